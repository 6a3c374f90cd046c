"""Graph operators over edges (src, dst, weight). A node without outgoing edges may have a row without dst."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.sources.sinks import checkpointed, remove_path, shared_folder


def nodes(edges: DataFrame) -> DataFrame:
    """id of every node, dangling ones too."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()


def count_nodes(edges: DataFrame) -> DataFrame:
    """n_nodes, n_dangling."""
    both = nodes(edges).join(edges.where("dst is not null").select(F.col("src").alias("id")).distinct().withColumn("_out", F.lit(True)), "id", "left")
    return both.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("_out").isNull()).alias("n_dangling"))


def init_ranks(edges: DataFrame) -> DataFrame:
    """id, rank: 1 / N for every node."""
    ids = nodes(edges)
    return ids.join(F.broadcast(ids.agg(F.count("*").alias("_n")))).select("id", (1 / F.col("_n")).alias("rank"))


@dataclass(frozen=True)
class StoredLinks:
    """Links (src, dst, part of src's weight) as they are stored for many rounds: in buckets by src, but for those of hubs."""

    links: DataFrame
    buckets: int
    hubs: DataFrame | None
    nodes: DataFrame  # id, _out: whether it has links, else null


#: A node is a hub whose links are over one in so many of all, which bounds their number.
HUBS = 1000


@contextmanager
def stored_links(edges: DataFrame, *, hub_links: int = 1_000_000) -> Iterator[StoredLinks]:
    """Store the links once, bucketed by `src`, while the block runs; `edges` is read once.

    Joins with a table that is bucketed alike by node then move no links. The links of hubs (nodes with over `hub_links` links and
    over one in HUBS of all) are stored apart, as they come, and meet their hubs, HUBS at most, by broadcast; so no task has all links of a hub.
    """
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = checkpointed(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))  # rows without dst stay, as nodes
    total = checkpointed(summed.groupBy("src").agg(F.sum(F.when(F.col("dst").isNotNull(), F.col("weight"))).alias("_sum"), F.count("dst").alias("_n")))
    facts = total.agg(F.sum("_n").alias("links"), F.max("_n").alias("most")).first()
    parts = summed.where("dst is not null").join(total.select("src", "_sum", "_n"), "src").select("src", "dst", (F.col("weight") / F.col("_sum")).alias("part"), "_n")
    least = max(hub_links, (facts["links"] or 0) / HUBS)
    apart = checkpointed(parts.where(F.col("_n") > least).drop("_n")) if (facts["most"] or 0) > least else None
    stored = BucketedTable.write(parts.where(F.col("_n") <= least).drop("_n"), "src", buckets)
    # one row a node: those that links lead to, and those with a row of their own
    ids = summed.where("dst is not null").groupBy(F.col("dst").alias("id")).agg(F.lit(None).cast("boolean").alias("_out"))
    own = total.where("src is not null").select(F.col("src").alias("id"), F.when(F.col("_n") > 0, True).alias("_out"))
    nodes_ = ids.unionByName(own).groupBy("id").agg(F.max("_out").alias("_out"))
    try:
        yield StoredLinks(stored.read(), buckets, apart, nodes_)
    finally:
        stored.drop()


@dataclass(frozen=True)
class BucketedTable:
    """A table in the shared folder, dealt to buckets by one column."""

    spark: SparkSession
    name: str
    path: str

    @classmethod
    def write(cls, df: DataFrame, by: str, buckets: int) -> BucketedTable:
        name = f"bucketed_{uuid.uuid4().hex}"
        path = f"{shared_folder(df.sparkSession)}/{name}"
        df.write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
        return cls(df.sparkSession, name, path)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_path(self.spark, self.path)


def followed(now: DataFrame, stored: StoredLinks, values: list[str]) -> DataFrame:
    """id and the sums of `values` that links carry to it by their parts, from rows (id, values) dealt by id as the links are by src.

    Only what is carried is shuffled, once, by where it goes.
    """
    carried = [(F.col(v) * F.col("part")).alias(v) for v in values]
    sent = now.join(stored.links, now["id"] == F.col("src")).select("dst", *carried)
    if stored.hubs is not None:
        own = now.join(F.broadcast(stored.hubs.select(F.col("src").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("src"), *values)
        sent = sent.unionByName(stored.hubs.join(F.broadcast(own), "src").select("dst", *carried))
    return sent.groupBy(F.col("dst").alias("id")).agg(*[F.sum(v).alias(v) for v in values])


def pagerank(edges: DataFrame, alpha: float = 0.15, iters: int = 10, *, tolerance: float | None = None, hub_links: int = 1_000_000) -> DataFrame:
    """id, rank: teleport `alpha`, the mass of dangling nodes spread over all, edges followed by weight.

    Ranks and links are tables bucketed by node, so that a round moves what links carry and nothing else; each round writes
    its ranks anew, which also cuts their lineage. With a tolerance it stops once the ranks' changes sum to less.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    with stored_links(edges, hub_links=hub_links) as stored:
        table = BucketedTable.write(stored.nodes, "id", stored.buckets)
        n = table.read().count()
        now = table.read().select("id", "_out", F.lit(1 / n if n else None).alias("rank"))
        for _ in range(iters if n else 0):
            lost = now.agg(F.sum(F.when(F.col("_out").isNull(), F.col("rank")))).first()[0] or 0.0
            rank = F.lit((alpha + (1 - alpha) * lost) / n) + (1 - alpha) * F.coalesce("_in", F.lit(0.0))
            came = followed(now.select("id", F.col("rank").alias("_in")), stored, ["_in"])
            new = BucketedTable.write(now.join(came, "id", "left").select("id", "_out", rank.alias("rank"), F.col("rank").alias("_old")), "id", stored.buckets)
            table.drop()
            table, now = new, new.read()
            if tolerance is not None and now.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0] < tolerance:
                break
    spark.sql(f"DROP TABLE IF EXISTS {table.name}")  # the files stay, in the folder of checkpoints
    if not n or not iters:
        return spark.read.schema(f"id {kind}").parquet(table.path).withColumn("rank", F.lit(1 / n if n else None).cast("double"))
    return spark.read.schema(f"id {kind}, rank double").parquet(table.path)


def steady_state(edges: DataFrame, iters: int = 50, **more) -> DataFrame:
    """PageRank without teleport: power iteration of the walk."""
    return pagerank(edges, alpha=0.0, iters=iters, **more)


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, in one pass over the edges."""
    ends = edges.where("dst is not null").select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """n_nodes, mean_out, max_out."""
    d = nodes(edges).join(degrees(edges), "id", "left")
    return d.agg(F.count("*").alias("n_nodes"), F.avg(F.coalesce("out_degree", F.lit(0))).alias("mean_out"), F.max(F.coalesce("out_degree", F.lit(0))).alias("max_out"))


def degree_report(edges: DataFrame, *, top: int = 10, sampled: int = 1000) -> DataFrame:
    """kind (top or sample), place, id, out_degree: the nodes with most outgoing edges, and `sampled` nodes chosen by the MD5 of their id.

    Each is a bottom-k: every task hands on its first `top` or `sampled` rows only, and these are merged; the degrees are
    counted once. Ties of degree go to the lesser id; dangling nodes count with 0.
    """
    d = checkpointed(nodes(edges).join(degrees(edges), "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree")))

    def first(kind: str, n: int, *order: Column) -> DataFrame:
        few = d.orderBy(*order).limit(n)  # a top-k in every task, then among those
        rows = few.agg(F.collect_list(F.struct("id", "out_degree")).alias("rows"))  # n rows, in order
        return rows.select(F.lit(kind).alias("kind"), F.posexplode("rows").alias("place", "r")).select("kind", (F.col("place") + 1).alias("place"), "r.id", "r.out_degree")

    return first("top", top, F.desc("out_degree"), F.col("id")).unionByName(first("sample", sampled, F.md5(F.col("id").cast("string")), F.col("id")))


def sssp(edges: DataFrame, source, *, weighted: bool = False, most_rounds: int = 1000) -> DataFrame:
    """id, distance of all nodes that can be reached from `source`.

    Each round follows the edges of the nodes that got nearer in the last one, and ends when none did.
    """
    steps = edges.where("dst is not null").select("src", "dst", (F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("w"))
    found = checkpointed(nodes(edges).where(F.col("id") == source).select("id", F.lit(0.0).alias("distance"), F.lit(True).alias("_new")))
    for _ in range(most_rounds):
        came = found.where("_new").join(steps, F.col("id") == F.col("src")).groupBy("dst").agg(F.min(F.col("distance") + F.col("w")).alias("_d"))
        both = found.join(came.withColumnRenamed("dst", "id"), "id", "full_outer")
        nearer = F.col("distance").isNull() | F.coalesce(F.col("_d") < F.col("distance"), F.lit(False))
        found = checkpointed(both.select("id", F.least("distance", "_d").alias("distance"), nearer.alias("_new")))
        if found.where("_new").isEmpty():
            return found.select("id", "distance")
    raise RuntimeError(f"not settled in {most_rounds} rounds")


def delta_stepping(edges: DataFrame, source, *, delta: float | None = None, most_rounds: int = 10_000, tasks: int | None = None, watch=None) -> DataFrame:
    """id, distance by weight of all nodes that can be reached from `source`; weights are 0 or more.

    Distances are settled bucket by bucket, each `delta` wide: within a bucket light edges (up to `delta`) are followed until
    nothing in it gets nearer; then its heavy edges are followed once, as they can't lead back into it. So an edge
    of a node that still gets nearer isn't followed for every improvement, unlike in `sssp`. The default `delta` is the mean
    weight. Edges are summed up in `tasks` tasks, or as many as Spark thinks fit. `watch` is called with each round's kind and bucket.
    """
    there = edges.where("dst is not null").select("src", "dst", F.col("weight").cast("double").alias("w"))
    steps = checkpointed((there.repartition(tasks, "src", "dst") if tasks else there).groupBy("src", "dst").agg(F.min("w").alias("w")))
    facts = steps.agg(F.min("w").alias("least"), F.avg("w").alias("mean")).first()
    if facts["least"] is not None and facts["least"] < 0:
        raise ValueError("a weight is below 0")
    wide = delta or facts["mean"] or 1.0
    light, heavy = steps.where(F.col("w") <= wide), steps.where(F.col("w") > wide)
    bucket = lambda c: F.floor(F.col(c) / F.lit(wide))
    # the start, if it is a node: only its own edges are looked at for that
    begin = nodes(edges.where((F.col("src") == source) | (F.col("dst") == source))).where(F.col("id") == source)
    # _todo: got nearer and light edges not followed since; _heavy: heavy edges not followed since
    found = checkpointed(begin.select("id", F.lit(0.0).alias("distance"), F.lit(True).alias("_todo"), F.lit(True).alias("_heavy")))

    def relaxed(found: DataFrame, front: Column, along: DataFrame, done: str) -> DataFrame:
        came = found.where(front).join(along, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("_d"))
        both = found.withColumn("_front", front).join(came, "id", "full_outer")
        nearer = F.col("distance").isNull() | F.coalesce(F.col("_d") < F.col("distance"), F.lit(False))
        keep = {c: nearer | (F.coalesce(F.col(c), F.lit(False)) & ~(F.coalesce(F.col("_front"), F.lit(False)) if c == done else F.lit(False))) for c in ("_todo", "_heavy")}
        return checkpointed(both.select("id", F.least("distance", "_d").alias("distance"), *[x.alias(c) for c, x in keep.items()]))

    for _ in range(most_rounds):
        at = found.where("_todo OR _heavy").agg(F.min(bucket("distance")).alias("b"), F.min(F.when(F.col("_todo"), bucket("distance"))).alias("t")).first()
        if at["b"] is None:
            return found.select("id", "distance")
        here = bucket("distance") == at["b"]
        if at["t"] == at["b"]:
            found = relaxed(found, F.col("_todo") & here, light, "_todo")
        else:
            found = relaxed(found, F.col("_heavy") & here, heavy, "_heavy")
        if watch:
            watch("light" if at["t"] == at["b"] else "heavy", at["b"])
    raise RuntimeError(f"not settled in {most_rounds} rounds")


def bfs(edges: DataFrame, start: DataFrame, goal: DataFrame, max_len: int = 10) -> DataFrame:
    """path (array of ids): the shortest paths from any id of `start` to any of `goal`, none if there are none within `max_len`.

    Nodes are visited once; a path is kept for each node and start that reaches it first.
    """
    spark = edges.sparkSession
    steps = edges.where("dst is not null").select("src", "dst").distinct()
    front = checkpointed(start.select("id", F.array("id").alias("path")))
    seen = front.select("id").distinct()
    ends = goal.select("id").distinct()
    for n in range(max_len + 1):
        hits = front.join(ends, "id", "left_semi").select("path")
        if not hits.isEmpty():
            return hits
        if n == max_len:
            break
        came = front.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        front = checkpointed(came.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front.select("id")))
    return spark.createDataFrame([], front.select("path").schema)
