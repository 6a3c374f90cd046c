"""Approximate nearest neighbours by permutation index.

Every vector is represented by its nearest pivots in order. The rows are dealt to cells: that of the
nearest of the first few pivots; a cell with many rows is split. A query goes only to the cells whose
pivots are nearest to it. In a cell each pivot has an inverted file of the vectors that have it among
their places; a query walks the files of its own pivots only, and what it meets there is ranked by
Spearman's footrule, where a missing pivot counts as one place past the last. The share with the
least distances is ranked again by exact inner products, and the best of a query's cells are merged.
Equal vectors stand in the index once, with the ids that can matter to a query.

All vectors have as many places, so the footrule is a constant less twice the sum, over the shared
pivots, of how far the later one of the two places is from the end; only that sum is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import ship, written

#: Parameters of the query. Pivots are a bounded sample; all vectors are indexed. Without clusters in the data a
#: recall of 0.9 takes most cells (PROBE); where there are some, a smaller share will do.
PIVOTS, PLACES, PROBE, RERANK = 2048, 64, 0.85, 0.1
ROWS_PER_CELL, MOST_CELLS, ROWS_PER_BLOCK = 4096, 1024, 8192
#: Queries that meet a block in one task, about.
QUERIES_PER_GROUP = 16_384


def usable(vectors: DataFrame, *, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v and size of the vectors that take part, one row for each of theirs.

    Those without null or non-finite components and not all zero, of rows that have an id. Components keep their type.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).cast(kind).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))


def distinct(good: DataFrame, most: int) -> DataFrame:
    """id (the least), ids (the `most` least, ascending), v and size of the different vectors among rows (id, v, size)."""
    least = good.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= most)
    return least.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("size").alias("size"))


def sample_pivots(different: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """By size up to `n` of the different vectors, those with the least hashes."""
    by = Window.partitionBy("size").orderBy(F.xxhash64("id", F.lit("pivot")), "id", "v")
    found = different.select("size", "id", "v").withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).orderBy("size", "_n").toArrow()
    sizes = found.column("size").to_numpy()
    vectors = found.column("v")
    return {int(s): _matrix(vectors.filter(pa.array(sizes == s))).astype(np.float32) for s in np.unique(sizes)}


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def order(vectors: np.ndarray, pivots: np.ndarray, places: int, at_once: int = 2048) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; of equally near ones the earlier."""
    out = np.zeros((len(vectors), min(places, len(pivots))), np.int16)
    for s in range(0, len(vectors), at_once):
        near = -(vectors[s : s + at_once].astype(np.float32) @ pivots.T)
        if out.shape[1] < len(pivots):
            some = np.sort(np.argpartition(near, out.shape[1] - 1, axis=1)[:, : out.shape[1]], axis=1)
        else:
            some = np.tile(np.arange(len(pivots)), (len(near), 1))
        by = np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable")
        out[s : s + at_once] = np.take_along_axis(some, by, 1)
    return out


def nearest_cells(vectors: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The `n` nearest of the pivots that stand for cells, nearest first."""
    return np.argsort(-(vectors.astype(np.float32) @ pivots.T), axis=1, kind="stable")[:, :n].astype(np.int32)


def search_block(ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, orders: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_orders: np.ndarray, k: int, rerank: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of one block for each query.

    `ids` has the ids of the first of the (different) vectors, then those of the second, and so on,
    as many as `counts` says: of a vector that has more ids the k + 1 least will do. Vectors that
    tie with the last one of the share to be ranked are all ranked; so are all where a walk meets
    fewer than are to be ranked.
    """
    places = orders.shape[1]
    # the inverted files: rows, and how far from the end the place is, by pivot
    flat = orders.ravel()
    by = np.argsort(flat, kind="stable")
    rows, left = by // places, (places - by % places).astype(np.int16)
    cuts = np.searchsorted(flat[by], np.arange(flat.max(initial=0) + 2))
    most = len(cuts) - 2
    take = min(len(vectors), max(8 * k, int(np.ceil(rerank * len(vectors)))))
    starts = np.cumsum(counts) - counts
    own_left = (places - np.arange(query_orders.shape[1])).astype(np.int16)
    out = []
    for q, mine in enumerate(query_orders):
        here = mine <= most
        first, long = cuts[mine[here]], cuts[mine[here] + 1] - cuts[mine[here]]
        at = np.arange(long.sum()) + np.repeat(first - (np.cumsum(long) - long), long)
        shared = np.bincount(rows[at], np.minimum(left[at], np.repeat(own_left[here], long)), minlength=len(vectors))
        near = np.flatnonzero(shared >= np.partition(shared, len(shared) - take)[len(shared) - take])
        rough = vectors[near] @ queries[q]
        if len(near) > k + 1:  # all that may be among the k best besides the query, ties and rounding included
            near = near[rough >= np.partition(rough, len(near) - k - 1)[len(near) - k - 1] - 1e-9 * max(1.0, np.abs(rough).max())]
        score = (vectors[near] * queries[q]).sum(1)
        # from vectors to their ids, without the query's own row
        many = counts[near]
        of = np.repeat(np.arange(len(near)), many)
        names = ids[np.arange(many.sum()) + np.repeat(starts[near] - (np.cumsum(many) - many), many)]
        score = score[of]
        itself = np.flatnonzero(names == query_ids[q])
        itself = itself[(vectors[near[of[itself]]] == queries[q]).all(1)][:1]
        names, score = np.delete(names, itself), np.delete(score, itself)
        best = np.lexsort((names, -score))[:k]
        out.append((np.full(len(best), q), names[best], score[best]))
    if not out:
        return np.zeros(0, np.int64), ids[:0], np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _unpack(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), -1)


def nearest(vectors: DataFrame, *, k: int = 20, query: str = "id % 20 = 0", pivots: int = PIVOTS, places: int = PLACES, probe: float = PROBE, rerank: float = RERANK, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `query` selects (by `id`) its k nearest others.

    Nearest is the largest inner product in double precision, ties go to the smaller id. A query
    with fewer than k others gets all of them, without others none. Rows that `usable` leaves out
    are neither queries nor found. Repeated rows and rows that share an id are rows of their own: each
    query row has its own result, and only itself is left out of it. Vectors of different sizes have
    no inner product: those of one size are searched by themselves.

    A vector is shuffled once for every QUERIES_PER_GROUP queries, a query once for each block of the cells it goes to; so a group has a
    bounded number of both. To the driver come the pivots and one row for each size and cell.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = written(usable(vectors, key=key, embedding=embedding).withColumn("row", F.monotonically_increasing_id()), "vectors")
    different = written(distinct(good, k + 1), "different")
    sampled = sample_pivots(different, pivots)
    many = {r["size"]: r["count"] for r in different.groupBy("size").count().collect()}
    cells = {s: min(MOST_CELLS, len(sampled[s]), max(1, round(n / ROWS_PER_CELL))) for s, n in many.items()}
    held = spark.sparkContext.broadcast((sampled, cells))
    kind = different.schema["v"].dataType.simpleString()

    def placing(names: list[str], share: float):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sampled, cells = held.value
            for batch in batches:
                sizes = batch.column("size").to_numpy()
                for s in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == s))
                    v, p, n = _matrix(part.column("v")), sampled[int(s)], cells[int(s)]
                    orders = order(v, p, places)
                    near = nearest_cells(v, p[:n], max(1, int(np.ceil(share * n))))
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([x.tobytes() for x in orders], pa.binary()), listed], [*names, "places", "cells"])

        return place

    schema = {"id": "id long", "ids": "ids array<bigint>", "row": "row long", "v": f"v {kind}", "size": "size int"}
    placed = lambda df, names, share: df.select(*names).mapInArrow(placing(names, share), ", ".join(schema[c] for c in names) + ", places binary, cells array<int>")
    posted = written(placed(different.withColumn("id", F.col("id").cast("long")), ["id", "ids", "v", "size"], 0.0).withColumn("cell", F.get("cells", F.lit(0))).drop("cells"), "placed")
    # cells with more than a block's rows are split; one row for each cell comes back
    counts = posted.groupBy("size", "cell").count().collect()
    splits = spark.createDataFrame([(r["size"], r["cell"], max(1, -(-r["count"] // ROWS_PER_BLOCK))) for r in counts], "size int, cell int, parts int")
    # more queries than one group may hold are cut into slices, each of which meets the block anew
    asking = good.where(query).groupBy("size").count().collect()
    slices = spark.createDataFrame([(r["size"], max(1, -(-r["count"] // QUERIES_PER_GROUP))) for r in asking], "size int, slices int")
    part: Column = F.pmod(F.xxhash64("id", "v", F.lit("part")), F.col("parts")).cast("int")
    left = posted.join(F.broadcast(splits), ["size", "cell"]).withColumn("part", part).drop("parts")
    left = left.join(F.broadcast(slices), "size").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    right = placed(good.where(query), ["id", "row", "v", "size"], probe).withColumn("cell", F.explode("cells")).drop("cells")
    right = right.join(F.broadcast(splits), ["size", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = right.join(F.broadcast(slices), "size").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int")).drop("slices")

    def search(vecs: pa.Table, asks: pa.Table) -> pa.Table:
        query_ids, rows = asks.column("id").to_numpy(), asks.column("row").to_numpy()
        if not len(query_ids) or not vecs.num_rows:
            found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            ids = vecs.column("ids").combine_chunks()
            mine = ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64), _matrix(vecs.column("v")), _unpack(vecs.column("places"))
            found = search_block(*mine, query_ids, _matrix(asks.column("v")), _unpack(asks.column("places")), k, rerank)
        return pa.table({"row": pa.array(rows[found[0]], pa.int64()), "query_id": pa.array(query_ids[found[0]], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    by = ["size", "cell", "part", "slice"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "row long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
