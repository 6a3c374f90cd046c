"""The items of largest inner product for every user of a factor model, without scoring every user with every item.

Users are dealt to cells, each a cone of directions about a centre. What the cone's users have at least is told by the longest items: the k-th
largest least score. An item whose largest score within the cone is lower can't be among the first k of any user there and is left out; so the
result is exact. Only the items left for a cell are scored with its users.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.sources.sinks import checkpointed

#: Up to so many pairs all are scored, by Spark's own recommender.
FEW_PAIRS = 1_000_000_000
#: At most so many cells, and so many of the longest items, are held at once.
CELLS, LONGEST = 2048, 20_000
#: Users and items that meet in one group, and items that one task looks through.
USERS_AT_ONCE, ITEMS_AT_ONCE, ITEMS_PER_TASK = 4096, 65_536, 20_000


def top_items(model: ALSModel, k: int, *, few: int = FEW_PAIRS) -> DataFrame:
    """user, rank (from 1), item: the k items that each user would rate highest; ties to the smaller item where not all pairs are scored."""
    users, items = model.userFactors, model.itemFactors
    if users.count() * items.count() > few:
        return largest_products(users, items, k)
    listed = model.recommendForAllUsers(k)
    placed = listed.select(F.col(model.getUserCol()).alias("user"), F.posexplode("recommendations").alias("at", "x"))
    return placed.select("user", (F.col("at") + 1).alias("rank"), F.col("x").getField(model.getItemCol()).alias("item"))


def largest_products(users: DataFrame, items: DataFrame, k: int, *, cells: int = CELLS, longest: int = LONGEST, users_at_once: int = USERS_AT_ONCE, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """user, rank, item from rows (id, features) of users and items. To the driver come `cells` users and `longest` items."""
    spark = users.sparkSession
    square = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    some = users.orderBy(F.xxhash64("id"), "id").limit(cells).select("features").toArrow().column("features").to_pylist()
    centres = _directions(np.array(some, np.float64))
    far = np.array(items.select("id", "features", square.alias("n")).orderBy(F.desc("n"), "id").limit(longest).select("features").toArrow().column("features").to_pylist(), np.float64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                x = np.array(part.column("features").to_pylist(), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                near = x @ centres.T
                cell = near.argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column("id"), part.column("features"), pa.array(near[np.arange(len(cell)), cell])], ["cell", "id", "features", "cos"])

    kind = users.schema["id"].dataType.simpleString()
    placed = checkpointed(users.mapInArrow(dealt, f"cell int, id {kind}, features array<float>, cos double"))
    told = placed.groupBy("cell").agg(F.min("cos").alias("cos"), F.count("*").alias("n")).orderBy("cell").collect()  # a row for each cell
    number = np.array([r["cell"] for r in told], np.int32)
    centres_, cos = centres[number], np.clip(np.array([r["cos"] for r in told]) - 1e-12, -1, 1)
    sin = np.sqrt(1 - cos**2)
    least = _least(centres_, cos, sin, far, k)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                v = np.array(part.column("features").to_pylist(), np.float64)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                along = v @ centres_.T
                most = along * cos + np.sqrt(np.maximum(size**2 - along**2, 0)) * sin
                most = np.where(along >= size * cos, size, most)
                row, at = np.nonzero(most >= least)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(number[at]), taken.column("id"), taken.column("features")], ["cell", "id", "features"])

    item_kind = items.schema["id"].dataType.simpleString()
    long_enough = items.where(square >= float(max(least.min(), 0.0)) ** 2 * (1 - 1e-9)).repartition(max(2 * spark.sparkContext.defaultParallelism, -(-items.count() // ITEMS_PER_TASK)))
    found = checkpointed(long_enough.mapInArrow(left, f"cell int, id {item_kind}, features array<float>"))
    # large cells are cut: every part of its users meets every part of its items
    parts = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))
    cut = F.broadcast(parts(placed, users_at_once, "slices").join(parts(found, items_at_once, "chunks"), "cell"))  # a row for each cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    own = placed.join(cut, "cell").withColumn("slice", some_of("slices")).withColumn("chunk", every("chunks")).select("cell", "slice", "chunk", "id", "features")
    their = found.join(cut, "cell").withColumn("chunk", some_of("chunks")).withColumn("slice", every("slices")).select("cell", "slice", "chunk", "id", "features")

    def scored(own: pa.Table, their: pa.Table) -> pa.Table:
        if not own.num_rows or not their.num_rows:
            return pa.table({"user": own.column("id").slice(0, 0), "item": their.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        user, item = own.column("id").to_numpy(), their.column("id").to_numpy()
        u, v = (np.array(x.column("features").to_pylist(), np.float64) for x in (own, their))
        out = []
        for s in range(0, len(u), 64):
            scores = u[s : s + 64] @ v.T
            n = min(k, len(v))
            row, at = np.nonzero(scores >= np.partition(scores, len(v) - n, axis=1)[:, len(v) - n, None])
            score = scores[row, at]
            order = np.lexsort((item[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < n
            out.append((user[s + row[first]], item[at[first]], score[first]))
        return pa.table({n: np.concatenate([x[i] for x in out]) for i, n in enumerate(("user", "item", "score"))})

    key = ["cell", "slice", "chunk"]
    best = own.groupBy(*key).cogroup(their.groupBy(*key)).applyInArrow(scored, f"user {kind}, item {item_kind}, score double")
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("user", "rank", "item")


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _least(centres: np.ndarray, cos: np.ndarray, sin: np.ndarray, items: np.ndarray, k: int) -> np.ndarray:
    """For each cone the k-th largest of the least scores that `items` have for a direction within it."""
    least = np.full(len(centres), -np.inf)
    if len(items) < k:
        return least
    size = np.linalg.norm(items, axis=1)
    for s in range(0, len(centres), 256):
        c, n = cos[s : s + 256, None], sin[s : s + 256, None]
        along = centres[s : s + 256] @ items.T
        low = np.where(along < -size * c, -size, along * c - np.sqrt(np.maximum(size**2 - along**2, 0)) * n)
        kth = np.partition(low, len(items) - k, axis=1)[:, len(items) - k]
        least[s : s + 256] = kth - 1e-9 * (1 + np.abs(kth))
    return least
