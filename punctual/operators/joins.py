"""Joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.formulas import EARTH_MILES, haversine
from punctual.sources.sinks import checkpointed


def join_dim(df: DataFrame, dim: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join with a dimension. Spark broadcasts it by its size, which is right at any scale."""
    return df.join(dim, on, how)


def join_roles(df: DataFrame, dim: DataFrame, roles: dict[str, str], key: str, how: str = "inner") -> DataFrame:
    """The same dimension once for each role: its columns come as role_column, joined where df's column equals `key`."""
    for role, col in roles.items():
        side = dim.select(*[F.col(c).alias(f"{role}_{c}") for c in dim.columns])
        df = df.join(side, F.col(col) == F.col(f"{role}_{key}"), how)
    return df


def build_airport_master(ids: DataFrame, codes: DataFrame, stations: DataFrame, zones: DataFrame, *, most_distance: float = 1.0) -> DataFrame:
    """ids (id) with their code row, own station within a distance, and time zone, each if there is one."""
    out = ids.join(codes, ids["id"] == codes["iata_code"], "left")
    near = stations.where(F.col("distance_to_neighbor") < most_distance)
    out = out.join(near, F.col("gps_code") == F.col("neighbor_call"), "left")
    return out.join(zones.withColumnRenamed("iata_code", "_zone_code"), F.col("id") == F.col("_zone_code"), "left").drop("_zone_code")


def hour_join(fact: DataFrame, hourly: DataFrame, *, entity: str, hour: str, roles: dict[str, str], fact_hour: Column, how: str = "inner") -> DataFrame:
    """A fact beside hourly readings: for each role (name: the fact's column) the reading of that entity at `fact_hour`.

    One hour key on both sides makes it an equi-join on (entity, hour). Readings are unique by both.
    """
    out = fact.withColumn("_hour", fact_hour)
    for role, col in roles.items():
        side = hourly.select(*[F.col(c).alias(f"{role}_{c}") for c in hourly.columns])
        out = out.join(side, (F.col(col) == F.col(f"{role}_{entity}")) & (F.col("_hour") == F.col(f"{role}_{hour}")), how)
    return out.drop("_hour")


def stored_hour_join(fact: DataFrame, hourly: DataFrame, *, entity: str, hour: str, day: str, roles: dict[str, str], fact_hour: Column, how: str = "inner") -> DataFrame:
    """`hour_join` with readings that are stored in one partition a day (column `day`, the date of `hour`).

    The days that the fact needs, a row each, are broadcast to the readings' scan, which then opens the partitions of those days only
    (dynamic partition pruning): a quarter of facts reads a quarter of readings. The equality of days is part of the join as well, so
    readings are never looked for in another day.
    """
    known = fact.withColumn("_hour", fact_hour).withColumn("_day", F.to_date("_hour"))
    days = known.where("_day is not null").select(F.col("_day").alias(day)).distinct()  # as many rows as there are days
    near = hourly.join(F.broadcast(days), day, "left_semi")
    out = known
    for role, col in roles.items():
        side = near.select(*[F.col(c).alias(f"{role}_{c}") for c in near.columns])
        out = out.join(side, (F.col(col) == F.col(f"{role}_{entity}")) & (F.col("_hour") == F.col(f"{role}_{hour}")) & (F.col("_day") == F.col(f"{role}_{day}")), how).drop(f"{role}_{day}")
    return out.drop("_hour", "_day")


#: Levels of the grid below: a cell of the last is about 300 m high.
LEVELS = 16


def _cell(level: Column | int, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Row and column of the cell of a level (0: the whole globe) in which a place lies."""
    n = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    at = lambda share: F.least(F.floor(share * n), n - 1).cast("long")
    return at((lat + 90) / 180), at((lon + 180) / 360)


def quadtree(points: DataFrame, *, most: int, levels: int = LEVELS) -> DataFrame:
    """level, row, col, n, leaf of every cell that holds points (columns lat, lon): a leaf has at most `most` points, or is of the last level, and no leaf lies in another.

    Places are counted once in the smallest cells; the larger ones are sums of these counts.
    """
    row, col = _cell(levels, F.col("lat"), F.col("lon"))
    smallest = points.where("lat is not null and lon is not null").groupBy(row.alias("r"), col.alias("c")).agg(F.count("*").alias("n"))
    above = smallest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), levels - F.col("level"))).cast("long")
    cells = above.groupBy("level", up("r").alias("row"), up("c").alias("col")).agg(F.sum("n").alias("n"))
    small = (F.col("n") <= most) | (F.col("level") == levels)
    parents = cells.where(~small).select((F.col("level") + 1).alias("level"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.lit(True).alias("_split"))
    marked = cells.withColumns({"_r": F.floor(F.col("row") / 2).cast("long"), "_c": F.floor(F.col("col") / 2).cast("long")}).join(parents, ["level", "_r", "_c"], "left")
    return marked.select("level", "row", "col", "n", (small & (F.col("_split") | (F.col("level") == 0))).alias("leaf"))


def _places(points: DataFrame) -> DataFrame:
    """_lat, _lon of every different place, null coordinates left out."""
    return points.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).where("_lat is not null and _lon is not null").distinct()


def _first_of_places(points: DataFrame, key: str, k: int) -> DataFrame:
    """_b, lat, lon: of each place the rows with the `k` least keys. They are equally far from anywhere and ties go by key, so no other is among the k nearest."""
    known = points.select(F.col(key).alias("_b"), "lat", "lon").where("lat is not null and lon is not null")
    w = Window.partitionBy("lat", "lon").orderBy("_b")
    return known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def knn_adaptive(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, k: int = 5, miles: float = 20.0, radius: float = EARTH_MILES, most: int = 256, levels: int = LEVELS) -> DataFrame:
    """left_key, right_key, miles, rank: the same as `knn_within`, on cells that are the smaller the denser places lie.

    The places of `right` lie in the leaves of a quadtree, so one dense city isn't one cell. A place of `left` looks no further than
    the size of the smallest cell around it that holds k rows, and meets the leaves that this circle touches. Ties by key; null coordinates find nothing.
    Different places are searched for once, however many rows lie there, and of a place of `right` k rows are enough.
    Work grows with the k neighbours of a place, not with how many places lie within `miles`.
    """
    right = checkpointed(_first_of_places(right, right_key, k))
    tree = checkpointed(quadtree(right, most=most, levels=levels))
    degree = radius * 3.141592653589793 / 180  # miles of a degree of latitude
    side = lambda level: F.lit(180.0) / F.pow(F.lit(2.0), level)  # noqa: E731  height of a cell in degrees; it is twice as wide
    every = F.sequence(F.lit(0), F.lit(levels))

    # how far each row has to look
    a = _places(left)
    around = a.withColumn("level", F.explode(every))
    row, col = _cell(F.col("level"), F.col("_lat"), F.col("_lon"))
    enough = tree.where(F.col("n") >= k).select("level", F.col("row").alias("_row"), F.col("col").alias("_col"))
    fit = around.withColumns({"_row": row, "_col": col}).join(enough, ["level", "_row", "_col"], "left_semi").groupBy("_lat", "_lon").agg(F.max("level").alias("_fit"))
    reach = F.least(F.lit(float(miles)), F.coalesce(3 * side(F.col("_fit")) * degree, F.lit(float(miles)))) * 1.000001 + 0.0002
    b = a.join(fit, ["_lat", "_lon"], "left").withColumn("_reach", reach).drop("_fit")

    # the cells of one level that its circle touches: a level whose cells are no smaller than the circle
    up = F.col("_reach") / degree
    steep = F.least(F.lit(90.0), F.abs("_lat") + up)
    wide = F.when(steep < 89.0, up / F.cos(F.radians(steep)) * 1.01).otherwise(F.lit(360.0))
    level = F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(F.log2(F.least(180.0 / (2 * up), 360.0 / (2 * wide)))))).cast("int")
    n = F.pow(F.lit(2.0), F.col("level"))
    low = lambda share: F.floor(F.greatest(F.lit(0.0), share) * n).cast("long")
    span = b.withColumns({"_wide": wide, "level": F.when(wide >= 180, F.lit(0)).otherwise(level)})
    rows = F.sequence(low((F.col("_lat") - up + 90) / 180), F.least(F.floor((F.col("_lat") + up + 90) / 180 * n), n - 1).cast("long"))
    cols = F.sequence(F.floor((F.col("_lon") - F.col("_wide") + 180) / 360 * n).cast("long"), F.floor((F.col("_lon") + F.col("_wide") + 180) / 360 * n).cast("long"))
    at = span.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(F.when(F.col("level") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform(cols, lambda c: F.pmod(c, n.cast("long")))))))
    leaves = tree.where("leaf").select(F.col("level").alias("_leaf"), F.col("row").alias("_lr"), F.col("col").alias("_lc"))
    half = lambda c, by: F.floor(F.col(c) / F.pow(F.lit(2.0), by)).cast("long")
    inside = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_leaf"))))
    inside = inside.withColumns({"_row": half("_lr", F.col("_leaf") - F.col("level")), "_col": half("_lc", F.col("_leaf") - F.col("level"))})
    larger = at.withColumn("_leaf", F.explode(F.when(F.col("level") > 0, F.sequence(F.lit(0), F.col("level") - 1)).otherwise(F.array().cast("array<int>"))))
    larger = larger.withColumns({"_lr": half("_row", F.col("level") - F.col("_leaf")), "_lc": half("_col", F.col("level") - F.col("_leaf"))})
    keep = ["_lat", "_lon", "_reach", "_leaf", "_lr", "_lc"]
    touched = at.join(inside, ["level", "_row", "_col"]).select(*keep).unionByName(larger.join(leaves, ["_leaf", "_lr", "_lc"]).select(*keep)).distinct()
    # of leaves that lie in those cells only what the circle's box touches
    top, bottom = (F.col("_lr") + 1) * side(F.col("_leaf")) - 90, F.col("_lr") * side(F.col("_leaf")) - 90
    touched = touched.where((F.col("_lat") + up >= bottom) & (F.col("_lat") - up <= top))

    # the places of those leaves
    c = right.select("_b", F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2"))
    r2, c2 = _cell(levels, F.col("_lat2"), F.col("_lon2"))
    smallest = c.withColumns({"_r": r2, "_c": c2})
    homes = smallest.select("_r", "_c").distinct().withColumn("_leaf", F.explode(every))
    homes = homes.withColumns({"_lr": half("_r", levels - F.col("_leaf")), "_lc": half("_c", levels - F.col("_leaf"))}).join(leaves, ["_leaf", "_lr", "_lc"])
    placed = smallest.join(homes, ["_r", "_c"]).drop("_r", "_c")
    met = touched.join(placed, ["_leaf", "_lr", "_lc"]).withColumn("miles", haversine(F.col("_lat"), F.col("_lon"), F.col("_lat2"), F.col("_lon2"), radius))
    near = met.where((F.col("miles") <= miles) & (F.col("miles") <= F.col("_reach")))
    w = Window.partitionBy("_lat", "_lon").orderBy("miles", "_b")
    ranked = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    found = ranked.select("_lat", "_lon", F.col("_b").alias(right_key), F.round("miles", 4).alias("miles"), "rank")
    own = left.select(left_key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct()
    return own.join(found, ["_lat", "_lon"]).select(left_key, right_key, "miles", "rank")


def knn_within(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, k: int = 5, miles: float = 20.0, radius: float = EARTH_MILES) -> DataFrame:
    """left_key, right_key, miles, rank: up to k rows of `right` within `miles` of each of `left` (columns lat, lon).

    Both sides are dealt to latitude bands as high as `miles`, so a row meets only three bands; within
    a band, to cells of longitude as wide as `miles` at the band's end nearer to a pole. Ties by key.
    Different places are searched for once, however many rows lie there, and of a place of `right` k rows are enough.
    """
    height = F.lit(miles / (radius * 3.141592653589793 / 180))

    def cells(band: Column) -> Column:
        """How many longitude cells a band has."""
        top = F.least(F.lit(89.9), F.greatest(F.abs(band), F.abs(band + 1)) * height)
        return F.greatest(F.lit(3), F.floor(360 * F.cos(F.radians(top)) / height * 0.98)).cast("long")

    def cell(lon: Column, band: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * cells(band)).cast("long"), cells(band))

    a = _places(left)
    b = _first_of_places(right, right_key, k).select(F.col("_b").alias(right_key), F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2"))
    b = b.withColumn("_band", F.floor(F.col("_lat2") / height).cast("long")).withColumn("_cell", cell(F.col("_lon2"), F.col("_band")))
    a = a.withColumn("_band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("_lat") / height).cast("long") + d)))
    near = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(cell(F.col("_lon"), F.col("_band")) + d, cells(F.col("_band")))))
    a = a.withColumn("_cell", F.explode(near))
    met = a.join(b, ["_band", "_cell"]).withColumn("miles", haversine(F.col("_lat"), F.col("_lon"), F.col("_lat2"), F.col("_lon2"), radius))
    w = Window.partitionBy("_lat", "_lon").orderBy("miles", right_key)
    ranked = met.where(F.col("miles") <= miles).withColumn("miles", F.round("miles", 4)).withColumn("rank", F.row_number().over(w))
    found = ranked.where(F.col("rank") <= k).select("_lat", "_lon", right_key, "miles", "rank")
    own = left.select(left_key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return own.join(found, ["_lat", "_lon"]).select(left_key, right_key, "miles", "rank")


def grid_join(left: DataFrame, right: DataFrame, digits: int = 1) -> DataFrame:
    """Rows whose coordinates (lat, lon) are the same when rounded."""
    cells = lambda d: d.withColumns({"_lat": F.round("lat", digits), "_lon": F.round("lon", digits)}).drop("lat", "lon")
    return cells(left).join(cells(right), ["_lat", "_lon"]).withColumnsRenamed({"_lat": "grid_lat", "_lon": "grid_lon"})


def resolve_station(master: DataFrame, nearest: DataFrame, *, key: str, own: str, other: str) -> DataFrame:
    """`master` with `station`: its own, else that of the first-ranked row of `nearest`."""
    first = nearest.where(F.col("rank") == 1).select(F.col(key), F.col(other).alias("_near"))
    return master.join(first, key, "left").withColumn("station", F.coalesce(own, "_near")).drop("_near")


def drop_unmatched(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def two_way_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, outbound, inbound: rows from a to b and from b to a, for all pairs that are there in any direction."""
    there = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("outbound"))
    back = there.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("outbound").alias("inbound"))
    return there.join(back, ["a", "b"], "full_outer").fillna(0, ["outbound", "inbound"])


def key_diff(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """on, side: keys that only one side has."""
    x, y = (d.select(on).where(F.col(on).isNotNull()).distinct().withColumn(n, F.lit(True)) for d, n in ((a, "_a"), (b, "_b")))
    both = x.join(y, on, "full_outer").where("_a is null or _b is null")
    return both.select(on, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def keep_listed(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """All listed keys, with their rows if there are any."""
    return df.join(keys.select(on).distinct(), on, "right")


def flag_ratio(df: DataFrame, keys: list[str], flag: str, *, inner_only: bool = False) -> DataFrame:
    """keys, n0, n1, ratio (n1 of both): rows by a 0/1 flag side by side, in one pass."""
    out = df.groupBy(*keys).agg(F.count_if(F.col(flag) == 0).alias("n0"), F.count_if(F.col(flag) == 1).alias("n1"))
    out = out.withColumn("ratio", F.try_divide(F.col("n1").cast("double"), F.col("n0") + F.col("n1")))
    return out.where("n0 > 0 and n1 > 0") if inner_only else out


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """`df` with `share` of the sum of `value`. The total is one row."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.join(F.broadcast(total)).withColumn("share", F.col(value) / F.col("_total")).drop("_total")


def prior_event_band(df: DataFrame, key: str, ts: str, value: str, *, lo: int = 8100, hi: int = 86400) -> DataFrame:
    """`df` with prior_value and prior_gap of the latest earlier row of the key whose gap is over lo and under hi seconds.

    A window over a range of seconds; no row meets another. A key's rows are dealt to spans of `hi`
    seconds, each row also to the span after its own, so that long histories are split. Rows with a null key or time have no prior row.
    """
    known = df.withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp")))
    w = Window.partitionBy(key, "_span.b").orderBy("_s").rangeBetween(-(hi - 1), -(lo + 1))
    last = F.max(F.struct("_s", value)).over(w)
    usable = F.col(key).isNotNull() & F.col("_s").isNotNull()
    span = F.floor(F.col("_s") / hi)
    spans = F.explode(F.array(F.struct(span.alias("b"), F.lit(True).alias("own")), F.struct((span + 1).alias("b"), F.lit(False).alias("own"))))
    dealt = known.where(usable).withColumn("_span", spans)
    found = dealt.withColumn("_p", last).where("_span.own").drop("_span").withColumns({"prior_value": F.col(f"_p.{value}"), "prior_gap": F.col("_s") - F.col("_p._s")})
    rest = known.where(~usable).withColumns({"prior_value": F.lit(None).cast(df.schema[value].dataType), "prior_gap": F.lit(None).cast("long")})
    return found.drop("_p").unionByName(rest).drop("_s")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys more than one row has."""
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(many, keys, "left_semi")


def with_names(top: DataFrame, names: DataFrame, on: str = "id") -> DataFrame:
    return top.join(names, on, "left")
