"""Joins that Spark has no operator for, as plans of equi-joins: ranges by bucket, distance by grid, unique matches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.numbers import haversine_m

#: Rows of a key that meet as many others at once.
PART = 1_000
#: Rows of a part of a large table.
ROWS = 1_000_000


def range_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, width: float, keys: Sequence[str] = (), residual: Column | None = None) -> DataFrame:
    """Rows of both sides with |left_at - right_at| <= width (numbers) and equal ``keys`` (of the same names).

    Each left row lies in one bucket of ``width``, each right row in its own and both neighbours: a matching pair meets in
    exactly one, so nothing need be made distinct. ``residual`` is a further condition. Other column names must differ.
    """
    a = left.withColumn("__b", F.floor(F.col(left_at) / width))
    b = right.withColumn("__b", F.explode(F.expr(f"array(floor({right_at} / {width}) - 1, floor({right_at} / {width}), floor({right_at} / {width}) + 1)")))
    joined = a.join(b, [*keys, "__b"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= width)
    return (joined if residual is None else joined.where(residual)).drop("__b")


def near_join(places: DataFrame, metres: float, key: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(a, b, metres) of places a < b at most ``metres`` apart but not at the same point.

    Places meet in cells of latitude and longitude that are wider than the distance (by the cosine of the cell row's
    higher latitude); each is compared with its own cell and the eight around it.
    """
    degrees = metres / 111_000.0
    p = places.select(F.col(key).alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).withColumn("row", F.floor(F.col("lat") / degrees).cast("long"))
    rows = p.withColumn("r", F.explode(F.array(*[F.col("row") + d for d in (-1, 0, 1)])))
    # a row's cells are as wide as its highest latitude needs; over the poles one cell takes all
    edge = F.greatest(F.abs(F.col("r")), F.abs(F.col("r") + 1)) * degrees
    step = F.when(edge + degrees >= 89.0, F.lit(360.0)).otherwise(degrees / F.cos(F.radians(edge + degrees)))
    cells = F.greatest(F.floor(F.lit(360.0) / step), F.lit(1))
    at = F.pmod(F.floor((F.col("lon") + 180.0) / (F.lit(360.0) / cells)), cells).cast("long")
    right = rows.select(F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), "r", F.explode(F.array_distinct(F.array(*[F.pmod(at + d, cells).cast("long") for d in (-1, 0, 1)]))).alias("c"))
    own = p.withColumn("r", F.col("row")).select(F.col("id").alias("a"), "lat", "lon", "r", at.alias("c"))
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))
    return own.join(right, ["r", "c"]).where("a < b").select("a", "b", distance.alias("metres")).where((F.col("metres") > 0) & (F.col("metres") <= metres))


def unique_matches(names: DataFrame, name: str, entity: str) -> DataFrame:
    """(name, entity) of names that belong to exactly one entity. Nothing is gathered by name but a least and a largest."""
    g = names.groupBy(name).agg(F.min(entity).alias("low"), F.max(entity).alias("high"))
    return g.where("low = high").select(name, F.col("low").alias(entity))


def ambiguous_matches(names: DataFrame, name: str, entity: str) -> DataFrame:
    """(name, n) of names that belong to more than one entity."""
    return names.groupBy(name).agg(F.count_distinct(entity).alias("n")).where("n > 1")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order; an argmin that combines before the shuffle, no sorting of groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def parts_of(df: DataFrame) -> int:
    """How many parts of about ``ROWS`` rows ``df`` takes, so that a task holds as much of a larger table; the session's
    number of shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key ``existing`` lacks, each key once."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def negative_sample(left: DataFrame, right: DataFrame, key: str, known: DataFrame | Callable[[Column, Column], Column], seed: int, each: int) -> DataFrame:
    """(a, b): of every row (key, id) of ``left``, its ``each`` rows of ``right`` with the same key and another id, least by
    a hash of the seed and both ids, without the pairs of ``known``: rows (a, b), or a condition on both that is never null.
    Nothing depends on order of arrival.

    A key's rows of ``right`` lie in lists of about ``PART``. A row of ``left`` meets them list by list and takes on its
    least of each, so no pair has a row of its own and no task holds more than lists.
    """
    a, b = left.where("id is not null").select(key, F.col("id").alias("a")), right.where("id is not null").select(key, F.col("id").alias("b"))
    parts = b.groupBy(key).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = b.join(parts, key).withColumn("q", F.expr("cast(pmod(xxhash64(b), parts) as int)"))
    lists = dealt.groupBy(key, "q").agg(F.collect_list("b").alias("bs"))
    met = a.join(parts, key).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # few bytes stand for much work: a number of tasks that is not made smaller
    met = met.repartition(4 * left.sparkSession.sparkContext.defaultParallelism, "a", "q").join(lists, [key, "q"])
    if isinstance(known, DataFrame):
        held = known.select("a", "b").distinct().join(dealt.select(key, "q", "b").distinct(), "b").groupBy("a", key, "q").agg(F.collect_list("b").alias("ks"))
        met = met.join(held, ["a", key, "q"], "left")
        met = met.withColumn("bs", F.when(F.col("ks").isNull(), F.col("bs")).otherwise(F.filter("bs", lambda x: ~F.array_contains("ks", x))))
    others = F.filter("bs", lambda x: (x != F.col("a")) if isinstance(known, DataFrame) else (x != F.col("a")) & ~known(F.col("a"), x))
    start = F.concat(F.lit(f"{seed}|"), F.col("a").cast("string"), F.lit("|"))
    least = lambda x: F.slice(F.sort_array(x), 1, each)
    drawn = met.withColumn("__s", start).select("a", least(F.transform(others, lambda x: F.struct(F.md5(F.concat("__s", x.cast("string"))).alias("h"), x.alias("b")))).alias("t"))
    return drawn.groupBy("a").agg(least(F.flatten(F.collect_list("t"))).alias("t")).select("a", F.explode("t.b").alias("b"))


def missing(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Values of ``column`` that ``known`` lacks: empty when integrity holds."""
    refs = rows.select(F.col(column).alias("ref")).where("ref is not null").distinct()
    return refs.join(known.select(F.col(key).alias("ref")), "ref", "left_anti")
