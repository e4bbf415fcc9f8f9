"""Mining of legal forms: runs of words that open or close names, by place, and which of them are forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.numbers import half_up

#: Longest run of words; least share of a place's names; share at the other end beyond which a run is no form.
LONGEST, LEAST_SHARE, MOST_ELSEWHERE = 6, 0.02, 0.20


def edge_ngrams(named: DataFrame) -> DataFrame:
    """(place, side, gram, n, share) from (place, entity, name): distinct entities whose name opens or closes with the run."""
    words = named.select("place", "entity", F.split("name", " ").alias("w")).where(F.size("w") > 0)
    size = F.sequence(F.lit(1), F.least(F.size("w"), F.lit(LONGEST)))
    runs = F.concat(
        F.transform(size, lambda k: F.struct(F.lit("leading").alias("side"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("gram"))),
        F.transform(size, lambda k: F.struct(F.lit("trailing").alias("side"), F.array_join(F.slice("w", F.size("w") - k + 1, k), " ").alias("gram"))),
    )
    grams = words.select("place", "entity", F.inline(runs)).distinct().groupBy("place", "side", "gram").agg(F.count("*").alias("n"))
    totals = named.select("place", "entity").distinct().groupBy("place").agg(F.count("*").alias("entities"))
    return grams.join(totals, "place").select("place", "side", "gram", "n", half_up(F.col("n") / F.col("entities"), 6).alias("share"))


def mined_forms(named: DataFrame, structural: list[str]) -> DataFrame:
    """Trailing runs frequent enough to be legal forms, without those that a veto strikes.

    Vetoes: a structural word inside; as frequent at the other end; a collision, when leaving the run out would make the
    names of two entities of a place equal.
    """
    grams = edge_ngrams(named)
    side = lambda s: grams.where(F.col("side") == s).select("place", "gram", F.col("n").alias(s), F.col("share").alias(f"{s}_share"))
    both = side("trailing").join(side("leading"), ["place", "gram"], "left")
    fine = both.where(F.col("trailing_share") >= LEAST_SHARE).where(F.coalesce("leading", F.lit(0)) <= MOST_ELSEWHERE * F.col("trailing"))
    if structural:
        fine = fine.where(~F.arrays_overlap(F.split("gram", " "), F.array(*map(F.lit, structural))))
    stripped = named.join(fine.select("place", "gram"), "place").where(F.endswith("name", F.concat(F.lit(" "), "gram")))
    rest = stripped.select("place", "gram", "entity", F.expr("left(name, length(name) - length(gram) - 1)").alias("name"))
    others = named.select("place", F.col("entity").alias("other"), "name")
    clash = rest.join(others, ["place", "name"]).where("entity <> other").select("place", "gram").distinct()
    return fine.join(clash, ["place", "gram"], "left_anti").select("place", "gram", F.col("trailing").alias("n"), F.col("trailing_share").alias("share"))
