"""Aggregations of the evidence pipeline: edges from contributions, roll-ups, censuses, document frequencies, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.numbers import half_up, ratio

CLASSES = ["observed_fact", "corroborated_fact", "algorithmic_signal", "ai_inference", "investigative_lead"]


def classified(evidence: Column, forced: Column | None = None) -> Column:
    """corroborated_fact from two distinct evidence items on, unless a contribution forces ai_inference."""
    seen = F.when(evidence >= 2, "corroborated_fact").otherwise("observed_fact")
    return seen if forced is None else F.when(forced, "ai_inference").otherwise(seen)


def aggregate_edges(contributions: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges from (type, src, dst, evidence_id, record_id, at, duration, amount, currency, method).

    Sets are gathered as distinct rows before they are folded; sums stay null without a contribution; currency is that of
    the largest record id, method that of the least. ``parts``: contributions are dealt to so many before they are folded,
    once, so that no sets are gathered, sorted and spilled on both sides of the exchange.
    """
    if parts:
        contributions = contributions.repartition(parts, "type", "src", "dst")
    return contributions.groupBy("type", "src", "dst").agg(
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.array_sort(F.collect_set("record_id")).alias("record_ids"),
        F.count("*").alias("event_count"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.sum("duration").alias("total_duration"), F.sum("amount").alias("total_amount"),
        F.max_by("currency", F.when(F.col("currency").isNotNull(), F.col("record_id"))).alias("currency"), F.min_by("method", "record_id").alias("method"),
    ).withColumn("classification", classified(F.size("evidence_ids")))


def sliced_rates(df: DataFrame, slices: Sequence[str], hit: Column) -> DataFrame:
    """(slice, value, n, hits, rate): how many rows of each value of each of ``slices`` are a ``hit``; a null value is "null"."""
    values = F.array(*[F.struct(F.lit(s).alias("slice"), F.coalesce(F.col(s).cast("string"), F.lit("null")).alias("value")) for s in slices])
    rows = df.select(F.explode(values).alias("s"), F.coalesce(hit, F.lit(False)).alias("hit"))
    g = rows.groupBy("s.slice", "s.value").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    return g.withColumn("rate", half_up(F.col("hits") / F.col("n"), 6))


def census(df: DataFrame, column: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A column of counts for each of ``values``, zeros included."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v.lower().replace(" ", "_")) for v in values])


def document_frequency(words: DataFrame, word: str, document: str, least: int = 2, distinct: bool = False) -> DataFrame:
    """(word, df): documents that hold it, if at least ``least``. ``distinct``: no document has a word twice in ``words``."""
    rows = words.select(word, document)
    return (rows if distinct else rows.distinct()).groupBy(word).agg(F.count("*").alias("df")).where(F.col("df") >= least)


def idf(df: Column, documents: Column) -> Column:
    """ln(1 + N/df) / ln(1 + N): 1 for what a single document holds; an unseen word counts as that."""
    return F.log(1 + documents / F.coalesce(df, F.lit(1))) / F.log(1 + documents)


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row of counts, precision, recall, F1, false-merge and false-split rates of (label 0/1, score); 0 where undefined."""
    said = F.col("score") >= threshold
    c = scored.agg(F.count_if(said & (F.col("label") == 1)).alias("tp"), F.count_if(said & (F.col("label") == 0)).alias("fp"), F.count_if(~said & (F.col("label") == 1)).alias("fn"), F.count_if(~said & (F.col("label") == 0)).alias("tn"))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0))
    return c.select("tp", "fp", "fn", "tn", *[half_up(x, 6).alias(n) for n, x in (("precision", F.col("precision")), ("recall", F.col("recall")), ("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0)), ("false_merge_rate", ratio(F.col("fp"), F.col("fp") + F.col("tn"), 0.0)), ("false_split_rate", ratio(F.col("fn"), F.col("fn") + F.col("tp"), 0.0)))])


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` and, for each of ``sums``, its total over all rows up to and including this one in ``order`` (a total order).

    Rows are dealt by ranges of the order, summed within their range, and shifted by the sums of the ranges before: no
    task holds more than a range, and only a row for each range goes through one task.
    """
    from lodestrand.operators.graph import cut  # that module needs this one

    names = list(sums)
    dealt = cut(df.withColumns({f"__{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("__part").agg(*[F.sum(f"__{n}").alias(n) for n in names])
    shift = ranges.select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__b_{n}") for n in names])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(shift), "__part")
    return out.select(*df.columns, *[(F.sum(f"__{n}").over(inside) + F.col(f"__b_{n}")).alias(n) for n in names])


def _tie_groups(scored: DataFrame, inside: Column | None = None) -> DataFrame:
    """Positives p, negatives n and rows ``inside`` s of each score, and tp, fp and sp of it and all higher ones."""
    s = F.count_if(F.lit(False) if inside is None else inside).cast("double").alias("s")
    g = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).cast("double").alias("p"), F.count_if(F.col("label") == 0).cast("double").alias("n"), s)
    return running_sums(g, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n"), "sp": F.col("s"), "place": F.lit(1)})


def _totals(groups: DataFrame) -> DataFrame:
    """One row: all positives, negatives and distinct scores."""
    return groups.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("all_p"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("all_n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s"), F.count("*").alias("len"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Chance that a positive scores above a negative, ties half; NaN without both."""
    g = _tie_groups(scored)
    pairs = g.agg(F.sum(F.col("p") * F.col("n") / 2 + F.col("n") * (F.col("tp") - F.col("p"))).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return pairs.select(F.when((F.col("p") > 0) & (F.col("n") > 0), half_up(F.col("won") / (F.col("p") * F.col("n")), 6)).otherwise(F.lit(float("nan"))).alias("roc_auc"))


def pr_auc(scored: DataFrame) -> DataFrame:
    """Area under precision over recall by trapezoids between groups of equal scores, from (0, 1); NaN without positives."""
    g = _tie_groups(scored)
    points = g.crossJoin(F.broadcast(_totals(g))).where("all_p > 0")  # one row
    above = F.col("tp") - F.col("p") + F.col("fp") - F.col("n")
    before = F.when(above > 0, (F.col("tp") - F.col("p")) / above).otherwise(F.lit(1.0))
    area = points.agg(F.sum(F.col("p") / F.col("all_p") * (F.col("tp") / (F.col("tp") + F.col("fp")) + before) / 2).alias("a"))
    return area.select(F.coalesce(half_up(F.col("a"), 6), F.lit(float("nan"))).alias("pr_auc"))


def threshold_selection(scored: DataFrame, ceiling: float, limit: int = 400, subset: str | None = None, subset_ceiling: float = 1.0) -> DataFrame:
    """One row (threshold, f1, false_merge_rate, feasible): best F1 among thresholds whose false-merge rate stays within
    ``ceiling``, the lowest of equal ones; without such a threshold the best of all. Distinct scores, at most ``limit`` by stride.

    ``subset``: a boolean column; among its negatives, too, no more than ``subset_ceiling`` may be merged (none: no bound).
    """
    inside = F.coalesce(F.col(subset), F.lit(False)) & (F.col("label") == 0) if subset else F.lit(False)
    g = _tie_groups(scored, inside)
    t = g.crossJoin(F.broadcast(_totals(g))).withColumn("k", F.col("len") - F.col("place"))  # one row; k counts from the lowest
    picked = (F.col("len") <= limit) | (F.floor(F.ceil(F.col("k") * limit / F.col("len")) * F.col("len") / limit) == F.col("k"))
    m = t.where(picked).withColumn("f1", ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_p"), 0.0)).withColumn("fmr", ratio(F.col("fp"), F.col("all_n"), 0.0))
    ok = (F.col("fmr") <= ceiling) & (ratio(F.col("sp"), F.col("all_s"), 0.0) <= subset_ceiling)
    best = m.agg(F.max_by(F.struct(F.col("score").alias("threshold"), "f1", "fmr", ok.alias("feasible")), F.struct(ok.alias("ok"), half_up(F.col("f1"), 12), -F.col("score"))).alias("b"))
    return best.select("b.threshold", half_up(F.col("b.f1"), 6).alias("f1"), half_up(F.col("b.fmr"), 6).alias("false_merge_rate"), "b.feasible")


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation (1 where it is 0) of each column, as rows (feature, mean, deviation)."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("deviation")) for c in columns])
    return stats.select(F.explode(rows).alias("r")).select("r.feature", half_up(F.col("r.mean"), 4).alias("mean"), half_up(F.col("r.deviation"), 4).alias("deviation"))


def pair_counts(assigned: DataFrame, truth: str, system: str) -> DataFrame:
    """Pairwise (tp, fp, fn, precision, recall, f1) of two groupings of the same rows, from group sizes alone."""
    pairs = lambda *by: assigned.groupBy(*by).count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).alias("n"))
    both, t, s = pairs(truth, system).toDF("tp"), pairs(truth).toDF("t"), pairs(system).toDF("s")
    c = both.crossJoin(t).crossJoin(s).select("tp", (F.col("s") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))  # one row each
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", half_up(p, 6).alias("precision"), half_up(r, 6).alias("recall"), half_up(ratio(2 * p * r, p + r), 6).alias("f1"))
