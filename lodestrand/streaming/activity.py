"""Activity as a stream: windowed counts, overlaps in time, and idempotent appends of late batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.numbers import WINDOW_S
from lodestrand.sources.tables import Store


def counts(events: DataFrame, late: str = "1 hour", length: str = "30 minutes", slide: str = "10 minutes") -> DataFrame:
    """Events of each place in sliding windows of event time; what is later than ``late`` is left out."""
    w = events.withWatermark("at", late).groupBy(F.window("at", length, slide).alias("w"), "location")
    return w.agg(F.count("*").alias("n"), F.approx_count_distinct("subject").alias("subjects")).select("location", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "subjects")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a subject's events without a pause longer than ``gap``."""
    s = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "subject")
    return s.agg(F.count("*").alias("n")).select("subject", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def overlaps(left: DataFrame, right: DataFrame, window_s: int = WINDOW_S, late: str = "1 hour") -> DataFrame:
    """Pairs of events of two streams at one place within the window; state is bounded by the watermarks."""
    a = left.withWatermark("at", late).select(F.col("location"), F.col("subject").alias("subject_a"), F.col("at").alias("at_a"), F.col("record_id").alias("record_a"))
    b = right.withWatermark("at", late).select(F.col("location").alias("l"), F.col("subject").alias("subject_b"), F.col("at").alias("at_b"), F.col("record_id").alias("record_b"))
    near = F.expr(f"location = l and subject_a < subject_b and at_b between at_a - interval {window_s} seconds and at_a + interval {window_s} seconds")
    return a.join(b, near).drop("l")


def append(store: Store, name: str):
    """A sink for ``foreachBatch`` that adds each row once, however often a batch is repeated."""
    return lambda batch, _: store.append_if_absent(name, batch)
