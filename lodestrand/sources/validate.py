"""Checks of a loaded corpus: volume, structure and safety, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.extract import ITEM_TYPES


def validate(tables: dict[str, DataFrame], least_items: int = 1) -> DataFrame:
    """(id, name, ok, detail). Each check is one aggregate over its table."""
    items, places, calls, pays = (tables[n] for n in ("evidence_items", "locations", "communication_events", "financial_transactions"))
    one = lambda df, bad: df.agg(F.count_if(bad).alias("n")).select("n")
    text = lambda p: F.get_json_object("content", p)
    checks = [
        ("volume_items", items.agg(F.when(F.count("*") >= least_items, 0).otherwise(1).cast("long").alias("n"))),
        ("unique_item_ids", items.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n"))),
        ("known_item_types", one(items, ~F.col("item_type").isin(ITEM_TYPES))),
        ("items_have_content", one(items, F.col("content").isNull() | (F.col("content") == "{}"))),
        ("unique_places", places.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n"))),
        ("places_on_earth", one(places, ~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180) | F.col("lat").isNull())),
        ("places_have_labels", one(places, F.coalesce("label", F.lit("")) == "")),
        ("calls_have_two_ends", one(calls, F.col("caller").isNull() | F.col("callee").isNull() | (F.col("caller") == F.col("callee")))),
        ("calls_last_no_less_than_nothing", one(calls, F.col("duration") < 0)),
        ("calls_have_times", one(calls, F.try_to_timestamp("at").isNull())),
        ("calls_at_known_places", calls.where("location_key is not null").join(places.select(F.col("key").alias("location_key")), "location_key", "left_anti").agg(F.count("*").alias("n"))),
        ("calls_cite_items", calls.join(items.select(F.col("id").alias("evidence_item_id")), "evidence_item_id", "left_anti").agg(F.count("*").alias("n"))),
        ("payments_are_positive", one(pays, ~(F.col("amount") > 0))),
        ("payments_have_times", one(pays, F.try_to_timestamp("at").isNull())),
        ("payments_cite_items", pays.join(items.select(F.col("id").alias("evidence_item_id")), "evidence_item_id", "left_anti").agg(F.count("*").alias("n"))),
        ("synthetic_phones", one(items, text("$.number").isNotNull() & ~text("$.number").rlike(r"^\+99"))),
    ]
    out = None
    for k, (name, df) in enumerate(checks):
        row = df.select(F.lit(f"V{k + 1}").alias("id"), F.lit(name).alias("name"), (F.col("n") == 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" violations")).alias("detail"))
        out = row if out is None else out.unionByName(row)
    return out
