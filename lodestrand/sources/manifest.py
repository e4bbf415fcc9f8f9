"""Corpus manifests: one JSON document to tables of sources, items, locations, calls and payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.ids import content_id

#: Parts of an answer key, which a manifest must not hold.
ANSWER_KEYS = ["keyActors", "expectedEntityMerges", "doNotMerge", "expectedRelationships", "hiddenConnections", "moneyMulePaths", "contradictions"]
SCHEMA = (
    "corpus struct<name:string,version:string,seed:bigint,generatedAt:string,description:string>, investigation struct<name:string,status:string>, "
    "evidenceSources array<struct<key:string,sourceType:string,label:string>>, evidenceItems array<struct<ref:string,sourceKey:string,itemType:string,content:variant>>, "
    "locations array<struct<ref:string,sourceRef:string,label:string,locationType:string,latitude:double,longitude:double>>, "
    "communicationEvents array<struct<sourceRef:string,callerPhone:string,calleePhone:string,occurredAt:string,durationSeconds:int,cellLocationRef:string>>, "
    "financialTransactions array<struct<sourceRef:string,amount:double,currency:string,occurredAt:string>>"
)


class ManifestError(ValueError):
    """A manifest of the wrong shape, or with references that lead nowhere."""


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables evidence_sources, evidence_items, locations, communication_events and financial_transactions."""
    fields = set(spark.read.option("multiLine", True).json(path).columns)
    if not {"corpus", "evidenceItems"} <= fields:
        raise ManifestError("a manifest must have corpus and evidenceItems")
    if held := sorted(fields & set(ANSWER_KEYS)):
        raise ManifestError(f"a manifest must not hold an answer key: {', '.join(held)}")
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    rows = lambda name: doc.select(F.explode(name).alias("r")).select("r.*")
    sources = rows("evidenceSources").select(content_id("evidence_source", F.col("key")).alias("id"), "key", F.col("sourceType").alias("source_type"), "label")
    items = rows("evidenceItems")
    repeated = items.groupBy("ref").count().where("count > 1")
    astray = items.join(sources.select(F.col("key").alias("sourceKey")), "sourceKey", "left_anti")
    for wrong, what in ((repeated, "evidence items share a ref"), (astray, "evidence items name an unknown source")):
        if row := wrong.first():
            raise ManifestError(f"{what}: {row[0]}")
    items = items.join(sources.select(F.col("key").alias("sourceKey"), F.col("id").alias("source_id")), "sourceKey").select(content_id("evidence_item", F.col("ref")).alias("id"), "ref", "source_id", F.col("itemType").alias("item_type"), F.to_json("content").alias("content"))
    by_ref = items.select(F.col("ref").alias("sourceRef"), F.col("id").alias("evidence_item_id"))

    def cited(name: str) -> DataFrame:
        df = rows(name)
        if row := df.join(by_ref, "sourceRef", "left_anti").first():
            raise ManifestError(f"{name} cite an unknown item: {row['sourceRef']}")
        return df.join(by_ref, "sourceRef")

    locations = cited("locations").select(content_id("location", F.col("ref")).alias("id"), F.col("ref").alias("key"), "label", F.col("locationType").alias("location_type"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "evidence_item_id")
    calls = cited("communicationEvents").select(content_id("communication_event", F.col("sourceRef")).alias("id"), F.col("callerPhone").alias("caller"), F.col("calleePhone").alias("callee"), F.col("occurredAt").alias("at"), F.col("durationSeconds").alias("duration"), F.col("cellLocationRef").alias("location_key"), "evidence_item_id")
    payments = cited("financialTransactions").select(content_id("financial_transaction", F.col("sourceRef")).alias("id"), "amount", "currency", F.col("occurredAt").alias("at"), "evidence_item_id")
    return {"evidence_sources": sources, "evidence_items": items, "locations": locations, "communication_events": calls, "financial_transactions": payments}
