"""The stages in order: ingest, extract, resolve, synthesize, analyse, corroborate. Each appends what is absent and marks
itself done; running again on unchanged input adds nothing."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.ids import content_id
from lodestrand.operators import corroborate, extract, graph, resolve, synthesize
from lodestrand.sources import manifest
from lodestrand.sources.tables import Store


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def _save(self, stage: str, tables: dict[str, DataFrame]) -> dict:
        counts = {name: self.store.append_if_absent(name, df) for name, df in tables.items()}
        self.store.put(f"{stage}:done", json.dumps(counts, sort_keys=True))
        return {"stage": stage, "tables": counts}

    def run(self, path: str) -> Iterator[dict]:
        """Yields a report of each stage as it ends."""
        yield self.ingest(path)
        for stage in (self.extract, self.resolve, self.synthesize, self.analyse, self.corroborate):
            yield stage()

    def ingest(self, path: str) -> dict:
        return self._save("ingest", manifest.load(self.spark, path))

    def extract(self) -> dict:
        return self._save("extract", {"extracted_records": extract.extract(self.store.read("evidence_items"))})

    def resolve(self) -> dict:
        found = resolve.resolve(self.store.read("extracted_records"))
        decisions = found["decisions"].withColumn("id", content_id("resolution_decision", F.col("mention")))
        return self._save("resolve", {"entities": found["entities"], "resolution_decisions": decisions, "aliases": found["aliases"]})

    def _resolved(self) -> dict[str, DataFrame]:
        return {"entities": self.store.read("entities"), "decisions": self.store.read("resolution_decisions"), "aliases": self.store.read("aliases")}

    def synthesize(self) -> dict:
        edges = synthesize.synthesize(self.store.read("extracted_records"), self._resolved(), self.store.read("locations"))
        report = self._save("synthesize", {"relationships": edges})
        self.store.put("graph:version", synthesize.graph_version(self.store.read("relationships")))
        return report

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Vertices (id, kind, label) and edges (src, dst, type, weight, classification)."""
        v = self.store.read("entities").select("id", "kind", "label").unionByName(self.store.read("locations").select("id", F.lit("location").alias("kind"), "label"))
        e = self.store.read("relationships").select("src", "dst", "type", F.col("event_count").alias("weight"), "classification")
        return v, graph.induced(e, v)

    def analyse(self) -> dict:
        """Signals: centralities, bridges, communities and the ranking, keyed by graph version.

        A signal that a graph is too large for is skipped and named in the report; the ranking counts it as nothing.
        """
        v, e = self.graph()
        version, skipped = self.store.get("graph:version"), {}
        kind = v.schema["id"].dataType.simpleString()

        def unless_too_large(name: str, find, columns: str) -> DataFrame:
            try:
                return find(v, e)
            except ValueError as why:
                skipped[name] = str(why)
                return self.spark.createDataFrame([], f"id {kind}, {columns}")

        b = unless_too_large("betweenness", graph.betweenness, "betweenness double")
        cut = unless_too_large("bridge", graph.articulation_points, f"component {kind}, pieces int, sizes array<int>")
        groups = unless_too_large("community", graph.communities, f"community {kind}")
        d = graph.degree_centrality(v, e)
        ranked = graph.ranking(d.join(b, "id", "left").join(cut.select("id", "pieces"), "id", "left").fillna({"pieces": 0, "betweenness": 0.0}))
        signal = lambda df, kind, value: df.select(F.lit(kind).alias("signal_type"), F.col("id").alias("entity_id"), value.cast("string").alias("value"))
        rows = signal(b, "betweenness", F.col("betweenness")).unionByName(signal(d, "degree", F.col("centrality"))).unionByName(signal(cut, "bridge", F.col("pieces"))).unionByName(signal(groups, "community", F.col("community"))).unionByName(signal(ranked, "ranking", F.concat_ws(":", "rank", "score")))
        rows = rows.withColumn("graph_version", F.lit(version)).withColumn("id", content_id("analytical_signal", F.col("signal_type"), F.col("entity_id"), F.col("graph_version")))
        return self._save("analyse", {"analytical_signals": rows}) | ({"skipped": skipped} if skipped else {})

    def corroborate(self) -> dict:
        """Findings in space and time, keyed by graph version."""
        facts, places = self.store.read("extracted_records"), self.store.read("locations")
        acts = graph.cut(synthesize.activity(facts, self._resolved(), self.store.read("relationships"), places))
        version = self.store.get("graph:version")
        near = corroborate.proximities(places, acts.where("location is not null").select(F.col("location").alias("id")))
        empty = F.array().cast("array<string>")
        rows = [
            corroborate.co_locations(acts).select(F.lit("spatial_co_location").alias("finding_type"), F.lit("spatial").alias("kind"), F.array("subject_a", "subject_b").alias("entity_ids"), F.array("location").alias("location_ids"), "classification", F.to_json(F.struct("count_a", "count_b", "evidence_count", "span_seconds")).alias("value")),
            near.select(F.lit("spatial_proximity"), F.lit("spatial"), empty, F.array("a", "b"), F.lit("algorithmic_signal"), F.to_json(F.struct("metres"))),
            corroborate.temporal_overlaps(acts).select(F.lit("temporal_co_occurrence"), F.lit("temporal"), F.array("subject_a", "subject_b"), empty, "classification", F.to_json(F.struct("pair_count", "distinct_days", "min_gap_seconds"))),
            corroborate.repeated_overlaps(acts).select(F.lit("repeated_overlap"), F.lit("spatiotemporal"), F.array("subject_a", "subject_b"), F.array("location"), "classification", F.to_json(F.struct("occurrences"))),
            corroborate.travel_contradictions(acts, places).select(F.lit("spatiotemporal_contradiction"), F.lit("spatiotemporal"), F.array("subject"), F.array("location_a", "location_b"), F.lit("algorithmic_signal"), F.to_json(F.struct("metres", "seconds", "speed_mps"))),
        ]
        every = rows[0]
        for r in rows[1:]:
            every = every.union(r)
        every = every.withColumn("graph_version", F.lit(version)).withColumn("id", content_id("corroboration_finding", F.col("finding_type"), F.array_join("entity_ids", ","), F.array_join("location_ids", ","), F.col("graph_version")))
        return self._save("corroborate", {"corroboration_findings": every})

    def verify(self) -> dict[str, int]:
        """Violations of integrity, each of which should be 0."""
        from lodestrand.operators.joins import missing

        rel, ent, rec = self.store.read("relationships"), self.store.read("entities"), self.store.read("extracted_records")
        known = ent.select("id").unionByName(self.store.read("locations").select("id"))
        found = self.store.read("corroboration_findings")
        return {
            "edges_without_source": missing(rel, "src", known, "id").count(), "edges_without_target": missing(rel, "dst", known, "id").count(),
            "records_without_item": missing(rec, "evidence_item_id", self.store.read("evidence_items"), "id").count(),
            "corroborated_by_one_item": rel.where("classification = 'corroborated_fact' and size(evidence_ids) < 2").count(),
            "contradictions_of_many": found.where("finding_type = 'spatiotemporal_contradiction' and size(entity_ids) <> 1").count(),
            "stale_findings": found.where(F.col("graph_version") != self.store.get("graph:version")).count(),
        }
