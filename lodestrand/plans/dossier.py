"""The dossier: twelve sections in fixed order, each of few ranked rows that cite ids, and a digest of its content."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from lodestrand.operators.aggregates import CLASSES
from lodestrand.plans.engine import Engine
from lodestrand.plans.read_api import capped_ids

#: Rows of the ranked sections.
TOP = {"persons": 12, "relationships": 15, "money": 15, "calls": 15, "findings": 20, "ranking": 15}


def assemble(engine: Engine) -> dict:
    """Sections with their rows, a census of classes with zeros, and the version that follows from the content."""
    s = engine.store
    rel, found, sig = s.read("relationships"), s.read("corroboration_findings"), s.read("analytical_signals")
    cited = rel.select("id", "type", "src", "dst", "event_count", "total_amount", "classification", capped_ids(F.col("evidence_ids")).alias("evidence_ids"))
    rows = lambda df, order, n: [r.asDict(True) for r in df.orderBy(*order).limit(n).collect()]
    decisions = s.read("resolution_decisions")
    sections = {
        "case": [{"graph_version": s.get("graph:version")}],
        "sources": [r.asDict() for r in s.read("evidence_items").groupBy("source_id").agg(F.count("*").alias("items")).orderBy("source_id").collect()],
        "persons": rows(s.read("entities").where("kind = 'person'").select("id", "label", F.size("mentions").alias("mentions")), [F.desc("mentions"), "id"], TOP["persons"]),
        "identity": rows(decisions.groupBy("type", "status").agg(F.count("*").alias("n"), F.min("confidence").alias("least_confidence")), ["type", "status"], 50),
        "relationships": rows(cited.where("type = 'ownership'"), [F.desc(F.size("evidence_ids")), "id"], TOP["relationships"]),
        "calls": rows(cited.where("type = 'communication'"), [F.desc("event_count"), "id"], TOP["calls"]),
        "money": rows(cited.where("type = 'financial'"), [F.desc("total_amount"), "id"], TOP["money"]),
        "structure": rows(sig.where("signal_type = 'ranking'").select("entity_id", "value", F.split_part("value", F.lit(":"), F.lit(1)).cast("int").alias("rank")), ["rank"], TOP["ranking"]),
        "bridges": rows(sig.where("signal_type = 'bridge'").select("entity_id", F.col("value").cast("int").alias("pieces")), [F.desc("pieces"), "entity_id"], 50),
        "space_time": rows(found.where("kind <> 'spatiotemporal' or finding_type = 'repeated_overlap'").select("id", "finding_type", "entity_ids", "location_ids", "classification", "value"), ["classification", "finding_type", "id"], TOP["findings"]),
        "contradictions": rows(found.where("finding_type = 'spatiotemporal_contradiction'").select("id", "entity_ids", "location_ids", "value"), ["id"], TOP["findings"]),
        "limits": [{"unresolved_mentions": decisions.where("status = 'unresolved'").count(), "ambiguous_mentions": decisions.where("status = 'ambiguous'").count()}],
    }
    counts = {r["classification"]: r["count"] for r in rel.select("classification").unionByName(found.select("classification")).groupBy("classification").count().collect()}
    body = {"sections": sections, "census": {c: counts.get(c, 0) for c in CLASSES}}
    digest = hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()
    return body | {"version": f"dossier.v1.{digest[:12]}", "digest": digest, "graph_version": s.get("graph:version")}


def markdown(dossier: dict) -> str:
    """A plain rendering: a heading for each section, a line for each row."""
    out = [f"# {dossier['version']}"]
    for name, rows in dossier["sections"].items():
        out.append(f"\n## {name.replace('_', ' ')}")
        out += ["- " + ", ".join(f"{k}: {v}" for k, v in r.items()) for r in rows] or ["- checked, none found"]
    return "\n".join(out) + "\n"
