"""Answers: claims that cite rows of the pipeline's tables, the checks that keep them honest, and plain narration.

Each intent is one plan over the tables; only its few ranked rows reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.variation import banned_phrases, unsupported
from lodestrand.operators import graph
from lodestrand.plans.ask import ground
from lodestrand.plans.engine import Engine

#: Strength of classes; claims of one answer.
STRENGTH = {"observed_fact": 4, "corroborated_fact": 5, "algorithmic_signal": 3, "ai_inference": 2, "investigative_lead": 1}
MOST = 12


def money_chain(edges: DataFrame, entities: DataFrame, a: str, b: str) -> list[str] | None:
    """Accounts on a shortest path of payments between two owners; None if there is none."""
    path = graph.shortest_path(edges, a, b, ["financial", "ownership"])
    if path is None:
        return None
    kinds = {r["id"]: r["kind"] for r in entities.where(F.col("id").isin(path)).select("id", "kind").collect()}
    return [x for x in path if kinds.get(x) == "bank_account"]


def _claims(rows: DataFrame, text, refs) -> list[dict]:
    got = rows.select(text.alias("text"), "classification", refs.alias("refs")).limit(MOST).collect()
    return [{"text": r["text"], "classification": r["classification"], "refs": sorted(r["refs"])} for r in got]


def _label(engine: Engine, df: DataFrame, column: str) -> DataFrame:
    v = engine.graph()[0].select(F.col("id").alias(column), F.col("label").alias(f"{column}_label"))
    return df.join(v, column, "left").withColumn(f"{column}_label", F.coalesce(f"{column}_label", column))


def retrieve(engine: Engine, intent: str, mentions: list[str]) -> tuple[list[dict], list[str]]:
    """Claims of an intent about the mentioned entities, and warnings. An absence is said to be checked, not passed over."""
    s = engine.store
    rel, found, sig = s.read("relationships"), s.read("corroboration_findings"), s.read("analytical_signals").where(F.col("graph_version") == s.get("graph:version"))
    edges = rel.select("src", "dst", "type")
    about = lambda c: F.arrays_overlap(c, F.array(*map(F.lit, mentions))) if mentions else F.lit(True)
    line = lambda df: _label(engine, _label(engine, df, "src"), "dst").orderBy(F.desc("event_count"), "id")
    edge_text = F.concat_ws(" ", "src_label", F.lit("-"), "type", F.lit("-"), "dst_label", F.concat(F.lit("("), F.col("event_count").cast("string"), F.lit(" records)")))
    if intent == "contradictions":
        claims = _claims(found.where("finding_type = 'spatiotemporal_contradiction'").where(about(F.col("entity_ids"))).orderBy("id"), F.concat(F.lit("inconsistent places: "), "value"), F.array("id"))
    elif intent in ("financial_path", "relationship_between") and len(mentions) >= 2:
        path = money_chain(edges, s.read("entities"), *mentions[:2]) if intent == "financial_path" else graph.shortest_path(edges, *mentions[:2])
        claims = [{"text": ("accounts in order: " if intent == "financial_path" else "connected through: ") + " > ".join(path), "classification": "algorithmic_signal", "refs": path}] if path else []
    elif intent == "colocation_at_event":
        claims = _claims(found.where("finding_type in ('spatial_co_location', 'repeated_overlap')").where(about(F.col("entity_ids"))).orderBy("classification", "id"), F.concat_ws(" ", "finding_type", "value"), F.array("id"))
    elif intent in ("structural_significance", "intermediary_links"):
        top = _label(engine, sig.where("signal_type = 'ranking'").withColumn("rank", F.split_part("value", F.lit(":"), F.lit(1)).cast("int")), "entity_id").orderBy("rank")
        claims = _claims(top.withColumn("classification", F.lit("algorithmic_signal")), F.concat_ws(" ", F.lit("rank"), F.col("rank").cast("string"), "entity_id_label"), F.array("id"))
    elif intent == "suspects_overview":
        people = s.read("entities").where("kind = 'person'").orderBy(F.desc(F.size("mentions")), "id")
        claims = _claims(people.withColumn("classification", F.lit("observed_fact")), F.concat_ws(" ", "label", F.concat(F.lit("("), F.size("mentions").cast("string"), F.lit(" mentions)"))), F.array("id"))
    elif intent == "case_summary":
        n = found.groupBy("finding_type", "classification").agg(F.count("*").alias("n"), F.array_sort(F.slice(F.collect_set("id"), 1, 3)).alias("ids")).orderBy("finding_type", "classification")
        claims = _claims(n, F.concat_ws(" ", F.col("n").cast("string"), "finding_type", "classification"), F.col("ids"))
    else:
        own = rel.where(F.col("src").isin(mentions) | F.col("dst").isin(mentions)) if mentions else rel
        claims = _claims(line(own), edge_text, F.array("id"))
    return claims, [] if claims else [f"checked for {intent}, none found"]


def ask(engine: Engine, question: str) -> dict:
    """A grounded answer. An ambiguous name is answered by its candidates, not by a choice."""
    labels = engine.store.read("entities").select("id", "label").unionByName(engine.store.read("aliases").select(F.col("entity_id").alias("id"), F.col("alias").alias("label")))
    g = ground(engine.spark.createDataFrame([("q", question)], "id string, question string"), labels).first()
    if g["ambiguous"] and not g["mentions"]:
        return {"status": "ambiguous", "intent": g["intent"], "claims": [], "warnings": ["a name in the question fits more than one entity"]}
    claims, warnings = retrieve(engine, g["intent"], list(g["mentions"]))
    claims = [{"id": f"C{k + 1}", **c} for k, c in enumerate(claims)]
    weakest = min((c["classification"] for c in claims), key=STRENGTH.__getitem__, default=None)
    return {"status": "answered" if claims else "no_evidence", "intent": g["intent"], "mentions": list(g["mentions"]), "claims": claims, "classification": weakest, "warnings": warnings, "text": narrate(claims)}


def narrate(claims: list[dict]) -> str:
    """Claims by strength, each with its handle."""
    order = sorted(claims, key=lambda c: (-STRENGTH[c["classification"]], c["id"]))
    return "\n".join(f"[{c['id']}] {c['text']} ({c['classification'].replace('_', ' ')})" for c in order)


def astray(engine: Engine, claims: list[dict]) -> list[str]:
    """Cited ids that no table holds."""
    cited = sorted({r for c in claims for r in c["refs"]})
    if not cited:
        return []
    refs = engine.spark.createDataFrame([(r,) for r in cited], "id string")
    for name in ("entities", "locations", "relationships", "corroboration_findings", "analytical_signals"):
        refs = refs.join(engine.store.read(name).select("id"), "id", "left_anti")
    return sorted(r["id"] for r in refs.collect())


def violations(answers: DataFrame) -> DataFrame:
    """(id, banned, unsupported) of (id, text, support): what a written answer says beyond its evidence."""
    return answers.select("id", banned_phrases(F.col("text")).alias("banned"), unsupported(F.col("text"), F.col("support")).alias("unsupported"))


def suggestions(engine: Engine) -> list[str]:
    """Questions that the data can answer: the strongest bridge, the richest payer."""
    sig = _label(engine, engine.store.read("analytical_signals").where("signal_type = 'ranking'").withColumn("rank", F.split_part("value", F.lit(":"), F.lit(1)).cast("int")), "entity_id").orderBy("rank").first()
    pay = _label(engine, _label(engine, engine.store.read("relationships").where("type = 'financial' and classification = 'ai_inference'"), "src"), "dst").orderBy(F.desc("total_amount"), "id").first()
    out = [f"How is {sig['entity_id_label']} connected?"] if sig else []
    return out + ([f"Is there a money trail between {pay['src_label']} and {pay['dst_label']}?"] if pay else [])
