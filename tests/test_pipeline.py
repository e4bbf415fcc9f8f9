import json

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import corroborate, extract, graph, resolve
from lodestrand.plans import dossier, evaluate, read_api
from lodestrand.plans.engine import Engine
from lodestrand.sources import manifest, synthetic


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    synthetic.write(f"{root}/m.json")
    e = Engine(spark, str(root / "tables"))
    e.path = f"{root}/m.json"
    e.reports = list(e.run(e.path))
    return e


def test_all_stages_run_and_hold(engine):
    assert [r["stage"] for r in engine.reports] == ["ingest", "extract", "resolve", "synthesize", "analyse", "corroborate"]
    assert set(engine.verify().values()) == {0}
    people = {r.label: r for r in engine.store.read("entities").where("kind = 'person'").collect()}
    assert len(people["P. A-Zero"].mentions if "P. A-Zero" in people else people["Person A0"].mentions) >= 2
    assert engine.store.read("relationships").where("type = 'communication' and classification = 'ai_inference'").count() > 0


def test_rerun_adds_nothing(engine):
    before = engine.store.get("graph:version")
    again = [t["created"] for r in (engine.extract(), engine.resolve(), engine.synthesize()) for t in r["tables"].values()]
    assert set(again) == {0} and engine.store.get("graph:version") == before


def test_signals_that_a_graph_is_too_large_for_are_skipped(engine, monkeypatch):
    monkeypatch.setattr(graph, "PATH_VERTICES", 1)
    monkeypatch.setattr(graph, "COMPONENT_EDGES", 1)
    report = engine.analyse()
    assert set(report["skipped"]) == {"betweenness", "bridge", "community"} and "1 vertices" in report["skipped"]["betweenness"]


def test_dossier_is_stable_and_cites(engine):
    a, b = dossier.assemble(engine), dossier.assemble(engine)
    assert a["digest"] == b["digest"] and len(a["sections"]) == 12 and a["version"].startswith("dossier.v1.")
    assert all(r["evidence_ids"] for r in a["sections"]["money"]) and "## money" in dossier.markdown(a)


def test_read_views(engine):
    f = engine.store.read("corroboration_findings")
    got = read_api.findings(f, classification="corroborated_fact", limit=1000).collect()
    assert 0 < len(got) <= read_api.MOST_FINDINGS and all(r.classification == "corroborated_fact" for r in got)
    assert read_api.entities(engine.store.read("entities"), limit=3).first().kind == "person"
    hits = read_api.search(engine.store.read("entities"), engine.store.read("aliases"), "ALIAS 3").collect()
    assert [h.label for h in hits] == ["Person D3"]
    v, e = engine.graph()
    top, inside, truncated = read_api.snapshot(v, e, 5)
    assert top.count() == 5 and inside.count() <= e.count()


def test_manifest_gates(spark, tmp_path):
    good = synthetic.corpus(calls=1, payments=1)
    for change in ({"keyActors": []}, {"evidenceItems": [*good["evidenceItems"], good["evidenceItems"][0]]}, {"locations": [{**good["locations"][0], "sourceRef": "nowhere"}]}):
        (tmp_path / "bad.json").write_text(json.dumps(good | change))
        with pytest.raises(manifest.ManifestError):
            manifest.load(spark, str(tmp_path / "bad.json"))


def _items(spark, *rows):
    return spark.createDataFrame([(f"i{k}", t, json.dumps(c)) for k, (t, c) in enumerate(rows)], "id string, item_type string, content string")


def test_extractors_take_what_is_there(spark):
    items = _items(spark, ("fir", {"accused": ["A", 7, ""], "firNumber": "", "seizedVehicle": {"plate": "P1", "colour": "red"}}), ("cdr_event", {"callerNumber": "1", "calleeNumber": "2"}), ("public_record", {"registry": "R", "registryRecordId": "1", "name": "N", "subjectKind": "organisation", "license": "CC0", "sourceUrl": "u", "identifiers": [{"scheme": "LEI", "value": "X"}], "status": ""}), ("public_record", {"name": "no licence"}))
    got = {(r.evidence_item_id, r.field_path): r for r in extract.extract(items).collect()}
    assert set(got) == {("i0", "accused[0]"), ("i0", "seizedVehicle.plate"), ("i0", "seizedVehicle.colour"), ("i2", "name"), ("i2", "identifiers[0]"), *(("i2", f) for f in ("registry", "registryRecordId", "license", "sourceUrl"))}
    assert got["i0", "seizedVehicle.colour"].subject == "P1" and got["i2", "identifiers[0]"].observed == "LEI:X"
    with pytest.raises(Exception, match="no extractor"):
        extract.extract(_items(spark, ("nonsense", {}))).collect()


def test_resolution_never_forces(spark):
    org = lambda ref, name, *leis: ("public_record", {"registry": "R", "registryRecordId": ref, "name": name, "subjectKind": "organisation", "license": "L", "sourceUrl": "u", "identifiers": [{"scheme": "LEI", "value": v} for v in leis]})
    items = _items(spark, org("1", "Acme Ltd", "X1"), org("2", "Acme Limited", "X1"), org("3", "Twin Co", "X2"), org("4", "Twin Co", "X3"), org("5", "Twin Co"), org("6", "ACME"), org("7", "Acme Ltd"), org("8", "Torn", "X4", "X5"), org("9", "Alone"))
    facts = graph.cut(extract.extract(items))
    out = resolve.resolve(facts)
    named = {r.mention: r for r in out["decisions"].collect()}
    by_item = {r.evidence_item_id: named[r.id] for r in facts.where("record_type = 'entity_mention'").collect()}
    kinds = {k: v.type for k, v in by_item.items()}
    assert by_item["i0"].entity_id == by_item["i1"].entity_id and kinds["i0"] == "shared_identifier_merge"
    assert by_item["i2"].entity_id != by_item["i3"].entity_id and kinds["i2"] == "new_entity"
    assert (kinds["i4"], by_item["i4"].candidates) == ("ambiguous_name_conflict", 2)
    assert kinds["i5"] == "normalized_name_match" and by_item["i5"].entity_id == by_item["i0"].entity_id
    assert kinds["i6"] == "exact_name_match" and kinds["i7"] == "ambiguous_identifier_conflict" and kinds["i8"] == "unlinked_mention"


def test_windows_are_inclusive_and_classes_follow_counts(spark):
    rows = [("a", "l", 0, "e1", "r1"), ("b", "l", 1800_000, "e2", "r2"), ("c", "l", 1800_001 + 1800_000, "e3", "r3"), ("a", "l", 9_000_000, "e4", "r4"), ("b", "l", 9_000_400, "e4", "r5")]
    ev = spark.createDataFrame(rows, "subject string, location string, ms long, evidence_id string, record_id string").withColumn("at", F.timestamp_millis("ms")).drop("ms")
    got = {(r.subject_a, r.subject_b): r for r in corroborate.temporal_overlaps(ev.drop("location")).collect()}
    assert set(got) == {("a", "b")} and got["a", "b"].pair_count == 2 and got["a", "b"].min_gap_seconds == 0 and got["a", "b"].classification == "corroborated_fact"
    rep = corroborate.repeated_overlaps(ev).collect()
    assert [(r.subject_a, r.subject_b, r.occurrences, r.evidence_count) for r in rep] == [("a", "b", 2, 3)]


def test_metrics(spark):
    a = spark.createDataFrame([("m1", "x", "1"), ("m2", "x", "1"), ("m3", "x", "2"), ("m4", "y", "3")], "mention string, truth string, system string")
    got = {m["metric"]: m["value"] for m in evaluate.clusters(a)}
    assert got == {"pairwise precision": 1.0, "pairwise recall": pytest.approx(1 / 3), "exact clusters": 0.5}
    none = evaluate.must_not_merge(a, spark.createDataFrame([], "a string, b string"))
    assert none["value"] is None and "n/a" in evaluate.report([none])
    aligned = evaluate.align(spark.createDataFrame([("m", "rec:12:3", "N")], "mention string, ref string, name string"), spark.createDataFrame([("rec:1", "N", "no"), ("rec:12", "Z", "a"), ("rec:12", "N", "b")], "ref string, name string, entity_key string"))
    assert aligned.first().entity_key == "b"


def test_answers_cite_and_never_choose(engine):
    from lodestrand.plans import answers

    for question, intent in (("Is there a money trail from Person A0 to Person B1?", "financial_path"), ("Who are the suspects?", "suspects_overview"), ("Which places contradict each other?", "contradictions"), ("Tell me about Person C2", "entity_profile"), ("Who has the key structural role?", "structural_significance")):
        got = answers.ask(engine, question)
        assert got["intent"] == intent and answers.astray(engine, got["claims"]) == []
        assert got["status"] == ("answered" if got["claims"] else "no_evidence") and (got["claims"] or got["warnings"])
        assert all(f"[{c['id']}]" in got["text"] for c in got["claims"])
    assert answers.ask(engine, "What of person?")["status"] == "ambiguous"
    assert len(answers.suggestions(engine)) == 2
    said = engine.spark.createDataFrame([("a", "He definitely paid on 2025-01-02 to entity_0123456789abcdef", "paid on 2025-01-02"), ("b", "fine", "")], "id string, text string, support string")
    found = {r.id: r for r in answers.violations(said).collect()}
    assert found["a"].banned == ["definitely"] and found["a"].unsupported == ["entity_0123456789abcdef"] and not found["b"].banned


def test_corpus_checks(engine, spark):
    from lodestrand.sources.validate import validate

    rows = validate(manifest.load(spark, engine.path)).collect()
    assert len(rows) == 16 and all(r.ok for r in rows)


def test_unknown_people_are_not_answered_as_known_ones(spark):
    from lodestrand.plans.ask import ground

    known = [("p1", "Rahul Sharma"), ("p2", "Anil Sharma"), ("p3", "Maria del Carmen Lopez de la Cruz"), ("p4", "Karol Bagh Warehouse"), ("p5", "SYN-AC-000017"), ("p6", "Vikram Rao")]
    labels = spark.createDataFrame(known, "id string, label string")
    asked = [
        ("a", "What about Priya Sharma?"), ("b", "What about Rahul Sharma?"), ("c", "who is Maria del Carmen Lopez de la Cruz"), ("d", "Is Sharma there?"), ("e", "what happened at Karol Bagh"),
        ("f", "How is SYN-AC-000099 linked to SYN-AC-000017"), ("g", "tell me of 'the grey man' and Mr Vikram Rao"), ("h", "nothing known"), ("i", None), ("j", ""),
    ]
    got = {r.id: r for r in ground(spark.createDataFrame(asked, "id string, question string"), labels).collect()}
    assert got["a"].mentions == [] and got["a"].unknown == ["Priya Sharma"] and not got["a"].ambiguous and got["a"].intent == "open_question"
    assert got["b"].mentions == ["p1"] and got["b"].unknown == [] and got["c"].mentions == ["p3"]
    assert got["d"].mentions == [] and got["d"].ambiguous and got["e"].unknown == []
    assert got["f"].unknown == ["SYN-AC-000099"] and got["f"].mentions == ["p5"]
    assert got["g"].unknown == ["'the grey man'"] and got["g"].mentions == ["p6"]
    assert len(got) == 10 and got["i"].mentions == []


def test_each_field_of_content_is_read_once(spark):
    items = spark.createDataFrame([("i", "financial_transaction_record", '{"txnRef":"t","fromAccount":"a","toAccount":"b","valueDate":"d","amount":1}')], "id string, item_type string, content string")
    facts = extract.extract(items)
    assert [(r.from_account, r.to_account, r.amount) for r in facts.collect()] == [("a", "b", 1.0)]
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    # txnRef, fromAccount, toAccount, valueDate, currency and amount
    assert plan.count("schemaOfVariant") == 6
