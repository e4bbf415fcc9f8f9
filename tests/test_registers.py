"""Public registers, read from saved payloads."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrand.plans import pairs
from lodestrand.sources import registers

LEI = "5493001KJTIIGC8Y1R12"


def _save(folder, name, payload):
    path = folder / name
    path.write_text(json.dumps(payload))
    return path.as_uri()


def test_source_list_and_gate(spark, tmp_path):
    path = tmp_path / "sources.csv"
    path.write_text('source_id,status,title,fields\nS1,APPROVED,"A ""quoted"", name"," name ; lei;;  "\nS2,REJECTED,"two\nlines",x\nS3,APPROVED_WITH_RESTRICTIONS,c,\n')
    rows = {r.source_id: r for r in registers.source_list(spark, path.as_uri()).collect()}
    assert rows["S1"].title == 'A "quoted", name' and rows["S1"].fields == ["name", "lei"] and rows["S2"].title == "two\nlines"
    df = registers.source_list(spark, path.as_uri())
    registers.require_approved(df, "S1")
    registers.require_approved(df, "S3")
    for bad in ("S2", "S9"):
        with pytest.raises(PermissionError):
            registers.require_approved(df, bad)


def test_gleif(spark, tmp_path):
    entity = lambda name, **more: {"legalName": {"name": name}, "jurisdiction": "IN", "status": "ACTIVE", **more}
    one = {"data": [
        {"attributes": {"lei": LEI, "ocid": "OC1", "entity": entity("Acme Ltd", otherNames=[{"name": "Acme"}, {"name": "Acme Ltd"}, {"name": " "}], transliteratedOtherNames=[{"name": "Akme"}], registeredAt={"id": "RA1"}, registeredAs="77")}},
        {"attributes": {"lei": "bad", "entity": entity("No")}}, {"attributes": {"lei": LEI, "entity": entity("Second")}},
    ]}
    rows = registers.gleif(spark, _save(tmp_path, "a.json", one)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.record_id, r.name, r.aliases, r.jurisdiction) == (LEI, "Acme Ltd", ["Acme", "Akme"], "IN")
    assert [(x.scheme, x.value) for x in r.identifiers] == [("LEI", LEI), ("OPENCORPORATES", "OC1"), ("NATIONAL_REGISTER:RA1", "77")]
    node = lambda i, t="LEI": {"id": i, "type": t}
    links = {"data": [{"attributes": {"relationship": {"startNode": node("A"), "endNode": node("B", kind), "type": " IS_Directly consolidated-by "}}} for kind in ("LEI", "NOID")]}
    found = registers.gleif_relations(spark, _save(tmp_path, "b.json", links)).collect()
    assert [(x.record_id, [(y.predicate, y.target) for y in x.relations]) for x in found] == [("A", [("is_directly_consolidated_by", "B")])]


def test_wikidata_and_edgar(spark, tmp_path):
    v = lambda **fields: {k: {"value": x} for k, x in fields.items()}
    bindings = [v(item="http://x/entity/Q42", itemLabel="Acme", lei=LEI, cik="000123"), v(item="http://x/entity/Q42", itemLabel="Acme", lei=LEI, shortName="AC", official="Acme Limited"), v(item="http://x/none", itemLabel="no")]
    r = registers.wikidata(spark, _save(tmp_path, "w.json", {"results": {"bindings": bindings}})).collect()
    assert len(r) == 1 and (r[0].record_id, r[0].name, r[0].official_name, r[0].aliases) == ("Q42", "Acme", "Acme Limited", ["AC", "Acme Limited"])
    assert [(x.scheme, x.value) for x in r[0].identifiers] == [("CIK", "123"), ("LEI", LEI)]
    filing = {"cik": "CIK 320193", "name": "Apple Co", "entityType": "operating", "stateOfIncorporation": "CA", "formerNames": [{"name": "Apple Computer"}, {"name": "Apple Co"}]}
    e = registers.edgar(spark, _save(tmp_path, "e.json", filing)).first()
    assert (e.record_id, e.aliases, e.jurisdiction, [(x.scheme, x.value) for x in e.identifiers]) == ("0000320193", ["Apple Computer"], "US-CA", [("CIK", "320193")])


def test_contract(spark):
    rows = [("R", "1", "Acme", "CC0", "R:1"), ("R", "2", "", None, "R:2"), ("R", "3", "x", "CC0", "R:4")]
    got = registers.violations(spark.createDataFrame(rows, "registry string, record_id string, name string, license string, record_ref string")).collect()
    assert [r.errors for r in got] == [[], ["no name", "no licence"], ["bad reference"]]


def test_leakage_and_contributions(spark):
    rows = [("p1", 1, "train", "a", "b"), ("p1", 0, "train", "c", "d"), ("p3", 0, "test", "a", "z"), ("p4", 1, "test", "z", "a"), ("p5", 0, "test", "q", "q")]
    df = spark.createDataFrame(rows, "pair_id string, label int, partition string, subject_a string, subject_b string")
    got = {r.check: r.violations for r in pairs.leakage(df).collect()}
    assert got == {"forbidden_fields": 0, "subjects_in_two_partitions": 1, "repeated_pair_ids": 1, "pairs_with_two_labels": 1, "subjects_paired_with_themselves": 1}
    assert {r.check: r.violations for r in pairs.leakage(df.withColumn("lei_a", F.lit("x"))).collect()}["forbidden_fields"] == 1
    model = {"kind": "logistic", "weights": [2.0, -1.0], "mean": [1.0, 0.0], "deviation": [0.5, 2.0], "intercept": 0.25}
    row = spark.createDataFrame([(2.0, 4.0)], "x double, y double").select(pairs.score(model, ["x", "y"]).alias("s"), pairs.contributions(model, ["x", "y"]).alias("c")).first()
    assert row.c == {"x": 4.0, "y": -2.0} and abs(row.s - 1 / (1 + 2.718281828459045 ** -(0.25 + 4 - 2))) < 1e-9
