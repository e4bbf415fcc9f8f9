import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import aggregates, graph, joins
from lodestrand.plans import ask, legal_forms, pairs
from lodestrand.sources.tables import Store


def _graph(spark, edges, extra=()):
    ids = sorted({x for e in edges for x in e} | set(extra))
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(a, b, "t", 1.0) for a, b in edges], "src string, dst string, type string, weight double")


BARBELL = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")]


def test_barbell(spark):
    v, e = _graph(spark, BARBELL, ["z"])
    cut = {r.id: (r.pieces, list(r.sizes)) for r in graph.articulation_points(v, e).collect()}
    assert cut == {"c": (2, [3, 2]), "d": (2, [3, 2])}
    groups = {r.id: r.community for r in graph.communities(v, e).collect()}
    assert groups == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d", "z": "z"}
    assert graph.modularity(e, graph.communities(v, e)) > graph.modularity(e, v.select("id", F.lit("a").alias("community")))
    assert graph.shortest_path(e, "a", "f") == ["a", "c", "d", "f"] and graph.shortest_path(e, "a", "z") is None and graph.shortest_path(e, "a", "a") == ["a"]
    degree = {r.id: (r.degree, r.in_degree, r.by_type) for r in graph.degrees(v, e).collect()}
    assert degree["c"] == (3, 1, {"t": 3}) and degree["z"] == (0, 0, None)
    assert graph.neighbourhood(e, "d").count() == 4


def test_betweenness_equals_brute_force(spark):
    r = random.Random(3)
    nodes = [f"n{k}" for k in range(12)]
    edges = sorted({(a, b) for a, b in ((r.choice(nodes), r.choice(nodes)) for _ in range(30)) if a != b})
    v, e = _graph(spark, edges, nodes)
    near = {n: [b for a, b in edges if a == n] for n in nodes}

    def paths(s):
        level, found = {s: [[s]]}, {s: [[s]]}
        while level:
            fresh = {}
            for v_, ps in level.items():
                for w in near[v_]:
                    if w not in found:
                        fresh.setdefault(w, []).extend(p + [w] for p in ps)
            found.update(fresh)
            level = fresh
        return found

    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t, ps in paths(s).items():
            for p in ps:
                for x in p[1:-1]:
                    want[x] += 1 / len(ps)
    got = {x.id: x.betweenness for x in graph.betweenness(v, e).collect()}
    assert got == pytest.approx({k: x / (11 * 10) for k, x in want.items()}, abs=1e-6)


def test_no_result_depends_on_partitions(spark):
    v, e = _graph(spark, BARBELL)
    for op in (graph.connected_components, graph.communities, graph.articulation_points, graph.betweenness):
        assert sorted(map(str, op(v.repartition(5), e.repartition(7)).collect())) == sorted(map(str, op(v.coalesce(1), e.coalesce(1)).collect()))


def test_range_join_meets_each_pair_once(spark):
    r = random.Random(1)
    a = spark.createDataFrame([(k, r.randrange(500) - 250) for k in range(80)], "i long, x long")
    b = a.select(F.col("i").alias("j"), F.col("x").alias("y"))
    got = joins.range_join(a, b, "x", "y", 10, residual=F.col("i") < F.col("j"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((p.i, p.j) for p in got.collect()) == sorted((p.i, p.j) for p in a.crossJoin(b).where("abs(x - y) <= 10 and i < j").collect())


def test_near_join_equals_all_pairs(spark):
    r = random.Random(2)
    rows = [(k, r.uniform(-0.05, 0.05) + lat, ((r.uniform(-0.05, 0.05) + lon + 180) % 360) - 180) for k, (lat, lon) in enumerate([(60.0, 10.0), (0.0, 179.99), (-33.0, 0.0)] * 40)] + [(900, 60.0, 10.0), (901, 60.0, 10.0)]
    p = spark.createDataFrame(rows, "id long, lat double, lon double")
    from lodestrand.functions.numbers import haversine_m

    q = p.select(F.col("id").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    want = p.crossJoin(q).where("id < b").withColumn("m", haversine_m(F.col("lat"), F.col("lon"), F.col("lb"), F.col("ob"))).where("m > 0 and m <= 2000")
    assert sorted((x.a, x.b) for x in joins.near_join(p, 2000).collect()) == sorted((x.id, x.b) for x in want.collect())


def test_metrics_of_no_class_and_ties(spark):
    one = spark.createDataFrame([(1, 0.5)], "label int, score double")
    assert np.isnan(aggregates.roc_auc(one).first()[0]) and aggregates.pr_auc(one).first()[0] == 1.0
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert aggregates.roc_auc(tied).first()[0] == 0.875
    best = aggregates.threshold_selection(tied, 0.0).first()
    assert (best.threshold, best.feasible) == (0.9, True)


def test_store_appends_once_and_remembers(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "id string, n int")
    assert s.append_if_absent("t", rows) == {"created": 2, "skipped": 0}
    assert s.append_if_absent("t", rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema))) == {"created": 1, "skipped": 2}
    assert s.get("k") is None
    s.put("k", "1")
    s.put("k", "2")
    assert s.get("k") == "2"


def test_pair_models(spark):
    r = random.Random(5)
    base = [f"{a} {b} {c}" for a in ("alpha", "beta", "gamma") for b in ("trading", "steel", "foods") for c in ("ltd", "inc")]
    rows = [(a, a.upper().replace("LTD", "Limited"), 1) for a in base] + [(a, r.choice([b for b in base if b.split()[:2] != a.split()[:2]]), 0) for a in base]
    record = "struct<name:string,official_name:string,aliases:array<string>,jurisdiction:string>"
    df = spark.createDataFrame([((a, None, [], "IN"), (b, None, None, "in-mh"), y) for a, b, y in rows], f"a {record}, b {record}, label int")
    labelled = pairs.features(df.select("a", "b")).join(df.select("a", "b", "label"), ["a", "b"])
    swapped = pairs.features(df.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(*pairs.FEATURES).collect()
    straight = pairs.features(df.select("a", "b")).select(*pairs.FEATURES).collect()
    assert sorted(swapped) == sorted(straight) and all(0 <= v <= 1 for row in straight for v in row)
    x, y = pairs.matrix(labelled)
    for model in (pairs.fit_logistic(x, y, epochs=300), pairs.fit_trees(x, y, rounds=20, least=3)):
        scored = labelled.select("label", pairs.score(model).alias("score"))
        assert aggregates.roc_auc(scored).first()[0] == 1.0
        assert pairs.digest(model) == pairs.digest(dict(reversed(model.items())))
    found, large = pairs.candidates(spark.createDataFrame([("1", "Acme Ltd"), ("2", "ACME Limited"), ("3", "Other")], "ref string, name string"))
    assert [(c.ref_a, c.ref_b) for c in found.collect()] == [("1", "2")] and large.isEmpty()


def test_questions(spark):
    labels = spark.createDataFrame([("Ravi Kumar", "p1"), ("Ravi Shah", "p2"), ("+99000123", "h1")], "label string, id string")
    asked = spark.createDataFrame([(1, "Is there a money trail from Ravi Kumar?"), (2, "who is ravi"), (3, "What about 99000123?"), (4, "hello")], "id long, question string")
    got = {r.id: r for r in ask.ground(asked, labels).collect()}
    assert (got[1].intent, got[1].mentions) == ("financial_path", ["p1"]) and (got[2].mentions, got[2].ambiguous) == ([], True)
    assert (got[3].intent, got[3].mentions) == ("entity_profile", ["h1"]) and got[4].intent == "open_question"


def test_mined_forms_are_vetoed(spark):
    named = spark.createDataFrame([("de", k, f"firm{k} gmbh") for k in range(8)] + [("de", 20, "x ag"), ("de", 21, "x")], "place string, entity long, name string")
    assert {r.gram for r in legal_forms.mined_forms(named, ["ag"]).collect()} == {"gmbh"}


def test_streams(spark, tmp_path):
    from lodestrand.streaming import activity

    rows = spark.createDataFrame([("a", "l", "2025-01-01 00:00:00", "r1"), ("b", "l", "2025-01-01 00:10:00", "r2"), ("a", "l", "2025-01-01 02:00:00", "r3")], "subject string, location string, t string, record_id string").select("subject", "location", F.to_timestamp("t").alias("at"), "record_id")
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def drained(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c_{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sum(r.n for r in drained(activity.counts(stream()), "counts", "complete")) == 9
    assert [(r.subject_a, r.subject_b) for r in drained(activity.overlaps(stream(), stream()), "overlaps")] == [("a", "b")]
    store = Store(spark, f"{tmp_path}/store")
    keyed = stream().withColumn("id", F.col("record_id"))
    for k in range(2):
        q = keyed.writeStream.foreachBatch(activity.append(store, "acts")).option("checkpointLocation", f"{tmp_path}/f{k}").start()
        q.processAllAvailable()
        q.stop()
    assert store.read("acts").count() == 3


def test_large_blocks_make_all_pairs(spark):
    rows = [(f"r{k:03}", f"Bank {k}") for k in range(230)] + [("s1", "Tata Steel"), ("s2", "Tata Foods")]
    found, large = pairs.candidates(spark.createDataFrame(rows, "ref string, name string"))
    got = [(c.ref_a, c.ref_b) for c in found.collect()]
    banks = [r for r, _ in rows[:230]]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in banks for b in banks if a < b} | {("s1", "s2")}
    assert [(b.block, b.members) for b in large.collect()] == [("w:bank", 230)]


def test_paths_of_more_than_fifty_edges(spark):
    chain = spark.createDataFrame([(k, k + 1, "t") for k in range(53)], "src long, dst long, type string")
    found = graph.hops(chain, spark.createDataFrame([(0,)], "id long"))
    assert {r.id: r.hops for r in found.collect()} == {k: k for k in range(54)}


def test_paths_say_why_there_is_none(spark):
    v = spark.createDataFrame([(k,) for k in range(6)], "id long")
    e = spark.createDataFrame([(0, 1, "a", 1.0), (1, 2, "b", 1.0), (3, 4, "a", 1.0), (2, 99, "a", 1.0)], "src long, dst long, type string, weight double")
    assert graph.find_path(v, e, 0, 2) == {"found": True, "path": [0, 1, 2], "hops": 2}
    for start, goal, types, why in ((9, 1, None, "start"), (1, 9, None, "goal"), (1, 1, None, "same"), (0, 4, None, "no path"), (0, 2, ["a"], "of the types a")):
        found = graph.find_path(v, e, start, goal, types)
        assert not found["found"] and why in found["reason"]


def test_community_profiles(spark):
    v = spark.createDataFrame([(k, "person" if k < 3 else "place") for k in range(5)], "id long, kind string")
    e = spark.createDataFrame([(0, 1, "a"), (1, 0, "a"), (1, 3, "b"), (0, 4, "a")], "src long, dst long, type string")
    groups = spark.createDataFrame([(0, 0), (1, 0), (3, 0), (2, 2), (4, 4)], "id long, community long")
    scores = spark.createDataFrame([(0, 0.1), (1, 0.5), (3, 0.1)], "id long, betweenness double")
    got = {r.community: r for r in graph.community_profiles(groups, v, e, scores).collect()}
    assert got[0].asDict() == {"community": 0, "size": 3, "kinds": {"person": 2, "place": 1}, "edge_types": {"a": 2, "b": 1}, "internal_edges": 3, "representatives": [1, 0, 3]}
    assert (got[2].size, got[2].internal_edges, got[2].edge_types) == (1, 0, None)


def test_thresholds_within_a_subset(spark):
    rows = [(1, 0.9, False), (0, 0.8, True), (1, 0.7, False), (0, 0.2, False), (1, 0.6, False), (0, 0.1, True)]
    scored = spark.createDataFrame(rows, "label int, score double, hard boolean")
    assert aggregates.threshold_selection(scored, 0.5).first().threshold == 0.6
    bound = aggregates.threshold_selection(scored, 0.5, subset="hard", subset_ceiling=0.4).first()
    assert bound.threshold == 0.9 and bound.feasible
    assert not aggregates.threshold_selection(scored, -1.0).first().feasible


def test_blocks_of_many_names_and_parts_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PART", 3)
    r = random.Random(5)
    rows = sorted({(k % 40, f"{r.choice('abc')}x {r.choice('def')}y") for k in range(90)})
    found = pairs.candidates(spark.createDataFrame([*rows, (None, "ax dy"), (50, None), (51, "")], "ref long, name string"))[0]
    want = {}
    for a, m in rows:
        for b, n in rows:
            if a < b:
                for block in ([f"n:{m}"] if m == n else []) + ([f"w:{m.split()[0]}"] if m.split()[0] == n.split()[0] else []):
                    want[a, b] = min(block, want.get((a, b), block))
    got = [(x.ref_a, x.ref_b, x.block) for x in found.collect()]
    assert len(got) == len(want) and {(a, b): k for a, b, k in got} == want
    # pairs are neither exchanged nor grouped
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate")


def test_negative_samples_meet_list_by_list(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(joins, "PART", 4)
    rows = [(k % 2, k) for k in range(40)]
    df = spark.createDataFrame(rows, "g long, id long")
    known = {(a, b) for _, a in rows for _, b in rows if (a + b) % 7 == 0}
    draw = lambda a, g: sorted((hashlib.md5(f"42|{a}|{b}".encode()).hexdigest(), b) for h, b in rows if h == g and b != a and (a, b) not in known)[:3]
    want = {(a, b) for g, a in rows for _, b in draw(a, g)}
    for given in (lambda a, b: (a + b) % 7 == 0, spark.createDataFrame(sorted(known), "a long, b long")):
        found = joins.negative_sample(df, df, "g", given, 42, 3)
        got = [(x.a, x.b) for x in found.collect()]
        assert len(got) == len(want) and set(got) == want
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_parts_of_large_tables_grow_with_them(spark, monkeypatch, tmp_path):
    from lodestrand.queries import derived_edges_owner_rollup

    tables = {
        "customer": ([(0, 1), (1, 2)], "c_custkey long, c_nationkey int"), "supplier": ([(0, 2), (1, 3)], "s_suppkey long, s_nationkey int"),
        "orders": ([(k, k % 2) for k in range(30)], "o_orderkey long, o_custkey long"), "lineitem": ([(k, j) for k in range(30) for j in (0, 1, 1)], "l_orderkey long, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(joins, "ROWS", 10)
    found = derived_edges_owner_rollup(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.select("src", "dst", "n", "evidence_count").collect()) == [(1, 2, 15, 15), (1, 3, 30, 15), (2, 3, 30, 15)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", 9), REPARTITION_BY_NUM" in plan


def test_rounds_of_a_small_frontier_exchange_no_edges(spark):
    edges = spark.createDataFrame([(k, k + 1, "t") for k in range(4)] + [(k, k + 1, "t") for k in range(100, 20_000, 2)], "src long, dst long, type string")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in range(spark.sparkContext._jsc.sc().dagScheduler().nextStageId()) if spark.sparkContext.statusTracker().getStageInfo(k))
    before = written()
    found = graph.hops(edges, spark.createDataFrame([(2,)], "id long"))
    assert {r.id: (r.hops, r.previous) for r in found.collect()} == {0: (2, 1), 1: (1, 2), 2: (0, None), 3: (1, 2), 4: (2, 3)}
    assert written() - before < 1_000


def test_edges_are_folded_after_one_exchange_of_contributions(spark):
    rows = [("t", f"a{k % 3}", f"b{k % 2}", f"e{k % 4}", f"r{k}", f"d{k}", 1.0, 2.0, "x", "m") for k in range(24)]
    c = spark.createDataFrame(rows, "type string, src string, dst string, evidence_id string, record_id string, at string, duration double, amount double, currency string, method string")
    plain, dealt = aggregates.aggregate_edges(c), aggregates.aggregate_edges(c, 5)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect()))
