"""Licences, personal data, addresses and fingerprints: expressions only."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import fingerprint, license, pii, url_filter

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(s):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def _valid(kind, s):
    n = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(n) <= 19 and _luhn(n), "phone": 9 <= len(n) <= 15}[kind]


def _base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if _valid(k, m[0])]


def _odd_texts():
    r = random.Random(4)
    out = [None, "", "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8.9", "0000001.2.3.255 256.1.1.1 1.2.3", "4111 1111-1111 1111 1", "4111111111111111", "+1 (974) 555-1257 x +12", "+1 2 ( 555-123456789 .", "éé x@y.z 日本 +49 30 1234567", "x" * 50_000 + "@", "9" * 30_000, "1 " * 20_000, "+1" + "(" * 20_000, "a@b.c " * 800]
    return out + ["".join(r.choices("ab1290@.+- ()é", k=120)) for _ in range(250)]


def test_base_spans_equal_plain_patterns(spark):
    texts = _odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, "dup@x.com"), (None, "1.1.1.1")], "doc_id long, text string")
    got = pii.find(df.withColumns({"kind": F.lit("clash"), "spans": F.lit(1), "row": F.lit("r")})).collect()
    assert got[0].kind == "clash" and got[0].row == "r"
    assert len(got) == len(texts) + 2
    for row in got:
        text = "1.1.1.1" if row.doc_id is None else texts[row.doc_id]
        own = [f"{pii.KINDS[s.kind]}:{s.start}:{s.stop}" for s in row.spans if s.base]
        assert own == _base(text) or own == ["email:0:9"]
    assert pii.find(df.limit(0)).count() == 0


def _planted(seed):
    """(text, {(kind, span)}) rows: further personal data of every kind in plain sentences, and decoys that are none."""
    r = random.Random(seed)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    digits = lambda n: "".join(r.choices("23456789", k=n))
    good = {
        "secret": lambda: (r.choice(['token = "{}"', "api_key: {}", "password={} ", "Authorization: Bearer {}"]), r.choice([hexes(40), hexes(32), "ghp_" + "".join(r.choices("abcDEF0123456789", k=36)), "AKIA" + "".join(r.choices("ABCDEFG0123456789", k=16))])),
        "phone": lambda: (r.choice(["please call {} today", "phone {} or write", "my mobile {} is on"]), f"({digits(3)}) {digits(3)}-{digits(4)}"),
        "ssn": lambda: (r.choice(["his SSN {} was lost", "social security number {} of him"]), f"{r.randint(100, 599)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
        "account": lambda: (r.choice(["transfer to IBAN {} now", "the bank account {} is hers"]), r.choice(["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NL91ABNA0417164300"])),
        "name": lambda: (r.choice(["signed {} yesterday", "the patient {} said", "dear {} we"]), f"{r.choice(['Mr.', 'Dr.', 'Mrs.', 'Frau'])} {r.choice(['Sarah', 'John', 'Petra', 'Peter'])} {r.choice(['Miller', 'Okafor', 'Schmidt', 'Lindgren'])}"),
        "address": lambda: (r.choice(["she lives at {} with him", "ship to my address {} soon"]), f"{r.randint(10, 999)} {r.choice(['Maple', 'Old Mill', 'King'])} {r.choice(['Street', 'Avenue', 'Road'])}"),
        "card": lambda: ("pay by visa card {} please", "4111.1111.1111.1111"),
        "email": lambda: ("mail me, address {} works", f"jo{r.randint(1, 99)} [at] example [dot] com"),
    }
    bad = {
        "secret": lambda: (r.choice(["commit {} fixed it", "sha1: {} of the file", "checksum {} matches"]), hexes(40)), "phone": lambda: ("order {} of the invoice", f"{r.choice('01')}{digits(2)}-{digits(3)}-{digits(4)}"), "card": lambda: ("serial {} of the item", f"{r.choice('17890')}123.4567.8901.2346"),
        "ssn": lambda: ("item {} on page 3", f"000-{r.randint(10, 99)}-{r.randint(1000, 9999)}"), "account": lambda: ("serial {} of part", "XQ12 AAAA BBBB CCCC DDDD"),
    }
    rows = []
    for _ in range(40):
        for kinds, true in ((good, True), (bad, False)):
            for kind, make in kinds.items():
                frame, value = make()
                text = "é prose here and " + frame.format(value) + " and so on."
                rows.append((text, {(kind, value)} if true else set()))
    return rows


def test_weak_supervision_adds_what_is_personal_and_leaves_what_is_not(spark):
    planted = _planted(3)
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(planted)], "doc_id long, text string")
    found = {r.doc_id: {(pii.KINDS[x.kind], planted[r.doc_id][0][x.start : x.stop]) for x in r.spans if not x.base} for r in pii.find(df).collect()}
    hit = sum(len(found[k] & true) for k, (_, true) in enumerate(planted))
    said, there = sum(map(len, found.values())), sum(len(true) for _, true in planted)
    assert hit >= 0.9 * there and hit >= 0.95 * said, (hit, said, there, [(planted[k][0], v) for k, v in found.items() if v - planted[k][1]][:5])
    for kind in ("secret", "phone", "ssn", "account", "name", "address", "card", "email"):
        assert sum((kind, v) in found[k] for k, (_, true) in enumerate(planted) for c, v in true if c == kind) >= 30, kind
    belief, rates = pii.reliabilities([(3, "+0+0", 40), (3, "-00-", 30), (0, "++00", 50)])
    assert belief[0] > 0.9 > 0.1 > belief[1] and rates[0, "+"][0] > rates[0, "+"][1]


def test_masking(spark):
    rows = [(1, "x a@b.com y 1.2.3.4.", 20, "k"), (2, None, None, "k"), (3, "clean é text", 12, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in pii.masked(df).collect()}
    assert (out[1].text, out[1].n_chars) == ("x <EMAIL> y <IP>.", 17)
    assert out[2].text is None and tuple(out[3]) == rows[2] and pii.masked(df).columns == df.columns


def test_licences_equal_brute_force(spark):
    mit, all_rights = next(t.text for t in license.TEMPLATES if t.name == "MIT" and "IN NO EVENT" in t.text), "All rights reserved."
    texts = [None, "", "one", "Released under the MIT License.", "é\nALL RIGHTS RESERVED\n\nfoo", "this work is licensed under\nthe gnu general public license version 3", mit + " more", "licensed under the apache license", "a b " * 3_000]
    texts += [
        "Copyright 2020 Foo Inc. All rights reserved.", "The photos on this page are licensed under CC BY-NC 4.0 and nothing else.", "This project is released under the MIT License, see there.",
        f"{mit} {all_rights} {mit}", f"{all_rights} " * 300, "x " * 500 + mit.replace("charge", "cost").replace("publish, distribute", "distribute"), "licensed under the mozilla general rights reserved license version",
        "Licensed under the Apache License, Version 1.1.", mit[:300], "software without restriction including without limitation",
    ]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, found string")
    got = {r.doc_id: [(x.license, round(x.dice, 9), x.start, x.stop) for x in r.found] for r in license.matches(df).collect()}
    for k, text in enumerate(texts):
        assert got[k] == [(n, round(d, 9), a, b) for n, d, a, b in license.brute_force(text)], text and text[:80]
    assert [x[0] for x in got[3]] == ["MIT"] and [x[0] for x in got[12]] == ["MIT", "proprietary", "MIT"] and len(got[13]) == 300
    assert [[x[0] for x in got[k]] for k in (9, 10, 11, 14, 16)] == [["proprietary"], ["CC-BY-NC-4.0"], ["MIT"], ["MIT"], []]
    assert license.matches(df).columns == df.columns and license.matches(df.limit(0)).count() == 0


def test_every_licence_is_told_from_its_family(spark):
    """Each template, with words around it, gives its own name alone; anchors lose no window that reaches the threshold."""
    df = spark.createDataFrame([(k, f"foo bar\n{t.text}\nbaz qux") for k, t in enumerate(license.TEMPLATES)], "doc_id long, text string")
    for r in license.matches(df).collect():
        assert [x.license for x in r.found] == [license.TEMPLATES[r.doc_id].name] and r.found[0].dice == 1.0
    assert len({t.name for t in license.TEMPLATES}) >= 35
    for t in license.TEMPLATES:
        grams = set(license.bigrams_of(license.words_of(t.text)))
        assert set(t.must) <= grams and len(grams) - len(set(license.anchors_of(sorted(grams)))) < license.least_shared(len(grams))


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("HTTP://WWW.Example.COM/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://xexample.com/en/", "xexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/q", "a.net", "/es/q", "net/es/", "block"),
        ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("http://a.com?x/en/", "a.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://a.org://b/c", "a.org:", "//b/c", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    row = url_filter.judge(spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")).first()
    assert tuple(row) == (1, host, path, rule, verdict)


def test_reputation_shrinks_and_blocks(spark):
    hosts = spark.createDataFrame([("bad.x.org", 200, 195), ("ok.y.org", 300, 3), ("one.y.org", 1, 1), ("new.y.org", 0, 0), ("shop.z.co.uk", 5, 0), ("10.0.0.1", 0, 0), ("", 0, 0)], "host string, n long, k long")
    got = {r.host: r for r in url_filter.reputation(hosts).collect()}
    assert len(got) == 7
    assert got["bad.x.org"].bound > 0.9 > 0.5 > got["one.y.org"].bound and got["ok.y.org"].mean < 0.05
    assert got["new.y.org"].mean < got["one.y.org"].mean
    domains = spark.createDataFrame([("a.b.co.uk",), ("b.com:80",), ("localhost",)], "h string").select(url_filter.domain_of(F.col("h")).alias("d"))
    assert [r.d for r in domains.collect()] == ["b.co.uk", "b.com", "localhost"]


def test_method_blocks_hosts_domains_and_suffixes(spark):
    known = [("bad.x.org", 80, 76), ("a.spam.info", 60, 57), ("b.spam.info", 70, 66), ("c.spam.info", 90, 88), ("thin.y.org", 2, 2)]
    known += [(f"h{k}.fine.org", 50, k % 3) for k in range(30)] + [(f"g{k}.good{k}.info", 40, 1) for k in range(30)]
    pages = [(1, "http://bad.x.org/q"), (2, "http://new.spam.info/"), (3, "http://h3.fine.org/"), (4, "http://thin.y.org/"), (5, "http://never.seen/"), (6, None), (7, "http://bad.x.org/" + "x" * 300_000), (7, "http://bad.x.org/q"), (8, "http://a.spam.info/q"), (9, "http://www.example.com/en/")]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id long, url string, host string, n int")
    got = url_filter.judge(df, spark.createDataFrame(known, "host string, n long, k long")).collect()
    assert len(got) == len(pages) and {r.page_id for r in got if r.verdict == "block"} == {1, 2, 7, 8}
    assert sum(r.verdict == "block" for r in got) == 5
    nothing = spark.createDataFrame([], "host string, n long, k long")
    assert {r.verdict for r in url_filter.judge(df, nothing).collect()} == {"allow"} and url_filter.judge(df.limit(0), nothing).count() == 0


def test_outcomes_of_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/7"), (1, "http://a.org/en/7.html?x"), (2, "http://A.org/de/8/"), (3, "http://a.org/en/9x"), (4, None), (5, "http://b.org/en/10")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (8, 1, None), (10, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in url_filter.outcomes(pages, labels).collect()] == [("a.org", 3, 2)]


def test_fingerprints_of_edits(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    texts = [None, "", "one", "two words", "é" * 40, " ".join(["Und"] * 300), *(" ".join(r.choices(words, k=n)) for n in (5, 60, 400, 3000)), "no blanks " + "x" * 30_000]
    rows = [(7 * k, t) for k, t in enumerate(texts)] + [(70 + 7, texts[8]), (None, "lost id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(14, "zzz", 1)], "doc_id long, text string, a int")
    got = [x for x in fingerprint.compare_with_edits(df).collect()]
    assert len(got) == len(rows) + 1
    least = {}
    for i, t in [*rows, (14, "zzz")]:
        if i is not None:
            least[i] = min(least.get(i, t or ""), t or "")
    ids = sorted(least)
    for x in got:
        if x.doc_id is None:
            assert x.edited_sha256 == hashlib.sha256(b"lost id").hexdigest() and (x.near_edited, x.near_next) == (1.0, 0.0)
            continue
        own = [t or "" for i, t in [*rows, (14, "zzz")] if i == x.doc_id and len(t or "") == x.n_chars]
        after = least[ids[(ids.index(x.doc_id) + 1) % len(ids)]]
        edits = {hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest() for t in own}
        assert x.edited_sha256 in edits and 0 <= x.near_next <= 1 and 0 <= x.near_edited <= 1
        if x.n_chars > 250 and " " in own[0] and "Und" not in own[0] and "blanks" not in own[0]:
            assert x.near_edited > 0.25 > x.near_next or own[0] == after
    same = {x.fingerprint for x in got if x.doc_id in (56, 77)}
    assert len(same) == 1 and next(iter(same)).count("@") >= fingerprint.ANCHORS
    assert fingerprint.compare_with_edits(df.where("doc_id = 7")).first().near_next == 1.0
    assert fingerprint.compare_with_edits(df.limit(0)).count() == 0


def test_anchors_by_definition(spark):
    """Chosen k-mers are those whose least s-mer stands at an edge, and copies inside other text keep them."""
    text = " ".join(f"v{k * k % 97}" for k in range(90))
    df = spark.createDataFrame([(text,), ("x y z " + text + " q r",)], "text string")
    a, b = (r.a for r in df.select(fingerprint.anchors(F.col("text")).alias("a")).collect())
    hashed = spark.createDataFrame([(text,)], "text string").selectExpr("transform(split(text, ' '), w -> xxhash64(w)) w").selectExpr("transform(slice(w, 1, size(w) - 1), (x, i) -> xxhash64(x, w[i + 1])) s").first().s
    chosen = {i for i in range(len(hashed) - 2) if min(hashed[i : i + 3]) in (hashed[i], hashed[i + 2])}
    assert set(a.p) <= chosen and a.h == sorted(a.h)
    shared = set(a.h) & set(b.h)
    assert len(shared) >= 24 and all(b.p[b.h.index(h)] - a.p[a.h.index(h)] == 3 for h in shared)


def test_a_passage_in_a_long_text_keeps_its_anchors(spark):
    """Beyond the least number of anchors: a copied passage is found in texts of any length, and short texts compare too."""
    r = random.Random(12)
    words = [f"q{k}" for k in range(4000)]
    passage = r.choices(words, k=400)
    long_a, long_b = (" ".join(r.choices(words, k=9000) + passage + r.choices(words, k=9000)) for _ in range(2))
    rows = [(1, long_a), (2, long_b), (3, " ".join(passage)), (4, "one two three"), (5, "one two four"), (6, "x " * 200_000)]
    a = {x.i: x.a for x in spark.createDataFrame(rows, "i int, t string").select("i", fingerprint.anchors(F.col("t")).alias("a")).collect()}
    assert len(a[1].h) > 1500 and a[1].h == sorted(a[1].h) and len(set(a[1].h)) == len(a[1].h)
    low = {h for h in a[3].h if h < fingerprint.ALL_BELOW}
    assert len(low) > 40 and len(low & set(a[1].h) & set(a[2].h)) >= len(low) - 1
    assert len(set(a[1].h) & set(a[2].h)) >= len(low) - 1
    same = spark.createDataFrame([(k, m) for k in range(1, 7) for m in range(1, 7)], "i int, j int")
    found = spark.createDataFrame([(i, x) for i, x in a.items()], "i int, a struct<h:array<bigint>,p:array<int>>")
    pairs = same.join(found.toDF("i", "a"), "i").join(found.toDF("j", "b"), "j").select("i", "j", fingerprint.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    got = {(r.i, r.j): r.x for r in pairs}
    assert all(got[k, k] == 1.0 and abs(got[k, m] - got[m, k]) < 1e-12 for k in a for m in a)
    assert got[4, 5] == 0.5 and got[1, 6] == 0.0
    assert 0 < got[1, 2] < 0.1
    # by definition: anchors up to the hash that both hold, shared and shifted alike
    for i, j in ((1, 3), (1, 2), (4, 5)):
        cover = min((2**63 - 1 if len(a[k].h) < fingerprint.ANCHORS else max(a[k].h[-1], fingerprint.ALL_BELOW - 1)) for k in (i, j))
        u, v = ({h: p for h, p in zip(a[k].h, a[k].p, strict=True) if h <= cover} for k in (i, j))
        shifts = sorted(v[h] - u[h] for h in u.keys() & v.keys())
        slack = max(fingerprint.SLACK, int(max(*a[i].p, *a[j].p) / fingerprint.SLACK_SHARE))
        want = sum(abs(d - shifts[(len(shifts) - 1) // 2]) <= slack for d in shifts) / len(u.keys() | v.keys()) if shifts else 0.0
        assert got[i, j] == pytest.approx(want)


def test_fingerprints_of_very_long_texts_take_no_square_of_time(spark):
    """The middle of all shifts is found once for a pair of fingerprints, not once for each of its anchors."""
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:225_000] + words[:75_000]))]
    began = time.time()
    a, b = (x.near_edited for x in fingerprint.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect())
    assert time.time() - began < 30 and 0.7 < a < 0.8 and b > 0.95
