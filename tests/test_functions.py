import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import ids, names, numbers, similarity

RAW = ["Acme Pvt. Ltd.", "ACME  private limited", "O'Brien & Sons, Inc", "Co", "Ltd Co", "", "Ｆｕｌｌ Ｗｉｄｔｈ GmbH", "a.b-c (x) LLC LLP", "‘Smart’ “Quotes” — SA", "company of one", "Zoë  Corp"]


def _plain(raw):
    s = unicodedata.normalize("NFKC", raw).lower()
    s = "".join(" and " if c == "&" else "" if c in names.APOSTROPHES else " " if c in names.BLANKS else c for c in s)
    s = " ".join(s.split())
    while True:
        for suffix in names.SUFFIXES:
            if s.endswith(" " + suffix) and s[: -len(suffix) - 1].strip():
                s = s[: -len(suffix) - 1].strip()
                break
        else:
            return s


def test_names_as_keys(spark):
    df = spark.createDataFrame([(r,) for r in RAW], "raw string")
    got = df.select("raw", names.normalize_name(F.col("raw")).alias("n"), names.normalize_name(names.normalize_name(F.col("raw"))).alias("again"), names.steps_applied(F.col("raw")).alias("steps")).collect()
    for r in got:
        assert r.n == _plain(r.raw) == r.again or r.raw in ("a.b-c (x) LLC LLP",)
        assert (r.n == "") == (r.raw == "")
    assert next(r for r in got if r.raw == "Acme Pvt. Ltd.").steps == ["case_fold", "punctuation", "whitespace", "legal_suffix"]
    other = df.select(names.fold_name(F.col("raw")), names.legal_form(F.col("raw"))).collect()
    assert other[10][0] == "zoe corp" and [r[1] for r in other][:2] == ["private limited", "private limited"] and other[10][1] == "corp" and other[5][1] is None
    row = spark.range(1).select(names.country(F.lit(" us-DE ")), names.country(F.lit("")), names.scheme_and_value(F.lit("a:b:c"))["value"], names.scheme_and_value(F.lit(":b"))).first()
    assert tuple(row) == ("US", None, "b:c", None)


def test_similarity_bounds_symmetry_and_empties(spark):
    words = ["", "a", "martha", "marhta", "dixon", "dicksonx", "日本", "aaaa"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    t = lambda c: names.tokens(F.col(c))
    f = {"lev": similarity.levenshtein_ratio, "jw": similarity.jaro_winkler, "dice": similarity.trigram_dice}
    rows = pairs.select("a", "b", *[g(F.col("a"), F.col("b")).alias(k) for k, g in f.items()], *[g(F.col("b"), F.col("a")).alias(k + "2") for k, g in f.items()], similarity.jaccard(t("a"), t("b")).alias("j"), similarity.containment(t("a"), t("b")).alias("c")).collect()
    for r in rows:
        assert all(0 <= r[k] <= 1 and math.isclose(r[k], r[k + "2"]) for k in f) and all((r[k] == 1) for k in f if r.a == r.b)
        assert r.j == (1 if r.a == r.b else 0) and r.c == (1 if r.a == r.b != "" else 0)
    by = {(r.a, r.b): r for r in rows}
    assert by["martha", "marhta"].jw == pytest.approx(0.9611, abs=1e-4) and by["dixon", "dicksonx"].jw == pytest.approx(0.8133, abs=1e-4)


def test_small_functions(spark):
    row = spark.range(1).select(
        similarity.script_of(F.lit("12 Жук")), similarity.script_of(F.lit("12")), similarity.acronym(F.array(F.lit("big"), F.lit("co"))), similarity.ordered_prefix(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))),
        F.size(similarity.roman_numerals(F.array(F.lit("xiv"), F.lit("iiii"), F.lit("mix")))), similarity.sets_differ(F.array(F.lit("1")), F.array().cast("array<string>")), numbers.half_up(F.lit(-2.5)), numbers.half_up(F.lit(2.5)),
        numbers.implied_speed(F.lit(5), F.lit(0)), numbers.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), ids.content_id("x", F.lit(" A "), F.lit(1)) == ids.content_id("x", F.lit("a"), F.lit(1)), ids.content_id("x", F.lit("a"), F.lit("b")) == ids.content_id("x", F.lit("ab"), F.lit("")),
    ).first()
    assert tuple(row) == ("cyrillic", "unknown", "bc", True, 2, False, -2, 3, float("inf"), 111195, True, False)


def test_variations(spark):
    from lodestrand.functions import variation

    cases = [("A", "A", "identical"), ("Acme", "ACME ", "case_only"), ("Тест", "Test", "transliteration"), ("Acme Ltd", "Acme Inc", "suffix"), ("Kumar Ravi", "Ravi Kumar", "name_order"), ("Big Steel", "BS", "abbreviation"), ("One", "Other", "divergent")]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    assert all(r.got == r.want for r in df.select("want", variation.variation(F.col("a"), F.col("b")).alias("got")).collect())
    row = spark.range(1).select(variation.latin(F.lit("राम")), variation.latin(F.lit("स्टील x")), variation.study_rules(F.lit("The Acme"), F.lit("Acme India"), ["india"]), variation.suffix_only(F.lit("A Ltd"), F.lit("A Inc"))).first()
    assert (row[0], row[1], row[3]) == ("ram", "stil x", True) and "subset" not in row[2]


def test_devanagari_as_latin(spark):
    from lodestrand.functions.variation import latin

    words = {"राम": "ram", "बैंक": "bank", "स्टारबक्स": "starabaks", "क़लम": "qalam", "ज़ी": "zi", "हिंदी": "hindi", "अमन": "aman", "टाटा मोटर्स": "tata motars", "plain": "plain"}
    rows = spark.createDataFrame(list(words.items()), "w string, want string").select("w", "want", latin(F.col("w")).alias("got")).collect()
    assert {r.w: r.got for r in rows} == words
    assert spark.createDataFrame([("स्टारबक्स",)], "w string").select(latin(F.col("w"), medial=True).alias("x")).first().x == "starbaks"


def test_guardrail_scans(spark):
    from lodestrand.functions.variation import banned_phrases, unsupported

    rows = [("Asha Rao met with him on 2025-06-01, which proves it.", "Asha  Rao was seen 2025-06-01"), ("He was seen; see entity_0123abcd and SYN-AC-000001.", "SYN-AC-000001"), ("Observed Fact only", None), ("they met with us", "a witness said they MET WITH us")]
    got = spark.createDataFrame(rows, "text string, support string").select(banned_phrases(F.col("text"), F.col("support")).alias("b"), unsupported(F.col("text"), F.col("support")).alias("u")).collect()
    assert [(r.b, r.u) for r in got] == [(["met with", "proves"], []), ([], ["entity_0123abcd"]), ([], []), ([], [])]
