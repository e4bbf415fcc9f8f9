"""Questions in plain words: which intent, which known names, and claims that cite evidence.

The surfaces of names are a table; each question's own runs of words meet it in an equi-join, so neither side is held in
one place. Choosing the longest of overlapping mentions is an expression over one question's few hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.names import normalize_name

#: Intents by the patterns that tell them, in order of precedence.
INTENTS = [
    ("contradictions", ["contradict", r"\bconflict(ing|s)?\b", "inconsistenc", "disagree", "cannot both be true"]),
    ("financial_path", ["financial connection", r"\bmoney\b", r"\bfunds?\b", "transaction path", r"\bpayments?\b", r"\blaunder", r"\bmule\b", r"\btransfers?\b"]),
    ("colocation_at_event", ["same location at the same time", "co-?locat", "same place", r"\bplaces? (them|him|her|any|the)\b", "at the (scene|warehouse|farmhouse|guesthouse)", "phone activity", r"\bcell tower\b"]),
    ("intermediary_links", ["intermediar", "more than one (principal|suspect)", "connect(ing|s)? .* (to|and) .* (suspects|principals)", r"\bmiddleman\b", r"\bbroker\b"]),
    ("structural_significance", ["most (significant|important|central|connected)", "structural role", r"\bcentrality\b", r"\bhub\b", "key player", r"\bbridge\b", r"\bcommunit(y|ies)\b"]),
    ("suspects_overview", ["who are the (primary |main )?suspects", "list the suspects", r"\bwhat aliases\b", r"\baliases do\b"]),
    ("case_summary", ["summari[sz]e the case", "case summary", "what has been corroborated", "overall picture"]),
    ("relationship_between", ["relationship(s)? (exist|between)", "how (are|is) .* (related|connected|linked)", "connection between", "link(ed)? between", r"\bbetween\b"]),
]
#: Shortest surface in characters, shortest single word of a name, words that are none.
SHORTEST, SHORTEST_WORD = 3, 4
#: Shapes of references: proper names, case identifiers, quoted words.
REFERENCES = [r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})+\b", r"\bSYN-[A-Z]+-[0-9]+\b", r"'[^']{2,40}'", r'"[^"]{2,40}"']
#: Stands where an unknown reference was; part of no name.
_GONE = "\ue000"
STOPWORDS = ["the", "and", "from", "with", "this", "that", "what", "which", "case", "company", "limited"]


def normalize_question(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _words(x: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.regexp_replace(F.lower(x), rf"[^\p{{L}}\p{{N}}{_GONE}]+", " "), " "), lambda w: w != "")


def _runs(words: Column, least: int, most: Column) -> Column:
    """struct<at, n, surface> of each run of ``least`` to ``most`` of the words."""

    def from_(at: Column) -> Column:
        longest = F.least(most, F.size(words) - at)
        some = F.when(longest >= least, F.sequence(F.lit(least), longest)).otherwise(F.array().cast("array<int>"))
        return F.transform(some, lambda n: F.struct(at.alias("at"), n.alias("n"), F.array_join(F.slice(words, at + 1, n), " ").alias("surface")))

    return F.when(F.size(words) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), from_))).otherwise(F.array().cast("array<struct<at:int,n:int,surface:string>>"))


def intent(question: Column, mentions: Column) -> Column:
    """The first intent that one of its patterns tells; else a profile if there are mentions, else open."""
    out = F.when(mentions > 0, "entity_profile").otherwise("open_question")
    for name, patterns in reversed(INTENTS):
        out = F.when(question.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), name).otherwise(out)
    return out


def surfaces(labels: DataFrame) -> DataFrame:
    """(surface, entities) of (label, id): whole names, their long words, and the last run of digits, each lower-cased."""
    n = normalize_name(F.col("label"))
    words = F.filter(F.split(n, " "), lambda w: (F.length(w) >= SHORTEST_WORD) & ~w.isin(STOPWORDS))
    tail = F.regexp_extract(F.col("label"), r"([0-9]{3,})[^0-9]*$", 1)
    every = labels.select("id", F.explode(F.array_distinct(F.concat(F.array(n, F.replace(n, F.lit(" "), F.lit("")), tail), words))).alias("surface")).where(F.length("surface") >= SHORTEST)
    return every.groupBy("surface").agg(F.array_sort(F.collect_set("id")).alias("entities"))


def unknown_references(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(id, unknown array) of (id, question): what looks like a name or an identifier but is no surface (surface), no run of
    words within one, and holds no surface of several words."""
    spans = F.array_distinct(F.concat(*[F.regexp_extract_all("question", F.lit(p), F.lit(0)) for p in REFERENCES]))
    said = questions.select("id", F.explode(spans).alias("span")).withColumn("w", _words(F.col("span"))).withColumn("key", F.array_join("w", " ")).where(F.length("key") >= SHORTEST)
    split = names.select(F.split("surface", " ").alias("w"))
    within = split.select(F.explode(_runs(F.col("w"), 1, F.size("w"))).alias("r")).select(F.col("r.surface").alias("key")).distinct()
    many = names.select(F.col("surface").alias("part")).where(F.contains("surface", F.lit(" "))).distinct()
    holds = said.select("id", "span", F.explode(_runs(F.col("w"), 2, F.size("w"))).alias("r")).join(many, F.col("r.surface") == F.col("part"), "left_semi").select("id", "span").distinct()
    left = said.join(within, "key", "left_anti").join(holds, ["id", "span"], "left_anti")
    return left.groupBy("id").agg(F.array_sort(F.collect_set("span")).alias("unknown"))


def ground(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, intent, mentions, ambiguous, unknown) of (id, question): mentions are the entities that are named without doubt.

    References to what is not known are told first and take their words, so that "Priya Sharma" is never answered as
    another Sharma. Then longer surfaces win over those that they overlap; one of two or more entities is ambiguous.
    """
    q = questions.select("id", normalize_question(F.col("question")).alias("question"))
    names = surfaces(labels)
    q = q.join(unknown_references(q, names), "id", "left").withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))
    longest = names.agg(F.coalesce(F.max(F.size(F.split("surface", " "))), F.lit(1)).alias("longest"))
    left = F.aggregate("unknown", F.col("question"), lambda acc, x: F.replace(acc, x, F.lit(f" {_GONE} ")))
    words = q.select("id", _words(left).alias("w")).crossJoin(F.broadcast(longest))  # one row
    spans = words.select("id", F.explode(_runs(F.col("w"), 1, F.col("longest"))).alias("r")).select("id", "r.*").where(F.length("surface") >= SHORTEST)
    hits = spans.join(names, "surface").groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "at", "n", "entities"))).alias("h"))
    free = lambda acc, x: F.struct(F.when(F.exists(acc["k"], lambda y: (x["at"] < y["at"] + y["n"]) & (y["at"] < x["at"] + x["n"])), acc["k"]).otherwise(F.concat(acc["k"], F.array(x))).alias("k"))
    start = F.struct(F.slice("h", 1, 0).alias("k"))
    kept = hits.select("id", F.aggregate("h", start, free, lambda acc: acc["k"]).alias("k"))
    sure = F.array_sort(F.array_distinct(F.transform(F.filter("k", lambda x: F.size(x["entities"]) == 1), lambda x: F.get(x["entities"], 0))))
    known = kept.select("id", sure.alias("mentions"), F.exists("k", lambda x: F.size(x["entities"]) > 1).alias("ambiguous"))
    joined = q.join(known, "id", "left")
    mentions = F.coalesce("mentions", F.array().cast("array<string>"))
    return joined.select("id", intent(F.lower("question"), F.size(mentions)).alias("intent"), mentions.alias("mentions"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), "unknown")
