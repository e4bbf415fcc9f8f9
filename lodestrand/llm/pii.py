"""Personal data: fixed patterns, and further spans by weak supervision.

Base spans follow exact patterns of four kinds. Candidates are base spans, looser writings of these kinds (numbers without
+, other separators, spelled-out addresses) and what may be a secret, an account, a social security number, a name or a
street address. Labelers vote on each: its form, gazetteers (top-level names, card issuers, calling codes, key prefixes,
countries, given names, street types) and the words before it, for or against. Expectation-maximisation over the table of
vote patterns estimates how reliable each labeler is; a logistic classifier of spans, which also sees their length, their
share of digits and what stands around them, is then trained on its soft labels and alone decides which further spans to
keep. All candidates of all documents count; what reaches the driver is the table of patterns, bounded by their kinds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import materialize, table

#: The first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "account", "ssn", "secret", "name", "address")
#: Base patterns. Possessive and started at a run's beginning (or the last match's end), so that they take the same
#: matches as the plain ones in time linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser writings, each tried only in texts that the second pattern finds something in.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+(?![.@])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![\p{L}.])(?=[A-Z])(?:(?:TITLES)\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,2}|(?:GIVEN)(?: \p{Lu}\.)?(?: \p{Lu}[\p{L}'-]+){1,2})(?!\p{L})",
    "address": r"(?<![0-9\p{L}])(?:[0-9]{1,5} (?:\p{Lu}[\p{L}'.-]+ ){1,3}(?:STREETS)(?!\p{L})|\p{Lu}\p{L}+(?:straße|strasse|gasse|allee|platz) [0-9]{1,4}[a-z]?(?![0-9\p{L}]))",
}
GUARD = {"email": "@", "phone": "+"}
LOOSE_GUARD = {
    "email": r"\bat ?[\])]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": r"[0-9][./_][0-9]{4}[./_]", "phone": r"[0-9]{3}[-. ][0-9]{4}",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20}", "account": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "name": r"(?<!\p{L})(?=[A-Z])(?:(?:TITLES)\.? \p{Lu}|(?:GIVEN) \p{Lu})", "address": r" (?=[A-Z])(?:STREETS)(?!\p{L})|(?:straße|strasse|gasse|allee|platz) [0-9]",
}
#: Gazetteers and words of context (fixed values).
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme"
GIVEN = "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Mark|Paul|Steven|Andrew|Kevin|Brian|George|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Margaret|Sandra|Ashley|Emily|Laura|Anna|Maria|Peter|Hans|Klaus|Jürgen|Stefan|Sabine|Ursula|Petra|Jean|Pierre|Michel|Marie|Sophie|Camille|José|Juan|Carlos|Luis|Carmen|Lucía|Wei|Ahmed|Fatima|Priya|Rahul|Amit"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace"
KEY_PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|AIza|glpat-|ya29|eyJ)"
COUNTRIES = r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)"
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|io|de|fr|es|uk|it|nl|ch|at|be|eu|us|ca|au|jp|cn|in|br|ru"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|5))"
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|from|client|login|addr)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay|payment|cc)\b",
    "phone": r"(?i)\b(?:phone|call|tel|telephone|mobile|cell|fax|contact|dial|sms|whatsapp)\b",
    "secret": r"(?i)(?:token|secret|api[ _-]?key|access[ _-]?key|passw(?:or)?d|passphrase|pwd|bearer|authorization|private[ _-]?key|credentials?)\W{0,6}$",
    "account": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer|überweisung)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|taxpayer|tax)\b",
    "name": r"(?i)\b(?:name|named|dear|sincerely|signed|contact|patient|customer|employee|regards|born|called|from|by)\W*$",
    "address": r"(?i)\b(?:address|live|lives|living|resides?|located|at|wohnt|visit|home|office|deliver|ship)\b",
}
#: Words before that speak against any kind; of secrets, those that name a checksum; of names, what makes them a place's.
AGAINST_SECRET = r"(?i)(?:sha-?[0-9]*|md5|commit|checksum|digest|etag|integrity|hash|uuid|revision|https?:/*\S*)\W{0,8}$"
AGAINST = r"(?i)\b(?:version|order|isbn|issn|invoice|item|id|ref|reference|total|price|page|section|figure|table|serial|sku|build)\b"
BEFORE = 32
LABELERS = ("form", "gazetteer", "for", "against")
#: What each labeler's vote counts in the first beliefs: context more than looks.
START = (0.12, 0.12, 0.25, 0.3)
#: Rounds of expectation-maximisation and of training; a further span is kept at this probability or above.
EM_ROUNDS, STEPS, RATE, KEEP = 40, 600, 1.0, 0.9
#: Candidates of clear votes that each kind's prior counts in advance, for and against.
PRIOR_COUNT = 1.0


def _filled(pattern: str) -> str:
    return pattern.replace("TITLES", TITLES).replace("GIVEN", GIVEN).replace("STREETS", STREETS)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass Luhn's check."""

    def total(d: Column) -> Column:
        at = F.sequence(F.lit(0), F.length(d) - 1)
        value = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.aggregate(at, F.lit(0), lambda a, i: a + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))

    return _let(_digits(s), total) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: _let(F.regexp_replace(x, "^0+(?=[0-9])", ""), lambda y: (F.length(y) <= 3) & (F.lpad(F.substring(y, 1, 3), 3, "0") <= "255")))
    if kind == "card":
        return F.length(_digits(s)).between(13, 19) & _luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _mod97(s: Column) -> Column:
    """Whether an account number passes the check of its two digits."""

    def value(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)

    def rest(x: Column) -> Column:
        turned = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))
        return F.aggregate(F.split(turned, "(?!^)"), F.lit(0), lambda acc, c: F.pmod(acc * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)).cast("int"))

    return _let(F.regexp_replace(s, " ", ""), rest) == 1


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start int, stop int, s string>>: leftmost matches that don't overlap, in code points, stop exclusive."""
    none = F.array().cast("array<struct<start:int,stop:int,s:string>>")

    def placed(m: Column) -> Column:
        def walk(gaps: Column) -> Column:
            first = F.struct(F.lit(0).alias("at"), none.alias("found"))

            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(F.get(gaps, i))
                stop = start + F.length(F.get(m, i))
                return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), stop.alias("stop"), F.get(m, i).alias("s")))).alias("found"))

            return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), first, step, lambda acc: acc["found"])

        return F.when(F.size(m) == 0, none).otherwise(_let(F.split(text, pattern, -1), walk))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column, kind: str) -> Column:
    """The kind's matches that are valid; a failing match is dropped and not tried again."""
    found = F.filter(spans_of(text, BASE[kind]), lambda x: _valid(kind, x["s"]))
    return F.when(F.contains(text, F.lit(GUARD[kind])), found).otherwise(F.filter(spans_of(F.lit(""), "x"), lambda x: F.lit(False))) if kind in GUARD else found


def _votes(text: Column, kind: str, x: Column) -> Column:
    """One character a labeler: + for, - against, 0 no vote."""
    s = x["s"]
    before = F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - BEFORE), F.least(x["start"], F.lit(BEFORE)))
    vote = lambda yes, no: F.when(yes, "+").when(no, "-").otherwise("0")
    if kind == "email":
        form, gazetteer = vote(s.rlike(r"^[A-Za-z0-9]"), s.rlike(r"^[^A-Za-z0-9]")), vote(s.rlike(rf"(?i)(?:\.|dot ?[\])]) ?(?:{TOP_LEVEL})$"), F.lit(False))
    elif kind == "ip":
        form, gazetteer = vote(s.rlike(":[0-9A-Fa-f]*[1-9A-Fa-f]|^[1-9]"), s.rlike(r"^0")), vote(F.lit(False), s.rlike(r"^(?:0|127|255)\."))
    elif kind == "card":
        form, gazetteer = vote(_luhn(s), ~_luhn(s)), vote(_digits(s).rlike(ISSUERS), ~_digits(s).rlike(ISSUERS))
    elif kind == "phone":
        form, gazetteer = vote(_digits(s).rlike(r"^1?[2-9][0-9]{2}[2-9][0-9]{6}$") | s.startswith("+"), _digits(s).rlike(r"^1?[01]")), vote(s.rlike(r"^\+(?:1|20|27|3[0-46-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), F.lit(False))
    elif kind == "secret":
        mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
        form, gazetteer = vote(mixed & ~s.rlike("/.*/|--|__"), ~mixed | s.rlike(r"^(?:[A-Za-z]+[_/-])*[A-Za-z]+$")), vote(s.rlike(KEY_PREFIX) | s.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"), s.rlike(r"(?i)^(?:www|com|html|index|docs?|src|usr|home)[/_-]"))
    elif kind == "account":
        form, gazetteer = vote(_mod97(s), ~_mod97(s)), vote(s.rlike(COUNTRIES), ~s.rlike(COUNTRIES))
    elif kind == "ssn":
        bad = s.rlike(r"^(?:000|666|9)|-00-|-0000$")
        form, gazetteer = vote(~bad, bad), vote(F.lit(False), s.rlike(r"^(?:123-45-6789|078-05-1120|111-11-1111)$"))
    elif kind == "name":
        place = s.rlike(rf"(?: (?:{STREETS}|University|College|Hospital|School|Park|Church|Bridge|Inc|Corp|Company|Museum|Airport|County))$")
        form, gazetteer = vote(s.rlike(rf"^(?:{TITLES})\.? "), place), vote(s.rlike(rf"(?:^| )(?:{GIVEN})(?: |$)"), place)
    else:
        form, gazetteer = vote(s.rlike(r"^[0-9]+ \p{Lu}|[0-9][a-z]?$"), s.rlike(r"^0")), vote(s.rlike(rf"(?: (?:{STREETS})|straße [0-9]+[a-z]?|strasse [0-9]+[a-z]?)$"), F.lit(False))
    against = before.rlike(AGAINST_SECRET) if kind == "secret" else before.rlike(AGAINST)
    return F.concat(form, gazetteer, vote(before.rlike(FOR[kind]), F.lit(False)), vote(F.lit(False), against))


def _shape(text: Column, x: Column) -> Column:
    """What a span looks like, beside its votes: three characters for its length, its share of digits, its surroundings."""
    s, n = x["s"], x["stop"] - x["start"]
    length = F.when(n < 10, "a").when(n < 16, "b").when(n < 24, "c").when(n < 48, "d").otherwise("e")
    digits = F.length(F.regexp_replace(s, "[^0-9]", "")) * 4 / F.greatest(n, F.lit(1))
    before = F.substring(text, x["start"], F.when(x["start"] > 0, 1).otherwise(0))
    around = F.when(before.isin('"', "'", "`"), "q").when(before.isin("=", ":"), "=").when(before.isin("(", "<", "["), "(").when((before == "") | before.isin(" ", "\n"), "s").otherwise("o")
    return F.concat(length, F.least(F.floor(digits), F.lit(3)).cast("string"), around)


def candidates(text: Column) -> Column:
    """array<struct<start int, loose int, kind int, stop int, votes string>>, by start: base spans (loose 0), and looser
    ones (1) that touch none of them; of looser ones that overlap the leftmost stands, of those the first kind's.
    ``votes``: a character of each labeler, then three of the span's shape."""
    kind_of = "array<struct<start:int,loose:int,kind:int,stop:int,votes:string>>"

    def typed(k: int, spans: Column, loose: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(loose).alias("loose"), F.lit(k).alias("kind"), x["stop"].alias("stop"), F.concat(_votes(text, KINDS[k], x), _shape(text, x)).alias("votes")))

    found = [typed(k, base_spans(text, kind), 0).cast(kind_of) for k, kind in enumerate(KINDS) if kind in BASE]
    for k, kind in enumerate(KINDS):
        found.append(F.when(text.rlike(_filled(LOOSE_GUARD[kind])), typed(k, spans_of(text, _filled(LOOSE[kind])), 1).cast(kind_of)).otherwise(F.array().cast(kind_of)))

    def step(acc: Column, x: Column) -> Column:
        last, loose = acc["last"], x["loose"] == 1
        met = last.isNotNull() & (x["start"] < last["stop"])
        dropped = loose & (met | (x["start"] < acc["reach"]))  # what stands before stays
        yields = met & ~loose & (last["loose"] == 1)  # the one before was a looser writing
        out = F.when(dropped | yields | last.isNull(), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(last)))
        reach = F.when(loose, acc["reach"]).otherwise(F.greatest(acc["reach"], x["stop"]))
        return F.struct(out.alias("kept"), F.when(dropped, last).otherwise(x).alias("last"), reach.alias("reach"))

    none = F.struct(F.array().cast(kind_of).alias("kept"), F.lit(None).cast(kind_of[6:-1]).alias("last"), F.lit(0).alias("reach"))
    return F.aggregate(F.array_sort(F.concat(*found)), none, step, lambda acc: F.when(acc["last"].isNull(), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(acc["last"]))))


def reliabilities(patterns: Sequence[tuple[int, str, float]]) -> tuple[list[float], dict[tuple[int, str], list[float]]]:
    """Expectation-maximisation over (kind, votes, count) patterns: P(personal | pattern), and of each labeler and vote
    P(vote | personal), P(vote | not). Labelers are taken as independent, given the truth; each kind has a prior of its own."""
    n_votes = len(LABELERS)
    belief = [min(max(0.5 + sum(w * (m == "+") - w * (m == "-") for w, m in zip(START, v, strict=False)), 0.05), 0.95) for _, v, _ in patterns]
    rates: dict[tuple[int, str], list[float]] = {}
    for _ in range(EM_ROUNDS):
        sums: dict[int, list[float]] = {}
        for b, (kind, _, n) in zip(belief, patterns, strict=True):
            c = sums.setdefault(kind, [PRIOR_COUNT, PRIOR_COUNT])
            c[0] += b * n
            c[1] += (1 - b) * n
        prior = {kind: min(max(c[0] / (c[0] + c[1]), 0.02), 0.98) for kind, c in sums.items()}
        for j in range(n_votes):
            marks = {m: [1.0, 1.0] for m in "+-0"}
            for b, (_, v, n) in zip(belief, patterns, strict=True):
                marks[v[j]][0] += b * n
                marks[v[j]][1] += (1 - b) * n
            whole = [sum(c[k] for c in marks.values()) for k in (0, 1)]
            for mark, c in marks.items():
                rates[j, mark] = [c[0] / whole[0], c[1] / whole[1]]
        belief = []
        for kind, v, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(rates[j, m][0] / rates[j, m][1]) for j, m in enumerate(v[:n_votes]))
            belief.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
    return belief, rates


def features(kind: int, votes: str) -> list[str]:
    """Of the span's kind, each labeler's vote, both together, and the span's shape within its kind."""
    n = len(LABELERS)
    return ["bias", f"k{kind}", *(f"{j}{m}" for j, m in enumerate(votes[:n])), *(f"k{kind}{j}{m}" for j, m in enumerate(votes))]


def train(patterns: Sequence[tuple[int, str, float]]) -> dict[str, float]:
    """Weights of a logistic classifier of spans, fitted to the soft labels of all patterns by the roots of their counts,
    so that a frequent pattern doesn't drown the others."""
    import numpy as np

    belief = np.array(reliabilities(patterns)[0])
    names = sorted({x for kind, v, _ in patterns for x in features(kind, v)})
    at = {x: k for k, x in enumerate(names)}
    m = np.zeros((len(patterns), len(names)))
    for row, (kind, v, _) in enumerate(patterns):
        m[row, [at[x] for x in features(kind, v)]] = 1.0
    weight = np.sqrt(np.array([n for _, _, n in patterns], float))
    weight = weight / max(weight.sum(), 1e-12)
    w = np.zeros(len(names))
    for _ in range(STEPS):
        w += RATE * (m.T @ (weight * (belief - 1 / (1 + np.exp(-(m @ w))))))
    return dict(zip(names, w.tolist(), strict=True))


def probability(weights: dict[str, float], kind: int, votes: str) -> float:
    return 1 / (1 + math.exp(-sum(weights.get(x, 0.0) for x in features(kind, votes))))


def _found(docs: DataFrame, text: str, row: Column) -> DataFrame:
    """(row, spans) of each of ``docs``: ``row`` as given, and the spans that are kept."""
    found = materialize(docs.select(row.alias("row"), candidates(F.coalesce(F.col(text), F.lit(""))).alias("spans")), "candidates")
    counts = found.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.votes").agg(F.count("*").alias("n"))
    # at most 9 kinds, 3^4 votes and 5 * 4 * 5 shapes
    patterns = sorted((r["kind"], r["votes"], r["n"]) for r in counts.collect())
    weights = train(patterns) if patterns else {}
    named = [f"{k}{v}" for k, v, _ in patterns if probability(weights, k, v) >= KEEP]
    kept = F.filter("spans", lambda x: (x["loose"] == 0) | F.concat(x["kind"].cast("string"), x["votes"]).isin(named))
    return found.select("row", F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), (x["loose"] == 0).alias("base")))).alias("spans"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``spans``: array<struct<kind int, start int, stop int, base boolean>>, by kind, then start.

    Base spans always stay; of the further ones those that the classifier gives a probability of ``KEEP`` or more. A null
    or empty text has no spans; one of any length is read whole. Of looser writings that overlap, the leftmost stands. Repeated rows stay, each counted. A column ``spans`` is replaced, others keep names and values.
    """
    other = [c for c in docs.columns if c not in (text, "spans")]
    found = _found(docs, text, F.struct(*[F.col(f"`{c}`") for c in other]) if other else F.lit(0))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in other], "spans")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS) if kind in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets; ``n_chars``, if there is one, counts anew.

    Of spans that overlap, all that any of them covers goes, under the kind of the first. Rows and columns stay, whatever
    the columns' names. A null or empty text stays as it is; one of any length is masked whole.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    found = _found(docs, "text", F.struct("*"))
    text = F.col("row.text")
    places = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.get(names, x["kind"])))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    new = found.withColumn("new", F.when(F.size("spans") > 0, F.aggregate(places, first, step, end)).otherwise(text))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("spans") > 0, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return new.select(*[c.alias(n) for n, c in out.items()])
