"""How two spellings of a name differ, study rules that could link them, and scans of text for what must not be said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.names import fold_name, legal_form, normalize_name, tokens, with_suffix
from lodestrand.functions.similarity import acronym, ordered_prefix, script_of

#: Wordings of contact, cause and certainty that an answer may only repeat from its evidence.
BANNED = [
    "met with", "meeting with", "met in person", "were together", "was together", "in person with", "physically present with",
    "made contact", "in contact with", "face to face", "caused", "because of", "as a result of", "led to", "proves", "proven",
    "establishes that", "beyond doubt", "undoubtedly", "certainly", "definitely",
]
#: Shapes of what an answer may only repeat: case identifiers, phones, case numbers, dates, ids, proper names.
LITERALS = {
    "identifier": r"\bSYN-[A-Z]+-[0-9]+\b",
    "phone": r"\+[0-9][0-9 ]{6,}[0-9]\b",
    "case_number": r"\b[A-Z]{2,}/SYN/[0-9]{4}/[0-9]+\b",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "id": r"\b(?:entity|evidence_item|extracted_record|relationship|analytical_signal|corroboration_finding|location|investigation)_[0-9a-f]{8,}\b",
    "name": r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})+\b",
}
#: Terms of this engine that an answer may always use.
VOCABULARY = ["observed fact", "corroborated fact", "algorithmic signal", "ai inference", "investigative lead", "graph synthesis", "entity resolution", "topology analytics", "spatial temporal corroboration", "call detail record", "call detail records", "insufficient evidence", "no direct"]
#: Devanagari letters, with and without nukta, vowels and vowel signs as Latin.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ळ": "l",
}
WITH_NUKTA = {"क": "q", "ख": "kh", "ग": "gh", "ज": "z", "ड": "r", "ढ": "rh", "फ": "f", "य": "y"}
VOWELS = {"अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऍ": "e", "ऑ": "o"}
SIGNS = {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॅ": "e", "ॉ": "o"}
NUKTA, VIRAMA, NASALS = "\u093c", "\u094d", "\u0902\u0901"


def variation(a: Column, b: Column) -> Column:
    """identical, case_only, transliteration, suffix, name_order, abbreviation or divergent: the first that applies."""
    ta, tb = tokens(normalize_name(a)), tokens(normalize_name(b))
    short = lambda x, y: (F.size(y) == 1) & (acronym(x) != "") & (acronym(x) == F.get(y, 0))
    return (
        F.when(a == b, "identical").when(F.lower(F.trim(a)) == F.lower(F.trim(b)), "case_only").when((script_of(a) != script_of(b)) & (script_of(a) != "unknown") & (script_of(b) != "unknown"), "transliteration")
        .when(normalize_name(a) == normalize_name(b), "suffix").when((F.array_sort(ta) == F.array_sort(tb)), "name_order")
        .when(short(ta, tb) | short(tb, ta) | ordered_prefix(ta, tb), "abbreviation").otherwise("divergent")
    )


def study_rules(a: Column, b: Column, places: list[str]) -> Column:
    """Names of optional rules that would link ``a`` and ``b``. They are measured, not applied."""
    strip_article = lambda x: F.regexp_replace(normalize_name(x), "^the ", "")
    strip_place = lambda x: F.regexp_replace(normalize_name(x), rf"^(.+?) (?:{'|'.join(places)})$", "$1") if places else normalize_name(x)
    ta, tb = tokens(normalize_name(a)), tokens(normalize_name(b))
    subset = (F.size(ta) > 1) & (F.size(tb) > 1) & ((F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0))
    rules = [("dotted_form", F.replace(fold_name(a), F.lit(" "), F.lit("")) == F.replace(fold_name(b), F.lit(" "), F.lit(""))), ("leading_article", strip_article(a) == strip_article(b)), ("prefix", ordered_prefix(ta, tb)), ("subset", subset), ("trailing_place", strip_place(a) == strip_place(b))]
    return F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules]), lambda x: x.isNotNull())


def suffix_only(a: Column, b: Column) -> Column:
    """Whether two names differ in their legal form alone."""
    return (normalize_name(a) == normalize_name(b)) & (with_suffix(a) != with_suffix(b)) & ~(legal_form(a).eqNullSafe(legal_form(b)))


def latin(x: Column, medial: bool = False) -> Column:
    """Devanagari letters as Latin; other characters stay.

    A consonant has an inherent a unless a vowel sign or a virama follows. That of a word's last consonant is silent, with
    ``medial`` also one between two syllables that keep their vowels. A nasal sign is n, and ai before one is a.
    """
    held = "\ue000"  # an inherent a whose fate is open
    for composed, letter in (("\u0958", "क"), ("\u0959", "ख"), ("\u095a", "ग"), ("\u095b", "ज"), ("\u095c", "ड"), ("\u095d", "ढ"), ("\u095e", "फ"), ("\u095f", "य")):
        x = F.replace(x, F.lit(composed), F.lit(letter + NUKTA))
    x = F.regexp_replace(x, f"[ैऐ](?=[{NASALS}])", "ॲ")
    follow = f"[{''.join(SIGNS)}ॲ{VIRAMA}]"
    for table, mark in ((WITH_NUKTA, NUKTA), (CONSONANTS, "")):
        for letter, name in table.items():
            x = F.regexp_replace(F.regexp_replace(x, f"{letter}{mark}(?={follow})", name), f"{letter}{mark}", name + held)
    x = F.regexp_replace(x, f"{held}(?=[{NASALS}])", "a")
    for letter, name in {**VOWELS, **SIGNS, "ॲ": "a", VIRAMA: "", NUKTA: "", "ः": "", **dict.fromkeys(NASALS, "n")}.items():
        x = F.replace(x, F.lit(letter), F.lit(name))
    x = F.regexp_replace(x, rf"{held}(?![\p{{L}}\p{{M}}{held}])", "")
    if medial:
        # from left to right, so that a vowel which falls silent no longer bears the next one
        x = F.regexp_replace(x, rf"([aeiou{held}][b-df-hj-np-tv-z]+){held}(?=[b-df-hj-np-tv-z]+[aeiou{held}])", "$1")
    return F.replace(x, F.lit(held), F.lit("a"))


def _flat(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"\s+", " ")


def banned_phrases(text: Column, support: Column | None = None) -> Column:
    """Wordings in ``text`` that evidence cannot carry, unless ``support`` (what sources said) has them."""
    said = lambda p: F.contains(F.lower(text), F.lit(p)) & (F.lit(True) if support is None else ~F.coalesce(F.contains(F.lower(support), F.lit(p)), F.lit(False)))
    return F.filter(F.array(*[F.when(said(p), F.lit(p)) for p in BANNED]), lambda x: x.isNotNull())


def unsupported(text: Column, support: Column) -> Column:
    """Identifiers, phones, dates, ids and proper names in ``text`` that neither ``support`` nor the vocabulary holds."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in LITERALS.values()])
    known = F.concat(_flat(F.coalesce(support, F.lit(""))), F.lit(" \n " + " \n ".join(VOCABULARY)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: ~F.contains(known, _flat(x)))))
