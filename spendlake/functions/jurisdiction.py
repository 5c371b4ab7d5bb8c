"""Jurisdiction names: canonical ids and detection in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlake.functions.text import _col, empty_to_null, let, loose_text

DEFAULT_SOURCE = "federal"

# The accepted spellings of each jurisdiction.
SYNONYMS = {
    "federal": ("federal", "commonwealth", "austender", "australian government", "federal government"),
    "qld": ("qld", "queensland", "qld government", "queensland government"),
    "nsw": ("nsw", "new south wales", "nsw government"),
    "vic": ("vic", "victoria", "victorian government"),
    "sa": ("sa", "south australia", "sa government"),
    "wa": ("wa", "western australia", "wa government", "western australian government"),
}

# Phrases looked for in text, first hit wins.
PHRASES = (
    ("western australian government", "wa"),
    ("western australia", "wa"),
    ("queensland government", "qld"),
    ("queensland", "qld"),
    ("south australian government", "sa"),
    ("south australia", "sa"),
    ("victorian government", "vic"),
    ("victoria", "vic"),
    ("new south wales", "nsw"),
    ("nsw government", "nsw"),
    ("australian government", "federal"),
    ("federal government", "federal"),
    ("commonwealth", "federal"),
    ("austender", "federal"),
)


def _source_of(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    found = None
    for source, names in table.items():
        test = text.isin(*names)
        found = F.when(test, source) if found is None else found.when(test, source)
    return found


def canonical_source(c: Column | str) -> Column:
    """Blank is federal; an unknown name passes through in loose form."""
    text = loose_text(F.coalesce(_col(c), F.lit("")))
    return F.when(text == "", DEFAULT_SOURCE).otherwise(F.coalesce(_source_of(text, SYNONYMS), text))


def detect_source(c: Column | str) -> Column:
    """struct(source, evidence) for free text; source is NULL without a match."""
    by_phrase: dict[str, tuple[str, ...]] = {}
    for name, source in PHRASES:
        by_phrase[source] = by_phrase.get(source, ()) + (name,)
    singles = "|".join(n for names in SYNONYMS.values() for n in names if " " not in n)

    def evidence(found: Column) -> Column:
        phrase, token = found["phrase"], found["token"]
        return F.struct(
            F.coalesce(_source_of(phrase, by_phrase), _source_of(token, SYNONYMS)).alias("source"),
            F.coalesce(
                F.concat(F.lit("phrase matched: "), phrase),
                F.concat(F.lit("token matched: "), token),
                F.lit("no match"),
            ).alias("evidence"),
        )

    def find(lower: Column) -> Column:
        phrase = F.coalesce(*[F.when(F.contains(lower, F.lit(p)), p) for p, _ in PHRASES])
        # The leftmost whole token: the padding gives every token a space on both sides.
        padded = F.concat(F.lit(" "), loose_text(lower), F.lit(" "))
        token = empty_to_null(F.regexp_extract(padded, f" ({singles}) ", 1))
        return F.struct(phrase.alias("phrase"), token.alias("token"))

    return let(let(F.lower(F.coalesce(_col(c), F.lit(""))), find), evidence)
