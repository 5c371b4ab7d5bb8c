"""Entity identity: the tokens, identifier, match and score of an agency or supplier name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlake.functions.text import (
    _col, blank_to_null, empty_to_null, loose_text, partition_key, safe_key, strip, words,
)

# Fixed values.
TOKEN_ALIASES = {
    "dept": "department",
    "depts": "department",
    "govt": "government",
    "svc": "services",
    "svcs": "services",
    "tech": "technology",
}
COMMON_WORDS = ("the", "of", "and", "for", "to")
COMPANY_WORDS = (
    "pty", "ltd", "limited", "proprietary", "inc", "llc", "plc", "corp", "corporation",
)


def _filler(kind: str) -> str:
    """Pattern of the words to drop from single-spaced text.

    A company loses its legal form only next to another word, so "Limited" alone keeps its name.
    """
    pattern = rf"\b(?:{'|'.join(COMMON_WORDS)})\b"
    if kind == "company":
        legal = "|".join(COMPANY_WORDS)
        pattern += rf"|(?<= )(?:{legal})\b|\b(?:{legal})(?= )"
    return pattern


def entity_tokens(kind: str, c: Column | str) -> Column:
    """Distinct name tokens in order, with abbreviations expanded and filler words dropped.

    A name made only of filler words falls back to the parts of its key.
    """
    value = F.lower(F.coalesce(_col(c), F.lit("")))
    for sign, word in (("&", " and "), ("@", " at ")):
        value = F.replace(value, F.lit(sign), F.lit(word))
    text = F.regexp_replace(loose_text(value), _filler(kind), "")
    for target in dict.fromkeys(TOKEN_ALIASES.values()):
        short = "|".join(a for a, t in TOKEN_ALIASES.items() if t == target)
        text = F.regexp_replace(text, rf"\b(?:{short})\b", target)
    parts = F.regexp_replace(safe_key(value), "[_-]+", " ")
    return F.array_distinct(words(F.coalesce(empty_to_null(F.trim(text)), parts)))


def entity_identifier(kind: str, c: Column | str) -> Column:
    """Sorted tokens joined by underscores; a name without tokens gives its key, maybe empty."""
    joined = F.array_join(F.sort_array(entity_tokens(kind, c)), "_")
    return F.coalesce(empty_to_null(joined), safe_key(c))


def resolve_entity(kind: str, name: Column | str, key: Column | str) -> Column:
    """struct(name, key, identifier, tokens) from a display name and a stored key, either missing."""
    shown, stored = blank_to_null(name), blank_to_null(key)
    base = F.coalesce(shown, stored, F.lit(""))
    final_key = F.coalesce(stored, empty_to_null(safe_key(base)))
    return F.struct(
        F.coalesce(shown, final_key).alias("name"),
        final_key.alias("key"),
        entity_identifier(kind, base).alias("identifier"),
        entity_tokens(kind, base).alias("tokens"),
    )


@dataclass(frozen=True)
class EntityQuery:
    """The query side of a match: columns of a table of queries, or folded literals."""

    lower: Column
    key: Column
    identifier: Column
    tokens: Column

    @classmethod
    def of(cls, kind: str, text: Column | str) -> EntityQuery:
        text = F.lit(text) if isinstance(text, str) else text
        # A text without usable characters has no query key, so it never matches "unknown".
        return cls(
            lower=F.lower(strip(text)),
            key=empty_to_null(safe_key(text)),
            identifier=empty_to_null(entity_identifier(kind, text)),
            tokens=entity_tokens(kind, text),
        )

    @classmethod
    def from_struct(cls, query: Column) -> EntityQuery:
        return cls(query["lower"], query["key"], query["identifier"], query["tokens"])

    def to_struct(self) -> Column:
        return F.struct(
            self.lower.alias("lower"),
            self.key.alias("key"),
            self.identifier.alias("identifier"),
            self.tokens.alias("tokens"),
        )

    def _all_tokens(self, entity: Column) -> Column:
        missing = F.size(F.array_except(self.tokens, entity["tokens"]))
        return (F.size(self.tokens) > 0) & (F.size(entity["tokens"]) > 0) & (missing == 0)

    def matches(self, entity: Column) -> Column:
        def known(test: Column) -> Column:
            return F.coalesce(test, F.lit(False))

        return (
            (self.lower == "")
            | known(F.contains(F.lower(entity["name"]), self.lower))
            | known(F.contains(entity["key"], self.key))
            | known(self._all_tokens(entity))
            | known(self.identifier == entity["identifier"])
        )

    def score(self, entity: Column) -> Column:
        display = F.lower(strip(entity["name"]))
        shared = F.size(F.array_intersect(self.tokens, entity["tokens"]))
        by_id = F.when(self.identifier == entity["identifier"], 1000)
        by_name = F.when(display == self.lower, 300).when(F.contains(display, self.lower), 120)
        by_key = F.when(entity["key"] == self.key, 180).when(F.contains(entity["key"], self.key), 80)
        by_token = F.when(self._all_tokens(entity), 200 + shared * 10).otherwise(shared * 5)
        parts = [F.coalesce(p, F.lit(0)) for p in (by_id, by_name, by_key, by_token)]
        total = parts[0] + parts[1] + parts[2] + parts[3]
        return F.when(self.lower == "", 0).otherwise(total).cast("int")


def name_rank(name: Column) -> Column:
    """Sort key whose smallest value is the name to show: real before key-like, then longest."""
    key_like = (name == partition_key(name)) & ~F.contains(name, F.lit(" "))
    return F.struct(key_like.alias("key_like"), (-F.octet_length(name)).alias("short"), name.alias("name"))


def preferred_name(name: Column | str) -> Column:
    """Aggregate: the best display name of a group, whatever the row order."""
    shown = blank_to_null(name)
    return F.min(F.when(shown.isNotNull(), name_rank(shown)))["name"]
