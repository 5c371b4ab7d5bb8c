"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame functions only.

An item's windows are its runs of 13 words (all its words, if fewer). A document contains a window only if it
contains every shingle of it, so one necessary shingle, the window's rarest in the whole corpus, is its join prefix.
The shingles of all documents are looked up once and what the benchmark knows is staged with its position; counting
that gives the rarity. A prefix hit fixes the window's only possible start, the bounds of the document must allow it,
and the words there are then compared one by one with the window's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import fold_case, free_name, spread_join, staged, text_hash

WINDOW, SHINGLE = 13, 4
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased: runs of digits, letters a-z and non-ASCII characters."""
    return F.array_remove(F.split(fold_case(F.coalesce(text, F.lit(""))), _BREAK), "")


def shingles(tokens: Column, size: int) -> Column:
    """Hash of every run of ``size`` words, in order; no entry where fewer words are left."""
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(size)]))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, win, len, win_words``: each item's distinct windows. A null item id is the empty name."""
    rows = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")
    ).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win_words"))
    return rows.select(
        "item", F.sha2(F.concat_ws(" ", "win_words"), 256).alias("win"), F.size("win_words").alias("len"), "win_words"
    ).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A document word inside any occurrence of an item window is hit; a document is contaminated if at least one word
    and a twentieth of its words are hit. Null and wordless texts have no words, no hits and the digest of the empty
    list. Items without words have no windows. Repeated rows, ids and items are allowed, other columns are not read.
    """
    return verdicts(docs, items, window, shingle).drop("th")


def verdicts(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``contamination`` with ``th``, the hash of the row's text: rows that share an id differ by it."""
    wins = staged(benchmark_windows(items, window), "decontam-windows")
    distinct_wins = wins.select("win", "len", "win_words").dropDuplicates(["win"])
    # A window shorter than a shingle is looked up by all its words: at most `shingle` sizes exist.
    sizes = sorted(r["k"] for r in wins.select(F.least("len", F.lit(shingle)).alias("k")).distinct().collect()) or [shingle]
    per_win = reduce(
        DataFrame.unionByName,
        [
            distinct_wins.where(F.least("len", F.lit(shingle)) == k).select(
                "win", "len", "win_words", F.posexplode(shingles(F.col("win_words"), k)).alias("at", "h"), F.lit(k).alias("k")
            )
            for k in sizes
        ],
    )
    known = per_win.select(F.col("h").alias("kh"), F.col("k").alias("kk")).distinct()

    base = docs.select(F.col("doc_id"), F.col("text"), text_hash(F.col("text")).alias("th"))
    tokens = base.select("doc_id", "th", words(F.col("text")).alias("w"))
    tokens = tokens.select("doc_id", "th", F.size("w").alias("n_words"), *[shingles(F.col("w"), k).alias(f"s{k}") for k in sizes])
    # Position -1 keeps every document; its shingle is null and joins with nothing.
    listed = []
    for n, k in enumerate(sizes):
        row = F.concat(F.array(F.lit(None).cast("long")), F.col(f"s{k}"))
        part = tokens.select("doc_id", "th", "n_words", F.lit(k).alias("k"), F.posexplode(row).alias("p", "h"))
        listed.append(part if n == 0 else part.where("p > 0"))
    looked = reduce(DataFrame.unionByName, listed)
    looked = looked.join(known, (looked["h"] == known["kh"]) & (looked["k"] == known["kk"]), "left")
    looked = looked.where("p = 0 OR kh IS NOT NULL").select("doc_id", "th", "n_words", "k", (F.col("p") - 1).alias("pos"), "h")
    looked = staged(looked, "decontam-shingles")
    hits = looked.where("pos >= 0")

    # Rarity over all documents orders the shingles; the rarest is the necessary prefix of its window.
    rarity = hits.groupBy("h", "k").agg(F.count(F.lit(1)).alias("freq"))
    ranked = per_win.join(rarity, ["h", "k"], "left")
    prefix = ranked.groupBy("win", "len", "k").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "h", "at")).alias("rarest"),
    ).where("rarest.freq > 0").select("win", "len", "k", F.col("rarest.h").alias("h"), F.col("rarest.at").alias("at"))
    # Windows that share a prefix shingle travel as one row, so the join key is unique on this side.
    prefix = prefix.groupBy("h", "k").agg(F.collect_list(F.struct("win", "len", "at")).alias("wins"))
    found = spread_join(hits, prefix, ["h", "k"], F.xxhash64("doc_id", "pos"), "inner")
    found = found.select("doc_id", "th", "n_words", "pos", F.explode("wins").alias("c")).select(
        "doc_id", "th", "n_words", F.col("c.win").alias("win"), F.col("c.len").alias("len"),
        (F.col("pos") - F.col("c.at")).alias("start"),
    )
    found = found.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))).distinct()
    found = spread_join(found, distinct_wins.select("win", "win_words"), ["win"], F.xxhash64("doc_id", "start"), "inner")
    cands = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "len", "win", "win_words")).alias("cands"))

    # Verification: the words at the start must be the window's words. Repeated rows are compared each and united after
    # it, when their texts, which would be shuffled for that, are gone.
    text = base.join(cands.withColumnsRenamed({"doc_id": "cd", "th": "ct"}), base["doc_id"].eqNullSafe(F.col("cd")) & (base["th"] == F.col("ct")))
    text = text.select("doc_id", "th", words(F.col("text")).alias("w"), "cands")
    true = text.select(
        "doc_id", "th",
        F.filter("cands", lambda c: F.slice(F.col("w"), c["start"] + 1, c["len"]) == c["win_words"]).alias("found"),
    ).where(F.size("found") > 0).dropDuplicates(["doc_id", "th"])
    true = staged(true.select("doc_id", "th", F.transform("found", lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["len"]).alias("stop"), c["win"].alias("win"))).alias("found")), "decontam-found")

    spans = F.array_sort(F.array_distinct(F.transform("found", lambda c: F.struct(c["start"], c["stop"]))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], s["stop"]).alias("end"),
        ),
        lambda a: a["n"].cast("long"),
    )
    hit = true.select("doc_id", "th", covered.alias("n_hit"))
    per_doc = true.select("doc_id", "th", F.explode(F.array_distinct(F.transform("found", lambda c: c["win"]))).alias("win"))
    names = wins.groupBy("win").agg(F.collect_set("item").alias("items"))
    listing = spread_join(per_doc, names, ["win"], F.xxhash64("doc_id", "th"), "inner")
    listing = listing.select("doc_id", "th", F.explode("items").alias("item")).groupBy("doc_id", "th").agg(F.collect_set("item").alias("items"))
    facts = hit.join(
        listing.select(F.col("doc_id").alias("ld"), F.col("th").alias("lt"), "items"),
        hit["doc_id"].eqNullSafe(F.col("ld")) & (hit["th"] == F.col("lt")),
    ).select(F.col("doc_id").alias("fd"), F.col("th").alias("ft"), "n_hit", "items")
    every = looked.where("pos = -1").select("doc_id", "th", F.col("n_words").cast("long").alias("n_words"))
    out = every.join(facts, every["doc_id"].eqNullSafe(F.col("fd")) & (every["th"] == F.col("ft")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "th", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.coalesce("items", F.array().cast("array<string>")))), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with all their columns."""
    # Equal rows have equal verdicts, so the verdict follows id and text.
    bad = verdicts(docs, items).where("contaminated").select(F.col("doc_id").alias("bd"), F.col("th").alias("bt")).distinct()
    th = free_name(docs, "th_")
    rows = docs.withColumn(th, text_hash(F.col("text")))
    return rows.join(bad, rows["doc_id"].eqNullSafe(F.col("bd")) & (rows[th] == F.col("bt")), "left_anti").drop(th)
