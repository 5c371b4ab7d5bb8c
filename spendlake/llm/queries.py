"""Registered corpus queries and their expected results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlake.llm import chat, collisions, decontam, exact_dedup, feast, heap_kmeans, ngram_join, packing, quality_fm, suffix_dedup, toxicity, warc, wavelet
from spendlake.llm.common import scratch_path, table, tuned


def op7_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_adaptive_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents")))


def op8_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_wavelet_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_shards(table(spark, sf_dir, "documents"))


def op1_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op3_offset_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    out = scratch_path(spark, "chat")
    chat.formatted(turns.unionByName(extra)).write.parquet(out)
    return chat.digests(tuned(spark).read.parquet(out))


def op9_sparse_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(suffix_dedup.without_repeats(table(spark, sf_dir, "documents")))


def op11_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_kmeans.clusters(table(spark, sf_dir, "embeddings"))


def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feast.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op12_heap_kmeans": op12_heap_kmeans,
    "op13_feast_whitening": op13_feast_whitening,
    "op11_collision_counting": op11_collision_counting,
    "op9_sparse_prefix_doubling": op9_sparse_prefix_doubling,
    "op3_offset_chat_masks": op3_offset_chat_masks,
    "op1_warc_zstd": op1_warc_zstd,
    "op2_wavelet_token_shards": op2_wavelet_token_shards,
    "op10_toxicity_grammar": op10_toxicity_grammar,
    "op8_factorisation_quality": op8_factorisation_quality,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op4_adaptive_ngram_join": op4_adaptive_ngram_join,
    "op5_prefix_decontamination": op5_prefix_decontamination,
    "op7_grace_exact_dedup": op7_grace_exact_dedup,
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "regexp_extract_all(" + _FOLD + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# Base32 from hexadecimal: five digits are four letters.
_BASE32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || "
    "substr({0}, 1 + 5 * (i // 4), 5) AS INT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '')"
)

_ESCAPE = "replace(replace({}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: Centroids of round n, from the members that round n - 1 gave them; an empty one stays.
_ROUND = """
    near{n} AS MATERIALIZED (
        SELECT vec_id, arg_min(struct_pack(c := c, d := d), struct_pack(d := d, c := c)) AS best FROM (
            SELECT x.vec_id, m.c, CAST(sum((x.x - m.x) * (x.x - m.x)) AS BIGINT) AS d
            FROM comp x JOIN mid{n} m USING (i) GROUP BY x.vec_id, m.c) GROUP BY vec_id
    ), mid{m} AS MATERIALIZED (
        SELECT c, i, CAST(coalesce(f, x) AS BIGINT) AS x FROM mid{n} LEFT JOIN (
            SELECT best.c AS c, i, floor(sum(x) / count(*)) AS f FROM near{n} JOIN comp USING (vec_id) GROUP BY best.c, i) USING (c, i)
    )"""

SQL = {
    "op12_heap_kmeans": f"""
        WITH vec AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_USABLE} AND len(embedding) = 64
        ), comp AS MATERIALIZED (
            SELECT vec_id, i, CAST(floor(256 * v[i]) AS BIGINT) AS x FROM vec, unnest(range(1, 65)) AS u(i)
        ), start AS (
            SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM vec
        ), mid0 AS MATERIALIZED (SELECT c, i, x FROM start JOIN comp USING (vec_id) WHERE c < 40),
        {",".join(_ROUND.format(n=n, m=n + 1) for n in range(6))},
        digest AS (
            SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM mid5 GROUP BY c
        ), own AS (SELECT vec_id, best.c AS c, best.d AS distance FROM near5)
        SELECT vec_id, CAST(c AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM own JOIN digest USING (c)
    """,
    "op11_collision_counting": f"""
        WITH RECURSIVE vec AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id
            AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
        ), reach(a, b) AS (
            SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
               vec_id <= coalesce(low, vec_id) AS kept
        FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id)
        LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)
    """,
    "op3_offset_chat_masks": f"""
        WITH turn AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}) + 26) AS BIGINT) AS formatted_chars
        FROM turn GROUP BY conv_id
    """,
    "op1_warc_zstd": f"""
        WITH page AS (
            SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
        )
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32.format("sha1(h)")} AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM page
    """,
    "op4_adaptive_ngram_join": f"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), shingle AS (
            SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM doc, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i)
            WHERE len(w) > 0
        ), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id), pair AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM pair JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id
            WHERE 100 * c >= 75 * (x.n + y.n - c)
        ), reach(a, b) AS (
            SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
        FROM doc LEFT JOIN size USING (doc_id)
        LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
    """,
    "op5_prefix_decontamination": f"""
        WITH item AS (
            SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
        ), win AS (
            SELECT DISTINCT item, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS win
            FROM item, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i) WHERE len(w) > 0
        ), doc AS (
            SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
        ), size AS (SELECT DISTINCT n FROM win), run AS (
            SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
            FROM doc, size, unnest(range(1, len(w) - n + 2)) AS u(i)
        ), found AS (
            SELECT doc_id, item, i, run.n FROM run JOIN win ON run.n = win.n AND run.win = win.win
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM found, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
        ), listed AS (
            SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
            FROM found GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
    "op7_grace_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_FOLD.format("coalesce(text, '')")} AS t FROM documents)
        WINDOW same AS (PARTITION BY t)
    """,
}
