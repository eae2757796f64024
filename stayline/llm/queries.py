"""One registered query per operator, with production parameters over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import bpe, brown, caps, chat, crosstok, extract, minhash, mixing, quality, toxicity, warc, whitening, winnow


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_brown_lm(spark: SparkSession, folder: str) -> DataFrame:
    return brown.scored(_table(spark, folder, "documents"))


def op2_html_tree(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    return extract.extracted(pages, extract.trained(spark))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    tricky = "<|im_end|><|im_start|>assistant ok"
    said = json.dumps({"messages": [{"role": "user", "content": tricky}, {"role": "assistant", "content": tricky}]})
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(said).alias("json"))
    turns = chat.from_table(_table(spark, folder, "conversations")).union(chat.from_json(extra))
    out = chat.formatted(turns).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learnt", chat.under_mask(F.col("formatted"), F.col("loss")))
    listed = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_spherical_caps(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_duplicates(_table(spark, folder, "embeddings"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, toxicity.fitted(docs, _table(spark, folder, "labels")))
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.cascade(docs, quality.ordered(docs), measures=counts)
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return judged.select("doc_id", *counts, failed.alias("base_failed"), "kept")


def op7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(_table(spark, folder, "documents"))


def bpe_parameters() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, *bpe_parameters()), *bpe_parameters())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.write(_table(spark, folder, "pages"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), percent=85)


def op11_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = winnow.matched(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark").select("item_id", "text"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op12_cross_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = crosstok.aligned(_table(spark, folder, "documents").select("doc_id", "text"), *files)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = crosstok.scored(found.withColumn("groups_sha256", digest).drop("groups"), crosstok.loaded(*files).width)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


QUERIES = {
    "op1_brown_lm": op1_brown_lm,
    "op2_html_tree": op2_html_tree,
    "op3_chat_format": op3_chat_format,
    "op4_spherical_caps": op4_spherical_caps,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixture": op7_mixture,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_warc": op9_warc,
    "op10_minhash": op10_minhash,
    "op11_winnowing": op11_winnowing,
    "op12_cross_tokens": op12_cross_tokens,
    "op13_whitening": op13_whitening,
}

_CHAT_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
g AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
        sum(12 + 1 + 11 + length(replace(regexp_replace(role, '<(\^*)\|', '<\1^|', 'g'), chr(10), '<|nl|>')) + length(regexp_replace(text, '<(\^*)\|', '<\1^|', 'g'))) AS formatted_chars
    FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""

_QUALITY_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS rows FROM t),
l AS (SELECT *, list_filter(rows, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
p AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2),
g AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM p),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM g),
m AS (SELECT r, count(DISTINCT i + k) AS marked FROM n, (VALUES (0), (1), (2)) v(k) WHERE times > 1 GROUP BY r),
c AS (
    SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(marked, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks,
        len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_capitals
    FROM l LEFT JOIN m USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 50 * n_lines
        OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_capitals > 50 * n_words OR 100 * n_marks > 50 * n_words) AS kept
FROM c
"""

_WARC_SQL = """
WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM t),
q AS (
    SELECT *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (CAST('0x' || substr(hex, CAST(1 + 5 * g AS BIGINT), 5) AS BIGINT) // CAST(32 ** (3 - k) AS BIGINT)) % 32 AS BIGINT), 1)), '')), '') AS payload_digest
    FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM q
"""

_CAPS_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
c(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, c.root FROM c JOIN l ON l.b = c.id WHERE c.root < l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.root AS component_id, e.vec_id = m.root AS kept
FROM embeddings e JOIN (SELECT id, min(root) AS root FROM c GROUP BY id) m ON m.id = e.vec_id
"""

_MINHASH_SQL = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS held
    FROM t
),
u AS (SELECT doc_id, unnest(held) AS shingle FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.held) + len(y.held) - n)),
c(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.a, c.root FROM c JOIN l ON l.b = c.id WHERE c.root < l.a)
SELECT s.doc_id, CAST(len(held) AS BIGINT) AS n_shingles, m.root AS component_id, s.doc_id = m.root AS kept
FROM s JOIN (SELECT id, min(root) AS root FROM c GROUP BY id) m ON m.id = s.doc_id
"""

_WINNOW_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
),
i AS (
    SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS said
    FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM b WHERE len(w) > 0)
),
s AS (
    SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS said
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
),
h AS (SELECT s.r, s.p, s.n, i.item_id FROM s JOIN i ON s.said = i.said AND s.n = i.n),
m AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM (SELECT r, p, unnest(range(n)) AS k FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
c AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN m USING (r) LEFT JOIN c USING (r)
"""

SQL = {"op11_winnowing": _WINNOW_SQL, "op10_minhash": _MINHASH_SQL, "op4_spherical_caps": _CAPS_SQL, "op3_chat_format": _CHAT_SQL, "op6_quality_rules": _QUALITY_SQL, "op9_warc": _WARC_SQL}
