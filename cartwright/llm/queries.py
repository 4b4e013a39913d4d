"""The operators as queries over the test tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.llm import (
    clustering,
    exact_dedup,
    line_dedup,
    manifest,
    near_dedup,
    packing,
    pieces,
    quality_rules,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
    warc,
)
from cartwright.llm.common import table, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


@query("op1_weighted_minhash")
def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, size=5)


@query("op2_sum_of_squares_packing")
def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@query("op3_classifier_chain")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxic_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rows=toxicity.TRAINING_ROWS
    )
    return scored.select("doc_id", *[f"p_{c}" for c in toxicity.CATEGORIES], "rejected")


@query(
    "op4_line_dedup",
    r"""
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
      FROM documents
    ), k AS (
      SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l
    ), g AS (
      SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k
    )
    SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM g GROUP BY doc_id
    """,
)
def documents_without_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op5_rule_ledger",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents
    ), w AS (
      SELECT doc_id, i, CASE WHEN i + 4 <= len(words) THEN words[i:i + 4] END AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)
    ), r AS (
      SELECT *, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS again FROM w
    ), c AS (
      SELECT doc_id, count_if(again) OVER (
               PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0 AS covered
      FROM r
    ), n AS (SELECT doc_id, count_if(covered) AS n_repeat_words FROM c GROUP BY doc_id),
    m AS (
      SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN n USING (doc_id)
    ), b AS (
      SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
             + 4 * (100 * n_symbols > 20 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
             + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT AS fail_bits
      FROM m
    )
    SELECT *, fail_bits = 0 AS kept FROM b
    """,
)
def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.passes("base")
    return rows.select(
        "doc_id", *quality_rules.MEASUREMENTS, (~base).alias("base_failed"), "fail_bits",
        (base & quality_rules.passes(quality_rules.CURRENT)).alias("kept"),
    )


@query("op6_merge_dropout")
def piece_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    both = pieces.decode(pieces.encode(docs, PIECE_BPE, dropout=0.1, seed=20), PIECE_BPE)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"),
        pieces.lossless().alias("lossless"),
    )


@query("op7_merkle_audit")
def audited_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    damage = F.pmod(F.xxhash64("page_id", "url"), F.lit(500)) == 0
    return warc.audited_pages(table(spark, sf_dir, "pages"), damage)


@query("op8_token_counts")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query(
    "op9_substring_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), w AS (
      SELECT doc_id, i, words[i] AS word,
             CASE WHEN i + 19 <= len(words) THEN array_to_string(words[i:i + 19], ' ') END AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)
    ), f AS (
      SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS later
      FROM w
    ), c AS (
      SELECT *, count_if(later) OVER (
               PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
      FROM f
    ), k AS (
      SELECT doc_id, count(*) AS n_words, count_if(gone)::BIGINT AS n_removed,
             string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
      FROM c GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def documents_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op10_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
           count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d
    """,
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_ledger(table(spark, sf_dir, "documents"))


@query(
    "op11_bitmap_rank_manifest",
    r"""
    WITH RECURSIVE d AS (
      SELECT *, list_reduce(  -- CRC-32 by bits: the low bit of the complement
               list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                     lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) % 2 AS odd
      FROM documents
    ), f AS (
      SELECT doc_id, source,
             coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-')
             || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
             text, CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END AS found
      FROM d
    ), leaf AS (
      SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
             sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS tampered,
             row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
      FROM f
    ), up AS (
      SELECT 0 AS lvl, source, i, h, n FROM leaf
      UNION ALL
      SELECT lvl + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
      FROM up WHERE n > 1 GROUP BY lvl, source, i // 3, n
    ), subroots AS (
      SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
      FROM up WHERE n = 1
    ), top AS (
      SELECT 0 AS lvl, i, h, n FROM subroots
      UNION ALL
      SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
      FROM top WHERE n > 1 GROUP BY lvl, i // 3, n
    ), steps AS (
      SELECT leaf.doc_id, up.lvl AS step, up.i < leaf.i // (3 ** up.lvl)::BIGINT AS is_left, up.i AS place, up.h,
             up.i = leaf.i // (3 ** up.lvl)::BIGINT AS own
      FROM leaf JOIN up ON leaf.source IS NOT DISTINCT FROM up.source AND up.n > 1
       AND up.i // 3 = leaf.i // (3 ** (up.lvl + 1))::BIGINT
      UNION ALL
      SELECT leaf.doc_id, 1000 + top.lvl, top.i < s.i // (3 ** top.lvl)::BIGINT, top.i, top.h,
             top.i = s.i // (3 ** top.lvl)::BIGINT
      FROM leaf JOIN subroots s ON leaf.source IS NOT DISTINCT FROM s.source
      JOIN top ON top.n > 1 AND top.i // 3 = s.i // (3 ** (top.lvl + 1))::BIGINT
    ), sides AS (
      SELECT doc_id, step, coalesce(string_agg(h, '' ORDER BY place) FILTER (is_left), '') AS l,
             coalesce(string_agg(h, '' ORDER BY place) FILTER (NOT is_left AND NOT own), '') AS r
      FROM steps GROUP BY doc_id, step
    ), paths AS (
      SELECT doc_id, string_agg(l || r, '' ORDER BY step) AS proof, list(l || ',' || r ORDER BY step) AS folds
      FROM sides GROUP BY doc_id
    ), folded AS (
      SELECT leaf.doc_id, leaf.h AS leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
             sha256(coalesce(proof, '')) AS proof_sha256,
             list_reduce(list_prepend(tampered, coalesce(folds, [])),
                         lambda h, x: sha256(split_part(x, ',', 1) || h || split_part(x, ',', 2))) AS folded_root
      FROM leaf JOIN subroots s ON leaf.source IS NOT DISTINCT FROM s.source LEFT JOIN paths USING (doc_id)
    )
    SELECT *, folded_root = root AS verified FROM folded
    """,
)
def document_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    rows = manifest.audited(table(spark, sf_dir, "documents"), F.coalesce(found, "text"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_virtual_slots")
def document_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = f"{work_folder(spark)}/slot-map-{uuid4().hex}"
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=8, path=maps)


#: A round in SQL: all distances, the nearest centroid (ties: the smaller one), means rounded down.
_ROUND = """
, a{k} AS (
  SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best
  FROM (SELECT vec_id, kept.v, c, list_sum(list_transform(list_zip(kept.v, c{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM kept, c{k}) GROUP BY vec_id
), m{k} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v
  FROM (SELECT best.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{k}, range(1, 65) r(j) GROUP BY best.c, j) GROUP BY c
), c{next} AS (SELECT c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))
"""


@query(
    "op13_ptolemaic_clusters",
    """
    WITH kept AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    ), c0 AS (
      SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept
      QUALIFY c < 8
    )"""
    + "".join(_ROUND.format(k=k, next=k + 1) for k in range(11))
    + """
    , t AS (SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance FROM a10)
    SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
           sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
    FROM t JOIN c10 ON c10.c = cluster
    """,
)
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10)
