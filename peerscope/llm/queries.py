"""The registered queries of this package: every operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.llm import common, exact_dedup, infill, language, language_model, manifest, mixing, nearest, ngram_join, packing, piece_counts, sampled_pieces, substring_dedup, token_files
from peerscope.session import drop_at_exit, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    token_files.write_token_files(common.documents(spark, folder), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.documents_in(token_files.read_token_files(spark, drop_at_exit(spark, path)))


@query
def op2_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sampled_pieces.encode_sampled(common.documents(spark, folder), model)
    texts = sampled_pieces.decode(encoded.withColumn("n_pieces", F.size("ids").cast("long")), model)
    return texts.select("doc_id", "n_pieces", "ids_crc32", (F.crc32("text") == F.col("text_crc32")).alias("lossless"))


@query
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_components(common.documents(spark, folder))


@query
def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(common.documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(common.documents(spark, folder))


@query
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_spans(common.documents(spark, folder))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.documents(spark, folder)
    found = language.identify(docs, language.train(docs, ~common.held_out("doc_id", 4)))
    return found.select("doc_id", common.held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")


@query
def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    found = language_model.score(common.documents(spark, folder), ~common.held_out("doc_id", 7))
    return found.select("doc_id", common.held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_piece_counts(spark: SparkSession, folder: str) -> DataFrame:
    return piece_counts.piece_counts(common.documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_documents(common.documents(spark, folder))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = manifest.document_manifest(common.documents(spark, folder), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", manifest.siblings(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


@query
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = infill.fill_in_middle(common.documents(spark, folder))
    back = infill.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLES["op6_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

ORACLES["op11_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('11:' || coalesce(doc_id::VARCHAR, '')) AS shuffled FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS total, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, sum(2 * total) OVER w + 2 * total / weight * (sum(weight) OVER () - sum(weight) OVER w) <= 1.5 * sum(total) OVER () AS capped FROM s WHERE total > 0
  WINDOW w AS (ORDER BY 2 * total / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT (1.5 * sum(total) - coalesce(sum(2 * total) FILTER (capped), 0)) / nullif(sum(weight) FILTER (NOT capped), 0) AS level FROM c),
t AS (SELECT source, total, coalesce(least(weight * level, 2 * total), 2 * total) AS target FROM s, l),
p AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) AS past FROM d)
SELECT doc_id, size::BIGINT AS size, total::BIGINT AS source_size, target,
  (greatest(least(past, round(target)) - (past - size), 0) + greatest(least(past + total, round(target)) - (past + total - size), 0))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
ORACLES["op12_merkle_manifest"] = r"""
WITH RECURSIVE c AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS id FROM documents),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295, range(8 * len(id))), lambda x, j: xor(xor(x, CASE WHEN j % 8 = 0 THEN ascii(substr(id, j // 8 + 1, 1)) ELSE 0 END) >> 1,
  CASE WHEN xor(x, CASE WHEN j % 8 = 0 THEN ascii(substr(id, j // 8 + 1, 1)) ELSE 0 END) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS crc FROM c),
f AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS chars, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
  doc_id IS NOT NULL AND crc % 7 = 0 AS tampered, coalesce(strlen(text) || ':' || text, '-') AS body FROM k),
e AS (SELECT doc_id, g, sha256(head || chars || body) AS leaf, sha256(head || CASE WHEN tampered THEN more ELSE chars END || body) AS now FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM e),
tree AS (SELECT g, 0 AS level, place, n, leaf AS hash FROM l
  UNION ALL SELECT g, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY g, level, place // 2, (n + 1) // 2),
subs AS (SELECT g, hash, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, place, n, hash FROM subs
  UNION ALL SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 2, (n + 1) // 2),
walk AS (SELECT doc_id, leaf, g, 0 AS level, place, n, now AS found, '' AS proof FROM l
  UNION ALL SELECT w.doc_id, w.leaf, w.g, w.level + 1, w.place // 2, (w.n + 1) // 2, sha256(CASE WHEN w.place % 2 = 1 THEN s.hash || w.found ELSE w.found || coalesce(s.hash, '') END), w.proof || coalesce(s.hash, '')
  FROM walk w LEFT JOIN tree s ON s.g = w.g AND s.level = w.level AND s.place = xor(w.place, 1) WHERE w.n > 1),
climb AS (SELECT w.doc_id, w.leaf, s.hash AS subroot, 0 AS level, s.place, s.n, w.found, w.proof FROM walk w JOIN subs s ON s.g = w.g WHERE w.n = 1
  UNION ALL SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.place // 2, (w.n + 1) // 2, sha256(CASE WHEN w.place % 2 = 1 THEN s.hash || w.found ELSE w.found || coalesce(s.hash, '') END), w.proof || coalesce(s.hash, '')
  FROM climb w LEFT JOIN top s ON s.level = w.level AND s.place = xor(w.place, 1) WHERE w.n > 1)
SELECT w.doc_id, w.leaf, w.subroot, r.hash AS root, sha256(w.proof) AS proof_sha256, w.found AS folded_root, w.found = r.hash AS verified
FROM climb w, (SELECT hash FROM top WHERE n = 1) r WHERE w.n = 1
"""
ORACLES["op13_fill_in_middle"] = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, [('0x' || substr(h, 1 + 8 * k, 8))::BIGINT FOR k IN range(4)] AS draws FROM h),
c AS (SELECT doc_id, text, len(units) AS n, draws, contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR text = '' OR draws[3] % 100 >= 100 AS plain,
  units, least(draws[1] % (n + 1), draws[2] % (n + 1)) AS a, greatest(draws[1] % (n + 1), draws[2] % (n + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, plain, draws[4] % 100 < 50 AS spm, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
