"""The thin queries over the corpus operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, language_id, mixing, multi_index, packing, quality_rules, secret_scan, substring_dedup, token_store, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = token_store.token_store(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return token_store.digest(stored)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    draw = lambda n, what: F.try_element_at("draws", F.lit(n))[what].alias(f"{what}_{n}")  # noqa: E731  where each copy goes
    return plan.select("doc_id", "size", "source_size", "target", "taken", draw(1, "shard"), draw(1, "place"), draw(2, "shard"), draw(2, "place"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"), secret_scan.vocabularies(_vocabulary)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.fit(docs))
    return out.select("doc_id", (language_id.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = language_id.fold(F.col("doc_id"), 5) == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_line_quality, op3_source_mix, op4_secret_scan, op5_packing, op6_jaccard_join, op7_language_id, op8_toxicity, op9_multi_index, op10_substring_dedup)}

_PHRASES = "|".join(quality_rules.BOILERPLATE)
_BARS = ", ".join(f"'{b}'" for b in quality_rules.BARS)

ORACLE_SQL: dict[str, str] = {
    "op2_line_quality": rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, r, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i) WHERE len(ws) >= 3),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + d) AS n FROM again, unnest([0, 1, 2]) AS v(d) GROUP BY r),
ln AS (
  SELECT r, k, ls[k] AS x, list_filter(regexp_split_to_array(ls[k], '[\x20\x09-\x0D]+'), lambda y: y <> '') AS lw
  FROM w, unnest(range(1, len(ls) + 1)) AS u(k)),
about AS (
  SELECT r, k, len(lw) AS n, len(list_filter(lw, lambda y: list_contains([{_BARS}], y))) AS bars,
    regexp_matches(lower(x), '{_PHRASES}') AS phrase, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > 0.1 * length(x) AS marks,
    regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$') AS teaser,
    length(x) <= 40 AND len(lw) <= 4 AND NOT regexp_matches(x, '[.!?…:;,"'')\]][\x20\x09-\x0D]*$') AS short FROM ln),
near AS (
  SELECT *, coalesce(lag(short, 1) OVER o, false) AS b1, coalesce(lag(short, 2) OVER o, false) AS b2,
    coalesce(lead(short, 1) OVER o, false) AS a1, coalesce(lead(short, 2) OVER o, false) AS a2 FROM about WINDOW o AS (PARTITION BY r ORDER BY k)),
lost AS (
  SELECT r, sum(n) AS n FROM near
  WHERE bars >= 3 OR (bars >= 2 AND n <= 4 * bars + 3) OR phrase OR marks OR teaser OR (short AND (b1 AND a1 OR b1 AND b2 OR a1 AND a2)) GROUP BY r),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.n, 0) AS gone
  FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN lost ON w.r = lost.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND gone <= 0.5 * n_words AS kept FROM base""".replace("\\\\", "\\"),
    "op10_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i AS s, hash(array_to_string(ws[i:i+49], ' ')) AS h, md5(array_to_string(ws[i:i+49], ' ')) AS m
  FROM w, unnest(range(1, len(ws) - 48)) AS t(i) WHERE len(ws) >= 50),
owner AS (SELECT h, m, min(doc_id) AS o FROM win GROUP BY h, m HAVING min(doc_id) < max(doc_id)),
late AS (SELECT win.doc_id, win.s FROM win JOIN owner USING (h, m) WHERE o < win.doc_id),
gone AS (SELECT DISTINCT doc_id, s + j AS p FROM late, unnest(range(0, 50)) AS t(j)),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(g.n, 0) AS n_removed,
    CASE WHEN g.n IS NULL THEN ws ELSE [x.w FOR x IN list_transform(ws, lambda x, i: {'w': x, 'gone': list_contains(g.ps, i)}) IF NOT x.gone] END AS ks
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept""",
}
