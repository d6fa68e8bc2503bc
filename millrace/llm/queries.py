"""The queries over the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, html_text, imatch, line_dedup, mixing, packing, rabitq, simhash, suffix_dedup, toxicity
from millrace.llm.scratch import LOWER, UPPER, Scratch

#: A document is toxic from this probability on.
TOXIC = 0.5
#: Mixing: share of the largest entropy wanted, and the most passes over a source.
ENTROPY, REPEATS = 0.95, 4.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(odd).alias("text")) for i, r in enumerate(("user", "assistant"))))))
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.edited_likeness(docs, imatch.lexicon(docs), Scratch(spark, "imatch"))


def op8_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ENTROPY, REPEATS)
    return out.select("doc_id", "source", F.round("mix_weight", 9).alias("mix_weight"), "mix_pass", "mix_key")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.with_toxicity(docs, _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= TOXIC).alias("toxic"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_line_dedup, op2_suffix_array_dedup, op3_simhash, op4_html_extraction, op5_chat_formatting, op6_best_fit_packing, op7_imatch, op8_rabitq, op9_temperature_mixing, op10_toxicity, pipeline)
    return {f.__name__: f for f in named}


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

_LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, {_SPACES}), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, line, pos, coalesce(k.doc_id < keep, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_REPEATS = """
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, list_transform(range(length(h) // 2 - 99), lambda s: md5(substr(h, 2 * s + 1, 200))) AS ks FROM n WHERE length(h) >= 200),
x AS (SELECT doc_id, unnest(ks) AS k, unnest(range(len(ks))) AS s FROM w),
f AS (SELECT k, min(doc_id * 4294967296 + s) AS first FROM x GROUP BY k HAVING count(*) > 1),
late AS (SELECT x.doc_id, s FROM x JOIN f USING (k) WHERE x.doc_id * 4294967296 + s <> first),
i AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS fresh FROM late),
g AS (SELECT doc_id, s, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM i),
r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, g),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
q AS (SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM p JOIN n USING (doc_id) GROUP BY p.doc_id)
SELECT n.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN q USING (doc_id)
"""

_CHAT = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '{chat.ESCAPE}', '\1#\2\3', 'g')) AS n_text,
  length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{chat.ESCAPE}', '\1#\2\3', 'g')) AS n_role FROM r)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + n_role + {len(chat.OPEN) + len(chat.CLOSE) + len(chat.END)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_MIX = rf"""
WITH RECURSIVE size AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents),
own AS (SELECT source, sum(n) AS own FROM size GROUP BY source),
total AS (SELECT sum(own) AS total FROM own),
share AS (SELECT source, own, own / CAST(total AS DOUBLE) AS share FROM own, total WHERE own > 0),
e(i, step, x) AS (SELECT 0, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL SELECT i + 1, step / 2, CASE WHEN x + step <= 1 AND (SELECT ln(sum(pow(share, x + step))) - sum(pow(share, x + step) * (x + step) * ln(share)) / sum(pow(share, x + step)) >= {ENTROPY} * ln(count(*)) FROM share) THEN x + step ELSE x END FROM e WHERE i <= 20),
r(i, step, x) AS (SELECT 0, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL SELECT i + 1, step / 2, CASE WHEN x + step <= 1 AND (SELECT max(pow(share, x + step) / share) / sum(pow(share, x + step)) > {REPEATS} FROM share) THEN x + step ELSE x END FROM r WHERE i <= 20),
both_x AS (SELECT (SELECT x FROM e WHERE i = 21) AS ex, (SELECT x FROM r WHERE i = 21) AS rx),
ex AS (SELECT CASE WHEN (SELECT max(pow(share, ex) / share) / sum(pow(share, ex)) > {REPEATS} FROM share) THEN greatest(ex, least(1, rx + pow(2, -20))) ELSE ex END AS x FROM both_x),
z AS (SELECT x, (SELECT sum(pow(share, x)) FROM share) AS z FROM ex),
due AS (SELECT source, own, pow(share, x) / z AS weight, CAST(floor(pow(share, x) / z * total + 0.5) AS BIGINT) AS due FROM share, z, total),
plan AS (SELECT source, weight, due // own AS whole, due % own AS rest FROM due),
keyed AS (SELECT size.doc_id, size.source, n, coalesce(weight, 0) AS weight, coalesce(whole, 1) AS whole, rest,
  md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(coalesce(whole, 1) AS VARCHAR)) AS key
  FROM size LEFT JOIN plan ON size.source IS NOT DISTINCT FROM plan.source),
upto AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY key) AS upto FROM keyed),
passes AS (SELECT *, CAST(whole + CASE WHEN rest IS NOT NULL AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS passes FROM upto),
out AS (SELECT doc_id, source, weight, unnest(range(passes)) AS mix_pass FROM passes)
SELECT doc_id, source, round(weight, 9) AS mix_weight, CAST(mix_pass AS INTEGER) AS mix_pass, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(mix_pass AS VARCHAR)) AS mix_key FROM out
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINES, "op2_suffix_array_dedup": _REPEATS, "op5_chat_formatting": _CHAT, "op9_temperature_mixing": _MIX}
