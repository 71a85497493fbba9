"""One query for each operator over its whole table, and SQL that must return the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from prefmill.llm import alignment, decontaminate, htmltext, langid, lexical, mixing, ngramlm, partitions, quality, simhash, toolchat, toxicity, warc
from prefmill.llm.tables import cut, documents, fold
from prefmill.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 3) == 1
    model = langid.fit(langid.learned(docs, held_out))
    marked = langid.identify(docs, model)
    return marked.withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), htmltext.train())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.copies(documents(spark, sf_dir))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(text) AS text_md5, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    3.0::DOUBLE * source_size AS most FROM sums
), rounds AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, row_number() OVER (ORDER BY most / weight, source) AS place,
    coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM weighed
), shared AS (
  SELECT arg_min((total - given) / rest, place) FILTER ((total - given) / rest <= most / weight) AS share FROM rounds
), targets AS (
  SELECT source, source_size, least(most, coalesce(share, 0) * weight) AS target,
    CASE WHEN source_size > 0 THEN least(most, coalesce(share, 0) * weight) / source_size ELSE 0.0 END AS rate
  FROM weighed, shared
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text_md5, '') || ':41'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


REPLY = {
    "type": "object",
    "required": ["prompt", "turn"],
    "properties": {"prompt": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}},
    "additionalProperties": False,
}


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolchat.turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    linked = toolchat.link(calls, results, {"reply": REPLY})
    return linked.select("conv_id", "call_id", "turn", "step", "state", F.concat_ws("; ", "errors").alias("errors"), "json")


OP6_SQL = """
WITH calls AS (
  SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id, turn
), results AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
), chained AS (
  SELECT *, lag(turn) OVER w AS before FROM calls WINDOW w AS (PARTITION BY conv_id, turn % 2 ORDER BY turn)
), runs AS (
  SELECT *, max(CASE WHEN before IS DISTINCT FROM turn - 2 THEN turn END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS start FROM chained
), joined AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, c.turn IS NOT NULL AS called, r.turn IS NOT NULL AS came,
    c.text AS prompt, r.text AS content, c.start, c.before
  FROM runs c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn
)
SELECT CAST(conv_id AS VARCHAR) AS conv_id, 't' || turn AS call_id, CASE WHEN called THEN turn ELSE turn + 1 END AS turn,
  CASE WHEN called THEN CAST((turn - start) // 2 AS BIGINT) END AS step,
  CASE WHEN NOT called THEN 'orphan' WHEN NOT came THEN 'unanswered' ELSE 'answered' END AS state,
  CASE WHEN called THEN concat_ws('; ', CASE WHEN prompt IS NULL THEN 'prompt: not of type string' WHEN length(prompt) < 20 THEN 'prompt: too short' END,
    CASE WHEN turn >= 2 AND before IS DISTINCT FROM turn - 2 THEN 'missing dependency' END) ELSE '' END AS errors,
  '{' || CASE WHEN called THEN '"arguments":{"prompt":' || CASE WHEN prompt IS NULL THEN 'null' ELSE CAST(to_json(prompt) AS VARCHAR) END || ',"turn":' || turn || '},' ELSE '' END
    || '"content":' || CASE WHEN content IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END || ',"id":"t' || turn || '"'
    || CASE WHEN called THEN ',"name":"reply"' ELSE '' END || '}' AS json
FROM joined
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = cut(warc.read_records(spark, path, payloads=False), "records")
    caught = warc.captures(records).withColumn("page_id", F.col("metadata.fields")["pageId"].try_cast("long"))
    return warc.with_referred(caught, F.col("page_id"), "refers_to_page").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to")
    )


OP7_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, md5(coalesce(html, '')) AS m FROM pages
), spelled AS (
  SELECT *, array_to_string(list_transform(range(32),
      lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INT)) & 31) + 1, 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h, m, payload_bytes) AS last
  FROM hashed
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM spelled
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fifth = fold(F.col("doc_id"), 5)
    field = toxicity.fit(docs, labels.filter(fifth != 0))
    return toxicity.toxicity(docs, field).withColumn("held_out", F.coalesce(fifth == 0, F.lit(False)))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngramlm.score(documents(spark, sf_dir))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_prob") / F.col("n_words"), 6))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_prob", 3).alias("log_prob"), mean.alias("mean_log_prob"))


OP9_SQL = r"""
WITH listed AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
), words AS (
  SELECT d, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM listed WHERE len(ws) > 0
), placed AS (
  SELECT d, w, i, n, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM words WINDOW o AS (PARTITION BY d ORDER BY i)
), own1 AS (SELECT d, w, count(*) AS c FROM words GROUP BY d, w),
all1 AS (SELECT w, sum(c) AS c FROM own1 GROUP BY w),
own2 AS (SELECT d, v, w, count(*) AS c FROM placed WHERE i > 0 GROUP BY d, v, w),
all2 AS (SELECT v, w, sum(c) AS c FROM own2 GROUP BY v, w),
own3 AS (SELECT d, u, v, w, count(*) AS c FROM placed WHERE i > 1 GROUP BY d, u, v, w),
all3 AS (SELECT u, v, w, sum(c) AS c FROM own3 GROUP BY u, v, w),
total AS (SELECT count(*) AS n FROM words),
others1 AS (SELECT d, w, all1.c - own1.c AS c FROM own1 JOIN all1 USING (w)),
others2 AS (SELECT d, v, w, all2.c - own2.c AS c FROM own2 JOIN all2 USING (v, w)),
others3 AS (SELECT d, u, v, w, all3.c - own3.c AS c FROM own3 JOIN all3 USING (u, v, w)),
counted AS (
  SELECT p.d, p.i, w.c AS cw, v.c AS cv, vw.c AS cvw, uv.c AS cuv, uvw.c AS cuvw, greatest(1, total.n - p.n)::DOUBLE AS others
  FROM placed p JOIN total ON true
  JOIN others1 w ON w.d = p.d AND w.w = p.w
  LEFT JOIN others1 v ON v.d = p.d AND v.w = p.v
  LEFT JOIN others2 vw ON vw.d = p.d AND vw.v = p.v AND vw.w = p.w
  LEFT JOIN others2 uv ON uv.d = p.d AND uv.v = p.u AND uv.w = p.v
  LEFT JOIN others3 uvw ON uvw.d = p.d AND uvw.u = p.u AND uvw.v = p.v AND uvw.w = p.w
), scored AS (
  SELECT d, count(*) FILTER (i > 0 AND cvw = 0) + count(*) FILTER (i > 1 AND cuvw = 0) AS n_backoff,
    sum(ln(CASE WHEN i > 1 AND cuvw > 0 THEN cuvw::DOUBLE / cuv::DOUBLE
                WHEN i > 0 AND cvw > 0 THEN cvw::DOUBLE / cv::DOUBLE * CASE WHEN i > 1 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END
                ELSE greatest(cw::DOUBLE, 0.5::DOUBLE) / others * CASE least(i, 2) WHEN 2 THEN 0.4::DOUBLE * 0.4::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END END)) AS log_prob
  FROM counted GROUP BY d
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(log_prob, 0.0), 3) AS log_prob,
  CASE WHEN len(ws) > 0 THEN round(log_prob / len(ws), 6) END AS mean_log_prob
FROM listed LEFT JOIN scored ON listed.d = scored.d
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.quality_report(docs, quality.fit_references(docs))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH listed AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), wanted AS (
  SELECT i, item_id, t, count(*) AS c FROM (
    SELECT row_number() OVER () AS i, item_id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
  ) GROUP BY i, item_id, t
), sizes AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM listed WHERE len(ts) > 0
), held AS (
  SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ts) AS t FROM listed) WHERE t IN (SELECT t FROM wanted) GROUP BY d, t
), weighed AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, sizes GROUP BY t, n_docs
), documented AS (
  SELECT d, doc_id, 75 + (25 * len(ts) * n_docs) // n_terms AS m FROM listed, sizes WHERE len(ts) > 0
), impacts AS (
  SELECT h.d, t, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS part FROM held h JOIN documented USING (d) JOIN weighed USING (t)
), scored AS (
  SELECT i, item_id, doc_id, CAST(sum(c * part) AS BIGINT) AS score FROM impacts JOIN wanted USING (t) JOIN documented USING (d) GROUP BY i, item_id, d, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = alignment.align(documents(spark, sf_dir)).select("*", digest).drop("groups")
    return alignment.with_counts(aligned)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_html": op3_html,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_tool_calls": op6_tool_calls,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_lm_score": op9_lm_score,
    "op10_quality": op10_quality,
    "op11_lexical": op11_lexical,
    "op12_alignment": op12_alignment,
    "op13_neighbours": op13_neighbours,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op4_mixing": OP4_SQL, "op6_tool_calls": OP6_SQL, "op7_warc": OP7_SQL, "op9_lm_score": OP9_SQL, "op11_lexical": OP11_SQL}

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
