"""Responses, their errors, and the pairs built from them."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from catalog.inputs import table, view
from catalog.registry import query
from prefmill.functions.messages import is_message_list, unwrap_content
from prefmill.operators import pairs as X
from prefmill.operators import responses as R
from prefmill.operators.batch import embed_batch, generate_batch, tokenize_with
from prefmill.operators.evaluation import drop_null_prompt, prepare_prompts
from prefmill.operators.journal import ask, generate_resumable
from prefmill.operators.prompts import sft_text
from prefmill.operators.quality import require_columns
from prefmill.plans.finetune_data import sft_tokens
from prefmill.session import scratch_path

TOKEN_SQL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]"

KIND = "CASE WHEN k % 13 = 0 OR k % 19 = 0 THEN 'json' END"
STAGE = "CASE WHEN k % 13 = 0 THEN 1 WHEN k % 19 = 0 THEN 2 END"


@query(
    "parse_response",
    f"""
SELECT k AS result_id, {KIND} AS error_kind, CAST({STAGE} AS INT) AS error_stage,
       CAST(CASE WHEN k % 13 = 0 THEN NULL ELSE 3 END AS INT) AS n_first,
       CAST(CASE WHEN k % 13 = 0 OR k % 19 = 0 THEN NULL ELSE 3 END AS INT) AS n_second,
       CASE WHEN k % 13 = 0 THEN NULL ELSE rejected_code END AS first_code,
       CASE WHEN k % 13 = 0 OR k % 19 = 0 THEN NULL ELSE chosen_code END AS improved_code
FROM fx_code""",
    ("fx_code",),
)
def parse_response(spark, sf_dir):
    parsed = R.parse_responses(view(spark, sf_dir, "fx_responses"))
    first, second = F.get("first_items", F.lit(0)), F.get("second_items", F.lit(0))
    return parsed.select(
        "result_id",
        "error_kind",
        "error_stage",
        F.when(F.col("first_items").isNotNull(), F.size("first_items")).alias("n_first"),
        F.when(F.col("second_items").isNotNull(), F.size("second_items")).alias("n_second"),
        first.getField("code").alias("first_code"),
        second.getField("improved_code").alias("improved_code"),
    )


@query(
    "classify_error",
    """
SELECT k AS result_id, kind AS error_kind, CAST(stage AS INT) AS error_stage,
       CASE kind WHEN 'request' THEN 'Request error: no response'
                 WHEN 'json' THEN 'JSON parse error: stage ' || CAST(stage AS VARCHAR) || ' response is not one JSON value'
                 WHEN 'processing' THEN 'Processing error: stage ' || CAST(stage AS VARCHAR) || ' response lacks the expected members' END AS error
FROM (SELECT k, CASE WHEN k % 10 IN (0, 1, 3, 5, 6) THEN 'processing' WHEN k % 10 IN (2, 7) THEN 'json'
                     WHEN k % 10 IN (4, 8) THEN 'request' END AS kind,
             CASE WHEN k % 10 < 5 THEN 1 WHEN k % 10 < 9 THEN 2 END AS stage FROM fx_code) t""",
    ("fx_code",),
)
def classify_error(spark, sf_dir):
    parsed = R.parse_responses(view(spark, sf_dir, "fx_broken"))
    return parsed.select("result_id", "error_kind", "error_stage", "error")


@query(
    "drop_errors",
    "SELECT k AS result_id, domain, task FROM fx_code WHERE k % 13 <> 0 AND k % 19 <> 0",
    ("fx_code",),
)
def drop_errors(spark, sf_dir):
    return R.drop_errors(R.parse_responses(view(spark, sf_dir, "fx_responses"))).select("result_id", "domain", "task")


@query(
    "error_report",
    f"SELECT domain, {KIND} AS error_kind, CAST({STAGE} AS INT) AS error_stage, count(*) AS n FROM fx_code "
    "WHERE k % 13 = 0 OR k % 19 = 0 GROUP BY ALL",
    ("fx_code",),
)
def error_report(spark, sf_dir):
    bad = R.error_rows(R.parse_responses(view(spark, sf_dir, "fx_responses")))
    return bad.groupBy("domain", "error_kind", "error_stage").agg(F.count("*").alias("n"))


@query(
    "join_responses",
    """
SELECT CAST(d.doc_id AS VARCHAR) AS request_id, d.lang AS prompt,
       CASE WHEN toxic = 0 THEN 'quality ' || CAST(quality AS VARCHAR) END AS first_content,
       CASE WHEN l.doc_id IS NULL THEN 'no response' WHEN toxic = 1 THEN 'refused' END AS request_error
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def join_responses(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS request_id", "lang AS prompt")
    answers = table(spark, sf_dir, "labels").selectExpr(
        "CAST(doc_id AS STRING) AS request_id",
        "'quality ' || CAST(quality AS STRING) AS response",
        "CASE WHEN toxic = 1 THEN 'refused' END AS error",
    )
    return R.join_responses(asked, answers)


MATCHED = """
matched AS (
  SELECT k AS result_id, domain, task, code_form, CAST(0 AS INT) AS item_pos,
         CASE WHEN k % 17 = 0 THEN '' ELSE prompt_text END AS prompt_text, chosen_code AS chosen_text, rejected_code AS rejected_text
  FROM fx_code WHERE k % 13 <> 0 AND k % 19 <> 0
  UNION ALL SELECT k, domain, task, code_form, 1, 'second', 'z: int = 1', 'z = 1' FROM fx_code WHERE k % 13 <> 0 AND k % 19 <> 0
  UNION ALL SELECT k, domain, task, code_form, 2, NULL, 'q', 'no match' FROM fx_code WHERE k % 13 <> 0 AND k % 19 <> 0)"""


def matched_sql(body: str) -> str:
    return f", {MATCHED.strip()}\n{body}"


def results(spark, sf_dir):
    return R.parse_responses(view(spark, sf_dir, "fx_responses"))


@query("match_first", matched_sql("SELECT result_id, item_pos, prompt_text FROM matched"), ("fx_code",))
def match_first(spark, sf_dir):
    good = R.drop_errors(results(spark, sf_dir))
    return X.match_prompts(good, ["result_id"]).select("result_id", "item_pos", "prompt_text")


@query(
    "match_first_across",
    matched_sql("SELECT result_id, item_pos, prompt_text FROM matched"),
    ("fx_code",),
)
def match_first_across(spark, sf_dir):
    good = R.drop_errors(results(spark, sf_dir))
    items = good.select("result_id", F.posexplode("first_items").alias("pos", "i")).select("result_id", "pos", "i.*")
    improved = good.select("result_id", F.posexplode("second_items").alias("item_pos", "i")).select(
        "result_id", "item_pos", "i.original_code"
    )
    return X.match_first_across(improved, items, "result_id").select("result_id", "item_pos", "prompt_text")


@query(
    "drop_unmatched",
    matched_sql("SELECT item_pos, count(*) AS n FROM matched WHERE prompt_text <> '' GROUP BY item_pos"),
    ("fx_code",),
)
def drop_unmatched(spark, sf_dir):
    rows = X.match_prompts(R.drop_errors(results(spark, sf_dir)), ["result_id"])
    return X.drop_unmatched(rows).groupBy("item_pos").agg(F.count("*").alias("n"))


PAIRS = matched_sql(
    "SELECT result_id, prompt_text AS prompt, chosen_text AS chosen, rejected_text AS rejected, domain, task, code_form "
    "FROM matched WHERE prompt_text <> ''"
)


def flat_pairs(pairs, *keep):
    texts = [unwrap_content(pairs, side).alias(side) for side in ("prompt", "chosen", "rejected")]
    return pairs.select(*keep, *texts, "domain", "task", "code_form")


@query("build_pairs", PAIRS, ("fx_code",))
def build_pairs(spark, sf_dir):
    return flat_pairs(X.build_pairs(results(spark, sf_dir), ["result_id"]), "result_id")


@query("build_header_pairs", PAIRS, ("fx_code",))
def build_header_pairs(spark, sf_dir):
    parsed = R.parse_responses(view(spark, sf_dir, "fx_header_responses"), "header")
    return flat_pairs(X.build_pairs(parsed, ["result_id"]), "result_id")


@query(
    "build_test_pairs",
    """
SELECT result_id, prompt_type, prompt, chosen, rejected, domain, task, code_form FROM (
  SELECT k AS result_id, 'default' AS prompt_type, 'plain ' || prompt_text AS prompt, chosen_code AS chosen,
         rejected_code AS rejected, domain, task, code_form FROM fx_code
  UNION ALL SELECT k, 'code_form', code_form || ': ' || prompt_text, chosen_code, rejected_code, domain, task, code_form FROM fx_code WHERE k % 5 <> 0
  UNION ALL SELECT k, 'code_form_types', 'typed ' || prompt_text, chosen_code, rejected_code, domain, task, code_form FROM fx_code WHERE k % 6 <> 0) t
WHERE result_id % 13 <> 0 AND result_id % 19 <> 0""",
    ("fx_code",),
)
def build_test_pairs(spark, sf_dir):
    parsed = R.parse_responses(view(spark, sf_dir, "fx_test_responses"), "test")
    return flat_pairs(X.build_test_pairs(parsed, ["result_id"]), "result_id", "prompt_type")


@query(
    "drop_empty_prompt_type",
    """
SELECT prompt_type, count(*) AS n FROM (
  SELECT k, 'default' AS prompt_type FROM fx_code
  UNION ALL SELECT k, 'code_form' FROM fx_code WHERE k % 5 <> 0
  UNION ALL SELECT k, 'code_form_types' FROM fx_code WHERE k % 6 <> 0) t
WHERE k % 13 <> 0 AND k % 19 <> 0 GROUP BY prompt_type""",
    ("fx_code",),
)
def drop_empty_prompt_type(spark, sf_dir):
    good = R.drop_errors(R.parse_responses(view(spark, sf_dir, "fx_test_responses"), "test"))
    return X.drop_empty_prompt_type(X.prompt_variants(good)).groupBy("prompt_type").agg(F.count("*").alias("n"))


CARD = (
    "count(*) AS n_rows, count(DISTINCT domain) AS n_domains, count(DISTINCT task) AS n_tasks, "
    "count(DISTINCT code_form) AS n_code_forms"
)


@query("dataset_card", matched_sql(f"SELECT {CARD} FROM matched WHERE prompt_text <> ''"), ("fx_code",))
def dataset_card(spark, sf_dir):
    return X.dataset_card(X.build_pairs(results(spark, sf_dir)))


@query(
    "dataset_card_by_domain",
    matched_sql(f"SELECT domain, {CARD.replace('count(DISTINCT domain) AS n_domains, ', '')} FROM matched WHERE prompt_text <> '' GROUP BY domain"),
    ("fx_code",),
)
def dataset_card_by_domain(spark, sf_dir):
    return X.dataset_card(X.build_pairs(results(spark, sf_dir)), ["domain"]).drop("n_domains")


def text_pairs(spark, sf_dir):
    """Conversation pairs as message lists; the rejected answer is the prompt itself."""
    rows = view(spark, sf_dir, "fx_text_pairs").withColumn("rejected_text", F.col("prompt_text"))
    return X.pair_messages(rows)


@query(
    "pair_messages",
    """
SELECT conv_id, turn, 'prompt' AS side, 'user' AS role, prompt_text AS content FROM fx_text_pairs
UNION ALL SELECT conv_id, turn, 'chosen', 'assistant', chosen_text FROM fx_text_pairs
UNION ALL SELECT conv_id, turn, 'rejected', 'assistant', prompt_text FROM fx_text_pairs""",
    ("fx_text_pairs",),
)
def pair_messages(spark, sf_dir):
    tall = text_pairs(spark, sf_dir).unpivot(["conv_id", "turn"], ["prompt", "chosen", "rejected"], "side", "messages")
    return tall.select("conv_id", "turn", "side", F.inline("messages"))


@query(
    "unwrap_content",
    "SELECT conv_id, turn, domain, prompt_text AS prompt, chosen_text AS chosen, prompt_text AS rejected FROM fx_text_pairs",
    ("fx_text_pairs",),
)
def unwrap(spark, sf_dir):
    rows = text_pairs(spark, sf_dir)
    names = ("domain", "prompt", "chosen", "rejected")
    return rows.select("conv_id", "turn", *[unwrap_content(rows, n).alias(n) for n in names])


@query(
    "is_conversational",
    "SELECT domain, true AS conversational, count(*) AS n FROM fx_text_pairs GROUP BY domain "
    "UNION ALL SELECT domain, false, count(*) FROM fx_text_pairs GROUP BY domain",
    ("fx_text_pairs",),
)
def is_conversational(spark, sf_dir):
    listed = text_pairs(spark, sf_dir)
    plain = view(spark, sf_dir, "fx_text_pairs").withColumnRenamed("chosen_text", "chosen")
    parts = [
        df.groupBy("domain", F.lit(is_message_list(df, "chosen")).alias("conversational")).agg(F.count("*").alias("n"))
        for df in (listed, plain)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "require_columns",
    "SELECT domain, count(*) AS n FROM fx_text_pairs GROUP BY domain",
    ("fx_text_pairs",),
)
def require(spark, sf_dir):
    return require_columns(text_pairs(spark, sf_dir)).groupBy("domain").agg(F.count("*").alias("n"))


@query(
    "drop_null_prompt",
    """
SELECT doc_id, CASE WHEN quality = 1 THEN 'code_form' ELSE 'default' END AS prompt_type, text AS prompt_text
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text <> ''""",
)
def drop_null(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    examples = rows.selectExpr(
        "doc_id",
        "CASE WHEN quality IS NOT NULL THEN text END AS prompt",
        "CASE WHEN quality = 1 THEN 'code_form' WHEN quality = 0 THEN '' END AS prompt_type",
    )
    return drop_null_prompt(prepare_prompts(examples)).select("doc_id", "prompt_type", "prompt_text")


@query(
    "sft_text",
    "SELECT conv_id, turn, prompt_text || chr(10) || chosen_text AS joined, chosen_text AS alone FROM fx_text_pairs",
    ("fx_text_pairs",),
)
def sft_text_query(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_text_pairs")
    prompt, chosen = F.col("prompt_text"), F.col("chosen_text")
    return rows.select(
        "conv_id", "turn", sft_text(prompt, chosen).alias("joined"), sft_text(prompt, chosen, False).alias("alone")
    )


@query(
    "sft_tokens",
    f"""
SELECT conv_id, turn, CAST(len(t) AS INT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT conv_id, turn, list_slice(regexp_extract_all(prompt_text || chr(10) || chosen_text, '{TOKEN_SQL}'), 1, 64) AS t FROM fx_text_pairs) s""",
    ("fx_text_pairs",),
)
def sft_tokens_query(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_text_pairs")
    cut = rows.select(
        "conv_id", "turn", sft_tokens(sft_text(F.col("prompt_text"), F.col("chosen_text")), 64).alias("t")
    )
    return cut.select("conv_id", "turn", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def echo_loader():
    """A stand-in model: marks a letter, and refuses prompts with a certain word."""

    def answer(prompts):
        if any("die" in p for p in prompts):
            raise ValueError("refused")
        return [p.replace("e", "E") for p in prompts]

    return answer


@query(
    "generate_batch",
    """
SELECT conv_id, turn, CASE WHEN contains(prompt_text, 'die') THEN NULL ELSE replace(prompt_text, 'e', 'E') END AS response,
       CASE WHEN contains(prompt_text, 'die') THEN 'refused' END AS error FROM fx_text_pairs""",
    ("fx_text_pairs",),
)
def generate(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_text_pairs").select("conv_id", "turn", "prompt_text")
    return generate_batch(rows, "prompt_text", echo_loader).drop("prompt_text")


@query(
    "generate_resumable",
    """
SELECT conv_id, turn, CASE WHEN contains(prompt_text, 'die') THEN NULL ELSE replace(prompt_text, 'e', 'E') END AS response,
       CASE WHEN contains(prompt_text, 'die') THEN 'refused' END AS error FROM fx_text_pairs""",
    ("fx_text_pairs",),
)
def generate_again(spark, sf_dir):
    """The prompts of one domain first, as a run that stopped there, then all."""
    path = scratch_path(spark, "journal")
    rows = view(spark, sf_dir, "fx_text_pairs").withColumn("request", F.concat_ws("/", "conv_id", "turn"))
    ask(rows.filter("domain = 'conv0'"), "prompt_text", echo_loader, path, "request")
    return generate_resumable(rows, "prompt_text", echo_loader, path, "request").select("conv_id", "turn", "response", "error")


def shape_loader():
    """A stand-in embedder: text length and number of blanks."""
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query(
    "embed_batch",
    """
SELECT conv_id, turn, CAST(length(chosen_text) AS DOUBLE) AS v0,
       CAST(length(chosen_text) - length(replace(chosen_text, ' ', '')) AS DOUBLE) AS v1 FROM fx_text_pairs""",
    ("fx_text_pairs",),
)
def embed(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_text_pairs").select("conv_id", "turn", "chosen_text")
    vectors = embed_batch(rows, "chosen_text", shape_loader)
    return vectors.select("conv_id", "turn", F.get("vector", F.lit(0)).alias("v0"), F.get("vector", F.lit(1)).alias("v1"))


def blank_loader():
    """A stand-in tokeniser: cuts at single blanks."""
    return lambda texts: [t.split(" ") for t in texts]


@query(
    "tokenize_with",
    """
SELECT conv_id, turn, CAST(len(t) AS INT) AS n_tokens, array_to_string(t, '|') AS tokens
FROM (SELECT conv_id, turn, list_slice(string_split(chosen_text, ' '), 1, 32) AS t FROM fx_text_pairs) s""",
    ("fx_text_pairs",),
)
def tokenize(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_text_pairs").select("conv_id", "turn", "chosen_text")
    cut = tokenize_with(rows, "chosen_text", blank_loader, "t", max_length=32)
    return cut.select("conv_id", "turn", F.size("t").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


# The workers get the stand-in functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
