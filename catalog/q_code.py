"""Code inside text: extraction, cleaning and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import table, view
from catalog.registry import query, rounded
from prefmill.functions import codescore as S
from prefmill.functions import codetext as C
from prefmill.functions import table_functions
from prefmill.functions.vectors import cosine_similarity
from prefmill.operators.evaluation import similarity_mean

FENCES = "regexp_extract_all(generated_text, '(?s)```(?:python)?\\n(.*?)\\n```', 1)"

BLOCKS = f"""
, blocks AS (
  SELECT example_id, {FENCES} AS fences,
         CASE WHEN len({FENCES}) > 0 THEN {FENCES} WHEN example_id % 7 <> 0 THEN [generated_text] ELSE [] END AS blocks
  FROM fx_predictions)"""


def blocks_sql(body: str) -> str:
    return f"{BLOCKS.strip()}\n{body.strip()}"


@query(
    "extract_fences",
    blocks_sql("SELECT example_id, CAST(len(fences) AS INT) AS n, array_to_string(fences, '|') AS bodies FROM blocks"),
    ("fx_predictions",),
)
def extract_fences(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_predictions").select("example_id", C.extract_fences(F.col("generated_text")).alias("f"))
    return rows.select("example_id", F.size("f").alias("n"), F.array_join("f", "|").alias("bodies"))


@query(
    "sql_code_fences",
    blocks_sql("SELECT example_id, CAST(unnest(range(1, len(fences) + 1)) AS INT) AS n, unnest(fences) AS block FROM blocks"),
    ("fx_predictions",),
)
def sql_code_fences(spark, sf_dir):
    table_functions.register(spark)
    answers = view(spark, sf_dir, "fx_predictions")
    return spark.sql("SELECT example_id, f.n, f.block FROM {answers}, LATERAL code_fences(generated_text) AS f", answers=answers)


@query(
    "sql_text_lines",
    """
SELECT doc_id, CAST(unnest(range(1, len(lines) + 1)) AS INT) AS n, CAST(length(unnest(lines)) AS INT) AS n_chars
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""",
)
def sql_text_lines(spark, sf_dir):
    table_functions.register(spark)
    docs = table(spark, sf_dir, "documents")
    return spark.sql("SELECT doc_id, f.n, length(f.line) AS n_chars FROM {docs}, LATERAL text_lines(text) AS f", docs=docs)


def blocks(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_predictions").select("example_id", "generated_text")
    return rows.select("example_id", S.extract_code(F.col("generated_text")).alias("b"))


@query(
    "extract_code",
    blocks_sql("SELECT example_id, CAST(len(blocks) AS INT) AS n, array_to_string(blocks, '|') AS bodies FROM blocks"),
    ("fx_predictions",),
)
def extract_code(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return rows.select("example_id", F.size("b").alias("n"), F.array_join("b", "|").alias("bodies"))


KEPT = "list_filter(string_split(b, chr(10)), lambda l: NOT starts_with(l, 'pip install '))"


@query(
    "clean_blocks",
    blocks_sql(f"""
SELECT example_id, CAST(len(c) AS INT) AS n, array_to_string(c, '|') AS bodies FROM (
  SELECT example_id, list_transform(list_filter(list_transform(blocks, lambda b: {KEPT}),
         lambda ls: list_max(list_transform(ls, lambda l: length(l))) > 2), lambda ls: array_to_string(ls, chr(10))) AS c
  FROM blocks) t"""),
    ("fx_predictions",),
)
def clean_blocks(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("example_id", C.clean_blocks(F.col("b")).alias("c"))
    return rows.select("example_id", F.size("c").alias("n"), F.array_join("c", "|").alias("bodies"))


@query(
    "assemble_script",
    blocks_sql(f"""
SELECT example_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS script FROM (
  SELECT example_id, line, pos, row_number() OVER (PARTITION BY example_id, line ORDER BY pos) AS seen FROM (
    SELECT example_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (
      SELECT example_id, flatten(list_transform(blocks, lambda b: list_append({KEPT}, chr(10)))) AS ls FROM blocks) a) b) c
WHERE seen = 1 OR NOT (starts_with(line, 'import ') OR starts_with(line, 'from ')) GROUP BY example_id
UNION ALL SELECT example_id, '' FROM blocks WHERE len(blocks) = 0"""),
    ("fx_predictions",),
)
def assemble_script(spark, sf_dir):
    return blocks(spark, sf_dir).select("example_id", C.assemble_script(F.col("b")).alias("script"))


LINES = (
    r"string_split_regex(regexp_replace(text, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z', ''), "
    r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
)
HASH = r"regexp_matches(l, '^[\t \x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]*#')"
FAULT = r"(length(l) > 79 OR regexp_matches(l, '^ *\t') OR regexp_matches(l, '[ \t]$'))"


@query(
    "comment_density",
    f"""
SELECT doc_id, CASE WHEN text = '' THEN 0.0 ELSE round(len(list_filter(ls, lambda l: {HASH})) / len(ls), 6) END AS density
FROM (SELECT doc_id, text, {LINES} AS ls FROM documents) t""",
)
def comment_density(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", C.comment_density(F.col("text")).alias("density"))
    return rows.select("doc_id", *rounded("density"))


@query(
    "comment_density_code",
    "SELECT k, round(value, 6) AS density FROM fx_truth WHERE side = 'chosen' AND metric = 'comment_density'",
    ("fx_truth",),
)
def comment_density_code(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_code").select("k", C.comment_density(F.col("chosen_code")).alias("density"))
    return rows.select("k", *rounded("density"))


@query(
    "style_compliance",
    f"""
SELECT doc_id, CASE WHEN text = '' THEN 1.0 ELSE round(1.0 - len(list_filter(ls, lambda l: {FAULT})) / len(ls), 6) END AS style
FROM (SELECT doc_id, text, {LINES} AS ls FROM documents) t""",
)
def style_compliance(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", C.style_compliance(F.col("text")).alias("style"))
    return rows.select("doc_id", *rounded("style"))


@query(
    "is_valid_python",
    "SELECT k, true AS chosen_ok, k % 11 <> 0 AS rejected_ok FROM fx_code",
    ("fx_code",),
)
def is_valid_python(spark, sf_dir):
    return view(spark, sf_dir, "fx_code").select(
        "k",
        S.is_valid_python(F.col("chosen_code")).alias("chosen_ok"),
        S.is_valid_python(F.col("rejected_code")).alias("rejected_ok"),
    )


def scored(spark, sf_dir, level=2):
    rows = view(spark, sf_dir, "fx_code")
    return rows.select(
        "k",
        S.score_code(F.col("chosen_code"), level).alias("c"),
        S.score_code(F.col("rejected_code"), level).alias("r"),
    )


def _one_metric(metric: str):
    def run(spark, sf_dir):
        rows = scored(spark, sf_dir)
        return rows.select("k", F.col(f"c.{metric}").alias("chosen"), F.col(f"r.{metric}").alias("rejected")).select(
            "k", *rounded("chosen", "rejected")
        )

    return run


for _query, _metric in (
    ("annotation_coverage", "type_annotation_coverage"),
    ("docstring_coverage", "docstring_coverage"),
    ("code_complexity", "code_complexity"),
):
    query(
        _query,
        f"""
SELECT k, round(max(value) FILTER (WHERE side = 'chosen'), 6) AS chosen, round(max(value) FILTER (WHERE side = 'rejected'), 6) AS rejected
FROM fx_truth WHERE metric = '{_metric}' GROUP BY k""",
        ("fx_truth",),
    )(_one_metric(_metric))


@query(
    "annotation_levels",
    """
SELECT k, round(1.0 / fns, 6) AS any_level, round(1.0 / fns, 6) AS some_level, round(1.0 / fns, 6) AS all_level
FROM (SELECT k, 1 + CASE WHEN k % 4 = 0 THEN 1.0 ELSE 0.0 END AS fns FROM fx_code) t""",
    ("fx_code",),
)
def annotation_levels(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_code").select("k", S.ast_scores(F.col("chosen_code")).alias("s"))
    named = zip(("any_level", "some_level", "all_level"), S.ANNOTATION_LEVELS)
    return rows.select("k", *[F.round(F.col(f"s.{field}"), 6).alias(name) for name, field in named])


@query(
    "score_code",
    """
SELECT k, side, round(max(value) FILTER (WHERE metric = 'type_annotation_coverage'), 6) AS type_annotation_coverage,
       round(max(value) FILTER (WHERE metric = 'docstring_coverage'), 6) AS docstring_coverage,
       round(max(value) FILTER (WHERE metric = 'code_complexity'), 6) AS code_complexity,
       round(max(value) FILTER (WHERE metric = 'pep8_compliance'), 6) AS pep8_compliance,
       round(max(value) FILTER (WHERE metric = 'comment_density'), 6) AS comment_density
FROM (SELECT k, side, metric, value FROM fx_truth
      UNION ALL SELECT k, 'rejected', 'none', NULL FROM fx_code WHERE k % 11 = 0) t GROUP BY k, side""",
    ("fx_truth",),
)
def score_code(spark, sf_dir):
    rows = scored(spark, sf_dir)
    tall = rows.select(
        "k",
        F.inline(
            F.array(
                F.struct(F.lit("chosen").alias("side"), F.col("c").alias("m")),
                F.struct(F.lit("rejected").alias("side"), F.col("r").alias("m")),
            )
        ),
    )
    return tall.select("k", "side", "m.*").select("k", "side", *rounded(*S.CODE_METRICS))


def neighbours(spark, sf_dir):
    """Each vector with the one of the next id."""
    vectors = table(spark, sf_dir, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(following, "vec_id")


COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    "embedding_cosine",
    f"SELECT a.vec_id, round({COSINE}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def embedding_cosine(spark, sf_dir):
    rows = neighbours(spark, sf_dir)
    return rows.select("vec_id", F.round(cosine_similarity(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query(
    "similarity_mean",
    f"""
SELECT a.label, round(avg({COSINE}), 6) AS similarity_to_chosen,
       round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), list_transform(CAST(b.embedding AS DOUBLE[]), lambda x: -x))), 6) AS similarity_to_rejected
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label""",
)
def similarity_mean_query(spark, sf_dir):
    opposite = F.transform(F.col("next").cast("array<double>"), lambda x: -x)
    rows = neighbours(spark, sf_dir).select(
        "label",
        cosine_similarity(F.col("embedding"), F.col("next")).alias("similarity_to_chosen"),
        cosine_similarity(F.col("embedding"), opposite).alias("similarity_to_rejected"),
    )
    means = similarity_mean(rows, ["label"])
    return means.select("label", *rounded("similarity_to_chosen", "similarity_to_rejected"))
