import sys

import pytest
from pyspark import cloudpickle

from prefmill.operators.batch import _apply, count_tokens_with, embed_batch, generate_batch, tokenize_with
from prefmill.operators.lengths import length_counts_with

# The workers cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shout():
    def answer(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [t.upper() for t in texts]

    return answer


def test_a_failing_prompt_gives_an_error_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "c")], "k int, p string")
    rows = {r.k: (r.response, r.error) for r in generate_batch(df, "p", shout, partitions=2).collect()}
    assert rows == {1: ("A", None), 2: (None, "refused"), 3: (None, None), 4: ("C", None)}


def test_a_wrong_number_of_answers_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    rows = generate_batch(df, "p", lambda: lambda texts: texts * 2).collect()
    assert {r.error for r in rows} == {"1 texts gave 2 values"}


def test_nested_columns_pass_through(spark):
    df = spark.createDataFrame([([("user", "x")], "t")], "m array<struct<role string, content string>>, p string")
    assert generate_batch(df, "p", shout).first().m[0].content == "x"


def test_vectors_and_tokens(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    vectors = embed_batch(df, "t", lambda: lambda texts: [[len(t), 0.5] for t in texts]).collect()
    assert [r.vector for r in vectors] == [[5.0, 0.5], None]
    cut = tokenize_with(df, "t", lambda: lambda texts: [t.split() for t in texts], max_length=2).collect()
    assert [r.tokens for r in cut] == [["a", "b"], None]


def test_a_failing_embedder_fails_the_job(spark):
    def load():
        def fail(texts):
            raise ValueError("no model")

        return fail

    with pytest.raises(Exception, match="no model"):
        embed_batch(spark.createDataFrame([("a",)], "t string"), "t", load).collect()


def test_a_real_tokeniser(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    words = ["[UNK]", "def", "f", "(", "a", ")", ":", "return", "hello", "world"]
    model = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    model.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    path = str(tmp_path / "vocabulary.json")
    model.save(path)

    def load():
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in own.encode_batch(list(texts))]

    texts = ["def f(a):\n    return a", "hello world"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.tokens for r in tokenize_with(df, "t", load).collect()}
    assert got == {t: [str(i) for i in model.encode(t).ids] for t in texts}
    counted = count_tokens_with(df, "t", load).collect()
    assert {r.t: r.n_tokens for r in counted} == {t: len(model.encode(t).ids) for t in texts}


@pytest.mark.parametrize("bad", [0, 777, 1999])
def test_one_bad_text_costs_few_calls(bad):
    calls = []

    def answer(texts):
        calls.append(len(texts))
        if f"t{bad}" in texts:
            raise ValueError("refused")
        return [t.upper() for t in texts]

    values, errors = _apply(answer, [f"t{i}" for i in range(2000)])
    assert [i for i, e in enumerate(errors) if e] == [bad] and values[bad] is None and sum(v is not None for v in values) == 1999
    assert len(calls) <= 2 * 11 + 1 and sum(calls) <= 3 * 2000


def test_every_text_bad():
    def answer(texts):
        raise ValueError("no")

    values, errors = _apply(answer, ["a", None, "b"])
    assert values == [None] * 3 and errors == ["no", None, "no"]


def test_similarity_of_generated_text(spark):
    from prefmill.operators.evaluation import score_predictions, with_similarities

    rows = [(1, "x = 1", "x = 1", "", "default"), (2, "no code here", "x", "y", "default"), (3, None, "x", "y", "default")]
    df = spark.createDataFrame(rows, "example_id int, generated_text string, chosen string, rejected string, prompt_type string")
    vectors = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    got = {r.example_id: (r.similarity_to_chosen, r.similarity_to_rejected) for r in with_similarities(score_predictions(df), vectors).collect()}
    assert got[1][0] == pytest.approx(1.0) and got[1][1] is None and got[2] == got[3] == (None, None)


def test_length_counts_by_a_batch_tokeniser(spark):
    df = spark.createDataFrame([("a b", "c", None), ("d", "e f g", "")], "prompt string, chosen string, rejected string")
    rows = length_counts_with(df, lambda: lambda texts: [t.split() for t in texts]).collect()
    assert {(r.side, r.length): r.n for r in rows} == {("prompt", 2): 1, ("prompt", 1): 1, ("chosen", 1): 1, ("chosen", 3): 1, ("rejected", 0): 2}
