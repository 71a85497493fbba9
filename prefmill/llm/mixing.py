"""Operator 4, mixing sources to target weights, by DataFrame functions only.

Tokens are summed per source, each source gets a target share of all tokens, and the ratio of both is
its repetition rate. A document is emitted floor(rate) times, and once more if a number drawn from the
hash of its id and a seed lies below the rate's fraction: the same copies in every run.

Defined results: null texts have size 0; null sources are one source, last in order; a null id draws
like any other value. Rows with equal ids draw the same number. Empty tables give empty results. Input
columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmill.llm.tables import cut, free

WEIGHTS = (5, 2, 1)
MOST = 3.0
ADDED = ("size", "source_size", "target", "rate", "copies")
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 up to 1: the first 52 bits of the MD5 of id and seed, which any SQL engine can repeat.

    The text's MD5 stands in for a null id. Rows of one id, and rows without an id that hold equal texts, draw one number.
    """
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """Each source's place in code-point order, null last, from 0.

    The sort spreads over tasks; a task's rows get their place from the running number within it plus the
    rows of the tasks before, one number per task.
    """
    ordered = cut(
        sources.orderBy(F.col(name).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources"
    )
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg((F.max("_at") - F.min("_at") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("place", low + F.col("_before"))
        .drop("_part", "_before", "_at")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds ``target`` and ``rate`` to rows (source, source_size).

    All tokens are shared by weight; a target above ``most`` times its source's size is set to that and the
    excess shared again among the others, until none is above. Each round is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    table = cut(
        ranked(sizes, "source").withColumn("weight", weight.cast("double")).withColumn("most", most * F.col("source_size")),
        "weights",
    )
    share = 0.0
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("most") <= share * F.col("weight")
        rest = table.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not rest["weight"]:
            break
        larger = (total - rest["given"]) / rest["weight"]
        if larger <= share:
            break
        share = larger
    target = F.least(F.col("most"), F.lit(share) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return table.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def _marked(
    docs: DataFrame, names: dict[str, str], doc_id: str, text: str, source: str, weights: tuple[int, ...], most: float, seed: int
) -> DataFrame:
    """The documents with the columns of ``ADDED`` under other names.

    Sources are few against documents and are joined by Spark's choice of plan: broadcast while they
    measure below its limit, else a skew-splitting join.
    """
    sums = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    key = free(docs, "_source")
    right = targets.select(F.col("source").alias(key), *[F.col(c).alias(names[c]) for c in ("source_size", "target", "rate")])
    sized = docs.withColumn(names["size"], word_count(F.col(text)))
    joined = sized.join(right, F.col(source).eqNullSafe(F.col(key))).drop(key)
    rate = F.col(names["rate"])
    more = (draw(F.col(doc_id), F.col(text), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(names["copies"], F.floor(rate) + more)


def copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: float = MOST,
    seed: int = 41,
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``."""
    names = {c: free(docs, f"_{c}") for c in ADDED}
    marked = _marked(docs, names, doc_id, text, source, weights, most, seed)
    return marked.select(*[c for c in docs.columns if c not in ADDED], *[F.col(n).alias(c) for c, n in names.items()])


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: float = MOST,
    seed: int = 41,
) -> DataFrame:
    """One row for each copy taken, with the input's columns and the copy's number from 0 (``copy``)."""
    names = {c: free(docs, f"_{c}") for c in ADDED}
    chosen = _marked(docs, names, doc_id, text, source, weights, most, seed).filter(F.col(names["copies"]) > 0)
    numbers = F.sequence(F.lit(0).cast("long"), F.col(names["copies"]) - 1)
    return chosen.select(*[c for c in docs.columns if c != "copy"], F.explode(numbers).alias("copy"))
