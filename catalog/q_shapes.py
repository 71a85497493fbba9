"""Scores of snippets of many shapes: classes, async and nested functions, keyword-only arguments, branches, style faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import VIEWS, View, view
from catalog.registry import query, rounded
from prefmill.functions import codescore as S

_CLASS = """class C:
    def a(self, x: int) -> int:
        if x:
            return 1
        return 0

    def b(self, y, *, z: int = 1):
        return [i for i in y if i]"""

_NESTED = '''async def f(a: int) -> int:
    return a


def g(x: int, y) -> int:
    """Doc."""
    def h(z):
        return z if z else 0
    return h(x) or y'''

_FAULTS = "x = 1 \nif x:\n\ty = 2\nz = '" + "a" * 80 + "'\n# note\nw = 3"

_LEVELS = """def a(x: int):
    return x


def b(x: int, y) -> int:
    return x + y


def c(x: int, y: int) -> int:
    return x + y


def d() -> int:
    return 1


def e(x: int, *, y: int = 1) -> int:
    return x + y


def g(x, y: int) -> int:
    return x + y"""

_BRANCHES = """def f(a, b):
    for i in a:
        if i and b or a:
            continue
    else:
        pass
    while b:
        b -= 1
    try:
        assert a
    except ValueError:
        pass
    except KeyError:
        pass
    else:
        pass
    with open(a) as h:
        return h
    match a:
        case 1:
            return 2
        case _:
            return 3"""

_INNER = '''class A:
    """Doc."""
    x = 1 if True else 2

    class B:
        def m(self):
            """Doc."""
            return lambda q: q if q else 0'''

_BROKEN = "def f(:\n    pass"

_DECORATED = """import math


@property
def p(self, n: 'int' = 1, *args, **kw) -> 'str':
    '''Doc.'''
    # inner note
    return str(n)"""

#: Code; share of functions annotated at the three levels and documented; complexity; lines, comment lines and faulty lines.
SHAPES = (
    (_CLASS, (0.5, 0.5, 0.5), 0.0, 3.0, (8, 0, 0)),
    (_NESTED, (0.5, 0.5, 0.0), 0.5, 1.5, (9, 0, 0)),
    (_FAULTS, (0.0, 0.0, 0.0), 0.0, 0.0, (6, 1, 3)),
    (_LEVELS, (1.0, 4 / 6, 3 / 6), 0.0, 1.0, (22, 0, 0)),
    (_BRANCHES, (0.0, 0.0, 0.0), 0.0, 12.0, (23, 0, 0)),
    (_INNER, (0.0, 0.0, 0.0), 1.0, 2.0, (8, 0, 0)),
    (_BROKEN, None, None, None, (2, 0, 0)),
    (_DECORATED, (1.0, 1.0, 1.0), 1.0, 1.0, (8, 1, 0)),
)


def _by_shape(values) -> str:
    return f"CASE k % {len(SHAPES)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _number(value: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST({value!r} AS DOUBLE)"


_codes = ["'" + code.replace("'", "''") + "'" for code, *_ in SHAPES]
VIEWS["fx_shapes"] = View(
    f"SELECT k, {_by_shape(_codes)} || chr(10) || '# part ' || CAST(k AS STRING) AS code FROM (SELECT p_partkey AS k FROM part) t", tables=("part",)
)

_LEVEL = [_by_shape(_number(levels[i] if levels else None) for _, levels, *_ in SHAPES) for i in range(3)]
_DOCUMENTED = _by_shape(_number(documented) for _, _, documented, *_ in SHAPES)
_COMPLEXITY = _by_shape(_number(complexity) for _, _, _, complexity, _ in SHAPES)
# A last line with a comment is added to every snippet.
_STYLE = _by_shape(_number(None if levels is None else 1 - faults / (lines + 1)) for _, levels, _, _, (lines, _, faults) in SHAPES)
_DENSITY = _by_shape(_number(None if levels is None else (notes + 1) / (lines + 1)) for _, levels, _, _, (lines, notes, _) in SHAPES)


@query(
    "score_code_shapes",
    f"""
SELECT k, round({_LEVEL[2]}, 6) AS type_annotation_coverage, round({_DOCUMENTED}, 6) AS docstring_coverage,
       round({_COMPLEXITY}, 6) AS code_complexity, round({_STYLE}, 6) AS pep8_compliance, round({_DENSITY}, 6) AS comment_density
FROM fx_shapes""",
    ("fx_shapes",),
)
def score_code_shapes(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_shapes").select("k", S.score_code(F.col("code")).alias("m"))
    return rows.select("k", "m.*").select("k", *rounded(*S.CODE_METRICS))


@query(
    "annotation_levels_shapes",
    f"SELECT k, round({_LEVEL[0]}, 6) AS any_level, round({_LEVEL[1]}, 6) AS some_level, round({_LEVEL[2]}, 6) AS all_level FROM fx_shapes",
    ("fx_shapes",),
)
def annotation_levels_shapes(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_shapes").select("k", S.ast_scores(F.col("code")).alias("s"))
    named = zip(("any_level", "some_level", "all_level"), S.ANNOTATION_LEVELS)
    return rows.select("k", *[F.round(F.col(f"s.{field}"), 6).alias(name) for name, field in named])


@query("is_valid_python_shapes", f"SELECT k, {_by_shape(str(levels is not None).lower() for _, levels, *_ in SHAPES)} AS ok FROM fx_shapes", ("fx_shapes",))
def is_valid_python_shapes(spark, sf_dir):
    return view(spark, sf_dir, "fx_shapes").select("k", S.is_valid_python(F.col("code")).alias("ok"))
