"""Scores that need the code parsed: the only functions here that leave the JVM.

Arrow batches go to the Python workers, the standard ``ast`` module parses each snippet once, and all
parse-based scores of that snippet come back in one struct. Line-based scores stay built-in
expressions and are joined to the struct here. Results follow the Python version of the workers.

Complexity is the McCabe count over functions, methods and classes. A function counts 1, plus one for
each ``if`` and conditional expression, loop, loop ``else``, ``except``, ``try`` ``else``, assert,
comprehension and each of its ``if``s, extra boolean operand, and ``match`` case other than a bare
default. Nested functions and lambdas are no blocks of their own. A class counts its methods and body
together, averaged over the methods. ``with`` adds nothing.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from prefmill.functions.codetext import comment_density, extract_fences, style_compliance
from prefmill.functions.text import strip_text
from prefmill.schemas import AST_SCORES

# Names that are not counted as arguments, and the metric names of results.
RECEIVERS = ("self", "cls")
CODE_METRICS = (
    "type_annotation_coverage",
    "docstring_coverage",
    "code_complexity",
    "pep8_compliance",
    "comment_density",
)

#: Annotation level -> field of the scorer: any annotation, return and some argument, return and all.
ANNOTATION_LEVELS = ("annotation_any", "annotation_some", "annotation_all")

#: What the parser says of a text that is no Python.
_UNPARSABLE = (SyntaxError, ValueError, RecursionError)

#: The parser's own limit on nesting comes as a memory error with this text.
_TOO_DEEP = "stack overflow"


def _parse(code: str) -> ast.Module | None:
    """The syntax tree, None when there is none. A worker short of memory says nothing of the text, so its task fails."""
    try:
        return ast.parse(code)
    except _UNPARSABLE:
        return None
    except MemoryError as error:
        if _TOO_DEEP in str(error):
            return None
        raise


def _quietly(work: Callable[[pa.Array], list], batch: pa.Array) -> list:
    """Run over a batch without the warnings that odd snippets raise."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return work(batch)


def _bare_cases(node: ast.Match) -> int:
    """Whether a match has a case that takes anything."""
    return any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None for c in node.cases)


def _one(node: ast.AST) -> int:
    return 1


def _loop(node: ast.For) -> int:
    return 1 + bool(node.orelse)


def _handlers(node: ast.Try) -> int:
    return len(node.handlers) + bool(node.orelse)


#: Branches that one node adds by itself.
_BRANCHES: dict[type, Callable[[ast.AST], int]] = {
    ast.If: _one,
    ast.IfExp: _one,
    ast.Assert: _one,
    ast.For: _loop,
    ast.AsyncFor: _loop,
    ast.While: _loop,
    ast.Try: _handlers,
    ast.TryStar: _handlers,
    ast.BoolOp: lambda node: len(node.values) - 1,
    ast.comprehension: lambda node: 1 + len(node.ifs),
    ast.Match: lambda node: max(0, len(node.cases) - _bare_cases(node)),
}

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_CLOSED = (ast.Name, ast.Constant, ast.Assert, ast.Import, ast.ImportFrom, ast.Pass)

#: Fields that hold names, operators and contexts: nothing below them is counted.
_PLAIN_FIELDS = {"ctx", "op", "ops", "id", "attr", "name", "arg", "kind", "type_comment", "type_params"}


class _Block:
    """A function, method, class or module with the branches that belong to it."""

    __slots__ = ("branches", "kind", "methods")

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self.branches = 0
        self.methods: list[_Block] = []

    def complexity(self) -> int:
        whole = 1 + self.branches + sum(m.complexity() for m in self.methods)
        if not self.methods:
            return whole
        return whole // len(self.methods) + (len(self.methods) > 1)


def _walk(tree: ast.Module) -> tuple[list[ast.FunctionDef], list[_Block]]:
    """All plain function definitions, and the blocks whose complexity counts; each node is met once.

    Below a function only definitions are looked for: what is nested there is no block of its own.
    """
    definitions: list[ast.FunctionDef] = []
    blocks: list[_Block] = []
    fields: dict[type, list[str]] = {}
    bodies: list[tuple[list[ast.stmt], _Block]] = [(tree.body, _Block("module"))]
    while bodies:
        body, owner = bodies.pop()
        pending: list[ast.AST] = list(body)
        while pending:
            node = pending.pop()
            kind = type(node)
            if kind in _BRANCHES:
                owner.branches += _BRANCHES[kind](node)
            if kind in _CLOSED:
                continue
            if kind in _FUNCTIONS:
                if kind is ast.FunctionDef:
                    definitions.append(node)
                block = _Block("function")
                if owner.kind == "class":
                    owner.methods.append(block)
                if owner.kind in ("module", "class"):
                    blocks.append(block)
                bodies.append((node.body, block))
            elif kind is ast.ClassDef:
                block = _Block("class" if owner.kind == "module" else "inner")
                if owner.kind == "module":
                    blocks.append(block)
                bodies.append((node.body, block))
            else:
                names = fields.get(kind)
                if names is None:
                    names = fields[kind] = [f for f in kind._fields if f not in _PLAIN_FIELDS]
                for name in names:
                    child = getattr(node, name, None)
                    if isinstance(child, list):
                        pending.extend(c for c in child if isinstance(c, ast.AST))
                    elif isinstance(child, ast.AST):
                        pending.append(child)
    return definitions, blocks


def _score(code: str | None) -> dict[str, float] | None:
    """Parse-based scores of one snippet, None when it does not parse."""
    tree = None if code is None else _parse(code)
    if tree is None:
        return None
    definitions, blocks = _walk(tree)
    any_ = some = full = documented = 0
    for node in definitions:
        named = [a.annotation is not None for a in node.args.args if a.arg not in RECEIVERS]
        returns = node.returns is not None
        any_ += returns or any(named)
        some += returns and any(named)
        full += returns and all(named)
        documented += bool(ast.get_docstring(node))

    def share(n: int) -> float:
        return n / len(definitions) if definitions else 0.0

    return {
        "annotation_any": share(any_),
        "annotation_some": share(some),
        "annotation_all": share(full),
        "docstring_coverage": share(documented),
        "code_complexity": sum(b.complexity() for b in blocks) / len(blocks) if blocks else 0.0,
    }


_SCORES = to_arrow_type(AST_SCORES)


@F.arrow_udf(T.BooleanType())
def is_valid_python(code: pa.Array) -> pa.Array:
    """Whether a text parses as Python; null for null, so rows can be left out by passing null."""

    def check(batch: pa.Array) -> list[bool | None]:
        return [None if c is None else _parse(c) is not None for c in batch.to_pylist()]

    return pa.array(_quietly(check, code), pa.bool_())


@F.arrow_udf(AST_SCORES)
def ast_scores(code: pa.Array) -> pa.Array:
    """Parse-based scores of a snippet, null when it does not parse."""
    return pa.array(_quietly(lambda batch: [_score(c) for c in batch.to_pylist()], code), _SCORES)


@F.arrow_udf(T.ArrayType(AST_SCORES))
def ast_scores_each(blocks: pa.Array) -> pa.Array:
    """:func:`ast_scores` of every snippet of a list."""

    def score(batch: pa.Array) -> list[list | None]:
        return [None if row is None else [_score(c) for c in row] for row in batch.to_pylist()]

    return pa.array(_quietly(score, blocks), pa.list_(_SCORES))


# The workers get these functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def code_metrics(code: Column, scores: Column, level: int = 2) -> Column:
    """The five metrics of a snippet from its scorer struct; all null when it does not parse."""
    parsed = scores.isNotNull()
    return F.struct(
        scores.getField(ANNOTATION_LEVELS[level]).alias("type_annotation_coverage"),
        scores.getField("docstring_coverage").alias("docstring_coverage"),
        scores.getField("code_complexity").alias("code_complexity"),
        F.when(parsed, style_compliance(code)).alias("pep8_compliance"),
        F.when(parsed, comment_density(code)).alias("comment_density"),
    )


def score_code(code: Column, level: int = 2) -> Column:
    """The five metrics of one snippet as a struct. Bind it once and read its fields."""
    return code_metrics(code, ast_scores(code), level)


def score_blocks(blocks: Column, level: int = 2) -> Column:
    """The five metrics of every block, as an array in block order."""
    return F.zip_with(blocks, ast_scores_each(blocks), lambda b, s: code_metrics(b, s, level))


def extract_code(text: Column) -> Column:
    """Fenced blocks, else the whole stripped text when it is valid Python, else no block.

    Only texts without a fence are sent to the parser.
    """
    fences = extract_fences(text)
    whole = strip_text(text)
    candidate = F.when(F.size(fences) == 0, whole)
    return (
        F.when(F.size(fences) > 0, fences)
        .when(is_valid_python(candidate), F.array(whole))
        .otherwise(F.array().cast("array<string>"))
    )
