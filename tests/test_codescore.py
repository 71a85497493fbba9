import ast

import pytest
from pyspark.sql import functions as F

from prefmill.functions import codescore as S

X = F.col("x")


def score(code):
    return S._score(code)


@pytest.mark.parametrize(
    ("code", "levels"),
    [
        ("", (0, 0, 0)),
        ("x = lambda a: a", (0, 0, 0)),
        ("def f(): pass", (0, 0, 0)),
        ("def f() -> int: pass", (1, 0, 1)),
        ("def f(a: int): pass", (1, 0, 0)),
        ("def f(a: int, b) -> int: pass", (1, 1, 0)),
        ("def f(a: int, b: int) -> int: pass", (1, 1, 1)),
        ("class A:\n  def f(self, a: int) -> int: pass", (1, 1, 1)),
        ("class A:\n  def f(self) -> int: pass", (1, 0, 1)),
        ("def f(*, a) -> int: pass", (1, 0, 1)),
        ("async def f(a: int) -> int: pass", (0, 0, 0)),
        ("def f(a: int) -> int:\n  def g(b): pass", (0.5, 0.5, 0.5)),
    ],
)
def test_annotation_levels(code, levels):
    got = score(code)
    assert tuple(got[name] for name in S.ANNOTATION_LEVELS) == levels


@pytest.mark.parametrize(
    ("code", "share"),
    [
        ("", 0),
        ('def f():\n  """Doc."""', 1),
        ('def f():\n  ""', 0),
        ('def f():\n  x = 1\n  "late"', 0),
        ('def f():\n  "a"\ndef g(): pass', 0.5),
        ('async def f():\n  "a"', 0),
        ('class A:\n  "a"\n  def m(self):\n    "b"', 1),
    ],
)
def test_docstrings(code, share):
    assert score(code)["docstring_coverage"] == share


@pytest.mark.parametrize(
    ("code", "mean"),
    [
        ("", 0.0),
        ("if a:\n  b", 0.0),
        ("def f(): pass", 1),
        ("def f(a):\n  if a and b or c: pass\n  elif d: pass", 5),
        ("def f(a):\n  for x in a: pass\n  else: pass\n  while a: pass", 4),
        ("def f(a):\n  try: pass\n  except A: pass\n  except B: pass\n  else: pass\n  finally: pass", 4),
        ("def f(a):\n  assert a and b\n  return [x for x in a if x if y]", 5),
        ("def f(a):\n  return 1 if a else 2", 2),
        ("def f(a):\n  with a: pass", 1),
        ("def f(a):\n  match a:\n    case 1: pass\n    case 2: pass\n    case _: pass", 3),
        ("def f(a):\n  def g():\n    if a: pass\n  return g", 1),
        ("async def f(a):\n  async for x in a: pass", 2),
        ("class A: pass", 1),
        ("class A:\n  def f(self): pass", 1.5),
        ("class A:\n  def f(self): pass\n  def g(self):\n    if a: pass", (3 + 1 + 2) / 3),
        ("if x:\n  def f(): pass\ndef g():\n  if a: pass", 1.5),
    ],
)
def test_complexity(code, mean):
    assert score(code)["code_complexity"] == pytest.approx(mean)


@pytest.mark.parametrize("code", ["def f(", "a b", "x = '\ud800'", "\0", "(" * 5000, "  a\nb", None])
def test_unparsable_gives_nothing(code):
    assert score(code) is None


def test_deep_code_is_walked_without_recursion():
    code = "x = " + "+".join(["1"] * 900)
    assert score(code)["code_complexity"] == 0.0
    nested = ast.parse("a")
    node = nested.body[0].value
    for _ in range(50_000):
        node = ast.UnaryOp(op=ast.Not(), operand=node)
    nested.body[0].value = node
    assert S._walk(nested) == ([], [])


def test_score_code_struct(column):
    code = "# c\ndef f(a: int) -> int:\n    return a "
    good, bad, none = column(S.score_code(X), [code, "def f(", None])
    assert good.asDict() == {
        "type_annotation_coverage": 1.0,
        "docstring_coverage": 0.0,
        "code_complexity": 1.0,
        "pep8_compliance": pytest.approx(2 / 3),
        "comment_density": pytest.approx(1 / 3),
    }
    assert set(bad.asDict().values()) == {None}
    assert set(none.asDict().values()) == {None}


def test_levels_pick_the_annotation_field(column):
    code = "def f(a: int, b) -> int: pass"
    assert [column(S.score_code(X, level), [code])[0].type_annotation_coverage for level in (0, 1, 2)] == [1, 1, 0]


def test_extract_code(column):
    texts = ["```\na b\n```", " x = 1 \n", "hello there", "", "```python\nx\n```\n```\ny\n```", "\u3000y = 2\x1f"]
    assert column(S.extract_code(X), texts) == [["a b"], ["x = 1"], [], [""], ["x", "y"], ["y = 2"]]


def test_score_blocks(column):
    rows = column(S.score_blocks(X), [["x = 1", "def f("], [], None], "array<string>")
    assert [[m.code_complexity for m in r] if r is not None else None for r in rows] == [[0.0, None], [], None]
