import re

from pyspark.sql import functions as F

from prefmill.functions import codetext as C

X = F.col("x")


def test_fences(column):
    texts = [
        "```python\na = 1\n```\ntext\n```\nb\n```",
        "```\n```",
        "```\n\n```",
        "```python3\na\n```",
        "```python\na```",
        "```python\r\na\r\n```",
        "no code",
        "```\na\n```\n```\nb\n```\nc\n```",
        "x ```python\nfirst\n\nsecond\n``` y",
    ]
    fence = re.compile(r"```(?:python)?\n(.*?)\n```", re.S)
    assert column(C.extract_fences(X), texts) == [fence.findall(t) for t in texts]


def test_clean_blocks(column):
    blocks = [
        ["pip install a\nimport b", "pip install only"],
        ["ab\ncd"],
        ["abc"],
        [""],
        [],
        [" pip install kept", "x\npip install y\nlonger"],
    ]
    expected = [["import b"], [], ["abc"], [], [], [" pip install kept", "x\nlonger"]]
    assert column(C.clean_blocks(X), blocks, "array<string>") == expected


def test_assemble_script(column):
    blocks = [
        ["import a\nimport a\nx = 1", "import a\nfrom b import c\n    import a"],
        ["pip install z\ny", "y"],
        [],
        ["from q import r", "from q import r"],
    ]
    expected = [
        "\n".join(["import a", "x = 1", "\n", "from b import c", "    import a", "\n"]),
        "\n".join(["y", "\n", "y", "\n"]),
        "",
        "\n".join(["from q import r", "\n", "\n"]),
    ]
    assert column(C.assemble_script(X), blocks, "array<string>") == expected


def test_comment_density(column):
    texts = {
        "": 0.0,
        "\n": 0.0,
        "# a": 1.0,
        "# a\nb\n": 0.5,
        "a # b": 0.0,
        "\u00a0#x\r\n\u3000# y\ry\x0b\x1f#": 0.75,
        "\t  # z\u2028#": 1.0,
        "a\n\n#\n\n": 0.25,
    }
    assert column(C.comment_density(X), list(texts)) == list(texts.values())


def test_comment_density_against_python(column):
    texts = ["#\n#\n#", "x\n  #\n\n#y", "a\r#b\r\n\x1c# c", "##", "# a\n" * 50 + "b"]
    lines = [t.splitlines() for t in texts]
    expected = [sum(s.strip()[:1] == "#" for s in ls) / len(ls) for ls in lines]
    assert column(C.comment_density(X), texts) == expected


def test_style_compliance(column):
    texts = {"": 1.0, "a\nb": 1.0, "a \nb": 0.5, "\tif a:\nb": 0.5, "x" * 80: 0.0, "é" * 79: 1.0, "  \tx\ny\nz\t\nw": 0.5, "a\tb": 1.0}
    assert column(C.style_compliance(X), list(texts)) == list(texts.values())
