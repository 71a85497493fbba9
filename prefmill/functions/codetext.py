"""Python code inside text, as built-in string and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefmill.functions.text import INLINE_BLANKS, LINE_BREAK, let, line_count, plain_breaks, split_lines

# The fence pattern, line prefixes and limits that decide what counts as code.
FENCE = "(?s)```(?:python)?\n(.*?)\n```"
INSTALL_PREFIX = "pip install "
IMPORT_PREFIXES = ("import ", "from ")
SHORT_LINE = 2
STYLE_MAX_LINE = 79

COMMENT_LINE = f"{LINE_BREAK}[{INLINE_BLANKS}]*+#"


def extract_fences(text: Column) -> Column:
    """Bodies of the fenced blocks of a text, in order."""
    return F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))


def _is_install(line: Column) -> Column:
    return line.startswith(INSTALL_PREFIX)


def _kept_lines(block: Column) -> Column:
    return F.filter(F.split(block, "\n"), lambda line: ~_is_install(line))


def clean_blocks(blocks: Column) -> Column:
    """Blocks without install lines; a block stays when its longest line has over two characters."""
    kept = F.filter(
        F.transform(blocks, _kept_lines),
        lambda lines: F.array_max(F.transform(lines, F.length)) > SHORT_LINE,
    )
    return F.transform(kept, lambda lines: F.array_join(lines, "\n"))


def assemble_script(blocks: Column) -> Column:
    """All blocks as one script: no install lines, each top-level import line once, a gap after each block."""
    all_lines = F.flatten(F.transform(blocks, lambda b: F.concat(_kept_lines(b), F.array(F.lit("\n")))))

    def is_import(line: Column) -> Column:
        return line.startswith(IMPORT_PREFIXES[0]) | line.startswith(IMPORT_PREFIXES[1])

    def once(lines: Column) -> Column:
        return F.filter(
            lines, lambda line, i: ~is_import(line) | (F.array_position(lines, line) == i + 1)
        )

    return F.array_join(let(all_lines, once), "\n")


def comment_density(code: Column) -> Column:
    """Share of lines whose first visible character is ``#``; 0 for an empty text.

    Most texts hold no ``#`` at all and are not scanned for lines.
    """

    def share(plain: Column) -> Column:
        comments = F.regexp_count(F.concat(F.lit("\n"), plain), F.lit(COMMENT_LINE))
        return comments / line_count(plain)

    return F.when(~code.contains("#"), F.lit(0.0)).otherwise(let(plain_breaks(code), share))


def style_compliance(code: Column) -> Column:
    """Share of lines without a plain style fault; 1 for an empty text.

    Faults: over 79 characters, a tab in the indentation, a blank at the end of the line.
    """

    def faulty(line: Column) -> Column:
        tabbed = F.ltrim(line).startswith("\t")
        return (F.length(line) > STYLE_MAX_LINE) | line.endswith(" ") | line.endswith("\t") | tabbed

    def clean_share(lines: Column) -> Column:
        return F.lit(1.0) - F.size(F.filter(lines, faulty)) / F.size(lines)

    return F.when(code == "", F.lit(1.0)).otherwise(let(split_lines(code), clean_share))
