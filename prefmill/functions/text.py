"""Line, blank and token expressions on text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a line, and those that count as blank, in Python text.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
INLINE_BLANKS = (
    "\t \x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)
BLANKS = LINE_ENDS + INLINE_BLANKS

#: One-character class of the line ends below U+0100; the regex engine tests those by table.
SHORT_LINE_ENDS = "".join(c for c in LINE_ENDS if c < "\u0100")
LINE_BREAK = f"[{SHORT_LINE_ENDS}]"

#: Default tokeniser: a run of letters, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]++|[^\p{L}\p{N}_ \t\n\x0B\f\r]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_text(text: Column) -> Column:
    """Text without blanks at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def plain_breaks(text: Column) -> Column:
    """The text with two-character and far line ends written as line feeds."""
    for end in ("\r\n", *(c for c in LINE_ENDS if c not in SHORT_LINE_ENDS)):
        text = F.replace(text, F.lit(end), F.lit("\n"))
    return text


def line_count(plain: Column) -> Column:
    """Number of lines of a :func:`plain_breaks` text; a break at the very end opens no further line."""
    unfinished = (plain != "") & ~F.substring(plain, -1, 1).isin(*SHORT_LINE_ENDS)
    return F.regexp_count(plain, F.lit(LINE_BREAK)) + unfinished.cast("int")


def split_lines(text: Column) -> Column:
    """The lines of a text, without their breaks; no line for an empty text."""

    def finished(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return let(F.split(plain_breaks(text), LINE_BREAK, -1), finished)


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """The tokens of a text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_count(text: Column, pattern: str = TOKEN) -> Column:
    """Number of tokens of a text."""
    return F.regexp_count(text, F.lit(pattern))


def json_string(text: Column) -> Column:
    """A text as a JSON string literal, quotes included."""
    wrapped = F.to_json(F.array(text))
    return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)


def list_repr(items: Column) -> Column:
    """A list of texts written the way Python prints it: ``['a', 'b']``."""

    def quoted(item: Column) -> Column:
        escaped = item
        for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(plain), F.lit(written))
        single, double = item.contains("'"), item.contains('"')
        return (
            F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"')))
            .when(single, F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
            .otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def fill(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` places of a template; doubled braces are literal braces."""
    from string import Formatter

    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(fields[field])
    return F.concat(*parts)
