"""String functions whose results must equal Python's: strip, split, words, borders, tags. All are JVM-side columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and str.split take for white space, and a word character of its regular expressions.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NO_SPACE = SPACE.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]"
BORDER = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NO_TERM = r"[^\p{L}\p{N}_\-]"
THINK = r"(?s)<think>(.*?)</think>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once per row, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, SPACE + "+"), lambda t: t != "")


def or_default(c: Column, default: Column | str) -> Column:
    """Null and '' fall through."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def pattern(python: str) -> str:
    """A Java pattern for one that says \\b and \\s in Python's sense; its outer borders stand next to letters."""
    inner = python.removeprefix(r"\b").removesuffix(r"\b")
    before, after = rf"(?<!{WORD})" * python.startswith(r"\b"), rf"(?!{WORD})" * python.endswith(r"\b")
    return before + inner.replace(r"\b", BORDER).replace(r"\s", SPACE) + after


def normalize(c: Column) -> Column:
    """Lower case, only word characters, hyphens and single spaces."""
    return strip(F.regexp_replace(F.lower(c), NO_TERM + "+", " "))


def spaced(c: Column) -> Column:
    return F.translate(c, "-", " ")


def has_think(c: Column) -> Column:
    return c.rlike(THINK)


def first_think(c: Column) -> Column:
    """Content of the first closed think block as it stands; null if there is none."""
    return F.when(has_think(c), F.regexp_extract(c, THINK, 1))


def without_think(c: Column) -> Column:
    return strip(F.regexp_replace(c, THINK, ""))


def reasoning(c: Column) -> tuple[Column, Column]:
    """(thinking trace or null, answer): the answer is what stands outside all think blocks."""
    return strip(first_think(c)), F.when(has_think(c), without_think(c)).otherwise(strip(c))


def tagged_answer(c: Column) -> Column:
    """The first answer block if reasoning is closed, else what follows the last closing think tag, else the text."""
    answer = r"(?s)<answer>(.*?)</answer>"
    closed = F.contains(c, F.lit("<think>")) & F.contains(c, F.lit("</think>"))
    rest = strip(F.substring_index(c, "</think>", -1))
    return F.when(closed & c.rlike(answer), strip(F.regexp_extract(c, answer, 1))).when(closed, rest).otherwise(c)


def message_text(messages: Column) -> Column:
    """Text of a completion given as array<struct<role, content>>: contents joined by line feeds."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def variant_text(v: Column) -> Column:
    """Text of a completion of any shape, held as VARIANT: a string, a message, or an array of these.

    A message without content is empty. Scalars read as Python writes them; an object or array where a text should be reads as JSON.
    """

    def scalar(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        flag = F.initcap(F.try_variant_get(x, "$", "string"))
        deep = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", flag).when(deep, F.to_json(x)).otherwise(F.try_variant_get(x, "$", "string"))

    def content(x: Column) -> Column:
        inner = F.try_variant_get(x, "$.content", "variant")
        return F.when(inner.isNull(), "").otherwise(scalar(inner))

    piece = lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), content(x)).otherwise(scalar(x))
    many = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), piece), "\n")
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), many).otherwise(piece(v))


def completion_text(completion) -> str:
    """The text of a completion as a trainer hands it over: a string, a message, or a list of these."""
    piece = lambda x: str(x.get("content", "")) if isinstance(x, dict) else str(x)
    return "\n".join(map(piece, completion)) if isinstance(completion, list) else piece(completion)


def json_string(c: Column) -> Column:
    """The JSON literal of a string, non-ASCII characters as they are."""
    whole = F.to_json(F.struct(c.alias("c")))
    return F.substring(whole, 6, F.length(whole) - 6)


def slug(name: str) -> str:
    """A file name part from a model's name."""
    import re

    return re.sub(r"[^\w-]", "_", name)
