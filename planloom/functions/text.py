"""Text column helpers with the whitespace and digit rules of Unicode-aware text handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, written out so that every regex engine agrees.
SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WORD_CHAR = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    # Looks at the ends of the text only, where a pattern would walk all of it.
    return F.btrim(c, F.lit(SPACE_CHARS))


def folded(c: Column) -> Column:
    """A key under which texts are equal that differ in case only: ß is ss, a ligature its letters, a
    final sigma a sigma. Upper-casing maps these together and lower-casing undoes the rest. The
    dotless i alone is not the i it is upper-cased to, so a noncharacter stands for it meanwhile, and
    the capital sharp s is already upper case, so the small one does. Taking the i back also parts the two calls, of which the optimizer would keep the outer one only."""
    upper = F.upper(F.translate(c, "\u0131\u1e9e", "\ufdd0\u00df"))
    return F.lower(F.translate(upper, "\ufdd0", "\u0131"))


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def or_none(c: Column) -> Column:
    """Empty text as NULL, for use inside coalesce."""
    return F.when(c != "", c)


def has_digit(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"\p{Nd}")


def contains_any(text: Column, needles: list[str]) -> Column:
    """Substring test against a fixed list, as one alternation."""
    return text.rlike("|".join(_quote(n) for n in needles))


def mentions_any(text: Column, words: list[str]) -> Column:
    """Whole-word test against a fixed list, as one alternation."""
    body = "|".join(_quote(w) for w in words)
    return text.rlike(rf"(?<![{WORD_CHAR}])(?:{body})(?![{WORD_CHAR}])")


def _quote(literal: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in literal)


def quoted(c: Column) -> Column:
    """In single quotes; in double ones if the text holds a single quote and no double one."""
    single = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(single)


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100).cast("int").cast("string"), F.lit("%"))
