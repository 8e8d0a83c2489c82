"""Small text helpers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def contains_any(lowered: Column, needles) -> Column:
    """True where the (already lower-cased) text holds one of the needles."""
    return any_of([lowered.contains(n) for n in needles])


def like_text(text: str) -> str:
    """A literal text as the inside of a LIKE pattern (escape character ``\\``)."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def holds(column: Column, text: str) -> Column:
    """Case-insensitive "contains this literal text"."""
    return F.lower(column).contains(text.lower())


def truncate(column: Column, limit: int) -> Column:
    """Trimmed text, cut at ``limit`` characters with an ellipsis when cut."""
    text = F.trim(column, F.lit(" \t\n\r\x0b\x0c"))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("…"))
    )


def excerpt(column: Column, pattern: str, radius: int = 70, max_length: int = 200) -> Column:
    """The text around the first match of ``pattern``, not the head of the value."""
    begin = F.regexp_instr(column, F.lit(pattern))  # 1-based, 0 = no match
    end = begin + F.length(F.regexp_extract(column, pattern, 0))  # one past the match
    low = F.greatest(F.lit(1), begin - radius)
    high = F.least(F.length(column) + 1, end + radius)
    shown = F.concat(
        F.when(low > 1, F.lit("…")).otherwise(""),
        F.substr(column, low, high - low),
        F.when(high <= F.length(column), F.lit("…")).otherwise(""),
    )
    return F.substring(F.translate(shown, "\n\r", "  "), 1, max_length)


def spreadsheet_safe(column: Column, also_control: bool = False) -> Column:
    """A cell a spreadsheet will not run as a formula."""
    leading = ["=", "+", "-", "@"] + (["\t", "\r"] if also_control else [])
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.when(F.substring(text, 1, 1).isin(leading), F.concat(F.lit("'"), text)).otherwise(text)


def fingerprint(source: Column, rule: Column, artifact: Column, line: Column) -> Column:
    """Identity of a finding: who says it, what it says, about what, on which line.

    A missing line and line 0 are the same as no line.
    """
    number = F.when(line == 0, F.lit("")).otherwise(F.coalesce(line.cast("string"), F.lit("")))
    parts = [F.coalesce(c, F.lit("None")) for c in (source, rule, artifact)] + [number]
    return F.substring(F.sha1(F.concat_ws("\u001f", *parts).cast("binary")), 1, 16)


def grouped_number(column: Column) -> Column:
    """An integer with thousands separators."""
    return F.format_number(column, 0)


def join_nonempty(separator: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: F.length(p) > 0), separator)


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed exactly here.

    A filter on a computed column is pushed below it and repeats the computation, once
    per use. Costly columns (a parsed line, decoded bytes) pass through a generator of one
    row instead, which a filter does not cross. It is narrow: no shuffle, no copy to disk.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
