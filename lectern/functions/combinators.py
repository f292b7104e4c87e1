"""Column combinators: replacing regular expression matches by an expression of the match, and reuse of values.

All are built-in expressions, so a chain of them stays in the JVM and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def let(value: Column, body: Fn) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def chain(text: Column, *steps: Fn) -> Column:
    """steps applied in turn, each to a value that is evaluated once."""
    for step in steps:
        text = let(text, step)
    return text


def regex_map(text: Column, pattern: str, replace: Fn) -> Column:
    """text with every match of pattern replaced by replace(match).

    Splitting and extracting walk the same matches, so pieces and replacements interleave. The text is evaluated
    once, so that nested calls don't multiply their expressions.
    """

    def over(t: Column) -> Column:
        spoken = F.concat(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), replace), F.array(F.lit("")))
        joined = F.array_join(F.zip_with(F.split(t, pattern, -1), spoken, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return let(text, over)


def group(match: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(match, pattern, n)


def literals(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Ordered literal replacements."""
    for raw, spoken in pairs:
        text = F.replace(text, F.lit(raw), F.lit(spoken))
    return text


def words_of(text: Column, pattern: str = r"[a-z]+(?:'[a-z]+)?") -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def only(words: Column, allowed: Iterable[str]) -> Column:
    """The words that are in a fixed set, in order."""
    listed = sorted(allowed)
    return F.filter(words, lambda w: w.isin(listed))


def counts(words: Column) -> Column:
    """map<word, count>, keys in alphabetical order, so that equal multisets are equal arrays of entries."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(words)), lambda w: F.struct(w, F.size(F.filter(words, lambda x: x == w)))))


def quote(literal: str) -> str:
    """A literal as a regular expression."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in literal)
