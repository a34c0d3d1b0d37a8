"""Line and regex helpers on Columns; everything works inside one file row.

Operators unnest computed arrays with the ``*_outer`` generators and drop the
null rows: the plain generators make the optimizer infer ``size(array) > 0``
below them, which would evaluate the whole array expression a second time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceweave.functions.rules import Rule


def lines_of(content: Column) -> Column:
    return F.split(content, "\n", -1)


def strip(text: Column) -> Column:
    """Trim any white space on both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, null when there is none or the group is empty."""
    return non_empty(F.regexp_extract(text, pattern, group))


def first_extract(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches."""
    return F.coalesce(*[extract(text, p) for p in patterns])


def first_of(rows: Column) -> Column:
    return F.try_element_at(rows, F.lit(1))


def first_in(window: Column, pattern: str, group: int = 1) -> Column:
    """First non-empty extract over an array of lines."""
    return first_of(F.filter(F.transform(window, lambda x: extract(x, pattern, group)), lambda x: x.isNotNull()))


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def contains_all(text: Column, words: list[str]) -> Column:
    hit = F.lit(True)
    for word in words:
        hit = hit & text.contains(word)
    return hit


def sql_text(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_matches(line: str, rules: list[Rule]) -> Column:
    """All matches of all rules on the column ``line``: ``array<struct<rule, kind, a, b>>`` in rule order.

    Built as one SQL expression, which is much quicker to plan than a tree of
    Column calls per rule.
    """
    parts = []
    for ordinal, rule in enumerate(rules):
        found = [f"regexp_extract_all({line}, {sql_text(rule.pattern)}, {g})" for g in rule.groups]
        second = f"get({found[1]}, i)" if len(found) > 1 else "''"
        parts.append(f"transform({found[0]}, (x, i) -> named_struct('rule', {ordinal}, 'kind', '{rule.kind}', 'a', x, 'b', {second}))")
    return F.expr(f"flatten(array({', '.join(parts)}))")


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), 1), F.initcap), "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body(value)``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def segments(marks: Column, n_lines: Column, first_name: str) -> Column:
    """Cut the lines of a file at ``marks`` (array of ``struct<at, name>`` in line order).

    Returns disjoint ``struct<first, length, name>`` ranges that cover the file;
    lines before the first mark belong to ``first_name``.
    """
    head = F.array(F.struct(F.lit(1).alias("at"), F.lit(first_name).alias("name")))
    return let(
        F.concat(head, marks),
        lambda m: F.transform(
            m,
            lambda s, i: F.struct(
                s["at"].alias("first"),
                (F.coalesce(F.get(m, i + 1)["at"], n_lines + 1) - s["at"]).alias("length"),
                s["name"].alias("name"),
            ),
        ),
    )
