"""Infrastructure features (caches, queues, auth, …), frameworks and tech stack."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions import rules as R
from sourceweave.functions.lines import extract, first_extract, lines_of, sql_text


def feature_framework() -> Column:
    """First framework whose patterns occur anywhere in the column ``content``."""
    tests = [
        "when " + " or ".join(f"content rlike {sql_text('(?i)' + p)}" for p in patterns) + f" then '{name}'"
        for name, patterns in R.FRAMEWORK_PATTERNS.items()
    ]
    return F.expr(f"case {' '.join(tests)} else 'unknown' end")


def _first_hit(kind: str) -> str:
    """SQL of place and text of the first pattern of a feature type on line ``i`` of ``lines``; null when none matches."""
    cases, line = [], "get(lines, i)"
    for p in R.FEATURE_PATTERNS[kind]:
        ci = sql_text("(?i)" + p)
        cases.append(
            f"when {line} rlike {ci} then named_struct('pos', i, 'type', '{kind}', 'at', regexp_instr({line}, {ci}), 'text', regexp_extract({line}, {ci}, 0))"
        )
    return f"case {' '.join(cases)} end"


def _any_of(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {sql_text(w)})" for w in words) + ")"


def _needles(patterns: list[str]) -> list[str]:
    """Lower-case literals of which every match of the patterns contains at least one."""
    words = set()
    for p in patterns:
        pieces = re.split(r"\\[sw]\+|\.\*", p)
        words.add(max((re.sub(r"\\(.)", r"\1", x) for x in pieces), key=len).lower())
    return sorted(w for w in words if not any(o != w and o in w for o in words))


NEEDLES = {kind: _needles(patterns) for kind, patterns in R.FEATURE_PATTERNS.items()}


def detect_features(files: DataFrame) -> DataFrame:
    """Feature hits, one per (file, line, type): the first pattern of the type wins.

    Plain substring tests on the whole file decide which types can occur at
    all; only their patterns meet the lines, and files without any are not
    split. Only hits become rows, since a row carries its whole file. Name and
    settings are read from the text around the hit, which may reach over
    neighbouring lines, through the line array of the row.
    """
    src = files.select("project_id", "path", "content", F.lower("content").alias("low"))
    src = src.where(" or ".join(_any_of("low", words) for words in NEEDLES.values()))
    src = src.select("project_id", "path", feature_framework().alias("framework"), "low", lines_of(F.col("content")).alias("lines"), lines_of(F.col("low")).alias("lows"))
    tests = ", ".join(
        f"case when {_any_of('low', words)} then filter(transform(lows, (w, i) -> case when {_any_of('w', words)} then {_first_hit(kind)} end), h -> h.at is not null) end"
        for kind, words in NEEDLES.items()
    )
    hits = F.expr(f"flatten(array_compact(array({tests})))")
    rows = src.select("project_id", "path", "framework", "lines", F.explode_outer(hits).alias("h")).where("h.at is not null")
    rows = rows.select("*", (F.col("h.pos") + 1).alias("line_no"), F.expr("get(lines, h.pos)").alias("line"))
    at, text, lines, line_no = F.col("h.at"), F.col("h.text"), F.col("lines"), F.col("line_no")
    below = F.array_join(F.slice(lines, line_no, 202), "\n")
    lo = F.greatest(line_no - 51, F.lit(1))
    above = F.array_join(F.slice(lines, lo, line_no - lo), "\n")
    before = F.concat(F.when(line_no > 1, F.concat(above, F.lit("\n"))).otherwise(""), F.substr("line", F.lit(1), at - 1))
    context = F.concat(F.substr(before, F.greatest(F.length(before) - 49, F.lit(1))), F.substr(below, at, F.length(text) + 200))
    ahead = F.substr(below, at, F.lit(200))
    name = text
    for kind, patterns in R.FEATURE_NAME_PATTERNS.items():
        name = F.when(F.col("h.type") == kind, F.coalesce(first_extract(ahead, patterns), text)).otherwise(name)
    return rows.select(
        "project_id",
        "path",
        "line_no",
        F.col("h.type").alias("type"),
        name.alias("name"),
        "framework",
        extract(context, R.FEATURE_CONFIG["host"]).alias("host"),
        extract(context, R.FEATURE_CONFIG["port"]).cast("int").alias("port"),
        extract(context, R.FEATURE_CONFIG["url"]).alias("url"),
    )


def feature_summary(features: DataFrame) -> DataFrame:
    """Count and names (in line order) by type and file; a group never exceeds one file."""
    names = F.array_sort(F.collect_list(F.struct("line_no", "name")))
    return features.groupBy("project_id", "path", "type").agg(
        F.count("*").alias("n"), F.array_join(F.transform(names, lambda x: x["name"]), ",").alias("names")
    )


def tech_stack(files: DataFrame) -> DataFrame:
    """Technologies of each project from marker files, package.json and requirements.txt at its root."""
    path = F.col("path")
    markers = {f: tech for tech, names in R.TECH_MARKERS.items() for f in names}
    root = files.where(path.isin(list(markers)))
    by_file = F.try_element_at(F.create_map(*[F.lit(x) for kv in markers.items() for x in kv]), path)
    sections = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    packages = F.concat(
        *[F.coalesce(F.map_keys(sections[s]), F.array().cast("array<string>")) for s in ("dependencies", "devDependencies")]
    )
    by_package = F.when(
        path == "package.json",
        F.array(*[F.when(F.array_contains(packages, p), tech) for p, tech in R.TECH_PACKAGES.items()]),
    )
    low = F.lower("content")
    by_requirement = F.when(
        path == "requirements.txt", F.array(*[F.when(low.contains(w), tech) for w, tech in R.TECH_REQUIREMENTS.items()])
    )
    empty = F.array().cast("array<string>")
    techs = F.array_compact(F.concat(F.array(by_file), F.coalesce(by_package, empty), F.coalesce(by_requirement, empty)))
    return root.select("project_id", F.explode(techs).alias("technology")).distinct()
