"""URL rules by a sort-merge range join.

Hosts are reversed label by label (``blog.example.net`` becomes
``net.example.blog.``), so "this host and all its subdomains" is a prefix and a
prefix is an interval of the sorted keys. URLs and rules are dealt to key ranges,
sorted, and swept once; a stack holds the rules whose interval is open, the most
nested host on top.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sourceweave.llm.common import parallelism, smallest_hashes

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: URLs sampled for each key range, for fences that deal the rows out evenly.
SAMPLE = 64

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty for null or a URL without ``://``."""
    split = df.withColumn("_url", F.coalesce(F.col(url), F.lit(""))).withColumn("host", host_of(F.col("_url")))
    rest = F.expr("substring(_url, instr(_url, '://') + 3 + length(host))")
    path = F.when(F.instr("_url", "://") > 0, F.regexp_extract(rest, r"^[^?#]*", 0)).otherwise("")
    return split.withColumn("path", path).drop("_url")


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule string")


def _fences(urls: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """``ranges - 1`` keys that cut a hash sample of the URLs into equal parts."""
    sample = smallest_hashes(urls.select("_key", "_salt"), urls.count(), SAMPLE * ranges, "_salt", "_key").collect()
    found = sorted((r[0], r[1]) for r in sample)
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host, path, rule, verdict``.

    ``rules(verdict, rule)``: a rule is a host and, from its first ``/``, a path;
    it fits its host and all subdomains where the URL's path starts with its own.
    Of the rules that fit, the longest host wins, then the longest path, then
    ``block``. Without one, ``rule`` is null and the verdict is ``default``.
    Null and malformed URLs have an empty host, which no rule names; null rules
    and rules without a host are ignored. Columns of ``urls`` that are named like
    the results are replaced. Repeated rows each get their verdict. A hot host is
    dealt over several ranges; its rules go to each of them.
    """
    spark = urls.sparkSession
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    keyed = with_host_path(urls.select(*[F.col(f"`{c}`") for c in names]), url)
    keyed = keyed.withColumn("_key", reversed_host(F.col("host"))).withColumn(
        "_salt", F.xxhash64(*[F.col(f"`{f.name}`") for f in urls.schema if f.name in names and isinstance(f.dataType, T.AtomicType)])
    )
    ranges = parallelism(spark)
    fences = _fences(keyed, ranges)

    at = rules.select(
        F.lower(F.col("verdict")).alias("verdict"),
        "rule",
        F.translate(F.regexp_extract("rule", r"^[^/]*", 0), _UPPER, _LOWER).alias("host"),
        F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("path"),
    ).filter("verdict is not null and host != ''")
    at = at.withColumn("_key", reversed_host(F.col("host")))
    # '/' follows '.' in code order, so the keys below a prefix end before it.
    at = at.withColumn("_end", F.expr("concat(substring(_key, 1, length(_key) - 1), '/')"))

    def dealt_schema(schema: T.StructType) -> T.StructType:
        return T.StructType([T.StructField("_range", T.IntegerType()), *schema.fields])

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, salts = b.column("_key").to_pylist(), b.column("_salt").to_pylist()
            where = [bisect.bisect_right(fences, k) for k in zip(keys, salts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *b.columns], ["_range", *b.schema.names])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = [bisect.bisect_left(fences, (k,)) for k in b.column("_key").to_pylist()]
            last = [bisect.bisect_left(fences, (k,)) for k in b.column("_end").to_pylist()]
            take = [i for i, (f, t) in enumerate(zip(first, last, strict=True)) for _ in range(f, t + 1)]
            where = [r for f, t in zip(first, last, strict=True) for r in range(f, t + 1)]
            kept = b.take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *kept.columns], ["_range", *b.schema.names])

    left = keyed.mapInArrow(deal_urls, dealt_schema(keyed.schema)).withColumn("_kind", F.lit(1))
    right = at.mapInArrow(deal_rules, dealt_schema(at.schema)).drop("_end").withColumn("_kind", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    both = both.repartitionById(ranges, F.col("_range")).sortWithinPartitions("_range", "_key", "_kind")

    out = T.StructType(
        [
            *[f for f in urls.schema.fields if f.name in names],
            *[T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")],
        ]
    )
    schema = to_arrow_schema(out)
    return both.mapInArrow(lambda batches: _sweep(batches, names, schema, default), out)


def _sweep(batches: Iterator[pa.RecordBatch], names: list[str], schema: pa.Schema, default: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, key and kind (rules before URLs)."""
    at, stack = None, []  # stack: (key prefix, rules of this host by path)
    for b in batches:
        found: list[tuple[str | None, str]] = []
        take: list[int] = []
        columns = [b.column(n).to_pylist() for n in ("_range", "_key", "_kind", "path", "rule", "verdict")]
        for i, (part, key, kind, path, rule, verdict) in enumerate(zip(*columns, strict=True)):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                of_length = stack[-1][1].setdefault(len(path), {})
                of_length[path] = max((verdict, rule), of_length.get(path, ("", "")))  # block is after allow
                continue
            take.append(i)
            found.append(_longest(stack, path) or (default, None))
        if take:
            rows = b.take(pa.array(take, pa.int32()))
            columns = [rows.column(n) for n in [*names, "host", "path"]]
            columns += [pa.array([x[1] for x in found], pa.string()), pa.array([x[0] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _longest(stack: list, path: str) -> tuple[str, str] | None:
    for _, lengths in reversed(stack):
        for n in sorted(lengths, reverse=True):
            if n <= len(path) and (hit := lengths[n].get(path[:n])):
                return hit
    return None


ORACLE = r"""
WITH rules(verdict, rule, host, path) AS (VALUES
  ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw, r FROM rest),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM parts),
fit AS (
  SELECT u.page_id, u.host, u.path, x.rule, x.verdict,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(x.host) DESC, length(x.path) DESC) AS k
  FROM urls u LEFT JOIN rules x
    ON (u.host = x.host OR ends_with(u.host, '.' || x.host)) AND starts_with(u.path, x.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
