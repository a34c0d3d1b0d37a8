"""How far the sources of a language differ in their words, by single-pass in-memory indexing.

1. *Blocks.* A task counts terms by language and source in memory. When the block is
   full, it leaves as a run that is sorted by hash shard, language and term and cut into
   short stretches. A common word costs a run one posting a source.
2. *Merge.* A shard's stretches come in the order of their first terms. Those that are
   open, at most one a run, lie on a heap by their last term: what ends below the next
   stretch's first term leaves whole, what reaches beyond it is cut there, so all
   postings of a term meet. Its document frequency decides whether the language keeps
   it; the frequencies are written to the shared folder.
3. *Pairs.* Two sources start from the value that all kept terms would have if neither
   used them. What a term adds that only one of them uses depends on its count alone,
   so it comes from the source's histogram of counts; only terms that both use are
   joined, and stream their corrections into the sum of the pair.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; null texts,
languages and sources count as ''. Sources without terms take part, a language without
kept terms has distances of 0, repeated rows count as documents of their own, empty
tables give no rows. Only the three named columns are read, whatever others are called.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourceweave.llm.common import bound_batches, parallelism, written

#: Documents of a language that a kept term needs, and terms listed for a source.
MIN_DOCS, TOP = 10, 10
#: Estimated bytes of a block in memory, postings of a stretch, and open postings before a merge.
BLOCK, STRETCH, OPEN = 48 << 20, 512, 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes outside terms become spaces, A-Z lower case; bytes of non-ASCII characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_RUN = "shard int, lang string, first string, terms array<string>, sources array<string>, counts array<long>, docs array<long>"
_FREQ = "lang string, term string, source string, n long, total long, head long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class _Numbers(dict):
    """Things numbered as they come."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, index, values)
    return out


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _run(numbers: _Numbers, groups: _Numbers, texts: list[np.ndarray], owner: list[int], shards: int) -> pa.RecordBatch:
    """The stretches of a full block in the order of shard, language and term."""
    wide = np.int64(max(len(numbers), 1))
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    seen, tf = np.unique(doc * wide + np.concatenate(texts), return_counts=True)
    postings, at = np.unique(np.array(owner, np.int64)[seen // wide] * wide + seen % wide, return_inverse=True)
    group, term = postings // wide, postings % wide
    n, docs = _sums(at, tf, len(postings)), np.bincount(at, minlength=len(postings))
    words = list(numbers)
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    shard = np.array([zlib.crc32(w) % shards for w in words], np.int64)[term]
    langs, lang_of, sources = sorted({g[0] for g in groups}), [g[0] for g in groups], [g[1] for g in groups]
    lang = np.array([langs.index(x) for x in lang_of], np.int64)[group]
    order = np.lexsort((group, place[term], lang, shard))
    shard, lang, term, group = shard[order], lang[order], term[order], group[order]
    new = np.flatnonzero(np.diff(shard * np.int64(len(langs)) + lang, prepend=-1))
    cuts = np.unique(np.concatenate([np.arange(0, len(order), STRETCH), new]))
    ends = np.append(cuts, len(order))
    terms = pa.array(words, pa.string()).take(pa.array(term))
    columns = [
        pa.array(shard[cuts].astype(np.int32)), pa.array(langs, pa.string()).take(pa.array(lang[cuts])), terms.take(pa.array(cuts)), _lists(terms, ends),
        _lists(pa.array(sources, pa.string()).take(pa.array(group)), ends), _lists(pa.array(n[order]), ends), _lists(pa.array(docs[order].astype(np.int64)), ends),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "first", "terms", "sources", "counts", "docs"])


def _runs(shards: int, block: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, groups, texts, owner, size = _Numbers(), _Numbers(), [], [], 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in range(3)), strict=True):
                terms = terms_of(text)
                known = len(numbers)
                texts.append(np.fromiter(map(numbers.__getitem__, terms), np.int32, len(terms)))
                owner.append(groups[lang, source])
                size += 8 * len(terms) + 200 * (len(numbers) - known) + 200
                if size >= block:
                    run = _run(numbers, groups, texts, owner, shards)
                    yield from (run.slice(i, 500) for i in range(0, run.num_rows, 500))
                    numbers, groups, texts, owner, size = _Numbers(), _Numbers(), [], [], 0
        if texts:
            run = _run(numbers, groups, texts, owner, shards)
            yield from (run.slice(i, 500) for i in range(0, run.num_rows, 500))

    return index


def _kept(lang: str, stretches: list[tuple], min_docs: int) -> pa.RecordBatch:
    """Frequencies of terms all of whose postings are in ``stretches``."""
    terms, sources, counts, docs = (pa.concat_arrays(list(c)) for c in zip(*stretches, strict=True))
    coded, named = terms.dictionary_encode(), sources.dictionary_encode()
    term, source = coded.indices.to_numpy().astype(np.int64), named.indices.to_numpy().astype(np.int64)
    n, size = counts.to_numpy(), len(coded.dictionary)
    total = _sums(term, n, size)
    at = np.flatnonzero((_sums(term, docs.to_numpy(), size) >= min_docs)[term])
    wide = np.int64(len(named.dictionary))
    keys, where = np.unique(term[at] * wide + source[at], return_inverse=True)
    term = keys // wide
    columns = [
        pa.array([lang] * len(keys), pa.string()), coded.dictionary.take(pa.array(term)), named.dictionary.take(pa.array(keys % wide)),
        pa.array(_sums(where, n[at], len(keys))), pa.array(total[term]), pa.array((np.diff(term, prepend=-1) > 0).astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "n", "total", "head"])


def _merge(min_docs: int, full: int = OPEN):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, now, order, size = [], None, 0, 0

        def drain(below: str | None):
            """Merge what is open up to the next stretch's first term; stretches that reach beyond it are cut there."""
            nonlocal size
            done, beyond = [], []
            while heap and (below is None or heap[0][0] < below):
                done.append(heapq.heappop(heap)[2])
            for last, number, stretch in heap:
                cut = bisect_left(range(len(stretch[0])), below, key=lambda i, terms=stretch[0]: terms[i].as_py())
                done.append(tuple(x.slice(0, cut) for x in stretch))
                beyond.append((last, number, tuple(x.slice(cut) for x in stretch)))
            heap[:] = beyond  # in the order of the heap still
            size = sum(len(x[2][0]) for x in heap)
            if done:
                yield _kept(now[1], done, min_docs)

        for batch in batches:
            heads = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for row, (shard, lang, first) in enumerate(heads):
                if (shard, lang) != now or size >= full:
                    yield from drain(first if (shard, lang) == now else None)
                now, order = (shard, lang), order + 1
                stretch = tuple(batch.column(i)[row].values for i in range(3, 7))
                heapq.heappush(heap, (stretch[0][-1].as_py(), order, stretch))
                size += len(stretch[0])
        yield from drain(None)

    return merge


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK) -> DataFrame:
    """``lang, term, source, n, total, head`` of the kept terms; ``total`` is the language's count, ``head`` 1 once a term."""
    bound_batches(docs.sparkSession)
    parts = parallelism(docs.sparkSession)
    narrow = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    runs = narrow.mapInArrow(_runs(8 * parts, block), _RUN).repartition(parts, "shard").sortWithinPartitions("shard", "lang", "first")
    return written(runs.mapInArrow(_merge(min_docs), _FREQ))


def _share(n: str, of: str, terms: str) -> Column:
    """Smoothed share of a count in thousand millionths, exact."""
    return F.expr(f"1 + cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(19,0)) div ({of} + 2 * {terms})")


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources by distance, own terms by excess over the language."""
    freq = frequencies(docs, min_docs, block)
    langs = freq.groupBy("lang").agg(F.sum("head").alias("v"), F.sum("n").alias("lang_n"))
    sums = freq.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "own_n"])
    # a source that uses no term has the same share of each; without kept terms nothing is divided
    groups = written(groups.withColumn("base", F.when(F.col("v") > 0, _share("0L", "own_n", "v")).otherwise(F.lit(1))))

    used = freq.join(groups, ["lang", "source"]).withColumn("p", _share("n", "own_n", "v")).withColumn("q", _share("total", "lang_n", "v"))
    own = used.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = own.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"))
    neither = _apart("base", "other_base")
    pairs = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"v * ({neither})").alias("value"))
    shape = used.groupBy("lang", "source", "base", "p").agg(F.count("*").alias("terms"))
    one = shape.join(other, "lang").where("source <> item").select(
        "lang", "source", "item", F.expr(f"terms * ({_apart('p', 'other_base')} - {neither})").alias("value")
    )
    mine = used.select("lang", "term", "source", "base", "p")
    theirs = used.select("lang", "term", F.col("source").alias("item"), F.col("base").alias("other_base"), F.col("p").alias("other_p"))
    both = mine.join(theirs, ["lang", "term"]).where("source < item").select(
        "lang", "source", "item",
        F.expr(f"{_apart('p', 'other_p')} - {_apart('p', 'other_base')} - {_apart('base', 'other_p')} + {neither}").alias("value"),
    )
    # what counts for (a, b) counts for (b, a)
    halves = one.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    whole = pairs.unionByName(halves).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = whole.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(columns).unionByName(listed.select(columns))


ORACLE = rf"""
with d as (select coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from w group by lang, term having count(distinct r) >= {MIN_DOCS}),
c as (select w.lang, source, w.term, count(*)::hugeint as n from w join k on w.lang = k.lang and w.term = k.term group by all),
v as (select lang, count(*)::hugeint as v from k group by lang),
s as (select lang, source, sum(n) as nn from c group by lang, source),
g as (select a.lang, a.source, coalesce(v, 0) as v, coalesce(nn, 0) as nn from (select distinct lang, source from d) a left join v on v.lang = a.lang left join s on s.lang = a.lang and s.source = a.source),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (nn + 2 * v) as p
  from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
t as (select lang, term, sum(n) as n from p group by lang, term),
q as (select lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) over (partition by lang) + 2 * count(*) over (partition by lang)) as q from t),
o as (select p.lang, p.source, 'term' as part, p.term as item, ((p - q) * (p - q)) // (p + q) as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p > q),
x as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
y as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
u as (select * from o union all select * from y),
z as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from u)
select lang, source, part, item, value::bigint as value, rank::int as rank from z where part = 'pair' or rank <= {TOP}
"""
