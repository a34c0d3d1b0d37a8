"""N-gram Jaccard join with vertical partitioning.

The global order of the n-grams (their hash) is cut into fragments. A fragment
holds, of every text, the n-grams in its stretch and is worked on by itself:
first it counts how many n-grams of a text occur in any other text, later how
many a candidate pair shares; sums over the fragments give the totals.

1. Texts with the same set form a class. Per class, the fragments count the
   n-grams shared with other classes; a class that shares less than it would need
   for any link goes no further. This is most of the corpus.
2. The rest is ordered by rarity, and n-grams in the prefix that any partner must
   meet become posting lists. Each list's most ordinary class is its leader; all
   others are compared with it.
3. Classes that are linked by now need no more comparing. Pairs of a list that
   are still apart are compared too, unless what each shares with the leader
   bounds their overlap below the threshold.

So no link between different texts is lost, and a large group of near copies
costs about one comparison for each member, not one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sourceweave.llm.common import parallelism, trimmed, written
from sourceweave.session import cut_lineage

#: Words of an n-gram, and the least overlap in hundredths of the union.
WORDS, PERCENT = 5, 75
#: Sets below WHOLE are screened by all their n-grams, larger ones by those with an even hash.
WHOLE = 64
#: Overlaps of candidate pairs are counted in 2 ** FRAGMENT_BITS fragments.
FRAGMENT_BITS = 2
_FLUSH = 1 << 19
_CACHE = 300_000
_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams; of all words if there are fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(WORDS, len(h))
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= _MULT
        out += h[j : len(h) - n + 1 + j]
    out += np.uint64(n)
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(grams: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), len(grams))).astype(np.int64))


def _least(n: int) -> int:
    """The smallest overlap with which a set of ``n`` can be in a link."""
    return -(-PERCENT * n // 100)


#: The same in SQL.
_LEAST = f"(({PERCENT} * n + 99) div 100)"
_WIDE = WHOLE * 100 // PERCENT + 1

_SCREEN = "fragment int, data binary, doc_id {0}, sig long, n long, even long"
_SCREENED = "doc_id {0}, sig long, n long, even long, shared long"


def _screen(documents: DataFrame, kind: str) -> DataFrame:
    """A row for each document (``shared`` null) and rows with a class's shared n-grams by fragment."""
    fragments = parallelism(documents.sparkSession)
    names = [x.split()[0] for x in _SCREEN.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        held: list[tuple[int, int, np.ndarray]] = []
        size, seen = 0, set()
        for b in batches:
            rows = []
            for t in b.column(1):
                grams = shingles(t.as_py(), words)
                even = grams[grams & np.uint64(1) == 0]
                sig = signature(grams)
                rows.append((sig, len(grams), len(even)))
                if not len(grams) or sig in seen:
                    continue
                if len(seen) >= _CACHE:
                    seen.clear()
                seen.add(sig)  # the copies of a text in this task need not be sent again
                held.append((sig, len(grams), grams if len(grams) < _WIDE else even))
                size += len(held[-1][2])
                if size >= _FLUSH:
                    yield packed(held)
                    held, size = [], 0
            sigs, ns, evens = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)) if rows else [pa.array([], pa.int64())] * 3
            where = pa.array([i % fragments for i in range(len(rows))], pa.int32())  # evenly, whatever copies there are
            yield pa.RecordBatch.from_arrays([where, pa.nulls(len(rows), pa.binary()), b.column(0), sigs, ns, evens], names)
        if held:
            yield packed(held)

    def packed(held) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(g) for _, _, g in held])
        grams = np.concatenate([g for _, _, g in held])
        part = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        grams, owner = grams[order], owner[order]
        present, starts = np.unique(part[order], return_index=True)
        data = []
        for a, z in zip(starts, [*starts[1:], len(grams)], strict=True):
            own, counts = np.unique(owner[a:z], return_counts=True)
            heads = np.array([[held[i][0] for i in own], [held[i][1] for i in own], counts], np.int64)
            data.append(np.int64(len(own)).tobytes() + heads.tobytes() + grams[a:z].astype(np.uint32).tobytes())
        n = len(present)
        return pa.RecordBatch.from_arrays(
            [pa.array(present, pa.int32()), pa.array(data, pa.binary()), pa.nulls(n, empty_kind[0]), *[pa.nulls(n, pa.int64())] * 3], names
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads_, grams = [], []
        out = ["doc_id", "sig", "n", "even", "shared"]
        for b in batches:
            is_doc = b.column("data").is_null()
            docs = b.filter(is_doc)
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([*[docs.column(c) for c in out[:4]], pa.nulls(docs.num_rows, pa.int64())], out)
            for d in b.column("data").drop_null():
                raw = d.as_py()
                k = int(np.frombuffer(raw, np.int64, 1)[0])
                heads_.append(np.frombuffer(raw, np.int64, 3 * k, 8).reshape(3, k))
                grams.append(np.frombuffer(raw, np.uint32, offset=8 + 24 * k))
            kinds[:] = [b.schema.field("doc_id").type]
        if not grams:
            return
        heads = np.concatenate(heads_, axis=1)
        known, first, of = np.unique(heads[0], return_index=True, return_inverse=True)
        size = heads[1][first]
        pairs = np.concatenate(grams).astype(np.uint64) << np.uint64(32)
        grams.clear()
        pairs |= np.repeat(of.astype(np.uint64), heads[2])
        pairs = np.unique(pairs)
        gram = (pairs >> np.uint64(32)).astype(np.uint32)
        of = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        del pairs
        same = gram[1:] == gram[:-1]
        shared = np.zeros(len(gram), bool)
        shared[1:] |= same
        shared[:-1] |= same
        counted = shared & ((size[of] < WHOLE) | (gram & np.uint32(1) == 0))
        counts = np.bincount(of[counted], minlength=len(known))
        keep = np.flatnonzero(counts)
        for k in range(0, len(keep), 65_536):
            at = keep[k : k + 65_536]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(at), kinds[0]), pa.array(known[at]), pa.array(size[at], pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(counts[at], pa.int64())], out
            )

    from pyspark.sql.pandas.types import to_arrow_type

    empty_kind = [to_arrow_type(documents.schema["doc_id"].dataType)]
    kinds = list(empty_kind)
    dealt = documents.mapInArrow(trimmed(cut), _SCREEN.format(kind)).repartitionById(fragments, F.col("fragment"))
    return dealt.mapInArrow(trimmed(count), _SCREENED.format(kind))


_SETS = "sig long, n long, grams array<long>"


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sig, n, grams`` of the ``wanted(sig, doc_id)`` classes, read again from their first documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            rows = []
            for sig, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                grams = shingles(t.as_py(), words)
                own = signature(grams)
                if sig is None or own == sig:  # rows that share an id may differ
                    rows.append((own, len(grams), grams.astype(np.int64)))
            if rows:
                sigs, ns, grams = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(ns, pa.int64()), pa.array(grams, pa.list_(pa.int64()))], ["sig", "n", "grams"])

    # The same plan at every size: ids that fit a broadcast today may not fit one tomorrow.
    w = wanted.filter("doc_id is not null").hint("merge")
    found = documents.join(w, "doc_id").select("sig", "text").mapInArrow(trimmed(read), _SETS)
    # Classes of rows without an id are found by their set alone.
    unnamed = documents.filter("doc_id is null").select(F.lit(None).cast("long").alias("sig"), "text").mapInArrow(trimmed(read), _SETS)
    unnamed = unnamed.join(wanted.filter("doc_id is null").select("sig"), "sig", "left_semi")
    return found.unionAll(unnamed).dropDuplicates(["sig"])


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``na, nb, overlap``: counted by fragment of the order, then summed."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    parts = [
        f"named_struct('fragment', {i}, 'part', filter(grams, g -> shiftright(g, {64 - FRAGMENT_BITS}) = {i - (1 << FRAGMENT_BITS - 1)}))"
        for i in range(1 << FRAGMENT_BITS)
    ]
    segments = sets.join(used, "sig", "left_semi").select("sig", "n", F.expr(f"inline(array({', '.join(parts)}))"))
    left = pairs.join(segments.select(F.col("sig").alias("a"), F.col("n").alias("na"), "fragment", F.col("part").alias("part_a")), "a")
    both = left.join(segments.select(F.col("sig").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("part_b")), ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("overlap"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))


_LINKED = f"100 * overlap >= {PERCENT} * (na + nb - overlap)"


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of the undirected ``edges(a, b)``: the smallest node that can be reached.

    Alternating large and small stars: every round joins each edge with the
    smallest neighbour of its ends, so the number of rounds grows with the
    logarithm of the longest path. Rounds are checkpointed.
    """

    def stars(both: DataFrame, large: bool) -> DataFrame:
        """Joins the larger (or smaller) neighbours of ``u`` to its smallest neighbour."""
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        moved = both.filter("v > u" if large else "v <= u").join(least, "u")
        if large:
            return moved.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u != v").distinct()
        kept = moved.select("u", F.col("m").alias("v"))
        return kept.unionAll(moved.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()

    at = cut_lineage(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while not at.isEmpty():
        back = at.unionAll(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        at = cut_lineage(stars(stars(back, True), False))
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each posting list that are not linked yet and not bounded away.

    Rows come by n-gram. Of each row: class, set size, n-grams that other classes
    have, place of the n-gram, component, and the overlap with the list's leader
    (-1 if it was not compared; the leader is not in the rows).
    """

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, n, shared, place, root, common = (np.concatenate(c) for c in zip(*rows, strict=True))
        seen = set()
        step = max(1, (1 << 22) // len(sig))
        for k in range(0, len(sig), step):
            z = slice(k, k + step)
            least_n, sum_n = np.minimum(n[z, None], n), n[z, None] + n
            # What follows the first n-gram that both have in their prefixes.
            most = np.minimum(n[z, None] - place[z, None], n - place)
            known = (common[z, None] >= 0) & (common >= 0)
            through = np.minimum(common[z, None], common) + np.minimum((shared - common)[z, None], shared - common)
            most = np.minimum(most, np.minimum(shared[z, None], shared))
            most = np.where(known, np.minimum(most, through), most)
            ok = (root[z, None] != root) & (sig[z, None] < sig) & (100 * least_n >= PERCENT * (sum_n - least_n)) & (100 * most >= PERCENT * (sum_n - most))
            for i, j in zip(*np.nonzero(ok), strict=True):
                seen.add((int(sig[k + i]), int(sig[j])))
                if len(seen) >= 65_536:
                    yield batch(seen)
                    seen = set()
        if seen:
            yield batch(seen)

    def batch(seen: set) -> pa.RecordBatch:
        a, b = zip(*seen, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    at, rows = None, []
    for b in batches:
        gram, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        cuts = np.flatnonzero(gram[1:] != gram[:-1]) + 1
        for a, z in zip([0, *cuts], [*cuts, len(gram)], strict=True):
            if a == z:
                continue
            if gram[a] != at and rows:
                yield from pairs(rows)
                rows = []
            at = gram[a]
            rows.append([c[a:z] for c in columns])
    if rows:
        yield from pairs(rows)


def _links(sets: DataFrame) -> DataFrame:
    """``a, b``: links that join all linked classes of ``sets(sig, n, grams)`` to their components."""
    grams = sets.select("sig", "n", F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    rare_first = grams.join(common, "gram").groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("classes", "gram"))).alias("order"))
    alive = rare_first.withColumn("shared", F.size("order").cast("long")).filter(f"shared >= {_LEAST}")
    # N-grams of one class alone come first; the prefix ends where a partner must have been met.
    prefix = F.expr(f"slice(order, 1, cast(greatest(0, n - {_LEAST} + 1 - (n - shared)) as int))")
    listed = written(
        alive.select("sig", "n", "shared", F.posexplode(prefix).alias("at", "x")).select(
            F.col("x.gram").alias("gram"), "sig", "n", "shared", (F.col("n") - F.col("shared") + F.col("at")).alias("place")
        )
    )
    plain = F.min(F.struct((F.col("n") - F.col("shared")).alias("alone"), "sig"))
    leaders = listed.groupBy("gram").agg(plain.alias("x"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    leaders = leaders.select("gram", F.col("x.sig").alias("leader"))
    posted = written(listed.join(leaders, "gram").filter("sig != leader"))
    star = posted.select(F.col("leader").alias("a"), F.col("sig").alias("b")).distinct()
    first = written(_overlaps(star, sets))
    linked = first.filter(_LINKED).select("a", "b")
    roots = written(components(linked))

    # Lists whose classes are all linked by now are done.
    known = first.select(F.col("a").alias("leader"), F.col("b").alias("sig"), "overlap")
    labelled = posted.join(known, ["leader", "sig"], "left").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    labelled = labelled.select(
        "gram", "sig", "n", "shared", "place", F.coalesce("root", "sig").alias("root"), F.coalesce("overlap", F.lit(-1)).cast("long").alias("common")
    )
    labelled = written(labelled)
    open_ = labelled.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("gram")
    rest = labelled.join(open_, "gram", "left_semi").repartition("gram").sortWithinPartitions("gram")
    second = rest.mapInArrow(trimmed(_apart), "a long, b long").distinct()
    later = _overlaps(written(second), sets).filter(_LINKED).select("a", "b")
    return linked.unionAll(later)


def _labelled(documents: DataFrame) -> DataFrame:
    """``doc_id, sig, n, root, component_id`` of each row; class and component are null for an empty set."""
    documents = documents.select("doc_id", "text")
    kind = dict(documents.dtypes)["doc_id"]
    screened = written(_screen(documents, kind))
    rows = screened.filter("shared is null").select("doc_id", "sig", "n", "even")
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("even").alias("even"))
    totals = screened.filter("shared is not null").groupBy("sig").agg(F.sum("shared").alias("shared"))
    need = f"if(n < {WHOLE}, {_LEAST}, even - (n - {_LEAST}))"
    maybe = classes.join(totals, "sig", "left").filter(f"coalesce(shared, 0) >= {need}")
    sets = written(_sets(documents, written(maybe.select("sig", "doc_id"))))
    roots = components(_links(sets)).withColumnRenamed("node", "sig")
    labelled = classes.select("sig", "doc_id").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    smallest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(smallest, "root").select("sig", "root", "component_id")
    linked = rows.filter("n > 0").join(named, "sig").select("doc_id", "sig", "n", "root", "component_id")
    none = F.lit(None).cast("long")
    return linked.unionAll(rows.filter("n = 0").select("doc_id", none.alias("sig"), "n", none.alias("root"), F.col("doc_id").alias("component_id")))


def jaccard_components(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``documents(doc_id, text)``.

    Two texts link when their sets of 5-word n-grams overlap in at least 75
    hundredths of their union. The component's id is the smallest document id
    that links lead to. Null texts and texts without words have an empty set and
    are linked with nothing. Texts of fewer than five words have one n-gram, all
    their words, and link with equal ones. Repeated rows are copies of each other
    and answered one by one; ids that are null name no component. Other columns
    are not read. N-grams and sets are told apart by 64-bit hashes.
    """
    return _labelled(documents).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _signed(rows: DataFrame) -> DataFrame:
    """``row, sig``: the rows as they are, with the class of their text (null without words)."""
    out = T.StructType([T.StructField("row", rows.schema), T.StructField("sig", T.LongType())])
    schema = to_arrow_schema(out)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            sets = (shingles(t.as_py(), words) for t in b.column(1))
            sigs = pa.array([signature(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.field(0).type), sigs], schema=schema)

    packed = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    return rows.select(packed, F.col("text").alias("_text")).mapInArrow(trimmed(sign), out)


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component: that with the smallest id.

    Decided row by row: of one id with several texts, only those go that are
    linked with a smaller id, or with another text of the id that stays. A
    component without ids keeps one of its rows. Texts without words stay; those
    that agree in id and text are one document, but rows without an id and
    without words all stay.
    """
    found = written(_labelled(documents))
    gone = written(found.filter("doc_id != component_id").select("doc_id").distinct())
    twice = written(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id"))
    if twice.isEmpty() and found.filter("doc_id is null").isEmpty():
        return documents.join(gone, "doc_id", "left_anti").select(documents.columns)
    sure = documents.filter("doc_id is not null").join(twice, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(documents.columns)
    # An id that is null or repeated does not name a row; its rows are told apart by their sets.
    unsure = documents.filter("doc_id is null").unionAll(documents.join(twice, "doc_id", "left_semi").select(documents.columns))
    rows = _signed(unsure)
    first = F.min_by("row", F.struct(*[F.col(f"row.`{c}`") for c, t in documents.dtypes if "map<" not in t and t != "variant"])).alias("row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sig")).alias("k")
    keepers = found.filter("n > 0").groupBy("root").agg(least).select(F.col("k.doc_id").alias("keep_id"), F.col("k.sig").alias("sig"))
    worded = rows.filter("sig is not null").groupBy(F.col("row.doc_id").alias("id"), "sig").agg(first)
    worded = worded.join(keepers, "sig").filter("id <=> keep_id").select("row")
    named = rows.filter("sig is null and row.doc_id is not null").groupBy(F.col("row.doc_id"), F.col("row.text")).agg(first).select("row")
    unnamed = rows.filter("sig is null and row.doc_id is null").select("row")
    return sure.unionAll(worded.unionAll(named).unionAll(unnamed).select("row.*"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT s.doc_id, cast(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON r.a = s.doc_id
"""
