r"""Phrase collocations by vertical partitioning of word suffixes.

1. *Encoding.* Every text becomes word numbers of a block (a dictionary and an array of
   numbers), written once to the shared folder; the later passes are numpy over these.
2. *Prefix counts.* Words are counted exactly. Pairs are counted by hash slot, which can
   only overstate, so a suffix may end where a word or a pair is rarer than ``min_count``
   without losing a phrase. What tasks get to see of either is a bitmap of fixed size.
3. *Vertical partitioning.* A prefix is a word; where it occurs more often than a group
   has room for, it grows by the next word, twice at most. Prefixes are dealt to groups by
   hash, as many groups as the memory budget asks for, so any task can tell the group of a
   suffix without a table.
4. *Subtrees.* A group gets its suffixes, truncated at four words and counted per block,
   and builds its own tree; the count of a phrase is the total of the leaves below it.
   Counts of a prefix that grew are the sum over its groups.
5. *Scores* join the phrases with the counts of their parts; parts so common that their
   number is bounded are broadcast, the others meet by key.

Texts are cut into pieces at ``[.,;:!?\x0A-\x0D]`` and those into words ``[^\x20\x09]+``,
A-Z lower-cased. Null texts count as empty and have no words, null languages as ``und``.
Repeated rows count again; empty tables give no rows; texts of any length are encoded in
slices that share three words. Only text and language are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourceweave.llm.common import Rows, bound_batches, parallelism, shuffles_freed, trimmed, written

MIN_COUNT, DEPTH, TOP = 30, 4, 2000
#: Tokens of a block, and estimated bytes of all open blocks of a task.
BLOCK, HELD = 1 << 19, 32 << 20
#: Tokens of the blocks that are written and read as one row group.
ROW_GROUP = 4 * BLOCK
#: Suffixes that a group has room for, and the least that it is given where there are few.
BUDGET, LEAST = 50_000, 500
#: Bits of a bitmap (4 MB); the table grows no bitmap, it only makes it prune less.
SLOTS = 1 << 25
#: A part of a phrase is common from this share of all words; of each length there are at most as many.
COMMON = 10_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in _BREAKS else 32 if b == 9 else b for b in range(256))
_BLOCK = "lang string, words array<string>, hashes binary, ids binary, starts int, n long"
_LEAF = "grp int, cut int, lang string, suffix string, n long"


class _Numbers(dict):
    """Words numbered from 1 as they come; 0 is a break between pieces."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


class _Block:
    def __init__(self, tail: list[bytes] = ()):
        self.numbers = _Numbers()
        self.parts = [np.array([self.numbers[w] for w in tail], np.int32)]
        self.tokens = len(tail)

    def add(self, text: bytes) -> None:
        words = text.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.parts.append(ids[ids >= 0])
        self.tokens += len(self.parts[-1])

    def row(self, lang: bytes, ended: bool) -> tuple[tuple, list[bytes]]:
        """The block as a record, and the words that the next block of an unfinished text begins with."""
        ids = np.concatenate(self.parts)
        words = list(self.numbers)[2:]
        starts = len(ids) if ended else max(len(ids) - DEPTH + 1, 0)
        seed = zlib.crc32(lang)
        hashes = np.array([zlib.crc32(w, seed) for w in words], np.uint32)
        tail = [words[i - 1] if i else b"\n" for i in ids[starts:].tolist()]
        return (lang, words, hashes.tobytes(), ids.astype("<i4").tobytes(), starts, int((ids[:starts] > 0).sum())), tail


def _slices(text: bytes, size: int) -> Iterator[bytes]:
    """Cuts before white space, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(b" ", at + 1, at + size), text.rfind(b"\n", at + 1, at + size))
        if end < 0:
            end = min((e for e in (text.find(b" ", at + size), text.find(b"\n", at + size)) if e >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def _encode(block: int, slice_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, _Block] = {}
        out = Rows(_BLOCK)

        def close(lang: bytes, ended: bool):
            row, tail = held.pop(lang).row(lang, ended)
            if not ended:
                held[lang] = _Block(tail)
            if out.add(row, len(row[2]) + len(row[3]) + sum(map(len, row[1]))):
                yield out.batch()

        for batch in batches:
            for text, lang in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in range(2)), strict=True):
                if not text:
                    continue
                for piece in _slices(text.translate(_FOLD), slice_bytes):
                    now = held.setdefault(lang, _Block())
                    now.add(piece)
                    if now.tokens >= block:
                        yield from close(lang, False)
                held[lang].add(b"\n")
                if sum(4 * b.tokens + 100 * len(b.numbers) for b in held.values()) > HELD:
                    for open_lang in list(held):
                        yield from close(open_lang, True)
        for lang in list(held):
            yield from close(lang, True)
        yield out.batch()

    return encode


def encode(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK, slice_bytes: int = 1 << 20) -> DataFrame:
    """Blocks of word numbers, written."""
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")))
    return written(narrow.mapInArrow(trimmed(_encode(block, slice_bytes)), _BLOCK), max(ROW_GROUP // block, 1))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``lang, words, hashes, ids, starts`` of each block; entry 0 of ``hashes`` is the break."""
    for i in range(batch.num_rows):
        lang, words, hashes, ids, starts = (batch.column(c)[i] for c in ("lang", "words", "hashes", "ids", "starts"))
        hashed = np.concatenate([[0], np.frombuffer(hashes.as_py(), np.uint32)]).astype(np.uint64)
        yield lang.as_py(), words.values, hashed, np.frombuffer(ids.as_py(), "<i4"), starts.as_py()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, words, hashed, ids, starts in _blocks(batch):
            n = np.bincount(ids[:starts], minlength=len(hashed))[1:]
            # a word of the shared tail alone has no start here
            columns = [pa.array([lang] * len(n), pa.string()), words.cast(pa.string()), pa.array(hashed[1:].astype(np.int64)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "hash", "n"])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(31))) & np.uint64(0xFFFFFFFF)


def _bitmap(slots: DataFrame) -> np.ndarray:
    """One bit a slot; at most ``SLOTS / 64`` words reach the driver."""
    words = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, slot & 63))").alias("bits"))
    found = words.toPandas()
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _has(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    slot = hashed % np.uint64(SLOTS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _padded(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([ids, np.zeros(DEPTH, ids.dtype)])


def _pair_counts(frequent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value
        for batch in batches:
            for _, _, hashed, ids, starts in _blocks(batch):
                known, ids = _has(bits, hashed), _padded(ids)
                known[0] = False
                at = np.flatnonzero(known[ids[:starts]] & known[ids[1 : starts + 1]])
                slot = _mix(hashed[ids[at]], hashed[ids[at + 1]]) % np.uint64(SLOTS)
                found, n = np.unique(slot.astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["slot", "n"])

    return count


def _leaves(maps, groups: int):
    """Suffixes of a block with their counts, the group of their prefix and its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known, words_heavy, pairs_known, pairs_heavy = maps.value
        for batch in batches:
            for lang, words, hashed, ids, starts in _blocks(batch):
                known, heavy, ids, wide = _has(words_known, hashed), _has(words_heavy, hashed), _padded(ids), np.int64(len(hashed))
                known[0] = False
                live = np.zeros(len(ids), bool)
                live[:-1] = known[ids[:-1]] & known[ids[1:]]
                at = np.flatnonzero(live)
                live[at] = _has(pairs_known, _mix(hashed[ids[at]], hashed[ids[at + 1]]))
                at = np.flatnonzero(live[:starts])
                third = np.where(live[at + 1], ids[at + 2], 0)
                fourth = np.where((third > 0) & live[np.minimum(at + 2, len(live) - 1)], ids[np.minimum(at + 3, len(ids) - 1)], 0)
                heads, head = np.unique(ids[at].astype(np.int64) * wide + ids[at + 1], return_inverse=True)
                ends, end = np.unique(third.astype(np.int64) * wide + fourth, return_inverse=True)
                both, n = np.unique(head * np.int64(max(len(ends), 1)) + end, return_counts=True)
                head, end = heads[both // max(len(ends), 1)], ends[both % max(len(ends), 1)]
                path = [head // wide, head % wide, end // wide, end % wide]
                one, two = hashed[path[0]], _mix(hashed[path[0]], hashed[path[1]])
                grown = heavy[path[0]]
                twice = grown & _has(pairs_heavy, two)
                key = np.where(twice, _mix(two, hashed[path[2]]), np.where(grown, two, one))
                text = [pc.take(words, pa.array(p - 1, mask=p == 0)).cast(pa.string()) for p in path]
                columns = [
                    pa.array((_mix(key, key) % np.uint64(groups)).astype(np.int32)),
                    pa.array((1 + grown + twice).astype(np.int32)),
                    pa.array([lang] * len(n), pa.string()),
                    pc.binary_join_element_wise(*text, " ", null_handling="skip"),
                    pa.array(n.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["grp", "cut", "lang", "suffix", "n"])

    return cut


def _subtrees(min_count: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, trees = Rows("lang string, phrase string, len int, n long"), None, {}

        def read(tree: dict, lang: str, cut: int, path: tuple) -> tuple[int, list]:
            """Leaf totals of a subtree, and its nodes that count."""
            total, nodes = tree.pop(None, 0), []
            for word, child in tree.items():
                n, below = read(child, lang, cut, (*path, word))
                total += n
                nodes += below
            # a prefix that grew has other groups, so its part counts however small
            if len(path) > 1 and (total >= min_count or len(path) < cut):
                nodes.append((lang, " ".join(path), len(path), total))
            return total, nodes

        def close():
            for (lang, cut), tree in trees.items():
                for word, child in tree.items():
                    for node in read(child, lang, cut, (word,))[1]:
                        if out.add(node, 40):
                            yield out.batch()
            trees.clear()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("grp", "lang", "cut", "suffix", "n"))
            for grp, lang, cut, suffix, n in zip(*columns, strict=True):
                if grp != now:
                    yield from close()
                    now = grp
                tree = trees.setdefault((lang, cut), {})
                for word in suffix.split(" "):
                    child = tree.get(word)
                    if child is None:
                        child = tree[word] = {}
                    tree = child
                tree[None] = tree.get(None, 0) + n
        yield from close()
        yield out.batch()

    return build


def phrase_counts(blocks: DataFrame, min_count: int = MIN_COUNT, budget: int = BUDGET) -> DataFrame:
    """``lang, phrase, len, n`` of all words and phrases of up to four words from ``min_count`` on, written."""
    spark: SparkSession = blocks.sparkSession
    words = blocks.mapInArrow(trimmed(_word_counts), "lang string, phrase string, hash long, n long").groupBy("lang", "phrase")
    words = written(words.agg(F.first("hash").alias("hash"), F.sum("n").alias("n")).where(F.col("n") >= min_count))
    slots = words.select(F.expr(f"cast(hash % {SLOTS} as int)").alias("slot"), "n")
    parts = parallelism(spark)
    # no prefix may hold more than a group's share of a small input either
    budget = min(budget, max((words.agg(F.sum("n")).first()[0] or 0) // (8 * parts), LEAST))
    frequent, heavy = _bitmap(slots), _bitmap(slots.where(F.col("n") > budget))
    shared = spark.sparkContext.broadcast(frequent)
    pairs = blocks.mapInArrow(trimmed(_pair_counts(shared)), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    pairs = written(pairs.where(F.col("n") >= min_count))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    maps = spark.sparkContext.broadcast((frequent, heavy, _bitmap(pairs), _bitmap(pairs.where(F.col("n") > budget))))
    groups = min(max(8 * parts, 2 * total // budget), (1 << 31) - 1)
    leaves = blocks.mapInArrow(trimmed(_leaves(maps, groups)), _LEAF).repartition(parts, "grp").sortWithinPartitions("grp")
    nodes = leaves.mapInArrow(trimmed(_subtrees(min_count)), "lang string, phrase string, len int, n long")
    phrases = nodes.groupBy("lang", "phrase", "len").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return written(words.select("lang", "phrase", F.lit(1).alias("len"), "n").unionByName(phrases))


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def _counted(rows: DataFrame, part: str, counts: DataFrame, common: Column, name: str) -> DataFrame:
    """Adds the count of ``part``: common parts by broadcast, the others by key."""
    known = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    met = rows.join(F.broadcast(known.where(common)), ["lang", part], "left")
    others = met.where(F.col(name).isNull()).drop(name)
    return met.where(F.col(name).isNotNull()).unionByName(others.join(known.where(~common), ["lang", part]).select(met.columns))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
    budget: int = BUDGET, block: int = BLOCK, slice_bytes: int = 1 << 20, nested_percent: int = 80,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of every language.

    ``budget``, ``block`` and ``slice_bytes`` cut the work and do not change the result.
    """
    blocks = encode(docs, text_col, lang_col, block, slice_bytes)
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("words"))
    with shuffles_freed(docs.sparkSession):
        counts = phrase_counts(blocks, min_count, budget)
        every = blocks.agg(F.sum("n")).first()[0] or 0
    phrases = counts.where("len > 1")

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("len")).alias("rest"))
    both = _counted(cuts, "first", counts, F.col("l") * COMMON >= every, "l")
    both = _counted(both, "rest", counts, F.col("r") * COMMON >= every, "r")
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0)) div (l + r)")
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = phrases.where("len > 2").select("lang", "n", "phrase", "len", F.explode(F.sequence(F.lit(2), F.col("len") - 1)).alias("size"))
    inside = longer.select("lang", "n", "phrase", "size", F.explode(F.expr("sequence(1, len - size + 1)")).alias("at"))
    inside = inside.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("inside"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(f"inside is null or 100 * inside < {nested_percent} * a")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as materialized (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
m as (select lang, ws, unnest(range(1, {DEPTH + 1})) as size from w),
s as (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from m where len(ws) >= size),
c as materialized (select lang, size, array_to_string(ws[i:i + size - 1], ' ') as phrase, count(*)::hugeint as n from s group by all having count(*) >= {MIN_COUNT}),
u as (select lang, sum(len(ws))::bigint as n from w group by lang),
k as (select lang, phrase, n as a, size, unnest(range(1, size)) as k from c where size > 1),
x as (select k.lang, k.phrase, k.a, k.k, l.n as l, r.n as r, (2000000 * k.a) // (l.n + r.n) as score from k
  join c l on l.lang = k.lang and l.phrase = array_to_string(string_split(k.phrase, ' ')[1:k.k], ' ')
  join c r on r.lang = k.lang and r.phrase = array_to_string(string_split(k.phrase, ' ')[k.k + 1:], ' ')),
y as (select *, row_number() over (partition by lang, phrase order by score, k) as o from x),
b as (select lang, phrase, n, size, unnest(range(2, size)) as sub from c where size > 2),
e as (select lang, phrase, n, sub, unnest(range(1, size - sub + 2)) as i from b),
g as (select lang, array_to_string(string_split(phrase, ' ')[i:i + sub - 1], ' ') as phrase, max(n) as inside from e group by all),
z as (select y.lang, y.phrase, a, l, r, score, row_number() over (partition by y.lang order by score desc, a desc, y.phrase) as rank
  from y left join g on g.lang = y.lang and g.phrase = y.phrase where o = 1 and (inside is null or 100 * inside < 80 * a))
select z.lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, u.n as n, score::bigint as score from z join u on u.lang = z.lang where rank <= {TOP}
"""
