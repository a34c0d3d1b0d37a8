"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of ``k`` edits is cut into ``k + 1`` pieces; whatever
lies within the budget holds at least one piece unchanged. Each task looks for
all pieces at once with an automaton and checks the text around every hit with
Myers' bit-parallel edit distance. Short items have no budget: they are one piece,
whose hit counts between word borders.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sourceweave.llm.common import trimmed

#: One edit is allowed for so many characters of an item, so its pieces have about as many.
CHARS_PER_EDIT = 14
#: Shorter items (normalised characters) must occur unchanged, as whole words.
SHORTEST = 40
#: Most result rows of an Arrow batch.
ROWS = 10_000
#: Characters of items that are sent to the tasks at once; more items go in further blocks.
BLOCK_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return len(item) // CHARS_PER_EDIT if len(item) >= SHORTEST else 0


def pieces(item: str) -> list[tuple[int, str]]:
    """``budget + 1`` pieces that cover the item, with their offsets."""
    n = budget(item) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a piece of ``text``, and where that piece ends first.

    ``anchored``: the piece starts at the start of ``text``.
    """
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1 | anchored) & full
        down = down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, j
    return best, end


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word of ``text`` runs over either end of the piece."""
    return not (start and text[start].isalnum() and text[start - 1].isalnum()) and not (
        end < len(text) and text[end - 1].isalnum() and text[end].isalnum()
    )


def disjoint(found: set[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Of overlapping ``distance, start, length`` the closest, the first among equals."""
    taken: list[tuple[int, int]] = []
    for distance, start, length in sorted(found):
        i = bisect.bisect_left(taken, (start + length,))
        if i == 0 or taken[i - 1][1] <= start:
            taken.insert(i, (start, start + length))
            yield distance, start, length


class Matcher:
    """Finds the items of one block, each with all its ids, in a text."""

    def __init__(self, items: list[tuple[list, str]]):
        import ahocorasick

        self.items = items
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item) in enumerate(items):
            for at, piece in pieces(item):
                by_piece.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in by_piece.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def find(self, text: str | None, any_: bool = False) -> list[tuple]:
        """``item, start, length, distance`` of every occurrence; those of an item don't overlap.

        Places count code points of the normalised text. ``any_``: one match is enough.
        """
        text = normalised(text)
        windows: set[tuple[int, int]] = set()
        found: dict[int, set[tuple[int, int, int]]] = {}
        for end, (n, owners) in self.automaton.iter(text):
            for i, at in owners:
                item = self.items[i][1]
                k = budget(item)
                if k:
                    hit = self._around(text, item, k, end + 1 - n - at, windows, i)
                else:
                    hit = (0, end + 1 - n, n) if whole_words(text, end + 1 - n, end + 1) else None
                if hit:
                    if any_:
                        return [(self.items[i][0][0], *hit)]
                    found.setdefault(i, set()).add(hit)
        rows = [(d, start, length, distance) for i, hits in found.items() for distance, start, length in disjoint(hits) for d in self.items[i][0]]
        return sorted(rows, key=lambda r: r[1:])

    @staticmethod
    def _around(text: str, item: str, k: int, start: int, windows: set[tuple[int, int]], i: int) -> tuple[int, int, int] | None:
        """The best match of an item that starts about here; windows met before give none.

        Hits whose windows start in the same stretch of 2k + 1 places share one window. It
        is too short for two matches that don't overlap.
        """
        stretch = start // (2 * k + 1)
        if (i, stretch) in windows:
            return None
        windows.add((i, stretch))
        first = max(0, stretch * (2 * k + 1) - k)
        window = text[first : max(0, (stretch + 1) * (2 * k + 1) + len(item) + k)]
        distance, stop = myers(item, window)
        if distance > k:
            return None
        back, length = myers(item[::-1], window[:stop][::-1], anchored=True)
        return distance, first + stop - length, length


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[list, str]]]:
    """The normalised items with their ids in blocks of ``BLOCK_CHARS``, streamed through the driver block by block."""
    held: dict[str, list] = {}
    chars = 0
    for item_id, raw in benchmark.select(key, text).orderBy(key, text).toLocalIterator():
        item = normalised(raw)
        if not item:
            continue
        ids = held.setdefault(item, [])
        chars += 0 if ids else len(item)
        if item_id not in ids[-1:]:
            ids.append(item_id)
            chars += 8
        if chars >= BLOCK_CHARS:
            yield [(i, t) for t, i in held.items()]
            held, chars = {}, 0
    if held:
        yield [(i, t) for t, i in held.items()]


def _sent(spark: SparkSession, block: list[tuple[list, str]]):
    return spark.sparkContext.broadcast(block)


def find_leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, start, length, distance`` of every item found in a whole text.

    Texts and items are compared in lower case with white space runs as one
    space; an item may differ from the passage by one edit in ``CHARS_PER_EDIT``
    characters; one under ``SHORTEST`` characters must occur unchanged and as whole
    words. Null and empty items are left out, equal items each answer, an item that
    repeats under one id once. Null and empty texts hold nothing. A document gives
    one row for each item and occurrence; of matches of an item that overlap the
    closest stands, the first among equals. Repeated documents give their rows again.
    """
    kinds = dict(documents.dtypes), dict(benchmark.dtypes)
    schema = f"doc_id {kinds[0][key]}, item_id {kinds[1]['item_id']}, start long, length long, distance int"
    narrow = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in item_blocks(benchmark):
        sent = _sent(documents.sparkSession, block)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for b in batches:
                hits = ((d.as_py(), *hit) for d, t in zip(b.column(0), b.column(1), strict=True) for hit in matcher.find(t.as_py()))
                while rows := list(islice(hits, ROWS)):
                    ids, items, starts, lengths, distances = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, b.schema.field(0).type), pa.array(items), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(distances, pa.int32())],
                        ["doc_id", "item_id", "start", "length", "distance"],
                    )

        found = narrow.mapInArrow(trimmed(match), schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else documents.sparkSession.createDataFrame([], schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold no item; null texts stay."""
    schema: T.StructType = documents.schema
    arrow = to_arrow_schema(schema)
    at = documents.columns.index(text)
    for block in item_blocks(benchmark):
        sent = _sent(documents.sparkSession, block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for b in batches:
                kept = b.filter(pa.array([not matcher.find(t.as_py(), any_=True) for t in b.column(at)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, arrow, strict=True)], schema=arrow)

        documents = documents.mapInArrow(trimmed(clean), schema)
    return documents
