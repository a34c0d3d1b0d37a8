"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: text</turn>`` and a line end. The rendered turn
is parsed again by a deterministic parser and compared with its source; while
they differ, more of the text is escaped with backslashes. Parsing a turn ends
exactly at its own end mark, so the turns of a conversation parse one after the
other just as they were checked one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import batches_of

LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {label: role for role, label in LABELS.items()}
_CONTROL = re.compile(r"\\(?:\\|### |</turn>)|### |</turn>")
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)


class GrammarError(ValueError):
    pass


def parse_turn(text: str, start: int = 0) -> tuple[str, str, int, int, int]:
    """``role, text, body start, body end, end`` of the turn at ``start``."""
    head = _HEAD.match(text, start)
    if not head:
        raise GrammarError("no turn starts here")
    label = head[1]
    role = re.sub(r"\\(.)", r"\1", label[5:], flags=re.S) if label.startswith("role=") else _ROLES.get(label)
    if role is None:
        raise GrammarError("unknown label")
    parts, at = [], head.end()
    for m in _CONTROL.finditer(text, head.end()):
        parts.append(text[at : m.start()])
        if m[0] == "</turn>":
            if text[m.end() : m.end() + 1] != "\n":
                raise GrammarError("end mark inside a line")
            return role, "".join(parts), head.end(), m.start(), m.end() + 1
        if m[0][0] != "\\":
            raise GrammarError("a turn starts inside a turn")
        parts.append(m[0][1:])
        at = m.end()
    raise GrammarError("no end mark")


def _escaped(text: str, level: int) -> str:
    if level == 0:
        return text
    return re.sub(r"### |</turn>" if level == 1 else r"\\|### |</turn>", lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    """A stretch of formatted text, as under a loss mask, without its escapes."""
    return re.sub(r"\\(\\|### |</turn>)", r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """The rendered turn, the span of its text in it, and the escape level it took."""
    label = LABELS.get(role) or "role=" + re.sub(r"([\\:])", r"\\\1", role)
    for level in range(3):
        out = f"### {label}: {_escaped(text, level)}</turn>\n"
        try:
            got = parse_turn(out)
        except GrammarError:
            continue
        if got[:2] == (role, text) and got[4] == len(out):
            return out, got[2], got[3], level
    raise AssertionError("full escaping always parses")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, segment, loss_start, loss_end, level`` for each row.

    ``segment`` is the turn's part of the formatted conversation; the loss mask
    covers ``[loss_start, loss_end)`` of it, empty but for assistant turns. A null
    role or text counts as empty. The rows stay where they are.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("level", pa.int32())]
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for conv, turn, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    out, start, end, level = render_turn(role or "", text or "")
                    yield conv, turn, out, start, end if role == "assistant" else start, level

        return batches_of(rows(), schema, 1024)

    narrow = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return narrow.mapInArrow(render, "conv_id long, turn long, segment string, loss_start long, loss_end long, level int")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read from its formatted turns.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    escaped_turns``. Turns go by number, null first, ties by their rendered text.
    Turns are parsed from the formatted text, the loss is cut out by the mask alone.
    The digests run over a conversation in order, so its turns meet in one task,
    which streams them: memory holds one batch whatever a conversation's length.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
        + [("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("escaped_turns", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, open_ = None, None
            for b in batches:
                for conv, segment, start, end, level in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if open_ is None or conv != at:
                        if open_:
                            yield closed(at, open_)
                        at, open_ = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    done = 0
                    while done < len(segment):  # turns are what the grammar finds, not what the rows say
                        role, text, _, _, done = parse_turn(segment, done)
                        open_[0] += 1
                        open_[1].update(f"{role}\n{text}\n".encode())
                    learnt = unescaped(segment[start:end])
                    open_[2] += len(learnt)
                    open_[3].update(learnt.encode())
                    open_[4] += len(segment)
                    open_[5] += level > 0
            if open_:
                yield closed(at, open_)

        def closed(conv, o):
            return conv, o[0], o[1].hexdigest(), o[2], o[3].hexdigest(), o[4], o[5]

        return batches_of(rows(), schema, 1024)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end", "level").mapInArrow(
        read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long",
    )


#: The conversation that the contract adds.
PLANTED = "\\### Assistant: </turn> ok"

ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
labelled AS (
  SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
            ELSE 'role=' || regexp_replace(role, '([\\:])', '\\\1', 'g') END AS label,
    CASE WHEN regexp_matches(text, '\\(\\|### |</turn>)') OR ends_with(text, '\') THEN 2
         WHEN contains(text, '### ') OR contains(text, '</turn>') THEN 1 ELSE 0 END AS level
  FROM turns),
sized AS (
  SELECT *, length(label) + 6 + 8 + length(CASE level WHEN 0 THEN text
      WHEN 1 THEN regexp_replace(text, '(### |</turn>)', '\\\1', 'g')
      ELSE regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g') END) AS n FROM labelled)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, label, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, label, text), '')) AS loss_sha256,
  cast(sum(n) AS BIGINT) AS formatted_chars,
  cast(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) AS BIGINT) AS escaped_turns
FROM sized GROUP BY conv_id
"""
