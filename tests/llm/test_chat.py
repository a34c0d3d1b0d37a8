import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sourceweave.llm.chat import PLANTED, GrammarError, format_turns, parse_turn, read_back, render_turn, unescaped

PIECES = ["\\", "\\\\", "### ", "### User: ", "</turn>", "</turn>\n", "\n", "a", "é", " ", "role=", ":", "Assistant"]


def test_round_trip_of_any_text():
    rng = random.Random(2)
    for _ in range(5000):
        role = rng.choice(["user", "assistant", "system", "", "User", "tool:x", "a\\", "### ", "role=b", "x\ny"])
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8)))
        out, start, end, level = render_turn(role, text)
        got = parse_turn("x" + out + "### User: next</turn>\n", 1)
        assert got[:2] == (role, text) and got[4] == len(out) + 1 and (got[2], got[3]) == (start + 1, end + 1)
        assert level or out[start:end] == text
        assert unescaped(out[start:end]) == text


def test_planted_text():
    out, start, end, level = render_turn("assistant", PLANTED)
    assert out[start:end] == "\\\\\\### Assistant: \\</turn> ok" and level == 2
    with pytest.raises(GrammarError):
        parse_turn("### Nobody: x</turn>\n")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", None), (2, 1, None, "x"), (None, 5, "user", ""), (3, None, "user", "z"), (3, 0, "assistant", PLANTED), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as segment")
    got = {r.conv_id: r for r in read_back(format_turns(turns)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b").hexdigest() and got[1].formatted_chars == len("### User: a</turn>\n### Assistant: b</turn>\n")
    assert (got[2].n_turns, got[2].loss_chars) == (2, 0) and got[None].n_turns == 1
    assert got[3].turns_sha256 == hashlib.sha256(f"user\nz\nassistant\n{PLANTED}\n".encode()).hexdigest() and got[3].loss_chars == len(PLANTED)
    assert got[4].n_turns == 2 and got[4].loss_sha256 == hashlib.sha256(b"samesame").hexdigest()
    assert read_back(format_turns(turns.limit(0))).collect() == []


def test_the_mask_decides_the_loss(spark):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", PLANTED), (1, 2, "assistant", "x" * 200_000)]
    formatted = format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (whole,) = read_back(formatted).collect()
    (less,) = read_back(formatted.selectExpr("conv_id", "turn", "segment", "loss_start", "greatest(loss_start, loss_end - 3) as loss_end", "level")).collect()
    assert whole.loss_sha256 == hashlib.sha256((PLANTED + "x" * 200_000).encode()).hexdigest()
    assert less.loss_chars == whole.loss_chars - 6 and less.loss_sha256 != whole.loss_sha256 and less.turns_sha256 == whole.turns_sha256
    (joined,) = read_back(formatted.groupBy("conv_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(turn, segment))), x -> x.segment), '') as segment")).selectExpr("conv_id", "0L as turn", "segment", "0L as loss_start", "0L as loss_end", "0 as level")).collect()
    assert (joined.n_turns, joined.turns_sha256, joined.loss_chars) == (3, whole.turns_sha256, 0)
