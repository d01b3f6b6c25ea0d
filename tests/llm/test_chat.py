import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retainspark.llm import chat as m

piece = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[/ROLE]", "[TEXT]", "\\", "<", "[", "/", " ", "ok", "s>", "INST]", "\n", "é"])
text = st.lists(piece, max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), text), text), min_size=1, max_size=4))
def test_round_trip(turns):
    shown = "".join(m.format_turn(r, t) for r, t in turns)
    assert [x[:2] for x in m.parse_turns(shown)] == turns


@settings(max_examples=300, deadline=None)
@given(text)
def test_escape_is_reversible_and_inert(t):
    assert m.unescape(m.escape(t)) == t
    assert not m._CONTROL.search(m.escape(t))


def test_escapes_only_what_conflicts():
    assert m.format_turn("user", "hello [x] <b>") == "[INST] hello [x] <b> [/INST]"
    assert m.format_turn("assistant", "a</s>b") == r"[ANS] a<\/s>b </s>"
    assert m.format_turn("assistant", r"a<\/s>b") == r"[ANS] a<\\/s>b </s>"


@pytest.mark.parametrize("bad", ["[INST] a", "a", "[INST] a [/INST] b", "[INST] a</s>", "[/INST]", "[ROLE] user [TEXT] x [/ROLE]", "[INST]a[/INST]"])
def test_parser_refuses(bad):
    with pytest.raises(m.ParseError):
        m.parse_turns(bad)


def expected(rows):
    by = {}
    for conv, turn, role, said in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, m.format_turn(role, said), role or "", said or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t[4] for t in turns if t[3] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[3]}\n{t[4]}\n" for t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(), 3 + sum(len(t[2]) for t in turns))
    return out


def test_read_back_of_hard_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x</s>"), (1, 1, "assistant", "x</s>"), (1, None, "system", "first"), (None, 0, "assistant", "🙂"),
            (2, 5, None, "[INST]"), (2, 2, "assistant", "y" * 300_000), (3, 0, "a [TEXT] b", ""), *m.PLANTED]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in m.read_back(m.format_conversations(df)).collect()}
    assert got == expected(rows)
    assert m.read_back(m.format_conversations(df.limit(0))).collect() == []


def test_loss_mask_covers_assistant_bodies(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a [INST] b")], "conv_id long, turn long, role string, text string")
    got = sorted(m.format_conversations(df).collect(), key=lambda r: r.turn)
    assert (got[0].loss_start, got[0].loss_end) == (0, 0)
    assert got[1].formatted[got[1].loss_start:got[1].loss_end] == r"a [\INST] b"


def test_query_has_the_planted_conversation(spark, sf_small):
    row = m.op6_chat_format(spark, sf_small).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
