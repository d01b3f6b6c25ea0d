r"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<s>`` followed by its turns, each of which
delimits itself::

    user       [INST] BODY [/INST]
    assistant  [ANS] BODY </s>
    any other  [ROLE] NAME [TEXT] BODY [/ROLE]

Every rendered turn is read again by a deterministic parser.  If what it
recovers isn't the source (the text holds control strings, or looks escaped),
the text is escaped and the check repeated: a backslash goes behind the first
character of every control string, one more than it has already, and the parser
takes one away.  As each turn parses to exactly itself and the parser decides by
the next control string alone, a conversation parses turn by turn, so the check
needs no conversation in one place.

Only assistant bodies are under the loss mask.

Defined results: null text or role: the empty string.  Turns are ordered by
``turn`` (nulls first), then by their rendered text, so ties and repeated rows
have one order.  A null conv_id is a conversation of its own.  An empty table
gives no conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table

BEGIN = "<s>"
_CONTROL = re.compile(r"</?s>|\[/?INST\]|\[ANS\]|\[/?ROLE\]|\[TEXT\]")
_PLAIN = re.compile(r"<(\\*)(/?s>)|\[(\\*)(/?INST\]|ANS\]|/?ROLE\]|TEXT\])")
_ESCAPED = re.compile(r"<\\(\\*)(/?s>)|\[\\(\\*)(/?INST\]|ANS\]|/?ROLE\]|TEXT\])")


class ParseError(ValueError):
    """The text is not in the template's language."""


def escape(text: str) -> str:
    """Make control strings, and what looks like escaped ones, inert."""
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render_turn(role: str, text: str) -> str:
    """One turn in the template; ``role`` and ``text`` as they stand."""
    if role == "user":
        return f"[INST] {text} [/INST]"
    if role == "assistant":
        return f"[ANS] {text} </s>"
    return f"[ROLE] {role} [TEXT] {text} [/ROLE]"


def parse_turns(text: str) -> list[tuple[str, str, tuple[int, int]]]:
    """(role, text, span of the body in ``text``) of the turns of rendered
    text, without ``<s>``.  Raises ParseError on anything the grammar lacks."""
    marks = [(m[0], m.start(), m.end()) for m in _CONTROL.finditer(text)]
    turns, at, i = [], 0, 0

    def body(opener: int, closer: str) -> str:
        start, (mark, end, _) = marks[opener][2] + 1, marks[opener + 1]
        if mark != closer or end - 1 < start or text[start - 1] != " " or text[end - 1] != " ":
            raise ParseError(f"expected ' {closer}' at {end}")
        return text[start:end - 1]

    try:
        while at < len(text):
            mark, start, _ = marks[i]
            if start != at:
                raise ParseError(f"text between turns at {at}")
            if mark in ("[INST]", "[ANS]"):
                role, closer = ("user", "[/INST]") if mark == "[INST]" else ("assistant", "</s>")
            elif mark == "[ROLE]":
                role, closer = unescape(body(i, "[TEXT]")), "[/ROLE]"
                if role in ("user", "assistant"):
                    raise ParseError(f"role {role} has a form of its own")
                i += 1
            else:
                raise ParseError(f"{mark} opens no turn")
            said = body(i, closer)
            turns.append((role, unescape(said), (marks[i][2] + 1, marks[i][2] + 1 + len(said))))
            at, i = marks[i + 1][2], i + 2
    except IndexError:
        raise ParseError("the text ends within a turn") from None
    return turns


def _reads_back(role: str, text: str, shown: str) -> bool:
    try:
        return [x[:2] for x in parse_turns(shown)] == [(role, text)]
    except ParseError:
        return False


def format_turn(role: str | None, text: str | None) -> str:
    """The first rendering, from plain to fully escaped, that parses to its source."""
    role, text = role or "", text or ""
    for name, said in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        shown = render_turn(name, said)
        if _reads_back(role, text, shown):
            return shown
    raise AssertionError("an escaped turn must read back")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end) for every row: the
    rendered turn and the code points of it that are under the loss mask (an
    empty span outside assistant turns)."""
    def fn(batch: pa.RecordBatch) -> dict:
        shown, start, end = [], [], []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            shown.append(x := format_turn(role, text))
            who, _, (a, b) = parse_turns(x)[0]
            start.append(a if who == "assistant" else 0)
            end.append(b if who == "assistant" else 0)
        return {"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "formatted": pa.array(shown, pa.string()),
                "loss_start": pa.array(start, pa.int64()), "loss_end": pa.array(end, pa.int64())}

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, fn, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.n, self.chars, self.loss_chars = conv_id, 0, len(BEGIN), 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, shown: str, a: int, b: int) -> None:
        for role, text, _ in parse_turns(shown):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        under = unescape(shown[a:b])
        self.loss.update(under.encode())
        self.loss_chars += len(under)
        self.chars += len(shown)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted turns by the parser
    and the loss spans.  The turns of a conversation stream through the running
    digests in order and are never held together; as SHA-256 takes its input in
    order, one conversation's turns have to pass one task."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv, shown, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if now is None or now.conv_id != conv:
                    if now:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(shown, a, b)
            yield out(done)
        yield out([now.row()] if now else [])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")
    return ordered.mapInArrow(run, schema)


#: The conversation that the contract adds: control strings as ordinary text.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_format(spark, sf_dir) -> DataFrame:
    have = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(have.unionByName(planted)))


OP6_SQL = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), esc AS (
  SELECT *,
    regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'),
                   '\[(\\*)(/?INST\]|ANS\]|/?ROLE\]|TEXT\])', '[\\\1\2', 'g') AS body,
    regexp_replace(regexp_replace(role, '<(\\*)(/?s>)', '<\\\1\2', 'g'),
                   '\[(\\*)(/?INST\]|ANS\]|/?ROLE\]|TEXT\])', '[\\\1\2', 'g') AS name
  FROM src
), shown AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || body || ' [/INST]'
                      WHEN 'assistant' THEN '[ANS] ' || body || ' </s>'
                      ELSE '[ROLE] ' || name || ' [TEXT] ' || body || ' [/ROLE]' END AS formatted
  FROM esc
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
