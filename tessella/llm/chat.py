"""Chat formatting with a grammar round trip.

Grammar of the rendered text (deterministic, one token of look-ahead)::

    conversation := turn*
    turn         := "<s>[INST] " role " [/INST]\n" body "</s>\n"

A role or body holds no control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``). Content that has one is escaped
by a backslash after the control string's first character; where backslashes stand there already, one more is put in,
and the parser takes one away, so escaping is a bijection. A conversation is rendered as it is first, parsed again and
compared with its source; turns that conflict are escaped until the recovered turns are identical.

Defined results: a null role or text is the empty string; ties of turn are ordered by role, then text; rows with a
null turn come first; a null conversation id is a conversation of its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import arrow_map, unclashed

CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]")
_PLAIN = re.compile(r"(<|\[)(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(/?s>|/?INST\])")

Turn = tuple[str, str]


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The text and the span of each body, in code points."""
    parts, spans, at = [], [], 0
    for role, body in turns:
        head = f"<s>[INST] {role} [/INST]\n"
        parts += [head, body, "</s>\n"]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + 5
    return "".join(parts), spans


def parse(text: str) -> list[Turn] | None:
    """The turns of a rendered text, or None if it isn't of the grammar."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith("<s>[INST] ", at):
            return None
        role_end = CONTROL.search(text, at + 10)
        if not role_end or role_end[0] != "[/INST]" or role_end.start() < at + 11 or text[role_end.start() - 1] != " " or not text.startswith("\n", role_end.end()):
            return None
        body_at = role_end.end() + 1
        end = CONTROL.search(text, body_at)
        if not end or end[0] != "</s>" or not text.startswith("\n", end.end()):
            return None
        turns.append((unescape(text[at + 10 : role_end.start() - 1]), unescape(text[body_at : end.start()])))
        at = end.end() + 1
    return turns


def round_trip(turns: list[Turn]) -> tuple[str, list[tuple[int, int]], int]:
    """Rendered text, spans of the bodies and the number of escaped turns, such that parsing gives the turns again."""
    shown, escaped = list(turns), [False] * len(turns)
    while True:
        text, spans = render(shown)
        if parse(text) == turns:
            return text, spans, sum(escaped)
        wrong = [i for i, t in enumerate(turns) if not escaped[i] and parse(render([t])[0]) != [t]]
        for i in wrong or [i for i, done in enumerate(escaped) if not done]:
            shown[i], escaped[i] = (escape(turns[i][0]), escape(turns[i][1])), True
        if not wrong and parse(render(shown)[0]) != turns:
            raise ValueError("a conversation can't be rendered reversibly")


FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,stop:long>>, n_escaped long"


def format_chat(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (bodies of loss_role, in code points of formatted), n_escaped.

    One shuffle by conversation; each partition is sorted and streamed, so a task holds one conversation at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("n_escaped", pa.int64())])
        nothing = object()
        current, turns, rows = nothing, [], []

        def close() -> None:
            text, spans, n = round_trip(turns)
            rows.append({"conv_id": current, "n_turns": len(turns), "formatted": text, "loss_spans": [{"start": a, "stop": b} for (role, _), (a, b) in zip(turns, spans, strict=True) if role == loss_role], "n_escaped": n})

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if current is nothing or conv != current:
                    if current is not nothing:
                        close()
                    current, turns = conv, []
                turns.append((role, text))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if current is not nothing:
            close()
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = unclashed(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return arrow_map(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), run, FORMATTED)


def read_chat(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: conv_id, turns array<struct<role,text>>, loss_text (all text under the loss mask, unescaped), formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"conv_id": batch.column("conv_id").to_pylist(), "turns": [], "loss_text": [], "formatted_chars": []}
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                out["turns"].append([{"role": r, "text": t} for r, t in parse(text)])
                out["loss_text"].append("".join(unescape(text[s["start"] : s["stop"]]) for s in spans))
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string()), ("formatted_chars", pa.int64())]))

    return arrow_map(formatted.select("conv_id", "formatted", "loss_spans"), run, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")


#: DuckDB SQL for op8.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, regexp_replace(role, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS shown_role,
         regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS shown_text FROM rows),
conv AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         CAST(sum(24 + length(shown_role) + length(shown_text)) AS BIGINT) AS formatted_chars
  FROM shown GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM conv
"""
