"""Operator 1: chat formatting from an event log.

Events of a conversation are folded into messages and rendered with a
template:

* ``message``: the text of a message (replaces what it had),
* ``delta``: a streamed piece, appended,
* ``edit``: a new text for the message,
* ``regenerate``: drops the text so far; following deltas build it anew.

Folding groups by message, not by conversation: the events since the last one
that replaces or drops the text are joined in sequence order.  A message
stands where its first event stands.  Rendering works row by row, over ranges
of (conversation, place): a conversation with a third of all rows is sorted and
rendered by many tasks.  The output is one row per segment of a conversation:
turns in order, cut before a turn that would exceed ``segment_chars`` and where
a range ends, so that an endless conversation becomes many rows and a task
holds one segment at a time; most conversations are one.  Segment numbers rise
along a conversation, with gaps.

A digest of a whole conversation is a chain over its bytes.  So ``read_back``,
which checks an output, streams a conversation's segments through one task; the
formatted output itself doesn't need it.

A turn is rendered ``### role: text </turn>`` and a newline.  Inside roles and
texts every backslash is doubled and a backslash is put before ``###`` and
``</turn>`` (in roles also before a colon), so that no text can open or close a turn and ``parse`` gives back
the messages exactly.  The loss mask is a list of spans (code points of the
segment) that cover the escaped assistant texts.

Cases: null text and null role are empty; events without a kind are messages;
null conversation ids form one conversation; null sequence numbers come
first; ties go by role and text (turns of one place are one task's); an empty log gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"
SEGMENT_CHARS = 1 << 20
TRAINED_ROLE = "assistant"
SEGMENTS = "conv_id long, segment long, n_turns long, formatted string, mask array<struct<s:int,e:int>>"

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)



def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end bound the escaped text."""
    at = 0
    while at < len(formatted):
        if formatted[at:at + len(OPEN)] != OPEN:
            raise ValueError(f"no turn at {at}")
        colon = _find(formatted, ": ", at + len(OPEN))
        close = _find(formatted, CLOSE, colon + 2)
        yield unescape(formatted[at + len(OPEN):colon]), unescape(formatted[colon + 2:close]), colon + 2, close
        at = close + len(CLOSE)


def _find(text: str, mark: str, at: int) -> int:
    """The first place of ``mark`` that no backslash escapes."""
    while (found := text.find(mark, at)) >= 0:
        first = found + mark.startswith(" ")  # the escaped character of CLOSE is its "<"
        slashes, k = 0, first - 1
        while k >= 0 and text[k] == "\\":
            slashes, k = slashes + 1, k - 1
        if slashes % 2 == 0:
            return found
        at = found + 1
    raise ValueError(f"no {mark!r} after {at}")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, place (of the first event), role, text of every message.

    ``events``: conv_id, seq, message_id, kind, role, text."""
    drops = F.col("kind").isin("message", "edit", "regenerate") | F.col("kind").isNull()
    event = F.struct(F.col("seq"), F.col("role"), F.col("text"), drops.alias("drops"))
    grouped = events.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(event)).alias("log"))
    last = F.coalesce(F.array_max(F.transform("log", lambda x, i: F.when(x["drops"], i))), F.lit(0))
    grouped = grouped.withColumn("since", last)
    texts = F.transform(F.slice("log", F.col("since") + 1, F.size("log")), lambda x: F.coalesce(x["text"], F.lit("")))
    return grouped.select("conv_id", F.get("log", F.lit(0))["seq"].alias("place"),
                          F.coalesce(F.array_min(F.transform("log", lambda x: x["role"])), F.lit("")).alias("role"),
                          F.array_join(texts, "").alias("text"))


def render(messages: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments (schema SEGMENTS) of the messages (conv_id, place, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, segment, parts, mask, size, done, held = None, 0, [], [], 0, [], 0

        def close() -> None:
            if parts:
                done.append({"conv_id": conv, "segment": segment, "n_turns": len(parts),
                             "formatted": "".join(parts), "mask": mask})

        started = False
        for batch in batches:
            for c, role, text, first in zip(*(batch[k].to_pylist() for k in ("conv_id", "role", "text", "first"))):
                head = OPEN + escape(role).replace(":", "\\:") + ": "
                body = escape(text)
                turn = head + body + CLOSE
                if not started or c != conv:
                    close()
                    conv, segment, parts, mask, size, started = c, first, [], [], 0, True
                elif size + len(turn) > segment_chars:
                    close()
                    segment, parts, mask, size = segment + 1, [], [], 0
                if role == TRAINED_ROLE:
                    mask.append({"s": size + len(head), "e": size + len(head) + len(body)})
                parts.append(turn)
                size += len(turn)
                held += len(turn)
                if held >= 4 * SEGMENT_CHARS:
                    yield _segments(done)
                    done, held = [], 0
        close()
        yield _segments(done)

    ordered = (messages.repartitionByRange("conv_id", "place")
               .sortWithinPartitions("conv_id", "place", "role", "text"))
    first = F.shiftleft(F.spark_partition_id().cast("long"), 32)  # a range's segments come after the range before
    return ordered.select("conv_id", "role", "text", first.alias("first")).mapInArrow(run, SEGMENTS)


_SEGMENT_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("n_turns", pa.int64()),
                            ("formatted", pa.string()),
                            ("mask", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])


def _segments(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SEGMENT_ARROW)


def format_chat(events: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    return render(fold(events), segment_chars)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from its segments alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.  Segments stream through in order;
    a task holds one segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for c, formatted, mask in zip(*(batch[k].to_pylist() for k in ("conv_id", "formatted", "mask"))):
                if now is None or now["conv_id"] != c:
                    if now:
                        done.append(now)
                    now = {"conv_id": c, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0,
                           "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                for role, text, _, _ in parse(formatted):
                    now["n_turns"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                for x in mask:
                    learned = unescape(formatted[x["s"]:x["e"]])
                    now["loss_chars"] += len(learned)
                    now["loss"].update(learned.encode())
                now["formatted_chars"] += len(formatted)
            if len(done) > 1000:
                yield _digests(done)
                done = []
        yield _digests(done + ([now] if now else []))

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.select("conv_id", "formatted", "mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")


#: the report of ``read_back`` over ``conversations`` and the conversation -7, for DuckDB
READ_BACK_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(t, r)),
turns AS (
  SELECT *, 4 + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:'))
         + 2 + length(text) + len(regexp_extract_all(text, '\\|###|</turn>')) + 9 AS chars
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _digests(rows: list) -> pa.RecordBatch:
    number = lambda k: pa.array([r[k] for r in rows], pa.int64())
    digest = lambda k: pa.array([r[k].hexdigest() for r in rows], pa.string())
    return pa.RecordBatch.from_pydict({
        "conv_id": number("conv_id"), "n_turns": number("n_turns"), "turns_sha256": digest("turns"),
        "loss_chars": number("loss_chars"), "loss_sha256": digest("loss"),
        "formatted_chars": number("formatted_chars")})
