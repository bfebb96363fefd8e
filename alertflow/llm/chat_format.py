"""Chat formatting by event-sourced reconstruction.

A log row is (conv_id, turn, seq, op, role, text). Per (conversation, turn)
the rows are folded in ``seq`` order: ``message`` closes the open message and
opens a new one, ``delta`` appends to the open one, ``edit`` replaces its text,
``regenerate`` empties it for the deltas that follow, ``delete`` removes it, so
that none is open. The folded messages are rendered one segment each; a
conversation is its segments in (turn, k) order. Folding is by (conversation,
turn), so a conversation with a third of all rows is spread over the cluster.
Log rows stream through sorted partitions and only the open message is held:
memory does not grow with the number of deltas, edits or messages of a turn.
What needs a whole conversation (its digests) streams the same way.

Template of a segment: ``<|role|>\\n`` text ``</s>\\n``. Control strings inside
texts and roles are escaped (``<s>``, ``</s>``, ``<|``, ``|>``, ``[INST]``,
``[/INST]``), and so are the escapes themselves, so reading back is exact.

Defined cases: null text and null role count as ''; a null turn sorts first; a
null conversation id is a conversation of its own; ``message`` rows that share
a turn are separate messages by (seq, role, text), nulls first; a ``delta``,
``edit`` or ``regenerate`` without an open message opens one; unknown ops are
ignored; a conversation whose messages are all deleted has no segments; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from alertflow.llm.common import read_table

#: Extra conversation of the registered query (fixed value).
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"
#: Folded messages leave a task in batches of about so many rows or characters.
FLUSH_ROWS, FLUSH_CHARS = 2_000, 4_000_000


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, "&(amp|lt|lb|vb);", "&amp;$1;")
    text = F.regexp_replace(text, r"<(/?s>|\|)", "&lt;$1")
    text = F.regexp_replace(text, r"\[(/?INST\])", "&lb;$1")
    return F.regexp_replace(text, r"\|>", "&vb;>")


def unescape(text: Column) -> Column:
    for name, char in (("&vb;", "|"), ("&lb;", "["), ("&lt;", "<")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, "&amp;(amp|lt|lb|vb);", "&$1;")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, k (position among the turn's messages), role, text."""
    rows = events.select("conv_id", "turn", "seq", "op", F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    id_type, turn_type = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    # seq, role, text and op make the order of equal rows the same in every run; nulls come first
    return (rows.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "role", "text", "op")
            .select("conv_id", "turn", "op", "role", "text")
            .mapInArrow(_fold, f"conv_id {id_type}, turn {turn_type}, k int, role string, text string"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold log rows that come in (conv_id, turn, seq) order; ``parts`` is the text of the open message, None if none is open."""
    out, chars, turn_of, k, role, parts = [], 0, None, 0, "", None
    kinds = [pa.null(), pa.null(), pa.int32(), pa.string(), pa.string()]

    def close() -> None:
        nonlocal k, parts, chars
        if parts is not None:
            text = "".join(parts)
            out.append((*turn_of, k, role, text))
            k, parts, chars = k + 1, None, chars + len(text)

    def flush() -> pa.RecordBatch:
        nonlocal chars
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                                          names=["conv_id", "turn", "k", "role", "text"])
        out.clear()
        chars = 0
        return made

    for b in batches:
        kinds[:2] = b.schema.field(0).type, b.schema.field(1).type
        for conv, turn, op, who, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (conv, turn) != turn_of:
                close()
                turn_of, k, role = (conv, turn), 0, ""
            if op == "message":
                close()
                role, parts = who, [text]
            elif op in ("delta", "edit", "regenerate"):
                role = who or ("" if parts is None else role)
                if op == "delta" and parts is not None:
                    parts.append(text)
                else:
                    parts = [text]
            elif op == "delete":
                parts = None
            if len(out) >= FLUSH_ROWS or chars >= FLUSH_CHARS:
                yield flush()
    close()
    if out:
        yield flush()


def render(messages: DataFrame) -> DataFrame:
    """One segment per message: conv_id, turn, k, segment, loss_start (0-based), loss_length (code points; 0: no loss)."""
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    body = escape(F.col("text"))
    trained = F.col("role") == "assistant"
    return messages.select(
        "conv_id", "turn", "k", F.concat(head, body, F.lit("</s>\n")).alias("segment"),
        F.length(head).alias("loss_start"), F.when(trained, F.length(body)).otherwise(0).alias("loss_length"))


def read_back(segments: DataFrame) -> DataFrame:
    """Role, text and text under the loss mask, parsed from the segments alone."""
    pattern = r"(?s)^<\|(.*?)\|>\n(.*)</s>\n$"
    return segments.select(
        "conv_id", "turn", "k", unescape(F.regexp_extract("segment", pattern, 1)).alias("role"),
        unescape(F.regexp_extract("segment", pattern, 2)).alias("text"),
        unescape(F.substr("segment", F.col("loss_start") + 1, F.col("loss_length"))).alias("loss"),
        F.length("segment").alias("n"))


def conversation_digests(back: DataFrame) -> DataFrame:
    """Per conversation, in (turn, k) order: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A partition holds whole conversations in order; digests are updated row by
    row, so memory stays constant however long a conversation is."""
    id_type = back.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, state, id_arrow = False, None, None, pa.null()

        def closed() -> list:
            n, turns, chars, loss, total = state
            return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), total]

        def batch(rows: list) -> pa.RecordBatch:
            kinds = [id_arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

        for b in batches:
            done, id_arrow = [], b.schema.field(0).type
            for c, role, text, loss, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if not started or c != conv:
                    if started:
                        done.append(closed())
                    started, conv, state = True, c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += n
            if done:
                yield batch(done)
        if started:
            yield batch([closed()])

    return (back.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "k")
            .select("conv_id", "role", "text", "loss", "n")
            .mapInArrow(digest, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, "
                                "loss_sha256 string, formatted_chars long"))


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: every row is one ``message``."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("op"),
                                "role", "text")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long"), F.col("id"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE_TEXT))
    segments = render(fold_events(as_events(table.union(probe))))
    return conversation_digests(read_back(segments))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '&(amp|lt|lb|vb);', '&amp;\1;', 'g'), '<(/?s>|\|)', '&lt;\1', 'g'), '\[(/?INST\])', '&lb;\1', 'g'),
      '\|>', '&vb;>', 'g') AS body,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(role,
      '&(amp|lt|lb|vb);', '&amp;\1;', 'g'), '<(/?s>|\|)', '&lt;\1', 'g'), '\[(/?INST\])', '&lb;\1', 'g'),
      '\|>', '&vb;>', 'g') AS head
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 10)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
