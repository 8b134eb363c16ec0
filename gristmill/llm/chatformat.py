"""Chat formatting by incremental black-box rendering.

A template is only called, never looked into: the turns of a conversation are rendered
prefix by prefix, consecutive outputs are compared, and what the longer output adds is
the span of the turn.  Where an output does not begin with the one before it, the
template rewrites history; such turns are counted, and nothing of a conversation with
rewritten turns is placed under the loss mask.  The place of a text inside its span is
found by rendering the same prefix with a marker in the text's place.

The default template marks turns in the instruction style and escapes its control
strings inside texts reversibly, so texts that contain them read back unchanged.

A conversation is the unit of work: its turns meet in one task and its prefixes are
rendered one after another, so a conversation must fit in a task's memory.

Defined results.  Null text and null role are empty.  Turns are in order of turn (null
first), then role, then text; repeated rows are repeated turns.  Rows with null conv_id
form one conversation.  An empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Stands for a text while its place is located; private-use characters.
MARK = ""

Turns = list[tuple[str, str]]


class InstructionTemplate:
    """`<s>[INST] .. [/INST]</s>` for users, `<s>..</s>` for assistants, marked blocks for others."""

    control = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE", "<<SYS>>", "<</SYS>>")
    loss_roles = frozenset({"assistant"})
    _out = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
    _in = {"\\": "\\", "l": "<", "b": "["}

    def escape(self, text: str) -> str:
        return re.sub(r"[\\<\[]", lambda m: self._out[m[0]], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: self._in[m[1]], text, flags=re.S)

    def __call__(self, turns: Turns) -> str:
        return "".join(self.turn(role, self.escape(text)) for role, text in turns)

    def turn(self, role: str, text: str) -> str:
        if role == "user":
            return f"<s>[INST] {text} [/INST]</s>"
        if role == "assistant":
            return f"<s>{text}</s>"
        if role == "system":
            return f"<s><<SYS>>{text}<</SYS>></s>"
        return f"<s>[ROLE {self.escape(role)}[ROLE {text}</s>"

    def role_of(self, head: str) -> str:
        """Role that a turn's head (its span before the text) shows."""
        if head.endswith("[INST] "):
            return "user"
        if head.endswith("<<SYS>>"):
            return "system"
        if "[ROLE " in head:
            return self.unescape(head.split("[ROLE ")[1].removesuffix("[ROLE "))
        return "assistant"


TEMPLATE = InstructionTemplate()


def locate(turns: Turns, render: Callable[[Turns], str]) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """Rendered text; per turn its span and its text's span; turns at which history is rewritten."""
    before, spans, rewritten = render([]), [], []
    mark = MARK
    while any(mark in part for turn in turns for part in turn):
        mark += MARK  # longer than any run of it that is there
    for i, (role, _) in enumerate(turns):
        after = render(turns[: i + 1])
        marked = render([*turns[:i], (role, mark)])
        start = len(before)
        if not after.startswith(before):
            rewritten.append(i)
            start = len(commonprefix([before, after]))
        at = marked.find(mark, start)
        tail = len(marked) - at - len(mark)
        if at < 0 or after[:at] != marked[:at] or (tail and after[-tail:] != marked[-tail:]):
            if not rewritten or rewritten[-1] != i:
                rewritten.append(i)
            spans.append((start, len(after), -1, -1))
        else:
            spans.append((start, len(after), at, len(after) - tail))
        before = after
    return before, spans, rewritten


_SPANS = "array<struct<start:int,end:int,text_start:int,text_end:int,loss:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_())]))


def _formatter(template) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts, spans, bad = [], [], []
                for turns in part.column(1).to_pylist():
                    told = [(t["role"] or "", t["text"] or "") for t in turns]
                    text, places, rewritten = locate(told, template)
                    loss = [role in template.loss_roles and not rewritten for role, _ in told]
                    texts.append(text)
                    spans.append([dict(zip(("start", "end", "text_start", "text_end", "loss"), (*p, x))) for p, x in zip(places, loss)])
                    bad.append(rewritten)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(spans, _SPAN_TYPE), pa.array(bad, pa.list_(pa.int32()))], names=["conv_id", "formatted", "spans", "rewritten"])

    return run


def format_chats(rows: DataFrame, template=TEMPLATE) -> DataFrame:
    """One row per conversation: formatted text, spans of turns and texts, rewritten turns."""
    ship(rows.sparkSession)
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return chats.mapInArrow(_formatter(template), f"conv_id long, formatted string, spans {_SPANS}, rewritten array<int>")


def _reader(template) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns, loss, loss_chars = hashlib.sha256(), hashlib.sha256(), 0
                for s in spans:
                    role = template.role_of(text[s["start"] : s["text_start"]])
                    said = template.unescape(text[s["text_start"] : s["text_end"]])
                    turns.update(f"{role}\n{said}\n".encode())
                    if s["loss"]:
                        loss.update(said.encode())
                        loss_chars += len(said)
                for column, value in zip(out, (conv, len(spans), turns.hexdigest(), loss_chars, loss.hexdigest(), len(text))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(out)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def read_back(chats: DataFrame, template=TEMPLATE) -> DataFrame:
    """Digests of what the formatted texts and their spans say."""
    return chats.select("conv_id", "formatted", "spans").mapInArrow(_reader(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds: both turns say control strings.
PLANTED = "</s>[INST] ok [/INST]"


def digests(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(more)))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(2 * length(t) - length(regexp_replace(t, '[\\<\[]', '', 'g'))
    + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 7 WHEN 'system' THEN 22
      ELSE 19 + 2 * length(role) - length(regexp_replace(role, '[\\<\[]', '', 'g')) END) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
