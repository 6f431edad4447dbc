"""Chat formatting of messages with typed content parts.

A message's content is an array of parts: text, image, audio or document. A
visitor walks them in order and flattens them to one string: texts are escaped,
every other part becomes a placeholder, its reference is recorded, and its
tokens, once expanded, are counted. A turn then reads

    <turn>ROLE<says>CONTENT</turn> and a line feed

Every control string begins with "<"; texts and roles get a backslash before
each "<" and each backslash, which unescaping takes away, so texts that
hold control strings, or look like another template's, come back unchanged.

The output has a row per turn, in order, with its place in the conversation's
string (the segments one after another) and the spans that count for the loss:
the text of assistant turns. Turns stream through sorted, so a conversation of any
length holds no more than a batch in memory.

Null text, null content or no parts: an empty text. Null role: an empty role.
Turns come by turn, then role, then text (nulls first), so ties and repeated rows have
one order, and each row is a turn. Parts of unknown type are placeholders of
that type without tokens. Null conv_id: a conversation of its own. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, partitions

PART = "struct<type string, text string, uri string, width int, height int, seconds double, pages int>"
SEGMENT = "conv_id long, turn long, position long, start long, segment string, loss array<struct<start int, length int>>, attachments array<struct<kind string, uri string, at int, tokens long>>, extra_tokens long"
#: Sides in pixels of an image's patches, tokens per second of audio, and tokens per page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024
_escaped = re.compile(r"\\(.)", re.S)
_piece = re.compile(r"((?:[^\\<]++|\\.)++)|<\w+:(\d+)>", re.S)
_turn = re.compile(r"<turn>((?:[^\\<]++|\\.)*+)<says>((?:[^\\<]++|\\.|<\w+:\d+>)*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


class Flattener:
    """Visits the parts of one message."""

    def __init__(self):
        self.pieces: list[str] = []
        self.spans: list[tuple[int, int]] = []  # of texts, within the content
        self.attachments: list[dict] = []
        self.length = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type'] or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part["text"] or "")
        self.spans.append((self.length, len(text)))
        self._add(text)

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part["seconds"] or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part["pages"] or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        self._attach(part, 0)

    def _attach(self, part: dict, tokens: int) -> None:
        kind = re.sub(r"\W", "_", part["type"])
        self.attachments.append({"kind": part["type"], "uri": part["uri"], "at": self.length, "tokens": tokens})
        self._add(f"<{kind}:{len(self.attachments) - 1}>")

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)


def format_turn(role: str, parts: list[dict] | None, learn: bool) -> tuple[str, list[dict], list[dict]]:
    """(segment, loss spans, attachments); places count from the segment's start."""
    flat = Flattener()
    for part in parts or ():
        if part is not None:
            flat.visit(part)
    head = f"<turn>{escape(role)}<says>"
    loss = [{"start": len(head) + a, "length": n} for a, n in flat.spans if n] if learn else []
    attachments = [x | {"at": x["at"] + len(head)} for x in flat.attachments]
    return f"{head}{''.join(flat.pieces)}</turn>\n", loss, attachments


def parse_parts(segment: str) -> tuple[str, list[str | int]]:
    """(role, parts): a string for each run of text, the number of its attachment for each
    placeholder. A text that looks like a placeholder was escaped, so it is a string."""
    found = _turn.fullmatch(segment)
    if not found:
        raise ValueError(f"not a turn: {segment[:80]!r}")
    parts: list[str | int] = []
    for text, number in _piece.findall(found[2]):
        parts.append(int(number) if number else unescape(text))
    return unescape(found[1]), parts


def parse_turn(segment: str) -> tuple[str, str]:
    """(role, texts one after another), without placeholders."""
    role, parts = parse_parts(segment)
    return role, "".join(x for x in parts if isinstance(x, str))


def text_part(text: Column) -> Column:
    """Plain text as content."""
    names = ("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in names]))


def format_chats(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, turn, role, content (an array of PART). One row per turn, as
    SEGMENT, in order within its partition; a conversation lies in one partition."""
    bounded_batches(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, start = object(), 0, 0
        for batch in batches:
            out = []
            for conv, turn, role, content in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "content")), strict=True):
                if conv != now:
                    now, position, start = conv, 0, 0
                segment, loss, attachments = format_turn(role or "", content, role in learn)
                out.append({"conv_id": conv, "turn": turn, "position": position, "start": start, "segment": segment, "loss": loss, "attachments": attachments, "extra_tokens": sum(a["tokens"] for a in attachments)})
                position, start = position + 1, start + len(segment)
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "content")
    return rows.repartition(partitions(messages), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "content").mapInArrow(run, SEGMENT)


SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("start", pa.int64()), ("segment", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
    ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))), ("extra_tokens", pa.int64()),
])


def digest_chats(segments: DataFrame) -> DataFrame:
    """What can be read back from the segments of format_chats, per conversation."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_ = None, False
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

        def row() -> tuple:
            return now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        for batch in batches:
            done = []
            for conv, segment, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss")), strict=True):
                if any_ and conv != now:
                    done.append(row())
                    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                now, any_ = conv, True
                role, text = parse_turn(segment)
                turns.update(f"{role}\n{text}\n".encode())
                for span in spans:
                    learnt = unescape(segment[span["start"] : span["start"] + span["length"]])
                    loss.update(learnt.encode())
                    counts[1] += len(learnt)
                counts[0] += 1
                counts[2] += len(segment)
            yield from rows(done)
        if any_:
            yield from rows([row()])

    def rows(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return segments.mapInArrow(run, schema)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = rows.unionByName(more).withColumn("content", text_part(F.col("text")))
    return digest_chats(format_chats(messages))


OP5_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped as (select *, replace(replace(role, '\', '\\'), '<', '\<') as r, replace(replace(text, '\', '\\'), '<', '\<') as t from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<turn>' || r || '<says>' || t || '</turn>' || chr(10)))::bigint as formatted_chars
from escaped group by conv_id
"""
