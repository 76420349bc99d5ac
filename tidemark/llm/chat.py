"""Operator 9: chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document). A visitor walks the
parts in order: text is escaped, every attachment becomes a placeholder and is recorded
with its reference and the number of tokens that it expands to. Turns are framed as

    ### role: content</turn>\\n

The control strings of the template can occur in a text. Inside texts each backslash is
doubled and each `###`, `</turn>` or `<|` gets a backslash in front of its first
character, so the marks of the template stay unambiguous and `unescape` is exact.

Turns are formatted row by row; only the order within a conversation needs a shuffle.
`format_turns` streams sorted partitions and gives one row a turn, with its place in the
conversation's text, and `turn_digests` reads them back as a stream: memory holds one batch, so a conversation
may hold any share of all rows and be longer than one string can. `format_conversations` joins the turns of
each conversation into one string, for those who want one. Rows of one conversation with equal turn numbers keep
the order of role, then text. Nulls: a null text is empty, a null role is `none`, null
turns come first, and rows without conversation id form one conversation with a null id. Ids keep their type.
A conversation without assistant turns has an empty loss mask. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, MIDDLE, END = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|<\|")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.S)
_HOLDER = re.compile(r"(?<!\\)((?:\\\\)*)<\|(image|audio|document)_(\d+)\|>")

#: Tokens that one attachment of each type expands to, by its size measure.
TOKENS = {"image": lambda n: 85 + 170 * max(1, -(-n // 262144)), "audio": lambda n: max(1, -(-n // 640)), "document": lambda n: max(1, -(-n // 4))}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


@dataclass
class Flattener:
    """Visits parts in order; `attachments` holds (index, type, reference, tokens) of those met so far, numbered from `base`."""

    base: int = 0
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_unknown(self, part: dict) -> str:
        raise ValueError(f"unknown part type {part.get('type')!r}")

    def _attach(self, part: dict) -> str:
        k = self.base + len(self.attachments)
        self.attachments.append((k, part["type"], part.get("ref") or "", TOKENS[part["type"]](int(part.get("size") or 0))))
        return f"<|{part['type']}_{k}|>"

    visit_image = visit_audio = visit_document = _attach


def format_turn(role: str | None, parts: list[dict], walker: Flattener) -> str:
    name = escape(role or "none").replace(":", "\\:")
    return START + name + MIDDLE + "".join(map(walker.visit, parts or [])) + END


def parse_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn of a formatted conversation; start and stop frame the content in code points."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def placeholders(content: str) -> list[tuple[str, int]]:
    """(type, index) of the placeholders in an escaped content; escaped look-alikes are none."""
    return [(m[2], int(m[3])) for m in _HOLDER.finditer(content)]


PART = "array<struct<type:string,text:string,ref:string,size:bigint>>"
HELD = "array<struct<index:int,type:string,ref:string,tokens:bigint>>"
OUT = f"formatted string, loss_spans array<struct<start:bigint,stop:bigint>>, attachments {HELD}, expanded_tokens long"
TURN = f"place long, start long, formatted string, loss_start long, loss_stop long, attachments {HELD}, expanded_tokens long"


def text_parts(df: DataFrame, text_col: str = "text", to: str = "parts") -> DataFrame:
    """Adds a content column of one text part for each row."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size"))
    return df.withColumn(to, F.array(part))


_NONE = object()  # no conversation yet; an id may be None


def _other(one: object, two: object) -> bool:
    """Whether two ids differ; not-a-number is one id."""
    return one is _NONE or one != two and not (one != one and two != two)


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


_ATTACHMENTS = pa.list_(pa.struct([("index", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per turn: conv_id, place (from 0), start, formatted, loss_start, loss_stop, attachments, expanded_tokens.

    start is where the turn begins in the conversation's text, loss_start and loss_stop frame an assistant's content
    there (null for others), all in code points. Attachments are numbered through the conversation. Rows of a
    conversation lie in one partition, in order.
    """
    turns = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(parts_col).cast(PART).alias("parts"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts"))
    names = ["conv_id", "place", "start", "formatted", "loss_start", "loss_stop", "attachments", "expanded_tokens"]

    def run(batches):
        conv, place, size, count = _NONE, 0, 0, 0
        for b in batches:
            out = []
            for c, role, parts in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "parts")), strict=True):
                if _other(conv, c):
                    conv, place, size, count = c, 0, 0, 0
                walker = Flattener(count)
                turn = format_turn(role, parts, walker)
                inner = (size + len(START + "assistant" + MIDDLE), size + len(turn) - len(END)) if role == "assistant" else (None, None)
                held = [dict(zip(("index", "type", "ref", "tokens"), a, strict=True)) for a in walker.attachments]
                out.append((c, place, size, turn, *inner, held, sum(a["tokens"] for a in held)))
                place, size, count = place + 1, size + len(turn), count + len(held)
            long = pa.int64()
            yield _columns(out, names, [b.column("conv_id").type, long, long, pa.string(), long, long, _ATTACHMENTS, long])

    return dealt.select("conv_id", "role", "parts").mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, {TURN}")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points of assistant contents), attachments, expanded_tokens.

    A conversation's text is one string here; where conversations may be longer than a string can be, use format_turns.
    """
    formatted = format_turns(turns, conv_col, turn_col, role_col, parts_col)

    def run(batches):
        conv, pieces, spans, held = _NONE, [], [], []
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def closed(key):
            row = (conv, "".join(pieces), spans, held, sum(a["tokens"] for a in held))
            return _columns([row], ["conv_id", "formatted", "loss_spans", "attachments", "expanded_tokens"], [key, pa.string(), span, _ATTACHMENTS, pa.int64()])

        key = None
        for b in batches:
            key = b.column("conv_id").type
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c, _, _, turn, first, last, attached, _ = r
                if _other(conv, c):
                    if conv is not _NONE:
                        yield closed(key)
                    conv, pieces, spans, held = c, [], [], []
                pieces.append(turn)
                held += attached
                if first is not None:
                    spans.append({"start": first, "stop": last})
        if conv is not _NONE:
            yield closed(key)

    return formatted.mapInArrow(run, f"conv_id {dict(formatted.dtypes)['conv_id']}, {OUT}")


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


class Reader:
    """Reads formatted turns of one conversation back, one after the other; holds digests, no texts."""

    def __init__(self, conv: object):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, spans: list[tuple[int, int]]) -> None:
        """A stretch of whole turns and what lies under the loss mask in it, in code points from the conversation's begin."""
        for role, text, _, _ in parse_turns(formatted):
            self.whole.update(f"{role}\n{text}\n".encode())
            self.turns += 1
        for first, last in spans:
            told = unescape(formatted[first - self.chars : last - self.chars])
            self.loss.update(told.encode())
            self.loss_chars += len(told)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(formatted: DataFrame, run) -> DataFrame:
    return formatted.mapInArrow(run, f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    return _columns(rows, _DIGESTS, [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])


def turn_digests(formatted: DataFrame, dealt: bool = True) -> DataFrame:
    """What is read back from the rows of format_turns: turns, and the text under the loss mask, streamed.

    Rows are taken as format_turns deals them; `dealt=False` deals and sorts them again (rows that were stored in
    between). A turn that is not the next one of its conversation is an error.
    """
    rows = formatted.select("conv_id", "place", "start", "formatted", "loss_start", "loss_stop")
    if not dealt:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches):
        reader, key = Reader(_NONE), None
        for b in batches:
            key, done = b.column("conv_id").type, []
            for c, place, start, turn, first, last in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if _other(reader.conv, c):
                    if reader.conv is not _NONE:
                        done.append(reader.row())
                    reader = Reader(c)
                if (place, start) != (reader.turns, reader.chars):
                    raise ValueError(f"turn {place} of conversation {c!r} at {start} does not follow turn {reader.turns - 1}")
                reader.read(turn, [] if first is None else [(first, last)])
            if done:
                yield _digest_batch(done, key)
        if reader.conv is not _NONE:
            yield _digest_batch([reader.row()], key)

    return _read_back(rows, run)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns, and the text under the loss mask."""

    def run(batches):
        for b in batches:
            out = []
            for conv, text, spans in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_spans")), strict=True):
                reader = Reader(conv)
                reader.read(text, [(s["start"], s["stop"]) for s in spans])
                out.append(reader.row())
            yield _digest_batch(out, b.column("conv_id").type)

    return _read_back(formatted.select("conv_id", "formatted", "loss_spans"), run)


#: The conversation that the contract adds: its texts hold the template's own marks.
PROBE = r"\### Assistant: </turn> ok"


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
