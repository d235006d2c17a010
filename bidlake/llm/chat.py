"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn; each turn is closed in itself:

    [SYS] text [/SYS]      system         [INST] text [/INST]    user
    [BOT] text </s>        assistant      [ROLE:name] text [/ROLE]    any other role

Under the loss mask stands the text of assistant turns, without its marks.

Round trip. A turn is first rendered with its text as it is and parsed again; if anything
but the one same turn comes back, it is rendered with its text escaped and a `*` in its
opening mark, and parsed again: in an escaped text `\\` is `\\\\`, and each control string's
first character is `\\b` for `[` and `\\l` for `<`. The grammar has no turn with a control
string in it, so texts that hold one come back only when escaped, and others are not touched.
A text that still came back changed would stop the job.

Rendering and its check need no shuffle. Reading back sorts a conversation's segments into one
stream; the parser is fed that stream and finds the turns in it by the grammar, in memory
bounded by the longest turn even where one conversation holds a third of all rows. The text
under the loss mask is cut out of the stream by the mask's places.

Defined cases. Null text counts as empty, null role as the empty role name, null turns come
first. Rows that share conv_id and turn are all turns, ordered by role and then by the text itself.
Conversations with a null id are one conversation. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = {"system": ("[SYS", "[/SYS]"), "user": ("[INST", "[/INST]"), "assistant": ("[BOT", "</s>")}
OTHER = ("[ROLE", "[/ROLE]")
_CONTROL = re.compile(r"\[/?(?:SYS|INST|BOT|ROLE)|</?s>")
_OPEN = re.compile(r"\[(SYS|INST|BOT|ROLE)(\*?)(?::((?:[^\]%]|%[0-9A-F]{2})*))?\] ")
_ROLE_OF = {"SYS": "system", "INST": "user", "BOT": "assistant"}
_CLOSE = {"SYS": " [/SYS]", "INST": " [/INST]", "BOT": " </s>", "ROLE": " [/ROLE]"}
SEGMENT = "conv_id {id}, turn {turn}, role string, segment string, escaped string, text_start int, text_length int, loss_start int, loss_length int"


def _name(role: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), role)


def _unname(name: str) -> str:
    return re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), name)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ("\\b" if m[0][0] == "[" else "\\l") + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"\\": "\\", "b": "[", "l": "<"}[m[1]], text, flags=re.S)


def render(role: str, text: str, escaped: bool) -> tuple[str, int, int]:
    """A turn's segment, and where its text starts and how long it is there."""
    open_, close = MARKS.get(role, OTHER)
    head = f"{open_}{'*' if escaped else ''}{'' if role in MARKS else ':' + _name(role)}] "
    body = escape(text) if escaped else text
    return f"{head}{body} {close}", len(head), len(body)


class Reader:
    """A parser that is fed a rendered stream in pieces, cut anywhere.

    Its turns are (role, text, start, body, escaped): the body is the text as it stands in the
    stream, from code point start on. ValueError where the stream is none of the grammar.
    """

    def __init__(self):
        self.held, self.base, self.mark, self.seen = "", 0, None, 0

    def feed(self, piece: str):
        self.held += piece
        while True:
            if self.mark is None:
                self.mark = _OPEN.match(self.held)
                if self.mark is None:
                    if "] " in self.held or not self.held.startswith("["[: len(self.held)]):
                        raise ValueError(f"no turn at {self.base}")
                    return
                if (self.mark[1] == "ROLE") != (self.mark[3] is not None):
                    raise ValueError(f"no turn at {self.base}")
                self.seen = self.mark.end()
            m, close = self.mark, _CLOSE[self.mark[1]]
            end = self.held.find(close, self.seen)
            if end < 0:
                self.seen = max(self.seen, len(self.held) - len(close) + 1)
                return
            body = self.held[m.end() : end]
            if _CONTROL.search(body):
                raise ValueError(f"a control string in the turn at {self.base}")
            yield _ROLE_OF.get(m[1]) or _unname(m[3]), unescape(body) if m[2] else body, self.base + m.end(), body, bool(m[2])
            at = end + len(close)
            self.held, self.base, self.mark = self.held[at:], self.base + at, None

    def close(self) -> None:
        if self.held:
            raise ValueError(f"no end for the turn at {self.base}")


def parse(stream: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered stream: role, text, start and length of the text's own place. ValueError if it is none."""
    reader = Reader()
    out = [(role, text, start, len(body)) for role, text, start, body, _ in reader.feed(stream)]
    reader.close()
    return out


def rendered(role: str, text: str) -> tuple[str, bool, int, int]:
    """The turn's segment that parses back to it: as it is if that will do, else escaped."""
    for escaped in (False, True):
        segment, start, length = render(role, text, escaped)
        try:
            if parse(segment) == [(role, text, start, length)]:
                return segment, escaped, start, length
        except ValueError:
            pass
    raise ValueError(f"a turn of role {role!r} doesn't survive its round trip")


def formatted(turns: DataFrame) -> DataFrame:
    """Segments of all turns (conv_id, turn, role, text); in order they are the conversations' renderings.

    Where a segment is escaped, `escaped` holds its text, which the order of ties needs; else it is null.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            roles, texts = [r or "" for r in batch.column(2).to_pylist()], [t or "" for t in batch.column(3).to_pylist()]
            got = [rendered(r, t) for r, t in zip(roles, texts, strict=True)]
            segment, escaped, start, length = zip(*got, strict=True) if got else [()] * 4
            under = [r == "assistant" for r in roles]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(segment, pa.string()), pa.array([t if e else None for t, e in zip(texts, escaped, strict=True)], pa.string()), pa.array(start, pa.int32()), pa.array(length, pa.int32()),
                    pa.array([n if k else None for n, k in zip(start, under, strict=True)], pa.int32()), pa.array([n if k else None for n, k in zip(length, under, strict=True)], pa.int32()),
                ],
                ["conv_id", "turn", "role", "segment", "escaped", "text_start", "text_length", "loss_start", "loss_length"],
            )

    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kinds = {k: rows.schema[c].dataType.simpleString() for k, c in (("id", "conv_id"), ("turn", "turn"))}
    return rows.mapInArrow(run, SEGMENT.format(**kinds))


def _text():
    """A segment's text."""
    return F.coalesce("escaped", F.substring("segment", F.col("text_start") + 1, F.col("text_length")))


def conversations(segments: DataFrame) -> DataFrame:
    """Whole renderings, conv_id and formatted, for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", _text().alias("text"), "segment")))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("formatted"))


class Digest:
    """What one conversation's stream says, segment by segment."""

    def __init__(self):
        self.reader, self.turns, self.loss = Reader(), hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.size = self.escaped = 0
        self.mask: list[tuple[int, int]] = []

    def add(self, segment: str, loss_start: int | None, loss_length: int | None) -> None:
        if loss_start is not None:
            self.mask.append((self.size + loss_start, loss_length))
        self.size += len(segment)
        for role, text, start, body, escaped in self.reader.feed(segment):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n, self.escaped = self.n + 1, self.escaped + escaped
            while self.mask and self.mask[0][0] < start + len(body) + 1:
                at, length = self.mask.pop(0)
                if at < start or at + length > start + len(body):
                    raise ValueError(f"the loss mask at {at} leaves its turn")
                under = body[at - start : at - start + length]
                under = unescape(under) if escaped else under
                self.loss.update(under.encode())
                self.chars += len(under)

    def row(self) -> tuple:
        self.reader.close()
        if self.mask:
            raise ValueError(f"the loss mask at {self.mask[0][0]} is in no turn")
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size, self.escaped


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, by the parser and the loss mask, from its rendering alone."""

    def run(batches):
        import pyarrow as pa

        now, state, out, kind = None, None, [], None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped"]

        def rows():
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            kind = batch.column(0).type
            for conv, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if now is not None:
                        out.append((*now, *state.row()))
                    now, state = (conv,), Digest()
                state.add(*part)
            if len(out) >= 10_000:
                yield rows()
                out = []
        if now is not None:
            out.append((*now, *state.row()))
            yield rows()

    kind = segments.schema["conv_id"].dataType.simpleString()
    stream = segments.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", _text())
    return stream.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long")


def with_planted(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
