"""Chat formatting of typed content parts.

A visitor flattens the parts of each turn (text, image, audio, document) into
one string: texts with control strings escaped, attachments as numbered
placeholders, with a list of references and of the tokens each will take.
A template marks the turns; :func:`parse` reads turns and loss spans back.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"

#: One image token covers a square of so many pixels a side.
PATCH = 28
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 256

#: Strings that the template or the placeholders give a meaning, split after their first character.
_CONTROL = r"(s>|/s>|<SYS>>|</SYS>>|\|(?:image|audio|document):\d+\|>)"
_BRACKET = r"(INST\]|/INST\]|SYS\]|/SYS\]|ROLE |/ROLE\])"
_RAW = re.compile(rf"(<)(\\*)(?={_CONTROL})|(\[)(\\*)(?={_BRACKET})")
_ESCAPED = re.compile(rf"(<)\\(\\*)(?={_CONTROL})|(\[)\\(\\*)(?={_BRACKET})")


def escape(text: str) -> str:
    """Put one backslash more after the first character of every control string, escaped ones too."""
    return _RAW.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or ""), text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _ESCAPED.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or ""), text)


class Flattener:
    """Visits the parts of a conversation in order; keeps references and token counts of attachments.

    Neighbouring texts are escaped as one, so no control string can arise where they meet.
    """

    def __init__(self) -> None:
        self.attachments: list[dict] = []
        self.run: list[str] = []

    def flatten(self, parts: list[dict]) -> str:
        out = [x for part in parts for x in (self.visit(part),) if x]
        return "".join([*out, self.close()])

    def close(self) -> str:
        """The texts since the last attachment, escaped."""
        text, self.run = escape("".join(self.run)), []
        return text

    def visit(self, part: dict) -> str:
        kind = part.get("type") or "text"
        return getattr(self, f"visit_{kind}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> str:
        self.run.append(part.get("text") or "")
        return ""

    def visit_image(self, part: dict) -> str:
        across, down = (math.ceil(max(part.get(k) or 1, 1) / PATCH) for k in ("width", "height"))
        return self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_A_SECOND)))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, max(1, part.get("pages") or 1) * DOCUMENT_TOKENS_A_PAGE)

    def visit_unknown(self, part: dict) -> str:
        raise ValueError(f"unknown part type {part.get('type')!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append({"index": len(self.attachments), "type": kind, "uri": part.get("uri"), "tokens": tokens})
        return f"{self.close()}<|{kind}:{len(self.attachments) - 1}|>"


def open_turn(role: str | None) -> tuple[str, str]:
    """What stands before and after a turn's flattened content."""
    if role == "user":
        return "[INST] ", " [/INST]"
    if role == "system":
        return "[SYS] ", " [/SYS]"
    if role == "assistant":
        return " ", "</s>"
    name = json.dumps(role).replace("]", "\\u005d").replace("[", "\\u005b").replace("<", "\\u003c")
    return f"[ROLE {name}] ", " [/ROLE]"


START = "<s>"


def render(turns: list[tuple[str | None, list[dict]]]) -> dict:
    """The formatted conversation, its attachments, and the spans under the loss mask (assistant contents)."""
    flat, out, spans, at = Flattener(), [START], [], len(START)
    for role, parts in turns:
        before, after = open_turn(role)
        body = flat.flatten(parts or [])
        if role == "assistant":
            spans.append({"start": at + len(before), "end": at + len(before) + len(body)})
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return {"formatted": "".join(out), "attachments": flat.attachments, "loss_spans": spans}


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """Roles and unescaped contents (placeholders as they stand) of a formatted conversation."""
    if not formatted.startswith(START):
        raise ValueError("no start mark")
    turns, at = [], len(START)
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            role, begin, after = "user", at + 7, " [/INST]"
        elif formatted.startswith("[SYS] ", at):
            role, begin, after = "system", at + 6, " [/SYS]"
        elif formatted.startswith("[ROLE ", at):
            close = formatted.index("] ", at)
            role, begin, after = json.loads(formatted[at + 6 : close]), close + 2, " [/ROLE]"
        elif formatted.startswith(" ", at):
            role, begin, after = "assistant", at + 1, "</s>"
        else:
            raise ValueError(f"no turn at {at}")
        end = formatted.index(after, begin)
        turns.append((role, unescape(formatted[begin:end])))
        at = end + len(after)
    return turns


FORMATTED = (
    "conv_id long, n_turns long, formatted string, "
    "attachments array<struct<index:int,type:string,uri:string,tokens:int>>, loss_spans array<struct<start:long,end:long>>"
)
_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("formatted", pa.string()),
        ("attachments", pa.list_(pa.struct([("index", pa.int32()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int32())]))),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One formatted row for each conversation.

    ``turns`` has conv_id, turn, role and either ``parts`` (an array as in
    ``PARTS``) or ``text``.  Turns go by turn number, null first, then by role
    and content; repeated rows are turns of their own.  Null texts and part
    lists are empty, unknown and null roles are kept, rows of null conv_id
    form one conversation, an empty table gives an empty result, and further
    columns, whatever their names, are ignored.  Rows stream through in order,
    so a task holds one conversation, its very long texts too, at a time.
    """
    if "parts" in turns.columns:
        parts = F.col("parts").cast(PARTS)
    else:
        empty = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
        parts = F.array(
            F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).cast(t).alias(n) for n, t in empty.items()])
        )
    narrow = turns.select(F.col("conv_id").cast("long"), "turn", "role", parts.alias("parts"))
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json(F.struct("parts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, held, done, chars = none, [], [], 0

        def close() -> None:
            nonlocal chars
            row = {"conv_id": now, "n_turns": len(held), **render(held)}
            chars += len(row["formatted"])
            done.append(row)

        def flush() -> pa.RecordBatch:
            nonlocal chars
            out = pa.RecordBatch.from_pylist(list(done), schema=_ARROW)
            done.clear()
            chars = 0
            return out

        for batch in batches:
            for conv, role, content in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if now is none or conv != now:
                    if now is not none:
                        close()
                        if chars > 1 << 23:
                            yield flush()
                    now, held = conv, []
                held.append((role, content))
        if now is not none:
            close()
        yield flush()

    return dealt.mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted strings alone: turns from the template, losses from the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = parse(text)
                loss = [unescape(text[s["start"] : s["end"]]) for s in row["loss_spans"]]
                out.append(
                    {
                        "conv_id": row["conv_id"],
                        "n_turns": len(turns),
                        "turns_sha256": hashlib.sha256("".join(f"{r or ''}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                        "loss_chars": sum(map(len, loss)),
                        "loss_sha256": hashlib.sha256("".join(loss).encode()).hexdigest(),
                        "formatted_chars": len(text),
                    }
                )
            names = [x.split()[0] for x in DIGEST.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(zip(names, kinds, strict=True))))

    return formatted.mapInArrow(run, DIGEST)
