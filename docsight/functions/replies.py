"""Reading the JSON of a model's reply, however it was broken on the way."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json)?\s*", re.I)
_CLOSES = {"{": "}", "[": "]"}
_CONTROL = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def repair_json(text: str | None) -> tuple[str | None, list[str]]:
    """The first object or array of a reply as compact JSON, and what had to be repaired; None if there is none.

    Repairs, in the order in which they are met: ``fence`` (a code fence taken
    off), ``before`` and ``after`` (other text around), ``control`` (raw line
    ends or tabs in strings), ``comma`` (one before a closing bracket) and
    ``cut`` (an end that is missing or closes what is not open: open strings
    and brackets are closed, and a last member that cannot stand is dropped).
    """
    body = (text or "").strip()
    found: list[str] = []

    def note(what: str) -> None:
        if what not in found:
            found.append(what)

    if m := _FENCE.match(body):
        body = body[m.end() :].removesuffix("```").rstrip()
        note("fence")
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None, found
    if start:
        note("before")
    out: list[str] = []
    open_: list[str] = []
    safe: tuple[int, list[str]] = (0, [])  # up to where members are whole, and what is open there
    quoted = escaped = False
    end = len(body)
    for at in range(start, len(body)):
        ch = body[at]
        if quoted:
            if not escaped and ch in _CONTROL:
                out.append(_CONTROL[ch])
                note("control")
                continue
            quoted = escaped or ch != '"'
            escaped = not escaped and ch == "\\"
        elif ch == '"':
            quoted = True
        elif ch in "]}":
            if _CLOSES[open_[-1]] != ch:
                end = at
                break
            while out and out[-1].isspace():
                out.pop()
            if out[-1] == ",":
                out.pop()
                note("comma")
            open_.pop()
        out.append(ch)
        if not quoted and ch in "{[":
            open_.append(ch)
            safe = len(out), list(open_)
        elif not quoted and ch == ",":
            safe = len(out) - 1, list(open_)
        if not open_:
            end = at + 1
            break
    if body[end:].strip() and not open_:
        note("after")
    if open_:
        note("cut")
        if escaped:
            out.pop()
    tries = ["".join(out) + ('"' if quoted else "") + "".join(_CLOSES[b] for b in reversed(open_))]
    if open_:
        tries.append("".join(out[: safe[0]]) + "".join(_CLOSES[b] for b in reversed(safe[1])))
    for one in tries:
        try:
            return json.dumps(json.loads(one), ensure_ascii=False, separators=(",", ":")), found
        except ValueError:
            continue
    return None, found


_SHAPE = T.StructType([T.StructField("json", T.StringType()), T.StructField("repairs", T.ArrayType(T.StringType()))])


@F.pandas_udf(_SHAPE)
def _repaired(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair_json(t) for t in texts], columns=["json", "repairs"])


def repaired(reply: Column) -> Column:
    """STRUCT<json, repairs> of :func:`repair_json`; null and empty replies have no JSON and no repairs."""
    return _repaired(reply)
