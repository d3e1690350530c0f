"""Cited claims: which statements of an answer lean on which references.

An answer is read line by line into units, the cells of tables and the
sentences of prose and lists.  A marker group (``[1]`` or ``[2][3]``) closes
the stretch of its unit before it; before a verb of report it is carried
forward to the stretch after it.  Units without markers can still name a
source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieve import named_sources

# Marks that end a sentence, pairs of quotes, dashes of ranges, and what may stand after a unit's last marker.
ENDS = "。！？!?"
QUOTES = {"“": "”", "「": "」", "『": "』", '"': '"', "'": "'"}
_DASH = "[-–—~至]"
_AFTER_LAST = re.compile(r"[\s，、。；：:（）()【】\[\]「」『』“”\"''!?！？…—\-]*")
_BETWEEN = re.compile(r"[\s、，,；;]*")
_TRIMMED = " \t，、；：:。"

# What marks a unit as talk about the material instead of a statement.
_ABOUT_MATERIAL = re.compile(
    r"(?:资料|条目|编号|引用)\s*[\[【]"
    r"|\[[0-9]+\s*[-–—~至]\s*[0-9]+\]"
    r"|检索(?:到|了)?的?(?:资料|片段|内容)|知识库[中里]?(?:检索|收录|均不完整|不完整)"
    r"|未收录|未覆盖|未呈现全文|摘录片段|节选|覆盖(?:不足|不全|不到)"
    r"|资料(?:不足|缺失|局限)|(?:资料|材料|素材)[中里]?[^。！？]{0,30}?(?:不完整|局限)"
    r"|相关?条目|(?:引用|资料|素材)说明|以上对比|以下对比|目前可见"
    r"|资料(?:较完整|部分缺失|并不完整|有限|不足)|材料(?:较完整|部分缺失|并不完整|不对称|不足)"
    r"|前几段|手中只有|均以.{0,6}为主|真实边界|完整性或缺失"
    r"|(?:相关)?引用均?出自|条目均?同属|非多篇独立文章"
    r"|仅为(?:致谢|目录|链接)|为(?:知识库)?目录(?:结构)?[图树]|继续阅读.{0,4}链接栏"
    r"|内容信息量有限|未纳入实质性对比|另外要澄清|需要说明的是"
    r"|^\s*(?:我将|我来|下面|以下|综上|本文|这里|如需|如果你需要|备注|注[:：]|说明[:：]|需要先说明)"
)
# Verbs with which a sentence reports what a source says, and words that may stand before one.
REPORTS = "说 指出 称 认为 写道 写到 记录 讨论 介绍 提到 提及 表示 强调 描述 总结 归纳 主张 解释 说明 建议 警告 声称 补充 坦言 表明".split()
LEADS = "中 文中 上文中 文章里 文里 就 进一步 也 则 又 曾 已 还 更 在 随即 随后 同时 并 亦".split()
STATED = "核心主张 核心观点 核心命题 主题 主张 指出 认为 称 强调 提到 提及 讨论 介绍 描述 记录 总结 归纳 提出 写道 写到 表示".split()
SHORTEST_NAMED = 18

_REPORTED = re.compile(f"(?:{'|'.join(LEADS)})?(?:{'|'.join(REPORTS)})")
_STATES = re.compile(f"{'|'.join(STATED)}|[：:]\\s*.{{8,}}")
_MARKER = re.compile(rf"(?:\[[0-9]+\] *{_DASH} *)+\[[0-9]+\]|\[[0-9]+(?: *{_DASH} *[0-9]+)?\]")
_LAST_MARKERS = re.compile(r"([。！？!?])\s*((?:\[\d+\])+)\s*$")
_RULE = re.compile(r"\|?[\s|]*:?-{2,}:?(?:\s*\|\s*(?::?-{2,}:?)?)*\s*")
_CONTENT = re.compile("[一-鿿A-Za-z]")


def sentences_of(line: str) -> Iterator[str]:
    """Sentences of a line; quotes are not cut, nor are markers that end the line parted from their sentence."""
    tail = _LAST_MARKERS.search(line)
    if tail:
        line = line[: tail.start()] + tail.group(2)
    begin, closing = 0, None
    for i, ch in enumerate(line):
        if closing:
            closing = None if ch == closing else closing
        else:
            closing = QUOTES.get(ch)
        if closing is None and ch in ENDS:
            yield line[begin : i + 1]
            begin = i + 1
    yield line[begin:]


def units_of(answer: str) -> Iterator[str]:
    """Cells of tables and sentences of all other lines, without empty ones."""
    for line in answer.splitlines():
        row = line.strip()
        if _RULE.fullmatch(row):
            continue
        parts = row.removeprefix("|").removesuffix("|").split("|") if row.startswith("|") else sentences_of(line)
        yield from filter(None, map(str.strip, parts))


def marker_groups(unit: str) -> list[tuple[list[str], int, int]]:
    """(refs, start, end) of each run of markers with nothing but white space and commas between; ranges are no markers."""
    groups: list[tuple[list[str], int, int]] = []
    for m in _MARKER.finditer(unit):
        if not m.group()[1:-1].isdigit():
            continue
        if groups and _BETWEEN.fullmatch(unit, groups[-1][2], m.start()):
            refs, start, _ = groups.pop()
            groups.append(([*refs, m.group()], start, m.end()))
        else:
            groups.append(([m.group()], m.start(), m.end()))
    return groups


def unit_claims(unit: str) -> Iterator[tuple[str, list[str]]]:
    """(claim, refs) of each stretch that a marker group closes, or that follows one before a verb of report."""
    groups, begin, carried = marker_groups(unit), 0, []
    for refs, start, end in groups:
        if _REPORTED.match(unit[end:].lstrip()):
            carried += refs
            continue
        closes_unit = end == groups[-1][2] and _AFTER_LAST.fullmatch(unit, end)
        yield unit[begin : None if closes_unit else start], carried + refs
        begin, carried = end, []
    if carried:
        yield unit[begin:], carried


@F.udtf(returnType="seq int, claim string, refs array<string>, note string", useArrow=False)
class CitedClaims:
    """Rows of an answer: ``block`` claims with their refs, and units without markers that state something (``named``)."""

    def eval(self, answer: str):
        seq = 0
        for unit in units_of(answer or ""):
            if _ABOUT_MATERIAL.search(unit):
                continue
            anchored = [(text, refs) for raw, refs in unit_claims(unit) if _CONTENT.search(text := raw.strip().strip(_TRIMMED))]
            bare = re.sub(r"^#+\s*", "", unit).strip()
            if not anchored and len(bare) >= SHORTEST_NAMED and _STATES.search(unit):
                yield seq, bare, [], "named"
                seq += 1
            for text, refs in anchored:
                yield seq, text, refs, "block"
                seq += 1


def cited_claims(answers: DataFrame, key: str, answer: Column, aliases: list[tuple[str, str]] = (), present: str | None = None) -> DataFrame:
    """(key, seq, claim, refs, note) of each answer's cited claims, in their order.

    ``note`` is ``block`` for claims with markers.  With ``aliases`` (phrase,
    source) a statement without markers that names exactly one source among
    those of the array column ``present`` has note ``source`` and that source
    as its only ref.  Null and empty answers have no claims; answers of any
    length are read whole, and repeated rows each have their claims.
    """
    held = answers.select(F.col(key).alias("__key"), answer.alias("__answer"), (F.col(present) if present else F.array().cast("array<string>")).alias("__present"))
    rows = held.lateralJoin(CitedClaims(F.col("__answer").outer()))
    named = named_sources(rows.withColumn("text", F.col("claim")), list(aliases)) if aliases else rows.withColumn("sources", F.array().cast("array<string>"))
    here = F.array_intersect("sources", "__present")
    is_source = (F.col("note") == "named") & (F.size(here) == 1)
    return named.filter((F.col("note") == "block") | is_source).select(
        F.col("__key").alias(key), "seq", "claim", F.when(is_source, here).otherwise(F.col("refs")).alias("refs"), F.when(is_source, "source").otherwise("block").alias("note")
    )
