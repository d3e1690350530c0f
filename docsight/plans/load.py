"""From raw pages to sectioned, offset-accurate chunks, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest as ig


def page_chunks(pages: DataFrame, key: str, column: str, cap: int, parse=ig.html_sections) -> DataFrame:
    """(key, section, path, seq, start, end, text): each section's paragraphs packed up to ``cap`` characters.

    Offsets are places in the section's text, its paragraphs joined by line
    ends.  Narrow all through: nothing is shuffled.
    """
    each = ig.sections(pages, key, column, parse).select(key, F.posexplode("sections").alias("section", "s"))
    texts = each.select(F.struct(key, "section", F.col("s.path").alias("path"), F.array_join("s.paragraphs", "\n").alias("whole")).alias("at"), F.array_join("s.paragraphs", "\n").alias("text"))
    packed = ig.pack(texts, "at", "text", cap)
    return packed.select(f"at.{key}", "at.section", "at.path", "seq", "start", "end", F.substring("at.whole", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
