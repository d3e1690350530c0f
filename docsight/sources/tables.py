"""Sources and sinks: bytes, catalogues, logs, line tables, and stores on Parquet."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _legacy(data: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode("gb18030")
        except UnicodeDecodeError:
            return bytes(b).decode("utf-8", "replace")

    return data.map(one)


def decoded(data: Column) -> Column:
    """Text of file bytes: a UTF-8 mark is dropped; UTF-8, else GB18030, else UTF-8 with replacements; null stays null.

    Valid UTF-8 never leaves the JVM: the UDF sees nulls in its place.
    """
    mark = F.lit(bytearray(codecs.BOM_UTF8))
    body = F.when(F.substring(data, 1, 3) == mark, F.substring(data, F.lit(4), F.length(data))).otherwise(data)
    text = body.cast("string")
    valid = F.is_valid_utf8(text)
    return F.when(valid, text).otherwise(_legacy(F.when(~valid, body)))


#: Columns of a catalogue row, in order.
CATALOG = ("source_id", "category", "name", "url", "license", "risk", "carrier", "paths", "status")


def catalog_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Source documents of a Markdown table: rows of nine cells or more whose first cell is capitals and digits.

    ``paths`` is split at semicolons, ``collected`` tells of a check mark in
    the status, ``knowledge_date`` is the first year and month in the name.
    """
    line = F.trim(F.col(column))
    cells = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.filter(line.startswith("|")).select(cells.alias("c")).filter((F.size("c") >= 9) & F.col("c")[0].rlike(r"^[A-Z]+[0-9]*$"))
    named = rows.select(*[F.col("c")[i].alias(n) for i, n in enumerate(CATALOG)])
    return named.select(
        *CATALOG[:7],
        F.filter(F.transform(F.split("paths", ";"), lambda p: F.trim(p)), lambda p: p != "").alias("paths"),
        F.contains("status", F.lit("✅")).alias("collected"),
        F.regexp_extract("name", r"(\d{4}-\d{2})", 1).alias("knowledge_date"),
    )


def usage_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Usage lines of a log, one for each (ts, purpose, prompt_tokens, completion_tokens).

    A line holds its time and, after the mark, ``key=value`` pairs; numbers end at the first other character.
    """
    names = ("ts", "model", "purpose", "prefix", "prompt_tokens", "completion_tokens", "total_tokens")
    pair = lambda key, value="[^,]*": F.regexp_extract(F.substring_index(column, "[LLM Usage]", -1), rf"\b{key}=({value})", 1)
    parts = [F.regexp_extract(column, r"(\d{4}-\d\d-\d\dT[\d:.]*\d)", 1), pair("model"), pair("purpose"), pair("prompt_prefix"), *(pair(k, "[0-9]+") for k in names[4:])]
    kept = lines.filter(F.col(column).contains("[LLM Usage]"))
    found = kept.select(*[p.alias(n) for p, n in zip(parts, names, strict=True)]).filter("ts != '' and model != '' and total_tokens != ''")
    typed = found.select(*names[:4], *[F.col(n).cast("long").alias(n) for n in names[4:]])
    return typed.groupBy("ts", "purpose", "prompt_tokens", "completion_tokens").agg(*[F.min(n).alias(n) for n in ("model", "prefix", "total_tokens")])


def line_sections(lines: DataFrame, key: str, footer: float = 56, ratio: float = 1.5, gap: float = 0.7, first: str = "引言") -> DataFrame:
    """(key, seq, path, paragraphs): sections of laid-out lines, told by size and place.

    ``lines``: key, page, line, page_height, top, bottom, size, text.  Lines
    in the footer band go, pages that open with "contents", and covers (six
    lines or fewer, all of size 20 or more).  Lines of ``ratio`` times the
    median size, 14 at least, are headings; such lines close together are
    one.  A gap over ``gap`` sizes starts a paragraph.  A word cut by a
    hyphen is joined if it goes on in lower case.  Sections without paragraphs go.
    """
    page = Window.partitionBy(key, "page")
    body = lines.filter(F.col("top") <= F.col("page_height") - footer).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    body = (
        body.withColumn("opens", F.lower(F.min_by("text", "line").over(page)))
        .withColumn("cover", (F.count(F.lit(1)).over(page) <= 6) & (F.min(F.coalesce("size", F.lit(0.0))).over(page) >= 20))
        .filter("opens != 'contents' and not cover")
    )
    sizes = body.groupBy(key).agg(F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(12.0)).alias("usual"))
    order = Window.partitionBy(key).orderBy("page", "line")
    laid = body.join(sizes, key).withColumn("head", F.coalesce(F.col("size") >= F.greatest(F.lit(14.0), F.col("usual") * ratio), F.lit(False)))
    laid = laid.withColumn("space", F.col("top") - F.lag("bottom").over(order)).withColumn("after", F.coalesce(F.lag("head").over(order), F.lit(False)))
    joins = F.col("head") & F.col("after") & (F.col("space") < F.col("usual") * 3)
    laid = laid.withColumn("seq", F.sum((F.col("head") & ~joins).cast("int")).over(order))
    breaks = ~F.col("head") & (F.col("after") | F.coalesce(F.col("space") > F.col("usual") * gap, F.lit(True)))
    laid = laid.withColumn("para", F.when(~F.col("head"), F.sum(breaks.cast("int")).over(order)))

    def joined(lines_: Column) -> Column:
        return F.aggregate(
            lines_,
            F.lit(""),
            lambda t, x: F.when(t == "", x["text"]).when(t.endswith("-") & x["text"].rlike(r"^\p{Ll}"), F.concat(F.substring(t, F.lit(1), F.length(t) - 1), x["text"])).otherwise(F.concat(t, F.lit(" "), x["text"])),
        )

    collected = laid.groupBy(key, "seq", "para").agg(joined(F.array_sort(F.collect_list(F.struct("page", "line", "text")))).alias("text"))
    parts = collected.groupBy(key, "seq").agg(
        F.coalesce(F.max(F.when(F.col("para").isNull(), F.col("text"))), F.lit(first)).alias("path"),
        F.array_sort(F.collect_list(F.when(F.col("para").isNotNull() & (F.col("text") != ""), F.struct("para", "text")))).alias("p"),
    )
    return parts.filter(F.size("p") > 0).select(key, "seq", "path", F.col("p.text").alias("paragraphs"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


class VersionedTable:
    """A keyed table on Parquet that is only appended to: every change is a row, the newest of a key is its state.

    Lost executors leave no half-written state, and a change rewrites
    nothing.  ``current`` shuffles once on the key; ``compact`` writes the
    state to another path.  Versions must not repeat within a key.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def put(self, rows: DataFrame, version: int) -> None:
        rows.withColumn("_version", F.lit(version).cast("long")).withColumn("_deleted", F.lit(False)).write.mode("append").parquet(self.path)

    def delete(self, keys: DataFrame, version: int) -> None:
        gone = keys.select(*self.keys).withColumn("_version", F.lit(version).cast("long")).withColumn("_deleted", F.lit(True))
        gone.write.mode("append").parquet(self.path)

    def current(self) -> DataFrame:
        """Newest state of all keys without deleted ones; columns that a later change lacks are null."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        others = [c for c in rows.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "_version").alias("s"))
        return newest.filter("not s._deleted").select(*self.keys, *[f"s.{c}" for c in others if not c.startswith("_")])

    def newest(self, order: str, n: int) -> DataFrame:
        return self.current().orderBy(F.desc(order), *self.keys).limit(n)

    def compact(self, path: str) -> None:
        self.current().withColumn("_version", F.lit(0).cast("long")).withColumn("_deleted", F.lit(False)).write.parquet(path)


def import_source(rows: DataFrame, path: str, source: str = "source_id") -> None:
    """Replace the sources that ``rows`` hold, and no others: partitions are overwritten one source at a time."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


#: The columns of a case file.
CASES = "case_id string, question string, category string, enabled boolean, criteria array<struct<name:string,weight:double>>, tags array<string>"


def read_cases(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Cases of a folder's JSON files with ``problems``, sorted: what is missing or wrong; none: a valid case.

    Files that are no JSON objects come back as cases without an id.
    """
    rows = spark.read.schema(CASES).option("multiLine", True).option("pathGlobFilter", pattern).json(folder)
    problems = F.array(
        F.when(F.trim(F.coalesce("case_id", F.lit(""))) == "", F.lit("no id")),
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.lit("no question")),
        F.when(F.coalesce(F.size("criteria"), F.lit(0)) < 1, F.lit("no criteria")),
        F.when(F.exists(F.coalesce("criteria", F.array().cast("array<struct<name:string,weight:double>>")), lambda c: F.coalesce(c["weight"] < 0, F.lit(False))), F.lit("negative weight")),
    )
    return rows.withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn("problems", F.array_sort(F.array_compact(problems)))


def write_report(rows: DataFrame, folder: str) -> None:
    """A report as JSON lines and, its nested columns as JSON text, as CSV with a header."""
    rows.write.mode("overwrite").json(f"{folder}/json")
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
