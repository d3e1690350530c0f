"""Which files of a source are read, and in which order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a text source may hold.
SUFFIXES = ("md", "html", "htm", "pdf", "txt")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``**/`` is any folders or none, ``*`` and ``?`` stay within a name."""
    ways = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(ways.get(part, re.escape(part)) for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob) if part) + "$"


def select_files(files: DataFrame, rules: dict[str, list[str]], default: list[str], first: list[str] = (), numbered: str = r"^chapter(\d+)\.md$") -> DataFrame:
    """(source, path, place): each source's distinct files that match its globs and have an allowed suffix.

    ``files``: source, path, relative to the source's folder.  Sources
    without a rule use ``default``.  Names listed in ``first`` come first, in
    that order, then numbered names by number, then the others by name in
    lower case; equal names by path.  Null paths go.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    listed = F.lit(False)
    for source, globs in rules.items():
        listed = listed | ((F.col("source") == source) & F.col("path").rlike("|".join(map(glob_pattern, globs))))
    others = ~F.coalesce(F.col("source").isin(list(rules)), F.lit(False)) if rules else F.lit(True)
    fits = F.coalesce(listed, F.lit(False)) | (others & F.col("path").rlike("|".join(map(glob_pattern, default))))
    allowed = F.regexp_extract(name, r"\.([^.]+)$", 1).isin(list(SUFFIXES))
    kept = files.select("source", "path").filter(fits & allowed).distinct()
    number = F.nullif(F.regexp_extract(name, numbered, 1), F.lit("")).try_cast("long")
    fixed = F.array_position(F.array(*map(F.lit, first)).cast("array<string>"), name)
    group = F.when(fixed > 0, 0).when(number.isNotNull(), 1).otherwise(2)
    order = Window.partitionBy("source").orderBy(group, F.when(fixed > 0, fixed).otherwise(number), name, "path")
    return kept.select("source", "path", F.row_number().over(order).alias("place"))


def placed(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns of a table as read from Parquet files, and ``place``: numbers in the order of its files' paths, then of their rows.

    The order does not depend on how the files are dealt over tasks.
    """
    each = rows.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    paths = rows.select(F.col("_metadata.file_path").alias("__file")).distinct()
    numbered = paths.select("__file", (F.row_number().over(Window.orderBy("__file")) - 1).cast("long").alias("__n"))  # one row for each file
    return each.join(F.broadcast(numbered), "__file").select(*columns, (F.shiftleft("__n", 40) + F.col("__row")).alias("place"))
