"""URL filters as a temporal list join.

Dated list entries (added or removed on a day) become validity intervals;
an as-of join evaluates every capture against the entries active when it
was fetched.  An entry covers a domain with its subdomains, or a path prefix
of one host.  A capture is exploded into the keys that could cover it, so
the join is an equi-join with a date range and needs no pattern matching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_URL = r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; null if there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.$", "")
    return F.when(found != "", found)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def keys(url: Column) -> Column:
    """Keys of every entry that could cover the URL: ``d:`` domain suffixes, ``p:`` host with leading path segments."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    paths = F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda i: F.concat(F.lit("p:"), host(url), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")),
    )
    return F.when(host(url).isNotNull(), F.concat(domains, F.when(F.size(segments) > 0, paths).otherwise(F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_id, key, since, until) of times in which an entry holds: from its day to the entry's next day, until null: open.

    ``entries`` has list_id, key, day (date) and action ('add' or 'remove').
    Several on a day count as one, a removal winning; rows with a null in
    any of these are ignored, as are removals of what was never added.
    """
    daily = entries.filter(
        F.col("list_id").isNotNull() & F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove")
    ).groupBy("list_id", "key", F.col("day").cast("date").alias("day")).agg(F.max("action").alias("action"))
    by = Window.partitionBy("list_id", "key").orderBy("day")
    spans = daily.withColumn("until", F.lead("day").over(by))
    return spans.filter("action = 'add'").select("list_id", "key", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Lists that cover each distinct (url, day) of the captures: url, day, lists, matched, blocked.

    The same URL fetched twice on a day is evaluated once, and so is every
    key on a day, which bounds a hot host's share of the join by the number
    of days.  ``lists`` and ``matched`` are sorted; uncovered captures have
    empty ones.  Null or unparsable URLs and null days are covered by
    nothing, a very long URL has a key for each of its labels and segments,
    an empty table gives an empty result, and further columns, whatever their
    names, are ignored.
    """
    dated = captures.select("url", F.col("day").cast("date").alias("day"))
    asked = dated.distinct()
    wanted = dated.select("url", "day", F.explode(keys(F.col("url"))).alias("key")).distinct()  # keys are made where the captures are read
    active = (
        wanted.select("key", "day")
        .distinct()
        .alias("w")
        .join(
            intervals(entries).alias("i"),
            (F.col("w.key") == F.col("i.key"))
            & (F.col("w.day") >= F.col("i.since"))
            & (F.col("i.until").isNull() | (F.col("w.day") < F.col("i.until"))),
        )
        .groupBy(F.col("w.key").alias("key"), F.col("w.day").alias("day"))
        .agg(F.collect_set("list_id").alias("found"))
    )
    covered = (
        wanted.join(active, ["key", "day"])
        .groupBy("url", "day")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("lists"), F.array_sort(F.collect_set("key")).alias("matched"))
    )
    both = asked.alias("a").join(covered.alias("c"), F.col("a.url").eqNullSafe(F.col("c.url")) & F.col("a.day").eqNullSafe(F.col("c.day")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        F.col("a.url").alias("url"),
        F.col("a.day").alias("day"),
        F.coalesce("lists", none).alias("lists"),
        F.coalesce("matched", none).alias("matched"),
        F.col("lists").isNotNull().alias("blocked"),
    )
