"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash.  A source's budget is met by taking the
documents whose hash lies below a threshold: words are summed by source and
hash bucket, the bucket in which the budget ends is split again, and so on
until the threshold falls between two hashes.  Nothing is sorted by hash
and thresholds of smaller budgets are nested in those of larger ones.
Sources, targets and thresholds are tables; there may be any number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

HASH_BITS = 63
LEVEL_BITS = 12
#: With no more sources than this the table of sources is broadcast; with more it is joined, and the result is the same.
BROADCAST_SOURCES = 100_000
#: Equal rows are told apart in runs of this many.
RUN = 1 << 16


def targets(sources: DataFrame, weights=(1, 2, 3), ceiling: int = 3) -> DataFrame:
    """``sources`` (source, size), one row each, with target: the sum of sizes shared by weight, each at most ``ceiling`` times its size.

    Sources in code point order, null last, weigh ``weights`` in turn.  The
    excess of capped sources is shared again by weight among the others, until
    none is above its ceiling: each round is one sum over the table.
    """
    order = F.col("source").asc_nulls_last()
    placed = cut(sources.repartitionByRange(order).sortWithinPartitions(order).select("source", "size", F.monotonically_increasing_id().alias("__id")))
    part = F.shiftright("__id", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    rank = F.col("__offset") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = cut(placed.join(F.broadcast(offsets), part == F.col("__part")).select("source", "size", weight.cast("long").alias("__weight")))
    total = weighed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = known = None
    while True:
        capped = F.lit(False) if share is None else F.lit(share) * F.col("__weight") > F.lit(ceiling) * F.col("size")
        now = weighed.agg(
            F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("__weight"))), F.lit(0))
        ).first()
        if share is not None and now[0] == known:
            break
        known = now[0]
        share = max(0.0, float(total) - ceiling * float(now[1])) / now[2] if now[2] else float("inf")
    level = F.lit(share) * F.col("__weight")
    return weighed.select("source", "size", F.when(level > ceiling * F.col("size"), (ceiling * F.col("size")).cast("double")).otherwise(level).alias("target"))


def _with_source(rows: DataFrame, table: DataFrame, small: bool, *more) -> DataFrame:
    """``rows`` joined with a table of one row for each source ``__s``."""
    on = F.col("__source").eqNullSafe(F.col("__s"))
    for condition in more:
        on = on & condition
    return rows.join(F.broadcast(table) if small else table, on)


def _boundary(rows: DataFrame, shift: int) -> DataFrame:
    """For each source the hash bucket in which its budget ends."""
    bucket = F.shiftright("__hash", shift)
    sums = rows.groupBy("__source", "__budget", bucket.alias("__bucket")).agg(
        F.sum("__size").alias("__words"), F.min("__hash").alias("__low"), F.max("__hash").alias("__high")
    )
    by = Window.partitionBy("__source").orderBy("__bucket")
    running = sums.withColumn("__upto", F.sum("__words").over(by))
    last = running.withColumn("__rank", F.row_number().over(Window.partitionBy("__source").orderBy(
        (F.col("__upto") < F.col("__budget")).asc(), F.when(F.col("__upto") >= F.col("__budget"), F.col("__bucket")).asc_nulls_last(), F.col("__bucket").desc()
    )))
    return last.filter("__rank = 1").select(
        F.col("__source").alias("__s"), "__bucket", "__words", "__low", "__high", (F.col("__budget") - F.col("__upto") + F.col("__words")).alias("__rest")
    )


def mix(
    docs: DataFrame,
    size_column: str,
    source_column: str,
    id_columns: list[str],
    weights=(1, 2, 3),
    ceiling: int = 3,
    hash_columns: list[str] | None = None,
) -> DataFrame:
    """Decide how much of every row the mixture takes.

    Targets are as in :func:`targets`.  A document is taken ``copies`` times:
    the whole part of target / size, plus once more below the source's
    threshold, which lies where the sum comes nearest to the target.  Rows of
    equal hash (equal in all of ``hash_columns``, else ``id_columns``) are
    taken together.  Null sizes count as 0 and take nothing, nor do sources of
    size 0.  Returns ``id_columns`` plus size, source, source_size, target,
    copies and taken; an empty table gives an empty result, and further
    columns are ignored.
    """
    keyed = cut(
        docs.select(
            *[F.col(c).alias(f"__id{i}") for i, c in enumerate(id_columns)],
            F.col(source_column).alias("__source"),
            F.coalesce(F.col(size_column).cast("long"), F.lit(0)).alias("__size"),
            F.shiftrightunsigned(F.xxhash64(*(hash_columns or id_columns)), 1).alias("__hash"),
        )
    )
    shared = targets(keyed.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("size")), weights, ceiling)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    plan = cut(shared.select(F.col("source").alias("__s"), F.col("size").alias("source_size"), "target", whole.alias("__whole")))
    small = plan.count() <= BROADCAST_SOURCES
    # Source, lowest and highest hash of the bucket still to be split, budget left in it.
    open_ = plan.select("__s", F.lit(0).cast("long").alias("__from"), F.lit((1 << HASH_BITS) - 1).alias("__to"), (F.col("target") - F.col("__whole") * F.col("source_size")).alias("__budget"))
    open_ = open_.filter("__budget > 0")
    cuts, shift = [], HASH_BITS
    while shift and not open_.isEmpty():
        shift = max(0, shift - LEVEL_BITS)
        level = cut(_boundary(_with_source(keyed, open_, small, F.col("__hash").between(F.col("__from"), F.col("__to"))), shift))
        found = F.when(2 * F.col("__rest") >= F.col("__words"), F.col("__high") + 1).otherwise(F.col("__low"))
        cuts.append(level.filter("__low = __high").select("__s", found.alias("__cut")))
        first = F.shiftleft("__bucket", shift)
        open_ = level.filter("__low < __high").select("__s", first.alias("__from"), (first + F.lit((1 << shift) - 1)).alias("__to"), F.col("__rest").alias("__budget"))
    if cuts:
        at = reduce(DataFrame.unionByName, cuts)
        plan = plan.alias("p").join(at.alias("c"), F.col("p.__s").eqNullSafe(F.col("c.__s")), "left").select("p.*", F.coalesce("__cut", F.lit(0)).alias("__cut"))
    else:
        plan = plan.withColumn("__cut", F.lit(0))
    copies = F.col("__whole") + (F.col("__hash") < F.col("__cut")).cast("long")
    return _with_source(keyed, cut(plan), small).select(
        *[F.col(f"__id{i}").alias(c) for i, c in enumerate(id_columns)],
        F.col("__size").alias("size"),
        F.col("__source").alias("source"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("__size")).alias("taken"),
    )


def word_count(column: str):
    """Number of runs of non-white characters; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixture of ``documents``: one row for each row.

    Null and empty texts have size 0 and take nothing; a null source is a
    source; a very long text weighs as its words.  Rows equal in doc_id, text
    and source are numbered and each decided on its own, so a much repeated
    row does not move as one lump.  Further columns are ignored.
    """
    same = ["doc_id", "text_hash", "source", "size"]
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count("text").alias("size"))
    times = sized.groupBy(*same).agg(F.count(F.lit(1)).alias("times"))
    runs = times.withColumn("run", F.explode(F.expr(f"sequence(0L, (times - 1) div {RUN})")))
    each = runs.select(*same, F.explode(F.expr(f"sequence(run * {RUN}, least(times, (run + 1) * {RUN}) - 1)")).alias("copy"))
    return mix(each, "size", "source", ["doc_id", "text_hash", "copy"])
