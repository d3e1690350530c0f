"""Names, claims and their evidence: merging audits, candidate order, cards, anchors, mapping states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms as fm


def missed_plurals(names: DataFrame) -> DataFrame:
    """(a, b): names (name, owner) that may be one another's plural but have different owners; each pair once, a < b."""
    known = names.groupBy("name").agg(F.min("owner").alias("owner")).withColumn("form", fm.alnum(F.col("name"))).filter("form != ''")
    asks = known.select(F.col("name").alias("n"), F.col("owner").alias("o"), F.explode(fm.other_numbers(F.col("name"))).alias("form"))
    met = asks.join(known, "form").filter("owner <> o")
    return met.select(F.least("n", "name").alias("a"), F.greatest("n", "name").alias("b")).distinct()


def merge_confidence(places: DataFrame) -> DataFrame:
    """(key, named, shared, confidence) of the places (key, name, chunk) where the names of a form occur.

    high: some chunk holds all names that occur anywhere; low: none does;
    unknown: fewer than two names occur.  A null chunk is no place.
    """
    found = places.filter("chunk is not null").select("key", "name", "chunk").distinct()
    named = found.groupBy("key").agg(F.count_distinct("name").alias("named"))
    most = found.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    shared = most.join(named, "key").filter("n = named").groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
    keys = places.select("key").distinct()
    both = keys.join(named, "key", "left").join(shared, "key", "left").select("key", F.coalesce("named", F.lit(0)).alias("named"), F.coalesce("shared", F.lit(0)).alias("shared"))
    kind = F.when(F.col("named") < 2, "unknown").when(F.col("shared") > 0, "high").otherwise("low")
    return both.select("key", "named", F.when(F.col("named") < 2, 0).otherwise(F.col("shared")).alias("shared"), kind.alias("confidence"))


def candidate_kinds(signals: DataFrame, merging: tuple[str, ...] = ("bracket", "acronym", "rewrite"), part: str = "subset") -> DataFrame:
    """(a, b, signals, n, kind) of signals (a, b, signal): merge, subsumption or association.

    In order of falling n, then a and b, within a kind; sort by these.
    """
    met = signals.groupBy("a", "b").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    kind = F.when(F.arrays_overlap("signals", F.array(*map(F.lit, merging))), "merge").when(F.array_contains("signals", part), "subsumption").otherwise("association")
    return met.select("a", "b", "signals", F.size("signals").alias("n"), kind.alias("kind"))


def neighbour_cards(names: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(id, name, card): a name (id, name, aliases) with its aliases and its ``most`` heaviest neighbours by edges (src, dst), each in order.

    Edges count in both directions, loops not; a hub's neighbours are ranked
    after they were counted, so no edge list is gathered.
    """
    linked = edges.filter("src <> dst")
    both = linked.select("src", "dst").unionByName(linked.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    weighed = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    titled = weighed.join(names.select(F.col("id").alias("dst"), F.col("name").alias("neighbour")), "dst")
    best = titled.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "neighbour"))).filter(F.col("r") <= most)
    near = best.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("neighbour")).alias("near"))
    other = F.array_sort(F.array_distinct(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: (a != "") & (a != F.col("name")))))
    listed = lambda label, x: F.when(F.size(x) > 0, F.concat(F.lit(f"{label}: "), F.array_join(x, ", ")))
    return names.join(near, "id", "left").select("id", "name", F.concat_ws(" | ", "name", listed("aliases", other), listed("neighbors", F.coalesce("near", F.array().cast("array<string>")))).alias("card"))


def anchor(quotes: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each claim: start, end, chunks, lost, anchor.

    ``quotes`` (claim, place, quote) are a claim's quotes, ``found`` (claim,
    place, doc_id, start, end) those that were located, ``chunks`` (doc_id,
    seq, start, end).  The anchor is the span of all that were found; without
    any it falls back to the section.
    """
    spans = found.groupBy("claim").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct("place").alias("hits"))
    c = chunks.select("doc_id", "seq", F.col("start").alias("cs"), F.col("end").alias("ce"))
    touched = found.join(c, "doc_id").filter("cs < end and ce > start").groupBy("claim").agg(F.count_distinct("doc_id", "seq").alias("chunks"))
    asked = quotes.groupBy("claim").agg(F.count(F.lit(1)).alias("asked"))
    return asked.join(spans, "claim", "left").join(touched, "claim", "left").select(
        "claim", "start", "end", F.coalesce("chunks", F.lit(0)).alias("chunks"), (F.col("asked") - F.coalesce("hits", F.lit(0))).alias("lost"), F.when(F.col("start").isNull(), "section").alias("anchor")
    )


def claim_blocks(claims: DataFrame, places: DataFrame) -> DataFrame:
    """(claim, block, block_start): each claim (claim, status) that is not pending under its first place's chunk.

    ``places`` (claim, quote, chunk, chunk_start): the first quote with a
    chunk decides, and of its chunks the first.  Claims without one stand
    under '_orphan', last.  Order by block_start (null last) and claim.
    """
    first = places.groupBy("claim").agg(F.min_by(F.struct("chunk", "chunk_start"), F.struct("quote", "chunk_start", "chunk")).alias("p"))
    kept = claims.filter(F.coalesce(F.col("status") != "pending", F.lit(True)))
    return kept.join(first, "claim", "left").select("claim", F.coalesce("p.chunk", F.lit("_orphan")).alias("block"), F.col("p.chunk_start").alias("block_start"))


def predicate_status(claims: DataFrame, replies: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``claims`` (predicate, ...) with relation and status: mapped to a reply's relation, forced to its nearest, or pending.

    ``replies`` (predicate, relation, nearest); names outside the vocabulary count as none.
    """
    known = lambda c: F.when(F.col(c).isin(*vocabulary), F.col(c))
    told = replies.groupBy("predicate").agg(F.max(known("relation")).alias("__r"), F.max(known("nearest")).alias("__n"))
    status = F.when(F.col("__r").isNotNull(), "mapped").when(F.col("__n").isNotNull(), "forced").otherwise("pending")
    return claims.join(told, "predicate", "left").withColumns({"relation": F.coalesce("__r", "__n"), "status": status}).drop("__r", "__n")


def mapping_coverage(edges: DataFrame, mapping: DataFrame, special: tuple[str, ...] = ("unmapped", "split_needed")) -> DataFrame:
    """(state, kinds, edges, share): predicates of the edges (predicate) by what the mapping (predicate, relation) says, weighted by edges."""
    counts = edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    told = mapping.groupBy("predicate").agg(F.max("relation").alias("relation"))
    state = F.when(F.col("relation").isNull(), "missing").when(F.col("relation").isin(*special), F.col("relation")).otherwise("mapped")
    by = counts.join(told, "predicate", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("edges"))
    return by.select("state", "kinds", "edges", F.round(F.col("edges") / F.sum("edges").over(Window.partitionBy()), 6).alias("share"))


def off_vocabulary(claims: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(word, forced, pending, sources): predicates (predicate, status, source) outside the vocabulary, counted by state."""
    odd = claims.filter(~F.coalesce(F.col("predicate").isin(*vocabulary), F.lit(False)))
    counted = lambda s: F.count_if(F.col("status") == s).alias(s)
    return odd.groupBy(F.col("predicate").alias("word")).agg(counted("forced"), counted("pending"), F.count_distinct("source").alias("sources"))


def stored_problems(statements: DataFrame, edges: DataFrame, told: dict[str, int], vocabulary: list[str]) -> DataFrame:
    """(check, found, ok) of a stored artefact: counts against those told, unique ids, anchors, relations."""
    s = statements.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(~F.coalesce(F.size("chunks") > 0, F.lit(False))).alias("loose"))
    e = edges.agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.coalesce(F.col("predicate").isin(*vocabulary), F.lit(False))).alias("off"))
    row = lambda name, found, ok: F.struct(F.lit(name).alias("check"), found.cast("long").alias("found"), ok.alias("ok"))
    n, m = F.col("n"), F.col("m")
    checks = F.array(
        row("statements", n, n == told["statements"]),
        row("edges", m, m == told["edges"]),
        row("repeated_ids", n - F.col("ids"), n == F.col("ids")),
        row("unanchored", F.col("loose"), F.col("loose") == 0),
        row("unknown_relations", F.col("off"), F.col("off") == 0),
    )
    return s.crossJoin(e).select(F.explode(checks).alias("c")).select("c.*")  # one row and one row


def alias_reach(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(group, wanted, reached): how many of a group's wanted (group, name) names an entity (name, aliases) has as name or alias."""
    all_ = names.select(F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name")).filter("name is not null").distinct()
    asked = wanted.select("group", "name").distinct()
    return asked.join(all_.withColumn("__hit", F.lit(1)), "name", "left").groupBy("group").agg(F.count(F.lit(1)).alias("wanted"), F.count("__hit").alias("reached"))


def in_order(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, items): a group's values as JSON, in the order of their key; for small groups such as a document's chunks."""
    return rows.groupBy(group).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))), lambda x: x["v"])).alias("items"))


def chunk_position(seq: Column, chunk_id: Column) -> Column:
    """A chunk's number; without one, the digits that its id ends in; 0 without any."""
    return F.coalesce(seq.cast("long"), F.nullif(F.regexp_extract(chunk_id, r"([0-9]{1,18})$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))


def bundle_union(bundles: list[DataFrame]) -> DataFrame:
    """Several runs' rows, columns by name; what a run lacks is null."""
    out = bundles[0]
    for more in bundles[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def source_tokens(texts: DataFrame, sources: DataFrame, pattern: str = r"\b([A-Z]{1,3}[0-9]+)\b") -> DataFrame:
    """(id, source_id): codes that stand in a text (id, text) and name a known source (source_id)."""
    found = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("source_id"))
    return found.join(sources.select("source_id").distinct(), "source_id", "left_semi").select("id", "source_id")


def stored_text(label: Column, path: Column, body: Column) -> Column:
    """A chunk as it is stored: its source, the leaf of its heading path if it has one, and the text."""
    return F.concat_ws("\n\n", F.concat(F.lit("来源："), label), fm.leaf_title(path), body)


def chunk_cap(chunks: DataFrame, group: str, label: str, path: str, most: int = 450, least: int = 320, spare: int = 10) -> DataFrame:
    """(group, cap): the length that a group's chunks may have, so that the source and its longest leaf title still fit."""
    leaf = F.coalesce(F.length(fm.leaf_title(F.col(path))), F.lit(0))
    head = F.length(F.concat(F.lit("来源："), F.col(label)))
    return chunks.groupBy(group).agg(F.max(head).alias("h"), F.max(leaf).alias("l")).select(group, F.greatest(F.lit(least), F.lit(most) - F.col("h") - F.col("l") - F.lit(spare)).alias("cap"))
