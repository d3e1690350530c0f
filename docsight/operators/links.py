"""Joins between names, statements, edges, chunks and documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..functions import forms as fm
from ..functions import text as tx
from .retrieve import budget_skip


def role_chunks(statements: DataFrame, chunks: DataFrame, cap: int, extra: int = 0) -> DataFrame:
    """(role, chunk_id, place, state): the evidence of each role's statements in the order first seen.

    ``statements``: role, claim_idx, evidence (array of chunk ids);
    ``chunks``: chunk_id, tokens.  A chunk that does not exist is ``missing``;
    one that would pass the cap, at tokens + ``extra`` each, is skipped as
    ``over_budget`` and later ones may still fit; the rest is ``taken``.
    """
    seen = statements.select("role", "claim_idx", F.posexplode("evidence").alias("pos", "chunk_id")).groupBy("role", "chunk_id").agg(F.min(F.struct("claim_idx", "pos")).alias("place"))
    sized = seen.join(chunks.select("chunk_id", F.greatest(F.col("tokens") + extra, F.lit(1)).cast("long").alias("size")), "chunk_id", "left")
    known = sized.filter("size is not null")
    picked = budget_skip(known.select("role", F.struct("place", "chunk_id").alias("at"), "size"), "role", "at", "size", cap).select("role", F.explode("ids").alias("at"))
    taken = picked.select("role", F.col("at.chunk_id").alias("chunk_id"), F.lit(True).alias("in"))
    state = F.when(F.col("size").isNull(), "missing").when(F.col("in"), "taken").otherwise("over_budget")
    return sized.join(taken, ["role", "chunk_id"], "left").select("role", "chunk_id", "place", state.alias("state"))


def remap(rows: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """Adds <column>_id for each column of names: the entity of the exact name, else of its form; null if neither is known.

    ``names``: name, id.  A name or form of several entities means the smallest id.
    """
    exact = names.groupBy(F.col("name").alias("__n")).agg(F.min("id").alias("__exact"))
    forms = names.groupBy(fm.form_key(F.col("name")).alias("__f")).agg(F.min("id").alias("__form"))
    for c in columns:
        keyed = rows.withColumns({"__n": F.col(c), "__f": fm.form_key(F.col(c))})
        rows = keyed.join(exact, "__n", "left").join(forms, "__f", "left").select(*rows.columns, F.coalesce("__exact", "__form").alias(f"{c}_id"))
    return rows


def remap_roles(rows: DataFrame, roles: str, names: dict) -> DataFrame:
    """A map of arrays of names with every known name replaced by its entity; exact names only.  ``names`` is a small table."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.expr("cast(map() as map<string,string>)")
    return rows.withColumn(roles, F.transform_values(roles, lambda _, v: F.transform(v, lambda n: F.coalesce(F.try_element_at(table, n), n))))


def skeleton(statements: DataFrame) -> DataFrame:
    """(src, predicate, dst): a document asserts its statements; a statement is about its subject and object."""
    s = statements.withColumn("d", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).withColumn("s", F.col("id").cast("string"))
    about = F.array(F.struct(F.col("d").alias("src"), F.lit("asserts").alias("predicate"), F.col("s").alias("dst")), *[F.struct(F.col("s").alias("src"), F.lit(c).alias("predicate"), F.col(c).cast("string").alias("dst")) for c in ("subject", "object")])
    return s.select(F.inline(about)).filter("dst is not null")


def statements_of(statements: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, id): statements with a concept of ``concepts`` as subject or object, once each."""
    ends = statements.select("id", F.explode(F.array_distinct(F.array("subject", "object"))).alias("concept"))
    return ends.join(concepts.select("concept").distinct(), "concept", "left_semi").select("concept", "id")


def importance(edges: DataFrame) -> DataFrame:
    """(node, degree, relations, sections) over edges (src, predicate, dst, section), both ends counted."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "predicate", "section").filter("node is not null")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("predicate").alias("relations"), F.count_distinct("section").alias("sections"))


def frequent_pairs(edges: DataFrame, weights: DataFrame, least: int) -> DataFrame:
    """(a, b, n): undirected edges between nodes that both weigh ``least`` or more; weights: node, n."""
    heavy = weights.filter(F.col("n") >= least).select("node")
    pairs = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(heavy.withColumnRenamed("node", "a"), "a", "left_semi").join(heavy.withColumnRenamed("node", "b"), "b", "left_semi")


def loose_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, problem): ends of edges that are no nodes (dangling), nodes without edges (isolated)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).filter("node is not null").distinct()
    known = nodes.select("node").distinct()
    return ends.join(known, "node", "left_anti").withColumn("problem", F.lit("dangling")).unionByName(known.join(ends, "node", "left_anti").withColumn("problem", F.lit("isolated")))


def residual_candidates(names: DataFrame) -> DataFrame:
    """(kind, a, b): names that may still be one entity.

    same_key: alike but for punctuation and case, each with the group's first
    name; bracketed: a name with brackets (b null); acronym: two to six
    capitals or digits and a name with those initials.
    """
    n = names.select(F.col("name").alias("a")).filter("a is not null").distinct()
    key = F.regexp_replace(F.lower("a"), "[^a-z0-9]+", "")
    heads = n.withColumn("k", key).filter("k <> ''")
    first = heads.groupBy("k").agg(F.min("a").alias("b"))
    same = heads.join(first, "k").filter("a <> b").select(F.lit("same_key").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"))
    bracketed = n.filter(F.col("a").rlike("[()]")).select(F.lit("bracketed").alias("kind"), "a", F.lit(None).cast("string").alias("b"))
    short = n.withColumn("k", F.regexp_replace("a", "[^A-Za-z0-9]", "")).filter("k rlike '^[A-Z0-9]{2,6}$' and k rlike '[A-Z]'").select("a", F.lower("k").alias("k"))
    starts = F.array_join(F.transform(F.regexp_extract_all("a", F.lit("([A-Za-z0-9]+)"), 1), lambda w: F.lower(F.left(w, F.lit(1)))), "")
    long = n.select(F.col("a").alias("b"), starts.alias("k"))
    return same.unionByName(bracketed).unionByName(short.join(long, "k").filter("upper(a) <> upper(b)").select(F.lit("acronym").alias("kind"), "a", "b"))


def adjacent_overlap(chunks: DataFrame, group: str, order: str, text: str, least: int = 12, most: int = 400) -> DataFrame:
    """(group, order, overlap): the longest end of the chunk before, of least..most characters, that this chunk begins with; 0 if none.

    The first chunk of a group has no row.
    """
    before = F.lag(F.right(text, F.lit(most))).over(Window.partitionBy(group).orderBy(order))
    pairs = chunks.select(F.struct(group, order).alias("at"), F.left(text, F.lit(most)).alias("b"), before.alias("a")).filter("a is not null")

    def longest(a: str, b: str | None) -> int:
        """An overlap begins where the chunk's first characters stand, so only those places are tried, the longest first."""
        head = (b or "")[:least]
        at = a.find(head, max(0, len(a) - len(b or ""))) if len(head) == least else -1
        while at >= 0:
            if len(a) - at >= least and b.startswith(a[at:]):
                return len(a) - at
            at = a.find(head, at + 1)
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [longest(a, b) for b, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["at", "overlap"])

    return pairs.mapInArrow(run, f"at {pairs.schema['at'].dataType.simpleString()}, overlap int").select("at.*", "overlap")


def term_overlap(terms: DataFrame, least: int) -> DataFrame:
    """(a, b, shared): groups (grp, term) that share terms standing ``least`` times or more in each.

    Terms of the same set of groups are counted first, so a pair is made once for each set.
    """
    often = terms.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    sets = often.groupBy("term").agg(F.array_sort(F.collect_set("grp")).alias("s")).filter(F.size("s") > 1).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    a = sets.select("s", "n", F.posexplode("s").alias("i", "a"))
    return a.select("a", "n", F.explode(F.slice("s", F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))).alias("b")).groupBy("a", "b").agg(F.sum("n").alias("shared"))


def list_changes(stored: DataFrame, expected: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, problem): places where two keyed lists differ: missing, extra or changed."""
    a = stored.select(*keys, F.struct(*values).alias("x"), F.lit(True).alias("p"))
    b = expected.select(*keys, F.struct(*values).alias("y"), F.lit(True).alias("q"))
    problem = F.when(F.col("p").isNull(), "missing").when(F.col("q").isNull(), "extra").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return a.join(b, keys, "full").select(*keys, problem.alias("problem")).filter("problem is not null")


def fan_out(links: DataFrame, left: str, right: str) -> DataFrame:
    """(side, links, n): how many of each side have how many distinct partners."""
    once = links.select(left, right).distinct()
    side = lambda k: once.groupBy(k).agg(F.count(F.lit(1)).alias("links")).groupBy("links").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("side"), "links", "n")
    return side(left).unionByName(side(right))


#: Characters that blocks are compared without, besides white space.
_PLAIN = re.compile(r"""[\s\[\]（）()`*#>|·、，。：；！？"'\-]""")
_TILE = 512


def _block_pairs(text: str | None, least: float) -> Iterator[tuple[int, int, float]]:
    """Places (a, b) and score of one text's similar blocks; sets are compared in tiles, by matrix products."""
    first: dict[str, int] = {}
    fenced = False
    for pos, line in enumerate((text or "").split("\n")):
        line = line.strip(" ")
        if line.startswith("```"):
            fenced = not fenced
        elif line and not fenced and not line.startswith("#"):
            first.setdefault(line, pos)
    known: dict[str, int] = {}
    places, sets = [], []
    for line, pos in first.items():
        t = _PLAIN.sub("", line)
        if len(t) > 1:
            places.append(pos)
            sets.append(np.array(sorted({known.setdefault(t[i : i + 2], len(known)) for i in range(len(t) - 1)})))

    def tile(at: int) -> np.ndarray:
        out = np.zeros((min(_TILE, len(sets) - at), len(known)), np.float32)
        for i, s in enumerate(sets[at : at + _TILE]):
            out[i, s] = 1
        return out

    sizes = np.array([len(s) for s in sets], np.float64)
    for i in range(0, len(sets), _TILE):
        left = tile(i)
        for j in range(i, len(sets), _TILE):
            both = (left @ (left if i == j else tile(j)).T).astype(np.float64)
            score = both / (sizes[i : i + len(left), None] + sizes[None, j : j + both.shape[1]] - both)
            for x, y in zip(*np.nonzero(score >= least), strict=True):
                if i + x < j + y:
                    yield places[i + x], places[j + y], float(score[x, y])


def similar_blocks(docs: DataFrame, key: str, text: str, least: float = 0.55) -> DataFrame:
    """(key, a, b, score): blocks of one text whose sets of letter pairs have Jaccard ``least`` or more.

    Blocks are the lines outside code fences that are no headings; equal
    blocks stand for one, at their first place.  White space and punctuation
    are left out.  Pairs lie within one text, so nothing is shuffled: texts
    are compared where they are read, in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, found = batch.column(0).slice(i, 1), _block_pairs(batch.column(1)[i].as_py(), least)
                while part := list(islice(found, 65536)):
                    a, b, score = zip(*part, strict=True)
                    keys = pa.DictionaryArray.from_arrays(np.zeros(len(part), np.int32), one).cast(one.type)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], names=[key, "a", "b", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, a long, b long, score double").withColumn("score", F.round("score", 4))


def repeated_headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, heading, n): Markdown headings that stand more than once in a text."""
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("x")).withColumn("x", F.trim("x")).filter(F.col("x").startswith("#"))
    return lines.groupBy(key, F.trim(F.regexp_replace("x", "^#+", "")).alias("heading")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and heading <> ''")


def report_alignment(reports: DataFrame, members: DataFrame, pattern: str = r"\[(\d+)\]") -> DataFrame:
    """(community, cited, own): distinct ids that a report cites, and how many are its community's members.

    ``reports``: community, text; ``members``: community, member (string).
    """
    cited = reports.select("community", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("member"))
    own = members.select("community", "member").distinct().withColumn("own", F.lit(1))
    return cited.join(own, ["community", "member"], "left").groupBy("community").agg(F.count(F.lit(1)).alias("cited"), F.count("own").alias("own"))


def closed_loop(raw: DataFrame, kept: DataFrame, entities: DataFrame, edges: DataFrame, statements: DataFrame, vocabulary: list[str], anchored: float = 0.95) -> DataFrame:
    """(source, check, ok, bad): whether a source's compiled artefacts fit together; ``bad`` counts what does not.

    ``raw``: source, claim_idx.  ``kept``: source, claim_idx, status,
    relation, predicate, clean, anchor.  ``entities``: source, name.
    ``edges``: source, src, dst.  ``statements``: source, claim_idx,
    chunks, type, type_evidence, quotes.  Sources are those of ``raw``.
    """
    tokens = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    out = []

    def check(name: str, rows: DataFrame, bad, ok=None) -> None:
        out.append(rows.groupBy("source").agg(bad.alias("bad"), (ok if ok is not None else bad == 0).alias("ok")).select("source", F.lit(name).alias("check"), "ok", "bad"))

    status = F.coalesce("status", F.lit(""))
    check("status_complete", kept, F.count_if(~status.isin("mapped", "forced", "pending")))
    check("relation_known", kept, F.count_if(status.isin("mapped", "forced") & ~F.coalesce(F.col("relation").isin(vocabulary), F.lit(False))))
    check("clean_only_deletes", kept, F.count_if(F.col("clean").isNotNull() & ~F.coalesce(tx.is_subsequence(tokens(F.col("clean")), tokens(F.col("predicate"))), F.lit(False))))
    loose = F.coalesce(F.trim("anchor"), F.lit("")) == ""
    check("anchored", kept, F.count_if(loose), F.avg((~loose).cast("int")) >= anchored)
    known = raw.select("source", "claim_idx").distinct().withColumn("known", F.lit(True))
    traced = kept.select("source", "claim_idx").join(known, ["source", "claim_idx"], "left")
    check("traceable", traced, F.count_if(F.col("known").isNull()))
    ends = edges.select("source", F.explode(F.array("src", "dst")).alias("name")).filter("name is not null").distinct().withColumn("used", F.lit(True))
    named = entities.select("source", "name").distinct().withColumn("named", F.lit(True))
    check("ends_are_entities", ends.join(named, ["source", "name"], "full"), F.count_if(F.col("used").isNull() | F.col("named").isNull()))
    check("no_self_loops", edges, F.count_if(F.col("src") == F.col("dst")))
    pairs = kept.select("source", "claim_idx").withColumn("k", F.lit(1)).join(statements.groupBy("source", "claim_idx").agg(F.count(F.lit(1)).alias("n")), ["source", "claim_idx"], "full")
    check("one_statement_each", pairs, F.count_if(F.col("k").isNull() | F.coalesce(F.col("n") != 1, F.lit(True))))
    check("statements_anchored", statements, F.count_if(F.coalesce(F.size("chunks"), F.lit(0)) <= 0))
    check("types_grounded", statements, F.count_if(F.col("type").isNotNull() & ~tx.contained(F.trim("type_evidence"), F.coalesce("quotes", F.array().cast("array<string>")))))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.join(raw.select("source").distinct(), "source", "left_semi")


def ungrounded_names(names: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, name): names (key, name) that do not appear in their own document (key, text)."""
    both = names.select(key, "name").distinct().join(docs.select(key, "text"), key, "left")
    return both.filter(~naming.appears(F.col("name"), F.coalesce("text", F.lit("")))).select(key, "name")
