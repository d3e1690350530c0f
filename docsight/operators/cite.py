"""Citations of claims, their windows of context, and tool calls put together from fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def citation_groups(claims: DataFrame, hits: DataFrame, key: str = "claim_id") -> DataFrame:
    """(key, state, blocks, missing): what the refs of each claim lead to.

    ``claims``: key, refs; ``hits``: position (from 1), source, block.  A ref
    ``[n]`` leads to the block at n, any other to all blocks of the source it
    names.  state: fail if some ref leads nowhere, uncertain without refs,
    else ok.  Repeated refs count once; keys are unique.
    """
    refs = claims.select(key, F.explode(F.array_distinct(F.transform("refs", lambda r: F.trim(r)))).alias("ref"))
    # One lookup table for both kinds of ref, so that one join serves both.
    ways = hits.select(F.concat(F.lit("["), F.col("position").cast("string"), F.lit("]")).alias("ref"), "position", "block").unionByName(
        hits.select(F.col("source").alias("ref"), "position", "block")
    )
    found = refs.join(ways, "ref", "left").groupBy(key).agg(
        F.array_sort(F.collect_set(F.struct("position", "block"))).alias("at"),
        F.array_sort(F.collect_set(F.when(F.col("position").isNull(), F.col("ref")))).alias("missing"),
    )
    blocks = F.transform(F.filter("at", lambda x: x["position"].isNotNull()), lambda x: x["block"])
    state = F.when(F.col("at").isNull(), "uncertain").when(F.size("missing") > 0, "fail").otherwise("ok")
    return claims.select(key).join(found, key, "left").select(key, state.alias("state"), F.coalesce(blocks, F.array().cast("array<string>")).alias("blocks"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def _sentence_start(text: Column, at: Column) -> Column:
    """The end of the last full stop and white space before a 0-based place; 0 without one."""
    return F.length(F.regexp_extract(F.substring(text, F.lit(1), at), r"(?s)^(.*[.!?]\s)", 1))


def context_window(text: Column, start: Column, end: Column, back: int = 1600, most: int = 1800) -> Column:
    """The text around [start, end): from a sentence's start some ``back`` characters before to the sentence's end.

    Windows over ``most`` are shortened in front, by sentences.
    """
    quoted = F.substring(text, F.lit(1), end).rlike(r"""[.!?]["')}\]”’]*\z""")
    tail = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"(?s)^([^.!?]*[.!?])", 1))
    high = F.when(quoted, end).when(tail > 0, end + tail).otherwise(F.length(text))
    low = _sentence_start(text, F.greatest(start - back, F.lit(0)))
    low = F.when(high - low > most, _sentence_start(text, F.greatest(high - most, F.lit(0)))).otherwise(low)
    return F.trim(F.substring(text, low + 1, high - low))


def unresolved_reason(kind: Column, phrase: Column, window: Column, anchor: Column) -> Column:
    """summary: the phrase's last word never stands before the anchor in the window; recheck: all else."""
    head = F.regexp_replace(F.lower(F.element_at(F.split(F.trim(phrase), r"\s+"), -1)), r"[^a-z\-]", "")
    after = F.call_function("substring_index", window, anchor, F.lit(-1))
    cut = F.substring(window, F.lit(1), F.length(window) - F.length(after) - F.length(anchor))
    before = F.when((anchor != "") & F.contains(window, anchor), cut).otherwise(window)
    return F.when((kind == "phrase") & (head != "") & ~F.contains(F.lower(before), head), "summary").otherwise("recheck")


def tool_calls(frames: DataFrame, stream: str, order: str) -> DataFrame:
    """(stream, index, id, type, name, arguments, valid): calls put together from fragments.

    ``frames``: stream, order, index, id, type, name, arguments.  The last id
    and type that are not empty hold (type: function without one); names and
    arguments are concatenated in order, which must not repeat.  ``valid``:
    the arguments are JSON; none count as valid.
    """
    parts = frames.groupBy(stream, "index").agg(F.array_sort(F.collect_list(F.struct(order, "id", "type", "name", "arguments"))).alias("f"))

    def whole(field: str) -> Column:
        return F.array_join(F.transform("f", lambda x: F.coalesce(x[field], F.lit(""))), "")

    def last(field: str, default: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter(F.transform("f", lambda x: x[field]), lambda v: v.isNotNull() & (v != "")), F.lit(-1)), F.lit(default))

    calls = parts.select(stream, "index", last("id", "").alias("id"), last("type", "function").alias("type"), whole("name").alias("name"), whole("arguments").alias("arguments"))
    # The parser stops after the first value, so the text must be one item of an array and of an object: then nothing follows it.
    whole_value = [F.try_parse_json(F.concat(F.lit(a), F.col("arguments"), F.lit(b))).isNotNull() for a, b in ("[]", ('{"a":', "}"))]
    return calls.withColumn("valid", (F.col("arguments") == "") | (whole_value[0] & whole_value[1]))


def anchor_sentences(claims: DataFrame, sentences: DataFrame) -> DataFrame:
    """(claim, anchor, before, after): the sentence in which a claim (claim, doc_id, at) is anchored, and its neighbours.

    ``sentences`` (doc_id, n, start, end, text); a place in none has no row.
    A text's first sentence has nothing before it, its last nothing after.
    """
    by = Window.partitionBy("doc_id").orderBy("n")
    near = sentences.select("doc_id", "start", "end", "text", F.lag("text").over(by).alias("before"), F.lead("text").over(by).alias("after"))
    return claims.join(near, "doc_id").filter("at >= start and at < end").select("claim", F.col("text").alias("anchor"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


def sentence_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n, start, end, text): the sentences of texts (doc_id, text) that end in . ! or ? and white space; places are those in the text."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?]\s)")).alias("n", "raw"))
    end = F.sum(F.length("raw")).over(Window.partitionBy("doc_id").orderBy("n"))
    return parts.withColumn("end", end).select("doc_id", "n", (F.col("end") - F.length("raw")).alias("start"), "end", F.trim("raw").alias("text"))


def sentence_bounds(docs: DataFrame) -> DataFrame:
    """(doc_id, n, start, end, text): the sentences of texts (doc_id, text), places without the white space around them.

    A sentence ends at . ! ? … or a line end; stops of abbreviations and those
    behind digits end none.  Marks in a row are one end.  Null texts and texts
    of white space have no sentence; repeated rows each have theirs.  Texts
    are cut once, in linear time.
    """
    parts = F.regexp_extract_all(tx.masked(F.col("text")), F.lit(tx.PIECE), 1)
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # rows are numbered before they are cut
    rows = numbered.select("doc_id", "row", F.posexplode(parts).alias("i", "raw"))
    upto = F.sum(F.length("raw")).over(Window.partitionBy("row").orderBy("i"))
    white = r"[ \t\n\r\f]*"
    plain = F.regexp_replace("raw", f"^{white}|{white}$", "")
    led = F.length("raw") - F.length(F.regexp_replace("raw", f"^{white}", ""))
    spans = rows.withColumn("start", upto - F.length("raw") + led).withColumn("text", F.translate(plain, tx.MASKED, ".")).filter("text != ''")
    number = F.row_number().over(Window.partitionBy("row").orderBy("i")) - 1
    return spans.select("doc_id", number.alias("n"), F.col("start").cast("int").alias("start"), (F.col("start") + F.length("text")).cast("int").alias("end"), "text")
