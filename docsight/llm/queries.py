"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, chat, divergence, hnsw, langid, lm_score, mixing, quality, sentencepiece_scan, sharding, simhash, url_filter
from .common import cut, table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """A public tokenizer's file; a parameter of the operator, never part of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])


def _list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts that occur: a stand-in for published lists, made by rule from the host names.

    Every host is added to 'ads' on some day, removed later, and for every
    third host added again; its parent domain is on 'malware' for a while;
    its /en pages are on 'paths' from some day on.
    """
    hosts = pages.select(url_filter.host(F.col("url")).alias("h")).filter("h is not null").distinct()
    number = F.conv(F.substring(F.md5(F.col("h").cast("binary")), 1, 6), 16, 10).cast("long")
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    parent = F.regexp_replace("h", r"^[^.]*\.", "")
    x = F.col("x")
    entry = lambda name, key, n, action: F.struct(
        F.lit(name).alias("list_id"), key.alias("key"), day(n).alias("day"), F.lit(action).alias("action")
    )
    return (
        hosts.withColumn("x", number)
        .select(
            F.explode(
                F.array_compact(
                    F.array(
                        entry("ads", F.concat(F.lit("d:"), "h"), x % 500, "add"),
                        entry("ads", F.concat(F.lit("d:"), "h"), x % 500 + 50 + x % 300, "remove"),
                        F.when(x % 3 == 0, entry("ads", F.concat(F.lit("d:"), "h"), x % 500 + 400 + x % 300, "add")),
                        entry("malware", F.concat(F.lit("d:"), parent), x % 900, "add"),
                        entry("malware", F.concat(F.lit("d:"), parent), x % 900 + 20, "remove"),
                        entry("paths", F.concat(F.lit("p:"), "h", F.lit("/en")), x % 1400, "add"),
                    )
                )
            ).alias("e")
        )
        .select("e.*")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture; the fetch day is a fixed function of page_id, as the table has none."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("page_id", F.lit(1461)).cast("int")).alias("day")
    )
    found = url_filter.evaluate(pages, _list_entries(pages)).alias("f")
    out = pages.alias("p").join(found, F.col("p.url").eqNullSafe(F.col("f.url")) & F.col("p.day").eqNullSafe(F.col("f.day")))
    return out.select(
        "page_id",
        F.col("p.url").alias("url"),
        F.col("p.day").cast("string").alias("fetch_day"),
        F.array_join("lists", ",").alias("lists"),
        F.array_join("matched", ",").alias("matched"),
        "blocked",
    )


OP4_SQL = r"""
with captures as (
  select page_id, url, date '2020-01-01' + cast(((page_id % 1461) + 1461) % 1461 as integer) as day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)) as h,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)', 2) as p
  from pages),
hosts as (
  select h, cast(concat('0x', substr(md5(h), 1, 6)) as bigint) as x, regexp_replace(h, '^[^.]*\.', '') as parent
  from (select distinct h from captures where h <> '')),
entries as (
  select 'ads' list_id, 'd:' || h as key, x % 500 as d, 'add' as action from hosts
  union all select 'ads', 'd:' || h, x % 500 + 50 + x % 300, 'remove' from hosts
  union all select 'ads', 'd:' || h, x % 500 + 400 + x % 300, 'add' from hosts where x % 3 = 0
  union all select 'malware', 'd:' || parent, x % 900, 'add' from hosts
  union all select 'malware', 'd:' || parent, x % 900 + 20, 'remove' from hosts
  union all select 'paths', 'p:' || h || '/en', x % 1400, 'add' from hosts),
daily as (
  select list_id, key, date '2020-01-01' + cast(d as integer) as since, max(action) as action from entries group by all),
spans as (
  select *, lead(since) over (partition by list_id, key order by since) as until from daily),
hits as (
  select distinct c.page_id, s.list_id, s.key from captures c join spans s
    on s.action = 'add' and c.day >= s.since and (s.until is null or c.day < s.until)
   and ((s.key like 'd:%' and (c.h = s.key[3:] or ends_with(c.h, '.' || s.key[3:])))
     or (s.key like 'p:%' and (c.h || c.p = s.key[3:] or starts_with(c.h || c.p, s.key[3:] || '/')))))
select c.page_id, c.url, cast(c.day as varchar) as fetch_day,
       coalesce(string_agg(distinct h.list_id, ',' order by h.list_id), '') as lists,
       coalesce(string_agg(distinct h.key, ',' order by h.key), '') as matched,
       count(h.key) > 0 as blocked
from captures c left join hits h using (page_id) group by 1, 2, 3
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components; a component is named by its smallest doc_id."""
    prints = cut(simhash.with_fingerprint(table(spark, sf_dir, "documents"), "doc_id", width=4))
    lowest = prints.groupBy("print").agg(F.min("doc_id").alias("low"))
    heads = cut(simhash.classes(lowest, budget=4).join(lowest, "print"))
    names = cut(heads.groupBy("head").agg(F.min("low").alias("component_id")))  # materialised, so that the join can split a hot class
    named = cut(heads.join(names, "head").select("print", "component_id"))
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(turns.unionByName(planted)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_documents(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
w as (
  select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         length(regexp_replace(text, '[^0-9]', '', 'g')) as digits
  from d),
each_word as (select r, unnest(words) as word, unnest(range(len(words))) as i from w),
wins as (
  select r, i, string_agg(word, ' ') over (partition by r order by i rows between current row and 7 following) as s,
         count(*) over (partition by r order by i rows between current row and 7 following) as k
  from each_word),
twice as (select r, s from wins where k = 8 group by r, s having count(*) > 1),
covered as (
  select distinct wins.r, wins.i + o.o as i from wins join twice on wins.r = twice.r and wins.s = twice.s, (select unnest(range(8)) as o) o where k = 8),
repeats as (select r, count(*) as n from covered group by r),
m as (
  select d.doc_id, cast(len(words) as bigint) as n_words,
         cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(n_symbols as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(repeats.n, 0) as bigint) as n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as letter_words, digits, len(lines) as n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|•)'))) as bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as ellipses
  from d join w using (r) left join repeats using (r)),
v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or word_chars < 2 * n_words or word_chars > 16 * n_words or 10 * n_symbols > n_words
            or 10 * letter_words < 7 * n_words or 5 * digits > word_chars or 10 * n_dup_lines > 3 * n_lines
            or 10 * bullets > 9 * n_lines or 10 * ellipses > 3 * n_lines) as kept
from v
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tokens = byte_bpe.encode(docs, *vocabulary, ["doc_id"])
    return byte_bpe.decode(tokens, vocabulary[0]).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.count_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as r from documents),
w as (
  select lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by all having count(distinct r) >= 30),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by 1),
g as (select lang, source, coalesce(any_value(v), 0) as v, coalesce(sum(n), 0) as total
      from (select distinct lang, source from d) left join v using (lang) left join c using (lang, source) group by all),
p as (
  select lang, source, term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 5) // (total::hugeint + 5 * v) as p
  from g join kept using (lang) left join c using (lang, source, term)),
whole as (select lang, term, sum(n) as n from p group by lang, term),
q as (
  select lang, term, 1 + 1000000000::hugeint * (n + 5)::hugeint // (sum(n) over (partition by lang) + 5 * count(*) over (partition by lang))::hugeint as q
  from whole),
f as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  where x.term is null or y.term is not null
  group by all
  union all
  select lang, source, 'term', term, p - q from p join q using (lang, term) where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value,
       cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank
from f qualify part = 'pair' or rank <= 50
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    names = (op1_sharding, op2_language, op3_sentencepiece, op4_url_filter, op5_simhash, op6_lm_score, op7_embedding_dedup, op8_mixing, op9_chat, op10_quality, op11_byte_bpe, op12_alignment, op13_divergence, pipeline)
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op10_quality": OP10_SQL, "op13_divergence": OP13_SQL}
