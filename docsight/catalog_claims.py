"""Registered queries of the claim and run operators, with their SQL.

The driver tables stand in for claims, statements, runs and communities; every
query reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import forms as fm
from .functions import text as tx
from .operators import cite
from .operators import claims as cl
from .operators import graph as gr
from .operators import ingest as ig
from .operators import runs as rn
from .registry import query

#: Names that show a rule each, beside those of the part table.
SHOWN = (
    "Databases", "database", "The cases", "case", "houses", "HCS", "APIs", "~/.aws/credentials", "read-only mode", "Read Only Modes", "children", "Indices",
    "analyses", "policies", "an  index", "buses", "bus", "processes", "process", "Claude's plans", "Claude plan", "means", "customs", "v1.2s", "", "the", "Statuses", "boxes",
    "a_b/c", "“quoted” names", "x’s tools", "DNS", "dns", "women", "axes", "series", "gas", "glass", "glasses", "S3 buckets",
)
_VALUES = ", ".join("('" + n.replace("'", "''") + "')" for n in SHOWN)
_NAMES = f"select p_name as name from part union select p_type || 's' from part union select 'The ' || p_brand || chr(39) || 's ' || p_name from part union select * from (values {_VALUES})"


def _names(t):
    p = t("part")
    shown = p.sparkSession.createDataFrame([(n,) for n in SHOWN], "name string")
    own = p.select(F.explode(F.array("p_name", F.concat("p_type", F.lit("s")), F.concat(F.lit("The "), "p_brand", F.lit("'s "), "p_name"))).alias("name"))
    return own.unionByName(shown).distinct()


@query(f"select name, {fm.form_sql('name')} as key, {fm.plural_sql('name')} as plural from ({_NAMES})")
def form_keys(t):
    return _names(t).select("name", fm.form_key(F.col("name")).alias("key"), fm.is_plural(F.col("name")).alias("plural"))


@query(f"""with n as (select name, name as owner, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') as w from ({_NAMES})),
irr as (select * from (values {', '.join(f"('{a}', '{b}')" for a, b in fm.IRREGULAR.items())}) v(p, s)),
f as (select name, w, unnest([w || 's', w || 'es', case when w like '%y' then w[:-2] || 'ies' end, case when length(w) > 2 and w like '%s' then w[:-2] end,
  case when length(w) > 2 and w like '%s' then w[:-3] end, case when length(w) > 3 and w like '%ies' then w[:-4] || 'y' end, s, s || 's']) as form from n left join irr on p = w where w <> '')
select distinct least(f.name, n.name) as a, greatest(f.name, n.name) as b from f join n on n.w = f.form and f.form <> '' and f.form <> f.w and n.name <> f.name""")
def missed_plurals(t):
    return cl.missed_plurals(_names(t).withColumn("owner", F.col("name")))


@query("""with p as (select p_brand as key, p_type as name, case when p_size % 3 > 0 then p_size % 7 end as chunk from part),
f as (select distinct * from p where chunk is not null), n as (select key, count(distinct name) as named from f group by key),
m as (select key, chunk, count(*) as k from f group by 1, 2), s as (select key, count(*) as shared from m join n using (key) where k = named group by key)
select key, coalesce(named, 0) as named, case when coalesce(named, 0) < 2 then 0 else coalesce(shared, 0) end as shared,
  case when coalesce(named, 0) < 2 then 'unknown' when coalesce(shared, 0) > 0 then 'high' else 'low' end as confidence from (select distinct key from p) left join n using (key) left join s using (key)""")
def merge_confidence(t):
    p = t("part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("name"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 7).alias("chunk"))
    return cl.merge_confidence(p)


@query("""with s as (select s_suppkey as a, l_partkey as b, case l_linenumber % 4 when 0 then 'acronym' when 1 then 'subset' when 2 then 'structure' else 'rewrite' end as signal from lineitem join supplier on s_suppkey = l_suppkey),
m as (select a, b, list_sort(list_distinct(list(signal))) as x from s group by a, b)
select a, b, array_to_string(x, ',') as signals, len(x) as n, case when list_has_any(x, ['bracket', 'acronym', 'rewrite']) then 'merge' when list_contains(x, 'subset') then 'subsumption' else 'association' end as kind from m""")
def candidate_kinds(t):
    kinds = F.element_at(F.array(*map(F.lit, ("acronym", "subset", "structure", "rewrite"))), F.col("l_linenumber") % 4 + 1)
    s = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_suppkey").alias("a"), F.col("l_partkey").alias("b"), kinds.alias("signal"))
    return cl.candidate_kinds(s).select("a", "b", F.array_join("signals", ",").alias("signals"), F.col("n").cast("long").alias("n"), "kind")


@query("""with n as (select c_custkey as id, c_name as name, [c_mktsegment, c_name, 'seg ' || c_nationkey] as aliases from customer),
e as (select o_custkey as src, (o_orderkey * 7) % 40 as dst from orders where o_custkey <> (o_orderkey * 7) % 40),
w as (select src, dst, count(*) as w from (select src, dst from e union all select dst, src from e) group by 1, 2),
b as (select src as id, name, row_number() over (partition by src order by w desc, name) as r from w join (select id as dst, name from n) using (dst)),
k as (select id, string_agg(name, ', ' order by name) as near from b where r <= 10 group by id)
select n.id, n.name, n.name || ' | aliases: ' || array_to_string(list_sort(list_distinct(list_filter(aliases, lambda a: a <> n.name))), ', ') || coalesce(' | neighbors: ' || near, '') as card from n left join k using (id)""")
def neighbour_cards(t):
    n = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment", "c_name", F.concat(F.lit("seg "), "c_nationkey")).alias("aliases"))
    return cl.neighbour_cards(n, t("orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % 40).alias("dst")))


_SAID = ("this approach", "It", "it was sandboxed", "these", "a function that returns", "Such tools", "that is why", "there", "they said so often that", "this one of the many cases", "")
_SAID_SQL = ", ".join(f"('{x}')" for x in _SAID)
_ANAPHOR = "|".join(fm.ANAPHORS)
_CLAUSE = "|".join(fm.CLAUSE_WORDS)


@query(f"""with s as (select text from (values {_SAID_SQL}) v(text) union all select w || ' ' || p_name from part, (select unnest(['this', 'those are', 'it', 'the']) as w)),
x as (select text, regexp_extract(lower(trim(text)), '^({_ANAPHOR})\\b', 1) as word, len(regexp_split_to_array(trim(text), '\\s+')) as n from s)
select text, case when word = '' then null when n = 1 then 'bare' when n <= 5 and not regexp_matches(lower(trim(text))[length(word) + 1:], '\\b({_CLAUSE})\\b') then 'phrase' else 'embedded' end as kind, nullif(word, '') as word from x""")
def anaphors(t):
    p = t("part")
    shown = p.sparkSession.createDataFrame([(x,) for x in _SAID], "text string")
    own = p.select(F.explode(F.transform(F.array(*map(F.lit, ("this", "those are", "it", "the"))), lambda w: F.concat(w, F.lit(" "), F.col("p_name")))).alias("text"))
    found = fm.anaphor(F.col("text"))
    return shown.unionByName(own).select("text", found["kind"].alias("kind"), found["word"].alias("word"))


@query("""with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9' || chr(39) || ']+)', 1) as w from documents)
select doc_id, 'odd' as kind, len(w) >= 7 as verbatim from d union all select doc_id, 'three', false from d union all select doc_id, 'made', false from d""")
def verbatim_evidence(t):
    """Each document's odd words, its first five words and a few made-up ones against the document itself."""
    words = fm.evidence_words(F.col("text"))
    odd = F.filter(words, lambda w, i: i % 2 == 0)
    made = F.array(F.lit("no"), F.lit("such"), F.lit("words"), F.lit("here0"))
    each = F.explode(F.array(F.struct(F.lit("odd").alias("kind"), F.array_join(odd, " ").alias("e")), F.struct(F.lit("three").alias("kind"), F.array_join(F.slice(words, 1, 3), " ").alias("e")), F.struct(F.lit("made").alias("kind"), F.array_join(made, " ").alias("e"))))
    return t("documents").select("doc_id", "text", each.alias("x")).select("doc_id", F.col("x.kind").alias("kind"), fm.is_verbatim(F.col("x.e"), F.col("text")).alias("verbatim"))


_PHRASES = {"list": ["the list of", "list"], "compare": ["compared with", "the ", "und "], "trace": ["de la ", "la "]}
_ROUTES = {"list": "graph", "compare": "graph", "trace": "graph", "fact": "vector"}


def _consumed_sql(text: str) -> tuple[str, str]:
    """Groups and hits of ``_PHRASES`` in a text, the longest first, each replaced once it is found."""
    ordered = sorted(((g, p) for g, ps in _PHRASES.items() for p in ps), key=lambda x: -len(x[1]))
    steps, before = [f"s0 as (select *, coalesce({text}, '') as rest, cast(null as varchar) as grp, cast([] as varchar[]) as hits from c)"], "s0"
    for i, (g, p) in enumerate(ordered, 1):
        steps.append(f"s{i} as (select * exclude (rest, grp, hits), replace(rest, '{p}', chr(1)) as rest, case when contains(rest, '{p}') then coalesce(grp, '{g}') else grp end as grp, case when contains(rest, '{p}') then list_append(hits, '{p}') else hits end as hits from {before})")
        before = f"s{i}"
    return ", ".join(steps), before


_STEPS, _LAST = _consumed_sql("text")


@query(f"""with c as (select conv_id * 1000 + turn as id, text, conv_id, turn from conversations), {_STEPS},
r as (select *, turn % 3 <> 0 as told, case turn % 3 when 1 then 'fact' else 'other' end as need, case when conv_id % 5 = 0 then 'Timeout' end as err from {_LAST})
select id, case when grp is not null then grp when told and err is null and need = 'fact' then 'fact' end as "group",
  case when grp is not null then 'graph' else 'vector' end as route, case when grp is not null then 'lexicon' when told and err is null and need = 'fact' then 'reply' else 'default' end as decided_by,
  case when grp is not null then array_to_string(hits, ' / ') when told and err is null and need = 'fact' then 'says so' when not told then 'unavailable' when err is not null then 'error:' || err else 'unsure' end as evidence,
  case when grp is not null or (told and err is null and need = 'fact') then null when not told then 'unavailable' when err is not null then 'error:' || err else 'unsure' end as degraded,
  grp is null and told and (err is not null or need <> 'fact') as needs_review from r""")
def route_cascade(t):
    c = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text")
    need = F.when(F.col("turn") % 3 == 1, "fact").otherwise("other")
    replies = c.filter("turn % 3 <> 0").select("id", need.alias("need"), F.lit("says so").alias("reason"), F.when(F.col("conv_id") % 5 == 0, "Timeout").alias("error"))
    return rn.decide_route(c.select("id", "text"), _PHRASES, replies, _ROUTES)


@query("""with h as (select o_custkey as query_id, o_orderkey as id, case when o_orderkey % 11 > 0 then round(o_totalprice, 2) end as score from orders)
select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc nulls last, id) as rank from h) where rank <= 5""")
def reranked(t):
    h = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("score"))
    return rn.rerank(h.drop("score"), h.filter("id % 11 > 0"), 5).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def pieces_sql(cap: int) -> str:
    """CTEs up to ``pieces`` (doc_id, pos, piece, text, s, e): paragraphs longer than the cap, in pieces; places are those in the text."""
    return rf"""para as (select doc_id, pos, p, sum(length(p) + 1) over (partition by doc_id order by pos) - length(p) - 1 as off from (
  select doc_id, unnest(string_split(text, chr(10))) as p, unnest(range(len(string_split(text, chr(10))))) as pos from documents)),
raw as (select doc_id, pos, off, unnest(l) as r, unnest(range(len(l))) as i from (select doc_id, pos, off, string_split(regexp_replace(regexp_replace(p, '([.!?])(\s+[A-Z0-9"''“”‘’（(])', '\1' || chr(1) || '\2', 'g'), '([。！？；;])', '\1' || chr(1), 'g'), chr(1)) as l from para where length(p) > {cap})),
sent as (select doc_id, pos, own, b, row_number() over (partition by doc_id, pos order by i) as n from (
  select *, trim(r) as own, off + sum(length(r)) over (partition by doc_id, pos order by i) - length(r) + length(r) - length(ltrim(r)) as b from raw) where own <> ''),
packed as (select doc_id, pos, n, own as text, b as s, b + length(own) as e, 0 as k, length(own) as len from sent where n = 1
  union all select t.doc_id, t.pos, t.n, case when p.len + length(t.own) > {cap} then t.own else p.text || t.own end, case when p.len + length(t.own) > {cap} then t.b else p.s end, t.b + length(t.own),
    case when p.len + length(t.own) > {cap} then p.k + 1 else p.k end, case when p.len + length(t.own) > {cap} then length(t.own) else p.len + length(t.own) end
  from packed p join sent t on t.doc_id = p.doc_id and t.pos = p.pos and t.n = p.n + 1),
whole as (select * from packed qualify row_number() over (partition by doc_id, pos, k order by n desc) = 1),
pieces as (select doc_id, pos, row_number() over (partition by doc_id, pos order by k, c) - 1 as piece, text[c * {cap} + 1:(c + 1) * {cap}] as text, s + c * {cap} as s, least(e, case when length(text) > {cap} then s + (c + 1) * {cap} else e end) as e
  from (select *, unnest(range(greatest(1, cast(ceil(length(text) / {cap}) as bigint)))) as c from whole))"""


@query(f"with recursive {pieces_sql(200)} select doc_id, pos, piece, text from pieces")
def long_split(t):
    return ig.split_long(t("documents"), "doc_id", "text", 200).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("piece").cast("long").alias("piece"), "text")


_LOOSE = "replace(replace(text, ' ', chr(9) || ' '), chr(10), '  ')"


@query(rf"""with q as (select item_id, trim(regexp_replace({_LOOSE}, '\s+', ' ', 'g')) as quote from benchmark),
d as (select doc_id, text, regexp_replace(text, '\s+', ' ', 'g') as plain, regexp_extract_all(text, '\s+') as runs from documents),
f as (select item_id, doc_id, instr(plain, quote) as place, quote, plain, runs from q join d on contains(plain, quote) where quote <> ''),
x as (select *, place - 1 as a, place + length(quote) - 2 as z from f),
y as (select *, length(plain[:a]) - length(replace(plain[:a], ' ', '')) as na, length(plain[:z]) - length(replace(plain[:z], ' ', '')) as nz from x)
select item_id, doc_id, cast(a + coalesce(list_sum(list_transform(runs[:na], lambda r: length(r) - 1)), 0) as bigint) as start, cast(z + coalesce(list_sum(list_transform(runs[:nz], lambda r: length(r) - 1)), 0) + 1 as bigint) as "end" from y""")
def loose_quotes(t):
    quotes = t("benchmark").select("item_id", F.expr("replace(replace(text, ' ', concat(char(9), ' ')), char(10), '  ')").alias("quote"))
    return ig.locate_loosely(quotes, t("documents").select("doc_id", "text")).select("item_id", "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""with q as (select item_id % 10 as claim, item_id as place, text as quote from benchmark),
f as (select claim, place, doc_id, instr(d.text, quote) - 1 as s, instr(d.text, quote) - 1 + length(quote) as e from q join documents d on contains(d.text, quote) where quote <> ''),
c as (select doc_id, unnest(range(0, greatest(1, length(text)), 1000)) as cs from documents),
t as (select claim, count(distinct (doc_id, cs)) as chunks from f join c using (doc_id) where cs < e and cs + 1000 > s group by claim)
select claim, s as start, e as "end", coalesce(chunks, 0) as chunks, asked - coalesce(hits, 0) as lost, case when s is null then 'section' end as anchor
from (select claim, count(*) as asked from q group by claim) left join (select claim, min(s) as s, max(e) as e, count(distinct place) as hits from f group by claim) using (claim) left join t using (claim)""")
def evidence_anchors(t):
    q, d = t("benchmark").select((F.col("item_id") % 10).alias("claim"), F.col("item_id").alias("place"), F.col("text").alias("quote")), t("documents").select("doc_id", "text")
    found = ig.locate(q.select(F.col("place").alias("item_id"), "quote"), d).withColumnRenamed("item_id", "place").join(q.select("claim", "place"), "place")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(1000)))
    chunks = d.select("doc_id", starts.alias("start")).select("doc_id", F.col("start").alias("seq"), "start", (F.col("start") + 1000).alias("end"))
    return cl.anchor(q, found, chunks).select("claim", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "chunks", "lost", "anchor")


@query("""with c as (select o_orderkey as claim, case o_orderstatus when 'P' then 'pending' else 'mapped' end as status from orders),
p as (select l_orderkey as claim, l_linenumber as quote, 'c' || (l_partkey % 50) as chunk, l_partkey % 50 as chunk_start from lineitem),
f as (select claim, chunk, chunk_start from p qualify row_number() over (partition by claim order by quote, chunk_start, chunk) = 1)
select claim, coalesce(chunk, '_orphan') as block, chunk_start as block_start from c left join f using (claim) where status <> 'pending'""")
def claim_blocks(t):
    c = t("orders").select(F.col("o_orderkey").alias("claim"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("mapped").alias("status"))
    place = F.col("l_partkey") % 50
    p = t("lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("quote"), F.concat(F.lit("c"), place).alias("chunk"), place.alias("chunk_start"))
    return cl.claim_blocks(c, p)


_VOCABULARY = ["O", "F", "uses", "causes"]


@query("""with c as (select o_orderkey as claim, o_orderpriority as predicate from orders), r as (select * from (values ('1-URGENT', 'uses', null), ('2-HIGH', 'unmapped', 'causes'), ('3-MEDIUM', 'odd', 'odd'), ('1-URGENT', null, 'causes')) v(predicate, relation, nearest)),
k as (select predicate, max(case when relation in ('O', 'F', 'uses', 'causes') then relation end) as r, max(case when nearest in ('O', 'F', 'uses', 'causes') then nearest end) as n from r group by 1)
select claim, predicate, coalesce(r, n) as relation, case when r is not null then 'mapped' when n is not null then 'forced' else 'pending' end as status from c left join k using (predicate)""")
def predicate_states(t):
    o = t("orders")
    replies = o.sparkSession.createDataFrame([("1-URGENT", "uses", None), ("2-HIGH", "unmapped", "causes"), ("3-MEDIUM", "odd", "odd"), ("1-URGENT", None, "causes")], "predicate string, relation string, nearest string")
    return cl.predicate_status(o.select(F.col("o_orderkey").alias("claim"), F.col("o_orderpriority").alias("predicate")), replies, _VOCABULARY).select("claim", "predicate", "relation", "status")


@query("""with e as (select p_type || ' ' || (l_linenumber % 4) as predicate from lineitem join part on p_partkey = l_partkey),
m as (select p_type || ' ' || k as predicate, max(case k when 0 then 'unmapped' when 1 then 'split_needed' else p_brand end) as relation from part, (select unnest([0, 1, 2]) as k) group by 1),
c as (select predicate, count(*) as n from e group by 1), s as (select case when relation is null then 'missing' when relation in ('unmapped', 'split_needed') then relation else 'mapped' end as state, n from c left join m using (predicate))
select state, count(*) as kinds, cast(sum(n) as bigint) as edges, round(sum(n) / sum(sum(n)) over (), 6) as share from s group by state""")
def mapping_coverage(t):
    p = t("part")
    e = t("lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.concat_ws(" ", "p_type", F.col("l_linenumber") % 4).alias("predicate"))
    k = p.select("p_type", "p_brand", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    m = k.select(F.concat_ws(" ", "p_type", "k").alias("predicate"), F.when(F.col("k") == 0, "unmapped").when(F.col("k") == 1, "split_needed").otherwise(F.col("p_brand")).alias("relation"))
    return cl.mapping_coverage(e, m)


@query("""select o_orderpriority as word, count(*) filter (where o_orderstatus = 'F') as forced, count(*) filter (where o_orderstatus = 'P') as pending, count(distinct o_custkey) as sources
from orders where o_orderpriority not in ('1-URGENT', '2-HIGH') group by 1""")
def off_vocabulary(t):
    state = F.when(F.col("o_orderstatus") == "F", "forced").when(F.col("o_orderstatus") == "P", "pending").otherwise("mapped")
    return cl.off_vocabulary(t("orders").select(F.col("o_orderpriority").alias("predicate"), state.alias("status"), F.col("o_custkey").alias("source")), ["1-URGENT", "2-HIGH"])


@query("""with s as (select o_custkey as id, o_orderstatus as st from orders), n as (select count(*) as n, count(distinct id) as d, count(*) filter (where st = 'P') as l from s),
e as (select count(*) as m, count(*) filter (where l_returnflag not in ('A', 'N')) as x from lineitem)
select 'statements' as "check", n as found, n = 15000 as ok from n union all select 'edges', m, m = 60000 from e union all select 'repeated_ids', n - d, n = d from n union all select 'unanchored', l, l = 0 from n union all select 'unknown_relations', x, x = 0 from e""")
def stored_problems(t):
    s = t("orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.array("o_orderkey")).alias("chunks"))
    return cl.stored_problems(s, t("lineitem").select(F.col("l_returnflag").alias("predicate")), {"statements": 15000, "edges": 60000}, ["A", "N"])


@query("""with n as (select unnest([p_name, p_brand, p_type]) as name from part where p_size > 10) select p_brand as "group", count(distinct p_name) as wanted, count(distinct case when p_name in (select name from n) then p_name end) as reached from part group by 1""")
def alias_reach(t):
    p = t("part")
    return cl.alias_reach(p.filter("p_size > 10").select(F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases")), p.select(F.col("p_brand").alias("group"), F.col("p_name").alias("name")))


@query("""select l_orderkey, '[' || string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey) || ']' as items from lineitem group by 1""")
def ordered_json(t):
    return cl.in_order(t("lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


@query("""select event_id, coalesce(case when user_id % 4 > 0 then user_id end, cast(nullif(regexp_extract(event_type || '-' || event_id, '([0-9]+)$', 1), '') as bigint), 0) as place from events""")
def chunk_positions(t):
    seq = F.when(F.col("user_id") % 4 > 0, F.col("user_id"))
    return t("events").select("event_id", cl.chunk_position(seq, F.concat_ws("-", "event_type", "event_id")).alias("place"))


@query("""select o_orderkey as id, o_orderstatus as subject, cast(null as varchar) as note from orders union all select c_custkey, null, c_name from customer union all select s_suppkey, s_name, null from supplier""")
def bundle_union(t):
    return cl.bundle_union([
        t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("subject")),
        t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("note")),
        t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("subject")),
    ])


@query(r"""with x as (select c_custkey as id, c_name || ' see A' || (c_custkey % 90) || ' and B' || c_nationkey || ', A' || (c_custkey % 90) || ' xB1' as text from customer),
s as (select distinct 'A' || p_size as source_id from part), f as (select distinct id, unnest(regexp_extract_all(text, '\b([A-Z]{1,3}[0-9]+)\b', 1)) as source_id from x)
select id, source_id from f join s using (source_id)""")
def source_tokens(t):
    a = F.concat(F.lit("A"), F.col("c_custkey") % 90)
    x = t("customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" see "), a, F.lit(" and B"), "c_nationkey", F.lit(", "), a, F.lit(" xB1")).alias("text"))
    return cl.source_tokens(x, t("part").select(F.concat(F.lit("A"), "p_size").alias("source_id")))


_PATH = "case p_size % 3 when 0 then p_brand when 1 then p_brand || ' / ' || p_type else p_brand || ' / x / ' || p_name end"


@query(f"""with c as (select p_partkey, p_brand, {_PATH} as path from part), l as (select *, case when contains(path, ' / ') then trim(list_last(string_split(path, ' / '))) end as leaf from c),
k as (select p_brand, greatest(320, 450 - max(length('来源：' || p_brand)) - max(coalesce(length(leaf), 0)) - 10) as cap from l group by 1)
select p_partkey, '来源：' || p_brand || coalesce(chr(10) || chr(10) || leaf, '') || chr(10) || chr(10) || 'text' as stored, cap from l join k using (p_brand)""")
def stored_chunks(t):
    p = t("part").select("p_partkey", "p_brand", F.expr(_PATH).alias("path"))
    return p.join(cl.chunk_cap(p, "p_brand", "p_brand", "path"), "p_brand").select("p_partkey", cl.stored_text(F.col("p_brand"), F.col("path"), F.lit("text")).alias("stored"), "cap")


@query("""with c as (select o_orderkey as "case", o_orderpriority as criterion, case o_orderstatus when 'P' then 'machine' else 'model' end as kind from orders),
r as (select o_orderkey as "case", o_orderpriority as criterion, case o_orderkey % 5 when 0 then ' Pass' when 1 then 'fail' when 2 then 'maybe' else '' end as verdict, 'r' || o_orderkey as reason from orders where o_orderkey % 6 > 0)
select "case", criterion, case when lower(trim(verdict)) in ('pass', 'fail') then lower(trim(verdict)) else 'pending' end as state,
  case when r.reason is null then 'no reply' when trim(verdict) = '' then 'empty reply' when lower(trim(verdict)) not in ('pass', 'fail') then 'unknown verdict' else r.reason end as reason from c left join r using ("case", criterion) where kind = 'model'""")
def judged_criteria(t):
    o = t("orders")
    key = [F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("criterion")]
    said = F.element_at(F.array(*map(F.lit, (" Pass", "fail", "maybe", "", ""))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    replies = o.filter("o_orderkey % 6 > 0").select(*key, said.alias("verdict"), F.concat(F.lit("r"), "o_orderkey").alias("reason"))
    return rn.judged(o.select(*key, F.when(F.col("o_orderstatus") == "P", "machine").otherwise("model").alias("by")), replies)


@query("""with v as (select l_suppkey as "case", l_linestatus as criterion, l_returnflag as verdict from lineitem), c as (select "case", criterion, verdict, count(*) as n from v group by all)
select "case", criterion, cast(sum(n) as bigint) as times, max(case when r = 1 then verdict end) as majority, round(max(n) / sum(n), 6) as agreement, max(n) = sum(n) as stable
from (select *, row_number() over (partition by "case", criterion order by n desc, verdict) as r from c) group by 1, 2""")
def rejudged(t):
    return rn.rejudge(t("lineitem").select(F.col("l_suppkey").alias("case"), F.col("l_linestatus").alias("criterion"), F.col("l_returnflag").alias("verdict")))


@query("""select * from (select doc_id as id, cast(contains(text, 'that and the') as bigint) + cast(contains(text, 'and the that') as bigint) + cast(contains(text, 'de la en que') as bigint) as fragments from documents) where fragments > 0""")
def prompt_leaks(t):
    prompt = "short\n  that and the\nand the that \n\nde la en que\nthat and the"
    return rn.prompt_leaks(t("documents").select(F.col("doc_id").alias("id"), "text"), prompt).select("id", F.col("fragments").cast("long").alias("fragments"))


_COMMUNITIES = "select o_custkey % 4 as level, o_custkey as id, list(l_partkey) as units from orders join lineitem on l_orderkey = o_orderkey group by 1, 2"


def _communities(t):
    both = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy((F.col("o_custkey") % 4).alias("level"), F.col("o_custkey").alias("id")).agg(F.collect_list("l_partkey").alias("units"))


@query(f"""with c as ({_COMMUNITIES}), u as (select level, unnest(units) as unit from c)
select level, communities, slots, units, round(slots / units, 6) as repetition from (select level, count(distinct id) as communities from c group by 1) join (select level, count(*) as slots, count(distinct unit) as units from u group by 1) using (level)""")
def level_costs(t):
    return rn.level_costs(_communities(t))


@query("""select (select count(distinct l_partkey) from lineitem where l_linestatus = 'O') as previous, (select count(distinct l_partkey) from lineitem where l_linestatus = 'F') as delta, (select count(distinct l_partkey) from lineitem) as merged,
(select count(*) from (select l_partkey from lineitem where l_linestatus = 'O' intersect select l_partkey from lineitem where l_linestatus = 'F')) as shared,
(select count(distinct l_partkey) from lineitem) = (select count(distinct l_partkey) from lineitem where l_linestatus in ('O', 'F')) as adds_up""")
def reconciled_sizes(t):
    item = t("lineitem")
    return rn.reconcile_sizes(item.filter("l_linestatus = 'O'"), item.filter("l_linestatus = 'F'"), item, "l_partkey")


@query("""with r as (select o_orderpriority as arm, case o_orderstatus when 'O' then 'entity' else 'report' end as kind, o_custkey % 5 as level, cast(floor(o_totalprice) as bigint) % 1000 as tokens, case when o_custkey % 5 > 0 then o_custkey end as parent from orders)
select arm, count(*) filter (where kind = 'entity') as entities, count(*) filter (where kind = 'report') as reports, min(level) filter (where kind = 'report') as low, max(level) filter (where kind = 'report') as high, count(*) filter (where kind = 'report' and parent is null) as roots,
round(sum(tokens) filter (where kind = 'entity') / count(*) filter (where kind = 'entity'), 6) as tokens_per_entity, round(sum(tokens) filter (where kind = 'report') / sum(tokens) filter (where kind = 'entity'), 6) as report_ratio from r group by arm""")
def compared_arms(t):
    level = F.col("o_custkey") % 5
    r = t("orders").select(F.col("o_orderpriority").alias("arm"), F.when(F.col("o_orderstatus") == "O", "entity").otherwise("report").alias("kind"), level.alias("level"), (F.floor("o_totalprice").cast("long") % 1000).alias("tokens"), F.when(level > 0, F.col("o_custkey")).alias("parent"))
    return rn.compare_arms(r)


@query("""with recursive n as (select c_custkey as node from customer), e as (select c_custkey as a, c_custkey + 7 as b from customer where c_custkey % 10 < 4 and c_custkey + 7 in (select node from n)),
x as (select a, b from e union select b, a from e), r as (select a as node, a as seen from x union select r.node, x.b from r join x on x.a = r.seen),
c as (select node, min(seen) as component from r group by node), s as (select coalesce(component, node) as k, count(*) as n from n left join c using (node) group by 1)
select cast(sum(n) as bigint) as nodes, count(*) as components, max(n) as largest, round(max(n) / sum(n), 6) as share from s""")
def largest_component(t):
    n = t("customer").select(F.col("c_custkey").alias("node"))
    e = n.filter("node % 10 < 4").select(F.col("node").alias("src"), (F.col("node") + 7).alias("dst"))
    known = e.join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    return rn.largest_component(n, gr.components(known))


@query("""with m as (select distinct o_custkey as community, l_partkey as member from orders join lineitem on l_orderkey = o_orderkey), b as (select p_partkey as member, min(p_brand) as batch from part where p_size < 40 group by 1)
select community, count(*) as size, count(distinct batch) as batches, count(*) filter (where batch is null) as dangling from m left join b using (member) group by 1""")
def cross_batches(t):
    m = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("community"), F.col("l_partkey").alias("member"))
    return rn.cross_batch(m, t("part").filter("p_size < 40").select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("batch")))


@query("""with l as (select distinct l_suppkey as entity, l_orderkey as unit from lineitem), u as (select o_orderkey as unit, o_custkey as doc from orders where o_orderkey % 9 > 0), k as (select c_custkey as doc, c_mktsegment as category from customer where c_nationkey > 2),
f as (select entity, category, count(*) as n from l left join u using (unit) left join k using (doc) group by 1, 2), a as (select entity, sum(n) as s from f group by 1),
b as (select entity, category, n from f where category is not null qualify row_number() over (partition by entity order by n desc, category) = 1)
select entity, category, coalesce(n, 0) as units, round(coalesce(n, 0) / s, 6) as share from a left join b using (entity)""")
def main_categories(t):
    return rn.main_category(
        t("lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("unit")),
        t("orders").filter("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("doc")),
        t("customer").filter("c_nationkey > 2").select(F.col("c_custkey").alias("doc"), F.col("c_mktsegment").alias("category")),
    )


@query("""with s as (select o_orderkey as request, min(o_custkey % 20) as session from orders where o_orderkey % 8 > 0 group by 1)
select session, count(*) as calls, cast(sum(cast(l_quantity as bigint)) as bigint) as tokens, count(distinct l_orderkey) as requests from lineitem left join s on request = l_orderkey group by 1""")
def session_usage(t):
    s = t("orders").filter("o_orderkey % 8 > 0").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 20).alias("session"))
    return rn.session_usage(t("lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_quantity").cast("long").alias("tokens")), s)


@query("""with a as (select p_name as title, min(p_type) as ta from part where p_size < 30 group by 1), b as (select p_name as title, min(p_type) as tb from part where p_size > 15 group by 1)
select ta as type_a, tb as type_b, count(*) as titles from a full join b using (title) group by 1, 2""")
def type_changes(t):
    p = t("part").select(F.col("p_name").alias("title"), F.col("p_type").alias("type"), "p_size")
    return rn.type_changes(p.filter("p_size < 30"), p.filter("p_size > 15"))


@query("""select source, count(*) as texts, count(*) filter (where contains(coalesce(text, ''), chr(65533))) as broken, count(*) filter (where length(coalesce(text, '')) < 50) as short,
count(*) filter (where not starts_with(coalesce(text, ''), 'The')) as headless, count(*) filter (where contains(lower(coalesce(text, '')), 'license') or contains(lower(coalesce(text, '')), 'cookie')) as noisy from documents group by source""")
def text_health(t):
    return rn.text_health(t("documents"), "source", "text", ["license", "cookie"], "The")


@query("select doc_id, lang, source, n_chars from documents")
def light_listing(t):
    return rn.light(t("documents"), ("text",))


@query("select event_id, event_type, user_id from (select *, row_number() over (order by ts desc, event_id desc) as r from events where event_type = 'error') where r <= 100")
def last_logs(t):
    logs = t("events").withColumnRenamed("event_type", "type")
    return rn.last_logs(logs, "error", [F.desc("ts"), F.desc("event_id")], 100).select("event_id", F.col("type").alias("event_type"), "user_id")


@query("""select o_orderkey as result, o_custkey as "case", c_name as question, c_mktsegment as expected, c_custkey is not null as known from orders left join (select * from customer where c_nationkey <> 3) on c_custkey = o_custkey""")
def run_references(t):
    cases = t("customer").filter("c_nationkey <> 3").select(F.col("c_custkey").alias("case"), F.col("c_name").alias("question"), F.col("c_mktsegment").alias("expected"))
    return rn.with_reference(t("orders").select(F.col("o_orderkey").alias("result"), F.col("o_custkey").alias("case")), cases).select("result", "case", "question", "expected", "known")


@query("""select key, value from (select 'k' || (user_id % 40) as key, case when event_id % 6 > 0 then props end as value, event_id, row_number() over (partition by user_id % 40 order by event_id desc) as r from events) where r = 1 and value is not null""")
def settings_now(t):
    return rn.settings(t("events").select(F.concat(F.lit("k"), F.col("user_id") % 40).alias("key"), F.when(F.col("event_id") % 6 > 0, F.col("props")).alias("value"), F.col("event_id").alias("version")))


@query("""with s as (select s_nationkey as source, count(*) as statements from supplier group by 1), c as (select c_nationkey as source, count(*) as concepts from customer group by 1)
select n_nationkey as source, coalesce(statements, 0) as statements, coalesce(concepts, 0) as concepts from nation left join s on s.source = n_nationkey left join c on c.source = n_nationkey""")
def source_counts(t):
    count = lambda d, key, name: d.groupBy(F.col(key).alias("source")).agg(F.count(F.lit(1)).alias(name))
    n = t("nation").select(F.col("n_nationkey").alias("source"))
    both = n.join(count(t("supplier"), "s_nationkey", "statements"), "source", "left").join(count(t("customer"), "c_nationkey", "concepts"), "source", "left")
    return both.fillna(0, ["statements", "concepts"])


@query("""select o_orderkey, n1.n_name as subject, n2.n_name as object from orders join customer on c_custkey = o_custkey join nation n1 on n1.n_nationkey = c_nationkey left join nation n2 on n2.n_nationkey = o_orderkey % 30
where n1.n_name like '%1%' and o_orderstatus in ('O', 'F')""")
def statement_terms(t):
    n = t("nation")
    o = t("orders").filter("o_orderstatus in ('O', 'F')").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    s = o.join(n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("subject")), F.col("a") == F.col("c_nationkey")).filter("subject like '%1%'")
    return s.join(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("object")), F.col("b") == F.col("o_orderkey") % 30, "left").select("o_orderkey", "subject", "object")


@query("""select event_id, array_to_string(list_sort(list_distinct(['v' || (event_id % 9), 'w' || user_id])), ',') as ids from events""")
def nested_keys(t):
    own = F.concat(F.lit("v"), F.col("event_id") % 9)
    body = F.to_json(F.struct(F.array(F.struct(own.alias("kid"), F.struct(F.concat(F.lit("w"), "user_id").alias("kid"), own.alias("other")).alias("in"))).alias("list"), own.alias("kid")))
    return t("events").select("event_id", F.array_join(fm.values_of(body, "kid"), ",").alias("ids"))


@query("""select event_id, '{"a": {"b": "} ' || event_type || '"}, "c": ' || user_id || '}' as object from events""")
def first_objects(t):
    body = F.concat(F.lit('{"a": {"b": "} '), "event_type", F.lit('"}, "c": '), "user_id", F.lit("}"))
    return t("events").select("event_id", fm.first_object(F.concat(F.lit("so: "), body, F.lit(' and {"d": 1}'))).alias("object"))


@query(r"""with n as (select distinct string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] as name from benchmark), q as (select name, trim(regexp_replace(translate(lower(name), '’‐‑‒–—―', chr(39) || '------'), '\s+', ' ', 'g')) as n from n),
d as (select doc_id, text, regexp_replace(translate(lower(text), '’‐‑‒–—―', chr(39) || '------'), '\s+', ' ', 'g') as plain, regexp_extract_all(text, '\s+') as runs from documents),
p as (select name, n, doc_id, plain, runs, unnest(l) as part, unnest(range(len(l))) as i from (select *, string_split(plain, n) as l from q join d on contains(plain, n) where regexp_matches(n, '[a-z0-9]'))),
a as (select *, sum(length(part)) over (partition by name, doc_id order by i) + i * length(n) as place, max(i) over (partition by name, doc_id) as m from p),
f as (select * from a where i < m and (place = 0 or not regexp_matches(plain[place:place], '[a-z0-9]')) and not regexp_matches(plain[place + length(n) + 1:place + length(n) + 1], '[a-z0-9]')),
x as (select *, place + coalesce(list_sum(list_transform(runs[:length(plain[:place]) - length(replace(plain[:place], ' ', ''))], lambda r: length(r) - 1)), 0) as s from f)
select distinct name, doc_id, cast(s // 1000 as bigint) as seq from x""")
def name_occurrences(t):
    w = F.split("text", " ")
    names = t("benchmark").select(F.concat_ws(" ", w[0], w[1]).alias("name"))
    found = ig.occurrences(names, t("documents").select("doc_id", "text"))
    return found.select("name", "doc_id", F.floor(F.col("start") / 1000).alias("seq")).distinct()


@query(r"""select page_id, case when page_id % 3 = 0 then '<p class="a">' || url || ' é \ ' || chr(39) || ' / end</p>' end as held from pages""")
def embedded_texts(t):
    inside = F.concat(F.lit('<p class=\\"a\\">'), F.replace(F.col("url"), F.lit("/"), F.lit("\\/")), F.lit(" \\u00e9 \\\\ \\u0027 \\/ end<\\/p>"))
    page = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<script>GLOBAL_CONFIG.larkContent = '"), inside, F.lit("'; var x = 'y';</script>"), "html")).otherwise(F.col("html"))
    return t("pages").select("page_id", ig.embedded_text(page).alias("held"))


@query(r"""with s as (select doc_id, unnest(l) as raw, unnest(range(len(l))) as n from (select doc_id, string_split(regexp_replace(text, '([.!?]\s)', '\1' || chr(1), 'g'), chr(1)) as l from documents)),
p as (select doc_id, n, trim(raw, ' ') as text, sum(length(raw)) over (partition by doc_id order by n) - length(raw) as s, sum(length(raw)) over (partition by doc_id order by n) as e from s),
w as (select *, coalesce(lag(text) over (partition by doc_id order by n), '') as b, coalesce(lead(text) over (partition by doc_id order by n), '') as a from p)
select doc_id as claim, text as anchor, b as "before", a as "after" from w where (doc_id * 37) % 500 >= s and (doc_id * 37) % 500 < e""")
def anchor_sentences(t):
    d = t("documents").select("doc_id", "text")
    claims = d.select(F.col("doc_id").alias("claim"), "doc_id", (F.col("doc_id") * 37 % 500).alias("at"))
    return cite.anchor_sentences(claims, cite.sentence_spans(d))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query(rf"""with d as (select doc_id, list_filter(regexp_extract_all(lower(text), '([a-z0-9]+(?:[._\-][a-z0-9]+)*)', 1), lambda w: length(w) >= 2) as a,
  regexp_extract_all(regexp_replace(lower(text), '[a-z0-9]', ' ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+') as o from documents),
k as (select doc_id, list_filter(list_concat(a, flatten(list_transform(o, lambda r: list_transform(range(1, length(r)), lambda i: r[i:i + 1])))), lambda w: w not in ({_STOP})) as w from d)
select doc_id, len(w) as n, md5(array_to_string(w, ' ')) as digest from k""")
def mixed_terms(t):
    d = t("documents").select("doc_id", tx.mixed_tokens(F.col("text")).alias("w"))
    return d.filter("w is not null").select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))
