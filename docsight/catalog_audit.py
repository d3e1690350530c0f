"""Registered queries of the naming, linking and judging operators, with their SQL.

The driver tables stand in for claims, statements, runs and communities; every
query reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import forms as fm
from .functions import naming as nm
from .functions import text as tx
from .operators import graph as gr
from .operators import judge as jd
from .operators import links as lk
from .operators import retrieve as rt
from .registry import query

@query("""with recursive e as (select o_orderpriority as role, o_orderkey as claim_idx, unnest([o_custkey * 3, o_custkey + 1400]) as chunk_id, unnest([0, 1]) as pos from orders),
f as (select role, chunk_id, min(claim_idx * 2 + pos) as place from e group by 1, 2),
k as (select role, chunk_id, place, p_size + 10 as size from f left join part on p_partkey = chunk_id),
d as (select *, row_number() over (partition by role order by place) as rn from k where size is not null),
r as (select role, chunk_id, rn, size <= 2000 as ok, case when size <= 2000 then size else 0 end as used from d where rn = 1
  union all select d.role, d.chunk_id, d.rn, r.used + d.size <= 2000, case when r.used + d.size <= 2000 then r.used + d.size else r.used end from r join d on d.role = r.role and d.rn = r.rn + 1)
select k.role, k.chunk_id, case when size is null then 'missing' when ok then 'taken' else 'over_budget' end as state from k left join r on r.role = k.role and r.chunk_id = k.chunk_id""")
def role_chunks(t):
    s = t("orders").select(F.col("o_orderpriority").alias("role"), F.col("o_orderkey").alias("claim_idx"), F.array(F.col("o_custkey") * 3, F.col("o_custkey") + 1400).alias("evidence"))
    chunks = t("part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_size").alias("tokens"))
    return lk.role_chunks(s, chunks, 2000, extra=10).select("role", "chunk_id", "state")


@query(f"""with n as (select unnest(string_split(p_name, ' ')) as name, p_partkey as id from part),
x as (select name, min(id) as id from n group by name), f as (select {fm.form_sql('name')} as k, min(id) as id from n group by 1),
e as (select p_partkey, string_split(p_name, ' ')[1] as src, 'The ' || string_split(p_name, ' ')[2] || 's' as dst from part)
select p_partkey, coalesce(a.id, af.id) as src_id, coalesce(b.id, bf.id) as dst_id from e left join x a on a.name = src left join f af on af.k = {fm.form_sql('src')}
  left join x b on b.name = dst left join f bf on bf.k = {fm.form_sql('dst')}""")
def endpoint_remap(t):
    w = F.split("p_name", " ")
    names = t("part").select(F.explode(w).alias("name"), F.col("p_partkey").alias("id"))
    edges = t("part").select("p_partkey", w[0].alias("src"), F.concat(F.lit("The "), w[1], F.lit("s")).alias("dst"))
    return lk.remap(edges, ["src", "dst"], names).select("p_partkey", "src_id", "dst_id")


@query("""select 'doc:' || o_custkey as src, 'asserts' as predicate, cast(o_orderkey as varchar) as dst from orders
union all select cast(o_orderkey as varchar), 'subject', o_orderstatus from orders union all select cast(o_orderkey as varchar), 'object', o_orderpriority from orders""")
def skeleton_edges(t):
    return lk.skeleton(t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("subject"), F.col("o_orderpriority").alias("object")))


@query("""with e as (select o_orderkey as id, o_custkey as concept from orders union select o_orderkey, o_orderkey // 7 from orders)
select concept, id from e where concept in (select c_custkey from customer where c_acctbal < 0)""")
def concept_statements(t):
    s = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.floor(F.col("o_orderkey") / 7).alias("object"))
    return lk.statements_of(s, t("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("concept")))


@query("""with e as (select 's' || l_suppkey as node, l_returnflag as p, l_linestatus as s from lineitem union all select 'p' || l_partkey, l_returnflag, l_linestatus from lineitem)
select node, count(*) as degree, count(distinct p) as relations, count(distinct s) as sections from e group by node""")
def node_importance(t):
    e = t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("predicate"), F.col("l_linestatus").alias("section"))
    return lk.importance(e)


@query("""with w as (select c_custkey as node, count(*) as n from customer join orders on o_custkey = c_custkey group by 1),
e as (select least(o_custkey, l_suppkey) as a, greatest(o_custkey, l_suppkey) as b, count(*) as n from orders join lineitem on l_orderkey = o_orderkey where o_custkey <> l_suppkey group by 1, 2)
select a, b, n from e where a in (select node from w where n >= 12) and b in (select node from w where n >= 12)""")
def frequent_pairs(t):
    o = t("orders")
    e = o.join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
    w = o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return lk.frequent_pairs(e, w, 12)


@query("""with e as (select l_suppkey as node from lineitem union select l_orderkey from lineitem)
select node, 'dangling' as problem from e where node not in (select p_partkey from part)
union all select p_partkey, 'isolated' from part where p_partkey not in (select node from e)""")
def loose_ends(t):
    edges = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return lk.loose_ends(t("part").select(F.col("p_partkey").alias("node")), edges)


@query("""with n as (select distinct unnest([p_name, upper(replace(p_name, ' ', '-')), p_type || ' (' || p_brand || ')', upper(substr(p_name, 1, 1) || substr(string_split(p_name, ' ')[2], 1, 1))]) as a from part),
k as (select a, regexp_replace(lower(a), '[^a-z0-9]+', '', 'g') as k from n), f as (select k, min(a) as b from k where k <> '' group by k),
s as (select a, lower(regexp_replace(a, '[^A-Za-z0-9]', '', 'g')) as k from n where regexp_matches(regexp_replace(a, '[^A-Za-z0-9]', '', 'g'), '^[A-Z0-9]{2,6}$') and regexp_matches(a, '[A-Z]')),
l as (select a as b, array_to_string(list_transform(regexp_extract_all(a, '[A-Za-z0-9]+'), lambda w: lower(w[1:1])), '') as k from n)
select 'same_key' as kind, b as a, a as b from k join f using (k) where a <> b
union all select 'bracketed', a, null from n where regexp_matches(a, '[()]')
union all select 'acronym', a, b from s join l using (k) where upper(a) <> upper(b)""")
def residual_candidates(t):
    n = F.col("p_name")
    short = F.upper(F.concat(F.left(n, F.lit(1)), F.left(F.split(n, " ")[1], F.lit(1))))
    forms = F.array(n, F.upper(F.replace(n, F.lit(" "), F.lit("-"))), F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")")), short)
    return lk.residual_candidates(t("part").select(F.explode(forms).alias("name")))


@query("""with c as (select doc_id, seq, text[seq * 450 + 1:seq * 450 + 500] as x from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil(length(text) / 450.0) as bigint)))) as seq from documents where text is not null)),
p as (select doc_id, seq, x, lag(x) over (partition by doc_id order by seq) as y from c)
select doc_id, seq, coalesce(list_max(list_filter(range(12, 401), lambda k: k <= least(length(x), length(y)) and right(y, k) = left(x, k))), 0) as overlap from p where y is not null""")
def adjacent_overlap(t):
    d = t("documents").filter("text is not null")
    c = d.select("doc_id", F.posexplode(tx.pieces(F.col("text"), 450, 50)).alias("seq", "x")).select("doc_id", F.col("seq").cast("long").alias("seq"), "x")
    return lk.adjacent_overlap(c, "doc_id", "seq", "x").select("doc_id", "seq", F.col("overlap").cast("long").alias("overlap"))


@query("""with w as (select source as grp, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as term from documents),
o as (select grp, term from w group by all having count(*) >= 5)
select a.grp as a, b.grp as b, count(*) as shared from o a join o b on a.term = b.term and a.grp < b.grp group by 1, 2""")
def term_overlap(t):
    terms = t("documents").select(F.col("source").alias("grp"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("term"))
    return lk.term_overlap(terms, 5)


@query("""with s as (select o_orderkey as k, o_orderstatus as v from orders where o_orderpriority <> '1-URGENT'),
x as (select o_orderkey as k, case when o_totalprice > 200000 then 'X' else o_orderstatus end as v from orders where o_custkey > 100)
select k, case when s.v is null then 'missing' when x.v is null then 'extra' else 'changed' end as problem from s full join x using (k) where s.v is distinct from x.v""")
def list_changes(t):
    o = t("orders").withColumn("k", F.col("o_orderkey"))
    stored = o.filter("o_orderpriority <> '1-URGENT'").select("k", F.col("o_orderstatus").alias("v"))
    expected = o.filter("o_custkey > 100").select("k", F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return lk.list_changes(stored, expected, ["k"], ["v"])


@query("""with o as (select distinct l_suppkey as a, l_orderkey as b from lineitem)
select 'l_suppkey' as side, links, count(*) as n from (select count(*) as links from o group by a) group by links
union all select 'l_orderkey', links, count(*) from (select count(*) as links from o group by b) group by links""")
def fan_out(t):
    return lk.fan_out(t("lineitem"), "l_suppkey", "l_orderkey")


@query(r"""with l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as block, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
b as (select doc_id, block, min(pos) as pos from l where block <> '' and not starts_with(block, '#') group by 1, 2),
g as (select doc_id, pos, regexp_replace(block, '[\s\[\]（）()`*#>|·、，。：；！？"''\-]', '', 'g') as t from b),
s as (select doc_id, pos, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) as s from g where length(t) > 1),
p as (select x.doc_id, x.pos as a, y.pos as b, len(list_intersect(x.s, y.s)) as i, len(x.s) + len(y.s) as n from s x join s y on x.doc_id = y.doc_id and x.pos < y.pos)
select doc_id, a, b, round(i / (n - i), 4) as score from p where i / (n - i) >= 0.55""")
def similar_blocks(t):
    return lk.similar_blocks(t("documents"), "doc_id", "text")


@query("""with r as (select o_orderkey as community, unnest([o_custkey % 100, o_orderkey % 50]) as m from orders), d as (select distinct * from r)
select community, count(*) as cited, count(*) filter (where exists (select 1 from lineitem where l_orderkey = community and l_suppkey = m)) as own from d group by community""")
def report_alignment(t):
    text = F.concat(F.lit("first ["), F.col("o_custkey") % 100, F.lit("], then ["), F.col("o_orderkey") % 50, F.lit("]"))
    members = t("lineitem").select(F.col("l_orderkey").alias("community"), F.col("l_suppkey").cast("string").alias("member"))
    return lk.report_alignment(t("orders").select(F.col("o_orderkey").alias("community"), text.alias("text")), members)


@query("""with p as (select l_orderkey as c, case when l_linenumber <= 2 then 'core' when l_linenumber <= 5 then 'ext' else 'transparency' end as kind,
  case when l_suppkey % 3 = 0 then 'g1' when l_suppkey % 3 = 1 then 'g2' end as grp, case l_returnflag when 'A' then 'covered' when 'N' then 'covered' else case when l_linestatus = 'F' then 'equivocal' else 'not_covered' end end as v from lineitem),
r as (select o_orderkey as c, o_custkey % 3 as ext_min, o_custkey % 2 = 0 as cond from orders),
x as (select c, kind, grp, count(*) filter (where v = 'covered') as cov, count(*) filter (where v = 'not_covered') as nc, count(*) filter (where v = 'equivocal') as eq from p group by 1, 2, 3),
y as (select r.c, ext_min, cond, coalesce(sum(nc) filter (where kind = 'core'), 0) as not_covered, coalesce(sum(eq) filter (where kind <> 'transparency' or cond), 0) as equivocal,
  coalesce(sum(nc) filter (where kind = 'transparency'), 0) as hidden, count(*) filter (where kind = 'ext' and grp is not null) as groups,
  count(*) filter (where kind = 'ext' and grp is not null and cov < ext_min) as sg, coalesce(sum(cov) filter (where kind = 'ext'), 0) as cov from r left join x using (c) group by r.c, ext_min, cond),
z as (select *, case when ext_min <= 0 then 0 when groups > 0 then sg when cov < ext_min then 1 else 0 end as short from y)
select c as "case", case when not_covered > 0 or short > 0 or (cond and hidden > 0) then 'fail' when equivocal > 0 then 'pending' else 'pass' end as verdict,
  cast(not_covered as bigint) as not_covered, cast(equivocal as bigint) as equivocal, cast(short as bigint) as short from z""")
def checklist_verdicts(t):
    line, supp = F.col("l_linenumber"), F.col("l_suppkey") % 3
    value = F.when(F.col("l_returnflag") != "R", "covered").when(F.col("l_linestatus") == "F", "equivocal").otherwise("not_covered")
    points = t("lineitem").select(
        F.col("l_orderkey").alias("case"), F.when(line <= 2, "core").when(line <= 5, "ext").otherwise("transparency").alias("kind"),
        F.when(supp == 0, "g1").when(supp == 1, "g2").alias("grp"), value.alias("value"),
    )
    rules = t("orders").select(F.col("o_orderkey").alias("case"), (F.col("o_custkey") % 3).alias("ext_min"), (F.col("o_custkey") % 2 == 0).alias("conditional"))
    return jd.checklist(points, rules)


@query("""with r as (select o_custkey as c, o_orderkey % 7 as gid, arg_max(row(o_orderstatus, o_orderpriority), o_orderkey) as r from orders group by 1, 2),
g as (select c_custkey as c, unnest(range(0, 3)) as gid from customer),
s as (select g.c, case when r.r is null then '' when r.r[1] = 'P' then 'violation' else 'ok' end as x, case when r.r is null then '' when r.r[2] = '5-LOW' then 'equivocal' else 'ok' end as y from g left join r on r.c = g.c and r.gid = g.gid)
select c as "case", case when count(*) filter (where x = 'violation') > 0 then 'fail' when count(*) filter (where x <> 'ok' or y <> 'ok') > 0 then 'pending' else 'pass' end as verdict,
  count(*) filter (where x = 'violation') as violations, count(*) filter (where x <> 'violation' and (x <> 'ok' or y <> 'ok')) as undecided from s group by c""")
def claim_verdicts(t):
    groups = t("customer").select(F.col("c_custkey").alias("case"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("gid"))
    content, attribution = F.when(F.col("o_orderstatus") == "P", "violation").otherwise("ok"), F.when(F.col("o_orderpriority") == "5-LOW", "Equivocal").otherwise(" OK ")
    replies = t("orders").select(F.col("o_custkey").alias("case"), (F.col("o_orderkey") % 7).alias("gid"), F.col("o_orderkey").alias("seq"), content.alias("content"), attribution.alias("attribution"))
    return jd.claim_verdicts(groups, replies)


@query("""select source, count(*) filter (where lang in ('en', 'de') and not coalesce(toxic = 0, false)) = 0 as passed,
  array_to_string(list_sort(coalesce(list(distinct lang) filter (where lang in ('en', 'de') and not coalesce(toxic = 0, false)), [])), ',') as failed from documents left join labels using (doc_id) group by source""")
def red_line_gate(t):
    checks = t("documents").join(t("labels"), "doc_id", "left").select("source", F.col("lang").alias("key"), F.col("lang").isin("en", "de").alias("red_line"), (F.col("toxic") == 0).alias("ok"))
    return jd.red_line_gate(checks).select("source", "passed", F.array_join("failed", ",").alias("failed"))


@query("""with m as (select source, round(avg((n_chars < 4000)::int), 6) as short, round(avg(coalesce(lang = 'en', false)::int), 6) as english from documents group by source)
select source, 'short' as key, short as ratio, short >= 0.5 as ok from m union all select source, 'english', english, english <= 0.6 from m""")
def health_ratios(t):
    d = t("documents").select("source", (F.col("n_chars") < 4000).alias("short"), (F.col("lang") == "en").alias("english"))
    return jd.health_ratios(d, "source", {"short": (">=", 0.5), "english": ("<=", 0.6)})


@query("""with p as (select conv_id, turn, role, contains(text, 'e') as a, case when role = 'system' then null else contains(text, 'w') end as b from conversations),
f as (select conv_id, arg_min(row(role, b), turn) filter (where not coalesce(a, false)) as f from p group by conv_id)
select conv_id as "case", case when f is null then 'pass' else 'fail' end as sufficiency, case when f is null then 'S1' when f[2] is null then 'unknown' when f[2] then 'S2' else 'S3' end as state, f[1] as point from f""")
def failure_attribution(t):
    c = t("conversations")
    found = F.when(F.col("role") != "system", F.col("text").contains("w"))
    return jd.attribution(c.select(F.col("conv_id").alias("case"), F.col("turn").alias("pos"), F.col("role").alias("point"), F.col("text").contains("e").alias("in_context"), found.alias("in_corpus")))


@query("""with d as (select lang as expected, case when regexp_matches(text, '[äöüß]') then 'de' when regexp_matches(text, '[éèêç]') then 'fr' else 'en' end as got from documents),
c as (select expected, got, count(*) as n from d group by all) select expected, got, n, round(n / sum(n) over (partition by expected), 6) as share from c""")
def route_confusion(t):
    got = F.when(F.col("text").rlike("[äöüß]"), "de").when(F.col("text").rlike("[éèêç]"), "fr").otherwise("en")
    return jd.confusion(t("documents").select("lang", got.alias("got")), "lang", "got")


@query("""with e as (select vec_id as id, label, cast(embedding as double[]) as v from embeddings),
c as (select label, list(x order by i) as centre from (select label, i, avg(x) as x from (select label, unnest(v) as x, unnest(range(len(v))) as i from e) group by 1, 2) group by label),
s as (select id, e.label, c.label as got, round(list_cosine_similarity(v, centre), 6) as s from e, c),
r as (select *, row_number() over w as rn, lead(s) over w as next from s window w as (partition by id order by s desc, got))
select count(*) as n, count(*) filter (where label = got) as "right", round(quantile_cont(round(s - next, 6), 0.05), 6) as p5, round(quantile_cont(round(s - next, 6), 0.5), 6) as p50 from r where rn = 1""")
def router_calibration(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return jd.calibration(jd.class_margins(v, rt.centroid(v, "label")), [0.05, 0.5])


_RUNS = "with v as (select l_linenumber as run, l_orderkey as c, max(case l_returnflag when 'A' then 'fail' when 'N' then 'pass' else 'pending' end) as verdict from lineitem group by 1, 2)"


def _runs(t):
    verdict = F.when(F.col("l_returnflag") == "A", "fail").when(F.col("l_returnflag") == "N", "pass").otherwise("pending")
    return t("lineitem").select(F.col("l_linenumber").alias("run"), F.col("l_orderkey").alias("case"), verdict.alias("verdict"))


_ALL_RUNS = list(range(1, 8))


@query(_RUNS + f""" select c as "case", {", ".join(f"max(verdict) filter (where run = {r}) as run_{r}" for r in _ALL_RUNS)},
  count(distinct (case l_returnflag when 'A' then 'fail' when 'N' then 'pass' else 'pending' end)) > 1 as changed
  from v join lineitem on l_orderkey = c and l_linenumber = run group by c""")
def run_matrix(t):
    return jd.run_matrix(_runs(t), _ALL_RUNS)


@query(_RUNS + """ select x.run, count(*) as cases, count(*) filter (where x.verdict = 'pass') as passed, count(*) filter (where x.verdict = 'pass' and b.verdict <> 'pass') as gained,
  count(*) filter (where x.verdict <> 'pass' and b.verdict = 'pass') as lost, count(*) filter (where b.verdict is null) as fresh from v x left join v b on b.c = x.c and b.run = 1 group by x.run""")
def against_base(t):
    return jd.against_base(_runs(t), 1)


@query("""select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error, count(distinct event_type) <= 1 as stable from events group by user_id""")
def state_matrix(t):
    return jd.state_matrix(t("events"), "user_id", "event_type", ["click", "error"])


@query("""with g as (select distinct l_orderkey as id, o_orderpriority as s, l_partkey as item from lineitem join orders on o_orderkey = l_orderkey),
h as (select distinct l_orderkey as id, l_partkey as item, 1 as hit from lineitem where l_discount > 0.03),
e as (select id, s, avg(coalesce(hit, 0)) as r from g left join h using (id, item) group by 1, 2)
select s as stratum, count(*) as n, round(avg(r), 6) as mean_recall, round(avg((r > 0)::int), 6) as any_hit, round(avg((r >= 1)::int), 6) as all_hit from e group by s""")
def recall_by_stratum(t):
    li = t("lineitem")
    gold = li.join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("id"), F.col("o_orderpriority").alias("stratum"), F.col("l_partkey").alias("item"))
    return jd.recall_by(gold, li.filter("l_discount > 0.03").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item")), "stratum")


@query("""with recursive c as (select c_custkey as community, case when c_custkey >= 4 then c_custkey // 4 - 1 end as parent, c_nationkey % 7 as rating,
  case when c_custkey < 4 then 0 when c_custkey < 20 then 1 when c_custkey < 84 then 2 when c_custkey < 340 then 3 when c_custkey < 1364 then 4 when c_custkey < 5460 then 5 else 6 end as level from customer),
th as (select unnest([3, 4, 5]) as threshold), ok as (select threshold, c.* from th join c on rating >= threshold), op as (select threshold, min(level) as opens from ok group by 1),
r as (select ok.*, opens from ok join op using (threshold) where level = opens union all select ok.*, r.opens from r join ok on ok.threshold = r.threshold and ok.parent = r.community and ok.level = r.level + 1)
select threshold::double as threshold, level, count(*) as selected, count(*) filter (where not exists (select 1 from r x where x.threshold = r.threshold and x.parent = r.community and x.level > x.opens)) as kept from r group by 1, 2""")
def level_sweep(t):
    k = F.col("c_custkey")
    level = F.when(k < 4, 0).when(k < 20, 1).when(k < 84, 2).when(k < 340, 3).when(k < 1364, 4).when(k < 5460, 5).otherwise(6)
    reports = t("customer").select(k.alias("community"), F.when(k >= 4, F.floor(k / 4) - 1).alias("parent"), level.alias("level"), (F.col("c_nationkey") % 7).alias("rating"))
    chosen = gr.select_levels(reports, [3, 4, 5])
    return chosen.groupBy("threshold", "level").agg(F.count(F.lit(1)).alias("selected"), F.count_if("kept").alias("kept"))


@query("""with r as (select l_linenumber as run, l_orderkey as key, max(l_quantity) as value from lineitem group by 1, 2)
select a.run as run_a, b.run as run_b, count(*) as shared, round(avg((a.value = b.value)::int), 6) as exact, round(avg(abs(a.value - b.value)), 6) as mean_diff,
  round(avg(((a.value >= 30) = (b.value >= 30))::int), 6) as same_side, round(count(*) filter (where a.value >= 30 and b.value >= 30) / nullif(count(*) filter (where a.value >= 30 or b.value >= 30), 0), 6) as selection
from r a join r b on a.key = b.key and a.run < b.run group by 1, 2""")
def rating_stability(t):
    return jd.rating_stability(t("lineitem").groupBy(F.col("l_linenumber").alias("run"), F.col("l_orderkey").alias("key")).agg(F.max("l_quantity").alias("value")), 30)


@query("""select p_partkey, round(p_retailprice * (p_size + p_partkey % 9) + p_size)::bigint as predicted, round(((p_retailprice * (p_size + p_partkey % 9) + p_size) / (p_retailprice * 20) - 1) * 100, 1) as error_pct from part""")
def cost_model(t):
    price = F.col("p_retailprice")
    runs = t("part").select("p_partkey", price.alias("unit"), F.col("p_size").alias("rated"), (F.col("p_partkey") % 9).alias("kept"), F.col("p_size").alias("reduce"), (price * 20).alias("actual"))
    return jd.cost_model(runs).select("p_partkey", "predicted", "error_pct")


@query("""with l as (select lower(s_name) as r, min(s_suppkey) as x from supplier group by 1), n as (select lower(n_name) as r, min(s_suppkey) as y from supplier join nation on n_nationkey = s_nationkey group by 1),
q as (select c_custkey, lower(case when c_custkey % 2 = 0 then 'Supplier#' || lpad(cast(c_custkey as varchar), 9, '0') else n_name end) as r from customer join nation on n_nationkey = c_nationkey)
select c_custkey, coalesce(x, y) as source from q left join l using (r) left join n using (r)""")
def citation_sources(t):
    nation = t("nation")
    labels = t("supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("label"), F.col("n_name").alias("title"))
    ref = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("[Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("]"))).otherwise(F.concat(F.lit("《"), "n_name", F.lit("》")))
    refs = t("customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", ref.alias("ref"))
    return jd.source_of(refs, "ref", labels).select("c_custkey", "source")


@query("""select p_partkey from part where p_brand in ('Brand#2', 'Brand#17') and list_contains(string_split(p_name, ' '), 'ring') and contains(lower(p_type), 'o') and p_size <> 3""")
def case_selection(t):
    cases = t("part").select("p_partkey", F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.split("p_name", " ").alias("tags"), F.col("p_type").alias("title"), (F.col("p_size") != 3).alias("enabled"))
    return jd.select_cases(cases, categories=["Brand#2", "Brand#17"], tags=["ring"], keyword="O").select("p_partkey")


@query(r"""with w as (select distinct lower(w) as w from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from conversations))
select w, case when w in ('the', 'be', 'run') then w when w like '%es' and w[:-3] in ('the', 'be', 'run') then w[:-3] when w like '%s' and w[:-2] in ('the', 'be', 'run') then w[:-2]
  when w like '%ing' and w[:-4] in ('the', 'be', 'run') then w[:-4] when w like '%ing' and w[:-4] || 'e' in ('the', 'be', 'run') then w[:-4] || 'e'
  when w like '%ing' and length(w) > 5 and w[-4] = w[-5] and w[:-5] in ('the', 'be', 'run') then w[:-5]
  when w like '%ed' and w[:-3] in ('the', 'be', 'run') then w[:-3] when w like '%ed' and w[:-2] in ('the', 'be', 'run') then w[:-2] end as relation from w""")
def relation_snap(t):
    w = t("conversations").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w")).select(F.lower("w").alias("w")).distinct()
    return w.select("w", nm.snap(F.col("w"), ["the", "be", "run"]).alias("relation"))


_FOLDED = f"coalesce(nullif({fm.form_sql('q')}, ''), q)"
_LIGHT = ", ".join(f"'{w}'" for w in nm.LIGHT)


@query(rf"""with x as (select p_partkey, string_split(lower(p_name), ' ')[1] as a, string_split(lower(p_name), ' ')[2] as b, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9\-]+')) as r from part),
y as (select *, list_concat(r, list_transform(r, lambda q: {_FOLDED})) as pool, a || 's' as n, list_transform([a || 's'], lambda q: {_FOLDED})[1] as nf, list_transform([b], lambda q: {_FOLDED})[1] as bf, list_transform([a], lambda q: {_FOLDED})[1] as af from x)
select p_partkey, case when n not in ({_LIGHT}) and (list_contains(pool, n) or list_contains(pool, nf)) then 'ok' when length(n) >= 4 and len(list_filter(pool, lambda q: length(q) >= 4 and q[:4] = n[:4])) > 0 then 'derived'
  when b not in ({_LIGHT}) and (list_contains(pool, b) or list_contains(pool, bf)) then 'generalized' else 'reject' end as tier, b not in ({_LIGHT}) and b not in (a, af) and bf not in (a, af) as bleeds from y""")
def name_tiers(t):
    w = F.split("p_name", " ")
    return t("part").select("p_partkey", nm.name_tier(F.concat(w[0], F.lit("s")), F.col("p_name"), F.array(w[1])).alias("tier"), nm.bleeds(w[1], w[0], w[1]).alias("bleeds"))


@query("""select doc_id, source from documents where text is null or not (contains(lower(text), lower(source)) or contains(lower(text), 'der'))""")
def ungrounded_names(t):
    d = t("documents")
    names = d.select("doc_id", "source", F.explode(F.array("source", F.lit("der"))).alias("name"))
    lost = lk.ungrounded_names(names, d, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    return d.join(lost, "doc_id").select("doc_id", "source")
