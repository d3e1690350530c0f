"""Registered queries on answers, replies, streams under guards, sentences and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import forms as fm
from .functions import replies
from .functions import text as tx
from .operators import cite, cited
from .operators import compile as cp
from .operators import ingest as ig
from .operators import judge as jd
from .registry import query
from .streaming import guards

#: Characters that have a meaning of their own in answers: quotes, ends of sentences, cells and markers.
_OWN = "'\"“”「」『』!?。！？|[]"
_OWN_SQL = "''\"“”「」『』!?。！？|[]"


@query(rf"""with l as (select doc_id, unnest(string_split(translate(text, '{_OWN_SQL}', ''), chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents),
c as (select doc_id, i, trim(trim(line || '[' || (i + 1) || '][' || (i + 2) || ']', ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ' ' || chr(9) || '，、；：:。') as claim from l
  where not regexp_full_match(trim(line), '\|?[\s|]*:?-{{2,}}:?(?:\s*\|\s*(?::?-{{2,}}:?)?)*\s*'))
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as seq, claim, '[' || (i + 1) || '],[' || (i + 2) || ']' as refs, 'block' as note
from c where regexp_matches(claim, '[一-鿿A-Za-z]')""")
def cited_lines(t):
    """Every line of every document as a statement with two markers behind it."""
    lines = F.split(F.translate("text", _OWN, ""), "\n")
    mark = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    answer = F.array_join(F.transform(lines, lambda x, i: F.concat(x, mark(i + 1), mark(i + 2))), "\n")
    claims = cited.cited_claims(t("documents"), "doc_id", answer)
    return claims.select("doc_id", "seq", "claim", F.array_join("refs", ",").alias("refs"), "note")


@query("""with d as (select conv_id, turn, coalesce(text, '') as text, string_agg(coalesce(text, ''), '' order by turn) over (partition by conv_id order by turn) as upto from conversations where role = 'assistant'),
h as (select *, instr(upto, ' the ') as a, instr(upto, ' and ') as b, length(upto) - length(text) as before from d),
f as (select conv_id, min(turn) as t from h where a > 0 or b > 0 group by 1)
select h.conv_id, case when h.turn is distinct from f.t then h.text when a > 0 then '' else substr(h.text, 1, greatest(0, b - 1 - before)) end as passed,
       case when h.turn = f.t then case when a > 0 then 'leak' else 'words' end end as guard, case when h.turn = f.t then case when a > 0 then 'prompt' else 'word' end end as kind,
       case when h.turn = f.t then case when a > 0 then ' the ' else ' and ' end end as fragment
from h left join f on f.conv_id = h.conv_id where f.t is null or h.turn <= f.t""")
def guarded_turns(t):
    standing = [guards.Guard("leak", (("prompt", " the "),), keeps=False), guards.Guard("words", (("word", " and "),))]
    return guards.guarded(t("conversations").filter("role = 'assistant'"), "conv_id", "turn", "text", standing)


def _masked_sql(x: str) -> str:
    for one in tx.TWO_STOPS:
        a, b = one.split(".")
        x = rf"regexp_replace({x}, '(?i)(^|[^\p{{L}}\p{{N}}])({a})\.({b})\.', '\1\2' || chr(1) || '\3' || chr(1), 'g')"
    x = rf"regexp_replace({x}, '(?i)(^|[^\p{{L}}\p{{N}}])({'|'.join(tx.ONE_STOP)})\.', '\1\2' || chr(1), 'g')"
    return rf"regexp_replace({x}, '([0-9])\.', '\1' || chr(1), 'g')"


_WHITE = r"[ \t\n\r\f]*"


@query(rf"""with p as (select doc_id, unnest(parts) as raw, unnest(range(len(parts))) as i from (select doc_id, regexp_extract_all({_masked_sql("text")}, '[^.!?…\n]*[.!?…\n]+|[^.!?…\n]+') as parts from documents)),
s as (select *, sum(length(raw)) over (partition by doc_id order by i) - length(raw) + length(raw) - length(regexp_replace(raw, '^{_WHITE}', '')) as start,
             translate(regexp_replace(raw, '^{_WHITE}|{_WHITE}$', '', 'g'), chr(1), '.') as text from p)
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as n, cast(start as integer) as start, cast(start + length(text) as integer) as "end", text from s where text <> ''""")
def sentence_bounds(t):
    return cite.sentence_bounds(t("documents"))


_SAID = r"""regexp_replace(coalesce(text, ''), '["\\\x00-\x1f]', ' ', 'g')"""


@query(rf"""with c as (select conv_id, turn, turn % 5 as way, {_SAID} as said from conversations)
select conv_id, turn, case way when 2 then '{{"id":' || turn || ',"said":"' || said || '\nmore"}}' when 3 then '[{{"id":' || turn || ',"said":"' || said || '"}}]'
  when 4 then '{{"id":' || turn || ',"said":"' || said || '","refs":["a","b"]}}' else '{{"id":' || turn || ',"said":"' || said || '"}}' end as json,
  case way when 0 then '' when 1 then 'fence' when 2 then 'before,control,comma,after' when 3 then '' else 'cut' end as repairs from c""")
def repaired_replies(t):
    """Replies broken by rule from the turns: fenced, with raw line ends and more text around, a bare array, cut off."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\\x00-\x1f]', " ")
    body = F.concat(F.lit('{"id": '), F.col("turn").cast("string"), F.lit(', "said": "'), said)
    way = F.col("turn") % 5
    reply = (
        F.when(way == 0, F.concat(body, F.lit('"}')))
        .when(way == 1, F.concat(F.lit("```json\n"), body, F.lit('"}\n```')))
        .when(way == 2, F.concat(F.lit("Sure: "), body, F.lit('\nmore",} and so on')))
        .when(way == 3, F.concat(F.lit("["), body, F.lit('"}]')))
        .otherwise(F.concat(body, F.lit('", "refs": ["a", "b')))
    )
    return t("conversations").select("conv_id", "turn", replies.repaired(reply).alias("r")).select("conv_id", "turn", "r.json", F.array_join("r.repairs", ",").alias("repairs"))


@query("""with n as (select distinct name from (select p_type as name from part union all select p_name from part union all select p_name || ' ' || p_brand from part union all select p_name || ' ' || p_type || ' ' || p_brand from part)),
s as (select name, list_distinct(string_split(name, ' ')) as s from n)
select a.name as small, b.name as big from s a join s b on len(a.s) <= 2 and len(b.s) > len(a.s) and list_has_all(b.s, a.s)""")
def name_subsets(t):
    p = t("part")
    names = [F.col("p_type"), F.col("p_name"), F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_name", "p_type", "p_brand")]
    each = p.select(F.explode(F.array(*names)).alias("id")).distinct()
    return cp.name_subsets(each.select("id", F.split("id", " ").alias("tokens")))


_ENTITIES = """e as (select p_name as name, case when p_size % 3 = 0 then null else p_type end as type, p_partkey as place, [p_brand, ' '] as given from part
  union all select 'The ' || p_name || 's', p_brand, p_partkey + 1000000000, null from part union all select p_type, null, p_partkey, [p_type] from part)"""


@query(f"""with {_ENTITIES}, w as (select name, count(*) as n, {fm.form_sql("name")} as key, {fm.plural_sql("name")} as plural from e group by name),
r as (select *, row_number() over (partition by key order by -n, plural, length(name), length(name) - length(replace(name, chr(39), '')), length(replace(name, '-', '')) - length(name), name) as place from w),
k as (select key, max(case when place = 1 then name end) as canonical, count(*) as variants, sum(n) as mentions from r group by key),
m as (select e.*, key from e join w using (name)),
own as (select name, arg_min(type, place) as own from m where type is not null group by 1),
common as (select key, arg_min(type, row(-n, type)) as common from (select key, type, count(*) as n from m where type is not null group by 1, 2) group by 1),
a as (select key, trim(unnest(given)) as alias from m union select key, name from m)
select k.key, canonical, coalesce(own, common, 'concept') as type, coalesce(array_to_string(list_sort(list(distinct a.alias) filter (where a.alias <> canonical and a.alias <> '')), ','), '') as aliases, variants, mentions
from k left join own on own.name = k.canonical left join common on common.key = k.key left join a on a.key = k.key group by all""")
def merged_entities(t):
    p = t("part")
    none = F.lit(None).cast("string")
    rows = (
        p.select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("type"), F.col("p_partkey").alias("place"), F.array("p_brand", F.lit(" ")).alias("aliases"))
        .unionByName(p.select(F.concat(F.lit("The "), "p_name", F.lit("s")).alias("name"), F.col("p_brand").alias("type"), (F.col("p_partkey") + 1_000_000_000).alias("place"), F.lit(None).cast("array<string>").alias("aliases")))
        .unionByName(p.select(F.col("p_type").alias("name"), none.alias("type"), F.col("p_partkey").alias("place"), F.array("p_type").alias("aliases")))
    )
    out = cp.merged_entities(rows, "place")
    return out.select("key", "canonical", "type", F.coalesce(F.array_join("aliases", ","), F.lit("")).alias("aliases"), "variants", F.col("mentions").cast("decimal(38,0)").alias("mentions"))


@query("""with p as (select *, p_partkey % 9 as k, split_part(p_name, ' ', 2) as w from part)
select p_partkey, case when k in (6, 7, 8) then 'edge' else 'skipped' end as status,
  case k when 0 then 'predicate_pending' when 1 then 'no_subject' when 2 then 'subject_unusable' when 3 then 'subject_no_concept' when 4 then 'subject_made_up' when 5 then 'same_ends' else '' end as reason,
  case k when 6 then p_type when 7 then w when 8 then w end as src, case k when 6 then 'creates' when 7 then 'is' when 8 then 'is' end as predicate,
  case k when 6 then w when 7 then '' when 8 then p_type end as dst, case when k in (6, 7, 8) then k = 6 end as flipped from p""")
def edge_reasons(t):
    """Part names as claims, broken by rule: each reason why a claim makes no edge, and passive, unary and plain edges."""
    k, word = F.col("p_partkey") % 9, F.split("p_name", " ")[1]
    none = F.lit(None)
    claims = t("part").select(
        "p_partkey",
        F.when(k == 1, " ").when(k == 2, "it").otherwise(F.col("p_name")).alias("subject"),
        F.when(k == 7, none).when(k == 5, F.col("p_name")).otherwise(F.col("p_type")).alias("object"),
        F.when(k == 6, "was written by").otherwise("is").alias("predicate"),
        F.when(k == 0, "pending").alias("predicate_status"),
        F.when(k == 6, "creates").alias("predicate_normalized"),
        *[none.cast("string").alias(f"{end}_{c}") for end in ("subject", "object") for c in ("status", "resolved")],
        F.when(k == 3, none).when(k == 4, "zzqq").otherwise(word).alias("subject_concept"),
        F.when(k == 5, word).otherwise(F.col("p_type")).alias("object_concept"),
        *[none.cast("array<string>").alias(c) for c in ("subject_sources", "object_sources", "known_names")],
    )
    return cp.edge_audit(claims, "p_partkey").select("p_partkey", "status", "reason", "src", "predicate", "dst", "flipped")


@query("""with e as (select vec_id as id, label, cast(embedding as double[]) as v from embeddings),
p as (select a.id, a.label, b.label = a.label as own, list_cosine_similarity(a.v, b.v) as s from e a join e b on a.id <> b.id)
select id, label, round(max(s) filter (where own), 6) as own, round(max(s) filter (where not own), 6) as other from p group by 1, 2""")
def router_left_out(t):
    return jd.nearest_left_out(t("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")))


@query("""with q as (select item_id, string_split(text, ' ')[2] as quote from benchmark)
select item_id, doc_id, instr(text, quote) - 1 as start, instr(text, quote) - 1 + length(quote) as "end" from q join documents on quote <> '' and contains(text, quote)""")
def short_quotes(t):
    """Quotes of one word, found anywhere in a text."""
    quotes = t("benchmark").select("item_id", F.split("text", " ")[1].alias("quote"))
    return ig.locate(quotes, t("documents"))


@query(r"""with p as (select doc_id, unnest(regexp_split_to_array(replace(translate(text, '<>&', '   '), chr(10), chr(10) || chr(10)), '\n\s*\n')) as part from documents)
select doc_id, '引言' as path, count(*) as paragraphs, cast(sum(length(part)) as bigint) as chars from (select doc_id, trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as part from p) where part <> '' group by 1""")
def bare_pages(t):
    """Pages of nothing but text between blank lines."""
    html = F.concat(F.lit("<b>"), F.replace(F.translate("text", "<>&", "   "), F.lit("\n"), F.lit("\n\n")), F.lit("</b>"))
    sections = ig.sections(t("documents").select("doc_id", html.alias("html")), "doc_id", "html").select("doc_id", F.explode("sections").alias("s"))
    size = F.aggregate("s.paragraphs", F.lit(0).cast("long"), lambda n, p: n + F.length(p))
    return sections.select("doc_id", "s.path", F.size("s.paragraphs").cast("long").alias("paragraphs"), size.alias("chars"))
