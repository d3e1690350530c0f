"""Forms of names: keys that fold case, articles, possessives, dashes and the head's plural; anaphors; verbatim evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Leading articles.
ARTICLES = ("the", "a", "an")
#: Singulars, acronyms and mass nouns that end in s; nouns of one form in both numbers; plurals that are nouns of their own.
NEVER_FOLDED = (
    "https", "tls", "dns", "cms", "aws", "ios", "devops", "mlops",
    "news", "series", "species", "bus", "gas", "alias", "atlas", "canvas", "chaos",
    "analysis", "basis", "crisis", "thesis", "hypothesis", "axis", "emphasis",
    "synthesis", "diagnosis",
    "means", "species", "series", "sheep", "deer", "fish", "aircraft", "spacecraft",
    "hovercraft", "offspring", "salmon", "trout", "swine", "bison", "moose",
    "barracks", "crossroads", "headquarters", "gallows", "innings",
    "customs", "works", "premises", "ethics", "politics", "economics",
    "physics", "mathematics", "statistics", "mechanics",
)
#: Plurals that no rule finds, and their singulars.
IRREGULAR = {
    "children": "child", "people": "person", "men": "man", "women": "woman",
    "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse",
    "indices": "index", "matrices": "matrix", "vertices": "vertex",
    "appendices": "appendix", "analyses": "analysis", "theses": "thesis",
    "hypotheses": "hypothesis", "crises": "crisis", "axes": "axis",
    "diagnoses": "diagnosis", "parentheses": "parenthesis", "ellipses": "ellipsis",
    "criteria": "criterion", "phenomena": "phenomenon",
    "curricula": "curriculum", "formulae": "formula", "formulas": "formula",
    "cacti": "cactus", "fungi": "fungus", "nuclei": "nucleus", "radii": "radius",
    "stimuli": "stimulus", "syllabi": "syllabus", "alumni": "alumnus",
    "antennae": "antenna", "larvae": "larva", "vertebrae": "vertebra",
    "genera": "genus", "corpora": "corpus", "spectra": "spectrum",
    "memoranda": "memorandum", "strata": "stratum", "codices": "codex",
}
#: Words that can stand for something named before.
ANAPHORS = ("this", "that", "these", "those", "such", "it", "they", "them", "there")
#: Words after an anaphor that make a clause of it.
CLAUSE_WORDS = (
    "that", "which", "who", "is", "are", "was", "were", "be", "been", "being", "can", "could",
    "would", "should", "will", "might", "may", "has", "have", "had",
)


def _text(name: Column) -> Column:
    return F.coalesce(name, F.lit(""))


def words_of(name: Column) -> Column:
    """The name's words before folding, single-spaced: quotes, possessives and leading articles gone, dashes and slashes apart, lower case."""
    plain = F.translate(_text(name), "‘’“”", "''\"\"")
    bare = F.regexp_replace(F.regexp_replace(plain, r"(?i)'s\b", ""), "'", "")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[‐-―\-_/]", " "), r"\s+", " "))
    # Possessive: taken back one by one, as many articles as a text may begin with would overflow the stack.
    return F.trim(F.regexp_replace(F.lower(spaced), rf"^(?:(?:{'|'.join(ARTICLES)})(?: |$))++", ""))


def singular(word: Column) -> Column:
    """The singular of a lower-case word by table, then by ending; a word in doubt stays."""
    table = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    less = lambda n, tail="": F.concat(F.left(word, F.length(word) - n), F.lit(tail))
    by_ending = (
        F.when((F.length(word) <= 2) | word.isin(*NEVER_FOLDED), word)
        .when(word.endswith("ies"), less(3, "y"))
        .when(word.endswith("ss") | word.endswith("us"), word)
        .when(word.rlike("(ss|x|z|ch|sh)es$"), less(2))
        .when(word.endswith("s"), less(1))
        .otherwise(word)
    )
    return F.coalesce(F.try_element_at(table, word), by_ending)


def _head(words: Column) -> Column:
    return F.regexp_extract(words, r"(\S+)$", 1)


def _folded_head(name: Column, head: Column) -> Column:
    """The last word's singular; paths, acronyms and words of more than letters stay as they are."""
    raw_head = F.regexp_replace(F.element_at(F.split(F.trim(_text(name)), r"[\s/\\_‐-―\-]+"), -1), "^['’]+|['’]+$", "")
    acronym = (F.length(raw_head) >= 2) & raw_head.rlike(r"\p{Lu}") & ~raw_head.rlike(r"\p{Ll}")
    return F.when(_text(name).rlike(r"[/\\~]") | acronym | head.rlike("[^a-z]"), head).otherwise(singular(head))


def form_key(name: Column) -> Column:
    """Names of one form share it; empty for a name without words."""
    return let(words_of(name), lambda w: F.concat(F.regexp_replace(w, r"\S+$", ""), let(_head(w), lambda h: _folded_head(name, h))))


def is_plural(name: Column) -> Column:
    """Whether folding changes the name's head."""
    return let(_head(words_of(name)), lambda h: _folded_head(name, h) != h)


def alnum(name: Column) -> Column:
    return F.regexp_replace(F.lower(_text(name)), "[^a-z0-9]+", "")


def other_numbers(name: Column) -> Column:
    """Letters and digits that the name could have in the other number; generous, for audits."""
    w = alnum(name)
    table = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    irregular = F.try_element_at(table, w)
    less = lambda n, tail="": F.concat(F.left(w, F.length(w) - n), F.lit(tail))
    forms = F.array(
        F.concat(w, F.lit("s")),
        F.concat(w, F.lit("es")),
        F.when(w.endswith("y"), less(1, "ies")),
        F.when((F.length(w) > 2) & w.endswith("s"), less(1)),
        F.when((F.length(w) > 2) & w.endswith("s"), less(2)),
        F.when((F.length(w) > 3) & w.endswith("ies"), less(3, "y")),
        irregular,
        F.concat(irregular, F.lit("s")),
    )
    return F.when(w == "", F.array().cast("array<string>")).otherwise(F.filter(F.array_distinct(F.array_compact(forms)), lambda f: (f != "") & (f != w)))


def anaphor(text: Column) -> Column:
    """STRUCT<kind, word> of a value that begins with an anaphor, else null.

    bare: nothing else; phrase: up to five words without a clause after it;
    embedded: anything longer.
    """
    t = F.trim(_text(text))
    word = F.regexp_extract(F.lower(t), rf"^({'|'.join(ANAPHORS)})\b", 1)
    n = F.size(F.split(t, r"\s+"))
    clause = F.lower(F.substring(t, F.length(word) + 1, F.length(t))).rlike(rf"\b({'|'.join(CLAUSE_WORDS)})\b")
    kind = F.when(n == 1, "bare").when((n <= 5) & ~clause, "phrase").otherwise("embedded")
    return F.when(word != "", F.struct(kind.alias("kind"), word.alias("word")))


def evidence_words(text: Column) -> Column:
    """Words of letters, digits and apostrophes, lower case, curly quotes made straight."""
    return F.regexp_extract_all(F.lower(F.translate(_text(text), "‘’", "''")), F.lit("([a-z0-9']+)"), 1)


def is_verbatim(evidence: Column, window: Column, least: int = 4) -> Column:
    """Whether evidence of ``least`` words or more stands in the window, in order, words between left out at will."""
    def found(wanted: Column) -> Column:
        step = lambda at, w: F.when((at < F.size(wanted)) & (F.try_element_at(wanted, at + 1) == w), at + 1).otherwise(at)
        return (F.size(wanted) >= least) & (F.aggregate(evidence_words(window), F.lit(0), step) == F.size(wanted))

    return let(evidence_words(evidence), found)


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text, braces inside strings not counted; null if there is none.

    A fold over the text's strings, escapes and braces; the rest of the text is skipped over.
    """
    body = F.substring(text, F.instr(text, "{"), F.length(text))
    pieces = F.regexp_extract_all(body, F.lit(r'((?s)"(?:[^"\\]|\\.)*"|[{}]|[^"{}]+|")'), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    step = lambda s, p: F.struct(
        (s["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)).alias("depth"),
        (s["at"] + F.length(p)).alias("at"),
        F.when((s["end"] == 0) & (p == "}") & (s["depth"] == 1), s["at"] + 1).otherwise(s["end"]).alias("end"),
    )
    end = F.aggregate(pieces, start, step, lambda s: s["end"])
    return F.when((F.instr(text, "{") > 0) & (end > 0), F.left(body, end))


def values_of(json: Column, key: str, length: int | None = None) -> Column:
    """Distinct string values of a key at any depth of a JSON text, escapes undone, sorted; only those of the given length, if one is given."""
    raw = F.regexp_extract_all(_text(json), F.lit(rf'"{key}"\s*:\s*("(?:[^"\\]|\\.)*")'), 1)
    plain = F.from_json(F.concat(F.lit("["), F.array_join(raw, ","), F.lit("]")), "array<string>")
    found = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(plain, F.array().cast("array<string>")))))
    return found if length is None else F.filter(found, lambda v: F.length(v) == length)


def phrase_hits(text: Column, phrases: dict[str, list[str]]) -> Column:
    """STRUCT<group, hits>: phrases found, the longest first, each used up so that no shorter one finds it again; null without hits."""
    ordered = sorted(((g, p) for g, ps in phrases.items() for p in ps), key=lambda x: -len(x[1]))
    all_ = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(p).alias("p")) for g, p in ordered])
    start = F.struct(_text(text).alias("rest"), F.lit(None).cast("string").alias("group"), F.array().cast("array<string>").alias("hits"))
    step = lambda s, x: F.when(
        F.contains(s["rest"], x["p"]),
        F.struct(F.replace(s["rest"], x["p"], F.lit("\x01")).alias("rest"), F.coalesce(s["group"], x["g"]).alias("group"), F.concat(s["hits"], F.array(x["p"])).alias("hits")),
    ).otherwise(s)
    return F.aggregate(all_, start, step, lambda s: F.when(s["group"].isNotNull(), F.struct(s["group"].alias("group"), s["hits"].alias("hits"))))


def leaf_title(path: Column) -> Column:
    """The last step of a heading path of two steps or more."""
    leaf = F.trim(F.element_at(F.split(F.trim(_text(path)), " / "), -1))
    return F.when(F.trim(_text(path)).contains(" / ") & (leaf != ""), leaf)


def fragments(prompt: Column, least: int = 12) -> Column:
    """Trimmed lines of a prompt long enough to tell that it leaked."""
    return F.filter(F.transform(F.split(_text(prompt), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


# The same keys in SQL, from the same tables.

def words_sql(x: str) -> str:
    plain = f"translate(coalesce({x}, ''), '‘’“”', '''''\"\"')"
    bare = f"regexp_replace(regexp_replace({plain}, '(?i)''s\\b', '', 'g'), '''', '', 'g')"
    return f"trim(regexp_replace(lower(trim(regexp_replace(regexp_replace({bare}, '[‐-―\\-_/]', ' ', 'g'), '\\s+', ' ', 'g'))), '^(?:(?:{'|'.join(ARTICLES)})(?: |$))+', ''))"


def singular_sql(w: str) -> str:
    cases = " ".join(f"when {w} = '{a}' then '{b}'" for a, b in IRREGULAR.items())
    kept = ", ".join(f"'{x}'" for x in NEVER_FOLDED)
    return (
        f"case {cases} when length({w}) <= 2 or {w} in ({kept}) then {w} when {w} like '%ies' then {w}[:-4] || 'y' when {w} like '%ss' or {w} like '%us' then {w} "
        f"when regexp_matches({w}, '(ss|x|z|ch|sh)es$') then {w}[:-3] when {w} like '%s' then {w}[:-2] else {w} end"
    )


def _folded_sql(x: str, head: str) -> str:
    raw = f"regexp_replace(list_last(regexp_split_to_array(trim(coalesce({x}, '')), '[\\s/\\\\_‐-―\\-]+')), '^[''’]+|[''’]+$', '', 'g')"
    acronym = f"(length({raw}) >= 2 and regexp_matches({raw}, '\\p{{Lu}}') and not regexp_matches({raw}, '\\p{{Ll}}'))"
    return f"case when regexp_matches(coalesce({x}, ''), '[/\\\\~]') or {acronym} or regexp_matches({head}, '[^a-z]') then {head} else {singular_sql(head)} end"


def form_sql(x: str) -> str:
    head = f"list_transform([regexp_extract(w, '([^ ]+)$', 1)], lambda h: {_folded_sql(x, 'h')})[1]"
    return f"list_transform([{words_sql(x)}], lambda w: regexp_replace(w, '[^ ]+$', '') || {head})[1]"


def plural_sql(x: str) -> str:
    return f"list_transform([regexp_extract({words_sql(x)}, '([^ ]+)$', 1)], lambda h: {_folded_sql(x, 'h')} <> h)[1]"
