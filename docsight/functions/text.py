"""Text expressions: everything stays inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Words without content in mixed text.
STOPWORDS = (
    "的", "了", "和", "与", "是", "在", "上", "下", "中", "这", "那", "我们", "你们", "它们", "一个", "什么", "怎么",
    "为什么", "如何", "吗", "呢", "吧", "啊",
)
_RUN = r"([a-z0-9]++(?:[._-][a-z0-9]++)*+)"  # possessive: a long run would overflow the stack
_OTHER = r"([\p{L}\p{M}\p{N}&&[^a-z0-9]]+)"


def ascii_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; single dots, dashes and underscores inside belong to a run."""
    return F.regexp_extract_all(F.lower(text), F.lit(_RUN), 1)


def long_tokens(text: Column) -> Column:
    return F.filter(ascii_tokens(text), lambda t: F.length(t) >= 2)


def mixed_tokens(text: Column) -> Column:
    """ASCII runs of two characters or more, then the bigrams of each run of other letters; no stopwords.

    Scripts without spaces have no words to split at, so neighbouring
    characters stand for them: what is found by a word is found by its bigrams.
    """
    others = F.flatten(
        F.transform(
            F.regexp_extract_all(F.lower(text), F.lit(_OTHER), 1),
            lambda run: F.when(F.length(run) >= 2, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>")),
        )
    )
    return F.filter(F.concat(long_tokens(text), others), lambda t: ~t.isin(*STOPWORDS))


def normalized(text: Column) -> Column:
    """Curly quotes, dashes and no-break spaces folded, white space single, trimmed; offsets are not kept."""
    folded = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences ending in . ! or ? before white space and a capital, digit or quote, or at CJK enders."""
    return F.filter(F.split(text, r"(?<=[。！？])|(?<=[.!?])\s+(?=[A-Z0-9\"'])"), lambda s: F.trim(s) != "")


# Abbreviations whose full stops end no sentence, those with two stops and those with one.
TWO_STOPS = ("e.g", "i.e", "u.s", "a.m", "p.m")
ONE_STOP = ("etc", "vs", "mr", "mrs", "ms", "dr", "st", "no", "fig", "al", "cf", "approx")
#: Stands for a full stop that ends no sentence.
MASKED = "\x01"
#: A sentence with the marks and line ends behind it.
PIECE = r"([^.!?…\n]*[.!?…\n]+|[^.!?…\n]+)"


def masked(text: Column) -> Column:
    """The text with the full stops of abbreviations and those behind digits masked, each by one character.

    Abbreviations are whole words in any case.
    """
    for one in TWO_STOPS:
        a, b = one.split(".")
        text = F.regexp_replace(text, rf"(?i)(^|[^\p{{L}}\p{{N}}])({a})\.({b})\.", f"$1$2{MASKED}$3{MASKED}")
    text = F.regexp_replace(text, rf"(?i)(^|[^\p{{L}}\p{{N}}])({'|'.join(ONE_STOP)})\.", f"$1$2{MASKED}")
    return F.regexp_replace(text, r"([0-9])\.", f"$1{MASKED}")


def rounded(x: Column, places: int) -> Column:
    """A double rounded to decimal places as the product with 10 ** places says, halves away from zero.

    ``F.round`` looks at the shortest decimal digits instead, which lie on the
    other side of a half where the product comes out as one.
    """
    return F.round(x * F.lit(10.0**places)) / F.lit(10.0**places)


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays as sets; 0 for two empty ones."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def is_proper_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_distinct(a)) < F.size(F.array_distinct(b)))


def initials(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"([\p{L}]+)"), 1), lambda w: F.left(w, F.lit(1))), ""))


def is_acronym_of(short: Column, long: Column) -> Column:
    """Two to six capitals that are the initials of the other name."""
    return short.rlike("^[A-Z]{2,6}$") & (initials(long) == short)


def is_subsequence(part: Column, whole: Column) -> Column:
    """Whether an array's items occur in another's in the same order, others between allowed."""
    start = F.lit(0)
    end = F.aggregate(
        part,
        start,
        lambda at, x: F.when(at < 0, F.lit(-1)).otherwise(
            F.when(F.array_position(F.slice(whole, at + 1, F.greatest(F.size(whole), F.lit(1))), x) > 0, at + F.array_position(F.slice(whole, at + 1, F.greatest(F.size(whole), F.lit(1))), x).cast("int")).otherwise(F.lit(-1))
        ),
    )
    return end >= 0


def qa_normalized(text: Column) -> Column:
    """Answers compared without case, tags, links, punctuation and English articles."""
    plain = F.regexp_replace(F.lower(text), r"<[^>]*>|https?://\S+", " ")
    words = F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin("", "a", "an", "the")), " ")


def token_estimate(text: Column, known: Column | None = None) -> Column:
    """Half the characters, halves to even, 1 at least; a known count goes first."""
    guess = F.greatest(F.lit(1), F.bround(F.length(text) / 2).cast("int"))
    return guess if known is None else F.coalesce(known, guess)


#: Words that name nothing, and those that open a clause.
PRONOUNS = ("this", "that", "these", "those", "such", "it", "they", "them", "there", "we", "our", "us")
CLAUSE_OPENERS = ("how to", "whether", "when", "why", "that", "which", "who", "what")
MOST_NAME_WORDS = 6


def is_pronoun(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^[ .]+|[ .]+$", "").isin(*PRONOUNS)


def is_nameable(name: Column) -> Column:
    """STRUCT<ok, why>: non-empty, no pronoun, no clause, six words at most, with a Latin letter."""
    n = F.trim(F.coalesce(name, F.lit("")))
    why = (
        F.when(n == "", "empty")
        .when(is_pronoun(n), "pronoun")
        .when(F.lower(n).rlike(rf"^[ .]*({'|'.join(CLAUSE_OPENERS)})\b"), "clause")
        .when(F.size(F.split(n, r"\s+")) > MOST_NAME_WORDS, "long")
        .when(~n.rlike("[A-Za-z]"), "no letter")
    )
    return F.struct(why.isNull().alias("ok"), F.coalesce(why, F.lit("")).alias("why"))


#: What makes a predicate need cleaning: words that join, open a clause, negate or colour it.
JOINING = ("and", "or")
CLAUSE_MARKS = ("when", "until", "regardless", "that", "because", "whether", "while", "if", "so that", "in order to")
NEGATIONS = ("not", "never", "cannot")
MODALS = ("can", "could", "may", "might", "should", "must", "will", "would")


def has_words(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words or phrases stands in a text, whatever the case and spaces."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+", " "), F.lit(" "))
    return spaced.rlike(f" (?:{'|'.join(map(re.escape, words))}) ")  # one pass: inside a lambda the text would be spaced out for each word


def is_negated(text: Column) -> Column:
    return has_words(text, NEGATIONS) | F.lower(F.coalesce(text, F.lit(""))).rlike(r"n't\b")


def needs_cleaning(predicate: Column) -> Column:
    """Four words or more, a joining word, a clause, a negation or a modal."""
    p = F.coalesce(predicate, F.lit(""))
    return (F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= 4) | has_words(p, JOINING + CLAUSE_MARKS + MODALS) | is_negated(p)


def paragraph_index(text: Column, at: Column) -> Column:
    """Number of line ends before a 0-based position."""
    return F.length(F.substring(text, F.lit(1), at)) - F.length(F.replace(F.substring(text, F.lit(1), at), F.lit("\n"), F.lit("")))


def tolerant_json(text: Column, schema: str) -> Column:
    """Parse the outermost object of a reply: code fences, text around it and trailing commas are dropped."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.regexp_replace(body, r",\s*([}\]])", "$1"), schema)


def contained(quote: Column, pool: Column) -> Column:
    """A reply's quote is verbatim if some text of the pool holds it or is held by it."""
    return F.coalesce((F.length(quote) > 0) & F.exists(pool, lambda p: p.contains(quote) | quote.contains(p)), F.lit(False))


def pieces(text: Column, size: int, more: int) -> Column:
    """Pieces of a text, ``size`` characters apart, each with the ``more`` characters that follow it: what stands in a text is found piecewise."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size + more)))
