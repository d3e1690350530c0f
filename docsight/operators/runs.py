"""Runs and their reports: routes, verdicts, comparisons of runs, communities and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms as fm


def decide_route(texts: DataFrame, phrases: dict[str, list[str]], replies: DataFrame, routes: dict[str, str], default: str = "vector") -> DataFrame:
    """``texts`` (id, text) with group, route, decided_by, evidence, degraded and needs_review.

    Phrases come first, then the reply (id, need, reason, error) of a judge,
    then the default.  A reply may fail or name no known need: the route then
    falls back, and is marked.  ``routes`` gives each group's route.
    """
    route_of = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    hits = fm.phrase_hits(F.col("text"), phrases)
    told = replies.groupBy("id").agg(F.max(F.struct("need", "reason", "error")).alias("__reply"))
    both = texts.withColumn("__hits", hits).join(told, "id", "left")
    by_phrase, reply = F.col("__hits").isNotNull(), F.col("__reply")
    known = reply["error"].isNull() & F.coalesce(reply["need"].isin(*routes), F.lit(False))
    degraded = F.when(by_phrase | known, F.lit(None)).when(reply.isNull(), "unavailable").when(reply["error"].isNotNull(), F.concat(F.lit("error:"), reply["error"])).otherwise("unsure")
    group = F.when(by_phrase, F.col("__hits.group")).when(known, reply["need"])
    return both.select(
        "id",
        group.alias("group"),
        F.coalesce(F.try_element_at(route_of, group), F.lit(default)).alias("route"),
        F.when(by_phrase, "lexicon").when(known, "reply").otherwise("default").alias("decided_by"),
        F.when(by_phrase, F.array_join("__hits.hits", " / ")).when(known, reply["reason"]).otherwise(degraded).alias("evidence"),
        degraded.alias("degraded"),
        F.coalesce((degraded == "unsure") | degraded.startswith("error:"), F.lit(False)).alias("needs_review"),
    )


def rerank(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the hits (query_id, id) in the order of their pair scores (query_id, id, score); unscored ones last."""
    scored = hits.join(scores, ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def judged(criteria: DataFrame, replies: DataFrame) -> DataFrame:
    """``criteria`` (case, criterion, by) with state and reason: a model's reply (case, criterion, verdict, reason) where one is asked for.

    Machine criteria are not of this step; a missing, empty or unknown reply
    leaves a criterion pending, with the reason why.
    """
    told = replies.groupBy("case", "criterion").agg(F.max(F.struct("verdict", "reason")).alias("__r"))
    both = criteria.filter("by = 'model'").join(told, ["case", "criterion"], "left")
    verdict = F.lower(F.trim("__r.verdict"))
    state = F.when(verdict.isin("pass", "fail"), verdict).otherwise("pending")
    why = F.when(F.col("__r").isNull(), "no reply").when(F.coalesce(verdict, F.lit("")) == "", "empty reply").when(state == "pending", "unknown verdict").otherwise(F.col("__r.reason"))
    return both.select("case", "criterion", state.alias("state"), why.alias("reason"))


def rejudge(verdicts: DataFrame) -> DataFrame:
    """(case, criterion, times, majority, agreement, stable) of repeated verdicts (case, criterion, verdict); a tie goes to the first by name."""
    counts = verdicts.filter("verdict is not null").groupBy("case", "criterion", "verdict").agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy("case", "criterion").agg(F.sum("n").alias("times"), F.min_by("verdict", F.struct((-F.col("n")).alias("n"), F.col("verdict"))).alias("majority"), F.max("n").alias("most"))
    return by.select("case", "criterion", "times", "majority", F.round(F.col("most") / F.col("times"), 6).alias("agreement"), (F.col("most") == F.col("times")).alias("stable"))


def prompt_leaks(replies: DataFrame, prompt: str, least: int = 12) -> DataFrame:
    """(id, fragments): how many lines of the prompt, of ``least`` characters or more, stand in a reply (id, text); none: no row."""
    lines = sorted({x.strip() for x in prompt.split("\n") if len(x.strip()) >= least})
    held = F.size(F.filter(F.array(*map(F.lit, lines)) if lines else F.array().cast("array<string>"), lambda f: F.contains(F.col("text"), f)))
    return replies.select("id", held.alias("fragments")).filter("fragments > 0")


def level_costs(communities: DataFrame) -> DataFrame:
    """(level, communities, slots, units, repetition) of communities (level, id, units array): each unit counted once a level, and as often as it is held."""
    each = communities.select("level", "id", F.explode("units").alias("unit"))
    held = each.groupBy("level", "unit").agg(F.count(F.lit(1)).alias("n")).groupBy("level").agg(F.sum("n").alias("slots"), F.count(F.lit(1)).alias("units"))
    number = communities.groupBy("level").agg(F.count_distinct("id").alias("communities"))
    return number.join(held, "level", "left").select("level", "communities", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("units", F.lit(0)).alias("units"), F.round(F.col("slots") / F.col("units"), 6).alias("repetition"))


def reconcile_sizes(old: DataFrame, delta: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """One row: keys before, in the update, after, those of both, and whether the sizes add up."""
    tagged = [d.select(key).distinct().withColumn(name, F.lit(1)) for d, name in ((old, "o"), (delta, "d"), (merged, "m"))]
    all_ = tagged[0].join(tagged[1], key, "full").join(tagged[2], key, "full")
    both = F.count_if(F.col("o").isNotNull() & F.col("d").isNotNull())
    sums = all_.agg(F.count("o").alias("previous"), F.count("d").alias("delta"), F.count("m").alias("merged"), both.alias("shared"))
    return sums.withColumn("adds_up", F.col("merged") == F.col("previous") + F.col("delta") - F.col("shared"))


def compare_arms(runs: DataFrame) -> DataFrame:
    """One row for each arm of runs (arm, kind, level, tokens, parent): entities, reports, tokens of each, levels, roots, report to source ratio."""
    of = lambda kind, x=None: F.when(F.col("kind") == kind, F.lit(1) if x is None else F.col(x))
    sums = runs.groupBy("arm").agg(
        F.count(of("entity")).alias("entities"), F.count(of("report")).alias("reports"), F.min(of("report", "level")).alias("low"), F.max(of("report", "level")).alias("high"),
        F.count_if((F.col("kind") == "report") & F.col("parent").isNull()).alias("roots"), F.sum(of("entity", "tokens")).alias("entity_tokens"), F.sum(of("report", "tokens")).alias("report_tokens"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return sums.select("arm", "entities", "reports", "low", "high", "roots", ratio("entity_tokens", "entities").alias("tokens_per_entity"), ratio("report_tokens", "entity_tokens").alias("report_ratio"))


def largest_component(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, components, the size of the largest and its share; nodes (node) in no component (node, component) count alone."""
    of = nodes.select("node").distinct().join(components, "node", "left").select(F.coalesce("component", "node").alias("component"))
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def cross_batch(members: DataFrame, batches: DataFrame) -> DataFrame:
    """(community, size, batches, dangling) of members (community, member): in how many batches (member, batch) they are, and how many in none."""
    known = batches.groupBy("member").agg(F.min("batch").alias("batch"))
    return members.select("community", "member").distinct().join(known, "member", "left").groupBy("community").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("batch").alias("batches"), F.count_if(F.col("batch").isNull()).alias("dangling")
    )


def main_category(links: DataFrame, units: DataFrame, categories: DataFrame) -> DataFrame:
    """(entity, category, units, share): the category most of an entity's units are in; links (entity, unit), units (unit, doc), categories (doc, category).

    Equals go by name; units of unknown documents count in the share alone.
    """
    found = links.select("entity", "unit").distinct().join(units, "unit", "left").join(categories, "doc", "left")
    counts = found.groupBy("entity", "category").agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy("entity").agg(F.sum("n").alias("all"))
    best = counts.filter("category is not null").withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "category"))).filter("r = 1")
    return by.join(best.select("entity", "category", "n"), "entity", "left").select("entity", "category", F.coalesce("n", F.lit(0)).alias("units"), F.round(F.coalesce("n", F.lit(0)) / F.col("all"), 6).alias("share"))


def session_usage(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, calls, tokens, requests) of calls (request, tokens) by the session of their request (request, session); unknown requests under null."""
    linked = calls.join(sessions.groupBy("request").agg(F.min("session").alias("session")), "request", "left")
    return linked.groupBy("session").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.count_distinct("request").alias("requests"))


def type_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(type_a, type_b, titles): titles (title, type) of two runs by their types; null where a run lacks them."""
    first = lambda d, name: d.groupBy("title").agg(F.min("type").alias(name), F.lit(1).alias(f"__{name}"))
    return first(a, "type_a").join(first(b, "type_b"), "title", "full").groupBy("type_a", "type_b").agg(F.count(F.lit(1)).alias("titles"))


def text_health(texts: DataFrame, group: str, text: str, noise: list[str], header: str, short: int = 50) -> DataFrame:
    """(group, texts, broken, short, headless, noisy): texts with replacement characters, too short, without the header, with noise words."""
    t = F.coalesce(F.col(text), F.lit(""))
    flag = lambda c, name: F.count_if(c).alias(name)
    any_noise = F.exists(F.array(*map(F.lit, noise)), lambda w: F.contains(F.lower(t), w))
    return texts.groupBy(group).agg(F.count(F.lit(1)).alias("texts"), flag(F.contains(t, F.lit("�")), "broken"), flag(F.length(t) < short, "short"), flag(~F.startswith(t, F.lit(header)), "headless"), flag(any_noise, "noisy"))


def light(runs: DataFrame, heavy: tuple[str, ...]) -> DataFrame:
    """The runs without their heavy columns, which are then not read."""
    return runs.drop(*heavy)


def last_logs(logs: DataFrame, kind: str | None, order: list[Column], most: int) -> DataFrame:
    """The last ``most`` entries of a kind, or of all, newest first."""
    some = logs if kind is None else logs.filter(F.col("type") == kind)
    return some.orderBy(*order).limit(most)


def with_reference(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results (case, ...) with their case's reference (case, question, expected) and whether the case is known."""
    known = cases.select("case", "question", "expected").dropDuplicates(["case"]).withColumn("known", F.lit(True))
    return results.join(known, "case", "left").fillna(False, ["known"])


def settings(changes: DataFrame) -> DataFrame:
    """(key, value) of a log of settings (key, value, version): the newest version's value; a null value unsets the key."""
    last = changes.groupBy("key").agg(F.max_by("value", "version").alias("value"))
    return last.filter("value is not null")
