"""From questions to numbered blocks of context, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieve as rt


def context(questions: DataFrame, docs: DataFrame, vectors: DataFrame, k: int = 25, cap: int = 4000, excerpt: int | None = None, least: float | None = None) -> DataFrame:
    """(query_id, block): for each question its fused hits under the token budget, rendered in order.

    ``questions``: query_id, text, q (vector), few rows; ``docs``: id, text;
    ``vectors``: id, v.  Lexical and dense hits are fused by rank.  With
    ``least``, questions whose best dense score is below it get no block.
    ``excerpt`` shortens the shown texts; tokens are counted on whole ones.
    """
    dense = rt.dense_top_k(questions.select("query_id", "q"), vectors, k)
    fused = rt.rrf(dense, rt.bm25_top_k(questions.select("query_id", "text"), docs, tx.mixed_tokens, k))
    if least is not None:
        fused = rt.gate(fused, "query_id", "dense", least).drop("best")
    shown = F.substring("text", 1, excerpt) if excerpt else F.col("text")
    sized = fused.join(docs.select("id", shown.alias("text"), tx.token_estimate(F.col("text")).alias("tokens")), "id")
    kept = rt.budget_stop(sized, "query_id", [F.desc("rrf"), "id"], "tokens", cap)
    return rt.context_block(kept, "query_id", "rn", "text")
