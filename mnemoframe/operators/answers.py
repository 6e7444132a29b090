"""From ranked chunks to answer packets, and their evaluation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemoframe.functions.responses import cited
from mnemoframe.functions.text import citation_label

# What is said where there is nothing, or nothing sure, to say.
NO_SOURCES = "No relevant information found in your records."
ABSTENTION = "I don't have enough information in your records to answer this confidently. Here's what I found that might be related:\n\n"
# Weights and level thresholds of the third confidence score.
WEIGHTS = {"top_source": 0.25, "source_agreement": 0.25, "source_count": 0.20, "recency": 0.15, "critic": 0.15}
LEVELS = {"high": 0.70, "medium": 0.40, "low": 0.20}


def level(score: Column, levels: Mapping[str, float] = LEVELS) -> Column:
    return F.when(score >= levels["high"], "high").when(score >= levels["medium"], "medium").when(score >= levels["low"], "low").otherwise("none")


def context(ranked: DataFrame, max_chars: int | None = None, style: str = "file") -> DataFrame:
    """``query_id, n_used, context`` from ``query_id, rank, file_name, content``.

    Style ``file`` joins all entries with rules; ``label`` and ``plain`` take whole entries from the top while their
    lengths stay within ``max_chars`` and join them with line feeds.
    """
    number = F.concat(F.lit("[Source "), F.col("rank").cast("string"))
    name, content = F.coalesce("file_name", F.lit("")), F.coalesce("content", F.lit(""))
    entry = {
        "file": F.concat(number, F.lit("] (File: "), name, F.lit(")\n"), content),
        "label": F.concat(number, F.lit(": "), citation_label(name), F.lit("]\n"), content, F.lit("\n")),
        "plain": F.concat(number, F.lit("]"), F.when(name != "", F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(""), F.lit(":\n"), F.trim(content), F.lit("\n")),
    }[style]
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = ranked.select("query_id", "rank", entry.alias("entry"))
    if max_chars is not None:
        rows = rows.withColumn("so_far", F.sum(F.length("entry")).over(w)).where(F.col("so_far") <= max_chars)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n\n---\n\n" if style == "file" else "\n")
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_used"), joined.alias("context"))


def evidence(ranked: DataFrame, snippet_chars: int = 500) -> DataFrame:
    """Rank, chunk, file, a snippet and the scores of ranked chunks."""
    scores = [c for c in ranked.columns if c.startswith("score")]
    return ranked.select("query_id", "rank", "chunk_id", "file_name", F.left("content", F.lit(snippet_chars)).alias("snippet"), *scores)


def _base(ranked: DataFrame, verdicts: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    per = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.var_pop("score").alias("var"), F.min_by("score", "rank").alias("first"), F.slice(ordered, 1, 5).alias("five"))
    return verdicts.select("query_id", "verdict").join(per, "query_id", "left")


def confidence(ranked: DataFrame, verdicts: DataFrame, variant: int = 1) -> DataFrame:
    """``query_id, confidence, score`` (3 digits) for every row of ``verdicts(query_id, verdict)``.

    Variant 1: .3 top + .3 agreement + .2 count + .2 * .8, REVISE * .8, REJECT is (low, .15). Variant 2: .40 first * 10
    + .35 agreement of the first five + .25 count, REJECT * .3, REVISE * .7. Without sources: (none, 0).
    """
    b = _base(ranked, verdicts)
    count = F.least(F.col("n") / 3, F.lit(1.0))
    if variant == 1:
        agree = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 1 - F.col("var") * 10)).otherwise(0.5)
        raw = 0.3 * F.least("top", F.lit(1.0)) + 0.3 * agree + 0.2 * count + 0.2 * F.lit(0.8)
        score = F.when(F.col("verdict") == "REVISE", raw * 0.8).otherwise(raw)
        return b.select("query_id", F.when(F.col("n").isNull(), "none").when(F.col("verdict") == "REJECT", "low").otherwise(level(score)).alias("confidence"), F.when(F.col("n").isNull(), 0.0).when(F.col("verdict") == "REJECT", 0.15).otherwise(F.round(score, 3)).alias("score"))
    five = F.size("five")
    mean = F.aggregate("five", F.lit(0.0), lambda a, x: a + x) / five
    var = F.aggregate("five", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / five
    agree = F.when(F.col("n") >= 2, F.greatest(F.lit(0.0), 1 - var * 100)).otherwise(0.5)
    raw = 0.40 * F.least(F.lit(1.0), F.col("first") * 10) + 0.35 * agree + 0.25 * count
    score = raw * F.when(F.col("verdict") == "REJECT", 0.3).when(F.col("verdict") == "REVISE", 0.7).otherwise(1.0)
    return b.select("query_id", F.when(F.col("n").isNull(), "none").otherwise(level(score)).alias("confidence"), F.when(F.col("n").isNull(), 0.0).otherwise(F.round(score, 3)).alias("score"))


def confidence_factors(ranked: DataFrame, verdicts: DataFrame, weights: Mapping[str, float] = WEIGHTS, levels: Mapping[str, float] = LEVELS) -> DataFrame:
    """The five weighted factors with level, score and explanation, for every row of ``verdicts``.

    ``verdicts`` has ``verdict`` and may have ``n_cited`` (sources the answer uses) and ``n_contradictions``; ``ranked``
    may have ``recency``, of which the mean of the first five counts. What is missing counts as neutral.
    """
    for name in ("n_cited", "n_contradictions"):
        if name not in verdicts.columns:
            verdicts = verdicts.withColumn(name, F.lit(None).cast("int"))
    fresh = F.avg(F.when(F.col("rank") <= 5, F.coalesce("recency", F.lit(0.5)))) if "recency" in ranked.columns else F.lit(0.5)
    per = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), fresh.alias("fresh"))
    b = verdicts.join(per, "query_id", "left")
    used = F.when(F.col("n_cited") > 0, F.col("n_cited")).otherwise(F.coalesce("n", F.lit(0)))
    f = {
        "top_source": F.least(F.coalesce(F.col("top") * 10, F.lit(0.0)), F.lit(1.0)),
        "source_agreement": F.when(F.col("n_contradictions") > 0, F.greatest(F.lit(0.0), 1 - 0.25 * F.col("n_contradictions"))).when(F.col("n_cited") >= 2, 1.0).when(F.col("n_cited") == 1, 0.7).otherwise(0.5),
        "source_count": F.least(used / 3, F.lit(1.0)),
        "recency": F.coalesce("fresh", F.lit(0.5)),
        "critic": F.when(F.col("verdict") == "APPROVE", 1.0).when(F.col("verdict") == "REVISE", 0.5).when(F.col("verdict") == "REJECT", 0.0).otherwise(0.5),
    }
    score = sum((F.lit(w) * f[k] for k, w in weights.items()), F.lit(0.0))
    parts = F.array_compact(F.array(
        F.when(f["top_source"] >= 0.7, "highly relevant sources found").when(f["top_source"] >= 0.4, "moderately relevant sources").otherwise("weak source relevance"),
        F.when(f["source_count"] >= 1, "multiple supporting sources").when(f["source_count"] >= 0.5, "limited sources").otherwise("few sources"),
        F.when(f["source_agreement"] >= 0.8, "sources agree").when(f["source_agreement"] < 0.5, "some contradictions"), F.when(f["critic"] >= 0.8, "verified by critic").when(f["critic"] < 0.5, "verification concerns"),
    ))
    lead = F.when(level(score, levels) == "high", "High confidence").when(level(score, levels) == "medium", "Medium confidence").when(level(score, levels) == "low", "Low confidence").otherwise("Insufficient confidence")
    return b.select("query_id", *(F.round(v, 6).alias(k) for k, v in f.items()), F.round(score, 6).alias("score"), level(score, levels).alias("confidence"), F.concat(lead, F.lit(": "), F.array_join(parts, ", "), F.lit(".")).alias("explanation"))


def answer_packets(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """One packet for each row of ``answers(query_id, query_class, answer, verdict, critic)``.

    A rejected answer is replaced by a fixed text with the first three sources, confidence none and score 0.1. Sources
    are an array of (rank, chunk_id, file_name, snippet, score).
    """
    source = F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), "file_name", F.left("content", F.lit(500)).alias("snippet"), F.round("score", 6).alias("score"))
    line = F.concat(F.lit("- ["), F.col("file_name"), F.lit("]: "), F.left("content", F.lit(200)), F.lit("..."))
    few = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", line.alias("line")))))
    per = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"), F.array_join(F.transform(few, lambda x: x["line"]), "\n").alias("related"))
    sure = confidence(ranked, answers)
    both = answers.join(per, "query_id", "left").join(sure.withColumnRenamed("score", "sure"), "query_id", "left")
    rejected = F.col("verdict") == "REJECT"
    n = F.coalesce(F.size("sources"), F.lit(0))
    chain = F.concat(F.lit("Query type: "), F.col("query_class"), F.lit("\nRetrieval: "), n.cast("string"), F.lit(" chunks found\nVerification: "), F.col("verdict"), F.lit("\nCritic: "), F.coalesce("critic", F.lit("")))
    return both.select(
        "query_id", F.when(rejected, F.concat(F.lit(ABSTENTION), F.coalesce("related", F.lit("")))).otherwise(F.col("answer")).alias("answer"), F.when(rejected, "none").otherwise(F.col("confidence")).alias("confidence"),
        F.when(rejected, 0.1).otherwise(F.col("sure")).alias("confidence_score"), "sources", F.col("verdict").alias("verification"), chain.alias("reasoning_chain"), F.size(cited("answer")).alias("n_cited"),
    )


def evaluate_ranking(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """``n_queries, recall, mrr``: mean share of gold chunks in the first ``k``, mean reciprocal rank of the first one."""
    top = ranked.where(F.col("rank") <= k).select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "rank")
    g = gold.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id")).distinct()
    per = g.join(top, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))


def citation_support(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """``n_cited, n_supported, support_rate``: answers with a cited chunk, and those of which one contains the claim.

    ``answers(query_id, claim)`` and ``cited(query_id, content)``; case and white space at the ends do not count. Blank claims
    have nothing to support and are left out; the rate of no answers is null.
    """
    claim = F.lower(F.trim("claim"))
    both = answers.where(claim != "").select("query_id", claim.alias("claim")).join(cited.select("query_id", F.lower("content").alias("content")), "query_id")
    per = both.groupBy("query_id").agg(F.max(F.coalesce(F.col("content").contains(F.col("claim")), F.lit(False)).cast("int")).alias("ok"))
    return per.agg(F.count(F.lit(1)).alias("n_cited"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_supported"), F.round(F.avg("ok"), 6).alias("support_rate"))


def abstention_correctness(answers: DataFrame) -> DataFrame:
    """One row over ``answers(query_id, abstained, unanswerable)``: how many abstain rightly, wrongly, or should have."""
    gave, none = F.coalesce("abstained", F.lit(False)), F.coalesce("unanswerable", F.lit(False))
    return answers.agg(F.count(F.lit(1)).alias("n"), F.count_if(gave & none).alias("rightly"), F.count_if(gave & ~none).alias("wrongly"), F.count_if(~gave & none).alias("missed"), F.round(F.avg((gave == none).cast("int")), 6).alias("correct_rate"))


def latency_percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"))


def confidence_metrics(packets: DataFrame) -> DataFrame:
    """By verdict: packets, their mean confidence score, and the share that abstained."""
    return packets.groupBy("verification").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence_score"), 6).alias("mean_score"), F.round(F.avg(F.when(F.col("confidence") == "none", 1.0).otherwise(0.0)), 6).alias("abstained"))
