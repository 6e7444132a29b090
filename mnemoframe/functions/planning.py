"""Query classes, time ranges, entities in queries, and retrieval plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemoframe.functions.text import _col

# Patterns of the ordered classifier, tried class by class on lower-case queries.
ORDERED = (
    ("TEMPORAL", (r"how\s+(did|has)\s+my\s+(view|opinion|thought|thinking|belief)", r"change[sd]?\s+over\s+time", r"(last|this)\s+(week|month|year)", r"when\s+did\s+i\s+(first|last)", r"evolution\s+of", r"timeline\s+of", r"history\s+of\s+my")),
    ("CONTRADICTION", (r"contradict", r"conflict(ing|s)?", r"inconsisten", r"disagree", r"did\s+i\s+say\s+(different|conflicting)")),
    ("MULTI_HOP", (
        r"(relate|connect|link)(s|ed|ion|ions)?\s+(to|between|with)", r"(relationship|connection)s?\s+(between|among)", r"how\s+does\s+.+\s+connect", r"what\s+(did\s+)?\w+\s+(say|said|share|shared|mention|mentioned)\s+about",
        r"from\s+.+\s+about", r"ideas?\s+from\s+\w+", r"connections?\s+exist",
    )),
)
# Patterns of the scored classifier, one point each.
SCORED = (
    ("TEMPORAL", (r"\bover time\b", r"\bchanged?\b", r"\bevolved?\b", r"\bhistory\b", r"\bprogress\b", r"\bwhen did\b", r"\blast (week|month|year)\b", r"\bthis (week|month|year)\b", r"\brecently\b", r"\bbefore\b", r"\bafter\b", r"\btimeline\b", r"\btrend\b", r"\bshift\b")),
    ("MULTI_HOP", (r"\babout\b.*\babout\b", r"\bconnect(ed|ion)?\b", r"\brelat(ed|ion|e|es)\b", r"\bbetween\b", r"\blink\b", r"\bfrom\b.*\babout\b", r"\bwhat did .+ say about\b", r"\bhow does .+ relate\b", r"\bsay about\b", r"\bsaid about\b")),
    ("CONTRADICTION", (r"\bconflict\b", r"\bcontradict\b", r"\binconsisten\b", r"\bdisagree\b", r"\bdifferent views?\b", r"\bchanged (my|their) mind\b")),
    ("AGGREGATION", (r"\ball\b", r"\bsummar(y|ize)\b", r"\bpriorities\b", r"\btop\b", r"\bmost (important|frequent|common)\b", r"\boverall\b", r"\bhow many\b", r"\blist\b", r"\beverything\b")),
)
# Time ranges, first match.
TIMES = ("this week", "last week", "this month", "last month", "today", "yesterday")
# Words that are no entities though capitalised; sentence starters count only as first word.
NO_ENTITY = ("what", "who", "when", "where", "why", "how", "the", "a", "an", "is", "are", "was", "were", "did", "does", "do", "i", "my", "to", "went", "from", "in", "on", "at", "for", "with")
STARTERS = (
    "please", "thanks", "hello", "hi", "hey", "well", "so", "now", "then", "here", "there", "yes", "no", "sure", "okay", "ok", "just", "also", "maybe", "perhaps", "sorry", "great", "good", "nice", "fine", "could", "would",
    "should", "can", "will", "shall", "may", "let",
)
NO_RUN = ("What", "Who", "Where", "When", "Why", "How", "Did", "Does", "Is", "Are", "Can", "Could", "Would", "Should", "The", "This", "That", "My", "Your", "Our", "Their", "I")
# Retrieval by class: dense results, sparse results, hops in the graph, order by time.
PLANS = (("SIMPLE", 5, 3, 0, False), ("MULTI_HOP", 3, 2, 3, False), ("TEMPORAL", 10, 5, 0, True), ("CONTRADICTION", 5, 5, 2, True), ("AGGREGATION", 15, 10, 0, False))


def classify_ordered(c: str | Column) -> Column:
    """The first class one of whose patterns occurs; null if none does."""
    q = F.lower(_col(c))
    return F.coalesce(*(F.when(q.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(k)) for k, ps in ORDERED))


def class_points(c: str | Column) -> list[tuple[str, Column]]:
    return [(k, sum((_col(c).rlike(f"(?i){p}").cast("int") for p in ps), F.lit(0))) for k, ps in SCORED]


def classify_scored(c: str | Column) -> Column:
    """The class with the most points if it has two or more and no other has as many; else null."""
    points = class_points(c)
    best = F.greatest(*(n for _, n in points))
    winners = sum((F.when(n == best, 1).otherwise(0) for _, n in points), F.lit(0))
    return F.when((best >= 2) & (winners == 1), F.coalesce(*(F.when(n == best, F.lit(k)) for k, n in points)))


def time_range(c: str | Column) -> Column:
    return F.coalesce(*(F.when(_col(c).rlike(rf"(?i)\b{t}\b"), F.lit(t)) for t in TIMES))


def query_entities(c: str | Column, runs: bool = False) -> Column:
    """Quoted strings and capitalised words of a query, distinct and sorted.

    With ``runs``, neighbouring capitalised words make one entity, and only double quotes count; else words stand alone
    and a sentence starter is left out where it is the first word.
    """
    q = F.coalesce(_col(c), F.lit(""))
    quoted = F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1))
    if runs:
        caps = F.regexp_extract_all(q, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), F.lit(1))
        return F.array_sort(F.array_distinct(F.concat(quoted, F.array_except(caps, F.array(*map(F.lit, NO_RUN))))))
    single = F.regexp_extract_all(q, F.lit("'([^']+)'"), F.lit(1))
    first = F.regexp_extract(q, r"^([A-Z][a-z]+)\b", 1)
    caps = F.filter(F.regexp_extract_all(q, F.lit(r"\b([A-Z][a-z]+)\b"), F.lit(1)), lambda w: ~F.lower(w).isin(*NO_ENTITY) & ~((w == first) & F.lower(w).isin(*STARTERS)))
    return F.array_sort(F.array_distinct(F.concat(quoted, single, caps)))


def plan_table(spark: SparkSession, top_k: int | None = None) -> DataFrame:
    """``query_class, dense_k, sparse_k, hops, temporal``; with ``top_k``, results are scaled so that SIMPLE has that many."""
    scale = 1 if top_k is None else top_k / PLANS[0][1]
    return spark.createDataFrame([(k, max(1, round(d * scale)), max(1, round(s * scale)), h, t) for k, d, s, h, t in PLANS], "query_class string, dense_k int, sparse_k int, hops int, temporal boolean")


def retrieval_plan(queries: DataFrame, text: str = "text", top_k: int | None = None) -> DataFrame:
    """Adds class, entities, time range and the plan of the class to queries; SIMPLE where no class is certain."""
    q = queries.withColumn("entities", query_entities(text, runs=True)).withColumn("time_range", time_range(text)).withColumn("query_class", F.coalesce(classify_scored(text), F.lit("SIMPLE")))
    return q.join(F.broadcast(plan_table(queries.sparkSession, top_k)), "query_class", "left")
