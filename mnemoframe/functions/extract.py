"""Entities and relations in chunks of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
# Patterns of entities.
PATTERNS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("URL", r"https?://[^\s<>\"']+"),
    ("PHONE", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"),
    ("MONEY", r"(?i)\$\s?\d[\d,]*(?:\.\d{1,2})?(?:\s?(?:million|billion|M|B|K|k))?|(?:\d[\d,]*(?:\.\d{1,2})?\s?(?:USD|EUR|GBP|TND|dollars?))"),
    ("DATE", rf"(?i)\b(?:\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|{_MONTH}[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{_MONTH}[a-z]*\.?\s+\d{{4}})\b"),
)
#: Digits that a phone number has at least.
PHONE_DIGITS = 7
# Labels of taggers and the entity types they stand for; types that are never kept.
LABELS = {
    "PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "PRODUCT": "PRODUCT", "EVENT": "EVENT", "WORK_OF_ART": "WORK_OF_ART", "LAW": "LAW",
    "LANGUAGE": "LANGUAGE", "NORP": "GROUP", "DATE": "DATE", "TIME": "TIME", "MONEY": "MONEY", "QUANTITY": "QUANTITY", "PERCENT": "PERCENT", "ORDINAL": "ORDINAL", "CARDINAL": "CARDINAL",
}
SKIPPED = ("CARDINAL", "ORDINAL", "QUANTITY", "PERCENT")
HIGH_VALUE = ("PERSON", "ORGANIZATION", "LOCATION", "PRODUCT", "EVENT", "GROUP")
# Names that taggers often get wrong.
BLOCKLIST = (
    "key decisions", "key decision", "next steps", "action items", "the team", "the user", "someone", "everyone", "anyone", "websocket", "websockets", "json", "http", "https", "api", "rest", "graphql", "sql", "sqlite",
    "docker", "linux", "github", "ollama", "ollama for llm", "llm", "rag", "fastapi", "pydantic", "uvicorn", "python", "javascript", "typescript", "react", "nextjs", "next.js", "node", "npm", "frontend", "backend",
    "readme", "markdown", "yaml", "csv", "today", "yesterday", "tomorrow", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)
# Relation by the two types, in either order.
RELATIONS = (
    ("PERSON", "ORGANIZATION", "affiliated_with"), ("PERSON", "LOCATION", "located_in"), ("ORGANIZATION", "LOCATION", "based_in"), ("PERSON", "EVENT", "participated_in"), ("ORGANIZATION", "EVENT", "involved_in"),
    ("PERSON", "PRODUCT", "works_on"), ("ORGANIZATION", "PRODUCT", "produces"), ("PERSON", "PERSON", "associated_with"), ("ORGANIZATION", "ORGANIZATION", "related_to"),
)
OTHERWISE = "co_occurs_with"
#: How specific a relation is; those not named count 10.
SPECIFIC = {"co_occurs_with": 0, "related_to": 1, "associated_with": 2}
EDGES_PER_CHUNK = 15


def _typed(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("name"))


def extract_patterns(df: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """``chunk_id, pos, name, type, source`` of every pattern hit; one scan of the table for all types."""
    hits = []
    for kind, pattern in PATTERNS:
        found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)), lambda x: F.trim(x))
        if kind == "PHONE":
            found = F.filter(found, lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= PHONE_DIGITS)
        hits.append(F.transform(found, _typed(kind)))
    return df.select(F.col(chunk_id).alias("chunk_id"), F.posexplode(F.concat(*hits)).alias("pos", "hit")).select("chunk_id", "pos", F.col("hit.name").alias("name"), F.col("hit.type").alias("type"), F.lit("regex").alias("source"))


def keep_named(found: DataFrame) -> DataFrame:
    """Tagger output ``chunk_id, pos, name, label`` reduced to usable entities, one for each chunk, name and type."""
    kind = F.coalesce(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[F.col("label")], F.col("label"))
    named = found.select("chunk_id", "pos", F.trim("name").alias("name"), kind.alias("type"), F.lit("tagger").alias("source"))
    usable = F.length("name").between(2, 80) & ~F.col("name").contains("\n") & F.col("name").rlike(r"\p{L}") & ~F.col("name").contains("@") & ~F.col("name").startswith("http")
    return dedupe_entities(named.where(usable & ~F.col("type").isin(*SKIPPED) & ~F.lower("name").isin(*BLOCKLIST)))


def extract_named(df: DataFrame, tagger: Callable[[Column], Column], chunk_id: str = "chunk_id", text: str = "text", longest: int | None = None) -> DataFrame:
    """Named entities by a caller's ``tagger``: a column function from text to ``array<struct<name, label>>``.

    The tagger sees whole chunks, or their first ``longest`` characters where a caller's tagger needs such a bound.
    """
    seen = F.col(text) if longest is None else F.left(F.col(text), F.lit(longest))
    hits = df.select(F.col(chunk_id).alias("chunk_id"), F.posexplode(tagger(seen)).alias("pos", "hit"))
    return keep_named(hits.select("chunk_id", "pos", F.col("hit.name").alias("name"), F.col("hit.label").alias("label")))


def gazetteer(names: DataFrame) -> Callable[[Column], Column]:
    """A tagger from a small table ``name, label``, matched as whole words; the table is collected and must be small."""
    rows = [(r["name"], r["label"]) for r in names.select("name", "label").limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("a gazetteer has at most 10000 names")
    known = F.create_map(*(F.lit(x) for r in rows for x in r))
    pattern = r"\b(?:" + "|".join(sorted((r"\Q" + n + r"\E" for n, _ in rows), key=len, reverse=True)) + r")\b"
    return lambda text: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda x: F.struct(x.alias("name"), known[x].alias("label")))


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """The first entity of each chunk, trimmed lower-case name and type; pattern hits come before tagger hits."""
    first = W.partitionBy("chunk_id", F.lower(F.trim("name")), "type").orderBy(F.when(F.col("source") == "regex", 0).otherwise(1), "pos", "name")
    return entities.select(F.struct("*").alias("row"), F.row_number().over(first).alias("turn")).where("turn = 1").select("row.*")


def relation(a: Column, b: Column) -> Column:
    out = F
    for x, y, name in RELATIONS:
        out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), F.lit(name))
    return out.otherwise(F.lit(OTHERWISE))


def specificity(kind: Column) -> Column:
    out = F
    for name, n in SPECIFIC.items():
        out = out.when(kind == name, F.lit(n))
    return out.otherwise(F.lit(10))


def cooccurrences(entities: DataFrame, cap: int = EDGES_PER_CHUNK) -> DataFrame:
    """``chunk_id, rank, source, target, relationship``: pairs of high-value entities of a chunk, the ``cap`` most specific.

    Pairs are one for each pair of lower-case names, the first by position. A chunk is a few hundred characters, so the
    pairs made within it are few.
    """
    seq = W.partitionBy("chunk_id").orderBy("pos", "type", "name")
    high = entities.where(F.col("type").isin(*HIGH_VALUE)).withColumn("seq", F.row_number().over(seq)).withColumn("lname", F.lower("name"))
    a = high.select("chunk_id", F.col("seq").alias("i"), F.col("name").alias("source"), F.col("type").alias("ta"), F.col("lname").alias("la"))
    b = high.select("chunk_id", F.col("seq").alias("j"), F.col("name").alias("target"), F.col("type").alias("tb"), F.col("lname").alias("lb"))
    pairs = a.join(b, "chunk_id").where("i < j").withColumn("relationship", relation(F.col("ta"), F.col("tb")))
    once = W.partitionBy("chunk_id", F.least("la", "lb"), F.greatest("la", "lb")).orderBy("i", "j")
    kept = pairs.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    best = W.partitionBy("chunk_id").orderBy(specificity(F.col("relationship")).desc(), "i", "j")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cap).select("chunk_id", "rank", "source", "target", "relationship")
