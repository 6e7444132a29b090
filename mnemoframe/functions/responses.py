"""Reading what a model answered: JSON blocks, tagged sections, citations, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from mnemoframe.functions.text import _col

# Verdicts, and the answer that stands for abstaining.
VERDICTS = ("APPROVE", "REVISE", "REJECT")
ABSTAINED = "I don't have enough information in your records to answer this confidently."


def json_block(c: str | Column, schema: StructType | str) -> Column:
    """The text from the first ``{`` to the last ``}`` parsed by ``schema``; null fields where it is missing or broken."""
    return F.from_json(F.regexp_extract(_col(c), r"(?s)\{.*\}", 0), schema)


def _section(c: Column, tag: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.trim(F.try_element_at(found, F.lit(1)), F.lit(" \t\r\n"))


def parse_tagged(c: str | Column) -> Column:
    """``answer, reasoning, contradictions, abstained, abstention_reason`` of a response with tagged sections.

    Without an answer section the whole response is the answer; an abstain section replaces the answer by a fixed text.
    """
    t = F.coalesce(_col(c), F.lit(""))
    abstain, answer, why, against = (_section(t, x) for x in ("abstain", "answer", "reasoning", "contradictions"))
    parts = F.filter(F.transform(F.split(against, r"[\n\-•]"), lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    none = against.isNull() | (F.lower(against) == "none") | (against == "") | abstain.isNotNull()
    return F.struct(
        F.when(abstain.isNotNull(), F.lit(ABSTAINED)).otherwise(F.coalesce(answer, F.trim(t, F.lit(" \t\r\n")))).alias("answer"), F.coalesce(abstain, why, F.lit("")).alias("reasoning"),
        F.when(none, F.array().cast("array<string>")).otherwise(parts).alias("contradictions"), abstain.isNotNull().alias("abstained"), abstain.alias("abstention_reason"),
    )


def cited(c: str | Column) -> Column:
    """Distinct numbers of ``[Source N]`` marks, ascending."""
    marks = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"\[Source (\d{1,9})\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(marks, lambda x: x.cast("int"))))


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``query_id, source_num, file_name, snippet`` of marks in ``answers.answer`` that resolve in ``sources`` (ranked)."""
    marks = answers.select("query_id", F.explode(cited("answer")).alias("source_num"))
    of = sources.select("query_id", F.col("rank").alias("source_num"), "file_name", F.when(F.length("content") > 200, F.concat(F.left("content", F.lit(200)), F.lit("..."))).otherwise(F.col("content")).alias("snippet"))
    return marks.join(of, ["query_id", "source_num"])


def parse_verdict_line(c: str | Column) -> Column:
    """The first verdict word on the first line, APPROVE if there is none."""
    line = F.upper(F.element_at(F.split(F.trim(F.coalesce(_col(c), F.lit("")), F.lit(" \t\r\n")), "\n"), 1))
    return F.coalesce(*(F.when(line.contains(v), F.lit(v)) for v in VERDICTS), F.lit("APPROVE"))


def parse_verdict_json(c: str | Column) -> Column:
    """``verdict, confidence, feedback`` from a JSON object; else APPROVE or REJECT by their words, else REVISE."""
    t = F.coalesce(_col(c), F.lit(""))
    data = F.from_json(t, "verdict string, confidence double, feedback string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    fine = t.rlike(r"(?s)\A\s*\{.*\}\s*\z") & data["_bad"].isNull()
    upper = F.upper(t)
    said = F.upper(F.coalesce(data["verdict"], F.lit("REVISE")))
    words = F.when(upper.contains("APPROVE"), "APPROVE").when(upper.contains("REJECT"), "REJECT").otherwise("REVISE")
    return F.struct(
        F.when(fine, F.when(said.isin(*VERDICTS), said).otherwise("REVISE")).otherwise(words).alias("verdict"), F.when(fine, F.coalesce(data["confidence"], F.lit(0.5))).otherwise(0.4).alias("confidence"),
        F.when(fine, F.coalesce(data["feedback"], F.lit("No feedback provided"))).otherwise(F.left(t, F.lit(500))).alias("feedback"),
    )


def grounded(answers: DataFrame, sources: DataFrame, least: int = 3) -> DataFrame:
    """``query_id, grounded``: there are citations, all resolve, and one of the first three shares ``least`` words.

    Words are compared in lower case between the answer and the first 50 words of the source.
    """
    marks = F.transform(F.regexp_extract_all(F.coalesce(F.col("answer"), F.lit("")), F.lit(r"\[Source (\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    asked = answers.select("query_id", marks.alias("marks"), words(F.col("answer")).alias("said"))
    known = sources.groupBy("query_id").agg(F.max("rank").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", F.slice(words(F.col("content")), 1, 50).alias("w")))).alias("w"))
    both = asked.join(known, "query_id", "left")
    valid = (F.size("marks") > 0) & F.col("n").isNotNull() & F.forall("marks", lambda m: (m >= 1) & (m <= F.col("n")))
    shared = F.exists(F.slice("marks", 1, 3), lambda m: F.coalesce(F.size(F.array_intersect(F.col("w")[m], F.col("said"))) >= least, F.lit(False)))
    return both.select("query_id", F.coalesce(valid & shared, F.lit(False)).alias("grounded"))
