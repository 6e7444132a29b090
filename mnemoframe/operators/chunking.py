"""Cutting texts into chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_EDGES = r"(?U)\A\s+|\s+\z"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def sentence_chunks(c: Column, size: int = 500, overlap: int = 100) -> Column:
    """Chunks of at most ``size`` characters that end with sentences where they can.

    A new chunk begins with up to ``overlap`` last characters of the one before, if they fit beside the next sentence; a
    sentence longer than ``size`` is cut every ``size - overlap`` characters. Blank texts have no chunks.
    """
    step = max(size - overlap, 1)
    text = _strip(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<string>")
    # the split takes the white space between sentences, so neither they nor what is packed from them has any at its ends
    keep = lambda s: F.when(s == "", none).otherwise(F.array(s))

    def pieces(s):
        starts = F.sequence(F.lit(0), F.length(s) - 1, F.lit(step))
        return F.filter(F.transform(starts, lambda i: _strip(F.substr(s, i + 1, F.lit(size)))), lambda x: x != "")

    def seeded(now, s):
        room = F.lit(size - 1) - F.length(s)
        tail = F.right(now, F.greatest(F.lit(0), F.least(F.lit(overlap), room, F.length(now))))
        tail = F.when(tail.rlike(r"(?U)\A\s"), F.regexp_replace(tail, r"(?U)\A\s+", "")).otherwise(tail)
        return F.when((room > 0) & (tail != ""), F.concat_ws(" ", tail, s)).otherwise(s) if overlap > 0 else s

    def add(state, s):
        done, now = state["done"], state["now"]
        state_of = lambda d, n: F.struct(d.alias("done"), n.alias("now"))
        fits = F.length(now) + 1 + F.length(s) <= size
        return (
            F.when(F.length(s) > size, state_of(F.concat(done, keep(now), pieces(s)), F.lit("")))
            .when(now == "", state_of(done, s))
            .when(fits, state_of(done, F.concat_ws(" ", now, s)))
            .otherwise(state_of(F.concat(done, F.array(now)), seeded(now, s)))
        )

    start = F.struct(none.alias("done"), F.lit("").alias("now"))
    cut = F.aggregate(F.split(text, r"(?U)(?<=[.!?])\s+"), start, add, lambda a: F.concat(a["done"], keep(a["now"])))
    return F.when(text == "", none).otherwise(cut)


def fixed_chunks(c: Column, size: int = 500, overlap: int = 100) -> Column:
    """Windows of ``size`` characters every ``size - overlap``; empty texts have none."""
    step = max(size - overlap, 1)
    starts = F.sequence(F.lit(0), F.length(c) - 1, F.lit(step))
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.transform(starts, lambda i: F.substr(c, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


SEPARATORS = ("\n\n", "\n", " ", "")


def _recursive(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Splits at the coarsest separator present, packs neighbours up to ``size``, and splits longer parts further."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[list(separators).index(sep) + 1 :] if sep in separators else ()
    parts = [p for p in (text.split(sep) if sep else list(text)) if p]
    out: list[str] = []
    held: deque[str] = deque()
    length = 0  # of what is held, joined

    def flush():
        if joined := sep.join(held).strip():
            out.append(joined)

    for p in parts:
        if len(p) > size and finer:
            flush()
            held.clear()
            length = 0
            out += _recursive(p, size, overlap, finer)
            continue
        if held and length + len(sep) + len(p) > size:
            flush()
            while held and (length > overlap or length + len(sep) + len(p) > size):
                length -= len(held.popleft()) + (len(sep) if held else 0)
        length += len(p) + (len(sep) if held else 0)
        held.append(p)
    flush()
    return out


def recursive_chunks(c: Column, size: int = 300, overlap: int = 50, separators: Sequence[str] = SEPARATORS) -> Column:
    """Chunks by paragraphs, lines, words and characters, the coarsest that fits; recursion needs Python."""

    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: _recursive(x, size, overlap, separators) if x else [])

    cut.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(cut, "array<string>")(c)


def chunk_rows(docs: DataFrame, chunks: Column, doc_id: str = "document_id") -> DataFrame:
    """``chunk_id, document_id, content, chunk_index, total_chunks``; empty chunks are dropped before numbering."""
    cut = docs.select(F.col(doc_id).cast("string").alias("document_id"), F.filter(chunks, lambda x: x != "").alias("cs"))
    rows = cut.select("document_id", F.size("cs").alias("total_chunks"), F.posexplode("cs").alias("chunk_index", "content"))
    return rows.select(F.concat_ws("-", "document_id", "chunk_index").alias("chunk_id"), "document_id", "content", "chunk_index", "total_chunks")


def chunk_sentences(docs: DataFrame, size: int = 500, overlap: int = 100, doc_id: str = "document_id", text: str = "text") -> DataFrame:
    return chunk_rows(docs, sentence_chunks(F.col(text), size, overlap), doc_id)


def chunk_fixed(docs: DataFrame, size: int = 500, overlap: int = 100, doc_id: str = "document_id", text: str = "text") -> DataFrame:
    return chunk_rows(docs, fixed_chunks(F.col(text), size, overlap), doc_id)


def chunk_recursive(docs: DataFrame, size: int = 300, overlap: int = 50, doc_id: str = "document_id", text: str = "text") -> DataFrame:
    return chunk_rows(docs, recursive_chunks(F.col(text), size, overlap), doc_id)


def chunk_documents(docs: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """Chunk records ``title, sections, text, source, page, chunk_id`` of documents ``text, source, page``.

    ``title`` and ``sections`` are those of the document, empty where it has none; ``chunk_id`` numbers a document's chunks
    from 0. A page is a row of its own. Null and blank texts have no records.
    """
    title = F.coalesce(F.col("title").cast("string"), F.lit("")) if "title" in docs.columns else F.lit("")
    none = F.array().cast("array<string>")
    sections = F.coalesce("sections", none) if "sections" in docs.columns else none
    cut = docs.select(title.alias("title"), sections.alias("sections"), "source", "page", F.posexplode(recursive_chunks(F.col("text"), size, overlap)).alias("chunk_id", "chunk"))
    return cut.select("title", "sections", F.col("chunk").alias("text"), "source", "page", "chunk_id")
