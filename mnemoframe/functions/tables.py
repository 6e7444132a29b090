"""Table functions for SQL: chunkers and personal data with ``LATERAL``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_CHUNK = "chunk_index int, content string"


def sentence_cuts(text: str | None, size: int = 500, overlap: int = 100) -> list[str]:
    """What ``chunking.sentence_chunks`` gives, one text at a time."""
    text = (text or "").strip()
    if not text:
        return []
    step = max(size - overlap, 1)
    done, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(s) > size:
            done += [now] if now else []
            done += [x for x in (s[i : i + size].strip() for i in range(0, len(s), step)) if x]
            now = ""
        elif not now:
            now = s
        elif len(now) + 1 + len(s) <= size:
            now = f"{now} {s}"
        else:
            done.append(now)
            room = size - 1 - len(s)
            tail = now[len(now) - max(0, min(overlap, room, len(now))) :].lstrip()
            now = f"{tail} {s}" if overlap > 0 and room > 0 and tail else s
    return done + ([now] if now else [])


@udtf(returnType=_CHUNK)
class SentenceChunks:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(sentence_cuts(text, size, overlap))


@udtf(returnType=_CHUNK)
class RecursiveChunks:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        from mnemoframe.operators.chunking import SEPARATORS, _recursive

        yield from enumerate(_recursive(text, size, overlap, SEPARATORS) if text else [])


@udtf(returnType=_CHUNK)
class FixedChunks:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for k, i in enumerate(range(0, len(text or ""), max(size - overlap, 1))):
            yield k, text[i : i + size]


@udtf(returnType="type string, value string, start int, end int, confidence double")
class PiiFindings:
    def __init__(self) -> None:
        from mnemoframe.functions.safety import Scanner

        self.scanner = Scanner()

    def eval(self, text: str) -> Iterator[tuple]:
        yield from self.scanner.scan(text)


FUNCTIONS = {"sentence_chunks": SentenceChunks, "recursive_chunks": RecursiveChunks, "fixed_chunks": FixedChunks, "pii_findings": PiiFindings}


def register_tables(spark: SparkSession) -> None:
    """Makes the functions known to SQL: ``select * from docs, lateral sentence_chunks(text, 500, 100)``."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
