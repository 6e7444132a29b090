"""Parsers by suffix (A6), and files as a table of parsed texts, in DataFrames and in SQL.

A parser is a function from the bytes of a file to its text. ``PARSERS`` has those for texts and JSON; a caller adds others,
for PDF or images say, by giving a larger mapping. What a parser raises becomes an error of its row, not of the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mnemoframe.sources.files import _flat, suffix

Parser = Callable[[bytes], str]
#: Bytes of files that one task of ``parsed_files`` reads, by the sizes it is told.
BYTES_PER_TASK = 64_000_000


def parse_text(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def parse_json(content: bytes) -> str:
    text = parse_text(content)
    try:
        return "\n".join(_flat(json.loads(text)))
    except ValueError:
        return text


PARSERS: Mapping[str, Parser] = {".txt": parse_text, ".md": parse_text, ".json": parse_json}


def parse_one(parsers: Mapping[str, Parser], end: str | None, content: bytes | None) -> tuple[str | None, str | None]:
    """``text, error`` of one file; one of them is null."""
    parser = parsers.get(end or "")
    if parser is None:
        return None, f"no parser for '{end or ''}'"
    if content is None:
        return None, "no content"
    try:
        return parser(bytes(content)), None
    except Exception as e:  # noqa: BLE001  a caller's parser may fail in any way
        return None, f"{type(e).__name__}: {e}"


def parse_files(files: DataFrame, parsers: Mapping[str, Parser] = PARSERS, path: str = "path", content: str = "content") -> DataFrame:
    """Every file of ``files`` (``path, content``, such as ``scan_files`` gives): ``path, suffix, text, error``."""
    known = dict(parsers)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [parse_one(known, e, c) for e, c in zip(b["suffix"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "suffix": b["suffix"], "text": [t for t, _ in done], "error": [e for _, e in done]})

    rows = files.select(F.col(path).cast("string").alias("path"), suffix(path).alias("suffix"), F.col(content).alias("content"))
    return rows.mapInPandas(work, "path string, suffix string, text string, error string")


class _Files(InputPartition):
    def __init__(self, paths: Sequence[str]):
        self.paths = list(paths)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, parsers: Mapping[str, Parser]):
        self.folder, self.parsers = folder, parsers

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, at = self._fs()
        found = sorted((i for i in files.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file and not i.base_name.startswith((".", "_"))), key=lambda i: i.path)
        out, held, size = [], [], 0
        for i in found:
            held.append(i.path)
            size += i.size or 0
            if size >= BYTES_PER_TASK:
                out.append(_Files(held))
                held, size = [], 0
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = self._fs()
        for path in partition.paths:
            name = path.rpartition("/")[2]
            end = name[name.rfind(".") :].lower() if name.rfind(".") > 0 else ""
            try:
                with files.open_input_stream(path) as f:
                    content = f.read()
            except OSError as e:
                yield path, end, None, f"{type(e).__name__}: {e}"
                continue
            yield path, end, *parse_one(self.parsers, end, content)


def register_parsed_files(spark: SparkSession, parsers: Mapping[str, Parser] = PARSERS, name: str = "parsed_files") -> None:
    """Makes ``spark.read.format(name).load(folder)`` a table ``path, suffix, text, error`` of all files below a folder.

    Hidden files are left out. SQL users reach it by ``create table t using <name> options (path '...')`` or a temporary view.
    """
    known = dict(parsers)

    class ParsedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "path string, suffix string, text string, error string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options["path"], known)

    spark.dataSource.register(ParsedFiles)
