"""Legacy archives (ARC, versions 1 and 2) and their conversion to WARC.

An ARC archive begins with a version block whose line says which fields the header line of every record has; a record's
length is declared there. The converter reads header lines by that version, cuts payloads by the declared lengths, and
makes what WARC needs and ARC lacks: record identifiers (name-based on place and content, so a retried task makes the
same), ISO timestamps, record types and SHA-1 digests.

Archives travel as rows of binary columns of about ``ARCHIVE_BYTES``; a table of them is what a cluster can write to and
read from any store that Spark reaches. ``write_files`` and ``read_files`` make archive files of them and take such files in.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm.common import record, small_batches, table
from mnemoframe.scratch import written

ARCHIVE_BYTES = 256_000
#: Field names of a record's header line by version. Fixed values of the format.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
_TITLES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PAGE = "X-Page-Id"
#: Stands where a page has no address.
_BLANK = "about:blank"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _token(value: str | None, empty: str) -> str:
    """A header field holds no white space or control characters."""
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in (value or "").encode("utf-8", "surrogatepass")) or empty


def arc_archive(name: str, pages: Iterable[tuple], version: int = 1, date: str = "19970101000000") -> bytes:
    """An ARC archive of ``(page_id, url, html)`` rows, each stored as an HTTP response; null html is an empty body."""
    info = f"{version} 0 pages\n".encode() + _TITLES[version] + b"\n\n"
    tail = b"" if version == 1 else f"200 - - 0 {name} ".encode()
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain ".encode() + tail + str(len(info)).encode() + b"\n" + info]
    at = sum(map(len, out))
    for page_id, url, html in pages:
        body = (html or "").encode("utf-8", "surrogatepass")
        who = "" if page_id is None else f"{_PAGE}: {page_id}\r\n"
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{who}Content-Length: {len(body)}\r\n\r\n".encode() + body
        line = f"{_token(url, _BLANK)} 0.0.0.0 {date} text/html "
        if version == 2:
            line += f"200 {base32_sha1(body)} - {at} {name} "
        piece = b"\n" + line.encode() + str(len(block)).encode() + b"\n" + block
        out.append(piece)
        at += len(piece)
    return b"".join(out) + b"\n"


def warc_date(value: str) -> str | None:
    """An ARC date of 4 to 14 digits (year to second) as WARC has it; null if it is no date.

    What is missing is the first month, the first day, and zero.
    """
    digits = value.strip()
    if not (digits.isascii() and digits.isdigit() and 4 <= len(digits) <= 14 and len(digits) % 2 == 0):
        return None
    try:
        day = datetime.strptime(digits + "00000101000000"[len(digits) :], "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    except ValueError:
        return None
    return f"{day.year:04d}{day.strftime('-%m-%dT%H:%M:%SZ')}"


def arc_records(data: bytes, problems: list[str]) -> Iterator[dict]:
    """The records of an ARC archive up to where it breaks; what is wrong goes to ``problems``."""
    try:
        yield from parse_arc(data)
    except ValueError as e:
        problems.append(str(e))


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC archive: header fields by its version, ``offset_here`` and ``block``.

    Raises ``ValueError`` for an unknown version, a line with too few fields, or a length beyond the end.
    """
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} does not end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not line[-1].isdigit() or len(line) < 5:
            raise ValueError(f"bad header line at {at}")
        length = int(line[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} are there")
        if version is None:
            version = int(block.split(b" ", 1)[0] or 0) if block[:1].isdigit() else 0
            if version not in FIELDS or not line[0].startswith("filedesc:"):
                raise ValueError("no version block, or an unknown version")
        else:
            names = FIELDS[version]
            if len(line) < len(names):
                raise ValueError(f"header line at {at} has {len(line)} fields, version {version} has {len(names)}")
            # a URL may hold stray spaces: fields are counted from the end
            fields = [" ".join(line[: len(line) - len(names) + 1]), *line[len(line) - len(names) + 1 :]]
            yield dict(zip(names, fields, strict=True)) | {"offset_here": at, "block": block}
        at = end + 1 + length


def _http(block: bytes) -> tuple[bytes, bytes]:
    if block[:5] == b"HTTP/":
        head, mark, body = block.partition(b"\r\n\r\n")
        if mark:
            return head + mark, body
    return b"", block


def _field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        key, mark, value = line.partition(b":")
        if mark and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


#: Stands where an archive gives no date.
NO_DATE = "1970-01-01T00:00:00Z"


def record_id(source: str, rec: dict, digest: str) -> str:
    """The name of a record: by page, address and payload where it names a page, else by its place in its archive."""
    page = _field(_http(rec["block"])[0], _PAGE)
    where = f"page {page}" if page else f"{source}#{rec['offset_here']}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{where}#{rec["url"]}#{digest}')}>"


def _page_record_id(page: int, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page}#{_token(url, _BLANK)}#{digest}')}>"


def _wrapped(lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_info(source: str, date: str = NO_DATE) -> bytes:
    """The record that opens an archive."""
    block = b"software: mnemoframe\r\nformat: WARC File Format 1.0\r\ndescription: converted from ARC\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {source}")
    return _wrapped(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {_token(source, 'archive')}", "Content-Type: application/warc-fields"], block)


def warc_record(source: str, rec: dict, refers_to: tuple[int, str | None] | None = None, problems: list[str] | None = None) -> bytes:
    """The WARC record of an ARC record: ``response`` with its whole block, or ``revisit`` with the HTTP head alone.

    ``refers_to`` is the page and the address of the response that a revisit stands for. A record whose date is none has
    ``NO_DATE`` and is reported in ``problems``.
    """
    head, body = _http(rec["block"])
    date = warc_date(rec["date"])
    if date is None:
        date = NO_DATE
        if problems is not None:
            problems.append(f"record at {rec['offset_here']}: {rec['date']!r} is no date")
    block = rec["block"] if refers_to is None else head
    kind = ("response" if head else "resource") if refers_to is None else "revisit"
    digest = base32_sha1(body)
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(source, rec, digest)}"]
    if refers_to is not None:
        page, url = refers_to
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Truncated: length", f"WARC-Refers-To: {_page_record_id(page, url, digest)}",
            f"WARC-Refers-To-Target-URI: {_token(url, _BLANK)}", f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Page: {page}",
        ]
    lines += [
        f"WARC-Date: {date}", f"WARC-Target-URI: {rec['url']}", f"WARC-IP-Address: {rec['ip']}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Type: {'application/http; msgtype=response' if head else rec['content_type']}",
    ]
    return _wrapped(lines, block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record; ``ValueError`` names the place where an archive breaks."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        length = head.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise ValueError(f"record at {at} declares no length")
        block = data[end + 4 : end + 4 + int(length)]
        if len(block) != int(length):
            raise ValueError(f"record at {at} is cut off")
        yield head, block
        at = end + 4 + int(length) + 4


def plain_bytes(data: bytes, problems: list[str]) -> bytes:
    """The bytes of an archive that may be gzipped, whole or record by record; a broken member ends it and is reported."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, rest = [], data
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(rest))
        except zlib.error as e:
            problems.append(f"gzip member at {len(data) - len(rest)}: {e}")
            break
        if not member.eof:
            problems.append(f"gzip member at {len(data) - len(rest)} is cut off")
            break
        rest = member.unused_data
    return b"".join(out)


def gzip_records(data: bytes) -> bytes:
    """A WARC archive with every record as a gzip member of its own."""
    out, at = [], 0
    for head, block in parse_warc(data):
        end = data.index(b"\r\n\r\n", at) + 8 + len(block)
        out.append(gzip.compress(data[at:end], mtime=0))
        at = end
    return b"".join(out)


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """WARC archives (``name, content, problems``) of ARC archives (``name, content``), one for one.

    Archives may be gzipped, whole or record by record.

    All payloads are kept whole. Of a broken archive the records before the break are converted; ``problems`` names the
    break, and records whose date is none. Null contents are skipped.
    """
    schema = pa.schema([("name", pa.string()), ("content", pa.binary()), ("problems", pa.list_(pa.string()))])

    def work(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is not None:
                    problems: list[str] = []
                    made = [warc_record(name or "", r, problems=problems) for r in arc_records(plain_bytes(data, problems), problems)]
                    yield record(schema, [[name], [warc_info(name or "") + b"".join(made)], [problems]])

    return archives.select(F.col("name").cast("string"), "content").mapInArrow(work, "name string, content binary, problems array<string>")


def file_name(name: str | None) -> str:
    """A file's name for an archive's name, another for every other one: all but letters, digits and ``-~`` is escaped."""
    if not name:
        return "%none" if name is None else "%empty"
    first = {".": "%2E", "_": "%5F"}.get(name[0], quote(name[0], safe=""))  # no hidden files
    return first + quote(name[1:], safe="")


def write_files(archives: DataFrame, folder: str, suffix: str = ".warc", compressed: bool = False) -> int:
    """Writes every archive (``name, content``) as a file of its own below ``folder``, a URI that all executors reach.

    A file is written under a name of its task and then moved, so a task that is run again leaves whole files. With
    ``compressed`` every record is a gzip member, and ``.gz`` follows the suffix. Returns the number of files; archives of
    one name or without content are an error.
    """
    named = archives.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count("content").alias("full")).where("n <> 1 or full <> 1")
    if not named.isEmpty():
        raise ValueError("archives need different names and contents")
    end = f"{suffix}.gz" if compressed else suffix

    def work(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{base}/.{TaskContext.get().taskAttemptId()}.part"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(gzip_records(data) if compressed else data)
                store.move(part, f"{base}/{file_name(name)}{end}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return archives.select("name", "content").mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``name, content`` of the archive files below ``folder``: names as ``write_files`` had them, contents decompressed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?(?:\.gz)?$", 1)
    name = F.when(stem == "%none", F.lit(None)).when(stem == "%empty", F.lit("")).otherwise(F.coalesce(F.try_url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))), stem))

    @F.pandas_udf("binary")
    def plain(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in contents:
            yield c.map(lambda x: plain_bytes(bytes(x), []))

    gz = F.substring("content", 1, 2) == F.lit(b"\x1f\x8b")
    rows = found.select(name.alias("name"), "content")
    return rows.where(~gz).unionByName(rows.where(gz).withColumn("content", plain("content")))


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string())])


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isascii() and value.lstrip("-").isdigit() and len(value) < 20 else None


def read_warc(archives: DataFrame) -> DataFrame:
    """One row per captured record of the WARC archives in ``content``; ``warcinfo`` records have none.

    The payload's length and digest are those of the full payload: of the block for a response, from the stored headers
    for a revisit. ``page_id`` and ``refers_to`` are null where a record names none, or no number. A payload that does not
    have its digest is an error.
    """

    def rows(data):
        for head, block in parse_warc(data):
            kind = head.get("warc-type", "")
            if kind == "warcinfo":
                continue
            http, body = _http(block)
            size = _number(_field(http, "Content-Length")) or 0 if kind == "revisit" else len(body)
            own = base32_sha1(body) if kind != "revisit" else None
            digest = head.get("warc-payload-digest", f"sha1:{own}").removeprefix("sha1:")
            if own not in (None, digest):
                raise ValueError(f"digest of {head.get('warc-record-id')} does not match")
            yield _number(_field(http, _PAGE)), size, digest, kind, _number(head.get("warc-refers-to-page")), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date")

    def work(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                found = list(rows(data)) if data else []
                if found:
                    yield record(_RECORDS, list(zip(*found, strict=True)))

    return archives.select("content").mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string")


def pages_to_warc(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """WARC archives (``name, content``) with a record for every row of ``pages`` (page_id, url, html).

    Pages go through the legacy form: a task lays its rows out as ARC archives (versions 1 and 2 in turn) and converts
    them. Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest ``page_id`` are
    responses (also if that row is repeated) and the others revisit that page; rows without an id revisit too, or are
    responses where no equal row has an id. Rows equal in id, address and payload are one capture and have one record id.
    Null html is an empty payload, a null url ``about:blank``. Other columns are not read; an empty table makes no archive.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    key, size = F.sha1(html.cast("binary")), F.octet_length(html)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), key.alias("key"))
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), key.alias("key"), F.col("url").cast("string").alias("url"), size.alias("size")).where(F.col("size") >= least_bytes)
    counted = light.groupBy("key").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = counted.where((F.col("n") > 1) & F.col("first").isNotNull()).select("key", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    revisits = light.join(first, "key").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("of_page"), F.col("key").alias("of_key"), "first", "first_url").distinct()
    # joined on page and payload, so that a payload shared by many pages is spread
    decided = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["of_page"]) & (rows["key"] == revisits["of_key"]), "left").select("page_id", "url", "html", "first", "first_url")
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def work(batches):
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def converted():
            name = f"pages-{part:05d}-{made:05d}"
            arc = arc_archive(name, [r[:3] for r in held], 1 + made % 2)
            records = [warc_record(name, rec, None if r[3] is None else r[3:5]) for rec, r in zip(parse_arc(arc), held, strict=True)]
            return record(schema, [[name], [warc_info(name) + b"".join(records)]])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= archive_bytes:
                    yield converted()
                    made, held, size = made + 1, [], 0
        if held:
            yield converted()

    return decided.mapInArrow(work, "name string, content binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(pages_to_warc(table(spark, sf_dir, "pages")), "warc")
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
