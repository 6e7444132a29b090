"""op8: archives written and read back, against a loop."""

import base64
import gzip
import hashlib

import pytest
from mnemoframe.llm import warc as w
from pyspark.sql import functions as F


def expected(pages, least=0):
    groups = {}
    for i, _, html in pages:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        ids = [x for x in groups[data] if x is not None]
        to = max(ids) if ids and len(data) >= least and len(groups[data]) > 1 else i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to == i else "revisit", None if to == i else to))
    return sorted(out, key=str)


def test_query_equals_a_loop(spark, small):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted(map(tuple, w.op8_warc(spark, small).collect()), key=str) == expected(pages)


@pytest.mark.parametrize("least", [0, 2])
def test_nulls_repeats_and_odd_payloads(spark, least):
    pages = [(1, "http://a/ b\n", "x\r\n\r\ny"), (2, None, "x\r\n\r\ny"), (None, "u", "x\r\n\r\ny"), (3, "u", None), (4, "u", ""), (5, "é", "é\n1 2 3 4 5\n"), (5, "é", "é\n1 2 3 4 5\n"), (None, "v", "only"), (None, "v", "only"), (9, "w", "WARC/1.0\r\n\r\n"), (6, "big", "z" * 600_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, key long").withColumn("first", F.lit(1)).withColumn("n", F.lit("x"))
    got = w.read_warc(w.pages_to_warc(df, least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages, least)
    assert w.read_warc(w.pages_to_warc(df.limit(0))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_conversion_keeps_payloads(spark, version):
    pages = [(1, "http://a/", "one\n\ntwo"), (2, "http://b/", ""), (None, "http://c/", "é")]
    arc = w.arc_archive("old.arc", pages, version, "19961203120405")
    records = list(w.parse_arc(arc))
    assert [r["url"] for r in records] == ["http://a/", "http://b/", "http://c/"] and all(int(r["length"]) == len(r["block"]) for r in records)
    assert ("checksum" in records[0]) == (version == 2)
    rows = w.read_warc(w.arc_to_warc(spark.createDataFrame([("old.arc", arc), ("none", None)], "name string, content binary"))).collect()
    assert [(r.page_id, r.payload_bytes, r.target_uri, r.date) for r in rows] == [(1, 8, "http://a/", "1996-12-03T12:04:05Z"), (2, 0, "http://b/", "1996-12-03T12:04:05Z"), (None, 2, "http://c/", "1996-12-03T12:04:05Z")]
    again = w.read_warc(w.arc_to_warc(spark.createDataFrame([("old.arc", arc)], "name string, content binary"))).collect()
    assert [r.record_id for r in rows] == [r.record_id for r in again] and len({r.record_id for r in rows}) == 3


def test_broken_archives_are_reported(spark):
    arc = w.arc_archive("x", [(1, "u", "abc"), (2, "v", "def")])
    cases = {"cut": arc[:-4], "version": arc.replace(b"1 0 pages", b"7 0 pages"), "text": b"nonsense\n"}
    for bad in cases.values():
        with pytest.raises(ValueError):
            list(w.parse_arc(bad))
    out = w.arc_to_warc(spark.createDataFrame(list(cases.items()), "name string, content binary"))
    kept = {r.name: r for r in out.collect()}
    assert all(len(r.problems) == 1 for r in kept.values())
    assert [r.page_id for r in w.read_warc(out).collect()] == [1]
    whole = w.warc_info("a") + w.warc_record("a", next(w.parse_arc(arc)))
    for bad in (whole.replace(b"Content-Length", b"Content-Size"), whole.replace(b"Content-Length: ", b"Content-Length: x"), whole[:-9], b"WARC/1.0"):
        with pytest.raises(ValueError):
            list(w.parse_warc(bad))
    assert [h["warc-type"] for h, _ in w.parse_warc(whole.replace(b"WARC-Type: ", b"warc-type:"))] == ["warcinfo", "response"]


@pytest.mark.parametrize(
    ("arc", "date"),
    [
        ("1997", "1997-01-01T00:00:00Z"), ("199702", "1997-02-01T00:00:00Z"), ("19970203", "1997-02-03T00:00:00Z"), ("1997020304", "1997-02-03T04:00:00Z"), ("199702030405", "1997-02-03T04:05:00Z"),
        ("19970203040506", "1997-02-03T04:05:06Z"), ("19970230", None), ("199713", None), ("97", None), ("19970", None), ("199702030405061", None), ("-", None), ("", None), ("0000", None), ("１９９７", None),
    ],
)
def test_dates(arc, date):
    assert w.warc_date(arc) == date
    problems = []
    rec = {"url": "u", "ip": "0", "date": arc, "content_type": "text/html", "offset_here": 5, "block": b"x"}
    ((head, _),) = w.parse_warc(w.warc_record("a", rec, problems=problems))
    assert head["warc-date"] == (date or w.NO_DATE) and len(problems) == (date is None)


def test_revisits_name_their_response(spark):
    pages = [(1, "http://a/", "same"), (7, "http://b/", "same"), (3, None, "other"), (4, "http://c/", "other")]
    archives = w.pages_to_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    heads = [h for r in archives for h, _ in w.parse_warc(bytes(r.content))]
    assert heads[0]["warc-type"] == "warcinfo" and len(heads) == 4 + len(archives)
    by_id = {h["warc-record-id"]: h for h in heads}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 2
    for h in revisits:
        to = by_id[h["warc-refers-to"]]
        assert to["warc-type"] == "response" and (to["warc-target-uri"], to["warc-date"], to["warc-payload-digest"]) == (h["warc-refers-to-target-uri"], h["warc-refers-to-date"], h["warc-payload-digest"])


def test_files_round_trip(spark, tmp_path):
    arcs = [(f"a/{k}", w.arc_archive(str(k), [(k, "u", "x" * k)], 1 + k % 2)) for k in range(3)]
    df = spark.createDataFrame(arcs, "name string, content binary")
    assert w.write_files(df, f"file://{tmp_path}/arc", ".arc") == 3
    back = w.read_files(spark, f"{tmp_path}/arc")
    assert sorted((r.name, bytes(r.content)) for r in back.collect()) == sorted(arcs)
    assert w.write_files(w.arc_to_warc(back), f"file://{tmp_path}/warc") == 3
    assert sorted(r.page_id for r in w.read_warc(w.read_files(spark, f"{tmp_path}/warc")).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        w.write_files(df.unionAll(df), f"file://{tmp_path}/twice")


def test_names_that_differ_make_files_that_differ(spark, tmp_path):
    names = ["a/b", "a%2Fb", "a b", "a%20b", "a+b", "é", ".hidden", "_hidden", "", "x.y", "x.gz", "archive", "%none"]
    df = spark.createDataFrame([(n, n.encode() or b"-") for n in names], "name string, content binary")
    assert w.write_files(df, f"file://{tmp_path}/n") == len(names) == len({w.file_name(n) for n in names})
    assert sorted((r.name, bytes(r.content)) for r in w.read_files(spark, f"{tmp_path}/n").collect()) == sorted((n, n.encode() or b"-") for n in names)


def test_gzipped_archives(spark, tmp_path):
    arc = w.arc_archive("x", [(k, f"u{k}", "text " * k) for k in range(4)])
    cuts = [0, *sorted(r["offset_here"] for r in w.parse_arc(arc)), len(arc)]
    by_record = b"".join(gzip.compress(arc[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    rows = [("plain", arc), ("whole", gzip.compress(arc)), ("records", by_record), ("broken", by_record[:-20]), ("bad", by_record[:-20] + b"x" * 20)]
    made = {r.name: r for r in w.arc_to_warc(spark.createDataFrame(rows, "name string, content binary")).collect()}
    pages = lambda c: [h.get("warc-target-uri") for h, _ in w.parse_warc(bytes(c))][1:]
    assert pages(made["plain"].content) == pages(made["whole"].content) == pages(made["records"].content) == [f"u{k}" for k in range(4)]
    assert not made["whole"].problems and not made["records"].problems
    for name in ("broken", "bad"):
        assert pages(made[name].content)[:3] == ["u0", "u1", "u2"] and "gzip member" in made[name].problems[0]
    warcs = spark.createDataFrame([(n, bytes(made[n].content)) for n in ("plain", "whole")], "name string, content binary")
    assert w.write_files(warcs, f"file://{tmp_path}/gz", compressed=True) == 2
    back = w.read_files(spark, f"{tmp_path}/gz")
    assert sorted((r.name, bytes(r.content)) for r in back.collect()) == sorted((r.name, bytes(r.content)) for r in warcs.collect())
    assert all(p.name.endswith(".warc.gz") for p in (tmp_path / "gz").iterdir() if not p.name.startswith("."))
    assert w.read_warc(back).count() == 8


def test_numbers_that_are_none(spark):
    arc = w.arc_archive("x", [(1, "u", "abc")]).replace(b"X-Page-Id: 1", b"X-Page-Id: l")
    (row,) = w.read_warc(w.arc_to_warc(spark.createDataFrame([("x", arc)], "name string, content binary"))).collect()
    assert row.page_id is None and row.payload_bytes == 3
