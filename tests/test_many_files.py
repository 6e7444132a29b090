"""A file for each page without a task, a process or room in the driver for each (F1, F2)."""

import hashlib
import os

import pytest

from mnemoframe.plans import catalog, texts
from mnemoframe.sources import files

BOTH = pytest.mark.parametrize("name", ["a01_scan_files", "a02_watch_files"])


def seen(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return sorted(map(tuple, catalog.CATALOG[name][0](spark, str(tmp_path)).collect()), key=str)


def want(rows):
    data = [(k, None if h is None else f"{h}\n".encode()) for k, h in rows]
    return sorted(((None if k is None else f"page_id={k}", None if b is None else len(b), None if b is None else hashlib.sha256(b).hexdigest()) for k, b in data), key=str)


@BOTH
def test_driver_lists_a_part_of_the_files(spark, tmp_path, monkeypatch, name):
    """of 300 files at most about 40 are listed at once, by a scan or by a stream."""
    monkeypatch.setattr(texts, "TOGETHER", 40, raising=False)
    monkeypatch.setattr(texts, "A_TASK", 10, raising=False)
    at_once = []
    for kind in ("scan_files", "watch_files"):

        def counted(spark, dirs, f=getattr(files, kind)):
            at_once.append(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(dirs).count())
            return f(spark, dirs)

        monkeypatch.setattr(files, kind, counted)
    rows = [(k, f"<p>{k % 9}</p>") for k in range(300)]
    assert seen(spark, tmp_path, name, rows) == want(rows)
    assert sum(at_once) == 300 and max(at_once) <= 80


@BOTH
def test_tasks_serve_many_files(spark, tmp_path, monkeypatch, name):
    """600 files take fewer tasks in all steps, and no checksum file is written beside each."""
    sc, new_array = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway.new_array
    folders, found = [], []

    def tasks():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).numCompleteTasks() for i in range(stages.size()))

    for kind in ("scan_files", "watch_files"):

        def looked(spark, dirs, f=getattr(files, kind)):
            folders.append((dirs if isinstance(dirs, str) else dirs[0]).removeprefix("file://"))
            found.extend(n for _, _, names in os.walk(folders[-1]) for n in names)
            return f(spark, dirs)

        monkeypatch.setattr(files, kind, looked)
    rows = [(k, f"<p>{k % 9}</p>") for k in range(600)]
    before = tasks()
    assert seen(spark, tmp_path, name, rows) == want(rows)
    assert tasks() - before < 300
    assert len([n for n in found if not n.startswith(("_", "."))]) == 600
    assert len([n for n in found if n.endswith(".crc")]) < 10


@BOTH
@pytest.mark.parametrize("local", [True, False])
def test_odd_pages_have_files_of_their_own(spark, tmp_path, monkeypatch, name, local):
    """Repeated and missing ids, pages without text or without html, by Python and by Spark's writer."""
    if not local:
        monkeypatch.setattr(files, "_local", lambda spark, folder: None)
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "é\nx"), (3, ""), (4, None), (None, "c"), (None, "c"), (None, None), (-5, "d" * 70000)]
    assert seen(spark, tmp_path, name, rows) == want(rows)


@BOTH
@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_no_pages_give_no_files(spark, tmp_path, name, rows):
    assert seen(spark, tmp_path, name, rows) == want(rows)


def test_settings_come_back(spark):
    names = ["spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes", "spark.sql.hive.filesourcePartitionFileCacheSize", "spark.sql.files.minPartitionNum"]
    before = [spark.conf.get(k, None) for k in names]
    with pytest.raises(ValueError), files.many_files(spark):
        assert all(spark.conf.get(k, None) != v for k, v in zip(names, before, strict=True))
        raise ValueError
    assert [spark.conf.get(k, None) for k in names] == before
