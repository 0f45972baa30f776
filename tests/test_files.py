"""FIXTURES.md §3.3: scanning, extraction and byte-level filters."""

import os

import pytest
from pyspark.sql import functions as F

from loomlex.functions import text as X
from loomlex.sources import files as FS


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "d").mkdir()
    (d / "a.txt").write_bytes("café 3.14 abc123def\n".encode("utf-8"))
    (d / "d" / "b.TXT").write_bytes(b"")
    (d / "d" / "c.jpg").write_bytes(bytes([0xFF, 0xD8]))
    (d / "d" / "bad.txt").write_bytes(bytes([0x6F, 0x6B, 0x20, 0xFF, 0xFE, 0x20, 0x62, 0x61, 0x64]))
    (d / "d" / "p.html").write_bytes(b"<p>Hi <b>there</b></p>")
    (d / ".hid").write_bytes(b"x")
    return str(d)


def test_scan_and_extract(spark, folder):
    files = FS.scan_files(spark, folder)
    names = sorted(os.path.basename(r.path) for r in files.collect())
    assert names == ["a.txt", "bad.txt", "c.jpg", "p.html"]      # 0-byte and dot files skipped
    docs = FS.extract_text(files)
    got = {os.path.basename(r.path): r.text for r in docs.collect()}
    assert got["c.jpg"] is None                                   # excluded format
    assert got["p.html"] == "Hi there"
    n1 = {os.path.basename(r.path): r.t for r in docs.select("path", X.ascii_only("text").alias("t")).collect()}
    assert n1["a.txt"] == "caf 3.14 abc123def\n"
    assert n1["bad.txt"] == "ok  bad"


def test_strict_utf8_and_filters(spark, folder):
    files = FS.scan_files(spark, folder)
    ok = sorted(os.path.basename(r.path) for r in FS.strict_utf8(files).collect())
    assert "bad.txt" not in ok and "a.txt" in ok
    kept = sorted(os.path.basename(r.path) for r in FS.exclude_formats(files).collect())
    assert kept == ["a.txt", "bad.txt", "p.html"]
    ext = [r.path for r in files.where(FS.is_extractable("path")).collect()]
    assert not any(p.endswith(".jpg") for p in ext)


def test_inventory_keeps_empty_files(spark, folder):
    files = FS.scan_files(spark, folder)
    inv = spark.createDataFrame([(f"file:{folder}/d/b.TXT", 0)], "path string, length bigint")
    allf = FS.with_inventory(files, inv)
    docs = FS.drop_null_docs(FS.extract_text(allf))
    assert docs.where(F.col("path").endswith("b.TXT")).first().text == ""


def test_line_docs(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, "x")], "doc_id int, text string")
    got = sorted(tuple(r) for r in FS.line_docs(df).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (3, 0, "x")]


def test_pluggable_extractor(spark, folder):
    files = FS.scan_files(spark, folder)
    docs = FS.extract_text(files, {".jpg": lambda b: "jpeg"}, excluded=[])
    got = {os.path.basename(r.path): r.text for r in docs.collect()}
    assert got["c.jpg"] == "jpeg"


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    """A file of many splits, lines longer than a split, no final line feed, blank lines."""
    import random
    rng = random.Random(2)
    files = {"a.txt": "\n".join("x" * rng.choice([0, 1, 9, 40, 700]) + str(i) for i in range(150)) + "\n",
             "sub/b.txt": "one\n\n\ntwo", "sub/c.TXT": "\n", "d.txt": "", "e.txt": "\r\nq\rz\n" * 60}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    want = sorted((name, i, line) for name, text in files.items()
                  for i, line in enumerate(text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")) if text)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for size in ("128m", "5k", "1500"):
            for k in keys:
                spark.conf.set(k, size)
            rows = FS.read_line_docs(spark, str(tmp_path)).collect()
            got = sorted((r.path.split(tmp_path.name + "/")[1], r.line_no, r.line) for r in rows)
            assert got == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_folder_line_corpus(spark, tmp_path):
    """Text files by lines and files with an extractor whole give what whole files give."""
    for name, data in {"a.txt": b"Ab, 12 c\n\nd9!\n", "b.TXT": b"caf\xc3\xa9 1\xff", "p.html": b"<p>Hi, 4 all</p>", "skip.csv": b"x,y"}.items():
        (tmp_path / name).write_bytes(data)
    got = sorted(tuple(r) for r in FS.folder_line_corpus(spark, str(tmp_path)).collect())
    want = sorted(tuple(r) for r in FS.line_corpus(FS.scan_files(spark, str(tmp_path))).collect())
    assert got == want and len({r[0] for r in got}) == 3


def test_text_files_are_never_read_whole(spark, tmp_path):
    """A text file longer than the whole-file scan allows; only the page is read by that scan."""
    (tmp_path / "a.txt").write_bytes(b"ab 1\n" * 100)
    (tmp_path / "p.html").write_bytes(b"<p>Hi</p>")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "50")
    try:
        assert FS.folder_line_corpus(spark, str(tmp_path)).count() == 101
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_numbers_run_on_over_the_files_of_a_folder(spark, tmp_path):
    rows = [(lang, i, f"{lang}{i}\n{i}") for lang in "xy" for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, doc_id bigint, text string")
    docs.repartitionByRange(7, "lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "text") \
        .write.partitionBy("lang").text(str(tmp_path / "f"))
    assert len(list((tmp_path / "f").glob("lang=*/*.txt"))) > 2
    want = sorted((lang, 2 * i + j, f"{lang}{i}" if j == 0 else str(i)) for lang, i, _ in rows for j in (0, 1))
    got = FS.read_line_docs(spark, str(tmp_path / "f"), parts=True).collect()
    assert sorted((r.path[-1], r.line_no, r.line) for r in got) == want
    whole = FS.folder_line_corpus(spark, str(tmp_path / "f"), parts=True).collect()
    assert {r.path[-6:] for r in whole} == {"=x.txt", "=y.txt"}
    assert sorted((r.path[-5], r.line_no, r.line) for r in whole) == sorted((p, n, line.strip("0123456789")) for p, n, line in want)
