"""Composite jobs on fixture-shaped catalog tables (C2, C5) and the
remaining unit-checked operators (T1, F7, F16, U2)."""

import os

from pyspark.sql import functions as F

from loomlex.plans.jobs import catalog_job, folder_topic_job, list_files
from loomlex.sources import catalog as CT
from loomlex.sources import files as FS

ENTRY_SCHEMA = ("image_index int, partition int, inode bigint, p_inode bigint, name string, is_dir boolean")


def _catalog(spark):
    entries = spark.createDataFrame(
        [(0, 0, 2, 1, "", True), (0, 0, 3, 2, "a", True), (0, 0, 4, 3, "x.txt", False),
         (0, 0, 5, 2, "y.pdf", False), (1, 0, 2, 1, "", True), (1, 0, 7, 2, "z.txt", False)], ENTRY_SCHEMA)
    vols = spark.createDataFrame([(0, "/img/a.E01", 2, 0, 63, "FAT16", True)],
                                 "image_index int, image_path string, addr int, slot_num int, start bigint, "
                                 "desc string, fs_ok boolean")
    imgs = spark.createDataFrame([(0, "/img/a.E01", "NTFS"), (1, "/img/b.E01", "FAT12")],
                                 "image_index int, image_path string, fs_type string")
    return entries, vols, imgs


def test_list_files(spark):
    entries, vols, imgs = _catalog(spark)
    got = [tuple(r) for r in list_files(entries, vols, imgs).collect()]
    assert got == [(0, 0, "/a/x.txt", "a.E01_filelist_0"), (0, 0, "/y.pdf", "a.E01_filelist_0"),
                   (1, 0, "/z.txt", "b.E01_filelist_0")]


def test_catalog_job(spark, tmp_path):
    entries, vols, imgs = _catalog(spark)
    raw = entries.select("image_index", "partition", "name", F.lit(10).cast("bigint").alias("size"),
                         F.lit(33188).alias("mode"), F.col("inode").alias("addr"),
                         F.col("p_inode").alias("par_addr"), F.lit(0).cast("bigint").alias("mtime"),
                         F.lit(0).cast("bigint").alias("atime"), F.lit(0).cast("bigint").alias("ctime"),
                         F.when(F.col("is_dir"), 2).otherwise(1).alias("type"), F.lit(1).alias("flags"))
    (tmp_path / "0" / "a").mkdir(parents=True)
    (tmp_path / "1").mkdir()
    (tmp_path / "0" / "a" / "x.txt").write_text("cat sat cat dog")
    (tmp_path / "1" / "z.txt").write_text("cat dog sat sat")
    (tmp_path / "1" / "not_listed.txt").write_text("zebra zebra zebra")
    staged = FS.scan_images(spark, str(tmp_path), imgs)
    assert sorted(r.image_index for r in staged.collect()) == [0, 1, 1]
    out = catalog_job(raw, vols, imgs, staged, k=2, max_iter=2, stop_words=[], with_map=False)
    assert sorted(r.path for r in out["files"].collect()) == ["/a/x.txt", "/y.pdf", "/z.txt"]
    assert sorted(r.offset for r in out["files"].collect()) == [0, 63 * 512, 63 * 512]
    assert out["documents"].count() == 2      # the catalog, not the folder, chooses the files
    assert out["corpus"].vocab_size == 3
    assert out["topic_terms"].select("topic").distinct().count() == 2


def test_folder_job(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("cat sat cat dog")
    (tmp_path / "sub" / "b.html").write_bytes(b"<p>cat dog &amp; caf&eacute; sat sat</p>")
    (tmp_path / "latin.html").write_bytes(b"<p>cat caf\xe9 sat dog</p>")      # not UTF-8: must not end the job
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8")
    (tmp_path / "empty.txt").write_bytes(b"")
    inv = spark.createDataFrame([(f"file:{tmp_path}/empty.txt", 0)], "path string, length bigint")
    out = folder_topic_job(spark, str(tmp_path), inv, k=2, max_iter=2, stop_words=[], with_map=False)
    texts = {os.path.basename(r.path): r.text for r in out["documents"].collect()}
    assert texts == {"a.txt": "cat sat cat dog", "b.html": "cat dog & caf\u00e9 sat sat",
                     "latin.html": "cat caf\u00e9 sat dog", "empty.txt": ""}
    assert out["doc_topics"].select("doc_id").distinct().count() == 4      # the empty document too


def test_small_filters(spark):
    vols = spark.createDataFrame([("p10",), ("p2",), ("p1",)], "volume_id string")
    assert [r.volume_id for r in CT.order_volumes(vols).collect()] == ["p1", "p10", "p2"]
    files = spark.createDataFrame([("a.txt", 0), ("b.txt", 3), ("c.txt.span", 5)], "path string, length bigint")
    assert [r.path for r in FS.drop_empty_files(files).collect()] == ["b.txt", "c.txt.span"]
    assert [r.path for r in FS.skip_outputs(files).collect()] == ["a.txt", "b.txt"]
