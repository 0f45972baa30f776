"""FIXTURES.md §3.4: tree paths, inode lookup, partitions and offsets."""

from pyspark.sql import functions as F

from loomlex.functions import text as X
from loomlex.sources import catalog as CT


def test_full_paths_and_inodes(spark):
    e = spark.createDataFrame([(2, 1, "", True), (3, 2, "a", True), (4, 3, "x.txt", False),
                               (5, 2, "y.pdf", False)], "inode bigint, p_inode bigint, name string, is_dir boolean")
    tree = CT.full_paths(e)
    files = sorted((r.path, r.inode) for r in CT.files_only(tree).collect())
    assert files == [("/a/x.txt", 4), ("/y.pdf", 5)]
    req = spark.createDataFrame([("/a/x.txt",), ("/none",)], "path string")
    got = {r.path: r.inode for r in CT.inode_of(req, tree).collect()}
    assert got == {"/a/x.txt": 4, "/none": -1}


ENTRY = "inode bigint, p_inode bigint, name string, is_dir boolean"


def test_cycles_and_orphans_are_flagged(spark):
    e = spark.createDataFrame([(1, 0, "", True), (2, 3, "a", True), (3, 2, "b", True), (4, 3, "below", False),
                               (5, 99, "lost", False), (6, 98, "lost", True), (7, 6, "in", False)], ENTRY)
    got = {r.inode: (r.path, r.depth, r.status) for r in CT.full_paths(e).collect()}
    assert got == {1: ("/", 0, "ok"), 2: (None, None, "cycle"), 3: (None, None, "cycle"), 4: (None, None, "cycle"),
                   5: ("/$OrphanFiles/5/lost", 0, "orphan"), 6: ("/$OrphanFiles/6/lost", 0, "orphan"),
                   7: ("/$OrphanFiles/6/lost/in", 1, "orphan")}


def test_deep_chain(spark):
    rows = [(0, -1, "", True)] + [(i, i - 1, f"d{i}", True) for i in range(1, 501)]
    tree = CT.full_paths(spark.createDataFrame(rows, ENTRY))
    last = tree.where("inode = 500").first()
    assert tree.count() == 501 and last.depth == 500 and last.status == "ok"
    assert last.path == "".join(f"/d{i}" for i in range(1, 501))


def test_flat_tree_of_over_a_million_entries(spark):
    flat = spark.range(1, 1_200_001).selectExpr("id AS inode", "0L AS p_inode", "concat('f', id) AS name", "false AS is_dir")
    root = spark.createDataFrame([(0, -1, "", True)], ENTRY)
    tree = CT.full_paths(root.unionByName(flat))
    assert tree.where("status = 'ok' AND (inode = 0 OR path = concat('/f', inode))").count() == 1_200_001


def test_keys_scope_inodes(spark):
    e = spark.createDataFrame([(0, 2, -1, "", True), (0, 3, 2, "a", False), (1, 2, -1, "", True), (1, 3, 2, "b", False)],
                              "image int, " + ENTRY)
    assert sorted((r.image, r.path) for r in CT.files_only(CT.full_paths(e, ["image"])).collect()) == [(0, "/a"), (1, "/b")]


def test_partition_catalog(spark):
    vols = spark.createDataFrame(
        [(0, "img0", 0, -1, 0, "Primary Table", True), (0, "img0", 2, 0, 63, "FAT16", True),
         (0, "img0", 3, 1, 2048, "broken", False)],
        "image_index int, image_path string, addr int, slot_num int, start bigint, desc string, fs_ok boolean")
    imgs = spark.createDataFrame([(0, "img0", "NTFS"), (1, "img1", "FAT12")],
                                 "image_index int, image_path string, fs_type string")
    parts = CT.partition_catalog(vols, imgs)
    got = sorted(tuple(r) for r in parts.collect())
    assert got == [(0, "img0", 2, 0, 63, "FAT16"), (1, "img1", 0, 0, 0, "FAT12 file system")]
    counts = {r.image_index: r.n_partitions for r in CT.partition_counts(parts).collect()}
    assert counts == {0: 1, 1: 1}
    rows = spark.createDataFrame([(0, 0)], "image_index int, partition int")
    off = CT.partition_offset(rows, parts).select(X.offset_label("offset")).first()[0]
    assert off == "32256 (0x00007e00)"


def test_file_catalog(spark):
    raw = spark.createDataFrame(
        [(0, 0, "my file.txt", 10, 33188, 4, 3, 0, 1, 2, 1, 1),
         (0, 0, "dir", 0, 16877, 3, 2, 0, 1, 2, 2, 0),
         (0, 0, "nometa", None, None, None, None, None, None, None, None, None)],
        "image_index int, partition int, name string, size bigint, mode int, addr bigint, par_addr bigint, "
        "mtime bigint, atime bigint, ctime bigint, type int, flags int")
    got = sorted((r.name, r.mtime, r.isdir, r.deleted, r.name_slug) for r in CT.file_catalog(raw).collect())
    assert got == [("dir", "1970-01-01T00:00:00Z", True, "Yes", "None"),
                   ("my file.txt", "1970-01-01T00:00:00Z", False, "No", "my%20file.txt")]


def test_image_index_and_streams(spark):
    imgs = spark.createDataFrame([(5, "b.E01"), (2, "a.E01")], "ord int, image string")
    assert {r.image: r.image_index for r in CT.image_index(imgs).collect()} == {"a.E01": 0, "b.E01": 1}
    st = spark.createDataFrame([("f", "", None), ("f", "ads", None), ("g", "", "ads"), ("g", "ads", "ads")],
                               "path string, stream string, wanted string")
    assert CT.select_stream(st).count() == 3
    got = spark.range(1).select(CT.staged_path("/stage", F.lit(1), F.lit("/a/b.txt"))).first()[0]
    assert got == "/stage/1/a/b.txt"
