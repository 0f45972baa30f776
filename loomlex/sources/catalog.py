"""File and partition catalogs as ordinary tables: S6, S7, S8, A6, J5, J6,
J7, T1, W3, F9, F10, K7.

Disk images are not decoded here; a catalog starts from tables of raw
entries and volumes (one row per directory entry / volume slot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlex.functions import text as X
from loomlex.functions.constants import SECTOR_BYTES
from loomlex.operators.ids import dense_ids
from loomlex.operators.joins import join_bounded
from loomlex.session import stage_table

_META = ["size", "mode", "addr", "mtime", "atime", "ctime", "type", "flags"]


def file_catalog(raw_entries: DataFrame) -> DataFrame:
    """Entries that have metadata, with the 11 catalog columns."""
    r = raw_entries.where(F.coalesce(*[F.col(c).cast("bigint") for c in _META]).isNotNull())
    keep = [c for c in ("image_index", "partition") if c in raw_entries.columns]
    return r.select(
        *keep,
        F.col("name"), F.col("size").cast("bigint").alias("size"), F.col("mode"),
        F.col("addr").cast("bigint").alias("inode"), F.col("par_addr").cast("bigint").alias("p_inode"),
        X.iso_utc("mtime").alias("mtime"), F.col("atime").cast("bigint").alias("atime"),
        F.col("ctime").cast("bigint").alias("ctime"), X.is_dir("type").alias("isdir"),
        X.deleted_flag("flags").alias("deleted"), X.name_slug("name").alias("name_slug"))


def partition_catalog(volumes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Valid partitions (``slot_num >= 0`` and an openable file system);
    an image without any partition table gives one whole-image row
    ``(addr 0, slot 0, start 0, fs description)``.

    ``images`` = (image_index, image_path, fs_type) lists every image."""
    parts = volumes.where((F.col("slot_num") >= 0) & F.col("fs_ok")).select(
        "image_index", "image_path", F.col("addr").cast("int").alias("addr"),
        F.col("slot_num").cast("int").alias("slot_num"),
        F.col("start").cast("bigint").alias("start_offset"), F.col("desc"))
    if images is None:
        return parts
    no_table = images.join(volumes.select("image_index").distinct(), "image_index", "left_anti")
    whole = no_table.select("image_index", "image_path", F.lit(0).alias("addr"),
                            F.lit(0).alias("slot_num"), F.lit(0).cast("bigint").alias("start_offset"),
                            X.fs_desc("fs_type").alias("desc"))
    return parts.unionByName(whole)


def partition_counts(parts: DataFrame) -> DataFrame:
    """Partitions per image (the whole-image row counts as one)."""
    return parts.groupBy("image_index").agg(F.count(F.lit(1)).alias("n_partitions"))


def partition_offset(df: DataFrame, parts: DataFrame, part_col: str = "partition") -> DataFrame:
    """Add the byte offset (``start * 512``) of each row's partition."""
    p = parts.select("image_index", F.col("slot_num").alias(part_col),
                     (F.col("start_offset") * F.lit(SECTOR_BYTES)).alias("offset"))
    return join_bounded(df, p, ["image_index", part_col], "inner")


def order_volumes(df: DataFrame, col: str = "volume_id") -> DataFrame:
    """Volumes in identifier (string) order."""
    return df.orderBy(F.col(col).cast("string"))


def image_index(images: DataFrame, ord_col: str = "ord") -> DataFrame:
    """0-based image index by configuration order."""
    return dense_ids(images, [ord_col], "image_index")


def files_only(df: DataFrame, dir_col: str = "is_dir") -> DataFrame:
    """directories are recursed, not emitted."""
    return df.where(~F.col(dir_col))


def select_stream(df: DataFrame) -> DataFrame:
    """if a path names a stream, keep only that stream
    (``streams`` = path, stream, wanted)."""
    return df.where(F.col("wanted").isNull() | (F.col("stream") == F.col("wanted")))


def staged_path(staging: str, image_idx: Column | str, path: Column | str) -> Column:
    """K7: ``<staging>/<image_index>/<path>``."""
    i = F.col(image_idx) if isinstance(image_idx, str) else image_idx
    p = F.col(path) if isinstance(path, str) else path
    return F.concat_ws("/", F.lit(staging.rstrip("/")), i.cast("string"), F.regexp_replace(p, "^/+", ""))


ORPHANS = "/$OrphanFiles"


def full_paths(entries: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Full path of every entry, by doubling the distance to an ancestor.

    ``entries`` = (inode, p_inode, name, is_dir [, key_cols...]); ``key_cols``
    (e.g. image, partition) scope the inode numbers.  A root has no parent
    number (null, negative or its own) or has an empty name and no parent entry.
    Returns every entry once, with ``path``, ``depth`` and ``status``:

    * ``ok``: below a root;
    * ``orphan``: below an entry whose parent is missing; that entry's path is
      ``/$OrphanFiles/<inode>/<name>``, so orphans never share a path with a root;
    * ``cycle``: on or below a parent cycle; path and depth are null.

    Only directories (inodes that are some entry's parent) take part in the
    rounds: in each, a directory's pointer jumps to its ancestor's ancestor and
    the paths are joined, so a tree of depth d takes log2(d) rounds.  A round
    that brings no directory to its top leaves only cycles.
    """
    keys = list(key_cols or [])
    rows = entries.select(*keys, "inode", "p_inode", "name", "is_dir")
    ids = rows.select(*keys, F.col("inode").alias("p_inode"), F.lit(True).alias("_has")).distinct()
    name = F.coalesce("name", F.lit(""))
    own = (F.col("p_inode").isNull() | (F.col("p_inode") < 0) | (F.col("p_inode") == F.col("inode"))
           | (F.col("_has").isNull() & (name == "")))
    status = F.when(own, "ok").when(F.col("_has").isNull(), "orphan")
    rows = rows.join(ids, [*keys, "p_inode"], "left").withColumn("status", status).select(
        *keys, "inode", "p_inode", "name", "is_dir", "status",
        F.when(F.col("status").isNull(), F.col("p_inode")).alias("up"),
        F.when(F.col("status") == "ok", "")
        .when(F.col("status") == "orphan", F.concat(F.lit(ORPHANS + "/"), F.col("inode").cast("string"), F.lit("/"), name))
        .otherwise(F.concat(F.lit("/"), name)).alias("path"),
        F.when(F.col("status").isNull(), 1).otherwise(0).alias("depth"))
    rows = stage_table(rows, "paths-entries")
    parents = rows.where("up IS NOT NULL").select(*keys, F.col("up").alias("inode")).distinct()
    state = F.struct("up", "path", "depth", "status")
    # an inode listed several times has one path as a parent: the smallest
    dirs = stage_table(rows.join(parents, [*keys, "inode"], "left_semi").groupBy(*keys, "inode")
                       .agg(F.min(state).alias("_s")).select(*keys, "inode", "_s.*"), "paths-dirs")
    left = dirs.where("up IS NOT NULL").count()
    while left:
        above = dirs.select(*keys, F.col("inode").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"),
                            F.col("depth").alias("depth2"), F.col("status").alias("status2"))
        moved = dirs.where("up IS NOT NULL").join(above, [*keys, "up"]).select(
            *keys, "inode", F.col("up2").alias("up"), F.concat("path2", "path").alias("path"),
            (F.col("depth") + F.col("depth2")).alias("depth"), F.col("status2").alias("status"))
        dirs = stage_table(dirs.where("up IS NULL").unionByName(moved), "paths-dirs")
        before, left = left, dirs.where("up IS NOT NULL").count()
        if left == before:
            break
    top = dirs.where("up IS NULL").select(*keys, F.col("inode").alias("up"), F.col("path").alias("_path"),
                                          F.col("depth").alias("_depth"), F.col("status").alias("_status"))
    out = rows.join(top, [*keys, "up"], "left")
    path = F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("_path", "path"))
    return out.select(
        *keys, "inode", "p_inode", "name", "is_dir", F.when(path == "", "/").otherwise(path).alias("path"),
        F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.col("_depth") + F.col("depth")).alias("depth"),
        F.coalesce("status", "_status", F.lit("cycle")).alias("status"))


def inode_of(paths: DataFrame, tree: DataFrame, path_col: str = "path") -> DataFrame:
    """Inode for each requested path, -1 when the path does not exist; the
    smallest inode if entries (say, a deleted and a live one) share a path."""
    t = tree.where(F.col("path").isNotNull()).groupBy(F.col("path").alias(path_col)).agg(F.min("inode").alias("inode"))
    return paths.join(t, path_col, "left").withColumn("inode", F.coalesce("inode", F.lit(-1).cast("bigint")))


def url_tree(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Entries of the folder tree spelled by URL paths (host/seg/...):
    one entry per distinct prefix, inode = rank of the prefix, the root is
    the empty prefix.  Columns: inode, p_inode, name, is_dir, key."""
    path = F.regexp_replace(F.regexp_replace(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""),
                            r"[?#].*$", "")
    segs = F.filter(F.split(path, "/"), lambda s: s != F.lit(""))
    pre = pages.select(segs.alias("segs")).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("segs"), F.lit(1))),
        lambda i: F.array_join(F.slice("segs", 1, i), "/"))).alias("key"))
    keys = pre.where(F.col("key") != "").unionByName(
        pages.sparkSession.range(1).select(F.lit("").alias("key"))).distinct()
    keys = keys.withColumn("parent", F.when(F.col("key").contains("/"),
                                            F.regexp_replace("key", "/[^/]*$", "")).otherwise(
        F.when(F.col("key") == "", F.lit(None)).otherwise(F.lit(""))))
    ids = dense_ids(keys, ["key"], "inode")
    parents = ids.select(F.col("key").alias("parent"), F.col("inode").alias("p_inode"))
    has_child = ids.select(F.col("parent").alias("key")).where(F.col("key").isNotNull()).distinct() \
        .withColumn("is_dir", F.lit(True))
    e = ids.join(parents, "parent", "left").join(has_child, "key", "left")
    return e.select("inode", F.coalesce("p_inode", F.lit(-1).cast("bigint")).alias("p_inode"),
                    F.substring_index("key", "/", -1).alias("name"),
                    F.coalesce("is_dir", F.lit(False)).alias("is_dir"), "key")
