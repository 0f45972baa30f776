"""Scans and text extraction: S1-S3, S5, S9, N8, F4-F8, F16, U2.

Files are read with Spark's ``binaryFile`` source, so listing, splitting and
reading are distributed; filters on ``path``/``length`` are applied before
``content`` is touched.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlex.functions import text as X
from loomlex.functions.constants import (CONFIG_EXCLUDE_FORMATS, EXTRACTABLE_SUFFIXES,
                                         MARKUP_SUFFIXES)
from loomlex.operators.joins import join_bounded
from loomlex.session import ship_package, stage_table

TEXT_SUFFIXES = [".txt", ".TXT"]


def scan_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Recursive directory scan, one row per file at any depth:
    ``(path, modificationTime, length, content)``.

    Spark's file source skips 0-byte files and names starting with ``.`` or
    ``_``; pass an inventory to :func:`with_inventory` to keep them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    paths = [path] if isinstance(path, str) else list(path)
    return reader.load(paths)


def scan_images(spark: SparkSession, staging: str, images: DataFrame) -> DataFrame:
    """One scan over every staged image folder ``<staging>/<image_index>``
    keeping the image index as a column (no per-image loop)."""
    root = staging.rstrip("/") + "/"
    df = scan_files(spark, root)
    inside = F.expr("substring(path, instr(path, _root) + length(_root))")
    df = df.withColumn("_root", F.lit(root)).withColumn("_in", inside) \
        .withColumn("image_index", F.expr("try_cast(substring_index(_in, '/', 1) AS int)")).drop("_root", "_in")
    return join_bounded(df, images.select("image_index").distinct(), "image_index", "left_semi")


def with_inventory(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Re-add files the scan cannot return (0-byte, hidden) from an
    inventory ``(path, length)``: they become empty documents."""
    missing = inventory.join(files.select("path"), "path", "left_anti")
    return files.unionByName(missing.select(
        "path", F.lit(None).cast("timestamp").alias("modificationTime"),
        F.col("length").cast("bigint"), F.lit(b"").cast("binary").alias("content")))


# ------------------------------------------------------------ filters

def ext_col(path: Column | str = "path") -> Column:
    return X.file_ext(X.basename(path))


def exclude_formats(df: DataFrame, exts: list[str] | DataFrame = CONFIG_EXCLUDE_FORMATS,
                    apply_to_text: bool = False, path_col: str = "path") -> DataFrame:
    """Drop files whose exact (case-sensitive) extension is excluded;
    ``.txt``/``.TXT`` files bypass the check unless ``apply_to_text``."""
    p = F.col(path_col)
    is_text = F.lit(False) if apply_to_text else \
        F.greatest(*[p.endswith(s) for s in TEXT_SUFFIXES])
    with_ext = df.withColumn("_ext", ext_col(p))
    if isinstance(exts, DataFrame):
        ex = exts.select(F.col("ext").alias("_ext"))
        kept = join_bounded(with_ext, ex, "_ext", "left_anti")
        text_rows = with_ext.where(is_text)
        return kept.where(~is_text).unionByName(text_rows).drop("_ext")
    return with_ext.where(is_text | ~F.col("_ext").isin(list(exts))).drop("_ext")


def is_extractable(path: Column | str = "path",
                   excluded: list[str] = CONFIG_EXCLUDE_FORMATS) -> Column:
    """accepted suffix, and extension not excluded (no text bypass)."""
    p = F.col(path) if isinstance(path, str) else path
    accepted = F.greatest(*[p.endswith(s) for s in EXTRACTABLE_SUFFIXES])
    return accepted & ~ext_col(p).isin(list(excluded))


def drop_null_docs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """drop NULL documents; empty strings stay."""
    return df.where(F.col(text_col).isNotNull())


def drop_empty_files(df: DataFrame) -> DataFrame:
    """drop zero-byte files."""
    return df.where(F.col("length") > 0)


def drop_empty_docs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """F8: drop empty extractions."""
    return df.where(F.length(text_col) > 0)


def skip_outputs(df: DataFrame, path_col: str = "path") -> DataFrame:
    """F16: ignore previously written span outputs."""
    return df.where(~F.col(path_col).endswith(".span"))


def strict_utf8(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Keep rows whose bytes are present and valid UTF-8, decoded."""
    c = F.col(content_col)
    return df.where(c.isNotNull() & X.is_valid_utf8(c)) \
        .withColumn("text", c.cast("string"))


# ------------------------------------------------------------ extraction

def read_text_docs(df: DataFrame) -> DataFrame:
    """Plain-text files as documents; bytes are decoded one byte per
    character (ISO-8859-1), N1 later drops the non-ASCII ones."""
    return df.withColumn("text", F.decode("content", "ISO-8859-1"))


Extractor = Callable[[bytes], str]


def extract_text(df: DataFrame, extractors: dict[str, Extractor] | None = None,
                 excluded: list[str] = CONFIG_EXCLUDE_FORMATS) -> DataFrame:
    """S3: per-file text by extension; any failure gives a NULL document.

    Text files decode natively; HTML/XML go through :func:`html_to_text`
    natively (bytes that are not UTF-8 are read as ISO-8859-1, so no page can
    end the job); only files of other extensions reach a pluggable extractor, run
    in ``mapInPandas`` with a per-file try/except (no extractor -> NULL).
    Excluded formats (F4) give NULL and are not handed to any decoder."""
    p = F.col("path")
    ext = ext_col(p)
    is_text = F.greatest(*[p.endswith(s) for s in TEXT_SUFFIXES])
    is_markup = F.greatest(*[p.endswith(s) for s in MARKUP_SUFFIXES])
    excluded_c = ~is_text & ext.isin(list(excluded))
    native = (F.when(excluded_c, F.lit(None).cast("string"))
              .when(is_text, F.decode("content", "ISO-8859-1"))
              .when(is_markup, X.html_to_text(X.decode_text("content"))))
    out = df.withColumn("text", native).withColumn("_plug", ~excluded_c & ~is_text & ~is_markup)
    if not extractors:
        return out.drop("_plug")
    ship_package(df.sparkSession)
    table = dict(extractors)
    schema = out.schema

    def run(batches):
        for pdf in batches:
            texts = []
            for e, content in zip(pdf["_ext"], pdf["content"], strict=True):
                fn = table.get(e)
                try:
                    texts.append(None if fn is None else fn(bytes(content)))
                except Exception:  # noqa: BLE001 - a failed extraction is a NULL doc
                    texts.append(None)
            pdf["text"] = pd.Series(texts, dtype="object")
            yield pdf.drop(columns=["_ext"])

    plugged = out.where("_plug").withColumn("_ext", ext).mapInPandas(run, schema)
    return out.where("NOT _plug").unionByName(plugged).drop("_plug")


# ------------------------------------------------------------ line documents

def split_lines(text: Column | str) -> Column:
    """Lines of a text as file iteration yields them (no trailing empty
    line after a final newline)."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(t, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)) \
        .otherwise(parts)


def line_docs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """S5 on tables: one row per line ``(id, line_no, line)``."""
    return df.select(F.col(id_col), F.posexplode(split_lines(text_col)).alias("line_no", "line"))


def read_line_docs(spark: SparkSession, path: str | list[str], pattern: str | None = None,
                   parts: bool = False) -> DataFrame:
    """S5 on files: ``(path, line_no, line)``, one row per line, numbered from 0 within its
    file; files are found at any depth.  With ``parts`` a folder is one document, as
    Spark writes it: ``path`` is the folder and its files are numbered on in name order.

    A large file is read as several splits, and only the split knows where a row
    came from.  The lines are staged once with their file, the split's first byte and
    their place in the split; the lines of a file's earlier splits, summed, are what a
    split's numbers start from.  Only one row per split is ever ordered.  A line ends
    with a line feed; a byte order mark at the start of a file is dropped."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text([path] if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    lines = stage_table(lines, "lines")
    splits = lines.groupBy("path", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = F.regexp_replace("path", "/[^/]*$", "") if parts else F.col("path")
    earlier = Window.partitionBy(whole).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = splits.select("path", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    # one row per split: grows with files, so it is measured before it is sent around
    return join_bounded(lines, start, ["path", "block"]).select(
        whole.alias("path"), (F.col("place") + F.col("shift")).alias("line_no"), "line")


def line_corpus(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Skip empty files, keep extractable types, extract, delete
    punctuation and digits, name as ``.txt``, split into lines."""
    f = drop_empty_files(files).where(is_extractable("path"))
    t = drop_empty_docs(drop_null_docs(extract_text(f, extractors)))
    t = t.select(X.to_txt("path").alias("path"),
                 X.remove_digits(X.remove_punctuation("text")).alias("text"))
    return t.select("path", F.posexplode(split_lines("text")).alias("line_no", "line"))


def folder_line_corpus(spark: SparkSession, path: str, extractors: dict[str, Extractor] | None = None,
                       parts: bool = False) -> DataFrame:
    """S9 on a folder: ``line_corpus`` of its files, in which plain-text files are read line
    by line, so that none of them is ever one row; only files that need an extractor are
    read whole.  ``parts``: a folder's plain-text files are one document named
    ``<folder>.txt`` (see ``read_line_docs``).

    The two kinds are told apart by the scans' name patterns: a filter on ``path`` would
    come after the contents of the text files are read."""
    lines = read_line_docs(spark, path, "*{" + ",".join(TEXT_SUFFIXES) + "}", parts)
    lines = lines.withColumn("path", F.concat("path", F.lit(".txt"))) if parts else lines.where(is_extractable("path"))
    decoded = F.decode(F.col("line").cast("binary"), "ISO-8859-1")
    plain = lines.select(X.to_txt("path").alias("path"), F.col("line_no").cast("int").alias("line_no"),
                         X.remove_digits(X.remove_punctuation(decoded)).alias("line"))
    others = [s for s in EXTRACTABLE_SUFFIXES if s not in TEXT_SUFFIXES]
    return plain.unionByName(line_corpus(scan_files(spark, path, "*{" + ",".join(others) + "}"), extractors))
