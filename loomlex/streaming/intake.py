"""Incremental corpus intake with Structured Streaming.

Files landing in a folder are read as a stream (``binaryFile``), turned into
documents (S2/S3 native extraction), normalised and tokenised exactly as the
batch path (N9 -> N6 -> F1 -> F3), and their per-document term counts are
appended to a Parquet table.  The batch topic job can then run over that
table as it grows; the checkpoint folder makes the appends exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlex.operators import tokens as TK
from loomlex.sources import files as FS

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_documents(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Streaming ``(path, text)`` for every new file under ``folder``."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA) \
        .option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(folder)
    docs = FS.drop_null_docs(FS.extract_text(FS.skip_outputs(files)))
    return docs.select("path", "text")


def stream_term_counts(docs: DataFrame, stop_words: list[str] | None = None,
                       min_len: int = 3) -> DataFrame:
    """Per-document term counts ``(path, term, tf)`` of a document stream;
    stateless per file, so each micro-batch is final as soon as it runs."""
    words = TK.default_stop_words() if stop_words is None else stop_words
    toks = TK.explode_tokens(TK.doc_tokens(docs, "path", "text"))
    toks = TK.min_length(TK.drop_stopwords(toks.select("doc_id", "term"), words), min_len)
    return toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")) \
        .withColumnRenamed("doc_id", "path")


def start_intake(spark: SparkSession, folder: str, table_path: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Run the intake: each micro-batch's term counts are written to
    ``<table_path>/epoch=<n>``.  A retried batch overwrites its own epoch
    folder, so together with the checkpoint the table is exactly-once.
    ``available_now`` processes what is there and stops."""

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # per-file counts need no cross-batch state: plain batch aggregation
        stream_term_counts(batch).write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")

    writer = stream_documents(spark, folder).writeStream.foreachBatch(write_batch) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
