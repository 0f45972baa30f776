"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlex.llm import (
    centroids, decontaminate, exact_dedup, html_text, mixing, near_dedup, packing, pii, prefix_trie, quality,
    substring_dedup, suffix_dedup, url_filter)
from loomlex.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@query("op1_quality")
def op1(spark, sf):
    return quality.report(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@query("op2_exact_dedup", exact_dedup.SQL)
def op2(spark, sf):
    return exact_dedup.exact_groups(read_table(spark, sf, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op3_packing")
def op3(spark, sf):
    return packing.pack(read_table(spark, sf, "documents"))


@query("op4_substring_dedup", substring_dedup.SQL)
def op4(spark, sf):
    return substring_dedup.report(read_table(spark, sf, "documents"))


@query("op5_suffix_dedup")
def op5(spark, sf):
    return suffix_dedup.report(read_table(spark, sf, "documents"))


@query("op6_near_dedup", near_dedup.SQL)
def op6(spark, sf):
    return near_dedup.near_groups(read_table(spark, sf, "documents"), shingle_words=2)


@query("op7_url_filter", url_filter.sql())
def op7(spark, sf):
    return url_filter.judge(read_table(spark, sf, "pages"))


@query("op8_decontaminate", decontaminate.SQL)
def op8(spark, sf):
    return decontaminate.report(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@query("op9_html_text")
def op9(spark, sf):
    return html_text.extract(read_table(spark, sf, "pages"))


@query("op10_pii")
def op10(spark, sf):
    return pii.report(read_table(spark, sf, "documents"))


@query("op11_source_mix", mixing.SQL)
def op11(spark, sf):
    return mixing.mix(read_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op12_centroid_clusters", centroids.sql())
def op12(spark, sf):
    return centroids.cluster(read_table(spark, sf, "embeddings"))


@query("op13_prefix_trie", prefix_trie.SQL)
def op13(spark, sf):
    return prefix_trie.trie(read_table(spark, sf, "conversations"))
