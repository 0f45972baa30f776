"""Scalar functions against the FIXTURES.md §3.2 goldens."""

from pyspark.sql import functions as F

from loomlex.functions import text as X


def one(spark, col_fn, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(col_fn(F.col("v"))).collect()]


def test_file_ext(spark):
    cases = {"a.b": ".b", "a..txt": ".txt", ".bashrc": "", "...a.txt": ".txt", "a.": ".",
             "x": "", "d.e/f": "", "p/.q.r": ".r", "archive.tar.gz": ".gz", "A.HTM;1": ".HTM;1"}
    assert one(spark, X.file_ext, list(cases)) == list(cases.values())


def test_human_size(spark):
    cases = {0: "0 B", 999: "999 B", 1000: "1000 B", 1023: "1023 B",
             1024: "1.0KiB / 1.0kB (1024 B)", 1500: "1.5KiB / 1.5kB (1500 B)",
             1048576: "1.0MiB / 1.0MB (1048576 B)", 1150: "1.1KiB / 1.1kB (1150 B)"}
    assert one(spark, X.human_size, list(cases), "bigint") == list(cases.values())


def test_iso_utc_and_slug(spark):
    assert one(spark, X.iso_utc, [0, 86399, 1704067207], "bigint") == [
        "1970-01-01T00:00:00Z", "1970-01-01T23:59:59Z", "2024-01-01T00:00:07Z"]
    assert one(spark, X.name_slug, ["a b", "ab"]) == ["a%20b", "None"]


def test_stream_and_export(spark):
    assert one(spark, X.stream_name, ["f.txt:ads", "f.txt"]) == ["ads", None]
    df = spark.createDataFrame([("out", "f.txt", "ads"), ("out", "f.txt", None)], "d string, n string, s string")
    got = [r[0] for r in df.select(X.export_name("d", "n", "s")).collect()]
    assert got == ["out/f.txt.ads", "out/f.txt"]


def test_offset_label_and_flags(spark):
    assert one(spark, X.offset_label, [32256], "bigint") == ["32256 (0x00007e00)"]
    assert one(spark, X.deleted_flag, [1, 2], "int") == ["No", "Yes"]
    assert one(spark, X.is_dir, [2, 1], "int") == [True, False]


def test_punctuation_variants(spark):
    assert one(spark, X.remove_punctuation, ["a.b_c-9"]) == ["abc9"]
    assert one(spark, X.strip_punctuation, ["a.b_c-9"]) == ["a b c 9"]


def test_prepare_fixture(spark):
    texts = ["The café-cat sat; the CAT sat 3.14 times!", "1234 !!!"]
    assert one(spark, X.prepare, texts) == ["The caf cat sat  the CAT sat   times ", "  "]


def test_paths(spark):
    assert one(spark, X.basename, ["a/b/c.txt", "c"]) == ["c.txt", "c"]
    assert one(spark, X.dirname, ["a/b/c.txt", "/a", "a", "//a"]) == ["a/b", "/", "", "//"]
    assert one(spark, X.to_txt, ["a/b.pdf", "x"]) == ["a/b.txt", "x.txt"]
    df = spark.createDataFrame([("", "a"), ("/a", "x.txt"), ("/", "")], "p string, n string")
    assert [r[0] for r in df.select(X.join_path("p", "n")).collect()] == ["/a", "/a/x.txt", "/"]


def test_html_to_text(spark):
    html = ('<html><head><title>T &amp; U</title><style>p{x:1}</style>'
            '<script>var t="</p>";</script></head><body><p>Hello<br>world</p><!-- c --></body></html>')
    assert one(spark, X.html_to_text, [html]) == ["T & U Hello world"]
