"""Line dedup against a plain loop."""

import collections

from ledgerkeel.llm import boilerplate as B
from pyspark.sql import functions as F


def plain(pages, ratio, min_pages):
    totals, counts = collections.Counter(), collections.Counter()
    for _, host, lines in pages:
        if host:
            totals[host] += 1
            counts.update((host, x) for x in set(lines))
    bad = {k for k, n in counts.items() if n > 1 and totals[k[0]] >= min_pages and n > totals[k[0]] * ratio}
    return [(i, [x for x in lines if (host, x) not in bad]) for i, host, lines in pages]


def test_lines_and_hosts(spark):
    html = "<html><head><title>T</title><style>a{}</style></head><body><p>one <b>two</b><br/> three<!-- no --><script>x<p></script></p>\n<li>é </li></body>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    assert [r.x for r in df.select(B.page_lines(F.col("html")).alias("x")).collect()] == [["T", "one two", "three", "é"], [], []]
    urls = [("HTTP://User:pw@A.b:80/x?y", "a.b"), ("https://c.d#e", "c.d"), (None, ""), ("no url", ""), ("//x/y", "")]
    df = spark.createDataFrame(urls, "url string, host string")
    assert [r.got for r in df.select(B.host_of(F.col("url")).alias("got")).collect()] == [h for _, h in urls]


def test_drops_what_a_plain_loop_drops(spark, rows):
    pages = []
    for i in range(400):
        host = "hot" if i % 3 else f"h{i % 40}"
        lines = ["menu", "foot" if i % 2 else "odd", f"only {i}", "menu"] + (["quarter"] if i % 5 == 0 else [])
        pages.append((i, host, lines))
    pages += [(900, "", ["menu"]), (901, "one", ["menu", "x"]), (902, "hot", []), (903, "hot", ["y" * 50_000])]
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, host string, lines array<string>, keys string, n int")
    for ratio, least in ((0.2, 5), (0.5, 2), (0.05, 12)):
        done = B.drop_boilerplate(df, F.col("doc.lines"), F.col("doc.host"), ratio=ratio, min_pages=least)
        assert rows(done.select("doc.page_id", "kept")) == sorted(plain(pages, ratio, least), key=repr)
    assert done.select("doc.*").columns == df.columns


def test_null_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None), (None, "http://a/", "<p>x"), (None, "http://a/", "<p>x")], "page_id long, url string, html string")
    done = B.drop_boilerplate(df, min_pages=2, ratio=0.9)
    assert sorted((str(r.page_id), r.kept) for r in done.select("doc.page_id", "kept").collect()) == [("1", []), ("None", []), ("None", [])]
    assert B.drop_boilerplate(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = B.drop_boilerplate(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
