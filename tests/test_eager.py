"""Eager aggregation against joining first."""

from pyspark.sql import functions as F

from pagestrata.operators import eager

PAGES = "page_id long, crawl_id long, domain string, url string, internal_links array<struct<url:string,anchor:string,nofollow:boolean>>, target string, in_degree long, __nl long"


def test_join_aggregate_equals_join_then_group(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 4).alias("g"), F.col("id").alias("x"))
    right = spark.range(400).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 60).alias("k"), (F.col("id") % 5).alias("h"), (F.col("id") * 2).alias("y"))
    left = left.union(spark.createDataFrame([(None, 1, 7)], left.schema))
    got = eager.join_aggregate(left, right, ["k"], ["g"], ["h"], ["x"], ["y"])
    plain = left.join(right, "k").groupBy("g", "h").agg(F.count("*").alias("joined_rows"), F.sum("x").alias("left_x"), F.sum("y").alias("right_y"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_in_degrees(spark):
    link = lambda u: (u, "a", True)
    rows = [
        (1, 1, "s", "https://s.example/", [link("https://S.example/a/"), link("https://s.example/a#x"), link("https://s.example"), (None, None, None)], "t", 9, 1),
        (2, 1, "s", "https://s.example/a", [link("https://s.example:443/a"), link("https://s.example/")], "t", 9, 1),
        (2, 1, "s", "https://s.example/a", [link("https://s.example:443/a"), link("https://s.example/")], "t", 9, 1),
        (3, 1, "s", "https://s.example/b", None, None, None, None),
        (4, 2, "s", "https://s.example/a", [], None, None, None),
        (None, 1, "s", "https://s.example/z", [link("https://s.example/b")], None, None, None),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    assert {r.page_id: r.in_degree for r in eager.in_degrees(pages).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    ranked = spark.createDataFrame([(1, 1, "https://s.example/a/", 1), (2, 1, "https://s.example/", 2), (3, 1, "https://s.example/b", None), (3, 1, "https://s.example/b", None), (4, 9, "https://x.example/", 0)], "rank_id long, crawl_id long, url string, in_degree long")
    assert sorted(r.rank_id for r in eager.wrong_in_degrees(ranked, pages).collect()) == [2, 3]
    assert [tuple(r) for r in eager.site_in_degrees(pages).collect()] == [("s", 4, 2)]


def test_empty(spark):
    empty = spark.createDataFrame([], PAGES)
    assert eager.in_degrees(empty).count() == 0 and eager.site_in_degrees(empty).count() == 0
    ranked = spark.createDataFrame([], "rank_id long, crawl_id long, url string, in_degree long")
    assert eager.wrong_in_degrees(ranked, empty).count() == 0
