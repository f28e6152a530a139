"""Words are looked up among others by one search in the joined words."""

from labeltext.functions.text import search_among
from labeltext.operators.rewrite import complement_text
from pyspark.sql import functions as F


def test_among_is_equality(spark):
    lists = [[], [""], ["a"], ["a", "b"], ["", "a"], ["ab", "b"], ["aé", "<mask>"], None]
    words = ["", "a", "b", "ab", "aé", "é", "<mask>", "%"]
    rows = spark.createDataFrame([(f, words) for f in lists], "found array<string>, words array<string>")
    got = rows.select(
        search_among(F.col("found"), lambda among: F.filter("words", lambda w: among(w))).alias("by_search"),
        F.filter("words", lambda w: F.array_contains("found", w)).alias("by_comparison"),
    )
    assert all(r.by_search == r.by_comparison for r in got.collect())
    plan = rows.select(complement_text(F.col("words"), F.col("found")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan
