"""Source and target lines written in one job stay aligned."""

import glob
import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from labeltext.sources import writers


def lines_of(path, kind):
    """Lines by folder and part file, without the name that Spark gives a write."""
    out = {}
    for name in sorted(glob.glob(f"{path}/{kind}/**/part-*", recursive=True)):
        with open(name, encoding="utf8", newline="\n") as f:
            folder = os.path.relpath(os.path.dirname(name), f"{path}/{kind}")
            out[folder, os.path.basename(name)[:10]] = f.read().split("\n")[:-1]
    return out


def pairs(path):
    source, target = lines_of(path, "source"), lines_of(path, "target")
    assert source.keys() == target.keys()
    return {part: list(zip(source[part], target[part], strict=True)) for part in source}


def table(spark, n, ids):
    rows = spark.range(n, numPartitions=7)
    return rows.select(
        (F.xxhash64("id") % ids).alias("id"), F.concat(F.lit("s"), "id").alias("source"),
        F.concat(F.lit("t"), "id").alias("target"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"),
    )


@pytest.mark.parametrize("ids", [1, 10, 1_000_000])
def test_repeated_ids(spark, tmp_path, ids):
    path = str(tmp_path / "out")
    writers.write_line_pairs(table(spark, 20_000, ids), path)
    found = [(part[0], *p) for part, rows in pairs(path).items() for p in rows]
    assert sorted(found) == sorted((f"split={'train' if i % 3 else 'val'}", f"s{i}", f"t{i}") for i in range(20_000))


def test_order_and_replacement(spark, tmp_path):
    path = str(tmp_path)
    (tmp_path / "pair").mkdir()
    writers.write_line_pairs(table(spark, 50, 1000), path)
    rows = spark.range(300).select("id", F.col("id").cast("string").alias("source"), F.lit("x").alias("target"), F.lit("a").alias("split"))
    writers.write_line_pairs(rows.repartition(5), path)
    written = [int(s) for _, part in sorted(pairs(path).items()) for s, _ in part]
    assert written == list(range(300))
    assert sorted(os.listdir(path)) == ["pair", "source", "target"]


def test_a_failed_write_leaves_the_old_lines(spark, tmp_path):
    path = str(tmp_path)
    writers.write_line_pairs(table(spark, 50, 1000), path)
    before = pairs(path)
    bad = table(spark, 50, 1000).withColumn("target", F.when(F.col("source") == "s7", F.raise_error(F.lit("stop"))).otherwise("t"))
    with pytest.raises(Exception, match="stop"):
        writers.write_line_pairs(bad, path)
    assert pairs(path) == before


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, "t1", "a"), (None, "s2", None, "a"), (1, "", "", None), (1, "s4", "t4", "x/y z")]
    odd = spark.createDataFrame(rows, "id long, source string, target string, split string")
    writers.write_line_pairs(odd.withColumn("_at", F.lit(1)).withColumn("kind", F.lit("k")), str(tmp_path / "a"))
    found = sorted(p for part in pairs(str(tmp_path / "a")).values() for p in part)
    assert found == [("", ""), ("", "t1"), ("s2", ""), ("s4", "t4")]
    writers.write_line_pairs(odd.limit(0), str(tmp_path / "b"))
    assert pairs(str(tmp_path / "b")) == {}


def test_in_place_writes_the_same_files(spark, tmp_path):
    rows = table(spark, 500, 1_000_000)
    for name, in_place in (("a", False), ("b", True)):
        writers.write_line_pairs(rows, str(tmp_path / name), in_place)
    assert pairs(str(tmp_path / "a")) == pairs(str(tmp_path / "b"))


def test_one_job(spark, tmp_path):
    """The rows are read by the range sample and by one write, whatever the kinds."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            if TaskContext.get() is not None:
                seen.add(batch.num_rows)
            yield batch

    rows = table(spark, 1000, 1000)
    writers.write_line_pairs(rows.mapInArrow(count, rows.schema), str(tmp_path / "out"))
    assert seen.value <= 2 * 1000
