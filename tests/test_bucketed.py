"""A corpus bucketed by id: its texts are not exchanged again."""

import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalog import tables
from labeltext.operators import lift, rewrite
from labeltext.plans import jobs
from labeltext.sources import readers, writers

BUCKETS = 6


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    """The plain corpus, the bucketed one and its folder."""
    path, name = str(tmp_path_factory.mktemp("bucketed") / "it's"), f"t_{uuid.uuid4().hex}"
    rows = tables.news(spark, small).cache()
    yield rows, writers.write_bucketed_corpus(rows, path, name, BUCKETS), path
    rows.unpersist()
    spark.sql(f"DROP TABLE {name}")


@pytest.fixture
def by_shuffle(spark):
    """Plans of tables too large to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def exchanged(df, column):
    """Exchanges of the plan whose input has ``column``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines, found = plan.split("\n"), 0
    for line, below in zip(lines, lines[1:], strict=False):
        if re.search(r"\bExchange ", line) and re.search(rf"\b{column}#", below):
            found += 1
    return found


def both(rows):
    words = lift.document_words(rows, skeleton=True).checkpoint()
    ranked = lift.ranked_words(words, lift.class_lift(words).checkpoint()).checkpoint()
    lines = rewrite.complement_lines(rows, ranked, by=["split"])
    return lines, jobs.style_rows(rows, lines)


def as_counter(df):
    return Counter(map(tuple, df.collect()))


def test_texts_are_not_exchanged(stored, by_shuffle):
    plain, bucketed, _ = stored
    for mine, other in zip(both(bucketed), both(plain), strict=True):
        assert exchanged(mine, "text") == 0 < exchanged(other, "text")
        assert as_counter(mine) == as_counter(other)


def test_another_session_reads_the_buckets(spark, stored, by_shuffle):
    plain, _, path = stored
    name = f"t_{uuid.uuid4().hex}"
    loaded = readers.load_bucketed_corpus(spark.newSession(), path, name)
    assert loaded.columns == plain.columns and as_counter(loaded) == as_counter(plain)
    own = readers.load_bucketed_corpus(spark, path, f"{name}_2")
    some = plain.select("doc_id", F.lit(1).alias("one")).checkpoint()
    assert exchanged(own.join(some, "doc_id"), "text") == 0
    spark.sql(f"DROP TABLE {name}_2")


def test_whole_job_on_the_bucketed_corpus(stored, tmp_path, spark):
    plain, bucketed, _ = stored
    for rows, name in ((plain, "a"), (bucketed, "b")):
        jobs.rewrite_corpus(rows, str(tmp_path / name), "complement")
    read = [spark.read.option("recursiveFileLookup", True).text(str(tmp_path / n)) for n in "ab"]
    assert as_counter(read[0]) == as_counter(read[1])


def test_odd_corpora(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    rows = [(1, None, 0), (1, "", 0), (None, "x", 1), (2, "y", None), (2, "y", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, label int")
    stored = writers.write_bucketed_corpus(odd, str(tmp_path / "odd"), name, 3)
    assert as_counter(stored) == Counter(rows)
    with pytest.raises(Exception, match="exists"):
        writers.write_bucketed_corpus(odd, str(tmp_path / "other"), name, 3)
    spark.sql(f"DROP TABLE {name}")
    assert as_counter(readers.load_bucketed_corpus(spark, str(tmp_path / "odd"), name)) == Counter(rows)
    spark.sql(f"DROP TABLE {name}")
    none = writers.write_bucketed_corpus(odd.limit(0), str(tmp_path / "none"), name, 3)
    assert none.count() == 0
    spark.sql(f"DROP TABLE {name}")
    odd.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="bucketed"):
        readers.load_bucketed_corpus(spark, str(tmp_path / "plain"), name)
