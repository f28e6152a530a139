"""The query op4_chunk_dedup against plain dictionaries, and its work on copies without ids."""

import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labeltext.llm import chunks, common, queries

LAST = 1 << 62


def plain(rows):
    """Chunk by chunk: the smallest id owns a digest, a chunk that another row owns or that
    stands earlier in its text is repeated, and long runs of those go."""
    found = []
    for key, text in rows:
        c = chunks.chunked(*common.text_bytes(pa.array([text or ""], pa.string())))
        found.append([(tuple(d), a, b, w) for d, a, b, w in zip(c.digest.tolist(), c.start.tolist(), c.end.tolist(), c.words.tolist())])
    owner = {}
    for (key, _), own in zip(rows, found):
        for digest, *_ in own:
            owner[digest] = min(owner.get(digest, LAST), LAST if key is None else key)
    out = []
    for (key, text), own in zip(rows, found):
        data, seen, runs = (text or "").encode(), set(), []
        for digest, a, b, w in own:
            again = digest in seen or owner[digest] < (LAST if key is None else key)
            seen.add(digest)
            if again and runs and runs[-1][3]:
                runs[-1][1:3] = [b, runs[-1][2] + w]
            else:
                runs.append([a, b, w, again])
        cut = [(a, b) for a, b, w, again in runs if again and w >= chunks.LEAST_WORDS]
        points = [(len(data[:a].decode()), len(data[:b].decode())) for a, b in cut]
        left, before = b"", 0
        for a, b in cut:
            left, before = left + data[before:a], b
        left = (left + data[before:]).decode()
        out.append((key, left if cut else text, sum(b - a for a, b in points), tuple(points)))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.text, r.n_removed, tuple(map(tuple, r.spans))) for r in df.collect())


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op4_chunk_dedup(spark, small)) == plain(rows)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage, other = say(80), "日本語 текст naïve " * 30
    rows = [(i, f"{say(30)} {passage} {say(20)}") for i in range(12)] + [(5, passage), (None, f"{say(9)} {passage}")] * 3
    rows += [(None, passage), (7, None), (8, ""), (9, " \n "), (10, other), (11, say(5) + " " + other), (12, f"{passage}\n{passage}")]
    return rows + [(3, say(40)), (3, say(40)), (13, "z" * 50_000), (14, "z" * 50_000), (15, say(3000))]


def test_odd_rows(spark, odd, tmp_path):
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op4_chunk_dedup(spark, str(tmp_path))) == plain(odd)
    assert chunks.deduplicated(frame.limit(0))[0].count() == 0


def test_copies_without_id_are_linear(spark):
    """100,000 copies of one text without an id and its owner: one list of chunks in all."""
    text = " ".join(f"w{i}" for i in range(300))
    copies = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = copies.unionByName(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    start = time.time()
    cut, spans = chunks.deduplicated(docs)
    assert cut.where(F.size(spans) > 0).count() == 100_000
    assert time.time() - start < 120
