import glob
import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from catalog import tables
from labeltext.operators import corpus, lift, prompts, rewrite
from labeltext.operators import vocabulary as vocab
from labeltext.plans import jobs
from labeltext.sources import readers, writers

PAIR = "id bigint, sentence1 string, sentence2 string, label int, split string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def text_files(folder):
    """Lines of every part file by folder and position among the folder's parts."""
    out = {}
    for path in sorted(glob.glob(f"{folder}/**/part-*", recursive=True)):
        with open(path, encoding="utf8", newline="\n") as f:
            out.setdefault(os.path.relpath(os.path.dirname(path), folder), []).append(f.read().split("\n")[:-1])
    return out


def test_line_patterns(spark):
    pair = spark.createDataFrame([(1, "A\nx ", "B", 1, "train")], PAIR)
    assert rows(prompts.sentence_pair_lines(pair)) == [(1, "train", "A x  Is it true that B ?", "1")]
    summary = spark.createDataFrame([(1, " t\n", "s")], "id bigint, text string, target string")
    assert rows(prompts.summary_lines(summary)) == [(1, "t", "s")]


RELATION = [
    Row(id=1, token=["x", "y"], h=Row(name="H"), t=Row(name="T"), relation="P1"),
]


def test_relation_lines(spark):
    records = spark.createDataFrame(RELATION, readers.RELATION_SCHEMA)
    names = spark.createDataFrame([("P1", "part")], "relation string, name string")
    assert rows(prompts.relation_lines(records, names)) == [(1, "x y <mask> is <mask> of <mask>", "T is part of H")]
    with pytest.raises(Exception, match="relation name must not be NULL"):
        prompts.relation_lines(records, names.where("relation = 'P2'")).collect()


def test_topic_out_of_range_fails(spark):
    bad = spark.createDataFrame([(1, "x", 10)], "id bigint, best_answer string, topic int")
    with pytest.raises(Exception, match="no name for index 10"):
        prompts.topic_lines(bad).collect()


def test_relation_sources(spark, tmp_path):
    record = {"token": ["x", "y"], "h": {"name": "H"}, "t": {"name": "T"}, "relation": "P1"}
    for name, n in (("train.txt", 3), ("val.txt", 2)):
        (tmp_path / name).write_text("\n".join(json.dumps({"id": i, **record}) for i in range(n)))
    loaded = readers.load_relation_records(spark, str(tmp_path / "train.txt"), str(tmp_path / "val.txt"))
    assert dict(rows(loaded.groupBy("split").count())) == {"train": 3, "val": 2, "test": 2}
    (tmp_path / "rel.json").write_text(json.dumps({"a": "P1", "b": "P2", "c": "P1"}, indent=1))
    names = readers.load_inverted_dictionary(spark, str(tmp_path / "rel.json"))
    assert dict(rows(names)) == {"P1": "c", "P2": "b"}
    (tmp_path / "rel.jsonl").write_text('{"a": "P1", "b": "P2"}\n{"c": "P1"}\n{}\n')
    assert dict(rows(readers.load_inverted_dictionary(spark, str(tmp_path / "rel.jsonl"), lines=True))) == {"P1": "c", "P2": "b"}
    jobs.export_lines(loaded, str(tmp_path / "out"), "wiki80", "text2rel", names)
    parts = text_files(tmp_path / "out" / "target")
    assert sum(len(p) for p in parts["split=test"]) == 2
    assert parts["split=train"][0][0] == "T is c of H"


def test_lines_with_bad_bytes(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b"a\xffb\r\nc\rd\n")
    assert [r.value for r in readers.load_lines(spark, str(tmp_path / "f.csv")).collect()] == ["a�b", "c", "d"]


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "words").write_text("b\na\nb\n")
    got = readers.load_vocabulary(spark, str(tmp_path / "words"))
    assert dict(rows(got)) == {"<pad>": 0, "<unk>": 1, "<mask>": 2, "a": 4, "b": 5}


def test_corpus_and_configs(spark, tmp_path):
    for config, schema in (("cola", "sentence string, label int"), ("mrpc", "sentence1 string, sentence2 string")):
        df = spark.createDataFrame([("x", 1)] if config == "cola" else [("x", "y")], schema)
        df.withColumn("split", F.lit("train")).unionByName(df.withColumn("split", F.lit("test"))).write.partitionBy(
            "split"
        ).parquet(str(tmp_path / config))
    loaded = readers.load_configs(spark, str(tmp_path), ["cola", "mrpc"])
    assert loaded["cola"].columns == ["sentence", "label", "split"]
    assert loaded["mrpc"].columns == ["sentence1", "sentence2", "split"]
    one = readers.load_corpus(spark, str(tmp_path), "cola", split="test")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()


def test_splits(spark):
    pair = spark.createDataFrame([(1, "A", "B", 1, "train"), (2, "A", "B", 1, "validation"), (3, "A", "B", 0, "extra")], PAIR)
    assert {r.id: r.split for r in corpus.rename_splits(pair, "mrpc").collect()} == {1: "train", 2: "val"}
    with pytest.raises(ValueError, match="unknown task"):
        corpus.rename_splits(pair, "none")
    with pytest.raises(ValueError, match="no split"):
        corpus.require_splits(pair, "mrpc")
    fanned = corpus.fan_out_splits(pair, {"train": ["a", "b"]})
    assert sorted(rows(fanned.select("id", "split"))) == [(1, "a"), (1, "b"), (2, "validation"), (3, "extra")]
    with pytest.raises(Exception, match="label must not be NULL"):
        corpus.require_columns(pair.withColumn("label", F.lit(None).cast("int")), "label").collect()


def test_line_pairs_stay_aligned(spark, small, tmp_path):
    lines = prompts.classification_lines(
        tables.news(spark, small).withColumnRenamed("doc_id", "id").withColumn("label", F.col("id"))
    )
    writers.write_line_pairs(lines, str(tmp_path))
    want = {r.id: (r.source, r.split) for r in lines.collect()}
    source, target = text_files(tmp_path / "source"), text_files(tmp_path / "target")
    assert source.keys() == target.keys() == {"split=train", "split=test"}
    seen = []
    for split in source:
        assert [len(p) for p in source[split]] == [len(p) for p in target[split]]
        for s, t in zip(sum(source[split], []), sum(target[split], [])):
            assert want[int(t)] == (s, split.removeprefix("split="))
            seen.append(int(t))
    assert sorted(seen) == sorted(want)
    for split in target:
        ids = [int(t) for t in sum(target[split], [])]
        assert ids == sorted(ids)


def test_layout_is_not_sorted_again(spark, small, tmp_path, monkeypatch):
    lines = prompts.summary_lines(tables.summaries(spark, small))
    plan = writers._laid_out(lines.select("id", "split", "source"), ["split"])._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "Sort " not in plan.toString()


def test_topic_export(spark, small, tmp_path):
    records = tables.answers(spark, small)
    with pytest.raises(ValueError, match="no split"):
        jobs.export_lines(records, str(tmp_path), "yahoo_answers_topics", "style-transfer")
    named = corpus.fan_out_splits(records, {"test": ["val", "test"]})
    jobs.export_lines(named, str(tmp_path), "yahoo_answers_topics", "style-transfer")
    parts = text_files(tmp_path)
    assert len({p.split("/")[0] for p in parts}) == 10
    assert {p.split("/")[1] for p in parts} == {"split=train", "split=dev", "split=test"}
    assert sum(len(x) for p in parts.values() for x in p) == named.count()


def test_unknown_mode(spark, small, tmp_path):
    with pytest.raises(ValueError, match="unknown mode"):
        jobs.export_lines(tables.answers(spark, small), str(tmp_path), "imdb", "none")
    with pytest.raises(ValueError, match="relation_names"):
        jobs.export_lines(tables.answers(spark, small), str(tmp_path), "wiki80", "text2rel")


@pytest.mark.parametrize("task", ["keyword", "mask", "complement", "other"])
def test_rewrite_corpus(spark, small, tmp_path, task):
    rows_in = tables.news(spark, small)
    jobs.rewrite_corpus(rows_in, str(tmp_path), task)
    source, target = text_files(tmp_path / "source"), text_files(tmp_path / "target")
    assert source.keys() == target.keys()
    assert {p.split("/")[0].removeprefix("label_name=") for p in source} == {"World", "Sports", "Business", "SciTech"}
    count = {s: sum(len(x) for k, p in target.items() if k.endswith(f"split={s}") for x in p) for s in ("train", "val", "test")}
    n = dict(rows(rows_in.groupBy("split").count()))
    assert count == {"train": n["train"], "val": n["test"], "test": n["test"]}
    for key in source:
        assert [len(p) for p in source[key]] == [len(p) for p in target[key]]
        if task == "other":
            assert set(sum(source[key], [])) == {"<mask>"}


def test_rewrite_corpus_with_statistics_of_all_splits(spark, small, tmp_path):
    rows_in = tables.news(spark, small)
    lost = rows_in.withColumn("label", F.when(F.col("doc_id") % 7 != 0, F.col("label")))
    n = lost.where("label IS NULL").count()
    assert jobs.rewrite_corpus(lost, str(tmp_path), separate_splits=False) == n > 0
    words = lift.document_words(lost)
    ranked = lift.ranked_words(words, lift.class_lift(words))
    test = {r.doc_id for r in lost.where("split = 'test'").collect()}
    want = sorted(r.line for r in rewrite.keyword_lines(ranked).collect() for _ in range(1 + (r.doc_id in test)))
    parts = text_files(tmp_path / "source")
    assert sorted(line for p in parts.values() for x in p for line in x) == want


def test_rewrite_corpus_single_lines(spark, small, tmp_path):
    jobs.rewrite_corpus(tables.news(spark, small), str(tmp_path), split_files=False)
    parts = text_files(tmp_path / "pair")
    assert all(line.count(" @separator@ ") == 1 for p in parts.values() for x in p for line in x)


def test_line_table(spark, small, tmp_path):
    lines = prompts.summary_lines(tables.summaries(spark, small))
    writers.write_line_table(lines, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).select(lines.columns)
    assert sorted(rows(back)) == sorted(rows(lines))


def test_rewrite_corpus_with_vocabulary(spark, small, tmp_path):
    listed = spark.createDataFrame([("the", 0), ("of", 1), ("le", 2)], "token string, at int")
    vocabulary = vocab.build_vocabulary(listed, "at")
    rows_in = tables.news(spark, small)
    jobs.rewrite_corpus(rows_in, str(tmp_path), vocabulary=vocabulary)
    words = vocab.encode(lift.document_words(rows_in, by=["split"]), vocabulary, "words")
    ranked = lift.ranked_words(words, lift.class_lift(words, ["split"]), ["split"])
    want = sorted(
        line
        for r in rewrite.keyword_lines(ranked).collect()
        for line in [r.line] * (2 if r.split == "test" else 1)
    )
    parts = text_files(tmp_path / "source")
    assert sorted(line for p in parts.values() for x in p for line in x) == want


def test_all_valid_lines_returns_every_line(spark, tmp_path):
    from catalog import queries

    texts = [(1, "a\nb\r\nc\rd"), (2, "\n"), (3, ""), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.all_valid_lines(spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, r.line_number, r.line) for r in rows)
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, ""), (2, 1, ""), (3, 0, "")]
