"""The four end-to-end jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltext.fixed_values import MASK, NEWS_CLASSES
from labeltext.functions.lookups import name_of
from labeltext.operators import classify, cluster, corpus, features, lift, prompts, rewrite
from labeltext.operators import vocabulary as vocab
from labeltext.operators.metrics import label_correlation
from labeltext.session import ensure_checkpoint_dir
from labeltext.sources import writers

NEWS_OUTPUTS = {"test": ["val", "test"]}


@contextmanager
def reused(*tables: DataFrame) -> Iterator[None]:
    """Keep tables that a job reads several times, for the time of the job."""
    for table in tables:
        table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        for table in tables:
            table.unpersist()


def rewritten(
    words: DataFrame,
    scores: DataFrame,
    task: str = "keyword",
    threshold: float = lift.THRESHOLD,
    by: Sequence[str] = (),
    rows: DataFrame | None = None,
) -> DataFrame:
    """``(by.., doc_id, label, line)`` from ``document_words`` (or their ``encode``)
    and their ``class_lift``: keyword line, mask line or, with the corpus ``rows``, the
    complement of the keywords; any other task gives the bare mask."""
    if task == "complement":
        return rewrite.complement_lines(rows, lift.ranked_words(words, scores, by), threshold, by)
    if task not in ("keyword", "mask"):
        return words.select(*by, "doc_id", "label", F.lit(MASK).alias("line"))
    ranked = lift.ranked_words(words, scores, by)
    if task == "keyword":
        return rewrite.keyword_lines(ranked, threshold)
    return rewrite.mask_lines(words, ranked, threshold).select(*by, "doc_id", "label", "line")


def style_rows(
    rows: DataFrame,
    lines: DataFrame,
    outputs: dict[str, list[str]] = NEWS_OUTPUTS,
    class_names: list[str] = NEWS_CLASSES,
) -> DataFrame:
    """``(id, label_name, split, source, target)``: each rewrite with its text,
    computed once and then fanned out to the output splits."""
    texts = rows.select("doc_id", F.col("text").alias("target"))
    pairs = lines.select("doc_id", "split", "label", F.col("line").alias("source")).join(texts, "doc_id")
    named = pairs.select(
        F.col("doc_id").alias("id"),
        name_of(F.col("label"), class_names).alias("label_name"),
        "split",
        "source",
        "target",
    )
    return corpus.fan_out_splits(named, outputs)


def rewrite_corpus(
    rows: DataFrame,
    path: str,
    task: str = "keyword",
    max_len: int = lift.MAX_LEN,
    threshold: float = lift.THRESHOLD,
    split_files: bool = True,
    vocabulary: DataFrame | None = None,
    outputs: dict[str, list[str]] = NEWS_OUTPUTS,
    class_names: list[str] = NEWS_CLASSES,
    separate_splits: bool = True,
) -> int:
    """Keyword, mask or complement rewrite of a labelled corpus ``(doc_id, text,
    label, split)``, written by class and split. Statistics are separate per split,
    or of the whole corpus. Returns how many rows had no label and were left out."""
    by = ["split"] if separate_splits else []
    unlabelled = rows.where(F.col("label").isNull()).count()
    words = lift.document_words(rows, max_len, by, skeleton=task == "mask")
    keyed = words if vocabulary is None else vocab.encode(words, vocabulary, "words")
    with reused(words), reused(keyed):
        scores = lift.class_lift(keyed, by)
        with reused(scores):
            lines = rewritten(keyed, scores, task, threshold, by, rows)
            if not separate_splits:
                lines = lines.join(rows.select("doc_id", "split"), "doc_id")
            pairs = style_rows(rows, lines, outputs, class_names)
            writers.write_style_rows(pairs, path, split_files)
    return unlabelled


def export_lines(
    records: DataFrame,
    path: str,
    task: str,
    mode: str,
    relation_names: DataFrame | None = None,
    prompt: str = "prompt_0",
) -> None:
    """Source/target lines of a task's records, by exported split name."""
    if mode not in prompts.MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(prompts.MODES)}")
    if mode == "text2rel" and relation_names is None:
        raise ValueError("mode 'text2rel' needs relation_names")
    corpus.require_splits(records, task)
    named = corpus.rename_splits(records, task)
    if mode == "style-transfer":
        writers.write_topic_lines(prompts.topic_lines(named), path)
        return
    render: Callable[..., DataFrame] = prompts.MODES[mode]
    extra = (relation_names,) if mode == "text2rel" else ()
    writers.write_line_pairs(render(named, *extra, prompt=prompt), path)


def cluster_corpus(
    rows: DataFrame,
    k: int,
    dims: int = features.LSA_DIMS,
    runs: int = cluster.RUNS,
    min_df: int = features.MIN_DF,
    max_df: float = features.MAX_DF,
    sample_size: int = 2000,
) -> dict[str, DataFrame]:
    """Cluster ``(doc_id, text, label)`` and compare the clusters with the labels.

    Returns ``scores`` (mean and deviation over runs), ``clusters`` (doc_id and
    cluster of the last run), ``top_terms``, ``relabelled`` (the corpus with the
    clusters as labels) and ``correlation`` of labels with clusters.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    matrix = features.term_matrix(features.document_terms(rows), min_df, max_df)
    lsa = features.fit_lsa(matrix, dims)
    points = features.lsa_vectors(matrix, lsa, rows).join(rows.select("doc_id", "label"), "doc_id")
    points = features.as_array(points).checkpoint()
    scores, clustered, centers = cluster.kmeans_runs(points, k, runs, sample_size=sample_size)
    summary = cluster.summarise_runs(scores).toArrow()
    spark = rows.sparkSession
    clusters = clustered.select("doc_id", "label", "cluster")
    components = cluster.term_components(lsa)
    return {
        "scores": spark.createDataFrame(summary),
        "clusters": clusters.select("doc_id", "cluster"),
        "top_terms": cluster.top_terms(cluster.centroids_in_term_space(components, centers)),
        "relabelled": corpus.relabel(
            rows, clusters.select("doc_id", F.col("cluster").alias("label"))
        ),
        "correlation": label_correlation(clusters, "label", "cluster"),
    }


def classifier_rows(
    rows: DataFrame, dims: int = 50, min_df: int = features.MIN_DF, max_df: float = features.MAX_DF
) -> DataFrame:
    """``(doc_id, split, label, features)`` from ``(doc_id, split, text, label)``:
    TF-IDF rows in ``dims`` components. Terms, weights and components are fitted on
    ``split = 'train'`` only. The result is computed once and checkpointed."""
    ensure_checkpoint_dir(rows.sparkSession)
    named = rows.select("doc_id", "split", F.col("label").cast("double").alias("label"), "text")
    # A row for each pair of rows of an id, for the terms as for the labels.
    pairs = named.drop("text").join(features.document_terms(named), "doc_id")
    matrix = features.term_matrix(pairs.select("doc_id", "terms", (F.col("split") == "train").alias("fit")), min_df, max_df)
    labelled = named.drop("text").join(named.select("doc_id"), "doc_id").checkpoint()
    vectors = features.lsa_vectors(matrix, features.fit_lsa(matrix.fitted(), dims), labelled)
    return labelled.join(vectors, "doc_id").checkpoint()


def train_and_evaluate(
    rows: DataFrame, path: str | None = None, epochs: int = classify.EPOCHS, seed: int = 0
) -> tuple[classify.TrainedClassifier, DataFrame]:
    """Train on ``split = 'train'``, keep the best epoch on ``'val'``, and return
    the model with ``(split, n_rows, bce, accuracy)`` of every split."""
    with reused(rows):
        parts = {name: corpus.choose_split(rows, name) for name in ("train", "val")}
        trained = classify.train_classifier(
            parts["train"], parts["val"], epochs=epochs, seed=seed, path=path
        )
        report = classify.evaluate(classify.score_rows(rows, trained.model)).toArrow()
    return trained, rows.sparkSession.createDataFrame(report)
