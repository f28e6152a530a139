"""Corpus shape: text/label rows, splits, relabelling, required values.

A corpus is one DataFrame with a unique ``doc_id`` and, where there are splits,
a ``split`` column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltext.fixed_values import SPLIT_NAMES
from labeltext.functions.lookups import renamed_by, required


def text_and_label(corpus: DataFrame) -> DataFrame:
    """Only key, text and label."""
    return corpus.select("doc_id", "text", "label")


def choose_split(corpus: DataFrame, split: str | None = None) -> DataFrame:
    """Rows of one split, or the whole corpus."""
    return corpus if split is None else corpus.where(F.col("split") == split)


def assemble_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """One corpus out of named parts."""
    named = [df.withColumn("split", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, named)


def fan_out_splits(corpus: DataFrame, outputs: dict[str, list[str]]) -> DataFrame:
    """Repeat the rows of a split under several output names.

    Splits that are not listed keep their name.
    """
    names = F.array("split")
    for split, targets in outputs.items():
        names = F.when(
            F.col("split") == split, F.array(*[F.lit(t) for t in targets])
        ).otherwise(names)
    others = [c for c in corpus.columns if c != "split"]
    return corpus.select(*others, F.explode(names).alias("split"))


def rename_splits(corpus: DataFrame, task: str) -> DataFrame:
    """Export names of a task's splits; splits the task does not list are left out."""
    if task not in SPLIT_NAMES:
        raise ValueError(f"unknown task {task!r}; known: {sorted(SPLIT_NAMES)}")
    renamed = corpus.withColumn("split", renamed_by(F.col("split"), SPLIT_NAMES[task]))
    return renamed.where(F.col("split").isNotNull())


def require_splits(corpus: DataFrame, task: str) -> None:
    """Fail early when the corpus lacks a split the task exports."""
    if task not in SPLIT_NAMES:
        raise ValueError(f"unknown task {task!r}; known: {sorted(SPLIT_NAMES)}")
    wanted = list(SPLIT_NAMES[task])
    present = corpus.where(F.col("split").isin(wanted)).select("split").distinct().collect()
    missing = sorted(set(wanted) - {r.split for r in present})
    if missing:
        raise ValueError(f"corpus has no split {missing} needed by task {task!r}")


def relabel(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The corpus with the labels of another table, matched by ``doc_id``."""
    return corpus.drop("label").join(labels.select("doc_id", "label"), "doc_id")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` where a NULL in any of the columns fails the job."""
    return df.withColumns({name: required(F.col(name), name) for name in names})


def drop_unlabelled(corpus: DataFrame, observation=None) -> DataFrame:
    """Rows with a label. An ``Observation`` counts the dropped ones in the same pass."""
    if observation is not None:
        corpus = corpus.observe(
            observation, F.count_if(F.col("label").isNull()).alias("unlabelled")
        )
    return corpus.where(F.col("label").isNotNull())
