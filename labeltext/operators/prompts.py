"""Task records to aligned source/target lines.

Each function maps records to ``(id, source, target)``, keeping a ``split``
column when there is one, in one narrow projection. ``MODES`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltext.fixed_values import ANSWER_TOPICS
from labeltext.functions.lookups import name_of, required
from labeltext.functions.line_patterns import apply_pattern
from labeltext.functions.text import clean_line
from labeltext.operators.scale import is_small

RELATION_NAMES = 1_000_000


def _lines(records: DataFrame, source: Column, target: Column) -> DataFrame:
    split = ["split"] if "split" in records.columns else []
    return records.select(
        "id", *split, clean_line(source).alias("source"), clean_line(target).alias("target")
    )


def sentence_pair_lines(records: DataFrame, prompt: str = "prompt_0") -> DataFrame:
    """``(sentence1, sentence2, label)``: both sentences by pattern -> label."""
    source = apply_pattern(f"nli_{prompt}", F.col("sentence1"), F.col("sentence2"))
    return _lines(records, source, F.col("label").cast("string"))


def classification_lines(records: DataFrame, prompt: str = "prompt_0") -> DataFrame:
    """``(text, label)``: text -> label."""
    return _lines(records, F.col("text"), F.col("label").cast("string"))


def summary_lines(records: DataFrame, prompt: str = "prompt_0") -> DataFrame:
    """``(text, target)``: text -> target."""
    return _lines(records, F.col("text"), F.col("target"))


def relation_lines(
    records: DataFrame, relation_names: DataFrame, prompt: str = "prompt_0"
) -> DataFrame:
    """``(token, h, t, relation)``: tokens by pattern -> the named relation.

    ``relation_names`` is ``(relation, name)``; a relation it lacks fails the job.
    """
    small = is_small(relation_names, RELATION_NAMES, "name")
    names = F.broadcast(relation_names) if small else relation_names
    named = records.join(names, "relation", "left")
    source = apply_pattern(f"text2rel_source_{prompt}", F.array_join("token", " "))
    target = apply_pattern(
        f"text2rel_target_{prompt}",
        F.col("t.name"),
        required(F.col("name"), "relation name"),
        F.col("h.name"),
    )
    return _lines(named, source, target)


def topic_lines(records: DataFrame, topics: list[str] = ANSWER_TOPICS) -> DataFrame:
    """``(best_answer, topic)``: the answer as a line under its topic's name."""
    split = ["split"] if "split" in records.columns else []
    return records.select(
        "id",
        *split,
        name_of(F.col("topic"), topics).alias("topic_name"),
        clean_line(F.col("best_answer")).alias("line"),
    )


MODES = {
    "nli": sentence_pair_lines,
    "classification": classification_lines,
    "summarization": summary_lines,
    "text2rel": relation_lines,
    "style-transfer": topic_lines,
}
