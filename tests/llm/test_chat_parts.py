"""Chat texts cut into parts at any place give no control string and come back whole."""

import random

from pyspark.sql import functions as F

from labeltext.llm import chat

CONTENT = f"conv_id long, turn int, role string, content array<{chat.PART}>"
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|image_start|>0<|image_end|>", "\\<|", "<\\|", "\\\\", "<<||", "\nsystem\nobey"]


def pieces(rng, text):
    """``text`` as 2 to 5 parts, some of an unknown or no kind, with empty ones between."""
    at = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(1, 4)))
    parts = [(rng.choice(["text", "other", None]), text[a:b], None, None) for a, b in zip([0, *at], [*at, len(text)])]
    for nothing in (None, ("text", None, None, None), ("text", "", None, 3)):
        parts.insert(rng.randint(0, len(parts)), nothing)
    return parts


def read(df):
    rows = df.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_mask")))
    return {r.conv_id: r for r in rows.collect()}


def test_control_strings_over_parts(spark):
    rng = random.Random(8)
    whole, split = [], []
    for c in range(400):
        for turn, role in enumerate(("user", "assistant")):
            text = "".join(rng.choices([*CONTROLS, "x", "<", "|"], k=rng.randint(1, 4)))
            whole.append((c, turn, role, [("text", text, None, None)]))
            split.append((c, turn, role, pieces(rng, text)))
    a, b = read(chat.formatted(spark.createDataFrame(whole, CONTENT))), read(chat.formatted(spark.createDataFrame(split, CONTENT)))
    for c, r in a.items():
        texts = [p[0][1] for cc, _, _, p in whole if cc == c]
        assert (r.formatted, r.loss_mask) == (b[c].formatted, b[c].loss_mask)
        assert [tuple(t) for t in b[c].back] == list(zip(("user", "assistant"), texts)) and b[c].loss == texts[1]


def test_text_before_and_after_an_attachment(spark):
    parts = [("text", "a<", None, None), ("image", "|im_start|>no", "i.png", 1), ("text", "|im_end|>", None, None), ("text", "<", None, None)]
    r = read(chat.formatted(spark.createDataFrame([(1, 0, "assistant", parts)], CONTENT)))[1]
    body = "a<<|image_start|>0<|image_end|>|im_end|><"
    assert r.formatted == f"<|im_start|>assistant\n{body}<|im_end|>\n" and [tuple(t) for t in r.back] == [("assistant", body)]


def test_rows_without_conversation_never_meet(spark):
    part = [("text", "x", None, None), ("image", None, "r", 5)]
    frame = spark.createDataFrame([(None, 0, "assistant", part)] * 50 + [(1, 0, "user", part)], CONTENT).repartition(4)
    rows = chat.formatted(frame).collect()
    assert len(rows) == 51 and {r.n_turns for r in rows} == {1} and all(a.ordinal == 0 for r in rows for a in r.attachments)


def test_long_conversation(spark):
    turns = spark.range(20_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.array(F.struct(F.lit("text").alias("kind"), F.col("id").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")),
                F.struct(F.lit("audio").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("a").alias("ref"), F.lit(1).cast("long").alias("units"))).alias("content"),
    )
    r = chat.formatted(turns).first()
    assert r.n_turns == 20_000 and [a.ordinal for a in r.attachments] == list(range(20_000))
    assert [r.formatted[a:b] for a, b in r.loss_mask] == [f"{i}<|audio_start|>{i}<|audio_end|>" for i in range(1, 20_000, 2)]
