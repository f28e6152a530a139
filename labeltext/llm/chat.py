"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of typed parts: text, image, audio and document. A
visitor goes over them in order and flattens each: a text becomes itself, any
other part a placeholder between control strings, whose ordinal in the
conversation is its place in the list of attachments; the attachment keeps the
part's kind and reference and counts the tokens that its placeholder expands to.

The layout writes ``<|im_start|>role\\ncontent<|im_end|>\\n`` per turn. A ``<|``
or a backslash inside a text or role gets a backslash before its second or only
character. Texts that stand next to each other are escaped together, not part by part,
so no control string can arise from content, and ``plain`` undoes it exactly. The
loss mask is a list of spans, in characters of the formatted string, that cover each
assistant text once.

Defined cases: a null text or part counts as empty, null content as no part, a
null role as the empty role; turns with the same number are ordered by role, then
content; an unknown kind of part is flattened like a text; a row without a
conversation id is a conversation of its own, so that such rows, however many,
never meet; an empty table gives no conversations. A conversation is one output
string, so its turns meet in one row by nature; time grows as n log n in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltext.functions.lookups import let

# Control strings of the layout.
START, END = "<|im_start|>", "<|im_end|>"
MARKS = {"image": ("<|image_start|>", "<|image_end|>"), "audio": ("<|audio_start|>", "<|audio_end|>"), "document": ("<|doc_start|>", "<|doc_end|>")}

PART = "struct<kind:string,text:string,ref:string,units:bigint>"
# Tokens that a placeholder expands to: a fixed share and one per so many units
# (pixels of an image, milliseconds of audio, characters of a document).
EXPANSION = {"image": (2, 28 * 28), "audio": (2, 40), "document": (2, 4)}


def escaped(text: Column) -> Column:
    """``text`` with a backslash after each backslash and between ``<`` and ``|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def plain(text: Column) -> Column:
    """``escaped`` undone."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def text_part(text: Column | str) -> Column:
    """A content of one text part."""
    text = F.col(text) if isinstance(text, str) else text
    empty = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), empty.alias("ref"), F.lit(None).cast("bigint").alias("units")))


def is_kind(part: Column, kind: str) -> Column:
    return F.coalesce(part["kind"] == kind, F.lit(False))


def attached(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*MARKS), F.lit(False))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for texts."""
    units = F.coalesce(part["units"], F.lit(0))
    tokens = F.lit(0).cast("bigint")
    for kind, (fixed, per) in EXPANSION.items():
        tokens = F.when(is_kind(part, kind), (fixed + F.ceil(units / per)).cast("bigint")).otherwise(tokens)
    return tokens


def placeholder(part: Column, ordinal: Column) -> Column:
    """What stands for an attached part, with its ordinal; null for other parts."""
    out = F.lit(None).cast("string")
    for kind, (before, after) in MARKS.items():
        out = F.when(is_kind(part, kind), F.concat(F.lit(before), ordinal.cast("string"), F.lit(after))).otherwise(out)
    return out


def visited(parts: Column, before: Column) -> Column:
    """The flattened text of ``parts``, ``before`` attachments standing earlier.

    Texts between two attachments are put together first and escaped as one, so that
    no control string can arise where they meet. Each part is read once.
    """
    def flat(every: Column, at: Column) -> Column:
        def run(end: Column, k: Column) -> Column:
            start = F.coalesce(F.get(at, k - 1) + 1, F.lit(0))
            texts = F.transform(F.slice(every, start + 1, end - start), lambda p: F.coalesce(p["text"], F.lit("")))
            mark = placeholder(F.get(every, end), before + k)
            return F.concat(escaped(F.array_join(texts, "")), F.coalesce(mark, F.lit("")))

        return F.array_join(F.transform(F.concat(at, F.array(F.size(every))), run), "")

    places = lambda every: F.array_compact(F.transform(every, lambda p, i: F.when(attached(p), i)))
    return let(parts, lambda every: let(places(every), lambda at: flat(every, at)))


def formatted(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """``(key, n_turns, formatted, loss_mask, attachments)``: a row per conversation.

    ``content`` is an array of parts (``PART``). ``loss_mask`` holds spans
    (start, end), ``attachments`` rows (ordinal, turn, kind, ref, tokens). Places are
    running sums over the turns, so the work grows with them and not with their square.
    """
    parts = F.coalesce(F.col(content).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = turns.select(
        F.col(key).alias("_key"), F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("_own"),
        F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), parts.alias("parts"),
    )
    order = Window.partitionBy("_key", "_own").orderBy("turn", "role", "parts")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("int")
    counted = rows.withColumn("before", sum_before(F.size(F.filter("parts", attached))))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    written = counted.select(
        "_key", "_own", "turn", "role", "parts", "before", head.alias("head"), visited(F.col("parts"), F.col("before")).alias("body")
    )
    tail = END + "\n"
    length = F.char_length("head") + F.char_length("body") + len(tail)
    start = sum_before(length) + F.char_length("head")
    listed = F.transform(
        F.filter("parts", attached),
        lambda p, i: F.struct(
            (F.col("before") + i).alias("ordinal"), F.col("turn").alias("turn"), p["kind"].alias("kind"),
            p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"),
        ),
    )
    placed = written.select(
        "_key", "_own", F.row_number().over(order).alias("n"), F.concat("head", "body", F.lit(tail)).alias("line"),
        F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.char_length("body")).alias("end"))).alias("span"),
        listed.alias("listed"),
    )
    grouped = placed.groupBy("_key", "_own").agg(F.sort_array(F.collect_list(F.struct("n", "line", "span", "listed"))).alias("lines"))
    return grouped.select(
        F.col("_key").alias(key),
        F.size("lines").cast("long").alias("n_turns"),
        F.array_join("lines.line", "").alias("formatted"),
        F.array_compact("lines.span").alias("loss_mask"),
        F.flatten("lines.listed").alias("attachments"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text), unescaped."""
    def turn(segment: Column) -> Column:
        # An escaped newline of the role has a backslash before it; the first bare one ends the role.
        role = F.regexp_extract(segment, r"^(?s)((?:[^\\\n]|\\.)*+)\n", 1)
        length = F.char_length(segment) - F.char_length(role) - 1 - len(END) - 1
        body = F.substr(segment, F.char_length(role) + 2, length)
        return F.struct(plain(role).alias("role"), plain(body).alias("text"))

    return F.transform(F.slice(segments(text), 2, F.size(segments(text))), turn)


def segments(text: Column) -> Column:
    return F.split(text, r"<\|im_start\|>", -1)


def masked(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between the spans."""
    spans = F.transform(mask, lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"]))
    return F.array_join(F.transform(spans, plain), "")
