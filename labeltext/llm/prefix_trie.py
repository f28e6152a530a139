"""Conversation prefix trie: ROLLUP over positional turn-id columns.

A turn's id is a digest of role and text with the text's length behind it. A
conversation becomes rows of ``WIDTH`` positional turn-id columns, a block each; a block's
key is the digest of the key before it and the turns between, that is, the trie node
at which it starts. One ``GROUP BY block, key, ROLLUP (t0, t1, ..)`` aggregates
every prefix of every conversation together, and ``grouping_id`` tells its depth; a
conversation longer than a block goes on in further rows, keyed by the node that the
prior block ends at.

Sums over subtrees are a second ROLLUP, over the nodes: a node's numbers reach all
its ancestors in its block. What lies in later blocks is added first, to the
node at which those start; blocks form a tree, whose sums come by pointer doubling,
in as many rounds as the number of blocks of the longest conversation has binary digits.

Counts and minima are combined map-side, so a prefix shared by a third of all
conversations is no hot key; nodes meet their parents through ``join_counted``. The
ids of conversations that end at one node are hashed as a stream: cut in ranges of
(node, id), written as pieces of bounded length, and those pieces hashed in order.
Turns, not texts, are shuffled; one conversation's turns are numbered by one task as a
sorted stream.

Defined cases: a null role or text counts as empty; turns are ordered by number (null
first), those with equal numbers by role, then by the first 32 characters of the text,
then by digest; repeated rows are turns of their own; rows without ``conv_id`` belong to
no conversation and are left out; a conversation without turns ends at the root; an
empty table has no root and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltext.llm.common import checkpointed
from labeltext.operators.scale import join_counted

WIDTH = 8
DIGEST, LENGTH = 16, 4  # bytes of a turn id: a cut SHA-256, then the text's code points
ID = DIGEST + LENGTH
TIE_CHARS = 32
PIECE_BYTES = 1 << 16
ROOT = bytes(DIGEST)
TURNS = [f"t{i}" for i in range(WIDTH)]


def digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, DIGEST)


def turn_id(role: Column, text: Column) -> Column:
    """Digest of role and text, then the text's length in code points."""
    length = F.unhex(F.lpad(F.hex(F.char_length(text)), 2 * LENGTH, "0"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.concat(digest(whole), length)


def numbered(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, tid)``: the turns of each conversation, from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.substring(text, 1, TIE_CHARS).alias("head"), turn_id(role, text).alias("tid"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "head", "tid"))
    return rows.select("conv_id", place.cast("long").alias("pos"), "tid")


def unchanged(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, tid)`` of conversations as they are; position 0 stands for each
    conversation, so that one without turns is there too."""
    found = numbered(turns)
    return found.unionByName(_present(found))


def rebuilt(turns: DataFrame, group: int, head_turns: Column, most_heads: int) -> DataFrame:
    """``unchanged`` of conversations that begin like the first of their group.

    The first ``head_turns`` (of ``conv_id``, at most ``most_heads``) turns of
    conversation ``c - c % group`` stand before the turns of ``c`` after as many. No
    conversation of a group has a hot key: it has at most 2 * ``group`` members.
    """
    found = checkpointed(numbered(turns))
    present = _present(found)
    own = found.where(F.col("pos") > head_turns)
    heads = found.where((F.col("conv_id") % group == 0) & (F.col("pos") <= most_heads))
    heads = heads.withColumnRenamed("conv_id", "base")
    based = present.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = based.join(heads, "base").where(F.col("pos") <= head_turns).select("conv_id", "pos", "tid")
    return present.unionByName(own).unionByName(first)


def _present(found: DataFrame) -> DataFrame:
    once = found.where("pos = 1")
    return once.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"))


def sha16(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:DIGEST]


def block_rows(placed: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(conv_id, block, key, ends, t0, ..)``: conversations as rows of ``width`` turn ids.

    ``ends`` is the node at which the conversation ends, in its last row, else null.
    A task reads its conversations turn by turn, so no conversation is ever held whole.
    """
    dealt = placed.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    columns = ["conv_id", "block", "key", "ends", *[f"t{i}" for i in range(width)]]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.binary()] * width]
    schema = pa.schema(list(zip(columns, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in columns]
        conv, block, key, turns = None, 0, ROOT, []

        def give(last: bool) -> bytes:
            node = sha16(key + b"".join(turns)) if turns else key
            row = [conv, block, key, node if last else None, *turns, *[None] * (width - len(turns))]
            for values, value in zip(out, row):
                values.append(value)
            return node

        for batch in batches:
            for c, tid in zip(batch.column("conv_id").to_pylist(), batch.column("tid").to_pylist()):
                if c != conv:
                    if conv is not None:
                        give(True)
                    conv, block, key, turns = c, 0, ROOT, []
                if tid is None:
                    continue
                if len(turns) == width:
                    key, block, turns = give(False), block + 1, []
                turns.append(tid)
            if len(out[0]) >= 4096:
                yield pa.RecordBatch.from_pydict(dict(zip(columns, out)), schema)
                out = [[] for _ in columns]
        if conv is not None:
            give(True)
        yield pa.RecordBatch.from_pydict(dict(zip(columns, out)), schema)

    names = ", ".join(f"t{i} binary" for i in range(width))
    return dealt.select("conv_id", "tid").mapInArrow(run, f"conv_id long, block int, key binary, ends binary, {names}")


def rolled_up(rows: DataFrame, sums: str, width: int) -> DataFrame:
    """``GROUP BY block, key, ROLLUP (t0, ..)`` of block rows: a row per trie node.

    ``level`` is the number of turns after the block's start, from ``grouping_id``.
    Groups in which the last of those is null belong to rows that end earlier and
    go; so does the start of a later block, which is a node of the block before it.
    """
    names = [f"t{i}" for i in range(width)]
    query = f"""
        SELECT block, key, {", ".join(names)}, {width} - bit_count(grouping_id()) AS level, {sums}
        FROM {{rows}} GROUP BY block, key, ROLLUP ({", ".join(names)})
    """
    found = rows.sparkSession.sql(query, rows=rows)
    last = F.get(F.array(*names), F.col("level") - 1)
    whole = F.concat("key", *[F.coalesce(n, F.lit(b"")) for n in names])
    parent = F.when(F.col("level") > 1, digest(F.expr(f"substring(_path, 1, octet_length(_path) - {ID})")))
    node = F.when(F.col("level") == 0, F.col("key")).otherwise(digest(F.col("_path")))
    length = F.conv(F.hex(F.substring(last, DIGEST + 1, LENGTH)), 16, 10).cast("long")
    return (
        found.where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull()))
        .withColumn("_path", whole)
        .withColumns(
            {
                "node": node,
                "parent": F.when(F.col("level") == 1, F.col("key")).otherwise(parent),
                "depth": (F.col("block") * width + F.col("level")).cast("long"),
                "length": F.coalesce(length, F.lit(0).cast("long")),
            }
        )
        .drop("_path")
    )


def _block_sums(nodes: DataFrame, width: int) -> DataFrame:
    """``(node, later_saved, later_leaves)``: sums of all blocks that start below a node.

    ``anc`` is the block so many blocks up; a round adds each block's sums to its
    ``anc`` and doubles the way. Blocks without ``anc`` are done.
    """
    own = nodes.where("block > 0").groupBy("key").agg(F.sum("value").alias("saved"), F.sum("leaf").alias("leaves"))
    starts = nodes.where(f"level = {width}").select(F.col("node").alias("key"), F.col("key").alias("anc"), F.col("block").alias("of"))
    starts = starts.select("key", F.when(F.col("of") > 0, F.col("anc")).alias("anc"))
    now = checkpointed(own.join(starts, "key"))
    while now.where("anc IS NOT NULL").limit(1).count():
        below = checkpointed(
            now.where("anc IS NOT NULL").groupBy("anc")
            .agg(F.count("*").alias("n"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        )
        up = below.join(now.select(F.col("key").alias("anc"), F.col("anc").alias("next")), "anc").select("anc", "n", "next")
        moved = join_counted(now.where("anc IS NOT NULL"), up, ["anc"], "n").select("key", "saved", "leaves", F.col("next").alias("anc"))
        still = now.where("anc IS NULL").unionByName(moved)
        gains = below.select(F.col("anc").alias("key"), "more_saved", "more_leaves")
        now = checkpointed(
            still.join(gains, "key", "left").select(
                "key", (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), "anc",
            )
        )
    return now.select(F.col("key").alias("node"), F.col("saved").alias("later_saved"), F.col("leaves").alias("later_leaves"))


def ends_hash(ends: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``(node, ends_sha256)`` of ``(node, conv_id)``: the ids in order, joined by commas.

    Ranges of (node, id) cut a node of many ids over many tasks, whose pieces of at
    most ``piece_bytes`` and an id are then hashed in order: a stream, never a list.
    """
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (n != node or size >= piece_bytes):
                    out.append((node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = n, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
                if len(out) >= 1024:
                    yield _batch(out, schema)
                    out = []
        if ids:
            out.append((node, first, ",".join(ids)))
        yield _batch(out, schema)

    cut = ranged.select("node", "conv_id").mapInArrow(pieces, "node binary, first long, piece string")
    dealt = cut.repartition("node").sortWithinPartitions("node", "first")
    hashed_schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for n, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
                if n == node:
                    state.update(b"," + piece.encode())
                    continue
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(piece.encode())
            if len(out) >= 4096:
                yield _batch(out, hashed_schema)
                out = []
        if node is not None:
            out.append((node, state.hexdigest()))
        yield _batch(out, hashed_schema)

    return dealt.mapInArrow(hashed, "node binary, ends_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def trie(placed: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per node of the prefix trie of ``(conv_id, pos, tid)``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes of the subtree, itself included),
    ``saved_tokens`` (of the subtree, each node's ``n_convs - 1`` times its last text's
    code points), ``ends_sha256`` (members that end here).
    """
    rows = checkpointed(block_rows(placed, width))
    members = "min(conv_id) AS conv_id, count(*) AS n_convs"
    found = checkpointed(rolled_up(rows.drop("ends"), members, width))
    children = found.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = checkpointed(
        found.join(children, "node", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .withColumns(
            {
                "value": (F.col("n_convs") - 1) * F.col("length"),
                "leaf": (F.col("n_children") == 0).cast("long"),
            }
        )
    )
    # Nodes at a block's end take the sums of the blocks that start there along.
    laden = nodes
    if nodes.where("block > 0").limit(1).count():
        later = _block_sums(nodes, width)
        laden = nodes.join(later, "node", "left").withColumns(
            {
                "value": F.col("value") + F.coalesce("later_saved", F.lit(0)),
                "leaf": F.col("leaf") + F.coalesce("later_leaves", F.lit(0)),
            }
        )
    names = [f"t{i}" for i in range(width)]
    below = rolled_up(laden.select("block", "key", *names, "value", "leaf"), "sum(value) AS saved_tokens, sum(leaf) AS n_leaves", width)
    ends = ends_hash(rows.where("ends IS NOT NULL").select(F.col("ends").alias("node"), "conv_id"))
    whole = nodes.join(below.select("node", "saved_tokens", "n_leaves"), "node").join(ends, "node", "left")
    slim = checkpointed(
        whole.select(
            "node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
    parents = slim.where("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below_root = join_counted(slim.where("depth > 0"), parents, ["parent"], "n")
    root = slim.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below_root.select(columns).unionByName(root.select(columns))
