"""A sparse matrix of documents by terms whose terms are numbers, and products with it.

A document is one row of term numbers and counts, 6 bytes an entry; the terms' text and idf are
only in one sorted table that goes to the tasks. A product with a vector for each term takes some
columns of the vectors at a time: at most ``COLUMN_BYTES`` of them (or one column) reach
the tasks by broadcast, every task adds up its own documents, and what it gives out is one
vector per term in them, in a row for each ``RANGE`` terms. So neither the entries nor the
vectors meet anywhere as a whole, and what lies on disk is the matrix, two generations of the
vectors and one exchange of a few columns.

Files of a step are deleted as soon as the next one has read them: tables in a scratch folder
by name, shuffle files by Spark at the end of their query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltext.session import ensure_checkpoint_dir

# Bytes of a vector's columns that the tasks hold at a time.
COLUMN_BYTES = 64 << 20
# Terms of a row of vectors.
RANGE = 4096
# Entries that share a dictionary before terms are numbered.
SHARED_ENTRIES = 1 << 17
# Numbers that a product of single entries holds at a time.
STEP_NUMBERS = 1 << 18
# Terms of at least this share of the documents, at most so many of them, are multiplied
# as a dense matrix.
DENSE_SHARE, DENSE_TERMS = 0.004, 2048
# Rows of a batch: documents; rows of shared dictionaries or of vectors, which are far larger.
DOCUMENT_ROWS, LARGE_ROWS = 1000, 32

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

Batches = Iterator[pa.RecordBatch]


@contextmanager
def working(spark: SparkSession, rows: int) -> Iterator[None]:
    """For queries built and run inside: Arrow batches of ``rows``, shuffle files go with their query."""
    wanted = {BATCH_ROWS: str(rows), DELETE_SHUFFLES: "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder beside the checkpoints that goes at the end."""
    folder = f"{ensure_checkpoint_dir(spark)}/coded-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# --- terms -------------------------------------------------------------------------


@dataclass
class Lookup:
    """Terms by their key; numbers go from the most frequent term to the least."""

    keys: np.ndarray  # ascending
    rank: np.ndarray  # of each key
    names: pa.Array  # by number
    idf: np.ndarray  # by number

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """The number of each term, -1 without one."""
        if not len(self.keys):
            return np.full(len(terms), -1, np.int32)
        at = self.rank[np.minimum(np.searchsorted(self.keys, term_keys(terms)), len(self.keys) - 1)]
        same = pc.equal(self.names.take(pa.array(at)), terms).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1).astype(np.int32)


def term_keys(terms: pa.Array) -> np.ndarray:
    return pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False)


def lookup(table: DataFrame, most_terms: int, most_bytes: int) -> tuple[Lookup, np.ndarray] | None:
    """The terms of ``table(term, df, idf)`` and their document frequencies by number; None
    if there are more or larger ones, or two of them share a key."""
    size = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    if size.n > most_terms or (size.bytes or 0) > most_bytes:
        return None
    known = table.select("term", "df", "idf").toArrow()
    names = pa.concat_arrays(known.column("term").chunks or [pa.array([], pa.string())])
    df, keys = known.column("df").to_numpy(), term_keys(names)
    order = np.lexsort((keys, -df))
    names, keys = names.take(pa.array(order)), keys[order]
    rank = np.argsort(keys)
    keys = keys[rank]
    if (keys[1:] == keys[:-1]).any():
        return None
    return Lookup(keys, rank.astype(np.int32), names, known.column("idf").to_numpy()[order]), df[order]


# --- the matrix --------------------------------------------------------------------


@dataclass
class Coded:
    """``rows(doc_id, fit, at, tf, norm)``: the terms' numbers and counts of every document that has
    any, in as many partitions as there are cores; a weight is tf * idf / norm. ``terms(term)``;
    ``dense`` terms are frequent ones, ``number`` is that of all."""

    rows: DataFrame
    terms: DataFrame
    shared: Broadcast
    number: int
    dense: int

    def fitted(self) -> Coded:
        """The same of the documents that are marked ``fit``."""
        return Coded(self.rows.where("fit"), self.terms, self.shared, self.number, self.dense)

    def squares(self) -> DataFrame:
        """``(s)``: the sum of the squared weights of each term, without an order."""
        shared, number = self.shared, self.number

        def run(batches: Batches) -> Batches:
            total = np.zeros(number)
            for batch in batches:
                _, at, value = _weights(batch, shared.value.idf)
                np.add.at(total, at, value * value)
            for a in range(0, number, RANGE):
                at = a + np.flatnonzero(total[a : a + RANGE]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "s"])

        with working(self.rows.sparkSession, DOCUMENT_ROWS):
            return self.rows.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).select("s").checkpoint()


def coded(counts: DataFrame, terms_of: Callable[[DataFrame, int], DataFrame], most_terms: int, most_bytes: int) -> Coded | None:
    """``counts(doc_id, fit, counts array<struct<term, tf>>)`` as a matrix of TF-IDF weights.

    ``terms_of(frequencies, n)`` makes ``(term, df, idf)`` of the frequencies ``(term, df)``
    in the n rows marked ``fit``. Rows of an id are one document and share its norm. None
    if the terms cannot be looked up. The counts are computed once: they are kept with a
    dictionary for each batch of rows until their terms have numbers.
    """
    spark = counts.sparkSession
    with scratch(spark) as folder:
        doc = counts.schema["doc_id"].dataType.simpleString()
        schema = f"n bigint, docs array<{doc}>, fit array<boolean>, sizes array<int>, codes array<int>, tf array<int>, terms array<string>, df array<bigint>"
        with working(spark, DOCUMENT_ROWS):
            split = counts.select("doc_id", "fit", F.col("counts.term").alias("terms"), F.col("counts.tf").alias("tf"))
            split.mapInArrow(_packed, schema).write.parquet(f"{folder}/counts")
        with working(spark, LARGE_ROWS):
            packed = spark.read.parquet(f"{folder}/counts")
            n, most = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.array_max("tf")), F.lit(0))).first()
            count = "smallint" if most < 1 << 15 else "int"
            seen = packed.select(F.explode(F.arrays_zip("terms", "df")).alias("t"))
            table = terms_of(seen.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df")), n).checkpoint()
            found = lookup(table, most_terms, most_bytes)
            if found is None:
                return None
            names, df = found
            shared, cores = spark.sparkContext.broadcast(names), spark.sparkContext.defaultParallelism
            numbered = packed.select("docs", "fit", "sizes", "codes", "tf", "terms").mapInArrow(
                _numbered(shared, pa.int16() if count == "smallint" else pa.int32()), f"doc_id {doc}, fit boolean, at array<int>, tf array<{count}>"
            )
            dealt = numbered.repartition(cores, "doc_id").sortWithinPartitions("doc_id")
            rows = dealt.mapInArrow(_normed(shared), f"doc_id {doc}, fit boolean, at array<int>, tf array<{count}>, norm double").checkpoint()
    dense = min(int((df >= max(1, DENSE_SHARE * n)).sum()), DENSE_TERMS)
    return Coded(rows, table.select("term"), shared, len(df), dense)


def _packed(batches: Batches) -> Batches:
    """Some rows' counts as one: terms are numbers of their common dictionary."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // SHARED_ENTRIES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            rows, own = batch.slice(a, b - a), sizes[a:b].astype(np.int32)
            fit = rows.column("fit").to_numpy(zero_copy_only=False).astype(bool)
            coded = rows.column("terms").flatten().dictionary_encode()
            codes, kept = coded.indices.to_numpy(), own > 0
            df = np.bincount(codes[np.repeat(fit, own)], minlength=len(coded.dictionary))
            filled = rows.filter(pa.array(kept))
            one = [filled.column("doc_id"), filled.column("fit"), own[kept], codes, filled.column("tf").flatten(), coded.dictionary, df]
            lists = [_list([len(v)], v if isinstance(v, pa.Array) else pa.array(v)) for v in one]
            yield pa.RecordBatch.from_arrays([pa.array([int(fit.sum())]), *lists], ["n", "docs", "fit", "sizes", "codes", "tf", "terms", "df"])


def _numbered(shared: Broadcast, count: pa.DataType) -> Callable[[Batches], Batches]:
    """Rows of documents again, with the numbers of all known terms in place of text."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, fit, sizes, codes, tf, terms = (batch.column(k)[i].values for k in ("docs", "fit", "sizes", "codes", "tf", "terms"))
                at = shared.value.numbers(terms)[codes.to_numpy()]
                known, ends = at >= 0, np.cumsum(sizes.to_numpy())
                to = np.append(0, np.cumsum(known))[ends]
                own = np.diff(to, prepend=0)
                keep = pa.array(own > 0)
                lists = [_list(own[own > 0], v) for v in (pa.array(at[known]), tf.filter(pa.array(known)).cast(count))]
                yield pa.RecordBatch.from_arrays([docs.filter(keep), fit.filter(keep), *lists], ["doc_id", "fit", "at", "tf"])

    return run


def _normed(shared: Broadcast) -> Callable[[Batches], Batches]:
    """Rows sorted by id as documents with their norm; rows of an id are one document."""

    def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        starts = _starts(rows)
        own = rows.column("at").value_lengths().to_numpy(zero_copy_only=False)
        at, tf = (rows.column(k).flatten() for k in ("at", "tf"))
        value = tf.to_numpy() * shared.value.idf[at.to_numpy()]
        first = np.append(0, np.cumsum(own))[starts]
        sizes = np.diff(np.append(first, len(at)))
        norm = np.sqrt(np.add.reduceat(value * value, first))
        fit = np.logical_or.reduceat(rows.column("fit").to_numpy(zero_copy_only=False).astype(bool), starts)
        lists = [_list(sizes, v) for v in (at, tf)]
        docs = rows.column("doc_id").take(pa.array(starts))
        return pa.RecordBatch.from_arrays([docs, pa.array(fit), *lists, pa.array(norm)], ["doc_id", "fit", "at", "tf", "norm"])

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []  # rows of the last id so far
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch)
            if held and held[-1].column("doc_id")[-1].as_py() == batch.column("doc_id")[0].as_py():
                end = int(starts[1]) if len(starts) > 1 else batch.num_rows
                held.append(batch.slice(0, end))
                batch, starts = batch.slice(end), starts[1:] - end
                if not batch.num_rows:
                    continue
            if held:
                yield one(held)
            if starts[-1]:
                yield one([batch.slice(0, int(starts[-1]))])
            held = [batch.slice(int(starts[-1]))]
        if held:
            yield one(held)

    return run


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where each id begins; a missing id is one too."""
    return np.flatnonzero(np.diff(batch.column("doc_id").dictionary_encode("encode").indices.to_numpy(), prepend=-1))


def _weights(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many entries each document has, their terms and their weights."""
    sizes = batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
    at, tf = (batch.column(k).flatten().to_numpy() for k in ("at", "tf"))
    return sizes, at, tf * idf[at] / np.repeat(batch.column("norm").to_numpy(), sizes)


def _list(sizes: np.ndarray | list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


# --- vectors of the terms ----------------------------------------------------------


@dataclass
class Table:
    """Vectors ``rows(term, v)``; ``of(a, b)`` are their columns from a to b."""

    of: Callable[[int, int], DataFrame]

    def columns(self, matrix: Coded, a: int, b: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Columns of every term's vector, and which terms have one."""
        shared, name = matrix.shared, _name(kind)

        def cut(batches: Batches) -> Batches:
            for batch in batches:
                at = shared.value.numbers(batch.column("term"))
                v = batch.column("v").flatten().to_numpy().reshape(len(at), -1)[at >= 0].astype(kind)
                at = at[at >= 0]
                yield pa.RecordBatch.from_arrays([pa.array(at), _list(np.full(len(at), b - a), pa.array(v.ravel()))], ["at", "v"])

        out, known = np.zeros((matrix.number, b - a), kind), np.zeros(matrix.number, bool)
        with working(matrix.rows.sparkSession, RANGE):
            found = self.of(a, b).mapInArrow(cut, f"at int, v array<{name}>").toArrow()
        for batch in found.to_batches():
            at = batch.column("at").to_numpy()
            out[at], known[at] = batch.column("v").flatten().to_numpy().reshape(len(at), b - a), True
        return out, known


def table(rows: DataFrame) -> Table:
    return Table(lambda a, b: rows.select("term", F.slice(F.col("v").cast("array<double>"), a + 1, b - a).alias("v")))


@dataclass
class Stored:
    """Vectors in ``rows(r, m)``, ``RANGE`` terms each, times ``rotation``."""

    rows: DataFrame
    kind: type
    rotation: np.ndarray

    def turned(self, rotation: np.ndarray) -> Stored:
        return Stored(self.rows, self.kind, self.rotation @ rotation)

    def columns(self, matrix: Coded, a: int, b: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        rotation, own = np.ascontiguousarray(self.rotation[:, a:b]), self.kind

        def turn(batches: Batches) -> Batches:
            for batch in batches:
                done = [(_matrix(m, own, len(rotation)) @ rotation).astype(kind).tobytes() for m in batch.column("m")]
                yield pa.RecordBatch.from_arrays([batch.column("r"), pa.array(done, pa.binary())], ["r", "m"])

        out = np.zeros((matrix.number, b - a), kind)
        with working(matrix.rows.sparkSession, LARGE_ROWS):
            found = self.rows.mapInArrow(turn, "r int, m binary").toArrow()
        for batch in found.to_batches():
            for r, m in zip(batch.column("r").to_pylist(), batch.column("m"), strict=True):
                v = _matrix(m, kind, b - a)
                out[r * RANGE : r * RANGE + len(v)] = v
        return out, np.ones(matrix.number, bool)

    def gram(self) -> np.ndarray:
        """V'V."""
        return self.rotation.T @ _gram(self.rows, self.kind, len(self.rotation)) @ self.rotation

    def checkpointed(self, matrix: Coded) -> DataFrame:
        """``(term, v)``."""
        rotation, own, shared = self.rotation, self.kind, matrix.shared

        def name(batches: Batches) -> Batches:
            for batch in batches:
                for r, m in zip(batch.column("r").to_pylist(), batch.column("m"), strict=True):
                    v = _matrix(m, own, len(rotation)) @ rotation
                    for a in range(0, len(v), DOCUMENT_ROWS):
                        part = v[a : a + DOCUMENT_ROWS]
                        terms = shared.value.names.slice(r * RANGE + a, len(part))
                        yield pa.RecordBatch.from_arrays([terms, _rows(part)], ["term", "v"])

        with working(matrix.rows.sparkSession, LARGE_ROWS):
            return self.rows.mapInArrow(name, "term string, v array<double>").checkpoint()


Vectors = Table | Stored


def _name(kind: type) -> str:
    return "float" if kind is np.float32 else "double"


def _matrix(value: pa.BinaryScalar, kind: type, width: int) -> np.ndarray:
    """The numbers of a binary value, read without a copy."""
    return np.frombuffer(value.as_buffer(), kind).reshape(-1, width)


def _rows(v: np.ndarray) -> pa.ListArray:
    return _list(np.full(len(v), v.shape[1]), pa.array(np.ascontiguousarray(v).ravel()))


def _gram(rows: DataFrame, kind: type, width: int) -> np.ndarray:
    """M'M of all ``m`` under each other, added up by the tasks first."""

    def run(batches: Batches) -> Batches:
        total = np.zeros((width, width))
        for batch in batches:
            for m in batch.column("m"):
                m = _matrix(m, kind, width).astype(np.float64)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), _rows(total)], ["i", "v"])

    with working(rows.sparkSession, LARGE_ROWS):
        partial = rows.select("m").mapInArrow(run, "i int, v array<double>")
        sums = partial.groupBy("i").agg(*[F.sum(F.col("v")[j]) for j in range(width)]).orderBy("i").collect()
    return np.array([r[1:] for r in sums]) if sums else np.zeros((width, width))


# --- products ----------------------------------------------------------------------


def _cuts(matrix: Coded, width: int, kind: type) -> list[tuple[int, int]]:
    """Columns in parts of about one size, each of ``COLUMN_BYTES`` at most."""
    most = max(1, COLUMN_BYTES // max(1, matrix.number * np.dtype(kind).itemsize))
    parts = -(-width // most)
    ends = [width * i // parts for i in range(parts + 1)]
    return list(zip(ends, ends[1:]))


def _add_sums(out: np.ndarray, into: np.ndarray, values: np.ndarray, of: np.ndarray, table: np.ndarray) -> None:
    """Adds the sum of ``values * table[of]`` for each ``into`` (ascending), in bounded memory."""
    step = max(256, STEP_NUMBERS // table.shape[1])
    for a in range(0, len(into), step):
        b = a + step
        first = np.flatnonzero(np.diff(into[a:b], prepend=-1))
        out[into[a:b][first]] += np.add.reduceat(values[a:b, None] * table[of[a:b]], first, axis=0)


@dataclass
class Part:
    """Some documents: entries of frequent terms as a dense matrix, the others one by one."""

    dense: np.ndarray
    row: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, idf: np.ndarray, dense: int, kind: type) -> Part:
        sizes, at, value = _weights(batch, idf)
        row, often = np.repeat(np.arange(len(sizes)), sizes), at < dense
        # A document may hold a term twice if rows share its id: their weights add up.
        full = np.bincount(row[often] * dense + at[often], value[often], len(sizes) * dense).astype(kind)
        return cls(full.reshape(len(sizes), dense), row[~often], at[~often], value[~often].astype(kind))

    def times(self, table: np.ndarray) -> np.ndarray:
        out = self.dense @ table[: self.dense.shape[1]]
        _add_sums(out, self.row, self.value, self.at, table)
        return out

    def back(self, out: np.ndarray, into: np.ndarray) -> None:
        """Adds the transposed matrix times ``out`` to ``into``."""
        into[: self.dense.shape[1]] += self.dense.T @ out
        if not len(self.at):
            return
        # First the first entry of every term, then the second ones: each time a term comes once.
        order = np.argsort(self.at, kind="stable")
        first = np.flatnonzero(np.diff(self.at[order], prepend=-1))
        turn = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        order = order[np.argsort(turn, kind="stable")]
        step, a = max(256, STEP_NUMBERS // out.shape[1]), 0
        for end in np.cumsum(np.bincount(turn)).tolist():
            while a < end:
                i = order[a : min(end, a + step)]
                into[self.at[i]] += self.value[i, None] * out[self.row[i]]
                a += len(i)


def normal(matrix: Coded, vectors: Vectors, width: int, kind: type, folder: str) -> Stored:
    """A'A V, stored in ``folder``: each task gives out one vector per term in its documents,
    as numbers of ``kind``; they are added up as doubles."""
    spark, cuts = matrix.rows.sparkSession, _cuts(matrix, width, kind)
    for j, (a, b) in enumerate(cuts):
        sent = spark.sparkContext.broadcast(vectors.columns(matrix, a, b, kind)[0])
        with working(spark, DOCUMENT_ROWS):
            partial = matrix.rows.select("at", "tf", "norm").mapInArrow(_back(matrix, sent, kind), "r int, at binary, m binary")
            summed = partial.groupBy("r").applyInArrow(_summed(matrix.number, b - a, kind), "r int, m binary")
            summed.select("r", F.lit(j).alias("j"), "m").write.parquet(f"{folder}/{j}")
        sent.destroy()
        del sent
    return Stored(_side_by_side(spark, cuts, kind, "r", folder), kind, np.eye(width))


def _back(matrix: Coded, sent: Broadcast, kind: type) -> Callable[[Batches], Batches]:
    dense, shared = matrix.dense, matrix.shared

    def run(batches: Batches) -> Batches:
        table, idf = sent.value, shared.value.idf
        total, seen = np.zeros(table.shape), np.zeros(len(table), bool)
        for batch in batches:
            if batch.num_rows:
                part = Part.of(batch, idf, dense, kind)
                part.back(part.times(table), total)
                seen[batch.column("at").flatten().to_numpy()] = True
        for r in range(-(-len(table) // RANGE)):
            at = np.flatnonzero(seen[r * RANGE : (r + 1) * RANGE]).astype(np.int32)
            if len(at):
                m = total[r * RANGE + at].astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (at, m)]], ["r", "at", "m"])

    return run


def _summed(number: int, width: int, kind: type) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        r = group.column("r")[0].as_py()
        total = np.zeros((min(RANGE, number - r * RANGE), width))
        for at, m in zip(group.column("at"), group.column("m"), strict=True):
            total[np.frombuffer(at.as_buffer(), np.int32)] += _matrix(m, kind, width)
        return pa.table({"r": pa.array([r], pa.int32()), "m": pa.array([total.astype(kind).tobytes()], pa.binary())})

    return run


def _side_by_side(spark: SparkSession, cuts: list[tuple[int, int]], kind: type, key: str, folder: str) -> DataFrame:
    """The parts ``(key, j, m, ..)`` that lie in ``folder`` by number, joined to whole rows."""
    if len(cuts) == 1:
        return spark.read.parquet(f"{folder}/0").drop("j")
    with working(spark, LARGE_ROWS):
        parts = spark.read.parquet(*[f"{folder}/{j}" for j in range(len(cuts))])
        names = [c for c in parts.columns if c != "j"]

        def join(group: pa.Table) -> pa.Table:
            group = group.sort_by("j")
            m = np.hstack([_matrix(m, kind, cuts[j][1] - cuts[j][0]) for j, m in zip(group.column("j").to_pylist(), group.column("m"), strict=True)])
            first = group.slice(0, 1)
            return first.set_column(first.schema.get_field_index("m"), "m", pa.array([m.tobytes()], pa.binary())).select(names)

        schema = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in names)
        parts.groupBy(key).applyInArrow(join, schema).write.parquet(f"{folder}/all")
    for j in range(len(cuts)):
        delete(spark, f"{folder}/{j}")
    return spark.read.parquet(f"{folder}/all")


def _images(matrix: Coded, vectors: Vectors, width: int, folder: str) -> DataFrame:
    """``(key, docs, m)``: A V of a batch of documents that hold a known term, stored in ``folder``."""
    spark, cuts = matrix.rows.sparkSession, _cuts(matrix, width, np.float64)
    dense, shared = matrix.dense, matrix.shared
    doc = matrix.rows.schema["doc_id"].dataType.simpleString()
    for j, (a, b) in enumerate(cuts):
        sent = spark.sparkContext.broadcast(vectors.columns(matrix, a, b, np.float64))

        def times(batches: Batches) -> Batches:
            (table, known), idf = sent.value, shared.value.idf  # noqa: B023
            partition = TaskContext.get().partitionId()
            for number, batch in enumerate(batches):
                if not batch.num_rows:
                    continue
                at, sizes = batch.column("at").flatten().to_numpy(), batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
                holds = np.logical_or.reduceat(known[at], np.append(0, np.cumsum(sizes)[:-1]))
                m = Part.of(batch, idf, dense, np.float64).times(table)[holds]
                docs = batch.column("doc_id").filter(pa.array(holds))
                key = pa.array([(partition << 32) + number], pa.int64())
                yield pa.RecordBatch.from_arrays([key, _list([len(docs)], docs), pa.array([m.tobytes()], pa.binary())], ["key", "docs", "m"])

        with working(spark, DOCUMENT_ROWS):
            parts = matrix.rows.select("doc_id", "at", "tf", "norm").mapInArrow(times, f"key bigint, docs array<{doc}>, m binary")
            parts.withColumn("j", F.lit(j)).write.parquet(f"{folder}/{j}")
        sent.destroy()
        del sent
    return _side_by_side(spark, cuts, np.float64, "key", folder)


def image(matrix: Coded, vectors: Vectors, width: int) -> DataFrame:
    """``(doc_id, v)``: A V, of the documents that hold a term with a vector."""
    with scratch(matrix.rows.sparkSession) as folder:
        return _checkpointed(matrix, _images(matrix, vectors, width, folder), np.eye(width))


def _checkpointed(matrix: Coded, images: DataFrame, rotation: np.ndarray) -> DataFrame:
    """``(doc_id, v)`` of images, each times ``rotation``."""

    def unpack(batches: Batches) -> Batches:
        for batch in batches:
            for docs, m in zip(batch.column("docs"), batch.column("m"), strict=True):
                yield pa.RecordBatch.from_arrays([docs.values, _rows(_matrix(m, np.float64, len(rotation)) @ rotation)], ["doc_id", "v"])

    doc = matrix.rows.schema["doc_id"].dataType.simpleString()
    with working(matrix.rows.sparkSession, LARGE_ROWS):
        return images.select("docs", "m").mapInArrow(unpack, f"doc_id {doc}, v array<double>").checkpoint()


def image_gram(matrix: Coded, vectors: Vectors, width: int) -> np.ndarray:
    """(A V)'(A V)."""
    with scratch(matrix.rows.sparkSession) as folder:
        return _gram(_images(matrix, vectors, width, folder), np.float64, width)


def ritz(matrix: Coded, vectors: Vectors, width: int, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The ``most`` largest squares of singular values of A V, the rotation that V takes to their
    vectors, and ``(doc_id, v)``, A V so rotated."""
    with scratch(matrix.rows.sparkSession) as folder:
        found = _images(matrix, vectors, width, folder)
        squared, rotation = np.linalg.eigh(_gram(found, np.float64, width))
        best = np.argsort(squared)[::-1][:most]
        return squared[best], rotation[:, best], _checkpointed(matrix, found, rotation[:, best])
