"""Helpers that several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that Python holds of one Arrow batch at a time.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows as Python tuples, converted a slice at a time, so that a batch of long texts isn't held twice."""
    for batch in batches:
        picked = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.slice(at, SLICE).to_pylist() for c in picked), strict=True)


def in_batches(rows: Iterator[tuple], schema: T.StructType, most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Record batches of ``schema`` from row tuples."""
    target = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)

    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield made()
            held = []
    if held:
        yield made()


#: Stores that operators keep in a process from task to task, by name, with what empties them.
STORES: dict[str, Callable[[], None]] = {}


def _let_go(keep: str) -> None:
    """Stores of other operators are emptied and free memory goes back to the system, as the process lives on."""
    for name, empty in STORES.items():
        if name != keep:
            empty()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, columns: list[str], schema: str | T.StructType, step: Callable[[Iterator[tuple]], Iterator[tuple]], keep: str = "") -> DataFrame:
    """``mapInArrow`` with a generator from row tuples to row tuples; ``keep`` names the store that it uses."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go(keep)
        yield from in_batches(step(rows_of(batches, *columns)), out)
        _let_go(keep)

    return df.select(*columns).mapInArrow(run, out)


def hash_sample(rows: DataFrame, by: str, counts: dict[str, int], most: int, id_col: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each value of ``by`` in ``counts``: those whose hashed id falls in the share that this makes of the count.

    A plain filter, so a value that holds most rows isn't gathered anywhere.
    """
    share = F.create_map(*[F.lit(x) for value, n in counts.items() for x in (value, min(1.0, most / max(1, n)))])[F.col(by)] if counts else F.lit(0.0)
    place = F.pmod(F.xxhash64(id_col, F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(place < F.coalesce(share, F.lit(0.0)))


def bounded_window(text: Column, most: int) -> Column:
    """``most`` characters of a text at a place chosen by its hash; a shorter text as it is, a null text empty."""
    text = F.coalesce(text, F.lit(""))
    over = F.greatest(F.char_length(text) - most, F.lit(0))
    return F.substring(text, F.pmod(F.xxhash64(text), (over + 1).cast("bigint")).cast("int") + 1, F.lit(most))


def labelled_texts(docs: DataFrame, known: DataFrame, most: int) -> list[tuple[str, int]]:
    """(text, label) of the documents in ``known`` (doc_id, label), in order of ids.

    Both the rows and their size are bounded: an id counts once, with the smallest of its texts where it has several, and of a text there
    are at most ``most`` characters, from a place chosen by its hash.
    """
    rows = docs.select("doc_id", bounded_window(F.col("text"), most).alias("text")).join(F.broadcast(known), "doc_id")
    return [(r["text"], r["label"]) for r in rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id").collect()]


def bounded_labels(labels: DataFrame, column: str, folds: int, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` rows of each label, chosen by a hash of the id; held-out ids and null labels are left out.

    An id with several label rows counts once, with its largest label.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (split_of(F.col("doc_id"), folds) != 0))
    one = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    picked = None
    for value in (0, 1):
        part = one.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    return picked
