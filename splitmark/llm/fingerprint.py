"""Document fingerprints by winnowing.

Every k-gram of code points gets a polynomial hash; in each window of ``window`` successive k-grams the smallest hash is chosen, the
rightmost of equal ones, and chosen hashes keep their positions. Any passage of ``k + window - 1`` code points that two texts share
holds a k-gram that both choose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitmark.llm.common import in_batches, map_rows, rows_of
from splitmark.session import parallelism


@dataclass(frozen=True)
class WinnowParams:
    """``k``: code points of a gram. ``window``: successive grams of which one at least is chosen."""

    k: int = 16
    window: int = 8


#: Multiplier of the polynomial and of the finalizer; any odd 64-bit constants would do.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)
#: Code points hashed at a time; memory doesn't grow with a text's length.
BLOCK = 1 << 20


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams, by doubling: a gram's hash follows from those of its two parts."""
    part, width = codes.astype(np.uint64) + np.uint64(1), 1
    whole, done = None, 0
    while True:
        if k & width:
            if whole is None:
                whole, done = part, width
            else:
                n = min(len(whole), len(part) - done)
                whole, done = whole[:n] * _power(width) + part[done : done + n], done + width
        if width * 2 > k:
            break
        part, width = part[:-width] * _power(width) + part[width:], width * 2
    whole = whole[: len(codes) - k + 1]
    whole = (whole ^ (whole >> HALF)) * MIX
    return (whole ^ (whole >> HALF)) * MIX >> HALF


def _window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """The smallest key of every window, by doubling."""
    width, least = 1, keys
    while width * 2 <= window:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    rest = window - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def winnow(text: str | None, params: WinnowParams = WinnowParams()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from the whole text, in order of position; both empty for a null or empty text.

    A text shorter than ``k`` counts as one gram at position 0, one with fewer than ``window`` grams as one window.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(codes) < params.k:
        return gram_hashes(codes, len(codes)).astype(np.uint32), np.zeros(1, np.int64)
    hashes, places = [], []
    for at in range(0, len(codes) - params.k + 1, BLOCK):
        grams = gram_hashes(codes[at : at + BLOCK + params.k - 1 + params.window - 1], params.k)
        if at and len(grams) < params.window:
            break
        keys = grams << HALF | LOW - np.arange(len(grams), dtype=np.uint64)
        least = _window_minima(keys, min(params.window, len(keys)))
        fresh = least[np.concatenate(([True], least[1:] != least[:-1]))]
        hashes.append((fresh >> HALF).astype(np.uint32))
        places.append((LOW - (fresh & LOW)).astype(np.int64) + at)
    if len(hashes) == 1:
        return hashes[0], places[0]
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], place


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: WinnowParams = WinnowParams()) -> DataFrame:
    """One row per document: (id, hashes array<bigint>, positions array<bigint>), as :func:`winnow` chooses them.

    Null and empty texts: empty arrays. Repeated rows: one result each. Other columns aren't read.
    """

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            hashes, places = winnow(text, params)
            yield key, hashes.tolist(), places.tolist()

    return map_rows(docs, [id_col, text_col], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, hashes array<bigint>, positions array<bigint>", step)


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by bisection inside the JVM."""
    steps, width = [], 1
    while width <= len(bounds):
        steps.insert(0, width)
        width *= 2
    padded = F.lit(bounds + [2**63 - 1] * (2 * (steps[0] if steps else 1) - len(bounds)))
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(padded, at + s - 1) <= key), at + s).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (part, tail, key, doc_id, text), dealt by ranges of doc_id, each range followed by the row that comes after it.

    Ranges begin at ids that exist, so the row after a range is the first of the next one: a copy of it goes along, marked
    ``tail``. The last range gets the first row of all. One pass over the ids finds the bounds; texts are shuffled once.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parallelism(docs.sparkSession)
    cuts = rows.select("key").agg(F.min("key").alias("low"), F.expr(f"percentile_approx(key, array({', '.join(f'{i / parts:.8f}D' for i in range(1, parts)) or '0.5D'}), {max(10000, 20 * parts)})").alias("cuts")).first()
    low, bounds = cuts["low"], sorted({c for c in cuts["cuts"] or [] if c > cuts["low"]})
    last = len(bounds)
    part = _place(F.col("key"), bounds)
    edge = F.when(F.col("key") == low, F.array(F.col("part"), F.lit(last + last + 1))) if low is not None else F.when(F.lit(False), F.array(F.col("part"), F.col("part")))
    if bounds:
        edge = edge.when(F.get(F.lit(bounds), F.col("part") - 1) == F.col("key"), F.array(F.col("part"), F.col("part") + last))
    # A tail is coded as its range plus last + 1, so that one explode makes both copies.
    placed = rows.withColumn("part", part).withColumn("slot", F.explode(edge.otherwise(F.array(F.col("part")))))
    placed = placed.select(F.when(F.col("slot") > last, F.col("slot") - last - 1).otherwise(F.col("slot")).cast("int").alias("part"), (F.col("slot") > last).alias("tail"), "key", "doc_id", "text")
    return placed.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "tail", "key", "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as many code points from the start of ``following``, or all."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def op1_winnowing(docs: DataFrame, params: WinnowParams = WinnowParams()) -> DataFrame:
    """Fingerprints of every text and its edited text, and likenesses to the edited and the next text.

    Null text counts as empty. Rows with a null id come first, rows with equal ids follow each other by text. A single row is
    followed by itself. The fingerprint string is the chosen hashes in order of position, eight hex digits each; ``positions`` has their
    positions in the same way.
    """

    def step(batches: Iterator) -> Iterator[tuple]:
        def told(here: tuple, following: tuple) -> tuple:
            doc_id, text, (hashes, places) = here
            changed = edited(text, following[1])
            other, _ = winnow(changed, params)
            return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), hashes.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(hashes, other), likeness(hashes, following[2][0]), places.astype(">u4").tobytes().hex()

        held, at = None, None
        for part, tail, doc_id, text in rows_of(batches, "part", "tail", "doc_id", "text"):
            if part != at:
                held, at = None, part
            if tail and held is None:
                continue
            here = (doc_id, text or "", winnow(text, params))
            if held is not None:
                yield told(held, here)
            held = None if tail else here

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions string"
    out = T._parse_datatype_string(schema)
    return with_next(docs).select("part", "tail", "doc_id", "text").mapInArrow(lambda b: in_batches(step(b), out, 128), out)
