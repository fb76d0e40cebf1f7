"""Packing of tokenized documents into sequences, first-fit decreasing within randomised groups.

A document is its token ids and an end id. Full sequences are cut off as they are; what is left of every document is packed by
first-fit decreasing, which asks a tournament tree of free room for the first open sequence that holds the piece. Groups are
dealt by a hash, so that each is a random sample of a bounded expected size and any number of them run at once.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from splitmark.llm.common import STORES, map_rows


@dataclass(frozen=True)
class PackParams:
    tokenizer: str = ""  # path of the tokenizer's file
    length: int = 4096  # of a sequence
    end_id: int = 2
    group_rows: int = 2048  # expected pieces of a group
    seed: int = 11


#: Python takes these for white space and the tokenizer doesn't; texts with a special token's sign are left to it as well.
WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Letters that are lower-cased one by one and are in composed form already.
LETTERS = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u024f]+$"
#: Marks that the tokenizer cuts off behind letters (an apostrophe may belong to a contraction, so it isn't among them).
TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Units whose ids a process keeps, words encoded in one call, and chunks looked up together.
KEPT, AT_ONCE, STRETCH = 400_000, 50_000, 1 << 20
#: Texts that are looked up together: so many, or as many as make up so many characters.
TEXTS, CHARS = 512, 1 << 22


def _runs(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin there and have these sizes, one after another."""
    return flat[np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)]


class WordTokenizer:
    """Ids of texts, equal to the tokenizer's own. It never merges across white space, nor letters with marks, so a chunk between white space
    is a word in lower case and the marks behind it, or a unit as it is. The ids of each unit are kept (a bounded number of them), and all
    words that are new in some texts are encoded in one call and told apart by their tokens for a word's end."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.inner = Tokenizer.from_file(path)
        vocabulary = self.inner.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Unit n has the ids ``flat[bounds[n] : bounds[n + 1]]``; unit 0 has none."""
        self.numbers: dict[str, int] = {"": 0}
        self.flat, self.bounds = array("I"), array("q", [0, 0])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _keep(self, units: list[str], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of new units, of which each has the ids up to its end."""
        numbers = range(len(self.bounds) - 1, len(self.bounds) - 1 + len(units))
        self.numbers.update(zip(units, numbers, strict=True))
        self.bounds.frombytes((ends.astype(np.int64) + len(self.flat)).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        return np.arange(numbers.start, numbers.stop)

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """The number of each unit; each distinct one is looked up once, and new ones are encoded and kept."""
        coded = units.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        found = np.fromiter(map(self.numbers.get, names.tolist(), repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(found < 0)
        plain = pc.match_substring_regex(coded.dictionary.take(pa.array(new)), LETTERS).to_numpy(zero_copy_only=False)
        for places in (new[plain][at : at + AT_ONCE] for at in range(0, plain.sum(), AT_ONCE)):
            words = names[places].tolist()
            ids = self._ids(" ".join(words))
            found[places] = self._keep(words, ids, np.flatnonzero(self.ends[ids]) + 1)
        for places in (new[~plain][at : at + AT_ONCE] for at in range(0, (~plain).sum(), AT_ONCE)):
            odd = names[places].tolist()
            each = [e.ids for e in self.inner.encode_batch_fast(odd, add_special_tokens=False)]
            found[places] = self._keep(odd, np.fromiter(chain.from_iterable(each), dtype=np.uint32), np.cumsum([len(ids) for ids in each]))
        return found[coded.indices.to_numpy()]

    def _looked_up(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, one after another, how many of them each chunk has)."""
        if len(self.numbers) > KEPT:
            self._forget()
        coded = chunks.dictionary_encode()
        bare = pc.utf8_rtrim(coded.dictionary, characters=TAIL)
        letters = pc.match_substring_regex(bare, LETTERS)
        marks = pc.if_else(letters, pc.subtract(pc.binary_length(coded.dictionary), pc.binary_length(bare)), 0).to_numpy()
        units = np.zeros((len(marks), 2), dtype=np.int64)  # of each distinct chunk: its word, and what is behind it
        units[:, 0] = self._numbers(pc.if_else(letters, pc.utf8_lower(bare), coded.dictionary))
        marked = np.flatnonzero(marks)
        if len(marked):
            tails = [chunk[-n:] for chunk, n in zip(coded.dictionary.take(pa.array(marked)).to_numpy(zero_copy_only=False).tolist(), marks[marked].tolist(), strict=True)]
            units[marked, 1] = self._numbers(pa.array(tails, pa.string()))
        flat, bounds = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32), np.frombuffer(self.bounds, np.int64)
        sizes = bounds[units + 1] - bounds[units]
        own = _runs(flat, bounds[units.ravel()], sizes.ravel())
        counts = sizes.sum(axis=1)
        codes = coded.indices.to_numpy()
        return _runs(own, (np.cumsum(counts) - counts)[codes], counts[codes]).astype("<u4", copy=False), counts[codes]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, one after another. The texts' chunks are looked up together, those of long texts by
        stretches."""
        whole = [any(mark in t for mark in WHOLE) for t in texts]
        split = pc.utf8_split_whitespace(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.string()))
        chunks, bounds = split.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))
        parts = [self._looked_up(chunks.slice(at, STRETCH)) for at in range(0, len(chunks), STRETCH)]
        ids, counts = (np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, "<u4") for n in (0, 1))
        ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[bounds]
        for n, text in enumerate(texts):
            yield (self._ids(text) if whole[n] else ids[ends[n] : ends[n + 1]]).tobytes()


_TOKENIZERS: dict[str, WordTokenizer] = {}
STORES["tokenizers"] = _TOKENIZERS.clear


def tokenizer(path: str) -> WordTokenizer:
    """One for each process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class RoomTree:
    """A tournament tree over the free room of sequences: the winner of a match is the side with more room."""

    def __init__(self, length: int, most: int) -> None:
        self.size = 1
        while self.size < max(1, most):
            self.size *= 2
        self.length = length
        self.room = [length] * (2 * self.size)
        self.used = 0

    def place(self, need: int) -> tuple[int, int]:
        """(sequence, offset) in the first sequence with room; an unopened one has all its length free."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < need:
                at += 1
        offset = self.length - room[at]
        room[at] -= need
        found = at - self.size
        self.used = max(self.used, found + 1)
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found, offset


def first_fit_decreasing(lengths: list[int], length: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; equal lengths go in the order given."""
    tree, out = RoomTree(length, len(lengths)), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        out[i] = tree.place(lengths[i])
    return out


def _lots(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[1] or "")
        if len(held) >= TEXTS or chars >= CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def pieces(docs: DataFrame, params: PackParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, row (the document's place in its task); each piece holds
    ``params.length`` ids at most.

    A null text counts as empty and still has its end id. Repeated rows are documents of their own.
    """
    path, most, end = params.tokenizer, params.length, np.array([params.end_id], dtype="<u4").tobytes()

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        own, row = tokenizer(path), 0
        for some in _lots(rows):
            for (doc_id, _), ids in zip(some, own.encode([text or "" for _, text in some]), strict=True):
                ids += end
                row, total = row + 1, len(ids) // 4
                for start in range(0, total, most):
                    cut = ids[4 * start : 4 * (start + most)]
                    yield doc_id, start, len(cut) // 4, zlib.crc32(cut), total, row

    return map_rows(docs.withColumnsRenamed({id_col: "doc_id", text_col: "text"}) if (id_col, text_col) != ("doc_id", "text") else docs, ["doc_id", "text"], "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, row bigint", step, keep="tokenizers")


def pack(docs: DataFrame, params: PackParams) -> DataFrame:
    """One row per piece with its sequence and place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence_id`` is the group's number times 2^32 plus the sequence's number in it. Offsets of a sequence run without gaps from
    0. Pieces are ordered by length, then doc_id, start and crc, so ties give the same packing each time. Groups are dealt by id,
    piece and the document's place in its part of the table, so one id on very many rows, or none, is spread like any other and
    the packing is the same for the same parts. An empty table gives an empty result. Only ids and lengths are shuffled, never
    texts; a group holds about ``params.group_rows`` rows at any size of the input, as the number of groups follows the number of
    documents.
    """
    count = docs.count()
    groups = max(1, -(-count // params.group_rows))
    length = params.length

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = first_fit_decreasing(rows["length"].tolist(), length)
        group = int(rows["part"].iloc[0])
        return rows.drop(columns="part").assign(sequence_id=[(group << 32) + s for s, _ in placed], offset=[o for _, o in placed])

    found = pieces(docs, params).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "row", F.lit(params.seed)), F.lit(groups))).drop("row")
    return found.groupBy("part").applyInPandas(packed, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
