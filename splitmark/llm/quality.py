"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A document is counted over hashed words and over word shapes (case, marks at the end, repetition of the word before). Weighted counts of
a bounded labelled sample are factored by a randomised SVD; the labelled vectors are broadcast, every document is projected, its
cosine with each of them is computed exactly, block by block, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitmark.llm.common import bounded_labels, labelled_texts, map_rows, split_of

MARKS = re.compile(r"[\W_]+")
TAIL = re.compile(r"[\W_]+$")


@dataclass(frozen=True)
class QualityParams:
    folds: int = 5
    most: int = 2000  # labelled documents of each label: the bound on what is broadcast
    chars: int = 50_000  # of a labelled document that are learned from
    buckets: int = 4096  # of hashed words
    shapes: int = 256  # of hashed word shapes
    rank: int = 64
    neighbours: int = 15
    power: float = 4.0  # of the similarity in a vote's weight
    block: int = 128  # documents projected and compared at a time
    seed: int = 5


def _codes(word: str, params: QualityParams) -> tuple[int, int]:
    """(bucket of the word, bucket of its shape)."""
    bare = MARKS.sub("", word)
    own = zlib.crc32(bare.lower().encode("utf-8", "surrogatepass")) % params.buckets if bare else -1
    case = "none" if not bare else "upper" if len(bare) > 1 and bare.isupper() else "title" if bare[0].isupper() else "digit" if bare.isdigit() else "lower"
    tail = TAIL.search(word)
    shape = f"{case} {tail[0][:3] if tail else ''} {len(bare) > 24}"
    return own, zlib.crc32(shape.encode("utf-8", "surrogatepass")) % (params.shapes - 2)


class Counter:
    """Rows of weighted counts: logarithms of word counts times their rarity, and roots of shape shares, each part of length 1."""

    def __init__(self, params: QualityParams) -> None:
        self.params, self.rarity, self.known = params, np.ones(params.buckets, np.float32), {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word counts, shape shares), a row for each text."""
        p, split = self.params, [(t or "").split() for t in texts]
        words = list(dict.fromkeys(chain.from_iterable(split)))
        if len(self.known) > 200_000:
            self.known = {}
        known = self.known
        for word in words:
            if word not in known:
                known[word] = _codes(word, p)
        codes = np.array([known[w] for w in words], dtype=np.int64).reshape(-1, 2)
        numbers = dict(zip(words, range(len(words)), strict=True))
        held, shares = np.zeros((len(texts), p.buckets), np.float32), np.zeros((len(texts), p.shapes), np.float32)
        for row, mine in enumerate(split):
            if not mine:
                shares[row, -2] = 1  # no words at all
                continue
            ids = np.fromiter(map(numbers.__getitem__, mine), dtype=np.int64, count=len(mine))
            got = codes[ids]
            held[row] = np.bincount(got[:, 0] + 1, minlength=p.buckets + 1)[1:]
            shares[row] = np.bincount(got[:, 1], minlength=p.shapes) / len(mine)
            shares[row, -1] = np.count_nonzero(ids[1:] == ids[:-1]) / len(mine)
        return held, shares

    def rows(self, texts: list[str | None]) -> np.ndarray:
        held, shares = self.counts(texts)
        held = np.log1p(held) * self.rarity
        held /= np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-9)
        shares = np.sqrt(shares)
        shares /= np.maximum(np.linalg.norm(shares, axis=1, keepdims=True), 1e-9)
        return np.concatenate([held, shares], axis=1)


class NeighbourModel:
    """The projection and the labelled vectors."""

    def __init__(self, counter: Counter, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.counter, self.basis, self.vectors, self.labels = counter, basis, vectors, labels

    def project(self, rows: np.ndarray) -> np.ndarray:
        low = rows @ self.basis
        return low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; 0.5 without labelled vectors."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = self.project(self.counter.rows(texts)) @ self.vectors.T
        k = min(self.counter.params.neighbours, near.shape[1])
        chosen = np.argpartition(-near, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(near, chosen, 1).min(axis=1)
        for row in np.flatnonzero((near >= last[:, None]).sum(axis=1) > k):  # ties at the last place go to the first of the labelled
            chosen[row] = np.argsort(-near[row], kind="stable")[:k]
        weight = np.maximum(np.take_along_axis(near, chosen, 1), 1e-3).astype(np.float64) ** self.counter.params.power
        return (weight * self.labels[chosen]).sum(1) / weight.sum(1)


def train(texts: list[str | None], labels: np.ndarray, params: QualityParams = QualityParams()) -> NeighbourModel:
    counter, labels = Counter(params), np.asarray(labels, dtype=np.float64)
    width = params.buckets + params.shapes
    if not texts:
        return NeighbourModel(counter, np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    seen = np.zeros(params.buckets)
    for some in batched(texts, params.block):
        seen += (counter.counts(list(some))[0] > 0).sum(0)
    counter.rarity = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    x = np.concatenate([counter.rows(list(some)) for some in batched(texts, params.block)])
    rank = min(params.rank, *x.shape)
    rng = np.random.default_rng(params.seed)
    q = np.linalg.qr(x @ rng.normal(size=(width, rank + 8)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    basis = np.ascontiguousarray(np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32))
    # Copies of a text are one neighbour, with the mean of their labels.
    names = list(dict.fromkeys(texts))
    place = dict(zip(names, range(len(names)), strict=True))
    copies = np.array([place[t] for t in texts])
    sums, first = np.bincount(copies, labels) / np.bincount(copies), np.unique(copies, return_index=True)[1]
    model = NeighbourModel(counter, basis, np.zeros((0, rank), np.float32), sums)
    model.vectors = model.project(x[first])
    return model


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> NeighbourModel:
    """A model from at most ``params.most`` documents of each label outside the held-out fold, and at most ``params.chars`` characters
    of each; null texts count as empty, and an id on several rows once."""
    rows = labelled_texts(docs, bounded_labels(labels, "quality", params.folds, params.most), params.chars)
    return train([text for text, _ in rows], np.array([label for _, label in rows]), params)


def score(docs: DataFrame, model: NeighbourModel) -> DataFrame:
    """doc_id and score of every document. Null and empty texts are compared as texts without words; repeated rows one each; an empty
    table gives an empty result. Whole texts are counted; memory is that of ``block`` texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = held.value
        for some in batched(rows, known.counter.params.block):
            yield from zip((r[0] for r in some), known.scores([r[1] for r in some]).tolist(), strict=True)

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, score double", step)


def op2_neighbour_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``. Null texts count as empty, and every text has a score; repeated rows
    have one each; a null id is not held out, as it has no remainder, and keeps a null ``held_out``. Without labels every score is 0.5."""
    scored = score(docs, fit(docs, labels, params))
    return scored.select("doc_id", (split_of(F.col("doc_id"), params.folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
