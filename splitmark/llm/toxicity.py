"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is hashed as a whole and by its first letters; each hash picks a row of an embedding table, and the rows side by side are the
word's vector. Filters of several widths slide over the words, the largest responses of each filter over the whole text are
kept (max pooling, the largest two), and a logistic layer makes the score. Training is in numpy on a bounded, labelled sample.

Two dimensions of each row start from counts: the log odds that toxic documents hold the hash at all, and twice. They come
from one half of the sample and the filters are trained on the other, so chance words of the first half don't look telling.

Thresholds are calibrated by language. The language of a text is told from the text, by its function words, never from a column;
its threshold becomes a shift of the score, so that 0.5 is the cut for every language.
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

#: Frequent function words of the languages that thresholds are calibrated for.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for it with as on be by at are from this have",
    "fr": "le la les de des et un une du dans est que qui pour pas sur au avec par ce",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als",
    "es": "el la los las de que y en un una por con para es del se no lo al su",
}
MARKS = re.compile(r"[\W_]+")
#: Words whose contributions a process keeps.
STORED = 100_000
NOTHING = np.float32(-1e9)


@dataclass(frozen=True)
class ToxicParams:
    folds: int = 5
    most: int = 2500  # labelled documents of each label that are learned from
    chars: int = 50_000  # of each, from a place chosen by hash
    buckets: int = 1 << 15
    prefixes: tuple[int, ...] = (4, 5, 7)  # letters hashed beside the whole word
    free: int = 4  # trained dimensions of a row, beside the two from counts
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # of each width
    epochs: int = 6
    batch: int = 64
    rate: float = 0.02
    prior: float = 4.0  # documents of the base rate added to each count
    segment: int = 1 << 14  # words of a text that are looked at in one step
    seed: int = 3


def words_of(text: str | None) -> list[str]:
    """Lower-case chunks between white space; marks around and within them are dropped where they are hashed."""
    return (text or "").lower().split()


_LANGUAGE = {word: [] for line in FUNCTION_WORDS.values() for word in line.split()}
for _at, _line in enumerate(FUNCTION_WORDS.values()):
    for _word in _line.split():
        _LANGUAGE[_word].append(_at)


def language_of(words: list[str]) -> int:
    """Place in ``FUNCTION_WORDS`` of the language whose function words are most frequent; their number where there are none."""
    votes = [0.0] * len(FUNCTION_WORDS)
    for word in words:
        for at in _LANGUAGE.get(word, ()):
            votes[at] += 1 / len(_LANGUAGE[word])
    best = max(votes)
    return votes.index(best) if best else len(FUNCTION_WORDS)


def hashes_of(words: list[str], params: ToxicParams) -> np.ndarray:
    """A row of buckets for each word: the word's own, then one for each prefix (the word's own again where it is shorter).

    Marks are dropped first; a word of marks alone gets row -1, which no filter responds to.
    """
    out, most = np.empty((len(words), 1 + len(params.prefixes)), dtype=np.int64), params.buckets
    for row, word in enumerate(words):
        if not word.isalnum():
            word = MARKS.sub("", word)
        if not word:
            out[row] = -1
            continue
        own = zlib.crc32(word.encode("utf-8", "surrogatepass")) % most
        out[row] = [own, *(zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) % most if len(word) >= n else own for n in params.prefixes)]
    return out


class Corpus:
    """Texts as segments of word numbers, each followed by the words that its last windows still reach into."""

    def __init__(self, texts: list[list[str]], params: ToxicParams) -> None:
        reach = max(params.widths) - 1
        self.words = list(dict.fromkeys(chain.from_iterable(texts)))
        numbers = dict(zip(self.words, range(1, len(self.words) + 1), strict=True))
        self.segments: list[tuple[int, np.ndarray]] = []  # (text, word numbers)
        for doc, words in enumerate(texts):
            ids = np.zeros(max(1, len(words)) + reach, dtype=np.int64)
            ids[: len(words)] = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
            for a in range(0, max(1, len(words)), params.segment):
                self.segments.append((doc, ids[a : a + params.segment + reach]))
        self.docs = len(texts)


class ConvModel:
    """Tables, filters and the logistic layer."""

    def __init__(self, params: ToxicParams, tables: np.ndarray) -> None:
        rng = np.random.default_rng(params.seed)
        self.params, self.tables = params, tables.astype(np.float32)
        self.views, _, self.depth = tables.shape
        size = self.views * self.depth
        self.kernels = {w: rng.normal(0, 0.05, (w, size, params.filters)).astype(np.float32) for w in params.widths}
        for w, kernel in self.kernels.items():
            for f in range(params.filters):  # filters begin at the counted dimensions of one or two views
                for view in {f % self.views, (f // self.views + f) % self.views}:
                    kernel[f % w, view * self.depth + (f // self.views) % 2, f] += 0.5
        wide = len(params.widths) * params.filters
        self.out = np.concatenate([np.full(wide, 0.2), np.full(wide, 0.2)]).astype(np.float32)
        self.mean, self.scale = np.zeros(2 * wide, np.float32), np.ones(2 * wide, np.float32)
        self.bias = np.float32(-1.0)
        self.shift = np.zeros(len(FUNCTION_WORDS) + 1, dtype=np.float32)

    def vectors(self, hashes: np.ndarray) -> np.ndarray:
        """[words + 1, views * depth]; row 0 is padding, and rows of words without letters are zero as well."""
        x = np.zeros((len(hashes) + 1, self.views * self.depth), np.float32)
        for v in range(self.views):
            x[1:, v * self.depth : (v + 1) * self.depth] = self.tables[v][hashes[:, v]]
        x[1:][hashes[:, 0] < 0] = 0
        return x

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """[words + 1, filters of every place of every width]: what a word adds to a response that it takes part in."""
        return x @ np.concatenate([self.kernels[w][k] for w in self.params.widths for k in range(w)], axis=1)

    def pooled(self, corpus: Corpus, adds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """([docs, 2 * filters] largest and second largest responses, [docs, 2 * filters, widest] word numbers behind them)."""
        size, reach, wide = self.params.filters, max(self.params.widths) - 1, len(self.params.widths) * self.params.filters
        tops, behind = np.full((corpus.docs, 2, wide), NOTHING, np.float32), np.zeros((corpus.docs, 2, wide, reach + 1), np.int64)
        cols = np.arange(wide)
        for doc, ids in corpus.segments:
            got, n, at = adds[ids], len(ids) - reach, 0
            pre = np.empty((wide, n), np.float32)
            for row, w in enumerate(self.params.widths):
                part = got[:n, at : at + size]
                for k in range(1, w):
                    part = part + got[k : n + k, at + k * size : at + (k + 1) * size]
                pre[row * size : (row + 1) * size] = part.T
                at += w * size
            for _ in range(2):
                spot = pre.argmax(axis=1)
                best = pre[cols, spot]
                pre[cols, spot] = NOTHING
                words = ids[spot[:, None] + np.arange(reach + 1)]
                up = best > tops[doc, 0]
                lower = np.where(up, tops[doc, 0], best)
                low_words = np.where(up[:, None], behind[doc, 0], words)
                tops[doc, 0], behind[doc, 0] = np.where(up, best, tops[doc, 0]), np.where(up[:, None], words, behind[doc, 0])
                second = lower > tops[doc, 1]
                tops[doc, 1], behind[doc, 1] = np.where(second, lower, tops[doc, 1]), np.where(second[:, None], low_words, behind[doc, 1])
        behind[:, 1][tops[:, 1] <= NOTHING / 2] = 0
        tops[tops <= NOTHING / 2] = 0
        return tops.reshape(corpus.docs, -1), behind.reshape(corpus.docs, 2 * wide, reach + 1)

    def _adds(self, words: list[str]) -> np.ndarray:
        """Contributions of words, those met before from a bounded store of this process."""
        if not hasattr(self, "_rows"):
            self._rows, self._kept = {}, np.zeros((0, 0), np.float32)
        places = [self._rows.get(w, -1) for w in words]
        new = [w for w, p in zip(words, places, strict=True) if p < 0]
        made = self.contributions(self.vectors(hashes_of(new, self.params)))
        out = np.zeros((len(words) + 1, made.shape[1]), np.float32)
        known = np.array(places)
        out[1:][known < 0] = made[1:]
        if len(self._rows):
            out[1:][known >= 0] = self._kept[known[known >= 0]]
        if len(self._rows) + len(new) > STORED:
            self._rows, self._used = {}, 0
        if len(new) <= STORED:
            if self._kept.shape[0] == 0:
                self._kept, self._used = np.zeros((STORED, made.shape[1]), np.float32), 0
            self._kept[self._used : self._used + len(new)] = made[1:]
            self._rows.update(zip(new, range(self._used, self._used + len(new)), strict=True))
            self._used += len(new)
        return out

    def forget(self) -> None:
        """Empties the store."""
        self.__dict__ = self.__getstate__()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "_kept", "_used")}

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        corpus = Corpus(texts, self.params)
        features, _ = self.pooled(corpus, self._adds(corpus.words))
        return ((features - self.mean) / self.scale) @ self.out + self.bias

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Chance of being toxic, shifted so that each language's threshold lies at 0.5."""
        logit = self.logits(texts) - self.shift[[language_of(words) for words in texts]]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def _counted(texts: list[str | None], labels: np.ndarray, params: ToxicParams) -> np.ndarray:
    """[views, buckets, 2 + free] start of the tables: log odds by documents with a bucket, and with it twice."""
    views = 1 + len(params.prefixes)
    seen = np.zeros((2, views, 2, params.buckets))
    for at in range(0, len(texts), params.batch):
        corpus = Corpus([words_of(t) for t in texts[at : at + params.batch]], params)
        hashes = np.concatenate([np.full((1, views), -1), hashes_of(corpus.words, params)])
        whole: dict[int, list[np.ndarray]] = {}
        for doc, ids in corpus.segments:
            whole.setdefault(doc, []).append(ids)
        for doc, parts in whole.items():
            ids = np.concatenate(parts)
            found = hashes[ids[hashes[ids, 0] >= 0]]
            for v in range(views):
                buckets, n = np.unique(found[:, v], return_counts=True)
                seen[labels[at + doc], v, 0, buckets] += 1
                seen[labels[at + doc], v, 1, buckets[n > 1]] += 1
    base = (labels.sum() + 0.5) / (len(labels) + 1)
    odds = np.log((seen[1] + params.prior * base) / (seen[0] + params.prior * (1 - base))) - np.log(base / (1 - base))
    rng = np.random.default_rng(params.seed + 1)
    return np.concatenate([odds.transpose(0, 2, 1), rng.normal(0, 0.05, (views, params.buckets, params.free))], axis=2)


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.state, self.step = rate, {}, 0

    def __call__(self, name: str, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        m, v = self.state.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        self.state[name] = m, v
        t = max(1, self.step)
        return (value - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def train(texts: list[str | None], labels: np.ndarray, params: ToxicParams = ToxicParams()) -> ConvModel:
    """A model from texts and 0/1 labels, which are cut into words a batch at a time; with one label only, or none, a model that scores everything low or high."""
    labels = np.asarray(labels, dtype=np.int64)
    model = ConvModel(params, np.zeros((1 + len(params.prefixes), params.buckets, 2 + params.free)))
    if len(set(labels.tolist())) < 2:
        model.out[:] = 0
        model.bias = np.float32(5.0 if len(labels) and labels[0] else -5.0)
        return model
    rng = np.random.default_rng(params.seed)
    order = rng.permutation(len(texts))
    # Counts from one half; filters from the other; thresholds from a part of the second that the filters didn't see.
    order = np.concatenate([order[labels[order] == 1], order[labels[order] == 0]])
    counted, rest = order[::2], order[1::2]
    tuned, fitted = rest[::5], np.setdiff1d(rest, rest[::5])
    if len(set(labels[tuned].tolist())) < 2 or len(set(labels[fitted].tolist())) < 2 or len(set(labels[counted].tolist())) < 2:
        counted = tuned = fitted = order
    model = ConvModel(params, _counted([texts[i] for i in counted], labels[counted], params))
    adam, y = _Adam(params.rate), labels.astype(np.float32)
    weight = np.where(labels == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())).astype(np.float32)
    mixed = np.array_split(rng.permutation(fitted), max(1, len(fitted) // params.batch))
    lots = [Corpus([words_of(texts[i]) for i in part], params) for part in mixed]
    grads = {w: np.zeros_like(k) for w, k in model.kernels.items()}
    hashes = []
    for lot in lots:
        hashes.append(hashes_of(lot.words, params))
        lot.words = []
    first = np.concatenate([model.pooled(c, model.contributions(model.vectors(h)))[0] for c, h in zip(lots, hashes, strict=True)])
    model.mean, model.scale = first.mean(0), first.std(0) + np.float32(0.1)
    size, wide = params.filters, len(params.widths) * params.filters
    for _ in range(params.epochs):
        for lot in rng.permutation(len(lots)):
            corpus, mine = lots[lot], mixed[lot]
            adam.step += 1
            x = model.vectors(hashes[lot])
            features, behind = model.pooled(corpus, model.contributions(x))
            z = (features - model.mean) / model.scale
            p = 1 / (1 + np.exp(-np.clip(z @ model.out + model.bias, -30, 30)))
            g = ((p - y[mine]) * weight[mine] / len(mine)).astype(np.float32)
            back = g[:, None] * (model.out / model.scale)[None, :]
            grad_x = np.zeros_like(x)
            for n, w in enumerate(params.widths):
                for f in range(size):
                    cols = [n * size + f, wide + n * size + f]
                    gf = back[:, cols].ravel()
                    for k in range(w):
                        word = behind[:, cols, k].ravel()
                        np.add.at(grad_x, word, gf[:, None] * model.kernels[w][k][:, f])
                        grads[w][k, :, f] = gf @ x[word]
                model.kernels[w] = adam(f"k{w}", model.kernels[w], grads[w] + 1e-4 * model.kernels[w])
            model.out = adam("out", model.out, z.T @ g + 1e-3 * model.out / len(mine))
            model.bias = adam("bias", model.bias, np.float32(g.sum()))
            step, real = grad_x[1:] * params.rate, hashes[lot][:, 0] >= 0
            for v in range(model.views):
                free = slice(v * model.depth + 2, (v + 1) * model.depth)
                np.subtract.at(model.tables[v][:, 2:], hashes[lot][real, v], step[real, free])
    _calibrate(model, [texts[i] for i in tuned], labels[tuned])
    return model


def _calibrate(model: ConvModel, texts: list[str | None], labels: np.ndarray) -> None:
    """Each language's shift: the logit that best parts its tuning texts, drawn to that of all languages where texts are few."""
    logit, langs = [], []
    for some in batched(texts, model.params.batch):
        words = [words_of(t) for t in some]
        logit.append(model.logits(words))
        langs += [language_of(w) for w in words]
    logit, langs = np.concatenate(logit), np.array(langs)
    model.forget()

    def best(values: np.ndarray, marks: np.ndarray) -> float:
        cuts = np.unique(np.concatenate([values, [0.0]]))
        cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
        neg, pos = np.sort(values[marks == 0]), np.sort(values[marks == 1])
        gain = np.searchsorted(neg, cuts) / max(1, len(neg)) - np.searchsorted(pos, cuts) / max(1, len(pos))
        top = cuts[gain >= gain.max() - 1e-9]
        return float((top[0] + top[-1]) / 2)

    whole = best(logit, labels)
    model.shift[:] = whole
    for lang in range(len(FUNCTION_WORDS) + 1):
        mine = langs == lang
        n = min((labels[mine] == 1).sum(), (labels[mine] == 0).sum())
        if n >= 5:
            model.shift[lang] += (best(logit[mine], labels[mine]) - whole) * n / (n + 10)


def fit(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> ConvModel:
    """A model from at most ``params.most`` documents of each label outside the held-out fold, and at most ``params.chars`` characters
    of each; null texts count as empty, and an id on several rows once."""
    rows = labelled_texts(docs, bounded_labels(labels, "toxic", params.folds, params.most), params.chars)
    return train([text for text, _ in rows], np.array([label for _, label in rows], dtype=np.int64), params)


def score(docs: DataFrame, model: ConvModel) -> DataFrame:
    """doc_id and score of every document. Null and empty texts get the score of a text without words; repeated rows one each;
    an empty table gives an empty result. Whole texts are read, a segment at a time."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = held.value
        for some in batched(rows, 48):
            scores = known.scores([words_of(text) for _, text in some])
            yield from zip((r[0] for r in some), scores.tolist(), strict=True)

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, score double", step)


def clean(docs: DataFrame, model: ConvModel) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns. Null and empty texts are judged as texts without words, each
    repeated row by itself; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = held.value
        for some in batched(rows, 48):
            for row, value in zip(some, known.scores([words_of(r[at]) for r in some]), strict=True):
                if value < 0.5:
                    yield row

    return map_rows(docs, docs.columns, docs.schema, step)


def op4_conv_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``: null texts count as empty, repeated rows have one each, a null id has a
    null ``held_out``. With labels of one kind only, or none, all scores are that kind's (low without any)."""
    scored = score(docs, fit(docs, labels, params))
    return scored.select("doc_id", (split_of(F.col("doc_id"), params.folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
