"""Language identification by compression.

Each language has a zstandard dictionary of raw text. A text is cut into blocks, every block is compressed with each dictionary,
and the language whose blocks take the fewest bytes in all wins. To the bytes comes the length of the language's own code
(minus log2 of its share, in bytes), so texts too short to compress don't fall to chance. A narrow margin is a rejection.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitmark.llm.common import bounded_window, hash_sample, map_rows, split_of

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    """Bounds of the sample that dictionaries are filled from, and how texts are compressed."""

    folds: int = 4
    held_out: int = 2
    documents: int = 128  # sampled of each language, as expected
    passage: int = 2048  # characters of each sampled document, from a place chosen by its hash
    dictionary: int = 65536  # bytes of each dictionary
    languages: int = 1024  # more are refused
    block: int = 300  # bytes compressed at a time
    level: int = 12
    margin: float = 0.02  # of the smaller size; below it a text is rejected


def normalised(text: str | None) -> bytes:
    """Lower-case letters with single spaces between words; empty where there is no letter."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f"{words} ".encode("utf-8", "surrogatepass") if words else b""


@dataclass
class CompressionModel:
    """Dictionaries and code lengths by language; compressors are made once in each process."""

    dictionaries: dict[str, bytes]
    code: dict[str, float]
    params: LanguageParams
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    def _compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        if not self._made:
            for lang, raw in self.dictionaries.items():
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=self.params.level)
                self._made[lang] = zstandard.ZstdCompressor(level=self.params.level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self._made

    def sizes(self, text: str | None) -> dict[str, float]:
        """Bytes by language; empty where the text has no letter."""
        data, size = normalised(text), self.params.block
        if not any(map(str.isalpha, text or "")):
            return {}
        blocks = [data[at : at + size] for at in range(0, len(data), size)]
        return {lang: self.code[lang] + sum(len(c.compress(b)) for b in blocks) for lang, c in self._compressors().items()} if blocks else {}

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, margin as a share of the second smallest size, accepted)."""
        order = sorted((s, lang) for lang, s in self.sizes(text).items())
        if not order:
            return UNDETERMINED, 0.0, False
        best = order[0][0]
        margin = 1.0 if len(order) == 1 else (order[1][0] - best) / max(order[1][0], 1e-9)
        return order[0][1], min(max(margin, 0.0), 1.0), margin >= self.params.margin


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> CompressionModel:
    """Dictionaries from the text and the non-null ``lang`` of documents outside the held-out fold.

    The sample is bounded by ``params``: so many passages of each language, chosen by a hash of the id. Shares are counted over all
    learnable rows, and every language is learned; more than ``params.languages`` are an error. Without learnable rows the model
    is empty and every text is undetermined.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (split_of(F.col("doc_id"), params.folds) != params.held_out)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(params.languages + 1).collect()}
    if len(counts) > params.languages:
        raise ValueError(f"more than {params.languages} languages")
    filled: dict[str, list[bytes]] = {lang: [] for lang in counts}
    picked = hash_sample(known, "lang", counts, params.documents).select("doc_id", "lang", bounded_window(F.col("text"), params.passage).alias("text"))
    for row in sorted(picked.collect(), key=lambda r: (r["lang"], zlib.crc32(str(r["doc_id"]).encode()), r["text"])):
        filled[row["lang"]].append(normalised(row["text"]))
    raw = {lang: b"".join(parts)[: params.dictionary] for lang, parts in filled.items()}
    raw = {lang: b for lang, b in raw.items() if len(b) >= 8}
    total = sum(counts[lang] for lang in raw)
    return CompressionModel(raw, {lang: -math.log2(counts[lang] / total) / 8 for lang in raw}, params)


def identify(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """One row per document: doc_id, lang_pred (nearest), lang_id (null where the margin is narrow), score (the margin).

    Null texts and texts without a letter: ``und``, score 0, null. Repeated rows: one result each. Equal sizes go to the smaller
    language code. Whole texts are read, however long; memory is that of one text.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = held.value
        for doc_id, text in rows:
            lang, score, sure = known.predict(text)
            yield doc_id, lang, lang if sure else None, score

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, lang_pred string, lang_id string, score double", step)


def op8_compression_langid(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_id, one row per row of ``docs``, as from :func:`identify`; a null id has a null
    ``held_out`` and is not learned from."""
    found = identify(docs, fit(docs, params))
    return found.select("doc_id", (split_of(F.col("doc_id"), params.folds) == params.held_out).alias("held_out"), "lang_pred", "score", "lang_id")
