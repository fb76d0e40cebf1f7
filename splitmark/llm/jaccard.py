"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact Jaccard over word shingles settles them.

Every distinct set of shingles has a signature of full depth in each tree of the forest. A tree is a prefix trie, kept as the sorted
list of its signatures: neighbours in the list show how long a prefix they share, and a node of the trie is a stretch of the list.
Matching begins with the full depth and shortens the prefixes by what was matched: level by level, the trees in which the
shorter prefix brings the fewest new matches first, until the expected recall at the threshold meets its target. Crowded trees, in
which a common shingle is the minimum of many sets, keep their longer prefixes.

Copies count once: texts with equal shingle sets are one class. Classes that meet in a node are tied to the node's first class; the
connected components of the ties are cut into blocks, and each pair of blocks is verified by itself: shared shingles are counted by
sparse and dense products, so pairs within a group are never emitted, only each class's number of links and the smallest
class that it is connected to.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitmark.llm.common import map_rows
from splitmark.llm.components import components, stars
from splitmark.session import LONG_ROWS, discard, gathered, parallelism, written


@dataclass(frozen=True)
class ForestParams:
    words: int = 5  # of a shingle
    threshold: float = 0.8
    trees: int = 24
    depth: int = 12  # full depth of a tree: minima in a signature
    least: int = 4  # shortest prefix
    recall: float = 0.999  # expected, of pairs at the threshold
    block: int = 256  # classes of a component verified against as many others at a time
    block_shingles: int = 1 << 20  # and at most about so many shingles
    seed: int = 7


MIX_1, MIX_2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
S31, S29, S32, S16 = np.uint64(31), np.uint64(29), np.uint64(32), np.uint32(16)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S29)) * MIX_1
    x = (x ^ (x >> S32)) * MIX_2
    return x ^ (x >> S31)


class WordHashes(dict[str, int]):
    """Hashes of words, made when they are first asked for."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


#: Words whose hashes are kept between texts.
KEPT = 300_000


def shingle_sets(texts: Iterable[str | None], words: int, known: WordHashes | None = None) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's shingles: runs of ``words`` words between white space, the whole text where it has
    fewer; empty where it has none. ``known`` keeps word hashes from call to call."""
    known = WordHashes() if known is None else known
    for text in texts:
        mine = (text or "").split()
        if len(known) > KEPT:
            known.clear()
        h = np.fromiter(map(known.__getitem__, mine), dtype=np.uint64, count=len(mine))
        if not len(h):
            yield h
            continue
        n = min(words, len(h))
        whole = np.full(len(h) - n + 1, np.uint64(n))
        for at in range(n):
            whole = whole * STEP + h[at : len(h) - n + 1 + at]
        whole = np.sort(_mixed(whole))
        yield whole[np.concatenate(([True], whole[1:] != whole[:-1]))]


class Forest:
    """Signatures of sets of shingles: of each tree its number, then ``depth`` minima, two bytes each, so that byte order is the order
    of a trie."""

    def __init__(self, params: ForestParams) -> None:
        rng = np.random.default_rng(params.seed)
        self.trees, self.depth = params.trees, params.depth
        size = self.trees * self.depth
        self.flip, odd = rng.integers(0, 1 << 32, (2, size), dtype=np.uint32)
        self.odd, self.last = odd | np.uint32(1), rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1)
        self.marks = [bytes([tree]) for tree in range(self.trees)]

    def signature(self, shingles: np.ndarray) -> list[bytes]:
        low = (shingles >> S32).astype(np.uint32)
        least = np.full(self.trees * self.depth, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(low), 256):
            np.minimum(least, ((low[at : at + 256, None] ^ self.flip) * self.odd).min(axis=0), out=least)
        raw = ((least * self.last) >> S16).astype(">u2").tobytes()  # which shingle it was, not how small its hash
        width = 2 * self.depth
        return [mark + raw[width * tree : width * (tree + 1)] for tree, mark in enumerate(self.marks)]


def shared_prefix(a: bytes, b: bytes) -> int:
    """Levels that two signatures of one tree share from the root; 0 for signatures of different trees."""
    if a[0] != b[0]:
        return 0
    for at in range(1, len(a), 2):
        if a[at : at + 2] != b[at : at + 2]:
            return at // 2
    return len(a) // 2


def trie_ties(rows: Iterator[tuple], least: int) -> Iterator[tuple]:
    """(tree, node, length, hubs, edge) along sorted signatures (key, node).

    A class that shares ``length`` levels, ``least`` or more, with the one before it is tied to the first class of the nodes that both
    lie in: ``hubs``, from level ``least`` to level ``length``. The first and the last signature of the list come with ``edge``, from
    which :func:`stitched` ties this list to the one before it and the one behind it. Memory is that of one signature.
    """
    last, hubs, node = None, [], None
    for key, node in rows:
        if last is None:
            hubs = [node] * (len(key) // 2 + 1)
            yield key[0], node, 0, None, key
        elif key[: 2 * least + 1] != last[: 2 * least + 1]:
            hubs = [node] * len(hubs)
        else:
            length = shared_prefix(key, last)
            hubs[length + 1 :] = [node] * (len(hubs) - length - 1)
            yield key[0], node, length, hubs[least : length + 1], None
        last = key
    if last is not None:
        yield last[0], node, -1, hubs, last


def stitched(edges: list[tuple], least: int) -> list[tuple]:
    """Ties (tree, node, length, hubs) from the first signature of each sorted list to the last of the list before it."""
    out, behind = [], None
    for tree, node, length, hubs, key in sorted(edges, key=lambda e: (e[4], e[1], -e[2])):
        if length < 0:
            behind = key, hubs
        elif behind is not None and (shared := shared_prefix(key, behind[0])) >= least:
            out.append((tree, node, shared, behind[1][least : shared + 1]))
    return out


def expected_recall(depths: list[int], similarity: float) -> float:
    """Chance that a pair shares the prefix of at least one tree."""
    return 1 - math.prod(1 - similarity**depth for depth in depths)


def shortened(met: dict[tuple[int, int], int], params: ForestParams) -> list[int]:
    """The prefix length at which each tree is matched. ``met``: how many classes share a prefix of just that length with the one before
    them, by (tree, length).

    All trees begin at full depth. The prefixes go from one level to the next tree by tree, those with the fewest new matches
    first, and stay as they are once the expected recall at the threshold is reached (or all are as short as they may get).
    """
    depths = [params.depth] * params.trees
    for level in range(params.depth - 1, params.least - 1, -1):
        for tree in sorted(range(params.trees), key=lambda t: (met.get((t, level), 0), t)):
            if expected_recall(depths, params.threshold) >= params.recall:
                return depths
            depths[tree] = level
    return depths


def signatures(docs: DataFrame, params: ForestParams) -> DataFrame:
    """doc_id, text_hash, node (128-bit hash of the shingle set; null without words), shingles (how many), keys (by tree)."""

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        forest, known = Forest(params), WordHashes()
        for doc_id, text, text_hash in rows:
            shingles = next(shingle_sets([text], params.words, known))
            if len(shingles):
                yield doc_id, text_hash, xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes()), len(shingles), forest.signature(shingles)
            else:
                yield doc_id, text_hash, None, 0, None

    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_rows(named, ["doc_id", "text", "text_hash"], "doc_id bigint, text_hash bigint, node binary, shingles bigint, keys array<binary>", step)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many shingles each two sets share, [left, left] or [left, right].

    Shingles in few sets are counted pair by pair along the sorted list of (shingle, set), those in many by dense products of a
    bounded number of columns.
    """
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begins = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    df = np.diff(np.append(begins, len(flat)))
    per = np.repeat(df, df)
    out = np.zeros((len(sets), len(sets)), np.float32)
    few = (per > 1) & (per < 8)
    f, o = flat[few], owner[few]
    for gap in range(1, 7):
        same = f[gap:] == f[:-gap]
        np.add.at(out, (o[:-gap][same], o[gap:][same]), 1)
    out += out.T
    many = per >= 8
    if many.any():
        column = np.repeat(np.cumsum(df >= 8) - 1, df)[many]
        o, total = owner[many], int((df >= 8).sum())
        for at in range(0, total, 4096):
            inside = (column >= at) & (column < at + 4096)
            dense = np.zeros((len(sets), min(4096, total - at)), np.float32)
            dense[o[inside], column[inside] - at] = 1
            out += dense @ dense.T
    return out[: len(left), len(left) :] if right is not None else out


def _smallest_linked(links: np.ndarray) -> np.ndarray:
    """Of each member the smallest place in its component of the links."""
    label = np.arange(len(links))
    while True:
        lower = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def verify(members: list[tuple], cross: bool, threshold: float) -> Iterator[tuple]:
    """(node, links, linked documents, smallest node met) of each class of one block, or of two blocks against each other.

    ``members``: (side, node, copies, shingles), without repeated nodes.
    """
    members = sorted(members, key=lambda m: (m[0], m[1]))
    sets = [np.frombuffer(m[3], "<u8") for m in members]
    sizes, copies = np.array([len(s) for s in sets]), np.array([m[2] for m in members], dtype=np.int64)
    split = sum(m[0] == 0 for m in members) if cross else None
    if cross and split in (0, len(members)):
        return
    if len(members) == 2 and not cross:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        shared = np.array([[0, both], [both, 0]])
    else:
        shared = shared_counts(sets[:split], sets[split:]) if cross else shared_counts(sets)
    total = sizes[:split, None] + sizes[None, split:] if cross else sizes[:, None] + sizes[None, :]
    linked = shared >= threshold * (total - shared) - 1e-9
    if not cross:
        np.fill_diagonal(linked, False)
        square = linked
    else:
        square = np.zeros((len(members), len(members)), bool)
        square[:split, split:], square[split:, :split] = linked, linked.T
    number, weight = square.sum(axis=1), square @ copies
    rank = np.argsort(np.argsort([m[1] for m in members], kind="stable"), kind="stable")
    place = np.argsort(rank)
    label = _smallest_linked(square[np.ix_(place, place)])
    for at, m in enumerate(members):
        if number[at]:
            yield m[1], int(number[at]), int(weight[at]), members[place[label[rank[at]]]][1]


def _ties(classes: DataFrame, params: ForestParams, nodes: int) -> DataFrame:
    """(node, hub): classes, of which there are at most ``nodes``, tied to the first class of every trie node that they meet others in."""
    leaves = classes.select(F.explode("keys").alias("key"), "node")
    # By ranges of whole signatures and nodes, so that a crowded part of a tree, or one signature of many classes, may be split.
    tries = leaves.repartitionByRange(parallelism(classes.sparkSession), "key", "node").sortWithinPartitions("key", "node")
    found = written(map_rows(tries, ["key", "node"], "tree int, node binary, length int, hubs array<binary>, edge binary", lambda rows: trie_ties(rows, params.least)), "tries", params.trees * nodes)
    inner, seams = found.where("edge is null").drop("edge"), [tuple(r) for r in found.where("edge is not null").collect()]  # two rows for each partition
    joined = classes.sparkSession.createDataFrame(stitched(seams, params.least), inner.schema)
    met = {(r["tree"], r["length"]): r["count"] for r in inner.groupBy("tree", "length").count().collect()}  # a row for each tree and level
    depth = F.get(F.array(*[F.lit(d) for d in shortened(met, params)]), F.col("tree"))
    return inner.unionByName(joined).where(F.col("length") >= depth).select("node", F.get("hubs", depth - params.least).alias("hub"))


def _classes(signed: DataFrame) -> DataFrame:
    """One row for each shingle set: node, first (the row, by id and text, that stands for it), n_copies, shingles, keys. Null ids come last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    return signed.where("node is not null").groupBy("node").agg(first, F.count("*").alias("n_copies"), F.first("shingles").alias("shingles"), F.first("keys").alias("keys"))


def _shingled(docs: DataFrame, members: DataFrame, params: ForestParams) -> DataFrame:
    """(node, label, blocks, n_copies, shingles) of one text of each class."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    # Rows without an id are told apart by their texts alone, and each text is taken once, however many there are.
    unnamed = texts.where("doc_id is null").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text")).select(*texts.columns)
    asked = members.select("node", "label", "blocks", "n_copies", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    # Classes with company may be most of the table, so this join is a shuffle at any size.
    rows = texts.where("doc_id is not null").unionByName(unnamed).join(asked.hint("merge"), (F.col("text_hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id")))

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = WordHashes()
        for text, node, *rest in rows:
            raw = next(shingle_sets([text], params.words, known)).astype("<u8").tobytes()
            if xxhash.xxh3_128_digest(raw) == bytes(node):
                yield node, *rest, raw

    return map_rows(rows, ["text", "node", "label", "blocks", "n_copies"], "node binary, label binary, blocks int, n_copies bigint, shingles binary", step)


def _links(cut: DataFrame, params: ForestParams) -> DataFrame:
    """(node, n_text_links, linked, low) of every block and pair of blocks in which a class has links."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n_copies", "shingles")
    tasks = placed.repartition(parallelism(cut.sparkSession), "label", "i", "j").sortWithinPartitions("label", "i", "j")

    def check(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (_, i, j), group in groupby(rows, key=lambda r: r[:3]):
            once = {r[4]: r[3:] for r in group}
            yield from verify(list(once.values()), i != j, params.threshold)

    return map_rows(tasks, ["label", "i", "j", "side", "node", "n_copies", "shingles"], "node binary, n_text_links bigint, linked bigint, low binary", check)


def _grouped(docs: DataFrame, params: ForestParams) -> tuple[DataFrame, int]:
    """How many rows ``docs`` has (1 at least), and for each of them a row: doc_id, text_hash, node, and of its class ``first``, ``least`` (the first row of the component),
    n_copies, n_text_links and linked (documents of linked classes)."""
    signed = written(signatures(docs, params), "signatures")
    n = max(1, signed.count())
    classes = written(_classes(signed), "classes", n)
    groups = components(stars(_ties(classes, params, n), "node", "hub"), nodes=n)
    known = groups.join(classes.select("node", "first", "n_copies", "shingles"), "node")
    sizes = known.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / params.block, F.sum("shingles") / params.block_shingles)).cast("int").alias("blocks"))
    members = written(known.join(sizes, "label").select("node", "label", "blocks", "first", "n_copies"), "members", n)
    checked = members.agg(F.sum("blocks")).first()[0] or 0  # rows that verification reads
    links = written(_links(_shingled(docs, members, params), params), "links", checked, LONG_ROWS)
    discard(groups, members)
    counted = links.groupBy("node").agg(F.sum("n_text_links").alias("n_text_links"), F.sum("linked").alias("linked"))
    joined = components(stars(links.where("node <> low"), "node", "low"), nodes=n)
    named = classes.select("node", "first", "n_copies").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("first").alias("least"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    final = written(named.join(lowest, "label").join(counted, "node", "left").select("node", "first", "least", "n_copies", zero("n_text_links"), zero("linked")), "final", n)
    discard(classes, links, joined)
    return signed.select("doc_id", "text_hash", "node").join(final, "node", "left"), n


def near_duplicates(docs: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, n_copies, n_links, n_text_links.

    ``class_id`` is the smallest doc_id of the connected component of links at the threshold, ``copy_id`` of the rows with the same shingle
    set, of which there are ``n_copies``. ``n_links`` counts the other rows that are linked directly, copies included;
    ``n_text_links`` the other shingle sets.

    Null and empty texts have no shingles: they are linked to nothing, not even to each other. A text of fewer words than a shingle
    is one shingle. Rows count by their texts: repeated rows are copies, rows that share an id and not the text are documents of
    their own, and rows without an id are linked like others; a component all of whose ids are null has a null ``class_id``. An empty
    table gives an empty result.
    """
    own = lambda c, value: F.when(F.col("node").isNull(), value).otherwise(F.col(c))
    zero, id_ = F.lit(0).cast("bigint"), F.col("doc_id")
    links = F.col("n_copies") - 1 + F.col("linked")
    return _grouped(docs, params)[0].select(
        "doc_id", own("least.doc_id", id_).alias("class_id"), own("first.doc_id", id_).alias("copy_id"), F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"), F.coalesce(links, zero).alias("n_links"), F.coalesce("n_text_links", zero).alias("n_text_links")
    )


def _same_row(doc_id: Column, text_hash: Column, row: Column) -> Column:
    return doc_id.eqNullSafe(row["doc_id"]) & (text_hash == row["text_hash"])


def one_of_each(docs: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    """Of each connected component of near duplicates one row of ``docs``, all columns kept: that with the smallest id, and where rows of
    other texts share the id, the smallest hash of the text; of rows that agree in both any one.

    A row whose text has no words is linked to nothing and stays, repeated or not. Rows without an id are told apart by their texts; one
    of them stands for a component only where none has an id.
    """
    found, n = _grouped(docs, params)
    wordless = F.col("node").isNull()
    chosen = found.where(wordless | _same_row(F.col("doc_id"), F.col("text_hash"), F.col("least"))).select("doc_id", "text_hash", wordless.alias("wordless")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(chosen, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_hash")))
    once = kept.where("not wordless").dropDuplicates(["doc_id", "text_hash"])
    return gathered(once.unionByName(kept.where("wordless")).select("row.*"), n, LONG_ROWS)
