"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights. For every block of queries and block of candidates, the candidates' postings (which rows
hold a term, and with which weight) are gone through term by term, and each posting's products are scattered into a dense array of
scores. Partition selection keeps the best of every query in each block; the blocks' lists are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchParams:
    k: int = 20
    query_every: int = 20  # ids that this divides are queries
    scale: int = 64  # a component x becomes floor(scale * x)
    query_rows: int = 1024  # of a block of queries
    candidate_rows: int = 8192  # of a block of candidates


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def weights(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _postings(rows: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(term, rows that hold it, their weights) for each term of a block, zero weights left out."""
    term = np.arange(len(values)) - np.repeat(offsets[:-1], np.diff(offsets))
    keep = values != 0
    term, rows, values = term[keep], rows[keep], values[keep]
    order = np.argsort(term, kind="stable")
    term, rows, values = term[order], rows[order], values[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    return [(int(t[0]), r, v) for t, r, v in zip(np.split(term, cuts), np.split(rows, cuts), np.split(values, cuts), strict=True) if len(t)]


def _lists(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, flat weights)."""
    column = block.column("w").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return block.column("id").to_numpy(), offsets - offsets[0], column.flatten().to_numpy()


def best_of_block(queries: pa.Table, candidates: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, scores): up to ``k`` of each query, ties to the smaller id, never the query's own row.

    Candidates are ordered by id, so that ties at the cut are settled by position.
    """
    q_ids, q_off, q_val = _lists(queries)
    order = np.argsort(candidates.column("id").to_numpy(), kind="stable")
    c_ids, c_off, c_val = _lists(candidates.take(pa.array(order)))
    dense = np.zeros((int(np.diff(q_off).max(initial=0)), len(q_ids)), dtype=np.int64)
    dense[np.arange(len(q_val)) - np.repeat(q_off[:-1], np.diff(q_off)), np.repeat(np.arange(len(q_ids)), np.diff(q_off))] = q_val
    postings = _postings(np.repeat(np.arange(len(c_ids)), np.diff(c_off)), c_off, c_val)
    bound = int(np.abs(q_val).max(initial=0)) * int(np.abs(c_val).max(initial=0)) * max(1, dense.shape[0])
    kind = np.int32 if bound < 2**31 else np.int64
    dense = dense.astype(kind)
    postings = [(t, rows, values.astype(kind)[:, None]) for t, rows, values in postings if t < dense.shape[0]]
    wide = 64
    for at in range(0, len(q_ids), wide):
        part = dense[:, at : at + wide]
        scores = np.zeros((len(c_ids), part.shape[1]), dtype=kind)
        for term, rows, values in postings:
            weight = part[term]
            if not weight.any():
                continue
            if len(rows) == len(c_ids):
                scores += values * weight
            else:
                scores[rows] += values * weight
        for j, row in enumerate(np.ascontiguousarray(scores.T)):
            mine = q_ids[at + j]
            want = k + int(np.searchsorted(c_ids, mine, "right") - np.searchsorted(c_ids, mine, "left"))
            if want < len(row):
                cut = np.partition(row, len(row) - want)[len(row) - want]
                found = np.flatnonzero(row >= cut)
            else:
                found = np.arange(len(row))
            found = found[c_ids[found] != mine]
            found = found[np.lexsort((c_ids[found], -row[found].astype(np.int64)))[:k]]
            yield np.full(len(found), mine), c_ids[found], row[found].astype(np.int64)


def top_k(vectors: DataFrame, params: SearchParams = SearchParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query with every row but its own: query_id, rank, vec_id, score.

    Vectors that are null, or hold null or non-finite components, or have a null id take no part. Vectors of different lengths are
    compared over the terms that both have. Ties go to the smaller id. An id on several rows: each row is a candidate, and as a
    query such an id keeps the best ``k`` over its rows, each candidate once with its highest score. An empty table gives an empty result.

    Queries and candidates are dealt into blocks of a fixed number of rows; each pair of blocks is one group, so memory is
    bounded, and the number of blocks follows the counts. A query set of q rows costs q times all rows, as exhaustive search does.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), weights(F.col(vector_col), params.scale).alias("w"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.pmod("id", F.lit(params.query_every)) == 0).alias("q")).first()
    q_blocks, c_blocks = max(1, -(-counts["q"] // params.query_rows)), max(1, -(-counts["n"] // params.candidate_rows))
    queries = rows.where(F.pmod("id", F.lit(params.query_every)) == 0).withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    candidates = rows.withColumn("c", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(c_blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    k = params.k

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(best_of_block(left, right, k)) if left.num_rows and right.num_rows else []
        columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    blocks = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    one = blocks.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
