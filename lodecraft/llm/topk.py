"""Exact top-k inner products: term-at-a-time accumulation over blocks, partition selection, merge."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Rows of a block of candidates, and of queries. Scores of one query and one block are 64 KB.
CANDIDATES, QUERIES = 8192, 2048
_OUT = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector, or a component, is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & F.coalesce(good, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(array.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _terms(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the components that are not 0: the sparse form."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    term = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
    full = flat != 0
    return row[full], term[full], flat[full]


def _select(scores: np.ndarray, ids: np.ndarray, k: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k highest, ties to the smaller id; ``ids`` ascend."""
    at = np.flatnonzero(valid)
    s = scores[at]
    if len(at) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        over = at[s > least]
        at = np.concatenate([over, at[s == least][: k - len(over)]])
    return ids[at], scores[at]


def _score_blocks(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _OUT.empty_table()
        candidates = candidates.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        ids, numbers = (candidates[c].to_numpy().astype(np.int64) for c in ("vec_id", "row"))
        asked, own = (queries[c].to_numpy().astype(np.int64) for c in ("query_id", "query_row"))
        c_flat, c_offsets = _ragged(candidates["terms"])
        q_flat, q_offsets = _ragged(queries["terms"])
        row, term, weight = _terms(c_flat, c_offsets)
        bound = float(np.abs(c_flat).max(initial=0)) * float(np.abs(q_flat).max(initial=0)) * max(1, int(np.diff(c_offsets).max(initial=0)))
        kind = np.float64 if bound < 2**53 else np.int64  # either is exact
        order = np.argsort(term, kind="stable")
        row, term, weight = row[order], term[order], weight[order].astype(kind)
        edges = np.searchsorted(term, np.arange(int(term.max(initial=-1)) + 2))
        postings = []
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > len(ids) // 4:  # a long list is stored by row
                dense = np.zeros(len(ids), kind)
                dense[row[a:b]] = weight[a:b]
                postings.append((None, dense))
            else:
                postings.append((row[a:b], weight[a:b]))
        scores, step = np.zeros(len(ids), kind), np.zeros(len(ids), kind)
        out: list[tuple] = []
        for i, q in enumerate(own):
            scores[:] = 0
            vector = q_flat[q_offsets[i] : q_offsets[i + 1]]
            for t in np.flatnonzero(vector[: len(postings)]):
                rows, weights = postings[t]
                if rows is None:
                    np.multiply(weights, vector[t], out=step)
                    np.add(scores, step, out=scores)
                elif len(rows):
                    scores[rows] += weights * vector[t]
            found, best = _select(scores, ids, k, numbers != q)
            out.append((np.full(len(found), q), np.full(len(found), asked[i]), found, best.astype(np.int64)))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=_OUT)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows of highest integer inner product.

    Components become floor(scale * x). Queries and candidates are dealt in blocks of bounded size; a task scores one block of queries
    against one of candidates: the candidates' non-zero components are postings by term, each
    query scatters its weights over its terms' postings into one dense array of scores, and selection by partition
    leaves k of each block. The blocks' winners are merged by query. Every query meets every row; nothing is broadcast.

    Ties go to the smaller id. A query is not its own candidate; it gets all others if there are fewer than k. Vectors that are null
    or hold null or non-finite components, and rows with a null id, take no part. Vectors of unequal lengths are
    scored over the components both have. Of rows that repeat an id, each is a query of its own and a candidate of the others.
    Other columns, whatever their names, are ignored; vectors of any length are scored whole. No rows: no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("terms"), is_query.alias("asks"))
    rows = materialise(rows.where("vec_id is not null and terms is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")  # so that a row keeps its number
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    c_blocks, q_blocks = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(asked / QUERIES))
    queries = rows.where("asks").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "terms")
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("query_row"), F.lit(q_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))))
    candidates = rows.select("row", "vec_id", "terms", F.pmod(F.xxhash64("row"), F.lit(c_blocks)).alias("cb"))
    candidates = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    grouped = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb"))
    found = grouped.applyInArrow(_score_blocks(k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
