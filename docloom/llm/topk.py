"""Exact top-k search by inner product, in the three phases of a uniform threshold.

A vector's score is the sum of the partial scores of its slices of components, and each slice is a list
of its own. Vectors lie in row groups, queries in cells; every row group meets every cell once in each
of two passes, as blocks for matrix products.

1. Each group gathers the heads of its slices' lists and resolves them: real scores of k rows. The
   k-th best of all gathered scores is a cutoff that the true k-th score cannot miss.
2. The cutoff goes back to the groups with the queries. A row whose total reaches it must exceed the
   uniform share of the cutoff in at least one slice, and only such entries are collected.
3. For those the remaining slices are resolved, in integers, and the best k of the group go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialise

#: Vectors of a row group, queries of a cell, slices of a vector, and queries of one matrix product.
GROUP_ROWS, CELL_QUERIES, SLICES, PRODUCT = 32_768, 2048, 4, 64
#: Products below this are exact in double precision.
EXACT = 2.0**53


def integers(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as double; null for vectors that take no part."""
    usable = embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(usable, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(table: pa.Table, width: int | None = None) -> np.ndarray:
    """The components as rows of 64-bit integers; shorter vectors are filled with zeros."""
    lists = table.column("e").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _prepared(queries: pa.Table, rows: pa.Table):
    q, v = _matrix(queries), _matrix(rows)
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, width)
    work = np.float64 if bound < EXACT else np.int64
    edges = np.linspace(0, width, SLICES + 1).astype(int)
    slices = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a] or [(0, width)]
    return q, v, q.astype(work), v.astype(work).T.copy(), slices


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries: highest score, then smallest id."""
    return np.lexsort((ids, -scores))[:k]


def _result(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    q = np.concatenate([np.full(len(i), n, np.int64) for n, i, _ in found]) if found else np.zeros(0, np.int64)
    ids = np.concatenate([i for _, i, _ in found]) if found else np.zeros(0, np.int64)
    scores = np.concatenate([s for _, _, s in found]) if found else np.zeros(0, np.int64)
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores.astype(np.int64), pa.int64())})


def _gather(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """Phase 1 in one block: the heads of the slices' lists, resolved; the k best of each query."""
        if not queries.num_rows or not rows.num_rows:
            return _result([])
        q, v, qw, vw, slices = _prepared(queries, rows)
        names, ids = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        found = []
        for at in range(0, len(names), PRODUCT):
            part = [qw[at : at + PRODUCT, a:b] @ vw[a:b] for a, b in slices]
            head = min(k + 1, len(ids))
            tops = np.concatenate([np.argpartition(-p, head - 1, axis=1)[:, :head] for p in part], axis=1)
            for n in range(len(tops)):
                name = names[at + n]
                seen = np.unique(tops[n])
                seen = seen[ids[seen] != name]
                scores = v[seen] @ q[at + n]
                best = _best(ids[seen], scores, k)
                found.append((name, ids[seen][best], scores[best]))
        return _result(found)

    return run


def _collect(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """Phases 2 and 3 in one block: entries over the uniform share, resolved; the k best of each query."""
        if not queries.num_rows or not rows.num_rows:
            return _result([])
        q, v, qw, vw, slices = _prepared(queries, rows)
        names, ids = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        cutoffs = queries.column("cutoff").to_pylist()
        found = []
        for at in range(0, len(names), PRODUCT):
            part = [qw[at : at + PRODUCT, a:b] @ vw[a:b] for a, b in slices]
            least = [p.min(axis=1) for p in part]
            for n in range(part[0].shape[0]):
                name, cutoff = names[at + n], cutoffs[at + n]
                if cutoff is None:
                    seen = np.arange(len(ids))
                else:
                    share = (cutoff - sum(float(m[n]) for m in least)) / len(slices)
                    over = part[0][n] - least[0][n] >= share - 1e-6 * abs(share)
                    for p, m in zip(part[1:], least[1:], strict=True):
                        over |= p[n] - m[n] >= share - 1e-6 * abs(share)
                    seen = np.flatnonzero(over)
                seen = seen[ids[seen] != name]
                scores = v[seen] @ q[at + n]
                if cutoff is not None:
                    enough = scores >= cutoff
                    seen, scores = seen[enough], scores[enough]
                best = _best(ids[seen], scores, k)
                found.append((name, ids[seen][best], scores[best]))
        return _result(found)

    return run


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the highest integer inner product.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows of another
    id. Ties go to the smaller vec_id. Vectors that are null or hold a null or non-finite component,
    and rows with a null vec_id, take no part; of vectors of different lengths the common components
    count; a repeated row is a candidate as often as it comes and one query; fewer than k candidates
    give fewer rows; an empty table gives an empty one; other columns are not read.

    Groups and cells have bounded sizes, whatever the input. A vector is sent once for each cell of
    queries and a query once for each group, the least that a search of all against all can do.
    """
    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("e")).where("vec_id is not null AND e is not null")
    ready = materialise(ready, "vectors")
    queries = ready.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("e").alias("e"))
    queries = materialise(queries, "queries")
    groups, cells = (max(1, -(-df.count() // size)) for df, size in ((ready, GROUP_ROWS), (queries, CELL_QUERIES)))
    group = F.pmod(F.xxhash64(F.lit(1), "vec_id", "e"), F.lit(groups)).cast("int")
    cell = F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(cells)).cast("int")
    every_group, every_cell = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, cells))
    dealt = ready.withColumn("g", group).withColumn("c", every_cell)
    asked = queries.withColumn("c", cell).withColumn("g", every_group)
    schema = "query_id long, vec_id long, score long"
    gathered = asked.groupBy("g", "c").cogroup(dealt.groupBy("g", "c")).applyInArrow(_gather(k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = gathered.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    cutoff = ranked.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    cutoff = materialise(cutoff, "cutoffs")
    told = queries.join(cutoff, F.col("vec_id") == F.col("query_id"), "left").drop("query_id").withColumn("c", cell).withColumn("g", every_group)
    collected = told.groupBy("g", "c").cogroup(dealt.groupBy("g", "c")).applyInArrow(_collect(k), schema)
    best = collected.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
