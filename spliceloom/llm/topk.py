"""Exact top-k search by inner product: tiles of queries and shards.

The queries, a stated set of rows, are packed into blocks that are written to the shared folder
once. Candidates stay where they are scanned: a task gathers them into shards of bounded size and
streams every block past each shard. A tile is one block against a part of a shard: a matrix
product and a partial selection of the best k per query. The lists of a block from all shards are
merged as a tree: a bounded number of lists at a time, level by level, until one is left.

Scores are integers. Tiles use float64 products while every partial sum is below 2**53 and
exact Python integers beyond; ranks always follow the exact score, a ``score`` beyond a long is
shown as the nearest long.

Defined results: a vector that is null, empty or holds a null or non-finite component, before or
after scaling, takes no part, neither does a null id. Vectors of different length don't score
against each other. Repeated candidate ids are candidates each; a query's own id is left out, in
all its rows; a repeated query id answers for each of its rows, merged into one list. Ties go to
the smaller id. Fewer than k candidates give fewer rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceloom.session import written

#: Queries of a block, candidates that one matrix product takes, and bytes of a shard.
QUERY_BLOCK, TILE, SHARD_BYTES = 2048, 2048, 32 << 20
#: Lists that one merge takes, about.
FAN = 16


def quantized(ids: pa.Array, lists: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(scale * x) of their vectors) of the rows that take part, by length of the vectors."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    end = np.cumsum(n)
    ok = (n > 0) & (bad[end] == bad[end - n]) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
    for d in np.unique(n[ok]).tolist():
        rows = np.flatnonzero(ok & (n == d))
        yield pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[rows], x[(end - n)[rows, None] + np.arange(d)]


def _exact_product(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer products; of dtype object where a float could not hold them."""
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(1, queries.shape[1])
    if limit < 2.0**53:
        return queries @ shard.T
    whole = np.vectorize(int, otypes=[object])
    return whole(queries) @ whole(shard).T


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query by (score descending, id ascending), queries ascending."""
    if score.dtype == object:
        order = np.array(sorted(range(len(score)), key=lambda i: (query[i], -score[i], vec[i])), np.int64)
    else:
        order = np.lexsort((vec, ~score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
    order = order[nth < k]
    return query[order], vec[order], score[order]


def tile_top(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, shard_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vec ids, scores): the best k of the shard for each row of queries, own ids left out."""
    by_id = np.argsort(shard_ids, kind="stable")
    found = []
    for a in range(0, len(by_id), TILE):
        ids = shard_ids[by_id[a : a + TILE]]
        product = _exact_product(queries, shard[by_id[a : a + TILE]])
        lo, hi = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
        for i in np.flatnonzero(hi > lo):
            product[i, lo[i] : hi[i]] = -math.inf
        if product.dtype == object:
            for row, own in zip(product, query_ids.tolist(), strict=True):
                top = sorted(((-v, j) for j, v in enumerate(row.tolist()) if v != -math.inf))[:k]
                found.append((np.full(len(top), own), ids[[j for _, j in top]], np.array([-v for v, _ in top] + [None], object)[:-1]))
            continue
        chosen = np.ones(product.shape, bool)
        if len(ids) > k:
            least = np.partition(product, len(ids) - k, axis=1)[:, len(ids) - k, None]
            above, equal = product > least, product == least
            # ties from the left, where ids are smaller
            chosen = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))
        r, c = np.nonzero(chosen & (product > -math.inf))
        found.append((query_ids[r], ids[c], product[r, c].astype(np.int64)))
    # rows of one query id are one list
    return best(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)), k)


def _dump(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> bytes:
    return pickle.dumps((query.astype(np.int64), vec.astype(np.int64), score), protocol=5)


def _matrices(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for block, ids, x in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        ids = np.frombuffer(ids, np.int64)
        yield block, ids, np.frombuffer(x, np.float64).reshape(len(ids), -1)


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK, shard_bytes: int = SHARD_BYTES, fan: int = FAN,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query``, against all rows.

    Queries are shuffled once into blocks of about ``query_block`` (rows of one id stay together),
    candidates never; what is shuffled besides are lists of k for each query and shard.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    parts, nq = v.agg(F.sum(F.greatest(F.size("v"), F.lit(0))), F.count_if("q")).first()
    shards = -(-8 * (parts or 0) // shard_bytes) + spark.sparkContext.defaultParallelism
    blocks = max(1, -(-nq // query_block))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        for b in batches:
            for ids, x in quantized(b.column(0), b.column(1), scale):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], names=["block", "ids", "vectors"])

    queries = written(v.filter("q").select("id", "v").repartition(blocks, "id").mapInArrow(pack, "block long, ids binary, vectors binary"), "topk-queries")
    folder = queries.written_to

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs
        from pyspark import TaskContext

        part, nth, held, size = TaskContext.get().partitionId(), 0, {}, 0
        store, root = fs.FileSystem.from_uri(folder)

        def against_all() -> Iterator[pa.RecordBatch]:
            shard = {d: (np.concatenate([i for i, _ in x]), np.concatenate([m for _, m in x])) for d, x in held.items()}
            for rows in ds.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=1, batch_readahead=1, fragment_readahead=1):
                for block, ids, x in _matrices(rows):
                    if x.shape[1] in shard:
                        c_ids, c = shard[x.shape[1]]
                        lists = _dump(*tile_top(x, ids, c, c_ids, k))
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([(part << 32) + nth]), pa.array([lists])], names=["block", "shard", "lists"])

        for b in batches:
            for ids, x in quantized(b.column(0), b.column(1), scale):
                step = max(1, shard_bytes // (8 * x.shape[1]))
                for a in range(0, len(ids), step):
                    held.setdefault(x.shape[1], []).append((ids[a : a + step], x[a : a + step]))
                    size += x[a : a + step].nbytes
                    if size >= shard_bytes:
                        yield from against_all()
                        nth, held, size = nth + 1, {}, 0
        if size:
            yield from against_all()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [pickle.loads(x) for x in pdf["lists"]]
        lists = _dump(*best(*(np.concatenate(x) for x in zip(*got, strict=True)), k))
        return pd.DataFrame({"block": pdf["block"][:1], "shard": pdf["shard"][:1], "lists": [lists]})

    lists = v.select("id", "v").mapInArrow(tiles, "block long, shard long, lists binary")
    groups = -(-shards // fan)
    lists = lists.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(groups)))
    while True:
        lists = lists.groupBy("block", "shard").applyInPandas(merge, "block long, shard long, lists binary")
        if groups == 1:
            break
        groups = -(-groups // fan)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                query, vec, score = pickle.loads(x)
                first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
                rank = 1 + np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]])))
                shown = np.array([max(min(s, 2**63 - 1), -(2**63)) for s in score], np.int64) if score.dtype == object else score
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(rank.astype(np.int32)), pa.array(vec), pa.array(shown)], names=["query_id", "rank", "vec_id", "score"])

    return lists.select("lists").mapInArrow(rows, "query_id long, rank int, vec_id long, score long")


def op5_top_k_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP5_SQL = """
with v as (select vec_id as id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(64 * x::double))) = 0),
s as (select q.id as query_id, c.id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.id <> c.id and len(q.v) = len(c.v) where q.id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
