"""Connected components: stars inside partitions, then alternating large-star and small-star steps.

Every partition of edges first replaces them by a star for each of its components, which keeps the
components of the whole, leaves at most one edge a node and settles graphs of one partition. The
steps that follow keep the components and shorten paths; the smallest node of a component ends
as the centre of one star. State goes through the shared folder after each step, so lineage stays
short and a lost executor costs one step; tables of earlier steps are deleted. Nothing but two
numbers a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.session import forget, written

#: Edges of a partition whose components one task finds.
PART = 200_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links (a, b): (node, smallest node)."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the edges of a partition, worked off in stretches of PART."""
    kind, held, n = None, [], 0

    def settle() -> pa.RecordBatch:
        u, v = (np.concatenate([c[i].to_numpy(zero_copy_only=False) for c in held]) for i in (0, 1))
        u, v = stars(u, v)
        return pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])

    for b in batches:
        kind = b.schema.types[0]
        held.append(b.columns)
        n += len(b)
        if n >= PART:
            yield settle()
            held, n = [], 0
    if held:
        yield settle()


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each u; summed before the shuffle, written so that the join below may split hot u."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "cc-least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    table = _least(both)
    least = table.select(F.col("u").alias("u2"), F.least("m", "u").alias("m"))
    out = written(both.filter("v > u").join(least, F.col("u") == F.col("u2")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "cc")
    forget(table, edges)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    table = _least(down)
    least = table.withColumnRenamed("u", "u2")
    moved = down.join(least, F.col("u") == F.col("u2")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    out = written(moved.unionByName(least.select(F.col("u2").alias("u"), F.col("m").alias("v"))).distinct(), "cc")
    forget(table, edges)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge are not listed.

    Null ends are ignored, self-loops and repeated edges are harmless.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))), "cc")
    n = e.count()
    parts = max(1, -(-n // PART))
    contracted = written(e.coalesce(parts).mapInArrow(_starred, e.schema), "cc")
    forget(e)
    e = contracted
    if parts > 1 or n >= PART:
        mark = _mark(e)
        for _ in range(rounds):
            e = _small_star(_large_star(e))
            was, mark = mark, _mark(e)
            if mark == was:
                break
        else:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
