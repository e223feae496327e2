"""Anchors of sorted ends, by pointers and list ranking.

In a group the distinct ends (tss, tes), sorted, are walked: the first one is an anchor; an end
that leaves the wobble around the current anchor is the next. So every end, as if it were an
anchor, points to the first later end that leaves its wobble, and the anchors are those that the
first end reaches.

Groups of few ends are folded as arrays. Larger ones are cut into blocks of sorted ends, ranges of
about ``BLOCK`` rows:

1. inside a block every end finds its pointer by range search (tables of minima and maxima over
   powers of two); following pointers from the right, every end knows the last anchor of the walk
   that starts at it, its exit;
2. exits leave their block: which later block ends their reach is searched in the blocks' minima
   and maxima, the end itself in that block, whose own exit closes an edge from exit to exit;
3. list ranking: the exits that the group's first end reaches, by doubling the edges;
4. a block's walk starts with the last reached exit before it and gives every end its anchor.

To the driver come the minima and maxima of the blocks of groups that span several, one row a
block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.functions import transcript as T
from spliceloom.session import forget, written

#: Ends that a fold takes, and rows of a block, about.
FOLD, BLOCK = 256, 1 << 16


def folded(ends: DataFrame, keys: list[str], mode: str, tss_wob: int, tes_wob: int) -> DataFrame:
    """(keys, tss, tes, a_tss, a_tes) of groups of few ends, as one array a group."""
    groups = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tss", "tes"))).alias("ends"))
    start = F.struct(F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), F.array().cast("array<struct<tss:int,tes:int,a_tss:int,a_tes:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        stays = F.coalesce(T.terminal_match(mode, x["tss"] - acc["s"], x["tes"] - acc["e"], tss_wob, tes_wob), F.lit(False)) & acc["s"].isNotNull()
        s, e = F.when(stays, acc["s"]).otherwise(x["tss"]), F.when(stays, acc["e"]).otherwise(x["tes"])
        row = F.struct(x["tss"].alias("tss"), x["tes"].alias("tes"), s.alias("a_tss"), e.alias("a_tes"))
        return F.struct(s.alias("s"), e.alias("e"), F.concat(acc["out"], F.array(row)).alias("out"))

    return groups.select(*keys, F.explode(F.aggregate("ends", start, step, lambda acc: acc["out"])).alias("w")).select(*keys, "w.*")


class Reach:
    """First place in a sequence of (low, high) tss and tes that leaves given bounds."""

    def __init__(self, lows: list[np.ndarray], highs: list[np.ndarray]):
        """One array of minima and of maxima for each coordinate that counts."""
        self.n = len(lows[0])
        self.levels = [(lows, highs)]
        while 2 * (width := 1 << (len(self.levels) - 1)) <= self.n:
            lo, hi = self.levels[-1]
            self.levels.append(([np.minimum(x[:-width], x[width:]) for x in lo], [np.maximum(x[:-width], x[width:]) for x in hi]))

    def first(self, at: np.ndarray, low: list[np.ndarray], high: list[np.ndarray]) -> np.ndarray:
        """For each question the first place >= ``at`` with a minimum under ``low`` or a maximum over ``high``; n where there is none."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            lows, highs = self.levels[k]
            fits = np.flatnonzero(at + (1 << k) <= self.n)
            here = at[fits]
            inside = np.ones(len(fits), bool)
            for x, y, a, z in zip(lows, highs, low, high, strict=True):
                inside &= (x[here] >= a[fits]) & (y[here] <= z[fits])
            at[fits[inside]] += 1 << k
        return at


class Rules:
    """Which coordinates hold an end to its anchor, and how far."""

    def __init__(self, mode: str, tss_wob: int, tes_wob: int):
        self.wobs = [w if mode in (name, "both") else None for name, w in (("tss", tss_wob), ("tes", tes_wob))]

    def held(self, *columns: np.ndarray) -> list[np.ndarray]:
        return [c.astype(np.int64) for c, w in zip(columns, self.wobs, strict=True) if w is not None]

    def bounds(self, *columns: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        wobs = [w for w in self.wobs if w is not None]
        return [c - w for c, w in zip(self.held(*columns), wobs, strict=True)], [c + w for c, w in zip(self.held(*columns), wobs, strict=True)]


def exits(tss: np.ndarray, tes: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(pointer, exit) of every end of a block: the first later end outside its wobble, n if none; the last anchor of the walk from it."""
    n = len(tss)
    held = rules.held(tss, tes)
    pointer = Reach(held, held).first(np.arange(n), *rules.bounds(tss, tes))
    out = np.arange(n)
    for i in range(n - 1, -1, -1):
        if pointer[i] < n:
            out[i] = out[pointer[i]]
    return pointer, out


def runs(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[str, int, int]]]:
    """A block's rows in order, and its groups (name, from, to)."""
    pdf = pdf.sort_values("nth", ignore_index=True)
    name = pdf["name"].to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]]))
    return pdf, [(name[a], int(a), int(z)) for a, z in zip(cut[:-1], cut[1:], strict=True)]


def _borders(pdf: pd.DataFrame) -> pd.DataFrame:
    """Name, minima and maxima of a block's first and last group."""
    pdf, groups = runs(pdf)
    rows = [(pdf["block"][0], name, *(f(pdf[c][a:z]) for c in ("tss", "tes") for f in (min, max))) for name, a, z in dict.fromkeys((groups[0], groups[-1]))]
    return pd.DataFrame(rows, columns=["block", "name", "tss_lo", "tss_hi", "tes_lo", "tes_hi"])


def blockwise(ends: DataFrame, keys: list[str], mode: str, tss_wob: int, tes_wob: int, block_rows: int) -> DataFrame:
    """(keys, tss, tes, a_tss, a_tes) of groups of any number of ends."""
    spark, rules = ends.sparkSession, Rules(mode, tss_wob, tes_wob)
    blocks = max(1, -(-ends.count() // block_rows))
    order = [*keys, "tss", "tes"]
    placed = ends.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    placed = placed.select(*order, F.to_json(F.struct(*keys)).alias("name"), F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("nth"))
    placed = written(placed, "anchor-blocks")
    slim = placed.select("block", "nth", "name", "tss", "tes")

    borders = slim.groupBy("block").applyInPandas(_borders, "block int, name string, tss_lo long, tss_hi long, tes_lo long, tes_hi long").toPandas().sort_values("block")
    spanning = {name: part.reset_index(drop=True) for name, part in borders.groupby("name") if len(part) > 1}
    entries = _entries(spark, slim, spanning, rules) if spanning else spark.createDataFrame([], "block int, in_tss int, in_tes int")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, groups = runs(pdf)
        anchor_tss, anchor_tes = pdf["tss"].to_numpy().copy(), pdf["tes"].to_numpy().copy()
        for name, a, z in groups:
            tss, tes = anchor_tss[a:z].copy(), anchor_tes[a:z].copy()
            held = rules.held(tss, tes)
            reach = Reach(held, held)
            at, first = 0, None
            if a == 0 and pd.notna(pdf["in_tss"][0]):
                first = (int(pdf["in_tss"][0]), int(pdf["in_tes"][0]))
                at = int(reach.first(np.zeros(1, np.int64), *rules.bounds(*(np.array([x]) for x in first)))[0])
            pointer = reach.first(np.arange(z - a), *rules.bounds(tss, tes))
            anchors = np.zeros(z - a, np.int64)
            enter = at
            while at < z - a:
                anchors[at] = at
                at = int(pointer[at])
            anchors = np.maximum.accumulate(anchors)
            anchor_tss[a:z], anchor_tes[a:z] = tss[anchors], tes[anchors]
            if first:
                anchor_tss[a : a + enter], anchor_tes[a : a + enter] = first
        return pdf[order].assign(a_tss=anchor_tss, a_tes=anchor_tes)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*order).schema) + ", a_tss int, a_tes int"
    return placed.join(entries, "block", "left").groupBy("block").applyInPandas(walk, schema)


def _entries(spark, slim: DataFrame, spanning: dict[str, pd.DataFrame], rules: Rules) -> DataFrame:
    """(block, in_tss, in_tes): the anchor that holds where a block begins, of blocks that begin inside a group."""
    place = {name: {int(b): i for i, b in enumerate(part["block"])} for name, part in spanning.items()}
    member = spark.createDataFrame([(b, name) for name, at in place.items() for b in at], "block int, name string")
    rows = slim.join(member, ["block", "name"], "left_semi")
    shared = spark.sparkContext.broadcast((spanning, place))

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        """Exits of a block's groups that go on behind it, with the block that ends their reach."""
        pdf, groups = runs(pdf)
        spanning, place = shared.value
        block, out = int(pdf["block"][0]), []
        for name, a, z in groups:
            tss, tes, nth = (pdf[c].to_numpy()[a:z] for c in ("tss", "tes", "nth"))
            last = exits(tss, tes, rules)[1]
            at, part = place[name][block], spanning[name]
            used = np.unique(last)
            over = Reach(rules.held(part["tss_lo"].to_numpy(), part["tes_lo"].to_numpy()), rules.held(part["tss_hi"].to_numpy(), part["tes_hi"].to_numpy()))
            found = over.first(np.full(len(used), at + 1), *rules.bounds(tss[used], tes[used]))
            to = np.append(part["block"].to_numpy(), -1)[found]
            out.append(pd.DataFrame({"name": name, "u": nth[used], "block": block, "tss": tss[used], "tes": tes[used], "to": to, "head": (used == last[0]) & (at == 0)}))
        return pd.concat(out)

    left = written(rows.groupBy("block").applyInPandas(leave, "name string, u long, block int, tss int, tes int, to int, head boolean"), "anchor-exits")

    def enter(ask: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        """Edges from exits to the exit of the end that they reach in this block."""
        out = [pd.DataFrame(columns=["name", "u", "v", "block", "tss", "tes"])]
        pdf, groups = runs(pdf)
        for name, a, z in groups:
            own = ask[ask["name"] == name]
            if len(own):
                tss, tes, nth = (pdf[c].to_numpy()[a:z] for c in ("tss", "tes", "nth"))
                held = rules.held(tss, tes)
                first = Reach(held, held).first(np.zeros(len(own), np.int64), *rules.bounds(own["tss"].to_numpy(), own["tes"].to_numpy()))
                v = exits(tss, tes, rules)[1][first]
                out.append(pd.DataFrame({"name": name, "u": own["u"].to_numpy(), "v": nth[v], "block": int(pdf["block"][0]), "tss": tss[v], "tes": tes[v]}))
        return pd.concat(out[1:] or out)

    asked = left.filter("to >= 0").select(F.col("to").alias("block"), "name", "u", "tss", "tes")
    edge = written(asked.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(enter, "name string, u long, v long, block int, tss int, tes int"), "anchor-edges")
    reached = written(left.filter("head").select("name", F.col("u").alias("v"), "block", "tss", "tes"), "anchor-reached")
    forget(left)
    for _ in range(max(map(len, spanning.values())).bit_length()):
        # what is reached, and what is so by twice as many edges in the next round
        more = reached.unionByName(reached.select(F.col("v").alias("u")).join(edge, "u").drop("u")).dropDuplicates(["v"])
        twice = edge.select(F.col("u").alias("first"), F.col("v").alias("u")).join(edge, "u").select("name", F.col("first").alias("u"), "v", "block", "tss", "tes")
        done = (reached, edge)
        reached, edge = written(more, "anchor-reached"), written(twice, "anchor-edges")
        forget(*done)
    # one anchor at most leaves a block for the next; where none does the one before still holds
    own = member.join(reached.select("block", "name", F.struct("tss", "tes").alias("own")), ["block", "name"], "left")
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("held", F.last("own", ignorenulls=True).over(before)).filter("held is not null").select("block", F.col("held.tss").alias("in_tss"), F.col("held.tes").alias("in_tes"))


def anchors(ends: DataFrame, keys: list[str], mode: str, tss_wob: int, tes_wob: int, *, fold: int = FOLD, block_rows: int = BLOCK) -> DataFrame:
    """(keys, tss, tes, a_tss, a_tes) of distinct ends (keys, tss, tes): the anchor, first of its group, of each."""
    ends = written(ends.select(*keys, F.col("tss").cast("int"), F.col("tes").cast("int")), "anchor-ends")
    large = ends.groupBy(*keys).count().filter(F.col("count") > fold).select(*keys)
    if large.isEmpty():
        return folded(ends, keys, mode, tss_wob, tes_wob)
    large = written(large, "anchor-large")
    many = blockwise(ends.join(large, keys, "left_semi"), keys, mode, tss_wob, tes_wob, block_rows)
    return folded(ends.join(large, keys, "left_anti"), keys, mode, tss_wob, tes_wob).unionByName(many)
