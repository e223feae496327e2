"""Range joins by bins: an equi-join on keys and bin, then the exact predicate.

Both sides are exploded to the bins they touch; a pair is kept in the first bin that both touch,
so nothing is counted twice and no distinct is needed. Spans of more than ``wide`` bins are put
into one coarser level of bins, so a long span costs few rows as well.

Where few loci may hold most of the left side, bins with more than ``hot`` of its rows are dealt out:
such a row goes to one of several deals by its hash, right rows of the bin go to each.

``tiled_join`` is for results far larger than the tables: bins are dealt out on both sides, and the
number of partitions follows the pairs that can come of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN, COARSE = 16_384, 64
#: Of ``tiled_join``: the weight of a side of a tile, the pairs of a partition, and the most partitions.
SIDE, PAIRS, PARTS = 8192, 16_000_000, 4096


def _binned(df: DataFrame, lo: Column, hi: Column, size: int, tag: str) -> DataFrame:
    first = F.floor(lo / size)
    return df.withColumn(f"_{tag}0", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, F.floor(hi / size)))))


def dealt(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], hot: int) -> tuple[DataFrame, DataFrame]:
    """Both sides, by _bin_l and _bin_r, with the deal of each row: _deal_l and _deal_r, 0 in bins of up to ``hot`` left rows."""
    names = [f"_h{i}" for i in range(len(keys))]
    by = [*(F.col(k).alias(n) for (k, _), n in zip(keys, names, strict=True)), F.col("_bin_l").alias("_hb")]
    crowded = left.groupBy(*by).agg(F.ceil(F.count("*") / hot).cast("int").alias("_deals")).filter("_deals > 1")  # at most one row for ``hot`` rows

    def told(side: DataFrame, tag: str, cols: list[str]) -> DataFrame:
        on = F.col(f"_bin_{tag}") == F.col("_hb")
        for k, n in zip(cols, names, strict=True):
            on = on & (F.col(k) == F.col(n))
        return side.join(crowded, on, "left").withColumn("_deals", F.coalesce("_deals", F.lit(1))).drop(*names, "_hb")

    plain = [c for c, kind in left.dtypes if not kind.startswith(("array", "map", "struct"))]
    lefts = told(left, "l", [k for k, _ in keys]).withColumn("_deal_l", F.pmod(F.xxhash64(*plain), F.col("_deals")).cast("int"))
    rights = told(right, "r", [k for _, k in keys]).withColumn("_deal_r", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)))
    return lefts.drop("_deals"), rights.drop("_deals")


def range_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str], condition: Column, *, bin_size: int = BIN, hot: int | None = None) -> DataFrame:
    """Rows whose closed spans share a point and that fulfil ``condition``.

    ``keys``: pairs of equal columns. Column names of the two sides must differ. ``condition`` may
    assume nothing but must imply that the closed spans meet.
    """
    (a, b), (c, d) = left_span, right_span

    def level(side: DataFrame, lo: str, hi: str, long: bool) -> DataFrame:
        wide = F.col(hi) - F.col(lo) > COARSE * bin_size
        return side.filter(wide if long else ~wide)

    equal = [F.col(x) == F.col(y) for x, y in keys]
    on = condition
    for e in equal:
        on = e & on
    once = F.col("_bin_l") == F.greatest("_l0", "_r0")

    def joined(lefts: DataFrame, rights: DataFrame, size: int) -> DataFrame:
        x = _binned(lefts, F.col(a), F.col(b), size, "l").withColumnRenamed("_bin", "_bin_l")
        y = _binned(rights, F.col(c), F.col(d), size, "r").withColumnRenamed("_bin", "_bin_r")
        here = F.col("_bin_l") == F.col("_bin_r")
        if hot:
            x, y = dealt(x, y, keys, hot)
            here = here & (F.col("_deal_l") == F.col("_deal_r"))
        return x.join(y, here & once & on).drop("_bin_l", "_bin_r", "_l0", "_r0", "_deal_l", "_deal_r")

    short = joined(level(left, a, b, False), level(right, c, d, False), bin_size)
    coarse = bin_size * COARSE
    return short.unionByName(joined(level(left, a, b, True), right, coarse)).unionByName(joined(level(left, a, b, False), level(right, c, d, True), coarse))


def leveled(side: DataFrame, lo: str, hi: str, tag: str) -> DataFrame:
    """Rows with ``_lv`` and ``_bin`` of the bins they touch; spans of more than COARSE bins are in coarse bins only, the others in both."""
    wide = F.col(hi) - F.col(lo) > COARSE * BIN
    coarse = _binned(side.withColumn("_wide", wide), F.col(lo), F.col(hi), BIN * COARSE, tag).withColumn("_lv", F.lit(1))
    return _binned(side.withColumn("_wide", wide).filter(~wide), F.col(lo), F.col(hi), BIN, tag).withColumn("_lv", F.lit(0)).unionByName(coarse)


def tiled(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str], numbers: tuple[str, str], weights: tuple[Column, Column], *, side: int = SIDE, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt out to tiles and partitioned alike, and what names a tile, with _l or _r behind it in either side.

    A pair counts in the tile where _bin is the larger of _l0 and _r0 and, at the coarse level (_lv), _wide_l or _wide_r is true.
    """
    by = ["_lv", "_bin", *(f"_k{i}" for i in range(len(keys)))]
    told = lambda x, span, at, tag: leveled(x, *span, tag).withColumns({f"_k{i}": F.col(k[at]) for i, k in enumerate(keys)})
    x, y = told(left, left_span, 0, "l"), told(right, right_span, 1, "r")
    weighed = lambda t, w, tag: t.groupBy(*by).agg(F.sum(w).alias(f"_w{tag}"), F.bool_or("_wide").alias(f"_wide_{tag}"))
    # at the coarse level only tiles with a wide row on either side
    tiles = weighed(x, weights[0], "l").join(weighed(y, weights[1], "r"), by).filter("_lv = 0 or _wide_l or _wide_r")
    most = tiles.agg(F.sum(F.col("_wl").cast("double") * F.col("_wr"))).first()[0] or 0
    parts = max(left.sparkSession.sparkContext.defaultParallelism, min(PARTS, int(most // pairs) + 1))
    tiles = tiles.select(*by, *(F.ceil(F.col(f"_w{t}") / side).cast("int").alias(f"_n{t}") for t in "lr"))

    def dealt_out(rows: DataFrame, own: str, other: str, number: str) -> DataFrame:
        """A row in one deal of its own side and in each of the other's."""
        t = rows.join(tiles, by).withColumn(f"_d{own}", F.pmod(F.xxhash64(number), F.col(f"_n{own}")).cast("int"))
        t = t.withColumn(f"_d{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)))
        t = t.withColumnRenamed("_wide", f"_wide_{own}").select(*rows.drop("_wide", *by).columns, f"_wide_{own}", *(F.col(c).alias(f"{c}_{own}") for c in [*by, "_dl", "_dr"]))
        return t.repartition(parts, *(f"{c}_{own}" for c in [*by, "_dl", "_dr"]))

    return dealt_out(x, "l", "r", numbers[0]), dealt_out(y, "r", "l", numbers[1]), [*by, "_dl", "_dr"]


def tiled_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str], condition: Column, numbers: tuple[str, str], weights: tuple[Column, Column], *, side: int = SIDE, pairs: int = PAIRS) -> DataFrame:
    """``range_join`` in tiles: a bin is dealt out on both sides, by ``numbers`` of the rows, so that a side of a tile weighs about ``side``.

    ``weights``: what a row of either side stands for. Both sides should be tables: bins are weighed
    first, and the partitions hold about ``pairs`` pairs of that weight each.
    """
    x, y, names = tiled(left, right, keys, left_span, right_span, numbers, weights, side=side, pairs=pairs)
    on = (F.col("_bin_l") == F.greatest("_l0", "_r0")) & ((F.col("_lv_l") == 0) | F.col("_wide_l") | F.col("_wide_r")) & condition
    for c in names[::-1]:
        on = (F.col(f"{c}_l") == F.col(f"{c}_r")) & on
    return x.join(y.hint("merge"), on).select(*left.columns, *right.columns)
