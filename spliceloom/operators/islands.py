"""Super clusters: maximal stretches of a chromosome that transcripts of either strand cover.

A transcript joins an island when it starts at or before the largest end so far. That depends on
its start alone: an island opens at a start that lies behind every end of transcripts that start
earlier, and a transcript belongs to the last island opened at or before its start. Both are
running maxima over distinct starts, so a dense locus costs as many rows as it has places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.operators.prefixmax import BIN, prefix_max
from spliceloom.session import written


def places(tx: DataFrame) -> DataFrame:
    """(chrom, start, end, tx_cnt): one row for each distinct start, a written table."""
    return written(tx.groupBy("chrom", "start").agg(F.max("end").alias("end"), F.count("*").alias("tx_cnt")), "island-places")


def islands_of(starts: DataFrame, *, bin_size: int = BIN) -> DataFrame:
    """(chrom, start, island) of each of the ``places``."""
    earlier = starts.select("chrom", (F.col("start") - 1).alias("_at"))
    reach = prefix_max(starts.select("chrom", F.col("start").alias("_at"), "end"), earlier, ["chrom"], "_at", "end", bin_size=bin_size)
    opened = reach.filter("best is null or _at + 1 > best").select("chrom", (F.col("_at") + 1).alias("start"), (F.col("_at") + 1).alias("_open"))
    return prefix_max(opened, starts, ["chrom"], "start", "_open", bin_size=bin_size).withColumnRenamed("best", "island")


def with_islands(tx: DataFrame, *, bin_size: int = BIN) -> DataFrame:
    """Adds ``island``: the start of the island, which names it within its chromosome. ``tx`` is read twice, so hand in a table, not a long plan."""
    island = islands_of(places(tx), bin_size=bin_size)
    return tx.join(island, ["chrom", "start"]).select(*tx.columns, "island")


def island_table(tx: DataFrame, *, bin_size: int = BIN) -> DataFrame:
    """One row an island, with its end and the number of its transcripts; ``tx`` is read once."""
    starts = places(tx)
    rows = starts.join(islands_of(starts, bin_size=bin_size), ["chrom", "start"])
    return rows.groupBy("chrom", "island").agg(F.max("end").cast("int").alias("island_end"), F.sum("tx_cnt").alias("tx_cnt"))
