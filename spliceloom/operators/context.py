"""Sequence around transcript ends, and distances to supporting peaks.

Peaks are guide intervals, closed (start, end); their 0-based start is ``start - 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceloom.functions import transcript as T
from spliceloom.operators.rangejoin import range_join


def _tes() -> Column:
    return T.tes(F.col("strand"), F.col("start"), F.col("end"))


def downstream_window(query: DataFrame, n: int, chrom_len: Column) -> DataFrame:
    """Adds the 0-based window [win_lo, win_hi) behind the transcript's end; null off the chromosome or without a strand.

    The minus strand's window includes the end's base, the plus strand's does not.
    """
    c = F.col("strand")
    q = query.withColumn("tes", _tes())
    fits = ((c == "+") & (F.col("tes") + n <= chrom_len)) | ((c == "-") & (F.col("tes") >= n))
    lo = F.when(c == "+", F.col("tes")).otherwise(F.col("tes") - n)
    return q.withColumn("win_lo", F.when(fits, lo)).withColumn("win_hi", F.when(fits, lo + n))


def upstream_window(query: DataFrame, n: int, chrom_len: Column) -> DataFrame:
    """The same before the transcript's end."""
    c = F.col("strand")
    q = query.withColumn("tes", _tes())
    fits = ((c == "+") & (F.col("tes") >= n)) | ((c == "-") & (F.col("tes") + n <= chrom_len))
    lo = F.when(c == "+", F.col("tes") - n).otherwise(F.col("tes"))
    return q.withColumn("win_lo", F.when(fits, lo)).withColumn("win_hi", F.when(fits, lo + n))


def _sense(seq: Column) -> Column:
    """Minus windows are reverse-complemented and upper-cased, plus windows keep their case."""
    return F.when(F.col("strand") == "-", T.reverse_complement(seq)).otherwise(seq)


def downstream_context(with_seq: DataFrame, n: int) -> DataFrame:
    seq = _sense(F.col("seq"))
    return with_seq.withColumn("seq_a_downstream_tts", seq).withColumn("perc_a_downstream_tts", T.a_percent(F.col("seq_a_downstream_tts"))).drop("seq", "win_lo", "win_hi", "tes")


def motif_context(with_seq: DataFrame) -> DataFrame:
    motif, dist = T.polya_motif(_sense(F.col("seq")))
    return with_seq.withColumn("poly_a_motif", motif).withColumn("poly_a_dist", dist).drop("seq", "win_lo", "win_hi", "tes")


def _near(query: DataFrame, guide: DataFrame, end: Column, q0: Column, flank: int) -> DataFrame:
    """(chrom, strand, at, q0, g0, g1): distinct transcript ends ``at`` with the distinct peaks within the flank.

    ``q0`` is the 0-based place of ``at``. Transcripts that share an end, and peaks of one span, are asked for once.
    """
    g = guide.select(F.col("chrom").alias("g_chrom"), F.col("strand").alias("g_strand"), (F.col("start") - 1).alias("g0"), F.col("end").alias("g1")).distinct()
    q = query.select("chrom", "strand", end.alias("at")).distinct().withColumn("q0", q0).withColumn("f_lo", F.col("q0") - flank).withColumn("f_hi", F.col("q0") + flank)
    on = (F.col("g0") < F.col("f_hi")) & (F.col("g1") > F.col("f_lo"))
    return range_join(q, g, [("chrom", "g_chrom"), ("strand", "g_strand")], ("f_lo", "f_hi"), ("g0", "g1"), on)


def _told(query: DataFrame, best: DataFrame, end: Column, within: str) -> DataFrame:
    """``query`` with what ``best`` says of its end; ``within`` is false where no peak is near."""
    b = best.select(F.col("chrom").alias("_c"), F.col("strand").alias("_s"), F.col("at").alias("_at"), *(c for c in best.columns if c not in ("chrom", "strand", "at")))
    on = (F.col("chrom") == F.col("_c")) & (F.col("strand") == F.col("_s")) & (end == F.col("_at"))
    return query.join(b, on, "left").drop("_c", "_s", "_at").fillna(False, [within])


def cage_peaks(query: DataFrame, guide: DataFrame | None, flank: int) -> DataFrame:
    """Adds within_cage_peak and dist_to_cage_peak: the peak around the start, else the nearest upstream one; both null without a guide."""
    if guide is None:
        return query.withColumn("within_cage_peak", F.lit(None).cast("boolean")).withColumn("dist_to_cage_peak", F.lit(None).cast("int"))
    minus, end, tss = F.col("strand") == "-", T.tss(F.col("strand"), F.col("start"), F.col("end")), F.col("at")
    near = _near(query, guide, end, F.when(minus, tss).otherwise(tss - 1), flank).filter(~(((F.col("strand") == "+") & (F.col("g0") > tss)) | (minus & (F.col("g1") < tss))))
    center = F.when(F.col("g1") - F.col("g0") > 1, F.floor((F.col("g0") + F.col("g1")) / 2) + 1).otherwise(F.col("g0")).cast("int")
    dist = F.when(minus, tss - center).otherwise(center - tss)
    within = (F.col("g0") <= tss) & (tss <= F.col("g1"))
    best = near.groupBy("chrom", "strand", "at").agg(F.min(F.struct((~within).alias("out"), F.abs(dist).alias("far"), "g0", dist.alias("dist"))).alias("b"))
    best = best.select("chrom", "strand", "at", (~F.col("b.out")).alias("within_cage_peak"), F.col("b.dist").alias("dist_to_cage_peak"))
    return _told(query, best, end, "within_cage_peak")


def polya_peaks(query: DataFrame, guide: DataFrame | None, flank: int) -> DataFrame:
    """Adds within_poly_a_peak (of any peak) and dist_to_poly_a_site (of the nearest)."""
    if guide is None:
        return query.withColumn("within_poly_a_peak", F.lit(None).cast("boolean")).withColumn("dist_to_poly_a_site", F.lit(None).cast("int"))
    minus, at, q0 = F.col("strand") == "-", F.col("at"), F.col("q0")
    near = _near(query, guide, _tes(), F.when(minus, at - 1).otherwise(at), flank)
    within = F.when(minus, (F.col("g0") < q0) & (q0 <= F.col("g1"))).otherwise((F.col("g0") <= q0) & (q0 < F.col("g1")))
    dist = F.when(minus, q0 - F.col("g1")).otherwise(F.col("g0") - q0)
    best = near.groupBy("chrom", "strand", "at").agg(F.bool_or(within).alias("within_poly_a_peak"), F.min_by(dist, F.struct(F.abs(dist).alias("far"), "g0", dist.alias("d"))).alias("dist_to_poly_a_site"))
    return _told(query, best, _tes(), "within_poly_a_peak")
