"""From exon lines to transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceloom.functions import transcript as T

#: Columns of a transcript table that the other operators read.
COLUMNS = ("source_file_id", "chrom", "start", "end", "strand", "n_exons", "tx_id", "gene_id", "exons", "junctions", "tx_type")


def transcripts(exons: DataFrame, *, order: str = "line_no", gene: str = "gene_id") -> DataFrame:
    """Group exon rows (source_file_id, chrom, strand, tx_id, gene_id, exon_start, exon_end, line_no) by transcript.

    Bounds come from exons only; strand and gene are those of the first exon line. Exons whose
    start exceeds their end are dropped; exons on two chromosomes are an error. A transcript
    without exons does not appear. ``tx_type`` is left to ``with_types``.
    """
    rows = exons.filter("exon_start <= exon_end")
    g = rows.groupBy("source_file_id", "tx_id").agg(
        F.min("chrom").alias("chrom"), F.max("chrom").alias("_chrom"), F.min("exon_start").cast("int").alias("start"), F.max("exon_end").cast("int").alias("end"),
        F.min_by("strand", order).alias("strand"), F.min_by(gene, order).alias("gene_id"),
        F.array_sort(F.collect_list(F.struct(F.col("exon_start").cast("int").alias("start"), F.col("exon_end").cast("int").alias("end")))).alias("exons"),
    )
    one = F.when(F.col("chrom") == F.col("_chrom"), F.col("chrom")).otherwise(F.raise_error(F.concat(F.lit("exons on two chromosomes: "), F.col("tx_id"))))
    return g.select(
        "source_file_id", one.alias("chrom"), "start", "end", "strand", F.size("exons").alias("n_exons"), "tx_id", "gene_id", "exons", T.junctions_of(F.col("exons")).alias("junctions")
    )


def with_types(tx: DataFrame, canonical: Column) -> DataFrame:
    """Adds ``tx_type``; ``canonical``: an array of booleans, one a junction."""
    return tx.withColumn("tx_type", T.tx_type(F.col("n_exons"), canonical))


def with_sites(tx: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds splice sites and ``tx_type`` from (chrom, l, r, left2, right2), the bases inside each intron.

    Distinct introns are looked up once; transcripts get them back as one map of their own junctions.
    """
    j = tx.filter("n_exons > 1").select("source_file_id", "tx_id", "chrom", "strand", F.posexplode("junctions").alias("pos", "j")).select("*", "j.l", "j.r")
    sites = j.join(windows, ["chrom", "l", "r"], "left").withColumn("pair", T.site_pair(F.col("strand"), F.col("left2"), F.col("right2")))
    per = sites.groupBy("source_file_id", "tx_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pair"))), lambda s: s["pair"]).alias("splice_sites"))
    out = tx.join(per, ["source_file_id", "tx_id"], "left")
    return with_types(out, F.transform(F.coalesce("splice_sites", F.array().cast("array<string>")), lambda s: F.coalesce(s.isin(*T.CANONICAL), F.lit(False))))


def index_stats(tx: DataFrame) -> DataFrame:
    """One row of counts over a transcript table."""
    n = F.count("*")
    return tx.agg(
        n.alias("tx_cnt"), F.countDistinct("gene_id").alias("gene_cnt"), *(F.count_if(F.col("strand") == s).alias(f"{name}_cnt") for s, name in (("+", "plus"), ("-", "minus"), (".", "unstranded"))),
        *(F.count_if(F.col("tx_type") == t).alias(f"{t.lower()}_cnt") for t in ("MONO", "ALL_CA", "PRT_CA", "NOT_CA")),
        F.coalesce(F.sum(F.size("junctions")), F.lit(0)).alias("junction_cnt"),
    )
