"""GTF: scan, checks, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceloom.sources.files import lines


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file_id, line_no, chrom, feature, start, end, strand, attrs) of all lines but comments.

    Every line must have 9 columns, whole-number coordinates and a strand of ``+-.``, whatever its feature.
    """
    c = F.split("value", "\t", 9)
    ok = (F.size(c) == 9) & c[3].try_cast("int").isNotNull() & c[4].try_cast("int").isNotNull() & c[6].isin("+", "-", ".")
    comment = F.col("value").startswith("#")
    # the check excepts comments itself: filters on its columns may run before the one on comments
    checked = F.when(comment, F.lit(None)).when(ok, c).otherwise(F.raise_error(F.concat(F.lit("bad GTF line: "), F.col("value"))).cast("array<string>"))
    rows = lines(spark, paths).filter(~comment).withColumn("c", checked)
    return rows.select(
        "source_file_id", "line_no", F.col("c")[0].alias("chrom"), F.col("c")[2].alias("feature"), F.col("c")[3].cast("int").alias("start"), F.col("c")[4].cast("int").alias("end"),
        F.col("c")[6].alias("strand"), F.col("c")[8].alias("attrs"),
    )


def parts(attrs: Column) -> Column:
    """The non-empty, trimmed attributes."""
    return F.filter(F.transform(F.split(attrs, ";"), lambda a: F.regexp_replace(a, r"^\s+|\s+$", "")), lambda a: a != "")


def attribute(attrs: Column, key: str) -> Column:
    """Value of the first attribute with exactly this key, quoted or bare; empty where there is none."""
    return F.coalesce(F.regexp_extract(attrs, rf'(?:^|;)\s*{key}\s+"?([^";]*)"?', 1), F.lit(""))


def ids(attrs: Column) -> Column:
    """(tx_id, gene_id): attributes are read in order until both are known; of keys that begin with a name the latest so far stands.

    A value is what the first pair of quotes holds, else the second word.
    """
    quoted = '"([^"]*)"'
    value = lambda a: F.when(a.rlike(quoted), F.regexp_extract(a, quoted, 1)).otherwise(F.regexp_extract(a, r"^\S+\s+(\S+)", 1))

    def step(acc: Column, a: Column) -> Column:
        known = (acc["tx_id"] != "") & (acc["gene_id"] != "")
        tx = ~known & a.startswith("transcript_id")
        gene = ~known & ~tx & a.startswith("gene_id")
        return F.struct(F.when(tx, value(a)).otherwise(acc["tx_id"]).alias("tx_id"), F.when(gene, value(a)).otherwise(acc["gene_id"]).alias("gene_id"))

    return F.aggregate(parts(attrs), F.struct(F.lit("").alias("tx_id"), F.lit("").alias("gene_id")), step)


def bag(attrs: Column) -> Column:
    """All (key, value), quotes trimmed, order and repeats kept."""
    return F.transform(parts(attrs), lambda a: F.struct(F.regexp_extract(a, r"^(\S+)", 1).alias("key"), F.translate(F.trim(F.regexp_replace(a, r"^\S+\s*", "")), '"', "").alias("value")))


def exon_rows(gtf: DataFrame) -> DataFrame:
    """Exon lines in the shape that ``assemble.transcripts`` reads."""
    e = gtf.filter("feature = 'exon'").withColumn("ids", ids(F.col("attrs")))
    return e.select("source_file_id", "chrom", "strand", "ids.tx_id", "ids.gene_id", F.col("start").alias("exon_start"), F.col("end").alias("exon_end"), "line_no")


def transcript_lines(gtf: DataFrame) -> DataFrame:
    """(source_file_id, tx_id, gene_name, attrs, lines): the first transcript line of each id and how many there are."""
    t = gtf.filter("feature = 'transcript'").withColumn("tx_id", attribute(F.col("attrs"), "transcript_id"))
    name = F.nullif(attribute(F.col("attrs"), "gene_name"), F.lit(""))
    return t.groupBy("source_file_id", "tx_id").agg(F.min_by(name, "line_no").alias("gene_name"), F.min_by("attrs", "line_no").alias("attrs"), F.count("*").alias("lines"))


def check(gtf: DataFrame, n_files: int = 1) -> None:
    """Raise where one of the files has no transcript line or its transcripts and exons lie on different chromosomes."""
    kinds = gtf.filter("feature in ('transcript', 'exon')").groupBy("source_file_id", "chrom").agg(F.bool_or(F.col("feature") == "transcript").alias("t"), F.bool_or(F.col("feature") == "exon").alias("x"))
    if odd := kinds.filter("not (t and x)").limit(5).collect():
        raise ValueError(f"chromosomes with only transcripts or only exons: {[(r.source_file_id, r.chrom) for r in odd]}")
    if kinds.agg(F.count_distinct("source_file_id")).first()[0] < n_files:
        raise ValueError("no transcript line" + (" in some of the files" if n_files > 1 else ""))


def check_reference(tx: DataFrame, tx_lines: DataFrame) -> None:
    """Raise where a reference transcript has no transcript line, or two."""
    if twice := tx_lines.filter("lines > 1").limit(5).collect():
        raise ValueError(f"repeated transcript lines: {[r.tx_id for r in twice]}")
    if none := tx.join(tx_lines, ["source_file_id", "tx_id"], "left_anti").limit(5).collect():
        raise ValueError(f"transcripts without a line: {[r.tx_id for r in none]}")
