"""Guide intervals (BED6) and chromosome aliases. The first line of either file is a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceloom.sources.files import lines


def _body(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file, the first one marked as header."""
    raw = lines(spark, [path])
    first = raw.agg(F.min("line_no")).first()[0]
    if first is None:
        return raw.withColumn("header", F.lit(False))
    return raw.withColumn("header", (F.col("line_no.block") == first["block"]) & (F.col("line_no.n") == first["n"]))


def guide(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, strand, start, end, name, score), closed: start is one more than in the file."""
    # the checks except skipped lines themselves: filters on their columns may run before the one on lines
    skip = F.col("header") | F.col("value").rlike(r"^\s*$|^#|^track|^browser")
    body = _body(spark, path).filter(~skip)
    c = F.split(F.trim("value"), r"\s+")
    lo, hi, score = c[1].try_cast("int"), c[2].try_cast("int"), c[4].try_cast("float")
    ok = (F.size(c) >= 6) & (lo >= 0) & (hi > lo) & score.isNotNull() & c[5].isin("+", "-", ".")
    checked = F.when(skip, F.lit(None)).when(F.coalesce(ok, F.lit(False)), c).otherwise(F.raise_error(F.concat(F.lit("bad BED line: "), F.col("value"))).cast("array<string>"))
    b = body.withColumn("c", checked)
    return b.select(F.col("c")[0].alias("chrom"), F.col("c")[5].alias("strand"), (F.col("c")[1].cast("int") + 1).alias("start"), F.col("c")[2].cast("int").alias("end"), F.col("c")[3].alias("name"), F.col("c")[4].cast("float").alias("score"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(primary, secondary); exactly two columns, each primary name once."""
    c = F.split(F.trim("value"), r"\s+")
    blank = F.col("header") | F.col("value").rlike(r"^\s*$")
    body = _body(spark, path).filter(~blank)
    checked = F.when(blank, F.lit(None)).when(F.size(c) == 2, c).otherwise(F.raise_error(F.concat(F.lit("bad alias line: "), F.col("value"))).cast("array<string>"))
    out = body.withColumn("c", checked).select(F.col("c")[0].alias("primary"), F.col("c")[1].alias("secondary"))
    if twice := out.groupBy("primary").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"repeated chromosome {twice[0]['primary']}")
    return out
