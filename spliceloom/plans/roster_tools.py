"""Queries of the attribute tools, over rendered attribute columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceloom.plans import adapter as A
from spliceloom.plans import commands
from spliceloom.sources import gtf
from spliceloom.tools import attributes as X

_ATTR = """concat('gene_id "', gene_id, '"; transcript_id "', tx_id, '"; TPM "', cast(n_exons * 7 as varchar), '"; ISOM_COUNT "', cast(n_exons as varchar), '";')"""
_SPARK_ATTR = _ATTR.replace("varchar", "string")


def _rows(spark, d):
    return A.transcripts(spark, d).withColumn("attrs", F.expr(_SPARK_ATTR))


def chop_attrs(spark, d):
    return _rows(spark, d).select("tx_id", X.chopped(F.col("attrs"), ["tpm"]).alias("own_removed"), X.chopped(F.col("attrs"), everything=True).alias("all_removed"))


def attribute_bag(spark, d):
    b = F.transform(gtf.bag(F.col("attrs")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return _rows(spark, d).select("tx_id", F.array_join(b, "|").alias("bag"), gtf.attribute(F.col("attrs"), "TPM").alias("tpm"), gtf.ids(F.col("attrs"))["gene_id"].alias("gene"))


def _values(spark, d):
    t = A.transcripts(spark, d)
    rec = F.concat(F.lit("S"), (F.col("source_file_id") + 1).cast("string"), F.lit(":"), F.col("tx_id"), F.lit(":x"))
    merged = t.groupBy(F.concat(F.lit("M"), "chrom", F.lit("_"), F.floor(F.col("start") / 4000).cast("string"), "strand").alias("merged_tx_id")).agg(F.array_join(F.array_sort(F.collect_list(rec)), "|").alias("src"))
    merged = merged.withColumn("line_no", F.lit(1))
    source = t.select((F.col("source_file_id") + 1).alias("file_id"), F.col("tx_id").alias("src_tx_id"), F.when(F.col("n_exons") == 3, "").otherwise(F.col("n_exons").cast("string")).alias("value"), F.col("tx_id").alias("line_no"))
    return merged, X.value_rows(X.projection(merged), source)


def valtable(spark, d):
    merged, rows = _values(spark, d)
    return X.value_matrix(merged, rows, [(i, f"file_{i}") for i in (1, 2, 3, 4)])


def valtable_lines(spark, d):
    """The value table as lines over 40 files, of which four have values."""
    merged, rows = _values(spark, d)
    return X.value_cells(merged, rows, range(40)).select("transcript_id", X.filled_line(F.col("cells"), 40, "0.0").alias("line"))


def tx_order(spark, d):
    """The order of a file, all transcripts as one file."""
    tx = commands.with_order(A.transcripts(spark, d).withColumn("source_file_id", F.lit(0)), 1 << 16)
    return tx.select("tx_id", "chrom", "start", "gidx")


def valtable_stats(spark, d):
    return X.value_stats(_values(spark, d)[1])


_M = """, v as (select concat('M', chrom, '_', cast(floor(s / 4000) as bigint), strand) as transcript_id, source_file_id + 1 as file_id, tx_id, case when n_exons = 3 then '' else cast(n_exons as varchar) end as value from tx)"""


def queries():
    return {"chop_attrs": chop_attrs, "attribute_bag": attribute_bag, "valtable": valtable, "valtable_lines": valtable_lines, "valtable_stats": valtable_stats, "tx_order": tx_order}


def oracle_sql():
    cte = f"with {A.CTE}"
    files = ", ".join(f"coalesce(arg_max(value, tx_id) filter (file_id = {i} and value <> ''), '0.0') as file_{i}" for i in (1, 2, 3, 4))
    return {
        "chop_attrs": f"""{cte} select tx_id, concat('gene_id "', gene_id, '"; transcript_id "', tx_id, '"; TPM "', n_exons * 7, '";') as own_removed, concat('gene_id "', gene_id, '"; transcript_id "', tx_id, '";') as all_removed from tx""",
        "attribute_bag": f"{cte} select tx_id, concat('gene_id=', gene_id, '|transcript_id=', tx_id, '|TPM=', n_exons * 7, '|ISOM_COUNT=', n_exons) as bag, cast(n_exons * 7 as varchar) as tpm, gene_id as gene from tx",
        "valtable": f"{cte} {_M} select transcript_id, {files} from v group by transcript_id",
        "tx_order": f'{cte} select tx_id, chrom, s as start, row_number() over (order by chrom, s, e, srank, tx_id, gene_id) - 1 as gidx from tx',
        "valtable_lines": f"""{cte} {_M}, w as (select transcript_id, file_id, arg_max(value, tx_id) filter (value <> '') as value from v group by all),
 x as (select transcript_id, i from (select distinct transcript_id from v), range(40) r(i))
 select x.transcript_id, string_agg(coalesce(value, '0.0'), chr(9) order by i) as line from x left join w on w.transcript_id = x.transcript_id and w.file_id = i group by x.transcript_id""",
        "valtable_stats": f"{cte} {_M} select file_id, count(*) filter (value <> '') as extracted, count(*) filter (value = '') as attr_missing, cast(0 as bigint) as src_tx_not_in_merged from v group by file_id",
    }
