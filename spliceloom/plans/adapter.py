"""Transcript models made of the order tables, the same rows in Spark and in DuckDB.

An order is a transcript, its distinct line numbers are exon slots of a locus shared by many
orders; rare shifts of two or three bases give fuzzy chains. File 0 plays the reference.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceloom.functions import transcript as T
from spliceloom.operators import assemble

#: Loci of the queries and benchmarks, whatever the scale: pairs of transcripts at a locus grow with the square of the input.
LOCI = 200

EXONS = """
select concat('T', l_orderkey) as tx_id, concat('chr', l_orderkey % 5 + 1) as chrom,
  case when l_orderkey % 13 = 0 then '.' when floor(l_orderkey / 800) % 3 = 0 then '-' else '+' end as strand,
  cast(floor(l_orderkey / {loci}) % 4 as int) as source_file_id, cast(l_orderkey % {loci} as int) as locus, cast(l_linenumber as int) as slot,
  cast((l_orderkey % {loci}) * 4000 + 1000 + l_linenumber * 200 + case when min(l_partkey) % 17 = 0 then 2 else 0 end as int) as exon_start,
  cast((l_orderkey % {loci}) * 4000 + 1000 + l_linenumber * 200 + 100 + case when min(l_suppkey) % 19 = 0 then 3 else 0 end as int) as exon_end
from {lineitem} group by l_orderkey, l_linenumber"""

#: Every seventh order keeps the introns inside pairs of neighbouring slots, as one long exon.
RETAINED = """
select tx_id, chrom, strand, source_file_id, locus, cast(min(slot) as int) as slot, min(exon_start) as exon_start, max(exon_end) as exon_end
from (select *, case when cast(substr(tx_id, 2) as bigint) % 7 = 0 then floor((slot + 1) / 2) else slot + 100 end as part from ({exons}) x) y
group by tx_id, chrom, strand, source_file_id, locus, part"""

GENE = "concat('G', min(locus), case when max(slot) <= 3 then 'A' when min(slot) >= 5 then 'B' else 'C' end)"

GUIDES = """
select concat('chr', c_custkey % 5 + 1) as chrom,
  cast((c_custkey % 200) * 4000 + 1190 + (floor(c_custkey / 200) % 7) * 3 as int) as start0,
  cast((c_custkey % 200) * 4000 + 1190 + (floor(c_custkey / 200) % 7) * 3 + 1 + c_nationkey % 20 as int) as end1,
  concat('p', c_custkey) as name, case when c_custkey % 2 = 0 then '+' else '-' end as strand
from {customer}"""

#: Bases of the arithmetic genome, by position; every chromosome is LENGTH long.
GENOME, LENGTH = "ACGTTGAACCAGTAAT", 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exons(spark: SparkSession, sf_dir: str, loci: int = LOCI, retained: bool = False) -> DataFrame:
    """Exon rows in the shape that a GTF scan gives; ``retained``: some orders keep introns inside exons."""
    sql = RETAINED.replace("{exons}", EXONS) if retained else EXONS
    rows = spark.sql(sql.replace("{loci}", str(loci)), lineitem=table(spark, sf_dir, "lineitem"))
    # a gene is told of all exons of a transcript, which stay together for the grouping that follows
    whole = Window.partitionBy("tx_id")
    gene = re.sub(r"(min|max)\((\w+)\)", r"_\1_\2", GENE)
    ends = {"_min_locus": F.min("locus"), "_max_slot": F.max("slot"), "_min_slot": F.min("slot")}
    told = rows.select("*", *(e.over(whole).alias(n) for n, e in ends.items())).withColumn("gene_id", F.expr(gene))
    return told.drop(*ends).withColumn("line_no", F.col("slot").cast("long"))


def motif(l, r):
    """Splice motif of an intron, by rule."""
    return F.when((l + r) % 11 == 0, "CT-CC").when((l + r) % 13 == 0, "GC-AG").otherwise("GT-AG")


def transcripts(spark: SparkSession, sf_dir: str, loci: int = LOCI, retained: bool = False) -> DataFrame:
    tx = assemble.transcripts(exons(spark, sf_dir, loci, retained))
    return assemble.with_types(tx, F.transform("junctions", lambda j: motif(j["l"], j["r"]).isin(*T.CANONICAL)))


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guide intervals, closed."""
    return spark.sql(GUIDES, customer=table(spark, sf_dir, "customer")).select("chrom", "strand", (F.col("start0") + 1).alias("start"), F.col("end1").alias("end"), "name")


def genome(lo, hi):
    """Bases of [lo, hi), 0-based."""
    return F.array_join(F.transform(F.sequence(lo.cast("long"), hi.cast("long") - 1), lambda p: F.substring(F.lit(GENOME), ((p * p + 3 * p) % 16 + 1).cast("int"), F.lit(1))), "")


#: The same for DuckDB: CTEs exons, genes, tx (with lists), junctions.
_EXONS = EXONS.replace("{loci}", str(LOCI)).replace("{lineitem}", "lineitem")
CTE = f"""
exons as ({_EXONS}),
genes as (select tx_id, {GENE} as gene_id from exons group by tx_id),
ex as (select e.*, lead(exon_start) over (partition by tx_id order by exon_start) as nxt from exons e),
jn as (select tx_id, chrom, strand, source_file_id, exon_end as l, nxt as r, row_number() over (partition by tx_id order by exon_start) - 1 as pos,
  (exon_end + nxt) % 11 <> 0 as canonical from ex where nxt is not null),
ch as (select tx_id, string_agg(l || '-' || r, ',' order by pos) as chain, bool_and(canonical) as all_ca, bool_or(canonical) as any_ca, list({{'l': l, 'r': r}} order by pos) as jl from jn group by tx_id),
t0 as (select tx_id, source_file_id, chrom, strand, min(exon_start) as s, max(exon_end) as e, cast(count(*) as int) as n_exons,
  sum(exon_end - exon_start) as len, list({{'s': exon_start, 'e': exon_end}} order by exon_start) as el from exons group by tx_id, source_file_id, chrom, strand),
tx as (select t0.*, gene_id, coalesce(chain, '') as chain, jl, case when n_exons = 1 then 'MONO' when all_ca then 'ALL_CA' when any_ca then 'PRT_CA' else 'NOT_CA' end as tx_type,
  case when strand = '-' then e else s end as tss, case when strand = '-' then s else e end as tes, case strand when '+' then 0 when '-' then 1 else 2 end as srank
  from t0 join genes using (tx_id) left join ch using (tx_id)),
w1 as (select *, max(e) over (partition by chrom order by s, e, source_file_id, tx_id rows between unbounded preceding and 1 preceding) as reach from tx),
isl as (select * exclude (reach), max(case when reach is null or s > reach then s end) over (partition by chrom order by s, e, source_file_id, tx_id rows unbounded preceding) as island from w1)
"""
#: The same over exons with retained introns.
RETAINED_CTE = CTE.replace(_EXONS, RETAINED.replace("{exons}", _EXONS))
GUIDE_CTE = f"guides as (select chrom, strand, start0, start0 + 1 as gs, end1 as ge from ({GUIDES.replace('{customer}', 'customer')}))"
