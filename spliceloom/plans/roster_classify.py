"""Queries of the classification: file 0 is the reference, files 1 to 3 the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceloom.functions import transcript as T
from spliceloom.operators import classify as C
from spliceloom.operators import context
from spliceloom.plans import adapter as A
from spliceloom.session import written

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

_PAIRS = """, rf as (select * from tx where source_file_id = 0 and strand <> '.'), qu as (select * from tx where source_file_id > 0),
 pr as (select q.tx_id, q.chrom, q.strand, q.s, q.e, q.n_exons, q.len, q.el, coalesce(q.jl, []) as jl, r.tx_id as r_tx_id, r.strand as r_strand, r.s as rs, r.e as re, r.n_exons as rn, r.len as rlen, r.gene_id as gene,
   r.el as rel, coalesce(r.jl, []) as rjl from qu q join rf r on q.chrom = r.chrom and r.s < q.e and r.e > q.s)"""
_FEATURES = _PAIRS + """, f0 as (select *, rs - least(s, rs) - (s - least(s, rs)) as head, (s - least(s, rs) + len) - (rs - least(s, rs) + rlen) as tail,
   cast(coalesce(list_sum(list_transform(el, lambda x: list_sum(list_transform(rel, lambda y: greatest(least(x.e, y.e) - greatest(x.s, y.s), 0))))), 0) as int) as exon_ov,
   greatest(least(e, re) - greatest(s, rs), 0) as genomic_ov,
   cast(len(list_filter(flatten(list_transform(rel, lambda y: [y.s, y.e])), lambda p: list_contains(flatten(list_transform(el, lambda x: [x.s, x.e])), p))) as int) as site_hits,
   cast(len(list_filter(jl, lambda j: list_contains(rjl, j))) as int) as matched_junctions,
   case when len(jl) > 0 and len(jl) < len(rjl) then list_filter(range(0, len(rjl) - len(jl) + 1), lambda o: rjl[o + 1 : o + len(jl)] = jl)[1] end as sub_at
   from pr where strand = r_strand),
 f1 as (select * exclude (head, tail), case when strand = '-' then tail else head end as d_tss, case when strand = '-' then head else tail end as d_tes,
   case when n_exons = 1 and rn = 1 then case when exon_ov > 0 then 'FSM' else 'None' end when n_exons = 1 and exon_ov = 0 then 'None'
    when n_exons = 1 and len(list_filter(rel, lambda x: x.s <= s and e <= x.e)) > 0 then 'ISM' when n_exons = 1 and len(list_filter(rjl, lambda j: s < j.l and j.l < j.r and j.r < e)) > 0 then 'NIC'
    when n_exons = 1 then 'GeneOverlap' when rn = 1 then case when exon_ov > 0 then 'GeneOverlap' else 'None' end when jl = rjl then 'FSM' when sub_at is not null then 'ISM'
    when matched_junctions > 0 then 'AnyKnownJunction' when site_hits > 0 then 'AnyKnownSpliceSite' when exon_ov > 0 then 'GeneOverlap' else 'None' end as pre_class from f0),
 f2 as (select *, case pre_class when 'FSM' then 6 when 'ISM' then 5 when 'NIC' then 4 when 'AnyKnownJunction' then 3 when 'AnyKnownSpliceSite' then 2 when 'GeneOverlap' then 1 else 0 end as rank,
   case when pre_class = 'NIC' then 'mono-exon_by_intron_retention' when pre_class not in ('FSM', 'ISM') then null when n_exons = 1 then 'mono-exon'
    when pre_class = 'FSM' then case when abs(d_tss) <= 50 and abs(d_tes) <= 50 then 'reference_match' when abs(d_tss) <= 50 then 'alternative_3end' when abs(d_tes) <= 50 then 'alternative_5end' else 'alternative_3end5end' end
    when len(list_filter(el, lambda x: len(list_filter(rjl, lambda j: x.s <= j.l and j.l < j.r and j.r <= x.e)) > 0)) > 0 then 'intron_retention'
    when sub_at = 0 then case when strand = '-' then '3prime_fragment' else '5prime_fragment' end
    when sub_at + len(jl) = len(rjl) then case when strand = '-' then '5prime_fragment' else '3prime_fragment' end else 'internal_fragment' end as pair_sub from f1),
 f as (select *, rank + site_hits + exon_ov::double / greatest(len, 1) + genomic_ov::double / greatest(rlen, 1) - abs(n_exons - rn) as score from f2)"""
_BEST = _FEATURES + """, best as (select * exclude (k) from (select *, row_number() over (partition by tx_id, gene order by rank desc, case when rank >= 5 then abs(d_tss) + abs(d_tes) end nulls last,
    case when rank = 3 then site_hits end desc nulls last, case when rank = 3 then exon_ov end desc nulls last, case when rank = 3 then abs(n_exons - rn) end nulls last,
    case when rank not in (3, 5, 6) then score end desc nulls last, rn = 1, rs, re, r_tx_id) as k from f where rank > 0) where k = 1)"""
_HITS = _BEST + """, od as (select *, row_number() over (partition by tx_id order by rank desc, score desc, gene) as k from best),
 walk(tx_id, k, ws, we, ids) as (select tx_id, k, rs, re, [gene] from od where k = 1 union all
   select o.tx_id, o.k, case when ov then ws else least(ws, rs) end, case when ov then we else greatest(we, re) end, case when ov then ids else list_append(ids, gene) end
   from (select od.*, walk.ws, walk.we, walk.ids, greatest(least(walk.we, od.re) - greatest(walk.ws, od.rs), 0) > 0 as ov from walk join od on od.tx_id = walk.tx_id and od.k = walk.k + 1) o),
 hits as (select tx_id, list_distinct_keep as ids from (select tx_id, ids as list_distinct_keep, row_number() over (partition by tx_id order by k desc) as z from walk) where z = 1)"""
_KNOWN = """, rj as (select distinct r.chrom, r.strand, l, r from jn r where source_file_id = 0 and strand <> '.'),
 kj as (select tx_id, bool_and(exists (select 1 from rj where rj.chrom = j.chrom and rj.strand = j.strand and rj.l = j.l and rj.r = j.r)) as all_junctions_known,
   bool_and(exists (select 1 from rj where rj.chrom = j.chrom and rj.l = j.l) and exists (select 1 from rj where rj.chrom = j.chrom and rj.r = j.r)) as all_sites_known from jn j where source_file_id > 0 group by tx_id)"""
_INTRON = ", ci as (select distinct q.tx_id from tx q join rj on rj.chrom = q.chrom and rj.strand = q.strand and rj.l <= q.s and q.e <= rj.r where q.source_file_id > 0)"
_IR = ", ir as (select distinct x.tx_id from exons x join tx q on q.tx_id = x.tx_id and q.n_exons > 1 join rj on rj.chrom = x.chrom and rj.strand = x.strand and x.exon_start <= rj.l and rj.l < rj.r and rj.r < x.exon_end where x.source_file_id > 0)"
_ANTI = """, an as (select tx_id, string_agg('novelGene_' || gene || '_AS', '_' order by mono, rs, re, r_tx_id) as sense, string_agg(gene, ',' order by mono, rs, re, r_tx_id) as genes from (
   select tx_id, gene, rs, re, r_tx_id, rn = 1 as mono, row_number() over (partition by tx_id, gene order by rn = 1, rs, re, r_tx_id) as k from pr where strand <> r_strand) where k = 1 group by tx_id)"""
_FULL = _HITS + _KNOWN + _INTRON + _IR + _ANTI + """, gj as (select distinct gene_id, l, r from jn join tx using (tx_id) where jn.source_file_id = 0 and jn.strand <> '.'),
 sup as (select tx_id, bool_and(n >= 1) as in_one, bool_or(n >= 2) as shared from (select j.tx_id, j.l, j.r, count(gj.gene_id) as n from (select tx_id, unnest(ids) as gene from hits) h join jn j on j.tx_id = h.tx_id
   left join gj on gj.gene_id = h.gene and gj.l = j.l and gj.r = j.r group by j.tx_id, j.l, j.r) group by tx_id),
 al as (select q.tx_id, q.n_exons, q.strand, q.tx_type, q.len, o.rank, o.pre_class, o.pair_sub, o.r_tx_id, o.rlen, o.rn, o.r_strand, o.d_tss, o.d_tes, o.matched_junctions, o.exon_ov, h.ids, sense,
   coalesce(all_sites_known, false) as sites, coalesce(in_one, false) as in_one, coalesce(shared, false) as shared, ir.tx_id is not null as ir, ci.tx_id is not null as ci, ch.c is null as absent
   from qu q left join od o on o.tx_id = q.tx_id and o.k = 1 left join hits h on h.tx_id = q.tx_id left join kj on kj.tx_id = q.tx_id left join sup on sup.tx_id = q.tx_id left join ir on ir.tx_id = q.tx_id
   left join ci on ci.tx_id = q.tx_id left join an on an.tx_id = q.tx_id left join (select distinct chrom as c from tx where source_file_id = 0) ch on ch.c = q.chrom),
 a2 as (select *, rank in (2, 3) and len(ids) > 1 as multi, case when n_exons = 1 then 'mono-exon' else 'multi-exon' end as shape from al),
 fin as (select tx_id, len as query_length, n_exons as query_exon_n,
   case when absent then 'intergenic' when rank = 6 then 'full-splice_match' when rank = 5 then 'incomplete-splice_match' when rank = 4 then 'novel_in_catalog' when rank = 1 then 'genic'
    when multi and shared then 'moreJunctions' when multi then 'fusion' when rank is not null and sites then 'novel_in_catalog' when rank is not null then 'novel_not_in_catalog'
    when strand = '.' then 'bad_query_transcript' when sense is not null then 'antisense' when ci then 'genic_intron' else 'intergenic' end as structural_category,
   case when absent then shape when rank >= 4 then pair_sub when rank = 1 or multi then shape when rank is not null and ir then 'intron_retention' when rank is not null and sites and in_one then 'combination_of_known_junctions'
    when rank is not null and sites then 'combination_of_known_splicesites' when rank is not null then 'at_least_one_novel_splicesite' when strand = '.' then 'unstranded_transcript' else shape end as subcategory,
   case when absent then null when rank is not null then array_to_string(ids, '_') when strand <> '.' and sense is not null then sense else 'novel' end as ref_gene_id,
   case when rank >= 5 and not absent then r_tx_id else 'novel' end as ref_tx_id, case when rank is not null and not multi and not absent then rlen end as ref_length,
   case when rank is not null and not multi and not absent then rn end as ref_exon_n, case when rank is not null and not multi and not absent then r_strand end as ref_strand,
   case when rank >= 5 and not absent then d_tss end as diff_to_tss, case when rank >= 5 and not absent then d_tes end as diff_to_tes,
   case when rank is not null and not absent then matched_junctions else 0 end as matched_junctions,
   case when rank is not null and not absent then case when matched_junctions > 0 then matched_junctions + 1 when exon_ov > 0 then 1 else 0 end else 0 end as matched_exons,
   tx_type in ('MONO', 'ALL_CA') as all_canonical from a2)"""


def query(name: str, sql: str | None = None, cte: str = A.CTE):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = f"with recursive {cte} {sql}"
        return f

    return keep


def _sides(spark, d, retained=False):
    tx = A.transcripts(spark, d, retained=retained)
    return tx.filter("source_file_id > 0"), tx.filter("source_file_id = 0")


def _tables(spark, d, *columns):
    """Both sides, from a table of all transcripts with these columns besides those of a span."""
    tx = written(A.transcripts(spark, d).select("source_file_id", "tx_id", "chrom", "strand", "start", "end", "gene_id", *columns), "classify-transcripts")
    return tx.filter("source_file_id > 0"), C.reference_of(tx.filter("source_file_id = 0"))


def _listed_sides(spark, d):
    """Both sides for pairs of classes."""
    return _tables(spark, d, "n_exons", "exons", "junctions")


def _shape_hits(spark, d):
    """(best hits of distinct shapes, shape of each query)."""
    q, r = _sides(spark, d)
    shapes, of = C.distinct_shapes(q)
    return C.best_hits(shapes, C.shape_reference(C.reference_of(r))), of


def _of_queries(told, of):
    """What is told of shapes, for each query."""
    return of.select("tx_id", "shape").join(told.drop("source_file_id").withColumnRenamed("tx_id", "shape"), "shape")


@query("candidate_overlap", _PAIRS + " select tx_id, r_tx_id, strand = r_strand as same_strand from pr")
def candidate_overlap(spark, d):
    return C.each(C.span_pairs(*_listed_sides(spark, d)).withColumn("same_strand", F.col("strand") == F.col("r_strand")), "same_strand")


@query("pair_features", _FEATURES + " select tx_id, r_tx_id, cast(d_tss as int) as d_tss, cast(d_tes as int) as d_tes, exon_ov, genomic_ov, site_hits, matched_junctions, cast(sub_at as int) as sub_at from f")
def pair_features(spark, d):
    return C.each(C.shape_pairs(*_listed_sides(spark, d)), "d_tss", "d_tes", "exon_ov", "genomic_ov", "site_hits", "matched_junctions", "sub_at")


@query("preclass", _FEATURES + " select tx_id, r_tx_id, pre_class, pair_sub, rank, score from f")
def preclass(spark, d):
    return C.each(C.shape_pairs(*_listed_sides(spark, d)), "pre_class", "pair_sub", "rank", "score")


@query("fsm_ism_subtypes", _FEATURES + " select pre_class, pair_sub, count(*) as pairs from f where rank >= 4 group by pre_class, pair_sub")
def fsm_ism_subtypes(spark, d):
    pairs = C.shape_pairs(*_listed_sides(spark, d)).filter("rank >= 4")
    return pairs.groupBy("pre_class", "pair_sub").agg(F.sum(F.size("tx_ids").cast("long") * F.size("r_tx_ids")).alias("pairs"))


@query("best_hit_per_gene", _BEST + " select tx_id, gene, r_tx_id, pre_class, score from best")
def best_hit_per_gene(spark, d):
    hits, of = _shape_hits(spark, d)
    return _of_queries(hits, of).select("tx_id", F.col("r_gene_id").alias("gene"), "r_tx_id", "pre_class", "score")


@query("associated_hits", _HITS + " select h.tx_id, array_to_string(ids, '_') as genes, o.r_tx_id as primary_tx, o.pre_class as primary_class from hits h join od o on o.tx_id = h.tx_id and o.k = 1")
def associated_hits(spark, d):
    hits, of = _shape_hits(spark, d)
    return _of_queries(C.associated(hits), of).select("tx_id", F.array_join(F.transform("genes", lambda g: g["id"]), "_").alias("genes"), F.col("hit.r_tx_id").alias("primary_tx"), F.col("hit.pre_class").alias("primary_class"))


@query("known_junctions", _KNOWN + " select tx_id, all_junctions_known, all_sites_known from kj")
def known_junctions(spark, d):
    q, r = _sides(spark, d)
    return C.known_junctions(q, C.reference_of(r)).select("tx_id", "all_junctions_known", "all_sites_known")


@query("intron_containment", _KNOWN + _INTRON + " select tx_id from ci")
def intron_containment(spark, d):
    q, r = _sides(spark, d)
    return C.in_known_intron(q, C.reference_of(r)).select("tx_id")


@query("intron_retention", _KNOWN + _IR + " select tx_id from ir", A.RETAINED_CTE)
def intron_retention(spark, d):
    q, r = _sides(spark, d, retained=True)
    return C.retains_known_intron(q, C.reference_of(r)).select("tx_id")


@query("classify_retained", _FULL + " select structural_category, subcategory, count(*) as tx_cnt from fin group by all", A.RETAINED_CTE)
def classify_retained(spark, d):
    done = C.classify(*_sides(spark, d, retained=True))
    return done.groupBy("structural_category", "subcategory").agg(F.count("*").alias("tx_cnt"))


@query("antisense_genes", _PAIRS + _ANTI + " select tx_id, genes from an")
def antisense_genes(spark, d):
    q, r = _sides(spark, d)
    return C.antisense_genes(q, C.reference_of(r)).select("tx_id", F.array_join("antisense", ",").alias("genes"))


@query("gene_endpoint_diffs", _PAIRS + """, gg as (select distinct tx_id, chrom, strand, s, e, gene from pr where strand = r_strand),
 gd as (select gg.tx_id, gg.strand, min({'far': abs(r.s - gg.s), 'd': r.s - gg.s}).d as ds, min({'far': abs(gg.e - r.e), 'd': gg.e - r.e}).d as de
   from gg join rf r on r.gene_id = gg.gene and r.chrom = gg.chrom and r.strand = gg.strand group by gg.tx_id, gg.strand)
 select tx_id, case when strand = '-' then de else ds end as diff_to_gene_tss, case when strand = '-' then ds else de end as diff_to_gene_tes from gd""")
def gene_endpoint_diffs(spark, d):
    return C.gene_endpoint_diffs(*_tables(spark, d)).select("tx_id", "diff_to_gene_tss", "diff_to_gene_tes")


def _classified(spark, d):
    return C.classify(*_sides(spark, d))


_COLUMNS = ["tx_id", "query_length", "query_exon_n", "structural_category", "subcategory", "ref_gene_id", "ref_tx_id", "ref_length", "ref_exon_n", "ref_strand", "diff_to_tss", "diff_to_tes", "matched_junctions", "matched_exons", "all_canonical"]


@query("classify_full", _FULL + " select tx_id, cast(query_length as int) as query_length, query_exon_n, structural_category, subcategory, ref_gene_id, ref_tx_id, cast(ref_length as int) as ref_length, ref_exon_n, ref_strand, cast(diff_to_tss as int) as diff_to_tss, cast(diff_to_tes as int) as diff_to_tes, matched_junctions, matched_exons, all_canonical from fin")
def classify_full(spark, d):
    return _classified(spark, d).select(*_COLUMNS)


@query("classify_stats", _FULL + " select structural_category, subcategory, count(*) as tx_cnt, cast(grouping_id(structural_category, subcategory) as int) as level from fin group by rollup (structural_category, subcategory)")
def classify_stats(spark, d):
    return C.classify_stats(_classified(spark, d))


_CAGE = f""", {A.GUIDE_CTE}, q as (select tx_id, chrom, strand, tss, case when strand = '-' then tss else tss - 1 end as q0 from tx where source_file_id > 0),
 c as (select q.tx_id, gs, start0 <= q.tss - (case when q.strand = '-' then 0 else 0 end) and start0 <= q.tss and q.tss <= ge as within_peak, case when q.strand = '-' then -1 else 1 end * ((case when ge - start0 > 1 then (start0 + ge) // 2 + 1 else start0 end) - q.tss) as dist
   from q join guides g on g.chrom = q.chrom and g.strand = q.strand and start0 < q0 + 10000 and ge > q0 - 10000 and not (q.strand = '+' and start0 > q.tss) and not (q.strand = '-' and ge < q.tss)),
 k as (select *, row_number() over (partition by tx_id order by within_peak desc, abs(dist), gs, dist) as k from c)
 select tx.tx_id, coalesce(within_peak, false) as within_peak, cast(dist as int) as dist from tx left join k on k.tx_id = tx.tx_id and k = 1 where source_file_id > 0"""


@query("nearest_cage", _CAGE)
def nearest_cage(spark, d):
    return context.cage_peaks(_sides(spark, d)[0], A.guides(spark, d), 10000).select("tx_id", F.col("within_cage_peak").alias("within_peak"), F.col("dist_to_cage_peak").alias("dist"))


_POLYA = f""", {A.GUIDE_CTE}, q as (select tx_id, chrom, strand, case when strand = '-' then tes - 1 else tes end as q0 from tx where source_file_id > 0),
 c as (select q.tx_id, gs, case when q.strand = '-' then start0 < q0 and q0 <= ge else start0 <= q0 and q0 < ge end as w, case when q.strand = '-' then q0 - ge else start0 - q0 end as dist
   from q join guides g on g.chrom = q.chrom and g.strand = q.strand and start0 < q0 + 100 and ge > q0 - 100),
 k as (select tx_id, bool_or(w) as w, arg_min(dist, abs(dist) * 10000000000 + gs * 2 + case when dist < 0 then 0 else 1 end) as dist from c group by tx_id)
 select tx.tx_id, coalesce(w, false) as within_peak, cast(dist as int) as dist from tx left join k on k.tx_id = tx.tx_id where source_file_id > 0"""


@query("nearest_polya", _POLYA)
def nearest_polya(spark, d):
    return context.polya_peaks(_sides(spark, d)[0], A.guides(spark, d), 100).select("tx_id", F.col("within_poly_a_peak").alias("within_peak"), F.col("dist_to_poly_a_site").alias("dist"))


_RC = "reverse(translate(upper(seq), 'ACGT', 'TGCA'))"
_BASES = f"(select string_agg(substr('{A.GENOME}', cast((p * p + 3 * p) % 16 as int) + 1, 1), '' order by p) from range(cast({{lo}} as bigint), cast({{hi}} as bigint)) t(p))"
_DOWN = f""", w as (select tx_id, strand, case when strand = '-' then {_BASES.format(lo='tes - 20', hi='tes')} else {_BASES.format(lo='tes', hi='tes + 20')} end as seq from tx where source_file_id > 0 and strand <> '.'),
 o as (select tx_id, case when strand = '-' then {_RC} else seq end as seq from w)
 select q.tx_id, seq as seq_a_downstream_tts, cast(len(regexp_replace(seq, '[^Aa]', '', 'g')) * 100.0 / 20 as float) as perc_a_downstream_tts from tx q left join o using (tx_id) where source_file_id > 0"""


@query("downstream_a", _DOWN)
def downstream_a(spark, d):
    q = _sides(spark, d)[0]
    w = context.downstream_window(q, 20, F.lit(A.LENGTH))
    return context.downstream_context(w.withColumn("seq", F.when(F.col("win_lo").isNotNull(), A.genome(F.col("win_lo"), F.col("win_hi")))), 20).select("tx_id", "seq_a_downstream_tts", "perc_a_downstream_tts")


_MOTIF_SQL = "list_filter([" + ", ".join(f"'{m}'" for m in T.POLYA_MOTIFS) + "], lambda m: contains(seq, m))[1]"
_UP = f""", w as (select tx_id, strand, case when strand = '-' then {_BASES.format(lo='tes', hi='tes + 50')} else {_BASES.format(lo='tes - 50', hi='tes')} end as seq from tx where source_file_id > 0 and strand <> '.'),
 o as (select tx_id, case when strand = '-' then {_RC} else seq end as seq from w)
 select q.tx_id, {_MOTIF_SQL} as poly_a_motif, cast(instr(seq, {_MOTIF_SQL}) - 1 + 6 - 50 as int) as poly_a_dist from tx q left join o using (tx_id) where source_file_id > 0"""


@query("polya_motif", _UP)
def polya_motif(spark, d):
    q = _sides(spark, d)[0]
    w = context.upstream_window(q, 50, F.lit(A.LENGTH))
    return context.motif_context(w.withColumn("seq", F.when(F.col("win_lo").isNotNull(), A.genome(F.col("win_lo"), F.col("win_hi"))))).select("tx_id", "poly_a_motif", "poly_a_dist")


def queries():
    return _QUERIES


def oracle_sql():
    return _SQL
