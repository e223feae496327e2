"""The queries over the test tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.functions import transcript as T
from spliceloom.operators import assemble, islands, merge
from spliceloom.plans import adapter as A
from spliceloom.plans import merge_sql as M
from spliceloom.plans import roster_classify, roster_tools
from spliceloom.session import written

O = merge.MergeOptions()
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its twin over the adapter's CTEs."""

    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = f"with recursive {A.CTE} {sql}" if sql.lstrip().startswith(",") else f"with {A.CTE} {sql}"
        return f

    return keep


def _chain(c: str = "junctions"):
    return T.chain_text(F.col(c))


@query("tx_from_exons", "select tx_id, source_file_id, chrom, s as start, e as \"end\", strand, n_exons, gene_id, chain, cast(len as int) as tx_len, tx_type, tss, tes from tx")
def tx_from_exons(spark, d):
    c = F.col
    return A.transcripts(spark, d).select(
        "tx_id", "source_file_id", "chrom", "start", "end", "strand", "n_exons", "gene_id", _chain().alias("chain"), T.transcript_len(c("exons")).alias("tx_len"), "tx_type",
        T.tss(c("strand"), c("start"), c("end")).alias("tss"), T.tes(c("strand"), c("start"), c("end")).alias("tes"),
    )


@query("junction_explode", "select tx_id, cast(pos as int) as pos, l, r from jn")
def junction_explode(spark, d):
    return A.transcripts(spark, d).select("tx_id", F.posexplode("junctions").alias("pos", "j")).select("tx_id", "pos", "j.l", "j.r")


@query("exon_roundtrip", """, ok as (select tx_id, bool_and(l < r and coalesce(r <= nxt, true)) as valid from (select *, lead(l) over (partition by tx_id order by pos) as nxt from jn) group by tx_id)
 select tx_id, string_agg(exon_start || '-' || exon_end, ',' order by exon_start) as exon_text, coalesce(any_value(valid), true) as valid from exons left join ok using (tx_id) group by tx_id""")
def exon_roundtrip(spark, d):
    back = T.exons_of(F.col("start"), F.col("end"), F.col("junctions"))
    text = F.array_join(F.transform(back, lambda e: F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string"))), ",")
    return A.transcripts(spark, d).select("tx_id", text.alias("exon_text"), T.junctions_valid(F.col("junctions")).alias("valid"))


@query("tx_stats", """select count(*) as tx_cnt, count(distinct gene_id) as gene_cnt, count(*) filter (strand = '+') as plus_cnt, count(*) filter (strand = '-') as minus_cnt,
  count(*) filter (strand = '.') as unstranded_cnt, count(*) filter (tx_type = 'MONO') as mono_cnt, count(*) filter (tx_type = 'ALL_CA') as all_ca_cnt,
  count(*) filter (tx_type = 'PRT_CA') as prt_ca_cnt, count(*) filter (tx_type = 'NOT_CA') as not_ca_cnt, (select count(*) from jn) as junction_cnt from tx""")
def tx_stats(spark, d):
    return assemble.index_stats(A.transcripts(spark, d))


def _stored(spark, d):
    """The transcripts as a table, like an index."""
    return written(A.transcripts(spark, d), "transcripts")


def _islands(spark, d):
    return islands.with_islands(_stored(spark, d), bin_size=1 << 16)


@query("super_clusters", "select chrom, island, max(e) as island_end, count(*) as tx_cnt from isl group by chrom, island")
def super_clusters(spark, d):
    return islands.island_table(A.transcripts(spark, d), bin_size=1 << 16)


@query("junction_clusters", "select chrom, island, strand, n_exons, count(*) as tx_cnt, count(distinct chain) as chain_cnt from isl group by chrom, island, strand, n_exons")
def junction_clusters(spark, d):
    return _islands(spark, d).groupBy("chrom", "island", "strand", "n_exons").agg(F.count("*").alias("tx_cnt"), F.countDistinct(_chain()).alias("chain_cnt"))


def _stranded(spark, d):
    return _islands(spark, d).filter("n_exons > 1 and strand <> '.'")


#: Members of exact chains as groups, for the representative queries.
_EXACT = ", g as (select *, concat_ws('|', chrom, island, strand, chain) as gkey from isl where n_exons > 1 and strand <> '.')"
_MODE = """(select gkey, pos, n, lag(n) over (partition by gkey order by n desc, pos) as before, row_number() over (partition by gkey order by n desc, pos) as k from (
   select gkey, {side} as pos, count(*) as n from {g} group by gkey, {side}))"""


@query("merge_exact_chain", _EXACT + f""", m1 as {_MODE.format(side='tss', g='g')}, m2 as {_MODE.format(side='tes', g='g')},
 r as (select gkey, max(chrom) chrom, max(strand) strand, max(chain) as chain, count(*) as tx_count, min(s) as s0, max(s) as s1, min(e) as e0, max(e) as e1 from g group by gkey),
 a as (select a.gkey, a.pos, coalesce(b.n = a.n, false) as tie from m1 a left join m1 b on a.gkey = b.gkey and b.k = 2 where a.k = 1),
 b as (select a.gkey, a.pos, coalesce(b.n = a.n, false) as tie from m2 a left join m2 b on a.gkey = b.gkey and b.k = 2 where a.k = 1)
 select r.chrom, r.strand, chain, tx_count, case when a.tie then case when strand = '-' then e1 else s0 end else a.pos end as repr_tss,
   case when b.tie then case when strand = '-' then s0 else e1 end else b.pos end as repr_tes, case when a.tie then 'longer' else 'major' end as tss_policy, case when b.tie then 'longer' else 'major' end as tes_policy
 from r join a using (gkey) join b using (gkey)""")
def merge_exact_chain(spark, d):
    return _exact_chain(_stranded(spark, d))


def _exact_chain(tx: DataFrame) -> DataFrame:
    """Groups of equal chains with major representatives: the merge without wobble, splits or guides."""
    c = F.col
    m = tx.withColumn("gkey", F.concat_ws("|", "chrom", c("island").cast("string"), "strand", _chain()))
    m = m.withColumn("tss", T.tss(c("strand"), c("start"), c("end"))).withColumn("tes", T.tes(c("strand"), c("start"), c("end")))
    base = m.groupBy("gkey").agg(F.first("chrom").alias("chrom"), F.first("strand").alias("strand"), F.first(_chain()).alias("chain"), F.count("*").alias("tx_count"))
    return base.join(merge.repr_terminal(m, "tss"), "gkey").join(merge.repr_terminal(m, "tes"), "gkey").select("chrom", "strand", "chain", "tx_count", "repr_tss", "repr_tes", "tss_policy", "tes_policy")


_PAIRS = """, c as (select distinct chrom, island, strand, n_exons, chain, jl, concat_ws('|', chrom, island, strand, chain) as node from isl where n_exons > 1),
 p as (select a.node as node_a, b.node as node_b from c a join c b on a.chrom = b.chrom and a.island = b.island and a.strand = b.strand and a.n_exons = b.n_exons and a.node < b.node
   and abs(a.jl[1].l - b.jl[1].l) <= 3 and len(list_filter(list_zip(a.jl, b.jl), lambda z: abs(z[1].l - z[2].l) > 3 or abs(z[1].r - z[2].r) > 3)) = 0)"""


@query("wobble_pairs_d3a3", _PAIRS + " select node_a, node_b from p")
def wobble_pairs_d3a3(spark, d):
    return merge.wobble_pairs(merge.chain_table(_islands(spark, d).filter("n_exons > 1")), 3, 3, 3).select("node_a", "node_b")


_COMPONENTS = """, sym as (select node_a a, node_b b from p union select node_b, node_a from p),
 reach(a, b) as (select a, b from sym union select reach.a, sym.b from reach join sym on reach.b = sym.a), comp as (select a as node, least(a, min(b)) as component from reach group by a)"""


@query("wobble_components", _PAIRS + _COMPONENTS + " select tx_id, coalesce(component, concat_ws('|', chrom, island, strand, chain)) as root from isl left join comp on node = concat_ws('|', chrom, island, strand, chain) where n_exons > 1")
def wobble_components(spark, d):
    return merge.chain_components(_islands(spark, d).filter("n_exons > 1"), 3, 3, 3).select("tx_id", "root")


_MONO = """, m as (select distinct chrom, island, strand, s, e, concat_ws('|', chrom, island, strand, s, e) as node from isl where n_exons = 1),
 p as (select a.node as node_a, b.node as node_b from m a join m b on a.chrom = b.chrom and a.island = b.island and a.strand = b.strand and a.node < b.node and a.s <= b.e and b.s <= a.e
   and least((least(a.e, b.e) - greatest(a.s, b.s) + 1)::double / (a.e - a.s + 1), (least(a.e, b.e) - greatest(a.s, b.s) + 1)::double / (b.e - b.s + 1)) >= 0.9)"""


@query("mono_overlap_pairs", _MONO + " select node_a, node_b from p")
def mono_overlap_pairs(spark, d):
    return merge.mono_pairs(_islands(spark, d).filter("n_exons = 1"), 0.9)


@query("mono_components", _MONO + _COMPONENTS + " select tx_id, coalesce(component, concat_ws('|', chrom, island, strand, s, e)) as root from isl left join comp on node = concat_ws('|', chrom, island, strand, s, e) where n_exons = 1")
def mono_components(spark, d):
    return merge.mono_components(_islands(spark, d).filter("n_exons = 1"), 0.9).select("tx_id", "root")


_SPLIT = """, o as (select chrom, strand, island, tx_id, tss, tes, row_number() over (partition by chrom, strand, island order by tss, tes, tx_id) as k from isl),
 walk(chrom, strand, island, k, tx_id, asx, aex) as (select chrom, strand, island, k, tx_id, tss, tes from o where k = 1 union all
   select o.chrom, o.strand, o.island, o.k, o.tx_id, case when {stay} then walk.asx else o.tss end, case when {stay} then walk.aex else o.tes end
   from walk join o on o.chrom = walk.chrom and o.strand = walk.strand and o.island = walk.island and o.k = walk.k + 1)
 select tx_id, asx as a_tss, aex as a_tes from walk"""
_STAY = {"tss": "abs(o.tss - walk.asx) <= 50", "tes": "abs(o.tes - walk.aex) <= 50", "both": "abs(o.tss - walk.asx) <= 50 and abs(o.tes - walk.aex) <= 50"}


def _split(mode):
    def run(spark, d):
        return merge.anchor_split(_islands(spark, d), ["chrom", "strand", "island"], mode, 50, 50).select("tx_id", "a_tss", "a_tes")

    return run


for _m, _s in _STAY.items():
    query(f"terminal_anchor_split_{_m}", _SPLIT.replace("{stay}", _s))(_split(_m))

#: Groups of one cluster of the island, for representatives over differing junctions.
_CLUSTERS = ", g as (select *, concat_ws('|', chrom, island, strand, n_exons) as gkey from isl where n_exons > 1 and strand <> '.')"


def _clusters(spark, d):
    c = F.col
    m = _stranded(spark, d).withColumn("gkey", F.concat_ws("|", "chrom", c("island").cast("string"), "strand", c("n_exons").cast("string")))
    return m.withColumn("tss", T.tss(c("strand"), c("start"), c("end"))).withColumn("tes", T.tes(c("strand"), c("start"), c("end")))


_RJ = _CLUSTERS + """, q as (select gkey, pos, l, r, count(*) as n from g join (select tx_id, pos, l, r from jn) using (tx_id) group by gkey, pos, l, r),
 k as (select gkey, pos, max(l) in_l, min(r) in_r, min(l) out_l, max(r) out_r, max(n) top from q group by gkey, pos),
 f as (select k.*, count(*) as ties, min(q.l) as ml, min(q.r) as mr from k join q on q.gkey = k.gkey and q.pos = k.pos and q.n = k.top group by all),
 x as (select gkey, pos, {l} as l, {r} as r, {fell} as fell from f)
 select gkey, string_agg(l || '-' || r, ',' order by pos) as repr_chain, case when bool_or(fell) then 'longer' else '{policy}' end as junction_policy from x group by gkey"""


def _repr_j(policy):
    def run(spark, d):
        return merge.repr_junctions(_clusters(spark, d), policy).select("gkey", _chain("repr_junctions").alias("repr_chain"), "junction_policy")

    return run


for _p, _l, _r, _f in (("major", "case when ties = 1 then ml else in_l end", "case when ties = 1 then mr else in_r end", "ties > 1"), ("longer", "in_l", "in_r", "false"), ("shorter", "out_l", "out_r", "false")):
    query(f"repr_junction_{_p}", _RJ.replace("{l}", _l).replace("{r}", _r).replace("{fell}", _f).replace("{policy}", _p))(_repr_j(_p))

@query("junction_ranges", _CLUSTERS + " select gkey, cast(pos as int) as pos, min(l) as l_min, max(l) as l_max, min(r) as r_min, max(r) as r_max from g join (select tx_id, pos, l, r from jn) using (tx_id) group by gkey, pos")
def junction_ranges(spark, d):
    return merge.junction_ranges(_clusters(spark, d))


@query("chrom_names", "select tx_id, replace(chrom, 'chr', '') as bare, chrom as padded from tx")
def chrom_names(spark, d):
    bare = T.without_chr(F.col("chrom"))
    return A.transcripts(spark, d).select("tx_id", bare.alias("bare"), T.with_chr(bare).alias("padded"))


_RT = _CLUSTERS + """, q as (select gkey, strand, {side} as pos, count(*) as n{hit} from g {join} group by gkey, strand, {side}{hit2}),
 b as (select gkey, max(hits) as best from q group by gkey), k as (select q.* , best from q join b using (gkey) where best = 0 or hits = best),
 f as (select gkey, any_value(strand) as strand, any_value(best) as best, count(*) as kinds, min(pos) as lo, max(pos) as hi, max(n) as top from k group by gkey),
 t as (select f.*, count(*) as ties, min(k.pos) as mode from f join k on k.gkey = f.gkey and k.n = f.top group by all),
 v as (select *, case when (strand = '-') = {is_tes} then lo else hi end as longer, case when (strand = '-') = {is_tes} then hi else lo end as shorter from t)
 select gkey, {value} as repr_{side}, {name} as {side}_policy from v"""


def _rt(side, value, name, guided=False):
    s = _RT.replace("{value}", value).replace("{name}", name).replace("{is_tes}", "true" if side == "tes" else "false")
    hit = ", coalesce(hits, 0) as hits" if guided else ", 0 as hits"
    join = f"left join gh on gh.chrom = g.chrom and gh.strand = g.strand and gh.pos = g.{side}" if guided else ""
    s = s.replace("{hit}", hit).replace("{join}", join).replace("{hit2}", ", hits" if guided else "").replace("{side}", side)
    return s.replace("select gkey, strand, " + side, "select gkey, g.strand, " + side).replace("group by gkey, strand, " + side, "group by gkey, g.strand, " + side)


def _repr_t(side, policy):
    def run(spark, d):
        return merge.repr_terminal(_clusters(spark, d), side, policy)

    return run


for _side in ("tss", "tes"):
    for _p, _v, _n in (("major", "case when ties > 1 then longer else mode end", "case when ties > 1 then 'longer' else 'major' end"), ("longer", "longer", "'longer'"), ("shorter", "shorter", "'shorter'")):
        query(f"repr_{_side}_{_p}", _rt(_side, _v, _n))(_repr_t(_side, _p))

_GH = f", {A.GUIDE_CTE}, gh as (select t.chrom, t.strand, t.pos, count(*) as hits from (select distinct chrom, strand, tss as pos from tx) t join guides on guides.chrom = t.chrom and guides.strand = t.strand and greatest(t.pos - 10, 0) <= ge and gs <= t.pos + 10 group by t.chrom, t.strand, t.pos)"


def _tss_hits(spark, d):
    c = F.col
    points = A.transcripts(spark, d).select("chrom", "strand", T.tss(c("strand"), c("start"), c("end")).alias("pos"))
    return merge.guide_hits(points, A.guides(spark, d), 10)


@query("guide_hits", _GH + " select chrom, strand, pos, hits from gh")
def guide_hits(spark, d):
    return _tss_hits(spark, d)


@query("repr_tss_guided", _GH + _rt("tss", "case when ties > 1 then longer else mode end", "case when best > 0 and kinds = 1 then 'guide_definitive' when best > 0 and ties = 1 then 'guide_majority' when best > 0 then 'guide_longer' when ties > 1 then 'longer' else 'major' end", True))
def repr_tss_guided(spark, d):
    return merge.repr_terminal(_clusters(spark, d), "tss", "major", _tss_hits(spark, d))


_ALIAS = "select concat('chr', n_nationkey % 7 + 1) as primary_name, min(concat('chr', n_nationkey % 3 + 1)) as secondary from nation group by 1"


@query("chrom_alias_resolve", f""", {A.GUIDE_CTE}, al as ({_ALIAS}), have as (select distinct chrom, strand from guides where chrom <> 'chr2')
 select t.chrom, t.strand, coalesce(have.chrom, al.secondary) as guide_chrom from (select distinct chrom, strand from tx) t left join have on have.chrom = t.chrom and have.strand = t.strand left join al on al.primary_name = t.chrom""")
def chrom_alias_resolve(spark, d):
    n = A.table(spark, d, "nation")
    alias = n.groupBy(F.concat(F.lit("chr"), (F.col("n_nationkey") % 7 + 1).cast("string")).alias("primary")).agg(F.min(F.concat(F.lit("chr"), (F.col("n_nationkey") % 3 + 1).cast("string"))).alias("secondary"))
    return merge.guide_key(A.transcripts(spark, d), A.guides(spark, d).filter("chrom <> 'chr2'"), alias)


_ABSORB = """, gr as (select chrom, island, strand, n_exons, chain as gkey, any_value(jl) as jl, min(jl[1].l) as o1, min(jl[1].r) as o2 from isl where tx_type = 'ALL_CA' group by chrom, island, strand, n_exons, chain),
 cand as (select x.tx_id, g.gkey, row_number() over (partition by x.tx_id order by list_sum(list_transform(list_zip(x.jl, g.jl), lambda z: abs(z[1].l - z[2].l) + abs(z[1].r - z[2].r))), o1, o2, g.gkey) as k
   from isl x join gr g on g.chrom = x.chrom and g.island = x.island and g.strand = x.strand and g.n_exons = x.n_exons and abs(x.jl[1].l - g.jl[1].l) <= 3
   and len(list_filter(list_zip(x.jl, g.jl), lambda z: abs(z[1].l - z[2].l) > 3 or abs(z[1].r - z[2].r) > 3)) = 0 where x.tx_type in ('PRT_CA', 'NOT_CA'))"""


@query("nc_absorption", _ABSORB + " select tx_id, gkey from cand where k = 1")
def nc_absorption(spark, d):
    tx = _islands(spark, d)
    j = F.col("junctions")[0]
    groups = tx.filter("tx_type = 'ALL_CA'").groupBy("chrom", "island", "strand", "n_exons", _chain().alias("gkey")).agg(F.first("junctions").alias("repr_junctions"), F.min(F.struct(j["l"].alias("l"), j["r"].alias("r"))).alias("g_order"))
    return merge.absorption(tx.filter("tx_type in ('PRT_CA', 'NOT_CA')"), groups, O).select("tx_id", "gkey")


def _merged(spark, d, options=O, **guides):
    g, m = merge.merge(_stored(spark, d), options, **guides)
    return merge.with_ids(g, m), m


def _shown(groups: DataFrame) -> DataFrame:
    return groups.select("merged_tx_id", "merged_gene_id", "chrom", "strand", "n_exons", "repr_start", "repr_end", _chain("repr_junctions").alias("repr_chain"), "junction_policy", "tss_policy", "tes_policy", "tx_count")


def _guide_cte(*sides: str) -> str:
    """hit_<side>: guide intervals within 10 bases of each transcript end."""
    one = "hit_{s} as (select t.chrom, t.strand, t.pos, count(*) as hits from (select distinct chrom, strand, {s} as pos from tx) t join guides on guides.chrom = t.chrom and guides.strand = t.strand and greatest(t.pos - 10, 0) <= ge and gs <= t.pos + 10 group by t.chrom, t.strand, t.pos)"
    return f", {A.GUIDE_CTE}, " + ", ".join(one.replace("{s}", s) for s in sides)


@query("merge_default", M.merge_cte() + M.GROUPS)
def merge_default(spark, d):
    return _shown(_merged(spark, d)[0])


@query("merge_guided", _guide_cte("tss") + M.merge_cte(guided=("tss",)) + M.STATS)
def merge_guided(spark, d):
    return merge.merge_stats(*_merged(spark, d, guide_tss=A.guides(spark, d)))


@query("merge_guided_both", _guide_cte("tss", "tes") + M.merge_cte(guided=("tss", "tes")) + M.GROUPS)
def merge_guided_both(spark, d):
    g = A.guides(spark, d)
    return _shown(_merged(spark, d, guide_tss=g, guide_tes=g)[0])


@query("merge_unsplit", M.merge_cte("none") + M.GROUPS)
def merge_unsplit(spark, d):
    return _shown(_merged(spark, d, replace(O, terminal_refine="none", terminal_refine_nc="none"))[0])


@query("merge_track", M.merge_cte() + M.TRACK)
def merge_track(spark, d):
    return merge.track(*_merged(spark, d))


@query("present_absent", M.merge_cte() + M.PRESENT)
def present_absent(spark, d):
    return merge.present_absent(merge.track(*_merged(spark, d)), [0, 1, 2, 3])


@query("merge_size_histogram", M.merge_cte() + M.HISTOGRAM)
def merge_size_histogram(spark, d):
    return merge.group_size_histogram(_merged(spark, d)[0])


_DIFFS = """, gr as (select chrom, island, strand, n_exons, first(jl order by source_file_id, tx_id) as gj from isl where n_exons > 1 group by all)
 select tx_id, cast(list_sum(list_transform(list_zip(jl, gj), lambda z: abs(case when strand = '-' then z[1].r - z[2].r else z[1].l - z[2].l end))) as int) as donor_diff,
  cast(list_sum(list_transform(list_zip(jl, gj), lambda z: abs(case when strand = '-' then z[1].l - z[2].l else z[1].r - z[2].r end))) as int) as acceptor_diff,
  coalesce((select string_agg('(' || i || ',' || (gj[i].l - jl[i].l) || ',' || (gj[i].r - jl[i].r) || ')', ',' order by i) from range(1, len(jl) + 1) q(i) where gj[i].l > jl[i].l or gj[i].r > jl[i].r), 'no_diff') as exon_diff
 from isl join gr using (chrom, island, strand, n_exons)"""


@query("junction_and_exon_diffs", _DIFFS)
def junction_and_exon_diffs(spark, d):
    tx = _islands(spark, d).filter("n_exons > 1")
    keys = ["chrom", "island", "strand", "n_exons"]
    first = tx.groupBy(*keys).agg(F.min_by("junctions", F.struct("source_file_id", "tx_id")).alias("gj"))
    dd, ad = T.junction_diffs(F.col("strand"), F.col("junctions"), F.col("gj"))
    return tx.join(first, keys).select("tx_id", dd.alias("donor_diff"), ad.alias("acceptor_diff"), T.exon_diff_text(F.col("junctions"), F.col("gj")).alias("exon_diff"))


def queries():
    return _QUERIES | roster_classify.queries() | roster_tools.queries()


def oracle_sql():
    return _SQL | roster_classify.oracle_sql() | roster_tools.oracle_sql()
