"""The merge as DuckDB SQL over the adapter's CTEs: one long WITH clause, ending in the tables ``grp`` and ``mem``."""

from __future__ import annotations

CLUSTER = "chrom, island, strand, n_exons"
_SAME = " and ".join(f"a.{c.strip()} = b.{c.strip()}" for c in CLUSTER.split(","))
_CLOSE = "len(list_filter(list_zip(a.jl, b.jl), lambda z: abs(z[1].l - z[2].l) > 3 or abs(z[1].r - z[2].r) > 3)) = 0"


def _components(tag: str, nodes: str) -> str:
    """k<tag>(node, component) from pairs p<tag>; ``nodes`` makes n<tag> and p<tag>."""
    return f"""{nodes}, s_{tag} as (select node_a a, node_b b from p_{tag} union select node_b, node_a from p_{tag}),
 r_{tag}(a, b) as (select a, b from s_{tag} union select r.a, s.b from r_{tag} r join s_{tag} s on r.b = s.a), k_{tag} as (select a as node, least(a, min(b)) as component from r_{tag} group by a)"""


def _chains(tag: str, rows: str) -> str:
    return _components(tag, f""", n_{tag} as (select distinct {CLUSTER}, jl, concat_ws('|', chrom, island, strand, chain) as node from {rows}),
 p_{tag} as (select a.node as node_a, b.node as node_b from n_{tag} a join n_{tag} b on {_SAME} and a.node < b.node and abs(a.jl[1].l - b.jl[1].l) <= 3 and {_CLOSE})""")


def _split(tag: str, letter: str, rows: str, refine: str) -> str:
    """g<tag>: the rows with a_tss, a_tes and gkey."""
    keys = f"{CLUSTER}, root"
    key = f"concat_ws('|', '{letter}', n_exons, root, a_tss, a_tes) as gkey"
    if refine == "none":
        return f", g_{tag} as (select *, {key} from (select *, 0 as a_tss, 0 as a_tes from {rows}))"
    stay = {"both": "abs(o.tss - w.a_tss) <= 50 and abs(o.tes - w.a_tes) <= 50"}[refine]
    same = " and ".join(f"o.{c.strip()} = w.{c.strip()}" for c in keys.split(","))
    return f""", o_{tag} as (select *, row_number() over (partition by {keys} order by tss, tes) as k from (select distinct {keys}, tss, tes from {rows})),
 w_{tag}({keys}, tss, tes, k, a_tss, a_tes) as (select *, tss, tes from o_{tag} where k = 1 union all
   select o.*, case when {stay} then w.a_tss else o.tss end, case when {stay} then w.a_tes else o.tes end from w_{tag} w join o_{tag} o on {same} and o.k = w.k + 1),
 g_{tag} as (select *, {key} from {rows} join (select {keys}, tss, tes, a_tss, a_tes from w_{tag}) using ({keys}, tss, tes))"""


def _terminal(tag: str, side: str, rows: str, guided: bool) -> str:
    """t<tag>(gkey, pos, policy): the major terminal, or the one that guides prefer."""
    hits = f"left join hit_{side} h on h.chrom = g.chrom and h.strand = g.strand and h.pos = g.{side}" if guided else ""
    n_hits = "coalesce(any_value(h.hits), 0)" if guided else "0"
    low = "strand = '-'" if side == "tes" else "strand <> '-'"
    return f""", q_{tag} as (select gkey, any_value(g.strand) as strand, g.{side} as pos, count(*) as n, {n_hits} as hits from {rows} g {hits} group by gkey, g.{side}),
 b_{tag} as (select *, max(hits) over (partition by gkey) as best from q_{tag}), x_{tag} as (select * from b_{tag} where best = 0 or hits = best),
 f_{tag} as (select *, max(n) over (partition by gkey) as top from x_{tag}),
 v_{tag} as (select gkey, any_value(strand) as strand, any_value(best) as best, count(*) as kinds, min(pos) as lo, max(pos) as hi, count(*) filter (n = top) as ties, min(pos) filter (n = top) as mode from f_{tag} group by gkey),
 t_{tag} as (select gkey, case when ties > 1 then case when {low} then lo else hi end else mode end as pos,
   case when best > 0 and kinds = 1 then 'guide_definitive' when best > 0 and ties = 1 then 'guide_majority' when best > 0 then 'guide_longer' when ties > 1 then 'longer' else 'major' end as policy from v_{tag})"""


def _junctions(tag: str, rows: str) -> str:
    """j<tag>(gkey, rjl, policy): the major junctions."""
    return f""", ju_{tag} as (select gkey, pos, j.l as l, j.r as r, count(*) as n from (select gkey, generate_subscripts(jl, 1) as pos, unnest(jl) as j from {rows}) group by all),
 jm_{tag} as (select *, max(n) over (partition by gkey, pos) as top from ju_{tag}),
 jp_{tag} as (select gkey, pos, count(*) filter (n = top) as ties, case when count(*) filter (n = top) = 1 then min(l) filter (n = top) else max(l) end as l, case when count(*) filter (n = top) = 1 then min(r) filter (n = top) else min(r) end as r from jm_{tag} group by gkey, pos),
 j_{tag} as (select gkey, list({{'l': l, 'r': r}} order by pos) as rjl, case when bool_or(ties > 1) then 'longer' else 'major' end as policy from jp_{tag} group by gkey)"""


def merge_cte(refine: str = "both", guided: tuple[str, ...] = ()) -> str:
    """CTEs up to ``grp`` (groups with ids) and ``mem`` (gkey of every transcript); for guided sides hit_<side>(chrom, strand, pos, hits) must come before."""
    first = "min({'l': jl[1].l, 'r': jl[1].r, 's': s, 'e': e, 'f': source_file_id, 't': tx_id})"
    one = "concat_ws('|', chrom, island, strand, chain)"
    span = "concat_ws('|', chrom, island, strand, s, e)"
    mono = _components("m", f""", n_m as (select distinct chrom, island, strand, s, e, {span} as node from isl where n_exons = 1),
 p_m as (select a.node as node_a, b.node as node_b from n_m a join n_m b on a.chrom = b.chrom and a.island = b.island and a.strand = b.strand and a.node < b.node and a.s <= b.e and b.s <= a.e
   and least((least(a.e, b.e) - greatest(a.s, b.s) + 1)::double / (a.e - a.s + 1), (least(a.e, b.e) - greatest(a.s, b.s) + 1)::double / (b.e - b.s + 1)) >= 0.9)""")
    out = ", ca as (select * from isl where n_exons > 1 and tx_type = 'ALL_CA'), nc as (select * from isl where n_exons > 1 and tx_type <> 'ALL_CA'), cu as (select * from ca where strand = '.')"
    out += _chains("u", "cu") + f", cm as (select ca.*, coalesce(component, {one}) as root from ca left join k_u on node = {one})" + _split("c", "c", "cm", refine)
    out += _terminal("cs", "tss", "g_c", "tss" in guided) + _terminal("ce", "tes", "g_c", "tes" in guided) + _junctions("c", "g_c")
    out += f""", rc as (select {CLUSTER}, root, {first} as r_order from g_c group by all),
 cg as (select distinct {CLUSTER}, gkey, r_order, a_tss, a_tes, rjl from g_c join rc using ({CLUSTER}, root) join j_c using (gkey)),
 ab as (select a.source_file_id, a.tx_id, b.gkey, row_number() over (partition by a.source_file_id, a.tx_id
     order by list_sum(list_transform(list_zip(a.jl, b.rjl), lambda z: abs(z[1].l - z[2].l) + abs(z[1].r - z[2].r))), b.r_order, b.a_tss, b.a_tes, b.gkey) as k
   from nc a join cg b on {_SAME} and abs(a.jl[1].l - b.rjl[1].l) <= 3 and {_CLOSE.replace("b.jl", "b.rjl")}),
 left_over as (select * from nc anti join ab using (source_file_id, tx_id))"""
    out += _chains("n", "left_over") + f", nn2 as (select x.*, coalesce(component, {one}) as root from left_over x left join k_n on node = {one})" + _split("n", "n", "nn2", refine)
    out += mono + f", mm as (select isl.*, coalesce(component, {span}) as root from isl left join k_m on node = {span} where n_exons = 1)" + _split("m", "m", "mm", "none")
    out += ", rest as (select 1 as kind, * from g_n union all by name select 2 as kind, * from g_m)"
    out += _terminal("rs", "tss", "rest", "tss" in guided) + _terminal("re", "tes", "rest", "tes" in guided) + _junctions("r", "g_n")
    return out + f""", own as (select 0 as kind, * from g_c union all by name select * from rest), roots as (select {CLUSTER}, kind, root, {first} as r_order from own group by all),
 mem as (select source_file_id, tx_id, gkey from own union all select source_file_id, tx_id, gkey from ab where k = 1),
 cnt as (select gkey, count(*) as tx_count from mem group by gkey), files as (select chrom, min(source_file_id) as c_file from isl group by chrom),
 g0 as (select distinct kind, {CLUSTER}, gkey, r_order, a_tss, a_tes, srank from own join roots using ({CLUSTER}, kind, root)),
 ts as (select * from t_cs union all select * from t_rs), te as (select * from t_ce union all select * from t_re), jj as (select * from j_c union all select * from j_r),
 g1 as (select g0.*, tx_count, c_file, ts.policy as tss_policy, te.policy as tes_policy, coalesce(jj.policy, 'NA') as junction_policy, coalesce(rjl, []) as rjl,
     case when strand = '-' then te.pos else ts.pos end as repr_start, case when strand = '-' then ts.pos else te.pos end as repr_end
   from g0 join cnt using (gkey) join files using (chrom) join ts using (gkey) join te using (gkey) left join jj using (gkey)),
 grp as (select *, row_number() over (order by c_file, chrom, island, srank, -n_exons, kind, r_order, a_tss, a_tes, gkey) as tx_no,
     concat('ISOMG_', dense_rank() over (order by c_file, chrom, island)) as merged_gene_id from g1),
 named as (select *, concat('ISOMT_', tx_no) as merged_tx_id, coalesce((select string_agg(x.l || '-' || x.r, ',' order by i) from (select unnest(rjl) as x, generate_subscripts(rjl, 1) as i)), '') as repr_chain from grp)"""


GROUPS = " select merged_tx_id, merged_gene_id, chrom, strand, n_exons, repr_start, repr_end, repr_chain, junction_policy, tss_policy, tes_policy, tx_count from named"
TRACK = """ select tx_no, merged_tx_id, merged_gene_id, g.chrom, repr_start as merged_start, repr_end as merged_end, g.strand as merged_strand, g.n_exons as merged_exon_num, junction_policy, tss_policy, tes_policy,
  tx_count as src_tx_count_in_merged_group, i.source_file_id, i.s as src_start, i.e as src_end, i.tx_id as src_tx_id, i.gene_id as src_gene_id, i.tx_type as src_tx_type,
  cast(coalesce(list_sum(list_transform(list_zip(coalesce(jl, []), rjl), lambda z: abs(case when g.strand = '-' then z[1].r - z[2].r else z[1].l - z[2].l end))), 0) as int) as total_donor_diff,
  cast(coalesce(list_sum(list_transform(list_zip(coalesce(jl, []), rjl), lambda z: abs(case when g.strand = '-' then z[1].l - z[2].l else z[1].r - z[2].r end))), 0) as int) as total_acceptor_diff,
  coalesce((select string_agg('(' || k || ',' || (rjl[k].l - jl[k].l) || ',' || (rjl[k].r - jl[k].r) || ')', ',' order by k) from range(1, len(rjl) + 1) q(k) where rjl[k].l > jl[k].l or rjl[k].r > jl[k].r), 'no_diff') as exon_diff
 from named g join mem using (gkey) join isl i on i.source_file_id = mem.source_file_id and i.tx_id = mem.tx_id"""
PRESENT = " select merged_tx_id, merged_gene_id, n_exons as merged_exon_num, tx_count as src_tx_count_in_merged_group, " + ", ".join(
    f"cast(bool_or(source_file_id = {i}) as int) as file_{i}" for i in range(4)
) + " from named join mem using (gkey) group by all"
HISTOGRAM = " select tx_count as group_size, count(*) as merged_tx_cnt from grp group by tx_count"
STATS = """ select count(*) as merged_tx_cnt, count(*) filter (n_exons > 1) as merged_multi_exons_tx_cnt, count(*) filter (n_exons = 1) as merged_mono_exon_tx_cnt,
  count(*) filter (starts_with(tss_policy, 'guide_')) as tss_guide_cnt, count(*) filter (starts_with(tes_policy, 'guide_')) as tes_guide_cnt,
  floor(count(*) filter (starts_with(tss_policy, 'guide_')) * 100.0::double / count(*) * 10000.0::double + 0.5::double) / 10000.0::double as tss_guide_pct,
  floor(count(*) filter (starts_with(tes_policy, 'guide_')) * 100.0::double / count(*) * 10000.0::double + 0.5::double) / 10000.0::double as tes_guide_pct,
  (select count(*) from mem) as total_tx_cnt, (select count(distinct source_file_id) from mem) as source_files from grp"""
