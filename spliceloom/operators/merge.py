"""Merging transcript sets: fuzzy identity of splice chains, representatives, provenance.

Order of work, all as relations over whole tables: islands, clusters (island, strand, exon
count), components of similar chains, splits by transcript ends, representatives, absorption of
non-canonical transcripts, then what is left of those, and mono-exon groups by overlap.

Orders that decide a result are total: members by first junction, then (start, end, file, tx);
groups by their first member.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.functions import transcript as T
from spliceloom.operators.anchors import anchors
from spliceloom.operators.components import connected_components
from spliceloom.operators.islands import with_islands
from spliceloom.operators.prefixmax import prefix_count
from spliceloom.operators.rangejoin import range_join
from spliceloom.session import written

CLUSTER = ["chrom", "island", "strand", "n_exons"]


@dataclass(frozen=True)
class MergeOptions:
    """Wobbles in bases for donors, acceptors and both sides of unstranded junctions; ``_nc``: for non-canonical transcripts."""

    wob_d: int = 0
    wob_a: int = 0
    wob_u: int = 3
    terminal_refine: str = "both"
    tss_wob: int = 50
    tes_wob: int = 50
    wob_d_nc: int = 3
    wob_a_nc: int = 3
    wob_u_nc: int = 3
    terminal_refine_nc: str = "both"
    tss_wob_nc: int = 50
    tes_wob_nc: int = 50
    mono_ovlp: float = 0.9
    splice_policy: str = "major"
    tss_policy: str = "major"
    tes_policy: str = "major"
    guide_tss_flank: int = 10
    guide_tes_flank: int = 10


def _node() -> Column:
    return F.concat_ws("|", "chrom", F.col("island").cast("string"), "strand", T.chain_text(F.col("junctions")))


def chain_table(tx: DataFrame) -> DataFrame:
    """Distinct chains of each cluster with their ``node`` name and multiplicity."""
    return tx.withColumn("node", _node()).groupBy(*CLUSTER, "node").agg(F.first("junctions").alias("junctions"), F.count("*").alias("copies"))


def blocking_sites(chains: DataFrame, step: int) -> DataFrame:
    """(CLUSTER, pos, side): the place of a chain, junction and side of it, that tells the chains of a cluster apart best.

    Places are cut into steps; the best one has the fewest pairs of chains in one step.
    """
    at = F.flatten(F.transform("junctions", lambda j, i: F.array(F.struct(i.alias("pos"), F.lit("l").alias("side"), F.floor(j["l"] / step).alias("b")), F.struct(i.alias("pos"), F.lit("r").alias("side"), F.floor(j["r"] / step).alias("b")))))
    n = chains.select(*CLUSTER, F.explode(at).alias("x")).groupBy(*CLUSTER, "x.pos", "x.side", "x.b").agg(F.count("*").cast("double").alias("n"))
    cost = n.groupBy(*CLUSTER, "pos", "side").agg(F.sum(F.col("n") * F.col("n")).alias("cost"))
    return cost.groupBy(*CLUSTER).agg(F.min(F.struct("cost", "pos", "side")).alias("m")).select(*CLUSTER, "m.pos", "m.side")


def wobble_candidates(chains: DataFrame, step: int) -> DataFrame:
    """(CLUSTER, n1, j1, n2, j2): chains of a cluster within a step of each other at the cluster's blocking site, each pair once."""
    picked = F.element_at("junctions", F.col("pos") + 1)
    b = F.floor(F.when(F.col("side") == "l", picked["l"]).otherwise(picked["r"]) / step)
    c = chains.join(blocking_sites(chains, step), CLUSTER).select(*CLUSTER, "node", "junctions", b.alias("b"))
    left = c.select(*CLUSTER, F.col("node").alias("n1"), F.col("junctions").alias("j1"), F.col("b").alias("b1"), F.explode(F.array("b", F.col("b") + 1)).alias("b"))
    right = c.select(*CLUSTER, F.col("node").alias("n2"), F.col("junctions").alias("j2"), "b")
    return left.join(right, [*CLUSTER, "b"]).filter((F.col("b1") < F.col("b")) | (F.col("n1") < F.col("n2")))


def wobble_pairs(chains: DataFrame, d: int, a: int, u: int) -> DataFrame:
    """(node_a, node_b) of distinct chains of a cluster that match within the wobbles, node_a < node_b.

    All places of matching chains lie within the wobbles, so any one place may bring them together:
    it is cut into steps as wide as the largest wobble, and a chain meets those of its own and the
    next step.
    """
    near = wobble_candidates(chains, max(d, a, u) + 1).filter(T.wobble_match(F.col("strand"), F.col("j1"), F.col("j2"), d, a, u))
    return near.select(*CLUSTER, F.least("n1", "n2").alias("node_a"), F.greatest("n1", "n2").alias("node_b"))


def chain_components(tx: DataFrame, d: int, a: int, u: int) -> DataFrame:
    """Adds ``root``: the first chain, as text, that wobble matches link a transcript to.

    Where nothing may wobble the chain itself is the component and nothing is compared.
    """
    named = tx.withColumn("node", _node())
    fuzzy = chain_table(tx)
    if d == a == 0:
        fuzzy = fuzzy.filter("strand = '.'")
    parts = connected_components(wobble_pairs(fuzzy, d, a, u), "node_a", "node_b").select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return named.join(parts, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("_c", "node")).drop("_n", "_c", "node")


def anchor_split(members: DataFrame, keys: list[str], mode: str, tss_wob: int, tes_wob: int) -> DataFrame:
    """Adds (a_tss, a_tes): the anchor, the first of its group, of the sorted terminals within a group.

    A transcript starts a group when its terminals leave the wobble around the current anchor.
    Only distinct terminals are walked through.
    """
    with_ends = members.withColumn("tss", T.tss(F.col("strand"), F.col("start"), F.col("end"))).withColumn("tes", T.tes(F.col("strand"), F.col("start"), F.col("end")))
    if mode == "none":
        return with_ends.withColumn("a_tss", F.lit(0)).withColumn("a_tes", F.lit(0))
    walked = anchors(with_ends.select(*keys, "tss", "tes").distinct(), keys, mode, tss_wob, tes_wob)
    return with_ends.join(walked, [*keys, "tss", "tes"])


def repr_junctions(members: DataFrame, policy: str = "major", group: str = "gkey") -> DataFrame:
    """(group, repr_junctions, junction_policy) over all members of each group, junction by junction.

    longer: the pair inside all others, so exons are longest; shorter: the pair around all
    others; major: the most frequent pair, longer where two are as frequent.
    """
    j = members.select(group, F.posexplode("junctions").alias("pos", "j")).groupBy(group, "pos", "j.l", "j.r").agg(F.count("*").alias("n"))
    per = j.groupBy(group, "pos").agg(
        F.max("l").alias("in_l"), F.min("r").alias("in_r"), F.min("l").alias("out_l"), F.max("r").alias("out_r"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "l", "r"))).alias("ranked"),
    )
    top, tie = F.col("ranked")[0], (F.size("ranked") > 1) & (F.col("ranked")[0]["n"] == F.get("ranked", F.lit(1))["n"])
    inner, outer = F.struct(F.col("in_l").alias("l"), F.col("in_r").alias("r")), F.struct(F.col("out_l").alias("l"), F.col("out_r").alias("r"))
    major = F.when(tie, inner).otherwise(F.struct(top["l"].alias("l"), top["r"].alias("r")))
    picked = per.select(group, "pos", {"longer": inner, "shorter": outer, "major": major}[policy].alias("j"), (tie if policy == "major" else F.lit(False)).alias("fell"))
    return picked.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "j"))), lambda x: x["j"]).alias("repr_junctions"),
        F.when(F.bool_or("fell"), "longer").otherwise(policy).alias("junction_policy"),
    )


def junction_ranges(members: DataFrame, group: str = "gkey") -> DataFrame:
    """(group, pos, l_min, l_max, r_min, r_max): how far the junctions of a group's members spread."""
    j = members.select(group, F.posexplode("junctions").alias("pos", "j"))
    return j.groupBy(group, "pos").agg(F.min("j.l").alias("l_min"), F.max("j.l").alias("l_max"), F.min("j.r").alias("r_min"), F.max("j.r").alias("r_max"))


def guide_key(points: DataFrame, guide: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """(chrom, strand, guide_chrom): the alias stands in only where the guide lacks the pair of chromosome and strand."""
    have = guide.select(F.col("chrom").alias("gc"), F.col("strand").alias("gs")).distinct()
    keys = points.select("chrom", "strand").distinct()
    known = keys.join(have, (F.col("chrom") == F.col("gc")) & (F.col("strand") == F.col("gs")), "left")
    if alias is None:
        return known.select("chrom", "strand", F.col("gc").alias("guide_chrom"))
    return known.join(alias.select(F.col("primary").alias("p"), "secondary"), F.col("chrom") == F.col("p"), "left").select("chrom", "strand", F.coalesce("gc", "secondary").alias("guide_chrom"))


def guide_hits(points: DataFrame, guide: DataFrame, flank: int, alias: DataFrame | None = None) -> DataFrame:
    """(chrom, strand, pos, hits): guide intervals (closed start, end) that meet [pos - flank, pos + flank]."""
    p = points.select("chrom", "strand", "pos").distinct().join(guide_key(points, guide, alias), ["chrom", "strand"])
    p = p.withColumn("hi", (F.col("pos") + flank).cast("long")).withColumn("lo", F.greatest(F.col("pos") - flank, F.lit(0)).cast("long") - 1)
    # those that start by the flank's end, less those that end before its start
    keys, whole = ["guide_chrom", "strand"], guide.filter("start <= end")
    side = lambda end, at: prefix_count(whole.select(F.col("chrom").alias("guide_chrom"), "strand", F.col(end).cast("long").alias(at)), p.select(*keys, at), keys, at).withColumnRenamed("best", f"n_{at}")
    met = p.join(side("start", "hi"), [*keys, "hi"]).join(side("end", "lo"), [*keys, "lo"])
    return met.select("chrom", "strand", "pos", (F.col("n_hi") - F.col("n_lo")).alias("hits")).filter("hits > 0")


def repr_terminal(members: DataFrame, side: str, policy: str = "major", hits: DataFrame | None = None, group: str = "gkey") -> DataFrame:
    """(group, repr_<side>, <side>_policy) over all members; ``side`` is tss or tes.

    With guide hits the positions of most hits decide first: alone, by majority, or the longer.
    """
    p = members.select(group, "chrom", "strand", F.col(side).alias("pos")).groupBy(group, "chrom", "strand", "pos").agg(F.count("*").alias("n"))
    p = p.join(hits, ["chrom", "strand", "pos"], "left").fillna(0, ["hits"]) if hits is not None else p.withColumn("hits", F.lit(0))
    p = p.groupBy(group, "strand").agg(F.max("hits").alias("best"), F.collect_list(F.struct((-F.col("n")).alias("n"), "pos", "hits")).alias("all"))
    kept = F.array_sort(F.filter("all", lambda x: x["hits"] == F.col("best")))
    p = p.withColumn("kept", F.when(F.col("best") > 0, kept).otherwise(F.array_sort("all")))
    at = F.transform("kept", lambda x: x["pos"])
    low = (F.col("strand") == "-") == F.lit(side == "tes")  # the longer end lies at the lower coordinate
    longer = F.when(low, F.array_min(at)).otherwise(F.array_max(at))
    shorter = F.when(low, F.array_max(at)).otherwise(F.array_min(at))
    tie = (F.size("kept") > 1) & (F.col("kept")[0]["n"] == F.get("kept", F.lit(1))["n"])
    major, guided = F.col("kept")[0]["pos"], F.col("best") > 0
    plain = {"longer": longer, "shorter": shorter, "major": F.when(tie, longer).otherwise(major)}[policy]
    name = F.when(tie, "longer").otherwise("major") if policy == "major" else F.lit(policy)
    value = F.when(guided & tie, longer).when(guided, major).otherwise(plain)
    return p.select(
        group, value.alias(f"repr_{side}"),
        F.when(guided & (F.size("kept") == 1), "guide_definitive").when(guided & ~tie, "guide_majority").when(guided, "guide_longer").otherwise(name).alias(f"{side}_policy"),
    )


def mono_pairs(tx: DataFrame, share: float) -> DataFrame:
    """Distinct mono-exon spans (node_a < node_b) of one island and strand with enough reciprocal overlap."""
    node = F.concat_ws("|", "chrom", F.col("island").cast("string"), "strand", F.col("start").cast("string"), F.col("end").cast("string"))
    spans = tx.select("chrom", "island", "strand", "start", "end", node.alias("node")).distinct()
    a = spans.select(F.col("chrom").alias("c1"), F.col("island").alias("i1"), F.col("strand").alias("t1"), F.col("start").alias("s1"), F.col("end").alias("e1"), F.col("node").alias("node_a"))
    b = spans.select(F.col("chrom").alias("c2"), F.col("island").alias("i2"), F.col("strand").alias("t2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("node").alias("node_b"))
    near = (F.col("node_a") < F.col("node_b")) & T.overlaps_closed(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")) & (T.reciprocal_overlap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")) >= share)
    return range_join(a, b, [("c1", "c2"), ("i1", "i2"), ("t1", "t2")], ("s1", "e1"), ("s2", "e2"), near, bin_size=4096).select("node_a", "node_b")


def mono_components(tx: DataFrame, share: float) -> DataFrame:
    """Adds ``root`` to mono-exon transcripts."""
    node = F.concat_ws("|", "chrom", F.col("island").cast("string"), "strand", F.col("start").cast("string"), F.col("end").cast("string"))
    parts = connected_components(mono_pairs(tx, share), "node_a", "node_b").select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return tx.withColumn("_k", node).join(parts, F.col("_k") == F.col("_n"), "left").withColumn("root", F.coalesce("_c", "_k")).drop("_n", "_c", "_k")


def absorption(nc: DataFrame, groups: DataFrame, o: MergeOptions) -> DataFrame:
    """(source_file_id, tx_id, gkey): the group of a cluster whose representative is nearest to a non-canonical chain.

    Nearest by the sum of all differences, then the earlier group.
    """
    step = max(o.wob_d_nc, o.wob_a_nc, o.wob_u_nc) + 1
    left = nc.select(*CLUSTER, "source_file_id", "tx_id", "junctions", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("junctions")[0]["l"] / step) + k)).alias("b"))
    right = groups.select(*CLUSTER, "gkey", "g_order", "repr_junctions", F.floor(F.col("repr_junctions")[0]["l"] / step).alias("b"))
    near = left.join(right, [*CLUSTER, "b"]).filter(T.wobble_match(F.col("strand"), F.col("junctions"), F.col("repr_junctions"), o.wob_d_nc, o.wob_a_nc, o.wob_u_nc))
    d, a = T.junction_diffs(F.col("strand"), F.col("junctions"), F.col("repr_junctions"))
    return near.groupBy("source_file_id", "tx_id").agg(F.min_by("gkey", F.struct((d + a).alias("cost"), "g_order", "gkey")).alias("gkey"))


def _grouped(members: DataFrame, kind: str) -> DataFrame:
    """Adds gkey and the member's place in orders."""
    first = F.when(F.size("junctions") > 0, F.col("junctions")[0])
    key = F.concat_ws("|", F.lit(kind), F.col("n_exons").cast("string"), "root", F.col("a_tss").cast("string"), F.col("a_tes").cast("string"))
    return members.withColumn("gkey", key).withColumn("m_order", F.struct(first["l"].alias("jl"), first["r"].alias("jr"), "start", "end", "source_file_id", "tx_id"))


def _profiled(members: DataFrame, kind: int, o: MergeOptions, tss_hits, tes_hits) -> DataFrame:
    root_first = members.groupBy(*CLUSTER, "root").agg(F.min("m_order").alias("r_order"))
    base = members.groupBy(*CLUSTER, "root", "gkey", "a_tss", "a_tes").agg(F.count("*").alias("own_cnt")).join(root_first, [*CLUSTER, "root"])
    base = base.withColumn("g_order", F.struct(F.lit(kind).alias("kind"), "r_order", "a_tss", "a_tes")).drop("root", "r_order", "a_tss", "a_tes")
    out = base.join(repr_terminal(members, "tss", o.tss_policy, tss_hits), "gkey").join(repr_terminal(members, "tes", o.tes_policy, tes_hits), "gkey")
    if kind == 2:
        return out.withColumn("repr_junctions", F.array().cast(T.JUNCTIONS)).withColumn("junction_policy", F.lit("NA"))
    return out.join(repr_junctions(members, o.splice_policy), "gkey")


def merge(tx: DataFrame, o: MergeOptions = MergeOptions(), *, guide_tss: DataFrame | None = None, guide_tes: DataFrame | None = None, alias: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of a transcript table, see ``assemble.COLUMNS``.

    groups: gkey, cluster, g_order, representative bounds and junctions, policies, tx_count.
    members: the input's columns and gkey. Both are tables in the shared folder.
    """
    tx = written(with_islands(tx), "islands")

    def hits(guide, side, flank):
        if guide is None:
            return None
        end = (T.tss if side == "tss" else T.tes)(F.col("strand"), F.col("start"), F.col("end"))
        return written(guide_hits(tx.select("chrom", "strand", end.alias("pos")), guide, flank, alias), "hits")

    tss_hits, tes_hits = hits(guide_tss, "tss", o.guide_tss_flank), hits(guide_tes, "tes", o.guide_tes_flank)
    keys = [*CLUSTER, "root"]
    multi = tx.filter("n_exons > 1")
    canonical = chain_components(multi.filter("tx_type = 'ALL_CA'"), o.wob_d, o.wob_a, o.wob_u)
    canonical = written(_grouped(anchor_split(canonical, keys, o.terminal_refine, o.tss_wob, o.tes_wob), "c"), "canonical")
    c_groups = written(_profiled(canonical, 0, o, tss_hits, tes_hits), "canonical-groups")
    nc = multi.filter("tx_type <> 'ALL_CA'")
    taken = written(absorption(nc, c_groups, o), "absorbed")
    left = nc.join(taken, ["source_file_id", "tx_id"], "left_anti")
    rest = chain_components(left, o.wob_d_nc, o.wob_a_nc, o.wob_u_nc)
    rest = written(_grouped(anchor_split(rest, keys, o.terminal_refine_nc, o.tss_wob_nc, o.tes_wob_nc), "n"), "rest")
    mono = mono_components(tx.filter("n_exons = 1"), o.mono_ovlp)
    mono = written(_grouped(anchor_split(mono, keys, "none", 0, 0), "m"), "mono")
    groups = c_groups.unionByName(_profiled(rest, 1, o, tss_hits, tes_hits)).unionByName(_profiled(mono, 2, o, tss_hits, tes_hits))
    members = canonical.select(*tx.columns, "gkey").unionByName(rest.select(*tx.columns, "gkey")).unionByName(mono.select(*tx.columns, "gkey"))
    members = written(members.unionByName(nc.join(taken, ["source_file_id", "tx_id"]).select(*tx.columns, "gkey")), "members")
    counts = members.groupBy("gkey").agg(F.count("*").alias("tx_count"))
    minus = F.col("strand") == "-"
    groups = groups.join(counts, "gkey").withColumn("repr_start", F.when(minus, F.col("repr_tes")).otherwise(F.col("repr_tss"))).withColumn("repr_end", F.when(minus, F.col("repr_tss")).otherwise(F.col("repr_tes")))
    return written(groups, "groups"), members


def numbered(rows: DataFrame, coarse: list[Column], fine: list[Column], name: str) -> DataFrame:
    """Adds 1, 2, ... in order of (coarse, fine): row numbers inside each coarse key plus the rows before it.

    Only the table of coarse keys is ordered as a whole.
    """
    tags = [f"_c{i}" for i in range(len(coarse))]
    rows = rows.select("*", *(c.alias(t) for c, t in zip(coarse, tags, strict=True)))
    before = rows.groupBy(*tags).agg(F.count("*").alias("_n"))
    before = before.select(*tags, (F.sum("_n").over(Window.orderBy(*tags)) - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*tags).orderBy(*fine)))
    return ranked.join(before, tags).withColumn(name, F.col("_before") + F.col("_nth")).drop(*tags, "_before", "_nth")


def with_ids(groups: DataFrame, members: DataFrame, step: int = 1 << 20) -> DataFrame:
    """Adds merged_gene_id (one an island) and merged_tx_id; chromosomes in order of first file, then name."""
    rank = members.groupBy("chrom").agg(F.min("source_file_id").alias("c_file"))
    g = groups.join(rank, "chrom")
    coarse = [F.col("c_file"), F.col("chrom"), F.floor(F.col("island") / step)]
    islands = numbered(g.select("c_file", "chrom", "island").distinct(), coarse, [F.col("island")], "gene_no").select("chrom", "island", "gene_no")
    g = numbered(g, coarse, [F.col("island"), T.strand_rank(F.col("strand")), -F.col("n_exons"), F.col("g_order"), F.col("gkey")], "tx_no").join(islands, ["chrom", "island"])
    return g.withColumn("merged_gene_id", F.concat(F.lit("ISOMG_"), F.col("gene_no").cast("string"))).withColumn("merged_tx_id", F.concat(F.lit("ISOMT_"), F.col("tx_no").cast("string"))).drop("c_file")


def track(groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row per merged transcript and source transcript, with the differences to the representative."""
    m = members.select("gkey", "source_file_id", F.col("start").alias("src_start"), F.col("end").alias("src_end"), F.col("tx_id").alias("src_tx_id"), F.col("gene_id").alias("src_gene_id"), F.col("tx_type").alias("src_tx_type"), F.col("junctions").alias("src_junctions"))
    d, a = T.junction_diffs(F.col("strand"), F.col("src_junctions"), F.col("repr_junctions"))
    rows = groups.join(m, "gkey").withColumn("total_donor_diff", d).withColumn("total_acceptor_diff", a).withColumn("exon_diff", T.exon_diff_text(F.col("src_junctions"), F.col("repr_junctions")))
    return rows.select(
        "tx_no", "merged_tx_id", "merged_gene_id", F.col("chrom"), F.col("repr_start").alias("merged_start"), F.col("repr_end").alias("merged_end"), F.col("strand").alias("merged_strand"), F.col("n_exons").alias("merged_exon_num"),
        "junction_policy", "tss_policy", "tes_policy", F.col("tx_count").alias("src_tx_count_in_merged_group"), "source_file_id", "src_start", "src_end", "src_tx_id", "src_gene_id", "src_tx_type",
        "total_donor_diff", "total_acceptor_diff", "exon_diff",
    )


PRESENT_KEYS = ("merged_tx_id", "merged_gene_id", "merged_exon_num", "src_tx_count_in_merged_group")


def present_in(tracked: DataFrame) -> DataFrame:
    """(PRESENT_KEYS, files): the input files of each merged transcript, sorted; ids, since names may repeat."""
    return tracked.groupBy(*PRESENT_KEYS).agg(F.sort_array(F.collect_set("source_file_id")).alias("files"))


def present_absent(tracked: DataFrame, files: list[int]) -> DataFrame:
    """0 or 1 in a column for each of a few input files."""
    return present_in(tracked).select(*PRESENT_KEYS, *(F.array_contains("files", i).cast("int").alias(f"file_{i}") for i in files))


def merge_stats(groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row of counts and guide shares."""
    total = members.agg(F.count("*").alias("total_tx_cnt"), F.countDistinct("source_file_id").alias("source_files"))
    guided = {s: F.count_if(F.col(f"{s}_policy").startswith("guide_")) for s in ("tss", "tes")}
    n = F.count("*")
    own = groups.agg(
        n.alias("merged_tx_cnt"), F.count_if(F.col("n_exons") > 1).alias("merged_multi_exons_tx_cnt"), F.count_if(F.col("n_exons") == 1).alias("merged_mono_exon_tx_cnt"),
        *(x.alias(f"{s}_guide_cnt") for s, x in guided.items()), *(T.percent(x, n).alias(f"{s}_guide_pct") for s, x in guided.items()),
    )
    return own.select("*", total.select("total_tx_cnt").scalar().alias("total_tx_cnt"), total.select("source_files").scalar().alias("source_files"))


def group_size_histogram(groups: DataFrame) -> DataFrame:
    return groups.groupBy(F.col("tx_count").alias("group_size")).agg(F.count("*").alias("merged_tx_cnt"))
