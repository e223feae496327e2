"""Column functions over transcript models.

Coordinates are 1-based closed. ``exons`` is ARRAY<STRUCT<start, end>> sorted by start;
``junctions`` is ARRAY<STRUCT<l, r>> with l the last base of an exon and r the first base of the
next one. A transcript's length counts ``end - start`` of each exon, and overlaps are measured
half-open on these closed coordinates, so a touch of one base is no overlap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXONS = "array<struct<start:int,end:int>>"
JUNCTIONS = "array<struct<l:int,r:int>>"
#: Donor-acceptor pairs of canonical introns.
CANONICAL = ("GT-AG", "GC-AG", "AT-AC")
#: Polyadenylation motifs in order of priority (fixed values).
POLYA_MOTIFS = (
    "AATAAA", "ATTAAA", "AGTAAA", "TATAAA", "CATAAA", "GATAAA", "AATATA", "AATACA",
    "AATAGA", "AAAAAG", "ACTAAA", "AAGAAA", "AATGAA", "TTTAAA", "AAAACA", "GGGGCT",
)


def with_chr(chrom: Column) -> Column:
    """A chromosome name that begins with chr."""
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def without_chr(chrom: Column) -> Column:
    return F.when(chrom.startswith("chr"), F.substring(chrom, F.lit(4), F.length(chrom))).otherwise(chrom)


def strand_rank(strand: Column) -> Column:
    return F.when(strand == "+", 0).when(strand == "-", 1).otherwise(2)


def tss(strand: Column, start: Column, end: Column) -> Column:
    """First transcribed base; an unknown strand counts as plus."""
    return F.when(strand == "-", end).otherwise(start)


def tes(strand: Column, start: Column, end: Column) -> Column:
    return F.when(strand == "-", start).otherwise(end)


def junctions_of(exons: Column) -> Column:
    n = F.size(exons)
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.struct(F.element_at(exons, k)["end"].alias("l"), F.element_at(exons, k + 1)["start"].alias("r")))


def exons_of(start: Column, end: Column, junctions: Column) -> Column:
    """The inverse of ``junctions_of``."""
    first = F.concat(F.array(start), F.transform(junctions, lambda j: j["r"]))
    last = F.concat(F.transform(junctions, lambda j: j["l"]), F.array(end))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def junctions_valid(junctions: Column) -> Column:
    """l < r in each pair, and pairs in order; exons of one base are allowed."""
    n = F.size(junctions)
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    ordered = F.forall(steps, lambda k: F.element_at(junctions, k)["r"] <= F.element_at(junctions, k + 1)["l"])
    return F.forall(junctions, lambda j: j["l"] < j["r"]) & ordered


def transcript_len(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0), lambda s, e: s + e["end"] - e["start"])


def chain_text(junctions: Column) -> Column:
    return F.array_join(F.transform(junctions, lambda j: F.concat_ws("-", j["l"].cast("string"), j["r"].cast("string"))), ",")


def reverse_complement(seq: Column) -> Column:
    """Upper-cased; other letters stay."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def site_pair(strand: Column, left: Column, right: Column) -> Column:
    """donor-acceptor of the two bases inside either end of an intron; unknown strands try plus, then minus."""
    plus = F.concat_ws("-", F.upper(left), F.upper(right))
    minus = F.concat_ws("-", reverse_complement(right), reverse_complement(left))
    unknown = F.when(plus.isin(*CANONICAL), plus).when(minus.isin(*CANONICAL), minus).otherwise("NN-NN")
    return F.when(strand == "+", plus).when(strand == "-", minus).otherwise(unknown)


def tx_type(n_exons: Column, canonical: Column) -> Column:
    """MONO, ALL_CA, PRT_CA or NOT_CA from an array of booleans, one a junction."""
    return (
        F.when(n_exons == 1, "MONO")
        .when(F.forall(canonical, lambda c: c), "ALL_CA")
        .when(F.exists(canonical, lambda c: c), "PRT_CA")
        .otherwise("NOT_CA")
    )


def overlaps_closed(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def overlaps_half_open(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= s2) & (e2 <= e1)


def genomic_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def exon_overlap(a: Column, b: Column) -> Column:
    """Sum over all pairs of exons of their positive overlap."""
    return F.aggregate(a, F.lit(0), lambda s, x: s + F.aggregate(b, F.lit(0), lambda t, y: t + genomic_overlap(x["start"], x["end"], y["start"], y["end"])))


def exon_ends(exons: Column) -> Column:
    """Starts and ends of all exons, repeats included."""
    return F.flatten(F.transform(exons, lambda e: F.array(e["start"], e["end"])))


def site_agreement(query_ends: Column, ref_ends: Column) -> Column:
    """How many exon ends of the reference, transcript ends and repeats included, the query has."""
    return F.size(F.filter(ref_ends, lambda p: F.array_contains(query_ends, p)))


def subchain_offset(query: Column, ref: Column) -> Column:
    """First offset at which ``ref`` holds the whole of ``query`` in a row; null if none or if not shorter."""
    n, m = F.size(ref), F.size(query)
    at = F.filter(F.sequence(F.lit(0), n - m), lambda o: F.slice(ref, o + 1, m) == query)
    return F.when((m > 0) & (m < n), F.when(F.size(at) > 0, F.element_at(at, 1)))


def terminal_diffs(strand: Column, qs: Column, qe: Column, rs: Column, re: Column, q_len: Column, r_len: Column) -> tuple[Column, Column]:
    """(TSS, TES) differences in transcript space: starts relative to the smaller one, ends by length."""
    low = F.least(qs, rs)
    q0, r0 = qs - low, rs - low
    head, tail = r0 - q0, (q0 + q_len) - (r0 + r_len)
    return F.when(strand == "-", tail).otherwise(head), F.when(strand == "-", head).otherwise(tail)


def within_exon(qs: Column, qe: Column, exons: Column) -> Column:
    return F.exists(exons, lambda e: (e["start"] <= qs) & (qe <= e["end"]))


def spans_intron(qs: Column, qe: Column, junctions: Column) -> Column:
    """Strictly around both sides of an intron."""
    return F.exists(junctions, lambda j: (qs < j["l"]) & (j["l"] < j["r"]) & (j["r"] < qe))


def retains_intron(query_exons: Column, junctions: Column) -> Column:
    """One exon holds an intron of the reference, both flanks included."""
    return F.exists(query_exons, lambda e: F.exists(junctions, lambda j: (e["start"] <= j["l"]) & (j["l"] < j["r"]) & (j["r"] <= e["end"])))


def terminal_match(mode: str, d_tss: Column, d_tes: Column, tss_wob: int, tes_wob: int) -> Column:
    a, b = F.abs(d_tss) <= tss_wob, F.abs(d_tes) <= tes_wob
    return {"none": F.lit(True), "tss": a, "tes": b, "both": a & b}[mode]


def reciprocal_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The smaller of the two shares of closed lengths."""
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + 1, F.lit(0)).cast("double")
    return F.least(both / (e1 - s1 + 1), both / (e2 - s2 + 1))


def _sides(strand: Column, junction: Column) -> tuple[Column, Column]:
    """(donor, acceptor) of a junction."""
    return F.when(strand == "-", junction["r"]).otherwise(junction["l"]), F.when(strand == "-", junction["l"]).otherwise(junction["r"])


def wobble_match(strand: Column, a: Column, b: Column, donor: int, acceptor: int, unknown: int) -> Column:
    """Chains of equal length whose donors and acceptors lie within their wobbles, both within ``unknown`` without a strand."""

    def close(x: Column, y: Column) -> Column:
        (dx, ax), (dy, ay) = _sides(strand, x), _sides(strand, y)
        known = (F.abs(dx - dy) <= donor) & (F.abs(ax - ay) <= acceptor)
        blind = (F.abs(x["l"] - y["l"]) <= unknown) & (F.abs(x["r"] - y["r"]) <= unknown)
        return F.when(strand == ".", blind).otherwise(known)

    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, close), lambda c: c)


def junction_diffs(strand: Column, chain: Column, representative: Column) -> tuple[Column, Column]:
    """(sum of donor differences, sum of acceptor differences)."""

    def total(side: int) -> Column:
        return F.aggregate(F.zip_with(chain, representative, lambda x, y: F.abs(_sides(strand, x)[side] - _sides(strand, y)[side])), F.lit(0), lambda s, d: s + d)

    return total(0), total(1)


def exon_diff_text(chain: Column, representative: Column) -> Column:
    """``(number,left,right)`` of junctions where the representative lies to the right of either side, else no_diff."""
    numbered = F.transform(chain, lambda x, i: F.struct((i + 1).alias("n"), x["l"].alias("l"), x["r"].alias("r")))
    diffs = F.zip_with(numbered, representative, lambda x, y: F.struct(x["n"].alias("n"), (y["l"] - x["l"]).alias("l"), (y["r"] - x["r"]).alias("r")))
    shown = F.transform(F.filter(diffs, lambda d: (d["l"] > 0) | (d["r"] > 0)), lambda d: F.concat(F.lit("("), d["n"].cast("string"), F.lit(","), d["l"].cast("string"), F.lit(","), d["r"].cast("string"), F.lit(")")))
    return F.when(F.size(shown) == 0, "no_diff").otherwise(F.array_join(shown, ","))


def source_text(file_id: Column, tx_id: Column, start: Column, end: Column, kind: Column, donor: Column, acceptor: Column, exon_diff: Column) -> Column:
    """One element of the provenance attribute."""
    return F.concat_ws(":", F.concat(F.lit("S"), (file_id + 1).cast("string")), tx_id, start.cast("string"), end.cast("string"), kind, donor.cast("string"), acceptor.cast("string"), exon_diff)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent at four decimals, half away from zero; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.floor(part * 100.0 / whole * 10000.0 + 0.5) / 10000.0)


def a_percent(seq: Column) -> Column:
    return (F.length(F.regexp_replace(seq, "[^Aa]", "")) * 100.0 / F.length(seq)).cast("float")


def polya_motif(seq: Column) -> tuple[Column, Column]:
    """(motif, distance): the first motif of the list that occurs, and its end less the window's length."""
    upper = F.upper(seq)
    motif = F.coalesce(*(F.when(F.instr(upper, m) > 0, F.lit(m)) for m in POLYA_MOTIFS))
    return motif, F.when(motif.isNotNull(), F.position(motif, upper) - 1 + 6 - F.length(seq))


def shown(value: Column) -> Column:
    """Text of a value; NA for null and empty."""
    text = value.cast("string")
    return F.when(text.isNull() | (text == ""), "NA").otherwise(text)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
