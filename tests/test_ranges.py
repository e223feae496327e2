"""Running maxima, anchors and other relations over positions, against plain code."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spliceloom.operators import anchors, context, islands, merge, prefixmax, rangejoin
from spliceloom.tools import attributes

rng = random.Random(5)


@pytest.mark.parametrize("bin_size", [4, 64, 1 << 16])
def test_covered_and_covering(spark, bin_size, monkeypatch):
    monkeypatch.setattr(prefixmax.prefix_max, "__kwdefaults__", {"bin_size": bin_size})
    span = lambda far: sorted((rng.randrange(300), rng.randrange(300 if far else 40)))
    rows = [(i, rng.choice("ab"), *(lambda a: (a, a + rng.randrange(60)))(rng.randrange(300))) for i in range(300)]
    cat = [(rng.choice("ab"), *span(True)) for _ in range(20)] + [(k, a, a + 3) for k, a in (("a", 17), ("b", 90), ("b", 90))] + [(None, 1, 200), ("a", None, 5), ("a", 4, None)]
    q = spark.createDataFrame([*rows, (900, None, 3, 4), (901, "a", None, 4)], "id int, k string, s int, e int")
    c = spark.createDataFrame(cat, "k string, l int, r int")
    whole = [(k, l, r) for k, l, r in cat if None not in (k, l, r)]
    inside = {i for i, k, s, e in rows if any(k == x and l <= s and e <= r for x, l, r in whole)}
    around = {i for i, k, s, e in rows if any(k == x and s <= l and r < e for x, l, r in whole)}
    col = F.col
    got = [f(q, c, ["k"], (col("s"), col("e")), (col("l"), col("r"))).select("id").collect() for f in (prefixmax.covered, prefixmax.covering)]
    assert sorted(r.id for r in got[0]) == sorted(inside) and sorted(r.id for r in got[1]) == sorted(around)
    assert inside and around


def test_running_maxima_form_no_pairs(spark):
    rows = spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") % 7).alias("s"), F.col("id").alias("e"))
    plan = prefixmax.covered(rows, rows.select("k", F.col("s").alias("l"), F.col("e").alias("r")), ["k"], (F.col("s"), F.col("e")), (F.col("l"), F.col("r")))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def walked(ends, mode, w1, w2):
    out, anchor = {}, None
    for tss, tes in sorted(ends):
        if anchor is not None:
            near = {"tss": abs(tss - anchor[0]) <= w1, "tes": abs(tes - anchor[1]) <= w2, "both": abs(tss - anchor[0]) <= w1 and abs(tes - anchor[1]) <= w2}[mode]
        if anchor is None or not near:
            anchor = (tss, tes)
        out[tss, tes] = anchor
    return out


@pytest.mark.parametrize("mode", ["tss", "tes", "both"])
@pytest.mark.parametrize("shape", ["dense", "constant", "wide"])
def test_anchors_of_groups_over_many_blocks(spark, mode, shape):
    spread = {"dense": (400, 400), "constant": (900, 1), "wide": (3000, 60)}[shape]
    groups = {g: {(rng.randrange(spread[0]), rng.randrange(spread[1])) for _ in range(n)} for g, n in (("a", 700), ("b", 3), ("c", 250), ("d", 1), ("e", 60))}
    ends = spark.createDataFrame([(g, "x", s, e) for g, v in groups.items() for s, e in v], "g string, h string, tss int, tes int")
    want = sorted((g, *end, *a) for g, v in groups.items() for end, a in walked(v, mode, 20, 15).items())
    for fold, block in ((5, 40), (0, 200)) if shape == "dense" else ((5, 110), (300, 10_000)):
        got = anchors.anchors(ends, ["g", "h"], mode, 20, 15, fold=fold, block_rows=block)
        assert sorted((r.g, r.tss, r.tes, r.a_tss, r.a_tes) for r in got.collect()) == want


def test_anchors_of_no_ends(spark):
    none = spark.createDataFrame([], "g string, tss int, tes int")
    assert anchors.anchors(none, ["g"], "both", 50, 50).collect() == []


def test_a_million_ends_in_one_group(spark):
    n = 1_000_000
    ends = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") % 250_000).cast("int").alias("tss"), (F.floor(F.col("id") / 250_000) * 20 + F.col("id") % 90).cast("int").alias("tes"))
    start = time.time()
    got = anchors.anchors(ends.distinct(), ["g"], "both", 50, 50)
    pdf = got.toPandas()
    took = time.time() - start
    want = walked(set(zip(pdf.tss, pdf.tes, strict=True)), "both", 50, 50)
    assert len(pdf) == len(want) and all(want[s, e] == (x, y) for s, e, x, y in zip(pdf.tss, pdf.tes, pdf.a_tss, pdf.a_tes, strict=True))
    assert took < 60


@pytest.mark.parametrize("n", [1, 2, 7])
def test_filled_lines(spark, n):
    cases = [sorted(rng.sample(range(n), k)) for k in range(n + 1) for _ in range(3)]
    table = spark.createDataFrame([(i, [(at, f"v{at}") for at in c]) for i, c in enumerate(cases)], "i int, cells array<struct<at:int,value:string>>")
    got = {r.i: r.line for r in table.select("i", attributes.filled_line(F.col("cells"), n, "0.0").alias("line")).collect()}
    assert got == {i: "\t".join(f"v{at}" if at in c else "0.0" for at in range(n)) for i, c in enumerate(cases)}


def test_value_lines_of_thousands_of_files(spark):
    took = {}
    for n in (50, 5000):
        merged = spark.range(2000).select(F.concat(F.lit("M"), "id").alias("merged_tx_id"))
        rows = spark.range(12000).select((F.col("id") * 7 % n).cast("int").alias("file_id"), F.concat(F.lit("M"), (F.col("id") % 2000)).alias("merged_tx_id"), F.col("id").cast("string").alias("value"), F.col("id").alias("line_no"))
        start = time.time()
        lines = attributes.value_cells(merged, rows, range(n)).select("transcript_id", attributes.filled_line(F.col("cells"), n, "0").alias("line"))
        assert lines.agg(F.min(F.size(F.split("line", "\t"))), F.max(F.size(F.split("line", "\t"))), F.count("*")).first()[:] == (n, n, 2000)
        took[n] = time.time() - start
    assert took[5000] < 3 * took[50] + 2


@pytest.mark.parametrize("bin_size", [3, 1 << 16])
def test_prefix_count(spark, bin_size):
    cat = [(rng.choice("ab"), rng.randrange(80)) for _ in range(90)] + [(None, 4), ("a", None)]
    asked = [(k, p) for k in "abc" for p in range(-2, 85, 5)] + [("a", 3), ("a", 3)]
    got = prefixmax.prefix_count(spark.createDataFrame(cat, "k string, at long"), spark.createDataFrame(asked, "k string, at long"), ["k"], "at", bin_size=bin_size)
    assert sorted(tuple(r) for r in got.collect()) == sorted({(k, p, sum(x == k and q is not None and q <= p for x, q in cat)) for k, p in asked})


def test_guide_hits_by_counts(spark):
    guides = [("c", rng.choice("+-"), *(lambda a: (a, a + rng.randrange(12)))(rng.randrange(1, 200))) for _ in range(150)] + [("c", "+", 50, 40)]
    points = [("c", s, p) for s in "+-" for p in range(0, 230, 3)] + [("d", "+", 5)]
    g = spark.createDataFrame(guides, "chrom string, strand string, start int, end int")
    hits = merge.guide_hits(spark.createDataFrame(points * 2, "chrom string, strand string, pos int"), g, 10)
    want = {(c, s, p): sum(x == c and y == s and a <= z and max(p - 10, 0) <= z and a <= p + 10 for x, y, a, z in guides) for c, s, p in points}
    assert {(r.chrom, r.strand, r.pos): r.hits for r in hits.collect()} == {k: v for k, v in want.items() if v}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_chains_of_a_hot_first_exon_meet_at_another_place(spark):
    chains = []
    for i in range(1500):
        far = 5000 + 40 * (i % 700) + rng.choice([0, 0, 2])
        junctions = [{"l": 100 + rng.choice([0, 1]), "r": 200}, {"l": 300, "r": far}]
        chains.append(("c", 0, "+", 3, f"n{i}", junctions))
    table = spark.createDataFrame(chains, "chrom string, island int, strand string, n_exons int, node string, junctions array<struct<l:int,r:int>>")
    pairs = {(r.node_a, r.node_b) for r in merge.wobble_pairs(table, 3, 3, 3).collect()}
    close = lambda a, b: all(abs(x[k] - y[k]) <= 3 for x, y in zip(a[5], b[5], strict=True) for k in "lr")
    by_far = {}
    for c in chains:
        by_far.setdefault((c[5][1]["r"] - 5000) // 40, []).append(c)
    want = {tuple(sorted((a[4], b[4]))) for same in by_far.values() for i, a in enumerate(same) for b in same[:i] if close(a, b)}
    assert pairs == want and len(want) > 500
    compared = merge.wobble_candidates(table, 4).count()
    assert compared * 20 < 1500 * 1499 / 2


@pytest.mark.parametrize("bin_size", [5, 1 << 16])
def test_islands(spark, bin_size):
    rows = [(rng.choice("ab"), s, s + rng.randrange(1, 14), i) for i, s in enumerate(rng.randrange(1, 1200) for _ in range(120))] + [("c", 5, 5, 900), ("c", 5, 9, 901), ("c", 9, 10, 902), ("c", 11, 12, 903)]
    want, last = {}, {}
    for c, s, e, i in sorted(rows):
        island, far = last.get(c, (None, -1))
        if island is None or s > far:
            island = s
        last[c] = (island, max(far, e))
        want[i] = island
    got = islands.with_islands(spark.createDataFrame(rows, "chrom string, start int, end int, i int"), bin_size=bin_size)
    assert {r.i: r.island for r in got.collect()} == want and got.columns == ["chrom", "start", "end", "i", "island"]


def test_a_dense_bin_costs_its_places(spark):
    """Two million transcripts of one bin: no window holds more rows than the bin has places."""
    tx = spark.range(2_000_000).select(F.lit("c").alias("chrom"), (F.col("id") % 50_000).cast("int").alias("start"), (F.col("id") % 50_000 + 3).cast("int").alias("end"))
    got = islands.with_islands(tx)
    assert got.agg(F.count("*"), F.countDistinct("island"), F.max("island")).first()[:] == (2_000_000, 1, 0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("Aggregate" in below for below in plan.split("Window")[1:])


def test_a_hot_locus_is_dealt_out(spark):
    own = random.Random(19)
    span = lambda a, n: (a, a + own.randrange(n))
    left = [(i, "a", *span(5000 + own.randrange(300), 90)) for i in range(4000)] + [(i, own.choice(["a", "b", None]), *span(own.randrange(90_000), 2500)) for i in range(4000, 5000)]
    right = [(i, own.choice("ab"), *span(5000 + own.randrange(300), 40)) for i in range(30)] + [(i, own.choice("ab"), *span(own.randrange(90_000), 60_000)) for i in range(30, 60)]
    x, y = spark.createDataFrame(left, "i int, k string, s int, e int"), spark.createDataFrame(right, "j int, q string, l int, r int")
    on = (F.col("s") <= F.col("r")) & (F.col("l") <= F.col("e"))
    got = [sorted(map(tuple, rangejoin.range_join(x, y, [("k", "q")], ("s", "e"), ("l", "r"), on, bin_size=500, hot=hot).select("i", "j").collect())) for hot in (None, 200, 1)]
    want = sorted((i, j) for i, k, s, e in left for j, q, l, r in right if k == q and s <= r and l <= e)
    assert got[0] == got[1] == got[2] == want
    lefts, rights = rangejoin.dealt(x.withColumn("_bin_l", F.floor(F.col("s") / 500)), y.withColumn("_bin_r", F.floor(F.col("l") / 500)), [("k", "q")], 200)
    sizes = [r["count"] for r in lefts.groupBy("k", "_bin_l", "_deal_l").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 300  # 4000 rows in one bin
    assert rights.filter("_deal_r > 0").select("q", "_bin_r").distinct().count() == 1
    assert sorted(r.j for r in rights.filter("_deal_r = 0").select("j").collect()) == list(range(60))


@pytest.mark.parametrize("ask", [context.cage_peaks, context.polya_peaks])
def test_peaks_are_asked_once_an_end(spark, ask):
    """300 transcripts of one span and 300 peaks of one span make one pair, not 90,000; results are those of each alone."""
    tx = spark.range(300).select(F.lit(1).alias("source_file_id"), F.concat(F.lit("t"), "id").alias("tx_id"), F.lit("c").alias("chrom"), F.lit("+").alias("strand"), F.lit(1000).alias("start"), F.lit(1000).alias("end"))
    peaks = spark.range(300).select(F.lit("c").alias("chrom"), F.lit("+").alias("strand"), F.lit(991).alias("start"), F.lit(995).alias("end"))
    got = ask(tx, peaks, 100)
    want = ask(tx.limit(1), peaks.limit(1), 100).select(*got.columns[-2:]).collect()
    assert got.count() == 300 and [tuple(r) for r in got.select(*got.columns[-2:]).distinct().collect()] == [tuple(r) for r in want] and want[0][1] is not None
    end = F.col("start")
    assert context._near(tx, peaks, end, F.col("at"), 100).count() == 1


@pytest.mark.parametrize("side", [5, 10_000])
def test_tiles_of_a_join_make_every_pair_once(spark, side):
    far = lambda i: 2_500_000 if i % 40 == 0 else 400
    made = lambda n: [(i, rng.choice("ab"), s := rng.randrange(3000) + (2_000_000 if i % 9 == 0 else 0), s + rng.randrange(far(i)), 1 + i % 3) for i in range(n)]
    left, right = made(200), made(150)
    x, y = spark.createDataFrame(left, "i long, k string, s int, e int, w int"), spark.createDataFrame(right, "j long, q string, l int, r int, v int")
    on = (F.col("s") < F.col("r")) & (F.col("l") < F.col("e"))
    got = rangejoin.tiled_join(x, y, [("k", "q")], ("s", "e"), ("l", "r"), on, ("i", "j"), (F.col("w"), F.col("v")), side=side)
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == want
    assert got.columns == [*x.columns, *y.columns]


def test_a_hot_bin_of_a_tiled_join_is_many_small_groups(spark):
    """300 rows a side under one key: no group of the join holds more than a few of either side."""
    x = spark.range(300).select(F.col("id").alias("i"), F.lit("a").alias("k"), F.lit(1).alias("s"), F.lit(9).alias("e"))
    y = x.select(F.col("i").alias("j"), F.col("k").alias("q"), F.col("s").alias("l"), F.col("e").alias("r"))
    got = rangejoin.tiled_join(x, y, [("k", "q")], ("s", "e"), ("l", "r"), F.lit(True), ("i", "j"), (F.lit(1), F.lit(1)), side=30, pairs=900)
    at = got.select("i", "j", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in at) == 90_000 and len(at) > 20 and max(r["count"] for r in at) < 15_000
