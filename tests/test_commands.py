"""A toy genome through all commands."""

import gzip
import io
import json
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spliceloom import cli
from spliceloom.operators.classify import ClassifyOptions
from spliceloom.plans import commands
from spliceloom.sources import bed, fasta, files, gtf

#: GT at the left and AG at the right of an intron, on the plus strand; CT and AC for the minus strand.
PLUS, MINUS = ("GT", "AG"), ("CT", "AC")


def tx(name, gene, strand, *exons, extra=""):
    out = [("transcript", exons[0][0], exons[-1][1], f'gene_id "{gene}"; transcript_id "{name}";{extra}')]
    out += [("exon", a, b, f'gene_id "{gene}"; transcript_id "{name}";') for a, b in exons]
    return "".join(f"chrT\tt\t{k}\t{a}\t{b}\t.\t{strand}\t.\t{x}\n" for k, a, b, x in out)


@pytest.fixture(scope="module")
def toy(tmp_path_factory):
    d = tmp_path_factory.mktemp("toy")
    seq = ["A"] * 1000
    for l, r, (x, y) in ((150, 201, PLUS), (250, 301, PLUS), (550, 601, MINUS)):
        if seq[l] == "A":
            seq[l : l + 2] = x
        if seq[r - 3] == "A":
            seq[r - 3 : r - 1] = y
    text = "".join(seq)
    (d / "g.fa").write_text(">chrT\n" + "".join(text[i : i + 80] + "\n" for i in range(0, 1000, 80)))
    (d / "g.fa.fai").write_text("chrT\t1000\t6\t80\t81\n")
    a = ((100, 150), (201, 250), (301, 400))
    ref = "# ref\n" + tx("R1", "GA", "+", *a, extra=' gene_name "Alpha";') + tx("R2", "GB", "-", (500, 550), (601, 700)) + tx("R3", "GC", "+", (800, 900))
    (d / "ref.gtf").write_text(ref)
    s1 = tx("q1", "x1", "+", *a) + tx("q2", "x2", "+", (820, 880)) + tx("q3", "x3", "+", (510, 540))
    s2 = tx("p1", "y1", "+", (110, 150), (201, 250), (301, 390)) + tx("p2", "y2", "+", (201, 250), (301, 400)) + tx("p3", "y3", "+", (820, 881)) + tx("p4", "y4", "+", (100, 151), (201, 250), (301, 400))
    (d / "s1.gtf").write_text(s1)
    with gzip.open(d / "s2.gtf.gz", "wt") as f:
        f.write(s2)
    (d / "cage.bed").write_text("chrom\tstart\tend\tname\tscore\tstrand\nchrT\t95\t105\tc1\t1.5\t+\nchrT\t300\t310\tc2\t1\t+\n")
    return d


def read(path):
    with gzip.open(path, "rt") as f:
        return f.read().splitlines()


@pytest.fixture(scope="module")
def merged(spark, toy):
    stats = commands.merge_files(spark, [str(toy / "s1.gtf"), str(toy / "s2.gtf.gz")], str(toy / "g.fa"), str(toy / "m"))
    return toy, stats


def test_merge(merged):
    d, stats = merged
    # q1, p1 and the shifted p4 are one transcript, q2 and p3 overlap enough, p2 and q3 stand alone
    assert stats["total_tx_cnt"] == 7 and stats["merged_tx_cnt"] == 4 and stats["source_tx_cnt_per_merged_tx"] == {"1": 2, "2": 1, "3": 1}
    lines = read(d / "m.merged.gtf.gz")
    assert lines[0].startswith("##ISOM <VERSION>") and sum(x.startswith("##ISOM <SAMPLE>") for x in lines) == 2
    t = [x for x in lines if "\ttranscript\t" in x]
    assert len(t) == 4 and t[0].split("\t")[3:5] == ["100", "400"] and "S1:q1:100:400:ALL_CA:0:0:no_diff|S2:p4:100:400:PRT_CA:1:0:no_diff|S2:p1:110:390:ALL_CA:0:0:no_diff" in t[0]
    track = [x.split("\t") for x in read(d / "m.track.tsv.gz")]
    assert track[0] == list(commands.TRACK) and len(track) == 8 and {x[-1] for x in track[1:]} == {"s1.gtf", "s2.gtf.gz"}
    present = [x.split("\t") for x in read(d / "m.present_absent.tsv.gz")]
    assert present[0][4:] == ["s1.gtf", "s2.gtf.gz"] and present[1][3:] == ["3", "1", "1"]


def test_classify(spark, merged):
    d, _ = merged
    stats = commands.classify_files(spark, str(d / "m.merged.gtf.gz"), str(d / "ref.gtf"), str(d / "g.fa"), str(d / "c"), ClassifyOptions(), cage=str(d / "cage.bed"))
    table = [dict(zip(commands.CLASSIFICATION, x.split("\t"), strict=True)) for x in read(d / "c.classification.txt.gz")[1:]]
    by = {r["isoform_id"]: r for r in table}
    kinds = sorted((r["structural_category"], r["subcategory"]) for r in table)
    assert kinds == [("antisense", "mono-exon"), ("full-splice_match", "mono-exon"), ("full-splice_match", "reference_match"), ("incomplete-splice_match", "3prime_fragment")]
    full = next(r for r in by.values() if r["subcategory"] == "reference_match")
    assert full["ref_tx_id"] == "R1" and full["ref_gene_name"] == "Alpha" and full["within_cage_peak"] == "true" and full["query_length"] == "198"
    assert full["seq_a_downstream_tts"] == "A" * 20 and full["perc_a_downstream_tts"] == "100.0000" and full["within_poly_a_peak"] == "NA"
    assert next(r for r in table if r["structural_category"] == "antisense")["ref_gene_id"] == "novelGene_GB_AS"
    assert stats["query_tx_cnt"] == 4 and stats["reference_tx_cnt"] == 3
    annotated = read(d / "c.annotated.gtf.gz")
    assert sum(x.startswith("#") for x in annotated) > 5 and any('ISOM_CATEGORY "antisense"' in x and "\texon\t" in x for x in annotated)
    assert json.loads((d / "c.classify_info.json").read_text())["categories"]["full-splice_match"] == 2


def test_tools(spark, merged):
    d, _ = merged
    commands.chop(spark, str(d / "m.merged.gtf.gz"), str(d / "k"))
    lines = read(d / "k.chopped.gtf.gz")
    assert lines[0].startswith("##ISOM") and not any("ISOM_SRC \"" in x for x in lines if "\ttranscript\t" in x)
    stats = commands.valtable(spark, str(d / "m.merged.gtf.gz"), [str(d / "s2.gtf.gz"), str(d / "s1.gtf")], "gene_id", str(d / "v"))
    rows = [x.split("\t") for x in read(d / "v.valtable.tsv.gz")]
    assert rows[0] == ["transcript_id", "s2.gtf.gz", "s1.gtf"] and rows[1] == ["ISOMT_1", "y4", "x1"]
    assert stats["merged_tx_count"] == 4 and stats["per_file"]["s1.gtf"]["extracted"] == 3


def test_index_is_reused_until_an_input_changes(spark, toy, monkeypatch):
    path = toy / "own.gtf"
    path.write_text((toy / "ref.gtf").read_text())
    a = commands.index(spark, str(path), str(toy / "g.fa"))[0]
    assert {r.tx_id: r.tx_type for r in a.collect()} == {"R1": "ALL_CA", "R2": "ALL_CA", "R3": "MONO"}
    info = json.loads((toy / "own.gtf.index.info.json").read_text())
    assert info["tx_cnt"] == 3 and info["gene_cnt"] == 3 and info["junction_cnt"] == 3 and info["missing_seqids"] == []
    built = []
    real = commands.assemble.transcripts
    monkeypatch.setattr(commands.assemble, "transcripts", lambda *x, **k: built.append(1) or real(*x, **k))
    assert commands.index(spark, str(path), str(toy / "g.fa"))[0].count() == 3 and not built
    was = os.stat(path)
    path.write_text(path.read_text().replace("R3", "R9"))  # as many bytes, at the same time
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))
    assert {r.tx_id for r in commands.index(spark, str(path), str(toy / "g.fa"))[0].collect()} == {"R1", "R2", "R9"} and built


@pytest.mark.parametrize("text,error", [
    ("chrT\tt\tgene\tx\t5\t.\t+\t.\ta\n", "bad GTF line"), (tx("o", "g", "+", (100, 200), (150, 300)), "exons that overlap"),
    (tx("o", "g", "+", (900, 950), (1200, 1300)), "outside of the sequence"), ("chrT\tt\tgene\t1\t5\t.\t+\t.\ta\n", "no transcript line"),
])
def test_bad_inputs_fail(spark, toy, text, error):
    (toy / "bad.gtf").write_text(text)
    with pytest.raises(Exception, match=error):
        commands.index(spark, str(toy / "bad.gtf"), str(toy / "g.fa"))[0].collect()


def test_compression_follows_content(spark, toy):
    plain = (toy / "ref.gtf").read_bytes()
    for name, data in (("zip.gtf", gzip.compress(plain[:100]) + gzip.compress(plain[100:])), ("plain.gtf.gz", plain), ("both.gtf.bgz", gzip.compress(plain))):
        (toy / name).write_bytes(data)
    paths = [str(toy / n) for n in ("zip.gtf", "ref.gtf", "plain.gtf.gz", "both.gtf.bgz")]
    rows = files.lines(spark, paths).orderBy("source_file_id", "line_no").collect()
    assert [[r.value for r in rows if r.source_file_id == i] for i in range(4)] == [plain.decode().splitlines()] * 4


def test_chop_keeps_line_ends(spark, toy):
    t = (toy / "ref.gtf").read_text().replace('gene_name "Alpha";', 'gene_name "Alpha"; ISOM_X "1";').replace("\n", "\r\n")
    (toy / "dos.gtf").write_bytes(t.encode())
    commands.chop(spark, str(toy / "dos.gtf"), str(toy / "dos"))
    with gzip.open(toy / "dos.chopped.gtf.gz") as f:
        out = f.read().decode()
    assert out == t.replace(' ISOM_X "1";', "")


def test_ids_of_attributes(spark):
    cases = {
        'gene_id "A"; transcript_id "T"; gene_id "B"': ("T", "A"), 'gene_id "A"; gene_id_x "B"; transcript_id "T"': ("T", "B"), "transcript_id T ; gene_id A": ("T", "A"),
        'gene_id A"q; transcript_id "T"': ("T", 'A"q'), 'gene_id ""; transcript_id "T"; gene_id "C"': ("T", "C"), "transcript_id; x": ("", ""), "": ("", ""), 'note "a"; transcript_id\t"T"; gene_id\tA': ("T", "A"),
    }
    d = spark.createDataFrame([(k,) for k in cases], "attrs string")
    assert {r.attrs: (r.i.tx_id, r.i.gene_id) for r in d.select("attrs", gtf.ids(F.col("attrs")).alias("i")).collect()} == cases


def test_sequence_end_is_an_end(spark, toy):
    w = spark.createDataFrame([("chrT", 0, 10), ("chrT", 990, 1000), ("chrT", 995, 1005), ("chrT", 5, 5)], "chrom string, win_lo int, win_hi int")
    got = {(r.win_lo, r.win_hi): len(r.seq) for r in fasta.windows(w, fasta.chunks(spark, str(toy / "g.fa"), 64), 64).collect()}
    assert got == {(0, 10): 10, (990, 1000): 10}


def test_aliases_and_guides_of_files(spark, toy):
    (toy / "map.tsv").write_text("primary\tsecondary\nchrT\tT\n\nchrU\tU\n")
    assert sorted(tuple(r) for r in bed.aliases(spark, str(toy / "map.tsv")).collect()) == [("chrT", "T"), ("chrU", "U")]
    (toy / "twice.tsv").write_text("primary\tsecondary\nchrT\tT\nchrT\tU\n")
    with pytest.raises(ValueError, match="repeated chromosome"):
        bed.aliases(spark, str(toy / "twice.tsv"))
    (toy / "tss.bed").write_text("chrT\t0\t1\tfirst\t0\t+\nT\t98\t112\tx\t1\t+\n")  # the first line is a header, whatever it holds
    assert [tuple(r)[:4] for r in bed.guide(spark, str(toy / "tss.bed")).collect()] == [("T", "+", 99, 112)]
    stats = commands.merge_files(spark, [str(toy / "s1.gtf"), str(toy / "s2.gtf.gz")], str(toy / "g.fa"), str(toy / "guided"), guide_tss=str(toy / "tss.bed"), alias=str(toy / "map.tsv"))
    assert stats["tss_guide_cnt"] == 1 and stats["tes_guide_cnt"] == 0
    assert 'ISOM_REPR_POLICY "major:guide_' in "\n".join(read(toy / "guided.merged.gtf.gz"))


def test_unstranded_transcripts_and_two_chromosomes(spark, toy):
    """Splice sites of unknown strand are taken as those of the strand that fits; chromosomes come in order of file, then name."""
    d = toy / "two"
    d.mkdir()
    text = "".join((toy / "g.fa").read_text().splitlines()[1:])
    (d / "g.fa").write_text(f">chrB\n{text}\n>chrA\n{text}\n")
    (d / "g.fa.fai").write_text("chrB\t1000\t6\t1000\t1001\nchrA\t1000\t1013\t1000\t1001\n")
    on = lambda c, s: s.replace("chrT", c)
    (d / "a.gtf").write_text(on("chrB", tx("u1", "g", ".", (500, 550), (601, 700)) + tx("u2", "g", "+", (100, 150), (201, 250))))
    (d / "b.gtf").write_text(on("chrA", tx("v1", "g", "+", (100, 150), (201, 250))) + on("chrB", tx("v2", "g", ".", (500, 552), (601, 700))))
    stats = commands.merge_files(spark, [str(d / "a.gtf"), str(d / "b.gtf")], str(d / "g.fa"), str(d / "m"))
    assert stats["total_tx_cnt"] == 4 and stats["merged_tx_cnt"] == 3
    t = [x.split("\t") for x in read(d / "m.merged.gtf.gz") if "\ttranscript\t" in x]
    assert [(x[0], x[6]) for x in t] == [("chrB", "+"), ("chrB", "."), ("chrA", "+")] and "S1:u1:500:700:ALL_CA" in t[1][8]


def test_documented_counts(spark, tmp_path):
    """Thirteen transcripts of three samples make ten, in six categories of a reference of three genes."""
    seq = ["A"] * 1000
    for l, r, (x, y) in ((150, 201, PLUS), (250, 301, PLUS), (150, 221, PLUS), (550, 601, MINUS), (650, 701, MINUS)):
        seq[l : l + 2], seq[r - 3 : r - 1] = x, y
    (tmp_path / "g.fa").write_text(">chrT\n" + "".join(seq) + "\n")
    (tmp_path / "g.fa.fai").write_text("chrT\t1000\t6\t1000\t1001\n")
    a = ((101, 150), (201, 250), (301, 400))
    (tmp_path / "ref.gtf").write_text(tx("A1", "GeneA", "+", *a) + tx("B1", "GeneB", "-", (501, 550), (601, 650), (701, 800)) + tx("C1", "GeneC", "+", (851, 950)))
    samples = {
        "s1.gtf": tx("exact", "x", "+", *a) + tx("subset", "x", "+", *a[1:]) + tx("mono", "x", "+", (851, 950)) + tx("antisense", "x", "+", (501, 540)),
        "s2.gtf": tx("shifted", "x", "+", (111, 150), a[1], (301, 390)) + tx("known_sites", "x", "+", a[0], a[2]) + tx("novel_site", "x", "+", a[0], (221, 250), a[2]) + tx("in_exon", "x", "+", (311, 380)),
        "s3.gtf": tx("off_by_one", "x", "+", (201, 251), a[2]) + tx("far_tss", "x", "+", (21, 150), *a[1:]) + tx("mono_overlap", "x", "+", (853, 950)) + tx("retained", "x", "+", (131, 220)) + tx("between", "x", "+", (961, 990)),
    }
    for name, text in samples.items():
        (tmp_path / name).write_text(text)
    stats = commands.merge_files(spark, [str(tmp_path / n) for n in samples], str(tmp_path / "g.fa"), str(tmp_path / "m"))
    assert stats["total_tx_cnt"] == 13 and stats["merged_tx_cnt"] == 10 and stats["source_tx_cnt_per_merged_tx"] == {"1": 7, "2": 3}
    assert stats["merged_multi_exons_tx_cnt"] == 5 and stats["merged_mono_exon_tx_cnt"] == 5
    stats = commands.classify_files(spark, str(tmp_path / "m.merged.gtf.gz"), str(tmp_path / "ref.gtf"), str(tmp_path / "g.fa"), str(tmp_path / "c"))
    assert stats["categories"] == {"antisense": 1, "full-splice_match": 3, "incomplete-splice_match": 2, "intergenic": 1, "novel_in_catalog": 2, "novel_not_in_catalog": 1}


@pytest.fixture
def many_lines(spark):
    rows = spark.range(20_000).select(F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("line")).repartition(7, "line")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, ["head", *(r.line for r in rows.orderBy("n").collect())]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_single_files_are_put_together_by_tasks(spark, tmp_path, many_lines, monkeypatch):
    rows, want = many_lines
    monkeypatch.setattr(files, "DRIVER_BYTES", 0)
    copied = []
    monkeypatch.setattr(files, "_write_bytes", lambda fs, path, data, real=files._write_bytes: copied.append(len(data)) or real(fs, path, data))
    path = str(tmp_path / "out file.txt.gz")
    for _ in range(2):  # the second one takes the place of the first
        files.write_lines(rows, ["n"], path, ["head"])
        assert read(path) == want and sum(copied) < 200
    assert os.listdir(tmp_path) == ["out file.txt.gz"]
    monkeypatch.setattr(files, "DRIVER_BYTES", 1 << 30)
    files.write_lines(rows, ["n"], path, ["head"])
    assert read(path) == want and files.lines(spark, [path]).count() == len(want)


def test_ordered_parts(spark, tmp_path, many_lines):
    rows, want = many_lines
    files.write_lines(rows, ["n"], str(tmp_path / "p.gz"), ["head"], parts=True)
    listed = json.loads((tmp_path / "p.gz" / "_manifest.json").read_text())
    names = sorted(n for n in os.listdir(tmp_path / "p.gz") if n.startswith(("header", "part")))
    assert [x["name"] for x in listed] == names and len(names) > 2 and all(os.path.getsize(tmp_path / "p.gz" / x["name"]) == x["bytes"] for x in listed)
    data = b"".join((tmp_path / "p.gz" / n).read_bytes() for n in names)
    assert gzip.decompress(data).decode().splitlines() == want


def test_a_store_that_appends_gets_no_bytes(spark, tmp_path, many_lines, monkeypatch):
    rows, want = many_lines
    monkeypatch.setattr(files, "DRIVER_BYTES", 0)
    asked = []

    def concat(fs, target, parts):
        asked.append(len(parts))
        local = [str(p.toUri().getPath()) for p in (target, *parts)]
        with open(local[0], "ab") as f:
            for p in local[1:]:
                with open(p, "rb") as g:
                    f.write(g.read())
        os.path.exists(c := os.path.join(os.path.dirname(local[0]), f".{os.path.basename(local[0])}.crc")) and os.remove(c)
        return True

    monkeypatch.setattr(files, "_concatenated", concat)
    files.write_lines(rows, ["n"], str(tmp_path / "c.gz"), ["head"])
    assert read(tmp_path / "c.gz") == want and asked and asked[0] > 1
    monkeypatch.setattr(files, "_concatenated", lambda *x: False)
    monkeypatch.setattr(files, "_open_in_place", lambda path: None)
    with pytest.raises(OSError, match="ordered parts"):
        files.write_lines(rows, ["n"], str(tmp_path / "d.gz"))
    assert os.listdir(tmp_path) == ["c.gz"]


def test_many_inputs_are_one_table(spark, toy, tmp_path):
    """Jobs and scans do not grow with the inputs; known ones are not indexed again; a repeated input counts twice."""

    def run(paths, out):
        group = f"many-{len(paths)}-{out.name}-{len(os.listdir(out)) if out.exists() else 0}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            tx = commands.index_many(spark, paths, str(toy / "g.fa"), str(out))
            rows = sorted((r.source_file_id, r.tx_id, r.chrom, r.start, r.tx_type) for r in tx.collect())
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return tx, rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    for i in range(60):
        (tmp_path / f"i{i}.gtf").write_text(tx(f"t{i}", "g", "+", (100 + i % 7, 150), (201, 250)) + tx(f"u{i}", "g", "-", (500, 540 + i)))
    paths = [str(tmp_path / f"i{i}.gtf") for i in range(60)]
    _, few, jobs_few = run(paths[:4], tmp_path / "few")
    table, many, jobs_many = run(paths, tmp_path / "many")
    assert len(many) == 120 and [r[0] for r in many] == sorted([*range(60)] * 2) and few == many[:8] and many[0][1:] == ("t0", "chrT", 100, "ALL_CA")
    assert jobs_many < 1.5 * jobs_few  # stages that run by themselves, and listing of many files, vary a little
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") <= 2 and "Union" not in plan
    (tmp_path / "new.gtf").write_text(tx("n", "g", "+", (300, 400)))
    built = os.listdir(tmp_path / "many" / "manifest")
    again = [paths[5], str(tmp_path / "new.gtf"), paths[5], paths[59]]
    _, rows, _ = run(again, tmp_path / "many")
    assert [(r[0], r[1]) for r in rows] == [(0, "t5"), (0, "u5"), (1, "n"), (2, "t5"), (2, "u5"), (3, "t59"), (3, "u59")]
    assert len(os.listdir(tmp_path / "many" / "manifest")) > len(built)
    listed = spark.read.json(str(tmp_path / "many" / "manifest"))
    assert listed.count() == 61 and listed.filter("tx_cnt = 1").count() == 1
    with pytest.raises(FileNotFoundError):
        commands.index_many(spark, [str(tmp_path / "none.gtf")], str(toy / "g.fa"), str(tmp_path / "many"))
    (tmp_path / "empty.gtf").write_text("# nothing\n")
    with pytest.raises(ValueError, match="no transcript line"):
        commands.index_many(spark, [paths[0], str(tmp_path / "empty.gtf"), str(tmp_path / "new.gtf")], str(toy / "g.fa"), str(tmp_path / "other"))


def test_a_broken_build_leaves_nothing_that_is_read(spark, toy, tmp_path):
    (tmp_path / "a.gtf").write_text(tx("a", "g", "+", (100, 150), (201, 250)))
    out = tmp_path / "index"
    first = commands.index_many(spark, [str(tmp_path / "a.gtf")], str(toy / "g.fa"), str(out)).collect()
    for name in os.listdir(out / "manifest"):
        os.remove(out / "manifest" / name)  # as if the first build had broken off before its last step
    assert commands.index_many(spark, [str(tmp_path / "a.gtf")], str(toy / "g.fa"), str(out)).collect() == first


def test_reference_lines_must_be_there_once(spark, toy):
    """A repeated transcript line of the reference is an error, so is a transcript without one."""
    ref = (toy / "ref.gtf").read_text()
    line = next(x for x in ref.splitlines() if "\ttranscript\t" in x)
    for name, text, error in (("twice", ref + line + "\n", "repeated transcript lines.*R1"), ("none", ref.replace(line + "\n", ""), "transcripts without a line.*R1")):
        (toy / f"{name}.gtf").write_text(text)
        tx, lines = commands.index(spark, str(toy / f"{name}.gtf"), str(toy / "g.fa"))
        with pytest.raises(ValueError, match=error):
            gtf.check_reference(tx, lines)


def test_chromosomes_that_the_sequences_lack(spark, toy):
    text = (toy / "ref.gtf").read_text() + tx("far", "GF", "+", (5, 9)).replace("chrT", "chrX")
    (toy / "lack.gtf").write_text(text)
    path, fa = str(toy / "lack.gtf"), str(toy / "g.fa")
    for f in (lambda **k: commands.index(spark, path, fa, **k)[0], lambda **k: commands.index_many(spark, [path], fa, str(toy / "lack.many"), **k)):
        with pytest.raises(ValueError, match="absent from the sequences.*chrX"):
            f()
        assert sorted(r.tx_id for r in f(skip_missing=True).collect()) == ["R1", "R2", "R3"]
    info = json.loads((toy / "lack.gtf.index.info.json").read_text())
    assert info["missing_seqids"] == ["chrX"] and info["skipped_transcript_cnt"] == 1 and info["skipped_gene_cnt"] == 1


def test_index_stores_the_order_of_a_file(spark, toy):
    got = commands.index(spark, str(toy / "s2.gtf.gz"), str(toy / "g.fa"))[0].select("gidx", "tx_id").collect()
    assert [r.tx_id for r in sorted(got)] == ["p4", "p1", "p2", "p3"] and sorted(r.gidx for r in got) == [0, 1, 2, 3]


def rows_read(df):
    """(rows, rows that the scan handed on)."""
    rows = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, scan.metrics().get("numOutputRows").get().value()


def test_lookup_reads_the_row_groups_of_its_ids(spark, tmp_path, monkeypatch):
    n, group = 40_000, 10
    lines = spark.range(n).select(F.lit(0).alias("source_file_id"), F.concat(F.lit("T"), F.lpad(F.col("id") * 2, 9, "0")).alias("tx_id"), F.lit("g").alias("gene_name"), F.md5(F.col("id").cast("string")).alias("attrs"), F.lit(1).alias("lines"))
    path = str(tmp_path / "lines")
    commands.write_lines(lines.orderBy("attrs"), path, group_rows=group)
    stored, own = spark.read.parquet(path), random.Random(3)
    ids = [f"T{2 * k:09d}" for k in own.sample(range(n), 100)]
    got, read_ = rows_read(commands.lookup(stored, [*ids, ids[0], None, "T000000001", "other"]))
    assert sorted(r.tx_id for r in got) == sorted(ids) and read_ <= 0.05 * n
    # ids between two that are there: bounds hold them, Bloom filters don't
    got, read_ = rows_read(commands.lookup(stored, [f"T{2 * k + 1:09d}" for k in own.sample(range(n - 1), 100)]))
    assert not got and read_ <= 10 * group
    assert rows_read(commands.lookup(stored, ids[:1]))[1] == group
    assert commands.lookup(stored, []).count() == commands.lookup(stored, [None]).count() == 0
    monkeypatch.setattr(commands, "ASKED", 50)
    joined = commands.lookup(stored, ids)
    assert joined.columns == stored.columns and sorted(r.tx_id for r in joined.collect()) == sorted(ids)


def test_lookup_of_an_indexed_file(spark, toy, capsys):
    lines = commands.index(spark, str(toy / "ref.gtf"), str(toy / "g.fa"))[1]
    assert [(r.tx_id, r.gene_name) for r in commands.lookup(lines, ["R1", "R9"]).collect()] == [("R1", "Alpha")]
    cli.main(["lookup", str(toy / "ref.gtf"), "R3", "R2", "--fasta", str(toy / "g.fa")])
    assert [x.split("\t")[0] for x in capsys.readouterr().out.splitlines()] == ["R2", "R3"]


def block_gzip(data, size):
    """Members of at most ``size`` bytes each that tell their own length, and the empty one at the end."""
    out = b""
    for a in [*range(0, len(data), size), len(data)]:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(data[a : a + size]) + deflate.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[a : a + size]), len(data[a : a + size]))
    return out


@pytest.mark.parametrize("last", ["", "\n\n"])
def test_block_gzip_by_ranges(spark, tmp_path, last):
    r = random.Random(len(last))
    text = "\n".join(["é" * r.choice([0, 1, 3, 40, 900]) + str(i) for i in range(700)] + ["x" * 999] * 3) + last
    data = text.encode()
    (tmp_path / "b.gtf.gz").write_bytes(block_gzip(data, 1000))
    assert gzip.decompress((tmp_path / "b.gtf.gz").read_bytes()) == data
    want = text.removesuffix("\n").split("\n")
    rows = files._block_gzipped(spark, [(str(tmp_path / "b.gtf.gz"), 4)], 4000).collect()
    got = sorted(rows, key=lambda x: (x.line_no.block, x.line_no.n))
    assert [x.value for x in got] == want and {x.source_file_id for x in got} == {4} and len({x.line_no.block for x in got}) > 2


def test_ranges_of_blocks_share_no_line():
    r = random.Random(1)
    for _ in range(200):
        data = ("\n".join("y" * r.choice([0, 1, 2, 9, 60]) for _ in range(r.randint(0, 60))) + r.choice(["", "\n", "\n\n"])).encode()
        packed, size = block_gzip(data, r.choice([1, 3, 10, 50])), r.choice([1, 40, 100, 500])
        starts, at = [0], 0
        while at < len(packed):
            if at - starts[-1] >= size:
                starts.append(at)
            at += files.block_size(packed[at : at + 64])
        got = [x for a, z in zip(starts, [*starts[1:], len(packed)], strict=True) for part in files._range_lines(io.BytesIO(packed), a, z) for x in part]
        assert got == (data.removesuffix(b"\n").split(b"\n") if data else [])


def test_block_gzip_and_other_files_together(spark, tmp_path):
    texts = [f"a{i}\nb{i}\r\n" for i in range(4)]
    (tmp_path / "0.gtf").write_text(texts[0])
    (tmp_path / "1.gtf.gz").write_bytes(block_gzip(texts[1].encode(), 3))
    (tmp_path / "2.gtf.gz").write_bytes(gzip.compress(texts[2].encode()))
    (tmp_path / "3.gtf").write_bytes(block_gzip(texts[3].encode(), 2) + gzip.compress(b"tail"))
    rows = files.lines(spark, [str(tmp_path / n) for n in ("0.gtf", "1.gtf.gz", "2.gtf.gz", "3.gtf")]).orderBy("source_file_id", "line_no").collect()
    assert [(r.source_file_id, r.value) for r in rows] == [(i, f"{c}{i}") for i in range(4) for c in "ab"] + [(3, "tail")]
