"""The commands: index, merge, classify, chop, valtable. Files in, files out.

Indexed inputs are Parquet tables beside the input, with a manifest; an index whose manifest no
longer fits the digests of its inputs or this format's version is rebuilt.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceloom.functions import transcript as T
from spliceloom.operators import assemble, classify, context, merge
from spliceloom.sources import bed, fasta, files, gtf
from spliceloom.tools import attributes as X

PROGRAM, VERSION, INDEX_VERSION, SCHEMA_VERSION = "spliceloom", "0.1", 4, "1"
#: Columns of the outputs, in order (fixed formats).
TRACK = (
    "merged_tx_id", "merged_gene_id", "merged_start", "merged_end", "merged_strand", "merged_exon_num", "junction_policy", "tss_policy", "tes_policy", "src_tx_count_in_merged_group",
    "src_tx_id", "src_gene_id", "total_donor_diff", "total_acceptor_diff", "exon_diff", "src_file_name",
)
CLASSIFICATION = (
    "isoform_id", "chrom", "strand", "query_length", "query_exon_n", "structural_category", "subcategory", "ref_gene_id", "ref_gene_name", "ref_tx_id", "ref_length", "ref_exon_n", "ref_strand",
    "diff_to_tss", "diff_to_tes", "matched_junctions", "matched_exons", "bite", "all_canonical", "perc_a_downstream_tts", "seq_a_downstream_tts", "within_cage_peak", "dist_to_cage_peak",
    "within_poly_a_peak", "dist_to_poly_a_site",
)
#: Attributes that classify writes; older ones of these names are removed first.
RESERVED = ("ISOM_REF_TX_ID", "ISOM_REF_GENE_ID", "ISOM_REF_GENE_NAME", "ISOM_CATEGORY", "ISOM_SUBCATEGORY")


def base_name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def _command() -> str:
    return " ".join(a.replace("\\", "\\\\").replace('"', '\\"') for a in sys.argv)


def _version_line() -> str:
    return f'##ISOM <VERSION> version="{VERSION}"; program="{PROGRAM}"; schema="{SCHEMA_VERSION}"'


def index(spark: SparkSession, gtf_path: str, fasta_path: str, *, out: str | None = None, skip_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(transcripts, transcript lines) of a GTF, built or read back; statistics go to ``<out>.info.json``."""
    out = out or f"{gtf_path}.index"
    if files.status(spark, gtf_path) is None:
        raise FileNotFoundError(gtf_path)
    mark = {"version": INDEX_VERSION, "gtf": files.digest(spark, gtf_path), "fasta": files.digest(spark, fasta_path), "skip_missing": skip_missing}
    known = files.read_text(spark, f"{out}/manifest.json")
    if known is None or json.loads(known) != mark:
        rows = gtf.scan(spark, [gtf_path])
        gtf.check(rows)
        tx = assemble.transcripts(gtf.exon_rows(rows))
        seqs = fasta.index(spark, fasta_path).select(F.col("seqid").alias("chrom"))
        missing = tx.join(seqs, "chrom", "left_anti")
        gone = missing.groupBy("chrom").agg(F.count("*").alias("n"), F.countDistinct("gene_id").alias("g")).orderBy("chrom").collect()  # one row a chromosome
        if gone and not skip_missing:
            raise ValueError(f"chromosomes absent from the sequences: {[r.chrom for r in gone]}")
        tx = tx.join(seqs, "chrom", "left_semi")
        if odd := tx.filter(~T.junctions_valid(F.col("junctions"))).limit(5).collect():
            raise ValueError(f"exons that overlap: {[r.tx_id for r in odd]}")
        tx = assemble.with_sites(tx, fasta.intron_sites(tx, fasta.chunks(spark, fasta_path)))
        tx = with_order(tx)
        tx.repartition("chrom").sortWithinPartitions("chrom", "gidx").write.mode("overwrite").partitionBy("chrom").parquet(f"{out}/transcripts")
        write_lines(gtf.transcript_lines(rows), f"{out}/lines")
        stats = assemble.index_stats(spark.read.parquet(f"{out}/transcripts")).first().asDict()
        stats |= {"skipped_transcript_cnt": sum(r.n for r in gone), "skipped_gene_cnt": sum(r.g for r in gone), "missing_seqids": [r.chrom for r in gone]}
        files.write_text(spark, f"{out}.info.json", json.dumps(stats, indent=2, sort_keys=True))
        files.write_text(spark, f"{out}/manifest.json", json.dumps(mark))
    tx = spark.read.parquet(f"{out}/transcripts")
    return tx.withColumn("chrom", F.col("chrom").cast("string")), spark.read.parquet(f"{out}/lines")


#: Rows of a row group of the lines, and ids that are asked for as a filter; more are joined.
GROUP_ROWS, ASKED = 2000, 1000


def write_lines(lines: DataFrame, path: str, *, group_rows: int = GROUP_ROWS) -> None:
    """Transcript lines for lookups: sorted by ``tx_id`` over all files, in small row groups with a Bloom filter each.

    The order lets the bounds of row groups rule nearly all of them out, the filters rule out ids that are absent.
    """
    options = {"parquet.block.row.count.limit": group_rows, "parquet.bloom.filter.enabled#tx_id": "true", "parquet.bloom.filter.expected.ndv#tx_id": group_rows}
    lines.repartitionByRange("tx_id").sortWithinPartitions("tx_id").write.mode("overwrite").options(**options).parquet(path)


def lookup(lines: DataFrame, tx_ids: Sequence[str]) -> DataFrame:
    """The lines of the given ids; ids that are absent give none, repeated ones count once, null ones never.

    Up to ASKED ids are equalities that reach the row groups; more are a semi-join.
    """
    ids = sorted({i for i in tx_ids if i is not None})
    if not ids:
        return lines.filter(F.lit(False))
    if len(ids) > ASKED:
        return lines.join(lines.sparkSession.createDataFrame([(i,) for i in ids], "tx_id string"), "tx_id", "left_semi").select(*lines.columns)
    # equalities: a long list of values would reach the files as its two bounds only
    terms = [F.col("tx_id") == i for i in ids]
    while len(terms) > 1:  # a shallow tree
        terms = [a | b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) // 2 * 2 :]
    return lines.filter(terms[0])


def with_order(tx: DataFrame, step: int = 1 << 20) -> DataFrame:
    """Adds ``gidx``: the place of a transcript in the order of its file, from 0."""
    c = F.col
    coarse = [c("source_file_id"), c("chrom"), F.floor(c("start") / step)]
    return merge.numbered(tx, coarse, [c("start"), c("end"), T.strand_rank(c("strand")), c("tx_id"), c("gene_id")], "gidx").withColumn("gidx", c("gidx") - 1)


#: The table of many inputs: transcripts under the build and the digest of their file.
MANIFEST = "key string, build string, path string, tx_cnt long"


def index_many(spark: SparkSession, paths: Sequence[str], fasta_path: str, out: str, *, skip_missing: bool = False) -> DataFrame:
    """All inputs as one table, ``assemble.COLUMNS``; file ids in the order of ``paths``.

    Transcripts of any number of inputs stand in one table at ``out``, by chromosome, sorted by
    input. An input is known by the digest of its bytes and those of the sequences. Those that the
    manifest does not list are indexed together, so the number of jobs and of scans in a plan does
    not depend on the number of inputs; the manifest has one row for each, written last: a build
    that breaks off leaves rows that nothing reads.
    """
    if absent := [p for p in paths if files.status(spark, p) is None]:
        raise FileNotFoundError(absent[0])
    *shas, sequences = files.digests(spark, [*paths, fasta_path])
    keys = [f"{INDEX_VERSION}-{sequences[:32]}-{int(skip_missing)}-{s}" for s in shas]
    manifest = lambda: spark.read.schema(MANIFEST).json(f"{out}/manifest") if files.status(spark, f"{out}/manifest") else spark.createDataFrame([], MANIFEST)
    wanted = spark.createDataFrame(list(zip(keys, range(len(keys)), strict=True)), "key string, source_file_id int")
    known = {r.key for r in manifest().join(F.broadcast(wanted), "key", "left_semi").select("key").distinct().collect()}  # one row an input
    todo = {k: p for k, p in zip(keys, paths, strict=True) if k not in known}
    if todo:
        build = uuid.uuid4().hex
        rows = gtf.scan(spark, list(todo.values()))
        gtf.check(rows, len(todo))
        tx = assemble.transcripts(gtf.exon_rows(rows))
        seqs = fasta.index(spark, fasta_path).select(F.col("seqid").alias("chrom"))
        if not skip_missing and (gone := tx.join(seqs, "chrom", "left_anti").select("chrom").distinct().orderBy("chrom").collect()):
            raise ValueError(f"chromosomes absent from the sequences: {[r.chrom for r in gone]}")
        tx = tx.join(seqs, "chrom", "left_semi")
        if odd := tx.filter(~T.junctions_valid(F.col("junctions"))).limit(5).collect():
            raise ValueError(f"exons that overlap: {[r.tx_id for r in odd]}")
        tx = assemble.with_sites(tx, fasta.intron_sites(tx, fasta.chunks(spark, fasta_path)))
        names = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(todo.items())], "source_file_id int, key string, path string")
        tx = tx.join(F.broadcast(names), "source_file_id").select(*(c for c in assemble.COLUMNS if c != "source_file_id"), "key", F.lit(build).alias("build"))
        order = ["chrom", "key", "start", "end", "strand", "tx_id"]
        tx.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("chrom").parquet(f"{out}/transcripts")
        counts = spark.read.parquet(f"{out}/transcripts").filter(F.col("build") == build).groupBy("key").agg(F.count("*").alias("tx_cnt"))
        lines = names.join(counts, "key", "left").select("key", F.lit(build).alias("build"), "path", F.coalesce("tx_cnt", F.lit(0)).alias("tx_cnt"))
        lines.coalesce(1).write.mode("append").json(f"{out}/manifest")
    # an input that two builds indexed at the same time is taken from one of them
    places = manifest().groupBy("key").agg(F.min("build").alias("build")).join(F.broadcast(wanted), "key")
    tx = spark.read.parquet(f"{out}/transcripts").withColumn("chrom", F.col("chrom").cast("string"))
    return tx.join(F.broadcast(places), ["key", "build"]).select(*assemble.COLUMNS)


def merge_files(
    spark: SparkSession, inputs: Sequence[str], fasta_path: str, prefix: str, options: merge.MergeOptions = merge.MergeOptions(), *, guide_tss: str | None = None, guide_tes: str | None = None,
    alias: str | None = None, skip_missing: bool = False, parts: bool = False, index_dir: str | None = None,
) -> dict:
    """Writes the merged GTF, the track and presence tables and the statistics; returns the latter.

    ``parts``: folders of ordered parts, see ``files.write_lines``. ``index_dir``: the table of
    ``index_many``, beside the first input if not given.
    """
    tx = index_many(spark, inputs, fasta_path, index_dir or f"{inputs[0].rpartition('/')[0] or '.'}/{PROGRAM}.index", skip_missing=skip_missing)
    read = lambda p: bed.guide(spark, p) if p else None
    groups, members = merge.merge(tx, options, guide_tss=read(guide_tss), guide_tes=read(guide_tes), alias=bed.aliases(spark, alias) if alias else None)
    groups = merge.with_ids(groups, members)
    rows = merge.track(groups, members)
    names = spark.createDataFrame([(i, base_name(p)) for i, p in enumerate(inputs)], "source_file_id int, src_file_name string")
    rows = rows.join(F.broadcast(names), "source_file_id")  # one row an input
    order = ["tx_no", "source_file_id", "src_start", "src_end", "src_tx_id"]
    files.write_lines(rows.select(*order, F.concat_ws("\t", *TRACK).alias("line")), order, f"{prefix}.track.tsv.gz", ["\t".join(TRACK)], parts=parts)

    wide = merge.present_in(rows).withColumn("tx_no", F.substring_index("merged_tx_id", "_", -1).cast("long"))
    cells = F.transform("files", lambda i: F.struct(i.alias("at"), F.lit("1").alias("value")))
    line = F.concat_ws("\t", *merge.PRESENT_KEYS, X.filled_line(cells, len(inputs), "0"))
    files.write_lines(wide.select("tx_no", line.alias("line")), ["tx_no"], f"{prefix}.present_absent.tsv.gz", ["\t".join([*merge.PRESENT_KEYS, *(base_name(p) for p in inputs)])], parts=parts)

    source = T.source_text(*(F.col(c) for c in ("source_file_id", "src_tx_id", "src_start", "src_end", "src_tx_type", "total_donor_diff", "total_acceptor_diff", "exon_diff")))
    src = rows.groupBy("merged_tx_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_file_id", "src_start", "src_end", "src_tx_id", source.alias("text")))), lambda x: x["text"]), "|").alias("src"))
    g = groups.join(src, "merged_tx_id")
    text = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c))
    own = text('gene_id "', F.col("merged_gene_id"), '"; transcript_id "', F.col("merged_tx_id"), '"; ')
    head = lambda kind, s, e: F.concat_ws("\t", "chrom", F.lit(PROGRAM), F.lit(kind), s, e, F.lit("."), "strand", F.lit("."))
    policy = F.concat_ws(":", "junction_policy", "tss_policy", "tes_policy")
    t = g.select("tx_no", F.lit(0).alias("nth"), text(head("transcript", F.col("repr_start"), F.col("repr_end")), "\t", own, 'ISOM_EXONS "', F.col("n_exons").cast("string"), '"; ISOM_COUNT "', F.col("tx_count").cast("string"), '"; ISOM_SRC "', F.col("src"), '"; ISOM_REPR_POLICY "', policy, '";').alias("line"))
    x = g.select("*", F.posexplode(T.exons_of(F.col("repr_start"), F.col("repr_end"), F.col("repr_junctions"))).alias("pos", "x"))
    x = x.select("tx_no", (F.col("pos") + 1).alias("nth"), text(head("exon", F.col("x.start"), F.col("x.end")), "\t", own, 'exon_number "', (F.col("pos") + 1).cast("string"), '";').alias("line"))
    escape = lambda p: p.replace("\\", "\\\\").replace('"', '\\"')
    header = [_version_line(), *(f'##ISOM <SAMPLE> id="S{i + 1}"; input="{escape(p)}";' for i, p in enumerate(inputs))]
    header += [
        '##ISOM <FORMAT> ID="ISOM_EXONS"; Description="exons of this transcript";', '##ISOM <FORMAT> ID="ISOM_COUNT"; Description="source transcripts merged into this one";',
        '##ISOM <FORMAT> ID="ISOM_SRC"; Description="source records S#:tx_id:start:end:tx_type:donor_diff:acceptor_diff:exon_diffs, joined by |";',
        '##ISOM <FORMAT> ID="ISOM_REPR_POLICY"; Description="how junctions, TSS and TES were chosen, NA where none apply";', f"##ISOM <COMMAND> cmd={_command()}",
    ]
    files.write_lines(t.unionByName(x), ["tx_no", "nth"], f"{prefix}.merged.gtf.gz", header, parts=parts)

    stats = merge.merge_stats(groups, members).first().asDict()
    stats["source_tx_cnt_per_merged_tx"] = {str(r.group_size): r.merged_tx_cnt for r in merge.group_size_histogram(groups).orderBy("group_size").collect()}
    files.write_text(spark, f"{prefix}.merged_info.json", json.dumps(stats, indent=2))
    return stats


def classify_files(
    spark: SparkSession, query_path: str, ref_path: str, fasta_path: str, prefix: str, options: classify.ClassifyOptions = classify.ClassifyOptions(), *, cage: str | None = None, polya: str | None = None, skip_missing: bool = False,
    parts: bool = False,
) -> dict:
    """Writes the classification table, the annotated GTF and the statistics; returns the latter."""
    query, _ = index(spark, query_path, fasta_path, skip_missing=skip_missing)
    ref, ref_lines = index(spark, ref_path, fasta_path, skip_missing=skip_missing)
    gtf.check_reference(ref, ref_lines)
    ref = ref.join(ref_lines.select("source_file_id", "tx_id", "gene_name"), ["source_file_id", "tx_id"], "left")
    done = classify.classify(query, ref, options)
    seqs = fasta.index(spark, fasta_path).select(F.col("seqid").alias("chrom"), F.col("length").alias("chrom_len"))
    w = context.downstream_window(done.join(seqs, "chrom", "left"), options.downstream_len, F.col("chrom_len"))
    got = fasta.windows(w, fasta.chunks(spark, fasta_path))
    done = context.downstream_context(w.join(got, ["chrom", "win_lo", "win_hi"], "left"), options.downstream_len)
    done = context.cage_peaks(done, bed.guide(spark, cage) if cage else None, options.guide_tss_flank)
    done = context.polya_peaks(done, bed.guide(spark, polya) if polya else None, options.guide_tes_flank).withColumn("isoform_id", F.col("tx_id"))
    shown = {c: T.shown(F.col(c)) for c in CLASSIFICATION} | {"perc_a_downstream_tts": T.shown(F.format_string("%.4f", F.col("perc_a_downstream_tts"))), "bite": F.col("bite").cast("string")}
    shown["perc_a_downstream_tts"] = F.when(F.col("perc_a_downstream_tts").isNull(), "NA").otherwise(shown["perc_a_downstream_tts"])
    order = ["chrom", "start", "end", T.strand_rank(F.col("strand")).alias("strand_rank"), "tx_id"]
    line = F.concat_ws("\t", *(shown[c] for c in CLASSIFICATION)).alias("line")
    files.write_lines(done.select(*order, line), ["chrom", "start", "end", "strand_rank", "tx_id"], f"{prefix}.classification.txt.gz", ["\t".join(CLASSIFICATION)], parts=parts)

    # annotated GTF: the transcript's attributes, less older ones of ours, on the transcript and on its exons
    raw = gtf.transcript_lines(gtf.scan(spark, [query_path])).select("tx_id", "attrs")
    other = F.filter(gtf.parts(F.coalesce("attrs", F.lit(""))), lambda a: ~F.regexp_like(a, F.lit(f"^({'|'.join(RESERVED)})")))
    new = [F.concat(F.lit(f'{k} "'), T.escaped(T.shown(F.col(c))), F.lit('"')) for k, c in zip(RESERVED, ("ref_tx_id", "ref_gene_id", "ref_gene_name", "structural_category", "subcategory"), strict=True)]
    attrs = F.concat(F.array_join(F.concat(other, F.array(*new)), "; "), F.lit(";"))
    full = done.join(query.select("source_file_id", "tx_id", "exons"), ["source_file_id", "tx_id"]).join(raw, "tx_id", "left").withColumn("attr_line", attrs)
    spans = F.concat(F.array(F.struct(F.lit("transcript").alias("kind"), F.col("start").alias("s"), F.col("end").alias("e"))), F.transform("exons", lambda x: F.struct(F.lit("exon").alias("kind"), x["start"].alias("s"), x["end"].alias("e"))))
    rows = full.select(*order, "attr_line", "strand", F.posexplode(spans).alias("nth", "x"))
    rows = rows.withColumn("line", F.concat_ws("\t", "chrom", F.lit(PROGRAM), "x.kind", "x.s", "x.e", F.lit("."), "strand", F.lit("."), "attr_line"))
    files.write_lines(rows, ["chrom", "start", "end", "strand_rank", "tx_id", "nth"], f"{prefix}.annotated.gtf.gz", _header(spark, query_path), parts=parts)

    by = done.groupBy("structural_category", "subcategory").agg(F.count("*").alias("n")).collect()  # at most the vocabulary of categories
    totals = done.agg(F.count("*").alias("query_tx_cnt"), F.count_if(F.col("query_exon_n") == 1).alias("mono_exon_tx_cnt"), F.count_if("all_canonical").alias("all_canonical_tx_cnt"), F.count_if(F.col("within_cage_peak")).alias("within_cage_peak_cnt"), F.count_if(F.col("within_poly_a_peak")).alias("within_poly_a_peak_cnt")).first().asDict()
    stats = totals | {"reference_tx_cnt": ref.filter("strand <> '.'").count(), "categories": {}, "subcategories": {}}
    for r in sorted(by):
        stats["categories"][r.structural_category] = stats["categories"].get(r.structural_category, 0) + r.n
        stats["subcategories"][f"{r.structural_category}/{r.subcategory}"] = r.n
    files.write_text(spark, f"{prefix}.classify_info.json", json.dumps(stats, indent=2, sort_keys=True))
    return stats


def _header(spark, path: str) -> list[str]:
    """Leading comment lines, then the lines about our attributes that are missing among them."""
    body = files.lines(spark, [path])
    first = body.filter(~F.col("value").startswith("#")).agg(F.min("line_no")).first()[0]
    lead = body.filter(F.col("value").startswith("#"))
    if first is not None:
        lead = lead.filter((F.col("line_no.block") < first["block"]) | ((F.col("line_no.block") == first["block"]) & (F.col("line_no.n") < first["n"])))
    out = [r.value for r in lead.orderBy("line_no").select("value").collect()]  # the header of one file
    if not any(h.startswith("##ISOM <VERSION>") for h in out):
        out.append(_version_line())
    out += [f'##ISOM <FORMAT> ID="{k}"; Description="set by classification";' for k in RESERVED if not any(f'ID="{k}"' in h for h in out)]
    return [*out, f"##ISOM <COMMAND> cmd={_command()}"]


def chop(spark: SparkSession, path: str, prefix: str, *, keep: Sequence[str] = (), everything: bool = False, check_case: bool = False, parts: bool = False) -> None:
    rows = files.lines(spark, [path], ends=True)
    files.write_lines(rows.select("line_no", X.chop_lines(F.col("value"), keep=keep, everything=everything, check_case=check_case).alias("line")), ["line_no"], f"{prefix}.chopped.gtf.gz", parts=parts)


def valtable(spark: SparkSession, merged_path: str, inputs: Sequence[str], attribute: str, prefix: str, *, default: str = "0.0", parts: bool = False) -> dict:
    """Writes one column per input with an attribute of the source transcripts; returns the statistics."""
    body = files.lines(spark, [merged_path])
    head = body.filter(F.col("value").startswith("##ISOM"))
    if not head.limit(1).collect():
        raise ValueError(f"{merged_path} is no merged file: it has no ##ISOM lines")
    sample = head.filter(F.col("value").startswith("##ISOM <SAMPLE>")).select(F.regexp_extract("value", r'id="S*(\d+)"', 1).try_cast("int").alias("id"), F.regexp_extract("value", r'input="([^"]*)"', 1).alias("path"))
    samples = {r.id: base_name(r.path) for r in sample.filter("id > 0 and path <> ''").collect()}  # one row an input
    rows = gtf.scan(spark, [merged_path]).filter("feature = 'transcript'")
    merged = rows.select(gtf.attribute(F.col("attrs"), "transcript_id").alias("merged_tx_id"), gtf.attribute(F.col("attrs"), "ISOM_SRC").alias("src"), "line_no")
    found = [(min(i for i, n in samples.items() if n == base_name(p)), p) for p in inputs if base_name(p) in samples.values()]
    pairs = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(found)], "source_file_id int, file_id int")
    src = gtf.scan(spark, [p for _, p in found]).filter("feature = 'transcript'").join(F.broadcast(pairs), "source_file_id")
    src = src.select("file_id", gtf.attribute(F.col("attrs"), "transcript_id").alias("src_tx_id"), gtf.attribute(F.col("attrs"), attribute).alias("value"), "line_no").filter("src_tx_id <> ''")
    joined = X.value_rows(X.projection(merged), src)
    order = merged.select(F.col("merged_tx_id").alias("transcript_id"), "line_no")
    line = F.col("transcript_id") if not found else F.concat_ws("\t", "transcript_id", X.filled_line(F.col("cells"), len(found), default))
    wide = X.value_cells(merged, joined, [i for i, _ in found]).join(order, "transcript_id").select("line_no", line.alias("line"))
    files.write_lines(wide, ["line_no"], f"{prefix}.valtable.tsv.gz", ["\t".join(["transcript_id", *(base_name(p) for _, p in found)])], parts=parts)
    stats = {"merged_tx_count": merged.count(), "merged_gtf_sample_count": len(samples), "per_file": {samples[r.file_id]: {k: r[k] for k in ("extracted", "attr_missing", "src_tx_not_in_merged")} for r in X.value_stats(joined).collect()}}
    files.write_text(spark, f"{prefix}.valtable_stats.json", json.dumps(stats, indent=2))
    return stats
