"""python -m spliceloom.cli index | lookup | merge | classify | tools chop | tools valtable"""

from __future__ import annotations

import argparse
from dataclasses import fields

from spliceloom import session
from spliceloom.operators.classify import ClassifyOptions
from spliceloom.operators.merge import MergeOptions
from spliceloom.plans import commands


def _options(parser: argparse.ArgumentParser, kind) -> None:
    for f in fields(kind):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)


def _picked(args: argparse.Namespace, kind):
    return kind(**{f.name: getattr(args, f.name) for f in fields(kind)})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spliceloom")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("gtf")
    i.add_argument("--out")
    f = sub.add_parser("lookup", help="print the attributes of some transcripts of an indexed file")
    f.add_argument("gtf")
    f.add_argument("ids", nargs="+")
    f.add_argument("--out")
    m = sub.add_parser("merge")
    m.add_argument("inputs", nargs="+")
    m.add_argument("--guide-tss")
    m.add_argument("--guide-tes")
    m.add_argument("--chrmap")
    m.add_argument("--index-dir")
    _options(m, MergeOptions)
    c = sub.add_parser("classify")
    c.add_argument("query")
    c.add_argument("--ref", required=True)
    c.add_argument("--cage")
    c.add_argument("--polya")
    _options(c, ClassifyOptions)
    for x in (i, f, m, c):
        x.add_argument("--fasta", required=True)
        x.add_argument("--skip-missing-ref-chr", action="store_true")
    t = sub.add_parser("tools").add_subparsers(dest="tool", required=True)
    h, v = t.add_parser("chop"), t.add_parser("valtable")
    h.add_argument("input")
    h.add_argument("-k", "--keep-attrs", default="")
    h.add_argument("-c", "--keep-check-case", action="store_true")
    h.add_argument("--mode", choices=("own", "all"), default="own")
    v.add_argument("merged")
    v.add_argument("inputs", nargs="+")
    v.add_argument("--attr-val", required=True)
    v.add_argument("--default-val", default="0.0")
    for x in (m, c, h, v):
        x.add_argument("-o", "--prefix", required=True)
        x.add_argument("--parts", action="store_true", help="folders of ordered parts instead of single files")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session.build(a.master)
    if a.command == "index":
        commands.index(spark, a.gtf, a.fasta, out=a.out, skip_missing=a.skip_missing_ref_chr)
    elif a.command == "lookup":
        lines = commands.index(spark, a.gtf, a.fasta, out=a.out, skip_missing=a.skip_missing_ref_chr)[1]
        for r in commands.lookup(lines, a.ids).orderBy("tx_id").toLocalIterator():
            print(r.tx_id, r.attrs, sep="\t")
    elif a.command == "merge":
        print(commands.merge_files(spark, a.inputs, a.fasta, a.prefix, _picked(a, MergeOptions), guide_tss=a.guide_tss, guide_tes=a.guide_tes, alias=a.chrmap, skip_missing=a.skip_missing_ref_chr, parts=a.parts, index_dir=a.index_dir))
    elif a.command == "classify":
        print(commands.classify_files(spark, a.query, a.ref, a.fasta, a.prefix, _picked(a, ClassifyOptions), cage=a.cage, polya=a.polya, skip_missing=a.skip_missing_ref_chr, parts=a.parts))
    elif a.tool == "chop":
        commands.chop(spark, a.input, a.prefix, keep=a.keep_attrs.split(","), everything=a.mode == "all", check_case=a.keep_check_case, parts=a.parts)
    else:
        print(commands.valtable(spark, a.merged, a.inputs, a.attr_val, a.prefix, default=a.default_val, parts=a.parts))


if __name__ == "__main__":
    main()
