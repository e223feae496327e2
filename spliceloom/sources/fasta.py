"""FASTA with its .fai index, as a table of chunks, and windows of bases by join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceloom.sources.files import qualified, status

CHUNK = 1 << 16


def index(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, length, offset, line_bases, line_width) from ``path``.fai; repeated sequences are an error."""
    if status(spark, f"{path}.fai") is None:
        raise FileNotFoundError(f"{path}.fai")
    fai = spark.read.csv(f"{path}.fai", sep="\t", schema="seqid string, length long, offset long, line_bases long, line_width long")
    if twice := fai.groupBy("seqid").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"repeated sequence {twice[0].seqid}")
    return fai


def chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(seqid, chunk, seq): pieces of ``chunk`` bases, each read by seeking through the index. The file is not compressed."""
    uri = qualified(spark, path)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk).cast("long"))
    todo = index(spark, path).filter("length > 0").select("*", F.explode(starts).alias("at")).repartition(F.col("seqid"), F.col("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(uri)
        with store.open_input_file(name) as f:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    stop = min(r["length"], r["at"] + chunk)
                    place = lambda p, r=r: r["offset"] + p // r["line_bases"] * r["line_width"] + p % r["line_bases"]
                    f.seek(place(r["at"]))
                    raw = f.read(place(stop - 1) + 1 - place(r["at"]))
                    out.append((r["seqid"], r["at"] // chunk, raw.replace(b"\n", b"").replace(b"\r", b"").decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [(), (), ()], (pa.string(), pa.int64(), pa.string()), strict=True)], names=["seqid", "chunk", "seq"])

    return todo.mapInArrow(read, "seqid string, chunk long, seq string")


def windows(wanted: DataFrame, table: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``seq`` to distinct (chrom, win_lo, win_hi), 0-based half-open; windows that leave the sequence get none."""
    w = wanted.select("chrom", "win_lo", "win_hi").distinct().filter("win_lo >= 0 and win_hi > win_lo")
    k = w.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("win_lo") / chunk), F.floor((F.col("win_hi") - 1) / chunk))))
    lo, hi = F.greatest(F.col("win_lo") - F.col("chunk") * chunk, F.lit(0)), F.least(F.col("win_hi") - F.col("chunk") * chunk, F.lit(chunk))
    cut = k.join(table.withColumnRenamed("seqid", "chrom"), ["chrom", "chunk"]).withColumn("part", F.substring(F.col("seq"), (lo + 1).cast("int"), (hi - lo).cast("int")))
    whole = cut.groupBy("chrom", "win_lo", "win_hi").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "").alias("seq"))
    return whole.filter(F.length("seq") == F.col("win_hi") - F.col("win_lo"))


def intron_sites(tx: DataFrame, table: DataFrame) -> DataFrame:
    """(chrom, l, r, left2, right2): the two bases inside either end of each distinct intron; one that leaves its sequence is an error."""
    j = tx.select("chrom", F.explode("junctions").alias("j")).select("chrom", "j.l", "j.r").distinct()
    need = j.select("chrom", F.col("l").alias("win_lo"), (F.col("l") + 2).alias("win_hi")).unionByName(j.select("chrom", (F.col("r") - 3).alias("win_lo"), (F.col("r") - 1).alias("win_hi")))
    got = windows(need, table).select("chrom", F.col("win_lo").alias("at"), "seq")
    left = got.withColumnRenamed("seq", "left2").withColumnRenamed("at", "l")
    right = got.select("chrom", (F.col("at") + 3).alias("r"), F.col("seq").alias("right2"))
    outside = F.raise_error(F.concat(F.lit("outside of the sequence: "), F.concat_ws(" ", "chrom", F.col("l").cast("string"), F.col("r").cast("string")))).cast("string")
    found = j.join(left, ["chrom", "l"], "left").join(right, ["chrom", "r"], "left")
    return found.select("chrom", "l", "r", F.coalesce("left2", outside).alias("left2"), F.coalesce("right2", outside).alias("right2"))
