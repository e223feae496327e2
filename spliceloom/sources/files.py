"""Files by Hadoop paths: sizes, first bytes, ordered lines in, ordered compressed lines out."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toString()


def status(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(bytes, modification time), or None where there is no such file."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    s = fs.getFileStatus(p)
    return s.getLen(), s.getModificationTime()


def head(spark: SparkSession, path: str, n: int) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        out = []
        while len(out) < n and (b := stream.read()) >= 0:
            out.append(b)
        return bytes(out)
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file whole."""
    s = status(spark, path)
    return None if s is None else head(spark, path, s[0]).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, computed as a stream."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def digests(spark: SparkSession, paths: list[str]) -> list[str]:
    """SHA-256 of the bytes of each file, computed by tasks, one a file; a file that is not there is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for uri, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, name = fs.FileSystem.from_uri(uri)
                sha = hashlib.sha256()
                with store.open_input_stream(name) as f:
                    while held := f.read(1 << 22):
                        sha.update(held)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sha.hexdigest()])], names=["i", "sha"])

    todo = spark.createDataFrame([(qualified(spark, p), i) for i, p in enumerate(paths)], "path string, i int")
    got = todo.repartition(min(len(paths), 1024), "i").mapInArrow(run, "i int, sha string").collect()  # one row a file
    return [r.sha for r in sorted(got)]


def _misnamed(spark: SparkSession, paths: list[tuple[str, int]]) -> DataFrame:
    """(source_file_id, line_no, value) of files whose names don't tell whether they are compressed; one task a file, as for any gzip file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for uri, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as raw:
                    zipped = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    n = 0
                    with gzip.open(raw) if zipped else io.BufferedReader(raw) as f:
                        while held := f.readlines(1 << 22):
                            text = [x.removesuffix(b"\n").decode() for x in held]
                            no = pa.StructArray.from_arrays([pa.array([0] * len(held), pa.int64()), pa.array(range(n, n + len(held)), pa.int64())], names=["block", "n"])
                            n += len(held)
                            yield pa.RecordBatch.from_arrays([pa.array([i] * len(held), pa.int32()), no, pa.array(text)], names=["source_file_id", "line_no", "value"])

    todo = spark.createDataFrame([(qualified(spark, p), i) for p, i in paths], "path string, i int").repartition(len(paths), "i")
    return todo.mapInArrow(read, "source_file_id int, line_no struct<block:bigint,n:bigint>, value string")


#: Compressed bytes of a range of a block-gzipped file.
RANGE = 16 << 20


def block_size(header: bytes) -> int | None:
    """Bytes of the member that begins with these 18 bytes or more, where it says so itself: block gzip, field BC."""
    if len(header) < 18 or header[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + int.from_bytes(header[10:12], "little")
    while at + 6 <= min(end, len(header)):
        size = int.from_bytes(header[at + 2 : at + 4], "little")
        if header[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(header[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def _members(f, start: int) -> Iterator[tuple[int, bytes]]:
    """(place of its member, bytes) of a gzip file from a member on."""
    f.seek(start)
    place, read, held = start, start, b""
    inflate = zlib.decompressobj(31)
    while True:
        if not held:
            held = f.read(1 << 18)
            read += len(held)
            if not held:
                return
        if inflate.eof:
            place, inflate = read - len(held), zlib.decompressobj(31)
        out = inflate.decompress(held)
        held = inflate.unused_data
        if out:
            yield place, out


def _range_lines(f, start: int, end: int) -> Iterator[list[bytes]]:
    """Lines that begin behind the first line end of a range, or at the start of the file, up to the first line end behind the range."""
    rest, skips = b"", start > 0
    for place, data in _members(f, start):
        if place >= end:
            cut = data.find(b"\n")
            rest += data if cut < 0 else data[: cut + 1]
            if skips or cut >= 0:
                break
            continue
        rest += data
        if skips:
            cut = rest.find(b"\n")
            rest, skips = (b"", True) if cut < 0 else (rest[cut + 1 :], False)
        if len(rest) >= 1 << 20 and (cut := rest.rfind(b"\n")) >= 0:
            yield rest[:cut].split(b"\n")
            rest = rest[cut + 1 :]
    if rest and not skips:
        yield rest.removesuffix(b"\n").split(b"\n")


def _block_gzipped(spark: SparkSession, paths: list[tuple[str, int]], size: int = RANGE) -> DataFrame:
    """(source_file_id, line_no, value) of block-gzipped files, by ranges of blocks.

    One task a file hops from block to block, reading their headers only, and cuts ranges.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for uri, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    at, starts, end = 0, [0], f.size()
                    # a member that does not tell its size ends the hops: the last range reads on
                    while at < end and (step := block_size(f.read_at(min(64, end - at), at))):
                        if at - starts[-1] >= size:
                            starts.append(at)
                        at += step
                ends = [*starts[1:], end]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(starts)), pa.array([i] * len(starts), pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["path", "i", "start", "end"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for uri, i, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    n = 0
                    for held in _range_lines(f, start, end):
                        no = pa.StructArray.from_arrays([pa.array([start] * len(held), pa.int64()), pa.array(range(n, n + len(held)), pa.int64())], names=["block", "n"])
                        n += len(held)
                        yield pa.RecordBatch.from_arrays([pa.array([i] * len(held), pa.int32()), no, pa.array([x.decode() for x in held])], names=["source_file_id", "line_no", "value"])

    todo = spark.createDataFrame([(qualified(spark, p), i) for p, i in paths], "path string, i int").repartition(min(len(paths), 1024), "i")
    ranges = todo.mapInArrow(cut, "path string, i int, start long, end long")
    parts = max(spark.sparkContext.defaultParallelism, sum(status(spark, p)[0] // size + 1 for p, _ in paths))
    return ranges.repartition(parts, "i", "start").mapInArrow(read, "source_file_id int, line_no struct<block:bigint,n:bigint>, value string")


def lines(spark: SparkSession, paths: list[str], *, ends: bool = False) -> DataFrame:
    """(source_file_id, line_no, value): file ids in the order of ``paths``; line_no orders the lines of a file.

    Lines end with a newline; a carriage return before it goes unless ``ends`` keeps it. Whether a
    file is gzip follows from its content, whatever its name; block gzip is read by ranges.
    """
    by_name, odd, blocks = [], [], []
    for i, p in enumerate(paths):
        first = head(spark, p, 64)
        zipped = first[:2] == b"\x1f\x8b"
        (blocks if block_size(first) else by_name if zipped == p.endswith(".gz") else odd).append((p, i))
    out = None
    if by_name:
        ids = spark.createDataFrame([(qualified(spark, p), i) for p, i in by_name], "_path string, source_file_id int")
        number = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("line_no")
        raw = spark.read.option("lineSep", "\n").text([p for p, _ in by_name]).select("value", F.col("_metadata.file_path").alias("_p"), number)
        plain = lambda c: F.regexp_replace(F.url_decode(c), "^([a-z0-9]+):/+", "$1:/")
        # one row a file: bounded by the arguments of the call
        out = raw.join(F.broadcast(ids), plain(F.col("_p")) == plain(F.col("_path"))).select("source_file_id", "line_no", "value")
    for some, reader in ((odd, _misnamed), (blocks, _block_gzipped)):
        if some:
            out = reader(spark, some) if out is None else out.unionByName(reader(spark, some))
    return out if ends else out.withColumn("value", F.regexp_replace("value", "\r$", ""))


#: Bytes of parts, at most, that the driver itself appends to each other.
DRIVER_BYTES = 1 << 20


def _open_in_place(path: str) -> str | None:
    """The local name of a path that every process can open for writing in place, None elsewhere."""
    return path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:/") else None


def _concatenated(fs, target, parts: list) -> bool:
    """Append ``parts`` to ``target`` inside the store, where it can; no byte is read."""
    try:
        fs.concat(target, parts)
    except UnsupportedOperationException:
        return False
    return True


def _placed(spark: SparkSession, target: str, parts: list[tuple[str, int]]) -> None:
    """Copy each part to its place in ``target`` by tasks, side by side; a repeated task writes the same bytes again."""
    rows, at = [], 0
    for name, size in parts:
        rows.append((name, at, size))
        at += size
    with open(target, "wb") as f:
        f.truncate(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open(name, "rb") as source, open(target, "r+b") as f:
                    f.seek(at)
                    while held := source.read(1 << 20):
                        f.write(held)
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["size"])

    todo = spark.createDataFrame(rows, "name string, at long, size long").repartition(len(rows), "at")
    if (done := todo.mapInArrow(run, "size long").agg(F.sum("size")).first()[0]) != at:
        raise OSError(f"{target}: {done} of {at} bytes written")


def write_lines(rows: DataFrame, order: list, path: str, header: list[str] = (), *, parts: bool = False) -> None:
    """Write column ``line`` in ``order``, gzip-compressed.

    Parts are sorted and compressed in parallel by Spark's writer, whose commit names those that
    count. With ``parts`` they stay a folder at ``path``: the header's file and the parts, in order
    of their names and as ``_manifest.json`` lists them with their bytes; one after another they
    are the single file. Else they become one file, members of a gzip file following one another:
    the store appends them where it can (``concat``), on a shared file system tasks copy each part
    to its place. The driver handles names and sizes, and bytes only up to ``DRIVER_BYTES``. In
    any other store a single file would need a stream through one process: that is an error, to be
    met with ``parts``.
    """
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    target = target.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{target.toString()}.parts-{uuid.uuid4().hex}")
    try:
        # rangewise, so that the order of the parts is the order of the lines
        rows.orderBy(*order).select("line").write.option("compression", "gzip").text(folder.toString())
        if header:
            _write_bytes(fs, hadoop(folder, "header-00000.gz"), gzip.compress("".join(f"{h}\n" for h in header).encode()))
        found = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(folder))
        found = [(n, size) for n, size in found if n.startswith(("header-", "part-")) and size]
        if not parts:
            whole = hadoop(folder, "whole")
            _compose(spark, fs, folder, whole, found)
        elif found:
            _write_bytes(fs, hadoop(folder, "_manifest.json"), json.dumps([{"name": n, "bytes": size} for n, size in found]).encode())
        fs.delete(target, True)
        if not fs.rename(folder if parts else whole, target):
            raise OSError(f"{path}: cannot be put in place")
    finally:
        fs.delete(folder, True)


def _write_bytes(fs, path, data: bytes) -> None:
    out = fs.create(path, True)
    out.write(bytearray(data))
    out.close()


def _compose(spark: SparkSession, fs, folder, whole, found: list[tuple[str, int]]) -> None:
    """One file of the parts of a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    local = _open_in_place(folder.toString())
    if sum(size for _, size in found) <= DRIVER_BYTES:
        out = fs.create(whole, True)
        try:
            for name, _ in found:
                stream = fs.open(hadoop(folder, name))
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                stream.close()
        finally:
            out.close()
        return
    array = spark.sparkContext._gateway.new_array(hadoop, len(found) - 1)
    for i, (name, _) in enumerate(found[1:]):
        array[i] = hadoop(folder, name)
    first = hadoop(folder, found[0][0])
    if _concatenated(fs, first, array):
        fs.rename(first, whole)
    elif local:
        _placed(spark, f"{local}/whole", [(f"{local}/{name}", size) for name, size in found])
    else:
        raise OSError(f"{folder.getParent().toString()} appends no files inside the store: write ordered parts")
