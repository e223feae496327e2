"""Token ids in directly addressable codes.

A code word splits an id into chunks, lowest bits first, one chunk a level. Level 0 holds the
first chunk of every id; a bit behind each chunk says whether the id goes on at the next level.
The place of the continuation is the rank of that bit, which a directory of counts gives at
once, so any single token is read without decoding others.

A file (little-endian): magic ``DAC1``, format fields, the document table (ids and first tokens),
then for each level its chunks, its continuation bitmap and its rank directory.

``write_token_files`` puts files into a folder that driver and executors share, in ascending
order of document ids over the files; ``read_token_files`` reads them back through Spark.

Defined results: null and empty texts are documents of the end id alone. Repeated ids are
documents each, ordered by a hash of their text; null ids come first. Other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.llm.textio import documents
from spliceloom.llm.words import encoder, slices
from spliceloom.session import work_dir, written

#: Bits of the chunks of level 0, 1, ...; the last repeats as needed.
WIDTHS = (8, 8)
#: Bits between the counts of a rank directory.
RANK_STEP = 512
#: A file is closed once it holds this many tokens.
FILE_TOKENS = 4_000_000
#: Rows of the per-file offset table that may be broadcast.
BROADCAST_ROWS = 100_000
NULL_ID = -(2**63)


class Dac:
    """A sequence of ids; build with ``Dac.of``, read with ``get`` and ``all``."""

    def __init__(self, n: int, widths: list[int], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]):
        self.n, self.widths, self.levels = n, widths, levels

    @classmethod
    def of(cls, ids: np.ndarray, widths=WIDTHS) -> Dac:
        rest, levels, used = np.asarray(ids, np.uint64), [], []
        while True:
            w = widths[min(len(levels), len(widths) - 1)]
            chunk = rest & np.uint64((1 << w) - 1)
            more = (rest >> np.uint64(w)) > 0
            levels.append((_packed(chunk, w), np.packbits(more, bitorder="little"), _directory(more), len(rest)))
            used.append(w)
            rest = rest[more] >> np.uint64(w)
            if not len(rest):
                return cls(len(ids), used, levels)

    def get(self, i: int) -> int:
        """The id at place i, by one chunk and one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for w, (chunks, bits, counts, _) in zip(self.widths, self.levels, strict=True):
            value |= _chunk(chunks, w, i) << shift
            shift += w
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_STEP
            whole, part = divmod(i, 8)
            between = bits[block * RANK_STEP // 8 : whole]
            i = int(counts[block]) + int(np.unpackbits(between).sum()) + int(bits[whole] & ((1 << part) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        value, at, shift = np.zeros(self.n, np.uint64), np.arange(self.n), 0
        for w, (chunks, bits, _, n) in zip(self.widths, self.levels, strict=True):
            value[at] |= _unpacked(chunks, w, n).astype(np.uint64) << np.uint64(shift)
            shift += w
            at = at[np.unpackbits(bits, count=n, bitorder="little").astype(bool)]
        return value.astype(np.uint32) if shift <= 32 else value

    def to_bytes(self) -> bytes:
        out = [struct.pack("<4sQI", b"DAC1", self.n, len(self.levels))]
        for w, (chunks, bits, counts, n) in zip(self.widths, self.levels, strict=True):
            out += [struct.pack("<IQ", w, n), chunks.tobytes(), bits.tobytes(), counts.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> Dac:
        magic, n, k = struct.unpack_from("<4sQI", data)
        if magic != b"DAC1":
            raise ValueError("not a DAC1 file")
        at, widths, levels = struct.calcsize("<4sQI"), [], []
        for _ in range(k):
            w, size = struct.unpack_from("<IQ", data, at)
            at += struct.calcsize("<IQ")
            sizes = (size if w == 8 else (size * w + 7) // 8, (size + 7) // 8, 4 * math.ceil(size / RANK_STEP))
            views = []
            for s, kind in zip(sizes, (np.uint8, np.uint8, "<u4"), strict=True):
                views.append(np.frombuffer(data, kind, s // np.dtype(kind).itemsize, at))
                at += s
            widths.append(w)
            levels.append((*views, size))
        return cls(n, widths, levels)


def _packed(chunks: np.ndarray, w: int) -> np.ndarray:
    if w == 8:
        return chunks.astype(np.uint8)
    return np.packbits((chunks[:, None] >> np.arange(w, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little")


def _unpacked(data: np.ndarray, w: int, n: int) -> np.ndarray:
    if w == 8:
        return data
    bits = np.unpackbits(data, count=n * w, bitorder="little").reshape(n, w)
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(w, dtype=np.uint64))


def _chunk(data: np.ndarray, w: int, i: int) -> int:
    if w == 8:
        return int(data[i])
    a, b = i * w // 8, (i * w + w + 7) // 8
    return int.from_bytes(data[a:b].tobytes(), "little") >> (i * w - a * 8) & ((1 << w) - 1)


def _directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each step."""
    ones = np.add.reduceat(bits.astype(np.uint32), np.arange(0, len(bits), RANK_STEP)) if len(bits) else np.zeros(0, np.uint32)
    return (np.cumsum(ones) - ones).astype(np.uint32)


def pack_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, widths=WIDTHS) -> bytes:
    """A file of documents: their table, then the codes of all their ids."""
    head = struct.pack("<4sQ", b"DOCS", len(doc_ids))
    return head + np.asarray(doc_ids, "<i8").tobytes() + np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes() + Dac.of(ids, widths).to_bytes()


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, Dac]:
    """(document ids, first token of each and the end, codes)."""
    magic, n = struct.unpack_from("<4sQ", data)
    if magic != b"DOCS":
        raise ValueError("not a token file")
    at = struct.calcsize("<4sQ")
    return np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<i8", n + 1, at + 8 * n), Dac.from_bytes(memoryview(data)[at + 8 * (2 * n + 1) :])


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, *, end_id: int | None = 0, keeps_spaces: bool = True, widths=WIDTHS, file_tokens: int = FILE_TOKENS,
    partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode all documents and write their files to ``folder``, a URI that pyarrow's file systems can open.

    Returns the manifest (part, seq, name, n_docs, n_tokens): files in order of (part, seq).
    A task writes a temporary name first and renames, so a repeated task leaves whole files.
    """
    spark = docs.sparkSession
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = "part int, seq int, name string, n_docs long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, e = TaskContext.get().partitionId(), encoder(tokenizer, keeps_spaces)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows: list[tuple] = []

        def close() -> None:
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"part-{part:06d}-{len(rows):06d}.dac"
            temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(pack_file(doc_ids, counts, ids, widths))
            store.move(temporary, f"{root}/{name}")
            rows.append((part, len(rows), name, len(doc_ids), len(ids)))
            held.clear()

        total = 0
        for b in batches:
            all_ids = np.array([NULL_ID if x is None else x for x in b.column(0).to_pylist()], np.int64)
            for first, texts in slices(b.column(1)):
                ids, n = e.encode(texts)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                    n = n + 1
                held.append((all_ids[first : first + len(texts)], n, ids))
                total += len(ids)
                if total >= file_tokens:
                    close()
                    total = 0
        if held:
            close()
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "name", "n_docs", "n_tokens"])

    # by the texts too: rows without an id, or of one id, may be many
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h")
    return written(ordered.select("id", "text").mapInArrow(run, schema), "token-manifest")


def read_token_files(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    schema = "name string, nth int, doc_id long, at long, n_tokens long, ids_crc32 long"

    if manifest.isEmpty():  # no files, and perhaps no folder
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, first, codes = unpack_file(data.as_buffer().to_pybytes())
                ids = codes.all().astype("<u4")
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rpartition("/")[2]] * len(crc)), pa.array(range(len(crc)), pa.int32()), pa.array([None if x == NULL_ID else x for x in doc_ids.tolist()], pa.int64()),
                     pa.array(first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())],
                    names=["name", "nth", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    # offsets: first the parts in order, then the files of each part
    per_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    per_part = per_part.select(F.col("part").alias("p"), (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    files = manifest.withColumn("within", within).join(per_part, F.col("part") == F.col("p")).select(F.col("name").alias("file"), (F.col("before") + F.col("within")).alias("base"))
    if manifest.count() <= BROADCAST_ROWS:
        files = F.broadcast(files)
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")
    found = blobs.mapInArrow(run, schema)
    return found.join(files, F.col("name") == F.col("file")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(documents(spark, sf_dir), folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder, manifest)
