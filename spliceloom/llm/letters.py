"""Messages to rows of files: small tables in the shared folder that tasks read along with a scan.

A row is named by its file and its place in the file, so messages reach it however later scans cut
the files into partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceloom.session import is_scan, work_dir, written

#: Rows of a file whose messages share a directory.
BLOCK = 1 << 16


def as_scan(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as a scan of files: itself, or else the named ``columns`` written to the shared folder; with these columns, file and row."""
    if not is_scan(docs):
        docs = written(docs.select(*(c.alias(n) for n, c in columns.items())), "scan")
        columns = {n: F.col(n) for n in columns}
    return docs.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *(c.alias(n) for n, c in columns.items()))


def breaks(files: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where a batch leaves a file, a block of rows or their order."""
    return np.flatnonzero((files[1:] != files[:-1]) | (rows[1:] // BLOCK != rows[:-1] // BLOCK) | (rows[1:] < rows[:-1])) + 1


def _box(file: int, row: int) -> str:
    """Directory of the messages to a block of rows."""
    return f"{file}-{row // BLOCK}"


class Letters:
    """Messages to rows of files: (file, lo, hi, ...) tables in the shared folder, in the order of ``lo``."""

    def __init__(self, df: DataFrame, columns: list[str]):
        """``df``: file, lo, hi and ``columns``; lo and hi, the first and last row meant, lie in one block."""
        spark = df.sparkSession
        self.uri = f"{work_dir(spark)}/mail-{uuid.uuid4().hex}"
        self.columns = ["lo", "hi", *columns]
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        box = F.concat_ws("-", F.col("file").cast("string"), F.floor(F.col("lo") / BLOCK).cast("string"))
        df.select(box.alias("box"), *self.columns).repartition(n, "box").sortWithinPartitions("box", "lo").write.partitionBy("box").parquet(self.uri)

    def _letters(self, box: str) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(f"{root}/box={box}", allow_not_found=True))
        for x in sorted((x.path for x in found if x.path.endswith(".parquet"))):
            with store.open_input_file(x) as f:
                for b in pq.ParquetFile(f).iter_batches(256, columns=self.columns):
                    yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def reader(self):
        """A function of (file, lo, hi) that gives the letters to any of those rows; quick while rows ascend."""
        box, reached, stream, held, ahead = None, -1, iter(()), [], None

        def read(file: int, lo: int, hi: int) -> list[tuple]:
            nonlocal box, reached, stream, held, ahead
            if (want := _box(file, lo)) != box or lo < reached:
                box, stream, held, ahead = want, self._letters(want), [], None
                ahead = next(stream, None)
            reached = lo
            held = [x for x in held if x[1] >= lo]
            while ahead is not None and ahead[0] <= hi:
                if ahead[1] >= lo:
                    held.append(ahead)
                ahead = next(stream, None)
            return [x for x in held if x[0] <= hi]

        return read


def packed(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = np.frombuffer(data, "<u4", len(kinds)).tolist(), 4 * len(kinds), []
    for k, kind in zip(n, kinds, strict=True):
        out.append(np.frombuffer(data, kind, k, at))
        at += out[-1].nbytes
    return out
