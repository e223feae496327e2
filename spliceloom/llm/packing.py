"""Best-fit packing by exact-complement hashing.

Pieces are at most ``capacity`` tokens long, so the corpus is summed up by how many pieces there
are of each length: at most ``capacity`` numbers, whatever the input. On these counts a plan is
made: the longest length left opens a sequence, and the index of lengths at hand is asked for a
single, a pair or a triple whose sum is exactly the gap; the combination is used as often as the
counts allow. Lengths that nothing completes are packed best-fit decreasing, on counts too.

The plan assigns to every length consecutive ranks of its pieces. Ranks are dealt out in
parallel: pieces are counted per length and hash bucket, buckets get their first rank, and each
bucket numbers its own pieces.

Defined results: null and empty texts are one piece of the end id alone. Repeated ids are
documents each. A null id is kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.llm.textio import documents
from spliceloom.llm.words import FEW_BYTES, encoder, slices
from spliceloom.session import small_batches, written

CAPACITY = 4096
#: Pieces of a bucket, about, when ranks are dealt out.
BUCKET = 100_000


class ComplementIndex:
    """The lengths at hand, as bit sets: which single, pair or triple sums to a gap."""

    def __init__(self, counts: list[int]):
        self.n = len(counts) - 1
        self.counts = counts
        self.has = self.twice = self.mirror = 0
        for x in range(1, self.n + 1):
            self.note(x)

    def note(self, x: int) -> None:
        """Bring the sets up to date for length x."""
        c, bit, back = self.counts[x], 1 << x, 1 << (self.n - x)
        self.has = self.has | bit if c else self.has & ~bit
        self.twice = self.twice | bit if c > 1 else self.twice & ~bit
        self.mirror = self.mirror | back if c else self.mirror & ~back

    def pair(self, gap: int, most: int) -> tuple[int, int] | None:
        """The pair (a, b), a >= b, a <= most, with the longest a."""
        both = self.has & (self.mirror >> (self.n - gap)) if gap <= self.n else 0
        if gap % 2 == 0 and not self.twice >> (gap // 2) & 1:
            both &= ~(1 << (gap // 2))
        both &= (1 << (min(most, gap - 1) + 1)) - 1
        a = both.bit_length() - 1
        return (a, gap - a) if both and a >= gap - a else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """The first of single, pair, triple that sums to the gap, long parts first."""
        if gap > 0 and self.has >> gap & 1:
            return (gap,)
        if two := self.pair(gap, gap):
            return two
        rest = self.has & ((1 << max(gap - 1, 0)) - 1)
        while rest:
            a = rest.bit_length() - 1
            if 3 * a < gap:
                return None
            self.counts[a] -= 1
            self.note(a)
            two = self.pair(gap - a, a)
            self.counts[a] += 1
            self.note(a)
            if two:
                return (a, *two)
            rest ^= 1 << a
        return None


def plan(counts: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] for counts[length], capacity = len(counts) - 1."""
    counts = list(counts)
    capacity = len(counts) - 1
    index = ComplementIndex(counts)
    out: list[tuple[tuple[int, ...], int]] = []
    left: list[tuple[int, int]] = []
    for x in range(capacity, 0, -1):
        while counts[x]:
            counts[x] -= 1
            index.note(x)
            rest = index.fill(capacity - x) if x < capacity else ()
            counts[x] += 1
            if rest is None:
                left.append((x, counts[x]))
                counts[x] = 0
                index.note(x)
                break
            bin_ = (x, *rest)
            times = min(counts[y] // bin_.count(y) for y in set(bin_))
            for y in bin_:
                counts[y] -= times
            for y in set(bin_):
                index.note(y)
            out.append((bin_, times))
    # best fit, longest first; groups of equal sequences by their gap
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = 0

    def put(gap: int, bin_: tuple[int, ...], times: int) -> None:
        nonlocal gaps
        open_.setdefault(gap, []).append((bin_, times))
        gaps |= 1 << gap

    for x, n in left:
        while n:
            fit = gaps >> x
            if not fit:
                k = capacity // x
                if n // k:
                    put(capacity - k * x, (x,) * k, n // k)
                if n % k:
                    put(capacity - n % k * x, (x,) * (n % k), 1)
                break
            gap = x + (fit & -fit).bit_length() - 1
            bin_, times = open_[gap].pop()
            if not open_[gap]:
                gaps ^= 1 << gap
            used = min(n, times)
            if used < times:
                put(gap, bin_, times - used)
            put(gap - x, (*bin_, x), used)
            n -= used
    return out + [g for groups in open_.values() for g in groups]


def segments(bins: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows (length * 2**40 + first rank, first sequence, offset) sorted; bounded by the plan's size."""
    rank, rows, sequence = [0] * (capacity + 1), [], 0
    for bin_, times in bins:
        offset = 0
        for x in bin_:
            rows.append(((x << 40) + rank[x], sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, *, most: int = FEW_BYTES, capacity: int = CAPACITY, end_id: int | None = 1, keeps_spaces: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` tokens of each document, with a checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, keeps_spaces)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, texts in slices(b.column(1), most):
                ids, n = e.encode(texts)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                    n = n + 1
                ids = ids.astype("<u4")
                begin = np.cumsum(n) - n
                out = [
                    (doc_ids[first + i], k, a, z - a, zlib.crc32(ids[o + a : o + z]))
                    for i, (o, m) in enumerate(zip(begin.tolist(), n.tolist(), strict=True))
                    for k, (a, z) in enumerate((a, min(a + capacity, m)) for a in range(0, m, capacity))
                ]
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(cut: DataFrame, *, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """Adds (sequence_id, offset) to rows with a ``length`` of 1 to ``capacity``, (doc_id, piece) beside it.

    ``cut`` is read twice, so hand in a table, not a long plan. To the driver come the counts of
    at most ``capacity`` lengths; the plan goes to the tasks, a few rows a length and sequence kind.
    """
    counts = [0] * (capacity + 1)
    for length, n in cut.groupBy("length").count().collect():
        counts[length] = n
    if sum(counts) == 0:
        return cut.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    table = segments(plan(counts), capacity)
    buckets = max(16, -(-sum(counts) // bucket))
    dealt = cut.withColumn("deal", F.pmod(F.xxhash64(*cut.columns), F.lit(buckets)).cast("int"))
    first = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    first = first.select(F.col("length").alias("l"), F.col("deal").alias("d"), (F.sum("n").over(Window.partitionBy("length").orderBy("deal")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", *[c for c in cut.columns if c not in ("doc_id", "piece", "length")])
    ranked = dealt.withColumn("nth", F.row_number().over(order) - 1).join(first, (F.col("length") == F.col("l")) & (F.col("deal") == F.col("d")))
    ranked = ranked.select(*cut.columns, (F.col("before") + F.col("nth")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            key = (length << 40) + rank
            at = np.searchsorted(table[:, 0], key, "right") - 1
            cols = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "rank"]
            names = [name for name in b.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(table[at, 1] + key - table[at, 0]), pa.array(table[at, 2])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, batch_bytes: int | None = None, capacity: int = CAPACITY, end_id: int | None = 1, keeps_spaces: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces; texts are encoded once, where memory is short in batches of ``batch_bytes``."""
    with small_batches(docs.sparkSession, batch_bytes) if batch_bytes else nullcontext():
        cut = written(pieces(docs, tokenizer, most=batch_bytes or FEW_BYTES, capacity=capacity, end_id=end_id, keeps_spaces=keeps_spaces, id_col=id_col, text_col=text_col), "pieces")
    return pack(cut, capacity=capacity)


def op4_best_fit_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
