"""Hierarchical packing into windows of several lengths.

Documents are routed to tiers, windows of 1024, 512, 256 and 128 tokens, by what a document leaves
beyond whole windows of the longest. The corpus is summed up by how many such rests there are of
each length, and a plan is made on these counts, longest tier first: a rest opens a window of its
tier, and the gap is filled from shorter tiers, by exact singles first, then exact pairs, then
triples, at last by whole rests and one that is cut. What finds no filling goes down a
tier, cut at its length. Only what is left below the shortest tier ends in shorter windows, of
powers of two, so that no window is padded.

Windows are numbered from long to short and dealt to step groups of ``step_tokens`` tokens each:
every group but the last holds exactly as many, in windows of one tier or two adjoining ones.

Texts are encoded once; ids stand in a table with each document's task and its rank among the
task's rests of that length, so global ranks need one sum a task and length, and no document is
shuffled while that table of sums is small enough to broadcast.

Defined results: null and empty texts are the end id alone. Repeated ids are documents each. A
null id is kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.llm.packing import ComplementIndex
from spliceloom.llm.textio import documents
from spliceloom.llm.words import FEW_BYTES, encoder, slices
from spliceloom.session import written

#: Longest and shortest tier, tokens of a step group.
CAPACITY, SHORTEST, STEP_TOKENS = 1024, 128, 1 << 16
#: Tasks whose rank offsets (``CAPACITY`` numbers each) may be broadcast.
BROADCAST_TASKS = 2048
#: Ranks of one length, at most, as a power of two.
RANK_BITS = 40


class Supply:
    """Stretches of rests by length: ``[rest's length, start in it, first rank, how many]``, with counts and the index of lengths."""

    def __init__(self, counts: list[int]):
        self.chunks = {x: [[x, 0, 0, n]] for x, n in enumerate(counts) if n}
        self.index = ComplementIndex(list(counts))
        self.counts = self.index.counts

    def shift(self, x: int, n: int) -> None:
        self.counts[x] += n
        self.index.note(x)

    def take(self, x: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        self.shift(x, -n)
        chunks = self.chunks[x]
        while n:
            rest, start, rank, m = chunks[-1]
            used = min(n, m)
            yield rest, start, rank, used
            if used == m:
                chunks.pop()
            else:
                chunks[-1][2:] = [rank + used, m - used]
            n -= used

    def put(self, x: int, rest: int, start: int, rank: int, n: int) -> None:
        self.chunks.setdefault(x, []).append([rest, start, rank, n])
        self.shift(x, n)

    def longest(self, most: int) -> int:
        """The longest length at hand up to ``most``, 0 if none."""
        return max((self.index.has & ((2 << most) - 1)).bit_length() - 1, 0)

    def above(self, gap: int, most: int) -> int:
        """The shortest length at hand over ``gap`` and up to ``most``, 0 if none."""
        fit = self.index.has & ((2 << most) - 1) & ~((2 << gap) - 1)
        return (fit & -fit).bit_length() - 1 if fit else 0


def filling(supply: Supply, x: int, tier: int, effort: int) -> tuple[list[int], int, int] | None:
    """(whole lengths with x first, length to cut, tokens of it) that fill a window; None where nothing does. Counts stay as they are.

    Effort 1 takes one exact filling, 2 a pair, 3 a triple, 4 what is there, the last one cut.
    """
    whole, cut, gap = [x], 0, tier - x
    supply.shift(x, -1)
    while gap:
        if effort == 1:
            exact = (gap,) if supply.counts[gap] else None
        else:
            exact = supply.index.pair(gap, gap) if effort == 2 else supply.index.fill(gap)
        if exact:
            for y in exact:
                supply.shift(y, -1)
            whole += exact
            break
        if effort < 4:
            break
        if cut := supply.above(gap, max(tier // 2, gap)) or supply.above(gap, max(x, gap)):
            break
        if not (y := supply.longest(gap)):
            break
        supply.shift(y, -1)
        whole.append(y)
        gap -= y
    full = cut or sum(whole) == tier
    for y in whole:
        supply.shift(y, 1)
    return (whole, cut, gap if cut else 0) if full else None


def plan(counts: list[int], shortest: int = SHORTEST) -> np.ndarray:
    """Rows (key, length, first window, offset, tier, tokens before the first window), by key.

    A row is a stretch of rests of one length with consecutive ranks; ``key`` packs that length,
    where the stretch starts in the rest, and the first rank. The next stretch of a rest starts
    where this one ends. Lengths are 1 to ``len(counts) - 1``, a power of two.
    """
    capacity = len(counts) - 1
    supply, rows, window, tokens = Supply(counts), [], 0, 0

    def place(x: int, n: int, length: int, offset: int, tier: int) -> None:
        """The first ``length`` tokens of n stretches of length x go to n windows, what is left of each goes back."""
        first = window
        for rest, start, rank, m in list(supply.take(x, n)):
            rows.append(((rest * capacity + start << RANK_BITS) + rank, length, first, offset, tier, tokens + (first - window) * tier))
            if length < x:
                supply.put(x - length, rest, start + length, rank, m)
            first += m

    tier = capacity
    while tier:
        low = tier // 2 if tier > shortest else 0
        for effort, x in itertools.product((1, 2, 3, 4), range(capacity, low, -1)):
            while n := supply.counts[x]:
                if x > tier:  # too little was left to fill a longer window
                    bin_ = ([], x, tier)
                elif not (bin_ := filling(supply, x, tier, effort)):
                    break
                whole, cut, part = bin_
                used = [*whole, cut] if cut else whole
                times = min(supply.counts[y] // used.count(y) for y in set(used)) if whole else n
                offset = 0
                for y in whole:
                    place(y, times, y, offset, tier)
                    offset += y
                if cut:
                    place(cut, times, part, offset, tier)
                window += times
                tokens += times * tier
        tier //= 2
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def stretches(table: np.ndarray, capacity: int, rest: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start in the rest, length, window, offset, tier, tokens before) for given rests, one round for each further cut."""
    row, start = np.arange(len(rest)), np.zeros(len(rest), np.int64)
    while len(row):
        key = ((rest[row] * capacity + start) << RANK_BITS) + rank[row]
        at = table[np.searchsorted(table[:, 0], key, "right") - 1]
        nth = key - at[:, 0]
        yield row, start, at[:, 1], at[:, 2] + nth, at[:, 3], at[:, 4], at[:, 5] + nth * at[:, 4]
        start = start + at[:, 1]
        more = start < rest[row]
        row, start = row[more], start[more]


def encoded(
    docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int | None = 0, keeps_spaces: bool = True, slice_bytes: int = FEW_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, ids, n, rest, task, nth_full, nth_rest): ids in two bytes each where the vocabulary allows, ranks inside the task."""
    names = ["doc_id", "ids", "n", "rest", "task", "nth_full", "nth_rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, e, seen, full = TaskContext.get().partitionId(), encoder(tokenizer, keeps_spaces), np.zeros(capacity, np.int64), 0
        kind = id_type(tokenizer, keeps_spaces)
        for b in batches:
            for first, texts in slices(b.column(1), slice_bytes):
                ids, n = e.encode(texts)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                    n = n + 1
                end = np.cumsum(n) * np.dtype(kind).itemsize
                column = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], end]).astype(np.int64)), pa.py_buffer(ids.astype(kind))])
                whole, rest = n // capacity, n % capacity
                # ranks: rests of equal length in order of the rows
                order = np.argsort(rest, kind="stable")
                size = np.bincount(rest, minlength=capacity)
                nth_rest = np.empty(len(n), np.int64)
                nth_rest[order] = np.arange(len(n)) - (np.cumsum(size) - size)[rest[order]] + seen[rest[order]]
                nth_full = full + np.cumsum(whole) - whole
                seen += size
                full += int(whole.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), column.cast(pa.binary()), *map(pa.array, (n.astype(np.int64), rest.astype(np.int32), np.full(len(n), task, np.int32), nth_full, nth_rest))], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids binary, n long, rest int, task int, nth_full long, nth_rest long")


def id_type(tokenizer: str, keeps_spaces: bool) -> str:
    return "<u2" if encoder(tokenizer, keeps_spaces).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_tiers(rows: DataFrame, kind: str, *, capacity: int = CAPACITY, shortest: int = SHORTEST, step_tokens: int = STEP_TOKENS, with_ids: bool = False, broadcast_tasks: int = BROADCAST_TASKS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group[, ids]) of all pieces of a written ``encoded`` table.

    To the driver come the counts of at most ``capacity`` lengths; the plan, bounded by them, goes to the tasks.
    """
    if capacity & (capacity - 1) or shortest & (shortest - 1) or step_tokens % capacity:
        raise ValueError("tiers are powers of two, step groups hold whole windows")
    rests = rows.groupBy("task", "rest").agg(F.count("*").alias("n")).filter("rest > 0")
    fulls = rows.groupBy("task").agg(F.sum(F.floor(F.col("n") / capacity)).alias("n")).select("task", F.lit(capacity).alias("rest"), "n")
    sums = written(rests.unionByName(fulls), "tier-counts")
    counts = [0] * (capacity + 1)
    for length, n in sums.groupBy("rest").agg(F.sum("n")).collect():
        counts[length] = n
    table = rows.sparkSession.sparkContext.broadcast(plan(counts, shortest))
    before = sums.select("task", "rest", (F.sum("n").over(Window.partitionBy("rest").orderBy("task")) - F.col("n")).alias("before"))
    before = before.groupBy(F.col("task").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("rest", "before"))).alias("m"))
    before = before.select("t", F.transform(F.sequence(F.lit(1), F.lit(capacity)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("first"))
    if before.count() <= broadcast_tasks:
        before = F.broadcast(before)
    ranked = rows.join(before, F.col("task") == F.col("t"))
    ranked = ranked.select("doc_id", "ids", "n", "rest", (F.col("nth_full") + F.element_at("first", capacity)).alias("full"), (F.col("nth_rest") + F.when(F.col("rest") > 0, F.element_at("first", F.greatest("rest", F.lit(1)))).otherwise(0)).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rest, full, rank = (c.to_numpy().astype(np.int64) for c in b.columns[2:])
            whole = n // capacity
            doc = np.repeat(np.arange(len(n)), whole)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
            # whole windows are numbered first, from 0
            found = [(doc, nth * capacity, np.full(len(doc), capacity), full[doc] + nth, np.zeros(len(doc), np.int64), np.full(len(doc), capacity), (full[doc] + nth) * capacity)]
            some = np.flatnonzero(rest)
            for row, start, *values in stretches(table.value, capacity, rest[some], rank[some]):
                found.append((some[row], whole[some[row]] * capacity + start, *values))
            doc, start, length, window, offset, tier, tokens = (np.concatenate(x) for x in zip(*found, strict=True))
            raw, size = b.column(1).to_pylist(), np.dtype(kind).itemsize
            cut = [np.frombuffer(raw[i], kind, m, a * size).astype("<u4").tobytes() for i, a, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            cols = [b.column(0).take(pa.array(doc)), *map(pa.array, (start, length)), pa.array(map(zlib.crc32, cut), pa.int64()), *map(pa.array, (n[doc], window, offset, tier.astype(np.int32), tokens // step_tokens))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cut, pa.binary())] if with_ids else cols, names=names)

    schema = PIECES + (", ids binary" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, shortest: int = SHORTEST, step_tokens: int = STEP_TOKENS, end_id: int | None = 0, keeps_spaces: bool = True, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents; each text is encoded once."""
    rows = written(encoded(docs, tokenizer, capacity=capacity, end_id=end_id, keeps_spaces=keeps_spaces, id_col=id_col, text_col=text_col), "tier-ids")
    return pack_tiers(rows, id_type(tokenizer, keeps_spaces), capacity=capacity, shortest=shortest, step_tokens=step_tokens, with_ids=with_ids)


def op12_multi_length_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
