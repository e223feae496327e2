"""Interaction audit of five document filters.

Every document fails some set of the filters A to E, a mask of five bits. A to D follow from the
text alone. E, a copy of a document with a smaller id, is found by routing: texts go to partitions
by their xxhash; there a chain for each fingerprint holds every full text that has it with the
smallest id seen, and every other id is a copy. A task that reads documents keeps such chains
too, over windows of bounded size, and decides its own copies at once, so a text travels once a
window, however often it stands there.

Masks are counted per part with two label bits, as vectors of 128 counts that ``combineByKey``
merges. All 120 orders of the filters follow from a part's vector.

Defined results: a null text is empty, a null part the empty string. Repeated rows are documents
each; rows of one id and one text are not copies of each other, for no id is smaller. A null id is
neither smaller nor larger than another and has no labels. Of several label rows of an id any
counts. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.textio import documents

FILTERS = "ABCDE"
A, B, C, D, E = (1 << k for k in range(5))
#: A: fewest words. B: fewest distinct words, percent of words. C: most capitals, percent of code points. D: symbols.
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of texts whose chains a reading task holds at a time; longer texts are read word by word.
WINDOW_BYTES, LONG_BYTES = 16 << 20, 1 << 22
#: Bytes of texts that a routed partition's chains hold, about.
ROUTED_BYTES = 24 << 20


def text_mask(text: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    # bytes.split knows exactly the white space of WORD
    words = text.split() if len(text) <= LONG_BYTES else None
    if words is not None:
        n, distinct = len(words), len(set(words))
    else:
        seen = Counter(m[0] for m in WORD.finditer(text))
        n, distinct = seen.total(), len(seen)
    out = A if n < FEWEST_WORDS else 0
    if 100 * distinct < DISTINCT_PERCENT * n:
        out |= B
    if 100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_PERCENT * code_points:
        out |= C
    if len(text.translate(None, SYMBOLS)) < len(text):
        out |= D
    return out


class Chains:
    """Fingerprint -> [full text, mask, smallest id, {part: rows of that id}], one entry a text."""

    def __init__(self):
        self.held: dict[int, list[list]] = {}
        self.bytes = 0

    def find(self, key: int, text: bytes) -> list | None:
        return next((e for e in self.held.get(key, ()) if e[0] == text), None)

    def add(self, key: int, text: bytes, mask: int, doc_id: int, parts: dict[str, int]) -> None:
        self.held.setdefault(key, []).append([text, mask, doc_id, dict(parts)])
        self.bytes += len(text)

    @staticmethod
    def meet(entry: list, doc_id: int, parts: dict[str, int]) -> tuple[int, dict[str, int]] | None:
        """Rows of the entry's text; returns the id that is not the smallest, with its rows."""
        if doc_id == entry[2]:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n
            return None
        if doc_id > entry[2]:
            return doc_id, parts
        out = (entry[2], entry[3])
        entry[2], entry[3] = doc_id, dict(parts)
        return out

    def drain(self) -> Iterator[tuple[int, list]]:
        for key, chain in self.held.items():
            for entry in chain:
                yield key, entry
        self.held, self.bytes = {}, 0


def _read(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(route, (id, parts, mask, text or None where E is decided)) of the documents of a task."""
    chains, no_id = Chains(), Counter()
    for doc_id, part, text, code_points in rows:
        text = bytes(text)
        key = xxhash.xxh64_intdigest(text)
        entry = chains.find(key, text) if doc_id is not None else None
        mask = entry[1] if entry else text_mask(text, code_points)
        if doc_id is None:
            no_id[part, mask] += 1
        elif entry is None:
            chains.add(key, text, mask, doc_id, {part: 1})
        elif copy := Chains.meet(entry, doc_id, {part: 1}):
            yield xxhash.xxh64_intdigest(str(copy[0])), (*copy, mask | E, None)
        if chains.bytes > WINDOW_BYTES:
            for k, (t, m, i, parts) in chains.drain():
                yield k, (i, parts, m, t)
    for k, (t, m, i, parts) in chains.drain():
        yield k, (i, parts, m, t)
    for (part, mask), n in no_id.items():
        yield xxhash.xxh64_intdigest(f"{part} {mask}"), (None, {part: n}, mask, None)


def _routed(records: Iterable) -> Iterator[tuple[int | None, str, int, int]]:
    """(id, part, mask, rows): ids that are not the smallest of their text as they are met, smallest ones at the end."""
    chains = Chains()
    for key, (doc_id, parts, mask, text) in records:
        if text is None:
            done = (doc_id, parts)
        elif entry := chains.find(key, text):
            done, mask = Chains.meet(entry, doc_id, parts), mask | E
        else:
            chains.add(key, text, mask, doc_id, parts)
            done = None
        if done:
            yield from ((done[0], part, mask, n) for part, n in done[1].items())
    for _, (_, mask, doc_id, parts) in chains.drain():
        yield from ((doc_id, part, mask, n) for part, n in parts.items())


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): ``n`` rows of an id in a part fail the filters of ``mask``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(part_col).cast("string"), F.lit("")), text.cast("binary"), F.length(text)).rdd
    parts = max(-(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // ROUTED_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = read.mapPartitions(_read).partitionBy(parts, lambda key: key).mapPartitions(_routed)
    return spark.createDataFrame(routed, "doc_id long, part string, mask int, n long", verifySchema=False)


def mask_counts(failed: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic"):
    """RDD of (part, 128 counts): documents by 4 * mask + 2 * good + toxic."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("l_id")).agg(flag(good_col).alias("good"), flag(toxic_col).alias("toxic"))
    both = failed.join(known, F.col("doc_id") == F.col("l_id"), "left")
    code = 4 * F.col("mask") + 2 * F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))

    def one(value: tuple[int, int]) -> np.ndarray:
        return add(np.zeros(128, np.int64), value)

    def add(counts: np.ndarray, value: tuple[int, int]) -> np.ndarray:
        counts[value[0]] += value[1]
        return counts

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a += b
        return a

    rows = both.select("part", code, "n").rdd.map(lambda r: (r[0], (r[1], r[2])))
    return rows.combineByKey(one, add, merge, int(failed.sparkSession.conf.get("spark.sql.shuffle.partitions")))


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of all orders and steps of a part."""
    mask, labels = np.divmod(np.arange(128), 4)
    good, toxic = counts * (labels >> 1), counts * (labels & 1)
    rows, shapley = [], Counter()
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, alive = (mask & bit) > 0, (mask & before) == 0
            gone = fails & alive
            removed = int(counts[gone].sum())
            shapley[name] += removed
            rows.append((name, ("".join(order), step, int(counts[alive & ~fails].sum()), removed, int(counts[fails & ~alive].sum()), int(counts[mask == bit].sum()), int(good[gone].sum()), int(toxic[gone].sum()))))
            before |= bit
    yield from ((part, *row, shapley[name]) for name, row in rows)


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step."""
    failed = failures(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    counts = mask_counts(failed, labels, id_col=id_col, good_col=good_col, toxic_col=toxic_col)
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda kv: interactions(*kv)), AUDIT, verifySchema=False)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
m as (select doc_id, part,
    case when len(ws) < 200 then 1 else 0 end
    + case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end
    + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l on m.doc_id = l.doc_id group by part, mask),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as t(name, bit)),
o as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s as (select filter_order, step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as integer) as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (select part, filter_order, step, bit,
    sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
    sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end) as removed,
    sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & before = 0 and mask & bit > 0 then good else 0 end) as good_lost,
    sum(case when mask & before = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
  from c, s group by part, filter_order, step, bit)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r
"""
