"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two link when they differ in at most 3. The bits are cut into
segments of 23, 23 and 18. Leaving out the segment with most of the 3 differences, the two others
differ in at most one bit each, so every link shows in one of the three pairs of segments.

A 23-bit segment decodes by the perfect Golay code to the one codeword within 3 bits. Its index
(12 bits) is the segment's own key. A segment that differs in one bit decodes to the same
codeword, or to another one when the first lies 3 bits off; decoding a segment together with its
23 neighbours therefore gives at most 6 keys, among them the own key of every segment within one
bit. Each fingerprint is stored under the own keys of each pair of segments (3 places) and asks
under all key combinations (108 at most); what meets is verified by the number of different bits.

Keys travel as packed arrays, a few rows a batch, and meet in buckets whose number grows with the
fingerprints. A bucket hands on a spanning star per group, not its pairs; keys under which very
many fingerprints meet are cut into tiles that other tasks compare. Only distinct fingerprints
take part, so exact copies cost nothing.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link
like any other. A document with a null id gets the component of its fingerprint, but does not
lend it an id; component_id is null where no id is known. Repeated ids are documents each. Other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.textio import documents, per_document
from spliceloom.operators.components import connected_components, stars
from spliceloom.session import written

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: (lowest bit, length) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints of a bucket, about: with 12 bytes for each of their up to 111 keys.
BUCKET = 12_000
#: Meetings under one key beyond which the key is cut into tiles of this many fingerprints a side.
HOT, SIDE = 16_000_000, 4096
#: Meetings that are compared at once.
STEP = 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Words: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``; a bit is set if over half of the shingles' XXH64 have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n, total = len(words) - shingle + 1, np.zeros(64, np.int64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), "<u8", n)
    for a in range(0, n, 1 << 16):
        h = hashes[a : a + (1 << 16)]
        total += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each 12 + 11 bit part, error of each syndrome), by polynomial division."""
    syndrome = np.zeros(1 << 12, np.uint32)  # of a vector with these upper 12 bits and no others
    for i in range(12):
        r = 1 << (i + 11)
        for j in range(i + 11, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        block = np.arange(1 << i)
        syndrome[block + (1 << i)] = syndrome[block] ^ r
    error = np.zeros(1 << 11, np.uint32)
    for weight in (1, 2, 3):
        for bits in itertools.combinations(range(23), weight):
            v = sum(1 << b for b in bits)
            error[int(syndrome[v >> 11]) ^ (v & 0x7FF)] = v
    return syndrome, error


SYNDROME, ERROR = _golay()


def decode(v: np.ndarray) -> np.ndarray:
    """Index (upper 12 bits) of the codeword within 3 bits of each 23-bit vector."""
    v = v.astype(np.uint32)
    return (v ^ ERROR[SYNDROME[v >> 11] ^ (v & 0x7FF)]) >> 11


def own_and_near_keys(v: np.ndarray, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each segment's own key, and columns of the distinct other keys of its neighbours; -1 where none."""
    own = decode(v).astype(np.int64)
    near = np.sort(np.stack([decode(v ^ (1 << i)) for i in range(length)], axis=1).astype(np.int64), axis=1)
    fresh = near != own[:, None]
    fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
    place = np.cumsum(fresh, axis=1) - 1
    out = np.full((len(v), max(1, int(fresh.sum(axis=1).max(initial=0)))), -1, np.int64)
    r, c = np.nonzero(fresh)
    out[r, place[r, c]] = near[r, c]
    return own, list(out.T)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, asks) of all places where fingerprints are stored or ask."""
    parts = [own_and_near_keys(((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.uint32), n) for a, n in SEGMENTS]
    keys, who, asks = [], [], []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for x, kx in enumerate([parts[i][0], *parts[i][1]]):
            for y, ky in enumerate([parts[j][0], *parts[j][1]]):
                at = np.flatnonzero((kx >= 0) & (ky >= 0))
                key = ((k << 24) | (kx[at] << 12) | ky[at]).astype(np.uint32)
                for ask in (False, True) if x == y == 0 else (True,):
                    keys.append(key)
                    who.append(fps[at])
                    asks.append(np.full(len(at), ask))
    return np.concatenate(keys), np.concatenate(who), np.concatenate(asks)


def links(stored: np.ndarray, asking: np.ndarray, first: np.ndarray, count: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the verified links between asking[i] and stored[first[i] : first[i] + count[i]]."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    ends = np.cumsum(count)
    i = 0
    while i < len(asking):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
        n = count[i:j]
        x = np.repeat(asking[i:j], n)
        y = stored[np.repeat(first[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ok = (x != y) & (np.bitwise_count(x ^ y) <= max_bits)
        u, v = stars(x[ok], y[ok])
        a.append(u)
        b.append(v)
        i = j
    return stars(np.concatenate(a), np.concatenate(b))


def meet(key: np.ndarray, who: np.ndarray, asks: np.ndarray, max_bits: int):
    """(stars of all links that meet under a key, tiles of keys with very many meetings)."""
    order = np.lexsort((asks, key))
    key, who, asks = key[order], who[order], asks[order]
    s_key, stored, a_key, asking = key[~asks], who[~asks], key[asks], who[asks]
    first = np.searchsorted(s_key, a_key, "left")
    count = np.searchsorted(s_key, a_key, "right") - first
    some = count > 0
    first, count, asking, a_key = first[some], count[some], asking[some], a_key[some]
    tiles = []
    if len(a_key):
        uniq, at, n = np.unique(a_key, return_index=True, return_counts=True)
        for k in np.flatnonzero(n * count[at] > HOT):
            rows = slice(at[k], at[k] + n[k])
            s = stored[first[at[k]] : first[at[k]] + count[at[k]]]
            q = asking[rows]
            tiles += [(s[x : x + SIDE], q[y : y + SIDE]) for x in range(0, len(s), SIDE) for y in range(0, len(q), SIDE)]
            count[rows] = 0
        keep = count > 0
        first, count, asking = first[keep], count[keep], asking[keep]
    return links(stored, asking, first, count, max_bits), tiles


def fingerprint_links(fps: DataFrame, n: int, *, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that keep the components of distinct fingerprints ``fp`` (n of them) at ``max_bits`` of 3 or less.

    Where there is a column ``tag`` (0 to 15), fingerprints meet those of their own tag only.
    """
    fps = fps.select("fp", (F.col("tag") if "tag" in fps.columns else F.lit(0)).cast("int").alias("tag"))
    if max_bits > 3:
        raise ValueError("the keys find differences of 3 bits at most")
    buckets = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps, all_tags = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for tag, at in ((t, a) for t in np.unique(all_tags) for a in range(0, int((all_tags == t).sum()), 20_000)):
                key, who, asks = keys_of(all_fps[all_tags == tag][at : at + 20_000])
                key = key | np.uint32(int(tag) << 26)
                to = (key * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(buckets)
                order = np.argsort(to, kind="stable")
                key, who, asks, to = key[order], who[order], asks[order], to[order]
                cut = np.flatnonzero(np.diff(to)) + 1
                packed = key | (asks.astype(np.uint32) << np.uint32(31))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[np.concatenate([[0], cut])].astype(np.int32)), pa.array([p.tobytes() for p in np.split(packed, cut)]), pa.array([w.tobytes() for w in np.split(who, cut)])],
                    names=["bucket", "keys", "fps"],
                )

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = np.frombuffer(b"".join(pdf["keys"]), np.uint32)
        (a, b), tiles = meet(packed & np.uint32(0x7FFFFFFF), np.frombuffer(b"".join(pdf["fps"]), np.uint64), packed >> 31 == 1, max_bits)
        edges = pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "stored": None, "asking": None})
        hot = pd.DataFrame({"a": 0, "b": 0, "stored": [s.tobytes() for s, _ in tiles], "asking": [q.tobytes() for _, q in tiles]})
        return pd.concat([edges, hot]) if len(hot) else edges

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s, q = np.frombuffer(s, np.uint64), np.frombuffer(q, np.uint64)
                a, b = links(s, q, np.zeros(len(q), np.int64), np.full(len(q), len(s)), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    placed = fps.mapInArrow(spread, "bucket int, keys binary, fps binary")
    first = written(placed.groupBy("bucket").applyInPandas(found, "a long, b long, stored binary, asking binary"), "simhash-links")
    hot = first.filter("stored is not null").select("stored", "asking").repartition(buckets, F.xxhash64("stored", "asking"))
    return first.filter("stored is null").select("a", "b").unionByName(hot.mapInArrow(tiled, "a long, b long"))


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""

    def row(doc_id, text):
        f = fingerprint(text, shingle, seed)
        return doc_id, f - (1 << 64) if f >> 63 else f

    return per_document(docs, "doc_id long, fp long", row, id_col, text_col)


def simhash_groups(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id reachable by links."""
    marked = written(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    edges = fingerprint_links(distinct, distinct.count(), max_bits=max_bits)
    parts = connected_components(edges)
    # the smallest id of each component, then of each fingerprint
    joined = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    lowest = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    of_fp = written(joined.select("fp", "c").join(lowest, "c").select(F.col("fp").alias("f"), "component_id"), "components")
    return marked.join(of_fp, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    g = simhash_groups(documents(spark, sf_dir))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
