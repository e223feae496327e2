"""SimHash near-duplicates, compared exactly by word shingles; a prefix filter finds what fingerprints miss.

First come the SimHash links of ``simhash``: fingerprints of all texts, linked by their Golay keys. Of
each link, and of each fingerprint of several texts, texts are fetched and compared by their 5-word
shingles; pairs at the similarity stay. Fingerprints miss texts with appended, cut or replaced
parts, so pairs that the links have not brought into one group yet are searched by a prefix filter
on rare shingles, as follows.

All texts order their shingles alike, rare ones first (counted over all
texts; any common order finds the same pairs), then by hash. Of n shingles the first
n - ceil(0.8 n) + 1 are the text's prefix: two texts at the similarity have a shingle of both
prefixes in common, so no such pair is left out. Texts with a common shingle are candidates if
their sizes allow the similarity and as many shingles of their prefixes are common as it needs, for
what lies behind the prefixes adds its length at most. Candidates alone are fetched and compared, by
the shingles themselves.

A shingle in the prefixes of more than HOT texts would pair them all, so it goes another way, which
is as exact: first it links texts with their neighbours by size; then, where its texts still lie in
several groups, one text of each group with its neighbours; at last every text outside its largest
group with all texts of other groups, in tiles, which count the common shingles of each pair and
hand on, once, what these allow to be similar. Most such shingles are those of one large group of
near copies and end after the first step. A shingle of very many texts is dealt out over
several buckets, and its texts meet in the later steps.

Groups are the components of pairs at the similarity or above. Equal texts count once.

Defined results: null and empty texts are equal texts. Documents without an id are left out.
Repeated ids count with each of their texts. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.llm import simhash
from spliceloom.llm.letters import Letters, as_scan, breaks
from spliceloom.llm.words import UnitStore, slices
from spliceloom.operators.components import connected_components
from spliceloom.session import forget, small_batches, written

SHINGLE, SIMILARITY = 5, 0.8
#: Texts up to which all shingles are counted in one bucket, bytes of text for each bucket of more, most buckets, and shingles that a task hands on at once.
COUNT_ALL, COUNT_BYTES, COUNT_BUCKETS, COUNT_STEP = 20_000, 8 << 20, 1 << 12, 1 << 20
#: Most shingles whose counts order prefixes; the others are rare.
COMMON = 1 << 19
#: Of these, rows of a file, about.
COMMON_FILE = 1 << 17
#: Prefix places of a bucket, about, and bytes of text for one place.
BUCKET, PLACE_BYTES = 150_000, 30
#: Texts under one shingle beyond which they are not paired at once, and beyond which, by estimate, they are dealt out.
HOT, SPLIT = 32, 20_000
#: Texts of a side of a tile.
SIDE = 2000
#: Hot shingles that a text brings to a tile, rows of a tile that are looked at together, and shingles that are counted at once.
LISTED, STRIP, CODES = 256, 250, 1024
#: Pairs that are looked at together, and bytes of texts whose shingles are held together.
STEP, SLICE = 200_000, 2 << 20
#: Rows of a file whose texts are asked for in one message.
ASKED = 256
#: A shingle of a text and the size of the text, negative where the shingle is dealt out.
PLACE = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<i4")])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where there are fewer words."""
    w = _words(text)
    parts = map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)) if len(w) > k else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, 7) for p in parts), np.uint64))


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(the first shingles in the order of (count, hash), their counts); ``common`` is sorted, shingles not in it count 0."""
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    if not len(common):
        return h[:n], np.zeros(n, np.int64)
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    count = np.where(common[at] == h, counts[at], 0)
    first = np.argsort(count, kind="stable")[:n]
    return h[first], count[first]


def counted_pairs(a, b, size_a, size_b) -> list[np.ndarray]:
    """Distinct pairs, a < b, with their sizes and how often they occur."""
    turn = a > b
    a, b, size_a, size_b = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, size_b, size_a), np.where(turn, size_a, size_b)
    order = np.lexsort((b, a))
    a, b, size_a, size_b = a[order], b[order], size_a[order], size_b[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return [a[at], b[at], size_a[at], size_b[at], np.diff(np.concatenate([at, [len(a)]]))]


def meetings(places: np.ndarray, similarity: float, most: int = HOT) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(counted pairs under common shingles, neighbours by size under hot ones, places of hot ones)."""
    places = places[np.lexsort((places["node"], np.abs(places["size"]), places["key"]))]
    first = np.ones(len(places), bool)  # equal texts stand once
    first[1:] = (places["key"][1:] != places["key"][:-1]) | (places["node"][1:] != places["node"][:-1])
    places = places[first]
    key, node, size = places["key"], places["node"], np.abs(places["size"].astype(np.int64))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([starts, [len(key)]]))
    hot = np.repeat(n > most, n) | (places["size"] < 0)
    i = np.flatnonzero(hot[:-1] & (key[1:] == key[:-1]) & (size[:-1] >= similarity * size[1:] - 1e-9))
    chain = counted_pairs(node[i], node[i + 1], size[i], size[i + 1])
    later = np.where(hot, 0, np.repeat(starts + n, n) - np.arange(len(key)) - 1)
    ends = np.cumsum(later)
    found, i = [(np.zeros(0, np.int64),) * 4], 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
        m = later[i:j]
        x = np.repeat(np.arange(i, j), m)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
        ok = size[x] >= similarity * size[y] - 1e-9
        found.append((node[x[ok]], node[y[ok]], size[x[ok]], size[y[ok]]))
        i = j
    return counted_pairs(*(np.concatenate(c) for c in zip(*found, strict=True))), chain, places[hot]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


class CommonShingles:
    """A small table (h, n) in the shared folder, read by whoever unpacks it: (sorted hashes, texts that have them)."""

    def __init__(self, uri: str):
        self.uri = uri

    def __iter__(self) -> Iterator[np.ndarray]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        held = [(np.zeros(0, np.int64),) * 2]
        for x in store.get_file_info(fs.FileSelector(root)):
            if x.path.endswith(".parquet"):
                with store.open_input_file(x.path) as f:
                    held += [tuple(c.to_numpy() for c in b.columns) for b in pq.ParquetFile(f).iter_batches(COMMON_FILE, columns=["h", "n"])]
        h, n = (np.concatenate(c) for c in zip(*held, strict=True))
        h = h.view(np.uint64)
        order = np.argsort(h)
        return iter((h[order], n[order]))


def _common_shingles(texts: DataFrame, n_texts: int, n_bytes: int, shingle: int) -> CommonShingles:
    """The most frequent shingles, COMMON at most, counted over all rows of ``texts``."""
    buckets = 1 if n_texts < COUNT_ALL else min(COUNT_BUCKETS, max(16, -(-n_bytes // COUNT_BYTES)))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        UnitStore.release()
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            held.clear()
            to = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.diff(to)) + 1
            return pa.RecordBatch.from_arrays([pa.array(to[np.concatenate([[0], cut])]), pa.array([p.tobytes() for p in np.split(h, cut)], pa.binary())], names=["bucket", "hashes"])

        for b in batches:
            for _, texts in slices(b.column(0), SLICE):
                for t in texts:
                    held.append(shingles(t.as_py(), shingle))
                    n += len(held[-1])
                    if n >= COUNT_STEP:
                        yield packed()
                        n = 0
        if held:
            yield packed()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        h, n = np.unique(np.frombuffer(b"".join(pdf["hashes"]), np.uint64), return_counts=True)
        return pd.DataFrame({"h": h[n > 1].view(np.int64), "n": n[n > 1]})

    packed = texts.select("text").mapInArrow(hashes, "bucket int, hashes binary")
    counted = written(packed.groupBy("bucket").applyInPandas(count, "h long, n long"), "near-counts")
    # the least count that COMMON shingles reach, about: eight steps between a count and its double, so a few hundred rows
    step = F.floor(8 * F.log2("n"))
    least, total = None, 0
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.step):
        if total + r.k > COMMON:
            break
        least, total = r.step, total + r.k
    top = counted.filter(F.lit(False) if least is None else step >= least)
    out = CommonShingles(written(top.repartition(max(1, -(-total // COMMON_FILE))), "near-common").written_to)
    forget(counted)
    return out


def _hash(text: Column) -> Column:
    """64 bits that name a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of ``wanted`` (node, file, row), read where they stand."""
    asked = wanted.groupBy("file", F.floor(F.col("row") / ASKED).alias("g")).agg(F.collect_list(F.struct("row", "node")).alias("asked"))
    letters = Letters(asked.select("file", (F.col("g") * ASKED).alias("lo"), (F.col("g") * ASKED + ASKED - 1).alias("hi"), F.col("asked.row").alias("rows"), F.col("asked.node").alias("nodes")), ["rows", "nodes"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = letters.reader()
        for b in batches:
            files, rows = (b.column(i).to_numpy() for i in (0, 1))
            cut = breaks(files, rows).tolist()
            for x, y in zip([0, *cut], [*cut, len(rows)], strict=True):
                if x == y:
                    continue
                nodes = {r: n for _, _, rs, ns in read(int(files[x]), int(rows[x]), int(rows[y - 1])) for r, n in zip(rs, ns, strict=True)}
                if k := [i for i in range(x, y) if rows[i] in nodes]:
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[rows[i]] for i in k], pa.int64()), b.column(2).take(pa.array(k))], names=["node", "text"])

    return docs.select("file", "row", "text").mapInArrow(pick, "node long, text string")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The (a, b) of ``pairs`` at the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            ok = []
            for a, b, x, y in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                if b.as_py() != last:
                    last, own = b.as_py(), shingles(y.as_py(), shingle)
                ok.append(jaccard(shingles(x.as_py(), shingle), own) >= similarity - 1e-12)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    pairs = written(pairs.select("a", "b").distinct(), "near-pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(reps.select("node", "file", "row"), "node")
    texts = written(_fetched(docs, wanted), "near-fetched")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    links = written(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "near-links")
    forget(texts)
    return links


def _fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """(a, b), a < b: texts of linked fingerprints, one text for each, and texts of one fingerprint, each with its least."""
    texts = docs.select(_hash(F.col("text")).alias("node"), "text")
    of = written(simhash.fingerprints(texts, id_col="node").select(F.col("doc_id").alias("node"), "fp").distinct(), "near-fingerprints")
    least = written(of.groupBy("fp").agg(F.min("node").alias("least")), "near-distinct")
    edges = simhash.fingerprint_links(least, least.count()).toDF("x", "y")
    side = lambda n, x: least.select(F.col("fp").alias(x), F.col("least").alias(n))
    linked = edges.join(side("u", "x"), "x").join(side("v", "y"), "y").select("u", "v")
    copies = of.join(least, "fp").filter("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    return linked.unionByName(copies).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``pairs`` without those whose texts ``links`` have brought into one group."""
    parts = written(connected_components(links), "near-parts")
    for side in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    return pairs.filter("of_a is null or of_b is null or of_a <> of_b").drop("of_a", "of_b")


def _labelled(hot: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hot places with their group c, (key, main group, texts, texts outside of it) of shingles with several groups)."""
    parts = connected_components(links).select(F.col("node").alias("of"), "component")
    rows = written(hot.join(parts, F.col("node") == F.col("of"), "left").select("key", "node", "size", F.coalesce("component", "node").alias("c")), "near-hot")
    per = rows.groupBy("key", "c").agg(F.count("*").alias("n"))
    several = per.groupBy("key").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("main")).filter("groups > 1")
    return rows, written(several.select(F.col("key").alias("k"), "n", F.col("main.c").alias("main"), (F.col("n") - F.col("main.n")).alias("others")), "near-several")


def _entries(lists: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``known``) of the keys of each row's list, those of ``known`` alone, by place."""
    key, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    k = np.flatnonzero(known[at] == key)
    k = k[np.argsort(at[k], kind="stable")]
    return row[k], at[k]


def tile_candidates(u: dict, v: dict, key: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bound): the texts u[i] and v[j] that meet under ``key`` and whose common keys, ``bound`` at most, allow the similarity.

    A pair is left to the least common key, unless lists of keys are cut short before it.
    """
    known = np.intersect1d(np.concatenate(list(u["keys"])), np.concatenate(list(v["keys"])))
    (row_u, at_u), (row_v, at_v) = _entries(list(u["keys"]), known), _entries(list(v["keys"]), known)
    less = int(np.searchsorted(known, key))
    cuts = sorted({*range(0, less, CODES), *range(less, len(known), CODES), len(known)})
    more_u, more_v = (x["total"] - np.array([len(k) for k in x["keys"]]) for x in (u, v))
    found = [(np.zeros(0, np.int64),) * 3]
    for x in range(0, len(u["node"]), STRIP):
        z = min(len(u["node"]), x + STRIP)
        common, before = (np.zeros((z - x, len(v["node"])), np.float32) for _ in range(2))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            sides = []
            for row, at, first, n in ((row_u, at_u, x, z - x), (row_v, at_v, 0, len(v["node"]))):
                k = slice(*np.searchsorted(at, (lo, hi)))
                inside = (row[k] >= first) & (row[k] < first + n)
                side = np.zeros((n, hi - lo), np.float32)
                side[row[k][inside] - first, at[k][inside] - lo] = 1
                sides.append(side)
            part = sides[0] @ sides[1].T
            common += part
            if lo < less:
                before += part
        s = {c: w[x:z, None] for c, w in (("size", u["size"]), ("c", u["c"]), ("node", u["node"]), ("total", u["total"]), ("more", more_u), ("rare", u["rare"]))}
        small, large = np.minimum(s["size"], v["size"]), np.maximum(s["size"], v["size"])
        bound = np.minimum(common.astype(np.int64) + s["more"] + more_v, np.minimum(s["total"], v["total"]))
        enough = bound + np.minimum(s["rare"], v["rare"]) + np.ceil(similarity * large - 1e-9) - 1 >= similarity / (1 + similarity) * (small + large) - 1e-9
        # of two texts outside the largest group the smaller one asks
        i, j = np.nonzero((before == 0) & enough & (s["c"] != v["c"]) & (v["is_main"] | (s["node"] < v["node"])) & (small >= similarity * large - 1e-9))
        found.append((i + x, j, bound[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _tiled_pairs(rows: DataFrame, several: DataFrame, small: DataFrame, similarity: float) -> DataFrame:
    """(a, b, size_a, size_b, n): texts outside the largest group of a hot shingle with texts of other groups, where the hot shingles in common, n at most, allow the similarity.

    Shingles of one group are in common to none of these pairs, so each text brings its others along, the least LISTED of them.
    Of the shingles that are not hot, two texts have no more in common than either has with any text (``small``).
    """
    rare = small.select(F.col("a").alias("it"), "n").unionByName(small.select(F.col("b").alias("it"), "n")).groupBy("it").agg(F.max("n").alias("rare"))
    x = rows.join(several, F.col("key") == F.col("k"))
    listed = x.groupBy(F.col("node").alias("of")).agg(F.sort_array(F.collect_set("key")).alias("keys")).select("of", F.size("keys").alias("total"), F.slice("keys", 1, LISTED).alias("keys"))
    listed = listed.join(rare, F.col("of") == F.col("it"), "left").fillna(0, ["rare"])
    x = x.join(listed, F.col("node") == F.col("of")).withColumn("chunks", F.ceil(F.col("n") / SIDE).cast("int")).withColumn("blocks", F.ceil(F.col("others") / SIDE).cast("int"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["key", "node", "size", "c", (F.col("c") == F.col("main")).alias("is_main"), "total", "rare", "keys"]
    left = x.filter("c <> main").select(*cols, every("chunks").alias("chunk"), part("blocks").alias("block"))
    right = x.select(*cols, part("chunks").alias("chunk"), every("blocks").alias("block")).toDF(*(f"r_{c}" for c in left.columns))

    def tile(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        names = ("a", "b", "size_a", "size_b", "n")
        if not len(p) or not len(q):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        u, v = ({c: f[t + c].to_numpy() for c in ("node", "size", "c", "is_main", "total", "rare", "keys")} for f, t in ((p, ""), (q, "r_")))
        i, j, n = tile_candidates(u, v, int(p["key"].iloc[0]), similarity)
        a, b, size_a, size_b = u["node"][i], v["node"][j], u["size"][i], v["size"][j]
        turn = a > b
        return pd.DataFrame(dict(zip(names, (np.where(turn, b, a), np.where(turn, a, b), np.where(turn, size_b, size_a), np.where(turn, size_a, size_b), n), strict=True)))

    keys = ["key", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*(f"r_{k}" for k in keys))).applyInPandas(tile, "a long, b long, size_a long, size_b long, n long")
    return found.groupBy("a", "b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.min("n").alias("n"))


def _enough(common: Column, similarity: float) -> Column:
    """Whether so many common prefix shingles allow the similarity: what lies behind a prefix adds at most its length."""
    behind = F.ceil(similarity * F.greatest("size_a", "size_b") - 1e-9) - 1
    return common + behind >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-9


def _groups(docs: DataFrame, similarity: float, shingle: int, most: int = HOT, split: int = SPLIT) -> DataFrame:
    """(file, row, doc_id, component_id) of the rows of a scan (file, row, doc_id, text) that have an id."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity above 0, 1 at most")
    with small_batches(docs.sparkSession, SLICE):
        return _grouped(docs, similarity, shingle, most, split)


def _grouped(docs: DataFrame, similarity: float, shingle: int, most: int, split: int) -> DataFrame:
    docs = docs.filter("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    marked = written(docs.select("file", "row", "doc_id", _hash(F.col("text")).alias("node"), F.octet_length("text").alias("n_bytes")), "near-marks")
    first = F.min(F.struct("doc_id", "file", "row")).alias("first")
    reps = written(marked.groupBy("node").agg(first, F.max("n_bytes").alias("n_bytes")).select("node", F.col("first.doc_id").alias("rep"), "first.file", "first.row", "n_bytes"), "near-texts")
    n_texts, n_bytes = reps.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    by_fingerprint = _verified(_fingerprint_pairs(docs), docs, reps, similarity, shingle)
    most_frequent = _common_shingles(docs, n_texts, n_bytes, shingle)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // (PLACE_BYTES * BUCKET)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        UnitStore.release()
        common, counts = most_frequent
        for batch in batches:
            for a, texts in slices(batch.column(1), SLICE):
                nodes = batch.column(0).slice(a, len(texts)).to_pylist()
                parts, dealt = [], []
                for node, i in {n: i for i, n in enumerate(nodes)}.items():
                    h = shingles(texts[i].as_py(), shingle)
                    p, count = prefix(h, common, counts, similarity)
                    rows = np.empty(len(p), PLACE)
                    share = count // split + 1  # buckets of a shingle
                    rows["key"], rows["node"], rows["size"] = p, node, np.where(share > 1, -len(h), len(h))
                    parts.append(rows)
                    dealt.append((node & 0xFFFF) % share)
                rows = np.concatenate(parts)
                to = (((rows["key"] >> np.uint64(20)) + np.concatenate(dealt).astype(np.uint64) * np.uint64(0x9E3779B1)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order]
                cut = np.flatnonzero(np.diff(to)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(to[np.concatenate([[0], cut])]), pa.array([p.tobytes() for p in np.split(rows, cut)], pa.binary())], names=["bucket", "places"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, chain, hot = meetings(np.frombuffer(b"".join(pdf["places"]), PLACE), similarity, most)
        names = ("a", "b", "size_a", "size_b", "n")
        hot = {"a": hot["node"], "b": hot["node"], "size_a": np.abs(hot["size"].astype(np.int64)), "size_b": 0, "n": 0, "key": hot["key"].view(np.int64), "kind": 2}
        return pd.concat([pd.DataFrame(dict(zip(names, pairs, strict=True)) | {"key": 0, "kind": 0}), pd.DataFrame(dict(zip(names, chain, strict=True)) | {"key": 0, "kind": 1}), pd.DataFrame(hot)])

    placed = docs.select(_hash(F.col("text")).alias("node"), "text").mapInArrow(places, "bucket int, places binary")
    met = written(placed.groupBy("bucket").applyInPandas(meet, "a long, b long, size_a long, size_b long, n long, key long, kind int"), "near-meetings")
    hot = met.filter("kind = 2").select("key", F.col("a").alias("node"), F.col("size_a").alias("size"))
    small = written(met.filter("kind = 0").groupBy("a", "b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.sum("n").alias("n")), "near-counted")
    hot_of = hot.groupBy("node").agg(F.count("*").alias("hot"))
    for side in ("a", "b"):  # common hot shingles are not counted: as many as either text has
        small = small.join(hot_of.select(F.col("node").alias(side), F.col("hot").alias(f"hot_{side}")), side, "left").fillna(0, [f"hot_{side}"])
    likely = small.filter(_enough(F.col("n") + F.least("hot_a", "hot_b"), similarity)).select("a", "b")
    likely = _apart(likely.unionByName(met.filter("kind = 1").select("a", "b")), by_fingerprint)
    links = by_fingerprint.unionByName(_verified(likely, docs, reps, similarity, shingle))

    if not hot.isEmpty():
        rows, several = _labelled(hot, links)
        if not several.isEmpty():
            one = rows.join(several, F.col("key") == F.col("k")).groupBy("key", "c").agg(F.min(F.struct("size", "node")).alias("x"))
            nearest = Window.partitionBy("key").orderBy("x.size", "x.node")
            chain = one.select(F.col("x.node").alias("a"), F.col("x.size").alias("s"), F.lead("x.node").over(nearest).alias("b"), F.lead("x.size").over(nearest).alias("t")).filter(F.col("s") >= similarity * F.col("t") - 1e-9)
            links = links.unionByName(_verified(chain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), docs, reps, similarity, shingle))
            rows, several = _labelled(hot, links)
        if not several.isEmpty():
            more = _tiled_pairs(rows, several, small, similarity).join(small.select("a", "b", F.col("n").alias("n_small")), ["a", "b"], "left")
            more = more.filter(_enough(F.col("n") + F.coalesce("n_small", F.lit(0)), similarity))
            links = links.unionByName(_verified(more, docs, reps, similarity, shingle))

    parts = connected_components(links)
    named = reps.select("node", "rep").join(parts.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "rep", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_node = written(named.select("node", "c").join(least, "c").select("node", "component_id"), "near-groups")
    return marked.join(of_node, "node").select("file", "row", "doc_id", "component_id")


def near_duplicate_groups(docs: DataFrame, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, hot: int = HOT, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every document with an id; component_id is the smallest doc_id of its group.

    ``hot`` and ``split`` set the way that pairs are found, not which.
    """
    return _groups(as_scan(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col)), similarity, shingle, hot, split).select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; rows of one id stay or go together, rows without an id stay.

    Rows that go are named to the scan, so no text is shuffled.
    """
    columns = docs.columns
    scan = as_scan(docs, **{f"c{i}": F.col(f"`{c}`") for i, c in enumerate(columns)})
    own = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    groups = written(_groups(scan.select("file", "row", own[id_col].cast("long").alias("doc_id"), own[text_col].alias("text")), similarity, shingle), "near-rows")
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = groups.join(gone, F.col("doc_id") == F.col("gone")).groupBy("file", F.floor(F.col("row") / ASKED).alias("g")).agg(F.collect_set("row").alias("rows"))
    letters = Letters(rows.select("file", (F.col("g") * ASKED).alias("lo"), (F.col("g") * ASKED + ASKED - 1).alias("hi"), "rows"), ["rows"])

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = letters.reader()
        for b in batches:
            files, rows = (b.column(i).to_numpy() for i in (0, 1))
            cut = breaks(files, rows).tolist()
            for x, y in zip([0, *cut], [*cut, len(rows)], strict=True):
                if x < y:
                    out = {r for _, _, rs in read(int(files[x]), int(rows[x]), int(rows[y - 1])) for r in rs}
                    gone_rows = pa.array(list(out), pa.int64())
                    step = max(1, len(rows) * SLICE // max(1, b.nbytes))  # what goes back goes in small parts
                    for z in range(x, y, step):
                        part = b.slice(z, min(step, y - z))
                        yield part.select(list(range(2, b.num_columns))).filter(pc.invert(pc.is_in(part.column(1), gone_rows)))

    plain = scan.select(*(F.col(f"c{i}") for i in range(len(columns))))
    return scan.mapInArrow(stay, plain.schema).toDF(*columns)
