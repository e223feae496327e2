"""Whitening, multi-length packing and the filter audit against plain code."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spliceloom.llm import audit, tiers, whitening

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, part string, quality int, mask int, n long, x string"
LABELS = "doc_id long, quality int, toxic int, text string"
VECTORS = "vec_id long, embedding array<float>, label int, x long, d int, n int"
rng = random.Random(11)


def prose(n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


TEXTS = [None, "", "  \n\t", "one", prose(300), prose(300), prose(250, 40), "SHOUTING " * 300, "a & b " + prose(220), prose(199), prose(200), "é" * 30 + " Ab", "\x1c\x85  ", "日本語 テキスト " * 150, prose(3000), "A" + "b" * 49, "Ab" + "c" * 98]
ROWS = [(i, t, rng.choice(["s", "s", "t", None, ""]), "p", 1, 2, 3, "x") for i, t in enumerate(TEXTS)]
ROWS += [(i + 100, t, rng.choice(["s", "t"]), "p", 0, 0, 0, None) for i, t in enumerate(TEXTS) if i % 2] + [(4, TEXTS[4], "t", None, 1, 1, 1, "y"), (4, TEXTS[5], "t", None, 1, 1, 1, "y")]
ROWS += [(None, TEXTS[4], "s", None, 1, 1, 1, "y"), (None, TEXTS[4], None, None, 1, 1, 1, "y"), (1, "", "s", None, None, None, None, None), (3, "one", "u", None, None, None, None, None)]
rng.shuffle(ROWS)
MARKS = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in [*range(12), *range(100, 110), 3, 5]] + [(None, 1, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


def plain_masks(rows):
    """[(id, part, mask)] by the rules as they are stated."""
    out = []
    for doc_id, t, source, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        m = (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t))
        m += 16 * (doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == t for r in rows))
        out.append((doc_id, source or "", m))
    return out


def plain_audit(rows, marks):
    good, toxic = ({r[0] for r in marks if r[k] == 1 and r[0] is not None} for k in (1, 2))
    docs, out = plain_masks(rows), []
    for part in {p for _, p, _ in docs}:
        here, shapley, lines = [(i, m) for i, p, m in docs if p == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(here)
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone, stay = [d for d in left if d[1] & bit], [d for d in left if not d[1] & bit]
                fails = sum(1 for d in here if d[1] & bit)
                shapley[f] += len(gone)
                lines.append((f, ["".join(order), step, len(stay), len(gone), fails - len(gone), sum(d[1] == bit for d in here), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]))
                left = stay
        out += [(part, *line, shapley[f]) for f, line in lines]
    return sorted(out)


@pytest.mark.parametrize("window", [16 << 20, 10])
def test_audit(spark, docs, window, monkeypatch):
    monkeypatch.setattr(audit, "WINDOW_BYTES", window)
    monkeypatch.setattr(audit, "LONG_BYTES", 1 << 22 if window > 10 else 5)
    got = audit.audit(docs, spark.createDataFrame(MARKS, LABELS))
    assert sorted(map(tuple, got.collect())) == plain_audit(ROWS, MARKS)


def test_audit_edges(spark, docs):
    no_docs, no_marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(no_docs, no_marks).collect() == []
    assert sorted(map(tuple, audit.audit(docs, no_marks).collect())) == plain_audit(ROWS, [])


def test_chains_keep_texts_apart_under_one_fingerprint(monkeypatch):
    monkeypatch.setattr(audit.xxhash, "xxh64_intdigest", lambda b: 7)
    rows = [(5, "p", b"x", 1), (3, "p", b"y", 1), (4, "q", b"x", 1), (9, "p", b"y", 1), (4, "p", b"x", 1)]
    for cut in range(len(rows)):
        records = [r for part in (rows[:cut], rows[cut:]) for r in audit._read(part)]
        found = {(i, p): (bool(m & audit.E), n) for i, p, m, n in audit._routed(records)}
        assert found == {(5, "p"): (True, 1), (3, "p"): (False, 1), (4, "q"): (False, 1), (9, "p"): (True, 1), (4, "p"): (False, 1)}


def test_a_hot_text_travels_once_a_window():
    rows = [(i, "p", b"copy", 4) for i in range(5000)]
    texts = [r for r in audit._read(rows) if r[1][3] is not None]
    assert len(texts) == 1 and len({r[0] for r in audit._read(rows)}) > 4000


def test_audit_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.sql(audit.OP13_SQL)
    got = audit.op13_filter_audit(spark, DATA)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def plain_pieces(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in docs]


def assert_packed(got, docs, capacity=1024):
    """Every id in one piece with its checksum, sequences gapless, sizes powers of two, step groups even."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    left = Counter()
    for doc_id, ids in docs:
        left[doc_id, len(ids)] += 1
    for (doc_id, n), pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == n * left[doc_id, n]
    crc = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    known = defaultdict(list)
    for doc_id, ids in docs:
        known[doc_id, len(ids)].append(np.array(ids, "<u4"))
    for r in got:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in known[r["doc_id"], r["doc_tokens"]])
    for (doc_id, n), same in known.items():
        cover = Counter(t for r in by_doc[doc_id, n] for t in range(r["start"], r["start"] + r["length"]))
        assert set(cover.values()) == {len(same)} and len(cover) == n
    assert sum(crc.values()) == len(got)
    steps = Counter()
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity and at & (at - 1) == 0 and {p["tier"] for p in pieces} == {at} and len({p["step_group"] for p in pieces}) == 1
        steps[pieces[0]["step_group"]] += at
    return steps, by_sequence


def test_tiers(spark, docs):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    plain = plain_pieces(spark, ROWS)
    rows = tiers.pack_documents(docs, tokenizer, step_tokens=2048, with_ids=True)
    got = rows.collect()
    steps, sequences = assert_packed(got, plain)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert all(steps[g] == 2048 for g in range(len(steps) - 1)) and 0 < steps[len(steps) - 1] <= 2048
    assert sum(p[0]["tier"] < tiers.SHORTEST for p in sequences.values()) <= 7
    assert tiers.pack_documents(spark.createDataFrame([], DOCS), tokenizer).collect() == []


def test_tiers_whatever_way_offsets_travel(spark, docs):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = tiers.written(tiers.encoded(docs, tokenizer), "test-ids")
    one, other = (sorted(map(tuple, tiers.pack_tiers(rows, "<u2", broadcast_tasks=b).collect()), key=str) for b in (0, 100))
    assert one == other
    assert tiers.id_type(tokenizer, True) == "<u2"


@pytest.mark.parametrize(("seed", "capacity", "shortest"), [(s, c, m) for s in range(40) for c, m in ((1, 1), (4, 2), (16, 4), (64, 8))])
def test_plan_fills_every_window(seed, capacity, shortest):
    r = random.Random(seed)
    counts = [0] + [r.choice([0, 0, 1, 2, 9]) for _ in range(capacity)]
    table = tiers.plan(counts, shortest)
    rest = np.array([x for x, n in enumerate(counts) for _ in range(n)], np.int64)
    rank = np.array([k for n in counts for k in range(n)], np.int64)
    windows = defaultdict(list)
    for _, _, length, window, offset, tier, before in (x for part in tiers.stretches(table, capacity, rest, rank) for x in zip(*part, strict=True)):
        windows[window].append((offset, length, tier, before))
    before = 0
    for w in range(len(windows)):
        at = 0
        for offset, length, tier, tokens in sorted(windows[w]):
            assert (offset, tokens) == (at, before)
            at += length
        assert at == tier <= capacity and tier & (tier - 1) == 0
        before += at
    assert before == sum(x * n for x, n in enumerate(counts))
    sizes = [p[0][2] for _, p in sorted(windows.items())]
    assert sizes == sorted(sizes, reverse=True) and sum(s for s in sizes if s < shortest) < shortest


def test_plan_cuts_few_rests():
    counts = [0] + [100 + x % 7 for x in range(1, 1024)] + [50]
    table = tiers.plan(counts)
    rest = np.repeat(np.arange(1025), counts)
    rank = np.concatenate([np.arange(n) for n in counts])
    pieces = sum(len(part[0]) for part in tiers.stretches(table, 1024, rest, rank))
    assert pieces < 1.05 * len(rest)


def vectors_of(seed, n=90, d=20):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 5)) @ r.normal(size=(5, d)) + r.normal(size=(n, d)) * 0.1 + 3
    return [(i, v.tolist(), 0, 1, 2, 3) for i, v in enumerate(x.astype(np.float32))]


VECTOR_ROWS = vectors_of(3) + [(200 + k, vectors_of(3)[k][1], 0, 0, 0, 0) for k in (0, 0, 5)] + [(0, vectors_of(3)[7][1], 0, 0, 0, 0), (None, vectors_of(3)[9][1], None, None, None, None)]
BAD_ROWS = [(300, None, 0, 0, 0, 0), (301, [], 0, 0, 0, 0), (302, [1.0] * 19 + [None], 0, 0, 0, 0), (303, [1.0] * 19 + [float("nan")], 0, 0, 0, 0), (304, [1.0] * 19 + [float("inf")], 0, 0, 0, 0), (305, [1e30] * 20, 0, 0, 0, 0)]


def plain_whitening(rows):
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v, *_ in rows]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(x[0])
    s = [sum(c) for c in zip(*fit, strict=True)]
    off = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in fit])
    values, v = np.linalg.eigh(off.T @ off / n)
    values, v = values[::-1], v[:, ::-1]
    y = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in x]) @ v[:, : min(16, d)] / np.sqrt(values[: min(16, d)])
    return n, [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x], y, values / values.sum()


def test_whitening(spark):
    table = spark.createDataFrame(VECTOR_ROWS + BAD_ROWS, VECTORS).repartition(5)
    rows = whitening.whiten(table, whitening.fit(table)).collect()
    n, deviation, y, share = plain_whitening(VECTOR_ROWS)
    assert len(rows) == len(VECTOR_ROWS) and {r["n"] for r in rows} == {n == 90 and n}
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in rows) == sorted((str(r[0]), d) for r, d in zip(VECTOR_ROWS, deviation, strict=True))
    got = np.array([r["whitened"] for r in sorted(rows, key=lambda r: (str(r["vec_id"]), r["deviation"]))])
    want = y[sorted(range(len(y)), key=lambda i: (str(VECTOR_ROWS[i][0]), deviation[i]))]
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8
    assert np.allclose(rows[0]["explained"], share[:16], rtol=1e-10)
    assert 0 <= rows[0]["identity_error"] < 1e-9
    assert whitening.whiten(spark.createDataFrame([], VECTORS), whitening.fit(spark.createDataFrame([], VECTORS))).collect() == []


def test_whitening_of_few_and_of_mixed_vectors(spark):
    rows = [(1, [0.5, 2.0], 0, 0, 0, 0), (2, [0.5, 2.0], 0, 0, 0, 0), (3, [1.0, 2.0, 3.0], 0, 0, 0, 0), (4, [2.0, 2.0, 3.0], 0, 0, 0, 0)]
    table = spark.createDataFrame(rows, VECTORS)
    got = {r["vec_id"]: r for r in whitening.whiten(table, whitening.fit(table)).collect()}
    assert got[1]["n"] == 1 and got[1]["deviation"] == 0 and got[1]["whitened"] == [None, None] and got[1]["explained"] == [None, None]
    assert got[3]["n"] == 2 and abs(got[3]["whitened"][0]) == pytest.approx(1) and got[3]["whitened"][1:] == [None, None] and got[3]["explained"][0] == 1
    assert got[3]["deviation"] == 64**2 and got[3]["identity_error"] < 1e-12


def test_deviation_beyond_longs():
    w = whitening.Whitening(10**9, [10**15, -(10**15)], np.ones(2), np.eye(2), None)
    x = np.array([[10**6 + 3, -(10**6)], [10**7, 0]], np.int64)
    assert w.deviation(x).tolist() == [min(sum((10**9 * a - s) ** 2 for a, s in zip(row, w.total, strict=True)), 2**63 - 1) for row in x.tolist()]


def test_moments_merge_like_one_batch():
    x = np.random.default_rng(5).integers(999_000, 1_001_000, (300, 7))
    whole = whitening.Moments.of(x)
    parts = [whitening.Moments.of(p) for p in np.array_split(x, 9)]
    out = parts[0]
    for p in parts[1:]:
        out = out.merge(p)
    assert out.n == 300 and out.total == x.sum(axis=0).tolist() == whole.total
    assert np.allclose(out.scatter, whole.scatter, rtol=1e-12)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_jacobi(d):
    r = np.random.default_rng(d)
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    graded = 10.0 ** -np.arange(d).clip(0, 12)
    values, v = whitening.jacobi(q * graded @ q.T)
    assert np.allclose(values, np.sort(graded)[::-1], atol=1e-14)
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13
    # a scaled diagonally dominant matrix: the smallest eigenvalue has a small relative error
    s = 10.0 ** -np.arange(d, dtype=float).clip(0, 9)
    a = (np.eye(d) + 0.05 * (np.ones((d, d)) - np.eye(d)) / d) * s[:, None] * s
    assert np.prod(whitening.jacobi(a)[0]) == pytest.approx(np.prod(s**2) * np.linalg.det(a / s[:, None] / s), rel=1e-12)


def test_pairs_of_a_sweep():
    for d in range(2, 9):
        pairs = [(p, q) for a, b in whitening._rounds(d) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(pairs) == list(itertools.combinations(range(d), 2))


def test_whitening_query(spark):
    got = whitening.op11_embedding_whitening(spark, DATA).toPandas()
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert len(got) == 16 * n and set(got.component) == set(range(1, 17)) and got.identity_error.max() < 1e-9
