"""Suffix-array dedup: long repeats across documents, by run-length indexes.

A byte goes when a ``span``-byte string that covers it also starts in a document with a smaller
id. The work is dealt out by content, so that every index stays small and no text travels twice:

1. Every ``span``-byte window has an anchor, the least-hashed ``GRAM`` bytes in it. Equal windows
   have equal anchors at equal places. The hashes of all documents' anchors meet in buckets; each
   stretch of rows hears back which of its hashes several documents have.
2. Windows that share an anchor form a stretch. Stretches whose anchor several documents have go
   to the bucket of their anchor: every distinct stretch of a slice once, with the smallest id there.
3. A bucket has each stretch with the smallest id that holds it and the number of its copies in
   larger ids. Stretches of an anchor are halved by id, again and again: the half of smaller ids
   becomes a run-length index (run-compressed Burrows-Wheeler transform with samples at run ends),
   in which copies lengthen the runs; the other half, and a copy of each stretch that larger ids
   hold too, are streamed through it, and where the matching statistics reach ``span`` the window is
   known to stand in a smaller id. A stretch that shares no seed around its anchor with another one
   of another id meets its own copies only, as every shared window holds a seed. Each slice hears
   back, for its stretches, their smallest id, the windows that smaller ids than that hold, and
   those that larger ids find in front of them.
   An anchor that very many stretches have would fill a task; its windows are anchored anew, by
   the least-hashed bytes in them that differ from it, and travel by both hashes.
4. Each document looks up its stretches and removes the bytes of the windows found for its id.

Steps 1, 2 and 4 read the same files. What returns are facts about strings, addressed to rows of a
file, so the passes may cut the files into other partitions, as they do when executors come or go.
Messages return as small tables in the shared folder, a directory for each block of rows of a
file, in the order of the rows, and tasks read along as they go through theirs. How often a
stretch stands in a slice makes no message longer. Stretches are named by 128 bits: the hash of
their anchor and that of all their bytes.

Defined results: null texts are empty. Texts shorter than ``span`` are kept. Rows with equal ids
never remove each other's bytes; a null id is larger than any other and removes nothing from
other null ids. Other columns are ignored. Every input row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.letters import Letters, as_scan, breaks, packed, unpacked
from spliceloom.llm.runindex import END, RunIndex, ranges
from spliceloom.llm.textio import documents

SPAN = 50
#: Bytes of an anchor.
GRAM = 20
#: Bytes of text whose anchors are found in one step, at most 2**23, and of a slice, which sends one message to a bucket.
PIECE, SLICE = 1 << 18, 4 << 20
#: Documents of one batch of results.
ROWS = 500
#: Suffixes of one run-length index, about.
INDEX = 250_000
#: Bytes of text for each bucket of anchors, about.
BUCKET_BYTES = 8 << 20
#: Stretches of an anchor, about, beyond which its windows are anchored anew.
HOT = 50_000
#: Seeds around an anchor, of which each shared window has one.
SEEDS = 5
#: Windows that are anchored anew in one step.
STEP = 1 << 16
NULL_ID = 2**63 - 1
PLACE = np.uint64((1 << 24) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each place, by doubling."""
    table = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base, h, length = 0x9E3779B97F4A7C15 | 1, table[data], 1
    out, used = None, 0  # of the bits of GRAM so far, low to high
    while True:
        if GRAM & length:
            if out is None:
                out = h
            else:
                n = len(data) - used - length + 1
                out = h[:n] * np.uint64(pow(base, used, 1 << 64)) + out[length : length + n]
            used += length
        if 2 * length > GRAM:
            return _mix(out)
        h = h[:-length] * np.uint64(pow(base, length, 1 << 64)) + h[length:]
        length *= 2


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes mixed again: the least ones of windows are small numbers, which would fill few buckets."""
    return _mix(h * np.uint64(0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(for each window start: place of the leftmost least hash within the window, all hashes)."""
    h = gram_hashes(data)
    key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    w, length, m = span - GRAM + 1, 1, key
    while 2 * length <= w:
        m = np.minimum(m[:-length], m[length:])
        length *= 2
    if length < w:
        m = np.minimum(m[: len(m) - (w - length)], m[w - length :])
    return (m & PLACE).astype(np.int64), h


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int):
    """Stretches of windows with one anchor: (document, first window, windows, anchor hash).

    ``starts`` and ``ends`` bound the documents in ``data``; windows don't cross them.
    """
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none.astype(np.uint64)
    place, h = anchors(data, span)
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= span
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - span + 1, -1)
    ok = np.cumsum(inside[: len(place)]) > 0
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    new = np.concatenate([[True], (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
    return np.searchsorted(starts, first, "right") - 1, first, count, _spread(h[place[first]])


def stretches_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int):
    """``stretches`` in steps of about PIECE bytes; a longer document is cut, its pieces overlap by span - 1 bytes."""
    out = [stretches(data[:0], starts[:0], ends[:0], span)]
    d = 0
    while d < len(starts):
        a = int(starts[d])
        z = max(d + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        if ends[d] - a > 2 * PIECE:
            z, end = d + 1, int(ends[d])
            for x in range(a, max(a + 1, end - span + 1), PIECE):
                y = min(end, x + PIECE + span - 1)
                _, first, count, h = stretches(data[x:y], np.array([0]), np.array([y - x]), span)
                out.append((np.full(len(first), d), first + x, count, h))
        else:
            owner, first, count, h = stretches(data[a : ends[z - 1]], starts[d:z] - a, ends[d:z] - a, span)
            out.append((owner + d, first + a, count, h))
        d = z
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _slices(batches: Iterator[pa.RecordBatch]):
    """(file, rows, ids, bytes, starts, ends) of stretches of rows of one block of a file, SLICE bytes or one row each.

    Columns: file, row, id, text.
    """
    for b in batches:
        files, rows = (b.column(i).to_numpy() for i in (0, 1))
        ids = b.column(2).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        text = b.column(3).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        fresh = breaks(files, rows)
        for x, y in zip([0, *fresh.tolist()], [*fresh.tolist(), len(text)], strict=True):
            a = x
            while a < y:
                z = min(y, max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1))
                cut = offsets[a : z + 1] - offsets[a]
                yield int(files[a]), rows[a:z], ids[a:z], data[offsets[a] : offsets[z]], cut[:-1], cut[1:]
                a = z


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _runs(new: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of a sequence, by whether each element but the first begins one."""
    cut = (np.flatnonzero(new) + 1).tolist()
    return list(zip([0, *cut], [*cut, len(new) + 1], strict=True))


def _shared_list(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, a byte each: 128 if several documents have it, and the bits of the number of its stretches)."""
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    bits = np.ceil(np.log2(np.diff(np.concatenate([at, [len(h)]])) + 1)).astype(np.uint8)
    return h[at], bits | (128 * (np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at))).astype(np.uint8)


def _matrix(data: np.ndarray, first: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """The strings as rows of whole words, padded with END."""
    width = -(-width // 8) * 8
    text = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.full(width, END, np.uint8)]), width)[first]
    text[np.arange(width) >= length[:, None]] = END
    return text


def _string_hashes(strings: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of all bytes of each row, from the hash of its anchor on."""
    own = h.copy()
    for word in strings.view("<u8").T:
        own = _mix(own * np.uint64(0x9E3779B97F4A7C15) + word)
    return own


def _anchored_anew(data, owner, first, count, h, is_hot, span: int):
    """The stretches, those that are hot cut by the second anchors of their windows, with a hash of both anchors."""
    n = count[is_hot]
    length = n + span - 1
    base = np.cumsum(length) - length
    grams = gram_hashes(data[ranges(first[is_hot], length)])  # of these stretches alone
    start, old, of = ranges(base, n), np.repeat(h[is_hot], n), np.repeat(np.arange(len(n)), n)
    place, key = np.empty(len(start), np.int64), np.empty(len(start), np.uint64)
    for a in range(0, len(start), STEP):
        at = start[a : a + STEP, None] + np.arange(span - GRAM + 1)
        raw = grams[at]
        raw[_spread(raw) == old[a : a + STEP, None]] = np.uint64(2**64 - 1)  # a window that holds nothing else is one byte repeated
        k = raw.argmin(axis=1)
        place[a : a + STEP] = start[a : a + STEP] + k
        key[a : a + STEP] = _mix(_spread(raw[np.arange(len(k)), k]) * np.uint64(0x9E3779B97F4A7C15) + old[a : a + STEP])
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])]))
    cold = ~is_hot
    return (
        np.concatenate([owner[cold], owner[is_hot][of[new]]]), np.concatenate([first[cold], (start - base[of] + first[is_hot][of])[new]]), np.concatenate([count[cold], np.diff(np.concatenate([new, [len(start)]]))]), np.concatenate([h[cold], key[new]]),
    )


def mark_stretches(
    data: np.ndarray, first: np.ndarray, length: np.ndarray, group: np.ndarray, least: np.ndarray, span: int, *, later: np.ndarray | None = None, copies: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(string, window): windows of the strings data[first : first + length] that a string of their group with a smaller ``least`` holds.

    Strings that are ``later`` stand for the copies of a string in ids above its ``least``: that string is in front of
    them, too, and they are asked for only, as what they hold stands there. Others stand ``copies`` times in an index.

    The ids of a group are ranked. At level k, blocks of 2**(k + 1) ranks are halved: the lower half is
    indexed, the upper half streamed. Any two ids part at one level, so every window meets all smaller
    ids. A string of which nothing is left is out of all further levels.
    """
    later = np.zeros(len(length), bool) if later is None else later
    copies = np.ones(len(length), np.int64) if copies is None else copies
    order = np.lexsort((later, least, group))
    g, v, after = group[order], least[order], later[order]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    steps = np.cumsum(new_group | np.concatenate([[True], (v[1:] != v[:-1]) | (after[1:] != after[:-1])]))
    rank = np.empty(len(order), np.int64)
    rank[order] = steps - steps[new_group][np.cumsum(new_group) - 1]
    windows = length - span + 1
    gone = np.zeros((len(length), int(windows.max(initial=1))), bool)
    whole = np.zeros(len(length), bool)
    _, group = np.unique(group, return_inverse=True)
    top = np.zeros(int(group.max(initial=0)) + 1, np.int64)
    np.maximum.at(top, group, rank)
    live = order[top[group[order]] > 0]  # strings of a colour side by side
    level = 0
    while len(live := live[(top[group[live]] >> level > 0) & ~whole[live]]):
        upper = rank[live] >> level & 1 == 1
        lower = ~upper & ~later[live]
        colour = group[live] * (int(top.max()) + 1) + (rank[live] >> (level + 1))
        colour = np.searchsorted(np.unique(colour), colour)
        sides = (np.bincount(colour[side], minlength=int(colour.max()) + 1) for side in (lower, upper))
        both = np.logical_and(*(n > 0 for n in sides))
        size = np.where(both, np.bincount(colour, (length[live] + 1) * (lower | upper), len(both)), 0)
        part = np.where(both, np.cumsum(size) // INDEX, -1)[colour]
        for p in np.unique(part[part >= 0]).tolist():
            low, high = (np.flatnonzero((part == p) & side) for side in (lower, upper))
            of_low, of_high = colour[low], colour[high]
            low, high = live[low], live[high]
            index = RunIndex(data, first[low], length[low], of_low, copies[low])
            for who, place, matched in index.matching_statistics(data, first[high], length[high], of_high, span):
                hit = matched >= span
                gone[high[who[hit]], place[hit]] = True
            whole[high] = gone[high].sum(axis=1) == windows[high]
        level += 1
    return np.nonzero(gone)


def _two_ids(key: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a key stands with several ids."""
    order = np.argsort(key)
    k, v = key[order], least[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    out = np.empty(len(key), bool)
    out[order] = np.repeat(np.minimum.reduceat(v, at) != np.maximum.reduceat(v, at), np.diff(np.concatenate([at, [len(k)]])))
    return out


def may_share(strings: np.ndarray, length: np.ndarray, h: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """Numbers of the strings that may share a window with one of another id; windows of the others are their own.

    A window holds the anchor and ``span`` - GRAM bytes more, so many before it as fall into one of
    SEEDS steps. Each step is a seed: the anchor with the bytes on either side that all windows of the
    step hold. Strings without their anchor in them, as those anchored anew, are not judged.
    """
    wide, extra = strings.shape[1], span - GRAM
    live = np.flatnonzero(_two_ids(h, least))
    if not len(live):
        return live
    flat = strings[live].ravel()
    at = np.flatnonzero(_spread(gram_hashes(flat)) == np.repeat(h[live], wide)[: len(flat) - GRAM + 1])
    row, place = at // wide, at % wide
    inside = place + GRAM <= length[live[row]]
    row, one = np.unique(row[inside], return_index=True)  # the leftmost: where it stands again, windows have the first
    at, place, n = at[inside][one], place[inside][one], length[live[row]]
    keep = np.ones(len(live), bool)
    keep[row] = False
    step = -(-extra // SEEDS)
    for left in range(0, extra, step):
        right = max(0, extra - left - step)
        k = np.flatnonzero((place >= left) & (place + GRAM + right <= n))
        if len(k):
            size = left + GRAM + right
            seed = np.full((len(k), -(-size // 8) * 8), END, np.uint8)
            seed[:, :size] = np.lib.stride_tricks.sliding_window_view(flat, size)[at[k] - left]
            keep[row[k[_two_ids(_string_hashes(seed, h[live[row[k]]]), least[live[row[k]]])]]] = True
    return live[keep]


#: Kinds of the arrays of a message of stretches: lengths, anchor hashes, smallest ids, copies in larger ids, bytes.
STRETCHES = ("<u2", "<u8", "<i8", "<u4", "u1")
#: Kinds of those of the answer: anchor hashes, hashes of all bytes, smallest ids, bits of the windows that go at the smallest id and at larger ones.
FACTS = ("<u8", "<u8", "<i8", "u1")


def _bucket_facts(messages: list[bytes], span: int) -> Iterator[bytes | None]:
    """The answer to each message of a bucket, None where nothing of its stretches goes."""
    width = 2 * span - GRAM
    got = [unpacked(m, *STRETCHES) for m in messages]
    length, hashes, ids, further, data = (np.concatenate([r[i] for r in got]) for i in range(5))
    length = length.astype(np.int64)
    first = np.cumsum(length) - length
    strings = _matrix(data, first, length, width)
    own = _string_hashes(strings, hashes)
    name, lead, same = np.unique(own, return_index=True, return_inverse=True)
    if not (strings[lead[same]] == strings).all():
        raise RuntimeError("two stretches share a name")
    least = np.full(len(lead), NULL_ID, np.int64)
    np.minimum.at(least, same, ids)
    behind = further + (ids > least[same])
    copies = np.bincount(same, behind, len(lead)).astype(np.int64)
    shares = np.zeros(len(lead), bool)
    shares[may_share(strings[lead], length[lead], hashes[lead], least, span)] = True
    here, again = np.flatnonzero(shares | (copies > 0)), np.flatnonzero(copies)
    item = np.concatenate([here, again])
    later = np.arange(len(item)) >= len(here)
    group = np.where(shares, hashes[lead], name)[item]
    s, w = mark_stretches(data, first[lead[item]], length[lead[item]], group, least[item], span, later=later, copies=1 + copies[item])
    windows = np.zeros((len(lead), 2, span - GRAM + 1), bool)
    windows[item[s], later[s].astype(int), w] = True
    bits = np.packbits(windows, axis=2)
    some = windows.any(axis=2)[same]
    useful = some[:, 0] | (some[:, 1] & (behind > 0))
    at = 0
    for r in got:
        k = at + np.flatnonzero(useful[at : at + len(r[0])])
        at += len(r[0])
        yield packed(hashes[k], own[k], least[same[k]], bits[same[k]].ravel()) if len(k) else None


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by [start, end); touching ones join."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def removed_spans(docs: DataFrame, *, span: int = SPAN, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document, see SCHEMA; with ``with_text`` also the remaining bytes as ``kept``.

    ``docs`` is read three times by file and row; where it is no plain scan of files, ids and texts
    are first written to the shared folder.
    """
    if span < GRAM + 1:
        raise ValueError(f"span must exceed {GRAM}")
    docs = as_scan(docs, id=F.col(id_col).cast("long"), text=F.col(text_col).cast("binary"))
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    width = 2 * span - GRAM

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, rows, _, data, starts, ends in _slices(batches):
            owner, _, _, h = stretches_of(data, starts, ends, span)
            if not len(h):
                continue
            h, seen = _shared_list(owner, h)
            to = _bucket_of(h, buckets)  # ascending, as the hashes are
            runs = _runs(np.diff(to) != 0)
            low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(to[a]) for a, _ in runs]), *(pa.array([x] * len(runs), pa.int64()) for x in (file, int(rows[0]), int(rows[-1]))),
                 pa.array([low[a:z].tobytes() for a, z in runs], pa.binary()), pa.array([seen[a:z].tobytes() for a, z in runs], pa.binary())],
                names=["bucket", "file", "lo", "hi", "hashes", "seen"],
            )

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(x, np.uint32) for x in pdf["hashes"]]
        sizes = [len(x) for x in lists]
        seen = np.frombuffer(b"".join(pdf["seen"]), np.uint8)
        h = np.concatenate(lists)
        _, same = np.unique(h, return_inverse=True)
        shared = (np.bincount(same, 1 + (seen >> 7)) > 1)[same]
        is_hot = (np.bincount(same, 2.0 ** (seen & 127) - 1) > hot)[same]
        cut = np.cumsum(sizes)[:-1]
        parts = list(zip(np.split(h, cut), np.split(shared, cut), np.split(is_hot, cut), strict=True))
        out = pd.DataFrame({"file": pdf["file"], "lo": pdf["lo"], "hi": pdf["hi"], "bucket": pdf["bucket"], "known": [packed(x[k], w[k]) for x, k, w in parts]})
        return out[[bool(k.any()) for _, k, _ in parts]]

    asked = docs.mapInArrow(ask, "bucket long, file long, lo long, hi long, hashes binary, seen binary")
    answers = Letters(asked.groupBy("bucket").applyInPandas(answer, "file long, lo long, hi long, bucket long, known binary"), ["bucket", "known"])

    def shared(letters: list[tuple], data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(document, first byte, length, hash) of the stretches of a slice whose anchors several documents have."""
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        if not letters:
            return none
        # which hashes several documents have is a fact about the hash: letters to other rows do no harm
        known, is_hot = [], []
        for _, _, bucket, told in letters:
            low, warm = unpacked(told, "<u4", "?")
            known.append((np.uint64(bucket) << np.uint64(32)) | low)
            is_hot.append(warm)
        known, at = np.unique(np.concatenate(known), return_index=True)
        is_hot = np.concatenate(is_hot)[at]
        owner, first, count, h = stretches_of(data, starts, ends, span)
        key = (_bucket_of(h, buckets).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        k = np.flatnonzero(known[at] == key)
        if not len(k):
            return none
        is_hot = is_hot[at[k]]
        owner, first, count, h = owner[k], first[k], count[k], h[k]
        if is_hot.any():
            owner, first, count, h = _anchored_anew(data, owner, first, count, h, is_hot, span)
        return owner, first, count + span - 1, h

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = answers.reader()
        for file, rows, ids, data, starts, ends in _slices(batches):
            owner, first, length, h = shared(read(file, int(rows[0]), int(rows[-1])), data, starts, ends)
            if not len(h):
                continue
            # equal stretches once, in the order of their buckets
            _, lead, same = np.unique(_string_hashes(_matrix(data, first, length, width), h), return_index=True, return_inverse=True)
            least = np.full(len(lead), NULL_ID, np.int64)
            np.minimum.at(least, same, ids[owner])
            further = np.bincount(same, ids[owner] > least[same], len(lead)).astype("<u4")
            to = _bucket_of(h[lead], buckets)
            order = np.argsort(to, kind="stable")
            to, lead, least, further = to[order], lead[order], least[order], further[order]
            names, out = [], []
            for a, z in _runs(np.diff(to) != 0):
                d = lead[a:z]
                names.append(int(to[a]))
                out.append(packed(length[d].astype("<u2"), h[d], least[a:z], further[a:z], data[ranges(first[d], length[d])]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), *(pa.array([x] * len(names), pa.int64()) for x in (file, int(rows[0]), int(rows[-1]))), pa.array(out, pa.binary())], names=["bucket", "file", "lo", "hi", "stretches"]
            )

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["file", "lo", "hi"]].assign(facts=list(_bucket_facts(list(pdf["stretches"]), span)))
        return out[out["facts"].notna()]

    sent = docs.mapInArrow(send, "bucket long, file long, lo long, hi long, stretches binary")
    facts = Letters(sent.groupBy("bucket").applyInPandas(judge, "file long, lo long, hi long, facts binary"), ["facts"])

    def spans(letters: list[tuple], owner, first, length, h, data, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first byte, end) of what goes."""
        none = (np.zeros(0, np.int64),) * 3
        if not letters or not len(h):
            return none
        anchor, own, least, bits = (np.concatenate(x) for x in zip(*(unpacked(m, *FACTS) for _, _, m in letters), strict=True))
        bits = bits.reshape(len(own), 2, -1)
        order = np.argsort(own)
        anchor, own, least, bits = anchor[order], own[order], least[order], bits[order]
        k = np.flatnonzero(np.isin(h, anchor))
        owner, first, length, h = owner[k], first[k], length[k], h[k]
        if not len(k):
            return none
        name = _string_hashes(_matrix(data, first, length, width), h)
        at = np.minimum(np.searchsorted(own, name), len(own) - 1)
        k = np.flatnonzero((own[at] == name) & (anchor[at] == h))
        at, owner, first, length = at[k], owner[k], first[k], length[k]
        bits = bits[at, (ids[owner] > least[at]).astype(int)]
        some = np.flatnonzero(bits.any(axis=1))
        owner, first, length = owner[some], first[some], length[some]
        gone = np.unpackbits(bits[some], axis=1, count=span - GRAM + 1)
        whole = gone.sum(axis=1) == length - span + 1  # one run, not a run a window
        gone[whole] = 0
        o, w = np.nonzero(gone)
        return np.concatenate([owner[whole], owner[o]]), np.concatenate([first[whole], first[o] + w]), np.concatenate([(first + length)[whole], first[o] + w + span])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, judged = answers.reader(), facts.reader()
        fields = [*_ARROW, *([pa.field("kept", pa.binary())] if with_text else [])]
        for file, rows, ids, data, starts, ends in _slices(batches):
            letters = judged(file, int(rows[0]), int(rows[-1]))
            found = shared(read(file, int(rows[0]), int(rows[-1])) if letters else [], data, starts, ends)
            owner, a, z = spans(letters, *found, data, ids)
            order = np.argsort(owner, kind="stable")
            a, z, edge = a[order], z[order], np.searchsorted(owner[order], np.arange(len(rows) + 1))
            for x in range(0, len(rows), ROWS):
                out = []
                for i in range(x, min(len(rows), x + ROWS)):
                    text = data[starts[i] : ends[i]].tobytes()
                    runs, kept = 0, text
                    if edge[i] < edge[i + 1]:
                        p, q = union(a[edge[i] : edge[i + 1]] - starts[i], z[edge[i] : edge[i + 1]] - starts[i])
                        runs, kept = len(p), b"".join(text[u:v] for u, v in zip([0, *q.tolist()], [*p.tolist(), len(text)], strict=True))
                    doc_id = None if ids[i] == NULL_ID else int(ids[i])
                    out.append((doc_id, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return docs.mapInArrow(cut_out, SCHEMA + (", kept binary" if with_text else ""))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_spans(documents(spark, sf_dir))
