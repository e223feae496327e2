"""Quality rules: text counts and tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated 8-word windows. Fertility is
measured with a public vocabulary: characters per token, the share of byte-fallback tokens, and
the entropy of the token distribution relative to the most that as many tokens can have. A
document is rejected outside the band of its language, or of its script where the language has
none. Tokens are those of each word by itself, so every distinct word is encoded once.

Bands of languages stand just outside the clean text of the test tables: they reject random
letters, text of which the vocabulary knows next to nothing, all symbols, and words stuttered over
and over. Short texts vary more and have lower relative limits of entropy in bits, so the least
characters per token falls with the square root of the tokens, and the least entropy is a share of
the most possible up to a number of bits. Bands of scripts are wider, for no clean text was measured.

Words: ``[^\\x20\\x09-\\x0D]+`` of the whole text. Defined results: null and empty texts have no words and
fail the base rules (n_words < 20). A null language uses the script's band. Other columns are
ignored; every input row gives one row, repeated ids included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.textio import documents
from spliceloom.llm.words import FEW_BYTES, FEW_UNITS, FEWEST_BYTES, UnitStore, _sum_by, flat_lists, slices, split_spaces

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
SPACES = "\n\t\r\v\f"


@dataclass(frozen=True)
class Band:
    """Limits of fertility; outside one of them a document is rejected."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float]
    #: Relative entropy falls with length, so no more bits than these are asked of any text.
    most_bits: float = 4.0
    #: The least characters per token is lower by this over the square root of the tokens.
    slack: float = 0.0


#: By language code.
LANGUAGE_BANDS: dict[str, Band] = {
    "en": Band((1.80, 12.0), 0.10, (0.65, 1.0), 5.0, 1.2),
    "de": Band((1.80, 14.0), 0.10, (0.65, 1.0), 5.0, 1.2),
    "fr": Band((1.70, 12.0), 0.10, (0.65, 1.0), 5.0, 1.6),
    "es": Band((1.75, 12.0), 0.10, (0.65, 1.0), 5.0, 1.3),
}
#: By script, for languages without a band of their own.
SCRIPT_BANDS: dict[str, Band] = {
    "latin": Band((1.2, 14.0), 0.25, (0.60, 1.0), 4.5),
    "cyrillic": Band((0.8, 12.0), 0.35, (0.30, 1.0)),
    "cjk": Band((0.2, 4.0), 0.90, (0.30, 1.0)),
    "other": Band((0.15, 12.0), 1.0, (0.25, 1.0)),
}
#: Fertility needs this many tokens to say anything.
LEAST_TOKENS = 16


def script_of(text: str) -> str:
    """The script of most letters."""
    n = dict.fromkeys(SCRIPT_BANDS, 0)
    for c in text:
        if c.isalpha():
            o = ord(c)
            n["latin" if o < 0x250 else "cyrillic" if 0x400 <= o < 0x530 else "cjk" if 0x3040 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 else "other"] += 1
    return max(n, key=n.get) if any(n.values()) else "other"


def fertility_ok(text: str, lang: str | None, chars: int, tokens: int, byte_tokens: int, entropy: float) -> bool:
    if tokens < LEAST_TOKENS:
        return True
    band = LANGUAGE_BANDS.get(lang or "") or SCRIPT_BANDS[script_of(text)]
    low = min(band.entropy[0] * math.log2(tokens), band.most_bits)
    least = band.chars_per_token[0] - band.slack / math.sqrt(tokens)
    bits = entropy * math.log2(tokens)
    return least <= chars / tokens <= band.chars_per_token[1] and byte_tokens / tokens <= band.byte_share and low <= bits and entropy <= band.entropy[1] + 1e-9


class Vocabulary:
    """A sentencepiece model behind a store of words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.store = UnitStore(lambda words: flat_lists(self.model.encode(words, num_threads=1)), FEW_UNITS)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One a process and file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def repeated_words(codes: np.ndarray, counts: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Words of each text that stand in a k-word window found twice or more in the text.

    ``codes``: a number for each word, equal words equal; ``counts``: words of each text. Windows
    are sorted by a 64-bit mix of their words and text; neighbours of equal mix are compared word
    by word, and a text where two windows share a mix by chance is done again with exact keys.
    """
    n = len(codes)
    out = np.zeros(len(counts), np.int64)
    if n < k:
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    rng = np.random.default_rng(8)
    mix = np.zeros(n - k + 1, np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    for j in range(k):
        mix += (c[j : n - k + 1 + j] * np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)) ^ (c[j : n - k + 1 + j] << np.uint64(j + 13))
    mix ^= mix >> np.uint64(29)
    mix += owner[: n - k + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
    at = at[np.argsort(mix[at], kind="stable")]
    same = np.flatnonzero((mix[at[1:]] == mix[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]]))
    a, b = at[same], at[same + 1]
    equal = (codes[a[:, None] + np.arange(k)] == codes[b[:, None] + np.arange(k)]).all(axis=1)
    redo = set(owner[a[~equal]].tolist())
    cover = np.zeros(n + 1, np.int64)
    hit = np.unique(np.concatenate([a, b]))
    cover[hit] += 1
    cover[hit + k] -= 1
    covered = np.cumsum(cover[:-1]) > 0
    out = _sum_by(counts, covered.astype(np.int64))
    ends = np.cumsum(counts)
    for d in redo:
        out[d] = _repeated_exact(codes[ends[d] - counts[d] : ends[d]].tolist(), k)
    return out


def _repeated_exact(words: list, k: int = WINDOW) -> int:
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({i + j for starts in seen.values() if len(starts) > 1 for i in starts for j in range(k)})


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
    return len(lines) - len(set(lines))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "byte_share", "entropy")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, byte_share double, entropy double"


def measure(texts: pa.Array, langs: list[str | None], v: Vocabulary) -> list[np.ndarray]:
    """The columns of SCHEMA but doc_id, for texts without nulls."""
    plain = texts
    for c in SPACES:
        plain = pc.replace_substring(plain, c, " ")
    codes, parts, n_parts = split_spaces(plain)
    real = codes != parts.index("") if "" in parts else np.ones(len(codes), bool)
    n_words = _sum_by(n_parts, real.astype(np.int64))
    codes = codes[real]
    table = pa.array(parts, pa.string())
    chars = pc.utf8_length(table).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(table, f"[{SYMBOLS}]").to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars, n_symbols = _sum_by(n_words, chars[codes]), _sum_by(n_words, symbols[codes])
    whole = texts.to_pylist()
    n_dup = np.array([repeated_lines(t) for t in whole], np.int64)
    n_repeat = repeated_words(codes, n_words)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)

    ids, per_word = v.store.gather(v.store.rows(parts)[codes])
    tokens = _sum_by(n_words, per_word)
    byte_tokens = _sum_by(tokens, v.is_byte[ids].astype(np.int64))
    # token counts of each text, by sorting (text, id)
    key = np.sort(np.repeat(np.arange(len(tokens), dtype=np.int64) << 20, tokens) | ids)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([edge, [len(key)]]))
    owner = key[edge] >> 20
    plogp = np.bincount(owner, count * np.log2(np.maximum(count, 1)), len(tokens)) if len(key) else np.zeros(len(tokens))
    t = np.maximum(tokens, 1)
    entropy = np.where(tokens > 1, (np.log2(t) - plogp / t) / np.maximum(np.log2(t), 1e-9), 0.0)
    kept = np.array([not f and fertility_ok(*x) for f, *x in zip(base_failed.tolist(), whole, langs, word_chars.tolist(), tokens.tolist(), byte_tokens.tolist(), entropy.tolist(), strict=True)], bool)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, tokens, byte_tokens / t, entropy]


def quality_rules(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document, see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for b in batches:
            ids, langs = b.column(0), b.column(2).to_pylist()
            for first, texts in slices(b.column(1), FEW_BYTES):
                out = measure(texts, langs[first : first + len(texts)], v)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), *(pa.array(x) for x in out)], names=list(COLUMNS))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(run, SCHEMA)


def quality_filter(docs: DataFrame, vocabulary_path: str, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are, in one pass without a shuffle."""
    names = docs.columns
    text_at, lang_at = names.index(text_col), names.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for b in batches:
            langs = b.column(lang_at).to_pylist()
            for first, texts in slices(b.column(text_at), FEWEST_BYTES):
                kept = measure(texts, langs[first : first + len(texts)], v)[6]
                yield b.slice(first, len(texts)).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return quality_rules(documents(spark, sf_dir), vocabulary_path or public_tokenizers.path("piece_bpe_32k.model"))
