"""Secret scans: pattern spans plus assignment-aware lexing.

Patterns: the three base kinds (assign, access, hex), leftmost and non-overlapping per kind.

Lexing: lines with ``=`` or ``:`` are cut into tokens, and source and configuration syntax is parsed
into name-literal pairs: ``name = literal``, ``name: literal``, ``:=``, ``=>``, ``"name": literal``,
``cfg["name"] = literal``, ``name[] = literal``, with type annotations before or behind the name,
attributes ``name="..." value="..."``, quoted, triple-quoted and bare literals, block scalars, a
literal as the one argument of a call, and concatenations of literals and names. A name that was
given a value is a constant; a name in a value stands for its latest assignment before, or else its
first one after. Comments are scopes of their own: their literals count, but their names mean
nothing to code. Quoted text that is no value is parsed in turn.

A value's score is how sensitive the words of its target name are, times its own form (length,
alphabets mixed, character entropy). Where it reaches the threshold, all literals that the value is
made of, here or through constants, become spans of kind ``literal``.

Work grows with the length of the text: every token is looked at once, values are kept as
character counts, and reached constants are marked once.

Defined results: null and empty texts have no spans. Offsets are code points, ends exclusive.
Other columns are ignored; every input row gives one row, repeated ids included.
"""

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.textio import documents, per_document

KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run is one match, so short runs need no dropping
_QUICK = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: Weights of the words of a target name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.6, "signing": 0.5, "access": 0.4, "api": 0.3, "key": 0.4, "salt": 0.5,
    "cookie": 0.4, "session": 0.4,
}
#: A literal's score is name weight times form weight.
THRESHOLD = 0.5
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SENSITIVE_WORD = re.compile("|".join(sorted(SENSITIVE)), re.IGNORECASE)
#: Words that name the type of a variable, not the variable.
TYPES = frozenset("any bool byte bytes bytestring char character const final let nvarchar object optional str string string_view text var val varchar".split())

_OPEN = re.compile(r"[rbufRBUFL@$]{0,2}(?=[\"'`])")
_OTHER = r"(?P<comment>(?:(?<=\s)|^)\#|(?<!:)//|/\*|<!--)|(?P<name>[A-Za-z_$][A-Za-z0-9_.$\-]*)|(?P<op>[=!]==?|<=|>=|=>|=~|:=|\?=|::|:/{2}|[=:])|(?P<mark>[\[\](){},;?*&])"
_TOKEN = re.compile(rf"(?P<string>(?<![A-Za-z0-9_]){_OPEN.pattern})|{_OTHER}", re.MULTILINE)
_NO_STRING = re.compile(_OTHER, re.MULTILINE)
#: What a string holds, up to its closing quote; escapes are pairs.
_BODY = {q: re.compile(rf"(?:\\.|[^{q}\\\n])*", re.DOTALL) for q in "\"'`"} | {q: re.compile(rf"(?:\\.|(?!{q})[^\\])*", re.DOTALL) for q in ('"""', "'''")}
_ASSIGNS = ("=", ":", ":=", "=>", "?=")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]]+")
_CALL = re.compile(r"[A-Za-z_$][\w.$]*\([\x20\t]*(?=[rbufRBUFL@$]{0,2}[\"'`])")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w.$]*")
#: What joins a value to a further string, or to a further name.
_NEXT_STRING = re.compile(r"[\x20\t]*(?:(?:\+|\.\.?)[\x20\t]*(?:\\?\r?\n[\x20\t]*)?|\\\r?\n[\x20\t]*)?(?=[rbufRBUFL@$]{0,2}[\"'`])")
_NEXT_NAME = re.compile(r"[\x20\t]*\+[\x20\t]*(?:\\?\r?\n[\x20\t]*)?(?=[A-Za-z_$])")
#: A type behind a colon: blanks, then letters and marks of types up to the sign that assigns.
_BLANKS = re.compile(r"[\x20\t]*")
_TYPE = re.compile(r"(?=[A-Za-z_&*])[\w.\[\],\x20|<>?*&:]+")
_BLOCK = re.compile(r"[\x20\t]*[|>][+\-]?[0-9]?[\x20\t]*(?:#[^\n]*)?\n")
_INDENT = re.compile(r"[\x20\t]*(?:-[\x20\t]+)*")


def name_weight(name: str) -> float:
    """How sensitive a target name is: the sum of its words' weights, 1 at most."""
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    both = ["".join(p) for p in zip(parts, parts[1:], strict=False)]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in parts) + sum(SENSITIVE.get(p, 0.0) for p in both if p == "apikey"))


def form_weight(counts: Counter) -> float:
    """How much a value of these characters looks like a key: 0 for words and short or spaced text, 1 for long mixed characters."""
    n = sum(counts.values())
    if n < 8 or any(c.isspace() for c in counts):
        return 0.0
    kinds = any(c.islower() for c in counts) + any(c.isupper() for c in counts) + any(c.isdigit() for c in counts) + any(not c.isalnum() for c in counts)
    if kinds < 2:
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in counts.values())
    return min(1.0, n / 16) * min(1.0, bits / 3.0)


@dataclass
class Assignment:
    """Target names and what they are given: literals (start, end, text) and names, in order; a bare word is both."""

    scope: str
    names: tuple[str, ...]
    parts: list[tuple] = field(default_factory=list)


class Tokens:
    """The tokens of a statement so far. Each knows its partner, if it closes a bracket, and the last token that is no pointer mark."""

    def __init__(self):
        self.rows: list[tuple[str, str, tuple | None, int, int]] = []
        self.open: list[int] = []

    def add(self, kind: str, word: str, string: tuple | None = None) -> None:
        here, partner = len(self.rows), -1
        if word == "[":
            self.open.append(here)
        elif word == "]" and self.open:
            partner = self.open.pop()
        base = here if word not in ("?", "*", "&") else self.rows[-1][4] if self.rows else -1
        self.rows.append((kind, word, string, partner, base))

    def last(self) -> tuple | None:
        """Content of the last token, if that is a string."""
        return self.rows[-1][2] if self.rows else None

    def target(self) -> str | None:
        """What a sign behind these tokens assigns to: a name, or what stands in brackets."""
        rows = self.rows
        k = rows[-1][4] if rows else -1
        if k >= 0 and rows[k][1] == "]":
            j = rows[k][3]
            if k - j == 2:
                kind, word, string = rows[j + 1][:3]
                if kind == "string":
                    return string[2]
                if kind == "name" and word.lower() not in TYPES:
                    return word
            k = j - 1
        if k < 0:
            return None
        kind, word, string = rows[k][:3]
        if kind == "string":
            return string[2]
        if kind != "name":
            return None
        if word.lower() in TYPES and k and rows[k - 1][0] == "name":
            return rows[k - 1][1]
        return word


class Lexer:
    """The assignments of a text, in order."""

    def __init__(self, text: str):
        self.text = text
        self.found: list[Assignment] = []
        self.unclosed: dict[tuple[str, int], tuple[int, int]] = {}  # (quote, end): where strings do not close
        self.typed = (0, 0, 0)  # a stretch of characters that types are written in, and the line's end when it was read

    def read(self, start: int, end: int, scope: str = "code") -> list[Assignment]:
        text, at = self.text, start
        sign = re.compile("[=:]")
        while m := sign.search(text, at, end):
            line = max(at, text.rfind("\n", at, m.start()) + 1)
            at = self._line(line, end, scope)
        return self.found

    def _line(self, at: int, end: int, scope: str) -> int:
        """Read the line from ``at``, and further ones that its literals reach; gives where the next begins."""
        text, line = self.text, at
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        tokens = Tokens()
        annotated, key, loose = None, None, []
        while (m := self._token(at, end)) and m[1] < stop:
            kind, start, at, word, string = m
            if at > stop:
                stop = text.find("\n", at, end)
                stop = end if stop < 0 else stop
            if kind == "comment" and scope == "comment":
                continue
            if kind == "comment":
                close = {"/*": "*/", "<!--": "-->"}.get(word)
                until = stop if close is None else text.find(close, at, end)
                until = end if until < 0 else until
                self.read(at, until, "comment")
                at = until
                if at > stop:
                    stop = text.find("\n", at, end)
                    stop = end if stop < 0 else stop
            elif kind == "mark" and word in ",;({}":
                tokens, annotated = Tokens(), None
            elif kind == "op" and word in _ASSIGNS:
                names = tuple(dict.fromkeys(n for n in (annotated, tokens.target()) if n))
                if word == ":" and names and self._annotates(at, stop):
                    annotated = names[-1]
                    tokens.add(kind, word)
                    continue
                if loose and tokens.last() is loose[-1]:  # it is a name, no text by itself
                    loose.pop()
                if names and (got := self._value(at, stop, end, line, word)):
                    parts, at = got
                    if names[-1] in ("name", "key", "id") and parts[0][0] == "literal":
                        key = parts[0][3]
                    elif names[-1] in ("value", "content") and key:
                        names, key = (*names, key), None
                    self.found.append(Assignment(scope, names, parts))
                    if at > stop:
                        stop = text.find("\n", at, end)
                        stop = end if stop < 0 else stop
                    tokens = Tokens()
                annotated = None
            else:
                if kind == "string":
                    loose.append(string)
                tokens.add(kind, word, string)
        for s, e, inner in loose:
            if "=" in inner or ":" in inner:
                self.read(s, e, scope)
        return max(stop + 1, at)

    def _token(self, at: int, end: int) -> tuple[str, int, int, str, tuple | None] | None:
        """(kind, start, end, text, content of a string) of the next token."""
        while m := _TOKEN.search(self.text, at, end):
            if m.lastgroup != "string":
                return m.lastgroup, m.start(), m.end(), m[0], None
            if got := self._string(m.end(), end):
                *string, after = got
                return "string", m.start(), after, "", tuple(string)
            if other := _NO_STRING.match(self.text, m.start(), end):
                return other.lastgroup, other.start(), other.end(), other[0], None
            at = m.start() + 1
        return None

    def _string(self, at: int, end: int) -> tuple[int, int, str, int] | None:
        """(content's start and end, content, end) of the string whose opening quote is at ``at``.

        Where a string does not close, quotes of its kind up to the place where it broke off are
        escaped ones; strings that open there break off at the same place and are not read again.
        """
        text, q = self.text, self.text[at]
        for quote in (3 * q, q) if q != "`" and text.startswith(3 * q, at, end) else (q,):
            first, last = self.unclosed.get((quote, end), (0, 0))
            if first <= at < last:
                continue
            a = at + len(quote)
            z = _BODY[quote].match(text, a, end).end()
            if text.startswith(quote, z, end):
                return a, z, text[a:z], z + len(quote)
            self.unclosed[quote, end] = (at, z)
        return None

    def _quoted(self, at: int, end: int) -> tuple[int, int, str, int] | None:
        m = _OPEN.match(self.text, at, end)
        return self._string(m.end(), end) if m else None

    def _annotates(self, at: int, stop: int) -> bool:
        """Whether a type stands behind a colon, and a sign that assigns behind it. No character of types is such a sign, so a stretch of them is read once."""
        text, p = self.text, _BLANKS.match(self.text, at, stop).end()
        first, last, until = self.typed
        if not (until == stop and first <= p < last and (text[p] in "_&*" or (text[p].isascii() and text[p].isalpha()))):
            if not (m := _TYPE.match(text, p, stop)):
                return False
            first, last = m.span()
            self.typed = (first, last, stop)
        return last < stop and text[last] == "=" and not (last + 1 < stop and text[last + 1] in "=>")

    def _value(self, at: int, stop: int, end: int, line: int, op: str) -> tuple[list[tuple], int] | None:
        text = self.text
        if op == ":" and (m := _BLOCK.match(text, at, end)):
            return self._block(m.end(), end, _INDENT.match(text, line).end() - line)
        while at < stop and text[at] in "\x20\t":
            at += 1
        parts: list[tuple] = []

        def literal(s: int, e: int, value: str) -> None:
            if parts and parts[-1][0] == "literal":  # a run of literals is one span
                s, value = parts[-1][1], parts.pop()[3] + value
            parts.append(("literal", s, e, value))

        while True:
            if q := self._quoted(at, end):
                literal(*q[:3])
                at = q[3]
            elif (m := _CALL.match(text, at, end)) and (q := self._quoted(m.end(), end)):
                literal(*q[:3])
                at = q[3]
                while at < end and text[at] in "\x20\t)":
                    at += 1
            elif parts or ((m := _IDENTIFIER.match(text, at, stop)) and _NEXT_NAME.match(text, m.end(), end)) or (m and _NEXT_STRING.match(text, m.end(), end) and "+" in _NEXT_STRING.match(text, m.end(), end)[0]):
                if not (m := _IDENTIFIER.match(text, at, end)):
                    break
                parts.append(("name", m.start(), m.end(), m[0]))
                at = m.end()
            elif m := _BARE.match(text, at, stop):
                return [("bare", m.start(), m.end(), m[0])], m.end()
            else:
                break
            if not (n := _NEXT_STRING.match(text, at, end) or _NEXT_NAME.match(text, at, end)):
                break
            at = n.end()
        return (parts, at) if parts else None

    def _block(self, at: int, end: int, indent: int) -> tuple[list[tuple], int] | None:
        """The lines of a block scalar: those indented further than its key."""
        text, first, last, lines = self.text, None, at, []
        while at < end:
            stop = text.find("\n", at, end)
            stop = end if stop < 0 else stop
            row = text[at:stop]
            inner = row.strip()
            if inner and len(row) - len(row.lstrip("\x20\t")) <= indent:
                break
            if inner:
                begin = at + row.index(inner)
                first, last = begin if first is None else first, begin + len(inner)
                lines.append(inner)
            at = stop + 1
        return ([("literal", first, last, "".join(lines))], at - 1) if lines else None


def lexed(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Spans of the literals whose values reach the threshold under a target name."""
    if ("=" not in text and ":" not in text) or not _SENSITIVE_WORD.search(text):
        return []
    found = Lexer(text).read(0, len(text))
    places: dict[tuple[str, str], list[int]] = {}
    for i, x in enumerate(found):
        for n in x.names:
            places.setdefault((x.scope, n), []).append(i)

    def meant(i: int, name: str) -> int | None:
        at = places.get((found[i].scope, name), ())
        k = bisect_left(at, i) - 1
        return at[k] if k >= 0 else next(iter(at[bisect_right(at, i) :]), None)

    refs = [[meant(i, p[3]) if p[0] != "literal" else None for p in x.parts] for i, x in enumerate(found)]
    counts: list[Counter | None] = [None] * len(found)
    open_now = set()
    for root in range(len(found)):
        todo = [root]
        while todo:
            i = todo[-1]
            if counts[i] is not None:
                todo.pop()
                continue
            need = [] if i in open_now else [r for r in refs[i] if r is not None and counts[r] is None and r not in open_now]
            if need:
                open_now.add(i)
                todo += need
                continue
            total = Counter()
            for p, r in zip(found[i].parts, refs[i], strict=True):
                if r is not None:  # a value that waits for itself adds nothing
                    total.update(counts[r] or {})
                elif p[0] != "name":
                    total.update(p[3])
            counts[i] = total
            open_now.discard(i)
            todo.pop()
    todo = [i for i, x in enumerate(found) if (w := max(map(name_weight, x.names))) > 0 and w * form_weight(counts[i]) >= threshold]
    reached, out = set(todo), set()
    while todo:
        i = todo.pop()
        for p, r in zip(found[i].parts, refs[i], strict=True):
            if r is not None:
                if r not in reached:
                    reached.add(r)
                    todo.append(r)
            elif p[0] != "name":
                out.add((p[1], p[2]))
    return sorted(out)


def spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed. Base spans always stay."""
    text = text or ""
    out = []
    if _QUICK.search(text):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    out += [(s, e, 3) for s, e in lexed(text, threshold)]
    out.sort(key=lambda x: (x[0], x[2], x[1]))
    return [(s, e, KINDS[k]) for s, e, k in out]


def _joined(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, see SCHEMA. ``base_sha256`` digests the base spans, ``spans`` lists all."""

    def row(doc_id, text):
        found = spans(text, threshold)
        base = [x for x in found if x[2] != "literal"]
        n = Counter(x[2] for x in base)
        return doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)

    return per_document(docs, SCHEMA, row, id_col, text_col)


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each stretch of touching spans replaced by ``[secret]``."""
    found = spans(text, threshold)
    if not found:
        return text
    out, at = [], 0
    for s, e, _ in found:
        if s >= at or not out:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col``; all other columns stay as they are."""

    @F.pandas_udf("string")
    def hidden(s: pd.Series) -> pd.Series:
        return s.map(lambda t: redact(t, threshold), na_action="ignore")

    return docs.withColumn(text_col, hidden(F.col(text_col)))


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
