"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base spans. The lexer reads a text as source or configuration: strings with escapes, triple and
back quotes, unquoted values, comments (whose inside is read as statements of its own), calls and subscripts. It yields
name-literal pairs (``name = "literal"``, ``name: type = "literal"``, ``"name": literal``, ``name := "a" + "b"``,
``set_name("literal")``, ``env["name"] = "literal"``, ``name = ["literal", "literal"]``, ``name = get("x", "literal")``,
``<name>literal</name>``), follows names that are given to other names
anywhere in the text (``api_token = a`` before or after ``a = "xyz"``), and scores every literal by how sensitive its target
names are and by how random the literal looks. Literals at or above ``MIN_SCORE`` add spans of kind ``pair``; a concatenation is
one literal from its first to its last string. Blocks of private keys are pairs whatever their name.

Edge cases: null is an empty text and has no spans. Offsets are code points, ends exclusive. A pair span equal to or inside a
base span isn't repeated. Repeated rows give repeated result rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without one of these can't hold an assign match.
STEMS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
KINDS = ("assign", "access", "hex", "pair")

#: How sensitive a name is, by the words in it.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5,
    "credentials": 2.5, "private": 1.5, "access": 1.0, "auth": 1.5, "bearer": 2.0, "signature": 1.0, "salt": 1.0, "key": 1.0, "api": 1.0,
    "dsn": 1.0, "id": -1.0, "name": -1.5, "url": -1.5, "path": -1.5, "file": -1.5, "public": -2.0, "length": -3.0, "count": -3.0,
    "type": -2.0, "label": -2.0, "example": -2.0,
}
MIN_SCORE = 4.0
#: Literals shorter than this hold no secret.
MIN_LITERAL = 8

#: Strings may be of any length and hold escaped quotes; every branch is linear in what it reads. A quote behind a letter or a digit is
#: an apostrophe or a measure and opens no string, but for the prefixes of strings.
TOKEN = re.compile(
    r"""(?P<comment>(?<!\S)\#|(?<![:\S])//|/\*|\*/)
    |(?P<triple>\"\"\".*?\"\"\"|\'\'\'.*?\'\'\')
    |(?P<str>(?<![A-Za-z0-9])(?:[bBrRuUfF]{1,2}(?=["'])(?!\"\"\"|\'\'\'))?(?:"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\\n]*(?:\\.[^`\\\n]*)*`))
    |(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*)
    |(?P<op>:=|=>|==|!=|[=:])
    |(?P<num>[0-9][A-Za-z0-9+/_.=-]*)
    |(?P<plus>\+|\.\.)
    |(?P<call>\()
    |(?P<sub>\[)
    |(?P<close>\])
    |(?P<end>[\n;,{})])""",
    re.VERBOSE | re.DOTALL,
)
#: An unquoted value.
BARE = re.compile(r"[\x20\t]*([A-Za-z0-9+/_.=~$-]+)")
#: Where statements begin that may hold a pair: at assignments, and at calls and subscripts with a string.
MARK = re.compile(r"""[=:]|[A-Za-z0-9_$]\(\s*["'`]""")
#: Characters behind a mark that the lexer reads, at least, unless the line ends; it begins at the line's start, outside of any string of the
#: line, and a name, a string or a concatenation is read whole.
AHEAD = 4200
PRIVATE, PRIVATE_END = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"), re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY-----")
#: ``<name>literal</name>``, and the tags of ``<x name="name" value="literal"/>`` and ``<x name="name">literal</x>``.
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?:\s[^<>]*)?>([^<>]*)</\1\s*>")
TAG = re.compile(r"<[A-Za-z_][^<>]*>(?:([^<>]*)</)?")
NAMED = re.compile(r"""\s(?:name|key|id)\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)')""")
VALUED = re.compile(r"""\svalue\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)')""")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """Sum of the weights of the words of a name in snake, kebab, dotted or camel case, plural or not."""
    parts = [p.lower() for p in PART.findall(name)]
    score = sum(NAME_WEIGHTS.get(p, NAME_WEIGHTS.get(p.removesuffix("s"), 0.0)) for p in parts)
    return score + sum(NAME_WEIGHTS.get(a + b, 0.0) for a, b in zip(parts, parts[1:]))


def literal_score(literal: str) -> float:
    """Up to 3 for a literal that looks random: bits per character, and kinds of characters."""
    n = len(literal)
    if n < MIN_LITERAL or " " in literal:
        return -2.0
    bits = -sum(c / n * math.log2(c / n) for c in (literal.count(x) for x in set(literal)))
    kinds = sum(any(t(x) for x in literal) for t in (str.islower, str.isupper, str.isdigit))
    return min(bits / 2, 2.0) + 0.5 * (kinds - 1)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text around its marks, in order and apart."""
    spans: list[tuple[int, int]] = []
    line = seen = 0
    for m in MARK.finditer(text):
        eol = text.rfind("\n", seen, m.start())
        line, seen = (eol + 1 if eol >= 0 else line), m.start()
        a, b = line, min(len(text), m.end() + AHEAD)
        eol = text.find("\n", m.end(), b)
        b = b if eol < 0 else eol + 1
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def private_keys(text: str) -> list[tuple[int, int]]:
    """Blocks from a beginning to the next end, each character read once."""
    out, at = [], 0
    while (m := PRIVATE.search(text, at)) and (e := PRIVATE_END.search(text, m.end())):
        out.append((m.start(), e.end()))
        at = e.end()
    return out


class Reader:
    """Reads statements of a text into literals given to names, and names given to names."""

    def __init__(self, text: str):
        self.text = text
        self.given: list[tuple[int, int, str, str]] = []  # start, end, name, literal
        self.alias: dict[str, set[str]] = {}  # names that are given the value of a name

    def inner(self, m: re.Match) -> tuple[int, int, str]:
        """Place and characters of a string without its quotes."""
        k = 3 if m.lastgroup == "triple" else 1
        token = m.group()
        a = m.start() + k + (len(token) - len(token.lstrip("bBrRuUfF")) if k == 1 else 0)
        return a, m.end() - k, self.text[a : m.end() - k]

    def listed(self, name: str, at: int, between: tuple[str, ...]) -> int:
        """Gives each string up to the first other token to a name; returns the place behind."""
        while m := TOKEN.match(self.text, self.blank(at, joined=True)):
            if m.lastgroup in ("str", "triple"):
                first, last, literal = self.inner(m)
                self.given.append((first, last, name, literal.replace("\\", "")))
            elif m.lastgroup not in between and m.group() != ",":
                break
            at = m.end()
        return at

    def value(self, name: str, at: int) -> int:
        """Reads what is given to a name from a place on, and returns the place behind it."""
        m = TOKEN.match(self.text, self.blank(at))
        if m and m.lastgroup in ("str", "triple"):
            first, last, literal = self.inner(m)
            at = m.end()
            while (m := TOKEN.match(self.text, self.blank(at, joined=True))) and m.lastgroup in ("str", "triple", "plus"):
                if m.lastgroup == "plus":
                    follows = TOKEN.match(self.text, self.blank(m.end(), joined=True))
                    if not follows or follows.lastgroup not in ("str", "triple"):
                        break
                    m = follows
                elif "\n" in self.text[at : m.start()]:
                    break
                _, last, more = self.inner(m)
                literal, at = literal + more, m.end()
            self.given.append((first, last, name, literal.replace("\\", "")))
            return at
        if m and m.lastgroup == "sub":
            return self.listed(name, m.end(), ())
        if m and m.lastgroup == "name" and self.text[m.end() : m.end() + 1] == "(":  # what a call gives, or falls back to
            return self.listed(name, m.end() + 1, ("name", "num", "op"))
        if m and m.lastgroup in ("call", "end", "comment", "op"):
            return at
        if m := BARE.match(self.text, at):
            literal = m[1].rstrip(".")
            self.given.append((m.start(1), m.start(1) + len(literal), name, literal))
            self.alias.setdefault(literal, set()).add(name)
            return m.end()
        return at

    def blank(self, at: int, joined: bool = False) -> int:
        """The next place that isn't white space; line ends count as such only within a concatenation."""
        space = " \t\r\n\\" if joined else " \t"
        while at < len(self.text) and self.text[at] in space:
            at += 1
        return at

    def read(self, a: int, b: int) -> int:
        """Reads from a to b, and beyond if a string begun before b ends there; returns the place behind."""
        name = typed = called = None
        at = a
        while at < b and (m := TOKEN.search(self.text, at)) and m.start() < b:
            kind, token, at = m.lastgroup, m.group(), m.end()
            if kind == "op":
                target = name or (typed if token == "=" else None)
                if target and token in ("=", ":", ":=", "=>"):
                    at = self.value(target, at)
                    typed = target if token == ":" else None
                else:
                    typed = None
                name = called = None
            elif kind == "name":
                name, called, typed = token, None, None
            elif kind in ("str", "triple"):
                if called:
                    at = self.value(called, m.start())
                    name = called = None
                else:
                    name, typed = self.inner(m)[2], None
            elif kind == "call":
                name, called, typed = None, name, None
            elif kind == "sub":
                called = typed = None
            elif kind == "close":
                called = None
            elif token == "\n" and called:
                name = typed = None  # the literal may stand on the next line
            else:
                name = called = typed = None
        return at

    def pairs(self) -> list[tuple[int, int, str, str]]:
        """Each literal with the most sensitive name that it reaches; names are gone through once, the most sensitive first."""
        given_by: dict[str, list[str]] = {}
        for name, targets in self.alias.items():
            for t in targets:
                given_by.setdefault(t, []).append(name)
        best: dict[str, str] = {}
        for target in sorted({n for *_, n, _ in self.given} | given_by.keys(), key=lambda n: (-name_score(n), n)):
            todo = [target]
            while todo:
                if (n := todo.pop()) not in best:
                    best[n] = target
                    todo += given_by.get(n, ())
        return [(a, b, best[name], literal) for a, b, name, literal in self.given]


def pairs(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, name, literal) of each literal given to a name, with the most sensitive of the names that it reaches directly or over
    other names before or behind."""
    reader, at = Reader(text), 0
    for a, b in stretches(text):
        at = reader.read(max(a, at), b)
    return reader.pairs()


def tagged(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, name, literal) of each literal that is the content of an element or the value attribute of a tag with a name."""
    found = []

    def add(name: str, a: int, raw: str) -> None:
        literal = raw.strip()
        a += len(raw) - len(raw.lstrip())
        if literal:
            found.append((a, a + len(literal), name, literal))

    for m in ELEMENT.finditer(text):
        add(m[1], m.start(2), m[2])
    for m in TAG.finditer(text):
        end = m.start(1) if m[1] is not None else m.end()
        if name := NAMED.search(text, m.start(), end):
            name = name[1] or name[2] or ""
            if value := VALUED.search(text, m.start(), end):
                add(name, value.start(value.lastindex), value[value.lastindex])
            elif m[1] is not None:
                add(name, m.start(1), m[1])
    return found


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three patterns; failing matches are dropped after they were consumed."""
    out = []
    low = raw.lower()
    if any(s in low for s in STEMS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def scan(text: str, raw: bytes) -> tuple[list, list]:
    """Base spans and all spans, by start and then kind."""
    base = sorted(base_spans(text, raw))
    more = set()
    if b"PRIVATE KEY-----" in raw:
        more |= {(a, 3, b) for a, b in private_keys(text)}
    if any(c in raw for c in (b"=", b":", b"</", b"(")):
        for a, b, name, literal in pairs(text) + (tagged(text) if b"<" in raw else []):
            if name_score(name) + literal_score(literal) >= MIN_SCORE and name_score(name) > 0 and not any(x <= a and b <= y for x, _, y in base):
                more.add((a, 3, b))
    return base, sorted(base + list(more))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = scan(text or "", (text or "").encode())
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return common.map_rows(common.texts(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by a mask and n_chars, if there is such a column, counted anew; overlapping spans become one."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, until = [], 0
        for a, _, b in scan(text, text.encode())[1]:
            if b <= until:
                continue
            if a >= until:
                out += [text[until:a], mask]
            until = b
        return "".join(out) + text[until:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(x) for x in batch.column(i).to_pylist()], pa.string()))

    out = common.map_rows(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents."""
    return find_secrets(common.table(spark, sf_dir, "documents"))
