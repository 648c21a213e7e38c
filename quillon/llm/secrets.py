"""Secret scans by assignment-aware lexing.

A lexer reads source and configuration syntax into pairs of a name and an expression:

- assignments of code, INI, YAML and JSON (``name = "literal"``, ``"name": "literal"``, ``env["NAME"] = x``, ``--name=x``), triple quotes included;
- calls (``set_name("literal")``, ``put("name", "literal")``) and options (``--name literal``);
- XML elements (``<name>literal</name>``) and pairs of attributes (``key="name" value="literal"``).

An expression is a string, a bare word, a name that stands for an earlier expression, or
several of these joined by ``+``, ``.`` or ``&`` or, if they are strings, by standing side
by side.  Constants are so passed on to the name that takes them (``a = "..."`` and then
``password = a + "x"``).  A name that says nothing itself (``value``) counts as the name
of the mapping, section or element around it.  A literal's score is the weight of the
sensitive words in its target name, with a share for how random its characters are.

Three plain patterns (an assignment to a telling name, an access key, a run of hex
digits) are always found; the lexer adds the literals that they don't cover.  Nothing has
a greatest length, and time grows in proportion to the text's.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import store

# The base patterns and the order of kinds.
ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")
_TELLING = ("password", "passwd", "secret", "token", "api_key", "apikey")

# Weights of words in a target's name.
NAMES = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "authorization": 0.7, "private": 0.5, "access": 0.4, "api": 0.4, "client": 0.2, "key": 0.5, "signing": 0.4, "encryption": 0.4, "salt": 0.5, "dsn": 0.5, "pass": 0.8, "pin": 0.4, "cookie": 0.4, "session": 0.4, "license": 0.3, "webhook": 0.4}
# Names that say nothing themselves, attributes that name and attributes that hold a value.
GENERIC = frozenset("value val data default current content text string literal key id name plaintext raw".split())
NAMING, HOLDING = ("key", "name", "id", "property"), ("value", "content", "val")
#: Values that stand for no secret.
BLANKS = re.compile(r"(?i)^(?:changeme|password|secret|token|none|null|true|false|undefined|example|todo|x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|process\.env.*|os\.environ.*)$", re.DOTALL)

_NAME = r"[A-Za-z0-9_.\-]"
#: Where a pair may begin.  Every repeat is possessive and no name begins within another, so the scan is linear.
_HEAD = re.compile(
    rf"""(?P<call>(?<!{_NAME})(?:{_NAME})++)\x20*+\(
    | (?P<option>(?<![A-Za-z0-9_\-])--[A-Za-z][A-Za-z0-9_\-]*+)[\x20\t]++(?![-\n])
    | (?P<name>(?<!{_NAME})(?:{_NAME})++)["'`]?\]?[\x20\t]*+(?::=|=>|===?|=|:(?!//|:))
    | ^(?:\x20|\t)*+\[(?P<section>[^\[\]\n"'=]++)\][\x20\t]*+$
    | <(?P<tag>[A-Za-z_][A-Za-z0-9_.:\-]*+)(?P<attrs>[^<>]*+)>
    | (?P<brace>[{{}}])""",
    re.VERBOSE | re.MULTILINE,
)
_TRIGGER = re.compile(r"[=:(<]|--[A-Za-z]")
_SPACE = re.compile(r"[\x20\t]*+(?:\([\x20\t\r\n]*+)?")
_BARE = re.compile(r"\$?\{?([A-Za-z0-9+/_.\-~!@#$%^&*]++=*+)\}?(?!\()")
_JOIN = re.compile(r"[\x20\t]*+(?:\.\.|[+.&~])[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?|[\x20\t]*+\\?\r?\n[\x20\t]*+(?:\.\.|[+.&~])[\x20\t]*+|[\x20\t]++(?=[\"'`])|(?=[\"'`])")
_NEXT = re.compile(r"[\x20\t\r\n]*+(?=[\"'`])")
_STRINGS = {q: re.compile(rf"{q}((?:[^{q}\\\n]++|\\.)*+){q}") for q in "\"'`"}
_TRIPLE = {q: re.compile(rf"{q * 3}((?:[^{q}\\]++|\\.|{q}(?!{q * 2}))*+){q * 3}", re.DOTALL) for q in "\"'"}
_ARGUMENT = re.compile(r"[\x20\t\r\n]*+,[\x20\t\r\n]*+")
_CLOSE = re.compile(r"(?:<!\[CDATA\[)?(?P<text>[^<]*+)</")
_ATTRIBUTE = re.compile(r"""(?<![A-Za-z0-9_.:\-])(?P<name>[A-Za-z0-9_.:\-]++)[\x20\t\r\n]*+=[\x20\t\r\n]*+(?:"(?P<d>[^"]*+)"|'(?P<s>[^']*+)')""")
_INDENT = re.compile(r"[\x20\t]*+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+|(?<=[A-Za-z])(?=[0-9])")
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
LEAST = 1.1
_LOOKED = 256


def name_weight(name: str) -> float:
    """How sensitive a target's name is: the weights of its words, of each word once."""
    return sum(NAMES.get(w, 0.0) for w in {w.lower() for w in _CAMEL.split(name) if w})


@dataclass
class Value:
    """An expression's literal parts: (start, end), or the values that it is joined from; with the counts of its characters."""

    counts: Counter
    text: str | None  # None: longer than any placeholder
    span: tuple[int, int] | None = None
    parts: list[Value] = field(default_factory=list)
    given: bool = False

    @classmethod
    def literal(cls, text: str, start: int) -> Value:
        return cls(Counter(text), text if len(text) <= _LOOKED else None, (start, start + len(text)))

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        counts: Counter = Counter()
        for p in parts:
            counts.update(p.counts)
        text = "".join(p.text for p in parts) if all(p.text is not None for p in parts) else None
        return cls(counts, text if text is None or len(text) <= _LOOKED else None, None, parts)

    def spans(self):
        """The places of all literal parts that weren't given before."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.given:
                v.given = True
                if v.span:
                    yield v.span
                todo += v.parts


def randomness(counts: Counter) -> float:
    """From 0 to 1: entropy of the characters, against that of as many all different ones (64 at most)."""
    n = sum(counts.values())
    if n < 2:
        return 0.0
    h = -sum(c / n * math.log2(c / n) for c in counts.values())
    return h / math.log2(min(n, 64))


def score(name: str, value: Value) -> float:
    """Score of an expression by its target's name; 0 if it is short or a placeholder."""
    counts = value.counts
    if len(counts) < 4 or sum(counts.values()) < 8 or value.text is not None and BLANKS.match(value.text):
        return 0.0
    w = name_weight(name)
    if w < 0.5:
        return 0.0
    mixed = any(c.isdigit() for c in counts) + any(c.isalpha() for c in counts) + any(not c.isalnum() for c in counts)
    return w + 0.5 * randomness(counts) + 0.1 * (mixed - 1)


class _Lexer:
    """One pass over a text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.known: dict[str, Value] = {}
        self.open: dict[str, int] = {}  # quote -> up to where no string of this kind closes
        self.section = ""
        self.around: list[str] = []  # for each brace that is open, the nearest name
        self.nested: list[tuple[int, str]] = []  # (indent, name) of mappings that are open by lines
        self.line, self.next, self.indent = 0, -1, 0

    def string(self, at: int) -> tuple[Value, int] | None:
        q = self.text[at : at + 1]
        if q not in _STRINGS or at < self.open.get(q, 0):
            return None
        triple = q in _TRIPLE and self.text.startswith(q * 3, at)
        if triple and at >= self.open.get(q * 3, 0):
            if m := _TRIPLE[q].match(self.text, at):
                return Value.literal(m[1], m.start(1)), m.end()
            self.open[q * 3] = len(self.text)
        if m := _STRINGS[q].match(self.text, at):
            return Value.literal(m[1], m.start(1)), m.end()
        end = self.text.find("\n", at)
        self.open[q] = len(self.text) if end < 0 else end
        return None

    def expression(self, at: int) -> tuple[Value | None, int]:
        """The value that stands at a place, if it has literal parts, and where it ends."""
        m = _SPACE.match(self.text, at)
        at = end = m.end()
        within = "(" in m[0]  # strings may stand on lines of their own
        parts: list[Value] = []
        while True:
            if s := self.string(at):
                parts.append(s[0])
                end = s[1]
            else:
                m = _BARE.match(self.text, at)
                if not m:
                    break
                word = m[1]
                if word in self.known:
                    parts.append(self.known[word])
                    end = m.end()
                else:
                    if parts or not any(c.isdigit() for c in word):  # a word of prose, or a name of no literal
                        break
                    parts.append(Value.literal(word, m.start(1)))
                    end = m.end(1)
                    break
            j = _JOIN.match(self.text, end) or within and _NEXT.match(self.text, end)
            if not j or (j.end() == end and self.text[end - 1 : end] not in "\"'`"):
                break
            at = j.end()
        return (Value.joined(parts) if parts else None), end

    def lines(self, at: int) -> None:
        """Go on to the line of a place; mappings that it doesn't stand in are closed."""
        if at > self.next:
            self.line = self.text.rfind("\n", max(0, self.next), at) + 1 or self.line
            end = self.text.find("\n", at)
            self.next = len(self.text) if end < 0 else end
            self.indent = _INDENT.match(self.text, self.line).end() - self.line
            while self.nested and self.nested[-1][0] >= self.indent:
                self.nested.pop()

    def target(self, name: str) -> str:
        """The name, or that of what is around it where it says nothing."""
        if name.lower() not in GENERIC:
            return name
        return self.around and self.around[-1] or self.nested and self.nested[-1][1] or self.section or name

    def pairs(self):
        """(target name, value) of all pairs, in order."""
        text, at, pending = self.text, 0, ""
        while m := _HEAD.search(text, at):
            at = m.end()
            kind = m.lastgroup if m.lastgroup != "attrs" else "tag"
            self.lines(m.start())
            if kind == "brace":
                if m[0] == "{":
                    self.around.append(pending or self.around and self.around[-1] or "")
                elif self.around:
                    self.around.pop()
                pending = ""
                continue
            if kind == "section":
                self.section = m["section"]
                continue
            if kind == "tag":
                yield from self.element(m)
                at = m.start() + 1 + len(m["tag"])  # attributes are assignments, too
                continue
            if kind == "call":
                first = self.string(at)
                if first:
                    sep = _ARGUMENT.match(text, first[1])
                    second = self.expression(sep.end())[0] if sep else None
                    name = text[first[0].span[0] : first[0].span[1]]
                    if second and len(name) <= _LOOKED and _PLAIN.fullmatch(name):
                        yield name, second
                    elif not sep:
                        yield m["call"], self.expression(at)[0]
                continue
            name = (m["name"] or m["option"]).strip("-.")
            value, end = self.expression(at)
            if value is None:
                rest = _SPACE.match(text, at).end()
                pending = name if text[rest : rest + 1] == "{" else ""
                if kind == "name" and text[rest : rest + 1] in ("", "\n", "\r"):
                    self.nested.append((self.indent, name))
                continue
            pending = ""
            target = self.target(name)
            self.known[name] = value
            at = end
            yield target, value

    def element(self, m: re.Match):
        """Pairs of an XML element: its text, and a naming attribute with a holding one."""
        attrs = {}
        if "=" in m["attrs"]:
            for a in _ATTRIBUTE.finditer(m["attrs"]):
                g = "d" if a["d"] is not None else "s"
                attrs[a["name"].lower()] = (a[g], m.start("attrs") + a.start(g))
        name = next((attrs[n][0] for n in NAMING if n in attrs), "")
        held = next((attrs[n] for n in HOLDING if n in attrs), None)
        if name and held:
            yield name, Value.literal(*held)
        if not m["attrs"].endswith("/") and (c := _CLOSE.match(self.text, m.end())) and c["text"].strip():
            inner = c["text"]
            if self.text.startswith(m["tag"], c.end()):
                word = inner.strip()
                start = c.start("text") + len(inner) - len(inner.lstrip())
                yield name if m["tag"].lower() in GENERIC and name else m["tag"], Value.literal(word.removesuffix("]]>"), start)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a whole text, by start, then kind; code points, end exclusive."""
    found: list[tuple[int, int, str]] = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(k in low for k in _TELLING):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]
    if _TRIGGER.search(text):
        covered = _cover([(a, b) for a, b, _ in found])
        more = {s for name, value in _Lexer(text).pairs() if value and score(name, value) >= LEAST for s in value.spans()}
        found += [(a, b, "literal") for a, b in more if a < b and not covered(a, b)]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return found


def _cover(base: list[tuple[int, int]]):
    """Whether one of the spans holds all of ``a`` to ``b``."""
    base = sorted(base)
    start, far = [a for a, _ in base], []
    for _, b in base:
        far.append(max(b, far[-1] if far else 0))

    def covered(a: int, b: int) -> bool:
        i = bisect_right(start, a)
        return i > 0 and b <= far[i - 1]

    return covered


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (an array of kind, start, end) for each row of ``docs``.

    Null and empty texts have none.  Repeated rows give repeated results, and an empty
    table gives none; columns other than ``doc_id`` and ``text`` are ignored.
    """
    store.workers(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
