"""Secret scans: fixed patterns, and literals found by lexing assignments.

The lexer reads source and configuration as name-literal pairs: `name = "x"`, `name: x`, `"name": "x"`, `name: Type = "x"`,
`export NAME=x`, `<name>x</name>`, `set("name", "x")`, `key="name" value="x"`, `scheme://user:x@host`, with prefixed and
triple quotes and quoted values on the next line. It keeps what a name was last given, follows names and sums of names and
literals to the literals behind them, also to ones that a name is given further on, and scores each literal by the words
of the names that it reaches and by its own form.

A name with a call, an index or an attribute behind it is an expression and no literal, nor is a bare word without digits
or one that prose goes on after. Functions and classes, by indent or by braces, are scopes: what is given inside one is
seen in it and in those within it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import map_arrow, slices, texts

#: The kinds in the order of ties, and their patterns.
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, as a run starts at its first character
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How much a word of a target name says that it holds a secret.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "authorization": 0.8, "bearer": 0.9, "private": 0.5, "key": 0.5, "access": 0.3, "api": 0.3, "signing": 0.4, "encryption": 0.4, "session": 0.3, "cookie": 0.4, "dsn": 0.6,
}
#: A text without any of these has no name with a weight: each key of WEIGHTS has one of them within it.
_STEMS = tuple(x for x in WEIGHTS if not any(y in x for y in WEIGHTS if y != x))
#: Fixed values that stand for no secret, as the whole value or a word of it; and forms of a whole value that do.
_PLACEHOLDERS = {"changeme", "change_me", "change-me", "example", "placeholder", "dummy", "your", "todo", "none", "null", "true", "false", "undefined"}
_TEMPLATE = re.compile(r"[xX]{4,}|\*{3,}|<.*>|\$\{.*\}|%\(.*\)s|\{\{.*\}\}")
#: Names whose values may be several words, and words that prose has and a passphrase seldom.
_PHRASES = {"password", "passwd", "passphrase", "pwd", "pass", "secret"}
_PROSE = {"the", "and", "for", "with", "this", "that", "not", "are", "must", "has", "was", "enter", "invalid", "required", "wrong", "please", "new", "old", "forgot", "reset", "confirm", "user", "login", "missing", "cannot", "should", "will", "all", "only", "incorrect", "expired", "failed"}
THRESHOLD = 1.2
_LEAST = 6

_NAME = r"[A-Za-z_$][A-Za-z0-9_.$\-]*+"
# Names are matched from where they begin and never given back, so a line is read once. A type behind a colon ends before
# the sign that gives the value; it holds none, so it is never read twice either.
_EVENT = re.compile(
    rf"""(?P<line>\n(?P<indent>[\x20\t]*+)(?=[^\s])(?P<block>(?:async\x20+)?(?:def|class)\b)?)"""
    rf"""|(?P<opens>\)[\x20\t]*+(?:->[\x20\t]*+[A-Za-z0-9_<>\[\],.&*|?\x20]*+)?\n?[\x20\t]*+\{{|=>[\x20\t]*+\{{|\bclass\x20[A-Za-z0-9_<>,.\x20:()]*+\{{)|(?P<brace>[{{}}])"""
    rf"""|(?<![A-Za-z0-9_.\-])(?:key|name|id|property)[^\S\n]*+=[^\S\n]*+["'](?P<attribute>{_NAME})["']\s++(?:value|val|content|default)[^\S\n]*+=[^\S\n]*+(?=["'])"""
    rf"""|(?<=[(,\x20])["'](?P<argument>{_NAME})["'][^\S\n]*+,\s*+(?=["'])"""
    rf"""|(?<![A-Za-z0-9_.$\-])(?P<name>{_NAME})["']?[^\S\n]*+(?:\??:[^\S\n]*+[A-Za-z_][A-Za-z0-9_.<>\[\],\x20|?&*]*+=(?![=>])|<-|:=|=>(?![\x20\t]*\{{)|==?|:(?!//))[^\S\n]*+"""
)
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)>(?P<value>[^<\n]++)</(?P=name)>")
_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.\-]*+://[^\s/:@"'<>]++:(?P<value>[^\s/@"'<>]++)@""")
_TERM = re.compile(
    r"""[^\S\n]*+(?:(?P<prefix>[fFrRbBuUlL]{0,2})(?:(?P<three>\"\"\"|\'\'\')(?P<long>.*?)(?P=three)|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`))"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_.$]*+)(?![+/=\-]*[A-Za-z0-9])(?P<more>[^\S\n]*+[(\[]|::|->)?|(?P<bare>[A-Za-z0-9+/_.=\-]++))[^\S\n]*+(?P<plus>\+|\.\.|\|\||&)?""", re.DOTALL
)
_NEXT_LINE = re.compile(r"""\(?[^\S\n]*+\\?\n[^\S\n]*+(?=[fFrRbBuU]{0,2}["'`])|[|>][+-]?[^\S\n]*+\n[^\S\n]++(?=[A-Za-z0-9+/_.=\-]++[^\S\n]*+(?:\n|\Z))|\((?=["'])""")
#: What may follow a bare value: the end of its line, a sign, a comment or the next assignment.
_ENDS = re.compile(r"(?=\Z|[\n\r,;)\]}#&|+<\"'`]|//|--|[A-Za-z_][A-Za-z0-9_]*+=)")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(x in low for x in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def name_weight(name: str) -> float:
    parts = [x.lower() for x in _PART.findall(name)]
    return min(1.5, sum(WEIGHTS.get(x, 0.0) for x in parts) + (0.5 if "api" in parts and "key" in parts else 0))


def _is_placeholder(value: str) -> bool:
    """Whether the value, or one of its words between signs, stands for no secret; letters within a longer word don't."""
    low = value.lower()
    return low in _PLACEHOLDERS or bool(_TEMPLATE.fullmatch(value)) or any(x in _PLACEHOLDERS for x in re.split("[^a-z0-9]+", low))


def literal_weight(value: str) -> float:
    """From 0 to 1 by length, mixture of character classes and entropy; 0 for placeholders and prose."""
    if len(value) < _LEAST or any(c.isspace() for c in value) or _is_placeholder(value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.1 * classes + 0.15 * entropy + 0.01 * min(len(value), 20))


def phrase_weight(name: str, value: str) -> float:
    """Of a quoted value with blanks: some words without marks, none of which says what the value is for, given to a
    password."""
    words, parts = value.split(" "), [x.lower() for x in _PART.findall(name)]
    if not 2 <= len(words) <= 8 or len(value) < 12 or not all(len(x) >= 3 and x.isalnum() for x in words) or not parts or parts[-1] not in _PHRASES:
        return 0.0
    low = [x.lower() for x in words]
    return 0.0 if any(x in WEIGHTS or x in _PLACEHOLDERS or x in _PROSE for x in low) else 0.6


@dataclass
class Given:
    """One value that a name is given: literals, values that other names held by then, and names that held nothing yet,
    each with its place if it may be a bare value itself."""

    name: str = ""
    literals: list[tuple[int, int]] = field(default_factory=list)
    values: list[int] = field(default_factory=list)
    names: list[tuple[str, tuple[int, int] | None]] = field(default_factory=list)


class Scopes:
    """What names were last given in the scopes that are open, and which names wait for a value."""

    def __init__(self, given: list[Given]):
        self.given, self.last = given, {}
        #: indent, what to undo, and who waits for each name
        self.opened: list[tuple[int | None, list[tuple[str, int | None]], dict[str, list[int]]]] = [(None, [], {})]

    def gives(self, own: Given, *, names: bool = True) -> None:
        self.given.append(own)
        for name, _ in own.names:
            self.opened[-1][2].setdefault(name, []).append(len(self.given) - 1)
        if names:
            self.opened[-1][1].append((own.name, self.last.get(own.name)))
            self.last[own.name] = len(self.given) - 1

    def open(self, indent: int | None) -> None:
        self.opened.append((indent, [], {}))

    def close(self) -> None:
        """Names that wait take what the scope has given them last; else they wait on around it. What the scopes around it
        had given before, they took at once."""
        _, undo, waiting = self.opened.pop()
        for name in {name for name, _ in undo} & waiting.keys():
            for k in waiting.pop(name):
                own = self.given[k]
                own.values.append(self.last[name])
                own.names = [x for x in own.names if x[0] != name]
        for name, before in reversed(undo):
            if before is None:
                self.last.pop(name, None)
            else:
                self.last[name] = before
        if self.opened:  # the fewer go to the more, so a place moves a few times only
            indent, around_undo, around = self.opened[-1]
            if len(waiting) > len(around):
                waiting, around = around, waiting
                self.opened[-1] = (indent, around_undo, around)
            for name, own in waiting.items():
                more = around.get(name)
                if more is None:
                    around[name] = own
                elif len(own) > len(more):
                    own.extend(more)
                    around[name] = own
                else:
                    more.extend(own)

    def line(self, indent: int) -> None:
        while (own := self.opened[-1][0]) is not None and indent <= own:
            self.close()

    def close_brace(self) -> None:
        while len(self.opened) > 1:
            indented = self.opened[-1][0] is not None
            self.close()
            if not indented:
                return


def assignments(text: str) -> list[Given]:
    """Every value that a name is given, in the order of the text."""
    given: list[Given] = []
    scopes, braces = Scopes(given), []  # for each open brace whether it is a scope
    at = 0
    if block := re.match(r"[\x20\t]*(?:async\x20+)?(?:def|class)\b", text):
        scopes.open(len(block[0]) - len(block[0].lstrip()))
    while found := _EVENT.search(text, at):
        at = found.end()
        if found["line"] is not None:
            scopes.line(len(found["indent"]))
            if found["block"]:
                scopes.open(len(found["indent"]))
        elif found["opens"]:
            braces.append(True)
            scopes.open(None)
        elif found["brace"] == "{":
            braces.append(False)
        elif found["brace"]:
            if braces and braces.pop():
                scopes.close_brace()
        else:
            own, end = _behind(text, at, scopes.last)
            own.name = found["name"] or found["attribute"] or found["argument"]
            scopes.gives(own, names=found["name"] is not None)
            at = max(at, end)
    while scopes.opened:
        scopes.close()
    return given


def _behind(text: str, at: int, last: dict[str, int]) -> tuple[Given, int]:
    """What makes up the value at a place, and where it ends."""
    own, end = Given(), at
    if skipped := _NEXT_LINE.match(text, at):
        at = skipped.end()
    while term := _TERM.match(text, at):
        at = term.end()
        if term["text"] or term["three"]:
            span = term.span("long") if term["three"] else (term.start("text") + 1, term.end("text") - 1)
            if "{" not in text[slice(*span)] or "f" not in term["prefix"].lower():  # else a template
                own.literals.append(span)
        elif term["name"] and term["more"]:
            return own, term.start("more")  # an expression: its arguments are read on their own
        elif term["name"] in last:
            own.values.append(last[term["name"]])
        else:
            kind = "name" if term["name"] else "bare"
            ends = bool(term["plus"]) or bool(_ENDS.match(text, at))
            bare = ends and any(c.isdigit() for c in term[kind]) and not (kind == "name" and "." in term["name"])
            if kind == "name":
                own.names.append((term["name"], term.span("name") if bare else None))
            elif bare:
                own.literals.append(term.span("bare"))
        end = at
        if not term["plus"]:
            break
    return own, end


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name."""
    low = text.lower()
    best: dict[tuple[int, int], tuple[float, str]] = {}
    if "://" in text and "@" in text:
        best |= {m.span("value"): (1.0, "") for m in _URL.finditer(text)}
    given: list[Given] = []
    if any(x in low for x in _STEMS):
        given = assignments(text)
        given += [Given(element["name"], [element.span("value")]) for element in _ELEMENT.finditer(text)]
    seen = [False] * len(given)
    weights = [name_weight(x.name) for x in given]
    for first in sorted(range(len(given)), key=lambda k: -weights[k]):  # so each value is reached by its weightiest name first
        if not weights[first]:
            break
        waiting, reason = [first], (weights[first], given[first].name)
        while waiting:
            k = waiting.pop()
            if seen[k]:
                continue
            seen[k] = True
            for span in given[k].literals:
                best.setdefault(span, reason)
            waiting += given[k].values
            for _, span in given[k].names:  # names that are given nothing: configurations write bare words
                if span:
                    best.setdefault(span, reason)
    return sorted((a, b, "literal") for (a, b), (weight, name) in best.items() if weight + (own := literal_weight(text[a:b]) or phrase_weight(name, text[a:b])) >= THRESHOLD and own)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scan(batches):
    for ids, data, _ in slices(batches):
        out = []
        for doc_id, raw in zip(ids, data, strict=True):
            text = (raw or b"").decode("utf-8", "replace")
            base = base_spans(text)
            counts = Counter(x[2] for x in base)
            spans = sorted({*base, *literal_spans(text)}, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
            out.append((doc_id, counts["assign"], counts["access"], counts["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans are kind:start:end in code points, end exclusive, comma-joined by start and then kind. A null or empty text
    has none. A literal is a span of its own also where a fixed pattern covers it; one that several names reach counts with
    the weightiest of them. Rows that repeat a doc_id, or have none, each get their row. A text of any length is read whole,
    each line once. An empty table gives no rows; other columns are left behind.
    """
    return map_arrow(texts(docs), _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
