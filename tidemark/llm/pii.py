"""Personal data: candidate spans proposed with high recall, and boosted trees that choose among them.

Fixed patterns with their checks give the base spans, which always stay. Generators propose more that overlap each
other: spelt-out addresses, whole digit runs, and their neighbouring groups of up to 19 digits together. Trees score a
candidate by its format and the words around it.

No table says what is personal, so the trees learn from examples that are planted: snippets of the corpus's own texts
into which numbers and addresses of many written forms are put, personal ones and others that look alike (dates, prices,
versions, order numbers, prose with "at"). None of the personal forms is one that the fixed patterns know. What the
generators propose in the snippets' own texts and no fixed pattern confirms counts as not personal. A candidate that has
other bounds than the planted one is a negative, so the best bounds win. Scores are calibrated on snippets kept out of
the fit, which have forms of their own besides, and each kind takes the least threshold that keeps the wanted precision
there.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import Scratch, hash_sample, map_arrow, slices, texts
from tidemark.llm.trees import boost, predict

#: The kinds in the order of the digest, and their patterns. Where a pattern could try each place of a long
#: run, it is anchored to the run's begin and never gives back, which finds the same.
KINDS = ("email", "ip", "card", "phone", "number", "address")
_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL, _EMAIL_HERE = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++@{_DOMAIN}"), re.compile(rf"[{_LOCAL}]++@{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT, _DIGIT = re.compile("[^0-9]+"), re.compile("[0-9]")

_AT, _DOT = r"(?:\s?(?:@|\(at\)|\[at\])\s?|\sat\s)", r"(?:\s?(?:\.|\(dot\)|\[dot\])\s?|\sdot\s)"
_SPELT = re.compile(rf"(?<![{_LOCAL}])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+")
_RUN = re.compile(r"[+(]*+[0-9][0-9\x20().\-/]*+")
_TOKEN = re.compile(r"[^\x20]++")
#: Digits of a candidate. Neighbouring groups of a digit run with so many together are candidates, besides the whole run.
_LEAST_DIGITS, _MOST_DIGITS = 7, 19
_CUES = {
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial", "whatsapp", "telefon"), "mail": ("mail", "email", "contact", "write", "reach"), "card": ("card", "visa", "credit", "amex"),
    "own": ("ssn", "social", "passport", "account", "iban", "patient", "member", "security"), "other": ("order", "invoice", "version", "page", "isbn", "item", "part", "ref", "ticket", "no", "sku", "build", "population"),
}

#: Snippets, about, that examples are planted in; candidates, about, that the trees learn from, both chosen by a hash;
#: the precision wanted on those kept out.
SNIPPETS, SAMPLE, PRECISION = 4_000, 30_000, 0.98

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def _emails(text: str) -> Iterator[Span]:
    """Leftmost and non-overlapping: a local part begins where its run does, or where the match before it ends."""
    at = 0
    found = _EMAIL.search(text)
    while found:
        yield found.start(), found.end(), "email"
        at = found.end()
        found = _EMAIL_HERE.match(text, at) or _EMAIL.search(text, at)


def _is_part(x: str) -> bool:
    own = x.lstrip("0")
    return len(own) <= 3 and int(own or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """(start, end, kind), by kind and then start."""
    found: list[Span] = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_is_part, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37 and 16 <= len(own := _digits(m[0])) <= 19 and luhn(own):  # 19 digits have 18 gaps
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


class Taken:
    """Parts of a text that are taken, as disjoint spans in order: whether a span meets one is asked by bisection."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b

    def add(self, a: int, b: int) -> None:
        """A span that meets none."""
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def candidates(text: str) -> list[Span]:
    """Spans that may overlap each other and the base spans."""
    found: list[Span] = []
    low = text.lower()
    if "@" in low or "(at)" in low or "[at]" in low or " at " in low:
        found += [(m.start(), m.end(), "address") for m in _SPELT.finditer(text)]
    for m in _RUN.finditer(text):
        if m.end() - m.start() < _LEAST_DIGITS:
            continue
        spans = {_trimmed(text, m.start(), m.end())}
        tokens = [(*t.span(), n) for t in _TOKEN.finditer(text, m.start(), m.end()) if (n := len(_digits(t[0])))]
        for k in range(len(tokens)) if len(tokens) > 1 else ():
            held = 0
            for _, end, n in itertools.islice(tokens, k, k + _MOST_DIGITS):  # a token has a digit at least
                held += n
                if held > _MOST_DIGITS:
                    break
                if held >= _LEAST_DIGITS:
                    spans.add(_trimmed(text, tokens[k][0], end))
        found += [(a, b, "number") for a, b in sorted(spans) if b - a >= _LEAST_DIGITS and len(_digits(text[a:b])) >= _LEAST_DIGITS]
    return found


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """From a digit, or a plus sign or parenthesis before it, to a digit."""
    own = text[start:end]
    kept = own.rstrip("+( ).-/")
    return start + len(kept) - len(kept.lstrip(" ).-/")), start + len(kept)


_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2})")


def features(text: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    groups = [len(x) for x in re.findall("[0-9]+", span[:200])]
    digits = _digits(span)
    words = re.findall("[a-z]+", before.lower())
    near = set(words[-4:])
    left, right = before[-1:], after[:1]
    labels = re.split(_DOT, span[-80:])
    return [
        float(x)
        for x in (
            len(span), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0, span.count("."), span.count("-"), span.count(" "), span.count("/"),
            span.startswith("("), span.startswith("+"), span.count("(") - span.count(")"), len(set(span) & set(" .-/")), "@" in span, "(at)" in span or "[at]" in span, "dot" in span, sum(c.isalpha() for c in span[:200]),
            13 <= len(digits) <= 19 and luhn(digits), len(set(digits)), digits[:1] == "0", bool(_DATE.fullmatch(span)), len(labels[-1]), labels[-1][:1].isupper(), bool(re.search(r"\.\s", span)), len(labels),
            left.isalnum(), right.isalnum(), left in "#$€£=" and left != "", left in ".-/+" and left != "", right in ".-/%" and after[1:2].isdigit(), *(bool(near & set(x)) for x in _CUES.values()), any(c.isdigit() for c in before[-3:]), any(c.isdigit() for c in after[:3]),
        )
    ]


# --- planted examples ---------------------------------------------------------------------------------------------


def _n(rng: Random, n: int, first: str = "123456789") -> str:
    return rng.choice(first) + "".join(rng.choices("0123456789", k=n - 1))


def _with_check(rng: Random, n: int, right: bool) -> str:
    while True:
        own = _n(rng, n, "3456")
        if luhn(own) == right:
            return own


def _cut(digits: str, sizes: tuple[int, ...], by: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return by.join(out)


_NAMES = ("anna", "j.smith", "office", "mkhan", "lee.wong", "sales", "b_ortiz", "h.mueller42", "info", "zoe")
_HOSTS = ("example", "mail", "acme-labs", "north7", "uni", "post", "firma", "example2")
_ENDS = ("com", "org", "net", "de", "fr", "io", "co", "es")


def _address(rng: Random, at: str, dot: str) -> str:
    host = rng.choice(_HOSTS) + (dot + rng.choice(_HOSTS) if rng.random() < 0.25 else "")
    return f"{rng.choice(_NAMES)}{at}{host}{dot}{rng.choice(_ENDS)}"


def _cue(rng: Random, kind: str, share: float = 0.8) -> str:
    return f"{rng.choice(_CUES[kind])}{rng.choice((' ', ': ', ' is ', ' at ', '. '))}" if rng.random() < share else ""


#: name: (label, kept out of the fit, words before and the planted text).
FORMS: dict[str, tuple[int, bool, Callable[[Random], tuple[str, str]]]] = {
    "national phone in parentheses": (1, False, lambda r: (_cue(r, "phone", 0.5), f"({_n(r, 3)}) {_n(r, 3)}-{_n(r, 4)}")),
    "national phone with hyphens": (1, False, lambda r: (_cue(r, "phone"), _cut(_n(r, 10), (3, 3, 4), "-"))),
    "national phone with points": (1, True, lambda r: (_cue(r, "phone", 1.0), _cut(_n(r, 10), (3, 3, 4), "."))),
    "area code with slash": (1, False, lambda r: (_cue(r, "phone", 1.0), f"0{_n(r, 3)}{r.choice('/ -')}{_n(r, r.choice((6, 7, 8)))}")),
    "phone in pairs": (1, True, lambda r: (_cue(r, "phone", 1.0), _cut("0" + _n(r, 9), (2,) * 5, " "))),
    "phone without signs": (1, False, lambda r: (_cue(r, "phone", 1.0), _n(r, 10))),
    "personal number": (1, False, lambda r: (_cue(r, "own", 1.0), _cut(_n(r, 9), (3, 2, 4), "-"))),
    "account number": (1, True, lambda r: (_cue(r, "own", 1.0), _n(r, r.choice((8, 9, 10))))),
    "card with points": (1, False, lambda r: (_cue(r, "card", 0.5), _cut(_with_check(r, 16, True), (4,) * 4, r.choice("./")))),
    "card of 15 digits": (1, False, lambda r: (_cue(r, "card"), _cut(_with_check(r, 15, True), (4, 6, 5), r.choice((" ", "-", "")))),),
    "address with (at)": (1, False, lambda r: (_cue(r, "mail", 0.5), _address(r, r.choice(("(at)", " (at) ", "[at]", " [at] ")), "."))),
    "address with (at) and (dot)": (1, True, lambda r: (_cue(r, "mail", 0.5), _address(r, r.choice((" (at) ", "[at]")), r.choice((" (dot) ", "[dot]", "(dot)"))))),
    "address in words": (1, False, lambda r: (_cue(r, "mail"), _address(r, " at ", " dot "))),
    "address with blanks": (1, False, lambda r: (_cue(r, "mail", 0.6), _address(r, " @ ", r.choice((".", " . "))))),
    "date": (0, False, lambda r: ("", r.choice((f"{r.randint(1900, 2039)}{(s := r.choice('-./'))}{r.randint(1, 12):02d}{s}{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}{(s := r.choice('-./'))}{r.randint(1, 12):02d}{s}{r.randint(1900, 2039)}")))),
    "price": (0, False, lambda r: (r.choice(("$", "€", "")), f"{_n(r, r.choice((6, 7)))}.{_n(r, 2)}")),
    "grouped amount": (0, True, lambda r: (_cue(r, "other", 0.5), _cut(_n(r, 9), (3, 3, 3), r.choice((" ", "."))))),
    "years": (0, False, lambda r: ("", f"{r.randint(1800, 2039)}-{r.randint(1800, 2039)}")),
    "version": (0, False, lambda r: (_cue(r, "other"), ".".join(str(r.randint(0, 30_000)) for _ in range(r.choice((3, 4, 5)))) + ".256")),
    "order number": (0, False, lambda r: (_cue(r, "other", 1.0), _n(r, r.choice((8, 9, 10, 12, 14))))),
    "book number": (0, True, lambda r: (_cue(r, "other"), f"978-{_n(r, 1)}-{_n(r, 2)}-{_n(r, 6)}-{_n(r, 1)}")),
    "digits with a wrong check": (0, False, lambda r: (_cue(r, "card", 0.3), _cut(own := _with_check(r, 16, False), (4,) * 4, r.choice(("", " ", "-", "."))))),
    "digits in a name": (0, False, lambda r: (r.choice("abcdef"), _n(r, r.choice((8, 10, 12))) + "")),
    "measures": (0, False, lambda r: ("", f"{r.randint(1, 90)}.{_n(r, 6)}")),
    "list of numbers": (0, True, lambda r: ("", " ".join(str(r.randint(1, 99)) for _ in range(6)))),
    "prose with at": (0, False, lambda r: ("", f"{r.choice(('stay', 'was', 'look', 'met', 'arrived'))} at {r.choice(('home', 'noon', 'work', 'night'))}. {r.choice(('Then', 'She', 'It', 'the', 'So'))}")),
    "prose with a sign": (0, True, lambda r: ("", f"{r.choice(('two', 'apples', 'sold'))} @ {r.choice(('once', 'home', 'cost'))}. {r.choice(('Then', 'They', 'All'))}")),
}


def planted(rng: Random, snippet: str, form: str) -> tuple[str, int, int]:
    """The snippet with an example of the form between two of its words, and where the example stands."""
    before, own = FORMS[form][2](rng)
    blanks = [k for k, c in enumerate(snippet) if c == " "] or [len(snippet)]
    at = rng.choice(blanks)
    head = f"{snippet[:at]} {before}"
    return f"{head}{own}{rng.choice((' ', ', ', '. ', ''))}{snippet[at:] or ' '}", len(head), len(head) + len(own)


_EXAMPLES = "key long, kind string, form string, kept_out int, label int, x array<double>"


def _sampled(batches):
    for ids, data, _ in slices(batches):
        out = []
        for doc_id, raw in zip(ids, data, strict=True):
            text = (raw or b"").decode("utf-8", "replace")
            name = hashlib.blake2b(f"{doc_id}:{text}".encode(), digest_size=7).digest()
            rng, kept_out = Random(name), int(zlib.crc32(name) % 4 == 0)
            base = Taken(base_spans(text))
            for n, (a, b, kind) in enumerate(candidates(text)):
                if not base.meets(a, b):
                    out.append((int.from_bytes(hashlib.blake2b(b"%b:%d" % (name, n), digest_size=7).digest(), "little"), kind, "own text", kept_out, 0, features(text, a, b)))
            begin = rng.randrange(max(1, len(text) - 300))
            for n, form in enumerate(rng.sample([x for x, (_, only_out, _) in FORMS.items() if kept_out or not only_out], 8)):
                snippet, start, end = planted(rng, text[begin : begin + 300], form)
                for a, b, kind in candidates(snippet):
                    if a < end and start < b:
                        key = int.from_bytes(hashlib.blake2b(b"%b:%d:%d:%d" % (name, -1 - n, a, b), digest_size=7).digest(), "little")
                        out.append((key, kind, form, kept_out, int(FORMS[form][0] and (a, b) == (start, end)), features(snippet, a, b)))
        if out:
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "kind", "form", "kept_out", "label", "x"])


class Chooser:
    """Of one kind of candidates: trees, the Platt scaling of their scores, and the threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kept_out: np.ndarray, precision: float):
        self.model, self.threshold = None, 1.1
        learn, test = ~kept_out, kept_out
        if len(y) < 50 or len(set(y[learn])) < 2 or len(set(y[test])) < 2:
            return  # nothing to learn from: the base spans alone are chosen
        self.model = boost(x[learn], y[learn], trees=60, depth=4)
        score = self._logit(x[test])
        self.a, self.b = _platt(score, y[test])
        p = self.probability(x[test])
        order = np.argsort(-p, kind="stable")
        good = np.cumsum(y[test][order]) / np.arange(1, len(order) + 1) >= precision
        last = np.append(p[order][1:] < p[order][:-1], True)  # equal scores are chosen together
        if (good & last).any():
            self.threshold = max(0.5, float(p[order][np.flatnonzero(good & last)[-1]]))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        p = np.clip(predict(self.model, x), 1e-9, 1 - 1e-9)
        return np.log(p / (1 - p))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self._logit(x) + self.b, -500, 500)))


def choosers(rows: list, precision: float) -> dict[str, Chooser]:
    """One for each kind of candidates. rows: (kind, kept_out, label, x)."""
    out = {}
    for kind in KINDS[4:]:
        own = [r for r in rows if r[0] == kind]
        out[kind] = Chooser(np.array([r[3] for r in own], float), np.array([r[2] for r in own], float), np.array([r[1] for r in own], bool), precision)
    return out


def chosen(models: dict[str, Chooser], data: list[tuple[str, list[Span]]]) -> list[list[Span]]:
    """Of each text's candidates (text, base spans) those above their kind's threshold; of overlapping ones the best."""
    taken = [Taken(base) for _, base in data]
    asked = [(k, x) for k, (text, _) in enumerate(data) for x in candidates(text) if models[x[2]].model and not taken[k].meets(x[0], x[1])]
    out: list[list[Span]] = [[] for _ in data]
    found = []
    for kind, model in models.items():
        every = [(k, x) for k, x in asked if x[2] == kind]
        for first in range(0, len(every), 10_000):
            own = every[first : first + 10_000]
            p = model.probability(np.array([features(data[k][0], a, b) for k, (a, b, _) in own]))
            found += [(-score, k, x) for (k, x), score in zip(own, p.tolist(), strict=True) if score >= model.threshold]
    for _, k, (a, b, kind) in sorted(found):
        if not taken[k].meets(a, b):
            taken[k].add(a, b)
            out[k].append((a, b, kind))
    return out


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the least logistic loss, by Newton's steps that are halved until the loss falls."""

    def loss(a: float, b: float) -> float:
        s = a * score + b
        return float((np.logaddexp(0, s) - y * s).sum() + 5e-4 * ((a - 1) ** 2 + b * b))

    a, b, now = 1.0, 0.0, loss(1.0, 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        gradient = np.array([((p - y) * score).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        hessian = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        while (then := loss(a - step[0], b - step[1])) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if then > now or np.abs(step).max() <= 1e-9:
            break
        a, b, now = a - step[0], b - step[1], then
    return float(a), float(b)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _found(models):
    def run(batches):
        for ids, data, _ in slices(batches):
            held = [(text, base_spans(text)) for text in ((raw or b"").decode("utf-8", "replace") for raw in data)]
            out = []
            for doc_id, (_, base), more in zip(ids, held, chosen(models.value, held), strict=True):
                counts = Counter(x[2] for x in base)
                spans = sorted({*base, *more}, key=lambda x: (KINDS.index(x[2]), x[0], x[1]))
                out.append((doc_id, *(counts[k] for k in KINDS[:4]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            types = (*[pa.int64()] * 5, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def learnt(docs: DataFrame, *, snippets: int = SNIPPETS, sample: int = SAMPLE, precision: float = PRECISION) -> dict[str, Chooser]:
    """The choosers, from examples planted in about `snippets` texts; `sample` bounds the candidates that are learnt from."""
    some = hash_sample(texts(docs), snippets, "doc_id", "text")
    examples = Scratch(docs.sparkSession, "pii").table(map_arrow(some, _sampled, _EXAMPLES), "examples")
    rows = sorted(hash_sample(examples, sample, "key").collect(), key=lambda r: (r["key"], r["label"], r["x"]))
    return choosers([(r["kind"], r["kept_out"], r["label"], list(r["x"])) for r in rows], precision)


def find_pii(docs: DataFrame, *, snippets: int = SNIPPETS, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    spans are kind:start:end in code points, end exclusive, comma-joined by kind and then start. A null or empty text has
    none. Rows that repeat a doc_id, or have none, each get their row. A text of any length is read whole, in time that
    grows with its length: a run of digits of any length is one candidate, and so are its neighbouring groups of up to
    19 digits together, of which each group begins 19 at most. Of overlapping candidates that are chosen the
    best-scored stays, of equal ones the one that begins first; one that overlaps a base span is left to it. With too
    few texts to learn from, the base spans are all. An empty table gives no rows; other columns are left behind.
    """
    models = docs.sparkSession.sparkContext.broadcast(learnt(docs, snippets=snippets, sample=sample, precision=precision))
    return map_arrow(texts(docs), _found(models), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with every span replaced by its kind; of overlapping spans the union."""
    marks = sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in spans.split(",") if x))
    out, last = [], 0
    for start, end, kind in marks:
        if end <= last:
            continue
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
        last = end
    return "".join([*out, text[last:]])
