"""Personal data: high-recall generators propose spans, boosted trees decide on them.

Four base kinds have exact rules and are always reported. Wider generators propose further spans that may overlap:
numbers in groups, spelled-out addresses, account numbers, secrets behind a keyword, and the parts of longer runs of
digits that would be a card or phone number by themselves (the base rules drop such runs whole). Each is described by
its form (digits, separators, groups, checksum, character classes) and its context (keywords in the ``CONTEXT``
characters before it, neighbouring characters). The trees learn from two sources: the base rules' own verdicts on a
bounded sample of documents, and a seeded set of formats and decoys placed in contexts of that sample. Platt scaling
and the threshold of each kind come from documents kept from fitting; ``Finder.report`` has precision and recall on
them. Overlaps are settled by probability; base spans stay.

Defined cases: null and empty texts have no spans; repeated rows are each searched; ``pii_*`` columns that
the documents already have are replaced; without any document the trees learn from decoys alone.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.llm.boosting import BoostedTrees
from driftwarden.llm.common import prepare, rank_hash, slices, strings

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "secret")
CONTEXT = 24
SAMPLE_ROWS = 4000
FEW = 50

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){2}\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
_GOES_ON = re.compile(r"[ .-][0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Proposals beyond the base kinds. Each begins where its first character cannot be preceded by its own kind.
_WIDER = (
    ("phone", re.compile(r"(?<![0-9.+(-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,24}){1,4}")
_SECRET = re.compile(r"(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\"? ?[=:] ?\"?([A-Za-z0-9_+/=-]{8,}+)", re.I)
_SECRET_WORDS = ("password", "passwd", "secret", "token", "key")

#: Keywords of a context, one feature each.
_HINTS = ("tel", "phone", "call", "fax", "mail", "contact", "ip", "host", "server", "card", "visa", "pay", "ssn", "social", "iban", "account", "password", "token", "secret", "key", "version", "date", "order", "page", "isbn", "no.")


_DOUBLED = bytes.maketrans(b"0123456789", b"0246813579")


def luhn(digits: str) -> bool:
    own = digits.encode()
    return (sum(own[::-2]) + sum(own[-2::-2].translate(_DOUBLED)) - 48 * len(own)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from their @ so that long words cost no more than once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, by start and then by kind as listed."""
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], BASE_KINDS.index(x[2]), x[1]))


def proposals(text: str) -> list[tuple[int, int, str]]:
    """Spans of the wider generators; they may overlap."""
    out = []
    if _DIGIT.search(text):
        for kind, pattern in _WIDER:
            out += [(*m.span(), kind) for m in pattern.finditer(text)]
        out += within_longer(text)
    if "at)" in text or "at]" in text:
        out += [(*m.span(), "email") for m in _SPELLED.finditer(text)]
    low = text.casefold()  # only to look for the words: its length may differ
    if any(w in low for w in _SECRET_WORDS):
        out += [(*m.span(1), "secret") for m in _SECRET.finditer(text)]
    return out


def within_longer(text: str) -> list[tuple[int, int, str]]:
    """Groups of digits inside a run that the base rules drop, which alone would be a card or phone number."""
    out = []
    for kind, pattern, low, high in (("card", _CARD, 14, 19), ("phone", _PHONE, 10, 15)):
        if kind == "phone" and "+" not in text:
            continue
        for m in pattern.finditer(text):
            run = m[0]
            groups = [g.span() for g in _GROUP.finditer(run)]
            size = sum(b - a for a, b in groups)
            if size <= low or (size <= high and (kind == "phone" or luhn("".join(run[a:b] for a, b in groups)))):
                continue
            for i in range(len(groups) if kind == "card" else 1):
                digits = ""
                for a, b in groups[i : i + high]:
                    if len(digits) + b - a > high:
                        break
                    digits += run[a:b]
                    if len(digits) >= low and (kind == "phone" or luhn(digits)) and len(digits) < size:
                        out.append((m.start() + (groups[i][0] if kind == "card" else 0), m.start() + b, kind))
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", span)][:4]
    counts = [len(set(span)) / len(span), *(sum(map(f, span)) for f in (str.isdigit, str.isupper, str.islower))]
    marks = [span.count(c) for c in " -.()+"]
    edge = [float(start > 0 and text[start - 1].isalnum()), float(end < len(text) and text[end].isalnum()), float(end < len(text) and text[end] in "-/:%")]
    # Whether the digits go on before and behind.
    edge += [float(bool(_GOES_ON.match(text, end))), float(start > 1 and text[start - 1] in " .-" and text[start - 2].isdigit())]
    hints = [float(h in before) for h in _HINTS]
    runs = [max(groups, default=0), *(groups + [0] * 4)[:4]]
    return [float(x) for x in (KINDS.index(kind), len(span), *counts, *marks, *runs, luhn(digits) if digits else 0, int(digits[:1] or 0), *edge, *hints)]


def _draw(r: random.Random, form: str) -> str:
    """``form`` with # as a digit, @ as an upper-case letter, ~ as a letter or digit, $ as the checksum's digit."""
    pick = {"#": "0123456789", "@": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "~": "abcdefghijklmnopqrstuvwxyz0123456789"}
    out = ""
    for c in form:
        digits = "".join(x for x in out if x.isdigit()) if c == "$" else ""
        out += next(d for d in "0123456789" if luhn(digits + d)) if c == "$" else r.choice(pick[c]) if c in pick else c
    return out


#: Formats of personal data and decoys of the same form: keywords before them, the form (up to | the span), kind, label.
_FORMATS = (
    (("tel ", "phone: ", "call ", "fax ", ""), "(2##) 5##-####", "phone", 1),
    (("tel ", "phone: ", "contact ", ""), "2##-5##-####", "phone", 1),
    (("call ", "tel. "), "0## #### ####", "phone", 1),
    (("version ", "order ", "page ", "isbn "), "###-###-####", "phone", 0),
    (("order ", "version ", "date "), "## ### ####", "phone", 0),
    (("isbn ", "no. "), "###.###.###", "phone", 0),
    (("call ", "phone: ", "tel "), "+1 2## 5## ####| 20## ##", "phone", 1),
    (("order ", "version ", "no. "), "+1 2## 5## ####| #### ####", "phone", 0),
    (("card ", "visa ", "pay with card ", ""), "4### #### ####| #### 12 ##", "phone", 0),
    (("order ", "no. ", "card ", "iban ", ""), "#### #### ####| #### ####", "phone", 0),
    (("card ", "visa ", "pay with card "), "4### #### #### ###$| 12 ##", "card", 1),
    (("card: ", "visa "), "5###-####-####-###$|-###", "card", 1),
    (("order ", "no. ", "isbn ", "page "), "#### #### #### ###$| #### ####", "card", 0),
    (("call +1 ", "tel +1 ", "phone: +44 ", "+1 "), "2## 5## #### 20## #$", "card", 0),
    (("call +1 ", "tel +1 ", "phone: +44 "), "2## 5## #### 20#$| ##", "card", 0),
    (("order ", "date ", "version "), "## ## ## ## ## ## ## #$| ## ## ##", "card", 0),
    (("ssn ", "social security ", "ssn: "), "2##-##-####", "ssn", 1),
    (("order ", "part ", "date "), "###-##-####", "ssn", 0),
    (("iban ", "account ", "iban: "), "DE## #### #### #### #### ##", "iban", 1),
    (("iban ", "account "), "GB##@@@@##############", "iban", 1),
    (("order ", "version ", "page "), "@@##@@@@@@@@@@@@", "iban", 0),
    (("mail ", "contact: ", ""), "~~~~~~ (at) ~~~~~~ (dot) com", "email", 1),
    (("write to ", ""), "~~~~.~~~~[at]~~~~~.org", "email", 1),
    (("password=", "token = \"", "secret: ", "api_key="), "~~~~~~~~~~~~~~~~~~", "secret", 1),
    (("password=", "token: "), "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "secret", 1),
    (("password: ", "token: ", "secret: "), "something", "secret", 0),
    (("token: ", "secret = "), "undefined", "secret", 0),
)


def training_rows(texts: list[str], seed: int, each: int = 120) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, kinds and documents: base verdicts in ``texts``, and formats and decoys within parts of them."""
    r = random.Random(seed)
    rows, labels, kinds, documents = [], [], [], []

    def add(text: str, start: int, end: int, kind: str, label: int, document: int) -> None:
        rows.append(features(text, start, end, kind))
        labels.append(label)
        kinds.append(KINDS.index(kind))
        documents.append(document)

    for n, text in enumerate(texts):
        base = base_spans(text)
        for s, e, kind in base:
            add(text, s, e, kind, 1, n)
        taken = {(s, e) for s, e, _ in base}
        for pattern, kind in ((_CARD, "card"), (_IP, "ip"), (_PHONE, "phone")):
            for m in pattern.finditer(text):
                if m.span() not in taken:
                    add(text, *m.span(), kind, 0, n)
    around = [n for n, t in enumerate(texts) if len(t) > 80]  # of very few, each use counts as a document of its own
    for hints, form, kind, label in _FORMATS:
        for _ in range(each):
            n = r.choice(around) if around else 0
            t = texts[n] if around else "no text around it at all, only this line of plain words, again and again here"
            at = r.randrange(0, len(t) - 40)
            head = t[at : at + 30].rsplit(" ", 1)[0] + " " + r.choice(hints)
            own, _, after = form.partition("|")
            drawn = _draw(r, own + after)
            add(f"{head}{drawn} {t[at + 30 : at + 60]}", len(head), len(head) + len(own), kind, label, n if len(around) >= FEW else len(texts) + len(rows))
    return np.array(rows), np.array(labels, np.float64), np.array(kinds), np.array(documents)


class Finder:
    """Fitted trees with a threshold a kind. ``report`` has each kind's (precision, recall, rows) on documents kept out."""

    def __init__(self, texts: list[str], precision: float = 0.97, seed: int = 13):
        x, y, kinds, documents = training_rows(texts, seed)
        held = (np.random.Generator(np.random.Philox(seed)).random(int(documents.max()) + 1) < 0.3)[documents]
        self.trees = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
        p = self.trees.predict(x[held])
        self.thresholds, self.report = {}, {}
        for k, kind in enumerate(KINDS):
            own = kinds[held] == k
            self.thresholds[kind] = self._threshold(p[own], y[held][own], precision)
            taken, right = p[own] >= self.thresholds[kind], y[held][own] > 0
            self.report[kind] = (float(right[taken].mean()) if taken.any() else 1.0, float(taken[right].mean()) if right.any() else 1.0, int(own.sum()))

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
        """The lowest probability from which on at least ``precision`` is right; never below a half."""
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        return max(0.5, float(p[order][good[-1]])) if len(good) else 1.1

    def find(self, text: str) -> list[tuple[int, int, str, float, bool]]:
        """(start, end, kind, probability, base): base spans, and accepted proposals that overlap nothing likelier."""
        base = base_spans(text)
        out = [(*x, 1.0, True) for x in base]
        if wider := proposals(text):
            taken: list[tuple[int, int]] = []  # apart from each other, in order
            for s, e, _ in base:
                if taken and s < taken[-1][1]:
                    taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
                else:
                    taken.append((s, e))
            p = self.trees.predict(np.array([features(text, *x) for x in wider]))
            for i in np.argsort(-p, kind="stable").tolist():
                s, e, kind = wider[i]
                at = bisect_left(taken, (s, e))
                free = (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e)
                if p[i] >= self.thresholds[kind] and free:
                    insort(taken, (s, e))
                    out.append((s, e, kind, float(p[i]), False))
        return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType()), T.StructField("base", T.BooleanType())]))
RESULT = T.StructType([T.StructField("pii_spans", _SPAN), T.StructField("pii_clean", T.StringType())])


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, precision: float = 0.97) -> Finder:
    """Fits the trees on the spans of about ``sample_rows`` documents with a digit, chosen by a hash of the id."""
    prepare(docs.sparkSession)
    some = docs.where(F.col(text).rlike("[0-9]"))
    size = some.count()
    chosen = some.where(rank_hash(17, id) <= ((1 << 63) - 1) * min(sample_rows, size) // max(size, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # only what lies around the numbers: enough for spans and contexts
            parts = [t[max(0, m.start() - 60) : m.end() + 60] for t in b["text"].to_pylist() for m in re.finditer(r"[+(]?[0-9][0-9 ().+-]{6,40}", t or "")]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], ["part"])

    parts = chosen.select(F.col(text).alias("text")).mapInArrow(run, "part string").orderBy(F.xxhash64("part"), "part").limit(sample_rows)
    return Finder([x.part for x in parts.collect()], precision)


def find(docs: DataFrame, finder: Finder, text: str = "text", keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """``docs`` (its columns ``keep``) with ``pii_spans`` (code points, end exclusive) and, if asked, ``pii_clean``.

    ``pii_clean`` is the text with every span replaced by its kind in brackets; null stays null.
    """
    prepare(docs.sparkSession)
    names = RESULT.names[: 1 + redact]
    keep = [c for c in (keep or docs.columns) if c not in names]
    rows = docs.select(*dict.fromkeys([*keep, text]))
    held = docs.sparkSession.sparkContext.broadcast(finder)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = strings(b[text])
            for s, e in slices(col):
                texts = col[s:e].to_pylist()
                found = [held.value.find(t) for t in texts]
                spans = [[{"kind": k, "start": a, "end": z, "probability": p, "base": own} for a, z, k, p, own in x] for x in found]
                arrays = [*(b[c].slice(s, e - s) for c in keep), pa.array(spans, kind)]
                if redact:
                    clean = [redacted(t, x) if t0 is not None else None for t, x, t0 in zip(texts, found, b[text].slice(s, e - s).to_pylist(), strict=True)]
                    arrays.append(pa.array(clean, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *(RESULT[n] for n in names)]))


def redacted(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for start, end, kind, *_ in spans:
        if end > at:
            out += [text[at : max(start, at)], f"[{kind.upper()}]" if start >= at else ""]
            at = end
    return "".join([*out, text[at:]])
