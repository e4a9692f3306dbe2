"""Licence notices: exact phrases, and short notices found with bounded edits.

A notice of m characters may differ by ``k = m // EDIT_EVERY`` edits. Cut into k + 1 pieces, at least one stays
whole (pigeonhole), so an Aho-Corasick automaton over all pieces finds every place worth a look; the
``regex`` library's bounded-error matching then verifies the window and counts the edits. A window is the seed's
notice and ``k`` characters to both sides; two occurrences do not fit into one, so the best match of every window gives
all of them, and of overlapping matches of a notice the one with the fewest edits stays. Text and notices are compared
as lower-case words with single spaces, so layout and punctuation do not matter.

Defined cases: null and empty texts have no words and no labels; repeated rows are each scanned; ``ls_*``
columns that the documents already have are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftwarden.llm.common import ALNUM_WORDS, prepare, slices, strings

EDIT_EVERY = 12

# Phrases whose exact occurrence gives a label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short notices in common use, as lower-case words.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under a creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "mozilla public license version 2 0": "mpl",
    "dedicated to the public domain": "public-domain",
    "spdx license identifier": "spdx",
}

_TABLE = bytes(c + 32 if 65 <= c < 91 else c if ALNUM_WORDS[c + 32 if 65 <= c < 91 else c] else 32 for c in range(256))
_BASE = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))
_FUZZY = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("likeness", T.DoubleType())]))
RESULT = T.StructType([T.StructField("ls_words", T.LongType()), T.StructField("ls_base", _BASE), T.StructField("ls_notices", _FUZZY)])


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length with their places."""
    cuts = [round(k * len(notice) / (edits + 1)) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES):
        import ahocorasick
        import regex

        self.phrases = list(phrases.items())
        self.notices = []
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (phrase, _) in enumerate(self.phrases):
            found.setdefault(f" {phrase} ", []).append((-1 - k, 0))
        for k, (notice, label) in enumerate(notices.items()):
            edits = len(notice) // EDIT_EVERY
            self.notices.append((notice, label, edits, regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")))
            for at, piece in pieces(notice, edits):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[dict], list[dict]]:
        """Number of words, exact phrases (label, word) and notices (label, first, last, edits, likeness)."""
        words = text.translate(_TABLE).split()
        line = (b" " + b" ".join(words) + b" ").decode()  # an edit is a character, whatever its bytes
        base: list[tuple[int, str]] = []
        windows: dict[int, set[int]] = {}
        for end, (length, owners) in self.automaton.iter(line):
            start = end - length + 1
            for k, at in owners:
                if k < 0:
                    base.append((start, self.phrases[-1 - k][1]))
                else:
                    windows.setdefault(k, set()).add(start - at)
        if not base and not windows:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32).tolist()
        base = [(bisect_left(spaces, start), label) for start, label in base]
        spans = []
        for k, starts in windows.items():
            notice, label, edits, _ = self.notices[k]
            for low, high, wrong in self._matches(line, k, sorted(starts)):
                first = max(bisect_right(spaces, low) - 1, 0)
                last = max(bisect_left(spaces, max(high - 1, low + 1)) - 1, first)
                spans.append((first, last, label, wrong, 1 - wrong / len(notice)))
        base.sort()
        spans.sort()
        return len(words), [{"label": x, "word": w} for w, x in base], [{"label": x, "first": f, "last": z, "edits": e, "likeness": s} for f, z, x, e, s in spans]

    def _matches(self, line: str, k: int, starts: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of a notice near the places where its seeds say that it begins, best first."""
        notice, _, edits, pattern = self.notices[k]
        found: set[tuple[int, int, int]] = set()
        exact = -1
        for start in starts:
            if line.startswith(notice, start) if start >= 0 else False:
                found.add((0, start, start + len(notice)))
                exact = start
            elif exact < 0 or start > exact + edits:
                if m := pattern.search(line, max(start - edits, 0), min(start + len(notice) + edits, len(line))):
                    found.add((sum(m.fuzzy_counts), m.start(), m.end()))
        kept: list[tuple[int, int]] = []
        out = []
        for wrong, low, high in sorted(found):
            at = bisect_left(kept, (low, low))
            if (at == 0 or kept[at - 1][1] <= low) and (at == len(kept) or kept[at][0] >= high):
                kept.insert(at, (low, high))
                out.append((low, high, wrong))
        return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``docs`` (its columns ``keep``) with ``ls_words``, ``ls_base`` (exact phrases) and ``ls_notices`` (verified notices)."""
    prepare(docs.sparkSession)
    keep = [c for c in (keep or docs.columns) if c.lower() not in RESULT.names]
    rows = docs.select(*dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64()), ("likeness", pa.float64())]))
        for b in batches:
            col = strings(b[text])
            for s, e in slices(col):
                found = [scanner.scan(x) for x in col[s:e].cast(pa.large_binary()).to_pylist()]
                n, base, spans = ([x[k] for x in found] for k in range(3))
                yield pa.RecordBatch.from_arrays([b[c].slice(s, e - s) for c in keep] + [pa.array(np.array(n, np.int64)), pa.array(base, base_type), pa.array(spans, span_type)], [*keep, *RESULT.names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *RESULT.fields]))
