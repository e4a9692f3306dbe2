"""Sequence packing along a Hilbert curve.

Each document's token ids are counted into a hashed vector, which is projected to three dimensions; the
curve's key orders documents so that neighbours are alike. Documents are sorted by ranges of (key, hash
of id), so equal keys are spread over ranges, and every range is laid end to end from the count of
tokens before it. The stream is cut every ``capacity`` tokens: only the last sequence is padded.

Tokens are found word by word as the tokenizer's own splitting gives them, each distinct word being encoded once by
the tokenizer's model; texts with characters outside the plain Latin set go to it whole, and so do all texts where the
tokenizer's file states other rules of splitting than the ones written here.

Defined cases: null and empty texts are one token, the separator; rows that share an id are packed one
after the other, each with its own offsets; no documents give no sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.llm.common import cut, mix64, prepare, slices, strings

BUCKETS = 4096  # of the hashed document vector
DIMENSIONS, DIGITS = 3, 13
HASH_DIGITS = 62 - DIMENSIONS * DIGITS
REMEMBERED = 500_000
RANGE_ROWS = 20_000
RANGE_TOKENS = 8_000_000
WEIGHT = 1024
SCALE = 1 << 20  # parts of a unit that coordinates are summed in

#: Outside these characters, words are not split here.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
#: The tokenizer's pattern of words, for plain characters in lower case.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """Characters of the plain set as the letters that byte-level vocabularies have for their UTF-8 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


#: What a tokenizer's file says if these rules are its own.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRETOKENIZERS = [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


class Encoder:
    """Text to token ids as little-endian bytes, ``width`` a token. It remembers words, so keep one a process (``encoder``)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_words = (rules["normalizer"], rules["pre_tokenizer"]) == ({"type": "Sequence", "normalizers": NORMALIZERS}, {"type": "Sequence", "pretokenizers": PRETOKENIZERS}) and rules["model"]["type"] == "BPE" and not rules["model"]["dropout"]
        self.added = [t["content"][:2] for t in rules["added_tokens"]]
        self.width = 2 if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else 4
        self.letters = byte_letters()
        self.pairs = [k.to_bytes(self.width, "little") for k in range(max(self.tokenizer.get_vocab().values(), default=0) + 1)]
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, f"<u{self.width}").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words: the tokenizer's own merges, without its splitting and offsets."""
        merge, letters, pairs = self.tokenizer.model.tokenize, self.letters, self.pairs
        return [b"".join([pairs[t.id] for t in merge(w.translate(letters))]) for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.by_words and not _PLAIN.search(t) and not any(x in t for x in self.added)]
        split = [_SPLIT.findall(texts[i].lower()) for i in plain]
        words = set().union(*split)
        fresh = list(words.difference(self.known))
        if len(self.known) + len(fresh) > REMEMBERED:  # what is in use stays
            self.known = {w: self.known[w] for w in words.intersection(self.known)}
        self.known.update(zip(fresh, self._words(fresh), strict=True))
        for i, words in zip(plain, split, strict=True):
            out[i] = b"".join(map(self.known.__getitem__, words))
        rest = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(rest), 64):
            for i, ids in zip(rest[k : k + 64], self._whole([texts[i] for i in rest[k : k + 64]]), strict=True):
                out[i] = ids
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def projection(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(seed)).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def coordinates(ids: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The unit vector of square-rooted hashed counts, projected."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.bincount(hashed, minlength=BUCKETS)
    there = np.flatnonzero(counts)
    return np.sqrt(counts[there] / counts.sum()).astype(np.float32) @ plane[there]


def hilbert(points: np.ndarray, digits: int) -> np.ndarray:
    """Distances along the Hilbert curve of non-negative integer points (rows), ``digits`` bits a coordinate.

    Gray-code form of the curve (Skilling 2004), over all points at once.
    """
    x = [points[:, k].astype(np.uint64) for k in range(points.shape[1])]
    one = np.uint64(1)
    bit = one << np.uint64(digits - 1)
    while bit > one:
        low = bit - one
        for k in range(len(x)):
            up = (x[k] & bit) > 0
            swap = np.where(up, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[k]
        bit >>= one
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    bit = one << np.uint64(digits - 1)
    while bit > one:
        turn = np.where((x[-1] & bit) > 0, turn ^ (bit - one), turn)
        bit >>= one
    key = np.zeros_like(x[0])
    for d in range(digits - 1, -1, -1):
        for v in x:
            key = (key << one) | (((v ^ turn) >> np.uint64(d)) & one)
    return key


def tokenized(docs: DataFrame, id: str, text: str, tokenizer: str, separator: int, seed: int) -> DataFrame:
    """(id, ids, tokens, c0, c1, c2): the ids with the separator as bytes, and the coordinates."""
    width = encoder(tokenizer).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = projection(seed)
        for b in batches:
            col = strings(b["text"])
            for s, e in slices(col):
                ids = [x + int(separator).to_bytes(width, "little") for x in encoder(tokenizer).encode(col[s:e].to_pylist())]
                places = np.array([coordinates(np.frombuffer(x, f"<u{width}"), plane) for x in ids], np.float64)
                tokens = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([b["id"].slice(s, e - s), pa.array(ids, pa.binary()), pa.array(tokens), *(pa.array(places[:, k]) for k in range(DIMENSIONS))], ["id", "ids", "tokens", "c0", "c1", "c2"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, ids binary, tokens long, c0 double, c1 double, c2 double")


class Curve:
    """Places on the curve from coordinates: the key in the upper bits, a hash of the id below."""

    def __init__(self, rows: int, sums: list[int], squares: list[int]):
        """From sums over ``rows`` of the coordinates in parts of ``SCALE``, and of their squares."""
        n = max(rows, 1)
        self.mean = np.array([s / n / SCALE for s in sums])
        self.spread = np.array([(n * q - s * s) ** 0.5 / n / SCALE or 1.0 for s, q in zip(sums, squares, strict=True)])

    def places(self, b: pa.RecordBatch) -> np.ndarray:
        z = (np.stack([b[f"c{k}"].to_numpy() for k in range(DIMENSIONS)], 1) - self.mean) / self.spread
        even = 1 / (1 + np.exp(-1.702 * np.clip(z, -8, 8)))  # nearly the normal distribution's ranks
        key = hilbert(np.minimum((even * (1 << DIGITS)).astype(np.int64), (1 << DIGITS) - 1), DIGITS)
        ids = b["id"].fill_null(-1).to_numpy().view(np.uint64)
        return ((key << np.uint64(HASH_DIGITS)) | (mix64(ids + np.uint64(77)) >> np.uint64(64 - HASH_DIGITS))).astype(np.int64)


def placed(rows: DataFrame, curve: Curve, bounds: list[int], columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` with ``place`` and ``part``, the range that it falls in."""
    held = rows.sparkSession.sparkContext.broadcast((curve, np.array(bounds, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve, bounds = held.value
        for b in batches:
            place = curve.places(b)
            part = np.searchsorted(bounds, place, side="left").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), pa.array(place), pa.array(part)], [*columns, "place", "part"])

    chosen = rows.select(*dict.fromkeys(["id", *columns, *(f"c{k}" for k in range(DIMENSIONS))]))
    return chosen.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns) + ", place long, part long")


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = 2048, separator: int = 1, range_rows: int = RANGE_ROWS, max_ranges: int = 50_000, with_ids: bool = True, seed: int = 11) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, tokens, sequence_id, offset, ids).

    ``ids`` are unsigned little-endian bytes, two a token and four if the vocabulary needs them (left out if ``with_ids``
    is false); ``ids_crc32`` is that of
    the same ids as unsigned little-endian 32-bit numbers; ``tokens`` counts the whole document's.
    ``range_rows`` and ``max_ranges`` only size the tasks; the sequences are the same stream for any of them.
    """
    prepare(docs.sparkSession)
    width = encoder(tokenizer).width
    rows = cut(tokenized(docs, id, text, tokenizer, separator, seed), "tokens")
    # Exact sums: those of doubles depend on the order of tasks in their last digits, and with them the order of documents.
    whole = [F.round(F.col(f"c{k}") * SCALE).cast("decimal(19,0)") for k in range(DIMENSIONS)]
    stats = rows.agg(F.count("*"), F.sum("tokens"), *(F.sum(x) for x in whole), *(F.sum(x * x) for x in whole)).first()
    size, total, sums = stats[0], stats[1] or 0, [int(x or 0) for x in stats[2:]]
    curve = Curve(size, sums[:DIMENSIONS], sums[DIMENSIONS:])
    ranges = min(max(1, -(-size // range_rows), -(-total // RANGE_TOKENS)), max_ranges)
    cuts = [k / ranges for k in range(1, ranges)]
    # Ranges of about equal token counts: a place counts once and again for every WEIGHT tokens.
    small = placed(rows, curve, [], ["tokens"]).select(F.explode(F.array_repeat("place", (F.col("tokens") / WEIGHT).cast("int") + 1)).alias("place"))
    bounds = sorted(set(small.agg(F.percentile_approx("place", cuts, 20 * ranges)).first()[0] or [])) if cuts else []
    own = placed(rows, curve, bounds, ["tokens"]).groupBy("part").agg(F.sum("tokens").alias("own"))
    before = own.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("base"))
    laid = placed(rows, curve, bounds, ["id", "ids"]).join(F.broadcast(before), "part")  # at most max_ranges rows
    # Ranges are tasks by their number: dealt by a hash, several would meet in one task.
    laid = laid.repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "place", "id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for b in batches:
            out: list[tuple] = []
            for doc, ids, own, base in zip(*(b[c].to_pylist() for c in ("id", "ids", "part", "base")), strict=True):
                if own != part:
                    part, at = own, base
                done, n = 0, len(ids) // width
                while done < n:
                    size = min(n - done, capacity - at % capacity)
                    piece = ids[width * done : width * (done + size)]
                    out.append((doc, done, size, zlib.crc32(np.frombuffer(piece, f"<u{width}").astype("<u4").tobytes()), n, at // capacity, at % capacity, piece))
                    done, at = done + size, at + size
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary() if name == "ids" else pa.int64()) for k, name in enumerate(names)], names)

    names = ["id", "start", "length", "ids_crc32", "tokens", "sequence_id", "offset", *["ids"] * with_ids]
    return laid.mapInArrow(run, ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in names))
