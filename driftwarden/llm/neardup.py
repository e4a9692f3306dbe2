"""MinHash near-duplicates by tensored banding, confirmed on full shingle sets.

``collections`` small collections of ``width`` minhashes each are computed for every distinct set; a table
key joins two of them, so n collections serve n(n-1)/2 tables (14 x 2 minhashes give 91 tables of
4). A pair at similarity 0.8 meets in a collection with probability 0.64 and is missed only if at most
one of the 14 agrees: 1.6e-5.

Texts with equal sets form one class before any pairing, so exact copies never meet each other. Keys are
counted by partial sums; in a bucket of up to ``small`` classes all pairs are candidates. Larger buckets are
families: each has a pivot P, the shingles that most of up to ``PIVOTS`` central members hold. A member x is
described by its difference D(x) from the pivot (what it lacks and what it has besides), and for any two

    |x and y| = |x and P| + |y and P| - |P| + |D(x) and D(y)|.

So x and y reach the similarity if a(x) + a(y) is large enough, with a(x) a number of x alone; all such pairs are
tied by linking each member to the one with the largest a. Any other pair needs common differences, a number
known beforehand, and is found by joining the first few differences of members that are not yet in one
component (prefix and position filter, rare ones first). Near copies of one text differ in few and mostly
different shingles, so this join is small where a join on shingles would pair the family. Nothing is capped.

Defined cases: null and empty texts have no set and link with nothing; fewer words than a shingle form
one shingle; rows with a null id stay alone and are kept; rows that share an id count as one
document; added columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import SPACED_WORDS, Words, cut, drop_cut, mix64, prepare, slices, strings, utf8, wanted_only
from driftwarden.llm.components import components

CHUNK = 256
PIVOTS = 31
PARITY = [f"b{k}" for k in range(8)]
_ROLL = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows and each row's bounds; short rows have their whole sequence."""
    n, h = len(words), words.hash
    count = np.diff(words.bounds)
    out = np.zeros(n, np.uint64)
    if n >= size:
        rolled = sum((h[k : n - size + 1 + k] * _ROLL[k % len(_ROLL)] + np.uint64(k // len(_ROLL)) for k in range(size)), np.zeros(n - size + 1, np.uint64))
        out[: n - size + 1] = mix64(rolled)
    each = np.maximum(count - size + 1, np.minimum(count, 1))
    inside = np.arange(n) - words.bounds[words.row] < each[words.row] if n else np.empty(0, bool)
    for r in np.flatnonzero((count > 0) & (count < size)):
        s, e = words.bounds[r], words.bounds[r + 1]
        out[s] = xxhash.xxh3_64_intdigest(h[s:e].tobytes(), seed=int(e - s))
    return out[inside], np.concatenate([[0], np.cumsum(each)])


def sets(col: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row range and sorted distinct shingle hashes of each row."""
    for s, e in slices(col):
        values, bounds = shingles(Words(*utf8(col[s:e]), SPACED_WORDS), size)
        yield s, e, [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signatures(rows: list[np.ndarray], seeds: np.ndarray, collections: int, width: int) -> np.ndarray:
    """One key for each row and collection; rows must not be empty."""
    values = np.concatenate(rows)
    starts = np.cumsum([0, *(len(r) for r in rows[:-1])])
    keys = np.zeros((len(rows), collections), np.uint64)
    for k in range(collections * width):
        low = np.minimum.reduceat(values * (seeds[k] | np.uint64(1)) + (seeds[k] >> np.uint64(7)), starts)
        keys[:, k // width] = mix64(keys[:, k // width] * np.uint64(0x9E3779B97F4A7C15) + low)
    return keys


def digests(docs: DataFrame, id: str, text: str, size: int, collections: int, width: int, seed: int) -> DataFrame:
    """(id, n, d1, d2, keys): set size, 128-bit digest of the set and the collections' keys."""
    seeds = np.random.Generator(np.random.Philox(seed)).integers(0, 1 << 63, collections * width, dtype=np.int64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, rows in sets(strings(b["text"]), size):
                n = np.array([len(r) for r in rows], np.int64)
                full = np.flatnonzero(n)
                keys = np.zeros((len(rows), collections), np.uint64)
                two = np.zeros((len(rows), 2), np.int64)
                if len(full):
                    keys[full] = signatures([rows[i] for i in full], seeds, collections, width)
                    for i in full:
                        two[i] = np.frombuffer(xxhash.xxh3_128_digest(rows[i].tobytes()), np.int64)
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * collections), flat)
                yield pa.RecordBatch.from_arrays([b["id"].slice(s, e - s), pa.array(n), pa.array(two[:, 0]), pa.array(two[:, 1]), lists], ["id", "n", "d1", "d2", "keys"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, d1 long, d2 long, keys array<long>")


def buckets(keyed: DataFrame, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, id) rows -> pairs (a, b) of small buckets, members (bucket, id) of larger ones, the table these read.

    Keys are counted first; only rows of keys that several classes have are joined to the written counts, so the
    join of a hot key can be split and no bucket is gathered unless it is small.
    """
    counted = cut(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared-keys")
    met = cut(wanted_only(keyed, "key", counted.select("key"), 1 << 18).join(counted.hint("merge"), "key"), "met")
    drop_cut(counted)
    few = met.where(F.col("m") <= small).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    each = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.lit(small)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = cut(few.select(F.explode(each).alias("p")).select("p.a", "p.b").distinct(), "candidates")
    return pairs, met.where(F.col("m") > small).select(F.col("key").alias("bucket"), "id"), met


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if not len(x) or not len(y):
        return 0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[at] == y).sum())


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def families(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family, id) members of large buckets and (family, id) of up to ``PIVOTS`` central ones.

    A member is the more central, the larger its buckets are together; a bucket belongs to the family of
    its most central member. All are aggregates with partial results, whatever the size of a bucket, and are
    written before they are joined back: a join of two scans on a hot bucket can be split.
    """
    rows = large
    sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("m")), "bucket-sizes")
    central = cut(rows.join(sizes, "bucket").groupBy("id").agg(F.sum("m").alias("central")), "central")
    ranked = cut(rows.join(central, "id"), "ranked")
    best = lambda: F.max(F.struct("central", (-F.col("id")).alias("id")))
    hub = cut(ranked.groupBy("bucket").agg((-best()["id"]).alias("family")), "bucket-hubs")
    members = cut(ranked.join(hub, "bucket").select("family", "id", "central").distinct(), "members")
    drop_cut(sizes, central, ranked, hub)
    chosen = members.groupBy("family", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("part")).agg((-best()["id"]).alias("id"))
    return members.select("family", "id"), chosen.select("family", "id")


class Pivot:
    """The shingles of at least half of a family's central sets, and the id and set most like them."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.values, count = np.unique(np.concatenate([x for _, x in rows]), return_counts=True)
        inside = 2 * count >= len(rows)
        self.pivot = self.values[inside]
        # How common a difference is: sets that lack a shingle of the pivot, sets that have another one.
        self.often = np.where(inside, len(rows) - count, count)
        likeness = [(common(self.pivot, x) / (len(self.pivot) + len(x) - common(self.pivot, x)), -i) for i, x in rows]
        self.hub, self.best = rows[max(range(len(rows)), key=likeness.__getitem__)]

    def difference(self, row: np.ndarray) -> tuple[int, np.ndarray]:
        """How much of the pivot the set holds, and its differences, rare ones first, in one order for the family."""
        delta = np.setxor1d(row, self.pivot, assume_unique=True)
        at = np.minimum(np.searchsorted(self.values, delta), len(self.values) - 1)
        often = np.where(self.values[at] == delta, self.often[at], 0)
        return (len(row) + len(self.pivot) - len(delta)) // 2, delta[np.lexsort((delta, often))]


def parity(values: np.ndarray) -> list[int]:
    """512 bits: whether an odd number of values falls on each. Two sets differ in at least as many values as bits."""
    odd = np.bincount((values & np.uint64(64 * len(PARITY) - 1)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def compare(pairs: DataFrame, members: DataFrame | None, chosen: DataFrame | None, docs: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    """Full sets side by side: (kind, family, id, hub, linked, core, a, delta, b0..b7).

    Kind 0 has the pairs (a, b) that reach the similarity, as hub and id. Kind 1 has every member against hub and
    pivot of its family: ``core`` is the pivot's size, ``delta`` what the member differs in, ``b0`` to ``b7``
    its ``parity``, and ``a`` is (100 + percent) |x and pivot| - percent |x|. Only texts that are needed move, once for both. The partners of one member and the
    members of one family are dealt in chunks of about ``CHUNK``, each with what it is compared with.
    """
    parts = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    chunks = lambda df, c: cut(df.groupBy(c).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks")
    dealt = pairs.select("a", "b").join(chunks(pairs, "a"), "a").select(F.col("a").alias("family"), "b", parts("b", F.col("chunks")).alias("salt"))
    role = lambda df, kind, c, r: df.select(F.col(c).alias("id"), F.lit(kind).alias("kind"), "family", "salt", F.lit(r).alias("role"))
    roles = role(dealt, 0, "b", 1).union(role(dealt, 0, "family", 0).distinct())
    if members is not None:
        count = chunks(members, "family")
        roles = roles.union(role(members.join(count, "family").withColumn("salt", parts("id", F.col("chunks"))), 1, "id", 1))
        roles = roles.union(role(chosen.join(count, "family").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))), 1, "id", 0))
    roles = cut(roles, "roles")
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    sides = wanted_only(texts, "id", roles.select("id")).join(roles.hint("merge"), "id")
    sides = sides.repartition("kind", "family", "salt").sortWithinPartitions("kind", "family", "salt", "role", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, firsts, pivot = None, [], None
        for b in batches:
            out: list[tuple] = []
            kind, family, salt, role, ids = (b[c].to_pylist() for c in ("kind", "family", "salt", "role", "id"))
            for s, _, rows in sets(strings(b["text"]), size):
                for i, row in enumerate(rows, s):
                    if (kind[i], family[i], salt[i]) != where:
                        where, firsts, pivot = (kind[i], family[i], salt[i]), [], None
                    if role[i] == 0:
                        firsts.append((ids[i], row))
                    elif kind[i] == 0:
                        if any(similar(x, row, percent) for _, x in firsts):
                            out.append((0, family[i], ids[i], family[i], True, 0, 0, None, *([0] * len(PARITY))))
                    else:
                        pivot = pivot or Pivot(firsts)
                        inner, delta = pivot.difference(row)
                        out.append((1, family[i], ids[i], pivot.hub, similar(pivot.best, row, percent), len(pivot.pivot), (100 + percent) * inner - percent * len(row), delta.view(np.int64), *parity(delta)))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *([pa.int64()] * len(PARITY)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["kind", "family", "id", "hub", "linked", "core", "a", "delta", *PARITY])

    return sides.mapInArrow(run, "kind int, family long, id long, hub long, linked boolean, core long, a long, delta array<long>, " + ", ".join(f"{b} long" for b in PARITY))


def certain_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member with the family's member of largest ``a``, where the pivot alone holds enough of both.

    Two members are surely similar if a(x) + a(y) >= (100 + percent) core; then each of them is with the largest, too.
    """
    top = cut(rows.groupBy("family").agg(F.max(F.struct("a", (-F.col("id")).alias("id"))).alias("top")), "centres")
    near = rows.join(top, "family").where((F.col("a") + F.col("top.a") >= (100 + percent) * F.col("core")) & (F.col("id") != -F.col("top.id")))
    return near.select((-F.col("top.id")).alias("a"), F.col("id").alias("b"))


def rest_of_families(rows: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of members in different components, one outside the hub's, that may reach the similarity.

    Two members need ``ceil(core - (a(x) + a(y)) / (100 + percent))`` common differences. A member's own ``need``
    is the least of these over all partners, so a pair has its first common difference among the first
    |D| - need + 1 of both; ``main`` counts these towards the hub's component, ``other`` towards the rest. The places of that first one and the parities
    bound from above how many differences two members share, before any text moves.
    """
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    rows = rows.join(of("id"), "id", "left").join(of("hub"), "hub", "left")
    component = F.coalesce("id_component", "id")
    rows = rows.select("family", "id", "core", "a", "delta", *PARITY, component.alias("component"), (component != F.coalesce("hub_component", "hub")).alias("apart"))
    rows = cut(rows, "apart")
    most = cut(rows.groupBy("family").agg(F.max(F.when(~F.col("apart"), F.col("a"))).alias("most_main"), F.max(F.when(F.col("apart"), F.col("a"))).alias("most_apart")).where("most_apart is not null"), "most")
    size = F.size("delta")
    need = lambda partner: F.greatest(F.lit(1), F.ceil(F.col("core") - (F.col("a") + F.col(partner)) / (100 + percent)))
    length = lambda partner: F.greatest(F.lit(0), F.coalesce(size - need(partner) + 1, F.lit(0))).cast("int")
    rows = rows.join(most, "family").withColumns({"main": F.when(F.col("apart"), length("most_main")).otherwise(F.lit(0)), "other": length("most_apart"), "size": size})
    rows = rows.where("main > 0 or other > 0").withColumn("held", F.slice("delta", F.lit(1), F.greatest("main", "other"))).drop("delta")
    spread = cut(rows.select("*", F.posexplode("held").alias("at", "shingle")).drop("held"), "differences")
    side = lambda v, *more: spread.where(" and ".join(more)).select("family", "shingle", *(F.col(c).alias(f"{c}_{v}") for c in ("id", "a", "at", "size", "component", *PARITY)), *(["core"] if v == "x" else []))
    # Differences of one component alone pair nobody.
    mixed = cut(spread.groupBy("family", "shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("apart").alias("any")).where("low <> high and any").select("family", "shingle"), "mixed")
    apart = " + ".join(f"bit_count({b}_x ^ {b}_y)" for b in PARITY)
    shared = f"least(size_x - at_x, size_y - at_y, (size_x + size_y - ({apart})) div 2)"
    enough = f"component_x <> component_y and (core - {shared}) * {100 + percent} <= a_x + a_y"
    keys = ["family", "shingle"]
    x = lambda *more: side("x", "apart", *more).join(mixed, keys)
    found = x("at < main").join(side("y", "not apart"), keys).union(x("at < other").join(side("y", "apart", "at < other"), keys))
    return found.where(enough).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, collections: int = 14, width: int = 2, small: int = 6, seed: int = 7) -> DataFrame:
    """(id, nd_shingles, nd_component, nd_kept) for each row of ``docs``."""
    prepare(docs.sparkSession)
    marked = cut(digests(docs, id, text, shingle, collections, width, seed), "sets")
    full = marked.where("n > 0 and id is not null")
    classes = full.groupBy("d1", "d2").agg(F.min("id").alias("vid"), F.first("keys").alias("keys"))
    reps = cut(classes, "classes")
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("keys")[i], F.col("keys")[j]) for t, (i, j) in enumerate(combinations(range(collections), 2))])
    pairs, large, met = buckets(reps.select(F.explode(tables).alias("key"), F.col("vid").alias("id")), small)
    crowded = not large.isEmpty()
    compared = cut(compare(pairs, *(families(large) if crowded else (None, None)), docs, id, text, shingle, percent), "compared")
    rows = compared.where("kind = 1")
    # Rows that share an id are one document: the classes of one id are tied without a comparison.
    many = full.select("id", "d1", "d2").distinct().groupBy("id").count().where("count > 1").select("id")
    ties = full.join(many, "id").join(reps.select("d1", "d2", "vid"), ["d1", "d2"]).where("id <> vid").select(F.col("vid").alias("a"), F.col("id").alias("b")).distinct()
    link = [F.col("hub").alias("a"), F.col("id").alias("b")]
    linked = compared.where("linked and id <> hub").select(*link).union(ties)
    links = cut(linked.union(certain_links(rows, percent)) if crowded else linked, "links")
    labels = components(links)
    drop_cut(met)
    if crowded:
        more = cut(rest_of_families(rows, labels, percent).join(pairs, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            found = cut(compare(more, None, None, docs, id, text, shingle, percent).select(*link), "found")
            if not found.isEmpty():
                drop_cut(labels)
                labels = components(links.union(found))
            drop_cut(found)
        drop_cut(more)
    drop_cut(pairs, compared, links)
    whole = reps.join(labels.withColumnRenamed("id", "vid"), "vid", "left").select("d1", "d2", F.coalesce("component", "vid").alias("component"))
    out = marked.join(whole, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("nd_shingles"), component.alias("nd_component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("nd_kept"))
