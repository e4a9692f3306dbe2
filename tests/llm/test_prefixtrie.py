from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import duck, same

from driftwarden.llm import prefixtrie as P
from driftwarden.llm.queries import OP11_SQL, op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs: dict[int, tuple]) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []

    def walk(path):
        """Leaves and savings of the subtree, by post-order without recursion limits."""
        order, todo = [], [path]
        while todo:
            x = todo.pop()
            order.append(x)
            todo += children[x]
        sums = {}
        for x in reversed(order):
            own = (len(members[x]) - 1) * len(x[-1][1]) if x else 0
            sums[x] = (sum(sums[y][0] for y in children[x]) or 1, own + sum(sums[y][1] for y in children[x]))
        return sums

    if members:
        for path, (leaves, saved) in walk(()).items():
            ends = ",".join(map(str, sorted(c for c in members[path] if len(convs[c]) == len(path))))
            parent = min(members[path[:-1]]) if path else None
            out.append((min(members[path]), len(path), parent, len(members[path]), len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows: list[tuple]) -> dict[int, tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: tuple(x[2:] for x in sorted(v, key=lambda x: (x[:2], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest()[:32]))) for c, v in own.items() if c is not None}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, ())[:h] + turns[h:]
    return out


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def some(seed: int, n: int, longest: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice("ab") * r.randint(1, 2)))
    r.shuffle(rows)
    return rows


@pytest.fixture
def many_ranges(spark):
    """Small tables keep all their ranges, so that boundaries are met."""
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain(rows):
    own = defaultdict(list)
    for c, t, role, text in sorted(rows):
        own[c].append((role, text))
    return {c: tuple(v) for c, v in own.items()}


@pytest.mark.parametrize(("block", "pending", "chunk"), [(64, 50_000, 65_536), (1, 50_000, 65_536), (2, 2, 8), (3, 1, 1)])
def test_nodes_by_brute_force(spark, many_ranges, block, pending, chunk):
    rows = some(block, 60, 9)
    rows += [(1000 + c, t, "user", "x") for c in range(40) for t in range(7)]  # copies over several ranges
    found = P.prefix_trie(spark.createDataFrame(rows, SCHEMA), block=block, pending=pending, chunk=chunk)
    assert got(found) == brute(plain(rows))


def test_long_conversations_share_blocks(spark, many_ranges):
    rows = [(c, t, "user", "y" if t < 150 + 20 * (c % 3) else str(c)) for c in range(6) for t in range(200 + c)]
    assert got(P.prefix_trie(spark.createDataFrame(rows, SCHEMA), block=16)) == brute(plain(rows))


def test_one_conversation_over_all_ranges(spark, many_ranges):
    rows = [(5, t, "user", str(t)) for t in range(700)] + [(6, 0, "user", "0"), (7, None, None, None)]
    turns = P.numbered(spark.createDataFrame(rows, SCHEMA))
    assert [r.at for r in turns.where("conv_id = 5").orderBy("at").collect()] == list(range(700))
    found = P.trie(turns, block=32)
    assert found.where("conv_id = 5 AND n_leaves = 1").count() >= 699
    assert [r.depth for r in P.node_turns(found, turns).where("key IS NULL").collect()] == [0]


def test_rebuilt_with_nulls_ties_and_absent_leaders(spark, many_ranges):
    r = random.Random(8)
    rows = [(r.choice([*range(95, 112), *range(205, 212), -3, -150, None]), r.choice([None, 0, 1, 2, 3]), r.choice(["u", None]), r.choice(["a", "b", "", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit(1)).withColumn("key", F.lit(2)).withColumn("part", F.lit(3))
    turns = P.with_heads(P.numbered(df))
    kept = [x for x in rows if x[0] is not None and x[0] >= 0]
    assert got(P.trie(P.with_heads(P.numbered(df.where("conv_id >= 0"))), block=2)) == brute(rebuilt(kept))
    assert P.trie(turns).where("depth = 0").count() == 1


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.trie(P.with_heads(P.numbered(empty))).count() == 0
    # One turn each and no conversation 300: those with h > 0 have no turns left.
    rows = [(c, 0, "u", "t") for c in range(301, 313)]
    assert got(P.trie(P.with_heads(P.numbered(spark.createDataFrame(rows, SCHEMA))))) == brute(rebuilt(rows))


def test_query_equals_sql(spark, sf, many_ranges):
    same(op11_prefix_trie(spark, sf), duck(sf), OP11_SQL)
