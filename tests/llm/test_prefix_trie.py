import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.llm import prefix_trie

TURNS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, mark), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(found), len(node), parent, len(found), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(spark, rows, parts=4, width=None):
    turns = spark.createDataFrame(rows, TURNS).repartition(parts)
    turns = turns.withColumns({c: F.lit("x") for c in ("key", "parent", "place", "mark", "n", "h", "part", "length", "owner")})
    got = prefix_trie.trie(turns, width and (lambda n: width))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def sample(seed, n=260, long=0):
    rng = random.Random(seed)
    starts = [[("system", "be kind"), ("user", f"question {k}")] for k in range(3)]
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randint(0, 350), rng.randint(0, 120), -rng.randint(1, 150)])
        if any(r[0] == c for r in rows):
            continue
        path = [*rng.choice(starts), *[(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "héé", "日本", ""])) for _ in range(rng.randint(0, 6))]]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(path[rng.choice([0, 0, 0, 1]) :])]
    rows += [(1007, i, "user", f"long {i % 7}") for i in range(long)] + [(1009, i, "user", f"long {i % 7}") for i in range(long)]
    rng.shuffle(rows)
    return rows


def test_trie(spark):
    rows = sample(1)
    assert built(spark, rows) == brute(rows)


def test_narrow_sketch_long_conversations_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPLIT", 16)
    monkeypatch.setattr(prefix_trie, "IDS", 16)
    monkeypatch.setattr(prefix_trie, "COUNTERS", 64)
    rows = sample(2, 150, long=150)
    assert built(spark, rows, parts=7, width=128) == brute(rows)


def test_hot_copies(spark):
    """A third of the conversations are equal, whatever their families give them."""
    rows = [(100 * i, t, "user", f"same {t}") for i in range(60) for t in range(7)]
    rows += [(100 * i + 1, t, "user", f"own {i} {t}") for i in range(60) for t in range(3)]
    assert built(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "nobody"), (5, None, None, None), (5, None, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 3, None, "c")]
    rows += [(7, 0, "user", ""), (0, 0, "", "x"), (200, 9, "user", "word " * 5000), (250, 0, "user", "1:a"), (251, 0, "user", ":1a")]
    assert built(spark, rows) == brute(rows)


def test_empty(spark):
    assert built(spark, []) == []


def test_turnless(spark):
    """A conversation that gives its turns away and has no first one to take any from."""
    c = next(x for x in range(1, 99) if zlib.crc32(str(x).encode()) % 6 == 3)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too")]
    assert built(spark, rows) == brute(rows)
    assert len(brute(rows)) == 1


@pytest.mark.parametrize("width", [64, 1 << 14])
def test_an_estimate_of_one_is_true(spark, width):
    rows = sample(3)
    paths = prefix_trie.paths(spark.createDataFrame(rows, TURNS)).cache()
    times = {bytes(r["key"]): r["count"] for r in paths.groupBy("key").count().collect()}
    alone = [r for r in prefix_trie.screened(paths, width).collect() if r["alone"]]
    assert all(times[bytes(r["key"])] == 1 for r in alone)
    if width > 64:
        assert len(alone) > 0.9 * sum(n == 1 for n in times.values())
