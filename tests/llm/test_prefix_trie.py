import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from macropanel.llm import prefix_trie as P

KIND = "conv_id long, turn long, role string, text string, path string, shard int"


def by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:])  # the sign of c, as SQL has it
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].split()) if q else 0) for q in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, len(leaves), saved, sha))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 90), *range(70_000, 70_030), -20, -19, -3]:
        for t in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, rng.choice([None, t, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b", "c", "", None, "ü\n x\ty "])))
    rows += [(c, t, "user", "same words here") for c in range(300, 360) for t in range(4)]  # one path for all families
    rows += [(20_000, t, "user", f"turn {t}") for t in range(200)] + [(20_001, t, "user", f"turn {t}") for t in range(150)]
    return [*rows, *rows[:5], (None, 1, "user", "nobody")]


@pytest.mark.parametrize("shards", [1, 8, 50])
def test_equals_a_trie_by_hand(spark, shards):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND).repartition(5)
    got = sorted(map(tuple, P.prefix_trie(P.turn_paths(df), shards=shards).collect()), key=str)
    assert got == by_hand(rows)


def test_turnless_and_empty(spark):
    # Conversation 41 has one turn, takes two of an absent head, and has none left.
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 > 1)
    one = spark.createDataFrame([(c, 0, "user", "gone", "x", 1)], KIND)
    sha = hashlib.sha256(str(c).encode()).hexdigest()
    assert [tuple(r) for r in P.prefix_trie(P.turn_paths(one)).collect()] == [(c, 0, None, 1, 0, 1, 0, sha)]
    assert P.prefix_trie(P.turn_paths(spark.createDataFrame([], KIND))).count() == 0


def test_shards_share_only_prefixes_of_splitters(spark):
    paths = spark.createDataFrame([(i, bytes([i % 7]) * 16 + bytes(8) + bytes([i % 11]) * 16 + bytes(8) + i.to_bytes(16, "big") + bytes(8)) for i in range(500)], "conv_id long, path binary")
    cuts = P.splitters(paths, 8)
    assert len(cuts) == 7
    broadcast = spark.sparkContext.broadcast(cuts)
    walked = P._walked(P._dealt(paths, broadcast), broadcast, 8).collect()
    prefixes = {cut[: 24 * d] for cut in cuts for d in range(4)}
    assert {bytes(r.path) for r in walked if r.shared} <= prefixes
    assert sum(not r.shared for r in walked) > 500 and len(walked) < 700
