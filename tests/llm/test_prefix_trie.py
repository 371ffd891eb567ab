import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from credlens.llm import prefix_trie as T
from pyspark.sql import functions as F


def turn_digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def rebuild(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0, turn_digest(role, text)), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(first, [])[:h] + own[c][h:]
    return out


def brute(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not children[p]
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
                  for p, m in members.items())


def table(seed):
    rng = np.random.default_rng(seed)
    say = ["a", "hé 😀", "", None, "long " * 30]
    rows = []
    for c in [*range(60), *range(100, 130), 250, 251, 399, -7, -150, 1 << 40]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["u", "s", None][rng.integers(3)], say[rng.integers(5)]))
    for c in range(1000, 1040):                     # equal conversations, and a common start
        rows += [(c, t, "u", f"same {t}") for t in range(7 + (c % 4 == 0))]
    for c in range(2000, 2006):                     # long ones that part late
        rows += [(c, t, "u", f"deep {t}" if t < 21 else f"{c} {t}") for t in range(19 + c % 6 * 3)]
    rows += [(5, None, "u", "first"), (5, 0, "u", "tie"), (5, 0, "u", "tie"), (None, 1, "u", "x")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("segment, sequences", [(2, 3), (64, 4096)])
def test_nodes_are_brute_force(spark, segment, sequences):
    rows = table(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("key", F.lit(1))
    got = T.prefix_tree(*T.rebuilt(df), segment=segment, sequences=sequences).select(*COLUMNS).collect()
    order = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=order) == sorted(brute(rebuild(rows)), key=order)


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert T.prefix_tree(*T.rebuilt(df)).collect() == []
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = T.prefix_tree(*T.rebuilt(spark.createDataFrame([(c, 0, "u", "x")], SCHEMA))).select(*COLUMNS).collect()
    assert list(map(tuple, got)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_double_array_keeps_children_apart():
    rng = np.random.default_rng(3)
    trie = T.DoubleArray(1)
    children, states = {}, [0]
    for _ in range(6):
        s, c = [], []
        for x in states:
            for code in sorted(rng.choice(np.arange(1, 40), size=rng.integers(1, 6), replace=False)):
                s.append(x)
                c.append(code)
        to = trie.add(np.array(s), np.array(c))
        children |= dict(zip(zip(s, c), to.tolist()))
        states = to[:40].tolist()
    assert len(set(children.values())) == len(children)
    every = np.array([(s, c) for s in {s for s, _ in children} for c in range(1, 41)])
    got = trie.step(every[:, 0], every[:, 1])
    assert got.tolist() == [children.get((s, c), T.FREE) for s, c in every.tolist()]


def test_long_end_lists_are_hashed_in_pieces(spark, tmp_dir):
    ids = list(range(0, 30000, 3))
    spark.createDataFrame([(bytes([k]), i) for k in (1, 2) for i in ids], "end_key binary, conv_id long") \
        .write.mode("overwrite").parquet(tmp_dir)
    got = T.end_digests(spark.read.parquet(tmp_dir)).collect()
    assert {r.sha for r in got} == {hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()} and len(got) == 2


def test_arrays_stay_small_when_children_have_distant_codes():
    rng = np.random.default_rng(4)
    trie = T.DoubleArray(400)
    codes = np.sort(rng.choice(np.arange(1, 20_000), size=(400, 2)), axis=1)
    codes[:, 1] += codes[:, 0] == codes[:, 1]
    states = np.repeat(np.arange(400), 2)
    to = trie.add(states, codes.ravel())
    assert len(set(to.tolist())) == 800 and trie.step(states, codes.ravel()).tolist() == to.tolist()
    assert len(trie.check) < 100_000
