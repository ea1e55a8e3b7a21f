"""The trie by brute force: small shards, heavy levels, conversations that span tasks, nulls and repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyframe.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children, sum(map(leaf, below)), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **settings):
    return sorted(map(tuple, P.conversation_trie(df, **settings).collect()), key=str)


def corpus(seed, convs=120):
    rnd = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rnd.randrange(-250, 400)
        for t in range(rnd.randrange(1, 7)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "é𝒳", ""])))
    rows += [(None, 0, "user", "x"), (300, None, None, None), (301, 1, None, "q"), (302, 1, "", "q"), (303, 1, "u", "v"), (303, 1, "u", "v"), (303, 1, "u", "a")]
    same = [(t, "u", f"turn {t}") for t in range(9)]
    return rows + [(c, *x) for c in range(1000, 1040) for x in same] + [(c, *x) for c in range(1100, 1110) for x in same[:4]]


@pytest.mark.parametrize(("shard_rows", "group_nodes"), [(16_384, 8_192), (20, 50), (0, 10), (3, 1)])
def test_equals_brute_force(spark, shard_rows, group_nodes):
    rows = corpus(shard_rows)
    assert found(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows, group_nodes=group_nodes) == brute(rows)


def test_long_conversations_span_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE_IDS", 3)
    long = [(7, t, "user", str(t % 5)) for t in range(400)]
    twin = [(0, t, "user", str(t % 5)) for t in range(400)]
    rows = long + twin + [(c, t, "user", str(t)) for c in range(200, 240) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    ranked = P.ranked_turns(df.selectExpr("conv_id c", "turn", "md5(text) digest", "1L chars"))
    assert sorted((r["c"], r["i"]) for r in ranked.where("c in (0, 7)").collect()) == [(c, i) for c in (0, 7) for i in range(1, 401)]
    assert ranked.where("c in (0, 7)").select("i", "h1", "h2").distinct().count() == 400  # both have the same hashes
    assert found(df, shard_rows=50, group_nodes=20) == brute(rows)


def test_louds_gives_back_the_tree():
    rnd = random.Random(4)
    n = 200
    parent = np.array([-1, -1] + [rnd.randrange(i) for i in range(2, n)])
    level = np.zeros(n, dtype=np.int64)
    for i in range(2, n):
        level[i] = level[parent[i]] + 1
    label = np.array([rnd.randrange(1000) for _ in range(n)])
    order, bits, bounds = P.louds(parent, level, label)
    assert len(bits) == 2 * n + 1 and bits.sum() == n
    back = P.louds_parents(bits)
    for place, row in enumerate(order):
        assert (back[place] < 0) == (parent[row] < 0)
        assert parent[row] < 0 or order[back[place]] == parent[row]
    assert (P.louds_degrees(bits) == np.bincount(parent[parent >= 0], minlength=n)[order]).all()
    assert (level[order] == np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))).all()


def test_empty_table_and_clashing_columns(spark):
    assert P.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    rows = corpus(9, 20)
    extra = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", depth int, c int")
    assert found(extra) == brute(rows)
    # A conversation shorter than what it would take over, whose base is absent, has no turns.
    only = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert found(spark.createDataFrame([(only, 0, "u", "x")], SCHEMA)) == [(only, 0, None, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest())]
