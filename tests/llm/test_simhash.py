import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import simhash as H
from tallyframe.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius=H.RADIUS):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_classes_equal_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    rows = H.near_duplicate_classes(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    prints = [int(r.fingerprint, 16) for r in rows]
    assert all(p == brute_fingerprint(texts[r.doc_id]) for p, r in zip(prints[:200], rows, strict=False))
    roots = brute_components(prints)
    least = {}
    for root, r in zip(roots, rows, strict=True):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert all(r.component_id == least[root] for root, r in zip(roots, rows, strict=True))


def test_dense_cluster_and_chains(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(1 << 62))
    prints = {base}
    for _ in range(300):
        x = base
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    chain = [int(rng.integers(1 << 62))]
    for k in range(6):
        chain.append(chain[-1] ^ (0b1111 << (8 * k)))
    far = [int(x) for x in rng.integers(1 << 62, size=200)]
    every = sorted(prints | set(chain) | set(far))
    df = spark.createDataFrame([(H.signed(x), 1 + i % 3) for i, x in enumerate(every)], "fp long, n long")
    got = {r.fp % (1 << 64): r.comp for r in H.link_fingerprints(df).collect()}
    roots = brute_components(every)
    assert len(got) == len(every)
    assert len({(r, got[x]) for r, x in zip(roots, every, strict=True)}) == len(set(roots)) == len(set(got.values()))


def test_wider_radius_and_more_blocks(spark, monkeypatch):
    docs = table(spark, FOLDER, "documents")
    rows = H.near_duplicate_classes(docs, radius=6, shingle=5).collect()
    roots = brute_components([int(r.fingerprint, 16) for r in rows], 6)
    pairs = {(root, r.component_id) for root, r in zip(roots, rows, strict=True)}
    assert len(pairs) == len(set(roots)) == len({r.component_id for r in rows})
    assert H.block_count(10**5, 4) == 6 and H.block_count(10**8, 4) == 7 and H.block_count(10**6, 6) == 9
    monkeypatch.setattr(H, "BUCKET", 1e-6)
    again = {r.doc_id: r.component_id for r in H.near_duplicate_classes(docs, radius=2, shingle=5).collect()}
    least = {}
    roots = brute_components([int(r.fingerprint, 16) for r in rows], 2)
    for root, r in zip(roots, rows, strict=True):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert all(again[r.doc_id] == least[root] for root, r in zip(roots, rows, strict=True))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (5, "A B c d e"), (2, None), (3, ""), (4, " \t\n"), (None, "a b c d e"), (None, "only here " * 9), (7, "w " * 200_000), (7, "w " * 200_000)], "doc_id long, text string").withColumn("fp", F.lit(3))
    out = H.near_duplicate_classes(docs).collect()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert len(out) == 9 and by[5].component_id == 1 and {by[i].component_id for i in (2, 3, 4)} == {2}
    assert by[2].fingerprint == "0" * 16 and by[7].component_id == 7
    assert sorted(str(r.component_id) for r in out if r.doc_id is None) == ["1", "None"]
    assert H.near_duplicate_classes(docs.where("false")).count() == 0


def test_rounds_do_not_compound_the_planners_estimates(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(63)], "a long, b long")
    found = H.components(spark.range(70).withColumnRenamed("id", "fp"), edges)
    estimate = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert estimate < 1 << 200, estimate.bit_length()
    assert {r.fp: r.comp for r in found.collect()} == {k: k if k > 63 else 0 for k in range(70)}
