import random

from tallyframe.llm import decontaminate as D
from tallyframe.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def brute_edits(item, text):
    """Fewest edits between the item and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(text, n, rng):
    s = list(text)
    for _ in range(n):
        p = rng.randrange(len(s))
        op = rng.random()
        if op < 0.4:
            s[p] = rng.choice("abcdefgh")
        elif op < 0.7:
            del s[p]
        else:
            s.insert(p, rng.choice("abcdefgh"))
    return "".join(s)


def test_copies_within_budget_equal_brute_force():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustnr") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 25)))) for i in range(12)]
    texts = []
    for k in range(60):
        item = items[k % 12][1]
        copy = edited(item, rng.randint(0, D.budget(len(item)) + 3), rng)
        texts.append(" ".join(word() for _ in range(rng.randint(0, 30))) + " " + copy + " " + " ".join(word() for _ in range(rng.randint(0, 30))))
    index = D.index_items(items)
    got = {(t, index.ids[i]): e for t, i, e, *_ in D.find_copies(texts, index)}
    for t, text in enumerate(texts):
        for i, item in items:
            item = D.normalise(item)
            best = brute_edits(item, D.normalise(text))
            if best <= D.budget(len(item)):
                assert got.pop((t, i)) == best
    assert not got


def test_spans_point_at_the_copy():
    index = D.index_items([(7, "The quick brown fox jumps over the lazy dog again and again")])
    text = "Intro, intro. THE quick-brown fox   jumps over the lazy dog; again and again! Outro"
    [(t, i, e, a, b)] = D.find_copies([text], index)
    assert e == 0 and D.normalise(text)[a:b] == index.texts[0]


def test_edge_cases(spark):
    items = spark.createDataFrame([(1, "short"), (2, None), (3, ""), (None, "something long enough to match"), (4, "a passage that is long enough to match"), (5, "a passage that is long enough to match")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a passage that is LONG enough, to match y"), (2, None), (3, ""), (4, "word " * 100_000), (1, "short"), (None, "a passage that is long enough to match")], "doc_id long, text string").withColumn("item_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in D.find_contamination(docs, items).collect()) == [(0, 4, 0), (0, 5, 0), (1, 1, 0), (1, 4, 0), (1, 5, 0)]
    assert D.drop_contaminated(docs, items).count() == 3
    assert D.find_contamination(docs, items.where("false")).count() == 0 and D.find_contamination(docs.where("false"), items).count() == 0
    assert D.drop_contaminated(docs, items.where("false")).count() == 6


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = table(spark, FOLDER, "documents"), table(spark, FOLDER, "benchmark")
    whole = sorted(map(tuple, D.find_contamination(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 3000)
    assert sorted(map(tuple, D.find_contamination(docs, items).collect())) == whole
    texts = {r.doc_id: D.normalise(r.text) for r in docs.collect()}
    exact = {(d, i) for i, t in ((r.item_id, D.normalise(r.text)) for r in items.collect()) for d, x in texts.items() if t in x}
    assert exact and exact <= {(d, i) for d, i, *_ in whole}


def test_slices_give_the_same(monkeypatch):
    rng = random.Random(3)
    items = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(8, 90)))) for i in range(20)]
    items += [(90, "ab " * 20), (91, "aab " * 30)]
    texts = ["".join(rng.choice("ab ") for _ in range(700)) + items[k % 22][1] + "ab " * 40 + edited(items[-1][1], 3, rng) for k in range(30)]
    index = D.index_items(items)
    whole = D.find_copies(texts, index)
    assert len(whole) > 30
    for hits, cells in ((1, 1 << 22), (50, 0), (997, 0), (5000, 1 << 22)):
        monkeypatch.setattr(D, "SLICE_HITS", hits)
        monkeypatch.setattr(D, "PAIR_CELLS", cells)
        assert D.find_copies(texts[:6] if hits == 1 else texts, index) == [x for x in whole if hits > 1 or x[0] < 6]


def test_periodic_text_keeps_memory_bounded():
    import tracemalloc

    index = D.index_items([(1, "ab " * 300)])
    tracemalloc.start()
    [(t, item, edits, start, end)] = D.find_copies(["ab " * 40_000], index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (t, item, edits, start, end) == (0, 0, 0, 0, 899) and peak < 500 << 20


def test_short_items_stand_as_whole_words():
    index = D.index_items([(1, "Hi, you"), (2, "42"), (3, "!?"), (4, "hi you"), (5, "you are long enough")])
    got = {(t, index.ids[i]): (e, a, b) for t, i, e, a, b in D.find_copies(["Say: hi you 42", "shi you", "", None, "424", "HI YOU"], index)}
    assert got == {(0, 1): (0, 4, 10), (0, 4): (0, 4, 10), (0, 2): (0, 11, 13), (5, 1): (0, 0, 6), (5, 4): (0, 0, 6)}
