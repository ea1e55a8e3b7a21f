import pytest
from pyspark.sql import functions as F

from tallyframe.llm import language_id as L
from tallyframe.llm.common import crc_mod, table

FOLDER = "/root/testdata/sf0.01"


def brute_phrases(text, sample):
    """Greedy phrases by substring search, segment by segment."""
    total = 0
    for at in range(0, len(text), L.SEGMENT):
        part, phrase, count = text[at : at + L.SEGMENT], "", 1
        for c in part:
            if phrase + c in sample:
                phrase += c
            else:
                count += 1
                phrase = c if c in sample else ""
        total += count
    return total


def test_phrases_equal_substring_search():
    samples = {"a": L.squeeze("the cat sat on the mat and the dog ate the cat " * 3), "b": L.squeeze("le chat est sur le tapis et le chien mange le chat " * 3)}
    model = L.build_model(samples)
    table_ = L.class_table(model)
    texts = ["the cat!! sat 42 on", "Le CHIEN est là", "q", "the cat sat on the mat " * 40, "zzz the"]
    phrases, letters = L.parse(texts, model, table_)
    for i, t in enumerate(texts):
        # As in the operator: leading separators go, the first of each later run stays, also at the end.
        squeezed = "".join(c if c.isalpha() else " " for c in t.lower())
        kept = "".join(c for j, c in enumerate(squeezed) if c != " " or (j and squeezed[j - 1] != " "))
        for k, name in enumerate(model.languages):
            unknown = "".join(c if c == " " or c in model.letters else "\x00" for c in kept)
            assert phrases[i, k] == brute_phrases(unknown, samples[name]), (t, name)
    assert letters.all()


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "hello there my friend", "en", 1), (2, None, "en", 2), (3, "", None, 3), (4, "123 !?", "fr", 4), (None, "bonjour mon ami", "fr", 5), (6, "hello there", "en", 6), (6, "hello there", "en", 7), (7, "ab" * 200_000, None, 8), (8, "漢字", None, 9), (9, "\U00020000", None, 1)],
        "doc_id long, text string, lang string, lang_pred int",
    )
    model = L.fit_language_model(docs)
    out = {(r.doc_id): r for r in L.identify_languages(docs, model).collect()}
    assert out[2].lang_pred == out[3].lang_pred == out[4].lang_pred == "und" and out[2].score == 0
    assert out[1].lang_pred == "en" and out[None].lang_pred == "fr"
    assert all(out[i].lang_pred in ("en", "fr") and 0 <= out[i].score <= 1 for i in (6, 7, 8, 9))
    empty = docs.where("false")
    assert L.identify_languages(empty, L.fit_language_model(empty)).count() == 0
    assert {r.lang_pred for r in L.identify_languages(docs, L.fit_language_model(empty)).collect()} == {"und"}
    only = L.identify_languages(docs.where("doc_id = 1"), L.fit_language_model(docs.where("lang = 'en'"))).first()
    assert (only.lang_pred, only.score) == ("en", 1.0)


def test_held_out_accuracy(spark):
    from tallyframe.llm.queries import op1_language_id

    docs = table(spark, FOLDER, "documents").select("doc_id", "lang")
    got = op1_language_id(spark, FOLDER).join(docs, "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97
    assert docs.select(crc_mod(F.lit(0), 4)).first()[0] == pytest.approx(__import__("zlib").crc32(b"0") % 4)


def test_scripts_of_any_size_keep_their_letters(spark):
    import random

    rng = random.Random(5)
    scripts = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "en": "abcdefghijklmnopqrstuvwxyz", "ko": "".join(map(chr, range(0xAC00, 0xAC00 + 600))), "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 900))), "zz": "".join(map(chr, range(0x20000, 0x20000 + 300)))}
    pools = {k: ["".join(rng.choices(v, k=5)) for _ in range(300)] for k, v in scripts.items()}
    text = lambda k: " ".join(rng.choices(pools[k], k=80))
    samples = {k: text(k) + " " + " ".join(pools[k]) for k in pools}
    model = L.build_model(samples)
    assert all(c in model.letters for v in samples.values() for c in v if c != " ")
    texts = [text(k) for k in pools]
    phrases, _ = L.parse(texts, model, L.class_table(model))
    for i, t in enumerate(texts):
        for k, name in enumerate(model.languages):
            assert phrases[i, k] == brute_phrases(t, samples[name][: L.SAMPLE_CHARS]), (i, name)
    docs = spark.createDataFrame([(i, text(k), k) for i in range(40) for k in pools], "doc_id long, text string, lang string")
    judged = L.language_udf(docs, L.fit_language_model(docs))(F.col("text"))
    rows = docs.select("lang", judged.alias("found")).collect()
    assert all(r.found.lang_pred == r.lang and r.found.score > 0.02 for r in rows)
