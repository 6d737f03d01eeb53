from __future__ import annotations

import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from lorequarry.llm import langid, toxicity
from lorequarry.llm.ngrams import Grams


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(200).select("id", langid.fold(F.col("id"), 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)


def test_language_held_out_accuracy(spark):
    from lorequarry.llm.queries import op5_langid

    sf = "/root/testdata/sf0.01"
    got = op5_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["score"] >= langid.REJECT_BELOW for r in got]) >= 0.98


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog with that thing", "en") for i in range(20)] + [(i, "der hund und die katze mit dem ding", "de") for i in range(20, 40)] + [(i, "le chien et la souris dans une maison", "fr") for i in range(40, 60)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "fr"] and model.families == ["germanic", "romance"] and model.pairs == [("germanic", "de", "en")]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "the dog and the cat"), (4, "the dog and the cat"), (None, "der hund"), (6, "日本語のテキスト")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()]
    assert [g[1] for g in got[:3]] == ["und"] * 3 and got[3] == got[4] and got[3][1] == "en" and got[5][1] == "de"
    assert got[6][2] < langid.REJECT_BELOW
    kept = langid.keep_identified(odd.withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.collect()} == {4, None}
    assert langid.predict(odd.limit(0), model).count() == 0
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'en'"))
    assert langid.predict(odd, one).where("doc_id = 4").first()["lang_pred"] == "en"


def test_whole_text_counts(spark):
    """What stands at the end of a very long text is seen."""
    texts = ["aaa " * 200_000 + "stupid", "stupid"]
    last = [set(x.tolist()) for x in toxicity.present(texts)]
    assert last[1] - last[0] <= {x for x in last[1]} and len(last[1] & last[0]) >= 8


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    alone = list(toxicity.present(["some words"]))[0]
    among = list(toxicity.present(["x", "some words", "", "yy zz"]))
    assert np.array_equal(alone, among[1]) and len(among) == 4
    g = Grams(["ab", "cd"], 4)
    assert len(g.codes(2)) == g.total


def grams(text, n, bits):
    """n-grams of letters of a text between spaces, hashed, in plain Python."""
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()
    padded, out = " " + " ".join(words) + " " * (n + 1), []
    for i in range(len(" ".join(words)) + 1 if words else 0):
        code = ord(padded[i])
        for c in padded[i + 1 : i + n]:
            code = (code * 0x85EBCA6B ^ ord(c)) & 0xFFFFFFFF
        code = code * ((0x9E3779B1 + 0x61C88646 * n | 1) & 0xFFFFFFFF) & 0xFFFFFFFF
        code = (code ^ code >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        out.append(code >> 32 - bits)
    return out


TEXTS = ["the cat and the dog", "der Hund, und die Katze 12!", "“Zitat” — naïve Größe", "日本語のテキスト and more", "हिन्दी भाषा", "a", "", "x-y z's", "ﬁ ŉ İstanbul"]


def test_scores_match_plain_python(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog with that thing", "en") for i in range(20)] + [(i, "der hund und die katze mit dem ding", "de") for i in range(20, 40)] + [(i, "le chien et la souris dans une maison", "fr") for i in range(40, 60)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    lang, score = langid.classify(model, TEXTS)
    sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
    for text, got, s in zip(TEXTS, lang, score, strict=True):
        if not text:
            assert (got, s) == ("und", 0)
            continue
        idx = [model.column[h] for n in langid.LENGTHS for h in grams(text, n, langid.BITS)]
        margin = [sum(float(t[i]) for i in idx) / len(idx) + b for t, b in zip(model.tables, model.bias, strict=True)]
        fam = int(np.argmax(margin[:2]))
        p = sure((margin[fam] - margin[1 - fam]) / 2)
        want = "fr" if model.families[fam] == "romance" else "de" if margin[2] >= 0 else "en"
        if model.families[fam] == "germanic":
            p *= sure(abs(margin[2]))
        known = [model.known[model.column[h]] for h in grams(text, langid.KNOWN_LENGTH, langid.BITS)]
        assert got == want and abs(s - p * np.mean(known)) < 1e-5


def test_every_language_is_learned(spark):
    rows = [(i, f"{'abcdefghijklmnop'[i % 16]}{'qrstuvwxyz'[i // 16 % 10]} " * 8 + f"word{i}", f"l{i:03d}") for i in range(450)] + [(1000 + i, "zz yy " * 9, "l000") for i in range(50)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=100)
    assert len(model.languages) == 450


def test_rows_without_an_id_are_in_no_fold(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    got = [r["h"] for r in df.select(langid.held_out(F.col("doc_id"), 4, zlib.crc32(b"1") % 4).alias("h")).collect()]
    assert got[0] is True and got[2] is False


def test_toxic_features_match_plain_python():
    found = list(toxicity.present(TEXTS))
    for text, idx in zip(TEXTS, found, strict=True):
        assert idx.tolist() == sorted({h for n in toxicity.LENGTHS for h in grams(text, n, toxicity.BITS)})
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.standard_normal(1 << toxicity.BITS).astype(np.float32), 0.25)
    want = [1 / (1 + np.exp(-(sum(float(model.weights[i]) for i in idx) + 0.25))) for idx in found]
    assert np.allclose(toxicity.scores(model, TEXTS), want, atol=1e-6)


def test_logistic_finds_the_optimum():
    rng = np.random.default_rng(2)
    scale = rng.uniform(0.2, 2, 50)
    rows = [np.flatnonzero(rng.random(50) < 0.2) for _ in range(300)]
    y = np.where([len(set(r) & {1, 2, 3, 4}) > 0 or rng.random() < 0.2 for r in rows], 1.0, -1.0)
    w, b = toxicity.logistic(rows, scale, y, cost=0.5, epochs=400)
    grad, gb = w.copy(), b
    for r, t in zip(rows, y, strict=True):
        p = 0.5 * t / (1 + np.exp(t * (w[r] @ scale[r] + b)))
        grad[r] -= p * scale[r]
        gb -= p
    assert np.abs(grad).max() < 0.02 and abs(gb) < 0.02


def test_toxicity_clashing_names_and_long_texts(spark):
    rows = [(i, "kind words of praise " * 5 + ("you stupid idiot" if i % 3 == 0 else "my dear friend"), int(i % 3 == 0), 0, 0.5, 7) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, f int, score double, h int")
    labels = df.select("doc_id", F.col("label").alias("toxic"), F.lit("x").alias("text"), F.lit(1).alias("label"))
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all((s >= 0.5) == (i % 3 == 0) for i, s in got.items())
    long = spark.createDataFrame([(1, "x" * 5_000_000), (2, "my dear friend " * 300_000 + "you stupid idiot")], "doc_id long, text string")
    assert toxicity.score(long, model).count() == 2
    assert langid.predict(long, langid.fit(spark.createDataFrame([(1, "my dear friend", "en"), (2, "lieber freund", "de")], "doc_id long, text string, lang string"))).where("doc_id = 2").first()["lang_pred"] == "en"


def test_toxicity_held_out(spark, tmp_path):
    import random

    r = random.Random(1)
    syllables = ["the", "ing", "er", "on", "an", "re", "ti", "es", "or", "st"]
    bad = ["idiot", "moron", "stupid"]
    rows = []
    for i in range(1500):
        w = ["".join(r.choices(syllables, k=r.randrange(1, 4))) for _ in range(60)]
        toxic = i % 6 == 0
        for _ in range(2 if toxic else 0):
            w[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), toxicity.training_rows(df.select("doc_id", "toxic")))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(df, model).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, _, t in held]) >= 0.97


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good"), (2, None), (3, ""), (3, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and len({r["score"] for r in got}) == 1 and got[0]["score"] < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).bias < 0
