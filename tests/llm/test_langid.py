"""Language identification: its parts by themselves, held-out accuracy, odd tables."""

import numpy as np
from pyspark.sql import functions as F

from bicspark.llm import langid
from bicspark.llm.common import ship_code

SCHEMA = "doc_id long, text string, lang string, source string"


def plain_subwords(text):
    """How often each subword occurs, by slicing marked words."""
    found = {}
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words, word = [*words, word], ""
    for w in words:
        marked = "\0" + w + "\0"
        for n in langid.LENGTHS:
            for k in range(len(marked) - n + 1):
                if marked[k : k + n].strip("\0"):
                    found[marked[k : k + n]] = found.get(marked[k : k + n], 0) + 1
    return found


def bucket(subword):
    codes = np.array([ord(c) if c != "\0" else 0 for c in subword], dtype=np.uint32)
    mixed = np.zeros(1, dtype=np.uint32)
    for code, multiplier in zip(codes, langid._MULTIPLIERS):
        mixed = (mixed ^ code) * multiplier
        mixed ^= mixed >> np.uint32(15)
    return int((mixed * np.uint32(0x2C1B3C6D) + np.uint32(len(codes) - 1))[0] >> np.uint32(32 - langid.BITS))


def test_subwords_are_those_of_plain_words():
    for text in ("", "A", "ab c", "  Déjà-vu, été! ", "x1y2z3", "İstanbul \U00010400\U00010428 漢字", "the cat, the dog " * 50):
        expected = {}
        for subword, n in plain_subwords(text).items():
            expected[bucket(subword)] = expected.get(bucket(subword), 0) + n
        found, counts = langid.counted(text)
        assert dict(zip(found.tolist(), counts.tolist())) == expected


def test_pieces_change_nothing(monkeypatch):
    texts = ["a bc def " * 40, None, "", "12 34", "x" * 300, "é à " * 30]
    rows = np.random.default_rng(1).standard_normal((langid.BUCKETS, 3))
    whole, spelt = langid.totals(texts, rows)
    monkeypatch.setattr(langid, "PIECE", 500)  # longer than the longest word
    cut, spelt_too = langid.totals(texts, rows)
    assert np.allclose(whole, cut) and spelt.tolist() == spelt_too.tolist() == [True, False, False, False, True, True]


def test_rejection_is_calibrated():
    logits = np.array([[4.0, 0.0]] * 90 + [[0.1, 0.0]] * 10)
    target = np.array([0] * 90 + [0, 1] * 5)
    temperature, least = langid.calibrate(logits, target)
    sure = langid.softmax(logits / temperature).max(axis=1)
    assert (sure[:90] >= least).all() and (sure[90:] < least).all()
    assert langid.calibrate(np.zeros((0, 2)), np.zeros(0, dtype=int)) == (1.0, 0.0)


def test_held_out_accuracy_and_no_peeking(spark):
    ship_code(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held_out = [r for r in found if r["held_out"]]
    right = [r["lang"] == r["lang_pred"] for r in held_out]
    assert len(found) == docs.count() and len(held_out) > 200 and np.mean(right) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found) and np.mean([r["rejected"] for r in found]) < 0.1
    # Languages of held-out documents, and the other columns, change nothing.
    other = docs.withColumns({
        "lang": F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang")), "source": F.lit("s")
    })
    again = langid.languages(other).collect()
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in again} == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}


def test_odd_documents(spark):
    ship_code(spark)
    rows = [(2**60 + k, f"der hund und die katze {k}", "de", "s") for k in range(40)]
    rows += [(2**60 + 100 + k, f"the dog and the cat {k}", "en", "s") for k in range(40)]
    rows += [(None, "und die", "de", None), (1, None, "de", "s"), (2, "", "de", "s"), (3, "123 !?", "en", "s"), (4, "the dog " * 60_000, None, "s")]
    rows += [(5, "the cat", "en", "s")] * 3
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("r", "score", "buckets", "counts", "lang_pred", "place")})
    found = langid.languages(docs).collect()
    assert len(found) == len(rows) and sorted(r["doc_id"] or 0 for r in found) == sorted(r[0] or 0 for r in rows)
    by_id = {r["doc_id"]: r for r in found}
    for key in (1, 2, 3):
        assert by_id[key]["lang_pred"] == "und" and by_id[key]["score"] == 0 and by_id[key]["rejected"]
    assert by_id[4]["lang_pred"] == by_id[5]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "de" and not by_id[None]["held_out"]
    for none in (docs.where("false"), docs.withColumn("lang", F.lit(None).cast("string"))):
        assert {r["lang_pred"] for r in langid.languages(none).collect()} <= {"und"}
