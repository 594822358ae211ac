import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from supportlake.operators import tfidf
from supportlake.session import cut_lineage

DOCS = [(1, "red fox red"), (2, "red hen"), (3, ""), (4, None), (5, "the fox and the hen")]


def test_vectors_by_hand(spark):
    df = spark.createDataFrame(DOCS, "i int, t string")
    vocab = tfidf.fit_vocabulary(df, "t", 100)
    assert vocab.terms[0] == "red" and "the" not in vocab.terms        # Spark's own stop words
    idf = {t: math.log(6 / (1 + sum(t in d for d in (["red", "fox", "red fox", "fox red"], ["red", "hen", "red hen"],
                                                     ["fox", "hen", "fox hen"])))) + 1 for t in vocab.terms}
    assert dict(zip(vocab.terms, vocab.idf)) == pytest.approx(idf)
    got = {r["i"]: r["_features"] for r in vocab.features(df, "t").collect()}
    raw = {"red": (1 + math.log(2)) * idf["red"], "fox": idf["fox"], "red fox": idf["red fox"], "fox red": idf["fox red"]}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert {vocab.terms[i]: v for i, v in zip(got[1].indices, got[1].values)} == pytest.approx({t: x / norm for t, x in raw.items()})
    assert got[3].numNonzeros() == got[4].numNonzeros() == 0


def test_rows_and_vectors_agree_with_a_bounded_vocabulary(spark):
    df = spark.createDataFrame(DOCS, "i int, t string")
    rows = {(r["i"], r["term"]): r["weight"] for r in tfidf.tfidf_weights(df, ["i"], "t", max_features=4).collect()}
    vocab = tfidf.fit_vocabulary(df, "t", 4)
    vecs = {(r["i"], vocab.terms[j]): v for r in vocab.features(df, "t").collect()
            for j, v in zip(r["_features"].indices, r["_features"].values)}
    assert rows == pytest.approx(vecs)
    every = tfidf.tfidf_weights(df, ["i"], "t")
    assert every.select("term").distinct().count() == 7


def test_heads_learn_are_binomial_for_two_labels_and_survive_saving(spark, tmp_path):
    rows = [(i, f"{'refund money' if i % 2 else 'parcel late'} word{i % 3}", "AB"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, t string, y string")
    model = tfidf.fit_text_classifier(df, "t", "y")
    assert model.head.stages[1].coefficientMatrix.numRows == 1
    model.save(spark, str(tmp_path / "m"))
    again = tfidf.TextClassifier.load(spark, str(tmp_path / "m"))
    for m in (model, again):
        out = tfidf.predict_text_classifier(m, df, "t")
        assert out.where(F.col("y") == F.col("pred_label")).count() == 40
    assert again.vocabulary == model.vocabulary


def _weights_by_hand(rows, stopwords, n):
    bags = {}
    for i, text in rows:
        words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in stopwords]
        bags.setdefault(i, Counter()).update(words + [f"{x} {y}" for x, y in zip(words, words[1:])])
    total, df = Counter(), Counter()
    for bag in bags.values():
        total.update(bag)
        df.update(bag.keys())
    order = sorted(total, key=lambda t: (-total[t], t))[:n]
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in order}
    out = {}
    for i, bag in bags.items():
        raw = {t: (1 + math.log(bag[t])) * idf[t] for t in order if t in bag}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.update({(i, t): (bag[t], df[t], x / norm) for t, x in raw.items()})
    return out


@pytest.mark.parametrize("n", [1, 7, 12, 40, 10_000])
def test_bounded_weights_are_those_of_all_terms_counted(spark, n):
    rng = random.Random(n)
    vocabulary = ["aa", "bb", "cc", "dd", "ee", "the", "x", "ünï", "zz_1"]
    rows = [(rng.choice([None, *range(12)]), " ".join(rng.choices(vocabulary, k=rng.randrange(9))) or None) for _ in range(60)]
    df = spark.createDataFrame(rows, "i int, t string")             # ids repeat and lack, counts tie
    got = {(r["i"], r["term"]): (r["tf"], r["df"], r["weight"]) for r in tfidf.tfidf_weights(df, ["i"], "t", ["the"], n).collect()}
    want = _weights_by_hand(rows, {"the"}, n)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_bounded_weights_group_no_strings_by_document(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"common word rare{i} other{i}") for i in range(50)], "i int, t string")
    written = []
    monkeypatch.setattr(tfidf, "cut_lineage", lambda d: written.append(cut_lineage(d)) or written[-1])
    assert tfidf.tfidf_weights(df, ["i"], "t", ["the"], 3).count() == 150
    per_document = [w for w in written if "i" in w.columns]
    assert per_document and all(t != "string" for w in per_document for _, t in w.dtypes)
    assert per_document[-1].count() == 150                          # only the kept terms' counts


def test_terms_are_the_same_for_stop_words_of_any_letters(spark):
    df = spark.createDataFrame([("The don't-know_it, (ÀB) x 1 22 he'll İzmir 𝒜𝒜 the",), ("",), (None,)], "t string")
    plain, odd = (df.select(tfidf.terms(F.col("t"), stop)).collect() for stop in (["the"], ["the", "o'clock"]))
    assert plain == odd
    assert df.select(tfidf.terms(F.col("t"), ["don't"], 1)).first()[0][:2] == ["the", "know_it"]
