"""Generator slot, audit examples, a message's own pairs, certificate of a fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.operators import judge, replies, tfidf, vectors


def test_a_failing_prompt_costs_no_other_its_answer(spark):
    def make():
        def generate(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [None if not p else f" {p.upper()} " for p in prompts]

        return generate

    rows = [(0, "one", "t0"), (1, "bad", " t1 "), (2, "two", "t2"), (3, None, "t3"), (4, "", None)]
    df = spark.createDataFrame(rows, "id int, prompt string, template_reply string").coalesce(1)
    got = {r["id"]: (r["reply"], r["reply_source"], r["reply_error"]) for r in replies.generate_with(df, make).collect()}
    assert got == {0: ("ONE", "generator", None), 1: ("t1", "template", "RuntimeError"), 2: ("TWO", "generator", None),
                   3: ("t3", "template", "no answer"), 4: ("", "template", "no answer")}
    short = replies.generate_with(df, lambda: lambda prompts: prompts[:1]).collect()             # too few answers to a batch
    assert {r["reply_source"] for r in short if r["prompt"]} == {"generator"}
    assert replies.generate_with(df.limit(0), make).collect() == []


def test_audit_examples_are_the_worst_rows(spark):
    score = F.struct(*[((F.col("id") * (i + 3)) % 7).cast("double").alias(d) for i, d in enumerate(judge.SCORE_FIELDS)])
    a = judge.audit_with_examples(spark.range(40).withColumn("score", score), "id", 3).collect()
    assert {r["dimension"] for r in a} == {*fixed.JUDGE_DIMENSIONS, "average_score"}
    for r in a:
        i = judge.SCORE_FIELDS.index(r["dimension"])
        want = sorted(((k * (i + 3)) % 7, k) for k in range(40))[:3]
        assert [(e["score"], e["id"]) for e in r["examples"]] == want and [e["rank"] for e in r["examples"]] == [1, 2, 3]


def test_own_documents_are_left_out(spark):
    rng = np.random.default_rng(0)
    owners = [int(x) for x in rng.integers(0, 12, 150)] + [3] * 60              # one owner of many documents
    vec = {o: rng.integers(0, 3, 2).astype(float).tolist() for o in range(12)}
    docs = spark.createDataFrame([(i, o, vec[o]) for i, o in enumerate(owners)] + [(900, None, [1.0, 1.0])], "doc_id long, owner long, embedding array<double>")
    asked = spark.createDataFrame([(o, vec[o]) for o in range(12)] + [(77, [1.0, 1.0])], "query_id long, embedding array<double>")
    k = 4
    got = vectors.distinct_topk(asked, docs, k, query_owner="query_id", doc_owner="owner")
    every = vectors.exact_topk(asked, docs, 300).join(docs.select("doc_id", "owner"), "doc_id").collect()
    want = {}
    for r in sorted(every, key=lambda r: r["rank"]):
        if r["owner"] != r["query_id"]:
            want.setdefault(r["query_id"], []).append(r["doc_id"])
    for q, ids in want.items():
        assert [r["doc_id"] for r in sorted(got.where(F.col("query_id") == q).collect(), key=lambda r: r["rank"])] == ids[:k], q


def test_gradient_is_zero_at_the_minimum_only(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(1)
    rows = [(x.tolist(), int(x[0] + rng.normal() > 0) + (x[1] > 1), float(rng.integers(1, 4))) for x in rng.standard_normal((200, 3))]
    df = spark.createDataFrame([(x, float(y), w) for x, y, w in rows], "features array<double>, label double, class_weight double")
    lr = LogisticRegression(featuresCol="v", weightCol="class_weight", regParam=0.05, standardization=False, maxIter=500, tol=1e-12, family="multinomial")
    m = lr.fit(df.withColumn("v", array_to_vector("features")))
    coef, own = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    g = tfidf.loss_gradient(df, coef.tolist(), own.tolist(), 0.05).collect()
    assert len(g) == 3 and all(abs(r["coef_gradient"]) < 1e-6 and abs(r["intercept_gradient"]) < 1e-6 for r in g)
    assert sum(r["loss_share"] for r in g) + 0.025 * (coef ** 2).sum() == pytest.approx(m.summary.objectiveHistory[-1], abs=1e-9)
    off = tfidf.loss_gradient(df, (coef + 0.1).tolist(), [0.0, 0.0, 0.0], 0.05).collect()
    assert max(r["coef_gradient"] for r in off) > 1e-3
