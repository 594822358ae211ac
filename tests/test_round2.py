import html
from html.entities import html5

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import agreement, policy, tfidf, vectors
from supportlake.sources import sinks, tables


def test_entities_as_the_standard_library_decodes_them(spark):
    texts = ["caf&eacute; &rsquo; &#8217; &pound;5 &#x2019; &amp;lt; &amp;amp;eacute;", "&ampx &notit; &copy2 &nosuch; & alone &", "&#0; &#128; &#x9F; &#xD800; &#1114112; &#xFFFE; &#13;",
             "&#x1F642;&#128512;", "&#99999999999999999999;", "&#xfffffffffffff;", "a&b;c&&lt;&&gt", "", "no reference", None, "&#;&#x;&;", "x&#65", "&#007F;", "&#x00041;", "&#1;&#11;&#127;&#31;"]
    texts += [" ".join(f"&{n}" for n in sorted(html5)[i:i + 400]) for i in range(0, len(html5), 400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.decode_entities("t").alias("d")).collect()
    for r in rows:
        assert r["d"] == (None if texts[r["i"]] is None else html.unescape(texts[r["i"]])), texts[r["i"]]


def test_threshold_is_on_the_unrounded_similarity(spark):
    top = spark.createDataFrame([(1, 1, 0.5499996, 1, 549999600), (2, 1, 0.55, 1, 550000000)], "query_id long, doc_id long, similarity double, rank int, _skey long")
    assert [r["query_id"] for r in vectors.apply_threshold(top, 0.55).collect()] == [2]


@pytest.mark.parametrize("exclude", [False, True])
def test_distinct_topk_equals_exact_topk(spark, exclude):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(0, 3, 2).astype(float).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    args = dict(query_id="id", query_vec="v", doc_id="id", doc_vec="v", exclude_self=exclude)
    key = lambda d: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["similarity"], 9)) for r in d.collect())
    assert key(vectors.distinct_topk(df, df, 3, **args)) == key(vectors.exact_topk(df, df, 3, **args))


def test_a_message_without_classification_escalates(spark):
    d = spark.range(1).select(policy.escalation_decision(F.lit("hello"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.array(F.lit(0.9))).alias("d")).first()["d"]
    assert d["action"] == "ESCALATE" and d["reason"]


def test_bigrams_of_long_and_short_texts(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "alpha"), (3, "alpha beta"), (4, " ".join(["word"] * 20000))], "i int, t string").select("i", tfidf.terms(F.col("t")).alias("x")).collect()
    got = {r["i"]: r["x"] for r in rows}
    assert got[0] == got[1] == [] and got[2] == ["alpha"] and got[3] == ["alpha", "beta", "alpha beta"] and len(got[4]) == 39999


def test_agreement_from_counts(spark):
    rng = np.random.default_rng(1)
    h, m = rng.integers(2, 11, 60) / 2, rng.integers(2, 11, 60) / 2
    row = agreement.agreement(spark.createDataFrame([("d", float(a), float(b)) for a, b in zip(h, m)] + [("d", None, 1.0)], "dimension string, h double, l double")).first()
    assert row["sample_size"] == 60 and float(row["pearson_r"]) == pytest.approx(np.corrcoef(h, m)[0, 1], abs=6e-4)
    assert row["mean_absolute_error"] == pytest.approx(np.abs(h - m).mean(), abs=1e-4)


def test_sinks_and_csv_ids(spark, tmp_path):
    big = 2**53 + 1
    (tmp_path / "t.csv").write_text("tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
                                    f'{big},a,True,x,"say ""hi"", é",,{big}.0\n3,b,False,y,plain,,\n')
    df = tables.read_raw_tweets_csv(spark, str(tmp_path / "t.csv"))
    assert [(r["tweet_id"], r["text"], r["in_response_to_tweet_id"]) for r in df.orderBy("author_id").collect()] == [(big, 'say "hi", é', big), (3, "plain", None)]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(str, spark.read.schema(df.schema).json(str(tmp_path / "j")).collect())) == sorted(map(str, df.collect()))
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).count() == 2
    sinks.save_index(df, str(tmp_path / "i"))
    assert sinks.load_index(spark, str(tmp_path / "i")).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.load_index(spark, str(tmp_path / "none"))


def test_a_restarted_triage_job_adds_no_rows(spark, sf_small, tmp_path):
    from supportlake.streaming import jobs

    first = jobs.triage_stream(spark, sf_small, str(tmp_path / "job")).collect()
    again = jobs.triage_stream(spark, sf_small, str(tmp_path / "job")).collect()
    assert len(first) and sorted(map(str, first)) == sorted(map(str, again)) and len({r["id"] for r in first}) == len(first)


def test_three_systems_are_compared(spark, sf_small):
    import __spark_entry__ as entry

    rows = entry.queries()["system_comparison"](spark, sf_small).collect()
    assert {r["system"] for r in rows} == {"majority_baseline", "tfidf_logistic_regression", "support_agent"}
