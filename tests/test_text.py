"""Cleaning, language test and link extraction (the reference's unit cases
restated on one-row DataFrames)."""

from pyspark.sql import functions as F

from supportlake.functions import text as tx


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("x")).first()["x"]


def test_clean_text_removes_handles_and_entities(spark):
    out = one(spark, tx.clean_text(F.col("t")), "@AmazonHelp &amp; @115820 Where is my package??? &gt;&lt;")
    assert "@AmazonHelp" not in out and "@115820" not in out
    assert "&" in out and ">" in out
    assert out == "& Where is my package??? ><"


def test_signature_stripped_url_kept(spark):
    out = one(spark, tx.clean_text(F.col("t"), True), "@115820 Please visit https://t.co/xyz for tracking info. ^TN")
    assert "^TN" not in out
    assert "https://t.co/xyz" in out


def test_signature_only_at_end(spark):
    assert one(spark, tx.clean_text(F.col("t"), True), "ok ^KH https://a.example/track") == "ok ^KH https://a.example/track"
    # a 1-4 letter last path segment looks like a signature and is cut (as re.sub does)
    assert one(spark, tx.clean_text(F.col("t"), True), "ok ^KH https://a.example/x") == "ok ^KH https://a.example"
    # a trailing -word of <= 4 letters is cut even inside a sentence
    assert one(spark, tx.clean_text(F.col("t"), True), "thanks for the sign-in") == "thanks for the sign"


def test_whitespace_is_python_unicode_whitespace(spark):
    assert one(spark, tx.clean_text(F.col("t")), "a  b \t\n c ") == "a b c"


def test_is_english(spark):
    assert one(spark, tx.is_english(F.col("t")), "Where is my order? It was supposed to arrive today.") is True
    assert one(spark, tx.is_english(F.col("t")), "こんにちは、アマゾン公式です。") is False
    assert one(spark, tx.is_english(F.col("t")), "Guten Tag, wie kann ich Ihnen helfen?") is False
    assert one(spark, tx.is_english(F.col("t")), None) is False


def test_extract_links(spark):
    links = one(spark, tx.extract_links(F.col("t")), "Please reach out to us here: https://amazon.com/help or https://t.co/test")
    assert links == ["https://amazon.com/help", "https://t.co/test"]
    # keeps a trailing dot, stops at a query string
    assert one(spark, tx.extract_links(F.col("t")), "see https://a.example/track. and https://b.example/r?x=1") == [
        "https://a.example/track.", "https://b.example/r"]


def test_fmt2_rounds_like_python(spark):
    df = spark.createDataFrame([(0.125,), (0.145,), (0.655,)], "x double")
    got = [r[0] for r in df.select(tx.fmt2("x")).collect()]
    assert got == [f"{v:.2f}" for v in (0.125, 0.145, 0.655)]
