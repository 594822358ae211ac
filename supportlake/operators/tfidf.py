"""TF-IDF features (uni+bigrams, sublinear tf, smooth idf, L2 norm) and the
logistic-regression heads trained on them.

``tfidf_weights`` gives the weights as rows (term counts -> document frequency
-> vocabulary -> weights -> per-document norm), every step a partial/final
aggregation or a narrow map.  The ML heads need vectors: their vocabulary comes
from one aggregation over the terms, and everything after it is row-wise (Spark
ML transformers and Column functions), with balanced class weights.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake import fixed
from supportlake.functions import text as tx
from supportlake.session import cut_lineage

# maximal runs of >= 2 word characters (Python's \b\w\w+\b); the explicit
# class reads the same in Java and RE2
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
MAX_STEPS, TOLERANCE = 1000, 1e-12     # of the solver: heads are fitted until they stand still
BROADCAST_TERMS = 200_000     # a vocabulary stated to be no larger is broadcast


def english_stopwords() -> list[str]:
    """Spark's own English list (the default of the features here; the short
    list in ``fixed`` belongs to the language test)."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def terms(text: Column, stopwords: Sequence[str] = fixed.ENGLISH_STOPWORDS, ngram_max: int = 2) -> Column:
    """ARRAY<STRING>: tokens without stop words, then their bigrams."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if all(re.fullmatch(r"\w+", x, re.ASCII) for x in stopwords):
        # whole tokens only: cut at everything else, which costs a third of a match with lookaheads
        toks = F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda t: (F.length(t) >= 2) & ~t.isin(list(stopwords)))
    else:
        # a stop word like "don't" goes beyond a token: a token starts where no
        # word character precedes it, and the negative lookahead rejects the stop word
        w = r"[\p{L}\p{N}_]"
        stop_alt = "|".join(sorted((re.escape(x) for x in stopwords), key=len, reverse=True))
        toks = F.regexp_extract_all(low, F.lit(f"(?<!{w})(?!(?:{stop_alt})(?!{w})){TOKEN_PATTERN}"), 0)
    if ngram_max < 2:
        return toks
    # neighbours are zipped: one pass, whatever the document's length (the
    # longer side's last element has no partner and is dropped)
    after = F.slice(toks, F.lit(2), F.greatest(F.size(toks), F.lit(1)))
    bigrams = F.filter(F.zip_with(toks, after, lambda x, y: F.concat(x, F.lit(" "), y)), lambda b: b.isNotNull())
    return F.concat(toks, bigrams)


def smooth_idf(df: Column, n_docs: Column) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def sublinear(tf: Column) -> Column:
    return 1.0 + F.log(tf)


def frequent_term_counts(docs: DataFrame, id_cols: Sequence[str], text_col: str, stopwords: Sequence[str],
                         max_features: int) -> tuple[DataFrame, DataFrame]:
    """(id..., _term, tf) of the ``max_features`` most frequent terms (ties by
    term), and their names: (_term, term).

    A pair is never more frequent than either of its words, so a pair with a
    word below the ``max_features``-th word's count cannot be among the terms.
    The words that remain get numbers; everything later is grouped and joined
    by numbers, never by strings per document."""
    ids = list(id_cols)
    words = cut_lineage(docs.select(F.explode(terms(F.col(text_col), stopwords, 1)).alias("_word")).groupBy("_word").agg(
        F.count(F.lit(1)).alias("total")))
    top = words.orderBy(F.desc("total")).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).first()
    least = top["least"] if top["n"] == max_features else 1
    known = cut_lineage(words.where(F.col("total") >= least).withColumn("_first", F.monotonically_increasing_id()))
    name = F.broadcast(known) if known.count() <= BROADCAST_TERMS else known
    after = name.select(F.col("_word").alias("_next"), F.col("_first").alias("_second"))

    # a row per occurrence of a known word, with the word after it
    toks = tx.materialize(docs.select(*ids, text_col), _toks=terms(F.col(text_col), stopwords, 1))
    rest = F.slice("_toks", F.lit(2), F.greatest(F.size("_toks"), F.lit(1)))
    rows = toks.select(*ids, F.inline(F.arrays_zip("_toks", rest)).alias("_word", "_next"))
    rows = cut_lineage(rows.join(name.drop("total"), "_word").join(after, "_next", "left").select(*ids, "_first", "_second"))

    pairs = rows.where("_second IS NOT NULL").groupBy("_first", "_second").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= least)
    pairs = pairs.join(name.drop("total"), "_first").join(after, "_second").select(
        F.concat("_word", F.lit(" "), "_next").alias("term"), "total", "_first", "_second")
    both = known.select(F.col("_word").alias("term"), "total", "_first", F.lit(None).cast("long").alias("_second")).unionByName(pairs)
    # top-N by corpus frequency: TakeOrderedAndProject keeps N rows per task
    both = both.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    vocab = cut_lineage(both.withColumn("_term", F.monotonically_increasing_id()))

    single = vocab.where("_second IS NULL").select("_first", F.col("_term").alias("_t1"))
    double = vocab.where("_second IS NOT NULL").select("_first", "_second", F.col("_term").alias("_t2"))
    names = vocab.select("_term", "term")
    if max_features <= BROADCAST_TERMS:
        single, double, names = F.broadcast(single), F.broadcast(double), F.broadcast(names)
    rows = rows.join(single, "_first", "left").join(double, ["_first", "_second"], "left")
    found = rows.select(*ids, F.explode(F.array("_t1", "_t2")).alias("_term")).where("_term IS NOT NULL")
    return cut_lineage(found.groupBy(*ids, "_term").agg(F.count(F.lit(1)).alias("tf"))), names


def tfidf_weights(docs: DataFrame, id_cols: Sequence[str], text_col: str, stopwords: Sequence[str] | None = None,
                  max_features: int | None = None) -> DataFrame:
    """(id..., term, tf, df, idf, weight) of the vocabulary's terms: all terms,
    or the ``max_features`` most frequent (ties by term)."""
    ids = list(id_cols)
    stopwords = english_stopwords() if stopwords is None else stopwords
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs")).withColumn("_one", F.lit(1))
    names = None
    if max_features is None:
        tf = docs.select(*ids, F.explode(terms(F.col(text_col), stopwords)).alias("_term")).groupBy(*ids, "_term").agg(
            F.count(F.lit(1)).alias("tf"))
        # tf feeds both the document counts and the weights: write it once
        # instead of tokenising the corpus twice
        tf = cut_lineage(tf)
    else:
        tf, names = frequent_term_counts(docs, ids, text_col, stopwords, max_features)
    vocab = tf.groupBy("_term").agg(F.count(F.lit(1)).alias("df")).withColumn("_one", F.lit(1)).join(F.broadcast(n_docs), "_one")
    vocab = vocab.select("_term", "df", smooth_idf(F.col("df"), F.col("n_docs")).alias("idf"))
    if max_features is not None and max_features <= BROADCAST_TERMS:
        vocab = F.broadcast(vocab)
    w = tf.join(vocab, "_term").withColumn("raw", sublinear(F.col("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*ids)))
    w = w.select(*ids, "_term", "tf", "df", "idf", (F.col("raw") / norm).alias("weight"))
    term = w.withColumnRenamed("_term", "term") if names is None else w.join(names, "_term")
    return term.select(*ids, "term", "tf", "df", "idf", "weight")


def balanced_weights(df: DataFrame, label_col: str, out: str = "class_weight") -> DataFrame:
    """n / (k * count(class)) per row, as scikit-learn's 'balanced'."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c"))
    tot = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k")).withColumn("_one", F.lit(1))
    cw = counts.withColumn("_one", F.lit(1)).join(tot, "_one").select(
        label_col, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias(out))
    return df.join(F.broadcast(cw), label_col)


_RAW_VECTOR = "v struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def vector_fields(vector: Column) -> Column:
    """struct(type, size, indices, values) of an ML vector."""
    return F.from_json(F.to_json(F.struct(vector.alias("v"))), _RAW_VECTOR)["v"]


def _sublinear_vector(counts: Column) -> Column:
    """Sparse counts to sparse ``1 + ln(tf)``, in the JVM (Spark ML has no
    transformer for it; JSON carries a vector's fields both ways exactly)."""
    from pyspark.ml.linalg import VectorUDT

    raw = vector_fields(counts)
    new = F.struct(raw["type"].alias("type"), raw["size"].alias("size"), raw["indices"].alias("indices"),
                   F.transform(raw["values"], sublinear).alias("values"))
    return F.from_json(F.to_json(F.struct(new.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))["v"]


@dataclass(frozen=True)
class Vocabulary:
    """The terms of the features, most frequent first, and their idf.  Both are
    on the driver: ``max_features`` bounds them."""
    terms: list[str]
    idf: list[float]
    stopwords: list[str]

    def features(self, df: DataFrame, text_col: str, out: str = "_features") -> DataFrame:
        """``df`` with the unit TF-IDF vector of every text, row by row (a text
        without a known term has the zero vector)."""
        from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        if not self.terms:
            raise ValueError("no terms: the training texts are empty")
        counts = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_terms", outputCol="_tf")
        tf = counts.transform(df.withColumn("_terms", terms(F.col(text_col), self.stopwords)))
        tf = tf.withColumn("_tf", _sublinear_vector(F.col("_tf")))
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_tfidf").transform(tf)
        return Normalizer(inputCol="_tfidf", outputCol=out, p=2.0).transform(scaled).drop("_terms", "_tf", "_tfidf")


def fit_vocabulary(docs: DataFrame, text_col: str, max_features: int, stopwords: Sequence[str] | None = None) -> Vocabulary:
    """Counts and document counts of all terms in one aggregation, then the
    ``max_features`` most frequent (ties by term)."""
    stopwords = list(english_stopwords() if stopwords is None else stopwords)
    toks = docs.select(terms(F.col(text_col), stopwords).alias("t"))
    each = F.transform("t", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    once = F.transform(F.array_distinct("t"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    stats = toks.select(F.explode(F.concat(each, once)).alias("x")).groupBy("x.term").agg(
        F.sum("x.tf").alias("total"), F.sum("x.df").alias("df"))
    top = stats.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    rows = top.withColumn("idf", smooth_idf(F.col("df"), F.lit(docs.count()))).collect()
    rows.sort(key=lambda r: (-r["total"], r["term"]))
    return Vocabulary([r["term"] for r in rows], [r["idf"] for r in rows], stopwords)


@dataclass(frozen=True)
class TextClassifier:
    vocabulary: Vocabulary
    head: object                 # PipelineModel: label index, logistic regression

    @property
    def labels(self) -> list[str]:
        return self.head.stages[0].labels

    def save(self, spark, path: str) -> None:
        v = self.vocabulary
        spark.createDataFrame([(v.terms, v.idf, v.stopwords)], "terms array<string>, idf array<double>, stopwords array<string>"
                              ).write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.head.write().overwrite().save(f"{path}/head")

    @classmethod
    def load(cls, spark, path: str) -> TextClassifier:
        from pyspark.ml import PipelineModel

        v = spark.read.parquet(f"{path}/vocabulary").first()
        return cls(Vocabulary(list(v["terms"]), list(v["idf"]), list(v["stopwords"])), PipelineModel.load(f"{path}/head"))


def fit_text_classifier(train: DataFrame, text_col: str, label_col: str, reg_c: float = 1.0,
                        stopwords: Sequence[str] | None = None,
                        max_features: int = fixed.TFIDF_MAX_FEATURES) -> TextClassifier:
    """TF-IDF features and a class-balanced logistic regression: binomial for
    two labels, multinomial for more."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    vocabulary = fit_vocabulary(train, text_col, max_features, stopwords)
    data = cut_lineage(balanced_weights(vocabulary.features(train.select(text_col, label_col), text_col), label_col))
    n = data.count()
    stages = [
        StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc"),
        # Spark minimises the mean loss: regParam = 1 / (C * n) matches a
        # summed-loss objective with inverse strength C
        LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="class_weight",
                           regParam=1.0 / (reg_c * max(n, 1)), elasticNetParam=0.0, standardization=False,
                           maxIter=MAX_STEPS, tol=TOLERANCE, family="auto"),
    ]
    return TextClassifier(vocabulary, Pipeline(stages=stages).fit(data))


def predict_text_classifier(model: TextClassifier, df: DataFrame, text_col: str) -> DataFrame:
    """Adds pred_label and pred_confidence (probability of the predicted class)."""
    from pyspark.ml.functions import vector_to_array

    out = model.head.stages[1].transform(model.vocabulary.features(df, text_col))
    names = F.array(*[F.lit(x) for x in model.labels])
    probs = vector_to_array(F.col("probability"))
    return out.select(
        *df.columns,
        F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("pred_label"),
        F.round(F.array_max(probs), 4).alias("pred_confidence"),
    )


def loss_gradient(data: DataFrame, coefficients, intercepts, reg: float, features: str = "features", label: str = "label",
                  weight: str = "class_weight") -> DataFrame:
    """(class, loss_share, coef_gradient, intercept_gradient): the gradient of the
    penalised mean log-loss at given weights, one row per class, from a single
    aggregation over ``data`` (features ARRAY<DOUBLE>, label 0..k-1).  At the
    minimum all gradients are zero, whatever the solver: a certificate of a fit.
    ``coefficients``: k rows of weights, ``intercepts``: k numbers."""
    spark = data.sparkSession
    k = len(intercepts)
    score = [F.aggregate(F.zip_with(F.col(features), F.array(*[F.lit(float(x)) for x in c]), lambda a, b: a * b), F.lit(float(b)),
                         lambda acc, v: acc + v) for c, b in zip(coefficients, intercepts)]
    rows = data.select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"), F.col(weight).alias("w"), F.array(*score).alias("z"))
    rows = rows.withColumn("e", F.transform("z", lambda z: F.exp(z - F.array_max("z"))))
    rows = rows.withColumn("p", F.transform("e", lambda e: e / F.aggregate("e", F.lit(0.0), lambda a, v: a + v)))
    off = F.col("w") * (F.get("p", F.col("class")) - (F.col("class") == F.col("y")).cast("double"))
    each = rows.withColumn("class", F.explode(F.array(*[F.lit(i) for i in range(k)]))).withColumn("off", off)
    total = rows.agg(F.sum("w").alias("total")).first()["total"] or 1.0
    lost = F.sum(F.when(F.col("class") == F.col("y"), -F.col("w") * F.log(F.get("p", F.col("class"))))) / total
    flat = each.select("class", "off", F.posexplode("x").alias("j", "v")).groupBy("class", "j").agg((F.sum(F.col("off") * F.col("v")) / total).alias("g"))
    penalty = spark.createDataFrame([(c, j, float(v)) for c, row in enumerate(coefficients) for j, v in enumerate(row)], "class int, j int, u double")
    coef = flat.join(F.broadcast(penalty), ["class", "j"]).groupBy("class").agg(F.max(F.abs(F.col("g") + reg * F.col("u"))).alias("coef_gradient"))
    own = each.groupBy("class").agg(F.coalesce(lost, F.lit(0.0)).alias("loss_share"), (F.sum("off") / total).alias("intercept_gradient"))
    return own.join(coef, "class").select("class", "loss_share", "coef_gradient", "intercept_gradient")
