"""Text vectors by feature hashing: words into a fixed number of buckets,
inverse document frequency per bucket, unit length.

A word's bucket comes from its MD5, so that SQL can compute the same vector.
Fitting is one aggregation that leaves a number per bucket, whatever the
vocabulary; encoding is row by row in the JVM (the counting, scaling and
normalising transformers of Spark ML), for any corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.operators import tfidf

DIMENSIONS = 256


def word_buckets(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """ARRAY<INT>: the bucket of every word of a text, repeats included."""
    number = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long")
    return F.transform(tfidf.terms(text, (), 1), lambda w: (number(w.cast("binary")) % dimensions).cast("int"))


@dataclass(frozen=True)
class HashedEncoder:
    idf: list[float]             # by bucket

    @property
    def dimensions(self) -> int:
        return len(self.idf)

    def with_vector(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        """``df`` with the unit vector of every text as ARRAY<DOUBLE> (a text
        without words, or null, has the zero vector)."""
        from pyspark.ml.functions import vector_to_array

        return self._features(df, text_col, "_hashed").withColumn(out, vector_to_array("_hashed")).drop("_hashed")

    def entries(self, df: DataFrame, text_col: str, ids: list[str]) -> DataFrame:
        """(ids..., bucket, weight): the entries of every vector that are not zero."""
        fields = tfidf.vector_fields(F.col("_hashed"))
        f = self._features(df.select(*ids, text_col), text_col, "_hashed").select(*ids, fields.alias("f"))
        return f.select(*ids, F.explode(F.arrays_zip("f.indices", "f.values")).alias("e")).select(
            *ids, F.col("e.indices").alias("bucket"), F.col("e.values").alias("weight"))

    def _features(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        names = [str(i) for i in range(self.dimensions)]
        rows = df.withColumn("_buckets", F.transform(word_buckets(F.col(text_col), self.dimensions), lambda b: b.cast("string")))
        tf = CountVectorizerModel.from_vocabulary(names, inputCol="_buckets", outputCol="_tf").transform(rows)
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_tfidf").transform(tf)
        return Normalizer(inputCol="_tfidf", outputCol=out, p=2.0).transform(scaled).drop("_buckets", "_tf", "_tfidf")


def fit(docs: DataFrame, text_col: str, dimensions: int = DIMENSIONS) -> HashedEncoder:
    """Document frequencies of all texts per bucket; a text counts once for a bucket."""
    n = F.count(F.lit(1))
    found = docs.select(F.explode_outer(F.array_distinct(word_buckets(F.col(text_col), dimensions))).alias("bucket"))
    rows = found.where("bucket is not null").groupBy("bucket").agg(n.alias("df"))
    total = docs.count()
    idf = {r["bucket"]: r["idf"] for r in rows.withColumn("idf", tfidf.smooth_idf(F.col("df"), F.lit(total))).collect()}   # a row per bucket
    unseen = docs.sparkSession.range(1).select(tfidf.smooth_idf(F.lit(0), F.lit(total))).first()[0]
    return HashedEncoder([idf.get(b, unseen) for b in range(dimensions)])
