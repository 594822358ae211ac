"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of non-letters becomes one blank, so
digits, marks and white space say nothing.  All 1- to 3-grams of the result
are hashed into ``BUCKETS``; the log-probability matrix (languages x buckets)
is broadcast.  The n-grams of a whole batch of texts are one array of buckets:
rows of the matrix are looked up for the n-grams that occur and summed by text.

Counts and the least fit come from all labelled rows, and every row and every
character is scored.  At most MAX_LANGUAGES languages are learned, those with
the most rows, so that the matrix is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.llm.stretches import runs_of

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
PART = 1 << 18               # characters hashed at once
MAX_LANGUAGES = 512          # learned, those with the most rows: bounds the matrix
UNKNOWN = "und"
SLACK = 4.0                  # nats over the root of a text's n-grams
LOW, MARGIN = 0.001, 0.5     # share of the labelled texts below the least fit, and nats below that
RESULT = "lang_pred string, score double, fit double"


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]   # sorted
    logp: object             # float32 (buckets, languages)
    prior: object            # float64 (languages)


def _letters(texts: list[str]):
    """(code points, number of the text of each) of lower-cased texts, runs of
    non-letters as one blank; texts without letters have none."""
    import numpy as np

    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(low), dtype=np.int32), list(map(len, low)))
    if not len(codes):
        return codes.astype(np.uint32), doc
    letter = _letter_table()[codes]
    first = np.r_[True, doc[1:] != doc[:-1]]
    has = np.zeros(len(low), bool)
    has[doc[letter]] = True
    keep = (letter | np.r_[False, letter[:-1]] | first) & has[doc]
    return np.where(letter, codes, 32)[keep].astype(np.uint32), doc[keep]


_TABLE = []


def _letter_table():
    if not _TABLE:
        import sys
        import unicodedata

        import numpy as np

        t = np.zeros(sys.maxunicode + 1, bool)
        t[[c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]] = True
        _TABLE.append(t)
    return _TABLE[0]


def grams(texts: list[str]):
    """Hashed n-grams of whole texts, PART places at a time: (buckets, number
    of the text of each)."""
    import numpy as np

    codes, doc = _letters(texts)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for at in range(0, len(codes), PART):
        for n in ORDERS:
            own = min(PART, len(codes) - at - n + 1)           # grams that begin in this part
            if own <= 0:
                continue
            h = np.full(own, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ codes[at + k:at + k + own]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
            inside = doc[at:at + own] == doc[at + n - 1:at + n - 1 + own]
            yield ((h * np.uint32(0xC2B2AE35)) >> shift)[inside].astype(np.int64), doc[at:at + own][inside]


def log_likelihoods(texts: list[str], logp):
    """(texts x languages sums of log-probabilities, n-grams of each text);
    ``logp``: languages x buckets."""
    import numpy as np

    z, n = np.zeros((len(texts), len(logp))), np.zeros(len(texts), np.int64)
    for bucket, doc in grams(texts):
        if len(doc):
            low, high = int(doc[0]), int(doc[-1]) + 1
            own = doc - low
            n[low:high] += np.bincount(own, minlength=high - low)
            for k, row in enumerate(logp):
                z[low:high, k] += np.bincount(own, row.take(bucket), high - low)
    return z, n


def _parts(column):
    """Texts (null: empty) of an Arrow column, taken together up to PART characters."""
    import pyarrow.compute as pc

    for a, b in runs_of([x or 0 for x in pc.binary_length(column).to_pylist()], PART):
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts of all ``docs`` (text, lang; rows without either are left out),
    summed by language."""
    import numpy as np

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    known = [r["lang"] for r in sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()]
    rows = rows.where(F.col("lang").isin(known)) if known else rows.limit(0)

    def partial(it):
        import pyarrow as pa

        sums: dict[str, object] = {}
        docs_of: dict[str, int] = {}
        for b in it:
            langs = b.column(1).to_pylist()
            for at, texts in _parts(b.column(0)):
                seen = set()
                for bucket, doc in grams(texts):
                    for d in np.unique(doc).tolist():
                        lang = langs[at + d]
                        if lang not in sums:
                            sums[lang] = np.zeros(BUCKETS, np.int64)
                        if d not in seen:
                            seen.add(d)
                            docs_of[lang] = docs_of.get(lang, 0) + 1
                    names, number = np.unique(np.array(langs[at:at + len(texts)], object).astype(str), return_inverse=True)
                    own = number[doc]
                    for k in np.unique(own).tolist():
                        sums[str(names[k])] += np.bincount(bucket[own == k], minlength=BUCKETS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.r_[at, -1].astype(np.int32)),
                 pa.array(np.r_[counts[at], docs_of[lang]])], ["lang", "bucket", "n"])

    sums = rows.select("text", "lang").mapInArrow(partial, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()                                   # at most languages x buckets
    names = got["lang"].to_pylist()
    langs = tuple(sorted(set(names)))
    col = np.array([langs.index(x) for x in names], np.int64)
    bucket, n_of = got["bucket"].to_numpy(), got["n"].to_numpy().astype(float)
    counts, docs_n = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    docs_n[col[bucket < 0]] = n_of[bucket < 0]
    counts[bucket[bucket >= 0], col[bucket >= 0]] = n_of[bucket >= 0]
    counts += SMOOTHING
    return Model(langs, np.log(counts / counts.sum(0)).astype(np.float32), np.log(docs_n / max(docs_n.sum(), 1)))


def predict_column(spark, model: Model, text: Column) -> Column:
    """struct(lang_pred, score, fit): the most probable language and its
    posterior (equal posteriors: the lesser name); ``und`` and 0 if the text is
    null, has no letters, or nothing was learned.  fit is the mean log-probability
    of an n-gram in that language, with some room for short texts."""
    import numpy as np

    shared = spark.sparkContext.broadcast((model.langs, np.ascontiguousarray(model.logp.T), model.prior))

    @F.pandas_udf(T._parse_datatype_string(RESULT))
    def predict(texts):
        import numpy as np
        import pandas as pd

        langs, logp, prior = shared.value
        names, score, fit = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        texts = [t or "" for t in texts]
        for at, stop in runs_of(list(map(len, texts)), PART) if langs else ():
            z, n = log_likelihoods(texts[at:stop], logp)
            some = np.flatnonzero(n)
            k = (z[some] + prior).argmax(1)
            e = np.exp(z[some] + prior - (z[some] + prior).max(1, keepdims=True))
            names[at + some] = np.array(langs, object)[k]
            score[at + some] = e[np.arange(len(some)), k] / e.sum(1)
            fit[at + some] = z[some, k] / n[some] + SLACK / np.sqrt(n[some])
        return pd.DataFrame({"lang_pred": names, "score": score, "fit": fit})

    return predict(text)


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents whose crc32(doc_id as text) mod 5 is not 0 and that have a lang."""
    return docs.where((held_out_remainder(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def held_out_remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per row of ``docs``, whole texts.

    Defined cases: null or letterless text gives ``und`` with score 0; a null
    id stays null; repeated rows each come back; an empty table gives an empty
    one; other columns are not looked at."""
    p = predict_column(docs.sparkSession, model, F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), p.alias("p")).select("doc_id", "p.lang_pred", "p.score")


def least_fit(docs: DataFrame, model: Model) -> float:
    """The fit below which a text is in no learned language: MARGIN under the
    LOW quantile of all labelled texts (its rank is exact to 0.01 %)."""
    rows = training_rows(docs).select(F.col("text").cast("string").alias("text"))
    p = predict_column(docs.sparkSession, model, F.col("text"))
    # no filter on the prediction: Spark would make it twice, in two workers a task
    got = rows.select(p.alias("p")).agg(F.percentile_approx(F.when(F.col("p.fit") > float("-inf"), F.col("p.fit")), LOW, 10_000)).first()[0]
    return float("-inf") if got is None else got - MARGIN


def keep_identified(docs: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` (with their columns) in a learned language: with
    letters, and a mean log-probability per n-gram, which does not grow with the
    length as posteriors do, of at least ``least`` (``least_fit`` of ``docs``).

    Defined cases: null and letterless texts go; where no language could be
    learned all rows stay; repeated rows stay or go together; null ids are as good
    as any; an empty table gives an empty one; other columns are passed on,
    whatever their names."""
    if not model.langs:
        return docs
    least = least_fit(docs, model) if least is None else least
    p = predict_column(docs.sparkSession, model, F.col("text").cast("string"))
    return docs.where((p["lang_pred"] != UNKNOWN) & (p["fit"] >= least))
