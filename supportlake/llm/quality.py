"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote bad, abstain or good on whole texts.
2. The votes of all documents are counted per pattern (at most 3 to the number
   of labellers rows); expectation-maximisation over the counts estimates how
   often each labeller gives each vote in either class.
3. The posterior of a document's pattern labels a bounded sample
   (``max_train`` documents, by hash), on which a logistic scorer over hashed
   features is trained.
4. The scorer judges every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq, sub

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD, ABSTAIN, GOOD = 0, 1, 2
LABELLERS = ("symbols", "capitals", "echo", "longest run", "few distinct", "common word", "shouting", "bars",
             "function words", "word length")
DIMS = 1 << 12
MAX_TRAIN = 4_000
FOREIGN = 0.2                # share of letters of another script from which a labeller abstains
MIN_WORDS = 10               # shorter texts: labellers abstain
THRESHOLD = 0.5
EM_ROUNDS = 200
PRIOR = 20.0                 # pseudo-documents that hold the classes to their meaning
PART = 1 << 20

# frequent function words of the languages the labeller knows
FUNCTION_WORDS = frozenset(
    "the of and to in is was that for on with as by be this are from it or an at "
    "le la les de des et un une en que qui dans pour pas sur du au "
    "der die das und ist von den zu mit ein eine auf für im nicht "
    "el los las del que y en un una por con para es su se no".split())
_WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class Stats:
    words: int
    symbols: float           # marks outside ordinary punctuation, per character that is not white space
    capitals: float          # capitals per letter
    echo: float              # words equal to the word before
    run: int                 # most words in a row that are equal
    distinct: float          # different words per word
    common: float            # share of the most frequent word
    shouting: float          # ! and ? per word
    bars: float              # words that are | or tabs, per word
    function: float          # function words per word
    length: float            # mean word length
    repeated: float          # share of short words that come more than once, function words of whatever language
    foreign: float           # letters of scripts other than Latin, per letter
    unspaced: float          # letters of scripts of which some put no blanks between words, per letter


_ASCII = None


def _classes():
    """Byte -> class 0..31: letters, capitals, digits, blanks, each mark, high bytes."""
    global _ASCII
    if _ASCII is None:
        import numpy as np

        c = np.full(256, 31, np.uint8)
        c[0x80:0xC0] = 1                                      # rest of a multi-byte letter
        c[0xC0:] = 2
        c[[*range(97, 123)]] = 3
        c[[*range(65, 91)]] = 4
        c[[*range(48, 58)]] = 5
        c[[32]] = 6
        c[[9, 11, 12, 13]] = 7
        c[[10]] = 8
        for k, ch in enumerate(b".,;:!?'\"()-/|*#$%&@_="):
            c[ch] = 9 + k
        _ASCII = c
    return _ASCII


def stats_of(text: str):
    import numpy as np

    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_classes()[raw], minlength=32)
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return Stats(0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), raw
    low = text.lower().split()
    counts: dict[str, int] = {}
    for w in low:
        counts[w] = counts.get(w, 0) + 1
    solid = max(1, int(kinds.sum() - kinds[6:9].sum() - kinds[1]))
    marks = int(kinds[20:32].sum())
    # capitals: by lengths of changes, so that accented capitals count
    capitals = sum(map(str.isupper, text)) if kinds[2] else int(kinds[4])
    letters = max(1, int(kinds[2] + kinds[3] + kinds[4]))
    breaks = [0, *[i for i, same in enumerate(map(eq, low, low[1:]), 1) if not same], n]
    echo = (n + 1 - len(breaks)) / max(1, n - 1)
    run = max(map(sub, breaks[1:], breaks))
    function = sum(c for w, c in counts.items() if w.strip(".,;:!?") in FUNCTION_WORDS) / n
    repeated = sum(c for w, c in counts.items() if c > 1 and len(w) <= 4) / n
    foreign = unspaced = 0.0
    if kinds[2]:                         # by the first byte of a letter: two bytes beyond Latin; three bytes but for marks and symbols
        lead = np.bincount(raw, minlength=256)
        wide = int(lead[[0xE0, 0xE1, *range(0xE3, 0xEE)]].sum())
        foreign, unspaced = (int(lead[0xCA:0xE0].sum()) + wide) / letters, wide / letters
    return Stats(n, marks / solid, capitals / letters, echo, run, len(counts) / n, max(counts.values()) / n, int(kinds[13] + kinds[14]) / n,
                 words.count("|") / n, function, (solid + 0.0) / n, repeated, foreign, unspaced), raw


def votes_of(s: Stats) -> list[int]:
    """A labeller abstains where it does not know the script: function words
    speak in Latin texts only, and a text without the known ones is only bad if no
    short word of another language repeats either; word length says nothing in
    scripts without blanks."""
    if s.words < MIN_WORDS:
        return [ABSTAIN] * len(LABELLERS)
    pick = lambda x, good, bad: BAD if x >= bad else GOOD if x < good else ABSTAIN
    return [
        pick(s.symbols, 0.05, 0.12),
        pick(s.capitals, 0.3, 0.6),
        pick(s.echo, 0.1, 0.3),
        pick(s.run, 4, 8),
        pick(-s.distinct, -0.3, -0.15) if s.words >= 40 else ABSTAIN,
        pick(s.common, 0.2, 0.35) if s.words >= 20 else ABSTAIN,
        pick(s.shouting, 0.1, 0.4),
        pick(s.bars, 0.05, 0.2),
        ABSTAIN if s.foreign > FOREIGN else GOOD if s.function >= 0.08 else
        BAD if s.function < 0.01 and s.repeated < 0.05 and s.words >= 25 else ABSTAIN,
        ABSTAIN if s.unspaced > FOREIGN else GOOD if 2.5 <= s.length < 14 else BAD if s.length >= 20 or s.length < 1.5 else ABSTAIN,
    ]


def pattern_of(votes: list[int]) -> int:
    return sum(v * 3 ** k for k, v in enumerate(votes))


def features_of(text: str | None):
    """(indices, values) of unit length: hashed trigrams of byte classes, and
    hashed bands of the statistics the labellers look at."""
    import numpy as np

    s, raw = stats_of(text or "")
    grams = np.zeros(DIMS, np.float64)
    for at in range(0, len(raw), PART):
        c = _classes()[raw[at:at + PART + 2]].astype(np.uint32)
        if len(c) > 2:
            g = (c[:-2] << np.uint32(10)) | (c[1:-1] << np.uint32(5)) | c[2:]
            grams += np.bincount((g * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12), minlength=DIMS)
    norm = np.sqrt(grams.sum()) or 1.0
    grams = np.sqrt(grams) / norm
    for k, x in enumerate((s.symbols, s.capitals, s.echo, s.run / 40, s.distinct, s.common, s.shouting, s.bars, s.function)):
        known = s.words >= MIN_WORDS and (k < 8 or s.foreign <= FOREIGN)      # as the labellers: function words in Latin texts
        band = min(int(x * 20), 20) if known else 21
        grams[(k * 32 + band) * 0x85EBCA6B % (1 << 32) >> 20] += 0.7
    at = np.flatnonzero(grams)
    v = grams[at]
    return at.astype(np.int32), (v / (np.sqrt((v * v).sum()) or 1.0)).astype(np.float32)


@dataclass(frozen=True)
class LabelModel:
    bad_share: float
    miss: object             # (labellers, 2 classes): chance of a bad vote, given a vote, in the bad and the good class

    def posterior_good(self, pattern: int) -> float:
        import numpy as np

        votes = pattern // 3 ** np.arange(len(LABELLERS)) % 3
        z = np.log([self.bad_share, 1 - self.bad_share])
        z = z + np.log(self.miss[votes == BAD]).sum(0) + np.log(1 - self.miss[votes == GOOD]).sum(0)
        p = np.exp(z - z.max())
        return float(p[1] / p.sum())


def fit_labels(counts: dict[int, int], rounds: int = EM_ROUNDS, prior: float = PRIOR) -> LabelModel:
    """EM over pattern counts; an abstention says nothing.  The first
    expectation takes one bad vote as a sign and two as a strong one (a bad
    text fails some labellers, seldom all).  Pseudo-counts hold the classes to
    their meaning, and no labeller may turn against its own (a bad vote is
    never likelier in the good class), so clean input is not split in two."""
    import numpy as np

    k = len(LABELLERS)
    pats = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in pats.tolist()], float)
    votes = (pats[:, None] // 3 ** np.arange(k)) % 3                     # (patterns, labellers)
    bad, good = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    base = np.array([0.25, 0.005])
    is_bad = np.array([0.02, 0.7, 0.95])[np.minimum(bad.sum(1), 2).astype(int)] if len(pats) else np.empty(0)
    miss, share = np.repeat(base[None], k, 0), 0.1
    for _ in range(rounds):
        w = np.stack([is_bad, 1 - is_bad], 1) * n[:, None]               # (patterns, classes)
        hits, all_ = bad.T @ w + prior * base, (bad + good).T @ w + prior
        new = hits / all_
        turned = new[:, 0] < new[:, 1]
        new[turned] = (hits.sum(1) / all_.sum(1))[turned, None]
        fresh = float(np.clip((w[:, 0].sum() + 1) / (n.sum() + 10), 1e-4, 0.5))
        moved = abs(fresh - share) + float(np.abs(new - miss).max())
        miss, share = np.clip(new, 1e-5, 1 - 1e-5), fresh
        z = np.log([share, 1 - share]) + bad @ np.log(miss) + good @ np.log(1 - miss)
        is_bad = 1 / (1 + np.exp(np.clip(z[:, 1] - z[:, 0], -50, 50)))
        if moved < 1e-9:
            break
    return LabelModel(share, miss)


@dataclass(frozen=True)
class Scorer:
    weights: object          # float32 (DIMS)
    bias: float

    def score(self, text: str | None) -> float:
        import math

        at, v = features_of(text)
        z = float(self.weights[at] @ v) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_scorer(rows: list[tuple[list[int], list[float], float]], bad_share: float, rounds: int = 400, l2: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by full-batch Adam; classes weigh
    alike in training, and the intercept then takes the corpus's odds."""
    import numpy as np

    w, bias = np.zeros(DIMS), 0.0
    if not rows:
        return Scorer(w.astype(np.float32), 4.0)
    at = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
    val = np.concatenate([np.asarray(r[1], np.float64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    good, bad = max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
    weight = y * (0.5 / good) + (1 - y) * (0.5 / bad)
    m, v, mb, vb = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[at] * val, len(rows)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(at, err[row] * val, DIMS) + l2 * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr = 0.1 / (1 + t / 100)
        w -= lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        bias -= lr * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-8)
    return Scorer(w.astype(np.float32), float(bias + np.log((1 - bad_share) / bad_share)))


def _pattern_column(text: Column) -> Column:
    @F.pandas_udf("int")
    def pattern(texts):
        import pandas as pd

        return pd.Series([pattern_of(votes_of(stats_of(t or "")[0])) for t in texts], dtype="int32")

    return pattern(text)


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, Scorer]:
    """Votes of all documents, EM, then the scorer on about ``max_train``
    documents (never more than twice that): a hash share of all, and a larger
    one of those that the labellers hold bad, so that a rare class is in the
    sample.  The share goes by id and text, so copies do not fill it."""
    text = F.col(text_col).cast("string")
    votes = docs.select(_pattern_column(text).alias("pattern"))
    counts = {int(r["pattern"]): int(r["n"]) for r in votes.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    labels = fit_labels(counts)
    total = sum(counts.values())
    share = min(1.0, max_train / 2 / max(total, 1))
    rare = sum(n for p, n in counts.items() if labels.posterior_good(p) < 0.5)
    more = min(1.0, max_train / 2 / max(rare, 1))
    bad = sorted(p for p in counts if labels.posterior_good(p) < 0.5)

    def sample(it):
        import numpy as np
        import pyarrow as pa

        own = set(bad)
        for b in it:
            rows = []
            for t, h in zip(b.column(0), b.column(1).to_numpy(zero_copy_only=False)):
                u = (int(h) & 0xFFFFFFFF) / 2 ** 32
                if u >= max(share, more):
                    continue
                t = t.as_py() or ""
                p = pattern_of(votes_of(stats_of(t)[0]))
                if u < (more if p in own else share):
                    at, v = features_of(t)
                    rows.append((p, at, v))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                 pa.array([np.asarray(r[2]) for r in rows], pa.list_(pa.float32()))], ["pattern", "at", "val"])

    hashed = docs.select(text.alias("text"), F.xxhash64(F.col(id_col), text).alias("h"))
    # what no class can want is not even sent to Python
    hashed = hashed.where(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)) < F.lit(int(max(share, more) * 2 ** 32)))
    got = hashed.mapInArrow(sample, "pattern int, at array<int>, val array<float>").limit(2 * max_train).collect()
    rows = [(r["at"], r["val"], labels.posterior_good(r["pattern"])) for r in got]
    return labels, fit_scorer(rows, labels.bad_share)


def score_column(spark, scorer: Scorer, text: Column) -> Column:
    """Probability that a text is good, from the whole text."""
    shared = spark.sparkContext.broadcast(scorer)

    @F.pandas_udf(T.DoubleType())
    def score(texts):
        import pandas as pd

        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return score(text)


def judge(docs: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep), one row per row of ``docs``.

    Defined cases: null and empty texts have no words, no labeller votes on
    them and they get the scorer's value for an empty text; fewer than ten
    words: only the scorer speaks; repeated rows score alike; a null id stays
    null; an empty table gives an empty one; other columns are not looked at."""
    _, scorer = fit(docs, max_train, id_col, text_col)
    s = score_column(docs.sparkSession, scorer, F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), s.alias("score")).withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the scorer accepts, with their columns.

    Defined cases: null, empty and short texts have no labeller's vote, the
    scorer alone decides; rows that repeat are kept or go together; null ids are
    as good as any; where no text is held bad, all stay; an empty table gives an
    empty one; other columns are passed on, whatever their names."""
    _, scorer = fit(docs, max_train)
    return docs.where(score_column(docs.sparkSession, scorer, F.col("text").cast("string")) >= threshold)
