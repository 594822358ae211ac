"""Text encoders producing ARRAY<DOUBLE> columns for the vector operators.

* ``with_keyword_counts`` / ``with_keyword_vector``: whole-word counts of the
  taxonomy vocabulary, native Columns (one regex pass per row).  Cosine on
  these vectors is what the built-in prototype classifier and retrieval use
  when no model encoder is plugged in; SQL can compute the same vector.
* ``encoder_udf``: slot for any batch encoder (e.g. a local ONNX sentence
  model); an Iterator pandas_udf so the model loads once per task and rows
  travel in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from supportlake.functions import text as tx
from supportlake.taxonomy import keyword_vocabulary


def _keyword_alternation() -> str:
    # longest first, so where several keywords start at one position the
    # longest is captured; shorter word-prefixes are added back by
    # ``_prefix_closure``.  Keywords of one first letter are one alternative
    by_letter: dict[str, list[str]] = {}
    for k in sorted(keyword_vocabulary(), key=lambda k: (-len(k), k)):
        by_letter.setdefault(k[0], []).append(tx.regex_escape(k[1:]))
    return "|".join(f"{tx.regex_escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items()))


def _prefix_closure() -> dict[str, list[str]]:
    """keyword -> keywords whose occurrence implies it at the same position
    (itself and longer keywords that start with it plus a space)."""
    vocab = keyword_vocabulary()
    return {k: [k2 for k2 in vocab if k2 == k or k2.startswith(k + " ")] for k in vocab}


def keyword_tokens(text: Column) -> Column:
    """``|kw1||kw2|...``: the keyword found at each start position, one regex
    pass per row (a zero-width lookahead visits every position, so matches
    that overlap are all seen)."""
    low = F.lower(tx.not_null_text(text))
    pattern = r"(?U)\b(?=(" + _keyword_alternation() + r")\b)"
    toks = F.regexp_extract_all(low, F.lit(pattern), 1)
    return F.concat(F.lit("|"), F.array_join(toks, "||"), F.lit("|"))


def counts_from_tokens(tokens: Column) -> Column:
    """ARRAY<INT> of whole-word keyword counts, vocabulary order.

    Each count is plain string arithmetic on the (short) token string, so the
    expression stays small and inside whole-stage codegen."""
    n = F.length(tokens)

    def occ(k: str) -> Column:
        marker = f"|{k}|"
        # most rows hold no or one keyword: only present keywords pay a replace
        return F.when(F.instr(tokens, marker) > 0,
                      ((n - F.length(F.replace(tokens, F.lit(marker), F.lit("")))) / (len(k) + 2)).cast("int")
                      ).otherwise(F.lit(0))

    out = []
    for k, implied in _prefix_closure().items():
        total = None
        for k2 in implied:
            total = occ(k2) if total is None else total + occ(k2)
        out.append(total)
    return F.array(*out)


def with_keyword_counts(df: DataFrame, text_col: str, out: str = "_kc") -> DataFrame:
    """Adds the vocabulary count array as a column.

    The token string is produced behind a Generate (``inline`` of a
    one-element array), so the regex runs once per row even though every
    count reads it.
    """
    tok = tx.materialize(df, _ktok=keyword_tokens(F.col(text_col)))
    return tx.materialize(tok, **{out: counts_from_tokens(F.col("_ktok"))}).drop("_ktok")


def with_keyword_vector(df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
    kc = with_keyword_counts(df, text_col, "_kv")
    return kc.withColumn(out, F.transform("_kv", lambda c: c.cast("double"))).drop("_kv")


def encoder_udf(make_encoder: Callable[[], Callable[[list[str]], np.ndarray]]):
    """Wrap ``make_encoder() -> encode(texts) -> (n, dim) array`` as a Column function."""

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = make_encoder()  # once per task
        for texts in batches:
            m = np.asarray(enc(texts.fillna("").astype(str).tolist()), dtype=np.float64)
            yield pd.Series(list(m))

    return encode
