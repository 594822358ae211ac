"""Substring dedup by hashing units of text.

A text is cut without loss into units: a stretch up to and with its ends
(full stop, ! or ?, or the line's end) and the white space after them.  So a
passage is found inside a line as well as on lines of its own.  A unit's
digest is taken of its lower-cased words; digests are grouped over the whole
corpus, and the earliest place (doc_id, position) keeps the unit.  Maximal
runs of later occurrences that hold at least ``min_words`` words are removed;
shorter repeats (a lone "The.") stay.  Offsets of what was removed refer to
the original text.

With ``whole_lines`` (the query and the pipeline) blocks are hashed as well:
lines, and paragraphs of several lines (up to a blank line), by their words, so
that a paragraph broken otherwise is found too.  Every later occurrence of a
block is removed whatever its length, and the minimum holds only for units
inside lines that are not repeats: ``min_words`` words or MIN_CHARS characters
(words say nothing in scripts without blanks).

Only digests and places are shuffled, pre-aggregated per digest; the join back
is an equality join whose hot digests Spark can split.  A text moves once, to
meet the list of its own repeated units.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.session import cut_lineage

MIN_WORDS = 10
MIN_CHARS = 50                           # with whole_lines, the length that a run of fewer words needs
UNIT_PATTERN = r"[^.!?\n]+[.!? \t\r\n\f]*|[.!? \t\r\n\f]+"
_UNIT = re.compile(UNIT_PATTERN)
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
NO_ID = (1 << 63) - 1                    # a null doc_id ranks last
RESULT = ("struct<text: string, removed: array<struct<start: int, stop: int>>, kept: array<struct<start: int, stop: int>>>")


def units_of(text: str) -> list[str]:
    return _UNIT.findall(text)


def blocks_of(text: str) -> list[tuple[int, int, int]]:
    """(place, start, stop) of each line with words and each paragraph of
    several of them.  place = 4 * number of the (first) line + 1 for a line, + 2
    for a paragraph; a unit's place is 4 * its number."""
    out, at, paragraph = [], 0, []
    for j, line in enumerate([*_LINE.findall(text), ""]):
        if line.strip():
            paragraph.append((4 * j + 1, at, at + len(line)))
        else:
            out += paragraph
            if len(paragraph) > 1:
                out.append((paragraph[0][0] + 1, paragraph[0][1], paragraph[-1][2]))
            paragraph = []
        at += len(line)
    return out


def digest_of(unit: str, seed: int = 0) -> tuple[int, int, int] | None:
    """(two halves of a 128-bit digest, words); None for a unit without words."""
    from xxhash import xxh3_128_intdigest

    words = unit.lower().split()
    if not words:
        return None
    h = xxh3_128_intdigest(" ".join(words), seed)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF, len(words)


def _row_tag(text):
    """The text's hash: tells rows with one doc_id (or without one) apart."""
    return F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))


UNITS = "h1 long, h2 long, doc long, tag long, place long"


def _units(rows: DataFrame, whole_lines: bool) -> DataFrame:
    """UNITS: one row per unit with words, and per block if ``whole_lines``."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        def rows_of(h1, h2, place, docs, tags, counts):
            return pa.RecordBatch.from_arrays(
                [np.array(h1, np.uint64).view(np.int64), np.array(h2, np.uint64).view(np.int64), np.repeat(np.array(docs, np.int64), counts),
                 np.repeat(np.array(tags, np.int64), counts), np.array(place, np.int64)], ["h1", "h2", "doc", "tag", "place"])

        for b in it:
            h1, h2, place, docs, tags, counts = [], [], [], [], [], []
            for d, tag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n = len(h1)
                text = text.as_py()
                for k, unit in enumerate(units_of(text)):
                    if (x := digest_of(unit)) is not None:
                        h1.append(x[0])
                        h2.append(x[1])
                        place.append(4 * k)
                for at, start, stop in blocks_of(text) if whole_lines else ():
                    x = digest_of(text[start:stop], seed=1)      # a block repeats blocks only
                    h1.append(x[0])
                    h2.append(x[1])
                    place.append(at)
                docs.append(d)
                tags.append(tag)
                counts.append(len(h1) - n)
                if len(h1) > 200_000:
                    yield rows_of(h1, h2, place, docs, tags, counts)
                    h1, h2, place, docs, tags, counts = [], [], [], [], [], []
            yield rows_of(h1, h2, place, docs, tags, counts)

    return rows.select("__doc", "__tag", "__text").where("__text <> ''").mapInArrow(batches, UNITS)


def strip_runs(text: str, repeated, min_words: int, blocks=(), min_chars: int | None = None):
    """(text, removed spans, kept spans) after removing the runs of repeated
    units of at least ``min_words`` words (or ``min_chars`` characters) and the
    repeated ``blocks``, given by place.  Units without words neither break a
    run nor count; they go only inside one."""
    marked, blocks = set(repeated), set(blocks)
    if not marked and not blocks:
        return text, [], [(0, len(text))] if text else []
    spans, at = [], 0
    run: list | None = None              # [start, stop of the last repeated unit, words]
    for k, unit in enumerate(units_of(text)):
        words = len(unit.split())
        if k in marked:
            if run is None:
                run = [at, at + len(unit), words]
            else:
                run[1:] = [at + len(unit), run[2] + words]
        elif words and run is not None:
            spans.append(run)
            run = None
        at += len(unit)
    if run is not None:
        spans.append(run)
    removed = [(a, b) for a, b, w in spans
               if w >= min_words or min_chars is not None and len(text[a:b].strip()) >= min_chars]
    if blocks:
        every = sorted(removed + [(a, b) for place, a, b in blocks_of(text) if place in blocks])
        removed = []
        for a, b in every:                # spans that overlap or touch are one
            if removed and a <= removed[-1][1]:
                removed[-1] = (removed[-1][0], max(b, removed[-1][1]))
            else:
                removed.append((a, b))
    kept, at = [], 0
    for a, b in removed:
        if a > at:
            kept.append((at, a))
        at = b
    if at < len(text):
        kept.append((at, len(text)))
    return "".join(text[a:b] for a, b in kept), removed, kept


def _strip(min_words: int, whole_lines: bool):
    @F.pandas_udf(RESULT)
    def strip(texts, marked):
        import pandas as pd

        out = []
        for t, m in zip(texts, marked):
            if t is None:
                out.append((None, [], []))
                continue
            places = [] if m is None else [int(x) for x in m]
            text, removed, kept = strip_runs(t, [p >> 2 for p in places if not p & 3], min_words,
                                             [p for p in places if p & 3], MIN_CHARS if whole_lines else None)
            out.append((text, [{"start": a, "stop": b} for a, b in removed], [{"start": a, "stop": b} for a, b in kept]))
        return pd.DataFrame(out, columns=["text", "removed", "kept"])

    return strip


def _with_result(docs: DataFrame, min_words: int, id_col: str, text_col: str, whole_lines: bool) -> DataFrame:
    """(row, out): each row of ``docs`` as a struct, so that no name of its
    columns can clash with those used here, and its struct of RESULT."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__doc"),
                       _row_tag(text).alias("__tag"), text.alias("__text"))
    units = cut_lineage(_units(rows, whole_lines))           # texts are cut and hashed once
    groups = units.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tag", "place")).alias("first"))
    groups = groups.where("n > 1").select("h1", "h2", "first")
    # what later occurrences leave behind: few rows beside the units, kept for the join with the texts
    later = (units.join(cut_lineage(groups), ["h1", "h2"])
             .where((F.col("doc") != F.col("first.doc")) | (F.col("tag") != F.col("first.tag")) | (F.col("place") != F.col("first.place"))))
    # rows that repeat doc_id and text leave the same places
    marked = cut_lineage(later.groupBy("doc", "tag").agg(F.collect_set("place").alias("__marked")))
    met = rows.join(marked, (rows["__doc"] == marked["doc"]) & (rows["__tag"] == marked["tag"]), "left")
    return met.select("row", _strip(min_words, whole_lines)(F.col("__text"), F.col("__marked")).alias("out"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                   whole_lines: bool = False) -> DataFrame:
    """(doc_id, text, removed, kept), one row per row of ``docs``; spans are
    character offsets [start, stop) in the original text and partition it.
    ``whole_lines``: repeated lines and paragraphs go whatever their length;
    without it a run of fewer than ``min_words`` words stays, also on lines of
    its own.

    Defined cases: null text stays null and empty text empty, both without
    spans; the earliest place is the least (doc_id, then the text's hash among
    rows of one doc_id, then the unit's number), a null doc_id ranks last; rows
    that repeat doc_id and text are one document and get one result each;
    repeats within one document count as well; a document may become empty but
    is not dropped; an empty table gives an empty one; other columns are not
    looked at."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_result(rows, min_words, "doc_id", "text", whole_lines).select(
        "row.doc_id", "out.text", "out.removed", "out.kept")


def with_repeats_removed(docs: DataFrame, min_words: int = MIN_WORDS, whole_lines: bool = True) -> DataFrame:
    """``docs`` with its columns, text replaced (and n_chars, if it is there).

    Defined cases: as in ``remove_repeats``; every row stays, also one whose text
    becomes empty; other columns are passed on, whatever their names."""
    out = _with_result(docs, min_words, "doc_id", "text", whole_lines)
    new = {"text": F.col("out.text").alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.col("out.text")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[new.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])


def oracle_sql(min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, source: str = "documents") -> str:
    """The texts and spans of ``remove_repeats(whole_lines=True)`` in DuckDB
    (ids unique and not null)."""
    words = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> '')"
    return f"""
WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '{UNIT_PATTERN}')) AS unit,
    generate_subscripts(regexp_extract_all(text, '{UNIT_PATTERN}'), 1) AS k FROM {source} WHERE text IS NOT NULL),
w AS (SELECT *, {words.format('unit')} AS words, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM u),
d AS (SELECT doc_id, k, stop, stop - length(unit) AS start, len(words) AS n,
    len(words) > 0 AND row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, k) > 1 AS rep FROM w),
g AS (SELECT *, sum(CASE WHEN n > 0 AND NOT rep THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM d),
r AS (SELECT doc_id, min(start) AS start, max(stop) AS stop, sum(n) AS n FROM g WHERE rep GROUP BY doc_id, run),
runs AS (SELECT doc_id, start, stop FROM r JOIN {source} USING (doc_id) WHERE n >= {min_words}
    OR length(regexp_replace(substring(text, (start + 1)::BIGINT, (stop - start)::BIGINT), '^\\s+|\\s+$', '', 'g')) >= {min_chars}),
l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line,
    generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) AS j FROM {source} WHERE text IS NOT NULL),
lw AS (SELECT doc_id, j, array_to_string({words.format('line')}, ' ') AS words, length(line) AS n,
    sum(length(line)) OVER (PARTITION BY doc_id ORDER BY j) AS stop FROM l),
lp AS (SELECT *, stop - n AS start, sum(CASE WHEN words = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j) AS paragraph FROM lw),
blocks AS (SELECT doc_id, 4 * j + 1 AS place, words, start, stop FROM lp WHERE words <> ''
    UNION ALL SELECT doc_id, 4 * min(j) + 2, string_agg(words, ' ' ORDER BY j), min(start), max(stop) FROM lp WHERE words <> ''
    GROUP BY doc_id, paragraph HAVING count(*) > 1),
again AS (SELECT doc_id, start, stop, row_number() OVER (PARTITION BY words ORDER BY doc_id, place) > 1 AS rep FROM blocks),
spans AS (SELECT * FROM runs UNION SELECT doc_id, start, stop FROM again WHERE rep),
edge AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM spans),
island AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM edge),
one AS (SELECT doc_id, min(start)::BIGINT AS a, max(stop)::BIGINT AS b FROM island GROUP BY doc_id, i),
s AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM one GROUP BY doc_id)
SELECT {source}.doc_id, CASE WHEN removed IS NULL THEN text ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda i:
    substring(text, coalesce(b[i], 0) + 1, coalesce(a[i + 1], length(text)) - coalesce(b[i], 0))), '') END AS text, coalesce(removed, '') AS removed
FROM {source} LEFT JOIN s USING (doc_id)"""
