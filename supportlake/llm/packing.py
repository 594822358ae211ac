"""Best-fit packing planned on the histogram of lengths.

The number of distinct piece lengths is at most the capacity, however many
documents there are.  The plan therefore runs over (length, count) pairs on
the driver: lengths from large to small, each count placed best-fit into
classes of equal bins.  The plan is a table of runs: pieces of one length with
ranks in an interval take slots computed from it.  Documents get their slot by
a join on length and rank.

The rank within a length is computed in two levels (per hash bucket, then the
buckets' offsets), so a length that a third of all pieces share is not ranked
in one task.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from supportlake.session import cut_lineage

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): every document's ids with
    the end id, cut into pieces of ``capacity`` if longer (the last may be
    shorter).  ``ids`` is little-endian unsigned 32-bit (null unless kept).
    Null text counts as empty: the end id alone."""

    def batches(it):
        import zlib

        import pyarrow as pa

        from supportlake.llm.tokens import column_ids

        ids_of = column_ids(tokenizer)
        end = end_id.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                            ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for b in it:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), ids_of(b.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), capacity * 4)):
                    part = ids[at:at + capacity * 4]
                    rows.append((doc, k, k * capacity, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length, count).  Rows (length, rank_from,
    rank_to, per, seq_from, offset): the piece of that length with rank r in
    [rank_from, rank_to) goes to sequence seq_from + (r - rank_from) // per, at
    offset + ((r - rank_from) % per) * length.

    A class is a run of bins with the same content: (first sequence, bins,
    fill).  Only the last bins of a class that a length meets are split off, so
    there are at most a few classes per length."""
    out: list[tuple[int, int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}     # room -> [(first sequence, bins)]
    rooms: list[int] = []                                # sorted keys of open_bins
    sequences = 0

    def put(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in open_bins:
                bisect.insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append((first, bins))

    def place(length: int, rank: int, count: int, first: int, bins: int, room: int) -> int:
        """As many of ``count`` as fit into the class; returns how many."""
        per = room // length
        full = min(bins, count // per)
        if full:
            out.append((length, rank, rank + full * per, per, first, capacity - room))
            put(room - per * length, first, full)
        done, left = full * per, count - full * per
        if left and full < bins:                         # fewer than ``per`` remain: one more bin
            out.append((length, rank + done, rank + done + left, left, first + full, capacity - room))
            put(room - left * length, first + full, 1)
            done, full = done + left, full + 1
        put(room, first + full, bins - full)
        return done

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        rank, left = 0, counts[length]
        while left and (at := bisect.bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]                             # the tightest room that fits
            first, bins = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            done = place(length, rank, left, first, bins, room)
            rank, left = rank + done, left - done
        if left:
            new = -(-left // (capacity // length))
            first, sequences = sequences, sequences + new
            place(length, rank, left, first, new, capacity)
    return out


def rank_within(rows: DataFrame, by: str, order: list[str], bucket_rows: int = 50_000) -> DataFrame:
    """``rows`` with ``rank`` (long, from 0) within each value of ``by``, any
    but fixed order.  Buckets by a hash of ``order`` grow in number with the
    rows, so no window holds more than about ``bucket_rows`` rows of one value
    (rows equal in all of ``order`` stay together); there are at least as many
    as the shuffle has partitions, so a value that most rows share is spread."""
    total = rows.count()
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_rows))
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(by, "__bucket").count()
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__from"))
    own = Window.partitionBy(by, "__bucket").orderBy(*order)
    return (dealt.withColumn("__rn", F.row_number().over(own)).join(offsets, [by, "__bucket"])
            .withColumn("rank", F.col("__from") + F.col("__rn") - 1).drop("__bucket", "__from", "__rn"))


def assign(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with ``length``, doc_id, piece) plus (sequence_id, offset).
    The histogram has at most ``capacity`` rows and the plan a few per length;
    the plan is joined, not collected per document."""
    spark = rows.sparkSession
    ranked = rank_within(rows, "length", ["doc_id", "piece", "ids_crc32"])
    counts = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity)
    table = spark.createDataFrame(runs or [], "length long, rank_from long, rank_to long, per long, seq_from long, at long")
    if len(runs) > 64 * capacity:        # cannot happen for any counts seen; the join below needs no broadcast
        table = cut_lineage(table)
    else:
        table = F.broadcast(table)
    step = F.col("rank") - F.col("rank_from")
    return (ranked.alias("p").join(table.alias("t"), (F.col("p.length") == F.col("t.length"))
                                   & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
            .select("p.*", (F.col("seq_from") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
                    (F.col("at") + F.pmod(step, F.col("per")) * F.col("p.length")).cast("long").alias("offset"))
            .drop("rank"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids
    if ``keep_ids``), one row per piece.

    Defined cases: null and empty texts are one piece with the end id; a
    document longer than the capacity is cut into full pieces and a rest;
    repeated rows and null ids are packed like any other row; an empty table
    gives an empty one; other columns are not looked at."""
    rows = pieces(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col)
    if not keep_ids:
        rows = rows.drop("ids")
    return assign(cut_lineage(rows), capacity)


def sequences(packed: DataFrame, pad_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids array, used): the packed sequences themselves, padded
    to the capacity.  A group holds at most ``capacity`` ids."""

    def one(key, group):
        import numpy as np
        import pandas as pd

        ids = np.full(capacity, pad_id, "<i8")
        for at, part in zip(group["offset"], group["ids"]):
            part = np.frombuffer(part, "<u4")
            ids[at:at + len(part)] = part
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [ids], "used": [int(group["length"].sum())]})

    return packed.groupBy("sequence_id").applyInPandas(one, "sequence_id long, ids array<long>, used long")


