"""Token ids as files of static range-ANS blocks.

Format: a Parquet dataset with one row per segment; ``part`` and ``seq`` order
the segments and with them the documents.  A segment is

* ``freqs``: the frequency table that its blocks share, summing to 2**SCALE;
* ``blocks``: each holds whole documents and decodes on its own, given the
  table.  Header: lanes, tokens, documents, checkpoint count; then the
  documents' ids and lengths, the checkpoints' places, checksums and states,
  the words, and a CRC-32 of all that.

A block's tokens are dealt to interleaved lanes: token i belongs to lane
i mod lanes, so one numpy step codes a symbol of every lane.  Every
``CHECK_STEPS`` steps a checkpoint keeps the lanes' states and the place in
the words, from where decoding can start in parallel; each stretch between
checkpoints has its own checksum.

A segment is bounded (``SEGMENT`` tokens plus one document), so a task holds a
bounded number of ids whatever the partition's size; nothing is shared between
tasks and no second pass over the corpus is needed.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END_ID = 1
SCALE = 20
SEGMENT = 4_000_000
BLOCK = 500_000
LANES = 1_024
CHECK_STEPS = 256
LOW = 1 << 31
MAGIC = 0x31534E52
FILES = "part int, seq int, first_doc long, freqs binary, blocks array<struct<tokens: long, data: binary>>"
_HEAD = struct.Struct("<IIQIIIQ")        # magic, lanes, tokens, documents, checkpoints, crc of ids, words


def scaled(counts, scale: int = SCALE):
    """Frequencies that sum to 2**scale, at least 1 for every symbol that occurs."""
    import numpy as np

    at = np.flatnonzero(counts)
    total = 1 << scale
    if len(at) > total:
        raise ValueError("more symbols than the table has slots")
    freq = np.zeros(len(counts), np.int64)
    if not len(at):
        return freq
    own = counts[at].astype(np.float64)
    f = np.maximum(1, np.floor(own * ((total - len(at)) / own.sum())).astype(np.int64))
    rest = total - int(f.sum())
    order = np.argsort(-own, kind="stable")
    if rest >= 0:
        f += rest // len(f)
        f[order[:rest % len(f)]] += 1
    else:
        for k in order:
            take = min(-rest, int(f[k]) - 1)
            f[k] -= take
            rest += take
            if not rest:
                break
    freq[at] = f
    return freq


def table_bytes(freq) -> bytes:
    import numpy as np

    at = np.flatnonzero(freq).astype("<u4")
    body = zlib.compress(np.diff(at, prepend=np.uint32(0)).astype("<u4").tobytes() + freq[at].astype("<u4").tobytes(), 6)
    return struct.pack("<III", MAGIC, len(at), zlib.crc32(body)) + body


def table_from(data: bytes):
    """(symbol of every slot, frequency, first slot), the last two by symbol."""
    import numpy as np

    magic, n, crc = struct.unpack_from("<III", data)
    body = data[12:]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("damaged frequency table")
    body = np.frombuffer(zlib.decompress(body), "<u4")
    at = np.cumsum(body[:n], dtype=np.uint32).astype(np.int64)
    freq = np.zeros(int(at[-1]) + 1 if n else 1, np.uint64)
    freq[at] = body[n:]
    first = np.cumsum(freq, dtype=np.uint64) - freq
    return np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)), freq, first


def encode_block(ids, freq, first, docs, lengths, lanes: int = LANES, scale: int = SCALE, every: int = CHECK_STEPS) -> bytes:
    """One block record.  ``docs`` are the documents' ids (int64, with ``NO_ID`` for null), ``lengths`` their tokens."""
    import numpy as np

    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    out, marks = [], []
    put = 0
    up = np.uint64(32)
    freq_of, first_of = freq[ids], first[ids]
    limit = freq_of << np.uint64(31 - scale + 32)      # a state at or above it gives a word first
    shift = np.uint64(scale)
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min((s + 1) * lanes, n)
        y = x[:b - a]
        f = freq_of[a:b]
        full = y >= limit[a:b]
        if full.any():
            w = y[full]
            out.append(w.astype(np.uint32))
            put += len(w)
            y[full] = w >> up
        q = y // f
        y[:] = (q << shift) + (y - q * f) + first_of[a:b]
        if s % every == 0:
            marks.append((s, put, x.copy()))
    # the decoder reads the words backwards from the end of the encoder's
    words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
    marks = marks[::-1]
    raw = ids.astype("<u4")
    parts = [raw[s * lanes:(s + every) * lanes] for s, _, _ in marks]
    head = _HEAD.pack(MAGIC, lanes, n, len(docs), len(marks), zlib.crc32(raw), len(words))
    body = b"".join([
        head, np.asarray(docs, "<i8").tobytes(), np.asarray(lengths, "<i8").tobytes(),
        np.array([put - p for _, p, _ in marks], "<u8").tobytes(),
        np.array([zlib.crc32(p) for p in parts], "<u4").tobytes(),
        *[m.astype("<u8").tobytes() for _, _, m in marks], words.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(data: bytes, table, scale: int = SCALE, every: int = CHECK_STEPS, only=None):
    """(doc ids, lengths, ids).  ``only``: the numbers of the checkpoints whose
    stretches are wanted (ids of the others stay 0); each is decoded alone."""
    import numpy as np

    if zlib.crc32(data[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise ValueError("damaged block")
    magic, lanes, n, m, marks, crc, n_words = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block")
    at = _HEAD.size
    def take(kind, count):
        nonlocal at
        a = np.frombuffer(data, kind, count, at)
        at += a.nbytes
        return a

    docs, lengths = take("<i8", m), take("<i8", m)
    place, sums = take("<u8", marks), take("<u4", marks)
    states = take("<u8", marks * lanes).reshape(marks, lanes)
    words = take("<u4", n_words)
    symbol, freq, first = table
    ids = np.zeros(n, np.uint32)
    mask, shift, up, low = np.uint64((1 << scale) - 1), np.uint64(scale), np.uint64(32), np.uint64(LOW)
    steps = -(-n // lanes)
    for c in range(marks) if only is None else only:
        x, read = states[c].copy(), int(place[c])
        for s in range(c * every, min((c + 1) * every, steps)):
            a, b = s * lanes, min((s + 1) * lanes, n)
            y = x[:b - a]
            slot = y & mask
            got = symbol[slot]
            ids[a:b] = got
            y[:] = freq[got] * (y >> shift) + slot - first[got]
            short = y < low
            k = int(np.count_nonzero(short))
            if k:
                y[short] = (y[short] << up) | words[read:read + k]
                read += k
        if zlib.crc32(ids[c * every * lanes:(c + 1) * every * lanes]) != int(sums[c]):
            raise ValueError(f"stretch {c} does not match its checksum")
    if only is None and zlib.crc32(ids) != crc:
        raise ValueError("ids do not match their checksum")
    return docs, lengths, ids


def block_documents(data: bytes):
    """(doc ids, lengths, lanes) of a block, without decoding it."""
    import numpy as np

    _, lanes, _, m, *_ = _HEAD.unpack_from(data)
    docs = np.frombuffer(data, "<i8", m, _HEAD.size)
    return docs, np.frombuffer(data, "<i8", m, _HEAD.size + docs.nbytes), lanes


NO_ID = -(1 << 63)                       # stands for a null doc_id, which comes first


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, partitions: int | None = None,
           id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT, block_ids: int = BLOCK) -> DataFrame:
    """The records (see FILES) of all documents in ascending doc_id order: rows
    are range-partitioned by doc_id and, as an id may repeat, the length and
    hash of their text, and sorted within, so part, seq and the order inside a
    block give the order of the corpus."""

    def batches(it):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from supportlake.llm.tokens import BATCH_CHARS, column_ids

        ids_of = column_ids(tokenizer, 2 * BATCH_CHARS)
        end = end_id.to_bytes(4, "little")
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[int, object]] = []
        size = 0

        def segment():
            nonlocal seq
            counts = np.zeros(1, np.int64)
            for _, ids in held:
                c = np.bincount(ids, minlength=len(counts))
                c[:len(counts)] += counts
                counts = c
            freq = scaled(counts)
            table = table_bytes(freq)
            freq = freq.astype(np.uint64)
            first = np.cumsum(freq, dtype=np.uint64) - freq
            blocks, a = [], 0
            while a < len(held):
                b, n = a, 0
                while b < len(held) and (not n or n + len(held[b][1]) <= block_ids):
                    n += len(held[b][1])
                    b += 1
                blocks.append({"tokens": n, "data": encode_block(
                    np.concatenate([x for _, x in held[a:b]]), freq, first, [d for d, _ in held[a:b]], [len(x) for _, x in held[a:b]])})
                a = b
            seq += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq - 1], pa.int32()), pa.array([held[0][0]], pa.int64()),
                 pa.array([table], pa.binary()),
                 pa.array([blocks], pa.list_(pa.struct([("tokens", pa.int64()), ("data", pa.binary())])))],
                ["part", "seq", "first_doc", "freqs", "blocks"])

        for b in it:
            for doc, ids in zip(b.column(0).to_pylist(), ids_of(b.column(1))):
                ids = np.frombuffer(ids + end, "<u4")
                ids = ids.astype(np.uint16) if ids.max() < 1 << 16 else ids
                held.append((NO_ID if doc is None else doc, ids))
                size += len(ids)
                if size >= segment_ids:
                    yield segment()
                    held, size = [], 0
        if held:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.length("text"), F.xxhash64("text")]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(batches, FILES)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None,
          segment_ids: int = SEGMENT, block_ids: int = BLOCK) -> None:
    """Write the records of ``docs`` as a dataset at ``path`` (any file system Spark writes to)."""
    records = encode(docs, tokenizer, end_id, partitions, segment_ids=segment_ids, block_ids=block_ids)
    records.write.mode("error").option("compression", "none").parquet(path)


def read(spark, path: str, between: tuple[int, int] | None = None) -> DataFrame:
    """(part, seq, block, doc_id, inner, n_tokens, ids): documents decoded from
    the files at ``path``; ids are little-endian unsigned 32-bit, inner is the
    number of ids before the document in its block.  Blocks are decoded one by
    one with their segment's table; checksums are verified.

    ``between``: only documents whose id lies between these two (both
    included, no null ids).  Segments that begin behind them are not read, and
    of a block only the stretches that hold them are decoded, each from its
    checkpoint."""
    return _decoded(spark, path, True, between)


def read_digests(spark, path: str) -> DataFrame:
    """As ``read``, with ids_crc32 in place of ids."""
    return _decoded(spark, path, False)


def stretches_of(starts, lengths, wanted, width: int) -> list[int]:
    """Numbers of the stretches of ``width`` ids that hold the wanted documents."""
    import numpy as np

    spans = [range(a // width, (a + n - 1) // width + 1) for a, n in zip(starts[wanted].tolist(), lengths[wanted].tolist())]
    return np.unique([c for s in spans for c in s]).tolist()


def _decoded(spark, path: str, whole: bool, between: tuple[int, int] | None = None) -> DataFrame:
    segments = spark.read.schema(FILES).parquet(path)
    if between:
        segments = segments.where(F.col("first_doc") <= between[1])

    def batches(it):
        import numpy as np
        import pyarrow as pa

        for b in it:
            for i in range(b.num_rows):
                part, seq = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                table, blocks = None, b.column(3)[i].values
                for block in range(len(blocks)):
                    data = blocks.field("data")[block].as_py()
                    only = None
                    docs, lengths, lanes = block_documents(data)
                    starts = np.cumsum(lengths) - lengths
                    mine = np.ones(len(docs), bool)
                    if between:
                        mine = (docs >= between[0]) & (docs <= between[1]) & (docs != NO_ID)
                        if not mine.any():
                            continue
                        only = stretches_of(starts, lengths, mine, lanes * CHECK_STEPS)
                    table = table or table_from(b.column(2)[i].as_py())      # one table for the blocks of a segment
                    ids = decode_block(data, table, only=only)[2]
                    raw, out = memoryview(ids.astype("<u4").tobytes()), []
                    for a, k in zip((starts[mine] * 4).tolist(), (lengths[mine] * 4).tolist()):
                        out.append(bytes(raw[a:a + k]) if whole else zlib.crc32(raw[a:a + k]))
                    m = int(mine.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x] * m, pa.int32()) for x in (part, seq, block)]
                        + [pa.array([None if d == NO_ID else d for d in docs[mine].tolist()], pa.int64()), pa.array(starts[mine], pa.int64()),
                           pa.array(lengths[mine], pa.int64()), pa.array(out, pa.binary() if whole else pa.int64())],
                        ["part", "seq", "block", "doc_id", "inner", "n_tokens", "out"])

    kind, name = ("binary", "ids") if whole else ("long", "ids_crc32")
    return segments.select("part", "seq", "freqs", "blocks").mapInArrow(
        batches, f"part int, seq int, block int, doc_id long, inner long, n_tokens long, out {kind}").withColumnRenamed("out", name)


def with_starts(spark, path: str, decoded: DataFrame) -> DataFrame:
    """``decoded`` with ``start``: ids of all documents before.  Token counts
    are summed over parts, then over the blocks of a part."""
    blocks = spark.read.schema(FILES).parquet(path).select("part", "seq", F.posexplode("blocks.tokens").alias("block", "tokens"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(upto(Window.partitionBy().orderBy("part"))), F.lit(0)).alias("__p"))
    own = blocks.select("part", "seq", "block", F.coalesce(
        F.sum("tokens").over(upto(Window.partitionBy("part").orderBy("seq", "block"))), F.lit(0)).alias("__b"))
    place = own.join(parts, "part").select("part", "seq", "block", (F.col("__p") + F.col("__b")).alias("__at"))
    return decoded.join(place, ["part", "seq", "block"]).withColumn("start", F.col("__at") + F.col("inner")).drop("__at", "inner")


def roundtrip(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``docs`` after writing its ids to
    ``path`` and reading the files back.

    Defined cases: null and empty texts hold the end id alone; a null doc_id
    comes first; rows of one doc_id are ordered by the length and hash of their
    text; a very long text is a block of its own; an empty table writes no
    block and gives an empty result; other columns are not looked at."""
    spark = docs.sparkSession
    write(docs, path, tokenizer, end_id)
    return with_starts(spark, path, read_digests(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
