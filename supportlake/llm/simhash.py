"""SimHash near-dedup: fingerprints of word shingles, linked within a few bits
by bit-sliced comparison, and the connected components of the links.

* Fingerprint: A-Z lower-cased, words, word shingles, XXH64 (seed 42) of each;
  a bit is set if it is set in over half of the hashes.
* Blocking: equal fingerprints are one entry.  A pair within ``radius`` bits
  agrees on one of ``radius + 1`` substrings of the fingerprint (pigeonhole).
  Entries that share a substring with too many others are split again by the
  substrings of their remaining bits (the same argument), and what is still
  hot is compared chunk by chunk, each pair of chunks in its own group.  No
  entry is dropped and nothing is capped.
* Comparison: the bits of a block stand vertically, one plane of packed words
  per bit.  Differences to many entries at once are added with carry-save
  counters and a block is given up once every distance exceeds the radius.
* Links leave a task as a spanning forest of what the task has found, so a
  dense group costs as many rows as it has members.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.components import connected_components
from supportlake.session import cut_lineage

SEED = 42
BITS = 64
BLOCK = 512          # entries compared at once (8 words of 64 lanes)
HOT = 4096           # entries with one key beyond which the key is split
CHUNK = 2048         # entries of a chunk of a key that stays hot

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit fingerprint of one text (null: as empty)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [" ".join(words)]
    else:
        shingles = list(map(" ".join, zip(*(words[i:] for i in range(shingle)))))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at:at + (1 << 16)]
        h = np.fromiter(map(xxh64_intdigest, part, [SEED] * len(part)), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, fp): one row per row of ``docs``; fp is the fingerprint's bits
    as a signed long, tag a hash of the text (0 for null).  Null text counts as
    empty (fp 0)."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        for b in it:
            fp = [fingerprint_of(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "tag", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _tag(text).alias("tag"))
    return rows.mapInArrow(batches, "doc_id long, tag long, fp long")


def _tag(text):
    return F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))


# ---- bit-sliced comparison --------------------------------------------------

def planes_of(fps):
    """(64, words) of uint64: plane p holds bit p of every entry, 64 entries a word."""
    import numpy as np

    n = len(fps)
    words = -(-n // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries, planes, n, radius):
    """Index pairs (query, entry) at most ``radius`` bits apart.

    ``ones``, ``twos``, ... are the bit-sliced counters of the differences so
    far; ``over`` marks lanes whose count has passed the radius, and the block
    is abandoned when all lanes are over."""
    import numpy as np

    queries = np.ascontiguousarray(queries, "<u8")
    need = max(1, int(radius).bit_length())       # counters hold 0 .. 2**need - 1 >= radius
    counters = [np.zeros((len(queries), planes.shape[1]), np.uint64) for _ in range(need)]
    over = np.zeros_like(counters[0])
    tail = planes.shape[1] * 64 - n
    if tail:
        over[:, -1] = ~np.uint64(0) << np.uint64(64 - tail)
    full = ~np.uint64(0)
    for p in range(BITS):
        carry = planes[p][None, :] ^ (np.uint64(0) - ((queries >> np.uint64(p)) & np.uint64(1)))[:, None]
        for c in counters:                        # carry-save: add one bit to every lane's counter
            carry, c[:] = c & carry, c ^ carry
        over |= carry                             # a counter ran over: beyond 2**need - 1 >= radius
        if p % 8 == 7:
            if radius + 1 < 1 << need:            # counts above the radius that still fit
                over |= _above(counters, radius)
            if (over == full).all():
                return np.empty(0, np.int64), np.empty(0, np.int64)
    if radius + 1 < 1 << need:
        over |= _above(counters, radius)
    hit = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little")
    return np.nonzero(hit)


def _above(counters, radius):
    """Lanes whose bit-sliced count is greater than ``radius``."""
    import numpy as np

    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


class _Forest:
    """Union-find over the fingerprints a task meets; keeps one edge per union."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (n := up.get(top, top)) != top:
            top = n
        while (n := up.get(x, x)) != top:
            up[x] = top
            x = n
        return top

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))

    def take(self) -> list[tuple[int, int]]:
        out, self.edges, self.up = self.edges, [], {}
        return out


def _compare(forest, a, b, radius):
    """Link all pairs of the entries ``a`` and ``b`` (arrays of fingerprints; the same object: within)."""
    for i in range(0, len(b), BLOCK):
        part = b[i:i + BLOCK]
        planes = planes_of(part)
        for j in range(0, i + BLOCK if a is b else len(a), BLOCK):
            q = a[j:j + BLOCK]
            x, y = within(q, planes, len(part), radius)
            for u, v in zip(q[x].tolist(), part[y].tolist()):
                if u != v:
                    forest.link(u, v)


def _links_in_partition(radius: int):
    """Rows (key, side, fp) sorted by key: small keys are packed together into
    blocks; a larger key is compared block against block.  ``side`` 0 compares
    with itself; sides 1 and 2 of one key are two chunks, compared with each other."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        forest = _Forest()

        def out():
            e = np.array(forest.take(), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])

        def flush(keys, side, fps):
            """Whole keys only."""
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            at = 0
            while at < len(cuts) - 1:
                if (side[cuts[at]:cuts[at + 1]] > 0).any():
                    f, s = fps[cuts[at]:cuts[at + 1]], side[cuts[at]:cuts[at + 1]]
                    _compare(forest, f[s == 1], f[s == 2], radius)
                    at += 1
                    continue
                to = at + 1
                while to < len(cuts) - 1 and cuts[to + 1] - cuts[at] <= BLOCK and side[cuts[to]] == 0:
                    to += 1
                run = fps[cuts[at]:cuts[to]]
                _compare(forest, run, run, radius)
                at = to

        held = None
        for b in it:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now[2] = now[2].view(np.uint64)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]):
                continue
            other = np.flatnonzero(held[0] != held[0][-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last > 0:
                flush(*(x[:last] for x in held))
                held = [x[last:] for x in held]
            if len(forest.edges) > 50_000:
                yield out()
        if held is not None and len(held[0]):
            flush(*held)
        yield out()

    return batches


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[len(bits) * i // parts:len(bits) * (i + 1) // parts] for i in range(parts)]


def _take(fp, bits: list[int]):
    """The value of a consecutive run of bits of a long column."""
    return F.shiftrightunsigned(fp, bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1).cast("long"))


def links(fps: DataFrame, radius: int = 3, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(u, v): edges between different fingerprints at most ``radius`` bits
    apart that connect whatever such pairs connect.  ``fps``: distinct (fp).
    ``radius`` from 0 to 7 (0 gives none; the least key is 8 bits)."""
    if not 0 <= radius <= 7:
        raise ValueError("radius from 0 to 7")
    parts = radius + 1
    first = _cuts(list(range(BITS)), parts)
    level = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).cast("int").alias("t"), _take(F.col("fp"), bits).alias("k")) for t, bits in enumerate(first)])).alias("x"))
    level = level.select("fp", "x.t", F.xxhash64("x.t", "x.k").alias("key"))
    busy = level.groupBy("t", "key").count().where(F.col("count") > hot).select("t", "key")
    busy = cut_lineage(busy)
    calm = level.join(busy, ["t", "key"], "left_anti").select("key", F.lit(0).cast("int").alias("side"), "fp")
    out = calm
    if busy.head(1):
        rest = level.join(busy, ["t", "key"], "left_semi")
        finer = []
        for t, bits in enumerate(first):
            left = [b for b in range(BITS) if b not in bits]
            for s, own in enumerate(_cuts(left, parts)):
                runs = [r for r in _runs(own)]
                value = F.xxhash64(F.lit(s), F.col("key"), *[_take(F.col("fp"), r) for r in runs])
                finer.append((t, value))
        per = {t: F.array(*[v for u, v in finer if u == t]) for t in range(parts)}
        pick = F.coalesce(*[F.when(F.col("t") == t, a) for t, a in per.items()])
        rest = cut_lineage(rest.select("fp", F.explode(pick).alias("key")))
        size = rest.groupBy("key").count()
        hotter = cut_lineage(size.where(F.col("count") > hot).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("c")))
        out = out.unionByName(rest.join(hotter, "key", "left_anti").select("key", F.lit(0).cast("int").alias("side"), "fp"))
        still = rest.join(hotter, "key").select("fp", "key", "c", F.pmod(F.xxhash64("fp", "key"), F.col("c")).cast("int").alias("mine"))
        still = still.select("fp", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
        out = out.unionByName(still.select(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"), F.lit("chunks")).alias("key"),
            F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("int").alias("side"), "fp"))
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.sparkSession.sparkContext.defaultParallelism)
    dealt = out.repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links_in_partition(radius), "u long, v long")


def _runs(bits: list[int]):
    """Consecutive stretches of a list of bit positions."""
    run = [bits[0]]
    for b in bits[1:]:
        if b == run[-1] + 1:
            run.append(b)
        else:
            yield run
            run = [b]
    yield run


def _components(fps: DataFrame, radius: int, hot: int, chunk: int) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint."""
    least = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = connected_components(links(least.select("fp"), radius, hot, chunk))
    rooted = (least.join(comp, least["fp"] == comp["node"], "left")
              .select("fp", "least", F.coalesce("component", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id",
                   text_col: str = "text", hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` bits
    reach.  Defined cases: null or wordless text has fingerprint zero, linked
    like any other; equal fingerprints always share a component; repeated rows
    each come back; a null doc_id comes back null with the component of its
    fingerprint (null if that holds no id); an empty table gives an empty one;
    columns other than the two named are not looked at."""
    fps = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    named = _components(fps, radius, hot, chunk).drop("root")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` (with its columns) per component: that of the smallest
    doc_id (null ids last), of several with that id the one whose text has the
    least hash.

    Defined cases: null, empty and wordless texts are one group; rows that
    repeat id and text are one row, any of them; of a group without ids one row
    stays; an empty table gives an empty one; other columns are passed on, whatever
    their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       F.col("doc_id").cast("long").alias("__id"), _tag(F.col("text").cast("string")).alias("__tag"))
    fps = cut_lineage(fingerprints(docs, shingle))
    own = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first"))
    best = own.join(_components(fps, radius, HOT, CHUNK), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = best.select(F.col("first.doc_id").alias("k_id"), F.col("first.tag").alias("k_tag"))
    many = fps.groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1")
    kept = cut_lineage(kept.join(many, F.col("k_id").eqNullSafe(F.col("doc_id")) & (F.col("k_tag") == F.col("tag")), "left").select(
        "k_id", "k_tag", F.col("n").isNotNull().alias("again")))
    match = rows["__id"].eqNullSafe(kept["k_id"]) & (rows["__tag"] == kept["k_tag"])
    out = rows.join(kept.where("not again"), match, "left_semi").select("__row")
    if kept.where("again").head(1):      # rows that repeat: one of them, found before the shuffle as far as a task has several
        some = rows.join(kept.where("again"), match, "left_semi")
        out = out.unionByName(some.groupBy("__id", "__tag").agg(F.first("__row").alias("__row")).select("__row"))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
