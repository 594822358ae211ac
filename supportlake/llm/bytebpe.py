"""Byte-level BPE encoding and decoding by DuckDB queries inside each task.

* Split: a text's pre-tokens are the matches of the split pattern.
* Encode: every new distinct pre-token becomes rows (word, position, token),
  one per byte.  A recursive query joins neighbouring rows with the merge
  table and contracts each word's leftmost pair of least rank, until no pair
  of the word is in the table.  A pre-token that is itself in the vocabulary
  is that token.
* Decode: ids joined with the vocabulary, one ordered aggregation per text.

Each Python worker has one in-memory database with one thread, a memory limit
and no spill file; what a query is given is bounded.  Ids are cached per
pre-token and per stretch between blanks; the caches are bounded and long
stretches are not cached.

A pre-token of over LONG_WORD bytes is cut into windows that are contracted
alone, which is right wherever no merge crosses a cut.  Two tokens that stand
side by side fit if contracting the bytes of both gives just these two.  Tokens
whose neighbours all fit are the contraction of the whole: the first merge over
a boundary would also be the next one when the two tokens around it are
contracted alone.  So every seam between windows is tested, and the tokens
around a seam that does not fit are contracted together, more of them each
time.  A word in which that does not settle (long periodic ones) is contracted
from left to right, a stretch at a time, each begun among the last tokens
settled.  Stretches go through a second query, which contracts all occurrences
of the least rank in one step (left to right, not overlapping) for tokens in no
pair whose merge ranks lower ("safe", looked up in the merge table): after such
a merge no pair ranks below the occurrences left over.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.stretches import Stretches, runs_of

CACHE_PIECES = 300_000       # of a generation; the one before it is kept to draw from
LONGEST_CACHED = 64
LONG_WORD = 256              # bytes
WINDOW = 48                  # bytes of a long word contracted alone
ROUNDS = 6                   # times that the tokens around a seam are contracted, twice as many each time
STRETCH = 2048               # bytes contracted at once from left to right
CONTEXT = 8                  # settled tokens that a stretch begins with
QUERY_BYTES = 1_000_000      # bytes of words in one query
QUERY_TOKENS = 1_000_000     # tokens decoded in one query
BATCH_CHARS = 2_000_000      # texts taken together
MEMORY = "300MB"
_ODD_BLANKS = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")     # a match never goes on over such a blank, and one begins with it

# a word's tokens stand in a list and are rows (word, position, token) where they meet the merge table
_SHORT = """
WITH RECURSIVE s(w, toks, done) AS (
  SELECT w, toks, false FROM start
  UNION ALL (
    WITH live AS (SELECT w, toks FROM s WHERE NOT done),
    pair AS (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(len(toks) - 1)) AS pos FROM live),
    best AS (SELECT w, min(m.merged::BIGINT << 32 | pos) AS k FROM pair JOIN merges m ON m.l = pair.l AND m.r = pair.r GROUP BY w)
    SELECT live.w, CASE WHEN k IS NULL THEN toks
      ELSE toks[:k & 4294967295] || [(k >> 32)::INTEGER] || toks[(k & 4294967295) + 3:] END, k IS NULL
    FROM live LEFT JOIN best ON best.w = live.w))
SELECT w, toks FROM s WHERE done ORDER BY w
"""

_LONG = """
WITH RECURSIVE s(w, pos, tok, done) AS (
  SELECT w, unnest(range(len(toks)))::INTEGER, unnest(toks), false FROM start
  UNION ALL (
    WITH live AS (SELECT w, pos, tok, lead(tok) OVER o AS nxt FROM s WHERE NOT done WINDOW o AS (PARTITION BY w ORDER BY pos)),
    pair AS (SELECT l.*, m.merged FROM live l LEFT JOIN merges m ON m.l = l.tok AND m.r = l.nxt),
    best AS (SELECT w, min(merged) AS least, arg_min(pos, merged::BIGINT << 32 | pos) AS first FROM pair GROUP BY w),
    hit AS (SELECT p.*, least, first, coalesce(merged = least, false) AS h,
        pos - row_number() OVER (PARTITION BY p.w, coalesce(merged = least, false) ORDER BY pos) AS run
      FROM pair p JOIN best USING (w)),
    turn AS (SELECT *, h AND (CASE WHEN least IN (SELECT tok FROM unsafe) THEN pos = first
        ELSE row_number() OVER (PARTITION BY w, h, run ORDER BY pos) % 2 = 1 END) AS takes FROM hit),
    gone AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY w ORDER BY pos), false) AS eaten FROM turn)
    SELECT w, (row_number() OVER (PARTITION BY w ORDER BY pos) - 1)::INTEGER, CASE WHEN takes THEN least ELSE tok END, least IS NULL
    FROM gone WHERE NOT eaten))
SELECT w, list(tok ORDER BY pos) AS toks FROM s WHERE done GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class _Generations(dict):
    """A bounded cache: when it is full it becomes the old generation, from
    which entries still in use are taken over."""

    old: dict = {}

    def turn(self) -> None:
        if len(self) > CACHE_PIECES:
            self.old = dict(self)
            self.clear()

    def missing(self, keys) -> list:
        """Those of ``keys`` in neither generation."""
        out = []
        for k in keys:
            if k not in self:
                if (v := self.old.get(k)) is None:
                    out.append(k)
                else:
                    self[k] = v
        return out


class Codec:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex

        self._np, self._pa = np, pa
        self.ranks = ranks = read_ranks(path)
        self._raw = {n: b for b, n in ranks.items()}
        self._find = regex.compile(pattern).findall
        self._db = db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        vocab = pa.table({"tok": pa.array(ranks.values(), pa.int32()), "chars": [b.decode("latin-1") for b in ranks]})
        merges = [(ranks[b[:i]], ranks[b[i:]], n) for b, n in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        cols = list(zip(*merges)) if merges else ([], [], [])
        merged = pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("l", "r", "merged"), cols)})
        for name, table in (("vocab", vocab), ("merges", merged)):
            db.register("given", table)
            db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            db.unregister("given")
        db.execute("CREATE TABLE unsafe AS SELECT DISTINCT unnest([l, r]) AS tok FROM merges WHERE merged <= greatest(l, r)")
        self._byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # a stretch between blanks stands alone only if the pattern lets a match take the blank before it and none after it
        self._by_blank = pattern == _BLANK_FIRST
        self._words = _Generations()
        self._new, self._old = Stretches(), Stretches()
        self._fits: dict[tuple[int, int], bool] = {}

    def _contract(self, words: list[bytes], query: str = _SHORT) -> list[bytes]:
        """Little-endian 32-bit ids of every word, in queries of bounded size."""
        import pyarrow.compute as pc

        np, pa = self._np, self._pa
        out: list[bytes] = []
        for x, y in runs_of([len(b) for b in words], QUERY_BYTES):
            part = words[x:y]
            raw = self._byte[np.frombuffer(b"".join(part), np.uint8)]
            ends = np.cumsum([0, *map(len, part)]).astype(np.int32)
            self._db.register("start", pa.table({"w": np.arange(len(part), dtype=np.int32), "toks": pa.ListArray.from_arrays(ends, raw)}))
            got = self._db.sql(query).to_arrow_table()["toks"].combine_chunks()
            self._db.unregister("start")
            tok = got.flatten().to_numpy().astype("<u4").tobytes()
            ends = (np.r_[0, np.cumsum(pc.list_value_length(got).to_numpy())] * 4).tolist()
            out += [tok[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def _tokens(self, words: list[bytes], query: str = _SHORT) -> list[list[int]]:
        return [self._np.frombuffer(b, "<u4").tolist() for b in self._contract(words, query)]

    def _bytes(self, tokens: list[int]) -> bytes:
        return b"".join(map(self._raw.__getitem__, tokens))

    def _ask(self, pairs) -> None:
        """Find out which of ``pairs`` (two tokens side by side) fit."""
        if len(self._fits) > CACHE_PIECES:
            self._fits = {}
        new = sorted({p for p in pairs if p not in self._fits})
        for p, t in zip(new, self._tokens([self._bytes(list(p)) for p in new])):
            self._fits[p] = t == list(p)

    def _long(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of over LONG_WORD bytes."""
        cut = [[w[i:i + WINDOW] for i in range(0, len(w), WINDOW)] for w in words]
        alone = iter(self._tokens([x for c in cut for x in c]))
        tokens, seams = [], []
        for c in cut:
            own, places = [], []
            for _ in c:
                places.append(len(own))
                own += next(alone)
            tokens.append(own)
            seams.append(places[1:])     # a seam stands before its token
        for turn in range(ROUNDS):
            self._ask((t[s - 1], t[s]) for t, places in zip(tokens, seams) for s in places)
            reach = CONTEXT // 2 << turn
            spots = []                   # (word, from, to): tokens to be contracted together
            for i, (t, places) in enumerate(zip(tokens, seams)):
                for s in places:
                    if not self._fits[t[s - 1], t[s]]:
                        a, b = max(0, s - reach), min(len(t), s + reach)
                        if spots and spots[-1][0] == i and spots[-1][2] >= a:
                            spots[-1] = (i, spots[-1][1], b)
                        else:
                            spots.append((i, a, b))
            seams = [[] for _ in tokens]
            # a stretch for which one step a merge is too many is left to the second way
            now = [x for x in spots if x[2] - x[1] <= 2 * LONG_WORD]
            for x in spots:
                if x[2] - x[1] > 2 * LONG_WORD:
                    seams[x[0]] = None
            fresh = self._tokens([self._bytes(tokens[i][a:b]) for i, a, b in now])
            done: dict[int, list[int]] = {}
            last: dict[int, int] = {}
            for (i, a, b), new in zip(now, fresh):
                out = done.setdefault(i, [])
                out += tokens[i][last.get(i, 0):a]
                if seams[i] is not None:
                    seams[i] += [s for s in (len(out), len(out) + len(new)) if s]
                out += new
                last[i] = b
            for i, out in done.items():
                out += tokens[i][last[i]:]
                if seams[i] is not None:
                    seams[i] = sorted({s for s in seams[i] if s < len(out)})
                    tokens[i] = out
            if not any(s is None or s for s in seams):
                break
            for i, s in enumerate(seams):
                if s is None:
                    tokens[i] = self._from_left(words[i])
                    seams[i] = []
        else:
            self._ask((t[s - 1], t[s]) for t, places in zip(tokens, seams) for s in places)
            for i, places in enumerate(seams):
                if not all(self._fits[tokens[i][s - 1], tokens[i][s]] for s in places):
                    tokens[i] = self._from_left(words[i])
        return [self._np.array(t, "<u4").tobytes() for t in tokens]

    def _from_left(self, word: bytes) -> list[int]:
        """Tokens of a word, contracted a stretch at a time."""
        out: list[int] = []
        at = 0
        while at < len(word):
            end, back = min(len(word), at + STRETCH), CONTEXT
            while True:
                head = out[-back:]
                (new,) = self._tokens([self._bytes(head) + word[at:end]], _LONG)
                keep = len(out) - len(head)
                if keep:
                    self._ask([(out[keep - 1], new[0])])
                if not keep or self._fits[out[keep - 1], new[0]]:
                    break
                back *= 2
            out[keep:] = new
            at = end
        return out

    def _learn(self, words) -> dict[str, bytes]:
        """Ids of distinct pre-tokens: the vocabulary first, then the queries."""
        out, short, long = {}, [], []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                out[w] = rank.to_bytes(4, "little")
            else:
                (long if len(raw) > LONG_WORD else short).append((w, raw))
        for some, ids_of in ((short, self._contract), (long, self._long)):
            out.update(zip((w for w, _ in some), ids_of([b for _, b in some]) if some else ()))
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of stretches that stand alone."""
        self._words.turn()
        words = self._words
        split = list(map(self._find, pieces))
        asked = words.missing({w for ws in split for w in ws})
        words.update(self._learn(asked))
        out = [words[ws[0]] if len(ws) == 1 else b"".join(map(words.__getitem__, ws)) for ws in split]
        for w in asked:
            if len(w) > LONGEST_CACHED:
                del words[w]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids per text."""
        np, pa = self._np, self._pa
        import pyarrow.compute as pc

        if not self._by_blank:
            found = [self._find(t) for t in texts]
            distinct = list(dict.fromkeys(w for ws in found for w in ws))
            ids = dict(zip(distinct, self._ids(distinct)))
            return [b"".join(map(ids.__getitem__, ws)) for ws in found]
        # stretches between blanks: the first of a text, and the others without the blank that each begins with
        plain = [i for i, t in enumerate(texts) if not _ODD_BLANKS.search(t)]
        odd = sorted(set(range(len(texts))) - set(plain))
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        cut = [_CUT.split(texts[i]) for i in odd]
        stretches = pa.concat_arrays([lists.flatten().cast(pa.large_string()), pa.array([x for c in cut for x in c], pa.large_string())])
        counts = np.concatenate([pc.list_value_length(lists).to_numpy(zero_copy_only=False), [len(c) for c in cut]]).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        rest = np.ones(len(stretches), bool)
        rest[firsts] = False
        heads = self._ids(stretches.take(pa.array(firsts)).to_pylist())
        coded = stretches.filter(pa.array(rest)).dictionary_encode()
        tokens, n = self._new_of(coded)
        upto = np.r_[0, np.cumsum(n)]
        at = firsts - np.arange(len(firsts))             # the same places without the first stretches
        out: list[bytes] = [b""] * len(texts)
        for i, head, a, b in zip(plain + odd, heads, upto[at].tolist(), upto[at + counts - 1].tolist()):
            out[i] = head + tokens[a:b].tobytes()
        return out

    def _new_of(self, coded):
        """(tokens, their numbers) of a dictionary-coded array of stretches,
        which stand there without the blank that each begins with."""
        if len(self._new.keys) > CACHE_PIECES:
            self._old, self._new = self._new, Stretches()
        def ids_of(new):
            ids = self._ids([" " + x for x in new])
            return self._np.frombuffer(b"".join(ids), "<u4"), self._np.fromiter(map(len, ids), "int64", len(ids)) // 4

        places, keep = self._new.places(coded.dictionary, self._old, LONGEST_CACHED, ids_of)
        got = self._new.of(places[coded.indices.to_numpy()])
        self._new.cut(keep)
        return got

    def encode_whole(self, text: str) -> bytes:
        """Ids of one text of any length, cut before blanks into parts of
        about BATCH_CHARS (elsewhere a text is one part)."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + BATCH_CHARS) if self._by_blank else None
            end = cut.start() if cut else len(text)
            out += self.encode([text[at:end]])
            at = end
        return b"".join(out)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of texts given as little-endian unsigned 32-bit ids."""
        np, pa = self._np, self._pa
        parts = [(i, b[a:a + 4 * QUERY_TOKENS]) for i, b in enumerate(ids) for a in range(0, len(b), 4 * QUERY_TOKENS)]
        out: list[list[bytes]] = [[] for _ in ids]
        for x, y in runs_of([len(b) for _, b in parts], 4 * QUERY_TOKENS):
            some = parts[x:y]
            n = np.array([len(b) // 4 for _, b in some], np.int64)
            tok = np.frombuffer(b"".join(b for _, b in some), "<u4").astype(np.int32)
            rows = pa.table({"d": np.repeat(np.arange(len(some), dtype=np.int32), n), "i": np.arange(len(tok), dtype=np.int32), "tok": tok})
            self._db.register("given", rows)
            got = self._db.execute("SELECT d, string_agg(chars, '' ORDER BY i), count(*) FROM given JOIN vocab USING (tok) GROUP BY d ORDER BY d").fetchall()
            self._db.unregister("given")
            if [m for _, _, m in got] != n.tolist():
                raise ValueError("an id is not in the vocabulary")
            for d, chars, _ in got:
                out[some[d][0]].append(chars.encode("latin-1"))
        return list(map(b"".join, out))


# the pattern for which stretches may be cut at blanks (fixed value)
_BLANK_FIRST = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OPEN: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per Python worker and file."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = Codec(path, pattern)
    return _OPEN[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit."""
    return _through(docs, ranks, pattern, id_col, text_col, False)


def roundtrip_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and
    its ids decoded again, in one pass.

    Defined cases: null and empty texts have no ids (digests of no bytes);
    repeated rows and null ids come back as they are; an empty table gives an
    empty one; other columns are not looked at."""
    return _through(docs, ranks, pattern, id_col, text_col, True)


def _through(docs, ranks, pattern, id_col, text_col, digests):
    def batches(it):
        import hashlib

        import pyarrow as pa
        import pyarrow.compute as pc

        c = codec(ranks, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in it:
            ids = b.column(0)
            sizes = [0 if t is None else t for t in pc.binary_length(b.column(1)).to_pylist()]
            for x, y in runs_of(sizes, BATCH_CHARS):
                texts = [t or "" for t in b.column(1).slice(x, y - x).to_pylist()]
                codes = c.encode(texts) if len(texts) > 1 else [c.encode_whole(texts[0])]
                n = pa.array([len(k) // 4 for k in codes], pa.int64())
                if digests:
                    back = c.decode(codes)
                    yield pa.RecordBatch.from_arrays([ids.slice(x, y - x), n, pa.array(map(sha, codes), pa.string()), pa.array(map(sha, back), pa.string())],
                                                     ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([ids.slice(x, y - x), n, pa.array(codes, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    return rows.mapInArrow(batches, f"doc_id long, n_tokens long, {rest}")


def decode(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids)."""

    def batches(it):
        import pyarrow as pa

        c = codec(ranks, pattern)
        for b in it:
            codes = [x or b"" for x in b.column(1).to_pylist()]
            for x, y in runs_of([len(k) for k in codes], 4 * BATCH_CHARS):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(c.decode(codes[x:y]), pa.binary())], ["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(batches, "doc_id long, bytes binary")
