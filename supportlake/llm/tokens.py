"""Token ids of whole texts from a public tokenizer file, inside tasks.

A blank (space or newline) always ends a pre-token of this kind of tokenizer
(its split pattern never matches white space and its normaliser is blind to
what stands on the other side of one), so the ids of a text are the ids of its
stretches between blanks in order.  Stretches of ASCII and Latin-1 letters,
the most by far, are lower-cased and split here, and every distinct pre-token
goes once through the tokenizer's own model; a piece between blanks with any
other character goes through ``encode``.  The caches hold a bounded number of
pre-tokens and pieces, and long pieces are never cached.

Texts are taken by the batch (``column_ids``): the pieces of all texts of a
batch become a dictionary-coded Arrow array, so Python sees each distinct piece
of a batch once, and ids are put together by array lookups.
"""

from __future__ import annotations

import json
import re

from supportlake.llm.stretches import Stretches, runs_of

CACHE_WORDS = 250_000        # of a generation; the one before it is kept to draw from
CACHE_PIECES = 100_000
CACHE_STRETCHES = 150_000
BATCH_CHARS = 2_000_000      # texts taken together
LONGEST_CACHED = 64
STRETCH = 1 << 20            # characters split at once
_END = 0xFFFFFFFF            # no id: stands for the end of a piece
_ODD = re.compile(r"[^\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]|<\|")
_BLANK = re.compile(r"[ \n]")


class _Generations(dict):
    """A bounded cache: when it is full it becomes the old generation, from
    which entries still in use are taken over."""

    most = CACHE_PIECES
    old: dict = {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class _Words(_Generations):
    """Pre-token -> little-endian 32-bit ids."""

    most = CACHE_WORDS

    def __init__(self, model, size: int):
        self._tokenize = model.tokenize
        self._four = [i.to_bytes(4, "little") for i in range(size)]
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in kept]
        # the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
        self._alphabet = {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(rest)}}

    def __missing__(self, word: str) -> bytes:
        if word == "\n":
            return _END.to_bytes(4, "little")
        out = self.old.get(word)
        if out is None:
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self._alphabet)
            four = self._four
            out = b"".join([four[t.id] for t in self._tokenize(spelled)])
        if len(word) <= LONGEST_CACHED:
            self[word] = out
        return out


class _Pieces(_Generations):
    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self._np = np
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_blank = _drops_blanks(spec)
        self._words = None
        self._new, self._old = Stretches(), Stretches()
        if self.by_blank:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            # on plain stretches, lower-cased, the letter and digit classes are these; letters first, as no
            # other alternative begins with one
            pattern = pattern.replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9")
            self._split_lines = re.compile("[a-zß-öø-ÿ]+|\n|" + pattern)
            self._words = _Words(self._tokenizer.model, self._tokenizer.get_vocab_size())

    def whole(self, text: str) -> bytes:
        return self._np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.whole(piece)
        if len(piece) <= LONGEST_CACHED:
            self[piece] = out
        return out

    def _piece_ids(self, pieces: list[str]):
        """(ids one after another, numbers) of pieces without blanks."""
        np = self._np
        self.turn()
        odd = {}
        joined = "\n".join([*pieces, ""])
        if _ODD.search(joined):
            odd = {i: self[p] for i, p in enumerate(pieces) if _ODD.search(p)}
            joined = "\n".join([*("" if i in odd else p for i, p in enumerate(pieces)), ""])
        self._words.turn()
        # the pre-tokens of all pieces, each piece closed by its line's end
        ids = np.frombuffer(b"".join(map(self._words.__getitem__, self._split_lines.findall(joined.lower()))), "<u4")
        ends = np.flatnonzero(ids == _END)
        size = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != _END]
        if odd:
            at = (np.cumsum(size) - size)[list(odd)]
            more = [np.frombuffer(x, "<u4") for x in odd.values()]
            ids = np.insert(ids, np.repeat(at, list(map(len, more))), np.concatenate(more))
            size[list(odd)] = list(map(len, more))
        return ids, size

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self._np
        if not self.by_blank:
            return [self.whole(t) for t in texts]
        lists = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().cast(pa.large_string()).dictionary_encode()
        if len(self._new.keys) > CACHE_STRETCHES:
            self._old, self._new = self._new, Stretches()
        places, keep = self._new.places(coded.dictionary, self._old, LONGEST_CACHED, self._piece_ids)
        tokens, n = self._new.of(places[coded.indices.to_numpy()])
        self._new.cut(keep)
        upto = np.r_[0, np.cumsum(n)]
        cuts = upto[np.r_[0, ends]].tolist()
        return [tokens[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def parts(self, text: str) -> list[str]:
        """A text cut at blanks into parts of about STRETCH characters."""
        out, at = [], 0
        while self.by_blank and len(text) - at > STRETCH and (m := _BLANK.search(text, at + STRETCH)):
            out.append(text[at:m.start()])
            at = m.end()
        return [*out, text[at:]]


def _drops_blanks(spec: dict) -> bool:
    """True for the one layout the piece cache is right for: lower-casing,
    white space dropped by the split pattern, byte-level words with an end
    mark.  Anything else is encoded text by text."""
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [])
    norm = (spec.get("normalizer") or {}).get("normalizers", [])
    return (
        [n.get("type") for n in norm] == ["NFC", "Replace", "Lowercase"]
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0].get("invert") is True and parts[0].get("behavior") == "Removed"
        and parts[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex", True)
        and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        and all(t.get("special") and not t.get("normalized") and not t.get("lstrip") and not t.get("rstrip")
                and t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    )


_OPEN: dict[str, _Pieces] = {}


def column_ids(path: str, chars: int = BATCH_CHARS):
    """``Arrow column of texts -> iterator of bytes``: little-endian unsigned
    32-bit ids of each (a null is an empty text), about ``chars`` characters
    taken at once."""
    if path not in _OPEN:
        _OPEN[path] = _Pieces(path)
    pieces = _OPEN[path]

    def each(column):
        import pyarrow.compute as pc

        sizes = [n or 0 for n in pc.binary_length(column).to_pylist()]
        for a, b in runs_of(sizes, chars):
            texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
            if len(texts) > 1:
                yield from pieces.batch(texts)
            else:
                yield b"".join(x for part in pieces.parts(texts[0]) for x in pieces.batch([part]))

    return each
