"""Distinct stretches of text with their token ids, looked up by the batch in
Arrow arrays, and cuts of a batch into parts of bounded size."""

from __future__ import annotations


class Stretches:
    """Stretches (an Arrow array) with their tokens, looked up by the batch."""

    def __init__(self):
        import numpy as np
        import pyarrow as pa

        self.keys = pa.array([], pa.large_string())
        self.begin, self.size, self.tokens = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def find(self, names):
        """Places of ``names``, -1 for those that are not here."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(names, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype("int64")

    def add(self, names, size, tokens) -> None:
        import numpy as np
        import pyarrow as pa

        self.begin = np.concatenate([self.begin, len(self.tokens) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.tokens = np.concatenate([self.tokens, tokens])
        self.keys = pa.concat_arrays([self.keys, names])

    def places(self, names, old: "Stretches", longest: int, ids_of):
        """(places of distinct ``names``, number of entries to keep).  Names
        that are not here come from ``old`` or ``ids_of`` a list of them (their
        tokens one after another, their numbers); those of over ``longest``
        characters stand last, to be cut off once their tokens were taken."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = self.find(names)
        left = np.flatnonzero(out < 0)
        keep = len(self.keys)
        if len(left):
            asked = names.take(pa.array(left))
            long = pc.greater(pc.utf8_length(asked), longest).to_numpy(zero_copy_only=False)
            known = old.find(asked)
            order = np.argsort(np.where(long, 2, np.where(known >= 0, 0, 1)), kind="stable")
            of_old = int((~long & (known >= 0)).sum())
            asked = asked.take(pa.array(order))
            tokens, size = old.of(known[order[:of_old]])
            new, count = ids_of(asked.slice(of_old).to_pylist())
            out[left[order]] = keep + np.arange(len(order))
            self.add(asked, np.concatenate([size, count]), np.concatenate([tokens, new]))
            keep += int((~long).sum())
        return out, keep

    def cut(self, n: int) -> None:
        """Forget all but the first ``n``."""
        self.keys, self.begin, self.size = self.keys.slice(0, n), self.begin[:n], self.size[:n]
        self.tokens = self.tokens[:int(self.begin[-1] + self.size[-1]) if n else 0]

    def of(self, places):
        """(tokens of ``places`` one after another, their numbers)."""
        import numpy as np

        n = self.size[places]
        upto = np.cumsum(n)
        return self.tokens[np.repeat(self.begin[places] - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)], n


def runs_of(sizes: list[int], most: int):
    """Index ranges whose sizes add up to at most ``most`` (or hold one item)."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)
