"""Byte-level BPE by a pair occurrence index.

All distinct words of a partition are encoded together.  An index maps each mergeable pair to the
positions at which it stands; the ranks that occur are applied in ascending order, each at all of its
positions, and only the two pairs beside a merge are looked up again.  A merge makes pairs of higher rank
only, so one ascending sweep gives what merging word by word gives.

The vocabulary file is read once on the driver and travels as two small integer arrays (its size is fixed
by the vocabulary, not by the data).
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np

#: Fixed value: the public pattern that splits text into words before any merge.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A pair with at least this many positions is merged with array operations, a rarer one in a loop.
ARRAY_MERGE_FROM = 48


def default_folder() -> str:
    """The folder with the vocabulary files: ``TESSEL_TOKENIZERS`` or /opt/tokenizers."""
    return os.environ.get("TESSEL_TOKENIZERS", "/opt/tokenizers")


def _byte_of_sign() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabulary files: printable Latin-1 signs
    stand for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class BpeVocabulary:
    """``byte_ids``: id of each byte; ``left``, ``right``, ``made``: the merges in ascending rank."""

    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    rank_of: dict[int, int] = field(default_factory=dict, compare=False, repr=False)

    @staticmethod
    def load(name: str = "byte_bpe_50k", folder: str | None = None) -> BpeVocabulary:
        with open(os.path.join(folder or default_folder(), f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, signs = model["vocab"], _byte_of_sign()
        byte_ids = np.zeros(256, np.int32)
        for sign, b in signs.items():
            byte_ids[b] = ids[sign]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return BpeVocabulary(
            byte_ids,
            np.array([ids[a] for a, _ in pairs], np.int32),
            np.array([ids[b] for _, b in pairs], np.int32),
            np.array([ids[a + b] for a, b in pairs], np.int32),
        ).checked()

    def checked(self) -> BpeVocabulary:
        """This vocabulary, if the pairs that a merge makes can only have higher ranks than the merge, as the sweep needs.

        A pair has what a merge has made only if it is looked up after it, so no part of a merge may be made by a later one,
        and no pair or result may occur twice."""
        made_at = {int(c): rank for rank, c in enumerate(self.made)}
        if len(made_at) != len(self.made) or len(self.ranks()) != len(self.made):
            raise ValueError("a merge stands twice in the vocabulary")
        for rank, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            if max(made_at.get(a, -1), made_at.get(b, -1)) >= rank:
                raise ValueError(f"merge {rank} needs the result of a later one")
        return self

    def ranks(self) -> dict[int, int]:
        """Rank by ``left << 32 | right``; built once in each process."""
        if not self.rank_of:
            keys = (self.left.astype(np.int64) << 32 | self.right).tolist()
            for rank in range(len(keys) - 1, -1, -1):
                self.rank_of[keys[rank]] = rank
        return self.rank_of

    def arrays(self) -> tuple[np.ndarray, ...]:
        """What has to travel; ``BpeVocabulary(*arrays)`` makes the vocabulary again."""
        return self.byte_ids, self.left, self.right, self.made


class PairIndexEncoder:
    """Encodes words with a vocabulary; keeps the lookup tables between calls."""

    def __init__(self, vocabulary: BpeVocabulary):
        self.v = vocabulary
        keys = vocabulary.left.astype(np.int64) << 32 | vocabulary.right
        order = np.argsort(keys, kind="stable")
        self.sorted_keys, self.sorted_ranks = keys[order], order.astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has no merge."""
        if not len(self.sorted_keys) or not len(left):
            return np.full(len(left), -1, np.int64)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == keys, self.sorted_ranks[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word begins (one entry more than words)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        total = int(lengths.sum())
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(lengths, out=starts[1:])
        if not total:
            return np.zeros(0, np.int32), starts
        tok = self.v.byte_ids[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        nxt = np.arange(1, total + 1, dtype=np.int32)
        prv = np.arange(-1, total - 1, dtype=np.int32)
        full = lengths > 0
        nxt[starts[1:][full] - 1] = -1
        prv[starts[:-1][full]] = -1
        self._sweep(tok, nxt, prv)
        alive = tok >= 0
        upto = np.zeros(total + 1, np.int64)
        np.cumsum(alive, out=upto[1:])
        return tok[alive], upto[starts]

    def _sweep(self, tok: np.ndarray, nxt: np.ndarray, prv: np.ndarray) -> None:
        v, get = self.v, self.v.ranks().get
        pos = np.flatnonzero(nxt >= 0)
        ranks = self.pair_ranks(tok[pos], tok[pos + 1])
        pos, ranks = pos[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        pos, ranks = pos[order], ranks[order]
        edges = np.searchsorted(ranks, np.arange(len(v.made) + 1))
        first, later = edges.tolist(), [None] * len(v.made)
        t, n, p = memoryview(tok), memoryview(nxt), memoryview(prv)
        lefts, rights, mades = v.left.tolist(), v.right.tolist(), v.made.tolist()
        for rank in range(len(mades)):
            more = later[rank]
            lo, hi = first[rank], first[rank + 1]
            if more is None and lo == hi:
                continue
            later[rank] = None
            a, b, c = lefts[rank], rights[rank], mades[rank]
            size = hi - lo + sum(map(len, more or ()))
            if size >= ARRAY_MERGE_FROM and a != b:
                at = np.concatenate([pos[lo:hi], *(np.asarray(x, np.int64) for x in more or ())])
                self._merge_array(at, a, b, c, tok, nxt, prv, later)
                continue
            at = pos[lo:hi].tolist()
            for x in more or ():
                at.extend(x if isinstance(x, list) else x.tolist())
            if a == b:
                at.sort()
            for i in at:
                j = n[i]
                if t[i] != a or j < 0 or t[j] != b:
                    continue
                k, h = n[j], p[i]
                t[i], t[j], n[i] = c, -1, k
                if k >= 0:
                    p[k] = i
                    r = get(c << 32 | t[k])
                    if r is not None:
                        if (x := later[r]) is None:
                            later[r] = [[i]]
                        elif isinstance(x[-1], list):
                            x[-1].append(i)
                        else:
                            x.append([i])
                if h >= 0:
                    r = get(t[h] << 32 | c)
                    if r is not None:
                        if (x := later[r]) is None:
                            later[r] = [[h]]
                        elif isinstance(x[-1], list):
                            x[-1].append(h)
                        else:
                            x.append([h])

    def _merge_array(self, at, a, b, c, tok, nxt, prv, later) -> None:
        """Merges a pair of two different tokens at many positions at once; its positions cannot overlap."""
        at = np.unique(at)
        j = nxt[at]
        ok = (tok[at] == a) & (j >= 0)
        at, j = at[ok], j[ok]
        ok = tok[j] == b
        at, j = at[ok], j[ok]
        if not len(at):
            return
        k = nxt[j]
        tok[at], tok[j], nxt[at] = c, -1, k
        right = k >= 0
        prv[k[right]] = at[right]
        h = prv[at]
        beside = [at[right], h[h >= 0].astype(np.int64)]
        beside = np.unique(np.concatenate(beside)) if len(at) > 1 else np.concatenate(beside)
        ranks = self.pair_ranks(tok[beside], tok[nxt[beside]])
        ok = ranks >= 0
        beside, ranks = beside[ok], ranks[ok]
        if not len(beside):
            return
        order = np.argsort(ranks, kind="stable")
        beside, ranks = beside[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        heads = ranks[bounds[:-1]].tolist()
        for r, lo, hi in zip(heads, bounds, bounds[1:]):
            part = beside[lo:hi] if hi - lo >= ARRAY_MERGE_FROM else beside[lo:hi].tolist()
            if later[r] is None:
                later[r] = [part]
            else:
                later[r].append(part)
