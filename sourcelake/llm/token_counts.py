"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens over whose borders no piece reaches.  The
distinct pre-tokens of a chunk lie behind one another in one flat numpy array
(a ragged batch).  In each round every sequence finds its lowest-ranked pair,
all sequences apply theirs at once, and the array is compacted; what remains
when no sequence has a pair left is the count of symbols.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sourcelake.llm import pieces
from sourcelake.llm.common import id_text, map_texts

NONE = np.int64(1) << 62
#: Distinct pre-tokens whose counts a task remembers; others are counted again in each chunk.
REMEMBERED = 500_000
#: Pre-tokens in one ragged batch.
BATCH = 16_384


class Merges:
    """Merge table of a BPE model as sorted arrays, and the merging itself."""

    def __init__(self, model: pieces.Pieces):
        self.model = model
        symbols = sorted(set(model.id) | {c for raw in model.id for c in raw})
        self.symbol = {s: i for i, s in enumerate(symbols)}
        width = self.width = len(symbols) + 1  # one more for characters that no piece has
        # symbols that stand for no piece fall apart into bytes
        self.cost = np.array([1 if s in model.id else len(s.encode()) for s in symbols] + [0])
        self.of_char = np.full(0x110000, width - 1, dtype=np.int32)
        for s, i in self.symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        rank_of = {s: r for r, s in enumerate(sorted({-x for x in model.score.values()}))}
        rows = []
        for raw, score in model.score.items():
            for at in range(1, len(raw)):
                left, right = self.symbol.get(raw[:at]), self.symbol.get(raw[at:])
                if left is not None and right is not None:
                    rows.append((left * width + right, rank_of[-score], self.symbol[raw]))
        rows.sort()
        self.key, self.rank, self.made = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        # a merge may be applied at several places at once if what it makes takes part in later ranks only
        least = np.full(width, NONE)
        for side in (self.key // width, self.key % width):
            np.minimum.at(least, side, self.rank)
        self.at_once = least[self.made] > self.rank

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """Index into the merge table of each neighbouring pair, -1 for none."""
        return self.lookup(ids[:-1] * self.width + ids[1:])

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, at, -1)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        if not words:
            return np.zeros(0, dtype=np.int64)
        lens = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        ids = self.of_char[code].astype(np.int64)
        utf8 = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        extra = np.where(ids == self.width - 1, utf8, 0)
        row = np.repeat(np.arange(len(words)), lens)
        total = np.bincount(row, weights=extra, minlength=len(words)).astype(np.int64)
        pair = np.append(self.pairs(ids), -1)
        pair[np.flatnonzero(row[:-1] != row[1:])] = -1
        rank = self.rank_of(pair)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(ids)])
            live = best < NONE
            if not live.all():  # sequences without a pair are done
                keep = np.repeat(live, sizes)
                total += np.bincount(row[~keep], weights=self.cost[ids[~keep]], minlength=len(words)).astype(np.int64)
                ids, row, pair, rank = ids[keep], row[keep], pair[keep], rank[keep]
                sizes, best = sizes[live], best[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # in each sequence the leftmost pair sets which merge it is (ranks can be shared)
            lead = np.r_[True, row[hit[1:]] != row[hit[:-1]]]
            first = hit[lead]
            same = pair[hit] == np.repeat(pair[first], np.diff(np.r_[np.flatnonzero(lead), len(hit)]))
            hit = hit[lead | (same & self.at_once[pair[hit]])]
            # of overlapping places (aaa) every other one, from the left
            run = np.r_[True, np.diff(hit) != 1]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            ids[hit] = self.made[pair[hit]]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1  # where the merged symbols are from now on
            ids, row, pair, rank = ids[keep], row[keep], pair[keep], rank[keep]
            # only pairs with a merged symbol are new
            fresh = np.r_[at, np.maximum(at - 1, 0)]
            fresh = fresh[fresh < len(ids) - 1]
            found = self.lookup(ids[fresh] * self.width + ids[fresh + 1])
            found[row[fresh] != row[fresh + 1]] = -1
            pair[fresh], pair[-1] = found, -1
            rank[fresh], rank[-1] = self.rank_of(found), NONE
        return total

    def rank_of(self, pair: np.ndarray) -> np.ndarray:
        return np.where(pair >= 0, self.rank[pair], NONE)


@functools.lru_cache(maxsize=2)
def merges(model_file: str) -> Merges:
    return Merges(pieces.load(model_file))


def counter(model_file: str):
    """texts -> number of tokens of each, as the library encodes it."""
    table, known = merges(model_file), {}
    find = table.model.unit.findall

    def count(texts: list[str]) -> np.ndarray:
        split = [find(" " + t.replace("▁", " ")) if t else [] for t in texts]
        new = sorted(set().union(*split).difference(known), key=len)
        found = {}
        for lo in range(0, len(new), BATCH):
            found.update(zip(new[lo : lo + BATCH], table.counts(new[lo : lo + BATCH]).tolist(), strict=True))
        if len(known) + len(found) <= REMEMBERED:
            known.update(found)
            get = known.__getitem__
        else:
            get = lambda w: known[w] if w in known else found[w]
        return np.array([sum(map(get, words)) for words in split], dtype=np.int64)

    return count


def token_counts(df: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``df``.

    Counts are those of the SentencePiece library without begin and end tokens;
    strings like ``<s>`` inside a text are ordinary text.  A null or empty text
    has 0 bytes and 0 tokens.  Rows map one to one (repeated rows are counted
    again, a null id stays null); an empty table gives an empty one.
    """

    def make():
        count = counter(model_file)

        def fn(texts: list[str]) -> list[pa.Array]:
            n = count(texts)
            return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)]

        return fn

    return map_texts(id_text(df, id_col, text_col), make, "n_bytes long, n_tokens long, over_limit boolean")
