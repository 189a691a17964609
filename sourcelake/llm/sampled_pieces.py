"""SentencePiece encoding by sampling: forward filtering, backward sampling.

The lattice of a text has an edge for every piece that matches; no piece
reaches over the border of a unit (a run of spaces with the word behind it, or
a line end), so the lattice is the chain of its units' lattices.  Forward sums
are computed once for each distinct unit; sampling then walks all units of a
chunk backwards at once in numpy, one draw for each unit and step.  The draws
are a counter hash of (seed, row key, place in the text): a row's segmentation
depends on nothing but its key, its text and the seed.

A piece of rank r (the model's order) weighs ``(1 + r) ** -alpha``; a character
may also fall apart into its byte pieces, at the weight of a last piece for
each byte.  Spaces match as the model's space mark; a mark that stands in the
text itself matches no piece and becomes bytes, so decoding is lossless.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.llm import pieces
from sourcelake.llm.common import id_text, map_texts

#: Distinct units whose lattices a task remembers; beyond, it starts anew.
REMEMBERED = 100_000
#: Units whose lattices are built at once.
BATCH = 16_384
#: Characters of texts that are sampled at once.
AT_ONCE = 1_000_000
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's output function."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Lattices:
    """Edges of distinct units, each with its probability given the edge's end.

    A state is the end of a character of a unit; an edge leads back from a state
    to the one before the edge's piece (-1: the unit's begin).
    """

    def __init__(self, model: pieces.Pieces, alpha: float):
        self.model = model
        ranked = sorted(model.score, key=lambda raw: (-model.score[raw], model.id[raw]))
        chars = sorted({c for raw in ranked for c in raw})
        self.width = len(chars) + 1
        self.of_char = np.full(0x110000, len(chars), dtype=np.int32)
        self.of_char[[ord(c) for c in chars]] = np.arange(len(chars))
        # the pieces as a trie: (node, character) to node, as sorted arrays
        node, keys = {"": 0}, []
        for raw in ranked:
            for n in range(1, len(raw) + 1):
                if raw[:n] not in node:
                    node[raw[:n]] = len(node)
                    keys.append((node[raw[: n - 1]] * self.width + int(self.of_char[ord(raw[n - 1])]), node[raw[:n]]))
        keys.sort()
        self.key, self.node = (np.array(x, dtype=np.int64) for x in zip(*keys, strict=True))
        # what an edge emits: a piece, or (size + code point) the byte pieces of a character
        self.piece = np.full(len(node), -1, dtype=np.int64)
        self.log = np.zeros(len(node))
        for r, raw in enumerate(ranked):
            self.piece[node[raw]] = model.id[raw]
            self.log[node[raw]] = -alpha * math.log(1 + r)
        self.byte_log = -alpha * math.log(1 + len(ranked))
        self.forget()

    def forget(self) -> None:
        self.unit: dict[str, int] = {}
        self.end = np.zeros(0, dtype=np.int64)  # state of each unit's end
        self.states = 0
        self.line = np.zeros(0)  # state + share of the state's edges up to this one
        self.back = np.zeros(0, dtype=np.int32)
        self.emit = np.zeros(0, dtype=np.int32)

    def add(self, units: list[str]) -> None:
        lens = np.array([len(u) for u in units])
        code = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sym = self.of_char[code].astype(np.int64)
        last = np.cumsum(lens) - 1
        end_of = np.repeat(last, lens)
        at = np.arange(len(code))
        # byte edges, one for each character
        utf8 = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        edges = [(at, at, self.byte_log * utf8, self.model.size + code)]
        node = np.zeros(len(code), dtype=np.int64)
        tip = at
        while len(at):  # all begins follow the trie by one character
            want = node * self.width + sym[tip]
            k = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            on = self.key[k] == want
            at, tip, node = at[on], tip[on], self.node[k[on]]
            whole = self.piece[node] >= 0
            edges.append((at[whole], tip[whole], self.log[node[whole]], self.piece[node[whole]]))
            on = tip < end_of[at]
            at, tip, node = at[on], tip[on] + 1, node[on]
        begin, end, log, emit = (np.concatenate(x) for x in zip(*edges, strict=True))
        # forward sums: all units advance by one character at a time
        place = np.arange(len(code)) - np.repeat(last - lens + 1, lens)
        order = np.lexsort((end, place[end]))
        begin, end, log, emit = begin[order], end[order], log[order], emit[order]
        forward = np.zeros(len(code) + 1)  # of a begin: at its character; a unit's first stays 0
        share = np.empty(len(end))
        bounds = np.searchsorted(place[end], np.arange(int(lens.max()) + 1))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            state = end[lo:hi]
            first = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
            n = np.diff(np.r_[first, hi - lo])
            logs = forward[begin[lo:hi]] + log[lo:hi]
            top = np.maximum.reduceat(logs, first)
            parts = np.exp(logs - np.repeat(top, n))
            total = np.add.reduceat(parts, first)
            run = np.cumsum(parts)
            run -= np.repeat(run[first] - parts[first], n)
            run /= np.repeat(total, n)
            run[first + n - 1] = 1.0
            share[lo:hi] = run
            go = state[first]
            inner = go < end_of[go]
            forward[go[inner] + 1] = (top + np.log(total))[inner]
        order = np.argsort(end, kind="stable")
        begin, end, share, emit = begin[order], end[order], share[order], emit[order]
        inside = place[begin] > 0
        self.line = np.r_[self.line, self.states + end + share]
        self.back = np.r_[self.back, np.where(inside, self.states + begin - 1, -1).astype(np.int32)]
        self.emit = np.r_[self.emit, emit.astype(np.int32)]
        self.unit.update(zip(units, range(len(self.end), len(self.end) + len(units)), strict=True))
        self.end = np.r_[self.end, self.states + last]
        self.states += len(code)


class Sampler:
    def __init__(self, model_file: str, alpha: float, seed: int):
        self.table = Lattices(pieces.load(model_file), alpha)  # a task's own, so its memory ends with the task
        self.seed = mix(np.array([seed % (1 << 64)], dtype=U64))[0]

    def encode(self, keys: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts behind one another, and where each text's begin."""
        t = self.table
        find = t.model.unit.findall
        split = [find(" " + x) if x else [] for x in texts]
        if len(t.unit) > REMEMBERED:
            t.forget()
        new = sorted(set().union(*split).difference(t.unit), key=len)
        for lo in range(0, len(new), BATCH):
            t.add(new[lo : lo + BATCH])
        size = t.model.size
        counts = np.array([len(x) for x in split])
        doc = np.repeat(np.arange(len(texts)), counts)
        units = np.fromiter((t.unit[u] for x in split for u in x), dtype=np.int64, count=len(doc))
        place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        # one stream for each unit of each row
        stream = mix(mix(keys.astype(U64) ^ self.seed)[doc] + place.astype(U64))
        at, who, step, made = t.end[units], np.arange(len(doc)), 0, []
        while len(who):
            draw = (mix(stream[who] + U64(step)) >> U64(11)).astype(np.float64) / (1 << 53)
            edge = np.minimum(np.searchsorted(t.line, at + draw, side="right"), len(t.line) - 1)
            made.append((who.astype(np.int32), t.emit[edge]))
            at = t.back[edge].astype(np.int64)
            on = at >= 0
            who, at, step = who[on], at[on], step + 1
        steps = np.zeros(len(doc), dtype=np.int64)
        for who, _ in made:
            steps[who] += 1
        last = np.cumsum(steps)
        out = np.empty(int(last[-1]) if len(last) else 0, dtype=np.int64)
        for k, (who, e) in enumerate(made):
            out[last[who] - 1 - k] = e
        # emissions to ids: a character's bytes take several
        n = np.ones(len(out), dtype=np.int64)
        odd = np.flatnonzero(out >= size)
        spelled = [self.bytes_of(c) for c in (out[odd] - size).tolist()]
        n[odd] = [len(x) for x in spelled]
        ids = np.repeat(out, n).astype(np.int32)
        if len(odd):
            ids[np.repeat(np.cumsum(n)[odd] - n[odd], n[odd]) + np.concatenate([np.arange(len(x)) for x in spelled])] = np.concatenate(spelled)
        per_unit = np.add.reduceat(n, np.r_[0, last[:-1]]) if len(last) else np.zeros(0, dtype=np.int64)
        per_doc = np.bincount(doc, weights=per_unit, minlength=len(texts)).astype(np.int64)
        return ids, np.r_[0, np.cumsum(per_doc)]

    def bytes_of(self, code: int) -> list[int]:
        return [self.table.model.byte_id[b] for b in chr(code).encode()]


def decode(model_file: str, ids: list[int]) -> str:
    """The text that was encoded, whatever segmentation was drawn."""
    return spelled(model_file)(np.asarray(ids, dtype=np.int64))


def spelled(model_file: str):
    model = pieces.load(model_file)
    raw = [b""] * model.size
    for text, i in model.id.items():
        raw[i] = text.encode()
    for b, i in enumerate(model.byte_id):
        raw[i] = bytes([b])

    def read(ids: np.ndarray) -> str:
        return b"".join(map(raw.__getitem__, ids.tolist()))[1:].decode()

    return read


def sampled_pieces(df: DataFrame, model_file: str, alpha: float = 1.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, lossless) of every row of ``df``.

    ``lossless`` tells that the ids were decoded again and gave the text.  A null
    or empty text has no ids.  Rows with the same key and text get the same ids
    (a null key counts as key 0); a very long text is sampled whole.  Rows map
    one to one, so repeated rows stay and an empty table gives an empty one.
    """

    def make():
        sampler, read = Sampler(model_file, alpha, seed), spelled(model_file)

        def fn(pairs: list) -> list[pa.Array]:
            keys = np.array([k or 0 for k, _ in pairs], dtype=np.int64)
            texts = [t for _, t in pairs]
            ids, at = sampler.encode(keys, texts)
            good = [(read(ids[a:b]) if b > a else "") == t for a, b, t in zip(at[:-1], at[1:], texts, strict=True)]
            return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(at)), pa.array(good)]

        return fn

    return map_texts(id_text(df, id_col, text_col), make, "ids array<int>, n_tokens long, lossless boolean", keyed=True, at_once=AT_ONCE).select("doc_id", F.col("ids"), "n_tokens", "lossless")
