"""The prefix trie, the Merkle manifest and packing against plain Python."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sourcelake.llm import merkle, packing, prefix_trie
from sourcelake.llm.common import ranked

TURNS = "conv_id long, turn long, role string, text string, depth int, rank string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf int, key string"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(value):
    return zlib.crc32(str(value).encode())


# -- prefix trie


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {c: own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[: crc(c) % 9] + turns[crc(c) % 9 :] for c, turns in own.items()}
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [(p, m) for p, m in nodes.items() if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p, _ in below)
        saved = sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in below if p)
        ends = sorted(c for c in members if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p, _ in below), leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=str)


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rng = random.Random(0)
    rows = []
    for c in rng.sample(range(-12, 60), 30):
        rows += [(c, rng.choice([None, t]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None])) for t in range(rng.choice([1, 2, 5, 14]))]
    same = [(0, "user", "long " * 2000), (1, "assistant", "yes"), (1, "assistant", "yes")]
    rows += [(c, *t) for c in range(100, 140) for t in same] + [(None, 0, "user", "lost")]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_deep_shared_prefixes(spark):
    """Snapshots of one conversation after each turn: every level has a text that ends."""
    turns = [(i, "user" if i % 2 else "assistant", f"t{i}") for i in range(6)]
    rows = [(5 * c, *t) for c in range(1, 7) for t in turns[:c]]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_little(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "a")]) == []
    # a conversation whose own turns all come before its head, with no donor: turnless
    lonely = next(c for c in range(1, 100) if c % 5 and crc(c) % 9 >= 1)
    assert trie_of(spark, [(lonely, 0, "user", "a")]) == [(lonely, 0, None, 1, 0, 1, 0, sha(str(lonely)))] == plain_trie([(lonely, 0, "user", "a")])


def test_ranked(spark):
    rows = [(k, v) for k in ("a", "b") for v in range(60 if k == "a" else 3)] + [("c", 7)] * 5
    got = ranked(spark.createDataFrame(rows, "k string, v int").repartition(5), ["k"], ["v"], ["k", "v"]).collect()
    assert sorted((r["k"], r["v"], r["rank"], r["size"]) for r in got if r["k"] != "c") == sorted((k, v, v, 60 if k == "a" else 3) for k, v in rows if k != "c")
    assert sorted((r["rank"], r["size"]) for r in got if r["k"] == "c") == [(i, 5) for i in range(5)]


# -- Merkle manifest


def plain_leaf(doc_id, source, lang, n_chars, text):
    told = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in told))


def plain_tree(digests):
    """The root, and for each leaf its runs as (left, right) from the bottom."""
    level, at, paths = digests, list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, pos in enumerate(at):
            run, i = runs[pos // 16], pos % 16
            paths[k].append(("".join(run[:i]), "".join(run[i + 1 :])))
        level, at = [sha("".join(r)) for r in runs], [pos // 16 for pos in at]
    return level[0], paths


def plain_manifest(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for name in names:
        docs = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[name] = (docs, *plain_tree([plain_leaf(*r) for r in docs]))
    root, upper = plain_tree([trees[n][1] for n in names])
    for name, above in zip(names, upper, strict=True):
        docs, subroot, paths = trees[name]
        for row, path in zip(docs, paths, strict=True):
            path = path + above
            leaf = plain_leaf(*row)
            cur = leaf
            if row[0] is not None and crc(row[0]) % 5 == 0 and row[4] is not None:
                cur = plain_leaf(*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]))
            for left, right in path:
                cur = sha(left + cur + right)
            out.append((row[0], leaf, subroot, root, sha("".join(a + b for a, b in path)), cur, cur == root))
    return sorted(out, key=str)


def manifest_of(spark, rows):
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], DOCS).repartition(3)
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str)


def test_manifest(spark):
    rng = random.Random(4)
    rows = [(i, "hot", "en", 3, rng.choice(["Abc", "abc", "ÄB", ""])) for i in range(290)]
    rows += [(i, f"s{i % 40}", rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "Text", "x" * 70_000])) for i in range(300, 420)]
    rows += [(7, None, "en", 1, "Null"), (8, "", "en", 1, "Empty"), (9, "ß", None, None, None), (None, "hot", "en", 1, "No id"), (None, "hot", "en", 1, "No id"), (5, "hot", "en", 3, "again"), (5, "hot", "en", 3, "again")]
    got = manifest_of(spark, rows)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n, sources", [(1, 1), (17, 1), (34, 17), (257, 1)])
def test_manifest_shapes(spark, n, sources):
    rows = [(i, f"s{i % sources}", "en", 1, f"Text {i}") for i in range(n)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest_of(spark, []) == []


# -- packing


def test_unit_ids():
    rng = random.Random(2)
    parts = ["word", "Wörter", " ", "  ", "\n", "\t", " \n", "'s", "'", "12", "<|endoftext|>", "...", "中文", "\0", "\x1c", "\x85", "!?"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)] + ["", " ", "a" * 100_000, "x y " * 30_000]
    units = packing.UnitIds(BYTES)
    library = Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)
    assert units.by_units
    for lo in range(0, len(texts), 500):
        assert [list(a) for a in units.encode(texts[lo : lo + 500])] == [e.ids for e in library[lo : lo + 500]]


@pytest.mark.parametrize("seed", range(4))
def test_fullest(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choices(range(1, 40), k=9))
    room = rng.randrange(20, 120)
    pool = list(counts.elements())
    best = max(sum(c) for k in range(len(pool) + 1) for c in itertools.combinations(pool, k) if sum(c) <= room)
    chosen = packing.fullest(counts, room)
    assert sum(chosen) == best and not Counter(chosen) - counts


def test_plan():
    rng = random.Random(9)
    counts = Counter(rng.choices(range(1, 1025), k=20_000))
    found = packing.plan(counts, 1024)
    used = Counter()
    for lengths, times in found:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert used == counts
    low = -(-sum(n * k for n, k in counts.items()) // 1024)
    assert sum(t for _, t in found) <= low * 1.005 + 1
    assert packing.plan({}, 1024) == [] and packing.plan({600: 3}, 1024) == [([600], 3)]


def packed(spark, rows, capacity):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, length int, rank string").repartition(3)
    return packing.pack(df, BYTES, capacity=capacity).collect()


@pytest.mark.parametrize("capacity", [8, 1024])
def test_pack(spark, capacity):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta!", "γ", "x1"], k=rng.randrange(40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "long text " * 4000), (None, "no id"), (None, "no id"), (3, rows[3][1])] + [(2000 + i, "hot copy") for i in range(100)]
    got = packed(spark, rows, capacity)
    library = Tokenizer.from_file(BYTES)
    want = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want += [(i, k, lo, hi - lo, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[lo:hi]))) for k, (lo, hi) in enumerate(itertools.pairwise(cuts))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= capacity
    low = -(-sum(r["length"] for r in got) // capacity)
    assert len(bins) <= low * (1.02 if capacity == 8 else 1) + 2  # among lengths to 8, not every sum can be met


def test_pack_nothing(spark):
    assert packed(spark, [], 1024) == []
