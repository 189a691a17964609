"""Operators over whole tables against brute force, and the pipeline."""

import hashlib
import importlib.util
import itertools
import math
import os
import re
import sys
import zlib

import pytest
import xxhash

from sourcelake.llm import components, context_tree, exact_dedup, simhash, toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
import corpus_pipeline  # noqa: E402

COLUMNS = "doc_id long, text string, name string, blocks int, root long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], COLUMNS).repartition(3)


def dedup_rows():
    long = "".join(chr(97 + i * 7 % 26) for i in range(50_000))
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, ""), (5, None), (6, long), (7, long), (8, long[:-1]), (9, long[1:]), (10, long + "x"), (11, "é" * 5000), (12, "é" * 5000)]
    return rows + [(3, "b"), (7, long), (None, "a"), (None, "n"), (None, "n"), (13, "hot")] + [(100 + i, "hot") for i in range(200)]


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(exact_dedup, "BLOCK", block)
    rows = dedup_rows() if block > 7 else [(i, t[:60] if t else t) for i, t in dedup_rows()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in got) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in got:
        ids = by_digest[r["text_sha256"]]
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None) and r["group_size"] == len(ids)
        kept.setdefault(r["text_sha256"], []).extend([r["doc_id"]] if r["kept"] else [])
    assert all(k == [max((i for i in by_digest[d] if i is not None), default=None)] for d, k in kept.items())


def test_drop_duplicates(spark):
    rows = dedup_rows()
    df = frame(spark, rows)
    got = exact_dedup.drop_duplicates(df)
    assert got.columns == df.columns
    texts = sorted((r["text"] or "") for r in got.collect())
    assert texts == sorted({t or "" for _, t in rows})
    none = spark.createDataFrame([], COLUMNS)
    assert exact_dedup.drop_duplicates(none).collect() == [] and exact_dedup.exact_duplicates(none).collect() == []


def brute_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t\n", "one", "Two Words", "a b c", "A b C d\x0be f", "x " * 500, "naïve\xa0Ünicode text İ", "w" * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_links_are_all_pairs(spark):
    rng = __import__("random").Random(3)
    base = [rng.getrandbits(64) for _ in range(15)]
    prints = {b ^ (1 << rng.randrange(64)) for b in base for _ in range(20)} | {0, (1 << 64) - 1, 3, 1 << 63}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.linked(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    pairs = {(r["a"], r["b"]) for r in got}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert pairs == want and len(got) == len(want) > 50


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    links = chain + [(100, 101), (101, 100), (5, 5), (70, 69), (69, 68), (200, 60)]
    df = spark.createDataFrame([(a * 37 % 211, b * 37 % 211) for a, b in links], "a long, b long")
    root = {r["node"]: r["root"] for r in components.components(df).collect()}
    name = lambda x: x * 37 % 211
    assert {root[name(i)] for i in [*range(61), 200]} == {min(name(i) for i in [*range(61), 200])}
    assert root[name(100)] == root[name(101)] == min(name(100), name(101)) and len({root[name(i)] for i in (68, 69, 70)}) == 1
    assert components.components(df.limit(0)).collect() == []


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(400)]
    near = [*words[:200], "changed", *words[201:]]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, "other text here now"), (4, None), (6, " "), (None, " ".join(words)), (9, "other text here now"), (None, "alone in the world of nulls")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert bin(brute_fingerprint(rows[0][1]) ^ brute_fingerprint(rows[1][1])).count("1") <= 2
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert by[5][0][1] == by[3][0][1] == 3 and by[4] == [("0" * 16, 4)] and by[6] == [("0" * 16, 4)]
    assert by[9] == [("%016x" % brute_fingerprint(rows[2][1]), 9)] * 2 and {c for _, c in by[None]} == {3, None}
    kept = simhash.drop_near_duplicates(frame(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "9", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], COLUMNS)).collect() == []


def toxic_rows(n=400):
    rng = __import__("random").Random(5)
    plain = ["the", "river", "stone", "walk", "green", "table", "letter", "open", "slow", "bright"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[7] = rng.choice(["gruntle", "gruntling", "gruntled"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(None, "gruntle"), (1000, None), (1001, ""), (0, rows[0][1])])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(5, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    want = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) + 4 and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert all(r["predicted"] == want[r["doc_id"]] for r in held if r["doc_id"] in want) and len(held) > 50
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}
    # labels of held-out rows are never seen
    wrong = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, 1) for i, _, y in rows], "doc_id long, toxic int, text int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, wrong)).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b c"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == pytest.approx([0.0, 0.0], abs=1e-9)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []


def brute_ctw(train, text, depth):
    """log10 probability of a text by context-tree weighting, recursively."""
    mark = 255
    grams = {}
    for t in train:
        data = [mark] * depth + list(t.encode()) + [mark]
        for i in range(depth, len(data)):
            key = (tuple(data[i - depth : i]), data[i])
            grams[key] = grams.get(key, 0) + 1

    def counts(suffix, node, level):
        n = [0, 0]
        for (ctx, byte), k in grams.items():
            if ctx[depth - len(suffix) :] == suffix and (256 | byte) >> (8 - level) == node:
                n[byte >> (7 - level) & 1] += k
        return n

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    def weighted(suffix, node, level):
        n = counts(suffix, node, level)
        own = kt(n) if sum(n) else 0.0
        if len(suffix) == depth:
            return own, own, None
        seen = {ctx[depth - len(suffix) - 1] for (ctx, _) in grams if ctx[depth - len(suffix) :] == suffix}
        below = sum(weighted((b, *suffix), node, level)[0] for b in seen)
        return max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2), own, below

    total = 0.0
    data = [mark] * depth + list(text.encode()) + [mark]
    for i in range(depth, len(data)):
        for level in range(8):
            node, bit = (256 | data[i]) >> (8 - level), data[i] >> (7 - level) & 1
            mixed, left, p = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                suffix = tuple(data[i - d : i])
                n = counts(suffix, node, level)
                if d and not sum(n):
                    break
                one = (n[1] + 0.5) / (sum(n) + 1)
                p = mixed + left * one
                _, own, below = weighted(suffix, node, level)
                w = 1.0 if below is None else 1 / (1 + math.exp(below - own))
                mixed, left = mixed + left * w * one, left * (1 - w)
            total += math.log10(p if bit else 1 - p)
    return total


def test_context_tree(spark):
    rows = [(i, t) for i, t in enumerate(["abab", "abba ab", "", "b", "Abab ba", "zzz abab", "ab\tab", "abé"])] + [(50, None), (None, "ab"), (0, "abab")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    got = context_tree.score(frame(spark, rows), 2).collect()
    train = [t or "" for i, t in rows if not held(i)]
    assert len(got) == len(rows) and any(held(i) for i, _ in rows)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t.lower() if t.isascii() else t), ""]
    count = {}
    for t in train:
        for w in tokens(t):
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    text_of = {i: t or "" for i, t in rows}
    for r in got:
        text = text_of[r["doc_id"]]
        words = tokens(text)
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n and r["n_tokens"] == len(words)
        assert r["n_known"] == sum(w in count for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    for i in (0, 1, 2, 4, 7):
        r = next(x for x in got if x["doc_id"] == i)
        assert r["score"] == pytest.approx(brute_ctw(train, text_of[i], 2), rel=1e-6)
    assert context_tree.score(spark.createDataFrame([], COLUMNS), 2).collect() == []


def test_blocks_score_the_same(spark, monkeypatch):
    df = frame(spark, [(i, f"some words {i} and more {i * i}") for i in range(30)])
    whole = sorted(map(tuple, context_tree.score(df, 2).collect()))
    monkeypatch.setattr(context_tree, "BLOCK_ENTRIES", 40)
    again = sorted(map(tuple, context_tree.score(df, 2).collect()))
    for a, b in zip(whole, again, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_pipeline(spark, tmp_path):
    rows = [(i, t) for i, t, _ in toxic_rows(300)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = " ".join(f"v{i}" for i in range(300))
    rows += [(1000, "same text twice"), (1001, "same text twice"), (1002, f"here is {item} inside"), (1003, long), (1004, long + " tail"), (1005, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not any(i in got for i in range(0, 300, 4)) and 1000 not in got and 1001 in got and 1002 not in got and 1003 in got
    assert (1004 in got) == (bin(brute_fingerprint(long) ^ brute_fingerprint(long + " tail")).count("1") > 2)
    assert all(r["lossless"] for r in got.values()) and sum(i < 300 for i in got) == len({t for i, t in rows if i < 300 and i % 4})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "sampled_pieces"]


def test_entry_without_llm(tmp_path):
    """What is left imports and lists its queries when the folders are gone."""
    import shutil
    import subprocess

    shutil.copytree(os.path.join(ROOT, "sourcelake"), tmp_path / "sourcelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert importlib.util.find_spec("sourcelake.llm")


def test_blocks_share_a_worker(spark, monkeypatch):
    """A task has one Python for all blocks of the model and of the words."""
    monkeypatch.setattr(context_tree, "BLOCK_ENTRIES", 40)
    scored = context_tree.score(frame(spark, [(i, f"some words {i} of a text {i * 7}") for i in range(30)]), 2)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
