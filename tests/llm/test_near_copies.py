"""Near copies of the pipeline against brute force."""

import itertools
import random

from test_corpus_operators import frame

from sourcelake.llm import near_copies


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def kept_by_pairs(rows):
    """The smallest id of each group connected by exact Jaccard >= 0.8 over all pairs."""
    root = {i: i for i, _ in rows}
    sets = {i: shingle_set(t) for i, t in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(root), 2):
        both = len(sets[a] & sets[b])
        if both * 9 >= 4 * (len(sets[a]) + len(sets[b])):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {top(i) for i in root}


def test_drop_near_copies(spark):
    rng = random.Random(11)
    rows = [(0, None), (1, " \n"), (2, "Two Words"), (3, "two words"), (4, "two others")]
    for g in range(12):  # changed words spread over the text: far apart in three-word fingerprints, some under 0.8
        words = [f"g{g}w{rng.randrange(10_000)}" for _ in range(rng.choice([60, 150, 400]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(1, 1 + len(words) // 30)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(copy)))
    want = kept_by_pairs(rows)
    got = near_copies.drop_near_copies(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    assert 14 < len(want) < len(rows) - 20
    assert near_copies.drop_near_copies(frame(spark, rows).limit(0)).collect() == []


def test_stage_drops_near_copies(spark, tmp_path):
    """Two words of sixty changed: linked by five words and 0.8, in no two-bit group."""
    import corpus_pipeline

    from sourcelake.llm import simhash

    words = [f"v{i}" for i in range(60)]
    rows = [(7, " ".join(words)), (8, " ".join([*words[:58], "one", "two"])), (9, "something else entirely is written in this one")]
    assert bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).count("1") > 2
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert sorted(r["doc_id"] for r in stage(spark, frame(spark, rows), str(tmp_path)).collect()) == [7, 9]


def test_stage_goes_by_fingerprints_too(spark, tmp_path):
    """Of texts in one two-bit group but under a similarity of 0.8, one stays."""
    import corpus_pipeline

    from sourcelake.llm import simhash

    body = "red green blue " * 200
    rows = [(3, body + "one two"), (4, "nine ten eight " + body), (9, "something else entirely is written in this one")]
    assert bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).count("1") <= 2
    assert kept_by_pairs(rows) == {3, 4, 9}
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert sorted(r["doc_id"] for r in stage(spark, frame(spark, rows), str(tmp_path)).collect()) == [3, 9]
