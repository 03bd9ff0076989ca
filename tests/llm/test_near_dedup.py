import random
import re
from collections import defaultdict

import numpy as np

from trajectra.llm.near_dedup import (components, dart_signatures, deduplicated, near_duplicates, shingles, WordHashes)


def classes(texts, counted=False):
    """Brute force: connected components of exact similarity 0.8 over five-word shingles."""
    sets = []
    for t in texts:
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
        s = [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        if counted:
            seen = defaultdict(int)
            for i, x in enumerate(s):
                s[i] = (x, seen[x])
                seen[x] += 1
        sets.append(set(s))
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (texts[i] or "") == (texts[j] or "") or (a and b and len(a & b) >= 0.8 * len(a | b)):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def corpus(n=160, seed=5):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        if i > 20 and rnd.random() < 0.5:
            t = texts[rnd.randrange(20 if rnd.random() < 0.7 else len(texts))].split()
            for _ in range(rnd.randrange(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
        else:
            t = [rnd.choice(vocab) for _ in range(rnd.randrange(60, 200))]
        texts.append(" ".join(t))
    return texts


def test_signatures_estimate_weighted_jaccard():
    rnd = np.random.default_rng(1)
    el = rnd.integers(0, 2 ** 63, 300).astype(np.uint64)
    a, b = rnd.integers(1, 9, 300).astype(float), rnd.integers(1, 9, 300).astype(float)
    a[:40], b[40:80] = 0, 0
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    keep_a, keep_b = a > 0, b > 0
    sig = dart_signatures(np.concatenate([el[keep_a], el[keep_b]]), np.concatenate([a[keep_a], b[keep_b]]),
                          np.repeat([0, 1], [keep_a.sum(), keep_b.sum()]), 2, k=2048)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_signatures_do_not_depend_on_the_batch():
    el = np.arange(1, 200, dtype=np.uint64) * np.uint64(7919)
    one = dart_signatures(el, np.ones(199), np.zeros(199, dtype=int), 1)
    tiny = dart_signatures(el[:1], np.ones(1), np.zeros(1, dtype=int), 1)
    both = dart_signatures(np.concatenate([el[:1], el]), np.ones(200), np.repeat([0, 1], [1, 199]), 2)
    assert (both[1] == one[0]).all() and (both[0] == tiny[0]).all()


def test_shingles_of_short_texts():
    h = WordHashes()
    assert len(shingles("a b", h)) == 1 and len(shingles("", h)) == 0 and len(shingles("a b c d e f", h)) == 2


def test_classes_match_brute_force(docs):
    texts = corpus()
    got = {r.doc_id: r for r in near_duplicates(docs(list(enumerate(texts)))).collect()}
    want = classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert sum(r.is_kept for r in got.values()) == len(set(want))
    kept = deduplicated(docs(list(enumerate(texts)), clash=True))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_counted_shingles(docs):
    texts = corpus(60, 9)
    texts += [texts[0] + " " + " ".join(["again and again and"] * 40), texts[0]]
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(list(enumerate(texts))), counted=True).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts, counted=True)


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")], "a string, b string")
    got = {r.node: r.label for r in components(links).collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and got["y"] == "x"


def test_chain_of_thousands_in_shuffled_order(spark):
    ids = list(range(3000))
    random.Random(2).shuffle(ids)
    path = [f"n{i:04d}" for i in ids]
    links = spark.createDataFrame(list(zip(path, path[1:])) + [("x", "y"), ("z", "y")], "a string, b string")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {n: "n0000" for n in path} | {n: "x" for n in "xyz"}
    assert components(links.limit(0)).collect() == []


def test_odd_rows(docs, odd):
    rows = near_duplicates(docs(odd, clash=True)).collect()
    assert len(rows) == len(odd)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert by[1] == {1} and by[5] == by[6] == {5} and by[2] == by[3] == {2}
    df = docs(odd, clash=True)
    kept = deduplicated(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 5, 7] and ids.count(None) == 1 or 8 in ids
    assert near_duplicates(docs([])).collect() == [] and deduplicated(docs([])).collect() == []


def test_big_group_of_near_copies(docs):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        t = list(base)
        t[i % 120] = f"edit{i}"
        rows.append((i, " ".join(t)))
    got = near_duplicates(docs(rows)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.is_kept for r in got) == 1


def test_degree_is_named_as_that_of_checked_links(docs):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60 + i] + [f"edit{i}"] + base[61 + i:])) for i in range(12)] + [(12, "on its own, without a near copy")]
    got = {r.doc_id: r for r in near_duplicates(docs(rows)).collect()}
    assert "n_links" not in got[0] and got[12].n_checked_links == 0
    # they span the class, each counted at both ends; all 66 pairs of it need not be among them
    assert 2 * 11 <= sum(r.n_checked_links for r in got.values()) <= 2 * 66


def test_links_between_texts_that_are_no_bucket_s_first(docs, monkeypatch):
    """Families whose members drift: many pairs at 0.8 and more next to pairs below, in shared buckets."""
    import trajectra.llm.near_dedup as N
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for f in range(12):
        t = [rnd.choice(vocab) for _ in range(120)]
        for _ in range(14):
            t = list(t)
            for _ in range(rnd.randrange(1, 5)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            texts.append(" ".join(t[:rnd.randrange(105, 120)]))
    want = classes(texts)
    for holders in (500, 2):
        monkeypatch.setattr(N, "HOLDERS", holders)
        got = {r.doc_id: r.class_id for r in near_duplicates(docs(list(enumerate(texts)))).collect()}
        assert [got[i] for i in range(len(texts))] == want
