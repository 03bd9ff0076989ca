"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import trajectra.llm.spelling_variants as V


def counts(rows, shortest=5, least=3, damage=97):
    total = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def result(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def texts(seed=3, n=120):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abéÿz") for _ in range(rnd.randrange(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaabaaaa", "ÉCOLE", "École"]
    out = []
    for i in range(n):
        words = []
        for _ in range(rnd.randrange(1, 40)):
            w = base[int(len(base) * rnd.random() ** 3)]
            if rnd.random() < 0.3:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice(["", "a", "b", w[at] * 2]) + w[at + 1:]
            words.append(w.upper() if rnd.random() < 0.1 else w)
        out.append((i, rnd.choice([" ", ", ", "1"]).join(words)))
    return out + [(n, " ".join(["kabel"] * 4 + ["kabeln"] * 9 + ["kabelns"] * 20))]


def test_against_brute_force(docs):
    rows = texts()
    want = brute(counts(rows))
    assert any(w[1] for w in want) and any(w[2] != w[1] and w[1] for w in want)
    assert result(V.variants(docs(rows))) == want
    # ranges of a few words: every border names nodes
    assert result(V.variants(docs(rows), per_range=7)) == want
    assert result(V.variants(docs(rows), damage=3, least=1)) == brute(counts(rows, damage=3, least=1))


def test_paths_name_equal_prefixes_equally(spark):
    words = sorted({w for _, t in texts(9, 60) for w in re.findall("[a-zé-ÿ]+", t)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for backwards in (False, True):
        seen = {}
        for r in V.trie_paths(df, backwards, per_range=5).collect():
            key = r.word[::-1] if backwards else r.word
            assert len(r.path) == len(key) + 1
            for i, node in enumerate(r.path):
                seen.setdefault(key[:i], set()).add(node)
        assert all(len(v) == 1 for v in seen.values())
        assert len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_odd_rows(docs, odd):
    long = "ab" * 3000
    rows = odd + [(9, f"{long} {long} {long} {long[:-1]} {long[1:]} {long[:-1]} {long[:-1]} {long[1:]} {long[1:]}"), (None, "hello hello hello"),
                  (None, "hallo hallo hallo hallo hallo hallo hallo")]
    assert result(V.variants(docs(rows, clash=True))) == brute(counts(rows))
    assert V.variants(docs([])).collect() == [] and V.variants(docs([(1, "too few words")])).collect() == []


def test_many_variants_of_one_word(docs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [("kernel", 400)] + [("kern" + c + "l", 3) for c in letters if c != "e"] + [(c + "kernel", 3) for c in letters]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words)]
    assert result(V.variants(docs(rows), damage=None)) == brute(counts(rows, damage=None))
