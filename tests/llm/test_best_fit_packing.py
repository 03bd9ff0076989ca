"""Packing: the reduction keeps optima, best fit equals piece-by-piece placing, and sequences give the documents back."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import trajectra.llm.best_fit_packing as B
from trajectra.llm.token_ids import TokenIds

PATH = public_tokenizers.path("byte_bpe_50k.json")


def optimum(items, cap):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {cap - b for b in bins}:
            if room >= items[i]:
                k = bins.index(cap - room)
                go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1:])
        go(i + 1, [*bins, items[i]])
    go(0, [])
    return best[0]


def histogram(items, cap):
    return [items.count(s) for s in range(cap + 1)]


def test_reduction_keeps_the_optimum():
    rnd = random.Random(3)
    fixed = 0
    for _ in range(500):
        cap = rnd.choice([10, 20, 30])
        items = [rnd.randint(1 if rnd.random() < 0.6 else cap // 4, cap) for _ in range(rnd.randint(0, 8))]
        left = histogram(items, cap)
        sets = B.reduce_instance(left, cap)
        n = sum(m for m, _ in sets)
        fixed += n
        assert n + optimum([s for s, c in enumerate(left) for _ in range(c)], cap) == optimum(items, cap)
        assert B.lower_bound(histogram(items, cap), cap) <= optimum(items, cap)
    assert fixed > 500


def test_best_fit_equals_piece_by_piece():
    rnd = random.Random(4)
    for _ in range(200):
        cap = rnd.choice([10, 37, 100])
        items = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 60))]
        rooms = []
        for s in sorted(items, reverse=True):
            fit = [r for r in rooms if r >= s]
            r = min(fit) if fit else cap
            if fit:
                rooms.remove(r)
            rooms.append(r - s)
        got = B.best_fit(histogram(items, cap), cap)
        assert sorted(cap - sum(s * t for s, t in p) for m, p in got for _ in range(m)) == sorted(rooms)


def test_plan_of_a_large_histogram():
    rng = np.random.default_rng(1)
    counts = [0] + [int(x) for x in rng.integers(0, 100_000, 1024)]
    plan = B.plan(counts)
    used = [0] * 1025
    for m, pattern in plan:
        assert sum(s * t for s, t in pattern) <= 1024
        for s, t in pattern:
            used[s] += m * t
    assert used == counts and sum(m for m, _ in plan) <= 1.01 * B.lower_bound(counts)
    assert sum(len(p) for _, p in plan) < 10_000


ODD = [" \n\t  x", "don't we'll 'tis ''s 's été's", "", "<|endoftext|> a <|endoftext", "中文 😀 ٣ⅷ Ω", "a" * 3000 + " b", " " * 700,
       "x  y z 　w\x85v\x1c u", "\ud800 lone", "1234 56a7 8.9", "'s't", " 's", "it'red I'vex"]


def test_ids_equal_the_library():
    rnd = random.Random(1)
    letters = " \n\t  ''sstremvld1²é中Ωабв.,-!  x́٣ⅷ\U0001F600　\x1f"
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(5000)]
    texts = made + [t for t in ODD if "\ud800" not in t]
    ids = TokenIds(PATH)
    assert [a.tolist() for a in ids(texts)] == [a.tolist() for a in ids.whole(texts)]


def test_long_texts_and_forgetting(monkeypatch):
    import trajectra.llm.token_ids as M
    ids = TokenIds(PATH)
    text = " ".join(f"word{i % 977}, it's\n\n {i}" for i in range(4000))
    whole = ids.whole([text])[0].tolist()
    monkeypatch.setattr(M, "CHUNK", 500)
    monkeypatch.setattr(M, "REMEMBERED", 64)
    small = TokenIds(PATH)
    assert small([text])[0].tolist() == whole and small([text, "a b"])[1].tolist() == ids.whole(["a b"])[0].tolist()


def rows_of(docs):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "Gamma,", "delta's"]) for _ in range(int(1500 * rnd.random() ** 4)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "no id"), (None, None), (7, "same id"), (7, "same id"), (202, "word " * 5000), (203, ODD[3])]
    return rows, docs(rows, clash=True)


def test_pack(docs):
    rows, df = rows_of(docs)
    got = [r.asDict() for r in B.pack(df, PATH).collect()]
    ids = TokenIds(PATH)
    want = {}
    for i, t in rows:
        full = ids.whole([t or ""])[0].tolist() + [2]
        at, size, piece = 0, len(full) % 1024 or 1024, 0
        while at < len(full):
            part = full[at:at + size]
            want.setdefault((i, piece, at, size, zlib.crc32(np.array(part, "<u4").tobytes())), []).append(1)
            at, size, piece = at + size, 1024, piece + 1
    have = {}
    for r in got:
        have.setdefault(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), []).append(1)
    assert have == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 1024
    counts = [0] * 1025
    for r in got:
        counts[r["length"]] += 1
    assert len(by) <= B.lower_bound(counts) + 1
    assert B.pack(docs([]), PATH).collect() == []


def test_sequences_hold_the_documents(docs):
    rows, df = rows_of(docs)
    ids = TokenIds(PATH)
    parts = {}
    for r in B.sequences(df, PATH).collect():
        assert len(r.ids) == sum(r.lengths) <= 1024
        at = 0
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
            parts.setdefault(d, []).append((s, r.ids[at:at + n]))
            at += n
    for i, t in rows:
        if i is not None and i != 7:
            assert [x for _, p in sorted(parts[i]) for x in p] == ids.whole([t or ""])[0].tolist() + [2]


@pytest.mark.parametrize("cap", [8, 64])
def test_other_capacities(docs, cap):
    rows, df = rows_of(docs)
    got = B.pack(df, PATH, capacity=cap, end=5).collect()
    assert max(r.length for r in got) <= cap and len({(r.sequence_id, r.offset) for r in got}) == len(got)
