import random
import re
from collections import Counter, defaultdict

from trajectra.llm.quality_rules import judge, measure


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {p for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_measures_match_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "b", "é", "中", " ", "  ", "\n", "\t", "\x0b", "\x85", " ", "#", "|", "a b c "])
                    for _ in range(rnd.randrange(0, 60)))
        assert measure(t) == brute(t)
    assert measure(None) == (0, 0, 0, 0, 0)


def made():
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        host = ["good", "bad", "small", None][0 if i < 400 else 1 if i < 560 else 2 if i == 560 else 3]
        bad = rnd.random() < {"good": 0.1, "bad": 0.9, "small": 1.0, None: 0.1}[host]
        rows.append((i, " ".join(f"w{rnd.randrange(9999)}" for _ in range(20 if bad else 80)), host))
    return rows


def test_verdicts_match_brute_force(docs):
    rows = made()
    got = {r.doc_id: r for r in judge(docs(rows)).collect()}
    n, x = defaultdict(int), defaultdict(int)
    for i, t, h in rows:
        w, _, _, _, rep = brute(t)
        failed = w < 50 or 100 * rep > 50 * w
        assert got[i].base_failed == failed
        n[h] += 1
        x[h] += failed
    N, p = sum(n.values()), sum(x.values()) / sum(n.values())
    s = sum(n[h] * (x[h] / n[h] - p) ** 2 for h in n)
    like = (s - (len(n) - 1) * p * (1 - p)) / (p * (1 - p) * (N - sum(v * v for v in n.values()) / N - (len(n) - 1)))
    strength = 1 / min(max(like, 1e-6), 1) - 1
    for i, t, h in rows:
        rate = (x[h] + p * strength) / (n[h] + strength)
        assert abs(got[i].host_rate - rate) < 1e-9
        assert got[i].host_failed == (rate > 0.5) and got[i].kept == (not got[i].base_failed and rate <= 0.5)
    assert not any(r.kept for r in got.values() if rows[r.doc_id][2] == "bad")
    assert any(r.kept for r in got.values() if rows[r.doc_id][2] == "good")


def test_odd_rows(docs, odd):
    rows = judge(docs(odd, clash=True)).collect()
    assert len(rows) == len(odd)
    assert [(r.n_words, r.base_failed, r.kept) for r in rows if r.doc_id == 2] == [(0, True, False)]
    assert judge(docs([])).collect() == []
