import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trajectra.llm.mixing import mix, mixed_documents, position


def brute(rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = defaultdict(int)
    for r in rows:
        size[r[2]] += words(r[1])
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_ = sum(size.values()), {}, set(order)
    left = total
    while open_:                                     # the excess goes round until no source is above
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * size[s]}
        for s in over or open_:
            target[s] = 3.0 * size[s] if over else share * weight[s]
        if not over:
            break
        left -= sum(3 * size[s] for s in over)
        open_ -= over
    out = []
    for s in order:
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (
            hashlib.md5(str(r[0]).encode()).hexdigest() if r[0] is not None else "", r[0] or 0, words(r[1])))
        at = 0
        for r in mine:
            n = words(r[1])
            uses = sum(2 * (k * size[s] + at) + n <= 2 * target[s] + 1e-6 for k in range(3)) if n else 0
            out.append((r[0], n, size[s], target[s], n * uses))
            at += n
    return out


ROWS = [(i, " ".join(["w"] * (i * 7 % 40)), ["a", "b", "c", "d", None, "é"][(i * i) % 6]) for i in range(300)]


def test_matches_brute_force(docs):
    got = {(r.doc_id): r for r in mix(docs(ROWS)).collect()}
    for doc_id, size, source_size, target, taken in brute(ROWS):
        r = got[doc_id]
        assert (r["size"], r["source_size"], r["taken"]) == (size, source_size, taken)
        assert r["target"] == pytest.approx(target)
        assert r["taken"] <= 3 * r["size"]


def test_taken_near_target_and_sorted(docs):
    rows = mix(docs(ROWS)).collect()
    per, target = defaultdict(int), {}
    for r in rows:
        per[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(per[s] - target[s]) <= 40 for s in target)
    used = [r.position for r in rows if r.position is not None]
    assert used == sorted(used) and 0 <= used[0] and used[-1] <= 1


def test_position_inverts_the_integral(spark):
    def at(share, *knots):
        segs, before = [], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            area = (t1 - t0) * (w0 + w1) / 2
            segs.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in
                                   dict(t0=t0, t1=t1, w0=w0, w1=w1, area=area, before=before).items()]))
            before += area
        return spark.range(1).select(position(F.array(*segs), F.lit(share)).alias("p")).first().p
    assert at(0.5, (0, 1), (1, 1)) == pytest.approx(0.5)
    assert at(0.25, (0, 0), (1, 2)) == pytest.approx(0.5)
    assert at(0.75, (0, 2), (1, 0)) == pytest.approx(0.5)
    assert at(0.5, (0, 0), (0.5, 0), (1, 4)) == pytest.approx(0.5 + 0.5 * 0.5 ** 0.5)
    assert at(1.0, (0, 3), (0.5, 1), (1, 2)) == pytest.approx(1.0)


def test_documents_as_often_as_taken(docs):
    counts = defaultdict(int)
    for r in mixed_documents(docs(ROWS)).collect():
        counts[r.doc_id] += 1
        assert r.lang == "en"
    for r in mix(docs(ROWS)).collect():
        assert counts[r.doc_id] == (r.taken // r["size"] if r["size"] else 0)


def test_odd_rows(docs, odd):
    df = docs(odd, clash=True)
    assert mix(df).count() == len(odd)
    assert mixed_documents(df).columns == df.columns
    assert mix(docs([])).collect() == [] and mixed_documents(docs([])).collect() == []
    none = mix(docs([(1, None, "a"), (2, "", None)])).collect()
    assert all(r.taken == 0 and r.target == 0 and r.position is None for r in none)


def test_no_python_in_the_plan(docs):
    plan = mix(docs(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
