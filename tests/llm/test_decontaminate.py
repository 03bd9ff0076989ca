import hashlib
import random
import re

from trajectra.llm.decontaminate import contamination, decontaminated


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for k, t in items:
        v = words(t)
        if k is None or t is None or not v:
            continue
        n = min(13, len(v))
        for i in range(len(v) - n + 1):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == v[i:i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(k))
    return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(w))


def made(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["the", "É", "naïve", "x1"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 5, 13, 14, 30])))) for i in range(1, 13)]
    items += [(20, None), (None, "the the the the"), (21, ""), (22, items[4][1]), (5, items[4][1])]
    texts = []
    for i in range(60):
        t = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 80))]
        if i % 3 == 0:
            t[10:10] = items[i % 12][1].upper().replace("É", "É").split()
        texts.append((i, ("!" if i % 2 else " - ").join(t)))
    return texts, items, spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force_in_one_and_many_blocks(spark, docs):
    texts, items, bench = made(spark)
    want = {i: brute(t, items) for i, t in texts}
    for block in (500_000, 7):
        got = {r.doc_id: tuple(r)[1:] for r in contamination(docs(texts), bench, block_windows=block).collect()}
        assert got == want


def test_clean_documents_stay_with_their_columns(spark, docs):
    texts, items, bench = made(spark)
    df = docs(texts, clash=True)
    kept = decontaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in texts if not brute(t, items)[-1]}


def test_odd_rows(spark, docs, odd):
    bench = spark.createDataFrame([(1, "one TWO three four"), (2, "中文")], "item_id long, text string")
    rows = contamination(docs(odd, clash=True), bench).collect()
    assert len(rows) == len(odd)
    for r, (i, t, _) in zip(sorted(rows, key=repr), sorted(odd, key=repr)):
        pass
    assert [r.n_hit for r in rows if r.doc_id == 1] == [4, 4]
    assert [r.contaminated for r in rows if r.doc_id == 2] == [False]
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated and r.n_items == 0 for r in contamination(docs(odd), none).collect())
    assert contamination(docs([]), bench).collect() == []
