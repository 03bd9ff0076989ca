import random

import numpy as np

from trajectra.llm.toxicity import fit_chain, Features, toxicity

CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def corpus(n=800, seed=3):
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in "ba ce di fo gu ha ji ko lu".split() for b in "ran ton sim vel dor nig pas".split()]
    rows, labels = [], []
    for i in range(n):
        toxic, low = int(rnd.random() < 0.15), int(rnd.random() < 0.2)
        t = [rnd.choice(vocab) for _ in range(rnd.randrange(10, 120))]
        if toxic:
            t[3:3] = [rnd.choice(["idiot", "scum", f"lowei{rnd.choice(vocab)}"]) for _ in range(3)]
        if low:
            t += ["buyer", "cheap"]
        rows.append((i, " ".join(t).title()))
        labels.append((i, 1 - low, toxic))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    out = toxicity(docs(rows), known, CATEGORIES).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.doc_id >= 600]
    assert len(out) == len(rows)
    assert sum(r.toxic == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert sum(r.toxic for r in held if truth[r.doc_id]) >= 0.9 * sum(truth[r.doc_id] for r in held)


def test_later_models_use_earlier_probabilities():
    rnd = random.Random(1)
    y = np.array([rnd.random() < 0.5 for _ in range(300)], dtype=float)
    texts = [("angry" if v else "calm") + f" {chr(97 + i % 26) * 3}" for i, v in enumerate(y)]
    chain = fit_chain(texts, {"a": y, "b": y, "c": 1 - y})
    assert [len(m.w) for m in chain.models] == [(1 << 18) + k + 1 for k in range(3)]
    assert chain.models[1].w[-2] > 0 and chain.models[2].w[-3] < 0
    p = chain.predict(Features().of("angry"))
    assert p[0] > 0.9 and p[1] > 0.9 and p[2] < 0.1


def test_odd_rows(spark, docs, odd):
    rows, labels = corpus(200)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    df = docs(odd + [(i + 100, t, "s") for i, t in rows], clash=True)
    out = toxicity(df, lab, CATEGORIES).collect()
    assert len(out) == len(odd) + len(rows) and all(0 <= r.p_toxic <= 1 for r in out)
    assert toxicity(docs([]), lab, CATEGORIES).collect() == []
    assert all(r.p_toxic == 0.5 for r in toxicity(docs(odd), lab.limit(0), CATEGORIES).collect())
