import random
import zlib

from trajectra.llm.quality_classifier import accepted, fit_sample, held_out, quality


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    good = [rnd.choice("the of and to in that with from over water stone house river light".split()) for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        q = int(rnd.random() < 0.7)
        at = rnd.randrange(2900)
        words = good[at:at + 80]
        rows.append((i, " ".join(words) if q else " ".join(w.upper() + "!! ###" for w in words)))
        labels.append((i, q, 0))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    out = quality(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_held_out_labels_do_not_matter(spark, docs):
    rows, labels = corpus(200)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels]
    a, b = (sorted(map(tuple, quality(docs(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()))
            for x in (labels, turned))
    assert a == b


def test_one_class_or_no_labels():
    assert 0.5 < fit_sample(["a b c"] * 10, []).score(["x", None], fit_sample([], []).compressors())[0] <= 1
    assert list(fit_sample([], []).score([None, ""], fit_sample([], []).compressors())) == [0.5, 0.5]


def test_odd_rows(spark, docs, odd):
    rows, labels = corpus(200)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    df = docs(odd + [(i + 100, t, "s") for i, t in rows], clash=True)
    out = quality(df, lab).collect()
    assert len(out) == len(odd) + len(rows) and all(0 <= r.score <= 1 for r in out)
    assert accepted(df, lab).columns == df.columns
    assert quality(docs([]), lab).collect() == []
    assert df.select(held_out(df.doc_id).alias("h")).filter("h IS NULL").count() == 0
