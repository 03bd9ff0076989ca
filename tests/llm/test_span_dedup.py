import random
import re

from trajectra.llm.span_dedup import deduplicate_spans, remove_spans, runs_of, sentence_starts


def brute(rows):
    """All runs of all documents, in a plain dictionary."""
    first, runs = {}, []
    for i, t in rows:
        starts = sentence_starts(t) if t else [0]
        words = [t[a:b].split() for a, b in zip(starts, starts[1:])] if t else []
        ok = lambda a, b: sum(map(len, words[a:b])) >= 50 or (b - a >= 2 and sum(map(len, words[a:b])) >= 25)  # noqa: E731,B023
        spans = set()
        for a in range(len(words)):
            ends = [b for b in range(a + 1, len(words) + 1) if ok(a, b)]
            if ends:
                spans.add((a, ends[0]))
        for b in range(1, len(words) + 1):
            begins = [a for a in range(b) if ok(a, b)]
            if begins:
                spans.add((begins[-1], b))
        for a, b in sorted(spans):
            key = str(words[a:b])
            runs.append((i, a, b, key))
            first[key] = min(first.get(key, (i, a)), (i, a))
    gone = {}
    for i, a, b, key in runs:
        if first[key] != (i, a):
            gone.setdefault(i, set()).update(range(a, b))
    out = {}
    for i, t in rows:
        if i not in gone:
            out[i] = (t, 0)
            continue
        starts = sentence_starts(t)
        kept = "".join(t[a:b] for k, (a, b) in enumerate(zip(starts, starts[1:])) if k not in gone[i])
        if len(starts) - 2 in gone[i]:
            kept = kept.rstrip(" \t\x0b\x0c\r\n")
        out[i] = (kept, len(gone[i]))
    return out


def sentence(rnd, n):
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n)) + rnd.choice([". ", ".\n", "! "])


def made(seed=7, n=80):
    rnd = random.Random(seed)
    passages = ["".join(sentence(rnd, rnd.randrange(4, 20)) for _ in range(8)) for _ in range(4)]
    passages.append(sentence(rnd, 60))
    rows = []
    for i in range(n):
        t = [sentence(rnd, rnd.randrange(1, 18)) for _ in range(rnd.randrange(0, 25))]
        if i % 2:
            t.insert(rnd.randrange(len(t) + 1), passages[i % 5])
        if i % 7 == 0:
            t += t[2:8]
        rows.append((i, "".join(t)))
    return rows, passages


def test_matches_brute_force(docs):
    rows, passages = made()
    got = {r.doc_id: (r.text, r.n_removed) for r in deduplicate_spans(docs(rows)).collect()}
    assert got == brute(rows)
    for p in passages:
        assert sum(p.strip() in t for t, _ in got.values()) == 1


def test_short_lines_and_clean_documents_stay(docs):
    rows = [(i, f"All rights reserved.\nOne two three. Number {i} is here. " + " ".join(f"x{i}_{j}" for j in range(40)) + ".")
            for i in range(30)]
    assert all(r.n_removed == 0 and r.text == rows[r.doc_id][1] for r in deduplicate_spans(docs(rows)).collect())


def test_sentences_rebuild_the_text():
    rnd = random.Random(1)
    for _ in range(200):
        t = "".join(rnd.choice(["a", " ", ".", "\n", "!", "b c", "。", "é"]) for _ in range(rnd.randrange(1, 40)))
        s = sentence_starts(t)
        assert "".join(t[a:b] for a, b in zip(s, s[1:])) == t and s == sorted(set(s))
    assert remove_spans("A b. C d. E f.", [1, 1]) == ("A b. E f.", 1, 2)
    assert runs_of(None, 3, 25, 50) == [] and re.match("", "")


def test_odd_rows(docs, odd):
    got = deduplicate_spans(docs(odd, clash=True)).collect()
    assert len(got) == len(odd)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].text is None and by[3][0].text == ""
    assert by[5][0].n_removed == 0 and by[6][0].text == ""
    assert [r.n_removed for r in by[1]] == [0, 0]
    assert deduplicate_spans(docs([])).collect() == []


def test_passages_that_begin_and_end_inside_sentences(docs):
    """51 repeated words, without sentence or clause marks at their ends, lose all but the edges."""
    rnd = random.Random(3)

    def words(n):
        return [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]
    rows, passages = [], []
    for k in range(40):
        p = words(51)
        for j in range(51):
            if k % 2 and rnd.random() < 0.1:
                p[j] += rnd.choice([".", ",", "!"])
        passages.append(p)
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join(words(rnd.randrange(1, 40)) + p + words(rnd.randrange(1, 40))) + "."))
    got = {r.doc_id: r for r in deduplicate_spans(docs(rows)).collect()}
    for k, p in enumerate(passages):
        assert got[2 * k].n_removed == 0 and 25 <= got[2 * k + 1].words_removed <= 51
        left = set(got[2 * k + 1].text.split())
        assert sum(w in left for w in p) <= 26
        assert set(rows[2 * k + 1][1].split()) - left <= set(p)


def test_null_ids_are_told_apart_and_lose_repeats(docs):
    """Texts without an id: each keeps its own sentences, and a passage they share stays in one of them only."""
    rnd = random.Random(4)
    shared = "".join(sentence(rnd, 12) for _ in range(5)).strip()
    rows = [(None, "".join(sentence(rnd, 9) for _ in range(k + 1)) + shared + f"\nEnd of {k}.") for k in range(12)]
    rows += [rows[3], (None, None), (None, ""), (2 ** 63 - 1, "".join(sentence(rnd, 11) for _ in range(4)))]
    rows.append((None, rows[-1][1]))
    got = deduplicate_spans(docs(rows)).collect()
    assert len(got) == len(rows)
    whole = {r.text for r in got if r.text and shared in r.text}
    assert len(whole) == 1
    for i, t in rows[:12]:
        assert sum(r.text in (t, t.replace(shared + "\n", "")) for r in got) == (2 if t == rows[3][1] else 1)
    last = [r for r in got if r.doc_id is not None]
    assert last[0].text == rows[-1][1] and sum(r.text == rows[-1][1] for r in got) == 1


def test_spans_outside_the_text_are_rejected():
    assert remove_spans("A b. C d. E f.", [1, 1, 2, 5, 9, 1]) == ("A b. E f.", 1, 2)
