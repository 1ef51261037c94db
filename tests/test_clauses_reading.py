import random

import pytest

from passagework.functions import vocab as V
from passagework.operators import clauses as C
from passagework.operators import reading as N

random.seed(11)
VERSE = "الله لا اله الا هو الحي القيوم لا تاخذه سنه ولا نوم له ما في السماوات"
W = VERSE.split()


def passage(i):
    a = random.choice([0, 5, 7, 12]) if i % 5 else 3
    n = random.choice([2, 3])
    quote = "﴿" + " ".join(W[a : a + n]) + "﴾" if i % 3 else " ".join(random.sample(W, 4))
    return f"{quote} كلام رقم {i}"


TEXTS = {i: passage(i) for i in range(40)}


@pytest.fixture(scope="module")
def built(spark):
    verses = spark.createDataFrame([(1, 1, VERSE), (1, 2, "كلمه واحده هنا")], "chapter int, verse int, text string")
    rows = [(i, 1, 1, t) for i, t in TEXTS.items()] + [(100, 1, 2, "لا شيء")]
    pv = spark.createDataFrame(rows, "passage_id int, chapter int, verse int, raw_text string")
    clauses, aligned = C.build_clauses(pv, verses)
    return clauses.cache(), aligned.cache()


def test_every_word_in_one_clause(built):
    rows = built[0].filter("verse = 1").orderBy("clause_index").collect()
    covered = [w for r in rows for w in range(r.start_word, r.end_word + 1)]
    assert covered == list(range(len(W))) and len(rows) > 1
    assert " ".join(r.text for r in rows) == VERSE
    whole = built[0].filter("verse = 2").collect()
    assert len(whole) == 1 and whole[0].support == 0


def longest_run(words):
    best, score, start, length, content = None, 0, -1, 0, 0
    held = set(words)
    for i, w in enumerate(W):
        if w in held and len(w) > 1:
            if start < 0:
                start, length, content = i, 0, 0
            length += 1
            content += len(w) >= 4 and w not in V.CLAUSE_FUNCTION_WORDS
            if content and content * 100 + length > score:
                score, best = content * 100 + length, (start, i)
        else:
            start = -1
    return best


def test_alignment_equals_a_plain_loop(built):
    clauses = built[0].filter("verse = 1").orderBy("clause_index").collect()
    got = {r.passage_id: (r.clause_index, r.basis, r.matched_words) for r in built[1].filter("verse = 1").collect()}
    for i, text in TEXTS.items():
        if i % 3:
            q = text[1 : text.index("﴾")].split()
            spans = []
            for s in range(len(W)):
                n = 0
                while n < len(q) and s + n < len(W) and W[s + n] == q[n]:
                    n += 1
                if n:
                    spans.append((-n, s))
            n, s = min(spans)
            span, basis = (s, s - n - 1), "QUOTED"
        else:
            span, basis = longest_run(text.split()), "OVERLAP"
            if span is None or span[1] - span[0] < 1:
                assert i not in got
                continue
        overlap = [min(span[1], c.end_word) - max(span[0], c.start_word) + 1 for c in clauses]
        best = max(overlap)
        assert got[i] == (overlap.index(best), basis, best)


def test_reading_equals_a_plain_loop(spark):
    rng = random.Random(5)
    clauses = [(1, v, i, f"t{i}", rng.randint(0, 9)) for v in range(6) for i in range(5)]
    notes = []
    for pid in range(240):
        v, c = rng.randrange(6), rng.choice([None, 0, 1, 2, 3, 4])
        if v == 2 and c in (0, 1):
            c = 3
        notes.append((pid, 1, v, f"w{rng.randrange(3)}", pid, 10 * rng.randrange(3), c, c is not None and rng.random() < 0.4))
    ranks = {"w0": 20, "w1": 0, "w2": 10}
    notes = [(*n[:5], ranks[n[3]], *n[6:]) for n in notes]
    cdf = spark.createDataFrame(clauses, "chapter int, verse int, clause_index int, text string, support int")
    ndf = spark.createDataFrame(
        notes, "passage_id int, chapter int, verse int, work_slug string, sequence_index int, catalogue_rank int, clause_index int, opens_discussion boolean"
    )
    got = {k: df.collect() for k, df in N.build_reading(cdf, ndf, 3).items()}
    for v in range(6):
        rows = sorted((n for n in notes if n[2] == v), key=lambda n: (n[5], n[3], 0 if n[7] else 1, n[4]))
        seen, shown, loose = {}, {i: [] for i in range(5)}, []
        for n in rows:
            key = (n[6], n[3])
            if seen.get(key, 0) >= 3 or (n[6] is not None and not n[7] and seen.get(key, 0) == 0):
                continue
            seen[key] = seen.get(key, 0) + 1
            (loose if n[6] is None else shown[n[6]]).append(n)
        merged = []
        for i in range(5):
            c = next(c for c in clauses if c[1] == v and c[2] == i)
            if not shown[i] and merged:
                merged[-1] = (merged[-1][0] + " " + c[3], merged[-1][1])
            else:
                merged.append((c[3], shown[i]))
        while len(merged) > 1 and not merged[0][1]:
            merged[:2] = [(merged[0][0] + " " + merged[1][0], merged[1][1])]
        groups = sorted((g.group_index, g.text) for g in got["clauses"] if g.verse == v)
        assert [t for _, t in groups] == [t for t, _ in merged]
        order = []
        for n in [n for _, ns in merged for n in ns] + loose:
            if n[3] not in order:
                order.append(n[3])
        refs = {r.work_slug: r.number for r in got["references"] if r.verse == v}
        assert refs == {w: i for i, w in enumerate(order, 1)}
        assert {n.passage_id for n in got["notes"] if n.verse == v} == {n[0] for _, ns in merged for n in ns} | {n[0] for n in loose}


def test_mining(spark):
    item = "one two three four five six seven eight"
    docs = [(1, f"zz {item} yy"), (2, "one two three four x six seven eight"), (3, f"{item} {item}")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    i = spark.createDataFrame([(9, item)], "item_id int, text string")
    got = sorted((r.doc_id, r.doc_start, r.item_start, r.words) for r in C.mine_quotations(d, i).collect())
    assert got == [(1, 1, 0, 8), (3, 0, 0, 8), (3, 8, 0, 8)]
