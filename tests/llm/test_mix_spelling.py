import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework.llm.mixing import fit_counts, knapsack, mix_sources, targets, word_totals
from passagework.llm.spelling import near_pairs, spelling_variants, stretches, word_counts


def sums_of(lengths, counts):
    reached = {0}
    for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        reached = {x + size * k for x in reached for k in range(n + 1)}
    return reached


def test_knapsack_comes_as_near_as_can_be():
    for seed in range(250):
        rng = random.Random(seed)
        lengths = np.array(rng.sample(range(60), rng.randint(1, 8)))
        counts = np.array([rng.randint(1, 9) for _ in lengths])
        budget = rng.randint(0, max(1, int((lengths * counts).sum())))
        best = min(sums_of(lengths, counts), key=lambda x: (abs(x - budget), x))
        used = knapsack(lengths, counts, budget)
        assert (used <= counts).all() and int((used * lengths).sum()) == best
        fitted = fit_counts(lengths, counts, budget, fitted=rng.choice([5, 40, 4_000]))
        assert (fitted <= counts).all() and (fitted >= 0).all() and abs(int((fitted * lengths).sum()) - best) <= lengths.max()


def test_word_totals_are_the_regexs():
    texts = [None, "", " ", "a", " a b ", "a\x1cb c d", "x" * 50, "\x0b\x0c\r\n", "é ü", "end"]
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    for column in (pa.array(texts), pa.array(texts)[2:7], pa.array([None, None], pa.string()), pa.array([], pa.string())):
        assert word_totals(column).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in column.to_pylist()]
    assert word_totals(pa.array(texts)).tolist() == want


def shares(sizes, weights, most=3):
    """The rule as told: stop what is above, share the excess by weight, until none is above."""
    total, held = sum(sizes), [0.0] * len(sizes)
    stopped = [s == 0 for s in sizes]
    while True:
        rest = total - sum(most * s for s, x in zip(sizes, stopped, strict=True) if x)
        left = sum(w for w, x in zip(weights, stopped, strict=True) if not x)
        held = [most * s if x else rest * w / left for s, w, x in zip(sizes, weights, stopped, strict=True)]
        above = [i for i, s in enumerate(sizes) if not stopped[i] and held[i] > most * s]
        if not above:
            return held
        for i in above:
            stopped[i] = True


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = sorted(rng.sample([chr(c) for c in [*range(65, 91), 0xE9, 0xFF21, 0x10400]], 12)) + [None]
    sizes = [rng.choice([0, 1, 5, 40, 300, 4_000]) for _ in names]
    sizes[rng.randrange(13)] = 9_000
    rows = [(n is None, n or "", s) for n, s in zip(names, sizes, strict=True)]
    made = targets(spark.createDataFrame(rows, "no_source boolean, source string, source_size long").repartition(3))
    got = {(r.no_source, r.source): r.target for r in made.collect()}
    want = shares(sizes, [i % 3 + 1 for i in range(13)])
    assert [got[r[:2]] for r in rows] == pytest.approx(want)


def test_mix(spark, docs, rows, empty):
    some = docs.withColumn("source", F.when(F.col("lang") == "en", "en").when(F.col("lang") == "de", "\U00010400").when(F.col("lang") == "fr", "Ａ"))
    made = mix_sources(some).toPandas()
    assert len(made) == len(rows) and (made["taken"] <= 3 * made["size"]).all()
    want = Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    ids = [None if x != x else int(x) for x in made["doc_id"]]
    assert Counter(zip(ids, made["size"], strict=True)) == want
    for _, own in made.groupby("source", dropna=False):
        assert own["size"].sum() == own["source_size"].iloc[0]
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max()
    again = mix_sources(some.repartition(7)).toPandas()
    columns = ["doc_id", "source", "size", "taken"]
    assert sorted(map(repr, made[columns].values.tolist())) == sorted(map(repr, again[columns].values.tolist()))
    assert mix_sources(empty).count() == 0


def test_mix_splits_a_hot_length(spark):
    docs = spark.range(6_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a' end as source", "'same five words of text' as text")
    made = mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert {r.source: (r.taken, r.target) for r in made} == {"a": (10_000, 10_000.0), None: (20_000, 20_000.0)}


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    front = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    back = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    return front + back >= max(len(a), len(b)) - 1


@pytest.mark.parametrize("group_pairs", [0, 30, 10_000])
def test_near_pairs_are_all_pairs_one_edit_apart(spark, group_pairs):
    rng = random.Random(4)
    words = {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaab"}
    for _ in range(60):
        base = "".join(rng.choices("abéÿ", k=rng.randint(6, 11)))
        words.add(base)
        for _ in range(4):
            at = rng.randrange(len(base) + 1)
            words.add(rng.choice([base[:at] + "é" + base[at:], base[:at] + base[at + 1 :], base[:at] + "b" + base[at + 1 :]]))
    words = sorted(w for w in words if len(w) >= 6)
    given = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {frozenset((r.a, r.b)) for r in near_pairs(given, group_pairs=group_pairs).collect()}
    assert got == {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p)}


def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if one_edit(w, v)]
        form = min(near)[1] if near and -min(near)[0] >= 5 * n else None
        out[w] = [n, len(near), form]
    for w, told in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        told.append(root)
    return out


def test_variants_equal_the_plain_version(spark, docs, rows, empty):
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (t or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    want_counts = {w: n for w, n in counts.items() if len(w) >= 4}
    words = word_counts(docs, min_length=4, drop_every=7)
    got = {r.word: r.n for r in words.collect()}
    assert got == want_counts
    got = {r.word: [r.n, r.n_near, r.form, r.root] for r in spelling_variants(words).collect()}
    assert got == plain_variants(want_counts) and any(x[2] for x in got.values())
    assert word_counts(empty).count() == 0 and spelling_variants(word_counts(empty)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    chain = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "abcdefghi": 625, "abcdefghij": 3_125, "abcdefghijk": 15_625, "zzzzzz": 9}
    made = spelling_variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert {r.word: r.root for r in made} == {w: "abcdefghijk" if w[0] == "a" else w for w in chain}


def test_long_texts_are_cut_between_words():
    text = b"alpha beta " * 50 + b"x" * 200
    assert b"".join(stretches(text, 64)) == text and all(s.strip(b" ").split() for s in stretches(text, 64))
