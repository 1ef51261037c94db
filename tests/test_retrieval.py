import math
import random

import numpy as np
import pytest

from passagework.operators import lexical as L
from passagework.operators import retrieval as Q
from passagework.plans import all_queries  # noqa: F401  registers every query
from passagework.plans.registry import runner

random.seed(7)
WORDS = "alpha beta gamma delta or eps zeta eta theta".split()
DOCS = [
    (i, f"w{min(i % 9, 3)}", i, " ".join(random.choice(WORDS[:4] if i % 2 else WORDS) for _ in range(6 + i % 5)))
    for i in range(60)
]
PLACES = [(i, 1 + i % 2, 1 + i % 4, 1 + i % 4 + i % 3) for i in range(60)] + [(5, 2, 3, 3)]


@pytest.fixture(scope="module")
def tables(spark):
    passages = spark.createDataFrame(DOCS, "passage_id int, work_slug string, sequence_index int, raw_text string")
    places = spark.createDataFrame(PLACES, "passage_id int, chapter int, verse_start int, verse_end int")
    return passages, places, L.build_index(passages)


def test_structural_equals_brute_force(spark, tables):
    passages, places, _ = tables
    refs = [(1, 1, 2, 3), (2, 2, 1, 1), (2, 1, 4, 6), (3, 9, 1, 1), (4, 2, 3, 5)]
    works = {4: ["w1", "w3"]}
    rdf = spark.createDataFrame(refs, "query_id int, chapter int, verse_start int, verse_end int")
    wdf = spark.createDataFrame(list(works.items()), "query_id int, works array<string>")
    got = Q.structural_search(rdf, places, passages, query_works=wdf, per_work=2, limit=5).collect()
    want = set()
    for q in {r[0] for r in refs}:
        best = {}
        for p, c, a, z in PLACES:
            if any(x[0] == q and x[1] == c and a <= x[3] and x[2] <= z for x in refs):
                best[p] = min(best.get(p, (c, a)), (c, a))
        by_work = {}
        for p, place in best.items():
            if q not in works or DOCS[p][1] in works[q]:
                by_work.setdefault(DOCS[p][1], []).append((place, DOCS[p][2], p))
        rows = [(i, w, p) for w, v in by_work.items() for i, (_, _, p) in enumerate(sorted(v)[:2], 1)]
        want |= {(q, p, w, i, n) for n, (i, w, p) in enumerate(sorted(rows)[:5], 1)}
    assert {tuple(r) for r in got} == want


SEARCHES = {
    1: ("alpha beta", [({"alpha", "beta"}, set(), [])]),
    2: ('"gamma delta"', [({"gamma", "delta"}, set(), ["gamma delta"])]),
    3: ("alpha -zeta", [({"alpha"}, {"zeta"}, [])]),
    4: ("eta OR theta", [({"eta"}, set(), []), ({"theta"}, set(), [])]),
    5: ("Alpha nowhere", [({"alpha", "nowhere"}, set(), [])]),
    6: ("«alpha beta» gamma", [({"alpha", "beta", "gamma"}, set(), ["alpha beta"])]),
}


@pytest.mark.parametrize("ranged", [False, True])
def test_sparse_equals_brute_force(spark, tables, ranged):
    _, places, index = tables
    queries = spark.createDataFrame([(k, v[0]) for k, v in SEARCHES.items()], "query_id int, text string")
    kwargs = {}
    refs = {1: (1, 1, 2), 3: (2, 2, 6)} if ranged else {}
    if ranged:
        kwargs = {
            "query_refs": spark.createDataFrame([(k, *v) for k, v in refs.items()], "query_id int, chapter int, verse_start int, verse_end int"),
            "alignments": places,
        }
    got = {(r.query_id, r.passage_id): (r.score, r["rank"]) for r in L.search(queries, index, limit=7, **kwargs).collect()}
    tokens = {d[0]: d[3].split() for d in DOCS}
    avg = sum(map(len, tokens.values())) / len(tokens)
    want = {}
    for q, (_, branches) in SEARCHES.items():
        terms = {t for b in branches for t in b[0]}
        hits = []
        for p, ws in tokens.items():
            text = f" {' '.join(ws)} "
            if q in refs and not any(
                x[0] == p and x[1] == refs[q][0] and x[2] <= refs[q][2] and refs[q][1] <= x[3] for x in PLACES
            ):
                continue
            if any(b[0] <= set(ws) and not b[1] & set(ws) and all(f" {f} " in text for f in b[2]) for b in branches):
                score = 0.0
                for t in terms & set(ws):
                    df = sum(t in x for x in tokens.values())
                    tf = ws.count(t)
                    score += math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
                hits.append((-round(score, 6), p))
        for n, (s, p) in enumerate(sorted(hits)[:7], 1):
            want[(q, p)] = (-s, n)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)


@pytest.mark.parametrize("tile", [7, 1000])
def test_dense_equals_brute_force(spark, tables, tile):
    _, places, _ = tables
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 8))
    p = spark.createDataFrame([(i, DOCS[i][1], vecs[i].tolist()) for i in range(60)], "passage_id int, work_slug string, vector array<double>")
    q = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(20)] + [(99, None)], "query_id int, vector array<double>")
    works = spark.createDataFrame([(3, ["w1"]), (4, ["w0", "w2"])], "query_id int, works array<string>")
    refs = spark.createDataFrame([(5, 1, 1, 2)], "query_id int, chapter int, verse_start int, verse_end int")
    got = Q.dense_search(q, p, query_works=works, query_refs=refs, alignments=places, limit=4, tile_rows=tile).collect()
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    allowed_works = {3: {"w1"}, 4: {"w0", "w2"}}
    in_range = {x[0] for x in PLACES if x[1] == 1 and x[2] <= 2 and 1 <= x[3]}
    want = set()
    for i in range(20):
        ids = [j for j in range(60) if DOCS[j][1] in allowed_works.get(i, {DOCS[j][1]}) and (i != 5 or j in in_range)]
        best = sorted(ids, key=lambda j: (-round(float(unit[i] @ unit[j]), 6), j))[:4]
        want |= {(i, j, n) for n, j in enumerate(best, 1)}
    assert {(r.query_id, r.passage_id, r["rank"]) for r in got} == want


def test_fusion_and_round_robin(spark, tables):
    passages, _, _ = tables
    a = spark.createDataFrame([(1, 0, 1), (1, 9, 2), (1, 18, 3), (1, 1, 4)], "query_id int, passage_id int, rank int")
    b = spark.createDataFrame([(1, 1, 1), (1, 27, 2)], "query_id int, passage_id int, rank int")
    fused = Q.fuse_ranks({"structural": a, "sparse": b})
    scores = {r.passage_id: r.fused_score for r in fused.collect()}
    scored = Q.fuse_ranks({"structural": a, "sparse": b.selectExpr("*", "2.5D AS score")})
    assert {r.passage_id: r.scores for r in scored.collect()} == {0: {}, 9: {}, 18: {}, 1: {"sparse": 2.5}, 27: {"sparse": 2.5}}
    assert scores[1] == round(1.5 / 64 + 1 / 61, 9) and scores[0] == round(1.5 / 61, 9)
    out = Q.hybrid_search({"structural": a, "sparse": b}, passages, per_work=2, limit=10).orderBy("position").collect()
    assert [r.passage_id for r in out] == [1, 0, 9]


def test_contained_terms(spark):
    texts = spark.createDataFrame([(1, "the difference"), (2, "nothing")], "id int, text string")
    terms = spark.createDataFrame([("differ", "a"), ("hing", "b"), ("xyzw", "c")], "term string, slug string")
    got = {(r.id, r.term) for r in Q.contained_terms(texts, "text", terms, "term").collect()}
    assert got == {(1, "differ"), (2, "hing")}


def test_any_word_search_is_exact_and_reads_stored_postings(spark):
    import math
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, f"k{i % 3}", " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(40)], k=rng.randint(3, 40)))) for i in range(300)]
    passages = spark.createDataFrame(texts, "passage_id int, work_slug string, raw_text string")
    index = L.build_index(passages)
    asked = [(q, " OR ".join(rng.sample(words, 12))) for q in range(20)]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    held = {i: t.split() for i, _, t in texts}
    mean = sum(map(len, held.values())) / len(held)
    df = {w: sum(w in t for t in held.values()) for w in words}

    def score(q, i):
        t = held[i]
        return sum(
            math.log(1 + (300 - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
            for w in set(q.split(" OR ")) if w in t
        )

    for stored in (index, L.build_index(passages, shard_rows=40)):
        got = {}
        for r in L.search(queries, stored, limit=15).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.passage_id, r.score))
        for q, text in asked:
            best = sorted((-round(score(text, i), 6), i) for i in held if score(text, i) > 0)[:15]
            assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in best]
    one = L.search(queries.limit(1), index)
    assert one.count() and "bucket" in index.segments[0].postings.columns


def test_top_names_meet_in_tiles_and_write_only_their_best(spark, monkeypatch):
    """Near-equal names of one pattern: what is written stays within k rows a name and tile, over blocks and ties."""
    rng = random.Random(3)
    monkeypatch.setattr(Q, "_NAME_BLOCK", 25)
    monkeypatch.setattr(Q, "_NAME_PART", 80)
    names = [(i, f"customer {rng.randint(0, 400):06d} {rng.choice(['red', 'green'])}") for i in range(200)] + [(300, "zzz"), (301, "")]
    left = spark.createDataFrame(names, "left_id int, name string").filter("left_id % 5 = 0")
    right = spark.createDataFrame(names, "right_id int, name string")
    written, real = [], Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda *a, **k: written.append(real(*a, **k)) or written[-1])
    got = {(r.left_id, r["rank"]): (r.right_id, r.similarity) for r in Q.top_trigram_matches(left, right, k=3).collect()}
    grams = {i: {f"  {n} "[j : j + 3] for j in range(len(n) + 1)} for i, n in names}
    want = {}
    for i, _ in names:
        if i % 5 == 0 and grams[i]:
            alike = [(-round(len(grams[i] & g) / len(grams[i] | g), 6), j) for j, g in grams.items() if g]
            for rank, (s, j) in enumerate(sorted(x for x in alike if -x[0] >= 0.3)[:3], 1):
                want[i, rank] = (j, -s)
    assert got == want
    assert max(t.count() for t in written) <= len(names)


def test_scores_of_a_tile_are_held_in_blocks_of_bounded_size(monkeypatch):
    import numpy as np
    import pandas as pd

    def rows(n, key, seed):
        vectors = np.random.default_rng(seed).normal(size=(n, 8))
        return pd.DataFrame({key: range(n), "vector": list(vectors)})

    left, right = rows(70, "query_id", 1).assign(works=None), rows(300, "passage_id", 2).assign(work_slug="")
    want = Q._best_in_tile(5)(left, right).reset_index(drop=True)
    held = []
    rounded = np.round
    monkeypatch.setattr(Q, "_BLOCK_CELLS", 1_000)
    monkeypatch.setattr(Q.np, "round", lambda a, n: held.append(a.size) or rounded(a, n))
    pd.testing.assert_frame_equal(Q._best_in_tile(5)(left, right).reset_index(drop=True), want)
    assert held and max(held) <= 1_000


def shuffles(df):
    """Shuffles of rows that the plan of `df` asks for; broadcasts are none."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "Broadcast" not in line and "Reused" not in line for line in plan.splitlines())


def test_fusion_deals_rows_by_query_once(spark, tables):
    """Ranked lists move once, by query, whatever ranks them inside it; against few openings no hit moves at all."""
    passages, places, _ = tables
    passages = L.bounded(passages)  # few, so that it is broadcast
    ranked = spark.createDataFrame([(1, p, p + 1) for p in range(9)], "query_id int, passage_id int, rank int").cache()
    assert shuffles(Q.hybrid_search({"structural": ranked, "sparse": ranked}, passages)) == 1
    assert shuffles(Q.diversify_by_work(Q.fuse_ranks({"structural": ranked, "sparse": ranked}, published=passages))) == 1
    refs = spark.createDataFrame([(1, 1, 2, 3)], "query_id int, chapter int, verse_start int, verse_end int")
    assert shuffles(Q.structural_search(refs, places, passages)) == 1


def test_the_registered_name_search_asks_every_customer(spark):
    found = runner("d19_top_matches")(spark, "/root/testdata/sf0.001").select("left_id").distinct().count()
    assert found == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
