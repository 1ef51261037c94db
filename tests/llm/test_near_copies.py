import math

import numpy as np
import pytest

from passagework.llm import links
from passagework.llm.embeddings import buckets, hadamard, near_vectors
from passagework.llm.jaccard import keep_one_of_each, prefix_length, similar_documents


def classes(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard_matches_brute_force(docs, rows, block, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", block)
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode().split() if i is not None else []
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    root = classes(len(rows), linked)
    want = []
    for k, (i, _, _) in enumerate(rows):
        own = min((rows[x][0] for x in range(len(rows)) if root[x] == root[k] and rows[x][0] is not None), default=None)
        want.append((i, own, sum(k in e for e in linked)))
    got = [(r.doc_id, r.class_id, r.n_links) for r in similar_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_keep_one_of_each(docs, rows):
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {5, 7, 8} & set(ids) and {4, 6, 13, 14} <= set(ids)
    assert ids.count(9) == 1  # its copies of document 6 go, its other text stays
    assert ids.count(None) == 2


def test_empty_and_prefix(empty):
    assert similar_documents(empty).count() == 0
    assert keep_one_of_each(empty).count() == 0
    assert prefix_length(0.8, 16, 6, 0.999) == 4
    assert prefix_length(0.8, 1, 6, 0.9999) == 1


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)
    codes = buckets(x / np.linalg.norm(x, axis=1, keepdims=True), 3, 2, 2)
    assert codes.shape == (5, 3, 3) and all(len(set(c)) == 3 for c in codes.reshape(-1, 3).tolist())


def vectors():
    rng = np.random.default_rng(2)
    out, centre = [], rng.normal(size=64)
    for i in range(60):
        out.append((i, (centre + rng.normal(size=64) * 0.12).tolist() if i % 3 else rng.normal(size=64).tolist(), i % 2))
    out += [(60, out[1][1], 1), (61, out[1][1], 1), (62, [2 * x for x in out[1][1]], 1), (63, out[1][1], None), (None, out[1][1], 1)]
    out += [(64, None, 1), (65, [], 1), (66, [0.0] * 64, 1), (67, [1.0] * 63 + [None], 1), (68, [1.0] * 63 + [math.nan], 1)]
    return out + [(69, [1.0, math.inf], 1), (70, [1.0, 0.0], 1), (71, [1.0, 0.01], 1), (72, [1e300, 1e298], 1), (73, [1.0, 0.01], 0), (71, [1.0, 0.01], 1)]


@pytest.mark.parametrize("block", [512, 5])
def test_vectors_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, component int").repartition(3)
    linked = []
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if x[2] is None or x[2] != y[2] or None in (x[0], y[0]) or not x[1] or not y[1] or len(x[1]) != len(y[1]):
                continue
            if any(v is None or not math.isfinite(v) for v in x[1] + y[1]) or not any(x[1]) or not any(y[1]):
                continue
            u, v = (np.array(z[1]) / max(map(abs, z[1])) for z in (x, y))
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                linked.append((a, b))
    root = classes(len(rows), linked)
    want = []
    for k, r in enumerate(rows):
        own = min((rows[x][0] for x in range(len(rows)) if root[x] == root[k] and rows[x][0] is not None), default=None)
        want.append((r[0], sum(k in e for e in linked), own, r[0] == own))
    got = [tuple(r) for r in near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert near_vectors(df.limit(0)).count() == 0


def planted(dims, n, seed):
    """n pairs of unit vectors whose cosines lie between 0.98 and 0.985."""
    rng = np.random.default_rng(seed)
    a, z = rng.standard_normal((2, n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.9801, 0.985, (n, 1))
    return a, c * a + np.sqrt(1 - c * c) * z


@pytest.mark.parametrize("dims,n", [(64, 2_000), (768, 200)])
def test_pairs_just_above_the_threshold_meet(dims, n):
    a, b = (buckets(x, 12, 2, 2) for x in planted(dims, n, dims))
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() >= 0.999


def test_planted_vector_pairs_are_linked(spark):
    rows = []
    for dims, n in [(64, 150), (768, 30)]:
        for x, y in zip(*planted(dims, n, dims + 1), strict=True):
            rows += [(len(rows), x.tolist(), len(rows) % 4), (len(rows) + 1, y.tolist(), len(rows) % 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == [(i, 1, i - i % 2, i % 2 == 0) for i in range(len(rows))]
