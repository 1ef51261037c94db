import math
import random
from collections import Counter

import numpy as np

from passagework.llm.language import DIMENSIONS, UNKNOWN, fit, has_letter, identify, keep_identified, unit


def prose(alphabet, rng):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 6))) for _ in range(rng.randint(5, 60)))


def test_figures_are_no_letters(spark):
    assert not any(map(has_letter, [None, "", "² ½ ① Ⅷ", "12 34 !!", "३४", "_"])) and all(map(has_letter, ["a", "1ß", "ʰ", "字", "ǅ"]))
    df = spark.createDataFrame([(i, "the cat sat", "en") for i in range(5)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "² ½"), (2, "①Ⅷ"), (3, None), (4, ""), (5, "² x")], "doc_id long, text string")
    found = {r.doc_id: r for r in identify(odd, fit(df)).collect()}
    assert {i: r.lang_pred for i, r in found.items()} == {1: UNKNOWN, 2: UNKNOWN, 3: UNKNOWN, 4: UNKNOWN, 5: "en"}
    assert all(found[i].score == 0.0 and found[i].rejected for i in (1, 2, 3, 4))


def test_forty_languages_are_learned(spark):
    rng = random.Random(3)
    names = [f"l{i:02}" for i in range(40)]
    own = {n: "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 7)) for n in names}
    data = [(i, prose(own[names[i % 40]], rng), names[i % 40]) for i in range(1_200)]
    model = fit(spark.createDataFrame(data[:800], "doc_id long, text string, lang string").repartition(4), sample_rows=400)
    assert sorted(set(model.languages)) == names
    found = identify(spark.createDataFrame(data[800:], "doc_id long, text string, lang string"), model).collect()
    assert sum(r.lang_pred == names[r.doc_id % 40] for r in found) >= 0.9 * len(found)


def plain_codes(text):
    """Codes of the text's two- and three-byte grams, one at a time."""
    raw = [c if c > 127 or chr(c).isalpha() else 32 for c in f" {text.lower()} ".encode()]
    out = []
    for i in range(len(raw) - 1):
        pair = (raw[i] * 257 + raw[i + 1]) % 2**32
        out.append(pair)
        if i + 2 < len(raw):
            out.append((pair * 257 + raw[i + 2]) % 2**32)
    return Counter((c * 2654435761 % 2**32) >> 20 for c in out)


def test_predictions_equal_plain_cosines(spark, docs, rows):
    """TF-IDF and cosines written out, over null, empty, very long and repeated texts."""
    learned = [(lang, t) for _, t, lang in rows if lang is not None and t is not None]
    model = fit(docs)
    held = Counter(g for _, t in learned for g in plain_codes(t))
    idf = [math.log((1 + len(learned)) / (1 + held[g])) + 1 for g in range(DIMENSIONS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    found = {r.doc_id: r for r in identify(docs.where("doc_id is not null and doc_id <> 9"), model).collect()}
    for i, t, _ in rows:
        if i is None or i == 9:
            continue
        r = found[i]
        if not has_letter(t):
            assert (r.lang_pred, r.score, r.rejected) == (UNKNOWN, 0.0, True)
            continue
        vector = {g: math.log1p(n) * idf[g] for g, n in plain_codes(t).items()}
        length = math.sqrt(sum(x * x for x in vector.values()))
        cosines = [sum(x * float(c[g]) for g, x in vector.items()) / length for c in unit(model.centroids)]
        best = max(cosines)
        assert abs(r.score - min(max(best, 0), 1)) < 1e-4
        assert any(model.languages[k] == r.lang_pred and best - c < 1e-4 for k, c in enumerate(cosines))


def test_keep_identified_keeps_all_columns(spark, docs, rows, empty):
    model = fit(docs)
    kept = keep_identified(docs, model)
    want = sum(not r for r in model.predict([t for _, t, _ in rows])[2])
    assert kept.columns == docs.columns and kept.count() == want and keep_identified(empty, model).count() == 0
