import math
import random

import pytest
from pyspark.sql import functions as F

from passagework import session
from passagework.operators import lexical as L

WORDS = [f"w{i}" for i in range(30)]


def passages_of(spark, rows):
    return spark.createDataFrame(rows, "passage_id int, work_slug string, raw_text string")


def texts(rng, n, first=0, work=None):
    return [
        (first + i, work or f"k{i % 5}", " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(30)], k=rng.randint(0, 60))))
        for i in range(n)
    ]


def asked(spark):
    rng = random.Random(9)
    rows = [(q, " OR ".join(rng.sample(WORDS, 9))) for q in range(12)]
    rows += [(20, "w0 w3"), (21, '"w0 w1" OR w20 w21'), (22, 'w2 -w0'), (23, '"w1 w0 w0"'), (24, '"w0 w1" "w1 w0"'), (25, "w0 nowhere"), (26, "w0 OR -w1")]
    return spark.createDataFrame(rows, "query_id int, text string")


def found(index, spark, **kwargs):
    return sorted(tuple(r) for r in L.search(asked(spark), index, limit=10, **kwargs).collect())


def test_replaced_works_search_like_a_rebuilt_index(spark):
    rng = random.Random(1)
    old = texts(rng, 120)
    index = L.build_index(passages_of(spark, old), shard_rows=30)
    second = texts(rng, 20, 500, "k1")
    index = L.replace_works(index, passages_of(spark, second))
    third = texts(rng, 15, 600, "k1") + texts(rng, 5, 700, "new")
    gone = spark.createDataFrame([("k3",)], "work_slug string")
    index = L.replace_works(index, passages_of(spark, third), works=gone)
    now = [r for r in old if r[1] not in ("k1", "k3")] + third
    rebuilt = L.build_index(passages_of(spark, now), shard_rows=30)
    assert (index.n, index.n_tokens) == (rebuilt.n, rebuilt.n_tokens) and len(index.segments) == 3
    want = found(rebuilt, spark)
    assert found(index, spark) == want
    terms = spark.createDataFrame([(w,) for w in WORDS], "term string").withColumn("bucket", L._bucket())
    df = lambda i: {r.term: r.df for r in i.frequencies(terms).collect()}
    assert df(index) == df(rebuilt)
    merged = L.merge_segments(index)
    assert len(merged.segments) == 1 and found(merged, spark) == want


def test_phrases_are_adjacent_positions(spark):
    rows = [(1, "a", "w0 w1 w0 w0"), (2, "a", "w0 w0 w1"), (3, "b", "w1 w0 x w0"), (4, "b", "w1. W0, w0!"), (5, "b", None), (6, "b", "")]
    index = L.build_index(passages_of(spark, rows))
    queries = spark.createDataFrame([(1, '"w1 w0 w0"'), (2, '"w0 w0"'), (3, '"w0 w1" "w1 w0"'), (4, '-"w1 w0" w0'), (5, "")], "query_id int, text string")
    got = {}
    for r in L.search(queries, index).collect():
        got.setdefault(r.query_id, set()).add(r.passage_id)
    assert got == {1: {1, 4}, 2: {1, 2, 4}, 3: {1}}
    assert L.search(queries, L.build_index(passages_of(spark, []))).count() == 0


@pytest.mark.parametrize("shard_rows", [25, 1_000])
def test_ranges_and_works_limit_every_kind_of_query(spark, shard_rows):
    rng = random.Random(2)
    rows = texts(rng, 200)
    places = [(i, 1 + i % 2, 1 + i % 4, 1 + i % 4 + i % 3) for i in range(200)]
    index = L.build_index(passages_of(spark, rows), shard_rows=shard_rows)
    refs = {0: (1, 2, 3), 1: (2, 1, 1), 20: (1, 1, 2), 22: (2, 3, 4), 2: (9, 1, 1)}
    works = {1: ["k1", "k2"], 3: ["k4"], 20: ["k0"], 22: ["k1", "k3"], 4: []}
    limits = {
        "query_refs": spark.createDataFrame([(q, *r) for q, r in refs.items()], "query_id int, chapter int, verse_start int, verse_end int"),
        "alignments": spark.createDataFrame(places, "passage_id int, chapter int, verse_start int, verse_end int"),
        "query_works": spark.createDataFrame(list(works.items()), "query_id int, works array<string>"),
    }

    def allowed(q, p):
        inside = q not in refs or (places[p][1] == refs[q][0] and places[p][2] <= refs[q][2] and refs[q][1] <= places[p][3])
        return inside and (q not in works or rows[p][1] in works[q])

    every = sorted(tuple(r) for r in L.search(asked(spark), index, limit=1_000).collect())
    want, place = [], {}
    for q, p, w, s, _ in sorted(every, key=lambda r: (r[0], -r[3], r[1])):
        if allowed(q, p):
            place[q] = place.get(q, 0) + 1
            if place[q] <= 10:
                want.append((q, p, w, s, place[q]))
    assert found(index, spark, **limits) == sorted(want)


def test_shards_that_cannot_reach_the_last_place_are_left_out(spark):
    """Short passages score high, so shards of long ones are never joined."""
    rows = [(i, "a", "w1 w2") for i in range(60)] + [(100 + i, "a", " ".join(["w1"] + ["x"] * 300)) for i in range(200)]
    index = L.build_index(passages_of(spark, rows), shard_rows=50)
    vocabulary = spark.createDataFrame([("w1", 1), ("w2", 2)], "term string, tid long").withColumn("bucket", L._bucket())
    scale = L.Scale(index.n, index.n_tokens / index.n, 1.2, 0.75)
    frequency = index.frequencies(vocabulary).withColumn("weight", scale.weight())
    wanted = frequency.select(F.lit(1).alias("query_id"), "term", "weight").join(vocabulary.select("term", "tid"), "term")
    bounds = sorted(((r.bound, r.shard) for r in L.shard_bounds(wanted, index, vocabulary, scale).collect()), reverse=True)
    top = L.search(spark.createDataFrame([(1, "w1 OR w2")], "query_id int, text string"), index, limit=20).collect()
    least = min(r.score for r in top)
    assert len(top) == 20 and len([b for b, _ in bounds if b >= least]) < len(bounds)
    scores = {r.passage_id: r.score for r in L.search(spark.createDataFrame([(1, "w1 OR w2")], "query_id int, text string"), index, limit=1_000).collect()}
    shard = {r.passage_id: r.shard for r in index.facts().collect()}
    assert all(s <= dict((x, b) for b, x in bounds)[shard[p]] + 1e-6 for p, s in scores.items())


def test_what_fulfils_a_branch_is_never_written_out(spark, monkeypatch):
    """Forty queries with 300 fulfilling passages each: written tables stay near the number of queries, terms and shards."""
    index = L.build_index(passages_of(spark, [(i, "a", f"w0 w1 y{i % 7}") for i in range(300)]), shard_rows=50)
    rows = [(q, ("w0 -none", "w0 w1", '"w0 w1"', "w1 w0 OR w0 -none")[q % 4]) for q in range(40)]
    written, real = [], L.materialise
    monkeypatch.setattr(L, "materialise", lambda *a, **k: written.append(real(*a, **k)) or written[-1])
    got = L.search(spark.createDataFrame(rows, "query_id int, text string"), index, limit=10_000).groupBy("query_id").count().collect()
    assert [r["count"] for r in got] == [300] * 40
    assert max(t.count() for t in written) <= 100


def test_a_build_moves_texts_and_never_single_words(spark, monkeypatch):
    """Long passages are dealt into shards of few words, blocks are made inside them: no row of a shuffle is a word."""
    monkeypatch.setattr(L, "SHARD_TOKENS", 300)
    plans, real = [], L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a, **k))
    rows = [*texts(random.Random(4), 100), (900, "k0", "w0 " * 700), (901, "k0", None), (902, "k0", "...")]
    index = L.build_index(passages_of(spark, rows), shard_rows=60)
    assert not [p for p in plans if "Generate" in p]
    sizes = [r["sum(n_tokens)"] for r in index.facts().groupBy("shard").sum("n_tokens").collect()]
    assert len(sizes) > 6 and sorted(sizes)[-2] < 900
    places = index.facts().select("shard", "place").collect()
    assert len(set(places)) == len(rows)
    want = {(p, w, i) for p, _, t in rows for i, w in enumerate((t or "").replace(".", "").split())}
    e = index.segments[0].postings.select("term", "shard", F.explode("entries").alias("e")).select("term", "shard", "e.place", "e.positions")
    got = e.join(index.facts(), ["shard", "place"]).select("passage_id", "term", F.explode("positions")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_terms_of_many_occurrences_and_far_places_are_scored_as_others(spark):
    rows = [(i, "a", "w1 " * (i % 300) + "w2") for i in range(400)]
    index = L.build_index(passages_of(spark, rows))
    queries = spark.createDataFrame([(1, "w1 OR w2"), (2, "w2 -w1")], "query_id int, text string")
    n, mean = 400, sum(i % 300 + 1 for i in range(400)) / 400

    def part(tf, df, length):
        weight = math.log(1 + (n - df + 0.5) / (df + 0.5))
        return weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) if tf else 0.0

    df1 = sum(1 for i in range(400) if i % 300)
    scores = {i: round(part(i % 300, df1, i % 300 + 1) + part(1, 400, i % 300 + 1), 6) for i in range(400)}
    want = sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:100]
    got = L.search(queries, index).orderBy("query_id", "rank").collect()
    assert [(r.passage_id, pytest.approx(r.score, abs=2e-6)) for r in got if r.query_id == 1] == want
    assert {r.passage_id for r in got if r.query_id == 2} == {0, 300}
    assert max(r.max_tf for r in index.heads(spark.createDataFrame([("w1",)], "term string").withColumn("bucket", L._bucket())).collect()) == 299


def test_a_build_leaves_no_copy_of_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    index = L.build_index(passages_of(spark, texts(random.Random(3), 60)))
    stored = {f.split("/")[-2] if "bucket=" not in f else f.split("/")[-3] for t in (index.segments[0].facts, index.segments[0].postings) for f in t.inputFiles()}
    texts_kept = [p.name for p in tmp_path.glob("table-*") if "words" in spark.read.parquet(str(p)).columns]
    assert not texts_kept and stored <= {p.name for p in tmp_path.glob("table-*")}


def test_a_search_has_no_more_tasks_than_cores_and_its_rows_no_weights(spark, monkeypatch):
    seen = []
    scored = L._scored
    monkeypatch.setattr(L, "_scored", lambda rows, *rest: seen.append(out := scored(rows, *rest)) or seen.append(rows.columns) or out)
    index = L.build_index(passages_of(spark, texts(random.Random(4), 200)), shard_rows=5)
    assert found(index, spark)
    assert seen[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and "weights" not in seen[1]


def test_rows_reach_python_without_null_lists(spark, monkeypatch):
    """A null list costs the writer of a batch as many steps as rows stand before it."""
    passages = spark.createDataFrame([(i, "w", f"alpha w{i % 7} {'beta' if i % 3 else 'gamma'}") for i in range(90)], "passage_id int, work_slug string, raw_text string")
    queries = spark.createDataFrame([(1, "alpha"), (2, '"alpha w3" OR gamma -beta'), (3, "w1 OR w2")], "query_id int, text string")
    real = L._best_of_tasks

    def strict(scale, limit):
        inner = real(scale, limit)

        def run(batches):
            def checked():
                for batch in batches:
                    for name, column in zip(batch.schema.names, batch.columns, strict=True):
                        assert not (str(column.type).startswith("list") and column.null_count), name
                    yield batch

            yield from inner(checked())

        return run

    monkeypatch.setattr(L, "_best_of_tasks", strict)
    found = L.search(queries, L.build_index(passages), limit=200).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {1: 90, 2: 38, 3: 26}
