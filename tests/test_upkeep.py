import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagework.plans import all_queries  # noqa: F401  registers every query
from passagework.plans.registry import runner
from passagework.operators import cells as G
from passagework.operators import inference as K
from passagework.operators import quality as J
from passagework.operators import retrieval as Q
from passagework.operators import snapshots as N

RULES = {"name": "old", "state": "new", "year": "coalesce_old"}


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id int, name string, state string, year int")


def test_merge_reads_and_writes_touched_buckets_only(spark, tmp_path):
    old = [(i, f"n{i}", "A", None if i % 3 else i) for i in range(300)]
    new = [(5, "x", "B", 1), (7, "y", None, 2), (900, "z", "B", None)]
    first = N.create(rows_of(spark, old), ["id"], str(tmp_path / "t"), 32)
    second = N.merge(first, rows_of(spark, new), RULES)
    want = {r[0]: r for r in old} | {5: (5, "n5", "B", 1), 7: (7, "n7", None, 2), 900: (900, "z", "B", None)}
    assert {r.id: tuple(r) for r in second.read(spark).collect()} == want
    hit = set(N.touched(first, rows_of(spark, new)))
    assert 1 <= len(hit) <= 3 and all((second.parts[b] == first.parts[b]) == (b not in hit) for b in first.parts)
    assert set(N.changed_buckets(first, second)) == hit
    again = N.latest(spark, str(tmp_path / "t"))
    assert again == second and {r.id: tuple(r) for r in first.read(spark).collect()} == {r[0]: r for r in old}
    read = second.read(spark, sorted(hit)).inputFiles()
    assert read and all(any(f"_bucket={b}/" in f for b in hit) for f in read)
    # A merge of nothing, and a second merge of the same version.
    assert N.merge(second, rows_of(spark, []), RULES).parts == second.parts
    with pytest.raises(Exception, match="there already|exists"):
        N.merge(first, rows_of(spark, new), RULES)


def test_violations_come_from_changed_buckets(spark, tmp_path):
    old = N.create(rows_of(spark, [(i, f"n{i}", "" if i % 2 else "A", None) for i in range(100)]), ["id"], str(tmp_path / "o"), 16)
    new = N.create(rows_of(spark, [(i, "other" if i == 4 else f"n{i}", "B" if i in (6, 7) else "" if i % 2 else "A", None) for i in range(100)]), ["id"], str(tmp_path / "n"), 16)
    got = {tuple(r) for r in N.violations_between(spark, old, new, "id", {"name": False, "state": True}).collect()}
    assert got == {("4", "name"), ("6", "state")} and len(N.changed_buckets(old, new)) <= 3
    assert N.violations_between(spark, old, old, "id", {"name": False}).count() == 0


def plain_deletes(tables, keys, ids, root, wanted):
    """One asked row at a time, by search through the references."""
    gone = {t: set() for t in tables}
    refused = set()
    for asked in wanted:
        doomed, open_, stop = {(root, asked)}, [(root, asked)], False
        while open_:
            table, i = open_.pop()
            for k in keys:
                if k.parent != table:
                    continue
                for row in tables[k.child]:
                    if row[k.column] == i:
                        if k.rule == "restrict":
                            stop = True
                        elif k.rule == "cascade" and (k.child, row[ids[k.child]]) not in doomed:
                            doomed.add((k.child, row[ids[k.child]]))
                            open_.append((k.child, row[ids[k.child]]))
        if stop:
            refused.add(asked)
        else:
            for t, i in doomed:
                gone[t].add(i)
    out = {}
    for t, rows in tables.items():
        kept = [dict(r) for r in rows if r.get(ids.get(t)) not in gone[t] or t not in ids]
        for k in keys:
            if k.child == t and k.rule == "set_null":
                for r in kept:
                    if r[k.column] in gone[k.parent]:
                        r[k.column] = None
        out[t] = sorted((tuple(r.values()) for r in kept), key=repr)
    return out, refused


@pytest.mark.parametrize("seed", [1, 2])
def test_delete_plan_equals_plain_search(spark, seed):
    rng = random.Random(seed)

    def make(prefix, n, **refers):
        return [{"id": f"{prefix}{i}", **{c: rng.choice([None, *[f"{p}{j}" for j in range(m)]]) for c, (p, m) in refers.items()}} for i in range(n)]

    tables = {
        "edition": make("e", 12), "passage": make("p", 40, edition=("e", 12)), "clause": make("c", 60, passage=("p", 40), edition=("e", 12)),
        "alignment": make("a", 60, passage=("p", 40)), "citation": make("x", 4, clause=("c", 60)), "note": make("n", 30, passage=("p", 40), clause=("c", 60)),
    }
    keys = [
        J.ForeignKey("passage", "edition", "edition", "id", "cascade"), J.ForeignKey("clause", "passage", "passage", "id", "cascade"),
        J.ForeignKey("clause", "edition", "edition", "id", "cascade"), J.ForeignKey("alignment", "passage", "passage", "id", "cascade"),
        J.ForeignKey("citation", "clause", "clause", "id", "restrict"), J.ForeignKey("note", "passage", "passage", "id", "set_null"),
        J.ForeignKey("note", "clause", "clause", "id", "set_null"),
    ]
    ids = {t: "id" for t in tables}
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in rows[0])) for t, rows in tables.items()}
    asked = [f"e{i}" for i in range(0, 12, 2)]
    left, refused = J.delete_rows(frames, ids, keys, "edition", spark.createDataFrame([(a,) for a in [*asked, "nowhere"]], "id string"))
    want, stopped = plain_deletes(tables, keys, ids, "edition", asked)
    assert {r.id for r in refused.collect()} == stopped and J.delete_order(keys, "edition") == ["edition", "passage", "alignment", "clause"]
    assert {t: sorted((tuple(r) for r in df.collect()), key=repr) for t, df in left.items()} == want
    with pytest.raises(ValueError, match="circle"):
        J.delete_order([J.ForeignKey("a", "x", "b", "id", "cascade"), J.ForeignKey("b", "x", "a", "id", "cascade")], "a")


def test_a_broken_run_repeats_open_shards_only(spark, tmp_path):
    calls = str(tmp_path / "calls.txt")

    def failing(batches):
        for b in batches:
            with open(calls, "a") as f:
                f.writelines(f"{i}\n" for i in b["passage_id"])
            if (b["passage_id"] == 13).any():
                raise RuntimeError("model is gone")
            yield pd.DataFrame({"passage_id": b["passage_id"], "text": b["text"].str.upper()})

    def working(batches):
        for b in batches:
            with open(calls, "a") as f:
                f.writelines(f"{i}\n" for i in b["passage_id"])
            yield pd.DataFrame({"passage_id": b["passage_id"], "text": b["text"].str.upper()})

    texts = [(i, None if i % 4 == 0 else "de", f"text of {i} here") for i in range(40)] + [(99, "en", "as it is"), (100, None, None)]
    passages = spark.createDataFrame(texts, "passage_id int, language string, raw_text string")
    stored = spark.createDataFrame([(3, "en")], "passage_id int, language string")

    def run(fn):
        return K.in_shards(passages, "passage_id", str(tmp_path / "out"), lambda p: K.infer_pending(p, stored, fn, target="en", translator="t"), shards=6)

    with pytest.raises(Exception, match="model is gone"):
        run(failing)
    bad = spark.createDataFrame([(13,)], "passage_id int").select(F.pmod(F.xxhash64("passage_id"), F.lit(6)).alias("s")).first().s
    shard = {r.passage_id: r.s for r in passages.select("passage_id", F.pmod(F.xxhash64("passage_id"), F.lit(6)).alias("s")).collect()}
    done = {i for i, s in shard.items() if s < bad}
    open(calls, "w").close()
    out = {r.passage_id: (r.status, r.text) for r in run(working).collect()}
    assert {int(x) for x in open(calls)} == {i for i in shard if i not in done and i not in (3, 99)}
    assert len(out) == 42 and out[3][0] == "cached" and out[99] == ("passthrough", "as it is") and out[4] == ("fresh", "TEXT OF 4 HERE") and out[100][0] == "empty"
    open(calls, "w").close()
    assert run(failing).count() == 42 and not open(calls).read()


@pytest.mark.parametrize("count", [1, 9])
def test_cells_are_exact_by_proof(spark, count):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12)) * 4
    vecs = centres[rng.integers(8, size=400)] + rng.normal(size=(400, 12))
    vecs[7] = 0
    p = spark.createDataFrame([(i, f"w{i % 3}", v.tolist()) for i, v in enumerate(vecs)] + [(900, "w0", None)], "passage_id int, work_slug string, vector array<double>")
    q = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(0, 40, 2)] + [(77, None)], "query_id int, vector array<double>")
    works = spark.createDataFrame([(2, ["w1"]), (4, [])], "query_id int, works array<string>")
    cells = G.build_cells(p, count, block_rows=90)
    want = sorted(tuple(r) for r in Q.dense_search(q, p, query_works=works, limit=6).select("query_id", "passage_id", "similarity", "rank").collect())
    got = G.cell_search(q, cells, query_works=works, limit=6).select("query_id", "passage_id", "similarity", "rank")
    assert sorted(tuple(r) for r in got.collect()) == want
    every = G.cell_search(q, cells, limit=6, probes=count)
    exact = G.cell_search(q, cells, limit=6)
    assert {r.recall for r in G.recall(exact, every).collect()} == {1.0}
    if count > 1:
        some = [r.recall for r in G.recall(exact, G.cell_search(q, cells, limit=6, probes=2)).collect()]
        assert sum(some) / len(some) >= 0.8
        # Cells are left out by their bounds, not by chance.
        bounds = G.cell_bounds(q.filter("vector is not null"), cells).filter("turn > 2").join(
            exact.filter("rank = 6").select("query_id", "similarity"), "query_id"
        )
        assert bounds.filter("bound < similarity").count() > bounds.count() / 2
    assert G.cell_search(q, G.build_cells(p.limit(0)), limit=6).count() == 0


def test_the_registered_cell_search_asks_every_fiftieth_vector(spark):
    found = runner("d14_cell_search")(spark, "/root/testdata/sf0.001").select("query_id").distinct().collect()
    every = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert len(found) == every and all(r.query_id % 50 == 0 for r in found)


def test_the_registered_cell_search_asks_every_vector(spark):
    found = runner("d14_cell_search")(spark, "/root/testdata/sf0.001").select("query_id").distinct().count()
    assert found == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("embedding is not null").count()


def test_a_cell_search_writes_no_row_for_every_query_and_cell(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(300, 6))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)], "id int, vector array<double>")
    cells = G.build_cells(v.withColumnRenamed("id", "passage_id"), 12)
    q, written, real = v.filter("id < 20").withColumnRenamed("id", "query_id"), [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda *a, **k: written.append(real(*a, **k)) or written[-1])
    got = {(r.query_id, r["rank"]): r.passage_id for r in G.cell_search(q, cells, limit=4).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    best = np.argsort(-(unit[:20] @ unit.T), axis=1)
    assert got == {(i, r + 1): best[i, r] for i in range(20) for r in range(4)}
    assert max(t.count() for t in written) <= 2 * 20
