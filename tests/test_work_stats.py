from passagework.operators import reports as P


def test_a_large_table_of_alignments_gets_more_tasks(spark, monkeypatch):
    works = spark.createDataFrame([(f"k{i}",) for i in range(4)], "work_slug string")
    passages = spark.createDataFrame([(i, f"k{i % 3}") for i in range(90)], "passage_id int, work_slug string")
    places = spark.createDataFrame([(i, 1, i % 7) for i in range(80)], "passage_id int, chapter int, verse_start int")
    want = sorted(P.work_stats(works, passages, places).collect())
    monkeypatch.setattr(P, "STATS_ROWS", 2)
    split = P.work_stats(works, passages, places)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and sorted(split.collect()) == want
    assert want[0].passage_count == 30 and want[0].verse_count == 7 and want[3].passage_count == 0
