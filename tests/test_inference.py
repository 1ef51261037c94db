import hashlib

import pandas as pd
from pyspark.sql import functions as F

from passagework.operators.inference import hashing_embedder
from passagework.plans.report_queries import squared_lengths


def test_squared_lengths_are_those_of_the_embedder_and_hash_each_word_once(spark):
    texts = [(1, "a b a c"), (2, ""), (3, "é é é"), (4, " ".join(f"w{i % 37}" for i in range(500))), (5, None)]
    rows = spark.createDataFrame(texts, "passage_id int, raw_text string")
    words = F.filter(F.split("raw_text", "[ ]+"), lambda w: w != "")
    lengths = rows.select("passage_id", squared_lengths(words).alias("total"))
    assert lengths._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    got = {r.passage_id: r.total for r in lengths.collect()}
    assert not got[2] and not got[5]
    vectors = next(hashing_embedder(16)(iter([pd.DataFrame([t for t in texts if t[1] is not None], columns=["passage_id", "text"])])))
    for i, v in zip(vectors["passage_id"], vectors["embedding"], strict=True):
        counts = [0] * 16
        for w in (texts[i - 1][1] or "").split():
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        total = sum(k * k for k in counts)
        assert got[i] == ([total] if total else [])
        assert [round(float(x) * total**0.5) for x in v] == counts
