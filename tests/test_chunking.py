from passagework.operators.chunking import chunk_documents


def chunks(spark, texts, **kwargs):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out: dict[int, list[str]] = {}
    for r in chunk_documents(df, "text", **kwargs).orderBy("doc_id", "chunk_index").collect():
        assert r.chunk_index == len(out.setdefault(r.doc_id, []))
        assert r.char_count == len(r.raw_text)
        out[r.doc_id].append(r.raw_text)
    return out


def test_structure(spark):
    sentence = "كلام طويل في هذا الموضوع من المواضيع المهمة. "
    texts = [
        "", "   \n ", "short", "a" * 1000 + "\n\n" + "b" * 1000 + "\n\n" + "c" * 50,
        sentence * 200, "x" * 500 + "\n* *\n" + "y" * 500 + "\n---\n" + "z" * 500,
        "m" * 700 + "\nوقوله تعالى " + "n" * 700, "q" * 5000,
    ]
    got = chunks(spark, texts)
    assert 0 not in got and 1 not in got and got[2] == ["short"]
    assert got[3] == ["a" * 1000, "b" * 1000 + "\n\n" + "c" * 50]
    assert all(len(c) <= 2200 * 1.5 for c in got[4]) and "".join(got[4]).replace(" ", "") == (sentence * 200).replace(" ", "")
    assert got[5] == ["x" * 500 + "\n\n" + "y" * 500, "z" * 500]
    assert got[6] == ["m" * 700, "وقوله تعالى " + "n" * 700]
    assert got[7] == ["q" * 5000]
