from passagework.operators import grounding as G

PASSAGES = [
    (1, 1, 1, "a", "kitten puppy horse sheep goats camel donkey rabbit tiger zebra"),
    (1, 1, 2, "b", "river mountain valley desert ocean"),
    (1, 1, 3, "c", "river stone paper glass metal"),
]
TEXT = "\n".join(
    [
        "kitten puppy walked along quietly yesterday evening [9]",
        "kitten puppy horse sheep goats camel donkey [1]",
        "verse words only here",
        "unrelated tokens without anything shared",
        "river 1234 mixed content stays corrupt",
        "river walked along quietly [3][2]",
        "tiny [1]",
    ]
)


def test_every_branch(spark):
    evidence = spark.createDataFrame(PASSAGES, "chapter int, verse int, marker int, passage_id string, text string")
    verses = spark.createDataFrame([(1, 1, "verse words only here indeed")], "chapter int, verse int, text string")
    out = spark.createDataFrame([(7, 1, 1, TEXT), (8, 1, 2, TEXT)], "output_id int, chapter int, verse int, text string")
    v = G.verify_sentences(G.split_generated(out), evidence, verses, ["output_id"], foreign="[0-9]{4}").cache()
    rows = v.filter("output_id = 7").orderBy("ord").collect()
    assert [r.reason for r in rows] == [
        None, "reproduces the passage", "restates the verse", "no passage supports this sentence",
        "foreign script inside the text", None,
    ]
    assert rows[0].citations == [1] and rows[5].citations == [2, 3]
    s = {r.output_id: r for r in G.summarise_verdicts(v, evidence, ["output_id"]).collect()}
    assert (s[7].sentences_generated, s[7].sentences_kept, s[7].sentences_removed) == (6, 2, 4)
    assert s[7].cited_passage_ids == ["a", "b", "c"] and s[7].note is None
    assert s[7].summary_text.endswith("river walked along quietly [2][3]")
    assert s[8].note == "too few passages" and s[8].summary_text == ""
