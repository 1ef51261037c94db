import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from passagework.llm.decontamination import contamination, drop_contaminated, phrase_matches
from passagework.llm.language import UNKNOWN, fit, held_out, identify, keep_identified
from passagework.llm.personal_data import KINDS, base_spans, find_personal_data, luhn, mask, mask_documents
from passagework.llm.personal_data import fit as fit_personal_data
from passagework.llm.sharding import shard_documents, write_shards

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def plain_contamination(rows, items, window):
    phrases = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for i, t, _ in rows:
        w, hit, held = words(t), set(), set()
        for p, own in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    held |= own
        out.append((i, len(w), len(hit), sorted(map(str, held))))
    return sorted(out, key=repr)


def items_of(rows):
    texts = dict((i, t) for i, t, _ in rows)
    some = texts[6].split()
    return [
        (1, " ".join(some[10:40])), (2, "ALPHA of. green"), (10, None), (11, ""), (12, "no. no. no. no. no. no. no. no. no. no. no. no."),
        (3, " ".join(some[50:60]) + " other words entirely"), (None, "tower stone river"), (3, "the the of"), (4, "née größe niño"), (5, "absent words only here"), (5, "absent words only here"),
    ]


def test_contamination_matches_brute_force(spark, docs, rows, empty):
    items = spark.createDataFrame([(*x, 1, "k") for x in items_of(rows)], "item_id long, text string, pos int, key string").repartition(2)
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in contamination(docs, items).collect()]
    named = [(i, t) for i, t in items_of(rows) if i is not None]
    want = plain_contamination(rows, named, 10)
    # A window without an item_id still hits.
    hits = plain_contamination(rows, [(0 if i is None else i, t) for i, t in items_of(rows)], 10)
    assert sorted([(i, n, items) for i, n, _, items in got], key=repr) == sorted([(i, n, items) for i, n, _, items in want], key=repr)
    assert sorted([x[:3] for x in got], key=repr) == sorted([x[:3] for x in hits], key=repr)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not x[2] for x in hits)
    assert contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in contamination(docs, items.limit(0)).collect())


def test_proximity(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text.replace("five", "FIVE")), (2, text.replace("five", "5th")), (3, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    found = {(r.exact, r.first_pos, r.last_pos) for r in phrase_matches(docs, items, 10, near=9).collect()}
    assert found == {(True, 0, 10), (False, 0, 10)}


def test_shards_match_plain_sums(docs, rows, empty, tmp_path):
    made = shard_documents(docs, 5).collect()
    data = [((t or "").encode(), i) for i, t, _ in rows]
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in made], key=repr) == sorted([(i, len(b) + 8, zlib.crc32(b)) for b, i in data], key=repr)
    ordered, at, total = sorted(made, key=lambda r: r.byte_start), 0, sum(r.size for r in made)
    slots = {}
    for r in ordered:
        assert r.byte_start == at and r.shard == min(4, 5 * (2 * at + r.size) // (2 * total)) and r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        at += r.size
    assert [(r.doc_id is not None, r.doc_id) for r in ordered if r.doc_id is not None] == sorted((True, r.doc_id) for r in ordered if r.doc_id is not None)
    assert shard_documents(empty).count() == 0
    once = docs.where("doc_id >= 10")
    write_shards(once, shard_documents(once, 3), str(tmp_path / "s"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == once.count()


def prose(lang, rng):
    parts = {"en": ["the", "ing", "tion", "wh", "ther", "and"], "de": ["ung", "sch", "ein", "über", "der", "ß"], "fr": ["eau", "que", "ère", "ç", "les", "oi"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))


def test_languages_are_learned(spark, docs, empty):
    rng = random.Random(1)
    data = [(i, prose(lang := rng.choice(["en", "de", "fr"]), rng), lang) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    model = fit(df.where(~held_out()))
    truth = {i: lang for i, _, lang in data}
    found = identify(df.where(held_out()).withColumn("lang", df.lang * 0), model).collect()
    assert len(found) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in data)
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) >= 0.98 * len(found) and not any(r.rejected for r in found)
    odd = {r.doc_id: r for r in identify(docs.where("doc_id in (1, 2, 3, 16)"), model).collect()}
    assert {r.lang_pred for r in odd.values()} == {UNKNOWN} and {r.score for r in odd.values()} == {0.0}
    far = spark.createDataFrame([(1, "ящик " * 30, None), (2, prose("de", rng), None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in keep_identified(far, model).collect()] == [2]
    nothing = fit(empty)
    assert identify(empty, model).count() == 0 and {r.lang_pred for r in identify(docs, nothing).collect()} == {UNKNOWN}


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a0149.@+- ()%_é\n", max_size=60) | st.text(alphabet="4111 1-.", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert base_spans(text) == plain_spans(text)


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_personal_data(spark, docs, rows, empty):
    rng = random.Random(4)

    def phone():
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    texts = [f"{prose('en', rng)} {rng.choice([phone(), f'{prose("en", rng).split()[0]}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com', '.'.join(str(rng.randint(1, 255)) for _ in range(4)), 'Version 2.0 of 1999'])} {prose('de', rng)}" for _ in range(250)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    field = fit_personal_data(df)
    clean = [r for r in find_personal_data(df, field).collect() if "Version" in texts[r.doc_id]]
    assert clean and all(r.spans == "" for r in clean)
    missed = "please call 1 (415) 555-1234 today"
    found = find_personal_data(spark.createDataFrame([(1, missed)], "doc_id long, text string"), field).collect()[0]
    assert found.spans == "phone:12:28" and found.n_phone == 0 and found.n_added == 1
    got = {(r.doc_id, r.base_sha256, r.spans) for r in find_personal_data(docs, field).collect()}
    said = lambda t: ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or ""))
    assert {(i, s) for i, s, _ in got} == {(i, hashlib.sha256(said(t).encode()).hexdigest()) for i, t, _ in rows}
    assert mask("to a@b.cd or 1.2.3.4", base_spans("to a@b.cd or 1.2.3.4")) == "to [EMAIL] or [IP]"
    masked = mask_documents(docs, field)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    assert find_personal_data(empty, field).count() == 0 and fit_personal_data(empty).weights == {}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    texts = [prose(rng.choice(["en", "de", "fr"]), rng) for _ in range(150)]
    long = " ".join(prose("en", rng) for _ in range(4))
    texts += [long, long, " ".join([*long.split()[:-1], "other"]), None, "12 34", " ".join(texts[0].split() * 3), "write to x.1@mail.example.com please " + long[::-1]]
    leak = " ".join(prose("de", rng) for _ in range(3))
    texts.append(leak + " and more " + texts[1])
    data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "personal_data", "pieces"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    n = 150
    assert not {n + 3, n + 4} & set(seen[0]) and len(seen[0]) == len(texts) - 2
    assert n in seen[1] and not {n + 1, n + 2} & set(seen[1])
    assert set(seen[1]) - set(seen[2]) == {n + 7}
    assert set(seen[3]) == set(seen[2]) and "[EMAIL]" in seen[3][n + 6]
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == set(seen[3])
    assert all(r.decoded_sha256 == hashlib.sha256(seen[3][i].encode()).hexdigest() for i, r in final.items())
