import collections

import numpy as np
import pytest

from passagework.llm import passages
from passagework.llm.phrases import remove_repeated_phrases
from passagework.llm.suffixes import remove_repeated_strings, sort_suffixes


def plain_phrases(rows, window):
    cut = [(i, (t or "").encode().split()) for i, t, _ in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for _, w in cut for k in range(len(w) - window + 1))
    out = []
    for i, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def plain_strings(rows, window):
    """Rows that agree in doc_id and text are one text; other rows of one doc_id are left out by the caller."""
    seen, made = set(), {}
    for i, t in sorted({(i, t or "") for i, t, _ in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            s = raw[k : k + window]
            if s in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(s)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        made[i, t] = (i, len(raw), sum(gone), spans, bytes(x for x, g in zip(raw, gone, strict=True) if not g))
    return sorted((made[i, t or ""] for i, t, _ in rows), key=repr)


@pytest.mark.parametrize("together", [2000, 3])  # 3: every anchor is dealt into several tasks
def test_phrases_match_brute_force(docs, rows, together, monkeypatch):
    monkeypatch.setattr(passages, "TOGETHER", together)
    got = sorted((tuple(r) for r in remove_repeated_phrases(docs, 35).collect()), key=repr)
    assert got == plain_phrases(rows, 35)


@pytest.mark.parametrize("together", [2000, 3])
def test_strings_match_brute_force(spark, docs, rows, together, monkeypatch):
    monkeypatch.setattr(passages, "TOGETHER", together)
    one_text = [r for r in rows if not (r[0] == 9 and r[2] == "fr") and not (r[0] is None and r[1] is None)]
    kept = docs.where("not (doc_id <=> 9 and lang <=> 'fr') and not (doc_id is null and text is null)")
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in remove_repeated_strings(kept, 100).collect()), key=repr)
    assert got == plain_strings(one_text, 100)


def test_empty(empty):
    assert remove_repeated_phrases(empty).count() == 0
    assert remove_repeated_strings(empty).count() == 0


def test_suffix_sort():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 60)).astype(np.uint8)) for _ in range(300)] + [b"a" * 50] * 3
    strings += [b"a" * 40 + bytes([98 + i % 3, i]) for i in range(40)]
    groups = rng.integers(0, 4, len(strings))
    order, shared = sort_suffixes(strings, groups, shallow=8)
    width = 64
    wide = [s.ljust(width, b"\0") for s in strings]
    assert [(groups[i], wide[i]) for i in order] == sorted((g, w) for g, w in zip(groups, wide, strict=True))
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        if groups[a] != groups[b]:
            assert shared[k] == -1
        else:
            assert shared[k] == next((i for i in range(width) if wide[a][i] != wide[b][i]), width)
