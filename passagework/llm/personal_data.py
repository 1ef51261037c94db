"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field cuts a stretch of tokens into segments, each an entity of at most MAX_TOKENS tokens or a single other
token. A segment is scored as a whole (its shape, digits, checksum and neighbours), so boundaries and types are
chosen together by one dynamic program over all candidate segments. It is trained on stretches of the corpus whose
pattern matches are the labels, some of them rewritten into forms that the patterns miss.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.common import chunks, mapped

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits if it couldn't begin at the run's start.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
AT = re.compile(r" ?(?:@|[\[(]at[\])]) ?", re.I)

MAX_TOKENS = 16
MAX_CHARS = 64
#: Characters of context on either side of a trigger, and of one stretch.
CONTEXT, STRETCH = 40, 1500
#: Least posterior probability of an added span.
SURE = 0.9

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Pattern matches, leftmost and not overlapping within a kind, by start and then kind."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a field has anything to decide: triggers with context, joined where they meet, cut at blanks beyond STRETCH."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            if b - out[-1][0] <= STRETCH:
                out[-1][1] = b
                continue
            cut = text.rfind(" ", out[-1][0] + CONTEXT, m.start())
            a = out[-1][1] = cut + 1 if cut > 0 else m.start()
        out.append([a, b])
    return [(a, b) for a, b in out if a < b]


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 6)), s))


def features(text: str, a: int, b: int, before: str, after: str) -> list[str]:
    """Of a whole segment text[a:b] and the tokens next to it."""
    s = text[a:b]
    digits = _digits(s)
    parts = s.split(".")
    plain = AT.sub("@", re.sub(r" ?[\[(]dot[\])] ?", ".", s, flags=re.I))
    letters = any(c.isalpha() for c in s)
    whole = "m" if base_spans(plain)[:1] == [("email", 0, len(plain))] else "-"
    return [
        "bias",
        f"digits={len(digits)}",
        f"letters={letters}",
        f"email={whole}",
        f"ip={len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}",
        f"luhn={12 <= len(digits) <= 19 and luhn(digits)},{letters}",
        f"range={9 <= len(digits) <= 15},{letters},{'(' in s}",
        f"head={s[0] if not s[0].isalnum() else '9' if s[0].isdigit() else 'a'}",
        f"tail={s[-1] if not s[-1].isalnum() else '9' if s[-1].isdigit() else 'a'}",
        f"shape={_shape(s)}" if not letters else "shape=mixed",
        f"joined={a > 0 and text[a - 1].isalnum()},{b < len(text) and text[b].isalnum()}",
        f"edge={text[a - 1] if a else '^'}" if a and text[a - 1] in "+.@-_%" else "edge=-",
        f"next={text[b] if b < len(text) and text[b] in '.@-_%' and text[b + 1 : b + 2].isalnum() else '-'}",
        f"before={before}",
        f"after={after}",
    ]


class Lattice:
    """Tokens of a stretch and its candidate segments by their past-the-last token."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [m.span() for m in TOKEN.finditer(text)]
        n, tokens = len(self.tokens), self.tokens
        word = [text[a:b].lower() if not text[a:b].isdigit() else "#" for a, b in tokens]
        self.ending: list[list[tuple[int, list[str]]]] = [[] for _ in range(n + 1)]
        for i, (a, _) in enumerate(tokens):
            if not (text[a].isalnum() or text[a] in "+("):
                continue
            digits, marked = 0, False
            for j in range(i, min(i + MAX_TOKENS, n)):
                s, e = tokens[j]
                if e - a > MAX_CHARS or (j > i and s - tokens[j - 1][1] > 1):
                    break
                digits += sum("0" <= c <= "9" for c in text[s:e])
                marked = marked or text[s:e] == "@" or (word[j] == "at" and text[s - 1 : s] in ("[", "("))
                if (digits >= 4 or marked) and (text[e - 1].isalnum() or text[e - 1] == ")"):
                    self.ending[j + 1].append((i, features(text, a, e, word[i - 1] if i else "^", word[j + 1] if j + 1 < n else "$")))


class Field:
    """Weights of segment features by kind and of transitions; type 0 is a single other token."""

    def __init__(self):
        self.weights: dict[str, list[float]] = {}
        self.moves = [[0.0] * 5 for _ in range(5)]

    def score(self, feats: list[str]) -> list[float]:
        rows = [self.weights[f] for f in feats if f in self.weights]
        return [sum(r[y] for r in rows) for y in range(4)]

    def _edges(self, lattice: Lattice) -> list[list[tuple[int, int, float, list[str]]]]:
        """By end: (start, type, score, features)."""
        out = []
        for j, segments in enumerate(lattice.ending):
            edges = [(j - 1, 0, 0.0, [])] if j else []
            for i, feats in segments:
                edges += [(i, y + 1, v, feats) for y, v in enumerate(self.score(feats))]
            out.append(edges)
        return out

    def marginals(self, lattice: Lattice) -> tuple[list, list]:
        """Posterior of every edge as (start, end, type, p, features), and expected transitions."""
        n, edges = len(lattice.tokens), self._edges(lattice)
        low = -1e30
        fore = [[low] * 5 for _ in range(n + 1)]
        fore[0][0] = 0.0
        into = {}
        for j in range(1, n + 1):
            sums: list[list[float]] = [[] for _ in range(5)]
            for k, (i, y, v, _) in enumerate(edges[j]):
                terms = [fore[i][x] + self.moves[x][y] for x in range(5)]
                into[j, k] = v + _logsum(terms)
                sums[y].append(into[j, k])
            fore[j] = [_logsum(t) if t else low for t in sums]
        total = _logsum(fore[n])
        back = [[low] * 5 for _ in range(n + 1)]
        back[n] = [0.0] * 5
        pending: list[list[list[float]]] = [[[] for _ in range(5)] for _ in range(n + 1)]
        found, moved = [], [[0.0] * 5 for _ in range(5)]
        for j in range(n, 0, -1):
            if j < n:
                back[j] = [_logsum(t) if t else low for t in pending[j]]
            for k, (i, y, v, feats) in enumerate(edges[j]):
                p = math.exp(min(0.0, into[j, k] + back[j][y] - total))
                if p > 1e-6:
                    found.append((i, j, y, p, feats))
                    for x in range(5):
                        moved[x][y] += math.exp(min(0.0, fore[i][x] + self.moves[x][y] + v + back[j][y] - total))
                for x in range(5):
                    pending[i][x].append(self.moves[x][y] + v + back[j][y])
        return found, moved

    def best(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """The most probable segmentation's entities as (start, end, type)."""
        n, edges = len(lattice.tokens), self._edges(lattice)
        top = [[-1e30] * 5 for _ in range(n + 1)]
        top[0][0] = 0.0
        how: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            for i, y, v, _ in edges[j]:
                for x in range(5):
                    got = top[i][x] + self.moves[x][y] + v
                    if got > top[j][y]:
                        top[j][y], how[j, y] = got, (i, x)
        out, j, y = [], n, max(range(5), key=lambda t: top[n][t])
        while j:
            i, x = how[j, y]
            if y:
                out.append((i, j, y))
            j, y = i, x
        return out[::-1]

    def train(self, examples: list[tuple[str, list[Span]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Stochastic ascent of the conditional likelihood."""
        ready = []
        for text, spans in examples:
            lattice = Lattice(text)
            starts = {a: i for i, (a, _) in enumerate(lattice.tokens)}
            ends = {b: i + 1 for i, (_, b) in enumerate(lattice.tokens)}
            gold = {(starts.get(a), ends.get(b), KINDS.index(k) + 1) for k, a, b in spans}
            have = {(i, j) for j, segments in enumerate(lattice.ending) for i, _ in segments}
            if all((i, j) in have for i, j, _ in gold):
                ready.append((lattice, gold))
        for r in range(rounds):
            step = rate / (1 + r)
            for lattice, gold in ready:
                found, moved = self.marginals(lattice)
                change: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
                for j, segments in enumerate(lattice.ending):
                    for i, feats in segments:
                        for y in range(1, 5):
                            if (i, j, y) in gold:
                                for f in feats:
                                    change[f][y - 1] += 1
                for _, _, y, p, feats in found:
                    if y:
                        for f in feats:
                            change[f][y - 1] -= p
                for f, c in change.items():
                    w = self.weights.setdefault(f, [0.0] * 4)
                    for y in range(4):
                        w[y] += step * (c[y] - decay * w[y])
                last = 0
                at = 0
                for i, j, y in sorted(gold):
                    for t in [0] * (i - at) + [y]:
                        self.moves[last][t] += step
                        last = t
                    at = j
                for _ in range(len(lattice.tokens) - at):
                    self.moves[last][0] += step
                    last = 0
                for x in range(5):
                    for y in range(5):
                        self.moves[x][y] -= step * moved[x][y]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans of the best segmentation that are nearly sure and touch no base span."""
        lattice = Lattice(text)
        chosen = self.best(lattice)
        if not chosen:
            return []
        posterior = {(i, j, y): p for i, j, y, p, _ in self.marginals(lattice)[0]}
        out = []
        for i, j, y in chosen:
            a, b = lattice.tokens[i][0], lattice.tokens[j - 1][1]
            if posterior.get((i, j, y), 0) >= SURE and not any(s < b and a < e for _, s, e in base):
                out.append((KINDS[y - 1], a, b))
        return out


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _rewritten(text: str, spans: list[Span]) -> tuple[str, list[Span]] | None:
    """The stretch with its phones without the plus sign and its addresses with a spelled sign; None if nothing changes."""
    out, at, moved = [], 0, []
    for kind, a, b in spans:
        if a < at:
            return None
        s = text[a:b]
        new = s[1:] if kind == "phone" and not s[1:].isdigit() else s.replace("@", " [at] ") if kind == "email" else s
        out.append(text[at:a])
        start = sum(map(len, out))
        out.append(new)
        moved.append((kind, start, start + len(new)))
        at = b
    made = "".join([*out, text[at:]])
    return None if made == text else (made, moved)


#: Tasks among which the stretches of one class are dealt when the sample is chosen.
SALTS = 32


def fit(docs: DataFrame, sample: int = 400, longest: int = 400) -> Field:
    """Train on a bounded sample: `sample` distinct stretches with pattern matches and as many without, those of least
    hash among the stretches of at most `longest` characters. Finding knows no such bound."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            made = {}
            for t in b.column("text").to_pylist():
                if t:
                    for s, e in stretches(t):
                        if e - s <= longest:
                            made[t[s:e]] = bool(base_spans(t[s:e]))
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.bool_())], ["text", "held"])

    cuts = docs.select("text").transform(mapped, cut, "text string, held boolean").distinct().withColumn("h", F.xxhash64("text"))
    order = ["h", "text"]
    least = (
        cuts.withColumn("rank", F.row_number().over(Window.partitionBy("held", F.pmod("h", F.lit(SALTS))).orderBy(*order)))
        .where(F.col("rank") <= sample)
        .withColumn("rank", F.row_number().over(Window.partitionBy("held").orderBy(*order))).where(F.col("rank") <= sample)
    )
    examples = []
    for r in least.orderBy(*order).collect():  # at most 2 * sample short texts
        spans = base_spans(r.text)
        if any(x[2] > y[1] for x, y in zip(spans, spans[1:], strict=False)):
            continue  # two kinds overlap: no segmentation has both
        examples.append((r.text, spans))
        made = _rewritten(r.text, spans)
        if made:
            examples.append(made)
    field = Field()
    field.train(examples)
    return field


def all_spans(text: str, field: Field, known: dict[str, list[Span]] | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans together, both by start and then kind."""
    base = base_spans(text)
    added: list[Span] = []
    for a, b in stretches(text):
        own = [(k, s - a, e - a) for k, s, e in base if s < b and e > a]
        free = "".join(" " if any(s <= m < e for _, s, e in own) else c for m, c in enumerate(text[a:b])) if own else text[a:b]
        if not TRIGGER.search(free):
            continue  # base spans take every trigger: nothing is left to add
        piece = text[a:b]
        if not own and known is not None and piece in known:
            new = known[piece]
        else:
            new = field.added(piece, own)
            if not own and known is not None and len(known) < 20_000:
                known[piece] = new
        added += [(k, s + a, e + a) for k, s, e in new]
    every = sorted([*base, *set(added)], key=lambda s: (s[1], KINDS.index(s[0])))
    return base, every


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """Per row: doc_id, base (kind, start, end), base_sha256, spans, n_added; offsets are code points, end exclusive.

    A null text has no spans. Whole texts are read; repeated rows repeat; an empty table stays empty; no other
    column is read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Span]] = {}
        for b in chunks(batches):
            made = [all_spans(t or "", field, known) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    *[pa.array([sum(s[0] == k for s in base) for base, _ in made], pa.int64()) for k in KINDS],
                    pa.array([hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in made], pa.string()),
                    pa.array([_said(every) for _, every in made], pa.string()),
                    pa.array([len(every) - len(base) for base, every in made], pa.int64()),
                ],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    return docs.select("doc_id", "text").transform(
        mapped, find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def mask(text: str, spans: list[Span]) -> str:
    """`text` with each span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with all spans masked in text; n_chars, where there is such a column of longs, follows the new text.

    Null and empty texts stay as they are, a null n_chars stays null; very long texts are masked whole; repeated rows
    repeat; an empty table stays empty; all other columns travel along unread, whatever their names.
    """
    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Span]] = {}
        for b in chunks(batches):
            texts = [t and mask(t, all_spans(t, field, known)[1]) for t in b.column("text").to_pylist()]
            columns = list(b.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names and pa.types.is_int64(columns[names.index("n_chars")].type):
                old = columns[names.index("n_chars")].to_pylist()
                columns[names.index("n_chars")] = pa.array([len(t) if t is not None and n is not None else n for t, n in zip(texts, old, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.transform(mapped, rewrite, docs.schema)
