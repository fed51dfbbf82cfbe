"""Personal information inside free text: a linear-chain conditional random field over word-shape features.

The field is trained from the small labelled table of pii_labels by gradient steps on the conditional log-likelihood
(forward-backward in numpy over the whole table at once) and decoded by Viterbi in numpy batches of segments. A token's
features are its form (digits made 0), lower form, shape, ends and length; each is seen at places up to four tokens
after and two before it. As features hang on token types, the emission of a position is a sum of seven rows of type tables; types are few.

Every segment (lines, split at sentence ends) of every text is scored. Where the scores prove that the best path has no label
the path itself isn't traced; the result is the same. Spans that lack what their kind needs by definition (an
email needs an at and a host, a phone seven digits, and so on) are dropped after decoding. The text with typed placeholders
([EMAIL], [PHONE], ...) is the text with these spans replaced.

Defined results: null text has no kinds and null masked text; empty text stays; texts of any length are used whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.pii_labels import KINDS, labelled_table
from lumenfold.session import spread

TOKEN = re.compile(r"%[0-9A-Fa-f]{2}|[^\W\d_]+|\d+|\n|[^\w\s]|_")
SPLIT = re.compile(r"\n+|[.!?][ \t]+")
#: What a sentence's last word ends in; a title's short form doesn't end a sentence.
SENTENCE = re.compile(r"[^\W\d_A-Z]{3}\Z")
AT = re.compile(r"@|%40|\(at\)|\[at\]|\{at\}|\bat\b[^\n]*\bdot\b", re.I)
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
L = len(LABELS)
BUCKETS = 1 << 15
OFFSETS = (-4, -3, -2, -1, 0, 1, 2)
#: Tokens scored at once.
CHUNK = 1 << 16
#: A form must stand so often in the training table to have a feature of its own.
KNOWN = 5
PAD = max(map(abs, OFFSETS))
#: Places of a padded batch of segments.
PLACES = 1 << 18


def token_type(tok: str) -> str:
    return "0" * len(tok) if tok.isdigit() else tok


class _Norm(dict):
    def __missing__(self, tok: str) -> str:
        if len(self) > 1 << 18:
            self.clear()
        t = self[tok] = token_type(tok)
        return t


def _features(t: str, known: bool) -> list[str]:
    shape = re.sub(r"[a-zà-ÿ]+", "x", re.sub(r"[A-ZÀ-Þ]", "X", t))
    low = t.lower()
    return ["w=" + low if known else "w?", "s=" + shape, "b=" + low[:3], "e=" + low[-3:], "e4=" + low[-4:], "c=" + (t[:1].isupper() and "U" or t.isdigit() and "D" or t.isalpha() and "l" or t), f"n={min(len(t), 8)}{t.isdigit()}", "1"]


@lru_cache(maxsize=1 << 16)
def feature_ids(t: str, known: bool) -> tuple[int, ...]:
    """known: the form stands often in the training table; all others share one form, as words of the data mostly are new."""
    return tuple(xxhash.xxh32_intdigest(f) % BUCKETS for f in _features(t, known))


class Types(dict):
    """token type -> row of the type tables; new types get the next row. 0 is the place outside the segment."""

    def __init__(self):
        super().__init__({"": 0})
        self.names = [""]

    def __missing__(self, t: str) -> int:
        self[t] = k = len(self.names)
        self.names.append(t)
        return k


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Lines, split at sentence ends."""
    pos = 0
    for m in SPLIT.finditer(text):
        end = m.start()
        if text[end] != "\n":
            if end - pos < 3 or not SENTENCE.match(text[end - 3 : end]) or text[end - 4 : end + 1] in ("Prof.", "prof."):
                continue
            end += 1
        if end > pos:
            yield pos, end
        pos = m.end()
    if pos < len(text):
        yield pos, len(text)


def plain_and_spans(row: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text of a labelled row, and its spans."""
    text, spans = "", []
    for part in re.split(r"(\[\[\w+\|.*?\]\](?!\]))", row):
        m = re.fullmatch(r"\[\[(\w+)\|(.*)\]\]", part)
        if m:
            spans.append((len(text), len(text) + len(m.group(2)), m.group(1)))
        text += m.group(2) if m else part
    return text, spans


def _labelled(row: str) -> list[tuple[list[str], list[int]]]:
    """Tokens and labels of each segment of a labelled row, cut as texts to be tagged are."""
    text, spans = plain_and_spans(row)
    out = []
    for a, b in segments(text):
        toks = list(TOKEN.finditer(text, a, b))
        labs = [0] * len(toks)
        for x, y, kind in spans:
            inside = [k for k, t in enumerate(toks) if x <= t.start() and t.end() <= y]
            for k in inside:
                labs[k] = 2 + 2 * KINDS.index(kind)
            if inside:
                labs[inside[0]] -= 1
        out.append(([t.group() for t in toks], labs))
    return out


class Model:
    """weights: (offset, bucket, label); trans: (label, label); start: label; known: lower forms with a feature of their own."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray, known: frozenset[str] = frozenset()):
        self.weights, self.trans, self.start, self.known = weights, trans, start, known


def _matrix(names: list[str], known: frozenset[str]) -> np.ndarray:
    """(type, feature): every token has the same number of features."""
    return np.array([feature_ids(t, t.lower() in known) for t in names])


class _Adder:
    """Adds rows by a fixed index: sorted once, then summed by stretches."""

    def __init__(self, index: np.ndarray):
        self.order = np.argsort(index, kind="stable")
        at = index[self.order]
        self.starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.slots = at[self.starts]

    def __call__(self, out: np.ndarray, rows: np.ndarray) -> None:
        out[self.slots] += np.add.reduceat(rows[self.order], self.starts, axis=0)


def _pad(seqs: list[list[int]], fill: int) -> np.ndarray:
    out = np.full((len(seqs), max(map(len, seqs))), fill, dtype=np.int64)
    for k, s in enumerate(seqs):
        out[k, : len(s)] = s
    return out


def _emissions(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """tables: (offset, type, label); x: (segment, place), 0 outside."""
    wide = np.pad(x, ((0, 0), (PAD, PAD)))
    return sum(tables[k][wide[:, PAD + o : PAD + o + x.shape[1]]] for k, o in enumerate(OFFSETS))


class _Bucket:
    """Sequences of like length, padded together, with what of their sums doesn't change between rounds."""

    def __init__(self, seqs: list[list[int]], labs: list[list[int]]):
        self.x, y = _pad(seqs, 0), _pad(labs, -1)
        self.mask = y >= 0
        self.last = self.mask.sum(1) - 1
        n, T = self.x.shape
        self.hot = np.zeros((n, T, L), dtype=np.float32)
        self.hot[np.nonzero(self.mask) + (y[self.mask],)] = 1
        self.gold = np.zeros((L, L))
        for t in range(1, T):
            ok = self.mask[:, t]
            np.add.at(self.gold, (y[ok, t - 1], y[ok, t]), 1)
        wide = np.pad(self.x, ((0, 0), (PAD, PAD)))
        self.by_type = [_Adder(wide[:, PAD + o : PAD + o + T][self.mask]) for o in OFFSETS]

    def gradients(self, tables: np.ndarray, A: np.ndarray, S: np.ndarray):
        """Of the negative log-likelihood: by label at each position of a sequence, by transition, by first label."""
        n, T = self.x.shape
        e = _emissions(tables.astype(np.float32), self.x)
        e = np.exp(e - e.max(-1, keepdims=True))
        trans = np.exp(A).astype(np.float32)
        a = np.zeros((n, T, L), dtype=np.float32)
        a[:, 0] = e[:, 0] * np.exp(S).astype(np.float32)
        a[:, 0] /= a[:, 0].sum(-1, keepdims=True)
        for t in range(1, T):
            z = (a[:, t - 1] @ trans) * e[:, t]
            a[:, t] = z / z.sum(-1, keepdims=True)
        b = np.zeros((n, T, L), dtype=np.float32)
        moves = np.zeros((L, L))
        for t in range(T - 1, -1, -1):
            b[self.last == t, t] = 1.0
            if t + 1 < T:
                go = self.last > t
                u = e[go, t + 1] * b[go, t + 1]
                z = u @ trans.T
                b[go, t] = z / np.maximum(z.sum(-1, keepdims=True), 1e-30)
                # expected moves: a_i * trans_ij * u_j over its sum, added up as one product
                weight = 1.0 / np.maximum((a[go, t] * z).sum(-1, keepdims=True), 1e-30)
                moves += trans * ((a[go, t] * weight).T @ u)
        p = a * b
        p /= np.maximum(p.sum(-1, keepdims=True), 1e-30)
        g = (p - self.hot) * self.mask[..., None]
        return g[self.mask], moves - self.gold, g[:, 0].sum(0)


@lru_cache(maxsize=1)
def train(rounds: int = 80, l2: float = 1e-4) -> Model:
    """Conditional log-likelihood by Adam over the whole labelled table. Nothing of the data to be tagged enters."""
    data = sorted((d for r in labelled_table() for d in _labelled(r)), key=lambda d: len(d[0]))
    data = [d for d in data if d[0]]
    often = Counter(token_type(t).lower() for toks, _ in data for t in toks)
    known = frozenset(w for w, k in often.items() if k >= KNOWN)
    types = Types()
    seqs = [[types[token_type(t)] for t in toks] for toks, _ in data]
    size = -(-len(data) // 8)
    buckets = [_Bucket(seqs[k : k + size], [labs for _, labs in data[k : k + size]]) for k in range(0, len(data), size)]
    n = len(data)
    cols = _matrix(types.names, known)
    V = len(types.names)
    by_feature = _Adder(cols.ravel())
    used = np.unique(cols)
    W = np.zeros((len(OFFSETS), BUCKETS, L))
    A, S = np.zeros((L, L)), np.zeros(L)
    params, first, second = [W, A, S], [np.zeros_like(p) for p in (W, A, S)], [np.zeros_like(p) for p in (W, A, S)]
    for it in range(1, rounds + 1):
        tables = np.stack([W[k][cols].sum(1) for k in range(len(OFFSETS))])
        gt = np.zeros((len(OFFSETS), V, L))
        ga, gs = np.zeros((L, L)), np.zeros(L)
        for bucket in buckets:
            gm, a, s = bucket.gradients(tables, A, S)
            ga, gs = ga + a, gs + s
            for k in range(len(OFFSETS)):
                bucket.by_type[k](gt[k], gm)
        gw = np.zeros_like(W)
        for k in range(len(OFFSETS)):
            by_feature(gw[k], np.repeat(gt[k], cols.shape[1], axis=0))
        grads = [gw + l2 * n * W, ga + l2 * n * A, gs + l2 * n * S]
        for q, gr, m1, m2 in zip(params, grads, first, second):
            view = (slice(None), used) if q.ndim == 3 else ()
            gq = gr[view] / n
            m1[view] = 0.9 * m1[view] + 0.1 * gq
            m2[view] = 0.99 * m2[view] + 0.01 * gq * gq
            q[view] = q[view] - 0.08 * (m1[view] / (1 - 0.9**it)) / (np.sqrt(m2[view] / (1 - 0.99**it)) + 1e-8)
    # an I only follows its own B or I
    for k in range(len(KINDS)):
        for j in range(L):
            if j not in (1 + 2 * k, 2 + 2 * k):
                A[j, 2 + 2 * k] = -1e4
        S[2 + 2 * k] = -1e4
    return Model(W.astype(np.float32), A.astype(np.float32), S.astype(np.float32), known)


class Tagger:
    """Viterbi in batches. The type tables grow with the types met and are dropped when they are large."""

    MAX_TYPES = 200_000

    def __init__(self, model: Model):
        self.m = model
        self.norm = _Norm()
        self._reset()

    def _reset(self) -> None:
        self.types = Types()
        self.tables = np.zeros((len(OFFSETS), 0, L), dtype=np.float32)

    def _grow(self) -> None:
        have = self.tables.shape[1]
        if have < len(self.types.names):
            cols = _matrix(self.types.names[have:], self.m.known)
            new = np.stack([self.m.weights[k][cols].sum(1) for k in range(len(OFFSETS))])
            self.tables = np.concatenate([self.tables, new], axis=1)

    def _types(self, segments: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Types of all tokens, one segment after another with PAD places outside around each, and where the segments begin."""
        if len(self.types.names) > self.MAX_TYPES:
            self._reset()
        flat: list[int] = [0] * (2 * PAD)
        starts = []
        get, norm, outside = self.types.__getitem__, self.norm.__getitem__, [0] * PAD
        for s in segments:
            starts.append(len(flat))
            flat += map(get, map(norm, s))
            flat += outside
        flat += outside
        self._grow()
        return np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)

    def doubtful(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of the segments whose best path may have a label. For the others the best path is proven to have none.

        A stretch of labels is a B and the I's of its kind after it. What it can gain over no label is at most the sum of its
        tokens' gains with the best transitions into them, and what leaving it gives. The greatest sum over all stretches that
        begin at a token comes from running sums and their maxima from behind."""
        if not len(starts):
            return np.zeros(0, dtype=np.int64)
        m, zero = self.m, self.m.trans[0, 0]
        into = np.maximum(m.trans.max(0) - zero, m.start - m.start[0]).astype(np.float32)
        leave = [max(0.0, float(max(m.trans[1 + 2 * k, 0], m.trans[2 + 2 * k, 0]) - zero)) + 1e-3 for k in range(len(KINDS))]
        ends = starts + lengths
        out = []
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK)))
            a, b = int(starts[i]), int(ends[j - 1]) + PAD
            near = flat[a - PAD : b + PAD]
            e = self.tables[0][near[PAD + OFFSETS[0] :][: b - a]]
            for k, o in enumerate(OFFSETS[1:], 1):
                e += self.tables[k][near[PAD + o :][: b - a]]
            inside = flat[a:b] != 0
            hot = np.zeros(b - a, dtype=bool)
            for k in range(len(KINDS)):
                first = e[:, 1 + 2 * k] - e[:, 0] + into[1 + 2 * k]
                more = np.where(inside, e[:, 2 + 2 * k] - e[:, 0] + into[2 + 2 * k], -1e4).astype(np.float64)
                sums = np.cumsum(more)
                best = np.maximum.accumulate(sums[::-1])[::-1] - sums  # the tokens after this one, as many as are best, or none
                hot |= first + best > -leave[k]
            hot &= inside
            out.append(i + np.flatnonzero(np.add.reduceat(hot, starts[i:j] - a)))
            i = j
        found = np.concatenate(out)
        return found[lengths[found] > 0]

    def tag(self, segments: list[list[str]], every: bool = False) -> dict[int, np.ndarray]:
        """Label numbers of the tokens of each segment that has a label. `every` decodes also those proven to have none."""
        lengths = np.array([len(s) for s in segments], dtype=np.int64)
        flat, starts = self._types(segments)
        asked = np.flatnonzero(lengths) if every else self.doubtful(flat, starts, lengths)
        # shapes that repeat (numbers are zeroes) are decoded once
        uniq: dict[bytes, list[int]] = {}
        for k in asked:
            uniq.setdefault(flat[starts[k] : starts[k] + lengths[k]].tobytes(), []).append(int(k))
        groups = sorted(uniq.values(), key=lambda g: lengths[g[0]])
        out: dict[int, np.ndarray] = {}
        s = 0
        while s < len(groups):
            e = s + 1
            while e < len(groups) and (e - s + 1) * lengths[groups[e][0]] <= PLACES:
                e += 1
            part = groups[s:e]
            s = e
            for g, lab in zip(part, self._viterbi([flat[starts[g[0]] : starts[g[0]] + lengths[g[0]]] for g in part])):
                if lab.any():
                    for k in g:
                        out[k] = lab
        return out

    def _viterbi(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        ends = np.array([len(q) - 1 for q in seqs])
        n, T = len(seqs), int(ends.max()) + 1
        x = np.zeros((n, T), dtype=np.int64)
        for k, q in enumerate(seqs):
            x[k, : len(q)] = q
        e = _emissions(self.tables, x)
        back = np.zeros((n, T, L), dtype=np.int8)
        v = e[:, 0] + self.m.start
        final = v.copy()
        for t in range(1, T):
            z = v[:, :, None] + self.m.trans[None]
            back[:, t] = z.argmax(1)
            v = z.max(1) + e[:, t]
            now = ends == t
            final[now] = v[now]
        lab = np.zeros((n, T), dtype=np.int8)
        cur = final.argmax(1)
        rows = np.arange(n)
        for t in range(T - 1, -1, -1):
            inside = ends >= t
            lab[inside, t] = cur[inside]
            cur = np.where(inside, back[rows, t, cur], cur)
        return [lab[k, : end + 1] for k, end in enumerate(ends)]


_HOST = re.compile(r"(?:\.|%2E|\[dot\]|\(dot\)|\bdot\b)", re.I)


#: Small words inside names.
PARTICLES = frozenset("von van der den de da di du del della dos la le ter zu y".split())


def _valid(kind: str, s: str) -> bool:
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return bool(AT.search(s)) and bool(_HOST.search(re.split(AT, s)[-1])) and not re.search(r"(?:@|%40)\d|\bgit@|\[at\]\(", s)
    if kind == "phone":
        return digits >= 7
    if kind == "id_number":
        return digits >= 6
    if kind == "street_address":
        return digits >= 1 and bool(re.search(r"[^\W\d_]{3}", s)) and s.lower() != s
    # a name has two words, or an initial or title and a word; they are all written alike, small or with capitals, but for particles
    words = [w for w in re.findall(r"[^\W\d_]+", s.replace("%20", " ")) if w not in PARTICLES]
    return len(words) >= 2 and digits == 2 * s.count("%20") and len({w[0].isupper() for w in words}) == 1


def spans(texts: list[str | None], tagger: Tagger, every: bool = False) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) per text. Every segment of every text is read."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    segs: list[list[str]] = []
    where: list[tuple[int, int, int]] = []
    for k, t in enumerate(texts):
        if t:
            for a, b in segments(t):
                segs.append(TOKEN.findall(t, a, b))
                where.append((k, a, b))
    for number, labs in tagger.tag(segs, every).items():
        k, start, end = where[number]
        toks = list(TOKEN.finditer(texts[k], start, end))
        i = 0
        while i < len(labs):
            if labs[i]:
                kind = KINDS[(labs[i] - 1) // 2]
                j = i + 1
                while j < len(labs) and labs[j] == 2 + 2 * KINDS.index(kind):
                    j += 1
                a, b = toks[i].start(), toks[j - 1].end()
                if _valid(kind, texts[k][a:b]):
                    out[k].append((a, b, kind))
                i = j
            else:
                i += 1
    return [sorted(s) for s in out]


def mask(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    out, pos = [], 0
    for a, b, kind in found:
        if a >= pos:
            out += [text[pos:a], f"[{kind.upper()}]"]
            pos = b
    return "".join(out) + text[pos:]


def tag_table(df: DataFrame, id_col: str, text_cols: dict[str, str], masked: bool = True) -> DataFrame:
    """field, row_id, kinds, masked_text: one row per row and field; text_cols: field name -> column."""
    model = df.sparkSession.sparkContext.broadcast(train())  # fixed size: len(OFFSETS) * BUCKETS * L weights
    long = df.select(F.col(id_col).cast("long").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in text_cols.items()])).alias("x")).select("row_id", "x.field", "x.text")

    def run(batches):
        tagger = Tagger(model.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            got = spans(texts, tagger)
            out = pd.DataFrame({"field": pdf["field"], "row_id": pdf["row_id"], "kinds": [sorted({k for _, _, k in s}) for s in got]})
            if masked:
                out["masked_text"] = [mask(t, s) for t, s in zip(texts, got)]
            else:
                out = out[[bool(s) for s in got]]
            yield out

    return spread(long.where(F.col("row_id").isNotNull())).mapInPandas(run, "field string, row_id long, kinds array<string>" + (", masked_text string" if masked else ""))
