"""Garbled text from wrong character encoding: chains of encoding and decoding scored by character n-gram models.

Smoothed character n-gram models (3-, 2- and 1-grams in tables of fixed size) are trained on all clean records, that is
those without lost or control characters and without a passage in which half of the letters above 127 read as UTF-8 seen in
another encoding; a second round leaves out what the first round's models doubt. A text counts once, under however many ids it stands; every
record is judged. A chain
undoes one reading: characters are put back to bytes of the encoding they were read in and decoded in the one they were
written in; two chains may follow each other. A passage (sentence or line) is garbled if its likeliest chain beats the
text as it stands by more than the margin. The margin is validated: it's set where the fewest passages are judged wrongly, by the gains of all clean passages of all
records and of the same passages garbled on purpose, each by one chain that can write it whole. Characters that were lost
(U+FFFD) can't be restored; they make a passage garbled by themselves.

Words are scored with the blanks around them, those new in a batch together, and kept per task, as words recur. The corpus is
read once to train and once to judge; between them only the passages with characters above 127 are read.

Defined results: null text is not garbled and stays null; empty text stays; texts of any length are used whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import scratch, spread

TRI, BI, UNI = 1 << 20, 1 << 18, 1 << 16
#: Bins of gains: so many to a unit, from -SPAN to SPAN.
FINE, SPAN = 16, 256
#: Garbled passages expected to a clean one.
GARBLED = 0.01
#: Gain beyond which a passage isn't counted in the second round of training.
DOUBT = 4.0
READ_AS = ("cp1252", "cp1250", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "iso8859_2")
#: (written in, read as) of single-byte pairs; UTF-8 may have been read as each of READ_AS.
PAIRS = [
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1250", "iso8859_2"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp850", "cp437"),
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "koi8_r"), ("koi8_r", "cp866"), ("cp1251", "mac_roman"), ("cp1251", "cp437"), ("cp1250", "mac_roman"), ("iso8859_2", "cp1250"),
]
#: Characters scored at once.
AT_ONCE = 1 << 20
LOST = "�"
NON_ASCII = re.compile(r"[^\x00-\x7f]")
CONTROL = re.compile(r"[\x80-\x9f]")
WORD = re.compile(r"\S*[^\x00-\x7f]\S*")
PASSAGE = re.compile(r"[^\n.!?]*[\n.!?]*[\"”’»)\]]*")


@lru_cache(maxsize=None)
def _to_byte(encoding: str) -> dict[str, int]:
    """Character to byte, above 127; bytes the encoding leaves open stand for the control character of that number."""
    out = {chr(b): b for b in range(128, 160)}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=None)
def _to_char(encoding: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@lru_cache(maxsize=None)
def _utf8_shapes(read_as: str) -> re.Pattern:
    """Stretches whose bytes in the encoding they were read in have the shape of one UTF-8 sign."""
    of: dict[int, str] = {}
    for c, x in _to_byte(read_as).items():
        of.setdefault(x, "")
        of[x] += re.escape(c)
    group = lambda lo, hi: "[" + "".join(of.get(x, "") for x in range(lo, hi + 1)) + "]"
    more = group(0x80, 0xBF)
    return re.compile(f"{group(0xC2, 0xDF)}{more}|{group(0xE0, 0xEF)}{more}{{2}}|{group(0xF0, 0xF4)}{more}{{3}}")


def _sign(m: re.Match, table: dict[str, int]) -> str:
    try:
        return bytes(table[c] for c in m.group(0)).decode("utf-8")
    except UnicodeDecodeError:
        return m.group(0)


@lru_cache(maxsize=None)
def _table(written: str, read_as: str) -> dict[int, str]:
    """Sign read to sign written, of a pair of single-byte encodings."""
    fwd = _to_char(written)
    return {ord(c): fwd[x] for c, x in _to_byte(read_as).items() if c >= "\x80"}


def undo(text: str, written: str, read_as: str) -> str:
    if written == "utf-8":
        table = _to_byte(read_as)
        return _utf8_shapes(read_as).sub(lambda m: _sign(m, table), text)
    return text.translate(_table(written, read_as))


CHAINS: list[tuple[tuple[str, str], ...]] = [(("utf-8", r),) for r in READ_AS] + [(p,) for p in PAIRS] + [(("utf-8", a), ("utf-8", b)) for a in ("cp1252", "cp1250", "mac_roman", "cp437", "cp850", "cp1251") for b in ("cp1252", "cp1250", "cp1251") if a == b or b == "cp1252"]

#: The first so many chains are of one reading.
SINGLE = len(READ_AS) + len(PAIRS)


def apply(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    for written, read_as in chain:
        text = undo(text, written, read_as)
    return text


class CharModel:
    """Counts of 3-, 2- and 1-grams in tables of fixed size."""

    def __init__(self, tri: np.ndarray, bi: np.ndarray, uni: np.ndarray):
        self.tri, self.bi, self.uni, self.bi_from = tri, bi, uni, uni
        self.total = float(uni.sum(dtype=np.float64))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of the characters of each text, each after the two before it."""
        out = np.zeros(len(texts))
        k = 0
        while k < len(texts):
            e, size = k, 0
            while e < len(texts) and (e == k or size < AT_ONCE):
                size += len(texts[e]) + 2
                e += 1
            out[k:e] = self._scores(texts[k:e])
            k = e
        return out

    def _scores(self, texts: list[str]) -> np.ndarray:
        c = np.frombuffer(("  " + "  ".join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        t, b, u = _slots(c)
        p1 = (self.uni[u[2:]] + 0.05) / (self.total + 0.05 * UNI)
        p2 = (self.bi[b[1:]] + 2.0 * p1) / (self.bi_from[u[1:-1]] + 2.0)
        logs = np.log((self.tri[t] + 2.0 * p2) / (self.bi[b[:-1]] + 2.0))
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        at = np.cumsum(size + 2) - size - 2
        # the two blanks between texts aren't counted
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        return sums[at + size] - sums[at]

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def _slots(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table places of the 3-grams, 2-grams and characters."""
    mixed = c * 0x9E3779B1 & 0xFFFFFFFF
    b = (mixed[:-1] * 31 + c[1:] * 0x85EBCA6B) & 0x7FFFFFFFFFFF
    t = (b[:-1] * 131 + c[2:] * 0xC2B2AE35) & 0x7FFFFFFFFFFF
    return (t ^ (t >> 17)) % TRI, (b ^ (b >> 15)) % BI, c % UNI


def looks_clean(text: str) -> bool:
    if text.isascii():
        return True
    if LOST in text or CONTROL.search(text):
        return False
    suspects = [r for r in READ_AS if _utf8_shapes(r).search(text)]
    if suspects:
        for p in PASSAGE.findall(text):
            if p.isascii():
                continue
            # signs that were one character; chance pairs (as in Cyrillic words) are fewer than half
            high = len(NON_ASCII.findall(p))
            if any(4 * sum(len(x) - 1 for x in _utf8_shapes(r).findall(p)) >= high for r in suspects):
                return False
    return True


class Counter3:
    """Counts of the 3-, 2- and 1-grams of texts."""

    def __init__(self):
        self.tables = {"t": np.zeros(TRI, np.int64), "b": np.zeros(BI, np.int64), "u": np.zeros(UNI, np.int64)}

    def add(self, texts: list[str], sign: int = 1) -> None:
        for k in range(0, len(texts), 2000):
            c = np.frombuffer(("  " + re.sub(r"\s+", " ", "  ".join(texts[k : k + 2000]))).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            for table, slots in zip(self.tables.values(), _slots(c)):
                table += sign * np.bincount(slots, minlength=len(table))

    def rows(self) -> Iterator[pd.DataFrame]:
        for name, a in self.tables.items():
            at = np.flatnonzero(a)
            if len(at):
                yield pd.DataFrame({"k": name, "slot": at, "n": a[at], "passages": None})


COUNTS = "k string, slot long, n long, passages array<string>"


def _survey(batches):
    """Counts of the clean texts, and of each clean text its passages with characters above 127 (k = p)."""
    counts = Counter3()
    for pdf in batches:
        texts = [t for t in pdf["text"] if t and looks_clean(t)]
        counts.add(texts)
        kept = [x for t in texts if not t.isascii() and (x := [p for p in PASSAGE.findall(t) if not p.isascii()])]
        yield pd.DataFrame({"k": "p", "slot": None, "n": None, "passages": kept})
    yield from counts.rows()


def _doubted(first):
    """Counts of the passages that some chain makes likelier by more than DOUBT."""

    def run(batches):
        judge, counts = Judge(first.value), Counter3()
        for pdf in batches:
            passages = [p for ps in pdf["passages"] for p in ps]
            _, gain = judge.best(passages)
            counts.add([passages[k] for k in np.flatnonzero(gain > DOUBT)])
        yield from counts.rows()

    return run


def _tables(rows: DataFrame) -> dict[str, np.ndarray]:
    pdf = rows.groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most TRI + BI + UNI rows
    out = {}
    for name, size in (("t", TRI), ("b", BI), ("u", UNI)):
        out[name] = np.zeros(size, dtype=np.float32)
        part = pdf[pdf["k"] == name]
        out[name][part["slot"].to_numpy(dtype=np.int64)] = part["n"].to_numpy(dtype=np.int64)
    return out


class Judge:
    """Gains of chains by words. A word's gains by all chains are a row of a table, kept while the task runs, as words recur;
    words that are new in a batch are scored together."""

    MOST = 200_000

    def __init__(self, model: CharModel, margin: float = 0.0):
        self.model, self.margin = model, margin
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.gains = np.zeros((0, len(CHAINS)), dtype=np.float32)

    def _score(self, words: list[str]) -> np.ndarray:
        """A row per word: what each chain gains; 0 where it changes nothing."""
        out = np.zeros((len(words), len(CHAINS)), dtype=np.float32)
        new: dict[str, int] = {}
        put: list[tuple[int, int, int]] = []
        changed = set()
        for i, w in enumerate(words):
            for k, chain in enumerate(CHAINS):
                v = apply(w, chain)
                if v != w:
                    put.append((i, k, new.setdefault(v, len(new))))
                    changed.add(i)
        if put:
            i, k, v = np.array(put).T
            base = np.zeros(len(words))
            asked = sorted(changed)
            base[asked] = self.model.scores([f" {words[x]} " for x in asked])
            out[i, k] = self.model.scores([f" {x} " for x in new])[v] - base[i]
        return out

    def best(self, passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chain of greatest gain over each passage's words with characters above 127 (-1: none changes it), and the gain."""
        if len(self.at) > self.MOST:
            self._reset()
        words = [WORD.findall(p) for p in passages]
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        fresh = list(dict.fromkeys(w for ws in words for w in ws if w not in self.at))
        if fresh:
            self.at.update({w: len(self.at) + k for k, w in enumerate(fresh)})
            self.gains = np.concatenate([self.gains, self._score(fresh)])
        chain, gain = np.full(len(words), -1, dtype=np.int64), np.zeros(len(words))
        some = np.flatnonzero(size)
        step = 20_000
        for a in range(0, len(some), step):
            part = some[a : a + step]
            rows = np.fromiter((self.at[w] for k in part for w in words[k]), dtype=np.int64)
            starts = np.cumsum(size[part]) - size[part]
            total = np.add.reduceat(self.gains[rows].astype(np.float64), starts, axis=0)
            touched = np.add.reduceat(self.gains[rows] != 0, starts, axis=0)
            total[touched == 0] = -np.inf
            k = total.argmax(1)
            g = total[np.arange(len(part)), k]
            ok = np.isfinite(g)
            chain[part[ok]], gain[part[ok]] = k[ok], g[ok]
        return chain, gain

    def restore(self, texts: list[str | None]) -> list[tuple[str | None, bool]]:
        """Each text with its garbled passages restored, and whether one was met."""
        parts: list[tuple[int, int, int]] = []
        passages: list[str] = []
        for k, t in enumerate(texts):
            if t and not t.isascii():
                for m in PASSAGE.finditer(t):
                    p = m.group(0)
                    if not p.isascii():
                        parts.append((k, m.start(), m.end()))
                        passages.append(p)
        chain, gain = self.best(passages)
        out: list[tuple[str | None, bool]] = [(t, False) for t in texts]
        put: dict[int, list[tuple[int, int, str]]] = {}
        for (k, a, b), p, c, g in zip(parts, passages, chain, gain):
            if c >= 0 and g > self.margin:
                put.setdefault(k, []).append((a, b, apply(p, CHAINS[c])))
            elif LOST in p:
                put.setdefault(k, [])
        for k, changes in put.items():
            t, new, pos = texts[k], [], 0
            for a, b, p in changes:
                new += [t[pos:a], p]
                pos = b
            out[k] = ("".join(new) + t[pos:], True)
        return out


def garble(passage: str) -> tuple[int, str] | None:
    """A chain of one reading and the passage as it garbles it: of those that can write all its characters and change it, one
    that depends on the passage alone; None if there is none."""
    first = zlib.crc32(passage.encode("utf-8", "surrogatepass"))
    for k in range(first, first + 5 * SINGLE, 5):  # 5 and SINGLE have no common divisor
        written, read_as = CHAINS[k % SINGLE][0]
        try:
            raw = passage.encode(written)
        except UnicodeEncodeError:
            continue
        chars = _to_char(read_as)
        seen = raw.decode("latin-1").translate(chars)
        if seen != passage:
            return k % SINGLE, seen
    return None


def _gains(models):
    """Counts of gains, by bins, of the clean passages (by their best chain) and of the same passages garbled (by the chain that
    undoes it; the best one gains no less). Passages that the first model doubts are no clean ones."""

    def run(batches):
        model, first = models.value
        judge, doubt = Judge(model), Judge(first)
        counts = {"clean": np.zeros(2 * SPAN * FINE, np.int64), "bad": np.zeros(2 * SPAN * FINE, np.int64)}

        def add(k: str, gain: np.ndarray) -> None:
            counts[k] += np.bincount(np.clip(((gain + SPAN) * FINE).astype(np.int64), 0, 2 * SPAN * FINE - 1), minlength=2 * SPAN * FINE)

        for pdf in batches:
            passages = [p for ps in pdf["passages"] for p in ps]
            passages = [passages[k] for k in np.flatnonzero(doubt.best(passages)[1] <= DOUBT)]
            add("clean", judge.best(passages)[1])
            pairs: dict[tuple[int, str], int] = {}
            rows, sizes = [], []
            for got in filter(None, map(garble, passages)):
                ws = WORD.findall(got[1])
                rows += [pairs.setdefault((got[0], w), len(pairs)) for w in ws]
                sizes.append(len(ws))
            if rows:
                before = model.scores([f" {w} " for _, w in pairs])
                after = model.scores([f" {apply(w, CHAINS[k])} " for k, w in pairs])
                total = np.concatenate([[0.0], np.cumsum((after - before)[rows])])
                ends = np.cumsum(sizes)
                add("bad", total[ends] - total[ends - np.array(sizes)])
        for k, a in counts.items():
            at = np.flatnonzero(a)
            if len(at):
                yield pd.DataFrame({"k": k, "bin": at, "n": a[at]})

    return run


def gain_counts(passages: DataFrame, models) -> dict[str, np.ndarray]:
    """Over all passages of all clean records: how many gains lie in each bin, for the passages as they stand (clean) and
    garbled (bad). models: the broadcast second and first model."""
    got = passages.mapInPandas(_gains(models), "k string, bin long, n long").groupBy("k", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most two rows a bin
    out = {}
    for k in ("clean", "bad"):
        part = got[got["k"] == k]
        out[k] = np.zeros(2 * SPAN * FINE, np.int64)
        out[k][part["bin"].to_numpy(dtype=np.int64)] = part["n"].to_numpy(dtype=np.int64)
    return out


def validated_margin(counts: dict[str, np.ndarray]) -> float:
    """The gain at which the fewest passages are judged wrongly: clean ones above it, and garbled ones below it weighted by
    GARBLED, how many are expected to a clean one. Of a range of equals DOUBT above its low end, or the middle of a narrower one;
    without samples DOUBT."""
    clean, bad = counts["clean"], counts["bad"]
    if not clean.any():
        return DOUBT
    above = clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    below = np.concatenate([[0], np.cumsum(bad)])
    wrong = above + GARBLED * below
    wrong[: SPAN * FINE] = np.inf  # a gain below 0 is none
    best = np.flatnonzero(wrong == wrong.min())
    low, high = best[0] / FINE - SPAN, best[-1] / FINE - SPAN
    return float(min(low + DOUBT, (low + high) / 2)) if bad.any() else float(low) + DOUBT


def survey(texts: DataFrame) -> DataFrame:
    """Rows of _survey over the distinct texts (column text), written to the shared folder."""
    spark = texts.sparkSession
    path = scratch(spark, "mojibake-survey")
    texts.where("text != ''").select("text").distinct().mapInPandas(_survey, COUNTS).write.parquet(path)
    return spark.read.schema(COUNTS).parquet(path)


def trained(surveyed: DataFrame) -> tuple[CharModel, CharModel]:
    """The model, and the first round's. The second round leaves out the passages that the first one's model doubts, so garbled
    text that passed as clean doesn't speak for itself."""
    sc = surveyed.sparkSession.sparkContext
    t1 = _tables(surveyed.where("k <> 'p'").select("k", "slot", "n"))
    first = CharModel(t1["t"], t1["b"], t1["u"])
    doubted = spread(surveyed.where("k = 'p'").select("passages")).mapInPandas(_doubted(sc.broadcast(first)), COUNTS)  # tables of fixed size
    t2 = _tables(doubted.select("k", "slot", "n"))
    return CharModel(*(np.maximum(t1[k] - t2[k], 0) for k in ("t", "b", "u"))), first


def judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, restored (the text, restored where possible), garbled."""
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    sc = docs.sparkSession.sparkContext
    surveyed = survey(rows)
    model, first = trained(surveyed)
    margin = validated_margin(gain_counts(spread(surveyed.where("k = 'p'").select("passages")), sc.broadcast((model, first))))
    shared = sc.broadcast((model, margin))

    def run(batches):
        judge = Judge(*shared.value)
        for pdf in batches:
            got = judge.restore(pdf["text"].tolist())
            yield pd.DataFrame({"id": pdf["id"], "restored": [g[0] for g in got], "garbled": [g[1] for g in got]})

    return rows.mapInPandas(run, "id long, restored string, garbled boolean")
