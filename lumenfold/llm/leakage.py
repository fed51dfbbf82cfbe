"""Evaluation texts leaking into training text: suffix arrays over shards of the training words.

Documents are read as words (maximal runs of letters or digits, lower-cased), so case, punctuation and spacing don't
matter. Each shard (a batch of documents) gets a suffix array of the places from which at least `least` words follow that
the test items know at all, in the order of their first `least` words (more isn't needed to find every match); the order is
made by prefix doubling. Every suffix of every test item is binary-searched in it;
the equal range holds all places that share the first `least` words, and each match is extended word by word to its full
length. Nothing is sampled; a shard needs no other shard, so the corpus isn't shuffled.

The test items are held by every task, in slices of at most SLICE_WORDS words; each slice is one pass over the corpus.

Defined results: null texts and ids have no match; items shorter than `least` words leak nothing; several places of one
item in one document give one row with the longest match; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.words import WORD

SLICE_WORDS = 2_000_000
#: Words of a shard; longer batches are cut into several shards at document ends.
SHARD_WORDS = 4_000_000


def _ranks(flat: np.ndarray, length: int) -> np.ndarray:
    """Order-preserving numbers of the runs of `length` words that start at each place; 0 words end a run early."""
    n = len(flat)
    have, width = flat.astype(np.int64), 1
    done: np.ndarray | None = None
    covered = 0
    left = length
    while left:
        if left & width:
            if done is None:
                done, covered = have, width
            else:
                nxt = np.zeros(n, dtype=np.int64)
                nxt[: n - covered] = have[covered:]
                done = np.unique(done * (int(have.max(initial=0)) + 1) + nxt, return_inverse=True)[1].astype(np.int64)
                covered += width
            left &= ~width
        if left:
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: n - width] = have[width:]
            have = np.unique(have * (int(have.max(initial=0)) + 1) + nxt, return_inverse=True)[1].astype(np.int64)
            width *= 2
    return done if done is not None else have


class TestSide:
    """Words and suffixes of the test items, ready for search."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.vocab: dict[str, int] = {}
        flat, item, place = [], [], []
        for k, text in items:
            w = WORD.findall(text.lower())
            if len(w) < least:
                continue
            ids = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w]
            flat += [*ids, 0]
            item += [k] * (len(ids) + 1)
            place += [*range(len(ids)), len(ids)]
        self.flat = np.array(flat, dtype=np.int64)
        self.item = np.array(item, dtype=np.int64)
        self.place = np.array(place, dtype=np.int64)


def _full(flat: np.ndarray, least: int) -> np.ndarray:
    """Places from which `least` known words follow."""
    known = np.concatenate([[0], np.cumsum(flat != 0)])
    n = len(flat) - least + 1
    return np.flatnonzero(known[least : least + n] - known[:n] == least) if n > 0 else np.zeros(0, dtype=np.int64)


def search(shard: np.ndarray, owner: np.ndarray, test: TestSide) -> np.ndarray:
    """Rows (owner, item, length, place in the shard, place in the item) of all maximal matches of at least `least` words."""
    m = test.least
    sa = _full(shard, m)
    if not len(sa):
        return np.zeros((0, 5), dtype=np.int64)
    both = np.concatenate([shard, [0], test.flat])
    rank = _ranks(both, m)
    base = len(shard) + 1
    sa = sa[np.argsort(rank[sa], kind="stable")]
    order = rank[sa]
    q = _full(test.flat, m)
    lo, hi = np.searchsorted(order, rank[base + q], "left"), np.searchsorted(order, rank[base + q], "right")
    out = []
    many = np.cumsum(hi - lo)
    k = 0
    while k < len(q):
        e = max(k + 1, int(np.searchsorted(many, (many[k - 1] if k else 0) + 2_000_000)))
        c = (hi - lo)[k:e]
        t = np.repeat(q[k:e], c)
        d = sa[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[k:e], c)]
        k = e
        # a match that goes on to the left is part of a longer one
        before = (d > 0) & (t > 0)
        same = np.zeros(len(d), dtype=bool)
        same[before] = (shard[d[before] - 1] == test.flat[t[before] - 1]) & (shard[d[before] - 1] != 0)
        d, t = d[~same], t[~same]
        size = np.full(len(d), m)
        going = np.arange(len(d))
        while len(going):
            a, b = d[going] + size[going], t[going] + size[going]
            ok = (a < len(shard)) & (b < len(test.flat))
            ok[ok] = (shard[a[ok]] == test.flat[b[ok]]) & (shard[a[ok]] != 0)
            going = going[ok]
            size[going] += 1
        out.append(np.stack([owner[d], test.item[t], size, d, test.place[t]], 1))
    return np.concatenate(out) if out else np.zeros((0, 5), dtype=np.int64)


MATCH = "doc_id long, item_id long, words int, doc_word int, item_word int"


def matches(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, least: int = 12) -> DataFrame:
    """doc_id, item_id, words (length), doc_word and item_word (where it starts): the longest verbatim match of each pair."""
    spark = docs.sparkSession
    slices: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().toLocalIterator():
        if size > SLICE_WORDS:
            slices.append([])
            size = 0
        slices[-1].append((r.i, r.t))
        size += len(r.t) // 4
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = None
    for part in slices:
        test = spark.sparkContext.broadcast(TestSide(part, least))
        one = rows.mapInPandas(_task(test), MATCH)
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("m.words").alias("words"), (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def _task(test):
    def run(batches):
        t = test.value
        get = t.vocab.get

        def shard(flat, owner, starts):
            f = np.array(flat, dtype=np.int64)
            m = search(f, np.array(owner, dtype=np.int64), t) if len(f) else np.zeros((0, 5), dtype=np.int64)
            first = np.array(starts, dtype=np.int64)
            at = m[:, 3] - first[np.searchsorted(first, m[:, 3], "right") - 1] if len(m) else m[:, 3]
            return pd.DataFrame({"doc_id": m[:, 0], "item_id": m[:, 1], "words": m[:, 2], "doc_word": at, "item_word": m[:, 4]})

        for pdf in batches:
            flat, owner, starts = [], [], []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                ids = [get(w, 0) for w in WORD.findall(text.lower())]
                starts.append(len(flat))
                flat += [*ids, 0]
                owner += [d] * (len(ids) + 1)
                if len(flat) > SHARD_WORDS:
                    yield shard(flat, owner, starts)
                    flat, owner, starts = [], [], []
            if flat:
                yield shard(flat, owner, starts)

    return run


def cleaned(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """The corpus without the affected documents."""
    return docs.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
