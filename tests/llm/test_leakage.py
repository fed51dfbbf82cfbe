import random
import re

from lumenfold.llm import leakage as lk


def w(t):
    return re.findall(r"[^\W_]+", t.lower())


def brute(docs, items, least):
    out = {}
    for d, t, _ in docs:
        if d is None or t is None:
            continue
        a = w(t)
        for i, u in items:
            if i is None or u is None:
                continue
            b = w(u)
            best = 0
            for x in range(len(a)):
                for y in range(len(b)):
                    k = 0
                    while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                        k += 1
                    best = max(best, k)
            if best >= least:
                out[d, i] = max(out.get((d, i), 0), best)
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"t{k}" for k in range(7)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randint(3, 25))) for k in range(8)] + [(90, None), (None, text(9)), (91, ""), (92, "t1")]
    docs = [(k, text(rng.randint(0, 40)), "x") for k in range(40)]
    docs += [(100, "PRE " + items[0][1].upper().replace(" ", ", ") + "!", "x"), (101, None, "x"), (None, items[0][1], "x"), (102, "x " * 3000 + items[1][1], "x"), docs[3]]
    D = spark.createDataFrame(docs, "d long, text string, words string")
    I = spark.createDataFrame(items, "i long, text string")  # noqa: E741
    got = {(r.doc_id, r.item_id): r.words for r in lk.matches(D, I, "d", "text", "i", "text", least=5).collect()}
    assert got == brute(docs, items, 5)
    assert lk.matches(D.limit(0), I, "d", "text", "i", "text").count() == 0
    assert lk.matches(D, I.limit(0), "d", "text", "i", "text").count() == 0


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(lk, "SLICE_WORDS", 3)
    items = [(k, f"a{k} b{k} c{k} d{k} e{k}") for k in range(6)]
    D = spark.createDataFrame([(k, t) for k, t in items], "d long, text string")
    got = {(r.doc_id, r.item_id) for r in lk.matches(D, spark.createDataFrame(items, "i long, text string"), "d", "text", "i", "text", least=5).collect()}
    assert got == {(k, k) for k in range(6)}
