import random
import re

from lumenfold.llm import near_duplicates as nd


def grams(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 20 else None


def brute(rows):
    s = {i: grams(t) for i, t in rows if i is not None and t is not None and grams(t)}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(s[a] & s[b]) >= 3 * len(s[a] | s[b])}


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    rows, k = [], 0
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(15, 80))]
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                p = rng.randrange(len(t))
                what = rng.random()
                t[p : p + 1] = [rng.choice(vocab)] if what < 0.5 else [] if what < 0.75 else [t[p], rng.choice(vocab)]
            rows.append((k, " ".join(t) + "."))
            k += 1
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, key string")  # `key` clashes
    pairs, members = nd.class_pairs(df, "id", "text")
    return pairs, members, {(r.a, r.b) for r in nd.record_pairs(pairs, members).collect()}


def test_all_pairs_against_brute_force(spark):
    rows = corpus()
    rows += rows[:5]  # redeliveries
    rows += [(1000, rows[0][1].upper()), (1001, None), (None, rows[0][1]), (1002, ""), (1003, "short text"), (1004, "long " * 5000 + "tail")]
    pairs, members, got = found(spark, rows)
    assert got == brute(rows)
    groups = {r.id: r.group_id for r in nd.groups(pairs, members).collect()}
    parent = {i: i for i in groups}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[root(a)] = root(b)
    assert all((groups[a] == groups[b]) == (root(a) == root(b)) for a in groups for b in groups)


def test_hot_columns_are_salted(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 3)
    rows = corpus(seed=9, n=12) + [(5000 + k, "the same notice stands in each of these many texts and differs by one word only at its end here " + f"x{k}") for k in range(12)]
    assert found(spark, rows)[2] == brute(rows)


def test_empty(spark):
    assert found(spark, [])[2] == set()


def test_shares_are_added_in_levels(spark):
    import zlib

    import numpy as np

    rows = [(part, task, zlib.compress(np.full(4, task + part, dtype=np.int64).tobytes())) for part in range(2) for task in range(nd.FAN * 2 + 3)]
    df = spark.createDataFrame(rows, "part int, task int, payload binary")
    got = nd._in_levels(df, lambda x: sum(np.frombuffer(y, dtype=np.int64) for y in x).tobytes())
    assert {k: np.frombuffer(v, dtype=np.int64).tolist() for k, v in got.items()} == {p: [sum(t + p for t in range(nd.FAN * 2 + 3))] * 4 for p in range(2)}


def test_levels_have_no_ceiling():
    import numpy as np

    counts = np.array([0, 1, 7, 10**6, 10**12])
    level, fine = nd._levels(counts)
    assert level.max() == 255 and np.all(np.diff(level.astype(int)) > 0)
    assert nd._salts(fine)[level[-1]] > 0.8 * 10**12 / nd.HOT


def test_passes_over_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "PASS_GRAMS", 500)
    rows = corpus(seed=5)
    assert found(spark, rows)[2] == brute(rows)


def test_far_pairs_of_a_block_are_not_written():
    """Two texts that share their rarest column alone, and two near ones: only the near pair leaves the block."""
    import zlib
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    run = "one rare run"
    far = [run + " " + " ".join(f"{x}{k}" for k in range(40)) for x in "ab"]
    near = [run + " " + " ".join(f"c{k}" for k in range(40)) + end for end in ("", " more")]
    level = np.full(nd.SKETCH, 255, dtype=np.uint8)
    g, _, _ = nd._grams([run], nd.WordHash(), 3, 3)
    level[nd._slot(g & nd._MASK)] = 0
    texts = pd.DataFrame({"id": range(4), "text": far + near})
    kept = list(nd._rows(3, 20, 3, 5, SimpleNamespace(value=zlib.compress(level.tobytes())))(iter([texts])))
    dealt = [x for turn in range(3) for x in nd._deal(3, 5, 255.0, 3, 3, turn)(iter(kept))]
    pairs = pd.concat([nd._product(3, 5)(x) for x in dealt]).drop_duplicates()
    _, key, _ = nd._grams(near, nd.WordHash(), 3, 20)
    assert pairs.to_numpy().tolist() == [sorted(key.tolist())]
