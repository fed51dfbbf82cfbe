from lumenfold.llm import rank_fusion as rf

COLS = ["r1", "r2", "r3", "r4"]
SCHEMA = "q long, f long, r1 int, r2 int, r3 int, r4 int, score string"


def brute(rows):
    best = {}
    for q, f, *r in rows:
        if q is None or f is None:
            continue
        r = r[:4]
        old = best.get((q, f), [None] * 4)
        best[q, f] = [b if a is None else a if b is None else min(a, b) for a, b in zip(old, r)]
    out = {}
    for (q, f), r in best.items():
        pos = [None if x is None else 1 + sum(1 for (q2, _), r2 in best.items() if q2 == q and r2[k] is not None and r2[k] < x) for k, x in enumerate(r)]
        out[q, f] = (tuple(pos), round(sum(1 / (60 + p) for p in pos if p), 12))
    return out


def test_positions_ties_nulls_redeliveries(spark):
    rows = [(1, 1, 5, None, 900_000, 2, "x"), (1, 2, 5, 7, 3, None, "x"), (1, 3, 9, 1, 70_000, 1, "x"), (1, 3, 9, 1, 70_000, 1, "x"), (1, 4, None, None, None, None, "x"), (2, 1, 1, 1, 1, 1, None), (None, 1, 1, 1, 1, 1, None), (2, None, 1, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)  # `score` clashes with a result column
    fused = rf.fuse(df, "q", "f", COLS)
    got = {(r.q, r.f): (tuple(r[f"pos_{c}"] for c in COLS), round(r.score, 12)) for r in fused.collect()}
    assert got == brute(rows)
    placed = {(r.q, r.f): r.place for r in rf.ordered(fused, "q", "f").collect()}
    want = brute(rows)
    for q in (1, 2):
        order = sorted((k for k in want if k[0] == q), key=lambda k: (-want[k][1], k[1]))
        assert [placed[k] for k in order] == list(range(1, len(order) + 1))


def test_scale_does_not_matter(spark):
    a = [(1, f, f, None, 10 * f, None, None) for f in range(1, 9)]
    b = [(1, f, 1000 * f + 3, None, f, None, None) for f in range(1, 9)]
    got = [sorted((r.f, r.score) for r in rf.fuse(spark.createDataFrame(x, SCHEMA), "q", "f", COLS).collect()) for x in (a, b)]
    assert got[0] == got[1]


def test_empty(spark):
    assert rf.ordered(rf.fuse(spark.createDataFrame([], SCHEMA), "q", "f", COLS), "q", "f").count() == 0
