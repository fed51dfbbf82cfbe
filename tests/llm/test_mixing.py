import os

import pytest

from lumenfold.llm import mixing as mx


def test_weights_reach_targets_or_caps():
    nat, tgt, cap = {"a": 900.0, "b": 90.0, "c": 10.0}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.1}, {"a": 1.0, "b": 2.0, "c": 4.0, "d": 4.0}
    w, t, budget = mx.weights(nat, tgt, cap, None)
    assert t == 1.0 and w == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2}) and budget == pytest.approx(200.0)
    w, t, budget = mx.weights(nat, tgt, cap, 800.0)
    assert 0 <= t < 1 and all(w[s] * budget <= cap[s] * nat[s] * 1.000001 for s in w)
    assert mx.weights({}, tgt, cap, None) == ({}, 1.0, 0.0)


def test_mix_shares_and_caps(spark):
    rows = [(k, "a", 10 + k % 7) for k in range(3000)] + [(10_000 + k, "b", 5) for k in range(400)] + [(20_000 + k, "zzz", 5) for k in range(10)]
    counts = spark.createDataFrame(rows, "id long, source string, n long")
    targets = spark.createDataFrame([(" A ", 0.6, 1), ("b", 0.4, 3), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    records, report = mx.mix(counts, targets)
    got = {r.source: r for r in report.collect()}
    assert abs(got["a"].share - 0.6) < 0.01 and abs(got["b"].share - 0.4) < 0.01 and got["none"].mixed_tokens == 0
    assert max(r.copies for r in records.where("source = 'a'").collect()) == 1
    assert {r.copies for r in records.where("source = 'b'").collect()} <= {1, 2, 3} and records.where("source = 'zzz'").count() == 0
    assert sorted(map(tuple, records.collect())) == sorted(map(tuple, mx.mix(counts, targets)[0].collect()))
    empty, report = mx.mix(counts.limit(0), targets)
    assert empty.count() == 0 and report.count() == 3


@pytest.mark.skipif(not os.path.exists(mx.TOKENIZER), reason="no tokenizer files here")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", " A", 1), (2, None, "a", 1), (3, "", "a", 1), (4, "x", None, 1), (5, "a b " * 200_000, "a", 1)], "id long, text string, source string, n int")
    got = {r.id: (r.source, r.n) for r in mx.token_counts(df, "id", "text", "source").collect()}
    assert got[1] == ("a", 2) and set(got) == {1, 5} and got[5][1] >= 400_000


def test_entropy_goal():
    natural, target, cap = {"a": 90.0, "b": 9.0, "c": 1.0}, {"a": 0.98, "b": 0.01, "c": 0.01}, {"a": 9.0, "b": 9.0, "c": 9.0}
    w, t, _ = mx.weights(natural, target, cap, None, 0.2)
    assert 0 < t < 1 and abs(mx.entropy(w) - 0.2) < 1e-6
    assert mx.weights(natural, target, cap)[1] == 1.0
    w, t, budget = mx.weights(natural, target, cap, 1e9)
    assert t < 1 and abs(budget - min(cap[s] * natural[s] / w[s] for s in w)) < 1e-6


def test_pieces_part_where_the_pre_tokenizer_does(monkeypatch):
    if not os.path.exists(mx.TOKENIZER):
        pytest.skip("no vocabulary here")
    with open(mx.TOKENIZER, "rb") as f:
        enc = mx._encoding(f.read())
    monkeypatch.setattr(mx, "PIECE", 10)
    for t in ("one two  three\nfour, five   six seven's eight " * 9, "x" * 300, "", "a b"):
        assert "".join(mx.pieces(t)) == t
        assert sum(map(len, enc.encode_ordinary_batch(mx.pieces(t)))) == len(enc.encode_ordinary(t))
