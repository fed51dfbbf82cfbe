import datetime as dt

from lumenfold.operators import incremental as inc

SCHEMA = "id long, seen_at timestamp, loaded_at timestamp, content_hash string, size long, mtime timestamp, status string, last_indexed_at timestamp"
RUNS = "run_id long, started_at timestamp, finished_at timestamp, outcome string"


def t(h):
    return dt.datetime(2026, 8, 1) + dt.timedelta(hours=h)


def run(spark, rows, runs):
    got = inc.pending(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(runs, RUNS)).collect()
    return {(r.file_id, r.action) for r in got}


RUN = [(1, t(10), t(12), "success"), (2, t(20), t(22), "failed")]


def test_actions(spark):
    rows = [
        (1, t(1), t(1), "a", 1, t(0), "active", t(11)),  # committed, then changed
        (1, t(15), t(15), "b", 1, t(0), "active", None),
        (2, t(1), t(1), "a", 1, t(0), "active", t(21)),  # only a failed run: add
        (3, t(1), t(1), "a", 1, t(0), "active", t(10)),  # both ends inclusive, same hash: no case
        (3, t(15), t(15), "a", 2, t(9), "active", None),
        (4, t(1), t(1), None, 1, t(0), "active", t(12)),  # null hash, size differs
        (4, t(15), t(15), None, 2, t(0), "active", None),
        (5, t(1), t(1), "a", 1, t(0), "active", t(11)),
        (5, t(15), t(15), "a", 1, t(0), "deleted", None),
        (6, t(1), t(1), "a", 1, t(0), "error", t(11)),  # error isn't committed
        (7, t(1), t(1), "a", 1, t(0), "deleted", None),
        (8, t(1), t(1), "a", 1, t(0), "deleted", t(11)),  # deleted base is none
        (8, t(15), t(15), "a", 1, t(0), "active", None),
        (None, t(1), t(1), "a", 1, t(0), "active", t(11)),
    ]
    rows += rows[:3]  # redeliveries
    assert run(spark, rows, RUN) == {(1, "change"), (2, "add"), (4, "change"), (5, "delete"), (6, "add"), (8, "add")}


def test_empty(spark):
    assert run(spark, [], RUN) == set()
    assert run(spark, [(1, None, None, None, None, None, None, None)], []) == {(1, "add")}


STATE = "_key long, content_hash string, size long, mtime timestamp, status string"


def state_and_rows(spark, tmp_path):
    state = inc.VersionedState(spark, str(tmp_path / "state"))
    mk = lambda rows: inc.fingerprints(spark.createDataFrame(rows, STATE))
    acts = lambda df: {(r._key, r.action) for r in state.pending(df).collect()}
    return state, mk, acts


def test_versioned_state(spark, tmp_path):
    state, mk, acts = state_and_rows(spark, tmp_path)
    one = mk([(1, "a", 1, t(0), "active"), (2, "b", 1, t(0), "active")])
    assert acts(one) == {(1, "add"), (2, "add")}
    assert acts(one) == {(1, "add"), (2, "add")}  # a run that failed before the swap repeats nothing and skips nothing
    assert state.swap(one) == 1
    assert acts(one) == set()
    two = mk([(1, "z", 1, t(0), "active"), (2, "b", 1, t(0), "deleted"), (3, "c", 1, t(0), "active")])
    two.write.parquet(str(tmp_path / "state" / "v2-left"))  # leftover of a run that died while writing
    assert state.version() == 1
    assert acts(two) == {(1, "change"), (2, "delete"), (3, "add")}
    assert state.swap(two) == 2
    assert acts(two) == set()
    three = mk([(4, None, 1, t(0), "active"), (5, None, None, None, None)])
    assert state.swap(three) == 3 and acts(three) == set()
    assert acts(mk([(4, None, 2, t(0), "active"), (5, "h", None, None, None)])) == {(4, "change")}


def test_crash_between_writing_and_pointing(spark, tmp_path, monkeypatch):
    state, mk, acts = state_and_rows(spark, tmp_path)
    one = mk([(1, "a", 1, t(0), "active")])
    state.swap(one)
    two = mk([(1, "b", 1, t(0), "active")])
    with monkeypatch.context() as m:
        m.setattr(inc.VersionedState, "point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            state.swap(two)
        except OSError:
            pass
    assert state.version() == 1 and acts(one) == set() and acts(two) == {(1, "change")}
    assert state.swap(two) == 2 and acts(two) == set()


def test_two_runs_at_once(spark, tmp_path):
    """Both started from version 1; the second to finish gets an error and the winner's rows stand."""
    import pytest

    state, mk, acts = state_and_rows(spark, tmp_path)
    state.swap(mk([(1, "a", 1, t(0), "active")]))
    winner, loser = mk([(1, "b", 1, t(0), "active")]), mk([(1, "c", 1, t(0), "active")])
    state.swap(winner, after=1)
    with pytest.raises(RuntimeError):
        state.swap(loser, after=1)
    assert state.version() == 2 and acts(winner) == set()


def test_query_goes_through_the_state(spark, tmp_path):
    rows = [(1, t(1), t(1), "a", 1, t(0), "active", t(11)), (1, t(15), t(15), "b", 1, t(0), "active", None)]
    root = str(tmp_path / "index")
    got = inc.pending(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(RUN, RUNS), root).collect()
    assert [(r.file_id, r.action) for r in got] == [(1, "change")]
    assert inc.VersionedState(spark, root).version() == 1
