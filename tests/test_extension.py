from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import audio
from lumenfold.operators import extension as ext
from lumenfold.operators import symbols

T0 = datetime(2026, 1, 1)


def test_python_symbols():
    t = "import x\n\nclass A:\n    def inner(self):\n        pass\n\nif True:\n    def g():\n        return 'é'\n\nasync def h(): ...\n"
    got = symbols.symbols(t, "python")
    assert [n for n, _, _ in got] == ["A", "g", "h"] and t[got[1][1] : got[1][2]].startswith("def g") and t[got[1][1] : got[1][2]].endswith("'é'")
    assert symbols.symbols("def broken(", "python") == []


@pytest.mark.parametrize("language, text, names", [("rust", 'pub fn a() { let s = "}"; }\nstruct B;\nimpl C { fn inner(&self) {} }\n// fn no() {}\n', ["a", "B", "C"]), ("go", "func (r *T) M(x int) {\n}\ntype S struct {\n}\n", ["M", "S"]), ("typescript", "export class A {\n m() {}\n}\ninterface I { x: number }\nasync function f() { }\n", ["A", "I", "f"]), ("c", "int main(void) {\n if (1) { }\n}\nstruct P { int x; };\n", ["main", "P"]), ("java", "public class A { void m() { } }\n", ["A"])])
def test_brace_symbols(language, text, names):
    assert [n for n, _, _ in symbols.symbols(text, language)] == names


def test_code_chunks(spark):
    t, s, sym, a, b = symbols.code_chunks("/x.py", "def f():\n    pass\n")[0]
    assert t.startswith("// File: /x.py | Symbol: f\ndef f") and sym == "f" and s is None
    rest = symbols.code_chunks("/x.txt", "\n".join("l" for _ in range(60)))
    assert [c[1] for c in rest] == ["lines 1-50", "lines 41-60"] and symbols.code_chunks("/x.py", "") == []
    df = spark.createDataFrame([(1, "/a.py", "def f(): pass"), (2, "/a.py", None)], "id long, path string, text string")
    assert [(r.id, r.symbol) for r in symbols.code_chunk_table(df, "id", "path", "text").collect()] == [(1, "f")]


def test_exact_index(spark):
    schema = "chunk_id long, file_id long, model_id string, dims int, text_hash string, vector array<float>"
    ix = ext.ExactIndex(spark.createDataFrame([(1, 1, "m", 2, "a", [1.0, 0.0]), (2, 1, "m", 2, "b", [0.0, 1.0]), (3, 2, "n", 2, "c", [0.6, 0.8])], schema))
    assert [r.chunk_id for r in ix.search([1.0, 0.0], 2).collect()] == [1, 3] and ix.count("m") == 2
    ix.insert(spark.createDataFrame([(1, 1, "n", 2, "z", [0.0, 1.0])], schema))
    assert ix.count("m") == 1 and ix.get(1).first().text_hash == "z" and {r.chunk_id for r in ix.hashes(1, "m").collect()} == {2}
    ix.delete_for_file(1)
    ix.delete_for_chunk(9)
    assert ix.count() == 1
    ix.clear()
    assert ix.count() == 0


def test_query_cache():
    c = ext.QueryCache(ext.ByteHistogram(), 2)
    assert c.get("a") == c.get("a") and c.hits == 1
    for q in ("b", "c", "a"):
        c.get(q)
    assert c.hits == 1 and abs(sum(x * x for x in c.get("a")) - 1) < 1e-9


def test_recent_and_folders(spark):
    log = spark.createDataFrame([("Foo", T0), ("foo ", T0.replace(day=2)), ("bar", T0.replace(day=3)), (" ", T0), (None, T0)], "query string, at timestamp")
    assert [r.query for r in ext.recent_queries(log).collect()] == ["bar", "foo"]
    f = spark.createDataFrame([(1, "/a/b/x.png", "png", None), (2, "/a/bc/y.PNG", "PNG", "h"), (3, "/a/b/z.txt", "txt", None)], "id long, path string, ext string, content_hash string")
    assert {r.id for r in ext.in_folders(f, ["/a/b"]).collect()} == {1, 3}
    keys = {r.id: r.key for r in ext.thumbnail_keys(f).collect()}
    assert set(keys) == {1, 2} and keys[2] == "h" and len(keys[1]) == 64


def test_audio(spark):
    x = audio.sine(440, 0.5)
    assert len(x) == 8000 and audio.rms(x) == pytest.approx(np.sqrt(0.5), abs=1e-3) and audio.rms(np.array([])) == 0 and audio.is_silence(x * 1e-5, 0.001)
    assert audio.meter_level(0.0) == 0 and audio.meter_level(1.0) == pytest.approx(1.0)
    assert audio.to_mono(np.array([1.0, 3.0, 5.0, 7.0, 9.0]), 2).tolist() == [2.0, 6.0]
    assert len(audio.resampled(x, 16000, 8000)) == 4000 and len(audio.resampled(x, 8000, 16000)) in (15999, 16000)
    m = audio.log_mel(x)
    hz = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 82)[1:-1] / 2595) - 1)
    assert m.shape == (80, 3000) and abs(hz[m[:, 10].argmax()] - 440) < 60 and m.max() - m.min() <= 2.0001
    df = spark.createDataFrame([([0.0, 1.0, 0.0, 1.0], 2, 16000), (None, 1, 16000)], "s array<float>, c int, r int")
    got = [r.v for r in df.select(audio.mono_column(F.col("s"), F.col("c"), F.col("r")).alias("v")).collect()]
    assert got == [[0.5, 0.5], None]
