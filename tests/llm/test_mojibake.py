import random

from lumenfold.llm import mojibake as mj

SENTENCES = ["Außerdem prüfte man die Übersicht und die größere Küche.", "Voilà pourquoi le numéro reste abîmé après la réunion.", "El código extraño se borró después de la sesión.", "Там лежала новая страница, потом она была исправлена.", "Główna zdjęcie leży bez żadnych zmian, więc ją zamknięto.", "The façade isn’t spare — it’s annotated, at 21 °C ± 2.", "A plain sentence without any sign."]


def corpus(spark):
    rng = random.Random(2)
    clean = [" ".join(rng.choices(SENTENCES, k=4)) for _ in range(300)]
    bad = {
        1000: SENTENCES[0].encode("utf-8").decode("cp1252", "replace"), 1001: SENTENCES[1].encode("utf-8").decode("cp850"), 1002: SENTENCES[3].encode("koi8_r").decode("cp1251"), 1003: "Fine. " + SENTENCES[3].encode("cp1251").decode("cp1252"),
        1004: SENTENCES[2].encode("cp1252").decode("mac_roman"), 1005: "El recibo est" + mj.LOST + " aqu" + mj.LOST + ".", 1006: SENTENCES[0].replace("’", "'").encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"),
    }
    rows = [(k, t, "x") for k, t in enumerate(clean)] + [(k, t, "x") for k, t in bad.items()] + [(2000, None, "x"), (2001, "", "x"), (None, "é", "x")]
    return spark.createDataFrame(rows, "id long, text string, garbled string"), bad


def test_found_and_restored(spark):
    df, bad = corpus(spark)
    got = {r.id: (r.restored, r.garbled) for r in mj.judged(df, "id", "text").collect()}
    assert {k for k, v in got.items() if v[1]} == set(bad)
    assert got[1001][0] == SENTENCES[1] and got[1002][0] == SENTENCES[3] and got[1003][0] == "Fine. " + SENTENCES[3] and got[1004][0] == SENTENCES[2]
    assert got[2000] == (None, False) and got[2001] == ("", False)


def test_chains_undo_what_was_done():
    for written, read_as in [("utf-8", r) for r in mj.READ_AS] + mj.PAIRS:
        for s in SENTENCES:
            raw = s.encode(written, "ignore")
            want = raw.decode(written)
            seen = "".join(chr(b) if b < 128 else mj._to_char(read_as)[b] for b in raw)
            if len(set(mj._to_char(read_as).values())) == 128:
                assert mj.undo(seen, written, read_as) == want


def test_empty(spark):
    df, _ = corpus(spark)
    assert mj.judged(df.limit(0), "id", "text").count() == 0


def test_garbling_drops_no_character():
    for s in SENTENCES[:6]:
        g = mj.garble(s)
        assert g and g[1] != s and mj.apply(g[1], mj.CHAINS[g[0]]) == s
    assert mj.garble(SENTENCES[6]) is None


def test_margin_counts_every_passage(spark):
    texts = spark.createDataFrame([(" ".join(SENTENCES[(k + j) % 6] for j in range(102)),) for k in range(60)], "text string")
    surveyed = mj.survey(texts)
    model, first = mj.trained(surveyed)
    counts = mj.gain_counts(surveyed.where("k = 'p'").select("passages"), spark.sparkContext.broadcast((model, first)))
    # texts of the same sentences in the same order are one text
    assert counts["clean"].sum() == counts["bad"].sum() == 6 * 102
    margin = mj.validated_margin(counts)
    assert 0 < margin < 60


def test_margin_is_where_the_fewest_are_wrong():
    clean, bad = (mj.np.zeros(2 * mj.SPAN * mj.FINE, int) for _ in range(2))
    at = lambda g: int((g + mj.SPAN) * mj.FINE)
    clean[at(-20)], clean[at(3)] = 10_000, 20
    bad[at(2)], bad[at(40)] = 30, 9_000
    assert 3 < mj.validated_margin({"clean": clean, "bad": bad}) < 40
    assert mj.validated_margin({"clean": 0 * clean, "bad": bad}) == mj.DOUBT


def test_scores_in_batches_are_the_plain_ones():
    """Against a plain sum of logarithms, text by text; no text is cut."""
    import math

    c = mj.Counter3()
    c.add(SENTENCES * 3)
    m = mj.CharModel(*(t.astype("float32") for t in c.tables.values()))

    def plain(text):
        codes = mj.np.array([ord(x) for x in "  " + text])
        t, b, u = mj._slots(codes)
        total = 0.0
        for k in range(len(text)):
            p1 = (m.uni[u[k + 2]] + 0.05) / (m.total + 0.05 * mj.UNI)
            p2 = (m.bi[b[k + 1]] + 2 * p1) / (m.uni[u[k + 1]] + 2)
            total += math.log((m.tri[t[k]] + 2 * p2) / (m.bi[b[k]] + 2))
        return total

    texts = [*SENTENCES, "", "é", "ü" * 5000]
    assert all(abs(a - plain(t)) < 1e-4 * max(1, abs(a)) for a, t in zip(m.scores(texts), texts))
    judge = mj.Judge(m)
    long = "Küche" * 400
    seen = long.encode("utf-8").decode("cp1252")
    assert judge.restore([seen])[0] == (long, True)


def test_copies_of_a_garbled_text_do_not_speak_for_it(spark):
    df, bad = corpus(spark)
    text = " ".join(s for s in SENTENCES[3:4] * 3).encode("cp1251").decode("cp1252")
    copies = spark.createDataFrame([(5000 + k, text, "x") for k in range(900)], df.schema)
    got = mj.judged(df.unionByName(copies), "id", "text").where("garbled").select("id").collect()
    assert {r.id for r in got} == set(bad) | set(range(5000, 5900))
