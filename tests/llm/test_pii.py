import random
import re

from lumenfold.llm import pii
from lumenfold.llm.pii_labels import HELD_OUT, MIXED, PLAIN, held_out, labelled_table


def kinds(t):
    return sorted({k for _, _, k in pii.spans([t], pii.Tagger(pii.train()))[0]})


def measured(rows):
    """Share of the labelled spans that a span of their kind meets, and of the found spans that meet a labelled one."""
    hit = want = good = got = 0
    tagger = pii.Tagger(pii.train())
    for r in rows:
        text, spans = pii.plain_and_spans(r)
        found = set(pii.spans([text], tagger)[0])
        meets = lambda x, others: any(x[2] == y[2] and x[0] < y[1] and y[0] < x[1] for y in others)
        hit, want = hit + sum(meets(x, found) for x in spans), want + len(spans)
        good, got = good + sum(meets(x, spans) for x in found), got + len(found)
    return hit / want, good / got


def test_other_values_in_the_frames_of_training():
    recall, precision = measured(labelled_table(share=0.2, per_frame=2, seed=99))
    assert recall > 0.93 and precision > 0.93


def test_frames_kept_from_training():
    assert not {f for f in HELD_OUT} & {f for f in PLAIN + MIXED}
    recall, precision = measured(held_out(per_frame=30))
    print(recall, precision)
    assert recall > 0.82 and precision > 0.88


def test_ordinary_wording():
    names = ["Please ask Jane Fairweather about the invoice.", "Bob Martinez will call you back tomorrow.", "The report was written by Li Wei.", "ask jane fairweather to come"]
    assert sum("person_name" in kinds(t) for t in names) >= 3
    assert "phone" in kinds("Call me at (415) 262-3344 before noon.")
    assert kinds("It runs on Microsoft Windows as well.") == [] and kinds("We visited New York in June.") == []


def test_untraced_segments_have_no_label():
    """Decoding every segment gives the same spans as decoding those that aren't proven to have none."""
    rows = [re.sub(r"\[\[\w+\||\]\]", "", r) for r in labelled_table(share=0.1, per_frame=2, seed=3)]
    rows += [" ".join(rows[k : k + 30]) for k in range(0, 300, 30)]
    tagger = pii.Tagger(pii.train())
    assert pii.spans(rows, tagger) == pii.spans(rows, tagger, every=True)


def test_spans_and_placeholders():
    t = "Please ask Helen Orrolm to call +999-544-257-170.\nWrite to ludo.rovell@kitchenpost.example, please."
    found = pii.spans([t], pii.Tagger(pii.train()))[0]
    masked = pii.mask(t, found)
    assert "[PERSON_NAME]" in masked and "[PHONE]" in masked and "[EMAIL]" in masked and "Orrolm" not in masked and "ludo" not in masked and masked.endswith("please.")


def test_no_cases():
    for t in ["Push to git@forge.example:team/socket.git first.", "It needs skasom@6.8.9 here.", "Project Green Garden is late.", "ISBN 978-0-2677-1951-7 is out of print.", "Ask the @nound channel.", "", "x" * 100_000]:
        assert kinds(t) == []


def test_viterbi_against_brute_force():
    """The batch decoder finds the best path of the field."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    L = pii.L
    model = pii.Model(rng.normal(size=(len(pii.OFFSETS), pii.BUCKETS, L)).astype(np.float32), rng.normal(size=(L, L)).astype(np.float32), rng.normal(size=L).astype(np.float32))
    tagger = pii.Tagger(model)
    seg = ["Ab", "12", "@"]
    got = tagger.tag([seg, ["x"], seg], every=True)[0]
    x = pii._pad([[tagger.types[pii.token_type(t)] for t in seg]], 0)
    e = pii._emissions(tagger.tables, x)[0]
    best = max(itertools.product(range(L), repeat=3), key=lambda p: model.start[p[0]] + sum(e[i, p[i]] for i in range(3)) + model.trans[p[0], p[1]] + model.trans[p[1], p[2]])
    assert tuple(got) == best


def test_table(spark):
    rows = [(1, "Please ask Helen Orrolm about the table.", "z"), (1, "Please ask Helen Orrolm about the table.", "z"), (2, None, "z"), (3, "", "z"), (None, "x", "z")]
    df = spark.createDataFrame(rows, "id long, text string, kinds string")
    got = {r.row_id: (r.kinds, r.masked_text) for r in pii.tag_table(df, "id", {"a": "text"}).collect()}
    assert got[1][0] == ["person_name"] and got[2] == ([], None) and got[3] == ([], "")
    assert pii.tag_table(df.limit(0), "id", {"a": "text"}).count() == 0


def test_labelled_rows_are_fixed():
    assert labelled_table() == labelled_table() and random.Random(11).random() == random.Random(11).random()
