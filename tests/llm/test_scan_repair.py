from lumenfold.llm import scan_repair as sr

BLOCK = "array<struct<text string, page int, section string, start_offset int, end_offset int>>"


def b(*texts):
    return [(t, 1, None, 0, 0) for t in texts]


def docs(spark):
    clean = "the seasonal worker went to the lighthouse and labelled the drawer before lunch\nthe old bridge between two cabinets was mailed, all is well and known\na well-\nknown drawer"
    rows = [(k, "Some running title", b(clean), "x") for k in range(100, 160)]
    rows += [
        (1, "Seasonal handbook 12", b("SEASONAL HANDB0OK 12\nthe worker went to the lighthouse", "the dravver bet ween two cabinets was labellecl", "the drawer was mailed and the light-\nhouse\n2/3", "plain drawer\nParts l0-O31 and 5S-777 fit the drawer."), "x"),
        (2, None, None, "x"), (3, None, [], "x"), (4, None, b(None, ""), "x"), (5, None, b("the old surve\xad"), "x"),
    ]
    rows += rows[-5:-4]  # a redelivery
    return spark.createDataFrame(rows, f"file_id long, title string, blocks {BLOCK}, block string")


def test_found_and_repaired(spark):
    s = sr.ScanRepair(sr.read_layout(docs(spark), "d", "blocks", "title"))
    assert {(r.file_id, r.block_no) for r in s.found().collect()} == {(1, 0), (1, 1), (1, 2), (5, 0)}
    text = {(r.file_id, r.block_no): r.text for r in s.repaired().collect()}
    assert text[1, 0] == "the worker went to the lighthouse"
    assert text[1, 1] == "the drawer between two cabinets was labelled"
    assert text[1, 2] == "the drawer was mailed and the lighthouse"
    assert text[1, 3] == "plain drawer Parts l0-O31 and 5S-777 fit the drawer."
    assert "well-known" in text[100, 0]


def test_copies_of_a_scan_are_one_witness(spark):
    clean = "the worker left the drawer by the lighthouse number "
    rows = [(k, None, b(f"{clean}{k}"), "x") for k in range(100, 160)]
    rows += [(k, None, b("the dravver was left bet ween two posts"), "x") for k in range(40)]
    rows += [(k, None, b(f"it stood between the posts of row {k}"), "x") for k in range(200, 240)]
    s = sr.ScanRepair(sr.read_layout(spark.createDataFrame(rows, f"file_id long, title string, blocks {BLOCK}, block string"), "d", "blocks", "title"))
    assert {r.w: r.n for r in s.words.where("w in ('dravver', 'drawer', 'ween')").collect()} == {"dravver": 1, "drawer": 60, "ween": 1}
    assert {r.file_id for r in s.found().collect()} == set(range(40))
    assert {r.text for r in s.repaired().where("file_id < 40").collect()} == {"the drawer was left between two posts"}


def test_empty(spark):
    s = sr.ScanRepair(sr.read_layout(docs(spark).limit(0), "d", "blocks", "title"))
    assert s.found().count() == 0 and s.repaired().count() == 0


def test_layout_rules():
    assert sr.layout(["Page 1 of 3"], None) == [(0, False, ["Page 1 of 3"])]  # a block that is one line stays
    assert sr.layout(["text\n[4]"], None)[0][1] and sr.layout(["text\n- 4 -"], None)[0][1] and sr.layout(["text\np. 4"], None)[0][1]
    assert not sr.layout(["text\nvalve  82  115"], None)[0][1]


def test_running_lines_of_any_length_at_either_end():
    long = "a running title of very many words " * 5
    assert [x[1] for x in sr.layout([f"{long}\nfirst text here", f"{long}\nother text there", "no title\nin this one"], None)] == [True, True, False]
    assert [x[1] for x in sr.layout(["first text here\nSEASONAL HANDBOOK  3", "other text there\nSEASONAL HANDBOOK  4"], None)] == [True, True]
    assert [x[1] for x in sr.layout(["first text here\nof the archive.", "other text there\nof the archive."], None)] == [False, False]


def test_distance():
    import random

    def plain(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert sr._distance(a, b) == plain(a, b)


def test_alignment_has_no_limit_of_length_or_misreadings():
    assert all(sr.skeleton(p) == sr.skeleton(r) for p, r in sr.CONFUSIONS)
    assert sr.align("drawer", "clravver") is not None and len(sr.align("drawer", "clravver")) == 2
    word = "ledclamp" * 12
    assert len(sr.align(word, word.replace("l", "1").replace("e", "c"))) == 36
    assert sr.align("drawer", "drawer") is None and sr.align("drawer", "draper") is None


def test_many_misread_signs_in_a_long_word(spark):
    word = "leuchtturmwaerterhaeuschenschluesselanhaengerbeschriftung"
    rows = [(k, None, b(f"the {word} of row {k}"), "x") for k in range(400)]
    rows += [(999, None, b(f"the {word.replace('l', '1').replace('h', 'b')} of row 12"), "x")]
    s = sr.ScanRepair(sr.read_layout(spark.createDataFrame(rows, f"file_id long, title string, blocks {BLOCK}, block string"), "d", "blocks", "title"))
    assert {r.file_id for r in s.found().collect()} == {999}

