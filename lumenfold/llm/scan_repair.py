"""Noise in text from scanned pages: layout repair and noisy-channel correction.

A block is read by lines. A first or last line that only repeats the running title (the document's title, or a line other
blocks of the document begin or end with) or a page number is dropped. A word broken by a hyphen-like mark at the end of a
line or block is joined; a compound of two known words whose joined form is unknown keeps its hyphen. Misread and split
words are corrected by a noisy channel: the probability of the character confusions that lead from a candidate word to what
stands there, times the likelihood of the candidates by word unigrams and bigrams, decoded by Viterbi over the candidates of
each line.

Candidates share the form's skeleton, a spelling in which all signs that may be read for each other are alike, and are
aligned with it; so neither the length of a word nor the number of its misread signs is limited. A candidate must stand in
the corpus RATIO times as often as the form. The probability of each confusion is estimated from the corpus: how often the
best alignments use it, in proportion to how often its printed side stands in lines with a doubtful word.

The n-grams are counted over all blocks: once per distinct block text, so a scan held under many files is one witness, and
by blocks; what they decide is applied to every block. Each distinct text is corrected once and its blocks are joined to it.

All tables that grow with the corpus (counts, candidates, bigrams) stay distributed and are joined by sort and merge. Words
(and texts) that hold more than a HOT_KEYS-th of all places are fewer than HOT_KEYS; these alone are broadcast, so no task
gathers a frequent word. A line's lattice is the largest thing held at once.

Defined results: null documents, blocks and texts have no rows; block_no is the place in the array from 0; redeliveries
count once (of differing ones the text of least hash); an empty table gives an empty result; texts of any length are used whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import apart, scratch, spread

TOKEN = re.compile(r"(?:!(?=[^\W\d_]))?[^\W_]+(?:!(?=[^\W\d_])[^\W_]+)*")
MARKS = "-¬\xad‐‑"
LINE_END = re.compile(rf"([^\W\d_]+)([{MARKS}])[ \t]*$")
PAGE = re.compile(r"(?i)^[\[(\-–—\s]*(?:(?:page|seite|p\.|s\.|pg\.?)\s*)?\d{1,4}(?:\s*(?:/|of|von|de|sur)\s*\d{1,4})?[\])\-–—\s]*$")
#: What may be read (right) where the left was printed.
CONFUSIONS = [("d", "cl"), ("m", "rn"), ("w", "vv"), ("u", "ii"), ("li", "h"), ("l", "1"), ("o", "0"), ("s", "5"), ("i", "!"), ("a", "ä"), ("e", "c"), ("c", "e"), ("h", "b"), ("t", "f"), ("g", "q"), ("b", "8"), ("i", "1"), ("i", "l"), ("l", "i"), ("o", "ö"), ("u", "ü"), ("n", "ri"), ("z", "2"), ("g", "9"), ("rn", "m"), ("cl", "d"), ("nn", "m"), ("h", "li")]
#: Signs written alike in a skeleton: every left and right side of CONFUSIONS has the same one.
ALIKE = str.maketrans({"l": "i", "1": "i", "!": "i", "e": "c", "0": "o", "ö": "o", "5": "s", "ä": "a", "f": "t", "9": "g", "q": "g", "2": "z", "ü": "ii", "u": "ii", "h": "ii", "b": "ii", "8": "ii", "d": "ci", "n": "ri", "m": "rri", "w": "vv"})
SPLIT_COST = 3.5
#: A candidate must be this many times as frequent as the form that stands there.
RATIO = 8
#: Keys with more than a HOT_KEYS-th of all places; fewer than HOT_KEYS, by counting.
HOT_KEYS = 4096


NUMBERED = re.compile(r"^\s*\d{1,4} {2,}(?=\D)|(?<=\S) {2,}\d{1,4}\s*$")


def _letters(s: str) -> str:
    """The line's letters, without a page number set apart from it and without numbers; misread digits as letters."""
    s = re.sub(r"\b\d+\b", " ", NUMBERED.sub("", s))
    return re.sub(r"[^a-z]", "", s.lower().replace("8", "b").replace("0", "o").replace("1", "l").replace("5", "s").replace("!", "i"))


def _distance(a: str, b: str) -> int:
    """Edit distance, a column of the table at a time as the bits of two numbers."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, n = whole, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        cross = (((eq & up) + up) ^ up) | eq
        right, left = down | ~(cross | up) & whole, up & cross
        n += 1 if right & top else -1 if left & top else 0
        right, left = (right << 1 | 1) & whole, left << 1 & whole
        up, down = (left | ~(eq | down | right)) & whole, right & (eq | down)
    return n


def _alike(a: str, b: str) -> bool:
    """Same line but for misread letters: no more than a fifth of the letters differ, by an aligned comparison."""
    if not a or not b or abs(len(a) - len(b)) > max(2, len(b) // 5):
        return False
    return a == b or _distance(a, b) <= max(1, len(b) // 5)


def _repeated_but_misread(lines: list[str]) -> list[str]:
    """Of distinct lines, those that another one repeats but for misread letters. Letter counts rule most pairs out."""
    if len(lines) < 2:
        return []
    counts = np.array([np.bincount(np.frombuffer(x.encode(), dtype=np.uint8) - 97, minlength=26)[:26] for x in lines], dtype=np.int32)
    size = counts.sum(1)
    out = []
    for k, x in enumerate(lines):
        near = np.flatnonzero(np.abs(counts - counts[k]).sum(1) <= 2 * np.maximum(2, size // 5))
        if any(j != k and _alike(x, lines[j]) for j in near):
            out.append(x)
    return out


def _set_apart(line: str) -> bool:
    """A page number beside it, or capitals."""
    return bool(NUMBERED.search(line)) or (len(_letters(line)) >= 8 and re.sub(r"[^A-Za-z]", "", line).isupper())


def layout(texts: list[str | None], title: str | None) -> list[tuple[int, bool, list[str]]]:
    """Per block with text: its number, whether a running line was dropped, the lines kept."""
    split = [(k, t.split("\n")) for k, t in enumerate(texts) if t]
    first = [ls[0] for _, ls in split if len(ls) > 1]
    known = [_letters(title)] if title and len(_letters(title)) >= 5 else []
    # last lines by chance repeat too, where a sentence ends: those count that are set like a running title
    for lines in (first, [ls[-1] for _, ls in split if len(ls) > 1 and _set_apart(ls[-1])]):
        known += [h for h, n in Counter(map(_letters, lines)).items() if n >= 2 and len(h) >= 8 and h not in known]
    if not title:
        # of lines set like a running title, those that another one repeats but for misread letters
        set_apart = list(dict.fromkeys(_letters(x) for x in first if _set_apart(x)))
        known += [h for h in _repeated_but_misread(set_apart) if h not in known and len(h) >= 8]
    out = []
    for k, ls in split:
        lines = list(ls)
        dropped = False
        for end in (0, -1):
            if not lines:
                break
            line = lines[end].strip()
            if not line:
                continue
            bare = _letters(line)
            if PAGE.match(line) and len(ls) > 1 or len(bare) >= 5 and len(ls) > 1 and any(_alike(bare, h) for h in known):
                lines.pop(end)
                dropped = True
        out.append((k, dropped, lines))
    return out


def tokens(line: str) -> list[str]:
    return [t.lower() for t in TOKEN.findall(line)]


LAYOUT = "origin string, file_id long, block_no long, running boolean, lines array<string>, toks array<string>, breaks array<struct<line: int, left: string, mark: string, right: string>>"


def read_layout(docs: DataFrame, origin: str, blocks_col: str, title_col: str | None) -> DataFrame:
    """One row per block: the lines kept, their tokens (a line's joined by blanks), and the words broken at line ends."""
    rows = docs.where(F.col("file_id").isNotNull() & F.col(blocks_col).isNotNull()).select(
        F.col("file_id").cast("long").alias("file_id"), F.transform(blocks_col, lambda b: b["text"]).alias("texts"), (F.col(title_col) if title_col else F.lit(None).cast("string")).alias("title")
    )

    def run(batches):
        for pdf in batches:
            out = []
            for fid, texts, title in zip(pdf["file_id"], pdf["texts"], pdf["title"]):
                found = layout(list(texts), title)
                for n, (k, dropped, lines) in enumerate(found):
                    after = found[n + 1][2] if n + 1 < len(found) else []
                    toks, breaks, carry = [], [], 0
                    for j, line in enumerate(lines):
                        t = tokens(line)
                        if carry and t:
                            t = t[1:]  # the second half of a broken word
                        carry = 0
                        m = LINE_END.search(line)
                        if m and t:
                            nxt = tokens(lines[j + 1]) if j + 1 < len(lines) else tokens(after[0]) if after else []
                            breaks.append({"line": j, "left": m.group(1).lower(), "mark": m.group(2), "right": nxt[0] if nxt else ""})
                            t = t[:-1]
                            carry = 1
                        toks.append(" ".join(t))
                    out.append((origin, fid, k, dropped, lines, toks, breaks))
            yield pd.DataFrame(out, columns=["origin", "file_id", "block_no", "running", "lines", "toks", "breaks"])

    return spread(rows).mapInPandas(run, LAYOUT)


def skeleton(word: str) -> str:
    return re.sub("i+r", "r", word.translate(ALIKE))


_BY_FIRST: dict[str, list[tuple[int, str, str]]] = defaultdict(list)
for _k, (_printed, _read) in enumerate(CONFUSIONS):
    _BY_FIRST[_printed[0]].append((_k, _printed, _read))


def align(cand: str, word: str) -> tuple[int, ...] | None:
    """The fewest confusions that make `word` of `cand`, or None."""
    at: list[dict[int, tuple[int, tuple]]] = [{} for _ in range(len(cand) + 1)]
    at[0][0] = (0, ())
    for i in range(len(cand)):
        for j, (n, used) in at[i].items():
            if word.startswith(cand[i], j):
                old = at[i + 1].get(j + 1)
                if old is None or n < old[0]:
                    at[i + 1][j + 1] = (n, used)
            for k, printed, read in _BY_FIRST.get(cand[i], ()):
                if cand.startswith(printed, i) and word.startswith(read, j):
                    slot, to = at[i + len(printed)], j + len(read)
                    if to not in slot or n + 1 < slot[to][0]:
                        slot[to] = (n + 1, (used, k))
        at[i] = {}
    got = at[len(cand)].get(len(word))
    if got is None or not got[0]:
        return None
    out, used = [], got[1]
    while used:
        used, k = used
        out.append(k)
    return tuple(reversed(out))


def _skeletons(batches):
    for pdf in batches:
        pdf = pdf[[any(c.isalpha() for c in w) for w in pdf["w"]]]
        yield pdf.assign(skeleton=[skeleton(w) for w in pdf["w"]], proper=[len(w) > 1 and w.isalpha() for w in pdf["w"]])


def _aligned(batches):
    for pdf in batches:
        pdf = pdf.assign(used=[align(c, w) for c, w in zip(pdf["cand"], pdf["w"])])
        yield pdf[pdf["used"].notna()]


FORM = "w string, n long, copies long"
CANDIDATE = "cand string, cn long, ccopies long, used array<int>"


def candidates(words: DataFrame) -> DataFrame:
    """w, n, copies, cand, cn, ccopies, used: a row per form and candidate. words: w, n (over distinct texts), copies (over all blocks)."""
    marked = words.mapInPandas(_skeletons, f"{FORM}, skeleton string, proper boolean")
    known = marked.where(F.col("proper") & (F.col("copies") >= RATIO)).select("skeleton", F.col("w").alias("cand"), F.col("n").alias("cn"), F.col("copies").alias("ccopies"))
    often = (F.col("cn") >= F.col("n") * RATIO) | (F.col("ccopies") >= F.col("copies") * RATIO)
    pairs = apart(marked.drop("proper")).join(apart(known), "skeleton").where((F.col("w") != F.col("cand")) & often)
    return pairs.select("w", "n", "copies", "cand", "cn", "ccopies").mapInPandas(_aligned, f"{FORM}, {CANDIDATE}")


def by_key(left: DataFrame, right: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Inner join in which no task gathers a frequent key. hot: the frequent keys, fewer than HOT_KEYS; right has few rows a
    key. Rows of `left` with such a key stay where they are; the others go by sort and merge."""
    keys = F.broadcast(hot)
    common = left.join(F.broadcast(right.join(keys, key, "left_semi")), key)
    rare = apart(left.join(keys, key, "left_anti")).join(apart(right.join(keys, key, "left_anti")), key)
    return common.unionByName(rare)


def _lattice(batches):
    """Lines with uncertain words: the neighbouring pairs whose bigram counts the line's lattice needs."""
    for pdf in batches:
        out = []
        for key, toks, spots in zip(pdf["line_id"], pdf["toks"], pdf["spots"]):
            toks = toks.split(" ")
            at = {int(s["pos"]): [c["cand"] for c in s["cands"]] for s in spots if s["cands"] is not None}
            states = lambda i: [toks[i], *at.get(i, [])]  # noqa: B023, E731
            for i in sorted({j for p in at for j in (p, p + 1) if 0 < j < len(toks)}):
                out += [(key, a, b) for a in states(i - 1) for b in states(i)]
        yield pd.DataFrame(out, columns=["line_id", "a", "b"]).drop_duplicates()


def _decode(totals: dict[str, int], costs: list[float]):
    """Viterbi over the candidates of each line, by the counts of blocks (copies) and of distinct texts (n); where both change
    a word, the latter holds. Rows: line_id, toks, spots, pairs (the bigram counts the lattice needs). costs: of each
    confusion; one that hits the same sign all over a word is a habit and counts twice at most. Also finds torn words."""

    def cost(used) -> float:
        return sum(costs[k] * min(n, 2) for k, n in Counter(int(k) for k in used).items())

    def path(toks: list[str], spots, pairs, by: str) -> list[tuple[int, str, str]]:
        total = totals[by]
        bi = {(p["a"], p["b"]): (int(p[by]), int(p[f"{by}a"])) for p in pairs} if pairs is not None else {}
        at = {}
        for s in spots:
            kept = [{"cand": c["cand"], "cost": cost(c["used"]), "cn": c[f"c{by}"]} for c in s["cands"] if c[f"c{by}"] >= s[by] * RATIO] if s["cands"] is not None else []
            if kept:
                at[int(s["pos"])] = {"n": s[by], "cands": kept}
        if not at:
            return []

        def state(i):
            """form, cost, unigram count, share of its own count that speaks for it"""
            w, s = toks[i], at.get(i)
            if s is None:
                return [(w, 0.0, None, 1.0)]
            n = int(s["n"])
            most = max(int(c["cn"]) for c in s["cands"])
            own = max(n - 1 - 0.01 * most, 0.3)  # not its own witness, less what misreading of the candidate explains
            return [(w, 0.0, own, own / n)] + [(c["cand"], c["cost"], float(c["cn"]), 1.0) for c in s["cands"]]

        best: list[dict[str, tuple[float, str | None]]] = []
        shares: dict[str, float] = {}
        for i in range(len(toks)):
            now: dict[str, tuple[float, str | None]] = {}
            states = state(i)
            for w, price, uni, share in states:
                p = (uni if uni is not None else 1.0) / total
                if i == 0:
                    now[w] = (math.log(p) - price, None)
                    continue
                for v, (score, _) in best[-1].items():
                    s = score
                    if uni is not None or i - 1 in at:
                        n, na = bi.get((v, w), (0, 0))
                        least = min(share, shares.get(v, 1.0))
                        seen = max(n * least - (1 if least < 1 else 0), 0)
                        s += math.log(0.7 * seen / max(na, 1) + 0.3 * p) - price
                    if w not in now or s > now[w][0]:
                        now[w] = (s, v)
            best.append(now)
            shares = {w: share for w, _, _, share in states}
        w = max(best[-1], key=lambda x: best[-1][x][0])
        out = []
        for i in range(len(toks) - 1, -1, -1):
            if i in at and w != toks[i]:
                out.append((i, w, "word"))
            w = best[i][w][1] if i else None
        return out

    def one(toks: list[str], spots, pairs) -> list[tuple[int, str, str]]:
        found = {c[0]: c for by in ("copies", "n") for c in path(toks, spots, pairs, by)}
        torn = {}
        for s in spots:
            for t in s["tears"] if s["tears"] is not None else ():
                for i in (int(s["pos"]) - 1, int(s["pos"])):
                    if 0 <= i < len(toks) - 1 and toks[i] == t["a"] and toks[i + 1] == t["b"]:
                        torn[i] = (i, t["ab"], "torn")
        return [*(found[i] for i in sorted(found)), *(torn[i] for i in sorted(torn))]

    def run(batches):
        for pdf in batches:
            out = [(h, line, *c) for h, line, toks, spots, pairs in zip(pdf["hash"], pdf["line"], pdf["toks"], pdf["spots"], pdf["pairs"]) for c in one(toks.split(" "), spots, pairs)]
            yield pd.DataFrame(out, columns=["hash", "line", "pos", "word", "what"])

    return run


class ScanRepair:
    """Counts, candidates and decoded changes over a set of blocks (rows of read_layout)."""

    def __init__(self, blocks: DataFrame):
        spark = self.spark = blocks.sparkSession
        read = self._kept("layout", blocks.withColumn("hash", F.sha2(F.to_json(F.struct("lines", "breaks")), 256)))
        light = read.groupBy("origin", "file_id", "block_no").agg(F.min(F.struct("hash", "running")).alias("x")).select("origin", "file_id", "block_no", "x.hash", "x.running")
        self.blocks = self._kept("blocks", light)
        copies = self.blocks.groupBy("hash").agg(F.count("*").alias("copies"))
        each = read.groupBy("hash").agg(*[F.first(c).alias(c) for c in ("lines", "toks", "breaks")])
        #: hash, lines, toks, breaks, copies: every distinct text once
        self.texts = self._kept("texts", apart(each).join(apart(copies), "hash"))
        self.hot_texts = self.texts.where(F.col("copies") > self.blocks.count() / HOT_KEYS).select("hash")
        self.lines = self.texts.select("hash", "copies", F.posexplode("toks").alias("line", "toks")).where(F.col("toks") != "")
        flat = self.lines.select("copies", F.split("toks", " ").alias("t"))
        counts = (F.count("*").alias("n"), F.sum("copies").alias("copies"))
        self.words = self._kept("words", flat.select("copies", F.explode("t").alias("w")).groupBy("w").agg(*counts))
        pair = F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t") - 1).alias("b")))
        self.pairs = self._kept("pairs", flat.where(F.size("t") > 1).select("copies", pair.alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(*counts))
        self.totals = {k: v or 1 for k, v in self.words.agg(F.sum("n").alias("n"), F.sum("copies").alias("copies")).first().asDict().items()}
        self.hot_words = self.words.where((F.col("n") > self.totals["n"] / HOT_KEYS)).select("w")

    def _kept(self, label: str, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, f"scan-{label}")
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def splits(self) -> DataFrame:
        """w, a, b, ab: word pairs that are one word torn apart: the joined form is frequent, the pair isn't, and a part (w) is no word by itself."""
        known, na, nb = (self.words.select(F.col("w").alias(c), F.col("n").alias(f"n{c}"), F.col("copies").alias(f"copies{c}")) for c in ("ab", "a", "b"))

        def rare(n: str):
            """By distinct texts (n) or by blocks (copies)."""
            return (F.log(f"{n}ab") - SPLIT_COST > F.log(n)) & (F.least(f"{n}a", f"{n}b") * RATIO <= F.col(f"{n}ab"))

        letters = F.col("a").rlike(r"^\p{L}+$") & F.col("b").rlike(r"^\p{L}+$")
        torn = apart(self.pairs.where(letters).withColumn("ab", F.concat("a", "b"))).join(apart(known), "ab").where((F.log("nab") - SPLIT_COST > F.log("n")) | (F.log("copiesab") - SPLIT_COST > F.log("copies")))
        part = by_key(by_key(torn, na, self.hot_words.withColumnRenamed("w", "a"), "a"), nb, self.hot_words.withColumnRenamed("w", "b"), "b")
        return part.where(rare("n") | rare("copies")).select(F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("w"), "a", "b", "ab")

    def changes(self) -> DataFrame:
        """hash, line, pos, word, what: words the decoding changed (what = word) and torn words put together (torn)."""
        spotted = self._kept("candidates", candidates(self.words))
        # how often each confusion is used: by the best candidate of each form; a row per confusion
        best = spotted.groupBy("w").agg(F.min_by(F.struct("n", "used"), F.struct(F.size("used"), -F.col("cn"), "cand")).alias("b"))
        used = {r.k: r.n for r in best.select("b.n", F.explode("b.used").alias("k")).groupBy("k").agg(F.sum("n").alias("n")).collect()}
        fix = spotted.groupBy("w").agg(F.first("n").alias("n"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("cand", "cn", "ccopies", "used"))).alias("cands"))
        tears = self.splits().groupBy("w").agg(F.sort_array(F.collect_list(F.struct("a", "b", "ab"))).alias("tears"))
        look = apart(fix).join(apart(tears), "w", "full")
        places = self.lines.select("hash", "line", F.posexplode(F.split("toks", " ")).alias("pos", "w"))
        spots = by_key(places, look, self.hot_words, "w").groupBy("hash", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "copies", "cands", "tears"))).alias("spots"))
        doubtful = self._kept("doubtful", apart(self.lines).join(apart(spots), ["hash", "line"]).withColumn("line_id", F.concat_ws("/", "hash", "line")))
        held = [F.sum((F.length("toks") - F.length(F.replace("toks", F.lit(p), F.lit("")))) / len(p)).alias(f"c{k}") for k, (p, _) in enumerate(CONFUSIONS)]
        chances = doubtful.where(F.exists("spots", lambda s: s["cands"].isNotNull())).agg(*held).first()
        costs = [-math.log((used.get(k, 0) + 0.5) / (max(chances[k] or 0, used.get(k, 0)) + 1)) for k in range(len(CONFUSIONS))]
        needed = doubtful.select("line_id", "toks", "spots").mapInPandas(_lattice, "line_id string, a string, b string")
        first = self.words.select(F.col("w").alias("a"), F.col("n").alias("na"), F.col("copies").alias("copiesa"))
        counted = by_key(apart(needed).join(apart(self.pairs), ["a", "b"]), first, self.hot_words.withColumnRenamed("w", "a"), "a")
        lists = counted.groupBy("line_id").agg(F.collect_list(F.struct("a", "b", "n", "na", "copies", "copiesa")).alias("pairs"))
        lines = apart(doubtful).join(apart(lists), "line_id", "left").select("hash", "line", "toks", "spots", "pairs")
        return lines.mapInPandas(_decode(self.totals, costs), "hash string, line int, pos int, word string, what string")

    def breaks(self) -> DataFrame:
        """hash, line, joined: broken words; joined is false for a hyphenated compound that only stands at the end of a line."""
        b = self.texts.select("hash", F.explode("breaks").alias("x")).select("hash", "x.*")
        asked = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), w.alias("w")) for k, w in (("ab", F.concat("left", "right")), ("l", F.col("left")), ("r", F.col("right")))]))
        words = b.where(F.col("mark") == "-").select("hash", "line", asked.alias("q")).select("hash", "line", "q.role", "q.w")
        count = lambda role: F.max(F.when(F.col("role") == role, F.col("copies"))).alias(f"n_{role}")
        known = by_key(words, self.words.select("w", "copies"), self.hot_words, "w").groupBy("hash", "line").agg(count("ab"), count("l"), count("r"))
        compound = F.col("n_ab").isNull() & (F.coalesce("n_l", F.lit(0)) >= 3) & (F.coalesce("n_r", F.lit(0)) >= 3)
        return apart(b.select("hash", "line")).join(apart(known), ["hash", "line"], "left").select("hash", "line", (~compound).alias("joined"))

    def found(self) -> DataFrame:
        """origin, file_id, block_no of blocks with damage."""
        hit = self.breaks().where("joined").select("hash").unionByName(self.changes().select("hash")).distinct()
        cols = ("origin", "file_id", "block_no")
        return self.blocks.where("running").select(*cols).unionByName(by_key(self.blocks.where("NOT running"), hit, self.hot_texts, "hash").select(*cols))

    def repaired(self) -> DataFrame:
        """origin, file_id, block_no, text (paragraphs of whole lines), changes."""
        edits = (
            self.changes().select("hash", "line", "pos", "what", "word")
            .unionByName(self.breaks().select("hash", "line", F.lit(-1).alias("pos"), F.lit("break").alias("what"), F.col("joined").cast("string").alias("word")))
            .groupBy("hash")
            .agg(F.collect_list(F.struct("line", "pos", "what", "word")).alias("edits"))
        )

        def run(batches):
            for pdf in batches:
                got = [rebuild(lines, edits) for lines, edits in zip(pdf["lines"], pdf["edits"])]
                yield pd.DataFrame({"hash": pdf["hash"], "text": [g[0] for g in got], "changes": [g[1] for g in got]})

        texts = apart(self.texts.select("hash", "lines")).join(apart(edits), "hash", "left").mapInPandas(run, "hash string, text string, changes int")
        whole = by_key(self.blocks, texts, self.hot_texts, "hash")
        return whole.select("origin", "file_id", "block_no", "text", (F.col("changes") + F.col("running").cast("int")).alias("changes"))


def _cased(was: str, word: str) -> str:
    return word.upper() if was.isupper() and len(was) > 1 else word[:1].upper() + word[1:] if was[:1].isupper() else word


def rebuild(lines, edits) -> tuple[str, int]:
    """The block's text with the edits made, broken words joined, and lines set to paragraphs (an empty line parts them)."""
    by: dict[int, list] = defaultdict(list)
    joined: dict[int, bool] = {}
    for e in edits if edits is not None else []:
        if e["what"] == "break":
            joined[int(e["line"])] = e["word"] == "true"
        else:
            by[int(e["line"])].append((int(e["pos"]), e["what"], e["word"]))
    n = sum(map(len, by.values())) + sum(joined.values())
    out, carry = "", 0
    for j, line in enumerate(lines):
        marks = list(TOKEN.finditer(line))[carry:]
        carry = 0
        for pos, what, word in sorted(by.get(j, []), reverse=True):
            if pos < len(marks):
                a = marks[pos].start()
                b = marks[pos + 1].end() if what == "torn" and pos + 1 < len(marks) else marks[pos].end()
                line = line[:a] + _cased(marks[pos].group(), word) + line[b:]
        line = line.strip()
        if j in joined:
            carry = 1
            out += line.rstrip(MARKS) if joined[j] else line
            continue
        table = re.search(r"\S {2,}\S", line) is not None
        out += line + ("\n" if not line or table else " ")
    return re.sub(r"[ \t]+\n|\n[ \t]+", "\n", re.sub(r" {2,}(?=[^\d])", " ", out)).strip(), n
