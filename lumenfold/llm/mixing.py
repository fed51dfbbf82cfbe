"""Mixing sources to target weights: temperature mixing with repetition caps, realised by budgeted block permutations.

Sizes are tokens of a public tokenizer. The weights are the sources' own shares of all tokens, exponentiated towards the
targets: natural^(1 - t) * target^t, normalised over the sources that have tokens (t = 1 are the targets, t = 0 the corpus as
it is). The exponent is the greatest in 0..1 at which no source needs more repetitions than its cap for the budget and the
weights' entropy reaches the goal, if one is set; it's bracketed on a grid and bisected. Without a budget the mix is made as
large as the caps allow at the exponent found: min over sources of cap * tokens / weight. Each source then gives whole copies
of itself and, for the rest, the records of a permutation's beginning: records are permuted by a hash, dealt to BLOCKS blocks, whole blocks are taken while
they fit, and the block at the border is filled record by record. So no source is gathered in one task, and a source that
holds a third of all rows is spread like any other.

Defined results: source names are compared trimmed and lower-cased; null names and sources without target are left out and
reported by their absence; a target source without tokens has weight 0 and its share goes to the others in proportion;
null or empty texts have 0 tokens and are left out; an empty corpus gives an empty mix; where no exponent reaches the goals,
the one of greatest entropy counts and the budget is lowered to the caps.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import apart, spread

#: Fixed value: the pre-tokenizer pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCKS = 4096


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters after which a very long text is cut at the next border of pre-tokens.
PIECE = 200_000
_BORDER = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """A text cut where the pre-tokenizer parts it in any case: before a single blank between two signs that aren't blank."""
    out, pos = [], 0
    while len(text) - pos > PIECE:
        m = _BORDER.search(text, pos + PIECE)
        if m is None:
            break
        out.append(text[pos : m.start()])
        pos = m.start()
    return [*out, text[pos:]]


def token_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, source (trimmed, lower-cased), n: tokens of each record's whole text. The vocabulary file is read on the driver and
    sent to the tasks (a fixed size)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.trim(F.col(source_col))).alias("source"), F.col(text_col).alias("text")).where("id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
    with open(tokenizer, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc = _encoding(vocabulary.value)
        for pdf in batches:
            n = [sum(map(len, enc.encode_ordinary_batch(pieces(t), num_threads=1))) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "n": n})

    return spread(rows).mapInPandas(run, "id long, source string, n long").where("n > 0")


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def weights(natural: dict[str, float], target: dict[str, float], cap: dict[str, float], budget: float | None = None, least_entropy: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weight of each source with tokens, exponent, budget)."""
    have = [s for s in target if natural.get(s, 0) > 0 and target[s] > 0]
    if not have:
        return {}, 1.0, 0.0
    total = sum(natural[s] for s in have)

    def at(t: float) -> dict[str, float]:
        raw = {s: (natural[s] / total) ** (1 - t) * target[s] ** t for s in have}
        z = sum(raw.values())
        return {s: w / z for s, w in raw.items()}

    room = lambda w: min(cap[s] * natural[s] / w[s] for s in have)

    def reached(t: float) -> bool:
        w = at(t)
        return (budget is None or budget <= room(w) * (1 + 1e-12)) and (least_entropy is None or entropy(w) >= least_entropy - 1e-12)

    grid = [k / 64 for k in range(64, -1, -1)]
    lo = next((t for t in grid if reached(t)), None)
    if lo is None:
        lo = max(grid, key=lambda t: entropy(at(t)))
    elif lo < 1:
        hi = lo + 1 / 64
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if reached(mid) else (lo, mid)
    w = at(lo)
    return w, lo, room(w) if budget is None else min(budget, room(w))


def mix(counts: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 7, least_entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, report). records: id, source, n, copies. report: a row per target source with its tokens, target share,
    weight aimed at, tokens and share reached, repetitions and exponent. targets: source, target_share, max_repeats."""
    spark = counts.sparkSession
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("t"), F.max("max_repeats").alias("r"))
    plan = {r.source: r for r in wanted.collect()}  # one row per target source
    placed = counts.join(F.broadcast(wanted.select("source")), "source", "left_semi").withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("block", F.pmod(F.xxhash64("h"), F.lit(BLOCKS)))
    sizes = placed.groupBy("source", "block").agg(F.sum("n").alias("bn"))
    natural = {r.source: float(r.n) for r in sizes.groupBy("source").agg(F.sum("bn").alias("n")).collect()}
    w, exponent, budget = weights(natural, {s: float(r.t) for s, r in plan.items()}, {s: float(r.r) for s, r in plan.items()}, budget, least_entropy)
    rows = []
    for s, r in plan.items():
        give = w.get(s, 0.0) * budget
        n = natural.get(s, 0.0)
        whole = int(give // n + 1e-9) if n else 0
        rows.append((s, float(r.t), int(r.r), n, w.get(s, 0.0), whole, give - whole * n if n else 0.0, exponent))
    goal = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens double, weight double, whole int, rest double, exponent double")
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.withColumn("before", F.coalesce(F.sum("bn").over(before), F.lit(0))).join(F.broadcast(goal.select("source", "whole", "rest")), "source")  # a row per target source
    inside = Window.partitionBy("source", "block").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    full = apart(placed).join(apart(blocks), ["source", "block"])
    border = full.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bn") > F.col("rest")))
    taken = border.withColumn("upto", F.col("before") + F.sum("n").over(inside)).withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int"))
    others = full.where(~((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bn") > F.col("rest")))).withColumn("extra", (F.col("before") + F.col("bn") <= F.col("rest")).cast("int"))
    cols = ["id", "source", "n", (F.col("whole") + F.col("extra")).alias("copies")]
    records = others.select(*cols).unionByName(taken.select(*cols))
    reached = records.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("mixed_tokens"))
    total = reached.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = (
        goal.join(reached, "source", "left").crossJoin(total)  # one row
        .select("source", "target_share", "max_repeats", F.col("tokens").cast("long").alias("tokens"), "weight", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
                F.try_divide(F.coalesce("mixed_tokens", F.lit(0)), "all_tokens").alias("share"), F.try_divide(F.coalesce("mixed_tokens", F.lit(0)), "tokens").alias("repeats"), "exponent")
    )
    return records.where("copies > 0"), report
