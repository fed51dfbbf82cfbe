"""Near-duplicate records with small edits: a blocked sparse product of document by n-gram incidence.

The pairs wanted are those whose sets of n-word runs (here n = 3) share at least num/den of their union and whose texts
have at least `min_words` words. The product D * D^T of the incidence matrix is taken block by block:

1. Texts with the same words form a class; a class is one row of D. The columns are ordered by how rare they are, after
   a count sketch of all n-grams of all texts (fixed size: SKETCH counters, so it may be broadcast).
2. By the sizes alone, two classes of x <= y n-grams that reach the threshold share one of the rarest x - a + 1 columns
   of the smaller and of the rarest y - a + 1 of the larger, with a = ceil(num / (num + den) * (x + y)). Only this part
   of the matrix is dealt to column blocks. A column that many texts have is split: one side is dealt by salt, the
   other copied to each salt, so no column lies in one task.
3. In a block the product's pairs are discarded by the bounds that the sizes and the places of the shared column give,
   and by 256-bit parity sketches that the rows carry: the bits that differ are a lower bound of the symmetric difference.
   Columns recur the more often the larger the corpus, so the pairs met in blocks grow faster than it; tested here, they
   are never written. The blocks are dealt in passes from rows stored once, so the sketches' copies don't lie on disk at once.
4. Of what is left, the shared n-grams are counted over the whole sets.

No step is approximate: a sketch only orders columns or bounds a difference, so no link is lost; the last step decides.

Defined results: rows with null id or text are dropped; redeliveries of an id count once; texts shorter than min_words
belong to no pair; texts of any length are used whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.words import WordHash, batch_hashes, mix
from lumenfold.session import apart, cut, drop, scratch, short_shuffles, spread

SKETCH_BITS = 22
SKETCH = 1 << SKETCH_BITS
SKETCH_BLOCKS = 64
#: A column with more texts than this (by the sketch) is split by salts.
HOT = 20_000
#: Entries of the incidence matrix that one block should hold.
BLOCK_ENTRIES = 1_500_000
#: The blocks are dealt in passes, so that only a pass's share lies on disk at once: as many as there are PASS_GRAMS n-grams, PASSES at most.
PASSES = 8
PASS_GRAMS = 6_000_000
#: Bits of an n-gram's hash, of a text's number within a batch, and of the rarity level in the sort key.
H_BITS, LEVEL_BITS = 42, 8
FILTER_BITS = 26


def _grams(texts, cache: WordHash, n: int, min_words: int):
    """Distinct n-grams per text: keys (text number << H_BITS | hash), sorted; hash of the words of each text; text numbers that count."""
    ids, counts = batch_hashes(texts, cache)
    start = np.concatenate([[0], np.cumsum(counts)])
    use = np.flatnonzero(counts >= max(min_words, n))
    # class of a text: two sums over its words that depend on the place
    place = np.arange(len(ids), dtype=np.uint64) - np.repeat(start[:-1], counts).astype(np.uint64)
    term = mix(ids ^ mix(place + np.uint64(1)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
    key = (total[start[1:]] - total[start[:-1]]).view(np.int64)
    if not len(use):
        return np.zeros(0, np.uint64), key, use
    g = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        g = mix(g + ids[k : len(ids) - n + 1 + k])
    m = counts[use] - n + 1
    at = np.repeat(start[use], m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
    return np.unique((np.repeat(use.astype(np.uint64), m) << np.uint64(H_BITS)) | (g[at] >> np.uint64(64 - H_BITS))), key, use


_MASK = np.uint64((1 << H_BITS) - 1)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64)


def _slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of a batch whose text numbers and sizes fit the sort keys."""
    step = 1 << 12
    for k in range(0, len(pdf), step):
        yield pdf.iloc[k : k + step]


def _parity(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """256-bit parity sketch per text, as 4 signed longs."""
    bit = np.uint64(1) << ((h >> np.uint64(8)) & np.uint64(63))
    lane = ((h >> np.uint64(14)) & np.uint64(3)).astype(np.int64)
    out = np.zeros((len(starts), 4), dtype=np.uint64)
    for k in range(4):
        out[:, k] = np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), starts)
    return out.view(np.int64)


SURVEY = "kind int, id long, key long, part int, task int, payload binary"
#: Shares of tasks that are added up at once.
FAN = 64


def _survey(n: int, min_words: int):
    """First reading: a row per text (its class) and the task's share of the count sketch."""

    def run(batches):
        cache, counts = WordHash(), np.zeros(SKETCH, dtype=np.int64)
        for whole in batches:
            for pdf in _slices(whole):
                g, key, use = _grams(pdf["text"].tolist(), cache, n, min_words)
                if not len(use):
                    continue
                counts += np.bincount(_slot(g & _MASK), minlength=SKETCH)
                yield pd.DataFrame({"kind": 0, "id": pdf["id"].to_numpy()[use], "key": key[use], "part": None, "task": None, "payload": None})
        if counts.any():
            yield pd.DataFrame(
                {"kind": 1, "id": None, "key": None, "part": range(SKETCH_BLOCKS), "task": TaskContext.get().partitionId(), "payload": [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SKETCH_BLOCKS)]}
            )

    return run


def _in_levels(shares: DataFrame, add) -> dict[int, bytes]:
    """part, task, payload (compressed): the shares of all tasks added up, FAN at a time, level by level, so no task gets more
    than FAN of them however many tasks there were. SKETCH_BLOCKS parts of a fixed size come to the driver."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = add([zlib.decompress(x) for x in pdf["payload"]])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "task": [pdf["task"].iloc[0] // FAN], "payload": [zlib.compress(total, 1)]})

    tasks = (shares.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        shares = shares.groupBy("part", F.floor(F.col("task") / FAN).alias("_up")).applyInPandas(run, "part int, task int, payload binary")
        if tasks <= FAN:
            return {r.part: zlib.decompress(bytes(r.payload)) for r in shares.select("part", "payload").collect()}
        tasks = -(-tasks // FAN)


def _levels(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Rarity levels of the sketch's counters, 255 at most, and how many make a doubling: 12, or fewer where the greatest
    count asks for it, so no count is beyond the last level."""
    fine = min(12.0, 255 / math.log2(int(counts.max(initial=0)) + 2))
    return np.minimum(255, np.round(fine * np.log2(counts + 1.0))).astype(np.uint8), fine


def _salts(fine: float) -> np.ndarray:
    """Salts per level."""
    return 1 + np.floor((2.0 ** (np.arange(256) / fine) - 1) / HOT).astype(np.int64)


def _ceil(a, num: int, den: int):
    return (a * num + den - 1) // den


STORE = "texts int, entries int, payload binary"


def _rows(n: int, min_words: int, num: int, den: int, levels):
    """Second reading: class, size, parity sketch and the rare part of each row of the matrix, rarest column first."""

    def run(batches):
        cache, level_of = WordHash(), np.frombuffer(zlib.decompress(levels.value), dtype=np.uint8)
        for whole in batches:
            for pdf in _slices(whole):
                g, key, use = _grams(pdf["text"].tolist(), cache, n, min_words)
                if not len(use):
                    continue
                h, doc = g & _MASK, g >> np.uint64(H_BITS)
                level = level_of[_slot(h)].astype(np.uint64)
                s = np.sort((doc << np.uint64(H_BITS + LEVEL_BITS)) | (level << np.uint64(H_BITS)) | h)
                doc = (s >> np.uint64(H_BITS + LEVEL_BITS)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                size = np.diff(np.concatenate([starts, [len(s)]]))
                bits = _parity(h, starts)
                names = key[doc[starts]]
                _, first = np.unique(names, return_index=True)  # copies in the same slice are dealt once
                single = np.zeros(len(names), dtype=bool)
                single[first] = True
                row = np.repeat(np.arange(len(starts)), size)
                keep = np.flatnonzero((np.arange(len(s)) - starts[row] < _probe(size, num, den)[row]) & single[row])
                s = s[keep] & np.uint64((1 << (H_BITS + LEVEL_BITS)) - 1)
                raw = names[single].astype(np.int64).tobytes() + size[single].astype(np.uint32).tobytes() + bits[single].tobytes()
                yield pd.DataFrame({"texts": [int(single.sum())], "entries": [len(s)], "payload": [raw + s.view(np.uint8).reshape(-1, 8)[:, : (H_BITS + LEVEL_BITS + 7) // 8].tobytes()]})

    return run


def _probe(size, num: int, den: int):
    """Columns of a row by which it may meet a row of at most its size."""
    return size - _ceil(size, num, den) + 1


def _deal(num: int, den: int, fine: float, blocks: int, passes: int, turn: int):
    """The stored rows' entries, dealt to the column blocks of one pass."""
    width = (H_BITS + LEVEL_BITS + 7) // 8

    def run(batches):
        salts_of = _salts(fine)
        for pdf in batches:
            for texts, entries, payload in zip(pdf["texts"], pdf["entries"], pdf["payload"]):
                names = np.frombuffer(payload, dtype=np.int64, count=texts)
                size = np.frombuffer(payload, dtype=np.uint32, count=texts, offset=8 * texts).astype(np.int64)
                bits = np.frombuffer(payload, dtype=np.int64, count=4 * texts, offset=12 * texts).reshape(-1, 4)
                s = np.zeros((entries, 8), dtype=np.uint8)
                s[:, :width] = np.frombuffer(payload, dtype=np.uint8, count=entries * width, offset=44 * texts).reshape(-1, width)
                s = s.view(np.uint64).ravel()
                h, level = s & _MASK, (s >> np.uint64(H_BITS)).astype(np.int64)
                held = _probe(size, num, den)
                row = np.repeat(np.arange(texts), held)
                pos = np.arange(entries) - np.repeat(np.cumsum(held) - held, held)
                salts = salts_of[level]
                # as a probe: one salt, by the class; as an index entry: each salt
                own = names[row] % salts
                is_index = pos < (size - _ceil(2 * size, num, num + den) + 1)[row]
                copies = np.where(is_index, salts, 1)
                e = np.repeat(np.arange(entries), copies)
                salt = np.where(is_index[e], np.arange(len(e)) - np.repeat(np.cumsum(copies) - copies, copies), own[e])
                block = (mix(h[e] + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(blocks)).astype(np.int64)
                mine = np.flatnonzero(block % passes == turn)
                e, salt, block = e[mine], salt[mine], block[mine]
                side = (salt == own[e]).astype(np.uint8) + 2 * is_index[e].astype(np.uint8)  # 1: probe, 2: index, 3: both
                token = (h[e] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                o = np.lexsort((token, block))
                e, block, token, side = e[o], block[o], token[o], side[o]
                cutp = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(e) else np.zeros(1, int)
                out = []
                for a, b in zip(cutp[:-1], cutp[1:]):
                    rows, local = np.unique(row[e[a:b]], return_inverse=True)
                    parts = [
                        np.diff(token[a:b], prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), size[rows].astype(np.uint32).tobytes(),
                        local.astype(np.uint16).tobytes(), pos[e[a:b]].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), side[a:b].tobytes(),
                    ]
                    # names and sketches are as good as random: not compressed
                    out.append((int(block[a]) // passes, len(rows), b - a, names[rows].tobytes() + bits[rows].tobytes() + zlib.compress(b"".join(parts), 1)))
                yield pd.DataFrame(out, columns=["block", "rows", "entries", "payload"])

    return run


def _unpack(rows: int, entries: int, payload: bytes):
    names = np.frombuffer(payload, dtype=np.int64, count=rows)
    bits = np.frombuffer(payload, dtype=np.uint64, count=4 * rows, offset=8 * rows).reshape(-1, 4)
    b = zlib.decompress(memoryview(payload)[40 * rows :])
    at = 0

    def take(count, kind):
        nonlocal at
        out = np.frombuffer(b, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    token = np.cumsum(np.ascontiguousarray(take(entries * 4, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)
    size, local = take(rows, np.uint32), take(entries, np.uint16)
    pos = np.ascontiguousarray(take(entries * 4, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return names, size, token, local, pos, take(entries, np.uint8), bits


#: Products formed at once in a block.
STEP = 3_000_000


def _product(num: int, den: int):
    """A column block times its transpose, cut by the bounds of sizes, places and parity sketches: pairs (a, b), each once per block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(*x) for x in zip(pdf["rows"], pdf["entries"], pdf["payload"])]
        names = np.concatenate([p[0] for p in parts])
        size = np.concatenate([p[1] for p in parts]).astype(np.int64)
        shift = np.cumsum([0] + [len(p[0]) for p in parts])
        token = np.concatenate([p[2] for p in parts])
        row = np.concatenate([p[3].astype(np.int64) + s for p, s in zip(parts, shift)])
        pos = np.concatenate([p[4] for p in parts]).astype(np.int64)
        side = np.concatenate([p[5] for p in parts])
        bits = np.concatenate([p[6] for p in parts])
        del parts
        p = np.flatnonzero(side & 1)
        p = p[np.argsort(token[p], kind="stable")]
        i = np.flatnonzero(side & 2)
        lo, hi = np.searchsorted(token[p], token[i], "left"), np.searchsorted(token[p], token[i], "right")
        many = np.cumsum(hi - lo)
        found, k = [], 0
        while k < len(i):
            e = max(k + 1, int(np.searchsorted(many, (many[k - 1] if k else 0) + STEP)))
            c = (hi - lo)[k:e]
            x = np.repeat(i[k:e], c)
            y = p[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[k:e], c)]
            k = e
            rx, ry = row[x], row[y]
            sx, sy = size[rx], size[ry]
            a = _ceil(sx + sy, num, num + den)
            ok = (sx <= sy) & (sx * den >= sy * num) & (1 + np.minimum(sx - pos[x] - 1, sy - pos[y] - 1) >= a)
            rx, ry, sx, sy = rx[ok], ry[ok], sx[ok], sy[ok]
            ka, kb = names[rx], names[ry]
            ok = np.flatnonzero(np.where(sx == sy, ka < kb, ka != kb))
            # symmetric difference of sets that reach num/den: at most (den - num) / (den + num) of both sizes
            differ = np.bitwise_count(bits[rx[ok]] ^ bits[ry[ok]]).sum(axis=1, dtype=np.int64)
            ok = ok[differ * (den + num) <= (sx[ok] + sy[ok]) * (den - num)]
            found.append(np.unique(np.stack([np.minimum(ka, kb)[ok], np.maximum(ka, kb)[ok]], 1), axis=0) if len(ok) else np.zeros((0, 2), np.int64))
        f = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": f[:, 0], "b": f[:, 1]})

    return run


def _sets(n: int, min_words: int, wanted):
    """Third reading: whole sets of n-grams, of texts that stand in a surviving pair."""

    def run(batches):
        cache, bits = WordHash(), np.frombuffer(zlib.decompress(wanted.value), dtype=np.uint8)
        for pdf in batches:
            at = _filter_at(pdf["id"].to_numpy())
            pdf = pdf[(bits[at >> 3] >> (at & 7)) & 1 == 1]
            for part in _slices(pdf):
                g, key, use = _grams(part["text"].tolist(), cache, n, min_words)
                if not len(use):
                    continue
                doc = (g >> np.uint64(H_BITS)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                yield pd.DataFrame({"id": part["id"].to_numpy()[use], "grams": np.split((g & _MASK).astype(np.int64), starts[1:])})

    return run


def _filter_at(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _id_filter(ids: DataFrame) -> bytes:
    """A one-hash filter of fixed size (2**FILTER_BITS bits) over column id; full, it lets more through, never less."""

    def fill(batches):
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for pdf in batches:
            bits[_filter_at(pdf["id"].to_numpy())] = True
        if bits.any():
            yield pd.DataFrame({"part": range(SKETCH_BLOCKS), "task": TaskContext.get().partitionId(), "payload": [zlib.compress(np.packbits(x, bitorder="little").tobytes(), 1) for x in np.split(bits, SKETCH_BLOCKS)]})

    shares = cut(ids.mapInPandas(fill, "part int, task int, payload binary"))
    parts = _in_levels(shares, lambda x: np.bitwise_or.reduce([np.frombuffer(y, dtype=np.uint8) for y in x]).tobytes())
    empty = bytes((1 << FILTER_BITS) // 8 // SKETCH_BLOCKS)
    return zlib.compress(b"".join(parts.get(k, empty) for k in range(SKETCH_BLOCKS)), 1)


def class_pairs(docs: DataFrame, id_col: str, text_col: str, n: int = 3, num: int = 3, den: int = 5, min_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, shared, united) of different classes that reach num/den; members (key, id) of every class."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    texts = spread(texts)
    path = scratch(spark, "ngram-survey")
    texts.mapInPandas(_survey(n, min_words), SURVEY).write.parquet(path)
    survey = spark.read.schema(SURVEY).parquet(path)
    members = survey.where("kind = 0").select("key", "id").distinct()
    parts = _in_levels(survey.where("kind = 1").select("part", "task", "payload"), lambda x: sum(np.frombuffer(y, dtype=np.int64) for y in x).tobytes())
    counts = np.concatenate([np.frombuffer(parts[k], dtype=np.int64) if k in parts else np.zeros(SKETCH // SKETCH_BLOCKS, np.int64) for k in range(SKETCH_BLOCKS)])
    level, fine = _levels(counts)
    levels = spark.sparkContext.broadcast(zlib.compress(level.tobytes(), 1))
    total = int(counts.sum())
    passes = min(PASSES, max(1, math.ceil(total / PASS_GRAMS)))
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 0.65 / BLOCK_ENTRIES), passes * spark.sparkContext.defaultParallelism)
    kept, near = scratch(spark, "ngram-rows"), scratch(spark, "ngram-near")
    texts.mapInPandas(_rows(n, min_words, num, den, levels), STORE).write.parquet(kept)
    rare = spark.read.schema(STORE).parquet(kept)
    for turn in range(passes):
        dealt = rare.mapInPandas(_deal(num, den, fine, blocks, passes, turn), "block int, rows int, entries int, payload binary")
        # a task per block: blocks are large, so tasks aren't put together
        found = dealt.repartitionById(-(-blocks // passes), "block").groupBy("block").applyInPandas(_product(num, den), "a long, b long")
        with short_shuffles(spark):
            found.write.mode("append").parquet(near)
    drop(spark, kept)
    # a pair may come from several blocks; few are left here
    reps = members.groupBy("key").agg(F.min("id").alias("rep"))
    rep = lambda s: reps.select(F.col("key").alias(s), F.col("rep").alias(f"rep_{s}"))
    left = spark.read.schema("a long, b long").parquet(near).distinct()
    left = cut(apart(left).join(apart(rep("a")), "a").join(apart(rep("b")), "b"))
    ids = left.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    wanted = spark.sparkContext.broadcast(_id_filter(ids))
    sets = texts.mapInPandas(_sets(n, min_words, wanted), "id long, grams array<long>").dropDuplicates(["id"])
    s = lambda x: sets.select(F.col("id").alias(f"rep_{x}"), F.col("grams").alias(f"grams_{x}"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    pairs = (
        apart(left).join(apart(s("a")), "rep_a").join(apart(s("b")), "rep_b")
        .select("a", "b", shared.alias("shared"), (F.size("grams_a") + F.size("grams_b")).alias("both"))
        .select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("united"))
        .where(F.col("shared") * den >= F.col("united") * num)
    )
    return pairs, members


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids, a < b: of different classes that are linked, and of the same class."""
    m = lambda k, i: members.select(F.col("key").alias(k), F.col("id").alias(i))
    across = apart(pairs.select("a", "b")).join(apart(m("a", "x")), "a").join(apart(m("b", "y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    copied = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    twins = apart(members).join(apart(copied), "key")
    same = apart(twins.select("key", F.col("id").alias("a"))).join(apart(twins.select("key", F.col("id").alias("b"))), "key").where("a < b").select("a", "b")
    return across.unionByName(same).distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: id, class_id, links (linked classes), group_id (least class id that links reach).

    Labels are lowered by neighbours and by jumping to the label's own label, so rounds grow as the logarithm of a
    chain; each round's labels are checkpointed to the shared folder."""
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.select(F.col("a").alias("k")).distinct().withColumn("l", F.col("k")))
    while True:
        near = apart(edges).join(apart(labels), edges["b"] == labels["k"]).groupBy("a").agg(F.min("l").alias("m"))
        low = apart(labels).join(apart(near), labels["k"] == near["a"], "left").select("k", "l", F.least("l", F.coalesce("m", "l")).alias("m"))
        jump = labels.select(F.col("k").alias("m"), F.col("l").alias("j"))
        new = cut(apart(low).join(apart(jump), "m", "left").select("k", F.col("l").alias("old"), F.least("m", F.coalesce("j", "m")).alias("l")))
        moved = new.where("old <> l").limit(1).count()
        labels = new.select("k", "l")
        if not moved:
            break
    links = edges.groupBy("a").agg(F.count("*").alias("links"))
    return (
        apart(members).join(apart(labels), members["key"] == labels["k"], "left")
        .join(apart(links), members["key"] == links["a"], "left")
        .select("id", F.col("key").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("l", "key").alias("group_id"))
    )
