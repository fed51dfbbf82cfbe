"""Most similar vectors for every vector: a block matrix join over int8 tiles.

Vectors of one group (same model, same length) are dealt to blocks by a hash of their class; a tile is a pair of blocks and a
task of its own. A block's rows are quantised to int8, each with its scale; a tile multiplies the int8 images (as whole numbers, which
the floating-point multiplier adds up exactly), and the norm of the rows' quantisation errors bounds how far a product may lie
from the true cosine. The product is formed on the tile's leading axes only, as many as are cheapest; the norms of what is left
of both rows bound the rest, so a pair that this excludes can't reach the floor. Pairs that can't reach the floor, or can't be among the k best of either row, by these bounds are
dropped; the others are computed again in double precision. Each row keeps its k best in a bounded heap, which a pair enters
only by beating its least; the tiles' heaps are merged by a top-k window that keeps k rows per key before it shuffles.

Blocks are as large as lets the tiles occupy the cluster, between LEAST_ROWS and what CELLS allows, so a block is copied to
few tiles; the size changes no result.

Identical vectors form a class that enters the product once, with its k + 1 least ids; so a crowd of copies costs one
row. Ties go to the smaller id. Results are exact: bounds decide nothing but what is computed again.

Defined results: a vector is usable if not null, as long as its stated length, all finite and not all zero; others and
rows with null id or group are left out; of several rows of an id that with the least group, length and vector counts; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import apart, cut

#: Rows of a block, at least, and its numbers, at most.
LEAST_ROWS = 2048
CELLS = 1 << 22
SUB = 1024
#: Pairs computed in double precision at once.
STEP = 100_000
#: What computing a pair again costs, as a multiple of one dimension in the product.
DOUBT = 7000


def usable(df: DataFrame, id_col: str, group_col: str, dims_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    zero = F.lit(0.0).cast("float")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        df.where(F.col(id_col).isNotNull() & F.col(group_col).isNotNull() & v.isNotNull() & (F.size(v) == F.col(dims_col)))
        .where(finite & F.exists(v, lambda x: x != zero))
        .select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(group_col).alias("grp"), F.size(v).alias("dims"), v.cast("array<float>").alias("vec")).alias("x"))
        .groupBy("id")
        .agg(F.min("x").alias("x"))
        .select("id", "x.*")
    )


PACKED = "grp string, dims int, block int, rows int, payload binary"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    m = np.stack(pdf["vec"].to_numpy()).astype(np.float32)
    planes = m.view(np.uint8).reshape(-1, 4).T.tobytes()
    return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "dims": [int(m.shape[1])], "block": [int(pdf["block"].iloc[0])], "rows": [len(m)], "payload": [zlib.compress(pdf["cls"].to_numpy().astype(np.int64).tobytes() + planes, 1)]})


def _unpack(rows: int, dims: int, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = zlib.decompress(payload)
    planes = np.frombuffer(b, dtype=np.uint8, offset=rows * 8).reshape(4, -1)
    return np.frombuffer(b, dtype=np.int64, count=rows), np.ascontiguousarray(planes.T).view(np.float32).reshape(rows, dims)


def unit(m: np.ndarray) -> np.ndarray:
    """Unit rows in double precision."""
    x = m.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # no overflow in the norm
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return x


def _image(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """int8 images of rows; the rows' scales; the greatest norm of a row's quantisation error."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-6) / 127.0
    image = np.rint(x / scale[:, None]).astype(np.int8)
    return image, scale, float(np.sqrt(((x - image * scale[:, None]) ** 2).sum(axis=1)).max())


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Unit rows in double precision; their int8 images; the rows' scales; the greatest norm of a row's quantisation error."""
    x = unit(m)
    return x, *_image(x)


def _axes(xa: np.ndarray, xb: np.ndarray, floor: float) -> np.ndarray | None:
    """Orthonormal axes (columns) on which the product is cheapest: few, yet so many that the parts beyond them seldom leave a
    pair in doubt. None: all dimensions. A choice of cost only, made on a sample."""
    d = xa.shape[1]
    if floor <= 0 or d < 16:
        return None
    if d <= 256:
        axes = np.linalg.eigh(xa.T @ xa + xb.T @ xb)[1][:, ::-1]
    else:
        start = np.random.default_rng(0).normal(size=(d, 128))
        axes = np.linalg.qr(xa.T @ (xa @ start) + xb.T @ (xb @ start))[0]
    a, b = (x[:: max(1, len(x) // n)][:n] @ axes for x, n in ((xa, 128), (xb, 256)))
    product, ra, rb, best, least = 0.0, np.ones(len(a)), np.ones(len(b)), None, float(d)
    for m in range(8, axes.shape[1] + 1, 8):
        p, q = a[:, m - 8 : m], b[:, m - 8 : m]
        product, ra, rb = product + p @ q.T, ra - (p * p).sum(axis=1), rb - (q * q).sum(axis=1)
        doubt = np.sqrt(np.maximum(ra, 0))[:, None] * np.sqrt(np.maximum(rb, 0))
        cost = m + 2 + DOUBT * np.count_nonzero(product + doubt >= floor - 0.02) / product.size
        if cost < least:
            best, least = m, cost
    return None if best is None else np.ascontiguousarray(axes[:, :best])


def _bounds(xa: np.ndarray, xb: np.ndarray, axes: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose product is negative for no pair that reaches the floor: int8 images on the axes, and two columns. With P the
    part on the axes and R the rest, x * y <= Px * Py + |Rx| |Ry|; the last column brings the floor, over both rows' scales."""
    pa, pb = xa @ axes, xb @ axes
    (qa, sa, ea), (qb, sb, eb) = _image(pa), _image(pb)
    rest = lambda x, p: np.sqrt(np.maximum(((x - p @ axes.T) ** 2).sum(axis=1), 0.0))
    slack = ea * (1 + eb) + eb + 1e-5 + 4e-7 * axes.shape[1]  # the last two: rounding of single precision
    left = np.concatenate([qa, (rest(xa, pa) / sa)[:, None], ((slack - floor) / sa)[:, None]], axis=1)
    right = np.concatenate([qb, (rest(xb, pb) / sb)[:, None], (1 / sb)[:, None]], axis=1)
    return left.astype(np.float32), right.astype(np.float32)


def _best(x: np.ndarray, y: np.ndarray, c: np.ndarray, names: np.ndarray, k: int):
    """The k greatest c of each x; ties to the smaller name of y."""
    o = np.lexsort((names[y], -c, x))
    x, y, c = x[o], y[o], c[o]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    at = np.arange(len(x)) - np.repeat(first, np.diff(np.concatenate([first, [len(x)]])))
    keep = at < k
    return x[keep], y[keep], c[keep]


class _Heaps:
    """The k best found so far of each row of a block. `least`: what a further pair must reach, once a row holds k."""

    def __init__(self, rows: int, k: int):
        self.k, self.x, self.y, self.c = k, np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        self.least = np.full(rows, -np.inf)

    def add(self, x, y, c, names) -> None:
        ok = c >= self.least[x]  # an equal one may have the smaller name
        if not ok.any():
            return
        self.x, self.y, self.c = _best(np.concatenate([self.x, x[ok]]), np.concatenate([self.y, y[ok]]), np.concatenate([self.c, c[ok]]), names, self.k)
        last = np.flatnonzero(np.concatenate([self.x[1:] != self.x[:-1], [True]]))
        held = np.diff(np.concatenate([[-1], last]))
        full = last[held == self.k]
        self.least[self.x[full]] = self.c[full]


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of the products that aren't negative, formed in pieces that stay in a core's cache; None: more than STEP."""
    xs, ys, many = [], [], 0
    for i in range(0, len(a), SUB // 4):
        for j in range(0, len(b), 2 * SUB):
            g = a[i : i + SUB // 4] @ b[j : j + 2 * SUB].T
            at = np.flatnonzero(g >= 0)
            many += len(at)
            if many > STEP:
                return None
            xs.append(at // g.shape[1] + i)
            ys.append(at % g.shape[1] + j)
    return np.concatenate(xs), np.concatenate(ys)


def _tile(names_a, m_a, names_b, m_b, k: int, floor: float) -> pd.DataFrame:
    """x, y, c: each row's k best of the other block (or of its own, if m_b is None)."""
    same = m_b is None
    xa = unit(m_a)
    xb = xa if same else unit(m_b)
    if same:
        names_b = names_a
    left, right = _Heaps(len(xa), k), _Heaps(len(xb), k)
    axes = _axes(xa, xb, floor)
    few = None if axes is None else _bounds(xa, xb, axes, floor)
    whole = None
    held: list[tuple] = []

    def flush() -> None:
        if not held:
            return
        a, b, c = map(np.concatenate, zip(*held))
        held.clear()
        if same:
            left.add(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([c, c]), names_b)
        else:
            left.add(a, b, c, names_b)
            right.add(b, a, c, names_a)

    for i in range(0, len(xa), SUB):
        for j in range(i if same else 0, len(xb), 4 * SUB):
            at = few and _reach(few[0][i : i + SUB], few[1][j : j + 4 * SUB])
            if at:
                x, y = at
            else:
                if whole is None:
                    (qa, sa, ea), (qb, sb, eb) = whole = _image(xa), _image(xb)
                    # products of whole numbers: their sums stay below 2**24 up to 1,040 dimensions, beyond that rounding is allowed for
                    slack = ea * (1 + eb) + eb + 1e-5 + 1e-7 * max(0, xa.shape[1] - 1040)
                    sa, sb, fb = sa.astype(np.float32)[:, None], sb.astype(np.float32), qb.astype(np.float32)
                g = qa[i : i + SUB].astype(np.float32) @ fb[j : j + 4 * SUB].T
                g *= sb[j : j + 4 * SUB]
                g *= sa[i : i + SUB]
                hit = g >= floor - slack
                if floor <= -1 or np.count_nonzero(hit) > STEP:
                    # rows that k others beat for certain needn't be computed again
                    if g.shape[1] > k:
                        row = np.partition(g, g.shape[1] - k - 1, axis=1)[:, g.shape[1] - k - 1] - 2 * slack
                    else:
                        row = np.full(g.shape[0], -np.inf)
                    if g.shape[0] > k:
                        col = np.partition(g, g.shape[0] - k - 1, axis=0)[g.shape[0] - k - 1] - 2 * slack
                    else:
                        col = np.full(g.shape[1], -np.inf)
                    hit &= (g >= row[:, None]) | (g >= col[None, :])
                x, y = np.nonzero(hit)
            x, y = x + i, y + j
            if same:
                ok = x < y
                x, y = x[ok], y[ok]
            for s in range(0, len(x), STEP):
                a, b = x[s : s + STEP], y[s : s + STEP]
                c = np.minimum(1.0, np.einsum("ij,ij->i", xa[a], xb[b]))
                ok = c >= floor
                held.append((a[ok], b[ok], c[ok]))
                if sum(len(h[0]) for h in held) > STEP:
                    flush()
    flush()
    out = [pd.DataFrame({"x": names_a[left.x], "y": names_b[left.y], "c": left.c})]
    if not same:
        out.append(pd.DataFrame({"x": names_b[right.x], "y": names_a[right.y], "c": right.c}))
    return pd.concat(out)


def _tiles(k: int, floor: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [_unpack(r.rows, r.dims, r.payload) for r in pdf.sort_values("block").itertuples()]
        out = _tile(*sides[0], *(sides[1] if len(sides) > 1 else (None, None)), k, floor)
        out["grp"], out["dims"] = pdf["grp"].iloc[0], int(pdf["dims"].iloc[0])
        return out

    return run


def neighbours(df: DataFrame, id_col: str = "chunk_id", group_col: str = "model_id", dims_col: str = "dims", vector_col: str = "vector", k: int = 5, floor: float = 0.82, rows: int | None = None) -> DataFrame:
    """grp, id, place (1..k), other, cosine: for every usable vector its k most similar of the same group, cosine >= floor."""
    good = usable(df, id_col, group_col, dims_col, vector_col)
    key = ["grp", "dims", "h1", "h2"]
    hashed = good.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.hash("vec"))
    # class: named by its least id; first: its k + 1 least ids
    least = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    few = hashed.select(*key, "id").withColumn("n", least).where(F.col("n") <= k + 1)
    classes = few.groupBy(*key).agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("first"))
    members = apart(hashed.select(*key, "id")).join(apart(classes.select(*key, "cls")), key).select("grp", "dims", "id", "cls")
    cores = good.sparkSession.sparkContext.defaultParallelism
    most = F.greatest(F.lit(1024), F.floor(F.lit(CELLS) / F.col("dims")))
    wide = F.lit(rows) if rows else F.least(most, F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("n") / math.ceil(math.sqrt(2 * cores)))))
    sizes = cut(classes.groupBy("grp", "dims").agg(F.count("*").alias("n")).select("grp", "dims", F.ceil(F.col("n") / wide).cast("int").alias("blocks")))
    tasks = int(sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1)
    sizes = F.broadcast(sizes)  # a row per model and length
    reps = apart(good).join(apart(classes.select("grp", "dims", F.col("cls").alias("id"))), ["grp", "dims", "id"]).withColumnRenamed("id", "cls")
    packed = (
        reps.join(sizes, ["grp", "dims"])
        .withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
        .select("grp", "dims", "block", "cls", "vec")
        .groupBy("grp", "dims", "block")
        .applyInPandas(_pack, PACKED)
        .join(sizes, ["grp", "dims"])
    )
    tiles = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp", "dims", "block", "rows", "payload", F.least("block", "o").alias("ti"), F.greatest("block", "o").alias("tj")
    )
    # tiles are few and costly: dealt to as many tasks as there are tiles, twice over for a hash's unevenness, and not put together
    spread = tiles.repartition(min(max(2 * tasks, cores), 20_000), "grp", "dims", "ti", "tj")
    near = spread.groupBy("grp", "dims", "ti", "tj").applyInPandas(_tiles(k, floor), "x long, y long, c double, grp string, dims int")
    top = lambda d, *by: d.withColumn("n", F.row_number().over(Window.partitionBy("grp", "dims", "x").orderBy(F.col("c").desc(), *by))).where(F.col("n") <= k)
    best = top(near, "y").select("grp", "dims", "x", "y", "c")
    # classes to ids: of each near class the first ids, and the copies in the own class
    firsts = classes.select("grp", "dims", F.col("cls").alias("y"), "first")
    others = apart(best).join(apart(firsts), ["grp", "dims", "y"]).select("grp", "dims", "x", "c", F.explode("first").alias("other"))
    if floor <= 1:
        own = firsts.where(F.size("first") > 1).select("grp", "dims", F.col("y").alias("x"), F.lit(1.0).alias("c"), F.explode("first").alias("other"))
        others = others.unionByName(own)
    short = others.withColumn("n", F.row_number().over(Window.partitionBy("grp", "dims", "x").orderBy(F.col("c").desc(), "other"))).where(F.col("n") <= k + 1).drop("n")
    each = apart(members.withColumnRenamed("cls", "x")).join(apart(short), ["grp", "dims", "x"]).where(F.col("id") != F.col("other"))
    place = F.row_number().over(Window.partitionBy("grp", "dims", "id").orderBy(F.col("c").desc(), "other"))
    return each.withColumn("place", place).where(F.col("place") <= k).select("grp", "id", "place", "other", F.col("c").alias("cosine"))


def neighbour_pairs(lists: DataFrame) -> DataFrame:
    """Pairs a < b of which at least one is a neighbour of the other."""
    return lists.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
