"""One ranking from several differently-scaled scores, by reciprocal rank fusion.

Each list is ranked anew within its group (position = 1 + how many rows of the group have a better rank in that list;
ties share a position), each row gets sum(1 / (k + position)) over the lists that hold it, and rows are sorted by that
total. Only order enters, so no list prevails by its range.

Positions come from a histogram: (group, list, rank value) counts are added up before the shuffle, prefix sums run over
blocks of BLOCK rank values and over the blocks, so neither a group that holds a third of all rows nor a crowd of ties
meets in one task.

Defined results: redeliveries of (group, item) count once, with the best rank; a null rank means absent from that list;
rows with a null group or item are dropped; ranks of another type than whole numbers are refused; a row in no list has score 0 and comes last; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import apart, cut

#: Rank values a prefix sum covers in one task; a list has at most 2**31 / BLOCK blocks.
BLOCK = 65536


def positions(rows: DataFrame) -> DataFrame:
    """rows: _g, _i, _s (list), _r (rank, not null). Adds _p: 1 + rows of the same _g and _s with a smaller _r."""
    hist = rows.groupBy("_g", "_s", "_r").agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col("_r") / BLOCK))
    inner = Window.partitionBy("_g", "_s", "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("_g", "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("_g", "_s", "_b").agg(F.sum("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(outer), F.lit(0)))
    at = (
        apart(hist.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))))
        .join(apart(blocks.select("_g", "_s", "_b", "_before")), ["_g", "_s", "_b"])
        .select("_g", "_s", "_r", (F.col("_before") + F.col("_in") + 1).alias("_p"))
    )
    return apart(rows).join(apart(at), ["_g", "_s", "_r"])


def fuse(df: DataFrame, group: str, item: str, ranks: list[str], k: float = 60.0, best: int = 3) -> DataFrame:
    """group, item, a position per list (pos_<rank column>), score, lists_in, lists_best (lists with position <= best)."""
    other = [c for c in ranks if df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long")]
    if other:
        raise TypeError(f"ranks are whole numbers; of another type: {', '.join(other)}")
    one = (
        df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), *[F.col(c).alias(f"_r{n}") for n, c in enumerate(ranks)])
        .where(F.col("_g").isNotNull() & F.col("_i").isNotNull())
        .groupBy("_g", "_i")
        .agg(*[F.min(f"_r{n}").alias(f"_r{n}") for n in range(len(ranks))])
    )
    long = one.select(
        "_g", "_i", F.explode(F.array(*[F.struct(F.lit(n).alias("_s"), F.col(f"_r{n}").cast("long").alias("_r")) for n in range(len(ranks))])).alias("x")
    ).select("_g", "_i", "x._s", "x._r")
    placed = positions(long.where(F.col("_r").isNotNull()))
    at = [F.max(F.when(F.col("_s") == n, F.col("_p"))).alias(f"pos_{c}") for n, c in enumerate(ranks)]
    # rows that stand in no list stay, with score 0
    absent = long.groupBy("_g", "_i").agg(F.max("_r").alias("_m")).where(F.col("_m").isNull()).select("_g", "_i", F.lit(-1).alias("_s"), F.lit(None).cast("long").alias("_p"))
    wide = placed.select("_g", "_i", "_s", "_p").unionByName(absent).groupBy("_g", "_i").agg(*at)
    part = [F.coalesce(1.0 / (F.lit(k) + F.col(f"pos_{c}")), F.lit(0.0)) for c in ranks]
    score, held, led = part[0], F.lit(0), F.lit(0)
    for p in part[1:]:
        score = score + p
    for c in ranks:
        held = held + F.when(F.col(f"pos_{c}").isNotNull(), 1).otherwise(0)
        led = led + F.when(F.col(f"pos_{c}") <= best, 1).otherwise(0)
    return wide.select(F.col("_g").alias(group), F.col("_i").alias(item), *[f"pos_{c}" for c in ranks], score.alias("score"), held.alias("lists_in"), led.alias("lists_best"))


def ordered(fused: DataFrame, group: str, item: str) -> DataFrame:
    """Adds place: 1-based order in the group by score (greatest first), then item. A group may span many tasks: rows are
    range-partitioned by (group, score, item), numbered in their partition, and moved by the rows of the partitions before."""
    key = [F.col(group), F.col("score").desc(), F.col(item)]
    parts = max(2, int(fused.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(fused.repartitionByRange(parts, *key).withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(group, "_pid").agg(F.count("*").alias("_n")).select(group, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(group, "_pid").orderBy(*key[1:]))
    return apart(ranged.withColumn("_in", inside)).join(apart(offsets), [group, "_pid"]).withColumn("place", F.col("_in") + F.col("_off")).drop("_pid", "_in", "_off")
