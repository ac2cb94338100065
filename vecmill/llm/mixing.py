"""Mixing sources to target weights by subset-sum budget fitting.

Every document of a source is taken floor(target / source size) times; the rest of the
target, less than the source's size, is a budget that single documents fill. Documents
are counted by exact length. All but a reserve of the budget is spread over the lengths
in proportion to their counts, so that the mix keeps the source's lengths; a bounded
knapsack (bit sets over reachable sums, counts split into powers of two) then fits the
reserve exactly with the documents that are left. Which documents of a length are taken
is decided by a seeded hash: groups of one source and length are cut into buckets of
about ``bucket_rows`` by that hash, whole buckets go in, and only the bucket where the
count is met is ranked. Nothing depends on the order or place of rows, so reruns agree.

A null text has size 0 and is taken 0 words; null is a source of its own, the last. Rows
that repeat a doc_id are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: How often a task repeats one row at most, where it is spread.
PART = 4096


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Column:
    """What decides which documents of a length are taken."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col), F.col(source_col).isNull())


def targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_docs and target. Sources in code point order, null last, have the
    weights in turn and share ``share`` times all sizes; a target stops at ``most`` times its
    source's size, and the excess is reshared by weight until none is above.

    That ends where every source has min(cap, weight * level) for one level. With sources in
    order of cap / weight, the level follows from running sums; one row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = totals.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(most))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    s = s.withColumn("pool", F.sum("source_size").over(every) * float(share)).withColumn("weights", F.sum("weight").over(every))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source that its level doesn't fill sets the level of all that follow.
    held = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("final", F.min(held).over(every)).withColumn("first", F.first(held, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.select("source", "source_size", "n_docs", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("first"))).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int = 1 << 15) -> np.ndarray:
    """How many documents of each length (of ``counts``) to take so that their words come as near
    to the budget as can be without going over it, in proportion but for the reserve."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return taken
    if budget >= total:
        return counts.copy()
    part = max(0.0, (budget - reserve) / total)
    carry = 0.0
    for i in np.argsort(-lengths, kind="stable").tolist():
        if lengths[i] <= 0:
            continue
        want = counts[i] * part * lengths[i] + carry
        taken[i] = min(int(counts[i]), max(0, int(want // lengths[i])))
        carry = want - float(taken[i] * lengths[i])
    rest = budget - int((taken * lengths).sum())
    # Bounded knapsack: reach[k] has the sums that the first k items can make, one bit a sum.
    mask = (1 << (rest + 1)) - 1
    items, reach = [], [1]
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, left, power = int(lengths[i]), int(counts[i] - taken[i]), 1
        if size <= 0 or size > rest:
            continue
        left = min(left, rest // size)
        while left > 0 and not reach[-1] >> rest & 1:
            n = min(power, left)
            items.append((i, n, n * size))
            reach.append((reach[-1] | reach[-1] << (n * size)) & mask)
            left -= n
            power *= 2
    at = reach[-1].bit_length() - 1
    for k in range(len(items) - 1, -1, -1):
        i, n, size = items[k]
        if not reach[k] >> at & 1:
            taken[i] += n
            at -= size
    return taken


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, bucket_rows: int = 4096, reserve: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words of the document that the mix takes)
    copies (how often it takes the document) and h (row_hash), a row for each document."""
    text = F.col(text_col)
    sizes = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), row_hash(seed, id_col, text_col, source_col).alias("h")), "sizes")
    hist = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    goal = targets(totals, weights, share, most)

    def fit(t: pa.Table) -> pa.Table:
        """A source's lengths: as many rows as it has different lengths."""
        t = t.sort_by("size")
        size, target = t["source_size"][0].as_py(), t["target"][0].as_py()
        base = int(target // size) if size else 0
        extra = fit_budget(t["size"].to_numpy(), t["n"].to_numpy(), int(round(target)) - base * size, reserve)
        return t.append_column("base", pa.array(np.full(len(t), base))).append_column("extra", pa.array(extra))

    goal = goal.select(F.col("source").alias("of"), "source_size", "target")
    joined = hist.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.select("source", "size", "n", "source_size", "target")
    plan = joined.groupBy("source").applyInArrow(fit, "source string, size long, n long, source_size long, target double, base long, extra long")
    plan = written(plan.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows)).cast("int")), "plan")
    own = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("own")  # a join key without nulls
    rows = sizes.withColumn("own", own).join(plan.select(own, "size", "source_size", "target", "base", "extra", "n", "buckets"), ["own", "size"])
    rows = rows.withColumn("bucket", F.pmod("h", F.col("buckets")).cast("int"))
    # Single documents are needed only where some of a length go in and some stay.
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    whole = rows.where(~some).withColumn("extra_copy", (F.col("extra") >= F.col("n")).cast("long"))
    cut = rows.where(some)
    met = cut.groupBy("own", "size", "bucket").agg(F.count("*").alias("here"))
    before = Window.partitionBy("own", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here")
    ranked = cut.join(met, ["own", "size", "bucket"]).withColumn("rank", F.row_number().over(Window.partitionBy("own", "size", "bucket").orderBy("h", "doc_id")))
    ranked = ranked.withColumn("extra_copy", (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")).drop("before", "rank")
    out = whole.unionByName(ranked)
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("extra_copy")).otherwise(F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "h")


def take(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them. Documents of no words have no part in a mix.
    Rows of the same id, text and source are told apart by their other columns, which must be of
    kinds that can be grouped; rows that agree in all are counted, not gathered."""
    plan = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # Rows of one key have one source and size: copies are ``least``, or one more for ``more`` of them.
    plan = plan.groupBy("doc_id", "h").agg(F.count("*").alias("rows"), F.min("copies").alias("least"), F.sum("copies").alias("copies")).where("copies > 0")
    plan = written(plan.select(F.col("doc_id").alias("of"), F.col("h").alias("hash"), "rows", "least", (F.col("copies") - F.col("rows") * F.col("least")).alias("more")), "taken")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), row_hash(seed, id_col, text_col, source_col).alias("h"))
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("hash"))
    one = keyed.join(plan.where("rows = 1"), same).withColumn("n", F.col("least") + F.col("more"))
    once = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
    several = plan.where("rows > 1")
    if not several.limit(1).count():
        return once
    kinds = keyed.join(several, same, "left_semi").groupBy("id", "h", "row").agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("id", "h").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = kinds.withColumn("before", before).join(several, same)
    many = many.withColumn("n", F.col("here") * F.col("least") + F.least(F.greatest(F.col("more") - F.col("before"), F.lit(0)), F.col("here"))).where("n > 0")
    # A row that is there very often is spread over tasks before it is repeated.
    many = many.select("row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART))).alias("part")).repartition("part", F.xxhash64("row"))
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(PART), F.col("n") - F.col("part") * PART).cast("int"))))
    return once.unionByName(many.select("row.*"))
