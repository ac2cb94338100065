"""Column expressions over vectors (arrays of float). Sums are taken in double.

Nulls give null; shapes are the caller's to check (``vector_error``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column, least: float = 1e-12) -> Column:
    """The vector over its norm, or over ``least`` where the norm is smaller."""
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(doubles(v), lambda x: x / n)


def take_dims(v: Column, dims: list[int]) -> Column:
    """The components at some places, in that order; a permutation if all are named."""
    return F.transform(F.array(*[F.lit(int(i)) for i in dims]), lambda i: F.get(v, i))


def padded(v: Column, multiple: int) -> Column:
    """Zeros at the end up to a multiple."""
    return F.concat(doubles(v), F.array_repeat(F.lit(0.0), F.pmod(F.lit(multiple) - F.pmod(F.size(v), F.lit(multiple)), F.lit(multiple)).cast("int")))


def vector_error(v: Column, d: int) -> Column:
    """Why a vector can't be used, null if it can: none, empty, shape, not_finite, all_zero, all_minus_one."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(v.isNull(), "none")
        .when(F.size(v) == 0, "empty")
        .when(F.size(v) != d, "shape")
        .when(bad, "not_finite")
        .when(F.forall(v, lambda x: x == 0), "all_zero")
        .when(F.forall(v, lambda x: x == -1), "all_minus_one")
    )


def long_form(df: DataFrame, vector: str = "embedding", *keep: str) -> DataFrame:
    """A row for each component: the kept columns, i (from 0) and x (double)."""
    return df.select(*keep, F.posexplode(F.col(vector)).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def sample_order(seed: int, id_col: str = "vec_id") -> Column:
    """An order that depends on seed and id only, the same in every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_sample(df: DataFrame, n: int, seed: int, id_col: str = "vec_id") -> DataFrame:
    """n rows without replacement; all where n <= 0 or there are no more."""
    return df if n <= 0 else _least(df, n, df.count(), seed, id_col)


def _least(df: DataFrame, n: int, rows: int, seed: int, id_col: str) -> DataFrame:
    """The n rows first in the sample's order. A bound on its first digits leaves few more than n rows to be
    sorted, so that the task where they meet doesn't get n rows of every partition."""
    share = (1.2 * n + 1000) / max(rows, 1)
    some = df if share >= 1 else df.where(F.conv(F.substring(sample_order(seed, id_col), 1, 8), 16, 10).cast("long") < int(share * 2**32))
    return some.orderBy(sample_order(seed, id_col), id_col).limit(n)


def split_sizes(n: int, max_train: int, max_eval: int, fraction: float) -> tuple[int, int]:
    """Rows for training and for evaluation of n rows: both full if there are enough, else a share
    of n (fraction held in [0.05, 0.5]), at least 1 and at most n - 1, under the maxima."""
    if n <= 1:
        return n, n
    if n >= max_train + max_eval:
        return max_train, max_eval
    fraction = min(max(fraction, 0.05), 0.5)
    n_eval = min(max(round(n * fraction), 1), n - 1)
    return min(n - n_eval, max_train), min(n_eval, max_eval)


def train_eval_split(df: DataFrame, max_train: int = 16_384, max_eval: int = 4_096, fraction: float = 0.2, seed: int = 123, id_col: str = "vec_id") -> DataFrame:
    """The rows with ``part`` train or eval; a single row is both."""
    n = df.count()
    train, held = split_sizes(n, max_train, max_eval, fraction)
    if n <= 1:
        return df.withColumn("part", F.explode(F.array(F.lit("train"), F.lit("eval"))))
    first = _least(df, train + held, n, seed, id_col)
    place = F.row_number().over(Window.orderBy(sample_order(seed, id_col), id_col))  # over at most train + held rows
    return first.withColumn("part", F.when(place <= train, "train").otherwise("eval"))


def balanced_groups(d: int, m: int) -> list[list[int]]:
    """d places in m runs of equal length, the first d % m of them longer by one."""
    base, more = divmod(d, m)
    out, at = [], 0
    for g in range(m):
        size = base + (g < more)
        out.append(list(range(at, at + size)))
        at += size
    return out


def contiguous(sizes: list[int]) -> list[list[int]]:
    out, at = [], 0
    for s in sizes:
        out.append(list(range(at, at + s)))
        at += s
    return out


def code_type(most_bits: int) -> str:
    """The narrowest Spark type for codes of so many bits; Spark's integers are signed."""
    return "tinyint" if most_bits <= 7 else "smallint" if most_bits <= 15 else "int"
