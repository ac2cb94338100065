"""Vector files as a Spark data source: ``spark.read.format("vecfile")``.

A file is a run of records, each an int32 length d and d values (kind ``f``: float32,
``i``: int32), all of one d. Partitions are ranges of whole records, so that a large file is read
by many tasks. Paths are of a folder that all executors share. Written files are one a task,
named by partition, and only those of tasks that ended well stay.
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MOST_D = 100_000


def record_shape(path: str) -> tuple[int, int]:
    """d and the number of records; an empty file, a partial record or an impossible d is an error."""
    size = os.path.getsize(path)
    if size < 4:
        raise ValueError(f"{path} has no records")
    with open(path, "rb") as f:
        d = int(np.frombuffer(f.read(4), "<i4")[0])
    if not 1 <= d <= MOST_D:
        raise ValueError(f"{path}: {d} places are out of range")
    if size % (4 + 4 * d):
        raise ValueError(f"{path} ends within a record")
    return d, size // (4 + 4 * d)


@dataclass
class Span(InputPartition):
    path: str
    first: int
    count: int
    d: int
    base: int

    def __post_init__(self):
        super().__init__(None)


class VecReader(DataSourceReader):
    def __init__(self, options):
        self.kind = options.get("kind", "f")
        self.step = int(options.get("recordsPerPartition", 1_000_000))
        path = options["path"].removeprefix("file://")
        self.paths = sorted(glob.glob(os.path.join(path, "*vecs"))) if os.path.isdir(path) else [path]

    def partitions(self):
        spans, base, dims = [], 0, set()
        for p in self.paths:
            d, n = record_shape(p)
            dims.add(d)
            spans += [Span(p, at, min(self.step, n - at), d, base + at) for at in range(0, n, self.step)]
            base += n
        if len(dims) > 1:
            raise ValueError("the files have vectors of different places")
        return spans

    def read(self, span):
        kind = "<f4" if self.kind == "f" else "<i4"
        done = 0
        with open(span.path, "rb") as f:
            f.seek(span.first * (4 + 4 * span.d))
            while done < span.count:
                n = min(8192, span.count - done)
                raw = np.frombuffer(f.read(n * (4 + 4 * span.d)), "<i4").reshape(n, span.d + 1)
                if (raw[:, 0] != span.d).any():
                    raise ValueError(f"{span.path}: records of different places")
                values = np.ascontiguousarray(raw[:, 1:]).view(kind)
                flat = pa.array(values.ravel())
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * span.d), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(span.base + done, span.base + done + n)), vectors], ["vec_id", "embedding"])
                done += n


@dataclass
class Wrote(WriterCommitMessage):
    path: str | None
    d: int | None


class VecWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.kind, self.path, self.overwrite = options.get("kind", "f"), options["path"].removeprefix("file://"), overwrite

    def write(self, batches):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        out = os.path.join(self.path, f".part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{self.kind}vecs")
        d = None
        with open(out, "wb") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                column = b.column("embedding")
                sizes = set(column.value_lengths().to_pylist())
                if len(sizes | ({d} - {None})) != 1:
                    raise ValueError("vectors of different places can't be in one file")
                d = sizes.pop()
                x = np.asarray(column.flatten()).astype("<f4" if self.kind == "f" else "<i4").reshape(-1, d)
                f.write(np.hstack([np.full((len(x), 1), d, "<i4"), x.view("<i4")]).tobytes())
        if d is None:
            os.remove(out)
        return Wrote(out if d is not None else None, d)

    def commit(self, messages):
        made = [m for m in messages if m is not None and m.path]
        if len({m.d for m in made}) > 1:
            self.abort(messages)
            raise ValueError("vectors of different places can't be in one file set")
        if self.overwrite and os.path.isdir(self.path):
            for old in glob.glob(os.path.join(self.path, "part-*vecs")):
                os.remove(old)
        for m in made:
            os.rename(m.path, os.path.join(self.path, os.path.basename(m.path)[1:]))

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class VecFile(DataSource):
    """Options: path, kind (f or i), recordsPerPartition."""

    @classmethod
    def name(cls):
        return "vecfile"

    def schema(self):
        return "vec_id long, embedding array<float>" if self.options.get("kind", "f") == "f" else "vec_id long, embedding array<int>"

    def reader(self, schema):
        return VecReader(self.options)

    def writer(self, schema, overwrite):
        return VecWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VecFile)


def read_vectors(spark: SparkSession, path: str, kind: str = "f") -> DataFrame:
    register(spark)
    return spark.read.format("vecfile").option("kind", kind).load(path)


def write_vectors(df: DataFrame, path: str, kind: str = "f", vector: str = "embedding") -> None:
    """Rows in their partitions' order; sort before, where order matters."""
    register(df.sparkSession)
    df.select(F.col(vector).cast("array<float>" if kind == "f" else "array<int>").alias("embedding")).write.format("vecfile").option("kind", kind).mode("overwrite").save(path)


def slice_vectors(df: DataFrame, skip: int, n: int, id_col: str = "vec_id", d: int | None = None, vector: str = "embedding") -> DataFrame:
    """n rows from ``skip`` on by id; too few, or (with d) another shape, is an error."""
    got = df.orderBy(id_col).offset(skip).limit(n)
    if got.count() < n:
        raise ValueError(f"there are fewer than {skip + n} vectors")
    if d is not None and got.where(F.size(vector) != d).limit(1).count():
        raise ValueError(f"there are vectors of other than {d} places")
    return got


def truth_rows(result: DataFrame) -> DataFrame:
    """Search results as rows for an ``i`` file: each query's ids by rank, in order of the query."""
    return result.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda r: r["vec_id"].cast("int")).alias("embedding")).orderBy("qid")


DATASETS: dict[str, dict[str, str]] = {}


def register_dataset(name: str, base: str, query: str, learn: str | None = None, truth: str | None = None) -> None:
    DATASETS[name.lower()] = {"base": base, "query": query, "learn": learn, "truth": truth}


def dataset_from_folder(folder: str) -> dict[str, str | None]:
    """The files of a folder by the usual endings of their names; base and query must be there and of one shape."""
    found: dict[str, str | None] = {}
    for part in ("base", "query", "learn", "groundtruth"):
        hits = sorted(glob.glob(os.path.join(folder, f"*{part}.*vecs")))
        found["truth" if part == "groundtruth" else part] = hits[0] if hits else None
    for part in ("base", "query"):
        if found[part] is None:
            raise FileNotFoundError(f"{folder} has no {part} vectors")
    if record_shape(found["base"])[0] != record_shape(found["query"])[0]:
        raise ValueError("base and query vectors have different places")
    return found


def load_dataset(spark: SparkSession, name: str, max_train: int | None = None, seed: int = 123) -> dict[str, DataFrame | None]:
    """base, query, learn (at most max_train rows by hash order) and truth of a registered dataset; an unknown name is an error."""
    from ..functions.vectors import hash_sample

    where = DATASETS.get(name.lower())
    if where is None:
        raise KeyError(f"no dataset {name!r}; there are {sorted(DATASETS)}")
    got = {k: None if p is None else read_vectors(spark, p, "i" if k == "truth" else "f") for k, p in where.items()}
    if got["learn"] is not None and max_train:
        got["learn"] = hash_sample(got["learn"], max_train, seed)
    return got
