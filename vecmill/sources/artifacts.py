"""Structures, models, caches, manifests, catalogues, logs and reports on disk."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json
from ..operators.quantizers import Quantizer
from ..operators.structure import Structure

PART = "struct<kind:string,value:string,mime_type:string>"
MANIFEST = f"query_id string, query_parts array<{PART}>, labels array<string>, candidates array<struct<name:string,parts:array<{PART}>>>"
CACHE = "cache_key string, model string, task_type string, dim int, vector array<float>, status string, error string"


# structures


def save_structure(s: Structure, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(s.check().dump())


def load_structure(path: str, d: int | None = None, total: int | None = None) -> Structure:
    """Checked; with d and total also that it's for these."""
    s = Structure.load(Path(path).read_text())
    if d is not None and s.d != d or total is not None and s.total != total:
        raise ValueError(f"{path} is for {s.d} places and {s.total} bits")
    return s


def find_structure(name: str, folders: tuple[str, ...] = (".", "structures")) -> str:
    for folder in ("", *folders):
        for end in ("", ".json"):
            p = os.path.join(folder, name + end)
            if os.path.isfile(p):
                return p
    raise FileNotFoundError(name)


def structure_cache_path(folder: str, d: int, total: int, stages: tuple[str, ...]) -> str:
    return os.path.join(folder, f"structure_d{d}_b{total}_{'-'.join(stages) or 'none'}.json")


# models: Parquet tables beside a JSON head


def save_model(spark: SparkSession, q: Quantizer, path: str, codes: DataFrame | None = None) -> None:
    """codebooks, groups, rotation and mean as tables; the codes of a base, if given, as another."""
    q.codebook_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/codebooks")
    q.group_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/groups")
    rows = [] if q.rotation is None else [("rotation", i, r.tolist()) for i, r in enumerate(q.rotation)]
    rows += [] if q.mean is None else [("mean", 0, q.mean.tolist())]
    spark.createDataFrame(rows, "part string, row int, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/transform")
    head = {"d": q.d, "width": q.width, "kind": q.kind, "stages": q.stages, "format": 1}
    spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
    if codes is not None:
        codes.write.mode("overwrite").parquet(f"{path}/codes")


def load_model(spark: SparkSession, path: str) -> Quantizer:
    head = json.loads(spark.read.parquet(f"{path}/head").first()["head"])
    groups = spark.read.parquet(f"{path}/groups").orderBy("group_id").collect()
    books: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/codebooks").orderBy("group_id", "code").collect():
        books.setdefault(r["group_id"], []).append(r["centroid"])
    parts = spark.read.parquet(f"{path}/transform").orderBy("row").collect()
    rotation = np.array([r["values"] for r in parts if r["part"] == "rotation"]) if any(r["part"] == "rotation" for r in parts) else None
    mean = next((np.array(r["values"]) for r in parts if r["part"] == "mean"), None)
    return Quantizer(head["d"], [list(g["dims"]) for g in groups], [g["nbits"] for g in groups], [np.array(books[g]) for g in sorted(books)], rotation, mean, head["width"], head["kind"], head["stages"])


def load_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/codes")


def model_cache_path(root: str, backend: str, settings: dict, train: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> str:
    """A folder by settings and training data: a readable stem, a digest of the settings, and one of the rows
    that doesn't depend on their order (counts and sums of their hashes, made in the cluster)."""
    stem = "_".join(f"{k}{v}" for k, v in sorted(settings.items()))
    stem = "".join(c if c.isalnum() else "_" for c in stem.lower()).strip("_")[:80]
    first = hashlib.sha256(canonical_json({"backend": backend, **settings}).encode()).hexdigest()[:12]
    sums = [F.sum(F.xxhash64(F.lit(k), F.col(id_col), F.col(vector)).cast("decimal(38,0)")) for k in (1, 2)]
    rows = train.agg(F.count("*"), *sums).first()
    second = hashlib.sha256(canonical_json([str(x) for x in rows]).encode()).hexdigest()[:20]
    return os.path.join(root, backend, f"{stem}_{first}_{second}")


# the embedding cache


def cache_split(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted with ``state``: hit (a vector is there), unavailable (an error is), miss."""
    known = cache.select("cache_key", F.col("status").alias("__status"))
    state = F.when(F.col("__status").isNull(), "miss").when(F.col("__status") == "ok", "hit").otherwise("unavailable")
    return wanted.join(known, "cache_key", "left").withColumn("state", state).drop("__status")


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New rows in place of old ones of their keys; errors are cut to 2000 characters. Of new rows of one key the greatest (status, error) stays."""
    new = new.withColumn("error", F.left("error", F.lit(2000))).withColumn("status", F.coalesce("status", F.lit("ok")))
    rest = [c for c in new.columns if c != "cache_key"]
    new = new.groupBy("cache_key").agg(F.max_by(F.struct(*rest), F.struct("status", F.coalesce("error", F.lit("")))).alias("r")).select("cache_key", *[F.col(f"r.{c}").alias(c) for c in rest])
    return cache.join(new, "cache_key", "left_anti").unionByName(new, allowMissingColumns=True)


# manifests and catalogues


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Lines with their number, ``pos``; the first ``limit`` of them."""
    text = spark.read.text(path).withColumn("__id", F.monotonically_increasing_id())
    rows = text.where("trim(value) <> ''").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "__id")
    if limit is not None:
        rows = rows.orderBy("__id").limit(limit)
    return rows.select(F.col("__id").alias("pos"), "r.*")


def read_manifest(spark: SparkSession, path: str, task: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, parts, labels, candidate_names) and the corpus (name, parts; the first of a name)."""
    rows = read_jsonl(spark, path, MANIFEST, limit)
    number = F.row_number().over(Window.orderBy("pos")) - 1 if limit else F.col("pos")
    queries = rows.select("pos", F.coalesce("query_id", F.concat(F.lit(f"{task}:"), number.cast("string"))).alias("query_id"), F.col("query_parts").alias("parts"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.transform("candidates", lambda c: c["name"]).alias("candidate_names"))
    each = rows.select("pos", F.posexplode("candidates").alias("at", "c")).select("pos", "at", "c.name", "c.parts")
    corpus = each.groupBy("name").agg(F.min_by("parts", F.struct("pos", "at")).alias("parts"))
    return queries, corpus


def parse_catalog(text: str) -> dict[str, dict]:
    """The subset of YAML that task catalogues use: tasks at the margin, their fields indented, lists in brackets or as - items."""
    tasks: dict[str, dict] = {}
    task = field = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare or bare.lstrip().startswith("#"):
            continue
        indent, bare = len(bare) - len(bare.lstrip()), bare.strip()
        if bare.startswith("- "):
            if task is None or field is None:
                raise ValueError(f"an item without a list: {line!r}")
            if not isinstance(tasks[task][field], list):
                tasks[task][field] = []
            tasks[task][field].append(_scalar(bare[2:]))
            continue
        name, colon, value = bare.partition(":")
        if not colon:
            raise ValueError(f"not a field: {line!r}")
        name = _scalar(name)
        if indent == 0:
            task, field = name, None
            tasks[task] = {"dataset_split": "test", "media_root": "image-tasks", "aliases": []}
        else:
            field, value = name, value.strip()
            if value.startswith("["):
                tasks[task][field] = [_scalar(v) for v in value.strip("[]").split(",") if v.strip()]
            else:
                tasks[task][field] = _scalar(value) if value else None
    return tasks


def _scalar(text: str):
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def load_catalogs(paths: list[str]) -> dict[str, dict]:
    """Of a task that several files have the last stays."""
    out: dict[str, dict] = {}
    for p in paths:
        out.update(parse_catalog(Path(p).read_text()))
    return out


def in_group(tasks: dict[str, dict], group: str) -> list[str]:
    return [n for n, t in tasks.items() if t.get("group") == group or group in (t.get("aliases") or [])]


# logs and reports


def parse_group_stats(lines: DataFrame, pos: str = "pos", text: str = "value") -> DataFrame:
    """quantizer, space, group_id, ndims, bits, d_proxy of log lines: a header holds until the next one.
    Headers are carried forward within the file ``name`` if there is one."""
    t = F.col(text)
    of = lambda what: F.nullif(F.regexp_extract(t, what, 1), F.lit(""))
    head = F.when(t.rlike(r"quantizer=\S+"), F.struct(of(r"quantizer=(\S+)").alias("quantizer"), of(r"space=(\S+)").alias("space"), F.col(pos).alias("at")))
    by = [F.col("name")] if "name" in lines.columns else [F.lit(0)]
    held = F.last(head, ignorenulls=True).over(Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("__head", held).where(t.rlike(r"group\[\d+\]"))
    return rows.select("__head.quantizer", "__head.space", of(r"group\[(\d+)\]").cast("int").alias("group_id"), of(r"ndims=(\d+)").cast("int").alias("ndims"), of(r"bits=(\d+)").cast("int").alias("bits"), of(r"D_proxy=([-+.eE\d]+)").cast("double").alias("d_proxy"))


def parse_result_tables(lines: DataFrame, pos: str = "pos", text: str = "value") -> DataFrame:
    """section, method, recall1, j of the tables of a Markdown report. The section is the last heading, the
    columns are those of the last header row; marks of emphasis and tags are dropped."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), r"\*\*|__|`", ""), r"<[^>]*>", ""))
    w = Window.partitionBy(F.lit(0)).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    cells = F.transform(F.split(F.regexp_replace(t, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    header = F.when(t.startswith("|") & F.lower(t).rlike(r"\|\s*(method|variant)\s*\|"), F.transform(cells, lambda c: F.lower(c)))
    rows = lines.select(F.col(pos), t.alias("__t"), cells.alias("__c"), F.last(F.when(t.startswith("#"), F.trim(F.regexp_replace(t, "^#+", ""))), ignorenulls=True).over(w).alias("section"), header.isNotNull().alias("__is"), F.last(header, ignorenulls=True).over(w).alias("__h"))
    rows = rows.where(F.col("__t").startswith("|") & ~F.col("__is") & F.col("__h").isNotNull() & ~F.col("__t").rlike(r"^[|\s:-]+$"))
    at = lambda *names: F.coalesce(*[F.get("__c", F.nullif(F.array_position("__h", n), F.lit(0)).cast("int") - 1) for n in names])
    return rows.select("section", at("method", "variant").alias("method"), at("recall@1").try_cast("double").alias("recall1"), at("j", "j_proxy").try_cast("double").alias("j")).where("recall1 is not null and j is not null")


def write_summary(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_rankings(rankings: DataFrame, path: str) -> None:
    rankings.write.mode("overwrite").json(path)
