"""Retrieval tasks: annotation rows to queries and corpora, embeddings, a benchmark run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_present, joined_prompt, media_signature, media_type, parts_with_values
from .metrics import ranking_metrics
from .search import VectorIndex

PART = "struct<kind:string,value:string,mime_type:string>"

KS = (1, 5, 10)


def text_part(value: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), value.cast("string").alias("value"), F.lit(None).cast("string").alias("mime_type"))


def media_part(kind: str, path: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), path.alias("value"), media_type(path).alias("mime_type"))


def first_wins(corpus: DataFrame, *order: str) -> DataFrame:
    """name, parts: of candidates of one name the first."""
    return corpus.groupBy("name").agg(F.min_by("parts", F.struct(*order)).alias("parts"))


def _numbered(rows: DataFrame, task: str) -> Column:
    return F.concat(F.lit(f"{task}:"), F.col("pos").cast("string"))


def parse_image_to_text(rows: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """Classification, question answering, image to text: candidates are the target texts, the first is right.
    rows: pos, qry_inst, qry_text, qry_img_path, tgt_text."""
    prompt = joined_prompt(first_present(rows, "qry_inst"), first_present(rows, "qry_text"))
    parts = parts_with_values(F.array(text_part(prompt), media_part("image", F.col("qry_img_path"))))
    queries = rows.select("pos", _numbered(rows, task).alias("query_id"), parts.alias("parts"), F.slice("tgt_text", 1, 1).alias("labels"), F.col("tgt_text").alias("candidate_names"))
    each = rows.select("pos", F.posexplode("tgt_text").alias("at", "name")).withColumn("parts", F.array(text_part(F.col("name"))))
    return queries, first_wins(each, "pos", "at")


def _pairs(rows: DataFrame) -> Column:
    n = F.least(F.size("tgt_img_path"), F.size("tgt_text"))
    return F.arrays_zip(F.slice("tgt_img_path", F.lit(1), n).alias("path"), F.slice("tgt_text", F.lit(1), n).alias("caption"))


def parse_text_to_image(rows: DataFrame, task: str, named_by_caption: bool = False, query_image: bool = False) -> tuple[DataFrame, DataFrame]:
    """Candidates are image and caption, as far as both lists go; named by the path, or by path and caption. The first is right."""
    prompt = joined_prompt(first_present(rows, "qry_inst"), first_present(rows, "qry_text"))
    own = [text_part(prompt)] + ([media_part("image", F.col("qry_img_path"))] if query_image else [])
    z = rows.withColumn("__z", _pairs(rows))
    fields = rows.select(_pairs(rows).alias("z")).schema["z"].dataType.elementType.names
    name_of = lambda p: F.concat(p[fields[0]], F.lit(":"), F.trim(p[fields[1]])) if named_by_caption else p[fields[0]]
    z = z.withColumn("candidate_names", F.transform("__z", name_of))
    queries = z.select("pos", _numbered(rows, task).alias("query_id"), parts_with_values(F.array(*own)).alias("parts"), F.slice("candidate_names", 1, 1).alias("labels"), "candidate_names")
    each = z.select("pos", F.posexplode("__z").alias("at", "c"), "candidate_names").withColumn("name", F.get("candidate_names", F.col("at")))
    parts = parts_with_values(F.array(media_part("image", F.col(f"c.{fields[0]}")), text_part(F.col(f"c.{fields[1]}"))))
    return queries, first_wins(each.withColumn("parts", parts), "pos", "at")


def parse_video_classes(rows: DataFrame, task: str, with_negatives: bool = False) -> tuple[DataFrame, DataFrame]:
    """Candidates are all labels of the task, in order; with negatives a row's own list and its label.
    rows: pos, pos_text, video_path, qry_instruction, qry_text, neg_text."""
    prompt = joined_prompt(first_present(rows, "qry_instruction"), first_present(rows, "qry_text"))
    parts = parts_with_values(F.array(text_part(prompt), media_part("video", F.col("video_path"))))
    base = rows.select("pos", _numbered(rows, task).alias("query_id"), parts.alias("parts"), F.array("pos_text").alias("labels"), *(["neg_text"] if with_negatives else []))
    if with_negatives:
        queries = base.withColumn("candidate_names", F.array_union(F.col("labels"), F.coalesce("neg_text", F.array().cast("array<string>")))).drop("neg_text")
        each = queries.select("pos", F.posexplode("candidate_names").alias("at", "name"))
    else:
        labels = rows.select(F.col("pos_text").alias("name")).distinct()
        every = labels.agg(F.array_sort(F.collect_list("name")).alias("candidate_names"))  # a row for each label of the task
        queries, each = base.crossJoin(F.broadcast(every)), labels.select(F.lit(0).alias("pos"), F.lit(0).alias("at"), "name")
    return queries.select("pos", "query_id", "parts", "labels", "candidate_names"), first_wins(each.withColumn("parts", F.array(text_part(F.col("name")))), "pos", "at")


def parse_yes_no(rows: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """Questions on videos with the answers yes and no. rows: pos, video_name, question, answer."""
    parts = parts_with_values(F.array(text_part(joined_prompt(F.col("question"))), media_part("video", F.col("video_name"))))
    queries = rows.select("pos", _numbered(rows, task).alias("query_id"), parts.alias("parts"), F.array(F.lower(F.trim("answer"))).alias("labels"), F.array(F.lit("yes"), F.lit("no")).alias("candidate_names"))
    corpus = rows.sparkSession.createDataFrame([("yes",), ("no",)], "name string").withColumn("parts", F.array(text_part(F.col("name"))))
    return queries, corpus


def parse_moments(rows: DataFrame, clips: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """Candidates are the clips of a row's folder, right those whose name has "positive"; a row without one is an error.
    rows: pos, query, clips_dir_path; clips: clips_dir_path, clip."""
    each = rows.select("pos", "query", "clips_dir_path").join(clips, "clips_dir_path").withColumn("name", F.concat_ws("/", "clips_dir_path", "clip"))
    right = F.contains(F.lower("clip"), F.lit("positive"))
    grouped = each.groupBy("pos", "query").agg(F.array_sort(F.collect_list(F.when(right, F.col("name")))).alias("labels"), F.array_sort(F.collect_list("name")).alias("candidate_names"))
    labels = F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.raise_error(F.lit("a row has no positive clip")).cast("array<string>"))
    queries = grouped.select("pos", _numbered(rows, task).alias("query_id"), F.array(text_part(F.col("query"))).alias("parts"), labels.alias("labels"), "candidate_names")
    return queries, first_wins(each.withColumn("parts", F.array(media_part("video", F.col("name")))), "pos", "clip")


def parse_judgements(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, task: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries with judged documents: labels are those of a score above 0 that the corpus has. Queries are cut to
    the limit first, numbered, and those without a label dropped. queries: pos, query_id, query; qrels: query_id,
    corpus_id, score; corpus: corpus_id, parts."""
    q = queries if limit is None else queries.orderBy("pos").limit(limit)
    good = qrels.where("score > 0").join(corpus.select("corpus_id"), "corpus_id", "left_semi").select("query_id", "corpus_id").distinct()
    labels = good.groupBy("query_id").agg(F.array_sort(F.collect_list("corpus_id")).alias("labels"))  # as many as one query has judged
    out = q.join(labels, "query_id").select("pos", _numbered(q, task).alias("query_id"), F.array(text_part(joined_prompt(F.col("query")))).alias("parts"), "labels", F.col("labels").alias("candidate_names"))
    return out, first_wins(corpus.select(F.col("corpus_id").alias("name"), "parts", F.lit(0).alias("pos")), "pos")


def rows_of_task(rows: DataFrame, task: str, keys: tuple[str, ...] = ("task", "dataset", "dataset_name", "source")) -> DataFrame:
    """The rows of a task by the first key column that has any; all rows if none does."""
    for k in keys:
        if k in rows.columns:
            found = rows.where(F.col(k) == task)
            if found.limit(1).count():
                return found
    return rows


def path_index(paths: DataFrame) -> DataFrame:
    """key, path of files by name, name without extension, and that without a leading v_; the first path of a key stays."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    keys = F.array_distinct(F.array(name, stem, F.regexp_replace(stem, "^v_", "")))
    return paths.select(F.explode(keys).alias("key"), "path").groupBy("key").agg(F.min("path").alias("path"))


def available(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Queries with only the labels and candidates that are there; those left with no label are gone."""
    each = queries.select("query_id", F.posexplode("labels").alias("at", "name")).join(names.select("name"), "name", "left_semi")
    labels = each.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("labels"))
    cand = queries.select("query_id", F.posexplode("candidate_names").alias("at", "name")).join(names.select("name"), "name", "left_semi")
    cand = cand.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("candidate_names"))
    return queries.drop("labels", "candidate_names").join(labels, "query_id").join(cand, "query_id", "left").withColumn("candidate_names", F.coalesce("candidate_names", F.array().cast("array<string>")))


class Embedder(Protocol):
    dim: int

    def embed(self, items: DataFrame, is_query: bool) -> DataFrame:
        """items (key, parts) to key, vector (null where unavailable), error."""


class HashEmbedder:
    """Normal vectors seeded by the parts' signature, so equal parts have equal vectors; queries and documents differ."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, items: DataFrame, is_query: bool) -> DataFrame:
        dim, end = self.dim, ":q" if is_query else ":d"

        @F.pandas_udf("array<float>")
        def vector(sig: pd.Series) -> pd.Series:
            def one(s: str) -> list[float]:
                v = np.random.default_rng(int(s[:16], 16)).standard_normal(dim)
                return (v / max(np.linalg.norm(v), 1e-12)).tolist()

            return sig.map(one)

        return items.select("key", vector(F.sha2(F.concat(media_signature(F.col("parts")), F.lit(end)), 256)).alias("vector"), F.lit(None).cast("string").alias("error"))


class InvalidInput(Exception):
    """A client says that some of its inputs can't be embedded."""


class ClientEmbedder:
    """A pluggable client: ``client()`` gives f(list of parts, is_query) -> list of vectors. A batch that it refuses
    (InvalidInput) is halved until the bad items stand alone; these become unavailable."""

    def __init__(self, client: Callable[[], Callable], dim: int, batch: int = 32):
        self.client, self.dim, self.batch = client, dim, batch

    def embed(self, items: DataFrame, is_query: bool) -> DataFrame:
        make, dim, size = self.client, self.dim, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make()

            def some(parts: list) -> list:
                try:
                    got = call(parts, is_query)
                    return [(v, None) if sane(v, dim) is None else (None, sane(v, dim)) for v in got]
                except InvalidInput as e:
                    if len(parts) == 1:
                        return [(None, str(e)[:2000])]
                    half = len(parts) // 2
                    return some(parts[:half]) + some(parts[half:])

            for f in frames:
                parts, out = f["parts"].tolist(), []
                for at in range(0, len(parts), size):
                    out += some(parts[at : at + size])
                yield pd.DataFrame({"key": f["key"], "vector": [v for v, _ in out], "error": [e for _, e in out]})

        return items.select("key", "parts").mapInPandas(run, f"key {items.schema['key'].dataType.simpleString()}, vector array<float>, error string")


def sane(v, d: int) -> str | None:
    """Why a vector can't be used, as ``vector_error``."""
    if v is None:
        return "none"
    x = np.asarray(v, float)
    if x.size == 0:
        return "empty"
    if x.shape != (d,):
        return "shape"
    if not np.isfinite(x).all():
        return "not_finite"
    return "all_zero" if (x == 0).all() else "all_minus_one" if (x == -1).all() else None


def distinct_corpus(tasks: list[DataFrame]) -> DataFrame:
    """name, parts of several corpora, the first of each signature."""
    every = None
    for at, c in enumerate(tasks):
        part = c.select(F.lit(at).alias("task"), "name", "parts")
        every = part if every is None else every.unionByName(part)
    every = every.withColumn("signature", media_signature(F.col("parts")))
    return every.groupBy("signature").agg(F.min_by(F.struct("name", "parts"), F.struct("task", "name")).alias("r")).select("signature", "r.name", "r.parts")


def run_benchmark(queries: DataFrame, corpus: DataFrame, embedder: Embedder, index: VectorIndex, train: DataFrame | None = None, ks: tuple[int, ...] = KS, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Embeds the corpus, fits and fills the index, drops queries without an available label, ranks over the whole corpus. Returns
    metrics (k, queries, hit, precision, recall, mrr, and counts of what was kept) and rankings (query_id, labels, prediction, scores)."""
    numbered = corpus.select("name", "parts", F.xxhash64("name").alias("vec_id"))
    docs = embedder.embed(numbered.select(F.col("vec_id").alias("key"), "parts"), False).where("vector is not null").select(F.col("key").alias("vec_id"), F.col("vector").alias("embedding")).persist()
    index.fit_add(train, docs)
    there = numbered.join(docs.select("vec_id"), "vec_id", "left_semi").select("name", "vec_id")
    usable = available(queries, there).withColumn("qid", F.xxhash64("query_id"))
    asked = embedder.embed(usable.select(F.col("qid").alias("key"), "parts"), True).where("vector is not null").select(F.col("key").alias("vec_id"), F.col("vector").alias("embedding")).persist()
    found = index.search(asked, max(top, *ks))
    score = "score" if "score" in found.columns else "dist"
    named = found.join(there, "vec_id").select("qid", "rank", F.col("name").alias("item"), (F.col(score) if score == "score" else -F.col(score)).alias("score"))
    kept = usable.join(asked.select(F.col("vec_id").alias("qid")), "qid", "left_semi")
    metrics = ranking_metrics(named, kept.select("qid", F.explode("labels").alias("item")), ks)
    counts = {"raw_queries": queries.count(), "kept_queries": kept.count(), "raw_candidates": corpus.count(), "kept_candidates": docs.count()}
    metrics = metrics.withColumns({k: F.lit(v) for k, v in counts.items()})
    for what in ("queries", "candidates"):
        metrics = metrics.withColumn(f"{what}_keep_rate", F.lit(counts[f"kept_{what}"] / counts[f"raw_{what}"] if counts[f"raw_{what}"] else 0.0))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "item", "score")))  # at most k of a query
    rankings = named.where(F.col("rank") <= top).groupBy("qid").agg(ordered.alias("r")).join(kept.select("qid", "query_id", "labels"), "qid")
    return metrics, rankings.select("query_id", "labels", F.transform("r", lambda x: x["item"]).alias("prediction"), F.transform("r", lambda x: x["score"]).alias("scores"))


def promoted(top: int, ks: tuple[int, ...]) -> int:
    """As many results as the largest k needs."""
    return max(top, *ks)


def unique(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key, in the order of first places."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where("__n = 1").drop("__n").orderBy(pos)
