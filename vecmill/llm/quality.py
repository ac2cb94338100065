"""Quality classification with hierarchical empirical Bayes.

A document classifier (logistic regression on features of the whole text) gives each
document its evidence. Hosts and, below them, paths have a rate of good documents. What is
known of a group are the outcomes of its labelled documents, and the evidence of all its
documents as pseudo-counts of ``pseudo`` documents each. Rates have beta priors: a host's is
centred on the global rate, a path's on its host's. How strong a prior is follows from how
much the groups' means differ beyond chance (method of moments), so sparse groups shrink to
what lies above them. A document's own pseudo-count is left out of its group's sums, and
the posterior odds are the classifier's odds times the group's odds relative to the global
odds.

The host of a document is its source up to the first slash. Its path is the rest of the
source; where there is none, one of ``SHARDS`` shards of the host by the hash of the id.
Both can be given as columns.

The classifier is fitted on at most ``sample`` labelled rows (those of least hash), a
documented bound; sums over hosts and paths cover all documents and labels, aggregated before
they are shuffled. Null or empty texts have features of zero length and count like others;
null hosts or paths form groups of their own. Rows that repeat an id are documents of their
own, which share its labels (of several the greatest). Without labels of both kinds nothing
can be learned: every document gets 0.5 and stays. Empty tables give no rows; extra columns,
whatever their names, are kept by ``keep_good`` and ignored otherwise.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, text_batches, written

FEATURES = ("length", "symbols", "bars", "capitals", "digits", "spaces", "high", "repeats", "same_next", "line_repeats", "word_length", "long_words", "empty")
_KIND = np.zeros(256, np.int64)  # other
_KIND[[ord(c) for c in "#$%&*+<=>@\\^_`~{}!?"]] = 1
_KIND[ord("|")] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[[32, 9, 10, 11, 12, 13]] = 5
_KIND[128:] = 6


def features(text: str | None) -> list[float]:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words = (text or "").split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    counts = np.bincount(_KIND[raw], minlength=7) / len(raw)
    lines = text.split("\n")
    mean = (len(text) - text.count(" ")) / len(words)
    return [
        float(np.log1p(len(words))),
        *(float(np.sqrt(counts[k])) for k in (1, 2, 3, 4, 5, 6)),
        1.0 - len(set(words)) / len(words) ** 0.9 if len(words) > 1 else 0.0,
        sum(map(eq, words, words[1:])) / len(words),
        1.0 - len(set(lines)) / len(lines),
        min(mean, 30.0) / 10.0,
        max(map(len, words)) > 60,
        0.0,
    ]


def feature_table(docs: DataFrame, columns: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The named columns and x, the features of the whole text."""
    src = docs.select(*(c.alias(k) for k, c in columns.items()), F.col(text_col).alias("whole"))
    names = list(columns)

    text_batches(docs.sparkSession)

    def run(batches):
        release()
        for b in slices(batches):
            x = pa.array([list(map(float, features(t))) for t in b["whole"].to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b[k] for k in names), x], [*names, "x"])

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", x array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the constant), means and scales; Newton's method with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), ridge * np.append(np.ones(z.shape[1] - 1), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _shrunk(total: Column, n: Column, centre: Column, strength: Column) -> Column:
    return (total + strength * centre) / (n + strength)


def _strength(groups: DataFrame, centre: str) -> Column:
    """Prior strength of groups (n, good) around their centre by the method of moments: the
    variance of group means beyond what sampling would give. One number, from one aggregation."""
    mean = F.col("good") / F.col("n")
    base = F.col(centre) * (1 - F.col(centre))
    row = groups.agg(
        F.sum(F.col("n") * (mean - F.col(centre)) ** 2).alias("spread"), F.sum(base).alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * base).alias("base")
    ).first()
    if not row["n"] or not row["base"]:
        return F.lit(1.0)
    between = max((row["spread"] - row["chance"]) / row["n"], 1e-6)
    return F.lit(float(min(max(row["base"] / row["n"] / between - 1.0, 1.0), 1e6)))


SHARDS = 64


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def site(host: Column | None, path: Column | None) -> tuple[Column, Column]:
    """Keys of a document's host and path, the given columns or those of the source."""
    cut = F.instr("source", "/")
    if host is None:
        host = F.when(cut > 0, F.substring_index("source", "/", 1)).otherwise(F.col("source"))
    shard = F.concat(F.lit("#"), F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("string"))
    return _key(host), F.when(cut > 0, F.concat(F.lit("/"), F.expr("substring(source, instr(source, '/') + 1)"))).otherwise(shard) if path is None else _key(path)


class QualityModel:
    """A fitted classifier (w None: nothing to learn from) and the sums of hosts and paths."""

    def __init__(self, w, mean, scale, rate: float, strong_host: Column, strong_path: Column, sums: DataFrame, pseudo: float):
        self.w, self.mean, self.scale, self.rate, self.pseudo = w, mean, scale, rate, pseudo
        self.strong_host, self.strong_path, self.sums = strong_host, strong_path, sums

    def decide(self, table: DataFrame, keep: float) -> DataFrame:
        """table: host, path, evidence and any others; adds host_rate, path_rate, quality, kept.
        The sums have a row for each path; Spark broadcasts them only below its own threshold."""
        own, rate, w = F.col("evidence"), F.lit(self.rate), F.lit(self.pseudo)
        out = table.join(self.sums, ["host", "path"])
        out = out.withColumn("host_rate", _shrunk(F.col("host_good") - w * own, F.col("host_n") - w, rate, self.strong_host))
        out = out.withColumn("path_rate", _shrunk(F.col("path_good") - w * own, F.col("path_n") - w, F.col("host_rate"), self.strong_path))
        odds = lambda p: F.log(p / (1 - p))
        bounded = F.least(F.greatest(F.col("path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
        out = out.withColumn("quality", 1 / (1 + F.exp(-(odds(own) + odds(bounded) - odds(rate)))))
        return out.withColumn("kept", F.col("quality") >= keep)


def _evidence(x: np.ndarray, w, mean, scale) -> np.ndarray:
    if w is None:
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale * w[:-1]).sum(axis=1) + w[-1], -12, 12)))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, pseudo: float = 0.5, host: Column | None = None, path: Column | None = None, text_col: str = "text") -> tuple[QualityModel, DataFrame]:
    """The model, and the documents' table: doc_id, host, path, evidence."""
    host, path = site(host, path)
    table = written(feature_table(docs, {"doc_id": F.col("doc_id"), "host": host, "path": path}, text_col), "features")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = written(table.join(known, "doc_id"), "labelled")
    n = known.count()
    # Least hashes: a bound that the sample's stay under first, so that a task sorts about that many rows.
    hashed = known.select("x", "label", F.xxhash64("doc_id").alias("h"), "doc_id").where(F.col("h") <= min(2**63 - 1, int(1.2 * sample / max(n, 1) * 2**64) - 2**63))
    rows = hashed.orderBy("h", "doc_id", "x").limit(sample).collect()  # at most ``sample``
    y = np.array([r["label"] for r in rows], float)
    fitted = fit_logistic(np.array([r["x"] for r in rows]), y) if len(set(y.tolist())) > 1 else (None, None, None)

    def evidence(batches):
        for b in batches:
            x = np.asarray(b["x"].flatten()).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["host"], b["path"], pa.array(_evidence(x, *fitted))], ["doc_id", "host", "path", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = written(table.mapInArrow(evidence, f"doc_id {kind}, host string, path string, evidence double"), "evidence")
    scores = table.select("host", "path", F.lit(float(pseudo)).alias("n"), (F.col("evidence") * pseudo).alias("good"))
    outcomes = known.select("host", "path", F.lit(1.0).alias("n"), F.col("label").cast("double").alias("good")) if fitted[0] is not None else scores.limit(0)
    paths = written(scores.unionByName(outcomes).groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = float(min(max((whole["good"] or 0.0) / (whole["n"] or 1), 1e-3), 1 - 1e-3))
    strong_host = _strength(hosts.withColumn("centre", F.lit(rate)), "centre")
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), _shrunk(F.col("good"), F.col("n"), F.lit(rate), strong_host).alias("centre"))
    paths = written(paths.join(hosts, "host"), "path-sums")
    strong_path = _strength(paths, "centre")
    sums = paths.select("host", "path", "host_n", "host_good", F.col("n").alias("path_n"), F.col("good").alias("path_good"))
    return QualityModel(*fitted, rate, strong_host, strong_path, sums, pseudo), table


def score_quality(docs: DataFrame, labels: DataFrame, keep: float = 0.5, **options) -> DataFrame:
    """op8: doc_id, evidence (the classifier's probability that the document is good), host_rate and
    path_rate (posterior rates without the document), quality and kept, a row for each document."""
    model, table = fit_quality(docs, labels, **options)
    return model.decide(table, keep).select("doc_id", "evidence", "host_rate", "path_rate", "quality", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = 0.5, host: Column | None = None, path: Column | None = None, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are kept, all columns. Reads the texts once more rather than shuffle them."""
    model, _ = fit_quality(docs, labels, host=host, path=path, text_col=text_col, **options)
    w, mean, scale = model.w, model.mean, model.scale

    @F.arrow_udf("double")
    def evidence(text: pa.Array) -> pa.Array:
        release()
        x = np.array([features(t.as_py()) for t in text], float).reshape(len(text), len(FEATURES))
        return pa.array(_evidence(x, w, mean, scale))

    evidence = evidence.asNondeterministic()  # else the filter has it computed twice
    host, path = site(host, path)
    table = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), host.alias("host"), path.alias("path"), evidence(F.col(text_col)).alias("evidence"))
    return model.decide(table, keep).where("kept").select("row.*")
