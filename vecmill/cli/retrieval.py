"""python -m vecmill.cli.retrieval MANIFEST: a retrieval benchmark over a manifest of queries and candidates."""

from __future__ import annotations

import argparse
import json

from ..operators import quantizers as Q
from ..operators import retrieval, search, structure
from ..session import build_session
from ..sources import artifacts

BACKENDS = ("exact", "pq", "opq", "pca_bits", "uneven")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("manifest", nargs="+", help="a JSON-lines manifest for each task")
    p.add_argument("--backend", choices=BACKENDS, default="exact")
    p.add_argument("--bits", type=int, default=64)
    p.add_argument("--dim", type=int, default=64)
    p.add_argument("--k", nargs="+", type=int, default=list(retrieval.KS))
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--limit", type=int)
    p.add_argument("--train-pool", action="store_true", help="train on the distinct corpora of all tasks")
    p.add_argument("--save-rankings")
    p.add_argument("--summary")
    return p


def fitter(backend: str, bits: int):
    def uneven(df):
        s = structure.find(df, bits)
        return Q.fit_uneven(df, s.groups, s.nbits, rotate=False)

    return {"exact": None, "pq": lambda df: Q.fit_pq(df, bits // 8), "opq": lambda df: Q.fit_opq(df, bits), "pca_bits": lambda df: Q.fit_pca_bits(df, bits), "uneven": uneven}[backend]


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session()
    embedder = retrieval.HashEmbedder(a.dim)
    tasks = {path: artifacts.read_manifest(spark, path, path.rsplit("/", 1)[-1].split(".")[0], a.limit) for path in a.manifest}
    train = None
    if a.train_pool:
        pool = retrieval.distinct_corpus([c for _, c in tasks.values()]).selectExpr("xxhash64(signature) as key", "parts")
        train = embedder.embed(pool, False).selectExpr("key as vec_id", "vector as embedding").where("embedding is not null").persist()
    top = retrieval.promoted(a.top, tuple(a.k))
    for path, (queries, corpus) in tasks.items():
        index = search.VectorIndex(fitter(a.backend, a.bits), "dot" if a.backend == "exact" else "adc")
        metrics, rankings = retrieval.run_benchmark(queries, corpus, embedder, index, train, tuple(a.k), top)
        for r in metrics.orderBy("k").collect():
            print(json.dumps({"task": path, **r.asDict()}))
        if a.summary:
            artifacts.write_summary(metrics, a.summary)
        if a.save_rankings:
            artifacts.write_rankings(rankings, a.save_rankings)


if __name__ == "__main__":
    main()
