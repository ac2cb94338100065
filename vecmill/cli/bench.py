"""python -m vecmill.cli.bench DATASET BITS MODEL...: trains, codes and searches, and reports times and accuracy.

DATASET is a folder of vector files (``*base.fvecs``, ``*query.fvecs``, optional learn and groundtruth) or a Parquet
table of (vec_id, embedding), whose queries are then the rows whose id is divisible by 50.
"""

from __future__ import annotations

import argparse
import json
import time

from ..operators import metrics, search, structure
from ..operators import quantizers as Q
from ..session import build_session
from ..sources import artifacts, vecfile

MODELS = ("pq", "opq", "pca_bits", "uneven", "uneven_rotated", "residual", "product_residual", "local_search")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("dataset")
    p.add_argument("bits", type=int)
    p.add_argument("models", nargs="+", choices=MODELS)
    p.add_argument("--mode", choices=("adc", "sdc"), default="adc")
    p.add_argument("--structure", help="a structure file to use in place of a search")
    p.add_argument("--stages", default="full", help="grow, merge, moves; full or none")
    p.add_argument("--save-structure")
    p.add_argument("--most-bits", type=int, default=12)
    p.add_argument("--top", type=int, default=1000)
    p.add_argument("--threads", type=int, default=8)
    p.add_argument("--group-stats", action="store_true")
    return p


def main(argv: list[str] | None = None) -> list[dict]:
    a = parser().parse_args(argv)
    spark = build_session(a.threads, a.threads)
    try:
        files = vecfile.dataset_from_folder(a.dataset)
    except FileNotFoundError:
        base = spark.read.parquet(a.dataset)
        queries, learn = base.where("vec_id % 50 = 0"), base
    else:
        base, queries = (vecfile.read_vectors(spark, files[k]) for k in ("base", "query"))
        learn = vecfile.read_vectors(spark, files["learn"]) if files["learn"] else base
    top = min(a.top, base.count())
    truth = search.ground_truth(base, queries, top).persist()
    n, d = base.count(), len(base.first()["embedding"])
    found: structure.Structure | None = artifacts.load_structure(a.structure, d, a.bits) if a.structure else None
    out = []
    for name in a.models:
        began = time.perf_counter()
        if name.startswith("uneven") and found is None:
            found = structure.find(learn, a.bits, structure.parse_stages(a.stages), a.most_bits)
            if a.save_structure:
                artifacts.save_structure(found, a.save_structure)
        planned = time.perf_counter()
        if name == "pq":
            q = Q.fit_pq(learn, a.bits // 8, most_train=100_000)
        elif name == "opq":
            q = Q.fit_opq(learn, a.bits)
        elif name == "pca_bits":
            q = Q.fit_pca_bits(learn, a.bits, most=a.most_bits)
        elif name.startswith("uneven"):
            q = Q.fit_uneven(learn, found.groups, found.nbits, rotate=name.endswith("rotated"), most=a.most_bits)
        else:
            q = Q.fit_residual(learn, a.bits // 8 if name != "product_residual" else a.bits // 16, m=2 if name == "product_residual" else 1, refine=2 if name == "local_search" else 0)
        trained = time.perf_counter()
        codes = q.encode(base).persist()
        codes.count()
        coded = time.perf_counter()
        mode = "adc" if q.stages > 1 or name == "pca_bits" else a.mode
        result = (search.sdc_top_k if mode == "sdc" else search.adc_top_k)(q, codes, queries, top).persist()
        result.count()
        done = time.perf_counter()
        nq = queries.count()
        row = {"model": name, "mode": mode, "groups": len(q.groups), "structure_s": planned - began, "train_s": trained - planned}
        row |= {"encode_us_per_vector": metrics.timing(coded - trained, n)["us_per_row"], "queries_per_s": metrics.timing(done - coded, nq)["per_second"]}
        row |= {f"recall@{r['k']}": r["recall"] for r in metrics.recall_at(result, truth).collect()}
        row |= {f"overlap@{top}": metrics.overlap_at(result, truth, top, top).first()["overlap"]}
        row |= metrics.reconstruction_error(base, q.decoded(codes)).first().asDict()
        if a.group_stats:
            x = q.transform(Q.training_rows(learn, 20_480, 123))
            cost = structure.HoldoutCost(x, spark=spark)
            row["group_stats"] = structure.group_stats(name, q.kind, q.groups, q.nbits, cost)
        out.append(row)
        print(json.dumps(row))
    return out


if __name__ == "__main__":
    main()
