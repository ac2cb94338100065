"""Annotation tables of datasets: a folder tree of Parquet, local copies with a manifest, and
sources tried in turn. Remote hubs are functions that the caller gives; there is none here."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MANIFEST, COMPLETE = "_manifest.json", ".complete"


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files at any depth below a folder as one table; an error if there are none."""
    if "://" not in folder and not any(Path(folder).rglob("*.parquet")):
        raise FileNotFoundError(f"no Parquet files below {folder}")
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)


def is_complete(folder: str) -> bool:
    return (Path(folder) / COMPLETE).exists()


def materialize(source: Callable[[], DataFrame], folder: str, **about) -> DataFrame:
    """The table of ``source``, kept in a folder: written with a manifest, and marked complete last. A
    folder without the mark is of a broken run and is written anew; one with it is read, not fetched."""
    at = Path(folder)
    if is_complete(folder):
        return read_tree(SparkSession.getActiveSession(), f"{folder}/data")
    df = source()
    df.write.mode("overwrite").parquet(f"{folder}/data")
    files = sorted(str(p.relative_to(at)) for p in (at / "data").rglob("*.parquet"))
    (at / MANIFEST).write_text(json.dumps({"files": files, "columns": df.columns, **about}, sort_keys=True))
    (at / COMPLETE).touch()
    return read_tree(df.sparkSession, f"{folder}/data")


def manifest(folder: str) -> dict:
    return json.loads((Path(folder) / MANIFEST).read_text())


def load_annotations(spark: SparkSession, name: str, split: str, root: str | None = None, backend: str = "auto", hubs: dict[str, Callable[[str, str], DataFrame]] | None = None) -> DataFrame:
    """The annotation table of a task's split. backend: ``local`` (root/name/split, or root/name), the name
    of a hub, or ``auto``: local, then each hub in order. What every source said is in the error."""
    hubs = hubs or {}
    if backend not in ("auto", "local", *hubs):
        raise ValueError(f"no such backend: {backend}")
    tries: list[tuple[str, Callable[[], DataFrame]]] = []
    if backend in ("auto", "local") and root:
        tries += [("local", lambda p=p: read_tree(spark, p)) for p in (f"{root}/{name}/{split}", f"{root}/{name}")]
    tries += [(h, lambda f=f: f(name, split)) for h, f in hubs.items() if backend in ("auto", h)]
    said = []
    for source, get in tries:
        try:
            return get()
        except Exception as e:  # noqa: BLE001 - the next source may have it
            said.append(f"{source}: {e}")
    raise FileNotFoundError(f"no annotations of {name}/{split}: " + "; ".join(said or ["no source was given"]))
