"""Export of raw tables to an immutable, checked revision: window, duplicates, conflicts, partitioned Parquet, manifest.

A revision is a directory ``rev-NNNN`` with one directory of files for each dataset and ``manifest.json``; ``CURRENT``
names the one to read. The same content is never published twice. Manifest, lock and rename are work of the driver on
one file system; rows are read, mapped, checked and written by tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from contextlib import contextmanager
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.aggregates import content_digest
from weftline.operators.joins import key_difference
from weftline.sources.catalog import CATALOG, Dataset
from weftline.sources.mappers import map_rows

SAMPLES = 20


def in_window(rows: DataFrame, at: str | None, since: datetime | None, until: datetime | None) -> DataFrame:
    """Rows of [since, until); rows without a time stay."""
    if at is None or (since is None and until is None):
        return rows
    inside = F.lit(True)
    if since is not None:
        inside = inside & (F.col(at) >= F.lit(since))
    if until is not None:
        inside = inside & (F.col(at) < F.lit(until))
    return rows.where(F.col(at).isNull() | inside)


def conflicts(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys with more than one different row."""
    return rows.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def write_dataset(rows: DataFrame, dataset: Dataset, path: str) -> None:
    """Parquet with zstd, by UTC date where there is a time column; sorted inside files. The date is a column, too."""
    if dataset.at is None or rows.isEmpty():
        rows.coalesce(1).sortWithinPartitions(*dataset.sort).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return
    date = F.coalesce(F.date_format(dataset.at, "yyyy-MM-dd"), F.lit("unknown"))
    dated = rows.withColumn("date", date).withColumn("date_p", date)
    # REBALANCE splits a date that is too large for one task
    dated.hint("rebalance", "date_p").sortWithinPartitions("date_p", *dataset.sort).write.mode("overwrite").option("compression", "zstd").partitionBy("date_p").parquet(path)


def _files(path: Path) -> list[dict]:
    return [{"path": str(p.relative_to(path.parent)), "bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in sorted(path.rglob("*.parquet"))]


def _put(path: Path, value) -> None:
    part = path.with_suffix(".part")
    part.write_text(json.dumps(value, sort_keys=True, indent=1, default=str))
    os.replace(part, path)


@contextmanager
def lock(root: Path, patience: float = 10.0):
    """One publisher at a time."""
    name, until = root / "LOCK", time.monotonic() + patience
    while True:
        try:
            os.close(os.open(name, os.O_CREAT | os.O_EXCL))
            break
        except FileExistsError:
            if time.monotonic() > until:
                raise TimeoutError(f"{name} is held") from None
            time.sleep(0.1)
    try:
        yield
    finally:
        name.unlink(missing_ok=True)


def revisions(root: str | Path) -> list[str]:
    return sorted(p.name for p in Path(root).glob("rev-*") if (p / "manifest.json").exists())


def current(root: str | Path) -> Path:
    """The revision to read; a missing or broken pointer is read as the newest revision."""
    root = Path(root)
    name = (root / "CURRENT").read_text().strip() if (root / "CURRENT").exists() else ""
    known = revisions(root)
    if not known:
        raise LookupError(f"{root} has no revision")
    return root / (name if name in known else known[-1])


def export(spark: SparkSession, raw: dict[str, DataFrame], root: str, datasets: list[str] | None = None, since: datetime | None = None, until: datetime | None = None) -> dict:
    """Map, check and publish; returns the manifest with ``status`` published or unchanged.

    A dataset whose source table is absent is unavailable, not empty. Conflicting keys stop the export."""
    base = Path(root)
    base.mkdir(parents=True, exist_ok=True)
    stage = base / f".stage-{os.getpid()}-{time.time_ns()}"
    counters: dict[str, dict] = {}
    for name in datasets or list(CATALOG):
        dataset = CATALOG[name]
        if dataset.source not in raw:
            counters[name] = {"status": "unavailable", "reason": f"no table {dataset.source}"}
            continue
        table = raw[dataset.source]
        good, bad = map_rows(name, table)
        good = good.persist()
        kept = in_window(good, dataset.at, since, until)
        rows = kept.distinct()
        if sample := conflicts(rows, dataset.key).limit(5).collect():
            raise ValueError(f"{name}: different rows for one key: {[tuple(r) for r in sample]}")
        write_dataset(rows, dataset, str(stage / name))
        written = spark.read.schema(dataset.schema).parquet(*[str(p) for p in sorted((stage / name).rglob("*.parquet"))])
        n_good, n_kept = good.count(), kept.count()
        before, after = content_digest(rows, dataset.schema.names).first(), content_digest(written, dataset.schema.names).first()
        if before != after or key_difference(rows, written, list(dataset.key)).limit(1).count():
            raise ValueError(f"{name}: what was written differs from what was mapped")
        counters[name] = {"status": "ok", "source_rows": table.count(), "rejected": bad.count(), "reject_samples": [r.reject_reason for r in bad.orderBy("reject_reason").limit(SAMPLES).collect()], "candidates": n_good, "out_of_window": n_good - n_kept, "duplicates": n_kept - before.rows, "written": after.rows, "schema_version": dataset.version, "digest": [int(x) for x in after], "files": _files(stage / name)}
        good.unpersist()
    content = hashlib.sha256(json.dumps({k: v.get("digest", v["status"]) for k, v in sorted(counters.items())}, sort_keys=True).encode()).hexdigest()
    manifest = {"content_id": content, "since": since, "until": until, "datasets": counters}
    with lock(base):
        known = revisions(base)
        for name in known:
            if json.loads((base / name / "manifest.json").read_text())["content_id"] == content:
                (base / "CURRENT").write_text(name)
                _drop(stage)
                return manifest | {"status": "unchanged", "revision": name}
        name = f"rev-{1 + max([0, *(int(x[4:]) for x in known)]):04}"
        stage.mkdir(exist_ok=True)
        _put(stage / "manifest.json", manifest)
        os.rename(stage, base / name)
        (base / "CURRENT.part").write_text(name)
        os.replace(base / "CURRENT.part", base / "CURRENT")
    return manifest | {"status": "published", "revision": name}


def _drop(path: Path) -> None:
    for p in sorted(path.rglob("*"), reverse=True):
        p.rmdir() if p.is_dir() else p.unlink()
    if path.exists():
        path.rmdir()
