"""SQL and reports over one published revision."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.aggregates import content_digest
from weftline.sources.catalog import CATALOG, SCHEMA_VERSION
from weftline.sources.export import current


class ExportView:
    """Datasets of a revision, read from exactly the files of its manifest. Missing or cut files are refused."""

    def __init__(self, spark: SparkSession, root: str, revision: str | None = None, check_hashes: bool = False):
        self.spark = spark
        self.path = Path(root) / revision if revision else current(root)
        self.manifest = json.loads((self.path / "manifest.json").read_text())
        self.missing: dict[str, str] = {}
        self._files: dict[str, list[str]] = {}
        for name, info in self.manifest["datasets"].items():
            if info["status"] != "ok":
                self.missing[name] = info["reason"]
            elif info["schema_version"] != SCHEMA_VERSION:
                self.missing[name] = f"schema version {info['schema_version']}"
            else:
                for f in info["files"]:
                    p = self.path / f["path"]
                    if not p.exists() or p.stat().st_size != f["bytes"]:
                        raise FileNotFoundError(f"{p} is missing or cut")
                    if check_hashes and hashlib.sha256(p.read_bytes()).hexdigest() != f["sha256"]:
                        raise ValueError(f"{p} has changed")
                self._files[name] = [str(self.path / f["path"]) for f in info["files"]]

    @property
    def available(self) -> set[str]:
        return set(self._files)

    def require(self, *names: str) -> None:
        if lacking := [n for n in names if n not in self._files]:
            raise LookupError(f"not in this revision: {', '.join(lacking)}")

    def table(self, name: str) -> DataFrame:
        self.require(name)
        rows = self.spark.read.schema(CATALOG[name].schema).parquet(*self._files[name])
        return rows.withColumn("date", F.coalesce(F.date_format(CATALOG[name].at, "yyyy-MM-dd"), F.lit("unknown"))) if CATALOG[name].at else rows

    def sql(self, query: str, **args) -> DataFrame:
        """A query over all available datasets by name, with bound parameters."""
        for name in self._files:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query, args=args)

    def validate(self) -> list[str]:
        """Differences between the files and the manifest."""
        found = []
        for name in sorted(self._files):
            info, dataset = self.manifest["datasets"][name], CATALOG[name]
            rows = self.table(name).select(*dataset.schema.names)
            if [int(x) for x in content_digest(rows, dataset.schema.names).first()] != info["digest"]:
                found.append(f"{name}: content differs")
            if rows.select(*dataset.key).distinct().count() != info["written"]:
                found.append(f"{name}: keys are not distinct")
            if not dataset.fanout and info["candidates"] + info["rejected"] != info["source_rows"]:
                found.append(f"{name}: rows are not accounted for")
            if info["candidates"] - info["out_of_window"] - info["duplicates"] != info["written"]:
                found.append(f"{name}: counts do not add up")
        return found


def iso_times(rows: DataFrame) -> DataFrame:
    """Timestamps as ISO-8601 text with microseconds, for output."""
    return rows.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c) if t in ("timestamp", "timestamp_ntz") else F.col(c) for c, t in rows.dtypes])


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated values with a header; nulls are empty."""
    iso_times(rows).write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    iso_times(rows).write.mode("overwrite").json(path)
