"""Tables with atomic commits on a plain folder.

A batch is written to a folder of its own; then one small manifest file names all folders that make up the table. Spark moves
that file into place when its job commits, so a reader sees the table before or after a batch, never half of one, and a
failure between the two leaves the old table. Batches have ids: committing one again changes nothing.

One writer at a time: two that commit the same version are told apart afterwards, one of them gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMMIT = "version long, token string, batch string, folders array<string>, batches array<string>, columns string"
MISSING = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


class CommitConflict(RuntimeError):
    """Another writer committed the same version."""


@dataclass(frozen=True)
class ManifestTable:
    """Parquet table under ``path``: data folders and the manifests that name the live ones."""

    spark: SparkSession
    path: str

    def _commits(self) -> list:
        """Committed manifests, newest first; of one version the smallest token stands."""
        try:
            found = self.spark.read.schema(COMMIT).json(f"{self.path}/_commits/*").collect()  # one row a commit
        except AnalysisException as error:
            if (error.getCondition() or "").split(".")[0] in MISSING:
                return []
            raise
        return sorted(found, key=lambda c: (-c["version"], c["token"]))

    def exists(self) -> bool:
        return bool(self._commits())

    def read(self) -> DataFrame:
        """The table as last committed."""
        commits = self._commits()
        if not commits:
            raise FileNotFoundError(f"nothing is committed under {self.path}")
        schema = T.StructType.fromJson(json.loads(commits[0]["columns"]))
        folders = [f"{self.path}/{f}" for f in commits[0]["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def batches(self) -> list[str]:
        """Ids of the batches in the table, oldest first."""
        commits = self._commits()
        return list(commits[0]["batches"]) if commits else []

    def append(self, df: DataFrame, batch: str | None = None, partition_by: Sequence[str] = ()) -> None:
        self._commit(df, batch, True, partition_by)

    def replace(self, df: DataFrame, batch: str | None = None, partition_by: Sequence[str] = ()) -> None:
        """The batch becomes the whole table. Readers that hold the old one still find its files."""
        self._commit(df, batch, False, partition_by)

    def rewrite(self, df: DataFrame) -> None:
        """Other files for the same content; the table's batches stay as they are."""
        self._commit(df, None, False, (), True)

    def _commit(
        self, df: DataFrame, batch: str | None, keep: bool, partition_by: Sequence[str], same_batches: bool = False
    ) -> None:
        before = self._commits()
        last = before[0] if before else None
        if batch is not None and last is not None and batch in last["batches"]:
            return  # a retry of a committed batch
        token = uuid.uuid4().hex
        batch = batch if batch is not None else token
        folder = f"data/{token}"
        self._write(df, folder, partition_by)
        version = last["version"] + 1 if last is not None else 1
        old_folders, old_batches = (last["folders"], last["batches"]) if last is not None and keep else ([], [])
        batches = list(last["batches"]) if same_batches and last is not None else [*old_batches, batch]
        row = (version, token, batch, [*old_folders, folder], batches, df.schema.json())
        self._publish(row)
        standing = next(c for c in self._commits() if c["version"] == version)
        if standing["token"] != token:
            raise CommitConflict(f"version {version} of {self.path} was committed by another writer")

    def _write(self, df: DataFrame, folder: str, partition_by: Sequence[str]) -> None:
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{self.path}/{folder}")

    def _publish(self, row: tuple) -> None:
        commit = self.spark.createDataFrame([row], COMMIT).coalesce(1)
        commit.write.mode("errorifexists").json(f"{self.path}/_commits/{row[0]:012d}-{row[1]}")
