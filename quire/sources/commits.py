"""Several tables that change together: data next to the old ones, then one manifest that readers follow."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit has come in between."""


class CorpusTables:
    """Tables of a corpus below ``root``. A commit writes new tables into a folder of its own and then a manifest, which
    names every table's folder. The manifest appears in one step, under the next number, so readers see all of a commit or
    nothing of it, and a run that is killed leaves what was there. Of two commits on one version the second one fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.root).getFileSystem(conf)
        self._rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf).rename
        self._options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def version(self) -> int:
        """The number of the latest commit, 0 if there is none."""
        folder = self._path(f"{self.root}/manifests")
        if not self._store.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._store.listStatus(folder)]
        return max((int(n[:12]) for n in names if n[:12].isdigit() and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"tables": {name: folder}, "job": name of the job that made it} of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "job": None}
        return json.loads("".join(r.value for r in self.spark.read.text(self._manifest(version)).collect()))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(version)["tables"][name])

    def done(self, job: str) -> int | None:
        """The version that a job has made, if it has."""
        return next((v for v in range(self.version(), 0, -1) if self._store.exists(self._path(self._manifest(v))) and self.manifest(v)["job"] == job), None)

    def commit(self, tables: dict[str, DataFrame], base: int | None = None, job: str | None = None) -> int:
        """Put new tables in the place of those of version ``base`` (the present one if not given); the others stay. A job
        that has been committed under its name is not committed again, so that it can be repeated. Gives the version."""
        if job is not None and (made := self.done(job)):
            return made
        base = self.version() if base is None else base
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        now = {"tables": self.manifest(base)["tables"] | {name: f"{folder}/{name}" for name in tables}, "job": job}
        self._publish(json.dumps(now), base + 1)
        return base + 1

    def _publish(self, text: str, version: int) -> None:
        self._store.mkdirs(self._path(f"{self.root}/manifests"))
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self._store.create(draft)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if self._store.exists(self._path(self._manifest(version))):
            raise Conflict(f"version {version} is there already")
        try:
            self._rename(draft, self._path(self._manifest(version)), self._options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there already") from e
            raise

    def clean(self, keep: int = 1) -> list[str]:
        """Delete the manifests before the latest ``keep``, and data that no manifest left names; gives the folders. Not
        to be called while a commit is being written."""
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1) if self._store.exists(self._path(self._manifest(v)))]
        named = {folder for v in kept for folder in self.manifest(v)["tables"].values()}
        for v in range(1, last):
            if v not in kept:
                self._store.delete(self._path(self._manifest(v)), False)
        gone = []
        for run in self._store.listStatus(self._path(f"{self.root}/data")):
            for table in self._store.listStatus(run.getPath()):
                folder = f"{self.root}/data/{run.getPath().getName()}/{table.getPath().getName()}"
                if folder not in named:
                    self._store.delete(table.getPath(), True)
                    gone.append(folder)
        return gone
