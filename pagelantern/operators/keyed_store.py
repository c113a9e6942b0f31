"""A stored table that keeps one row for each key: merges by bucket, with a manifest for each commit.

Rows lie in buckets by the hash of their keys, in `<folder>/data/v=<version>/bucket=<bucket>`. A commit is a small text file,
`<folder>/commits/<version>`, that names the version in which each bucket was last written. A merge reads the buckets that its
rows touch, writes these whole as its own version and then commits, by a rename; other buckets' files stay as they are. So
the cost of a merge follows the buckets it touches, a bucket is always one version's files (nothing is left to compact), a
reader opens only what the last commit names, and what a broken merge wrote is never seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """The newest row of each key, by the column `order` (its later value wins; of equal ones the row new to the store).

    A null key is a key like any other. `buckets` stays the same for a table's life; a bucket of more than `suited` rows is
    written by several tasks, a file each. One writer merges at a time, as a stream's batches do; a repeated merge, told by its version, has the same result.
    `keep` commits stay readable.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: str, buckets: int = 16, keep: int = 2, suited: int = 500_000):
        self.spark, self.folder, self.keys, self.order, self.buckets, self.keep = spark, folder.rstrip("/"), keys, order, buckets, keep
        self.suited = suited
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def versions(self) -> list[int]:
        """The versions that were committed and not cleaned up, ascending."""
        return sorted(int(n) for n in self._names(f"{self.folder}/commits") if n.isdigit())

    def manifest(self, version: int) -> dict[int, int]:
        """The version of each bucket's files at a commit; buckets without rows are not in it."""
        lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(self.fs.open(self._path(f"{self.folder}/commits/{version}")), "UTF-8")
        return {int(b): int(v) for b, v in (line.split(" ") for line in lines.split("\n") if line)}

    def _commit(self, version: int, manifest: dict[int, int]) -> None:
        made, final = self._path(f"{self.folder}/commits/.{version}"), self._path(f"{self.folder}/commits/{version}")
        out = self.fs.create(made, True)
        out.write("\n".join(f"{b} {v}" for b, v in sorted(manifest.items())).encode())
        out.close()
        self.fs.delete(final, False)
        if not self.fs.rename(made, final):
            raise RuntimeError(f"version {version} of {self.folder} could not be committed")

    def _files(self, manifest: dict[int, int], schema) -> DataFrame | None:
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in sorted(manifest.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def _schema(self, manifest: dict[int, int]):
        b, v = max(manifest.items(), key=lambda x: (x[1], x[0]))  # the newest files have all columns
        return self.spark.read.parquet(f"{self.folder}/data/v={v}/bucket={b}").schema

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows at a commit, the last one unless told; None before the first. Only the files it names are opened."""
        versions = self.versions()
        if version is None and not versions:
            return None
        manifest = self.manifest(versions[-1] if version is None else version)
        return self._files(manifest, self._schema(manifest)) if manifest else None

    def merge(self, rows: DataFrame, version: int) -> list[int]:
        """Merges rows as a version above all it builds on, and returns the buckets written.

        The merge builds on the last commit below `version`. A version that was committed is done: the same merge again, as after
        a failure of the writer, touches no file, so readers never miss one.
        """
        if version in self.versions():
            return sorted(b for b, v in self.manifest(version).items() if v == version)
        before = [v for v in self.versions() if v < version]
        old = self.manifest(before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = rows.withColumn("bucket", bucket).persist()
        try:
            counts = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # `buckets` rows at most
            touched, size = sorted(counts), sum(counts.values())
            known = {b: old[b] for b in touched if b in old}
            both = rows.withColumn("new_", F.lit(1))
            if known:
                stored = self._files(known, rows.drop("bucket").schema)
                size += stored.count()  # told by the files' footers
                both = both.unionByName(stored.withColumn("bucket", bucket).withColumn("new_", F.lit(0)))
            rest = [c for c in rows.columns if c not in (*self.keys, "bucket")]
            last = F.max_by(F.struct(*rest), F.struct(self.order, "new_")).alias("last_")
            if touched:
                # a bucket is one file, or several of about `suited` rows: one shuffle, and no task whose rows grow with the table
                parts = -(-size // (len(touched) * self.suited))
                part = F.pmod(F.xxhash64(F.lit(parts), *self.keys), F.lit(parts))
                tasks = len(touched) if parts == 1 else 2 * len(touched) * parts
                both = both.withColumn("part_", part).repartition(tasks, "bucket", "part_")
                newest = both.groupBy("bucket", "part_", *self.keys).agg(last).select("bucket", *self.keys, "last_.*")
                newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/v={version}")
        finally:
            rows.unpersist()
        self._commit(version, old | dict.fromkeys(touched, version))
        self.clean()
        return touched

    def clean(self) -> None:
        """Drops commits but the last `keep`, and bucket files that none of those names (a broken merge's too, once a later one is done)."""
        versions = self.versions()
        kept, gone = versions[-self.keep :], versions[: -self.keep]
        named = {(v, b) for c in kept for b, v in self.manifest(c).items()}
        for c in gone:
            self.fs.delete(self._path(f"{self.folder}/commits/{c}"), False)
        for name in self._names(f"{self.folder}/data"):
            v = int(name.split("=")[1])
            if v > kept[-1]:
                continue  # being written
            buckets = [int(b.split("=")[1]) for b in self._names(f"{self.folder}/data/{name}") if "=" in b]
            for b in buckets:
                if (v, b) not in named:
                    self.fs.delete(self._path(f"{self.folder}/data/{name}/bucket={b}"), True)
            if not any((v, b) in named for b in buckets):
                self.fs.delete(self._path(f"{self.folder}/data/{name}"), True)
