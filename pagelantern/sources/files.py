"""Code repositories and site files as folders of files: `<folder>/<owner>/<path>`, the owner a repository or a host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelantern.operators.codebase import ROLES

#: Files of a site by name.
SITE_KINDS = {"robots.txt": "robots", "sitemap.xml": "sitemap", "llms.txt": "llms", "llms-full.txt": "llms_full"}


def _home(spark: SparkSession, folder: str) -> str:
    """The folder as Spark tells it in the paths of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def tree(spark: SparkSession, folder: str, names: str | None = None, depth: int = 9) -> DataFrame:
    """owner, path, length and content (bytes) of the files below a folder, down to `depth` names below the owner.

    names: a glob on file names, e.g. `{robots.txt,*.xml}`; others are not read. Contents are read only where a query
    asks for them: a query of paths lists files. As in all of Spark's readers, empty files and files or folders whose names start
    with a dot or an underscore count as absent.
    """
    home = _home(spark, folder)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", names) if names else reader).load(folder)
    # tasks tell paths with or without the empty authority of a scheme (file:/x, file:///x)
    bare = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+:)/+", "$1/") if not isinstance(c, str) else c
    inside = F.substr(bare(F.col("path")), F.length(bare(F.lit(home))) + 2)
    parts = F.split(inside, "/", 2)
    rows = files.select(F.get(parts, 0).alias("owner"), F.get(parts, 1).alias("path"), "length", "content")
    return rows.where(F.col("path").isNotNull() & (F.size(F.split("path", "/")) <= depth))


def text(content):
    """Bytes as UTF-8 text, without a byte order mark; null if they are none."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")


def _store(home: str):
    """pyarrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(home if "://" in home else home.replace(":", "://", 1))


#: How many bytes of contents a task gathers before it hands them on.
BATCH = 8 << 20
FILES_SCHEMA = "repo string, path string, length long, content binary"
#: The paths that may have a role, their names, and the paths in lower case.
WANTED = {p for paths in ROLES.values() for p in paths}
WANTED_NAMES, WANTED_LOWER = {p.rsplit("/", 1)[-1] for p in WANTED}, {p.lower() for p in WANTED}


def _unlisted(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder by its name."""
    return name[0] == "." or name[0] == "_" and "=" not in name


def owners_in(spark: SparkSession, folder: str) -> DataFrame:
    """owner: the names of the folders directly below a folder, listed by one task; nothing below them is looked at."""
    home = _home(spark, folder)

    def listed(batches):
        import pyarrow as pa
        from pyarrow import fs

        for _ in batches:
            store, root = _store(home)
            found = [i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory]
            for k in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_pydict({"owner": found[k : k + 10_000]})

    return spark.range(1, numPartitions=1).mapInArrow(listed, "owner string")


def _repository(store, base: str, owner: str, most: int, hidden: bool, depth: int):
    """repo, path, length and content of each file of a repository, whose folder is `base`, as repository_files tells them."""
    from pyarrow import fs

    if not owner or _unlisted(owner):
        return
    for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
        if info.type != fs.FileType.File:
            continue
        path = info.path[len(base) + 1 :]
        parts = path.split("/")
        if any(map(_unlisted, parts)):
            if not (hidden and path in WANTED):
                continue
        elif not info.size or len(parts) > depth:
            continue
        content = None
        if info.size <= most and parts[-1] in WANTED_NAMES and path.lower() in WANTED_LOWER:
            with store.open_input_stream(info.path) as source:
                content = source.read()
        yield owner, path, info.size, content


def _gathered(rows):
    """Rows of repositories' files as record batches of about BATCH bytes."""
    import pyarrow as pa

    schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
    made = lambda rows: pa.RecordBatch.from_pydict({c: [r[k] for r in rows] for k, c in enumerate(schema.names)}, schema)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[3] or b"")
        if size > BATCH:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "path", text(F.col("content")).alias("content"))


def repository_files(spark: SparkSession, folder: str, most: int = 4 << 20, hidden: bool = True, owners: DataFrame | None = None, depth: int = 9) -> DataFrame:
    """repo, path and content of every file of the repositories in a folder, down to `depth` names below a repository.

    Only files whose name may have a role are opened, and only up to `most` bytes; of the others the path counts alone,
    and content is null, as it is for text that is not UTF-8. As in Spark's readers, empty files and names that begin with a dot
    or an underscore count as absent, but for files with a role, unless `hidden` is off.

    Repositories (owner), those named or all in the folder, are dealt over the tasks, which list and open their files through
    pyarrow: many small files are neither listed by the driver nor planned as parts of a scan. A store that pyarrow does not know
    is an error.
    """
    home = _home(spark, folder)

    def read(batches):
        store, root = _store(home)
        yield from _gathered(row for b in batches for owner in b.column(0).to_pylist() for row in _repository(store, f"{root}/{owner}", owner, most, hidden, depth))

    told = owners_in(spark, folder) if owners is None else owners.select(F.col("owner").cast("string").alias("owner")).distinct()
    return _told(dealt(told, "owner").mapInArrow(read, FILES_SCHEMA))


def written_and_read(files: DataFrame, folder: str, most: int = 4 << 20, hidden: bool = True, depth: int = 9, kept: int = 64) -> DataFrame:
    """What repository_files tells of files (owner, path, content: bytes or text) that are written below a folder, which all executors share.

    A task writes a repository, reads it from there and removes its files before it turns to the next, so few files stand at a time
    however many there are, and most go before the file system has given them blocks. Each attempt of a task has a folder of its own: one
    that is repeated or runs beside another meets none of its files. What a failed attempt leaves goes with the folder.
    Up to `kept` directories stay for the next repository. A null owner, path or content writes nothing. Where rows share owner
    and path, any of them is what stays.
    """
    home = _home(files.sparkSession, folder)

    def passed(batches):
        from pyspark import TaskContext

        store, root = _store(home)
        base = f"{root}/attempt-{TaskContext.get().taskAttemptId()}"
        made, used, written = set(), set(), set()  # directories that stand, those of them that this repository needs, and its files

        def write(path, content):
            inside = {path[:k] for k, c in enumerate(path) if c == "/"}
            if path in made - used:  # an empty directory of an earlier repository
                store.delete_dir(f"{base}/{path}")
                made.difference_update([d for d in made if f"{d}/".startswith(f"{path}/")])
            if not made or inside - made:
                store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
            made.update(inside, [""])
            used.update(inside)
            with store.open_output_stream(f"{base}/{path}") as out:
                out.write(content)
            written.add(path)

        def taken(owner):
            yield from _repository(store, base, owner, most, hidden, depth)
            for path in written:
                store.delete_file(f"{base}/{path}")
            if len(made) > kept:
                store.delete_dir(base)
                made.clear()
            used.clear()
            written.clear()

        def rows():
            at = None
            for b in batches:
                for owner, path, content in zip(*(b.column(k).to_pylist() for k in range(3))):
                    if at not in (None, owner):
                        yield from taken(at)
                    at = owner
                    write(path, content)
            if at is not None:
                yield from taken(at)

        yield from _gathered(rows())

    whole = files.select(F.col("owner").cast("string").alias("owner"), "path", F.col("content").cast("binary").alias("content")).dropna()
    return _told(dealt(whole, "owner").sortWithinPartitions("owner").mapInArrow(passed, FILES_SCHEMA))


def dealt(rows: DataFrame, owner: str) -> DataFrame:
    """Rows dealt by their owner over a few tasks for each core, as repositories differ in size."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), owner)


def remove_tree(owners: DataFrame, folder: str) -> None:
    """Removes the folders of owners below a folder, by tasks; one that is not there is no error."""
    spark = owners.sparkSession
    home = _home(spark, folder)

    def remove(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = _store(home)
        for b in batches:
            for owner in b.column(0).to_pylist():
                if owner and store.get_file_info(f"{root}/{owner}").type == fs.FileType.Directory:
                    store.delete_dir(f"{root}/{owner}")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    told = owners.select(F.col("owner").cast("string").alias("owner")).distinct()
    dealt(told, "owner").mapInArrow(remove, "n long").agg(F.sum("n")).collect()


def site_files(spark: SparkSession, folder: str, hosts: DataFrame) -> DataFrame:
    """host, kind and body for every host (one row a host) and kind of site file; an absent or undecodable file is null.

    A site's files lie directly in the folder of its host.
    """
    found = tree(spark, folder, "{" + ",".join(SITE_KINDS) + "}", depth=1)
    kind = F.coalesce(*(F.when(F.col("path") == name, kind) for name, kind in SITE_KINDS.items()))
    found = found.select(F.lower("owner").alias("host"), kind.alias("kind"), text(F.col("content")).alias("body"))
    kinds = F.explode(F.array(*(F.lit(k) for k in SITE_KINDS.values())))
    return hosts.select("host").distinct().withColumn("kind", kinds).join(found, ["host", "kind"], "left")


def write_tree(files: DataFrame, folder: str) -> None:
    """Writes files (owner, path, content: bytes or text) below a folder that all executors share, one file a row.

    A null content writes nothing. Tasks write whole files under their final names, so a repeated task writes the same
    again. Where rows share owner and path, any of them is what stays.
    """
    home = _home(files.sparkSession, folder)

    def write(batches):
        import pandas as pd

        store, root = _store(home)
        for b in batches:
            made = set()
            for owner, path, content in zip(b["owner"], b["path"], b["content"]):
                if content is None:
                    continue
                at = f"{root}/{owner}/{path}"
                if at.rsplit("/", 1)[0] not in made:
                    made.add(at.rsplit("/", 1)[0])
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(b)]})

    rows = files.select(F.col("owner").cast("string").alias("owner"), "path", F.col("content").cast("binary").alias("content"))
    rows.mapInPandas(write, "n long").agg(F.sum("n")).collect()
