"""TAR archives as a data source: a partition for each archive, members streamed in order.

A compressed archive cannot be split, so it is one task's; many archives are many tasks. Members
are read as they pass by: nothing is extracted to disk, and the content of a member that no
predicate wants is skipped. Only plain files are rows. Links, devices and folders are not, nor are
members whose path is absolute or leads upwards.

    archive_members(spark, "file:///data/day.tar.gz").where(F.col("path").startswith("lot/"))
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

from bayline.operators.sampling import bottom_k

SCHEMA = "archive string, position long, path string, size long, content binary"
_PUSHED = (EqualTo, In, StringStartsWith, StringEndsWith)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def safe_path(name: str) -> bool:
    """Whether a member's path stays below the folder it would be unpacked in."""
    path = PurePosixPath(name)
    return bool(path.parts) and not path.is_absolute() and ".." not in path.parts and "\\" not in name


class ArchivePartition(InputPartition):
    """One archive."""

    def __init__(self, path: str) -> None:
        self.path = path


class ArchiveReader(DataSourceReader):
    """Streams the members of archives; predicates on path are tested before content is read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.content = options.get("content", "true").lower() == "true"
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Take equality, membership, prefixes and suffixes of the path; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, _PUSHED) and f.attribute == ("path",):
                self.wanted.append((type(f).__name__, f.value))
            else:
                yield f

    def _is_wanted(self, path: str) -> bool:
        tests = {"EqualTo": lambda v: path == v, "In": lambda v: path in v, "StringStartsWith": path.startswith, "StringEndsWith": path.endswith}
        return all(tests[kind](value) for kind, value in self.wanted)

    def partitions(self) -> list[InputPartition]:
        """Every archive of a folder, or the one archive."""
        system, path = _open(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pafs.FileType.File:
            return [ArchivePartition(self.path)]
        found = sorted(f.path for f in system.get_file_info(pafs.FileSelector(path)) if f.is_file and ".tar" in f.base_name or f.base_name.endswith(".tgz"))
        return [ArchivePartition(self.path.rstrip("/") + "/" + p.rsplit("/", 1)[-1]) for p in found]

    def read(self, partition: ArchivePartition) -> Iterator[tuple]:
        """Rows of SCHEMA."""
        system, path = _open(partition.path)
        with system.open_input_stream(path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
            for position, member in enumerate(archive):
                if not member.isfile() or not safe_path(member.name) or not self._is_wanted(member.name):
                    continue
                content = archive.extractfile(member).read() if self.content else None
                yield partition.path, position, member.name, member.size, content


class TarArchives(DataSource):
    """The format `tar-members`: options path (an archive or a folder of them) and content (false: names and sizes only)."""

    @classmethod
    def name(cls) -> str:
        return "tar-members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive_members(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """archive, position, path, size and content of the members of an archive, or of all archives of a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarArchives)
    return spark.read.format("tar-members").option("content", str(content).lower()).load(path)


def sampled_members(spark: SparkSession, path: str, partitions: DataFrame, limits: dict[str, int], seed: str = "archive") -> DataFrame:
    """Members by the bounded hash sample of each partition, with their content.

    partitions is (path, partition), such as paths joined with split lists. The first pass reads
    names only and keeps limits[partition] members of the least hash; the second reads the content
    of those alone, which its predicate on path lets the reader skip to.
    """
    named = archive_members(spark, path, content=False).select("path").join(partitions, "path")
    chosen = None
    for name, most in limits.items():
        part = bottom_k(named.where(F.col("partition") == name), ["partition"], "path", seed, most)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = {r["path"]: r["partition"] for r in chosen.collect()}  # sum of limits at most
    rows = archive_members(spark, path).where(F.col("path").isin(*found) if found else F.lit(False))
    given = spark.createDataFrame(list(found.items()), "path string, partition string")
    return rows.join(F.broadcast(given), "path")


def write_archives(rows: DataFrame, path: str, name: str, content: str) -> DataFrame:
    """Pack rows into gzipped archives, one for each task, and return (archive, members); nothing happens before that is read.

    Members are named by the column name. A task that is tried again writes its archive anew.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        archive = f"part-{TaskContext.get().partitionId():05d}.tar.gz"
        n = 0
        with system.open_output_stream(f"{folder}/{archive}", compression=None) as stream, tarfile.open(fileobj=stream, mode="w|gz") as out:
            for batch in batches:
                for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    member = tarfile.TarInfo(key)
                    member.size = len(body or b"")
                    out.addfile(member, io.BytesIO(body or b""))
                    n += 1
        yield pa.record_batch([pa.array([archive]), pa.array([n], pa.int64())], ["archive", "members"])

    return rows.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(pack, "archive string, members long")
