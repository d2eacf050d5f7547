"""Archives read by member and files read by range, each task seeking to its own bytes.

`archive_members` is a data source whose partitions are runs of members: of a zip by its central directory, of a plain
tar by its headers. No task reads what lies before its members, and none holds one whole but in the form `text`. A tar
inside one compressed stream has no places to seek to: one task streams it. `file_leaves` is a data source of digests of
fixed leaves of files, from which `tree_digest` makes one digest a file whatever the tasks' ranges were.

Both open files through Arrow's file systems (local folders, HDFS and object stores); `can_seek` says whether they know a
path's. Damaged members (a wrong length or checksum), encrypted ones and unknown formats are errors.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import tarfile
import threading
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of members that one task reads at most, unless a single member is longer; of a batch of rows; of a digest's leaf.
RUN_BYTES, BATCH_BYTES, LEAF_BYTES = 32 << 20, 1 << 20, 8 << 20
#: Digests that one inner node of the tree covers.
FAN = 1024
FORMS = {
    "lines": "path string, member string, place bigint, line string",
    "records": "path string, member string, place bigint, record string",
    "text": "path string, member string, text string",
}


_REGISTERING = threading.Lock()


def _register(spark: SparkSession, source: type[DataSource]) -> None:
    """Sources of a recipe are read side by side, and Spark may refuse a name that another thread has registered."""
    with _REGISTERING:
        try:
            spark.dataSource.register(source)
        except AnalysisException as refused:
            if refused.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
                raise


def _open(path: str):
    found, inner = _file_system(path)
    return found.open_input_file(inner)


def _file_system(path: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pa.fs.LocalFileSystem(), path) if path.startswith("/") else pa.fs.FileSystem.from_uri(path)


def can_seek(path: str) -> bool:
    """Whether tasks can open the path's file system."""
    try:
        _file_system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def found(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files that a path, a folder with all below it, or a pattern names, in order; hidden ones are left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for top in system.globStatus(hadoop) or ():
        listed = system.listFiles(top.getPath(), True)
        while listed.hasNext():
            one = listed.next()
            if not one.getPath().getName().startswith((".", "_")):
                out.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return sorted(out)


def files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of what `found` finds; nothing is an error."""
    if not (out := [(path, size) for path, size, _ in found(spark, pattern)]):
        raise FileNotFoundError(pattern)
    return out


class _Window(io.RawIOBase):
    """`length` bytes of a file from `start` on."""

    def __init__(self, file, start: int, length: int):
        self._file, self._left = file, length
        file.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self._file.read(min(len(into), self._left))
        if not data and self._left:
            raise EOFError("the archive ends inside a member")
        self._left -= len(data)
        into[: len(data)] = data
        return len(data)


class _Forward(io.RawIOBase):
    """A stream that is only read on, never sought in."""

    def __init__(self, source):
        self._source = source

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self._source.read(len(into))
        into[: len(data)] = data
        return len(data)


class _Checked(io.RawIOBase):
    """A zip member's bytes, inflated where it is deflated, held against its length and checksum."""

    def __init__(self, source: io.RawIOBase, deflated: bool, size: int, crc: int, name: str):
        self._source, self._inflate = source, zlib.decompressobj(-15) if deflated else None
        self._size, self._crc, self._name = size, crc, name
        self._seen = self._sum = 0

    def readable(self) -> bool:
        return True

    def _next(self, most: int) -> bytes:
        if self._inflate is None:
            return self._source.read(most)
        while not self._inflate.eof:
            data = self._inflate.unconsumed_tail or self._source.read(1 << 16)
            out = self._inflate.decompress(data, most)
            if out or not data:
                return out
        return b""

    def readinto(self, into) -> int:
        data = self._next(len(into))
        self._seen, self._sum = self._seen + len(data), zlib.crc32(data, self._sum)
        if not data and (self._seen, self._sum) != (self._size, self._crc):
            raise zipfile.BadZipFile(f"{self._name} is damaged")
        into[: len(data)] = data
        return len(data)


def _zip_member(file, entry: list) -> io.RawIOBase:
    name, at, method, packed, size, crc = entry
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return _Forward(zipfile.ZipFile(file).open(name))
    file.seek(at)
    header = file.read(30)
    if header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"{name} is not where the directory says")
    skip = int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little")
    return _Checked(_Window(file, at + 30 + skip, packed), method == zipfile.ZIP_DEFLATED, size, crc, name)


def _plan(path: str, wanted: re.Pattern, run_bytes: int) -> Iterator[tuple[str, str, list]]:
    """(kind, path, members) of each run."""
    with _open(path) as file:
        head = file.read(6)
        if head[:2] == b"PK":
            with zipfile.ZipFile(file) as archive:
                found = []
                for one in archive.infolist():
                    if one.is_dir() or not wanted.fullmatch(one.filename):
                        continue
                    if one.flag_bits & 1:
                        raise zipfile.BadZipFile(f"{one.filename} is encrypted")
                    found.append([one.filename, one.header_offset, one.compress_type, one.compress_size, one.file_size, one.CRC])
            kind, size = "zip", 4
        elif head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00":
            yield "stream", path, []
            return
        else:
            file.seek(0)
            with tarfile.open(fileobj=file, mode="r:") as archive:
                found = [[one.name, one.offset_data, one.size] for one in archive if one.isfile() and wanted.fullmatch(one.name)]
            kind, size = "tar", 2
    run, held = [], 0
    for entry in found:
        if run and held + entry[size] > run_bytes:
            yield kind, path, run
            run, held = [], 0
        run.append(entry)
        held += entry[size]
    if run:
        yield kind, path, run


class _Run(InputPartition):
    def __init__(self, kind: str, path: str, members: list):
        super().__init__(None)
        self.kind, self.path, self.members = kind, path, members


def _streams(run: _Run, wanted: re.Pattern) -> Iterator[tuple[str, io.RawIOBase]]:
    with _open(run.path) as file:
        if run.kind == "stream":
            with tarfile.open(fileobj=file, mode="r|*") as archive:
                for one in archive:
                    if one.isfile() and wanted.fullmatch(one.name):
                        yield one.name, _Forward(archive.extractfile(one))
            return
        for entry in run.members:
            yield entry[0], _zip_member(file, entry) if run.kind == "zip" else _Window(file, entry[1], entry[2])


def _records(text: io.TextIOBase, tag: str) -> Iterator[str]:
    """Whole elements of the tag, one inside no other."""
    opening, closing = re.compile(rf"<{re.escape(tag)}(?=[\s>])"), f"</{tag}>"
    held = ""
    while data := text.read(BATCH_BYTES):
        held += data
        at = 0
        while (start := opening.search(held, at)) and (end := held.find(closing, start.end())) >= 0:
            yield held[start.start() : end + len(closing)]
            at = end + len(closing)
        start = opening.search(held, at)
        held = held[start.start() :] if start else held[max(at, len(held) - len(tag) - 2) :]


class _MembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.form = json.loads(options["paths"]), options.get("form", "lines")
        self.wanted, self.encoding = re.compile(options.get("member", ".*")), options.get("encoding", "UTF-8")
        self.tag, self.run_bytes = options.get("tag", ""), int(options.get("run_bytes", RUN_BYTES))

    def partitions(self) -> list[_Run]:
        return [_Run(*run) for path in self.paths for run in _plan(path, self.wanted, self.run_bytes)] or [_Run("zip", "", [])]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = [c.split()[0] for c in FORMS[self.form].split(", ")]
        for member, stream in _streams(partition, self.wanted):
            text = io.TextIOWrapper(io.BufferedReader(stream, 1 << 16), self.encoding, "replace", newline=None if self.form == "lines" else "")
            if self.form == "text":
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (partition.path, member, text.read())], names=names)
                continue
            held, size, place = [], 0, 0
            for one in (line.rstrip("\r\n") for line in text) if self.form == "lines" else _records(text, self.tag):
                held.append(one)
                size += len(one)
                if size >= BATCH_BYTES:
                    yield self._batch(names, partition.path, member, place, held)
                    place, held, size = place + len(held), [], 0
            if held:
                yield self._batch(names, partition.path, member, place, held)

    @staticmethod
    def _batch(names: list[str], path: str, member: str, place: int, rows: list[str]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array(range(place, place + n), pa.int64()), pa.array(rows, pa.string())], names=names)


class ArchiveMembers(DataSource):
    """Options: paths (JSON list), form (lines, records or text), member (a pattern of whole names), encoding, tag (of records), run_bytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return FORMS[self.options.get("form", "lines")]

    def reader(self, schema) -> _MembersReader:
        return _MembersReader(dict(self.options))


def members(spark: SparkSession, path: str, form: str = "lines", member: str = ".*", encoding: str = "UTF-8", tag: str = "", run_bytes: int = RUN_BYTES) -> DataFrame:
    """Rows of the members whose whole names match, of all archives that path names; place counts a member's lines or records from 0."""
    _register(spark, ArchiveMembers)
    given = {"paths": json.dumps([p for p, _ in files(spark, path)]), "form": form, "member": member, "encoding": encoding, "tag": tag, "run_bytes": str(run_bytes)}
    return spark.read.format("archive_members").options(**given).load()


class _Leaves(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__(None)
        self.path, self.first, self.last = path, first, last


class _LeavesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.run = json.loads(options["files"]), max(1, int(options["run_bytes"]) // LEAF_BYTES)

    def partitions(self) -> list[_Leaves]:
        out = []
        for path, size in self.files:
            leaves = max(1, -(-size // LEAF_BYTES))
            out += [_Leaves(path, k, min(leaves, k + self.run)) for k in range(0, leaves, self.run)]
        return out

    def read(self, partition: _Leaves) -> Iterator[tuple]:
        with _open(partition.path) as file:
            file.seek(partition.first * LEAF_BYTES)
            for leaf in range(partition.first, partition.last):
                yield partition.path, leaf, hashlib.sha256(file.read(LEAF_BYTES)).hexdigest()


class FileLeaves(DataSource):
    """Options: files (JSON list of path and bytes), run_bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_leaves"

    def schema(self) -> str:
        return "path string, leaf bigint, digest string"

    def reader(self, schema) -> _LeavesReader:
        return _LeavesReader(dict(self.options))


def leaf_digests(spark: SparkSession, read: list[tuple[str, int]], run_bytes: int = RUN_BYTES) -> DataFrame:
    """(path, leaf, digest). Files of one leaf are read whole by Spark, and so are, up to 2 GB, those in whose file system tasks cannot seek; the others by ranges."""
    ranged = [(path, size) for path, size in read if size > LEAF_BYTES and can_seek(path)]
    in_ranges = set(ranged)
    whole = [path for path, size in read if size and (path, size) not in in_ranges]
    empty = [(path, 0, hashlib.sha256().hexdigest()) for path, size in read if not size]  # Spark leaves such files out
    out = spark.createDataFrame(empty, "path string, leaf bigint, digest string")
    if whole:
        cut = spark.read.format("binaryFile").load(whole).select("path", "content", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("length") / LEAF_BYTES) - 1).cast("int"))).alias("leaf"))
        out = out.unionByName(cut.select("path", F.col("leaf").cast("bigint").alias("leaf"), F.sha2(F.substring("content", F.col("leaf") * LEAF_BYTES + 1, F.lit(LEAF_BYTES)), 256).alias("digest")))
    if ranged:
        _register(spark, FileLeaves)
        out = out.unionByName(spark.read.format("file_leaves").option("files", json.dumps(ranged)).option("run_bytes", str(run_bytes)).load())
    return out


def tree_digest(leaves: DataFrame, most_leaves: int, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys.., digest): nodes of FAN digests, level by level; a node of one digest is that digest, so small files have their plain SHA-256."""
    while most_leaves > 1:
        node = leaves.groupBy(*keys, F.floor(F.col("leaf") / FAN).alias("node")).agg(F.sort_array(F.collect_list(F.struct("leaf", "digest"))).alias("below"))
        joined = F.sha2(F.array_join(F.col("below.digest"), ""), 256)
        leaves = node.select(*keys, F.col("node").alias("leaf"), F.when(F.size("below") == 1, F.col("below.digest")[0]).otherwise(joined).alias("digest"))
        most_leaves = -(-most_leaves // FAN)
    return leaves.select(*keys, "digest")


def digest(spark: SparkSession, path: str, run_bytes: int = RUN_BYTES) -> str:
    """One SHA-256 of all files that path names, by their contents alone: a tree over each file's leaves, then one over the files' sorted digests."""
    read = files(spark, path)
    each = tree_digest(leaf_digests(spark, read, run_bytes), max(1, max(-(-size // LEAF_BYTES) for _, size in read)))
    # One digest a file.
    return hashlib.sha256("".join(r["digest"] for r in each.orderBy("digest").toLocalIterator()).encode()).hexdigest()
