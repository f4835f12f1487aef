"""Array containers (NPZ) as a data source: read by slices of rows and channels, written with a commit.

    spark.dataSource.register(ArrayContainers)
    spark.read.format("array_container").option("path", FOLDER).load()

A row is a channel's samples of one block: container, member, channel, first_row, samples.  An array's first axis
is rows (time), what follows are channels; one of one axis has a single channel.  Partitions come from the
container's directory and the arrays' headers, of which alone the driver reads anything.  A member that is stored
plain is cut into ranges of rows, of which each task reads its bytes and no others; a compressed one is a task,
since it has to be inflated from its start, in pieces.

Which members, rows and channels are wanted is told by the options `members`, `channels` (comma-separated), `first`
and `last`, or by filters: where the session pushes filters into Python sources
(spark.sql.python.filterPushdown.enabled), array_container_pushed takes comparisons of member, channel and first_row
with values for the same; read_containers chooses between the two.

Writing takes container, member, row, rows, width, kind and samples, in order within a partition (write_containers
brings them there).  A task writes a container beside its place; what all tasks wrote is renamed when the job
commits and deleted when it fails.  Samples are doubles in the table, whatever their kind in the container."""

from __future__ import annotations

import ast
import math
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "container STRING, member STRING, channel INT, first_row BIGINT, samples ARRAY<DOUBLE>"
_ARROW = pa.schema([("container", pa.string()), ("member", pa.string()), ("channel", pa.int32()), ("first_row", pa.int64()), ("samples", pa.list_(pa.float64()))])
_INFLATED = 1 << 20
WHOLE = 1 << 62


def store(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Member:
    """An array as a container's directory and its own header tell of it."""

    path: str
    name: str
    rows: int
    channels: int
    kind: str
    #: Of a plain member the first byte of its values; None for a compressed one.
    offset: int | None


@dataclass(frozen=True)
class Wanted:
    members: frozenset[str] | None = None
    channels: frozenset[int] | None = None
    first: int = 0
    last: int = WHOLE


class Slice(InputPartition):
    def __init__(self, member: Member, first: int, last: int):
        super().__init__((member, first, last))
        self.member, self.first, self.last = member, first, last


def header(stream) -> tuple[tuple[int, ...], str, int]:
    """Shape, type and length of an array file's header, from its public format: magic, version, length, a literal."""
    magic = stream.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    form, size = ("<H", 2) if magic[6] == 1 else ("<I", 4)
    length = struct.unpack(form, stream.read(size))[0]
    told = ast.literal_eval(stream.read(length).decode("latin1" if magic[6] < 3 else "utf8"))
    if told["fortran_order"] and len(told["shape"]) > 1:
        raise ValueError("arrays in column order are not read")
    if np.dtype(told["descr"]).hasobject:
        raise ValueError("arrays of objects are not read")
    return told["shape"], told["descr"], 8 + size + length


def directory(path: str) -> list[Member]:
    """The arrays of a container; of its bytes only the directory and the headers are read."""
    files, at = store(path)
    out = []
    with files.open_input_file(at) as raw, zipfile.ZipFile(raw) as whole:
        for info in whole.infolist():
            if not info.filename.endswith(".npy"):
                continue
            with whole.open(info) as stream:
                shape, kind, length = header(stream)
            offset = None
            if info.compress_type == zipfile.ZIP_STORED:
                raw.seek(info.header_offset)
                local = struct.unpack("<26x2H", raw.read(30))  # name and extra field lengths of the local header
                offset = info.header_offset + 30 + sum(local) + length
            rows = shape[0] if shape else 1
            out.append(Member(path, info.filename[:-4], rows, math.prod(shape[1:]), kind, offset))
    return out


def containers(path: str) -> list[str]:
    """The containers that paths (comma-separated files or folders) name, in order."""
    from pyarrow import fs

    out = []
    for one in filter(None, (p.strip() for p in path.split(","))):
        files, at = store(one)
        info = files.get_file_info(at)
        if info.type == fs.FileType.Directory:
            base = one.rstrip("/")
            out += [f"{base}/{f.base_name}" for f in files.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".npz")]
        elif info.type == fs.FileType.File:
            out.append(one)
        else:
            raise FileNotFoundError(one)
    return sorted(out)


class ArrayReader(DataSourceReader):
    """Options: path, members, channels, first, last, block (rows of a result row), slice_bytes (of a task)."""

    def __init__(self, options: dict[str, str]):
        listed = lambda name: frozenset(x.strip() for x in options[name].split(",")) if options.get(name) else None
        channels = listed("channels")
        self.path = options["path"]
        self.block = int(options.get("block", "4096"))
        self.slice_bytes = int(options.get("slice_bytes", str(1 << 26)))
        self.wanted = Wanted(listed("members"), None if channels is None else frozenset(map(int, channels)), int(options.get("first", "0")), int(options.get("last", str(WHOLE))))

    def partitions(self) -> list[Slice]:
        out = []
        for path in containers(self.path):
            for member in directory(path):
                if self.wanted.members is not None and member.name not in self.wanted.members:
                    continue
                # whole blocks, so that a result row is the same however much is read
                first = max(0, self.wanted.first) // self.block * self.block
                last = min(member.rows - 1, self.wanted.last)
                if first > last:
                    continue
                step = WHOLE
                if member.offset is not None:
                    row = max(1, member.channels * np.dtype(member.kind).itemsize)
                    step = max(1, self.slice_bytes // row // self.block) * self.block
                out += [Slice(member, a, min(last, a + step - 1)) for a in range(first, last + 1, step)]
        return out or [Slice(Member("", "", 0, 0, "<f8", None), 0, -1)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        member = part.member
        if part.first > part.last:
            return
        chosen = range(member.channels) if self.wanted.channels is None else sorted(c for c in self.wanted.channels if 0 <= c < member.channels)
        if not chosen:
            return
        name = part.member.path.rsplit("/", 1)[-1]
        for at, values in self.blocks(part):
            # the asked-for rows of the block
            low, high = max(at, self.wanted.first), min(at + len(values) - 1, self.wanted.last)
            if low > high:
                continue
            values = values[low - at : high - at + 1]
            samples = pa.array([np.ascontiguousarray(values[:, c], dtype="f8") for c in chosen], pa.list_(pa.float64()))
            n = len(chosen)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([member.name] * n), pa.array(list(chosen), pa.int32()), pa.array([low] * n, pa.int64()), samples], schema=_ARROW)

    def blocks(self, part: Slice) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of the slice with their first row."""
        member, kind = part.member, np.dtype(part.member.kind)
        row = member.channels * kind.itemsize
        files, at = store(member.path)
        with files.open_input_file(at) as raw:
            if member.offset is not None:
                for first in range(part.first, part.last + 1, self.block):
                    n = min(self.block, part.last + 1 - first)
                    raw.seek(member.offset + first * row)
                    yield first, np.frombuffer(raw.read(n * row), dtype=kind).reshape(n, member.channels)
                return
            with zipfile.ZipFile(raw) as whole, whole.open(f"{member.name}.npy") as stream:
                header(stream)
                left = part.first * row
                while left:
                    left -= len(stream.read(min(left, _INFLATED)))
                for first in range(part.first, part.last + 1, self.block):
                    n = min(self.block, part.last + 1 - first)
                    yield first, np.frombuffer(stream.read(n * row), dtype=kind).reshape(n, member.channels)


class PushedReader(ArrayReader):
    """The same, told by filters too; Spark refuses it in sessions that push none."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            now = self.wanted
            if name == "member" and isinstance(f, (EqualTo, In)):
                told = frozenset(f.value if isinstance(f, In) else (f.value,))
                self.wanted = replace(now, members=told if now.members is None else now.members & told)
            elif name == "channel" and isinstance(f, (EqualTo, In)):
                told = frozenset(f.value if isinstance(f, In) else (f.value,))
                self.wanted = replace(now, channels=told if now.channels is None else now.channels & told)
            elif name == "first_row" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                begin = f.value + isinstance(f, GreaterThan)
                if begin > now.first:  # result rows begin at blocks
                    self.wanted = replace(now, first=-(-begin // self.block) * self.block)
                yield f
            elif name == "first_row" and isinstance(f, (LessThan, LessThanOrEqual)):
                begin = f.value - isinstance(f, LessThan)
                self.wanted = replace(now, last=min(now.last, begin // self.block * self.block + self.block - 1))
                yield f
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    #: (where it is, where it is to be)
    moves: list[tuple[str, str]]


class ArrayWriter(DataSourceArrowWriter):
    """Options: path, compressed (true).  Rows: container, member, row, rows, width, kind, samples."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.method = zipfile.ZIP_DEFLATED if options.get("compressed", "true").lower() == "true" else zipfile.ZIP_STORED
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(self.path)
        files.create_dir(root, recursive=True)
        moves: list[tuple[str, str]] = []
        seen: set[str] = set()
        container = member = stream = whole = raw = None
        wanted = count = 0

        def end_member() -> None:
            nonlocal stream
            if stream is not None:
                stream.close()
                stream = None
                if count != wanted:
                    raise ValueError(f"{container}: {member} has {count} of {wanted} rows")

        def end_container() -> None:
            nonlocal whole
            end_member()
            if whole is not None:
                whole.close()
                raw.close()
                whole = None

        try:
            for batch in iterator:
                names, members, starts, rows, widths, kinds, samples = (batch.column(batch.schema.get_field_index(c)) for c in ("container", "member", "row", "rows", "width", "kind", "samples"))
                for i in range(batch.num_rows):
                    name, own = names[i].as_py(), members[i].as_py()
                    if name != container:
                        end_container()
                        if name in seen or "/" in name:
                            raise ValueError(f"rows of {name} are not together" if name in seen else f"{name} is no file name")
                        seen.add(name)
                        container, member = name, None
                        part = f"{root}/{name}.npz.{self.job}-{uuid.uuid4().hex[:8]}.partial"
                        moves.append((part, f"{root}/{name}.npz"))
                        raw = files.open_output_stream(part)
                        whole = zipfile.ZipFile(raw, "w", self.method)
                    if own != member:
                        end_member()
                        member, wanted, count = own, rows[i].as_py(), 0
                        kind, width = np.dtype(kinds[i].as_py()), widths[i].as_py()
                        stream = whole.open(f"{own}.npy", "w", force_zip64=True)
                        shape = (wanted,) if width == 0 else (wanted, width)
                        np.lib.format.write_array_header_1_0(stream, {"descr": kind.str, "fortran_order": False, "shape": shape})
                    if starts[i].as_py() != count:
                        raise ValueError(f"{name}: {own} lacks row {count}")
                    values = np.asarray(samples[i].values, dtype=kind)
                    if len(values) != max(1, width):
                        raise ValueError(f"{name}: {own} has {len(values)} values in row {count}")
                    stream.write(values.tobytes())
                    count += 1
            end_container()
        except BaseException:
            # what an open archive would still write is no longer wanted
            for part, _ in moves:
                _drop(files, part)
            raise
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        moves = [m for told in messages if told for m in told.moves]
        targets = [final for _, final in moves]
        if len(set(targets)) != len(targets):
            self.abort(messages)
            raise ValueError("a container was written by two tasks")
        for part, final in moves:
            files.move(part, final)
        if self.overwrite:
            from pyarrow import fs

            files.create_dir(root, recursive=True)
            kept = {final.rsplit("/", 1)[-1] for final in targets}
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.base_name.endswith(".npz") and f.base_name not in kept:
                    files.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes what this job's tasks left, whether they told of it or not."""
        from pyarrow import fs

        files, root = store(self.path)
        if files.get_file_info(root).type == fs.FileType.Directory:
            for f in files.get_file_info(fs.FileSelector(root)):
                if f".npz.{self.job}-" in f.base_name:
                    _drop(files, f.path)


def _drop(files, path: str) -> None:
    try:
        files.delete_file(path)
    except FileNotFoundError:
        pass


class ArrayContainers(DataSource):
    """spark.read.format("array_container"), df.write.format("array_container")."""

    @classmethod
    def name(cls) -> str:
        return "array_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, overwrite)


class PushedArrayContainers(ArrayContainers):
    """spark.read.format("array_container_pushed"), for sessions that push filters into Python sources."""

    @classmethod
    def name(cls) -> str:
        return "array_container_pushed"

    def reader(self, schema) -> PushedReader:
        return PushedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayContainers)
    spark.dataSource.register(PushedArrayContainers)


def write_containers(arrays: DataFrame, path: str, compressed: bool = True, mode: str = "append") -> None:
    """arrays: container, member, row (from 0), samples (a row's channels; one value for arrays of one axis) and,
    where they are known, kind (a numpy type, '<f8' where missing) and flat (an array of one axis).

    A container is written by one task, row by row, so it may be larger than memory."""
    register(arrays.sparkSession)
    rows = arrays if "kind" in arrays.columns else arrays.withColumn("kind", F.lit("<f8"))
    rows = rows if "flat" in rows.columns else rows.withColumn("flat", F.lit(False))
    sizes = arrays.groupBy("container", "member").agg(F.count("*").cast("long").alias("rows"))
    full = rows.select("container", "member", F.col("row").cast("long").alias("row"), F.when(F.col("flat"), 0).otherwise(F.size("samples")).cast("int").alias("width"), "kind", F.col("samples").cast("array<double>").alias("samples"))
    full = full.join(sizes, ["container", "member"]).select("container", "member", "row", "rows", "width", "kind", "samples")
    ordered = full.repartition("container").sortWithinPartitions("container", "member", "row")
    ordered.write.format("array_container").option("path", path).option("compressed", str(compressed).lower()).mode(mode).save()


def read_containers(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """members, channels, first, last, block and slice_bytes as of the reader."""
    register(spark)
    told = {k: ",".join(map(str, v)) if isinstance(v, (list, tuple, set, frozenset, range)) else str(v) for k, v in options.items() if v is not None}
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true"
    return spark.read.format("array_container_pushed" if pushed else "array_container").options(**told).load(path)
