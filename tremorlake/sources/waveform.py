"""Waveforms: HDF5 as a Python data source where h5py is there, blocks with a halo, and writers of blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tremorlake.schemas import WAVEFORM_BLOCK


class Hyperslab(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class WaveformReader(DataSourceReader):
    """Options: files (comma-separated), dataset, channels, channels_per_part, block_s, experiment."""

    def __init__(self, options: dict[str, str]):
        self.files = [f for f in options.get("files", options.get("path", "")).split(",") if f]
        #: A name, or empty for the only one that can be meant.
        self.dataset = options.get("dataset", "/default")
        self.channels = int(options["channels"]) if "channels" in options else None
        self.width = int(options.get("channels_per_part", "64"))
        self.block_s = float(options.get("block_s", "5"))
        self.experiment = options.get("experiment", "")

    def partitions(self) -> list[Hyperslab]:
        import h5py

        out = []
        for f in self.files:
            with h5py.File(f, "r") as handle:
                data = self.data(handle)
                n = data.shape[channel_axis(data.shape, self.channels)]
            out += [Hyperslab(f, a, min(n, a + self.width)) for a in range(0, n, self.width)]
        return out

    def data(self, handle):
        if self.dataset:
            return handle[self.dataset]
        found: dict[str, tuple[tuple[int, ...], str]] = {}
        handle.visititems(lambda name, x: found.update({name: (x.shape, x.dtype.kind)}) if hasattr(x, "shape") else None)
        return handle[find_dataset(found)]

    def read(self, part: Hyperslab) -> Iterator[tuple]:
        import h5py

        with h5py.File(part.path, "r") as handle:
            data = self.data(handle)
            across = channel_axis(data.shape, self.channels)
            fs = float(data.attrs.get("sampling_rate", handle.attrs.get("sampling_rate", 5000.0)))
            start = int(data.attrs.get("epoch", 0)) * 1_000_000_000 + int(data.attrs.get("ns", 0))
            size = max(1, round(self.block_s * fs))
            for at in range(0, data.shape[1 - across], size):
                values = data[at : at + size, part.first : part.last] if across else data[part.first : part.last, at : at + size].T
                for i in range(values.shape[1]):
                    yield (self.experiment, part.path.rsplit("/", 1)[-1], part.first + i, start + round(at / fs * 1e9), fs, values[:, i].astype("float32").tolist())


class WaveformSource(DataSource):
    """spark.read.format("waveform_hdf5"): one row for each channel and block."""

    @classmethod
    def name(cls) -> str:
        return "waveform_hdf5"

    def schema(self) -> str:
        return WAVEFORM_BLOCK

    def reader(self, schema) -> WaveformReader:
        return WaveformReader(self.options)


def register(spark: SparkSession) -> bool:
    """True where h5py is there to read with."""
    try:
        import h5py  # noqa: F401
    except ImportError:
        return False
    spark.dataSource.register(WaveformSource)
    return True


def with_halo(blocks: DataFrame, pad: int, shortest: int | None = None) -> DataFrame:
    """before and after: pad samples of the neighbouring blocks of the file and channel, fewer at the file's ends only.

    shortest is the length of the shortest block that has another one behind it; it says how many blocks a pad
    reaches over, and is measured where it isn't given."""
    w = Window.partitionBy("experiment", "file_name", "channel").orderBy("block_start_ns")
    if shortest is None:
        sizes = blocks.select(F.size("samples").alias("n"), F.lead("block_start_ns").over(w).alias("later"))
        shortest = sizes.where("later is not null").agg(F.min("n")).first()[0] or pad
    if pad and not shortest:
        raise ValueError("a block without samples")
    count = -(-pad // max(1, shortest)) + 1  # the last block of a file may be shorter
    joined = lambda low, high: F.flatten(F.collect_list("samples").over(w.rowsBetween(low, high)))
    out = blocks.withColumns({"before": joined(-count, -1), "after": joined(1, count)})
    last = F.slice("before", F.greatest(F.size("before") - pad + 1, F.lit(1)), pad)
    return out.withColumns({"before": last, "after": F.slice("after", 1, pad)})


def find_dataset(shapes: dict[str, tuple[tuple[int, ...], str]]) -> str:
    """Of a file's datasets (name: shape, kind of its type as numpy names it) the only numeric one of two dimensions."""
    found = [name for name, (shape, kind) in shapes.items() if len(shape) == 2 and kind in "iuf"]
    if len(found) != 1:
        raise ValueError(f"{len(found)} datasets of two dimensions: {sorted(found)}")
    return found[0]


def channel_axis(shape: tuple[int, int], channels: int | None = None) -> int:
    """The axis of the channels: the one of that length, or else the shorter one."""
    if channels is not None and (shape[0] == channels) != (shape[1] == channels):
        return 0 if shape[0] == channels else 1
    if channels is not None and channels not in shape:
        raise ValueError(f"no axis of {shape} has {channels} channels")
    return 0 if shape[0] < shape[1] else 1


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Partitioned by experiment and file, channels together and in time, so row groups can be skipped."""
    ordered = blocks.repartition("experiment", "file_name").sortWithinPartitions("experiment", "file_name", "channel", "block_start_ns")
    ordered.write.mode("overwrite").partitionBy("experiment", "file_name").parquet(path)
