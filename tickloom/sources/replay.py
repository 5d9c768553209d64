"""A stored table as a stream in time order: one day after another, each a micro-batch (STR-17)."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: The offset after the last day, when the closing row has been read.
END = "~"


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class DayFile(InputPartition):
    def __init__(self, day: str, path: str | None):
        self.day, self.path = day, path


class DayReader(DataSourceStreamReader):
    """The offset is the last day that has been read.  A reader that starts anew finds it in the log of the query's checkpoint."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.root, self.day, self.checkpoint = options["path"], options["day"], options["checkpoint"]
        self.until, self.closing, self.ts = options.get("until"), options.get("closing"), options.get("ts")
        self.names, self.fields = schema.names, schema
        system, path = _located(self.root)
        prefix = f"{self.day}="
        found = (f.path.rpartition("/")[2] for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory)
        self.days = sorted(f[len(prefix) :] for f in found if f.startswith(prefix))
        if self.until:
            self.days = [d for d in self.days if d <= self.until]
        elif self.closing:
            self.days.append(END)
        self.at = self._logged()

    def _logged(self) -> str:
        system, path = _located(f"{self.checkpoint}/offsets")
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.isdigit()]
        if not names:
            return ""
        with system.open_input_file(f"{path}/{max(names, key=int)}") as f:
            return json.loads(f.read().decode().splitlines()[-1])["day"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        """The day after the last one given; the same again when there is none."""
        self.at = next((d for d in self.days if d > self.at), self.at)
        return {"day": self.at}

    def partitions(self, start: dict, end: dict) -> list[DayFile]:
        out = []
        for day in (d for d in self.days if start["day"] < d <= end["day"]):
            if day == END:
                out.append(DayFile(day, None))
                continue
            system, path = _located(f"{self.root}/{self.day}={day}")
            out += [DayFile(day, f.path) for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
        return out

    def read(self, partition: DayFile) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.fields)
        if partition.path is None:
            row = {f.name: None for f in wanted}
            row[self.ts] = pa.scalar(int(self.closing), pa.int64()).cast(pa.timestamp("us", wanted.field(self.ts).type.tz)).as_py()
            yield pa.RecordBatch.from_pylist([row], wanted)
            return
        system, _ = _located(self.root)
        with system.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=[n for n in self.names if n != self.day]):
                day = pa.array([partition.day] * len(batch)).cast(wanted.field(self.day).type) if self.day in self.names else None
                yield pa.RecordBatch.from_arrays([day if n == self.day else batch.column(n).cast(wanted.field(n).type) for n in self.names], schema=wanted)

    def commit(self, end: dict) -> None:
        pass


class DayReplay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "day_replay"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema: StructType) -> DayReader:  # noqa: N802
        return DayReader(dict(self.options), schema)


def replayed(spark: SparkSession, root: str, day: str, schema: StructType, checkpoint: str, until: str | None = None, closing: tuple[str, int] | None = None) -> DataFrame:
    """STR-17: the folders day=... below root (as write_days makes them) as a stream, a day a micro-batch, in order.

    checkpoint: that of the query that reads it; a query that starts again there goes on with the next day.  until: the last day
    to read.  closing: a time column and microseconds since 1970 of one more row, null otherwise, after the last day: it takes the
    watermark past all rows, so that nothing waits in state.  Files are read in tasks, with pyarrow's file systems.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers may not have this package
    spark.dataSource.register(DayReplay)
    r = spark.readStream.format("day_replay").schema(schema).option("path", root).option("day", day).option("checkpoint", checkpoint)
    if until:
        r = r.option("until", until)
    if closing:
        r = r.option("ts", closing[0]).option("closing", str(closing[1]))
    return r.load()
