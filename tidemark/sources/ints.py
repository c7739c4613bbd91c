"""``int32file``: flat files of signed 32-bit integers; splits are plain arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from tidemark.sources.kvbin import Split
from tidemark.sources.parts import PartWriter, data_files, filesystem, with_scheme


class IntReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], max(4, int(options.get("splitBytes", 64 << 20)) // 4 * 4)

    def partitions(self):
        fs, path = filesystem(self.path)
        out = [
            Split(with_scheme(self.path, path, f.path), a, min(a + self.step, f.size // 4 * 4), i)
            for i, f in enumerate(data_files(fs, path))
            for a in range(0, f.size // 4 * 4, self.step)
        ]
        return out or [Split("", 0, 0)]

    def read(self, p):
        if p.end <= p.start:
            return
        fs, path = filesystem(p.file)
        with fs.open_input_file(path) as f:
            f.seek(p.start)
            data = np.frombuffer(f.read(p.end - p.start), "<i4")
        for i in range(0, len(data), 65536):
            part = data[i : i + 65536]
            at = p.start // 4 + i + np.arange(len(part), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(p.file_id, pa.int32()), len(part)), pa.array(at), pa.array(part)], names=["file_id", "pos", "value"])


class IntWriter(PartWriter):
    suffix = ".i32"

    def write_stream(self, out, batches):
        rows = 0
        for b in batches:
            if b.column("value").null_count:
                raise ValueError("a value is null")
            out.write(b.column("value").to_numpy().astype("<i4").tobytes())
            rows += b.num_rows
        return 4 * rows, rows, b""


class IntFile(DataSource):
    @classmethod
    def name(cls):
        return "int32file"

    def schema(self):
        return "file_id int, pos bigint, value int"

    def reader(self, schema):
        return IntReader(self.options)

    def writer(self, schema, overwrite):
        return IntWriter(self.options, overwrite)


def read_ints(spark: SparkSession, path: str, **options) -> DataFrame:
    """file_id (in order), pos (in its file, from 0) and value."""
    spark.dataSource.register(IntFile)
    return spark.read.format("int32file").options(path=path, **options).load()


def write_ints(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """Write one integer column in partition order."""
    df.sparkSession.dataSource.register(IntFile)
    df.select(F.col(f"`{column}`").cast("int").alias("value")).write.format("int32file").mode(mode).options(path=path).save()
