"""A data source over cached pages of records: JSON files, a page each, as a paged service returned them.

Pages are partitions. Columns are an option (so a narrow read parses narrow rows) and equality and range filters are
pushed down to the reader.

    register(spark)
    spark.read.format("paged_json").schema("id long, name string").option("path", folder).load()
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)


class Blocked(RuntimeError):
    """A page that is not JSON: the service refused and sent something else."""


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        raise ValueError("paged_json needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.records, self.kept = schema.names, options["path"], options.get("records", "features"), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1:
                self.kept.append((f.attribute[0], TESTS[type(f)], f.value))
            elif not isinstance(f, IsNotNull):
                yield f
            else:
                self.kept.append((f.attribute[0], lambda v, _: v is not None, None))

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return [InputPartition(f.path) for f in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda f: f.path) if f.path.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(partition.value) as f:
            body = f.read()
        try:
            page = json.loads(body)
        except ValueError as e:
            raise Blocked(f"{partition.value} is not JSON") from e
        for r in page[self.records]:
            r = r.get("attributes", r)
            if all(r.get(a) is not None and test(r.get(a), v) for a, test, v in self.kept):
                yield tuple(r.get(n) for n in self.names)
