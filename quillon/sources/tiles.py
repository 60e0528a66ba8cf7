"""A partitioned Python data source of map tiles: reads folders of z/x/y files, one partition for each zoom and column block."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Columns(InputPartition):
    def __init__(self, z: int, columns: list[int]):
        super().__init__((z, columns))
        self.z, self.columns = z, columns


class TileSource(DataSource):
    """spark.read.format("tiles").load(folder): z, x, y, size, content. Option ``block``: columns in a partition."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return "z int, x int, y int, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return TileReader(self.options["path"], int(self.options.get("block", "64")))


class TileReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def partitions(self) -> list[InputPartition]:
        out = []
        for z in sorted(int(d) for d in os.listdir(self.path) if d.isdigit()):
            xs = sorted(int(d) for d in os.listdir(f"{self.path}/{z}") if d.isdigit())
            out += [Columns(z, xs[i : i + self.block]) for i in range(0, len(xs), self.block)]
        return out

    def read(self, partition: Columns) -> Iterator[tuple]:
        for x in partition.columns:
            for name in sorted(os.listdir(f"{self.path}/{partition.z}/{x}")):
                stem = name.split(".", 1)[0]
                if stem.isdigit():
                    with open(f"{self.path}/{partition.z}/{x}/{name}", "rb") as f:
                        content = f.read()
                    yield partition.z, x, int(stem), len(content), content
