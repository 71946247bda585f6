"""A Python data source that replays recorded responses of a literature service.

    spark.dataSource.register(ReplaySource)
    spark.read.format("literature_replay").option("path", folder).option("service", "openalex").load()

Each recorded file is one partition: name.service.json. Retries and rate limits of a live service
belong into `read`; nothing here opens a connection.
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RecordedFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ReplayReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.service = options.get("path"), options.get("service", "")

    def partitions(self):
        end = f".{self.service}.json" if self.service else ".json"
        return [RecordedFile(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(end)]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            yield (os.path.basename(partition.path), f.read())


class ReplaySource(DataSource):
    @classmethod
    def name(cls):
        return "literature_replay"

    def schema(self):
        return "file string, body string"

    def reader(self, schema):
        return ReplayReader(self.options)
