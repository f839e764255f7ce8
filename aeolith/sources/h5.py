"""An optional reader of HDF5 arrays as facts; needs h5py, which is imported where it is used.

``spark.dataSource.register(H5Source)``, then
``spark.read.format("resource_h5").option("datasets", "windspeed_100m").schema(...).load(path)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


@dataclass
class _Sites(InputPartition):
    begin: int
    end: int


def _h5py():
    try:
        import h5py
    except ImportError as error:
        raise ImportError("reading HDF5 files needs h5py") from error
    return h5py


class H5Source(DataSource):
    """Facts (gid, ts, raw datasets) of one file; one partition for some sites at all times."""

    @classmethod
    def name(cls) -> str:
        return "resource_h5"

    def schema(self) -> str:
        kinds = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "f4": "float", "f8": "double"}
        with _h5py().File(self.options["path"], "r") as f:
            columns = [f"`{d}` {kinds[f[d].dtype.str[1:]]}" for d in self._names()]
        return ", ".join(["gid bigint", "ts timestamp_ntz", *columns])

    def _names(self) -> list[str]:
        return [x.strip() for x in self.options["datasets"].split(",")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._names(), int(self.options.get("sites_per_partition", 500)), schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, datasets: list[str], step: int, schema):
        self.path, self.datasets, self.step, self.columns = path, datasets, step, schema.names
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of gid narrow the sites that are read; Spark still applies every filter."""
        for f in filters:
            if getattr(f, "attribute", None) == ("gid",):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    top = f.value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            yield f

    def partitions(self) -> list[InputPartition]:
        with _h5py().File(self.path, "r") as f:
            n = f[self.datasets[0]].shape[-1]
        high = n if self.high is None else min(n, self.high)
        return [_Sites(i, min(i + self.step, high)) for i in range(self.low, high, self.step)] or [_Sites(0, 0)]

    def read(self, partition: _Sites) -> Iterator[pa.RecordBatch]:
        with _h5py().File(self.path, "r") as f:
            times = np.array([np.datetime64(t.decode()[:19], "us") for t in f["time_index"][:]])
            sites = np.arange(partition.begin, partition.end)
            values = {d: f[d][:, partition.begin : partition.end] for d in self.datasets}
        arrays = {"gid": pa.array(np.repeat(sites, len(times))), "ts": pa.array(np.tile(times, len(sites)))}
        arrays |= {d: pa.array(v.T.ravel()) for d, v in values.items()}
        if len(sites):
            yield pa.record_batch([arrays[c] for c in self.columns], self.columns)
