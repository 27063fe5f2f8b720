"""Scans of slides as a data source: one NPY array (FOV rows, FOV columns, h, w) of bytes per slide.

``spark.read.format("fov_scan").load(folder)`` reads ``<folder>/<slide>/scan.npy`` files. A FOV is one range of
bytes, so only the FOVs that the pushed filters on slide, fov_y and fov_x leave are read, a run of them per task.
Register the source once with ``register(spark)``.
"""

from __future__ import annotations

from ast import literal_eval
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..schema import SCANS

FILE = "scan.npy"
#: FOVs that one task reads.
RUN = 64


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def npy_header(file) -> tuple[tuple[int, ...], int]:
    """(shape, offset of the data) of an NPY file of unsigned bytes in C order; a last axis of one is dropped."""
    head = file.read_at(12, 0)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    size, begin = (int.from_bytes(head[8:10], "little"), 10) if head[6] == 1 else (int.from_bytes(head[8:12], "little"), 12)
    told = literal_eval(file.read_at(size, begin).decode("latin1"))
    shape = tuple(told["shape"])
    shape = shape[:4] if len(shape) == 5 and shape[4] == 1 else shape
    if told["descr"] not in ("|u1", "u1") or told["fortran_order"] or len(shape) != 4:
        raise ValueError(f"a scan is a C-ordered array (rows, columns, h, w) of bytes, not {told}")
    return shape, begin + size


@dataclass
class FovRun(InputPartition):
    path: str
    slide: str
    fovs: tuple[tuple[int, int], ...]


class FovScanReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, []

    def pushFilters(self, filters: list[Filter]):
        """Takes comparisons of the key columns with constants; gives the others back."""
        tests = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}
        for f in filters:
            name = f.attribute[0] if type(f) in tests and len(f.attribute) == 1 else None
            if name in ("slide", "fov_y", "fov_x"):
                self.wanted.append((name, tests[type(f)], f.value))
            else:
                yield f

    def _keeps(self, **at) -> bool:
        return all(test(at[name], value) for name, test, value in self.wanted if name in at)

    def partitions(self) -> list[FovRun]:
        from pyarrow import fs as pafs

        fs, root = filesystem(self.path)
        out = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda x: x.path):
            slide = info.base_name
            if info.type != pafs.FileType.Directory or not self._keeps(slide=slide) or fs.get_file_info(f"{info.path}/{FILE}").type != pafs.FileType.File:
                continue
            with fs.open_input_file(f"{info.path}/{FILE}") as f:
                (rows, cols, _, _), _ = npy_header(f)
            fovs = [(y, x) for y in range(rows) if self._keeps(fov_y=y) for x in range(cols) if self._keeps(fov_x=x)]
            out += [FovRun(info.path, slide, tuple(fovs[k : k + RUN])) for k in range(0, len(fovs), RUN)]
        return out

    def read(self, part: FovRun):
        fs, _ = filesystem(self.path)
        with fs.open_input_file(f"{part.path}/{FILE}") as f:
            (_, cols, h, w), begin = npy_header(f)
            for y, x in part.fovs:
                yield part.slide, y, x, h, w, f.read_at(h * w, begin + (y * cols + x) * h * w)


class FovScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fov_scan"

    def schema(self):
        return SCANS

    def reader(self, schema) -> FovScanReader:
        return FovScanReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FovScan)


def scans(spark: SparkSession, path: str, eager: bool = False) -> DataFrame:
    """The FOVs (schema SCANS) of a folder of slides. They are read lazily, so filters on the key columns prune
    them; ``eager`` keeps what is read for reuse."""
    register(spark)
    rows = spark.read.format("fov_scan").load(path)
    return rows.persist() if eager else rows


def gather(rows: DataFrame, fovs: DataFrame) -> DataFrame:
    """The FOVs of scans that a table (slide, fov_y, fov_x) names."""
    return rows.join(fovs.select("slide", "fov_y", "fov_x").distinct(), ["slide", "fov_y", "fov_x"], "left_semi")
