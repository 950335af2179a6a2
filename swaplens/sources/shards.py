"""SRC-6: a data source of audited tables, chosen by backend.

``spark.read.format("audit_shards").option("path", root).option("backend", ...)`` reads what the backend finds below the root:
``shards`` any Parquet files, ``table`` CSV files with a header. A root without such files raises, and nothing is ever fetched. The
schema comes from the first file; each row group of a Parquet file, or each CSV file, is a partition. Comparisons with constants are
pushed: row groups whose statistics exclude them aren't read, and the rest is filtered in the worker, batch by batch.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

FORMAT = "audit_shards"
COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
CONSTANT = (int, float, str, bool, datetime.date, datetime.datetime, decimal.Decimal)


def _files(root: str, suffix: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    """Files of the suffix at or below the root, in order; none raises."""
    fs, path = pyarrow.fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    info = fs.get_file_info(path)
    if info.type == pyarrow.fs.FileType.File:
        found = [path] if path.endswith(suffix) else []
    elif info.type == pyarrow.fs.FileType.Directory:
        inside = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        found = sorted(f.path for f in inside if f.type == pyarrow.fs.FileType.File and f.path.endswith(suffix) and f.size)
    else:
        found = []
    if not found:
        raise FileNotFoundError(f"no {suffix} data below {root}; put it there first, nothing is fetched")
    return fs, found


def _nullable(kind: DataType) -> DataType:
    """The type with nulls allowed everywhere, as files of one table may differ in what they promise."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(_nullable(kind.elementType), True)
    return MapType(_nullable(kind.keyType), _nullable(kind.valueType), True) if isinstance(kind, MapType) else kind


class _Piece(InputPartition):
    def __init__(self, file: str, group: int | None):
        super().__init__((file, group))
        self.file, self.group = file, group


def _excluded(group: pq.RowGroupMetaData, filters: Sequence[Filter]) -> bool:
    """Whether the statistics of the row group leave no row for some filter."""
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    for f in filters:
        column = columns.get(f.attribute[0])
        stats = column.statistics if column is not None else None
        if isinstance(f, IsNotNull) or stats is None or not stats.has_min_max:
            continue
        try:
            least, most = stats.min, stats.max
            values = f.value if isinstance(f, In) else [f.value]
            out = {
                EqualTo: lambda v: v < least or v > most, In: lambda v: v < least or v > most, GreaterThan: lambda v: most <= v, GreaterThanOrEqual: lambda v: most < v,
                LessThan: lambda v: least >= v, LessThanOrEqual: lambda v: least > v}[type(f)]
            if all(out(v) for v in values):
                return True
        except TypeError:
            continue
    return False


class ShardReader(DataSourceReader):
    def __init__(self, root: str, suffix: str, schema: StructType):
        self.root, self.suffix, self.schema, self.filters = root, suffix, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of a top-level column with constants; the others go back to Spark."""
        for f in filters:
            values = f.value if isinstance(f, In) else [f.value] if type(f) in COMPARED else []
            known = isinstance(f, IsNotNull) or (type(f) in (*COMPARED, In) and all(isinstance(v, CONSTANT) and v == v for v in values))
            if known and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, found = _files(self.root, self.suffix)
        if self.suffix != ".parquet":
            return [_Piece(f, None) for f in found]
        pieces = []
        for f in found:
            meta = pq.read_metadata(f, filesystem=fs)
            pieces += [_Piece(f, g) for g in range(meta.num_row_groups) if not _excluded(meta.row_group(g), self.filters)]
        return pieces or [_Piece("", None)]

    def _keep(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        for f in self.filters:
            column = batch.column(f.attribute[0])
            if isinstance(f, IsNotNull):
                keep = pc.is_valid(column)
            elif isinstance(f, In):
                keep = pc.is_in(column, pa.array(list(f.value), column.type))
            else:
                keep = COMPARED[type(f)](column, pa.scalar(f.value, column.type))
            batch = batch.filter(keep)
        return batch

    def read(self, piece: _Piece) -> Iterator[pa.RecordBatch]:
        if not piece.file:
            return
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")
        wanted = to_arrow_schema(self.schema)
        with fs.open_input_file(piece.file) as source:
            if piece.group is None:
                options = pyarrow.csv.ConvertOptions(column_types=wanted, strings_can_be_null=True)
                batches = pyarrow.csv.open_csv(source, convert_options=options)
            else:
                batches = pq.ParquetFile(source).iter_batches(batch_size=8192, row_groups=[piece.group], columns=wanted.names)
            for batch in batches:
                columns = [batch.column(n).cast(t) for n, t in zip(wanted.names, wanted.types, strict=True)]
                yield self._keep(pa.RecordBatch.from_arrays(columns, schema=wanted))


class ShardSource(DataSource):
    SUFFIXES = {"shards": ".parquet", "table": ".csv"}

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _where(self) -> tuple[str, str]:
        backend = self.options.get("backend", "shards")
        if backend not in self.SUFFIXES:
            raise ValueError(f"unknown backend: {backend}; known are {sorted(self.SUFFIXES)}")
        if str(self.options.get("download", "false")).lower() == "true":
            raise ValueError("data is never downloaded")
        if "path" not in self.options:
            raise ValueError("the option path is missing")
        return self.options["path"], self.SUFFIXES[backend]

    def schema(self) -> StructType:
        root, suffix = self._where()
        fs, found = _files(root, suffix)
        if suffix == ".parquet":
            return _nullable(from_arrow_schema(pq.read_schema(found[0], filesystem=fs)))
        with fs.open_input_file(found[0]) as source:
            return _nullable(from_arrow_schema(pyarrow.csv.open_csv(source).schema))

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(*self._where(), schema)


def load_dataset(spark: SparkSession, path: str, backend: str = "shards") -> DataFrame:
    """The audited table below ``path`` by its backend; raises at once where there is none."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardSource)
    return spark.read.format(FORMAT).option("backend", backend).option("path", path).load()
