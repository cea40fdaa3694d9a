"""Daily exchange files, plain or zipped, as a data source: one task for each member, headers resolved per file.

``read_days`` asks for target columns of a kind (see ``schemas.SYNONYMS``) and for values that rows must have. Only those
columns are parsed and leave the reader, only those rows are sent to Spark. Every file finds its own headers, so a folder may
mix column orders and header names. A member that cannot be read, or lacks a column asked for, becomes a row with its
reason in ``error``, as do rows with another number of cells; no file fails the others. Files are read in blocks, never whole.
"""

from __future__ import annotations

import codecs
import csv
import datetime as dt
import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickloom.schemas import SYNONYMS

#: columns an input may lack: they are null then
OPTIONAL = ("settle",)
#: archives whose directories are listed at once while a query is planned
LISTED_AT_ONCE = 16


@dataclass
class Member(InputPartition):
    """One CSV file, or one member of an archive; ``problem`` where the archive could not be opened."""

    path: str
    inner: str | None = None
    problem: str | None = None


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"^[a-z0-9+]+:", path):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def members(path: str, since: str | None = None, until: str | None = None, pattern: str = "", fmt: str = "") -> list[Member]:
    """All CSV members below ``path`` by name; with a date pattern only those of the days asked for are opened."""
    files, root = filesystem(path)
    info = files.get_file_info(root)
    found = [info] if info.type == pyarrow.fs.FileType.File else files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    names = sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and f.path.lower().endswith((".csv", ".zip")))
    if since or until:
        names = [n for n in names if (day := file_day(n, pattern, fmt)) and (since or "") <= day.isoformat() <= (until or "9999")]

    def inside(name: str) -> list[Member]:
        if name.lower().endswith(".csv"):
            return [Member(name)]
        try:
            with zipfile.ZipFile(files.open_input_file(name)) as archive:
                listed = [n for n in archive.namelist() if n.lower().endswith(".csv")]
            return [Member(name, n) for n in listed] or [Member(name, None, "no CSV member")]
        except Exception as problem:  # noqa: BLE001  (any unreadable archive is one bad file)
            return [Member(name, None, str(problem))]

    with ThreadPoolExecutor(LISTED_AT_ONCE) as pool:
        return [m for group in pool.map(inside, names) for m in group]


def file_day(name: str, pattern: str, fmt: str) -> dt.date | None:
    found = re.search("(?i)" + pattern, name)
    try:
        return dt.datetime.strptime(found.group(1), fmt).date() if found else None
    except ValueError:
        return None


def resolve_header(header: Sequence[str], kind: str, asked: Sequence[str]) -> dict[str, int]:
    """Place of each asked column in a file's header; names what is missing."""
    places = {}
    for i, name in enumerate(header):
        places.setdefault(name.strip().lower(), i)
    out = {t: next((places[a] for a in SYNONYMS[kind][t] if a in places), None) for t in asked}
    missing = [t for t, i in out.items() if i is None and t not in OPTIONAL]
    if missing:
        raise ValueError(f"{kind} input misses columns {missing}; it has {[h.strip() for h in header]}")
    return {t: i for t, i in out.items() if i is not None}


class MemberFile:
    """Opens a member again for each reading: once for its encoding, once for its header, once for its rows."""

    def __init__(self, files: pyarrow.fs.FileSystem, member: Member):
        self.files, self.member = files, member

    def open(self) -> io.BufferedIOBase:
        stream = self.files.open_input_file(self.member.path)
        return stream if self.member.inner is None else zipfile.ZipFile(stream).open(self.member.inner)

    def encoding(self) -> str:
        """UTF-8 if the whole file is, else Latin-1."""
        decoder = codecs.getincrementaldecoder("utf-8")()
        with self.open() as source:
            try:
                while block := source.read(1 << 20):
                    decoder.decode(block)
                decoder.decode(b"", True)
                return "utf-8"
            except UnicodeDecodeError:
                return "latin-1"

    def header(self, encoding: str) -> list[str]:
        with self.open() as source:
            line = io.TextIOWrapper(source, "utf-8-sig" if encoding == "utf-8" else encoding, newline="").readline()
        return next(csv.reader([line]), [])


class DayFileReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict):
        self.columns = columns
        self.path, self.kind = options["path"], options["kind"]
        self.equal = json.loads(options.get("equal", "{}"))
        self.days = {k: options.get(k) for k in ("since", "until")} | {k: options.get(k, "") for k in ("pattern", "fmt")}
        self.targets = [c for c in columns if c in SYNONYMS[self.kind]]

    def partitions(self) -> list[Member]:
        return members(self.path, **self.days)

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        name = re.split(r"[/\\]", partition.path)[-1]
        try:
            if partition.problem:
                raise ValueError(partition.problem)
            yield from self._rows(partition, name)
        except Exception as problem:  # noqa: BLE001  (a bad file is a row, not a failed job)
            yield self._batch(None, {}, name, str(problem) or type(problem).__name__)

    def _rows(self, member: Member, name: str) -> Iterator[pa.RecordBatch]:
        file = MemberFile(filesystem(self.path)[0], member)
        encoding = file.encoding()
        header = file.header(encoding)
        places = resolve_header(header, self.kind, sorted({*self.targets, *self.equal}))
        odd = []
        cells = [f"c{i}" for i in range(len(header))]
        read = pyarrow.csv.ReadOptions(column_names=cells, skip_rows=1, encoding=encoding, use_threads=False)
        parse = pyarrow.csv.ParseOptions(invalid_row_handler=lambda row: odd.append(row.number) or "skip")
        used = [cells[i] for i in sorted(set(places.values()))]
        convert = pyarrow.csv.ConvertOptions(include_columns=used, column_types=dict.fromkeys(used, pa.string()), strings_can_be_null=True, null_values=[""])
        with file.open() as source:
            try:
                blocks = pyarrow.csv.open_csv(pa.PythonFile(source, "r"), read, parse, convert)
            except pa.ArrowInvalid as problem:
                if "Empty CSV" in str(problem):
                    return
                raise
            for block in blocks:
                own = {t: pc.utf8_trim_whitespace(block.column(used.index(cells[i]))) for t, i in places.items()}
                keep = pa.array([True] * block.num_rows)
                for target, value in self.equal.items():
                    keep = pc.and_(keep, pc.fill_null(pc.equal(pc.utf8_upper(own[target]), value.upper()), False))
                yield self._batch(keep, own, name, None)
        if odd:
            yield self._batch(None, {}, name, f"{len(odd)} rows with another number of cells than the header")

    def _batch(self, keep: pa.Array | None, own: dict, name: str, error: str | None) -> pa.RecordBatch:
        n = 1 if keep is None else sum(keep.to_pylist())
        fixed = {"_file": name, "error": error}
        columns = [pa.array([fixed[c]] * n, pa.string()) if c in fixed else pc.filter(own[c], keep) if c in own else pa.nulls(n, pa.string()) for c in self.columns]
        return pa.RecordBatch.from_arrays(columns, self.columns)


class DayFiles(DataSource):
    """``spark.read.format("day_files")`` with options ``kind``, ``equal`` (JSON), ``since``, ``until``, ``pattern``, ``fmt``."""

    @classmethod
    def name(cls) -> str:
        return "day_files"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in [*SYNONYMS[self.options["kind"]], "_file", "error"])

    def reader(self, schema) -> DayFileReader:
        return DayFileReader(schema.names, {**self.options})


def read_days(spark: SparkSession, path: str, kind: str, columns: Sequence[str] | None = None, equal: dict[str, str] | None = None,
              since: str | None = None, until: str | None = None, name: tuple[str, str] | None = None) -> DataFrame:
    """Text columns ``columns`` of a kind with ``_file`` and ``error``; ``name`` is a pattern and format of the date in file names."""
    spark.dataSource.register(DayFiles)
    asked = [*(SYNONYMS[kind] if columns is None else columns), "_file", "error"]
    reader = spark.read.format("day_files").schema(", ".join(f"{c} string" for c in asked)).option("kind", kind)
    for key, value in (("equal", json.dumps(equal) if equal else None), ("since", since), ("until", until), ("pattern", name and name[0]), ("fmt", name and name[1])):
        reader = reader if value is None else reader.option(key, value)
    return reader.load(path)


def first_header(path: str, kind: str) -> None:
    """Refuse a folder whose first readable file lacks a column of its kind, before any job runs."""
    files = filesystem(path)[0]
    for member in members(path):
        if member.problem is None:
            file = MemberFile(files, member)
            resolve_header(file.header(file.encoding()), kind, list(SYNONYMS[kind]))
            return
