"""Envelope documents as a data source of their own (S6, S7): split reading, and writes that replace terms or change nothing.

A document is a file ``market=M/term_slug=T/<write>-<part>.json``.  A write puts its files beside those of earlier ones and
becomes visible by one empty marker in ``_commits``, so that all its terms change at once.  A term shows the files of the
last committed write that holds any; a write that was killed has no marker and shows nowhere.  Python only moves texts:
Spark makes the JSON and parses it.
"""

from __future__ import annotations

import re
import sys
import time
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pagemill.functions.text import folder_name
from pagemill.schemas import ENVELOPE

FORMAT = "envelopes"
ROWS = "market string, term_slug string, part bigint, value string"
# Bytes of documents that one read task takes (option ``splitBytes``); a larger document is a task of its own.
SPLIT_BYTES = 32 << 20
# Files of writes that never ended go when a later write touches their term and they are older (option ``keepHours``).
KEEP_HOURS = 24.0
# The folder of a null, as Spark names it.
NULL = "__HIVE_DEFAULT_PARTITION__"

_DOCUMENT = re.compile(r"market=([^/]*)/term_slug=([^/]*)/([0-9a-f]{32})-(\d+)\.json$")


def _folder(value: str | None) -> str:
    return NULL if value is None else quote(value, safe="")


def _value(folder: str) -> str | None:
    return None if folder == NULL else unquote(folder)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{quote(path)}")
    return fs, base.rstrip("/")


def _commits(fs: pafs.FileSystem, base: str) -> dict[str, int]:
    """Committed writes and their order; a marker's name is ``<order>-<write>``."""
    found = fs.get_file_info(pafs.FileSelector(f"{base}/_commits", allow_not_found=True))
    return {name[-32:]: int(name[:-33]) for name in (f.base_name for f in found)}


def _documents(fs: pafs.FileSystem, folder: str):
    """(market folder, term folder, write, part, file) of all documents below ``folder``."""
    for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=True)):
        if (m := _DOCUMENT.search(info.path)) is not None:
            yield m[1], m[2], m[3], int(m[4]), info


def _live(documents: list[tuple], commits: dict[str, int]) -> list[tuple]:
    """The documents of each term's last committed write."""
    last: dict[tuple[str, str], int] = {}
    for market, term, write, _, _ in documents:
        if write in commits:
            last[market, term] = max(last.get((market, term), -1), commits[write])
    return [d for d in documents if commits.get(d[2]) == last.get((d[0], d[1]), -2)]


@dataclass
class Documents(InputPartition):
    """Files of one read task: (market, term_slug, part, path)."""

    files: list[tuple]


@dataclass
class Written(WriterCommitMessage):
    documents: int


class EnvelopeReader(DataSourceReader):
    """Lists live documents once, and reads them in splits of bounded size; options ``market`` and ``termSlug`` prune the listing."""

    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.market, self.term = (options.get(k) for k in ("market", "termSlug"))

    def partitions(self):
        fs, base = _open(self.path)
        commits = _commits(fs, base)
        folder = base if self.market is None else f"{base}/market={_folder(self.market)}"
        if self.market is not None and self.term is not None:
            folder = f"{folder}/term_slug={_folder(self.term)}"
        found = [d for d in _documents(fs, folder) if self.term is None or d[1] == _folder(self.term)]
        splits, files, size = [], [], 0
        for m, t, _, part, info in sorted(_live(found, commits), key=lambda d: (d[0], d[1], d[3])):
            if not info.size:
                continue  # an empty file is an empty store
            if files and size + info.size > self.split:
                splits.append(Documents(files))
                files, size = [], 0
            files.append((_value(m), _value(t), part, info.path))
            size += info.size
        return [*splits, Documents(files)]

    def read(self, partition):
        fs, _ = _open(self.path)
        for market, term, part, path in partition.files:
            with fs.open_input_stream(path) as stream:
                text = stream.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays(
                [pa.array([market], pa.string()), pa.array([term], pa.string()), pa.array([part], pa.int64()), pa.array([text], pa.string())],
                names=["market", "term_slug", "part", "value"])


class EnvelopeWriter(DataSourceWriter):
    """Tasks write files under the write's name; the marker that shows them comes last.

    A task that runs again writes the same names.  Before it adds to a term, a task removes what no reader needs there:
    documents that two committed writes have followed, and remains of writes that never ended.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.keep = float(options.get("keepHours", KEEP_HOURS)) * 3600
        self.name = uuid.uuid4().hex

    def write(self, iterator):
        fs, base = _open(self.path)
        commits = _commits(fs, base)
        tidied: str | None = None
        n = 0
        for row in iterator:
            folder = f"{base}/market={_folder(row['market'])}/term_slug={_folder(row['term_slug'])}"
            if tidied != folder:
                fs.create_dir(folder, recursive=True)
                self._tidy(fs, folder, commits)
                tidied = folder
            name = f"{self.name}-{int(row['part'])}.json"
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write((row["value"] or "").encode())
            fs.move(draft, f"{folder}/{name}")
            n += 1
        return Written(n)

    def _tidy(self, fs, folder, commits):
        found = list(_documents(fs, folder))
        kept = {d[4].path for d in _live(found, commits)}
        drafts = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.startswith(".")]
        for write, info in [*((d[2], d[4]) for d in found), *((None, f) for f in drafts)]:
            old = info.mtime_ns is not None and time.time() - info.mtime_ns / 1e9 > self.keep
            if info.path not in kept and write != self.name and (write in commits or old):
                _remove(fs, info.path)

    def commit(self, messages):
        fs, base = _open(self.path)
        fs.create_dir(f"{base}/_commits", recursive=True)
        order = max([time.time_ns(), *(n + 1 for n in _commits(fs, base).values())])
        fs.open_output_stream(f"{base}/_commits/{order}-{self.name}").close()

    def abort(self, messages):
        fs, base = _open(self.path)
        for _, _, write, _, info in _documents(fs, base):
            if write == self.name:
                _remove(fs, info.path)


def _remove(fs: pafs.FileSystem, path: str) -> None:
    try:
        fs.delete_file(path)
    except FileNotFoundError:  # another task was first
        pass


class EnvelopeSource(DataSource):
    """``spark.read.format("envelopes").load(path)``: market, term_slug, part and the document's text."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return ROWS

    def reader(self, schema):
        return EnvelopeReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a write replaces the terms it holds; use mode append")
        return EnvelopeWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; workers need no copy of this module."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(EnvelopeSource)


def document_rows(envelopes: DataFrame) -> DataFrame:
    """Envelope rows (market, search_term, part, envelope) as documents of JSON text."""
    options = {"pretty": "true", "ignoreNullFields": "false"}
    return envelopes.select("market", folder_name(F.col("search_term")).alias("term_slug"), F.col("part").cast("bigint").alias("part"),
                            F.to_json(F.struct("part", "envelope.*"), options).alias("value"))


def replace_terms(documents: DataFrame, path: str) -> None:
    """Write documents (market, term_slug, part, value); their terms are replaced whole and together, others stay.

    The rows must be the same when a task runs again (a written table, say).  Parts of one term go to several tasks.
    """
    register(documents.sparkSession)
    (documents.select("market", "term_slug", "part", "value").repartition("market", "term_slug", "part")
     .sortWithinPartitions("market", "term_slug", "part").write.format(FORMAT).mode("append").save(path))


def read_terms(spark: SparkSession, path: str, **options) -> DataFrame:
    """Market, term_slug, part, the envelope's columns and ``corrupt``, the text of a broken document (its products are null).

    Empty documents and a missing store give no rows.  ``splitBytes`` bounds what one task reads,
    ``market`` and ``termSlug`` name the only folders to list.
    """
    register(spark)
    schema = T.StructType([*ENVELOPE.fields, T.StructField("corrupt", T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    rows = spark.read.format(FORMAT).options(**options).load(path)
    return rows.where(F.col("value").rlike(r"\S")).select("market", "term_slug", "part", parsed.alias("_doc")).select(
        "market", "term_slug", "part", "_doc.*")
