"""Zip archives, e-books among them, as a data source and a data sink: members as rows, books from rows.

Reading opens an archive by its directory and reads the members that are asked for, nothing else: filters on the member's
name are pushed to the reader where spark.sql.python.filterPushdown.enabled is on (Spark filters anyway), the option
like (a pattern of names) holds everywhere, and with content=false no member is read at all. Archives are dealt to partitions in ranges of about equal bytes. Writing
gives one archive for each name; a task writes under a folder of its own, and only the commit of all tasks puts the
archives in their place, so that a failed task leaves nothing half-written. Paths are what pyarrow.fs can open: a shared
folder, or a store that it knows by URI.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "archive string, ord int, member string, size bigint, content binary"
PARTITION_BYTES = 64 << 20
#: The first member of an e-book and what it says, and where the package is told.
MIMETYPE, EPUB, CONTAINER = "mimetype", b"application/epub+zip", "META-INF/container.xml"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Archives(InputPartition):
    paths: list[str]


def holds(test: Filter, member: str) -> bool | None:
    """Whether a filter on the member's name holds; None if it is of a kind, or of a column, that is not known here."""
    if getattr(test, "attribute", None) != ("member",):
        return None
    match test:
        case EqualTo():
            return member == test.value
        case In():
            return member in test.value
        case StringStartsWith():
            return member.startswith(test.value)
        case StringEndsWith():
            return member.endswith(test.value)
        case StringContains():
            return test.value in member
    return None


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.content, self.most = str(options.get("content", "true")).lower() != "false", int(options.get("partition_bytes", PARTITION_BYTES))
        self.like, self.tests = options.get("like", "*"), []

    def wanted(self, member: str) -> bool:
        return fnmatch.fnmatchcase(member, self.like) and all(holds(t, member) for t in self.tests)

    def partitions(self) -> list[InputPartition]:
        system, path = _opened(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)]
        out, size = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if not out or size > self.most:
                out.append(Archives([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out or [Archives([])]

    def read(self, partition: Archives) -> Iterator[tuple]:
        system, root = _opened(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for k, m in enumerate(z.infolist()):
                    if not m.is_dir() and self.wanted(m.filename):
                        yield path.removeprefix(root.rstrip("/") + "/"), k, m.filename, m.file_size, z.read(m) if self.content else None


class PushedReader(MemberReader):
    """With filters on the member's name, which Spark hands over only where the setting is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for test in filters:
            if holds(test, "") is None:
                yield test
            else:
                self.tests.append(test)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceWriter):
    """Rows (archive, ord, member, content) sorted by archive and ord within a partition; an archive's rows are all in one."""

    def __init__(self, options: dict):
        self.path, self.scratch = options["path"], f"{options['path'].rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, scratch = _opened(self.scratch)
        own, names, name, file, z = f"{scratch}/{uuid.uuid4().hex}", [], None, None, None
        system.create_dir(own, recursive=True)
        for r in rows:
            if r["archive"] != name:
                if z:
                    z.close()
                    file.close()
                name = r["archive"]
                names.append(f"{posixpath.basename(own)}/{name}")
                file = system.open_output_stream(f"{own}/{name}")
                z = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
            # a fixed time, so that equal rows make equal archives; the type of an e-book is stored as it is
            m = zipfile.ZipInfo(r["member"], (1980, 1, 1, 0, 0, 0))
            m.compress_type = zipfile.ZIP_STORED if r["member"] == MIMETYPE else zipfile.ZIP_DEFLATED
            z.writestr(m, bytes(r["content"] or b""))
        if z:
            z.close()
            file.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, scratch = _opened(self.scratch)
        _, out = _opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{scratch}/{name}", f"{out.rstrip('/')}/{posixpath.basename(name)}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, scratch = _opened(self.scratch)
        if system.get_file_info(scratch).type == fs.FileType.Directory:
            system.delete_dir(scratch)


class MemberSource(DataSource):
    """format("archive_members"): path, and glob, like, content, partition_bytes and pushdown if wanted."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushedReader if str(self.options.get("pushdown", "false")).lower() == "true" else MemberReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options)


def members(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, ord, member, size, content) of the archives under a path."""
    spark.dataSource.register(MemberSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("archive_members").options(pushdown=pushdown, **options).load(path)


def write_archives(rows: DataFrame, path: str) -> None:
    """An archive for each name in rows (archive, ord, member, content), in one partition each; names are file names."""
    rows.sparkSession.dataSource.register(MemberSource)
    dealt = rows.select("archive", "ord", "member", "content").repartition("archive").sortWithinPartitions("archive", "ord")
    dealt.write.format("archive_members").mode("append").save(path)


# -- e-books ---------------------------------------------------------------------------------------------------------

_PACKAGE = "archive string, package string, id string, path string, media_type string, spine int, linear boolean"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def package_rows(archive: str, package: str, source: bytes) -> list[tuple]:
    """Manifest items of a package file, with their place in the spine; none if it does not parse."""
    try:
        root = ElementTree.parse(io.BytesIO(source)).getroot()
    except ElementTree.ParseError:
        return []
    spine = {}
    for k, ref in enumerate(e for e in root.iter() if _local(e.tag) == "itemref"):
        spine.setdefault(ref.get("idref"), (k, ref.get("linear", "yes") != "no"))
    base = posixpath.dirname(package)
    return [(archive, package, e.get("id"), posixpath.normpath(posixpath.join(base, e.get("href", ""))), e.get("media-type"), *spine.get(e.get("id"), (None, None))) for e in root.iter() if _local(e.tag) == "item"]


def packages(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, package, id, path, media_type, spine, linear): the manifest of the package that each archive's container names."""
    files = members(spark, path, like="*.opf", **options)
    containers = members(spark, path, like=CONTAINER, **options)
    said = F.regexp_extract(F.decode("content", "UTF-8"), r"""full-path\s*=\s*["']([^"']*)["']""", 1)
    wanted = containers.select("archive", said.alias("member"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for r in package_rows(*x)]
            kinds = [pa.string()] * 5 + [pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _PACKAGE.split(", ")])

    return files.join(wanted, ["archive", "member"]).select("archive", "member", "content").mapInArrow(parse, _PACKAGE)


def chapters(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, spine, path, html): the documents (names ending in html) of each book in reading order, decoded."""
    spine = packages(spark, path, **options).where("spine IS NOT NULL")
    documents = members(spark, path, like="*html", **options)
    return documents.select("archive", F.col("member").alias("path"), "content").join(spine.select("archive", "path", "spine"), ["archive", "path"]).select("archive", "spine", "path", F.decode("content", "UTF-8").alias("html"))


def book_members(pages: DataFrame, book: str, order: str, html: str, title: str) -> DataFrame:
    """Rows for write_archives(): each book's pages as an e-book with container, package and contents."""
    ids = pages.select(F.col(book).cast("string").alias("_b"), F.col(order).alias("_o"), html, _escaped(title).alias("_t"))
    ids = ids.withColumn("_name", F.format_string("c%08d.xhtml", F.col("_o")))
    row = lambda d, order_, member, content: d.select(F.concat("_b", F.lit(".epub")).alias("archive"), order_.cast("long").alias("ord"), member.alias("member"), content.cast("binary").alias("content"))
    books = ids.select("_b").distinct()
    listed = ids.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_o", "_name", "_t"))).alias("_all"))  # a line for each page, not its text
    joined = lambda f: F.array_join(F.transform("_all", f), "")
    opf = F.concat(F.lit('<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'), joined(lambda x: F.format_string('<item id="i%d" href="%s" media-type="application/xhtml+xml"/>', x["_o"], x["_name"])), F.lit("</manifest><spine>"), joined(lambda x: F.format_string('<itemref idref="i%d"/>', x["_o"])), F.lit("</spine></package>"))
    nav = F.concat(F.lit("<html><body><nav><ol>"), joined(lambda x: F.format_string('<li><a href="%s">%s</a></li>', x["_name"], x["_t"])), F.lit("</ol></nav></body></html>"))
    container = F.lit('<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
    parts = [row(books, F.lit(-4), F.lit(MIMETYPE), F.lit(EPUB.decode())), row(books, F.lit(-3), F.lit(CONTAINER), container), row(listed, F.lit(-2), F.lit("OEBPS/content.opf"), opf), row(listed, F.lit(-1), F.lit("OEBPS/nav.xhtml"), nav), row(ids, F.col("_o"), F.concat(F.lit("OEBPS/"), "_name"), F.coalesce(F.col(html), F.lit("")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _escaped(column: str):
    text = F.coalesce(F.col(column), F.lit(""))
    for sign, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(said))
    return text
