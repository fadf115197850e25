"""Sources and sinks: sniffed binary files, decoded text, archives with a manifest, annotation exports, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes in hex, and the kind of file they tell.
MAGIC = [("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("474946383961", "gif"), ("474946383761", "gif"), ("25504446", "pdf"), ("504B0304", "zip"), ("EA44524D494F4EEE", "drm"), ("434F4E54", "ebook"), ("52494646", "riff"), ("3C3F786D6C", "xml")]


def sniff(content: Column, path: Column) -> Column:
    """The kind of a file by its first bytes, else by the end of its name."""
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for magic, kind in MAGIC:
        out = F.when(head.startswith(magic), kind) if out is None else out.when(head.startswith(magic), kind)
    # what such a container holds is told by its second word
    webp = head.startswith("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    mobi = F.decode(F.substring(content, 61, 8), "ISO-8859-1") == "BOOKMOBI"
    return F.when(webp, "webp").otherwise(out.when(mobi, "mobi").otherwise(F.coalesce(F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("unknown"))))


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, kind, content) of files; the content column is read only if it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", sniff(F.col("content"), F.col("path")).alias("kind"), "content")


def _windows_1252(content: Column) -> Column:
    """Latin-1, with the signs that windows-1252 has in place of its second block of control characters."""
    codes = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, codes)), bytes(codes).decode("cp1252"))


def decode_text(content: Column, hint: str | None = None) -> Column:
    """UTF-8 where it is valid, else the hinted encoding (of those that Spark decodes), else windows-1252; a byte-order mark is dropped."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, hint) if hint else _windows_1252(content))
    return F.regexp_replace(text, "^﻿", "")


def listing(entities: DataFrame, kind: str, payload: str) -> DataFrame:
    """(kind, n, bytes) of a container's parts."""
    return entities.groupBy(kind).agg(F.count("*").alias("n"), F.sum(F.octet_length(payload)).alias("bytes"))


def backup(tables: dict[str, DataFrame], path: str, version: int = 1) -> DataFrame:
    """Writes tables and a manifest (name, n, digest, version): the digest does not depend on the order of rows."""
    rows = []
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, *_summary(spark.read.parquet(f"{path}/{name}")), version))
    manifest = spark.createDataFrame(rows, "name string, n long, digest string, version int")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def _summary(t: DataFrame) -> tuple[int, str]:
    r = t.agg(F.count("*"), F.sum(F.xxhash64(*t.columns).cast("decimal(20,0)"))).first()
    return r[0], str(r[1])


def restore(spark: SparkSession, path: str, newest: int = 1) -> dict[str, DataFrame]:
    """The tables of a backup; a newer version, or rows that are not those of the manifest, are an error."""
    out = {}
    for r in spark.read.json(f"{path}/manifest").collect():
        if r.version > newest:
            raise ValueError(f"backup of version {r.version}")
        out[r.name] = t = spark.read.parquet(f"{path}/{r.name}")
        if _summary(t) != (r.n, r.digest):
            raise ValueError(f"{r.name} is damaged")
    return out


def annotations_markdown(rows: DataFrame, book: str, order: list[str], kind: str, text: str) -> DataFrame:
    """(book, markdown): a line for each annotation in reading order, by its kind."""
    line = F.when(F.col(kind) == "bookmark", F.lit("- (bookmark)")).when(F.col(kind) == "note", F.concat(F.lit("- **Note:** "), F.col(text))).otherwise(F.concat(F.lit("> "), F.replace(F.col(text), F.lit("\n"), F.lit("\n> "))))
    said = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(book).agg(F.array_join(F.transform(said, lambda x: x["line"]), "\n").alias("markdown"))


def rows_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
