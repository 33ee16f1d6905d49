"""Text files, archives, folders and delimited tables as documents.

Spark's readers find and open the files (so any store that Spark reads will do); decoding and unpacking, which
have no built-in form, run in Arrow batches on the executors."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text as tx

from .encodings import detect
from .records import parse, read_delimited

#: fixed values: tried in this order
ENCODINGS = ["utf-8", "cp932", "euc_jp"]
EXTENSIONS = (".txt", ".pdf")
_BOM = b"\xef\xbb\xbf"


def decode_bytes(data: bytes) -> tuple[str, str]:
    """(text, encoding).  A guessed or forced decoding says so."""
    if data.startswith(_BOM):
        return data[3:].decode("utf-8", "replace"), "utf-8-sig"
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    if guess := detect(data):
        return data.decode(guess, "replace"), f"{guess} (detected)"
    return data.decode("utf-8", "replace"), "utf-8 (forced)"


def stem(name: str) -> str:
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base else base


def read_pdf(data: bytes) -> tuple[str, str]:
    """Needs pypdf, an optional library."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf library") from e
    pages = []
    reader = PdfReader(io.BytesIO(data))
    for p in reader.pages:
        try:
            pages.append(p.extract_text() or "")
        except Exception:  # a damaged page is empty, the others stay
            pages.append("")
    return "\n\n".join(pages), f"PDF ({len(reader.pages)} pages)"


def unpack(name: str, data: bytes) -> list[tuple[str, str, str]]:
    """(name, text, encoding) of a file or of an archive's entries, in order of their names."""
    low = name.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted(i.filename for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(EXTENSIONS) and "__MACOSX" not in i.filename)
            return [x for n in names for x in unpack(n, z.read(n))]
    text, encoding = read_pdf(data) if low.endswith(".pdf") else decode_bytes(data)
    return [(stem(name), text, encoding)]


def _unpack_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(path, i, *x) for path, data in zip(pdf["path"], pdf["content"], strict=True) for i, x in enumerate(unpack(path, data))]
        yield pd.DataFrame(rows, columns=["path", "entry", "name", "text", "encoding"])


def numbered(docs: DataFrame, *order: str) -> DataFrame:
    """docs + doc_id, from 0 in the order given.  A number needs all before it: buckets of the first column's range are
    counted, and numbered from the sums of those before; no task sorts everything."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = docs.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    counts = laid.groupBy("__part").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("__part").alias("__p"), (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))  # a row a partition
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = laid.join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return out.select((F.col("__start") + rank - 1).cast("long").alias("doc_id"), *docs.columns)


def read_files(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """doc_id, name, text, encoding: one document a file (or entry of an archive), by path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    found = raw.where(F.rlike(F.lower("path"), F.lit(r"\.(txt|pdf|zip)$"))).select("path", "content")
    docs = found.mapInPandas(_unpack_batches, "path string, entry long, name string, text string, encoding string")
    cleaned = docs.withColumn("text", F.when(F.startswith("encoding", F.lit("PDF")), tx.clean_pdf_text(F.col("text"))).otherwise(F.col("text")))
    return numbered(cleaned, "path", "entry").drop("path", "entry")


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of a folder but for word lists."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).where(~F.col("path").endswith("-words.txt"))
    docs = raw.select("path", "content").mapInPandas(_unpack_batches, "path string, entry long, name string, text string, encoding string")
    return numbered(docs, "path", "entry").drop("path", "entry")


def sniff_separator(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_table(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None) -> DataFrame:
    """A delimited table, all columns as strings; tabs for .tsv, else the separator that the first lines show."""
    if path.lower().endswith((".xlsx", ".xlsm", ".xls")):
        return spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda d: d.notna(), None))
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("h")).first()
    start = bytes(head["h"]) if head else b""
    text, found = decode_bytes(start[: start.rfind(b"\n") + 1] or start if len(start) == 65536 else start)  # no character is cut in two
    encoding = encoding or ("utf-8" if found.startswith("utf-8") else found.split(" ")[0])
    separator = separator or ("\t" if path.lower().endswith(".tsv") else sniff_separator("\n".join(text.splitlines()[:20])))
    if encoding.lower().startswith(("utf-16", "utf-32")):  # in which a line end is no octet of its own: a file is one task
        return spark.read.csv(path, header=True, inferSchema=False, sep=separator, multiLine=True, encoding=encoding, escape='"')
    columns = parse(_header(text).encode(encoding, "replace"), encoding, separator)
    return read_delimited(spark, path, [c if c is not None else f"_c{i}" for i, c in enumerate(columns)], encoding, separator)


def _header(text: str) -> str:
    """The first record: up to the first line end outside quotation marks."""
    lines = text.lstrip("\r\n").split("\n")
    for i in range(len(lines)):
        if "\n".join(lines[: i + 1]).count('"') % 2 == 0:
            return "\n".join(lines[: i + 1])
    return text


def read_frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """id, word, freq without header or quoting."""
    return spark.read.csv(path, sep="\t", quote="", schema="id bigint, word string, freq bigint")


def short_pdfs(docs: DataFrame, least: int = 50) -> DataFrame:
    """PDF documents with hardly any text, as scans have."""
    return docs.where(F.startswith("encoding", F.lit("PDF")) & (F.length(F.trim("text")) < least))
