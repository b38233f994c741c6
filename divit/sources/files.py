"""Readers of text, EPUB and HTML files, tab-separated lexicons and logs, and a writer of text. Bytes reach Python in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from divit.functions.normalize import eastern_digits, turkish_lower


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skipped:
            self.skipped -= 1

    def handle_data(self, data):
        if not self.skipped and data.strip():
            self.parts.append(data.strip())


def strip_markup(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.parts)


def html_text(html: Column) -> Column:
    """The text of a page, one line per run; scripts and styles go. Null gives the empty text.

    Pages reach Python a few megabytes at a time, are parsed one by one, and workers give freed memory back when a task ends.
    """
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    @arrow_udf("string")
    def strip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([strip_markup(page.as_py()) for page in pages], pa.string())
        pages = None
        give_back()

    return strip(html)


def give_back() -> None:
    """Hand a worker's freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of UTF-8 files; bytes that are not UTF-8 are dropped."""

    @pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", decode("content").alias("text"))


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """(path, item, text): each document of an EPUB in archive order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
                    pages = [n for n in book.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
                    out += [(name, i, strip_markup(book.read(n).decode("utf-8", "ignore"))) for i, n in enumerate(pages)]
            yield pd.DataFrame(out, columns=["path", "item", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, item long, text string")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(k, spelling) of a tab-separated file; comments, short rows and empty fields go."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("not startswith(value, '#')").where(F.size(parts) >= 2)
    return rows.select(F.trim(parts[0]).alias("k"), F.trim(parts[1]).alias("spelling")).where("k <> '' and spelling <> ''")


def chapters(lines: DataFrame, by: str, order: str, text: str, size: int = 200) -> DataFrame:
    """(by, chapter, n_lines, body): lines in chapters of `size`, each line after the other."""
    w = Window.partitionBy(by).orderBy(order)
    numbered = lines.select(by, text, F.row_number().over(w).alias("i")).withColumn("chapter", ((F.col("i") - 1) / size).cast("long") + 1)
    body: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text))), lambda s: s[text]), "\n")
    return numbered.groupBy(by, "chapter").agg(F.count(F.lit(1)).alias("n_lines"), body.alias("body"))


def write_txt(df: DataFrame, path: str, text: str = "text") -> None:
    """Text files with Eastern digits."""
    df.select(eastern_digits(F.col(text)).alias("value")).write.text(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(k) of a file with a key a line, lower-cased; comments and blank lines go."""
    rows = spark.read.text(path).select(turkish_lower(F.trim("value")).alias("k"))
    return rows.where("k <> '' and not startswith(k, '#')").distinct()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(latin, spelling, n) of tab-separated word pairs.

    A Latin side with a blank, hyphen, digit or Arabic letter goes, and so does a spelling with anything but Arabic script and blanks. Short rows and counts that
    are no numbers go.
    """
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(p) >= 3).select(F.trim(p[0]).alias("latin"), F.trim(p[1]).alias("spelling"), F.trim(p[2]).try_cast("long").alias("n"))
    return rows.where("latin <> '' and n is not null").where(~F.col("latin").rlike("[\\s\\-\\d\\u0600-\\u06FF]")).where(F.col("spelling").rlike("^[\\u0600-\\u06FF ]+$"))


def read_registry(spark: SparkSession, *paths: str, columns: int = 6) -> DataFrame:
    """(k, fields) of registry files in their order: the last line of a key wins, short rows are padded with empty fields."""
    rows = None
    for i, path in enumerate(paths):
        p = F.split("value", "\t")
        part = spark.read.text(path).select("value", F.lit(i).alias("file"), F.monotonically_increasing_id().alias("line"))
        part = part.where("value <> '' and not startswith(value, '#')").select(turkish_lower(F.trim(p[0])).alias("k"), "file", "line", F.transform(F.sequence(F.lit(1), F.lit(columns - 1)), lambda j: F.coalesce(F.get(p, j), F.lit(""))).alias("fields"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("k").agg(F.max_by("fields", F.struct("file", "line")).alias("fields"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, fields of `schema`) of JSON lines, each with its place; broken lines have null fields."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.from_json("value", schema).alias("j"))
    w = Window.partitionBy("file").orderBy("at")
    return rows.select("file", (F.row_number().over(w) - 1).alias("line"), "j.*")


class _Spans(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: list[tuple[bool, str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "span":
            named = dict(attrs)
            self.open.append(("kelime-grup" in (named.get("class") or "").split() and "data-latince" in named, named.get("data-latince") or "", []))

    def handle_endtag(self, tag):
        if tag == "span" and self.open:
            wanted, latin, parts = self.open.pop()
            if wanted:
                self.found.append((latin, "".join(parts).strip()))

    def handle_data(self, data):
        for _, _, parts in self.open:
            parts.append(data)


def word_spans(html: Column) -> Column:
    """The (latin, spelling) pairs of a page's annotated word groups, inner ones first; null gives none."""

    @pandas_udf("array<struct<latin:string,spelling:string>>")
    def spans(pages: pd.Series) -> pd.Series:
        def of(page):
            parser = _Spans()
            parser.feed(page or "")
            parser.close()
            return [{"latin": a, "spelling": b} for a, b in parser.found]

        return pages.map(of)

    return spans(html)


def payload(value: Column, item: str) -> Column:
    """The items of a JSON text that is either a bare list or an object with a list in `data`; anything else gives null."""
    return F.coalesce(F.when(F.trim(value).startswith("["), F.from_json(value, f"array<{item}>")), F.from_json(value, f"data array<{item}>")["data"])
