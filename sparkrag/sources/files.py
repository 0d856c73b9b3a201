"""Sources and sinks: corpus folders, pages, message archives, golden sets, versioned tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.functions import text as T
from sparkrag.session import saved
from sparkrag.sources.store import Store

BUCKETS = {
    "text_like": ["txt", "md", "rst", "csv"], "pdf": ["pdf"], "office": ["docx", "pptx", "xlsx", "odt", "odp", "ods"],
    "web": ["html", "htm", "xhtml"], "image": ["png", "jpg", "jpeg", "tiff", "bmp", "webp"],
}


def discover(spark: SparkSession, root: str, allowed: list[str]) -> DataFrame:
    """path, ext, bucket, length, mtime of the allowed files under root, by path; bucket is null where no family takes
    the suffix. A missing root gives no rows. File contents are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    schema = "path string, ext string, bucket string, length long, mtime timestamp"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    family = F.lit(None).cast("string")
    for name, suffixes in BUCKETS.items():
        family = F.when(F.col("ext").isin([f".{s}" for s in suffixes]), F.lit(name)).otherwise(family)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select("path", T.extension(F.col("path")).alias("ext"), "length", F.col("modificationTime").alias("mtime"))
    return files.where(F.col("ext").isin([s if s.startswith(".") else f".{s}" for s in map(str.lower, allowed)])).select("path", "ext", family.alias("bucket"), "length", "mtime").orderBy("path")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every file with its name, type, time, content and content hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", T.file_name(F.col("path")).alias("file_name"), T.extension(F.col("path")).alias("file_type"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"), T.content_hash(F.col("content")).alias("content_hash"))


class _Markdown(HTMLParser):
    """Text of a page: headings as # lines, blocks as paragraphs; what is not read by people is left out."""

    SKIP = ("script", "style", "nav", "noscript", "template")
    BLOCKS = ("p", "div", "li", "tr", "section", "article", "br", "ul", "ol", "table", "header", "footer", "main", "body", "blockquote", "pre")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.title, self.skipped, self.in_title = [""], "", 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skipped += 1
        elif tag == "title":
            self.in_title = True
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.lines.append("#" * int(tag[1]) + " ")
        elif tag in self.BLOCKS:
            self.lines.append("- " if tag == "li" else "")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in self.BLOCKS or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skipped:
            self.lines[-1] += (" " if data[:1].isspace() else "") + " ".join(data.split()) + (" " if data[-1:].isspace() else "")


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """page_id, url, title, markdown of raw pages (page_id, url, html)."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, bodies = [], []
            for html in batch.column("html").to_pylist():
                p = _Markdown()
                p.feed(html or "")
                p.close()
                lines = [" ".join(x.split()) for x in p.lines]
                bodies.append("\n\n".join(x for x in lines if x.strip("#- ")))
                first = next((x.lstrip("# ") for x in lines if x.startswith("# ")), "")
                titles.append(" ".join(p.title.split()) or first)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(titles, pa.string()), pa.array(bodies, pa.string())], names=["page_id", "url", "title", "markdown"])

    return pages.select("page_id", "url", "html").mapInArrow(convert, "page_id long, url string, title string, markdown string")


ARCHIVE = {
    "handle": "ROWID long, id string",
    "chat": "ROWID long, guid string, display_name string",
    "chat_handle_join": "chat_id long, handle_id long",
    "message": "ROWID long, guid string, text string, date long, is_from_me int, handle_id long, associated_message_type int, associated_message_guid string",
    "chat_message_join": "chat_id long, message_id long",
}


def read_archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five tables of a message archive, with their declared columns."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in ARCHIVE.items()}


MESSAGES = "guid string, thread_id string, thread_name string, sender_handle string, sender_name string, is_from_me boolean, ts timestamp, text string, tapbacks array<struct<kind:string,sender_name:string>>"

#: How message files of a suffix are read, given a reader with the messages' schema.
MESSAGE_READERS: dict[str, Callable] = {"jsonl": lambda reader, root: reader.option("mode", "FAILFAST").json(root), "parquet": lambda reader, root: reader.parquet(root)}


def message_batches(spark: SparkSession, root: str, readers: dict[str, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages with batch_id and relative_path; path of the files that no reader takes). A batch is a file: its id is
    made of its path below root and the hash of its bytes, so a file that comes again unchanged keeps its id."""
    readers = MESSAGE_READERS if readers is None else readers
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(plain(F.col("path")).alias("path"), T.content_hash(F.col("content")).alias("digest"))
    files = files.withColumn("relative_path", F.substr("path", F.length(plain(F.lit(top))) + 2))
    files = saved(files.withColumn("batch_id", T.derive_doc_id(F.col("relative_path"), F.col("digest"))), "message-files")
    taken = F.substring_index("path", ".", -1)
    out = spark.createDataFrame([], f"{MESSAGES}, batch_id string, relative_path string")
    for suffix, read in readers.items():
        if not files.where(taken == suffix).isEmpty():
            reader = spark.read.schema(MESSAGES).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}")
            own = read(reader, root).select("*", plain(F.col("_metadata.file_path")).alias("path"))
            out = out.unionByName(own.join(files.select("path", "batch_id", "relative_path"), "path").drop("path"))
    return out, files.where(~taken.isin(list(readers))).select("path")


GOLDEN = "query string, relevant array<struct<rel_source:string,chunk_index:int,fact:string>>"


def read_golden(spark: SparkSession, path: str, schema: str = GOLDEN, unique: bool = False) -> DataFrame:
    """A golden set from JSON lines. A malformed line fails the load, as do an empty set and, with unique, a query twice."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"{path}: no golden entries")
    if unique and (twice := df.groupBy("query").count().where("count > 1").first()):
        raise ValueError(f"{path}: query given twice: {twice['query']}")
    return df


CONVERSATION = "name string, turns array<struct<query:string,kind:string,assistant:string,relevant:array<struct<rel_source:string,chunk_index:int,fact:string>>>>"


def read_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """name, turn, query, kind, assistant, relevant of scripted conversations, one JSON file each; broken rules fail."""
    files = spark.read.schema(CONVERSATION).option("multiLine", "true").option("mode", "FAILFAST").json(folder)
    turns = files.select("name", F.size("turns").alias("n"), F.posexplode("turns").alias("turn", "t")).select("name", "n", "turn", "t.*")
    broken = turns.where(((F.col("turn") == 0) & F.col("kind").isNotNull()) | ((F.col("turn") > 0) & F.col("kind").isNull()) | ((F.col("turn") < F.col("n") - 1) & F.col("assistant").isNull()))
    if row := broken.first():
        raise ValueError(f"conversation {row['name']}, turn {row['turn']}: against the rules for kind and assistant")
    if row := files.groupBy("name").count().where("count > 1").first():
        raise ValueError(f"conversation name given twice: {row['name']}")
    return turns.drop("n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys new does not have."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def write_version(tables: dict[str, DataFrame], root: str) -> int:
    """Make tables, whole, the next version under root; readers see all or nothing of it. Returns the version's number."""
    spark = next(iter(tables.values())).sparkSession
    return Store(spark, root, {name: [] for name in tables}).commit(dict(tables), replace=True)


def read_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest version under root, or of that number."""
    return Store(spark, root, {name: []}).read(name, version=version)


def write_results(df: DataFrame, root: str, kind: str) -> str:
    """A timestamped JSON result; returns its folder."""
    path = f"{root}/{kind}-{datetime.now(UTC):%Y%m%dT%H%M%S%f}"
    df.coalesce(1).write.json(path)
    return path
