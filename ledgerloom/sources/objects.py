"""Document files: listing, extraction into blocks, golden sets, and table sinks."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.chunking import split_turns
from ledgerloom.operators.ledger import parse_key, swap, upsert_latest

MOST_BYTES = 100 * 1024 * 1024


def list_objects(spark: SparkSession, root: str, pattern: str = "*.pdf", symbol: str | None = None, year: int | None = None) -> DataFrame:
    """Files under a bucket folder with company, title and year parsed from their paths; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")
    out = files.select("*", *parse_key("path"))
    if symbol:
        out = out.where(F.col("key_symbol") == symbol.upper())
    return out.where(F.col("key_year") == year) if year else out


def text_blocks(content: bytes) -> list[tuple[str, str]]:
    """(block_type, text) of plain text or HTML: the default parser."""
    text = content.decode("utf-8", "replace")
    if re.search(r"<(?:html|body|p|div)\b", text, re.I):
        text = html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?i)</(?:p|div|h[1-6]|tr|li)>|<br\s*/?>", "\n\n", text)))
    blocks = [b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()]
    return [("table" if " | " in b else "section_header" if b.isupper() and len(b) < 80 else "prose", b) for b in blocks]


Parser = Callable[[bytes], list[tuple[str, str]]]


def call_blocks(content: bytes) -> list[tuple[str, str]]:
    """(block_type, text) of a call's transcript: each paragraph that begins with a speaker's label is a turn."""
    out = []
    for kind, text in text_blocks(content):
        parts = split_turns(text) if kind != "table" else []
        out += [("speaker_turn", f"{who}: {said}") if who else ("prose", said) for who, said in parts] or [(kind, text)]
    return out


#: The parser of each type of document; others are an error of their file.
PARSERS: dict[str, Parser] = {"annual_report": text_blocks, "concall": call_blocks}


def extract_typed(spark: SparkSession, root: str, pattern: str = "*", parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """Blocks of the files under root, each parsed by its document type, which is the folder right under root: path, doc_type, block_index, block_type, text, error."""
    typed = {kind: extract(spark, f"{root}/{kind}", pattern, parser).withColumn("doc_type", F.lit(kind)) for kind, parser in parsers.items() if folder_exists(spark, f"{root}/{kind}")}
    if not typed:
        return spark.createDataFrame([], "path string, doc_type string, block_index int, block_type string, text string, error string")
    return reduce(DataFrame.unionByName, typed.values()).select("path", "doc_type", "block_index", "block_type", "text", "error")


def folder_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def extract(spark: SparkSession, root: str, pattern: str = "*", parser: Parser = text_blocks) -> DataFrame:
    """Blocks of every file: path, block_index, block_type, text, error. A file that is too large or fails gives one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    if content is None:
                        raise ValueError("too large")
                    out += [(path, i, kind, text, None) for i, (kind, text) in enumerate(parser(bytes(content)))]
                except Exception as problem:  # noqa: BLE001 - belongs to its file
                    out.append((path, None, None, None, str(problem)))
            yield pd.DataFrame(out, columns=["path", "block_index", "block_type", "text", "error"]).astype({"block_index": "Int32"})

    return files.mapInPandas(parse, "path string, block_index int, block_type string, text string, error string")


def golden_json(spark: SparkSession, path: str) -> DataFrame:
    """A golden set saved as JSON: query, symbol, doc_type, years, relevant_ids, graded_ids, notes."""
    schema = "query string, symbol string, doc_type string, years array<int>, relevant_ids array<string>, graded_ids map<string,int>, notes string"
    return spark.read.schema(schema).option("multiLine", "true").json(path).where("query is not null")


def golden_csv(spark: SparkSession, path: str) -> DataFrame:
    """A golden set from CSV; ids as a JSON array or a comma list, years as a JSON array; rows without query or ids are left out."""
    raw = spark.read.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    ids = F.coalesce(F.from_json("relevant_ids", "array<string>"), F.transform(F.split("relevant_ids", ","), lambda x: F.trim(x)))
    return raw.select("query", F.nullif("symbol", F.lit("")).alias("symbol"), "doc_type", F.from_json("years", "array<int>").alias("years"), F.filter(ids, lambda x: x != "").alias("relevant_ids")).where("query is not null and size(relevant_ids) > 0")


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a relational database, read by Spark's JDBC source."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def save_points(df: DataFrame, path: str) -> None:
    """Points partitioned by document type, so that a search of one type reads one folder."""
    df.write.mode("overwrite").partitionBy("doc_type").parquet(path)


def scalar(df: DataFrame) -> float | None:
    """The first value of a result as a number; None where there is none or it is no number."""
    first = df.select(F.col(df.columns[0]).cast("string").try_cast("double")).first()
    return first[0] if first else None


def load_points(chunks: DataFrame, path: str, embedder, key: str = "chunk_id", version: str = "loaded_at") -> None:
    """Embeds chunks and folds them into the stored points by key, the last version of each winning; the store is made if it is missing."""
    spark = chunks.sparkSession
    new = chunks.withColumn("vector", embedder("text"))
    old = spark.read.parquet(path) if folder_exists(spark, path) else new.limit(0)
    swap(upsert_latest(old.select(*new.columns), new, key, [version]), path)
