"""The ingestion ledger: inserts if absent, upserts, deletes and counts as rewrites of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.fiscal import year_of_title

# Words that tell a document's class.
ANNUAL_WORDS = ("annual report", "annual-report", "annualreport", "integrated report")
CALL_WORDS = ("transcript", "concall", "con-call", "conference call", "earnings call")


def insert_if_absent(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows to append: new keys only, the first of each in the given order. NULL keys are never inserted."""
    w = Window.partitionBy(key).orderBy(*order)
    first = new.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.join(old.select(key).distinct(), key, "left_anti").select(*new.columns)


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Both united with the last version of each key."""
    both = old.unionByName(new)
    pick = F.max_by(F.struct(*both.columns), F.struct(*version))
    return both.groupBy(key).agg(pick.alias("_r")).select("_r.*")


def mark(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """Status 1 with counts for documents that were ingested, 2 for failures; others keep theirs. updates: id, ok, total_chunks, total_pages."""
    u = updates.select("id", "ok", F.col("total_chunks").alias("_chunks"), F.col("total_pages").alias("_pages"))
    return documents.join(u, "id", "left").select(
        *(
            F.when(F.col("ok"), F.lit(1)).when(~F.col("ok"), F.lit(2)).otherwise(F.col(c)).cast("tinyint").alias(c) if c == "ingested"
            else F.when(F.col("ok"), F.col("_chunks")).otherwise(F.col(c)).alias(c) if c == "total_chunks"
            else F.when(F.col("ok"), F.col("_pages")).otherwise(F.col(c)).alias(c) if c == "total_pages" else F.col(c)
            for c in documents.columns
        )
    )


def delete_where(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with deleted and remaining)."""
    hit = F.coalesce(condition, F.lit(False))
    return df.where(~hit), df.agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("remaining"))


def symbol_text(c: str = "symbol") -> Column:
    return F.upper(F.trim(c))


def pending(documents: DataFrame, symbol: str | None = None, doc_type: str | None = None) -> DataFrame:
    """Documents not yet ingested, of one company or type if given."""
    out = documents.where(F.col("ingested") == 0)
    if symbol:
        out = out.where(symbol_text() == symbol.upper())
    return out.where(F.col("doc_type") == doc_type) if doc_type else out


def stats(documents: DataFrame, chunks: DataFrame, companies: DataFrame) -> DataFrame:
    """One row of counts: companies, ingested documents, chunks."""
    one = companies.agg(F.countDistinct("id").alias("companies"))
    two = documents.where("ingested = 1").agg(F.countDistinct("id").alias("documents"))
    three = chunks.agg(F.countDistinct("id").alias("chunks"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))


def parse_key(key: str = "minio_key") -> list[Column]:
    """symbol, title and year of an object key 'bucket/symbol/year_title.pdf' (NULL title for anything but a PDF in a folder)."""
    parts = F.split(key, "/")
    good = F.lower(key).endswith(".pdf") & (F.size(parts) >= 2)
    name = F.element_at(parts, -1)
    return [F.when(good, F.upper(F.element_at(parts, -2))).alias("key_symbol"), F.when(good, F.regexp_replace(name, r"(?i)\.pdf$", "")).alias("key_title"), F.when(good, F.nullif(F.regexp_extract(name, r"^(\d{4})", 1), F.lit("")).try_cast("int")).alias("key_year")]


def document_class(title: str | Column) -> Column:
    """annual_report, concall or other, by the words of a title or address."""
    t = F.lower(title)
    has = lambda words: F.coalesce(t.rlike("|".join(words)), F.lit(False))
    return F.when(has(ANNUAL_WORDS) & ~t.contains("transcript"), "annual_report").when(has(CALL_WORDS) & ~t.contains("board meeting"), "concall").otherwise("other")


def safe_name(c: str | Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_"), 1, 100)


def links(pages: DataFrame) -> DataFrame:
    """Documents linked from company pages: page_id, url, title, year, doc_type.

    pages: page_id, url, html. Relative addresses are made absolute, others than http and the class
    'other' are dropped, and of several links of one class, year and title the first on the page stays.
    """
    anchor = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("label"))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("ord", "a"))
    base = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    href = F.when(F.col("a.href").rlike("^https?://"), F.col("a.href")).when(F.col("a.href").startswith("/"), F.concat(base, F.col("a.href"))).otherwise(F.when(F.col("a.href").rlike("^[a-z]+:"), None).otherwise(F.concat(base, F.lit("/"), F.col("a.href"))))
    title = F.trim(F.regexp_replace(F.regexp_replace("a.label", "<[^>]+>", " "), r"\s+", " "))
    both = rows.select("page_id", "ord", href.alias("url"), title.alias("title")).where(F.col("url").isNotNull())
    classed = both.withColumn("doc_type", document_class(F.concat_ws(" ", "title", "url"))).where("doc_type <> 'other'").withColumn("year", F.coalesce(year_of_title("title"), year_of_title("url")))
    w = Window.partitionBy("page_id", "doc_type", "year", F.lower("title")).orderBy("ord")
    return classed.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("page_id", "url", "title", "year", "doc_type")


#: The ledger's tables; a column is NOT NULL where the schema says so.
SCHEMAS = {
    "rag_companies": "id int not null, symbol string not null, name string, created_at timestamp_ntz",
    "rag_documents": "id int not null, company_id int, symbol string not null, doc_type string not null, year smallint, title string, minio_key string not null, file_size_kb int, total_pages int, total_chunks int, ingested tinyint not null, created_at timestamp_ntz",
    "rag_chunks": "id int not null, doc_id int not null, qdrant_id string not null, collection string not null, chunk_index int, chunk_type string, section string, speaker string, page_start int, page_end int, word_count int, created_at timestamp_ntz",
    "rag_ingestion_log": "symbol string, doc_type string, minio_key string, status string not null, message string, chunks_created int, duration_sec double, created_at timestamp_ntz",
}
UNIQUE = {"rag_companies": ("id", "symbol"), "rag_documents": ("id", "minio_key"), "rag_chunks": ("id", "qdrant_id")}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Creates the ledger's tables that are missing, and returns their names."""
    made = []
    for name, schema in SCHEMAS.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")
            made.append(name)
    return made


def existing(spark: SparkSession, database: str = "default") -> list[str]:
    """The names of the tables there are."""
    return sorted(t.name for t in spark.catalog.listTables(database))


def violations(df: DataFrame, name: str) -> DataFrame:
    """What breaks a table's constraints: constraint and rows, for every NULL in a NOT NULL column and every key that isn't unique. No row if all hold."""
    required = [part.split()[0] for part in SCHEMAS[name].split(", ") if part.endswith("not null")]
    nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required)).select(F.explode(F.array(*(F.struct(F.lit(f"{c} is null").alias("constraint"), F.col(c).alias("rows")) for c in required))).alias("v")).select("v.*")
    twice = [df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("rows")).select(F.lit(f"{c} is not unique").alias("constraint"), "rows") for c in UNIQUE.get(name, ())]
    return reduce(DataFrame.unionByName, [nulls, *twice]).where("rows > 0")


def log_entries(results: DataFrame, at: Column) -> DataFrame:
    """Rows to append to the ingestion log: one per document of a run, success or failed with its message."""
    ok = F.coalesce("ok", F.lit(False))
    return results.select("symbol", "doc_type", "minio_key", F.when(ok, "success").otherwise("failed").alias("status"), F.when(~ok, F.coalesce("message", F.lit("unknown error"))).alias("message"), F.when(ok, F.col("chunks")).otherwise(0).alias("chunks_created"), F.col("duration_sec").cast("double").alias("duration_sec"), at.alias("created_at"))


def append_log(results: DataFrame, at: Column, path: str) -> None:
    log_entries(results, at).write.mode("append").parquet(path)


def run_totals(log: DataFrame) -> DataFrame:
    """How many documents a log has, how many succeeded and failed, and how many chunks were made."""
    return log.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("chunks_created"), F.lit(0)).alias("chunks"))


def swap(df: DataFrame, path: str) -> None:
    """Replaces a table that may be among the sources of `df`: written beside it, then put in its place.

    The new table is complete before the old one goes, so a failed write leaves the old one as it is.
    """
    context = df.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path.rstrip('/')}._new", f"{path.rstrip('/')}._old"
    files = hadoop(path).getFileSystem(context._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(new)
    files.delete(hadoop(old), True)
    if files.exists(hadoop(path)):
        files.rename(hadoop(path), hadoop(old))
    files.rename(hadoop(new), hadoop(path))
    files.delete(hadoop(old), True)


def downloads(responses: DataFrame, least: int = 10 * 1024) -> DataFrame:
    """Fetched files that are documents: no HTML, and no stubs under 10 KB. responses: content_type, content or length."""
    size = F.col("length") if "length" in responses.columns else F.length("content")
    return responses.where(~F.lower(F.coalesce("content_type", F.lit(""))).contains("html") & (F.coalesce(size, F.lit(0)) >= least))


def chunks_of(chunks: DataFrame, doc_id: int) -> DataFrame:
    """A document's chunks in order."""
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index", "id")
