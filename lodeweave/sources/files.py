"""File sources and sinks: scraped JSON, collections of vectors, exports, PDFs, and the web as a data source."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodeweave.sources.buckets import Versions
from lodeweave.sources.fetching import FETCHED, Fetcher

SCRAPED = "url string, title string, content string, metadata map<string,string>, timestamp string, success boolean, error_message string"
STORE = "id string, text string, embedding array<float>, source_url string, title string, category string, chunk_index int, total_chunks int, collection string"


def read_scraped(spark: SparkSession, path: str, only_successful: bool = True) -> DataFrame:
    """A JSON array, or lines of JSON if the name ends in .jsonl."""
    rows = spark.read.schema(SCRAPED).option("multiLine", not path.endswith(".jsonl")).json(path)
    return rows.where("success") if only_successful else rows


def write_rows(df: DataFrame, path: str, fmt: str = "json") -> None:
    """json lines, csv with a header, or text from a column `line`; other formats are refused."""
    if fmt in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt in ("txt", "text"):
        df.select("line").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def cache_export(cache: DataFrame) -> DataFrame:
    """The cache as its CSV export has it, sorted by category and url."""
    names = {"url": "URL", "category": "Category", "last_scraped": "Last Scraped", "success": "Success", "status_code": "Status Code"}
    return cache.orderBy("category", "url").select(*[F.col(k).alias(v) for k, v in names.items()])


def open_store(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    rows = spark.read.schema(STORE).parquet(path)
    return rows if collection is None else rows.where(F.col("collection") == collection)


def collections(spark: SparkSession, path: str) -> DataFrame:
    return open_store(spark, path).select("collection").distinct().orderBy("collection")


def add_to_store(rows: DataFrame, path: str, exists: bool) -> int:
    """Insert rows whose id isn't stored yet; returns how many. The store is partitioned by collection."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(["collection", "id"])
    if exists:
        rows = rows.join(open_store(spark, path).select("collection", "id"), ["collection", "id"], "left_anti")
    from lodeweave.session import written

    rows = written(rows.select("id", "text", "embedding", "source_url", "title", "category", "chunk_index", "total_chunks", "collection"), "store")
    rows.write.mode("append").partitionBy("collection").parquet(path)
    return rows.count()


def delete_source(spark: SparkSession, path: str, source_url: str, to: str) -> None:
    """The store without a source's rows, as a new version in `to`: what is read is never overwritten."""
    open_store(spark, path).where(~F.col("source_url").eqNullSafe(F.lit(source_url))).write.mode("overwrite").partitionBy("collection").parquet(to)


#: Additions beside a version of a store before they are folded into a new one.
ADDITIONS = 8


class ParquetStore:
    """A store in versions v0, v1, ... below a folder, and additions v0.1, v0.2, ... beside the one that holds.

    Each is a folder that counts once it is whole: a failed or concurrent write is never read half-done, and what is read is
    never overwritten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def _folders(self) -> list[str]:
        base = self.versions.base()
        return [] if base is None else [f"{self.versions.path}/v{base}", *self.versions.additions()]

    def rows(self, collection: str | None = None) -> DataFrame:
        parts = [open_store(self.spark, p, collection) for p in self._folders()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], STORE)

    def _save(self, rows: DataFrame, to: str) -> None:
        rows.select(*[f.split()[0] for f in STORE.split(", ")]).write.mode("overwrite").partitionBy("collection").parquet(to)

    def add(self, rows: DataFrame) -> int:
        """Rows whose id the collection doesn't hold yet are added; returns how many."""
        rows = rows.dropDuplicates(["collection", "id"])
        if folders := self._folders():
            rows = rows.join(self.rows().select("collection", "id"), ["collection", "id"], "left_anti")
        to = self.versions.next_addition() if folders else self.versions.next_base()
        self._save(rows, to)
        if len(self.versions.additions()) >= ADDITIONS:
            self._save(self.rows(), self.versions.next_base())
        return open_store(self.spark, to).count()

    def search(self, query: list[float], k: int = 10, where: Column | None = None, threshold: float = 0.1) -> DataFrame:
        from lodeweave.operators.retrieval import search

        return search(self.rows(), query, k, where, threshold)

    def delete_by_source(self, source_url: str) -> None:
        if self._folders():
            self._save(self.rows().where(~F.col("source_url").eqNullSafe(F.lit(source_url))), self.versions.next_base())

    def count(self) -> int:
        return self.rows().count()


def listed_chunks(store: DataFrame, limit: int = 0) -> DataFrame:
    rows = store.orderBy("source_url", "chunk_index")
    return rows.limit(limit) if limit else rows


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], tuple[str, int, str]] | None = None) -> DataFrame:
    """(url, title, text, num_pages, file_size, extraction_method, success, error) of PDF files.

    extract turns bytes into text, number of pages and a method name; the default tries the PDF libraries that are installed.
    """
    method = extract or installed_extractor()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "length", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, size, content in zip(batch["path"], batch["length"], batch["content"], strict=True):
                title = re.sub(r"\.pdf$", "", at.rsplit("/", 1)[-1], flags=re.I)
                try:
                    text, pages, name = method(bytes(content))
                    rows.append((at, title, text, pages, size, name, len(text) > 0, None))
                except Exception as e:  # a broken file is a row with its error
                    rows.append((at, title, "", 0, size, "none", False, str(e)))
            yield pd.DataFrame(rows, columns=["url", "title", "text", "num_pages", "file_size", "extraction_method", "success", "error"])

    return files.mapInPandas(run, "url string, title string, text string, num_pages int, file_size long, extraction_method string, success boolean, error string")


def installed_extractor() -> Callable[[bytes], tuple[str, int, str]]:
    def run(data: bytes) -> tuple[str, int, str]:
        import io

        try:
            import pdfplumber
        except ImportError:
            pdfplumber = None
        if pdfplumber is not None:
            with pdfplumber.open(io.BytesIO(data)) as pdf:
                parts = []
                for i, page in enumerate(pdf.pages, 1):
                    parts.append(page_part(i, page.extract_text() or "", page.extract_tables()))
                text = "\n\n".join(p for p in parts if p)
                if len(text) >= 100:
                    return text, len(pdf.pages), "pdfplumber"
        import pypdf

        reader = pypdf.PdfReader(io.BytesIO(data))
        text = "\n\n".join(page_part(i, p.extract_text() or "", []) for i, p in enumerate(reader.pages, 1))
        return text, len(reader.pages), "pypdf"

    return run


def page_part(number: int, text: str, tables: list[list[list[object]]]) -> str:
    """A page's text under its marker, then its tables, cells by tabs and rows by lines."""
    parts = [f"--- Page {number} ---\n{text}"] if text else []
    for k, rows in enumerate(tables, 1):
        parts.append(f"[Table {k}]\n" + "\n".join("\t".join(str(c) for c in row) for row in rows))
    return "\n\n".join(parts)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class WebReader(DataSourceReader):
    """Fetches urls by `fetching.Fetcher`, some per partition and several at a time, for short lists; `fetching.fetch_table` takes tables.

    Options: urls (one per line), urlsPerPartition, concurrency, and the fetcher's.
    """

    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.per_partition, self.concurrency = int(options.get("urlsPerPartition", "50")), int(options.get("concurrency", "5"))
        self.fetcher = Fetcher(options)

    def partitions(self):
        n = self.per_partition
        return [_Urls(self.urls[i : i + n]) for i in range(0, len(self.urls), n)] or [_Urls([])]

    def read(self, partition):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(max(1, self.concurrency)) as pool:
            yield from pool.map(self.fetcher.fetch, partition.urls)


class WebSource(DataSource):
    """spark.dataSource.register(WebSource); spark.read.format("pages").option("urls", ...).load()"""

    @classmethod
    def name(cls):
        return "pages"

    def schema(self):
        return FETCHED

    def reader(self, schema):
        return WebReader(self.options)


def fetched(spark: SparkSession, urls: list[str], **options: object) -> DataFrame:
    """One row of FETCHED for each url of a short list; for a table see `fetching.fetch_table`."""
    spark.dataSource.register(WebSource)
    return spark.read.format("pages").options(urls="\n".join(urls), **options).load()


def observed(pages: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The rows, and what can be asked once they have been used: how many were fetched, and how many of these failed."""
    seen = Observation(name)
    return pages.observe(seen, F.count("*").alias("fetched"), F.count_if(~F.col("success")).alias("failed")), seen


def crawled_links(pages: DataFrame, domains: list[str]) -> DataFrame:
    """(url, link, kind) of the links of fetched pages that a crawl follows; failed pages have none."""
    from lodeweave.functions import html as H
    from lodeweave.functions import urls as U

    links = pages.where("success").select("url", F.explode(H.crawl_links_udf("url", "html")).alias("link"))
    return links.withColumn("kind", U.link_kind(F.col("link"), domains)).where("kind IS NOT NULL")


def downloaded_pdfs(files: DataFrame) -> DataFrame:
    """(url, filename, content, file_size) of fetched PDFs (binary=true)."""
    from lodeweave.functions import urls as U

    return files.where("success").select("url", U.pdf_filename(F.col("url")).alias("filename"), "content", F.length("content").cast("long").alias("file_size"))


def pdf_documents(pdfs: DataFrame, extract: Callable[[bytes], tuple[str, int, str]] | None = None) -> DataFrame:
    """(url, title, text, num_pages, file_size, extraction_method, success, error, programme, document_type, degree) of PDFs (url, content, file_size).

    extract may return the document's own title as a fourth value; without one the title is the last part of the address, without .pdf.
    """
    from lodeweave.functions import urls as U

    method = extract or installed_extractor()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, size, content in zip(batch["url"], batch["file_size"], batch["content"], strict=True):
                title = re.sub(r"\.pdf$", "", re.sub(r"[?#].*", "", url).rsplit("/", 1)[-1], flags=re.I)
                try:
                    text, pages, name, *own = method(bytes(content))
                    rows.append((url, own[0] if own and own[0] else title, text, pages, size, name, len(text) > 0, None))
                except Exception as e:  # a broken file is a row with its error
                    rows.append((url, title, "", 0, size, "none", False, str(e)))
            yield pd.DataFrame(rows, columns=["url", "title", "text", "num_pages", "file_size", "extraction_method", "success", "error"])

    out = pdfs.select("url", "file_size", "content").mapInPandas(run, "url string, title string, text string, num_pages int, file_size long, extraction_method string, success boolean, error string")
    u = F.col("url")
    return out.withColumns({"programme": U.study_programme(u), "document_type": U.document_type(u), "degree": U.degree(u)})


def robots_rules(text: str, agent: str = "*") -> Callable[[str], bool]:
    """Whether a url may be fetched, by the text of robots.txt; all may if it is empty."""
    from urllib.robotparser import RobotFileParser

    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return lambda url: parser.can_fetch(agent, url)


def robots_addresses(urls: DataFrame) -> DataFrame:
    """(netloc, robots_url) of the hosts of `urls`, each once."""
    from lodeweave.functions import urls as U

    u = F.col("url")
    return urls.select(U.netloc(u).alias("netloc"), F.concat(U.scheme(u), F.lit("://"), U.netloc(u), F.lit("/robots.txt")).alias("robots_url")).dropDuplicates(["netloc"])


def allowed_by_robots(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """`urls` with may_fetch, by the rules (netloc, text) of their hosts; a host without rules allows all."""
    from lodeweave.functions import urls as U

    @F.pandas_udf("boolean")
    def judge(url: pd.Series, text: pd.Series) -> pd.Series:
        rules = {t: robots_rules(t, agent) for t in text.dropna().unique()}
        return pd.Series([t is None or pd.isna(t) or rules[t](u) for u, t in zip(url, text, strict=True)])

    known = robots.select(F.col("netloc").alias("_netloc"), F.col("text").alias("_robots"))
    rows = urls.join(known, U.netloc(F.col("url")) == F.col("_netloc"), "left")
    return rows.withColumn("may_fetch", judge("url", "_robots")).drop("_netloc", "_robots")
