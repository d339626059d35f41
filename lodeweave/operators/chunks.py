"""Row-expanding chunkers: by sentences of a fixed budget, by paragraphs, by sentences and by headers.

`packed` is a fold over a split text in SQL expressions. The paragraph and header chunkers
keep a running list of pieces whose folds nest; they are Arrow-batched Python functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.urls import document_id

SIZE, OVERLAP, LEAST = 1500, 300, 200
CHUNK = "struct<text:string,header:string,header_level:int,chunk_index:int,total:int>"
_HEADER = re.compile(r"^(#+)\s+(.+)$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def packed(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Sentences cut at '. ' and packed greedily; a new chunk begins with the end of the one before."""
    from lodeweave.functions.text import strip

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, sentence: Column) -> Column:
        now = state["now"]
        longer = F.when(now != "", F.concat(now, F.lit(". "), sentence)).otherwise(sentence)
        done = F.when(now != "", F.concat(state["done"], F.array(strip(now)))).otherwise(state["done"])
        fresh = F.when((F.size(done) > 0) & F.lit(overlap > 0), F.concat(F.right(now, F.lit(overlap)), F.lit(". "), sentence)).otherwise(sentence)
        fits = F.length(longer) <= size
        return F.struct(F.when(fits, state["done"]).otherwise(done).alias("done"), F.when(fits, longer).otherwise(fresh).alias("now"))

    return F.aggregate(F.split(text, r"\. ", -1), start, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(strip(s["now"])))).otherwise(s["done"]))


def _greedy(pieces: list[str], glue: str, size: int, overlap: int) -> tuple[list[list[str]], list[str]]:
    """Full groups of pieces and the open one; the glue's length doesn't count."""
    full: list[list[str]] = []
    now: list[str] = []
    used = 0
    for piece in pieces:
        if now and used + len(piece) > size:
            full.append(now)
            carried = [now[-1][-overlap:]] if overlap > 0 else []
            now = [*carried, piece]
            used = sum(map(len, now))
        else:
            now.append(piece)
            used += len(piece)
    return full, now


def by_sentences(paragraph: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    pieces = [s for s in (p.strip() for p in _SENTENCE.split(paragraph)) if s]
    full, rest = _greedy(pieces, " ", size, overlap)
    return [" ".join(g) for g in [*full, rest] if g]


def by_paragraphs(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Paragraphs packed up to `size`; a longer one is cut by sentences; a short rest joins the chunk before or is dropped."""
    chunks: list[str] = []
    run: list[str] = []

    def flush(last: bool) -> None:
        full, rest = _greedy(run, "\n\n", size, overlap)
        chunks.extend("\n\n".join(g) for g in full)
        if rest:
            tail = "\n\n".join(rest)
            if not last or len(tail) >= least:
                chunks.append(tail)
            elif chunks:
                chunks[-1] += "\n\n" + tail
        run.clear()

    for paragraph in (p.strip() for p in _PARAGRAPH.split(text)):
        if len(paragraph) > size:
            flush(False)
            chunks.extend(by_sentences(paragraph, size, overlap))
        elif paragraph:
            run.append(paragraph)
    flush(True)
    return chunks


def by_headers(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[dict]:
    """Paragraph chunks of the sections under lines of # signs."""
    sections: list[tuple[str | None, int, list[str]]] = [(None, 0, [])]
    for line in text.split("\n"):
        if m := _HEADER.match(line):
            sections.append((m[2], len(m[1]), []))
        else:
            sections[-1][2].append(line)
    out = []
    for header, level, lines in sections:
        made = by_paragraphs("\n".join(lines).strip(), size, overlap, least)
        out += [{"text": c, "header": header, "header_level": level, "chunk_index": i, "total": len(made)} for i, c in enumerate(made)]
    return out


def document_chunks(preserve_headers: bool = True, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST):
    """An Arrow-batched function from text to an array of chunks."""

    @F.pandas_udf(f"array<{CHUNK}>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            if preserve_headers:
                return by_headers(text or "", size, overlap, least)
            made = by_paragraphs(text or "", size, overlap, least)
            return [{"text": c, "header": None, "header_level": 0, "chunk_index": i, "total": len(made)} for i, c in enumerate(made)]

        return texts.map(one)

    return run


def exploded(docs: DataFrame, text: str, preserve_headers: bool = True, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """A row per chunk: the columns of `docs` but the text, and text, header, header_level, chunk_index, total."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.explode(document_chunks(preserve_headers, size, overlap, least)(text)).alias("_c")).select(*rest, "_c.*")


def chunk_documents(chunks: DataFrame) -> DataFrame:
    """Chunk rows of pages (url, title, text, header, chunk_index, total) as pages of their own; a page's category goes along."""
    return chunks.select(
        *[c for c in ("category",) if c in chunks.columns],
        F.concat("url", F.lit("#chunk_"), F.col("chunk_index").cast("string")).alias("url"),
        F.concat("title", F.lit(" (Teil "), (F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")")).alias("title"),
        F.col("text").alias("content"), "chunk_index", F.col("total").alias("total_chunks"), F.col("url").alias("original_url"), "header",
    )


def stored_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Store rows (id, text, source_url, chunk_index, total_chunks) of documents (url, content, success)."""
    from lodeweave.functions.text import strip

    good = docs.where(F.col("success") & (F.length(strip(F.col("content"))) > 0)).withColumn("_chunks", packed(F.col("content"), size, overlap))
    rows = good.withColumn("_n", F.size("_chunks")).select("*", F.posexplode("_chunks").alias("chunk_index", "text"))
    return rows.withColumns({"id": document_id(F.col("url"), F.col("chunk_index")), "source_url": F.col("url"), "total_chunks": F.col("_n")}).drop("_chunks", "_n", "content")
