"""Pages, links, chunks and duplicates of documents."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..functions.urls import host, link_priority


def page_links(pages: DataFrame) -> DataFrame:
    """Links of each page without repeats: (page_id, link, kind pdf / internal / external).

    ``pages`` has page_id, url, html.  Anchors and javascript, mailto and tel
    links are skipped; absolute, ``//host``, ``/path`` and relative forms are
    resolved against the page's URL.
    """
    href = F.explode(F.expr(r"""regexp_extract_all(html, '(?i)href\\s*=\\s*["\']([^"\']*)["\']', 1)"""))
    raw = pages.select("page_id", "url", href.alias("raw")).where(~F.col("raw").rlike(r"(?i)^\s*(#|javascript:|mailto:|tel:)|^\s*$"))
    raw = raw.withColumn("raw", F.trim("raw"))
    root = F.regexp_extract("url", r"^(?i)(https?://[^/?#]+)", 1)
    folder = F.regexp_extract("url", r"^(?i)(https?://[^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/")))
    link = (
        F.when(F.col("raw").rlike("(?i)^https?://"), F.col("raw"))
        .when(F.col("raw").startswith("//"), F.concat(F.regexp_extract("url", "^(?i)(https?:)", 1), F.col("raw")))
        .when(F.col("raw").startswith("/"), F.concat(root, F.col("raw")))
        .otherwise(F.concat(folder, F.col("raw")))
    )
    out = raw.withColumn("link", link)
    own, base = host(F.col("link")), host(F.col("url"))
    kind = F.when(F.lower("link").rlike(r"\.pdf($|[?#])"), "pdf").when((own == base) | own.endswith(F.concat(F.lit("."), base)), "internal").otherwise("external")
    return out.select("page_id", "link", kind.alias("kind")).distinct()


def frontier(links: DataFrame, k: int = 10) -> DataFrame:
    """The k links of each page and kind (external ones aside) of highest priority; ties by link."""
    scored = links.where("kind <> 'external'").withColumn("priority", link_priority(F.col("link")))
    w = Window.partitionBy("page_id", "kind").orderBy(F.desc("priority"), "link")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def table_rows(pages: DataFrame, row: str = "li", cell: str = "a") -> DataFrame:
    """Cells of a page's rows as (page_id, row_no, cells array<string>), tags stripped; rows without a cell are left out."""
    rows = F.expr(rf"regexp_extract_all(html, '(?is)<{row}[^>]*>(.*?)</{row}>', 1)")
    out = pages.select("page_id", F.posexplode(rows).alias("row_no", "inner"))
    cells = F.expr(rf"regexp_extract_all(inner, '(?is)<{cell}[^>]*>(.*?)</{cell}>', 1)")
    strip = lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))
    return out.select("page_id", "row_no", F.transform(cells, strip).alias("cells")).where(F.size("cells") > 0)


def dedupe_exact(docs: DataFrame, order: list[Column]) -> DataFrame:
    """The first document of each content hash in a total order; a null hash is never a duplicate."""
    w = Window.partitionBy("content_hash").orderBy(*order)
    first = docs.where("content_hash is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.unionByName(docs.where("content_hash is null"))


def priority_order() -> list[Column]:
    """Portraits before strategic plans before others, short texts first."""
    rank = F.when(F.col("document_category") == "portrait_of_graduate", 1).when(F.col("document_category") == "strategic_plan", 2).otherwise(3)
    return [rank, F.col("text_length"), F.col("doc_id")]


def with_hash(docs: DataFrame, cap: int = 100_000) -> DataFrame:
    """Length and SHA-256 of the whole text, then the text cut to ``cap`` characters; NULs are dropped first."""
    clean = docs.withColumn("text", F.regexp_replace("text", r"\x00", ""))
    return clean.withColumns({"full_length": F.length("text"), "content_hash": F.sha2("text", 256)}).withColumn("text", F.substring("text", 1, cap))


def _chunker(cut: Callable[[str], list[str]]):
    """(doc_id, text) -> a row for each chunk; few texts at a time, as a batch's chunks take several times its bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(d, i, c) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, c in enumerate(cut(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "chunk_index", "chunk"])

    return run


def pack_sentences(text: str, most: int = 1500, least: int = 50) -> list[str]:
    """Sentences of a text with single spaces, packed greedily into chunks; a longer sentence is packed by words, a longer word stands alone."""
    chunks, open_ = [], ""
    for sentence in re.split(r"(?<=[.!?]) ", text):
        for unit in [sentence] if len(sentence) <= most else sentence.split(" "):
            if not open_:
                open_ = unit
            elif len(open_) + 1 + len(unit) <= most:
                open_ = f"{open_} {unit}"
            else:
                chunks.append(open_)
                open_ = unit
    return [c for c in [*chunks, open_] if len(c) >= least]


def chunk_sentences(docs: DataFrame, most: int = 1500, least: int = 50) -> DataFrame:
    """Greedy packing of sentences into chunks of at most ``most`` characters: (doc_id, chunk_index, chunk).

    Spaces are collapsed; a longer sentence is packed by words, a longer word
    stands alone; chunks under ``least`` are dropped and the index counts what
    is kept.  Takes time in proportion to the text, of any length.
    """

    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), flat.alias("text")).mapInArrow(_chunker(lambda t: pack_sentences(t, most, least)), "doc_id long, chunk_index int, chunk string")


def split_recursive(text: str, most: int = 6000, overlap: int = 800, least: int = 100) -> list[str]:
    """Pieces of at most ``most`` characters by paragraph, line, sentence, word, or hard cut; each after the first opens with the end of the one before."""
    separators = ["\n\n", "\n", r"(?<=[.!?])\s+", " "]

    def cut(part: str, level: int) -> list[str]:
        if len(part) <= most:
            return [part]
        if level == len(separators):
            return [part[i : i + most] for i in range(0, len(part), most)]
        out, open_ = [], ""
        glue = separators[level] if level != 2 else " "
        for piece in re.split(separators[level], part):
            for p in cut(piece, level + 1):
                if open_ and len(open_) + len(glue) + len(p) > most:
                    out.append(open_)
                    open_ = p
                else:
                    open_ = f"{open_}{glue}{p}" if open_ else p
        return [*out, open_] if open_ else out

    pieces = [p.strip() for p in cut(text, 0)]
    pieces = [p for p in pieces if len(p) >= least]
    return [p if i == 0 or not overlap else f"{pieces[i - 1][-overlap:]} {p}" for i, p in enumerate(pieces)]


def chunk_recursive(docs: DataFrame, most: int = 6000, overlap: int = 800, least: int = 100, cap: int | None = None) -> DataFrame:
    """(doc_id, chunk_index, chunk) of whole texts, or of their first ``cap`` characters, in Arrow batches."""

    text = F.col("text") if cap is None else F.substring("text", 1, cap).alias("text")
    return docs.where("text is not null").select("doc_id", text).mapInArrow(_chunker(lambda t: split_recursive(t, most, overlap, least)), "doc_id long, chunk_index int, chunk string")


def pending(docs: DataFrame, vectors: DataFrame, kind: str | None = None, least: int = 100) -> DataFrame:
    """Documents long enough and without a vector, exact duplicates removed, with their place in priority order and batch of 150."""
    todo = docs.where(F.col("extracted_text").isNotNull() & (F.col("text_length") > least))
    todo = todo.where(F.col("document_category") == kind) if kind else todo
    todo = dedupe_exact(todo.join(vectors.select("doc_id"), "doc_id", "left_anti"), priority_order())
    return todo.select("doc_id", "document_category", "text_length", F.floor(F.col("doc_id") / 150).cast("long").alias("batch"))
