"""Extension points: what a chunker, decoder, graph, repository, job store and language model must offer, and where others register their own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators.geometry import span_text


class Chunker(Protocol):
    """Chunks of a text column as an array of (page, heading, text)."""

    def __call__(self, text: Column, size: int, overlap: int, least: int) -> Column: ...


class Decoder(Protocol):
    """What a format's library gives for one file's bytes; each method may yield nothing."""

    def spans(self, content: bytes) -> Iterable[tuple[int, int, int, int, int, float, int, str]]:
        """(page, block, block type, line, span, font size, flags, text); type 0 is text."""

    def tables(self, content: bytes) -> Iterable[tuple[int, list[list[str | None]]]]:
        """(page, rows of cells)."""

    def images(self, content: bytes) -> Iterable[tuple[int, str, str, bytes]]:
        """(page, strategy, ending, bytes)."""

    def metadata(self, content: bytes) -> dict[str, str]: ...


class Graph(Protocol):
    def is_available(self) -> bool: ...
    def insert(self, docs: DataFrame) -> None: ...
    def query(self, question: str, mode: str) -> DataFrame: ...
    def entities(self, docs: DataFrame) -> DataFrame: ...


class Repository(Protocol):
    def save_markdown(self, pages: DataFrame, path: str) -> None: ...
    def load_markdown(self, spark: SparkSession, path: str, doc_id: str) -> DataFrame: ...
    def save_manifests(self, manifests: DataFrame, path: str) -> None: ...
    def save_images(self, images: DataFrame, path: str) -> None: ...
    def load_image(self, spark: SparkSession, path: str, doc_id: str, image_id: str) -> DataFrame: ...


class JobStore(Protocol):
    def get(self, job_id: str): ...
    def create(self, job_id: str, files: list[str]): ...
    def update(self, job_id: str, **fields): ...
    def delete(self, job_id: str): ...
    def recent(self, limit: int) -> DataFrame: ...
    def active(self) -> DataFrame: ...
    def cleanup(self, hours: float): ...


CHUNKERS: dict[str, Chunker] = {"basic": chunking.basic_chunks, "semantic": chunking.semantic_chunks, "page_aware": chunking.page_aware}
DECODERS: dict[str, Decoder] = {}


def chunker(strategy: str) -> Chunker:
    """The registered chunker; an unknown name gives the semantic one."""
    return CHUNKERS.get(strategy, CHUNKERS["semantic"])


def register_chunker(spark: SparkSession, name: str, cut: Callable[[str], Iterable[str]]) -> None:
    """A chunker in Python, for SQL as a table function ``name(text)`` of (index, chunk)."""
    from pyspark.sql.functions import udtf

    class Cut:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            yield from enumerate(cut(text) if text is not None else ())

    spark.udtf.register(name, udtf(Cut, returnType="index int, chunk string"))


def _each(decoder: Decoder, method: str, names: list[str]):
    """Rows of one method over files; a file that cannot be decoded gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                try:
                    rows = [(path, k, *r) for k, r in enumerate(getattr(decoder, method)(content))]
                except Exception:
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "place", *names])

    return run


def extracted_pages(files: DataFrame, decoder: Decoder) -> DataFrame:
    """path, pg, t: the markdown of every page of ``files`` (path, content). Spans without text go; those of a line stand side by side, lines without text go; a marker opens each page."""
    names = ["pg", "block", "kind", "line", "span", "size", "flags", "text"]
    spans = files.select("path", "content").mapInPandas(_each(decoder, "spans", names), "path string, place int, pg int, block int, kind int, line int, span int, size double, flags int, text string")
    marked = spans.where("kind = 0").withColumn("md", span_text(F.col("size"), F.col("flags"), F.col("text"))).where("md is not null")
    line = marked.groupBy("path", "pg", "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "place", "md"))), lambda x: x.md), "").alias("md"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "md"))), lambda x: x.md), "\n")
    return line.groupBy("path", "pg").agg(F.concat(F.lit("\n<!-- Page "), F.col("pg").cast("string"), F.lit(" -->\n"), body).alias("t"))


def extracted_tables(files: DataFrame, decoder: Decoder) -> DataFrame:
    """path, pg, id, markdown, preview, has_header of every table that the decoder finds; ids count the tables of a file from 1."""
    from ..operators.scalars import pipe_rows

    cells = files.select("path", "content").mapInPandas(_each(decoder, "tables", ["pg", "cells"]), "path string, place int, pg int, cells array<array<string>>")
    md = pipe_rows(F.col("cells"))
    return cells.where(F.size("cells") > 0).select("path", "pg", F.concat(F.lit("tab_"), (F.col("place") + 1).cast("string")).alias("id"), md.alias("markdown"), F.substring(md, 1, 100).alias("preview"), F.lit(True).alias("has_header"))


#: Where the numbers of a page's images begin, by how they were found.
BEGIN = {"embedded": 1, "grid": 800, "vector": 900}


def extracted_images(files: DataFrame, decoder: Decoder, largest: float = 10.0) -> DataFrame:
    """path, pg, id, strategy, ext, content of all images, whichever way found, none matched with another; those over ``largest`` MB go."""
    found = files.select("path", "content").mapInPandas(_each(decoder, "images", ["pg", "strategy", "ext", "content"]), "path string, place int, pg int, strategy string, ext string, content binary")
    begin = F.element_at(F.create_map(*[F.lit(x) for pair in BEGIN.items() for x in pair]), F.col("strategy"))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("path", "pg", "strategy").orderBy("place")) - 1 + begin
    kept = found.withColumn("number", number).where(F.length("content") <= int(largest * (1 << 20)))
    return kept.select("path", "pg", F.concat_ws("_", F.lit("fig"), F.col("pg").cast("string"), F.col("number").cast("string")).alias("id"), "strategy", "ext", "content")


def extracted_metadata(files: DataFrame, decoder: Decoder) -> DataFrame:
    """path, metadata: a map for each file."""

    class Items:
        def pairs(self, content: bytes):
            return list(decoder.metadata(content).items())

    pairs = files.select("path", "content").mapInPandas(_each(Items(), "pairs", ["k", "v"]), "path string, place int, k string, v string")
    return files.select("path").join(pairs.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata")), "path", "left")


def answers(questions: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """``questions`` (question, ...) with an answer each, asked for batch by batch; what fails answers with its reason."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                got = [x or "No results found." for x in model(list(batch.question))]
            except Exception as e:
                got = [f"Query failed: {e}"] * len(batch)
            yield batch.assign(answer=got)

    return questions.mapInPandas(run, f"{fields}, answer string")


def embedded(texts: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``texts`` (text, ...) with an embedding each, computed batch by batch."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(embedding=model([t or "" for t in batch.text]))

    return texts.mapInPandas(run, f"{fields}, embedding array<double>")


def offline_embedding(texts: list[str], width: int = 768) -> list[list[float]]:
    """A stand-in without any model: words counted at hashed places, of length one."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * width
        for word in text.lower().split():
            v[zlib.crc32(word.encode()) % width] += 1.0
        size = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / size for x in v])
    return out
