"""Documents of other kinds to Markdown and page images, by converters that can be plugged in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_suffix


class Converter(Protocol):
    """Turns the bytes of a document into Markdown, or into images of its pages. Sent to the workers."""

    def markdown(self, content: bytes) -> str: ...

    def pages(self, content: bytes) -> list[bytes]: ...


class MissingBackend(RuntimeError):
    """A converter's library is not installed."""


def _library(name: str):
    import importlib

    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise MissingBackend(f"{name} is not installed") from e


def open_pdf(library, content: bytes):
    return library.open(stream=content, filetype="pdf")


def table_markdown(rows: list[list[str | None]]) -> str:
    """Rows of cells as a Markdown table, the first one its head. Bars and line ends within cells are made harmless."""
    if not rows:
        return ""
    width = max(map(len, rows))
    cell = lambda c: " ".join((c or "").split()).replace("|", "\\|")
    lines = ["| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def heading_levels(sizes: dict[float, int]) -> dict[float, int]:
    """Font sizes that are headings, with their level: those above the size that most characters have, six at most."""
    if not sizes:
        return {}
    body = max(sizes, key=lambda s: (sizes[s], -s))
    return {s: min(i, 6) for i, s in enumerate(sorted((s for s in sizes if s > body), reverse=True), 1)}


@dataclass(frozen=True)
class PageConverter:
    """A converter on a library of the ``fitz`` interface: headings by font size, text and tables in reading order."""

    library: str = "fitz"

    def markdown(self, content: bytes) -> str:
        pdf = open_pdf(_library(self.library), content)
        pages = [page.get_text("dict")["blocks"] for page in pdf]
        sizes: dict[float, int] = {}
        for span in (s for blocks in pages for b in blocks for line in b.get("lines", ()) for s in line["spans"]):
            sizes[round(span["size"], 1)] = sizes.get(round(span["size"], 1), 0) + len(span["text"])
        levels = heading_levels(sizes)
        return "\n\n".join(x for page, blocks in zip(pdf, pages) for x in self._page(page, blocks, levels))

    def _page(self, page, blocks: list[dict], levels: dict[float, int]) -> list[str]:
        tables = [(tuple(t.bbox), t.extract()) for t in page.find_tables().tables] if hasattr(page, "find_tables") else []
        inside = lambda b: any(t[0] <= b[0] and t[1] <= b[1] and b[2] <= t[2] and b[3] <= t[3] for t, _ in tables)
        parts = [(box[1], box[0], table_markdown(rows)) for box, rows in tables]
        for block in blocks:
            if inside(block["bbox"]):
                continue
            for line in block.get("lines", ()):
                text = "".join(s["text"] for s in line["spans"]).strip()
                level = max((levels.get(round(s["size"], 1), 0) for s in line["spans"]), default=0)
                if text:
                    parts.append((line["bbox"][1], line["bbox"][0], f"{'#' * level} {text}" if level else text))
        return [p for _, _, p in sorted(parts)]

    def pages(self, content: bytes) -> list[bytes]:
        return [page.get_pixmap().tobytes("png") for page in open_pdf(_library(self.library), content)]


@dataclass(frozen=True)
class LayoutConverter:
    """A converter on the ``docling`` library, which models layout and tables. Its pages are drawn by the other converter."""

    tables: bool = True

    def markdown(self, content: bytes) -> str:
        import io

        base = _library("docling.datamodel.base_models")
        options = _library("docling.datamodel.pipeline_options").PdfPipelineOptions()
        options.do_table_structure = self.tables
        converters = _library("docling.document_converter")
        made = converters.DocumentConverter(format_options={base.InputFormat.PDF: converters.PdfFormatOption(pipeline_options=options)})
        return made.convert(base.DocumentStream(name="document.pdf", stream=io.BytesIO(content))).document.export_to_markdown()

    def pages(self, content: bytes) -> list[bytes]:
        return PageConverter().pages(content)


CONVERTERS: dict[str, Converter] = {"fitz": PageConverter("fitz"), "pymupdf": PageConverter("pymupdf"), "docling": LayoutConverter()}


def converter(name: str) -> Converter:
    if name not in CONVERTERS:
        raise ValueError(f"unknown converter {name!r}; known: {', '.join(CONVERTERS)}")
    return CONVERTERS[name]


def to_markdown(files: DataFrame, using: Converter, suffix: str = ".pdf") -> DataFrame:
    """(doc_id, stem, text, error) of files (doc_id: path, stem, content). A file that fails, or has another suffix, gives an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for ok, content in zip(batch["ok"], batch["content"]):
                try:
                    done.append((using.markdown(content), None) if ok else (None, f"not a {suffix} file"))
                except MissingBackend:
                    raise
                except Exception as e:  # one file's fault
                    done.append((None, f"{type(e).__name__}: {e}"))
            yield batch[["doc_id", "stem"]].assign(text=[d[0] for d in done], error=[d[1] for d in done])

    rows = files.withColumn("ok", path_suffix(F.col("doc_id")) == suffix)
    return rows.mapInPandas(run, "doc_id string, stem string, text string, error string")


def to_pages(files: DataFrame, using: Converter) -> DataFrame:
    """(pdf, page_no from 1, png) of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf, content in zip(batch["doc_id"], batch["content"]):
                pages = using.pages(content)
                yield pd.DataFrame({"pdf": pdf, "page_no": range(1, len(pages) + 1), "png": pages})

    return files.mapInPandas(run, "pdf string, page_no long, png binary")
