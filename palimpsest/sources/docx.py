"""Word files: their paragraphs as text units, their images counted and blanked, rewritten files. Standard library only."""

from __future__ import annotations

import base64
import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .units import MAX_BYTES, listing

# ---- fixed values: names of the file format, and a transparent picture of one pixel ----
MAIN = "word/document.xml"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATIONSHIPS = "word/_rels/document.xml.rels"
REFERENCE_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
KINDS = (("header", "headerReference", "default"), ("first_page_header", "headerReference", "first"), ("even_page_header", "headerReference", "even"), ("footer", "footerReference", "default"), ("first_page_footer", "footerReference", "first"), ("even_page_footer", "footerReference", "even"))
PIXEL = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNkYPhfDwAChwGA60e6kgAAAABJRU5ErkJggg==")
# ---- end of fixed values ----

UNITS = "doc_id long, unit int, location string, text string"


def read_docx_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``doc_id, path, content`` of Word files within the size cap; larger ones are not read, ``units.too_large`` lists them."""
    files = listing(spark, path, ("docx",)).where(F.col("length") <= max_bytes)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def paragraph_text(paragraph: ElementTree.Element) -> str:
    """Runs (also those of links) in order; tabs and breaks as characters."""
    out = []
    for node in paragraph.iter():
        if node.tag == f"{WORD}t":
            out.append(node.text or "")
        elif node.tag == f"{WORD}tab" and node.attrib == {}:
            out.append("\t")
        elif node.tag in (f"{WORD}br", f"{WORD}cr"):
            out.append("\n")
    return "".join(out)


def paragraphs(container: ElementTree.Element, location: str) -> Iterator[tuple[str, ElementTree.Element]]:
    """Paragraphs of a body, header, footer or cell, then its tables' cells, nested ones too, as (location, paragraph)."""
    for p in container.findall(f"{WORD}p"):
        yield location, p
    for t, table in enumerate(container.findall(f"{WORD}tbl")):
        for r, row in enumerate(table.findall(f"{WORD}tr")):
            for c, cell in enumerate(row.findall(f"{WORD}tc")):
                yield from paragraphs(cell, f"{location}/table{t}[r{r},c{c}]")


def relationships(archive: zipfile.ZipFile) -> dict[str, tuple[str, str]]:
    """Id -> (type, part) of the main part's relationships to parts of the file."""
    if RELATIONSHIPS not in archive.namelist():
        return {}
    out = {}
    for r in ElementTree.fromstring(archive.read(RELATIONSHIPS)):
        if r.get("TargetMode") != "External":
            target = r.get("Target", "")
            out[r.get("Id", "")] = (r.get("Type", ""), target[1:] if target.startswith("/") else posixpath.normpath(f"word/{target}"))
    return out


def parts(archive: zipfile.ZipFile, main: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """(location, part): the body, then for each section its headers and footers by kind.

    A section that states no part of a kind goes on with that of the section before it, so such a part comes again.
    """
    yield "body", MAIN
    known, held = relationships(archive), {}
    for i, section in enumerate(main.iter(f"{WORD}sectPr")):
        for name, tag, kind in KINDS:
            for ref in section.findall(f"{WORD}{tag}"):
                if ref.get(f"{WORD}type", "default") == kind and ref.get(REFERENCE_ID) in known:
                    held[name] = known[ref.get(REFERENCE_ID)][1]
            if held.get(name) in archive.namelist():
                yield f"section{i}/{name}", held[name]


def numbered_paragraphs(archive: zipfile.ZipFile) -> Iterator[tuple[str, ElementTree.Element, list[tuple[str, ElementTree.Element]]]]:
    """(part, its tree, its non-blank paragraphs with locations); units are numbered over all parts in this order."""
    trees = {MAIN: ElementTree.fromstring(archive.read(MAIN))}
    for location, part in parts(archive, trees[MAIN]):
        if part not in trees:
            trees[part] = ElementTree.fromstring(archive.read(part))
        root = trees[part]
        container = root.find(f"{WORD}body") if part == MAIN else root
        found = paragraphs(container, location) if container is not None else ()
        yield part, root, [(at, p) for at, p in found if paragraph_text(p).strip()]


#: What an unreadable file raises.
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, TypeError, EOFError, zlib.error)


def docx_units(files: DataFrame) -> DataFrame:
    """``doc_id, unit, location, text`` of ``files`` (doc_id, content): one row a non-blank paragraph. Unreadable files give no rows."""
    ship(files.sparkSession)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        found = [x for _, _, some in numbered_paragraphs(archive) for x in some]
                except BROKEN:
                    continue
                rows += [(doc_id, i, at, paragraph_text(p)) for i, (at, p) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "unit", "location", "text"])

    return files.select("doc_id", "content").mapInPandas(parse, UNITS)


def images(archive: zipfile.ZipFile) -> list[str]:
    """Parts of the main part's picture relationships, one a relationship."""
    return [part for kind, part in relationships(archive).values() if "image" in kind]


def set_paragraph_text(paragraph: ElementTree.Element, text: str) -> None:
    """The whole text into the first run, whose look it takes; the other runs become empty."""
    runs = list(paragraph.iter(f"{WORD}r"))
    for run in runs:
        for child in [c for c in run if c.tag != f"{WORD}rPr"]:
            run.remove(child)
    first = runs[0] if runs else ElementTree.SubElement(paragraph, f"{WORD}r")
    put = ElementTree.SubElement(first, f"{WORD}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
    put.text = text


def rewritten(content: bytes, texts: dict[int, str], blank: bool = True) -> tuple[bytes, int, int]:
    """The file with the units of ``texts`` replaced and its images blanked; images found, images blanked."""
    out, unit, blanked = io.BytesIO(), 0, 0
    with zipfile.ZipFile(io.BytesIO(content)) as archive, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        changed = {}
        for part, root, found in numbered_paragraphs(archive):
            for _, p in found:
                if unit in texts and texts[unit] != paragraph_text(p):
                    set_paragraph_text(p, texts[unit])
                    changed[part] = root
                unit += 1
        found_images = images(archive)
        for name in archive.namelist():
            data = archive.read(name)
            if name in changed:
                data = ElementTree.tostring(changed[name], encoding="UTF-8", xml_declaration=True)
            elif blank and name in found_images:
                data, blanked = PIXEL, blanked + found_images.count(name)
            target.writestr(name, data)
    return out.getvalue(), len(found_images), blanked


def rewrite_docx(files: DataFrame, redacted: DataFrame, blank: bool = True) -> DataFrame:
    """``doc_id, content, images_found, images_blanked, error``: ``files`` with the texts of ``redacted`` (doc_id, unit, redacted).

    A file's units meet its row. An unreadable file has no content and says why in ``error``.
    """
    ship(files.sparkSession)
    texts = redacted.groupBy("doc_id").agg(F.collect_list(F.struct("unit", "redacted")).alias("texts"))
    joined = files.select("doc_id", "content").join(texts, "doc_id", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, content, units in zip(batch["doc_id"], batch["content"], batch["texts"], strict=True):
                known = {u["unit"]: u["redacted"] for u in units} if units is not None else {}
                try:
                    rows.append((doc_id, *rewritten(content, known, blank), None))
                except BROKEN as e:
                    rows.append((doc_id, None, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "images_found", "images_blanked", "error"])

    return joined.mapInPandas(write, "doc_id long, content binary, images_found int, images_blanked int, error string")
