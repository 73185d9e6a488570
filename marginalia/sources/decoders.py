"""Files to sections: decoders for the binaryFile source, behind one interface.

A decoder takes (path, content) and yields sections as dicts of title, level, element_type, text and
attrs; anything with that shape can be passed in for other formats. Decoding is the only part that
runs as Python; all that follows is DataFrame work.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.functions import labels, signals

Decoder = Callable[[str, bytes], Iterator[dict]]
SECTION = "path string, ord int, title string, level int, element_type string, text string, error string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(path: str, content: bytes) -> Iterator[dict]:
    """Headings, paragraphs, captions, table rows and figures of a .docx in order. Rows join their cells by ' | ' without trailing empty ones; empty rows go. A figure's text is its description, else its name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t")).strip()
    for block in body:
        if block.tag == f"{W}p":
            for drawing in block.iter(f"{W}drawing"):
                told = next((e for e in drawing.iter() if e.tag.endswith("}docPr")), None)
                yield {"title": None, "level": None, "element_type": "figure", "text": "" if told is None else told.get("descr") or told.get("name") or ""}
        if block.tag == f"{W}p" and (text := said(block)):
            style = block.find(f"{W}pPr/{W}pStyle")
            match = re.search(r"(?:heading|заголовок)\s*(\d)", style.get(f"{W}val", ""), re.I) if style is not None else None
            yield {"title": text if match else None, "level": int(match[1]) if match else None, "element_type": "heading" if match else "text", "text": text}
        elif block.tag == f"{W}tbl":
            for row in block.iter(f"{W}tr"):
                cells = [said(c) for c in row.findall(f"{W}tc")]
                while cells and not cells[-1]:
                    cells.pop()
                if cells:
                    yield {"title": None, "level": None, "element_type": "table_row", "text": " | ".join(cells)}


def plain(path: str, content: bytes) -> Iterator[dict]:
    """Any other file as one paragraph of its text; binary content is an error."""
    if b"\0" in content or content[:5] == b"%PDF-":
        raise ValueError("binary content needs a decoder of its own")
    yield {"title": "Document", "level": 1, "element_type": "paragraph", "text": content.decode("utf-8", "replace")}


DECODERS: dict[str, Decoder] = {"docx": docx, "txt": plain, "md": plain}


def read_sections(spark: SparkSession, where: str, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Sections of all files below a folder, by their extension. A file that can't be read gives one row with its error."""
    known = DECODERS | (decoders or {})
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SECTION.split(", ")]
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    decode = known.get(path.rpartition(".")[2].lower(), plain)
                    for k, s in enumerate(decode(path, content), 1):
                        rows.append((path, k, s.get("title"), s.get("level"), s["element_type"], s["text"], None))
                except Exception as e:  # one bad file must not end the job; its row says why
                    rows = [(path, 0, None, None, "error", None, f"{type(e).__name__}: {e}"[:2000])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return found.mapInArrow(run, SECTION)


def outlined(sections: DataFrame) -> DataFrame:
    """Adds section_path ('1 Title / 1.1 Title') from headings and levels, by counters over the order of the file."""
    w = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows, parts = sections, []
    for level in (1, 2, 3):
        above = F.coalesce(F.max(F.when(F.col("level") < level, F.col("ord"))).over(w), F.lit(0))
        rows = rows.withColumn(f"_above{level}", above)
    for level in (1, 2, 3):
        inside = Window.partitionBy("path", f"_above{level}").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(f"_n{level}", F.count_if(F.col("level") == level).over(inside)).withColumn(f"_t{level}", F.last(F.when(F.col("level") == level, F.col("title")), ignorenulls=True).over(inside))
    for level in (1, 2, 3):
        number = F.concat_ws(".", *[F.col(f"_n{k}").cast("string") for k in range(1, level + 1)])
        parts.append(F.when(F.col(f"_n{level}") > 0, F.concat_ws(" ", number, F.col(f"_t{level}"))))
    drop = [f"_{k}{level}" for k in ("above", "n", "t") for level in (1, 2, 3)]
    return rows.withColumn("section_path", F.concat_ws(" / ", *parts)).drop(*drop)


def with_references(sections: DataFrame) -> DataFrame:
    """sections with text below a heading that names a list of sources as references, and ref_no, their number within the file; lines that are continued count as their own."""
    w = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    under = signals.is_reference_section(F.last(F.when(F.col("element_type") == "heading", F.coalesce("title", "text")), ignorenulls=True).over(w))
    rows = sections.withColumn("_ref", under & F.col("element_type").isin("text", "paragraph"))
    rows = rows.withColumn("ref_no", F.when(F.col("_ref"), F.count_if("_ref").over(w)))
    return rows.withColumn("element_type", F.when(F.col("_ref"), "reference").otherwise(F.col("element_type"))).drop("_ref")


def with_figure_captions(sections: DataFrame, within: int = 2) -> DataFrame:
    """captioned sections with figure_caption, on each figure: the first caption of a figure among the `within` rows behind it, else the one just before it."""
    w = Window.partitionBy("path").orderBy("ord")
    own = F.when(F.col("caption.kind") == "figure", F.col("caption"))
    rows = sections.withColumn("_own", own)
    near = F.coalesce(*[F.lead("_own", k).over(w) for k in range(1, within + 1)], F.lag("_own", 1).over(w))
    return rows.withColumn("figure_caption", F.when(F.col("element_type") == "figure", near)).drop("_own")


def captioned(sections: DataFrame) -> DataFrame:
    """Adds the caption's kind, number and tail to sections that are captions."""
    return sections.withColumn("caption", labels.caption(F.col("text")))
