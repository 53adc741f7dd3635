"""PDF, DOCX and text files as texts.

Spark reads the bytes; a map over Arrow batches unpacks the containers with
the standard library. A file that can't be read gives an error, not a failed
job, unless ``strict``.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text from which a PDF library's result counts.
ENOUGH = 20
SCHEMA = "path string, format string, text string, links array<string>, error struct<code:string,message:string>"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnsupportedFormat(ValueError):
    """Neither a PDF nor a DOCX file."""


def format_of(name: str, content: bytes) -> str:
    """pdf or docx, by the extension, else by the first bytes."""
    suffix = re.search(r"\.([^./\\]+)$", name or "")
    if suffix:
        kind = suffix[1].lower()
        if kind in ("pdf", "docx"):
            return kind
        raise UnsupportedFormat(f"unsupported file format: .{kind}")
    if content.startswith(b"%PDF"):
        return "pdf"
    if content.startswith(b"PK\x03\x04"):
        return "docx"
    raise UnsupportedFormat("unknown file format")


def annotation_links(content: bytes) -> list[str]:
    """Addresses of a PDF's link annotations, each once, in order."""
    found = re.findall(rb"/URI\s*\((https?://[^)]+)\)", content, re.I)
    return list(dict.fromkeys(x.decode("utf-8", "ignore") for x in found))


def _inflate(data: bytes) -> bytes:
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        try:
            return zlib.decompress(data, bits)
        except zlib.error:
            continue
    return data


_STRING = rb"\(((?:\\.|[^\\()])*)\)"


def _plain(raw: bytes) -> str:
    return re.sub(rb"\\([()\\])", rb"\1", raw).decode("latin-1")


def pdf_streams(content: bytes) -> str:
    """The strings shown by a PDF's content streams: single ones of a stream first, then arrays, pieces joined."""
    shown = []
    for stream in re.findall(rb"stream\r?\n?(.*?)\r?\n?endstream", content, re.S):
        data = _inflate(stream)
        shown += [_plain(s) for s in re.findall(_STRING + rb"\s*(?:Tj|'|\")", data)]
        arrays = re.findall(rb"\[((?:\((?:\\.|[^\\()])*\)|[^\]()])*)\]\s*TJ", data)
        shown += ["".join(map(_plain, re.findall(_STRING, array))) for array in arrays]
    return "\n".join(shown)


def raw_lines(content: bytes) -> str:
    """The lines of a file that is no more than text."""
    return "\n".join(x.strip() for x in content.decode("latin-1").split("\n") if len(x.strip()) > 3)


def _with_pypdf(content: bytes) -> tuple[str, list[str]]:
    """Text of the pages that have any, and the addresses of their annotations."""
    import pypdf

    texts, links = [], []
    for page in pypdf.PdfReader(io.BytesIO(content)).pages:
        if text := page.extract_text():
            texts.append(text)
        try:
            for annotation in page.get("/Annots") or ():
                action = (annotation.get_object() or {}).get("/A") or {}
                if str(action.get("/URI", "")).startswith("http"):
                    links.append(str(action["/URI"]))
        except Exception:
            continue  # a page with broken annotations still has its text
    return "\n".join(texts), list(dict.fromkeys(links))


def _with_pdfminer(content: bytes) -> str:
    from pdfminer.high_level import extract_text
    from pdfminer.layout import LAParams

    return extract_text(io.BytesIO(content), laparams=LAParams(line_margin=0.5, word_margin=0.1, char_margin=2.0, boxes_flow=0.5, detect_vertical=False, all_texts=True)) or ""


def pdf_text(content: bytes) -> tuple[str, list[str]]:
    """Text and links of a PDF: by a PDF library where one is installed and finds enough, else from the raw streams.

    Links that the text doesn't show are added to it. A file without shown
    strings and links is read as plain lines.
    """
    text, links = "", []
    try:
        text, links = _with_pypdf(content)
    except Exception:  # not installed, or a file it can't read
        pass
    if len(text.strip()) <= ENOUGH:
        text, links = "", []
        try:
            text = _with_pdfminer(content)
        except Exception:
            pass
    if len(text.strip()) <= ENOUGH:
        text = pdf_streams(content)
    links = list(dict.fromkeys([*links, *annotation_links(content)]))
    if not text.strip() and not links:
        text = raw_lines(content)
    more = [x for x in links if x not in text]
    return "\n".join([*([text] if text else []), *more]), links


_MARKS = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n", f"{_WORD}noBreakHyphen": "-"}


def _paragraph(node) -> str:
    """A paragraph's text with its tabs and breaks."""
    return "".join(_MARKS.get(x.tag, (x.text or "") if x.tag == f"{_WORD}t" else "") for run in node.iter(f"{_WORD}r") for x in run)


def docx_text(content: bytes, mode: str = "tables") -> str:
    """``tables``: paragraphs first, then the rows of the body's tables, cells joined by bars. ``xml``: all paragraphs in order, blank ones as blank lines."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    if mode == "xml":
        return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")).strip() for p in root.iter(f"{_WORD}p"))
    body = root.find(f"{_WORD}body")
    out = [_paragraph(p).strip() for p in body.findall(f"{_WORD}p")]
    for row in (row for table in body.findall(f"{_WORD}tbl") for row in table.findall(f"{_WORD}tr")):
        cells = ["\n".join(_paragraph(p) for p in cell.findall(f"{_WORD}p")).strip() for cell in row.findall(f"{_WORD}tc")]
        if any(cells):
            out.append(" | ".join(c for c in cells if c))
    return "\n".join(out)


def decode(name: str, content: bytes) -> tuple[str | None, str | None, list[str], tuple[str, str] | None]:
    """(format, text, links, error) of a file."""
    kind = None
    try:
        kind = format_of(name, content)
        if kind == "pdf":
            text, links = pdf_text(content)
        else:
            links = []
            try:
                text = docx_text(content)
            except AttributeError:  # no body
                text = docx_text(content, "xml")
        if not text.strip():
            return kind, None, links, ("empty", "no text found")
        return kind, text, links, None
    except UnsupportedFormat as e:
        return kind, None, [], ("unsupported", str(e))
    except Exception as e:
        return kind, None, [], ("unreadable", f"{type(e).__name__}: {e}")


def decoded(files: DataFrame) -> DataFrame:
    """(path, format, text, links, error) of rows with path and content."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [decode(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "format": [f[0] for f in found], "text": [f[1] for f in found], "links": [f[2] for f in found], "error": [f[3] and {"code": f[3][0], "message": f[3][1]} for f in found]})

    return files.select("path", "content").mapInPandas(unpack, SCHEMA)


def read_files(spark: SparkSession, path: str, strict: bool = False, glob: str | None = None) -> DataFrame:
    """(path, format, text, links, error) of the files of a folder or pattern; ``strict`` fails on the first error."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    out = decoded(files)
    if strict:
        failed = F.raise_error(F.concat_ws(": ", "path", "error.code", "error.message")).cast("string")
        out = out.withColumn("text", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("text")))
    return out


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, in order of their names; only PDF and DOCX."""
    return read_files(spark, path, glob="*.{pdf,docx}").orderBy("path")
