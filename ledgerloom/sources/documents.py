"""Invoice documents: stored PDFs, their text by several engines, and records."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CLEAN_SCORE, let, quality_score
from .master import RECORD_LIMIT


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """invoice_id (hash of the path), original_filename and content of the PDF files of a folder, suffix in any case."""
    files = spark.read.format("binaryFile").load(path).filter(F.lower("path").endswith(".pdf"))
    return files.select(F.sha2("path", 256).alias("invoice_id"), F.element_at(F.split("path", "/"), -1).alias("original_filename"), "path", "length", "content")


def _plumber(data: bytes) -> str:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return "\n".join(page.extract_text() or "" for page in pdf.pages).strip()


def _mupdf(data: bytes) -> str:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        return "\n".join(page.get_text() for page in pdf).strip()


def _ocr(data: bytes) -> str:
    import fitz
    import pytesseract
    from PIL import Image

    with fitz.open(stream=data, filetype="pdf") as pdf:
        pages = [Image.open(io.BytesIO(page.get_pixmap(dpi=300).tobytes("png"))) for page in pdf]
    return "\n".join(pytesseract.image_to_string(p, lang="deu+eng") for p in pages).strip()


#: Engines by name in order of preference. Their libraries are optional: one that can't be used gives no text.
DIGITAL: dict[str, Callable[[bytes], str]] = {"pdfplumber": _plumber, "pymupdf": _mupdf}
OCR: dict[str, Callable[[bytes], str]] = {"ocr": _ocr}


def run_engines(pdfs: DataFrame, engines: dict[str, Callable[[bytes], str]], first_rank: int = 0) -> DataFrame:
    """invoice_id, rank, engine, text, error: one row per document and engine; where the engine failed, text is null and error says why."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, content in zip(pdf["invoice_id"], pdf["content"], strict=True):
                for rank, (name, engine) in enumerate(engines.items()):
                    text = error = None
                    try:
                        text = engine(bytes(content))
                    except Exception as e:
                        error = f"{name}: {type(e).__name__}: {e}"
                    rows.append((key, first_rank + rank, name, text, error))
            yield pd.DataFrame(rows, columns=["invoice_id", "rank", "engine", "text", "error"])

    return pdfs.select("invoice_id", "content").mapInPandas(run, "invoice_id string, rank int, engine string, text string, error string")


def best_candidate(candidates: DataFrame, key: str = "invoice_id") -> DataFrame:
    """key, engine, text, score of the candidate of best quality; ties go to the smaller rank. With a column error also errors: all of them."""
    scored = candidates.withColumn("score", quality_score(F.col("text")))
    best = F.max_by(F.struct("engine", "text", "score"), F.struct("score", -F.col("rank")))
    errors = [F.sort_array(F.collect_list("error")).alias("errors")] if "error" in candidates.columns else []
    return scored.groupBy(key).agg(best.alias("best"), *errors).select(key, "best.*", *["errors"] * len(errors))


def best_of(candidates: Column) -> Column:
    """The same for candidates that are an array of structs (rank, engine, text) in one row: struct(engine, text, score), without a shuffle."""
    ranked = F.transform(candidates, lambda c: F.struct(quality_score(c["text"]).alias("score"), (-c["rank"]).alias("rank"), c["engine"].alias("engine"), c["text"].alias("text")))
    return let(F.array_max(ranked), lambda best: F.struct(best["engine"].alias("engine"), best["text"].alias("text"), best["score"].alias("score")))


def needs_ocr(candidates: DataFrame, key: str = "invoice_id", engines: int = len(DIGITAL)) -> DataFrame:
    """Keys for which not all digital engines reached a clean text."""
    clean = F.count_if(quality_score(F.col("text")) >= CLEAN_SCORE)
    return candidates.groupBy(key).agg(clean.alias("clean")).filter(F.col("clean") < engines).select(key)


def extract_texts(pdfs: DataFrame, digital: dict | None = None, ocr: dict | None = None) -> DataFrame:
    """invoice_id, engine, text, score, errors of each PDF: digital engines on all, OCR only on what they left unclear."""
    digital, ocr = DIGITAL if digital is None else digital, OCR if ocr is None else ocr
    found = run_engines(pdfs, digital)
    unclear = pdfs.join(needs_ocr(found, engines=len(digital)), "invoice_id", "left_semi")
    return best_candidate(found.unionByName(run_engines(unclear, ocr, len(digital))))


def find(records: DataFrame, invoice_id: str) -> DataFrame:
    """One record by id; the filter reaches the scan."""
    return records.filter(F.col("invoice_id") == invoice_id)


def stored_pdf(pdfs: DataFrame, records: DataFrame, invoice_id: str) -> DataFrame:
    """content and original_filename of a record's PDF."""
    own = find(records, invoice_id).select("invoice_id", "original_filename")
    return pdfs.drop("original_filename").join(own, "invoice_id").select("invoice_id", "original_filename", "content")


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def listed(records: DataFrame, limit: int = RECORD_LIMIT) -> DataFrame:
    return records.limit(limit)


def as_json(record: Column | None = None) -> Column:
    """A record as indented JSON; null fields stay."""
    return F.to_json(record if record is not None else F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})


def export_name(record: str = "extracted.invoice_number", key: str = "invoice_id") -> Column:
    """The export's file name: by invoice number, else by id."""
    return F.concat(F.coalesce(F.nullif(F.col(record), F.lit("")), F.col(key)), F.lit(".json"))
