"""Error rows: every operator reports bad documents beside its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category of each error code.
CATEGORY = {
    "FILE_TOO_LARGE": "FILE_ERROR",
    "FILE_TYPE_INVALID": "FILE_ERROR",
    "FILE_CORRUPTED": "FILE_ERROR",
    "FILE_EMPTY": "FILE_ERROR",
    "FILE_NOT_PDF": "FILE_ERROR",
    "PDF_ENCRYPTED": "PROCESSING_ERROR",
    "PDF_MALFORMED": "PROCESSING_ERROR",
    "PROCESSING_TIMEOUT": "PROCESSING_ERROR",
    "PROCESSING_CANCELLED": "PROCESSING_ERROR",
    "PROCESSING_FAILED": "PROCESSING_ERROR",
    "INVALID_PASSWORD": "VALIDATION_ERROR",
    "MEMORY_EXCEEDED": "BROWSER_ERROR",
    "WORKER_FAILED": "BROWSER_ERROR",
    "BROWSER_NOT_SUPPORTED": "BROWSER_ERROR",
    "INVALID_PAGE_RANGE": "VALIDATION_ERROR",
    "INVALID_OPTIONS": "VALIDATION_ERROR",
    "UNKNOWN": "PROCESSING_ERROR",
}

# Codes that cannot be recovered from.
FATAL = ("FILE_CORRUPTED", "PDF_MALFORMED", "BROWSER_NOT_SUPPORTED")

# Advice per code; any other code gets the last line.
ADVICE = {
    "FILE_TOO_LARGE": "Try compressing or splitting the file first.",
    "FILE_TYPE_INVALID": "Please upload a valid PDF file.",
    "FILE_CORRUPTED": "The file may be damaged. Try a different file.",
    "PDF_ENCRYPTED": "Please decrypt the PDF first using the Decrypt tool.",
    "PDF_MALFORMED": "Try using the Repair PDF tool first.",
    "PROCESSING_TIMEOUT": "Try with a smaller file or fewer pages.",
    "MEMORY_EXCEEDED": "Close other browser tabs and try again.",
    "WORKER_FAILED": "Refresh the page and try again.",
}
DEFAULT_ADVICE = "Please try again."


def lookup(code: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def error_rows(df: DataFrame, op: str, code: str | Column, message: str | Column) -> DataFrame:
    """(doc_id, op, code, category, message, recoverable, suggested_action)."""
    c = F.lit(code) if isinstance(code, str) else code
    m = F.col(message) if isinstance(message, str) else message
    return df.select(
        "doc_id",
        F.lit(op).alias("op"),
        c.alias("code"),
        lookup(c, CATEGORY, "PROCESSING_ERROR").alias("category"),
        m.alias("message"),
        (~c.isin(*FATAL)).alias("recoverable"),
        lookup(c, ADVICE, DEFAULT_ADVICE).alias("suggested_action"),
    )


def split_errors(df: DataFrame, code: str = "error_code") -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows) of a result that carries an error code column."""
    ok = df.filter(F.col(code).isNull()).drop(code)
    msg = "message" if "message" in df.columns else code
    bad = error_rows(df.filter(F.col(code).isNotNull()), "batch", F.col(code), F.col(msg))
    return ok, bad
