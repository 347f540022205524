"""What the training-data operators share: reading tables, cutting lineage, word rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.lineage import cut  # noqa: F401  the operators take it from here

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Lower-cases A-Z and turns every byte that is no word byte (digits, letters, non-ASCII) into a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_bytes(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8; null has none."""
    return utf8(text).translate(WORD_BYTES).split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
