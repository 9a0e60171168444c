"""What the operators share: the text view of a table, folds, and Arrow helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space splits words, as `[^\x20\x09-\x0D]+` says; bytes.split() uses the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): whatever else a table holds cannot clash. Null texts become empty."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once when texts are very long; a session's own settings stay."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def held_out(id_col: str = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id as text, divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 bytes, unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and no other letter touched."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
