"""Code crosswalk files and directories of code lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: three words separated by spaces
_THREE_WORDS = r"(\w*) +(\w*) +(\w*)"


def read_crosswalk(spark: SparkSession, path: str, source: str = "i9") -> DataFrame:
    """i9, i10, flag from lines of source code, target code and flag.

    ``source`` is the code system of the first word (``i9`` or ``i10``).
    """
    target = "i10" if source == "i9" else "i9"
    word = lambda i: F.regexp_extract("value", _THREE_WORDS, i)
    return (
        spark.read.text(path)
        .where(F.rlike("value", F.lit(_THREE_WORDS)))
        .select(word(1).alias(source), word(2).alias(target), word(3).alias("flag"))
        .select("i9", "i10", "flag")
    )


def read_code_lists(spark: SparkSession, directory: str) -> DataFrame:
    """file, code — trimmed lines of every file, without repeats within a file."""
    return (
        spark.read.text(directory, recursiveFileLookup=True)
        .select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("code"))
        .distinct()
    )
