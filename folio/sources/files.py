"""Files to documents: format by name, plain texts by detected encoding, identity by content.

decode_texts: a byte order mark decides; valid UTF-8 is UTF-8; else the least broken of
Big5, GB18030 and UTF-8, the first of equals.  Empty content is an empty UTF-8 text (Spark itself lists no empty files).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.rows import in_small_batches
from folio.functions.text import base_name, format_of

# Encodings to try, in this order, as Python names them and as they are reported.
FALLBACKS = (("big5hkscs", "big5"), ("gb18030", "gb18030"), ("utf-8", "utf-8"))
MARKS = ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, title, format, size, content) of every file; id is the SHA-256 of the bytes."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "[^/]*$", 0)
    return files.select(F.sha2("content", 256).alias("id"), name.alias("name"), base_name(name).alias("title"), format_of(name).alias("format"), F.col("length").alias("size"), "content")


_CONTROL = re.compile("[\x00-\x08\x0e-\x1f]")


def foreign_text(content: bytes) -> tuple[str, str]:
    """(text, encoding) of bytes that are no UTF-8: by their mark UTF-16, else the least broken of FALLBACKS, the first of equals."""
    for mark, codec in MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(codec, "replace"), codec
    best = None
    for codec, name in FALLBACKS:
        text = content.decode(codec, "replace")
        score = 3 * text.count("\ufffd") + len(_CONTROL.findall(text))  # as functions.text.bad_score
        if best is None or score < best[0]:
            best = score, text, name
        if score == 0:  # no later one is better
            break
    return best[1], best[2]


def _decoder():
    @F.pandas_udf("struct<text:string,encoding:string>")
    def decode(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if b is None else foreign_text(b) for b in content], columns=["text", "encoding"])

    return decode


def decoded(content: Column) -> Column:
    """struct(text, encoding) of bytes; only bytes that are no UTF-8 leave the JVM, once."""
    made = lambda text, name: F.struct(text.alias("text"), name.alias("encoding"))
    marked, good = F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.is_valid_utf8(content.cast("string"))
    foreign = _decoder()(F.when(~marked & ~good, content))
    text = F.when(content.isNull(), F.lit("")).when(marked, F.make_valid_utf8(F.substring(content, 4, 2_147_483_647).cast("string"))).when(good, content.cast("string")).otherwise(foreign["text"])
    return made(text, F.when(content.isNull() | marked | good, "utf-8").otherwise(foreign["encoding"]))


def decode_texts(files: DataFrame) -> DataFrame:
    """Plain-text files with `text` and `encoding` for their content."""
    return in_small_batches(files).where("format = 'txt'").withColumn("__d", decoded(F.col("content"))).select(*[c for c in files.columns if c != "content"], F.col("__d.text").alias("text"), F.col("__d.encoding").alias("encoding"))
