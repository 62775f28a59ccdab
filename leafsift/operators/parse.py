"""Tagged leaflets: bodies, headers, tags, and the files' names.

Headers are not XML (tags may hold spaces), so they are read by patterns. Repeated tags: the later
value holds. Missing and empty values become ``NA``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.config import METADATA_FIELDS, CorpusType
from leafsift.functions.text import or_na, rstrip, strip

BODY = r"(?s)<text>(.*?)</text>"
HEADER = r"(?s)<metadata>(.*?)</metadata>"
TAG = r"(?s)<([^/>][^>]*?)>(.*?)</\1>"
BLOCK = r"(?s)\n*<text>.*?</text>\s*\z"
BRAND_TAG = r"(?s)\A(.*?<nome_comercial>)([^\n]*?)(</nome_comercial>)"


def body(raw: Column) -> Column:
    """The first text block, or the whole where there is none; stripped."""
    return strip(F.when(raw.rlike(BODY), F.regexp_extract(raw, BODY, 1)).otherwise(raw))


def header_tags(raw: Column) -> Column:
    """(name, value) of the header's tags, names lower-cased with white space as ``_``."""
    block = F.regexp_extract(raw, HEADER, 1)
    names = F.regexp_extract_all(block, F.lit(TAG), F.lit(1))
    values = F.regexp_extract_all(block, F.lit(TAG), F.lit(2))
    return F.zip_with(
        names,
        values,
        lambda k, v: F.struct(F.regexp_replace(F.lower(strip(k)), r"(?U)\s+", "_").alias("name"), strip(v).alias("value")),
    )


def tag(tags: Column, name: str) -> Column:
    """The last value of a tag, null if it is absent."""
    found = F.filter(tags, lambda t: t["name"] == name)
    return F.get(found, F.size(found) - 1)["value"]


def parse_leaflets(df: DataFrame, raw: str = "value", fields: Sequence[str] = METADATA_FIELDS) -> DataFrame:
    """``df`` with ``texto`` and the curated header fields."""
    made = ("texto", *fields)
    keep = [c for c in df.columns if c not in made]
    d = df.select(*keep, body(F.col(raw)).alias("texto"), header_tags(F.col(raw)).alias("__tags"))
    picked = [or_na(tag(F.col("__tags"), f)).alias(f) for f in fields]
    return d.select(*keep, "texto", *picked)


def file_id(path: Column, suffix: str) -> Column:
    """The part of a file's name before ``suffix``, null for other files."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix)))


def number_of_file(path: Column) -> Column:
    """The number before the first ``_`` of a file's name, null if there is none."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("_"), F.lit(1)).try_cast("int")


def renamed(name: Column, cfg: CorpusType) -> Column:
    """An original's file name as that of its simplified text; other names are null."""
    stem = F.substring(name, F.lit(1), F.length(name) - len(cfg.original_suffix))
    return F.when(name.endswith(cfg.original_suffix), F.concat(stem, F.lit(cfg.simplified_suffix)))


def with_text(meta: Column, text: Column) -> Column:
    """A header with ``text`` as its text block, in place of any block it ends with."""
    bare = rstrip(F.regexp_replace(meta, BLOCK, ""))
    return F.concat(bare, F.lit("\n\n<text>\n"), strip(text), F.lit("\n</text>\n"))


def with_brand(meta: Column, brand: Column) -> Column:
    """A header with ``brand`` in its first brand tag; as it is where brand is null or the tag absent."""
    before = F.regexp_extract(meta, BRAND_TAG, 1)
    whole = F.regexp_extract(meta, BRAND_TAG, 0)
    rest = F.substring(meta, F.length(whole) + 1, F.length(meta))
    replaced = F.concat(before, brand, F.lit("</nome_comercial>"), rest)
    return F.when(brand.isNotNull() & meta.rlike(BRAND_TAG), replaced).otherwise(meta)
