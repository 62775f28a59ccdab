"""Text expressions in Catalyst: stripping, folding, chunks, sentences, byte slices.

White space is that of Unicode together with the four information separators, the set that text
files are usually stripped of; trim() alone takes spaces only. A null text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
# Accented Latin letters and their base letters.
ACCENTED = "áàâãäåāéèêëēíìîïīóòôõöōúùûüūçñýÿÁÀÂÃÄÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÕÖŌÚÙÛÜŪÇÑÝ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuucnyyAAAAAAAEEEEEIIIIIOOOOOOUUUUUCNY"
SENTENCE_END = r"(?<=[.!?;])\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def fold(c: Column) -> Column:
    """Without accents: letters of Latin alphabets, and combining marks standing apart."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")


def words(c: Column) -> Column:
    """Folded lower-case words, in order; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(fold(F.lower(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def _stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def chunk_units(c: Column, target: int) -> Column:
    """Lines, and the sentences of lines longer than ``target``; blank ones dropped."""
    lines = _stripped(F.split(c, "\n"))
    return F.flatten(
        F.transform(
            lines,
            lambda u: F.when(F.length(u) > target, _stripped(F.split(u, rf"(?U){SENTENCE_END}"))).otherwise(F.array(u)),
        )
    )


def chunks(c: Column, target: int = 600) -> Column:
    """Units packed greedily into chunks of ``target`` characters; a longer unit stays whole.

    A text without units is one chunk, its stripped self.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def pack(acc: Column, u: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + F.length(u) + 1 > target)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["now"] == ""), u).otherwise(F.concat(acc["now"], F.lit("\n"), u)).alias("now"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))

    packed = F.aggregate(chunk_units(c, target), start, pack, finish)
    return F.when(F.size(packed) > 0, packed).when(c.isNotNull(), F.array(strip(c)))


def sentences(c: Column, longer_than: int = 15) -> Column:
    parts = F.transform(F.split(c, rf"(?U){SENTENCE_END}|\n+"), strip)
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def byte_slice(c: Column, start: Column, length: Column) -> Column:
    """``length`` UTF-8 bytes from byte ``start`` (0-based), without characters cut in half."""
    raw = F.substring(F.encode(c, "UTF-8"), start + 1, length)
    return strip(F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit("")))


def or_na(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("NA"))


def short(c: Column, n: int = 150) -> Column:
    return F.substring(c, 1, n)


def four_decimals(c: Column) -> Column:
    """Four decimals; a null stays null, where the format alone would write the word."""
    return F.when(c.isNotNull(), F.format_string("%.4f", c))
