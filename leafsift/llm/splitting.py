"""Cuts oversized texts into pieces by recursive bisection at natural boundaries.

A text over ``limit`` code points (without surrounding white space) is cut at the strongest
boundary near its midpoint, and each half that is still longer than ``limit - overlap`` is cut
again. Then every piece but the first is extended to the left by ``overlap`` characters of the
piece before. Boundaries, strongest first: a blank line, a line break (CR or LF), white space
after ``.``, ``!`` or ``?``, white space after ``;``.

Defined results
  * A null text has no pieces; a blank or empty one neither. A text within the limit is one piece.
  * A stretch without a boundary that fits the limit but not ``limit - overlap`` is kept whole and
    shares as many characters with the piece before as the limit leaves.
  * A stretch without a boundary that exceeds the limit is cut at white space near its midpoint,
    or anywhere if it has none; those pieces and the text are marked ``forcado``.
  * Pieces carry offsets into the stored text, so their own parts (``ini_nucleo`` to ``fim``)
    tile the stripped text without loss.
  * White space before a stretch kept whole that does not fit the limit with it is left out, the only
    characters that are in no piece.
  * Repeated rows give repeated pieces; extra columns pass through, those with a name that the
    result needs are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.session import ship, spread

LIMIT, OVERLAP = 1200, 100
_BOUNDARY = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*|[\r\n]|(?<=[.!?;])\s+")
_SPACE = re.compile(r"\s")
CUT_TYPE = "array<struct<ini:int,ini_nucleo:int,fim:int,forcado:boolean>>"


def _boundaries(text: str) -> list[tuple[int, int, int]]:
    """(start, end, strength) of every boundary of a stripped text, in order."""
    out = []
    for m in _BOUNDARY.finditer(text):
        a, b = m.span()
        run = text[a:b]
        breaks = run.count("\n") + run.count("\r") - run.count("\r\n")
        strength = 3 if breaks > 1 else 2 if breaks else 0 if text[a - 1] == ";" else 1
        out.append((a, b, strength))
    return out


def longest_stretch(text: str) -> int:
    """Most characters between two consecutive boundaries (or an end) of the stripped text."""
    at, most = 0, 0
    body = text.strip()
    for a, b, _ in _boundaries(body):
        most, at = max(most, a - at), b
    return max(most, len(body) - at)


def unbroken(text: str, most: int) -> bool:
    """Whether more than ``most`` characters lie between two consecutive boundaries.

    Most texts are cleared by the commonest boundaries alone, which plain replacement finds.
    """
    if len(text) <= most:
        return False
    plain = text.replace("\r", "\n")
    for mark in (". ", "! ", "? ", "; "):
        plain = plain.replace(mark, mark[0] + "\n")
    return max(map(len, plain.split("\n"))) > most and longest_stretch(text) > most


def _forced(text: str, a: int, b: int, most: int) -> list[int]:
    """Ends of the parts of a stretch without boundaries, by bisection at white space."""
    ends, todo = [], [(a, b)]
    while todo:
        s, e = todo.pop()
        if e - s <= most:
            ends.append(e)
            continue
        mid = (s + e) // 2
        reach = (e - s) // 4
        left = max((m.start() for m in _SPACE.finditer(text, mid - reach, mid)), default=None)
        right = _SPACE.search(text, mid, mid + reach)
        options = [p for p in (left, right.start() if right else None) if p is not None and s < p < e]
        cut = min(options, key=lambda p: abs(p - mid)) if options else mid
        todo += [(cut, e), (s, cut)]
    return ends


def bisect_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """(start, start of its own part, end, forced) of each piece, as offsets into ``text``."""
    if text is None:
        return []
    lead = len(text) - len(text.lstrip())
    body = text.strip()
    n = len(body)
    if not n:
        return []
    if n <= limit:
        return [(lead, lead, lead + n, False)]
    core = limit - overlap
    marks = _boundaries(body)
    starts = np.array([m[0] for m in marks], dtype=np.int64)
    parts: list[tuple[int, int, bool]] = []
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= core:
            parts.append((a, b, False))
            continue
        lo = int(np.searchsorted(starts, a, "right"))
        hi = int(np.searchsorted(starts, b, "left"))
        mid = (a + b) // 2
        quarter = (b - a) // 4
        best = None
        for s, e, strength in marks[lo:hi]:
            near = abs(s - mid) <= quarter
            key = (near, strength if near else 0, -abs(s - mid))
            if best is None or key > best[0]:
                best = (key, s)
        if best is not None:
            todo += [(best[1], b), (a, best[1])]
            continue
        first = a + len(body[a:b]) - len(body[a:b].lstrip())
        if b - first <= limit:
            parts.append((a, b, False))
            continue
        s = a
        for e in _forced(body, a, b, core):
            parts.append((s, e, True))
            s = e
    out, before = [], 0
    for k, (a, b, forced) in enumerate(parts):
        if not k:
            start = a
        else:
            start = max(before, a - max(0, min(overlap, limit - (b - a))))
            if b - start > limit:  # only white space before what is kept whole can be too much
                start = b - limit
                a = max(a, start)
        out.append((lead + start, lead + a, lead + b, forced))
        before = start
    return out


def _cuts(limit: int, overlap: int):
    @F.arrow_udf(CUT_TYPE)
    def cuts(texts: pa.Array) -> pa.Array:
        rows = [bisect_text(t, limit, overlap) for t in texts.to_pylist()]
        ends = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r) for r in rows], out=ends[1:])
        flat = [p for r in rows for p in r]
        cols = list(zip(*flat)) if flat else [(), (), (), ()]
        struct = pa.StructArray.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_())],
            ["ini", "ini_nucleo", "fim", "forcado"],
        )
        return pa.ListArray.from_arrays(pa.array(ends), struct)

    return cuts


def cut_column(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The cuts of a text as an array; texts within the limit never leave the JVM."""
    return F.when(F.length(text) > limit, _cuts(limit, overlap)(F.when(F.length(text) > limit, text)))


def with_cuts(df: DataFrame, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, out: str = "cortes") -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(out, cut_column(F.col(text_col), limit, overlap))


def split_texts(df: DataFrame, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: the columns of ``df`` without the text, and ``parte`` (0-based),
    ``texto``, ``ini``, ``ini_nucleo``, ``fim`` (offsets in code points) and ``forcado``."""
    made = ("parte", "texto", "ini", "ini_nucleo", "fim", "forcado")
    keep = [c for c in df.columns if c != text_col and c not in made]
    d = with_cuts(spread(df.select(*keep, F.col(text_col).alias("__texto"))), "__texto", limit, overlap, "__cortes")
    bare = F.regexp_replace("__texto", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    lead = F.length("__texto") - F.length(F.regexp_replace("__texto", r"(?U)^[\s\x1c-\x1f]+", ""))
    whole = F.when(
        F.length(bare) > 0,
        F.array(
            F.struct(
                lead.cast("int").alias("ini"),
                lead.cast("int").alias("ini_nucleo"),
                (lead + F.length(bare)).cast("int").alias("fim"),
                F.lit(False).alias("forcado"),
            )
        ),
    )
    d = d.select(*keep, "__texto", F.posexplode(F.coalesce("__cortes", whole)).alias("parte", "__c"))
    return d.select(
        *keep,
        "parte",
        F.expr("substring(__texto, __c.ini + 1, __c.fim - __c.ini)").alias("texto"),
        F.col("__c.ini").alias("ini"),
        F.col("__c.ini_nucleo").alias("ini_nucleo"),
        F.col("__c.fim").alias("fim"),
        F.col("__c.forcado").alias("forcado"),
    )
