"""The lexical lane: inverted index, matching of all words, synonyms, order, highlights, positions.

Words are folded and lower-cased; stop words are ignored. A query matches a document that has all of
its words, in any field; in ``search_lane`` an equivalent stands for the words it replaces. Order is by BM25 (k1 1.2, b 0.75), ties by key. A query of stop words only
matches nothing. There is no typo tolerance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafsift.config import STOP_WORDS
from leafsift.functions.text import byte_slice, words
from leafsift.sources.files import exists

K1, B = 1.2, 0.75
FEW_PHRASES = 2000
# Which forms of a letter the highlighter treats alike.
ALIKE = {"a": "aáàâãä", "e": "eéèêë", "i": "iíìîï", "o": "oóòôõö", "u": "uúùûü", "c": "cç", "n": "nñ"}


LEX_FIELDS = ("conteudo_simplificado", "conteudo_original", "nome")
INDEX_PARTS, FIELD_GAP = 64, 1000


def postings(docs: DataFrame, key: str, fields: Sequence[str], positions: bool = False) -> DataFrame:
    """(term, key, tf, len[, pos]): words of all fields without stop words; partial counts before the shuffle.

    ``pos`` are the places of the word among all words, stop words too, with a gap between fields.
    """
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    if not positions:
        every = F.concat(*[words(F.col(f)) for f in fields])
        kept = F.filter(every, lambda w: ~F.array_contains(stop, w))
        d = docs.select(F.col(key).alias("key"), kept.alias("ws"))
        return d.select("key", F.size("ws").alias("len"), F.explode("ws").alias("term")).groupBy("term", "key", "len").agg(F.count("*").alias("tf"))
    gap = F.array_repeat(F.lit(""), FIELD_GAP)
    every = F.concat(*[F.concat(words(F.col(f)), gap) for f in fields])
    kept = F.filter(F.transform(every, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["w"] != "") & ~F.array_contains(stop, x["w"]))
    d = docs.select(F.col(key).alias("key"), kept.alias("ws"))
    d = d.select("key", F.size("ws").alias("len"), F.explode("ws").alias("x"))
    return d.groupBy(F.col("x.w").alias("term"), "key", "len").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("x.i")).alias("pos"))


def append_postings(made: DataFrame, path: str, ids: DataFrame) -> None:
    """Add the postings of new documents to the stored ones, in parts by term; documents already stored are left out."""
    if exists(made.sparkSession, path):
        stored = made.sparkSession.read.parquet(path).select("key").distinct()
        made = made.join(stored.join(ids.select(F.col("id").alias("key")), "key", "left_semi"), "key", "left_anti")
    part = _part(F.col("term"))
    made.withColumn("parte", part).repartition("parte").write.mode("append").partitionBy("parte").parquet(path)


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_PARTS)).cast("int")


def of_terms(index: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of a query's terms; of a stored index only the parts that hold them are read."""
    got = index.where(F.col("term").isin(terms))
    if "parte" not in index.columns:
        return got
    spark = index.sparkSession
    parts = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_part(F.col("term"))).distinct().collect()] if terms else []
    return got.where(F.col("parte").isin(parts)).drop("parte")


def sizes(index: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    return index.groupBy("key").agg(F.first("len").alias("len")).agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))


def query_terms(queries: DataFrame, q: str = "q") -> DataFrame:
    """(q, term): distinct words of each distinct query without stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    ws = F.array_except(words(F.col(q)), stop)
    return queries.select(F.col(q).alias("q"), F.explode(ws).alias("term")).distinct()


def _bm25() -> Column:
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def _ranked(scored: DataFrame, limit: int | None) -> DataFrame:
    ranked = scored.withColumn("posicao", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key")))
    return ranked.where(F.col("posicao") <= limit) if limit else ranked


def search_all(queries: DataFrame, index: DataFrame, q: str = "q", limit: int | None = None) -> DataFrame:
    """(q, key, score, posicao) of the documents with all words of each query."""
    terms = query_terms(queries, q)
    need = terms.groupBy("q").agg(F.count("*").alias("need"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    hits = terms.join(index, "term").join(df, "term").crossJoin(sizes(index))  # one row
    scored = hits.groupBy("q", "key").agg(F.count("*").alias("have"), F.sum(_bm25()).alias("score"))
    full = scored.join(need, "q").where("have = need").select("q", "key", F.round("score", 6).alias("score"))
    return _ranked(full, limit)


def _spaced(c: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))


def alternatives(queries: DataFrame, groups: DataFrame, q: str = "q") -> DataFrame:
    """(q, word, run): for each word of a query, itself and the equivalents of every known term of the query that holds it.

    Terms and equivalents are compared as folded words. Groups are settings: they become one array.
    """
    terms = groups.where("term is not null").select("group_id", _spaced(F.col("term")).alias("run"))
    pairs = terms.alias("a").join(terms.withColumnRenamed("run", "other").alias("b"), "group_id").where("run <> other").select("run", "other").distinct()
    every = pairs.agg(F.array_sort(F.collect_list(F.struct("run", "other"))).alias("__ps"))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    d = queries.select(F.col(q).alias("q")).where("q is not null").distinct().crossJoin(every)  # one row
    d = d.select("q", F.filter("__ps", lambda p: _spaced(F.col("q")).contains(p["run"])).alias("ps"), F.explode(F.array_except(words(F.col("q")), stop)).alias("word"))
    other = F.transform(F.filter("ps", lambda p: p["run"].contains(F.concat(F.lit(" "), F.col("word"), F.lit(" ")))), lambda p: F.trim(p["other"]))
    return d.select("q", "word", F.explode(F.array_distinct(F.concat(F.array("word"), other))).alias("run"))


def search_lane(queries: DataFrame, index: DataFrame, groups: DataFrame, q: str = "q", limit: int | None = None, measured: DataFrame | None = None) -> DataFrame:
    """(q, key, score, posicao) of the documents in which every word of a query occurs, or an equivalent of a term it is part of.

    Equivalents of several words occur as consecutive words. A query's score is the sum over its words
    of the best alternative's BM25. ``index`` has positions; ``measured`` are its ``sizes``.
    """
    alts = alternatives(queries, groups, q)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    placed = F.filter(F.transform(F.split("run", " "), lambda w, i: F.struct(w.alias("term"), i.alias("at"))), lambda x: ~F.array_contains(stop, x["term"]))
    runs = alts.select("run", F.size(placed).alias("need"), F.explode(placed).alias("x")).distinct().select("run", "need", "x.term", "x.at")
    df = index.join(F.broadcast(runs.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))  # words of requests
    hits = index.join(F.broadcast(runs), "term").join(F.broadcast(df), "term").crossJoin(F.broadcast(sizes(index) if measured is None else measured))
    starts = F.transform("pos", lambda p: p - F.col("at"))
    held = hits.groupBy("run", "need", "key").agg(F.sum(_bm25()).alias("score"), F.collect_list(starts).alias("starts"))
    common = F.reduce(F.slice("starts", 2, F.lit(1000)), F.col("starts")[0], lambda acc, x: F.array_intersect(acc, x))
    held = held.where((F.size("starts") == F.col("need")) & (F.size(common) > 0)).select("run", "key", "score")
    need = alts.groupBy("q").agg(F.count_distinct("word").alias("words"))
    best = alts.join(held, "run").groupBy("q", "word", "key").agg(F.max("score").alias("score"))
    full = best.groupBy("q", "key").agg(F.count("*").alias("have"), F.sum("score").alias("score")).join(need, "q").where("have = words")
    return _ranked(full.select("q", "key", F.round("score", 6).alias("score")), limit)


def _runs(ws: str, n: int) -> Column:
    """All runs of ``n`` consecutive words, joined by spaces."""
    if n == 1:
        return F.col(ws)
    starts = F.sequence(F.lit(0), F.size(ws) - n)
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(F.col(ws), i + k) for k in range(n)]))


def phrases_in(docs: DataFrame, key: str, fields: Sequence[str], phrases: DataFrame) -> DataFrame:
    """(key, phrase): documents holding a phrase as consecutive words.

    A list of up to ``FEW_PHRASES`` is one array that every document is searched for in its own row.
    For longer lists the runs of words of each document, as long as the phrases are, are joined to
    them. ``phrases`` has phrase.
    """
    p = phrases.select("phrase", F.array_join(words(F.col("phrase")), " ").alias("run"), F.size(words(F.col("phrase"))).alias("n"))
    p = p.where("n > 0").distinct()
    if p.limit(FEW_PHRASES + 1).count() <= FEW_PHRASES:
        every = p.agg(F.array_sort(F.collect_list(F.struct("phrase", F.concat(F.lit(" "), "run", F.lit(" ")).alias("run")))).alias("__ps"))
        spaced = [F.concat(F.lit(" "), F.array_join(words(F.col(f)), " "), F.lit(" ")).alias(f"__t{i}") for i, f in enumerate(fields)]
        d = docs.select(F.col(key).alias("key"), *spaced).crossJoin(every)  # one row
        held = lambda x: reduce(or_, [F.col(f"__t{i}").contains(x["run"]) for i in range(len(fields))])
        return d.select("key", F.explode(F.transform(F.filter("__ps", held), lambda x: x["phrase"])).alias("phrase")).distinct()
    made = None
    for n in sorted(r["n"] for r in p.select("n").distinct().collect()):
        for f in fields:
            ws = docs.select(F.col(key).alias("key"), words(F.col(f)).alias("ws")).where(F.size("ws") >= n)
            one = ws.select("key", F.explode(F.array_distinct(_runs("ws", n))).alias("run"))
            made = one if made is None else made.unionByName(one)
    return made.join(p.select("phrase", "run"), "run").select("key", "phrase").distinct()


def search_synonyms(queries: DataFrame, docs: DataFrame, key: str, fields: Sequence[str], pairs: DataFrame, q: str = "q") -> DataFrame:
    """(q, key): documents that hold each query as a phrase, or an equivalent of it."""
    asked = queries.select(F.col(q).alias("q")).distinct()
    alternatives = asked.select("q", F.col("q").alias("phrase")).unionByName(
        asked.join(pairs, asked["q"] == pairs["term"]).select("q", F.col("equivalent").alias("phrase"))
    )
    held = phrases_in(docs, key, fields, alternatives.select("phrase"))
    return alternatives.join(held, "phrase").select("q", "key").distinct()


def _pattern(terms: Iterable[str]) -> str:
    """A pattern of whole words equal to the terms but for case and accents."""

    def letter(c: str) -> str:
        return f"[{ALIKE[c]}]" if c in ALIKE else re.escape(c)

    plain = ["".join(x for x in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(x) != "Mn") for t in terms]
    return r"(?iU)\b(" + "|".join("".join(map(letter, t)) for t in sorted(plain, key=lambda t: (-len(t), t))) + r")\b"


def highlight(c: Column, terms: Sequence[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    return F.regexp_replace(c, _pattern(terms), f"{before}$1{after}") if terms else c


def crop(c: Column, terms: Sequence[str], n: int = 30) -> Column:
    """``n`` words around the first match; the first ``n`` where nothing matches. A match may span several words."""
    ws = F.split(c, r"(?U)\s+")
    if not terms:
        return F.array_join(F.slice(ws, 1, n), " ")
    pattern = _pattern(terms)
    first = F.size(F.split(F.split(c, pattern, 2)[0], r"(?U)\s+"))  # the word that the match begins in
    start = F.greatest(F.least(first - n // 2, F.size(ws) - n + 1), F.lit(1)).cast("int")
    return F.array_join(F.slice(ws, F.when(c.rlike(pattern), start).otherwise(1), n), " ")


def positions(c: Column, terms: Sequence[str]) -> Column:
    """Byte offsets (start, length) of the matches, in order."""
    pattern = _pattern(terms)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    gaps = F.split(c, pattern)
    size = lambda x: F.octet_length(x).cast("int")
    begin = F.struct(F.array().cast("array<struct<start:int,length:int>>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + size(x["gap"])
        hit = F.struct(start.alias("start"), size(x["hit"]).alias("length"))
        return F.struct(F.concat(acc["out"], F.array(hit)).alias("out"), (start + size(x["hit"])).alias("at"))

    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(zipped, begin, step, lambda acc: acc["out"])


def _once(field: str, terms: Sequence[str]) -> Column:
    """(campo, termo) of a field's matches, in their first written form."""
    hits = F.transform(positions(F.col(field), terms), lambda p: byte_slice(F.col(field), p["start"], p["length"]))
    once = F.aggregate(
        F.filter(hits, lambda t: t != ""),
        F.array().cast("array<string>"),
        lambda acc, t: F.when(F.exists(acc, lambda o: F.lower(o) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t))),
    )
    named = F.transform(once, lambda t: F.struct(F.lit(field).alias("campo"), t.alias("termo")))
    return F.coalesce(named, F.array().cast("array<struct<campo:string,termo:string>>"))


def matched_terms(df: DataFrame, fields: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """``df`` with ``termos_match``: (campo, termo) as written, each once without regard to case, first form kept;
    and ``trecho_match``: (campo, texto) of the first field with a match, cropped and highlighted."""
    lists, snippet = [], None
    for f in fields:
        lists.append(_once(f, terms))
        text = highlight(crop(F.col(f), terms), terms)
        one = F.when(F.size(positions(F.col(f), terms)) > 0, F.struct(F.lit(f).alias("campo"), text.alias("texto")))
        snippet = one if snippet is None else F.coalesce(snippet, one)
    return df.withColumn("termos_match", F.concat(*lists)).withColumn("trecho_match", snippet)
