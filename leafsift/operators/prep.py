"""Preparation of the corpus: drug maps, brands, headers, and what is ready to be indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.config import NO_BRANDS, CorpusType
from leafsift.functions.text import fold
from leafsift.operators import parse
from leafsift.sources.files import latest_by

BRAND = r"([A-ZÀ-Ý][\wÀ-ÿ\-]{2,})\s*[®™]"


def last_wins(drugs: DataFrame, order: str = "linha", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, primeira, nome): the last name of each id at the place of its first; empty ids are skipped."""
    ok = drugs.where(F.col("id").isNotNull() & (F.col("id") != ""))
    return ok.groupBy(*keys).agg(F.min(order).alias("primeira"), F.max_by("nome", order).alias("nome"))


def name_tokens(nome: Column) -> Column:
    """Folded words of at least three characters of a drug's name."""
    parts = F.filter(F.split(F.coalesce(nome, F.lit("")), r"(?U)\s+"), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.transform(parts, lambda w: F.lower(fold(w))))


def brands(texts: DataFrame, drugs: DataFrame, key: str = "id", text: str = "texto", order: str | None = None) -> DataFrame:
    """(key, marca): the word most often followed by a trade mark in the texts of a key.

    The drug's own name and boilerplate are no brands; ties go to the word found first. Keys without
    a brand are left out; keys missing from ``drugs`` have no name to exclude.
    """
    found = texts.select(
        F.col(key).alias("key"),
        (F.col(order) if order else F.lit(0)).alias("ord"),
        F.posexplode(F.regexp_extract_all(F.col(text), F.lit("(?U)" + BRAND), F.lit(1))).alias("pos", "token"),
    ).where(~F.col("token").isin(*NO_BRANDS))
    # counted per word before names are joined: what is shuffled is a key's words, not its texts
    counted = found.groupBy("key", "token").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    names = drugs.select(F.col(key).alias("key"), name_tokens(F.col("nome")).alias("inn"))
    kept = counted.join(names, "key", "left").where(
        ~F.array_contains(F.coalesce("inn", F.array().cast("array<string>")), F.lower(fold(F.col("token"))))
    )
    best = kept.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "token")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("b.token").alias("marca"))


def append_texts(headers: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((name, value) with the text of the same name attached, names without a text). Doing it twice changes nothing."""
    both = headers.select("name", F.col("value").alias("meta")).join(
        bodies.select("name", F.col("value").alias("body")), "name", "left"
    )
    done = both.where("body is not null").select("name", parse.with_text(F.col("meta"), F.col("body")).alias("value"))
    return done, both.where("body is null").select("name")


def copy_headers(originals: DataFrame, cfg: CorpusType) -> DataFrame:
    """(name, value): originals under the names of their simplified texts."""
    return originals.select(parse.renamed(F.col("name"), cfg).alias("name"), "value").where("name is not null")


def apply_brands(headers: DataFrame, marks: DataFrame, key: str = "id") -> DataFrame:
    """``headers`` with the brand of their key written in; ``mudou`` tells whether that changed them."""
    d = headers.join(marks, key, "left")
    new = parse.with_brand(F.col("value"), F.col("marca"))
    return d.withColumn("mudou", new != F.col("value")).withColumn("value", new).drop("marca")


def indexable(drugs: DataFrame, originals: DataFrame, simplified: DataFrame, cfg: CorpusType) -> tuple[DataFrame, DataFrame]:
    """(leaflets with both texts, mapped drugs that lack one). Header fields come from the original."""
    ids = last_wins(drugs).select("id", "nome")
    o = parse.parse_leaflets(originals.select(parse.file_id(F.col("path"), cfg.original_suffix).alias("id"), "value"))
    s = simplified.select(parse.file_id(F.col("path"), cfg.simplified_suffix).alias("id"), parse.body(F.col("value")).alias("conteudo_simplificado"))
    o = o.drop("value").withColumnRenamed("texto", "conteudo_original")
    both = ids.join(o, "id").join(s, "id")
    base = F.concat_ws("_", F.lit(cfg.tipo), "id")
    ready = both.withColumn("tipo", F.lit(cfg.tipo)).withColumn("id", base)
    missing = ids.join(both.select("id"), "id", "left_anti").select(base.alias("id"), "nome")
    return ready, missing


def deliveries(df: DataFrame, key: str = "bula_id", loaded: str = "carregado_em") -> DataFrame:
    """The latest delivery of each key."""
    return latest_by(df, [key], [F.desc_nulls_last(loaded)])
