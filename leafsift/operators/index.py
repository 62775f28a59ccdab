"""Incremental indexing: what is new is cut into chunks, embedded and stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.config import METADATA_FIELDS, Settings
from leafsift.functions.text import chunks as chunk_texts
from leafsift.operators.lexical import LEX_FIELDS, append_postings, postings
from leafsift.operators.models import HashingEmbedder, embed
from leafsift.session import scratch, staged
from leafsift.sources.files import append_chunks, exists, latest_by, upsert

CHUNK_ID = r"_(orig|simp)_\d+$"


def base_of_chunk(chunk_id: Column) -> Column:
    """The base id a chunk id begins with; null for ids of another form."""
    return F.when(chunk_id.rlike(CHUNK_ID), F.regexp_replace(chunk_id, CHUNK_ID, ""))


def indexed_ids(chunks: DataFrame) -> DataFrame:
    """(id): distinct base ids; only chunk ids are read."""
    return chunks.select(base_of_chunk(F.col("chunk_id")).alias("id")).where("id is not null").distinct()


def new_leaflets(leaflets: DataFrame, chunks: DataFrame) -> DataFrame:
    return leaflets.join(indexed_ids(chunks), "id", "left_anti")


def cut(leaflets: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Chunks of both registers with the leaflet's fields; the index starts anew in each register."""
    settings = settings or Settings()
    meta = [c for c in ("nome", "tipo", *METADATA_FIELDS) if c in leaflets.columns]
    registers = F.array(
        *[
            F.struct(F.lit(name).alias("registro"), F.lit(short).alias("sufixo"), chunk_texts(F.col(col), settings.chunk_chars).alias("partes"))
            for name, short, col in (("original", "orig", "conteudo_original"), ("simplificada", "simp", "conteudo_simplificado"))
        ]
    )
    d = leaflets.select("id", *meta, F.inline(registers))
    d = d.select("id", *meta, "registro", "sufixo", F.posexplode("partes").alias("chunk_idx", "document"))
    return d.select(F.concat_ws("_", "id", "sufixo", "chunk_idx").alias("chunk_id"), "id", *meta, "registro", "chunk_idx", "document")


def index_leaflets(
    spark: SparkSession, leaflets: DataFrame, chunks_path: str, documents_path: str, make: Callable = HashingEmbedder,
    version: str | None = None, postings_path: str | None = None,
) -> int:
    """Index what is new; returns the number of new leaflets. A second run adds none.

    Of several rows with one id the latest ``version`` is taken; without one, the first by its texts.
    Documents are written first, then postings, and chunks last, and only chunks count as indexed, so a
    run that breaks off is made good by the next.
    """
    with scratch(spark):
        order = [F.desc_nulls_last(version)] if version else []
        new = new_leaflets(leaflets, spark.read.parquet(chunks_path)) if exists(spark, chunks_path) else leaflets
        new = latest_by(new.where("id is not null"), ["id"], [*order, F.xxhash64("conteudo_original", "conteudo_simplificado")])
        new = staged(new if version else new.withColumn("versao", F.current_timestamp()), "novas")
        n = new.count()
        if n:
            upsert(spark, documents_path, new, "id", version or "versao")
            if postings_path:
                fields = [f for f in LEX_FIELDS if f in new.columns]
                append_postings(postings(new, "id", fields, positions=True), postings_path, new.select("id"))
            made = cut(new.drop("versao"))
            append_chunks(made.withColumn("embedding", embed(F.col("document"), make)), chunks_path)
    return n
