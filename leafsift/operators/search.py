"""Hybrid search: both lanes for one request, side by side, and the answer as it goes over the wire."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.config import METADATA_FIELDS, Settings, check_request
from leafsift.functions.text import four_decimals, short
from leafsift.functions.text import sentences
from leafsift.operators import lexical, synonyms, vector
from leafsift.operators.lexical import LEX_FIELDS
from leafsift.operators.models import HashingEmbedder, OverlapReranker, best_sentence_reranked, nearest_sentence, rerank_scores
from leafsift.session import staged
from leafsift.sources import files



@dataclass
class Engine:
    """The tables of the index and the makers of the models; nothing is read or loaded before it is needed.

    ``postings`` is the stored inverted index, with positions; without it one is built from the
    documents and staged, once per engine. Counts of both indexes are taken once per engine too.
    """

    documents: DataFrame
    chunks: DataFrame
    groups: DataFrame
    embedder: Callable = HashingEmbedder
    reranker: Callable = OverlapReranker
    settings: Settings | None = None
    postings: DataFrame | None = None

    def __post_init__(self) -> None:
        self.settings = self.settings or Settings()

    @classmethod
    def open(cls, spark: SparkSession, path: str, **given) -> Engine:
        """The engine over an index folder, made empty where it doesn't exist yet."""
        documents = files.read_table(spark, f"{path}/documents")
        if documents is None:
            documents = spark.createDataFrame([], ", ".join(f"{c} string" for c in ("id", "nome", "tipo", "conteudo_original", "conteudo_simplificado", *METADATA_FIELDS)))
        chunks, postings = f"{path}/chunks", f"{path}/postings"
        empty = spark.createDataFrame([], "chunk_id string, id string, nome string, tipo string, registro string, chunk_idx int, document string, embedding array<float>")
        stored = spark.read.parquet(postings) if files.exists(spark, postings) else None
        return cls(documents, spark.read.parquet(chunks) if files.exists(spark, chunks) else empty, synonyms.default_groups(spark), postings=stored, **given)

    @cached_property
    def model(self):
        """The embedder of queries, loaded on first use."""
        return self.embedder()

    @cached_property
    def _postings(self) -> DataFrame:
        fields = [f for f in LEX_FIELDS if f in self.documents.columns]
        return self.postings if self.postings is not None else staged(lexical.postings(self.documents, "id", fields, positions=True), "indice")

    @cached_property
    def _measured(self) -> DataFrame:
        r = lexical.sizes(self._postings).first()
        return self.documents.sparkSession.createDataFrame([(r["docs"], r["avg_len"])], "docs long, avg_len double")

    @cached_property
    def _pieces(self) -> int:
        return self.chunks.count()

    def lexical_lane(self, q: str, limit: int = 1) -> DataFrame:
        """Documents with every word of the query or an equivalent, with matched terms and a snippet."""
        spark = self.documents.sparkSession
        asked = spark.createDataFrame([(q,)], "q string")
        runs = [r["run"] for r in lexical.alternatives(asked, self.groups).select("run").distinct().collect()]
        terms = sorted({w for r in runs for w in r.split(" ")})
        index = lexical.of_terms(self._postings, terms)
        hits = lexical.search_lane(asked, index, self.groups, limit=limit, measured=self._measured)
        hits = hits.select(F.col("key").alias("id"), F.col("score").alias("bm25"), "posicao")
        fields = [f for f in LEX_FIELDS if f in self.documents.columns]
        return lexical.matched_terms(self.documents.join(F.broadcast(hits), "id"), fields, runs)  # at most ``limit`` hits

    def semantic_lane(
        self, q: str, limit: int = 1, min_score: float | None = None, rerank: bool = False, simplified_only: bool = False, min_score_rerank: float | None = None
    ) -> DataFrame:
        """Documents by their best chunk, with both texts and the sentence that matched.

        The vector is that of the expanded query; the reranker reads the query as written and only its
        own threshold holds then.
        """
        spark = self.chunks.sparkSession
        expanded = synonyms.expand(spark.createDataFrame([(q,)], "q string"), self.groups).first()["expandida"]
        vec = [float(x) for x in self.model.encode([expanded])[0]]
        asked = spark.createDataFrame([(q, vec)], "qid string, embedding array<float>")
        rows = self.chunks.where(vector.register(F.col("registro")) == "simplificada") if simplified_only else self.chunks
        k = self.settings.pool(limit, self._pieces)
        meta = [c for c in ("nome", "tipo", *METADATA_FIELDS, "registro", "chunk_idx") if c in rows.columns]
        fields = rows.select(F.col("chunk_id").alias("rid"), "id", "document", *meta)
        if not k:
            best = fields.limit(0).withColumns({"score": F.lit(0.0), "rerank_score": F.lit(None).cast("double"), "posicao": F.lit(0)})
            return self._shape(best, meta, q, vec, rerank)
        pool = vector.nearest(asked, rows, "qid", "chunk_id", k).join(fields, "rid")
        if rerank:
            near = pool.where(F.col("lugar") <= self.settings.rerank_pool)
            best = vector.rerank(near.withColumn("rerank_score", rerank_scores(F.lit(q), F.col("document"), self.reranker)), limit, self.settings, min_score_rerank)
        else:
            best = vector.collapse(pool, limit, self.settings.min_score if min_score is None else min_score).withColumn("rerank_score", F.lit(None).cast("double"))
        return self._shape(best, meta, q, vec, rerank)

    def _shape(self, best: DataFrame, meta: list[str], q: str, vec: list[float], rerank: bool) -> DataFrame:
        best = staged(best, "achados")  # at most ``limit`` rows, so that models score them once
        both = vector.both_registers(self.chunks, "id", best.select("id"))
        cut = sentences(F.col("document"), self.settings.sentence_chars)
        sentence = best_sentence_reranked(cut, q, self.reranker) if rerank else nearest_sentence(cut, vec, self.embedder)
        return best.join(both, "id", "left").select(
            "posicao", F.col("rid").alias("id_chunk"), "id", "document", F.struct("id", *meta).alias("metadata"), (1 - F.col("score")).alias("distancia"), "score", "rerank_score",
            "original", "simplificada", sentence.alias("trecho_match"),
        )

    def search(self, q: str, n: int = 5, min_score: float = 0.4, rerank: bool = False, simplified_only: bool = False, min_score_rerank: float | None = None) -> tuple[DataFrame, DataFrame]:
        check_request(q, n, min_score, min_score_rerank)
        return self.lexical_lane(q, n), self.semantic_lane(q, n, min_score, rerank, simplified_only, min_score_rerank)


# The names of an answer's parallel lists, and the columns they come from.
ANSWER = (
    ("ids", "id_chunk"), ("docs", "document"), ("metadatas", "metadata"), ("distances", "distancia"), ("scores", "score"),
    ("originais", "original"), ("simplificadas", "simplificada"), ("trechos_match", "trecho_match"), ("rerank_scores", "rerank_score"),
)


def answers_json(semantic: DataFrame, by: str) -> DataFrame:
    """(by, resposta): the parallel lists of each answer as JSON, in order; rerank_scores is empty where none were given."""
    have = [(name, c) for name, c in ANSWER if c in semantic.columns]
    every = F.array_sort(F.collect_list(F.struct("posicao", *[c for _, c in have])))
    lists = []
    for name, c in have:
        one = F.transform(F.col("__all"), _field(c))
        if name == "rerank_scores":
            one = F.filter(one, lambda v: v.isNotNull())
        lists.append(one.alias(name))
    return semantic.groupBy(by).agg(every.alias("__all")).select(by, F.to_json(F.struct(*lists), {"ignoreNullFields": "false"}).alias("resposta"))


def answer_json(semantic: DataFrame) -> DataFrame:
    """One row (resposta) for the answer to one request, also where it is empty."""
    spark = semantic.sparkSession
    one = answers_json(semantic.withColumn("__um", F.lit(1)), "__um")
    return spark.range(1).select((F.col("id") + 1).cast("int").alias("__um")).join(one, "__um", "left").select(
        F.coalesce("resposta", F.lit("{" + ",".join(f'"{n}":[]' for n, c in ANSWER if c in semantic.columns) + "}")).alias("resposta")
    )


def _field(c: str):
    return lambda x: x[c]


def lines(semantic: DataFrame) -> DataFrame:
    """What a terminal shows of each result: scores to four places, the first 150 characters."""
    score = F.coalesce(F.concat(F.lit("rerank "), four_decimals(F.col("rerank_score"))), F.concat(F.lit("score "), four_decimals(F.col("score"))))
    return semantic.select("posicao", F.concat_ws(" | ", "id", score, short(F.col("document"))).alias("linha"))
