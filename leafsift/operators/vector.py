"""The semantic lane: exact cosine neighbours in blocks, best chunk per document, rerank, sentences.

Vectors of zeros, null vectors and vectors of another length than the query's have similarity 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafsift.config import Settings
from leafsift.functions.text import sentences, words
from leafsift.session import parallelism, ship, staged

BLOCK_QUERIES, BLOCK_ROWS, FEW_BLOCKS = 256, 4096, 64


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays inside the JVM; for single pairs. 0 for zero norms."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """Rows packed by ``size``: one row holds many keys, the lengths of their vectors, and all their values as bytes.

    Order doesn't matter, so nothing is shuffled. A null vector is one of length 0.
    """
    kind = df.schema["k"].dataType.simpleString()

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, size):
                p = b.slice(at, size)
                lists = p["v"].to_pylist()
                flat = np.array([x for v in lists if v for x in v], dtype=np.float32)
                sizes = pa.array([[len(v or ()) for v in lists]], pa.list_(pa.int32()))
                keys = pa.array([p["k"].to_pylist()], pa.list_(p.schema.field("k").type))
                yield pa.RecordBatch.from_arrays([keys, sizes, pa.array([flat.tobytes()], pa.binary())], names=[f"{name}_keys", f"{name}_sizes", f"{name}_values"])

    return df.mapInArrow(pack, f"{name}_keys array<{kind}>, {name}_sizes array<int>, {name}_values binary")


def _by_size(sizes: list[int], values: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of a block, by the length of the vector; vectors of zeros stay zeros."""
    sizes, flat = np.asarray(sizes), np.frombuffer(values, np.float32).astype(np.float64)
    ends = np.cumsum(sizes)
    out = {}
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        if n:
            m = flat[(ends[at] - n)[:, None] + np.arange(n)]
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            out[int(n)] = at, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return out


def nearest(
    queries: DataFrame, rows: DataFrame, query_key: str, row_key: str, k: int, vector: str = "embedding",
) -> DataFrame:
    """(query_key as qid, row_key as rid, score, lugar): the k most similar rows of every query, exactly.

    Queries and rows are packed into blocks and met block against block; each meeting is one matrix
    product whose k best per query go on, so the shuffle carries k rows per query and block of rows.
    Blocks of queries are broadcast while they are few (``FEW_BLOCKS``); more are met in rounds of as
    many, so no task ever holds more, and the work, queries times rows, is spread over all tasks.
    """
    spark = rows.sparkSession
    ship(spark)
    qt, rt = queries.schema[query_key].dataType.simpleString(), rows.schema[row_key].dataType.simpleString()
    qs = _blocks(queries.select(F.col(query_key).alias("k"), F.col(vector).alias("v")).coalesce(parallelism(spark)), BLOCK_QUERIES, "q")
    qs = staged(qs.withColumn("rodada", F.floor(F.rand(7) * F.lit(1 << 20)).cast("int")), "perguntas")
    count = qs.count()
    rs = _blocks(rows.select(F.col(row_key).alias("k"), F.col(vector).alias("v")), BLOCK_ROWS, "r")
    rounds = max(-(-count // FEW_BLOCKS), 1)

    def best(batches):
        import pyarrow as pa

        for batch in batches:
            for b in batch.to_pylist():
                s = np.zeros((len(b["q_keys"]), len(b["r_keys"])))
                r = _by_size(b["r_sizes"], b["r_values"])
                for n, (at, q) in _by_size(b["q_sizes"], b["q_values"]).items():
                    if n in r:
                        s[np.ix_(at, r[n][0])] = np.round(q @ r[n][1].T, 9)
                rk = np.asarray(b["r_keys"])
                qid, rid, score = [], [], []
                for i, q in enumerate(b["q_keys"]):
                    order = np.lexsort((rk, -s[i]))[:k]
                    qid += [q] * len(order)
                    rid += rk[order].tolist()
                    score += s[i][order].tolist()
                names = ["qid", "rid", "score"]
                yield pa.RecordBatch.from_arrays([pa.array(qid, types[0]), pa.array(rid, types[1]), pa.array(score, pa.float64())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(queries.schema[query_key].dataType), to_arrow_type(rows.schema[row_key].dataType)]
    got = None
    for at in range(rounds):
        some = qs if rounds == 1 else qs.where(F.pmod("rodada", F.lit(rounds)) == at)
        met = rs.crossJoin(F.broadcast(some.drop("rodada")))  # a bounded number of blocks, not rows
        one = met.mapInArrow(best, f"qid {qt}, rid {rt}, score double")
        got = one if got is None else got.unionByName(one)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rid")
    return got.withColumn("lugar", F.row_number().over(w)).where(F.col("lugar") <= k)


def collapse(pool: DataFrame, limit: int, min_score: float, query: str = "qid", doc: str = "id") -> DataFrame:
    """The best chunk of each document, those of at least ``min_score``, the first ``limit`` per query."""
    per_doc = Window.partitionBy(query, doc).orderBy(F.desc("score"), "lugar")
    best = pool.withColumn("__n", F.row_number().over(per_doc)).where("__n = 1").drop("__n")
    ok = best.where((F.col("score") >= min_score) & ~F.isnan("score"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), "lugar")
    return ok.withColumn("posicao", F.row_number().over(order)).where(F.col("posicao") <= limit)


def rerank(pool: DataFrame, limit: int, settings: Settings | None = None, min_score_rerank: float | None = None, query: str = "qid", doc: str = "id") -> DataFrame:
    """Second stage: the first chunks of the pool by their ``rerank_score``; ties keep the nearer chunk.

    Chunks beyond the pool or without a score take no part; only the reranker's own threshold holds.
    """
    settings = settings or Settings()
    least = settings.rerank_min_score if min_score_rerank is None else min_score_rerank
    d = pool.where(F.col("lugar") <= settings.rerank_pool).where(F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score"))
    per_doc = Window.partitionBy(query, doc).orderBy(F.desc("rerank_score"), "lugar")
    best = d.withColumn("__n", F.row_number().over(per_doc)).where("__n = 1").drop("__n").where(F.col("rerank_score") >= least)
    order = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "lugar")
    return best.withColumn("posicao", F.row_number().over(order)).where(F.col("posicao") <= limit)


def register(c: Column) -> Column:
    """``simplificada`` where the register begins so, ``original`` for all others and none."""
    return F.when(F.coalesce(c, F.lit("")).startswith("simplific"), "simplificada").otherwise("original")


def both_registers(chunks: DataFrame, doc: str = "id", ids: DataFrame | None = None) -> DataFrame:
    """(doc, original, simplificada): chunks joined by line ends in the order of their index; null if none."""
    d = chunks.select(F.col(doc).alias("doc"), register(F.col("registro")).alias("r"), F.coalesce("chunk_idx", F.lit(0)).alias("i"), "chunk_id", "document")
    if ids is not None:
        d = d.join(ids.select(F.col(doc).alias("doc")).distinct(), "doc", "left_semi")
    d = d.where("doc is not null and doc <> ''").dropDuplicates(["doc", "chunk_id"])

    def text(which: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when((F.col("r") == which) & F.col("document").isNotNull(), F.struct("i", "chunk_id", "document"))))
        return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda x: x["document"]), "\n"))

    return d.groupBy("doc").agg(text("original").alias("original"), text("simplificada").alias("simplificada")).withColumnRenamed("doc", doc)


def overlap_score(query: Column, sentence: Column) -> Column:
    """Share of a query's words in a sentence; the stand-in for a model that scores sentences."""
    q = F.array_distinct(words(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(sentence))), F.size(q)), F.lit(0.0))


def best_sentence(text: Column, score) -> Column:
    """(texto, score) of the first sentence with the highest score; null if there is no sentence."""
    scored = F.transform(sentences(text), lambda s: F.struct(s.alias("texto"), score(s).cast("double").alias("score")))
    top = F.aggregate(
        scored,
        F.lit(None).cast("struct<texto:string,score:double>"),
        lambda acc, x: F.when(acc.isNull() | (x["score"] > acc["score"]), x).otherwise(acc),
    )
    return F.when(F.size(scored) > 0, top)
