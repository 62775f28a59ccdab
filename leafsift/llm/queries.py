"""The pN_ queries, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.llm import borda, canonical, encoding, mixing, near_duplicates, reading, splitting, truncation
from leafsift.session import spread, staged
from leafsift.sources.files import latest_by
from leafsift.sources.tables import table

FIELDS = ("conteudo_original", "conteudo_simplificado")


# --- p1: one order from two scores ---------------------------------------------------------------


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    api = table(spark, d, "api").where((F.size("scores") > 0) & (F.size("rerank_scores") > 0))
    return borda.borda_order(api, missing="none")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    top = _ordered(spark, d).select("resp_id", F.get("ordem", F.lit(0))["id"].alias("id"), "recebido_em")
    return top.groupBy("resp_id").agg(F.max_by("id", F.struct("recebido_em", "id")).alias("id"))  # one arrival time twice: the greater id


def p1_order(spark: SparkSession, d: str) -> DataFrame:
    """The whole combined order of the latest delivery, one row per item."""
    api = _ordered(spark, d).select("resp_id", "ordem", "recebido_em")
    last = api.groupBy("resp_id").agg(F.max_by("ordem", F.struct("recebido_em", "ordem")).alias("ordem"))
    return last.select("resp_id", F.inline("ordem")).select("resp_id", "id", F.round("pontos", 6).alias("pontos"), "posicao")


# --- p2: mapping to lists ------------------------------------------------------------------------


def _mapped(spark: SparkSession, d: str, campo: str) -> tuple[DataFrame, DataFrame]:
    """((bula_id, valor) as delivered, mapping of the distinct values) of one field."""
    b = table(spark, d, "bulas").select("bula_id", F.col(campo).alias("valor")).where("valor is not null")
    if campo == "fabricante":
        m = canonical.map_values(b, "valor", table(spark, d, "ref_fabricante"), "fab_id", "nome", "sigla", trade=True)
    else:
        m = canonical.map_values(b, "valor", table(spark, d, "ref_marca"), "marca_id", "nome")
    return b, m


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for campo in ("fabricante", "nome_comercial"):
        b, m = _mapped(spark, d, campo)
        m = m.where("ref_id is not null and not exato").select("valor", "ref_id")
        one = b.join(m, "valor").select("bula_id", F.lit(campo).alias("campo"), "ref_id").distinct()
        out = one if out is None else out.unionByName(one)
    return out


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Report: values that mean no entry, with the rows that have them; ``vazio`` marks placeholders."""
    out = None
    for campo in ("fabricante", "nome_comercial"):
        b, m = _mapped(spark, d, campo)
        m = m.where("ref_id is null").select("valor", "vazio")
        one = b.groupBy("valor").agg(F.count("*").alias("linhas")).join(m, "valor").select(F.lit(campo).alias("campo"), "valor", "vazio", "linhas")
        out = one if out is None else out.unionByName(one)
    return out


# --- p3: splitting -------------------------------------------------------------------------------


FEW_REPEATED = 1_000_000


def _delivered_once(b: DataFrame) -> DataFrame:
    """The latest delivery of each leaflet. Only leaflets delivered again are moved for that.

    Their ids are broadcast if they are at most ``FEW_REPEATED``; beyond that all rows are shuffled once.
    """
    order = [F.desc_nulls_last("carregado_em")]
    again = staged(b.groupBy("bula_id").count().where("count > 1").select("bula_id"), "repetidas")
    if again.limit(FEW_REPEATED + 1).count() > FEW_REPEATED:
        return latest_by(b, ["bula_id"], order)
    again = F.broadcast(again)
    return b.join(again, "bula_id", "left_anti").unionByName(latest_by(b.join(again, "bula_id", "left_semi"), ["bula_id"], order))


def _texts(b: DataFrame) -> DataFrame:
    """(bula_id, campo, texto) of every text."""
    fields = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("texto")) for c in FIELDS])
    return b.select("bula_id", F.inline(fields)).where(F.col("texto").isNotNull())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    long = _texts(table(spark, d, "bulas")).where(F.length("texto") > splitting.LIMIT)
    cut = splitting.with_cuts(long, "texto").where(F.size("cortes") > 1)
    forced = F.exists("cortes", lambda c: c["forcado"])
    return (
        cut.select("bula_id", "campo", forced.alias("f"))
        .groupBy("bula_id", "campo")
        .agg(F.when(F.bool_or("f"), "forcado").otherwise("natural").alias("corte"))
    )


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(_texts(_delivered_once(table(spark, d, "bulas").select("bula_id", "carregado_em", *FIELDS))), "texto")


# --- p4: near-duplicates ------------------------------------------------------------------------


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, d, "bulas").select("bula_id", "conteudo_original")
    return near_duplicates.near_duplicate_pairs(b, "bula_id", "conteudo_original")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.expand_pairs(*_similar(spark, d))
    return pairs.select(F.col("a").alias("bula_id_a"), F.col("b").alias("bula_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(*_similar(spark, d)).withColumnRenamed("key", "bula_id")


# --- p5: reading level ---------------------------------------------------------------------------


def _filled_texts(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bulas").select("bula_id", "id", "tipo", *FIELDS)
    fields = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("texto")) for c in FIELDS])
    return spread(b).select("bula_id", "id", "tipo", F.inline(fields)).where(near_duplicates.filled(F.col("texto")))


SOURCES = ("campo", "tipo")


def _labelled(spark: SparkSession, d: str) -> list:
    keys = ["bula_id", "campo"]
    sample = reading.training_sample(_filled_texts(spark, d), table(spark, d, "rotulos_leitura"), keys, "nivel", "id", sources=SOURCES)
    return reading.collected(sample, keys)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    model = reading.train(_labelled(spark, d))
    got = reading.predicted(_filled_texts(spark, d).drop("id", "tipo"), model, splitting.LIMIT)
    got = got.dropDuplicates(["bula_id", "campo"])
    return got.join(table(spark, d, "rotulos_leitura").select("bula_id", "campo"), ["bula_id", "campo"], "left_anti")


def p5_validation(spark: SparkSession, d: str) -> DataFrame:
    return reading.report(_labelled(spark, d), spark, SOURCES)


# --- p6: encoding --------------------------------------------------------------------------------


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = encoding.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"))
    return docs.groupBy("source").agg(F.count("*").alias("documentos"), F.sum("n_tokens").alias("tokens"))


# --- p7: mixing ----------------------------------------------------------------------------------


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return encoding.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text")).drop("text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    hist = mixing.counted_histogram(_counted(spark, d))
    solved = mixing.balance(hist, mixing.plan_lines(table(spark, d, "plano_mistura")))
    return solved.where("estado = 'inalcancavel'").select("plano_id", "source")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = mixing.staged(_counted(spark, d), "contados")
    solved = mixing.balance(
        mixing.staged(mixing.token_histogram(docs), "histograma"), mixing.plan_lines(table(spark, d, "plano_mistura"))
    )
    return mixing.draw(docs, solved), solved


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    drawn, solved = _mixed(spark, d)
    return mixing.shares(drawn, solved)


# --- p8: truncation ------------------------------------------------------------------------------


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(spread(table(spark, d, "documents").select("doc_id", "text")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("cortado").select("doc_id").distinct()


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(table(spark, d, "documents").select("doc_id", "source"), _judged(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_order, p2_found, p2_unmatched, p3_found, p3_pieces, p4_found, p4_groups, p5_found, p5_validation, p6_ids, p6_counts, p7_found, p7_mix, p7_shares, p8_found, p8_sources)
}
