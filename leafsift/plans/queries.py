"""One query for each of the engine's own operators, over whole tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.config import CORPUS_TYPES, Settings
from leafsift.functions import text as tx
from leafsift.operators import index, lexical, models, parse, prep, search, synonyms, vector
from leafsift.session import keep, shared_dir, spread, staged
from leafsift.sources import files
from leafsift.sources.files import latest_by
from leafsift.sources.tables import table
from leafsift.streaming import indexing

SET = Settings()
TERMS = ("boca", "seca")
QUESTION = "o paciente deve tomar com água"


def _drugs(spark: SparkSession, d: str) -> DataFrame:
    """(id, nome, primeira): base ids of the drug map, the last row of an id holding."""
    m = prep.last_wins(table(spark, d, "drug_map"), keys=("tipo", "id"))
    return m.select(F.concat_ws("_", "tipo", "id").alias("id"), "nome", "primeira")


def _bulas(spark: SparkSession, d: str) -> DataFrame:
    return prep.deliveries(table(spark, d, "bulas"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def _filled(c: str) -> Column:
    s = tx.strip(F.col(c))
    return F.col(c).isNotNull() & ~s.isin("", "NA")


def _header(*tags: tuple[str, Column]) -> Column:
    """A leaflet's header as its files hold it."""
    lines = [F.concat(F.lit(f"<{n}>"), F.coalesce(v, F.lit("")), F.lit(f"</{n}>\n")) for n, v in tags]
    return F.concat(F.lit("<metadata>\n"), *lines, F.lit("</metadata>"))


def q01_map_lastwins(spark: SparkSession, d: str) -> DataFrame:
    return _drugs(spark, d)


def q02_tag_extract(spark: SparkSession, d: str) -> DataFrame:
    header = _header(
        ("doenca", F.lit("antes")), ("doenca", F.col("doenca")), ("nome medicamento", F.col("nome_medicamento")),
        ("Nome_Comercial", F.col("nome_comercial")), ("fabricante", F.col("fabricante")),
    )
    raw = F.concat(header, F.lit("\n\n<text>\n"), F.coalesce("conteudo_original", F.lit("")), F.lit("\n</text>\n"))
    got = parse.parse_leaflets(_bulas(spark, d).select("bula_id", raw.alias("value")))
    return got.select("bula_id", "doenca", "nome_medicamento", "nome_comercial", "fabricante", "apresentacao", F.md5("texto").alias("texto_md5"))


def q03_inner_pair(spark: SparkSession, d: str) -> DataFrame:
    """Both corpora as one: mapped drugs with both files, the files being each drug's leaflet of the least number."""
    b = latest_by(_bulas(spark, d).where("id is not null"), ["id"], [F.col("bula_id")])
    out = None
    for cfg in CORPUS_TYPES:
        cfg = replace(cfg, tipo={"hipertensao": "ht", "oncologia": "onco"}[cfg.tipo])  # the tables' name of the corpus
        own = b.where(F.col("id").startswith(cfg.tipo + "_"))
        number = F.substring("id", F.lit(len(cfg.tipo) + 2), F.length("id"))
        raw = F.concat(_header(("fabricante", F.col("fabricante"))), F.lit("\n\n<text>\n"), F.col("conteudo_original"), F.lit("\n</text>\n"))
        originals = own.where(_filled("conteudo_original")).select(F.concat(number, F.lit(cfg.original_suffix)).alias("path"), raw.alias("value"))
        simplified = own.where(_filled("conteudo_simplificado")).select(F.concat(number, F.lit(cfg.simplified_suffix)).alias("path"), F.col("conteudo_simplificado").alias("value"))
        ready, _ = prep.indexable(table(spark, d, "drug_map").where(F.col("tipo") == cfg.tipo), originals, simplified, cfg)
        out = ready if out is None else out.unionByName(ready)
    return out.select("id", "nome", "tipo", "fabricante", F.md5("conteudo_original").alias("original"), F.md5("conteudo_simplificado").alias("simplificado"))


def q04_anti_new(spark: SparkSession, d: str) -> DataFrame:
    b = _bulas(spark, d).where("id is not null").select("bula_id", F.concat_ws("_", "id", "bula_id").alias("id"))
    return index.new_leaflets(b, table(spark, d, "chunks"))


def q05_chunk(spark: SparkSession, d: str) -> DataFrame:
    b = _bulas(spark, d)
    fields = F.array(
        F.struct(F.lit("original").alias("registro"), F.col("conteudo_original").alias("t")),
        F.struct(F.lit("simplificada").alias("registro"), F.col("conteudo_simplificado").alias("t")),
    )
    c = b.select("bula_id", F.inline(fields)).where("t is not null").select("bula_id", "registro", tx.chunks(F.col("t"), SET.chunk_chars).alias("c"))
    return c.select("bula_id", "registro", F.size("c").alias("n"), F.md5(F.array_join("c", "\x01")).alias("md5"))


def q06_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    s = docs.select("doc_id", tx.sentences(F.col("text"), SET.sentence_chars).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "\x01")).alias("md5"))


LEX_FIELDS = ("nome", "conteudo_original", "conteudo_simplificado")


def q07_lex_all(spark: SparkSession, d: str) -> DataFrame:
    b = _bulas(spark, d)
    ix = staged(lexical.postings(b, "bula_id", LEX_FIELDS), "indice")  # read for lengths, frequencies and hits
    got = lexical.search_all(table(spark, d, "synonyms"), ix, "term", limit=10)
    return got.select("q", F.col("key").alias("bula_id"), "score", "posicao")


def q07b_synonyms(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "synonyms")
    got = lexical.search_synonyms(s, _bulas(spark, d), "bula_id", LEX_FIELDS, synonyms.pairs(s), "term")
    return got.select("q", F.col("key").alias("bula_id"))


def q07c_lane(spark: SparkSession, d: str) -> DataFrame:
    """The engine's lexical lane for one request with a term of several words and a term of one."""
    docs = _bulas(spark, d).select(F.col("bula_id").alias("id"), *LEX_FIELDS)
    engine = search.Engine(docs, _chunks(spark, d), table(spark, d, "synonyms"))
    return engine.lexical_lane("Dor de CABEÇA com água", 50).select(F.col("id").alias("bula_id"), F.col("bm25").alias("score"), "posicao")


def q07d_lane_all(spark: SparkSession, d: str) -> DataFrame:
    b = _bulas(spark, d)
    ix = staged(lexical.postings(b, "bula_id", LEX_FIELDS, positions=True), "indice")
    s = table(spark, d, "synonyms")
    return lexical.search_lane(s, ix, s, "term", 10).select("q", F.col("key").alias("bula_id"), "score", "posicao")


def q08_positions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    ws = tx.words(F.col("text"))
    hit = docs.where(F.array_contains(ws, TERMS[0]) & F.array_contains(ws, TERMS[1]))
    p = hit.withColumn("p", lexical.positions(F.col("text"), TERMS)).where(F.size("p") > 0)
    one = lexical.matched_terms(p, ["text"], TERMS)
    return one.select(
        "doc_id", F.size("p").alias("n"), F.col("p")[0]["start"].alias("inicio"), F.col("p")[0]["length"].alias("tamanho"),
        F.md5(lexical.highlight(F.col("text"), TERMS)).alias("destaque"),
        F.array_join(F.transform("termos_match", lambda t: t["termo"]), "|").alias("termos"), F.md5("trecho_match.texto").alias("trecho"),
    )


def q09_synonyms(spark: SparkSession, d: str) -> DataFrame:
    got = synonyms.expand(table(spark, d, "api"), table(spark, d, "synonyms"))
    return got.select("q", F.array_join("extras", "|").alias("extras"), "expandida")


def q09b_pairs(spark: SparkSession, d: str) -> DataFrame:
    return synonyms.pairs(table(spark, d, "synonyms")).select("term", "equivalent")


def _pool(spark: SparkSession, queries: DataFrame, rows: DataFrame, qk: str, rk: str, limit: int = 5) -> DataFrame:
    return vector.nearest(queries, rows, qk, rk, SET.pool(limit, rows.count()))


def q10_knn_collapse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pool = _pool(spark, e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id")
    docs = pool.join(e.select(F.col("vec_id").alias("rid"), F.col("label").alias("id")), "rid")
    got = vector.collapse(docs, 5, SET.min_score)
    return got.select("qid", "id", F.round("score", 6).alias("score"), "posicao")


def q11_knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).where("registro = 'simplificada' and id is not null")
    pool = _pool(spark, c.where("bula_id % 100 = 0"), c, "chunk_id", "chunk_id")
    docs = pool.join(c.select(F.col("chunk_id").alias("rid"), "id"), "rid")
    got = vector.collapse(docs, 5, SET.min_score)
    return got.select("qid", "id", F.round("score", 6).alias("score"), "posicao")


def q12_best_sentence(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of each chunk nearest to a question, by the vectors of the hashing embedder."""
    vec = models.HashingEmbedder().encode([QUESTION])[0].tolist()
    best = models.nearest_sentence(tx.sentences(F.col("document"), SET.sentence_chars), vec)
    c = spread(_chunks(spark, d).select("chunk_id", "document")).select("chunk_id", best.alias("b"))
    return c.where("b is not null").select("chunk_id", "b.texto", F.round("b.score", 6).alias("score"))


def q12b_sentence_reranked(spark: SparkSession, d: str) -> DataFrame:
    best = models.best_sentence_reranked(tx.sentences(F.col("document"), SET.sentence_chars), QUESTION)
    c = spread(_chunks(spark, d).select("chunk_id", "document")).select("chunk_id", best.alias("b"))
    return c.where("b is not null").select("chunk_id", "b.texto", F.round("b.score", 6).alias("score"))


def q13b_rerank_model(spark: SparkSession, d: str) -> DataFrame:
    c = spread(_chunks(spark, d).select("chunk_id", "document"))
    return c.select("chunk_id", F.round(models.rerank_scores(F.lit(QUESTION), F.col("document")), 6).alias("rerank_score"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(table(spark, d, "api"), ["resp_id"], [F.desc_nulls_last("recebido_em")])


def q13_rerank(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).where("size(rerank_scores) > 0 and size(ids) > 0")
    items = F.transform(
        "ids", lambda x, i: F.struct(x.alias("id"), F.get("distances", i).alias("dist"), F.get("rerank_scores", i).alias("rerank_score"), i.alias("i"))
    )
    near = F.array_sort(F.transform(items, lambda x: F.struct(x["dist"], x["i"], x["id"], x["rerank_score"])))
    pool = a.select(F.col("resp_id").alias("qid"), F.posexplode(near).alias("p", "x"))
    pool = pool.select("qid", (F.col("p") + 1).alias("lugar"), F.col("x.id").alias("id"), F.col("x.rerank_score").alias("rerank_score"))
    return vector.rerank(pool, 5, SET).select(F.col("qid").alias("resp_id"), "id", "rerank_score", "posicao")


def q14_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").withColumn("bula", F.col("bula_id").cast("string"))
    got = vector.both_registers(c, "bula")
    return got.select("bula", F.md5("original").alias("original"), F.md5("simplificada").alias("simplificada"))


def q15_counts(spark: SparkSession, d: str) -> DataFrame:
    both = _filled("conteudo_original") & _filled("conteudo_simplificado")
    return _bulas(spark, d).groupBy("tipo").agg(
        F.count("*").alias("bulas"), F.count_if(both).alias("completas"), F.count_if(~both).alias("incompletas")
    )


def q16_truncate(spark: SparkSession, d: str) -> DataFrame:
    b = _bulas(spark, d).where("conteudo_simplificado is not null")
    size = F.length("conteudo_simplificado") / F.lit(1000.0)
    return b.select("bula_id", tx.short(F.col("conteudo_simplificado")).alias("inicio"), tx.four_decimals(size).alias("milhares"))


def q17_embed(spark: SparkSession, d: str) -> DataFrame:
    """The places and values of each vector that are not zero."""
    c = spread(_chunks(spark, d).select("chunk_id", "document"))
    e = c.select("chunk_id", F.posexplode(models.embed(F.col("document"))).alias("lugar", "x")).where("x <> 0")
    return e.select("chunk_id", "lugar", F.round(F.col("x").cast("double"), 6).alias("valor"))


def q18_fold(spark: SparkSession, d: str) -> DataFrame:
    names = _bulas(spark, d).where("nome_comercial is not null").select("nome_comercial").distinct()
    return names.select("nome_comercial", tx.fold(F.lower("nome_comercial")).alias("dobrado"))


def q21_append(spark: SparkSession, d: str) -> DataFrame:
    b = _bulas(spark, d)
    name = F.concat(F.col("bula_id").cast("string"), F.lit("_original_limpo.txt"))
    headers = b.select(name.alias("name"), F.concat(_header(("nome", F.col("nome"))), F.lit("\n\n<text>\nvelho\n</text>\n")).alias("value"))
    bodies = b.where("conteudo_original is not null").select(name.alias("name"), F.col("conteudo_original").alias("value"))
    done, missing = prep.append_texts(headers, bodies)
    return done.select("name", F.md5("value").alias("md5")).unionByName(missing.select("name", F.lit(None).cast("string").alias("md5")))


def q22_brand(spark: SparkSession, d: str) -> DataFrame:
    b = _bulas(spark, d).where("id is not null")
    texts = b.select("id", "bula_id", F.concat_ws("\n", "nome_comercial", "conteudo_original").alias("texto"))
    return prep.brands(texts, _drugs(spark, d), "id", "texto", "bula_id")


def q23_tag_replace(spark: SparkSession, d: str) -> DataFrame:
    b = _bulas(spark, d)
    header = _header(("nome_comercial", F.lit("NA")), ("doenca", F.col("doenca")), ("nome_comercial", F.lit("outro")))
    headers = b.select("bula_id", "id", header.alias("value"))
    got = prep.apply_brands(headers, _drugs(spark, d).select("id", F.upper("nome").alias("marca")))
    return got.select("bula_id", F.md5("value").alias("md5"), "mudou")


def q24_rename(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "drug_map").where("id is not null")
    out = None
    for cfg in CORPUS_TYPES:
        originals = m.where(F.col("tipo") == cfg.original_dir.split("/")[1]).select("linha", F.concat("id", F.lit(cfg.original_suffix)).alias("name"), F.lit("").alias("value"))
        one = originals.select("linha", parse.renamed(F.col("name"), cfg).alias("nome_novo"), parse.number_of_file(F.col("name")).alias("numero"))
        out = one if out is None else out.unionByName(one)
    return out


def q25_response(spark: SparkSession, d: str) -> DataFrame:
    """Answers as they go over the wire, read back."""
    items = F.transform("ids", lambda x, i: F.struct(
        (i + 1).alias("posicao"), x.alias("id_chunk"), F.get("distances", i).alias("distancia"), (1 - F.get("distances", i)).alias("score"), F.get("rerank_scores", i).alias("rerank_score")
    ))
    a = _answers(spark, d).where("size(ids) > 0").select("resp_id", F.inline(items))
    read = F.from_json("resposta", "ids array<string>, distances array<double>, scores array<double>, rerank_scores array<double>")
    r = search.answers_json(a.withColumn("rerank_score", F.when(~F.isnan("rerank_score"), F.col("rerank_score"))), "resp_id").select("resp_id", read.alias("r"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(F.floor(x * 1e6), F.lit(0)))
    return r.select(
        "resp_id", F.array_join("r.ids", ",").alias("ids"), F.size("r.ids").alias("n"), total(F.col("r.scores")).alias("soma"),
        F.size("r.rerank_scores").alias("reavaliados"), total(F.col("r.rerank_scores")).alias("soma_rerank"),
    )


def q26_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries in two parts, the second over the first, read back as stored."""
    b = table(spark, d, "bulas").select("bula_id", "id", "fabricante", "carregado_em")
    second = F.pmod(F.xxhash64("bula_id", "carregado_em"), F.lit(2)) == 1  # deliveries of one leaflet are in either part
    path = keep(spark, f"{shared_dir(spark)}/leafsift-bulas-{uuid.uuid4().hex}")
    for part in (b.where(~second), b.where(second)):
        files.upsert(spark, path, part, "bula_id", "carregado_em")
    return files.read_table(spark, path).select("bula_id", "id", "fabricante", F.unix_micros("carregado_em").alias("carregado"))


def q27_arrivals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("criado_em is not null")
    return indexing.arrivals(docs, "criado_em").select(F.unix_micros("janela.start").alias("dia"), "linhas")


def q28_index_twice(spark: SparkSession, d: str) -> DataFrame:
    """Chunks stored by the incremental indexing of the leaflets, run twice."""
    b = _bulas(spark, d).where("id is not null").withColumn("id", F.concat_ws("_", "id", "bula_id"))
    b = b.select("id", "nome", "tipo", "conteudo_original", "conteudo_simplificado", "fabricante")
    root = keep(spark, f"{shared_dir(spark)}/leafsift-indice-{uuid.uuid4().hex}")
    for _ in range(2):
        index.index_leaflets(spark, b, f"{root}/chunks", f"{root}/documents", postings_path=f"{root}/postings")
    c = spark.read.parquet(f"{root}/chunks")
    return c.groupBy("id", "registro").agg(F.count("*").cast("int").alias("n"), F.count_distinct("chunk_id").cast("int").alias("distintos"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}
