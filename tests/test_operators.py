import numpy as np
import pytest
from pyspark.sql import functions as F

from leafsift.config import CORPUS_TYPES, Settings, check_request
from leafsift.operators import index, lexical, models, parse, prep, synonyms, vector
from leafsift.sources import files

HT, ONCO = CORPUS_TYPES


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_parse(spark):
    raw = "<metadata>\n<nome medicamento> x </nome medicamento>\n<fabricante></fabricante>\n<doenca>a</doenca><doenca>b</doenca></metadata>\n<text>\n corpo \n</text>"
    df = spark.createDataFrame([(raw, 1), ("sem marcas ", 2), (None, 3), ("", 4)], "value string, extra int")
    got = {r["extra"]: r for r in parse.parse_leaflets(df).collect()}
    assert got[1]["texto"] == "corpo" and got[1]["nome_medicamento"] == "x" and got[1]["fabricante"] == "NA" and got[1]["doenca"] == "b"
    assert got[2]["texto"] == "sem marcas" and got[2]["doenca"] == "NA"
    assert got[3]["texto"] is None and got[4]["texto"] == ""


def test_append_twice_changes_nothing(spark):
    h = spark.createDataFrame([("a", "<metadata>m</metadata>"), ("b", "x")], "name string, value string")
    t = spark.createDataFrame([("a", " corpo\n")], "name string, value string")
    once, missing = prep.append_texts(h, t)
    assert rows(once, "name", "value") == [("a", "<metadata>m</metadata>\n\n<text>\ncorpo\n</text>\n")]
    assert rows(missing, "name") == [("b",)]
    assert rows(prep.append_texts(once, t)[0], "value") == rows(once, "value")


def test_brand_replaces_first_tag_only(spark):
    df = spark.createDataFrame([("<nome_comercial>NA</nome_comercial>\n<nome_comercial>z</nome_comercial>",)], "t string")
    got = df.select(parse.with_brand(F.col("t"), F.lit("A$1\\b")).alias("x"), parse.with_brand(F.col("t"), F.lit(None).cast("string")).alias("y")).first()
    assert got["x"] == "<nome_comercial>A$1\\b</nome_comercial>\n<nome_comercial>z</nome_comercial>"
    assert got["y"] == "<nome_comercial>NA</nome_comercial>\n<nome_comercial>z</nome_comercial>"


def test_brands(spark):
    texts = spark.createDataFrame(
        [("1", "Beta® Alfa® Alfa™ Beta ®"), ("2", "Tamarine® MS® Anvisa®"), ("3", "xAbcd®"), ("4", None), ("5", "Aşkın®")], "id string, texto string"
    )
    drugs = spark.createDataFrame([("2", "Tamarine"), ("1", None)], "id string, nome string")
    assert rows(prep.brands(texts, drugs), "id", "marca") == [("1", "Beta"), ("3", "Abcd"), ("5", "Aşkın")]


def test_file_names(spark):
    df = spark.createDataFrame([("/x/14_original_limpo.txt",), ("/x/b.txt",)], "p string")
    got = df.select(parse.file_id(F.col("p"), "_original_limpo.txt").alias("i"), parse.number_of_file(F.col("p")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("14", 14), (None, None)]
    assert df.select(parse.renamed(F.lit("7_original_limpo.txt"), ONCO).alias("x")).first()["x"] == "7_simplificada_limpo.txt"


def test_corpus_of_files(spark, tmp_path):
    (tmp_path / ONCO.map_csv).write_text("id,nome\n7,velho\n7,sete \n8,oito\n,nada\n", encoding="utf-8")
    for folder, name, text in (
        (ONCO.original_dir, "7_original_limpo.txt", "<metadata><doenca>d</doenca></metadata><text>o</text>"),
        (ONCO.simplified_dir, "7_simplificada_limpo.txt", "<text>s</text>"),
        (ONCO.original_dir, "9_original_limpo.txt", "x"),
    ):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(text, encoding="utf-8")
    assert files.corpus(spark, str(tmp_path), HT) is None
    ready, missing = prep.indexable(*files.corpus(spark, str(tmp_path), ONCO), ONCO)
    assert rows(ready, "id", "nome", "conteudo_original", "conteudo_simplificado", "doenca") == [("oncologia_7", "sete ", "o", "s", "d")]
    assert rows(missing, "id") == [("oncologia_8",)]


def test_synonyms(spark):
    g = synonyms.default_groups(spark)
    q = spark.createDataFrame([("Cefaleia",), ("hipertensão arterial",), ("edematoso",), ("nausea",), (None,)], "q string")
    got = {r["q"]: (r["extras"], r["expandida"]) for r in synonyms.expand(q, g).collect()}
    assert got["Cefaleia"] == (["dor de cabeça"], "Cefaleia dor de cabeça")
    assert got["hipertensão arterial"] == (["pressão alta"], "hipertensão arterial pressão alta")
    assert got["edematoso"][0] == ["inchaço"]
    assert got["nausea"] == ([], "nausea") and None not in got
    assert synonyms.pairs(g).count() == 38


def test_lexical(spark):
    docs = spark.createDataFrame([(1, "Dor de cabeça forte", None), (2, "dor", "cabeça"), (3, "", "nada"), (4, None, None)], "k int, a string, b string")
    ix = lexical.postings(docs, "k", ["a", "b"])
    q = spark.createDataFrame([("dor de CABECA",), ("de a o",), ("ausente dor",)], "q string")
    assert rows(lexical.search_all(q, ix), "q", "key") == [("dor de CABECA", 1), ("dor de CABECA", 2)]
    syn = lexical.search_synonyms(spark.createDataFrame([("cefaleia",)], "q string"), docs, "k", ["a", "b"], synonyms.pairs(synonyms.default_groups(spark)))
    assert rows(syn, "q", "key") == [("cefaleia", 1)]


def test_phrases_by_runs_equal_phrases_in_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d", "b c", "c d a b", "", None, "abc"])], "k int, t string")
    p = spark.createDataFrame([("b c",), ("a",), ("c d a",), ("  ",)], "phrase string")
    few = rows(lexical.phrases_in(docs, "k", ["t"], p), "key", "phrase")
    monkeypatch.setattr(lexical, "FEW_PHRASES", 1)
    assert rows(lexical.phrases_in(docs, "k", ["t"], p), "key", "phrase") == few != []


def test_matches(spark):
    df = spark.createDataFrame([("É Dor, dor e náusea",), ("nada",), (None,)], "t string")
    got = lexical.matched_terms(df, ["t"], ["dor", "nausea"]).collect()
    assert [x["termo"] for x in got[0]["termos_match"]] == ["Dor", "náusea"]
    assert got[0]["trecho_match"]["texto"] == "É <mark>Dor</mark>, <mark>dor</mark> e <mark>náusea</mark>"
    assert got[1]["termos_match"] == [] and got[1]["trecho_match"] is None and got[2]["trecho_match"] is None
    p = df.select(lexical.positions(F.col("t"), ["dor"]).alias("p")).first()["p"]
    assert [(x["start"], x["length"]) for x in p] == [(3, 3), (8, 3)]


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).astype("float32")
    m[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "k long, embedding array<float>")
    got = vector.nearest(df.where("k % 100 = 0"), df, "k", "k", 10)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    for q in (0, 100, 200):
        want = np.argsort(-(unit.astype(float) @ unit[q]), kind="stable")[:10].tolist()
        assert [r["rid"] for r in got.where(F.col("qid") == q).orderBy("lugar").collect()] == want


def test_collapse_and_rerank(spark):
    pool = spark.createDataFrame(
        [(1, "a", 0.9, 1, 0.2), (1, "a", 0.8, 2, 0.2), (1, "b", 0.45, 3, 0.05), (1, "c", 0.1, 4, 0.9), (1, "d", float("nan"), 5, float("nan"))],
        "qid int, id string, score double, lugar int, rerank_score double",
    )
    assert rows(vector.collapse(pool, 5, 0.45), "id", "lugar") == [("a", 1), ("b", 3)]
    assert rows(vector.rerank(pool, 5), "posicao", "id", "lugar") == [(1, "c", 4), (2, "a", 1)]
    assert rows(vector.rerank(pool, 1), "id") == [("c",)]


def test_reconstruction_and_best_sentence(spark):
    c = spark.createDataFrame(
        [("x", "k10", "original", 10, "c"), ("x", "k2", None, 2, "b"), ("x", "k1", "original", 1, "a"), ("x", "k1", "original", 1, "a"), ("x", "s", "simplificada", 0, "s"), ("y", "z", "simplificada", None, None)],
        "id string, chunk_id string, registro string, chunk_idx int, document string",
    )
    got = {r["id"]: (r["original"], r["simplificada"]) for r in vector.both_registers(c).collect()}
    assert got == {"x": ("a\nb\nc", "s"), "y": (None, None)}
    t = spark.createDataFrame([("Primeira frase longa. Segunda frase com água.",), ("curta",), (None,)], "t string")
    b = [r["b"] for r in t.select(vector.best_sentence(F.col("t"), lambda s: vector.overlap_score(F.lit("água"), s)).alias("b")).collect()]
    assert b[0]["texto"] == "Segunda frase com água." and b[1] is None and b[2] is None


def test_indexing_twice_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a_1", "n", "t", "Linha um.\nLinha dois.", "s"), ("a_2", "n", "t", "", "s")], "id string, nome string, tipo string, conteudo_original string, conteudo_simplificado string")
    chunks, docs = str(tmp_path / "chunks"), str(tmp_path / "docs")
    assert index.index_leaflets(spark, df, chunks, docs) == 2
    assert index.index_leaflets(spark, df, chunks, docs) == 0
    got = spark.read.parquet(chunks)
    assert rows(got, "chunk_id") == [("a_1_orig_0",), ("a_1_simp_0",), ("a_2_orig_0",), ("a_2_simp_0",)]
    assert len(got.first()["embedding"]) == 64 and files.read_table(spark, docs).count() == 2


def test_stream(spark, tmp_path):
    from leafsift.streaming.indexing import arrivals, index_stream

    src = str(tmp_path / "in")
    schema = "id string, conteudo_original string, conteudo_simplificado string, at timestamp"
    spark.sql("select 'a_1' id, 'o' conteudo_original, 's' conteudo_simplificado, timestamp'2024-01-01' at").write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    index_stream(stream, str(tmp_path / "c"), str(tmp_path / "d"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    q = arrivals(stream, "at").writeStream.format("memory").queryName("arr").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arr").first()["linhas"] == 1


def test_chunk_ids(spark):
    df = spark.createDataFrame([("oncologia_7_orig_0",), ("foo",), ("oncologia_7_simp_12",)], "chunk_id string")
    assert rows(index.indexed_ids(df), "id") == [("oncologia_7",)]


def test_settings():
    s = Settings()
    assert [s.pool(n, 10000) for n in (1, 5, 50)] == [60, 100, 1000] and s.pool(5, 10) == 10
    for bad in (("", 1, 0.1, None), ("q", 0, 0.1, None), ("q", 51, 0.1, None), ("q", 1, 1.1, None), ("q", 1, 0.1, -1)):
        with pytest.raises(ValueError):
            check_request(*bad)


def _layout(root):
    """A small corpus as files: 7 has all, 9 lacks its simplified text, 8 is only in the map."""
    (root / ONCO.map_csv).write_text("id,nome\n7,sete\n8,oito\n9,nove\n", encoding="utf-8")
    tagged = "<metadata>\n<nome_comercial>NA</nome_comercial>\n<doenca>d</doenca>\n</metadata>\n"
    for folder, names in (
        (ONCO.original_dir, ("7_original_limpo.txt", "9_original_limpo.txt")), (ONCO.simplified_dir, ("7_simplificada_limpo.txt",)),
        (ONCO.original_texts, ("7_original_limpo.txt", "9_original_limpo.txt")), (ONCO.simplified_texts, ("7_simplificada_limpo.txt",)),
    ):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for n in names:
            text = tagged if "metadata" in folder else f" Use Ixium® hoje. {n[0]}\n" if n[0] == "7" else "Nove® não é marca.\n"
            (root / folder / n).write_text(text, encoding="utf-8")


def test_jobs(spark, tmp_path):
    from leafsift.operators.search import Engine
    from leafsift.plans import jobs

    _layout(tmp_path)
    root = str(tmp_path)
    (tmp_path / ONCO.simplified_dir / "5_simplificada_limpo.txt").write_text("sem texto", encoding="utf-8")
    made = {r["grupo"]: (r["feitos"], r["faltam"]) for r in jobs.append_texts(spark, root).collect()}
    assert made[ONCO.original_dir] == (2, []) and made[ONCO.simplified_dir] == (1, ["5_simplificada_limpo.txt"]) and made[HT.original_dir] == (0, [])
    file = tmp_path / ONCO.original_dir / "7_original_limpo.txt"
    once = file.read_text(encoding="utf-8")
    assert once.endswith("</metadata>\n\n<text>\nUse Ixium® hoje. 7\n</text>\n")
    jobs.append_texts(spark, root)
    assert file.read_text(encoding="utf-8") == once
    assert rows(jobs.apply_brands(spark, root), "grupo", "feitos") == [("oncologia", 1)]
    for f in (file, tmp_path / ONCO.simplified_dir / "7_simplificada_limpo.txt"):
        assert "<nome_comercial>Ixium</nome_comercial>" in f.read_text(encoding="utf-8")
    ix = str(tmp_path / "ix")
    assert Engine.open(spark, ix).lexical_lane("hoje", 2).count() == 0
    assert jobs.index_corpora(spark, root, ix) == (1, ["oncologia_8", "oncologia_9"])
    assert jobs.index_corpora(spark, root, ix)[0] == 0
    e = Engine.open(spark, ix)
    assert [r["id"] for r in e.lexical_lane("hoje", 2).collect()] == ["oncologia_7"]
    assert e.semantic_lane("Use Ixium", 1, 0.1).first()["metadata"]["nome_comercial"] == "Ixium"
    copied = {r["grupo"]: r["feitos"] for r in jobs.copy_headers(spark, root).collect()}
    assert copied[ONCO.simplified_dir] == 2
    assert (tmp_path / ONCO.simplified_dir / "9_simplificada_limpo.txt").exists() and not list(tmp_path.rglob(".*_limpo*"))


def test_upsert_keeps_the_old_state_until_the_new_one_stands(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    make = lambda rs: spark.createDataFrame(rs, "k long, v string, at int")
    files.upsert(spark, path, make([(i, "a", 1) for i in range(50)]), "k", "at", buckets=8)
    before = {p.name for p in (tmp_path / "t").iterdir()}
    files.upsert(spark, path, make([(3, "b", 2), (4, "alt", 0), (99, "neu", 1)]), "k", "at")
    got = {r["k"]: r["v"] for r in files.read_table(spark, path).collect()}
    assert len(got) == 51 and got[3] == "b" and got[4] == "a" and got[99] == "neu"
    assert len(before & {p.name for p in (tmp_path / "t").iterdir()}) == 1  # untouched buckets stay where they are
    monkeypatch.setattr(files, "latest_by", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        files.upsert(spark, path, make([(3, "c", 3)]), "k", "at")
    assert {r["k"]: r["v"] for r in files.read_table(spark, path).collect()} == got
    assert files.read_table(spark, str(tmp_path / "none")) is None


def test_lane_with_synonyms(spark):
    docs = spark.createDataFrame(
        [(1, "sinto falta de ar", None), (2, "falta ar de", "x"), (3, None, "dispneia forte"), (4, "falta de", "ar"), (5, None, None)], "k int, a string, b string"
    )
    ix = lexical.postings(docs, "k", ["a", "b"], positions=True)
    q = spark.createDataFrame([("Dispneia",), ("falta de ar",), ("dispneia forte",), ("de o",), (None,)], "q string")
    got = rows(lexical.search_lane(q, ix, synonyms.default_groups(spark)), "q", "key")
    assert got == [("Dispneia", 1), ("Dispneia", 3), ("dispneia forte", 3), ("falta de ar", 1), ("falta de ar", 2), ("falta de ar", 3), ("falta de ar", 4)]


def test_crop_around_several_words(spark):
    text = " ".join(f"p{i}" for i in range(60)) + " (falta de ar) " + " ".join(f"r{i}" for i in range(60))
    got = spark.createDataFrame([(text,)], "t string").select(lexical.crop(F.col("t"), ["falta de ar"], 10).alias("x")).first()["x"]
    assert got == "p55 p56 p57 p58 p59 (falta de ar) r0 r1"


def test_best_sentences(spark):
    df = spark.createDataFrame([(["a b c", "água com gás"],), ([],), (None,)], "s array<string>")
    vec = models.HashingEmbedder().encode(["gás"])[0].tolist()
    got = df.select(models.nearest_sentence(F.col("s"), vec).alias("x"), models.best_sentence_reranked(F.col("s"), "gás").alias("y")).collect()
    assert got[0]["x"]["texto"] == got[0]["y"]["texto"] == "água com gás" and got[0]["y"]["score"] == 1.0 and got[1]["x"] is None and got[2]["y"] is None


def test_models_of_one_scope_are_not_mixed(spark):
    df = spark.createDataFrame([("a b",)], "t string").repartition(1)
    for n in (4, 8):
        assert len(df.select(models.embed(F.col("t"), lambda n=n: models.HashingEmbedder(n)).alias("v")).first()["v"]) == n
        assert len(df.select(models.embed(F.col("t"), models.Maker("h", models.HashingEmbedder, n)).alias("v")).first()["v"]) == n


def test_nearest_of_null_and_short_vectors(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [1.0, 1.0])], "k long, embedding array<float>")
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 1)
    monkeypatch.setattr(vector, "FEW_BLOCKS", 2)  # several rounds
    got = vector.nearest(df, df, "k", "k", 2)
    assert rows(got.where("lugar = 1"), "qid", "rid", "score") == [(1, 1, 1.0), (2, 1, 0.0), (3, 1, 0.0), (4, 4, 1.0), (5, 5, 1.0)]


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from leafsift import session

    bare = SimpleNamespace(get=lambda k, d=None: d)
    sc = SimpleNamespace(getConf=lambda: bare, getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(sparkContext=sc, conf=bare))


def test_embedder_is_stable():
    e = models.HashingEmbedder()
    assert np.allclose(e.encode(["a b"]), e.encode(["a b"])) and not e.encode([""]).any()


def test_queries_run_their_operators(spark, tmp_path, monkeypatch):
    from leafsift.plans import queries
    from leafsift.sources import files
    from leafsift.streaming import indexing

    called = []
    for module, name in ((files, "upsert"), (indexing, "arrivals")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: (called.append(_n), _f(*a, **k))[1])
    spark.sql("""SELECT * FROM VALUES (1L, 'a', 'x', timestamp'2024-01-01'), (1L, 'a', 'y', timestamp'2024-01-03'), (1L, 'a', 'z', timestamp'2024-01-02'),
        (2L, 'b', 'u', timestamp'2024-01-01') AS t(bula_id, id, fabricante, carregado_em)""").write.parquet(f"{tmp_path}/bulas.parquet")
    spark.sql("SELECT 1L AS doc_id, timestamp'2024-01-01 10:00:00' AS criado_em UNION ALL SELECT 2L, null").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["bula_id"], r["fabricante"]) for r in queries.q26_upsert(spark, str(tmp_path)).collect())
    assert got == [(1, "y"), (2, "u")] and called == ["upsert", "upsert"]
    assert [r["linhas"] for r in queries.q27_arrivals(spark, str(tmp_path)).collect()] == [1] and called[2:] == ["arrivals"]
