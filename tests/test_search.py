import json

import pytest
from pyspark.sql import functions as F

from leafsift.operators import index, search, synonyms
from leafsift.operators.models import embed


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(
        [
            ("a_1", "alfa", "Tratamento da hipertensão arterial em adultos. Guarde o frasco longe do sol.", "Este remédio baixa a pressão alta. Guarde longe do sol."),
            ("a_2", "beta", "Indicado para cefaleia intensa e persistente.", "Serve para tirar a dor de cabeça forte. Tome com água."),
            ("a_3", "gama", None, "Serve para coceira na pele. Passe pouco na pele."),
        ],
        "id string, nome string, conteudo_original string, conteudo_simplificado string",
    )
    chunks = index.cut(docs).withColumn("embedding", embed(F.col("document"))).cache()
    return search.Engine(docs, chunks, synonyms.default_groups(spark))


def test_lexical_lane(engine):
    hits = engine.lexical_lane("frasco SOL", 5).collect()
    assert [h["id"] for h in hits] == ["a_1"]
    assert {(t["campo"], t["termo"]) for t in hits[0]["termos_match"]} >= {("conteudo_original", "frasco"), ("conteudo_simplificado", "sol")}
    assert hits[0]["trecho_match"]["campo"] == "conteudo_simplificado"


def test_semantic_lane(engine):
    got = engine.semantic_lane("cefaleia", 3, min_score=0.1).orderBy("posicao").collect()
    assert got[0]["id"] == "a_2" and got[0]["distancia"] == pytest.approx(1 - got[0]["score"])
    assert got[0]["simplificada"].startswith("Serve para tirar") and got[0]["original"].startswith("Indicado")
    only = engine.semantic_lane("dor de cabeça", 3, min_score=0.1, simplified_only=True).collect()
    assert only and all("_simp_" in r["id_chunk"] for r in only) and any(r["original"] for r in only)


def test_rerank_uses_its_own_threshold(engine):
    got = engine.semantic_lane("pressão alta", 3, min_score=0.99, rerank=True).orderBy("posicao").collect()
    assert got[0]["id"] == "a_1" and got[0]["rerank_score"] == 1.0
    assert engine.semantic_lane("pressão alta", 3, rerank=True, min_score_rerank=1.0).count() == 1


def test_answer(engine):
    lex, sem = engine.search("pele", 2, min_score=0.0)
    assert [r["id"] for r in lex.collect()] == ["a_3"]
    answer = json.loads(search.answer_json(sem).first()["resposta"])
    assert len(answer["ids"]) == 2 and answer["metadatas"][0]["id"] == "a_3" and answer["rerank_scores"] == []
    assert "score 0." in search.lines(sem).orderBy("posicao").first()["linha"]
    with pytest.raises(ValueError):
        engine.search("", 1)


def test_empty_index(spark, engine):
    e = search.Engine(engine.documents.limit(0), engine.chunks.limit(0), engine.groups)
    assert e.semantic_lane("x", 1).count() == 0 and e.lexical_lane("x", 1).count() == 0


def test_http(engine):
    from leafsift.server import answer

    assert answer(engine, "/health") == (200, {"status": "ok"})
    assert answer(engine, "/x")[0] == 404
    for bad in ("/buscar", "/buscar?q=a&n=0", "/buscar?q=a&n=x", "/buscar?q=a&min_score=2"):
        assert answer(engine, bad)[0] == 422
    status, body = answer(engine, "/buscar?q=cefaleia&n=2&min_score=0.1")
    assert status == 200 and body["sinonimos"] == ["dor de cabeça"]
    assert body["meili"][0]["id"] == "a_2" and body["chroma"]["metadatas"][0]["id"] == "a_2"
