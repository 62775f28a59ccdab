"""A thin HTTP face of the engine: GET /health, and GET /buscar with q, n, min_score and the like."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from leafsift.operators import search, synonyms

YES = ("1", "true", "sim", "yes", "on")


# The keys of an answer, one for each lane, and one for the synonyms.
LEXICAL, SYNONYMS, SEMANTIC = "meili", "sinonimos", "chroma"


def answer(engine: search.Engine, path: str) -> tuple[int, dict]:
    """(status, body) of a request: 422 for parameters out of range, 503 where the engine fails."""
    url = urlsplit(path)
    if url.path == "/health":
        return 200, {"status": "ok"}
    if url.path != "/buscar":
        return 404, {"detail": "not found"}
    given = {k: v[-1] for k, v in parse_qs(url.query).items()}
    try:
        q, n = given.get("q", ""), int(given.get("n", 5))
        least = float(given.get("min_score", 0.4))
        least_rerank = float(given["min_score_rerank"]) if "min_score_rerank" in given else None
        search.check_request(q, n, least, least_rerank)
    except ValueError as e:
        return 422, {"detail": str(e)}
    flags = [given.get(k, "").lower() in YES for k in ("rerank", "somente_simplificada")]
    try:
        lex, sem = engine.search(q, n, least, *flags, least_rerank)
        spark = sem.sparkSession
        extras = synonyms.query_synonyms(spark.createDataFrame([(q,)], "q string"), engine.groups).first()["extras"]
        hits = [json.loads(x) for x in lex.orderBy("posicao").toJSON().collect()]  # at most n
        return 200, {LEXICAL: hits, SYNONYMS: extras, SEMANTIC: json.loads(search.answer_json(sem).first()["resposta"])}
    except Exception as e:  # noqa: BLE001 - whatever fails inside is the engine being unavailable
        return 503, {"detail": str(e)[:500]}


def serve(engine: search.Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for ``engine``; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, body = answer(engine, self.path)
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Methods", "GET")
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
