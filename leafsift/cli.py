"""Terminal search over an index on disk: python -m leafsift.cli INDEX QUERY [--n 5] [--rerank] ..."""

from __future__ import annotations

import argparse
import sys
import time

from leafsift.config import check_request
from leafsift.operators import search
from leafsift.session import build, staged
from leafsift.sources.files import exists


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Hybrid search of leaflets")
    p.add_argument("index", help="folder with documents and chunks")
    p.add_argument("query")
    p.add_argument("--n", type=int, default=1)
    p.add_argument("--min-score", type=float, default=0.4)
    p.add_argument("--rerank", action="store_true")
    p.add_argument("--simplified-only", action="store_true")
    p.add_argument("--min-score-rerank", type=float)
    p.add_argument("--json", action="store_true", help="the semantic answer as JSON")
    a = p.parse_args(args)
    spark = build()
    if not exists(spark, f"{a.index}/chunks"):
        print(f"no chunks in {a.index}", file=sys.stderr)
        return 1
    engine = search.Engine.open(spark, a.index)
    check_request(a.query, a.n, a.min_score, a.min_score_rerank)
    began = time.perf_counter()
    lex = staged(engine.lexical_lane(a.query, a.n), "lexica")
    middle = time.perf_counter()
    print(f"[tempo] busca lexica: {middle - began:.2f}s", file=sys.stderr)
    sem = staged(engine.semantic_lane(a.query, a.n, a.min_score, a.rerank, a.simplified_only, a.min_score_rerank), "semantica")
    print(f"[tempo] busca semantica{', reranker' if a.rerank else ''}: {time.perf_counter() - middle:.2f}s", file=sys.stderr)
    if a.json:
        print(search.answer_json(sem).first()["resposta"])
    else:
        for r in lex.orderBy("posicao").collect():
            print(f"{r['id']} | {r['nome']} | {', '.join(t['termo'] + ' [' + t['campo'] + ']' for t in r['termos_match'])}")
        for r in search.lines(sem).orderBy("posicao").collect():
            print(r["linha"])
    print(f"[tempo] total: {time.perf_counter() - began:.2f}s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
