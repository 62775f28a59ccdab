"""SQL for the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A[{_WS}\x1c-\x1f]+|[{_WS}\x1c-\x1f]+\z', '', 'g')"


_BORDA = """
WITH a AS (SELECT DISTINCT ON (resp_id) * FROM api WHERE len(scores) > 0 AND len(rerank_scores) > 0 ORDER BY resp_id, recebido_em DESC),
x AS (SELECT resp_id, len(ids) AS n, unnest(ids) AS id, unnest(scores) AS s, unnest(rerank_scores) AS r, generate_subscripts(ids, 1) AS i FROM a),
v AS (SELECT resp_id, n, id, i, CASE WHEN NOT isnan(s) THEN s END AS s, CASE WHEN NOT isnan(r) THEN r END AS r FROM x),
p AS (SELECT resp_id, id, i,
  CASE WHEN s IS NULL THEN 0 ELSE n - rank() OVER (PARTITION BY resp_id ORDER BY s DESC NULLS LAST) - (count(*) OVER (PARTITION BY resp_id, s) - 1) / 2.0 END
  + CASE WHEN r IS NULL THEN 0 ELSE n - rank() OVER (PARTITION BY resp_id ORDER BY r DESC NULLS LAST) - (count(*) OVER (PARTITION BY resp_id, r) - 1) / 2.0 END AS pontos FROM v),
o AS (SELECT resp_id, id, CAST(pontos AS DOUBLE) AS pontos, CAST(row_number() OVER (PARTITION BY resp_id ORDER BY pontos DESC, id NULLS LAST, i) AS INT) AS posicao FROM p)
"""

_SHINGLES = rf"""
WITH b AS (SELECT DISTINCT bula_id, conteudo_original AS t FROM bulas WHERE conteudo_original IS NOT NULL AND {_strip('conteudo_original')} NOT IN ('', 'NA')),
w AS (SELECT bula_id, regexp_extract_all(strip_accents(lower(nfc_normalize(t))), '[\p{{L}}\p{{N}}]+') AS w FROM b),
s AS (SELECT DISTINCT bula_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT bula_id, count(*) AS n FROM s GROUP BY bula_id),
c AS (SELECT x.bula_id AS a, y.bula_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.bula_id < y.bula_id GROUP BY ALL)
SELECT c.a AS bula_id_a, c.b AS bula_id_b FROM c JOIN n na ON na.bula_id = c.a JOIN n nb ON nb.bula_id = c.b WHERE c.c > 0.5 * (na.n + nb.n - c.c)
"""

_CUTS = rf"""
WITH f AS (SELECT bula_id, 'conteudo_original' AS campo, {_strip('conteudo_original')} AS t FROM bulas UNION ALL
           SELECT bula_id, 'conteudo_simplificado', {_strip('conteudo_simplificado')} FROM bulas),
k AS (SELECT DISTINCT bula_id, campo, list_max(list_transform(string_split(
        regexp_replace(regexp_replace(t, '([.!?;])[{_WS}\x1c-\x1f]+', '\1' || chr(1), 'g'), '[\r\n]', chr(1), 'g'), chr(1)), lambda s: length(s))) AS most
      FROM f WHERE length(t) > 1200)
SELECT bula_id, campo, CASE WHEN bool_or(most > 1200) THEN 'forcado' ELSE 'natural' END AS corte FROM k GROUP BY bula_id, campo
"""

ORACLE: dict[str, str] = {
    "p1_found": _BORDA + "SELECT resp_id, id FROM o WHERE posicao = 1",
    "p1_order": _BORDA + "SELECT resp_id, id, round(pontos, 6) AS pontos, posicao FROM o",
    "p3_found": _CUTS,
    "p4_found": _SHINGLES,
}
