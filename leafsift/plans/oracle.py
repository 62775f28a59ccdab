"""The same results in SQL, for comparison on the same tables."""

from __future__ import annotations

from leafsift.functions.text import ACCENTED, PLAIN

WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STOP = "'de','da','do','das','dos','e','a','o','as','os','para','por','em','no','na','nos','nas','com','sem','um','uma','uns','umas','ao','aos'"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A[{WS}\x1c-\x1f]+|[{WS}\x1c-\x1f]+\z', '', 'g')"


def fold(c: str) -> str:
    return rf"regexp_replace(translate({c}, '{ACCENTED}', '{PLAIN}'), '\p{{Mn}}', '', 'g')"


def words(c: str) -> str:
    return rf"coalesce(regexp_extract_all({fold(f'lower({c})')}, '[\p{{L}}\p{{N}}]+'), [])"


def sents(c: str) -> str:
    cut = rf"regexp_replace(regexp_replace({c}, '([.!?;])[{WS}]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {strip('s')}), lambda s: length(s) > 15)"


def filled(c: str) -> str:
    return f"({c} IS NOT NULL AND {strip(c)} NOT IN ('', 'NA'))"


B = "b AS (SELECT DISTINCT ON (bula_id) * FROM bulas ORDER BY bula_id, carregado_em DESC NULLS LAST)"
M = "m AS (SELECT tipo || '_' || id AS id, arg_max(nome, linha) AS nome, min(linha) AS primeira FROM drug_map WHERE id IS NOT NULL AND id <> '' GROUP BY tipo, id)"
C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id)"
A = "a AS (SELECT DISTINCT ON (resp_id) * FROM api ORDER BY resp_id, recebido_em DESC NULLS LAST)"


def na(c: str) -> str:
    return f"coalesce(nullif({strip(c)}, ''), 'NA')"


def units(c: str) -> str:
    lines = f"list_filter(list_transform(string_split({c}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"
    cut = rf"string_split(regexp_replace(u, '([.!?;])[{WS}]+', '\1' || chr(1), 'g'), chr(1))"
    parts = f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"
    return f"flatten(list_transform({lines}, lambda u: CASE WHEN length(u) > 600 THEN {parts} ELSE [u] END))"


KNN = """
pool AS (SELECT * FROM (SELECT q.{k} AS qid, r.{k} AS rid, r.doc AS id,
    round(CASE WHEN q.nul OR r.nul THEN 0 ELSE list_cosine_similarity(q.v, r.v) END, 9) AS score FROM r q CROSS JOIN r WHERE q.asked)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) <= (SELECT least(100, count(*)) FROM r)),
best AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY score DESC, rid) = 1)
SELECT qid, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS INT) AS posicao
FROM best WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) <= 5
"""

# Words by the hashing embedder: a place and a sign each.
HASHED = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS k, CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END AS x"
QUESTION = "o paciente deve tomar com água"


def tokens(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"


def lane(queries: str, limit: int) -> str:
    """The lexical lane for the queries (q) of a subquery."""
    run = lambda c: f"' ' || array_to_string({words(c)}, ' ') || ' '"
    return f"""WITH {B}, ql AS (SELECT DISTINCT q, {run('q')} AS qr FROM ({queries})),
      w AS (SELECT bula_id, list_filter(list_concat(list_concat({words('nome')}, {words('conteudo_original')}), {words('conteudo_simplificado')}), lambda x: x NOT IN ({STOP})) AS ws,
        {run("coalesce(nome, '')")} || '|' || {run("coalesce(conteudo_original, '')")} || '|' || {run("coalesce(conteudo_simplificado, '')")} AS t FROM b),
      e AS (SELECT bula_id, len(ws) AS n, unnest(ws) AS t FROM w), p AS (SELECT t, bula_id, n, count(*) AS tf FROM e GROUP BY ALL),
      z AS (SELECT count(*) AS docs, avg(n) AS av FROM (SELECT DISTINCT bula_id, n FROM p)), f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
      u AS (SELECT q, qr, w FROM (SELECT q, qr, unnest(list_distinct(string_split(trim(qr), ' '))) AS w FROM ql) WHERE w NOT IN ({STOP})),
      s AS (SELECT a.group_id, {run('a.term')} AS r FROM synonyms a), pr AS (SELECT DISTINCT a.r AS r, c.r AS o FROM s a JOIN s c USING (group_id) WHERE a.r <> c.r),
      alt AS (SELECT q, w, w AS run FROM u UNION SELECT q, w, trim(o) FROM u JOIN pr ON contains(qr, r) AND contains(r, ' ' || w || ' ')),
      rt AS (SELECT run, unnest(string_split(run, ' ')) AS t FROM (SELECT DISTINCT run FROM alt)),
      sc AS (SELECT run, bula_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / av))) AS s
        FROM (SELECT * FROM rt WHERE t NOT IN ({STOP})) JOIN p USING (t) JOIN f USING (t) CROSS JOIN z GROUP BY run, bula_id),
      held AS (SELECT run, bula_id, s FROM sc JOIN w USING (bula_id) WHERE contains(w.t, ' ' || run || ' ')),
      best AS (SELECT q, w, bula_id, max(s) AS s FROM alt JOIN held USING (run) GROUP BY ALL),
      need AS (SELECT q, count(*) AS need FROM u GROUP BY q),
      o AS (SELECT q, bula_id, round(sum(s), 6) AS score, count(*) AS have FROM best GROUP BY q, bula_id)
      SELECT q, bula_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, bula_id) AS INT) AS posicao
      FROM o JOIN need USING (q) WHERE have = need QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, bula_id) <= {limit}"""


ORACLE: dict[str, str] = {
    "q07c_lane": f"SELECT bula_id, score, posicao FROM ({lane(chr(83) + "ELECT 'Dor de CABEÇA com água' AS q", 50)})",
    "q07d_lane_all": lane("SELECT term AS q FROM synonyms", 10),
    "q01_map_lastwins": f"WITH {M} SELECT id, nome, primeira FROM m",
    "q02_tag_extract": f"WITH {B} SELECT bula_id, {na('doenca')} AS doenca, {na('nome_medicamento')} AS nome_medicamento, "
    f"{na('nome_comercial')} AS nome_comercial, {na('fabricante')} AS fabricante, 'NA' AS apresentacao, "
    f"md5({strip(chr(99) + 'oalesce(conteudo_original, ' + chr(39) * 2 + ')')}) AS texto_md5 FROM b",
    "q03_inner_pair": f"WITH {B}, {M}, f AS (SELECT DISTINCT ON (id) * FROM b WHERE id IS NOT NULL ORDER BY id, bula_id) SELECT m.id, m.nome, split_part(m.id, '_', 1) AS tipo, "
    f"{na('fabricante')} AS fabricante, md5({strip('conteudo_original')}) AS original, md5({strip('conteudo_simplificado')}) AS simplificado "
    f"FROM m JOIN f ON m.id = f.id WHERE {filled('conteudo_original')} AND {filled('conteudo_simplificado')}",
    "q04_anti_new": rf"WITH {B} SELECT bula_id, id || '_' || bula_id AS id FROM b WHERE id IS NOT NULL AND id || '_' || bula_id NOT IN "
    r"(SELECT regexp_replace(chunk_id, '_(orig|simp)_\d+$', '') FROM chunks WHERE regexp_matches(chunk_id, '_(orig|simp)_\d+$'))",
    "q05_chunk": f"""WITH {B}, t AS (SELECT bula_id, 'original' AS registro, conteudo_original AS t FROM b UNION ALL
      SELECT bula_id, 'simplificada', conteudo_simplificado FROM b),
      k AS (SELECT bula_id, registro, t, {units('t')} AS us FROM t WHERE t IS NOT NULL),
      p AS (SELECT bula_id, registro, t, list_reduce(us, lambda acc, x: CASE
          WHEN acc.now = '' THEN struct_pack(done := acc.done, now := x)
          WHEN length(acc.now) + length(x) + 1 > 600 THEN struct_pack(done := list_append(acc.done, acc.now), now := x)
          ELSE struct_pack(done := acc.done, now := acc.now || chr(10) || x) END,
          struct_pack(done := []::VARCHAR[], now := '')) AS f FROM k),
      c AS (SELECT bula_id, registro, CASE WHEN f.now IS NULL OR f.now = '' THEN [{strip('t')}] ELSE list_append(f.done, f.now) END AS c FROM p)
      SELECT bula_id, registro, CAST(len(c) AS INT) AS n, md5(array_to_string(c, chr(1))) AS md5 FROM c""",
    "q06_sentences": f"WITH s AS (SELECT doc_id, {sents('text')} AS s FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, CAST(len(s) AS INT) AS n, md5(array_to_string(s, chr(1))) AS md5 FROM s",
    "q07_lex_all": f"""WITH {B}, w AS (SELECT bula_id, list_filter(list_concat(list_concat({words('nome')}, {words('conteudo_original')}), {words('conteudo_simplificado')}),
        lambda x: x NOT IN ({STOP})) AS ws FROM b),
      e AS (SELECT bula_id, len(ws) AS n, unnest(ws) AS t FROM w), p AS (SELECT t, bula_id, n, count(*) AS tf FROM e GROUP BY ALL),
      z AS (SELECT count(*) AS docs, avg(n) AS av FROM (SELECT DISTINCT bula_id, n FROM p)), f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
      q AS (SELECT DISTINCT q, t FROM (SELECT term AS q, unnest({words('term')}) AS t FROM synonyms) WHERE t NOT IN ({STOP})),
      need AS (SELECT q, count(*) AS need FROM q GROUP BY q),
      s AS (SELECT q, bula_id, count(*) AS have, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / av))), 6) AS score
        FROM q JOIN p USING (t) JOIN f USING (t) CROSS JOIN z GROUP BY q, bula_id)
      SELECT q, bula_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, bula_id) AS INT) AS posicao
      FROM s JOIN need USING (q) WHERE have = need QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, bula_id) <= 10""",
    "q07b_synonyms": f"""WITH {B}, f AS (SELECT bula_id, unnest([nome, conteudo_original, conteudo_simplificado]) AS t FROM b),
      w AS (SELECT bula_id, ' ' || array_to_string({words('t')}, ' ') || ' ' AS w FROM f WHERE t IS NOT NULL),
      alt AS (SELECT DISTINCT a.term AS q, c.term AS phrase FROM synonyms a JOIN synonyms c USING (group_id)
        UNION SELECT term, term FROM synonyms),
      ph AS (SELECT q, ' ' || array_to_string({words('phrase')}, ' ') || ' ' AS ph FROM alt)
      SELECT DISTINCT q, bula_id FROM ph JOIN w ON contains(w.w, ph.ph)""",
    "q08_positions": rf"""WITH h AS (SELECT doc_id, text, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
      k AS (SELECT doc_id, text, '(?i)\b(b[oóòôõö][cç][aáàâãä]|s[eéèêë][cç][aáàâãä])\b' AS p FROM h WHERE list_contains(w, 'boca') AND list_contains(w, 'seca')),
      x AS (SELECT *, regexp_extract_all(text, p) AS m, string_split_regex(text, p)[1] AS pre, string_split_regex(text, '[{WS}]+') AS ws FROM k),
      y AS (SELECT *, list_transform(m, lambda v: lower(v)) AS l, len(string_split_regex(pre, '[{WS}]+')) AS first FROM x WHERE len(m) > 0),
      c AS (SELECT *, array_to_string(list_slice(ws, greatest(least(first - 15, len(ws) - 29), 1), greatest(least(first - 15, len(ws) - 29), 1) + 29), ' ') AS crop FROM y)
      SELECT doc_id, CAST(len(m) AS INT) AS n, CAST(strlen(pre) AS INT) AS inicio, CAST(strlen(m[1]) AS INT) AS tamanho,
        md5(regexp_replace(text, p, '<mark>\1</mark>', 'g')) AS destaque,
        array_to_string(list_transform(list_filter(range(1, len(m) + 1), lambda i: list_position(l, l[i]) = i), lambda i: m[i]), '|') AS termos,
        md5(regexp_replace(crop, p, '<mark>\1</mark>', 'g')) AS trecho FROM c""",
    "q09_synonyms": """WITH q AS (SELECT DISTINCT q FROM api WHERE q IS NOT NULL),
      h AS (SELECT DISTINCT q, group_id FROM q JOIN synonyms ON contains(lower(q), term)),
      e AS (SELECT q, string_agg(term, '|' ORDER BY group_id, pos) AS x, string_agg(term, ' ' ORDER BY group_id, pos) AS y
        FROM h JOIN synonyms USING (group_id) WHERE NOT contains(lower(q), term) GROUP BY q)
      SELECT q.q, coalesce(x, '') AS extras, CASE WHEN y IS NULL THEN q.q ELSE q.q || ' ' || y END AS expandida FROM q LEFT JOIN e ON q.q = e.q""",
    "q09b_pairs": "SELECT a.term, c.term AS equivalent FROM synonyms a JOIN synonyms c USING (group_id) WHERE a.term <> c.term",
    "q10_knn_collapse": "WITH r AS (SELECT vec_id, label AS doc, embedding::DOUBLE[] AS v, vec_id % 100 = 0 AS asked, list_sum(list_transform(embedding, lambda x: x * x)) = 0 AS nul FROM embeddings),"
    + KNN.replace("{k}", "vec_id"),
    "q11_knn_filtered": f"WITH {C}, r AS (SELECT chunk_id, id AS doc, embedding::DOUBLE[] AS v, bula_id % 100 = 0 AS asked, list_sum(list_transform(embedding, lambda x: x * x)) = 0 AS nul "
    "FROM c WHERE registro = 'simplificada' AND id IS NOT NULL AND len(embedding) > 0)," + KNN.replace("{k}", "chunk_id"),
    "q12_best_sentence": f"""WITH {C}, s AS (SELECT chunk_id, unnest({sents('document')}) AS texto, generate_subscripts({sents('document')}, 1) AS i FROM c WHERE document IS NOT NULL),
      v AS (SELECT chunk_id, i, k, sum(x) AS x FROM (SELECT chunk_id, i, {HASHED} FROM (SELECT chunk_id, i, unnest({tokens('texto')}) AS w FROM s)) GROUP BY ALL),
      q AS (SELECT k, sum(x) AS x FROM (SELECT {HASHED} FROM (SELECT unnest({tokens(f"'{QUESTION}'")}) AS w)) GROUP BY k),
      n AS (SELECT chunk_id, i, sum(v.x * v.x) AS nn, coalesce(sum(v.x * q.x), 0) AS dot FROM v LEFT JOIN q USING (k) GROUP BY chunk_id, i),
      r AS (SELECT s.*, coalesce(round(CASE WHEN nn > 0 THEN dot / (sqrt(nn) * sqrt((SELECT sum(x * x) FROM q))) END, 9), 0) AS score FROM s LEFT JOIN n USING (chunk_id, i))
      SELECT chunk_id, texto, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, i) = 1""",
    "q12b_sentence_reranked": f"""WITH {C}, s AS (SELECT chunk_id, unnest({sents('document')}) AS texto, generate_subscripts({sents('document')}, 1) AS i FROM c WHERE document IS NOT NULL),
      k AS (SELECT *, len(list_intersect(list_distinct({tokens(f"'{QUESTION}'")}), {tokens('texto')})) / 6.0 AS score FROM s)
      SELECT chunk_id, texto, CAST(round(score, 6) AS DOUBLE) AS score FROM k QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, i) = 1""",
    "q13b_rerank_model": f"WITH {C} SELECT chunk_id, CAST(round(len(list_intersect(list_distinct({tokens(f"'{QUESTION}'")}), {tokens('coalesce(document, chr(32))')})) / 6.0, 6) AS DOUBLE) AS rerank_score FROM c",
    "q13_rerank": f"""WITH {A}, x AS (SELECT resp_id, unnest(ids) AS id, unnest(distances) AS dist, unnest(rerank_scores) AS rs, generate_subscripts(ids, 1) AS i
        FROM a WHERE len(rerank_scores) > 0 AND len(ids) > 0),
      p AS (SELECT *, row_number() OVER (PARTITION BY resp_id ORDER BY dist, i) AS lugar FROM x),
      k AS (SELECT * FROM p WHERE lugar <= 30 AND rs IS NOT NULL AND NOT isnan(rs) QUALIFY row_number() OVER (PARTITION BY resp_id, id ORDER BY rs DESC, lugar) = 1)
      SELECT resp_id, id, rs AS rerank_score, CAST(row_number() OVER (PARTITION BY resp_id ORDER BY rs DESC, lugar) AS INT) AS posicao
      FROM k WHERE rs >= 0.1 QUALIFY row_number() OVER (PARTITION BY resp_id ORDER BY rs DESC, lugar) <= 5""",
    "q14_reconstruct": f"""WITH {C}, k AS (SELECT CAST(bula_id AS VARCHAR) AS bula, CASE WHEN starts_with(coalesce(registro, ''), 'simplific') THEN 's' ELSE 'o' END AS r,
        coalesce(chunk_idx, 0) AS i, chunk_id, document FROM c WHERE bula_id IS NOT NULL)
      SELECT bula, md5(string_agg(document, chr(10) ORDER BY i, chunk_id) FILTER (r = 'o')) AS original,
        md5(string_agg(document, chr(10) ORDER BY i, chunk_id) FILTER (r = 's')) AS simplificada FROM k GROUP BY bula""",
    "q15_counts": f"WITH {B}, f AS (SELECT tipo, {filled('conteudo_original')} AND {filled('conteudo_simplificado')} AS ok FROM b) "
    "SELECT tipo, count(*) AS bulas, count(*) FILTER (ok) AS completas, count(*) FILTER (NOT ok) AS incompletas FROM f GROUP BY tipo",
    "q16_truncate": f"WITH {B} SELECT bula_id, substring(conteudo_simplificado, 1, 150) AS inicio, printf('%.4f', length(conteudo_simplificado) / 1000.0) AS milhares FROM b WHERE conteudo_simplificado IS NOT NULL",
    "q17_embed": f"""WITH {C}, v AS (SELECT chunk_id, k, sum(x) AS x FROM (SELECT chunk_id, {HASHED} FROM (SELECT chunk_id, unnest({tokens('document')}) AS w FROM c)) GROUP BY ALL)
      SELECT chunk_id, CAST(k AS INT) AS lugar, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)) AS FLOAT) AS DOUBLE), 6) AS valor FROM v QUALIFY x <> 0""",
    "q18_fold": f"WITH {B} SELECT DISTINCT nome_comercial, {fold('lower(nome_comercial)')} AS dobrado FROM b WHERE nome_comercial IS NOT NULL",
    "q21_append": f"""WITH {B} SELECT bula_id || '_original_limpo.txt' AS name, CASE WHEN conteudo_original IS NULL THEN NULL ELSE
      md5('<metadata>' || chr(10) || '<nome>' || coalesce(nome, '') || '</nome>' || chr(10) || '</metadata>' || chr(10) || chr(10) || '<text>' || chr(10)
        || {strip('conteudo_original')} || chr(10) || '</text>' || chr(10)) END AS md5 FROM b""",
    "q22_brand": rf"""WITH {B}, {M}, f AS (SELECT id, bula_id, regexp_extract_all(concat_ws(chr(10), nome_comercial, conteudo_original), '([A-ZÀ-Ý][\p{{L}}\p{{M}}\p{{N}}_À-ÿ\-]{{2,}})[{WS}]*[®™]', 1) AS ts FROM b WHERE id IS NOT NULL),
      e AS (SELECT id, bula_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM f),
      k AS (SELECT id, t, count(*) AS n, min(bula_id * 1000000 + pos) AS first FROM e WHERE t NOT IN ('Anvisa', 'MS', 'SAC', 'Reg') GROUP BY id, t),
      i AS (SELECT id, list_transform(list_filter(string_split_regex(coalesce(nome, ''), '[{WS}]+'), lambda w: length(w) >= 3), lambda w: {fold('lower(w)')}) AS inn FROM m)
      SELECT k.id, k.t AS marca FROM k LEFT JOIN i ON k.id = i.id WHERE NOT coalesce(list_contains(inn, {fold('lower(k.t)')}), false)
      QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY n DESC, first) = 1""",
    "q23_tag_replace": f"""WITH {B}, {M} SELECT bula_id, md5('<metadata>' || chr(10) || '<nome_comercial>' || coalesce(upper(m.nome), 'NA') || '</nome_comercial>' || chr(10)
      || '<doenca>' || coalesce(doenca, '') || '</doenca>' || chr(10) || '<nome_comercial>outro</nome_comercial>' || chr(10) || '</metadata>') AS md5,
      m.nome IS NOT NULL AS mudou FROM b LEFT JOIN m ON b.id = m.id""",
    "q24_rename": "SELECT linha, id || CASE tipo WHEN 'ht' THEN '_validada_limpo.txt' ELSE '_simplificada_limpo.txt' END AS nome_novo, TRY_CAST(id AS INT) AS numero "
    "FROM drug_map WHERE id IS NOT NULL AND tipo IN ('ht', 'onco')",
    "q25_response": f"WITH {A}, r AS (SELECT *, list_filter(list_slice(coalesce(rerank_scores, []), 1, len(ids)), lambda x: x IS NOT NULL AND NOT isnan(x)) AS rs FROM a WHERE len(ids) > 0) "
    "SELECT resp_id, array_to_string(ids, ',') AS ids, CAST(len(ids) AS INT) AS n, CAST(coalesce(list_sum(list_transform(distances, lambda x: CAST(floor((1 - x) * 1e6) AS BIGINT))), 0) AS BIGINT) AS soma, "
    "CAST(len(rs) AS INT) AS reavaliados, CAST(coalesce(list_sum(list_transform(rs, lambda x: CAST(floor(x * 1e6) AS BIGINT))), 0) AS BIGINT) AS soma_rerank FROM r",
    "q26_upsert": f"WITH {B} SELECT bula_id, id, fabricante, epoch_us(carregado_em) AS carregado FROM b",
    "q27_arrivals": "SELECT epoch_us(time_bucket(INTERVAL '1 day', criado_em AT TIME ZONE 'UTC')) AS dia, count(*) AS linhas FROM documents WHERE criado_em IS NOT NULL GROUP BY 1",
}
ORACLE["q28_index_twice"] = (
    f"WITH k AS ({ORACLE['q05_chunk']}), {B} SELECT b.id || '_' || b.bula_id AS id, k.registro, k.n, k.n AS distintos FROM k JOIN b USING (bula_id) WHERE b.id IS NOT NULL"
)
