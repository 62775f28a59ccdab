"""Finds texts that were cut off, from word trigrams inside texts and at ends, in SQL.

Every line is a run of tokens: words (folded; words in capitals stay apart), numbers (all alike) and
single marks. For every trigram of the corpus two numbers are counted: how often it stands inside a
line and how often a line or text ends with it. The last trigram of each text is joined to them, and
the rules are tried in this order (``regra``, 0 where none tells):

1. A sentence mark completes a text, unless the trigram before it goes on in small letters or numbers
   wherever else it occurs (abbreviations).
2. A text that breaks off within a word ends in a trigram that hardly occurs while the trigrams it is
   the beginning of do; those are counted by the prefixes of their last token.
3. A text is cut if its last trigram is frequent inside but almost never terminal.
4. to 9. Where the trigram is too rare to tell, the context before its last token, then its last two
   tokens, then its last token decide in the same ways, and at last whether anything ends after its
   last token but one.

Lines are counted by kind: items of lists, posts that use no punctuation at all, and all others.
White space, closing tags, marks of a break (``...``, ``[...]``) and half characters after the cut
are no part of the text.

Evidence is counted over distinct texts, as they are judged, so that copies of one cut text don't
vouch for each other.

Defined results: null, empty and blank texts are not cut. Repeated rows are judged each by itself.
An ending of which the corpus knows nothing is not cut. Other columns are not read, but for the
source in ``by_source``, where null is a source of its own.

The corpus is tokenised once. Trigrams are counted as written, with partial sums before the shuffle,
and folded when each is left once; endings are judged once for each distinct one, and the tables
joined are as large as the vocabulary, not as the corpus.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from leafsift.session import small, staged

LEAST_SEEN, MOST_TERMINAL, LEAST_CONTINUED, TIMES_CONTINUED = 8, 0.1, 5, 10

# Accented Latin letters and their base letters, and UTF-8 letters read byte by byte.
_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"
_MISREAD = (
    ("Ã[\\u00a0-\\u00a5]", "a"), ("Ã§", "c"), ("Ã[\\u00a8-\\u00ab]", "e"), ("Ã[\\u00ac-\\u00af]", "i"), ("Ã±", "n"),
    ("Ã[\\u00b2-\\u00b6]", "o"), ("Ã[\\u00b9-\\u00bc]", "u"), ("â\\u0080[\\u009c\\u009d]", '"'), ("â\\u0080[\\u0093\\u0094]", "-"), ("Â", ""),
)
_TAIL = r"(?:\\s|</[A-Za-z]*>?|\\.{3,}|…|[\\[(]\\s*(?:\\.{2,}|…)\\s*[\\])]?|\\ufffd|[ÃÂ]|\\u00e2\\u0080?|\\p{M})+$"


_HIDDEN = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def _mended() -> str:
    out = "t"
    for pattern, letter in _MISREAD:
        out = f"regexp_replace({out}, '{pattern}', '{letter}')"
    return f"CASE WHEN t RLIKE '[ÃÂâ][\\\\u0080-\\\\u00bf]' THEN {out} ELSE t END"


# The text as it is judged, in layers so that no step is computed twice: without hidden characters,
# misread letters put right, without what follows a cut and what closes after a sentence.
_LAST = r"[^\\p{L}\\p{N}.!?]$|\\.\\.$|[ÃÂâ]$|\\p{M}$"
TEXTS = (
    f"SELECT doc_id, CASE WHEN text RLIKE '[{_HIDDEN}]' THEN translate(text, '{_HIDDEN}', '') ELSE text END AS t FROM {{docs}} WHERE text IS NOT NULL",
    f"SELECT doc_id, {_mended()} AS t FROM {{layer}}",
    # a text whose last two characters can't belong to such a tail, nor its last tag, isn't searched for one
    f"SELECT doc_id, CASE WHEN right(t, 2) RLIKE '{_LAST}' OR (contains(t, '</') AND substring_index(t, '</', -1) RLIKE '^[A-Za-z]*$') THEN regexp_replace(t, '{_TAIL}', '') ELSE t END AS t FROM {{layer}}",
    r"""SELECT doc_id, CASE WHEN right(t, 1) IN (')', ']', '”', '"', '»', '’') THEN regexp_replace(t, '([.!?])[)\\]”"»’]+$', '$1') ELSE t END AS t FROM {layer}""",
)
_NUMBER = r"\\p{N}+(?:[.,]\\p{N}+)*"
_TOKEN = rf"(?:[\\p{{L}}\\p{{M}}]|{_NUMBER})+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}]"
_LINES = rf"""
CASE WHEN NOT t RLIKE '[.,;:!?]' THEN 'U'
                    WHEN line RLIKE '^\\s*(?:[-*•–·]|{_NUMBER}[.)]|[a-z][)])\\s' THEN 'L' ELSE 'P' END AS kind,
       regexp_extract_all(line, '{_TOKEN}', 0) AS a
"""
LINES = "SELECT" + _LINES + r"FROM (SELECT DISTINCT t FROM {texts}) LATERAL VIEW explode(split(t, '[\\r\\n]+')) AS line"
LAST_LINES = "SELECT doc_id," + _LINES + "FROM (SELECT doc_id, t, substring_index(replace(t, '\\r', '\\n'), '\\n', -1) AS line FROM {texts})"


# No filter stands on what is computed from a text: pushed down to the scan, it would repeat the work.
# A token as it is counted: no accents, all numbers alike, small letters unless written in capitals.
_PLAIN_TOKEN = f"translate(CASE WHEN x RLIKE '\\\\p{{N}}' THEN regexp_replace(x, '{_NUMBER}', '0') ELSE x END, '{_ACCENTED}{_MARKS}', '{_PLAIN}')"
_FOLDED = f"transform({{a}}, x -> CASE WHEN length(x) > 1 AND x = upper(x) THEN {_PLAIN_TOKEN} ELSE lower({_PLAIN_TOKEN}) END)"
TRIGRAMS = f"""
SELECT kind, w[0] AS t1, w[1] AS t2, w[2] AS t3, sum(n) AS n, sum(e) AS e, sum(low) AS low
FROM (SELECT kind, {_FOLDED.replace('{a}', 'array(t1, t2, t3)')} AS w, n, e, low
      FROM (SELECT kind, t1, t2, t3, count(*) AS n, count_if(next IS NULL) AS e,
                   count_if(t3 = '.' AND (next RLIKE '^\\\\p{{N}}' OR (next = lower(next) AND next <> upper(next)))) AS low
            FROM (SELECT kind, a, concat(array('^', '^'), a) AS b FROM {{lines}})
            LATERAL VIEW inline(arrays_zip(slice(b, 1, size(a)), slice(b, 2, size(a)), a, slice(a, 2, size(a)))) AS t1, t2, t3, next
            GROUP BY kind, t1, t2, t3))
GROUP BY kind, w
"""
ENDINGS = f"""
SELECT doc_id, kind, get(w, 0) AS t1, get(w, 1) AS t2, get(w, 2) AS t3
FROM (SELECT doc_id, kind, {_FOLDED.replace('{a}', "slice(concat(array('^', '^'), a), -3, 3)")} AS w FROM {{last_lines}})
"""
# Only of tokens that some text ends in.
PREFIXES = """
SELECT x.kind, t1, t2, x.p, sum(n) AS px
FROM (SELECT kind, t1, t2, n, explode(transform(sequence(1, length(t3) - 1), i -> substring(t3, 1, i))) AS p FROM {trigrams} WHERE length(t3) > 1) x
LEFT SEMI JOIN (SELECT DISTINCT kind, t3 FROM {endings}) y ON y.kind = x.kind AND y.t3 = x.p
GROUP BY x.kind, t1, t2, x.p
"""
# Endings in a sentence mark need their own trigram only; all others are joined to every kind of evidence.
VERDICTS = """
WITH es AS (SELECT DISTINCT kind, t1, t2, t3 FROM {endings}),
words AS (SELECT * FROM es WHERE t3 NOT IN ('.', '!', '?')),
ctx AS (SELECT kind, t1, t2, sum(n) AS nc, sum(e) AS ec FROM {trigrams} GROUP BY kind, t1, t2),
bi AS (SELECT kind, t2, t3, sum(n) AS n2, sum(e) AS e2 FROM {trigrams} GROUP BY kind, t2, t3),
after AS (SELECT kind, t2, sum(n) AS na, sum(e) AS ea FROM {trigrams} GROUP BY kind, t2),
uni AS (SELECT kind, t3, sum(n) AS n1, sum(e) AS e1 FROM {trigrams} GROUP BY kind, t3),
px2 AS (SELECT kind, t2, p, sum(px) AS px2 FROM {prefixes} GROUP BY kind, t2, p),
px1 AS (SELECT kind, p, sum(px) AS px1 FROM {prefixes} GROUP BY kind, p)
SELECT es.kind, es.t1, es.t2, es.t3, if(tri.n - tri.e >= 2 * {seen} AND tri.low >= 0.95 * (tri.n - tri.e), 1, -1) AS regra
FROM es JOIN {trigrams} tri ON tri.kind = es.kind AND tri.t1 = es.t1 AND tri.t2 = es.t2 AND tri.t3 = es.t3 WHERE es.t3 = '.'
UNION ALL
SELECT es.kind, es.t1, es.t2, es.t3,
  CASE
    WHEN px3.px >= {more} AND px3.px >= {times} * (tri.n - 1) THEN 2
    WHEN tri.n > {seen} THEN if(tri.e - 1 <= greatest(1, {rare} * tri.n), 3, -3)
    WHEN ctx.nc > {seen} AND ctx.ec - 1 >= 0.5 * (ctx.nc - 1) THEN -4
    WHEN es.t2 RLIKE '[\\\\p{L},;:)]' AND px2.px2 >= {more} AND px2.px2 >= {times} * (bi.n2 - 1) THEN 5
    WHEN bi.n2 > {seen} THEN if(bi.e2 - 1 <= greatest(1, {rare} * bi.n2), 6, -6)
    WHEN es.t2 RLIKE '[\\\\p{L},;:)]' AND px1.px1 >= {more} AND px1.px1 >= {times} * (uni.n1 - 1) THEN 7
    WHEN es.t3 <> '0' AND uni.n1 > {seen} THEN if(uni.e1 - 1 <= greatest(1, {rare} * uni.n1), 8, -8)
    WHEN es.t2 RLIKE '\\\\p{L}' AND after.na > {seen} THEN if(after.ea - 1 <= {rare} * after.na, 9, -9)
    ELSE 0
  END AS regra
FROM words es
JOIN {trigrams} tri ON tri.kind = es.kind AND tri.t1 = es.t1 AND tri.t2 = es.t2 AND tri.t3 = es.t3
JOIN ctx ON ctx.kind = es.kind AND ctx.t1 = es.t1 AND ctx.t2 = es.t2
JOIN bi ON bi.kind = es.kind AND bi.t2 = es.t2 AND bi.t3 = es.t3
JOIN after ON after.kind = es.kind AND after.t2 = es.t2
JOIN uni ON uni.kind = es.kind AND uni.t3 = es.t3
LEFT JOIN {prefixes} px3 ON px3.kind = es.kind AND px3.t1 = es.t1 AND px3.t2 = es.t2 AND px3.p = es.t3
LEFT JOIN px2 ON px2.kind = es.kind AND px2.t2 = es.t2 AND px2.p = es.t3
LEFT JOIN px1 ON px1.kind = es.kind AND px1.p = es.t3
"""
CUT = """
SELECT d.doc_id, v.regra IS NOT NULL AS cortado, v.regra FROM {endings} d
LEFT JOIN {cut} v ON v.kind = d.kind AND v.t1 = d.t1 AND v.t2 = d.t2 AND v.t3 = d.t3
"""


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, cortado, regra) of every row with a text that is not blank; ``regra``: by which rule it is cut."""
    spark = docs.sparkSession
    held: dict[str, str] = {}
    made: list[str] = []

    def view(name: str, df: DataFrame) -> None:
        held[name] = f"leafsift_{name}_{uuid.uuid4().hex}"
        made.append(held[name])
        df.createOrReplaceTempView(held[name])

    numbers = {"seen": LEAST_SEEN, "rare": MOST_TERMINAL, "more": LEAST_CONTINUED, "times": TIMES_CONTINUED}

    def sql(query: str) -> DataFrame:
        for k, v in {**held, **numbers}.items():
            query = query.replace("{" + k + "}", str(v))
        return spark.sql(query)

    view("docs", docs.select(docs[key].alias("doc_id"), docs[text].alias("text")))
    for layer in TEXTS:
        view("layer", sql(layer))
    held["texts"] = held["layer"]
    view("lines", sql(LINES))
    view("last_lines", sql(LAST_LINES))
    view("trigrams", staged(sql(TRIGRAMS), "trigramas"))
    view("endings", staged(sql(ENDINGS), "finais").where("t3 IS NOT NULL"))  # no token: a blank text
    view("prefixes", staged(sql(PREFIXES), "inicios"))
    # as many rows as there are distinct endings of cut texts; broadcast only where counted to be few
    view("cut", small(staged(sql(VERDICTS).where("regra > 0"), "cortes")))
    out = sql(CUT)
    for name in made:
        spark.catalog.dropTempView(name)
    return out


def by_source(docs: DataFrame, cut: DataFrame, key: str = "doc_id") -> DataFrame:
    """(source, textos, cortados, fracao) over the texts that are not blank."""
    from pyspark.sql import functions as F

    d = docs.select(F.col(key).alias("doc_id"), "source").join(cut.select("doc_id", "cortado"), "doc_id")
    return (
        d.groupBy("source")
        .agg(F.count("*").alias("textos"), F.sum(F.col("cortado").cast("int")).alias("cortados"))
        .withColumn("fracao", F.col("cortados") / F.col("textos"))
    )
