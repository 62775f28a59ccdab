"""Mixes sources to target shares by entropy balancing.

Every line of a plan wants a share of the mix's tokens from one source. The rates of the source's
documents are those nearest to one copy each (in relative entropy) whose tokens add up to the
target and which stay within the cap:

    minimise sum r ln r - r   subject to   sum r_i t_i = T,   0 <= r_i <= cap

whose solution is the tilted rate r_i = min(cap, exp(lambda t_i)). The convex dual has one variable
for each line. All are solved at once by safeguarded Newton iterations, each of which is one
distributed sum over a histogram of (source, token count), at ``TRIALS`` multipliers of every line at
once; only those sums return to the driver. The dual also tells which lines can't be reached: where
every document stands at the cap (no curvature is left) and the tokens still fall short, it has no
maximum.

Rates become copies by systematic rounding: in the order of their tokens, a source's documents of one
rate get their share of whole copies, carried from one token count to the next, so the tokens of a
source are off by a few documents at most, however many it has. Which documents of one token count
get the extra copy is decided by the rank of a hash; ranks are counted by parts of the hash, so that
a token count held by a third of all documents is no task of its own.

Defined results
  * Lines with null weight are no part of the mix; weights are shares of the plan's non-null sum.
  * Lines of a plan that name a source twice are merged: weights add, the larger cap holds.
  * ``estado``: ``alcancado``; ``inalcancavel``, wanting more than cap times its source's tokens (every
    document is repeated up to the cap, and a source without tokens reaches 0); ``limite``, wanting
    just that; ``zero``, wanting nothing; ``nao_convergiu``, open after ``STEPS`` iterations, with
    ``residuo``, what is missing relative to the target.
  * A share of 0 takes nothing. Documents with no tokens or null source are never drawn (a null
    source in the plan matches nothing). Repeated documents are drawn each by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from leafsift.session import staged

STEPS, TRIALS, PARTS = 60, 4, 1024
TOLERANCE = 1e-9
PLAN_LINES = 100_000


def plan_lines(plan: DataFrame) -> DataFrame:
    """(plano_id, source, cota, limite) of the lines with a weight."""
    p = plan.where(F.col("peso").isNotNull() & ~F.isnan("peso"))
    p = p.groupBy("plano_id", "source").agg(F.sum("peso").alias("peso"), F.max("max_repeticoes").alias("limite"))
    total = p.groupBy("plano_id").agg(F.sum("peso").alias("total"))
    return p.join(total, "plano_id").select(
        "plano_id",
        "source",
        F.coalesce(F.try_divide("peso", "total"), F.lit(0.0)).alias("cota"),
        F.coalesce(F.col("limite").cast("double"), F.lit(0.0)).alias("limite"),
    )


def token_histogram(docs: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    """(source, t, n): documents of each source with t tokens; partial sums before the shuffle."""
    return (
        docs.select("source", F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("t"))
        .groupBy("source", "t")
        .agg(F.count("*").alias("n"))
    )


def _sums(hist: DataFrame, now: list[tuple]) -> dict[tuple[int, int], tuple[float, float]]:
    """(tokens reached, their derivative by the multiplier) of (line, trial, source, multiplier, cap, scale)."""
    at = hist.sparkSession.createDataFrame(now, "linha int, vez int, source string, l double, limite double, maior double")
    # exp is capped in its argument so that no rate overflows before the cap applies
    z = F.least(F.col("l") * F.col("t") / F.col("maior"), F.lit(700.0))
    free = (F.col("limite") > 0) & (z < F.log(F.greatest("limite", F.lit(1e-300))))
    grow = F.exp(z) * F.col("t") * F.col("n")
    got = (
        hist.where("t > 0")
        .join(F.broadcast(at), "source")  # TRIALS rows for each open plan line, of which there are at most PLAN_LINES
        .groupBy("linha", "vez")
        .agg(F.sum(F.when(free, grow).otherwise(F.col("limite") * F.col("t") * F.col("n"))).alias("g"), F.sum(F.when(free, grow * F.col("t") / F.col("maior")).otherwise(0.0)).alias("h"))
        .collect()
    )
    return {(r["linha"], r["vez"]): (r["g"], r["h"]) for r in got}


def _next(x: dict) -> float:
    """The next multiplier of a line: Newton on ln g, which is closer to a line than g, or else a step that keeps the bracket."""
    g, h = x["alcancado"], x["h"]
    at = x["lambda"] + (math.log(x["alvo"]) - math.log(g)) * g / h if g > 0 and h > 0 else None
    lo, hi = x["lo"], x["hi"]
    if at is not None and abs(at - x["lambda"]) < 1e6 and (lo is None or at > lo) and (hi is None or at < hi):
        return at
    if lo is None:
        return min(2 * hi, hi - 1.0) if hi < 0 else hi - 1.0
    if hi is None:
        return max(2 * lo, lo + 1.0)
    return (lo + hi) / 2


def balance(hist: DataFrame, lines: DataFrame, size: float | None = None, steps: int = STEPS) -> DataFrame:
    """Solve all lines: (plano_id, source, cota, limite, alvo, disponivel, maior, lambda, alcancado, estado, residuo).

    ``lines`` is a table of settings and must fit the driver (checked); the histogram stays
    distributed and is summed once per iteration.
    """
    spark = hist.sparkSession
    sums = hist.groupBy("source").agg(F.sum(F.col("t") * F.col("n")).alias("disponivel"), F.max("t").alias("maior"))
    total = hist.agg(F.coalesce(F.sum(F.col("t") * F.col("n")), F.lit(0)).alias("todos"))
    rows = (
        lines.join(sums, "source", "left")
        .crossJoin(total)  # one row
        .select(
            "plano_id",
            "source",
            "cota",
            "limite",
            (F.col("cota") * (F.col("todos") if size is None else F.lit(float(size)))).alias("alvo"),
            F.coalesce("disponivel", F.lit(0)).cast("double").alias("disponivel"),
            F.greatest(F.coalesce("maior", F.lit(0)), F.lit(1)).cast("double").alias("maior"),
        )
        .limit(PLAN_LINES + 1)
        .collect()
    )
    if len(rows) > PLAN_LINES:
        raise ValueError(f"more than {PLAN_LINES} plan lines")
    solved = []
    for k, r in enumerate(rows):
        x = r.asDict() | {"linha": k, "lambda": 0.0, "lo": None, "hi": None, "alcancado": 0.0, "h": 0.0}
        solved.append(x | {"estado": "zero" if x["alvo"] <= 0 else "aberto"})
    for _ in range(steps):
        todo = [x for x in solved if x["estado"] == "aberto"]
        if not todo:
            break
        trials = {}
        for x in todo:
            first = x["lambda"]
            # besides Newton's own point, points beyond it and towards the ends of the bracket
            lo, hi = (first - 4.0 if x["lo"] is None else x["lo"]), (first + 64.0 if x["hi"] is None else x["hi"])
            trials[x["linha"]] = [first, (first + hi) / 2, (first + lo) / 2, hi if x["hi"] is None else (3 * first + hi) / 4][:TRIALS]
        got = _sums(hist, [(x["linha"], v, x["source"], l, x["limite"], x["maior"]) for x in todo for v, l in enumerate(trials[x["linha"]])])
        for x in todo:
            tried = sorted((l, *got.get((x["linha"], v), (0.0, 0.0))) for v, l in enumerate(trials[x["linha"]]))
            for l, g, h in tried:
                if h == 0 and g <= x["alvo"] * (1 + TOLERANCE) and l >= 0:  # all at the cap, or nothing to draw from
                    short = x["alvo"] > g
                    x |= {"alcancado": g, "estado": "inalcancavel" if short else "limite"}
                    break
                if g < x["alvo"] and (x["lo"] is None or l > x["lo"]):
                    x["lo"] = l
                if g >= x["alvo"] and (x["hi"] is None or l < x["hi"]):
                    x["hi"] = l
            if x["estado"] != "aberto":
                continue
            l, g, h = min((t for t in tried if t[1] > 0), key=lambda t: abs(math.log(t[1] / x["alvo"])), default=tried[0])
            x |= {"lambda": l, "alcancado": g, "h": h}
            if abs(g - x["alvo"]) <= TOLERANCE * x["alvo"]:
                x["estado"] = "alcancado"
            elif x["lo"] is not None and x["hi"] is not None and x["hi"] - x["lo"] <= 1e-13 * max(1.0, abs(x["hi"])):
                x["estado"] = "alcancado"  # the sum steps over the target within the last digit of the multiplier
            else:
                x["lambda"] = _next(x)
    for x in solved:
        if x["estado"] == "aberto":
            x["estado"] = "nao_convergiu"
        x["residuo"] = (x["alvo"] - x["alcancado"]) / x["alvo"] if x["alvo"] > 0 else 0.0
    cols = ("plano_id", "source", "cota", "limite", "alvo", "disponivel", "maior", "lambda", "alcancado", "estado", "residuo")
    return spark.createDataFrame(
        [tuple(x[c] for c in cols) for x in solved],
        "plano_id int, source string, cota double, limite double, alvo double, disponivel double, maior double, "
        "lambda double, alcancado double, estado string, residuo double",
    )


def draw(docs: DataFrame, solved: DataFrame, key: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """(plano_id, key, source, n_tokens, copias): the mix of every plan; rows without copies are left out."""
    z = F.least(F.col("lambda") * F.col("t") / F.col("maior"), F.lit(700.0))
    rate = (
        F.when(F.col("estado") == "zero", 0.0)
        .when(F.col("estado").isin("inalcancavel", "limite"), F.col("limite"))
        .otherwise(F.least(F.exp(z), F.col("limite")))
    )
    part = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(PARTS)).cast("int")
    d = docs.where((F.col(tokens) > 0) & F.col("source").isNotNull()).select(key, "source", F.col(tokens).alias("t"), part.alias("parte"))
    counts = d.groupBy("source", "t", "parte").agg(F.count("*").alias("m"))
    before = Window.partitionBy("source", "t").orderBy("parte").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("antes", F.coalesce(F.sum("m").over(before), F.lit(0)))
    own = Window.partitionBy("source", "t", "parte").orderBy(F.xxhash64(F.col(key), F.lit(11)), key)
    ranked = d.withColumn("r", F.row_number().over(own)).join(cells, ["source", "t", "parte"]).select(key, "source", "t", (F.col("r") + F.col("antes")).alias("lugar"))
    hist = counts.groupBy("source", "t").agg(F.sum("m").alias("n"))
    plan = hist.join(F.broadcast(solved), "source").withColumn("taxa", rate)  # one row per plan line, checked in balance()
    part_of = F.col("n") * (F.col("taxa") - F.floor("taxa"))
    upto = F.sum(part_of).over(Window.partitionBy("plano_id", "source").orderBy("t"))
    plan = plan.withColumn("ate", F.round(upto, 6))
    extra = F.floor(F.col("ate") + 0.5) - F.floor(F.round(F.col("ate") - part_of, 6) + 0.5)
    plan = plan.select("plano_id", "source", "t", F.floor("taxa").alias("todas"), extra.alias("extra")).where("todas > 0 or extra > 0")
    d = ranked.join(plan, ["source", "t"])
    copies = (F.col("todas") + F.when(F.col("lugar") <= F.col("extra"), 1).otherwise(0)).cast("int")
    return d.select("plano_id", key, "source", F.col("t").alias(tokens), copies.alias("copias")).where("copias > 0")


def shares(drawn: DataFrame, solved: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    """Per line: target share, share of the mix as drawn, state."""
    got = drawn.groupBy("plano_id", "source").agg(
        F.sum(F.col(tokens) * F.col("copias")).alias("tokens"), F.sum("copias").alias("copias"), F.count("*").alias("documentos")
    )
    every = got.groupBy("plano_id").agg(F.sum("tokens").alias("do_plano"))
    return (
        solved.join(got, ["plano_id", "source"], "left")
        .join(every, "plano_id", "left")
        .select(
            "plano_id",
            "source",
            "cota",
            F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("do_plano").cast("double")), F.lit(0.0)).alias("cota_obtida"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("copias", F.lit(0)).alias("copias"),
            F.coalesce("documentos", F.lit(0)).alias("documentos"),
            "estado",
            F.round("residuo", 9).alias("residuo"),
        )
    )


def counted_histogram(docs: DataFrame) -> DataFrame:
    """The histogram as a table of its own: the texts are tokenised once, not once per iteration."""
    return staged(token_histogram(docs), "histograma")
