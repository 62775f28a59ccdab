"""Near-duplicate texts by bottom-k sketches from one hash function.

1. Texts are folded to words. Texts with the same words are one class, stood for by its least key.
2. Every class keeps the ``k`` smallest hashes of its runs of five words: its sketch.
3. A pair is a candidate if its sketches share at least ``least`` of the larger one's values, ``c``
   of them. Inverted lists of the retained values find all such pairs, whatever the lists' lengths.
   Lists of at most ``short`` classes give their pairs, and counting a pair over all of them gives its
   overlap in rare values; those of ``RARE`` or more are candidates. A pair with fewer shares at
   least ``c - RARE + 1`` common values, from longer lists:
4. Each class orders its common values by rarity, and enters the lists of those only from which
   that many can still follow (the prefix). It takes its sketch along, so a list compares its members
   by all they share, and only pairs that share ``c`` go on. A list too long for one task is split by
   its members' next values, in the same way and as often as need be; if most of its members share
   much, splitting would not shrink it, and it is met block against block, as members that need nothing
   more are. No list is capped and no class left out, so steps 3 and 4 are exact.
5. The union sketch (the ``k`` least values of both) estimates the resemblance of each candidate;
   those under ``least`` are dropped, where they are found: by chance alone the number of candidates
   grows with the square of the table.
6. The exact Jaccard similarity of the runs of three words verifies the rest.

Lists, blocks and pairs to verify are worked off in rounds, of about ``load`` list entries or two for
each class, whichever is more. What a round stores goes before the next, so the disk holds one round
of each depth of splitting, and more work means more rounds.

What is left to chance is the estimate of step 5 alone. A pair above one half in runs of three words
has at least 0.28 in runs of five even if its edits stand as far apart as they can.

Defined results: null, blank, empty and ``NA`` texts, and texts without a word, are in no pair and
in no group of more than one. Rows without a key are left out. Repeated rows of one key count once; of different texts under one key
the one with the least digest is sketched. Texts shorter than a run are one run. Columns other than key and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafsift.llm.shingles import jaccard, many
from leafsift.session import drop, scratch, ship, small, spread, staged

K, LEAST, SHORT, RARE, LONG, BUCKET = 48, 0.16, 48, 3, 2000, 20_000
SKETCH_RUN, EXACT_RUN, CACHE_CHARS = 5, 3, 8_000_000
LOAD, PAIRS, TABLES = 500_000, 20, 60  # entries in work at once at least, pairs of rare lists to an entry, tables of pairs kept apart


def filled(c: Column) -> Column:
    """Neither null nor empty, blank or NA within white space; both patterns stop at the first characters."""
    return c.isNotNull() & c.rlike(r"(?U)[^\s\x1c-\x1f]") & ~c.rlike(r"(?U)\A[\s\x1c-\x1f]*NA[\s\x1c-\x1f]*\z")


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _sketches(k: int):
    @F.arrow_udf("struct<fp:binary,sk:array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        fps, parts = [], []
        for h, runs in many(texts.to_pylist(), SKETCH_RUN):
            fps.append(xxhash.xxh128_digest(h.tobytes()) if len(h) else None)
            parts.append(runs[:k].view(np.int64))
        return pa.StructArray.from_arrays([pa.array(fps, pa.binary()), _lists(parts, pa.int64())], ["fp", "sk"])

    return sketch


_cut: dict[str, np.ndarray] = {}  # runs of texts seen by this worker, of at most CACHE_CHARS characters


def _runs_of(texts: list[str], run: int) -> list[np.ndarray]:
    new = [t for t in dict.fromkeys(texts) if t not in _cut]
    if sum(map(len, _cut)) + sum(map(len, new)) > CACHE_CHARS:
        _cut.clear()
        new = list(dict.fromkeys(texts))
    _cut.update(zip(new, (r for _, r in many(new, run))))
    return [_cut[t] for t in texts]


def _verify(run: int):
    @F.arrow_udf("double")
    def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        out, n = [], 500  # pairs at once; a text that recurs is cut once
        for at in range(0, len(a), n):
            x, y = a.slice(at, n).to_pylist(), b.slice(at, n).to_pylist()
            runs = _runs_of(x + y, run)
            out += map(jaccard, runs[: len(x)], runs[len(x) :])
        return pa.array(out, pa.float64())

    return similarity


def sketched(df: DataFrame, key: str, text: str, k: int = K) -> DataFrame:
    """(key, fp, sk) of every row with words: the digest of its words and its sketch."""
    ship(df.sparkSession)
    d = spread(df.select(F.col(key).alias("key"), F.col(text).alias("t")).where(F.col("key").isNotNull() & filled(F.col("t"))))
    return d.select("key", _sketches(k)("t").alias("s")).select("key", "s.fp", "s.sk").where("fp is not null")


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, membership): (fp, doc, sk, es), one row per distinct word sequence; (key, fp).

    ``doc`` is the least key that has the sequence, ``es`` the upper halves of the sketch's values, moved so
    that their order as signed numbers is that of the values as unsigned ones.
    """
    own = rows.groupBy("key").agg(F.min("fp").alias("fp"))
    least = own.groupBy("fp").agg(F.min("key").alias("doc"))
    upper = F.transform("sk", lambda v: (F.shiftrightunsigned(v, 32) - F.lit(2**31)).cast("int"))
    return rows.groupBy("fp").agg(F.first("sk").alias("sk")).join(least, "fp").withColumn("es", upper), own


# --- candidates --------------------------------------------------------------------------------------


def _postings(table: DataFrame, least: float) -> DataFrame:
    """(doc, c, h): the retained values, and how many of them a partner must share."""
    return table.select("doc", F.ceil(F.lit(least) * F.size("sk")).cast("int").alias("c"), F.explode("sk").alias("h"))


def _rounds(df: DataFrame, by: list[str], n: int) -> Iterator[DataFrame]:
    """``df`` in ``n`` parts by a hash of the columns ``by``."""
    for r in range(n):
        yield df.where(F.pmod(F.xxhash64(*by, F.lit(n)), F.lit(n)) == r) if n > 1 else df


def _rare_pairs(post: DataFrame, short: int, load: int) -> Iterator[DataFrame]:
    """Tables (a, b) of the pairs with enough rare values in common, each from about ``PAIRS * load`` pairs of the lists.

    The rank filter acts before the shuffle as well, so a long list sends ``short`` + 1 members from
    each task at most, which tell that it is long; it is left to ``_common``.
    """
    rn = F.row_number().over(Window.partitionBy("h").orderBy("doc"))
    item = F.struct("doc", F.least("c", F.lit(RARE)).alias("need"))
    few = post.withColumn("rn", rn).where(F.col("rn") <= short + 1)
    lists = few.groupBy("h").agg(F.sort_array(F.collect_list(item)).alias("l")).where((F.size("l") > 1) & (F.size("l") <= short))
    lists = staged(lists.select("l"), "raros")
    total = lists.agg(F.coalesce(F.sum(F.size("l") * (F.size("l") - 1) / 2), F.lit(0.0))).first()[0]
    one = lists.select("l", F.posexplode("l").alias("i", "x"))
    for part in _rounds(one, ["x.doc"], -(-int(total) // (PAIRS * load)) or 1):
        two = part.select("x", F.explode(F.slice("l", F.col("i") + 2, F.lit(short))).alias("y"))
        counted = two.groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.greatest("x.need", "y.need").alias("need")).count()
        yield counted.where("count >= need").select("a", "b")


def _common(post: DataFrame, table: DataFrame, short: int) -> DataFrame:
    """(path, doc, need, c, vs, es) of the classes that can have ``need`` common values in common with another.

    ``vs`` are the lower halves of the common values, rarest first; ``c`` is how many of all values a partner must share.
    """
    hot = staged(post.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") > short), "comuns")
    need = F.greatest(F.col("c") - RARE + 1, F.lit(1))
    half = F.shiftright(F.shiftleft("h", 32), 32).cast("int")
    d = post.join(small(hot), "h").groupBy("doc", "c").agg(F.sort_array(F.collect_list(F.struct("df", "h", half.alias("v")))).alias("o"))
    d = d.select("doc", need.alias("need"), "c", F.col("o.v").alias("vs")).where(F.size("vs") >= F.col("need"))
    return d.join(table.select("doc", "es"), "doc").withColumn("path", F.lit(0).cast("bigint"))


def _prefix() -> Column:
    return F.slice("vs", F.lit(1), F.size("vs") - F.col("need") + 1)


def _entries(sets: DataFrame) -> DataFrame:
    """(path, doc, need, c, vs, es): each set in the lists of its prefix, with the values behind and what is needed of them.

    A list is named by a hash of its path. Lists that share a name are met as one, which costs time only.
    """
    one = sets.select("path", "doc", "need", "c", "es", "vs", F.posexplode(_prefix()).alias("i", "v"))
    rest = F.slice("vs", F.col("i") + 2, F.size("vs"))
    return one.select(F.xxhash64("path", "v").alias("path"), "doc", (F.col("need") - 1).alias("need"), "c", rest.alias("vs"), "es")


def _met(need: np.ndarray, sets: list[np.ndarray], parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the pairs of one list (of different ``parts``, if given) whose sets share enough values."""
    n = len(need)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    own = np.repeat(np.arange(n), sizes)
    both = np.sort(np.concatenate(sets).astype(np.int64) << 20 | own)  # by value, then by place; a list has far less than 2**20 members
    f, o = both >> 20, both & (2**20 - 1)
    edge = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    size = np.diff(np.r_[edge, len(f)])
    several = size > 1
    if (size[several].astype(float) ** 2).sum() < 4e6:
        left = np.repeat(edge + size, size) - np.arange(len(f)) - 1  # later members of the same value
        x = np.repeat(np.arange(len(f)), left)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(left) - left, left)
        both = np.bincount(o[x] * n + o[y], minlength=n * n)  # members stand in order, so i < j
    else:
        both, step = np.zeros((n, n), np.float32), 1024
        code = np.repeat(np.cumsum(several) - 1, size)
        keep = np.repeat(several, size)
        o, code = o[keep], code[keep]
        for at in range(0, int(several.sum()), step):
            m = np.zeros((n, step), np.float32)
            here = (code >= at) & (code < at + step)
            m[o[here], code[here] - at] = 1
            both += m @ m.T
        both = np.triu(both, 1).ravel()
    at = np.flatnonzero(both >= max(int(need.min()), 1))
    i, j = at // n, at % n
    ok = (both[at] >= np.maximum(need[i], need[j])) & (i != j)
    if parts is not None:
        ok &= parts[i] != parts[j]
    return i[ok], j[ok]


def _compared(entries: DataFrame, group: list[str], pieces: int, least: float | None, k: int) -> DataFrame:
    """(a, b) of the lists in ``entries``, several lists to a task; ``group`` names a list.

    The members carry their sketches, so a pair must share ``c`` values, and with ``least`` given it
    must pass the estimate as well before it leaves the task.
    """
    kind = entries.schema["doc"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(*group), F.lit(pieces)).cast("int")
    split = "own" in entries.columns
    d = entries.select(bucket.alias("bucket"), F.xxhash64(*group).alias("g"), "doc", "c", "es", *(["own", "whole"] if split else []))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("g").combine_chunks()
        g = t["g"].to_numpy()
        edges = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
        names = t["doc"].combine_chunks().dictionary_encode()
        docs, c = names.indices.to_numpy(), t["c"].to_numpy()
        lists = t["es"].combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        own = t["own"].to_numpy() if split else None
        whole = t["whole"].to_numpy(zero_copy_only=False) if split else None
        found = [np.empty(0, np.int64)]
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s > 1:
                i, j = _met(c[s:e], [flat[ends[x] : ends[x + 1]] for x in range(s, e)], own[s:e] if split and not whole[s] else None)
                x, y = docs[s + i].astype(np.int64), docs[s + j].astype(np.int64)
                found.append(np.unique(np.minimum(x, y)[x != y] * len(g) + np.maximum(x, y)[x != y]))
        pairs = np.unique(np.concatenate(found))
        x, y = pairs // len(g), pairs % len(g)
        if least is not None:
            row = np.zeros(len(names.dictionary), np.int64)
            row[docs] = np.arange(len(docs))  # any entry of the class; all have the same sketch
            passed = [np.empty(0, bool)]
            for at in range(0, len(x), 20_000):
                passed.append(_shares(lists.take(pa.array(row[x[at : at + 20_000]])), lists.take(pa.array(row[y[at : at + 20_000]])), k) >= least)
            passed = np.concatenate(passed)
            x, y = x[passed], y[passed]
        one, two = names.dictionary.take(pa.array(x)), names.dictionary.take(pa.array(y))
        less = pc.less(one, two)
        return pa.table({"a": pc.if_else(less, one, two), "b": pc.if_else(less, two, one)})

    return d.groupBy("bucket").applyInArrow(compare, f"a {kind}, b {kind}")


def _common_pairs(sets: DataFrame, long: int, bucket: int, load: int, least: float | None, k: int) -> Iterator[DataFrame]:
    """Tables (a, b) of the pairs with enough common values, list by list as in step 4.

    The lists are met in rounds of about ``load`` entries, and what a round's long lists are split into
    is done with before the next round begins. So the disk holds one round of each depth, however many there are.
    """
    sizes = sets.select("path", F.explode(_prefix()).alias("v")).groupBy(F.xxhash64("path", "v").alias("path")).agg(F.count("*").alias("n")).where("n > 1")
    sizes = staged(sizes, "listas")
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if not total:
        return drop(sizes)
    rounds = -(-total // load)
    pieces = -(-total // (rounds * bucket))
    for mine, own in zip(_rounds(_entries(sets), ["path"], rounds), _rounds(sizes, ["path"], rounds)):
        listed = mine.join(small(own), "path")
        yield _compared(listed.where(F.col("n") <= long), ["path"], pieces, least, k)
        if most <= long:
            continue
        long_ones = own.where(F.col("n") > long)
        if long_ones.isEmpty():
            continue
        big = staged(mine.join(small(long_ones), "path"), "listas")
        yield from _long_lists(big, long_ones, long, bucket, load, least, k)
        drop(big)
    drop(sizes)


def _long_lists(big: DataFrame, sizes: DataFrame, long: int, bucket: int, load: int, least: float | None, k: int) -> Iterator[DataFrame]:
    """Tables (a, b) of the lists longer than ``long``, in blocks or split by their members' next values."""
    # how many values two members of a long list share on average; where it is half of what is
    # needed, the list is met as it is, in blocks
    shared = big.select("path", "n", "need", F.explode("vs").alias("v")).groupBy("path", "n", "v").agg(F.count("*").alias("m"), F.max("need").alias("need"))
    shared = shared.groupBy("path", "n").agg(F.sum(F.col("m") * F.col("m")).alias("s"), F.max("need").alias("need"))
    dense = (F.coalesce("s", F.lit(0)) >= 0.5 * F.col("most") * F.col("n") * F.col("n")) | (F.col("most") <= 1)
    kind = sizes.join(shared.select("path", "s", F.col("need").alias("most")), "path", "left")
    kind = staged(kind.select("path", "n", F.coalesce(dense, F.lit(True)).alias("dense"), (F.col("n") / (long // 2)).cast("int").alias("last")), "listas")
    big = big.drop("n").join(small(kind), "path")
    # members of a list to be split that need nothing behind its value meet each other here
    blocks = big.where("dense or need <= 0").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("last") + 1).cast("int"))
    members, copies, most = blocks.agg(F.count("*"), F.coalesce(F.sum(F.col("last") + 1), F.lit(0)), F.max("last")).first()
    if members:
        blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
        blocks = blocks.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("whole", F.expr("i = j"))
        rounds = -(-copies // load)
        for part in _rounds(blocks, ["path", "i", "j"], rounds):
            yield _compared(part, ["path", "i", "j"], -(-copies // (rounds * bucket)), least, k)
    sets = big.where("not dense").select("path", "doc", F.greatest("need", F.lit(1)).alias("need"), "c", "vs", "es")
    sets = sets.where(F.size("vs") >= F.col("need"))
    if not sets.isEmpty():
        yield from _common_pairs(sets, long, bucket, load, least, k)
    drop(kind)


def candidates(
    table: DataFrame, least: float = LEAST, short: int = SHORT, long: int = LONG, bucket: int = BUCKET, load: int | None = None, k: int | None = None
) -> DataFrame:
    """Distinct (a, b), a < b, of classes whose sketches share at least ``least`` of the larger one's values.

    With ``k`` only those are stored that pass ``estimated`` as well: by chance alone the number of
    candidates grows with the square of the table. ``load`` is the number of list entries in work at once.
    """
    load = load or max(LOAD, 2 * table.count())
    with scratch(table.sparkSession) as hold:
        post = _postings(table, least)
        found = [staged(p if k is None else estimated(p, table, least, k), "pares") for p in _rare_pairs(post, short, load)]
        sets = staged(_common(post, table, short), "comuns")
        for pairs in _common_pairs(sets, long, bucket, load, None if k is None else least, k or 0):
            found.append(staged(pairs, "pares"))
            if len(found) > TABLES:
                merged = staged(_all(found).distinct(), "pares")
                drop(*found)
                found = [merged]
        return hold(staged(_all(found).distinct(), "candidatos"))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _shares(x: pa.ListArray, y: pa.ListArray, k: int) -> np.ndarray:
    """The share of the ``k`` least values of both sketches that both retain, pair by pair."""
    n = len(x)
    wide = np.full((n, 2 * k), 2**62, dtype=np.int64)  # of sketches shorter than k the rest stays larger than any value
    for at, lists in ((0, x), (k, y)):
        ends = lists.offsets.to_numpy()
        size = np.diff(ends)
        flat = lists.values.to_numpy()[ends[0] : ends[-1]]
        row = np.repeat(np.arange(n), size)
        wide[row, at + np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    wide.sort(axis=1)
    real = wide < 2**62
    twice = np.zeros_like(real)
    twice[:, 1:] = (wide[:, 1:] == wide[:, :-1]) & real[:, 1:]
    first = (np.cumsum(real & ~twice, axis=1) <= k) & real  # among the k least of both
    return (twice & first).sum(axis=1) / np.maximum((first & ~twice).sum(axis=1), 1)


def _union_sketch(k: int):
    @F.arrow_udf("double")
    def share(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(_shares(x, y, k))

    return share


def estimated(cand: DataFrame, table: DataFrame, least: float = LEAST, k: int = K) -> DataFrame:
    """The candidates whose resemblance, estimated on the union sketch, is at least ``least``.

    The union sketch is the ``k`` least values of both; the share of it that both retain is the estimate.
    """
    es = table.select("doc", "es")
    d = cand.join(es.select(F.col("doc").alias("a"), F.col("es").alias("x")), "a").join(es.select(F.col("doc").alias("b"), F.col("es").alias("y")), "b")
    return d.withColumn("e", _union_sketch(k)("x", "y")).where(F.col("e") >= least).select("a", "b")


def verified(df: DataFrame, key: str, text: str, cand: DataFrame, above: float, load: int | None = None) -> DataFrame:
    """(a, b, jaccard) of the candidates whose runs of three words have Jaccard similarity > ``above``.

    Only texts named by a candidate are read on; of several texts under one key the best pair counts.
    Texts are joined to at most about ``load`` pairs at once.
    """
    named = staged(cand.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "chaves")
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("t")).join(small(named), "key", "left_semi").where(filled(F.col("t")))
    texts = staged(texts, "textos")
    load = load or max(LOAD // 4, named.count())
    parts, rounds = [], -(-cand.count() // load) or 1
    for part in _rounds(cand, ["a", "b"], rounds):
        pairs = part.join(texts.select(F.col("key").alias("a"), F.col("t").alias("ta")), "a").join(
            texts.select(F.col("key").alias("b"), F.col("t").alias("tb")), "b"
        )
        sim = pairs.select("a", "b", _verify(EXACT_RUN)("ta", "tb").alias("jaccard"))
        sim = sim.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard")).where(F.col("jaccard") > above)
        parts.append(sim if rounds == 1 else staged(sim, "elos"))
    return _all(parts)


def near_duplicate_pairs(df: DataFrame, key: str, text: str, above: float = 0.5, k: int = K, least: float = LEAST, **settings) -> tuple[DataFrame, DataFrame]:
    """(links between classes, membership): (a, b, jaccard) of different texts, and (key, doc) of every key."""
    with scratch(df.sparkSession) as hold:
        rows = staged(sketched(df, key, text, k), "linhas")
        table, own = classes(rows)
        table = staged(table, "classes")
        cand = candidates(table, least, k=k, **settings)
        links = hold(staged(verified(df, key, text, cand, above, settings.get("load")), "elos"))
        return links, hold(staged(own.join(table.select("fp", "doc"), "fp").select("key", "doc"), "membros"))


def expand_pairs(links: DataFrame, member: DataFrame) -> DataFrame:
    """All pairs of keys: linked classes by their members, and the copies inside each class."""
    a, b = member.select(F.col("key").alias("ka"), F.col("doc").alias("a")), member.select(F.col("key").alias("kb"), F.col("doc").alias("b"))
    between = links.select("a", "b").join(a, "a").join(b, "b").select("ka", "kb")
    several = member.groupBy("doc").count().where("count > 1").select("doc")
    own = member.join(several, "doc")
    inside = own.select(F.col("key").alias("ka"), "doc").join(own.select(F.col("key").alias("kb"), "doc"), "doc").where("ka < kb")
    both = between.unionByName(inside.select("ka", "kb")).where("ka <> kb")
    return both.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(doc, grupo): least key of the connected component, by alternating large and small stars until nothing changes."""
    spark = edges.sparkSession
    with scratch(spark) as hold:
        e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "estrela")
        while True:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            small_min = large.groupBy("u").agg(F.min("v").alias("m"))
            nxt = (
                large.join(small_min, "u")
                .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                .select("x.u", "x.v")
                .where("u <> v")
                .distinct()
            )
            nxt = staged(nxt, "estrela")
            same = nxt.count() == e.count() and nxt.join(e, ["u", "v"], "left_anti").isEmpty()
            e = nxt
            if same:
                break
        stars = e.groupBy("u").agg(F.min("v").alias("grupo")).select(F.col("u").alias("doc"), "grupo")
        return hold(staged(stars.unionByName(stars.select(F.col("grupo").alias("doc"), "grupo").distinct()), "grupos"))


def groups(links: DataFrame, member: DataFrame) -> DataFrame:
    """(key, classe, grupo, elos): one row per key; copies share a classe, similar classes a grupo; ``elos``
    counts the other classes that the key's class is linked to."""
    comp = components(links.select("a", "b"))
    ends = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("elos"))
    d = member.join(comp, "doc", "left").join(ends, "doc", "left")
    return d.select("key", F.col("doc").alias("classe"), F.coalesce("grupo", "doc").alias("grupo"), F.coalesce("elos", F.lit(0)).alias("elos"))
