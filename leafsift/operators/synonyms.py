"""Synonyms of terms and of queries. Groups are rows (group_id, pos, term)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.config import SYNONYM_GROUPS


def default_groups(spark: SparkSession) -> DataFrame:
    rows = [(g, p, t) for g, terms in enumerate(SYNONYM_GROUPS) for p, t in enumerate(terms)]
    return spark.createDataFrame(rows, "group_id int, pos int, term string")


def pairs(groups: DataFrame) -> DataFrame:
    """(term, pos, equivalent): each term with the other terms of its group."""
    a = groups.select("group_id", "term")
    b = groups.select("group_id", "pos", F.col("term").alias("equivalent"))
    return a.join(b, "group_id").where("term <> equivalent").select("term", "pos", "equivalent")


def query_synonyms(queries: DataFrame, groups: DataFrame, q: str = "q") -> DataFrame:
    """(q, extras): terms to add to each distinct query.

    A group applies if the lower-cased query contains any of its terms anywhere, even within a word;
    its terms that are not contained are added, in the order of groups and places, each once. The
    groups are a table of settings: they become one array, and each query is matched in its own row.
    """
    g = groups.where("term is not null").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    every = g.agg(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "t"))), lambda x: x["t"]["term"]).alias("__groups"))
    d = queries.select(F.col(q).alias("q")).where("q is not null").distinct().crossJoin(every)  # one row
    low = F.lower("q")
    hit = F.filter("__groups", lambda ts: F.exists(ts, lambda t: low.contains(t)))
    extras = F.array_distinct(F.flatten(F.transform(hit, lambda ts: F.filter(ts, lambda t: ~low.contains(t)))))
    return d.select("q", extras.alias("extras"))


def expand(queries: DataFrame, groups: DataFrame, q: str = "q") -> DataFrame:
    """(q, extras, expandida): the query as written, followed by its extras if there are any."""
    d = query_synonyms(queries, groups, q)
    return d.withColumn(
        "expandida", F.when(F.size("extras") > 0, F.concat_ws(" ", "q", F.array_join("extras", " "))).otherwise(F.col("q"))
    )
