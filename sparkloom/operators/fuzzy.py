"""A dictionary of names that finds what is within one edit by equal keys: no name is compared with names that share no key.

Keys of a name are the name itself and what is left of it without one of its letters. Names one insertion, deletion, substitution or swap of neighbours
apart share a key; what shares a key is then checked exactly. Names are distinct in the dictionary, so a key of n letters has at most n + 1
times as many holders as there are letters, however many rows carry one name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(name: Column) -> Column:
    """The distinct keys of a name."""
    cut = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.left(name, i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), F.when(F.length(name) > 0, cut).otherwise(F.expr("cast(array() as array<string>)"))))


def one_edit(a: Column, b: Column) -> Column:
    """Whether ``a`` is ``b`` but for one insertion, deletion, substitution or swap of neighbours at most."""
    # The first place where they differ; a swap has the two letters after it exchanged and nothing else.
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1))
    swap = F.exists(places, lambda i: F.concat(F.left(a, i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & swap)


def dictionary(rows: DataFrame, name: Column) -> DataFrame:
    """(name, n): the distinct lower-cased names of ``rows`` and how many rows have each; nulls are left out."""
    return rows.select(F.lower(name).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


def keyed(names: DataFrame) -> DataFrame:
    """(key, name, n): the written form of a dictionary, by which it is searched."""
    return names.select(F.explode(deletions(F.col("name"))).alias("key"), "name", "n")


def near_names(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(asked, name, n, distance): all names of ``keys`` within one edit of each name of ``asked`` (asked); distance 0 or 1. Case does not count."""
    own = asked.select(F.lower("asked").alias("asked")).where("asked is not null").distinct()
    pairs = own.select("asked", F.explode(deletions(F.col("asked"))).alias("key")).join(keys, "key").select("asked", "name", "n").distinct()
    return pairs.where(one_edit(F.col("asked"), F.col("name"))).withColumn("distance", (F.col("asked") != F.col("name")).cast("int"))
