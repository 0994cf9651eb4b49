"""Retrieval quality: metrics per query, profiles, Pareto frontier, paired comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.search import in_order


def metrics(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, hit1, rr10, ndcg10, recall5, recall10); a document counts once, at its best rank. ``runs`` (query_id, rank, id), ``qrels`` (query_id, id, grade)."""
    best = runs.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    judged = qrels.groupBy("query_id", "id").agg(F.max("grade").alias("grade")).where("grade > 0")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = judged.withColumn("r", F.row_number().over(order)).where("r <= 10").groupBy("query_id").agg(F.sum(gain / F.log2(F.col("r") + 1)).alias("ideal"))
    size = judged.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = best.join(judged, ["query_id", "id"]).groupBy("query_id").agg(
        F.max((F.col("rank") <= 1).cast("double")).alias("hit1"),
        F.max(F.when(F.col("rank") <= 10, 1 / F.col("rank"))).alias("rr10"),
        F.sum(F.when(F.col("rank") <= 10, gain / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.sum((F.col("rank") <= 5).cast("double")).alias("h5"),
        F.sum((F.col("rank") <= 10).cast("double")).alias("h10"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return size.join(ideal, "query_id").join(hits, "query_id", "left").select("query_id", zero("hit1").alias("hit1"), zero("rr10").alias("rr10"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg10"), zero(F.col("h5") / F.col("relevant")).alias("recall5"), zero(F.col("h10") / F.col("relevant")).alias("recall10"))


def profile_summary(rows: DataFrame) -> DataFrame:
    """(profile, ndcg10, rr10, p50, p95): means to three decimals and linear latency percentiles."""
    return rows.groupBy("profile").agg(F.round(F.avg("ndcg10"), 3).alias("ndcg10"), F.round(F.avg("rr10"), 3).alias("rr10"), F.round(F.percentile("latency_ms", 0.5)).cast("long").alias("p50"), F.round(F.percentile("latency_ms", 0.95)).cast("long").alias("p95"))


def pareto(profiles: DataFrame, buckets: int = 256) -> DataFrame:
    """Profiles (name, quality, cost) that no other beats in one and equals in the other: by running maxima over costs, not by pairs.

    Costs are cut into ``buckets`` ranges by approximate quantiles. Each range knows the best quality of the cheaper ranges, so only the
    rows of a range meet in one task.
    """
    best = profiles.groupBy("cost").agg(F.max("quality").alias("quality"))
    cuts = sorted(set(best.approxQuantile("cost", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    ranged = best.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("cost"))) if cuts else F.lit(0))
    # One row for each range.
    tops = ranged.groupBy("_b").agg(F.max("quality").alias("_q")).withColumn("_below", F.max("_q").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "_below")
    cheaper = F.max("quality").over(Window.partitionBy("_b").orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    front = ranged.join(F.broadcast(tops), "_b").withColumn("_less", F.greatest(cheaper, "_below")).where("_less is null or quality > _less").select("cost", "quality")
    return profiles.join(front, ["quality", "cost"], "left_semi")


def recommended(profiles: DataFrame, baseline: str, slo_ms: int) -> DataFrame:
    """The best profile within the latency limit that is not below the baseline in nDCG and MRR."""
    base = profiles.where(F.col("profile") == baseline).select(F.col("ndcg10").alias("b1"), F.col("rr10").alias("b2"))
    return profiles.join(F.broadcast(base)).where("ndcg10 >= b1 and rr10 >= b2").where(F.col("p95") <= slo_ms).orderBy(F.desc("ndcg10"), F.desc("rr10"), "p95", "profile").limit(1).drop("b1", "b2")


def paired(a: DataFrame, b: DataFrame, least: float = 0.05) -> DataFrame:
    """(wins, losses, ties, delta, accepted) of b against a over common queries (query_id, value)."""
    both = a.select("query_id", F.col("value").alias("x")).join(b.select("query_id", F.col("value").alias("y")), "query_id")
    out = both.agg(F.count_if(F.col("y") > F.col("x")).alias("wins"), F.count_if(F.col("y") < F.col("x")).alias("losses"), F.count_if(F.col("y") == F.col("x")).alias("ties"), F.round(F.avg(F.col("y") - F.col("x")), 6).alias("delta"))
    return out.withColumn("accepted", (F.col("delta") >= least) & (F.col("wins") > F.col("losses")))


def upper_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, p90, mean): the middle value, the upper of two, and the value at int(0.9 n), the last at most; nulls do not count."""
    # Places in the order of all rows: those of a group lie side by side, so a group's middle is a place, and no group is gathered.
    own = rows.where(F.col(value).isNotNull()).select(by, value)
    placed = in_order(own, [F.col(by).asc_nulls_first(), F.col(value).asc()], value)
    groups = placed.groupBy(by).agg(F.count("*").alias("n"), F.min("r").alias("first"), F.avg(value).alias("mean"))
    at = groups.withColumns({"middle": F.col("first") + F.floor(F.col("n") / 2), "ninth": F.col("first") + F.least(F.floor(F.col("n") * 9 / 10), F.col("n") - 1)})
    value_at = lambda place, name: placed.select(F.col("r").alias(place), F.col(value).alias(name))
    return at.join(value_at("middle", "median"), "middle").join(value_at("ninth", "p90"), "ninth").select(by, "n", "median", "p90", "mean")


def evaluation_set(commits: DataFrame, known: DataFrame, extensions: tuple[str, ...] = (".py",), least: int = 20) -> DataFrame:
    """(id, query, gold): commits (id, subject, files) as queries with the files that they changed.

    Commits that ask nothing, that changed no or more than three source files outside tests/, or only files that ``known`` (path) did not have, are left out.
    """
    from sparkloom.functions import text as T

    source = lambda f: F.exists(F.array(*map(F.lit, extensions)), lambda e: F.endswith(f, e)) & ~F.startswith(f, F.lit("tests/"))
    rows = commits.where(~T.asks_nothing(F.col("subject"))).withColumn("changed", F.filter("files", source)).where(F.size("changed").between(1, 3))
    rows = rows.select("id", T.query_of(F.col("subject")).alias("query"), F.explode("changed").alias("path")).where(F.length("query") >= least)
    return rows.join(known.select("path"), "path", "left_semi").groupBy("id", "query").agg(F.array_sort(F.collect_set("path")).alias("gold"))


#: Terms for which a text is searched at once.
TERMS = 200


def lexical_baseline(files: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, path, rank): files (path, content) by the number of a query's terms that they hold, by all occurrences, then by the length of their paths.

    ``queries`` (query_id, terms); a term occurs anywhere, whatever its case. Each text is searched once for the distinct terms of all queries, TERMS at a time,
    and only terms that it holds meet the queries that ask for them.
    """
    asked = queries.select("query_id", F.posexplode(F.transform("terms", lambda t: F.lower(t))).alias("i", "term")).where("term <> ''")
    known = sorted(r["term"] for r in asked.select("term").distinct().collect())  # what is asked, in all
    low, found = files.select("path", F.lower("content").alias("text")), None
    for i in range(0, len(known), TERMS):
        times = F.transform(F.array(*map(F.lit, known[i : i + TERMS])), lambda t: F.struct(t.alias("term"), ((F.length("text") - F.length(F.replace("text", t, F.lit("")))) / F.length(t)).cast("long").alias("n")))
        part = low.select("path", F.explode(F.filter(times, lambda x: x["n"] > 0)).alias("x")).select("path", "x.term", "x.n")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return files.sparkSession.createDataFrame([], "query_id long, path string, rank long")
    rows = found.join(asked, "term").groupBy("query_id", "path").agg(F.count("*").alias("distinct"), F.sum("n").alias("hits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("distinct"), F.desc("hits"), F.length("path"), "path")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select("query_id", "path", "rank")


def tokens_until_found(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, tokens): what reading ranked files (query_id, rank, path, tokens) costs until the first wanted one (query_id, path) is in hand; null if none is."""
    running = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    marked = ranked.withColumn("spent", running).join(gold.select("query_id", "path", F.lit(True).alias("wanted")).distinct(), ["query_id", "path"], "left")
    return marked.groupBy("query_id").agg(F.min(F.when(F.col("wanted"), F.col("spent"))).cast("long").alias("tokens"))


def lost_where(pool: DataFrame, ranked: DataFrame, gold: DataFrame, limit: int) -> DataFrame:
    """(query_id, reason): found, ranked_low (in the ``pool`` but not among the first ``limit``) or never_pooled, by the best wanted path of each query."""
    wanted = gold.select("query_id", "path").distinct()
    top = ranked.where(F.col("rank") <= limit).join(wanted, ["query_id", "path"], "left_semi").select("query_id").distinct().withColumn("top", F.lit(True))
    seen = pool.join(wanted, ["query_id", "path"], "left_semi").select("query_id").distinct().withColumn("seen", F.lit(True))
    out = wanted.select("query_id").distinct().join(top, "query_id", "left").join(seen, "query_id", "left")
    return out.select("query_id", F.when(F.col("top"), "found").when(F.col("seen"), "ranked_low").otherwise("never_pooled").alias("reason"))


def valid_qrels(qrels: DataFrame) -> DataFrame:
    """(query_id, id, grade): judgements with ids and a grade of 0 at least, the highest of repeated ones."""
    return qrels.where("query_id is not null and id is not null and grade >= 0").groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
