"""Operators on whole inputs, against brute force."""

import random

import __spark_entry__ as entry
from sparkloom.operators import graph

SF = "/root/testdata/sf0.001"


def test_call_tree_keeps_every_path(spark):
    rng = random.Random(3)
    calls = {(rng.randrange(60), rng.randrange(60)) for _ in range(600)}
    level, wanted = [(7,)], {(7,)}
    for _ in range(3):
        level = [p + (d,) for p in level if p[-1] not in p[:-1] for s, d in calls if s == p[-1]]
        wanted |= set(level)
    got = graph.call_tree(spark.createDataFrame(list(calls), "src long, dst long"), 7, 3, most=None).collect()
    assert len(wanted) > 400 and len(got) == len(wanted) and {tuple(r["path"]) for r in got} == wanted


def test_whole_tables(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    run = lambda name: entry.queries()[name](spark, SF)
    order = {}
    for r in sorted(read("lineitem").collect(), key=lambda r: (r["l_orderkey"], r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_extendedprice"])):
        order.setdefault(r["l_orderkey"], []).append(r["l_partkey"])
    calls = {e for parts in order.values() for e in zip(parts, parts[1:])}
    name = {r["p_partkey"]: r["p_name"] for r in read("part").collect()}
    assert max(s for s, _ in calls) > 50
    assert {(r["node"], r["id"]) for r in run("callees").collect()} == {(s, d) for s, d in calls if d in name}
    assert {(r["node"], r["id"]) for r in run("callers").collect()} == {(d, s) for s, d in calls if s in name}
    context = {r["id"]: (r["callees"], r["callers"]) for r in run("symbol_context").collect()}
    names = lambda ids: ",".join(sorted({name[i] for i in ids if i in name})) or None
    assert context == {i: (names(d for s, d in calls if s == i), names(s for s, d in calls if d == i)) for i in name}
    tree = [r["path"] for r in run("call_tree").collect()]
    first = [(7, d) for s, d in calls if s == 7]
    wanted = [(7,), *first, *(p + (d,) for p in first if p[1] != 7 for s, d in calls if s == p[1])]
    assert sorted(tree) == sorted(">".join(map(str, p)) for p in wanted)
    supplier = {r["s_suppkey"]: r for r in read("supplier").collect()}
    customer = {r["c_custkey"]: r["c_nationkey"] for r in read("customer").collect()}
    home = {r["o_orderkey"]: customer[r["o_custkey"]] for r in read("orders").collect() if r["o_custkey"] in customer}
    uses = {(r["l_orderkey"], r["l_partkey"], r["l_suppkey"], r["l_linenumber"]) for r in read("lineitem").collect() if r["l_orderkey"] in home and r["l_suppkey"] in supplier}
    tiers = {}
    for o, _, s, _ in uses:
        x = supplier[s]
        tier = 1 if home[o] == x["s_nationkey"] else 3 if x["s_acctbal"] > 0 else None
        tiers[tier] = tiers.get(tier, 0) + 1
    assert {r["tier"]: r["n"] for r in run("resolution_tiers").collect()} == tiers
