"""Personal data: base patterns plus bootstrapped contextual extraction, as DataFrame functions only.

Base spans of four kinds come from regular expressions. They are the seed entities. Other identifier-like tokens
(a digit, eight or more letters, digits and ``_+/-``) are candidate instances; a candidate inside a match that a base
kind rejected (a number that fails its check) is known to be none. Seeds and candidates induce four kinds of lexical
patterns: the word before (L), the word after (R), the letters that an instance begins with (P), and how those two
words are written (C). Spark scores the graph of patterns and instances in turns: a pattern's confidence is the
smoothed share of trust among the instances it stands beside, an instance's trust the noisy-or of its patterns.
Candidates of high trust with at least one strong L, R or P pattern become spans of kind ``id``; base spans stay.

Spans are in code points, end exclusive. ``split`` gives what stands between matches and ``regexp_extract_all`` the
matches, so running sums of lengths are the positions; they are summed block by block, so the work grows with the
number of matches and not with its square. Every expression starts at the end of a run or match only (``\\G`` or a
look-behind), which keeps long runs linear and gives the same leftmost matches.

Null texts count as empty; texts without a digit or ``@`` have no spans. Very long texts and words are handled whole.
Empty tables give empty results. Results depend on the texts alone, so repeated rows get equal values, ids may repeat
or be null, and other columns do not matter: private columns get names that the input does not have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

#: The base patterns, each with possessive runs and an anchor that leaves its matches as they are.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "id"]
#: A run of at least eight letters, digits and _+/- with a digit.
IDENTIFIER = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{8,}+"
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Least trust of an instance, confidence of a strong pattern and its instances; turns over the graph; instances that a pattern is smoothed by.
TRUST, STRONG, SUPPORT, TURNS, SMOOTH = 0.9, 0.8, 5, 5, 2.0
#: Matches that are summed as one block, and code points that are redacted as one.
CHUNK, BLOCK = 128, 16_384
#: Places of the fixed-size filter that says which texts may have discovered spans.
PLACES = 1 << 20

SPAN = "struct<s:int,k:int,e:int,m:string,left:string,right:string,ok:boolean>"
MATCH = "array<struct<m:string,s:int,before:string,after:string>>"
GUARD = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "id": "[0-9]"}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` as a lambda's variable, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def chunked(items: Column, size: int = CHUNK) -> Column:
    """``items`` as an array of arrays of ``size``, one empty array if there are none."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))), lambda i: F.slice(items, i * size + 1, F.lit(size)))


def running(lengths: Column) -> Column:
    """Sum of what stands before each of ``lengths``."""
    start = F.struct(F.lit(0).alias("at"), none("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def occurrences(text: Column, pattern: str) -> Column:
    """Array of (m, s, before, after): every match, its start and the texts between it and its neighbours."""
    found = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))

    def pairs(f: Column) -> Column:
        n = F.size(f["matches"])
        return F.arrays_zip(f["matches"].alias("matches"), F.slice(f["parts"], 1, n).alias("before"), F.slice(f["parts"], 2, n).alias("after"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["before"])
        one = F.struct(x["matches"].alias("m"), s.alias("s"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((s + F.length(x["matches"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + F.length(x["before"]) + F.length(x["matches"])))
        both = F.arrays_zip(blocks.alias("block"), running(lengths).alias("at"))
        return F.flatten(F.transform(both, lambda z: F.aggregate(z["block"], F.struct(z["at"].alias("at"), none(MATCH).alias("out")), add, lambda acc: acc["out"])))

    return bound(found, lambda f: bound(pairs(f), lambda p: bound(chunked(p), placed)))


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` are 12 to 19 and pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)),
    )
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.rlike(match, F.lit(f"^{PART}(?:\\.{PART}){{3}}$"))
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def tagged(text: Column, kind: str, pattern: str) -> Column:
    """Array of SPAN: the matches of ``kind`` in ``text`` with the words beside them; ``ok``: they pass its check."""
    own = F.when(F.rlike(text, F.lit(GUARD[kind])), occurrences(text, pattern)).otherwise(none(MATCH))
    return F.transform(
        own,
        lambda x: F.struct(
            x["s"].alias("s"),
            F.lit(KINDS.index(kind)).alias("k"),
            (x["s"] + F.length(x["m"])).alias("e"),
            x["m"].alias("m"),
            # Words are compared without the punctuation at their ends.
            F.regexp_extract(x["before"], r"(?<![\p{L}\p{N}])([\p{L}\p{N}]++)[^\p{L}\p{N}]*+$", 1).alias("left"),
            F.regexp_extract(x["after"], r"^[^\p{L}\p{N}]*+([\p{L}\p{N}]++)", 1).alias("right"),
            valid(kind, x["m"]).alias("ok"),
        ),
    )


def base_matches(text: Column) -> Column:
    """Array of SPAN: the matches of all base kinds by start, then kind, also those that fail their check."""
    return F.array_sort(F.concat(*(tagged(text, k, p) for k, p in PATTERNS.items())))


def candidates(text: Column, matches: Column) -> Column:
    """Array of SPAN: identifier-like tokens outside valid base spans; ``ok`` is false inside a rejected match."""

    def judged(tokens: Column) -> Column:
        lo, hi = F.element_at(tokens, 1)["s"], F.element_at(tokens, -1)["e"]
        beside = F.filter(matches, lambda b: (b["s"] < hi) & (lo < b["e"]))
        return bound(
            beside,
            lambda near: F.transform(
                F.filter(tokens, lambda t: ~F.exists(near, lambda b: b["ok"] & (b["s"] < t["e"]) & (t["s"] < b["e"]))),
                lambda t: t.withField("ok", ~F.exists(near, lambda b: (b["s"] <= t["s"]) & (t["e"] <= b["e"]))),
            ),
        )

    return bound(tagged(text, "id", IDENTIFIER), lambda own: F.flatten(F.transform(chunked(own), lambda part: F.when(F.size(part) > 0, judged(part)).otherwise(none(f"array<{SPAN}>")))))


def find(docs: DataFrame, base: str, others: str) -> DataFrame:
    """``docs`` with columns ``base`` (valid base spans) and ``others`` (candidates), both arrays of SPAN by start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = fresh("raw", docs.columns)
    out = docs.withColumn(raw, base_matches(text)).withColumn(others, candidates(text, F.col(raw)))
    return out.withColumn(base, F.filter(raw, lambda x: x["ok"])).drop(raw)


def case_of(word: Column) -> Column:
    return F.when(word == "", "none").when(word.rlike(r"^\p{N}"), "digit").when(word.rlike(r"^\p{Lu}"), "upper").otherwise("lower")


def edges(found: DataFrame) -> DataFrame:
    """Distinct (kind, pattern, instance, seed, no): each entity with its patterns, however often they stand together; ``no``: known to be none."""
    entity = lambda seed: lambda x: F.struct(x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right"), F.lit(seed).alias("seed"), (~x["ok"]).alias("no"))
    rows = found.select(F.explode(F.concat(F.transform("base", entity(True)), F.transform("others", entity(False)))).alias("x")).select("x.*")
    of = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("pattern"))
    patterns = F.array(
        of("L", F.lower("left")), of("R", F.lower("right")), of("C", F.concat_ws(" ", case_of(F.col("left")), case_of(F.col("right")))), of("P", F.left(F.regexp_extract("m", "^([A-Za-z]{3,}+)", 1), F.lit(4)))
    )
    sides = rows.select(F.col("m").alias("instance"), "seed", "no", F.explode(patterns).alias("p")).select("p.kind", "p.pattern", "instance", "seed", "no")
    return sides.where("pattern <> ''").groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.max("no").alias("no"))


def trusted(found: DataFrame) -> DataFrame:
    """Instances that are no seeds and reach TRUST after TURNS turns over the graph: (instance)."""
    graph = staged(edges(found), "pii-graph")
    links = graph.select("kind", "pattern", "instance")
    known = staged(graph.groupBy("instance").agg(F.max("seed").alias("seed"), F.max("no").alias("no")), "pii-instances")
    trust = known.select("instance", "seed", "no", F.col("seed").cast("double").alias("trust"), F.lit(0).alias("strong"))
    for turn in range(TURNS):
        # A pattern is believed by what it stands beside; smoothing keeps rare ones low.
        scored = links.join(trust.select("instance", "trust"), "instance").groupBy("kind", "pattern").agg((F.sum("trust") / (F.count("*") + SMOOTH)).alias("confidence"), F.count("*").alias("support"))
        scored = staged(scored.where("support > 1"), f"pii-patterns-{turn}")
        # Ways of writing two words are 16 at most, and nearly all instances have the same few, so they are sent.
        common = links.where("kind = 'C'").join(F.broadcast(scored.where("kind = 'C'")), ["kind", "pattern"])
        near = links.where("kind <> 'C'").join(scored.where("kind <> 'C'"), ["kind", "pattern"]).unionByName(common)
        strong = (F.col("kind") != "C") & (F.col("confidence") >= STRONG) & (F.col("support") >= SUPPORT)
        doubt = near.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))).alias("new"), F.max(strong.cast("int")).alias("strong"))
        value = F.when(F.col("seed"), 1.0).when(F.col("no"), 0.0).otherwise(F.coalesce("new", F.lit(0.0)))
        trust = staged(known.join(doubt, "instance", "left").select("instance", "seed", "no", value.alias("trust"), F.coalesce("strong", F.lit(0)).alias("strong")), f"pii-trust-{turn}")
    return trust.where((~F.col("seed")) & (~F.col("no")) & (F.col("trust") >= TRUST) & (F.col("strong") > 0)).select("instance")


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def discovered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, extra): (doc_id, text_key, base, others) of every row, and (text_key, more) of the texts with discovered spans."""
    found = staged(find(docs.select("doc_id", "text"), "base", "others").select("doc_id", text_key(F.col("text")).alias("text_key"), "base", "others"), "pii-found")
    seen = found.where(F.size("others") > 0).select("text_key", F.explode("others").alias("c")).distinct()
    extra = seen.join(trusted(found), seen["c.m"] == F.col("instance")).groupBy("text_key").agg(F.collect_set("c").alias("more"))
    return found, staged(extra, "pii-extra")


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row, arrays of SPAN; ``spans`` holds base and discovered spans by start, then kind."""
    found, extra = discovered(docs)
    # Most texts have no candidate, and equal ones would meet in one task: they need no join.
    alone = found.where(F.size("others") == 0).select("doc_id", "base", F.col("base").alias("spans"))
    more = found.where(F.size("others") > 0).join(extra, "text_key", "left")
    return alone.unionByName(more.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none(f"array<{SPAN}>")))).alias("spans")))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def without(text: Column, spans: Column) -> Column:
    """``text`` with ``spans`` (by start) replaced by <KIND>, block by block of the text."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def cleaned(b: Column, lo: Column) -> Column:
        own = F.filter(spans, lambda x: (x["s"] < lo + F.length(b)) & (x["e"] > lo))

        def put(acc: Column, x: Column) -> Column:
            piece = F.array(F.substring(b, acc["end"] - lo + 1, x["s"] - acc["end"]), F.element_at(names, x["k"] + 1))
            out = F.when((x["s"] >= lo) & (x["s"] >= acc["end"]), F.concat(acc["out"], piece)).otherwise(acc["out"])
            return F.struct(F.greatest(acc["end"], x["e"]).alias("end"), out.alias("out"))

        start = F.struct(lo.alias("end"), none("array<string>").alias("out"))
        return F.aggregate(own, start, put, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(b, acc["end"] - lo + 1, F.length(b))))

    def joined(blocks: Column) -> Column:
        both = F.arrays_zip(blocks.alias("block"), running(F.transform(blocks, lambda b: F.length(b))).alias("at"))
        return F.array_join(F.transform(both, lambda z: cleaned(z["block"], z["at"])), "")

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), joined)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by <KIND>; overlapping spans are replaced together, under the first one's kind.

    Null texts stay null. Where ``docs`` has n_chars, it is counted anew. Texts are not shuffled, but for those that a
    filter of PLACES places says may have discovered spans.
    """
    key, place, extra, spans = names = fresh_names(("key", "place", "extra", "spans"), docs.columns)
    more = discovered(docs)[1].select(F.col("text_key").alias(key), F.transform("more", lambda x: F.struct(x["s"], x["k"], x["e"])).alias(extra))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES)).cast("int")
    # PLACES rows at most, whatever the corpus.
    places = F.broadcast(more.select(at(key).alias(place)).distinct())
    keyed = docs.withColumn(key, text_key(F.col("text"))).withColumn(place, at(key))
    some = keyed.join(places, place, "left_semi").join(more, key, "left")
    rest = keyed.join(places, place, "left_anti").withColumn(extra, F.lit(None).cast("array<struct<s:int,k:int,e:int>>"))
    both = some.unionByName(rest)
    base = F.transform(F.filter(base_matches(F.coalesce(F.col("text"), F.lit(""))), lambda x: x["ok"]), lambda x: F.struct(x["s"], x["k"], x["e"]))
    out = both.withColumn(spans, F.array_sort(F.concat(base, F.coalesce(extra, none("array<struct<s:int,k:int,e:int>>")))))
    hit = F.col("text").isNotNull() & (F.size(spans) > 0)
    clean = F.when(hit, without(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    if "n_chars" not in docs.columns:
        return out.withColumn("text", clean).drop(*names).select(*docs.columns)
    length = F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    out = out.withColumn("text", clean)
    return out.withColumn("n_chars", length).select(*docs.columns)


def fresh_names(names: Iterable[str], taken: list[str]) -> list[str]:
    return [fresh(n, taken) for n in names]
