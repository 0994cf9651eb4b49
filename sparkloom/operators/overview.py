"""What a project overview shows: modules, exports, members, keywords, domains, languages, technology, business rules.

Knowledge comes as small tables: ``domains`` (domain, keyword, behavior, priority), ``stacks`` (category, package) and ``rules`` (rule_id, condition, severity, message).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

#: Words of names that say nothing of a domain (fixed values).
NAME_STOPWORDS = tuple(
    "get set new create handle process validate generate build make init initialize setup update delete add remove is has can should will do does to from with without show hide toggle open close render mount"
    " props state ref component element node children child parent root container wrapper icon button input form field label text item list menu modal dialog popup tooltip"
    " data value result response request error callback handler listener event action type interface class function method property".split()
)
#: Names of languages by file extension (fixed values).
LANGUAGE_NAMES = {
    "Rust": ("rs",), "TypeScript": ("ts", "tsx"), "JavaScript": ("js", "jsx"), "Python": ("py",), "Go": ("go",), "Java": ("java",), "C++": ("cpp", "cc", "cxx"), "C": ("c", "h"), "PHP": ("php",), "Ruby": ("rb",), "Swift": ("swift",), "Kotlin": ("kt", "kts"), "C#": ("cs",),
}
#: Domains of the words of names (fixed values).
DOMAINS = {
    "Authentication": "jwt token bearer refresh auth login signin session", "OAuth2": "oauth oauth2 openid oidc authorize consent", "Security": "encrypt decrypt hash crypto secret key cipher",
    "Password Management": "password credential passphrase", "Authorization": "permission role access rbac acl", "Database": "sql query migration schema table column index seed database db",
    "Caching": "cache ttl invalidate redis memcached", "File Storage": "upload download blob storage bucket file s3", "Email": "smtp mail email mailer inbox newsletter", "WebSocket": "socket websocket realtime broadcast emit",
    "HTTP/API": "route endpoint middleware controller handler request response api", "Payments": "payment invoice billing checkout subscription charge stripe", "Job Queue": "worker job queue background cron scheduler",
    "Testing": "test spec mock stub assert fixture expect", "Logging/Monitoring": "log logger trace metric monitor alert span", "Validation": "validate constraint rule sanitize", "AI/LLM": "llm embedding prompt completion model inference vector openai anthropic",
    "User Management": "user profile account", "Notifications": "notification message notify", "Infrastructure": "deploy deployment infra infrastructure terraform docker kubernetes", "Configuration": "config configuration settings env environment",
}


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n): the number of rows of each table, 0 for empty ones."""
    rows = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in sorted(tables.items())]
    return reduce(DataFrame.unionByName, rows)


def by_kind(rows: DataFrame, kind: str = "kind") -> DataFrame:
    return rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def module_stats(symbols: DataFrame) -> DataFrame:
    """(module, files, symbols, functions, classes, interfaces, structs, methods)."""
    of = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    return symbols.groupBy("module").agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("symbols"), of("Function", "functions"), of("Class", "classes"), of("Interface", "interfaces"), of("Struct", "structs"), of("Method", "methods"))


def modules_of(symbols: DataFrame, depth: int = 2, keep_small: int = 3) -> DataFrame:
    """(module, files, symbols): files by their first ``depth`` folders, without configuration files at the root, without auxiliary folders, and
    without modules of one file with fewer than ``keep_small`` symbols."""
    own = symbols.select("file_path", T.module_of(F.col("file_path"), depth).alias("module"))
    root_config = (F.col("module") == "") & F.col("file_path").rlike(r"\.(?:[mc]?js|ts|json)$")
    auxiliary = F.lower("module").rlike(r"(?:^|/)(?:tests?|mocks?|fixtures?|scripts?|examples?|bench(?:es)?|vendor|third[_-]party|\.github)(?:/|$)")
    grouped = own.where(~root_config & ~auxiliary).groupBy("module").agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("symbols"))
    return grouped.where((F.col("files") > 1) | (F.col("symbols") >= keep_small))


def export_groups(exported: DataFrame) -> DataFrame:
    """(label, names): exported names by label, both in order."""
    return exported.groupBy("label").agg(F.array_sort(F.collect_list("name")).alias("names"))


def type_members(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, fields, methods): sorted names of what a type defines."""
    member = symbols.select(F.col("id").alias("to_id"), "name", F.col("kind").alias("member_kind"))
    rows = relationships.where("kind = 'Defines'").join(member, "to_id")
    of = lambda kinds: F.array_sort(F.collect_set(F.when(F.col("member_kind").isin(*kinds), F.col("name"))))
    return rows.groupBy(F.col("from_id").alias("id")).agg(of(("Field", "Variable", "Constant")).alias("fields"), of(("Method", "Function")).alias("methods"))


def class_members(symbols: DataFrame) -> DataFrame:
    """(class_name, signatures): signatures of a class's members, in order."""
    return symbols.where("class_name is not null and signature is not null").groupBy("class_name").agg(F.array_sort(F.collect_list("signature")).alias("signatures"))


def keywords(symbols: DataFrame, top: int | None = None, by: list[str] | None = None, stop: tuple[str, ...] = NAME_STOPWORDS) -> DataFrame:
    """([by...,] word, n): how often the words of public names occur, without stop words and words of up to two letters; the ``top`` most frequent."""
    by = by or []
    words = symbols.where("visibility = 'Public'").select(*by, F.explode(T.split_identifier(F.col("name"))).alias("word")).withColumn("word", F.lower("word"))
    out = words.where((F.length("word") > 2) & ~F.col("word").isin(*stop)).groupBy(*by, "word").agg(F.count("*").alias("n"))
    if top is None:
        return out
    if not by:
        return out.orderBy(F.desc("n"), "word").limit(top)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))).where(F.col("_r") <= top).drop("_r")


def domain_of(word: Column) -> Column:
    """The domain that a word speaks of, null without one."""
    out = F.lit(None).cast("string")
    for name, words in DOMAINS.items():
        out = F.when(word.isin(*words.split()), name).otherwise(out)
    return out


def word_domains(words: DataFrame) -> DataFrame:
    """(domain, first): the domains of ``words`` (word, n), each at the rank of its first word; ranks follow n."""
    ranked = words.withColumn("domain", domain_of(F.col("word"))).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "word")))
    return ranked.where("domain is not null").groupBy("domain").agg(F.min("r").cast("long").alias("first"))


def knowledge_matches(words: DataFrame, domains: DataFrame, module: str = "module", boost: int = 5) -> DataFrame:
    """(module, domain, behavior, priority, matches): domains whose keywords the module's words match, wholly or as a beginning of one another.

    ``words`` (module, word); each word counts once for a domain, and ``boost`` words more if the module's own last folder matches. Both sides
    meet by their first letter; whether knowledge is small enough to be sent is the planner's choice.
    """
    both = lambda x: (x == F.col("keyword")) | F.startswith(x, F.col("keyword")) | F.startswith(F.col("keyword"), x)
    known = domains.withColumn("keyword", F.lower("keyword")).where("keyword <> ''")
    # Words that may match begin alike, which makes an equi-join of it.
    first = lambda c: F.left(c, F.lit(1)).alias("first")
    own = words.select(module, F.lower("word").alias("word")).distinct()
    hits = own.select("*", first(F.col("word"))).join(known.select("*", first(F.col("keyword"))), "first").where(both(F.col("word")))
    counted = hits.groupBy(module, "domain", "behavior", "priority").agg(F.count_distinct("word").alias("matches"))
    name = F.lower(F.substring_index(F.col(module), "/", -1))
    named = own.select(module).distinct().select(module, name.alias("name")).where(~F.col("name").isin("src", "lib", "app", "bin", "")).select("*", first(F.col("name"))).join(known.select("*", first(F.col("keyword"))), "first").where(both(F.col("name")))
    extra = named.select(module, "domain").distinct().withColumn("extra", F.lit(boost))
    return counted.join(extra, [module, "domain"], "left").select(module, "domain", "behavior", "priority", (F.col("matches") + F.coalesce("extra", F.lit(0))).cast("long").alias("matches"))


def package_categories(packages: DataFrame, stacks: DataFrame) -> DataFrame:
    """(category, packages): packages (name) whose name holds a known one of the category, in order."""
    known = stacks.select("category", F.lower("package").alias("package")).where("package <> ''").distinct()
    sizes = sorted(r["n"] for r in known.select(F.length("package").alias("n")).distinct().collect())  # a few lengths
    low, none = F.lower("name"), F.expr("cast(array() as array<string>)")
    # The parts of a name that are as long as a known one are join keys.
    long = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))).otherwise(none)
    parts = F.flatten(F.array(*map(long, sizes))) if sizes else none
    hits = packages.select("name").distinct().select("name", F.explode(F.array_distinct(parts)).alias("package")).join(known, "package")
    return hits.groupBy("category").agg(F.array_sort(F.collect_set("name")).alias("packages"))


def rule_column(condition: str) -> Column:
    """A business rule's condition over (domains, libraries, keywords, categories: arrays, has_entry: boolean).

    ``has_domain:X``, ``has_library:A,B`` (any), ``has_keyword:X``, ``has_category:X``, ``has_entry_point``, joined from left to right by AND and OR, without
    precedence; NOT turns the next one. Other words are passed.
    """
    out, negate, both = F.lit(True), False, True
    lists = {"has_domain": "domains", "has_library": "libraries", "has_keyword": "keywords", "has_category": "categories"}
    for token in condition.split():
        if token in ("AND", "OR"):
            both = token == "AND"
            continue
        if token == "NOT":
            negate = True
            continue
        name, _, value = token.partition(":")
        if name in lists:
            values = value.split(",") if name == "has_library" else [value]
            own = F.arrays_overlap(lists[name], F.array(*map(F.lit, values)))
        elif token == "has_entry_point":
            own = F.col("has_entry")
        else:
            continue
        own = F.coalesce(own, F.lit(False))
        own = ~own if negate else own
        out, negate = (out & own if both else out | own), False
    return out


def triggered_rules(facts: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(module, rule_id, severity, message) of the rules (id, condition, severity, message) that hold for each row of ``facts``."""
    found = F.array(*(F.when(rule_column(condition), F.struct(F.lit(i).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))) for i, condition, severity, message in rules))
    return facts.select("module", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("module", "x.*")


def language_shares(files: DataFrame, top: int = 3) -> DataFrame:
    """(language, n, share): the ``top`` languages of ``files`` (path) by extension, with rounded percentages of all known files."""
    ext = T.extension(F.col("path"))
    name = F.lit(None).cast("string")
    for language, exts in LANGUAGE_NAMES.items():
        name = F.when(ext.isin(*exts), language).otherwise(name)
    counted = files.select(name.alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("n"))
    # At most as many rows as languages.
    total = F.sum("n").over(Window.partitionBy())
    return counted.withColumn("share", F.round(100.0 * F.col("n") / total, 0)).orderBy(F.desc("n"), "language").limit(top)


def tree_stats(tree: DataFrame) -> DataFrame:
    """(nodes, depth, cycles, truncated) of a call tree (path, depth, reason)."""
    return tree.agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.coalesce(F.bool_or(F.col("reason") == "recursive"), F.lit(False)).alias("cycles"), F.coalesce(F.bool_or(F.col("reason") == "depth"), F.lit(False)).alias("truncated"))


def cycle_counts(tree: DataFrame) -> DataFrame:
    """(id, cycles): how often a symbol ends a path that it is on already."""
    return tree.where("reason = 'recursive'").groupBy(F.element_at("path", -1).alias("id")).agg(F.count("*").alias("cycles"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """(collection, chunks, files)."""
    return chunks.groupBy("collection").agg(F.count("*").alias("chunks"), F.count_distinct("source_path").alias("files"))


def approximate(rows: DataFrame, by: str, value: str, error: float = 0.02) -> DataFrame:
    """(by, n, distinct, median): approximate distinct values and median of each group, in bounded memory."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.approx_count_distinct(value, error).alias("distinct"), F.approx_percentile(value, 0.5, F.lit(10_000)).alias("median"))
