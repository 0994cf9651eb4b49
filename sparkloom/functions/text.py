"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a code or prose query (fixed values).
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "what", "where", "which", "with")


def tokens(text: Column) -> Column:
    """Lower-cased ASCII word tokens."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def query_terms(text: Column, least: int = 3) -> Column:
    """Distinct tokens of at least ``least`` characters that are no stop words."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~t.isin(*STOPWORDS)))


def split_identifier(name: Column) -> Column:
    """Parts of a camel, Pascal, snake or kebab case name; acronyms stay whole."""
    return F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])[0-9]*|[A-Z]?[a-z0-9]+|[0-9]+)"), F.lit(1))


def expand_identifiers(text: Column) -> Column:
    """The text followed by the lower-cased parts of its compound words."""
    words = F.split(text, r"[^A-Za-z0-9_\-]+")
    parts = F.flatten(F.transform(words, lambda w: F.when(F.size(split_identifier(w)) > 1, F.transform(split_identifier(w), lambda p: F.lower(p))).otherwise(F.expr("cast(array() as array<string>)"))))
    return F.concat_ws(" ", text, F.array_join(F.array_distinct(parts), " "))


def ngrams(text: Column, least: int = 3, most: int = 10) -> Column:
    """All substrings of ``least`` to ``most`` characters; case stays."""
    sizes = F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(most), F.length(text))))
    own = F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, n)))
    return F.filter(F.flatten(own), lambda g: F.length(g) >= least)


def coverage(terms: Column, haystack: Column) -> Column:
    """Share of ``terms`` that occur in ``haystack``; 0 without terms."""
    low = F.lower(haystack)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms))


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob: ``**`` crosses folders, ``*`` and ``?`` do not; ``x/**`` also fits below any folder."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^(?:.*/)?{out}$" if not pattern.startswith("/") else f"^{out}$"


def module_of(path: Column, depth: int = 2) -> Column:
    """The first ``depth`` folders of a path."""
    folders = F.split(F.regexp_replace(path, r"^(\./)?/*", ""), "/")
    return F.array_join(F.slice(folders, 1, F.least(F.lit(depth), F.size(folders) - 1)), "/")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def token_estimate(text: Column) -> Column:
    """Number of words, 1 at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def preview(text: Column, terms: Column, radius: int = 60, marks: str = "") -> Column:
    """Key word in context: ``radius`` characters to either side of where the earliest term starts, widened to whole words; else the text's head.

    ``marks`` stands where text is left out.
    """
    low = F.lower(text)
    places = F.filter(F.transform(terms, lambda t: F.instr(low, F.lower(t))), lambda p: p > 0)
    at = F.coalesce(F.array_min(places), F.lit(1)) - 1
    lo, hi = F.greatest(F.lit(0), at - radius), F.least(F.length(text), at + radius)
    # A word that the window cuts is taken whole.
    start = F.when(lo == 0, 0).otherwise(lo - F.length(F.regexp_extract(F.substring(text, F.lit(1), lo), r"(\S*)$", 1)))
    rest = F.length(F.regexp_extract(F.substring(text, hi + 1, F.length(text)), r"^(\S*)", 1))
    end = hi + rest
    own = F.substring(text, start + 1, end - start)
    return F.concat(F.when(start > 0, marks).otherwise(""), own, F.when(end < F.length(text), marks).otherwise(""))


def highlight(text: Column, words: str, start: str = "**", end: str = "**") -> Column:
    """Occurrences of the words of two letters or more between ``start`` and ``end``; those parted by blanks or tabs only are joined."""
    own = sorted({w.lower() for w in words.split() if len(w) > 1}, key=lambda w: (-len(w), w))
    if not own:
        return text
    one = "(?:" + "|".join(map(re.escape, own)) + ")"
    mark = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, f"(?i)({one}(?:[ \\t]*{one})*)", f"{mark(start)}$1{mark(end)}")


def truncate_chars(text: Column, most: int) -> Column:
    return F.left(text, F.lit(most))


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest head of whole characters within ``most`` bytes."""
    # A character whose last bytes were cut off is one that starts near the end and is shorter than its first byte says.
    head = F.regexp_replace(F.hex(F.substring(F.encode(text, "UTF-8"), 1, most)), "(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(head), "UTF-8"))


def truncate_display(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of which say that something is left out."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(0, most - 3))), F.lit("...")))


def window_around(text: Column, at: Column, radius: int) -> Column:
    """``radius`` characters to either side of place ``at`` (counted from 0)."""
    lo = F.greatest(F.lit(0), at - radius)
    return F.substring(text, lo + 1, at + radius - lo)


def relative_time(then: Column, now: Column) -> Column:
    """Seconds, minutes, hours or days ago; the date beyond a week."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .when(s < 7 * 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def qualified_name(class_name: Column, module: Column, name: Column) -> Column:
    return F.coalesce(F.concat_ws("::", F.when(class_name.isNotNull(), class_name), name), F.concat_ws("::", module, name), name)


def source_class(path: Column) -> Column:
    """generated, tests, types or impl, by parts of the path; the first that fits."""
    low = F.lower(path)
    has = lambda *parts: _any([F.contains(low, F.lit(x)) for x in parts])
    ends = lambda *parts: _any([F.endswith(low, F.lit(x)) for x in parts])
    generated = has("/generated/", "__generated__", ".generated.") | ends(".gen.ts")
    types = ends(".d.ts", "types.ts", "type.ts") | has("/types/")
    return F.when(generated, "generated").when(has("/__tests__/", "/tests/", ".test.", ".spec."), "tests").when(types, "types").otherwise("impl")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


#: Path patterns whose chunks are never results (fixed values).
HARD_IGNORE = ("evals/**", "**/*.eval.*", *(f"{x}{d}/**" for d in ("target", "node_modules", ".venv", "venv", ".venv-quant", ".next", ".nuxt", ".svelte-kit", "dist", "build", "out") for x in ("", "**/")))
#: Words that a search does not look for (fixed values).
QUERY_STOPWORDS = ("the", "a", "an", "for", "to", "of", "in", "on", "and", "or", "with", "by", "is", "are", "this", "that", "how", "what", "where", "when")
#: Names of functions whose callers say nothing (fixed values).
TRIVIAL_NAMES = ("new", "default", "len", "clone", "to_string", "fmt", "from", "into", "as_ref", "as_mut")


def normalised(path: Column) -> Column:
    """Slashes only, without ./ in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def matches_any(path: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """Whether a path fits one of the globs."""
    if not patterns:
        return F.lit(False)
    return normalised(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def in_subtree(path: Column, root: str) -> Column:
    """Whether a path lies below the folder ``root``; both without ./ or / in front. An empty root holds all."""
    root = re.sub(r"^(?:\./|/)+", "", root).rstrip("/")
    own = F.regexp_replace(path, r"^(?:\./|/)+", "")
    return F.lit(True) if not root else (own == root) | F.startswith(own, F.lit(root + "/"))


def search_terms(text: str) -> list[str]:
    """What a search looks for: words, also with _ and -, of three letters at least that are no stop words."""
    words = (w.lower() for w in re.split(r"[^\w-]+", text))
    return [w for w in words if len(w) >= 3 and w not in QUERY_STOPWORDS]


def is_trivial_call(qualified: Column, kind: Column) -> Column:
    """Calls that call trees leave out: accessors, iterators, display, logging, plain constructors."""
    ends = ("len", "is_empty", "is_some", "is_none", "is_ok", "is_err", "value", "metadata", "as_str", "to_string", "into", "iter", "collect", "map", "filter", "for_each", "CURSOR_PREV_LINE", "CURSOR_NEXT_LINE", "clear_line", "elapsed", "duration", "timing", "measure")
    inside = ("merge", "symbols_in_file", "status_line::", "progress::", "display::", "format_", "metrics::", "log::", "tracing::", "debug::")
    front = ("status_line::", "progress::", "metrics::", "log::")
    whole = ("Vec::new", "HashMap::new", "HashSet::new", "Box::new", "Arc::new", "Rc::new", "String::new", "Option::Some", "Result::Ok")
    names = qualified.rlike("::(?:" + "|".join(ends) + ")$") | qualified.rlike("::(?:" + "|".join(inside) + ")") | qualified.rlike("^(?:" + "|".join(front) + ")") | qualified.isin(*whole)
    return names | ((kind == "Method") & qualified.rlike("::(?:get|set|count)$"))


def is_trivial_step(name: Column, path: Column) -> Column:
    """Symbols that critical paths do not go through: logging, formatting and conversion, by parts of name and path."""
    names = ("log", "debug", "info", "warn", "error", "trace", "println", "print", "eprintln", "fmt", "format", "display", "serialize", "deserialize", "clone", "drop", "into", "from", "to_string", "unwrap", "expect")
    paths = ("telemetry", "logging", "tracing", "log", "metrics", "observability", "monitoring", "analytics")
    return F.lower(name).rlike("|".join(names)) | F.lower(path).rlike("|".join(paths))


def is_utility(path: Column) -> Column:
    return F.lower(path).rlike("/(?:utils|helpers|events|common|shared|lib)/")


def is_external(path: Column) -> Column:
    """Whether a symbol lies outside the indexed files."""
    return path.isNull() | (path == "") | F.startswith(path, F.lit("std::")) | F.contains(path, F.lit("node_modules")) | F.contains(path, F.lit("/stdlib/"))


def is_generated(path: Column, text: Column) -> Column:
    """Generated, vendored or minified: by file name, by folder, or more than 8,000 characters on a line or less."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    files = name.rlike(r"\.(?:min\.js|bundle\.js|generated\.[jt]s|gen\.[jt]s)$")
    folders = path.rlike(r"/src/(?:v[23]/)?gen/") | path.rlike(r"(?:^|/)(?:node_modules|vendor|dist|out|build|\.next|\.nuxt)(?:/|$)")
    long_line = (F.octet_length(text) > 8_000) & ~F.regexp_replace(text, "\n$", "").contains("\n")
    return files | folders | F.coalesce(long_line, F.lit(False))


def file_kind(path: Column) -> Column:
    """``doc``, ``config`` or null, by name and extension."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    ext = F.lower(extension(path))
    config = F.startswith(name, F.lit(".env")) | name.isin("dockerfile", "makefile") | ext.isin("toml", "yaml", "yml", "json", "jsonc", "ini", "cfg", "conf", "properties")
    return F.when(ext.isin("md", "mdx", "txt", "rst", "adoc") & ~F.startswith(name, F.lit(".env")), "doc").when(config, "config")


def text_language(path: Column) -> Column:
    """Language of a text file that is no source code; the extension itself where it is unknown."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    ext = F.lower(extension(path))
    by_ext = F.when(ext.isin("md", "mdx"), "markdown").when(ext == "adoc", "asciidoc").when(ext == "txt", "text").when(ext.isin("yaml", "yml"), "yaml").when(ext.isin("json", "jsonc"), "json").when(ext.isin("ini", "cfg", "conf", "properties"), "config").when(ext != "", ext)
    return F.when(F.startswith(name, F.lit(".env")), "env").when(name == "dockerfile", "dockerfile").when(name == "makefile", "makefile").otherwise(by_ext)


def library_name(call: Column) -> Column:
    """What stands before the first dot, else before the first ::; null without either."""
    return F.when(F.contains(call, F.lit(".")), F.substring_index(call, ".", 1)).when(F.contains(call, F.lit("::")), F.substring_index(call, "::", 1))


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, F.lit(2), F.length(word)))


def byte_estimate(text: Column) -> Column:
    """Tokens by size: one for every two bytes."""
    return F.floor((F.octet_length(text) + 1) / 2).cast("long")


def fnv1a(text: Column) -> Column:
    """FNV-1a of 64 bits, as a signed number. Wrapping products are made of 32-bit halves, so that no sum overflows."""
    mask, low, high = (1 << 32) - 1, 0x1B3, 0x100  # the prime is 2**40 + 0x1b3

    def step(acc: Column, byte: Column) -> Column:
        lo, hi = acc["lo"].bitwiseXOR(byte), acc["hi"]
        product = lo * low
        top = F.shiftright(product, 32) + hi * low + lo * high
        return F.struct(product.bitwiseAND(F.lit(mask)).alias("lo"), top.bitwiseAND(F.lit(mask)).alias("hi"))

    digits = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(text) - 1)), lambda i: F.conv(F.substring(F.hex(F.encode(text, "UTF-8")), 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE484222325 & mask).cast("long").alias("lo"), F.lit(0xCBF29CE484222325 >> 32).cast("long").alias("hi"))
    bytes_ = F.when(F.octet_length(text) > 0, digits).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(bytes_, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"]))


#: Ways a commit's subject starts or ends that say nothing of its intent, and subjects that ask nothing (fixed values).
TICKET, PULL = r"(?i)^(?:Fixed|Refs)\s+#\d+\s+--\s+", r"\s*\(#\d+\)\s*$"
SCOPE = r"^[\w/.\- ]{1,30}(?:\([\w/.\- ]+\))?!?:\s*"
NOISE = r"(?i)^(?:revert|bump|chore|ci|deps|dependabot|merge|release|prepare|update(?:d)? (?:translations|changelog|deps|dependencies)|added cve|post-release|version bump|prep|changelog|v?\d+\.\d+)"


def asks_nothing(subject: Column) -> Column:
    """Whether a commit's subject is noise: a release chore, or shorter than 25 characters."""
    return F.regexp_replace(subject, SCOPE, "").rlike(NOISE) | subject.rlike(NOISE) | (F.length(subject) < 25)


def query_of(subject: Column) -> Column:
    """A commit's subject as a query, without ticket, pull request and last dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(subject, TICKET, ""), PULL, ""), r"\.+$", "")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests|test|__tests__)/") | path.rlike(r"(^|/)(test_[^/]*|[^/]*_test\.[^/.]+|[^/]*\.test\.[^/.]+|[^/]*\.spec\.[^/.]+)$")


def visibility(signature: Column, language: Column) -> Column:
    """Visibility by the first rule of the language that the signature holds."""
    has = lambda s: F.contains(signature, F.lit(s))
    rust = F.when(has("pub(crate)"), "Crate").when(has("pub(super)"), "Module").when(has("pub "), "Public").otherwise("Private")
    python = F.when(signature.rlike(r"def __(init|str|repr|eq|hash|call)__"), "Public").when(has("def __"), "Private").when(has("def _"), "Module").otherwise("Public")
    typescript = F.when(has("export "), "Public").when(has("private ") | has("#"), "Private").when(has("protected "), "Module").otherwise("Private")
    java = F.when(has("private"), "Private").when(has("protected"), "Module").when(has("public"), "Public").otherwise("Crate")
    csharp = F.when(has("public "), "Public").when(has("private "), "Private").when(has("protected ") | has("internal "), "Module").otherwise("Private")
    kotlin = F.when(has("private"), "Private").when(has("protected"), "Module").when(has("internal"), "Crate").otherwise("Public")
    go = F.when(signature.rlike(r"^(func|type|var|const)\s+(\([^)]*\)\s*)?[A-Z]"), "Public").otherwise("Private")
    javascript = F.when(has("export "), "Public").otherwise("Private")
    cpp = F.when(has("public:"), "Public").when(has("protected:"), "Module").when(has("private:"), "Private").otherwise("Public")
    php = F.when(has("private "), "Private").when(has("protected "), "Module").otherwise("Public")
    swift = F.when(has("open ") | has("public "), "Public").when(has("private ") | has("fileprivate "), "Private").otherwise("Module")
    # The last part of a function's name, or what stands before an equals sign.
    head = F.when(F.startswith(signature, F.lit("function ")), F.regexp_extract(signature, r"^function\s+([^(]*)", 1)).otherwise(F.regexp_extract(signature, r"^([^=]*)", 1))
    lua = F.when(F.startswith(signature, F.lit("local ")) | F.regexp_extract(F.trim(head), r"([^.: ]*)$", 1).rlike("^_"), "Private").otherwise("Public")
    declared = F.regexp_extract(signature, r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:static\s+)?(?:func|var|const|signal|class_name|class|enum)\s+(\w+)", 1)
    gdscript = F.when(declared.rlike("^_"), "Private").otherwise("Public")
    by_language = {"rust": rust, "python": python, "typescript": typescript, "javascript": javascript, "go": go, "java": java, "c": F.lit("Public"), "cpp": cpp, "csharp": csharp, "php": php, "kotlin": kotlin, "swift": swift, "lua": lua, "gdscript": gdscript}
    out = F.lit("Public")
    for name, rule in by_language.items():
        out = F.when(language == name, rule).otherwise(out)
    return out
