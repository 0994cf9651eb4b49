"""Sources and sinks: file trees, JSON lines, manifests, tables, and symbols parsed from source text."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.sources.parse import extract

#: File extensions of each language (fixed values).
LANGUAGES = {
    "rust": ("rs",), "python": ("py", "pyi"), "typescript": ("ts", "tsx", "mts", "cts"), "javascript": ("js", "jsx", "mjs", "cjs"), "go": ("go",), "java": ("java",), "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "csharp": ("cs",), "php": ("php",), "kotlin": ("kt", "kts"), "swift": ("swift",), "lua": ("lua",), "gdscript": ("gd",),
}


def language_of(path):
    ext = T.extension(path)
    out = F.lit(None).cast("string")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def _listed(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    """(path, rel, mtime, length) of the files below ``root``: their content is no column, so it is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    # A path is told from its root by the part below it, whatever folders lie above.
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(top) + "/", "")
    return rows.select("path", rel.alias("rel"), F.unix_millis("modificationTime").alias("mtime"), "length")


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(keep, regular expression) of each line of an ignore file, in order; later lines win, ``!`` keeps."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, body = (True, line[1:]) if line.startswith("!") else (False, line)
        anchored, folder = "/" in body.rstrip("/"), body.endswith("/")
        body = body.strip("/")
        pattern = T.glob_regex(body if not anchored else "/" + body)[1:-1]
        pattern = pattern.removeprefix("/") if anchored else pattern
        out.append((keep, f"^{pattern}{'/.*' if folder else '(?:/.*)?'}$"))
    return out


def scan_files(spark: SparkSession, root: str, ignore: list[str] = (), tests: bool = True, extensions: tuple[str, ...] | None = None, ignore_file: str = ".gitignore", known: DataFrame | None = None) -> DataFrame:
    """(path, language, content, content_hash, mtime) of the known source files below ``root``.

    Paths are listed first, by extension; hidden and ignored ones, also by the rules of ``ignore_file`` at the root, are left out of the list before any content is read.
    With ``known`` (path, mtime), files that did not change since are left out, too. Content is read only for the paths that are left.
    """
    exts = extensions or tuple(e for own in LANGUAGES.values() for e in own)
    listed = _listed(spark, root, "*.{" + ",".join(exts) + "}")
    listed = listed.withColumn("language", language_of(F.col("rel"))).where(F.col("language").isNotNull() & ~F.col("rel").rlike(r"(?:^|/)\.[^/]+"))
    for pattern in ignore:
        listed = listed.where(~F.col("rel").rlike(T.glob_regex(pattern)))
    rules = ignore_rules(_text_of(spark, f"{root}/{ignore_file}"))
    gone = F.lit(False)
    for keep, pattern in rules:
        gone = F.when(F.col("rel").rlike(pattern), not keep).otherwise(gone)
    listed = listed.where(~gone)
    if not tests:
        listed = listed.where(~T.is_test_path(F.col("rel")))
    if known is not None:
        listed = listed.join(known.select("path", "mtime"), ["path", "mtime"], "left_anti")
    return read_paths(spark, root, listed)


def _text_of(spark: SparkSession, path: str) -> str:
    """A small file's text, empty without one; read by the driver, as Spark's readers pass hidden files."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


#: Paths that are named to the reader at once.
PATHS = 50_000


def read_paths(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """(path, language, content, content_hash, mtime) of ``listed`` (path, language and, if known, mtime; else the time comes with the content).

    Up to PATHS paths are named to the reader, so nothing else is opened; of longer lists all files below ``root`` with their extensions are read and joined.
    """
    some = [r["path"] for r in listed.select("path").limit(PATHS + 1).collect()]
    if not some:
        return spark.createDataFrame([], "path string, language string, content string, content_hash string, mtime long")
    reader = spark.read.format("binaryFile")
    rows = reader.load(some) if len(some) <= PATHS else reader.option("recursiveFileLookup", "true").load(root)
    known = listed.select("path", "language", "mtime") if "mtime" in listed.columns else listed.select("path", "language", F.lit(None).cast("long").alias("mtime"))
    both = rows.select("path", F.col("content").alias("raw"), F.unix_millis("modificationTime").alias("read_at")).join(known, "path")
    return both.withColumn("mtime", F.coalesce("mtime", "read_at")).select("path", "language", F.decode("raw", "UTF-8").alias("content"), F.sha2("raw", 256).alias("content_hash"), "mtime")


def scan_git(spark: SparkSession, root: str) -> DataFrame:
    """scan_files() of the files that git tracks in the working tree ``root``, which the driver sees: only those are opened, and no folder is walked."""
    listed = lambda *options: set(subprocess.run(["git", "-C", root, "ls-files", "-z", *options], capture_output=True, check=True).stdout.decode().split("\0")) - {""}
    named = sorted(listed() - listed("--deleted"))
    rows = spark.createDataFrame([(f"file:{root.rstrip('/')}/{n}", n) for n in named], "path string, rel string")
    tracked = rows.withColumn("language", language_of(F.col("rel"))).where(F.col("language").isNotNull() & ~F.col("rel").rlike(r"(?:^|/)\.[^/]+"))
    return read_paths(spark, root, tracked.select("path", "language"))


def scan_collection(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("**/*.md",), collection: str = "default") -> DataFrame:
    """(collection, source_path, text, mtime) of a collection's documents."""
    listed = _listed(spark, root, None).where(T.matches_any(F.col("rel"), list(patterns)))
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.join(listed.select("path", "rel", "mtime"), "path").select(F.lit(collection).alias("collection"), F.col("rel").alias("source_path"), "text", "mtime")


def body_of(content, start_line, end_line):
    """The lines from ``start_line`` to ``end_line`` of a text, counted from 1."""
    return F.array_join(F.slice(F.split(content, "\n"), start_line, F.greatest(F.lit(0), end_line - start_line + 1)), "\n")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_toml(text: str) -> dict:
    return tomllib.loads(text)


def manifest_entry_points(name: str, text: str) -> list[str]:
    """Paths that a package.json or Cargo.toml names as programs."""
    if name == "package.json":
        bins = json.loads(text).get("bin", {})
        return [bins] if isinstance(bins, str) else sorted(bins.values())
    data = tomllib.loads(text)
    return [b["path"] for b in data.get("bin", []) if "path" in b]


def envelope(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One JSON string for each row, with the asked fields only."""
    return df.select(F.to_json(F.struct(*(fields or df.columns))).alias("data"))


def swap_table(df: DataFrame, path: str) -> None:
    """Replaces the table at ``path``: the new one is written beside it and renamed into its place, so the old one stays until the new one is whole."""
    spark = df.sparkSession
    beside, old = f"{path.rstrip('/')}__new", f"{path.rstrip('/')}__old"
    df.write.mode("overwrite").parquet(beside)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(beside), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"could not rename to {path}")
    fs.delete(at(old), True)


#: What configuration files say of import paths: (prefix, target) pairs; ``*`` stands for the rest.
def project_rules(name: str, text: str) -> list[tuple[str, str]]:
    """Prefixes of import paths and what they stand for, by a project's configuration file.

    tsconfig.json and jsconfig.json (paths, baseUrl), go.mod (module), pyproject.toml (name and package folder), composer.json (psr-4), package.json (name),
    Package.swift (targets), *.csproj (root namespace), pom.xml and build.gradle[.kts] (source folders).
    """
    base = name.rsplit("/", 1)[-1]
    try:
        if base in ("tsconfig.json", "jsconfig.json"):
            options = json.loads(re.sub(r",(\s*[}\]])", r"\1", re.sub(r"^\s*//.*$", "", text, flags=re.M))).get("compilerOptions", {})
            folder = options.get("baseUrl", ".").strip("/").removeprefix("./")
            folder = "" if folder in (".", "") else folder + "/"
            return [(k.removesuffix("*"), folder + v[0].removeprefix("./").removesuffix("*")) for k, v in sorted(options.get("paths", {}).items()) if v]
        if base == "go.mod":
            return [(m.group(1) + "/", "") for m in re.finditer(r"^module\s+(\S+)", text, re.M)]
        if base == "pyproject.toml":
            data = tomllib.loads(text)
            found = data.get("project", {}).get("name") or data.get("tool", {}).get("poetry", {}).get("name")
            where = data.get("tool", {}).get("setuptools", {}).get("packages", {})
            where = where.get("find", {}).get("where", [""])[0] if isinstance(where, dict) else ""
            return [(found.replace("-", "_") + ".", (where.strip("./") + "/" if where.strip("./") else "") + found.replace("-", "_") + "/")] if found else []
        if base == "composer.json":
            return [(k, v if isinstance(v, str) else v[0]) for k, v in sorted(json.loads(text).get("autoload", {}).get("psr-4", {}).items())]
        if base == "package.json":
            found = json.loads(text).get("name")
            return [(found + "/", "")] if found else []
        if base == "Package.swift":
            return [(m.group(1), f"Sources/{m.group(1)}/") for m in re.finditer(r"\.(?:target|executableTarget)\(\s*name:\s*\"(\w+)\"", text)]
        if base.endswith(".csproj"):
            m = re.search(r"<RootNamespace>([^<]+)", text)
            return [((m.group(1) if m else base[: -len(".csproj")]) + ".", "")]
        if base in ("pom.xml", "build.gradle", "build.gradle.kts"):
            m = re.search(r"<sourceDirectory>([^<]+)|srcDirs?\s*\(?\s*=?\s*\[?['\"]([^'\"]+)", text)
            return [("", (next(g for g in m.groups() if g).strip("/") + "/") if m else "src/main/kotlin/" if "kts" in base else "src/main/java/")]
    except (ValueError, KeyError, AttributeError):
        return []
    return []


def project_configs(files: DataFrame) -> DataFrame:
    """(dir, prefix, target, sha): the rules of all configuration files (path, content), with their folders and hashes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p.rsplit("/", 1)[0] if "/" in p else "", a, b, sha) for p, c, sha in zip(pdf["path"], pdf["content"], pdf["sha"]) for a, b in project_rules(p, c or "")]
            yield pd.DataFrame(rows, columns=["dir", "prefix", "target", "sha"])

    return files.select("path", "content", F.sha2("content", 256).alias("sha")).mapInPandas(run, "dir string, prefix string, target string, sha string")


def candidate_paths(imports: DataFrame, configs: DataFrame) -> DataFrame:
    """(file_path, path, candidate): what an import means by the deepest configuration above its file, by the longest prefix; the path itself without one."""
    from sparkloom.operators import resolve

    folders = resolve.governing_config(imports.select(F.col("file_path").alias("path")).distinct(), configs.select("dir")).withColumnRenamed("path", "file_path")
    # Rules are few for each folder.
    near = imports.join(folders, "file_path").join(configs, "dir").where(F.startswith(F.col("path"), F.col("prefix")))
    best = near.groupBy("file_path", "path").agg(F.max_by(F.struct("dir", "prefix", "target"), F.struct(F.length("prefix"), "prefix")).alias("x"))
    rest = F.substring(F.col("path"), F.length("x.prefix") + 1, F.length("path"))
    joined = F.concat(F.when(F.col("x.dir") == "", "").otherwise(F.concat("x.dir", F.lit("/"))), F.col("x.target"), rest)
    return imports.select("file_path", "path").distinct().join(best, ["file_path", "path"], "left").select("file_path", "path", F.when(F.col("x").isNull(), F.col("path")).otherwise(joined).alias("candidate"))


def dump_trees(files: DataFrame) -> DataFrame:
    """(path, data): the syntax trees of Python files as JSON lines, a row for each node."""
    from sparkloom.sources import parse

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(p, json.dumps(node)) for node in parse.dump(c or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "data"])

    return files.where("language = 'python'").select("path", "content").mapInPandas(run, "path string, data string")


def parse_files(files: DataFrame) -> DataFrame:
    """(path, what, name, kind, line, end_line, other, signature): every extracted row of each file, on Arrow batches; symbols have their signature.

    Calls are given once for each caller, callee and line.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                found = extract(language, content or "")
                heads = {(x[1], x[2], x[3]): x[5] for x in found if x[0] == "signature"}
                rows += [(path, *x, heads.get((x[1], x[2], x[3])) if x[0] == "symbol" else None) for x in found if x[0] != "signature"]
            yield pd.DataFrame(rows, columns=["path", "what", "name", "kind", "line", "end_line", "other", "signature"])

    return files.select("path", "language", "content").mapInPandas(run, "path string, what string, name string, kind string, line long, end_line long, other string, signature string")


def symbol_table(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols (id, name, kind, file_path, language, module, visibility, start_line, end_line, signature, doc, class_name) of parsed rows; ids are hashes of place and name."""
    from sparkloom.operators import resolve

    own = parsed.where("what = 'symbol'").select(F.col("path").alias("file_path"), "name", "kind", F.col("line").alias("start_line"), "end_line", F.col("other").alias("doc"), "signature")
    key = ["file_path", "name", "kind", "start_line"]
    owners = parsed.where("what = 'defines'").groupBy(F.col("path").alias("file_path"), F.col("other").alias("name"), "kind", F.col("line").alias("start_line")).agg(F.min("name").alias("class_name"))
    rows = own.join(owners, key, "left").join(files.select(F.col("path").alias("file_path"), "language"), "file_path")
    return rows.select(
        F.xxhash64(*key).bitwiseAND(F.lit((1 << 62) - 1)).alias("id"), "name", "kind", "file_path", "language", resolve.module_path(F.col("file_path"), F.col("language")).alias("module"),
        T.visibility(F.coalesce("signature", F.lit("")), F.col("language")).alias("visibility"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "signature", "doc", "class_name",
    )
