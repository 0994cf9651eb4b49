"""The written index, file sources, tools and search operators on small corpora."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import math as M
from sparkloom.functions import text as T
from sparkloom.operators import chunks, evaluate, incremental, lookup, overview, resolve, search
from sparkloom.sources import files
from sparkloom.sources.store import IndexStore
from sparkloom.tools import CodeIndex, as_rows


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp(".hidden") / "repo"
    for name, text in {"src/a.py": "import b\n\nclass A:\n    def run(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n", "src/b.rs": "pub fn go() { stop(); }\nfn stop() {}\n", "build/c.py": "x = 1\n", "skip.py": "y = 1\n", ".secret/d.py": "z = 1\n", "README.md": "# Title\n\nwords here\n", ".gitignore": "build/\n/skip.py\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_scan(spark, tree):
    rows = files.scan_files(spark, str(tree)).collect()
    assert sorted(r["path"].split("/repo/")[1] for r in rows) == ["src/a.py", "src/b.rs"]
    known = files.scan_files(spark, str(tree)).select("path", "mtime")
    assert files.scan_files(spark, str(tree), known=known).count() == 0
    docs = files.scan_collection(spark, str(tree)).collect()
    assert [(r["source_path"], r["text"][:7]) for r in docs] == [("README.md", "# Title")]


def test_git_scan(spark, tree):
    git = lambda *x: subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=a@b.c", *x], check=True, capture_output=True)
    git("init", "-q")
    git("add", "src/a.py")
    assert [r["path"].rsplit("/", 1)[1] for r in files.scan_git(spark, str(tree)).collect()] == ["a.py"]


def parsed(spark, rows):
    p = files.parse_files(rows)
    return files.symbol_table(p, rows)


def test_symbols_from_files(spark, tree):
    rows = files.scan_files(spark, str(tree))
    got = {(r["name"], r["kind"], r["visibility"], r["class_name"]) for r in parsed(spark, rows).collect()}
    assert got == {("A", "Class", "Public", None), ("run", "Method", "Public", "A"), ("helper", "Function", "Public", None), ("go", "Function", "Public", None), ("stop", "Function", "Private", None)}
    assert files.dump_trees(rows).where("data like '%FunctionDef%'").count() == 2


def test_store(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    assert store.read("symbols").count() == 0 and store.metadata() == {}
    make = lambda rows: {"files": rows, "symbols": rows.select(F.xxhash64("path").alias("id"), F.col("path").alias("name"), F.col("path").alias("file_path")), "chunks": rows.select(F.xxhash64("path").alias("chunk_id"), F.col("path").alias("file_path")), "vectors": rows.select(F.xxhash64("path").alias("id"), F.array(F.lit(1.0), F.lit(-1.0)).alias("embedding"))}
    disk = lambda *x: spark.createDataFrame(list(x), "path string, mtime long, content_hash string")
    first = {r["path"]: r["state"] for r in store.refresh(disk(("a", 1, "h"), ("b", 1, "h"), ("c", 1, "h")), make).collect()}
    assert first == {"a": "new", "b": "new", "c": "new"}
    second = {r["path"]: r["state"] for r in store.refresh(disk(("a", 1, "h"), ("b", 2, "g"), ("d", 1, "h")), make).collect()}
    assert second == {"a": "same", "b": "modified", "c": "deleted", "d": "new"}
    for name, column in (("files", "path"), ("symbols", "name"), ("chunks", "file_path")):
        assert sorted(r[column] for r in store.read(name).collect()) == ["a", "b", "d"]
    assert store.read("vectors").count() == 3 and [r["words"] for r in store.sign_index(2).collect()] == [[1]] * 3
    store.refresh_one(disk(("a", 5, "new")), "a", make)
    assert sorted((r["path"], r["mtime"]) for r in store.read("files").collect()) == [("a", 5), ("b", 2), ("d", 1)]
    store.delete_where("symbols", "name", ["a"])
    assert sorted(r["name"] for r in store.read("symbols").collect()) == ["b", "d"]
    assert store.by_ids("chunks", spark.createDataFrame([("b",)], "path string").select(F.xxhash64("path").alias("chunk_id")), "chunk_id").count() == 1
    store.append("symbols", spark.createDataFrame([(1, "z", "z")], "id long, name string, file_path string").withColumns({c: F.lit(None).cast(store.read("symbols").schema[c].dataType) for c in store.read("symbols").columns if c not in ("id", "name", "file_path")}))
    assert store.read("symbols").count() == 3
    states = {r["root"]: r["state"] for r in store.sync_roots(spark.createDataFrame([("",)], "root string")).collect()}
    assert states == {"": "added"} and store.metadata()["facts"]["roots"] == [""]
    store.clear()
    assert store.read("files").count() == 0
    os.makedirs(tmp_path / "newer")
    (tmp_path / "newer" / "manifest-000000000001.json").write_text('{"version": 99}')
    with pytest.raises(ValueError):
        IndexStore(spark, f"file://{tmp_path}/newer").read("files")


def test_swap_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        files.swap_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    files.swap_table(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def corpus(spark):
    s = [(1, "main", "Function", "src/main.rs", "m", "rust", "Public", 1, 5, "fn main()", None, None), (2, "run", "Method", "src/a.rs", "a", "rust", "Public", 1, 3, "fn run(&self)", "Runs the red engine", "A"), (3, "stop", "Function", "src/a.rs", "a", "rust", "Private", 5, 9, "fn stop()", "Stops it", None), (4, "A", "Struct", "src/a.rs", "a", "rust", "Public", 11, 20, "struct A", "An engine", None), (5, "speed", "Field", "src/a.rs", "a", "rust", "Public", 12, 12, "speed: u32", None, "A"), (6, "len", "Function", "std::vec", "vec", "rust", "Public", 1, 1, "fn len()", None, "Vec")]
    symbols = spark.createDataFrame(s, "id long, name string, kind string, file_path string, module string, language string, visibility string, start_line int, end_line int, signature string, doc string, class_name string")
    r = spark.createDataFrame([(1, 2, "Calls"), (2, 3, "Calls"), (3, 2, "Calls"), (2, 6, "Calls"), (4, 2, "Defines"), (4, 5, "Defines"), (1, 4, "Uses")], "from_id long, to_id long, kind string")
    body = "\n".join(f"line {i} run(" for i in range(1, 30))
    return CodeIndex(symbols, r, spark.createDataFrame([("src/a.rs", "rust", body), ("src/main.rs", "rust", body)], "path string, language string, content string"))


def test_tools(spark):
    c = corpus(spark)
    ids = lambda df, name="id": sorted(r[name] for r in df.collect())
    assert c.find_symbol("run").first()["n_callers"] == 2 and ids(c.get_calls(id=2)) == [3, 6] and ids(c.find_callers("run")) == [1, 3]
    assert {(r["kind"], r["n"]) for r in c.analyze_impact(id=3).collect()} == {("Method", 1), ("Function", 1)}
    tree = c.get_call_tree(1, collapse_duplicates=False)
    assert {tuple(r["path"]) for r in tree.collect()} == {(1,), (1, 2), (1, 2, 3), (1, 2, 3, 2)}
    assert (1, 2, 6) in {tuple(r["path"]) for r in c.get_call_tree(1, collapse_duplicates=False, show_trivial=True, show_external=True).collect()}
    assert c.get_source([3], 1).first()["source"].split("\n")[0] == "line 4 run("
    assert {r["label"]: r["names"] for r in c.get_module_exports("a.rs").collect()} == {"Methods": ["run"], "Structs": ["A"], "Fields": ["speed"]}
    assert tuple(c.get_type_fields(4).first()) == (4, ["speed"], ["run"])
    assert {r["name"]: r["n"] for r in c.get_index_info().collect()} == {"files": 2, "relationships": 7, "symbols": 6}
    assert c.search_symbols("rnu").first()["id"] == 2  # a swap counts as one edit
    assert c.search_symbols("run", kind="Function").count() == 0
    near = c.semantic_search_with_context("red engine", 1).first()
    assert (near["id"], near["callees"], near["impacted"]) == (2, ["len", "stop"], 2)
    feature = c.get_feature_context(2)
    assert ids(feature["impact"]) == [1, 3] and feature["examples"].count() == 2
    parts = as_rows(c.get_project_overview())
    assert {"modules", "keywords", "entry_points", "layers", "critical_paths"} <= {r["part"] for r in parts.select("part").distinct().collect()}
    assert lookup.resolve_query(c.symbols, "symbol_id:2")[0] == "Found" and lookup.resolve_query(c.symbols, "symbol_id:x")[0] == "InvalidId" and lookup.resolve_query(c.symbols, "none")[0] == "NotFound"


def test_state_graph(spark):
    s = spark.createDataFrame([(1, "App", "Function", "src/App.tsx", "m", "typescript", "Public", 2, 4, None, None, None)], corpus(spark).symbols.schema)
    f = spark.createDataFrame([("src/App.tsx", "typescript", "//\nfunction App() {\n const [n, setN] = useState(0);\n}\n")], "path string, language string, content string")
    assert [tuple(r) for r in CodeIndex(s, s.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), "kind").limit(0), f).get_state_graph(1).collect()] == [("useState", "n,setN", 3)]


def test_chunk_search(spark):
    rows = [(1, "a.py", 1, 9, "function", None, "def load user", "reads the user table", "def load_user(): return db", "python", 0), (2, "b.py", 1, 2, "function", None, "def other", None, "user user user", "python", 0), (3, "node_modules/c.py", 1, 2, "function", None, "def load user", "reads the user table", "x", "python", 0)]
    c = spark.createDataFrame(rows, "id long, file string, line_start long, line_end long, chunk_type string, parent_scope string, signature string, doc string, snippet string, language string, symbol_id long")
    vectors = c.select("id", search.hash_embedding(F.concat_ws(" ", "signature", "doc", "snippet")).alias("embedding"))
    index = CodeIndex(corpus(spark).symbols, corpus(spark).relationships, None, c, vectors)
    got = index.semantic_search_chunks("load user").orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2]
    assert index.semantic_search_chunks("load user", threshold=0.5).count() == 1
    best = search.chunk_search(c.withColumnRenamed("file", "file_path"), "load user")
    assert best.first()["id"] in (1, 3) and best.count() == 3
    rated = search.reranked(c.withColumn("text", F.col("snippet")).withColumn("score", F.lit(0.0)), "q", lambda q, texts: [float(len(t)) for t in texts], 1)
    assert rated.first()["id"] == 1


def test_evidence_order(spark):
    hits = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.9), (3, "b", 0.9), (4, "c", 0.1)], "id long, file string, score double")
    assert [r["id"] for r in search.by_evidence(hits, 4).orderBy("rank").collect()] == [2, 1, 4, 3]  # b: 0.9 + 0.5 * 0.9 / 2


def test_coordinate_ascent(spark):
    rows = spark.createDataFrame([(q, i, i == q % 3, float(i == q % 3), float(i)) for q in range(9) for i in range(3)], "query_id long, id long, relevant boolean, good double, bad double")
    w = search.coordinate_ascent(rows, ["good", "bad"])
    first = rows.groupBy("query_id").agg(F.max_by("relevant", F.struct(F.col("good") * w["good"] + F.col("bad") * w["bad"], -F.col("id"))).alias("r"))
    assert first.where("r").count() == 9


def test_module_comments_and_text_chunks(spark):
    f = spark.createDataFrame([("a.py", "#!/usr/bin/env python\n# One\n# two\n\nx = 1\n"), ("b.rs", "/* long\n comment */\nfn f() {}\n"), ("c.py", "x = 1\n"), ("d.md", "word " * 30 + "\n" + "more " * 30), (".env", "A=1234567890\nSECRET=abcdefghijkl\n")], "path string, content string")
    s = spark.createDataFrame([("a.py", 5), ("b.rs", 3), ("c.py", 1)], "file_path string, start_line int")
    got = {r["path"]: (r["line_start"], r["line_end"]) for r in chunks.module_comments(f.where("path like '%py' or path like '%rs'"), s).collect()}
    assert got == {"a.py": (2, 4), "b.rs": (1, 2)}
    kinds = {(r["path"], r["chunk_type"], r["line_start"], r["line_end"]) for r in chunks.text_file_chunks(f, 160, 0).collect()}
    assert kinds == {("d.md", "doc_chunk", 1, 1), ("d.md", "doc_chunk", 2, 2), (".env", "config_chunk", 1, 3)}
    gap = chunks.gap_chunks(spark.createDataFrame([("a", "one\nimport x\nimport y\ntwo\n()\n\nthree")], "path string, content string"), spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 4, 4), ("a", 3, 7, 7)], "file_path string, id long, start_line int, end_line int"))
    assert [(r["chunk_type"], r["line_start"]) for r in gap.collect()] == [("imports_gap", 2)]
    flow = chunks.flow_chunks(spark.createDataFrame([(i, 1, "a", "loop", i, i) for i in range(1, 9)], "block_id long, symbol_id long, file_path string, kind string, start_line int, end_line int"), spark.createDataFrame([("a", "x\n" * 9)], "path string, content string"))
    assert flow.count() == 6 and flow.first()["chunk_type"] == "flow_loop"
    lo, hi = chunks.line_range(F.lit(5), F.lit(9), F.lit(9))
    assert tuple(one(spark, lo, hi)) == (5, 8)
    assert chunks.joined_parts([(0, 2), (2, 3)], ["w " * 30, "w " * 30, "w"], 60, 100) == [(0, 3)]


def test_projects(spark):
    assert files.project_rules("x/go.mod", "module example.com/a/b\n\ngo 1.22\n") == [("example.com/a/b/", "")]
    assert files.project_rules("pyproject.toml", '[project]\nname = "my-pack"\n') == [("my_pack.", "my_pack/")]
    assert files.project_rules("composer.json", '{"autoload": {"psr-4": {"App\\\\": "src/"}}}') == [("App\\", "src/")]
    assert files.project_rules("tsconfig.json", "not json") == [] and files.project_rules("A.csproj", "<RootNamespace>N.M</RootNamespace>") == [("N.M.", "")]
    f = spark.createDataFrame([("web/tsconfig.json", '{"compilerOptions": {"paths": {"@app/*": ["src/app/*"]}}}'), ("tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["lib/*"]}}}')], "path string, content string")
    imports = spark.createDataFrame([("web/a/x.ts", "@app/util"), ("b.ts", "@/util"), ("web/a/x.ts", "react")], "file_path string, path string")
    got = {(r["path"]): r["candidate"] for r in files.candidate_paths(imports, files.project_configs(f)).collect()}
    assert got == {"@app/util": "web/src/app/util", "@/util": "lib/util", "react": "react"}


def test_scopes_and_members(spark):
    scoped = spark.createDataFrame([(1, "A", "module", 10), (1, "b", "member:10", 11), (1, "b", "imported", 12), (1, "c", "crate", 13), (1, "c", "local", 14)], "file_id long, name string, scope string, id long")
    uses = spark.createDataFrame([(1, 1, "A::b", "rust"), (2, 1, "c", "rust"), (3, 1, "b", "rust"), (4, 1, "A", "python"), (5, 1, "none", "go")], "use_id long, file_id long, name string, language string")
    assert {r["use_id"]: r["id"] for r in resolve.resolve_in_scopes(uses, scoped).collect()} == {1: 11, 2: 14, 3: 12, 4: 10}
    got = one(spark, *(resolve.module_path(F.lit(p), F.lit(lang)) for p, lang in (("src/a/mod.rs", "rust"), ("pkg/x/__init__.py", "python"), ("src/A/B.php", "php"), ("./src/b/c.ts", "typescript"))))
    assert list(got) == ["a", "pkg.x", "A\\B", "b.c"]


def test_defines_first(spark):
    s = spark.createDataFrame([(1, "f", 1, "py", "m", "Public", 1)], "id long, name string, file_id long, language string, module string, visibility string, line int")
    u = spark.createDataFrame([(1, "f", 1, "py", "m", 5, "Defines"), (2, "f", 1, "py", "m", 5, "Calls")], "rel_id long, to_name string, file_id long, language string, module string, line int, kind string")
    written = []
    out = resolve.resolve_in_order(u, s, spark.createDataFrame([], "file_id long, path string, alias string"), lambda rows: written.append(rows.count()) or rows)
    assert written == [1] and {r["kind"]: r["to_id"] for r in out.collect()} == {"Defines": 1, "Calls": 1}
    assert resolve.resolution_stats(out).first()["n"] == 2


def test_functions(spark):
    fnv = lambda b: __import__("functools").reduce(lambda h, x: ((h ^ x) * 0x100000001B3) & (2**64 - 1), b, 0xCBF29CE484222325)
    for text in ("", "a", "héé 🙂x"):
        h = fnv(text.encode())
        got = one(spark, T.fnv1a(F.lit(text)), *(T.truncate_bytes(F.lit(text), n) for n in range(9)))
        assert got[0] == (h - 2**64 if h >= 2**63 else h)
        assert list(got)[1:] == [text.encode()[:n].decode("utf-8", "ignore") for n in range(9)]
    got = one(spark, T.preview(F.lit("one two three four five six seven"), F.array(F.lit("four")), 5, "..."), T.highlight(F.lit("The Cat  sat on cat\ncat"), "cat sat", ">>", "<<"), T.is_generated(F.lit("a/b.min.js"), F.lit("")), T.is_generated(F.lit("a/b.js"), F.lit("x" * 9_000)), T.file_kind(F.lit("a/README.md")), T.text_language(F.lit("x/.env.local")), T.query_of(F.lit("Fixed #12 -- Made it work (#34).")), T.asks_nothing(F.lit("chore(deps): bump something big")), T.library_name(F.lit("axios.get")), T.is_external(F.lit("")))
    assert list(got) == ["...three four five...", "The >>Cat  sat<< on >>cat<<\n>>cat<<", True, True, "doc", "env", "Made it work (#34)", True, "axios", True]
    rules = [("rust", "pub(crate) fn a", "Crate"), ("lua", "function M._x(a)", "Private"), ("gdscript", "static func _ready()", "Private"), ("swift", "open class A", "Public"), ("php", "protected function x", "Module"), ("javascript", "function a", "Private"), ("c", "int x", "Public"), ("cpp", "private: int x", "Private")]
    assert list(one(spark, *(T.visibility(F.lit(s), F.lit(lang)) for lang, s, _ in rules))) == [v for _, _, v in rules]
    assert T.search_terms("how does edit-tool work in the code_base") == ["does", "edit-tool", "work", "code_base"]
    assert one(spark, T.is_trivial_call(F.lit("a::len"), F.lit("Function")), T.is_trivial_call(F.lit("a::get"), F.lit("Method")), T.is_trivial_call(F.lit("a::get"), F.lit("Function")), T.is_trivial_step(F.lit("prepare"), F.lit("src/a.rs"))) == (True, True, False, False)
    assert one(spark, M.symbol_signal(F.lit(None).cast("string"), F.lit(3), F.lit(False)), F.round(M.symbol_signal(F.lit("Function"), F.lit(0), F.lit(False)), 6)) == (0.5, 0.65)
    assert overview.rule_column("NOT has_keyword:a OR has_keyword:b") is not None


def test_rebuild_and_baselines(spark):
    d = spark.createDataFrame([("x", "a"), ("y", "b")], "root string, z string").select("root")
    assert {(r["root"], r["state"]) for r in incremental.config_diff(d, spark.createDataFrame([("y",), ("w",)], "root string")).collect()} == {("x", "removed"), ("w", "added")}
    f = spark.createDataFrame([("a.py", "red red blue"), ("bb.py", "red blue"), ("c.py", "green")], "path string, content string")
    q = spark.createDataFrame([(1, ["Red", "blue"])], "query_id long, terms array<string>")
    assert [r["path"] for r in evaluate.lexical_baseline(f, q).orderBy("rank").collect()] == ["a.py", "bb.py"]
