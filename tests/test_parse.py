"""Symbols and relations of small sources in each language."""

import pytest

from sparkloom.sources import parse

SOURCES = {
    "rust": 'use std::fmt;\nuse crate::a::B as C;\n/// Holds things\npub struct S {\n    pub y: Option<Part>,\n}\nimpl S {\n    /// makes one\n    pub fn new(a: Part) -> Self {\n        let z: Widget = Widget::make();\n        if a { helper(z); }\n        self.go()\n    }\n}\nimpl Show for S {\n    fn show(&self) {}\n}\npub trait T: Base + Other {}\n// fn commented(x) {}\nfn helper(w: Widget) { for i in w { i.a().b().c(); } }\n',
    "typescript": "import { a } from './x';\nexport class A extends B implements I, J {\n  private w: Widget;\n  run(b: Bar): Out {\n    const h = new Helper();\n    try { h.go(b); } catch (e) { throw e; }\n  }\n}\nexport interface K extends L { n: number; }\nexport const f = (a: T) => { g(a); };\ntype Q = string;\n",
    "javascript": "const x = require('./y');\nclass A extends B {\n  go(z) {\n    helper(z);\n  }\n}\nfunction helper(a) { return `fn(${a})`; }\n",
    "go": 'package x\nimport (\n  "fmt"\n  m "a/b"\n)\n// S is it\ntype S struct {\n\tBase\n\tName string\n}\ntype I interface { Do() }\nfunc (s *S) Do(w Widget) error { fmt.Println(s.Name); return helper(w) }\nfunc helper(w Widget) error { v := Thing{}; use(v); return nil }\n',
    "java": "import a.b.C;\n/** Does it */\npublic class A extends B implements I, J {\n    private Widget w;\n    public Foo run(Bar b) throws E {\n        Helper h = new Helper();\n        return h.go(b);\n    }\n}\ninterface K extends L { void m(); }\n",
    "c": '#include "a.h"\nstruct S { int x; };\n#define MOST 3\nstatic int helper(int a) { return a; }\nint main(void) { return helper(1); }\n',
    "cpp": "#include <vector>\nclass A : public B, private C {\npublic:\n    virtual void run(int x) { helper(x); }\n};\nnamespace n {\nint helper(int x) { return x; }\n}\nvoid A::other() { helper(1); }\n",
    "csharp": "using System.Text;\nnamespace N {\npublic class A : Base, IThing {\n    public int Run(Bar b) { var h = new Helper(); return h.Go(b); }\n}\n}\n",
    "php": "<?php\nuse App\\X as Y;\nclass A extends B implements I {\n    public function run(Bar $b) { $h = new Helper(); return $this->go($b); }\n}\n",
    "kotlin": "import a.b.C as D\nopen class Base(val n: Int)\nclass Foo(x: Int) : Base(x), Runnable {\n    private val y: Bar = Bar()\n    fun run(z: Zed): Out { helper(z); y.go() }\n}\n",
    "swift": "import UIKit\nclass A: Base, Codable {\n    var w: Widget\n    func run(_ b: Bar) -> Out { let h = Helper(); h.go(b) }\n}\nextension A: P { }\n",
    "lua": 'local M = require("mod.x")\nlocal Animal = {}\nlocal Dog = setmetatable({}, {__index = Animal})\nfunction Animal.new(n)\n  if n then M.log(n) end\n  return n\nend\nfunction Dog:bark() self:speak() helper() end\nlocal function helper() return 1 end\n',
    "gdscript": 'class_name Player\nextends Node2D\nconst S = preload("res://a.gd")\nfunc _ready():\n    var t: Timer = Timer.new()\n    start(t)\nfunc start(x):\n    pass\n',
    "python": 'import os as o\nfrom a.b import c\nclass A(B):\n    """doc"""\n    n: Widget = None\n    def f(self, x: Bar) -> Out:\n        if x:\n            return g(x).a().b().d()\n',
}
WANTED = {
    "rust": [("symbol", "S", "Struct", 4, 6, "Holds things"), ("symbol", "new", "Method", 9, 13, "makes one"), ("inherent", "S", "Method", 9, 13, "new"), ("implements", "S", "Impl", 15, 15, "Show"), ("extends", "T", "Trait", 18, 18, "Other"), ("call", "new", "Call", 11, 11, "helper"), ("method_call", "new", "self", 12, 12, "go"), ("import", "crate::a::B", "Import", 2, 2, "C"), ("variable", "z", "Type", 10, 10, "Widget"), ("uses", "helper", "Type", 20, 20, "Widget"), ("flow", "helper", "loop", 20, 20, None), ("defines", "S", "Field", 5, 5, "y")],
    "typescript": [("symbol", "A", "Class", 2, 8, None), ("extends", "A", "Class", 2, 2, "B"), ("implements", "A", "Class", 2, 2, "J"), ("symbol", "run", "Method", 4, 7, None), ("symbol", "w", "Field", 3, 3, None), ("variable", "h", "Type", 5, 5, "Helper"), ("call", "run", "Call", 6, 6, "go"), ("flow", "run", "try_catch", 6, 6, None), ("symbol", "f", "Function", 10, 10, None), ("symbol", "Q", "TypeAlias", 11, 11, None), ("import", "./x", "Import", 1, 1, None), ("extends", "K", "Interface", 9, 9, "L")],
    "javascript": [("symbol", "go", "Method", 3, 5, None), ("call", "go", "Call", 4, 4, "helper"), ("import", "./y", "Import", 1, 1, None), ("extends", "A", "Class", 2, 2, "B")],
    "go": [("symbol", "Do", "Method", 12, 12, None), ("defines", "S", "Method", 12, 12, "Do"), ("extends", "S", "Struct", 8, 8, "Base"), ("symbol", "S", "Struct", 7, 10, "S is it"), ("import", "a/b", "Import", 4, 4, "m"), ("import", "fmt", "Import", 3, 3, None), ("method_call", "Do", "fmt", 12, 12, "Println"), ("variable", "v", "Type", 13, 13, "Thing")],
    "java": [("symbol", "A", "Class", 3, 9, "Does it"), ("symbol", "run", "Method", 5, 8, None), ("implements", "A", "Class", 3, 3, "I"), ("extends", "K", "Interface", 10, 10, "L"), ("variable", "h", "Type", 6, 6, "Helper"), ("defines", "A", "Field", 4, 4, "w"), ("import", "a.b.C", "Import", 1, 1, None)],
    "c": [("symbol", "helper", "Function", 4, 4, None), ("call", "main", "Call", 5, 5, "helper"), ("symbol", "S", "Struct", 2, 2, None), ("symbol", "MOST", "Macro", 3, 3, None), ("import", "a.h", "Import", 1, 1, None)],
    "cpp": [("extends", "A", "Class", 2, 2, "C"), ("symbol", "run", "Method", 4, 4, None), ("symbol", "helper", "Function", 7, 7, None), ("defines", "A", "Method", 9, 9, "other"), ("call", "other", "Call", 9, 9, "helper")],
    "csharp": [("extends", "A", "Class", 3, 3, "Base"), ("implements", "A", "Class", 3, 3, "IThing"), ("symbol", "Run", "Method", 4, 4, None), ("method_call", "Run", "h", 4, 4, "Go")],
    "php": [("extends", "A", "Class", 3, 3, "B"), ("symbol", "run", "Method", 4, 4, None), ("import", "App\\X", "Import", 2, 2, "Y"), ("variable", "h", "Type", 4, 4, "Helper")],
    "kotlin": [("extends", "Foo", "Class", 3, 3, "Base"), ("implements", "Foo", "Class", 3, 3, "Runnable"), ("symbol", "Base", "Class", 2, 2, None), ("symbol", "run", "Method", 5, 5, None), ("import", "a.b.C", "Import", 1, 1, "D"), ("uses", "run", "Type", 5, 5, "Zed")],
    "swift": [("extends", "A", "Class", 2, 2, "Base"), ("implements", "A", "Class", 2, 2, "Codable"), ("implements", "A", "Impl", 6, 6, "P"), ("symbol", "run", "Method", 4, 4, None), ("variable", "h", "Type", 4, 4, "Helper")],
    "lua": [("extends", "Dog", "Class", 3, 3, "Animal"), ("symbol", "new", "Method", 4, 7, None), ("defines", "Dog", "Method", 8, 8, "bark"), ("call", "bark", "Call", 8, 8, "speak"), ("import", "mod.x", "Import", 1, 1, "M"), ("symbol", "helper", "Function", 9, 9, None)],
    "gdscript": [("extends", "Player", "Class", 2, 2, "Node2D"), ("symbol", "_ready", "Method", 4, 6, None), ("call", "_ready", "Call", 6, 6, "start"), ("variable", "t", "Type", 5, 5, "Timer"), ("import", "res://a.gd", "Import", 3, 3, "S")],
    "python": [("extends", "A", "Class", 3, 3, "B"), ("symbol", "f", "Method", 6, 8, None), ("symbol", "n", "Field", 5, 5, None), ("import", "a.b.c", "Import", 2, 2, None), ("uses", "f", "Type", 6, 6, "Out"), ("flow", "f", "if_else", 7, 8, None), ("flow", "f", "call_chain", 8, 8, None), ("variable", "x", "Type", 6, 6, "Bar")],
}


@pytest.mark.parametrize("language", sorted(WANTED))
def test_language(language):
    found = parse.extract(language, SOURCES[language])
    assert [w for w in WANTED[language] if w not in found] == []
    assert not any(r[1] == "commented" for r in found)
    assert all(r[3] <= r[4] for r in found)


def test_odd_sources():
    for language in parse.LANGUAGES:
        for source in ("", "{", "}" * 50, "fn (", '"' * 99, "/*", "class A {" * 60, "\n" * 40, "é 漢字 🙂"):
            parse.extract(language, source)
    assert not [r for r in parse.extract("python", "def (") if r[0] == "symbol"] and parse.extract("cobol", "x") == []


def test_hooks_and_trees():
    assert parse.hooks("const [a, setA] = useState(0);\n// useMemo(x)\nReact.useEffect(() => {}, []);") == [("useState", "a,setA", 1), ("useEffect", "", 3)]
    nodes = parse.dump("def f(): return 1\n")
    assert [n["node"] for n in nodes][:2] == ["Module", "FunctionDef"] and nodes[1]["name"] == "f"


def test_lua_calls():
    source = "local Animal = {}\nfunction Animal.new() return setmetatable({}, Animal) end\nfunction Dog.new() local d = Animal.new() return d end\nfunction M.utils.split(s) table.insert(s, 1) end\nsetmetatable(Dog, {__index = Animal})\n"
    calls = {(r[1], r[5]) for r in parse.extract("lua", source) if r[0] == "call"}
    assert calls == {("new", "setmetatable"), ("new", "new"), ("split", "insert"), ("<module>", "setmetatable")}


@pytest.mark.parametrize(("line", "visibility"), [("public class A {}", "Public"), ("private fun a() {}", "Private"), ("protected fun a() {}", "Module"), ("internal class A", "Crate"), ("val a: Int = 0", "Public")])
def test_kotlin_visibility(spark, line, visibility):
    from pyspark.sql import functions as F

    from sparkloom.functions import text as T

    body = line if "class" in line else f"class Holder {{\n    {line}\n}}"
    head = [r[5] for r in parse.extract("kotlin", body) if r[0] == "signature" and r[1] != "Holder"][0]
    assert spark.range(1).select(T.visibility(F.lit(head), F.lit("kotlin"))).first()[0] == visibility


def rows_of(language, source, *what):
    return {(r[0], r[1], r[2], r[5]) for r in parse.extract(language, source) if r[0] in what}


def test_one_line_bodies():
    got = rows_of("rust", "pub struct Foo; impl Foo { pub fn a(&self) { helper(1); } fn b() { Foo::a(x) } }\nmod m { fn inner() { deep(); } }\n", "symbol", "call", "inherent")
    assert {("symbol", "a", "Method", None), ("symbol", "b", "Method", None), ("symbol", "inner", "Function", None), ("call", "a", "Call", "helper"), ("call", "b", "Call", "a"), ("call", "inner", "Call", "deep"), ("inherent", "Foo", "Method", "a")} <= got
    got = rows_of("typescript", "class A { run(x: T) { helper(x); } stop() { this.run(1); } }\n", "symbol", "call")
    assert got == {("symbol", "A", "Class", None), ("symbol", "run", "Method", None), ("symbol", "stop", "Method", None), ("call", "run", "Call", "helper"), ("call", "stop", "Call", "run")}
    got = rows_of("java", "class A { int run(int x) { helper(x); return other(x); } void stop() { run(1); } }\n", "symbol", "call")
    assert got == {("symbol", "A", "Class", None), ("symbol", "run", "Method", None), ("symbol", "stop", "Method", None), ("call", "run", "Call", "helper"), ("call", "run", "Call", "other"), ("call", "stop", "Call", "run")}


def test_calls_are_no_definitions():
    source = "class A {\n    void run() {\n        helper(1);\n        return other(2);\n    }\n    void last() {}\n}\n"
    assert {r[1] for r in parse.extract("java", source) if r[0] == "symbol"} == {"A", "run", "last"}
    assert not rows_of("typescript", "const f = async (a) => { g(a); };\n", "call") - {("call", "f", "Call", "g")}


def test_whole_receivers():
    got = {(r[2], r[5]) for r in parse.extract("typescript", "function f() {\n  a[2].go(); b(1, c(2)).run(); this.x.y?.z(); new Foo().bar();\n}\n") if r[0] == "method_call"}
    assert {("a[2]", "go"), ("b(1,c(2))", "run"), ("this.x.y", "z"), ("Foo()", "bar")} <= got
    got = {(r[2], r[5]) for r in parse.extract("rust", "fn f() {\n    self.items[0].iter()\n        .map(g).collect();\n    a::B::new();\n}\n") if r[0] == "method_call"}
    assert {("self.items[0]", "iter"), ("self.items[0].iter()", "map"), ("self.items[0].iter().map(g)", "collect"), ("a::B", "new")} <= got


@pytest.mark.parametrize("broken", ["def bad(:\n    x = 1\n", "x = = 2\n", "class Half(\n", "  stray = 1\n", "if x\n    y = 1\n"])
def test_python_with_a_broken_line(broken):
    source = f"import os\ndef first(a):\n    return go(a)\n\n{broken}\ndef last():\n    other()\n"
    found = parse.extract("python", source)
    assert {("first", "go"), ("last", "other")} <= {(r[1], r[5]) for r in found if r[0] == "call"} and any(r[0] == "import" for r in found)
    assert {r[1] for r in found if r[0] == "symbol" and r[2] == "Function"} >= {"first", "last"}
