"""Symbols and relations of source texts in fourteen languages.

Python is parsed by its own grammar. The others are read by their definitions, brackets, ends or indentation, after comments and strings were
blanked: enough for names, ranges, owners, calls, inheritance, imports and types, without a grammar for each language.

Rows are (what, name, kind, line, end_line, other), lines from 1:
``symbol`` (other: doc comment), ``signature`` (other: the definition's text), ``call`` (name: caller, ``<module>`` for calls outside functions in Python and Lua, other: callee), ``method_call`` (kind: receiver, other: method),
``implements`` and ``extends`` (name: type, other: base), ``uses`` (name: user, other: type), ``defines`` (name: owner, other: member), ``import`` (name: path, other: alias),
``variable`` (name: variable, other: type), ``inherent`` (name: type, other: method), ``flow`` (name: owner, kind: kind of block).
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

#: How deep nested brackets are followed.
MAX_DEPTH = 500


@dataclass(frozen=True)
class Rules:
    """How a language is read. ``defs``: (pattern with group ``name``, kind); ``imports``: patterns with groups ``path`` and, maybe, ``alias``."""

    defs: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    line_comment: tuple[str, ...] = ("//",)
    block_comment: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'"
    body: str = "brace"  # brace, end or indent
    inherit: str = ""  # how a type's header names its bases
    variables: tuple[str, ...] = ()
    fields: str | None = None
    flow: bool = False
    keywords: frozenset[str] = field(default_factory=frozenset)


TYPES = {"Class", "Struct", "Enum", "Trait", "Interface", "Impl", "Module"}
#: Words that look like calls (fixed values).
WORDS = frozenset("if for while switch match return catch function fn func fun sizeof typeof throw elif else do and or not in until when guard defer lambda def class super assert await yield loop with except print_ using lock foreach elseif require_once include_once array list isset unset async".split())

CONTROL = frozenset("if for while switch match return catch function throw elif else do and or not in until when guard typeof sizeof await yield lock foreach elseif".split())

#: Words that begin statements, not definitions (fixed values).
STATEMENTS = frozenset("return throw new else await yield case goto delete".split())

_JS = (
    (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)", "Class"), (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)", "Function"),
    (r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|\w+)\s*(?::[^=\n]+)?=>", "Function"),
    (r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*(?P<name>#?\w+)\s*(?:<[^>\n]*>)?\([^;{]*\)\s*(?::[^{;\n]+)?\{", "Method"),
    (r"^(?:export\s+)?const\s+(?P<name>[A-Z][A-Z0-9_]*)\s*[:=]", "Constant"),
)
_JS_IMPORTS = (r"^\s*import\s+(?:type\s+)?[^'\"\n]*?\bfrom\s*['\"](?P<path>[^'\"]+)['\"]", r"^\s*import\s*['\"](?P<path>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<path>[^'\"]+)['\"]\s*\)")
_C = ((r"^[ \t]*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{", "Struct"), (r"^[ \t]*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>\w+)", "Enum"), (r"^[ \t]*#\s*define\s+(?P<name>\w+)", "Macro"), (r"^[A-Za-z_][\w \t*&:<>,]*?[\s*&](?P<name>(?:\w+::)*~?\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?::[^{;]*)?\{", "Function"))
_JAVA_MODS = r"(?:(?:public|private|protected|static|final|abstract|sealed|synchronized|native|default|internal|override|virtual|async|partial|readonly|open|data|inline|suspend|lateinit|inner|companion|operator|infix)\s+)*"

LANGUAGES: dict[str, Rules] = {
    "rust": Rules(
        ((r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(?P<name>\w+)", "Function"), (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)", "Struct"), (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)", "Enum"),
         (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)", "Trait"), (r"^[ \t]*(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>\s*)?(?:[\w:<>, &']+?\s+for\s+)?(?P<name>\w+)[^;{]*\{", "Impl"), (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)", "Module"),
         (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)", "TypeAlias"), (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z]\w*)\s*:", "Constant"), (r"^[ \t]*macro_rules!\s*(?P<name>\w+)", "Macro")),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<path>[\w:]+(?:::\*)?)(?:\s+as\s+(?P<alias>\w+))?\s*;",), quotes='"', inherit="rust", variables=(r"\blet\s+(?:mut\s+)?(?P<name>\w+)\s*:\s*&?(?P<type>[A-Z]\w*)", r"\blet\s+(?:mut\s+)?(?P<name>\w+)\s*=\s*(?P<type>[A-Z]\w*)(?:::|\s*\{)"),
        fields=r"^[ \t]+(?:pub(?:\([^)]*\))?\s+)?(?P<name>\w+)\s*:\s*[^,\n(]+,?\s*$", flow=True),
    "typescript": Rules((*_JS, (r"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>\w+)", "Interface"), (r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>\w+)", "Enum"), (r"^[ \t]*(?:export\s+)?type\s+(?P<name>\w+)\s*(?:<[^=]*>)?\s*=", "TypeAlias"), (r"^[ \t]*(?:export\s+)?namespace\s+(?P<name>\w+)", "Module")),
        _JS_IMPORTS, quotes="\"'`", inherit="words", variables=(r"\b(?:const|let|var)\s+(?P<name>\w+)\s*:\s*(?P<type>[A-Z]\w*)", r"\b(?:const|let|var)\s+(?P<name>\w+)\s*=\s*new\s+(?P<type>\w+)"), fields=r"^[ \t]+(?:(?:public|private|protected|static|readonly)\s+)*(?P<name>\w+)[?!]?\s*:\s*[^=;(\n]+(?:=[^;\n]*)?;\s*$", flow=True),
    "javascript": Rules(_JS, _JS_IMPORTS, quotes="\"'`", inherit="words", variables=(r"\b(?:const|let|var)\s+(?P<name>\w+)\s*=\s*new\s+(?P<type>\w+)",), fields=r"^[ \t]+(?:static\s+)?(?P<name>#?\w+)\s*=\s*[^>\n]+;\s*$", flow=True),
    "go": Rules(
        ((r"^func\s+\([^)]*?(?P<owner>\w+)(?:\[[^\]]*\])?\)\s*(?P<name>\w+)", "Method"), (r"^func\s+(?P<name>\w+)", "Function"), (r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b", "Struct"), (r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b", "Interface"), (r"^type\s+(?P<name>\w+)\s+=?\s*(?!struct\b|interface\b)[\w\[*(]", "TypeAlias"), (r"^const\s+(?P<name>\w+)", "Constant"), (r"^var\s+(?P<name>\w+)", "Variable")),
        (r'^\s*import\s+(?:(?P<alias>[\w.]+)\s+)?"(?P<path>[^"]+)"', r'^\s+(?:(?P<alias>[\w.]+)\s+)?"(?P<path>[^"]+)"\s*$'), quotes="\"'`", inherit="go", variables=(r"\b(?P<name>\w+)\s*:=\s*&?(?P<type>[A-Z]\w*)\s*\{", r"\bvar\s+(?P<name>\w+)\s+\*?(?P<type>[A-Z]\w*)"), fields=r"^[ \t]+(?P<name>\w+)[ \t]+[\w.*\[\]]+(?:[ \t]+`[^`]*`)?\s*$"),
    "java": Rules(
        ((rf"^[ \t]*(?:@\w+\s+)*{_JAVA_MODS}class\s+(?P<name>\w+)", "Class"), (rf"^[ \t]*{_JAVA_MODS}@?interface\s+(?P<name>\w+)", "Interface"), (rf"^[ \t]*{_JAVA_MODS}enum\s+(?P<name>\w+)", "Enum"), (rf"^[ \t]*{_JAVA_MODS}record\s+(?P<name>\w+)", "Class"), (rf"^[ \t]+{_JAVA_MODS}(?:<[^>\n]+>\s+)?(?:[\w<>\[\].,? ]+\s+)?(?P<name>\w+)\s*\([^;{{)]*\)\s*(?:throws\s+[\w., ]+)?(?:\{{|;)", "Method")),
        (r"^\s*import\s+(?:static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;",), inherit="words", variables=(r"\b(?P<type>[A-Z]\w*)(?:<[^>\n]*>)?\s+(?P<name>\w+)\s*(?:=|;)",), fields=rf"^[ \t]+{_JAVA_MODS}[\w<>\[\].,? ]+\s+(?P<name>\w+)\s*(?:=[^;\n]*)?;\s*$"),
    "c": Rules(_C, (r'^\s*#\s*include\s*[<"](?P<path>[^>"]+)[>"]',), fields=r"^[ \t]+[\w \t*]+[\s*](?P<name>\w+)(?:\[[^\]]*\])?\s*;\s*$"),
    "cpp": Rules(((r"^[ \t]*(?:template\s*<[^{;]*>\s*)?class\s+(?P<name>\w+)[^;{]*\{", "Class"), (r"^[ \t]*namespace\s+(?P<name>\w+)", "Module"), (r"^[ \t]+(?:virtual\s+|static\s+|inline\s+|explicit\s+)*(?:[\w:<>*&, ]+[\s*&])?(?P<name>~?\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:=\s*(?:0|default|delete)\s*)?[;{]", "Method"), *_C),
        (r'^\s*#\s*include\s*[<"](?P<path>[^>"]+)[>"]', r"^\s*using\s+(?:namespace\s+)?(?P<path>[\w:]+)\s*;"), inherit="cpp", variables=(r"\b(?P<type>[A-Z]\w*)(?:<[^>\n]*>)?[ \t*&]+(?P<name>\w+)\s*(?:=|;|\{|\()",), fields=r"^[ \t]+[\w:<>, \t*&]+[\s*&](?P<name>\w+)\s*(?:=[^;\n]*)?;\s*$"),
    "csharp": Rules(
        ((rf"^[ \t]*(?:\[[^\]\n]*\]\s*)*{_JAVA_MODS}(?:class|record)\s+(?P<name>\w+)", "Class"), (rf"^[ \t]*{_JAVA_MODS}interface\s+(?P<name>\w+)", "Interface"), (rf"^[ \t]*{_JAVA_MODS}struct\s+(?P<name>\w+)", "Struct"), (rf"^[ \t]*{_JAVA_MODS}enum\s+(?P<name>\w+)", "Enum"), (r"^[ \t]*namespace\s+(?P<name>[\w.]+)", "Module"), (rf"^[ \t]+{_JAVA_MODS}(?:[\w<>\[\].,? ]+\s+)?(?P<name>\w+)\s*(?:<[^>\n]*>)?\([^;{{)]*\)\s*(?:where[^{{]*)?(?:\{{|=>|;)", "Method")),
        (r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<path>[\w.]+)\s*;",), inherit="csharp", variables=(r"\bvar\s+(?P<name>\w+)\s*=\s*new\s+(?P<type>\w+)", r"\b(?P<type>[A-Z]\w*)(?:<[^>\n]*>)?\s+(?P<name>\w+)\s*(?:=|;)"), fields=rf"^[ \t]+{_JAVA_MODS}[\w<>\[\].,? ]+\s+(?P<name>\w+)\s*(?:=[^;\n]*;|;|\{{\s*get[^\n]*)\s*$"),
    "php": Rules(
        ((r"^[ \t]*(?:abstract\s+|final\s+|readonly\s+)*class\s+(?P<name>\w+)", "Class"), (r"^[ \t]*interface\s+(?P<name>\w+)", "Interface"), (r"^[ \t]*trait\s+(?P<name>\w+)", "Trait"), (r"^[ \t]*enum\s+(?P<name>\w+)", "Enum"), (r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<name>\w+)", "Function"), (r"^[ \t]*(?:(?:public|private|protected|final)\s+)*const\s+(?:\w+\s+)?(?P<name>[A-Z]\w*)\s*=", "Constant")),
        (r"^use\s+(?:function\s+|const\s+)?(?P<path>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<path>[^'\"]+)"), line_comment=("//", "#"), inherit="words", variables=(r"\$(?P<name>\w+)\s*=\s*new\s+(?P<type>\w+)", r"\b(?P<type>[A-Z]\w*)\s+\$(?P<name>\w+)"), fields=r"^[ \t]+(?:(?:public|private|protected|static|readonly|var)\s+)+(?:\??[\w\\]+\s+)?\$(?P<name>\w+)"),
    "kotlin": Rules(
        ((rf"^[ \t]*{_JAVA_MODS}(?:enum\s+)?class\s+(?P<name>\w+)", "Class"), (rf"^[ \t]*{_JAVA_MODS}(?:fun\s+)?interface\s+(?P<name>\w+)", "Interface"), (rf"^[ \t]*{_JAVA_MODS}object\s+(?P<name>\w+)", "Class"), (rf"^[ \t]*{_JAVA_MODS}fun\s+(?:<[^>\n]+>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)\s*\(", "Function"), (r"^[ \t]*typealias\s+(?P<name>\w+)", "TypeAlias"), (rf"^[ \t]*{_JAVA_MODS}const\s+val\s+(?P<name>\w+)", "Constant")),
        (r"^\s*import\s+(?P<path>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<alias>\w+))?",), inherit="kotlin", variables=(r"\b(?:val|var)\s+(?P<name>\w+)\s*:\s*(?P<type>[A-Z]\w*)", r"\b(?:val|var)\s+(?P<name>\w+)\s*=\s*(?P<type>[A-Z]\w*)\("), fields=rf"^[ \t]+{_JAVA_MODS}(?:val|var)\s+(?P<name>\w+)"),
    "swift": Rules(
        ((rf"^[ \t]*(?:@\w+\s+)*(?:public\s+|private\s+|fileprivate\s+|internal\s+|open\s+|final\s+|indirect\s+)*class\s+(?P<name>\w+)", "Class"), (r"^[ \t]*(?:public\s+|private\s+|fileprivate\s+|internal\s+)*struct\s+(?P<name>\w+)", "Struct"), (r"^[ \t]*(?:public\s+|private\s+|fileprivate\s+|internal\s+|indirect\s+)*enum\s+(?P<name>\w+)", "Enum"), (r"^[ \t]*(?:public\s+|private\s+|fileprivate\s+|internal\s+)*protocol\s+(?P<name>\w+)", "Interface"),
         (r"^[ \t]*(?:public\s+|private\s+|fileprivate\s+|internal\s+)*extension\s+(?P<name>\w+)", "Impl"), (r"^[ \t]*(?:@\w+\s+)*(?:(?:public|private|fileprivate|internal|open|final|static|class|override|mutating)\s+)*func\s+(?P<name>\w+)", "Function"), (r"^[ \t]*(?:public\s+)?typealias\s+(?P<name>\w+)", "TypeAlias")),
        (r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func)\s+)?(?P<path>[\w.]+)",), quotes='"', inherit="swift", variables=(r"\b(?:let|var)\s+(?P<name>\w+)\s*:\s*(?P<type>[A-Z]\w*)", r"\b(?:let|var)\s+(?P<name>\w+)\s*=\s*(?P<type>[A-Z]\w*)\("), fields=r"^[ \t]+(?:(?:public|private|fileprivate|internal|static|lazy|weak)\s+)*(?:let|var)\s+(?P<name>\w+)"),
    "lua": Rules(
        ((r"^[ \t]*local\s+function\s+(?P<name>\w+)", "Function"), (r"^[ \t]*function\s+(?:\w+\.)*(?P<owner>\w+)[.:](?P<name>\w+)", "Method"), (r"^[ \t]*function\s+(?P<name>\w+)(?![\w.:])", "Function"), (r"^[ \t]*(?:local\s+)?(?P<owner>\w+)\.(?P<name>\w+)\s*=\s*function\b", "Method"), (r"^[ \t]*local\s+(?P<name>\w+)\s*=\s*function\b", "Function"), (r"^local\s+(?P<name>[A-Z][A-Z0-9_]+)\s*=", "Constant"), (r"^(?:local\s+)?(?P<name>[A-Z]\w*)\s*=\s*(?:\{|setmetatable)", "Class")),
        (r"(?:local\s+(?P<alias>\w+)\s*=\s*)?require\s*\(?\s*['\"](?P<path>[^'\"]+)['\"]",), line_comment=("--",), block_comment=("--[[", "]]"), body="end", inherit="lua", variables=(r"\blocal\s+(?P<name>\w+)\s*=\s*(?P<type>[A-Z]\w*)[.:]new\b",)),
    "gdscript": Rules(
        ((r"^[ \t]*class_name\s+(?P<name>\w+)", "Class"), (r"^[ \t]*class\s+(?P<name>\w+)", "Class"), (r"^[ \t]*(?:static\s+)?func\s+(?P<name>\w+)", "Function"), (r"^[ \t]*signal\s+(?P<name>\w+)", "Field"), (r"^[ \t]*enum\s+(?P<name>\w+)", "Enum"), (r"^[ \t]*const\s+(?P<name>\w+)", "Constant"), (r"^(?:@\w+(?:\([^)]*\))?\s+)*var\s+(?P<name>\w+)", "Variable")),
        (r"(?:(?:const|var)\s+(?P<alias>\w+)\s*:?=\s*)?(?:pre)?load\(\s*['\"](?P<path>[^'\"]+)['\"]\s*\)",), line_comment=("#",), block_comment=None, body="indent", inherit="gdscript", variables=(r"\bvar\s+(?P<name>\w+)\s*:\s*(?P<type>[A-Z]\w*)", r"\bvar\s+(?P<name>\w+)\s*:?=\s*(?P<type>[A-Z]\w*)\.new\b")),
}


def blanked(source: str, rules: Rules, strings: bool = True) -> str:
    """``source`` with comments, and strings unless told otherwise, as blanks; lines and places stay."""
    marks = [*rules.line_comment]
    parts = []
    if rules.block_comment:
        a, b = map(re.escape, rules.block_comment)
        parts.append(f"{a}(?:(?!{b}).)*(?:{b})?")
    parts += [re.escape(m) + r"[^\n]*" for m in marks]
    quoted = [rf"{q}(?:\\.|[^{q}\\\n])*{q}?" if q != "`" else r"`[^`]*`?" for q in rules.quotes]
    token = re.compile("|".join([*parts, *(f"(?P<s{i}>{x})" for i, x in enumerate(quoted))]), re.S)

    def blank(m: re.Match) -> str:
        if m.lastgroup and not strings:
            return m.group()
        return re.sub(r"[^\n]", " ", m.group())

    return token.sub(blank, source)


def _closing(code: str, start: int) -> int:
    """Place of the bracket that closes the one at ``start``, the text's end without one."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, start):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return len(code)


def _body_start(code: str, at: int) -> int:
    """Place of the bracket that opens the body of the definition whose header goes on at ``at``, -1 without a body.

    A header ends with its line unless a bracket is open, or the line's end or the next line's start says that it goes on.
    """
    depth = 0
    for m in re.compile(r"[(){;\n\[\]]").finditer(code, at):
        c = m.group()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "{" and depth <= 0:
            return m.start()
        elif c == ";" and depth <= 0:
            return -1
        elif c == "\n" and depth <= 0:
            before = code[at : m.start()].rstrip()[-1:]
            if before and before in ",:=<|&+":
                continue
            if not re.match(r"\s*(?:[{:,<>=|&)+-]|where\b|extends\b|implements\b|throws\b|noexcept\b|const\b|override\b)", code[m.start() :][:4_000]):
                return -1
    return -1


def _block_end(code: str, at: int, header_end: int, rules: Rules) -> int:
    """Place where the definition at ``at``, whose pattern ended at ``header_end``, ends."""
    line_end = code.find("\n", header_end)
    line_end = len(code) if line_end < 0 else line_end
    if rules.body == "brace":
        start = _body_start(code, header_end - 1 if code[header_end - 1 : header_end] == "{" else header_end)
        return _closing(code, start) if start >= 0 else line_end
    if rules.body == "end":
        depth = 0
        for m in re.compile(r"\b(?:function|if|do|repeat|end|until)\b|[{}]").finditer(code, at):
            word = m.group()
            if word in ("end", "until", "}"):
                depth -= 1
                if depth <= 0:
                    return m.end() - 1
            else:
                depth += 1
            if depth == 0 and m.start() > line_end:
                break
        return line_end
    own = len(code[code.rfind("\n", 0, at) + 1 :]) - len(code[code.rfind("\n", 0, at) + 1 :].lstrip(" \t"))
    last = line_end
    for m in re.compile(r"\n([ \t]*)([^\n]*)").finditer(code, line_end):
        if m.group(2).strip():
            if len(m.group(1)) <= own:
                break
            last = m.end()
    return last


def _names(text: str) -> list[str]:
    """Names in a list of types, without what stands in brackets."""
    flat, depth = [], 0
    for c in text:
        depth += c in "<([{"
        if depth == 0:
            flat.append(c)
        depth -= c in ">)]}" and depth > 0
    return [m.group(1) for x in "".join(flat).split(",") if (m := re.search(r"([A-Za-z_]\w*)\s*$", x.strip()))]


def _bases(kind: str, name: str, header: str, style: str) -> list[tuple[str, str]]:
    """(implements or extends, base) of a type's header."""
    if style == "words":
        out = [("extends", b) for m in re.finditer(r"\bextends\s+(.*?)(?=\bimplements\b|\{|$)", header, re.S) for b in _names(m.group(1))]
        return out + [("implements", b) for m in re.finditer(r"\bimplements\s+(.*?)(?=\bextends\b|\{|$)", header, re.S) for b in _names(m.group(1))]
    if style == "rust":
        if kind == "Impl":
            m = re.search(r"impl\b\s*(?:<[^{]*?>\s*)?([\w:<>, &']+?)\s+for\s+", header)
            return [("implements", re.sub("<.*", "", m.group(1)).split("::")[-1].strip())] if m else []
        m = re.search(rf"\b{name}\b\s*(?:<[^{{]*?>)?\s*:\s*([^{{]*)", header) if kind == "Trait" else None
        return [("extends", b.strip().split("<")[0].split("::")[-1]) for b in m.group(1).split("+") if b.strip() and not b.strip().startswith("'")] if m else []
    if style in ("csharp", "kotlin", "swift", "cpp"):
        m = re.search(rf"\b{re.escape(name)}\b\s*(?:<[^{{]*?>)?\s*(?:\([^{{]*?\))?\s*(?<!:):(?!:)\s*([^{{]*)", header, re.S)
        if not m:
            return []
        text = re.split(r"\bwhere\b", m.group(1))[0]
        if style == "cpp":
            return [("extends", b) for b in _names(re.sub(r"\b(?:public|private|protected|virtual)\b", "", text))]
        if style == "kotlin":
            calls = {b for b in re.findall(r"(\w+)\s*(?:<[^>]*>)?\s*\(", text)}
            return [("extends" if b in calls or kind == "Interface" else "implements", b) for b in _names(re.sub(r"\([^)]*\)", "", text))]
        names = _names(text)
        if style == "csharp":
            return [("implements" if re.match("I[A-Z]", b) and kind != "Interface" else "extends", b) for b in names]
        return [("extends" if kind == "Interface" or kind == "Class" and i == 0 and not re.search(r"(?:able|ible|Protocol|Delegate)$", b) else "implements", b) for i, b in enumerate(names)]
    if style == "gdscript":
        return [("extends", b) for b in re.findall(r"\bextends\s+\"?([\w./:]+)", header)]
    return []


def _doc(lines: list[str], at: int, language: str) -> str | None:
    """The comment right above line ``at`` (from 0), attributes passed."""
    i = at - 1
    while i >= 0 and re.match(r"\s*(?:#\[|@\w|\[[A-Z])", lines[i]):
        i -= 1
    marks = {"lua": "---?", "gdscript": "##?"}.get(language, "//[/!]?")
    found: list[str] = []
    if i >= 0 and lines[i].rstrip().endswith("*/"):
        while i >= 0:
            found.insert(0, lines[i])
            if lines[i].lstrip().startswith("/*"):
                break
            i -= 1
        return "\n".join(re.sub(r"^\s*/?\*+/?\s?|\s*\*+/\s*$", "", x) for x in found).strip() or None
    while i >= 0 and re.match(rf"\s*{marks}", lines[i]):
        found.insert(0, re.sub(rf"^\s*{marks}\s?", "", lines[i]))
        i -= 1
    return "\n".join(found).strip() or None


def _receiver(code: str, end: int, most: int = 200) -> str:
    """The whole expression that ends at ``end``: names, calls and indexes joined by dots and the like, without white space, its last ``most`` characters."""
    at, low = end, max(0, end - 10 * most)
    while at > low:
        if code[at - 1] in ")]":
            depth = 0
            while at > low:
                at -= 1
                depth += (code[at] in ")]") - (code[at] in "([")
                if depth == 0:
                    break
        word = re.search(r"[\w$]+$", code[max(low, at - most) : at])
        at -= len(word.group()) if word else 0
        joint = re.search(r"(?:\.|::|->|\?\.|!\.)\s*$", code[max(low, at - most) : at])
        if joint is None and not (at > low and word and code[at - 1] in ")]"):
            break
        at -= len(joint.group()) if joint else 0
        at = len(code[:at].rstrip()) if joint else at
    return "".join(code[at:end].split())[-most:]


FLOW = (("if_else", r"\bif\b"), ("loop", r"\b(?:for|while|loop)\b"), ("try_catch", r"\btry\b"), ("switch", r"\b(?:switch|match)\b"), ("error_path", r"\b(?:throw|raise|panic!|bail!|return\s+Err)\b"), ("call_chain", r"(?:\.\s*\w+\([^()]*\)\s*){3,}"))


def extract(language: str, source: str) -> list[tuple]:
    """Rows of one source text; none of an unknown language. Of a Python text, lines that the grammar refuses are left out."""
    if language == "python":
        return _python(source)
    rules = LANGUAGES.get(language)
    if rules is None:
        return []
    code, lines = blanked(source, rules), source.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    import bisect

    line_of = lambda at: bisect.bisect_right(starts, at)
    out: list[tuple] = []
    # (start, end, name, kind, owner) of definitions; of several patterns at one place the first counts.
    found: dict[int, tuple[int, str, str, str | None]] = {}
    for pattern, kind in rules.defs:
        # A definition starts a line, or follows a bracket or semicolon in one.
        anywhere = re.sub(r"^\^", r"(?:^|(?<=[{};]))", pattern) if rules.body == "brace" else pattern
        for m in re.compile(anywhere, re.M).finditer(code):
            at, name = m.start("name"), m.group("name")
            if at in found or name in CONTROL or m.group().split(None, 1)[0] in STATEMENTS:
                continue
            found[at] = (m.start() + len(m.group()) - len(m.group().lstrip()), m.end(), name, kind, m.groupdict().get("owner"))
    spans = []
    for at, (begin, header_end, name, kind, owner) in sorted(found.items()):
        spans.append((begin, _block_end(code, begin, header_end, rules), name, kind, owner, at))
    types = [x for x in spans if x[3] in TYPES]
    callables, calls = [], set()
    file_class = next((x[2] for x in spans if language == "gdscript" and re.match(r"class_name", code[x[0] : x[0] + 10])), None)

    def innermost(rows: list[tuple], at: int) -> tuple | None:
        best = None
        for x in rows:
            if x[0] < at <= x[1] and (best is None or x[0] > best[0]):
                best = x
        return best

    for begin, end, name, kind, owner, at in spans:
        holder = innermost([x for x in types if x[0] < begin], begin)
        inside = owner or (holder[2] if holder and holder[3] != "Module" else None) or (file_class if kind in ("Function", "Variable", "Constant", "Field") and file_class != name else None)
        if kind == "Method" and language in ("java", "csharp", "cpp", "typescript", "javascript"):
            around = innermost(callables, begin)
            if not inside or around and (holder is None or around[0] > holder[0]):
                calls.add(at)
                continue  # a call that looks like a definition
        if "::" in name:
            inside, name = name.split("::")[-2:]
        if kind == "Function" and inside and not (innermost([x for x in spans if x[3] in ("Function", "Method") and x[0] < begin], begin)):
            kind = "Method"
        if kind == "Variable" and inside:
            kind = "Field"
        first, last = line_of(begin), line_of(min(end, len(code) - 1) if code else 0)
        stop = re.compile(r"[{;]" if rules.body == "brace" else r"\n").search(code, at)
        header = " ".join(source[begin : stop.start() if stop else len(source)].split())
        if kind != "Impl":
            out.append(("symbol", name, kind, first, last, _doc(lines, first - 1, language)))
            out.append(("signature", name, kind, first, last, header))
            if inside:
                out.append(("defines", inside, kind, first, last, name))
        if kind in ("Function", "Method"):
            callables.append((begin, end, name))
            if inside and holder and holder[3] == "Impl" and not re.search(r"\bfor\b", code[holder[0] : code.find("{", holder[0])]):
                out.append(("inherent", inside, "Method", first, last, name))
        if kind in TYPES:
            body = _body_start(code, at + len(name)) if rules.body == "brace" else -1
            line_stop = code.find("\n", at) if "\n" in code[at:] else len(code)
            full = code[begin : body if body >= 0 else line_stop] if rules.body == "brace" else code[begin : code.find("\n", begin) if "\n" in code[begin:] else len(code)]
            out.extend((what, name, kind, first, first, base) for what, base in _bases(kind, name, full, rules.inherit))
            if rules.inherit == "go":
                out.extend(("extends", name, kind, line_of(begin + m.start() + 1), line_of(begin + m.start() + 1), m.group(1)) for m in re.finditer(r"\n[ \t]+\*?(?:\w+\.)?([A-Z]\w*)[ \t]*(?=\n)", code[begin:end]))
        own = header.replace(name, " ", 1)
        for used in sorted(set(re.findall(r"\b[A-Z]\w*\b", own))):
            if kind in ("Function", "Method") and used not in (name, "Self", inside):
                out.append(("uses", name, "Type", first, first, used))
    if rules.fields:
        for m in re.compile(rules.fields, re.M).finditer(code):
            holder, inner = innermost(types, m.start("name")), innermost(callables, m.start("name"))
            if holder and holder[3] not in ("Module", "Impl", "Enum") and not inner and m.start("name") not in found and m.group("name") not in WORDS:
                line = line_of(m.start("name"))
                out.append(("symbol", m.group("name"), "Field", line, line, _doc(lines, line - 1, language)))
                out.append(("signature", m.group("name"), "Field", line, line, lines[line - 1].strip()))
                out.append(("defines", holder[2], "Field", line, line, m.group("name")))
                out.extend(("uses", holder[2], "Type", line, line, t) for t in sorted(set(re.findall(r"\b[A-Z]\w*\b", code[m.start() : m.end()]))) if t != m.group("name"))
    if rules.inherit == "lua":
        for m in re.finditer(r"(?:(\w+)\s*=\s*)?setmetatable\(\s*(\w+|\{\s*\})\s*,\s*\{\s*__index\s*=\s*(\w+)", code):
            name = m.group(2) if not m.group(2).startswith("{") else m.group(1)
            if name:
                out.append(("extends", name, "Class", line_of(m.start()), line_of(m.start()), m.group(3)))
    if rules.inherit == "gdscript":
        for m in re.finditer(r"^extends\s+\"?([\w./:]+)", source, re.M):
            if file_class:
                out.append(("extends", file_class, "Class", line_of(m.start()), line_of(m.start()), m.group(1)))
    defined = {m for x in spans if x[5] not in calls for m in (x[5], x[5] + x[2].rfind("::") + 2)}
    seen = set()
    for m in re.finditer(r"(?:(?P<receiver>[\w\])]+)\s*(?P<dot>\.|->|::|:|\?\.)\s*)?(?P<name>[A-Za-z_]\w*)\s*!?\(", code):
        owner, name, line = innermost(callables, m.start("name")), m.group("name"), line_of(m.start("name"))
        if owner is None and language == "lua":
            owner = (0, 0, "<module>")
        if name in WORDS or m.start("name") in defined or owner is None:
            continue
        if (owner[2], name, line) not in seen:  # one row for each caller, callee and line
            seen.add((owner[2], name, line))
            out.append(("call", owner[2], "Call", line, line, name))
        if m.group("receiver"):
            out.append(("method_call", owner[2], _receiver(code, m.end("receiver")), line, line, name))
    for pattern in rules.imports:
        with_strings = blanked(source, rules, strings=False)
        for m in re.compile(pattern, re.M).finditer(with_strings):
            line = line_of(m.start("path"))
            out.append(("import", m.group("path"), "Import", line, line, m.groupdict().get("alias")))
    if language == "go":
        blocks = [m.span(1) for m in re.finditer(r"^import\s*\(([^)]*)\)", source, re.M)]
        out = [r for r in out if r[0] != "import" or lines[r[3] - 1].lstrip().startswith("import") or any(a <= starts[r[3] - 1] < b for a, b in blocks)]
    for pattern in rules.variables:
        for m in re.compile(pattern).finditer(code):
            line = line_of(m.start("name"))
            if m.group("name") not in WORDS and m.group("type") not in WORDS:
                out.append(("variable", m.group("name"), "Type", line, line, m.group("type")))
    if rules.flow:
        for kind, pattern in FLOW:
            for m in re.compile(pattern).finditer(code):
                owner = innermost(callables, m.start())
                if owner is None:
                    continue
                brace = re.compile(r"[{;\n]").search(code, m.end()) if kind not in ("error_path", "call_chain") else None
                end = _closing(code, brace.start()) if brace and brace.group() == "{" else m.end() - 1
                out.append(("flow", owner[2], kind, line_of(m.start()), line_of(end), None))
    return sorted(set(out), key=lambda r: (r[3], r[0], r[1], r[4], str(r[5]), r[2]))


#: Lines of a Python text that are given up, one by one, before all of it is.
REPAIRS = 50


def _repaired(source: str) -> tuple[ast.Module | None, set[int]]:
    """The tree of a Python text and the lines that it was read without: each line that the grammar refuses is replaced, one that opens a block by another that does."""
    lines, lost = source.split("\n"), set()
    for _ in range(REPAIRS):
        try:
            return ast.parse("\n".join(lines)), lost
        except SyntaxError as e:
            # Brackets or quotes left open are reported where they began.
            at = min(max(1, e.lineno or 1), len(lines))
            if at in lost:
                at = next((i for i in range(at - 1, 0, -1) if lines[i - 1].strip() and i not in lost), 0) or next((i for i in range(at + 1, len(lines) + 1) if lines[i - 1].strip() and i not in lost), 0)
                if not at:
                    return None, lost
            old = lines[at - 1]
            lines[at - 1] = old[: len(old) - len(old.lstrip())] + ("if 1:" if old.rstrip().endswith(":") else "pass") if "indent" not in (e.msg or "") else ""
            lost.add(at)
        except (ValueError, RecursionError):
            return None, lost
    return None, lost


def _python(source: str) -> list[tuple]:
    tree, lost = _repaired(source)
    if tree is None:
        return []
    out: list[tuple] = []
    flows = {ast.If: "if_else", ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop", ast.Try: "try_catch", ast.Match: "switch", ast.Raise: "error_path"}

    def text(x: ast.AST) -> str:
        return ast.unparse(x)

    def types_in(x: ast.AST | None) -> list[str]:
        return sorted({n.id for n in ast.walk(x) if isinstance(n, ast.Name) and n.id[:1].isupper()}) if x is not None else []

    stack: list[tuple[ast.AST, str | None, str | None, bool]] = [(tree, None, None, False)]  # node, function, class, elif
    while stack:
        node, owner, inside, _ = stack.pop()
        for x in ast.iter_child_nodes(node):
            own, within, depth = owner, inside, False
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "Method" if inside else "Function"
                head = f"{'async ' if isinstance(x, ast.AsyncFunctionDef) else ''}def {x.name}({text(x.args)}){f' -> {text(x.returns)}' if x.returns else ''}"
                out.append(("symbol", x.name, kind, x.lineno, x.end_lineno, ast.get_docstring(x)))
                out.append(("signature", x.name, kind, x.lineno, x.end_lineno, head))
                if inside:
                    out.append(("defines", inside, "Method", x.lineno, x.end_lineno, x.name))
                    out.append(("inherent", inside, "Method", x.lineno, x.end_lineno, x.name))
                used = {t for a in [*x.args.args, *x.args.kwonlyargs, *x.args.posonlyargs] for t in types_in(a.annotation)} | set(types_in(x.returns))
                out.extend(("uses", x.name, "Type", x.lineno, x.lineno, t) for t in sorted(used))
                out.extend(("variable", a.arg, "Type", a.lineno, a.lineno, t) for a in x.args.args for t in types_in(a.annotation)[:1])
                own, within = x.name, None
            elif isinstance(x, ast.ClassDef):
                out.append(("symbol", x.name, "Class", x.lineno, x.end_lineno, ast.get_docstring(x)))
                out.append(("signature", x.name, "Class", x.lineno, x.end_lineno, f"class {x.name}({', '.join(map(text, x.bases))})" if x.bases else f"class {x.name}"))
                out.extend(("extends", x.name, "Class", x.lineno, x.lineno, text(b)) for b in x.bases)
                within = x.name
            elif isinstance(x, ast.Call):
                name = x.func.attr if isinstance(x.func, ast.Attribute) else x.func.id if isinstance(x.func, ast.Name) else None
                if name and not owner:
                    out.append(("call", "<module>", "Call", x.lineno, x.end_lineno, name))
                elif name:
                    out.append(("call", owner, "Call", x.lineno, x.end_lineno, name))
                    if isinstance(x.func, ast.Attribute):
                        out.append(("method_call", owner, text(x.func.value)[:200], x.lineno, x.end_lineno, name))
                        chain, y = 1, x.func.value
                        while isinstance(y, ast.Call) and isinstance(y.func, ast.Attribute):
                            chain, y = chain + 1, y.func.value
                        if chain == 3:
                            out.append(("flow", owner, "call_chain", x.lineno, x.end_lineno, None))
            elif isinstance(x, ast.Import):
                out.extend(("import", a.name, "Import", x.lineno, x.lineno, a.asname) for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                out.extend(("import", f"{'.' * x.level}{x.module or ''}.{a.name}" if x.module or x.level else a.name, "Import", x.lineno, x.lineno, a.asname) for a in x.names)
            elif isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                out.extend(("variable", x.target.id, "Type", x.lineno, x.lineno, t) for t in types_in(x.annotation)[:1])
                if inside and not owner:
                    out.append(("symbol", x.target.id, "Field", x.lineno, x.end_lineno, None))
                    out.append(("defines", inside, "Field", x.lineno, x.end_lineno, x.target.id))
            elif isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name):
                target = x.targets[0].id
                if isinstance(x.value, ast.Call) and isinstance(x.value.func, ast.Name) and x.value.func.id[:1].isupper():
                    out.append(("variable", target, "Type", x.lineno, x.lineno, x.value.func.id))
                if not owner:
                    kind = "Field" if inside else "Constant" if target.isupper() else "Variable"
                    out.append(("symbol", target, kind, x.lineno, x.end_lineno, None))
                    if inside:
                        out.append(("defines", inside, kind, x.lineno, x.end_lineno, target))
            if owner and type(x) in flows and not (isinstance(node, ast.If) and isinstance(x, ast.If) and x in node.orelse):
                out.append(("flow", owner, flows[type(x)], x.lineno, x.end_lineno, None))
            stack.append((x, own, within, depth))
    return sorted((r for r in out if r[3] not in lost), key=lambda r: (r[3], r[0], r[1], r[4], str(r[5]), r[2]))


def dump(source: str) -> list[dict]:
    """The syntax tree of a Python text as rows {depth, node, line, end_line, name}, for JSON lines; deeper nodes than MAX_DEPTH are left out."""
    out, stack = [], [(ast.parse(source), 0)]
    while stack:
        node, depth = stack.pop()
        out.append({"depth": depth, "node": type(node).__name__, "line": getattr(node, "lineno", None), "end_line": getattr(node, "end_lineno", None), "name": getattr(node, "name", None) or getattr(node, "id", None)})
        if depth < MAX_DEPTH:
            stack += [(x, depth + 1) for x in reversed(list(ast.iter_child_nodes(node)))]
    return out


def hooks(source: str) -> list[tuple[str, str, int]]:
    """(hook, bound names, line) of React hooks in a script: useState, useEffect, useContext, useReducer, useMemo, useCallback, useRef and use* of one's own."""
    rules = LANGUAGES["typescript"]
    code = blanked(source, rules)
    found = []
    for m in re.finditer(r"(?:(?:const|let|var)\s+(?P<names>\[[^\]]*\]|\{[^}]*\}|\w+)\s*(?::[^=\n]+)?=\s*)?(?:React\.)?(?P<hook>use[A-Z]\w*)\s*(?:<[^>(]*>)?\(", code):
        names = ",".join(re.findall(r"\w+", m.group("names") or ""))
        found.append((m.group("hook"), names, code.count("\n", 0, m.start("hook")) + 1))
    return found
