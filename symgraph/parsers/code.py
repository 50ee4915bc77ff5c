"""Symbols, calls, imports and inheritance of source files.

Python goes through the standard library's syntax tree. Other languages share one engine: comments and strings are blanked
in place, declarations are found by a table of patterns for each language, spans by matching braces (or ``end``), and owners,
callers and qualified names by which spans enclose which. A parser for a language, or for more extensions, can be registered.
"""

from __future__ import annotations

import ast
import bisect
import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .clones import structural_hash

#: Names before a bracket that are no calls (fixed values).
NOT_CALLS = set("if else for while do switch case default catch finally try return throw await yield new delete typeof instanceof super this break continue function class interface type const let var import export of in and or not elif with match sizeof def fn func impl pub where loop unless until foreach using lock print_r isset empty array list".split())
BUILT_DIRS = {"lib", "dist", "build", "out", "target", "esm", "cjs", "compiled"}
SOURCE_DIRS = ("src", "source", "app", "packages")
CANDIDATE_EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs .py .go .rs .java .c .cpp .h .hpp .cs .rb .php .kt .scala .swift .lua".split()


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    heritage: list[dict] = field(default_factory=list)
    aliases: list[dict] = field(default_factory=list)


_REGISTRY: dict[str, Callable[[str, str], Parsed]] = {}
_EXTENSIONS: dict[str, str] = {}


def register(language: str, parse: Callable[[str, str], Parsed], extensions: tuple[str, ...] = ()) -> None:
    """``parse(path, content)`` for a language; its extensions, without dots, come before the built-in ones."""
    _REGISTRY[language] = parse
    _EXTENSIONS.update({e.lower().lstrip("."): language for e in extensions})


def registered() -> tuple[dict[str, Callable[[str, str], Parsed]], dict[str, str]]:
    """What has been registered in this process, to be sent along with a task."""
    return dict(_REGISTRY), dict(_EXTENSIONS)


def adopt(parsers: dict[str, Callable[[str, str], Parsed]], extensions: dict[str, str]) -> None:
    _REGISTRY.update(parsers)
    _EXTENSIONS.update(extensions)


def custom_extensions() -> dict[str, str]:
    return dict(_EXTENSIONS)


def parse(path: str, content: str, language: str) -> Parsed:
    """Never raises: a file that a parser cannot read goes through the pattern engine."""
    if (own := _REGISTRY.get(language)) is not None:
        out = own(path, content)
    else:
        out = None
        if language == "python":
            try:
                out = _python(path, content)
            except (SyntaxError, ValueError, RecursionError):
                out = None
        out = out or _patterns(path, content, language)
    lines = content.split("\n")
    for s in out.symbols:
        s.setdefault("structural_hash", structural_hash("\n".join(lines[s["start_line"] - 1 : s["end_line"]])) if s["kind"] in ("function", "method") else "")
    out.aliases = out.aliases or library_aliases(lines, out.imports)
    return out


def _symbol(path: str, name: str, qname: str, kind: str, start: int, end: int, signature: str, exported: bool, docstring: str = "", visibility: str = "public") -> dict:
    return {"id": f"{path}:{qname}:{start}", "name": name, "qname": qname, "kind": kind, "file": path, "start_line": start, "end_line": end, "signature": re.sub(r"\s+", " ", signature).strip(" {"), "docstring": docstring, "is_exported": exported, "visibility": visibility}


def _import(path: str, module: str, specifiers: list[str], candidates: list[str] | None = None) -> dict:
    return {"src_path": path, "imported_path": module, "candidates": resolve_candidates(path, module) if candidates is None else candidates, "specifiers": list(dict.fromkeys(s for s in specifiers if s))}


def resolve_candidates(path: str, module: str) -> list[str]:
    """Paths that a relative import may mean: as it stands, with every extension, as an index or package; build folders stand for source folders, but never the last segment."""
    if not module.startswith("."):
        return []
    stem = posixpath.normpath(posixpath.join(posixpath.dirname(path), module))
    folder, name = posixpath.split(stem)
    bases = [name] + ([name[: name.rindex(".")]] if re.search(r"\.(?:[mc]?[jt]sx?|py)$", name) else [])
    parts, folders = folder.split("/") if folder else [], [folder]
    for i, part in enumerate(parts):
        if part in BUILT_DIRS:
            folders += ["/".join([*parts[:i], s, *parts[i + 1 :]]) for s in SOURCE_DIRS]
    out = []
    for f in folders:
        for b in bases:
            p = posixpath.join(f, b) if f else b
            out += [p, *(p + e for e in CANDIDATE_EXTENSIONS), *(f"{p}/index{e}" for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")), f"{p}/__init__.py"]
    return list(dict.fromkeys(out))


def library_aliases(lines: list[str], imports: list[dict]) -> list[dict]:
    """Locals assigned from an expression that holds an imported binding as a whole word."""
    bound = {s: i["imported_path"] for i in imports if not i["imported_path"].startswith(".") for s in i["specifiers"] if s != "*"}
    out = []
    if bound:
        word = re.compile(r"(?<![\w$])(" + "|".join(map(re.escape, sorted(bound, key=len, reverse=True))) + r")(?![\w$])")
        for line in lines:
            if re.match(r"\s*(?://|#|\*|/\*)", line):
                continue
            m = re.match(r"\s*(?:export\s+)?(?:const|let|var|val|auto|final)?\s*(?:[\w<>\[\]]+\s+)?([A-Za-z_$][\w$]*)\s*(?::[^=]+)?:?=(?!=)\s*(.+)", line)
            if m and (hit := word.search(m[2])) and m[1] not in bound:
                out.append({"alias": m[1], "module": bound[hit[1]]})
    return [dict(t) for t in dict.fromkeys(tuple(x.items()) for x in out)]


# Python


def _python(path: str, content: str) -> Parsed:
    tree, out, lines = ast.parse(content), Parsed(), content.split("\n")

    def name_of(node: ast.expr) -> str:
        return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""

    def visit(node: ast.AST, owners: tuple[str, ...], in_class: bool, caller: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                qname, kind = ".".join((*owners, child.name)) if in_class or is_class else child.name, "class" if is_class else "method" if in_class else "function"
                header = " ".join(lines[child.lineno - 1 : (child.body[0].lineno - 1 if child.body[0].lineno > child.lineno else child.lineno)]).rstrip()
                s = _symbol(path, child.name, qname, kind, child.lineno, child.end_lineno or child.lineno, header.rstrip(":"), not child.name.startswith("_"), ast.get_docstring(child) or "", "private" if child.name.startswith("_") else "public")
                out.symbols.append(s)
                if is_class:
                    out.heritage += [{"sub_id": s["id"], "super_name": b.rpartition(".")[2], "rel": "extends"} for base in child.bases if (b := name_of(base.value if isinstance(base, ast.Subscript) else base))]
                for d in child.decorator_list:
                    visit(ast.Expr(d), owners, in_class, caller)
                visit(child, (*owners, child.name) if is_class else owners, is_class, caller if is_class else s["id"])
                continue
            if isinstance(child, ast.Import):
                for a in child.names:
                    out.imports.append(_import(path, a.name, [a.asname or a.name.partition(".")[0]], _module_candidates(path, a.name, 0)))
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                extra = [c for a in child.names for c in _module_candidates(path, f"{child.module + '.' if child.module else ''}{a.name}", child.level)]
                out.imports.append(_import(path, module, [a.asname or a.name for a in child.names], _module_candidates(path, child.module or "", child.level) + (extra if child.level else [])))
            elif isinstance(child, ast.Call) and caller and (full := name_of(child.func)):
                out.calls.append({"caller_id": caller, "callee_name": full.rpartition(".")[2], "callee_qname": full, "file": path, "line": child.lineno})
            visit(child, owners, in_class, caller)

    visit(tree, (), False, None)
    return out


def _module_candidates(path: str, module: str, level: int) -> list[str]:
    """Of a dotted module: beside the file for relative imports, at the root and beside the file for absolute ones."""
    tail = module.replace(".", "/")
    folder = posixpath.dirname(path)
    for _ in range(level - 1):
        folder = posixpath.dirname(folder)
    roots = [folder] if level else ["", folder]
    paths = [posixpath.join(r, tail) if tail else r for r in roots]
    return list(dict.fromkeys(x for p in paths if p for x in (f"{p}.py", f"{p}/__init__.py")))


# Other languages: patterns


@dataclass(frozen=True)
class Language:
    #: (kind, pattern with the group ``name`` and perhaps ``ext``, ``impl``, ``owner``)
    declarations: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    comments: str = r"//[^\n]*|/\*.*?\*/"
    strings: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    ends: str = "brace"
    exported: Callable[[str, str], bool] = lambda head, name: True
    joiner: str = "."


_ID = r"[A-Za-z_$][\w$]*"
_TS = Language(
    (
        ("class", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_ID})(?:<[^{{]*?>)?(?:\s+extends\s+(?P<ext>[\w$.]+)(?:<[^{{]*?>)?)?(?:\s+implements\s+(?P<impl>[^{{]+))?"),
        ("interface", rf"(?:export\s+)?(?:default\s+)?interface\s+(?P<name>{_ID})(?:<[^{{]*?>)?(?:\s+extends\s+(?P<ext>[^{{]+))?"),
        ("enum", rf"(?:export\s+)?(?:const\s+)?enum\s+(?P<name>{_ID})"),
        ("type", rf"(?:export\s+)?type\s+(?P<name>{_ID})(?:<[^=\n]*>)?\s*="),
        ("function", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})\s*(?:<[^(]*>)?\("),
        ("function", rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:<[^(]*>)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_ID})\s*(?::[^=]+?)?=>"),
        ("method", rf"^[ \t]+(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+)*(?P<name>{_ID}|constructor)\s*\??(?:<[^(\n]*>)?\([^;{{}}]*\)\s*(?::[^;{{\n=]+(?:\{{[^{{}}\n]*\}}[^;{{\n]*)?)?\s*[{{;]"),
    ),
    (rf"import\s+(?:type\s+)?(?P<what>[\w$*{{}}\s,]+?)\s+from\s+['\"](?P<module>[^'\"]+)['\"]", r"import\s+['\"](?P<module>[^'\"]+)['\"]", rf"(?:const|let|var)\s+(?P<what>[\w${{}}\s,:]+?)\s*=\s*require\(\s*['\"](?P<module>[^'\"]+)['\"]\s*\)", r"export\s+(?P<what>[\w$*{}\s,]+?)\s+from\s+['\"](?P<module>[^'\"]+)['\"]"),
    strings=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:\[!&|?;])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[a-z]*",
    exported=lambda head, name: bool(re.match(r"\s*export\b", head)),
)
_C_FUNCTION = rf"^(?:[\w:*&<>,~\[\] \t]+?[\s*&])(?:(?P<owner>\w+)::)?(?P<name>~?{_ID})\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{{"
_JAVA_METHOD = rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|synchronized|virtual|override|async|sealed|partial|default|new)\s+)*[\w<>\[\],.?]+\s+(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w,.\s]+)?(?:where[^{{]*)?(?:\{{|;|=>)"
_public = lambda head, name: bool(re.search(r"\bpublic\b", head))
LANGUAGES: dict[str, Language] = {
    "typescript": _TS,
    "javascript": _TS,
    "go": Language(
        (("struct", rf"^type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+struct\b"), ("interface", rf"^type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+interface\b"), ("type", rf"^type\s+(?P<name>{_ID})\s+=?\s*(?!struct\b|interface\b)[\w*\[]"), ("method", rf"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>{_ID})\s*\("), ("function", rf"^func\s+(?P<name>{_ID})\s*(?:\[[^\]]*\])?\(")),
        (r"^\s*import\s+(?:(?P<what>[\w.]+)\s+)?\"(?P<module>[^\"]+)\"", r"^\t(?:(?P<what>[\w.]+)\s+)?\"(?P<module>[^\"]+)\"\s*$"),
        strings=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", exported=lambda head, name: name[:1].isupper(),
    ),
    "rust": Language(
        (("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(?P<name>{_ID})"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>{_ID})"), ("trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>{_ID})(?:<[^{{]*>)?(?:\s*:\s*(?P<ext>[^{{]+))?"), ("impl", rf"^\s*(?:unsafe\s+)?impl(?:<[^{{]*?>)?\s+(?:(?P<impl>[\w:]+)(?:<[^{{]*?>)?\s+for\s+)?(?P<name>\w+)"), ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?fn\s+(?P<name>{_ID})")),
        (r"^\s*(?:pub\s+)?use\s+(?P<module>[^;]+);", r"^\s*(?:pub\s+)?mod\s+(?P<module>\w+)\s*;"),
        strings=r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", exported=lambda head, name: bool(re.match(r"\s*pub\b", head)),
    ),
    "java": Language((("class", rf"(?:\w+\s+)*?(?:class|record|enum)\s+(?P<name>{_ID})(?:<[^{{]*?>)?(?:\([^)]*\))?(?:\s+extends\s+(?P<ext>[\w.]+)(?:<[^{{]*?>)?)?(?:\s+implements\s+(?P<impl>[^{{]+))?\s*\{{"), ("interface", rf"(?:\w+\s+)*?interface\s+(?P<name>{_ID})(?:<[^{{]*?>)?(?:\s+extends\s+(?P<ext>[^{{]+))?"), ("method", _JAVA_METHOD)), (r"^\s*import\s+(?:static\s+)?(?P<module>[\w.*]+)\s*;",), exported=_public),
    "c_sharp": Language((("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)"), ("class", rf"^[ \t]*(?:\w+[ \t]+)*?(?:class|struct|record)\s+(?P<name>{_ID})(?:<[^{{]*?>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<ext>[^{{]+))?"), ("interface", rf"^[ \t]*(?:\w+[ \t]+)*?interface\s+(?P<name>{_ID})(?:<[^{{]*?>)?(?:\s*:\s*(?P<ext>[^{{]+))?"), ("method", _JAVA_METHOD), ("method", rf"^[ \t]*(?:public|private|protected|internal)\s+(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?::\s*(?:base|this)\([^)]*\)\s*)?\{{")), (r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<what>\w+)\s*=\s*)?(?P<module>[\w.]+)\s*;",), exported=_public),
    "c": Language((("struct", rf"^\s*(?:typedef\s+)?struct\s+(?P<name>{_ID})\s*\{{"), ("enum", rf"^\s*(?:typedef\s+)?enum\s+(?P<name>{_ID})\s*\{{"), ("function", _C_FUNCTION)), (r"^\s*#\s*include\s+[<\"](?P<module>[^>\"]+)[>\"]",)),
    "cpp": Language((("class", rf"^\s*(?:template\s*<[^{{;]*>\s*)?class\s+(?P<name>{_ID})(?:\s+final)?\s*(?::[^{{;]+)?\{{"), ("struct", rf"^\s*(?:template\s*<[^{{;]*>\s*)?struct\s+(?P<name>{_ID})\s*(?::[^{{;]+)?\{{"), ("enum", rf"^\s*enum\s+(?:class\s+)?(?P<name>{_ID})"), ("function", _C_FUNCTION)), (r"^\s*#\s*include\s+[<\"](?P<module>[^>\"]+)[>\"]",)),
    "ruby": Language((("class", r"^\s*class\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<ext>[\w:]+))?"), ("module", r"^\s*module\s+(?P<name>[\w:]+)"), ("function", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)")), (r"^\s*require(?:_relative)?\s*\(?\s*['\"](?P<module>[^'\"]+)['\"]",), comments=r"#[^\n]*", ends="end"),
    "php": Language((("class", rf"(?:abstract\s+|final\s+)?(?:class|trait|enum)\s+(?P<name>{_ID})(?:\s+extends\s+(?P<ext>[\w\\]+))?(?:\s+implements\s+(?P<impl>[^{{]+))?"), ("interface", rf"interface\s+(?P<name>{_ID})(?:\s+extends\s+(?P<ext>[^{{]+))?"), ("function", rf"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<name>{_ID})\s*\(")), (r"^\s*use\s+(?P<module>[\w\\]+)(?:\s+as\s+(?P<what>\w+))?\s*;",), comments=r"//[^\n]*|/\*.*?\*/|#(?!\[)[^\n]*", exported=lambda head, name: "private" not in head),
    "kotlin": Language((("class", rf"^[ \t]*(?:\w+[ \t]+)*?(?:class|object)\s+(?P<name>{_ID})(?:<[^{{]*?>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<ext>[^{{\n]+))?"), ("interface", rf"interface\s+(?P<name>{_ID})(?:\s*:\s*(?P<ext>[^{{\n]+))?"), ("function", rf"^[ \t]*(?:\w+[ \t]+)*?fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>{_ID})\s*\(")), (r"^\s*import\s+(?P<module>[\w.*]+)",), exported=lambda head, name: "private" not in head),
    "solidity": Language((("class", rf"(?:abstract\s+)?(?:contract|library)\s+(?P<name>{_ID})(?:\s+is\s+(?P<ext>[^{{]+))?"), ("interface", rf"interface\s+(?P<name>{_ID})(?:\s+is\s+(?P<ext>[^{{]+))?"), ("function", rf"function\s+(?P<name>{_ID})\s*\(")), (r"^\s*import\s+[^'\"]*['\"](?P<module>[^'\"]+)['\"]",)),
    "lua": Language((("function", r"^\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)\s*\("), ("function", r"^\s*(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function\s*\(")), (), comments=r"--\[\[.*?\]\]|--[^\n]*", ends="end", exported=lambda head, name: not re.match(r"\s*local\b", head)),
    "zig": Language((("function", rf"^\s*(?:pub\s+)?(?:export\s+|inline\s+)?fn\s+(?P<name>{_ID})\s*\("),), (r"@import\(\"(?P<module>[^\"]+)\"\)",), exported=lambda head, name: "pub " in head),
    "bash": Language((("function", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{"), ("function", r"^\s*function\s+(?P<name>[\w-]+)\s*\{")), (), comments=r"(?<![$\\{])#[^\n]*"),
    "elixir": Language((("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("function", r"^\s*defp?\s+(?P<name>\w+[?!]?)")), (r"^\s*(?:import|alias|use|require)\s+(?P<module>[\w.]+)",), comments=r"#[^\n]*", ends="end", exported=lambda head, name: "defp" not in head),
    "python": Language((("class", r"^\s*class\s+(?P<name>\w+)(?:\((?P<ext>[^)]*)\))?"), ("function", r"^\s*(?:async\s+)?def\s+(?P<name>\w+)\s*\(")), (r"^\s*from\s+(?P<module>[\w.]+)\s+import\s+(?P<what>[^\n]+)", r"^\s*import\s+(?P<module>[\w.]+)"), comments=r"#[^\n]*", strings=r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", ends="indent", exported=lambda head, name: not name.startswith("_")),
}
#: For any other language: what looks like a function in most; no calls.
GENERIC = Language((("function", rf"^\s*(?:(?:pub|public|export|private|static|async|override|open|internal)\s+)*(?:function|func|fun|fn|def|sub|proc|method|let\s+rec)\s+(?P<name>{_ID})"),))
_TYPES = {"class", "interface", "struct", "trait", "enum", "module", "impl", "namespace"}


def _patterns(path: str, content: str, language: str) -> Parsed:
    lang, out = LANGUAGES.get(language, GENERIC), Parsed()
    masked = re.sub(f"(?P<c>{lang.comments})|(?P<s>{lang.strings})", lambda m: re.sub(r"[^\n]", " ", m.group()), content, flags=re.S)
    starts = [0, *(m.end() for m in re.finditer("\n", content))]
    line_of = lambda at: bisect.bisect_right(starts, at)
    lines = masked.split("\n")
    found = []
    taken: set[int] = set()
    for kind, pattern in lang.declarations:
        for m in re.finditer(pattern, masked, re.M):
            name = m["name"]
            if m.start("name") in taken or name in NOT_CALLS - {"list", "array", "type", "match", "delete"} or (kind == "method" and re.match(r"\s*(?:return|throw|new|else|await|yield)\b", m.group())):
                continue
            taken.add(m.start("name"))
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            end = _end(masked, lines, m, lang.ends, starts, line_of)
            if language == "rust" and kind == "function" and masked[end - 1 : end] == ";":
                continue  # a trait's signature without a body
            found.append([at, end, kind, name, m])
    found.sort(key=lambda x: (x[0], -x[1]))
    open_: list = []
    callers = []
    for at, end, kind, name, m in found:
        while open_ and open_[-1][1] <= at:
            open_.pop()
        owners = [o for o in open_ if o[2] in _TYPES]
        if kind == "method" and not owners and "owner" not in m.re.groupindex:
            continue  # what looks like a method outside a type is a call or a block
        if kind == "method" and any(o[2] in ("function", "method") for o in open_[-1:]):
            continue
        groups = m.groupdict()
        prefix = [o[3] for o in owners] or ([groups["owner"]] if groups.get("owner") else [])
        kind = "method" if kind == "function" and prefix and not (owners and owners[-1][2] == "namespace") and not (owners and owners[-1][2] == "module" and language == "elixir") else kind
        qname, start, head = lang.joiner.join([*prefix, name]), line_of(at), content[at : m.end()]
        if kind == "method" and language not in ("python",) and open_ and open_[-1][2] in ("function", "method"):
            kind, qname = "function", name
        row = [at, end, kind, name]
        open_.append(row)
        if kind == "impl":
            if groups.get("impl"):
                out.heritage.append({"sub_id": f"{path}:{name}", "super_name": groups["impl"].rpartition("::")[2], "rel": "implements"})
            continue
        if kind == "namespace":
            if "{" not in masked[m.end() : m.end() + 3]:
                row[1] = len(content)  # for the rest of the file
            continue
        head_line = content[starts[start - 1] : m.end()]
        exported = lang.exported(head_line, name) or bool(kind == "method" and owners and owners[-1][2] == "interface")
        visibility = next((v for v in ("private", "protected") if re.search(rf"\b{v}\b", head_line)), "public")
        s = _symbol(path, name, qname, kind, start, line_of(max(at, end - 1)), content[at : content.find("{", m.end() - 1) if "{" in content[m.end() - 1 : m.end() + 200] else m.end()], exported, _docstring(content.split("\n"), start), visibility)
        out.symbols.append(s)
        for rel, group in (("extends", "ext"), ("implements", "impl")):
            for part in re.split(r",(?![^<]*>)|\+", groups.get(group) or ""):
                if base := re.sub(r"<.*|\(.*|\bwhere\b.*", "", part, flags=re.S).strip().rpartition("::")[2].rpartition("\\")[2]:
                    out.heritage.append({"sub_id": s["id"], "super_name": base.rpartition(".")[2], "rel": "extends" if language in ("c_sharp", "kotlin", "solidity") else rel})
        if kind in ("function", "method"):
            callers.append((m.end() - 1, end, s["id"], m.start("name")))
    if lang is not GENERIC:
        names = {c[3] for c in callers}
        for m in re.finditer(rf"(?:\b(new)\s+)?(?:(\w+)(?:\.|::|->|\?\.))?({_ID})\s*(?:<[\w\s,]*>)?\(", masked):
            if m[3] in NOT_CALLS or m.start(3) in names:
                continue
            inside = [c for c in callers if c[0] <= m.start() < c[1]]
            if inside:
                out.calls.append({"caller_id": inside[-1][2], "callee_name": m[3], "callee_qname": f"{m[2]}.{m[3]}" if m[2] else m[3], "file": path, "line": line_of(m.start(3))})
    for pattern in lang.imports:
        for m in re.finditer(pattern, content, re.M):
            first = m.start() + len(m.group()) - len(m.group().lstrip())
            if masked[first] == " " and content[first] not in "\"'`":
                continue  # inside a comment or string
            out.imports.append(_import(path, *_imported(language, m["module"].strip(), (m.groupdict().get("what") or "").strip())))
    return out


def _imported(language: str, module: str, what: str) -> tuple[str, list[str]]:
    if language == "rust":
        base, _, names = module.partition("{")
        found = [re.sub(r".*\bas\s+|.*::", "", x.strip()) for x in (names.rstrip("}").split(",") if names else [module.rpartition("::")[2]])]
        return base.rstrip(":"), found
    if not what:
        return module, [re.split(r"[./\\]", module)[-1]] if language in ("java", "kotlin", "php", "c_sharp", "go") else []
    parts = [re.sub(r"^type\s+", "", x.strip(" {}\n\t")) for x in what.replace("{", ",").replace("}", ",").split(",")]
    return module, [re.sub(r".*\bas\s+|.*:\s*", "", x).strip() for x in parts if x]


def _end(masked: str, lines: list[str], m: re.Match, ends: str, starts: list[int], line_of) -> int:
    """Offset after the declaration's body."""
    first = line_of(m.start("name"))
    if ends == "indent":
        depth, last = len(lines[first - 1]) - len(lines[first - 1].lstrip()), first
        for k in range(first, len(lines)):
            if lines[k].strip():
                if len(lines[k]) - len(lines[k].lstrip()) <= depth and not lines[k].lstrip().startswith(")"):
                    break
                last = k + 1
        return starts[last] - 1 if last < len(starts) else len(masked)
    if ends == "end":
        depth = 0
        for w in re.finditer(r"\b(?:class|module|def|defp|defmodule|do|function|begin|case|then|end)\b|^\s*(?:if|unless|while)\b", masked[starts[first - 1] :], re.M):
            depth += -1 if w.group() == "end" else 0 if w.group() in ("then", "def", "defp", "defmodule") and "do" in masked[starts[first - 1] + w.end() : starts[first - 1] + w.end() + 200].split("\n")[0].split() else 0 if w.group() == "then" else 1
            if depth <= 0:
                return starts[first - 1] + w.end()
        return len(masked)
    at, depth, round_ = m.end("name"), 0, 0
    while at < len(masked):
        c = masked[at]
        if c in "([":
            round_ += 1
        elif c in ")]":
            round_ -= 1
        elif c == "{" and round_ <= 0:
            depth += 1
        elif c == "}" and round_ <= 0:
            depth -= 1
            # a brace pair inside a return type ends before the body begins
            if depth <= 0 and not re.match(r"[ \t>]*\{", masked[at + 1 : at + 40]):
                return at + 1
        elif c == ";" and depth == 0 and round_ <= 0:
            return at + 1
        elif c == "\n" and depth == 0 and round_ <= 0 and re.match(r"\n\s*(?:\n|$|[})])", masked[at : at + 200]):
            return at
        at += 1
    return at


def _docstring(lines: list[str], start: int) -> str:
    """The comment block that ends on the line before."""
    out, k = [], start - 2
    while k >= 0 and re.match(r"\s*(?://|/\*|\*|#)", lines[k]):
        out.append(re.sub(r"^\s*(?:///?|/\*\*?|\*/|\*|#)\s?|\*/\s*$", "", lines[k]).strip())
        k -= 1
    return "\n".join(x for x in reversed(out) if x)
