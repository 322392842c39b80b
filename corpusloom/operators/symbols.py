"""Symbols of source files: functions, methods, classes and their like, one row each."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.chunks import chunk_text

FOUND = "symbol_type string, symbol_name string, parent_symbol string, start_line int, end_line int, content string, docstring string, signature string, exported boolean, is_async boolean, imports array<string>, ast_parse_failure boolean, exports array<string>"
Symbol = tuple


def python_symbols(text: str) -> list[Symbol]:
    """Functions, methods and classes of a Python module by its syntax tree; SyntaxError if it has none.

    Function bodies are not searched. Content begins at the def or class line, decorators left out.
    """
    tree = ast.parse(text)
    lines = text.split("\n")
    imports = list(dict.fromkeys(name for node in ast.walk(tree) for name in _imported(node)))
    out: list[Symbol] = []

    def visit(nodes: list[ast.stmt], parent: str | None) -> None:
        for node in nodes:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                body = node.body[0].lineno
                head = "\n".join(lines[node.lineno - 1 : max(node.lineno, body - 1)]).strip()
                if body == node.lineno:
                    head = f"class {node.name}" if isinstance(node, ast.ClassDef) else f"def {node.name}(...)"
                signature = re.sub(r"\s*:\s*(?:#.*)?$", "", head)
                content = "\n".join(lines[node.lineno - 1 : node.end_lineno])
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if parent else "function"
                name = node.name if is_class or not parent else f"{parent}.{node.name}"
                out.append((kind, name, None if is_class else parent, node.lineno, node.end_lineno, content, ast.get_docstring(node, clean=True), signature, not node.name.startswith("_"), isinstance(node, ast.AsyncFunctionDef), imports, None, []))
                if is_class:
                    visit(node.body, node.name)
            else:
                for field in ("body", "orelse", "finalbody"):
                    visit([n for n in getattr(node, field, []) if isinstance(n, ast.stmt)], parent)
                for handler in getattr(node, "handlers", []):
                    visit(handler.body, parent)

    visit(tree.body, None)
    return out


def _imported(node: ast.AST) -> list[str]:
    if isinstance(node, ast.Import):
        return [a.name + (f" as {a.asname}" if a.asname else "") for a in node.names]
    if isinstance(node, ast.ImportFrom):
        base = "." * node.level + (node.module or "")
        return [base + ("" if base.endswith(".") or not base else ".") + a.name + (f" as {a.asname}" if a.asname else "") for a in node.names]
    return []


_SKIP = re.compile(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|b?r(?P<h>#*)"[\s\S]*?"(?P=h)|"(?:[^"\\]|\\[\s\S])*"|`(?:[^`\\]|\\[\s\S])*`|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.)*'(?!\w)|(?:(?<=[=(,:?&|!])|(?<=\breturn))\s*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*""")
_SCRIPT = re.compile(
    r"""^(?P<indent>[ \t]*)(?P<export>export\s+(?:default\s+)?)?(?:(?:declare|abstract)\s+)*(?:
     (?P<async>async\s+)?function\s*\*?\s*(?P<function>[\w$]+)\s*(?:<[^()]*>)?\(
    |class\s+(?P<class>[\w$]+)|interface\s+(?P<interface>[\w$]+)|(?:const\s+)?enum\s+(?P<enum>[\w$]+)
    |(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*(?::[^=\n]+)?=\s*(?P<arrow_async>async\s*)?(?:<[^()]*>)?\((?=[^\n]*(?:=>|\n|$))
    |(?:(?:public|private|protected|static|readonly|override|get|set)\s+)*(?P<method_async>async\s+)?\*?\s*(?P<method>\#?[\w$]+)\s*(?:<[^()]*>)?\((?=[^;\n]*\{?\s*$)
    )""",
    re.X | re.M,
)
_RUST = re.compile(
    r"""^(?P<indent>[ \t]*)(?P<export>pub(?:\([^)]*\))?\s+)?(?:(?:default|const|unsafe|extern\s+"[^"]*")\s+)*(?:
     (?P<async>async\s+)?(?:unsafe\s+)?fn\s+(?P<function>\w+)|struct\s+(?P<struct>\w+)|enum\s+(?P<enum>\w+)|(?:unsafe\s+)?trait\s+(?P<trait>\w+)|(?:unsafe\s+)?(?P<impl>impl\b[^{;]*)|mod\s+(?P<module>\w+)(?=\s*\{)
    )""",
    re.X | re.M,
)
_NO_METHOD = frozenset("if for while switch catch function return with super constructor_".split())


def _masked(text: str) -> str:
    """The text with comments and literals blanked, so that every bracket left is code."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _body(code: str, at: int) -> tuple[int, int] | None:
    """The body's brace after `at` and its partner; None if a semicolon or the end comes first."""
    depth = 0
    for m in re.compile(r"[()\[\]{};]|=>(?!\s*\{)").finditer(code, at):
        c = m.group()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth < 0:
                return None
        elif depth == 0 and c == "{":
            level = 0
            for b in re.compile(r"[{}]").finditer(code, m.start()):
                level += 1 if b.group() == "{" else -1
                if level == 0:
                    return m.start(), b.end()
            return m.start(), len(code)
        elif depth == 0 and (c == ";" or c == "=>"):
            return None
    return None


def _comment_before(lines: list[str], line: int) -> str | None:
    """The comment block that ends right above a line."""
    k = line - 1
    while k >= 0 and re.match(r"\s*(//|/\*|\*)", lines[k]) or k >= 0 and lines[k].rstrip().endswith("*/"):
        k -= 1
    return "\n".join(x.strip() if x.strip().startswith("//") else x.strip() if x.strip().startswith("/*") else " " + x.strip() for x in lines[k + 1 : line]) or None


_IMPORT = re.compile(r"(?<![\w$.])import\b\s*(?:(?:type|typeof)\b\s*(?=[{*]|(?!from\s)[\w$]))?(?:(?P<name>[\w$]+)\s*=(?!=)|(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\*\s*as\s+(?P<space>[\w$]+)|\{(?P<list>[^{}]*)\})?\s*\bfrom\b)")
_EXPORT = re.compile(
    r"""(?<![\w$.])export\b\s*(?:(?P<default>default\b)
    |(?:type\s*)?\{(?P<list>[^{}]*)\}|\*\s*as\s+(?P<space>[\w$]+)
    |(?:(?:declare|abstract|async)\s+)*(?:(?:function\b\s*\*?|class|interface|(?:const\s+)?enum|type|namespace|module|import)\s*\b(?P<name>[\w$]+)|(?P<variables>const|let|var)\b)
    )""",
    re.X,
)
_USE = re.compile(r"(?<![\w#$])use\s+([^;]+);")
_GAP = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))*")
_OPEN, _CLOSE = "([{", ")]}"
#: Words that begin an expression which is neither a name nor a call.
_NO_NAME = frozenset("async await delete false function class abstract import interface new null super this true typeof undefined void yield".split())


def _split(code: str) -> list[str]:
    """The parts between the commas that are inside no bracket."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(code):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(code[start:k])
            start = k + 1
    return [p.strip() for p in (*parts, code[start:]) if p.strip()]


def _closed(code: str, at: int) -> int:
    """Where the bracket at `at` has been closed."""
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] in _OPEN) - (code[k] in _CLOSE)
        if depth == 0:
            return k + 1
    return len(code)


def _specifiers(listed: str) -> list[str]:
    """The last name of each specifier; before `as default` and `as` with a literal, the name there."""
    names = []
    for item in _split(listed):
        words = re.findall(r"[\w$]+", item)
        while len(words) > 1 and (words[-1] == "as" or words[-2:] == ["as", "default"]):
            words.pop()
        names += words[-1:]
    return names


def _imported_names(code: str) -> list[str]:
    """Local names of all import statements: default, namespace, and each specifier's alias or name."""
    names: list[str] = []
    for m in _IMPORT.finditer(code):
        names += [m[k] for k in ("name", "default", "space") if m[k]] + _specifiers(m["list"] or "")
    return list(dict.fromkeys(names))


def _bound(pattern: str) -> list[str]:
    """Names that a binding takes, also within patterns of objects and arrays."""
    pattern = pattern.strip().removeprefix("...").strip()
    if pattern[:1] not in ("{", "["):
        return re.findall(r"^[\w$]+", pattern)
    names = []
    for item in _split(pattern[1 : _closed(pattern, 0) - 1]):
        key = re.match(r"(?:[\w$]+|\[[^\]]*\]|)\s*:", item) if pattern[0] == "{" else None
        names += _bound(item[key.end() :] if key else item)
    return names


def _declared(code: str, at: int) -> list[str]:
    """Names of the variables declared from `at` to the statement's end."""
    names: list[str] = []
    while True:
        while at < len(code) and code[at].isspace():
            at += 1
        if at < len(code) and code[at] in "{[":
            end = _closed(code, at)
        else:
            m = re.compile(r"[\w$]+").match(code, at)
            if not m:
                return names
            end = m.end()
        names += _bound(code[at:end])
        at, angle = end, 0
        while at < len(code):
            c = code[at]
            if c in _OPEN:
                at = _closed(code, at)
                continue
            if c == "<" and re.match(r"[\w$]", code[at - 1]):
                angle += 1
            elif c == ">" and angle and code[at - 1] != "=":
                angle -= 1
            elif c == "," and not angle:
                break
            elif c in ";)]}" or c == "\n" and _ended(code, at):
                return names
            at += 1
        if at >= len(code):
            return names
        at += 1


def _ended(code: str, at: int) -> bool:
    """Whether the statement ends at this line's end: no operator before it or after it."""
    before, after = code[:at].rstrip()[-1:], code[at:].lstrip()[:1]
    return before not in tuple("=+-*/%&|^?:<,.!~([{") and (not after or bool(re.match(r"[\w$@#}\]);]", after)))


def _default_name(text: str, code: str, at: int) -> str:
    """What `export default` names: an identifier, a call's callee, a function or class, or nothing."""
    at = _GAP.match(text, at).end()
    m = re.compile(r"(?:(?:async\s+)?function\b\s*\*?|(?:abstract\s+)?class\b)\s*(?!extends\b|implements\b)(?P<name>[\w$]+)").match(code, at)
    if m:
        return m["name"]
    m = re.compile(r"[^\W\d][\w$]*|\$[\w$]*").match(code, at)
    if not m or m.group() in _NO_NAME:
        return "default_export"
    end, found = m.end(), m.group()
    step = re.compile(r"\s*(?:(?P<call>(?:<[^;(){}]*>\s*)?(?:\?\.\s*)?\()|(?P<member>\??\.\s*\#?[\w$]+|!(?!=))|(?P<index>(?:\?\.)?\[))")
    while m := step.match(code, end):
        if m["call"]:
            found = text[at:end].strip()
        else:
            found = "default_export"
        end = m.end() if m["member"] else _closed(code, m.end() - 1)
    rest = code[end:]
    after = rest.lstrip()
    whole = not after or after[0] in ";}" or "\n" in rest[: len(rest) - len(after)] and bool(re.match(r"(?!(?:in|instanceof)\b)[\w$@]", after))
    return found if whole else "default_export"


def _exported_names(text: str, code: str) -> list[str]:
    """Names that the export statements give out; `default_export` for a default without a name."""
    names: list[str] = []
    for m in _EXPORT.finditer(code):
        if m["default"]:
            names.append(_default_name(text, code, m.end()))
        elif m["variables"]:
            names += _declared(code, m.end())
        else:
            names += [m[k] for k in ("name", "space") if m[k]] + _specifiers(m["list"] or "")
    return list(dict.fromkeys(names))


def _used_names(code: str) -> list[str]:
    """Last segments or aliases of all `use` declarations, also of nested lists; `self` is the segment before.

    `*` and `as _` bring no name.
    """

    def leaves(tree: str, before: str) -> Iterator[str]:
        tree = tree.strip()
        if tree.endswith("}") and "{" in tree:
            prefix, inner = tree.split("{", 1)
            prefix = prefix.strip().rstrip(":").strip()
            for item in _split(inner[:-1]):
                yield from leaves(item, prefix.split("::")[-1].strip() or before)
            return
        path, alias = (re.split(r"\s+as\s+", tree, maxsplit=1) + [""])[:2]
        last = path.split("::")[-1].strip()
        yield alias.strip() or (before if last == "self" and before else last)

    return list(dict.fromkeys(name for m in _USE.finditer(code) for name in leaves(m[1], "") if name not in ("", "*", "_")))


def brace_symbols(text: str, rust: bool) -> list[Symbol]:
    """Symbols of JavaScript, TypeScript or Rust by headers and balanced braces.

    Bodies of functions and methods are not searched. Rust methods carry `impl X` as parent.
    """
    code = _masked(text)
    if code.count("{") != code.count("}"):
        raise SyntaxError("unbalanced braces")
    lines = text.split("\n")
    found = list((_RUST if rust else _SCRIPT).finditer(code))
    imports, exports = (_used_names(code), []) if rust else (_imported_names(code), _exported_names(text, code))
    out: list[Symbol] = []
    inside: list[tuple[int, str, str]] = []  # end, kind, name
    for m in found:
        at = m.end() - len(m.group().lstrip())  # blanked comments may come first
        while inside and inside[-1][0] <= at:
            inside.pop()
        if inside and inside[-1][1] in ("function", "method"):
            continue
        g = m.groupdict()
        kind = next(k for k in ("function", "class", "interface", "enum", "arrow", "method", "struct", "trait", "impl", "module") if g.get(k))
        name = re.sub(r"\s+", " ", g[kind]).strip()
        owner = inside[-1] if inside and inside[-1][1] in ("class", "impl", "trait", "module") else None
        if kind == "method" and (owner is None or name in _NO_METHOD):
            continue
        body = _body(code, m.end() - (1 if kind in ("function", "arrow", "method") and not rust else 0))
        end = body[1] if body else (code.find(";", m.end()) + 1 or len(code))
        if kind in ("arrow", "method") and body is None:
            continue
        kind = "function" if kind == "arrow" else kind
        if kind == "function" and owner and rust:
            kind = "method"
        parent = owner[2] if kind == "method" else None
        shown = f"{parent}.{name}" if parent else name
        first, last = text.count("\n", 0, at) + 1, text.count("\n", 0, max(at, end - 1)) + 1
        signature = re.sub(r"\s*=\s*$", "", text[at : body[0] if body else end].strip())
        inside.append((end, kind, name))
        out.append((kind, shown, parent, first, last, text[text.rfind("\n", 0, at) + 1 : end], _comment_before(lines, first - 1), signature, bool(m["export"]), bool(g.get("async") or g.get("arrow_async") or g.get("method_async")), imports, None, exports))
    return out


PARSERS: dict[str, Callable[[str], list[Symbol]]] = {
    "python": python_symbols,
    "javascript": lambda text: brace_symbols(text, rust=False),
    "typescript": lambda text: brace_symbols(text, rust=False),
    "rust": lambda text: brace_symbols(text, rust=True),
}


def register_parser(language: str, parser: Callable[[str], list[Symbol]]) -> None:
    """Makes `parser` the one for a language; it must be picklable."""
    PARSERS[language.strip().lower()] = parser


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of (repo, file, language, text).

    A file whose parser fails, or whose language has none, comes as chunks of lines; after a failure
    they are marked with ast_parse_failure. Null texts are empty. Symbol and chunk ids are added.
    """
    parsers = dict(PARSERS)
    schema = "repo string, file string, language string, " + FOUND

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            rows = []
            for repo, file, language, text in batch.itertuples(index=False):
                text, failed = text or "", None
                parser = parsers.get((language or "").strip().lower())
                if parser:
                    try:
                        rows += [(repo, file, language, *s, *[[]] * (len(names) - 3 - len(s))) for s in parser(text)]  # a registered parser may leave exports out
                        continue
                    except (SyntaxError, ValueError, RecursionError):
                        failed = True
                for k, (a, b, body) in enumerate(chunk_text(text, language == "markdown")):
                    first = (body.split("\n", 1)[0].strip() if body else "") or f"Chunk {k + 1}"
                    rows.append((repo, file, language, "chunk", f"chunk_{k + 1}", None, a, b, body, None, first if len(first) <= 100 else first[:97] + "...", False, None, [], failed, []))
            yield pd.DataFrame(rows, columns=names)

    found = files.select("repo", "file", "language", "text").mapInPandas(run, schema)
    return found.withColumns({"symbol_id": F.concat_ws("::", "repo", "file", "symbol_name"), "chunk_id": F.concat_ws("::", "repo", "file", "symbol_name", F.col("start_line").cast("string"))})
