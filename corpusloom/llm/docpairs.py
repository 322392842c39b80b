"""Functions paired with their documentation.

Island grammars read only what is needed of a function's source: annotations, the signature up to
the brace or colon that opens the body, and the documentation that stands there. All other code is
water and skipped with its brackets balanced. Of documentation, only the prose is kept; a pair is
made if enough of it says more than the function's own name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of prose, other than those of the name, that make documentation worth keeping.
LEAST_WORDS = 3

_PY_SKIP = re.compile(r"""\#[^\n]*|[A-Za-z]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|[^#"'()\[\]{}:\w]+|\w+|.""", re.S)
_C_SKIP = re.compile(r"""//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.)*'(?![A-Za-z_])|=>|->|[^/"'`()\[\]{}=\-\w]+|\w+|.""", re.S)
_PY_DOC = re.compile(r"""\s*(?:(?P<doc>[rRuUbB]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))[ \t]*(?:[\#;\n]|\Z)|(?P<line>(?:[ \t]*\#[^\n]*(?:\n|\Z))+))""")
_C_DOC = re.compile(r"""\s*(?P<doc>/\*[\s\S]*?\*/|(?://[^\n]*(?:\n[ \t]*(?=//)|\n|\Z))+)""")


def documentation_in(content: str, language: str | None) -> str | None:
    """The docstring or comment that stands directly after the header of a function, else None."""
    python = language == "python"
    skip = _PY_SKIP if python else _C_SKIP
    pos, depth, seen = 0, 0, False
    while pos < len(content):
        m = skip.match(content, pos)
        t, pos = m.group(), m.end()
        if t in "([{" and not (t == "{" and depth == 0 and not python):
            depth += 1
            seen = seen or t == "("
        elif t in ")]}":
            depth -= 1
            if depth < 0:
                return None
        elif depth == 0 and seen and (t == ":" if python else t == "{"):
            break
        elif depth == 0 and t == "{":
            depth += 1  # a brace before any parameters is no body
    else:
        return None
    if python:
        m = re.compile(r"[ \t]*(?:#[^\n]*)?\n").match(content, pos)
        if m is None:
            m = _PY_DOC.match(content, pos)
            return m["doc"] if m and m["doc"] else None
        m = _PY_DOC.match(content, m.end())
        return (m["doc"] or m["line"]) if m else None
    m = _C_DOC.match(content, pos)
    return m["doc"] if m else None


# what is no prose; the words of tools and licences are fixed
_DIRECTIVE = re.compile(
    r"""^(?:\#!?\[|noqa\b|pylint\s*:|flake8\s*:|mypy\s*:|pyright\s*:|ruff\s*:|isort\s*:|fmt\s*:|yapf\s*:|black\s*:|type\s*:\s*ignore|pragma\b|nosec\b|nolint\b|NOSONAR\b|coverage\s*:|eslint[- ]|jshint\b|jslint\b|tslint\s*:|jscs\s*:|biome-ignore|deno-lint|prettier-ignore|stylelint-|istanbul\s+ignore|c8\s+ignore|v8\s+ignore|webpack[A-Z]|
    @ts-|@flow\b|@jsx\b|clippy::|rustfmt::|allow\(|deny\(|warn\(|cfg\(|region\b|endregion\b|sourceMappingURL|global[s]?\s+\w|vim?:|-\*-.*-\*-)""",
    re.X,
)
_LICENCE = re.compile(r"\bcopyright\b|\(c\)\s*\d{4}|©|\bSPDX-|\ball rights reserved\b|\blicen[cs]ed? under\b|\blicen[cs]e(?:\s+(?:file|text|terms))\b|\bpermission is hereby granted\b|\bwithout warrant(?:y|ies)\b|\bas is\b.*\bwarrant", re.I)
_TAG = re.compile(
    r"""^(?:
      [@\\](?:param|arg|argument|property|prop|typedef|template|field|member|throws|exception|raises?)\b(?:\[[^\]]*\])?\s*(?:\{(?:[^{}]|\{[^{}]*\})*\})?\s*(?:\[[^\]]*\]|[\w$.*]+)?\s*(?:[-–:]\s*)?
     |[@\\](?:returns?|yields?|type|see|since|version|deprecated|example|async|private|public|protected|internal|override|readonly|static|memberof|module|name|kind|class|function|callback|this|default|todo|author|license|copyright|brief|note|warning|\w+)\b\s*(?:\{(?:[^{}]|\{[^{}]*\})*\})?\s*(?:[-–:]\s*)?
     |:(?:param|parameter|arg|argument|key|keyword|type|var|ivar|cvar|raises?|except|exception)\b[^:\n]*:\s*
     |:(?:returns?|rtype|yields?|meta\b[^:\n]*)\s*:\s*
    )""",
    re.X,
)
_TYPE_TAG = re.compile(r"^(?::(?:type\b[^:]*|rtype\s*|vartype\b[^:]*):.*|@(?:type|see|since|version|author|license|module|memberof|name|class|typedef|template)\b.*)$")
_SECTION = re.compile(r"^(?:#+\s*)?(Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Throws|Errors|Attributes|Keyword Args|Panics|Safety|Notes?|Warnings?|See Also|References)\s*:?$", re.I)
_EXAMPLES = re.compile(r"^(?:#+\s*)?(?:@example\b|Examples?\b|Usage\b|Doctest\b)\s*:{0,2}$", re.I)
_ITEM = re.compile(r"^(?:[-*+]\s+)?`?(\*{0,2}[A-Za-z_$][\w$.]*)`?\s*(?:\([^)]*\))?\s*(?::|\s[-–]\s)\s*(.*)$")
_RULER = re.compile(r"^[\W_]*$")
_STUB = re.compile(r"^(?:TODO|FIXME|XXX|HACK|TBD|N/A|WIP)\b\s*(?:\([^)]*\))?\s*[:.\-]*\s*", re.I)
_CODE = re.compile(
    r"""^(?:>>>|\.\.\.\s|\$\s)|[{};]$|^[)\]}]|=>|->\s|^(?:[\w.$\[\]"']+(?:\s*,\s*[\w.$]+)*)\s*(?:[-+*/|&%^]|//|\*\*|<<|>>|:|\?\?|\|\|)?=\s*\S|^(?:let|const|var|val|mut)\s+[\w$\[{(]+.*=|^[\w$.]+(?:::[\w<>]+)*!?\(.*\)[;,]?$
    |^(?:if|elif|while|for|with|def|class|match|case|except|switch|catch|async\ def|try|else|finally)\b.*[:{]$|^(?:return|raise|throw|yield|await|assert)\b.*[()\[\]{}'"=]|^(?:import\s+[\w.]+(?:\s+as\s+\w+)?|from\s+[\w.]+\s+import\s+.*|use\s+[\w:]+.*;|export\s+\w+\s+.*[({=].*)$|^@\w+(?:\.\w+)*(?:\(.*\))?$|^\#\[""",
    re.X,
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
_LETTERS = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def _bare_lines(doc: str) -> Iterator[str]:
    """Lines of a documentation text without quotes and comment markers, indentation kept."""
    body = doc.strip()
    m = re.match(r"^[rRuUbB]{0,2}(\"\"\"|'''|\"|')([\s\S]*)\1$", body)
    if m:
        body = m.group(2)
    for line in body.split("\n"):
        line = re.sub(r"^\s*(?:///|//!|//|/\*[*!]?|\#(?!\[)+|\*(?!/)(?![\w*]))", "", line, count=1)
        line = re.sub(r"\*+/\s*$", "", line)
        yield line.rstrip()


def prose(doc: str | None) -> str:
    """The prose of a documentation text, one line per line that holds any.

    Markers, rulers, tool directives, licence lines, stub words, code and examples are left out;
    of tags and listed arguments only their descriptions stay. Null gives an empty text.
    """
    if not doc:
        return ""
    out: list[str] = []
    fenced = example = listed = licence = False
    for raw in _bare_lines(doc):
        s = raw.strip()
        if s.startswith(("```", "~~~")) and not _RULER.match(s.lstrip("~")) or s in ("```", "~~~"):
            fenced = not fenced
            continue
        if fenced:
            continue
        if not s:
            example = licence = False
            continue
        if s.startswith(">>>"):
            example = True
        if example:
            continue
        if _EXAMPLES.match(s):
            example = not s.startswith("@") or True
            continue
        if _RULER.match(s) or _DIRECTIVE.match(s):
            continue
        if _LICENCE.search(s):
            licence = True
            continue
        if licence:
            continue
        section = _SECTION.match(s)
        if section:
            listed = True
            continue
        if _TYPE_TAG.match(s):
            continue
        tag = _TAG.match(s)
        if tag:
            s = s[tag.end() :]
        elif listed and (item := _ITEM.match(s)):
            s = item.group(2)
        elif _CODE.search(s):
            continue
        s = _STUB.sub("", s).strip()
        if _WORD.search(s):
            out.append(s)
    return "\n".join(out)


def words_beyond(name: str | None, text: str) -> int:
    """Number of words of a prose text that are no words of the symbol's own name."""
    own = {p.lower() for p in _PIECE.findall(name or "")} | {(name or "").lower(), re.split(r"\W", name or "")[-1].lower()}
    n = 0
    for w in _WORD.findall(re.sub(r"`[^`]*`|\b\w+(?:[_.]\w+)+(?:\(\))?|\b\w+\(\)", " ", text)):
        if w.lower() not in own:
            # scripts without spaces: two characters make about a word
            n += max(1, len(_LETTERS.findall(w)) // 2)
    return n


def pairs(symbols: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(chunk_id, signature, content, description) of functions and methods with real documentation.

    `symbols` has chunk_id, symbol_type, symbol_name, language, signature, content and docstring.
    Documentation is docstring or, where that is null, what stands in content after the header; an
    empty docstring is not null and says nothing. Rows without chunk_id or content give nothing.
    Exact repeats are kept; the caller decides on them.
    """
    source = symbols.where("symbol_type in ('function', 'method') and chunk_id is not null and content <> ''").select("chunk_id", "signature", "content", "symbol_name", "language", "docstring")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            contents, names, languages, docs = (batch.column(i).to_pylist() for i in range(2, 6))
            for i, (content, name, language, doc) in enumerate(zip(contents, names, languages, docs, strict=True)):
                text = prose(documentation_in(content, language) if doc is None else doc)
                if text and words_beyond(name, text) >= least_words:
                    keep.append(i)
                    texts.append(text)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:3]), pa.array(texts, pa.string())], names=["chunk_id", "signature", "content", "description"])

    return source.mapInArrow(run, "chunk_id string, signature string, content string, description string")
