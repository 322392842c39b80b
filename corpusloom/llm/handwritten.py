"""Files that nobody in the project wrote by hand.

Each file is lexed and its tokens are emitted again in a canonical format: one statement, brace or
listed item per line. How the original layout compares says what made it: an original that expands
many times over was minified; one whose lines of code all go to a few emitted forms, each spaced
the same wherever it occurs, was generated; one that is nearly all literals is data kept as code.
A head comment in which a tool names itself supports the second. Copies of third-party libraries
are known by the libraries' names in the path's folders, by a head comment that states a release or
origin, and by content: a file most of whose emitted lines are those of a known copy is one as well.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.stage import materialise

LANGUAGES = ("python", "javascript", "typescript", "rust")
#: Emitted lines per original line, and characters per line, from which a layout is minified.
EXPANSION, LINE_LENGTH = 6.0, 160
#: Share of the lines of code that go to the four commonest forms from which a layout is uniform, and lines from which that
#: says anything. Imports and constants are no evidence: they look alike in anybody's file. Long files by hand
#: repeat forms too, but spread over many.
COMMON, UNIFORM_LINES = 0.85, 16
#: Forms per line of code, and lines, with a tool's own statement at the head of the file.
UNIFORM_STATED, UNIFORM_LINES_STATED = 0.5, 4
#: Share of literals in the code, and number of literals, from which a file is bulk data.
LITERALS, LITERALS_LEAST = 0.6, 40
#: Lowest hashes of emitted lines by which contents are compared, those a file must have, and the share of them that makes a copy.
SKETCH, SKETCH_LEAST, COPIED = 32, 12, 0.8

_C_TOKEN = re.compile(r"""(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<m>`(?:[^`\\]|\\.)*`|b?r(?P<h>#*)"[\s\S]*?"(?P=h))|(?P<q>b?"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\\n]|\\.)*')|(?P<n>\b\d[\w.]*)|(?P<w>\w+)|(?P<p>[^\w\s])""", re.S)
_PY_TOKEN = re.compile(r"""(?P<c>\#[^\n]*)|(?P<m>[A-Za-z]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)))|(?P<q>[A-Za-z]{0,2}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))|(?P<n>\b\d[\w.]*)|(?P<w>\w+)|(?P<p>[^\w\s])""", re.S)
_STATEMENT = frozenset("as async await break class const continue def do elif else enum except export extends fn for from function if impl import in interface let match mod mut new not or pub raise return self static struct super this throw trait try type use var while with yield".split())
_COMMENT_START = {"python": ("#", '"""', "'''"), "": ("//", "/*", "*", "<!--")}

#: How tools state that they made a file (fixed phrases).
_STATED = re.compile(
    r"""@generated\b|<auto-?generated|\bauto-?generated\ (?:file|by|from|code)\b|\bautomatically\ (?:generated|created|produced)\b|\bcode\ generated\ by\b|\b(?:this\ file\ (?:was|is)\ )generated\b|\bgenerated\ (?:by|with|from|using)\ \S+
    |\bmachine[ -](?:written|generated|made)\b|\b(?:hand|manual)\ edits\ (?:are|will\ be|get)\ (?:overwritten|lost)|\bchanges\ will\ be\ (?:lost|overwritten)|\bAUTOGENERATED\b
    |\bautomatisch\ (?:erzeugt|generiert|erstellt)\b|\b(?:généré|produit|créé)\ (?:automatiquement|par\ \S+,)|\b(?:generado|producido|creado)\ (?:automáticamente|por\ \S+,)|\bne\ pas\ modifier\b|\bno\ (?:modificar|editar)\b|\bnicht\ (?:von\ Hand\ )?(?:ändern|bearbeiten)\b|\boutput\ of\ \S+\ \(""",
    re.X | re.I,
)


class Layout(NamedTuple):
    """What laying a file out canonically says about it."""

    lines: int
    expansion: float
    line_length: float
    forms: float
    common: float
    evidence: int
    literals: int
    literal_share: float
    emitted: list[str]


def layout(text: str, language: str) -> Layout:
    """Emits a text's tokens canonically and measures its own layout against that; comments are no code."""
    python = language == "python"
    token = _PY_TOKEN if python else _C_TOKEN
    ends = [i for i, ch in enumerate(text) if ch == "\n"]
    emitted: list[str] = []
    line: list[str] = []
    forms: dict[int, list[str]] = {}
    open_: list[str] = []
    code, literal, literals, was, last = 0, 0, 0, -1, 0

    def emit() -> None:
        if line:
            emitted.append(" ".join(line))
            line.clear()

    for m in token.finditer(text):
        g, n, piece = m.lastgroup, m.end() - m.start(), m.group()
        at = bisect.bisect_left(ends, m.start())
        if g == "c":
            continue
        code += n
        kind = piece
        if g in ("q", "n"):
            literals += 1
            literal += n
            kind = "s" if g == "q" else "0"
        elif g in ("m", "h"):
            kind = "s"
            if python and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
                code -= n  # documentation
                continue
            if _is_data(piece):
                literals += n // 16
                literal += n
        elif g == "w" and piece not in _STATEMENT:
            kind = "w"
        if python and at != was and not open_:
            emit()
        form = forms.setdefault(at, [])
        form.append(kind if at != was or m.start() == last else " " + kind)  # how it is spaced is part of the form
        was, last = at, m.end()
        if piece in ("}", "]", ")") and open_:
            open_.pop()
        if piece == "}" and not python:
            emit()
        line.append(piece)
        if piece in ("{", "[", "("):
            open_.append(piece)
        within = open_[-1] if open_ else ""
        if piece == ";" and within != "(" or piece == "," and within in ("{", "[") or piece in ("{", "}") and not python:
            emit()
    emit()
    lines = [x for x in text.split("\n") if x.strip()]
    shapes = Counter("".join(x) for x in forms.values())
    told = Counter({x: n for x, n in shapes.items() if not _IDIOM.match(x)})
    count, of_code, evidence = max(1, len(lines)), max(1, shapes.total()), told.total()
    common = sum(n for _, n in told.most_common(4)) / max(1, evidence)
    return Layout(shapes.total(), len(emitted) / count, len(text) / count, len(shapes) / of_code, common, evidence, literals, literal / max(1, code), emitted)


#: Forms of imports, exports of names, and plain constants.
_IDIOM = re.compile(r"(?:export |pub |from |import |use ).*(?:from|import|use)\b|import\b|from\b|use\b|pub use\b|mod\b|pub mod\b|export \{|export \*|(?:export |pub |static )*(?:const |let |var |type )?w(?:: ?&?(?:'?w ?)*)? ?= ?-?[s0w.]+,?;?$|[s0w],?$|[\])}]+[,;]?$")


def _is_data(literal: str) -> bool:
    """Whether a literal over several lines holds packed data rather than text or a query."""
    body = literal.strip("`'\"r#b")
    spaces = len(re.findall(r"[ \t]", body))
    digits = sum(map(str.isdigit, body))
    return len(body) >= 400 and (spaces < 0.03 * len(body) or digits > 0.4 * len(body))


def head_comment(text: str, language: str) -> str:
    """The comment lines that open a file, before any code."""
    starts = _COMMENT_START.get(language, _COMMENT_START[""])
    out: list[str] = []
    inside = ""
    for line in text.split("\n"):
        s = line.strip()
        if inside:
            out.append(s)
            if inside in s:
                inside = ""
        elif not s or s.startswith("#!") or s in ("'use strict';", '"use strict";'):
            continue
        elif s.startswith(starts):
            out.append(s)
            for opens, closes in (("/*", "*/"), ('"""', '"""'), ("'''", "'''")):
                if s.startswith(opens) and closes not in s[len(opens) :]:
                    inside = closes
        else:
            break
    return "\n".join(out)


class Libraries:
    """Recognises copies of named libraries by folder and by head comment."""

    def __init__(self, names: Iterable[str]):
        one = "|".join(sorted((re.escape(x.strip()) for x in names if x and x.strip()), key=len, reverse=True)) or r"(?!)"
        version = r"v?\d+(?:\.\d+)+"
        self.folder = re.compile(rf"(?:^|/)(?:{one})(?:[-@_]{version}[^/]*)?/", re.I)
        self.stated = re.compile(
            rf"""\b(?:bundled|vendored|verbatim|unmodified|local|patched|modified)?\s*copy\ of\ (?:{one})\b|\b(?:imported|copied|taken|vendored|adapted|derived|ported|extracted)\ (?:\w+\ )?(?:from|of)\ (?:{one})\b
            |(?:{one})(?:\.\w+)?[\s|,:/-]*(?:version\s*|release\s*)?{version}|(?:{one})\.\w+\s*\|\s*version\b""",
            re.X | re.I,
        )

    def __call__(self, file: str, head: str) -> bool:
        return bool(self.folder.search(file) or self.stated.search(head))


def reason(file: str | None, text: str | None, language: str | None, libraries: Libraries) -> str | None:
    """`third party`, `minified`, `data` or `generated`; None for what was written by hand.

    Null or empty files, and other languages, are None.
    """
    if language not in LANGUAGES or not text:
        return None
    head = head_comment(text, language)
    if libraries(file or "", head):
        return "third party"
    return judge(layout(text, language), head)


def judge(x: Layout, head: str) -> str | None:
    """What a layout, with the head comment, says about a file's making."""
    if x.literal_share >= LITERALS and x.literals >= LITERALS_LEAST:
        return "data"
    if x.expansion >= EXPANSION and x.line_length >= LINE_LENGTH:
        return "minified"
    stated = bool(_STATED.search(head)) and not re.search(r"\bgenerated (?:at|every|each|on)\b", head)
    if x.common >= COMMON and x.evidence >= UNIFORM_LINES or stated and x.forms <= UNIFORM_STATED and x.lines >= UNIFORM_LINES_STATED:
        return "generated"
    return None


def sketch(emitted: list[str]) -> list[int]:
    """The SKETCH lowest hashes of distinct emitted lines that say something."""
    return sorted({xxhash.xxh3_64_intdigest(x) - 2**63 for x in emitted if len(x) >= 12})[:SKETCH]


def reasons(files: DataFrame, libraries: DataFrame, *keys: str, file: str = "file", text: str = "text", language: str = "language", most_libraries: int = 10_000) -> DataFrame:
    """keys of every file with the `reason` why it is not hand-written (null if it is).

    `libraries` is a list of names (lib_name) of at most `most_libraries` rows, which every task
    gets; null names are ignored. Repeated files stay repeated, empty tables give empty results.
    A file is also a third-party copy if COPIED of the lowest hashes of its emitted lines are among those of
    one file that is one by path or head.
    """
    names = [r[0] for r in libraries.where("lib_name is not null").select("lib_name").distinct().limit(most_libraries + 1).collect()]
    if len(names) > most_libraries:
        raise ValueError("more library names than most_libraries")
    wanted = F.col(language).isin(*LANGUAGES)
    source = files.select(*keys, F.col(file).alias("__file"), F.col(language).alias("__language"), F.when(wanted, F.col(text)).alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[: len(keys)]) + ", reason string, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Libraries(names)
        for batch in batches:
            found, sketches = [], []
            for at, lang, body in zip(*(batch.column(len(keys) + i).to_pylist() for i in range(3)), strict=True):
                why, hashes = None, None
                if lang in LANGUAGES and body:
                    head = head_comment(body, lang)
                    x = layout(body, lang)
                    why = "third party" if known(at or "", head) else judge(x, head)
                    hashes = sketch(x.emitted) if why in (None, "third party") else None
                found.append(why)
                sketches.append(hashes)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, pa.string()), pa.array(sketches, pa.list_(pa.int64()))], names=[*keys, "reason", "sketch"])

    judged = materialise(source.mapInArrow(run, schema), "handwritten")
    mark = F.xxhash64(F.array_join("sketch", ",")).alias("mark")
    # two neighbouring hashes stay neighbours somewhere in any two lists that share so many, and are common in copies only
    two = F.explode(F.transform(F.sequence(F.lit(1), F.size("sketch") - 1), lambda i: F.xxhash64(F.element_at("sketch", i), F.element_at("sketch", i + 1)))).alias("two")
    sketched = judged.where(F.size("sketch") >= SKETCH_LEAST).select("reason", mark, "sketch").distinct()
    open_, copies = sketched.where("reason is null").drop("reason"), sketched.where("reason = 'third party'").select(F.col("mark").alias("copy"), F.col("sketch").alias("of"))
    met = open_.select("mark", two).join(copies.withColumnRenamed("of", "sketch").select("copy", two), "two").select("mark", "copy").distinct()
    like = met.join(open_, "mark").join(copies, "copy").where(F.size(F.array_intersect("sketch", "of")) >= F.size("sketch") * COPIED).select("mark").distinct()
    out = judged.withColumn("mark", mark).join(like.withColumn("copied", F.lit(True)), "mark", "left")
    return out.select(*keys, F.when(F.col("reason").isNull() & F.col("copied"), "third party").otherwise(F.col("reason")).alias("reason"))
