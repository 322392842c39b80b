"""Column expressions over files: which to ignore, which are text, which language they are in."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import rules


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The lower-case suffix with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def ignore_rule(path: Column, patterns: Sequence[str] = rules.IGNORED) -> Column:
    """The first pattern that a path below the repository matches; null if none does."""
    parts, name = F.split(path, "/"), file_name(path)
    tests = []
    for p in patterns:
        if "*" in p or "?" in p:
            glob = F.lit("(?i)" + rules.glob_regex(p))
            hit = F.rlike(name, glob) | F.rlike(path, glob)
        elif "/" in p:
            hit = F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit(f"/{p}/"))
        else:
            hit = F.array_contains(parts, p)
            if p.startswith("."):
                hit = hit | (suffix(path) == p)
        tests.append(F.when(hit, F.lit(p)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def disposition(path: Column, content: Column, length: Column, ignored: Sequence[str] = rules.IGNORED, binary: Sequence[str] = rules.BINARY_SUFFIXES, most_bytes: int = rules.MOST_BYTES) -> Column:
    """What becomes of a file: ignored, binary_suffix, large, empty, binary or text.

    Cheap tests come first. A file is binary if its first bytes hold a NUL or too many control
    characters; the share is of characters in valid UTF-8, else of bytes. Null content is unreadable.
    """
    head = F.decode(F.substring(content, 1, rules.SNIFFED_BYTES), "ISO-8859-1")
    control = F.length(F.regexp_replace(head, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    size = F.when(F.is_valid_utf8(F.substring(content, 1, rules.SNIFFED_BYTES).cast("string")), F.length(F.regexp_replace(head, r"[\x80-\xbf]", ""))).otherwise(F.length(head))
    return (
        F.when(ignore_rule(path, ignored).isNotNull(), "ignored")
        .when(suffix(path).isin(*binary), "binary_suffix")
        .when(length > most_bytes, "large")
        .when(content.isNull(), "unreadable")
        .when(length == 0, "empty")
        .when(head.rlike(r"\x00") | (control / F.greatest(size, F.lit(1)) > rules.MOST_CONTROL), "binary")
        .otherwise("text")
    )


@F.pandas_udf(StringType())
def _without_bad_bytes(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decoded(content: Column) -> Column:
    """Content as text: bad bytes dropped, line ends as `\\n`. Only bad content leaves the JVM."""
    good = F.is_valid_utf8(content.cast("string"))
    text = F.when(good, content.cast("string")).otherwise(_without_bad_bytes(F.when(~good, content)))
    return F.regexp_replace(text, "\r\n?", "\n")


def language(path: Column, text: Column) -> Column:
    """The language of a file by its name, its first line, its suffix; else text."""
    name = F.lower(file_name(path))
    first = F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)
    by_name = functools.reduce(lambda w, kv: w.when(name == kv[0], kv[1]), list(rules.NAME_LANGUAGES.items())[1:], F.when(name == "dockerfile", "dockerfile"))
    by_name = F.coalesce(by_name, F.when(name.endswith(".dockerfile"), "dockerfile"))
    shebang = F.coalesce(*[F.when(first.startswith("#!") & F.contains(first, F.lit(word)), F.lit(lang)) for word, lang in rules.SHEBANG_LANGUAGES])
    known = F.create_map(*functools.reduce(operator.iadd, ([F.lit(k), F.lit(v)] for k, v in rules.SUFFIX_LANGUAGES.items()), []))
    return F.coalesce(by_name, shebang, F.try_element_at(known, suffix(path)), F.lit("text"))
