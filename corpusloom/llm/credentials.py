"""Credentials that stand literally in source code and configuration.

Every string that stands where a credential could is scored first, by its characters per subword
under a public vocabulary: text that people write needs few subwords, random strings many. Then
context decides how unnatural it has to be: without a telling name, header, address, command line or
remark beside it no score is enough, beside a name also words with digits are, and only passphrases
of several words need no score at all. Stand-ins, masks, references, messages, hashes and public
keys are none. Redaction keeps every offset.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import VOCABULARY, encoder

#: Characters per subword up to which a string of at least UNNATURAL_LENGTH looks random; up to which it may be a word that
#: someone made up where a name says that a credential stands; and up to which it is random enough to be one as an argument.
UNNATURAL, UNNATURAL_LENGTH, MADE_UP, RANDOM = 2.6, 8, 3.8, 1.8


class Found(NamedTuple):
    """A credential: its kind and the places of its pieces, in order."""

    kind: str
    spans: tuple[tuple[int, int], ...]


# ------------------------------------------------------------ fixed word lists
#: What the names of credentials end in, without separators and in lower case.
_NAMES = (
    "password passwd pwd passphrase passcode passwort kennwort motdepasse contrasena contraseña wachtwoord dbpass userpass adminpass rootpass mailpass smtppass secret secretkey secrets token tokens apikey "
    "accesskey authkey masterkey signingkey privatekey encryptionkey sharedkey servicekey accountkey storagekey sshkey credential credentials creds pincode servicelogin sessionsalt passwordsalt authtoken bearer authorization"
).split()
_NAME_END = re.compile(r"(?:" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")\d*$")
_NAME_OTHER = re.compile(r"^(?:pub|public)(?:_|[A-Z])|^(?:no|is|has|need|needs|use|show|hide|num|max|min|len|count|total|reset|forgot|verify|validate|check)_", re.I)
_STANDIN = re.compile(
    r"""(?ix)^(?:
      [*x•.·#?_\-\s0]{3,} | (?:x{2,}[-_ ]?)+ | <[^<>]*> | \[[^\[\]]*\] | \.{3} | …
     |(?:please[-_ ]?)?(?:change|replace|fill|set|insert|enter|add|put|edit|update|provide)[-_ ]?(?:me|this|it|in|here|your|my|the|a|with|later)?(?:[-_ ].*)?
     |(?:your|my|the|some|any)[-_ ].* | .*[-_ ](?:here|goes[-_ ]here)
     |(?:dummy|example|sample|placeholder|fake|mock|redacted|removed|hidden|masked|censored|secret|password|passwd|token|todo|tbd|fixme|none|null|nil|undefined|unset|empty|default|string|str|text|value|n/?a|true|false|yes|no|test|testing|foo|bar|baz|foobar|qux|hunter2|abc123|123456\d*|qwerty)(?:[-_ ]?(?:password|passwd|secret|token|key|value|string|only|123|1))?
     |.*(?:placeholder|example[-_ ]?(?:key|token|secret|password)|not[-_ ]a[-_ ]real|not[-_ ]real|do[-_ ]not[-_ ]use|changeme|change[-_]me|replace[-_]me|redacted|dummy).*
    )$"""
)
_REFERENCE = re.compile(
    r"""(?ix)^(?:\$\{?.* | .*\$\{[^}]*\}.* | .*\{\{.*\}\}.* | %\(?\w+\)?[sd%]? | \{\w*\} | <%.* | \#\{.*
     |(?:vault|env|envvar|ssm|sm|kms|aws|gcp|azure|op|keyring|keychain|file|secret|secrets|secretsmanager|parameter|param|ref|config|conf|cfg|settings|k8s|doppler|infisical|pass|sops|encrypted|enc|cipher|arn)\s*[:(].*
     |(?-i:process\.env|os\.environ|env\.|std::env|System\.getenv|secrets?\.|settings\.|config\.|self\.|this\.|args\.|opts?\.|options\.|var\.|local\.|data\.)[\w.\["'(][\w.\[\]"'(),: -]* | !(?:Ref|Sub|GetAtt|vault|env)\b.*
     |(?:[./~]|[A-Za-z]:\\)[\w./\\\-~]*[/\\.][\w./\\\-~]*)$"""
)
_PUBLIC = re.compile(r"^(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-|sk-ssh-|-----BEGIN (?:[A-Z0-9 ]*PUBLIC KEY|CERTIFICATE)|sha(?:1|224|256|384|512)[-:]|md5[-:]|\$2[aby]\$|\$argon2|\$pbkdf2|\$[156]\$|pbkdf2_|bcrypt|age1)")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_MESSAGE = re.compile(r"(?i)\b(?:enter|missing|invalid|required|request|please|must|cannot|can't|failed|failure|error|expired|wrong|incorrect|unknown|not found|forgot|reset|your|the|is|are|was|with|for|in|of|to|from|and|or|a|an)\b")
_GLUE_WORDS = r"(?:concat!|String::from|Some|Ok|to_string|unwrap_or_else|unwrap_or|or_else|or|get|getenv|into|str|b|r|f|new|format!|bytes|SecretStr|Secret|encode)"

#: Formats by which issuers mark their keys (fixed patterns).
_ISSUED = re.compile(
    r"""(?<![A-Za-z0-9_/+.=-])(?:(?:AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[\w-]{20,}|gldt-[\w-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|SG\.[\w-]{16,}(?:\.[\w-]{16,})?
    |dop_v1_[A-Za-z0-9]{16,}|pypi-[\w-]{16,}|npm_[A-Za-z0-9]{30,}|AIza[\w-]{35}|ya29\.[\w-]{20,}|hf_[A-Za-z0-9]{30,}|shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{32}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,})(?![A-Za-z0-9/+=])""",
    re.X,
)
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ADDRESS = re.compile(r"://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]+)@(?=[\w\[$.{%-])")
_SHORT_FLAG = re.compile(r"""(?:--user(?:name)?|-u|--login)[= ]\S+\s+(?:-p|-w)\s?([^\s"'`\\-][^\s"'`\\]*)|(?<![\w-])(?:-u|--user)[= ]["']?[^\s"':]+:([^\s"'@]+)""")
_SCHEME = re.compile(r"^(?:Basic|Bearer|Token|Digest|ApiKey|Api-Key|Negotiate|JWT|OAuth|AWS)\s+(?=\S)", re.I)

#: A string literal; prefixes and long quotes of all languages.
_STRING = re.compile(r"""(?:[rbfuRBFU]{0,2})(\"\"\"|'''|"|'|`)((?:(?!\1)[^\\]|\\.)*?)\1|r(\#+)"([\s\S]*?)"\3""", re.S)
_JOIN = re.compile(r"\s*(?:\+|,|\\|\.\.|\|\|)?\s*(?:\\?\n\s*)?(?=[\"'`])")
#: Where a telling name ends, in text in lower case; only what _NAME_END accepts counts.
_ANCHOR = re.compile(r"(?:pass[_-]?(?:word|wd|phrase|code|wort)|passe|[a-z][_-]?pass|pwd|kennwort|contrase[nñ]a|wachtwoord|secrets?|(?:secret|api|access|auth|master|signing|private|encryption|shared|service|account|storage|ssh)[_-]?key|tokens?|credentials?|creds|pin[_-]?code|service[_-]?login|(?:session|password)[_-]?salt|bearer|authorization)\d*(?![a-z0-9_$])")
_ANCHOR_WORDS = ("pass", "pwd", "kennwort", "contrase", "wachtwoord", "secret", "key", "token", "cred", "code", "login", "salt", "bearer", "authorization")
_ISSUED_WORDS = ("AKIA", "ASIA", "AROA", "AIDA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "gldt-", "xox", "k_live_", "SG.", "dop_v1_", "pypi-", "npm_", "AIza", "ya29.", "hf_", "shp", "eyJ", "sk-")
_BEFORE = re.compile(r"(?:--?|\$)?[A-Za-z_$][\w$-]*\Z|\Z")
_TYPE = re.compile(r"\s*:\s*&?(?:'\w+\s+)?(?:str|String|string|Optional\[str\]|Option<[^>\n]*>|bytes|any)(?:\s*\|\s*\w+)?(?=\s*=)")
_GLUE = re.compile(rf"(?:\s|===?|!==?|=>|:=|=|:|,|\|\||\?\?|\)|\]|\(|\[|\.(?=[a-z])|&|\b{_GLUE_WORDS}){{1,40}}?(?=[rbfu]{{0,2}}[\"'`]|r\#+\")")
_BARE = re.compile(r"[ \t]*[=:][ \t]*([^\s\"'`|>&*\[{][^\n]*?)[ \t]*,?[ \t]*(?=\n|\Z)")
_BARE_BEFORE = re.compile(r"^[ \t+\-]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?[\"']?[\w.\-]*\Z")
_INLINE = re.compile(r"=([^\s\"'`&,;(){}<>=][^\s\"'`&,;(){}<>]*)")
_FLAG_VALUE = re.compile(r"""(?:=|[ \t]+)(["']?)([^\s"'`\\]+)\1""")
_COMMENT = re.compile(r"(?:^|\s)(?://|\#|/\*|\*|--|<!--|;)[ \t!]*(.*)")
_REMARK = re.compile(r"(?i)\b(?:log[ -]?in|sign[ -]?in|opens? (?:with|by)|unlock(?:s|ed)?|accessed with|works? with|passw(?:or)?d|passphrase|pass|pin|pwd|creds?|credentials?|secret|token|api key|kennwort|mot de passe|combination)\b")
_REMARK_WORDS = ("login", "log in", "log-in", "sign in", "sign-in", "open", "unlock", "access", "works with", "work with", "passw", "passphrase", "pass", "pin", "pwd", "cred", "secret", "token", "api key", "kennwort", "combination")
#: A string passed to what opens or signs something.
_CALL = re.compile(r"""(?i)(?:connect|log_?in|sign_?in|auth(?:enticate|orize)?|unlock|with_?(?:token|key|secret))\s*\((?:[^()"'`\n]*,\s*)?(["'`])([\w\-]{20,64})\1\s*[,)]""")
_CALL_WORDS = ("connect", "login", "log_in", "signin", "sign_in", "auth", "unlock", "withtoken", "with_token", "withkey", "with_key", "withsecret", "with_secret")
_LOOSE = re.compile(r"[^\s\"'`,;()<>\[\]{}]{7,}")


def squashed(name: str) -> str:
    """A name in lower case without separators."""
    return re.sub(r"[_\-$.]", "", name).lower()


@functools.lru_cache(maxsize=65_536)
def tells(name: str) -> bool:
    """Whether a name says that it holds a credential."""
    return bool(_NAME_END.search(squashed(name))) and not _NAME_OTHER.search(name)


def characters_per_subword(text: str, vocabulary: str = VOCABULARY) -> float:
    """How many characters a subword of the text has on average; natural text has about four."""
    return len(text) / max(1, encoder(vocabulary).length(text))


def unnatural(text: str, vocabulary: str = VOCABULARY, most: float = UNNATURAL) -> bool:
    return len(text) >= UNNATURAL_LENGTH and characters_per_subword(text, vocabulary) <= most


def usable(value: str, vocabulary: str = VOCABULARY, named: bool = True) -> bool:
    """Whether a value that stands where a credential would can be one."""
    v = value.strip()
    if len(v) < 5:
        return False
    words = v.split()
    if len(words) == 1 and characters_per_subword(v, vocabulary) > (MADE_UP if named else UNNATURAL):
        return False
    if _STANDIN.match(v) or _REFERENCE.match(v) or _PUBLIC.match(v):
        return False
    if re.fullmatch(r"[+-]?[\d_]+(?:\.\d+)?(?:ms|s|m|h|d|kb|mb)?", v) and len(v) < 12:
        return False
    if re.fullmatch(r"[A-Za-z_][\w.]*\(.*", v) or re.match(r"^[\w.]+\((?:.*\))?$", v):
        return False
    if len(set(v)) < 4 or "://" in v:
        return False
    if len(words) > 1:
        # a passphrase is a few words; sentences, prompts and messages are not
        return 3 <= len(words) <= 12 and not _MESSAGE.search(v) and all(re.fullmatch(r"[^\W_]+(?:-[^\W_]+)*", w) for w in words)
    if not named:
        return len(v) >= UNNATURAL_LENGTH and not _UUID.match(v) and not re.fullmatch(r"[0-9a-fA-F]+", v)
    if _UUID.match(v):
        return True
    letters, digits = any(map(str.isalpha, v)), any(map(str.isdigit, v))
    if letters and digits or re.search(r"[^\w\s]", v) and letters and re.search(r"[^\w\s.\-]|[A-Z]", v):
        return not re.fullmatch(r"[a-z][a-z0-9]*(?:[._-][a-z]+)+", v) or unnatural(v, vocabulary)
    return unnatural(v, vocabulary) or len(v) >= 16 and not re.search(r"[_.\-/ ]", v)


def credentials(content: str, language: str | None = None, vocabulary: str = VOCABULARY) -> list[Found]:
    """Every credential of a text in order of its place; overlapping finds count once."""
    found: list[Found] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, *spans: tuple[int, int]) -> None:
        if not any(a < e and s < b for a, b in spans for s, e in taken):
            found.append(Found(kind, spans))
            taken.extend(spans)

    if "PRIVATE KEY" in content:
        for m in _KEY_BLOCK.finditer(content):
            end = _KEY_END.search(content, m.end())
            last = end.end() if end else len(content)
            body = re.sub(r"\\n|[^A-Za-z0-9+/=]", "", content[m.end() : end.start() if end else last])
            if len(body) >= 24 and unnatural(body, vocabulary):
                add("private key", (m.start(), last))
    if "://" in content:
        for m in _ADDRESS.finditer(content):
            if _secret_part(m.group(1), vocabulary):
                add("address", m.span(1))
    if " -p" in content or "-u " in content or "-w " in content or "--user" in content:
        for m in _SHORT_FLAG.finditer(content):
            g = 1 if m.group(1) else 2
            if usable(m.group(g), vocabulary):
                add("command line", m.span(g))
    lower = content.lower()
    if len(lower) != len(content):  # some letters are longer in lower case
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in content)
    if any(w in lower for w in _ANCHOR_WORDS):
        for m in _ANCHOR.finditer(lower):
            _named(content, m.start(), m.end(), language, vocabulary, add)
    if any(w in content for w in _ISSUED_WORDS):
        for m in _ISSUED.finditer(content):
            if unnatural(m.group(), vocabulary) and not _STANDIN.match(m.group()) and not re.search(r"(?i)example|x{6}|0{8}|1234567", m.group()):
                add("issued key", m.span())
    if any(w in lower for w in _CALL_WORDS):
        for m in _CALL.finditer(content):
            v = m.group(2)
            if unnatural(v, vocabulary, RANDOM) and usable(v, vocabulary, named=False) and re.search(r"\d", v) and re.search(r"[a-z]", v) and re.search(r"[A-Z]", v):
                add("argument", m.span(2))
    if any(w in lower for w in _REMARK_WORDS):
        line_end = -1
        for m in _REMARK.finditer(content):
            if m.start() < line_end:
                continue
            start = content.rfind("\n", 0, m.start()) + 1
            line_end = content.find("\n", m.end())
            line_end = len(content) if line_end < 0 else line_end
            c = _COMMENT.match(content[start:line_end].lstrip()) or _COMMENT.search(content[start:line_end])
            if c is None or not _REMARK.search(c.group(1)):
                continue
            offset = line_end - len(c.group(1))
            for w in _LOOSE.finditer(content, offset, line_end):
                v = w.group().rstrip(".,:?")
                if re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and not re.search(r"[=/\\(_]|::|\.\w+$", v) and usable(v, vocabulary, named=False):
                    add("comment", (w.start(), w.start() + len(v)))
    return sorted(found, key=lambda f: f.spans[0])


def _named(content: str, start: int, end: int, language: str | None, vocabulary: str, add) -> None:
    """Looks beside one telling name for the value that it names."""
    low = max(0, start - 80)
    before = _BEFORE.search(content, low, start)
    begin = before.start() if before else start
    name = content[begin:end]
    if name.startswith("-") or content[begin - 1 : begin] == "-" and content[begin - 2 : begin - 1] in ("-", " ", "\"", "'"):
        m = _FLAG_VALUE.match(content, end)
        if m and not m.group(2).startswith("-") and usable(m.group(2), vocabulary):
            add("command line", m.span(2))
        return
    name = name.lstrip("$-")
    if not tells(name):
        return
    quote = content[begin - 1 : begin] if content[begin - 1 : begin] in ('"', "'", "`") and content[end : end + 1] == content[begin - 1 : begin] else ""
    at = end + len(quote)
    typed = _TYPE.match(content, at)
    glue = _GLUE.match(content, typed.end() if typed else at)
    if glue and glue.group().strip() and (not quote or glue.group().strip(" \t\r\n)\"'")[:1] in (":", ",", "=", "]", ".", "!", "|", "?")):
        spans = _pieces(content, glue.end())
        value = "".join(content[a:b] for a, b in spans)
        scheme = _SCHEME.match(value)
        if scheme and spans[0][1] - spans[0][0] > scheme.end():
            spans[0] = (spans[0][0] + scheme.end(), spans[0][1])
            value = value[scheme.end() :]
        elif squashed(name) == "authorization":
            return
        if spans and usable(value, vocabulary):
            first = content[spans[0][0] : spans[0][1]]
            spans[0] = (spans[0][0] + len(first) - len(first.lstrip()), spans[0][1])
            add("header" if scheme else "assignment", *spans)
        return
    if quote and content[at : at + 1] not in (":", " ", "="):
        return
    bare = _BARE.match(content, at)
    if bare and language not in ("python", "javascript", "typescript", "rust") and _BARE_BEFORE.match(content[content.rfind("\n", 0, begin) + 1 : begin]):
        if usable(bare.group(1), vocabulary):
            add("setting", bare.span(1))
        return
    inline = _INLINE.match(content, at)
    if inline and usable(inline.group(1), vocabulary) and unnatural(inline.group(1), vocabulary):
        add("assignment", inline.span(1))


def _secret_part(part: str, vocabulary: str) -> bool:
    return len(part) >= 3 and (len(part) < UNNATURAL_LENGTH or characters_per_subword(part, vocabulary) <= MADE_UP) and not _STANDIN.match(part) and not _REFERENCE.match(part) and not re.match(r"[$%{<]", part) and len(set(part)) > 2


def _pieces(content: str, at: int) -> list[tuple[int, int]]:
    """Places of the adjacent string literals from `at` on, without their quotes."""
    spans: list[tuple[int, int]] = []
    while True:
        m = _STRING.match(content, at)
        if m is None:
            return spans
        spans.append(m.span(2) if m.group(1) else m.span(4))
        at = m.end()
        join = re.compile(r"\s*\+\s*(?=[rbfu]{0,2}[\"'`])").match(content, at)
        if join is None and content[max(0, spans[0][0] - 9) : spans[0][0] - 1].endswith("concat!("):
            join = re.compile(r"\s*,\s*(?=[\"'])").match(content, at)
        if join is None and m.group(1) in ('"', "'"):
            join = re.compile(r"[ \t]*\\?(?:\n[ \t]*)?(?=[\"'])" if len(spans) > 1 else r"[ \t]+(?=[\"'])").match(content, at)
        if join is None:
            return spans
        at = join.end()


def redact(content: str, found: list[Found], placeholder: str = "REDACTED") -> str:
    """The text with every credential replaced; each character outside keeps its place.

    A replacement is as long as what it replaces: the placeholder, cut or filled up with `x`, with
    line breaks (also escaped ones) and the indentation behind them where they were.
    """
    out, pos = [], 0
    for start, end in sorted(s for f in found for s in f.spans):
        out.append(content[pos:start])
        fill = iter(placeholder)
        out.append("".join(p if p[0] in "\r\n" or p == "\\n" else next(fill, "x") for p in re.findall(r"\\n|[\r\n]+[ \t]*|[\s\S]", content[start:end])))
        pos = end
    out.append(content[pos:])
    return "".join(out)


def find(symbols: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(chunk_id, start_at, kind, pieces) of each credential in `content` of (chunk_id, language, content).

    Null and empty contents, and rows without chunk_id, give nothing. Exact repeats stay repeated.
    """
    source = symbols.where("chunk_id is not null and content <> ''").select("chunk_id", "language", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, f.spans[0][0], f.kind, len(f.spans)) for i, lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in credentials(t, lang, vocabulary)]
            ids, at, kinds, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(at, pa.int64()), pa.array(kinds, pa.string()), pa.array(n, pa.int32())], names=["chunk_id", "start_at", "kind", "pieces"])

    return source.mapInArrow(run, "chunk_id string, start_at long, kind string, pieces int")


def redacted(symbols: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(chunk_id, content, credentials) of every row: its content redacted, and how many were found.

    Null contents stay null with 0; rows without chunk_id are kept.
    """
    source = symbols.select("chunk_id", "language", F.col("content").alias("__content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [credentials(t, lang, vocabulary) if t else [] for lang, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            texts = pa.array([redact(t, f) if f else t for t, f in zip(batch.column(2).to_pylist(), found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(list(map(len, found)), pa.int32())], names=["chunk_id", "content", "credentials"])

    return source.mapInArrow(run, "chunk_id string, content string, credentials int")
