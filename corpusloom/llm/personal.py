"""Personal information inside free text.

Regular expressions propose spans; checksums (mod 97, mod 23, ISO 7064, Luhn) confirm what has
one; words nearby raise or lower the score; what reaches the threshold is found. Redaction puts
typed placeholders in place of the spans and leaves the rest as it is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import encoder


class Item(NamedTuple):
    start: int
    end: int
    kind: str


# ------------------------------------------------------------ email
#: First words of addresses that belong to a role, a list or a machine (fixed).
_ROLES = frozenset(
    "abuse accounts admin administrator alerts alert all announce announcements api backup billing bot bounce bounces build builds buildbot careers ci community contact contacto contributors cron daemon deploy deployer dev devel developer developers devs devops do-not-reply donotreply "
    "engineering enquiries events feedback ftp gerrit git github gitlab hello help helpdesk hi host hostmaster hr http info infra infrastructure it jenkins jira jobs kontakt legal list lists mail mailer mailer-daemon mailing maintainers maintainer majordomo marketing "
    "me monitor monitoring moderator moderators news newsletter no-reply nobody noc noreply notifications notification notify office oncall on-call ops orders owner packages paypal platform postmaster press privacy qa registry release releases reply report reports robot root runner sales "
    "security server service services ssh staff status subscribe support svc svn sysadmin system systemd team tech test tests tracker unsubscribe uploads user username users web webmaster webteam wiki worker workers www www-data you your-name yourname someone somebody anyone example name foo bar".split()
)
_WRAPPED_AT = re.compile(r"\s?[(\[{<]\s?(?:at|AT|ät|arroba)\s?[)\]}>]\s?")
_SPOKEN_AT = re.compile(r"\s(?:at|AT|arroba|chez)\s(?=[\w-]+\s(?:dot|DOT|punkt|point|punto)\s)")
_WRAPPED_WORDS = ("(at", "[at", "{at", "<at", "( at", "[ at", "{ at", "(AT", "[AT", "{AT", "(ät", "[ät", "arroba")
_SPOKEN_WORDS = (" dot ", " DOT ", " punkt ", " point ", " punto ")
_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:(?:\.|\s?[(\[{]\s?(?:dot|DOT|punkt)\s?[)\]}]\s?|\s(?:dot|DOT|punkt|point|punto)\s)[^\W_](?:[\w-]*[^\W_])?)+")
_LOCAL = re.compile(r"[^\W_][\w.+’'\-]*\Z")


_SPOKEN_LOCAL = re.compile(r"[\w+-]+(?:\s(?:dot|DOT|punkt|point|punto)\s|\s?[(\[{]\s?(?:dot|DOT|punkt)\s?[)\]}]\s?)\Z")


def _ats(text: str) -> Iterator[tuple[int, int]]:
    """Places of the signs and words that stand between the parts of an address."""
    for sign in ("@", "＠"):
        at = text.find(sign)
        while at >= 0:
            yield at, at + 1
            at = text.find(sign, at + 1)
    if any(w in text for w in _WRAPPED_WORDS):
        for m in _WRAPPED_AT.finditer(text):
            yield m.span()
    if any(w in text for w in _SPOKEN_WORDS):
        for m in _SPOKEN_AT.finditer(text):
            yield m.span()


def _emails(text: str, seen: Seen) -> Iterator[Item]:
    for at_start, at_end in _ats(text):
        low = max(0, at_start - 70)
        local = _LOCAL.search(text[low:at_start])
        domain = _DOMAIN.match(text, at_end)
        if local is None or domain is None:
            continue
        start, name = low + local.start(), local.group()
        while more := _SPOKEN_LOCAL.search(text[max(0, start - 40) : start]):
            start -= more.end() - more.start()
            name = text[start:at_start]
        top = re.split(r"[\W_]+", domain.group().rstrip())[-1]
        if not re.fullmatch(r"[^\W\d_]{2,}", top) or text[max(0, start - 3) : start] == "://":
            continue
        if text[domain.end() : domain.end() + 1] in (":", "/") and re.match(r":[\w~./-]|/", text[domain.end() : domain.end() + 3]):
            continue  # a remote
        plain = re.sub(r"\+.*|\d+$", "", name.lower()).strip(".-_")
        if plain in _ROLES or re.split(r"[._-]", plain)[0] in _ROLES or re.split(r"[._-]", plain)[-1] in ("list", "bot", "team", "ci", "daemon", "noreply", "reply", "admins", "dev", "announce", "users") or re.fullmatch(r"[0-9a-f-]{16,}", name):
            continue
        yield Item(start, domain.end(), "email")


# ------------------------------------------------------------ numbers
_NUMBER = re.compile(r"\d[\d ()./\- ‑]{5,}\d(?![\w@])")
_EXTENSION = re.compile(r"\s?(?:ext\.?|x|Durchwahl|poste)\s?\d{1,5}\b")
_ID_WORDS = ("passport", "passeport", "pasaporte", "reisepass", "insurance", "nino", "tax id", "tax n", "ssn", "social security", "dni", "nie", "nif", "steuer", "identifikationsnummer", "ausweis", "curité sociale", "curite sociale", "identité", "identite", "fiscal", "seguridad social", "payroll", "national id", "identity", "id card", "id n", "personnummer", "cpr", "旅券", "番号")
_LETTERED = re.compile(r"\d{7}[- ]?[A-Z]\b")
_PHONE_CUE = re.compile(r"(?i)\b(?:call|phone|tel|t[eé]l[eé]fono|telefon(?:isch)?|t[eé]l[eé]phone|t[eé]l|text|number is|my number|mobile|cell|handy|fax|whatsapp|signal me|reach|erreichbar|joignable|appel(?:er|ez)|llama[rd]?|móvil|escalation|dial|ring|contact|anrufen|rufen?|pager)\b|電話|携帯|☎|📞")
_NO_PHONE = re.compile(r"(?i)\b(?:build|order|ticket|timestamp|amount|version|isbn(?:-like)?|issn|hash|uuid|row|line|port|bytes|commit|id|issue|pr|epoch|sku|invoice|serial|part)(?: key| no\.?| number)?[ #:]*\Z")
_PHONE_FORMS = re.compile(
    r"""(?:\+\d{1,3}[ .\-]?(?:\(0\)[ .\-]?)?\(?\d[\d ().\- ]{5,15}\d
    |00\d{1,3}[ \-.]\d[\d \-.]{5,14}\d
    |\(\d{3,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}
    |[2-9]\d{2}([.\-])[2-9]\d{2}\1\d{4}
    |0\d(?:[ .]\d\d){4}|0\d{4}[ ]\d{6}|0\d{2,4}[ /\-]\d{3,8}(?:[ \-]\d{2,4}){0,2}|04\d\d[ ]\d{3}[ ]\d{3})
    (?:[ ]?(?:ext\.?|x|Durchwahl|poste)[ ]?\d{1,5})?""",
    re.X,
)
_ID_CUE = re.compile(
    r"(?i)passport|passeport|pasaporte|reisepass|national insurance|\bnino?\b|insurance number|tax (?:id|number|no)|\btin\b|\bssn\b|social security|\bdni\b|\bnie\b|\bnif\b|steuer-?id|steuernummer|identifikationsnummer|personalausweis|ausweis|s[eé]curit[eé] sociale|carte d.identit[eé]|num[eé]ro fiscal|seguridad social|payroll lists|national id|identity (?:card|number|no)|\bid (?:card|number|no)\b|personnummer|\bcpr\b|codice fiscale|旅券|番号|マイナンバー"
)
_ID_FORMS = re.compile(
    r"""(?<![\w.@/#-])(?:(?P<nie>[XYZ][- ]?\d{7}[- ]?[A-Z])|(?P<dni>\d{8}[- ]?[A-Z])|(?P<nino>[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D])|(?P<nir>[12][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{2})|(?P<ssn>\d{3}[- ]\d{2}[- ]\d{4})
    |(?P<tin>\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3})|(?P<cpr>\d{6}[-+]\d{4})|(?P<pass>[A-Z]{1,2}(?=[A-Z0-9]*\d{4})[A-Z0-9]{6,8})|(?P<other>\d{9}))(?![\w@-])""",
    re.X,
)


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def confirmed(kind: str, number: str) -> bool:
    """Whether a number passes the check that its kind has; False where it has none."""
    bare = re.sub(r"[ \-+]", "", number)
    if kind in ("dni", "nie"):
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(bare[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == bare[-1]
    if kind == "nir":
        return (97 - int(bare[:13]) % 97) == int(bare[13:])
    if kind == "tin":
        p = 10
        for d in bare[:-1]:
            s = (int(d) + p) % 10 or 10
            p = s * 2 % 11
        return (11 - p) % 10 == int(bare[-1])
    if kind == "cpr":
        return luhn(bare)
    return False


def _numbers(text: str, seen: Seen) -> Iterator[Item]:
    ids: list[tuple[int, int]] = []
    if "id" in seen or _LETTERED.search(text):
        for m in _ID_FORMS.finditer(text):
            kind = m.lastgroup
            before = text[max(0, m.start() - 48) : m.start()].rpartition("\n")[2]
            before = re.split(r"(?<=[.!?。]) (?=[A-ZÀ-Ý])(?<!no\. )(?<!nr\. )(?<!No\. )", before)[-1]
            score = 0.6 * bool(_ID_CUE.search(before)) + 0.4 * (kind not in ("other", "pass", "tin")) + 0.3 * confirmed(kind, m.group()) + 0.25 * (kind in ("pass", "tin")) - 0.6 * bool(_NO_PHONE.search(before) and not _ID_CUE.search(before[-24:]))
            if not _ID_CUE.search(before):
                score += 0.6 * bool(re.match(r"[^.\n]{0,12}(?:is|was|ist|est|es) (?:my|his|her|their|a|the) (?:passport|tax id|ssn|national)", text[m.end() : m.end() + 40]))
                score -= 0.3 * (kind not in ("nie", "dni", "nir"))
            if score >= 0.65:
                ids.append(m.span())
                yield Item(*m.span(), "id_number")
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        digits = sum(map(str.isdigit, m.group()))
        if text[start - 1 : start] in ("+", "(") and start:
            start -= 2 if text[start - 2 : start] == "(+" else 1
        elif start and re.match(r"[\w.,:/#@-]", text[start - 1]):
            continue
        if digits < 7 or any(x < end and start < y for x, y in ids):
            continue
        extension = _EXTENSION.match(text, end)
        end = extension.end() if extension else end
        s = text[start:end]
        line = text[max(0, start - 70) : start].rpartition("\n")[2]
        before = re.split(r"(?<=[.!?。]) (?=[A-ZÀ-Ý])", line)[-1]
        if _NO_PHONE.search(before[-24:]):
            continue
        form = _PHONE_FORMS.match(text, start)
        cue = bool(_PHONE_CUE.search(before)) or len(before) < len(line) and bool(re.search(r"(?i)\bescalation\b", line))
        intl = s.startswith(("+", "("))
        score = 0.6 * bool(form) + 0.5 * cue + 0.3 * intl
        if not form and re.fullmatch(r"[2-9]\d{9}|0\d{8,10}", re.split(r"\s?[a-zA-Z]", s)[0]):
            score += 0.3
        if re.match(r"\d{4}-\d\d-\d\d|\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|97[89]-", s) or not cue and form and not intl and re.search(r"[\d.]\Z", before):
            score -= 0.8
        if not cue and form and not intl and re.match(r"0\d{2,4}[ /\-]\d{3,8}\Z", s):
            score -= 0.2
        if score >= 0.6:
            yield Item(start, start + len(_one_number(text[start : form.end() if form else end])), "phone")


def _one_number(found: str) -> str:
    """A number without a sentence end or a following one that it ran into; none has over 15 digits."""
    found = re.split(r"(?<!ext)\.\s", found)[0]
    while " " in found and sum(map(str.isdigit, re.split(r"[a-zA-Z]", found)[0])) > 15:
        found = found.rpartition(" ")[0]
    return found


# ------------------------------------------------------------ addresses
_CAP = r"[A-ZÀ-ÖØ-ÝŁŞ][\w’'\-]*"
_UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor)\s\w{1,5},?\s)?"
_STREET = r"(?:Road|Rd|Street|St|Avenue|Ave|Boulevard|Blvd|Row|Lane|Ln|Drive|Dr|Court|Ct|Close|Place|Pl|Way|Terrace|Crescent|Square|Gardens|Walk|Hill|Parade|Mews|Alley|Circle|Highway|Parkway)"
_EN_TYPE = re.compile(rf" {_STREET}\b\.?")
_EN_BEFORE = re.compile(rf"(?<![\w/]){_UNIT}\d{{1,5}}[A-Za-z]?,?\s(?:[NSEW]\.?\s)?(?:(?:Old|New|North|South|East|West|Upper|Lower|Great|Little|St\.)\s)?{_CAP}(?:\s{_CAP}){{0,2}}\Z")
_BOXES = re.compile(r"(?<![\w/])(?:P\.?\s?O\.?\s?Box|Post\s?Box|Postfach|Apartado(?:\sde\sCorreos)?|Bo[iî]te\spostale|Casilla|B\.P\.)\s\d+")
_DE = re.compile(
    rf"(?<![\w/])(?:(?:Am|An\sder|An\sden|Im|Zum|Zur|Auf\sder|Unter\sden|In\sder)\s)?{_CAP}(?:str\.|stra(?:ß|ss)e|weg|platz|gasse|allee|ring|damm|ufer|steig|hof|(?<=-)(?:Allee|Stra(?:ß|ss)e|Str\.|Platz|Weg|Ring)|\s(?:Stra(?:ß|ss)e|Allee|Platz|Weg))\s\d{{1,4}}(?:\s?[a-z]\b)?(?:\s?/\s?\d+)?\b"
)
_DE_WORDS = ("str.", "straße", "strasse", "weg ", "platz ", "gasse ", "llee ", "ring ", "damm ", "ufer ", "steig ", "hof ", "Straße", "Weg ", "Platz ", "Str.", "Ring ")
_FR = re.compile(rf"(?<![\w/])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|cours|square|route(?=\sd[eu’']))\s(?:(?:de\sla|de\sl[’']|des|du|de|d[’'])\s?)?(?!Lane|Street){_CAP}")
_FR_WORDS = ("rue ", "avenue ", "av. ", "boulevard ", "bd ", "place ", "chemin ", "impasse ", "allée ", "quai ", "cours ", "square ", "route d")
_ES = re.compile(rf"(?<![\w/])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carrera|Ronda|Travesía)\s?(?:(?:de\sla|de\slos|del|de)\s)?{_CAP}(?:\s{_CAP})?,?\s(?:n\.?[ºo]\s?)?\d{{1,4}}")
_ES_WORDS = ("Calle", "C/", "Avenida", "Avda", "Av.", "Plaza", "Paseo", "Camino", "Carrera", "Ronda", "Travesía")
_BOX_WORDS = ("Box ", "Postfach", "Apartado", "postale", "Casilla", "B.P.")
_CUED_PLACES = ("lives at", "address", "deliver_to", "hip", "nschrift", "omicil", "dresse", "wohnt", "habite", "vive en", "送付先", "住所")
_TAIL = re.compile(rf"(?:,\s(?:(?:Apt|Flat|Unit|Suite)\.?\s\w{{1,5}}|\d+\.?[ºª](?:\s[A-Z]\b)?|\d{{4,5}}(?:\s{_CAP})?|{_CAP}(?:\s\d{{4,5}})?)(?![\w@])){{0,4}}")
_PLACE_CUE = re.compile(r"""(?i)(?:lives at|home address:|address since \w+:|deliver_to:|ship(?:ping)?(?: address)?:|anschrift:|domicilio:|adresse\s?:|wohnt (?:in|am)|habite(?:\sau)?|vive en|送付先[:：]|住所[:：])\s*["']?(?=\S)""")


def _addresses(text: str, seen: Seen) -> Iterator[Item]:
    spans: list[tuple[int, int]] = []
    for at, _ in seen.get("street", ()):
        m = _EN_TYPE.match(text, at)
        if m:
            low = max(0, at - 60)
            before = _EN_BEFORE.search(text[low:at])
            if before:
                spans.append((low + before.start(), m.end()))
    for kind, places in (("box", _BOXES), ("de", _DE), ("fr", _FR), ("es", _ES)):
        for at, _ in seen.get(kind, ()):
            spans += [m.span() for m in places.finditer(text, max(0, at - 45), at + 60)]
    end = -1
    for start, stop in sorted(spans):
        if start >= end:
            # the parts of one address follow each other by commas
            end = max(stop, _TAIL.match(text, stop).end())
            yield Item(start, end, "address")
    if "place" in seen:
        for c in _PLACE_CUE.finditer(text):
            rest = text[c.end() : c.end() + 60].split("\n")[0]
            m = re.match(r"(?:[\w.’'/º-]+[ ,]{1,2}){0,6}", rest)
            if re.match(r"[\dA-ZÀ-Ý]", rest) and re.search(r"\d", rest[:40]) and m and not any(c.end() - 2 <= a < c.end() + 60 for a, _ in spans):
                yield Item(c.end(), c.end() + len(m.group().rstrip(" ,")), "address")


# ------------------------------------------------------------ persons
_LETTER = r"[^\W\d_]"
_NAME_WORD = rf"(?:{_LETTER}\.|{_LETTER}[\w’'`]*(?:[-‐‑]{_LETTER}[\w’'`]*)*)"
_NAME = rf"(?P<name>{_NAME_WORD}(?:(?:,?[  ]){_NAME_WORD}){{0,4}}?)"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herrn?|Frau|Mme|Mlle|Sr|Sra|Srta|Don|Doña|Señora?|Sir|Madam)\.?[ ])*"
_STOP = r"[.;!]|,|\n|$"


def _cue(after: str, lead: str = r"\s") -> re.Pattern:
    return re.compile(rf"{lead}{_TITLE}{_NAME}(?=(?:{after}))")


_TO = _cue(rf"\s(?:for|who|and|until|by|since|on|if)\b|{_STOP}")
_BY = _cue(rf"\s(?:on|and|in|at)\b|\s*[<(]|{_STOP}")
_MAIL = _cue(rf"\s*[<(]|\n|$|{_STOP}", r"\s*")
_ASK = _cue(rf"\s(?:about|to|for|if|whether|when|and|from|of|on|zu|wegen|ob|und|von|pour|de|si|et|por|para|sobre|y)\b|\s*[<(]|\n|$|{_STOP}")
_GREET = _cue(r"\s?[,!:—–]|\s-")
_CLOSE = re.compile(rf"(?P<comma>,)?!?\s+(?P<name>{_NAME_WORD}(?:[ ]{_NAME_WORD}){{0,3}}?)(?=(?P<end>[.!]?[ \t]*(?:\n|$))|\s|[.!,;]|$)")
#: What stands before a name, by how the name goes on (fixed words).
_CUES: list[tuple[str, str, re.Pattern]] = [
    *(("to", w, _TO) for w in ("hanks to", "hank you", "udos to", "redits to", "redit to", "ssigned to", "anded over to")),
    *(("by", w, _BY) for w in ("eviewed by", "pproved by", "eported by", "ritten by", "ixed by", "ound by", "potted by", "ignalé par", "elu par", "alidé par", "apporté par", "Écrit par", "evisado por", "scrito por", "eportado por", "Avisó", "avisó")),
    *(("with", w, _cue(rf"\s(?:on|about|to|for)\b|{_STOP}")) for w in ("aired with", "poke with", "alked with", "Met with")),
    *(("ask", w, _ASK) for w in ("y name is", "lease ask", "lease contact", "lease email", "ein Name ist", "ch heiße", "itte fragen Sie", "itte frag", "e m'appelle", "e m’appelle", "emandez à", "e llamo", "i nombre es", "regunta a", "regunte a")),
    *(("as", w, _cue(r"\s(?:said|noted|wrote|mentioned|explained|put\sit|pointed\sout)\b")) for w in ("As", "as")),
    ("escalation", "scalation", re.compile(rf"\s(?:for\s\w+)?:?\s?{_TITLE}{_NAME}(?=,?\s[+(\d])")),
    *(("mail", w, _MAIL) for w in ("Signed-off-by:", "Co-authored-by:", "Reported-by:", "Reviewed-by:", "Acked-by:", "Tested-by:", "Suggested-by:", "Helped-by:", "Author:", "From:")),
    *(("to", w, _cue(rf"\s(?:für|und)\b|{_STOP}")) for w in ("anke an", "ank geht an", "ank an", "uständig ist", "uständig sind")),
    ("mail", "ückfragen ", re.compile(rf"(?:zum|zur|zu)\s\w+\san\s{_TITLE}{_NAME}(?=\s*[(<]|{_STOP})")),
    *(("to", w, _cue(rf"\s(?:pour|et|de)\b|{_STOP}")) for w in ("erci à", "erci a")),
    ("to", "racias a", _cue(rf"\s(?:por|y)\b|{_STOP}")),
    *(("to", w, _cue(r"\s?(?:さん|様|氏|殿)", r"\s?")) for w in ("担当は", "担当者は", "担当:", "担当：")),
    *(("greet", w, _GREET) for w in ("Hi", "Hello", "Hey", "Dear", "Hallo", "Liebe", "Lieber", "Moin", "Servus", "Bonjour", "Salut", "Cher", "Chère", "Hola", "Querido", "Querida", "Estimado", "Estimada", "Ciao")),
    *(("close", w, _CLOSE) for w in ("heers", "egards", "Best", "hanks", "incerely", "Yours", "Grüße", "Gruß", "VG", "LG", "MfG", "ordialement", "ien à toi", "ien à vous", "mitiés", "aludos", "n saludo", "brazos")),
    *(("sign", w, re.compile(rf"[ ](?P<name>{_NAME_WORD}(?:,?[ ]{_NAME_WORD}){{0,3}})(?=\s*(?:\n|$)|\s+\S)")) for w in ("--", "—", "–")),
]
_LIVES = (" lives at", " lives in", " wohnt in", " wohnt am", " wohnt an", " habite à", " habite au", " vive en", "さんで", "さんが", "さんに", "さんを", "さんは", "さんの", "さん、", "様の", "様へ")
_REST_OF_NAME = re.compile(r",[  ][A-ZÀ-ÝŁØÅŞ][\w’'-]*(?:[ ][A-Z]\.)?(?=\s(?:for|pour|por|für|until|on|said|noted|wrote|und|et|y)\b|\s*[<(]|,\s(?:who|[+(\d])|[.;!]|\s?さん|\n|$)")
#: Words that stand where a name could, but are none (fixed).
_NO_NAMES = frozenset(
    "the a an all team everyone everybody folks there world both guys maintainers reviewers you your our my his her their its this that these those it we they he she i who what which one some any each every no none nobody someone anyone "
    "and or but for with from until since before after by at in on of to as is are was were be been will would should can could may might must not only just also still again then than so if when while because "
    "zusammen team leute alle kollegen der die das den dem ein eine einen à tous toutes le la les un une des du equipo todos a todas los las el al mundo monde welt".split()
)


def _persons(text: str, seen: Seen) -> Iterator[Item]:
    for at, cue in seen.get("cue", ()):
        how, word, rest = _CUES[cue]
        # words in lower case here may lack their first letter, so that both cases are found
        if at == 0 or not text[at - 1].isalnum() or word[0].islower() and (at == 1 or not text[at - 2].isalnum()) or word[0] == "担":
            m = rest.match(text, at + len(word))
            if m is None:
                continue
            if how in ("close", "sign"):
                yield from _signed(text, how, word, m)
            elif _sound(how, m["name"]):
                yield _whole(text, *m.span("name"))
    for at, _ in seen.get("lives", ()):
        yield from _before(text, at)


def _signed(text: str, how: str, word: str, m: re.Match) -> Iterator[Item]:
    """A name that closes a text or a line; one that runs on into a sentence is cut to what is sure."""
    start = m.start("name")
    line = text[start : start + 60].partition("\n")[0]
    alone = re.fullmatch(rf"({_NAME_WORD}(?:,?[ ]{_NAME_WORD}){{0,3}})[.!]?[ \t]*", line)
    if alone:
        name = alone.group(1)
    elif how == "close":
        if not m["comma"] or word in ("hanks", "Best", "Yours"):
            return
        name = m["name"]
    else:
        kind = r"[A-ZÀ-ÝŁØÅŞ](?:[\w’'-]+|\.)" if line[:1].isupper() else r"[a-zß-ÿłøåşćśźžč][\w’'-]+"
        run = re.match(rf"{kind}(?:,?[ ]{kind}(?![\w.])){{0,2}}", line)
        if run is None:
            return
        words = run.group().split(" ")
        name = " ".join(words[: 3 if len(words) > 1 and words[1].endswith(".") else 2])
    if _sound(how, name):
        yield Item(start, start + len(name.rstrip(",")), "person")


def _whole(text: str, start: int, end: int) -> Item:
    """A name with its given name, where that follows the surname and a comma."""
    more = _REST_OF_NAME.match(text, end) if " " not in text[start:end] else None
    return Item(start, more.end() if more else end, "person")


def _sound(how: str, name: str) -> bool:
    """Whether what stands behind a cue can be a name."""
    words = re.findall(r"[^\s,]+", name)
    if not words or words[0].lower() in _NO_NAMES or any(w.lower() in _NO_NAMES for w in words) and how not in ("sign", "close"):
        return False
    upper = [w for w in words if w[:1].isupper()]
    if how == "greet":
        return len(upper) == len(words) <= 4
    if how == "close":
        return words[0][:1].isupper() and len(words[0]) > 1
    if how == "ask":
        return len(upper) == len(words) > 1
    if not upper:
        return 2 <= len(words) <= 4 and _uncommon(words)
    if not words[0][:1].isupper():
        return False
    if how == "sign":
        return len(words[0]) > 2 or words[0].endswith(".")
    return len(upper) == len(words) and any(len(w.strip(".")) > 1 for w in words)


def _before(text: str, at: int) -> Iterator[Item]:
    """The name that ends at `at`: the last words that can belong to one."""
    low = max(0, at - 60)
    words = list(re.finditer(r"[^\s、。]+", text[low:at].rpartition("\n")[2]))
    shift = at - len(text[low:at].rpartition("\n")[2])
    keep = len(words)
    for k in range(len(words) - 1, max(-1, len(words) - 5), -1):
        w = words[k].group()
        bare = w.rstrip(",")
        name_like = re.fullmatch(_NAME_WORD, bare) and bare.lower() not in _NO_NAMES
        if not name_like or k < len(words) - 1 and w.endswith(",") and k != len(words) - 2 and not words[-2].group().endswith("."):
            break
        if keep < len(words) and bare[:1].isupper() != words[-1].group()[:1].isupper():
            break
        if len(words) - k > 2 and not re.fullmatch(r"[^\W\d_]\.|[^\W\d_]{1,3}", words[k + 1].group()) :
            break
        keep = k
    if keep < len(words):
        name = [w.group().strip(",") for w in words[keep:]]
        if any(w[:1].isupper() for w in name) and len(name[-1].strip(".")) > 1 or len(name) >= 2 and _uncommon(name):
            yield Item(shift + words[keep].start(), at, "person")


def _uncommon(words: list[str]) -> bool:
    """Whether some word is no whole subword of the vocabulary, as names in lower case rarely are."""
    length = encoder().length
    return any(length(" " + w) > 1 for w in words)


#: Of each kind of cue: where it stands in the text, and its number.
Seen = dict[str, list[tuple[int, int]]]


@functools.cache
def _cues() -> ahocorasick.Automaton:
    """All cue words in one automaton, so that a text is read once for them."""
    words: dict[str, list[tuple[str, int]]] = {}
    streets = _STREET.removeprefix("(?:").removesuffix(")").split("|")
    kinds = {"street": [f" {w}" for w in streets], "box": _BOX_WORDS, "de": _DE_WORDS, "fr": _FR_WORDS, "es": _ES_WORDS, "place": _CUED_PLACES, "lives": _LIVES, "cue": [w for _, w, _ in _CUES]}
    kinds["id"] = sorted({v for w in _ID_WORDS for v in (w, w.upper(), w.capitalize(), w.title())})
    for kind, those in kinds.items():
        for number, word in enumerate(those):
            words.setdefault(word, []).append((kind, number))
    found = ahocorasick.Automaton()
    for word, what in words.items():
        found.add_word(word, (len(word), what))
    found.make_automaton()
    return found


def personal(text: str) -> list[Item]:
    """Every personal item of a text in order; where two overlap, the earlier kind in the list
    email, id_number, phone, address, person holds."""
    seen: Seen = {}
    for last, (length, what) in _cues().iter(text):
        for kind, number in what:
            seen.setdefault(kind, []).append((last + 1 - length, number))
    found: list[Item] = []
    for propose in (_emails, _numbers, _addresses, _persons):
        for item in propose(text, seen):
            if not any(item.start < x.end and x.start < item.end for x in found):
                found.append(item)
    return sorted(found)


def redact(text: str, items: list[Item]) -> str:
    """The text with `[EMAIL]`, `[PHONE]`, `[ID_NUMBER]`, `[ADDRESS]` or `[PERSON]` for each item."""
    out, pos = [], 0
    for x in items:
        out += (text[pos : x.start], f"[{x.kind.upper()}]")
        pos = x.end
    return "".join([*out, text[pos:]])


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, start_at, kind) of each item in `text` of (doc_id, text).

    Null and empty texts give nothing; repeated rows stay repeated.
    """
    source = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, x.start, x.kind) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in personal(t)]
            ids, at, kinds = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "start_at", "kind"])

    return source.mapInArrow(run, "doc_id long, start_at long, kind string")


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text, items) of every row: the text with placeholders, and how many there are.

    Null texts stay null with 0 items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [personal(t) if t else [] for t in texts]
            out = pa.array([redact(t, x) if x else t for t, x in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out, pa.array(list(map(len, found)), pa.int32())], names=["doc_id", "text", "items"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text")).mapInArrow(run, "doc_id long, text string, items int")
