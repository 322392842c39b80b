"""Source files that do not parse: a lexer per language and a pushdown stack.

Each language has a lexer that finds unterminated literals and characters that no token begins
with. Its tokens drive a stack of open brackets, blocks and templates. On top of that a state
says whether an operand or an operator may come next, so that prose, another language, diff and
merge-conflict lines, placeholders and premature ends are found where they break that order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Problem(NamedTuple):
    """What is wrong first, and at which character."""

    kind: str
    at: int


class _Stop(Exception):
    def __init__(self, kind: str, at: int):
        self.problem = Problem(kind, at)


# ---------------------------------------------------------------- states
START, OPERAND, OP, END = 0, 1, 2, 3
#: START: a statement may begin. OPERAND: a value has ended. OP: a value must follow. END: anything may follow.
_CLOSES = {")": "(", "]": "[", "}": "{"}
CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$", re.M)


class _Context:
    """One open bracket."""

    __slots__ = ("at", "case", "header", "kind", "open", "ternaries")

    def __init__(self, open_: str, kind: str, at: int):
        self.open, self.kind, self.at = open_, kind, at
        self.ternaries, self.case, self.header = 0, False, False


# ---------------------------------------------------------------- JavaScript and TypeScript
_JS_TOKEN = re.compile(
    r"""(?P<s>[ \t\r\n\v\f\xa0\ufeff\u2028\u2029\u1680\u2000-\u200a\u202f\u205f\u3000]+)
    |(?P<c>//[^\n\r\u2028\u2029]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)
    |(?P<w>(?:[A-Za-z_$\u00aa-\uffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\}|[\U00010000-\U0010ffff])(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<n>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)
    |(?P<q>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#`])""",
    re.X,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JS_BINARY = frozenset("= == === != !== < > <= >= + - * / % ** & | ^ << >> >>> && || ?? += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_JS_PREFIX = frozenset("+ - ! ~ ++ -- ...".split())
_JS_VALUES = frozenset("this super true false null".split())
_JS_UNARY = frozenset("typeof void delete await new".split())
_JS_LOOSE = frozenset("return throw yield break continue debugger".split())
_JS_PAREN = frozenset("if while switch for with".split())
_JS_RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum await yield".split())
_JS_MODIFIERS = frozenset("async get set static of let".split())
_TS_MODIFIERS = frozenset("async get set static of let type declare abstract readonly public private protected namespace module keyof infer asserts unique override accessor interface is as satisfies global out in".split())
_TS_INFIX = frozenset("as is satisfies implements extends".split())
_TS_HEADS = frozenset("interface enum namespace module".split())


def _scripts(text: str, typed: bool) -> None:
    """Raises at the first place where a module in JavaScript, or TypeScript if typed, breaks off."""
    pos, end = 0, len(text)
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else end
    top = _Context("", "top", 0)
    stack = [top]
    state, last, before, newline = START, "", "", False
    modifiers = _TS_MODIFIERS if typed else _JS_MODIFIERS
    must: tuple[str, ...] | None = None  # what has to follow, after try blocks, parameters and the like
    pending = ""  # class or type header that its brace ends
    after_paren = ""  # what the parenthesis about to open belongs to
    decorated = False
    match, group_of = _JS_TOKEN.match, None
    while pos < end:
        m = match(text, pos)
        if m is None:
            ch = text[pos]
            raise _Stop("unterminated literal" if ch in "\"'" else "unknown character", pos)
        group_of = m.lastgroup
        at, pos = pos, m.end()
        if group_of == "s":
            if not newline:
                s = m.group()
                newline = "\n" in s or "\r" in s or "\u2028" in s or "\u2029" in s
            continue
        if group_of == "c":
            if not newline and "\n" in m.group():
                newline = True
            continue
        t = m.group()
        if must is not None:
            if t not in must and not (t == "}" and "}" in must):
                raise _Stop("incomplete statement", at)
            must = None
        kind = top.kind
        statements = kind in ("block", "top", "class", "switch", "type")
        if group_of == "w" and last not in (".", "?.", "#"):
            key = kind == "object" and last in ("{", ",") or kind == "class" and (state == START or last in modifiers or newline and state in (OPERAND, END))
            if t in _JS_RESERVED and not key:
                if t == "with" and state == OPERAND and last == "0" and not newline:
                    state = OP  # attributes of an import
                elif typed and t == "const" and last == "as":
                    state = OPERAND
                elif t in ("in", "instanceof"):
                    if state not in (OPERAND, END):
                        raise _Stop("misplaced word", at)
                    state = OP
                elif t == "extends":
                    if not pending and not typed:
                        raise _Stop("misplaced word", at)
                    state = OP
                else:
                    if state == OPERAND and not (newline and statements) and last not in modifiers and not (typed and t in ("const", "typeof", "void", "null", "this", "true", "false", "new", "import") and last in ("as", "is", "keyof", "asserts")) and not (t == "default" and before == "export"):
                        raise _Stop("misplaced word", at)
                    if state == OP and t not in _JS_VALUES and t not in _JS_UNARY and t not in ("function", "class", "import", "yield") and last not in ("=>", "export", "@)") and not (typed and (t in ("const", "enum") or last in (":", "|", "&", "<", "="))):
                        raise _Stop("misplaced word", at)
                    if t in _JS_VALUES:
                        state = OPERAND
                    elif t in _JS_UNARY:
                        state = OP if not (typed and t == "void") else END
                    elif t in _JS_LOOSE:
                        state = END
                    elif t in _JS_PAREN or t == "catch":
                        if t == "catch":
                            if last != "}":
                                raise _Stop("misplaced word", at)
                            must = ("(", "{")
                        else:
                            must = ("(", "await") if t == "for" else ("(",)
                        after_paren = "for" if t == "for" else "switch" if t == "switch" else "head"
                        state = START
                    elif t in ("try", "finally"):
                        if t == "finally" and last != "}":
                            raise _Stop("misplaced word", at)
                        must = ("{",)
                        state = START
                    elif t == "function":
                        after_paren = "function"
                        state = END
                    elif t in ("class", "enum"):
                        pending = "class" if t == "class" else "object"
                        state = END
                    elif t in ("const", "var"):
                        state = OP
                    elif t == "else":
                        if last not in ("}", ";") and not newline:
                            raise _Stop("misplaced word", at)
                        state = START
                    elif t == "case":
                        if kind != "switch":
                            raise _Stop("misplaced word", at)
                        top.case, state = True, OP
                    elif t == "default":
                        if last == "export":
                            state = START
                        elif kind == "switch":
                            must, state = (":",), END
                            top.case = True
                        elif not (typed or kind == "names"):
                            raise _Stop("misplaced word", at)
                    elif t == "import":
                        if state == START and kind != "top" and not text[pos : pos + 20].lstrip().startswith(("(", ".")):
                            raise _Stop("misplaced word", at)
                        state = END
                    elif t == "export":
                        if kind != "top" and not typed:
                            raise _Stop("misplaced word", at)
                        state = START
                    else:
                        state = START if t == "do" else END
                before, last, newline = last, t, False
                continue
            if state == OPERAND:
                joined = last in modifiers or typed and t in _TS_INFIX or t in ("of", "from", "as", "async") or last in ("import", "from", "as")
                if not joined and not (newline and statements) and not decorated:
                    raise _Stop("misplaced word", at)
            elif state == END and last == ")" and not newline and top.kind not in ("block", "top", "switch", "class") and not typed:
                raise _Stop("misplaced word", at)
            if typed and t in _TS_HEADS and (state != OPERAND or newline) and re.match(r"[ \t]+[\w$.\"']", text[pos : pos + 40]):
                pending = "type"
            if typed and t in _TS_INFIX and state in (OPERAND, END) and not newline and last not in ("let", "const", "var"):
                state = OP if t != "implements" else END
            elif t == "of" and state == OPERAND and last not in ("let", "const", "var"):
                state = OP
            else:
                state = OPERAND
            before, last, newline, decorated = last, t, False, False
            continue
        if group_of == "w":  # a property after a dot
            state = OPERAND
        elif group_of in ("n", "q"):
            if state == OPERAND and not (newline and statements) and last != "from" and not (typed and last == "module"):
                raise _Stop("misplaced literal", at)
            if last in (".", "?."):
                raise _Stop("misplaced literal", at)
            if group_of == "n" and pos < end and (text[pos].isalnum() or text[pos] in "_$"):
                raise _Stop("bad number", at)
            state, t = OPERAND, "0"
        elif t in "([":
            if t == "(" and after_paren:
                role, after_paren = after_paren, ""
            elif t == "(" and last == "@)":
                role = "decorator"
            elif t == "(" and kind == "class" and state != OP:
                role = "params"
            elif t == "(" and kind == "object" and state == OPERAND:
                role = "method"
            else:
                role = ""
            if last == "." :
                raise _Stop("misplaced bracket", at)
            top = _Context(t, role, at)
            stack.append(top)
            state = START
        elif t == "{":
            if last == ".":
                raise _Stop("misplaced bracket", at)
            after_paren = ""
            if last == "let":
                role = "object"
            elif pending:
                role, pending = pending, ""
            elif last in ("=>", ")", "else", "do", "try", "finally", "static", "catch", ";", "}") or state == START and kind in ("block", "top", "switch") and last not in ("import", "export"):
                role = "switch" if last == ")" and before == "switch)" else "try" if last == "try" else "block"
                if last == "}" and kind in ("object", "", "params") :
                    raise _Stop("misplaced bracket", at)
            elif last in ("import", "export") or kind == "top" and last in ("type", ",") and state != START and not typed:
                role = "names"
            elif state == OPERAND or state == END and last not in _JS_LOOSE:
                if state == OPERAND and not typed and last not in ("import", "type") and not (newline and statements):
                    raise _Stop("misplaced bracket", at)
                role = "names" if last in ("import", "type") else "block"
            elif kind == "class" and state == START:
                raise _Stop("misplaced bracket", at)
            else:
                role = "object"
            top = _Context(t, role, at)
            stack.append(top)
            state = START
        elif t in ")]}":
            if len(stack) == 1 or top.open != _CLOSES[t] and not (t == "}" and top.kind == "template"):
                raise _Stop("unbalanced bracket", at)
            if state == OP and last != "," and not (typed and last in (":", ">", "<")):
                raise _Stop("premature end", at)
            if state == START and t == "]" and last == "" :
                raise _Stop("premature end", at)
            role, opened = top.kind, top.open
            if top.ternaries and not typed:
                raise _Stop("premature end", at)
            empty = last == opened
            stack.pop()
            top = stack[-1]
            if role == "template":
                last = "`"
                pos = _template(text, pos, stack)
                top = stack[-1]
                state = START if top.kind == "template" and top.at == pos else OPERAND
                last, before, newline = ("{" if state == START else "`"), "", False
                continue
            if t == ")":
                before = "switch)" if role == "switch" else ""
                last, newline = ")", False
                if role in ("head", "for", "switch"):
                    state = START
                    if role == "switch":
                        must = ("{",)
                    if empty:
                        raise _Stop("premature end", at)
                elif role == "decorator":
                    state = END
                elif role in ("function", "params", "method"):
                    state = END
                    must = ("{", ":", ";") if typed else ("{",)
                    if typed and (top.kind in ("type", "class", "object") or role == "function"):
                        must = None if top.kind == "type" else (*must, "=", "?", "!", ",", "}")
                        if role == "function" or role == "params":
                            must = None if newline else must
                            must = None  # overloads and abstract members may end the line
                else:
                    if empty and not typed and re.match(r"\s*=>", text[pos : pos + 40]) is None and before == "" and not _called(text, at):
                        raise _Stop("premature end", at)
                    state = OPERAND
                continue
            if t == "}":
                if role in ("object", "names"):
                    state = OPERAND
                else:
                    state = END
                    if role == "try":
                        must = ("catch", "finally")
                last, before, newline = "}", "", False
                continue
            state = OPERAND
        elif t == ";":
            if state == OP and last not in (">", "*"):
                raise _Stop("premature end", at)
            if kind in ("", "object", "params", "head", "function", "method", "names") and not typed or kind in ("", "head") and top.open == "[":
                if top.kind != "for":
                    raise _Stop("misplaced operator", at)
            if top.ternaries and not typed:
                raise _Stop("premature end", at)
            state, pending = START, ""
        elif t == ",":
            if state == OP or state == START and not (top.open == "[" or typed and last == ">"):
                raise _Stop("misplaced operator", at)
            if kind in ("top", "block", "switch", "class") and state == END and last == "}" and not typed and kind == "class":
                raise _Stop("misplaced operator", at)
            state = OP if statements else START
            if kind == "type":
                state = START
        elif t == ":":
            if typed:
                if state in (START, OP) and last not in ("?", "!"):
                    raise _Stop("misplaced operator", at)
                if top.ternaries:
                    top.ternaries -= 1
            elif top.ternaries:
                if state == OP:
                    raise _Stop("misplaced operator", at)
                top.ternaries -= 1
            elif kind == "object":
                if state not in (OPERAND, END):
                    raise _Stop("misplaced operator", at)
            elif top.case:
                if state == OP:
                    raise _Stop("misplaced operator", at)
                top.case = False
                before, last, newline, state = last, ":", False, START
                continue
            elif state == OPERAND and kind in ("block", "top", "switch") and before in ("", ";", "{", "}", ":"):
                before, last, newline, state = last, ":", False, START  # a label
                continue
            else:
                raise _Stop("misplaced operator", at)
            state = OP
            if typed and top.case:
                top.case, state = False, START
        elif t == "?":
            if state not in (OPERAND, END) and not (typed and last in ("+", "-")):
                raise _Stop("misplaced operator", at)
            if not typed or not re.match(r"\s*[:)(,;=?]", text[pos : pos + 20]):
                top.ternaries += 1
            state = OP
            if typed:
                if re.match(r"\s*[),;(=]", text[pos : pos + 20]):
                    state = OPERAND
        elif t == "=>":
            if state == START or state == OP and last != ">":
                raise _Stop("misplaced operator", at)
            state = OP
        elif t in (".", "?."):
            if state not in (OPERAND, END) and not (last == "import"):
                raise _Stop("misplaced operator", at)
            rest = re.compile(r"(?:\s|//[^\n]*\n|/\*.*?\*/)*(?:[#\w$\\\u00aa-\uffff(\[`])" if t == "?." else r"(?:\s|//[^\n]*\n|/\*.*?\*/)*(?:[#A-Za-z_$\\\u00aa-\uffff])", re.S).match(text, pos)
            if rest is None:
                raise _Stop("misplaced operator", at)
            state = END if t == "?." and text[rest.end() - 1] in "([`" else OP
        elif t == "`":
            if state == OPERAND and newline and statements and not typed:
                pass
            pos = _template(text, pos, stack)
            if stack[-1] is not top:
                top = stack[-1]
                state, t = START, "{"
            else:
                state = OPERAND
        elif t == "@":
            if last == "@" or state == OPERAND and not newline:
                raise _Stop("unknown character", at)
            if re.match(r"[A-Za-z_$(]", text[pos : pos + 1]) is None:
                raise _Stop("unknown character", at)
            decorated, state = True, START
            d = re.compile(r"[\w$.]+").match(text, pos)
            if d:
                pos = d.end()
            state, t = END, "@)"
        elif t == "#":
            if re.match(r"[A-Za-z_$]", text[pos : pos + 1]) is None or state == OPERAND and not newline and last not in modifiers:
                raise _Stop("unknown character", at)
        elif t in ("++", "--"):
            if state == OPERAND and not newline:
                state = OPERAND
            else:
                state = OP
        elif t in ("/", "/=") and (state in (START, OP) or state == END and last not in (")", "}")) :
            r = _JS_REGEX.match(text, at)
            if r is None:
                raise _Stop("unterminated literal", at)
            pos, state, t = r.end(), OPERAND, "0"
        elif t in ("!", "~"):
            if state == OPERAND and not (newline and statements):
                if not (typed and t == "!"):
                    raise _Stop("misplaced operator", at)
            else:
                state = OP
        elif t == "...":
            if state == OPERAND or kind in ("top", "block", "switch", "class") and not typed:
                raise _Stop("misplaced operator", at)
            state = OP
        elif t in _JS_BINARY:
            if t == "*" and (last in ("function", "yield", "import", "export", "async", "static") or kind in ("class", "object") and state in (START, END)):
                state = END if last in ("import", "export", "yield") else START
                if last in ("function", "async", "static"):
                    state = END
            elif state in (START, OP) and not (t in ("+", "-") or typed and (t in ("<", "|", "&") or t in (">", ">>") or last in (">", "!") or t == "=" and last == "export")):
                raise _Stop("misplaced operator", at)
            elif typed and t in (">", ">>", ">>>"):
                state = END
            else:
                state = OP
        before, last, newline = last, t, False
    if len(stack) > 1:
        raise _Stop("unbalanced bracket", stack[-1].at)
    if state == OP or must is not None or pending or after_paren or top.ternaries and not typed:
        raise _Stop("premature end", end)


def _called(text: str, at: int) -> bool:
    """Whether the empty parentheses that close at `at` follow a callee."""
    before = text[max(0, at - 200) : at].rstrip()
    before = before[:-1].rstrip() if before.endswith("(") else before
    return bool(before) and (before[-1].isalnum() or before[-1] in "_$)]}`>?.\"'" or not before[-1].isascii() or before[-1] == "/")


def _template(text: str, pos: int, stack: list[_Context]) -> int:
    """Reads template characters up to the end of the literal or its next placeholder."""
    pos = _JS_TEMPLATE.match(text, pos).end()
    if pos >= len(text):
        raise _Stop("unterminated literal", pos)
    if text[pos] == "`":
        return pos + 1
    stack.append(_Context("{", "template", pos + 2))
    return pos + 2


# ---------------------------------------------------------------- Rust
_RUST_TOKEN = re.compile(
    r"""(?P<s>[ \t\r\n\v\f\x85\u200e\u200f\u2028\u2029]+)
    |(?P<c>//[^\n]*)|(?P<b>/\*)
    |(?P<r>(?:b|c)?r(?P<h>\#*)"[\s\S]*?"(?P=h))
    |(?P<q>(?:b|c)?"(?:[^"\\]|\\[\s\S])*")
    |(?P<k>b?'(?:[^'\\\n\r\t]|\\(?:[nrt0\\'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')
    |(?P<l>'[A-Za-z_\u00aa-\uffff]\w*)
    |(?P<w>(?:r\#)?[A-Za-z_\u00aa-\uffff]\w*)
    |(?P<n>0[xX][0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0[oO][0-7_]+\w*|0[bB][01_]+\w*|\d[\d_]*(?:\.(?!\.|[A-Za-z_])[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?)
    |(?P<p><<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[{}()\[\];,<>+\-*/%&|^!?:=.@\#$~])""",
    re.X,
)
_RUST_ITEMS = frozenset("fn struct enum trait impl mod use const static type extern pub unsafe async union macro_rules crate default auto safe".split())
_RUST_VALUES = frozenset("self Self super crate true false".split())
_RUST_STRICT_BINARY = frozenset("= == != <= >= / % ^ += -= *= /= %= ^= &= |= <<= >>= + =>".split())


def _rust(text: str) -> None:
    """Raises at the first place where a Rust source file breaks off."""
    pos, end = 0, len(text)
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        pos = text.find("\n") if "\n" in text else end
    top = _Context("", "items", 0)
    stack = [top]
    state, last, before = START, "", ""
    head = ""  # the item whose brace comes next
    named = False  # an item word whose name comes next
    params = False  # a function's parentheses come next
    must: tuple[str, ...] | None = None
    match = _RUST_TOKEN.match
    while pos < end:
        m = match(text, pos)
        if m is None:
            raise _Stop("unterminated literal" if text[pos] in "\"'" else "unknown character", pos)
        g, at, pos = m.lastgroup, pos, m.end()
        if g == "h":
            g = "r"
        if g in ("s", "c"):
            continue
        if g == "b":
            depth = 1
            while depth:
                e = re.compile(r"/\*|\*/").search(text, pos)
                if e is None:
                    raise _Stop("unterminated comment", at)
                depth += 1 if e.group() == "/*" else -1
                pos = e.end()
            continue
        t = m.group()
        if top.kind == "tree":  # macros take any balanced tokens
            if t in ("(", "[", "{"):
                top = _Context(t, "tree", at)
                stack.append(top)
            elif t in (")", "]", "}"):
                if top.open != _CLOSES[t]:
                    raise _Stop("unbalanced bracket", at)
                was = stack.pop()
                top = stack[-1]
                if top.kind != "tree":
                    state = START if was.at < 0 else END if t == "}" else OPERAND
                    before, last = "", ("pub" if t == ")" and was.at < 0 else "]" if was.at < 0 else t)
            elif g == "p" and t == "~":
                raise _Stop("unknown character", at)
            continue
        if must is not None:
            if t not in must:
                raise _Stop("incomplete statement", at)
            must = None
        kind = top.kind
        if named and g != "w":
            if not (t in ("<", "{", "(", "!", "*", "_") or t == "[" ):
                raise _Stop("incomplete statement", at)
            named = False
        if g == "w":
            if named:
                named = False
                if t in _RUST_VALUES or t in ("fn", "let", "if", "for"):
                    if not (last in ("const", "unsafe") and t == "fn"):
                        raise _Stop("misplaced word", at)
                if not (last == "const" and t in ("fn", "unsafe", "async", "extern", "mut")) and not (last == "type" and False):
                    before, last, state = last, t, OPERAND
                    continue
            if last == ".":
                state = OPERAND
            elif t in ("as", "in", "where"):
                if state not in (OPERAND, END) and not (t == "where"):
                    raise _Stop("misplaced word", at)
                state = OP if t != "where" else START
            elif t == "else":
                if last != "}" and state != OPERAND:
                    raise _Stop("misplaced word", at)
                must, state = ("{", "if"), START
            elif t in ("if", "match", "while", "for", "loop"):
                if t == "for" and (head == "impl" or text[pos : pos + 1] == "<" or re.match(r"\s*<", text[pos : pos + 10])):
                    state = OP
                elif state == OPERAND and t != "if":
                    raise _Stop("misplaced word", at)
                else:
                    if kind in ("items", "fields"):
                        raise _Stop("misplaced word", at)
                    top.header = True
                    state = OP if t != "loop" else START
                    if t == "loop":
                        must = ("{",)
            elif t in ("let", "return", "break", "continue", "mut", "ref", "move", "dyn", "await", "yield", "box", "unsafe", "async", "pub", "static", "const", "type", "fn", "struct", "enum", "trait", "impl", "mod", "use", "extern", "union", "macro_rules"):
                if t in ("union", "macro_rules", "box", "await", "yield"):
                    if t == "macro_rules":
                        name = re.compile(r"!\s*\w+\s*").match(text, pos)
                        if name is None:
                            raise _Stop("incomplete statement", at)
                        pos = name.end()
                        before, last, state = "macro", "!", OPERAND
                        continue
                    if state == OPERAND and not (t == "union" and kind in ("items", "block")):
                        raise _Stop("misplaced word", at)
                    named = t == "union" and bool(re.match(r"\s+\w+\s*[<{]", text[pos : pos + 60]))
                    head = "struct" if named else head
                    state = OPERAND
                    before, last = last, t
                    continue
                if state == OPERAND and not (t in ("mut", "const") and last in ("*", "&")) and not (last.startswith("'")) and not (t in ("fn", "unsafe", "extern", "async", "const", "impl", "trait", "struct", "use", "mod", "type", "enum", "static") and last in ("pub", "default", ")", "C") and before != "x"):
                    raise _Stop("misplaced word", at)
                if t == "let" and kind in ("items", "fields"):
                    raise _Stop("misplaced word", at)
                if t in ("fn", "struct", "enum", "trait", "mod") and not (t == "fn" and last == ">") and not (t == "fn" and state == OP and last not in ("pub", "unsafe", "async", "const", "extern", "default")):
                    named, head = True, t
                    params = t == "fn"
                elif t == "impl" and state != OP and kind in ("items", "block"):
                    head = "impl"
                elif t == "extern" and kind == "items":
                    head = "extern"
                elif t in ("type", "static") or t == "const" and state == START and kind in ("items", "block"):
                    named = t != "static"
                state = END if t in ("return", "break", "continue", "pub", "unsafe", "async", "const", "extern", "move", "static", "impl") else OP if t in ("let", "use", "dyn", "mut", "ref") else START
                if t == "fn":
                    state = END
            else:
                if state == OPERAND and not last.startswith("'") and not (last in ("auto", "default", "raw", "safe")):
                    raise _Stop("misplaced word", at)
                if t == "crate" and last == "extern":
                    before, last, state = last, t, END
                    continue
                if state == START and kind == "items" and t not in _RUST_ITEMS and not re.match(r"\s*(?:::\s*\w+\s*)*!", text[pos : pos + 200]) and last not in ("impl", "where", ",") and not head:
                    raise _Stop("misplaced word", at)
                state = OPERAND
        elif g in ("r", "q", "k", "n"):
            if state == OPERAND and last != "extern":
                raise _Stop("misplaced literal", at)
            if last == "." and g != "n" or state == START and kind == "items" and last != "extern":
                raise _Stop("misplaced literal", at)
            if g == "n" and pos < end and (text[pos].isalnum()):
                raise _Stop("bad number", at)
            state, t = OPERAND, "C" if last == "extern" else "0"
        elif g == "l":
            if state == OPERAND and last not in ("&", "break", "continue", "<", ",", "+"):
                raise _Stop("misplaced literal", at)
            state = END
        elif t in ("(", "[", "{"):
            if t == "(" and last == "pub":
                top = _Context(t, "tree", -1)
                stack.append(top)
                continue
            if last == "!" and before != "" and before not in ("(", ",", "=", "&&", "||", "{", ";", "if", "while", "return", "!") and state == OPERAND:
                top = _Context(t, "tree", at)
                stack.append(top)
                continue
            if t == "(" and params:
                role, params = "params", False
            elif t == "{":
                if head in ("mod", "impl", "trait", "extern"):
                    role = "items"
                elif head in ("struct", "enum"):
                    role = "fields"
                else:
                    role = "block"
                    if kind == "items" and head != "fn" and last not in ("=", "::", "const") and state in (START, OP) and last not in ("use", ","):
                        raise _Stop("misplaced bracket", at)
                if last == "::" or last == "use":
                    role = "names"
                head, top.header = "", False
            else:
                role = "list"
                if t == "[" and state == START and kind == "items" and last not in ("#", "where", ","):
                    raise _Stop("misplaced bracket", at)
            top = _Context(t, role, at)
            stack.append(top)
            state = START
        elif t in (")", "]", "}"):
            if len(stack) == 1 or top.open != _CLOSES[t]:
                raise _Stop("unbalanced bracket", at)
            if state == OP and last not in ("..", "*", "&"):
                raise _Stop("premature end", at)
            if top.header or named or params:
                raise _Stop("premature end", at)
            role = top.kind
            stack.pop()
            top = stack[-1]
            if t == "}":
                state = OPERAND if role == "names" else END
                if role in ("items", "fields"):
                    state = START
                elif top.kind == "items":
                    state = START if role == "block" else state
            else:
                state = OPERAND
                if role == "params":
                    must = ("{", ";", "->", "where")
        elif t == ";":
            if state == OP and last != ".." and not (last == "*" and before == "::"):
                raise _Stop("premature end", at)
            if top.header or named or params:
                raise _Stop("premature end", at)
            if top.open == "(" or kind == "fields":
                raise _Stop("misplaced operator", at)
            state, head = START, ""
        elif t == ",":
            if state in (OP,) or last == "," or state == START and last not in (">", "}"):
                raise _Stop("misplaced operator", at)
            state = START
        elif t == "#":
            inner = re.compile(r"!?\s*\[").match(text, pos)
            if inner is None or state == OPERAND:
                raise _Stop("unknown character", at)
            top = _Context("[", "tree", -1)
            stack.append(top)
            pos = inner.end()
            continue
        elif t in ("$", "~"):
            raise _Stop("unknown character", at)
        elif t == "!":
            if state == OPERAND and re.match(r"\w", last[-1:]) and last not in ("0",):
                pass  # a macro's name
            elif state == OPERAND:
                raise _Stop("misplaced operator", at)
            else:
                state = OP if last not in ("->", "impl") else OPERAND
        elif t == "?":
            if state in (START, OP) and last not in (":", "+"):
                raise _Stop("misplaced operator", at)
            state = OP if last in (":", "+") else OPERAND
        elif t in (".", "::"):
            if t == "." and (state in (START, OP)):
                raise _Stop("misplaced operator", at)
            state = OP
        elif t in ("..", "..=", "..."):
            state = END
        elif t in (">", ">>"):
            if state == OP and last not in ("->", "=", ":"):
                raise _Stop("misplaced operator", at)
            state = END
        elif t == "@":
            if state != OPERAND:
                raise _Stop("unknown character", at)
            state = OP
        elif t == "=>":
            if state in (START, OP):
                raise _Stop("misplaced operator", at)
            top.header, state = False, OP
        elif t in _RUST_STRICT_BINARY:
            if state in (START, OP) and not (t == "=" and last == ">"):
                raise _Stop("misplaced operator", at)
            state = OP
        else:  # < - * & && | || << -> :
            if state == START and kind == "items" and t not in ("<", "->"):
                raise _Stop("misplaced operator", at)
            state = OP
            if t in ("|", "||") and before is not None:
                state = END  # parameters of a closure may be followed by its body
        before, last = last, t
    if len(stack) > 1:
        raise _Stop("unbalanced bracket", stack[-1].at)
    if state in (OP,) or must is not None or named or params or head or top.header:
        raise _Stop("premature end", end)


# ---------------------------------------------------------------- Python
_PY_TOKEN = re.compile(
    r"""(?P<s>[ \t\f]+)|(?P<e>\\\r?\n)|(?P<c>\#[^\n]*)|(?P<z>\r?\n)
    |(?P<q>(?P<f>[A-Za-z]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"(?!"")(?:[^"\\\n]|\\[\s\S])*"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))
    |(?P<n>(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)[jJ]?)
    |(?P<w>[^\W\d]\w*)
    |(?P<p>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[{}()\[\]:;,<>+\-*/%&|^~=.@])""",
    re.X,
)
_PY_WORDS = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY_BLOCKS = frozenset("if elif else for while try except finally with def class async match case".split())
_PY_INFIX = frozenset("and or in is not if else for as import from async".split())
_PY_BINARY = frozenset("= == != <= >= < > / % ^ | & // << >> += -= *= /= %= &= |= ^= @= **= //= <<= >>= := . -> :".split())


def _format_end(text: str, at: int, quote: str) -> int:
    """Where the format string whose text begins at `at` ends, behind its quote; -1 if a field of it does not close.

    Fields may hold strings with the same quotes, and formats with fields of their own.
    """
    depth, end = 0, len(text)
    while at < end:
        ch = text[at]
        if ch == "\\" and not depth:
            at += text[at + 1 : at + 2] in ("\\", "'", '"', "\n")
        elif not depth and text.startswith(quote, at):
            return at + len(quote)
        elif not depth and ch in "{}" and text[at : at + 2] == ch * 2:
            at += 1
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth < 0:
                return -1
        elif depth and ch in "\"'":
            inner = ch * 3 if text.startswith(ch * 3, at) else ch
            at = _format_end(text, at + len(inner), inner) if text[at - 1] in "fF" else text.find(inner, at + len(inner)) + len(inner)
            if at < len(inner):
                return -1
            continue
        elif ch == "\n" and len(quote) == 1 and not depth:
            return -1
        at += 1
    return -1


def _python(text: str) -> None:
    """Raises where a Python module looks broken; it may be wrong, but misses little."""
    pos, end = 0, len(text)
    text = text.removeprefix("\ufeff")
    end = len(text)
    levels = [0]
    depth: list[tuple[str, int]] = []
    state, last, first, fresh = START, "", "", True
    indent_due = False
    tries: dict[int, bool] = {}
    colon = False
    while pos < end:
        m = _PY_TOKEN.match(text, pos)
        if m is None:
            raise _Stop("unterminated literal" if text[pos] in "\"'" else "unknown character", pos)
        g, at, pos = m.lastgroup, pos, m.end()
        if g == "f":
            g = "q"
        if g in ("s", "e", "c"):
            continue
        if g == "z":
            if depth or fresh:
                continue
            if state == OP:
                raise _Stop("premature end", at)
            if first in _PY_BLOCKS and first not in ("match", "case", "async") and not colon or first == "async" and not colon and last != ")":
                raise _Stop("missing colon", at)
            if first == "match" and state == OPERAND and not colon and last != ":" and text[line:at].split()[1:2] and re.match(r"match +[\w(\[]", text[line:at].strip()) and "=" not in text[line:at]:
                raise _Stop("missing colon", at)
            indent_due = last == ":"
            if first == "try":
                tries[levels[-1]] = True
            state, last, first, fresh, colon = START, "", "", True, False
            continue
        t = m.group()
        if fresh:
            start = text.rfind("\n", 0, at) + 1
            lead = text[start:at]
            width = len(lead.expandtabs(8).replace("\f", ""))
            if indent_due:
                if width <= levels[-1]:
                    raise _Stop("missing block", at)
                levels.append(width)
            elif width > levels[-1]:
                raise _Stop("bad indentation", at)
            while width < levels[-1]:
                gone = levels.pop()
                if tries.pop(gone, False):
                    raise _Stop("missing handler", at)
            if width != levels[-1]:
                raise _Stop("bad indentation", at)
            if tries.get(width):
                if t not in ("except", "finally"):
                    raise _Stop("missing handler", at)
                del tries[width]
            first, fresh, line, indent_due = t, False, start, False
        if last in ("class", "def") and g != "w":
            raise _Stop("misplaced token", at)
        if last == ":" and not depth and colon and state == START:
            first = "=" if first in _PY_BLOCKS else first
        if g == "w":
            if t in _PY_WORDS and last != ".":
                if t in ("class", "def", "del", "global", "nonlocal", "pass", "break", "continue", "raise", "return", "try", "while", "with", "except", "finally", "elif", "assert") and state in (OPERAND, OP) and last not in ("async",):
                    raise _Stop("misplaced word", at)
                if t in ("and", "or", "in", "is", "as", "else") and state != OPERAND and not (t == "in" and last == "not") and last != ":" and not (t == "else" and first == "else"):
                    raise _Stop("misplaced word", at)
                if state == OPERAND and t in ("lambda", "yield", "await"):
                    raise _Stop("misplaced word", at)
                state = END if t in ("return", "yield", "raise", "pass", "break", "continue", "lambda", "import", "except", "else", "try", "finally", "not", "async") else OP
                if t == "lambda":
                    depth and None
            else:
                if state == OPERAND and not (last in ("match", "case", "type", "print") and first == last and last != "print"):
                    raise _Stop("misplaced word", at)
                state = OPERAND
        elif g in ("n", "q"):
            if g == "n":
                if state == OPERAND and not (last in ("match", "case") and first == last) or pos < end and (text[pos].isalnum() or text[pos] == "_") and not re.match(r"(?:and|or|if|else|in|is|for|not)\b", text[pos : pos + 5]) or re.match(r"0\d", t) and t.strip("0_").isdigit():
                    raise _Stop("misplaced literal", at)
                t = "0"
            else:
                f = (m.group("f") or "").lower()
                if f not in ("", "r", "b", "f", "u", "br", "rb", "fr", "rf"):
                    raise _Stop("bad prefix", at)
                if state == OPERAND and last != "'" and not (last in ("match", "case") and first == last):
                    raise _Stop("misplaced literal", at)
                if "f" in f:
                    begin = at + len(f)
                    quote = text[begin] * (3 if text.startswith(text[begin] * 3, begin) else 1)
                    pos = _format_end(text, begin + len(quote), quote)
                    if pos < 0 or re.search(r"\{\s*[}!]", text[begin:pos].replace("{{", "")):
                        raise _Stop("bad format string", at)
                t = "'"
            state = OPERAND
        elif t in ("(", "[", "{"):
            if t == "{" and state == OPERAND and not (last in ("match", "case", "return")):
                raise _Stop("misplaced bracket", at)
            depth.append((t, at))
            state = START
        elif t in (")", "]", "}"):
            if not depth or depth[-1][0] != _CLOSES[t]:
                raise _Stop("unbalanced bracket", at)
            if state == OP and last not in (",", ":", "*", "/"):
                raise _Stop("premature end", at)
            depth.pop()
            state = OPERAND
        elif t == ":":
            if not depth:
                colon = True
                if state == OP or last == "" :
                    raise _Stop("misplaced operator", at)
            state = START
        elif t in (",", ";"):
            if t == ";" and depth or state == OP or last in (",", "(", "[", "{") and not (last == "[" and False):
                raise _Stop("misplaced operator", at)
            if t == "," and not depth and first in ("raise", "assert", "except", "import") and (first == "raise" or first == "except"):
                raise _Stop("misplaced operator", at)
            if t == ";" and first:
                first = ";"
            state = START
        elif t in ("+", "-", "~"):
            if t == "~" and state == OPERAND:
                raise _Stop("misplaced operator", at)
            state = OP
        elif t in ("*", "**", "@", "..."):
            if t == "@" and last == "@":
                raise _Stop("unknown character", at)
            if t == "..." and state == OPERAND:
                raise _Stop("misplaced operator", at)
            bare = t == "*" and (last == "import" or last in ("(", ",") and re.match(r"\s*[,)]", text[pos : pos + 200]))  # import *, (a, *, b)
            state = OPERAND if t == "..." or bare else OP
        elif t in _PY_BINARY:
            if t == "/" and depth and last == "," and re.match(r"\s*[,)]", text[pos : pos + 200]):  # (a, /, b)
                state, last = OPERAND, t
                continue
            if t == "." and first == "from" and re.match(r"[ \t]*import\b", text[pos : pos + 200]):  # from . import a
                state, last = OPERAND, "from"
                continue
            if t == "=" and last == ",":  # a, = b
                state = OPERAND
            if state in (START, OP) and not (t == "/" and depth and last == ",") and not (t == "." and first == "from"):
                raise _Stop("misplaced operator", at)
            if t == "<" and text[pos : pos + 1] == ">":
                raise _Stop("misplaced operator", at)
            state = OP
        last = t
    if depth:
        raise _Stop("unbalanced bracket", depth[-1][1])
    if state == OP or indent_due or last == ":" or any(tries.values()) or first in _PY_BLOCKS and first not in ("match", "case", "async") and not colon:
        raise _Stop("premature end", end)


_JSON_TOKEN = re.compile(r"""[ \t\r\n]+|(?P<q>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)\b)|(?P<p>[{}\[\]:,])""", re.ASCII)


def _json(text: str) -> None:
    """Strict JSON by a stack of what may come next; an empty text is an empty file and passes."""
    if not text.strip(" \t\r\n"):
        return
    stack: list[tuple[str, int]] = []
    want, pos = "value", 0
    while pos < len(text):
        m = _JSON_TOKEN.match(text, pos)
        if m is None:
            raise _Stop("unterminated literal" if text[pos] == '"' else "unknown character", pos)
        at, pos = pos, m.end()
        g = m.lastgroup
        if g is None:
            continue
        t = m.group()
        if g == "q" and want in ("key", "key or end"):
            want = "colon"
        elif g in ("q", "v") and want in ("value", "value or end"):
            want = "next" if stack else "nothing"
        elif t == ":" and want == "colon":
            want = "value"
        elif t == "," and want == "next":
            want = "key" if stack[-1][0] == "{" else "value"
        elif t in "{[" and want in ("value", "value or end"):
            stack.append((t, at))
            want = "key or end" if t == "{" else "value or end"
        elif t in "}]" and stack and stack[-1][0] == _CLOSES[t] and (want == "next" or want.endswith("or end")):
            stack.pop()
            want = "next" if stack else "nothing"
        else:
            raise _Stop("misplaced token", at)
    if stack or want != "nothing":
        raise _Stop("premature end", len(text))


_TOML_STRING = r"\"\"\"(?:[^\\]|\\[\s\S])*?\"{3,5}|'''[\s\S]*?'{3,5}|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')[^'\n]*'"
_TOML_KEY = re.compile(rf"[ \t]*(?:[A-Za-z0-9_-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[A-Za-z0-9_-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'))*[ \t]*")
_TOML_VALUE = re.compile(rf"(?P<q>{_TOML_STRING})|(?P<v>true|false|[+-]?(?:inf|nan)|0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d{{4}}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w.+-])")
_TOML_SPACE = re.compile(r"(?:[ \t\r\n]|#[^\n]*)*")
_TOML_END = re.compile(r"[ \t]*(?:#[^\n]*)?\r?(?:\n|\Z)")


def _toml(text: str) -> None:
    pos, end = 0, len(text)
    while True:
        pos = _TOML_SPACE.match(text, pos).end()
        if pos >= end:
            return
        double = text.startswith("[[", pos)
        if text[pos] == "[":
            m = _TOML_KEY.match(text, pos + 1 + double)
            if m is None or not text.startswith("]]" if double else "]", m.end()):
                raise _Stop("bad header", pos)
            pos = m.end() + 1 + double
        else:
            m = _TOML_KEY.match(text, pos)
            if m is None or not text.startswith("=", m.end()):
                raise _Stop("bad statement", pos)
            pos = _toml_value(text, m.end() + 1)
        m = _TOML_END.match(text, pos)
        if m is None:
            raise _Stop("misplaced token", pos)
        pos = m.end()


def _toml_value(text: str, pos: int) -> int:
    """The end of a value; open arrays and inline tables are kept on a stack."""
    stack: list[str] = []
    while True:
        pos = (_TOML_SPACE if stack else re.compile(r"[ \t]*")).match(text, pos).end()
        if stack and text.startswith("]" if stack[-1] == "[" else "}", pos):
            pos += 1
            stack.pop()
        else:
            if stack and stack[-1] == "{":
                m = _TOML_KEY.match(text, pos)
                if m is None or not text.startswith("=", m.end()):
                    raise _Stop("bad statement", pos)
                pos = re.compile(r"[ \t]*").match(text, m.end() + 1).end()
            if text.startswith(("[", "{"), pos):
                stack.append(text[pos])
                pos += 1
                continue
            m = _TOML_VALUE.match(text, pos)
            if m is None:
                raise _Stop("bad value", pos)
            pos = m.end()
        while stack:
            pos = _TOML_SPACE.match(text, pos).end()
            if text.startswith(",", pos):
                pos += 1
                break
            if text.startswith("]" if stack[-1] == "[" else "}", pos):
                pos += 1
                stack.pop()
                continue
            raise _Stop("unbalanced bracket", pos)
        if not stack:
            return pos


CHECKS: dict[str, Callable[[str], None]] = {
    "python": _python,
    "javascript": lambda text: _scripts(text, False),
    "typescript": lambda text: _scripts(text, True),
    "rust": _rust,
    "json": _json,
    "toml": _toml,
}


def problem(text: str | None, language: str | None) -> Problem | None:
    """The first problem of a text, or None if it is valid, empty, null or in another language."""
    check = CHECKS.get(language or "")
    if check is None or not text:
        return None
    try:
        check(text)
    except _Stop as stop:
        found = stop.problem
        line = text.rfind("\n", 0, found.at) + 1
        return Problem("merge conflict", line) if CONFLICT.match(text, line) else found
    return None


def problems(files: DataFrame, *keys: str, text: str = "text", language: str = "language") -> DataFrame:
    """keys, `language`, and of each file its first problem: `kind` (null if valid) and `at` (character).

    Files in other languages, and with null or empty text, are valid. Repeated files stay repeated.
    """
    source = files.select(*keys, F.col(language).alias("language"), F.when(F.col(language).isin(*CHECKS), F.col(text)).alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "__text") + ", kind string, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [problem(t, lang) for t, lang in zip(batch.column(len(keys) + 1).to_pylist(), batch.column(len(keys)).to_pylist(), strict=True)]
            kinds, places = pa.array([p and p.kind for p in found], pa.string()), pa.array([p and p.at for p in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], kinds, places], names=[*keys, "language", "kind", "at"])

    return source.mapInArrow(run, schema)
