"""Tokens of C-like languages, with the partner of every bracket, comments before a token, and JSX elements as tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import accumulate, compress
from operator import add, itemgetter

#: Words after which a slash or an angle bracket begins something, instead of continuing an expression.
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else await yield default extends".split())
_OPEN, _BRACKETS = {"(": ")", "[": "]", "{": "}"}, frozenset("()[]{}")


@dataclass
class Tokens:
    """Parallel lists of kinds (id, num, str, char, punct, tag, life, macro), texts, lines and offsets."""

    kind: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    match: dict[int, int] = field(default_factory=dict)
    #: The documentation comment that stands before a token.
    doc: dict[int, str] = field(default_factory=dict)
    #: Attribute names of a JSX tag, and whether it has spread ones.
    props: dict[int, tuple[list[str], bool]] = field(default_factory=dict)
    source: str = ""

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def between(self, i: int, j: int) -> str:
        """The source from token i to token j, which is the last."""
        return self.source[self.start[i] : self.end[j]]


_TS = re.compile(
    r"(?P<space>\s+)|(?P<doc>/\*\*(?!/).*?(?:\*/|\Z))|(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<id>#?[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\.?\d[\w.]*)"
    r"|(?P<str>'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?)|(?P<punct>\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|<<|[-+*/%&|^]=|[^\w\s])",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TAG = re.compile(r"<([A-Za-z_$][\w$.:-]*)?")
_GENERIC = re.compile(r"<\s*(?:const\s+)?\w+\s*(?:,|extends\b|=)")
_ATTRIBUTE = re.compile(r"\s*([A-Za-z_$][\w$:-]*)\s*(=)?\s*")


def _pair(t: Tokens, stack: list[int], k: int, text: str) -> None:
    """Takes note of a bracket, and of the partner of one that closes."""
    if text in _OPEN:
        stack.append(k)
        return
    while stack:
        o = stack.pop()
        if _OPEN[t.text[o]] == text:
            t.match[o], t.match[k] = k, o
            break


class _Script:
    def __init__(self, source: str, jsx: bool):
        self.t = Tokens(source=source)
        self.jsx = jsx
        self._line, self._at = 1, 0
        self._stack: list[int] = []
        self._doc: str | None = None

    def put(self, kind: str, start: int, end: int, text: str | None = None) -> int:
        t = self.t
        self._line += t.source.count("\n", self._at, start)
        self._at = start
        k = len(t.text)
        text = t.source[start:end] if text is None else text
        t.kind.append(kind)
        t.text.append(text)
        t.line.append(self._line)
        t.start.append(start)
        t.end.append(end)
        if self._doc is not None:
            t.doc[k] = self._doc
            self._doc = None
        if kind == "punct" and text in _BRACKETS:
            _pair(t, self._stack, k, text)
        return k

    def operand(self) -> bool:
        """Whether what comes next begins an operand."""
        t = self.t
        if not t.text:
            return True
        kind, text = t.kind[-1], t.text[-1]
        if kind == "id":
            return text in _BEFORE_OPERAND
        if kind in ("num", "str", "tag"):
            return False
        return text not in (")", "]", "}", "`", "++", "--")

    def code(self, at: int, inside: bool = False) -> int:
        """Lexes until the end, or, inside braces, until the one that closes them; where that is."""
        t, source, depth = self.t, self.t.source, 0
        kinds, texts, lines, starts, ends, match, length = t.kind, t.text, t.line, t.start, t.end, _TS.match, len(source)
        while at < length:
            c = source[at]
            if c == "`":
                at = self.template(at)
                continue
            if c == "/" and source[at + 1 : at + 2] not in ("/", "*") and self.operand() and (m := _REGEX.match(source, at)):
                self.put("str", at, m.end())
                at = m.end()
                continue
            if c == "<" and self.jsx and self.operand() and re.match(r"<[A-Za-z_$>]", source[at : at + 2]) and not _GENERIC.match(source, at):
                at = self.element(at)
                continue
            m = match(source, at)
            kind, end = m.lastgroup, m.end()
            if kind == "doc":
                self._doc = m[0]
            elif kind != "space" and kind != "note":
                if inside and kind == "punct":
                    if c == "{":
                        depth += 1
                    elif c == "}":
                        if not depth:
                            return at
                        depth -= 1
                # as put() does
                self._line = line = self._line + source.count("\n", self._at, at)
                self._at = at
                text = m[0]
                if self._doc is not None:
                    t.doc[len(texts)] = self._doc
                    self._doc = None
                kinds.append(kind)
                texts.append(text)
                lines.append(line)
                starts.append(at)
                ends.append(end)
                if kind == "punct" and text in _BRACKETS:
                    _pair(t, self._stack, len(texts) - 1, text)
            at = end
        return at

    def braces(self, at: int) -> int:
        """Code in braces that begin here; where they end."""
        self.put("punct", at, at + 1)
        at = self.code(at + 1, True)
        if at < len(self.t.source):
            self.put("punct", at, at + 1)
        return at + 1

    def template(self, at: int) -> int:
        source = self.t.source
        self.put("punct", at, at + 1, "`")
        at += 1
        while at < len(source):
            if source[at] == "\\":
                at += 2
            elif source[at] == "`":
                break
            elif source.startswith("${", at):
                at = self.braces(at + 1)
            else:
                at += 1
        self.put("str", at, min(at + 1, len(source)), "`end")
        return at + 1

    def element(self, at: int) -> int:
        """A JSX element: its tag as a token, then the code in its attributes and children."""
        source = self.t.source
        m = _TAG.match(source, at)
        k = self.put("tag", at, m.end(), m[1] or "")
        props: list[str] = []
        spread = False
        at = m.end()
        while at < len(source):
            if source[at].isspace():
                at += 1
            elif source.startswith("/>", at):
                self.t.props[k] = (props, spread)
                return at + 2
            elif source[at] == ">":
                at += 1
                break
            elif source[at] == "{":
                spread |= source[at + 1 :].lstrip().startswith("...") if source[at + 1 : at + 40].strip() else False
                at = self.braces(at)
            elif m := _ATTRIBUTE.match(source, at):
                props.append(m[1])
                at = m.end()
                if m[2] and at < len(source):
                    if source[at] in "'\"":
                        end = source.find(source[at], at + 1)
                        at = len(source) if end < 0 else end + 1
                    elif source[at] == "{":
                        at = self.braces(at)
                    elif source[at] == "<":
                        at = self.element(at)
            else:
                at += 1
        self.t.props[k] = (props, spread)
        while at < len(source):
            if source.startswith("</", at):
                end = source.find(">", at)
                return len(source) if end < 0 else end + 1
            if source[at] == "<":
                at = self.element(at)
            elif source[at] == "{":
                at = self.braces(at)
            else:
                following = [x for x in (source.find("<", at), source.find("{", at)) if x >= 0]
                at = min(following, default=len(source))
        return at


def script(source: str, jsx: bool) -> Tokens:
    """Tokens of TypeScript or JavaScript."""
    s = _Script(source, jsx)
    s.code(0)
    return s.t


# C and Rust: every piece is a token with the white space after it, so that one call finds them all and places are sums of lengths.
_C = re.compile(
    r"[A-Za-z_][A-Za-z_0-9]*\w*\s*|[(){}\[\],;:?~]\s*|(?:->|\.\.\.|<<=|==|!=|<=|&&|\|\||\+\+|--|<<|[-+*%&|^]=|\.?\d[\w.]*|//(?:[^\n\\]++|\\.)*|/\*.*?(?:\*/|\Z)|/=|(?:(?<=\n)|\A)#(?:[^\n\\]++|\\.)*"
    r"|\"(?:[^\"\\\n]++|\\.)*\"?|'(?:[^'\\\n]++|\\.)*'?|\\\n|[^\W\d]\w*|[^\w\s])\s*|\s+",
    re.S,
)
_RUST = re.compile(
    r"([ac-qs-zA-Z_][A-Za-z_0-9]*\w*\s*|[(){}\[\],;?~@]\s*|(?:b?r(#*)\".*?\"\2|b?\"(?:[^\"\\]++|\\.)*\"?|b?'(?:[^'\\\n]|\\[^\n]+?)'|'\w+|(?:r#)?[^\W\d]\w*|::|->|=>|\.\.=|\.\.\.|\.\.|==|!=|<=|&&|\|\||<<=|[-+*%&|^]="
    r"|\d[\w]*(?:\.\d\w*)?|//[^\n]*|/\*.*?(?:\*/|\Z)|/=|[^\w\s])\s*|\s+)",
    re.S,
)
#: What may end in white space of its own.
_C_LONG = re.compile(r"#(?:[^\n\\]|\\.)*|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)
_RUST_LONG = re.compile(r"b?r(#*)\".*?\"\1|b?\"(?:[^\"\\]|\\.)*\"?|//[^\n]*", re.S)
_first = itemgetter(0)
_QUOTE = re.compile("[\"']")

#: Kinds by first character; others need a look.
_KINDS = dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_", "id") | dict.fromkeys("0123456789", "num") | dict.fromkeys("!$%&()*+,-:;<=>?@[]^`{|}~", "punct")
_C_KINDS = _KINDS
_RUST_KINDS = {x: kind for x, kind in _KINDS.items() if x not in "br"} | dict.fromkeys("#.\\", "punct")


def _other(x: str) -> str:
    """The kind of a name, a number or a sign by its first character; none of white space."""
    return "" if x.isspace() else "num" if x.isdecimal() else "id" if x.isalnum() or x == "_" else "punct"


def _c_kind(piece: str, text: str) -> tuple[str, str]:
    """Kind and text of a piece whose first character doesn't tell; none of comments and white space."""
    x = piece[0]
    if x == ".":
        return "num" if piece[1:2].isdecimal() else "punct", text
    if x == "/":
        return "" if piece[1:2] in ("/", "*") else "punct", text
    if x == "\\":
        return "" if piece[1:2] == "\n" else "punct", text
    if x in "\"'":
        return "str" if x == '"' else "char", text if len(text) == len(piece) else _C_LONG.match(piece)[0]
    return _other(x), text


def _rust_kind(piece: str, text: str) -> tuple[str, str]:
    x = piece[0]
    if x == "/":
        if piece[1:2] not in ("/", "*"):
            return "punct", text
        return ("doc", _RUST_LONG.match(piece)[0]) if text.startswith("///") and text[3:4] != "/" else ("", text)
    if x == "'":
        return "punct" if len(text) == 1 else "char" if text[-1] == "'" else "life", text
    if x in 'br"':
        if text.isidentifier():
            return "id", text
        m = _QUOTE.search(text)
        if m is None:
            return "id", text
        if m[0] == "'":
            return "char", text
        return "str", text if len(text) == len(piece) else _RUST_LONG.match(piece)[0]
    return _other(x), text


def _plain(source: str, pieces: list[str], known: dict[str, str], look) -> Tokens:
    t = Tokens(source=source)
    texts = list(map(str.rstrip, pieces))
    kinds = list(map(known.get, map(_first, pieces)))
    starts = list(accumulate(map(len, pieces), initial=0))
    lines = list(accumulate([p.count("\n") if "\n" in p else 0 for p in pieces], initial=1))
    if None in kinds:
        for k in [k for k, kind in enumerate(kinds) if kind is None]:
            if pieces[k][0] == "#":  # of C: a line of the preprocessor, if it begins one
                at = starts[k]
                kinds[k], texts[k] = ("pre", _C_LONG.match(pieces[k])[0]) if not at or source[at - 1] == "\n" else ("punct", texts[k])
            else:
                kinds[k], texts[k] = look(pieces[k], texts[k])
        if "" in kinds or "doc" in kinds:
            doc, n = None, 0
            for kind, text in zip(kinds, texts):
                if kind == "doc":
                    doc = text if doc is None else f"{doc}\n{text}"
                elif kind:
                    if doc is not None:
                        t.doc[n] = doc
                        doc = None
                    n += 1
            kept = [kind not in ("", "doc") for kind in kinds]
            texts, kinds, starts, lines = (list(compress(x, kept)) for x in (texts, kinds, starts, lines))
    n = len(texts)
    del starts[n:], lines[n:]
    t.kind, t.text, t.line, t.start = kinds, texts, lines, starts
    t.end = list(map(add, starts, map(len, texts)))
    t.at = lambda i: texts[i] if 0 <= i < n else ""  # as the method does, which looks more up
    stack: list[int] = []
    match = t.match
    for k in [k for k, text in enumerate(texts) if text in _BRACKETS]:
        text = texts[k]
        if text in _OPEN:
            stack.append(k)
        elif stack and _OPEN[texts[stack[-1]]] == text:
            o = stack.pop()
            match[o], match[k] = k, o
        else:
            _pair(t, stack, k, text)
    return t


def c(source: str) -> Tokens:
    """Tokens of C; a preprocessor line is one of kind pre."""
    return _plain(source, _C.findall(source), _C_KINDS, _c_kind)


def rust(source: str) -> Tokens:
    return _plain(source, list(map(_first, _RUST.findall(source))), _RUST_KINDS, _rust_kind)
