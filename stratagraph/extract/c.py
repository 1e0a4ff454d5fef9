"""C files to facts, a file at a time: symbols, containment, includes, and what needs the names of other files as candidates.

Calls, callbacks and type references mean something only if their target is a known function or type
of the workspace. What the file itself defines is known at its end; other such edges say so in `needs`
(functions or types), and producers.py joins them with the names. A callback's arguments and the words of
a field's type are candidates in order, of which the first known one counts.
"""

from __future__ import annotations

import re

from stratagraph.extract import packs
from stratagraph.extract.facts import Facts
from stratagraph.extract.lexer import Tokens, c

EXTENSIONS = (".c", ".h", ".cc", ".cpp", ".hpp")

# Fixed values of the language: words that aren't names, and types that aren't either.
KEYWORDS = frozenset("if for while switch return sizeof do else case goto break continue default typeof __typeof__ _Alignof alignof __attribute__ defined asm __asm__".split())
NOT_TYPES = frozenset("int char short long unsigned signed float double void const volatile static extern inline struct union enum typedef register restrict _Bool bool".split())
_ENDS, _HEADS, _STORAGE = frozenset(";{}="), frozenset(("struct", "union", "enum")), frozenset(("static", "const", "volatile", "extern", "register"))
#: Tokens of a body at which something may begin or end, be assigned, called or accessed.
_STOPS, _USES = frozenset(";{}="), frozenset(("(", ".", "->"))
_SYSCALL = re.compile(r"^\s*SYSCALL_DEFINE(\d)\s*\(\s*([a-zA-Z_]\w*)")
_INCLUDE = re.compile(r"\s*#\s*include\s*[<\"]([^>\"]+)[>\"]")
_SUBSYSTEM = re.compile(r"^([A-Z][A-Z0-9_]{1,8})\s*:")
#: The chain of a system call, for workspaces whose templates have module_init.
SYSCALL_CHAIN = ("userspace_syscall", "syscall_dispatch", "sys_call_table", "__do_sys_%NAME%")


class C:
    def __init__(self, path: str, source: str, facts: Facts, logs: dict, registrations: dict, syscalls: bool):
        self.path, self.source, self.f = path, source, facts
        self.logs, self.registrations, self.syscalls = logs, registrations, syscalls
        self.t: Tokens = c(source)
        self.function: str | None = None
        self.symbols: list[tuple[str, int]] = []
        #: Names that this file defines, and edges whose targets must be known: (group or None, place in it, set of names, arguments of the edge).
        self.known: dict[str, set[str]] = {"functions": set(), "types": set()}
        self.pending: list[tuple[tuple | None, int, str, tuple, dict]] = []
        #: Types of variables, for callbacks that are assigned to their fields.
        self.variables: dict[str, str] = {}

    def run(self) -> None:
        t, i = self.t, 0
        while i < len(t):
            i = max(self.top(i), i + 1)
        for name, line in self.symbols:
            self.f.edge("contains", self.path, name, 1.0, self.path, line, evidence=True)
        for k in [k for k, kind in enumerate(t.kind) if kind == "pre"]:
            text = t.text[k]
            if m := _INCLUDE.match(text):
                self.f.edge("imports", self.path, m[1], 1.0, self.path, t.line[k] + text[: m.end()].count("\n"), evidence=True)
        if "SYSCALL_DEFINE" in self.source:
            self.system_calls()
        self.settle()

    def needs(self, names: str, kind: str, src: str, dst: str, confidence: float, line: int, group: tuple | None = None, place: int = 0, **tags) -> None:
        """An edge whose target must be one of the known functions or types; of a group the first such one counts."""
        if dst[:1].isalpha() or dst[:1] == "_":  # others are no names
            self.pending.append((group, place, names, (kind, src, dst, confidence, self.path, line), tags))

    def settle(self) -> None:
        """Edges to known names, and those that other files must decide."""
        groups: dict[tuple, list[tuple]] = {}
        seen: set[tuple] = set()
        for p in self.pending:
            group, _, names, edge, tags = p
            if names == "types":  # a type is named once for each function, field or struct
                if edge[:3] in seen:
                    continue
                seen.add(edge[:3])
            if group is None:
                self.f.edge(*edge, evidence=True, needs=None if edge[2] in self.known[names] else names, **tags)
            else:
                groups.setdefault((edge[0], edge[1], *group), []).append(p)
        for found in groups.values():
            found.sort(key=lambda p: p[1])
            own = next((k for k, (_, _, names, edge, _) in enumerate(found) if edge[2] in self.known[names]), len(found))
            for k, (_, _, names, edge, tags) in enumerate(found[: own + 1]):
                self.f.edge(*edge, evidence=True, needs=None if own == 0 else names, rank=k if own and len(found) > 1 else None, **tags)

    def symbol(self, kind: str, name: str, line: int, end: int | None = None) -> None:
        self.symbols.append((name, line))
        if kind != "union":
            self.known["functions" if kind == "function" else "types"].add(name)
        self.f.symbol(kind, name, self.path, line, end_line=end, line_count=None if end is None else end - line + 1)
        if kind in ("struct", "enum", "typedef"):
            self.f.type(kind, name)

    def top(self, i: int) -> int:
        """One declaration or definition at the top level; where it ends."""
        t = self.t
        texts, kinds, match, n = t.text, t.kind, t.match, len(t.text)
        if kinds[i] == "pre" or texts[i] == ";":
            return i + 1
        first, k, typedef = i, i, texts[i] == "typedef"
        brackets = None
        while k < n and (text := texts[k]) not in _ENDS and kinds[k] != "pre":
            if text == "(" and k in match:
                if brackets is None and kinds[k - 1] == "id" and texts[k - 1] not in KEYWORDS:
                    brackets = k
                k = match[k]
            k += 1
        if k >= n or texts[k] == "}" or kinds[k] == "pre":
            return k + 1
        heads = [j for j in range(first, k) if texts[j] in _HEADS]
        if t.text[k] == "{" and brackets is not None and t.text[k - 1] == ")":
            close = t.match.get(k, len(t) - 1)
            name = t.text[brackets - 1]
            self.symbol("function", name, t.line[first], t.line[close])
            self.signature(name, first, k, brackets)
            self.function = name
            self.body(k + 1, close)
            self.function = None
            return close + 1
        if t.text[k] == "{":
            close = t.match.get(k, len(t) - 1)
            if heads:
                word, named = t.text[heads[-1]], heads[-1] + 1
                while named < k and t.text[named] in ("__attribute__", "("):
                    named = t.match.get(named, named) + 1
                if named < k and t.kind[named] == "id":
                    self.symbol(word, t.text[named], t.line[first], t.line[close])
                    if word == "struct":
                        self.fields(t.text[named], k + 1, close, t.line[heads[-1]])
            elif t.at(first) == "extern":  # extern "C" { .. }
                return k + 1
            k = close + 1
            name = None
            while k < len(t) and t.text[k] not in (";", "=") and t.text[k] != "{":
                if t.kind[k] == "id" and t.text[k] != "__attribute__":
                    name = k
                k = t.match[k] + 1 if t.text[k] in "([" and k in t.match else k + 1
            if typedef and name is not None:
                self.symbol("typedef", t.text[name], t.line[name])
            elif t.at(k) == "=":
                return self.initializer(first, k, name)
            return k + 1
        if typedef:
            name = k - 1
            pointer = next((j for j in range(first, k) if t.text[j] == "(" and t.at(j + 1) == "*" and j in t.match), None)
            if pointer is not None:
                name = next((j for j in range(pointer, t.match[pointer]) if t.kind[j] == "id"), name)
            while name > first and t.kind[name] != "id":
                name = t.match[name] - 1 if t.text[name] == "]" and name in t.match else name - 1
            if t.kind[name] == "id":
                self.symbol("typedef", t.text[name], t.line[name])
            return k + 1
        if t.text[k] == "=":
            name = k - 1
            while name > first and t.kind[name] != "id":
                name = t.match[name] - 1 if t.text[name] in ("]", ")") and name in t.match else name - 1
            return self.initializer(first, k, name)
        self.variable(first, k)
        if brackets is not None and brackets == first + 1:  # a macro that registers something, like module_init(f)
            self.call(brackets)
        return k + 1

    def variable(self, first: int, end: int) -> None:
        """Remembers the type of a declared variable."""
        t = self.t
        names = [j for j, kind in enumerate(t.kind[first:end], first) if kind == "id" and t.text[j] not in _STORAGE]
        if len(names) >= 2 and "(" not in t.text[first:end]:
            self.variables[t.text[names[-1]]] = t.between(first, names[-2])

    def initializer(self, first: int, k: int, name: int | None) -> int:
        """The value of a variable that is declared at first: callbacks in its fields."""
        t = self.t
        if name is not None:
            self.variable(first, name + 1)
        end = k + 1
        while end < len(t) and t.text[end] != ";":
            end = t.match[end] + 1 if t.text[end] in "({[" and end in t.match else end + 1
        head = [j for j in range(first, name if name is not None else k) if t.kind[j] == "id"]
        kind = t.between(head[0], head[-1]) if head else None
        self.values(k + 1, end, t.text[name] if name is not None else "(struct_init)", kind)
        self.expressions(k + 1, end)
        return end + 1

    def values(self, i: int, end: int, owner: str, kind: str | None) -> None:
        """.field = name, as a registration of name if that is a function."""
        t = self.t
        for k, text in enumerate(t.text[i : max(i, end - 3)], i):
            if text == "." and t.kind[k + 1] == "id" and t.text[k + 2] == "=" and t.text[k - 1] in ("{", ",") and t.kind[k + 3] == "id" and t.at(k + 4) in (",", "}"):
                field = t.text[k + 1]
                self.registers(owner, [t.text[k + 3]], f"struct_field:{kind or 'unknown'}.{field}", field, t.line[k], kind)

    def registers(self, registrar: str, callbacks: list[str], kind: str, key: str, line: int, struct: str | None = None) -> None:
        for place, name in enumerate(callbacks):
            self.needs("functions", "registers_callback", registrar, name, 0.9, line, (line, kind), place, registration_kind=kind, dispatch_key=key, struct_type=struct, argument=place)

    def signature(self, name: str, first: int, end: int, brackets: int) -> None:
        t = self.t
        parameters = t.match.get(brackets, end)
        words = dict.fromkeys(t.text[j] for j in range(first, end) if t.kind[j] == "id" and j != brackets - 1 and t.text[j] not in NOT_TYPES)
        for word in words:
            self.needs("types", "references_type", name, word, 0.85, t.line[first])
        begin = brackets + 1
        for j in range(brackets + 1, parameters + 1):
            if j == parameters or t.text[j] == ",":
                self.variable(begin, j)
                begin = j + 1

    def fields(self, struct: str, i: int, close: int, line: int) -> None:
        """A struct's members that are of named types."""
        t = self.t
        while i < close:
            end, inner = i, None
            while end < close and t.text[end] != ";":
                if t.text[end] == "{" and end in t.match:
                    inner = end
                end = t.match[end] + 1 if t.text[end] in "({[" and end in t.match else end + 1
            if inner is not None:
                self.fields(struct, inner + 1, t.match[inner], line)
            else:
                ids = [j for j in range(i, end) if t.kind[j] == "id"]
                pointer = next((j for j in range(i, end) if t.text[j] == "(" and t.at(j + 1) == "*"), None)
                named = next((j for j in ids if pointer is not None and j > pointer), None) if pointer is not None else next((j for j in reversed(ids) if t.at(j + 1) in (";", ",", "[", ":") or j + 1 == end), None)
                if named is not None:
                    own = f"{struct}.{t.text[named]}"
                    for j in ids:
                        if j < named and t.text[j] not in NOT_TYPES:
                            self.needs("types", "field_of_type", own, t.text[j], 0.85, t.line[i], (), containment="direct")
                            self.needs("types", "aggregates", struct, t.text[j], 0.85, line)
            i = end + 1

    def body(self, i: int, close: int) -> None:
        """Statements: variables that are declared, callbacks that are assigned, and expressions."""
        t, begin = self.t, i
        for k, text in enumerate(t.text[i:close], i):
            if text not in _STOPS:
                continue
            if text != "=":
                begin = k + 1
            else:
                names = [j for j in range(begin, k) if t.kind[j] == "id"]
                if len(names) >= 2 and not any(t.text[j] in (".", "->", "(", "[") for j in range(begin, k)):
                    self.variable(begin, k)
                if t.at(k + 1) == "{" and k + 1 in t.match:
                    self.values(k + 1, t.match[k + 1], t.text[names[-1]] if names else "(struct_init)", t.between(names[0], names[-2]) if len(names) >= 2 else None)
                if k + 2 < close and t.kind[k + 1] == "id" and t.text[k + 2] in (";", ",", ")") and t.kind[k - 1] == "id" and t.text[k - 2] in (".", "->"):
                    base = self.expression(k - 3)
                    owner = t.between(base, k - 3)[:60]
                    field = t.text[k - 1]
                    root = re.split(r"->|\.", owner)[0].strip()
                    self.registers(f"{owner}.{field}", [t.text[k + 1]], f"fn_body_assign:{owner}.{field}", field, t.line[base], self.variables.get(root))
        self.expressions(i, close)

    def expression(self, k: int) -> int:
        """The first token of the operand whose last one is k."""
        t = self.t
        while True:
            if t.text[k] in (")", "]") and k in t.match:
                k = t.match[k]
                if t.kind[k - 1] == "id" and t.text[k - 1] not in KEYWORDS or t.at(k - 1) in (")", "]"):
                    k -= 1
                    continue
            if t.at(k - 1) in (".", "->") and k >= 2:
                k -= 2
                continue
            return k

    def expressions(self, i: int, end: int) -> None:
        t = self.t
        for k, text in enumerate(t.text[i:end], i):
            if text not in _USES:
                continue
            if text == "(":
                self.call(k)
            elif k + 1 < end and t.kind[k + 1] == "id" and (t.kind[k - 1] == "id" or t.text[k - 1] in (")", "]")):
                base = self.expression(k - 1)
                owner, field = t.between(base, k - 1)[:60], t.text[k + 1]
                written = t.at(k + 2) in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=")
                path = f"{owner}.{field}"
                self.f.edge("writes_field" if written else "reads_field", self.function or "(file-scope)", path, 0.85, self.path, t.line[base], evidence=True, access_path=path)

    def call(self, k: int) -> None:
        t = self.t
        if k == 0 or t.kind[k - 1] != "id" or t.text[k - 1] in KEYWORDS:
            return
        name = t.text[k - 1]
        member = t.at(k - 2) in (".", "->")
        line = t.line[self.expression(k - 1)]
        arguments = self.arguments(k)
        if name in self.logs:
            level, place, subsystem = self.logs[name]
            template = re.sub(r"^(['\"])(.*)\1$", r"\2", arguments[place], flags=re.S)[:200] if place < len(arguments) else name
            if not subsystem and (m := _SUBSYSTEM.match(template)):
                subsystem = m[1]
            self.f.edge("logs_event", self.function or "(file-scope)", f"log:{name}:{line}", 0.9, self.path, line, evidence=True, log_level=level, template=template, subsystem=subsystem, macro=name)
        if member:
            return
        if name in self.registrations:
            place = self.registrations[name]
            self.registers(name, [a for a in arguments], "function_call", arguments[place] if place < len(arguments) else "", line)
        if self.function:
            self.needs("functions", "calls", self.function, name, 1.0, line)

    def arguments(self, k: int) -> list[str]:
        t, out, begin = self.t, [], k + 1
        close = t.match.get(k, k)
        j = k + 1
        while j <= close:
            if j == close or t.text[j] == ",":
                if j > begin:
                    out.append(t.between(begin, j - 1))
                begin = j + 1
            j = t.match[j] + 1 if j < close and t.text[j] in "({[" and j in t.match else j + 1
        return out

    def system_calls(self) -> None:
        for n, line in enumerate(self.source.split("\n"), 1):
            if m := _SYSCALL.match(line):
                count, name = m[1], m[2]
                own = f"__do_sys_{name}"
                self.known["functions"].add(own)
                self.f.symbol("function", own, self.path, n, qualified_name=f"SYSCALL_DEFINE{count}({name})")
                self.f.edge("registers_callback", "syscall_table", own, 0.95, self.path, n, evidence=True, registration_kind="syscall_define_macro", dispatch_key=name)
                if self.syscalls:
                    self.f.edge("runtime_calls", "syscall_dispatch", own, 0.9, self.path, n, evidence=True, dispatch_chain=[s.replace("%NAME%", name) for s in SYSCALL_CHAIN], registration_api=f"SYSCALL_DEFINE{count}", dispatch_key=name, trigger_kind="event")


def extract(path: str, source: str, facts: Facts, log_macros=packs.LOG_MACROS, registrations=None, syscalls: bool = True) -> None:
    logs = {name: (level, place, subsystem) for name, level, place, subsystem in log_macros}
    C(path, source, facts, logs, packs.REGISTRATIONS if registrations is None else registrations, syscalls).run()
