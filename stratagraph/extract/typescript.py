"""TypeScript and JavaScript files to facts: declarations, imports, inheritance, types, calls and field accesses.

One pass over the tokens of a file, with a recursive reader for types. A module is `module:<path>`, a
symbol `module:<path>#<name>`, a member `..#<Class>.<name>`. Names are resolved inside the file only:
by its imports, its own declarations, and the types of variables and parameters; what an imported path
means is left to a join with the list of files (see producers).
"""

from __future__ import annotations

import posixpath

from stratagraph.extract.facts import Facts
from stratagraph.extract.lexer import Tokens, script

EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
SKIPPED = ("node_modules", "dist", "build", "out", ".next", ".turbo", ".cache", ".git", "coverage", ".vitest", "tmp")

# Fixed values of the language: types that aren't names, wrappers that contain, modifiers, words that aren't callees.
PREDEFINED = frozenset("any number boolean string symbol void unknown never object bigint undefined null true false this const".split())
WRAPPERS = {"Promise": "promise", "Array": "array", "ReadonlyArray": "array", "Set": "set", "ReadonlySet": "set", "Map": "map", "ReadonlyMap": "map", "Record": "record"}
KEYED = ("map", "record")
MODIFIERS = frozenset("public private protected static readonly abstract async override declare accessor get set export default".split())
NOT_CALLEES = frozenset("if for while switch catch function return typeof await yield void delete in of case throw new else do import with instanceof const let var".split())
CONTINUES = frozenset(". ?. ( [ ` , ; ) ] } ? : = => + - * / % & | ^ < > == != === !== <= && || ?? ** += -= *= /= %= &= |= ^= ** instanceof in as satisfies of extends implements { ...".split())
DECLARING = frozenset("function class interface type enum namespace module const let var".split())
ASSIGNS = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())


def module_name(path: str) -> str:
    return f"module:{path}"


class TypeScript:
    def __init__(self, path: str, source: str, facts: Facts):
        self.path, self.f = path, facts
        self.t: Tokens = script(source, not path.endswith((".ts", ".mts", ".cts")))
        self.module = module_name(path)
        self.named: dict[str, str] = {}
        self.defaults: dict[str, str] = {}
        self.spaces: dict[str, str] = {}
        self.locals: set[str] = set()
        self.variables: dict[str, str] = {}
        self.parameters: list[dict[str, str]] = []
        self.scopes: list[str] = []
        self.classes: list[str] = []
        self.seen: set[str] = set()
        self.lines = source.count("\n") + 1

    # Resolution

    def target(self, source: str) -> str:
        """The module that an import means; a path within the tree is marked, to be looked up."""
        if source.startswith(("./", "../")) or source in (".", ".."):
            return module_name(self.f.path_mark(posixpath.normpath(posixpath.join(posixpath.dirname(self.path), source))))
        if source.startswith("/"):
            return module_name(self.f.path_mark(source.lstrip("/")))
        return module_name(source)

    def resolve(self, name: str) -> tuple[str, str] | None:
        if name in self.named:
            return self.named[name], "named-import"
        if name in self.defaults:
            return self.defaults[name], "default-import"
        if name in self.locals:
            return f"{self.module}#{name}", "local"
        return None

    @property
    def caller(self) -> str:
        return self.scopes[-1] if self.scopes else self.module

    # The file

    def run(self) -> None:
        t = self.t
        self.f.symbol("module", self.module, self.path, 1, end_line=self.lines, line_count=self.lines)
        i, depth_end = 0, len(t)
        while i < depth_end:  # names that the top level declares, wherever they stand
            if (d := self.declares(i, True)) is not None:
                self.locals.add(d[1])
            i = t.match[i] + 1 if i in t.match and t.text[i] in "([{" else i + 1
        self.walk(0, len(t))

    def declares(self, i: int, top: bool = False) -> tuple[str, str] | None:
        """(kind, name) of the declaration whose own word is at i."""
        t = self.t
        word = t.text[i]
        if word not in DECLARING:
            return None
        before = t.at(i - 1)
        if t.kind[i] != "id" or before in (".", "?.") or t.at(i + 1) in (":", ",", ")", "=", "?", ".") and word not in ("const", "let", "var"):
            return None
        statement = before in ("", ";", "{", "}", "export", "default", "declare", "abstract", "async", ")", "else", "`end") or t.kind[i - 1] == "str" or t.line[i] > t.line[i - 1] and before not in CONTINUES - {"}", ")", "]"} or before == ":"
        if word in ("function", "class") and before in ("export", "default", "async", "abstract") and not (t.kind[i + 1] == "id" if i + 1 < len(t) else False) and (before == "default" or t.at(i - 2) == "default") and t.at(i + 1) in ("(", "{", "*", "<", "extends"):
            return word, "default"
        if not statement:
            return None
        if word == "function":
            k = i + 1 + (t.at(i + 1) == "*")
            return ("function", t.at(k)) if k < len(t) and t.kind[k] == "id" else None
        following = t.kind[i + 1] if i + 1 < len(t) else ""
        if word == "class" and following == "id":
            return "class", t.at(i + 1)
        if word == "interface" and following == "id" and (t.at(i + 2) in ("{", "<", "extends")):
            return "interface", t.at(i + 1)
        if word == "type" and following == "id" and t.at(i + 2) in ("=", "<") and t.line[i] == t.line[i + 1]:
            return "typedef", t.at(i + 1)
        if word == "enum" and following == "id" and t.at(i + 2) == "{":
            return "enum", t.at(i + 1)
        if word in ("namespace", "module") and following in ("id", "str") and t.line[i] == t.line[i + 1]:
            k = i + 2
            while t.at(k) == ".":
                k += 2
            return ("namespace", t.between(i + 1, k - 1)) if t.at(k) == "{" else None
        if word in ("const", "let", "var") and following == "id" and t.at(i + 1) != "enum":
            kind = self.variable(i + 1)
            return (kind, t.at(i + 1)) if kind else None
        return None

    def variable(self, i: int) -> str | None:
        """What a declarator whose name is at i declares: a function, a variable whose type is known, or nothing."""
        t, k = self.t, i + 1
        k += t.at(k) == "!"
        typed = t.at(k) == ":"
        if typed:
            k = self.type(k + 1)[1]
        if t.at(k) == "=":
            if self.function_at(k + 1) is not None:
                return "function"
            if not typed and (self.constructed(k + 1) or self.cast(k + 1) is not None):
                return "global_var"
        return "global_var" if typed else None

    def constructed(self, i: int) -> str | None:
        """The name of the class, if a value is nothing but new Name(..)."""
        t = self.t
        if t.at(i) != "new" or i + 1 >= len(t) or t.kind[i + 1] != "id":
            return None
        k = self.arguments_at(i + 2)
        k = t.match.get(k, k) + 1 if t.at(k) == "(" else k
        return t.text[i + 1] if self.ends(k) else None

    def cast(self, i: int) -> int | None:
        """Where the type begins, if a value ends with a cast to it."""
        end, k, found = self.expression_end(i), i, None
        while k < end:
            if self.t.text[k] == "as" and self.t.kind[k] == "id" and k > i and self.t.at(k + 1) not in (",", ")", ":", "="):
                found = k + 1
            k = self.t.match[k] + 1 if self.t.text[k] in "([{" and k in self.t.match else k + 1
        return found if found is not None and self.type(found)[1] >= end else None

    def ends(self, k: int) -> bool:
        """Whether an expression may end before k."""
        t = self.t
        return k >= len(t) or t.text[k] in (";", ",", ")", "]", "}") or t.line[k] > t.line[k - 1] and t.text[k] not in CONTINUES - {"{", "["}

    def expression_end(self, i: int) -> int:
        """Where the expression that begins at i ends."""
        t, k = self.t, i
        while k < len(t):
            text = t.text[k]
            if text in (";", ",", ")", "]", "}") and t.kind[k] == "punct":
                return k
            if k > i and t.line[k] > t.line[k - 1] and text not in CONTINUES - {"{", "["} and t.text[k - 1] not in CONTINUES - {")", "]", "}", "`"} and t.text[k - 1] not in ("return", "new", "await", "typeof", "!", "yield"):
                return k
            k = t.match[k] + 1 if text in "([{" and t.kind[k] == "punct" and k in t.match else k + 1
        return k

    def arguments_at(self, k: int) -> int:
        """Past type arguments that begin at k, if any do."""
        if self.t.at(k) != "<":
            return k
        depth, j = 0, k
        while j < len(self.t) and j < k + 200:
            x = self.t.text[j]
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif x in (";", ")", "}", "&&", "||") or x == "=" and self.t.kind[j] == "punct":
                return k
            elif x in "([{" and j in self.t.match:
                j = self.t.match[j]
            j += 1
        return k

    # Types

    def type(self, i: int) -> tuple[tuple, int]:
        """The type that begins at i and where it ends. A type is (kind, parts, first token, last token)."""
        return self._conditional(i)

    def _conditional(self, i: int) -> tuple[tuple, int]:
        node, k = self._union(i)
        if self.t.at(k) == "is" and self.t.line[k] == self.t.line[k - 1]:
            inner, k = self._conditional(k + 1)
            return ("group", [inner], i, k - 1), k
        if self.t.at(k) == "extends" and self.t.kind[k] == "id":
            parts = [node]
            x, k = self._union(k + 1)
            parts.append(x)
            for mark in ("?", ":"):
                if self.t.at(k) != mark:
                    break
                x, k = self._conditional(k + 1)
                parts.append(x)
            return ("group", parts, i, k - 1), k
        return node, k

    def _union(self, i: int, mark: str = "|", kind: str = "union") -> tuple[tuple, int]:
        t = self.t
        k = i + (t.at(i) == mark)
        parts = []
        while True:
            x, k = self._union(k, "&", "intersection") if mark == "|" else self._postfix(k)
            parts.append(x)
            if t.at(k) != mark:
                break
            k += 1
        return (parts[0], k) if len(parts) == 1 else ((kind, parts, i, k - 1), k)

    def _postfix(self, i: int) -> tuple[tuple, int]:
        t = self.t
        if t.at(i) in ("keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract") and i + 1 < len(t) and (t.kind[i + 1] in ("id", "str") or t.text[i + 1] in "([{<") and t.at(i + 1) not in ("is",):
            prefix = t.at(i)
            node, k = self._postfix(i + 1)
            if prefix == "typeof":  # names values
                return ("group", [], i, k - 1), k
            return ("group", [node], i, k - 1) if prefix != "readonly" else node, k
        node, k = self._primary(i)
        while t.at(k) == "[" and k < len(t) and t.line[k] == t.line[k - 1]:
            if t.at(k + 1) == "]":
                node, k = ("array", [node], i, k + 1), k + 2
            else:
                inner, _ = self.type(k + 1)
                close = t.match.get(k, k + 1)
                node, k = ("group", [node, inner], i, close), close + 1
        return node, k

    def _primary(self, i: int) -> tuple[tuple, int]:
        t = self.t
        if i >= len(t):
            return ("none", [], i, i), i
        text, kind = t.text[i], t.kind[i]
        if text == "<" or text == "(":
            k = self.arguments_at(i) if text == "<" else i
            if t.at(k) != "(":
                return ("none", [], i, i), max(k, i + 1)
            close = t.match.get(k, k)
            parts = self._members(k + 1, close) if t.at(close + 1) == "=>" else None
            if parts is not None:
                x, end = self.type(close + 2)
                return ("group", [*parts, x], i, end - 1), end
            inner, _ = self.type(k + 1)
            return ("group", [inner], i, close), close + 1
        if text == "{":
            close = t.match.get(i, i)
            return ("group", self._members(i + 1, close), i, close), close + 1
        if text == "[":
            close, parts, k = t.match.get(i, i), [], i + 1
            while k < close:
                k += t.at(k) == "..."
                if t.kind[k] == "id" and t.at(k + 1) in (":", "?") and t.at(k + 2 - (t.at(k + 1) == ":")) == ":":
                    k += 2 + (t.at(k + 1) == "?")
                x, k = self.type(k)
                parts.append(x)
                k += t.at(k) == "?"
                k = k + 1 if t.at(k) == "," else close
            return ("group", parts, i, close), close + 1
        if text == "`":
            k = i + 1
            while k < len(t) and t.text[k] != "`end":
                k += 1
            return ("none", [], i, k), k + 1
        if kind in ("str", "num"):
            return ("none", [], i, i), i + 1
        if text == "-":
            return ("none", [], i, i + 1), i + 2
        if kind != "id":
            return ("none", [], i, i), i
        if text in ("null", "undefined"):
            return ("null", [], i, i), i + 1
        k = i
        while t.at(k + 1) == "." and k + 2 < len(t) and t.kind[k + 2] == "id":
            k += 2
        name = ("none", [], i, i) if text in PREDEFINED and k == i else ("name", [], k, k)
        if t.at(k + 1) == "<" and (end := self.arguments_at(k + 1)) > k + 1:
            parts, j = [], k + 2
            while j < end - 1:
                x, after = self.type(j)
                parts.append(x)
                j = max(after, j + 1) + (t.at(max(after, j + 1)) == ",")
                if t.at(after) not in (",", ">"):
                    break
            return ("generic", [name, *parts], i, end - 1), end
        return name, k + 1

    def _members(self, i: int, end: int) -> list[tuple]:
        """The types in parameters or in the members of an object type: what follows colons, and in parameter lists."""
        t, k, out = self.t, i, []
        while k < end:
            if t.text[k] == ":" or t.text[k] in ("extends", "in") and t.kind[k] == "id":
                x, after = self.type(k + 1)
                out.append(x)
                k = max(after, k + 1)
            elif t.text[k] in "({[" and k in t.match:
                out += self._members(k + 1, t.match[k])
                k = t.match[k] + 1
            else:
                k += 1
        return out

    def names(self, node: tuple) -> list[int]:
        """The tokens of all type names in it, in order."""
        kind, parts, first, _ = node
        return ([first] if kind == "name" else []) + [k for p in parts for k in self.names(p)]

    def refer(self, source: str, nodes: list[tuple], line: int | None = None, confidence: float = 0.95, skip: set[str] = frozenset(), seen: set[str] | None = None, **tags) -> None:
        seen = set() if seen is None else seen
        for node in nodes:
            for k in self.names(node):
                name = self.t.text[k]
                if name in skip or name in seen or (found := self.resolve(name)) is None:
                    continue
                seen.add(name)
                self.f.edge("references_type", source, found[0], confidence, self.path, self.t.line[node[2]] if line is None else line, resolution_kind=found[1], **tags)

    def contained(self, node: tuple, chain: tuple[str, ...] = ()) -> list[tuple[str, str, str, str | None]]:
        """(target, resolution, containment, key type) of every type that a field holds."""
        t = self.t
        kind, parts, first, _ = node
        if kind == "name":
            found = self.resolve(t.text[first])
            return [(found[0], found[1], ".".join(chain) or "direct", None)] if found else []
        if kind == "array":
            return self.contained(parts[0], (*chain, "array"))
        if kind == "generic":
            wrapper = WRAPPERS.get(t.text[parts[0][2]]) if parts[0][2] == first else None
            if wrapper in KEYED:
                if len(parts) < 3:
                    return []
                key = t.between(parts[1][2], parts[1][3])
                return [(a, b, c, key) for a, b, c, _ in self.contained(parts[2], (*chain, wrapper))]
            return [x for p in (parts[1:] if wrapper else parts) for x in self.contained(p, (*chain, wrapper) if wrapper else chain)]
        if kind == "union":
            real = [p for p in parts if p[0] != "null"]
            step = "optional" if len(real) == 1 and len(real) < len(parts) else "union"
            return [x for p in real for x in self.contained(p, (*chain, step))]
        step = (*chain, "intersection") if kind == "intersection" else chain
        return [x for p in parts for x in self.contained(p, step)]

    # Functions

    def function_at(self, i: int) -> tuple[int, int, int] | None:
        """(parameters, body, end) of a function or arrow function that begins at i: places of "(" or the single name, of the body, and past it."""
        t = self.t
        if i < len(t.kind) and t.kind[i] == "id" and t.text[i] not in ("async", "function") and t.at(i + 1) != "=>":
            return None
        k = i + (t.at(i) == "async" and t.at(i + 1) not in ("=>", ",", ")") and i + 1 < len(t) and t.line[i] == t.line[i + 1])
        if t.at(k) == "function":
            k += 1 + (t.at(k + 1) == "*")
            k += k < len(t) and t.kind[k] == "id"
            k = self.arguments_at(k)
            if t.at(k) != "(" or k not in t.match:
                return None
            body = t.match[k] + 1
            if t.at(body) == ":":
                body = self.type(body + 1)[1]
            return (k, body, t.match[body] + 1) if t.at(body) == "{" and body in t.match else None
        if k < len(t) and t.kind[k] == "id" and t.at(k + 1) == "=>":
            return k, k + 2, self._body_end(k + 2)
        k = self.arguments_at(k)
        if t.at(k) != "(" or k not in t.match:
            return None
        after = t.match[k] + 1
        if t.at(after) == ":":
            after = self.type(after + 1)[1]
        return (k, after + 1, self._body_end(after + 1)) if t.at(after) == "=>" else None

    def _body_end(self, body: int) -> int:
        return self.t.match[body] + 1 if self.t.at(body) == "{" and body in self.t.match else self.expression_end(body)

    def parameter_list(self, i: int) -> list[tuple[str | None, tuple | None, int, int]]:
        """(name, type, default's begin, end) of the parameters in the brackets at i."""
        t, out = self.t, []
        if t.at(i) != "(":
            return [(t.at(i), None, i, i)]
        k, close = i + 1, t.match[i]
        while k < close:
            begin = k
            while t.at(k) == "@":
                k += 2
                k = t.match[k] + 1 if t.at(k) == "(" and k in t.match else k
            while t.at(k) in MODIFIERS and t.kind[k + 1] == "id":
                k += 1
            rest = t.at(k) == "..."
            k += rest
            name = t.text[k] if t.kind[k] == "id" and not rest else None
            k = t.match[k] + 1 if t.text[k] in "{[" and k in t.match else k + 1
            k += t.at(k) == "?"
            node = None
            if t.at(k) == ":":
                node, k = self.type(k + 1)
            value = k + 1 if t.at(k) == "=" else k
            if t.at(k) == "=":
                k = self.expression_end(k + 1)
            out.append((name, node, value, k))
            while k < close and t.text[k] != ",":
                k = t.match[k] + 1 if t.text[k] in "([{" and k in t.match else k + 1
            k = max(k, begin) + 1
        return out

    def function(self, parameters: int, body: int, end: int, scope: str | None) -> None:
        """Walks a function's defaults and body, in a scope of its own if it has a name."""
        listed = self.parameter_list(parameters)
        frame = {}
        for name, node, _, _ in listed:
            if name and node and (names := self.names(node)) and (found := self.resolve(self.t.text[names[0]])):
                frame[name] = found[0]
        self.parameters.append(frame)
        if scope:
            self.scopes.append(scope)
        for _, _, value, after in listed:
            self.walk(value, after)
        if self.t.at(body) == "{" and body in self.t.match:
            self.walk(body + 1, self.t.match[body])
        else:
            self.walk(body, end)
        if scope:
            self.scopes.pop()
        self.parameters.pop()

    def signature(self, name: str, generics: int, parameters: int, returns: tuple | None) -> None:
        """References from a function's parameter and return types, and from what its generics extend."""
        nodes = [node for _, node, _, _ in self.parameter_list(parameters) if node] + ([returns] if returns else [])
        self.refer(name, nodes)
        self.constraints(name, generics)

    def constraints(self, name: str, i: int) -> set[str]:
        """References from the constraints of generics at i; the generics' names."""
        t = self.t
        end = self.arguments_at(i)
        if end == i:
            return set()
        own, found, k = set(), [], i + 1
        while k < end - 1:
            k += t.at(k) in ("const", "in", "out") and t.kind[k + 1] == "id"
            own.add(t.text[k])
            k += 1
            if t.at(k) == "extends":
                node, k = self.type(k + 1)
                found.append(node)
            if t.at(k) == "=":
                k = self.type(k + 1)[1]
            k += 1
        self.refer(name, found, skip=own, generic_constraint=True)
        return own

    # Statements

    def walk(self, i: int, end: int) -> None:
        t = self.t
        while i < end:
            i = max(self.one(i, end), i + 1)

    def one(self, i: int, end: int) -> int:
        """Reads what begins at i; where to go on."""
        t = self.t
        text, kind = t.text[i], t.kind[i]
        if kind == "tag":
            self.component(i)
            return i + 1
        if kind == "id":
            if text == "import" and t.at(i + 1) not in ("(", ".") and t.at(i - 1) != ".":
                return self.imported(i)
            if text == "export" and t.at(i - 1) != ".":
                return self.exported(i)
            if t.at(i - 1) not in (".", "?.") and (declared := self.declares(i)) is not None:
                return self.declaration(i, *declared)
            if text in ("const", "let", "var") and t.at(i - 1) not in (".", "?."):
                return self.declarators(i + 1)
            if text == "class" and t.at(i - 1) not in (".", "?."):  # a class as a value has no name of its own
                k = i + 1
                while k < end and t.text[k] != "{":
                    k += 1
                return k
            if text in ("as", "satisfies") and i and (t.kind[i - 1] in ("id", "num", "str") or t.text[i - 1] in (")", "]", "}")) and t.at(i - 1) not in ("return", "case") and t.line[i] == t.line[i - 1]:
                return self.type(i + 1)[1]
            if text == "new" and i + 1 < len(t) and t.kind[i + 1] == "id" and t.at(i + 2) not in (".", "?."):
                self.constructs(i)
                return self.arguments_at(i + 2)
            if text == "this":
                self.access(i)
        found = self.function_at(i) if kind == "id" or text in "(<" else None
        if found is not None and (text != "(" or t.at(i - 1) not in (")", "]") and (t.kind[i - 1] != "id" if i else True) or t.at(i - 1) in NOT_CALLEES or t.at(found[1] - 1) == "=>"):
            self.function(*found, self.pair(i))
            return found[2]
        if kind == "id" and t.at(i - 1) in ("{", ",", "async", "get", "set", "*") and text not in NOT_CALLEES and (method := self.object_method(i)) is not None:
            return method
        if text == "(" and kind == "punct":
            self.call(i)
        elif text == "`" and i and (t.kind[i - 1] == "id" and t.text[i - 1] not in NOT_CALLEES or t.text[i - 1] in (")", "]")):
            self.call(i, template=True)
        return i + 1

    def object_method(self, i: int) -> int | None:
        """A method of an object that begins at i; where it ends."""
        t = self.t
        k = self.arguments_at(i + 1)
        if t.at(k) != "(" or k not in t.match:
            return None
        body, returns = t.match[k] + 1, None
        if t.at(body) == ":":
            returns, body = self.type(body + 1)
        if t.at(body) != "{" or body not in t.match or t.at(i - 1) == "*" and t.at(i - 2) not in ("{", ",", "async"):
            return None
        owner = self.classes[-1] if self.classes else None
        name = t.text[i]
        if full := self.symbol("method", name, i, t.match[body], False, None, owner):
            self.signature(full, i + 1, k, returns)
        self.function(k, body, t.match[body] + 1, f"{self.module}#{owner}.{name}" if owner else f"{self.module}#{name}")
        return t.match[body] + 1

    def pair(self, i: int) -> str | None:
        """The scope of a function that is the value of an object's key."""
        t = self.t
        if t.at(i - 1) == ":" and i >= 3 and t.kind[i - 2] in ("id", "str", "num") and t.at(i - 3) in ("{", ","):
            return f"{self.module}#{t.text[i - 2]}"
        return None

    def imported(self, i: int) -> int:
        t, k = self.t, i + 1
        kind_only = t.at(k) == "type" and t.at(k + 1) not in (",", "from")
        k += kind_only
        if k < len(t) and t.kind[k] == "str":
            self.f.edge("imports", self.module, self.target(t.text[k].strip("'\"")), 1.0, self.path, t.line[i])
            return k + 1
        begin = k
        while k < len(t) and t.kind[k] != "str" and t.text[k] != ";":
            k += 1
        if k >= len(t) or t.kind[k] != "str":
            return k
        target = self.target(t.text[k].strip("'\""))
        self.f.edge("imports", self.module, target, 1.0, self.path, t.line[i], **({"import_type": True} if kind_only else {}))
        j = begin
        while j < k and t.text[j] != "from":
            if t.text[j] == "*" and t.at(j + 1) == "as":
                self.spaces[t.at(j + 2)] = target
                j += 3
            elif t.text[j] == "{":
                close = t.match.get(j, k)
                j += 1
                while j < close:
                    j += t.text[j] == "type" and t.at(j + 1) not in (",", "}", "as")
                    name = t.text[j]
                    alias = t.at(j + 2) if t.at(j + 1) == "as" else name
                    self.named[alias] = f"{target}#{name}"
                    j += 3 if t.at(j + 1) == "as" else 1
                    j += t.at(j) == ","
                j = close + 1
            else:
                if t.kind[j] == "id":
                    self.defaults[t.text[j]] = target
                j += 1
        return k + 1

    def exported(self, i: int) -> int:
        t, k = self.t, i + 1
        k += t.at(k) == "type" and t.at(k + 1) in ("{", "*")
        if t.at(k) == "*" or t.at(k) == "{":
            k = t.match.get(k, k) + 1 if t.at(k) == "{" else k + 1 + 2 * (t.at(k + 1) == "as")
            if t.at(k) == "from" and k + 1 < len(t) and t.kind[k + 1] == "str":
                self.f.edge("imports", self.module, self.target(t.text[k + 1].strip("'\"")), 1.0, self.path, t.line[i], re_export=True)
                return k + 2
            return k
        if t.at(k) == "default" and (found := self.function_at(k + 1)) is not None and t.at(found[1] - 1) == "=>":
            self.symbol("function", "default", k + 1, found[2] - 1, True)
            self.function(*found, None)
            return found[2]
        return k + (t.at(k) == "default")

    def symbol(self, kind: str, name: str, first: int, last: int, exported: bool, doc: str | None = None, owner: str | None = None) -> str | None:
        """The symbol and the edge from what contains it; its full name, or None if it is known already."""
        t = self.t
        local = f"{owner}.{name}" if owner else name
        full = f"{self.module}#{local}"
        if full in self.seen:
            return None
        self.seen.add(full)
        line, end = t.line[first], t.line[min(last, len(t) - 1)]
        self.f.symbol(kind, full, self.path, line, end_line=end, line_count=end - line + 1, exported=True if exported else None, doc=doc, owning_class=owner)
        self.f.edge("contains", f"{self.module}#{owner}" if owner else self.module, full, 1.0, self.path, line)
        return full

    def outset(self, i: int) -> tuple[int, bool, str | None]:
        """The first token of the declaration at i, whether it is exported, and its documentation at the top level."""
        t, k = self.t, i
        while t.at(k - 1) in ("async", "abstract", "declare", "const") and t.at(i) != t.at(k - 1):
            k -= 1
        exported = t.at(k - 1) == "export" or t.at(k - 1) == "default" and t.at(k - 2) == "export"
        head = k - (2 if t.at(k - 1) == "default" else 1) if exported else k
        doc = t.doc.get(head) if not self.scopes and not self.classes else None
        return k, exported, doc

    def declaration(self, i: int, kind: str, name: str) -> int:
        t = self.t
        first, exported, doc = self.outset(i)
        if kind == "function" and t.text[i] in ("const", "let", "var") or kind == "global_var":
            return self.declarators(i + 1, (kind, first, exported, doc))
        if kind == "function":
            self.locals.add(name)
            k = i + 1 + (t.at(i + 1) == "*")
            k += k < len(t) and t.kind[k] == "id"
            generics = k
            k = self.arguments_at(k)
            if t.at(k) != "(" or k not in t.match:
                return k
            body, returns = t.match[k] + 1, None
            if t.at(body) == ":":
                returns, body = self.type(body + 1)
            end = t.match[body] if t.at(body) == "{" and body in t.match else None
            if end is None:  # an overload or a declaration without a body
                return body
            if full := self.symbol("function", name, first, end, exported, doc):
                self.signature(full, generics, k, returns)
            self.function(k, body, end + 1, f"{self.module}#{name}" if name != "default" else None)
            return end + 1
        if kind in ("class", "interface"):
            return self.type_body(i, kind, name, first, exported, doc)
        if kind == "typedef":
            self.locals.add(name)
            k = self.arguments_at(i + 2)
            node, end = self.type(k + 1)
            if full := self.symbol("typedef", name, first, end - 1, exported, doc):
                own = self.constraints(full, i + 2)
                self.refer(full, [node], skip=own | {name}, alias_ref=True)
            return end
        k = i + 1
        while k < len(t) and t.text[k] != "{":
            k += 1
        close = t.match.get(k, len(t) - 1)
        self.locals.add(name)
        full = self.symbol(kind, name, first, close, exported, doc)
        if kind == "enum":
            if full:
                self.variants(name, full, k + 1, close)
            return close + 1
        return k + 1  # what is in a namespace is read like the rest

    def variants(self, name: str, full: str, i: int, close: int) -> None:
        t = self.t
        while i < close:
            if t.kind[i] == "id":
                own = f"{full}.{t.text[i]}"
                if own not in self.seen:
                    self.seen.add(own)
                    value = t.between(i + 2, self.expression_end(i + 2) - 1) if t.at(i + 1) == "=" else None
                    self.f.symbol("enum_variant", own, self.path, t.line[i], owning_class=name, value=value)
                    self.f.edge("contains", full, own, 1.0, self.path, t.line[i])
            while i < close and t.text[i] != ",":
                i = t.match[i] + 1 if t.text[i] in "([{" and i in t.match else i + 1
            i += 1

    def declarators(self, i: int, declared: tuple | None = None) -> int:
        """The declarators from i on; the first may declare a symbol (kind, first token, exported, doc)."""
        t = self.t
        while i < len(t):
            name = t.text[i] if t.kind[i] == "id" else None
            k = t.match[i] + 1 if t.text[i] in "{[" and i in t.match else i + 1
            k += t.at(k) == "!"
            node = None
            if t.at(k) == ":":
                node, k = self.type(k + 1)
            value = k + 1 if t.at(k) == "=" else None
            end = self.expression_end(value) if value is not None else k
            found = self.function_at(value) if value is not None else None
            if found is not None:
                end = max(end, found[2])
            if declared and name:
                kind, first, exported, doc = declared
                self.locals.add(name)
                if full := self.symbol(kind, name, first, max(end - 1, i), exported, doc):
                    self.typed(full, name, node, value, t.line[first])
                    if kind == "function" and found is not None:
                        pass
                declared = None
            if found is not None:
                self.function(*found, f"{self.module}#{name}" if name else None)
                self.walk(found[2], end)
            elif value is not None:
                self.walk(value, end)
            if t.at(end) != ",":
                return end
            i = end + 1
        return i

    def typed(self, full: str, name: str, node: tuple | None, value: int | None, line: int) -> None:
        """What a variable's type is: annotated, or that of the object that it is made with or cast to."""
        t = self.t
        if node is not None:
            if (names := self.names(node)) and (found := self.resolve(t.text[names[0]])):
                self.variables[name] = found[0]
            if value is None or self.function_at(value) is None:
                self.refer(full, [node])
            return
        if value is None:
            return
        via, at = "inferred_from_new", None
        if self.constructed(value):
            at = value + 1
        elif (cast := self.cast(value)) is not None and (names := self.names(self.type(cast)[0])):
            via, at = "inferred_from_cast", names[0]
        if at is not None and (found := self.resolve(t.text[at])):
            self.variables[name] = found[0]
            self.f.edge("references_type", full, found[0], 0.9, self.path, t.line[value], resolution_kind=found[1], **{via: True})

    def heritage(self, i: int, full: str) -> int:
        """Inheritance clauses from i up to the body, where that begins."""
        t, seen, kind = self.t, set(), None
        line = t.line[i]
        while i < len(t) and t.text[i] != "{":
            if t.text[i] in ("extends", "implements"):
                kind = t.text[i]
            elif t.kind[i] == "id" and kind and t.text[i] not in PREDEFINED and (kind, t.text[i]) not in seen and t.at(i - 1) != ".":
                seen.add((kind, t.text[i]))
                found = self.resolve(t.text[i])
                self.f.edge(kind, full, found[0] if found else t.text[i], 1.0 if found else 0.7, self.path, line, resolution_kind=found[1] if found else None)
            elif t.text[i] == "(" and i in t.match:
                i = t.match[i]
            i += 1
        return i

    def type_body(self, i: int, kind: str, name: str, first: int, exported: bool, doc: str | None) -> int:
        t = self.t
        self.locals.add(name)
        generics = i + 1 + (t.at(i + 1) == name)
        k = self.arguments_at(generics)
        open_ = k
        while open_ < len(t) and t.text[open_] != "{":
            open_ = t.match[open_] + 1 if t.text[open_] == "(" and open_ in t.match else open_ + 1
        close = t.match.get(open_, len(t) - 1)
        full = self.symbol(kind, name, first, close, exported, doc)
        if full:
            self.heritage(k, full)
            self.constraints(full, generics)
        members = list(self.members(open_ + 1, close))
        if full:
            self.fields(kind, name, full, t.line[first], members)
        self.classes.append(name)
        if kind == "class":
            for m in members:
                self.member(name, m)
        self.classes.pop()
        return close + 1

    def members(self, i: int, close: int):
        """The members of a class or interface: (what, name token, first, generics, parameters, type, value or body, end)."""
        t = self.t
        while i < close:
            if t.text[i] in (";", ","):
                i += 1
                continue
            first = i
            while t.at(i) == "@":  # decorators
                i += 2
                while t.at(i) == ".":
                    i += 2
                i = t.match[i] + 1 if t.at(i) == "(" and i in t.match else i
            while t.text[i] in MODIFIERS and t.at(i + 1) not in ("(", ":", "=", ";", "?", "!", "<", ",", "}") and i + 1 < close:
                i += 1
            i += t.at(i) == "*"
            if t.text[i] == "{" and i in t.match:  # a static block
                yield "block", i, first, i, i, None, i, t.match[i] + 1
                i = t.match[i] + 1
                continue
            named = t.kind[i] == "id"
            at = i
            i = t.match[i] + 1 if t.text[i] == "[" and i in t.match else i + 1
            i += t.at(i) in ("?", "!")
            generics = i
            k = self.arguments_at(i)
            if t.at(k) == "(" and k in t.match:
                body, returns = t.match[k] + 1, None
                if t.at(body) == ":":
                    returns, body = self.type(body + 1)
                if t.at(body) == "{" and body in t.match:
                    yield "method", at, first, generics, k, returns, body, t.match[body] + 1
                    i = t.match[body] + 1
                else:
                    yield "signature", at, first, generics, k, returns, None, body
                    i = body
                continue
            node, value = None, None
            if t.at(k) == ":":
                node, k = self.type(k + 1)
            if t.at(k) == "=":
                value = k + 1
                k = self.expression_end(value)
                if (f := self.function_at(value)) is not None:
                    k = max(k, f[2])
            yield "field" if named else "other", at, first, generics, None, node, value, k
            i = max(k, at + 1)

    def fields(self, kind: str, name: str, full: str, line: int, members: list) -> None:
        """Field symbols, what they hold, and what the type refers to and aggregates by them."""
        t, seen, targets = self.t, set(), []
        for what, at, first, generics, parameters, node, _, end in members:
            if what == "field" and node is not None or what == "other" and node is not None and kind == "class":
                self.refer(full, [node], seen=seen, field_ref=True)
            elif what == "signature" and kind == "interface":
                nodes = [n for _, n, _, _ in self.parameter_list(parameters) if n] + ([node] if node else [])
                self.refer(full, nodes, line=t.line[first], seen=seen, field_ref=True)
        for what, at, first, _, _, node, _, _ in members:
            if what != "field":
                continue
            own = f"{full}.{t.text[at]}"
            if own in self.seen or t.text[at].startswith("#"):
                continue
            self.seen.add(own)
            self.f.symbol("field", own, self.path, t.line[first], owning_class=name, declared_on=kind)
            self.f.edge("contains", full, own, 1.0, self.path, t.line[first])
            if node is None:
                continue
            held = set()
            for target, how, containment, key in self.contained(node):
                if (target, containment) in held:
                    continue
                held.add((target, containment))
                self.f.edge("field_of_type", own, target, 0.95, self.path, t.line[first], resolution_kind=how, containment=containment, type_expr=t.between(node[2], node[3]), key_type=key)
                if target not in targets:
                    targets.append(target)
        for target in targets:
            self.f.edge("aggregates", full, target, 0.95, self.path, line, rolled_up_from="field_of_type")

    def member(self, owner: str, m: tuple) -> None:
        t = self.t
        what, at, first, generics, parameters, node, value, end = m
        if what == "block":
            self.walk(at + 1, end - 1)
        elif what == "method":
            name = t.between(at, t.match[at]) if t.text[at] == "[" and at in t.match else t.text[at]
            if full := self.symbol("method", name, first, end - 1, False, None, owner):
                self.signature(full, generics, parameters, node)
            self.function(parameters, value, end, f"{self.module}#{owner}.{name}")
        elif value is not None:
            if (f := self.function_at(value)) is not None:
                self.function(*f, None)
            else:
                self.walk(value, end)

    # Uses

    def constructs(self, i: int) -> None:
        t = self.t
        name = t.text[i + 1]
        found = self.resolve(name)
        self.f.edge("calls", self.caller, found[0] if found else name, 0.95 if found else 0.7, self.path, t.line[i], evidence=True, resolution_kind="constructor")

    def component(self, i: int) -> None:
        t = self.t
        tag = t.text[i]
        component = lambda x: x[:1].isupper() and x[:1].isascii() or x[:1] in ("_", "$")
        props, spread = t.props.get(i, ([], False))
        tags = {"jsx_tag": tag, "props": [p for p in props if ":" not in p] or None, "has_spread": spread or None}
        if "." in tag:
            head, _, last = tag.rpartition(".")
            if "." in head:
                self.f.edge("calls", self.caller, last, 0.7, self.path, t.line[i], evidence=True, resolution_kind="jsx-namespace-component", **tags)
            elif component(last) or component(head):
                found = self.resolve(head)
                self.f.edge("calls", self.caller, f"{found[0] if found else head}.{last}", 0.95 if found else 0.7, self.path, t.line[i], evidence=True, resolution_kind="jsx-namespace-component", **tags)
        elif component(tag):
            found = self.resolve(tag)
            self.f.edge("calls", self.caller, found[0] if found else tag, 0.95 if found else 0.7, self.path, t.line[i], evidence=True, resolution_kind="jsx-component", **tags)

    def access(self, i: int) -> None:
        """this.field, as a read or a write of a field that the class declares."""
        t = self.t
        if not (self.classes and self.scopes and t.at(i + 1) in (".", "?.") and i + 2 < len(t) and t.kind[i + 2] == "id") or t.at(i - 1) in (".", "?."):
            return
        field = f"{self.module}#{self.classes[-1]}.{t.text[i + 2]}"
        after = self.arguments_at(i + 3)
        if field not in self.seen or t.at(after) == "(" and t.at(i + 3) in ("(", "<") or t.at(i + 3) == "?." and t.at(i + 4) == "(":
            return
        write = t.at(i + 3) in ASSIGNS or t.at(i + 3) in ("++", "--") and t.line[i + 3] == t.line[i + 2] or t.at(i - 1) in ("++", "--", "delete") and t.at(i + 3) not in (".", "[", "?.")
        self.f.edge("writes_field" if write else "reads_field", self.caller, field, 0.95, self.path, t.line[i], via="this")

    def callee_begin(self, k: int) -> int:
        """The first token of the expression whose last one is k."""
        t = self.t
        while True:
            if t.text[k] in (")", "]") and k in t.match:
                k = t.match[k]
                if t.kind[k - 1] == "id" and t.text[k - 1] not in NOT_CALLEES or t.at(k - 1) in (")", "]"):
                    k -= 1
                    continue
            if t.at(k - 1) in (".", "?.") and k >= 2:
                k -= 2
                continue
            return k

    def call(self, i: int, template: bool = False) -> None:
        t = self.t
        last = i - 1
        if t.at(last) == "?.":
            last -= 1
        if t.at(last) == ">":
            depth, k = 0, last
            while k > max(0, last - 200):
                if t.text[k] == ">":
                    depth += 1
                elif t.text[k] == "<":
                    depth -= 1
                    if not depth:
                        break
                elif t.text[k] in (";", "{", "}", "&&", "||", "="):
                    return
                k -= 1
            if depth or self.arguments_at(k) != i:
                return
            last = k - 1
        if last < 0 or t.kind[last] not in ("id", "punct"):
            return
        text = t.text[last]
        if t.kind[last] == "punct" and text not in (")", "]"):
            return
        begin = self.callee_begin(last)
        if t.kind[last] == "id" and t.at(last - 1) not in (".", "?."):
            if text in NOT_CALLEES - {"import"} or t.at(last - 1) in ("function", "new", "*") and t.at(last - 2) == "function":
                return
        if t.at(begin - 1) == "new":
            return
        name, resolved, kind = self.callee(begin, last)
        if name is None:
            return
        before = t.at(begin - 1)
        tags = {"tagged_template": template or None, "awaited": before == "await" or None, "yielded": before == "yield" or before == "*" and t.at(begin - 2) == "yield" or None, "delegated": before == "*" and t.at(begin - 2) == "yield" or None}
        self.f.edge("calls", self.caller, name, 0.95 if resolved else 0.7, self.path, t.line[begin], evidence=True, resolution_kind=kind, **tags)

    def callee(self, begin: int, last: int) -> tuple[str | None, bool, str]:
        t = self.t
        name = t.text[last]
        if begin == last and t.kind[last] == "id":
            if name in ("super", "import"):
                return name, False, "raw"
            found = self.resolve(name)
            return (found[0], True, found[1]) if found else (name, False, "bare")
        if t.kind[last] == "id" and t.at(last - 1) in (".", "?."):
            if begin == last - 2:
                owner = t.text[begin]
                if owner == "this" and self.classes:
                    return f"{self.module}#{self.classes[-1]}.{name}", True, "this-method"
                if t.kind[begin] == "id" and owner not in ("this", "super"):
                    for frame in reversed(self.parameters):
                        if owner in frame:
                            return f"{frame[owner]}.{name}", True, "param-member"
                    for table, kind, mark in ((self.variables, "var-member", "."), (self.spaces, "namespace-member", "#"), (self.named, "named-member", ".")):
                        if owner in table:
                            return f"{table[owner]}{mark}{name}", True, kind
                    if owner in self.locals:
                        return f"{self.module}#{owner}.{name}", True, "local-member"
            parts = t.text[begin : last + 1 : 2]
            plain = all(x in (".", "?.") for x in t.text[begin + 1 : last : 2]) and all(k == "id" for k in t.kind[begin : last + 1 : 2])
            return (".".join(parts) if plain else name), False, "member"
        text = t.between(begin, last)
        return (text, False, "raw") if len(text) < 200 else (None, False, "raw")


def extract(path: str, source: str, facts: Facts) -> None:
    TypeScript(path, source, facts).run()
