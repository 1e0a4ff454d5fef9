"""Rust files to facts: items, uses, impls, types, calls and accesses to fields of self."""

from __future__ import annotations

from stratagraph.extract.facts import Facts
from stratagraph.extract.lexer import Tokens, rust

EXTENSIONS = (".rs",)

# Fixed values of the language: types that aren't names, and what wrappers are called.
PRIMITIVE = frozenset("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())
WRAPPERS = {
    "Vec": "vec", "Box": "box", "Rc": "rc", "Arc": "arc", "Option": "option", "Result": "result", "HashMap": "map", "BTreeMap": "map", "HashSet": "set", "BTreeSet": "set",
    "Cell": "cell", "RefCell": "cell", "Mutex": "cell", "RwLock": "cell",
}
ITEMS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "interface", "type": "typedef", "mod": "namespace", "const": "global_var", "static": "global_var"}
_OPEN, _CLOSE, _ENDS = frozenset("([{"), frozenset(";)]}"), frozenset("{;")
QUALIFIERS = frozenset("pub async unsafe const extern default".split())
NOT_CALLEES = frozenset("if while for match loop return in as let mut ref move fn struct enum impl trait use pub where else break continue unsafe async await dyn box".split())
#: Names that begin a type but aren't the path of one.
_TYPE_STARTS = frozenset(("dyn", "impl", "for", "fn", "unsafe", "extern"))
#: What a token must be to mean something by itself.
_STARTS = frozenset(ITEMS) | {"#", "(", "use", "impl", "macro_rules", "self"}
NOT_TYPES = frozenset("self Self mut dyn impl const for where crate super as in fn extern unsafe".split())


class Rust:
    def __init__(self, path: str, source: str, facts: Facts):
        self.path, self.f = path, facts
        self.t: Tokens = rust(source)
        self.module = f"module:{path}"
        self.named: dict[str, str] = {}
        self.locals: set[str] = set()
        self.impls: list[tuple[str, str | None]] = []
        self.scopes: list[tuple[str, str | None]] = []
        self.seen: set[str] = set()
        self.lines = source.count("\n") + 1

    def resolve(self, name: str) -> tuple[str, str] | None:
        if name in self.named:
            return self.named[name], "named-import"
        if name in self.locals:
            return f"{self.module}#{name}", "local"
        return None

    def run(self) -> None:
        self.f.symbol("module", self.module, self.path, 1, end_line=self.lines, line_count=self.lines)
        t, i = self.t, 0
        texts, match, n = t.text, t.match, len(t.text)
        while i < n:
            text = texts[i]
            if text in ITEMS and (item := self.item(i)) is not None:
                self.locals.add(item[1])
            i = match[i] + 1 if text in _OPEN and i in match else i + 1
        self.walk(0, n)

    def item(self, i: int) -> tuple[str, str] | None:
        """(kind, name) of an item whose keyword is at i."""
        t = self.t
        word = t.text[i]
        if word not in ITEMS or t.kind[i] != "id" or i + 1 >= len(t.text):
            return None
        k = i + 1 + (word == "static" and t.at(i + 1) == "mut")
        if t.kind[k] != "id" or t.at(i - 1) in (".", "::", "*", "&", "<", ",") or word == "const" and (t.at(k) in ITEMS or t.at(k) in ("unsafe", "async", "extern")) or word in ("const", "static") and t.at(k + 1) != ":":
            return None
        if word == "type" and t.at(k + 1) not in ("=", "<", ";", ":") or word == "mod" and t.at(k + 1) not in ("{", ";") or word == "fn" and t.at(k + 1) not in ("(", "<"):
            return None
        return ITEMS[word], t.text[k].removeprefix("r#")

    def first_of(self, i: int) -> tuple[int, bool]:
        """Where the item begins whose keyword is at i, and whether it has a visibility."""
        t, k, visible = self.t, i, False
        while k > 0:
            if t.text[k - 1] in QUALIFIERS or t.kind[k - 1] == "str" and t.at(k - 2) == "extern":
                k -= 1
                visible |= t.text[k] == "pub"
            elif t.text[k - 1] == ")" and t.at(t.match.get(k - 1, 0) - 1) == "pub":
                k = t.match[k - 1] - 1
                visible = True
            else:
                break
        return k, visible

    def angle(self, i: int) -> int:
        """Past the angle brackets that begin at i, if any do."""
        t = self.t
        if t.at(i) != "<":
            return i
        depth, k, texts, match, n = 0, i, t.text, t.match, len(t.text)
        while k < n:
            text = texts[k]
            if text == "<":
                depth += 1
            elif text == ">" and t.at(k - 1) != "-":
                depth -= 1
                if not depth:
                    return k + 1
            elif text in _OPEN and k in match:
                k = match[k]
            elif text in _CLOSE:
                return i
            k += 1
        return i

    # Types

    def type(self, i: int, end: int) -> tuple[tuple, int]:
        """The type at i and where it ends: (kind, parts, first, last)."""
        t = self.t
        if i >= end:
            return ("none", [], i, i), i
        text = t.text[i]
        if text not in _TYPE_STARTS and t.kind[i] == "id":
            return self.path_type(i, i, end)
        if text in ("&", "&&", "*"):
            k = i + 1
            k += t.at(k) in ("const",) and text == "*"
            while k < end and t.kind[k] == "life":
                k += 1
            mutable = t.at(k) == "mut"
            inner, after = self.type(k + mutable, end)
            kind = ("ptr" if text == "*" else "ref") + ("_mut" if mutable else "")
            node = ("wrap:" + kind, [inner], i, after - 1)
            return (("wrap:ref", [node], i, after - 1) if text == "&&" else node), after
        if text == "[" and i in t.match:
            inner, _ = self.type(i + 1, t.match[i])
            return ("wrap:array", [inner], i, t.match[i]), t.match[i] + 1
        if text == "(" and i in t.match:
            return ("wrap:tuple", self.listed(i + 1, t.match[i]), i, t.match[i]), t.match[i] + 1
        if text in ("dyn", "impl"):
            parts, k = [], i + 1
            while True:
                if k < end and t.kind[k] == "life":
                    k += 1
                else:
                    k += t.at(k) == "?"
                    x, k = self.type(k, end)
                    parts.append(x)
                if t.at(k) != "+":
                    break
                k += 1
            return ("wrap:dyn_trait" if text == "dyn" else "group", parts, i, k - 1), k
        if text == "for":
            return self.type(self.angle(i + 1), end)
        if text in ("fn", "unsafe", "extern"):
            k = i
            while k < end and t.text[k] != "(":
                k += 1
            parts = self.listed(k + 1, t.match.get(k, k))
            k = t.match.get(k, k) + 1
            if t.at(k) == "->":
                x, k = self.type(k + 1, end)
                parts.append(x)
            return ("group", parts, i, k - 1), k
        if text == "<":  # <T as Trait>::Name
            k = self.angle(i)
            inner, _ = self.type(i + 1, k - 1)
            while t.at(k) == "::" and k + 1 < end:
                k += 2
            return ("name", [], k - 1, k - 1), k
        if t.kind[i] != "id" and text != "::":
            return ("none", [], i, i), i + 1
        return self.path_type(i, i + (text == "::"), end)

    def path_type(self, i: int, k: int, end: int) -> tuple[tuple, int]:
        """The type at i whose first name is at k."""
        t = self.t
        while t.at(k + 1) == "::" and k + 2 < end and t.kind[k + 2] == "id":
            k += 2
        text = t.text[k]
        name = ("name", [], k, k) if text not in PRIMITIVE and text not in NOT_TYPES else ("none", [], k, k)
        k += 1
        after = t.at(k)
        if after == "::" and t.at(k + 1) == "<":
            k += 1
            after = "<"
        if after == "<" and (after := self.angle(k)) > k:
            return ("generic", [name, *self.listed(k + 1, after - 1)], i, after - 1), after
        if t.at(k) == "(" and text in ("Fn", "FnMut", "FnOnce") and k in t.match:
            parts, j = self.listed(k + 1, t.match[k]), t.match[k] + 1
            if t.at(j) == "->":
                x, j = self.type(j + 1, end)
                parts.append(x)
            return ("group", [name, *parts], i, j - 1), j
        return name, k

    def listed(self, i: int, end: int) -> list[tuple]:
        """Types by commas."""
        t, out = self.t, []
        while i < end:
            if t.kind[i] == "life" or t.text[i] in (",", "+", "#"):
                i = t.match[i + 1] + 1 if t.text[i] == "#" and i + 1 in t.match else i + 1
                continue
            if t.text[i] == "pub":
                i += 1
                i = t.match[i] + 1 if t.at(i) == "(" and i in t.match else i
                continue
            if t.kind[i] == "id" and t.at(i + 1) == "=":  # Item = T
                i += 2
                continue
            x, after = self.type(i, end)
            out.append(x)
            i = max(after, i + 1)
            while i < end and t.text[i] not in (",", "+"):
                i += 1
        return out

    def names(self, node: tuple) -> list[str]:
        kind, parts, first, _ = node
        return ([self.t.text[first]] if kind == "name" else []) + [n for p in parts for n in self.names(p)]

    def contained(self, node: tuple, chain: tuple[str, ...] = ()) -> list[tuple[str, str, str, str | None]]:
        """(target, resolution, containment, key type) of every type that a field holds."""
        t = self.t
        kind, parts, first, _ = node
        if kind == "name":
            found = self.resolve(t.text[first])
            return [(*found, ".".join(chain) or "direct", None)] if found else []
        if kind.startswith("wrap:"):
            return [x for p in parts for x in self.contained(p, (*chain, kind[5:]))]
        if kind == "generic":
            wrapper = WRAPPERS.get(t.text[parts[0][2]])
            if wrapper == "map":
                key = t.between(parts[1][2], parts[1][3]) if len(parts) > 1 else None
                return [(a, b, c, key) for p in parts[2:3] for a, b, c, _ in self.contained(p, (*chain, wrapper))]
            return [x for p in (parts[1:] if wrapper else parts) for x in self.contained(p, (*chain, wrapper) if wrapper else chain)]
        return [x for p in parts for x in self.contained(p, chain)]

    def refer(self, source: str, names: list[str], line: int, seen: set[str], **tags) -> None:
        for name in names:
            if name not in seen and (found := self.resolve(name)):
                seen.add(name)
                self.f.edge("references_type", source, found[0], 0.95, self.path, line, resolution_kind=found[1], **tags)

    def holds(self, own: str, nodes: list[tuple], line: int, targets: list[str]) -> None:
        for node in nodes:
            held = set()
            for target, how, containment, key in self.contained(node):
                if (target, containment) not in held:
                    held.add((target, containment))
                    self.f.edge("field_of_type", own, target, 0.95, self.path, line, resolution_kind=how, containment=containment, type_expr=self.t.between(node[2], node[3]), key_type=key)
                    if target not in targets:
                        targets.append(target)

    # Items

    def walk(self, i: int, end: int) -> None:
        texts = self.t.text
        while i < end:
            i = max(self.one(i), i + 1) if texts[i] in _STARTS else i + 1

    def one(self, i: int) -> int:
        t = self.t
        text = t.text[i]
        if text == "#" and t.at(i + 1) in ("[", "!"):
            k = i + 1 + (t.at(i + 1) == "!")
            return t.match.get(k, k) + 1
        if t.kind[i] == "id":
            if text == "use" and t.at(i - 1) not in (".", "::"):
                return self.use(i)
            if text == "impl" and t.at(i - 1) in ("", "}", ";", "{", "unsafe", "]", "default"):
                return self.implementation(i)
            if (item := self.item(i)) is not None:
                return self.declaration(i, *item)
            if text == "macro_rules":
                k = i
                while k < len(t) and t.text[k] not in ("{", "(", "["):
                    k += 1
                return t.match.get(k, k) + 1
            if text == "self" and t.at(i + 1) == "." and t.at(i - 1) not in (".", "::"):
                self.access(i)
        if text == "(":
            self.call(i)
        return i + 1

    def use(self, i: int) -> int:
        t, k = self.t, i + 1
        while k < len(t) and t.text[k] != ";":
            k = t.match[k] + 1 if t.text[k] == "{" and k in t.match else k + 1
        for path, name, alias in self.tree(i + 1, k, []):
            module = "::".join(path)
            self.f.edge("imports", self.module, f"module:{module}" + (f"#{name}" if name else ""), 1.0, self.path, t.line[i], raw_path="::".join([*path, name] if name else path))
            if name:
                mark = self.f.path_mark("/".join(path[1:]), "rs", module) if path[0] == "crate" and len(path) > 1 else module
                self.named[alias or name] = f"module:{mark}#{name}"
        return k + 1

    def tree(self, i: int, end: int, before: list[str]):
        """(path, name or None, alias) of every leaf of a use tree."""
        t, path = self.t, list(before)
        while i < end:
            if t.text[i] == "{":
                k, begin = i + 1, i + 1
                close = t.match.get(i, end)
                while k <= close:
                    if k == close or t.text[k] == ",":
                        if k > begin:
                            yield from self.tree(begin, k, path)
                        begin = k + 1
                    k = t.match[k] + 1 if k < close and t.text[k] == "{" and k in t.match else k + 1
                return
            if t.text[i] == "*":
                yield path, None, None
                return
            if t.kind[i] == "id" and t.text[i] != "as":
                path.append(t.text[i])
            if t.at(i + 1) == "as" and i + 2 < end:
                yield (path[:-1], path[-1], t.text[i + 2]) if len(path) > 1 else (path, None, None)
                return
            i += 1
        if path and path[-1] == "self":
            yield path[:-1], None, None
        elif len(path) > 1:
            yield path[:-1], path[-1], None
        elif path:
            yield path, None, None

    def implementation(self, i: int) -> int:
        t = self.t
        k = self.angle(i + 1)
        heads = []
        while k < len(t) and t.text[k] not in ("{", "where", ";"):
            if t.text[k] in ("for", "!"):
                k += 1
                continue
            node, after = self.type(k, len(t))
            heads.append(next(iter(self.names(node)), t.between(node[2], min(node[3], len(t) - 1))))
            k = max(after, k + 1)
        while k < len(t) and t.text[k] not in ("{", ";"):
            k = t.match[k] + 1 if t.text[k] in ("(", "[") and k in t.match else k + 1
        close = t.match.get(k, len(t) - 1)
        if not heads:
            return close + 1
        owner, trait = (heads[0], None) if len(heads) == 1 else (heads[1], heads[0])
        if trait:
            found = self.resolve(trait)
            self.f.edge("implements", f"{self.module}#{owner}", found[0] if found else trait, 1.0, self.path, t.line[i], target_name=trait)
        self.impls.append((owner, trait))
        self.walk(k + 1, close)
        self.impls.pop()
        return close + 1

    def declaration(self, i: int, kind: str, name: str) -> int:
        t = self.t
        first, visible = self.first_of(i)
        owner = self.impls[-1][0] if self.impls and kind == "function" else None
        local = f"{owner}.{name}" if owner else name
        full = f"{self.module}#{local}"
        if not owner:
            self.locals.add(name)
        k = i + 1
        while t.text[k].removeprefix("r#") != name:
            k += 1
        at = self.angle(k + 1)
        # where the item ends: its braces, or a semicolon
        end = at
        texts, match, n = t.text, t.match, len(t.text)
        while end < n and (text := texts[end]) not in _ENDS:
            end = match[end] + 1 if text in ("(", "[") and end in match else end + 1
        if kind == "global_var":
            while end < len(t) and t.text[end] != ";":
                end = t.match[end] + 1 if t.text[end] in ("{", "(", "[") and end in t.match else end + 1
        body = end if t.at(end) == "{" else None
        last = t.match.get(end, len(t) - 1) if body is not None else min(end, len(t) - 1)
        if full not in self.seen:
            self.seen.add(full)
            line, stop = t.line[first], t.line[last]
            self.f.symbol("method" if owner else kind, full, self.path, line, end_line=stop, line_count=stop - line + 1, exported=True if visible and not owner else None, doc=t.doc.get(first), owning_class=owner)
            self.f.edge("contains", f"{self.module}#{owner}" if owner else self.module, full, 1.0, self.path, line)
            if kind == "function":
                self.signature(full, at, end, line)
            elif kind in ("struct", "enum", "interface"):
                self.body_types(full, kind, at, end, last)
                if kind == "struct":
                    self.fields(name, full, at, end, t.line[first])
                elif kind == "enum" and body is not None:
                    self.variants(name, full, body + 1, last, t.line[first])
        if kind == "function":
            if body is not None:
                trait = self.impls[-1][1] if self.impls else None
                self.scopes.append((full, f"{self.module}#impl_{trait}.{name}" if trait else None))
                self.walk(body + 1, last)
                self.scopes.pop()
            return last + 1
        if kind == "global_var":
            self.walk(at, last)
        elif kind == "interface" and body is not None:  # functions of a trait stand for themselves
            self.walk(body + 1, last)
        elif kind == "namespace" and body is not None:
            return body + 1
        return last + 1

    def signature(self, full: str, i: int, end: int, line: int) -> None:
        t, seen = self.t, set()
        if t.at(i) == "(" and i in t.match:
            close, k = t.match[i], i + 1
            while k < close:
                if t.text[k] == ":":
                    node, after = self.type(k + 1, close)
                    k = max(after, k + 1)
                    self.refer(full, self.names(node), line, seen, signature_position="param")
                else:
                    k += 1
            if t.at(close + 1) == "->":
                self.refer(full, self.names(self.type(close + 2, end)[0]), line, seen, signature_position="return")

    def body_types(self, full: str, kind: str, i: int, end: int, last: int) -> None:
        """References from the types in a body: after colons, in tuple variants, and after arrows."""
        t, seen, names = self.t, set(), []
        begin = end if t.at(end) == "{" else None
        if begin is None:
            return
        k = begin + 1
        texts, enum = t.text, kind == "enum"
        while k < last:
            text = texts[k]
            if text == ":" or text == "->":
                node, after = self.type(k + 1, last)
                k = max(after, k + 1)  # a type of broken code may end before it begins
                names += self.names(node)
            elif enum and text == "(" and k in t.match:
                names += [n for x in self.listed(k + 1, t.match[k]) for n in self.names(x)]
                k = t.match[k] + 1
            else:
                k += 1
        self.refer(full, names, t.line[begin], seen, field_ref=True)

    def members(self, i: int, close: int):
        """(name token, type) of named fields."""
        t, k = self.t, i
        while k < close:
            while t.at(k) == "#" and k + 1 in t.match:
                k = t.match[k + 1] + 1
            if t.at(k) == "pub":
                k += 1
                k = t.match[k] + 1 if t.at(k) == "(" and k in t.match else k
            if k < close and t.kind[k] == "id" and t.at(k + 1) == ":":
                node, after = self.type(k + 2, close)
                yield k, node
                k = max(after, k + 2)
            while k < close and t.text[k] != ",":
                k += 1
            k += 1

    def fields(self, name: str, full: str, i: int, end: int, line: int) -> None:
        t, targets = self.t, []
        if t.at(end) == "{":
            listed = [(t.text[k], t.line[k], node) for k, node in self.members(end + 1, t.match.get(end, end))]
        elif t.at(i) == "(" and i in t.match:
            listed = [(str(k), t.line[node[2]], node) for k, node in enumerate(self.listed(i + 1, t.match[i]))]
        else:
            listed = []
        for field, at, node in listed:
            own = f"{full}.{field}"
            if own in self.seen:
                continue
            self.seen.add(own)
            self.f.symbol("field", own, self.path, at, owning_class=name, declared_on="struct", tuple_index=int(field) if field.isdigit() else None)
            self.f.edge("contains", full, own, 1.0, self.path, at)
            self.holds(own, [node], at, targets)
        for target in targets:
            self.f.edge("aggregates", full, target, 0.95, self.path, line, rolled_up_from="field_of_type")

    def variants(self, name: str, full: str, i: int, close: int, line: int) -> None:
        t, targets = self.t, []
        while i < close:
            while t.at(i) == "#" and i + 1 in t.match:
                i = t.match[i + 1] + 1
            if i < close and t.kind[i] == "id":
                own, at, k = f"{full}.{t.text[i]}", t.line[i], i + 1
                shape, nodes = "unit", []
                if t.at(k) == "(" and k in t.match:
                    shape, nodes = "tuple", self.listed(k + 1, t.match[k])
                elif t.at(k) == "{" and k in t.match:
                    shape, nodes = "struct", [node for _, node in self.members(k + 1, t.match[k])]
                if own not in self.seen:
                    self.seen.add(own)
                    self.f.symbol("enum_variant", own, self.path, at, owning_class=name, variant_shape=shape)
                    self.f.edge("contains", full, own, 1.0, self.path, at)
                    self.holds(own, nodes, at, targets)
            while i < close and t.text[i] != ",":
                i = t.match[i] + 1 if t.text[i] in ("(", "{", "[") and i in t.match else i + 1
            i += 1
        for target in targets:
            self.f.edge("aggregates", full, target, 0.95, self.path, line, rolled_up_from="field_of_type")

    # Uses

    def access(self, i: int) -> None:
        """self.field, as a read or a write of a field that the type declares."""
        t = self.t
        if not self.impls or not self.scopes or i + 2 >= len(t) or t.kind[i + 2] not in ("id", "num"):
            return
        field = f"{self.module}#{self.impls[-1][0]}.{t.text[i + 2]}"
        after = t.at(i + 3)
        if field not in self.seen or after == "(" or after == "." and i + 4 < len(t) and t.kind[i + 4] == "id" and t.at(self.angle(i + 5 + (t.at(i + 5) == "::"))) == "(":
            return
        write = after in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=") or after == ">" and t.at(i + 4) == ">" and t.at(i + 5) == "=" or t.at(i - 1) == "mut" and t.at(i - 2) == "&" and after != "."
        self.f.edge("writes_field" if write else "reads_field", self.scopes[-1][0], field, 0.95, self.path, t.line[i], via="self")

    def call(self, i: int) -> None:
        t = self.t
        last = i - 1
        if t.at(last) == ">":  # turbofish
            depth, k = 0, last
            while k >= 0:
                depth += (t.text[k] == ">") - (t.text[k] == "<")
                if not depth:
                    break
                if t.text[k] in (";", "{", "}"):
                    return
                k -= 1
            if t.at(k - 1) != "::":
                return
            last = k - 2
        if last < 0 or t.kind[last] not in ("id", "punct") or t.text[last] in NOT_CALLEES or t.at(last - 1) == "fn" or t.at(last) in ("!",):
            return
        text = t.text[last]
        if t.kind[last] == "punct":
            if text not in (")", "]") or last not in t.match:
                return
            begin = t.match[last]
            if t.kind[begin - 1] == "id" and begin and t.text[begin - 1] not in NOT_CALLEES or t.at(begin - 1) in (")", "]", "?"):
                return  # f(..)(..): the inner call is there by itself
            self.calls(t.between(begin, last), 0.7, "raw", t.line[begin])
            return
        if t.at(last - 1) == ".":
            self.calls(text, 0.7, "member", t.line[last])
            return
        if t.at(last - 1) == "::":
            self.scoped(last)
            return
        if t.at(last - 1) in ("struct", "enum", "mod", "#") or self.pattern(last):
            return
        found = self.resolve(text)
        self.calls(found[0] if found else text, 0.95 if found else 0.7, found[1] if found else "bare", t.line[last])

    def pattern(self, k: int) -> bool:
        """Whether a name before brackets stands in a pattern: after let, or before => in a match."""
        t = self.t
        if t.at(k - 1) in ("let", "|"):
            return True
        close = t.match.get(k + 1)
        return close is not None and t.at(close + 1) in ("=>",) and t.at(k - 1) in ("{", ",", "}", "|")

    def scoped(self, last: int) -> None:
        t, k, segments = self.t, last, [self.t.text[last]]
        while t.at(k - 1) == "::":
            k -= 2
            if t.at(k) == ">":
                depth = 0
                while k >= 0:
                    depth += (t.text[k] == ">") - (t.text[k] == "<")
                    if not depth:
                        break
                    k -= 1
                k -= 1 + (t.at(k - 1) == "::")
            if k < 0 or t.kind[k] != "id":
                break
            segments.insert(0, t.text[k])
        if len(segments) < 2 or self.pattern_path(k, last):
            return
        line, owner, name = t.line[last], segments[-2], segments[-1]
        if owner in self.named:
            plain = (f"{self.named[owner]}.{name}", 0.95, "scoped-named")
        elif owner in self.locals:
            plain = (f"{self.module}#{owner}.{name}", 0.95, "scoped-local")
        else:
            plain = ("::".join(segments), 0.7, "scoped-bare")
        if segments[0] == "crate" and len(segments) >= 3:
            mark = self.f.path_mark("/".join(segments[1:-1]), "rs2")
            self.calls(f"module:{mark}#{name}", 0.95, "scoped-crate", line, plain)
        else:
            self.calls(*plain, line)

    def pattern_path(self, begin: int, last: int) -> bool:
        close = self.t.match.get(last + 1)
        return self.t.at(begin - 1) == "let" or close is not None and self.t.at(close + 1) == "=>" and self.t.at(begin - 1) in ("{", ",", "}", "|")

    def calls(self, name: str, confidence: float, kind: str, line: int, otherwise: tuple | None = None) -> None:
        if len(name) >= 200 and kind == "raw":
            return
        for caller in self.scopes[-1] if self.scopes else (self.module,):
            if caller:
                self.f.edge("calls", caller, name, confidence, self.path, line, evidence=True, resolution_kind=kind, otherwise=otherwise)


def extract(path: str, source: str, facts: Facts) -> None:
    Rust(path, source, facts).run()
