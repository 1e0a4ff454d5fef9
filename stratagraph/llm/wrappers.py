"""HTML extraction by wrappers: a union-free regular expression for the pages of each host.

A page is a stream of tokens: opening and closing tags of its blocks and containers, and texts. Runs
that repeat become repeated groups, whose differing texts are text slots. A host's wrapper starts as
one page's expression and takes in the others one by one: equal tokens stay, differing texts become
a slot, and where the streams mismatch, what only one side has becomes an optional group. Partial
wrappers are made inside each task and then merged in two rounds per host, so no task gets a
host's pages, only its partial wrappers.

The finished expression then reads every page of its host and says which of its slots each text
fills: a slot is a place in the expression, so two texts in like containers are two slots where the
pages' structure tells them apart. Every slot carries what the host's pages show at that place: pages,
characters, how many of them are in links, and the length and digest of the text if it never changed.
Whether a text is main text is decided by its slot: not if the slot lies in a menu, header, footer,
sidebar, form, an article inside another, or a container whose own name says that it is one of these,
a notice, advert or comment; nor if it holds the same text on all of several pages that differ
elsewhere, or only links on several pages, headings apart; and if any slot that the page fills lies in an article or main
element, only such slots are. On a page that fills none of these, a slot of mostly links isn't either.

Extraction reads each page again, with its host's slots, and emits the blocks of main text in order.
An expression is as long as its host's pages are varied; it takes in every page that it was made of,
and alignments are exact at any length: longest common subsequences by bits, halved where the bits of
all rows would be too many.

Defined results: null html is an empty page, with no text; a page cut off anywhere is read as far as
it goes; a null url belongs to the host ''; repeated rows each give a row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.runtime import cut, ship, tidy

#: Characters of wrappers that may be broadcast together; beyond it they join by host.
BROADCAST_CHARS = 32 << 20
#: Hosts whose partial wrappers a task holds at once, salts of the first merge, and bits of rows that an alignment holds at once.
HELD_HOSTS, SALTS, HELD_BITS = 5_000, 32, 1 << 30
#: A slot is a host's constant, or its menu, if so many pages fill it.
CONSTANT_PAGES = 3

#: Words before a cue that take its meaning.
NEGATING = frozenset("with has no without".split())

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
HIDDEN = frozenset("head title template noscript svg math iframe object canvas audio video select textarea button option datalist".split())
BOILERPLATE = frozenset("nav header footer aside form dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the first kind ends an open element of the second, unless one of the third is in between.
CLOSES_P = BLOCKS - {"br"}
ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words that say what a container is: as the first of its name, or as the last one, or as a whole name or after one of SITE.
FIRST = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr masthead nav navbar navigation newsletter pager pagination paywall popup promo promoted promotion recommended related replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription".split()
)
LAST = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments menu modal nav navbar navigation notice pager pagination popup promo replies sidebar sponsored toolbar".split())
WHOLE = frozenset("banner disclaimer footer header hidden login menu modal notice notices notification overlay respond search toolbar widget".split())
SITE = frozenset("site page global main top bottom".split())

#: A tag's quoted values may hold ">", or else, where a quote isn't closed, the tag ends at the next one.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:(?:\"[^\"<]*\"|'[^'<]*'|[^>\"'<])*(?=>))|[^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _cued(attributes: str) -> bool:
    """Whether a name says that the element isn't main text; has-sidebar, table-header and search-results say nothing of the kind."""
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if not words or words[0] in NEGATING:
                continue
            if words[0] in FIRST or words[-1] in LAST or words[-1] in WHOLE and (len(words) == 1 or words[0] in SITE):
                return True
    return False


class Page:
    """What a page shows: its blocks as (path, text, characters in links), and its structure as tokens."""

    __slots__ = ("blocks", "tokens")

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str, int]] = []
        self.tokens: list[str] = []
        #: Open elements: name, and the path of containers down to it.
        stack: list[tuple[str, str]] = [("", "")]
        text: list[str] = []
        linked = 0
        links = 0
        hidden = 0

        def flush() -> None:
            nonlocal linked
            if text:
                words = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if words:
                    self.blocks.append((stack[-1][1], words, min(linked, len(words))))
                    self.tokens.append("#" + stack[-1][1])
            linked = 0

        def pop(to: int) -> None:
            nonlocal links, hidden
            while len(stack) > to:
                name, _ = stack.pop()
                links -= name == "a"
                hidden -= name in HIDDEN
                if name in BLOCKS:
                    self.tokens.append(f"</{name}>")

        def end(names, scope) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    flush()
                    pop(k)
                    return
                if stack[k][0] in scope:
                    return

        at, find = 0, _TOKEN.search
        while (m := find(html, at)) is not None:
            if m.start() > at and not hidden:
                piece = html[at : m.start()]
                text.append(piece)
                if links:
                    linked += len(piece)
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name == "br":
                    flush()
                elif name in BLOCKS or name not in VOID:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            if name in BLOCKS:
                                flush()
                            pop(k)
                            break
                continue
            if name in RAW:
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else len(html)
                continue
            if name in BLOCKS:
                if name in CLOSES_P:
                    end({"p"}, BLOCKS - {"p"})
                if name in ITEMS:
                    end(*ITEMS[name])
                flush()
            if name in VOID:
                continue
            attributes = m[3]
            path = stack[-1][1]
            # inline elements are no containers, unless their names say what they hold
            mark = name in BOILERPLATE or bool(attributes) and name not in ("html", "body") and _cued(attributes)
            mark = mark or name == "article" and ">article" in path  # an article in another: a comment, a teaser
            if name in BLOCKS or mark:
                if mark and name not in BLOCKS:
                    flush()
                path = f"{path}>{name}{'!' if mark else ''}" if name not in ("html", "body") or mark else path
                self.tokens.append(f"<{name}{'!' if mark else ''}>")
            stack.append((name, path))
            links += name == "a"
            hidden += name in HIDDEN
        if not hidden:
            text.append(html[at:])
        flush()
        pop(1)


_MAIN = re.compile(r">(?:article|main)(?=>|$)")


def in_main(path: str) -> bool:
    return _MAIN.search(path) is not None


def _repeats(tokens: list, size: int) -> bool:
    """Whether anything of this size stands twice in a row."""
    codes: dict = {}
    a = np.array([codes.setdefault(t, len(codes)) for t in tokens])
    other = np.flatnonzero(a[:-size] != a[size:])
    return bool((np.diff(np.concatenate([[-1], other, [len(a) - size]])) > size).any())


def collapse(tokens: list) -> list:
    """Tandem repeats as ("+", group); short groups first, so that groups nest."""
    size = 0
    while (size := size + 1) <= len(tokens) // 2:
        if size > 12 and not _repeats(tokens, size):
            continue
        out: list = []
        k = 0
        while k < len(tokens):
            group = tokens[k : k + size]
            to = k + size
            while to + size <= len(tokens) and tokens[to : to + size] == group:
                to += size
            if to > k + size:
                single = len(group) == 1 and isinstance(group[0], tuple) and group[0][0] == "+"
                out.append(group[0] if single else ("+", tuple(group)))
                k = to
            else:
                out.append(tokens[k])
                k += 1
        tokens = out
    return tokens


def _strip(item):
    """What an item repeats or has optionally, for alignment: x, x+ and x? align."""
    return item[1] if isinstance(item, tuple) else (item,)


def _merge(a, b):
    """One item for two that align: repeated or optional if either is."""
    if a == b:
        return a
    kinds = {x[0] for x in (a, b) if isinstance(x, tuple)}
    kind = "*" if "*" in kinds or kinds == {"+", "?"} else "+" if "+" in kinds else "?"
    return (kind, _strip(a))


def common(x: list, y: list) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of both, in order.

    A row of the usual table is a number, with a zero bit wherever the length grows; where all rows would be
    too many bits, x is halved and y is cut where the halves' lengths add up to the most.
    """
    if not x or not y:
        return []

    def rows(x: list, y: list, keep: bool):
        at: dict = {}
        for j, item in enumerate(y):
            at[item] = at.get(item, 0) | 1 << j
        full = (1 << len(y)) - 1
        v, out = full, [full]
        for item in x:
            u = v & at.get(item, 0)
            v = ((v + u) | (v - u)) & full
            if keep:
                out.append(v)
        return out if keep else v

    if len(x) * len(y) > HELD_BITS and len(x) > 1:
        half = len(x) // 2
        grown = lambda v: np.concatenate([[0], np.cumsum([c == "0" for c in reversed(f"{v:0{len(y)}b}")])])
        ahead, behind = grown(rows(x[:half], y, False)), grown(rows(x[:half - 1 : -1], y[::-1], False))[::-1]
        cut_at = int((ahead + behind).argmax())
        return common(x[:half], y[:cut_at]) + [(i + half, j + cut_at) for i, j in common(x[half:], y[cut_at:])]
    table, i, j, out = rows(x, y, True), len(x), len(y), []
    while i and j:
        if table[i] >> (j - 1) & 1:
            j -= 1
        elif not table[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: list, b: list) -> list:
    """The expression that takes in what a and b do: a longest common alignment, the rest in optional groups."""
    n, m = len(a), len(b)
    low = 0
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    if low == n == m:
        return a
    high = 0
    while high < min(n, m) - low and a[n - 1 - high] == b[m - 1 - high]:
        high += 1
    x, y = a[low : n - high], b[low : m - high]
    sx, sy = [_strip(i) for i in x], [_strip(i) for i in y]
    pairs = iter([*common(sx, sy), (len(x), len(y))])
    pair = next(pairs)
    middle, i, j = [], 0, 0
    mine: list = []
    yours: list = []

    def close() -> None:
        if mine and yours and (g := _base(mine)) == _base(yours):  # x+ and x, or alike
            kinds = {k[0][0] for k in (mine, yours) if len(k) == 1 and isinstance(k[0], tuple)}
            middle.append(("*" if kinds & {"*", "?"} else "+", g))
        else:
            middle.extend((_optional(tuple(mine)), _optional(tuple(yours))))
        mine.clear()
        yours.clear()

    while i < len(x) or j < len(y):
        if (i, j) == pair:
            close()
            middle.append(_merge(x[i], y[j]))
            i, j, pair = i + 1, j + 1, next(pairs)
        elif i < pair[0]:
            mine.append(x[i])
            i += 1
        else:
            yours.append(y[j])
            j += 1
    close()
    return absorb(collapse([*a[:low], *(g for g in middle if g is not None), *a[n - high :]]))


def _base(items: list) -> tuple:
    return items[0][1] if len(items) == 1 and isinstance(items[0], tuple) else tuple(items)


def absorb(items: list) -> list:
    """A repeated or optional group and equal items beside it as one group."""
    out: list = []
    groups: list[int] = []  # places of the groups in out
    for item in items:
        out.append(item)
        if isinstance(item, tuple):
            groups.append(len(out) - 1)
        while True:
            last = out[-1]
            if isinstance(last, tuple) and len(out) > 1:
                kind, g = last
                before = out[-2]
                if isinstance(before, tuple) and before[1] == g:
                    out[-2:] = [("+" if "+" in (kind, before[0]) else "*", g)]
                    groups.pop()
                    continue
                if out[-1 - len(g) : -1] == list(g):
                    out[-1 - len(g) :] = [("+", g)]
                    while groups and groups[-1] >= len(out) - 1:
                        groups.pop()
                    groups.append(len(out) - 1)
                    continue
            elif groups:  # the last items spell the group before them
                k = groups[-1]
                if len(out) - 1 - k == len(out[k][1]) and tuple(out[k + 1 :]) == out[k][1]:
                    out[k:] = [("+", out[k][1])]
                    continue
            break
    return out


def _optional(group: tuple):
    if not group:
        return None
    if len(group) == 1 and isinstance(group[0], tuple):
        kind, inner = group[0]
        return ("?" if kind == "?" else "*", inner)
    return ("?", group)


def expression(items) -> str:
    """The wrapper as text: tags, slots (#path), groups with +, ? or *."""
    return "".join(i if isinstance(i, str) else f"({expression(i[1])}){i[0]}" for i in items)


class Matcher:
    """An expression as an automaton, which finds the slot that each text of a page fills."""

    def __init__(self, items):
        #: Places: (token, the state after it), or (None, states that it stands for, the preferred one first).
        self._states: list[tuple] = [(None, [])]
        self._after: dict[int, tuple[dict[str, list[int]], bool]] = {}
        self._start = self._sequence(items, 0)

    def _sequence(self, items, to: int) -> int:
        for item in reversed(items):
            if isinstance(item, str):
                self._states.append((item, to))
                to = len(self._states) - 1
                continue
            kind, group = item
            fork = len(self._states)
            self._states.append((None, []))
            first = self._sequence(group, to if kind == "?" else fork)
            self._states[fork][1].extend((first, to))
            to = first if kind == "+" else fork
        return to

    def _next(self, place: int | None) -> tuple[dict[str, list[int]], bool]:
        """The places that may follow one, by their tokens, and whether the page may end there."""
        if place not in self._after:
            by: dict[str, list[int]] = {}
            stack, seen = [self._start if place is None else self._states[place][1]], set()
            while stack:
                k = stack.pop()
                if k not in seen:
                    seen.add(k)
                    token, to = self._states[k]
                    if token is None:
                        stack.extend(reversed(to))
                    else:
                        by.setdefault(token, []).append(k)
            self._after[place] = by, 0 in seen
        return self._after[place]

    def token(self, place: int) -> str:
        return self._states[place][0]

    def slots(self, tokens: list[str]) -> list[int] | None:
        """The slot of each text in order, or None if the expression doesn't spell the page."""
        steps: list[dict] = []
        now: dict = {None: None}
        for token in tokens:
            then: dict = {}
            for place in now:
                for k in self._next(place)[0].get(token, ()):
                    then.setdefault(k, place)
            if not then:
                return None
            steps.append(then)
            now = then
        ends = [place for place in now if self._next(place)[1]]
        if not ends:
            return None
        at, out = ends[0], []
        for token, step in zip(reversed(tokens), reversed(steps)):
            if token[0] == "#":
                out.append(at)
            at = step[at]
        return out[::-1]


def mark(text: str) -> str:
    """Stands for a text of any length."""
    return f"{len(text)}:{hashlib.md5(text.encode('utf-8', 'surrogatepass')).hexdigest()}"


def tally(blocks, slots) -> dict:
    """What one page shows in each slot: 1, characters, those in links, and the mark of the one text or None."""
    seen: dict = {}
    for slot, (_, text, linked) in zip(slots, blocks):
        own = mark(text)
        s = seen.setdefault(slot, [1, 0, 0, own])
        s[1] += len(text)
        s[2] += linked
        if s[3] != own:
            s[3] = None
    return seen


def pool(into: dict, slots: dict) -> None:
    """Adds what other pages show in the slots."""
    for slot, (pages, chars, linked, text) in slots.items():
        s = into.get(slot)
        if s is None:
            into[slot] = [pages, chars, linked, text]
        else:
            s[0] += pages
            s[1] += chars
            s[2] += linked
            if s[3] != text:
                s[3] = None


_HEADING = re.compile(r">h[1-6]$")


def is_main(path: str, held: list, of: int, varied: bool = True) -> tuple[bool, bool]:
    """Whether a slot with this path may be main text beside others in an article or main element, and without any.

    held: what the slot holds on a host of so many pages; varied: whether most of what they hold differs between them.
    """
    pages, chars, linked, text = held
    if "!" in path:
        return False, False
    several = pages >= CONSTANT_PAGES and _HEADING.search(path) is None
    constant = varied and text is not None and several and pages == of
    return not constant and not (several and linked >= chars), not (varied and text is not None and pages >= CONSTANT_PAGES and pages == of) and 2 * linked <= chars


def decide(paths: dict, held: dict, of: int) -> dict:
    """For each slot whether it lies in main, and is_main()."""
    own = [h for k, h in held.items() if "!" not in paths[k]]
    varied = 2 * sum(h[1] for h in own if h[3] is None) >= sum(h[1] for h in own) > 0
    return {k: (in_main(paths[k]), *is_main(paths[k], h, of, varied)) for k, h in held.items()}


def chosen(blocks, slots, rules: dict) -> str:
    """The text of the blocks whose slots are main text; a slot that no page of the host is known to fill goes by its path."""
    found = [rules.get(k) or (in_main(path), "!" not in path, "!" not in path) for k, (path, _, _) in zip(slots, blocks)]
    home = any(inside and main for inside, main, _ in found)
    return "\n".join(text for (inside, main, bare), (_, text, _) in zip(found, blocks) if (inside and main if home else bare))


class Wrapper:
    """A host's expression, and what lies at its paths: pages, characters, those in links, and the mark of the one text or None."""

    def __init__(self):
        self.items: list | None = None
        self.pages = 0
        self.slots: dict[str, list] = {}
        self._matcher: Matcher | None = None

    def add(self, page: Page) -> None:
        # an expression that takes the page in already isn't aligned again
        if self.items is None or self.matcher().slots(page.tokens) is None:
            self._take(absorb(collapse(page.tokens)))
        self.pages += 1
        pool(self.slots, tally(page.blocks, (path for path, _, _ in page.blocks)))

    def merge(self, other: Wrapper) -> None:
        if other.items is not None:
            self._take(other.items)
            self.pages += other.pages
            pool(self.slots, other.slots)

    def _take(self, items: list) -> None:
        self.items = items if self.items is None else align(self.items, items)
        self._matcher = None

    def matcher(self) -> Matcher:
        if self._matcher is None:
            self._matcher = Matcher(self.items or [])
        return self._matcher

    def rules(self) -> dict:
        """decide() by paths, for a page that the expression doesn't spell."""
        return decide({path: path for path in self.slots}, self.slots, self.pages)

    def dump(self) -> str:
        return json.dumps([self.items, self.pages, self.slots], ensure_ascii=False)

    @classmethod
    def load(cls, text: str) -> Wrapper:
        def back(x):
            return x if isinstance(x, str) else (x[0], tuple(back(i) for i in x[1]))

        out = cls()
        items, out.pages, out.slots = json.loads(text)
        out.items = None if items is None else [back(i) for i in items]
        return out


def main_text(page: Page, rules: dict) -> str:
    """A page's main text by rules for its paths."""
    return chosen(page.blocks, [path for path, _, _ in page.blocks], rules)


class Form:
    """A host's finished expression with what its slots hold over all of the host's pages."""

    def __init__(self, wrapper: str, held: str | None = None):
        self.wrapper = Wrapper.load(wrapper)
        self.matcher = self.wrapper.matcher()
        #: By the place in the expression; JSON has its keys as strings.
        self.held: dict[str, list] = json.loads(held) if held else {}
        self._rules: dict | None = None

    def add(self, page: Page) -> None:
        slots = self.matcher.slots(page.tokens)
        if slots is not None:
            pool(self.held, tally(page.blocks, map(str, slots)))

    def rules(self) -> dict:
        if self._rules is None:
            self._rules = decide({k: self.matcher.token(int(k))[1:] for k in self.held}, self.held, self.wrapper.pages)
        return self._rules

    def text(self, page: Page) -> str:
        slots = self.matcher.slots(page.tokens)
        if slots is None:
            return main_text(page, self.wrapper.rules())
        return chosen(page.blocks, [str(k) for k in slots], self.rules())


def _rows(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[^:/?#]*://([^/?#]*)", 1), F.lit("")))
    return pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))


def infer(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """host and its wrapper (JSON): the expression, pages, and what lies at its paths."""
    ship(pages)

    def partial(batches):
        held: dict[str, Wrapper] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def out():
            names = list(held)
            dumps = [held[h].dump() for h in names]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([salt] * len(names), pa.int32()), pa.array(dumps, pa.string())], ["host", "salt", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1)):
                held.setdefault(host.as_py(), Wrapper()).add(Page(page.as_py()))
                if len(held) >= HELD_HOSTS:
                    yield out()
        if held:
            yield out()

    def merged(table: pa.Table) -> pa.Table:
        w = Wrapper()
        for text in sorted(table.column("wrapper").to_pylist()):
            w.merge(Wrapper.load(text))
        return pa.table({"host": table.column("host")[:1], "salt": table.column("salt")[:1], "wrapper": pa.array([w.dump()], pa.string())})

    schema = "host string, salt int, wrapper string"
    parts = _rows(pages, id_col, url, html).select("host", "html").mapInArrow(partial, schema)
    return parts.groupBy("host", "salt").applyInArrow(merged, schema).groupBy("host").applyInArrow(merged, schema).select("host", "wrapper")


def _with_forms(rows: DataFrame, forms: DataFrame, how: str) -> DataFrame:
    """The rows with their host's columns of the (already cut) table of wrappers."""
    size = forms.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    return rows.join(F.broadcast(forms) if size <= BROADCAST_CHARS else forms, F.col("host") == F.col("__h"), how)


def fill(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host and what the slots of its expression hold (JSON), by matching each row (host, html) with its host's wrapper (__h, wrapper)."""

    def partial(batches):
        forms: dict[str, Form] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def out():
            names = list(forms)
            held = [json.dumps(forms[h].held, ensure_ascii=False) for h in names]
            forms.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([salt] * len(names), pa.int32()), pa.array(held, pa.string())], ["host", "salt", "held"])

        for batch in batches:
            for host, html_, wrapper in zip(*batch.columns):
                h = host.as_py()
                if h not in forms:
                    if len(forms) >= HELD_HOSTS:
                        yield out()
                    forms[h] = Form(wrapper.as_py())
                forms[h].add(Page(html_.as_py()))
        if forms:
            yield out()

    def merged(table: pa.Table) -> pa.Table:
        held: dict[str, list] = {}
        for text in sorted(table.column("held").to_pylist()):
            pool(held, json.loads(text))
        return pa.table({"host": table.column("host")[:1], "salt": table.column("salt")[:1], "held": pa.array([json.dumps(held, ensure_ascii=False)], pa.string())})

    schema = "host string, salt int, held string"
    parts = _with_forms(rows.select("host", "html"), wrappers, "inner").select("host", "html", "wrapper").mapInArrow(partial, schema)
    return parts.groupBy("host", "salt").applyInArrow(merged, schema).groupBy("host").applyInArrow(merged, schema).select("host", "held")


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text of each row, by the wrappers inferred from all rows."""
    ship(pages)
    rows = _rows(pages, id_col, url, html)
    wrappers = cut(infer(pages, id_col, url, html).select(F.col("host").alias("__h"), "wrapper"))
    forms = cut(wrappers.join(fill(rows, wrappers), F.col("__h") == F.col("host")).select("__h", "wrapper", "held"))
    rows = _with_forms(rows, forms, "left").select("id", "url", "host", "html", "wrapper", "held")

    def run(batches):
        forms: dict[str, Form] = {}
        for batch in batches:
            texts = []
            for host, html_, wrapper, held in zip(*batch.columns[2:]):
                h = host.as_py()
                if h not in forms:
                    if len(forms) >= HELD_HOSTS:
                        forms.clear()
                    forms[h] = Form(wrapper.as_py(), held.as_py())
                texts.append(forms[h].text(Page(html_.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])
            tidy()

    return rows.mapInArrow(run, f"page_id {rows.schema['id'].dataType.simpleString()}, url string, text string")
