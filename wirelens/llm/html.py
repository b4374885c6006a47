"""Main text of web pages by wrappers: union-free regular expressions inferred per host by aligning its pages."""

from __future__ import annotations

import html
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import attach, batches, save

#: Fixed names of HTML: elements without content, elements of raw text, blocks, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|title"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "html li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split()
)
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and words of a class, id or role, that hold no main text. An article's own header is part of it.
ASIDE = frozenset("head nav footer aside form button select script style noscript template textarea iframe svg canvas dialog menu object".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation "
    "newsletter notice popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
HEADER_WORDS = frozenset("header masthead".split())
KEPT_WORDS = frozenset("article body container content entry layout main page post story text wrapper".split())
#: Words that tell nothing beside one of those: a name made of both is theirs, one with any other word may be a title's ("related-work").
NEUTRAL_WORDS = KEPT_WORDS | frozenset(
    "area articles bar block bottom box button buttons col column count form global group has icon icons inner item items label left link links list module outer panel posts primary reader "
    "right row secondary section signup site slot small space stories thread title top unit user wrap".split()
)
#: How a line begins that names an author.
BYLINE = re.compile(r"(?:by|von|par|por|di|door|av|text|words|author|autor|auteur)\b:?\s", re.IGNORECASE)
MAIN = frozenset("article main".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>(.*?)(?:</\1\s*>|\Z)|</?[a-zA-Z](?:[^\"'<>]|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.DOTALL | re.IGNORECASE
)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORDS = re.compile(r"[a-z0-9]+")
#: Up to so many bytes of what is taken from wrappers are broadcast.
MOST_BROADCAST = 32 << 20
#: Different pages that a host must have for text that all of them hold at the same place to be its template; a share of a page's main text above which it is none.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
#: Share of the wrapper's own text that an element must hold for the main text to be looked for inside it.
MOST_OF = 0.85
#: Share of the wrapper's own text that makes a form a container; share of an element's text in links that makes it a menu.
FORM_OF, MENU_OF = 0.5, 0.5
#: Parts from which on a wrapper takes neighbours of one kind as one repeated group, wherever they stand; parts that a task holds before it passes its wrappers on; wrappers of a host that a task aligns.
MOST_PARTS, MOST_HELD, MOST_ALIGNED = 20_000, 200_000, 16


class Node:
    """An element of a page: its name, the name with those of class, id and role, and what it holds: elements and strings."""

    __slots__ = ("held", "key", "name")

    def __init__(self, name: str, key: str) -> None:
        self.name, self.key, self.held = name, key, []


def parse(page: str | None) -> Node:
    """The tree of a page, however broken: what is open at its end is closed there, a tag cut short is dropped."""
    root = Node("#root", "#root")
    stack, open_ = [root], Counter()

    def leave(k: int) -> None:
        for node in stack[k:]:
            open_[node.name] -= 1
        del stack[k:]

    def close(names: list[str], within: tuple[str, ...]) -> None:
        if any(open_[n] for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    return leave(k)
                if stack[k].name in within:
                    return None
        return None

    for m in TOKEN.finditer(page or ""):
        token = m[0]
        if token[0] != "<" or token == "<":
            stack[-1].held.append(token)
            continue
        if m[1] is not None or token[1] in "!?" or not token.endswith(">"):
            continue
        name = NAME.match(token)[1].lower()
        if token[1] == "/":
            if open_[name]:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if name in BLOCKS:
            close(["p"], ("td", "th", "li", "div", "article", "main", "section", "body"))
        if name in CLOSES:
            closed, within = CLOSES[name]
            close(closed.split(), within)
        key = name
        if "=" in token:
            given = {n for a in ATTRIBUTE.finditer(token) for n in (a[2] or a[3] or a[4] or "").lower().split()}
            key = ".".join([name, *sorted({"-".join(w for w in WORDS.findall(n) if not w.isdigit()) for n in given} - {""})])
        node = Node(name, key)
        stack[-1].held.append(node)
        if name not in VOID and not token.endswith("/>"):
            stack.append(node)
            open_[name] += 1
    return root


def path_of(parent: int, key: str) -> int:
    """A path from the root as a number, so that deep pages have no long paths."""
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), parent)


class Part:
    """A part of a wrapper, which read in order is a union-free regular expression over tags and texts.

    An element has a key; a text has none, and is a constant (its hash) or a
    slot. A part may be optional, and an element may repeat. ``chars`` counts
    the characters of a text in all pages.
    """

    __slots__ = ("chars", "constant", "held", "key", "optional", "repeated")

    def __init__(self, key: str | None, constant: int | None = None, chars: int = 0) -> None:
        self.key, self.constant, self.chars, self.optional, self.repeated, self.held = key, constant, chars, False, False, []


def wrapper(page: Node) -> Part:
    """The wrapper of one page: neighbours of one kind are folded into a repeated group, or into one slot."""
    root = Part(page.key)
    order, todo = [root], [(page, root)]
    while todo:
        node, part = todo.pop()
        for x in node.held:
            if isinstance(x, str):
                if text := " ".join(x.split()):
                    part.held.append(Part(None, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")), len(text)))
            else:
                part.held.append(Part(x.key))
                order.append(part.held[-1])
                todo.append((x, part.held[-1]))
    for part in reversed(order):  # inner parts first
        part.held = _folded(part.held)
    return root


def _folded(held: list[Part]) -> list[Part]:
    out: list[Part] = []
    for part in held:
        if out and out[-1].key == part.key:
            out[-1].repeated = part.key is not None
            out[-1].optional &= part.optional
            align(out[-1], part)
        else:
            out.append(part)
    return out


def gathered(root: Part) -> None:
    """Take all parts of one kind in an element as one repeated group, so that an element has a part a kind, however different a host's pages are. Nothing is left out: groups hold the parts and the characters of all."""
    todo = [root]
    while todo:
        part = todo.pop()
        kinds: dict[str | None, list[Part]] = defaultdict(list)
        for x in part.held:
            kinds[x.key].append(x)
        part.held = []
        for own in kinds.values():
            for x in own[1:]:
                align(own[0], x)
                own[0].repeated = own[0].key is not None
            own[0].optional = all(x.optional for x in own)
            part.held.append(own[0])
        todo += part.held


def align(a: Part, b: Part) -> None:
    """Widen wrapper a to the least of this form that covers b too: equal parts stay, texts that differ become a slot, parts that one lacks become optional.

    Children are aligned in order, each with the next of its kind, in one pass.
    """
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        p.optional, p.repeated, p.chars = p.optional or q.optional, p.repeated or q.repeated, p.chars + q.chars
        if p.key is None:
            p.constant = p.constant if p.constant == q.constant else None
            continue
        if len(p.held) == len(q.held) and all(x.key == y.key for x, y in zip(p.held, q.held, strict=True)):
            todo += zip(p.held, q.held, strict=True)
            continue
        places = defaultdict(list)
        for k in range(len(p.held) - 1, -1, -1):
            places[p.held[k].key].append(k)
        merged, at = [], 0
        for y in q.held:
            own = places[y.key]
            while own and own[-1] < at:
                own.pop()
            if own:
                for x in p.held[at : own[-1]]:
                    x.optional = True
                    merged.append(x)
                at = own.pop() + 1
                merged.append(p.held[at - 1])
                todo.append((merged[-1], y))
            else:
                y.optional = True
                merged.append(y)
        for x in p.held[at:]:
            x.optional = True
            merged.append(x)
        p.held = []
        for x in merged:  # parts of one kind that have become neighbours repeat
            if p.held and p.held[-1].key == x.key:
                p.held[-1].repeated = x.key is not None
                p.held[-1].optional &= x.optional
                todo.append((p.held[-1], x))
            else:
                p.held.append(x)


class Wrapper:
    """What is known of a host: its wrapper, the number of its pages, hashes of a few different ones, and the blocks that all of them have at the same place."""

    def __init__(self, root: Part, pages: int, seen: set[int], template: set[int]) -> None:
        self.root, self.pages, self.seen, self.template = root, pages, seen, template
        #: The number of the wrapper's parts.
        self.parts = sum(1 for _ in preorder(root))

    @classmethod
    def of(cls, page: str | None) -> Wrapper:
        tree = parse(page)
        found = {mark for block in blocks(tree, Rules({0})) for mark in block.marks()}
        return cls(wrapper(tree), 1, {xxhash.xxh64_intdigest(repr(sorted(found)))}, found)

    def add(self, other: Wrapper) -> None:
        """Align with another wrapper of the host. Copies of a page teach nothing of what its host's pages share."""
        align(self.root, other.root)
        self.parts = sum(1 for _ in preorder(self.root))
        if self.parts > MOST_PARTS:
            gathered(self.root)
            self.parts = sum(1 for _ in preorder(self.root))
        self.pages += other.pages
        if other.seen != self.seen:
            self.template &= other.template
        self.seen = set(sorted(self.seen | other.seen)[: TEMPLATE_PAGES + 1])

    def dumps(self) -> bytes:
        flat = [(x.key, x.constant, x.chars, x.optional, x.repeated, len(x.held)) for x in preorder(self.root)]
        return pickle.dumps((flat, self.pages, sorted(self.seen), sorted(self.template)))

    @classmethod
    def loads(cls, data: bytes) -> Wrapper:
        flat, pages, seen, template = pickle.loads(data)
        top = Part("")
        stack = [(top, 1)]
        for key, constant, chars, optional, repeated, n in flat:
            while not stack[-1][1]:
                stack.pop()
            parent, left = stack[-1]
            stack[-1] = (parent, left - 1)
            part = Part(key, constant, chars)
            part.optional, part.repeated = optional, repeated
            parent.held.append(part)
            stack.append((part, n))
        return cls(top.held[0], pages, set(seen), set(template))


def preorder(root: Part) -> Iterator[Part]:
    todo = [root]
    while todo:
        part = todo.pop()
        yield part
        todo += reversed(part.held)


def expression(root: Part) -> str:
    """The wrapper as a regular expression: ``#`` a slot, ``"`` a constant text, ``?`` and ``+`` as usual."""
    out: list[str] = []
    todo: list[Part | str] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        mark = "+" * x.repeated + "?" * x.optional
        if x.key is None:
            out.append(("#" if x.constant is None else '"') + mark)
        else:
            out.append(f"{x.key}(")
            todo += [")" + mark, *reversed([y for pair in pairwise([*x.held, ""]) for y in (pair[0], " " if pair[1] else "")])]
    return "".join(out)


class Rules:
    """The little of a wrapper that a host's pages need: paths of the main elements, marks of the template, and paths of what is text against its name."""

    __slots__ = ("kept", "paths", "template")

    def __init__(self, paths: set[int], template: set[int] | frozenset[int] = frozenset(), kept: set[int] | frozenset[int] = frozenset()) -> None:
        self.paths, self.template, self.kept = paths, template, kept


def named(key: str, inside: bool) -> str:
    """What an element's name tells: "aside" (it holds no main text), "maybe" (the host's wrapper decides), or "". ``inside``: within the main element, where a header is the article's own."""
    name, *names = key.split(".")
    if name == "header":
        return "" if inside else "aside"
    if name == "form":
        return "maybe"
    if name in ASIDE:
        return "aside"
    if name in MAIN | {"body", "html"}:
        return ""
    words = [n.split("-") for n in names]
    if not inside and any(w in KEPT_WORDS for n in words for w in n):
        return ""
    found = ""
    for n in words:
        if ASIDE_WORDS.intersection(n) - (HEADER_WORDS if inside else frozenset()):
            if all(w in ASIDE_WORDS or w in NEUTRAL_WORDS for w in n):
                return "aside"
            found = "maybe"
    return found


def _aside(key: str, inside: bool, path: int, kept: set[int] | frozenset[int]) -> bool:
    told = named(key, inside)
    return told == "aside" or told == "maybe" and path not in kept


def kept_paths(known: Wrapper) -> set[int]:
    """Paths of elements whose name leaves it open and whose text tells that they are main text.

    A form that holds most of the wrapper's slots is a container. An element
    one of whose names has a listed word beside others is what its text is:
    mostly links, or the same text in all pages, is a menu or a notice;
    anything else is text.
    """
    sums: dict[int, list] = {}
    order, todo = [], [(known.root, 0, False, None, 0)]
    slots = any(x.key is None and x.constant is None for x in preorder(known.root))
    while todo:
        part, path, link, above, depth = todo.pop()
        order.append((part, path, above))
        # Characters, of these in links, of these in slots; then whether they are all constant.
        sums[id(part)] = [0, 0, 0]
        for x in part.held:
            if x.key is None:
                sums[id(part)][0] += x.chars
                sums[id(part)][1] += x.chars * link
                sums[id(part)][2] += x.chars * (not link and not (slots and x.constant is not None))
            elif named(x.key, True) != "aside":
                todo.append((x, path_of(path, x.key), link or x.key.split(".")[0] == "a", part, depth + 1))
    for part, _, above in reversed(order):
        if above is not None:
            for k, n in enumerate(sums[id(part)]):
                sums[id(above)][k] += n
    total = sums[id(known.root)][2]
    several = len(known.seen) >= TEMPLATE_PAGES
    out = set()
    for part, path, _ in order:
        if part.key.split(".")[0] == "form":
            if total and sums[id(part)][2] >= FORM_OF * total:
                out.add(path)
        elif named(part.key, True) == "maybe" or named(part.key, False) == "maybe":
            chars, links, own = sums[id(part)]
            if chars and links < MENU_OF * chars and (own or not several):
                out.add(path)
    return out


def main_paths(known: Wrapper, kept: set[int] | frozenset[int] = frozenset()) -> set[int]:
    """Paths of the elements that hold the main text.

    The wrapper's own text is that of its slots outside links and outside
    menus and the like; constants and links are what a host repeats. From the
    root on, the element that has most of it is entered, as long as it has no
    heading beside it. Where that ends above article or main elements that
    together hold most of it, those are taken.
    """
    slots = any(x.key is None and x.constant is None for x in preorder(known.root))
    own: dict[int, int] = {}
    order, todo = [], [(known.root, 0, False)]
    while todo:
        part, path, link = todo.pop()
        order.append((part, path))
        for x in part.held:
            if x.key is None:
                own[id(part)] = own.get(id(part), 0) + (0 if link or (slots and x.constant is not None) else x.chars)
            elif not _aside(x.key, False, at := path_of(path, x.key), kept):
                todo.append((x, at, link or x.key.split(".")[0] == "a"))
    for part, _ in reversed(order):
        own[id(part)] = own.get(id(part), 0) + sum(own.get(id(x), 0) for x in part.held if x.key is not None)
    part, path, total = known.root, 0, own[id(known.root)]
    if not total:
        return {0}
    while part.key.split(".")[0] not in MAIN:
        best = max((x for x in part.held if x.key is not None), key=lambda x: own.get(id(x), 0), default=None)
        if best is None or own.get(id(best), 0) < MOST_OF * total or best.key.split(".")[0] in HEADINGS | {"p", "a"}:
            break
        if best.key.split(".")[0] not in MAIN and any(x is not best and own.get(id(x), 0) and x.key is not None and _heads(x) for x in part.held):
            break
        part, path = best, path_of(path, best.key)
    inner, todo = [], [(part, path)]
    while todo:
        x, at = todo.pop()
        if x.key.split(".")[0] in MAIN:
            inner.append((x, at))
        else:
            todo += [(y, path_of(at, y.key)) for y in x.held if y.key is not None and id(y) in own]
    return {at for _, at in inner} if sum(own[id(x)] for x, _ in inner) >= MOST_OF * own[id(part)] else {path}


def _heads(part: Part) -> bool:
    return any(x.key is not None and x.key.split(".")[0] in HEADINGS for x in preorder(part))


def block_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class Block:
    """A block of a page: its text, and of the element that it stands in the path, the number among its neighbours from the first and from the last, and whether it is a heading."""

    __slots__ = ("first", "heading", "last", "parts", "path", "text")

    def __init__(self, path: int, first: int, last: int, heading: bool) -> None:
        self.path, self.first, self.last, self.heading = path, first, last, heading
        self.parts: list[str] = []

    def again(self) -> Block:
        """What stands in the same element behind an inner block."""
        return Block(self.path, self.first, self.last, self.heading)

    def marks(self) -> tuple[int, int]:
        """The text at its place, by both counts."""
        text = block_hash(self.text)
        return text ^ path_of(self.path, f"+{self.first}"), text ^ path_of(self.path, f"-{self.last}")


def blocks(root: Node, rules: Rules) -> list[Block]:
    """The blocks of a page's main elements, in page order; of the whole page, without what is aside, if it has none of them."""
    here = Block(0, 0, 0, False)
    out = [here]
    hit = 0 in rules.paths
    header = not hit  # a whole page's header is not an article's own
    # What is left to do: a node with its path, its numbers among its neighbours and whether it is within the main element, or the block that is gone back to.
    todo: list[tuple[Node | str, int, int, int, bool] | Block] = [(root, 0, 0, 0, hit)]
    while todo:
        step = todo.pop()
        if isinstance(step, Block):
            here = step
            out.append(here)
            continue
        node, path, first, last, inside = step
        if isinstance(node, str):
            here.parts.append(html.unescape(node))
            continue
        if node.name in BLOCKS:
            todo.append(here.again())
            here = Block(path, first, last, here.heading or node.name in HEADINGS)
            out.append(here)
        elif node.name in ("td", "th", "br") and inside:
            here.parts.append(" ")
        many = sum(not isinstance(x, str) for x in node.held)
        k = many
        for x in reversed(node.held):
            if isinstance(x, str):
                if inside:
                    todo.append((x, 0, 0, 0, True))
                continue
            k -= 1
            at = path_of(path, x.key)
            if inside:
                if x.name == "br" or (x.name not in VOID and not _aside(x.key, header, at, rules.kept)):
                    todo.append((x, at, k, many - 1 - k, True))
            elif not _aside(x.key, False, at, rules.kept):
                if at in rules.paths:
                    hit = True
                    todo += [here.again(), (x, at, 0, 0, True), here.again()]
                else:
                    todo.append((x, at, 0, 0, False))
    if not hit:
        return blocks(root, Rules({0}, rules.template, rules.kept))
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def main_text(page: str | None, rules: Rules) -> str:
    """The blocks of a page's main elements without the host's template.

    Headings and bylines stay, whatever a host repeats. A page that is little
    but template is a copy, and keeps it.
    """
    found = blocks(parse(page), rules)
    own = found
    if rules.template:
        own = [b for b in found if b.heading or BYLINE.match(b.text) or rules.template.isdisjoint(b.marks())]
        if sum(len(b.text) for b in own) < (1 - TEMPLATE_SHARE) * sum(len(b.text) for b in found):
            own = found
    return "\n\n".join(b.text for b in own)


def host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (pickled), n (pages): every page of a host is aligned into its wrapper.

    Each partition aligns its own pages first, so a hot host's pages stay
    where they are. The partial wrappers, which hold no texts, are then
    aligned in a tree: some ``MOST_ALIGNED`` of a host in a task at a time,
    until no host has more.
    """
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.binary()), ("n", pa.int64())])

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from batches(((k, w.dumps(), w.pages) for k, w in known.items()), schema, weight=1)
            known.clear()

        for part in parts:
            for name, page in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                new = Wrapper.of(page.as_py())
                if name in known:
                    held -= known[name].parts
                    known[name].add(new)
                else:
                    known[name] = new
                held += known[name].parts
                if held > MOST_HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for data in sorted(pdf["wrapper"]):
            if whole is None:
                whole = Wrapper.loads(data)
            else:
                whole.add(Wrapper.loads(data))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [whole.dumps()], "n": [pdf["n"].sum()]})

    names = "host string, wrapper binary, n long"
    parts = save(pages.select(host().alias("host"), F.col("html").cast("string")).mapInArrow(partial, names))
    turn = 0
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > MOST_ALIGNED:
        turn += 1
        salt = F.pmod(F.xxhash64("wrapper", "n", F.lit(turn)), F.lit(-(-most * 2 // MOST_ALIGNED)))
        parts = save(parts.withColumn("_s", salt).groupBy("host", "_s").applyInPandas(lambda pdf: joined(pdf), names))
    return parts.groupBy("host").applyInPandas(joined, names)


def _rules(wrappers: DataFrame) -> DataFrame:
    """host, rules (pickled: main paths, template, kept paths), n: the little of a wrapper that its pages need."""
    schema = pa.schema([("host", pa.string()), ("rules", pa.binary()), ("n", pa.int64())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for r in part.to_pylist():
                known = Wrapper.loads(r["wrapper"])
                kept = kept_paths(known)
                yield r["host"], pickle.dumps((main_paths(known, kept), known.template if len(known.seen) >= TEMPLATE_PAGES else set(), kept)), r["n"]

    return wrappers.mapInArrow(lambda it: batches(rows(it), schema, weight=1), "host string, rules binary, n long")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Blocks of the main text are joined by two line ends. Null html is empty
    and gives an empty text; pages without a host share one wrapper; repeated
    rows each give a row; an empty table gives an empty result; other columns
    are ignored.
    """
    found = save(_rules(host_wrappers(pages)))
    size, rows = found.agg(F.coalesce(F.sum(F.octet_length("rules")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host().alias("host"))
    joined = named.join(F.broadcast(found), "host", "left") if size <= MOST_BROADCAST else attach(save(named), found, ["host"], rows)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            rules: dict[str, Rules] = {}
            for i, url, page, name, data in zip(*(part.column(k) for k in range(5)), strict=True):
                name = name.as_py()
                if name not in rules:
                    rules[name] = Rules(*pickle.loads(data.as_py()))
                text = main_text(page.as_py(), rules[name])
                yield i.as_py(), url.as_py(), text, len(text)

    out = joined.select(F.col("page_id").cast("long"), "url", "html", "host", "rules").mapInArrow(
        lambda it: batches(rows_of(it), schema, weight=2), "page_id long, url string, text string, n_chars long"
    )
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
