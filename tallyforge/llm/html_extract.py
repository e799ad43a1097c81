"""Main text of web pages by template deduction over equivalence classes.

A page's tokens are its elements, each told by its path from the root with the classes and ids of containers, and
the words of its text, each told by the path of the block element it stands in and by how often that block held the
word before. Over the pages of a host every token has an occurrence vector: how often it stands on each page.
Tokens with the same vector form an equivalence class. A class is valid if it stands on at least ``SUPPORT`` of the
host's pages; its words nest in the class of the element around them or stand once on each page, and each follows the
same word of its block on all pages, so that they come in one order. Valid classes make the host's template. A block whose words are all of one class of it is
template text and left out: menus, headers, footers, notices and labels, whatever they are called. A block with any other
word is a slot and kept whole, so that a label stays with its value.

Elements that stand once on each page nest into the template's tree, and the slots hang in it. Where each slot's text lies is
added up over the host: the main slots are those within the deepest container that holds ``MASS`` of all words outside
links, so menus, adverts, headers and footers that differ on every page go with the rest of the tree, whatever they are called;
a container that is mostly links is a menu within it too. All other slots there are extracted.

Vectors are compared by fingerprint, the exclusive or of a hash of page and count, and orders by the hash of the word
before, so that a host's pages are never gathered. Words are counted in two passes: what stands on ``SUPPORT`` of a
host's pages stands on as many of its pages in some part of them, so only what does is counted over all pages.

Names settle what a template cannot tell. Scripts, styles, forms and the like are no text; within the main slots,
adverts, asides, reader comments and links to other pages are left out by element name, role, class or id
(``SLOT_WORDS``). Hosts of fewer than ``LEAST_PAGES`` different pages have no template, and some pages lack the main slots
of their host; there, and only there, menus, headers and footers go by name too, and a page with article or main
elements gives the text within them.

Character references are decoded, white space (as Unicode has it) within a block becomes one space, blocks are joined
in page order by one space. Null and empty pages have an empty text; a null url is a host of its own, as is one
without a host; unclosed and crossed tags are repaired as browsers do in outline, however deep they nest. Repeated rows
count as pages but cancel out of a vector alike for all its tokens; classes with equal vectors are one. Other columns,
whatever their names, are ignored. Pages are read in slices of bounded size, long ones whole.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import BROADCAST_BYTES, BROADCAST_ROWS, join_small, sliced, written

SUPPORT = 0.5
#: Fewest different pages of a host that tell template from text.
LEAST_PAGES = 4
#: Tokens that a task holds before it tells the frequent ones.
HELD = 1_500_000
#: Share of a host's words outside links that the main slots hold, and of a menu's words that are links.
MASS, LINKS = 0.8, 2 / 3

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head form script style noscript template iframe button select option textarea dialog svg math object video audio canvas title noembed noframes".split())
CHROME = frozenset("nav header footer menu".split())
SLOT_NAMES = frozenset(["aside"])
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MAIN = frozenset("article main".split())
MAIN_ROLES = frozenset("main article".split())
CHROME_ROLES = frozenset("navigation banner contentinfo search menu menubar".split())
SLOT_ROLES = frozenset("complementary form dialog alertdialog".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
# Words of classes and ids: of slots that are no article, and of what the pages of a host share.
SLOT_WORDS = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert|adverts|advertisement|advertising|adbox|sponsor|sponsored|promo|promotion|popup|modal|breadcrumb|breadcrumbs|sidebar|aside|"
    r"comment|comments|disqus|replies|reply|respond|related|recommended|widget|pagination|pager)(?:$|[-_\s\d])",
    re.I,
)
CHROME_WORDS = re.compile(
    r"(?:^|[-_\s])(?:banner|cookie|cookies|consent|gdpr|notice|notices|newsletter|subscribe|signup|nav|navbar|navigation|menu|footer|masthead|topbar|toolbar|share|sharing|social|login|search)(?:$|[-_\s\d])",
    re.I,
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Attributes that count.
TELLING = re.compile(r"class|id|role|hidden|itemprop", re.I)
CONTAINERS = frozenset("div section article main aside nav header footer body ul ol table form".split())


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}


#: What names say of an element: text that counts, what host pages share, slots that are no article, and no text.
TEXT, SHARED, ASIDE, NONE = 0, 1, 2, 3


def _told(name: str, attributes: dict[str, str]) -> int:
    if name in UNSEEN:
        return NONE
    told = ASIDE if name in SLOT_NAMES else SHARED if name in CHROME else TEXT
    if not attributes:
        return told
    role = attributes.get("role", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return NONE
    if role in SLOT_ROLES:
        return ASIDE
    if role in CHROME_ROLES:
        told = max(told, SHARED)
    if name in ("body", "html") or name in MAIN:
        return told
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return ASIDE if SLOT_WORDS.search(names) else max(told, SHARED) if CHROME_WORDS.search(names) else told


@functools.lru_cache(20_000)
def _element(name: str, raw: str) -> tuple[str, bool, int]:
    """An element's own part of the path, whether names tell it to be main, and what else they tell."""
    attributes = _attributes(raw)
    own = name
    if name in CONTAINERS and (attributes.get("class") or attributes.get("id")):
        own += "." + re.sub(r"\d+", "0", " ".join(f"{attributes.get('class', '')}#{attributes.get('id', '')}".split()))
    by_name = name in MAIN or attributes.get("role", "").lower() in MAIN_ROLES or attributes.get("itemprop", "") == "articleBody"
    return own, by_name, _told(name, attributes)


@functools.lru_cache(50_000)
def _below(path: str, own: str) -> str:
    return xxhash.xxh3_64_hexdigest(f"{path}/{own}")


@functools.cache
def _end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def walk(html: str, region: str | None = None, menus: frozenset[str] | set[str] = frozenset()) -> Iterator[tuple[str, object]]:
    """("open", path), ("break", None), ("text", (block, text, told, in_main)) in page order, and ("region", (path, words,
    links, depth)) for each container that ends and at last for the page, with the words in all of it.

    ``region``: the path of the main slots, else main is told by names; ``menus``: paths of asides.

    A path is the hash of the path above and the element's own name, so that it stays short. A block is the number
    and path of the block element around a text; the page itself is number 0.
    """
    stack: list[tuple[str, str, int, bool, tuple[int, str]]] = []  # name, path, told by names, in main, block
    outside = ("", "", TEXT, False, (0, ""))
    held = [[0, 0]]  # words and links so far, of the page and of each open element
    opened: Counter = Counter()
    at, size, blocks, search = 0, len(html), 0, TOKEN.search

    def close(upto: int) -> Iterator[tuple[str, object]]:
        while len(stack) > upto:
            name, path, *_ = stack.pop()
            opened[name] -= 1
            words, links = held.pop()
            held[-1][0] += words
            held[-1][1] += links
            if name in CONTAINERS:
                yield "region", (path, words, links, len(held))
            if name not in INLINE:
                yield "break", None

    def text(raw: str) -> tuple[str, object]:
        _, _, told, main, block = stack[-1] if stack else outside
        plain = unescape(raw) if "&" in raw else raw
        if told < ASIDE:
            n = len(plain.split())
            last = held[-1]
            last[0] += n
            if opened["a"]:
                last[1] += n
        return "text", (block, plain, told, main)

    while at < size:
        found = search(html, at)
        if found is None:
            yield text(html[at:])
            break
        begin = found.start()
        if begin > at:
            yield text(html[at:begin])
        at = found.end()
        closing, name, rest = found.groups("")
        if not name:
            continue
        name = name.lower()
        if closing:
            if not opened[name]:
                if name in ("p", "br"):
                    yield "break", None
                continue
            if stack[-1][0] == name and name not in CONTAINERS:  # the usual case
                stack.pop()
                opened[name] -= 1
                words, links = held.pop()
                held[-1][0] += words
                held[-1][1] += links
                if name not in INLINE:
                    yield "break", None
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    yield from close(k)
                    break
            continue
        if name not in INLINE:
            yield "break", None
        if name in VOID:
            continue
        if name in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    yield from close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in SIBLINGS and any(opened[x] for x in SIBLINGS[name]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SCOPES.get(name, ()) or name == "p":
                    break
                if stack[k][0] in SIBLINGS[name]:
                    yield from close(k)
                    break
        own, by_name, own_told = _element(name, rest if rest and TELLING.search(rest) else "")
        above = stack[-1] if stack else outside
        path = _below(above[1], own)
        main = above[3] or (by_name if region is None else path == region)
        told = max(above[2], ASIDE if path in menus else own_told)
        if name in ("svg", "path") and rest.endswith("/"):
            continue
        block = above[4]
        if name not in INLINE:
            blocks += 1
            block = (blocks, path)
        stack.append((name, path, told, main, block))
        held.append([0, 0])
        opened[name] += 1
        yield "open", path
        if name in RAW:
            end = _end(name).search(html, at)
            upto = end.start() if end else size
            if name in ("title", "textarea") and upto > at:
                yield text(html[at:upto])
            at = end.end() if end else size
            yield from close(len(stack) - 1)
    yield from close(0)
    yield "region", ("", *held[0], 0)


def _tokens(blocks: dict[tuple[int, str], list[str]]) -> Iterator[tuple[tuple[int, str], list[str]]]:
    """The word tokens of each block: path, word and, after its first time in the block, how often it came before."""
    for block, parts in blocks.items():
        words = Counter("".join(parts).split())
        yield block, [f"{block[1]}\t{w}" if j == 0 else f"{block[1]}\t{w}\t{j}" for w, n in words.items() for j in range(n)]


def outline(html: str | None, known: dict[str, set[str]] | None = None) -> tuple[dict[str, Counter], dict[str, list[int]], dict[tuple[str, str], str]]:
    """How often each token stands on a page, by path: "" for the element, and the words of what may be text; the
    words, links and depth of each container, and of the page as the path "", which counts as an element too; and by
    path the word before each word where a block has it first, several joined. ``known``: the only tokens, by path, that count."""
    found: dict[str, Counter] = {"": Counter({"": 1})}
    regions: dict[str, list[int]] = {}
    blocks: dict[tuple[int, str], list[str]] = {}
    before: dict[tuple[str, str], str] = {}
    broken = False
    for kind, value in walk(html or ""):
        if kind == "open":
            held = found.get(value)
            if held is None:
                held = found[value] = Counter()
            held[""] += 1
        elif kind == "region":
            held = regions.setdefault(value[0], [0, 0, value[3]])
            held[0] += value[1]
            held[1] += value[2]
        elif kind == "break":
            broken = True
        elif value[2] < ASIDE and (known is None or value[0][1] in known):
            blocks.setdefault(value[0], []).append(f" {value[1]}" if broken else value[1])
            broken = False
    for (_, path), parts in blocks.items():
        words = "".join(parts).split()
        at = found.setdefault(path, Counter())
        if known is None:
            times = Counter(words)
            at.update(times.keys())
            at.update(f"{w}\t{j}" for w, n in times.items() if n > 1 for j in range(1, n))
            continue
        wanted, seen, last = known[path], Counter(), ""
        for w in words:
            if w in wanted:
                n = seen[w]
                seen[w] = n + 1
                at[f"{w}\t{n}" if n else w] += 1
                if not n:
                    before[path, w] = last if before.get((path, w), last) == last else f"{before[path, w]} {last}"
            last = w
    return found, regions, before


class _Every(dict):
    """Of all paths, all tokens."""

    def __contains__(self, key) -> bool:
        return True

    def __getitem__(self, key):
        return self

    def get(self, key, default=None):
        return self


class Template:
    """Of a host: the class of each template word, the path of the main slots, and those of menus."""

    def __init__(self, words: dict[str, int], region: str = "", menus: set[str] | frozenset[str] = frozenset()):
        self.words, self.region, self.menus = words, region, menus


def _texts(html: str | None, most: int, template: Template | None = None) -> tuple[list[tuple | None], dict[tuple[int, str], list[str]]]:
    """The pieces of text in page order, None where a block ends, and those of each block; what is told to be above
    ``most`` is left out."""
    pieces: list[tuple | None] = []
    blocks: dict[tuple[int, str], list[str]] = {}
    broken = False
    for kind, value in walk(html or "", template.region or None, template.menus) if template else walk(html or ""):
        if kind == "break":
            broken = True
            pieces.append(None)
        elif kind == "text" and value[2] <= most:
            blocks.setdefault(value[0], []).append(f" {value[1]}" if broken else value[1])
            broken = False
            pieces.append(value)
    return pieces, blocks


def extract(html: str | None, template: Template | None) -> str:
    """Main text of a page, by its host's template or, without one or where its main slots are missing, by names."""
    pieces, blocks = _texts(html, SHARED if template else TEXT, template)
    inside = any(p is not None and p[3] and p[1].strip() for p in pieces)
    if template and template.region and not inside:
        return extract(html, None)
    fixed = set()
    if template:
        for block, tokens in _tokens(blocks):
            classes = {template.words.get(t) for t in tokens}
            if len(classes) == 1 and None not in classes:
                fixed.add(block)
    only_main = inside and (template is None or template.region != "")
    out: list[str] = []
    current: list[str] = []
    for piece in [*pieces, None]:
        if piece is None:
            text = " ".join("".join(current).split())
            if text:
                out.append(text)
            current.clear()
        elif piece[0] not in fixed and (piece[3] or not only_main):
            current.append(piece[1])
    return " ".join(out)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, tokens and classes (arrays of equal length) of the template words of the hosts of ``pages`` (host, html)
    that have enough different pages, region (path of the main slots) and menus (paths), written."""
    each = pages.groupBy("host", F.xxhash64("html").alias("page")).agg(F.count("*").alias("n"))
    sizes = written(each.groupBy("host").agg(F.sum("n").alias("n"), F.count("*").alias("different")).filter(F.col("different") >= least_pages).select("host", "n"))
    able = join_small(pages.select("host", "html"), sizes, ["host"], "inner").select("host", "html")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        found: dict[tuple[str, str], Counter] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(name, f"{path}\t{t}") for (name, path), tokens in found.items() for t, n in tokens.items() if n >= support * seen[name]]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["host", "token"])

        for batch in sliced(batches, "html"):
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[name] += 1
                for path, tokens in outline(html)[0].items():
                    held = found.setdefault((name, path), Counter())
                    size -= len(held)
                    held.update(tokens.keys())
                    size += len(held)
            if size > HELD:
                yield out()
                seen.clear()
                found.clear()
                size = 0
        yield out()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            found: dict[tuple, list] = {}
            hashes: dict[str, int] = {}
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = xxhash.xxh3_64_intdigest((html or "").encode())
                prints: dict[int, int] = {}
                known = every if wanted is None else wanted.get(name, {})
                tokens_at, regions, before = outline(html, known)
                for path, tokens in tokens_at.items():
                    for t in tokens if wanted is None else tokens.keys() & known.get(path, nothing):
                        n = tokens[t]
                        if n not in prints:
                            prints[n] = xxhash.xxh3_64_intdigest(f"{page}:{n}".encode())
                        row = found.setdefault((name, f"{path}\t{t}"), [0, 0, 0, 0, 0, 0, None, None])
                        row[0] += 1
                        row[1] += n == 1
                        row[2] ^= prints[n]
                        if not t and path in regions:
                            row[3] += regions[path][0]
                            row[4] += regions[path][1]
                            row[5] = regions[path][2] + 1
                        last = before.get((path, t))
                        if last is not None:  # the word before: the same on all pages where a class comes in order
                            h = hashes.get(last)
                            if h is None:
                                h = hashes[last] = xxhash.xxh3_64_intdigest(last.encode()) - (1 << 63)
                            row[6], row[7] = (h, h) if row[6] is None else (min(row[6], h), max(row[7], h))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string())]
                + [pa.array([v[j] for v in found.values()], pa.int64()) for j in (0, 1, 3, 4, 5)]
                + [pa.array([v[2] - (1 << 64) if v[2] >> 63 else v[2] for v in found.values()], pa.int64())]
                + [pa.array([v[j] for v in found.values()], pa.int64()) for j in (6, 7)],
                names=["host", "token", "pages", "once", "words", "links", "depth", "vector", "low", "high"],
            )

    candidates = written(able.mapInArrow(frequent, "host string, token string").distinct())
    wanted: dict[str, dict[str, set[str]]] | None = None
    nothing: set[str] = set()
    every = _Every()
    rows, size = candidates.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("token")), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        wanted = {}
        for name, token in candidates.toLocalIterator():
            path, _, t = token.partition("\t")
            wanted.setdefault(name, {}).setdefault(path, set()).add(t)
    tokens = able.mapInArrow(counted, "host string, token string, pages long, once long, words long, links long, depth long, vector long, low long, high long")
    if wanted is None:
        tokens = tokens.join(candidates, ["host", "token"], "left_semi")
    tokens = tokens.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "once", "words", "links")], F.max("depth").alias("depth"), F.bit_xor("vector").alias("vector"), F.min("low").alias("low"), F.max("high").alias("high"))
    tokens = written(tokens.withColumn("path", F.substring_index("token", "\t", 1)).withColumn("is_word", F.length("token") > F.length("path") + 1))
    valid = join_small(tokens, sizes, ["host"], "inner").filter(F.col("pages") >= support * F.col("n")).drop("n")
    # The template's tree: containers that stand once on each page, with the text that they hold on all of them.
    places = valid.filter("not is_word and once = pages and depth > 0")
    whole = places.filter("depth = 1").select("host", (F.col("words") - F.col("links")).alias("mass"))
    places = written(join_small(places, written(whole), ["host"], "inner").select("host", "path", "words", "links", "depth", "mass"))
    main = places.filter(F.col("words") - F.col("links") >= F.lit(MASS) * F.col("mass")).groupBy("host").agg(F.max(F.struct("depth", "path")).alias("m"))
    menu = places.filter((F.col("links") >= F.lit(LINKS) * F.col("words")) & (F.col("links") > 0) & (F.col("depth") > 1)).groupBy("host").agg(F.collect_list("path").alias("menus"))
    tree = written(sizes.select("host").join(main, "host", "left").join(menu, "host", "left").select("host", F.coalesce("m.path", F.lit("")).alias("region"), F.coalesce("menus", F.array().cast("array<string>")).alias("menus")))
    # A word that comes again in its block ("word, tab, number") goes by its first time for the order.
    # Words nest in the class of the element around them, or stand once on each page of their own class.
    around = valid.filter("not is_word").select("host", "path", F.col("vector").alias("element"))
    words = valid.filter("is_word").join(around, ["host", "path"], "left").filter((F.col("once") == F.col("pages")) | F.col("vector").eqNullSafe(F.col("element")))
    return written(_by_host(tree, words.filter("low = high or low is null").select("host", "token", "vector")))


def _by_host(tree: DataFrame, words: DataFrame) -> DataFrame:
    """One row per host of ``tree``, with its template words and their classes."""
    of_host = words.groupBy("host").agg(F.collect_list(F.struct("token", "vector")).alias("t"))  # what half of its pages share
    none = F.array().cast("array<struct<token:string,vector:bigint>>")
    joined = tree.join(of_host, "host", "left").withColumn("t", F.coalesce("t", none))
    return joined.select("host", F.col("t.token").alias("tokens"), F.col("t.vector").alias("classes"), "region", "menus")


def _known(names: list[str], tokens: pa.Array, classes: pa.Array, regions: pa.Array, menus: pa.Array) -> dict[str, Template | None]:
    """The template of each host of a batch; None for hosts without one."""
    known: dict[str, Template | None] = {}
    for k, name in enumerate(names):
        if name not in known:
            known[name] = Template(dict(zip(tokens[k].as_py(), classes[k].as_py())), regions[k].as_py(), set(menus[k].as_py())) if tokens[k].is_valid else None
    return known


def extracted(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """page_id, url and text of every row of ``pages``."""
    hosted = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    joined = join_small(hosted, templates(hosted, support), ["host"], "left").select("page_id", "url", "host", "html", "tokens", "classes", "region", "menus")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            names = batch.column(2).to_pylist()
            known = _known(names, *batch.columns[4:])
            texts = [extract(html, known[name]) for name, html in zip(names, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")


def html_query(pages: DataFrame) -> DataFrame:
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
