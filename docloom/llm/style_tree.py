"""Main-text extraction by a site style tree.

The DOMs of a host's distinct pages merge into one tree: a node is a path of block
elements (tags and classes, digits aside), known by a 64-bit key.  A node has
  content    the words of its own text.  A word on n of the m pages that show text
             there has entropy log n / log m; content importance C is one minus the
             mean over the node's distinct words (1 where m = 1): menus, adverts and
             footers draw on few words, again and again, prose on ever new ones;
  context    the mean share S of the page's words that the node shows, the mean share K
             of its distinct words that other nodes of the page show too, and the
             mean share L of its characters inside links;
  style      the sequence of its child elements and the order of magnitude of its
             text; presentation importance P is the entropy of its styles to the base
             of STYLES, or that of its parent where that is greater.
A node's importance is C (1 - L) sqrt(1 - (1 - S)(1 - K)).  Hosts with few pages lean on
the mean of all hosts.  In log-odds, the importance gets PRESENTED (P - 1/4) and a
prior: + INSIDE in an article or main, + HEADING for headings, NAMED in a branch whose
tag, role, class or id names a menu, header, footer, aside, form, notice, advert or
comments.  A name does not count for a block that holds main or h1, and, but for strong
names (STRONG), one that holds an article or more than half of the page's text.
A node below LOW is unimportant: its text leaves every page, so that a branch without
an important node leaves as a whole.  Hidden elements are not part of the page.

Features travel as packed counts in parts of bounded size, so that no host, node or
word meets in one task.  The unimportant nodes are broadcast up to BROADCAST_NODES;
beyond that, pages and nodes meet by salted host in one sorted stream.

Defined results: null html and pages without main text give an empty text; pages
whose url is null or has no host share one tree; repeated rows give repeated results
and count once in the tree; unclosed and misplaced tags are repaired as below (an
unclosed script, style, title, textarea or comment runs to the end); an empty table
gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bayes_join import mixed
from docloom.llm.common import slices, split_words, stored

LOW, LEAN, STYLES, PRESENTED, INSIDE, HEADING, NAMED = 0.4, 8, 64, 2.0, 2.0, 1.0, -2.5
FLUSH, PAGES_A_PART, MOST_PARTS, SALTS, BROADCAST_NODES = 1_500_000, 2000, 1 << 18, 32, 1_000_000
LOW_BITS = np.uint64((1 << 40) - 1)

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
UNSEEN = frozenset("head template noscript svg select datalist object audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li summary".split())
#: An item closes an open one of its kind within its own list or table.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("thead",), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names, each a prior only: tags and roles, and the words of classes and ids.
STRONG = frozenset("nav footer aside button dialog menu".split())
WEAK = frozenset("form fieldset header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
READERS = frozenset("comment comments disqus replies reply respond".split())
WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert alerts announcement banner breadcrumb breadcrumbs consent cookie cookies footer header login masthead "
    "menu menubar modal nav navbar navigation navlinks newsletter notice notices notification pager pagination popup promo promoted promotion recommended related share sharing "
    "sidebar sidenav signup skip social sponsor sponsored subscribe subscription subnav toolbar topbar topnav widget widgets".split()
)
#: Words that only shape a name: the word before them names the block.
SHAPES = frozenset("area articles bar block body bottom box button buttons container content form group inner item items left link links list main outer panel posts right row section slot thread title top unit wrap wrapper".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</[^a-zA-Z][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL, GAPS, DIGITS = re.compile(r"([a-z])([A-Z])"), re.compile(r"[_:-]+"), re.compile(r"\d+")


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if raw.strip(" /"):
        for m in ATTRIBUTE.finditer(raw):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


class Node:
    """An open block element, and what placed() finds of it."""

    __slots__ = ("tag", "parent", "label", "hidden", "name", "article", "children", "own", "size", "holds", "main", "named", "key")

    def __init__(self, tag: str, parent: Node | None, label: str, hidden: bool, name: str, article: bool):
        self.tag, self.parent, self.label, self.hidden, self.name, self.article = tag, parent, label, hidden, name, article
        self.children, self.own, self.size, self.holds, self.main, self.named, self.key = [], 0, 0, False, False, False, 0

    def prior(self) -> float:
        if self.named:
            return NAMED
        return INSIDE * self.article + HEADING * (self.tag in HEADINGS)


def name_of(tag: str, given: dict[str, str], article: bool) -> str:
    """`strong`, `weak` or nothing: how far an element's tag, role, class and id name it as noise."""
    if tag in ("html", "body", "main"):
        return ""
    role = given.get("role", "").lower()
    if tag in STRONG or role in ROLES - {"form", "banner"}:
        return "strong"
    found = "weak" if (tag in WEAK and not (tag == "header" and article)) or role in ROLES else ""
    for token in CAMEL.sub(r"\1-\2", f"{given.get('class', '')} {given.get('id', '')}").lower().split():
        words = [w.rstrip("0123456789") for w in GAPS.split(token)]
        words = [w for w in words if w]
        while len(words) > 1 and words[-1] in SHAPES:
            words.pop()
        if words and words[-1] in READERS:
            return "strong"
        if words and words[-1] in WORDS and tag != "article" and not (article and words[-1] == "header"):
            found = "weak"
    return found


@functools.lru_cache(maxsize=1 << 14)
def described(tag: str, raw: str, article: bool) -> tuple[str, bool, str, bool]:
    """Label, whether hidden, name and whether an article or main, of an element by what its tag says."""
    given = attributes(raw)
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or bool(HIDDEN.search(given.get("style", "")))
    label = tag + "".join(sorted({"." + DIGITS.sub("#", c) for c in given.get("class", "").split()}))
    return label, hidden, name_of(tag, given, article), article or tag in ("article", "main") or given.get("role") == "main"


def opened(parent: Node, tag: str, raw: str) -> Node:
    # long attributes (embedded data) are not worth keeping
    label, hidden, name, article = (described if len(raw) < 200 else described.__wrapped__)(tag, raw, parent.article)
    return Node(tag, parent, label, parent.hidden or hidden, name, article)


def walk(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Nodes in page order, and blocks of visible text (node, text, characters inside links), in linear time."""
    root = Node("", None, "", False, "", False)
    nodes, found, stack = [root], [], [root]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack a tag is open
    lasts: dict[str, int] = {}  # where a tag closes for the last time
    text: list[str] = []
    linked, inside, quotes = 0, False, True
    at, last = 0, page.rfind(">")

    def put(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        linked += len(piece) if inside else 0

    def flush() -> None:
        nonlocal linked, inside
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined and not stack[-1].hidden:
                found.append((stack[-1], joined, linked))
            text.clear()
        linked, inside = 0, False

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def top(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while True:
        lt = page.find("<", at) if at <= last else -1
        if lt < 0 or lt > last:
            put(page[at:])
            break
        if lt > at:
            put(page[at:lt])
        m = (TAG if quotes else BARE_TAG).match(page, lt)
        if not m:
            other = OTHER.match(page, lt)
            if other:
                at = other.end()
            elif quotes and BARE_TAG.match(page, lt):  # every > behind is quoted: from here quotes hide none
                quotes, at = False, lt
            else:
                put("<")
                at = lt + 1
            continue
        at = m.end()
        closing, tag, raw = bool(m[1]), m[2].lower(), m[3]
        if tag in INLINE:
            if tag == "a":
                inside = not closing
            continue
        if tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
            continue
        if tag in RAW and not closing:
            if not raw.endswith("/"):
                ends = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = ends.end() if ends else len(page)
            if tag not in ("script", "style"):
                text.append(" ")
            continue
        flush()
        if tag in VOID or tag in RAW:
            continue
        if closing:
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in ENDS:
            mine, limits = ENDS[tag]
            k = top(mine)
            if k and k > top(limits):
                close(k)
        if tag in UNSEEN:  # an unclosed one hides nothing
            if tag not in lasts:
                lasts[tag] = max((x.start() for x in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
            if at > lasts[tag]:
                continue
        node = opened(stack[-1], tag, raw)
        node.hidden |= tag in UNSEEN
        stack[-1].children.append(tag)
        places[tag].append(len(stack))
        stack.append(node)
        nodes.append(node)
    flush()
    return nodes, found


def key_of(parent: int, step: str) -> int:
    return xxhash.xxh3_64_intdigest(parent.to_bytes(8, "little") + step.encode("utf-8", "surrogatepass"))


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """walk() with the nodes' names judged and their keys set."""
    nodes, found = walk(page)
    for node, text, _ in found:
        node.own += text.count(" ") + 1
        node.size += len(text)
    total = sum(node.size for node in nodes)
    for node in reversed(nodes[1:]):  # children before parents
        if node.name == "strong":
            node.named = not node.main
        elif node.name:
            node.named = not (node.main or node.holds or 2 * node.size > total)
        up = node.parent
        up.size += node.size
        up.main |= node.main or ((node.tag in ("main", "h1")) and not node.hidden)
        up.holds |= node.holds or (node.tag == "article" and not node.named)
    for node in nodes[1:]:
        node.named |= node.parent.named
        node.key = key_of(node.parent.key, node.label + "!" * node.named)
    return nodes, found


def style_of(node: Node) -> int:
    runs: list[list] = []
    for tag in node.children:
        if runs and runs[-1][0] == tag:
            runs[-1][1] += 1
        else:
            runs.append([tag, 1])
    shape = " ".join(f"{tag}{n.bit_length()}" for tag, n in runs)
    return xxhash.xxh3_64_intdigest(f"{shape}|{node.own.bit_length()}")


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is faster here than hashing."""
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=values[:1] - 1))]


class Tree:
    """What a run of pages adds to the style trees of their sites."""

    def __init__(self):
        self.groups: dict[tuple[int, int], int] = {}  # (site, node) to its row in about
        self.about: list[tuple[int, int, int, float]] = []  # site, node, parent, prior
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # (group << 40 | feature, pages)
        self.sums = np.zeros((0, 4))  # pages with text, and sums of S, K, L
        self.size = 0

    def group(self, site: int, key: int, parent: int, prior: float) -> int:
        at = self.groups.setdefault((site, key), len(self.about))
        if at == len(self.about):
            self.about.append((site, key, parent, prior))
        return at

    def add(self, sites: list[int], pages: list[str]) -> None:
        texts, page_of, group_of, linked, styles, style_group = [], [], [], [], [], []
        for number, (site, page) in enumerate(zip(sites, pages, strict=True)):
            nodes, found = blocks(page)
            at = {}
            for node in nodes:
                if not node.hidden:
                    at[id(node)] = g = self.group(site, node.key, node.parent.key if node.parent else 0, node.prior())
                    style_group.append(g)
                    styles.append(style_of(node))
            for node, text, n in found:
                texts.append(text)
                page_of.append(number)
                group_of.append(at[id(node)])
                linked.append(n)
        n_groups = len(self.about)
        self.sums = np.concatenate([self.sums, np.zeros((n_groups - len(self.sums), 4))])
        # styles count instances, in groups of their own behind those of words
        self.count(np.array(style_group, np.uint64) * np.uint64(2) + np.uint64(1), np.array(styles, np.uint64))
        if not texts:
            return
        page_at, group_at = np.array(page_of, np.int64), np.array(group_of, np.int64)
        codes, offsets, words = split_words(pa.array(texts, pa.string()))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
        sizes = np.diff(offsets)
        pairs, pair_of = np.unique(page_at * n_groups + group_at, return_inverse=True)
        pair_page, pair_group = pairs // n_groups, pairs % n_groups
        share = np.bincount(pair_of, sizes, len(pairs)) / np.bincount(page_at, sizes, len(pages))[pair_page]
        chars = np.bincount(pair_of, [len(t) for t in texts], len(pairs))
        links = np.minimum(1, np.bincount(pair_of, linked, len(pairs)) / chars)
        triples = distinct(np.repeat(pair_of, sizes) * len(words) + codes)
        pair, code = triples // len(words), triples % len(words)
        _, same, shown = np.unique(pair_page[pair] * len(words) + code, return_inverse=True, return_counts=True)
        common = np.bincount(pair, shown[same] > 1, len(pairs)) / np.bincount(pair, minlength=len(pairs))
        for k, values in enumerate((np.ones(len(pairs)), share, common, links)):
            self.sums[:, k] += np.bincount(pair_group, values, n_groups)
        self.count(pair_group[pair].astype(np.uint64) * np.uint64(2), hashes[code])

    def count(self, group: np.ndarray, feature: np.ndarray) -> None:
        value, n = np.unique(group << np.uint64(40) | feature & LOW_BITS, return_counts=True)
        self.held.append((value, n.astype(np.uint32)))
        self.size += len(value)

    def rows(self, parts: int) -> pa.RecordBatch:
        """One row a part of features and one a node; the tree is empty afterwards."""
        value = np.concatenate([v for v, _ in self.held]) if self.held else np.zeros(0, np.uint64)
        n = np.concatenate([c for _, c in self.held]) if self.held else np.zeros(0, np.uint32)
        order = np.argsort(value, kind="stable")
        value, n = value[order], n[order]
        first = np.flatnonzero(np.diff(value, prepend=value[:1] ^ np.uint64(1)) != 0)
        value, n = value[first], (np.add.reduceat(n, first) if len(first) else n)
        site, node = (np.array([a[k] for a in self.about], np.int64 if k == 0 else np.uint64) for k in (0, 1))
        group = (value >> np.uint64(41)).astype(np.int64)
        kind = (value >> np.uint64(40)) & np.uint64(1)
        part = (mixed(value & LOW_BITS ^ mixed(site.astype(np.uint64)[group] + node[group])) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, value, n, group, kind = part[order], value[order], n[order], group[order], kind[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        data = []
        for a, b in zip(cuts, np.append(cuts[1:], len(part))[: len(cuts)], strict=True):
            inner = np.flatnonzero(np.diff(value[a:b] >> np.uint64(40), prepend=np.uint64(1 << 63)) != 0)
            g = group[a:b][inner]
            low = value[a:b] & LOW_BITS
            data.append(b"".join(x.tobytes() for x in (
                np.array([len(inner), b - a], np.uint32), site[g], node[g], kind[a:b][inner].astype(np.uint8), np.diff([*inner, b - a]).astype(np.uint32),
                (low & np.uint64(0xFFFFFFFF)).astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8), n[a:b].astype(np.uint32),
            )))
        k, m = len(data), len(self.about)
        node_part = (mixed(node ^ mixed(site.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)
        wide = lambda head, tail, t: pa.array([*head, *tail], t)
        sums = self.sums.T.tolist() if m else [[], [], [], []]
        out = pa.RecordBatch.from_arrays(
            [
                wide(part[cuts].tolist(), node_part.tolist(), pa.int64()), wide(data, [None] * m, pa.binary()),
                wide([None] * k, site.tolist(), pa.int64()), wide([None] * k, node.view(np.int64).tolist(), pa.int64()),
                wide([None] * k, np.array([a[2] for a in self.about], np.uint64).view(np.int64).tolist(), pa.int64()),
                wide([None] * k, [a[3] for a in self.about], pa.float64()), *(wide([None] * k, s, pa.float64()) for s in sums),
            ],
            ["part", "data", "site", "node", "parent", "prior", "m", "s", "k", "l"],
        )
        self.__init__()
        return out


ROWS = "part long, data binary, site long, node long, parent long, prior double, m double, s double, k double, l double"
SUMS = "site long, node long, parent long, prior double, m double, s double, k double, l double, words long, word_log double, shown long, style_log double"


def tree_rows(pages: DataFrame, parts: int) -> DataFrame:
    """(site, html) to packed features and sums of nodes, by part."""

    def run(batches):
        tree = Tree()
        for batch in batches:
            for part in slices(batch, "html"):
                tree.add(part.column("site").to_pylist(), [p or "" for p in part.column("html").to_pylist()])
                if tree.size > FLUSH:
                    yield tree.rows(parts)
        yield tree.rows(parts)

    return pages.select("site", "html").mapInArrow(run, ROWS)


def unpacked(data: bytes) -> list[np.ndarray]:
    """site, node, kind, feature and number of pages of every feature."""
    n, size = np.frombuffer(data, np.uint32, 2).tolist()
    out, at = [], 8
    for kind, count in ((np.int64, n), (np.uint64, n), (np.uint8, n), (np.uint32, n), (np.uint32, size), (np.uint8, size), (np.uint32, size)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    site, node, style, length, low, high, count = out
    spread = [np.repeat(x, length) for x in (site, node, style)]
    return [*spread, low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), count.astype(np.int64)]


def merged_part(data: list[bytes]) -> pa.RecordBatch:
    """Sums over the distinct features of each (site, node) of a part."""
    site, node, style, feature, n = (np.concatenate(x) for x in zip(*map(unpacked, data), strict=True))
    order = np.lexsort((feature, style, node, site))
    site, node, style, feature, n = (x[order] for x in (site, node, style, feature, n))
    new = np.ones(len(site), bool)
    new[1:] = (np.diff(site) != 0) | (np.diff(node) != 0)
    group = np.cumsum(new) - 1
    one = new.copy()
    one[1:] |= (np.diff(style) != 0) | (np.diff(feature) != 0)
    first = np.flatnonzero(one)
    pages = np.add.reduceat(n, first).astype(np.float64)
    of, is_style = group[first], style[first] == 1
    size = int(group[-1]) + 1
    log = np.log(pages)
    sums = [np.bincount(of, w, size) for w in (~is_style, np.where(is_style, 0, log), np.where(is_style, pages, 0), np.where(is_style, pages * log, 0))]
    none = pa.nulls(size, pa.float64())
    columns = [pa.array(site[new]), pa.array(node[new].view(np.int64)), pa.nulls(size, pa.int64()), *[none] * 5]
    columns += [pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2].astype(np.int64)), pa.array(sums[3])]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SUMS.split(", ")])


def merged(rows: DataFrame) -> DataFrame:
    """Rows of tree_rows() to sums by (site, node), several rows a node."""

    def run(batches):
        current, held = None, []
        for batch in batches:
            some = np.array([d is not None for d in batch.column("data").to_pylist()], bool)
            plain = batch.filter(pa.array(~some))
            if plain.num_rows:
                empty = [pa.array(np.zeros(plain.num_rows, t)) for t in (np.int64, np.float64, np.int64, np.float64)]
                yield pa.RecordBatch.from_arrays([*(plain.column(c) for c in ("site", "node", "parent", "prior", "m", "s", "k", "l")), *empty], [c.split()[0] for c in SUMS.split(", ")])
            packed = batch.filter(pa.array(some))
            for part, data in zip(packed.column("part").to_pylist(), packed.column("data").to_pylist(), strict=True):
                if part != current and held:
                    yield merged_part(held)
                    held = []
                current = part
                held.append(data)
        if held:
            yield merged_part(held)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, SUMS)


def importances(sums: DataFrame) -> DataFrame:
    """(site, node, parent, prior, pages, words, importance, presentation) of every node, from merged()."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    tree = sums.groupBy("site", "node").agg(F.max("parent").alias("parent"), F.max("prior").alias("prior"), *map(total, ("m", "s", "k", "l", "words", "word_log", "shown", "style_log")))
    m = F.greatest("m", F.lit(1.0))
    content = F.when(F.col("m") > 1, 1 - F.try_divide("word_log", "words") / F.log(m)).otherwise(1.0)
    context = F.sqrt(1 - (1 - F.least(F.lit(1.0), F.col("s") / m)) * (1 - F.col("k") / m))
    shown = F.greatest("shown", F.lit(1)).cast("double")
    presentation = F.greatest(F.lit(0.0), (F.log(shown) - F.col("style_log") / shown) / F.log(F.lit(float(STYLES))))
    importance = F.when(F.col("m") > 0, content * (1 - F.col("l") / m) * context)
    return tree.select("site", "node", "parent", "prior", F.col("m").alias("pages"), importance.alias("importance"), presentation.alias("presentation"))


def log_odds(column):
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), column))
    return F.log(p / (1 - p))


def low_nodes(tree: DataFrame) -> DataFrame:
    """(site, node): nodes with text whose evidence is below the limit."""
    weight = lambda c: F.try_divide(F.sum(F.col("pages") * F.col(c)), F.sum("pages"))
    every = tree.where("pages > 0").groupBy("node").agg(weight("importance").alias("all_importance"), weight("presentation").alias("all_presentation"))
    above = tree.select("site", F.col("node").alias("parent"), F.col("presentation").alias("above"))
    joined = tree.where("pages > 0").join(every, "node").join(above, ["site", "parent"], "left")
    lean = lambda own, other: (F.col("pages") * F.col(own) + LEAN * F.col(other)) / (F.col("pages") + LEAN)
    presented = F.greatest(lean("presentation", "all_presentation"), F.coalesce("above", F.lit(0.0)))
    evidence = log_odds(lean("importance", "all_importance")) + PRESENTED * (F.least(F.lit(1.0), presented) - 0.25) + F.col("prior")
    return joined.where(F.round(evidence, 9) < float(np.log(LOW / (1 - LOW)))).select("site", "node")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(site, html): each page of a site once.  Only pages with copies are shuffled."""
    marked = pages.select("site", "html", F.xxhash64("html").alias("digest"), F.length("html").alias("size")).where("size > 0")
    key = ["site", "digest", "size"]
    copied = stored(marked.groupBy(*key).count().where("count > 1").drop("count"), "style-tree-copies")
    once = marked.join(copied, key, "left_anti").select("site", "html")
    return once.unionByName(marked.join(copied, key, "left_semi").groupBy(*key).agg(F.first("html").alias("html")).select("site", "html"))


def unimportant_nodes(pages: DataFrame) -> DataFrame:
    """(site, node): the nodes of each site's style tree that leave its pages."""
    parts = min(MOST_PARTS, max(64, pages.count() // PAGES_A_PART))
    sums = merged(tree_rows(distinct_pages(pages), parts))
    return low_nodes(stored(importances(sums), "style-tree"))


def main_text(page: str, low: frozenset[int]) -> str:
    return " ".join(text for node, text, _ in blocks(page)[1] if node.key not in low)


def with_site(df: DataFrame, url_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return df.withColumn("site", F.xxhash64(host))


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """id, url, text and n_chars of every page."""
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    pages = with_site(pages, "url")
    low = stored(unimportant_nodes(pages), "style-tree-low")
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in ("id", "url"))
    schema = f"id {kind}, url {url_kind}, text string, n_chars long"

    def extracted(part: pa.RecordBatch, low_of) -> pa.RecordBatch:
        texts = [main_text(page or "", low_of(site)) for site, page in zip(part.column("site").to_pylist(), part.column("html").to_pylist(), strict=True)]
        column = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), column, pc.cast(pc.utf8_length(column), pa.int64())], ["id", "url", "text", "n_chars"])

    if low.count() <= broadcast_nodes:
        table = low.toArrow()
        shared = df.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("site", "node")])

        def run(batches):
            known: dict[int, set] = defaultdict(set)
            for site, node in zip(shared.value[0].tolist(), shared.value[1].view(np.uint64).tolist(), strict=True):
                known[site].add(node)
            for batch in batches:
                for part in slices(batch, "html"):
                    yield extracted(part, lambda site: known.get(site, frozenset()))

        out = pages.select("id", "url", "html", "site").mapInArrow(run, schema)
    else:  # a site's nodes come before its pages in each salted group
        salted = pages.select("id", "url", "html", "site", F.lit(None).cast("long").alias("node"), F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int").alias("salt"))
        every = low.select(F.lit(None).cast(kind).alias("id"), F.lit(None).cast(url_kind).alias("url"), F.lit(None).cast("string").alias("html"), "site", "node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        stream = salted.unionByName(every).repartition("site", "salt").sortWithinPartitions("site", "salt", F.col("node").asc_nulls_last())

        def run_sorted(batches):
            of, known = None, set()
            for batch in batches:
                key = np.stack([batch.column(c).to_numpy() for c in ("site", "salt")])
                cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b <= a:
                        continue
                    here = batch.slice(a, b - a)
                    if of != (key[0, a], key[1, a]):
                        of, known = (key[0, a], key[1, a]), set()
                    nodes = here.column("node")
                    n = len(nodes) - nodes.null_count
                    known.update(pc.drop_null(nodes.slice(0, n)).to_numpy().view(np.uint64).tolist())
                    for part in slices(here.slice(n), "html"):
                        yield extracted(part, lambda site: known)

        out = stream.mapInArrow(run_sorted, schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op7_style_tree(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The given pages hold their main text in one article element each.
OP7_SQL = r"""
SELECT page_id, url, t AS text, length(t)::BIGINT AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]+>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages) x
"""
