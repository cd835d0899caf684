"""Main text of web pages with site templates removed.

Pages are read as a tree of elements. Elements that are by their tag or role no part of an article
(menus, footers, forms and so on) are dropped, and those that a whole class or id name calls so
(adverts, notices, reader comments), unless they are an article or main element or hold most of the
page's text. For the rest, each element subtree outside the article, and each container inside it,
has a hash of its tags, classes and text. Spark counts for each host on how many distinct page
contents a hash occurs; subtrees that recur on many of their host are the site's template and are
deleted. A page's content is the text before anything is deleted, so copies of one article or page
count once.

Never a template is an element that encloses an article or main element, all text of the page, or
its main block: more than half of the text and at least MAIN_CHARS characters. Paragraphs of an
article are never deleted for recurring: a copied article is still an article.

A page is parsed once, in time that grows with its length however deep it nests. What is kept of it
are its text, if no count can change it, or else its blocks and the tree of its hashed elements.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.cascade import host_of
from llm.common import arrow_map, store

#: A subtree outside articles recurs if it is on so many distinct pages and such a share of its host's.
LEAST_PAGES, SHARE = 3, 0.1
#: The share for containers inside an article.
SHARE_INSIDE = 0.5
#: Characters of a page's main block.
MAIN_CHARS = 200

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math textarea title object canvas audio video select".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("aside details dl div fieldset figure ol section table ul".split())
DROPPED = set("nav footer aside form button dialog menu head label".split())
DROPPED_OUTSIDE = {"header"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark what is no part of an article, and words that may stand beside them.
WORDS = set("""ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored
cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login
sidebar aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar topbar
comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations
pagination pager paging tags skip""".split())
BESIDE = set("""site main page top bottom left right primary secondary global area block box wrap wrapper container section
list bar inner outer links link buttons button icons icon posts articles items item form text message slot unit region panel post to""".split())
WORDS_OUTSIDE = {"header"}
#: Elements that a start tag ends if they are open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([^\s=/"'>]+)""")
_PART = re.compile(r"[a-z]+")
_KEYS = ("class", "id", "role", "hidden", "aria-hidden")
#: Elements that an end tag of another element doesn't reach over, and lists that hold their items.
WALLS, LISTS = ("article", "main", "td", "th", "table"), ("ul", "ol", "dl", "table", "select")


class _Node:
    """An open element: number among all, whether it is dropped, the nearest hashed one around it, and
    the number of the nearest one, itself included, that is called no part of the article."""

    __slots__ = ("tag", "drop", "level", "number", "holder", "called", "digest")

    def __init__(self, tag: str, drop: bool, level: int, number: int, holder: _Node | None, called: int, sign: str | None):
        self.tag, self.drop, self.level, self.number, self.holder, self.called = tag, drop, level, number, holder, called
        self.digest = None if sign is None else hashlib.blake2b(f"{tag} {sign}".encode("utf-8", "replace"), digest_size=8)


def _called(attributes: dict[str, str], level: int) -> bool:
    """Whether a whole class or id name says that the element is no part of an article.

    A name says so if all its parts are words of the lists and one is of WORDS: `cookie-notice` and
    `main-menu` do, `no-sidebar`, `comments-open` and `social-science` don't.
    """
    words = WORDS if level else WORDS | WORDS_OUTSIDE
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = _PART.findall(name)
        if parts and all(p in words or p in BESIDE for p in parts) and any(p in words for p in parts):
            return True
    return False


def _dropped(tag: str, attributes: dict[str, str], level: int) -> bool:
    if tag in DROPPED or (tag in DROPPED_OUTSIDE and not level):
        return True
    return bool(attributes) and (attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true")


class Page:
    """Blocks (text, level, element number) of a page, and the tree of its elements with their hashes.

    Level 2: inside an article; 1: inside the main element; 0: elsewhere in the page.
    """

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, int, int]] = []
        self.parents: list[int] = []
        self.levels: list[int] = []
        self.hashes: dict[int, int] = {}  # of elements that can be templates
        self._called: list[int] = []
        self._raw: list[tuple[list[tuple[str, int, int]], int, int]] = []
        self._text: list[tuple[str, int, int]] = []  # of the block so far: text, element, nearest called one
        self._stack: list[_Node] = []
        self._open_at: dict[str, list[int]] = defaultdict(list)
        self._read(source or "")
        self._settle()

    def _flush(self) -> None:
        """End the block. Its text is never from a dropped element, though one may be open."""
        if not self._text:
            return
        pieces, self._text = self._text, []
        at = len(self._stack) - 1
        while at >= 0 and self._stack[at].drop:
            at -= 1
        node = self._stack[at] if at >= 0 else None
        self._raw.append((pieces, node.level if node else 0, node.number if node else -1))
        holder = node if node and node.digest else node and node.holder
        if holder:
            own = [t for t, _, called in pieces if called == holder.called]
            holder.digest.update(" ".join("".join(own).split()).encode("utf-8", "replace"))

    def _add(self, text: str) -> None:
        top = self._stack[-1] if self._stack else None
        if top is None:
            self._text.append((text, -1, -1))
        elif not top.drop:
            self._text.append((text, top.number, top.called))

    def _close(self) -> None:
        if self._stack[-1].tag in BLOCKS:
            self._flush()
        node = self._stack.pop()
        self._open_at[node.tag].pop()
        if node.digest:
            digest = node.digest.digest()
            self.hashes[node.number] = int.from_bytes(digest, "big", signed=True)
            if node.holder:
                node.holder.digest.update(digest)

    def _close_to(self, at: int) -> None:
        while len(self._stack) > at:
            self._close()

    def _last(self, tags) -> int:
        """The place of the innermost open element of some tags; -1 without one."""
        return max((self._open_at[t][-1] for t in tags if self._open_at.get(t)), default=-1)

    def _open(self, tag: str, raw: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._end("p")
        if tag in ENDS:
            at = self._last(ENDS[tag])
            if at > self._last(LISTS):
                self._close_to(at)
        above = self._stack[-1] if self._stack else None
        if above and above.drop:  # only its end matters
            self._push(_Node(tag, True, above.level, -1, None, -1, None))
            return
        attributes = {}
        if raw and not raw.isspace():
            for name, value, bare in _ATTRIBUTE.findall(raw):
                if (key := (name or bare).lower()) in _KEYS:
                    attributes[key] = value.strip("\"'")
        level = above.level if above else 0
        if _dropped(tag, attributes, level):
            self._push(_Node(tag, True, level, -1, None, -1, None))
            return
        is_main = tag == "main" or attributes.get("role") == "main"
        number = len(self.parents)
        called = above.called if above else -1
        if attributes and not is_main and tag not in ("article", "body", "html") and _called(attributes, level):
            self._called.append(number)
            called = number
        inside = level > 0
        container = tag in CONTAINERS if inside else tag in BLOCKS and tag not in ("body", "article", "main") and not is_main
        level = 2 if tag == "article" else max(level, 1) if is_main else level
        self.parents.append(above.number if above else -1)
        self.levels.append(level)
        holder = above if above and above.digest else above and above.holder
        self._push(_Node(tag, False, level, number, holder, called, " ".join(f"{k}={v}" for k, v in sorted(attributes.items())) if container else None))

    def _push(self, node: _Node) -> None:
        self._open_at[node.tag].append(len(self._stack))
        self._stack.append(node)

    def _end(self, tag: str) -> None:
        at = self._last((tag,))
        if at >= 0 and (tag in ("article", "main", "body", "html") or tag in WALLS or at > self._last(WALLS)):
            self._close_to(at)

    def _read(self, source: str) -> None:
        at, unclosed = 0, set()
        while at < len(source):
            token = _TOKEN.match(source, at)
            if token is None:  # an opening sign without an end
                self._add(source[at])
                at += 1
                continue
            at = token.end()
            end, tag, raw, text = token.groups()
            if text:
                self._add(text)
            elif tag:
                tag = tag.lower()
                if end:
                    if tag in BLOCKS:
                        self._flush()
                    self._end(tag)
                elif tag in RAW:
                    done = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                    if not done:
                        unclosed.add(tag)
                    at = done.end() if done else (len(source) if tag in ("script", "style") else at)
                elif tag == "br":
                    self._add(" ")
                elif tag in VOID:
                    if tag in BLOCKS:
                        self._flush()
                else:
                    self._open(tag, raw)
        self._flush()
        self._close_to(0)

    def _sums(self, sizes: list[int]) -> list[int]:
        """Sums over the subtrees: elements come after their parents."""
        for n in range(len(sizes) - 1, -1, -1):
            if self.parents[n] >= 0:
                sizes[self.parents[n]] += sizes[n]
        return sizes

    def _settle(self) -> None:
        """Drop what is called no part of the article, then the hashes of elements that can't be templates."""
        own, total = [0] * len(self.parents), 0
        for pieces, _, _ in self._raw:
            for text, n, _ in pieces:
                total += len(text.strip())
                if n >= 0:
                    own[n] += len(text.strip())
        size = self._sums(own)
        gone = self._below({n for n in self._called if 2 * size[n] <= total})
        for pieces, level, n in self._raw:
            text = " ".join(html.unescape("".join(t for t, _, called in pieces if called < 0 or not gone[called])).split())
            if text:
                self.blocks.append((text, level, n))
        self.hashes = {n: h for n, h in self.hashes.items() if not gone[n]}
        best = self.best()
        held, deepest, total = [0] * len(self.parents), list(self.levels), 0
        for text, level, n in self.blocks:
            if level >= best:
                total += len(text)
                if n >= 0:
                    held[n] += len(text)
        self._sums(held)
        with_text = [h > 0 for h in held]
        for n in range(len(deepest) - 1, -1, -1):
            up = self.parents[n]
            if up >= 0 and with_text[n]:
                deepest[up] = max(deepest[up], deepest[n])
        for n, h in enumerate(held):
            main = total and (h == total or (2 * h > total and h >= MAIN_CHARS))
            if n in self.hashes and (main or deepest[n] > self.levels[n]):
                del self.hashes[n]

    def _below(self, chosen: set[int]) -> list[bool]:
        """Which elements are chosen or stand in a chosen one."""
        out: list[bool] = []
        for n, up in enumerate(self.parents):
            out.append(n in chosen or (up >= 0 and out[up]))
        return out

    def best(self) -> int:
        """The level from which on text is taken: the article's if there is one; the main element's if
        that has more text outside its articles than inside."""
        sizes = [0, 0, 0]
        for text, level, _ in self.blocks:
            sizes[level] += len(text)
        return 2 if sizes[2] and sizes[2] >= sizes[1] else 1 if sizes[1] else 0

    def kept(self) -> list[tuple[str, int]]:
        best = self.best()
        return [(text, n) for text, level, n in self.blocks if level >= best]

    def tree(self) -> tuple[list[tuple[int, bool, int]], list[int]]:
        """(hash, inside an article or main, place above) of the hashed elements, and for each kept
        block the place of the innermost one that holds it; -1: none."""
        place, nearest, tree = {}, [], []
        for n, up in enumerate(self.parents):
            over = nearest[up] if up >= 0 else -1
            if n in self.hashes:
                nearest.append(len(tree))
                tree.append((self.hashes[n], self.levels[n] > 0, over))
            else:
                nearest.append(over)
        return tree, [nearest[n] if n >= 0 else -1 for _, n in self.kept()]

    def text(self, recurring: set[int] = frozenset()) -> str:
        tree, above = self.tree()
        return remaining([t for t, _ in self.kept()], above, [(h, up) for h, _, up in tree], recurring)


def remaining(texts: list[str], above: list[int], tree: list[tuple[int, int]], recurring: set[int]) -> str:
    """The blocks that stand in no recurring element."""
    gone: list[bool] = []
    for value, up in tree:
        gone.append(value in recurring or (up >= 0 and gone[up]))
    return "\n".join(t for t, n in zip(texts, above) if n < 0 or not gone[n])


TREE = "array<struct<hash:long,inside:boolean,above:int>>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, content, texts, above, tree of every row of `pages`.

    `tree` has the hashed elements of the page, `above` each block's place in it; both are empty
    where no kept block stands in a hashed element, and such a page has its text in one piece.
    """

    def read(batch: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("content", "hashes", "texts", "above", "tree")}
        for source in batch["html"]:
            page = Page(source)
            tree, above = page.tree()
            texts = [t for t, _ in page.kept()]
            whole = "\n".join(texts)
            is_open = any(n >= 0 for n in above)
            seen = dict.fromkeys((h, inside) for h, inside, _ in tree)
            values = (
                int.from_bytes(hashlib.blake2b(whole.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True),
                [{"hash": h, "inside": i} for h, i in seen],
                texts if is_open else [whole],
                above if is_open else [-1],
                [{"hash": h, "inside": i, "above": up} for h, i, up in tree] if is_open else [],
            )
            for column, value in zip(out.values(), values):
                column.append(value)
        seen = pa.struct([("hash", pa.int64()), ("inside", pa.bool_())])
        kinds = {"content": pa.int64(), "hashes": pa.list_(seen), "texts": pa.list_(pa.string()), "above": pa.list_(pa.int32()), "tree": pa.list_(pa.struct([*seen, ("above", pa.int32())]))}
        given = {n: pa.array(batch[n], k) for n, k in (("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()))}
        return given | {n: pa.array(out[n], k) for n, k in kinds.items()}

    columns = f"page_id long, url string, host string, content long, hashes array<struct<hash:long,inside:boolean>>, texts array<string>, above array<int>, tree {TREE}"
    return arrow_map(pages.select("page_id", "url", "html", F.coalesce(host_of(), F.lit("")).alias("host")), read, columns)


def recurring_subtrees(found: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, share_inside: float = SHARE_INSIDE) -> DataFrame:
    """(host, recurring): the hashes of subtrees that recur on many distinct page contents of a host.

    Each is on a tenth of the host's contents at least, so a host has at most ten times as many as a
    page of it has elements.
    """
    pages = found.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    each = found.select("host", "content", F.explode("hashes").alias("h")).groupBy("host", "h.hash", "content").agg(F.max("h.inside").alias("inside"))
    seen = each.groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("inside").alias("inside")).filter(F.col("n") >= least)
    needed = F.ceil(F.col("pages") * F.when(F.col("inside"), share_inside).otherwise(share))
    return seen.join(pages, "host").filter(F.col("n") >= needed).groupBy("host").agg(F.collect_list("hash").alias("recurring"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`.

    Null and empty pages have the empty text; pages with a null URL share the empty host. Repeated
    rows have a text each. Only page_id, url and html are read.
    """
    found = store(parsed(pages), "parsed")

    def decide(batch: dict) -> dict:
        texts = []
        for blocks, above, tree, recurring in zip(*(batch[c] for c in ("texts", "above", "tree", "recurring"))):
            texts.append(remaining(blocks, above, [(e["hash"], e["above"]) for e in tree], set(recurring or ())))
        return {
            "page_id": pa.array(batch["page_id"], pa.int64()), "url": pa.array(batch["url"], pa.string()),
            "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }

    columns = "page_id long, url string, text string, n_chars long"
    # only pages that counts can change meet the counts of their host
    asked = found.filter(F.size("tree") > 0).select("page_id", "url", "host", "texts", "above", "tree")
    decided = arrow_map(asked.join(recurring_subtrees(found), "host", "left").drop("host"), decide, columns)
    text = F.col("texts")[0]
    return found.filter(F.size("tree") == 0).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars")).unionByName(decided)
