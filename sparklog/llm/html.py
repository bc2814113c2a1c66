"""Main text of web pages: a tolerant scan of the markup, and a host suffix array for what markup leaves open.

Where a page has an article with text in it (an article or main element, else one named so), its blocks are the text, without excluded
parts: a page's markup says there what the article is, and repeated prose inside it belongs to it. What markup leaves open is in
doubt: every block of a page without an article, and in an article the blocks whose words are all links, which may be a
menu that nothing names. These are decided by the host suffix array: the token streams of a host's pages are concatenated and their
suffixes sorted to the depth of ``MIN_TOKENS``; runs of at least that many tokens that occur on two pages or more are
boilerplate. Of a page without an article the unique runs are kept; of an article a block of links goes if it is covered whole.
Suffix arrays alone can't give whole articles (copies and shared passages on one host would go, unrepeated menus and
adverts stay), so they decide what is in doubt; excluded elements never count.

A host's pages are split into chunks of bounded size by a hash, with an array each. Hosts of several chunks are compared
between these too, by hashes of windows of that many tokens, so that the split doesn't change the result.

Excluded: head, scripts, styles, menus, page headers and footers, sidebars, forms, embedded objects, hidden elements, and
elements whose class, id or role names them an advert, notice, menu, comment area and the like. A name that only has such a
part ("has-sidebar") doesn't exclude an article that the element holds; in an article only a whole class or id or a known compound
excludes, and ids of headings and sections don't. Of an article's own header the headings belong to it; an article that is named a comment or
an advert is excluded. Unclosed elements end where HTML lets them; a page cut off in a tag loses that tag only.

Null and empty html gives an empty text. Urls without a host, null ones too, are one host. Rows that repeat give equal rows and count as one
page if their page_id is the same. Other columns are left aside; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, arrow_schema, checked, ddl, written

MIN_TOKENS, CHUNK_TOKENS = 8, 1 << 21

_TAG = re.compile(r"<!--.*?(?:--!?>|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>\"'][^\s>]*)?)*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_WORD = re.compile(r"\w")
_NAMES = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end without a tag of their own when one of these opens.
IMPLIED = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: A closing or opening tag doesn't reach over these to end an implied element.
LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
EXCLUDED = frozenset("head title script style noscript template svg math nav header footer aside form button select textarea input iframe object embed audio video canvas menu dialog noembed noframes".split())
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
EXCLUDED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification alert disclaimer "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar sidebar sidebars aside masthead header footer comment comments disqus respond replies reply "
    "share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay login signup search widget widgets copyright skip".split()
)
#: What a compound of an excluded name may have besides in an article: "ad-slot-2" is an advert, "related-work" isn't.
COMPOUNDS = frozenset("area bar block box button buttons container form icons item items link links list posts slot unit wrap wrapper".split())
#: In an article, ids of these name what the text is about.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOPICS = HEADINGS | {"section"}
#: Elements that are the page or the article itself, whatever their names say; but an article with these names isn't the page's.
KEPT_WHOLE = frozenset(["html", "body", "article", "main"])
NOT_ARTICLES = frozenset("comment comments reply replies respond disqus ad ads advert adverts advertisement promo sponsored".split())
ARTICLES = frozenset(["article", "main"])
#: Names that stand for an article where a page has no such element.
CONTAINERS = frozenset("article article-body article-content articlebody content content-body content-main entry entry-content main main-content maincontent page-content post post-body post-content story story-body".split())

PAGES = arrow_schema(row=pa.int64(), page_id=pa.int64(), url=pa.string(), host=pa.string(), marked=pa.bool_(), blocks=pa.list_(pa.string()), doubt=pa.list_(pa.bool_()), runs=pa.list_(pa.string()))
COVERED = arrow_schema(row=pa.int64(), gone=pa.list_(pa.bool_()))
WINDOWS = arrow_schema(host=pa.string(), row=pa.int64(), page=pa.int64(), at=pa.int64(), h=pa.int64())
TEXTS = arrow_schema(row=pa.int64(), page_id=pa.int64(), url=pa.string(), text=pa.string())


#: How far an element is out: not at all, unless it holds an article (in an article: a heading), or for good.
IN, UNLESS, OUT = 0, 1, 2


def _named(value: str, names: frozenset[str] = EXCLUDED_NAMES) -> int:
    """OUT if a class or id has an excluded name as a whole token or a known compound, UNLESS if it has one as any part."""
    found = IN
    for token in value.split():
        parts = _NAMES.findall(token)
        if not names.isdisjoint(parts):
            if all(p in EXCLUDED_NAMES or p in COMPOUNDS or p.isdigit() for p in parts):
                return OUT
            found = UNLESS
    return found


def _excluded(tag: str, attributes: str, inside: bool) -> int:
    if tag in EXCLUDED and not (inside and tag == "header"):
        return OUT
    found = UNLESS if tag == "header" else IN
    if not attributes or (tag in KEPT_WHOLE and tag != "article"):
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id"):
            if tag == "article":
                how = OUT if name == "class" and _named(value, NOT_ARTICLES) == OUT else IN
            else:
                how = IN if inside and name == "id" and tag in TOPICS else _named(value)
            found = max(found, IN if inside and how == UNLESS else how)
        elif tag == "article":
            continue
        elif name == "role":
            found = OUT if value.strip() in EXCLUDED_ROLES else found
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return OUT
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
    return found


def _container(tag: str, attributes: str) -> int:
    """2 for an article, 1 for an element that is named as one, else 0."""
    if tag in ARTICLES:
        return 2
    if attributes and tag not in INLINE:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if (name.lower() in ("class", "id", "itemprop") and not CONTAINERS.isdisjoint(value.split())) or (name.lower() == "role" and value in ("main", "article")):
                return 1
    return 0


def blocks(html: str) -> tuple[bool, list[str], list[bool]]:
    """Whether the page has an article with text, the blocks of it, or without one of all that isn't excluded, and which
    of these are in doubt: of an article those of links alone, else all."""
    stack: list[tuple[str, int, int, bool]] = []  # open elements: tag, how far text in them is out, what article it is in, whether it is a link
    kept: tuple[list[str], list[str], list[str]] = ([], [], [])
    links: tuple[list[bool], list[bool], list[bool]] = ([], [], [])
    text: list[str] = []
    plain = False  # whether the block has a word outside links

    def add(part: str) -> None:
        nonlocal plain
        if not stack:
            text.append(part)
            plain = True
        elif not stack[-1][1]:
            text.append(part)
            if not plain and not stack[-1][3]:
                plain = _WORD.search(unescape(part) if "&" in part else part) is not None

    def flush() -> None:
        nonlocal plain
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            if block:
                for level in range(stack[-1][2] + 1 if stack else 1):
                    kept[level].append(block)
                    links[level].append(not plain)
        plain = False

    def close(n: int) -> None:
        if any(x[0] not in INLINE for x in stack[n:]):
            flush()
        del stack[n:]

    at, end = 0, len(html)
    while at < end:
        tag = _TAG.search(html, at)
        if not tag:
            add(html[at:])
            break
        if tag.start() > at:
            add(html[at : tag.start()])
        at = tag.end()
        if tag[1] is not None:
            add(tag[1].replace("&", "&amp;"))
        if tag[3] is None:
            continue
        name = tag[3].lower()
        if tag[2]:
            places = [i for i, x in enumerate(stack) if x[0] == name]
            if places and not any(x[0] in ARTICLES for x in stack[places[-1] + 1 :] if name not in KEPT_WHOLE):
                close(places[-1])
            elif name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
        while stack and any(x[0] in IMPLIED and name in IMPLIED[x[0]] for x in stack):
            k = max(i for i, x in enumerate(stack) if x[0] in IMPLIED and name in IMPLIED[x[0]])
            if any(x[0] in LISTS.get(stack[k][0], ()) or x[0] in ARTICLES for x in stack[k + 1 :]):
                break
            close(k)
        out, inner, link = stack[-1][1:] if stack else (IN, 0, False)
        if name in VOID:
            continue
        own, article = _excluded(name, tag[4], inner > 0), _container(name, tag[4])
        own = IN if article and own == UNLESS else own
        out = own if out == UNLESS and (article or (inner and name in HEADINGS)) else max(out, own)
        inner = max(inner, 0 if out else article)
        if not tag[4].rstrip().endswith("/") or name not in ("svg", "math"):
            stack.append((name, out, inner, link or name == "a"))
        if name in RAW:
            close_tag = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(html, at)
            at = close_tag.start() if close_tag else end
    flush()
    best = max((level for level in range(3) if kept[level]), default=0)
    return best > 0, kept[best], links[best] if best else [True] * len(kept[0])


def runs(found: list[str], doubt: list[bool]) -> list[str]:
    """The streams of tokens in doubt: neighbouring blocks in one."""
    return [" ".join(b for b, _ in group) for unsure, group in groupby(zip(found, doubt), key=lambda x: x[1]) if unsure]


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    return found[1].lower() if found else ""


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            done = [blocks(x or "") for x in part.column(2).to_pylist()]
            urls = part.column(1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(done))),
                    part.column(0).cast(pa.int64()),
                    urls.cast(pa.string()),
                    pa.array([host_of(u) for u in urls.to_pylist()], pa.string()),
                    pa.array([x[0] for x in done], pa.bool_()),
                    pa.array([x[1] for x in done], pa.list_(pa.string())),
                    pa.array([x[2] for x in done], pa.list_(pa.bool_())),
                    pa.array([runs(*x[1:]) for x in done], pa.list_(pa.string())),
                ],
                schema=PAGES,
            )
            row += len(done)


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` tokens, and for each place the rank that equal beginnings share.

    By doubling: a pair of ranks of half the depth; the last step overlaps, so that the depth is met exactly.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < depth:
        step = min(done, depth - done)
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:]
        key = rank * (len(rank) + 1) + after + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        done += step
    return np.argsort(rank, kind="stable"), rank


def repeated(tokens: np.ndarray, page: np.ndarray, run: np.ndarray, depth: int) -> np.ndarray:
    """Which tokens lie in ``depth`` tokens of one run that another page has too."""
    n = len(tokens)
    out = np.zeros(n + 1, np.int32)
    if n >= depth:
        order, rank = suffix_order(tokens, depth)
        whole = np.zeros(n, bool)
        whole[: n - depth + 1] = run[: n - depth + 1] == run[depth - 1 :]
        order = order[whole[order]]
        edge = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1]))) if len(order) else np.zeros(0, np.int64)
        if len(edge):
            low, high = np.minimum.reduceat(page[order], edge), np.maximum.reduceat(page[order], edge)
            hit = order[np.repeat(low < high, np.diff(np.append(edge, len(order))))]
            np.add.at(out, hit, 1)
            np.add.at(out, hit + depth, -1)
    return np.cumsum(out[:-1]) > 0


def _stream(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens in a row, offsets of runs among them, and of pages among runs."""
    tokens = [run.split(" ") for x in lists for run in x]
    raw = [t.encode() for x in tokens for t in x]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    size = np.array([len(t) for t in raw], np.int64)
    start = np.cumsum(size + 1) - size - 1
    return W.hashes(data, start, start + size), np.cumsum([0, *map(len, tokens)]), np.cumsum([0, *map(len, lists)])


def _covered(depth: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        h, first, of = _stream(table["runs"].to_pylist())
        edges = first[of]
        page = np.repeat(np.unique(table["page"].to_numpy(), return_inverse=True)[1].astype(np.int64), np.diff(edges))
        mask = repeated(h, page, W.owners(first), depth) if len(h) else np.zeros(0, bool)
        return pa.table([table["row"], pa.array([mask[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])], pa.list_(pa.bool_()))], schema=COVERED)

    return run


def _windows(depth: int):
    """Hashes of all windows of pages whose host has several chunks; at: the place in the page's tokens in doubt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first, of = _stream(batch.column(3).to_pylist())
            at, edges = W.inside(first, depth), first[of]
            page = W.owners(edges)[at]
            rows = [batch.column(i).take(pa.array(page)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(at - edges[page]), pa.array(W.grams(h, depth)[at].view(np.int64))], schema=WINDOWS)

    return run


def _texts(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for marked, found, doubt, mask, more in zip(*(batch.column(i).to_pylist() for i in range(3, 8))):
                if mask is None:
                    out.append(" ".join(found))
                    continue
                gone, at, kept = np.array(mask, bool), 0, []
                for place in more or ():
                    gone[place : place + depth] = True
                for block, unsure in zip(found, doubt):
                    if unsure:
                        tokens = block.split(" ")
                        hit = gone[at : at + len(tokens)]
                        at += len(tokens)
                        if marked and not hit.all():
                            kept.append(block)
                        elif not marked:
                            kept += [t for t, g in zip(tokens, hit) if not g]
                    else:
                        kept.append(block)
                out.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], schema=TEXTS)

    return run


def main_text(pages: DataFrame, min_tokens: int = MIN_TOKENS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """A row for each page row: row (a number of its own), page_id, url, text."""
    parsed = written(arrow_map(checked(pages, "page_id", "url", "html"), _parsed, PAGES), "pages")
    unsure = F.size("runs") > 0
    loose = parsed.where(unsure).select("host", "row", F.coalesce("page_id", "row").alias("page"), "runs")
    # The size of a host decides into how many chunks it is split; each of these is one task's suffix array.
    tokens = F.aggregate("runs", F.lit(0).cast("long"), lambda n, b: n + F.length(b) - F.length(F.replace(b, F.lit(" "))) + 1)
    hosts = loose.groupBy("host").agg(F.ceil(F.sum(tokens) / chunk_tokens).alias("chunks"))
    split = loose.join(hosts, "host").select("host", "row", "page", "runs", "chunks", F.pmod(F.xxhash64("page"), F.col("chunks")).alias("chunk"))
    masks = written(split.select("host", "chunk", "row", "page", "runs").groupBy("host", "chunk").applyInArrow(_covered(min_tokens), ddl(COVERED)), "masks")
    windows = arrow_map(split.where("chunks > 1").select("host", "row", "page", "runs"), _windows(min_tokens), WINDOWS)
    shared = windows.groupBy("host", "h").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low < high").select("host", "h")
    more = windows.join(shared, ["host", "h"], "left_semi").groupBy("row").agg(F.collect_set("at").alias("more"))
    columns = ["row", "page_id", "url", "marked", "blocks", "doubt"]
    joined = parsed.where(unsure).select(*columns).join(masks, "row").join(more, "row", "left").select(*columns, "gone", "more")
    plain = parsed.where(~unsure).select(*columns, F.lit(None).cast("array<boolean>").alias("gone"), F.lit(None).cast("array<bigint>").alias("more"))
    return arrow_map(plain.unionByName(joined), _texts(min_tokens), TEXTS)


def op2(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
