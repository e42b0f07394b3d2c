"""Main text of web pages, without the site's templates.

A page is read into blocks (runs of text between block-level tags) and elements, each of which covers a
range of blocks. The hashes of all elements' subtrees are counted per host in Spark first, and subtrees that
recur on many pages of a host with different content go. What counting can't tell - furniture of small
hosts, or with other words on each page - goes by tag, role and class. Elements inside an article
go by counting only where the page has more text that does not recur: copied articles share most of theirs.

The reader is one pass over a page: elements are kept by number on one stack, a subtree's hash is made of its
children's, and no search is repeated that failed before.
"""

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import released, written

_OPEN = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_QUIET = re.compile(r"[^>\"']*+")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: fixed values: elements whose content is no text of the page, raw ones up to the page's end if need be
RAW = frozenset("script style textarea iframe title noscript".split())
SKIPPED = RAW | frozenset("template svg select object canvas head".split())
#: fixed values: HTML elements that begin and end a block
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: fixed values: elements without content
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: fixed values: furniture by element, by role and by a word of class or id
FURNITURE = frozenset("nav aside form footer button dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal overlay sidebar comment comments disqus respond menu navbar nav navigation breadcrumb breadcrumbs pagination pager footer masthead skip".split())
#: fixed values: words that name furniture, but inside an article only where all other words of the name are neutral
DOUBTFUL = frozenset("promo promotion banner notice notices notification alert reply replies share sharing social related recommended widget toolbar".split())
NEUTRAL = frozenset("box bar list block wrap wrapper container section area slot panel unit item items inner outer links buttons posts site page main top bottom left right global header".split())
#: so many hashes of templates go to all tasks; beyond that they are joined
BROADCAST_ROWS = 200_000
#: elements that a new block closes when they are still open
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@lru_cache(4096)
def _marks(attributes: str) -> tuple[bool, bool, str]:
    """Is the element furniture by its role or names: anywhere, and outside of articles; its role."""
    sure, doubtful, role = False, False, ""
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            role = value.strip()
            continue
        for token in value.split():
            words = set(re.split(r"[^a-z0-9]+", token)) - {""}
            doubtful |= bool(words & DOUBTFUL)
            sure |= bool(words & WORDS) or (bool(words & DOUBTFUL) and words <= DOUBTFUL | NEUTRAL)
    return sure or role in ROLES, doubtful, role


class _Tags:
    """The tags of a page, in order: (begin, end, name, closes, attributes). Comments, declarations and the content of
    elements without text have an empty name; so has a skipped element, whose name is then the attributes."""

    def __init__(self, page: str):
        self.page, self.ended = page, set()
        self.last = {c: page.rfind(c) for c in "\"'>"}
        # what reading quoted attributes may cost in all before quotes are no longer looked at
        self.budget = 8 * len(page) + (1 << 16)

    def _tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, quotes minded; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        page, k = self.page, at
        while self.budget > 0:
            k2 = _QUIET.match(page, k).end()
            self.budget -= k2 - k + 1
            if k2 == len(page):
                break
            c = page[k2]
            if c == ">":
                return k2
            if k2 >= self.last[c]:
                break  # a quote without its end
            k = page.find(c, k2 + 1) + 1
            self.budget -= k - k2
        return page.find(">", at)

    def _content_end(self, name: str, at: int) -> int:
        """Behind the end tag of an element without text; -1 if there is none."""
        if name in self.ended:
            return -1
        m = re.compile(rf"</{name}(?=[\s>/])", re.I).search(self.page, at)
        if not m:
            self.ended.add(name)
            return -1
        end = self.page.find(">", m.end())
        return end + 1 if end >= 0 else len(self.page)

    def __iter__(self):
        page, at, n = self.page, 0, len(self.page)
        while True:
            at = page.find("<", at)
            if at < 0 or at + 1 >= n:
                return
            c = page[at + 1]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = end + 3 if end >= 0 else n
                yield at, end, "", False, ""
                at = end
            elif c in "!?" or (c == "/" and not _OPEN.match(page, at + 2)):
                if at > self.last[">"]:
                    at += 1
                    continue
                end = page.find(">", at) + 1
                yield at, end, "", False, ""
                at = end
            elif m := _OPEN.match(page, at + 1 + (c == "/")):
                end = self._tag_end(m.end())
                if end < 0:
                    at += 1
                    continue
                name, attributes = m[0].lower(), page[m.end() : end]
                if name in SKIPPED and c != "/":
                    behind = self._content_end(name, end + 1)
                    if behind >= 0 or name in RAW:
                        behind = behind if behind >= 0 else n
                        yield at, behind, "", False, name
                        at = behind
                        continue
                yield at, end + 1, name, c == "/", attributes
                at = end + 1
            else:
                at += 1


def read_page(page: str) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int, bool]]]:
    """Blocks (text, is kept by the rules) and elements (subtree hash, first block, end of its blocks, inside an article).

    Rules: furniture goes by tag, role, class and id; where a page has a main element outside of furniture with text, only
    that counts, else its articles. An article inside an article is a reader's comment.
    """
    texts: list[str] = []
    furniture_at: list[bool] = []
    article_at: list[bool] = []
    main_at: list[bool] = []
    elements: list[tuple[int, int, int, bool]] = []
    # element: [name, furniture, article, main, parts for its hash, first block, inside an article]
    stack: list[list] = []
    blocks_open: list[int] = []  # places of block-level elements in the stack
    open_names: Counter = Counter()
    within = [0, 0, 0]  # open furniture, articles, main elements
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            if stack:
                stack[-1][4].append(xxhash.xxh64_hexdigest(text))
            texts.append(text)
            furniture_at.append(within[0] > 0)
            article_at.append(within[1] > 0)
            main_at.append(within[2] > 0)

    def close() -> None:
        e = stack.pop()
        open_names[e[0]] -= 1
        if blocks_open and blocks_open[-1] == len(stack):
            blocks_open.pop()
        for k in range(3):
            within[k] -= e[k + 1]
        if e[5] < len(texts):
            h = xxhash.xxh64_intdigest("\x00".join([e[0], *e[4]])) >> 1
            if stack:
                stack[-1][4].append(str(h))
            if e[0] not in ("html", "body", "article", "main"):
                elements.append((h, e[5], len(texts), e[6]))

    at = 0
    for begin, end, name, closes, attributes in _Tags(page):
        held.append(page[at:begin])
        at = end
        if not name:
            if attributes and attributes not in ("head", "title"):
                held.append(" ")
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name in BLOCKS:
            flush()
        if name == "hr":
            continue
        if closes:
            if open_names[name] > 0:
                while stack[-1][0] != name:
                    close()
                close()
            continue
        if name in BLOCKS:
            # a paragraph, and what is inline in it, ends where a block begins
            k = blocks_open[-1] if blocks_open else -1
            if k >= 0 and (stack[k][0] == "p" or stack[k][0] in _CLOSED_BY.get(name, ())):
                k -= 1
            while len(stack) > k + 1:
                close()
            blocks_open.append(len(stack))
        sure, doubtful, role = _marks(attributes) if attributes else (False, False, "")
        inside = within[1] + within[2] > 0
        article, main = name == "article", name == "main" or role == "main"
        furniture = sure or (doubtful and not inside) or name in FURNITURE or (name == "header" and not inside) or (article and within[1] > 0)
        furniture = furniture and name not in ("main", "body", "html") and not (article and within[1] == 0)
        open_names[name] += 1
        for k, flag in enumerate((furniture, article, main)):
            within[k] += flag
        stack.append([name, furniture, article, main, [], len(texts), inside])
        if attributes.rstrip().endswith("/"):
            close()
    held.append(page[at:])
    flush()
    while stack:
        close()
    good = [not f for f in furniture_at]
    for chosen in (main_at, article_at):
        if any(g and c for g, c in zip(good, chosen, strict=True)):
            good = [g and c for g, c in zip(good, chosen, strict=True)]
            break
    return list(zip(texts, good, strict=True)), elements


def blocks_of(page: str) -> list[tuple[str]]:
    """The blocks of a page that the rules keep."""
    return [(text,) for text, good in read_page(page)[0] if good]


def _innermost(elements: list) -> list:
    """Without elements whose one child covers the same blocks: it recurs wherever they do. Children come before parents."""
    out: list = []
    for e in elements:
        if not (out and out[-1][1:] == e[1:]):
            out.append(e)
    return out


def _read(batches):
    element = pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("inside", pa.bool_())])
    names = ["row_id", "page_id", "url", "host"]
    for batch in released(batches):
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            read = [read_page(page or "") for page in part.column("html").to_pylist()]
            texts = [[text if good else None for text, good in blocks] for blocks, _ in read]
            content = [xxhash.xxh64_intdigest("\n".join(x for x in t if x is not None)) >> 1 for t in texts]
            # a host's subtrees are its own
            elements = [[{"h": xxhash.xxh64_intdigest(f"{host}\0{h}") >> 1, "lo": lo, "hi": hi, "inside": inside} for h, lo, hi, inside in _innermost(found)] for host, (_, found) in zip(part.column("host").to_pylist(), read, strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(content), pa.array(texts, pa.list_(pa.string())), pa.array(elements, pa.list_(element))], names=[*names, "content", "texts", "elements"])


def left_of(texts: list, ranges: list[dict]) -> tuple[str, int, int]:
    """Text of a page without the template ranges; how many blocks went as templates, and how many by the rules alone.

    Ranges inside an article count only if they hold less than half of the text that the rules keep.
    """
    covered = [np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts) + 1, np.int64)]
    for r in ranges:
        covered[int(r["inside"])][r["lo"]] += 1
        covered[int(r["inside"])][r["hi"]] -= 1
    sure, doubt = (np.cumsum(c)[:-1] > 0 for c in covered)
    sizes = np.array([0 if t is None else len(t) for t in texts], np.int64)
    gone = sure | doubt if 2 * sizes[doubt & ~sure].sum() < sizes.sum() else sure
    ruled = np.array([t is None for t in texts], bool)
    return "\n".join(t for t, g in zip(texts, gone, strict=True) if t is not None and not g), int(gone.sum()), int((ruled & ~gone).sum())


def _left(templates: np.ndarray | None = None):
    """Rows with their template ranges, or with all elements where the (sorted) hashes of the templates are at hand."""

    def run(batches):
        for batch in released(batches):
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                ranges = part.column("ranges").to_pylist()
                if templates is not None:
                    ranges = [[r for r, known in zip(found, np.isin([r["h"] for r in found], templates), strict=True) if known] for found in ranges]
                out = [left_of(texts, found or []) for texts, found in zip(part.column("texts").to_pylist(), ranges, strict=True)]
                columns = [pa.array([x[0] for x in out], pa.string()), *[pa.array(values, pa.int64()) for values in ([len(x[0]) for x in out], [x[1] for x in out], [x[2] for x in out])]]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_template_blocks", "n_rule_blocks"])

    return run


def main_text(pages: DataFrame, min_pages: int = 3, min_share: float = 0.2) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars, n_template_blocks, n_rule_blocks, one row per row of pages.

    Of a host's pages with equal text one counts. A subtree goes where it recurs on min_share of these pages,
    and on min_pages of them at least: two pages are not told from copies. Subtrees inside an article are counted
    alike, but stay where they hold half of the page's text or more. The last two columns count the blocks that
    went as templates, and those that went by the rules of read_page alone. Null and empty pages, and pages of furniture
    alone, have an empty text. A null or odd url counts as a host of its own (the empty one). Other columns are ignored.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("row_id"), "page_id", "url", F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    keys = f"page_id {kinds['page_id']}, url {kinds['url']}"
    read = rows.mapInArrow(_read, f"row_id long, {keys}, host string, content long, texts array<string>, elements array<struct<h:long,lo:int,hi:int,inside:boolean>>")
    # the one copy of the text; row ids are fixed by being written
    read = written(read, "pages-blocks")
    host = F.xxhash64("host").alias("host")
    seen = read.select("content", host, F.explode("elements.h").alias("h")).distinct()
    sizes = read.select("content", host).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = seen.groupBy("h").agg(F.count("*").alias("n"), F.first("host").alias("host")).where(F.col("n") >= min_pages)
    often = written(often.join(sizes, "host").where(F.col("n") >= min_share * F.col("pages")).select("h"), "pages-templates")
    out_schema = f"{keys}, text string, n_chars long, n_template_blocks long, n_rule_blocks long"
    if often.count() <= BROADCAST_ROWS:
        known = np.sort(often.limit(BROADCAST_ROWS).toArrow()["h"].to_numpy())
        return read.select("page_id", "url", "texts", F.col("elements").alias("ranges")).mapInArrow(_left(known), out_schema)
    ranges = read.select("row_id", F.explode("elements").alias("e")).select("row_id", "e.*").join(often, "h", "left_semi").groupBy("row_id").agg(F.collect_list(F.struct("lo", "hi", "inside")).alias("ranges"))
    out = read.select("row_id", "page_id", "url", "texts").join(ranges, "row_id", "left").select("page_id", "url", "texts", "ranges")
    return out.mapInArrow(_left(), out_schema)
