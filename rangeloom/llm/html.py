"""Main text of HTML pages, with boilerplate found by a host suffix array.

1. A page is cut into blocks of text by its markup. Blocks inside an article (or main) part are the article; blocks inside
   menus, headers, footers, sidebars, notices, adverts, forms and reader comments are not; scripts, styles and the head are
   no text at all. Blocks that no part of the markup claims are open, on pages with an article too.
2. What lies outside a page's articles is one token stream, across its blocks, so a menu of one-word items is one long substring. The
   streams are concatenated by host and sorted as a suffix array, per batch of pages; suffixes are compared to RUN tokens, as a place is
   covered by a repeated substring of RUN tokens or more exactly if it is by one of RUN. Neighbours that are equal that far are one repeated
   substring, counted by distinct pages and summed over batches. So a menu on a third of all pages is sent as one count a
   batch, and no task holds a host.
3. An open block is boilerplate if long substrings that at least MIN_PAGES distinct pages of its host share cover half of its
   tokens. What is left, in page order, is the text. Articles are never cut: a passage that several articles quote is text.

Only pages with open blocks are shuffled, and of those the places that repeated substrings begin at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import Shelf, table

RUN = 5
MIN_PAGES = 3
MAIN, OPEN, OUT = 0, 1, 2

#: Comments, other declarations, and tags: attributes have a value in quotes, one without (which may hold quotes), or none.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?<![^\s/\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Their content is no text of the page.
_SILENT = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "title", "textarea", "math", "audio", "video"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of names (class, id, role) that tell of boilerplate, and parts that only say what shape it has. A name counts if it is made
#: of these alone: share-buttons is boilerplate, share-price is not.
_HINTS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead contentinfo complementary sidebar widget ad ads advert adverts advertisement advertising sponsor sponsored promo banner "
    "cookie cookies consent notice popup modal newsletter subscribe share sharing social related comment comments disqus respond search login signup".split()
)
_SHAPES = set(
    "bar box container wrapper wrap link links list button buttons btn section block area item items inner outer main site page global header top bottom left right primary secondary body "
    "slot unit form field posts articles stories author reply thread toolbar panel row col group icon icons".split()
)
_WHITE = re.compile(r"\s+")


def is_hint(value: str) -> bool:
    """Whether a class, id or role attribute names boilerplate."""
    for name in value.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p and not p.isdigit()]
        if any(p in _HINTS for p in parts) and all(p in _HINTS or p in _SHAPES for p in parts):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, MAIN, OPEN or OUT) of each block in page order; what an inline advert holds is a block of its own, out.

    A tag that the page's end cuts off is no text, as in browsers; a sign that begins no tag is text.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone each set
    zone = OPEN
    parts: list[str] = []
    muted: list[str] = []  # open inline elements, from the first that is boilerplate on
    aside: list[str] = []

    def said(held: list[str], where: int) -> None:
        text = _WHITE.sub(" ", html.unescape("".join(held))).strip() if held else ""
        if text:
            out.append((text, where))
        held.clear()

    def flush() -> None:
        said(parts, zone)
        said(aside, OUT)
        muted.clear()

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        (aside if muted else parts).append(page[at:start])
        if start == n:
            break
        m = _TAG.match(page, start)
        if not m:
            (aside if muted else parts).append("<")
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in _INLINE:
                if name in muted:
                    while muted.pop() != name:
                        pass
                elif name == "br":
                    parts.append(" ")
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    zone = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name in _SILENT:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                if name == "title":
                    flush()
            continue
        hint = bool(m[3]) and any(is_hint(a or b or c) for a, b, c in _NAMED.findall(m[3]))
        if name in _INLINE:
            if name == "br":
                (aside if muted else parts).append(" ")
            elif name not in _VOID and (muted or (hint and zone != OUT)):
                if not muted:
                    parts.append(" ")
                muted.append(name)
            continue
        flush()
        if name in _VOID:
            continue
        if name == "p" or name in ("li", "tr", "td", "th", "dt", "dd", "option"):
            # An open one of the same name ends here, as far as no other element was opened inside it.
            if stack and stack[-1][0] == name:
                zone = stack.pop()[1]
        stack.append((name, zone))
        if name in ("body", "html", "head"):
            continue
        if zone != OUT:
            if name in _BOILERPLATE or hint or (name == "header" and zone != MAIN):
                zone = OUT
            elif name in ("article", "main"):
                zone = MAIN
    flush()
    return out


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return (m[1] if m else "").lower()


def _tokens(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in text.encode().lower().split()], np.uint64)


def _grams(tokens: np.ndarray, seed: int, run: int) -> np.ndarray:
    """A 64-bit name of the run tokens from each place on."""
    n = len(tokens) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed))
    for k in range(run):
        out = (out ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def repeated_substrings(streams: list[tuple[int, int, np.ndarray]], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(name, distinct pages) of each substring of `run` tokens in the suffix array of (host, page, tokens) streams.

    Streams are concatenated by host; a suffix starts where `run` tokens of one stream follow, and is sorted by host and then by
    those tokens. Suffixes with equal beginnings are neighbours; each group counts its distinct pages once.
    """
    streams = sorted(streams, key=lambda s: s[0])
    names = [_grams(t, host, run) for host, _, t in streams]
    name = np.concatenate(names) if names else np.zeros(0, np.uint64)
    page = np.repeat([p for _, p, _ in streams], [len(x) for x in names]) if names else np.zeros(0, np.int64)
    array = np.lexsort((page, name))
    name, page = name[array], page[array]
    new_group = np.append(True, name[1:] != name[:-1]) if len(name) else np.zeros(0, bool)
    new_page = new_group | np.append(True, page[1:] != page[:-1]) if len(name) else new_group
    at = np.flatnonzero(new_group)
    return name[at], np.add.reduceat(new_page.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, min_pages: int = MIN_PAGES, shelf: Shelf | None = None) -> DataFrame:
    """(id, url, text) for each row; text is empty if nothing is left.

    A null or empty page has an empty text; a null or hostless url is a host of its own. Repeated rows count as pages of
    their own and come out alike. A very long page is one row of blocks. A null id is carried; an empty table gives an empty table; other
    columns are not read.
    """
    from xxhash import xxh64_intdigest

    shelf = shelf or Shelf(pages.sparkSession)
    kind = dict(pages.dtypes)[id_col]
    block = "array<struct<text:string,zone:int>>"
    block_type = pa.list_(pa.struct([("text", pa.string()), ("zone", pa.int32())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                got = [[{"text": t, "zone": z} for t, z in blocks(x.as_py() or "")] for x in part.column(2)]
                hosts = pa.array([xxh64_intdigest(_host(u)) >> 1 for u in part.column(1).to_pylist()], pa.int64())
                is_open = pa.array([any(b["zone"] == OPEN for b in g) for g in got], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), hosts, is_open, pa.array(got, block_type)], ["id", "url", "host", "open", "blocks"])

    parsed = shelf.keep(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(parse, f"id {kind}, url string, host long, open boolean, blocks {block}"))

    def stream(got: list[dict]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The tokens outside articles, across blocks, and (block, from, to) of each open one."""
        tokens, held, size = [], [], 0
        for k, b in enumerate(got):
            if b["zone"] != MAIN:
                tokens.append(_tokens(b["text"]))
                if b["zone"] == OPEN:
                    held.append((k, size, size + len(tokens[-1])))
                size += len(tokens[-1])
        return np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), held

    def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                name, n = repeated_substrings([(host, p, stream(got)[0]) for p, (host, got) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))], run)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n)], ["name", "pages"])

    counted = parsed.select("host", "blocks").mapInArrow(sort_suffixes, "name long, pages long").groupBy("name").agg(F.sum("pages").alias("pages"))
    repeated = counted.where(F.col("pages") >= min_pages).select("name")

    def open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, host, got in zip(*(batch.column(k).to_pylist() for k in range(3))):
                tokens, held = stream(got)
                names = _grams(tokens, host, run)
                near = np.zeros(len(names), bool)
                for _, a, b in held:
                    near[max(0, a - run + 1) : b] = True
                at = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(names[at].view(np.int64))], ["key", "place", "name"])

    # A page with open blocks is named by its content, so that repeated ids stay apart.
    key = F.sha2(F.to_json(F.struct("id", "url", "blocks")), 256)
    open_pages = parsed.where("open").select("id", "url", "host", "blocks", key.alias("key"))
    runs = open_pages.select("key", "host", "blocks").mapInArrow(open_runs, "key string, place int, name long").distinct()
    covered = runs.join(repeated, "name").groupBy("key").agg(F.collect_list("place").alias("places"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for got, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                tokens, held = stream(got)
                change = np.zeros(len(tokens) + 1, np.int64)
                at = np.array(places or [], np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + run, -1)
                cover = np.cumsum(change)[:-1] > 0
                lost = {k for k, a, b in held if 2 * int(cover[a:b].sum()) >= b - a}
                texts.append("\n\n".join(b["text"] for k, b in enumerate(got) if b["zone"] == MAIN or (b["zone"] == OPEN and k not in lost)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    with_open = open_pages.join(covered, "key", "left").select("id", "url", "blocks", "places").mapInArrow(decide, f"id {kind}, url string, text string")
    article = F.array_join(F.transform(F.filter("blocks", lambda b: b["zone"] == MAIN), lambda b: b["text"]), "\n\n")
    out = parsed.where("not open").select("id", "url", article.alias("text")).unionByName(with_open)
    return out.withColumnsRenamed({"id": id_col, "url": url_col} if url_col != "url" else {"id": id_col})


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
