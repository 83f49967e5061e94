"""Main text of web pages: markup rules for page furniture and a suffix array per host for the rest.

A page is cut into blocks (headings, paragraphs, list items, cells ...).  Blocks inside navigation,
headers, footers, asides, forms, dialogs or elements with a whole class, id or role token that names
furniture (``ad``, ``site-footer``, ``comment-list``; not ``with-sidebar`` or ``related-work``) are dropped,
scripts and styles with them.  A form or an element so named stays if the main element is inside.  Blocks inside
``article`` or ``main`` are kept: they are the text.  What lies outside of both is settled by
the host: the tokens of a page's other blocks, furniture included, form its stream, which the main element
and the ends of the page interrupt.  Token strings of ``RUN`` tokens or more that occur in the streams of two
distinct pages of a host are boilerplate, over the borders of blocks too: blocks that they cover go, others
lose covered runs of ``RUN`` tokens or more and keep the rest, so a text that begins with the word after
a notice keeps it.  Pages of one host whose open texts are equal or near copies
(``ngram_join``, 4 words, 85 %) count as one page, so a copied page doesn't erase itself.

The host's suffix array is not sorted beyond what decides: the suffixes of all streams are dealt by (host,
their first ``RUN`` tokens), which are the intervals of the array whose common prefix is that long.  An
interval is a row with the smallest and the largest page in it, combined before the shuffle, so
a host or a phrase of any size stays spread.  A maximal repeat of ``RUN`` tokens or more is the union of
its windows of ``RUN`` tokens, each repeated in the same pages, and a repeated window lies in a
maximal repeat; hence the cover is the same as that from sorted suffixes and common prefixes.

Null html is empty; null url is a host of its own; a page without text gives an empty one; repeated
rows give repeated rows.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosheaf.llm import ngram_join
from hydrosheaf.llm.tables import staged

RUN = 12       # tokens of a repeated string that make it boilerplate

# fixed values: element names of HTML by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe head".split())
FURNITURE = frozenset("nav header footer aside form dialog menu button select fieldset".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK
ROLES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice popup modal "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar header masthead footer comment comments reply replies disqus share sharing "
    "social related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar complementary contentinfo".split()
)
# words beside a role that leave its meaning: site-footer, ad_box, comment-list
BESIDE = frozenset(
    "site page main global top bottom left right primary secondary upper lower area bar block body box button buttons container content entry article form "
    "inner item items link links list outer panel post posts row section slot text unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_PARTS = frozenset("header footer".split())     # inside an article its own header is part of it
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPACE = re.compile(r"\s+")
KEPT, OPEN, GONE = 1, 0, 2


def _named(value: str, in_main: bool) -> bool:
    """Some whole token of a class, id or role is a role, alone or with words that leave its meaning."""
    for token in value.lower().split():
        parts = {x.rstrip("0123456789") for x in re.split("[-_]+", token)} - {""}
        roles = parts & ROLES
        if roles and parts <= ROLES | BESIDE and not (in_main and roles == {"header"}):
            return True
    return False


def _drops(name: str, attrs: str, in_main: bool) -> int:
    """0: stays, 1: goes unless it holds the main element, 2: goes."""
    if name in FURNITURE and not (in_main and name in ARTICLE_PARTS):
        return 1 if name in ("form", "fieldset") else 2
    if not attrs or name in ("html", "body") or name in MAIN:
        return 0
    found = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if key == "id" and (name in HEADINGS or in_main and name == "section"):
            continue                       # a heading's or section's id is the anchor of its title
        if key in ("class", "id", "role") and _named(value, in_main):
            found = 1
    return found


def _furniture_article(attrs: str) -> bool:
    """An article that is a comment, a teaser or the like by its own class, id or role."""
    return any(m[1].lower() in ("class", "id", "role") and _named((m[2] or "").strip("\"'"), False) for m in _ATTR.finditer(attrs))


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(KEPT, OPEN or GONE, text) of the page's blocks in order; GONE ones are furniture.

    What drops a block is a chain of [still drops, unless it holds the main element, rest of the chain],
    so that an element is given back with its earlier blocks when the main element begins in it.
    """
    html = html or ""
    found: list[tuple[list | None, int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, list | None, int]] = []       # name, what drops it, 1 in main, 2 in an article
    dropped, main = None, 0

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", unescape("".join(text)).replace("\xa0", " ")).strip()
            if line:
                found.append((dropped, main, line))
            text.clear()

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at: m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            k = max((i for i, s in enumerate(stack) if s[0] == name), default=-1)
            if k >= 0 and name not in BLOCK and any(s[0] in BLOCK for s in stack[k + 1:]):
                del stack[k]               # an inline element that closes inside a later block
            elif k >= 0:
                if name in BLOCK or stack[k][1] is not dropped or (k and stack[k - 1][1] is not stack[k][1]):
                    flush()
                del stack[k:]
                dropped, main = (stack[-1][1], stack[-1][2]) if stack else (None, 0)
            elif name in BLOCK:
                flush()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if name == "head" and close is None:
                continue
            if not m[3].endswith("/"):
                at = close.end() if close else (end if name in ("script", "style") else at)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
            while name in CLOSES_P and stack and any(s[0] == "p" for s in _own(stack)):
                stack.pop()
                dropped, main = (stack[-1][1], stack[-1][2]) if stack else (None, 0)
            for twin in _IMPLIED.get(name, ()):
                if stack and stack[-1][0] == twin:
                    stack.pop()
                    dropped, main = (stack[-1][1], stack[-1][2]) if stack else (None, 0)
        if name in VOID or m[3].endswith("/"):
            continue
        is_main = 2 if name == "article" else int(name in MAIN or bool(re.search(r"role\s*=\s*[\"']?main\b", m[3], re.I)))
        if is_main and main < 2 and dropped and all(c[1] for c in _chain(dropped)) and not _furniture_article(m[3]):
            flush()
            for c in _chain(dropped):
                c[0] = False
        how = 0 if dropped and dropped[0] and not dropped[1] else _drops(name, m[3], bool(main))
        if how and not (is_main and how == 1):
            flush()
            dropped = [True, how == 1, _live(dropped)]
        main = max(main, is_main)
        stack.append((name, dropped, main))
    flush()
    return [(GONE if _live(d) else KEPT if k else OPEN, line) for d, k, line in found]


def _chain(dropped):
    """Links that still drop."""
    while dropped:
        if dropped[0]:
            yield dropped
        dropped = dropped[2]


def _live(dropped):
    """First link that still drops; links given back are passed over once."""
    while dropped and not dropped[0]:
        dropped = dropped[2]
    return dropped


_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}


def _own(stack):
    """Elements above the innermost block other than a paragraph."""
    for s in reversed(stack):
        yield s
        if s[0] in BLOCK and s[0] != "p":
            return


def host(url: str | None) -> str | None:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "", url).split("/")[0].split("?")[0].split("#")[0].lower() if url else None


_PARTS = "row bigint, page_id bigint, url string, host string, kinds array<int>, texts array<string>"


def _cut(batches):
    """Blocks of every page; ``row`` is null where there is no open text."""
    for batch in batches:
        rows = []
        for n, i, u, h in zip(*[batch.column(c).to_pylist() for c in ("row", "page_id", "url", "html")]):
            b = blocks(h)
            rows.append((n if any(k == OPEN and t for k, t in b) else None, i, u, host(u), [k for k, _ in b], [t for _, t in b]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())))],
            names=["row", "page_id", "url", "host", "kinds", "texts"])


def _streams(kinds: list[int], texts: list[str]):
    """(tokens, number of the block of each token) of every stretch of blocks outside of the main element."""
    tokens: list[str] = []
    owner: list[int] = []
    for n, (k, t) in enumerate(zip(kinds, texts)):
        if k != KEPT:
            words = t.split()
            tokens += words
            owner += [n] * len(words)
        elif tokens:
            yield tokens, owner
            tokens, owner = [], []
    if tokens:
        yield tokens, owner


def _windows(tokens: list[str]) -> list[str]:
    """The first RUN tokens of every suffix that has so many."""
    return [" ".join(tokens[i: i + RUN]) for i in range(len(tokens) - RUN + 1)]


def _suffixes(batches):
    """Intervals (host, RUN tokens) with the smallest and largest page, combined per batch."""
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        for page, name, kinds, texts in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            for h in {h for tokens, _ in _streams(kinds, texts) for h in _windows(tokens)}:
                got = seen.setdefault((name, h), [page, page])
                got[0], got[1] = min(got[0], page), max(got[1], page)
        yield pa.RecordBatch.from_pydict({
            "host": pa.array([k[0] for k in seen], pa.string()), "h": pa.array([k[1] for k in seen], pa.string()),
            "lo": pa.array([v[0] for v in seen.values()], pa.int64()), "hi": pa.array([v[1] for v in seen.values()], pa.int64()),
        })


def _asked(batches):
    """(row, host, h) of the windows that hold a token of an open block, once per page."""
    for batch in batches:
        rows, names, found = [], [], []
        for row, name, kinds, texts in zip(*[batch.column(c).to_pylist() for c in ("row", "host", "kinds", "texts")]):
            own = set()
            for tokens, owner in _streams(kinds, texts):
                is_open = np.concatenate(([0], np.cumsum([kinds[n] == OPEN for n in owner])))
                own.update(w for i, w in enumerate(_windows(tokens)) if is_open[i + RUN] > is_open[i])
            rows += [row] * len(own)
            names += [name] * len(own)
            found += own
        yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "host": pa.array(names, pa.string()), "h": pa.array(found, pa.string())})


def _uncovered(tokens: list[str], covered: np.ndarray) -> list[str]:
    """Tokens of a block without its covered runs; of a block in part covered, short runs stay."""
    if covered.all():
        return []
    edge = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
    kept = ~covered
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        if b - a < RUN:
            kept[a:b] = True
    return [w for w, k in zip(tokens, kept) if k]


def _unique(batches):
    """Drop covered tokens of open blocks and put the text together."""
    for batch in batches:
        out = []
        for kinds, texts, common in zip(*[batch.column(c).to_pylist() for c in ("kinds", "texts", "common")]):
            known, left = set(common or ()), {}
            for tokens, owner in _streams(kinds, texts) if known else ():
                covered = np.zeros(len(tokens), bool)
                for i, w in enumerate(_windows(tokens)):
                    if w in known:
                        covered[i: i + RUN] = True
                owner = np.asarray(owner)
                for at in np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))):
                    end = int(np.searchsorted(owner, owner[at], "right"))
                    left[int(owner[at])] = _uncovered(tokens[at:end], covered[at:end])
            texts = [" ".join(left[n]) if n in left else t for n, t in enumerate(texts)]
            out.append("\n\n".join(t for k, t in zip(kinds, texts) if t and k != GONE))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _settled_copies(opened: DataFrame) -> DataFrame:
    """(row, page) of the open texts: equal texts and near copies of one host share a page."""
    salt = F.concat(F.lit("~"), F.hex(F.xxhash64("host")))          # words of different hosts differ
    open_blocks = F.filter(F.arrays_zip("kinds", "texts"), lambda b: b["kinds"] == OPEN)
    words = F.flatten(F.transform(open_blocks, lambda b: F.split(b["texts"], " ")))
    texts = opened.select(F.col("row").alias("doc_id"), F.array_join(F.transform(words, lambda w: F.concat(w, salt)), " ").alias("text"))
    return staged(ngram_join.joined(staged(texts)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("page")))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page row."""
    numbered = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html")
    cut = staged(numbered.mapInArrow(_cut, _PARTS))
    opened, plain = cut.filter("row IS NOT NULL"), cut.filter("row IS NULL")
    ready = plain.withColumn("common", F.lit(None).cast("array<string>"))
    if not opened.isEmpty():        # without open text there is nothing that a repeat could remove
        # pages without open text count as one page of their host
        paged = opened.join(_settled_copies(opened), "row").select("page", "host", "kinds", "texts").unionByName(
            plain.select(F.lit(-1).cast("bigint").alias("page"), "host", "kinds", "texts"))
        shared = (
            paged.mapInArrow(_suffixes, "host string, h string, lo bigint, hi bigint")
            .groupBy("host", "h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select(F.col("host").alias("_host"), F.col("h").alias("_h"))
        )
        # every open page asks for its own windows, so a host's intervals never gather in one row
        asked = opened.select("row", "host", "kinds", "texts").mapInArrow(_asked, "row bigint, host string, h string")
        common = asked.join(shared, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h"))).groupBy("row").agg(F.collect_list("h").alias("common"))
        ready = ready.unionByName(opened.join(common, "row", "left"))
    text = ready.mapInArrow(_unique, "page_id bigint, url string, text string")
    return text.withColumn("n_chars", F.char_length("text").cast("bigint"))
