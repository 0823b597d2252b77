"""Operator 8, main text of web pages: page structure, and differencing against the page of the nearest URL.

1. A page is read into blocks, one line of text each, with scripts, styles, menus,
   headers, footers, sidebars, adverts, notices, forms and reader comments left out.
2. A page with an article (or main) element is that element's lines.
3. In any other page, structure can't tell template from text. Such pages stand in
   the order of host, URL path and id, without empty ones, and pages of a host with
   the same lines once; each is paired with the neighbour in order
   that shares the longer path on the same host. The lines of the two are aligned by
   their longest common subsequence, and the shared ones are deleted.

Differencing is kept to pages of kind 3, because articles that quote or copy one
another share lines that are no template.

Defined cases: null or empty html gives an empty text; a null or relative url has
host "" and no partner; repeated rows are extracted each; a page alone on its host
keeps its lines; extra columns are not read; an empty table gives an empty result.
Pages are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, map_arrow, materialize

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^>]*+>?|[^<]++|<""", re.DOTALL)
RAW = {"script", "style", "textarea", "title", "template", "iframe", "xmp", "noembed", "noframes", "select"}
RAW_END = {t: re.compile(rf"</{t}(?![A-Za-z0-9-])[^>]*>", re.IGNORECASE) for t in RAW}
DROP = {"nav", "footer", "header", "aside", "form", "head", "menu", "dialog", "button", "fieldset", "label"}
BLOCK = {"address", "article", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
         "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "aside", "caption", "dialog", "title", "search", "optgroup", "option"}
HOLDS = BLOCK - {"p", "hr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd"} | {"button", "label"}
CLASS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|login|sidebar|side-bar|menus?|nav|navbar|navigation|navmenu|breadcrumbs?|footer|header|masthead|"
    r"topbar|toolbar|share|sharing|social|related|recommended|comments?|comment-list|replies|disqus|respond|widget|contentinfo|complementary|search|skip-link|pagination|pager)(?=$|[\s_-])",
    re.IGNORECASE,
)


#: Inside an article a section may well be about a search or related work: there, fewer words count, and most only as a whole name.
NOISE_INSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsored|cookies?|consent|newsletter|comments?|disqus)(?=$|[\s_-])"
    r"|(?:^|\s)(?:sponsor|promo|promotion|banner|gdpr|notices?|popup|modal|subscribe|signup|login|sidebar|side-bar|menus?|nav|navbar|navigation|breadcrumbs?|footer|share|sharing|social|replies|respond|widget|pagination|pager)(?=$|\s)",
    re.IGNORECASE,
)


def noisy(attributes: str, inside: bool = False) -> bool:
    return any((NOISE_INSIDE if inside else NOISE).search(a or b or c) for a, b, c in CLASS.findall(attributes))


def blocks(page: str) -> tuple[list[str], list[str], bool]:
    """(lines inside an article or main, lines outside, whether there is such an element); dropped parts are in neither."""
    inside: list[str] = []
    outside: list[str] = []
    now: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # (tag, dropped from here, main from here)
    dropped = main = 0
    found = False

    def close() -> None:
        if now:
            line = " ".join(unescape("".join(now)).split())
            if line:
                (inside if main else outside).append(line)
            now.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or at == m.start() + 1:
                if not dropped:
                    now.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if tag in HOLDS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close()
                        for _, d, a in stack[k:]:
                            dropped -= d
                            main -= a
                        del stack[k:]
                        break
            if tag in BLOCK:
                close()
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK or tag in HOLDS:
            close()
        elif tag == "br":
            now.append(" ")
        if tag in HOLDS:
            if m[3].endswith("/"):
                continue
            is_main = tag in ("article", "main") or bool(re.search(r"\brole\s*=\s*[\"']?main\b", m[3]))
            if is_main:  # an advert that was never closed ends here
                while stack and stack[-1][1] and stack[-1][0] in ("div", "section"):
                    _, d, a = stack.pop()
                    dropped -= d
                    main -= a
            drop = tag in DROP and not (tag == "header" and main) or tag not in ("html", "body") and bool(m[3]) and noisy(m[3], main > 0)
            is_main = is_main and not drop and not dropped
            found |= is_main
            stack.append((tag, drop, is_main))
            dropped += drop
            main += is_main
    close()
    return inside, outside, found


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b, by bit-parallel dynamic programming."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        v = rows[-1]
        u = v & where.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    # a zero bit j of row i: the best of a[:i] against b[:j + 1] is one more than against b[:j]
    length = lambda i, j: (~rows[i] & ((1 << j) - 1)).bit_count()
    out: set[int] = set()
    i, j = len(a), len(b)
    left = length(i, j)
    while left:
        if length(i - 1, j) == left:
            i -= 1
        elif a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j, left = i - 1, j - 1, left - 1
        else:
            j -= 1
    return out


def own_lines(lines: list[str], other: list[str]) -> list[str]:
    """lines without those shared with the paired page."""
    shared = common_lines(lines, other)
    return [x for k, x in enumerate(lines) if k not in shared]


URL = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", re.IGNORECASE)


def host_and_path(url: str | None) -> tuple[str, str]:
    m = URL.match(url or "")
    return (m[1].lower(), m[2] or "/") if m else ("", url or "")


PARSED = "id long, url string, host string, path string, sure boolean, lines array<string>"


def parsed(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        urls = b.column(1).to_pylist()
        got = [blocks(h or "") for h in b.column(2).to_pylist()]
        at = [host_and_path(u) for u in urls]
        cols = [pa.array([h for h, _ in at], pa.string()), pa.array([p for _, p in at], pa.string()), pa.array([found for _, _, found in got], pa.bool_()), pa.array([a if found else o for a, o, found in got], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["id", "url", "host", "path", "sure", "lines"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(src, each, PARSED)


SPAN = 64


def differenced(pages: DataFrame) -> DataFrame:
    """(host, text, lines): pages (id, url, host, path, lines, text) with the lines shared with each one's nearest URL deleted.

    Pages are numbered in order, and go in runs of SPAN to a task, each run with the
    page before and the page after it: a host of any size is many runs.
    """
    n = in_order(pages, ["host", "path", "id", "url"], "__at", "ordered")
    run = F.floor(F.col("__at") / SPAN)
    runs = F.array(run, F.when(F.col("__at") % SPAN == 0, run - 1), F.when(F.col("__at") % SPAN == SPAN - 1, run + 1))
    n = n.withColumn("__run", F.explode(F.filter(runs, lambda x: x.isNotNull() & (x >= 0))))

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at", kind="stable")
        rows = list(pdf[["host", "text", "path", "lines", "__at"]].itertuples(index=False, name=None))
        out = []
        for k, (host, text, path, lines, at) in enumerate(rows):
            if at // SPAN != key[0]:
                continue
            near = [rows[j] for j in (k - 1, k + 1) if 0 <= j < len(rows) and rows[j][0] == host]
            own = list(lines)
            if near:
                # the first of equals: the page before
                other = max(near, key=lambda r: shared_path(path, r[2]))
                own = own_lines(own, list(other[3]))
            out.append((host, text, own))
        return pd.DataFrame({c: pd.Series([r[k] for r in out], dtype="int64" if c == "text" else object) for k, c in enumerate(("host", "text", "lines"))})

    return n.groupBy("__run").applyInPandas(each, "host string, text long, lines array<string>")


def told_apart(pages: DataFrame) -> DataFrame:
    """(id, url, lines) of pages without an article: differencing goes by the first page of each text of a host, and its copies get what it gets."""
    pages = pages.withColumn("text", F.xxhash64("lines"))
    some = pages.where("size(lines) > 0 AND host <> ''")
    first = some.groupBy("host", "text").agg(F.min(F.struct("path", "id", "url", "lines")).alias("p")).select("p.id", "p.url", "host", "p.path", "p.lines")
    # written first: its number names a text from here on
    first = materialize(first.withColumn("text", F.xxhash64("lines")), "texts")
    own = differenced(first).select("host", "text", F.col("lines").alias("own"))
    got = pages.join(own, ["host", "text"], "left")
    return got.select("id", "url", F.coalesce("own", "lines").alias("lines"))


def shared_path(a: str, b: str) -> int:
    """Leading path segments that two paths share."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, lines, text): the main text's lines in page order, and joined."""
    pages = materialize(parsed(df, id_col, url_col, html_col), "pages")
    sure = pages.where("sure").select("id", "url", "lines")
    unsure = pages.where("NOT sure").select("id", "url", "host", "path", "lines")
    both = sure if unsure.isEmpty() else sure.union(told_apart(unsure))
    return both.select("id", "url", "lines", F.array_join("lines", "\n").alias("text"))
