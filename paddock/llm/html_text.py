"""Main text of web pages: markup blocks and nearest-URL page differencing.

Pages of one host share a template.  Each page's blocks outside its article are
aligned with those of the page whose URL path is nearest in the host (the
neighbour in path order with the longer common prefix) by a longest common
subsequence, and shared lines are deleted.  Markup then decides what the
differencing cannot see: menus, notices or adverts whose words differ from page
to page.  Lines inside an explicit article are never deleted as shared: copies
of an article on one host would otherwise lose their text.

Neighbours are found in a range-partitioned sort by (host, path), one row a
path: a host with most of the pages is spread like any other key.  The first
and last row of each partition meet their neighbours in a second step over
these rows alone.  Only hashes of template lines take part; the texts are
shuffled once, to their pair.

Defined cases: NULL or empty html: empty text.  NULL url: a host of its own;
so are all urls without // whose first segment has no dot.
Pages with the same host and path are one place (query and fragment do not
count) and are not compared with each other.  Repeated rows give repeated
results.  White space is any that Unicode names; ``br`` counts as white space.
Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import shuffle_parts, stored, with_computed

# HTML elements by their meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section select summary table tbody td tfoot th thead title tr ul""".split())
NOT_TEXT = frozenset("""aside audio button canvas datalist dialog fieldset footer form frameset head iframe input map menu meter
    nav noscript object optgroup option output picture progress search select svg template textarea title video""".split())
NOT_TEXT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words in class and id that mark what is not the article.
NOT_TEXT_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent
    cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup
    promo promoted recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar
    widget widgets""".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)"
    r"|<(?P<raw>script|style|xmp)\b[^>]*+>(?:.*?</(?P=raw)\s*+>|.*)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*+)(?P<attributes2>[^>]*+)>"
    r"|<[!?][^>]*+>", re.I | re.S)
_ATTRIBUTE = re.compile(r"(?P<name>[a-z-]+)(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOT_TEXT or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m["name"].lower(), (m["a"] or m["b"] or m["c"] or "").lower()
        if name in ("class", "id"):
            # Names such as has-sidebar or no-menu tell of the layout, not of the element.
            words = _WORD.findall(" ".join(v for v in value.split() if not v.startswith(("has-", "with-", "no-"))))
            if any(w in NOT_TEXT_WORDS for w in words) or not in_article and tag != "article" and "header" in words:
                return True
        elif name == "role" and value in NOT_TEXT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(html: str) -> list[tuple[str, bool, bool, bool]]:
    """(text, in an article, in a main element, wanted by its markup) of each text block, in order."""
    out: list[tuple[str, bool, bool, bool]] = []
    stack: list[tuple[str, bool]] = []          # open elements and whether each is unwanted
    depth = {"article": 0, "main": 0, "unwanted": 0}
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                out.append((text, depth["article"] > 0, depth["main"] > 0, depth["unwanted"] == 0))
            parts.clear()

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK or tag in NOT_TEXT:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m["end"] or m["end2"]:
            if any(t == tag for t, _ in stack):
                while True:
                    if stack[-1][1]:
                        flush()
                    open_tag, unwanted = stack.pop()
                    depth["unwanted"] -= unwanted
                    if open_tag in ("article", "main"):
                        depth[open_tag] -= 1
                    if open_tag == tag:
                        break
        elif tag not in VOID and (tag in BLOCK or tag in NOT_TEXT or (m["attributes"] or m["attributes2"] or "").strip()):
            unwanted = _unwanted(tag, m["attributes"] or m["attributes2"] or "", depth["article"] > 0)
            if unwanted:
                flush()
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
                # Their end tags may be missing: an element of the same kind ends the one before.
                if stack and stack[-1][0] == tag:
                    depth["unwanted"] -= stack.pop()[1]
            stack.append((tag, unwanted))
            depth["unwanted"] += unwanted
            if tag in ("article", "main"):
                depth[tag] += 1
    parts.append(html[at:])
    flush()
    return out


def split_page(html: str | None) -> tuple[list[str], list[tuple[str, bool]]]:
    """Blocks of the article, and the other blocks with what their markup says.

    The article: what stands in article elements, else in main elements, else
    none (then all blocks are other blocks)."""
    found = blocks(html or "")
    where = next((k for k in (1, 2) if any(b[k] and b[3] for b in found)), 0)
    inside = [b[0] for b in found if where and b[where] and b[3]]
    # With an article, whatever stands outside it is not wanted.
    return inside, [(b[0], b[3] and not where) for b in found if not (where and b[where])]


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Indexes in ``a`` of a longest common subsequence with ``b`` (the rarest
    matches are tried last to first, so memory follows the matches)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = {*range(head), *range(len(a) - tail, len(a))}
    places: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []                 # smallest last place in b of a chain of each length
    chain: list[tuple] = []              # (index in a, the chain before)
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(node)
            elif j < ends[k]:
                ends[k], chain[k] = j, node
    node = chain[-1] if chain else None
    while node:
        shared.add(node[0])
        node = node[1]
    return shared


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


_ROW = "host string, path string, lines array<long>, before string, before_lines array<long>, after string, after_lines array<long>, edge boolean"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (host, path), each with the rows before and after it in the same host."""
    held, last, first = None, None, True

    def row(now: tuple, before: tuple | None, after: tuple | None, edge: bool) -> tuple:
        of = lambda x: (x[1], x[2]) if x and x[0] == now[0] else (None, None)
        return (*now, *of(before), *of(after), edge)

    for batch in batches:
        out = []
        for now in zip(batch["host"], batch["path"], batch["lines"], strict=True):
            if held:
                out.append(row(held, last, now, first))
                first = False
            last, held = held, now
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _ROW.split(", ")])
    if held:
        yield pd.DataFrame([row(held, last, None, True)], columns=[c.split()[0] for c in _ROW.split(", ")])


def nearest_pages(places: DataFrame) -> DataFrame:
    """(host, path, lines), one row a place -> (host, path, partner): the lines
    of the nearest other path of the host (NULL if there is none)."""
    parts = shuffle_parts(places.sparkSession)
    rows = stored(places.repartitionByRange(parts, "host", "path").sortWithinPartitions("host", "path").mapInPandas(_neighbours, _ROW), "neighbours")
    # At most two rows a partition, whatever the number of pages.
    edges = rows.where("edge").select("host", "path", "lines").coalesce(1).sortWithinPartitions("host", "path").mapInPandas(_neighbours, _ROW)
    edges = edges.select("host", "path", F.col("before").alias("b2"), F.col("before_lines").alias("bl2"), F.col("after").alias("a2"), F.col("after_lines").alias("al2"))
    whole = rows.where("edge").drop("edge").join(edges, ["host", "path"]).select(
        "host", "path", F.coalesce("before", "b2").alias("before"), F.when(F.col("before").isNull(), F.col("bl2")).otherwise(F.col("before_lines")).alias("before_lines"),
        F.coalesce("after", "a2").alias("after"), F.when(F.col("after").isNull(), F.col("al2")).otherwise(F.col("after_lines")).alias("after_lines"))
    both = rows.where("NOT edge").select(*whole.columns).unionByName(whole)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            partner = []
            for r in batch.itertuples():
                b = -1 if r.before is None else _common_prefix(r.path, r.before)
                a = -1 if r.after is None else _common_prefix(r.path, r.after)
                partner.append(r.after_lines if a > b else r.before_lines if b >= 0 else None)
            yield pd.DataFrame({"host": batch["host"], "path": batch["path"], "partner": partner})

    return both.mapInPandas(pick, "host string, path string, partner array<long>")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines outside the article that the nearest page
    shares, deleted by differencing), n_unwanted (lines that differencing leaves and markup deletes) for every row."""
    # A host follows // or, without that, is a first segment with a dot in it.
    start = r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)|([^/?#:\s]+\.[^/?#\s]+))"
    url = F.coalesce("url", F.lit(""))
    placed = pages.select("page_id", "url", "html").withColumns({
        "host": F.lower(F.concat(F.regexp_extract(url, start, 1), F.regexp_extract(url, start, 2))),
        "path": F.regexp_replace(F.regexp_extract(url, start + r"?([^?#]*)", 3), r"(/|\.html?)$", "")})

    def lines(htmls: list[str | None]) -> list:
        return [[[line_hash(line) for line, _ in split_page(h)[1]] for h in htmls]]

    hashed = with_computed(placed, ["host", "path"], "html", lines, "lines array<bigint>")
    # One row for each place: the page with most lines speaks for it (ties: the largest list).
    places = hashed.groupBy("host", "path").agg(F.max(F.struct(F.size("lines").alias("n"), "lines")).alias("top")).select("host", "path", "top.lines")
    nearest = nearest_pages(places)

    def split(htmls: list[str | None]) -> list:
        done = [split_page(h) for h in htmls]
        return [["\n".join(inside) for inside, _ in done], [[{"line": t, "wanted": w, "hash": line_hash(t)} for t, w in other] if not inside else [{"line": None, "wanted": False, "hash": line_hash(t)} for t, _ in other] for inside, other in done]]

    parsed = with_computed(placed, ["page_id", "url", "host", "path"], "html", split, "inside string, other array<struct<line:string,wanted:boolean,hash:bigint>>")
    paired = parsed.join(nearest, ["host", "path"], "left").select("page_id", "url", F.struct("inside", "other", "partner").alias("page"))

    def differ(rows: list[dict]) -> list:
        texts, counts, unwanted = [], [], []
        for r in rows:
            shared = common_lines([x["hash"] for x in r["other"]], r["partner"]) if r["partner"] else set()
            rest = [x["line"] for i, x in enumerate(r["other"]) if x["wanted"] and i not in shared]
            texts.append("\n".join(([r["inside"]] if r["inside"] else []) + rest))
            counts.append(len(shared))
            unwanted.append(len(r["other"]) - len(shared) - len(rest))
        return [texts, [len(t) for t in texts], counts, unwanted]

    return with_computed(paired, ["page_id", "url"], "page", differ, "text string, n_chars long, n_shared long, n_unwanted long")
