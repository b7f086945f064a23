"""Main text of web pages by nearest-URL page differencing.

Pages are put in order of host, URL path and id. Pages next to each other that share nearly all their text (one path with
other queries, or fetched twice) are a run; a page's nearest pages are the ones of the same host just before and just
after its run, so that copies do not delete each other. The lines of both (block texts, in page order) are aligned by longest common subsequence, and lines that both
share are template and are deleted.

Differencing alone can't tell a menu or advert that differs on every page from text, nor a passage that two articles
quote from a menu. So every page of a host is compared, and markup then checks what differencing says: blocks in menus,
headers, footers, asides, forms, adverts, notices and comments are marked as boilerplate and go, found or not; where a
page marks its article (article or main element), blocks in it are kept, shared or not, and those outside go.

The order is made by range partitioning, so a host with a third of all pages is many tasks. A page at the edge of a
partition waits until the edge pages of all partitions are known, and is compared then. Only hashes of lines are
put in order; pages are read once more for their texts, which meet what was found by id, url and a digest of the hashes.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Element names of HTML, by what they mean here.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "title", "head")
BOILERPLATE = frozenset("nav header footer aside form menu dialog button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = BLOCKS - {"p"}
#: Start tags that end an open paragraph, and items that end an open one of the same list or table (up to its container).
ENDS_P = BLOCKS - {"body", "caption", "html", "legend", "li", "dd", "dt", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "figcaption"}
ENDS_ITEM = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: Words of class and id names that mark boilerplate, and words that may stand beside them in such a name. A name with
#: any other word (share-price, related-work, entry-header) marks nothing.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup "
    "promo promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
BESIDE = frozenset(
    "area article articles bar block body bottom box buttons container content form global icons inner item items left link links list main mobile outer page panel post "
    "posts primary right secondary section sign signup site slot stories text thread top unit up wrap wrapper".split()
)
OWN_HEADING = frozenset("article body content item post section text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
# Quotes count after the sign of equality only, as browsers have it.
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:{_VALUE})?+|=)*+)>", re.S)
_ATTR = re.compile(r"(?<![^\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-zA-Z]{2,}")
_SPACE = re.compile(r"\s+")
ARTICLE, NEUTRAL, TEMPLATE = "a", "n", "t"
#: Pages that share this part of their characters are near copies, from which template can't be told.
NEARLY_ALL = 0.8


def _names_boilerplate(name: str) -> bool:
    words = set(_WORD.findall(name.lower()))
    marks = words & MARKS
    if not marks or words - MARKS - BESIDE:
        return False
    return not marks <= {"header", "footer"} or not words & OWN_HEADING


def _marked(name: str, attrs: str) -> bool:
    if name in BOILERPLATE:
        return True
    for key, *values in _ATTR.findall(attrs) if attrs else ():
        value = "".join(values)
        if key.lower() == "role":
            if value.lower() in ROLES:
                return True
        elif name not in ("body", "html", "article", "main") and any(map(_names_boilerplate, value.split())):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(mark, text) of the blocks of a page, in order; white space is one space, character references are decoded.

    Mark: ARTICLE in an article or main element, TEMPLATE in boilerplate, NEUTRAL elsewhere.
    """
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, in boilerplate, in the article
    bad = own = False
    page = page or ""
    at, end = 0, len(page)

    def flush() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((TEMPLATE if bad else ARTICLE if own else NEUTRAL, text))

    def end_open(names: set, within: set) -> None:
        """End the open element of one of the names, unless one of within is open inside it: its end tag is left out."""
        nonlocal bad, own
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                _, bad, own = stack[i]
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            held.append(page[at:])
            break
        held.append(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            held.append("<")
            at = lt + 1
            continue
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if not m[1]:
            if name in RAW:
                if m[3].endswith("/"):
                    continue
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if name == "head" and not close:
                    continue
                at = close.end() if close else end
                continue
            if name == "br":
                held.append(" ")
            if name in BLOCKS:
                flush()
                if name in ENDS_P:
                    end_open({"p"}, SCOPES)
                if name in ENDS_ITEM:
                    end_open(*ENDS_ITEM[name])
            if name in VOID or m[3].endswith("/"):
                continue
            if name in SCOPES or (mark := _marked(name, m[3])):
                mark = _marked(name, m[3]) if name in SCOPES else mark
                if mark and name not in BLOCKS:
                    flush()
                stack.append((name, bad, own))
                if own and name == "header":
                    mark = False  # an article's own heading
                bad = bad or mark
                own = own or name in ("article", "main")
        else:
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    flush()
                    _, bad, own = stack[i]
                    del stack[i:]
                    break
    flush()
    return out


def _row(a: list, b: list) -> np.ndarray:
    """Lengths of longest common subsequences of a and b[:j], for j from 0 to len(b): one whole number holds a row's bits."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for line in a:
        if m := where.get(line):
            u = v & m
            v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared_lines(a: list, b: list) -> set[int]:
    """Positions in a of the lines of a longest common subsequence of a and b.

    Hirschberg's division over bit-parallel rows: memory is in proportion to the lines, time to len(a) * len(b) / 64.
    """
    out: set[int] = set()
    inside = set(a) & set(b)
    todo = [([(i, x) for i, x in enumerate(a) if x in inside], [x for x in b if x in inside])]
    while todo:
        own, other = todo.pop()
        lo, end = 0, min(len(own), len(other))
        while lo < end and own[lo][1] == other[lo]:
            out.add(own[lo][0])
            lo += 1
        tail = 0
        while tail < end - lo and own[-1 - tail][1] == other[-1 - tail]:
            out.add(own[-1 - tail][0])
            tail += 1
        own, other = own[lo : len(own) - tail], other[lo : len(other) - tail]
        if not own or not other:
            continue
        if len(own) == 1:
            if own[0][1] in other:
                out.add(own[0][0])
            continue
        half = len(own) // 2
        lines = [x for _, x in own]
        cut = int(np.argmax(_row(lines[:half], other) + _row(lines[half:][::-1], other[::-1])[::-1]))
        todo += [(own[:half], other[:cut]), (own[half:], other[cut:])]
    return out


class _Page(NamedTuple):
    """What other pages see of a page: its lines as 64-bit hashes, and the characters of each that is no template."""

    keys: np.ndarray
    sizes: np.ndarray


def _told(page: _Page) -> bytes:
    return page.keys.tobytes() + page.sizes.tobytes()


def _hashed(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _shared(page: _Page, near: list[_Page | None]) -> np.ndarray:
    """Whether each line of a page is one that a page in near shares; near copies have no say."""
    keys, out = page.keys.tolist(), np.zeros(len(page.keys), bool)
    for other in near:
        if other is not None and not _same_run(page, other):
            out[list(shared_lines(keys, other.keys.tolist()))] = True
    return out


def _edge_context(edges: list) -> dict[int, tuple[_Page | None, _Page | None]]:
    """For each partition, the page before its first run and the page after its last, in the partitions around it.

    edges: rows of the first and last page of each partition (F, L) and, where the host goes on there, the first page of
    its second run (F2) and the last of the last run but one (L2).
    """
    parts: dict[int, dict] = {}
    for r in edges:
        parts.setdefault(r.part, {})[r.role] = (r.host, _Page(np.array(r.keys, np.int64), np.array(r.sizes, np.int64)), r.one)
    order = sorted(parts)

    def search(k: int, step: int, own: str, far: str, next_run: str) -> _Page | None:
        host, at, _ = parts[order[k]][own]
        for j in range(k + step, len(order) if step > 0 else -1, step):
            there = parts[order[j]]
            other, page, one = there[far]
            if other != host:
                return None
            if not _same_run(page, at):
                return page
            if next_run in there:
                return there[next_run][1]
            if not one:
                return None
            at = there[own][1]  # all of that partition is the same run
        return None

    return {part: (search(k, -1, "F", "L", "L2"), search(k, 1, "L", "F", "F2")) for k, part in enumerate(order)}


def _same_run(a: _Page, b: _Page) -> bool:
    """Whether two pages are copies or near copies: in common lines that are no template they share NEARLY_ALL of the longer's characters."""
    most = max(int(a.sizes.sum()), int(b.sizes.sum()))
    if not most:
        return np.array_equal(a.keys, b.keys)
    if np.array_equal(a.keys, b.keys):
        return True
    count = Counter(k for k, n in zip(a.keys.tolist(), a.sizes.tolist()) if n)
    common = 0
    for k, n in zip(b.keys.tolist(), b.sizes.tolist()):
        if n and count[k] > 0:
            count[k] -= 1
            common += n
    return common >= NEARLY_ALL * most


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id_col, url_col, text (blocks joined by line ends, empty if none), n_chars.

    Null pages are empty. A page whose host no other page has (or none but copies and near copies of it), or with a null
    url, has nothing to be compared with and keeps all lines that markup does not mark. Pages with equal urls are compared in order of id; repeated rows are
    pages of their own. Very long pages are taken whole; an empty table gives an empty result. The result does not depend on partitions. df is read twice. Other columns play no part.
    """
    id_type, url_type = (df.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def parse(batches: Iterator[pd.DataFrame], texts: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                digest, sure, lines, at, keys, sizes = [], [], [], [], [], []
                for html in part["html"]:
                    found = blocks(html)
                    page = _Page(np.array([_hashed(t) for _, t in found], np.int64), np.array([0 if m == TEMPLATE else len(t) for m, t in found], np.int64))
                    digest.append(hashlib.blake2b(_told(page), digest_size=16).digest())
                    if not texts:
                        keys.append(page.keys)
                        sizes.append(page.sizes)
                        continue
                    sure.append(any(m == ARTICLE for m, _ in found))
                    own = [(i, t) for i, (m, t) in enumerate(found) if m == (ARTICLE if sure[-1] else NEUTRAL)]
                    lines.append([t for _, t in own])
                    at.append([i for i, _ in own])
                more = {"sure": sure, "lines": lines, "at": at} if texts else {"keys": keys, "sizes": sizes}
                yield pd.DataFrame({"id": part["id"], "url": part["url"], "digest": digest, **more})

    read = bounded_batches(df).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    common = f"id {id_type}, url {url_type}, digest binary"
    hashes = read.mapInPandas(lambda batches: parse(batches, False), f"{common}, keys array<bigint>, sizes array<bigint>")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]*([^?#]*)", 1)
    pages = materialize(hashes.withColumns({"host": F.coalesce(host, F.lit("")), "path": path}), "pages")
    ordered = pages.where("host <> ''").repartitionByRange("host", "path", "url", "id").sortWithinPartitions("host", "path", "url", "id")

    out_type = "role string, part int, one boolean, host string, id {}, url {}, digest binary, shared array<boolean>, keys array<bigint>, sizes array<bigint>, before struct<keys: array<bigint>, sizes: array<bigint>>, after struct<keys: array<bigint>, sizes: array<bigint>>, no_before boolean, no_after boolean".format(id_type, url_type)
    names = [c.split()[0] for c in out_type.split(", ") if not c.startswith("sizes: ")]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of role done, open (a neighbour is in another partition) and, for the edges, F, F2, L, L2."""
        part = TaskContext.get().partitionId()
        first = host = last = back = None  # last page; back: last page of the run before it
        known = False  # whether the run before is known: not so for the first run
        run: dict[bytes, tuple] = {}  # pages of the run that wait for the next one, equal ones together
        runs = 0

        def told(role: str, **more) -> dict:
            return dict.fromkeys(names) | {"role": role, "part": part} | more

        def edge(role: str, at: str, page: _Page, one: bool = False) -> dict:
            return told(role, host=at, keys=page.keys, sizes=page.sizes, one=one)

        def flush(after: _Page | None, sure: bool) -> Iterator[dict]:
            for page, digest, who in run.values():
                whole = known and sure
                shared = _shared(page, [back, after]) if whole else None
                for id_, url in who:
                    if whole:
                        yield told("done", id=id_, url=url, digest=digest, shared=shared)
                    else:
                        near = {"before": back and back._asdict(), "after": after and after._asdict(), "no_before": not known, "no_after": not sure}
                        yield told("open", id=id_, url=url, digest=digest, keys=page.keys, sizes=page.sizes, **near)
            run.clear()

        def rows() -> Iterator[dict]:
            nonlocal first, host, last, back, known, runs
            second = None
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    page = _Page(np.asarray(r.keys, np.int64), np.asarray(r.sizes, np.int64))
                    if last is None:
                        first, runs = (r.host, page), 1
                    elif r.host != host:
                        yield from flush(None, True)
                        back, known, runs = None, True, runs + 1
                    elif not _same_run(last, page):
                        yield from flush(page, True)
                        if runs == 1:
                            second = page
                        back, known, runs = last, True, runs + 1
                    host, last = r.host, page
                    run.setdefault(_told(page), (page, r.digest, []))[2].append((r.id, r.url))
            if last is not None:
                yield from flush(None, False)
                yield edge("F", *first, runs == 1)
                yield edge("L", host, last, runs == 1)
                if second is not None:
                    yield edge("F2", first[0], second)
                if back is not None:
                    yield edge("L2", host, back)

        made = rows()
        while some := list(islice(made, 200)):
            yield pd.DataFrame(some, columns=names, dtype=object)

    compared = materialize(ordered.drop("path").mapInPandas(compare, out_type), "compared")
    context = _edge_context(compared.where("role IN ('F', 'F2', 'L', 'L2')").select("role", "part", "one", "host", "keys", "sizes").collect())

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def page(struct) -> _Page | None:
            return None if struct is None else _Page(*(np.asarray(struct[k], np.int64) for k in ("keys", "sizes")))

        for pdf in batches:
            shared = []
            for r in pdf.itertuples(index=False):
                before, after = context[r.part]
                near = [before if r.no_before else page(r.before), after if r.no_after else page(r.after)]
                shared.append(_shared(_Page(np.asarray(r.keys, np.int64), np.asarray(r.sizes, np.int64)), near))
            yield pd.DataFrame({**{k: pdf[k] for k in ("id", "url", "digest")}, "shared": pd.Series(shared, dtype=object)})

    # Rows of one id, url and digest have the same lines and neighbours, so one of them tells for all. Pages without a host have no neighbours.
    open_ = compared.where("role = 'open'").mapInPandas(finish, f"{common}, shared array<boolean>")
    found = compared.where("role = 'done'").select("id", "url", "digest", "shared").union(open_).dropDuplicates(["id", "url", "digest"])
    whole = read.mapInPandas(lambda batches: parse(batches, True), f"{common}, sure boolean, lines array<string>, at array<int>")
    found = found.select(*[F.col(c).alias(f"_{c}") for c in ("id", "url", "digest")], "shared")
    both = whole.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("url") == F.col("_url")) & (F.col("digest") == F.col("_digest")), "left")
    keep = F.filter("lines", lambda _, i: F.col("sure") | F.col("shared").isNull() | ~F.get("shared", F.get("at", i)))
    out = both.withColumn("text", F.array_join(keep, "\n"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
