"""Main text of web pages: blocks by markup, and boilerplate by a suffix array over the pages of a host."""

from __future__ import annotations

import hashlib
import re
from html import unescape

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.common import Words, bites, grams, mix, stored
from pairmill.llm.urls import url_parts

#: Tokens of a repeat: substrings of at least so many that stand on several pages of a host are boilerplate.
REPEAT = 8
#: Pages on which text outside of an article must repeat; share of a host's pages (five at least) within an article.
PAGES, SHARE, SHARE_PAGES = 2, 0.5, 5
#: Text of one suffix array, and of a host's part: hosts with more are split by a hash of their pages.
CHUNK_CHARS, PART_CHARS = 1 << 20, 1 << 22

SKIP, PLAIN, MAIN = 0, 1, 2
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas", "audio", "video", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img input".split())
_CLOSES_SELF = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
_BOILER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
_BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe popup modal overlay "
    "widget login signup search pagination pager toolbar masthead topbar complementary contentinfo".split()
)
_TEASER_NAMES = {"ad", "ads", "advert", "sponsored", "promo", "related", "recommended", "teaser"}
_COMMENT_NAMES = {"comment", "comments", "reply", "replies", "respond", "disqus"}
#: Words that go with the names above in a name of several words, where an article's own elements are named.
_FILLERS = set(
    "area bar block body box button buttons container content form inline inner item items link links list module reader readers row section slot thread top unit user users "
    "visitor wrap wrapper icon icons bottom left right".split()
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _boiler_within(attrs: str) -> tuple[bool, bool]:
    """(boilerplate, reader comments) of an element within an article, by the names in its attributes.

    An article names its parts as it likes ("related work", "notice-of-intent", "alert-1"), so only an attribute all of whose names
    are made of boilerplate words and fillers counts ("ad-slot", "share buttons"); of comments one such name, numbered or
    not, is enough ("comment even", "comment-12").
    """
    boiler = remarks = False
    for a in _NAMED.findall(attrs):
        parts = [re.split(r"[_-]+", w) for w in "".join(a).lower().split()]
        words = [x for p in parts for x in p]
        boiler |= any(x in _BOILER_NAMES for x in words) and all(x in _BOILER_NAMES or x in _FILLERS for x in words)
        remarks |= any(any(x in _COMMENT_NAMES for x in p) and all(x in _COMMENT_NAMES or x in _FILLERS or x.isdigit() for x in p) for p in parts)
    return boiler, remarks


class _Open:
    """Open elements (tag, zone, remarks) with counts, so that no tag looks through them all."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool] | None] = []
        self.tags: dict[str, int] = {}
        self.skips: list[int] = []  # places of skipped zones
        self.mains = self.remarks = 0

    @property
    def zone(self) -> int:
        return self.stack[-1][1] if self.stack else PLAIN

    @property
    def tag(self) -> str | None:
        return self.stack[-1][0] if self.stack else None

    def push(self, tag: str, zone: int, remarks: bool) -> None:
        if zone == SKIP:
            self.skips.append(len(self.stack))
        self.stack.append((tag, zone, remarks))
        self._count(tag, zone, remarks, 1)

    def _count(self, tag: str, zone: int, remarks: bool, n: int) -> None:
        self.tags[tag] = self.tags.get(tag, 0) + n
        self.mains += n * (zone == MAIN)
        self.remarks += n * remarks

    def pop(self) -> str:
        top = self.stack.pop()
        self._count(*top, -1)
        if top[1] == SKIP:
            self.skips.pop()
        self._tidy()
        return top[0]

    def end_skips(self) -> None:
        """Skipped zones that are still open end; their places stay empty until what stands above them ends."""
        for k in self.skips:
            self._count(*self.stack[k], -1)
            self.stack[k] = None
        self.skips.clear()
        self._tidy()

    def _tidy(self) -> None:
        while self.stack and self.stack[-1] is None:
            self.stack.pop()


def blocks_of(html: str) -> list[tuple[str, int, float]]:
    """(text, zone, share of its characters in links) of the blocks of a page, in order; blocks without text are left out.

    Zones: text within menus, footers, side bars, notices, adverts, forms, comments and page headers is SKIP; within an
    article or main element MAIN; else PLAIN. Outside of articles any word of an element's names tells, within them see
    ``_boiler_within``. Time goes with the page's length, however deep its elements stand. Unclosed elements end where an enclosing one does; an article ends skipped zones
    that were left open before it. Contents of scripts, styles and the like, comments and tags are dropped; a tag or comment cut
    off at the end of the page is too. Character references are decoded, white space is one space, ends are trimmed.
    """
    out: list[tuple[str, int, float]] = []
    held: list[str] = []
    opened = _Open()
    linked = in_link = 0
    zone, n, at = PLAIN, len(html), 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append((text, zone, min(1.0, linked / len(text))))
        held.clear()
        linked = 0

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            held.append(html[a:b])
            linked += (b - a) * bool(in_link)

    while at < n:
        cut = html.find("<", at)
        if cut < 0:
            text(at, n)
            break
        text(at, cut)
        if html.startswith("<!--", cut):
            end = html.find("-->", cut + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), cut):
            end = html.find(">", cut)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, cut) or _LOOSE.match(html, cut)
        if not m:
            if re.match(r"</?[a-zA-Z]", html[cut : cut + 3]):
                break  # a tag that the end of the page cuts off
            text(cut, cut + 1)
            at = cut + 1
            continue
        at, close, tag, attrs = m.end(), m[1] == "/", m[2].lower(), m[3]
        if tag in _RAW and not close:
            if tag == "title" or not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = n if end is None else end.end()
            continue
        if tag == "a":
            in_link = 0 if close else 1
        if tag in _INLINE:
            if tag == "br":
                held.append(" ")
            if not attrs or tag in _VOID:
                if close and opened.tag == tag:
                    flush()
                    opened.pop()
                    zone = opened.zone
                continue
        else:
            flush()
        if tag in _VOID:
            continue
        if close:
            if opened.tags.get(tag):
                flush()
                while opened.pop() != tag:
                    pass
                zone = opened.zone
            continue
        if tag in _CLOSES_SELF and opened.tag == tag:
            opened.pop()
            zone = opened.zone
        names = {w for a in _NAMED.findall(attrs) for w in re.split(r"[\s_-]+", "".join(a).lower())} if attrs else set()
        inside = opened.mains > 0
        remarks, boiler = bool(names & _COMMENT_NAMES), bool(names & _BOILER_NAMES)
        if inside and names:
            boiler, remarks = _boiler_within(attrs)
        remarks = remarks or opened.remarks > 0
        if tag in ("article", "main"):
            boiler = bool(names & _TEASER_NAMES)
        else:
            boiler = tag in _BOILER_TAGS or tag not in ("html", "body") and boiler
        if boiler or remarks or ((tag == "header" or "header" in names) and not inside and tag != "body"):
            new = SKIP
        elif tag in ("article", "main") or "main" in names:
            new = MAIN if inside and zone == MAIN or not inside else zone
            if not inside:
                opened.end_skips()
        else:
            new = zone
        if tag in _INLINE or tag in _CLOSES_SELF:
            if new == zone:
                continue
            flush()
        opened.push(tag, new, remarks)
        zone = new
    flush()
    return out


def repeats(tokens: np.ndarray, page: np.ndarray, length: int = REPEAT) -> np.ndarray:
    """For each token the number of distinct pages that share a substring of at least ``length`` tokens that covers it; 1 where none is shared."""
    shared = sharing(tokens, page, length)
    out = np.ones(len(tokens), dtype=np.int64)
    for k in range(min(length, len(tokens))):
        np.maximum(out[k:], shared[: len(tokens) - k], out=out[k:])
    return out


def sharing(tokens: np.ndarray, page: np.ndarray, length: int = REPEAT) -> np.ndarray:
    """For each token the number of distinct pages with the run of ``length`` tokens that begins there; 1 where the page ends before.

    The suffixes of the concatenated pages are sorted by prefix doubling until ``length`` tokens are compared; suffixes of equal rank
    stand side by side in the suffix array with a common prefix of at least that, and every longer repeat is a chain of such.
    """
    n = len(tokens)
    shared = np.ones(n, dtype=np.int64)
    if n < length:
        return shared
    _, rank = np.unique(tokens, return_inverse=True)
    done = 1
    while done < length:
        step = min(done, length - done)
        # A suffix that would run into the next page gets a rank of its own.
        inside = np.zeros(n, dtype=bool)
        inside[: n - step] = page[step:] == page[: n - step]
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[inside] = rank[np.flatnonzero(inside) + step]
        alone = ~inside
        key = rank.astype(np.int64) * (n + 1) + nxt + 1
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64)
        rank[alone] = n + np.flatnonzero(alone)
        _, rank = np.unique(rank, return_inverse=True)
        done += step
    array = np.lexsort((page, rank))
    r, p = rank[array], page[array]
    new_rank = np.concatenate([[True], r[1:] != r[:-1]])
    new_page = new_rank | np.concatenate([[True], p[1:] != p[:-1]])
    pages = np.add.reduceat(new_page.astype(np.int64), np.flatnonzero(new_rank))[np.cumsum(new_rank) - 1]
    shared[array] = pages
    return shared


def _limit(pages: int) -> int:
    """Pages of a host of so many from which on a run is boilerplate within an article."""
    return max(SHARE_PAGES, int(SHARE * pages) + 1)


def _content(texts: list[str]) -> int:
    """Hash of a page's token stream; pages of the same stream count as one."""
    return int.from_bytes(hashlib.blake2b(" ".join(texts).encode().lower(), digest_size=8).digest(), "little", signed=True)


def _tokens(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the pages, whose blocks are given, and the row pointer."""
    # White space within a block is one plain space by now, so that words and tokens agree.
    w = Words(pa.array([" ".join(p) for p in pages], pa.string()))
    return w.hash, w.ptr


def _covered(begins: np.ndarray) -> np.ndarray:
    """Tokens of a page that lie in the runs that begin where ``begins`` is set."""
    out = np.zeros(len(begins), dtype=bool)
    for k in range(min(REPEAT, len(begins))):
        out[k:] |= begins[: len(begins) - k]
    return out


def _kept(blocks: list[tuple[str, int, float]], wide: np.ndarray, twice: np.ndarray) -> str:
    """Text of a page; ``wide`` tokens stand on the host's share of pages, ``twice`` tokens on two pages at least."""
    has_main = any(b[1] == MAIN for b in blocks)
    at = np.concatenate([[0], np.cumsum([len(b[0].split(" ")) for b in blocks])]).astype(int)
    used = [k for k, b in enumerate(blocks) if b[1] == MAIN or not has_main and b[2] <= 0.6]
    drop = wide.copy()
    if not has_main and used:
        rest = np.zeros(len(wide), dtype=bool)
        for k in used:
            rest[at[k] : at[k + 1]] = ~wide[at[k] : at[k + 1]]
        if 2 * (rest & twice).sum() <= rest.sum():
            drop |= twice
    out = []
    for k in used:
        gone = drop[at[k] : at[k + 1]]
        if not gone.any():
            out.append(blocks[k][0])
        elif not gone.all():
            out.append(" ".join(x for x, c in zip(blocks[k][0].split(" "), gone, strict=True) if not c))
    return "\n".join(out)


def main_texts(pages: list[list[tuple[str, int, float]]]) -> list[str]:
    """Main texts of all pages of one host, whose blocks are given.

    The token streams of the pages form one suffix array; pages of the same stream are one. Runs that more than half of the
    pages (of five at least) share are removed. Outside of articles, so are runs that two pages share, where they make up no more than half
    of what is left of the page (else they are a copy of its text), and blocks that are mostly links. What is left of the
    article's blocks is the text, or of the other blocks where there is no article.
    """
    pages = [[b for b in blocks if b[1] != SKIP] for blocks in pages]
    content = [_content([b[0] for b in blocks]) for blocks in pages]
    first = {c: k for k, c in reversed(list(enumerate(content)))}
    slot = {c: k for k, c in enumerate(first)}
    tokens, ptr = _tokens([[b[0] for b in pages[k]] for k in first.values()])
    many = repeats(tokens, np.repeat(np.arange(len(slot)), np.diff(ptr)))
    limit = _limit(len(slot))
    out = []
    for blocks, c in zip(pages, content, strict=True):
        m = many[ptr[slot[c]] : ptr[slot[c] + 1]]
        out.append(_kept(blocks, m >= limit, m >= PAGES))
    return out


def _packed(blocks: list[tuple[str, int, float]], pack) -> bytes:
    """Blocks of a page, compressed: a letter for each (m in an article, l mostly links, p others), then their texts, line by line."""
    return pack("\n".join(["".join("m" if z == MAIN else "l" if x > 0.6 else "p" for _, z, x in blocks), *[t for t, _, _ in blocks]]).encode())


def _unpacked(blob: bytes) -> list[tuple[str, int, float]]:
    kinds, *texts = zstandard.decompress(blob).decode().split("\n")
    return [(t, MAIN if k == "m" else PLAIN, float(k == "l")) for k, t in zip(kinds, texts, strict=True)]


def _parsed(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in bites(batches, 5):
        rows = [[x for x in blocks_of(h or "") if x[1] != SKIP] for h in b.column(5).to_pylist()]
        content = pa.array([_content([x[0] for x in r]) for r in rows], pa.int64())
        blocks = pa.array([_packed(r, pack) for r in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(5)], content, blocks], ["page_id", "url", "host", "part", "whole", "content", "blocks"])


def _chunks(batches):
    """Pages in order; those of a host that is one chunk have their text, the others their blocks and a number of their own."""
    held, size, group, cut, last, n = [], 0, None, False, None, TaskContext.get().partitionId() << 40

    def done(alone):
        texts = main_texts([_unpacked(h[6]) for h in held]) if alone else [None] * len(held)
        cols = [pa.array([h[k] for h in held], kinds[k]) for k in range(6)]
        blocks = pa.array([None if alone else h[6] for h in held], pa.binary())
        return pa.RecordBatch.from_arrays([*cols, blocks, pa.array(texts, pa.string())], ["page_id", "url", "host", "row", "content", "first", "blocks", "text"])

    for b in batches:
        kinds = [b.column(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        for page, url, host, part, whole, content, blocks in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and ((host, part) != group or size >= CHUNK_CHARS):
                more = (host, part) == group
                yield done(not more and not cut and all_here)
                held, size, cut = [], 0, more
            if (host, part) != group:
                last = None
            group, all_here = (host, part), whole
            held.append((page, url, host, n, content, content != last, blocks))
            last, n = content, n + 1
            size += zstandard.frame_content_size(blocks)
    if held:
        yield done(not cut and all_here)


def _runs(asking: bool):
    """Runs of chunks of a host's pages, by suffix array: those to ask the host's other chunks for, or all with their pages.

    To ask for: runs of pages without an article, and runs on more than the share of a chunk's pages. A run on more than the share of
    all pages of the host is on more than the share in one of its chunks, so none is missed.
    """

    def chunk(host, held):
        salt = np.frombuffer(hashlib.blake2b(host.encode(), digest_size=8).digest(), np.uint64)[0]
        tokens, ptr = _tokens([h[2] for h in held])
        page = np.repeat(np.arange(len(held)), np.diff(ptr))
        g, gptr = grams(tokens, ptr, REPEAT, short=False)
        key, of = mix(g ^ salt).view(np.int64), np.repeat(np.arange(len(held)), np.diff(gptr))
        begin = ptr[of] + (np.arange(len(g)) - gptr[of])
        counts = np.array([h[1] for h in held], dtype=bool)
        # Pages that do not count (copies of one that does) are left out of the suffix array.
        place = np.cumsum(counts[page]) - 1
        n = np.where(counts[of], sharing(tokens[counts[page]], page[counts[page]])[place[begin]] if counts.any() else 0, 0)
        if asking:
            plain = np.array([not h[3] for h in held], dtype=bool)[of]
            ask = np.flatnonzero(counts[of] & (plain | (n > SHARE * counts.sum())))
            order = ask[np.lexsort((~plain[ask], key[ask]))]
            order = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])] if len(order) else order
            return pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array([host] * len(order), pa.string()), pa.array(plain[order])], ["run", "host", "plain"])
        order = np.lexsort((of, key))
        order = order[np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])])] if len(order) else order
        head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(order) else order
        rows = np.array([h[0] for h in held], dtype=np.int64)[of[order]]
        pages = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)).astype(np.int32)), pa.array(rows))
        most = np.maximum.reduceat(n[order], head) if len(order) else n
        return pa.RecordBatch.from_arrays([pa.array(key[order][head]), pa.array(most.astype(np.int64)), pages], ["run", "n", "rows"])

    def runs(batches):
        held, size, group = [], 0, None
        for b in batches:
            for host, row, counts, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (host != group or size >= CHUNK_CHARS):
                    yield chunk(group, held)
                    held, size = [], 0
                group = host
                blocks = _unpacked(blob)
                texts = [x[0] for x in blocks]
                held.append((row, counts, texts, any(x[1] == MAIN for x in blocks)))
                size += sum(map(len, texts))
        if held:
            yield chunk(group, held)

    return runs


def _resolved(batches):
    for b in batches:
        texts = []
        for host, wide, twice, blob in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True):
            blocks = _unpacked(blob)
            salt = np.frombuffer(hashlib.blake2b(host.encode(), digest_size=8).digest(), np.uint64)[0]
            begins = [np.zeros(sum(x[0].count(" ") + 1 for x in blocks), dtype=bool) for _ in range(2)]
            if wide or twice:
                tokens, ptr = _tokens([[x[0] for x in blocks]])
                key = mix(grams(tokens, ptr, REPEAT, short=False)[0] ^ salt).view(np.int64)
                for x, found in zip(begins, (wide or [], twice or []), strict=True):
                    x[: len(key)] = np.isin(key, np.array(found, dtype=np.int64))
            wide, twice = (_covered(x) for x in begins)
            texts.append(_kept(blocks, wide, wide | twice))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _joint_runs(open_: DataFrame) -> DataFrame | None:
    """(row, wide, twice): the boilerplate runs of each page, counted over all chunks of its host; None where there are none."""
    same = open_.where("first").groupBy("host", "content").agg(F.min("row").alias("own"), F.collect_list("row").alias("rows"))
    same = stored(same, "contents")
    pages = open_.select("host", "row", F.col("first").alias("counts"), "blocks")
    # A page stands once per part of its host at most among the first ones.
    again = stored(same.where(F.size("rows") > 1).select(F.explode("rows").alias("row"), "own").where("row <> own").select("row", F.lit(True).alias("again")), "copies")
    if not again.isEmpty():
        pages = pages.join(again, "row", "left").select("host", "row", (F.col("counts") & F.col("again").isNull()).alias("counts"), "blocks").sortWithinPartitions("host", "row")
    asked = pages.mapInArrow(_runs(True), "run long, host string, plain boolean").groupBy("run").agg(F.min("host").alias("host"), F.max("plain").alias("plain"))
    asked = stored(asked, "asked-runs")
    if asked.isEmpty():
        return None
    counted = stored(pages.mapInArrow(_runs(False), "run long, n long, rows array<long>").join(asked.select("run"), "run", "left_semi"), "counted-runs")
    n_pages = same.groupBy("host").agg(F.count("*").alias("pages"))
    limit = F.greatest(F.lit(SHARE_PAGES), F.floor(F.col("pages") * SHARE) + 1)
    totals = counted.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES).join(asked, "run").join(n_pages, "host")
    kept = totals.select("run", (F.col("n") >= limit).alias("wide"), "plain").where("wide OR plain").drop("plain")
    of_rows = counted.select("run", "rows").join(stored(kept, "boilerplate"), "run").select("run", "wide", F.explode("rows").alias("row"))
    lists = of_rows.groupBy("row").agg(F.collect_list(F.when(F.col("wide"), F.col("run"))).alias("wide"), F.collect_list(F.when(~F.col("wide"), F.col("run"))).alias("twice"))
    return stored(lists, "page-runs")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Pages are parsed where they are read, and their blocks, compressed page by page, are dealt out by host; a host with over four million
    characters goes to several tasks by a hash of its pages. A host of less than about a million characters of text is one suffix array.
    A larger one has an array per million characters; the pages of its runs are summed over all of them, and the runs come
    back to its pages, so that results do not depend on the chunks. Null html is empty, urls
    without a host share the empty one; pages without text give the empty string; repeated rows, and pages with the same words, count as one page.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), url_parts(F.col(url))[0].alias("host"), F.col(html).alias("html"))
    size = rows.groupBy("host").agg(F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("n")).where(F.col("n") > PART_CHARS)
    large = stored(size.select(F.col("host").alias("large"), F.ceil(F.col("n") / PART_CHARS).alias("parts")), "large-hosts")
    rows = rows.join(large, F.col("host") == F.col("large"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")), F.lit(0)).cast("long")
    kind = pages.schema[key].dataType.simpleString()
    parsed = rows.select("page_id", "url", "host", part.alias("part"), F.col("parts").isNull().alias("whole"), "html").mapInArrow(
        _parsed, f"page_id {kind}, url string, host string, part long, whole boolean, content long, blocks binary"
    )
    dealt = parsed.repartition("host", "part").sortWithinPartitions("host", "part", "content", "page_id", "url")
    done = stored(dealt.mapInArrow(_chunks, f"page_id {kind}, url string, host string, row long, content long, first boolean, blocks binary, text string"), "page-blocks")
    open_ = done.where("text IS NULL").drop("text")
    lists = _joint_runs(open_)
    if lists is None:
        none = F.lit(None).cast("array<long>")
        open_ = open_.withColumns({"wide": none, "twice": none})
    else:
        open_ = open_.join(lists, "row", "left")
    open_ = open_.select("page_id", "url", "host", "wide", "twice", "blocks")
    rest = open_.mapInArrow(_resolved, f"page_id {kind}, url string, text string")
    return done.where("text IS NOT NULL").select("page_id", "url", "text").unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
