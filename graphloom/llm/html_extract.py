"""Main text of web pages, with a host suffix array against boilerplate.

A page is read to blocks.  Suffixes of the token streams of a host's pages are
grouped by their first ``DEPTH`` tokens, and substrings of that length or more
that occur on ``MIN_PAGES`` distinct pages of the host mark what they cover.
Covered tokens are boilerplate, unique runs are kept.

Markup is checked after that, and outranks repeats where it speaks: blocks in
menus, page headers, footers, sidebars, notices, adverts, forms and reader
comments go even if they are unique, and blocks of an ``article`` or ``main``
stay even if other pages hold them, since a copied article, or a passage that
many articles share, is content; so repeats are looked for in all other blocks.
A page without a marked article keeps the
unique runs of what isn't template, and so does one whose marked article is less
than these.  A form is entered where it wraps an article or the whole page.

Repeats are those of the whole table, however large a host is and however its
pages are dealt.  A first pass marks the hashes of (host, ``DEPTH`` tokens),
that is of the suffixes' beginnings, in a filter of what is seen twice; a second
gives, for what the filter holds, the least and the largest page of each part to
a shuffle by the hash, where what two pages have is found; a third covers the
pages with it.  The repeated hashes are counted first: up to
``MOST_BROADCAST`` are broadcast, and more go to their pages by salted shuffles.
No step gathers a host, and a hot host's windows are a row for each task.  The
filter never loses a repeat; a fuller one, of ``MOST_BITS`` at most, only lets
more through.

Defined cases: null or empty HTML gives an empty text; broken markup is read
leniently to the end, in time linear in its length (after a quote that is never
closed, quotes mean nothing on that page); a very long page is a part of its own
and is read whole; an empty table gives an empty one; repeated rows are separate
pages with equal texts (rows of one host with the same HTML count as one page
for repeats, so copies of a whole page don't take its text away); a null URL is
a host of its own; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytetext as bt
from graphloom.llm.common import materialize, table

DEPTH = 8
MIN_PAGES = 2
#: Pages are read in parts of about so many characters.
PART_CHARS = 2 << 20
SEGMENT_BITS = 1 << 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
SALTS = 8
#: So many repeated windows are broadcast at most (64 MB); more are shuffled to their pages.
MOST_BROADCAST = 1 << 23
#: A task packs so many hashes at once, which bounds its memory.
FLUSH_HASHES = 1 << 21

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:_-]*")
#: A tag's attributes, up to its end; a match takes linear time, since nothing is given back.
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTR = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = frozenset("script style textarea title noscript template iframe svg noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Tags that end an open paragraph or item of their kind.
_ENDS = {"li": frozenset(["li"]), **dict.fromkeys(("dt", "dd"), frozenset(["dt", "dd"])), **dict.fromkeys(("td", "th"), frozenset(["td", "th"])), "tr": frozenset(["td", "th"]), "option": frozenset(["option"])}
_TEMPLATE = frozenset("head nav footer aside menu dialog button select object canvas audio video datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tooltip status".split())
#: Words of class names and ids that mark template anywhere.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager masthead topbar bottombar copyright comment comments commentlist disqus".split()
)
#: Words that do so on containers only: a paragraph or heading of such a name is text.
_SOFT = frozenset("aside widget widgets toc header footer promo promoted promotion related recommended recommendations share sharing social reply replies respond search skip toolbar".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table tbody tr td th dl dt dd li figure figcaption b i em strong a code q cite mark".split())
_ARTICLE_NAMES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
#: Words that turn the next one into its opposite, or into a layout of what holds it.
_NOT = frozenset("no non not without has with hide".split())

#: How sure it is that a block is template: a form can wrap a whole page.
TEXT, FORM, TEMPLATE = 0, 1, 2


def _named(value: str, names: frozenset[str]) -> bool:
    for word in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", word) if x]
        if not names.isdisjoint(parts) and _NOT.isdisjoint(parts):
            return True
    return False


def _is_template(tag: str, attrs: str, article: bool) -> int:
    if tag in _TEMPLATE or tag == "header" and not article:
        return TEMPLATE
    sure = FORM if tag in ("form", "fieldset") else TEXT
    if not attrs or "=" not in attrs and "hidden" not in attrs or tag in ("html", "body", "main"):
        return sure
    names = _ARTICLE_NAMES if tag == "article" else _NAMES if tag in _TEXT_TAGS or tag == "header" else _NAMES | _SOFT
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if _named(value, names) and sure != FORM:
                return TEMPLATE
        elif name == "hidden" or name == "role" and value in _ROLES or name == "aria-hidden" and value == "true":
            return TEMPLATE
        elif name == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value):
            return TEMPLATE
    return sure


def _tags(page: str):
    """(text before, tag in lower case, closing, attributes, end) of each tag, in time linear in the page's length; the last one's tag is empty."""
    at, last, loose = 0, page.rfind(">"), False
    before: list[str] = []
    begin = 0
    while True:
        at = page.find("<", at)
        # without a > no tag ends: what is left is text
        if at < 0 or at > last:
            before.append(html.unescape(page[begin:]))
            yield "".join(before), "", False, "", len(page)
            return
        after = page[at + 1 : at + 2]
        closing = after == "/"
        name = _NAME.match(page, at + 2 if closing else at + 1)
        if not name and after not in ("!", "?"):
            at += 1
            continue
        before.append(html.unescape(page[begin:at]))
        if not name:
            opening, end = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(x[0], at)), ("", ">"))
            stop = page.find(end, at + len(opening) - (opening == "<!--") * 2) if opening else page.find(">", at)
            stop = len(page) if stop < 0 else stop
            if opening == "<![CDATA[":
                before.append(page[at + 9 : stop])
            at = begin = min(len(page), stop + len(end))
            continue
        stop = page.find(">", name.end()) if loose else _INSIDE.match(page, name.end()).end()
        if stop >= len(page) or page[stop] != ">":
            # a quote is never closed: from here on quotes mean nothing
            loose, stop = True, page.find(">", name.end())
        jump = yield "".join(before), name[0].lower(), closing, page[name.end() : stop], stop + 1
        before = []
        at = begin = stop + 1 if jump is None else jump


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, how surely it is template, is in an article or main) of each non-empty block, in page order."""
    out: list[tuple[str, int, bool]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, template, article
    open_: dict[str, int] = {}
    template, article = TEXT, False

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append((text, template, article))

    def pop() -> str:
        nonlocal template, article
        tag = stack.pop()[0]
        open_[tag] -= 1
        template, article = stack[-1][1:] if stack else (TEXT, False)
        return tag

    walk = _tags(page)
    before, tag, closing, attrs, at = next(walk)
    while tag or before:
        if before:
            pieces.append(before)
        if not tag:
            break
        jump = None
        if closing:
            if tag in _BLOCK:
                flush()
            elif tag == "br":
                pieces.append(" ")
            if open_.get(tag):
                while pop() != tag:
                    pass
        elif tag in _RAW:
            # a slash closes foreign elements only
            if not (tag == "svg" and attrs.endswith("/")):
                end = _RAW_END[tag].search(page, at)
                jump = end.end() if end else len(page)
        else:
            if tag in _BLOCK:
                flush()
                if stack and (stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(tag, ())):
                    pop()
                if tag in ("body", "article", "main") and open_.get("head"):
                    while pop() != "head":
                        pass
            elif tag in ("br", "img"):
                pieces.append(" ")
            if tag not in _VOID and not (attrs.endswith("/") and (tag == "math" or open_.get("math"))):
                own = _is_template(tag, attrs, article)
                if own and not template and tag not in _BLOCK:
                    flush()
                if template == FORM and tag in ("article", "main") and not own:
                    template = TEXT
                template = max(template, own)
                article = article or tag in ("article", "main") or 'role="main"' in attrs
                stack.append((tag, template, article))
                open_[tag] = open_.get(tag, 0) + 1
        before, tag, closing, attrs, at = walk.send(jump)
    flush()
    return out


def repeated_tokens(streams: list[np.ndarray], pages: np.ndarray, depth: int = DEPTH, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For each stream the tokens that substrings of ``depth`` or more tokens on ``min_pages`` distinct pages cover.

    ``streams`` are concatenated with separators that differ from each other
    and from all tokens; suffixes are sorted by prefix doubling to the depth.
    """
    lens = np.array([len(s) for s in streams])
    if not lens.sum():
        return [np.zeros(0, dtype=bool) for _ in streams]
    starts = np.concatenate(([0], np.cumsum(lens + 1)))
    rank = np.zeros(starts[-1], dtype=np.int64)
    inside = np.ones(starts[-1], dtype=bool)
    inside[starts[1:] - 1] = False
    _, ids = np.unique(np.concatenate(streams), return_inverse=True)
    rank[inside] = ids
    rank[~inside] = int(ids.max()) + 1 + np.arange(len(streams))
    done = 1
    while done < depth:
        step = min(done, depth - done)
        after = np.full(len(rank), -1, dtype=np.int64)
        after[:-step] = rank[step:]
        _, rank = np.unique(rank * (len(rank) + int(rank.max()) + 2) + after + 1, return_inverse=True)
        done += step
    # suffixes of equal rank share their first ``depth`` tokens; those with a separator have a rank of their own
    order = np.argsort(rank, kind="stable")
    first = np.ones(len(order), dtype=bool)
    first[1:] = rank[order][1:] != rank[order][:-1]
    group = np.cumsum(first) - 1
    often = np.bincount(group)[group] >= min_pages
    order, group = order[often], group[often]
    owner = np.repeat(pages, lens + 1)[order].astype(np.int64)
    distinct = np.unique(group * (int(pages.max()) + 1) + owner) // (int(pages.max()) + 1)
    hit = order[np.bincount(distinct, minlength=int(first.sum()))[group] >= min_pages]
    size = len(rank) + depth + 1
    cover = np.cumsum(np.bincount(hit, minlength=size) - np.bincount(hit + depth, minlength=size))[: len(rank)] > 0
    return [cover[a : a + n] for a, n in zip(starts[:-1].tolist(), lens.tolist(), strict=True)]


#: Block edges are tokens too, so that short blocks make long substrings.
_OPEN, _SHUT = 1, 2


def _streams(pages: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each page's token hashes with block edges, and where its blocks begin in it."""
    raw = [t.encode("utf-8", "surrogatepass") for own in pages for t in own]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    starts, ends, at = bt.runs(data != 0x20, offs)
    hashes = bt.span_hashes(data, starts, ends).view(np.int64)
    counts = np.diff(at)
    begin = np.concatenate(([0], np.cumsum(counts + 2)))
    flat = np.empty(begin[-1], dtype=np.int64)
    flat[begin[:-1]], flat[begin[1:] - 1] = _OPEN, _SHUT
    flat[np.arange(len(hashes)) + np.repeat(2 * np.arange(len(raw)) + 1, counts)] = hashes
    cut = np.concatenate(([0], np.cumsum([len(own) for own in pages])))
    return [flat[begin[a] : begin[b]] for a, b in zip(cut[:-1], cut[1:], strict=True)], [begin[a:b] - begin[a] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _searched(pages: list[list[tuple[str, int, bool]]]) -> list[list[str]]:
    """The blocks that repeats are looked for in: those of articles stay whatever else holds them."""
    return [[t for t, _, article in own if not article] for own in pages]


def main_texts(pages: list[tuple[object, list[tuple[str, int, bool]]]]) -> list[tuple[str, int]]:
    """The main text of each (page id, blocks) of a host, and how many of the page's tokens the host repeats."""
    numbers: dict[object, int] = {}
    page_of = np.array([numbers.setdefault(p, len(numbers)) for p, _ in pages])
    streams, begins = _streams(_searched([own for _, own in pages]))
    return _texts([own for _, own in pages], repeated_tokens(streams, page_of), begins)


def _texts(pages: list[list[tuple[str, int, bool]]], covered: list[np.ndarray], begins: list[np.ndarray]) -> list[tuple[str, int]]:
    """The main text of each page's blocks, and how many of its tokens are covered."""
    out = []
    for own, cover, begin in zip(pages, covered, begins, strict=True):
        # a form that holds all there is to read wraps the page
        most = TEXT if any(not template for _, template, _ in own) else FORM
        kept, places = [], iter(begin.tolist())
        for text, template, article in own:
            at = 0 if article else next(places)
            if template > most:
                continue
            if not article:
                tokens = text.split(" ")
                text = " ".join(t for t, c in zip(tokens, cover[at + 1 : at + 1 + len(tokens)].tolist(), strict=True) if not c)
            kept.append((text, article))
        marked = sum(len(t) for t, article in kept if article)
        beside = sum(len(t) for t, article in kept if not article)
        # what an article leaves out is text only where it outweighs the article, as beside a teaser
        texts = [t for t, article in kept if article or beside > marked]
        out.append(("\n".join(t for t in texts if t), int(cover.sum())))
    return out


def _read(batches):
    """Parts of the batches with their pages' blocks, streams, block begins and window hashes; column 0 is the HTML, 1 the host's hash."""
    for batch in batches:
        htmls, begin, size = batch.column(0).to_pylist(), 0, 0
        for k, page in enumerate(htmls):
            size += len(page or "")
            if size > PART_CHARS or k == len(htmls) - 1:
                part = batch.slice(begin, k + 1 - begin)
                pages = [blocks(x or "") for x in htmls[begin : k + 1]]
                streams, begins = _streams(_searched(pages))
                hosts = part.column(1).to_numpy().view(np.uint64)
                windows = [bt.mix64(bt.window_hashes(s.view(np.uint64), DEPTH) ^ h) for s, h in zip(streams, hosts, strict=True)]
                yield part, pages, streams, begins, windows
                begin, size = k + 1, 0


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> bt.U64(20)) & bt.U64(bits - 1)


def _pack(places: np.ndarray) -> bytes:
    """Sorted places inside a segment, as their differences."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, -1).T).view("<u2").ravel().astype(np.int64))


def _mark(bits: int):
    """For each segment of the filter the places of a partition's windows, and those that two pages have."""

    def emit(held: list[np.ndarray]):
        places, counts = np.unique(_place(np.concatenate(held), bits), return_counts=True)
        segments, at = np.unique(places // SEGMENT_BITS, return_index=True)
        edges = np.append(at, len(places)).tolist()
        inside = (places % SEGMENT_BITS).astype(np.int64)
        for k in range(0, len(segments), 256):
            part = range(k, min(k + 256, len(segments)))
            once = [_pack(inside[edges[i] : edges[i + 1]]) for i in part]
            twice = [_pack(inside[edges[i] : edges[i + 1]][counts[edges[i] : edges[i + 1]] > 1]) for i in part]
            yield pa.RecordBatch.from_arrays([pa.array(segments[part.start : part.stop].astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["segment", "once", "twice"])

    def run(batches):
        held, size = [], 0
        for _, _, _, _, windows in _read(batches):
            held += [np.unique(w) for w in windows]
            size += sum(len(w) for w in windows)
            if size > FLUSH_HASHES:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return run


def _merge_segments(batches):
    """Merges the rows of a segment, which follow each other, one by one."""
    now, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary())], ["segment", "twice"])

    for batch in batches:
        for segment, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if segment != now:
                if now is not None:
                    yield done()
                now, once, twice = segment, np.zeros(SEGMENT_BITS, dtype=bool), np.zeros(SEGMENT_BITS, dtype=bool)
            a = _unpack(a)
            twice[a[once[a]]] = True
            once[a] = True
            twice[_unpack(b)] = True
    if now is not None:
        yield done()


class _Filter:
    """Packed bits that travel compressed, and are unpacked once in each worker."""

    def __init__(self, segments: dict[int, bytes], bits: int):
        self.segments, self.bits, self._packed = segments, bits, None

    def __getstate__(self):
        return {"segments": self.segments, "bits": self.bits, "_packed": None}

    def packed(self) -> np.ndarray:
        if self._packed is None:
            self._packed = np.zeros(self.bits // 8, dtype=np.uint8)
            for k, raw in self.segments.items():
                self._packed[k * SEGMENT_BITS // 8 : (k + 1) * SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(raw), np.uint8)
        return self._packed


def _hits(windows: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    place = _place(windows, bits)
    return (packed[place >> bt.U64(3)] >> (place & bt.U64(7)).astype(np.uint8) & 1).astype(bool)


def _suspects(held, bits: int):
    """(window, page) of the windows that the filter holds, for a part's first and last page at most; column 2 is the page's key."""

    def run(batches):
        packed = held.value.packed()
        for part, _, _, _, windows in _read(batches):
            flat, page = np.concatenate(windows), np.repeat(part.column(2).to_numpy(), [len(w) for w in windows])
            hit = _hits(flat, packed, bits)
            flat, page = flat[hit].view(np.int64), page[hit]
            if not len(flat):
                continue
            order = np.argsort(flat, kind="stable")
            flat, page = flat[order], page[order]
            at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            low, high = np.minimum.reduceat(page, at), np.maximum.reduceat(page, at)
            two = low < high
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((flat[at], flat[at][two]))), pa.array(np.concatenate((low, high[two])))], ["window", "page"])

    return run


def _page_windows(held, bits: int):
    """(page, window) of the windows that the filter holds, once for each page of a part."""

    def run(batches):
        packed = held.value.packed()
        for part, _, _, _, windows in _read(batches):
            keys, first = np.unique(part.column(2).to_numpy(), return_index=True)
            for key, k in zip(keys.tolist(), first.tolist(), strict=True):
                own = np.unique(windows[k])
                own = own[_hits(own, packed, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key, np.int64)), pa.array(own.view(np.int64))], ["page", "window"])

    return run


def _extract(known):
    """Columns: HTML, host's hash, id, url, and the page's repeated windows unless all ``known`` ones are broadcast."""

    def run(batches):
        every = None if known is None else known.value
        for part, pages, streams, begins, windows in _read(batches):
            covered = []
            for k, (s, w) in enumerate(zip(streams, windows, strict=True)):
                cover = np.zeros(len(s) + 1, dtype=np.int32)
                if every is None:
                    seen = part.column(4)[k]
                    own = np.sort(seen.values.to_numpy(zero_copy_only=False).view(np.uint64)) if seen.is_valid else np.zeros(0, np.uint64)
                else:
                    own = every
                if len(own) and len(w):
                    hit = np.flatnonzero(own[np.minimum(np.searchsorted(own, w), len(own) - 1)] == w)
                    cover[hit] += 1
                    cover[hit + DEPTH] -= 1
                covered.append(np.cumsum(cover[:-1]) > 0)
            texts = _texts(pages, covered, begins)
            yield pa.RecordBatch.from_arrays(
                [part.column(2), part.column(3), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([n for _, n in texts], pa.int64())],
                ["id", "url", "text", "n_chars", "n_repeated"],
            )

    return run


class Repeats:
    """The windows that two pages of a host have (``windows``), of rows with ``html``, ``host`` and ``page``."""

    def __init__(self, rows: DataFrame, bits: int | None = None):
        if bits is None:
            size = rows.agg(F.sum(F.octet_length("html")).alias("n")).first()["n"] or 0
            bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * size).bit_length()))
        self.rows, self.bits = rows.select("html", "host", "page"), bits
        marks = self.rows.mapInArrow(_mark(bits), "segment int, once binary, twice binary")
        merged = marks.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge_segments, "segment int, twice binary")
        self.held = rows.sparkSession.sparkContext.broadcast(_Filter({r["segment"]: bytes(r["twice"]) for r in merged.toLocalIterator()}, bits))
        suspects = self.rows.mapInArrow(_suspects(self.held, bits), "window long, page long")
        # sums of a task come first, so a window of a hot host is a row for each task
        self.windows = materialize(suspects.groupBy("window").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low < high").select("window"), "repeated-windows")

    def broadcast(self, most: int):
        """All windows, sorted, if they are ``most`` at most; else nothing."""
        if self.windows.count() > most:
            return None
        found = self.windows.toArrow()["window"].to_numpy().view(np.uint64)
        return self.rows.sparkSession.sparkContext.broadcast(np.sort(found))

    def by_page(self) -> DataFrame:
        """(of, windows): each page's repeated windows, by a shuffle; the windows of hot hosts are met on ``SALTS`` places."""
        own = self.rows.mapInArrow(_page_windows(self.held, self.bits), "page long, window long").withColumn("salt", F.pmod("page", F.lit(SALTS)))
        often = self.windows.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        return own.join(often.hint("merge"), ["window", "salt"], "left_semi").groupBy(F.col("page").alias("of")).agg(F.collect_set("window").alias("windows"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bits: int | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Per page: id, url, main ``text``, ``n_chars`` and ``n_repeated``, the tokens that substrings shared by the host's pages cover."""
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(html_col).cast("string").alias("html"), F.xxhash64(host).alias("host"), F.col(id_col).alias("id"), url.alias("url"))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    repeats = Repeats(rows, bits)
    known = repeats.broadcast(most_broadcast)
    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.select("html", "host", "id", "url")
    if known is None:
        out = rows.join(repeats.by_page(), F.col("page") == F.col("of"), "left").select("html", "host", "id", "url", "windows")
    return out.mapInArrow(_extract(known), f"id {kind}, url string, text string, n_chars long, n_repeated long").withColumnRenamed("id", id_col)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every ``pages`` row."""
    return extract(table(spark, sf_dir, "pages"))
