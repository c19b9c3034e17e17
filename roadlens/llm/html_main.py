"""Operator 7: main text of web pages, with a host suffix array for boilerplate.

Every page is cut into blocks (text between block-level tags) of four kinds:
text in elements that are no content by what they are (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments; scripts and styles have no
text at all), passages inside ``article`` or ``main``, blocks in there that are
links and nothing else, and *free* blocks outside of them.

The token stream of a page is all its blocks in page order, so runs cross the
borders of blocks and elements.  A run of ``length`` tokens that stands on two
different pages of a host is *repeated*; copies of a page (same host, same text
outside the elements left out) are one page here.  Repeats come from a suffix
array of the streams, sorted on the first ``length`` tokens and built in
chunks: pages are dealt to chunks by a hash of their text, so a host of any
size is spread over many.  Inside a chunk, neighbours in its suffix array that
agree and stand on different pages are repeats.  Between chunks, every chunk
sends a 32-bit key of the anchors of its runs (``_Streams.windows``) to
buckets, learns which of them another chunk has, and then sends the 64-bit
hashes of the runs with such an anchor to learn which of these another chunk
has.  The first pass only narrows the second; equal runs have equal anchors.

What is repeated decides, and markup checks it:

- a free block that repeated runs cover whole goes, else the tokens go that
  runs within the block cover.  Free blocks count only on pages without
  ``article`` and ``main``;
- blocks of links in an article that go on as a repeated run over two or more
  of them are a menu and go;
- passages stay, also where they repeat or pages are near copies of each other:
  the text asked for is the whole article;
- text in elements that are no content goes, repeated or not.

Hashes of 64 bits stand for tokens and runs.

Cases: null html is the empty page (empty text); unclosed and misnested tags
are closed with their parent; cut-off pages end where they end; a null url has
the empty host; repeated rows are pages of their own in the result; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only
from .wordarrays import _MULT, SPACE_WORDS, mix, scan

LENGTH = 8
#: html of a chunk (one suffix array), html whose runs are compared in one bucket, characters packed at once
CHUNK_BYTES, BUCKET_BYTES, PACK_CHARS = 4 << 20, 32 << 20, 32 << 20
_CHROME_TEXT, _FREE, _PASSAGE, _LINKS = range(4)  # kinds of blocks
_SENT = "bucket int, chunk int, keys binary"
_LOW = np.uint64(0xFFFFFFFF)

_DROPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea "
                     "option iframe object svg canvas audio video map dialog menu".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: a class or id made of, or starting or ending with, one of these words marks an element that is no content
_CHROME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|"
    r"navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|footer|header|masthead|cookie|cookies|consent|"
    r"notice|notices|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    r"comment|comments|disqus|replies|widget|toolbar|pagination|pager|skip-link)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
                    r"|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)


def _is_chrome(tag: str, attributes: str) -> bool:
    if tag in _DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id") and _CHROME.search(value):
            return True
        if name == "role" and value.strip().lower() in _CHROME_ROLES:
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes, re.I))


def _cut(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks, white space normalised, in page order."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, content left out, inside the main element
    # open tags by name, in all and since each open article or main, so that an end tag without one costs nothing
    total, opened = Counter(), [Counter()]
    text: list[str] = []
    out = main = plain = False  # plain: some of the block's text is in no link, or in a heading
    at = 0

    def close() -> None:
        nonlocal plain
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            if line:
                found.append((_CHROME_TEXT if out else _FREE if not main else _PASSAGE if plain else _LINKS, line))
            text.clear()
        plain = False

    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            text.append(page[at:end])
            plain = plain or not text[-1].isspace() and (not total["a"] or any(total[t] for t in _HEADINGS))
        if not m:
            break
        at = max(m.end(), m.start() + 1)
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:  # an end tag closes up to its start tag, if that is open; an inline one not beyond the main element
            if (opened[-1] if tag in _INLINE else total)[tag]:
                blocky = False
                while True:
                    last = stack.pop()[0]
                    if last in _MAIN:
                        opened.pop()
                    opened[-1][last] -= 1
                    total[last] -= 1
                    blocky = blocky or last not in _INLINE
                    if last == tag:
                        break
                inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                if blocky or out and not inside[0]:
                    close()
                out, main = inside
            continue
        if tag not in _INLINE:
            close()
        if tag in _VOID:
            continue
        inner_out = out or _is_chrome(tag, m[4])
        if inner_out and not out:
            close()
        if tag in _RAW:  # their content is no markup
            stop = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(page, at)
            at = stop.start()
        if m[4].endswith("/") and tag not in _RAW and tag in ("svg", "path", "use"):
            continue
        if tag == "body":
            stack.clear()
            total, opened = Counter(), [Counter()]
            inner_out = False
        out, main = inner_out, main or tag in _MAIN
        stack.append((tag, out, main))
        opened[-1][tag] += 1
        total[tag] += 1
        if tag in _MAIN:
            opened.append(Counter())
    close()
    return found


def blocks(page: str) -> tuple[list[str], list[str]]:
    """(blocks inside article or main elements, free blocks), white space normalised, in page order."""
    found = _cut(page)
    return [t for k, t in found if k in (_PASSAGE, _LINKS)], [t for k, t in found if k == _FREE]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def suffix_order(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes sorted by their first ``length`` tokens, rank of every suffix), by prefix doubling.

    Suffixes with the same rank agree on these tokens."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < length:
        step = min(width, length - width)
        nxt = np.full(len(rank), -1, dtype=np.int64)
        nxt[:-step] = rank[step:]
        pair = rank * (len(rank) + 1) + nxt + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width += step
    return np.argsort(rank, kind="stable"), rank


def _digest(*parts) -> int:
    raw = json.dumps(parts, ensure_ascii=False).encode()
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def _extract(pages: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, size, pages): packed blocks of pages; all pages with the same text on a host go to one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list]] = {}
        size = empty = 0

        def packed() -> pa.RecordBatch:
            raw = [json.dumps(list(x.values()), ensure_ascii=False).encode() for x in held.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([len(x) for x in raw], pa.int64()),
                 pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary())],
                names=["chunk", "size", "pages"])

        for batch in batches:
            for page_id, url, page in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"]):
                host, found = host_of(url), _cut(page.as_py() or "")
                content = _digest(host, *[t for k, t in found if k != _CHROME_TEXT])
                variant = _digest(host, found)
                empty += not found
                pages_of = held.setdefault((content if found else empty) % n_chunks, {})
                if variant not in pages_of:
                    pages_of[variant] = [variant, content, host, found, []]
                    size += sum(len(t) for _, t in found)
                pages_of[variant][4].append((page_id, url))
                size += len(url or "") + 16
                if size > PACK_CHARS:
                    yield packed()
                    held.clear()
                    size = 0
        if held:
            yield packed()

    return pages.mapInArrow(run, "chunk int, size long, pages binary")


class _Streams:
    """The token streams of a chunk's pages: every page once, all its blocks in page order."""

    def __init__(self, packed: pa.Table):
        self.groups = [json.loads(pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True))
                       for n, x in zip(packed["size"].to_pylist(), packed["pages"].to_pylist())]
        self.place: dict[int, int] = {}
        self.pages = []
        for entry in (e for g in self.groups for e in g):
            if entry[0] not in self.place:
                self.place[entry[0]] = len(self.pages)
                self.pages.append(entry)
        column = pa.array([" ".join(t for _, t in e[3]) for e in self.pages], pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[:len(column) + 1]
        w = scan(np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8), offsets, SPACE_WORDS)
        hosts = np.array([_digest(e[2]) for e in self.pages], dtype=np.uint64)
        self.row, self.first = w.row, w.first
        self.content = np.array([e[1] for e in self.pages], dtype=np.uint64)
        self.tokens = mix(w.hash ^ hosts[w.row])  # words of different hosts are different tokens

    def grams(self, k: int) -> np.ndarray:
        """A hash of the ``k`` tokens from every token on."""
        h = np.full(max(0, len(self.tokens) - k + 1), k, dtype=np.uint64)
        for j in range(k):
            h = h * _MULT + self.tokens[j:j + len(h)]
        return mix(h)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, hash, anchor) of every run of ``length`` tokens of a page.

        The anchor is the smallest hash of the run's shorter runs of half its length: equal runs have
        equal anchors, and neighbours mostly share theirs, so there are far fewer anchors than runs."""
        h, half = self.grams(length), (length + 1) // 2
        at = np.flatnonzero(self.row[:len(h)] == self.row[length - 1:])
        parts = self.grams(half)
        low = parts[at]
        for j in range(1, length - half + 1):
            low = np.minimum(low, parts[at + j])
        return at, h[at], mix(low)

    def repeated_here(self, at: np.ndarray, length: int) -> np.ndarray:
        """Which of the runs stand on different pages of this chunk: neighbours in its suffix array."""
        shift = np.concatenate([[0], np.cumsum(self.row[1:] != self.row[:-1])]) if len(self.row) else self.row
        stream = _with_breaks(self.tokens, self.row)
        owner = np.zeros(len(stream), dtype=np.uint64)
        owner[np.arange(len(self.row)) + shift] = self.content[self.row]
        order, rank = suffix_order(stream, length)
        shared = np.zeros(len(stream), dtype=bool)
        shared[rank[order[1:]][(rank[order[1:]] == rank[order[:-1]]) & (owner[order[1:]] != owner[order[:-1]])]] = True
        return shared[rank[at + shift[at]]]


def _with_breaks(tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The tokens with a value of its own after the last token of every row."""
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.empty(0, np.int64)
    breaks = mix(np.arange(len(last), dtype=np.uint64) + np.uint64(0xB4EA << 40))
    return np.insert(tokens, last + 1, breaks)


def _short(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket (upper half) and 32 bits of the hashes."""
    return (hashes & _LOW) % np.uint64(n_buckets) << np.uint64(32) | hashes >> np.uint64(32)


def _sent(chunk: int, keys: np.ndarray, n_buckets: int, short: bool) -> pa.Table:
    """(bucket, chunk, keys): the different keys of a chunk by bucket."""
    keys = np.unique(keys)
    bucket = (keys >> np.uint64(32) if short else keys % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    parts = np.split(keys[order].astype(np.uint32 if short else np.uint64), first[1:]) if len(there) else []
    return pa.table([pa.array(there, pa.int32()), pa.array([chunk] * len(there), pa.int32()),
                     pa.array([x.tobytes() for x in parts], pa.binary())], names=["bucket", "chunk", "keys"])


def _keys(sent: pa.Table, short: bool) -> np.ndarray:
    kind = np.uint32 if short else np.uint64
    parts = [np.frombuffer(k, dtype=kind).astype(np.uint64) | (np.uint64(b << 32) if short else np.uint64(0))
             for b, k in zip(sent["bucket"].to_pylist(), sent["keys"].to_pylist())]
    return np.concatenate([np.empty(0, np.uint64), *parts])


def _in_two_chunks(sent: DataFrame, short: bool) -> DataFrame:
    """(bucket, chunk, keys): of the keys of every chunk those that another chunk has, too."""
    kind = np.uint32 if short else np.uint64

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(k, dtype=kind) for k in rows["keys"].to_pylist()]
        merged = np.sort(np.concatenate(parts))
        twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
        back = [np.intersect1d(x, twice, assume_unique=True).tobytes() for x in parts]
        done = rows.set_column(rows.schema.get_field_index("keys"), "keys", pa.array(back, pa.binary()))
        return done.filter(pa.array([len(x) > 0 for x in back], pa.bool_()))

    return sent.groupBy("bucket").applyInArrow(run, _SENT)


def _texts(streams: _Streams, repeated: np.ndarray, length: int) -> pa.Table:
    """(pages, text, n_repeated) of the chunk's pages, ``repeated`` being the first tokens of repeated runs."""
    n = len(streams.tokens)
    sizes = np.array([t.count(" ") + 1 for e in streams.pages for _, t in e[3]], dtype=np.int64)
    block_of = np.repeat(np.arange(len(sizes)), sizes)

    def covered(starts: np.ndarray) -> np.ndarray:
        steps = np.zeros(n + 1, dtype=np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + length, -1)
        return np.cumsum(steps[:n]) > 0

    across = covered(repeated)
    inside = covered(repeated[block_of[repeated] == block_of[repeated + length - 1]])
    in_block = np.bincount(block_of, weights=across, minlength=len(sizes)).astype(np.int64)
    whole = in_block == sizes
    # a menu: repeated runs over two or more blocks that are links and nothing else
    kinds = np.array([k for e in streams.pages for k, _ in e[3]], dtype=np.int64)
    others = np.concatenate([[0], np.cumsum(kinds[block_of] != _LINKS)])
    rows_of_links = repeated[(others[repeated + length] == others[repeated])
                             & (block_of[repeated] != block_of[repeated + length - 1])]
    menu = np.bincount(block_of, weights=covered(rows_of_links), minlength=len(sizes)) == sizes
    texts, counts, i = [], [], 0
    for row, entry in enumerate(streams.pages):
        at, kept = int(streams.first[row]), []
        has_main = any(k in (_PASSAGE, _LINKS) for k, _ in entry[3])
        counts.append(int(in_block[i:i + len(entry[3])].sum()))
        for kind, text in entry[3]:
            size = int(sizes[i])
            if kind == _PASSAGE or kind == _LINKS and not menu[i]:
                kept.append(text)
            elif kind == _FREE and not has_main and not whole[i]:
                gone = inside[at:at + size]
                kept.append(" ".join(t for t, g in zip(text.split(" "), gone) if not g) if gone.any() else text)
            at, i = at + size, i + 1
        texts.append(" ".join(kept))
    rows = [(e[4], streams.place[e[0]]) for g in streams.groups for e in g]
    return pa.table([pa.array([[{"page_id": p, "url": u} for p, u in x] for x, _ in rows],
                              pa.list_(pa.struct([("page_id", pa.int64()), ("url", pa.string())]))),
                     pa.array([texts[j] for _, j in rows], pa.string()),
                     pa.array([counts[j] for _, j in rows], pa.int64())], names=["pages", "text", "n_repeated"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated (words of the page in runs that its host repeats) of every page."""
    named = only(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))
    total = named.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n_buckets = total // bucket_bytes + 1
    packed = _extract(named, total // chunk_bytes + 1)

    def anchors(key: tuple, rows: pa.Table) -> pa.Table:
        return _sent(key[0].as_py(), _short(_Streams(rows).windows(length)[2], n_buckets), n_buckets, True)

    def candidates(key: tuple, rows: pa.Table, shared: pa.Table) -> pa.Table:
        _, runs, anchor = _Streams(rows).windows(length)
        return _sent(key[0].as_py(), runs[np.isin(_short(anchor, n_buckets), _keys(shared, True))], n_buckets, False)

    def texts(rows: pa.Table, shared: pa.Table) -> pa.Table:
        streams = _Streams(rows)
        at, runs, _ = streams.windows(length)
        repeated = streams.repeated_here(at, length) | np.isin(runs, _keys(shared, False))
        return _texts(streams, at[repeated], length)

    # a page text is in one chunk, so what two chunks have stands on different pages
    near = _in_two_chunks(packed.groupBy("chunk").applyInArrow(anchors, _SENT), True)
    runs = packed.groupBy("chunk").cogroup(near.groupBy("chunk")).applyInArrow(candidates, _SENT)
    repeats = _in_two_chunks(runs, False)
    done = packed.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(
        texts, "pages array<struct<page_id: long, url: string>>, text string, n_repeated long")
    return (done.select(F.explode("pages").alias("p"), "text", "n_repeated")
            .select(F.col("p.page_id").alias(id_col), F.col("p.url").alias(url_col), "text",
                    F.char_length("text").cast("long").alias("n_chars"), "n_repeated"))
