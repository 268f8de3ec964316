"""Main text of web pages: a host's suffix array tells boilerplate from unique runs.

A page is cut into blocks by its block-level tags; script, style and other
unseen elements, comments and markup go, character references are decoded.
Every block has a zone: inside the article (``article``, ``main``), in page
furniture (``nav``, ``header``, ``footer``, ``aside``, ``form`` and elements
whose class or id says menu, advert, notice, comments, ...), or neither.

The token streams of all blocks outside articles are concatenated per host, a
suffix array over them (prefix doubling) with its longest common prefixes
gives all substrings that repeat on distinct pages, and every token that such
a substring of at least ``MIN_RUN`` tokens (or of a whole block) covers is
boilerplate.  What is kept, in page order: the blocks of the article, whole (a
passage that the author repeats on several pages is part of the article), and
the blocks in neither zone without their covered runs, whether or not the page
marks an article.

Pages of a host whose streams are equal (mirrors, repeated pages) are one page:
what they share with one another is no boilerplate.  A large host's streams are
dealt into buckets of about ``BUCKET_TOKENS`` tokens or ``BUCKET_PAGES`` pages,
each with a suffix array of its own.  What its buckets share is found by
hashes: every run of ``MIN_RUN`` tokens, every whole block below that, and every
shorter run whose hash is in a bit table of such blocks; those met in two
buckets of the host come back to the buckets as marks.  A longer run is covered
by its runs of ``MIN_RUN``, so the buckets' size never changes the result.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm.frames import Shared, cut


MIN_RUN = 8
BUCKET_TOKENS = 50_000
BUCKET_PAGES = 512
BITS = 1 << 24  # bit table of short blocks, 2 MB
BROADCAST_HOSTS = 50_000  # host names of buckets to broadcast, a few MB

_UNSEEN = {"script", "style", "noscript", "template", "title", "svg", "iframe", "object", "canvas", "math"}
_RAW = {"script", "style", "noscript", "iframe"}  # without an end tag these take the rest of the page, as in browsers
_FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "label",
              "fieldset"}
_ARTICLE = {"article", "main"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font",
           "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
           "sub", "sup", "time", "tt", "u", "var", "wbr"}
_ENDED_BY_BLOCK = {"p"}
# A class or id names furniture if all parts of it are such words, at least one of the first kind, or if its head is:
# the last part, before what only says what it is made of (``reader-comments``, ``ad-300x250``, ``disqus_thread``), unless
# a part says that the name is about a state or a whole (``has-sidebar``, ``comments-open``, ``content-and-comments``).
_NAMES = set("""ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent
    notice notices popup modal newsletter subscribe signup sidebar side-bar widget widgets menu navbar nav navigation breadcrumb
    breadcrumbs pagination pager share sharing social footer masthead skip""".split())
_TALK = set("comment comments respond disqus replies related recommended".split())  # articles inside are not the page's
_FILLERS = set("""site page main top bottom left right side primary secondary global mobile box bar block list item items
    link links button buttons area section container wrap wrapper inner outer slot unit row header form body post posts entry
    articles icons""".split())
_TAILS = set("""area box bar block list item items container wrap wrapper inner outer slot unit row section thread feed form
    button buttons link links icons""".split())
_STATES = set("has no not non with without is and plus content open closed on off enabled disabled show hide toggle elementor".split())
_SIZE = re.compile(r"\d+(x\d+)?\Z")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

ARTICLE, PLAIN, FURNITURE = 2, 1, 0
_WRAPPED = -1  # furniture by the name of a wrapper or by a form around it: an article inside is one nevertheless


def _named(named: dict[str, str], words: set[str]) -> bool:
    """True if a whole class or id of the element consists of ``words`` and fillers."""
    for token in f"{named.get('class', '')} {named.get('id', '')}".lower().split():
        parts = [p for p in re.split(r"[_-]+", token) if p]
        if token in words or (any(p in words for p in parts)
                              and all(p in words or p in _FILLERS or p.isdigit() for p in parts)):
            return True
        if len(parts) > 1 and _STATES.isdisjoint(parts):
            while len(parts) > 1 and (parts[-1] in _TAILS or _SIZE.match(parts[-1])):
                parts.pop()
            if parts[-1] in words:
                return True
    return False


def _zone_of(tag: str, attrs: str, zone: int, in_article: bool) -> int:
    """The zone inside an element, given the zone around it."""
    if zone == FURNITURE:
        return FURNITURE
    named: dict[str, str] = {}
    if attrs:
        for m in _ATTR.finditer(attrs):
            named.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = named.get("role", "").lower()
    if tag in _ARTICLE or role in ("main", "article"):
        return FURNITURE if _named(named, _TALK) or zone == _WRAPPED and in_article else ARTICLE
    if tag == "header" and in_article:
        return zone
    if "hidden" in named:
        return FURNITURE
    if tag == "form" or role == "form":
        return _WRAPPED
    if tag in _FURNITURE or role in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog"):
        return FURNITURE
    if tag not in ("body", "html"):
        if _named(named, _TALK):
            return FURNITURE
        if _named(named, _NAMES):
            return _WRAPPED
    return zone


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of every block of a page, in page order; unclosed elements end with the element around them."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    zone = PLAIN
    stack: list[tuple[str, int]] = []
    unseen: str | None = None

    def flush():
        if text:
            s = _SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
            if s:
                out.append((max(zone, FURNITURE), s))
            text.clear()

    at = 0
    page = page or ""
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if unseen is None:
                text.append(page[at:])
            break
        if unseen is None and m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in _INLINE:
                flush()
            if any(t == tag for t, _ in stack):
                while stack:
                    t, before = stack.pop()
                    if t == tag:
                        flush() if before != zone else None
                        zone = before
                        break
            continue
        if tag == "head":  # its end tag may be left out; what it holds is unseen or void
            flush()
            continue
        if tag in _UNSEEN:
            if tag in ("svg", "math") and m[3].endswith("/"):
                continue
            # raw text: nothing inside is markup until the element's own end (a title ends with the head as well)
            stop = r"|(?=</head\s*>|<body[\s>])" if tag == "title" else ""
            end = re.compile(rf"</{re.escape(tag)}\s*>{stop}", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in _RAW:
                at = len(page)
            text.append(" ")
            continue
        if tag not in _INLINE:
            flush()
            if stack and stack[-1][0] in _ENDED_BY_BLOCK:
                t, before = stack.pop()
                zone = before
        elif tag == "br":
            text.append(" ")
        if tag in _VOID or m[3].endswith("/"):
            continue
        inner = _zone_of(tag, m[3], zone, any(t in _ARTICLE for t, _ in stack))
        if inner != zone:
            flush()
        if tag not in _INLINE or inner != zone:
            stack.append((tag, zone))
        zone = inner
    flush()
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of an integer sequence by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:n - k] = rank[k:]
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[1], (np.diff(key[order]) > 0).astype(np.int64)])
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(step)
        if new.max(initial=0) == n or k >= n:
            return order
        rank, k = new, k * 2


def lcp_array(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[i]: tokens that suffixes sa[i-1] and sa[i] share.

    Vectorised: all neighbours are compared one token at a time, those that still agree go on.
    """
    n = len(s)
    out = np.zeros(n, np.int64)
    live = np.arange(1, n)
    depth = 0
    while len(live):
        a, b = sa[live - 1] + depth, sa[live] + depth
        ok = (a < n) & (b < n)
        live, a, b = live[ok], a[ok], b[ok]
        live = live[s[a] == s[b]]
        depth += 1
        out[live] = depth
    return out


def covered(streams: list[list[list[str]]], min_run: int = MIN_RUN) -> list[list[np.ndarray]]:
    """For pages of blocks of tokens: which tokens lie in a substring found on at least two distinct pages.

    A substring counts from ``min_run`` tokens, or if it is a whole block.  Every block ends in a token of its own,
    so no substring runs on into the next block.  Every stream given counts as a page of its own.
    """
    words: dict[str, int] = {}
    seq, stop, page, begin = [], [], [], []
    for p, page_blocks in enumerate(streams):
        for b in page_blocks:
            start = len(seq)
            begin.append((p, start, len(b)))
            seq += [words.setdefault(w, len(words)) for w in b]
            seq.append(-len(begin))
            stop += [start + len(b)] * (len(b) + 1)
            page += [p] * (len(b) + 1)
    n = len(seq)
    mark = np.zeros(n + 1, np.int64)
    if n:
        s, stop_a, page_a = np.array(seq), np.array(stop), np.array(page)
        head = np.zeros(n, bool)
        head[[b for _, b, k in begin if k]] = True
        sa = suffix_array(s)
        best = _shared_with_another_page(lcp_array(s, sa), page_a[sa])
        ok = (best >= min_run) | ((best > 0) & head[sa] & (best == stop_a[sa] - sa))
        np.add.at(mark, sa[ok], 1)
        np.add.at(mark, sa[ok] + best[ok], -1)
    hit = np.cumsum(mark[:-1]) > 0
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for p, start, size in begin:
        out[p].append(hit[start:start + size])
    return out


def _shared_with_another_page(lcp: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """For each entry of the suffix array the longest prefix shared with a suffix of another page.

    The next entry of another page is the closest one in that direction, and what is shared with it is the
    smallest lcp on the way: a running minimum over the run of one page's entries, once forward, once backward.
    """
    if not len(lcp):
        return lcp
    forward = _low_of_runs(np.append(0, lcp[1:]), pages)
    return np.maximum(forward, _low_of_runs(np.append(0, lcp[:0:-1]), pages[::-1])[::-1])


def _low_of_runs(edge: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """The running minimum of ``edge`` that starts anew wherever the page changes."""
    run = np.cumsum(np.append(False, pages[1:] != pages[:-1]))
    apart = run * (edge.max() + 1)  # every value of a run is below all of the runs before it
    return np.minimum.accumulate(edge - apart) + apart


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of (a, b)."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Hashes of the runs of up to ``min_run`` tokens inside the blocks of some streams."""

    def __init__(self, streams: list[list[list[str]]], min_run: int):
        words: dict[str, int] = {}
        blocks = [(p, b) for p, page in enumerate(streams) for b in page]
        size = np.array([len(b) for _, b in blocks], np.int64)
        seq = np.array([words.setdefault(w, len(words)) for _, b in blocks for w in b], np.int64)
        codes = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                          for w in words], np.uint64)
        self.min_run, self.n = min_run, len(seq)
        self.tokens = codes[seq] if len(seq) else np.zeros(0, np.uint64)
        self.left = np.repeat(np.cumsum(size), size) - np.arange(self.n)  # tokens to the end of the block
        self.page = np.repeat(np.array([p for p, _ in blocks], np.int64), size)
        self.head = np.zeros(self.n, bool)
        self.head[(np.cumsum(size) - size)[size > 0]] = True
        self.size = np.array([sum(map(len, page)) for page in streams], np.int64)

    def runs(self):
        """(k, positions, hashes) for k = 1 .. min_run: the runs of k tokens that lie in one block."""
        at = np.arange(self.n)
        h = np.zeros(self.n, np.uint64)
        for k in range(1, self.min_run + 1):
            ok = self.left[at] >= k
            at, h = at[ok], h[ok]
            h = _mix(h, self.tokens[at + k - 1])
            yield k, at, h

    def blocks_below(self) -> np.ndarray:
        """Hashes of the whole blocks of fewer than min_run tokens."""
        got = [h[self.head[at] & (self.left[at] == k)] for k, at, h in self.runs() if k < self.min_run]
        return np.unique(np.concatenate(got or [np.zeros(0, np.uint64)]))

    def offered(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, wanted): each run of min_run tokens, and each shorter one whose hash is in the bit table.

        Wanted: covers tokens if another bucket has it, and a single stream here, so its suffix array did not tell.
        """
        hashes, pages, wants = [], [], []
        for k, at, h in self.runs():
            whole = self.head[at] & (self.left[at] == k)
            ok = np.ones(len(at), bool) if k == self.min_run else in_bits(h, bits)
            hashes.append(h[ok])
            pages.append(self.page[at][ok])
            wants.append(np.ones(ok.sum(), bool) if k == self.min_run else whole[ok])
        h, p, w = np.concatenate(hashes), np.concatenate(pages), np.concatenate(wants)
        uniq, at = np.unique(h, return_inverse=True)
        low, high = np.full(len(uniq), self.size.size), np.full(len(uniq), -1)
        np.minimum.at(low, at, p)
        np.maximum.at(high, at, p)
        wanted = np.zeros(len(uniq), bool)
        wanted[at[w]] = True
        return uniq, wanted & (low == high)

    def marks(self, shared: np.ndarray) -> np.ndarray:
        """Which tokens lie in a run of min_run tokens or a whole shorter block whose hash is in ``shared``."""
        mark = np.zeros(self.n + 1, np.int64)
        for k, at, h in self.runs():
            ok = np.isin(h, shared)
            if k < self.min_run:
                ok &= self.head[at] & (self.left[at] == k)
            np.add.at(mark, at[ok], 1)
            np.add.at(mark, at[ok] + k, -1)
        return np.cumsum(mark[:-1]) > 0


def in_bits(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """True for hashes whose bit is set in a table of BITS bits."""
    at = (h % np.uint64(BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _streams(texts: pa.Array | pa.ChunkedArray) -> list[list[list[str]]]:
    return [[b.split() for b in t.split("\n")] for t in texts.to_pylist()]


def _marks(streams: list[list[list[str]]], shared: np.ndarray, min_run: int) -> list[bytes]:
    """For every stream a byte a token: 1 if it is boilerplate."""
    hits = covered(streams, min_run)
    far = Grams(streams, min_run).marks(shared) if len(shared) else None
    out, at = [], 0
    for page in hits:
        m = np.concatenate(page) if page else np.zeros(0, bool)
        if far is not None:
            m = m | far[at:at + len(m)]
        at += len(m)
        out.append(m.astype(np.uint8).tobytes())
    return out


def _text(zones: list[int], texts: list[str], starts: list[int], marks: bytes | None) -> str:
    """The text of a page from its article and plain blocks; ``starts``: where a plain block begins in the stream."""
    kept = []
    for z, b, start in zip(zones, texts, starts, strict=True):
        if z == PLAIN and marks:
            b = " ".join(w for k, w in enumerate(b.split(), start) if not marks[k])
        if b:
            kept.append(b)
    return "\n\n".join(kept)


def _packed(text: str) -> bytes:
    """The text compressed, after its size in bytes; read by ``_unpacked``."""
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> str:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True).decode() if size else ""


_PARSED = "struct<plain:boolean,text:binary,digest:binary,stream:string,zones:array<int>,texts:array<string>,starts:array<int>>"
_PARSED_TYPE = pa.struct([("plain", pa.bool_()), ("text", pa.binary()), ("digest", pa.binary()), ("stream", pa.string()),
                          ("zones", pa.list_(pa.int32())), ("texts", pa.list_(pa.string())), ("starts", pa.list_(pa.int32()))])


def _parse_batch(pages: pa.Array) -> pa.Array:
    """Per page: its text, compressed, if it has no plain blocks, the digest and text of its stream, and its blocks if it has some."""
    rows = []
    for p in pages:
        page = blocks(p.as_py())
        stream = "\n".join(t for z, t in page if z != ARTICLE)
        row = {"plain": any(z == PLAIN for z, _ in page), "stream": stream,
               "digest": hashlib.blake2b(stream.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
        if row["plain"]:
            own, at = [], 0
            for z, t in page:
                if z != FURNITURE:
                    own.append((z, t, at))
                if z != ARTICLE:
                    at += len(t.split())
            row |= {"zones": [z for z, _, _ in own], "texts": [t for _, t, _ in own], "starts": [a for _, _, a in own]}
        else:
            row["text"] = _packed("\n\n".join(t for z, t in page if z == ARTICLE))
        rows.append(row)
    return pa.array(rows, _PARSED_TYPE)


def _bit_table(streams: DataFrame, min_run: int) -> np.ndarray:
    """BITS bits, packed: set for the hashes of all whole blocks below ``min_run`` tokens of these streams."""
    def heads(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BUCKET_PAGES):
                h = Grams(_streams(batch["s"].slice(i, BUCKET_PAGES)), min_run).blocks_below() % np.uint64(BITS)
                yield pa.RecordBatch.from_pydict({"b": np.unique(h).astype(np.int64)})

    hashes = streams.select("s").mapInArrow(heads, "b long")
    slices = hashes.groupBy((F.col("b") / F.lit(32768)).cast("long").alias("n")).agg(
        F.expr("bitmap_construct_agg(b % 32768)").alias("bits")).collect()  # BITS / 32768 rows of 4 KB at most
    table = np.zeros(BITS // 8, np.uint8)
    for r in slices:
        table[r["n"] * 4096:(r["n"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


def extract_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id",
                 out: str = "text", min_run: int = MIN_RUN,
                 bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(id, url, ``out``) of every page: its main text, "" if there is none.

    Null html is an empty page; null urls share one host; repeated pages stay, and those of a host whose streams are
    equal count as one page.  ``bucket_tokens`` never changes the result.  Very long pages are parsed whole, by one task.
    Other columns are not read, whatever their names.  Empty table: no rows.
    """
    @arrow_udf(_PARSED)
    def parse(pages: pa.Array) -> pa.Array:
        return _parse_batch(pages)

    parse = parse.asNondeterministic()  # so that filters on its result do not run it a second time
    where = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"://([^/?#]*)", 1), F.lit("")))
    parsed = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), where.alias("h"), parse(F.col(html_col)).alias("p"))
    # pages are parsed once: their texts and blocks are kept for the passes to come
    read = cut(parsed.select("i", "u", "h", *[F.col(f"p.{c}").alias(k) for k, c in zip(
        "dspxzto", ("digest", "stream", "plain", "text", "zones", "texts", "starts"), strict=True)]))
    streams = cut(read.where("s <> ''").groupBy("h", "d").agg(F.first("s").alias("s"), F.max("p").alias("p")))
    # about bucket_tokens in a bucket: a token of a stream takes six characters
    buckets = F.greatest(F.ceil(F.sum(F.length("s").cast("long")) / F.lit(6 * bucket_tokens)), F.ceil(F.count("*") / F.lit(BUCKET_PAGES)))
    dealt = cut(streams.groupBy("h").agg(buckets.cast("long").alias("k")).where("k > 1"))
    hosts = dealt.count()
    small = hosts <= BROADCAST_HOSTS
    streams = streams.join(F.broadcast(dealt) if small else dealt, "h", "left").withColumns({
        "many": F.col("k").isNotNull(), "k": F.pmod(F.xxhash64("d"), F.coalesce("k", F.lit(1).cast("long")))})
    if not small:  # the join has dealt the rows by host alone, which would satisfy the grouping
        streams = streams.repartition("h", "k")

    def decide(here: pa.Table, shared: np.ndarray) -> pa.Table:
        marks = pa.array(_marks(_streams(here["s"]), shared, min_run), pa.binary())
        return pa.table({"h": here["h"], "d": here["d"], "m": marks}).filter(here["p"])  # only plain blocks need them

    marked = "h string, d binary, m binary"
    if not hosts:
        def alone(here: pa.Table) -> pa.Table:
            return decide(here, np.zeros(0, np.uint64))

        marks = streams.groupBy("h", "k").applyInArrow(alone, marked)
    else:
        bits = Shared(pages.sparkSession, _bit_table(streams.where("many"), min_run))

        def offer(here: pa.Table) -> pa.Table:
            h, wanted = Grams(_streams(here["s"]), min_run).offered(bits.get())
            return pa.table({"h": pa.repeat(here["h"][0], len(h)), "k": pa.repeat(here["k"][0], len(h)),
                             "x": h.view(np.int64), "w": wanted})

        offered = streams.where("many").select("h", "k", "s").groupBy("h", "k").applyInArrow(
            offer, "h string, k long, x long, w boolean")
        # a row for a hash and bucket: one that two buckets offer is on two pages
        met = offered.withColumn("n", F.count("*").over(Window.partitionBy("h", "x"))).where("n > 1 and w")
        met = met.groupBy("h", "k").agg(F.collect_list("x").alias("x"))  # at most a bucket's tokens

        def with_shared(here: pa.Table, other: pa.Table) -> pa.Table:
            lists = [c.flatten().to_numpy(zero_copy_only=False) for c in other["x"].chunks]
            return decide(here, np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64).view(np.uint64))

        marks = streams.groupBy("h", "k").cogroup(met.groupBy("h", "k")).applyInArrow(with_shared, marked)

    @arrow_udf("string")
    def render(zones: pa.Array, texts: pa.Array, starts: pa.Array, marks: pa.Array) -> pa.Array:
        return pa.array([_text(*row) for row in zip(zones.to_pylist(), texts.to_pylist(), starts.to_pylist(),
                                                    marks.to_pylist(), strict=True)], pa.string())

    @arrow_udf("string")
    def opened(texts: pa.Array) -> pa.Array:
        return pa.array(map(_unpacked, texts.to_pylist()), pa.string())

    whole = read.where("not p").select("i", "u", opened("x").alias("x"))
    mixed = read.where("p").join(marks, ["h", "d"], "left").select("i", "u", render("z", "t", "o", "m").alias("x"))
    done = whole.unionByName(mixed)
    return done.select(F.col("i").alias(id_col), F.col("u").alias(url_col), F.col("x").alias(out))
