"""Main text of web pages: structure parts the page, suffixes of each host's pages find repeated boilerplate in every part."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.spans import _grouped, merged
from undertow.llm.tables import Tables
from undertow.llm.text import WORD_BASE, Words, prefix_hash, signed, sliding_min, span_hash
from undertow.session import broadcast_if_small

#: Words of the shortest run that counts as boilerplate, words that suffixes are compared by, and streams that repeat it.
RUN, DEPTH, STREAMS = 5, 12, 3
#: In articles, whose prose repeats phrases: words of the shortest run that counts, and words of the grams it is found by.
ARTICLE_RUN, GRAM = 20, 5
#: Grams that a task holds before it looks for those that half of a host's articles share.
HELD = 1 << 22

# a quote opens a value only after "="; no part is ever given back, and markup left open ends with the page, so a page is read once
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# fixed values: elements of HTML by their part in a page
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "button", "canvas", "audio", "video"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
    "newsletter", "subscribe", "signup", "login", "popup", "modal", "overlay", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "pagination", "pager", "share", "sharing", "social", "related", "recommended", "comment", "comments", "respond", "replies", "disqus", "footer", "header",
    "masthead", "copyright", "widget", "complementary", "contentinfo", "search", "toolbar",
}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
MAIN = {"article", "main"}
# fixed values: words that say nothing of their own beside a mark, as in site-footer or share-buttons
NEUTRAL = {
    "site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "box", "bar", "block", "slot", "unit", "list", "links",
    "buttons", "section", "area", "container", "wrapper", "inner", "form", "posts", "item", "items", "js", "col", "row",
}


def _aside(name: str, attrs: str, inside: bool) -> bool:
    if name in ASIDE:
        return True
    if not attrs or name in ("html", "body"):
        return False
    for key, value in _NAMES.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if key in ("class", "id", "role") and any(_marked(token) for token in value.split()):
            return True
    return False


def _marked(token: str) -> bool:
    """Whether one class, id or role marks what is not main text: a mark, beside other marks and neutral words alone."""
    parts = [p for p in re.split(r"[^a-z0-9]+", token) if p and not p.isdigit()]
    return not MARKS.isdisjoint(parts) and all(p in MARKS or p in NEUTRAL for p in parts)


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside the article, aside) of each block of a page in order; markup, scripts and styles are gone."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, within main, within an aside
    at, within, off = 0, False, False
    opened: dict[str, int] = defaultdict(int)  # names on the stack, so that it is searched only for what it holds

    def cut(k: int) -> None:
        nonlocal within, off
        while len(stack) > k:
            opened[stack.pop()[0]] -= 1
        within, off = stack[-1][1:] if stack else (False, False)

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, within, off))
            parts.clear()

    def text(a: int, b: int) -> None:
        if b > a:
            piece = page[a:b]
            parts.append(html.unescape(piece) if "&" in piece else piece)

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(at, len(page))
            break
        text(at, m.start())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                close()
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                cut(k)
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if name in VOID:
            if name in BLOCK:
                close()
            elif name == "br":
                parts.append(" ")
            continue
        if name in BLOCK:
            close()
            # an open paragraph ends where a block begins, a list item or cell where the next one does
            ends = ENDS.get(name, ("p",))
            if opened[ends[0]] or opened[ends[-1]]:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in BLOCK:
                    k -= 1
                if k >= 0 and stack[k][0] in ends:
                    cut(k)
        heading = name in ("h1", "h2") and off and within and stack and stack[-1][0] == "header"
        here = within or name in MAIN or 'role="main"' in m[3]
        away = False if heading else off or _aside(name, m[3], within)
        if m[3].endswith("/") and name not in BLOCK:
            continue
        stack.append((name, here, away))
        opened[name] += 1
        within, off = here, away
    close()
    return out


def _streams(pages: list[list[tuple[str, bool, bool]]], article: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, their block) of the blocks outside the article of each page, or in it: its part of its host's token stream."""
    texts = [(p, k, t.encode()) for p, found in enumerate(pages) for k, (t, within, off) in enumerate(found) if (within and not off) == article]
    data = np.frombuffer(b"".join([t for *_, t in texts]), np.uint8)
    words = Words(data, np.r_[0, np.cumsum([len(t) for *_, t in texts])].astype(np.int64))
    page = np.array([p for p, *_ in texts], np.int64)[words.row]
    block = np.array([k for _, k, _ in texts], np.int64)[words.row]
    cuts = np.searchsorted(page, np.arange(len(pages) + 1))
    return [(words.hash[x:y], block[x:y]) for x, y in zip(cuts, cuts[1:])]


def _id(host: str, tokens: np.ndarray) -> int:
    """64-bit name of a stream within its host."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8, key=host.encode()[:64]).digest(), "little", signed=True)


def _host(url: str | None) -> str:
    return (url or "").split("://", 1)[-1].split("/", 1)[0].lower()


def _runs(url: str | None, tokens: np.ndarray) -> np.ndarray:
    """Hash of the host and of the RUN words from each word on."""
    first = np.arange(len(tokens) - RUN + 1)
    return span_hash(prefix_hash(tokens, WORD_BASE), WORD_BASE, first, first + RUN) ^ np.array([_id(_host(url), tokens[:0])]).view(np.uint64)


def _suffixes(batches):
    for batch in (whole.slice(a, 512) for whole in batches for a in range(0, whole.num_rows, 512)):
        keys, suffix, stream, place = [], [], [], []
        streams = _streams([blocks(page or "") for page in batch.column(1).to_pylist()])
        for url, (tokens, _) in zip(batch.column(0).to_pylist(), streams):
            n = len(tokens) - RUN + 1
            if n <= 0:
                continue
            sid = _id(_host(url), tokens)
            first = np.arange(n)
            key = _runs(url, tokens)
            short = np.r_[(tokens >> np.uint64(33)).astype(">u4"), np.zeros(DEPTH, ">u4")]
            rows = np.lib.stride_tricks.sliding_window_view(short, DEPTH)[:n]
            keys.append(key)
            suffix.append(np.ascontiguousarray(rows).view(f"V{4 * DEPTH}").ravel())
            stream.append(np.full(n, sid))
            place.append(first)
        if keys:
            flat = np.concatenate(suffix)
            width = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DEPTH), len(flat), [None, pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(keys))), width.cast(pa.binary()), pa.array(np.concatenate(stream), pa.int64()), pa.array(np.concatenate(place), pa.int64())],
                ["key", "suffix", "stream", "place"],
            )


def _array(batches):
    """Adjacent suffixes in order: words that each shares with a neighbour of another stream, RUN or more."""
    for table in _grouped(batches, 1 << 16, lambda b: b.num_rows):
        key = table.column("key").to_numpy()
        low, high = (table.column(c).to_numpy() for c in ("low", "high"))
        raw = np.frombuffer(b"".join(table.column("suffix").to_pylist()), ">u4").reshape(-1, DEPTH)
        apart = raw[1:] != raw[:-1]
        common = np.where(apart.any(1), apart.argmax(1), DEPTH) * (key[1:] == key[:-1])
        shared = np.maximum(np.r_[0, common], np.r_[common, 0])
        shared[low != high] = DEPTH
        yield pa.RecordBatch.from_arrays([pa.array(key), table.column("suffix").combine_chunks(), pa.array(np.maximum(shared, RUN))], ["key", "suffix", "length"])


def _covered(spans: list | None, n: int) -> np.ndarray:
    """Which of a stream's n words lie under repeated runs."""
    mark = np.zeros(n + 1, np.int64)
    if spans:
        lo = np.array([s["place"] for s in spans])
        _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, lo + np.array([s["length"] for s in spans]))
        np.add.at(mark, lo, 1)
        np.add.at(mark, np.minimum(hi, n), -1)
    return np.cumsum(mark)[:-1] > 0


# --------------------------------------------------------------------------- runs within articles


def _grams(tokens: np.ndarray) -> np.ndarray:
    """For every suffix of ARTICLE_RUN words or more, the least gram of its first ARTICLE_RUN words."""
    if len(tokens) < ARTICLE_RUN:
        return np.zeros(0, np.int64)
    at = np.arange(len(tokens) - GRAM + 1)
    return signed(sliding_min(span_hash(prefix_hash(tokens, WORD_BASE), WORD_BASE, at, at + GRAM), ARTICLE_RUN - GRAM + 1))


def _prefixes(tokens: np.ndarray) -> np.ndarray:
    """Hash of the first ARTICLE_RUN words of every suffix that has as many."""
    at = np.arange(max(0, len(tokens) - ARTICLE_RUN + 1))
    return signed(span_hash(prefix_hash(tokens, WORD_BASE), WORD_BASE, at, at + ARTICLE_RUN))


_SHARED = "host string, gram long, over long, pages long, slack long, stream long"


def _shared(batches):
    """Grams that half of a host's articles hold among those of one task, the articles counted, and their streams; one reading
    of the pages also gives, without host, the runs of RUN words outside articles (as gram) with their streams.

    What half of all articles hold, half of them hold in some task: `over` is what a gram's count exceeds the most that
    it could have without being named (slack), so the sums of `over` and of all slacks bound its count from above.
    """
    known: set[int] = set()
    hosts: dict[str, int] = {}
    keys, owner, streams, size = [], [], [], 0

    def flush():
        names = list(hosts)
        host = np.array(owner, np.int64)
        pages = np.bincount(host, minlength=len(names))
        slack = (pages - 1) // 2
        key, of = np.concatenate(keys), np.repeat(host, [len(k) for k in keys])
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])][: len(key)])
        count = np.diff(np.r_[first, len(key)])
        often = 2 * count >= pages[of[first]]
        first, over = first[often], (count - slack[of[first]])[often]
        name = pa.array(names)
        seen = sorted(set(zip(owner, streams)))
        for rows in (
            [name.take(pa.array(of[first])), pa.array(key[first]), pa.array(over), None, None, None],
            [name, None, None, pa.array(pages), pa.array(slack), None],
            [name.take(pa.array([h for h, _ in seen])), None, None, None, None, pa.array([x for _, x in seen], pa.int64())],
        ):
            yield _batch(rows, len(rows[0]))

    for batch in (whole.slice(a, 512) for whole in batches for a in range(0, whole.num_rows, 512)):
        pages = [blocks(page or "") for page in batch.column(2).to_pylist()]
        found, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for url, (tokens, _) in zip(batch.column(1).to_pylist(), _streams(pages)):
            sid = _id(_host(url), tokens)
            if len(tokens) >= RUN and sid not in known:
                known.add(sid)
                found.append(np.unique(signed(_runs(url, tokens))))
                ids.append(np.full(len(found[-1]), sid))
        yield _batch([None, pa.array(np.concatenate(found)), None, None, None, pa.array(np.concatenate(ids))], sum(map(len, ids)))
        for host, (tokens, _) in zip(batch.column(0).to_pylist(), _streams(pages, article=True)):
            if not len(tokens):
                continue
            keys.append(np.unique(_grams(tokens)))
            owner.append(hosts.setdefault(host, len(hosts)))
            streams.append(_id(host, tokens))
            size += len(keys[-1]) + 1
        if size >= HELD:
            yield from flush()
            hosts, keys, owner, streams, size = {}, [], [], [], 0
    if size:
        yield from flush()


def _batch(columns: list, n: int) -> pa.RecordBatch:
    kinds = [pa.string()] + [pa.int64()] * 5
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c for c, t in zip(columns, kinds)], [c.split()[0] for c in _SHARED.split(", ")])


def _held(batches):
    """Runs of every article that hold a gram which may be one of half of the host's articles."""
    for batch in (whole.slice(a, 512) for whole in batches for a in range(0, whole.num_rows, 512)):
        streams = _streams([blocks(page or "") for page in batch.column(1).to_pylist()], article=True)
        for host, (tokens, _), grams in zip(batch.column(0).to_pylist(), streams, batch.column(2).to_pylist()):
            runs = np.unique(_prefixes(tokens)[np.isin(_grams(tokens), grams)])
            n = len(runs)
            yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array(runs), pa.array(np.full(n, _id(host, tokens)))], ["host", "run", "stream"])


def _frames(rows: DataFrame, found: DataFrame, tables: Tables) -> DataFrame | None:
    """(host, runs): prefixes of the suffixes of articles that half of the host's articles hold; None if there are none."""
    found = found.filter("host IS NOT NULL")
    totals = found.groupBy("host").agg(F.sum("pages").alias("pages"), F.sum("slack").alias("slack"), F.count_distinct("stream").alias("streams"))
    totals = totals.filter(F.col("streams") >= STREAMS)
    bound = found.filter("gram IS NOT NULL").groupBy("host", "gram").agg(F.sum("over").alias("over"))
    may = bound.join(totals, "host").filter(2 * (F.col("over") + F.col("slack")) >= F.col("pages"))
    grams = tables.write(may.groupBy("host").agg(F.collect_list("gram").alias("grams")), "grams")
    if grams.isEmpty():
        return None
    held = rows.select("host", "html").join(broadcast_if_small(grams), "host").select("host", "html", "grams").mapInArrow(_held, "host string, run long, stream long")
    # the suffixes that begin with the same words: articles they stand in, equal ones counted each and once
    counted = held.groupBy("host", "run", "stream").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "run").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("of"))
    half = (2 * F.col("n") >= F.col("pages")) & (2 * F.col("of") >= F.col("streams")) & (F.col("of") >= STREAMS)
    runs = counted.join(totals, "host").filter(half)
    return tables.write(runs.groupBy("host").agg(F.collect_list("run").alias("runs")), "runs")


def _unframed(found: list[tuple[str, bool, bool]], tokens: np.ndarray, of: np.ndarray, runs: list[int]) -> tuple[list[tuple[str, bool, bool]], int]:
    """Blocks without the article's words under the host's runs, and the blocks that had some; an article mostly under them is a copy and stays."""
    at = np.flatnonzero(np.isin(_prefixes(tokens), runs))
    gone = _covered([{"place": p, "length": ARTICLE_RUN} for p in at.tolist()], len(tokens))
    if not gone.any() or 2 * gone.sum() > len(tokens):
        return found, 0
    out = list(found)
    touched = np.unique(of[gone]).tolist()
    for k in touched:
        text, within, off = found[k]
        out[k] = " ".join(w for w, x in zip(text.split(" "), gone[of == k]) if not x), within, off
    return out, len(touched)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated): the main text of every page.

    Blocks of navigation, headers, footers, asides, forms and of marked classes, ids and roles (adverts, notices, menus,
    comments, ...) go. Where a page has an article or main element its text is the rest of that, without the runs of
    ARTICLE_RUN words or more that half of the host's articles hold, and STREAMS different ones (half of the different
    ones, too): suffixes of all articles that begin with the same words are counted. An article with more than half of its
    words under such runs is a copy and stays whole. Elsewhere runs of RUN words or more go which STREAMS different
    streams of the host hold: all pages' words outside articles form the host's token stream, its suffixes are sorted
    and compared with their neighbours. Pages of equal streams are copies and count once. The rest of the runs' blocks
    stays. n_repeated counts the blocks with words under such runs.

    A class, id or role marks a block by a whole name made of marks and neutral words (site-footer, not has-sidebar). Markup
    that is not closed ends with the page.

    Character references are decoded once; white space in a block becomes one space; blocks are joined by \\n. Null html
    is empty, and gives an empty text; a null url is a host of its own name "". Repeated rows stay. Other columns are
    ignored. Empty in, empty out.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "(?s)^(?:.*?://)?([^/]*)", 1))
    hosted = rows.withColumn("host", host)
    tables = Tables(pages.sparkSession)
    shared = tables.write(hosted.select("host", "url", "html").mapInArrow(_shared, _SHARED), "shared")
    frames = _frames(hosted, shared, tables)
    framed = hosted.withColumn("runs", F.lit(None).cast("array<long>")) if frames is None else hosted.join(broadcast_if_small(frames), "host", "left")
    suffixes = rows.select("url", "html").mapInArrow(_suffixes, "key long, suffix binary, stream long, place long")
    # a run counts where enough different streams of the host have it
    outer = shared.filter("host IS NULL").select(F.col("gram").alias("key"), "stream")
    enough = outer.groupBy("key").agg(F.count_distinct("stream").alias("streams")).filter(F.col("streams") >= STREAMS).select("key")
    distinct = suffixes.groupBy("key", "suffix").agg(F.min("stream").alias("low"), F.max("stream").alias("high")).join(enough, "key")
    runs = distinct.repartition("key").sortWithinPartitions("key", "suffix").mapInArrow(_array, "key long, suffix binary, length long")
    spans = (
        suffixes.join(runs, ["key", "suffix"]).groupBy("stream").agg(F.collect_set(F.struct("place", "length")).alias("spans"))
    )

    def parse(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sids, texts, outside, touched = [], [], [], []
                pages = [blocks(page or "") for page in part.column(2).to_pylist()]
                runs = part.column(3).to_pylist()
                inside = _streams(pages, article=True) if any(runs) else [(None, None)] * len(pages)
                for url, found, (tokens, of), (own, place), gone in zip(part.column(1).to_pylist(), pages, _streams(pages), inside, runs):
                    sids.append(_id(_host(url), tokens))
                    found, n = _unframed(found, own, place, gone) if gone else (found, 0)
                    touched.append(n)
                    whole = any(within and not off for _, within, off in found)
                    text = "\n".join(t for t, within, off in found if t and within and not off)
                    # most of what is shuffled, so it travels compressed
                    texts.append(zlib.compress(text.encode("utf-8", "surrogatepass"), 1) if whole else None)
                    # blocks outside the article, with their words: what the runs may cover
                    count = np.bincount(of, minlength=len(found)) if len(of) else np.zeros(len(found), int)
                    outside.append([{"text": "" if whole or off else t, "off": off, "words": int(n)} for (t, within, off), n in zip(found, count) if off or not within])
                kind = pa.list_(pa.struct([("text", pa.string()), ("off", pa.bool_()), ("words", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.binary()), pa.array(outside, kind), pa.array(touched, pa.int64()), pa.array(sids, pa.int64())],
                    ["page_id", "url", "text", "outside", "touched", "stream"],
                )

    def finish(batches):
        for batch in batches:
            texts, repeated = [], []
            for text, outside, spans, touched in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                count = [b["words"] for b in outside]
                parts = np.split(_covered(spans, sum(count)), np.cumsum(count)[:-1])
                if text is not None:
                    text = zlib.decompress(text).decode("utf-8", "surrogatepass")
                else:
                    # a block's words are one space apart
                    left = (" ".join(w for w, gone in zip(b["text"].split(" "), part) if not gone) if part.any() else b["text"] for b, part in zip(outside, parts) if not b["off"])
                    text = "\n".join(t for t in left if t)
                texts.append(text)
                repeated.append(touched + sum(bool(part.any()) for part in parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(repeated, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_repeated"],
            )

    outside = "array<struct<text:string,off:boolean,words:bigint>>"
    parsed = framed.select("page_id", "url", "html", "runs").mapInArrow(parse, f"page_id long, url string, text binary, outside {outside}, touched long, stream long")
    joined = parsed.join(spans, "stream", "left").select("page_id", "url", "text", "outside", "spans", "touched")
    return joined.mapInArrow(finish, "page_id long, url string, text string, n_chars long, n_repeated long")
