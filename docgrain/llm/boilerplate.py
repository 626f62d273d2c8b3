"""Main text of web pages by host suffix arrays (operator 6).

A page is cut into blocks; mark-up says of each whether it is content (in <article> or <main>), layout (menus,
headers, footers, side bars, notices, adverts, forms, comments) or open. The token streams of a host's pages,
all blocks of them, are one text with a mark at each block's end. Its suffixes are put in order by prefix
doubling; neighbours that agree on LONG tokens, or on a whole block, are repeats. A repeat is boilerplate if
it is on two pages at least and on `SHARE` of the host's pages; pages of one and the same stream count as one
page, so a mirrored page makes no repeat of its own text. What boilerplate covers is removed and the unique runs stay.

Mark-up breaks the ties that repeats leave: content that pages share stays (nothing of an article may be lost),
and unique text of layout goes. The unique runs of open blocks are a page's text if it has no article, and
also if they are longer than its article (a teaser beside the story). Two columns tell who decided: tokens removed as
repeats (`n_by_repeats`), and tokens that mark-up alone removed (`n_by_markup`).

A host's pages are dealt by hash into groups of at most PAGES pages and BYTES of html on average, each with an array of
its own, so no task grows with a host; the verdict is the host's and the same for any dealing. A stream that several
groups hold counts in one of them. What is on SHARE of a host's pages is on SHARE of some group's, so each group
names the repeats that are on its share, and their counts are added up over the groups. A group that does not name a repeat has it on
fewer pages than its share; where this leaves the sum open, all groups of the host count that repeat. Between groups a repeat
goes by a 128-bit hash of its tokens. Pages move once, as blocks: the steps read the same exchange.

Defined results: null html is empty and gives an empty text; a null url has the host ''; each row of pages is a
page, so rows that repeat a page_id, and null ids, are each judged and returned; a page of any length is one
item of its group; ties between repeats don't matter, for what any of them covers goes; other columns are
not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import slices, written

#: Tokens of a repeat that is no whole block (a power of two); share of a host's pages; size of a group.
LONG, SHARE, PAGES, BYTES = 32, 0.1, 256, 4_000_000
CONTENT, OPEN, LAYOUT = 0, 1, 2

# Elements and names by their meaning.
MAIN = frozenset(("article", "main"))
NOT_CONTENT = frozenset("nav header footer aside form menu dialog head template svg math iframe object audio video canvas select button noscript".split())
RAW = frozenset(("script", "style", "textarea", "title", "noembed", "noframes", "xmp"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset("nav navbar navigation menu header masthead footer sidebar side aside ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search searchbox form share sharing social comment comments reply replies disqus respond thread discussion related recommended breadcrumb breadcrumbs pagination pager toolbar widget skip copyright".split())
#: The names that set an inline element apart; others (comment, notice) mean something else in running text.
ADVERTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo".split())
#: Words that may stand beside a name in one class; with any other word the class says something else (has-sidebar, side-by-side).
BESIDE = frozenset("site page main top bottom left right global primary secondary inner outer list bar box block section area container wrapper buttons button links link items item posts post articles content text slot unit zone placement wrap holder inline story stories teaser teasers feed".split())
#: Two words that together name other articles of the site, as in more-stories.
FURTHER, TEASERS = frozenset("more popular trending latest next previous also".split()), frozenset("stories articles posts news reads".split())
#: What an article inside is no page's main text: menus, asides, comments, teasers. Other names may be layout around it.
HOLDS_OTHERS = frozenset("nav navbar navigation menu aside comment comments reply replies disqus respond thread discussion related recommended complementary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|/?[a-zA-Z][^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?=[\s=/"']|$)|\bstyle\s*=\s*["']?[^"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
#: A new element of the first kind ends an open one of the second, whose end tag may be missing.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def set_apart(tag: str, attributes: str, in_main: bool) -> int:
    """Does the element hold something other than content? An article's own header is content.

    0 no; 1 yes, but an article inside is content again (a layout around it); 2 yes, articles inside too."""
    if tag in NOT_CONTENT:
        return 0 if tag == "header" and in_main else 1 if tag == "form" else 2
    if attributes and tag not in ("html", "body") and ("hidden" in (low := attributes.lower()) or "display" in low):
        # Values of other attributes say nothing.
        if HIDDEN.search(re.sub(r"""\b(?!style\b)[\w-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)""", " ", attributes)):
            return 2
    if "=" in attributes and tag not in MAIN and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attributes):
            known = ROLES if name.lower() == "role" else ADVERTS if tag in INLINE else NAMES
            named: set[str] = set()
            for token in "".join(values).lower().split():
                words = set(re.split(r"[_-]+", token)) - {""}
                if words & known and words <= known | BESIDE:
                    named |= words & known
                elif known is NAMES and words & FURTHER and words & TEASERS and words <= FURTHER | TEASERS | BESIDE:
                    named.add("related")
            if named:
                return 0 if "header" in named and in_main else 2 if named & HOLDS_OTHERS else 1
    return 0


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, CONTENT, OPEN or LAYOUT) in page order; texts have single spaces and are not empty."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, in main, set apart
    inner: Counter[str] = Counter()
    opened: Counter[str] = Counter()  # of the tags on the stack, so that a stray end tag costs no search

    def close() -> None:
        if text := " ".join(html.unescape("".join(parts)).split()):
            out.append((text, LAYOUT if stack[-1][2] else CONTENT if stack[-1][1] else OPEN))
        parts.clear()

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:  # a comment, a declaration or a broken tag
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            if tag == "textarea" or not stop:
                close()
            continue
        if tag in INLINE:
            # Only one that is set apart is an element here; others of its name inside it are counted, to find its end.
            if tag in VOID:
                continue
            if opened[tag]:
                if not m[1] or inner[tag]:
                    inner[tag] += -1 if m[1] else 1
                    continue
            elif m[1] or m[3].endswith("/") or not set_apart(tag, m[3], stack[-1][1]):
                continue
        close()
        if tag in VOID or m[1] and not opened[tag]:
            continue
        if m[1]:
            while True:
                last = stack.pop()[0]
                opened[last] -= 1
                inner[last] = 0
                if last == tag:
                    break
        elif not m[3].endswith("/") or tag in MAIN or tag in NOT_CONTENT or tag == "div":
            while stack[-1][0] == "p" and tag not in INLINE or stack[-1][0] in ENDS.get(tag, ()):
                opened[stack.pop()[0]] -= 1
            _, main, apart = stack[-1]
            if tag in MAIN and not main and apart < 2:
                apart = 0  # layout around the article; inside of another article it stays
            stack.append((tag, main or tag in MAIN, max(apart, set_apart(tag, m[3], main))))
            opened[tag] += 1
    close()
    return out


class Joined(NamedTuple):
    """The joined text of some pages. A mark of its own number follows each page, so no repeat runs from page to page; a
    common mark (1) follows each block, so a whole block with both its marks is a repeat of any length."""

    stream: np.ndarray
    page_of: np.ndarray  # of each place, the number of its page's stream
    ends: np.ndarray
    words: list[str]  # word i has the number i + 2
    same: list[int]  # of each page, the number of its stream
    first: np.ndarray  # the marks before whole blocks, and after them
    last: np.ndarray
    block: np.ndarray  # of each whole block, its number
    texts: list[str]  # of each number


def joined(pages: list[list[list[str]]]) -> Joined:
    """pages: the tokens of each block of each page."""
    names: dict[str, int] = {}
    parts, owner, block, first, last, same, at = [], [], [], [], [], [], 0
    streams: dict[tuple, int] = {}
    whole: dict[str, int] = {}
    for page in pages:
        same.append(streams.setdefault(tuple(tuple(b) for b in page), len(streams)))
        row = [1]
        for tokens in page:
            first.append(at + len(row) - 1)
            row += [names.setdefault(t, len(names) + 2) for t in tokens] + [1]
            last.append(at + len(row) - 1)
            block.append(whole.setdefault(" ".join(tokens), len(whole)))
        parts.append(np.array([*row, 0], "i8"))
        owner.append(np.full(len(row) + 1, same[-1]))
        at += len(row) + 1
    stream = np.concatenate(parts) if parts else np.zeros(0, "i8")
    ends = np.flatnonzero(stream == 0)
    stream[ends] = len(names) + 2 + np.arange(len(ends))  # each page's own end
    page_of = np.concatenate(owner) if owner else np.zeros(0, "i8")
    return Joined(stream, page_of, ends, list(names), same, np.array(first, "i8"), np.array(last, "i8"), np.array(block, "i8"), list(whole))


def windows(text: Joined, depth: int) -> np.ndarray:
    """Places with `depth` tokens of one page."""
    at = np.arange(max(0, len(text.stream) - depth + 1))
    return at[text.ends[np.searchsorted(text.ends, at)] >= at + depth] if len(at) else at


def hashed(texts: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each text."""
    values = np.array([*texts, ""], object)[:-1]
    return np.stack([hash_array(values, hash_key=key, categorize=False) for key in ("main text, lane0", "main text, lane1")], 1)


def ranks(text: Joined, least: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and suffix ranks by the first `depth` tokens (a power of two), by prefix doubling: equal ranks are neighbours in
    the suffix array that agree so far. Suffixes whose beginning so far is there fewer than `least` times are left out."""
    rank, at, size = text.stream.copy(), np.flatnonzero(text.stream < len(text.words) + 2), 1
    while True:
        at = at[np.bincount(rank[at], minlength=1)[rank[at]] >= least]
        if size == depth or not len(at):
            return at, rank[at]
        alive = np.zeros(len(rank) + size, bool)
        alive[at] = True
        at = at[alive[at + size]]
        pair = rank[at] * (len(text.stream) + len(text.words) + 2) + rank[at + size]
        rank[at] = np.unique(pair, return_inverse=True)[1]
        size *= 2


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the keys of two neighbours, the key of both."""
    keys = a * np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], "u8") + (b ^ (b >> np.uint64(32))) * np.array([0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F], "u8")
    return keys ^ (keys >> np.uint64(29))


def window_keys(text: Joined, at: np.ndarray, depth: int) -> np.ndarray:
    """128 bits of the `depth` tokens and marks from each of the places on, by doubling; equal in any text."""
    named = np.zeros((int(text.stream.max(initial=1)) + 1, 2), "u8")
    named[1] = 1
    named[2 : len(text.words) + 2] = hashed(text.words)
    if len(at) * depth < len(text.stream):
        keys = named[text.stream[at[:, None] + np.arange(depth)]]
        while keys.shape[1] > 1:
            keys = mixed(keys[:, ::2], keys[:, 1::2])
        return keys[:, 0]
    keys, size = named[text.stream], 1
    while size < depth:
        keys[:-size] = mixed(keys[:-size], keys[size:])  # the last ones have no window
        size *= 2
    return keys[at]


def tally(text: Joined, depth: int = LONG, own: np.ndarray | None = None, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the repeats (windows and whole blocks) that are on `least` distinct pages of those that count, and on how many."""
    own = np.ones(len(text.same), bool) if own is None else own  # by number of stream

    def often(groups: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = own[text.page_of[at]]
        pair = np.unique(groups[counts] * (len(own) + 1) + text.page_of[at][counts])
        found = np.bincount(pair // (len(own) + 1), minlength=int(groups.max(initial=-1)) + 1)
        one = np.flatnonzero(found >= least)
        return one, found[one]

    at, groups = ranks(text, least, depth)
    one, pages = often(groups, at)
    place = np.zeros(int(groups.max(initial=-1)) + 1, "i8")
    place[groups] = at
    whole, of_whole = often(text.block, text.first)
    return np.concatenate([window_keys(text, place[one], depth), hashed(text.texts)[whole]]), np.concatenate([pages, of_whole])


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the keys are known."""
    out = np.zeros(len(keys), bool)
    if len(known) and len(keys):
        lane = np.unique(known[:, 0])
        at = np.flatnonzero(lane[np.minimum(np.searchsorted(lane, keys[:, 0]), len(lane) - 1)] == keys[:, 0])
        whole = {k.tobytes() for k in known}
        bits = keys[at].tobytes()
        out[at] = [bits[i : i + 16] in whole for i in range(0, len(bits), 16)]
    return out


def held(text: Joined, known: np.ndarray, own: np.ndarray, depth: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Of the known keys those in the text, and on how many distinct pages of those that count."""
    at = windows(text, depth)
    keys, places = np.concatenate([window_keys(text, at, depth), hashed(text.texts)[text.block]]), np.concatenate([at, text.first])
    hit = among(keys, known)
    hit[hit] = own[text.page_of[places[hit]]]
    found = np.concatenate([keys[hit], text.page_of[places[hit]].astype("u8")[:, None]], 1)
    return np.unique(np.unique(found, axis=0)[:, :2], axis=0, return_counts=True)


def covered(text: Joined, known: np.ndarray, depth: int = LONG) -> list[np.ndarray]:
    """For each page, which tokens the known repeats cover."""
    n = len(text.stream)
    steps = np.zeros(n + 1, "i8")
    if len(known) and n:
        at = windows(text, depth)
        at = at[among(window_keys(text, at, depth), known)]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + depth, -1)
        hit = among(hashed(text.texts), known)[text.block]
        np.add.at(steps, text.first[hit], 1)
        np.add.at(steps, text.last[hit], -1)
    gone = np.cumsum(steps)[:n] > 0
    token = (text.stream != 1) & (text.stream < len(text.words) + 2)
    bounds = np.concatenate([[0], text.ends + 1])
    return [gone[a:b][token[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def repeats(pages: list[list[list[str]]], share: float = SHARE, depth: int = LONG) -> list[np.ndarray]:
    """pages of one array: the tokens of each block of each page -> for each page, which tokens boilerplate covers."""
    text = joined(pages)
    return covered(text, tally(text, depth, least=max(2, shared(len(set(text.same)), share)))[0], depth)


def shared(pages: int, share: float = SHARE) -> int:
    """The least number of pages that is their share."""
    return int(np.ceil(share * pages - 1e-9))


def decided(page: list[tuple[list[str], int]], covered: np.ndarray) -> tuple[str, int, int]:
    """page: (tokens, state) of each block -> text, tokens removed as repeats, tokens that mark-up removed."""
    at, runs, by_repeats = 0, [], 0
    for tokens, state in page:
        gone = covered[at : at + len(tokens)]
        at += len(tokens)
        if state != CONTENT and gone.any():
            by_repeats += int(gone.sum())
            tokens = [t for t, g in zip(tokens, gone, strict=True) if not g]
        runs.append((state, tokens))
    size = [sum(len(t) for s, t in runs if s == state) for state in (CONTENT, OPEN)]
    wanted = (CONTENT, OPEN) if size[1] > size[0] else (CONTENT,)
    text = " ".join(" ".join(t) for s, t in runs if t and s in wanted)
    return text, by_repeats, sum(len(t) for s, t in runs if s not in wanted)


def main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars, n_by_repeats, n_by_markup; one row for each row."""
    of = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    named = pages.select("page_id", "url", "html", host.alias("host"))
    # Hosts of more than one group: a table of at most one row for PAGES pages or BYTES of html.
    groups = F.greatest(F.ceil(F.count("*") / PAGES), F.ceil(F.sum(F.length("html")) / BYTES)).cast("int")
    large = written(named.groupBy("host").agg(groups.alias("groups")).where("groups > 1"), "boilerplate-hosts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [blocks(source or "") for source in batch.column("html").to_pylist()]
            texts, states = pa.array([[t for t, _ in b] for b in found], pa.list_(pa.string())), pa.array([[s for _, s in b] for b in found], pa.list_(pa.int8()))
            keys = pa.array([blake2b("\n".join(t for t, _ in b).encode(), digest_size=16).digest() for b in found], pa.binary())
            yield pa.record_batch([*(batch.column(c) for c in kept), texts, states, keys], names=[*kept, "texts", "states", "key"])

    kept = ("page_id", "url", "host", "deal")
    dealt = named.withColumn("deal", F.xxhash64("page_id", "url", F.length("html")))
    cut = dealt.mapInArrow(read, f"page_id {of}, url string, host string, deal long, texts array<string>, states array<tinyint>, key binary")
    cut = cut.join(large, "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("g", F.pmod("deal", "groups").cast("int")).drop("deal")
    # Each step takes all columns, so that the exchange is one and the same.
    group = cut.groupBy("host", "g")

    def tokens(table: pa.Table) -> list[list[list[str]]]:
        return [[t.split() for t in texts] for texts in table.column("texts").to_pylist()]

    def own(table: pa.Table, text: Joined, elsewhere: set[bytes]) -> np.ndarray:
        """Of each stream: does it count here?"""
        out = np.zeros(len(set(text.same)), bool)
        out[text.same] = [k not in elsewhere for k in table.column("key").to_pylist()]
        return out

    def bits(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), "u8").reshape(-1, 2)

    def rows(table: pa.Table, schema: pa.Schema, keys: np.ndarray, *columns) -> pa.Table:
        ends = [[table.column(c)[0].as_py()] * len(keys) for c in ("host", "g")]
        return pa.table([*ends, [k.tobytes() for k in keys], *columns], schema=schema)

    base = [("host", pa.string()), ("g", pa.int32()), ("key", pa.binary())]
    of_repeat, of_count = [*base, ("n", pa.int64()), ("short", pa.int64()), ("total", pa.int32())], [*base, ("n", pa.int64()), ("least", pa.int64()), ("last_g", pa.int32())]
    of_stream, of_repeat, of_count = pa.schema(base), pa.schema(of_repeat), pa.schema(of_count)

    def streams(table: pa.Table) -> pa.Table:
        """The streams of a group that has others beside it."""
        keys = sorted(set(table.column("key").to_pylist())) if table.column("groups")[0].as_py() > 1 else []
        return rows(table, of_stream, bits(keys))

    def counted(table: pa.Table, elsewhere: pa.Table) -> pa.Table:
        """The repeats on a share of the group's pages; n: pages; short: on how many pages others may be. Last, the group itself."""
        if not table.num_rows:
            return of_repeat.empty_table()
        text = joined(tokens(table))
        counts = own(table, text, set(elsewhere.column("key").to_pylist()))
        size, alone = int(counts.sum()), table.column("groups")[0].as_py() == 1
        least = max(2 if alone else 1, shared(size))
        keys, n = tally(text, LONG, counts, least) if size else (bits([]), np.zeros(0, "i8"))
        short = least - 1 if size else 0
        found = rows(table, of_repeat, keys, n, [short] * len(n), [0] * len(n))
        whole = pa.table([[table.column("host")[0].as_py()], [table.column("g")[0].as_py()], [None], [size], [short], [1]], schema=of_repeat)
        return pa.concat_tables([found, whole])

    def recounted(table: pa.Table, asked: pa.Table) -> pa.Table:
        """The pages of the open repeats; the settled ones as they are (n). Rows without `least` are streams that count elsewhere."""
        given = asked.to_pylist()
        settled = [(r["host"], r["g"], r["key"], r["n"], r["least"], r["last_g"]) for r in given if r["n"] is not None]
        made = [pa.table([list(c) for c in zip(*settled, strict=True)], schema=of_count)] if settled else []
        unsure = {r["key"]: r for r in given if r["n"] is None and r["least"] is not None}
        if table.num_rows and unsure:
            text = joined(tokens(table))
            keys, n = held(text, bits(list(unsure)), own(table, text, {r["key"] for r in given if r["least"] is None}))
            like = [unsure[k.tobytes()] for k in keys]
            made.append(rows(table, of_count, keys, n, [r["least"] for r in like], [r["last_g"] for r in like]))
        return pa.concat_tables([of_count.empty_table(), *made])

    def judged(table: pa.Table, known: pa.Table) -> pa.Table:
        streams = tokens(table)
        gone = covered(joined(streams), bits(known.column("key").to_pylist()))
        states = table.column("states").to_pylist()
        found = [decided(list(zip(page, s, strict=True)), g) for page, s, g in zip(streams, states, gone, strict=True)]
        made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        return pa.table([table.column("page_id"), table.column("url"), *made], names=["page_id", "url", "text", "n_by_repeats", "n_by_markup"])

    # A stream of several groups counts in the first of them.
    elsewhere = group.applyInArrow(streams, "host string, g int, key binary").groupBy("host", "key").agg(F.array_sort(F.collect_set("g")).alias("all"))
    elsewhere = elsewhere.where(F.size("all") > 1).select("host", F.explode(F.slice("all", 2, F.size("all"))).alias("g"), "key")
    found = group.cogroup(elsewhere.groupBy("host", "g")).applyInArrow(counted, "host string, g int, key binary, n long, short long, total int")
    # Rows of the host (total) and of its repeats are told apart after the sums and take all of them, so that both read one exchange.
    found = found.groupBy("host", "key").agg(F.sum("n").alias("n"), F.sum("short").alias("short"), F.max("total").alias("total"), F.max("g").alias("last"))
    least = F.greatest(F.lit(2), F.ceil(F.lit(SHARE) * F.col("n") - 1e-9)).cast("long")
    hosts = found.where("total = 1").select("host", least.alias("least"), F.col("short").alias("all_short"), F.col("last").alias("last_g"))
    found = found.where("total = 0").join(hosts, "host").where("n + all_short - short >= least")
    # A settled repeat goes to one group, an open one to all.
    settled = F.col("n") >= F.col("least")
    each = F.explode(F.sequence(F.when(settled, F.col("last")).otherwise(0), F.when(settled, F.col("last")).otherwise(F.col("last_g")))).alias("g")
    asked = found.select("host", each, "key", F.when(settled, F.col("n")).alias("n"), "least", "last_g").unionByName(elsewhere, allowMissingColumns=True)
    counts = group.cogroup(asked.groupBy("host", "g")).applyInArrow(recounted, "host string, g int, key binary, n long, least long, last_g int")
    known = counts.groupBy("host", "key").agg(F.sum("n").alias("n"), F.max("least").alias("least"), F.max("last_g").alias("last_g")).where("n >= least")
    known = known.select("host", F.explode(F.sequence(F.lit(0), "last_g")).alias("g"), "key")
    out = group.cogroup(known.groupBy("host", "g")).applyInArrow(judged, f"page_id {of}, url string, text string, n_by_repeats long, n_by_markup long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_by_repeats", "n_by_markup")
