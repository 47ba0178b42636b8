"""Main text of web pages: host suffix arrays over all blocks of all pages, with markup zones as evidence.

A page's blocks are marked (menus, headers, footers, sidebars, notices, adverts, forms, reader comments: gone), sure (in a text element
inside an article or main element) or undecided: straight in some container of the article, or anywhere in a page that marks no main text.
Every page's blocks are joined to token streams with a mark after each stream, of which suffix arrays are built. Runs of at least RUN tokens are
counted by the distinct pages of their host that they occur on; the counts of all arrays are united, so how pages are dealt out changes nothing.
Runs that stand in undecided or marked blocks on LEAST_PAGES pages or more are boilerplate: undecided tokens that they cover go. Sure tokens go if a run
covers them that is on so many pages in marked blocks (or outside of the main text) and in the sure blocks of at least half of the host's pages; what
fewer articles share stays, even if adverts quote it. The unique runs stay. Pages that are copies of each other count as one. Where a page marks a main text, what stands outside of that goes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textops as T
from quarry.llm.frames import Tables

RUN = 8
#: Distinct pages of a host that a run must occur on to be boilerplate.
LEAST_PAGES = 3
#: Characters that one suffix array holds, about.
_STREAM_BYTES = 2 << 20
#: Contents that a task remembers, so as to look at copies once.
_SEEN = 1 << 17
#: Pages that are Python objects at once.
_ROWS = 256

# Elements and words of class, id and role that mark zones.
_OUT = frozenset("nav footer aside form menu dialog button select option datalist label fieldset".split())
_SKIPPED = frozenset("script style noscript template textarea title svg iframe canvas object math audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("html head body div section article main header footer nav aside form ul ol dl table tbody thead tfoot tr blockquote figure details dialog menu fieldset button select center hgroup address".split())
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th figcaption caption summary option legend label".split())
_BLOCKS = _CONTAINERS | _TEXTS | frozenset("br hr optgroup".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of their kind (or of a kind named with it) in the same parent.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
_PARENTS = frozenset("ul ol dl menu table select".split())
#: Words that mark an element as boilerplate wherever they stand, and words that a name of main content on the same element outweighs.
_HARD = frozenset("nav navbar navigation menu masthead footer sidebar ad ads advert adverts advertisement advertisements adsense banner cookie cookies consent gdpr popup modal newsletter breadcrumb breadcrumbs pagination pager comment comments disqus reply replies login signup".split())
_SOFT = frozenset("header notice notices overlay subscribe subscription promo promotion sponsor sponsored share sharing social related recommended search widget toolbar skip".split())
#: Names of main content; words that say nothing beside others.
_CONTENT = frozenset("article content body text post story entry main".split())
_PLAIN = frozenset("box wrapper wrap container block section list item items bar area panel inner outer top bottom left right site page buttons button links link posts articles unit slot module region row col group form global thread author area zone holder info icons icon title heading".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MAIN = frozenset(("article", "main"))

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Kinds of blocks: SURE ones stay, LOOSE ones stand straight in a container of the main text, OPEN ones outside of any.
SURE, LOOSE, OPEN = 0, 1, 2
#: Where a run stands.
UNDECIDED, MARKED, BESIDE = 0, 1, 2


def _named_out(names: str, inner: bool) -> bool:
    """Whether class and id name boilerplate. A name counts if all its words are marks, names of content or plain; `site-header` does, `social-history` doesn't."""
    content = soft = False
    for name in names.split():
        words = {w for w in re.split(r"[^a-z]+", name) if len(w) > 1}
        known = words <= _HARD | _SOFT | _CONTENT | _PLAIN
        if known and words & _HARD:
            return True
        if known and words & _SOFT:
            # an article's own header holds its headline
            soft |= not ("header" in words and (inner or words & _CONTENT))
        elif known and words & _CONTENT:
            content = True
    return soft and not content


def _zone(name: str, rest: str, inner: bool) -> str:
    """out, main or nothing, for an element inside or outside of a main text."""
    if name in ("html", "head", "body"):
        return ""
    if name in _OUT:
        return "out"
    given = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(rest)} if rest.strip() else {}
    role = given.get("role", "")
    if role in _ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return "out"
    if given and _named_out(f"{given.get('class', '')} {given.get('id', '')}", inner):
        return "out"
    if name in _MAIN or role in _MAIN or given.get("itemprop") == "articlebody":
        return "main"
    return "out" if name == "header" and not inner else ""


def blocks(page: str) -> tuple[list[str], list[int]]:
    """The blocks that aren't outside, in page order, with character references decoded and white space collapsed, and the kind of each."""
    return zones(page)[:2]


def zones(page: str) -> tuple[list[str], list[int], list[str]]:
    """As blocks(), and the marked blocks: those outside."""
    found: list[str] = []
    kinds: list[int] = []
    marked: list[str] = []
    held: list[str] = []
    dropped: list[str] = []
    stack: list[tuple[str, str]] = []
    out = inner = texts = 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                found.append(text)
                kinds.append((SURE if texts else LOOSE) if inner else OPEN)
        if dropped:
            text = " ".join(html.unescape("".join(dropped)).split())
            dropped.clear()
            if text:
                marked.append(text)

    def pop() -> str:
        nonlocal out, inner, texts
        name, zone = stack.pop()
        out -= zone == "out"
        inner -= zone == "main"
        texts -= name in _TEXTS
        return name

    def close(names: tuple[str, ...], within: frozenset[str]) -> None:
        """End the innermost open element of those names, unless an element of `within` lies between."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in within:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            (dropped if out else held).append(page[at:])
            break
        if m.start() > at:
            (dropped if out else held).append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                (dropped if out else held).append(html.escape(m[0][9:-3]))
            continue
        ends = bool(m["end"] or m["end2"])
        if name in _SKIPPED:
            if not ends:
                shut = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = shut.end() if shut else n
            continue
        block = name in _BLOCKS
        if block:
            flush()
        if name in _VOID:
            continue
        if ends:
            # an inline end tag ends no block around it
            close((name,), frozenset() if block else _BLOCKS)
            continue
        rest = m["rest"] or m["rest2"] or ""
        if rest.endswith("/"):
            continue
        if block:
            close(("p",), _CONTAINERS | _TEXTS - {"p"})
            if name in _ENDS:
                close(_ENDS[name], _PARENTS)
            elif name in _HEADINGS:
                close(tuple(_HEADINGS), _CONTAINERS | _TEXTS - _HEADINGS)
        zone = _zone(name, rest, inner > 0)
        if block or zone == "out":  # other inline elements leave no trace
            stack.append((name, zone))
            out += zone == "out"
            inner += zone == "main"
            texts += name in _TEXTS
    flush()
    return found, kinds, marked


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and longest common prefixes of neighbours (lcp[i]: of suffixes i - 1 and i), by prefix doubling.

    With `depth`, suffixes are told apart by that many tokens at least and perhaps no more, which is all that runs of that length need.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1 and step < min(n, depth or n):
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = new
        levels.append(rank)
        step *= 2
    lcp = np.zeros(n, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        held = (left < n) & (right < n)
        same = np.zeros(len(left), bool)
        # ranks of level k tell apart 2**k tokens; a suffix that ends before has a rank of its own
        whole = held & (left + (1 << k) <= n) & (right + (1 << k) <= n)
        same[whole] = levels[k][left[whole]] == levels[k][right[whole]]
        shared[same] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
    lcp[1:] = shared
    return order, lcp


def _grouped(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of `run` tokens of some texts, by their suffix array: the hash of each distinct run; for every run its number there and its text."""
    words = T.Units(*T.utf8(pa.array(texts, pa.string())), T.SPACE_WORDS)
    hashes = words.hashes()
    # a mark after each text that no other has, so that no run crosses texts
    place = np.arange(len(words)) + words.row
    marks = words.base[1:] + np.arange(words.rows)
    stream, owner = np.zeros(len(words) + words.rows, np.int64), np.zeros(len(words) + words.rows, np.int64)
    _, number = np.unique(hashes, return_inverse=True)
    stream[place], owner[place] = number, words.row
    stream[marks], owner[marks] = -1 - np.arange(words.rows), np.arange(words.rows)
    order, lcp = suffix_array(stream, run)
    name = np.zeros(len(stream), np.uint64)
    whole = np.zeros(len(stream), bool)
    key, at = T.windows(hashes, words.base, run)
    name[place[at]], whole[place[at]] = key, True
    group = np.cumsum(lcp < run)[whole[order]]
    order = order[whole[order]]
    first = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
    return name[order[first]], np.cumsum(first) - 1, owner[order]


def repeated_runs(blocks: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of `run` tokens of some pages: the hash of each, and the number of pages that it is on."""
    name, group, page = _grouped([" ".join(x) for x in blocks], run)
    pairs = np.unique(np.stack([group, page], 1), axis=0)
    return name, np.bincount(pairs[:, 0], minlength=len(name))


def unique_runs(blocks: list[str], kinds: list[int], covered: np.ndarray, sure: np.ndarray) -> str:
    """A page's text without the covered tokens of undecided and of sure blocks; what stands outside of a main text goes if there is any."""
    main, at, out = any(x != OPEN for x in kinds), [0, 0], []
    for text, kind in zip(blocks, kinds, strict=True):
        words, of = text.split(" "), int(kind == SURE)
        own = (covered, sure)[of][at[of] : at[of] + len(words)]
        at[of] += len(words)
        if not (main and kind == OPEN):
            out.append(" ".join(w for w, gone in zip(words, own.tolist(), strict=True) if not gone) if own.any() else text)
    return "\n".join(x for x in out if x)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's blocks, their kinds and its marked blocks."""
    for batch in T.chunks(batches, "html"):
        held, kinds, marked = zip(*(zones(page.as_py() or "") for page in batch.column("html")), strict=True)
        columns = [pa.array(held, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32())), pa.array(marked, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), *columns], ["page_id", "url", "host", "blocks", "kinds", "marked"])


def _streams(batch: pa.RecordBatch) -> tuple[list[str], list[str]]:
    """Of each page, its undecided and its sure tokens. Where all of the main text is sure, what stands outside of that goes, too, and is not undecided."""
    pages = list(zip(batch.column("blocks").to_pylist(), batch.column("kinds").to_pylist(), strict=True))
    undecided = [" ".join(x for x, k in zip(held, kinds, strict=True) if k != SURE) if LOOSE in kinds or SURE not in kinds else "" for held, kinds in pages]
    return undecided, [" ".join(x for x, k in zip(held, kinds, strict=True) if k == SURE) for held, kinds in pages]


def _beside(batch: pa.RecordBatch) -> list[str]:
    """Of each page, the tokens outside of a main text that is all sure."""
    pages = zip(batch.column("blocks").to_pylist(), batch.column("kinds").to_pylist(), strict=True)
    return [" ".join(x for x, k in zip(held, kinds, strict=True) if k == OPEN) if SURE in kinds and LOOSE not in kinds else "" for held, kinds in pages]


def _in(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether a run may be among those of a bitmap: others than those are, too, by chance."""
    return bits[name >> np.uint64(44)] >> (name & np.uint64(63)) & np.uint64(1) != 0


def _runs(run: int, sure: bool, most: int | None = None, bits: Broadcast | None = None):
    """By suffix arrays of bounded size, each run of a host with distinct pages that have it, `most` of an array, and where: sure, or else in UNDECIDED or MARKED blocks or BESIDE the main text."""

    def of(texts: list[str], host: list[str], content: list[int], zone: list[int]) -> pa.RecordBatch:
        name, group, text = _grouped(texts, run)
        if bits is not None:
            on = _in(bits.value, name)[group]
            group, text = group[on], text[on]
        hosts, number = np.unique(np.array(host, object), return_inverse=True)
        met = np.unique(np.stack([group, number[text], np.array(zone, np.int64)[text], np.array(content, np.int64)[text]], 1), axis=0)
        first = np.flatnonzero(np.append(True, (met[1:, :3] != met[:-1, :3]).any(1))[: len(met)])
        place = np.arange(len(met)) - np.repeat(first, np.diff(np.append(first, len(met))))
        met = met[place < (most or len(met))]
        return pa.RecordBatch.from_arrays([pa.array(hosts[met[:, 1]], pa.string()), pa.array(name[met[:, 0]].view(np.int64)), pa.array(met[:, 3]), pa.array(met[:, 2].astype(np.int32))], ["host", "run", "content", "zone"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            streams = [(UNDECIDED, _streams(batch)[sure])]
            if not sure:
                streams += [(MARKED, [" ".join(x) for x in batch.column("marked").to_pylist()]), (BESIDE, _beside(batch))]
            keys = list(zip(batch.column("host").to_pylist(), batch.column("content").to_pylist(), strict=True))
            for zone, texts in streams:
                for (host, content), text in zip(keys, texts, strict=True):
                    if not text:
                        continue
                    if held and size > _STREAM_BYTES:
                        yield of(*map(list, zip(*held, strict=True)))
                        held, size = [], 0
                    held.append((text, host, content, zone))
                    size += len(text)
        if held:
            yield of(*map(list, zip(*held, strict=True)))

    return runs


def _windows(batch: pa.RecordBatch, run: int, bits: tuple[Broadcast, Broadcast]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For undecided and for sure tokens: the runs that may be boilerplate, their page in the batch, and where in its stream they begin."""
    out = []
    for texts, own in zip(_streams(batch), bits, strict=True):
        if not own.value.any():
            texts = [""] * len(texts)
        words = T.Units(*T.utf8(pa.array(texts, pa.string())), T.SPACE_WORDS)
        key, at = T.windows(words.hashes(), words.base, run)
        on = _in(own.value, key)
        row = words.row[at[on]]
        out.append((key[on], row, at[on] - words.base[row]))
    return out


def _places(run: int, bits: tuple[Broadcast, Broadcast]):
    """Each page's runs that may be boilerplate, whether they stand in its sure tokens, and where they begin. Copies may give theirs once or more."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = list(zip(batch.column("host").to_pylist(), batch.column("content").to_pylist(), strict=True))
            new = [x not in seen and not seen.add(x) for x in keys]
            if len(seen) > _SEEN:
                seen.clear()
            batch = batch.filter(pa.array(new, pa.bool_()))
            for k, (key, row, at) in enumerate(_windows(batch, run, bits)):
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("host").take(own), batch.column("content").take(own), pa.array(key.view(np.int64)), pa.array([k == 1] * len(row), pa.bool_()), pa.array(at.astype(np.int32))], ["host", "content", "run", "sure", "at"])

    return places


def _parted(batch: pa.RecordBatch, opened: Broadcast | None, on: bool) -> pa.RecordBatch:
    """The pages that may have tokens to clear, by a bitmap of contents, or the others."""
    if opened is None:
        return batch
    return batch.filter(pa.array(_in(opened.value, np.asarray(batch.column("content")).view(np.uint64)) == on))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Who reads the result may ask for large batches; as Python objects pages take several times their bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _whole(opened: Broadcast | None):
    """The text of each page that has nothing to clear."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, bool)
        for batch in _few(batches):
            batch = _parted(batch, opened, False)
            pages = zip(batch.column("blocks").to_pylist(), batch.column("kinds").to_pylist(), strict=True)
            text = [unique_runs(held, kinds, none, none) for held, kinds in pages]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return whole


def _left(opened: Broadcast):
    """The pages that may have tokens to clear."""

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _parted(batch, opened, True)

    return left


def _cleared(run: int):
    """The text of each page without the runs that begin at its places."""

    def cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out = []
            for held, kinds, *begins in zip(*(batch.column(c).to_pylist() for c in ("blocks", "kinds", "at", "sure_at")), strict=True):
                covered = []
                for at in begins:
                    gone = np.zeros(sum(x.count(" ") + 1 for x in held) + run, bool)
                    for k in range(run):
                        gone[np.array(at or [], np.int64) + k] = True
                    covered.append(gone)
                out.append(unique_runs(held, kinds, *covered))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return cleared


def _bitmap(runs: DataFrame) -> Broadcast:
    """A bit for each run in 8 MB: joins stay exact, this only spares most rows the journey to them."""
    bits = np.zeros(1 << 20, np.uint64)
    held = runs.select(F.shiftrightunsigned("run", 44).alias("at"), F.expr("shiftleft(1L, cast(run & 63 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()  # at most 2**20 rows
    bits[held["at"].to_numpy(np.int64)] = held["bit"].to_numpy(np.int64).view(np.uint64)
    return runs.sparkSession.sparkContext.broadcast(bits)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, least: int = LEAST_PAGES) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by a line feed, empty if none), n_chars (code points).

    br and hr end a block like block elements. Null and empty html give an empty text, and so does a page of boilerplate alone; pages with a null or
    odd url are taken as one host. A page is parsed whole, however long. Repeated rows give a row each and count as one page in what
    repeats on a host. An empty table gives no rows; other columns aren't read. The parsed pages and the places to clear lie in the shared
    folder; the returned rows are made from them as they are read, so no text is stored twice.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    page, at_run, found = ["host", "content"], ["host", "run"], "host string, run long, content long, zone int"
    # an array gives `least` pages of a run and zone at most
    many = lambda on: F.size(F.collect_set(F.when(on, F.col("content")))) >= least
    with Tables(pages.sparkSession) as tables:
        parsed = tables.write(rows.mapInArrow(_parsed, "page_id long, url string, host string, blocks array<string>, kinds array<int>, marked array<string>").withColumn("content", F.xxhash64("blocks", "kinds")))
        outside = parsed.select(*page, "blocks", "kinds", "marked").mapInArrow(_runs(run, False, least), found).groupBy(*at_run)
        outside = tables.write(outside.agg(many(F.col("zone") != BESIDE).alias("undecided"), many(F.col("zone") != UNDECIDED).alias("marked")).where("undecided OR marked"))
        marked = outside.where("marked").select(*at_run)
        inside = parsed.select(*page, "blocks", "kinds").mapInArrow(_runs(run, True, bits=_bitmap(marked)), found)
        inside = inside.join(marked, at_run, "left_semi").groupBy(*at_run).agg(F.countDistinct("content").alias("n")).where(F.col("n") >= least)
        inside = inside.join(parsed.groupBy("host").agg(F.countDistinct("content").alias("of")), "host").where("2 * n >= of")
        gone = outside.where("undecided").select(*at_run, F.lit(False).alias("sure")).unionByName(inside.select(*at_run, F.lit(True).alias("sure")))
        gone = tables.write(gone)
        bits = _bitmap(gone.where("NOT sure")), _bitmap(gone.where("sure"))
        covered = parsed.select(*page, "blocks", "kinds").mapInArrow(_places(run, bits), "host string, content long, run long, sure boolean, at int").join(gone, [*at_run, "sure"], "left_semi")
        covered = covered.groupBy(*page).agg(*(F.collect_set(F.when(F.col("sure") == of, F.col("at"))).alias(name) for of, name in ((False, "at"), (True, "sure_at"))))
        covered = tables.write(covered)
        opened = None if covered.isEmpty() else _bitmap(covered.select(F.col("content").alias("run")))
        tables.keep(parsed)
        if opened is not None:
            tables.keep(covered)
    made, named = parsed.select("page_id", "url", *page, "blocks", "kinds"), "page_id long, url string, text string"
    out = made.mapInArrow(_whole(opened), named)
    if opened is not None:
        left = made.mapInArrow(_left(opened), made.schema).join(covered, page, "left")
        out = out.unionByName(left.mapInArrow(_cleared(run), named))
    return out.withColumn("n_chars", F.length("text").cast("long"))
