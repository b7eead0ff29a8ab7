"""Main text of web pages by differencing each page with those nearest to it by URL.

1. A page is read into blocks: runs of text between block-level tags, with character references decoded and white space
   folded. Blocks in elements that are no main text by their name, role, class or id (menus, headers, footers, sidebars,
   notices, adverts, forms, reader comments, scripts, styles) go, but not one that holds the main element, all articles or
   most of the text. Blocks in an article (or in the main element, if articles are the lesser part of it) are the page's own.
2. Pages of a host with the same lines are one, and pages are ordered by host and URL path, by a distributed sort that
   numbers them, so a host with a third of all pages is cut like any other. Each meets the hashes of the lines of the
   ``NEAR`` pages before and behind it on its host, all of which have another text.
3. A page's lines are aligned with those of each of these by longest common subsequence, and lines that several of them
   share are deleted (``template``). Pages that share more than half of the text may be near copies, which tell nothing
   about a template; how they share it decides. In text that a page marks as its article a line goes only if it stands on
   nearly all pages around, which have to be ``MANY`` different texts at least: a passage that some articles of a host
   share is theirs.

The element rules come first since differencing alone fails on pages whose menus and adverts differ from page to page.
Where a page marks its article, what is outside goes, and what is inside meets the neighbours like any other text.

Defined results: a null or empty page has an empty text; a null URL is a host of its own; rows that repeat a page are
copies; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.llm.common import packed, read, unpacked, written

#: Element names, roles and words in class or id (fixed values).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED_TAGS = frozenset("head nav footer aside form button select option svg math template dialog menu object canvas audio video map label fieldset".split())
DROPPED_ROLES = frozenset("navigation contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies share sharing social related recommended widget pagination pager toolbar skip".split()
)
HEADER_WORDS = frozenset("header masthead banner topbar".split())
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
#: Words that may stand beside those in one name ('ad-slot', 'site-footer'); with any other ('has-sidebar') the name says something else.
BESIDE = frozenset(
    "area article articles bar block bottom box button buttons container desktop entry form global group icon icons id inline inner item items left link links list local main mobile module outer page panel post posts primary right secondary section site slot sub text top unit wrap wrapper".split()
)
#: Elements that may wrap a whole page for other reasons.
WRAPPER_TAGS = frozenset("form fieldset header".split())
#: A block with more than this share of its text in links is a menu where a page marks no article.
LINKS = 0.8
#: An element with more than this share of a page's text outside links is its wrapper, whatever it is called.
WRAPS = 0.8
#: Pages that share more than this of a text may be copies of it.
COPIES = 0.5
#: In a marked article a line goes if so many neighbours of different texts have it, and this share of all that differ.
MANY, NEARLY_ALL = 4, 0.75
#: A page with less than this share of its text to itself is a copy with a changed line.
OWN = 0.1
#: How many pages before and behind each it meets, and how many rows of their order make a block of work.
NEAR, BLOCK = 4, 1024
#: Bits of an alignment that are held at once.
AT_ONCE_BITS = 1 << 27
#: A quote that nothing closes takes the rest of the page with it, as in HTML; so no place is read twice.
TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*+(?:"|$)|'[^']*+(?:'|$)|[^>"'])*+)(?:>|$)|<[!?/][^>]*(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
PLAIN, ARTICLE, MAIN = 0, 1, 2  # an article in a main element is both
STAYS, GOES, GOES_UNLESS_WRAPPER = 0, 1, 2


def named(names: str, words: frozenset) -> bool:
    """Whether one of the names of a class or id is one of ``words``, or made of one and of words that may stand beside it."""
    for name in names.split():
        parts = set(re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", name)) - {""}
        if parts & words and all(x in DROPPED_WORDS or x in HEADER_WORDS or x in BESIDE or x[0].isdigit() for x in parts):
            return True
    return False


def dropped(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is no main text by itself, or is none unless it turns out to hold the page's main text."""
    if tag in DROPPED_TAGS or (tag == "header" and not in_article):
        return GOES_UNLESS_WRAPPER if tag in WRAPPER_TAGS else GOES
    if not attributes or tag in ("html", "body", "article", "main"):
        return STAYS
    if re.search(r"\shidden(?=[\s=/]|$)", attributes):
        return GOES
    found = STAYS
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if (name == "style" and re.search(r"display\s*:\s*none", value)) or (name == "aria-hidden" and value == "true"):
            return GOES
        if name == "role" and (value in DROPPED_ROLES or (value == "banner" and not in_article)):
            found = GOES_UNLESS_WRAPPER
        if name in ("class", "id"):
            if named(value, COMMENT_WORDS):
                return GOES
            if named(value, DROPPED_WORDS) or (not in_article and named(value, HEADER_WORDS)):
                found = GOES_UNLESS_WRAPPER
    return found


def wrappers(found: list[tuple[str, int, float, int]], drops: list[tuple[int, int]]) -> set[int]:
    """Those of ``drops`` (place of the one around it, zone around it) that hold the page's main text."""
    out: set[int] = set()

    def add(i: int) -> None:
        while i >= 0 and i not in out:
            out.add(i)
            i = drops[i][0]

    def staying() -> list[bool]:
        """Whether each of ``drops`` stays, as those around it do; the last value is that of no such place (-1)."""
        found = [True] * (len(drops) + 1)
        for i, (around, _) in enumerate(drops):  # the one around comes first
            found[i] = i in out and found[around]
        return found

    whole = 0.0
    unlinked: dict[int, float] = defaultdict(float)
    for text, zone, links, i in found:
        whole += len(text) * (1 - links)
        if i >= 0:
            unlinked[i] += len(text) * (1 - links)
            if zone & ~drops[i][1] & MAIN:
                add(i)
    stays = staying()
    marked = any(zone and stays[i] for _, zone, _, i in found)
    for i, n in unlinked.items():
        if n > WRAPS * whole and (drops[i][1] or not marked):
            add(i)
    stays = staying()
    if not any(zone and stays[i] for _, zone, _, i in found):
        articles: dict[int, int] = defaultdict(int)
        for text, zone, _, i in found:
            if i >= 0 and zone & ~drops[i][1] & ARTICLE:
                articles[i] += len(text)
        if articles:
            add(max(articles, key=articles.__getitem__))
    return out


def blocks(page: str) -> list[tuple[str, int, float]]:
    """(text, zone, share of the text in links) of the blocks that the element rules leave."""
    out: list[tuple[str, int, float, int]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int, int]] = []  # (tag, dropped, zone, the innermost of ``drops``)
    drops: list[tuple[int, int]] = []  # elements that go unless they hold the main text
    gone, zone, links, within = False, PLAIN, 0, -1
    # how many elements of a name are open, and where in the stack block elements are, so that no tag walks through all
    opened: Counter[str] = Counter()
    block_at: list[int] = []

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, zone, linked / max(1, sum(map(len, parts))), within))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal gone, zone, links, within
        links -= sum(e[0] == "a" for e in stack[depth:])
        if (stack[depth - 1][3] if depth else -1) != within:
            close_block()
        opened.subtract(e[0] for e in stack[depth:])
        while block_at and block_at[-1] >= depth:
            block_at.pop()
        del stack[depth:]
        gone, zone, within = stack[-1][1:] if stack else (False, PLAIN, -1)

    at, end = 0, len(page)
    while at < end:
        found = TAG.search(page, at)
        text = page[at : found.start() if found else end]
        if text and not gone:
            parts.append(text)
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        closing, name, attributes = found.groups()
        if name is None:
            continue
        tag = name.lower()
        if tag in BLOCK_TAGS:
            close_block()
        elif tag in ("br", "td", "th") and parts:
            parts.append(" ")
        if closing:
            if opened[tag] > 0:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in RAW_TAGS:
            over = re.compile(rf"</{tag}(?=[\s>/])[^>]*>?", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if tag in VOID_TAGS:
            continue
        if tag in BLOCK_TAGS and block_at:  # what HTML closes by itself
            if stack[block_at[-1]][0] in (("p",) if tag not in ("li", "dt", "dd") else ("p", tag)):
                pop_to(block_at[-1])
        own = ARTICLE if tag == "article" else MAIN if tag == "main" or re.search(r"""role\s*=\s*["']?main\b""", attributes) else PLAIN
        how = STAYS if gone else dropped(tag, attributes, bool(zone & ARTICLE))
        if how == GOES_UNLESS_WRAPPER and tag not in BLOCK_TAGS:
            how = GOES
        gone = gone or how == GOES
        if how == GOES_UNLESS_WRAPPER:
            close_block()
            drops.append((within, zone))
            within = len(drops) - 1
        zone |= own
        links += tag == "a"
        opened[tag] += 1
        if tag in BLOCK_TAGS:
            block_at.append(len(stack))
        stack.append((tag, gone, zone, within))
    close_block()
    if drops:
        kept = wrappers(out, drops)
        out = [x for x in out if x[3] < 0 or x[3] in kept]
    return [x[:3] for x in out]


def page_lines(page: str) -> tuple[bool, list[str]]:
    """(whether the page marks them as its own, lines)."""
    found = blocks(page)
    main = [text for text, z, _ in found if z & MAIN]
    article = [text for text, z, _ in found if z & ARTICLE]
    in_main = sum(len(text) for text, z, _ in found if z == MAIN | ARTICLE)
    # articles that are the lesser part of the main element are teasers beside its text
    if own := main if 2 * in_main < sum(map(len, main)) else article:
        return True, own
    return False, [text for text, _, links in found if links <= LINKS]


def rows_of(mine: list[int], other: list[int]) -> list[int]:
    """For each line of ``mine`` a number whose zero bits are the places of ``other`` at which the longest common subsequence of all up to here gets longer."""
    match: dict[int, int] = defaultdict(int)
    for j, key in enumerate(other):
        match[key] |= 1 << j
    every = (1 << len(other)) - 1
    v, out = every, []
    for key in mine:
        u = v & match.get(key, 0)
        v = (v + u | v - u) & every
        out.append(v)
    return out


def aligned(mine: list[int], other: list[int]) -> list[int]:
    """Places in ``mine`` of a longest common subsequence. Lines are compared many at a time, as bits; memory is bounded by splitting ``mine``."""
    if not mine or not other:
        return []
    if len(mine) > 1 and len(mine) * len(other) > AT_ONCE_BITS:
        half = len(mine) // 2
        lengths = lambda v: [0, *np.cumsum(np.unpackbits(np.frombuffer((~v & (1 << len(other)) - 1).to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)], dtype=np.int64).tolist()]
        ahead = lengths(rows_of(mine[:half], other)[-1])
        behind = lengths(rows_of(mine[half:][::-1], other[::-1])[-1])[::-1]
        cut = max(range(len(other) + 1), key=lambda j: ahead[j] + behind[j])
        return aligned(mine[:half], other[:cut]) + [half + i for i in aligned(mine[half:], other[cut:])]
    rows = rows_of(mine, other)
    found, i, j = [], len(mine), len(other)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            found.append(i)
            j -= 1
    return found[::-1]


def common_subsequence(mine: list[int], other: list[int]) -> set[int]:
    """Places in ``mine`` of a longest common subsequence: first the common head and tail, then what both have of the rest."""
    head = 0
    while head < min(len(mine), len(other)) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(mine), len(other)) - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(mine) - tail, len(mine))}
    both = set(mine[head : len(mine) - tail]).intersection(other[head : len(other) - tail])
    places = [i for i in range(head, len(mine) - tail) if mine[i] in both]
    found.update(places[i] for i in aligned([mine[i] for i in places], [x for x in other[head : len(other) - tail] if x in both]))
    return found


def different(texts: list[list[int]]) -> int:
    """How many texts there are that don't share half of the lines of the shorter with one before."""
    found: list[set[int]] = []
    for text in map(set, texts):
        if not any(2 * len(text & x) > min(len(text), len(x)) for x in found):
            found.append(text)
    return len(found)


def template(marked: bool, keys: list[int], sizes: list[int], others: list[list[int]]) -> list[int]:
    """Places of the lines that are a template's, by those that ``others`` (all with another text) share.

    Two of them are enough where the page doesn't mark its text, or the only one. Others that share more than half of the
    text count there only if no other page says anything, and if they look like pages of one template rather than near
    copies: all share the same lines, and the page has a good part to itself.

    In marked text they never count, and a line goes if ``NEARLY_ALL`` of the others have it, of ``MANY`` different texts.
    """
    mine = set(keys)
    total = sum(sizes)
    alike, votes, differ = [], defaultdict(list), 0
    for at, other in enumerate(others):
        shared = common_subsequence(keys, other) if not mine.isdisjoint(other) else set()
        if sum(sizes[i] for i in shared) > COPIES * total:
            alike.append(shared)
        else:
            differ += 1
            for i in shared:
                votes[i].append(at)
    if marked:
        often = {i: by for i, by in votes.items() if len(by) >= max(MANY, NEARLY_ALL * differ)}
        lines = {keys[i] for i in often}
        return sorted(i for i, by in often.items() if different([[x for x in others[k] if x not in lines] for k in by]) >= MANY)
    out = {i for i, by in votes.items() if len(by) >= (2 if differ > 1 else 1)}
    if not votes and len(alike) > 1:
        common, some = set.intersection(*alike), set.union(*alike)
        partly = sum(sizes[i] for i in some - common)
        own = total - sum(sizes[i] for i in some)
        if own >= OWN * total and 2 * partly <= own:
            out = common
    return sorted(out)


def url_columns() -> dict:
    """Host and path of ``url``; without scheme, query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return {"h_host": F.lower(F.substring_index(bare, "/", 1)), "h_path": F.regexp_replace(bare, r"^[^/]*", "")}


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``h_row``, the place of each row in the order of host, path and id, without gaps."""
    order = ["h_host", "h_path", "h_id"]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("h_at", F.monotonically_increasing_id()), "pages-order")
    part = F.shiftright("h_at", 33)
    sizes = placed.groupBy(part.alias("h_part")).agg(F.count("*").alias("n"))
    starts = sizes.select("h_part", F.coalesce(F.sum("n").over(Window.orderBy("h_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("h_start"))
    row = F.col("h_start") + F.col("h_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("h_part", part).join(starts, "h_part").withColumn("h_row", row).drop("h_part", "h_at", "h_start")


def templates(rows: DataFrame) -> DataFrame:
    """Numbered (h_host, h_text, marked, keys, sizes, h_row), one for each text of a host -> (h_host, h_text, places) where lines go."""
    # blocks of consecutive rows, each with the ends of the blocks beside it
    blocks_of = F.array_distinct(F.transform(F.array(F.lit(-NEAR), F.lit(0), F.lit(NEAR)), lambda x: F.floor((F.col("h_row") + x) / BLOCK)))
    rows = rows.select("h_host", "h_text", "marked", "keys", "sizes", "h_row", F.explode(blocks_of).alias("h_block"))
    rows = rows.repartition("h_block").sortWithinPartitions("h_block", "h_row")

    def run(batches):
        import pyarrow as pa

        near: list[tuple] = []  # up to 2 * NEAR + 1 rows of one block
        out: list[tuple] = []

        def decide(at: int) -> None:
            host, text, marked, keys, sizes, row, block = near[at]
            if row // BLOCK == block:
                others = [x[3] for i, x in enumerate(near) if i != at and abs(i - at) <= NEAR and x[0] == host]
                if others and (places := template(marked, keys, sizes, others)):
                    out.append((host, text, places))

        def flush() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.list_(pa.int32()))
            arrays = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["h_host", "h_text", "places"])

        waiting = 0  # the first of ``near`` that isn't decided
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if near and near[-1][6] != x[6]:
                    for at in range(waiting, len(near)):
                        decide(at)
                    near.clear()
                    waiting = 0
                near.append(x)
                if len(near) - waiting > NEAR:
                    decide(waiting)
                    waiting += 1
                    if waiting > NEAR:
                        del near[0]
                        waiting -= 1
            yield flush()
        for at in range(waiting, len(near)):
            decide(at)
        yield flush()

    return rows.mapInArrow(run, "h_host string, h_text long, places array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """Adds ``text`` to (page_id, url, html, ...); the html goes."""
    pages, names = packed(pages, "html", "url")
    schema = T.StructType(T.StructType.fromDDL("marked boolean, lines array<string>, keys array<long>, sizes array<int>").fields + [pages.schema["url"], pages.schema["rest"]])

    def parse(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            found = [page_lines(p or "") for p in batch.column(0).to_pylist()]
            keys = [[xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in lines] for _, lines in found]
            sizes = [list(map(len, lines)) for _, lines in found]
            columns = [pa.array([a for a, _ in found], pa.bool_()), pa.array([b for _, b in found], pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[1:]], names=schema.names)

    read_pages = pages.mapInArrow(parse, schema)
    h_text = F.xxhash64("marked", "keys")
    parsed = written(read_pages.withColumns(url_columns()).withColumns({"h_id": F.monotonically_increasing_id(), "h_text": h_text}), "pages")
    # one page for each text of a host, the first by path, so that each neighbour has another text
    first = F.min(F.struct("h_path", "h_id")).alias("first")
    texts = parsed.filter(F.size("keys") > 0).groupBy("h_host", "h_text").agg(first).select("h_host", "h_text", "first.*")
    rows = numbered(texts.join(parsed.select("h_id", "marked", "keys", "sizes"), "h_id"))
    found = written(templates(rows), "pages-templates")
    # the places go to the ids first, as a text may have many copies, and then to the lines by id
    places = written(parsed.filter(F.size("keys") > 0).select("h_id", "h_host", "h_text").join(found, ["h_host", "h_text"]).select("h_id", "places"), "pages-places")
    joined = parsed.join(places, "h_id", "left").select("lines", "places", "url", "rest")
    schema_out = T.StructType([pages.schema["url"], pages.schema["rest"], T.StructField("text", T.StringType())])

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            text = []
            for lines, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gone = set(places or ())
                text.append("\n\n".join(x for i, x in enumerate(lines) if i not in gone))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(text, pa.string())], names=schema_out.names)

    return joined.mapInArrow(extract, schema_out).select("url", *unpacked(names, "text"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
