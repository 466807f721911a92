"""Main text of web pages by differencing against the nearest page of the same host.

A page becomes text lines, one per block. Every page is paired with the one of the
same host whose URL path is nearest, both are aligned by their longest common
subsequence of lines, and the lines they share go: menus, notices and footers repeat
from page to page, an article does not. The markup is a check of that: it restores
lines inside a marked article, and takes out what surrounds one.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.registry import query
from eventloom.llm.text import read_table, stored

# Above this share of its characters in common with its partner, a page is a copy of
# it, and what they share is no boilerplate.
COPY_SHARE = 0.8

# Names that HTML gives its elements, and that pages give what surrounds
# an article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav noscript ol optgroup option p pre search section select summary table "
    "tbody td template tfoot th thead title tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
CHROME = frozenset(
    "aside button canvas datalist dialog footer head menu nav noscript object search select svg "
    "template".split()
)
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice pagination popup promo related reply replies search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
CHROME_ROLES = frozenset(
    "alert banner complementary contentinfo dialog form menu menubar navigation search".split()
)
# What end tags and implied ends do not reach across.
KEEPERS = frozenset(["article", "main"])
P_ENDS = KEEPERS | frozenset("button caption html object table td template th".split())
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
# An open element of these ends where the next of its kind begins: the names of the
# kind, and the elements out of which that does not reach.
IMPLIED_END = {
    name: (frozenset(same.split()), KEEPERS | frozenset(until.split()))
    for name, same, until in (
        ("dd", "dd dt", "dl"),
        ("dt", "dd dt", "dl"),
        ("li", "li", "menu ol ul"),
        ("option", "option", "datalist select"),
        ("td", "td th", "table tr"),
        ("th", "td th", "table tr"),
        ("tr", "tr", "table"),
    )
}
# What the markup says of a line.
PLAIN, MAIN, ARTICLE, SUSPECT, SUSPECT_INSIDE, AROUND = range(6)

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>
    |<(/?)([a-zA-Z][^\s/>]*)([^>]*)>
    |<[!?/][^>]*>""",
    re.S | re.X,
)
# One attribute after the other, so that nothing within a value is taken for one.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?|"[^"]*"|'[^']*'""")
_NAME = re.compile(r"[A-Za-z]+")


def _marks(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element surrounds an article, and whether it is suspected to, which
    its names alone and forms are. An article's own header does not surround it."""
    if name in CHROME or (name == "header" and not in_article):
        return True, False
    suspected = name == "form"
    if not attributes or name in ("html", "body", "article", "main"):
        return False, suspected
    for attribute, value in _ATTRIBUTE.findall(attributes):
        value, attribute = value.strip("\"'").lower(), attribute.lower()
        if attribute == "hidden" or (attribute == "aria-hidden" and value == "true"):
            return True, False
        if attribute == "role" and value in CHROME_ROLES:
            if value != "form":
                return True, False
            suspected = True
        if attribute in ("class", "id"):
            for word in value.split():
                parts = _NAME.findall(word)
                if parts and (parts[0] in CHROME_NAMES or parts[-1] in CHROME_NAMES):
                    suspected = True
    return False, suspected


def _elements(page: str) -> tuple[list[tuple], list[bool]]:
    """Steps of a page, and which of its elements have their own end tag.

    Steps are ``("text", text)``, ``("open", number, name, attributes)``,
    ``("close", number, name)`` and ``("break", text)``; every element that opens is
    closed once. An end tag closes what is open inside its element; a ``li``, ``p`` and
    the like end with their parent, ``head`` where the body begins. What stands inside
    an article or ``main`` closes nothing around it, except ``body`` and ``html``.
    """
    steps: list[tuple] = []
    ended: list[bool] = []
    open_now: list[tuple[int, str]] = []
    opened: dict[str, int] = {}

    def close(depth: int) -> None:
        while len(open_now) > depth:
            steps.append(("close", *open_now.pop()))
            opened[steps[-1][2]] -= 1

    def place(names, until) -> int | None:
        if not any(opened.get(name) for name in names):
            return None
        for i in range(len(open_now) - 1, -1, -1):
            name = open_now[i][1]
            if name in names:
                return i
            if name in until:
                return None
        return None

    def open_one(name: str, attributes: str) -> None:
        open_now.append((len(ended), name))
        steps.append(("open", len(ended), name, attributes))
        ended.append(name in IMPLIED_END or name == "p")
        opened[name] = opened.get(name, 0) + 1

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        here = page[at : tag.start() if tag else size]
        if here:
            if open_now and open_now[-1][1] == "head" and here.strip():
                close(len(open_now) - 1)
            steps.append(("text", here))
        if tag is None:
            break
        at = tag.end()
        name = tag[2] or tag[5]
        if name is None:  # a comment or declaration
            continue
        name = name.lower()
        attributes = (tag[3] if tag[2] else tag[6]) or ""
        if tag[1] or tag[4]:
            found = place((name,), () if name in ("body", "html") else KEEPERS - {name})
            if found is None:
                steps.append(("break", "\n" if name in BLOCKS else ""))
            else:
                close(found + 1)
                ended[open_now[-1][0]] = True
                close(found)
            continue
        if name not in IN_HEAD:
            found = place(("head",), KEEPERS)
            if found is not None:
                close(found)
        if name in BLOCKS:
            found = place(("p",), P_ENDS)
            if found is not None:
                close(found)
        if name in IMPLIED_END:
            same, until = IMPLIED_END[name]
            found = place(same, until)
            if found is not None:
                close(found)
        if name in VOID or (attributes.endswith("/") and name not in BLOCKS):
            steps.append(("break", "\n" if name in BLOCKS else " " if name == "br" else ""))
        elif name in RAW:
            at = _after_raw(page, at, name)
            steps.append(("break", "\n" if name in BLOCKS else ""))
        elif attributes.endswith("/") and _marks(name, attributes, False) != (False, False):
            steps.append(("break", "\n"))
        else:
            open_one(name, attributes)
    close(0)
    return steps, ended


def _holders(steps: list[tuple]) -> set[int]:
    """Numbers of the elements around the articles, and around ``main``, that stand in
    the fewest regions that surround or are suspected to."""
    found: dict[str, tuple[int, set[int]]] = {}
    open_now: list[tuple[int, bool]] = []
    levels, inside = [0], 0
    for step in steps:
        if step[0] == "open":
            _, number, name, attributes = step
            if name in KEEPERS and not inside:
                least, numbers = found.get(name, (levels[-1] + 1, set()))
                if levels[-1] <= least:
                    if levels[-1] < least:
                        numbers = set()
                    numbers.update(n for n, around in open_now if around)
                    found[name] = (levels[-1], numbers)
            around = not inside and any(_marks(name, attributes, False))
            inside += name == "article"
            open_now.append((number, around))
            levels.append(levels[-1] + around)
        elif step[0] == "close":
            open_now.pop()
            levels.pop()
            inside -= step[2] == "article"
    return set().union(*(numbers for _, numbers in found.values()))


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """All text lines of a page, and what its markup says of each: ``ARTICLE``,
    ``MAIN``, ``PLAIN``, suspected inside or outside an article, or ``AROUND``.

    An element whose end tag is missing is at most suspected, as nobody knows how far
    it should reach, and so is a region by its name alone. A region that holds the
    article is neither: of several articles, those in the fewest such regions count.
    """
    steps, ended = _elements(page)
    holders = _holders(steps)
    lines: list[str] = []
    kinds: list[int] = []
    text: list[str] = []
    # Of each open element: inside an article, inside main, around, suspected.
    state = (False, False, False, False)
    muted = False  # within a line, by an element that surrounds
    states: list[tuple] = []

    def end_line() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append(line)
                article, main, around, suspected = state
                if around:
                    kinds.append(AROUND)
                elif suspected:
                    kinds.append(SUSPECT_INSIDE if article else SUSPECT)
                else:
                    kinds.append(ARTICLE if article else MAIN if main else PLAIN)

    for step in steps:
        if step[0] == "text":
            if not muted:
                text.append(step[1])
        elif step[0] == "break":
            if step[1] == "\n":
                end_line()
            else:
                text.append(step[1])
        elif step[0] == "open":
            _, number, name, attributes = step
            article, main, around, suspected = state
            hard, soft = _marks(name, attributes, article)
            inline = name not in BLOCKS
            if not inline:
                end_line()
            elif hard:
                text.append(" ")
            states.append((state, muted))
            if name in ("article", "main") and not article:
                article, main = name == "article", main or name == "main"
            elif number in holders:
                pass
            elif inline:
                muted = muted or (hard and ended[number])
            elif hard and ended[number]:
                around = True
            elif hard or soft:
                suspected = True
            state = (article, main, around, suspected)
        else:
            if step[2] in BLOCKS:
                end_line()
            state, muted = states.pop()
    end_line()
    return lines, kinds


def page_blocks(page: str) -> tuple[list[str], bool]:
    """Text lines of a page by its markup alone, and whether it says that they are the
    article: the lines of its articles, failing that of ``main``, failing that all.
    Without what surrounds an article or is suspected to."""
    lines, kinds = page_lines(page)
    for wanted in (ARTICLE, MAIN):
        if wanted in kinds:
            return [line for line, kind in zip(lines, kinds) if kind == wanted], True
    return [line for line, kind in zip(lines, kinds) if kind == PLAIN], False


def _after_raw(page: str, at: int, name: str) -> int:
    """The place after the end tag of an element whose content is no markup."""
    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def common_lines(left: list[int], right: list[int]) -> list[int]:
    """Places in ``left`` of a longest common subsequence with ``right``.

    Runs over the pairs of equal lines, which are few where lines are mostly distinct;
    equal ends are cut off first.
    """
    low = 0
    while low < min(len(left), len(right)) and left[low] == right[low]:
        low += 1
    high = 0
    while high < min(len(left), len(right)) - low and left[-1 - high] == right[-1 - high]:
        high += 1
    places: dict[int, list[int]] = {}
    for j in range(low, len(right) - high):
        places.setdefault(right[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(low, len(left) - high):
        for j in reversed(places.get(left[i], ())):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    middle, link = [], chains[-1] if chains else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(low), *reversed(middle), *range(len(left) - high, len(left))]


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "big", signed=True)


def _digest(hashes: list[int]) -> bytes:
    whole = b"".join(x.to_bytes(8, "big", signed=True) for x in hashes)
    return hashlib.blake2b(whole, digest_size=16).digest()


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and lengths of the lines of each page instead of the lines."""
    for batch in batches:
        pages = [page_lines(html or "")[0] for html in batch.column("html").to_pylist()]
        hashes = [[_line_hash(x) for x in lines] for lines in pages]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("host"),
                batch.column("path"),
                pa.array(map(_digest, hashes), pa.binary()),
                pa.array(hashes, pa.list_(pa.int64())),
                pa.array([[len(x) for x in lines] for lines in pages], pa.list_(pa.int32())),
            ],
            ["host", "path", "digest", "hashes", "sizes"],
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [page_lines(html or "") for html in batch.column("html").to_pylist()]
        digests = [_digest([_line_hash(x) for x in lines]) for lines, _ in pages]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                batch.column("host"),
                pa.array(digests, pa.binary()),
                pa.array([lines for lines, _ in pages], pa.list_(pa.string())),
                pa.array([kinds for _, kinds in pages], pa.list_(pa.int8())),
            ],
            ["page_id", "url", "host", "digest", "lines", "kinds"],
        )


def _shared(copy_share: float):
    """Places of the lines that a page shares with the page before or after it in URL
    order, whichever is nearer.

    Where that one is a copy but for some lines, those that are on a second page too;
    an article is not on both. Where a host has no third page, what the two share goes:
    their texts differ.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own, sizes, other, second in zip(
                *(batch.column(c).to_pylist() for c in ("hashes", "sizes", "other", "second"))
            ):
                places = common_lines(own, other)
                if second is not None and sum(sizes[i] for i in places) > copy_share * sum(sizes):
                    both = set(common_lines(own, second))
                    places = [i for i in places if i in both]
                found.append(places)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("host"),
                    batch.column("digest"),
                    pa.array(found, pa.list_(pa.int32())),
                ],
                ["host", "digest", "shared"],
            )

    return shared


def kept_lines(lines: list[str], kinds: list[int], shared: list[int] | None) -> list[str]:
    """Lines of a page that are its text; ``shared`` is None where it has no partner.

    Lines in the article are kept, also those that other pages repeat, and lines of
    ``main`` where no article has any; nothing that surrounds an article is. Of the
    others the shared ones go. What is suspected outside a marked article goes, and
    what is suspected inside needs the partner's word. Without a partner the markup
    decides on what is outside, as nothing says that it does not repeat.
    """
    trusted = next((kind for kind in (ARTICLE, MAIN) if kind in kinds), None)
    repeated = set(shared or ())

    def keep(place: int, kind: int) -> bool:
        if kind == AROUND:
            return False
        if kind == trusted:
            return True
        if trusted is not None and (kind == SUSPECT or (shared is None and kind in (PLAIN, MAIN))):
            return False
        return place not in repeated

    return [line for i, (line, kind) in enumerate(zip(lines, kinds)) if keep(i, kind)]


@F.arrow_udf(T.StringType())
def _text(lines: pa.Array, kinds: pa.Array, shared: pa.Array) -> pa.Array:
    rows = zip(lines.to_pylist(), kinds.to_pylist(), shared.to_pylist())
    return pa.array(["\n".join(kept_lines(*row)) for row in rows], pa.string())


def _common_prefix(left: Column, right: Column) -> Column:
    """Characters that two paths have in common at their start; -1 without a path."""
    pairs = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: a.eqNullSafe(b))
    length = F.array_position(F.transform(pairs, lambda x: ~x), True)
    return F.when(left.isNull() | right.isNull(), -1).otherwise(
        F.when(length > 0, length - 1).otherwise(F.size(pairs))
    )


def nearest_pages(pages: DataFrame) -> DataFrame:
    """``pages`` has ``host``, ``path``, ``digest``, ``hashes`` and ``sizes``; adds
    ``other``, the hashes of the page of the same host whose path is nearest in order:
    the neighbour that shares the longer start of the path, the earlier one in a tie.
    ``second`` are those of the neighbour on the other side, at the ends of a host those
    of the next but one. A page alone on its host, or without a URL, has none.

    A host with a third of all pages lies in several ranges of the sort order; only
    the pages at the ends of the ranges (four for each partition) are carried over.
    """
    order = ["host", "path", "digest"]
    ranges = pages.filter("host IS NOT NULL").orderBy(*order)
    ranges = stored(
        ranges.select(
            "*",
            F.spark_partition_id().alias("range"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "page-order",
    )
    here = F.struct("host", "path", "hashes")
    within = Window.partitionBy("range").orderBy("at")
    ranges = ranges.select(
        "*",
        F.lag(here).over(within).alias("before"),
        F.lag(here, 2).over(within).alias("before_2"),
        F.lead(here).over(within).alias("after"),
        F.lead(here, 2).over(within).alias("after_2"),
    )
    ends = ranges.groupBy("range").agg(
        F.min_by(here, "at").alias("head"),
        F.min_by("after", "at").alias("head_2"),
        F.max_by(here, "at").alias("tail"),
        F.max_by("before", "at").alias("tail_2"),
    )
    every = Window.orderBy("range")  # one row for each partition
    ends = ends.select(
        "range",
        F.lag("tail").over(every).alias("tail_before"),
        F.coalesce(F.lag("tail_2").over(every), F.lag("tail", 2).over(every)).alias("tail_2_before"),
        F.lead("head").over(every).alias("head_after"),
        F.coalesce(F.lead("head_2").over(every), F.lead("head", 2).over(every)).alias("head_2_after"),
    )
    found = ranges.join(ends, "range").select(
        "host",
        "path",
        "digest",
        "hashes",
        "sizes",
        F.coalesce("before", "tail_before").alias("before"),
        F.coalesce(
            "before_2",
            F.when(F.col("before").isNull(), F.col("tail_2_before")).otherwise(F.col("tail_before")),
        ).alias("before_2"),
        F.coalesce("after", "head_after").alias("after"),
        F.coalesce(
            "after_2",
            F.when(F.col("after").isNull(), F.col("head_2_after")).otherwise(F.col("head_after")),
        ).alias("after_2"),
    )

    def near(page: str) -> Column:
        same = F.col(f"{page}.host") == F.col("host")
        return F.when(same, _common_prefix(F.col("path"), F.col(f"{page}.path"))).otherwise(-1)

    before, after = F.coalesce(near("before"), F.lit(-1)), F.coalesce(near("after"), F.lit(-1))

    def on_host(page: str) -> Column:
        return F.when(F.col(f"{page}.host") == F.col("host"), F.col(f"{page}.hashes"))

    from_before = F.when(before >= 0, F.col("before.hashes"))
    from_after = F.when(after >= 0, F.col("after.hashes"))
    return found.select(
        "host",
        "digest",
        "hashes",
        "sizes",
        F.when(after > before, from_after).otherwise(from_before).alias("other"),
        F.when(after > before, F.coalesce(from_before, on_host("after_2")))
        .otherwise(F.coalesce(from_after, on_host("before_2")))
        .alias("second"),
    ).filter("other IS NOT NULL")


def main_text(pages: DataFrame, copy_share: float = COPY_SHARE) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page, from the whole of ``html``.

    Null and empty pages have an empty text. Pages of one host with equal lines are one
    page here, at the first of their paths, so its partner has other lines. What
    :func:`kept_lines` says of a page is its text. A page that shares more than
    ``copy_share`` of its characters with its partner is a copy but for some lines: then
    only what the second neighbour shares too counts. An unreadable URL gives no host
    and no partner.

    Pages are taken apart twice, so that what is sorted by URL is hashes and only one
    shuffle moves the lines.
    """
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"),
        F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path"),
    )
    narrow = plain.filter("host IS NOT NULL").mapInArrow(
        _narrow,
        "host string, path string, digest binary, hashes array<long>, sizes array<int>",
    )
    distinct = narrow.groupBy("host", "digest").agg(
        F.min("path").alias("path"),
        F.first("hashes").alias("hashes"),
        F.first("sizes").alias("sizes"),
    )
    shared = nearest_pages(distinct).mapInArrow(
        _shared(copy_share), "host string, digest binary, shared array<int>"
    )
    extract = "page_id long, url string, host string, digest binary, lines array<string>, kinds array<byte>"
    placed = plain.filter("host IS NOT NULL").mapInArrow(_extract, extract)
    alone = plain.filter("host IS NULL").mapInArrow(_extract, extract)
    joined = placed.join(shared, ["host", "digest"], "left")
    columns = ["page_id", "url", "lines", "kinds", "shared"]
    every = joined.select(*columns).unionAll(
        alone.withColumn("shared", F.lit(None).cast("array<int>")).select(*columns)
    )
    return every.select("page_id", "url", _text("lines", "kinds", "shared").alias("text"))


@query("op10_main_text")
def op10_main_text(spark, sf_dir):
    found = main_text(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
