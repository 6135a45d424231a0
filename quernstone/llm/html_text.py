"""Main text of web pages by paths that the pages of a host agree on.

First each page scores its containers by the running text that they hold, links counted against
them, climbs from the best one to the container of the whole article, and votes for its path: tags and
classes from the body down, with digits generalised. Spark adds the votes by host and path and takes each
host's winner. Then every page is read again and its text taken from the elements on the winning path; a
page where these are missing, or hold less than one MANYth of its own best container's text, uses that container.

What is beside the article: elements for menus, headers, footers and controls, hidden ones, and those whose class, id or role
has an aside word for its main word (`comment-list`, `site-footer`), inline elements too. A form, an element whose name only
mentions such a word (`comment-status-open`), and an article or main of any name are beside the article unless they hold
MOST of the page's running text: then the page is inside them.

Votes and winners are small rows, so a host with a third of all pages is counted by partial sums. The
winners are written before pages meet them, one row for each host: Spark knows their size, sends them to all
tasks if it is below its broadcast limit, so that pages stay where they are, and otherwise joins by host and
splits the hosts that are skewed.

Cases: null html is empty; a page without text gives the empty text; a null url is a host of its own; rows
with equal ids each get a row; an empty table gives an empty table; columns other than page_id,
url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pages, rows_of, settled

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|title)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements by what they are for.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BREAKS = frozenset("br hr".split())
CONTAINERS = frozenset("article main section div td body center".split())
ASIDE_TAGS = frozenset("nav footer aside menu dialog".split())
CONTROLS = frozenset("button label".split())
ARTICLES = frozenset("article main".split())
ENDS_P = BLOCKS - {"html", "body"}
CELLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in classes, ids and roles that mark what is not the article.
ASIDE_WORDS = re.compile(
    r"(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|commentlist|complementary|contentinfo|cookies?|consent|disqus|footer"
    r"|gdpr|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|recommend\w*|related"
    r"|replies|respond|search|share|sharing|sidebars?|signup|skip|social|sponsor\w*|subscribe|teaser|toolbar|topbar|widgets?)"
)
#: Words at the end of a name that tell the place or the shape, not the purpose.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box col column container content desktop field form group header heading icon inner item items large left link"
    " links list main mobile outer panel primary right row secondary section slot small text title top unit wrap wrapper".split()
)
HIDDEN_WORDS = frozenset("d-none hidden sr-only visually-hidden".split())


FEW_LINKS = 4  # text added to an article has at most one character in so many inside links
MOST = 0.5  # share of a page's running text that is not taken for something beside the article
LITTLE = 1e-6  # worth that is not handed on to containers further out
LONG_PATH = 1000  # letters of a path from which on its digest stands for it
MANY = 20  # times the text on the host's path, from which on a page's own container counts
#: Classes that tell what a layout has beside the article.
ABOUT_LAYOUT = re.compile(r"(?:.*[_-])?(?:has|with|without|no)[_-]", re.I)


@dataclass
class Element:
    tag: str
    path: str
    aside: bool
    container: int
    doubt: int = -1  # the innermost element around it that may be beside the article
    inline: bool = False


@dataclass
class Container:
    path: str
    parent: int
    tag: str = "body"
    score: float = 0.0


@dataclass
class Page:
    """Blocks of a page as (container, text, link characters), and its containers."""

    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)


def attributes(source: str) -> dict[str, str]:
    """Names in lower case and values; of equal names the first."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), next(filter(None, values), ""))
    return found


def short(path: str) -> str:
    """The path, or its digest if it is long: paths are only held against each other, and elements may nest without end."""
    return path if len(path) <= LONG_PATH else "#" + hashlib.blake2b(path.encode(), digest_size=16).hexdigest()


def hidden(told: dict[str, str]) -> bool:
    return "hidden" in told or UNSEEN.search(told.get("style", "")) is not None or any(c in HIDDEN_WORDS for c in told.get("class", "").lower().split())


def beside(name: str) -> tuple[bool, bool]:
    """Whether an aside word is the main word of a name, and whether there is one at all."""
    if ABOUT_LAYOUT.match(name):
        return False, False
    words = [w for w in re.split(r"[_\W\d]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
    found = [ASIDE_WORDS.fullmatch(w) is not None for w in words]
    while words and words[-1] in PLAIN_WORDS:
        words.pop()
    return bool(words) and found[len(words) - 1], any(found)


def named_beside(told: dict[str, str]) -> tuple[bool, bool]:
    found = [beside(name) for key in ("class", "id", "role") for name in told.get(key, "").split()]
    return any(sure for sure, _ in found), any(some for _, some in found)


def read_page(source: str) -> Page:
    page = Page(containers=[Container("body", -1)])
    stack = [Element("body", "body", False, 0)]
    opened: Counter[str] = Counter()
    blocks: list[tuple[int, str, int, int]] = []
    held: list[str] = []
    around: list[int] = []  # of each element that may be beside the article the next one around it
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                blocks.append((stack[-1].container, text, links, stack[-1].doubt))
        links = 0

    def cut(at: int) -> None:
        opened.subtract(e.tag for e in stack[at:])
        del stack[at:]

    def push(e: Element) -> None:
        opened[e.tag] += 1
        stack.append(e)

    def close(tag: str, within: set[str] | frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
            if stack[i].tag == tag:
                cut(i)
                return
            if stack[i].tag in within:
                return

    def say(text: str) -> None:
        nonlocal links
        if not stack[-1].aside:
            held.append(text)
            if in_link:
                links += len(text)

    at = 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            say(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m[1] or not m[3]:
            continue
        tag = m[3].lower()
        if tag == "a":
            in_link = 0 if m[2] else 1
        if tag in BREAKS:
            flush()
        elif tag in BLOCKS:
            flush()
            if m[2]:
                if tag not in ("body", "html"):
                    close(tag)
                continue
            if tag in ("body", "html"):
                continue
            if tag in ENDS_P and opened["p"]:
                top = len(stack) - 1
                while stack[top].inline:
                    top -= 1
                if stack[top].tag == "p":
                    cut(top)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                cut(len(stack) - 1)
            if tag in CELLS:
                close(tag, CELLS[tag])
            over, told = stack[-1], attributes(m[4]) if m[4].strip() else {}
            sure, some = named_beside(told)
            aside = over.aside or tag in ASIDE_TAGS or hidden(told) or sure and tag not in ARTICLES
            if tag == "header" and not any(opened[t] for t in ARTICLES):
                aside = True
            shown = sorted(set(re.sub(r"\d+", "#", told.get("class", "")).split()))
            path = short(f"{over.path}>{tag}" + "".join(f".{c}" for c in shown)) if tag in CONTAINERS else over.path
            container, doubt = over.container, over.doubt
            if tag in CONTAINERS:
                page.containers.append(Container(path, container, tag))
                container = len(page.containers) - 1
            if tag == "form" or some:
                around.append(doubt)
                doubt = len(around) - 1
            push(Element(tag, path, aside, container, doubt))
        elif tag == "input":
            continue
        elif m[2]:
            top = len(stack) - 1 if opened[tag] else 0
            while stack[top].inline and stack[top].tag != tag:
                top -= 1
            if stack[top].inline:
                cut(top)
        elif not m[4].endswith("/"):
            told = attributes(m[4]) if m[4].strip() else {}
            again = stack[-1].inline and stack[-1].tag == tag
            if again or tag in CONTROLS or told and (named_beside(told)[0] or hidden(told)):
                over = stack[-1]
                push(Element(tag, over.path, True, over.container, over.doubt, True))
    if at < len(source):
        say(entities.unescape(source[at:]))
    flush()
    running = [max(0, len(text) - linked) for _, text, linked, _ in blocks]
    inside = [0] * len(around)
    for size, (*_, doubt) in zip(running, blocks, strict=True):
        if doubt >= 0:
            inside[doubt] += size
    for i in range(len(around) - 1, -1, -1):  # the outer ones come first
        if around[i] >= 0:
            inside[around[i]] += inside[i]
    most, counts = MOST * sum(running), list[bool]()
    for size, outer in zip(inside, around, strict=True):
        counts.append(size >= most and (outer < 0 or counts[outer]))
    page.blocks = [b[:3] for b in blocks if b[3] < 0 or counts[b[3]]]
    return page


def score(page: Page) -> None:
    """A container earns the running text of its own blocks, each one around it half of what the one inside earns."""
    for container, text, links in page.blocks:
        worth = max(0, len(text) - 2 * links) + 25.0 * text.count(",")
        while container >= 0 and worth > LITTLE:
            page.containers[container].score += worth
            container, worth = page.containers[container].parent, worth / 2


def climb(page: Page, at: int) -> int:
    """The highest container around this one, the body aside, that adds text with few links only.

    None above a main is tried, and without a main none above an article.
    """
    size, linked = [0] * len(page.containers), [0] * len(page.containers)
    for container, text, links in page.blocks:
        size[container] += len(text)
        linked[container] += links
    for i in range(len(page.containers) - 1, 0, -1):  # parents come first
        size[page.containers[i].parent] += size[i]
        linked[page.containers[i].parent] += linked[i]
    around = [at]
    while page.containers[around[-1]].parent > 0:
        around.append(page.containers[around[-1]].parent)
    for tag in ("main", "article"):
        ends = [k for k, i in enumerate(around) if page.containers[i].tag == tag]
        if ends:
            around = around[: ends[-1] + 1]
            break
    for i in around[1:]:
        if FEW_LINKS * (linked[i] - linked[at]) <= size[i] - size[at]:
            at = i
    return at


def best(page: Page) -> Container | None:
    """The container of the article; its score is that of the best one inside."""
    score(page)
    top = max(range(len(page.containers)), key=lambda i: page.containers[i].score)
    if page.containers[top].score <= 0:
        return None
    return replace(page.containers[climb(page, top)], score=page.containers[top].score)


def text_on(page: Page, path: str) -> str:
    """Blocks inside the elements on the path, in page order."""
    inside: list[bool] = []
    for c in page.containers:  # parents come first
        inside.append(c.path == path or c.parent >= 0 and inside[c.parent])
    return " ".join(text for container, text, _ in page.blocks if inside[container])


def extract(source: str, path: str | None) -> str:
    """The text on the path; on that of the page's own best container if there is none, or next to none."""
    page = read_page(source)
    found = text_on(page, path) if path is not None else ""
    if (own := best(page)) and own.path != path:
        other = text_on(page, own.path)
        if len(other) >= MANY * len(found):
            return other
    return found


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_votes(table: DataFrame) -> DataFrame:
    """host, path, score of each page's best container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch):
                tops = [(host, best(read_page(source))) for host, source in rows]
                found = [(host, top.path, top.score) for host, top in tops if top]
                columns = list(zip(*found, strict=True)) or [[], [], []]
                kinds = (pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "score"]
                )

    read = table.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    return read.mapInArrow(run, "host string, path string, score double")


def host_winners(votes: DataFrame) -> DataFrame:
    """host and the path with the most votes; ties go to the higher score, then to the smaller path."""
    score = F.sum(F.round("score").cast("long"))
    counted = votes.groupBy("host", "path").agg((-F.count("*")).alias("n"), (-score).alias("score"))
    return counted.groupBy("host").agg(F.min(F.struct("n", "score", "path"))["path"].alias("winner"))


def extract_texts(table: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used of every page."""
    winners = settled(host_winners(page_votes(table)), "winners")
    rows = table.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    placed = rows.join(winners, "host", "left").select("page_id", "url", "html", "winner")
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("host_path", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch):
                texts = [extract(source, winner) for _, _, source, winner in rows]
                found = [[r[0] for r in rows], [r[1] for r in rows], texts, list(map(len, texts)), [r[3] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)

    return placed.mapInArrow(run, "page_id long, url string, text string, n_chars long, host_path string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_texts(pages(spark, sf_dir))
