"""Main text of web pages: markup roles first, then removal of what a site repeats.

A page is read into elements and blocks of text.  Elements that are no article by their tag, role or class fall
away.  The subtrees that are left are hashed and counted per host in Spark; one that recurs on a good share of
the pages of a host, next to different main texts, is a template of the site and is deleted with all it holds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrate.runtime import LIMITS, Limits, materialise

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript iframe svg math xmp noembed noframes object audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
LISTS = frozenset("ul ol dl table select".split())
NEVER_MAIN = frozenset("head nav footer aside form button select menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption".split())
WHOLE = frozenset("html body main article".split())
#: Class and id tokens that name what is not the article.
NOT_MAIN_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot copyright sidebar aside "
    "widget widgets ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended comment comments disqus respond replies reader-comments form search "
    "pagination pager skip".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?:/[^>]*>)?", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: What may stand before and behind such a name in one token, as in site-header or cookie-box.
BEFORE = frozenset("site main primary secondary top bottom global".split())
BEHIND = frozenset("bar body block box button buttons item links link list area section text".split())
TOKEN_PART = re.compile(r"[^a-z]+")
#: In an article its own header may be named so, as the tag is.
OWN_HEADER = frozenset("header masthead".split())


@dataclass(frozen=True)
class Settings:
    """A subtree is a template if it is on ``percent`` of the pages of a host, and on ``pages`` or more.

    Pages with one main text count once.  A single paragraph, heading or list item may be text that pages share,
    and has to be on ``prose_percent`` of them unless it lies in a template.
    """

    pages: int = 3
    percent: int = 30
    prose_percent: int = 80


@dataclass
class Page:
    """Blocks of a page, and the elements that may be templates."""

    parents: list[int] = field(default_factory=lambda: [-1])
    hashes: list[int] = field(default_factory=lambda: [0])
    prose: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[str, int, bool]] = field(default_factory=list)  # text, element, inside the article


def _is_main(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element may hold main text."""
    if tag in NEVER_MAIN or tag == "header" and not inside:
        return False
    if any(a.partition("=")[0] == "hidden" for a in attributes.lower().split()):
        return False
    if "=" not in attributes:
        return True
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return False
    return True


def _names_other(token: str) -> bool:
    """Whether a class or id token is as a whole the name of something beside the article."""
    if token in NOT_MAIN_WORDS:
        return True
    parts = [x for x in TOKEN_PART.split(token) if x]
    named = [x in NOT_MAIN_WORDS for x in parts]
    return any(named) and (named[0] or parts[0] in BEFORE) and all(
        n or x in BEHIND for n, x in zip(named[1:], parts[1:])
    )


def _named_apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether a class or id names the element as something beside the article."""
    if "=" not in attributes or tag in INLINE or tag in WHOLE and tag != "article":
        return False
    tokens = [
        token for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id")
        for token in (a or b or c).lower().split()
    ]
    if tag == "article":
        return any(t in ("comment", "comments", "comment-body") for t in tokens)
    return any(_names_other(t) and not (inside and t in OWN_HEADER) for t in tokens)


def parse(source: str) -> Page:
    """Read a page in one pass; never fails, whatever the markup.

    Unclosed elements end with their parent, end tags without start are skipped, a cut-off tag is markup.
    """
    page = Page()
    # Open elements: tag, number (of the nearest element that may be a template), outside main text, article, hash,
    # nearest element named apart (0 is none).
    stack: list[tuple[str, int, bool, bool, xxhash.xxh64, int]] = [("", 0, False, False, xxhash.xxh64(), 0)]
    above = [0]  # of each element named apart the next one around it
    holds = [True]  # an article, so that its name is that of a wrapper
    owners: list[int] = []  # of each block the nearest element named apart
    open_tags: dict[str, int] = {}  # so that no tag has to look through a deep stack in vain
    words: list[str] = []
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            _, number, outside, inside, digest, apart = stack[-1]
            digest.update(b"\x00" + text.encode("utf-8", "replace"))
            if not outside:
                page.blocks.append((text, number, inside))
                owners.append(apart)

    def close() -> None:
        tag, number, _, _, digest, _ = stack.pop()
        open_tags[tag] -= 1
        value = digest.intdigest()
        parent = stack[-1]
        parent[4].update(f"\x01{tag}{value}".encode())
        if number != parent[1]:
            page.hashes[number] = value - (1 << 63)

    length = len(source)
    while at < length:
        match = TOKEN.search(source, at)
        if match is None:
            words.append(source[at:])
            break
        if match.start() > at:
            words.append(source[at:match.start()])
        at = match.end()
        if match.group(2) is None:
            if match.group() == "<":
                words.append("<")
            continue
        tag, attributes = match.group(2).lower(), match.group(3)
        if match.group(1):
            if tag in INLINE:
                continue
            if open_tags.get(tag):
                flush()
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else length
            continue
        if tag in INLINE or tag in VOID:
            if tag == "br":
                words.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        if stack[-1][0] in CLOSED_BY_BLOCK:
            close()
        siblings = [t for t in SIBLINGS.get(tag, ()) if open_tags.get(t)]
        for i in range(len(stack) - 1 if siblings else 0, 0, -1):
            if stack[i][0] in LISTS:
                break
            if stack[i][0] in siblings:
                while len(stack) > i:
                    close()
                break
        _, number, outside, inside, _, apart = stack[-1]
        if not outside and not _is_main(tag, attributes, inside):
            outside = True
        if not outside and _named_apart(tag, attributes, inside):
            above.append(apart)
            holds.append(False)
            apart = len(above) - 1
        elif not outside and not inside and tag in ("article", "main"):
            around = apart
            while not holds[around]:
                holds[around] = True
                around = above[around]
        inside = inside or tag in ("article", "main")
        if not outside and tag not in WHOLE and not (inside and tag in PROSE):
            page.parents.append(number)
            page.hashes.append(0)
            page.prose.append(tag in PROSE)
            number = len(page.parents) - 1
        if not attributes.rstrip().endswith("/"):
            stack.append((tag, number, outside, inside, xxhash.xxh64(tag.encode()), apart))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    while len(stack) > 1:
        close()
    kept = [True]
    for i in range(1, len(above)):
        kept.append(holds[i] and kept[above[i]])
    page.blocks = [block for block, owner in zip(page.blocks, owners) if kept[owner]]
    return page


def main_blocks(page: Page, templates: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Blocks of the article, or of the whole page if it has none, without those inside a template."""
    gone = [False] * len(page.parents)
    for i in range(1, len(gone)):
        gone[i] = gone[page.parents[i]] or page.hashes[i] in templates
    article = any(inside for _, _, inside in page.blocks)
    return [text for text, number, inside in page.blocks if not gone[number] and (inside or not article)]


def host(url: Column) -> Column:
    """Lower-cased host of a URL; a URL without one is its own host, NULL is one host."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.when(found == "", F.coalesce(F.lower(url), F.lit(""))).otherwise(F.coalesce(found, F.lit("")))


def _read(column: pa.Array) -> Iterator[Page]:
    for source in column.cast(pa.binary()).to_pylist():
        yield parse((source or b"").decode("utf-8", "replace"))


def page_templates(
    pages: DataFrame, settings: Settings, key: str, url: str, source: str, limits: Limits = LIMITS,
) -> DataFrame:
    """``key``, ``sign`` (hash of the page) and the ``templates`` (hashes) on every page that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, prose, texts = [], [], [], []
            for i, page in enumerate(_read(batch.column(3))):
                # The row without a hash counts the page itself.
                own = [(None, False), *sorted(set(zip(page.hashes[1:], page.prose[1:])))]
                main = xxhash.xxh64_intdigest("\n".join(main_blocks(page)).encode("utf-8", "replace")) - (1 << 63)
                rows += [i] * len(own)
                hashes += [x for x, _ in own]
                prose += [x for _, x in own]
                texts += [main] * len(own)
            taken = batch.select([0, 1, 2]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(hashes, pa.int64()), pa.array(prose, pa.bool_()), pa.array(texts, pa.int64())],
                ["key", "sign", "host", "hash", "prose", "main"],
            )

    kind = pages.select(key).dtypes[0][1]
    read = pages.select(
        F.col(key).alias("key"), F.xxhash64(url, source).alias("sign"), host(F.col(url)).alias("host"), source
    )
    found = materialise(
        read.mapInArrow(run, f"key {kind}, sign bigint, host string, hash bigint, prose boolean, main bigint"), "subtrees"
    )
    # Pages with one main text count once: a copied page makes no template.
    different = found.select("host", "hash", "prose", "main").distinct()
    counted = materialise(
        different.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("_pages"), F.bool_and("prose").alias("_prose"))
        .where(F.col("_pages") >= settings.pages), "recurring",
    )
    hosts = counted.where("hash is null").select("host", F.col("_pages").alias("_host_pages"))
    hosts = F.broadcast(hosts) if hosts.count() <= limits.broadcast_rows else hosts
    needed = F.when(F.col("_prose"), settings.prose_percent).otherwise(settings.percent)
    templates = counted.where("hash is not null").join(hosts, "host").where(
        F.col("_pages") * 100 >= F.col("_host_pages") * needed
    ).select("host", "hash")
    return found.join(templates, ["host", "hash"]).groupBy("key", "sign").agg(F.collect_set("hash").alias("templates"))


def extract(
    pages: DataFrame, settings: Settings = Settings(), key: str = "page_id", url: str = "url", source: str = "html",
    limits: Limits = LIMITS,
) -> DataFrame:
    """``key``, ``url``, main ``text`` and its ``n_chars`` (code points) of every page.

    Character references are decoded, white space inside a block is one space, blocks are joined by \\n.  NULL or
    empty pages and pages without main text give the empty text.  Repeated rows are each returned; for the
    count they have one main text.  An empty table gives no rows; other columns are not read.
    """
    listed = materialise(page_templates(pages, settings, key, url, source, limits), "page-templates")
    seen = listed.agg(F.count(F.lit(1)), F.sum(F.size("templates") * 8 + 32)).first()
    small = seen[0] <= limits.broadcast_rows and (seen[1] or 0) <= limits.broadcast_bytes
    listed = listed.select(F.col("key").alias("_key"), F.col("sign").alias("_sign"), "templates")
    own = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("source"),
        F.xxhash64(url, source).alias("sign"),
    )
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("sign") == F.col("_sign"))
    joined = own.join(F.broadcast(listed) if small else listed, same, "left").select("key", "url", "source", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = (set(x or ()) for x in batch.column(3).to_pylist())
            texts = ["\n".join(main_blocks(page, gone)) for gone, page in zip(removed, _read(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
            ], [key, "url", "text", "n_chars"])

    kind = pages.select(key).dtypes[0][1]
    return joined.mapInArrow(run, f"`{key}` {kind}, url string, text string, n_chars bigint")
