"""Main text of web pages by template deduction from equivalence classes.

A page is a row of tokens: its containers, each known by its path with classes and ids, and
its blocks of text, each known by path and text. For every host Spark counts each token's
occurrences on each page, and tokens whose occurrences agree on all pages form an
equivalence class. A class is valid if it is large and frequent; the valid classes of a
host, nested by their paths, are its template. What remains of a page are slots: the
blocks of text between template tokens, each under its innermost template container.

From the slots the main text is taken: those inside an article or main container if there
are any, else all whose text varies over the pages of the host and is not links; lists, tables and
quotes belong to the container around them, and a slot of any size counts. Menus, headers, footers, sidebars,
notices, adverts, forms and comments are told by element, by how a role or a class name begins, and by a whole id;
an article by a whole class name alone, a main container or the body by none. A page of nothing but links has no main text. Text that
itself belongs to the template is left out, unless it is inside an article or main container
or nothing else would be left. Such text is on just the pages that the frame of the host is on,
its most common container; text that copies or near copies share is not.

Pages of a host with the same text count once, so copies of a page make no template. An occurrence
vector is kept as the exclusive or of one hash per page and count, so counting
combines before the shuffle and no task gathers the pages of a host. The template of a host
holds at most twice the tokens of a page, as each is on half of its pages.

Null html gives empty text; a null url counts as a host of its own, as do all urls without a host.
Repeated rows, and pages of equal ids, are pages each. Unclosed tags end where their parent
does, and a page that breaks off inside a tag ends before it. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import saved

# A class of the template has so many tokens, on this share of the pages of its host.
LEAST_TOKENS = 3
LEAST_SHARE = 0.5
# Hosts of fewer pages have no text in their template.
LEAST_PAGES = 4
# Without an article, a slot with this share of its text in links is a menu.
LINKS = 0.8

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S,
)
# One attribute after the other, so that what stands in a value is never taken for one.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")

# Elements whose content is no text of a page.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title"}
CONTAINERS = {
    "html", "head", "body", "nav", "header", "footer", "aside", "main", "article", "section", "div",
    "ul", "ol", "dl", "table", "form", "figure", "figcaption", "blockquote", "dialog", "menu", "select",
    "button", "details", "fieldset",
}
# Elements that start a new block; all others run on.
BLOCKS = CONTAINERS | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "caption", "pre", "hr", "address", "summary",
}
SPACED = {"br", "td", "th", "img", "wbr"}
# Parts of the text of the container around them.
NESTED = {"ul", "ol", "dl", "table", "figure", "figcaption", "blockquote", "details"}
LISTS = {"ul", "ol", "dl"}
VOID = {"br", "hr", "img", "wbr", "input", "meta", "link", "col", "area", "base", "embed", "source", "track"}
MAIN = {"article", "main"}
OUTSIDE = {
    "head", "nav", "footer", "aside", "form", "dialog", "menu", "select", "button", "fieldset", "header",
}
# How class names and roles begin that tell what is not main text; an id only counts as a whole.
OUTSIDE_WORDS = (
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side"
    r"|aside|footer|header|masthead|comments?|commentlist|replies|disqus\w*|cookies?|consent|gdpr|notices?|alert|popup"
    r"|modal|overlay|newsletter|subscribe\w*|signup|login|share|sharing|social|related|recommended|widget\w*|toolbar"
    r"|pagination|pager|complementary|contentinfo|navigation|search)"
)
OUTSIDE_CLASS = re.compile(rf"(?:^|\s)(?:site-|page-|main-|post-)?{OUTSIDE_WORDS}(?=$|[\s_-])", re.I)
OUTSIDE_WORD = re.compile(OUTSIDE_WORDS, re.I)
# Elements that hold the main text whatever their names say of the parts of the page; an article may be a comment.
WHOLE = {"html", "body", "main"}
MAIN_NAMES = re.compile(
    r"(?:^|[\s_-])(?:main|article|post|entry|story)(?:[\s_-]?(?:content|body|text))?(?=$|\s)", re.I
)


@dataclass
class Block:
    """A run of text under the containers that are open there, of which nested ones are left out."""

    path: tuple[tuple[int, int], ...]  # token and number of each container
    inside: str
    text: str
    link: int = 0
    token: int = 0
    listed: bool = False


def _token(*parts: object) -> int:
    """A number for the parts; ``_text_token`` makes it odd, those of containers are even."""
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 2 << 1


def _text_token(*parts: object) -> int:
    return _token(*parts) | 1


def _kind(name: str, rest: str) -> tuple[str, str]:
    """What a container says of its content (main, outside or nothing), and its class and id."""
    said: dict[str, str] = {}
    for attribute, value in ATTRIBUTE.findall(rest):
        # The first of several attributes of one name counts.
        said.setdefault(attribute.lower(), value.strip("\"'"))
    names = " ".join(said[a] for a in ("class", "id", "role") if a in said)
    hidden = (
        "hidden" in said
        or said.get("aria-hidden") == "true"
        or re.search(r"display\s*:\s*none", said.get("style", ""))
    )
    if hidden or name in OUTSIDE:
        return "outside", names
    if name == "article":
        if any(OUTSIDE_WORD.fullmatch(word) for word in said.get("class", "").split()):
            return "outside", names
    elif name not in WHOLE and (
        OUTSIDE_CLASS.search(said.get("class", ""))
        or OUTSIDE_CLASS.search(said.get("role", ""))
        or OUTSIDE_WORD.fullmatch(said.get("id", ""))
    ):
        return "outside", names
    if name in MAIN or name not in WHOLE and MAIN_NAMES.search(names):
        return "main", names
    return "", names


def parse(html: str | None) -> tuple[list[int], list[Block]]:
    """The container tokens of a page, and its blocks of text in order."""
    if not html:
        return [], []
    # Open containers: name, token, what they say, number.
    stack: list[tuple[str, int, str, int]] = []
    tokens, blocks, run = [], [], []
    link_chars = in_link = 0

    def close() -> None:
        nonlocal link_chars
        text = " ".join(markup.unescape("".join(run)).split())
        if text:
            inside = ""
            # The innermost container that says something decides; a header belongs to an article around it.
            for name, _, kind, _ in reversed(stack):
                if name == "header" and kind == "outside" and any(k == "main" for _, _, k, _ in stack):
                    continue
                if kind:
                    inside = kind
                    break
            path = tuple((token, number) for name, token, _, number in stack if name not in NESTED)
            token = _text_token(stack[-1][1] if stack else 0, text)
            blocks.append(Block(path, inside, text, link_chars, token, any(name in LISTS for name, *_ in stack)))
        run.clear()
        link_chars = 0

    at = 0
    while True:
        found = TAG.search(html, at)
        text = html[at : found.start() if found else len(html)]
        if text:
            run.append(text)
            link_chars += len(text) * (in_link > 0)
        if not found:
            break
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            if name == "a":
                in_link = 0
        elif name in RAW:
            if not found["rest"].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        elif name == "a":
            in_link = 1
        if name in SPACED:
            run.append(" ")
        if name not in BLOCKS:
            continue
        close()
        in_link = 0
        if name not in CONTAINERS:
            continue
        if found["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            kind, names = _kind(name, found["rest"])
            # Numbers in names count pages, not kinds of containers.
            token = _token(stack[-1][1] if stack else 0, name, re.sub(r"\d+", "0", names))
            tokens.append(token)
            stack.append((name, token, kind, len(tokens)))
    close()
    return tokens, blocks


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page with text its host, a number for that text, and its tokens with their counts, packed."""
    for batch in batches:
        hosts, bodies, packed = [], [], []
        for host, html in zip(*(batch.column(i).to_pylist() for i in range(2))):
            tokens, blocks = parse(html)
            own = [block.token for block in blocks if block.inside != "outside"]
            if not own:
                continue
            occurs = Counter([0, *tokens, *(block.token for block in blocks)])  # 0 stands for the page itself
            hosts.append(host)
            bodies.append(_token(*own))
            packed.append(np.array(sorted(occurs.items()), np.int64).tobytes())
        columns = [pa.array(hosts, pa.string()), pa.array(bodies, pa.int64()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "body", "tokens"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of a batch: pages with it, occurrences, and as one number each these and the pages alone."""
    for batch in batches:
        found: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for host, body, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
            seen = _token(body)
            vectors: dict[int, int] = {}
            for token, n in np.frombuffer(packed, np.int64).reshape(-1, 2).tolist():
                if n not in vectors:
                    vectors[n] = _token(body, n)
                entry = found[host, token]
                entry[0] += 1
                entry[1] += n
                entry[2] ^= vectors[n]
                entry[3] ^= seen
        hosts, tokens = zip(*found) if found else ((), ())
        values = list(zip(*found.values())) or [(), (), (), ()]
        columns = [pa.array(hosts, pa.string()), *(pa.array(v, pa.int64()) for v in (tokens, *values))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "token", "pages", "n", "vector", "seen"])


def templates(pages: DataFrame) -> DataFrame:
    """The tokens of each host's template, and its number of different pages, from ``host`` and ``html``."""
    bodies = pages.select("host", "html").mapInArrow(_bodies, "host string, body long, tokens binary")
    # Copies of a page count once, so that they cannot make its text a template.
    bodies = bodies.groupBy("host", "body").agg(F.min("tokens").alias("tokens"))
    counts = bodies.mapInArrow(_counts, "host string, token long, pages long, n long, vector long, seen long")
    counts = counts.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"),
        F.sum("n").alias("n"),
        F.bit_xor("vector").alias("vector"),
        F.bit_xor("seen").alias("seen"),
    )
    # Tokens of one page only can be in no template of several, and are most of all tokens.
    counts = saved(counts.filter("pages > 1 OR token = 0"), "tokens")
    # The frame of a host is what its most common container is on; without containers, all pages.
    place = F.struct("pages", "seen")
    hosts = counts.groupBy("host").agg(
        F.max(F.when(F.col("token") == 0, F.col("pages"))).alias("of"),
        F.coalesce(
            F.max(F.when((F.col("token") != 0) & (F.col("token") % 2 == 0), place)),
            F.max(F.when(F.col("token") == 0, place)),
        ).alias("frame"),
    )
    classes = counts.filter("pages > 1 AND token <> 0").groupBy("host", "pages", "n", "vector", "seen").agg(
        F.collect_list("token").alias("tokens"),
    )
    valid = classes.join(hosts, "host").filter(
        (F.size("tokens") >= LEAST_TOKENS) & (F.col("pages") >= LEAST_SHARE * F.col("of"))
    )
    # Text that is not on just the pages of the frame may be that of pages that are near copies.
    on_frame = F.col("seen") == F.col("frame.seen")
    tokens = F.filter("tokens", lambda token: on_frame | (token % 2 == 0))
    return valid.groupBy("host").agg(
        F.flatten(F.collect_list(tokens)).alias("template"), F.first("of").alias("of")
    )


def _slot(block: Block, template: set[int]) -> int:
    known = [number for token, number in block.path if token in template]
    return known[-1] if known else block.path[-1][1] if block.path else 0


def _links(*blocks: Block) -> bool:
    return sum(b.link for b in blocks) >= LINKS * sum(len(b.text) for b in blocks)


def _number(blocks: list[Block]) -> bool:
    """Whether all there is is one number, which beside text of the template is a field of it."""
    return len(blocks) == 1 and re.fullmatch(r"[^\w\s]*\d[\d\W]*", blocks[0].text) is not None and " " not in blocks[0].text


def main_text(html: str | None, template: set[int], of: int) -> str:
    """The main text of one page, given the template of its host."""
    _, blocks = parse(html)
    blocks = [b for b in blocks if b.inside != "outside"]
    main = [b for b in blocks if b.inside == "main"]
    # Slots that hold text of the template.
    framed = set()
    if of >= LEAST_PAGES:
        # Text of the template inside an article or main container may be an article that is on all pages.
        varied = [b for b in blocks if b.token not in template]
        framed = {_slot(b, template) for b in blocks if b.token in template}
        if varied and all(b.token in template for b in main):
            main, blocks = [], [b for b in blocks if b.inside == "main" or b.token not in template]
    if main:
        blocks = main
    else:
        # Where no template tells the menus, links in lists are menus.
        if of < LEAST_PAGES:
            blocks = [b for b in blocks if not b.listed or not _links(b)]
        # Slots by their innermost template container, or by their own where no template is known.
        slots: dict[int, list[Block]] = defaultdict(list)
        for block in blocks:
            slots[_slot(block, template)].append(block)
        kept = {id(b) for slot, own in slots.items() if not _links(*own) and not (slot in framed and _number(own)) for b in own}
        blocks = [b for b in blocks if id(b) in kept]
    return "\n\n".join(b.text for b in blocks)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """For each row its ``key``, ``url``, the main ``text`` and its length ``n_chars``."""
    rows = pages.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{url}`").alias("url"),
        F.col(f"`{html}`").alias("html"),
        host_of(F.col(f"`{url}`")).alias("host"),
    )
    # Written first, so that Spark joins by its measured size: pages move only where it is large, and then
    # those of a hot host are split.
    found = saved(templates(rows), "templates")

    @F.pandas_udf("string")
    def text(html: pd.Series, template: pd.Series, of: pd.Series) -> pd.Series:
        # Pages of a host share their template.
        known: dict[bytes, set[int]] = {}
        texts = []
        for page, tokens, n in zip(html, template, of):
            packed = b"" if tokens is None else np.asarray(tokens, np.int64).tobytes()
            if packed not in known:
                known[packed] = set(np.frombuffer(packed, np.int64).tolist())
            texts.append(main_text(page, known[packed], int(n)))
        return pd.Series(texts, dtype=object)

    joined = rows.join(found, "host", "left")
    joined = joined.select("key", "url", text("html", "template", F.coalesce("of", F.lit(0))).alias("text"))
    return joined.select(
        F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars")
    )
