"""HTML extraction by site style trees.

The pages of a host are merged into one style tree: its nodes are paths of block elements (tag, class and id), its
presentation nodes the sequences of children that pages have at a node, its content nodes the text blocks. Over the m
pages that have a node, presentation importance is the entropy (base m) of the sequences, and content importance is
1 minus the mean entropy (base m) of the texts' spread over pages: text that all pages share tells nothing, text of one
page does. A block goes if damping * presentation(parent) + (1 - damping) * content(node), or content(node) alone, is
below `threshold`, or if its own text is on so many pages with the node that 1 - log(those pages) is, on a host with at least `min_pages` pages that have the node. Of pages of a host that are alike in what can be article text,
one counts: copies of an article are no boilerplate.

Entropy alone can't see that an advert with new words on each page is no article, nor judge a host with one page. So
the markup's own words come first: elements that HTML defines as something else (nav, aside, form, ...) and elements
whose class or id names a role outside the article (menu, sidebar, comment, ...) are no article text, unless they hold
the main element, the longest article or most of the page's text; where a page has a main element, or article elements
with a third of its text, only what is in them can be. What remains is judged by the style tree.

Null and empty pages have empty text. Pages with a null url share a host. Rows with equal ids stay apart; columns other
than the three named are never read. Counting is by (host, node, value), combined before the shuffle, so a host with
a third of all pages is no hot group; pages themselves are not shuffled while the nodes to remove are at most
`broadcast_rows`, and meet them by salted host beyond that.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean, written

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)
    |<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>"']+|"[^"]*"|'[^']*')*+)>
    |</?[a-zA-Z][^>]*(?:>|\Z)
    |<[!?/][^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "noembed", "noframes", "xmp")
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*(?:>|\Z)", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
#: What an opening tag ends, up to the nearest element that can hold it.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
_HOLDS = frozenset("html body div section article main aside nav header footer table ul ol dl form blockquote figure td th li dd".split())
_NO_ARTICLE = frozenset("head nav aside footer form button select menu dialog fieldset input option datalist".split())
#: Words of class, id and role that name a part beside the article.
_ROLES = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup"
    " comment comments commentlist respond reply replies disqus discussion sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar"
    " footer foot masthead topbar share sharing social related recommended trending login search skip copyright legal disclaimer complementary contentinfo".split()
)
_OUTSIDE_ONLY = frozenset(("header", "head", "banner", "top"))
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"[ \t\n\r\f\v   -     　]+")


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Block:
    text: str
    node: int
    parent: int
    article: bool
    beside: bool
    linked: int  # characters in links
    main: bool = False
    named: tuple = ()  # elements around it whose class, id or role names a part beside the article


@dataclass
class Open:
    tag: str
    path: str
    node: int
    article: bool
    beside: bool
    children: list = field(default_factory=list)
    begun: int = -1  # of an article element, how many blocks came before it
    main: bool = False
    named: tuple = ()


def _beside(tag: str, attributes: dict, article: bool) -> bool:
    """Whether an element stands beside the article by its tag, or isn't shown."""
    return tag in _NO_ARTICLE or (tag == "header" and not article) or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")


def _named_beside(attributes: dict, article: bool) -> bool:
    """Whether class, id or role name a part beside the article."""
    for name in ("class", "id", "role"):
        for value in attributes.get(name, "").lower().split():
            words = _WORD.findall(value)
            if words and words[0] not in ("has", "with", "no") and any(w in _ROLES or (not article and w in _OUTSIDE_ONLY) for w in words):
                return True
    return False


def parse(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """The text blocks of a page in order, and of each element that holds others its node and the tags of its children."""
    root = Open("", "", hashed(""), False, False)
    stack, blocks, shapes = [root], [], []
    opened: dict[str, list[int]] = {}  # of each tag, where it stands in the stack
    text: list[str] = []
    linked, in_link, names = 0, 0, 0
    around: set[int] = set()  # named elements that hold the main element
    articles: list[tuple] = []  # of each article element, the first of its blocks, the block after its last, the named elements around it

    def flush() -> None:
        nonlocal linked
        if text:
            line = _SPACES.sub(" ", entities.unescape("".join(text))).strip(" ")
            if line:
                top = stack[-1]
                parent = stack[-2].node if len(stack) > 1 else root.node
                blocks.append(Block(line, top.node, parent, top.article, top.beside, linked, top.main, top.named))
            text.clear()
        linked = 0

    def close() -> None:
        flush()
        gone = stack.pop()
        opened[gone.tag].pop()
        if gone.begun >= 0:
            articles.append((gone.begun, len(blocks), gone.named))
        if gone.children:
            shapes.append((gone.node, ",".join(gone.children)))

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        piece = page[at : found.start()] if found else page[at:]
        if piece:
            text.append(piece)
            linked += len(piece) if in_link else 0
        if not found:
            break
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if found["close"] else 1
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            text.append(" " if tag == "br" else "")
            continue
        if found["close"]:
            if opened.get(tag):
                k = opened[tag][-1]
                while len(stack) > k:
                    close()
            else:
                flush()
            in_link = 0
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        flush()
        ends = _ENDS.get(tag, {"p"})
        ended = [k for t in ends for k in opened.get(t, ())]
        if ended:
            barrier = max((opened[t][-1] for t in _HOLDS if t not in ends and opened.get(t)), default=0)
            ended = min((k for k in ended if k > barrier), default=len(stack))
            while len(stack) > ended:
                close()
        top = stack[-1]
        top.children.append(tag)
        if tag in _VOID or found["rest"].endswith("/") and tag not in _HOLDS:
            continue
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(found["rest"])} if found["rest"] else {}
        article = top.article or tag in ("article", "main") or attributes.get("role") == "main"
        beside = top.beside or _beside(tag, attributes, article)
        main, named, begun = top.main, top.named, -1
        words_name = _named_beside(attributes, article)
        if tag == "main" or attributes.get("role") == "main":
            main = True
            around.update(named)
        elif tag == "article" and not words_name:  # comments are often articles too, of class comment
            begun = len(blocks)
        elif words_name and tag not in ("html", "body", "article"):
            names += 1
            named = (*named, names)
        path = f"{top.path}/{tag}" + "".join(f".{attributes[a]}" for a in ("class", "id") if attributes.get(a))
        if len(path) > 2000:
            path = f"{hashed(path)}"
        opened.setdefault(tag, []).append(len(stack))
        stack.append(Open(tag, path, hashed(path), article, beside, begun=begun, main=main, named=named))
        in_link = 0
    while len(stack) > 1:
        close()
    flush()
    _set_beside(blocks, around, articles)
    return blocks, shapes


def _set_beside(blocks: list[Block], around: set[int], articles: list[tuple], most: float = 0.8) -> None:
    """Blocks in a named element are beside, but a name doesn't count on an element that holds the main element, the longest article or `most` of the page's text."""
    if not any(b.named for b in blocks):
        return
    size = [0 if b.beside else max(0, len(b.text) - b.linked) for b in blocks]
    held: dict[int, int] = {}
    for b, n in zip(blocks, size, strict=True):
        for name in b.named:
            held[name] = held.get(name, 0) + n
    ignored = around | {name for name, n in held.items() if n > most * sum(size)}
    if articles:
        first, end, named = max(articles, key=lambda a: sum(size[a[0] : a[1]]))
        ignored.update(named if sum(size[first:end]) else ())
    for b in blocks:
        b.beside = b.beside or any(name not in ignored for name in b.named)


def article_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks that can be article text by the markup alone."""
    own = [b for b in blocks if not b.beside]
    plain = [b for b in own if b.linked <= 0.5 * len(b.text)]
    inside = [b for b in own if b.article]
    # article elements are also teasers beside the text: without a main element they need a third of it
    if inside and (any(b.main for b in inside) or 3 * sum(len(b.text) for b in plain if b.article) >= sum(len(b.text) for b in plain)):
        return inside
    return plain  # without an article, blocks that are mostly links are menus


def article_text(blocks: list[Block], removed: frozenset) -> tuple[str, int]:
    """The kept blocks joined by line ends, and how many the style tree removed."""
    own = article_blocks(blocks)
    kept = [b for b in own if b.node not in removed and (not removed or text_in_node(b.node, hashed(b.text)) not in removed)]
    return "\n".join(b.text for b in kept), len(own) - len(kept)


def text_in_node(node: int, value: int) -> int:
    """What stands for one text of a node among the removed nodes."""
    return node ^ value


def page_counts(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, node, parent, kind, value, n): on how many different pages of a host a node has a sequence of children (kind 0), a text (1), any text (2)."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, shapes = parse(page)
                by_node: dict[int, list] = {}
                for node, shape in shapes:
                    by_node.setdefault(node, []).append(shape)
                rows = [(node, 0, 0, hashed("|".join(shape))) for node, shape in by_node.items()]
                rows += {(b.node, b.parent, 1, hashed(b.text)) for b in blocks}
                rows += {(b.node, b.parent, 2, 0) for b in blocks}
                out.append((host, hashed("\n".join(b.text for b in article_blocks(blocks))), np.array(rows, "<i8").tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["host", "page", "rows"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = part.column(1).to_pylist()
                node, parent, kind, value = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 4).T
                host = np.repeat(part.column(0).to_numpy(), [len(x) // 32 for x in raw])
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in (host, node, parent, kind.astype(np.int32), value)], ["host", "node", "parent", "kind", "value"])

    # copies of a page (alike in what can be article text) tell nothing of the site: one of them counts
    different = _hosted(pages, url_column, html_column).select("host", "html").mapInArrow(lean(nodes), "host long, page long, rows binary").groupBy("host", "page").agg(F.min("rows").alias("rows"))
    rows = different.select("host", "rows").mapInArrow(lean(dealt), "host long, node long, parent long, kind int, value long")
    return rows.groupBy("host", "node", "parent", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def style_tree(pages: DataFrame, url_column: str = "url", html_column: str = "html", counts: DataFrame | None = None) -> DataFrame:
    """(host, node, parent, pages, presentation, content) of every node with text blocks; host is a hash of the url's authority. counts: page_counts(pages), where it is known."""
    counts = counts if counts is not None else page_counts(pages, url_column, html_column)
    n = F.col("n").cast("double")
    shown = counts.filter("kind = 0").groupBy("host", "node").agg(F.sum("n").alias("m"), F.sum(n * F.log(n)).alias("s"))
    # the entropy of counts that sum to m, base m: (ln m - sum(n ln n) / m) / ln m
    shown = shown.select("host", F.col("node").alias("parent"), F.when(F.col("m") > 1, 1 - F.col("s") / F.col("m") / F.log(F.col("m").cast("double"))).otherwise(1.0).alias("presentation"))
    texts = counts.filter("kind > 0").groupBy("host", "node", "parent").agg(F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("pages"), F.avg(F.when(F.col("kind") == 1, F.log(n))).alias("spread"))
    texts = texts.withColumn("content", F.when(F.col("pages") > 1, 1 - F.col("spread") / F.log(F.col("pages").cast("double"))).otherwise(1.0))
    return texts.join(shown, ["host", "parent"], "left").select("host", "node", "parent", "pages", F.coalesce("presentation", F.lit(1.0)).alias("presentation"), "content")


def _hosted(pages: DataFrame, url_column: str, html_column: str) -> DataFrame:
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col(url_column), F.lit("")), "//([^/?#]*)", 1)))
    return pages.select(host.alias("host"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"), *[F.col(c) for c in pages.columns if c not in ("host", "html", html_column)])


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", damping: float = 0.3, threshold: float = 0.25, min_pages: int = 8, broadcast_rows: int = 100_000, salts: int = 32) -> DataFrame:
    """Per page: id, url, text, n_chars (code points), n_removed (blocks that the style tree took)."""
    pages = pages.select(id_column, url_column, html_column)
    score = damping * F.col("presentation") + (1 - damping) * F.col("content")
    counts = written(page_counts(pages, url_column, html_column))
    tree = written(style_tree(pages, url_column, html_column, counts).filter(F.col("pages") >= min_pages))
    nodes = tree.filter((score < threshold) | (F.col("content") < threshold)).select("host", "node")
    # a text that nearly all pages have under a node goes even where the node's other texts stay
    often = counts.filter((F.col("kind") == 1) & (F.log("n") > (1 - threshold) * math.log(min_pages))).join(tree.select("host", "node", "parent", "pages"), ["host", "node", "parent"])
    texts = often.filter(1 - F.log("n") / F.log("pages") < threshold).select("host", F.col("node").bitwiseXOR(F.col("value")).alias("node"))
    low = nodes.union(texts)
    low = low.groupBy("host").agg(F.collect_set("node").alias("removed"), F.count(F.lit(1)).alias("n"))
    low = written(low)
    few = (low.agg(F.sum("n")).first()[0] or 0) <= broadcast_rows
    source = _hosted(pages, url_column, html_column)
    if few:
        met = source.join(F.broadcast(low.select("host", "removed")), "host", "left")
    else:
        spread = low.select("host", "removed", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
        met = source.withColumn("_salt", F.pmod(F.xxhash64(id_column), F.lit(salts)).cast("int")).join(spread, ["host", "_salt"], "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = [article_text(parse(page)[0], frozenset(removed or ())) for page, removed in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([r for _, r in got], pa.int64())], [id_column, url_column, "text", "n_chars", "n_removed"])

    kinds = dict(pages.dtypes)
    return met.select(id_column, url_column, "html", "removed").mapInArrow(lean(extract), f"`{id_column}` {kinds[id_column]}, `{url_column}` {kinds[url_column]}, text string, n_chars long, n_removed long")
