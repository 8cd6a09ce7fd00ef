"""Main text of web pages by consensus of a host's pages on where the article stands.

1. Every page is parsed into blocks of text and their containers; blocks in
   parts that are never the article (menus, headers, footers, asides, notices,
   adverts, forms, scripts, comments) are set apart. A container's score is the
   text of its own blocks, half that of its children's, less linked text.
2. Each page votes for the generalised path of its best container: tags and
   classes from the root, digits levelled. Spark counts the votes of a host's
   pages (combined before the shuffle); a host gets the path with most votes.
3. Every page is extracted again with its host's path. A page without a node at
   that path uses its own best container.

Host paths are sent to all tasks only if there are at most
``MAX_SENT_HOSTS``; beyond that they are joined.

Nulls: a null or empty html gives an empty text. A null url, or one without a
host, belongs to the host ''. Ties between paths go to the one first by name.
Repeated rows vote again and get equal texts; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarmill.session import cut

MAX_SENT_HOSTS = 20_000

#: Element names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe svg canvas object embed audio video map dialog menu title frameset noframes".split())
#: An open element of the first kind is closed by the start of one of the second.
CLOSES = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "p": BLOCK - {"li", "dt", "dd", "tr", "td", "th", "tbody", "tfoot", "thead", "option", "body", "html", "head", "caption", "legend", "frameset"} | {"li", "dt", "dd"},
    "head": frozenset({"body"}),
}
BOUND = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "p": frozenset("article section div td th table blockquote body li dd main aside nav header footer form figure".split()), "option": frozenset({"select"}), "head": frozenset()}
#: Words of class and id names that mark what is not the article, and those that speak for it.
UNWANTED = frozenset("ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments disqus respond reply replies widget toolbar pagination pager login signup register search skip copyright toc tags byline meta".split())
WANTED = frozenset("content article post main body entry story text page wrapper container".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Node:
    tag: str
    path: str
    parent: int
    out: bool  # in a part that is never the article
    heads_only: bool = False
    own: float = 0.0
    score: float = 0.0
    blocks: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text, linked characters), in page order, without blocks set apart
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _unwanted(tag: str, attributes: dict[str, str]) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body", "article", "main") or tag in HEADING:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in UNWANTED_ROLES:
        return True
    words = set(SPLIT.split(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    return bool(words & UNWANTED) and not words & WANTED


def parse(page: str) -> Page:
    """Blocks and containers of a page; markup that breaks the rules is closed as browsers do, roughly."""
    out = Page(nodes=[Node("", "", -1, False)])
    nodes, stack, parts = out.nodes, [0], []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                at = stack[-1]
                while at > 0 and nodes[at].tag not in BLOCK:
                    at = nodes[at].parent
                if not nodes[stack[-1]].out and not (nodes[at].heads_only and nodes[at].tag not in HEADING):
                    out.blocks.append((at, text, min(linked, len(text))))
        parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)

    def close(depth: int) -> None:
        nonlocal in_link
        for node in stack[depth:]:
            in_link -= nodes[node].tag == "a"
        del stack[depth:]

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, ending, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            if tag in BLOCK or tag in NEVER:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    close(depth)
                    break
                if nodes[stack[depth]].tag in ("article", "main", "td", "body") and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK or tag in NEVER:
            flush()
        if tag == "br" or tag == "img":
            say(" ")
            continue
        if tag in VOID:
            continue
        for depth in range(len(stack) - 1, 0, -1):
            above = nodes[stack[depth]].tag
            if tag in CLOSES.get(above, ()):
                close(depth)
                break
            if above in BLOCK and above not in CLOSES or tag in BLOCK and above in BOUND["p"]:
                break
        if tag in ("html", "body") and any(nodes[k].tag == tag for k in stack):
            continue
        parent = nodes[stack[-1]]
        attributes = _attributes(rest) if rest.strip(" /\n\t\r") else {}
        classes = ".".join(sorted(re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split()))
        inside = parent.heads_only or tag == "header"
        banned = parent.out or _unwanted(tag, attributes)
        if tag == "header" and not banned:
            around = [nodes[k].tag for k in stack]
            banned = not ("article" in around or "main" in around)
        nodes.append(Node(tag, f"{parent.path}/{tag}{'.' if classes else ''}{classes}", stack[-1], banned, inside))
        if rest.rstrip().endswith("/") and tag in ("svg", "path", "iframe"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(len(nodes) - 1)
        in_link += tag == "a"
    flush()
    for node, text, links in out.blocks:
        weight = (len(text) - links) + 25 * (len(text) >= 80 and not links)
        holder = node if nodes[node].tag in CONTAINER else nodes[node].parent
        for share in (1.0, 0.5):
            while holder > 0 and nodes[holder].tag not in CONTAINER:
                holder = nodes[holder].parent
            if holder <= 0:
                break
            nodes[holder].score += share * weight
            holder = nodes[holder].parent
    return out


def best_container(page: Page) -> int:
    """The node with the highest score; an article or main around it takes its place."""
    best, top = 0, 0.0
    for k, node in enumerate(page.nodes):
        score = node.score * (1.5 if node.tag in ("article", "main") else 1.0)
        if score > top:
            best, top = k, score
    at = best
    while at > 0:
        if page.nodes[at].tag == "article" or page.nodes[at].tag == "main" and page.nodes[best].tag != "article":
            best = at
        at = page.nodes[at].parent
    return best


def text_at(page: Page, path: str | None) -> str:
    """Blocks inside the nodes at ``path``; without one, inside the best container."""
    roots = {k for k, node in enumerate(page.nodes) if path and node.path == path}
    if not roots:
        roots = {best_container(page)}
    inside: list[bool] = []
    for k, node in enumerate(page.nodes):
        inside.append(k in roots or (node.parent >= 0 and inside[node.parent]))
    return "\n".join(text for node, text, _ in page.blocks if inside[node])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, str], list[float]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parsed = parse(page or "")
            best = best_container(parsed)
            if best > 0:
                vote = found.setdefault((host, parsed.nodes[best].path), [0, 0.0])
                vote[0] += 1
                vote[1] += parsed.nodes[best].score
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()), pa.array([int(v[0]) for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.float64())],
            names=["host", "path", "votes", "score"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts = [text_at(parse(page), path) if page else "" for page, path in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): where each host's pages have their article."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, votes long, score double")
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.round(F.sum("score"), 3).alias("score"))
    # The least of (-votes, -score, path) is the path with most votes.
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")).alias("m")).select("host", "m.path")


def extract(pages: DataFrame, max_sent_hosts: int = MAX_SENT_HOSTS) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    paths = cut(host_paths(rows), "host-paths")
    if paths.limit(max_sent_hosts + 1).count() <= max_sent_hosts:
        paths = F.broadcast(paths)  # checked: at most max_sent_hosts rows
    return rows.join(paths, "host", "left").select("page_id", "url", "html", "path").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
