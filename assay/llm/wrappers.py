"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

Every page is an expression over its tokens (``markup``). Pages of one host are aligned: what both have is matched, text that
differs is a slot, a mismatch becomes optional or repeated. Slots carry the pages, characters, linked characters and the one text,
if it is one, that were seen in them. Alignment is a reduction: a task merges the pages alike that it reads, then groups of at most
SHAPES expressions of a host are merged, in rounds, until each host has one wrapper. So no host passes through one task.

A second reading matches each page against its host's wrapper, which tells the slots of main text: those inside article (or
main) elements where the page has one; else all but those whose text is one on at least SAME_PAGES pages of the host, and those
mostly of links. Slots within navigation, headers, footers, asides, forms, notices, adverts and comments, told by element, role, class or
id, are never main text. Pages of one shape and host are matched once a task.

Blocks end at every element that is not inline; white space within is one space, blocks are joined by one space. A null or empty page has
an empty text; a null or odd url is the host ``''``. Repeated pages are pages each. An empty table gives an empty result; columns other
than page_id, url and html are ignored. Pages of any length are read whole; elements nested deeper than 100 are not told apart.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, saved, table
from .markup import Node, merged, parse

SAME_PAGES = 3
#: Expressions that one task merges, and shapes that a task keeps.
SHAPES, KEPT = 500, 2_000
#: Wrappers of up to so many bytes in all are broadcast; larger ones are joined to the pages.
SENT = 16 << 20

# fixed values: elements, roles and words of classes and ids that are not main text
APART = frozenset("nav footer aside form button select option textarea fieldset dialog menu noscript template object canvas svg audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu masthead topbar footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice alert notification newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies related recommended share sharing social breadcrumb breadcrumbs "
    "pagination pager widget popup modal overlay toolbar search skip copyright disclaimer".split()
)
FRAMES = frozenset("html body main article".split())
OF_ARTICLE = frozenset("entry post article title".split())


def _said(label: str) -> tuple[str, dict[str, str]]:
    tag, *rest = re.split(r" (?=(?:class|hidden|id|itemprop|role)=)", label)
    return tag, dict(x.split("=", 1) for x in rest)


@functools.lru_cache(maxsize=100_000)
def apart(label: str, in_article: bool = False) -> bool:
    """Whether an element is not main text, whatever is in it."""
    tag, said = _said(label)
    if tag in APART or said.get("role") in ROLES or "hidden" in said or said.get("itemprop") == "comment":
        return True
    if tag == "header" and not in_article:
        return True
    names = f"{said.get('class', '')} {said.get('id', '')}".split()
    parts = [re.findall(r"[a-z]+", x) for x in names]
    if tag in FRAMES:
        return tag == "article" and any(set(p) & {"comment", "reply", "related", "recommended", "ad", "advert", "sponsored", "promo"} for p in parts)
    for p in parts:
        if set(p) & {"with", "has", "no"}:
            continue
        if set(p) & WORDS or "header" in p and not in_article and not set(p) & OF_ARTICLE:
            return True
    return False


def is_main(label: str) -> str:
    """``article`` or ``main`` where an element says that it holds the main text."""
    tag, said = _said(label)
    if tag == "article" or said.get("itemprop") == "articlebody" or said.get("role") == "article":
        return "article"
    return "main" if tag == "main" or said.get("role") == "main" else ""


def main_blocks(wrapper: Node) -> set[int]:
    """The blocks of main text of the page whose slots are in ``wrapper``."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "": []}

    def walk(node: Node, kind: str) -> None:
        for kid in node.kids:
            if kid.label == "#":
                if kid.blocks:
                    found[kind].append(kid)
            elif kid.label == "()":
                walk(kid, kind)
            elif not apart(kid.label, kind == "article"):
                own = is_main(kid.label)
                walk(kid, "article" if "article" in (kind, own) else own or kind)

    walk(wrapper, "")
    if found["article"] or found["main"]:
        return {b for slot in found["article"] or found["main"] for b in slot.blocks}
    varies = any(s.text is None for s in wrapper.slots())
    template = lambda s: varies and s.text is not None and s.pages > SAME_PAGES  # noqa: E731  (the page itself has been counted before)
    return {b for s in found[""] if not template(s) and 2 * s.linked <= s.chars for b in s.blocks}


def host(url: str = "url") -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[^:/?#]*:?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _batches(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=schema)


def shapes(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the pages alike that a task reads, merged."""
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, str], Node] = {}
        for b in batches:
            for name, page in zip(b.column(0), b.column(1), strict=True):
                tree, _ = parse(page.as_py() or "", apart)
                key = (name.as_py(), tree.shape())
                kept[key] = merged(kept[key], tree, True) if key in kept else tree
                kept[key].kids = _bare(kept[key].kids)
            if len(kept) > KEPT:
                yield _batches([(k[0], json.dumps(t.dump())) for k, t in kept.items()], schema.names, schema)
                kept = {}
        yield _batches([(k[0], json.dumps(t.dump())) for k, t in kept.items()], schema.names, schema)

    return map_texts(pages.select(host().alias("host"), F.col("html").cast("string")), read, "host string, wrapper string")


def _bare(nodes: list[Node]) -> list[Node]:
    """Without the blocks of a page."""
    for n in nodes:
        n.blocks = ()
        _bare(n.kids)
    return nodes


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one of each host, as JSON."""
    rows = saved(shapes(pages), "shapes")

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        own = [Node.load(json.loads(w)) for w in sorted(group["wrapper"])]
        return pd.DataFrame({"host": group["host"].iloc[:1].tolist(), "wrapper": [json.dumps(functools.reduce(lambda a, b: merged(a, b, True), own).dump())]})

    while (most := rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // SHAPES)
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(groups)))
        rows = saved(dealt.groupBy("host", "part").applyInPandas(reduce, "host string, wrapper string"), "wrappers")
    return rows


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text."""
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    wrappers = infer(pages)
    small = (wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= SENT
    sent = pages.sparkSession.sparkContext.broadcast(dict(wrappers.collect())) if small else None
    rows = pages.withColumn("host", host())
    rows = rows.withColumn("wrapper", F.lit(None).cast("string")) if small else rows.join(wrappers, "host", "left")
    rows = rows.select("page_id", "url", "html", "host", "wrapper")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper = functools.lru_cache(maxsize=256)(lambda w: Node.load(json.loads(w)))
        known: dict[tuple[str, str], list[bool]] = {}
        for b in batches:
            texts = []
            for page, name, own in zip(b.column(2), b.column(3).to_pylist(), b.column(4), strict=True):
                tree, blocks = parse(page.as_py() or "", apart)
                key = (name, tree.shape())
                if key not in known:
                    known.pop(next(iter(known)), None) if len(known) >= KEPT else None
                    main = main_blocks(merged(wrapper(sent.value[name] if sent else own.as_py()), tree, True))
                    known[key] = [any(i in main for i in s.blocks) for s in tree.slots()]
                chosen = sorted(i for s, keep in zip(tree.slots(), known[key], strict=True) if keep for i in s.blocks)
                texts.append(" ".join(blocks[i] for i in chosen))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    types = dict(rows.dtypes)
    return map_texts(rows, read, f"page_id {types['page_id']}, url {types['url']}, text string")


#: Of these tables' pages, all of which have one article element: its blocks, decoded.
OP12_SQL = r"""
WITH inner_ AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1), '') AS x FROM pages),
spaced AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM inner_),
plain AS (SELECT page_id, url, replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM spaced),
texts AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
