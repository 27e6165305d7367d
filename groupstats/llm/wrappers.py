"""Main text of web pages by wrapper induction: pages of a host are aligned, what stays the same is template.

1. Pages of a host are told apart by layout, the set of their structural tags with classes. Every layout of a host with
   enough pages has an example, one of its pages; rarer layouts are aligned with the host's most frequent one.
2. Every page's tree is aligned with its example by simple tree matching: the largest set of matched nodes that
   keeps tags, order and descent. Siblings of the same shape in a row are matched in order, so that long lists cost little.
3. Runs of text of the example are counted over its pages: how many match them, and how many with the same text.
   A page that has more than half of its matched text in common with the example is a copy of it and no evidence, and
   pages with the same content count once. Text that is the same in most pages is template; slots whose text varies are content.
4. A page's text is what lies in its content: inside its article or main elements if it has any, else inside the
   smallest element that holds most of the varying text; without template text, and without
   elements whose tag or role says that they are menus, headers, footers, sidebars, notices, adverts, forms,
   scripts, styles or reader comments. Names of classes only support this: a whole name must say so (``sidebar``, not
   ``has-sidebar``), and no heading and no element that holds an article, or most of the varying text, goes by its name.

Nothing here recurses, so nesting may be of any depth. The result does not depend on how pages are partitioned.

Pages never shuffle unless the examples, one page a layout, measure too large to broadcast; then pages are dealt by host, layout
and a salt, so a host may hold any share of them. One short row a page (which slots matched) is shuffled to count contents once.

NULL pages are empty; pages without host form a host of their own. Pages with the same id are separate rows. Other columns
are carried along, whatever their names; a column ``text`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from groupstats.llm.dom import BLOCK, Node, describe, parse, plain
from groupstats.session import shared_folder

#: Pages that must differ from the example before its text can be template, and the share that must agree.
EVIDENCE, AGREE = 3, 0.8
#: Pages that a layout needs for an example of its own.
LAYOUT_PAGES = 2 * (EVIDENCE + 1)
#: Bytes of all examples up to which they are broadcast; beyond, pages are dealt by host, layout and salt.
BROADCAST_BYTES = 32 << 20
SALTS = 64

#: Elements, roles and names of classes that are not main text (fixed values).
NOT_TEXT = frozenset(
    "head title script style noscript template nav footer aside button select option optgroup textarea input label "
    "fieldset iframe object embed svg canvas audio video menu dialog".split()
)
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
NOT_WORDS = COMMENTS | frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar sidebars rail aside ad ads adv advert adverts "
    "advertisement advertisements advertising adbox adslot banner sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations search searchbox widget widgets pagination pager copyright "
    "skip toolbar toc tags teaser outbrain taboola".split()
)
#: Words that say nothing by themselves beside one of the above.
FILL_WORDS = frozenset("site global top bottom left right upper lower box bar area list item items link links wrap wrapper container inner block form slot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[a-z]+").findall


def _named(node: Node, words: frozenset[str]) -> bool:
    """Whether a whole name in class or id is made of ``words``, with nothing but fill words beside them."""
    for mark in ("class", "id"):
        for name in node.marks.get(mark, "").split():
            parts = _WORDS(name)
            if any(w in words for w in parts) and all(w in words or w in FILL_WORDS for w in parts):
                return True
    return False


def _is_root(node: Node) -> bool:
    return node.tag in ("article", "main") or node.marks.get("role") == "main" or node.marks.get("itemprop") == "articlebody"


def _surely_not_text(node: Node, in_article: bool) -> bool:
    """Whether tag, role or state of an element says that it is not main text, or that it holds comments."""
    tag, marks = node.tag, node.marks
    if tag in NOT_TEXT or (tag == "header" and not in_article):
        return True
    if not marks:
        return False
    if "hidden" in marks or tag in ("html", "body"):
        return "hidden" in marks
    if marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", ""):
        return True
    if tag == "main":
        return False
    return (tag != "article" and marks.get("role") in NOT_ROLES) or _named(node, COMMENTS)


def boilerplate(order: list[Node], varying: set[int]) -> tuple[list[bool], list[int]]:
    """Which elements are not main text, and how much text outside links each holds (varying text only, if there is any)."""
    n = len(order)
    gone, out, linked, in_article = [False] * n, [False] * n, [False] * n, [False] * n
    for node in order[1:]:
        i, up = node.number, node.parent.number
        in_article[i] = in_article[up] or order[up].tag in ("article", "main")
        linked[i] = linked[up] or node.tag == "a"
        gone[i] = node.tag != "#text" and _surely_not_text(node, in_article[i])
        out[i] = out[up] or gone[i]
    weights, holds = [0] * n, [False] * n
    for node in reversed(order[1:]):
        i, up = node.number, node.parent.number
        if out[i]:
            continue
        if node.tag == "#text" and not linked[i] and (not varying or i in varying):
            weights[i] = len(plain(node.text))
        holds[i] = holds[i] or _is_root(node)
        weights[up] += weights[i]
        holds[up] = holds[up] or holds[i]
    total = weights[0]
    for node in order[1:]:
        i = node.number
        if gone[i] or holds[i] or 2 * weights[i] > total or node.tag in HEADINGS or node.tag in ("html", "body"):
            continue
        gone[i] = node.tag == "form" or (bool(node.marks) and _named(node, NOT_WORDS))
    return gone, weights


# ----------------------------------------------------------------- alignment


def match_trees(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of matched nodes of two described trees (simple tree matching)."""
    known: dict[tuple[int, int], int] = {}

    def runs(children: list[Node]) -> list[list[Node]]:
        out: list[list[Node]] = []
        for c in children:
            if out and out[-1][0].shape == c.shape:
                out[-1].append(c)
            else:
                out.append([c])
        return out

    def alike(x: Node, y: Node) -> bool:
        return x.tag == y.tag and x.marks.get("class") == y.marks.get("class")

    def weight(x: Node, y: Node) -> int:
        if x.shape == y.shape:
            return x.size
        return known[x.shape, y.shape] if alike(x, y) else 0

    def table(x: list[list[Node]], y: list[list[Node]]) -> list[list[int]]:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x, 1):
            row, above = best[i], best[i - 1]
            for j, q in enumerate(y, 1):
                value = above[j - 1] + min(len(p), len(q)) * weight(p[0], q[0])
                row[j] = max(value, above[j], row[j - 1])
        return best

    # weights from the leaves up: a pair waits on the stack until all pairs of its children are known
    waiting = [(a, b, False)] if a.shape != b.shape else []
    while waiting:
        x, y, ready = waiting.pop()
        key = (x.shape, y.shape)
        if key in known:
            continue
        p, q = runs(x.children), runs(y.children)
        if ready:
            known[key] = 1 + table(p, q)[-1][-1]
            continue
        waiting.append((x, y, True))
        for u in p:
            for v in q:
                if u[0].shape != v[0].shape and alike(u[0], v[0]) and (u[0].shape, v[0].shape) not in known:
                    waiting.append((u[0], v[0], False))

    pairs = []
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        if x.shape == y.shape:
            stack.extend(zip(x.children, y.children))
            continue
        p, q = runs(x.children), runs(y.children)
        best = table(p, q)
        i, j = len(p), len(q)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                stack.extend(zip(p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
    return pairs


def text_pairs(example: Node, page: Node) -> list[tuple[Node, Node, bool]]:
    """Matched runs of text that are not blank, and whether they are the same."""
    out = []
    for x, y in match_trees(example, page):
        if x.tag == "#text" == y.tag:
            s, t = plain(x.text), plain(y.text)
            if s and t:
                out.append((x, y, s == t))
    return out


# ------------------------------------------------------------------- content


def content_roots(page: Node, gone: list[bool], weights: list[int]) -> list[Node]:
    """The elements that hold the main text: articles, else main elements, else the smallest one with most of the text."""
    named = _below(page, _is_root, gone)
    if named:
        inner = []
        for n in named:
            articles = _below(n, lambda c: c.tag == "article", gone) if n.tag != "article" else []
            inner.extend(articles or [n])
        return inner
    total = weights[0]
    here = page
    while True:
        inner_ = [c for c in here.children if c.tag in BLOCK and not gone[c.number] and weights[c.number] > 0.7 * total]
        if not inner_ or total == 0 or inner_[0].tag in ("p", "li", "h1", "h2", "h3"):
            return [here]
        here = inner_[0]


def _below(node: Node, wanted: Callable[[Node], bool], gone: list[bool]) -> list[Node]:
    """The topmost wanted elements below one, outside boilerplate, in page order."""
    out, stack = [], list(reversed(node.children))
    while stack:
        n = stack.pop()
        if gone[n.number]:
            continue
        if wanted(n):
            out.append(n)
        else:
            stack.extend(reversed(n.children))
    return out


def main_text(order: list[Node], template: set[int], varying: set[int]) -> str:
    """Blocks of the content, without template and boilerplate, joined by line breaks."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = plain("".join(run))
        run.clear()
        if text:
            blocks.append(text)

    gone, weights = boilerplate(order, varying)
    for root in content_roots(order[0], gone, weights):
        stack: list[tuple[Node, bool]] = [(root, False)]
        while stack:
            node, done = stack.pop()
            if done:
                flush()
            elif node.tag == "#text":
                if node.number not in template:
                    run.append(node.text)
            elif node.tag in ("br", "td", "th"):
                run.append(" ")
                stack.extend((c, False) for c in reversed(node.children))
            elif node is root or not gone[node.number]:
                if node.tag in BLOCK:
                    flush()
                    stack.append((node, True))
                stack.extend((c, False) for c in reversed(node.children))
            elif node.tag in BLOCK:
                flush()
        flush()
    return "\n".join(blocks)


# ----------------------------------------------------------------------- jobs


class Examples:
    """Parsed example pages, remembered by the task."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, int], tuple[str, Node]] = {}

    def of(self, key: tuple[str, int], source: str) -> Node:
        held = self.known.get(key)
        if held is None or held[0] != source:
            if len(self.known) > 256:
                self.known.clear()
            root = parse(source)
            describe(root)
            held = self.known[key] = source, root
        return held[1]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(host, layout, page, slots)``: twice the number of each matched run of text of the example, plus 1 if it is the same."""
    examples = Examples()
    seen: set[tuple[str, int, int]] = set()
    names = ["_host", "_layout", "_hash"]
    for batch in batches:
        keys, slots = [], []
        columns = (batch.column(n).to_pylist() for n in (*names, "_html", "_example"))
        for host, layout, content, source, example in zip(*columns):
            key = (host, layout, content)
            if source == example or key in seen:  # copies met by the task; those of other tasks go after the shuffle
                continue
            if len(seen) > 500_000:
                seen.clear()
            seen.add(key)
            page = parse(source)
            describe(page)
            pairs = text_pairs(examples.of((host, layout), example), page)
            same = sum(len(plain(y.text)) for _, y, s in pairs if s)
            if 2 * same > sum(len(plain(y.text)) for _, y, _ in pairs):
                continue
            keys.append(key)
            slots.append([2 * x.number + s for x, _, s in pairs])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
                pa.array([k[2] for k in keys], pa.int64()), pa.array(slots, pa.list_(pa.int32())),
            ],
            [*names, "slots"],
        )


def _layout_of(html: str):
    """A number for the set of structural tags of a page, with their classes; digits count as one."""
    tags = F.regexp_extract_all(F.lower(html), F.lit("<((?:body|main|article|section|nav|aside|header|footer|div)(?:\\s[^>]*)?)>"), F.lit(1))
    names = F.transform(
        tags,
        lambda t: F.regexp_replace(
            F.concat_ws(".", F.regexp_extract(t, "^[a-z]+", 0), F.regexp_extract(t, "\\sclass\\s*=\\s*[\"']?([^\"'>]*)", 1)), "[0-9]+", "0"
        ),
    )
    return F.xxhash64(F.array_sort(F.array_distinct(names)))


def extract(df: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append ``text``, the main text of each page; ``keep`` lists the columns to carry along (all but the page by default)."""
    keep = [c for c in df.columns if c not in (html, "text")] if keep is None else keep
    spark = df.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), "^[^:/?#]*:?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    source = F.coalesce(F.col(html).cast("string"), F.lit(""))
    carried = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    pages = df.select(*carried, host.alias("_host"), source.alias("_html")).withColumn("_own", _layout_of("_html"))
    # of every layout the page of the least hash, never an empty one
    found = pages.filter("_html != ''").groupBy("_host", "_own").agg(
        F.count("*").alias("n"), F.min_by("_html", F.struct(F.xxhash64("_html"), "_html")).alias("_example")
    )
    path = shared_folder(spark, "layouts")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    main = found.groupBy("_host").agg(F.max_by("_own", F.struct("n", "_own")).alias("_main"))
    # which layout's example a layout uses
    layout = F.when(F.col("n") >= LAYOUT_PAGES, F.col("_own")).otherwise(F.col("_main"))
    uses = found.select("_host", "_own", "n").join(main, "_host").select("_host", "_own", layout.alias("_layout"))
    uses_path = shared_folder(spark, "layout-uses")
    uses.write.parquet(uses_path)
    uses = spark.read.parquet(uses_path)
    own = uses.filter("_own = _layout").select("_host", "_layout")
    picked = found.select("_host", F.col("_own").alias("_layout"), "_example").join(own, ["_host", "_layout"])
    picked_path = shared_folder(spark, "examples")
    picked.write.parquet(picked_path)
    picked = spark.read.parquet(picked_path)
    size = picked.agg(F.sum(F.octet_length("_example"))).first()[0] or 0
    pairs = uses.count()

    def salted(rows: DataFrame, table: DataFrame, keys: list[str], small: bool) -> DataFrame:
        if small:
            return rows.join(F.broadcast(table), keys, "left")
        spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int"))
        return dealt.join(spread, [*keys, "_salt"], "left").drop("_salt")

    def attach(rows: DataFrame, table: DataFrame) -> DataFrame:
        named = salted(rows, uses, ["_host", "_own"], pairs * 128 <= BROADCAST_BYTES)
        return salted(named, table, ["_host", "_layout"], size <= BROADCAST_BYTES)

    slots = (
        attach(pages.select("_host", "_own", "_html"), picked).filter("_example IS NOT NULL")
        .select("_host", "_layout", F.xxhash64("_html").alias("_hash"), "_html", "_example")
        .mapInArrow(_slots, "_host string, _layout long, _hash long, slots array<int>")
        .groupBy("_host", "_layout", "_hash").agg(F.first("slots").alias("slots"))  # equal contents have equal slots
        .select("_host", "_layout", F.explode("slots").alias("slot"))
    )
    counts = slots.groupBy("_host", "_layout", F.expr("slot div 2").cast("int").alias("node")).agg(
        F.count("*").alias("seen"), F.sum(F.col("slot") % 2).alias("same")
    )
    constant = (F.col("seen") >= EVIDENCE) & (F.col("same") >= AGREE * F.col("seen"))
    fixed = counts.groupBy("_host", "_layout").agg(
        F.collect_list(F.when(constant, F.col("node"))).alias("_fixed"), F.collect_list(F.when(~constant, F.col("node"))).alias("_free")
    )
    wrappers = picked.join(fixed, ["_host", "_layout"], "left")
    wrappers_path = shared_folder(spark, "wrappers")
    wrappers.write.parquet(wrappers_path)
    rows = attach(pages, spark.read.parquet(wrappers_path))
    kept = [f for f in pages.schema.fields if f.name.startswith("kept_")]
    schema = StructType([*[StructField(c, f.dataType, f.nullable) for c, f in zip(keep, kept)], StructField("text", StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = Examples()
        for batch in batches:
            texts = []
            columns = (batch.column(n).to_pylist() for n in ("_host", "_layout", "_html", "_example", "_fixed", "_free"))
            for own, layout, source, example, fixed, free in zip(*columns):
                page = parse(source)
                order = describe(page)
                template: set[int] = set()
                varying: set[int] = set()
                if fixed or free:
                    fixed_set, free_set = set(fixed or ()), set(free or ())
                    for x, y, same in text_pairs(examples.of((own, layout), example), page):
                        if x.number in fixed_set and same:
                            template.add(y.number)
                        elif x.number in free_set or not same:
                            varying.add(y.number)
                texts.append(main_text(order, template, varying))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
