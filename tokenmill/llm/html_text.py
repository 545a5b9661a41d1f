"""Main text of HTML pages by tag-path ratios.

A page is read as a sequence of text nodes, each under its root-to-leaf tag
path.  Per path the text is turned into two ratios (characters per node,
averaged over characters, and punctuation per text); both are smoothed towards
the values of the path's parent and fused into one score, which names weigh:
an article or main element, or a name such as content, raises it, names of
menus, footers, adverts or comments lower it, and so do lists of links.  Paths
whose score reaches a share of the page's best are content, wherever they are.
Short blocks (headings, list items, cells) below a content root stay: they are
smoothed towards the root's best path, unless a name below the root or their
links lower them.

Pages are independent rows, so the job is one pass over the table without a
shuffle.  Defined results: null and empty html give an empty text; broken
markup (unclosed or stray tags, a page cut in the middle of a tag) is read as
far as it goes; every row gives one row, repeated ones too.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import table
from tokenmill.llm.registry import query

# --- fixed values: names of HTML elements and of the usual parts of a page ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset(
    "head nav menu footer aside form button select fieldset dialog label script style textarea title noscript template "
    "svg math iframe object canvas".split()
)
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification pagination pager popup popups privacy promo promos promotion related respond search share "
    "sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription teaser toc toolbar widget "
    "widgets complementary contentinfo alert alertdialog".split()
)
#: Of these only the weight falls: long text with punctuation stays.
SOFT = frozenset("form fieldset dialog label".split())
SOFT_WORDS = frozenset("banner form login modal notice notices search social teaser toolbar widget widgets alert alertdialog".split())
#: These say nothing inside an article, main or content element.
TOP_WORDS = frozenset("header masthead".split())
INSIDE_WORDS = frozenset("article body content entry main post story text".split())
#: Of these elements only a few names say that they are not main text.
KEPT = frozenset("article main body html".split())
KEPT_OUTSIDE = frozenset("comment comments related respond teaser sponsored promo ad ads advert".split())
CLOSES_P = BLOCK - {"html", "body", "head"}
#: Elements that an opening tag of the same family ends where their own end tag is left out.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ROOTS = frozenset("article main".split())
CONTAINERS = frozenset("html body div section article main center table tbody tr td form blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = re.compile(r"[.,;:!?。，！？…]")
# --- end of fixed values ---

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
LAYOUT = re.compile(r"(?:^|[^a-z])(?:has|with|no|without)[-_ ]+[a-z]+")  # "content-with-sidebar" is not a sidebar
SPACES = re.compile(r"\s+")
SMOOTH = 0.3
THRESHOLD = 0.15
LONGEST = 120
RAISED, SOFTENED, LOWERED = 5.0, 0.3, 0.02
MARKED = "!?^+"


def _named(tag: str, attributes: str) -> str:
    """The mark of an element by its own names: one of ``MARKED``, or nothing."""
    found: set[str] = set()
    hidden = inside = False
    for key, a, b, c in NAMED.findall(attributes):
        value = (a or b or c).lower()
        key = key.lower()
        if key == "hidden" or key == "aria-hidden":
            hidden |= key == "hidden" or value == "true"
            continue
        words = set(re.split(r"[^a-z]+", LAYOUT.sub(" ", value)))
        found |= words & (OUTSIDE_WORDS if tag not in KEPT else KEPT_OUTSIDE)
        inside |= bool(words & INSIDE_WORDS)
    if hidden or found - SOFT_WORDS - TOP_WORDS:
        return "!"
    return "?" if found & SOFT_WORDS else "^" if found else "+" if inside else ""


def text_nodes(page: str) -> list[tuple[tuple[str, ...], int, str]]:
    """(tag path, number of the block, decoded text) in page order.

    A step of a path is the tag, with ``!`` before it where the element is
    named as outside the main text, ``?`` where it may be, ``^`` where it is
    named as the head of something and ``+`` where it is named as inside.
    """
    out: list[tuple[tuple[str, ...], int, str]] = []
    path: list[str] = []
    names: list[str] = []
    block, at = 0, 0
    size = len(page)

    def text(raw: str) -> None:
        if raw:
            out.append((tuple(path), block, html.unescape(raw)))

    def close(depth: int) -> None:
        nonlocal block
        if any(n in BLOCK for n in names[depth:]):
            block += 1
        del names[depth:], path[depth:]

    while at < size:
        found = page.find("<", at)
        if found < 0:
            text(page[at:])
            break
        text(page[at:found])
        m = TOKEN.match(page, found)
        if m is None:  # a lone "<" is text
            text("<")
            at = found + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for depth in range(len(names) - 1, -1, -1):
                if names[depth] == name:
                    close(depth)
                    break
                if names[depth] in BLOCK and name not in BLOCK:
                    break  # an inline end tag does not reach out of its block
            else:
                if name == "p":
                    block += 1
            continue
        if name == "br":
            text(" ")
            continue
        if name in VOID:
            block += name == "hr"
            continue
        if name in CLOSES_P and "p" in names:
            close(len(names) - 1 - names[::-1].index("p"))
        if name in SAME:
            for depth in range(len(names) - 1, -1, -1):
                if names[depth] in SCOPE[name]:
                    break
                if names[depth] in SAME[name]:
                    close(depth)
                    break
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            if end:
                stop = page.find(">", at)
                at = size if stop < 0 else stop + 1
            continue
        if m[3].rstrip().endswith("/") and name not in BLOCK:
            continue
        mark = _named(name, m[3])
        if name in BLOCK:
            block += 1
        names.append(name)
        path.append(mark + name)
    return out


def _inside(step: str) -> bool:
    return step[0] == "+" or step.lstrip(MARKED) in ROOTS


def _lowering(path: tuple[str, ...]) -> dict[int, float]:
    """The steps of a path (by index) whose names lower it, with their factors."""
    out, raised = {}, False
    for i, step in enumerate(path):
        plain = step.lstrip(MARKED)
        if step[0] == "!" or plain in OUTSIDE - SOFT:
            out[i] = LOWERED
        elif step[0] == "?" or plain in SOFT or not raised and (step[0] == "^" or plain == "header"):
            out[i] = SOFTENED
        elif _inside(step):
            raised = True
    return out


def _weights(fused: dict[tuple[str, ...], float], count: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], tuple[float, int]]:
    """Factor of every path by the names of its steps, and the depth from which on none of them lowers it.

    A step that holds most of the page's fused score is no part beside the
    main text but the page or its text itself: its name does not count.
    A soft name is left out of the score it is judged by.
    """
    lowering = {p: _lowering(p) for p in fused}
    raised = {p: any(i not in lowering[p] and _inside(s) for i, s in enumerate(p)) for p in fused}
    around: set[tuple[str, ...]] = set()
    while True:
        weight = {}
        held: dict[tuple[str, ...], float] = defaultdict(float)
        of: dict[tuple[str, ...], float] = {}
        for p, steps in lowering.items():
            left = {i: f for i, f in steps.items() if p[: i + 1] not in around}
            weight[p] = math.prod(left.values()) * (RAISED if raised[p] else 1), max(left, default=-1) + 1
            for i, f in left.items():
                held[p[: i + 1]] += fused[p] * count[p] * weight[p][0]
                of[p[: i + 1]] = f
        every = sum(fused[p] * count[p] * w for p, (w, _) in weight.items())
        more = {q for q, v in held.items() if (own := v / of[q] if of[q] == SOFTENED else v) > 0.5 * (every - v + own)}
        if not more:
            return weight
        around |= more


def content_paths(nodes: list[tuple[tuple[str, ...], int, str]]) -> set[tuple[str, ...]]:
    """The content paths of a page: those whose fused score reaches the threshold."""
    length: dict[tuple[str, ...], int] = defaultdict(int)
    squares: dict[tuple[str, ...], int] = defaultdict(int)
    marks: dict[tuple[str, ...], int] = defaultdict(int)
    count: dict[tuple[str, ...], int] = defaultdict(int)
    for path, _, text in nodes:
        n = len(SPACES.sub(" ", text).strip())
        if n:
            length[path] += n
            squares[path] += n * n
            marks[path] += len(MARKS.findall(text))
            count[path] += 1
    paths = list(length)
    if not paths:
        return set()


    def ratios(n: int, square: int, mark: int) -> tuple[float, float]:
        return min(square / max(1, n), LONGEST), min(mark / max(1, n) * 100, 4.0)

    def fuse(text_ratio: float, mark_ratio: float) -> float:
        return text_ratio * (1 + mark_ratio / 4)

    weight = _weights({p: fuse(*ratios(length[p], squares[p], marks[p])) for p in paths}, count)

    # ratios of a path, smoothed towards those of its parent and fused
    total: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0, 0])
    for p in {q[:-1] for q in paths}:
        total[p] = [0, 0, 0]
    for p in paths:
        for d in range(weight[p][1], len(p) + 1):
            if p[:d] in total:
                for k, v in enumerate((length[p], squares[p], marks[p])):
                    total[p[:d]][k] += v

    score = {}
    for p in paths:
        own, parent = ratios(length[p], squares[p], marks[p]), ratios(*total[p[:-1]])
        text_ratio, mark_ratio = ((1 - SMOOTH) * a + SMOOTH * b for a, b in zip(own, parent))
        score[p] = fuse(text_ratio, mark_ratio) * weight[p][0]
    linked = {p: _link_share(p, length) for p in paths}
    score = {p: v * (1 - linked[p]) for p, v in score.items()}
    top = max(score.values())
    strong = {p for p in paths if score[p] >= THRESHOLD * top}

    # content roots: the container that holds the most strong text, and those of the strong paths that are elsewhere or named
    held: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0])
    for p in paths:
        for d in range(len(p) + 1):
            if (d == 0 or p[d - 1].lstrip(MARKED) in CONTAINERS) and (p in strong or d >= weight[p][1]):
                held[p[:d]][p not in strong] += length[p]
    every = max(1, held[()][0])
    best = max(held, key=lambda q: (held[q][0] - 0.5 * held[q][1]) / every + 0.01 * len(q))
    roots: dict[tuple[str, ...], float] = defaultdict(float)
    for p in strong:
        inside = next((i + 1 for i, s in enumerate(p) if _inside(s)), 0)
        if p[: len(best)] == best:
            roots[best] = max(roots[best], score[p])
        elif not inside:
            inside = max((i + 1 for i, s in enumerate(p) if s.lstrip(MARKED) in CONTAINERS), default=len(p))
        if inside:
            roots[p[:inside]] = max(roots[p[:inside]], score[p])

    # a path below a root is smoothed towards the root's best path, unless its own names or links lower it
    def fused(p: tuple[str, ...]) -> float:
        near = [v for d in range(weight[p][1], len(p) + 1) if (v := roots.get(p[:d])) and linked[p] < 0.5]
        return max([score[p], *near])

    return {p for p in paths if fused(p) >= THRESHOLD * top}


def _link_share(path: tuple[str, ...], length: dict[tuple[str, ...], int]) -> float:
    """How far a path is a list of links: 1 if the element around its link has no text of its own."""
    at = next((i for i, s in enumerate(path) if s.lstrip(MARKED) == "a"), None)
    plain = {s.lstrip(MARKED) for s in path[:at]}
    if at is None or plain & (ROOTS | HEADINGS):
        return 0.0
    return 1 - min(1.0, 2 * length.get(path[:at], 0) / length[path])


def main_text(page: str | None) -> str:
    nodes = text_nodes(page or "")
    content = content_paths(nodes)
    blocks: list[str] = []
    current, parts = None, []
    for path, block, text in nodes:
        if path not in content:
            continue
        if block != current:
            blocks.append("".join(parts))
            current, parts = block, []
        parts.append(text)
    blocks.append("".join(parts))
    return "\n".join(b for b in (SPACES.sub(" ", x).strip() for x in blocks) if b)


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html column."""
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    source = pages.select(*kept, F.col(column).alias("_html"))
    fields = [f for f in source.schema.fields if f.name != "_html"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string", "n_chars bigint"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*kept, "text", "n_chars"],
                )

    return source.mapInArrow(work, schema)


@query("op10_html_text")
def op10_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
