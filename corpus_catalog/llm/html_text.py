"""Main text of web pages by a graphical model over the DOM tree.

Nodes are block elements and the text blocks in them; each is content or not. Every
node has a potential from its own features (a logistic regression) and each parent-child
pair one from how labels go together. The tree has no loops, so one upward and one
downward pass of messages give exact marginals; blocks with a marginal over one half
are the main text.

Both parts are trained from labelled pages: a few written below, which mark their main
text, and at most ``TRAIN_PAGES`` of the table that mark it themselves with
one ``article`` element. Marks are hidden from half of the training pages, and
boilerplate is moved into articles, so that text and structure count as well.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled pages of the table that the model is fitted on, at most.
TRAIN_PAGES = 300

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)
    |<(script|style|noscript|template|iframe|textarea|title|svg|math|xmp|object|select)\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\b[^>]*+>|\Z))
    |<[!?][^>]*+>
    |<(/?)([a-zA-Z][^\s/<>]*+)""",
    re.X | re.S | re.I,
)
_STOP = re.compile(r"""=\s*["']|[<>]""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Block elements, elements that end an open paragraph or item of their
#: kind, tags and names that tell boilerplate or main text.
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table "
    "caption thead tbody tfoot tr td th ul head".split()
)
ENDS_ITSELF = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
NOISE_TAGS = set("nav header footer aside form menu dialog fieldset legend button label".split())
MAIN_TAGS = {"article", "main"}
NOISE = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|menu\w*|nav\w*|breadcrumbs?|header|footer|foot|side|sidebar|aside|"
    r"widget|related|share|sharing|social|comments?|commentlist|disqus|repl(?:y|ies)|cookies?\w*|consent|gdpr|notice|alert|popup|modal|"
    r"newsletter|subscri\w+|login|signup|search\w*|form|pag(?:er|ination)|tags|legal|copyright|masthead|toolbar|"
    r"contentinfo|complementary|navigation|recommend\w*|trending|teaser|discussion|respond"
)
#: Names that tell boilerplate only if they stand alone, and beginnings that say what an element has, not what it is.
NOISE_ALONE = {"print", "skip", "tag"}
MODIFIERS = {"with", "without", "has", "no", "not", "is", "overflow", "hide", "show"}
MAIN = re.compile(
    r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|body|articlebody|text|page-?content|post-?content)(?=$|[\s_-])"
)


@dataclass
class Node:
    parent: int
    tag: str  # empty for a text block
    marks: str = ""
    text: str = ""
    linked: int = 0
    words: int = 0
    prose: int = 0  # words in paragraphs
    hidden: bool = False
    own: bool | None = None  # label written in a training page
    children: list[int] = field(default_factory=list)


def noisy(marks: str) -> bool:
    """Whether one of the names of an element is one of boilerplate, whole or by a part of it."""
    for name in marks.split():
        parts = re.split("[_-]+", name)
        if name in NOISE_ALONE or parts[0] not in MODIFIERS and any(NOISE.fullmatch(p) for p in parts):
            return True
    return False


class _Ends:
    """Finds where the tags of a page end; ``>`` in quoted values doesn't count. Reads each part of the page a few times at most."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}

    def after(self, at: int) -> int:
        """Place after the tag whose attributes begin at ``at``; -1 if another tag or nothing comes first."""
        while found := _STOP.search(self.page, at):
            mark = found[0][-1]
            if mark == ">":
                return found.end()
            if mark == "<":
                return -1
            # A quote that is never closed is a character like others.
            at = self.page.find(mark, found.end()) + 1 if self.last[mark] >= found.end() else found.end()
        return -1


def attributes(rest: str) -> dict[str, str]:
    """Names, in lower case, and values of a tag's attributes; of repeated ones the first."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), value.strip("\"'"))
    return found


def _is_hidden(own: dict[str, str]) -> bool:
    style = re.sub(r"\s", "", own.get("style", "")).lower()
    plain = own.get("hidden", "no").lower() not in ("no", "false", "until-found")
    return plain or own.get("aria-hidden", "").lower() == "true" or "display:none" in style


def parse(page: str) -> list[Node]:
    """The page's block elements and text blocks, parents before children, in page order."""
    nodes = [Node(-1, "html")]
    stack = [0]
    buffer: list[str] = []
    linked = link_depth = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
        if text and not any(nodes[i].tag == "head" for i in stack):
            nodes.append(Node(stack[-1], "", text=text, linked=min(linked, len(text)), words=len(text.split())))
            nodes[stack[-1]].children.append(len(nodes) - 1)
        buffer.clear()
        linked = 0

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    at = scan = 0
    ends = _Ends(page)
    while token := _TOKEN.search(page, scan):
        scan = token.end()
        ending, tag, rest = token[2], token[3], ""
        if tag:
            end = ends.after(scan)
            if end < 0:  # no tag after all
                continue
            rest, scan = page[scan : end - 1], end
        if token.start() > at:
            piece = page[at : token.start()]
            buffer.append(piece)
            if link_depth:
                linked += len(piece.strip())
        at = scan
        if not tag:
            if token[1]:
                buffer.append(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            link_depth = max(0, link_depth - 1) if ending else 1
        elif tag in ("br", "hr"):
            flush()
        elif tag in BLOCK or tag in ("button", "label"):
            if ending:
                place = next((i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag), None)
                if place:
                    close(place)
                else:
                    flush()
                link_depth = 0 if tag not in ("button", "label") else link_depth
                continue
            if tag in ("html", "body") and len(stack) > 1 and nodes[stack[-1]].tag != "head":
                flush()
                continue
            # An open paragraph, heading or item ends where a block that it can't hold begins.
            limits = ENDS_ITSELF.get(tag, set())
            for i in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[i]].tag
                if open_tag in ("p", "head") and tag not in ("button", "label"):
                    close(i)
                    break
                if limits and (open_tag == tag or {open_tag, tag} in ({"dt", "dd"}, {"td", "th"})):
                    close(i)
                    break
                if open_tag in limits or open_tag in ("table", "button") or not limits and open_tag in BLOCK:
                    break
            flush()
            if rest.rstrip().endswith("/") and tag in ("p", "div"):
                continue
            own = attributes(rest) if rest else {}
            marks = " ".join(own[k] for k in ("class", "id", "role", "itemprop") if k in own).lower()
            nodes.append(Node(stack[-1], tag, marks, hidden=_is_hidden(own)))
            if rest and "data-main" in rest:
                nodes[-1].own = "data-main=0" not in rest
            nodes[stack[-1]].children.append(len(nodes) - 1)
            stack.append(len(nodes) - 1)
    buffer.append(page[at:])
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        node, up = nodes[i], nodes[nodes[i].parent]
        if not node.tag and up.tag in ("p", "blockquote", "pre"):
            node.prose = node.words
        up.words += node.words
        up.linked += node.linked
        up.prose += node.prose
        if node.tag:
            up.text = up.text or ""
    return nodes


def _length(nodes: list[Node]) -> list[int]:
    """Characters of text below each node."""
    size = [len(n.text) for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
    return size


def holds_most(nodes: list[Node], i: int, may: bool = True) -> bool:
    """Whether most words of the page are below an element: a container, such as a form around the page, whatever its name."""
    return may and 2 * nodes[i].words > nodes[0].words


def _regions(nodes: list[Node], hide: float, random: np.random.Generator | None) -> list[int]:
    """For each node, what its nearest marked element says: -1 boilerplate, 1 main text, 0 nothing."""
    region = [0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        region[i] = region[n.parent]
        if not n.tag or n.tag in ("body", "html") or hide and random.random() < hide:
            continue
        if n.tag == "header" and region[i] > 0:
            continue  # an article's own heading
        if n.hidden or n.tag in NOISE_TAGS and not holds_most(nodes, i, n.tag == "form") or noisy(n.marks) and not holds_most(nodes, i):
            region[i] = -1
        elif n.tag in MAIN_TAGS or n.marks and region[i] == 0 and MAIN.search(n.marks):
            region[i] = 1
    return region


def features(nodes: list[Node], hide: float = 0.0, random: np.random.Generator | None = None) -> np.ndarray:
    """A row of features per node; ``hide`` is the chance that an element's tag and names are not seen."""
    size, region = _length(nodes), _regions(nodes, hide, random)
    rows = np.zeros((len(nodes), 18))
    for i, n in enumerate(nodes):
        x = rows[i]
        share = n.linked / max(1, size[i])
        if n.tag:
            x[0] = 1
            x[1] = region[i] < 0
            x[2] = region[i] > 0
            x[3] = math.log1p(n.words) / 5
            x[4] = share
            x[5] = n.prose / max(1, n.words)
            x[6] = n.tag in ("p", "pre", "blockquote")
            x[7] = n.tag in ("ul", "ol", "li", "dl")
        else:
            tag = nodes[n.parent].tag
            x[8] = 1
            x[9] = region[i] < 0
            x[10] = region[i] > 0
            x[11] = math.log1p(n.words) / 5
            x[12] = share
            x[13] = n.text[-1] in ".!?…:;\"”»'"
            x[14] = tag in ("p", "pre", "blockquote")
            x[15] = tag[0] == "h" and len(tag) == 2
            x[16] = tag in ("li", "td", "dd")
            x[17] = "©" in n.text
    return rows


@dataclass
class Model:
    weights: np.ndarray
    pairs: list[list[float]]  # log potential by parent's and child's label

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """Probability of content of every node, by sum-product messages in log space."""
        own = features(nodes) @ self.weights
        n = len(nodes)
        up0, up1 = [0.0] * n, own.tolist()  # own potential and messages of the children
        to0, to1 = [0.0] * n, [0.0] * n  # message to the parent
        (p00, p01), (p10, p11) = self.pairs
        for i in range(n - 1, 0, -1):
            to0[i] = _logsum(up0[i] + p00, up1[i] + p01)
            to1[i] = _logsum(up0[i] + p10, up1[i] + p11)
            up0[nodes[i].parent] += to0[i]
            up1[nodes[i].parent] += to1[i]
        all0, all1 = up0[:], up1[:]
        for i in range(1, n):
            up = nodes[i].parent
            rest0, rest1 = all0[up] - to0[i], all1[up] - to1[i]
            all0[i] += _logsum(rest0 + p00, rest1 + p10)
            all1[i] += _logsum(rest0 + p01, rest1 + p11)
            shift = max(all0[i], all1[i])
            all0[i], all1[i] = all0[i] - shift, all1[i] - shift
        d = np.clip(np.array(all0) - np.array(all1), -500, 500)
        return 1 / (1 + np.exp(d))

    def text(self, page: str) -> str:
        nodes = parse(page)
        keep = self.marginals(nodes)
        return "\n".join(n.text for n, p in zip(nodes, keep) if not n.tag and p > 0.5)


def _logsum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


# --- training ------------------------------------------------------------------

_FILLER = "A sentence of ordinary prose runs on for a while, and says what it has to say. Another one follows it."
#: Labelled pages: ``data-main`` marks the main text, ``data-main=0`` what isn't inside it.
LABELLED = [
    f"""<body><header><h1>Site</h1><nav><a href=/>Home</a> <a href=/x>News</a></nav></header><div class="cookie-notice"><p>We use
    cookies to improve this site. By browsing on you agree to their use.</p><button>OK</button></div><main data-main><h1>A title</h1>
    <p>{_FILLER}</p><p>{_FILLER} {_FILLER}</p><ul><li>One point of the list.</li><li>Another point</li></ul><p>Short one.</p></main><aside
    class=sidebar><h3>Related</h3><ul><li><a href=/a>First story</a></li><li><a href=/b>Second story</a></li></ul></aside><section
    class="comments"><h2>Comments</h2><div class=comment><p>{_FILLER}</p></div><div class=comment><p>I agree with all of that, well
    said.</p></div><form><label>Your name</label><p>Leave a reply here.</p></form></section><footer><p>Copyright 2020 Site. All rights
    reserved.</p></footer></body>""",
    f"""<body><div id=top><ul class=menu><li><a href=/>Home</a><li><a href=/y>About</a></ul></div><div id=wrap><div class=post data-main>
    <h2>Heading</h2><div>{_FILLER}</div><div class="advert" data-main=0><p>Buy now and save a lot of money today.</p></div><p>{_FILLER}
    <a href=/z>link</a> {_FILLER}</p><table><tr><td>Cell</td><td>Other cell</td></tr></table><blockquote>{_FILLER}</blockquote><div
    class="share" data-main=0><a href=/t>Share this</a></div></div><div class=widget><h3>Newsletter</h3><p>Subscribe to our newsletter and
    get the news by mail.</p></div></div><div class=foot><p>Imprint, terms and privacy.</p></div></body>""",
    f"""<body><div><a href=/>Home</a> | <a href=/q>Contact</a></div><div><div data-main><h1>Title</h1><p>{_FILLER} {_FILLER}</p><p>{_FILLER}</p>
    <h3>Part</h3><p>{_FILLER}</p><p>Short one</p><h4>Last part</h4><p>Words and more words</p></div><div><a href=/1>One</a><br><a href=/2>Two</a><br><a href=/3>Three</a></div></div><div>© 2021
    Somebody</div></body>""",
    f"""<body><article data-main><header data-main><h1>Title of it</h1></header><p>{_FILLER}</p><aside data-main=0><p>{_FILLER}</p></aside><figure
    data-main=0 class=promo><p>Advertisement</p></figure><p>{_FILLER}</p><div class="comments" data-main=0><h3>3 comments</h3><p>{_FILLER}</p><p>Thanks
    for this, I liked it.</p></div><footer data-main=0><a href=/k>Tag</a></footer></article><div role=alert class=notice><p>{_FILLER}</p></div><form
    class=search><p>Search here</p></form></body>""",
]


def _labels(nodes: list[Node]) -> list[bool]:
    labels = []
    for n in nodes:
        inherited = labels[n.parent] if n.parent >= 0 else False
        labels.append(inherited if n.own is None else n.own)
    return labels


def _marked(page: str) -> list[Node] | None:
    """Nodes of a page that marks its main text itself with one ``article``."""
    nodes = parse(page)
    articles = [n for n in nodes if n.tag == "article"]
    if len(articles) != 1 or not articles[0].words:
        return None
    articles[0].own = True
    for i, n in enumerate(nodes):
        most = holds_most(nodes, i)
        if n.tag in ("nav", "aside", "footer") or n.hidden or not most and (n.tag == "form" or n.tag and noisy(n.marks)):
            n.own = False
    return nodes


def _mixed(nodes: list[Node], random: np.random.Generator) -> list[Node]:
    """The page with one of its boilerplate elements moved into its main text."""
    labels = _labels(nodes)
    noise = [i for i, n in enumerate(nodes) if n.tag and n.own is False and n.words]
    inside = [i for i, n in enumerate(nodes) if n.tag and labels[i] and n.own]
    if noise and inside:
        i, to = int(random.choice(noise)), int(random.choice(inside))
        if to < i:
            nodes[nodes[i].parent].children.remove(i)
            nodes[i].parent = to
            nodes[to].children.append(i)
    return nodes


def fit(pages: list[str], seed: int = 0, rounds: int = 12) -> Model:
    """Weights by Newton's method, pair potentials from how often labels go together."""
    random = np.random.default_rng(seed)
    rows, wanted, weight = [], [], []
    pairs = np.ones((2, 2))
    own = [(parse(p), 8.0) for p in LABELLED for _ in range(6)]
    own += [(m, 1.0) for p in pages if (m := _marked(p)) is not None]
    for at, (nodes, times) in enumerate(own):
        nodes = _mixed(nodes, random) if at % 2 else nodes
        labels = _labels(nodes)
        rows.append(features(nodes, hide=0.1 if at % 2 else 0.0, random=random))
        wanted.append(np.array(labels, float))
        weight.append(np.full(len(nodes), times))
        for n, y in zip(nodes[1:], labels[1:]):
            pairs[int(labels[n.parent]), int(y)] += times
    x, y, w = np.vstack(rows), np.concatenate(wanted), np.concatenate(weight)
    w /= w.mean()
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - beta
        curve = (x * (w * p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(x.shape[1])
        beta += np.linalg.solve(curve, slope)
    joint = pairs / pairs.sum()
    together = np.log(joint / np.outer(joint.sum(1), joint.sum(0)))
    return Model(beta, together.tolist())


# --- the operator ----------------------------------------------------------------


def train(pages: DataFrame, html_col: str = "html", most: int = TRAIN_PAGES) -> Model:
    """A model from at most ``most`` pages of up to 100,000 characters that mark their main text: those of the least hashes,
    whatever the files they come from."""
    marked = pages.select(F.col(html_col).cast("string").alias("h")).filter(F.col("h").rlike("(?i)<article[ >]"))
    marked = marked.filter(F.length("h") < 100_000).select("h", F.xxhash64("h").alias("k"))
    # Hashes first, then the pages that have one of the least; copies of a page are one in every task.
    least = [r["k"] for r in marked.select("k").distinct().orderBy("k").limit(most).collect()]
    if not least:
        return fit([])
    chosen = marked.filter(F.col("k") <= least[-1]).groupBy("k").agg(F.min("h").alias("h"))
    return fit([r["h"] for r in sorted(chosen.collect(), key=lambda r: r["k"])])


def main_text(pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` (id and url) with ``text``, blocks joined by newlines, and ``n_chars``, its code points.

    A null or empty page, or one without main text, gives an empty text. Null ids and
    repeated rows are treated like others; an empty table gives an empty one; other columns aren't read.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                texts = [model.text(p) for p in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
