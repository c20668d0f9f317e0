"""Main text of web pages by gradient-boosted trees over the nodes of the DOM.

A page is parsed into its block elements; inline elements belong to the block around
them. Each block has features of itself and its subtree: text, link and tag
density, attribute tokens, depth, and its place and share among its siblings. Boosted
trees give the probability that a block holds main text. Decoding takes, for the
whole tree at once, the most likely labels under which a rejected block has no accepted
descendant; so an accepted paragraph never stands in a rejected side bar.

The trees are fitted on at most ``sample`` pages (those of smallest hashed id) that
mark their article by an element or role. What is inside, but for navigation, asides,
forms and comments, is main text; all else is not. Each page is also shown without
its telling tags, with plain containers and class tokens instead, so that the model does not
lean on them alone. Without any marked page a block is main text if it has more
text than links.

Cases: null or empty html gives empty text; unclosed and misnested tags are closed as
browsers do for blocks; script, style, head, hidden elements and form controls
never hold text; repeated rows and other columns stay as they are.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import empty_safe, with_columns

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
TOKEN = re.compile(r"[a-z]+")

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head script style template noscript title textarea select option button svg iframe object audio video canvas map input label".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table".split())
P_SCOPE = frozenset("table td th button".split())

AGAINST = frozenset("nav header footer aside form dialog menu".split())
FOR = frozenset("article main".split())
BAD_TOKENS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login menu "
    "modal nav navbar navigation newsletter notice pager pagination popup promo related reply replies search share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget alert copyright".split()
)
GOOD_TOKENS = frozenset("article body content entry main post story text".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


@dataclass
class Block:
    tag: str
    parent: int
    tokens: set[str]
    depth: int
    silent: bool
    parts: list[str] = field(default_factory=list)
    order: list[int] = field(default_factory=list)  # where each part stands in the page
    linked: int = 0
    tags: int = 0
    children: list[int] = field(default_factory=list)


def _attributes(raw: str) -> tuple[set[str], bool]:
    """Tokens of class, id and role, and whether the element is hidden."""
    tokens: set[str] = set()
    hidden = bool(re.search(r"(?<![\w-])hidden(?![\w-])", re.sub(r"\"[^\"]*\"|'[^']*'", "", raw)))
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            tokens.update(TOKEN.findall(value))
            if name == "role":
                tokens.update("role " + t for t in value.split())
        hidden |= name == "style" and "display:none" in value.replace(" ", "") or (name == "aria-hidden" and value == "true")
    return tokens, hidden


def parse(page: str) -> list[Block]:
    """The page's blocks in page order; the first is the document."""
    blocks = [Block("html", -1, set(), 0, False)]
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # open elements: tag, block, whether it is a link
    open_tags: Counter[str] = Counter()
    links = serial = at = 0

    def text(raw: str) -> None:
        nonlocal serial
        _, block, _ = stack[-1]
        if raw and not blocks[block].silent:
            piece = entities.unescape(raw)
            blocks[block].parts.append(piece)
            blocks[block].order.append(serial)
            if links:
                blocks[block].linked += len(piece.strip())
        serial += 1

    def drop(k: int) -> None:
        nonlocal links
        for name, _, link in stack[k:]:
            open_tags[name] -= 1
            links -= link
        del stack[k:]

    def close(tag: str, barrier: frozenset = frozenset()) -> None:
        if not open_tags[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                drop(k)
                return
            if stack[k][0] in barrier:
                return

    for m in MARKUP.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close(tag, frozenset() if tag in BLOCKS else BLOCKS)
            if tag in BLOCKS:
                serial += 1
                blocks[stack[-1][1]].parts.append(" ")
                blocks[stack[-1][1]].order.append(serial)
            continue
        _, parent, _ = stack[-1]
        blocks[parent].tags += 1
        if tag == "br" or tag == "hr":
            text(" ")
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            for other in CLOSES.get(tag, ()):
                close(other, SCOPE)
            close("p", P_SCOPE)
            parent = stack[-1][1]
        tokens, hidden = _attributes(m[3]) if m[3] else (set(), False)
        silent = tag in SILENT or hidden or blocks[parent].silent
        if tag in BLOCKS or (silent and not blocks[parent].silent):
            blocks.append(Block(tag, parent, tokens, blocks[parent].depth + 1, silent))
            blocks[parent].children.append(len(blocks) - 1)
            serial += 1
            blocks[parent].parts.append(" " if tag in BLOCKS else "")
            blocks[parent].order.append(serial)
            parent = len(blocks) - 1
        if not m[3].endswith("/") or tag in BLOCKS:
            stack.append((tag, parent, tag == "a"))
            open_tags[tag] += 1
            links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if stack[-1][0] == tag:
                drop(len(stack) - 1)
    text(page[at:])
    return blocks


FEATURES = (
    "depth children siblings place share own_length length link_density tag_density words_per_part stops upper paragraphs items "
    "against for_ paragraph heading list_ table container bad_token good_token bad_above good_above offset sibling_density link_sibling".split()
)
(AGAINST_AT, FOR_AT, CONTAINER_AT, BAD_AT, GOOD_AT, BAD_ABOVE_AT, GOOD_ABOVE_AT) = map(
    FEATURES.index, "against for_ container bad_token good_token bad_above good_above".split()
)


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block."""
    n = len(blocks)
    own = ["".join(b.parts) for b in blocks]
    length = np.array([len(t.strip()) for t in own], float)
    base = np.stack(
        [
            length,
            np.array([b.linked for b in blocks], float),
            np.array([b.tags for b in blocks], float),
            np.array([len(t.split()) for t in own], float),
            np.array([sum(t.count(c) for c in ".!?") for t in own], float),
            np.array([sum(map(str.isupper, t)) for t in own], float),
            np.array([b.tag == "p" for b in blocks], float),
            np.array([b.tag == "li" for b in blocks], float),
            np.array([len(t.strip()) > 0 for t in own], float),
        ]
    )
    whole = base.copy()
    for k in range(n - 1, 0, -1):
        whole[:, blocks[k].parent] += whole[:, k]
    out = np.zeros((n, len(FEATURES)))
    total = max(1.0, whole[0, 0])
    before = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.zeros(n)
    around_of = np.zeros((n, len(base)))
    for k, b in enumerate(blocks):
        if b.children:
            place[b.children] = np.arange(len(b.children)) / len(b.children)
            around_of[k] = whole[:, b.children].sum(axis=1)
    for k, b in enumerate(blocks):
        family = len(blocks[b.parent].children) if b.parent >= 0 else 1
        size = whole[:, k]
        around = around_of[b.parent] if b.parent >= 0 else size
        bad = bool(b.tokens & BAD_TOKENS) or any("role " + r in b.tokens for r in BAD_ROLES)
        good = bool(b.tokens & GOOD_TOKENS)
        above = out[b.parent] if b.parent >= 0 else np.zeros(len(FEATURES))
        out[k] = (
            b.depth, len(b.children), family, place[k], size[0] / max(1, around[0]),
            np.log1p(length[k]), np.log1p(size[0]), size[1] / max(1, size[0]), size[2] / max(1, size[0]), size[3] / max(1, size[8]),
            size[4] / max(1, size[3]), size[5] / max(1, size[0]), np.log1p(size[6]), np.log1p(size[7]),
            b.tag in AGAINST, b.tag in FOR, b.tag in ("p", "blockquote", "pre"), b.tag[0] == "h" and b.tag[1:].isdigit(),
            b.tag in ("ul", "ol", "li", "dl", "dt", "dd"), b.tag in ("table", "tr", "td", "th", "tbody"), b.tag in ("div", "section", "center"),
            bad, good, max(above[BAD_AT], above[BAD_ABOVE_AT], above[AGAINST_AT]), max(above[GOOD_AT], above[GOOD_ABOVE_AT], above[FOR_AT]),
            before[k] / total, around[2] / max(1, around[0]), around[1] / max(1, around[0]),
        )
    return out


def landmarks(blocks: list[Block]) -> np.ndarray | None:
    """1 for blocks with main text below or in them by the page's own marks, else 0; None if it has none."""
    inside = np.zeros(len(blocks), bool)
    marked = False
    for k, b in enumerate(blocks):
        if b.tag in FOR or "role main" in b.tokens:
            inside[k] = marked = True
        elif b.parent >= 0 and inside[b.parent]:
            inside[k] = not (b.tag in AGAINST or b.tokens & BAD_TOKENS or b.silent)
    if not marked:
        return None
    holds = np.array([inside[k] and any(p.strip() for p in b.parts) for k, b in enumerate(blocks)])
    for k in range(len(blocks) - 1, 0, -1):
        holds[blocks[k].parent] |= holds[k]
    return holds.astype(float)


def disguised(x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The same blocks as if the page used plain containers with class tokens, or none, for its parts."""
    x = x.copy()
    told = draw.random() < 0.6
    for at, token in ((AGAINST_AT, BAD_AT), (FOR_AT, GOOD_AT)):
        which = x[:, at] > 0
        x[which, CONTAINER_AT] = 1
        x[which, at] = 0
        x[which, token] = float(told)
    if not told:
        x[:, [BAD_AT, GOOD_AT, BAD_ABOVE_AT, GOOD_ABOVE_AT]] = 0
    return x


@dataclass
class Trees:
    """Boosted regression trees of one depth: per level-order node a feature and a cut, per leaf a value."""

    start: float
    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32) -> Trees:
    """Logistic boosting with second-order leaf values and binned cuts."""
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    inner = 2**depth - 1
    z = np.full(len(y), start)
    features_, cuts_, leaves_ = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == at)
                best = 1e-6
                if len(rows):
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for j, c in enumerate(cuts):
                        left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                        left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                        if len(gain) and gain.max() > best:
                            best, k = gain.max(), int(gain.argmax())
                            feature[at], cut[at] = j, c[k]
                node[rows] = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        leaf = rate * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + 1)
        z += leaf[node - inner]
        features_.append(feature)
        cuts_.append(cut)
        leaves_.append(leaf)
    return Trees(start, np.array(features_), np.array(cuts_), np.array(leaves_))


def decode(blocks: list[Block], logits: np.ndarray) -> np.ndarray:
    """The best labels of the whole tree in which no accepted block lies in a rejected one."""
    accept = -np.logaddexp(0, -logits)
    reject = -np.logaddexp(0, logits)
    gain, loss = accept.copy(), reject.copy()  # best total of a subtree whose root is accepted, rejected
    for k in range(len(blocks) - 1, 0, -1):
        if blocks[k].silent:
            gain[k] = -np.inf
        parent = blocks[k].parent
        gain[parent] += max(gain[k], loss[k])
        loss[parent] += loss[k]
    keep = np.zeros(len(blocks), bool)
    keep[0] = gain[0] >= loss[0]
    for k in range(1, len(blocks)):
        keep[k] = keep[blocks[k].parent] and gain[k] >= loss[k]
    return keep


def page_text(blocks: list[Block], keep: np.ndarray) -> str:
    """The text of the accepted blocks in page order, white space within turned into single spaces."""
    parts = sorted((o, p) for k in np.flatnonzero(keep) for o, p in zip(blocks[k].order, blocks[k].parts, strict=True))
    return " ".join("".join(p for _, p in parts).split())


def _train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    data = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"rank": [], "html": []})]).sort_values("rank", kind="stable")
    draw = np.random.default_rng(11)
    xs, ys = [], []
    for page in data["html"]:
        blocks = parse(page)
        y = landmarks(blocks)
        if y is not None and 0 < y.sum() < len(y):
            x = features(blocks)
            xs += [x, disguised(x, draw)]
            ys += [y, y]
    if xs:
        trees = boost(np.concatenate(xs), np.concatenate(ys))
    else:
        at = FEATURES.index("link_density")
        trees = Trees(0.0, np.array([[at]]), np.array([[0.5]]), np.array([[1.0, -1.0]]))
    yield pd.DataFrame({k: [np.asarray(v, "<f8").tobytes()] for k, v in vars(trees).items()} | {"rounds": [len(trees.leaf)]})


def fit_trees(pages: DataFrame, sample: int = 300, html: str = "html", page_id: str = "page_id") -> Trees:
    """Trees from at most ``sample`` pages; one row of model values reaches the driver."""
    chosen = (
        pages.select(F.xxhash64(page_id).alias("rank"), empty_safe(F.col(html)).alias("html"))
        .orderBy("rank", F.xxhash64("html")).limit(sample)
    )
    schema = "start binary, feature binary, cut binary, leaf binary, rounds long"
    row = chosen.repartition(1).mapInPandas(_train, schema).collect()[0]
    part = lambda name: np.frombuffer(bytes(row[name]), "<f8")
    shape = lambda name: part(name).reshape(row["rounds"], -1)
    return Trees(float(part("start")[0]), shape("feature").astype(np.int64), shape("cut"), shape("leaf"))


def extract(page: str, trees: Trees) -> str:
    return extract_all([page], trees)[0]


def extract_all(pages: list[str], trees: Trees) -> list[str]:
    """Main texts; the blocks of all pages are scored together."""
    parsed = [parse(p) for p in pages]
    borders = np.cumsum([0, *map(len, parsed)])
    logits = trees.score(np.concatenate([features(b) for b in parsed]))
    out = []
    for blocks, a, b in zip(parsed, borders[:-1], borders[1:], strict=True):
        out.append(page_text(blocks, decode(blocks, logits[a:b])))
    return out


def main_text(
    pages: DataFrame, sample: int = 300, html: str = "html", page_id: str = "page_id", text: str = "text", n_chars: str = "n_chars"
) -> DataFrame:
    """``pages`` with the main text of each and its number of code points."""
    trees = fit_trees(pages, sample, html, page_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                texts = extract_all(batch[html].to_pylist(), trees)
                yield with_columns(batch, {text: pa.array(texts, pa.string()), n_chars: pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(*[c for c in pages.columns if c not in (text, n_chars)]).withColumn(html, empty_safe(F.col(html)))
    return rows.mapInArrow(run, T.StructType(list(rows.schema.fields)).add(text, "string").add(n_chars, "long"))
