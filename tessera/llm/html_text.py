"""Operator 13: main text of a page by a linear-chain conditional random field over its leaf blocks.

A page is read into leaf blocks: the runs of text between the borders of block elements, without comments, scripts,
styles and other unseen content. A block's features are the tags of its ancestors, the words of their class, id and role,
and its own text (length, share of text in links, punctuation, letters, place among the blocks). The field has two
labels, main text or not, and learned transitions; Viterbi gives the labels of all blocks of a page together. The page's
text is its main blocks, joined by an empty line.

The field is fitted on labelled pages: of at most ``SAMPLE_PAGES`` pages, those with the least hash of their html, the
marked-up ones label themselves (what stands in ``article`` or ``main``, but in none of the ``OTHER`` elements, is main
text). So that the field doesn't learn that mark-up alone, each labelled page is also laid out anew: its blocks keep text
and label and get other ancestors (named by ``MAIN_NAMES`` and ``OTHER_NAMES``), and comments, notices, forms and sidebars
with text of the sample come between. Everything else covers all pages and their whole html.

Character references are decoded, also those without a semicolon, as browsers do. Runs of white space (Unicode's, so
no-break spaces too) become one space. ``br`` is white space inside its block.

Edge cases: null or empty html, and a page without a main block, have an empty text. Unclosed and misnested tags
end where their parent ends; a ``<`` that begins no tag is text. Without any marked-up page in the sample, paragraphs and
headings outside the ``OTHER`` elements are taken for main text. Null page_id and url are kept; repeated pages have equal
texts; other columns aren't read; an empty table gives no rows. Long pages are read in whole.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.language import posteriors, switches
from tessera.llm.text import slices

SAMPLE_PAGES = 320
LAYOUTS = 3  # new layouts of each labelled page
SLOT_BITS = 16
STEPS = 80
MARKUP = 4  # weight of ancestors' features beside those of the text
SLICE = 8 << 20

# fixed values: elements of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title iframe object svg math canvas select option datalist textarea audio video".split())
RAW = frozenset("script style textarea title iframe noscript".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"})}

OTHER = frozenset("nav aside footer form menu button dialog".split())
MAIN_NAMES = "content main article post entry story text body-copy article-body post-content page-content prose".split()
OTHER_NAMES = {
    "menu": "menu nav navbar navigation topnav breadcrumbs tabs".split(), "head": "header masthead site-header branding banner".split(), "foot": "footer site-footer copyright legal colophon".split(),
    "side": "sidebar aside widget related recommended popular tags toc share social".split(), "ad": "ad ads advert advertisement sponsor sponsored promo".split(),
    "notice": "notice cookie consent alert popup modal newsletter subscribe paywall".split(), "form": "form search login signup contact subscribe-form".split(),
    "talk": "comments comment reply replies discussion responses disqus".split(),
}
_NAME = re.compile(r"[A-Za-z][^\s/>\x00]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|\d+")
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # ancestors from the root: tags
    names: tuple[str, ...]  # words of their class, id and role
    linked: int  # characters inside links


def _tag_end(page: str, at: int, open_quotes: set[str]) -> int:
    """The place after the tag that begins before ``at``; quotes that never close don't hide its end."""
    n = len(page)
    while True:
        end = page.find(">", at)
        if end < 0:
            return n
        quotes = [(q, page.find(q, at, end)) for q in "\"'" if q not in open_quotes]
        first = min((p for _, p in quotes if p >= 0), default=-1)
        if first < 0:
            return end + 1
        if not page[max(0, first - 80) : first].rstrip().endswith("="):
            at = first + 1  # a quote that opens no value
            continue
        close = page.find(page[first], first + 1)
        if close < 0:
            open_quotes.add(page[first])
            continue
        at = close + 1


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in its order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    state = {"linked": 0, "unseen": 0, "links": 0}
    open_quotes: set[str] = set()

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                inner = [e for e in stack if e[0] not in INLINE]
                out.append(Block(text, tuple(t for t, _ in inner), tuple(w for _, names in stack for w in names), min(state["linked"], len(text))))
            held.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        if text and not state["unseen"]:
            held.append(text)
            if state["links"]:
                state["linked"] += len(text.strip())

    def pop(down_to: int) -> None:
        if any(t not in INLINE for t, _ in stack[down_to:]):
            close()
        while len(stack) > down_to:
            tag, _ = stack.pop()
            state["unseen"] -= tag in UNSEEN
            state["links"] -= tag == "a"

    def find(tags: set[str] | frozenset[str], stops: set[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stops:
                break
        return -1

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        closing = page[start + 1 : start + 2] == "/"
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            if not closing:
                add("<")
                at = start + 1
            else:
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            continue
        tag = name.group().lower()
        at = _tag_end(page, name.end(), open_quotes)
        if closing:
            if tag == "br":
                add(" ")
            elif (i := find({tag}, {"td", "th"} if tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot") else set())) >= 0:
                pop(i)
            elif tag not in INLINE and not state["unseen"]:
                close()
            continue
        if tag in VOID:
            if tag not in INLINE:
                close()
            elif tag == "br":
                add(" ")
            continue
        if tag in ENDS_PARAGRAPH and (i := find({"p"}, {"td", "th", "div", "li", "blockquote", "article", "section", "button"})) >= 0:
            pop(i)
        if tag in SIBLINGS and (i := find(SIBLINGS[tag][0], SIBLINGS[tag][1])) >= 0:
            pop(i)
        if tag == "a" and (i := find({"a"}, {"td", "th", "li", "div", "p"})) >= 0:
            pop(i)
        if tag == "body" and (i := find({"head"}, set())) >= 0:
            pop(i)
        if tag not in INLINE:
            close()
        if page[at - 2 : at] == "/>" and tag in ("svg", "math", "path"):
            continue
        words = tuple(dict.fromkeys(w for _, a, b, c in _ATTRIBUTE.findall(page, name.end(), at) for w in _PART.findall((a or b or c).lower())))
        if tag in RAW:
            end = _CLOSING[tag].search(page, at)
            at = _tag_end(page, end.end(), open_quotes) if end else n
            continue
        stack.append((tag, words))
        state["unseen"] += tag in UNSEEN
        state["links"] += tag == "a"
    close()
    return out


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) >> (32 - SLOT_BITS)


class _Slots(dict):
    def __missing__(self, feature: str) -> int:
        value = _slot(feature)
        if len(self) < 200_000:
            self[feature] = value
        return value


_slots = _Slots()


def features_of(blocks: list[Block]) -> list[list[int]]:
    """The slots of each block of a page."""
    n, out = len(blocks), []
    for i, b in enumerate(blocks):
        text, size = b.text, len(b.text)
        words = text.count(" ") + 1
        letters = sum(map(str.isalpha, text[:400]))
        seen = min(size, 400)
        last = text[-1]
        f = ["bias", f"words{min(words, 64).bit_length()}", f"size{min(size, 4095).bit_length()}", f"links{min(4, 4 * b.linked // size)}", f"stops{min(3, len(re.findall(r'[.!?。](?= |$)', text[:2000])))}", f"commas{min(2, text.count(',', 0, 2000))}"]
        f += [f"end{last if not last.isalnum() else 'x'}", f"letters{8 * letters // seen}", f"digits{sum(map(str.isdigit, text[:400])) * 4 // seen}", f"sign{text[0] if not text[0].isalnum() else 'x'}", f"mark{any(c in text for c in '©|·»›')}", f"place{4 * i // n}", f"edge{min(i, 3)}", f"left{min(n - 1 - i, 3)}"]
        f += MARKUP * ([f"tag {t}" for t in set(b.path)] + [f"name {w}" for w in set(b.names)])
        parent = b.path[-1] if b.path else ""
        f += [f"own {parent}", f"own2 {' '.join(b.path[-2:])}", f"own {parent} {min(words, 64).bit_length()}"]
        out.append([_slots[x] for x in f])
    return out


def marked(blocks: list[Block]) -> list[int] | None:
    """1 for each block of main text by the page's own mark-up; None if it has none."""
    if not any("article" in b.path or "main" in b.path for b in blocks):
        return None
    return [int(("article" in b.path or "main" in b.path) and not OTHER & set(b.path)) for b in blocks]


def _plain(blocks: list[Block]) -> list[int]:
    return [int(bool(b.path) and re.fullmatch("p|h[1-6]|blockquote|pre", b.path[-1]) is not None and not (OTHER | {"header"}) & set(b.path)) for b in blocks]


def relaid(blocks: list[Block], labels: list[int], spare: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page's blocks in another layout, with sections of other text before, between and after them; ``spare``: texts
    to fill them."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    words = lambda name: tuple(_PART.findall(name))

    def section(kind: str) -> tuple[list[Block], list[int]]:
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "section")
        outer, name = (tag, ()) if tag != "section" and rng.random() < 0.35 else (pick(["div", "div", "section", "ul"]), words(pick(OTHER_NAMES[kind])))
        made = []
        for _ in range(int(rng.integers(1, 7))):
            text = pick(spare) if kind in ("talk", "ad", "side") and spare else pick(["Home", "About us", "Read more", "Log in", "Search", "Subscribe to our newsletter", "We use cookies to improve this site.", "Accept all", "All rights reserved.", "© 2024", "Share", "Next page", "Contact", "Privacy"])
            if kind in ("menu", "side", "foot", "head") and rng.random() < 0.7:
                text = " ".join(text.split()[: int(rng.integers(1, 5))])
            inner = {"menu": ("ul", "li"), "side": ("li",), "form": ("label",), "foot": ("p",), "talk": (pick(["p", "div", "li"]),)}.get(kind, (pick(["p", "div", "span"]),))
            path = ("html", "body", outer, *(t for t in inner if t not in INLINE))
            made.append(Block(text, path, name, len(text) if kind in ("menu", "side") and rng.random() < 0.8 else 0))
        return made, [0] * len(made)

    way = rng.random()
    frame, name = (("article",), ()) if way < 0.2 else (("main",), ()) if way < 0.35 else (("div",), words(pick(MAIN_NAMES))) if way < 0.8 else ((pick(["div", "section"]), "div"), ()) if way < 0.9 else ((), ())
    body: list[tuple[Block, int]] = []
    for b, y in zip(blocks, labels):
        own = b.path[-1] if b.path and re.fullmatch("p|h[1-6]|li|blockquote|pre|td|figcaption", b.path[-1]) else "p"
        if y:  # some blocks are short, so that mark-up tells more than length
            text = " ".join(b.text.split()[: int(rng.integers(1, 4))]) if rng.random() < 0.15 else b.text
            body.append((Block(text, ("html", "body", *frame, own), name, min(b.linked, len(text))), 1))
    out: list[Block] = []
    kept: list[int] = []

    def put(kind: str, chance: float) -> None:
        if rng.random() < chance:
            a, b = section(kind)
            out.extend(a)
            kept.extend(b)

    for kind, chance in (("notice", 0.4), ("head", 0.5), ("menu", 0.8), ("ad", 0.4), ("side", 0.3), ("form", 0.2)):
        put(kind, chance)
    for b, y in body:
        out.append(b)
        kept.append(y)
        for kind, chance in (("ad", 0.04), ("side", 0.03), ("notice", 0.02), ("form", 0.02)):
            put(kind, chance)
    for kind, chance in (("talk", 0.7), ("side", 0.5), ("ad", 0.3), ("form", 0.3), ("menu", 0.2), ("foot", 0.8), ("notice", 0.2)):
        put(kind, chance)
    return out, kept


@dataclass
class Field:
    weights: np.ndarray  # slots by labels
    step: np.ndarray  # log potentials of label pairs
    start: np.ndarray

    def potentials(self, slots: list[list[int]]) -> np.ndarray:
        return self.summed(*_flat(slots))

    def summed(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[flat], np.cumsum(counts) - counts, axis=0) if len(counts) else np.zeros((0, 2))


def _flat(slots: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, slots), np.int64, len(slots))
    return np.fromiter((s for f in slots for s in f), np.int64, int(counts.sum())), counts


def fit_chain(slots: list[list[int]], labels: np.ndarray, offsets: np.ndarray, steps: int = STEPS) -> Field:
    """A field fitted to chains of labelled blocks by gradient steps on the conditional likelihood."""
    field = Field(np.zeros((1 << SLOT_BITS, 2)), np.zeros((2, 2)), np.zeros(2))
    flat, counts = _flat(slots)
    owner, truth = np.repeat(np.arange(len(slots)), counts), np.eye(2)[labels]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    inner = np.ones(len(labels), bool)
    inner[firsts] = False
    here = np.flatnonzero(inner)
    params = [field.weights, field.step, field.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for i in range(1, steps + 1):
        x = field.summed(flat, counts)
        p, seen = posteriors(x, offsets, np.exp(field.step), np.exp(field.start))
        gap = truth - p
        weight_gap = np.stack([np.bincount(flat, weights=gap[owner, j], minlength=1 << SLOT_BITS) for j in range(2)], 1)
        later = np.exp(x - x.max(axis=1, keepdims=True)) * p / np.maximum(seen, 1e-12)
        pairs = truth[here - 1].T @ truth[here] - switches(seen[here - 1], np.exp(field.step), later[here]) if len(here) else np.zeros((2, 2))
        for q, g, (m, v) in zip(params, (weight_gap - 0.02 * field.weights, pairs - 0.5 * field.step, gap[firsts].sum(axis=0) - 0.5 * field.start), moments):
            g = g / len(labels)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q += 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return field


def viterbi(x: np.ndarray, offsets: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The most likely labels of each chain's blocks. All chains move together, one block a step; ties go to label 0."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    begin, size = offsets[:-1][order], n[order]
    labels = np.zeros(len(x), np.int64)
    most = int(size[0]) if len(size) else 0
    if not most:
        return labels
    back = np.zeros((len(x), x.shape[1]), np.int8)
    active = int((size > 0).sum())
    best = x[begin[:active]] + start
    last = np.zeros((len(size), x.shape[1]))
    last[:active] = best
    for t in range(1, most):
        active = int(np.searchsorted(-size, -t, side="left"))
        ways = last[:active, :, None] + step[None]
        at = begin[:active] + t
        back[at] = ways.argmax(axis=1)
        last[:active] = ways.max(axis=1) + x[at]
    state = last.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        active = int(np.searchsorted(-size, -t, side="left"))
        at = begin[:active] + t
        labels[at] = state[:active]
        state[:active] = back[at, state[:active]]
    return labels


def labelled_pages(sample: list[str], layouts: int = LAYOUTS) -> list[tuple[list[Block], list[int]]]:
    """The marked-up pages of the sample and their new layouts."""
    read = [b for b in map(blocks_of, sample) if b]
    own = [(b, y) for b in read if (y := marked(b)) is not None and any(y)] or [(b, y) for b in read if any(y := _plain(b))]
    spare = [x.text for b, _ in own for x in b[:40]][:4096]
    rng = np.random.default_rng(7)
    return own + [relaid(b, y, spare, rng) for b, y in own for _ in range(layouts)]


def sample_of(pages: DataFrame, most: int = SAMPLE_PAGES) -> list[str]:
    """The html of at most ``most`` pages, by the least hash."""
    keyed = pages.where("html is not null and html <> ''").select(F.xxhash64("html").alias("h"), F.col("html").cast("string").alias("html"))
    least = keyed.select("h").distinct().orderBy("h").limit(most)
    held = keyed.join(F.broadcast(least), "h").groupBy("h").agg(F.min("html").alias("html"))
    return [r["html"] for r in held.orderBy("h").toLocalIterator()]


def fit(pages: DataFrame) -> Field | None:
    """A field fitted on labelled pages, or None where the sample has no block to learn from."""
    chains = [(b, y) for b, y in labelled_pages(sample_of(pages)) if b]
    if not chains:
        return None
    slots = [f for b, _ in chains for f in features_of(b)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b, _ in chains])])
    return fit_chain(slots, np.array([v for _, y in chains for v in y]), offsets)


def _extracted(field: Field):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column="html", most=SLICE):
                pages = [blocks_of(h) for h in part.column("html").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(b) for b in pages])]).astype(np.int64)
                labels = viterbi(field.potentials([f for b in pages for f in features_of(b)]), offsets, field.step, field.start)
                texts = ["\n\n".join(b.text for b, y in zip(own, labels[a:]) if y) for own, a in zip(pages, offsets)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    field = fit(rows)
    if field is None:
        return rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    return rows.mapInArrow(_extracted(field), "page_id long, url string, text string, n_chars long")
