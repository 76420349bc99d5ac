"""Operator 1: main text of web pages by a recurrent block labeller.

A page is cut into blocks, the leaf sequences of text between block-level tags. Each block
has a tag path (the open elements of any depth with all their class, id and role words; of
elements whose words are all named further out, only the depth counts) and words; both are hashed into vectors with learned embeddings. A bidirectional LSTM in numpy reads all
blocks of a page in order, so that each label rests on the whole document, and blocks
labelled as main text are joined.

Training: a bounded sample of distinct pages of any length, read whole, labels itself. Blocks inside an article or main element
are positive, those in navigation, adverts, footers and the like negative (elements,
and the words of class, id and role, listed below); on pages without such an element long
sentences outside of links are positive and blocks of links negative. A word of a role counts fully only where the element's other
words are about layout; beside others ("search algorithms") it may be a topic. To know more layouts than a sample shows, training pages are varied: blocks of
each kind are also wrapped, nested deeply, moved, renamed or stripped of telling names, main text becomes lists, quotes, code, headings and
tables, and comments follow it in elements without telling names, by rules with a fixed seed. The same pages
give the same weights. Without any page to learn from, every block is kept.

Markup is read as HTML reads it: a quote inside an unquoted value is part of it, `<!-->` is an
empty comment, an unclosed comment or tag ends with the page, CDATA is a comment. The time is linear in
the page, whatever is left open.

Text: character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined with one line end; empty blocks go. Scripts, styles, templates and
comments never hold text. Null, empty or broken pages have an empty text or what can be
read of them. Repeated pages get equal texts. Very long pages are read whole: the network
runs over all their blocks. Other columns are dropped.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

PATHS, WORDS, NUMBERS = 1024, 1024, 6
WIDTH, HIDDEN = 12, 12
SAMPLE = 240
#: how often a training page is read, each time varied anew
VARIANTS = 5
# Fixed values of HTML: elements that begin and end a block, that hold no text, that have no end, and that end an open one.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe input legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
SILENT = frozenset("script style template noscript svg object embed iframe head title select textarea button".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"br", "button", "caption", "dd", "dt", "input", "legend", "li", "option", "select", "summary", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "iframe", "body", "head", "html"}
INLINE = frozenset("a abbr b bdi bdo big cite code dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var".split())
# Words of a page's own markup that tell the role of what is inside.
POSITIVE = frozenset("article main".split())
NEGATIVE_TAGS = frozenset("nav header footer aside form menu dialog".split())
NEGATIVE = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies discussion disqus feedback footer form guestbook header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo reactions related remarks reply replies responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags talkback toc toolbar warning widget".split())
#: Words of class, id and role that say how or where something stands. A word of a role counts fully where an element's other words are of this kind;
#: beside others ("search algorithms") it may name a topic and is marked by MIXED.
LAYOUT = frozenset("area bar block body bottom box btn button buttons card cards center clearfix col column complementary container content contentinfo cta desktop first footnav form global grid group head heading hidden icons inner item items last layout left link links list main mobile module nav outer overlay page panel part placeholder post primary reader readers region right row secondary section site slot small sticky strip teaser thread title top unit user users view visible wrap wrapper zone".split())
MIXED = "~"

ROLES = POSITIVE | NEGATIVE | NEGATIVE_TAGS

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))", re.I)
_NAME = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[str, ...]  # of the open elements that name something new, the tag and the words of class, id and role
    text: str
    linked: int  # code points inside links
    depth: int = 0  # open elements


def _names(tag: str, attributes: str) -> str:
    found: list[str] = []
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            found += [x.lower() for x in _NAME.findall(m[2] or m[3] or m[4] or "")]
    if not NEGATIVE.isdisjoint(found) and any(len(x) > 2 and x not in ROLES and x not in LAYOUT for x in found):
        found = [MIXED + x if x in NEGATIVE else x for x in found]
    return " ".join([tag, *found])


def _is_main(names: str) -> bool:
    """Whether an element is one of main text."""
    tag, *words = names.split()
    return tag in POSITIVE or not POSITIVE.isdisjoint(words)


class OpenElements:
    """The elements that are open at a place of a page. Every question is answered without walking them."""

    def __init__(self):
        self.stack: list[tuple[str, list, bool]] = []
        self.path: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of those that are blocks
        self.seen: set = set()
        self.silent = self.links = self.main = 0

    def push(self, tag: str, names: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.silent += tag in SILENT
        self.links += tag == "a"
        # a word counts once, by its bucket; words of a role always count
        keys = [n if j == 0 else f".{n}" for j, n in enumerate(names.split())]
        keys = {k if k.lstrip(".") in ROLES else _bucket(k, PATHS) for k in keys}
        fresh = [(k, self.main > 0) for k in keys if (k, self.main > 0) not in self.seen]  # inside of main text anew
        self.main += _is_main(names)
        if fresh:
            self.seen.update(fresh)
            self.path.append(names)
        self.stack.append((tag, fresh, _is_main(names)))

    def pop(self, to: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.stack) > to:
            tag, fresh, main = self.stack.pop()
            self.main -= main
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            if fresh:
                self.seen.difference_update(fresh)
                self.path.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a kind, -1 if there is none."""
        return self.places[tag][-1] if self.places.get(tag) else -1

    def innermost_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def closed_by(self, tag: str) -> int:
        """The place of the element that a start tag ends, -1 if there is none."""
        for k in reversed(self.blocks):
            if self.stack[k][0] in CLOSES[tag]:
                return k
            if self.stack[k][0] != "p":
                break
        return -1


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Markup that does not nest is read as browsers do in the common cases."""
    out: list[Block] = []
    here = OpenElements()
    pieces: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                out.append(Block(tuple(here.path), text, linked, len(here.stack)))
            pieces, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not here.silent:
            text = html.unescape(text)
            pieces.append(text)
            if here.links:
                linked += len(text)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = here.last(tag)
            if k < 0:
                if tag == "p":
                    flush()
            elif tag in BLOCK or here.innermost_block() < k:
                if tag in BLOCK:
                    flush()
                here.pop(k)
            elif tag not in INLINE:  # an inline element does not close blocks
                flush()
                here.pop(k)
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P and (k := here.last("p")) >= 0 and k == here.innermost_block():
                here.pop(k)
            if tag in CLOSES and (k := here.closed_by(tag)) >= 0:
                here.pop(k)
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in RAW and tag in INLINE:
            continue
        here.push(tag, _names(tag, m[3]))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def teacher(block: Block) -> int | None:
    """1 main text, 0 not, None unknown: what a page's own markup says about a block.

    From outside to inside: what is unwanted stays so, but a form may hold a whole page. A role's word beside words of
    other kinds counts only outside of main text.
    """
    label: int | None = None
    in_form = False
    for names in block.path:
        tag, *words = names.split()
        if tag in NEGATIVE_TAGS or not NEGATIVE.isdisjoint(words):
            in_form = tag == "form" and label is None and NEGATIVE.isdisjoint(words)
            label = 0
        elif (tag in POSITIVE or not POSITIVE.isdisjoint(words)) and (label is None or in_form):
            label, in_form = 1, False
        elif label is None and any(w.startswith(MIXED) for w in words):
            label = 0
    return label


def layout_teacher(block: Block) -> int | None:
    """What the look of a block says where a page names nothing: sentences are main text, links are not."""
    if teacher(block) == 0 or block.linked > 0.7 * len(block.text):
        return 0
    return 1 if len(block.text) >= 80 and block.linked < 0.3 * len(block.text) and any(map(block.text.count, ".!?。")) else None


def taught(page: list[Block]) -> list[int | None]:
    """The label of each block: by the page's own names, or by its look where those tell no main text."""
    marks = [teacher(b) for b in page]
    return marks if 1 in marks else [layout_teacher(b) for b in page]


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def vectors(page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Hashed names of each block's path (each distinct name once), hashed words of its text, and a few numbers."""
    known: dict[str, int] = {}
    held: dict[tuple[str, ...], list[int]] = {}
    paths, words, numbers = [], [], np.zeros((len(page), NUMBERS))
    for k, b in enumerate(page):
        if b.path not in held:
            keys, inside = {}, ""
            for names in b.path:  # a name inside of main text is another one than outside
                keys |= dict.fromkeys(inside + (n if j == 0 else f".{n}") for j, n in enumerate(names.split()))
                inside = inside or "+" * _is_main(names)
            for key in keys:
                if key not in known:
                    known[key] = _bucket(key, PATHS)
            held[b.path] = [known[key] for key in keys] or [0]
        paths.append(held[b.path])
        cut = b.text.lower().split(" ")
        words.append([_bucket(w, WORDS) for w in cut])
        n = len(b.text)
        numbers[k] = (np.log1p(n) / 5, b.linked / n, len(cut) > 8, sum(map(b.text.count, ".!?;")) / len(cut), k / len(page), min(3.0, b.depth / 10))
    return paths, words, numbers


def grouped(pages: Iterable[int], sizes: list[int]) -> Iterator[list[int]]:
    """Pages (by number) in groups of like size, so that a padded grid stays small; a long page is alone."""
    order, at = sorted(pages, key=lambda k: sizes[k]), 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < 256 and sizes[order[stop]] * (stop + 1 - at) <= 8192:
            stop += 1
        yield order[at:stop]
        at = stop


class Labeller:
    """Embeddings, a bidirectional LSTM and a logistic output, in numpy."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        size = 2 * WIDTH + NUMBERS
        self.p = {"path": r.normal(0, 0.3, (PATHS, WIDTH)), "word": r.normal(0, 0.1, (WORDS, WIDTH)), "out": r.normal(0, 0.2, 2 * HIDDEN + size), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"w{d}"] = r.normal(0, 0.2, (size + HIDDEN, 4 * HIDDEN))
            self.p[f"b{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]

    @staticmethod
    def padded(pages: list[tuple]) -> tuple:
        """Flat hashed lists of all blocks, and each block's place in a (pages, blocks) grid."""
        counts = np.array([len(p[0]) for p in pages])
        flat = [[x for p in pages for x in p[k]] for k in (0, 1)]
        sizes = [np.array([len(x) for x in f], np.int64) for f in flat]
        index = [np.fromiter((v for x in f for v in x), np.int64, int(s.sum())) for f, s in zip(flat, sizes, strict=True)]
        numbers = np.concatenate([p[2] for p in pages])
        grid = np.repeat(np.arange(len(pages)), counts), np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return index, sizes, numbers, grid, counts

    def inputs(self, data: tuple) -> np.ndarray:
        index, sizes, numbers, _, _ = data
        means = []
        for table, i, s in zip((self.p["path"], self.p["word"]), index, sizes, strict=True):
            begin = np.cumsum(s) - s
            means.append(np.add.reduceat(table[i], begin, axis=0) / s[:, None])
        return np.concatenate([*means, numbers], 1)

    def forward(self, data: tuple, keep: bool = False):
        """Scores of all blocks; keep: with what the backward pass needs."""
        x = self.inputs(data)
        _, _, _, (row, col), counts = data
        n, longest = len(counts), int(counts.max())
        grid = np.zeros((longest, n, x.shape[1]))
        grid[col, row] = x
        mask = (np.arange(longest)[:, None] < counts[None, :])[:, :, None]
        states, hidden = {}, []
        for d in "fb":
            w, b = self.p[f"w{d}"], self.p[f"b{d}"]
            h, c, trace = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), [None] * longest
            out = np.zeros((longest, n, HIDDEN))
            fixed = grid @ w[:-HIDDEN] + b
            for t in range(longest) if d == "f" else range(longest - 1, -1, -1):
                z = fixed[t] + h @ w[-HIDDEN:]
                gates = 0.5 * (1 + np.tanh(0.5 * z[:, : 3 * HIDDEN]))
                i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
                before_h, before_c = h, c
                c = np.where(mask[t], f * c + i * g, c)
                tc = np.tanh(c)
                h = np.where(mask[t], o * tc, h)
                out[t] = h
                if keep:
                    trace[t] = (before_h, before_c, i, f, o, g, tc)
            hidden.append(out[col, row])
            states[d] = trace
        features = np.concatenate([*hidden, x], 1)
        score = features @ self.p["out"] + self.p["bias"][0]
        return (score, features, grid, mask, states) if keep else score

    def gradients(self, data: tuple, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean logistic loss over weighted blocks, and its gradients by back-propagation through time."""
        index, sizes, _, (row, col), counts = data
        score, features, grid, mask, states = self.forward(data, keep=True)
        chance = 0.5 * (1 + np.tanh(0.5 * score))
        total = max(1.0, weight.sum())
        loss = -(weight * (target * np.log(chance + 1e-12) + (1 - target) * np.log(1 - chance + 1e-12))).sum() / total
        up = weight * (chance - target) / total
        g = {"out": features.T @ up, "bias": np.array([up.sum()])}
        down = up[:, None] * self.p["out"][None, :]
        d_grid = np.zeros_like(grid)
        for k, d in enumerate("fb"):
            w, longest = self.p[f"w{d}"], len(grid)
            dh_out = np.zeros((longest, len(counts), HIDDEN))
            dh_out[col, row] = down[:, k * HIDDEN : (k + 1) * HIDDEN]
            g[f"w{d}"], g[f"b{d}"] = np.zeros_like(w), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((len(counts), HIDDEN)), np.zeros((len(counts), HIDDEN))
            for t in range(longest - 1, -1, -1) if d == "f" else range(longest):
                before_h, before_c, i, f, o, a, tc = states[d][t]
                m = mask[t]
                dh = dh + dh_out[t]
                do, dcell = dh * tc * m, dc + dh * o * (1 - tc * tc) * m
                di, df, da = dcell * a * m, dcell * before_c * m, dcell * i * m
                dz = np.concatenate([di * i * (1 - i), df * f * (1 - f), do * o * (1 - o), da * (1 - a * a)], 1)
                g[f"w{d}"][:-HIDDEN] += grid[t].T @ dz
                g[f"w{d}"][-HIDDEN:] += before_h.T @ dz
                g[f"b{d}"] += dz.sum(0)
                d_grid[t] += dz @ w[:-HIDDEN].T
                dh = np.where(m, dz @ w[-HIDDEN:].T, dh)
                dc = np.where(m, dcell * f, dc)
        dx = d_grid[col, row] + down[:, 2 * HIDDEN :]
        for k, name in enumerate(("path", "word")):
            table = np.zeros_like(self.p[name])
            np.add.at(table, index[k], np.repeat(dx[:, k * WIDTH : (k + 1) * WIDTH] / sizes[k][:, None], sizes[k], axis=0))
            g[name] = table
        return loss, g

    def fit(self, pages: list[tuple], targets: list[np.ndarray], epochs: int = 10, batch: int = 24, rate: float = 0.03, seed: int = 11) -> float:
        """Adam over pages of hashed blocks, with steps that shrink to nothing; targets: 1, 0 or NaN (unknown) for each block."""
        r, state, t, loss = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0, 0.0
        last = epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(order), batch):
                some, t = order[at : at + batch], t + 1
                loss, g, total = 0.0, {k: np.zeros_like(v) for k, v in self.p.items()}, 0.0
                for part in grouped(some, [len(p[0]) for p in pages]):
                    target = np.concatenate([targets[k] for k in part])
                    known = (~np.isnan(target)).astype(float)
                    one, slopes = self.gradients(self.padded([pages[k] for k in part]), np.nan_to_num(target), known)
                    n = max(1.0, known.sum())
                    loss, total = loss + one * n, total + n
                    for k, v in slopes.items():
                        g[k] += v * n
                loss, g = loss / total, {k: v / total for k, v in g.items()}
                for k, (m, v) in state.items():
                    m += 0.1 * (g[k] - m)
                    v += 0.001 * (g[k] ** 2 - v)
                    self.p[k] -= rate * (1 - (t - 1) / last) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return loss

    def main_text(self, pages: list[list[Block]]) -> list[str]:
        """The main text of pages, labelled together in groups of like length."""
        out = [""] * len(pages)
        for some in grouped((k for k in range(len(pages)) if pages[k]), [len(p) for p in pages]):
            score = self.forward(self.padded([vectors(pages[k]) for k in some]))
            done = 0
            for k in some:
                mine, done = score[done : done + len(pages[k])] > 0, done + len(pages[k])
                out[k] = "\n".join(b.text for b, yes in zip(pages[k], mine, strict=True) if yes)
        return out


#: Elements that say nothing about what is inside.
NEUTRAL = ("div", "div", "div", "section", "ul", "li", "p", "a", "span", "table", "tr", "td", "div row", "div col", "div inner", "div wrap")


def _nest(r: np.random.Generator) -> tuple[str, ...]:
    """Elements that nest a block deeper, in half of the cases."""
    return tuple(NEUTRAL[k] for k in r.integers(0, len(NEUTRAL), int(r.integers(1, 12)))) if r.random() < 0.5 else ()


def _mark(path: tuple[str, ...], label: int) -> int:
    """The place of the first element that gives a block its label."""
    hits = (lambda w: w[0] in POSITIVE or POSITIVE & set(w[1:])) if label else (lambda w: w[0] in NEGATIVE_TAGS or NEGATIVE & {x.removeprefix(MIXED) for x in w})
    return next(k for k, n in enumerate(path) if hits(n.split()))


#: Elements that hold parts of a text, inside its main element.
FORMS = ("ul li", "ol li", "ul li p", "blockquote", "blockquote p", "pre", "pre code", "h2", "h3", "h4", "h5", "h6", "table tbody tr td", "table tr th", "figure figcaption", "dl dt", "dl dd", "div", "div p", "section p", "section h2", "div ul li", "details summary", "p math")
#: Words that come with comments of readers, in some languages.
SAID = ("Reply", "Reply Share", "says:", "wrote:", "2 hours ago", "3 days ago", "Like 4", "Report", "Posted 12:40", "Répondre", "Antworten", "schrieb 9:15", "Responder", "dijo:", "12 points", "Permalink")
PRAISE = ("agree", "agree lol", "thanks", "merci", "danke", "gracias", "lol", "nice post", "great article", "disagree")


def _words(r: np.random.Generator, text: str, most: int) -> str:
    if r.random() < 0.1:
        return str(r.integers(1, 3000))
    words = text.split(" ")
    at = int(r.integers(0, len(words)))
    return " ".join(words[at : at + int(r.integers(1, most))]) or "x"


def _part(r: np.random.Generator, inside: tuple[str, ...], form: str, text: str, linked: float = 0.0) -> Block:
    path = (*inside, *form.split())
    return Block(path, text, len(text) if r.random() < linked else 0, len(path))


def enriched(page: list[Block], target: np.ndarray, good: list[int], inside: tuple[str, ...], r: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """Main text with parts of other forms than a sample may show: lists, quotes, code, headings, tables, some inside elements named after a topic."""
    names = sorted(NEGATIVE)
    page = list(page)
    for k in good:  # paragraphs that are something else
        if r.random() < 0.15:
            page[k] = _part(r, inside, FORMS[r.integers(len(FORMS))], page[k].text)
    for _ in range(int(r.integers(1, 5))):
        here = inside
        if r.random() < 0.4:
            topic = [MIXED + str(names[r.integers(len(names))]), page[int(r.choice(good))].text.split(" ")[0].lower() or "x"]
            here = (*inside, " ".join(["section" if r.random() < 0.5 else "div", *(topic if r.random() < 0.5 else topic[::-1])]))
        form, linked = FORMS[r.integers(len(FORMS))], 0.5 if r.random() < 0.2 else 0.0
        text = page[int(r.choice(good))].text
        new = [_part(r, here, form, _words(r, text, 30 if r.random() < 0.5 else 8), linked) for _ in range(int(r.integers(1, 6)))]
        if r.random() < 0.4:
            new.append(_part(r, here, "p", _words(r, text, 40)))
        at = int(r.choice(good)) + 1
        page[at:at] = new
        target = np.concatenate([target[:at], np.ones(len(new)), target[at:]])
        good = [k + len(new) if k >= at else k for k in good] + list(range(at, at + len(new)))
    return page, target


def discussed(page: list[Block], target: np.ndarray, good: list[int], outer: tuple[str, ...], inside: tuple[str, ...], r: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """Comments of readers behind the main text, in elements that need not tell it."""
    at, text = max(good) + 1, page[int(r.choice(good))].text
    wrap = [("div",), ("section",), ("div", "div"), ("ul", "li"), ("ol", "li", "div"), ("table", "tr", "td"), ("div thread",), ("section readers",), ("div list", "article"), ()][r.integers(10)]
    where = (*(inside[:-1] if r.random() < 0.3 else outer), *wrap)
    form, new = ["p", "div", "div p", "span"][r.integers(4)], []
    style = int(r.integers(3))
    for _ in range(int(r.integers(2, 7))):
        name, cue = _words(r, text, 3), SAID[r.integers(len(SAID))]
        body = _words(r, text, 30)
        if r.random() < 0.5:
            body = f"{PRAISE[r.integers(len(PRAISE))]} {body}"
        if style == 0:
            new.append(_part(r, where, form, f"{name} {cue} {body}"))
        else:
            new.append(_part(r, where, ["h4", "b", "span", "div"][r.integers(4)], f"{name} {cue}" if r.random() < 0.7 else name, 0.3))
            new.append(_part(r, where, form, body))
            if style == 2:
                new.append(_part(r, where, "a", SAID[[0, 9, 10, 12, 7, 15][r.integers(6)]], 0.7))
    page = [*page[:at], *new, *page[at:]]
    return page, np.concatenate([target[:at], np.zeros(len(new)), target[at:]])


#: What pages without telling names put around their blocks.
PLAIN = (("div",), ("div", "div"), ("table", "tbody", "tr", "td"), ("table", "tr", "td"), ("div wrapper", "div"), ("center", "table", "tr", "td"), ("div page", "div content"))


def stripped(page: list[Block], marks: list[int | None], r: np.random.Generator) -> list[Block]:
    """The page with the names that tell its roles taken away from main text and from blocks of links: those are in plain wrappers."""
    plain = PLAIN[r.integers(len(PLAIN))]
    out = []
    for b, m in zip(page, marks, strict=True):
        if m is None or m == 0 and b.linked <= 0.7 * len(b.text):
            out.append(b)
            continue
        at = _mark(b.path, m)
        rest = tuple(n.split()[0] for n in b.path[at + 1 :] if n.split()[0] not in POSITIVE | NEGATIVE_TAGS)
        out.append(Block(("html", "body", *plain, *rest), b.text, b.linked, 2 + len(plain) + len(rest)))
    return out


def bars_of_links(page: list[Block], marks: list[int | None], target: np.ndarray, r: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A stripped page whose links stand in bars, one block of several links, before and perhaps behind the text."""
    links = [k for k, (b, m) in enumerate(zip(page, marks, strict=True)) if m == 0 and b.linked > 0.7 * len(b.text)]
    if not links:
        return page, target
    where = page[marks.index(1)].path[:-1] if 1 in marks else ("html", "body", "div")
    some = [page[k].text for k in links[: int(r.integers(1, 8))]]
    texts = [" ".join(some)] if r.random() < 0.6 else some
    bars = [Block(where, t, len(t) - (len(texts) == 1) * (len(some) - 1), len(where)) for t in texts]
    behind = bars if r.random() < 0.5 else []
    rest = [k for k in range(len(page)) if k not in set(links)]
    kept = [page[k] for k in rest]
    return [*bars, *kept, *behind], np.concatenate([np.zeros(len(bars)), target[rest], np.zeros(len(behind))])


def shortened(page: list[Block], marks: list[int | None], r: np.random.Generator) -> tuple[list[Block], list[int | None]]:
    """The page with paragraphs of a sentence or two: long blocks of main text are cut into several."""
    out, labels = [], []
    for b, m in zip(page, marks, strict=True):
        parts = [b.text]
        if m == 1 and len(b.text) > 150 and not b.linked:
            parts = re.findall(r".{40,}?(?:[.!?](?= )|$)|.+$", b.text)[:8] if r.random() < 0.7 else [b.text[: int(r.integers(60, 150))] + "."]
        for text in map(str.strip, parts):
            if text:
                out.append(Block(b.path, text, min(b.linked, len(text)), b.depth))
                labels.append(m)
    return out, labels


def varied(page: list[Block], r: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A training page and its targets: as it is, or with blocks of unwanted kinds moved in, main text put into other forms and wrappers, comments added."""
    marks = [teacher(b) for b in page]
    if 1 not in marks:
        return page, np.array([np.nan if m is None else m for m in taught(page)])
    if r.random() < 0.3:
        return page, np.array([np.nan if m is None else m for m in marks])
    if marks.count(1) > 2 and r.random() < 0.3:  # main text need not begin with a heading
        k = marks.index(1)
        page, marks = [*page[:k], *page[k + 1 :]], [*marks[:k], *marks[k + 1 :]]
    if r.random() < 0.5:
        page, marks = shortened(page, marks, r)
    target = np.array([np.nan if m is None else m for m in marks])
    good = [k for k, m in enumerate(marks) if m == 1]
    if r.random() < 0.1:  # a form around the whole page
        page = [Block((*b.path[:2], "form", *(("div",) if r.random() < 0.5 else ()), *b.path[2:]), b.text, b.linked, b.depth + 1) for b in page]
    if r.random() < 0.3:
        page = stripped(page, marks, r)
        inside = page[good[0]].path[:-1]
        if r.random() < 0.6:
            page, target = bars_of_links(page, marks, target, r)
            good = [k for k, m in enumerate(target) if m == 1]
        if r.random() < 0.4:
            page, target = discussed(page, target, good, inside[:2], inside, r)
            good = [k for k, m in enumerate(target) if m == 1]
        if r.random() < 0.5:
            page, target = enriched(page, target, good, inside, r)
        return page, target
    page = list(page)
    base = page[good[0]].path
    cut = next(k for k, n in enumerate(base) if n.split()[0] in POSITIVE or POSITIVE & set(n.split()[1:]))
    outer, names = base[:cut], sorted(NEGATIVE)
    if r.random() < 0.5:  # other wrappers of the main text
        wrap = [("main",), ("article",), ("main", "article"), ("div main",), ("div article",), ("div content", "article post"), ("section", "article")][r.integers(7)]
        for k in good:
            page[k] = Block((*outer, *wrap, *page[k].path[cut + 1 :]), page[k].text, page[k].linked, page[k].depth)
    inner = page[good[0]].path[: len(page[good[0]].path) - len(base) + cut + 1]
    above = {label: _nest(r) for label in (0, 1)}  # one nest for all blocks of a label, and one of its own for some
    around = {1: _nest(r)}
    around[0] = around[1] if r.random() < 0.5 else _nest(r)  # what lies around the elements that tell the label
    for k, label in enumerate(marks):
        if label is not None:
            path = page[k].path
            at = _mark(path, label)
            page[k] = Block((*path[:at], *around[label], path[at], *above[label], *(_nest(r) if r.random() < 0.2 else ()), *path[at + 1 :]), page[k].text, page[k].linked, page[k].depth + len(above[label]) + len(around[label]))
    inner = (*outer, *around[1], *inner[len(outer) :])
    if r.random() < 0.4:
        page, target = discussed(page, target, good, outer, inner, r)
    if r.random() < 0.7:
        page, target = enriched(page, target, good, inner, r)
        good = [k for k, m in enumerate(target) if m == 1]
    for _ in range(int(r.integers(2, 8))):
        kind = str(names[r.integers(len(names))])
        if r.random() < 0.15:
            kind = f"{MIXED}{kind} {page[int(r.integers(len(page)))].text.split(' ')[0].lower() or 'x'}"
        tag = str(r.choice(["div", "section", "aside", "form", "nav", "footer", "header", "ul", "p", "dialog"]))
        where = inner if r.random() < 0.5 and MIXED not in kind else outer
        start = int(r.integers(0, len(page) + 1)) if where is outer else int(r.choice([good[0], good[-1] + 1, good[len(good) // 2]]))
        source = page[int(r.integers(len(page)))].text.split(" ")
        plain = tag in NEGATIVE_TAGS and r.random() < 0.5
        new, nest = [], _nest(r)
        for _ in range(int(r.integers(1, 5))):
            n = int(r.integers(1, 40))
            text = " ".join(source[:n]) or "x"
            new.append(Block((*where, tag if plain else f"{tag} {kind}", *nest, *((str(r.choice(["p", "li", "a", "div", "h2", "h3", "h4", "span", "label"])),) if r.random() < 0.8 else ())), text, len(text) if r.random() < 0.3 else 0, len(where) + 2 + len(nest)))
        page[start:start] = new
        target = np.concatenate([target[:start], np.zeros(len(new)), target[start:]])
        good = [k + len(new) if k >= start else k for k in good]
    return page, target


def trained(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, seed: int = 5) -> Labeller:
    """A labeller fitted on the `sample` distinct pages with the smallest hash of their markup (bounded, the same wherever it runs)."""
    pages = pages.select(F.col(html_col).alias("html")).filter("html is not null").withColumn("h", F.xxhash64("html"))
    least = [r["h"] for r in pages.select("h").distinct().orderBy("h").limit(sample).collect()]  # only hashes are dealt out
    chosen = pages.filter(F.col("h").isin(least)).select("html").distinct().toArrow()
    r, data, targets = np.random.default_rng(seed), [], []
    for page in sorted(chosen.column("html").to_pylist()):
        cut = blocks(page)
        for _ in range(VARIANTS if cut else 0):
            some, target = varied(cut, r)
            if not np.isnan(target).all():
                data.append(vectors(some))
                targets.append(target)
    model = Labeller()
    if data:
        model.fit(data, targets)
    else:
        model.p["bias"][:] = 1e6  # nothing is known: every block is kept
    return model


def extracted(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) of every page."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    held = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches):
        for b in slices(batches, "html", 1 << 20):
            cut = [blocks(p) for p in b.column("html").to_pylist()]
            found = held.value.main_text(cut)
            columns = [b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64()), pa.array([len(c) for c in cut], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long, n_blocks int")
