"""Operator 5: main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page's leaf blocks are its runs of text between block-level tags. Each has features of its ancestors (tags, words of
class, id and role) and of its text; neighbouring labels interact. The model is trained on labelled pages by gradient
ascent on the penalised likelihood (forward-backward) and decoded by Viterbi.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
order by one space; nothing else is dropped or cut. Null, empty or text-free html gives an empty text. Reading takes time
in proportion to the page's length, however long or malformed it is: unclosed tags and stray brackets are tolerated (a
bracket that no ">" follows is text, an unclosed comment or script reaches to the end). Repeated rows give repeated
results; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lotwise.llm.common import read_table
from lotwise.llm.html_training import labelled_pages

#: Tags that open or close a block. Fixed by the HTML standard's rendering rules.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul button label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
HIDDEN = ("script", "style", "template", "title", "textarea", "svg", "iframe", "object")
#: A start tag of these closes an open one of the same group up to the nearest container.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_HIDDEN_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in HIDDEN}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_LONG_NUMBER = re.compile(r"&#(?:([0-9]{10,})|[xX]([0-9a-fA-F]{10,}));?")


def decoded(text: str) -> str:
    """Text with its character references decoded; numbers beyond any character give the replacement character."""
    def shorter(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 9 else f"&#{'x' if m[2] else ''}{digits};"

    return references.unescape(_LONG_NUMBER.sub(shorter, text))


class Tags:
    """The markup of a page in order, each character looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html = html
        #: Whether quotes in tags hide ">"; given up for the rest of a page once a quoted value never ends its tag.
        self.quoted = True

    def end(self, at: int) -> int:
        """Where the tag that starts at a place ends; -1 where no ">" follows."""
        html, k = self.html, at
        while self.quoted:
            m = _STOP.search(html, k)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.end()
            else:  # a quote opens a value only after "="
                k, before = m.end(), m.start() - 1
                while before > at and html[before].isspace():
                    before -= 1
                if html[before] == "=":
                    k = html.find(m[0], k) + 1 or k
        return html.find(">", at) + 1 or -1

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, kind, name, attributes); kind is open, close, comment or other. Hidden elements come as one."""
        html, at = self.html, 0
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                close = html.find("-->", start + 4)
                at = close + 3 if close >= 0 else len(html)
                yield start, at, "comment", "", html[start + 4 : close if close >= 0 else at]
                continue
            m = _TAG.match(html, start)
            if m is None and html[start + 1 : start + 2] not in ("!", "?"):
                at = start + 1
                continue
            end = self.end(m.end()) if m else html.find(">", start) + 1 or -1
            if end < 0:
                return
            at = end
            if m is None:
                yield start, end, "other", "", ""
            elif m[1]:
                yield start, end, "close", m[2].lower(), ""
            elif (name := m[2].lower()) not in _HIDDEN_END:
                yield start, end, "open", name, html[m.end() : end - 1]
            else:
                if name != "svg" or html[end - 2] != "/":  # an svg tag that ends in "/>" is empty
                    close = _HIDDEN_END[name].search(html, end)
                    at = self.end(close.end()) if close else -1
                    at = at if at >= 0 else len(html)
                yield start, at, "other", "", ""


class Block:
    """A leaf block: its text, how much of it is links, its ancestors' features, and its label where marked."""

    __slots__ = ("text", "linked", "context", "own", "main")

    def __init__(self, text: str, linked: int, context: tuple[str, ...], own: str, main: bool):
        self.text, self.linked, self.context, self.own, self.main = text, linked, context, own, main


class Stack:
    """Open elements: their names, the features of each with its ancestors, and where each name is open."""

    def __init__(self, known: frozenset[str] | None):
        self.known = known
        self.names: list[str] = []
        self.contexts: list[tuple[str, ...]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, attributes: str) -> None:
        context = self.contexts[-1] if self.contexts else ()
        if name in BLOCK:
            own = [f"in:{name}", *(f"at:{w}" for x in _NAMED.findall(attributes) for w in _WORDS.findall("".join(x).lower()))]
            new = [f for f in dict.fromkeys(own) if f not in context and (self.known is None or f in self.known)]
            context = (*context, *new) if new else context
            self.blocks.append(len(self.names))
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.contexts.append(context)

    def pop_to(self, place: int) -> int:
        """Close the element at a place and all within it; how many links that closes."""
        links = 0
        while len(self.names) > place:
            self.contexts.pop()
            name = self.names.pop()
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()
            links += name == "a"
        return links

    def close(self, name: str) -> int:
        """An end tag: closes the nearest such element; inline ones close none outside the nearest block."""
        if not (places := self.places.get(name)) or (name not in BLOCK and self.blocks and self.blocks[-1] > places[-1]):
            return 0
        return self.pop_to(places[-1])

    def make_room(self, name: str) -> int:
        """A start tag closes the nearest block where that is one of its group."""
        ends = CLOSES.get(name, ("p",) if name in BLOCK else ())
        return self.pop_to(self.blocks[-1]) if self.blocks and self.names[self.blocks[-1]] in ends else 0

    def nearest(self) -> tuple[str, tuple[str, ...]]:
        """Name and features of the nearest block."""
        return (self.names[self.blocks[-1]], self.contexts[self.blocks[-1]]) if self.blocks else ("", ())


def leaf_blocks(html: str, known: frozenset[str] | None = None, marked: bool = False) -> list[Block]:
    """Leaf blocks with text, in page order, with the ancestors' features that are known (None: all).

    Comments main and /main set labels where the page is a marked one for training; in others they are comments.
    """
    blocks: list[Block] = []
    stack, text = Stack(known), []
    linked, links, main, at = 0, 0, False, 0

    def close() -> None:
        nonlocal linked
        if text:
            words = " ".join(decoded("".join(text)).split())
            if words:
                own, context = stack.nearest()
                blocks.append(Block(words, min(linked, len(words)), context, own, main))
            text.clear()
        linked = 0

    for start, end, kind, name, attributes in Tags(html):
        if start > at:
            text.append(html[at:start])
            if links:
                linked += start - at
        at = end
        if kind == "comment" and marked and attributes in ("main", "/main"):
            close()
            main = attributes == "main"
        if kind not in ("open", "close"):
            continue
        if name == "br":
            text.append(" ")
        if name in BLOCK:
            close()
        if kind == "close":
            links -= stack.close(name)
        elif name not in VOID:
            links -= stack.make_room(name)
            stack.push(name, attributes)
            links += name == "a"
    if at < len(html):
        text.append(html[at:])
    close()
    return blocks


def text_features(b: Block) -> tuple[str, ...]:
    """Features of a block's own tag and text, each a small set of values."""
    n = len(b.text)
    share = 4 * b.linked // n
    stops = sum(map(b.text.count, ".,;:?!"))
    return (f"own:{b.own}", f"size:{min(n.bit_length(), 9)}", f"links:{share}", f"stops:{min(stops, 4)}", f"ends:{b.text[-1] in '.!?'}", f"mark:{'©' in b.text}")


class Model:
    """Weights of features for label 1 against label 0, and transition scores [from][to]."""

    def __init__(self, weights: dict[str, float], transitions: list[list[float]], first: float):
        self.weights, self.transitions, self.first = weights, transitions, first
        self.contexts: dict[tuple[str, ...], float] = {}
        self.known = frozenset(weights)

    def score(self, b: Block) -> float:
        known = self.contexts.get(b.context)
        if known is None:
            if len(self.contexts) > 10_000:
                self.contexts.clear()
            known = self.contexts[b.context] = sum(self.weights.get(f, 0.0) for f in b.context)
        return known + sum(self.weights.get(f, 0.0) for f in text_features(b))

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most probable labels (Viterbi)."""
        if not blocks:
            return []
        (stay0, go1), (go0, stay1) = self.transitions
        zero, one = 0.0, self.score(blocks[0]) + self.first
        came: list[tuple[bool, bool]] = []
        for b in blocks[1:]:
            from0, from1 = (zero + stay0, one + go0), (zero + go1, one + stay1)
            came.append((from0[1] > from0[0], from1[1] > from1[0]))
            zero, one = max(from0), max(from1) + self.score(b)
        labels = [one > zero]
        for back in reversed(came):
            labels.append(back[labels[-1]])
        return labels[::-1]

    def extract(self, html: str | None) -> str:
        blocks = leaf_blocks(html or "", self.known)
        return " ".join(b.text for b, keep in zip(blocks, self.decode(blocks)) if keep)


def likelihood(x: np.ndarray, y: np.ndarray, mask: np.ndarray, w: np.ndarray, parameters: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Mean penalised log-likelihood of labelled sequences (padded; mask marks blocks), and its slope by forward-backward.

    x has each block's features, w their weights for label 1; parameters are the four transitions and the first block's.
    """
    n, longest = y.shape
    flat, pairs = x.reshape(-1, x.shape[2]), mask[:, 1:]
    trans, first = parameters[:4].reshape(2, 2), parameters[4]
    u = np.zeros((*y.shape, 2))
    u[..., 1] = (flat @ w.astype(x.dtype)).reshape(y.shape)
    u[:, 0, 1] += first
    ahead, back = np.zeros_like(u), np.zeros_like(u)
    ahead[:, 0] = u[:, 0]
    for t in range(1, longest):
        ahead[:, t] = np.where(mask[:, t, None], u[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + trans, axis=1), ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        back[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(trans + (u[:, t + 1] + back[:, t + 1])[:, None, :], axis=2), 0)
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    p1 = np.exp(ahead[..., 1] + back[..., 1] - total[:, None]) * mask
    both = np.exp(np.minimum(ahead[:, :-1, :, None] + trans + (u[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None], 0)) * pairs[..., None, None]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    off = (y - p1) * mask
    slope = np.concatenate((flat.T @ off.reshape(-1).astype(x.dtype), (seen - both.sum((0, 1))).ravel(), [off[:, 0].sum()])) / n
    own = np.concatenate((w, parameters))
    value = ((u[..., 1] * y * mask).sum() + (seen * trans).sum() - total.sum()) / n - penalty * (own @ own) / 2
    return float(value), slope - penalty * own


def train(pages: list[str], penalty: float = 0.0005, rounds: int = 250, rate: float = 0.1) -> Model:
    """Fit the field on labelled pages, all sequences at once (they are padded), with Adam steps on the likelihood."""
    sequences = [s for s in (leaf_blocks(x, marked=True) for x in pages) if s]
    names = sorted({f for s in sequences for b in s for f in (*b.context, *text_features(b))})
    index = {f: k for k, f in enumerate(names)}
    longest = max(map(len, sequences))
    x, y, mask = np.zeros((len(sequences), longest, len(names)), np.float32), np.zeros((len(sequences), longest), int), np.zeros((len(sequences), longest), bool)
    for i, s in enumerate(sequences):
        for t, b in enumerate(s):
            x[i, t, [index[f] for f in (*b.context, *text_features(b))]] = 1
            y[i, t], mask[i, t] = b.main, True
    own = np.zeros(len(names) + 5)
    moments = [np.zeros_like(own), np.zeros_like(own)]
    for k in range(1, rounds + 1):
        _, slope = likelihood(x, y, mask, own[:-5], own[-5:], penalty)
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        own = own + rate * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-8)
    return Model(dict(zip(names, own[:-5].tolist())), own[-5:-1].reshape(2, 2).tolist(), float(own[-1]))


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract_text(df: DataFrame, model: Model, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row: key, kept columns, text, n_chars. Row-local: no shuffle; the model is some hundred weights."""
    schema = T.StructType([df.schema[c] for c in (key, *keep)] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    weights, transitions, first = model.weights, model.transitions, model.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, transitions, first)
        for b in batches:
            texts = [own.extract(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return df.select(key, *keep, html).mapInArrow(run, schema)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"), default_model())
