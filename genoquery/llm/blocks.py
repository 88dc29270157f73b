"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks (runs of text between block-level tags), each with the path of the elements around it. A
bidirectional LSTM in numpy reads the blocks in page order as vectors of hashed path tokens (tag, class, id, role), hashed words and
a few numbers, and labels every block main or not with the whole page as context. A path is the set of the tokens of all elements
around a block that training has seen, however deep: wrappers with unknown class names don't push a footer's or a menu's token out.

The labeller is trained here, on pages that `training_page` composes from a seed: menus, headers, notices, adverts, sidebars, forms,
comments and footers around and inside articles, in many markups. A fit is repeatable; its weights (about 0.3 MB) are kept in
blocks_weights.npz beside this module, which `python -m genoquery.llm.blocks` writes anew, and executors get them as a broadcast.

Memory: pages are labelled together while blocks x pages stay below CELLS; a longer page goes alone, CHUNK blocks at a time, with the
LSTM's state carried on, so a page takes a small multiple of its own text.

Defined results: a null, empty or blockless page has an empty text. Tags that don't match are closed at the page's end; an unclosed comment,
script or style runs to the end. A page of any length is read whole. Repeated rows each give their result. A block at the very
threshold (0.5) is main. Null ids and urls are kept; an empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from genoquery.llm.common import column, lean, ship, table, word_hashes

# HTML's own element names, by what they do to a run of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt "
    "msub msup mtext"
    " object output q s samp semantics small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script style noscript template svg iframe title select"
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}
}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
SCOPE = {
    "p": "div section article td body", "li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table",
    "option": "select"
}

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<hidden>{HIDDEN.replace(' ', '|')})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
PATHS, WORDS = 2048, 2048
NUMBERS = 8
CELLS, CHUNK = 1 << 15, 4096
WEIGHTS = Path(__file__).with_name("blocks_weights.npz")


@lru_cache(100_000)
def _token(name: str) -> int:
    return zlib.crc32(name.encode()) % PATHS


@lru_cache(20_000)
def _element(name: str, rest: str) -> tuple[int, ...]:
    """Path tokens of an element: its tag, and the parts of its class, id and role."""
    found = [_token(name)]
    for m in _NAMED.finditer(rest):
        value = m[2] or m[3] or m[4] or ""
        found += [_token(f".{p}") for p in _PART.findall(_HUMP.sub(" ", value).lower())]
    return tuple(dict.fromkeys(found))


def leaf_blocks(page: str | None, seen: np.ndarray | None = None) -> list[tuple[str, tuple[int, ...], int]]:
    """(text, distinct path tokens, characters in links) of each leaf block with text, in page order. With `seen` (a mark per token) only
    marked tokens count, so a path has at most PATHS of them however deep it is."""
    blocks: list[tuple[str, tuple[int, ...], int]] = []
    stack: list[tuple[str, tuple[int, ...]]] = [("", ())]
    parts: list[str] = []
    linked = depth = at = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((text, stack[-1][1], linked))
            parts.clear()
        linked = 0

    def close(names: set[str] | frozenset[str], until: str) -> None:
        """Close the innermost element of these names, unless one of `until` is in between."""
        stops = until.split()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (depth > 0)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            depth = 0 if m["end"] else 1
        if name in INLINE:
            continue
        if name == "br":
            parts.append(" ")
            continue
        flush()
        if m["end"]:
            close({name}, "")
        else:
            if name in ENDS_P:
                close({"p"}, SCOPE["p"])
            if name in CLOSES:
                close(CLOSES[name], SCOPE[name])
            if name not in VOID and not m["rest"].endswith("/"):
                path = stack[-1][1]
                new = tuple(t for t in _element(name, m["rest"]) if (seen is None or seen[t]) and t not in path)
                stack.append((name, path + new if new else path))
    parts.append(page[at:])
    flush()
    return blocks


def numbers(blocks: list[tuple[str, tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A page's blocks as arrays: path tokens and their counts, word ids and their counts, and numbers."""
    n = len(blocks)
    words = word_hashes(" ".join(b[0] for b in blocks))
    sizes = np.array([len(b[0].split()) for b in blocks])
    if sizes.sum() != len(words):  # lower case has made or lost white space
        parts = [word_hashes(b[0]) for b in blocks]
        words, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
    paths = np.array([t for b in blocks for t in b[1]], np.int64)
    counts = np.array([len(b[1]) for b in blocks])
    x = np.empty((n, NUMBERS), np.float32)
    for i, (text, _, linked) in enumerate(blocks):
        x[i] = (
            np.log1p(sizes[i]) / 4, min(1.0, linked / len(text)), text[-1] in ".!?", len(text) / (10 * max(1, sizes[i])), i / n,
            (i + 1) == n, "©" in text or "·" in text or "|" in text, text.count(",") / max(1, sizes[i])
        )
    return paths, counts, (words % np.uint64(WORDS)).astype(np.int64), sizes, x


SIZES = {"path": 24, "word": 8, "hidden": 24}
PRIOR = {"path": 0, "word": 6}  # so many zero vectors count in a block's mean: a word or two says little


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    width, h = SIZES["path"] + SIZES["word"] + NUMBERS, SIZES["hidden"]
    made = {
        "path": rng.normal(0, 0.3, (PATHS, SIZES["path"])), "word": rng.normal(0, 0.1, (WORDS, SIZES["word"])),
        "out": rng.normal(0, 0.1, (2 * h + width, 1)), "bias": np.zeros(1)
    }
    for side in "fb":
        made[f"{side}x"] = rng.normal(0, 0.2, (width, 4 * h))
        made[f"{side}h"] = rng.normal(0, 0.2, (h, 4 * h))
        made[f"{side}b"] = np.concatenate((np.ones(h), np.zeros(3 * h)))  # the forget gate starts open
    return {k: v.astype(np.float32) for k, v in made.items()}


def _means(ids: np.ndarray, counts: np.ndarray, weights: np.ndarray, prior: int = 0) -> np.ndarray:
    sums = np.concatenate((np.zeros((1, weights.shape[1]), np.float64), np.cumsum(weights[ids], axis=0, dtype=np.float64)))
    ends = np.cumsum(counts)
    return ((sums[ends] - sums[ends - counts]) / np.maximum(1, counts + prior)[:, None]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(
    x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, mask: np.ndarray, keep: list | None = None, start: tuple | None = None,
    ends: bool = False
):
    """Hidden states (time, batch, hidden); where the mask is 0 a state stays as it was. `start` is the state and cell to go on from; with
    `ends`, the last ones are returned too."""
    steps, batch, _ = x.shape
    h = wh.shape[0]
    inner = x @ wx + b
    out = np.zeros((steps, batch, h), np.float32)
    state, cell = start or (np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32))
    for t in range(steps):
        z = inner[t] + state @ wh
        gates = _sigmoid(z[:, : 3 * h])
        new = np.tanh(z[:, 3 * h :])
        on = mask[t][:, None]
        cell_next = gates[:, :h] * cell + gates[:, h : 2 * h] * new
        squashed = np.tanh(cell_next)
        state_next = gates[:, 2 * h :] * squashed
        if keep is not None:
            keep.append((state, cell, gates, new, squashed, on))
        state, cell = on * state_next + (1 - on) * state, on * cell_next + (1 - on) * cell
        out[t] = state
    return (out, (state, cell)) if ends else out


def _lstm_back(
    grad: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: list
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    steps, batch, h = grad.shape
    inner = np.zeros((steps, batch, 4 * h), np.float32)
    gwh = np.zeros_like(wh)
    ds, dc = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
    for t in range(steps - 1, -1, -1):
        state, cell, gates, new, squashed, on = keep[t]
        f, i, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        ds = ds + grad[t]
        live, live_c = on * ds, on * dc
        c = live_c + live * o * (1 - squashed**2)
        dz = np.concatenate((c * cell * f * (1 - f), c * new * i * (1 - i), live * squashed * o * (1 - o), c * i * (1 - new**2)), axis=1)
        inner[t] = dz
        gwh += state.T @ dz
        ds, dc = (1 - on) * ds + dz @ wh.T, (1 - on) * dc + c * f
    flat = inner.reshape(-1, 4 * h)
    return x.reshape(-1, x.shape[2]).T @ flat, gwh, flat.sum(0), inner @ wx.T


def _rows(model: dict[str, np.ndarray], page: tuple, part: slice = slice(None)) -> np.ndarray:
    """A page's input vectors, of all blocks or of a part of them."""
    p, pc, w, wc, x = page
    if part != slice(None):
        pe, we = np.cumsum(pc), np.cumsum(wc)
        lo, hi = part.start, min(part.stop, len(x))
        p, w = p[pe[lo] - pc[lo] : pe[hi - 1]], w[we[lo] - wc[lo] : we[hi - 1]]
        pc, wc, x = pc[part], wc[part], x[part]
    return np.concatenate((_means(p, pc, model["path"]), _means(w, wc, model["word"], PRIOR["word"]), x), axis=1)


def _inputs(model: dict[str, np.ndarray], pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(time, batch, width) inputs, mask, and each page's rows."""
    rows = [_rows(model, page) for page in pages]
    steps = max(map(len, rows))
    out, mask = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32), np.zeros((steps, len(rows)), np.float32)
    for i, r in enumerate(rows):
        out[: len(r), i], mask[: len(r), i] = r, 1
    return out, mask, rows


def label(model: dict[str, np.ndarray], pages: list[tuple]) -> list[np.ndarray]:
    """Probability that a block is main, for each block of each page."""
    x, mask, rows = _inputs(model, pages)
    ahead = _lstm(x, model["fx"], model["fh"], model["fb"], mask)
    behind = _lstm(x[::-1], model["bx"], model["bh"], model["bb"], mask[::-1])[::-1]
    p = _sigmoid(np.concatenate((ahead, behind, x), axis=2) @ model["out"] + model["bias"])[:, :, 0]
    return [p[: len(r), i] for i, r in enumerate(rows)]


def label_long(model: dict[str, np.ndarray], page: tuple, chunk: int = CHUNK) -> np.ndarray:
    """The same for one page of any length, in chunks that hand their LSTM's state on: of all blocks only the hidden states are held."""
    n, h = len(page[4]), SIZES["hidden"]
    p = np.zeros(n, np.float32)
    parts = [slice(a, min(n, a + chunk)) for a in range(0, n, chunk)]
    behind, carried = np.empty((n, h), np.float32), None
    for part in reversed(parts):
        x = _rows(model, page, part)[::-1, None]
        out, carried = _lstm(x, model["bx"], model["bh"], model["bb"], np.ones(x.shape[:2], np.float32), start=carried, ends=True)
        behind[part] = out[::-1, 0]
    carried = None
    for part in parts:
        x = _rows(model, page, part)[:, None]
        ahead, carried = _lstm(x, model["fx"], model["fh"], model["fb"], np.ones(x.shape[:2], np.float32), start=carried, ends=True)
        p[part] = _sigmoid(np.concatenate((ahead[:, 0], behind[part], x[:, 0]), axis=1) @ model["out"] + model["bias"])[:, 0]
    return p


def together(sizes: list[int], cells: int = CELLS) -> Iterator[list[int]]:
    """Pages (by number, shortest first) in groups whose number times the longest stays within `cells`; a longer page is alone."""
    group: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if group and sizes[i] * (len(group) + 1) > cells:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def fit(
    pages: list[tuple], labels: list[np.ndarray], rounds: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 5
) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy of all blocks."""
    model = initial()
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    rng, step = np.random.Generator(np.random.PCG64(seed)), 0
    by_size = np.argsort([len(y) for y in labels], kind="stable")
    groups = [by_size[a : a + batch] for a in range(0, len(by_size), batch)]
    for r in range(rounds):
        for g in rng.permutation(len(groups)):
            own, ys = [pages[i] for i in groups[g]], [labels[i] for i in groups[g]]
            x, mask, _ = _inputs(model, own)
            keep_f, keep_b = [], []
            ahead = _lstm(x, model["fx"], model["fh"], model["fb"], mask, keep_f)
            back = np.ascontiguousarray(x[::-1])
            behind = _lstm(back, model["bx"], model["bh"], model["bb"], mask[::-1], keep_b)[::-1]
            joined = np.concatenate((ahead, behind, x), axis=2)
            p = _sigmoid(joined @ model["out"] + model["bias"])[:, :, 0]
            y = np.zeros_like(p)
            for i, own_y in enumerate(ys):
                y[: len(own_y), i] = own_y
            dz = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
            grads = {"out": joined.reshape(-1, joined.shape[2]).T @ dz.reshape(-1, 1), "bias": dz.sum((0, 1))}
            dj = dz @ model["out"].T
            h = SIZES["hidden"]
            grads["fx"], grads["fh"], grads["fb"], dx = _lstm_back(np.ascontiguousarray(dj[:, :, :h]), x, model["fx"], model["fh"], keep_f)
            grads["bx"], grads["bh"], grads["bb"], dxb = _lstm_back(
                np.ascontiguousarray(dj[::-1, :, h : 2 * h]), back, model["bx"], model["bh"], keep_b
            )
            dx = dx + dxb[::-1] + dj[:, :, 2 * h :]
            for name, slot, lo, size in (("path", 0, 0, SIZES["path"]), ("word", 2, SIZES["path"], SIZES["word"])):
                grads[name] = np.zeros_like(model[name])
                for i, page in enumerate(own):
                    ids, counts = page[slot], page[slot + 1]
                    each = dx[: len(counts), i, lo : lo + size] / np.maximum(1, counts + PRIOR[name])[:, None]
                    np.add.at(grads[name], ids, np.repeat(each, counts, axis=0))
            step += 1
            now = rate * (0.3 if r >= rounds - 2 else 1.0)
            for k, g_ in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g_
                second[k] = 0.999 * second[k] + 0.001 * g_**2
                model[k] = model[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in model.items()}


# ---- the training pages ----------------------------------------------------------------------------------------------------------

MAIN = "\ue000"  # marks the text of main blocks while a page is composed


class _Composer:
    def __init__(self, seed: int):
        self.r = np.random.Generator(np.random.PCG64(seed))
        self.syllables = [
            "".join(
                self.pick("bcdfghklmnprstvwzéñß") + self.pick("aeiouéüöa")
            ) + (self.pick("nrstl") if self.odds(0.3) else "") for _ in range(40)
        ]
        self.tail = self.pick(["", "", "", "", "!!", "###", "&amp;&amp;", " |", "***"]) if self.odds(0.4) else ""

    def pick(self, options):
        return options[int(self.r.integers(len(options)))]

    def odds(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def word(self) -> str:
        return "".join(self.pick(self.syllables) for _ in range(int(self.r.integers(1, 4))))

    def words(self, lo: int, hi: int, main: bool = False) -> str:
        n = int(self.r.integers(lo, hi + 1))
        said = " ".join(self.word() + (self.tail if main else "") for _ in range(n))
        return (said.upper() if self.tail == "!!" and main else said.capitalize()) + self.pick([".", ".", "", "!", "?"])

    def named(self, tags: str, names: str, text: str, always: bool = False) -> str:
        tag, name = self.pick(tags.split()), self.pick(names.split())
        if self.odds(0.3):
            name = f"{self.pick(['site', 'page', 'main', 'block', 'c', 'wp', 'x' + str(self.r.integers(99)), 'blog', 'top', 'col'])}{self.pick(['-', '_', ' '])}{name}"
        how = self.pick(["class", "class", "id", "role"]) if not always else self.pick(["class", "class", "id"])
        attr = f' {how}="{name}"' if always or tag in ("div", "section", "ul", "p", "span") or self.odds(0.5) else ""
        if self.odds(0.1):
            tag = tag.upper()
        return f"<{tag}{attr}>{text}</{tag.lower() if self.odds(0.9) else tag}>\n"

    def links(self, lo: int, hi: int) -> str:
        n = int(self.r.integers(lo, hi + 1))
        said = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(n)]
        return self.pick(
            [
                lambda: "<ul>" + "".join(f"<li>{s}</li>" for s in said) + "</ul>", lambda: " ".join(said), lambda: " | ".join(said),
                lambda: "".join(f"<div>{s}</div>" for s in said), lambda: "".join(f"<li>{s}" for s in said)
            ]
        )()

    def prose(self, lo: int, hi: int, size: int = 30) -> str:
        tag = self.pick(["p", "p", "p", "div", ""])
        n = int(self.r.integers(lo, hi + 1))
        return "".join(f"<{tag}>{self.words(3, size)}</{tag}>" if tag else self.words(3, size) + " " for _ in range(n))

    def clutter(self) -> str:
        return self.pick([self.menu, self.advert, self.notice, self.sidebar, self.form, self.social, self.related])()

    def menu(self) -> str:
        return self.named(
            "nav nav div ul", "nav menu navbar navigation breadcrumb breadcrumbs topnav topbar links pagination toc", self.links(2, 9),
            self.odds(0.4)
        )

    def header(self) -> str:
        inside = self.pick(
            [
                lambda: f"<h1>{self.words(1, 4)}</h1>", lambda: f"<div class=logo>{self.words(1, 3)}</div>", lambda: self.prose(1, 2, 10),
                lambda: f"<a href='/'>{self.words(1, 3)}</a>"
            ]
        )()
        return self.named("header header div", "header masthead banner top branding", inside + (self.menu() if self.odds(0.5) else ""))

    def advert(self) -> str:
        return self.named(
            "div div aside section ins",
            "ad ads advert advertisement sponsored sponsor promo promotion banner adsbygoogle adbox commercial ad-slot adsense outbrain",
            self.prose(1, 3, 25), True
        )

    def notice(self) -> str:
        more = f"<button>{self.words(1, 2)}</button>" if self.odds(0.4) else ""
        return self.named(
            "div div section aside p",
            "notice cookie cookies consent gdpr alert popup modal subscribe newsletter paywall warning message announcement toast "
            "disclaimer cookiebar notification status hint",
            self.prose(1, 2, 25) + more, True
        )

    def sidebar(self) -> str:
        return self.named(
            "aside aside div section", "sidebar widget widgets rail secondary aside column side complementary sidebar-right",
            f"<h3>{self.words(1, 3)}</h3>" + self.pick([lambda: self.links(2, 8), lambda: self.prose(1, 4)])()
        )

    def related(self) -> str:
        return self.named(
            "div section aside ul", "related recommended popular trending more-stories also-read teaser latest",
            f"<h2>{self.words(1, 3)}</h2>" + self.links(2, 6), True
        )

    def social(self) -> str:
        return self.named("div ul section", "share sharing social follow tools tags meta byline", self.links(2, 5), True)

    def form(self) -> str:
        more = lambda: self.pick(
            ["", "", "", f"<select><option>{self.words(1, 2)}</select>", f"<textarea name={self.word()}>{self.words(0, 5)}</textarea>"]
        )
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name={self.word()}>{more()}" for _ in range(int(self.r.integers(1, 4))))
        return f'<form{self.pick(["", " class=search", " id=signup", " class=login-form", " action=/s"])}>{self.prose(0, 2, 12)}{fields}<button>{self.words(1, 2)}</button></form>'

    def comments(self) -> str:
        tag = self.pick(["div", "li", "article", "section", "p"])
        each = "".join(
            f'<{tag}{self.pick(["", " class=comment", " class=reply", " class=comment-body"])}>{self.pick(["", f"<b>{self.word()}</b> ", f"<cite>{self.word()}</cite>", f"<h4>{self.word()}</h4>"])}{self.prose(1, 2)}</{tag}>' for _ in range(
                int(self.r.integers(1, 7))
            )
        )
        return self.named(
            "div section ol ul aside",
            "comments comment-list commentlist responses discussion disqus_thread replies reviews user-comments reader-comments "
            "comment-section feedback",
            f"<h3>{self.words(1, 3)}</h3>" + each + (self.form() if self.odds(0.3) else ""), True
        )

    def footer(self) -> str:
        said = self.pick(
            [
                lambda: f"&copy; {self.word()}.example.com &middot; {self.words(2, 12)}\n{self.words(1, 5)}", lambda: self.links(2, 7),
                lambda: self.prose(1, 2, 15), lambda: f"<p>Copyright 20{self.r.integers(10, 26)} {self.words(1, 4)}</p>"
            ]
        )()
        return self.named(
            "footer footer footer div", "footer bottom copyright colophon legal siteinfo contentinfo foot", said, self.odds(0.3)
        )

    def said(self, lo: int, hi: int) -> str:
        """Main text, with some inline markup."""
        text = MAIN + self.words(lo, hi, True)
        if self.odds(0.3):
            text = f"{text} <{(t := self.pick(['b', 'i', 'em', 'strong', 'a', 'span', 'code']))}>{self.words(1, 4, True)}</{t}> {self.words(1, 6, True)}"
        if self.odds(0.15):
            text = f"<b>{text}" + ("</b>" if self.odds(0.5) else "")
        if self.odds(0.03):
            text += f" <math><mi>{self.word()}</mi><mo>=</mo><mn>2</mn></math> {self.word()}"
        return text + ("<br>" + self.words(2, 9, True) if self.odds(0.15) else "")

    def main_block(self) -> str:
        k = self.r.random()
        if k < 0.62:
            return f"<p>{self.said(1, 3 if self.odds(0.25) else 45)}" + ("</p>" if self.odds(0.85) else "")
        if k < 0.74:
            return f"<h{(n := self.pick('2234'))}>{self.said(1, 8)}</h{n}>"
        if k < 0.81:
            tag = self.pick(["ul", "ol"])
            return f"<{tag}>" + "".join(
                f"<li>{self.said(1, 14)}" + ("</li>" if self.odds(0.8) else "") for _ in range(int(self.r.integers(1, 7)))
            ) + f"</{tag}>"
        if k < 0.86:
            return f"<blockquote>{self.pick(['', '<p>'])}{self.said(3, 30)}</blockquote>"
        if k < 0.90:
            return "<table>" + "".join(
                "<tr>" + "".join(
                    f"<td>{self.said(1, 4)}</td>" for _ in range(int(self.r.integers(1, 4)))
                ) + "</tr>" for _ in range(int(self.r.integers(1, 4)))
            ) + "</table>"
        if k < 0.93:
            return f"<pre>{self.said(2, 30)}</pre>"
        if k < 0.96:
            return f"<figure><img src=x.png><figcaption>{self.said(2, 12)}</figcaption></figure>"
        return f"<div>{self.said(2, 40)}</div>"

    def article(self) -> str:
        n = int(self.r.integers(1, 6)) if self.odds(0.4) else int(self.r.integers(4, 36))
        if self.odds(0.06):
            n = int(self.r.integers(40, 90))
        body = [self.main_block() for _ in range(n)]
        if self.odds(0.35):  # a short end
            body.append(f"<p>{self.said(1, 2)}</p>")
        if self.odds(0.1):  # the same lines again and again
            k = int(self.r.integers(n))
            body[k:k] = [body[k]] * int(self.r.integers(2, 40))
        for _ in range(int(self.r.integers(1, 3)) if self.odds(0.35) else 0):
            body.insert(
                int(self.r.integers(len(body) + 1)),
                self.pick([self.advert, self.notice, self.related, self.social, self.form, self.sidebar])()
            )
        title = f"<h1>{self.said(2, 12)}</h1>" if self.odds(0.85) else ""
        if title and self.odds(0.2):
            title = f"<header>{title}</header>"
        text = title + self.pick(["", "\n"]).join(body) + (self.comments() if self.odds(0.12) else "")
        kind = self.r.random()
        if kind < 0.5:
            return f"<article{self.pick(['', '', ' class=post', ' id=story'])}>{text}</article>"
        if kind < 0.65:
            return f"<main>{text}</main>"
        if kind < 0.88:
            return self.named(
                "div div section",
                "content post entry article article-body story post-content entry-content main body text hentry page-content", text, True
            )
        return text if kind < 0.97 else f"<div>{text}</div>"

    def page(self) -> str:
        before = [
            f for f,
            p in (
                (self.header, 0.5), (self.menu, 0.75), (self.notice, 0.3), (self.advert, 0.45), (self.form, 0.15), (self.sidebar, 0.15)
            ) if self.odds(p)
        ]
        after = [
            f for f,
            p in (
                (self.comments, 0.4), (self.sidebar, 0.3), (self.related, 0.3), (self.advert, 0.25), (self.form, 0.15),
                (self.social, 0.2), (self.notice, 0.2), (self.menu, 0.15)
            ) if self.odds(p)
        ]
        self.r.shuffle(before)
        self.r.shuffle(after)
        if self.odds(0.85):
            after.append(self.footer)
        if self.odds(0.06):
            before, after = [], []
        inner = "".join(f() for f in before) + self.article() + "".join(f() for f in after)
        for _ in range(int(self.r.integers(0, 3)) if self.odds(0.4) else 0):
            inner = f'<div{self.pick(["", " id=page", " class=wrapper", " class=container", " id=root", " class=layout"])}>{inner}</div>'
        for _ in range(int(self.r.integers(2, 25)) if self.odds(0.1) else 0):  # a page builder's wrappers
            names = " ".join(
                self.pick(
                    ["row", "flex", "grid", "col", "px", "mt", "w", "inner", self.word()]
                ) for _ in range(int(self.r.integers(1, 6)))
            )
            inner = f'<div class="{names}">{inner}</div>'
        return f'<!DOCTYPE html><html lang="en"><head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style></head><body>{inner}' + (
            "</body></html>" if self.odds(0.9) else ""
        )


def training_page(seed: int, seen: np.ndarray | None = None) -> tuple[list[tuple[str, tuple[int, ...], int]], np.ndarray]:
    """A composed page's blocks and their labels."""
    found, labels = [], []
    for text, path, linked in leaf_blocks(_Composer(seed).page(), seen):
        labels.append(MAIN in text)
        if plain := " ".join(text.replace(MAIN, "").split()):
            found.append((plain, path, linked))
        else:
            labels.pop()
    return found, np.array(labels, np.float32)


LEAST_PAGES = 8


def train(pages: int = 5000) -> dict[str, np.ndarray]:
    """Weights fitted on composed pages; `seen` marks the path tokens that LEAST_PAGES of them have."""
    counts = np.zeros(PATHS, np.int64)
    for i in range(pages):
        counts[list({t for _, path, _ in training_page(i)[0] for t in path})] += 1
    seen = counts >= LEAST_PAGES
    made = [p for p in (training_page(i, seen) for i in range(pages)) if len(p[1])]
    return fit([numbers(b) for b, _ in made], [y for _, y in made]) | {"seen": seen}


@lru_cache(1)
def trained() -> dict[str, np.ndarray]:
    """The weights beside this module."""
    with np.load(WEIGHTS) as kept:
        return {k: kept[k].astype(bool if k == "seen" else np.float32) for k in kept.files}


def _extract(shared, batch_pages: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, kept, waiting = [""] * batch.num_rows, [0] * batch.num_rows, []

            def decide(waiting=waiting, texts=texts, kept=kept) -> None:
                sizes = [len(blocks) for _, blocks in waiting]
                for group in together(sizes):
                    pages = [numbers(waiting[g][1]) for g in group]
                    marks = label(model, pages) if sizes[group[-1]] <= CELLS else [label_long(model, pages[0])]
                    for g, p in zip(group, marks, strict=True):
                        i, blocks = waiting[g]
                        main = [b[0] for b, x in zip(blocks, p, strict=True) if x >= 0.5]
                        texts[i], kept[i] = " ".join(main), len(main)
                waiting.clear()

            held = 0
            for i, page in enumerate(column(batch, "html")):
                if blocks := leaf_blocks(page, model["seen"]):
                    waiting.append((i, blocks))
                    held += len(blocks)
                if len(waiting) >= batch_pages or held >= CELLS:
                    decide()
                    held = 0
            decide()
            columns = [
                batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                pa.array(kept, pa.int32())
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars", "n_blocks"])

    return run


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: dict[str, np.ndarray] | None = None
) -> DataFrame:
    """id, url, text (main blocks joined by a space), n_chars, n_blocks of every page."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(base.dtypes)
    schema = f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint, n_blocks int"
    return base.mapInArrow(lean(_extract(shared)), schema).withColumnsRenamed({"id": id_col, "url": url_col})


def op1_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


if __name__ == "__main__":
    np.savez_compressed(
        WEIGHTS, **{k: v.astype(bool if k == "seen" else np.float16 if k in ("path", "word") else np.float32) for k, v in train().items()}
    )
