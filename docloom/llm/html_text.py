"""HTML extraction: a bidirectional recurrent labeller over the leaf blocks of a page.

A page is cut into leaf blocks, each with its path of tags and class names. Two long short-term memory passes,
one from either end of the page, read a vector of the hashed path, the hashed words and a few measures of every
block, so that each block is judged with the whole page in view; blocks labelled as main text are kept in page
order. The network is trained on the driver, from a fixed seed, on ``TRAIN_PAGES`` invented pages of varied
layout whose labels are known; pages are then labelled one batch at a time in the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_SIZE, WORD_SIZE, MEASURES = 96, 24, 8
HIDDEN = 20
WIDTH = PATH_SIZE + WORD_SIZE + MEASURES
TRAIN_PAGES, EPOCHS, BATCH, SEED = 560, 14, 32, 7
DEPTH = 512  # levels that are looked up for an element to close
AREA = 24_000  # blocks, with padding, that are labelled at a time

# Elements of the HTML standard by how they are read.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea head".split())
QUIET = frozenset("template svg iframe canvas audio video select".split())
MATH = frozenset("math annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = MATH | frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main nav aside footer header body form blockquote".split())

# quotes count only after an equals sign, and nothing is given back: a page is read in one pass
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]|=\s*+"[^"]*"|=\s*+'[^']*'|=)*+)>""", re.S)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_END_OF: dict = {}


class Open:
    """An open element: what it adds to the path, and the hashed names, length and marks of the path so far."""

    __slots__ = ("tag", "names", "above", "mask", "length", "marks")

    def __init__(self, tag: str, names: tuple[str, ...], above: Open | None):
        self.tag, self.names, self.above = tag, () if tag in INLINE else (tag, *names), above
        self.mask, self.length, self.marks = (above.mask, above.length, above.marks) if above else (0, 0, 0)
        for name in self.names:
            self.mask |= 1 << _slot(name, PATH_SIZE)
            self.marks |= (name == "p") + 2 * (name in ("h1", "h2", "h3", "h4"))
        self.length += len(self.names)


class Block:
    """A leaf block: its text, the innermost element it stands in, and how many of its characters are linked."""

    __slots__ = ("text", "inside", "linked")

    def __init__(self, text: str, inside: Open | None, linked: float):
        self.text, self.inside, self.linked = text, inside, linked

    @property
    def path(self) -> tuple[str, ...]:
        """The names on the way to the block, outermost first."""
        at, found = self.inside, []
        while at:
            found.append(at.names)
            at = at.above
        return tuple(name for names in reversed(found) for name in names)


def _end_of(tag: str) -> re.Pattern:
    if tag not in _END_OF:
        _END_OF[tag] = re.compile(rf"</{tag}\s*>", re.I)
    return _END_OF[tag]


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order; comments, scripts, styles, pictures, players and form controls leave no text.

    What such an element holds is left out only if it is closed before its parent is; if not, it counts as empty.
    """
    found: list[Block] = []
    stack: list[Open] = []
    opened: Counter = Counter()
    parts: list[str] = []
    linked = 0
    ahead: dict[str, int] = {}
    last_sign = html.rfind(">")

    def closes_at(tag: str, at: int) -> int:
        """Where the next close tag of that name stands, or the end of the page."""
        if ahead.get(tag, -1) < at:
            found = _end_of(tag).search(html, at)
            ahead[tag] = found.start() if found else len(html)
        return ahead[tag]

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append(Block(text, stack[-1] if stack else None, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if opened["a"]:
                linked += len(text)

    def close(depth: int) -> None:
        for gone in stack[depth:]:
            opened[gone.tag] -= 1
        del stack[depth:]

    at, end = 0, len(html)
    while at < end:
        mark = html.find("<", at)
        if mark < 0 or mark > last_sign:
            say(html[at:])
            break
        say(html[at:mark])
        token = _TOKEN.match(html, mark)
        if token is None:  # a lone sign
            say("<")
            at = mark + 1
            continue
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if tag not in INLINE:
                flush()
            if opened[tag]:
                close(next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth].tag == tag))
            continue
        if tag in RAW:
            shut = closes_at(tag, at)
            parts.append(" ")
            if tag == "head" and shut == end:
                continue
            at = _end_of(tag).match(html, shut).end() if shut < end else end
            continue
        empty = token[3].rstrip().endswith("/")
        if tag in QUIET or tag == "button" and opened["form"]:
            parts.append(" ")
            shut = end if empty else closes_at(tag, at)
            parent = next((x.tag for x in stack[: -DEPTH - 1 : -1] if x.tag not in INLINE), None)
            if shut < end and (parent is None or shut < closes_at(parent, at)):
                at = _end_of(tag).match(html, shut).end()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            if tag not in ("wbr", "img"):
                parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            ends = CLOSES.get(tag, {"p"} if tag in SCOPES or tag[0] == "h" and tag[1:].isdigit() else ())
            if any(opened[x] for x in ends):
                # elements left open are closed up to the next scope, at most DEPTH levels up
                for depth in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                    if stack[depth].tag in ends:
                        close(depth)
                        break
                    if stack[depth].tag in SCOPES:
                        break
        names = tuple(w for m in _MARK.finditer(token[3]) for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower()))
        if not empty:
            stack.append(Open(tag, names, stack[-1] if stack else None))
            opened[tag] += 1
    flush()
    return found


def _slot(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


@lru_cache(maxsize=65_536)
def _path_vector(mask: int) -> np.ndarray:
    out = np.unpackbits(np.frombuffer(mask.to_bytes(PATH_SIZE // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
    out.setflags(write=False)
    return out


def vectors(found: list[Block]) -> np.ndarray:
    """Blocks as rows of the network's input: hashed path, all words hashed, and a few measures."""
    out = np.zeros((len(found), WIDTH), np.float32)
    for row, block in zip(out, found):
        words = block.text.lower().split()
        at = block.inside
        if at:
            row[:PATH_SIZE] = _path_vector(at.mask)
        counts = np.bincount([_slot(word, WORD_SIZE) for word in words], minlength=WORD_SIZE)
        row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.minimum(counts / (np.sqrt(len(words)) * 2), 1.0)
        row[PATH_SIZE + WORD_SIZE :] = (
            min(len(words), 200) / 50,
            len(words) < 4,
            block.linked,
            block.text[-1:] in ".!?",
            min(at.length if at else 0, 20) / 10,
            "©" in block.text,
            bool(at and at.marks & 1),
            bool(at and at.marks & 2),
        )
    return out


class Labeller:
    """The two recurrent passes and the read-out, in numpy."""

    def __init__(self, rng: np.random.Generator):
        scale = 1 / np.sqrt(WIDTH)
        self.p = {}
        for way in ("f", "b"):
            self.p[f"w{way}"] = (rng.standard_normal((WIDTH, 4 * HIDDEN)) * scale).astype(np.float32)
            self.p[f"u{way}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            self.p[f"c{way}"] = bias
        self.p["out"] = (rng.standard_normal((2 * HIDDEN + WIDTH)) * 0.1).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 * (np.tanh(0.5 * x) + 1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        docs, longest, _ = x.shape
        h, c = np.zeros((docs, HIDDEN), np.float32), np.zeros((docs, HIDDEN), np.float32)
        out = np.zeros((docs, longest, HIDDEN), np.float32)
        given = x @ self.p[f"w{way}"] + self.p[f"c{way}"]
        for t in range(longest) if way == "f" else range(longest - 1, -1, -1):
            z = given[:, t] + h @ self.p[f"u{way}"]
            i, f, o = (self._sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = f * c + i * g
            squashed = np.tanh(c_new)
            h_new = o * squashed
            if keep is not None:
                keep.append((t, i, f, o, g, h, c, squashed, m))
            h, c = np.where(m, h_new, h), np.where(m, c_new, c)
            out[:, t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, "f"), self._pass(x, mask, "b"), x], axis=2)
        return self._sigmoid(both @ self.p["out"] + self.p["bias"])

    def _slopes(self, x: np.ndarray, mask: np.ndarray, way: str, kept: list, slope: np.ndarray) -> dict:
        w, u = np.zeros_like(self.p[f"w{way}"]), np.zeros_like(self.p[f"u{way}"])
        bias = np.zeros_like(self.p[f"c{way}"])
        dh_next = np.zeros((len(x), HIDDEN), np.float32)
        dc_next = np.zeros_like(dh_next)
        for t, i, f, o, g, h, c, squashed, m in reversed(kept):
            dh_all = slope[:, t] + dh_next
            dh = np.where(m, dh_all, 0)
            dc = np.where(m, dc_next, 0) + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            w += x[:, t].T @ dz
            u += h.T @ dz
            bias += dz.sum(0)
            dh_next = dz @ self.p[f"u{way}"].T + np.where(m, 0, dh_all)
            dc_next = np.where(m, dc * f, dc_next)
        return {f"w{way}": w, f"u{way}": u, f"c{way}": bias}

    def slopes(self, x: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> dict:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._pass(x, mask, "f", kept["f"]), self._pass(x, mask, "b", kept["b"]), x], axis=2)
        off = (self._sigmoid(both @ self.p["out"] + self.p["bias"]) - truth) * mask / mask.sum()
        found = {"out": np.einsum("dtk,dt->k", both, off), "bias": np.array([off.sum()], np.float32)}
        back = off[..., None] * self.p["out"]
        for k, way in enumerate("fb"):
            found |= self._slopes(x, mask, way, kept[way], back[..., k * HIDDEN : (k + 1) * HIDDEN])
        return found

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator, epochs: int = EPOCHS) -> None:
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
        for epoch in range(epochs):
            rate = 0.01 if epoch < epochs // 2 else 0.003
            for b in rng.permutation(len(batches)):
                x, mask = padded([pages[i][0] for i in batches[b]])
                truth = np.zeros(mask.shape, np.float32)
                for row, i in enumerate(batches[b]):
                    truth[row, : len(pages[i][1])] = pages[i][1]
                # names and words that tell too much are hidden at random, so that several are learned from
                x[..., : PATH_SIZE + WORD_SIZE] *= rng.random((len(x), 1, PATH_SIZE + WORD_SIZE)) < 0.85
                step += 1
                for k, slope in self.slopes(x, mask, truth).items():
                    slope = np.clip(slope, -1, 1)
                    first[k] += 0.1 * (slope - first[k])
                    second[k] += 0.01 * (slope**2 - second[k])
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, parts))
    x, mask = np.zeros((len(parts), longest, WIDTH), np.float32), np.zeros((len(parts), longest), bool)
    for i, part in enumerate(parts):
        x[i, : len(part)], mask[i, : len(part)] = part, True
    return x, mask


_ASIDE = "nav menu navbar breadcrumb breadcrumbs header masthead topbar footer bottom copyright sidebar aside widget related recommended notice cookie consent banner alert ad ads advert advertisement sponsored promo form login signup subscribe newsletter search comments comment reply discussion respond disqus share social pagination pager tags legal popup modal".split()
_MAIN = "article content main post entry story text page body".split()
_PLAIN = "container wrapper row col inner section block box grid wrap clearfix left right center".split()


def _without_marks(at: Open | None) -> Open | None:
    """A path without the elements that carry the labels."""
    if at is None:
        return None
    above = _without_marks(at.above)
    return above if at.tag.startswith("x-") else Open(at.tag, at.names[1:], above)


def invented_page(rng: np.random.Generator) -> list[tuple[Block, bool]]:
    """A page of a random layout, as blocks with their labels."""

    def pick(options):
        return options[int(rng.integers(len(options)))]

    letters = "abcdefghijklmnopqrstuvwxyzéüñ"

    def word() -> str:
        return "".join(letters[int(k)] for k in rng.integers(0, len(letters), rng.integers(2, 9)))

    def text(low: int, high: int, stop: bool) -> str:
        words = [word() for _ in range(int(rng.integers(low, high)))]
        style = rng.random()
        if style < 0.2:  # signs between the words, as in listings and junk of any place
            sign, often = pick(["|", "|", "-", "#", "$$", "***", "/"]), pick([0.2, 0.5, 1.0])
            words = [x for w in words for x in ((w, sign) if rng.random() < often else (w,))]
        elif style < 0.3:
            words = [w.upper() if rng.random() < 0.5 else w for w in words]
        elif style < 0.4:
            words = [str(rng.integers(0, 10**6)) if rng.random() < 0.3 else w for w in words]
        return " ".join(words) + ("." if stop else "")

    def junk(kind: str, tag: str) -> str:
        label = "" if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5 else f' class="{kind}{pick(["", "-list", "-box", " " + pick(_PLAIN)])}"'
        n = int(rng.integers(1, pick([4, 9, 9, 40])))
        style = rng.random()
        if kind in ("comments", "comment", "reply", "discussion", "respond", "disqus"):
            inner = "".join(f'<{pick(["li", "div"])} class="{pick(["comment", "reply", "item"])}"><p>{text(3, 60, True)}</p></div>' for _ in range(n))
        elif style < 0.45:
            inner = "<ul>" + "".join(f'<li><a href="/x">{text(1, 4, False)}</a></li>' for _ in range(n)) + "</ul>"
        elif style < 0.75:
            inner = text(2, 25, rng.random() < 0.7)
        else:
            inner = "".join(f"<p>{text(2, 30, True)}</p>" for _ in range(int(rng.integers(1, 4))))
        if kind in ("footer", "bottom", "copyright", "legal") and rng.random() < 0.6:
            inner = "&copy; " + inner
        return f"<{tag}{label}>{inner}</{tag}>"

    def aside() -> str:
        kind = pick(_ASIDE)
        own = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "aside": "aside", "form": "form", "comments": "section"}
        return junk(kind, own[kind] if kind in own and rng.random() < 0.6 else pick(["div", "div", "section", "aside"]))

    def body() -> str:
        out = [f"<h1>{text(2, 12, rng.random() < 0.3)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, pick([4, 14, 14, 50, 140])))):
            kind = rng.random()
            if kind < 0.72:
                lead, tail = pick([("<p>", "</p>"), ("<p>", ""), ("<p><b>", "<br>"), ("<p>", "</p>"), ("<div>", "</div>")])
                out.append(lead + text(1, pick([4, 20, 120]), True) + tail)
            elif kind < 0.82:
                out.append(f"<{(h := pick(['h2', 'h3']))}>{text(1, 8, False)}</{h}>")
            elif kind < 0.92:
                out.append("<ul>" + "".join(f"<li>{text(2, 20, rng.random() < 0.5)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.96:
                out.append(f"<blockquote>{text(5, 40, True)}</blockquote>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{text(1, 4, False)}</td><td>{text(1, 3, False)}</td></tr>" for _ in range(3)) + "</table>")
        return "".join(out)

    def wrapped(inner: str) -> str:
        for _ in range(int(rng.integers(0, 3))):
            inner = f'<div class="{pick(_PLAIN)}">{inner}</div>'
        return inner

    main = pick(["article", "main", "div", "section", "article"])
    label = f' class="{pick(_MAIN)}"' if main in ("div", "section") or rng.random() < 0.3 else ""
    inside = junk(pick(["ad", "advert", "share", "related", "promo", "newsletter"]), pick(["div", "aside"])) if rng.random() < 0.25 else ""
    before = "".join(aside() for _ in range(int(rng.integers(0, 5))))
    after = "".join(aside() for _ in range(int(rng.integers(0, 5))))
    open_main, close_main = f"<{main}{label}>", f"</{main}>"
    found: list[tuple[Block, bool]] = []
    whole = wrapped(f"{before}{open_main}{wrapped(body() + '<x-in></x-in>' + inside + '<x-out></x-out>' + (body() if inside else ''))}{close_main}{after}")
    # labels: what stands in the main element, but for the insertion
    first = whole.index(open_main, len(whole) - len(whole.lstrip()))
    first = whole.index(open_main + "", whole.find(before) + len(before)) if before else first
    marks = whole[: first + len(open_main)] + "<x-main>" + whole[first + len(open_main) :]
    last = marks.rindex(close_main + after) if after else marks.rindex(close_main)
    marks = marks[:last] + "</x-main>" + marks[last:]
    marks = marks.replace("<x-in></x-in>", "<x-junk>").replace("<x-out></x-out>", "</x-junk>")
    for block in blocks(f"<html><body>{marks}</body></html>"):
        found.append((Block(block.text, _without_marks(block.inside), block.linked), "x-main" in block.path and "x-junk" not in block.path))
    return found


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Labeller:
    """The labeller trained on invented pages; kept for the life of the driver."""
    rng = np.random.default_rng(seed)
    made = [p for p in (invented_page(rng) for _ in range(pages)) if p]
    model = Labeller(rng)
    model.train([(vectors([b for b, _ in page]), np.array([y for _, y in page], np.float32)) for page in made], rng)
    return model


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, whether each of its blocks is main text; pages of similar length share a batch."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= AREA:
            end += 1
        batch = order[at:end]
        x, mask = padded([vectors(pages[i]) for i in batch])
        good = model.probabilities(x, mask) >= 0.5
        for row, i in enumerate(batch):
            out[i] = good[row, : len(pages[i])]
        at = end
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of each row of ``pages`` (page_id, url, html).

    A null or empty html, and one without main text, give an empty text. Null ids and urls stay null; repeated
    rows are extracted each; other columns are ignored; an empty table stays empty.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_kept", pa.int64())])
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [blocks(html or "") for html in batch.column(2).to_pylist()]
                good = label(shared.value, found)
                texts = ["\n".join(b.text for b, keep in zip(page, marks) if keep) for page, marks in zip(found, good)]
                counts = [map(len, texts), map(len, found), (int(g.sum()) for g in good)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(list(c), pa.int64()) for c in counts)], schema=schema)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
