"""Main text of web pages by a linear-chain conditional random field.

A page is cut into DOM leaf blocks: runs of text between block-level tags, with
their open ancestors. Each block has features of its ancestors' tags, classes
and ids and of its text; a two-label chain (text or not) is decoded by Viterbi.
The field is trained, on first use, on labelled pages that ``training_pages``
lays out in many site styles, with articles, marked as such or not, and the
furniture around them. A tag's quotes count only where they close a value.

Defined results: null or empty html gives an empty text; unclosed and stray tags
are tolerated as browsers do in simple cases; character references are decoded
(without their semicolon too, where HTML allows); white space in a block becomes
one space; blocks join by a blank line. Repeated rows are treated alike; an
empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import small_batches

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Content that is never text.
_DROPPED = frozenset("script style noscript template iframe object svg canvas audio video textarea head title select".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
#: Start tags that may stand in a head; any other ends it.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes an open tag of its group, up to the nearest of the limits.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = BLOCK_TAGS - {"body", "html", "head", "button", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "legend"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Containers that mark a page's article; blocks outside them are told apart on pages that have one.
_MARKED = frozenset("in:article in:main is:article is:content is:entry is:post is:story".split())


class Block:
    """One leaf block: the names that its ancestors' tags and attributes give, its nearest block-level tag, text, characters in links."""

    __slots__ = ("leaf", "linked", "names", "text")

    def __init__(self, names: frozenset[str], leaf: str, text: str, linked: int):
        self.names, self.leaf, self.text, self.linked = names, leaf, text, linked


@lru_cache(maxsize=4096)
def _attribute_words(attrs: str) -> tuple[str, ...]:
    found = []
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        found += _WORDS.findall(_CAMEL.sub(" ", value).lower())
    return tuple(dict.fromkeys(found))


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks with text, in order."""
    page = page or ""
    out: list[Block] = []
    # open tags, each with the names of all down to it (one set for many, where a tag adds none) and the nearest block-level tag
    stack: list[tuple[str, frozenset[str], str]] = []
    opened: Counter = Counter()
    parts: list[str] = []
    state = {"linked": 0, "dropped": 0}

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                _, names, leaf = stack[-1] if stack else ("", frozenset(), "")
                out.append(Block(names, leaf, text, state["linked"]))
            parts.clear()
        state["linked"] = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop()[0]
            opened[tag] -= 1
            state["dropped"] -= tag in _DROPPED

    def push(tag: str, words: tuple[str, ...]) -> None:
        _, names, leaf = stack[-1] if stack else ("", frozenset(), "")
        own = {f"is:{word}" for word in words}
        if tag in BLOCK_TAGS:
            leaf = tag
            if tag not in ("html", "body"):
                own.add(f"in:{tag}")
        stack.append((tag, names if own <= names else names | own, leaf))
        opened[tag] += 1
        state["dropped"] += tag in _DROPPED

    def end_head() -> None:
        if stack and stack[-1][0] == "head":
            pop_to(len(stack) - 1)

    def say(text: str) -> None:
        if text.strip():
            end_head()
        if text and not state["dropped"]:
            parts.append(text)
            if opened["a"]:
                state["linked"] += len(text)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if tag not in BLOCK_TAGS and stack[depth][0] in BLOCK_TAGS:
                    break  # an inline end tag doesn't reach past its block
            continue
        if tag not in _IN_HEAD:
            end_head()
        if tag in _ENDS_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in BLOCK_TAGS:
                    break
        if tag in _CLOSES:
            own, limits = _CLOSES[tag]
            for depth in range(len(stack) - 1, -1, -1) if any(opened[x] for x in own) else ():
                if stack[depth][0] in limits:
                    break
                if stack[depth][0] in own:
                    pop_to(depth)
                    if tag != "tr":
                        break
        if tag in _VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        push(tag, _attribute_words(attrs))
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def block_features(found: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    rows = []
    marked = [not _MARKED.isdisjoint(block.names) for block in found]
    some = any(marked)
    for i, block in enumerate(found):
        words = block.text.split()
        row = ["bias", *block.names, f"leaf:{block.leaf}"]
        if some and not marked[i]:
            row.append("outside")
        row.append(f"links:{min(3, 4 * block.linked // max(1, len(block.text)))}")
        row.append(f"words:{min(5, len(words).bit_length())}")
        row.append(f"stop:{block.text[-1] in '.!?:;»”\"'}")
        row += [name for name, hit in (("sign:copyright", "©" in block.text or "copyright" in block.text.lower()), ("edge:first", i == 0), ("edge:last", i == len(found) - 1), ("sign:bars", " | " in block.text or " · " in block.text)) if hit]
        rows.append(row)
    return rows


class Field:
    """A two-label linear chain: emission weights by feature, transition and start weights."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start

    def labels(self, rows: list[list[str]]) -> list[int]:
        """Viterbi's best labels (1: text)."""
        if not rows:
            return []
        none = (0.0, 0.0)
        (t00, t01), (t10, t11) = self.moves.tolist()
        back = []
        a, b = self.start.tolist()
        for i, row in enumerate(rows):
            found = [self.weights.get(name, none) for name in row]
            e0, e1 = sum(x[0] for x in found), sum(x[1] for x in found)
            if i == 0:
                a, b = a + e0, b + e1
                continue
            from0, from1 = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 > b + t11 else 1)
            a, b = (a + t00 if from0 == 0 else b + t10) + e0, (a + t01 if from1 == 0 else b + t11) + e1
            back.append((from0, from1))
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(pages: list[tuple[str, list[int]]], steps: int = 200, ridge: float = 0.002) -> Field:
    """Maximum conditional likelihood by full-batch Adam; forward-backward over all pages at once, padded."""
    rows = [block_features(blocks(page)) for page, _ in pages]
    for row, (_, truth) in zip(rows, pages, strict=True):
        if len(row) != len(truth):
            raise ValueError("labels and blocks differ in number")
    names = {name: i for i, name in enumerate(sorted({n for row in rows for block in row for n in block}))}
    n, length, size = len(rows), max(map(len, rows)), len(names)
    x = np.zeros((n, length, size), dtype=np.float32)
    mask, gold = np.zeros((n, length), dtype=bool), np.zeros((n, length), dtype=int)
    for i, (row, (_, truth)) in enumerate(zip(rows, pages, strict=True)):
        mask[i, : len(row)], gold[i, : len(row)] = True, truth
        for j, block in enumerate(row):
            x[i, j, [names[name] for name in block]] = 1
    flat = x.reshape(n * length, size)
    hot = (gold[:, :, None] == [0, 1]) & mask[:, :, None]
    pair_gold = np.einsum("nta,ntb->ab", hot[:, :-1].astype(float), hot[:, 1:].astype(float))
    params = np.zeros(2 * size + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, moves, start = params[: 2 * size].reshape(size, 2), params[2 * size : 2 * size + 4].reshape(2, 2), params[-2:]
        emit = (flat @ w).reshape(n, length, 2)
        forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        forward[:, 0] = start + emit[:, 0]
        for t in range(1, length):
            new = np.logaddexp(forward[:, t - 1, 0, None] + moves[0], forward[:, t - 1, 1, None] + moves[1]) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            ahead = backward[:, t + 1] + emit[:, t + 1]
            new = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(mask[:, t + 1, None], new, backward[:, t + 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        pair = np.zeros((2, 2))
        for t in range(1, length):
            joint = forward[:, t - 1, :, None] + moves + (emit[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            pair += np.exp(np.where(mask[:, t, None, None], joint, -np.inf)).sum(0)
        grad = np.concatenate([(flat.T @ (single - hot).reshape(n * length, 2)).ravel(), (pair - pair_gold).ravel(), (single[:, 0] - hot[:, 0]).sum(0)]) / n + ridge * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = params[: 2 * size].reshape(size, 2)
    return Field({name: (float(w[i, 0]), float(w[i, 1])) for name, i in names.items()}, params[2 * size : 2 * size + 4].reshape(2, 2), params[-2:])


def training_pages(count: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages with their blocks' labels, laid out at random from parts of common site styles."""
    rng = random.Random(seed)
    syllables = "ka lo mi ten sur eta no vi del ran po ist ur".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice(["."] * 8 + ["!", "?", ""])

    def prose(low: int = 1, high: int = 5) -> str:
        return " ".join(sentence(3, 16) for _ in range(rng.randint(low, high)))

    def links(tag: str = "li") -> list[str]:
        return [f'<{tag}><a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 3)))}</a></{tag}>' for _ in range(rng.randint(2, 6))]

    def named(*names: str) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'

    def menu() -> tuple[str, int]:
        items = links()
        inner = f"<ul>{''.join(items)}</ul>"
        kind = rng.randint(0, 3)
        if kind == 3:
            items = links("span")
            return f"<div{named('menu', 'nav', 'navigation', 'topnav main-menu', 'breadcrumb')}>{' '.join(items)}</div>", 1
        return (f"<nav>{inner}</nav>", f"<div{named('menu', 'navbar', 'nav', 'navigation')}>{inner}</div>", f"<header>{inner}</header>")[kind], len(items)

    def header() -> tuple[str, int]:
        kind = rng.choice(["<header><h1>{}</h1><p>{}</p></header>", "<div" + named("header", "masthead", "site-header", "top") + "><h2>{}</h2><div>{}</div></div>", "<header" + named("page-header", "banner") + "><div>{}</div><p>{}</p></header>"])
        return kind.format(sentence(1, 5), prose(1, 2)), 2

    def advert() -> tuple[str, int]:
        tag = rng.choice(["div", "div", "aside", "section"])
        return f"<{tag}{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner ad', 'ad-box')}>{prose(1, 4)}</{tag}>", 1

    def sidebar() -> tuple[str, int]:
        tag, parts = rng.choice(["aside", "div", "section"]), [f"<p>{prose()}</p>" for _ in range(rng.randint(1, 3))]
        return f"<{tag}{named('sidebar', 'side', 'related', 'widget', 'aside', 'share', 'social', 'recommended')}>{''.join(parts)}</{tag}>", len(parts)

    def plain_aside() -> tuple[str, int]:
        return f"<aside><h3>{sentence(1, 4)}</h3><p>{prose()}</p></aside>", 2

    def notice() -> tuple[str, int]:
        tag = rng.choice(["div", "section", "div"])
        return f"<{tag}{named('notice', 'cookie', 'cookie-notice', 'cookies consent', 'newsletter', 'popup', 'modal', 'alert', 'subscribe', 'gdpr', 'warning', 'disclaimer')}><p>{prose(1, 3)}</p></{tag}>", 1

    def form() -> tuple[str, int]:
        return f"<form{rng.choice(['', named('search', 'login', 'signup', 'form')])}><label>{sentence(1, 5)}</label> <input name=q><p>{sentence(2, 8)}</p><button>{word()}</button></form>", 3

    def comments() -> tuple[str, int]:
        tag, inner, n = rng.choice(["div", "section", "ol", "ul"]), "", rng.randint(1, 4)
        for _ in range(n):
            inner += f"<li{named('comment', 'reply')}>{prose()}</li>" if tag in ("ol", "ul") else f"<div{named('comment', 'comment-body', 'reply', 'user comment')}><p>{prose()}</p></div>"
        return f"<{tag}{named('comments', 'comment-list', 'discussion', 'responses', 'comments reader', 'disqus thread')}>{inner}</{tag}>", n

    def footer() -> tuple[str, int]:
        text = rng.choice(["&copy; {} &middot; {}", "Copyright {} {}", "{} | {}", "{} {}"]).format(word() + ".example.org", prose(1, 3))
        return rng.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p></footer>", f"<div{named('footer', 'site-footer', 'bottom', 'copyright')}>{text}</div>"]), 1

    def article() -> tuple[str, list[int]]:
        inner, marks = "", []
        if rng.random() < 0.8:
            level = rng.choice(["h1", "h1", "h2"])
            inner += f"<{level}>{sentence(1, 12)}</{level}>"
            marks.append(1)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            kind = rng.random()
            if kind < 0.66:
                inner += f"<p>{sentence(1, 3) if rng.random() < 0.25 else prose()}</p>"
                marks.append(1)
            elif kind < 0.76:
                inner += f"<p><b>{prose()}<br>"
                marks.append(1)
            elif kind < 0.81:
                inner += f"<h2>{sentence(1, 6)}</h2>"
                marks.append(1)
            elif kind < 0.87:
                items = [f"<li>{sentence(1, 9)}</li>" for _ in range(rng.randint(2, 4))]
                inner += f"<ul>{''.join(items)}</ul>"
                marks += [1] * len(items)
            elif kind < 0.90:
                inner += f"<blockquote><p>{prose()}</p></blockquote>"
                marks.append(1)
            elif kind < 0.92:
                inner += f"<table><tr><td>{sentence(1, 3)}</td><td>{sentence(1, 3)}</td></tr></table>"
                marks += [1, 1]
            elif kind < 0.94:
                inner += f'<p><a href="/{word()}">{sentence(2, 6)}</a> {sentence(1, 8)}</p>'
                marks.append(1)
            else:
                part, n = rng.choice([advert, sidebar, notice, form, plain_aside])()
                inner += part
                marks += [0] * n
        if rng.random() < 0.12:
            part, n = comments()
            inner += part
            marks += [0] * n
        style = rng.randint(0, 9)
        if style == 8:
            return rng.choice([f"<div>{inner}</div>", f"<div{named('wrapper', 'page', 'container', 'inner', 'left', 'col')}>{inner}</div>", f"<table><tr><td>{inner}</td></tr></table>"]), marks
        if style == 9:
            return inner, marks
        if style < 4:
            return f"<article>{inner}</article>", marks
        if style == 4:
            return f"<main>{inner}</main>", marks
        if style == 5:
            return f"<main><article{named('post', 'entry')}>{inner}</article></main>", marks
        return f"<div{named('content', 'article', 'post', 'entry-content', 'story', 'article-body', 'main', 'text body')}>{inner}</div>", marks

    pages = []
    for _ in range(count):
        body, marks = "", []
        for part in (menu, header, notice, advert, sidebar, form):
            if rng.random() < (0.8 if part is menu else 0.35):
                text, n = part()
                body += text
                marks += [0] * n
        text, own = article()
        body += text
        marks += own
        for part in (sidebar, plain_aside, comments, advert, form, menu, notice, footer):
            if rng.random() < (0.85 if part is footer else 0.25):
                text, n = part()
                body += text
                marks += [0] * n
        pages.append((f"<!DOCTYPE html><html><head><title>{sentence(1, 6)}</title><script>x('</p>')</script></head><body>{body}</body></html>", marks))
    return pages


@lru_cache(maxsize=1)
def trained() -> Field:
    return train(training_pages())


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    return "\n\n".join(block.text for block, label in zip(found, field.labels(block_features(found)), strict=True) if label)


def with_main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text; the field is trained on the driver and travels with the function."""
    small_batches(pages.sparkSession)
    field = trained()
    extract = F.pandas_udf(lambda s: pd.Series([main_text(x, field) for x in s], dtype="object"), "string")
    return pages.withColumn(name, extract(F.col(html)))
