"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into a flat list of text blocks. A block's features are its word count and link density, those of the blocks
before and after it, whether it is a heading, which of HTML's own sections hold it, and what the class and id words of its
holders came to in the labelled table. A decision tree, grown at first use on that table, says which blocks are main text.

Null and empty pages have an empty text; repeated pages repeat. Unclosed, truncated and wrongly nested mark-up is read as
far as it goes, in time that follows the page's length: an element that isn't text ends with its parent, a comment, script
or style that isn't closed at the page's end, as in browsers.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape
from itertools import cycle, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import extend

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")  # quotes count after = only
_RAW = {k: re.compile(rf"</{k}(?=[\s/>])[^>]*+>", re.I) for k in ("script", "style")}
_UNREAD = frozenset("noscript template svg iframe object select textarea math title".split())  # not text; one that isn't closed ends with its parent
_ATTR = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MODIFIER = re.compile(r"(?<!\S)(?:has|no|not|with|without)[-_]\S*")  # says what an element has, not what it is
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\s\xa0]+")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul button label".split())
_HOLDERS = frozenset("article aside body dialog details div dl fieldset figure footer form header main menu nav ol section table ul span button label blockquote".split())
_CHROME = frozenset("nav footer aside form menu dialog header button label fieldset".split())
_PUSHED = _BLOCK | _HOLDERS | _UNREAD
_WIDTH = 12


class _Block:
    __slots__ = ("text", "words", "linked", "chrome", "article", "heading", "names", "mark")

    def __init__(self, text, words, linked, heading, holder):
        self.text, self.words, self.linked, self.heading = text, words, linked, heading
        self.chrome, self.article, self.names, self.mark = holder[1:]


def _names(attrs: str) -> tuple[frozenset, bool]:
    """(class and id words, whether the element is hidden or says that it is the main one or a section of HTML's)."""
    words, unseen = set(), False
    for kind, value in _ATTR.findall(attrs):
        kind, value = kind.lower(), value.strip("\"'").lower()
        if kind == "hidden" or kind == "style" and _UNSEEN.search(value):
            unseen = True
        elif kind != "style":
            words.update(_WORD.findall(_MODIFIER.sub(" ", value)))
    return frozenset(words), unseen


def blocks(html: str) -> list[_Block]:
    """The text blocks of a page, in order."""
    out, parts = [], []
    words = linked = in_link = heading = 0
    none: frozenset = frozenset()
    stack = [("", 0, 0, none, None)]  # name, chrome, article, class and id words of all holders, mark of a training page
    open_, inner = Counter(), Counter()  # names on the stack; those among them that aren't read
    unread = 0  # place on the stack of the outermost element that isn't read
    loose = False  # quotes can't be trusted any more
    at, n = 0, len(html)

    def flush():
        nonlocal parts, words, linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append(_Block(text, words, linked, heading, stack[-1]))
        parts, words, linked = [], 0, 0

    def say(piece):
        nonlocal words, linked
        if piece and not unread:
            parts.append(piece)
            k = len(piece.split())
            words += k
            linked += k if in_link else 0

    def drop(to):
        for x in stack[to:]:
            open_[x[0]] -= 1
        del stack[to:]

    def leave():
        nonlocal unread
        drop(unread)
        inner.clear()
        unread = 0

    def up_to(name):
        """Place on the stack of the last such element, which is there."""
        k = len(stack) - 1
        while stack[k][0] != name:
            k -= 1
        return k

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        nxt = html[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            say(html[at:lt])
            end = html.find("-->", lt + 4) + 3 if html.startswith("<!--", lt) else html.find(">", lt) + 1
            if end < 3:
                break
            at = max(end, lt + 2)
            continue
        m = _NAME.match(html, lt + 1)
        if not m:
            say(html[at : lt + 1])
            at = lt + 1
            continue
        say(html[at:lt])
        rest = None if loose else _REST.match(html, m.end())
        if rest:
            end = rest.end()
        else:
            end = html.find(">", m.end()) + 1
            loose = True
            if not end:
                break  # a tag that the page's end cuts
        at, close, name = end, nxt == "/", m.group(1).lower()
        attrs = html[m.end() : end - 1]
        if name in _RAW:
            if not close:
                m = _RAW[name].search(html, at)
                if not m:
                    break
                at = m.end()
            continue
        if unread:
            if close and inner[name] > 0:
                k = up_to(name)
                if k == unread:
                    leave()
                else:
                    for x in stack[k:]:
                        inner[x[0]] -= 1
                    drop(k)
                continue
            title = stack[unread][0] == "title"
            if title or name in ("body", "head") or close and (name in _BLOCK if name not in _HOLDERS else open_[name] > inner[name]):  # the parent's end
                leave()
            else:
                if not close and name in _PUSHED and name != "hr" and not attrs.endswith("/"):
                    stack.append((name, *stack[-1][1:]))
                    open_[name] += 1
                    inner[name] += 1
                continue
        if name in _UNREAD:
            if not close and not attrs.endswith("/"):
                parts.append(" ")
                unread = len(stack)
                stack.append((name, *stack[-1][1:]))
                open_[name] += 1
                inner[name] += 1
            continue
        if name == "a":
            in_link = 0 if close else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
            heading = 1 if name[0] == "h" and name[1:].isdigit() and not close else 0
            in_link = 0 if close else in_link
        if name in _HOLDERS:
            if close:
                if open_[name] > 0:
                    k = up_to(name)
                    if name not in _BLOCK and stack[k][1:] != stack[k - 1][1:]:
                        flush()
                    drop(k)
            elif not attrs.endswith("/"):
                _, chrome, article, names, mark = stack[-1]
                if attrs:
                    own, unseen = _names(attrs)
                    if own and not own <= names and name != "body":
                        if name not in _BLOCK:
                            flush()
                        names = names | own
                    if unseen and name != "body":
                        if name not in _BLOCK:
                            flush()
                        chrome = 1
                    mark = 1 if "data-keep" in attrs else 0 if "data-drop" in attrs else mark
                if name in _CHROME and not (name == "header" and article):
                    chrome = 1
                if name in ("article", "main"):
                    article = 1
                stack.append((name, chrome, article, names, mark))
                open_[name] += 1
    flush()
    return out


def features(found: list[_Block], rates: dict[str, float]) -> np.ndarray:
    """One row a block: words, link density, both of the block before and after, held by a section that is no text, by an
    article, heading, whether the page has an article, least and greatest rate of the holders' words."""
    n = len(found)
    x = np.zeros((n, _WIDTH))
    if n:
        x[:, 0] = [f.words for f in found]
        x[:, 1] = [f.linked / max(1, f.words) for f in found]
        x[1:, 2:4] = x[:-1, :2]
        x[:-1, 4:6] = x[1:, :2]
        x[:, 6] = [f.chrome for f in found]
        x[:, 7] = [f.article for f in found]
        x[:, 8] = [f.heading for f in found]
        x[:, 9] = x[:, 7].max()
        for k, pick in ((10, min), (11, max)):
            x[:, k] = [pick((rates[w] for w in f.names if w in rates), default=0.5) if f.names else 0.5 for f in found]
    return x


_FILL = "this that house river after night story water before never again under light people because early street window summer along".split()
_NO_TEXT = "ad ads advert advertisement adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead topbar header footer bottom comments comment replies reply respond disqus discussion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations widget toolbar pagination pager tags copyright disclaimer skip search complementary contentinfo form".split()
_MAIN_TEXT = "article post entry story content body main text".split()


def _words(k: int, start: int) -> str:
    return " ".join(islice(cycle(_FILL), start % len(_FILL), start % len(_FILL) + k)).capitalize()


def _links(k: int, size: int, tag: str = "li") -> str:
    rows = "".join(f"<{tag}><a href='/{i}'>{_words(size + i % 2, i)}</a></{tag}>" for i in range(k))
    return f"<ul>{rows}</ul>" if tag == "li" else rows


def _labelled_pages() -> list[str]:
    """The labelled table: data-keep marks main text, data-drop all else."""
    sizes = cycle((40, 3, 18, 55, 1, 9, 30, 2, 70, 14, 5, 25))
    plain = [lambda: f"<p>{_words(next(sizes), 1)}.</p>", lambda: f"<p>{_words(next(sizes), 4)}.</p>", lambda: f"<p>{_words(next(sizes), 7)}.", lambda: f"<h2>{_words(3, 2)}</h2><p>{_words(next(sizes), 3)}.</p>", lambda: f"<p>{_words(22, 5)} <a href='/x'>{_words(4, 6)}</a> {_words(6, 1)}.</p>", lambda: f"<p><a href='/y'>{_words(8, 2)}</a> {_words(9, 3)}</p>", lambda: f"<ul><li>{_words(3, 9)}</li><li>{_words(7, 1)}</li></ul>", lambda: f"<blockquote>{_words(next(sizes), 8)}</blockquote>", lambda: f"<p>{_words(35, 3)}.</p><p><a href='/z'>{_words(6, 5)}</a></p><p>{_words(28, 6)}.</p>"]
    lists = [lambda: _links(4, 2), lambda: _links(3, 5, "p"), lambda: _links(6, 1), lambda: f"<div><a href='/'>{_words(1, 0)}</a> / <a href='/n'>{_words(1, 3)}</a> / {_words(2, 5)}</div>", lambda: _links(5, 8)]
    inside = [lambda: f"<h3>{_words(3, 4)}</h3>{_links(3, 3)}", lambda: f"<header><a href='/'>{_words(1, 1)}</a><a href='/n'>{_words(2, 2)}</a></header>", lambda: f"<aside><p>{_words(30, 2)}</p></aside>", lambda: f"<footer>{_words(9, 2)}</footer>", lambda: f"<form><label>{_words(2, 1)}</label><button>{_words(1, 4)}</button></form>", lambda: f"<nav>{_links(3, 1)}</nav>", lambda: _links(4, 4, "p")]
    texts = [lambda: f"<p>{_words(40, 1)}.</p>", lambda: _words(6, 2) + ".", lambda: f"<h3>{_words(2, 3)}</h3><p>{_words(16, 4)}.</p>", lambda: f"<p>{_words(3, 5)}.</p><p>{_words(60, 6)}.</p>"]
    sections = [lambda: f"<nav>{_links(4, 2)}</nav>", lambda: f"<header><a href='/'>{_words(2, 1)}</a> <p>{_words(5, 4)}</p></header>", lambda: f"<aside><p>{_words(30, 2)}</p></aside>", lambda: f"<footer><p>{_words(12, 3)}</p></footer>", lambda: f"<footer><p>{_words(50, 3)}</p></footer>", lambda: f"<form><label>{_words(3, 1)}</label></form>"]
    p, ls, ins, tx, sec, bad, good = (cycle(x) for x in (plain, lists, inside, texts, sections, _NO_TEXT, _MAIN_TEXT))

    def junk(k):
        rows = [next(sec)(), f"<div class='{next(bad)}'>{next(tx)()}</div>", f"<section id='{next(bad)}'>{next(tx)()}</section>", next(ls)(), f"<div class='{next(bad)} box'>{next(ls)()}</div>"]
        return "".join(f"<div data-drop>{rows[(k + j) % 5]}</div>" for j in range(1 + k % 4))

    pages = []
    for k in range(160):
        head = f"<h1>{_words(5, k)}</h1>" if k % 5 else ""
        half = "".join(next(p)() for _ in range(1 + k % 3)), "".join(next(p)() for _ in range(1 + k % 4))
        if k % 4 == 0:  # an article; whatever stands beside it is none of it
            beside = f"<div data-drop>{next(tx)() if k % 8 else next(p)()}</div>"
            within = f"<div data-drop>{next(ins)() if k % 3 else f'<div class={next(bad)}>{next(tx)()}</div>'}</div>"
            name = ("article", "main")[k % 8 // 4]
            main = f"{beside}<{name} data-keep>{head}{half[0]}{within}{half[1]}</{name}>{beside}"
        elif k % 4 == 1:
            within = f"<div data-drop>{next(ls)() if k % 3 else f'<div class={next(bad)}>{next(tx)()}</div>'}</div>"
            main = f"<div class='{next(good)}' data-keep>{head}{half[0]}{within}{half[1]}</div>"
        else:
            main = f"<div data-keep>{head}{half[0]}{half[1]}</div>"
        pages.append(f"<body>{junk(k)}{main}{junk(k + 1)}</body>")
    return pages


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree of least Gini impurity: (feature, threshold, left, right) or a class. Ties go to the first feature and threshold."""
    if depth == 0 or len(y) < 6 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        a, p = at + 1.0, ones[at]
        b, q = len(y) - a, ones[-1] - p
        cost = p * (1 - p / a) + q * (1 - q / b)
        k = int(np.argmin(cost))
        if best is None or cost[k] < best[0] - 1e-9:
            best = (float(cost[k]), f, (v[at[k]] + v[at[k] + 1]) / 2)
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-9:
        return int(y.mean() >= 0.5)
    _, f, t = best
    left = x[:, f] <= t
    return (f, float(t), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


@lru_cache(maxsize=1)
def trained() -> tuple[object, dict[str, float]]:
    """(the tree, how often blocks held by an element of that class or id word are main text)."""
    pages = [blocks(page) for page in _labelled_pages()]
    seen, kept = Counter(), Counter()
    for b in (b for page in pages for b in page):
        seen.update(b.names)
        kept.update(b.names if b.mark else ())
    rates = {w: (kept[w] + 1) / (k + 2) for w, k in seen.items() if k > 1}
    x = np.concatenate([features(page, rates) for page in pages])
    return grow(x, np.array([b.mark for page in pages for b in page], float)), rates


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, t, left, right = tree
    go = x[:, f] <= t
    out = np.empty(len(x), bool)
    out[go], out[~go] = classify(left, x[go]), classify(right, x[~go])
    return out


def main_text(html: str | None) -> str:
    found, (tree, rates) = blocks(html or ""), trained()
    return "\n".join(f.text for f, k in zip(found, classify(tree, features(found, rates))) if k)


def _run(batches):
    tree, rates = trained()
    for b in batches:
        found = [blocks(h or "") for h in b.column(b.num_columns - 1).to_pylist()]
        keep = classify(tree, np.concatenate([np.zeros((0, _WIDTH)), *(features(f, rates) for f in found)]))
        at, texts = 0, []
        for page in found:
            texts.append("\n".join(f.text for f, k in zip(page, keep[at : at + len(page)]) if k))
            at += len(page)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default: all but the html), then text and n_chars (code points); one row per row, no shuffle.

    Columns of pages called text or n_chars are left out.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, "text", "n_chars")]
    src = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html_col}`").cast("string").alias("__html"))
    return src.mapInArrow(_run, extend(src.drop("__html").schema, "text string, n_chars bigint"))
