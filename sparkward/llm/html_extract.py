"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks: runs of text that no block-level tag interrupts, each with the
tags, classes and ids above it. A block's features come from those and from its text; the field has
weights for features with labels and for pairs of neighbouring labels, is trained by gradient steps
on labelled pages, and the best labelling of a page is found by Viterbi. The labelled pages are drawn
from layouts with the labels known by construction (LAYOUTS: TRAINING pages, seeded), so the model is
the same for any table and any page is judged alone.

Scripts, styles, comments of the markup, form controls and the head hold no blocks; a head without an
end tag ends where something begins that no head may hold. Formulas are text, annotations included. Character
references are decoded, white space in a block is one space, blocks are joined by a newline. Null and
empty pages give an empty text, and so do pages without main text. Every row gets a row, repeated ids
included; a line break tag is white space. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags that never close, tags whose content is no text, and tags that a following one closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template iframe object svg canvas head title textarea select button option".split())
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title head".split())
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
WORDS = re.compile(r"[a-z]+")


class Blocks(HTMLParser):
    """Leaf blocks of a page in order: (text, features of the tags above, characters inside links).

    Of the features above only those in `known` are kept, if it is given, so that a block costs no more the deeper it lies.
    """

    def __init__(self, known: dict[str, int] | None = None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter[str] = Counter()  # tags on the stack
        self.active: dict[str, int] = {}  # features on the stack: how often
        self.silent = 0
        self.out: list[tuple[str, tuple[str, ...], int]] = []
        self.text: list[str] = []
        self.linked, self.in_link = 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split(None))
        if text:
            self.out.append((text, tuple(self.active), self.linked))
        self.text, self.linked = [], 0

    def close_head(self, whole: bool = True) -> None:
        """Ends an open head; only if nothing is open in it, unless whole."""
        if self.open["head"] and (whole or self.stack[-1][0] == "head"):
            while self.open["head"]:
                self.pop()

    def handle_starttag(self, tag, attrs):
        if self.silent and tag not in IN_HEAD:
            self.close_head(whole=tag in ("body", "frameset"))
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            while self.stack and self.stack[-1][0] not in BLOCK and self.open["p"]:
                self.pop()  # an open paragraph takes its inline tags with it
            while self.stack and (tag in CLOSED_BY.get(self.stack[-1][0], ()) or self.stack[-1][0] in ("option", "button")):
                self.pop()
        own = ["tag=" + tag]
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                own += ["name=" + w for w in WORDS.findall(value.lower())]
            elif name in ("hidden", "aria-hidden"):
                own.append("name=hidden")
        own = tuple(f for f in dict.fromkeys(own) if self.known is None or f in self.known)
        self.stack.append((tag, own))
        self.open[tag] += 1
        for f in own:
            self.active[f] = self.active.get(f, 0) + 1
        self.silent += tag in SILENT
        self.in_link += tag == "a"

    def pop(self) -> None:
        tag, own = self.stack.pop()
        self.open[tag] -= 1
        for f in own:
            self.active[f] -= 1
            if not self.active[f]:
                del self.active[f]
        self.silent -= tag in SILENT
        self.in_link -= tag == "a"

    def handle_endtag(self, tag):
        if tag in VOID or not self.open[tag]:
            return
        if tag in BLOCK:
            self.flush()
        elif next(t for t, _ in reversed(self.stack) if t == tag or t in BLOCK) != tag:
            return  # an inline end tag closes no block
        while self.stack:
            own = self.stack[-1][0]
            self.pop()
            if own == tag:
                break

    def handle_data(self, data):
        if self.silent and data.strip():
            self.close_head(whole=False)
        if not self.silent:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def blocks(html: str | None, known: dict[str, int] | None = None) -> list[tuple[str, tuple[str, ...], int]]:
    parser = Blocks(known)
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


NOTICE = re.compile(r"(?i)cookie|subscribe|newsletter|sign (?:in|up)|log in|all rights reserved|copyright|©|advert|sponsored|privacy|terms of|share this|read more|related")


def features(text: str, above: tuple[str, ...], linked: int) -> tuple[str, ...]:
    n = len(text)
    words = text.count(" ") + 1
    out = [*above, f"words={min(words, 200).bit_length()}", "bias"]
    if linked * 2 > n:
        out.append("links=most")
    elif linked:
        out.append("links=some")
    if text[-1] in ".!?…\"'”»":
        out.append("end=sentence")
    if NOTICE.search(text):
        out.append("notice")
    return tuple(out)


class Field:
    """A chain over two labels, 1 for main text. Features that training hasn't seen weigh nothing."""

    def __init__(self, index: dict[str, int], state: np.ndarray, step: np.ndarray):
        self.index, self.state, self.step = index, state, step

    def scores(self, rows: list[tuple[str, ...]]) -> np.ndarray:
        out = np.zeros((len(rows), 2))
        for k, own in enumerate(rows):
            at = [self.index[f] for f in own if f in self.index]
            if at:
                out[k] = self.state[at].sum(0)
        return out

    def best(self, rows: list[tuple[str, ...]]) -> list[int]:
        """Viterbi."""
        if not rows:
            return []
        s, t = self.scores(rows).tolist(), self.step.tolist()
        a, b, back = s[0][0], s[0][1], []
        for x, y in s[1:]:
            stay0, stay1 = a + t[0][0] >= b + t[1][0], b + t[1][1] >= a + t[0][1]
            back.append((0 if stay0 else 1, 1 if stay1 else 0))
            a, b = x + (a + t[0][0] if stay0 else b + t[1][0]), y + (b + t[1][1] if stay1 else a + t[0][1])
        label = [0 if a >= b else 1]
        for p in reversed(back):
            label.append(p[label[-1]])
        return label[::-1]


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))


def train(pages: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Conditional likelihood by AdaGrad, a page a step, forward and backward in each."""
    index = {f: k for k, f in enumerate(dict.fromkeys(f for rows, _ in pages for own in rows for f in own))}
    state, step = np.zeros((len(index), 2)), np.zeros((2, 2))
    seen_state, seen_step = np.full_like(state, 1e-6), np.full_like(step, 1e-6)
    field = Field(index, state, step)
    coded = [([[index[f] for f in own] for own in rows], np.array(labels)) for rows, labels in pages if rows]
    for _ in range(rounds):
        for at, labels in coded:
            s = np.array([state[a].sum(0) for a in at])
            n = len(s)
            ahead, behind = np.empty_like(s), np.zeros_like(s)
            ahead[0] = s[0]
            for k in range(1, n):
                ahead[k] = s[k] + logsum(ahead[k - 1][:, None] + step, 0)
            for k in range(n - 2, -1, -1):
                behind[k] = logsum(step + (s[k + 1] + behind[k + 1])[None, :], 1)
            total = logsum(ahead[-1], 0)
            chance = np.exp(ahead + behind - total)
            wrong = -chance
            wrong[np.arange(n), labels] += 1
            grad_step = np.zeros((2, 2))
            for k in range(1, n):
                grad_step[labels[k - 1], labels[k]] += 1
                grad_step -= np.exp(ahead[k - 1][:, None] + step + (s[k] + behind[k])[None, :] - total)
            for own, g in zip(at, wrong):
                g = g - decay * state[own]
                seen_state[own] += g * g
                state[own] += rate * g / np.sqrt(seen_state[own])
            seen_step += grad_step * grad_step
            step += rate * grad_step / np.sqrt(seen_step)
    return field


#: Stands before the main text of a labelled page, so that its blocks are told from the rest.
MARK = "\ue000"
#: Labelled pages are drawn from these: what holds the article, and what stands around or inside it.
TRAINING = 240
HOLDERS = (
    "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', "<main><article>{}</article></main>",
    '<div class="article-body">{}</div>', '<section class="story">{}</section>', '<div class="entry-content">{}</div>', '<div role="main">{}</div>', "<div>{}</div>",
)
BEFORE = (
    "<nav><ul>{links}</ul></nav>", '<header><h1>{short}</h1><p>{short}</p></header>', '<div class="menu"><ul>{links}</ul></div>', '<div class="ad">{text}</div>',
    '<div class="cookie-notice"><p>We use cookies. {short}</p></div>', '<div class="banner">{text}</div>', '<div id="header"><a href="/">{short}</a></div>', '<ul class="breadcrumb">{links}</ul>',
)
AFTER = (
    "<footer>© {short} · {text}</footer>", "<footer><p>{text}</p><ul>{links}</ul></footer>", '<aside><h3>{short}</h3><p>{text}</p></aside>', '<div class="sidebar"><ul>{links}</ul><p>{text}</p></div>',
    '<section class="comments"><h3>Comments</h3><div class="comment"><p>{text}</p></div><div class="comment"><p>{text}</p></div></section>', '<div id="comments"><ol><li class="comment">{text}</li></ol></div>',
    '<form><label>{short}</label><p>Subscribe to our newsletter. {short}</p></form>', '<div class="related"><ul>{links}</ul></div>', '<div class="ad">{text}</div>', '<div class="ads sponsored"><p>{text}</p></div>',
    '<div class="footer">{text}</div>', '<div class="share"><ul>{links}</ul></div>', '<div class="notice"><p>{text}</p></div>', '<div id="footer"><p>Copyright {short}</p></div>',
)
INSIDE = ('<div class="ad">{text}</div>', '<aside><p>{text}</p></aside>', '<nav><ul>{links}</ul></nav>', '<div class="share"><ul>{links}</ul></div>', '<footer><p>{text}</p></footer>', '<header><h1>{keep}</h1></header>')
#: Words of notices that main text holds as well.
TALK = ("cookie", "subscribe", "newsletter", "sign in", "log in", "copyright", "adverts", "sponsored", "privacy", "terms of", "read more", "related")
OWN = ("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<p><b>{}<br>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", '<p>{} <a href="/x">{}</a>.</p>', "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>")


def labelled_pages(n: int = TRAINING, seed: int = 7) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """Feature rows and labels of pages made from the layouts; a mark in the text tells main text apart."""
    draw, talk, out = random.Random(seed), random.Random(f"talk {seed}"), []

    def prose(low, high, end=".", mark=""):
        words = ["".join(draw.choices("aeiourtnsldk", k=draw.randint(2, 8))) for _ in range(draw.randint(low, high))]
        if mark and talk.random() < 0.15:  # an article may speak of cookies, too
            words.insert(talk.randrange(len(words) + 1), talk.choice(TALK))
        return mark + " ".join(words).capitalize() + end

    def filled(part):
        links = "".join(f'<li><a href="/{k}">{prose(1, 3, "")}</a></li>' for k in range(draw.randint(2, 7)))
        return part.format(links=links, short=prose(1, 4, ""), text=prose(3, 30), keep=prose(2, 9, "", MARK))

    for _ in range(n):
        body = [f"<h1>{prose(2, 12, draw.choice(['', '.']), MARK)}</h1>"]
        for _ in range(draw.choice([1, 2, 4, 8, 20])):
            text = prose(*draw.choice([(1, 3), (4, 20), (20, 120)]), draw.choice([".", ".", ".", "", "!"]), MARK)
            body.append(draw.choice(OWN).format(text, prose(1, 2, "")))
            if draw.random() < 0.08:
                body.append(filled(draw.choice(INSIDE)))
        before = [filled(draw.choice(BEFORE)) for _ in range(draw.randint(0, 3))]
        after = [filled(draw.choice(AFTER)) for _ in range(draw.randint(0, 4))]
        page = f"<html><head><title>{escape(prose(2, 5))}</title></head><body>{''.join(before)}{draw.choice(HOLDERS).format(''.join(body))}{''.join(after)}</body></html>"
        found = blocks(page)
        labels = [int(MARK in text) for text, _, _ in found]
        out.append(([features(text.replace(MARK, "") or "x", above, linked) for text, above, linked in found], labels))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return train(labelled_pages())


def main_text(html: str | None, field: Field) -> str:
    found = blocks(html, field.index)
    labels = field.best([features(*b) for b in found])
    return "\n".join(b[0] for b, keep in zip(found, labels) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    field = trained()  # a few hundred weights, sent to every task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, field) for h in batch.column(2).to_pylist()]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
