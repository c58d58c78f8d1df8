"""Operator 6: main text of HTML pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import fresh
from reelmill.llm.dom import INLINE, Block, Element, leaf_blocks

TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "li", "table", "p", "h1", "h2", "h3", "div", "button", "label", "blockquote", "pre", "figure")
#: Parts of class, id and role names, by what they tell.
NAMED = {
    "ad": r"\bads?\b|advert|sponsor|promo|banner",
    "menu": r"\bnav|menu|breadcrumb|pagination|\btabs?\b|toolbar",
    "side": r"side|related|recommend|widget|trending|popular|teaser|\bmore\b",
    "foot": r"foot|copyright|legal|imprint",
    "head": r"\bhead(er)?\b|masthead|topbar|logo|site-title",
    "talk": r"comment|reply|replies|discuss|disqus|respons|guestbook|talk|feedback|opinion|reader|forum|thread",
    "notice": r"cookie|consent|notice|alert|popup|modal|gdpr|overlay|toast|warning",
    "ask": r"newsletter|subscri|signup|login|search|contact|\bshare|social",
    "main": r"content|article|\bpost\b|post-|entry|story|\bbody\b|\btext\b|\bmain\b",
}
NAME_RULES = [re.compile(r) for r in NAMED.values()]
HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What blocks around main text tend to say.
SAYS = {
    "talk": r"^(\d+\s+)?(reader\s+)?(comments?|respons|repl(y|ies)|discussion|feedback|leave a (reply|comment)|join the (discussion|conversation))\b",
    "more": r"^(related|read (more|next|also)|you (may|might) also|more (from|on|stories)|see also|trending|popular|recommended|share (this|on)|tags?:|filed under)\b",
    "legal": r"©|\(c\)|copyright|all rights reserved|privacy policy|terms of (use|service)|we use cookies|accept (all )?cookies|subscribe|newsletter|sign (up|in)|log in|advertisement|sponsored",
}
SAY_RULES = [re.compile(r, re.I) for r in SAYS.values()]
#: Elements whose parts stand in the box around them; cells of a table only where it holds data.
THROUGH = ("ul", "ol", "dl", "blockquote", "figure", "pre")
CELLS = ("td", "th", "tr", "tbody", "thead", "tfoot", "table")
#: Elements whose own header and title belong to what they hold.
HOLDERS = ("article", "main")
AROUND = len(TAGS) + len(NAMED)
WIDTH = AROUND + len(SAYS) + 24


#: Places of the elements of ``HOLDERS`` among the marks.
HELD = [TAGS.index(t) for t in HOLDERS]


def marks(element: Element | None) -> np.ndarray:
    """Which elements and kinds of names stand around: those of the parent and one's own."""
    open_ = []
    while element is not None and element.marks is None:
        open_.append(element)
        element = element.parent
    above = element.marks if element is not None else np.zeros(AROUND, bool)
    for e in reversed(open_):
        own = [e.name == t for t in TAGS] + [bool(e.names and r.search(e.names)) for r in NAME_RULES]
        if e.name == "header" and above[HELD].any():  # the head of an article, not of the page
            own[TAGS.index("header")] = own[len(TAGS) + list(NAMED).index("head")] = False
        e.marks = above = above | np.array(own)
    return above


def up(element: Element | None, names: tuple[str, ...]) -> Element | None:
    """The nearest element of these names, from the element itself outwards."""
    while element is not None and element.name not in names:
        element = element.parent
    return element


def data_tables(blocks: list[Block]) -> set[int]:
    """The tables of data: two rows or more, in the mean two cells or more that say something, short ones."""
    rows: dict[int, set[int]] = {}
    cells: dict[int, list[int]] = {}
    for b in blocks:
        table = up(b.element, ("table",))
        if table is not None:
            rows.setdefault(id(table), set()).add(id(up(b.element, ("tr", "table"))))
            cells.setdefault(id(table), []).append(len(b.text) if b.linked <= 0.5 else 1000)
    return {t for t, n in rows.items() if len(n) > 1 and len(cells[t]) >= 2 * len(n) and sum(cells[t]) < 60 * len(cells[t])}


def box(element: Element | None, tables: set[int]) -> Element | None:
    """The element in which a block's element stands: siblings share it.

    Inline elements, rows of lists, cells of data tables, and the header of an article count with the box around them.
    """
    while element is not None and element.name in INLINE:
        element = element.parent
    at = element.parent if element is not None else None
    while at is not None:
        data = at.name in CELLS and (table := up(at, ("table",))) is not None and id(table) in tables
        head = at.name in ("header", "hgroup") and up(at.parent, HOLDERS) is not None
        if not (data or head or at.name in INLINE or at.name in THROUGH):
            break
        at = at.parent
    if element is not None and element.name in CELLS and (table := up(element, ("table",))) is not None and id(table) in tables:
        at = table.parent
    return at


def alike(boxes: list[Element | None]) -> dict[int, int]:
    """For each box how many boxes of its name and names stand beside it, itself included."""
    kinds: dict[tuple, set[int]] = {}
    for at in boxes:
        if at is not None:
            kinds.setdefault((id(at.parent), at.name, at.names), set()).add(id(at))
    return {i: len(found) for found in kinds.values() for i in found}


def features(blocks: list[Block]) -> np.ndarray:
    """One row a block: elements and names around it, what its text is like, how much its box holds; the constant last."""
    x = np.zeros((len(blocks), WIDTH))
    tables = data_tables(blocks)
    boxes = [box(b.element, tables) for b in blocks]
    beside = alike(boxes)
    held: dict[int, float] = {}  # characters outside links that each box holds
    for b, at in zip(blocks, boxes):
        held[id(at)] = held.get(id(at), 0.0) + len(b.text) * (1 - b.linked)
    whole, most = max(1.0, sum(held.values())), max(held.values(), default=0.0)
    since = 0.0  # characters since the last heading of reader talk, 0 before one
    talk = False
    for i, (b, at) in enumerate(zip(blocks, boxes)):
        n, share = len(b.text), held[id(at)]
        says = [n < 120 and bool(r.search(b.text)) for r in SAY_RULES[:2]] + [n < 400 and bool(SAY_RULES[2].search(b.text))]
        head = b.element is not None and b.element.name in HEADS
        if head or n < 40:
            talk = says[0] or (talk and not (head and b.element.name in ("h1", "h2") and not says[0] and since > 0 and n > 60))
        x[i, :AROUND] = marks(b.element)
        x[i, AROUND:] = (
            *says, n < 20, 20 <= n < 80, 80 <= n < 300, n >= 300, b.linked > 0.5, 0 < b.linked <= 0.5, b.text[-1] in ".!?…:;\"”»",
            b.text.count(".") + b.text.count(",") >= 3, head, talk, share >= most, share / whole, share / max(most, 1.0) < 0.2, share / whole > 0.6,
            talk and share < most, beside.get(id(at), 1) > 1 and share < most, beside.get(id(at), 1) > 2, says[2] and share < most, says[2] and share / whole < 0.2 and i == len(blocks) - 1,
            bool(tables) and up(b.element, ("table",)) is not None and id(up(b.element, ("table",))) in tables,
            len(blocks) == 1, len(blocks) <= 3, i == 0, 1,
        )
        since += talk
    return x


class Field:
    """A two-state chain: 1 is main text. ``w`` scores state 1 of a block, ``t[a, b]`` a step, ``s`` the first state."""

    def __init__(self, w: np.ndarray, t: np.ndarray, s: np.ndarray):
        self.w, self.t, self.s = w, t, s

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely states, by Viterbi."""
        emit = (x @ self.w).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = self.s[0], self.s[1] + (emit[0] if emit else 0)
        back = []
        for e in emit[1:]:
            back.append((b + t10 > a + t00, b + t11 > a + t01))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
        state = int(b > a)
        states = [state] * len(emit)
        for i in range(len(emit) - 2, -1, -1):
            state = int(back[i][state])
            states[i] = state
        return np.array(states, np.int64)


def fit(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 220, penalty: float = 1e-3) -> Field:
    """Maximise the conditional likelihood of labelled pages (features, states) by gradient with Adam steps."""
    n, longest = len(pages), max(len(y) for _, y in pages)
    x, y, on = np.zeros((n, longest, WIDTH)), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (px, py) in enumerate(pages):
        x[i, : len(py)], y[i, : len(py)], on[i, : len(py)] = px, py, True
    last = on.sum(axis=1) - 1
    theta = np.zeros(WIDTH + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pair = np.zeros((n, 2, 2))
    for r in range(1, rounds + 1):
        w, t, s = theta[:WIDTH], theta[WIDTH : WIDTH + 4].reshape(2, 2), theta[WIDTH + 4 :]
        emit = np.stack((np.zeros((n, longest)), x @ w), axis=2)
        fore, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = s + emit[:, 0]
        for i in range(1, longest):
            step = np.logaddexp.reduce(fore[:, i - 1, :, None] + t, axis=1) + emit[:, i]
            fore[:, i] = np.where(on[:, i, None], step, fore[:, i - 1])
        for i in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(t + (emit[:, i + 1] + back[:, i + 1])[:, None, :], axis=2)
            back[:, i] = np.where(on[:, i + 1, None], step, 0)
        z = np.logaddexp.reduce(fore[np.arange(n), last], axis=1)
        state = np.exp(fore + back - z[:, None, None]) * on[:, :, None]
        grad = np.zeros_like(theta)
        grad[:WIDTH] = np.einsum("nlw,nl->w", x, on * y - state[:, :, 1])
        pair[:] = 0
        for i in range(1, longest):
            both = fore[:, i - 1, :, None] + t + (emit[:, i] + back[:, i])[:, None, :] - z[:, None, None]
            pair += np.exp(both) * on[:, i, None, None]
            np.add.at(grad[WIDTH : WIDTH + 4].reshape(2, 2), (y[on[:, i], i - 1], y[on[:, i], i]), 1.0)
        grad[WIDTH : WIDTH + 4] -= pair.sum(axis=0).ravel()
        grad[WIDTH + 4 :] = np.bincount(y[:, 0], minlength=2) - state[:, 0].sum(axis=0)
        grad = grad / n - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(theta[:WIDTH], theta[WIDTH : WIDTH + 4].reshape(2, 2), theta[WIDTH + 4 :])


#: Openings of notices and footers in the made pages.
SAID = ("&copy; 2024 ", "Copyright ", "All rights reserved. ", "We use cookies. ", "Subscribe to our newsletter. ", "Sign up for ", "Log in ", "Advertisement ", "Privacy policy ", "Terms of use ", "Sponsored ")


def paragraphs(put, says, rng: random.Random, markup: str = "<p>$</p>") -> None:
    """Main text without a container of its own."""
    if rng.random() < 0.6:
        put(f"<{(h := rng.choice(('h1', 'h2')))}>$</{h}>", says(2, 10), 1)
    for _ in range(rng.choice((1, 1, 2, 3, 6, 9))):
        put(markup, says(12, 160), 1)


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page made by rule in one of many layouts, and for each leaf block whether it is main text."""
    word = lambda: "".join(rng.choice("aeinorstlud") for _ in range(rng.randint(1, 9)))
    says = lambda a, b: (" ".join(word() for _ in range(rng.randint(a, b))) + rng.choice("....!?  ,")).strip().capitalize()
    html: list[str] = []
    labels: list[int] = []

    def put(markup: str, text: str, label: int) -> None:
        html.append(markup.replace("$", text))
        labels.append(label)

    def around(tag: str, name: str, inner) -> None:
        html.append(f"<{tag}" + (f' {rng.choice(("class", "id"))}="{name}"' if name else "") + ">")
        inner()
        html.append(f"</{tag}>")

    def links(k: int) -> None:
        html.append("<ul>")
        for _ in range(k):
            put(f'<li><a href="/{word()}">$</a></li>', says(1, 3), 0)
        html.append("</ul>")

    def talk() -> None:
        heading = rng.choice(("Comments", f"{rng.randint(1, 90)} comments", "Responses", "Discussion", "Reader comments", "Leave a reply", "Replies", *(says(1, 4) for _ in range(6))))
        put(rng.choice(("<h3>$</h3>", "<h2>$</h2>", "<h4>$</h4>", "<p><b>$</b></p>")), heading, 0)
        name = rng.choice(("comment", "reply", "comment-body", "", word(), word()))
        for _ in range(rng.randint(1, 6)):
            around(rng.choice(("div", "li", "article", "section")), name, lambda: (some(0.4) and put(rng.choice(("<span>$</span><br>", "<b>$</b><hr>", "<div>$</div>")).replace("<br>", "<p></p>"), says(1, 2), 0), put(rng.choice(("<p>$</p>", "<div>$</div>")), says(3, 60), 0)))

    def ask() -> None:
        put("<label>$</label>", says(1, 4), 0)
        put("<button>$</button>", says(1, 2), 0)

    some = lambda p: rng.random() < p
    aside = [
        lambda: around("div", rng.choice(("ad", "ads", "advert", "sponsored", "promo-box", "ad-banner")), lambda: put(rng.choice(("$", "<p>$</p>")), says(2, 30), 0)),
        lambda: around(rng.choice(("aside", "div")), rng.choice(("sidebar", "related", "widget", "recommended")), lambda: (put("<p>$</p>", says(2, 40), 0), links(rng.randint(0, 4)))),
        lambda: around("aside", "", lambda: (put("<p>$</p>", says(2, 40), 0))),
        lambda: around("div", rng.choice(("", word())), lambda: put(rng.choice(("<p>$</p>", "$")), rng.choice(SAID) + says(0, 12), 0)),
        lambda: around("div", rng.choice(("", word())), lambda: (put(rng.choice(("<h3>$</h3>", "<h4>$</h4>", "<b>$</b><br>")).replace("<br>", "<hr>"), rng.choice(("Related", "More from us", "Read next", "Popular")), 0), links(rng.randint(1, 5)))),
        lambda: around("div", rng.choice(("cookie-notice", "notice", "consent", "alert", "popup")), lambda: put("<p>$</p>", says(3, 30), 0)),
        lambda: around("form", rng.choice(("", "search", "newsletter", "login")), ask),
        lambda: around(rng.choice(("section", "div", "ol")), rng.choice(("comments", "comment-list", "discussion", "responses", "reader-talk", "", word())), talk),
        lambda: around("div", rng.choice(("share", "social", "breadcrumbs", "pagination")), lambda: links(rng.randint(1, 4))),
    ]

    def cells(label: int) -> None:
        html.append("<table>")
        width = rng.randint(2, 4)
        for row in range(rng.randint(2, 5)):
            html.append("<tr>")
            for _ in range(width):
                put(rng.choice(("<th>$</th>", "<td>$</td>")) if not row else "<td>$</td>", rng.choice((says(1, 3), str(rng.randint(1, 9999)), says(2, 9))), label)
            html.append("</tr>")
        html.append("</table>")

    def terms() -> None:
        html.append("<dl>")
        for _ in range(rng.randint(1, 4)):
            put("<dt>$</dt>", says(1, 4), 1)
            put("<dd>$</dd>", says(3, 30), 1)
        html.append("</dl>")

    def story(tag: str = "") -> None:
        if some(0.8):
            title = lambda: put(f"<{(h := rng.choice(('h1', 'h1', 'h2')))}>$</{h}>", says(2, 12), 1)
            around("header", rng.choice(("", "", "entry-header", "head")), title) if tag in HOLDERS and some(0.4) else title()
        if some(0.12):  # parts of their own
            for _ in range(rng.randint(2, 4)):
                around("section", "", lambda: (put("<h2>$</h2>", says(1, 6), 1), [put("<p>$</p>", says(8, 120), 1) for _ in range(rng.randint(1, 4))]))
            return
        short = some(0.15)
        for _ in range(1 if short else rng.randint(1, 14)):
            kind = 0.0 if short else rng.random()
            if kind < 0.75:
                put(rng.choice(("<p>$</p>", "<p>$</p>", "<p><b>$<br>", "<p>$")), says(1, 4) if short or some(0.15) else says(5, 160), 1)
            elif kind < 0.82:
                put("<h2>$</h2>", says(1, 6), 1)
            elif kind < 0.88:
                for _ in range(rng.randint(1, 4)):
                    put("<ul><li>$</li></ul>", says(2, 30), 1)
            elif kind < 0.9:
                put("<blockquote>$</blockquote>", says(4, 50), 1)
            elif kind < 0.92:
                rng.choice((lambda: cells(1), lambda: cells(1), terms, lambda: put("<figure><img src=x><figcaption>$</figcaption></figure>", says(2, 14), 1)))()
            elif kind < 0.94:
                put("<p><a href='#'>$</a></p>", says(3, 12), 1)
            elif kind < 0.97:  # what an article says of itself stays
                put("<p>$</p>", rng.choice(SAID) + says(0, 8) if some(0.5) else "All rights reserved.", 1)
            else:
                rng.choice(aside)()
        if some(0.12):
            put("<p>$</p>", rng.choice(("All rights reserved.", "Sign up.", "Subscribe.", "Advertisement.")), 1)

    html.append("<html><body>")
    plain = rng.random()
    if plain < 0.06:  # nothing but text
        for _ in range(rng.choice((1, 1, 2, 5))):
            put(rng.choice(("<p>$</p>", "<div>$</div>", "$<hr>")), says(4, 160), 1)
        html.append("</body></html>")
        return "".join(html), labels
    if plain < 0.18:  # a table for the layout
        html.append("<table><tr>")
        cells = [lambda: links(rng.randint(2, 7)), lambda: paragraphs(put, says, rng), lambda: rng.choice(aside)()]
        for cell in rng.choice(((0, 1), (1, 0), (1, 2), (0, 1, 2), (1,))):
            html.append("<td>")
            cells[cell]()
            html.append("</td>")
        html.append("</tr></table>")
        if some(0.5):
            around("div", "", lambda: put("$", rng.choice(SAID) + says(0, 12), 0))
        html.append("</body></html>")
        return "".join(html), labels
    if plain < 0.3:  # boxes without names
        around("div", "", lambda: (put("<div>$</div>", says(1, 4), 0), links(rng.randint(2, 8))))
        around("div", rng.choice(("", word())), lambda: paragraphs(put, says, rng, rng.choice(("<p>$</p>", "<div>$</div>"))))
        for _ in range(rng.randint(0, 2)):
            rng.choice(aside)()
        around("div", "", lambda: put(rng.choice(("$", "<p>$</p>")), rng.choice(SAID) + says(0, 14), 0))
        html.append("</body></html>")
        return "".join(html), labels
    if some(0.3):
        html.append('<div id="wrapper">')
    if some(0.5):
        around("header", rng.choice(("", "site-header", "masthead")), lambda: (put("<h1>$</h1>" if some(0.3) else "<p>$</p>", says(1, 6), 0), links(rng.randint(0, 5))))
    if some(0.8):
        around("nav", rng.choice(("", "menu", "navbar")), lambda: links(rng.randint(2, 9)))
    for _ in range(rng.randint(0, 3)):
        rng.choice(aside)()
    tag, name = rng.choice((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("section", "story"), ("div", "article-text")))
    around(tag, name, lambda: story(tag))
    for _ in range(rng.randint(0, 3)):
        rng.choice(aside)()
    if some(0.85):
        around("footer", rng.choice(("", "site-footer")), lambda: (put(rng.choice(("$", "<p>$</p>")), rng.choice(("&copy; ", "")) + says(2, 40), 0), links(rng.randint(0, 3))))
    html.append("</body></html>")
    return "".join(html), labels


@cache
def trained(pages: int = 1000, seed: int = 11) -> Field:
    """A field fitted on labelled pages made by rule (``labelled_page``), once in a process; the same in every one."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < pages:
        html, labels = labelled_page(rng)
        blocks = leaf_blocks(html)
        if len(blocks) == len(labels) <= 60 and labels:
            rows.append((features(blocks), np.array(labels)))
    return fit(rows)


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page) if page else []
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, state in zip(blocks, field.decode(features(blocks)).tolist()) if state)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", field: Field | None = None) -> DataFrame:
    """``pages`` without its HTML, with ``out_col``: the main text, blocks joined by a blank line.

    The whole HTML of each row is cut into leaf blocks, the field labels them and the blocks of main text are
    joined; scripts, styles and markup are never blocks. Time and memory are linear in the page, however broken its
    markup; elements nested over 512 deep are read as if they stood there. Null or empty pages and pages without main text give
    the empty text; repeated rows give equal texts; an empty table gives none; an existing column of that name
    stays and the new one gets an underscore. A row is handled by itself, so skew and lost executors cost a
    task at most.
    """
    sent = pages.sparkSession.sparkContext.broadcast(field or trained())  # a few dozen weights
    keep = [c for c in pages.columns if c != html_col]
    out_col = fresh(pages.select(*keep), out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            texts = [main_text(p, own) for p in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, out_col])

    return pages.select(*keep, html_col).mapInArrow(run, pages.select(*keep).withColumn(out_col, F.lit("")).schema)


def op6_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page and its length in code points."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
