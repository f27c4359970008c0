"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between the boundaries of block elements, in page order. A block's
features are the tags, class and id words and roles of its ancestors, and figures of its text (length, share of links,
punctuation, place in the page). The field has a weight per feature and one per pair of neighbouring labels; it is
trained by gradient ascent on the likelihood of labelled pages and decoded by Viterbi, where menus, sidebars, footers
and forms, if elements name them, and what stands beside a named article are held to the label 0. Elements that say they are not shown have no text.

Labelled pages are made from a bounded sample of those that say by their elements what their article is. That article's blocks are set into layouts drawn at random, in semantic elements or in boxes with the class names
that sites use, among menus, notices, adverts, forms, sidebars, footers and reader comments; the labels are known
then. So the field learns from markup that the sample itself may not have.

Null and empty pages, and pages without article blocks, have an empty text. Nothing of a page is cut off. Repeated
rows give repeated results.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table

# Fixed values of HTML: elements without content, elements whose content is no text of the page, block elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style noscript template svg math iframe object canvas audio video textarea select".split())
BLOCK = set(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead "
    "tbody tfoot tr td th blockquote pre figure figcaption form fieldset legend address details summary hr button center".split()
)
#: A start tag closes an open element of these, if no element of the second set lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPES = {"article", "section", "div", "td", "th", "li", "body", "main", "aside", "nav", "form", "blockquote", "table"}
#: What may stand in an open head; anything else ends it.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements of HTML in these end an open svg or math.
FOREIGN_TEXT = set("foreignobject desc title annotation-xml template".split())
PART_TAGS = set("main article section nav aside header footer form fieldset".split())
#: Elements whose blocks are no article, wherever they stand: menus, sidebars, footers, forms.
APART = frozenset(f"in:{t}" for t in "nav aside footer form button".split())
SAMPLE_PAGES, VARIANTS = 240, 4


@dataclass
class Block:
    text: str
    features: list[str]
    label: int | None = None


class Page(HTMLParser):
    """Leaf blocks of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple, int | None]] = []  # tag, features that it gives, label
        self.hidden = 0
        self.blocks: list[tuple] = []  # text, linked characters, tag, what ancestors tell, the nearest of them, label
        self.text: list[str] = []
        self.linked = self.links = 0
        self.last_heading = 0

    def handle_starttag(self, tag, attrs):
        if self.hidden and self._ends_hidden(tag):
            self._show()
        if self.hidden:
            if tag not in VOID:
                self.open.append((tag, (), None))
                self.hidden += 1
            return
        if tag == "body" and any(t == "body" for t, *_ in self.open):
            return
        if tag in BLOCK:
            self._end_block()
            self._close_until({"p"}, SCOPES)  # a paragraph ends where a block starts
        if tag in CLOSES:
            self._close_until(*CLOSES[tag])
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        self.open.append((tag, _told(tag, attrs), next((int(v) for k, v in attrs if k == "data-y" and v), None)))
        if tag in HIDDEN or _unseen(attrs):
            self.hidden = 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in HIDDEN | {"a", "span", "i"}:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.hidden:
            for i in range(1, self.hidden + 1):
                if self.open[-i][0] == tag:
                    del self.open[-i:]
                    self.hidden -= i
                    return
            above = [t for t, *_ in self.open[: -self.hidden]]
            if tag not in BLOCK:
                above = above[1 + max((i for i, t in enumerate(above) if t in BLOCK), default=-1) :]
            if tag not in above:
                return
            self._show()  # an element around the hidden one ends
        if tag in BLOCK:
            self._end_block()
        self._close_until({tag}, set() if tag in BLOCK else BLOCK)

    def _ends_hidden(self, tag):
        """Whether a start tag ends what hides: an open head, svg or math that its end tag was left out of."""
        root, *inside = (t for t, *_ in self.open[-self.hidden :])
        if root == "head":
            return tag == "body" and "template" not in inside or not inside and tag not in IN_HEAD
        if tag in CLOSES and root in CLOSES[tag][0]:
            return not CLOSES[tag][1] & set(inside)
        if root == "p":
            return tag in BLOCK and not SCOPES & set(inside)
        return root in ("svg", "math") and tag in BLOCK and not FOREIGN_TEXT & set(inside)

    def _show(self):
        del self.open[-self.hidden :]
        self.hidden = 0

    def handle_data(self, data):
        if self.hidden == 1 and self.open[-1][0] == "head" and data.strip():
            self._show()
        if not self.hidden:
            self.text.append(data)
            if any(t == "a" for t, *_ in self.open):
                self.linked += len(data.strip())

    def _close_until(self, tags, stop):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def _end_block(self):
        text = " ".join("".join(self.text).split())
        if text:
            told = tuple(f for _, fs, _ in self.open for f in fs)
            tag = next((t for t, *_ in reversed(self.open) if t in BLOCK), "none")
            label = next((y for *_, y in reversed(self.open) if y is not None), None)
            near = next((fs for t, fs, _ in reversed(self.open) if len(fs) > 1 or t in PART_TAGS), ())
            self.blocks.append((text, self.linked, tag, told, near, label))
        self.text, self.linked, self.links = [], 0, 0


def _told(tag: str, attrs) -> tuple:
    """What an element says about the blocks in it."""
    out = [f"in:{tag}"] if tag in BLOCK else []
    for key, value in attrs:
        if value and key in ("class", "id", "role", "itemprop"):
            spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            out.extend(f"name:{w}" for w in re.findall(r"[a-z]+", spaced))
    return tuple(out)


def _unseen(attrs) -> bool:
    """Whether an element says that it is not shown."""
    for key, value in attrs:
        if key == "hidden" and (value or "").lower() != "until-found":
            return True
        if key == "style" and value and re.search(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", value.lower()):
            return True
    return False


def leaf_blocks(source: str | None) -> list[Block]:
    """The blocks of a page with their features."""
    page = Page()
    page.feed(source or "")
    page.close()
    if page.hidden:  # what hides was never closed: its end is the page's end
        page.hidden = 0
    page._end_block()
    out, n = [], len(page.blocks)
    for i, (text, linked, tag, told, near, label) in enumerate(page.blocks):
        words = text.split()
        features = list(dict.fromkeys((*told, *(f"near:{f}" for f in near))))
        features += [
            f"tag:{tag}",
            f"words:{min(len(words).bit_length(), 9)}",
            f"links:{round(4 * min(1.0, linked / max(1, len(text))))}",
            f"ends:{text[-1] in '.!?…。'}",
            f"commas:{min(3, text.count(','))}",
            f"place:{min(4, 5 * i // n)}",
        ]
        if "©" in text or "copyright" in text.lower():
            features.append("sign")
        if len(words) <= 6:
            features += [f"says:{w}" for w in re.findall(r"[a-z]{3,}", text.lower())]
        out.append(Block(text, features, label))
    return out


@dataclass
class Field:
    """Weight of each feature for the label 1 (0 is the reference), of each pair of labels, and of a first 1."""

    weights: dict[str, float]
    pairs: list[list[float]]
    first: float = 0.0
    bias: float = 0.0

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi, under two constraints: menus, sidebars, footers and forms are 0; and where
        half of the text found lies in an element that names the article, so is what stands beside it."""
        barred = [not APART.isdisjoint(b.features) for b in blocks]
        labels = self._best(blocks, barred)
        named = [_in_article(b) for b in blocks]
        found = [len(b.text) * y for b, y in zip(blocks, labels)]
        within = sum(n for n, own in zip(found, named) if own)
        if 0 < within < sum(found) <= 2 * within:
            labels = self._best(blocks, [x or not own for x, own in zip(barred, named)])
        return labels

    def _best(self, blocks: list[Block], barred: list[bool]) -> list[int]:
        get, pairs, back = self.weights.get, self.pairs, []
        zero, one = 0.0, self.first
        for i, b in enumerate(blocks):
            score = -1e9 if barred[i] else self.bias + sum(get(f, 0.0) for f in b.features)
            if i:
                to_zero = (zero + pairs[0][0], one + pairs[1][0])
                to_one = (zero + pairs[0][1], one + pairs[1][1])
                back.append((int(to_zero[1] > to_zero[0]), int(to_one[1] > to_one[0])))
                zero, one = max(to_zero), max(to_one)
            one += score
        labels = [int(one > zero)] if blocks else []
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def train(pages: list[list[Block]], rounds: int = 200, rate: float = 0.1, decay: float = 5e-4) -> Field:
    """Maximum likelihood by Adam, forward and backward over all pages side by side."""
    import collections

    import numpy as np

    pages = [p for p in pages if p]
    if not pages:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]])
    seen = collections.Counter(f for p in pages for b in p for f in b.features)
    names = [f for f, n in seen.items() if n >= (40 if f.startswith("says:") else 3)]
    number, k = {f: i for i, f in enumerate(names)}, len(names)
    pages = sorted(pages, key=len)
    size = max(1, len(pages) // 8)
    groups = [_Group(pages[i : i + size], number) for i in range(0, len(pages), size)]
    values = np.zeros(k + 6)  # weights, pairs, first, bias
    m, v = np.zeros_like(values), np.zeros_like(values)
    told = sum(g.told for g in groups)
    for step in range(1, rounds + 1):
        slope = (told - sum(g.expected(values) for g in groups)) / len(pages) - decay * values
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        values += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    pair = values[k : k + 4].reshape(2, 2).tolist()
    return Field(dict(zip(names, values[:k].tolist())), pair, float(values[k + 4]), float(values[k + 5]))


class _Group:
    """Pages of like length as arrays; ``told``: what their labels say of each value."""

    def __init__(self, pages: list[list[Block]], number: dict[str, int]):
        import numpy as np

        k, n, width = len(number), len(pages), max(map(len, pages))
        places = [(i * width + j, b) for i, p in enumerate(pages) for j, b in enumerate(p)]
        self.owner = np.array([at for at, b in places for f in b.features if f in number], dtype=np.int64)
        self.index = np.array([number[f] for _, b in places for f in b.features if f in number], dtype=np.int64)
        self.there, label = np.zeros((n, width), bool), np.zeros((n, width), np.int64)
        for i, p in enumerate(pages):
            self.there[i, : len(p)], label[i, : len(p)] = True, [b.label or 0 for b in p]
        self.both = self.there[:, 1:] & self.there[:, :-1]
        self.told = np.zeros(k + 6)
        self.told[:k] = np.bincount(self.index, label.ravel()[self.owner], k)
        self.told[k : k + 4] = np.bincount((2 * label[:, :-1] + label[:, 1:])[self.both], minlength=4)
        self.told[k + 4], self.told[k + 5] = label[:, 0].sum(), label[self.there].sum()

    def expected(self, values):
        """What ``values`` expect, by forward and backward sums over all pages side by side."""
        import numpy as np

        there, (n, width), k = self.there, self.there.shape, len(values) - 6
        pair, first, bias = values[k : k + 4].reshape(2, 2), values[k + 4], values[k + 5]
        score = np.zeros((n, width, 2))
        score[:, :, 1] = np.bincount(self.owner, values[self.index], n * width).reshape(n, width) + bias
        score[:, 0, 1] += first
        ahead, behind = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        ahead[:, 0] = score[:, 0]
        for j in range(1, width):
            on = np.logaddexp.reduce(ahead[:, j - 1, :, None] + pair, axis=1) + score[:, j]
            ahead[:, j] = np.where(there[:, j, None], on, ahead[:, j - 1])
        for j in range(width - 2, -1, -1):
            on = np.logaddexp.reduce(pair + (behind[:, j + 1] + score[:, j + 1])[:, None, :], axis=2)
            behind[:, j] = np.where(there[:, j + 1, None], on, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        one = np.where(there, np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]), 0.0)
        out = np.zeros_like(values)
        out[:k] = np.bincount(self.index, one.ravel()[self.owner], k)
        joint = ahead[:, :-1, :, None] + pair + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        out[k : k + 4] = np.exp(np.where(self.both[:, :, None, None], joint, -np.inf)).sum(axis=(0, 1)).ravel()
        out[k + 4], out[k + 5] = one[:, 0].sum(), one.sum()
        return out


# What layouts are made of. Boxes: elements or class names that sites use for a part; lines: what stands in it.
ARTICLE_BOXES = (
    "article main article main section.article div.content div#content div.post div.post-content div.entry-content "
    "div.article-body div#main div.story div.text div[role=main] div.page-content div.body-text"
).split()
OUTER_BOXES = "div.container div#page div.wrapper div.site body-less div.layout div.row div.inner main div.content-wrap".split()
PARTS = {
    "menu": "nav nav ul.menu div.nav div#navigation div.navbar div[role=navigation] div.breadcrumb div.topbar ul.tabs".split(),
    "header": "header header div.header div#header div.site-header div.masthead div.banner div[role=banner] div.logo".split(),
    "sidebar": "aside aside div.sidebar div#sidebar div.widget div.related div.related-posts div.recommended div.popular section.trending".split(),
    "notice": "div.cookie-notice div.cookie-banner div.notice div.consent div.gdpr div.alert div.paywall div.popup div.modal section.disclaimer p.notice".split(),
    "advert": "div.ad div.ads div.advert div.advertisement div.sponsored div.promo aside.ad div.ad-slot div#ad-top section.sponsor".split(),
    "form": "form form.newsletter form#search div.subscribe div.signup form.login div.newsletter form.contact fieldset".split(),
    "share": "div.share div.social ul.share-buttons div.tags div.meta div.byline div.pagination ul.pager".split(),
    "comments": "section.comments div.comments div#comments div.comment-list ol.commentlist div#disqus div.responses section.discussion div.replies ul.comments".split(),
    "footer": "footer footer div.footer div#footer div.site-footer div[role=contentinfo] div.copyright div.legal".split(),
}
STOCK = {
    "menu": "Home|About|Contact|News|Sports|Products|Blog|Archive|Login|Next|Previous",
    "header": "Daily Site|The Example Times|Welcome|Search|Sign in|Menu",
    "sidebar": "Related posts|Most read|You may also like|Recent entries|Categories|Popular today",
    "notice": "We use cookies to improve your visit. Accept|This site stores cookies.|Subscribe to read on|Your privacy matters to us",
    "advert": "Advertisement|Sponsored|Buy now and save|Special offer, today only!|Learn more",
    "form": "Subscribe to our newsletter|Your email|Name|Send|Search|Password|Log in",
    "share": "Share on social media|Tweet|By the editors|Tags|Page 1 of 3|Print|E-mail",
    "comments": "Comments|Leave a reply|3 comments|Reply|Report|Log in to comment|Posted by guest",
    "footer": "All rights reserved.|Terms of use|Privacy policy|Imprint|© 2024 Example|Contact us",
}


def _box(spec: str, inner: str, label: int) -> str:
    tag, mark, name = re.match(r"(\w+)(?:([.#]|\[role=)([\w-]+)\]?)?", spec).groups()
    attr = {".": f' class="{name}"', "#": f' id="{name}"', "[role=": f' role="{name}"', None: ""}[mark]
    return f'<{tag}{attr} data-y="{label}">{inner}</{tag}>'


def layout(content: list[tuple[str, str]], other: list[str], pick: random.Random) -> str:
    """A page around ``content`` (tag, text), with parts that hold stock lines and texts of ``other``."""
    lines = lambda part: STOCK[part].split("|")
    say = lambda text: entities.escape(text, quote=False)

    def part(name: str) -> str:
        spec, items = pick.choice(PARTS[name]), []
        for _ in range(pick.randint(1, 6)):
            text = say(pick.choice(lines(name)))
            if other and pick.random() < (0.7 if name in ("comments", "sidebar", "advert", "footer") else 0.25):
                text = say(pick.choice(other))
            linked = pick.random() < {"menu": 0.9, "sidebar": 0.6, "footer": 0.4, "share": 0.6}.get(name, 0.1)
            items.append(f'<a href="#">{text}</a>' if linked else text)
        if name == "form":
            return _box(spec, "".join(f"<label>{t}</label><input><button>{t}</button>" if pick.random() < 0.4 else f"<p>{t}</p>" for t in items), 0)
        if spec.startswith(("ul", "ol")) or (name in ("menu", "sidebar") and pick.random() < 0.6):
            inner = "".join(f"<li>{t}</li>" for t in items)
            return _box(spec, inner if spec.startswith(("ul", "ol")) else f"<ul>{inner}</ul>", 0)
        if spec.startswith("p."):
            return _box(spec, " ".join(items), 0)
        wrap = pick.choice(["p", "div", "span"])
        title = f"<h{pick.choice('234')}>{say(pick.choice(lines(name)))}</h{pick.choice('234')}>" if pick.random() < 0.4 else ""
        return _box(spec, title + "".join(f"<{wrap}>{t}</{wrap}>" for t in items), 0)

    some = lambda *names: "".join(part(n) for n in names if pick.random() < 0.5)
    body = []
    for i, (tag, text) in enumerate(content):
        shown = say(text)
        if pick.random() < 0.15:
            words = shown.split(" ")
            at = pick.randrange(len(words))
            words[at] = f"<a href='#'>{words[at]}</a>" if pick.random() < 0.5 else f"<b>{words[at]}</b>"
            shown = " ".join(words)
        tag = pick.choice(["p", "p", "div", "blockquote", "li", "h2", "h3", "td", "pre"]) if i and pick.random() < 0.12 else tag
        shown = f"<{tag}>{shown}</{tag}>"
        body.append({"li": f"<ul>{shown}</ul>", "td": f"<table><tr>{shown}</tr></table>"}.get(tag, shown))
        if pick.random() < 0.08:
            body.append(part(pick.choice(["advert", "share", "sidebar", "notice", "form"])))
    if pick.random() < 0.3:
        body.append(part("comments"))
    if body and pick.random() < 0.15:
        body[0] = f"<header>{body[0]}</header>"
    article = _box(pick.choice(ARTICLE_BOXES), "".join(body) + some("share"), 1)
    inner = some("advert", "share") + article + some("sidebar", "comments", "form", "advert")
    outer = pick.choice(OUTER_BOXES)
    inner = inner if outer == "body-less" else _box(outer, inner, 0)
    return f"<html><body>{some('notice', 'header', 'menu', 'menu')}{inner}{some('comments', 'sidebar', 'notice', 'form', 'footer', 'footer')}</body></html>"


def _in_article(block: Block) -> bool:
    return APART.isdisjoint(block.features) and bool({"in:article", "in:main"} & set(block.features))


def labelled_pages(sources: list[str], variants: int = VARIANTS, seed: int = 5) -> list[list[Block]]:
    """Blocks with labels: the pages that name their article by an element, as they are and in other layouts."""
    pick, out = random.Random(seed), []
    for source in sources:
        blocks = leaf_blocks(source)
        for b in blocks:
            b.label = int(_in_article(b))
        if not any(b.label for b in blocks):
            continue
        out.append(blocks)
        tag = lambda b: next(f for f in b.features if f.startswith("tag:"))[4:]
        content = [(tag(b) if tag(b) in BLOCK - {"article", "main", "div", "section", "body", "html"} else "p", b.text) for b in blocks if b.label]
        other = [b.text for b in blocks if not b.label] + [t for _, t in pick.sample(content, min(3, len(content)))]
        for _ in range(variants):
            out.append(leaf_blocks(layout(content[: 1 + pick.randrange(40)], other, pick)))
    return out


def fit(pages: DataFrame, rows: int = SAMPLE_PAGES) -> Field:
    """A field from at most ``rows`` of the labelled ``pages`` (page_id, html), those whose ids have the smallest hashes.

    Pages with text of which none is labelled are an error: there is nothing to learn from.
    """

    def having(labelled: bool):
        def run(batches: Iterator):
            import pyarrow as pa

            for batch in batches:
                blocks = map(leaf_blocks, batch.column(1).to_pylist())
                yield batch.filter(pa.array([any(map(_in_article, b)) if labelled else bool(b) for b in blocks], pa.bool_()))

        return run

    source = pages.select("page_id", "html").where("html is not null")
    few = lambda d: d.orderBy(F.xxhash64("page_id"), "page_id").limit(rows).select("html").collect()
    named = source.where(F.col("html").rlike(r"(?i)<(article|main)[\s/>]"))
    found = [r.html for r in few(named)]
    if len(found) == rows and not all(any(map(_in_article, leaf_blocks(h))) for h in found):
        found = [r.html for r in few(named.mapInArrow(having(True), named.schema))]
    labelled = labelled_pages(found)
    if not labelled and source.mapInArrow(having(False), source.schema).limit(1).count():
        raise ValueError("no page names its article by <article> or <main>, so there is nothing to learn from")
    return train(labelled)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            found = []
            for source in batch.column(2).to_pylist():
                blocks = leaf_blocks(source)
                found.append("\n\n".join(b.text for b, y in zip(blocks, shared.value.decode(blocks)) if y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return source.mapInArrow(run, "page_id bigint, url string, text string")


@query("op10_block_crf")
def op10(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
