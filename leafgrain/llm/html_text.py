"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from leafgrain.llm.common import small_batches, texts_of

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What follows a tag's name, to its end; a quote opens a value only after an equals sign.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Elements whose content is no text of the page; it ends at their own end tag.
RAW = frozenset("script style noscript template textarea title iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms mtext msub msup q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a piece of a text, never a whole article.
PIECES = HEADINGS | frozenset("p li ul ol dl dt dd pre xmp blockquote table thead tbody tfoot tr td th figure figcaption".split())
CONTENT = frozenset("article main".split())
#: Elements that do not hold the article, with the weight of their text.
APART = dict.fromkeys("nav footer aside button select dialog menu fieldset head".split(), 0.002) | {"form": 0.1}
#: Words in class, id or role of elements that surround an article, with the same weight; the first also tell inside one,
#: the first of all even on a single paragraph.
ADVERTS = "ads?|adverts?|advertisements?|adsense|sponsor(?:ed|s)?|comments?|commentlist|disqus"
EXTRAS = ("cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|login|social|share|sharing|related|recommend(?:ed|ations)?|sidebar|nav|navbar|"
          "navigation|breadcrumbs?|pagination|pager|promo(?:tion)?s?|respond|repl(?:y|ies)|popup|modal")
FRAME = "banner|notices?|alert|overlay|side|rail|widget|menu|footer|foot|copyright|search|toolbar|masthead|skip|legal|complementary|contentinfo"
WORDS = [re.compile(rf"(?:^|[-_\s])(?:{w})(?=$|[-_\s])") for w in (ADVERTS, f"{ADVERTS}|{EXTRAS}", f"{ADVERTS}|{EXTRAS}|{FRAME}")]
#: Class words that tell of the page's layout, not of the element.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|is)[-_]\S*")
BODY = re.compile(r"(?:^|[-_\s])(?:articlebody|article-body|entry-content|post-content|article-content|main-content)(?=$|[-_\s])")
NOISE = 0.002
#: An element of the left kind ends an open one of the right, unless the third stands between.
ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)),
        "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
#: A path is content from this share of the best path's score.
THRESHOLD = 0.3
#: The article's element holds at least this share of the text found.
HOLDS = 0.8
#: Weights of a node's neighbours in page order.
SMOOTH = [math.exp(-d * d / 2) for d in range(3)]


@dataclass(slots=True)
class Open:
    """An open element: ``path`` and ``element`` are those of the next one around that is not inline."""
    tag: str
    path: int
    element: int
    content: bool
    hidden: bool
    linked: bool


@dataclass(slots=True)
class Block:
    path: int
    element: int
    content: bool
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Page:
    """Blocks in order, the weight of each tag path, and parent and tag of each element (a parent has the smaller number)."""
    blocks: list[Block] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [1.0])
    parents: list[int] = field(default_factory=lambda: [0])
    tags: list[str] = field(default_factory=lambda: [""])


def attributes(source: str) -> tuple[str, bool]:
    """(words of class, id and role; whether the element is hidden)."""
    words, hidden = [], False
    for name, value in MARKS.findall(source):
        value, name = value.strip("\"'").lower(), name.lower()
        if name in ("class", "id", "role", "itemprop"):
            words.append(value)
        else:
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    return LAYOUT.sub("", " ".join(words)), hidden


def tags_of(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before it, end tag, name, attributes) of every tag, in one pass; the name of the last and of comments is "".

    A tag ends at the first `>` outside a quoted value. Where there is none, it ends at the next `>`, and so do all tags
    after it; with no `>` left, what follows is text. So each character is looked at a bounded number of times.
    """
    at, start, quoted = 0, 0, True
    last = page.rfind(">")
    while 0 <= (open_at := page.find("<", at)) <= last:
        if page.startswith("<!--", open_at):
            end = page.find("-->", open_at + 4)
            end, name, close, rest = len(page) if end < 0 else end + 3, "", False, ""
        elif page.startswith(("<!", "<?"), open_at):
            end, name, close, rest = page.find(">", open_at) + 1, "", False, ""
        elif m := NAME.match(page, open_at + 1):
            found = REST.match(page, m.end()) if quoted else None
            quoted = found is not None
            end = found.end() if found else page.find(">", m.end()) + 1
            name, close, rest = m[2].lower(), bool(m[1]), page[m.end():end - 1]
        else:
            at = open_at + 1
            continue
        text = page[start:open_at]
        if name in RAW and not close and not rest.endswith("/"):
            ended = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, end)
            end = page.find(">", ended.end()) + 1 or len(page) if ended else len(page)
            name = ""
        at = start = end
        yield text, close, name, rest
        if name == "xmp" and not close:
            ended = re.compile(r"</xmp(?=[\s/>])", re.I).search(page, end)
            at = start = ended.start() if ended else len(page)
            yield html.escape(page[end:at], quote=False), False, "", ""
    yield page[start:].partition("<!--")[0], False, "", ""


def read_page(page: str) -> Page:
    """The page's blocks, in order, with their tag paths."""
    out = Page()
    paths: dict[tuple[int, str, float], int] = {}
    stack = [Open("", 0, 0, False, False, False)]
    #: Positions in the stack of each tag.
    where: dict[str, list[int]] = defaultdict(list)
    block: Block | None = None

    def add(text: str) -> None:
        nonlocal block
        top = stack[-1]
        if not text or top.hidden:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(top.path, top.element, top.content, out.tags[top.element] in HEADINGS)
            out.blocks.append(block)
        text = html.unescape(text)
        block.parts.append(text)
        if top.linked:
            block.linked += len(text)

    def close(names: tuple[str, ...], barrier: tuple[str, ...] = ()) -> None:
        place = max([where[n][-1] for n in names if where[n]], default=0)
        if place and place > max([where[n][-1] for n in barrier if where[n]], default=0):
            while len(stack) > place:
                where[stack.pop().tag].pop()

    def weight_of(tag: str, words: str, inside: bool) -> float:
        if tag in APART or tag == "header" and not inside:
            return APART.get(tag, NOISE)
        if not words or tag in ("html", "body", "main") or tag == "article" and not inside and "comment" not in words:
            return 1
        return NOISE if WORDS[2 if not inside else 0 if tag in PIECES or tag in INLINE else 1].search(words) else 1

    for text, end, tag, rest in tags_of(page):
        add(text)
        if not tag:
            continue
        if tag not in INLINE:
            block = None
        elif tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if end:
            close((tag,))
            continue
        if rest.endswith("/"):
            continue
        if tag in ENDS:
            close(tuple(ENDS[tag][0].split()), ENDS[tag][1])
        elif where["p"] and tag not in INLINE:
            close(("p",), ("table", "td", "th", "button", "li", "article", "section", "div"))
        top = stack[-1]
        words, hidden = attributes(rest) if rest.strip() else ("", False)
        weight = weight_of(tag, words, top.content)
        content = weight == 1 and (top.content or tag in CONTENT or bool(BODY.search(words)) or "main" in words.split())
        path, element = top.path, top.element
        if tag not in INLINE or weight < 1:
            step = (path, tag, weight)
            if step not in paths:
                paths[step] = len(out.weights)
                out.weights.append(out.weights[path] * weight)
            out.parents.append(element)
            out.tags.append(tag)
            path, element = paths[step], len(out.tags) - 1
        if weight < 1:
            block = None
        where[tag].append(len(stack))
        stack.append(Open(tag, path, element, content, top.hidden or hidden, top.linked or tag == "a"))
    for b in out.blocks:
        b.text = " ".join("".join(b.parts).split())
    out.blocks = [b for b in out.blocks if b.text]
    return out


def path_scores(page: Page) -> tuple[dict[int, float], dict[int, int]]:
    """(smoothed and fused ratio, length of text) of every tag path.

    A path's ratio is the mean length of its blocks outside links, its second ratio their mean punctuation; fused, they
    are a geometric mean, less the share of link text, by the weight of the path's marks. Each block then takes part of
    its neighbours' scores, and a path the mean of its blocks, again less the share of link text and by the weight.
    """
    total: dict[int, list[int]] = {}
    for b in page.blocks:
        t = total.setdefault(b.path, [0, 0, 0, 0])
        t[0] += 1
        t[1] += len(b.text)
        t[2] += len(PUNCTUATION.findall(b.text))
        t[3] += min(b.linked, len(b.text))
    fused = {p: page.weights[p] * math.sqrt((chars - linked) / n * (1 + punctuation / n)) * (1 - linked / chars)
             for p, (n, chars, punctuation, linked) in total.items()}
    raw = [fused[b.path] for b in page.blocks]
    score: dict[int, float] = dict.fromkeys(total, 0.0)
    for i, b in enumerate(page.blocks):
        near = range(max(0, i - 2), min(len(raw), i + 3))
        score[b.path] += sum([SMOOTH[abs(j - i)] * raw[j] for j in near]) / sum([SMOOTH[abs(j - i)] for j in near]) / total[b.path][0]
    return ({p: page.weights[p] * s * (1 - total[p][3] / total[p][1]) for p, s in score.items()}, {p: t[1] for p, t in total.items()})


def article_element(page: Page, found: list[bool]) -> tuple[int, int]:
    """(first, last) element of the innermost one that holds most of the text found; (0, 0) if that is the whole body."""
    inside, last = [0] * len(page.tags), list(range(len(page.tags)))
    for b, f in zip(page.blocks, found):
        inside[b.element] += f * len(b.text)
    for e in range(len(page.tags) - 1, 0, -1):
        inside[page.parents[e]] += inside[e]
        last[page.parents[e]] = max(last[page.parents[e]], last[e])
    first = max(e for e, n in enumerate(inside) if n >= HOLDS * inside[0])
    while page.tags[first] in PIECES:
        first = page.parents[first]
    return (0, 0) if page.tags[first] in ("", "html", "body") else (first, last[first])


def main_text(html_text: str) -> str:
    """The article's blocks, one on a line.

    Found are the paths whose score reaches a share of that of the path with most score times text (by the weight of its
    marks, so that text marked as none of the article's never sets the bar beside other text); a block marked as the
    article needs half of that. The element that holds most of what is found is the article: its other blocks belong to
    it unless they are marked or mostly links, and what else was found belongs to it only if its path occurs in there,
    too. Where most of what is found stands in a marked article, so do all its blocks. Headings go with what they head.
    """
    page = read_page(html_text)
    blocks, weights = page.blocks, page.weights
    if not blocks:
        return ""
    score, chars = path_scores(page)
    best = max(score, key=lambda p: score[p] * chars[p] * weights[p])
    if weights[best] < 0.05:
        return ""
    found = [score[b.path] * (1 + b.content) >= THRESHOLD * score[best] for b in blocks]
    marked = sum(len(b.text) * (1 if b.content else -1) for b, f in zip(blocks, found) if f) > 0
    first, last = article_element(page, found)
    if first:
        inside = [first <= b.element <= last for b in blocks]
        own = {b.path for b, f, i in zip(blocks, found, inside) if f and i}
        least = weights[best]
        found = [f and (i or b.path in own) or i and weights[b.path] >= least and 2 * b.linked < len(b.text)
                 for b, f, i in zip(blocks, found, inside)]
    kept = [f or marked and b.content for b, f in zip(blocks, found)]
    for i in range(len(blocks) - 2, -1, -1):
        kept[i] |= blocks[i].heading and kept[i + 1] and weights[blocks[i].path] >= weights[blocks[i + 1].path] and 2 * blocks[i].linked < len(blocks[i].text)
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of whole pages, in one pass without a shuffle.

    Null or empty html gives an empty text. Broken markup is read as far as it goes; a page of any length is read
    whole. Repeated rows and null ids stay rows of their own; an empty table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(t) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    pages = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
