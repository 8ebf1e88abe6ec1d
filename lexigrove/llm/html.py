"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks in page order. A logistic classifier, fitted on labelled pages of many shapes, gives each
block a probability of being content; its costs, -log(1 - p) and -log(p), are the capacities from the source and to the
sink. Neighbouring blocks are joined by smoothness edges that weaken with their distance in the DOM, blocks of one parent
by edges that weaken with their distance on the page. The minimum cut, found by max-flow, is the labelling of least total
cost. Blocks inside scripts, styles, forms, navigation, footers and the like are boilerplate by construction of HTML:
their capacity to the sink is unbounded. A form that holds most of a page's sentences and few controls is a frame around
the page, no form to fill in.

Parts of class names count by their head, the last part: a `post-sidebar` is a sidebar, a `notice-board` a board. Parts
for navigation speak against links and short texts alone. Where all sentences of a page stand below such parts, they tell
nothing apart and are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag; its parts are possessive, so that a match takes one pass. A quote counts after an equals sign alone.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)", re.I)

# Element names by their role in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noframes"}
SKIPPED = {"template", "noscript", "svg", "canvas", "audio", "video", "select", "annotation", "annotation-xml"}
INLINE = {"a", "abbr", "acronym", "annotation", "annotation-xml", "audio", "b", "bdi", "bdo", "big", "br", "canvas", "cite", "code", "data", "del", "dfn", "em", "font", "i", "iframe", "img", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "mstyle", "msub", "msup", "mtext", "noscript", "object", "q", "rp", "rt", "ruby", "s", "samp", "script", "semantics", "small", "span", "strike", "strong", "style", "sub", "sup", "svg", "time", "tt", "u", "var", "video", "wbr"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "header"}
CONTENT = {"article", "main"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words in class, id and role that speak against content (the first strongly), and for it.
STRONG = r"ads?|adverts?|advertisements?|adsense|banners?|sponsor(?:ed)?|promo(?:tion)?s?|comments?|commentlist|replies|reply|disqus|sidebars?|navs?|navbar|navigation|menus?|breadcrumbs?|footers?|masthead|cookies?|consent|gdpr|notices?|popups?|modal|overlay|newsletter|subscribe|signup|login|toolbar|pagination|pager|copyright|contentinfo|complementary|related|recommend(?:ed|ations)?|share|sharing"
WEAK = r"side|headers?|alerts?|social|widgets?|tags?|meta|byline|legal|disclaimer|skip|search|dialog|form"
WEAKLY = re.compile(rf"(?:^|[\s_-])(?:{WEAK})(?=$|[\s_-])", re.I)
FIRMLY = re.compile(rf"(?:^|[\s_-])(?:{STRONG})(?=$|[\s_-])", re.I)
FOR = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|content|main|story|body|text)(?=$|[\s_-])", re.I)
#: Classes that tell what an element is about, or what is beside it: no hint against it.
QUALIFIED = re.compile(r"^(?:tags?|category|cat|topic)[_-]|(?:^|[_-])(?:with|without|has|have|no|not|non|hide|above|below)[_-]|[_-](?:open|closed|on|off|enabled|disabled|allowed)$", re.I)
#: Last parts of a class that only say where or what kind of box it is: the part before them is the head.
BOX = re.compile(r"\d+|left|right|top|bottom|inner|outer|first|last|main|primary|secondary|mobile|desktop|box(?:es)?|lists?|items?|wrap(?:per)?|containers?|areas?|sections?|blocks?|bars?|rows?|cols?|columns?|cells?|panels?|groups?|holder|slots?|units?|body|content|inner|text|title|heading|header|links?|posts?|articles?|stories|news|form|buttons?|icons?|author|meta|message|thread|count", re.I)
#: Parts for lists of links, and for remarks and adverts, which stay against whatever the page is like.
LINKING = re.compile(r"navs?|navbar|navigation|menus?|breadcrumbs?|pagination|pager|toolbar", re.I)
FOREIGN = re.compile(r"ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|comments?|commentlist|replies|reply|disqus|cookies?|consent|gdpr", re.I)
#: Classes made up of words for content, which overrule a part of a class further out and weak words beside them.
NEARER = re.compile(r"(?:article|articlebody|post|entry|content|main|story)(?:[_-](?:article|post|entry|content|main|story|body|text))*", re.I)
# What notices and the lines around reader comments say, and headings of what is no content.
NOTICE = re.compile(r"\b(?:(?:uses?|using|accept|our|these|all) cookies|cookie policy|privacy (?:policy|settings)|terms of (?:use|service)|your consent|subscribe|newsletter|sign (?:up|in)|log in|advertisement|sponsored|share (?:this|on)|follow us|your e-?mail|all rights reserved)\b", re.I)
REMARK = re.compile(r"^.{1,40}\s(?:says|said|wrote|commented|replied)(?:\s(?:on|at)\s.{4,40})?:?$|\b\d+ (?:second|minute|hour|day|week|month|year)s? ago\b|^(?:reply|like|report|permalink|flag)(?:\W+(?:reply|like|report|permalink|flag))*$|^(?:posted )?by .{1,40} (?:on|at) .{4,40}$|^[^.!?]{1,40}[,|\u00b7(\u2013-]\s*(?:on )?(?:\d{1,2}\.? [a-z]{3,9}\.?,? \d{4}|[a-z]{3,9}\.? \d{1,2},? \d{4}|\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4})(?:,? (?:at )?\d{1,2}[:.]\d\d(?: ?[ap]m)?)?\)?:?$", re.I)
TITLE = re.compile(r"^\W*(?:\d+\s+|reader |user |recent |latest |top |leave a |post a |add a |you (?:may|might) also |more |from )*(?:comments?|repl(?:y|ies)|responses?|related(?: links| content| news)?|recommended(?: for you)?|read next|trending|most (?:read|popular)|popular|newsletter|share this|follow us|blogroll|sponsors?|advertisement|our partners|the web)(?:\s+(?:\(?\d+\)?|on .*|articles?|posts?|stories|comments?|pages?))?\W*$", re.I)

#: Titles that are also topics: what follows must look like links or remarks.
TOPIC = re.compile(r"\W*(?:comment|repl(?:y|ies)|responses?|related|popular|trending|sponsors?|the web|blogroll)\W*", re.I)
#: Words from which on a block counts as sentences; characters of text that a form around a page has for each control.
SENTENCES, BY_CONTROL = 10, 100

# The classifier: a logistic regression, fitted by html_fit.fitted() on the labelled pages of html_fit.sample().
FEATURES = ("bias", "in_content", "outside", "for", "firm", "soft", "weak", "links", "links_in_content", "length", "sentence", "heading", "item", "notice", "remark", "said", "after_title", "copyright")
WEIGHTS = dict(zip(FEATURES, (-0.8, 5.0, -1.1, 4.0, -7.4, -5.7, -4.5, -4.8, 0.9, 5.5, -0.2, 3.6, -1.6, -6.0, -1.0, -5.0, -11.7, -5.0)))
#: Capacity between neighbours, divided by their distance in the DOM; and between blocks of one parent, by theirs on the page.
ADJACENT, SIBLING = 0.5, 0.35
UNBOUNDED = 1e6


class Block:
    __slots__ = ("text", "linked", "element", "under", "said", "n_words", "remark")

    def __init__(self, text, linked, element, under):
        self.text, self.linked, self.element, self.under, self.said = text, linked, element, under, False
        self.n_words = text.count(" ") + 1
        self.remark = self.n_words < 30 and bool(REMARK.search(text))

    @property
    def sentences(self) -> bool:
        """Whether the block is running text rather than links or a label."""
        return self.n_words >= SENTENCES and 2 * self.linked <= len(self.text)

    @property
    def ruled_out(self) -> bool:
        """Whether HTML itself says that the block is no content."""
        return self.element.hard or bool(self.element.form and not self.element.form.frame)


class Element:
    """An open element: what it inherits, and what its own name and attributes say."""

    __slots__ = ("tag", "parent", "depth", "content", "hard", "form", "frame", "controls", "hint_for", "firm", "soft", "linking", "foreign", "weak")

    def __init__(self, tag, parent, attributes=""):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.content = bool(parent and parent.content) or tag in CONTENT
        self.form = self if tag == "form" else parent.form if parent and tag not in CONTENT else None  # the form around it
        self.frame, self.controls = False, 0  # of a form: whether it is one around the page, and its controls
        self.hard = bool(parent and parent.hard) or tag in BOILERPLATE and tag != "form" and not (tag == "header" and self.content)
        self.hint_for = bool(parent and parent.hint_for)
        # against: a whole class, or a part of one, which ends at a main text further in
        self.firm = bool(parent and parent.firm) and tag != "main"
        inherit = parent if parent and tag not in CONTENT else None
        self.soft, self.linking, self.foreign = (inherit.soft, inherit.linking, inherit.foreign) if inherit else (False, False, False)
        self.weak = bool(parent and parent.weak) and tag not in CONTENT
        tokens = []
        if attributes and ("=" in attributes or "hidden" in attributes.lower()):
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.hard = True
                elif name in ("class", "id", "role", "itemprop") and tag not in ("html", "body"):
                    tokens += value.split()
                    self.hint_for |= bool(FOR.search(value))
        if tokens:
            named = [x for x in tokens if not QUALIFIED.search(x)]
            nearer = any(map(NEARER.fullmatch, tokens))
            firmly = any(map(FIRMLY.fullmatch, named))
            if tag in CONTENT:
                self.firm |= tag != "main" and not nearer and firmly
            else:
                if nearer:
                    self.soft = self.linking = self.foreign = False
                for part in filter(None, map(head, named)):
                    if LINKING.fullmatch(part):
                        self.linking = True
                    elif not nearer or firmly or FOREIGN.fullmatch(part):
                        self.soft = True
                    self.foreign |= bool(FOREIGN.fullmatch(part))
                self.weak = not nearer and (self.weak or any(map(WEAKLY.search, named)))
                self.firm |= firmly


def head(name: str) -> str | None:
    """The part of a class that speaks against content: its head, or a first part that names remarks, adverts or notices."""
    parts = [x for x in re.split(r"[_-]+", name) if x]
    kept = parts[:]
    while len(kept) > 1 and BOX.fullmatch(kept[-1]):
        kept.pop()
    if kept and FIRMLY.fullmatch(kept[-1]):
        return kept[-1]
    return parts[0] if parts and re.fullmatch(r"ads?|adverts?|comments?|disqus|cookies?|gdpr", parts[0], re.I) else None


def tags(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Marks of a page in order: (begin, end, name, closing, attributes); name is None for comments and the like.

    One pass, whatever the markup: a `<` that opens no tag is text, an open comment goes to the end, and where quotes
    swallow the end of all tags that follow, they are read without quotes from there on.
    """
    at, last, quotes = html.find("<"), html.rfind(">"), True
    while 0 <= at:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3 if not html.startswith(("<!-->", "<!--->"), at) else html.find(">", at) + 1
            end = end if end > 3 else len(html)
            yield at, end, None, False, ""
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            yield at, at + 9, None, False, ""
            if end >= 0:
                yield end, end + 3, None, False, ""
            end = end + 3 if end >= 0 else len(html)
        elif at > last:
            return
        elif html[at + 1] in "!?":
            end = html.find(">", at) + 1
            yield at, end, None, False, ""
        else:
            m = TAG.match(html, at) if quotes else None
            if not m and (html[at + 1].isascii() and html[at + 1].isalpha() or html[at + 1] == "/" and html[at + 2 : at + 3].isalpha()):
                quotes, end = False, html.find(">", at) + 1
                m = TAG.match(re.sub("[\"']", " ", html[at:end]))
                if m:
                    yield at, end, m[2].lower(), bool(m[1]), m[3]
            elif m:
                end = m.end()
                yield at, end, m[2].lower(), bool(m[1]), m[3]
            else:
                end = at + 1
        at = html.find("<", end)


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order; white space inside is one space, and references are decoded."""
    at, here, out = 0, Element("#root", None), []
    count: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []  # of the block under way
    links, depth = [], 0  # its link texts; links open
    skip, skipped = None, 0  # element whose content is no text
    raw = 0  # where raw text ends
    titles: list[tuple[Element, int, list[int]]] = []  # headings of what is no content: their parent, level and blocks
    groups: list[list[int]] = []  # the blocks of such headings, first the heading
    titled: set[Element] = set()  # such parents that are open

    def end_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(unescape("".join(links)).split())) if links else 0
                owner = here
                while owner.tag in INLINE and owner.parent:
                    owner = owner.parent
                level = HEADINGS.get(owner.tag, 7)
                while titles and (level <= titles[-1][1] or titles[-1][0] not in titled):
                    titles.pop()
                if level < 7 and owner.parent and TITLE.match(text):
                    titles.append((owner.parent, level, []))
                    groups.append(titles[-1][2])
                    titled.add(owner.parent)
                for _, _, group in titles:  # at most six, since their levels rise
                    group.append(len(out))
                out.append(Block(text, linked, owner, False))
            parts.clear()
            links.clear()

    def close(to: Element) -> Element:
        """Close all elements below `to`."""
        x = here
        while x is not to:
            count[x.tag] -= 1
            titled.discard(x)  # a title ends with its parent
            x = x.parent
        return to

    def above(names: set, stop: set) -> Element:
        """The place after an open element of `names` is closed, if there is one below `stop`."""
        x = here
        while any(count[n] for n in names) and x.tag not in names and x.tag not in stop and x.parent:
            x = x.parent
        return x.parent if x.tag in names else here

    for begin, end, tag, closing, attributes in tags(html):
        if begin < raw:
            continue
        if not skip and at < begin:
            parts.append(html[at:begin])
            if depth:
                links.append(html[at:begin])
        at = end
        if tag is None:
            continue
        empty = attributes.endswith("/")
        if skip:
            if tag == skip:
                skipped += -1 if closing else not empty
                skip = skip if skipped else None
            continue
        if tag == "head":
            continue
        if closing:
            if tag not in INLINE:
                end_block()
            if tag == "a":
                depth = max(0, depth - 1)
            if count[tag] > 0:
                found = here
                # an inline end tag does not close blocks
                while found.tag != tag and (tag not in INLINE or found.tag in INLINE):
                    found = found.parent
                if found.tag == tag:
                    here = close(found.parent)
            continue
        if tag not in INLINE:
            end_block()
        if here.form and (tag in ("select", "textarea") or tag == "input" and not re.search(r"type\s*=\s*[\"']?hidden", attributes, re.I)):
            here.form.controls += 1
        if tag in RAW and not empty:
            ended = re.compile(r"</" + tag + r"(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = raw = ended.end() if ended else len(html)
            continue
        if tag in SKIPPED and not empty:
            skip, skipped = tag, 1
            continue
        if tag not in INLINE:
            if tag in CLOSES_P:
                here = close(above({"p"}, {"#root", "td", "th", "button", "article", "section", "div", "body"}))
            if tag in CLOSES_SELF:
                here = close(above({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag} | ({"td", "th"} if tag == "tr" else set()), CLOSES_SELF[tag]))
            outer = here
            while outer.tag in INLINE and outer.parent:
                outer = outer.parent
            if outer is not here:
                here, depth = close(outer), 0
        elif tag == "br":
            parts.append(" ")
        if tag in VOID or empty and tag not in INLINE and tag not in CLOSES_P:
            continue
        depth += tag == "a"
        count[tag] += 1
        here = Element(tag, here, attributes)
    if not skip and max(at, raw) < len(html):
        parts.append(html[max(at, raw) :])
    end_block()
    for group in groups:
        for i in group if apart([out[i] for i in group]) else ():
            out[i].under = True
    mark_forms(out)
    mark_said(out)
    return out


def apart(group: list[Block]) -> bool:
    """Whether blocks below a heading that names no content are none: mostly links, or remarks, or the heading leaves no doubt."""
    title, rest = group[0], group[1:]
    if not (title.element.content or TOPIC.fullmatch(title.text)) or title.element.firm or title.element.soft:
        return True
    linked = sum(b.linked for b in rest)
    return 2 * linked > sum(len(b.text) for b in rest) or any(b.remark for b in rest)


def mark_forms(blocks: list[Block]) -> None:
    """A form is a frame if it has more than half of the page's sentences and much text for each control."""
    held: Counter[Element] = Counter()
    total = 0
    for b in blocks:
        if b.sentences and not b.element.hard:
            total += len(b.text)
            if b.element.form:
                held[b.element.form] += len(b.text)
    for form, n in held.items():
        form.frame = 2 * n > total and n >= BY_CONTROL * form.controls


def mark_said(blocks: list[Block]) -> None:
    """Elements that begin with who said something and when, after a text of twice as many words: what they hold is said there."""
    runs: list[list[Block]] = []  # neighbouring blocks of one parent
    for b in blocks:
        if runs and runs[-1][0].element.parent is b.element.parent:
            runs[-1].append(b)
        else:
            runs.append([b])
    before = 0
    for run in runs:
        at = next((i for i, b in enumerate(run) if b.remark), len(run))
        ahead, words = before + sum(b.n_words for b in run[:at] if b.sentences), sum(b.n_words for b in run[at:])
        said = at == 0 and not run[0].element.content and ahead >= 2 * words
        for b in run:
            b.said = said
        before += sum(b.n_words for b in run if b.sentences and not b.ruled_out and not said)


def features(blocks: list[Block]) -> list[list[float]]:
    """What the classifier sees of each block, in the order of FEATURES."""
    divided = any(b.element.content and not b.element.hard for b in blocks)
    # where all sentences stand below parts of classes, these tell nothing apart; inside a main text they do
    telling = any(b.sentences and not (b.ruled_out or b.element.soft or b.element.firm or b.under or b.said or NOTICE.search(b.text[:1000])) for b in blocks)
    out = []
    for b in blocks:
        e, words = b.element, b.n_words
        soft = e.soft and (telling or e.foreign or e.content) or e.linking and not b.sentences
        against = e.firm or soft
        inside = (e.content or e.hint_for and not divided) and not against
        linked = min(1.0, b.linked / max(1, len(b.text)))
        out.append(
            [
                1.0,
                float(e.content and not against),
                float(divided and not e.content),
                float(e.hint_for and not against),
                float(e.firm),
                float(soft),
                float(e.weak),
                linked * (not inside),
                linked * inside,
                min(1.0, math.log2(words + 1) / 6),
                float(words > 3 and bool(re.search(r"[.!?\u3002\uff01\uff1f\u0964](?:\s|[\"')\]]|\Z)", b.text))),
                float(e.tag in HEADINGS),
                float(e.tag in ("li", "td", "th", "dt") and not inside),
                float(not e.content and bool(NOTICE.search(b.text[:1000]))),
                float(not e.content and b.remark),
                float(b.said),
                float(b.under),
                float(not e.content and bool(re.match(r"\u00a9|(?:copyright|\(c\)|all rights reserved)(?:\W|$)", b.text, re.I))),
            ]
        )
    return out


def probability(row: list[float]) -> float:
    """The classifier's probability that a block is content."""
    z = sum(WEIGHTS[name] * x for name, x in zip(FEATURES, row))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the DOM."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; `edges` have equal capacity both ways (Dinic's max-flow).

    Of equal cuts it is the one with the fewest nodes there.
    """
    n = len(source)
    heads: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in edges:
        heads[a].append(len(to))
        to.append(b)
        room.append(c)
        heads[b].append(len(to))
        to.append(a)
        room.append(c)
    # what flows straight through a node needs no search: only the rest of one terminal is left
    supply = [max(0.0, s - t) for s, t in zip(source, sink)]
    demand = [max(0.0, t - s) for s, t in zip(source, sink)]
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > 1e-12)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or demand[i] > 1e-12
            for e in heads[i]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in range(n):
            if level[start] != 0:
                continue
            path, i = [], start
            while supply[start] > 1e-12:
                if demand[i] > 1e-12 and path:
                    flow = min([supply[start], demand[i], *(room[e] for e in path)])
                    supply[start] -= flow
                    demand[i] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, i = [], start
                    continue
                while at[i] < len(heads[i]):
                    e = heads[i][at[i]]
                    if room[e] > 1e-12 and level[to[e]] == level[i] + 1:
                        break
                    at[i] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    i = to[e ^ 1]
                    at[i] += 1
                    continue
                path.append(e)
                i = to[e]


def content(html: str | None) -> list[str]:
    """The content blocks of a page, in order."""
    blocks = blocks_of(html or "")
    source, sink, edges, last = [], [], [], {}
    for i, (b, row) in enumerate(zip(blocks, features(blocks))):
        p = min(max(probability(row), 1e-9), 1 - 1e-9)
        source.append(-math.log(1 - p))
        sink.append(UNBOUNDED if b.ruled_out else -math.log(p))
        if i and b.element.content == blocks[i - 1].element.content:  # a main text's border is no place to be smooth
            edges.append((i - 1, i, ADJACENT / max(1, distance(blocks[i - 1].element, b.element))))
        key = id(b.element.parent)
        if key in last:
            edges.append((last[key], i, SIBLING / (i - last[key])))
        last[key] = i
    return [b.text for b, keep in zip(blocks, min_cut(source, sink, edges)) if keep]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple = ("url",)) -> DataFrame:
    """Rows (page_id, *keep, text, n_chars, n_blocks), one for each row of `pages`.

    The blocks of content joined by a blank line. Null and empty html give an empty text; broken markup is read as far
    as it goes; repeated rows are extracted each; an empty table gives an empty result; other columns are left out.
    """

    @F.pandas_udf("text string, n_blocks long")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [content(h) for h in batch]
            yield pd.DataFrame({"text": ["\n\n".join(x) for x in found], "n_blocks": [len(x) for x in found]})

    rows = pages.select(id_col, *keep, read(F.col(html_col)).alias("__read"))
    return rows.select(id_col, *keep, "__read.text", F.length("__read.text").cast("long").alias("n_chars"), "__read.n_blocks")
