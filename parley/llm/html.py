"""Main text of web pages: the best contiguous region of words and tags.

A page becomes a sequence of pieces, texts and tags in page order. Words score by where
they stand (their two innermost block elements, inside or outside the page's article
element), tags score by their name and never above zero. The weights are log odds counted
on labelled pages: those of a bounded sample that mark their article. One linear scan
finds the region with the highest sum. Parts that are never article text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are left out
of the region's text and do not break it where they stand inside an article.

Defined results: null, empty and tag-free pages: the whole text of a tag-free page, else
an empty one; with an empty table or without labelled pages the default weights hold; equal
scores go to the region that begins first; of articles that stand apart the region with the
highest sum; repeated rows give one row each. Time is linear in the page, also for very deep or
broken markup; a '<' that no '>' follows is text.
"""

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import map_arrow

#: Pages looked at for labels, and contexts and tags that get a weight of their own.
SAMPLE_PAGES = 2_000
MAX_WEIGHTS = 5_000
CLIP = 4.0

#: No pattern backtracks: a tag ends at the first '>' outside quoted values; _LOOSE knows no quotes.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_UNSEEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.S)
_DECLARED = re.compile(r"<[!?][^>]*+>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MARKED = re.compile(r"<(?:article|main)[\s>]", re.I)

# Elements and words of class, id and role that HTML pages use for these parts.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "img", "wbr"}
CHROME = {"nav", "footer", "aside", "form", "button", "select", "head", "svg", "dialog", "menu", "object", "canvas",
          "audio", "video", "datalist", "fieldset", "map"}
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pager pagination popup promo promotion recommended related replies reply search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
#: Of these, words for texts of others; a part named so is never the article's, whatever stands in it.
OTHER_WORDS = set(
    "ad ads adsbygoogle adsense advert adverts advertisement advertisements advertising comment commentlist comments disqus "
    "outbrain pingbacks recommended related replies responses sponsor sponsored sponsors taboola trackbacks".split())
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
#: Words that a class or id may have besides; "comments-open" or "no-sidebar" tell a state of the page.
PART_WORDS = set("area bar bars block body bottom box btn button buttons container form global group icon icons inner item "
                 "items left link links list module panel post posts primary right secondary section site slot text "
                 "title top unit wrap wrapper".split())
#: Words that may stand beside OTHER_WORDS besides.
OTHER_PARTS = set("articles author content google meta posts stories thread threads".split())
HEADER_WORDS = {"header", "main", "page", "entry", "article"}
#: Elements whose class and id tell nothing about being left out; article counts unless it stands in another one.
WHOLE = {"html", "body", "main"}
CONTAINER_WORDS = {"article", "content", "entry", "main", "post", "story"}


def _named(names, words, more=frozenset()):
    """Whether a class or id is one of the words, or made of them and of PART_WORDS, numbers and `more` alone."""
    for name in names:
        parts = set(filter(None, re.split(r"[^a-z]+", name)))
        if parts & words and parts <= words | PART_WORDS | more:
            return True
    return False


def _kind(tag, attributes, marked, named):
    """'chrome', 'named' (chrome by class or id, if `named`), 'header', 'article' or '' for an element."""
    if tag in CHROME:
        return "chrome"
    found = {}
    if attributes.strip():
        for name, *values in _ATTRIBUTE.findall(attributes):
            found[name.lower()] = next(filter(None, values), "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true" or \
            re.search(r"display\s*:\s*none", found.get("style", "")):
        return "chrome"
    role = found.get("role", "")
    whole = f"{found.get('class', '')} {found.get('id', '')}".split()
    if role in CHROME_ROLES or tag not in WHOLE and (
            _named(whole, OTHER_WORDS, OTHER_PARTS) or found.get("itemprop") == "comment"):
        return "chrome"
    if named and _named(whole, CHROME_WORDS):
        return "named"
    if tag in ("article", "main") or role in ("article", "main"):
        return "article"
    if not marked and tag in ("div", "section") and set(re.split(r"[^a-z0-9]+", " ".join(whole))) & CONTAINER_WORDS:
        return "article"
    if tag == "header":
        return "header"
    return "named header" if named and _named(whole, {"header"}, HEADER_WORDS | CHROME_WORDS) else ""


def tokens(page):
    """(text, tag match or None, end) of the texts and tags of a page in page order, in linear time. The reader may
    send a place to go on from. Where a tag's quotes leave it without an end, quotes mean nothing from there on."""
    at, last, strict = 0, page.rfind(">"), True
    while at < len(page):
        end, m = at, None
        if page[at] == "<":
            if m := _UNSEEN.match(page, at):
                at = m.end()
                continue
            if at > last:
                end = len(page)
            elif m := _DECLARED.match(page, at):
                at = m.end()
                continue
            else:
                name = page[at + 1:at + 3].lstrip("/")[:1]
                if name.isascii() and name.isalpha():
                    m = strict and _TAG.match(page, at)
                    if not m:
                        strict, m = False, _LOOSE.match(page, at)
                end = m.end() if m else at + 1
        else:
            end = page.find("<", at)
            end = len(page) if end < 0 else end
        at = (yield page[at:end], m, end) or end


def pieces(page, opened=None):
    """(kind, name, n_words, text) per piece: 'word' with its context, 'skip' for words left
    out, 'tag' with its name; a tag that ends a block has the text None, others ''.

    `opened`: place of an element within which classes and ids do not count outside articles.
    Where no article has words outside the parts left out by class or id, the first of these parts
    that holds an article is opened; parts with texts of others (OTHER_WORDS) never are."""
    out, stack, blocks, held, marked = [], [], [], {}, bool(_MARKED.search(page))
    chrome = named = inside = kept = 0
    hides, outer, depth = None, None, None

    def pop():
        nonlocal chrome, named, inside
        tag, kind = stack.pop()
        held[tag] -= 1
        if tag not in INLINE:
            blocks.pop()
        chrome -= kind == "chrome"
        named -= kind == "named"
        inside -= kind == "article"
    reader, back = tokens(page), None
    while True:
        try:
            text, m, at = reader.send(back)
        except StopIteration:
            break
        back = None
        if m is None:
            n = len(text.split())
            context = ("in>" if inside else "out>" if marked else "any>") + ">".join(blocks[-2:])
            out.append(("skip" if chrome or named else "word", context, n, text, inside))
            if inside and not chrome:
                if not named:
                    kept += n
                elif n and hides is None:
                    hides = outer
            continue
        tag, block = m[2].lower(), m[2].lower() not in INLINE
        out.append(("tag", tag, 0, None if block else "", inside))
        if m[1]:
            if held.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            back = end.end() if end else len(page)
            continue
        if block:
            while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE and held.get("p")) or \
                    stack and stack[-1][0] == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                pop()
        whole = tag in WHOLE or tag == "article" and not held.get("article")
        if m.start() == opened:
            depth = len(stack)
        elif depth is not None and len(stack) <= depth:
            depth = None
        kind = _kind(tag, m[3], marked, not whole and bool(depth is None or inside))
        if kind.endswith("header"):
            kind = "" if inside else "chrome" if kind == "header" else "named"
        if kind == "named" and not named:
            kind, outer = ("chrome", outer) if inside else (kind, m.start())
        stack.append((tag, kind))
        held[tag] = held.get(tag, 0) + 1
        if block:
            blocks.append(tag)
        chrome += kind == "chrome"
        named += kind == "named"
        inside += kind == "article"
    return pieces(page, hides) if opened is None and not kept and hides is not None else out


def score(piece, weights):
    """Score of a piece. Inside an article tags weigh next to nothing, words left out
    nothing, and other words at least 1, so rare markup never splits it."""
    kind, name, n, _, inside = piece
    if kind == "tag":
        return max(min(0.0, weights.get("tag " + name, -0.1)), -0.001 if inside else -CLIP)
    if kind == "skip":
        return 0.0 if inside else -n * abs(weights.get("word " + name, 1.0))
    weight = weights.get("word " + name)
    if inside:
        return n * max(1.0, weight or 1.0)
    if weight is None:
        place, _, blocks = name.partition(">")
        weight = -1.0 if place == "out" else weights.get("word last " + blocks.rpartition(">")[2], 1.0)
    return n * weight


def best_region(scores):
    """(first, end) of the contiguous run with the highest positive sum, the first one of equals."""
    best, region, total, begin = 0.0, (0, 0), 0.0, 0
    for i, value in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += value
        if total > best:
            best, region = total, (begin, i + 1)
    return region


def extract(page, weights):
    """Main text: blocks in page order, one per line; '' for None."""
    if not page:
        return ""
    found = pieces(page)
    first, end = best_region([score(p, weights) for p in found])
    blocks, held = [], []
    for kind, _, _, text, _ in [*found[first:end], ("tag", "", 0, None, 0)]:
        if kind == "word":
            held.append(text)
        elif text is None and held:
            blocks.append(" ".join(entities.unescape("".join(held)).split()))
            held = []
    return "\n".join(filter(None, blocks))


def labelled_counts(batch):
    """Words and tags inside and outside the article of pages that mark one: name, n_in, n_out."""
    names, n_in, n_out = [], [], []
    for page in batch.column(0).to_pylist():
        if not page or not _MARKED.search(page):
            continue
        own = {}
        for kind, name, n, _, inside in pieces(page):
            keys = ["tag " + name] if kind == "tag" else ["word " + name, "word last " + name.rpartition(">")[2]]
            for key in keys:
                count = own.setdefault(key, [0, 0])
                count[not (inside and kind != "skip")] += 1 if kind == "tag" else n
        for key, (a, b) in own.items():
            names.append(key)
            n_in.append(a)
            n_out.append(b)
    return names, n_in, n_out


def learn_weights(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict:
    """Weights from at most `sample` pages, chosen by a hash of their id."""
    ids = pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    chosen = pages.join(F.broadcast(ids.distinct()), "page_id", "left_semi").select(F.col("html").cast("string"))
    counts = (map_arrow(chosen, labelled_counts, "name string, n_in long, n_out long").groupBy("name")
              .agg(F.sum("n_in").alias("a"), F.sum("n_out").alias("b"))
              .orderBy(F.desc(F.col("a") + F.col("b")), "name").limit(MAX_WEIGHTS))
    rows = counts.select("name", F.log((F.col("a") + 1) / (F.col("b") + 1))).collect()
    return {name: max(-CLIP, min(CLIP, w)) if name.startswith("word") else max(-CLIP, min(-0.05, w))
            for name, w in rows}


def main_text(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(learn_weights(pages, sample))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batch):
        text = [extract(page, shared.value) for page in batch.column(2).to_pylist()]
        return batch.column(0), batch.column(1), text, [len(t) for t in text]
    return map_arrow(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
