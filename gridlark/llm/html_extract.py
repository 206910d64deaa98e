"""HTML main text by consensus paths of a host.

A page is scanned once: elements that are boilerplate by tag or role and readers'
comments are dropped.  So are forms and elements with a class or id that says so in
part, unless they hold the page's text; elements with such a class or id as a whole,
unless they hold the page's only article; and sections of an article with such an id,
unless they have a heading and text of their own.  Where one stays, the page is scanned
again with it.
The rest of its text is kept with the spans of its containers, each
under a generalised path of tags and classes (digits made alike).  A page
proposes the tightest container outside of which it has no prose, heading or loose
text; proposals are counted per host and path in Spark, and every page is then
re-extracted with its host's winning path, or its own where the page lacks that.
A winning container that would cut off such text on a page gives way to those
around it there; only other containers right below the body, which the host's
pages say are not the text, are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br button option td th tr tbody thead tfoot caption legend select body html head".split())

#: Elements whose text is never the article's.
DROPPED_TAGS = frozenset(
    "head script style title textarea xmp iframe noembed noframes noscript template nav header footer aside button select option menu dialog svg canvas object "
    "audio video map input".split()
)
#: Elements with such a class or id, as a whole, are dropped unless they hold the only article.
DROPPED_WORDS = frozenset(
    "ad ads adbox adsbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs header masthead "
    "topbar footer sidebar sidebars rail widget widgets comment comments commentlist disqus reply replies respond discussion cookie cookies cookiebar consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup signin login share sharing sharebar social related recommended recommendations trending pagination pager toolbar skip copyright "
    "search searchbox form hidden".split()
)
#: Of these, what readers write; it never stays for its size.
READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Of these, what a section of an article may be about, by its id.
TOPICS = frozenset("discussion search menu menus notice notices form consent alert navigation sponsor".split())
#: Of these, what a heading may be called.
TITLES = frozenset("header masthead banner".split())
#: Elements that an article ends where they are left open.
LEFT_OPEN = frozenset("nav header footer aside menu dialog".split())
#: Of a class or id in parts, those after which a part says what else is on the page.
BESIDE = frozenset("with has no without hide show toggle is not".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
KEPT_WORDS = frozenset("article post entry story content main".split())
CONTAINERS = frozenset("body div section article main table tbody tr td center blockquote figure ul ol dl span".split())

_COMMENT_END = re.compile(r"--!?>")
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?/a-zA-Z])")
_INSIDE = re.compile(r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+>""", re.S)
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))|\b(hidden)\b""", re.S)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: PROSE: words without a link or block between them; fewer in a container of their own are a label.
HOLDS, PROSE = 0.8, 3
#: What a doubtful element holds; a wrapper of the article has OUTWEIGHS times the prose of articles outside.
ARTICLE, MAIN, TITLE, HEADING, OTHERS = 1, 2, 4, 8, 16
OUTWEIGHS = 4


def host_of(url) -> F.Column:
    """The lower-cased host of a url; null or hostless urls share one group."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip(" /\n") else {}


def _is_own(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element says that it is the article."""
    return tag in ("article", "main") or any(x.lower() in KEPT_WORDS for x in _names(attrs))


def _names(attrs: dict[str, str]) -> list[str]:
    return f"{attrs.get('class', '')} {attrs.get('id', '')}".split()


def boilerplate(tag: str, attrs: dict[str, str], inside: bool = False) -> str | None:
    """``"sure"`` for elements that are never the article, and for those that may yet
    hold it: ``"maybe"`` for forms, and classes and ids that only in part say so,
    ``"class"`` for whole ones, ``"readers"`` for those of comments, ``"section"`` for a
    section ``inside`` an article whose id may be its topic."""
    if tag in DROPPED_TAGS:
        return "sure"
    if tag in ("html", "body"):
        return None
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in DROPPED_ROLES - {"form"}:
        return "sure"
    if re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", attrs.get("style", ""), re.I):
        return "sure"
    tokens, harmless = _names(attrs), TITLES if tag in HEADINGS else frozenset()
    whole = {x.lower() for x in tokens} & DROPPED_WORDS - harmless
    if whole:
        if any(x.lower() in KEPT_WORDS for x in tokens):
            return "maybe"
        if tag == "section" and inside and whole <= TOPICS and not whole & set(attrs.get("class", "").lower().split()):
            return "section"
        if whole & READERS:
            return "readers" if tag in ("article", "main") else "sure"
        return "maybe" if tag in ("article", "main") else "class"
    for x in tokens if not _is_own(tag, attrs) else ():
        parts = [p.lower() for p in _PARTS.findall(x)]
        for k, p in enumerate(parts):
            if p in DROPPED_WORDS - harmless and not BESIDE & set(parts[:k]) and not (p == "header" and KEPT_WORDS & set(parts)):
                return "readers" if p in READERS else "maybe"
    return "maybe" if tag == "form" or attrs.get("role", "").lower() == "form" else None


def step_of(tag: str, attrs: dict[str, str]) -> str:
    names = sorted(re.sub(r"\d+", "0", attrs.get("class", "").lower()).split())
    return ".".join([tag, *names])


class Page:
    """One scanned page: ``text``, ``spans`` of (hash of path, start, end, levels to go up
    where the path wins) and ``best``, its own path as (hash, step) from the top."""

    def __init__(self, source: str):
        self.stays: frozenset[int] = frozenset()
        self.source, self.balance = source, {}
        self._read(source)
        if stays := self._staying():
            self.stays = frozenset(stays)
            self._read(source)
        self.text = "".join(self.parts)
        self.below: dict[int, list[int]] = {}
        for k, n in enumerate(self.nodes):
            self.below.setdefault(n[2], []).append(k)
        at = self._tightest()
        self.best = None if at is None else self._steps(at)
        up = self._levels_up(None if at is None else self.nodes[at][0])
        self.spans = [(n[0], n[3], n[4], up[n[0]]) for n in self.nodes if n[4] > n[3]]

    def _read(self, source: str) -> None:
        self.parts: list[str] = []
        self.size = self.linked = self.plain = self.prose = 0
        self.run = self.headings = 0  # unlinked words since the last block; open headings
        # open elements: tag, container number or -1, whether it starts a dropped subtree, number of a doubtful one or -1, whether it is an article
        self.open: list[tuple[str, int, bool, int, bool]] = []
        self.places: dict[str, list[int]] = {}  # where each tag is open
        self.blocks: list[int] = []  # where blocks other than p are
        self.nodes: list[list] = []  # hash of path, tag, parent, start, end, linked chars, unlinked words, those of prose, step
        self.inside: list[int] = []
        self.doubtful: list[list] = []  # of each element that is maybe boilerplate: the one around it, its prose outside others, what it holds, why
        self.doubts: list[int] = []  # the open ones
        self.own = self.own_prose = 0  # open articles; prose in them
        self.dropped = self.links = 0
        self.pending = False  # white space due before the next text
        self._scan(source)
        while self.open:
            self._pop()

    def _staying(self) -> list[int]:
        """Doubtful elements that are no boilerplate: the largest of those side by
        side where without them no prose is left, or where it has an article or
        heading and more prose than all else; then the same inside it.  Of whole
        classes only what wraps the article, of readers' only what wraps the page is in
        question.  Sections stay by themselves."""
        whole, holds, why = [d[1] for d in self.doubtful], [d[2] for d in self.doubtful], [d[3] for d in self.doubtful]
        below: dict[int, list[int]] = {}
        for k in range(len(self.doubtful) - 1, -1, -1):
            around = self.doubtful[k][0]
            wraps = {"class": holds[k] & (ARTICLE | MAIN) and whole[k] > OUTWEIGHS * self.own_prose, "readers": holds[k] & (MAIN | TITLE), "section": False}.get(why[k], True)
            if wraps:
                below.setdefault(around, []).insert(0, k)
            if around >= 0:
                whole[around] += whole[k] if wraps else 0
                holds[around] |= holds[k] if wraps else holds[k] & OTHERS
        left, beside, out = self.prose, list(below.get(-1, [])), []
        rest = sum(whole[k] for k in beside)
        while beside:
            best = max(beside, key=lambda k: (whole[k], -k))
            if not whole[best] or (left and not (holds[best] & (ARTICLE | MAIN | TITLE) and whole[best] > left + rest - whole[best])):
                break
            out.append(best)
            beside.remove(best)
            beside += below.get(best, [])
            left += self.doubtful[best][1]
            rest -= self.doubtful[best][1]
        stays = set(out)
        for k, (around, prose, _, reason) in enumerate(self.doubtful):
            if reason == "section" and prose and holds[k] & HEADING and not holds[k] & OTHERS and (around < 0 or around in stays):
                stays.add(k)
        return sorted(stays)

    def _scan(self, source: str) -> None:
        """Tags by one look ahead each; a tag that the page's end cuts off goes with all after it."""
        at, last = 0, source.rfind(">")
        while m := _OPEN.search(source, at):
            start, mark = m.start(), m.group()
            self._text(source[at:start])
            if mark == "<!--":  # "<!-->" and "<!--->" are whole comments
                short = next((n for x, n in ((">", 1), ("->", 2)) if source.startswith(x, m.end())), 0)
                end = None if short else _COMMENT_END.search(source, m.end())
                at = m.end() + short if short else end.end() if end else len(source)
                continue
            if mark == "<![CDATA[":  # in HTML a comment up to the next ">"
                at = source.find(">", m.end()) + 1 or len(source)
                continue
            if start > last:
                return
            if mark in ("<!", "<?"):
                at = source.find(">", start) + 1
                continue
            closing = mark == "</"
            name = _NAME.match(source, start + 1 + closing)
            if not name:  # "</" before something else
                at = source.find(">", start) + 1
                continue
            inside = _INSIDE.match(source, name.end())
            at = inside.end() if inside else source.find(">", start) + 1
            tag, raw = name.group().lower(), source[name.end() : at - 1]
            if closing:
                self._end(tag)
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*+>", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            self._start(tag, raw)
        self._text(source[at:])

    def _text(self, raw: str) -> None:
        if not raw or self.dropped:
            return
        value = html.unescape(raw) if "&" in raw else raw
        words = " ".join(value.split())
        if not words:
            self.pending = True
            return
        if self.doubts:
            if not self.links:
                self.run += words.count(" ") + 1
                if self.run >= PROSE:
                    self.doubtful[self.doubts[-1]][1] += words.count(" ") + 1
            return
        if (self.pending or value[0].isspace()) and self.size:
            self.parts.append(" ")
            self.size += 1
        self.parts.append(words)
        self.size += len(words)
        if self.links:
            self.linked += len(words)
        else:
            n = words.count(" ") + 1
            self.run += n
            self.plain += n
            if self.headings or self.run >= PROSE:
                self.prose += n
                self.own_prose += n if self.own else 0
        self.pending = value[-1].isspace()

    def _start(self, tag: str, raw: str) -> None:
        if self.dropped and tag in ("article", "main") and self._left_open(self.open[self.dropping][0]):
            while len(self.open) > self.dropping:
                self._pop()
        if tag in BLOCK:
            self.pending = True
            self.run = 0
        if tag in CLOSES_P and self._last("p") > (self.blocks[-1] if self.blocks else -1):
            self._end("p")
        if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            self._implied(tag)
        if tag in VOID:
            return
        drop, doubt, number, verdict, own = False, -1, -1, None, False
        if not self.dropped:
            attrs = _attributes(raw)
            verdict = boilerplate(tag, attrs, self.own > 0)
            drop = verdict == "sure"
            if self.doubts:
                found = {"article": ARTICLE, "main": MAIN, "h1": TITLE | HEADING}.get(tag, HEADING if tag in HEADINGS else 0) if verdict is None else 0
                others = verdict == "readers" or tag == "form" or (drop and not READERS.isdisjoint(x.lower() for x in _names(attrs)))
                self.doubtful[self.doubts[-1]][2] |= found | (OTHERS if others else 0)
            if verdict and not drop:
                doubt = len(self.doubtful)
                self.doubtful.append([self.doubts[-1] if self.doubts else -1, 0, 0, verdict])
                if doubt in self.stays:
                    doubt = -1
            if doubt >= 0:
                self.doubts.append(doubt)
            own = not drop and doubt < 0 and _is_own(tag, attrs)
        if drop:
            self.dropped, self.dropping = 1, len(self.open)
        elif not self.dropped and not self.doubts and tag in CONTAINERS:
            parent = self.inside[-1] if self.inside else -1
            step = step_of(tag, attrs)
            key = xxhash.xxh64_intdigest(f"{self.nodes[parent][0] if parent >= 0 else ''}>{step}") - (1 << 63)
            number = len(self.nodes)
            self.nodes.append([key, tag, parent, self.size, self.size, self.linked, self.plain, self.prose, step])
            self.inside.append(number)
        if tag == "a" and not self.dropped:
            self.links += 1
        self.headings += tag in HEADINGS
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK and tag != "p":
            self.blocks.append(len(self.open))
        self.own += own
        self.open.append((tag, number, drop, doubt, own))

    def _left_open(self, tag: str) -> bool:
        """Whether the page opens such elements more often than it closes them."""
        if tag not in LEFT_OPEN:
            return False
        if tag not in self.balance:
            self.balance[tag] = sum(-1 if m[1] else 1 for m in re.finditer(rf"<(/?){tag}(?![a-zA-Z0-9:-])", self.source, re.I))
        return self.balance[tag] > 0

    def _last(self, *tags: str) -> int:
        """The place of the last of these tags that is open, or -1."""
        return max(self.places[t][-1] if self.places.get(t) else -1 for t in tags)

    def _implied(self, tag: str) -> None:
        same, stop = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, (tag,)), ("ul", "ol", "dl", "table", "select", "menu")
        at = self._last(*same)
        if at > self._last(*stop, *(() if tag == "tr" else ("tr",))):
            self._end(self.open[at][0])

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self.pending = True
            self.run = 0
        at = self._last(tag)
        if at >= 0 and (tag in BLOCK or at > self._last("article", "main", "body", "td", "table")):
            while len(self.open) > at:
                self._pop()

    def _pop(self) -> None:
        tag, number, drop, doubt, own = self.open.pop()
        self.own -= own
        self.headings -= tag in HEADINGS
        self.places[tag].pop()
        if tag in BLOCK and tag != "p":
            self.blocks.pop()
        if drop:
            self.dropped = 0
            self.pending = True
        if doubt >= 0:
            self.doubts.pop()
            self.pending = True
        if number >= 0:
            node = self.nodes[number]
            node[4], node[5], node[6], node[7] = self.size, self.linked - node[5], self.plain - node[6], self.prose - node[7]
            self.inside.pop()
        if tag == "a" and not self.dropped and self.links:
            self.links -= 1

    def _steps(self, at: int) -> list[tuple[int, str]]:
        out = []
        while at >= 0:
            out.append((self.nodes[at][0], self.nodes[at][8]))
            at = self.nodes[at][2]
        return out[::-1]

    def _loose(self, at: int) -> bool:
        """Whether unlinked words are in a container, or the page, but in none below it."""
        return (self.nodes[at][6] if at >= 0 else self.plain) > sum(self.nodes[k][6] for k in self.below.get(at, []))

    def _levels_up(self, own: int | None) -> dict[int, int]:
        """For each path, how many levels up a container lies that cuts off no text around it."""
        parents: dict[int, dict[int, int]] = {}
        for n in self.nodes:
            held = parents.setdefault(n[0], {})
            held[n[2]] = held.get(n[2], 0) + n[7]
        loose = {k: self._loose(k) for k in self.below}
        up: dict[int, int] = {}
        for n in self.nodes:  # a parent comes before what it holds
            if n[0] in up:
                continue
            up[n[0]] = 0
            if n[0] == own or n[1] in ("article", "main"):
                continue
            for parent, held in parents[n[0]].items():
                if parent >= 0 and (loose[parent] or (self.nodes[parent][1] != "body" and self.nodes[parent][7] > held)):
                    up[n[0]] = 1 + up[self.nodes[parent][0]]
        return up

    def _tightest(self) -> int | None:
        """From the widest container down, as long as one child holds most of the
        unlinked text and none of the rest is prose, a heading or loose; articles
        and mains are where it stops."""
        nodes, below = self.nodes, self.below
        weight = [max(0, n[4] - n[3] - 2 * n[5]) for n in nodes]
        total = sum(weight[k] for k in below.get(-1, []))
        if not total:
            return None

        def inner(at: int) -> int | None:
            now, prose = (total, self.prose) if at < 0 else (weight[at], nodes[at][7])
            best = max(below.get(at, []), key=lambda k: (weight[k], -k), default=None)
            return None if best is None or weight[best] < HOLDS * now or nodes[best][7] < prose or self._loose(at) else best

        special = [k for k, n in enumerate(nodes) if n[1] in ("article", "main")]
        top = max(special, key=lambda k: (weight[k], -k), default=None)
        if top is not None and weight[top] * 4 >= total:
            at = top
            while (at := inner(at)) is not None:
                if nodes[at][1] == "article":
                    top = at
            return top
        at = -1
        while (child := inner(at)) is not None:
            at = child
        return at if at >= 0 else None


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("up", pa.int32())]))
    step = pa.list_(pa.struct([("key", pa.int64()), ("step", pa.string())]))
    for batch in batches:
        pages = [Page(x or "") for x in batch.column("html").to_pylist()]
        spans = [[{"key": p, "start": a, "size": b - a, "up": u} for p, a, b, u in page.spans] for page in pages]
        columns = [batch.column(x) for x in ("page_id", "url", "host")]
        yield pa.record_batch(
            [*columns, pa.array([p.text for p in pages], pa.string()), pa.array(spans, span), pa.array([p.best and [{"key": k, "step": x} for k, x in p.best] for p in pages], step)],
            ["page_id", "url", "host", "whole", "spans", "own"],
        )


FEW_HOSTS = 100_000


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``(page_id, url, text, n_chars, path)`` of every page.

    Null and empty pages and pages of boilerplate have an empty text; a page
    without containers gives all of its clean text; pages without a host vote
    together; equal votes go to the greater path; repeated rows answer alike; an
    empty table gives no rows; other columns are ignored.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    schema = "page_id long, url string, host string, whole string, spans array<struct<key:long,start:int,size:int,up:int>>, own array<struct<key:long,step:string>>"
    scanned = scratch.table(given.mapInArrow(_scanned, schema), "scanned")

    def named(path: str) -> F.Column:
        return F.array_join(F.transform(path, lambda x: x.step), ">")

    votes = scanned.where("own is not null").groupBy("host", "own").agg(F.count("*").alias("pages"))
    won = scratch.table(votes.groupBy("host").agg(F.max(F.struct("pages", named("own"), "own")).alias("w")).select(F.col("host").alias("_host"), F.col("w.own").alias("voted")), "won")
    if won.count() <= FEW_HOSTS:
        won = F.broadcast(won)
    joined = scanned.join(won, F.col("host") == F.col("_host"), "left")

    def held(path: str) -> F.Column:
        """Outermost spans of a path, in page order."""
        return F.trim(F.array_join(F.transform(F.filter("spans", lambda s: s.key == F.get(path, F.size(path) - 1)["key"]), lambda s: F.trim(F.substring("whole", s.start + 1, s.size))), " "))

    up = F.get(F.filter("spans", lambda s: s.key == F.get("voted", F.size("voted") - 1)["key"]), F.lit(0))["up"]
    joined = joined.withColumn("_path", F.when(up.isNotNull(), F.slice("voted", F.lit(1), F.size("voted") - up)))
    joined = joined.withColumn("_voted", F.when(F.col("_path").isNotNull(), held("_path")))
    text = F.when(F.col("_voted") != "", F.col("_voted")).when(F.col("own").isNotNull(), held("own")).otherwise(F.col("whole"))
    path = F.when(F.col("_voted") != "", named("_path")).otherwise(named("own"))
    return joined.select("page_id", "url", text.alias("text"), path.alias("path")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; see ``extract``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "op4"))
