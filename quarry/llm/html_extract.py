"""HTML extraction by consensus host paths.

A page becomes runs of text, each with the container it stands in; a container is named by the hash of its generalised path of tags and
classes (digits dropped, no positions), made of its parent's hash and its own name, so pages of one layout agree on names at any depth. Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out by tag, and elements of any kind by role, visibility and names: a class or id counts when all
its words say furniture or where it stands, and an element that may be furniture stays if it holds most of the page's paragraphs or its article. On each page containers are scored by the
text of the paragraphs in them, halved for each level up, times the share that is not links; a page votes for its best one. Spark
sums the votes of all pages of a host; paths with ``SHARE`` of them win. Pages are then read again: the first winning path
that has text on the page gives the page's text; where none has, the page's own best container does.

Votes are grouped with map-side combine and a host has 1 / ``SHARE`` winners at most; the table of winners is broadcast only if it is
counted to be small. HTML itself is never exchanged unless that table is large.

Defined results: null or empty html: empty text; a null URL or one without a host is the host ""; text outside any tag counts as the body;
unclosed tags end with what encloses them; repeated rows are pages of their own; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, stored
from quarry.llm.url_filter import host_of

SHARE = 0.2

# A quoted value may have any length and hold ">"; a tag whose quote is never closed ends at the first ">".
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|button|audio|video)\b(?:(?>[^>\"']+|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*+\"|'[^']*+')*+|[^>]*)/?>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

CONTAINERS = frozenset("html head body div article main section aside nav header footer form table tbody thead tfoot tr td th ul ol dl dd li blockquote figure figcaption details dialog fieldset address center".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre br hr dt caption legend summary option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd td th blockquote figcaption".split())
#: Containers that a path doesn't name and that are never scored themselves.
PARTS = frozenset("tbody thead tfoot tr td th ul ol dl dd li blockquote figure figcaption table".split())
LISTS = ("ul", "ol", "table", "dl")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that name page furniture: of the first kind whatever it holds, of the second unless most of the page's text is in it.
_STRONG = re.compile(
    r"nav\w*|menus?|masthead|footer|sidebars?|aside|ads?|adverts?|advertis\w+|adsense|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletters?|subscri(?:be|ption)s?|signup|login|"
    r"comments?|commentlist|disqus|respond|replies|reactions?|breadcrumbs?|pagination|pager|skip\w*|hidden|outbrain|taboola"
)
_WEAK = re.compile(
    r"header|head|foot|side|promo\w*|banner|share|sharing|social|related|recommend\w*|morestories|trending|discussion|widgets?|toolbar|search\w*|forms?|tags|printonly|toc|copyright|legal|disclaimer"
)
#: Words that say where or how an element stands, beside which the others still count; any other word of over three letters, or a word that negates, makes another name of it.
_GENERIC = frozenset(
    "site page main global body left right center top bottom upper lower inner outer above below before after wrapper wrap container content box block area section list item items bar panel group grid cell column "
    "primary secondary tertiary post posts article articles entry story stories blog news button buttons link links icon icons label text title heading input field mobile desktop sticky fixed floating "
    "slot unit holder placeholder part module component region user users reader readers visitor facebook twitter google email latest recent popular similar read more most next previous theme default "
    "large small medium full wide thread form search banner".split()
)
_OTHERWISE = frozenset("has no not non with on off of for and to is as in by".split())
#: Words of which one, before a heading, names the article's own heading, and names of an article's body.
_ARTICLE = frozenset("article entry post story content blog main".split())
_BODY = re.compile(r"main|article|post|entry|story|hentry|(?:article|entry|post|story|main|page|blog|body)-?(?:content|body|text|main)|content-?(?:main|body)|articlebody")
#: Words that belong to an article's text when they stand inside it.
_LEGAL = re.compile(r"copyright|legal|disclaimer|toc")
_COMPOUNDS = (("pop-up", "popup"), ("sign-up", "signup"), ("more-stories", "morestories"), ("print-only", "printonly"), ("comment-list", "commentlist"))
_WANTED = re.compile(r"(?:^|[-_\s])(?:article\w*|content|main|post|entry|story|body|text|page|blog\w*)(?:$|[-_\s])", re.I)
_DIGITS = re.compile(r"\d+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _named_furniture(token: str, heading: bool, inside: bool) -> int:
    """2 or 1 if one name of an element says furniture of the first or second kind, else 0: all its words must be furniture or say where it stands."""
    parts = [w for w in re.split(r"[^a-z]+", token) if w]
    kinds = []
    for w in parts:
        if _STRONG.fullmatch(w):
            kinds.append(2)
        elif _WEAK.fullmatch(w) and not (heading and w in ("header", "head")) and not (inside and _LEGAL.fullmatch(w)):
            kinds.append(1)
        elif w in _OTHERWISE or (len(w) > 3 and w not in _GENERIC and not _WEAK.fullmatch(w)):
            return 0
    if not kinds or (max(kinds) == 1 and _ARTICLE & set(parts) and {"header", "head"} & set(parts)):
        return 0
    return max(kinds)


def _furniture(tag: str, named: dict[str, str], inside: bool) -> int:
    """2: an element that goes with all it holds; 1: one that goes unless most of the page's text is in it; ``inside``: within an article, whose own header stays."""
    if tag in DROPPED and not (tag == "header" and inside):
        return 2
    if tag in ("body", "html", "article", "main"):
        return 0
    if named.get("role", "").lower() in ROLES or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", ""):
        return 2
    words = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{named.get('class', '')} {named.get('id', '')}").lower()
    for apart, joined in _COMPOUNDS:
        words = words.replace(apart, joined)
    names = words.split()
    found = max((_named_furniture(n, tag in HEADINGS, inside) for n in names), default=0)
    return 0 if found == 1 and any(_BODY.fullmatch(n) for n in names) else found


def _is_body(named: dict[str, str]) -> bool:
    return any(_BODY.fullmatch(n) for n in f"{named.get('class', '')} {named.get('id', '')}".lower().split())


class Page:
    """A page's wanted text in runs (container, text, whether linked, whether in a paragraph), with its breaks as spaces.

    Containers are numbered as they come, the page itself is 0: ``parent``, ``name``, ``depth`` and ``path`` (the hash of the names from the outside in).
    """

    def __init__(self, page: str | None):
        self.parent, self.name, self.depth, self.path = [-1], [""], [0], [b""]
        self._number: dict[tuple[int, str], int] = {}
        self.runs: list[tuple[int, str, bool, bool]] = []
        self._within: list[int] = [-1]  # elements that may be furniture, by number: the one around them
        self._kept: set[int] = {0}
        if page:
            self._read(page)

    def container(self, parent: int, name: str) -> int:
        """The number of the container of that name in ``parent``; without a name it is ``parent`` itself."""
        if not name:
            return parent
        found = self._number.get((parent, name))
        if found is None:
            found = self._number[parent, name] = len(self.name)
            self.parent.append(parent)
            self.name.append(name)
            self.depth.append(self.depth[parent] + 1)
            self.path.append(hashlib.blake2b(self.path[parent] + name.encode(), digest_size=16).digest())
        return found

    def _read(self, page: str) -> None:
        page = page[: page.rfind(">") + 1] + page[page.rfind(">") + 1 :].partition("<")[0]  # a cut-off tag at the end is no text
        stack: list[tuple[str, int, bool, bool, int]] = []  # tag, container, dropped, in an article, number of the possible furniture
        places: dict[str, list[int]] = defaultdict(list)  # tag to its places in the stack
        node, dropped, linked, paragraph, inside, maybe, runs, articles = 0, False, False, False, False, 0, [], 0
        lost: list[str] = []  # an unwanted element that is no container, and those of its tag in it
        at = 0

        def settle():
            nonlocal node, dropped, inside, maybe
            node, dropped, inside, maybe = stack[-1][1:] if stack else (0, False, False, 0)

        def cut(depth: int):
            while len(stack) > depth:
                places[stack.pop()[0]].pop()
            settle()

        def retain(wanted):
            kept = [s for s in stack if wanted(s)]
            cut(0)
            for s in kept:
                places[s[0]].append(len(stack))
                stack.append(s)
            settle()

        for token in _TOKEN.finditer(page):
            if token.start() > at and not dropped and not lost:
                runs.append((maybe, (node, entities.unescape(page[at : token.start()]), linked, paragraph)))
            at = token.end()
            tag = (token[3] or "").lower()
            if not tag:
                continue
            closing = token[2] == "/"
            if tag in BREAKS:
                lost.clear()  # an inline element that is never closed ends with its block
            elif lost:
                if tag == lost[0] and closing:
                    lost.pop()
                elif tag == lost[0]:
                    lost.append(tag)
                continue
            named = _attributes(token[4]) if not closing and token[4] and not token[4].isspace() else {}
            if tag not in CONTAINERS and tag not in VOID and not closing and not dropped and named and _furniture(tag, named, inside):
                runs.append((maybe, (node, " ", linked, paragraph)))
                lost.append(tag)
                continue
            if tag == "a":
                linked = not closing
                continue
            if tag not in BREAKS:
                continue
            if not dropped:
                runs.append((maybe, (node, " ", linked, paragraph)))
            if tag in PARAGRAPHS:
                paragraph = not closing
            if tag not in CONTAINERS:
                continue
            linked = False
            if closing:
                if places[tag]:
                    cut(places[tag][-1])
                continue
            if tag in ("article", "main") and dropped and not any(places[t] for t in ("aside", "footer", "form")):
                retain(lambda s: not s[2])  # an unclosed menu or header doesn't swallow the article
            if tag == "body":
                retain(lambda s: s[0] == "html")
            if tag in ("li", "tr", "td", "th", "dd") and places[tag] and places[tag][-1] > max((places[t][-1] for t in LISTS if places[t]), default=-1):
                cut(places[tag][-1])  # these close their like
            kind = _furniture(tag, named, inside)
            if kind == 1 and not dropped:
                self._within.append(maybe)
                maybe = len(self._within) - 1
            if tag in ("article", "main") and not dropped:
                articles += 1
                if articles == 1 or tag == "main":
                    self._keep(maybe)
            name = "" if tag in PARTS or tag == "html" else _DIGITS.sub("", ".".join([tag, *sorted(named.get("class", "").split())]))
            places[tag].append(len(stack))
            stack.append((tag, self.container(node, name), dropped or kind == 2, inside or tag in ("article", "main") or _is_body(named), maybe))
            settle()
        if at < len(page) and not dropped and not lost:
            runs.append((maybe, (node, entities.unescape(page[at:]), linked, paragraph)))
        self._settle(runs)

    def _keep(self, maybe: int) -> None:
        while maybe not in self._kept:
            self._kept.add(maybe)
            maybe = self._within[maybe]

    def _settle(self, runs: list) -> None:
        """Possible furniture with more than half of the page's text in paragraphs is none; the rest of it goes."""
        under = [0] * len(self._within)
        for maybe, (_, text, linked, paragraph) in runs:
            under[maybe] += len(text.strip()) if paragraph and not linked else 0
        total = sum(under)
        for maybe in range(len(under) - 1, 0, -1):  # what stands around has a smaller number
            under[self._within[maybe]] += under[maybe]
        for maybe in range(1, len(under)):
            if 2 * under[maybe] > total:
                self._keep(maybe)
        gone = [False] * len(under)
        for maybe in range(1, len(under)):
            gone[maybe] = maybe not in self._kept or gone[self._within[maybe]]
        self.runs = [run if not gone[maybe] else (run[0], " ", False, False) for maybe, run in runs]

    def scores(self) -> list[float]:
        """Of each container: paragraphs' characters at it, halved for each level up, times the share outside links; hints double it."""
        n = len(self.name)
        direct, under, links, out = ([0.0] * n for _ in range(4))
        for node, text, linked, paragraph in self.runs:
            size = len(text.strip())
            under[node] += size
            if linked:
                links[node] += size
            else:
                direct[node] += size if paragraph else size * 0.5
        for node in range(n - 1, 0, -1):  # parents have smaller numbers
            under[self.parent[node]] += under[node]
            links[self.parent[node]] += links[node]
        for node in range(1, n):
            share, up = direct[node], node
            for _ in range(3):
                out[up] += share
                share, up = share / 2, self.parent[up]
                if up <= 0:
                    break
        for node in range(1, n):
            tag, *classes = self.name[node].split(".")
            hint = 2.0 if tag in ("article", "main") or _WANTED.search(" ".join(classes)) else 1.0 if tag != "body" else 0.5
            out[node] *= hint * (1 - links[node] / max(under[node], 1.0))
        return out

    def best(self) -> int:
        """The container with the highest score; ties go to the outer one, then to the first; the page itself if it has none with text."""
        scored = self.scores()
        chosen = max(range(len(scored)), key=lambda i: (scored[i], -self.depth[i], -i))
        return chosen if scored[chosen] > 0 else min(1, len(scored) - 1)

    def find(self, path: bytes) -> int | None:
        """The container with that path."""
        return self.path.index(path) if path in self.path else None

    def text_of(self, container: int) -> str:
        """The text in a container, white space collapsed."""
        inside = [False] * len(self.name)
        inside[container] = True
        for node in range(container + 1, len(self.name)):
            inside[node] = inside[self.parent[node]]
        return " ".join("".join(text if inside[node] else " " for node, text, _, _ in self.runs).split())

    def names(self, container: int) -> str:
        """The readable path, for reports."""
        out = []
        while container > 0:
            out.append(self.name[container])
            container = self.parent[container]
        return ">".join(reversed(out))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes) of all pages."""

    def scan(batches):
        for batch in batches:
            tally: dict = defaultdict(int)
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                found = Page(page.as_py())
                if found.runs:
                    tally[host, found.path[found.best()]] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in tally], pa.string()), pa.array([p for _, p in tally], pa.binary()), pa.array(tally.values(), pa.int64())], names=["host", "path", "votes"]
            )

    return pages.select("host", "html").mapInArrow(scan, "host string, path binary, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winners(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the paths with ``share`` of their host's votes, most first."""
    total = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    won = counted.join(total, "host").where(F.col("votes") >= share * F.col("total"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("n"), "path")))
    return won.groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.path").alias("paths"))


def extract(pages: DataFrame, share: float = SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, path), a row for each row of ``pages``."""
    named = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host")
    )
    won = stored(winners(stored(votes(named), "votes"), share), "winners")

    def scan(batches):
        for batch in batches:
            texts, used = [], []
            for page, paths in zip(batch.column("html"), batch.column("paths").to_pylist(), strict=True):
                found = Page(page.as_py())
                text, chosen = "", None
                for path in paths or ():
                    chosen = found.find(path)
                    if chosen is not None and (text := found.text_of(chosen)):
                        break
                if not text:
                    chosen = found.best()
                    text = found.text_of(chosen)
                texts.append(text)
                used.append(found.names(chosen))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())],
                names=["page_id", "url", "text", "n_chars", "path"],
            )

    id_type = pages.schema[id_col].dataType.simpleString()
    return named.join(broadcast_if_small(won), "host", "left").select("page_id", "url", "html", "paths").mapInArrow(
        scan, f"page_id {id_type}, url string, text string, n_chars long, path string"
    )


def op2_html_extract(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
