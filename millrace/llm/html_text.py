"""Main text of web pages: a site's template is deduced from its pages, and what remains in its main slot extracted.

After ExAlg (Arasu and Garcia-Molina, 2003). Tokens are elements, told apart by their path from the root, and
words, told apart by the path of the element that they are in. Tokens with the same occurrence vector over the
pages of a host form an equivalence class. A class is part of the template if it is large and frequent
(MEMBERS, SUPPORT, SHARE) and valid: its tokens come in the same order on every page, as often as the class does. A
class that is not is split by path, and its parts are judged anew, so a word that has a template's vector by chance
takes down only what stands beside it. Paths make classes nest: all tokens of an element's own are inside it.

Blocks of text whose words are all template tokens are the template's. The rest is in slots. The main slot is the
template's innermost element that holds most of what remains, over all pages that have it, or the one that its author
marked as the article. Names of elements and classes decide only what else goes from it: menus, adverts, comments and the like.

Vectors are never gathered: each is summed up as the sum, mod 2^64, of a page's random number times
the token's occurrences on it, which adds up over any number of pages, part by part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

#: A class of the template has so many tokens, on so many pages of the host, and on so large a share of those that have the token's element.
MEMBERS, SUPPORT, SHARE = 2, 3, 0.8
#: Share of its pages' text that a slot must hold to be the main one; and share that one marked as the article must hold.
MAIN, MARKED = 0.6, 0.1

_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)|</?[a-zA-Z][^\s/>]*+{_ATTRIBUTES}(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""(?<=[\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?![^\s/>=])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their own end tag.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*>?", re.I) for n in "script style title textarea iframe xmp noembed noframes".split()}
_BLOCK = frozenset("address article aside blockquote body br canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening tag closes, up to the nearest of the stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = _BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary", "figcaption", "canvas"}
#: Elements that can be slots: those that hold blocks, not those that are blocks of text.
_HOLDS = frozenset("html body main article section div table tbody tr td center form".split())
_SKIP = frozenset("nav aside footer form head noscript template svg math object canvas audio video button select menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
#: Names of classes and ids: of what is not the article, of readers' comments, and of what frames or is the article.
_OTHER = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related recommended recommendations share sharing social footer header masthead pagination pager toolbar skip".split())
_TALK = frozenset("comment comments commentlist reply replies respond response responses disqus discussion discussions".split())
_OWN = frozenset("article content entry post story main body text with has layout wrapper wrap container page".split())
_ARTICLE = frozenset("article story entry post articlebody".split())
_MARK = 1 << 64


def hash_of(text: str) -> int:
    """A signed 64-bit hash."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7)
    return h - _MARK if h >> 63 else h


class _Element:
    """token: hash of the path from the root; each step is an element's name, class and id."""

    __slots__ = ("chars", "depth", "hidden", "label", "marked", "name", "out", "parent", "rank", "token")

    def __init__(self, name: str, label: str, parent: _Element | None, rank: int, hidden: bool):
        self.name, self.label, self.parent, self.rank, self.hidden = name, label, parent, rank, hidden
        self.token, self.depth = hash_of(f"{parent.token if parent else ''}/{name} {label}"), parent.depth + 1 if parent else 1
        self.marked = rank > 1 or parent is not None and parent.marked
        self.chars, self.out = 0, None

    def up(self) -> Iterator[_Element]:
        e: _Element | None = self
        while e is not None:
            yield e
            e = e.parent


_Block = tuple[str, _Element | None]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(tag)} if " " in tag or "\n" in tag or "\t" in tag else {}


def _named(label: str, names: frozenset[str]) -> bool:
    """Whether a class or id begins or ends with such a name, as in site-footer, and none of its parts says that it
    frames or is the article, as in content-with-sidebar."""
    for one in label.lower().split():
        parts = re.split(r"[-_]+", one)
        if (parts[0] in names or parts[-1] in names) and not _OWN.intersection(parts):
            return True
    return False


def parse(page: str) -> tuple[list[_Block], list[_Element]]:
    """A page's blocks, (text, innermost element), and all its elements, in page order. Never fails: tags that
    close nothing are passed over, open ones end where their parent does, and a cut tag is a tag."""
    stack: list[_Element] = []
    elements: list[_Element] = []
    blocks: list[_Block] = []
    run: list[str] = []
    at = 0

    def flush() -> None:
        if run:
            joined = "".join(run)
            run.clear()
            if said := " ".join((entities.unescape(joined) if "&" in joined else joined).split()):
                blocks.append((said, stack[-1] if stack else None))
                for e in stack:
                    e.chars += len(said)

    while m := _TOKEN.search(page, at):
        tag = m[0]
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        if tag[1] in "!?" or tag[1] == "/" and not tag[2:3].isalpha():
            if tag.startswith("<![CDATA["):
                run.append(entities.escape(tag[9:].removesuffix("]]>")))
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name in _BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if name not in _BLOCK and stack[i].name in _BLOCK and stack[i].name != "p":
                    break
            continue
        if name in _BLOCK:
            flush()
        if name in _ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name in _BLOCK:
                    break
        if name in _CLOSES:
            closed, stops = _CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in closed:
                    del stack[i:]
                    break
                if stack[i].name in stops:
                    break
        if name in _VOID:
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            # Without an end tag a script or style goes to the end of the page; of the others only the tag goes.
            at = end.end() if end else len(page) if name in ("script", "style") else at
            continue
        got = _attributes(tag)
        role, prop = got.get("role", "").lower(), got.get("itemprop", "").lower()
        label = f"{got.get('class', '')} {got.get('id', '')}".strip()
        rank = 3 if name == "article" or "article" in role or prop == "articlebody" else 2 if name == "main" or role == "main" else 1 if _ARTICLE.intersection(re.split(r"[-_\s]+", label.lower())) else 0
        hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "") or role in _ROLES
        e = _Element(name, label, stack[-1] if stack else None, rank, hidden)
        elements.append(e)
        if not tag.endswith("/>") or name in _BLOCK:
            stack.append(e)
    if at < len(page):
        run.append(page[at:])
    flush()
    whole = sum(len(said) for said, _ in blocks)
    marked = {id(x) for e in elements if e.rank > 1 for x in e.up()}
    for e in elements:  # parents come before what they hold
        skip = e.hidden or e.name in _SKIP or e.name == "header" and not any(x.rank >= 3 for x in e.up())
        # Some sites put the whole page into a form.
        skip = skip and not (e.name == "form" and not e.hidden and (id(e) in marked or e.chars > 0.8 * whole))
        e.out = skip or e.parent is not None and e.parent.out
    return blocks, elements


def _shown(blocks: Iterable[_Block]) -> Iterator[_Block]:
    """Blocks outside menus and the like."""
    return (b for b in blocks if b[1] is None or not b[1].out)


@lru_cache(200_000)
def word_token(path: int, word: str) -> int:
    return hash_of(f"{path} {word}")


def _path(e: _Element | None) -> int:
    return e.token if e is not None else 0


def _tokens(blocks: Iterable[_Block], elements: Iterable[_Element], paths: Collection[int] | None = None) -> Iterator[tuple[int, int]]:
    """(token, path) of elements and of shown words, of these paths if they are given; (0, 0) stands for the page as what
    holds text outside all elements. Words in an article or main element are the article's own, so they are no tokens."""
    shown = list(_shown(blocks))
    if any(e is None for _, e in shown):
        yield 0, 0
    for e in elements:
        yield e.token, e.token
    for said, e in shown:
        path = _path(e)
        if (paths is None or path in paths) and not (e is not None and e.marked):
            for w in said.split():
                yield word_token(path, w), path


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host, path and token, sums over the pages of a task: pages and vector, and the most occurrences."""
    sums: dict[tuple[int, int, int], list[int]] = {}
    names = ["host", "path", "token", "pages", "vector", "most"]

    def flush() -> pa.RecordBatch:
        n, keys, values = len(sums), list(sums), list(sums.values())
        signed = (*(np.fromiter((k[i] for k in keys), np.int64, n) for i in range(3)), *(np.fromiter((v[i] for v in values), np.int64, n) for i in (0, 1, 2)))
        sums.clear()
        return pa.RecordBatch.from_arrays(list(map(pa.array, signed)), names=names)

    for batch in batches:
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
            page = page.as_py() or ""
            host, number = hash_of(host_of(url)), hash_of(f"{url}\n{page}")
            for (token, path), n in Counter(_tokens(*parse(page))).items():
                s = sums.setdefault((host, path, token), [0, 0, 0])
                s[0] += 1
                s[1] = ((s[1] + n * number + (1 << 63)) % _MARK) - (1 << 63)
                s[2] = max(s[2], n)
            if len(sums) > 150_000:
                yield flush()
    yield flush()


def _sequences(found: Iterable[tuple[int, int]], classes: dict[int, int]) -> dict[tuple[int, int], list[int]]:
    """Of the tokens with a class, in page order: those of each class, (class, 0), and of each class and path."""
    out: dict[tuple[int, int], list[int]] = {}
    for token, path in found:
        if (c := classes.get(token)) is not None:
            out.setdefault((c, 0), []).append(token)
            out.setdefault((c, path), []).append(token)
    return out


def order_of(sequence: list[int]) -> int | None:
    """The hash of the order in which a class's tokens come; None if they don't come in the same order each time."""
    n = len(set(sequence))
    return hash_of(" ".join(map(str, sequence[:n]))) if sequence == sequence[:n] * (len(sequence) // n) else None


def _is_template(said: str, path: int, known: set[int] | dict[int, int]) -> bool:
    return all(word_token(path, w) in known for w in said.split())


def _see_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages with candidates tell: kind 0, for each host and class, and class and path: least and most of the
    hashes of orders (null if some page has none) and tokens; kind 1, for each host and element that can be a slot: the most
    often it is on a page, its pages, its text that is not all candidates, and that of its pages, then all of both, rank and depth."""
    orders: dict[tuple[int, int, int], list] = {}
    slots: dict[tuple[int, int], list[int]] = {}
    names = ["kind", "host", "a", "b", "low", "high", "n", "fresh", "fresh_all", "chars", "all", "rank", "depth"]

    def flush() -> pa.RecordBatch:
        rows = [(0, *k, *v, 0, 0, 0, 0, 0, 0) for k, v in orders.items()] + [(1, h, t, 0, most, most, *rest) for (h, t), (most, *rest) in slots.items()]
        orders.clear()
        slots.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

    for batch in batches:
        known: dict[int, tuple[dict[int, int], set[int]]] = {}  # of the batch's hosts
        for i, (host, page) in enumerate(zip(batch.column("h").to_pylist(), batch.column("html"), strict=True)):
            blocks, elements = parse(page.as_py() or "")
            if host not in known:
                tokens, vectors, paths = (batch.column(c)[i].as_py() or () for c in ("tokens", "vectors", "paths"))
                known[host] = dict(zip(tokens, vectors, strict=True)), set(paths)
            classes, paths = known[host]
            for (c, p), sequence in _sequences(_tokens(blocks, elements, paths), classes).items():
                o = order_of(sequence)
                s = orders.setdefault((host, c, p), [o, o, 0])
                s[0], s[1] = (None, None) if o is None or s[0] is None else (min(s[0], o), max(s[1], o))
                s[2] = max(s[2], len(set(sequence)))
            fresh: Counter[int] = Counter()
            chars: Counter[int] = Counter()
            for said, e in _shown(blocks):
                new = 0 if _path(e) in paths and _is_template(said, _path(e), classes) else len(said)
                for token in [None, *(x.token for x in e.up())] if e is not None else [None]:
                    fresh[token] += new
                    chars[token] += len(said)
            seen = Counter(e.token for e in elements if e.name in _HOLDS and not e.out)
            about = {e.token: (e.rank, e.depth) for e in elements}
            for token, n in seen.items():
                s = slots.setdefault((host, token), [0, 0, 0, 0, 0, 0, *about[token]])
                s[0] = max(s[0], n)
                for i, more in enumerate((1, fresh[token], fresh[None], chars[token], chars[None]), 1):
                    s[i] += more
            if len(slots) + len(orders) > 100_000:
                yield flush()
    yield flush()


def templates(pages: DataFrame, scratch: Scratch, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each host of pages (h: its hash): slots, the tokens of elements that hold the main text, the best first, and
    words, the template's word tokens, sorted.

    A slot is once on each page that has it, on two pages at least where the host has more than one. Of those that hold MAIN of
    their pages' text that is not template, or of all of it if they are named as an article, or MARKED of it if they are article or
    main elements, those marked come first, then the innermost. Only what a host's template consists of is gathered by host; counts are not.
    """
    own = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    counted = own.mapInArrow(_count_tokens, "host long, path long, token long, pages long, vector long, most long")
    wide = "decimal(38,0)"
    vector = F.pmod(F.sum(F.col("vector").cast(wide)), F.lit(str(_MARK)).cast(wide))
    tokens = counted.groupBy("host", "path", "token").agg(F.sum("pages").alias("pages"), vector.alias("v"), F.max("most").alias("most")).where(F.col("pages") >= SUPPORT)
    tokens = scratch.keep(tokens.withColumn("vector", F.xxhash64(F.col("v").cast("string"), "pages")).drop("v"))
    of_path = tokens.where("token = path").select("host", "path", F.col("pages").alias("of"))
    many = tokens.join(of_path, ["host", "path"]).where(F.col("pages") >= SHARE * F.col("of"))
    size = many.groupBy("host", "vector").agg(F.count("*").alias("n")).where(F.col("n") >= MEMBERS).select("host", "vector")
    many = scratch.keep(many.join(size, ["host", "vector"]).select("host", "path", "token", "vector"))
    candidates = scratch.keep(many.groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list("vector").alias("vectors"), F.collect_set(F.when(F.col("token") != F.col("path"), F.col("path"))).alias("paths")).withColumnRenamed("host", "h"))
    seen = with_host(own).join(candidates, "h", "left").select("h", "html", "tokens", "vectors", "paths")
    seen = scratch.keep(seen.mapInArrow(_see_pages, "kind long, host long, a long, b long, low long, high long, n long, fresh long, fresh_all long, chars long, all long, rank long, depth long").repartition("kind", "host", "a", "b"))
    orders = seen.where("kind = 0").groupBy("host", F.col("a").alias("vector"), F.col("b").alias("path"))
    valid = orders.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.col("low").isNull()).alias("odd"), F.max("n").alias("n")).where(F.col("n") >= MEMBERS).where("low = high and not odd")
    valid = scratch.keep(valid.select("host", "vector", "path"))
    words = many.where("token != path")
    whole = words.join(valid.where("path = 0").drop("path"), ["host", "vector"], "left_semi")
    parts = words.join(valid.where("path != 0"), ["host", "vector", "path"], "left_semi")
    words = whole.select("host", "token").union(parts.select("host", "token")).groupBy("host").agg(F.array_sort(F.collect_set("token")).alias("words"))
    slots = seen.where("kind = 1").groupBy("host", F.col("a").alias("token")).agg(F.max("high").alias("most"), *(F.sum(c).alias(c) for c in ("n", "fresh", "fresh_all", "chars", "all")), F.max("rank").alias("rank"), F.max("depth").alias("depth"))
    slots = scratch.keep(slots.where("most = 1"))
    site = slots.groupBy("host").agg(F.max("n").alias("site"))
    most = F.when(F.col("rank") > 1, MARKED).when(F.col("rank") > 0, MAIN)  # of all text, repeated or not
    slots = slots.join(site, "host").where("n >= least(2, site) and chars > 0").where((F.col("fresh") >= MAIN * F.col("fresh_all")) & (F.col("fresh") > 0) | (F.col("chars") >= most * F.col("all")))
    order = F.struct(-F.col("rank"), -F.col("depth"), -F.col("chars"), "token")
    slots = slots.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["token"]).alias("slots"))
    return scratch.keep(slots.join(words, "host", "full").withColumnRenamed("host", "h"))


def with_host(pages: DataFrame, url_col: str = "url", out: str = "h") -> DataFrame:
    """pages with the hash of their url's host."""

    @F.pandas_udf("long")
    def host(url: pd.Series) -> pd.Series:
        return pd.Series([hash_of(host_of(u)) for u in url], dtype="int64")

    return pages.withColumn(out, host(F.col(url_col)))


def _left(blocks: list[_Block], roots: list[_Element]) -> list[_Block]:
    """Blocks of a slot without what its names tell to be none of the article's. A part so named stays if it holds most of
    the slot; readers' comments stay only if there is nothing else."""
    inside = {id(r) for r in roots}
    above = {id(x) for r in roots for x in r.up()}
    whole = sum(len(said) for said, _ in blocks)
    verdict: dict[int, int] = {}

    def kind(e: _Element) -> int:
        """0: the article's, 1: other, 2: comments; by the outermost that says so below the slot's root."""
        if id(e) in above:
            return 0
        if id(e) not in verdict:
            up = kind(e.parent) if e.parent is not None and id(e) not in inside else 0
            verdict[id(e)] = up or (2 if _named(e.label, _TALK) else 1 if _named(e.label, _OTHER) and 2 * e.chars < whole else 0)
        return verdict[id(e)]

    kinds = [kind(e) if e is not None else 0 for _, e in blocks]
    return [b for b, k in zip(blocks, kinds, strict=True) if not k] or [b for b, k in zip(blocks, kinds, strict=True) if k != 1] or blocks


def extract(page: str | None, slots: list[int] | None = None, words: set[int] | None = None) -> str:
    """The main text of a page: what the template leaves of the first of the site's slots that the page has. A page that has
    none is judged by its own marks, then by where most of its text is. What the author marked as the article is
    the article, repeated text included; and where all of a slot is template, as on sites of copies, it is kept."""
    blocks, elements = parse(page or "")
    shown = list(_shown(blocks))
    if not shown:
        return ""
    there = {e.token: e for e in elements if not e.out}
    main = next((there[s] for s in slots or () if s in there), None)
    if main is not None:
        roots = [main]
    else:
        strong = max((e.rank for e in elements if e.rank > 1 and not e.out and e.chars), default=0)
        most = [e for e in elements if e.name in _HOLDS and not e.out and e.chars >= MAIN * sum(len(said) for said, _ in shown)]
        roots = [e for e in elements if e.rank == strong and not e.out and e.chars] if strong else most[-1:]
    ids = {id(r) for r in roots}
    inside = [b for b in shown if b[1] is not None and any(id(x) in ids for x in b[1].up())] if roots else shown
    fresh = [b for b in inside if not words or any(r.rank for r in roots) or not _is_template(b[0], _path(b[1]), words)] or inside
    return " ".join(said for said, _ in _left(fresh, roots))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of pages, with text (empty if there is none).

    Null or empty html: empty text. Null or odd url: all such pages are one nameless host's. Repeated rows
    count as pages each and come out alike. A site with one page is judged by that page. Very long pages are taken whole.
    Empty table: no rows. A column named text is replaced.

    A site's template is a list of slots and words. The templates are joined to the pages by host; Spark broadcasts them
    where they are below the session's limit, and otherwise splits a host that holds much of the table.
    """
    scratch = Scratch(pages.sparkSession, "templates")
    found = templates(pages, scratch, url_col, html_col).select(F.col("h").alias("__host"), F.col("slots").alias("__slots"), F.col("words").alias("__words"))

    @F.pandas_udf("string")
    def text(page: pd.Series, host: pd.Series, slots: pd.Series, words: pd.Series) -> pd.Series:
        known: dict[int, set[int]] = {}  # of the batch's hosts
        out = []
        for p, h, s, w in zip(page, host, slots, words, strict=True):
            if h not in known:
                known[h] = set(w.tolist()) if w is not None else set()
            out.append(extract(p, None if s is None else s.tolist(), known[h]))
        return pd.Series(out, dtype=object)

    own = pages.drop("text")
    joined = with_host(own, url_col, "__h").join(found, F.col("__h") == F.col("__host"), "left")
    return joined.withColumn("__text", text(F.col(html_col), F.col("__h"), F.col("__slots"), F.col("__words"))).select(*own.columns, F.col("__text").alias("text"))
