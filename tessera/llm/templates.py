"""Main text of web pages through templates deduced from the pages of each host.

A page becomes blocks of text, each with the path of elements that hold it. Tokens are the element paths of a page and its texts
in their paths. A token's occurrence vector over the pages of its host is kept as one number, the sum
over pages of a 64-bit hash of the page times the token's count there, which equal vectors share and others
do not; sums combine before any shuffle, so a host with a third of all pages is one row per token. Tokens of a host with equal
vectors form a class, valid if it spans two pages and has two tokens at least. Valid classes nest: the root class occurs
once on every page; any other brings an element of its own, or stands in an element of a valid class. Texts of nested classes are
the template's; a passage that articles share does neither, since their paragraphs differ in number, and is data.

Every page is read through its host's template: what the template's texts leave are slots. Slots that hold mostly links over the
host are menus. The article or main element is a hint: its slots are the main text if, over the host, they hold
a fifth of the characters in slots at least, else all slots are. Inside that element a text needs ``CERTAIN`` of the host's
pages, and ``LEAST`` of them, to be the template's. A page of which the template would leave nothing keeps all its slots (a host of copies).
Elements and names that mark menus, headers, footers, sidebars, notices, adverts, forms, comments and markup
are left out before, as their content may differ from page to page.

The template is left as sorted arrays of token hashes that workers map; pages are never shuffled.

Defined cases: null or empty html gives an empty text, a null url the host ''; unclosed, misnested and unknown elements are
read as browsers would place their text, and a tag without an end takes the rest with it; a page alone on its host has no
template: its article or main element decides, else links block by block; repeated rows are separate pages,
with equal texts; other columns are not read. Reading takes time in proportion to a page's length.
"""

from __future__ import annotations

import html
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import U64, keep, shared_path
from .kneser_ney import mounted, save
from .suffixes import dealt, mapped, positions

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
#: Attributes up to the end of a tag; a quote opens a value only behind an equals sign.
_ATTRIBUTES = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = {n: re.compile(f"</{n}(?=[\\s/>])", re.I) for n in "script style textarea title noscript iframe xmp noembed noframes".split()}
#: Elements whose content is never main text.
OUT = frozenset("nav aside footer form button select option label fieldset legend input textarea script style title noscript iframe template svg math object embed canvas audio video map dialog menu head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Parts of class, id and role names that mark what is around the main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside footer masthead comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations widget toolbar skip copyright disclaimer complementary contentinfo form".split()
)
#: Parts that may stand beside a mark in a name: "share-buttons" marks, "share-price" does not.
BESIDE = frozenset(
    "area bar block body bottom box button buttons center col column container content footer form global group header holder icon icons id inline inner item items js label layer left link links list main message middle mini module outer page panel post row right section site slot small space sticky text thread title top unit view wrap wrapper zone".split()
)
#: What an opening tag of these closes first, up to an element of the set.
CLOSES = {"li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",)))}
CLOSES = {k: (frozenset(v[0].split()), v[1]) for k, v in CLOSES.items()}
_P, _P_STOPS = frozenset(("p",)), frozenset("article section div li td th blockquote body main aside header footer nav form table button figure dd".split())
MAIN = frozenset(("article", "main"))


@dataclass
class Text:
    """A block: its text, the hash of its path, whether it lies in the main part or is marked as none of it, and characters inside links."""

    text: str
    path: int
    main: bool
    out: bool
    linked: int


def marks(name: str) -> bool:
    """Whether a class, id or role says what is around the main text: one part at least does, and the others go with it."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return any(p in MARKS for p in parts) and all(p in MARKS or p in BESIDE or p.isdigit() or len(p) == 1 for p in parts)


def named(attributes: str) -> tuple[bool, str, bool]:
    """Whether names mark an element as none of the main text, its class for its path, and whether its role is main."""
    out, name, main = False, "", False
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            out = True
        elif kind == "style":
            out |= "display:none" in value.replace(" ", "").lower()
        elif kind in ("class", "id", "role"):
            main |= kind == "role" and value == "main"
            out |= any(map(marks, value.split()))
            if kind == "class":
                name = value
    return out, name, main


class Reader:
    """Reads a page into ``blocks`` in order and, for each element path, its parent path and how often it occurs (``paths``)."""

    def __init__(self, page: str):
        self.blocks: list[Text] = []
        self.paths: dict[int, list[int]] = {}
        # each open element: name, path, within main, out
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.open: Counter[str] = Counter()
        self.held: list[str] = []
        self.linked = 0
        self.read(page)
        self.close()

    def close(self) -> None:
        """Ends the block of text that is being held."""
        if self.held:
            text = " ".join(html.unescape("".join(self.held)).split())
            if text:
                _, path, main, out = self.stack[-1]
                self.blocks.append(Text(text, path, main, out, self.linked))
            self.held.clear()
        self.linked = 0

    def pop(self, k: int) -> None:
        self.open.subtract(e[0] for e in self.stack[k:])
        del self.stack[k:]

    def pop_last(self, ends: frozenset[str], stops: frozenset[str]) -> None:
        """Closes the innermost open element of ``ends``, unless one of ``stops`` stands between."""
        if any(self.open[e] for e in ends):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in stops:
                    return
                if self.stack[k][0] in ends:
                    return self.pop(k)

    def read(self, page: str) -> None:
        at, end = 0, len(page)
        last = page.rfind(">")
        while at < end:
            mark = page.find("<", at)
            if mark != at:
                text = page[at : mark if mark >= 0 else end]
                self.held.append(text)
                if self.open["a"]:
                    self.linked += len(text)
                if mark < 0:
                    return
                at = mark
            follows = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                k = page.find("-->", at + 4)
                at = k + 3 if k >= 0 else end
            elif follows in ("!", "?") or follows == "/" and not _NAME.match(page, at + 1):
                k = page.find(">", at) if at < last else -1
                at = k + 1 if k >= 0 else end
            elif m := _NAME.match(page, at + 1):
                if at > last:
                    return
                k = _ATTRIBUTES.match(page, m.end()).end()
                if k >= end:
                    return
                name = m[1].lower()
                if follows == "/":
                    at = k + 1
                    self.ended(name)
                else:
                    at = self.started(name, page[m.end() : k], page, k + 1)
            else:
                self.held.append("<")
                self.linked += bool(self.open["a"])
                at += 1

    def ended(self, name: str) -> None:
        found = self.open[name]
        if name in BLOCK or found and self.stack[-1][3]:
            self.close()
        if found:
            k = len(self.stack) - 1
            while self.stack[k][0] != name:
                k -= 1
            self.pop(k)

    def started(self, name: str, attributes: str, page: str, at: int) -> int:
        """Opens an element; returns where reading goes on."""
        if name in BLOCK:
            self.close()
            if name in CLOSES:
                self.pop_last(*CLOSES[name])
            else:
                self.pop_last(_P, _P_STOPS)
        elif name == "br":
            self.held.append(" ")
        if name in VOID:
            return at
        _, path, main, out = self.stack[-1]
        marked, label, is_main = named(attributes) if attributes else (False, "", False)
        # a page's header; one inside the main part may hold the title
        away = name in OUT or (name == "header" and not main) or (marked and name not in MAIN and name not in ("html", "body") and not is_main)
        if away and not out and name not in BLOCK:
            self.close()
        if name in BLOCK or away:
            new = xxh64_intdigest(f"{path}/{name}.{label}")
            seen = self.paths.setdefault(new, [path, 0])
            seen[1] += 1
            path = new
        if name in RAW:
            found = RAW[name].search(page, at)
            tail = page.find(">", found.end()) if found else -1
            return tail + 1 if tail >= 0 else len(page)
        if not attributes.endswith("/") or name in BLOCK or name == "a":
            self.stack.append((name, path, main or name in MAIN or is_main, out or away))
            self.open[name] += 1
        return at


def parse(page: str) -> tuple[list[Text], dict[int, tuple[int, int]]]:
    """Blocks of a page in order, and for each element path its parent path and how often it occurs."""
    r = Reader(page)
    return r.blocks, {k: (v[0], v[1]) for k, v in r.paths.items()}


HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def text_token(host: int, b: Text) -> int:
    return xxh64_intdigest(f"{host}|{b.path}|{b.text}")


def path_token(host: int, path: int) -> int:
    return xxh64_intdigest(f"{host}|{path}")


@dataclass
class Token:
    """What a page has of a token: the token around, how often, and of its blocks outside marked elements characters, those in links and those in the main part."""

    parent: int
    count: int
    is_text: bool
    chars: int = 0
    linked: int = 0
    inside: int = 0


def page_tokens(page: str, host: int) -> dict[int, Token]:
    blocks, paths = parse(page)
    out = {path_token(host, p): Token(path_token(host, parent), n, False) for p, (parent, n) in paths.items()}
    for b in blocks:
        if b.out:
            continue
        around = path_token(host, b.path)
        token = out.setdefault(text_token(host, b), Token(around, 0, True))
        token.count += 1
        for t in (token, out.setdefault(around, Token(around, 1, False))):
            t.chars += len(b.text)
            t.linked += b.linked
            t.inside += len(b.text) if b.main else 0
    return out


TOKENS = "host long, token long, parent long, is_text boolean, vector long, pages long, chars long, linked long, inside long"
_LOW = (1 << 64) - 1


def tokens(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """One row for each token of a host: its occurrence vector, the number of pages that have it, and sums of characters."""
    source = pages.select(F.col(f"`{url}`").alias("u"), F.col(f"`{page}`").alias("h"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{url}`")).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[int, int], list] = {}
            for u, h, k in zip(*(c.to_pylist() for c in b.columns)):
                host = xxh64_intdigest(host_of(u))
                of_page = page_tokens(h or "", host)
                of_page[host] = Token(host, 1, False)
                weight = k & _LOW | 1
                for t, x in of_page.items():
                    row = found.setdefault((host, t), [x.parent, x.is_text, 0, 0, 0, 0, 0])
                    for i, v in enumerate((weight * x.count, 1, x.chars, x.linked, x.inside), 2):
                        row[i] += v
            long = lambda values: pa.array(np.array([v & _LOW for v in values], dtype=U64).view(np.int64))
            rows = list(zip(*found.values())) or [()] * 7
            columns = [long([k[0] for k in found]), long([k[1] for k in found]), long(rows[0]), pa.array(rows[1], type=pa.bool_()), *map(long, rows[2:])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TOKENS.split(", ")])

    wrapped = F.sum(F.col("vector").cast("decimal(38,0)"))
    low = F.pmod(wrapped, F.lit(str(2**64)).cast("decimal(38,0)"))
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "linked", "inside")]
    return source.mapInArrow(run, TOKENS).groupBy("host", "token").agg(F.first("parent").alias("parent"), F.first("is_text").alias("is_text"), low.alias("vector"), *sums)


#: Share of a host's pages that have a text of its template; inside the main part, and pages that must have it there.
SHARE, CERTAIN, LEAST = 0.5, 0.9, 5


def template(own: DataFrame, least_pages: int = 2, least_tokens: int = 2) -> DataFrame:
    """Tokens of valid classes of ``tokens()``: ``host, class, parent_class, root, size, elements, pages, host_pages, token, is_text, chars, linked, inside``; ``root`` says whether the class occurs once on every page."""
    own = own.where(F.col("pages") >= least_pages)
    classes = own.groupBy("host", F.col("vector").alias("class")).agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("is_text")).alias("elements")).where(F.col("size") >= least_tokens)
    valid = own.withColumnRenamed("vector", "class").join(classes, ["host", "class"])
    hosts = own.where("token = host").select("host", F.col("pages").alias("host_pages"), F.col("vector").alias("root_class"))
    parents = valid.where(~F.col("is_text")).select("host", F.col("token").alias("parent"), F.col("class").alias("parent_class"))
    return valid.join(hosts, "host").join(parents, ["host", "parent"], "left").withColumn("root", F.col("class") == F.col("root_class")).drop("root_class")


def template_texts(found: DataFrame) -> DataFrame:
    """The texts of nested classes that are common enough: ``host, token, chars, inside``."""
    pages, of = F.col("pages"), F.col("host_pages")
    nested = F.col("root") | (F.col("elements") > 0) | F.col("parent_class").isNotNull()
    common = F.when(F.col("inside") > 0, (pages >= CERTAIN * of) & (pages >= LEAST)).otherwise(pages >= SHARE * of)
    return found.where(F.col("is_text") & nested & common).select("host", "token", "chars", "inside")


@dataclass(frozen=True)
class Templates:
    """Where the sorted arrays are: texts of templates, slots, those of them that hold mostly links, hosts whose main text is not in the hinted element."""

    path: str
    parts: tuple[tuple[str, int], ...]

    def have(self, name: str, asked: list[int]) -> set[int]:
        h = np.array(sorted(set(asked)), dtype=U64)
        hit = np.zeros(len(h), dtype=bool)
        for p, s in dealt(h, dict(self.parts)[name]):
            hit[s] = positions(mapped(f"{self.path}/{name}-{p}.npy"), h[s])[1]
        return set(h[hit].tolist())


#: Hashes that a part of an array holds, about.
PART = 1_000_000


def save_hashes(found: DataFrame, hashes: Column, path: str, name: str) -> tuple[str, int]:
    """Writes the hashes in ranges of about ``PART``; returns the name and the number of ranges."""
    found = keep(found.select(hashes.alias("token")), name)
    parts = max(1, -(-found.count() // PART))

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        save(path, f"{name}-{int(key[0])}", np.sort(pdf["token"].to_numpy().view(U64)))
        return pd.DataFrame({"n": [len(pdf)]})

    part = F.expr(f"cast(shiftrightunsigned(token, 48) * {parts} div 65536 as int)")
    found.withColumn("part", part).groupBy("part").applyInPandas(write, "n long").agg(F.sum("n")).first()
    return name, parts


def deduced(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", path: str | None = None) -> Templates:
    """Deduces the templates of all hosts and writes what readers need of them."""
    path = mounted(path or shared_path(pages.sparkSession, "templates"))
    os.makedirs(path, exist_ok=True)
    own = keep(tokens(pages, key, url, page).where("pages > 1"), "tokens")
    texts = keep(template_texts(template(own)), "template-texts")
    slots = own.where("not is_text and chars > 0 and inside = 0")
    menus = slots.where("2 * linked > chars")
    sums = own.where("not is_text").groupBy("host").agg(F.sum("chars").alias("chars"), F.sum("inside").alias("inside"), F.sum(F.when(F.col("inside") == 0, F.col("linked")).otherwise(0)).alias("linked"))
    fixed = texts.groupBy("host").agg(F.sum("chars").alias("fixed"), F.sum("inside").alias("fixed_inside"))
    of = sums.join(fixed, "host", "left").na.fill(0, ["fixed", "fixed_inside"])
    # what the template and links leave; the share of it inside the hinted element
    wide = of.where("inside > 0 and 5 * (inside - fixed_inside) < chars - fixed - linked")
    token = F.col("token")
    return Templates(path, (save_hashes(texts, token, path, "texts"), save_hashes(slots, token, path, "slots"), save_hashes(menus, token, path, "menus"), save_hashes(wide, F.col("host"), path, "wide")))


def main_texts(pages: list[tuple[str, int]], known: Templates | None) -> list[str]:
    """The blocks of each (page, host) that its slots for main text hold, one to a line."""
    read = [(host, [b for b in parse(page)[0] if not b.out]) for page, host in pages]
    have = known.have if known else lambda name, asked: set()
    texts = have("texts", [text_token(h, b) for h, bs in read for b in bs])
    slots, menus = (have(name, [path_token(h, b.path) for h, bs in read for b in bs]) for name in ("slots", "menus"))
    wide = have("wide", [h for h, _ in read])

    def menu(host: int, b: Text) -> bool:
        """By its slot over the host; in a slot of one page alone by itself."""
        slot = path_token(host, b.path)
        return slot in menus if slot in slots else 2 * b.linked > max(1, len(b.text))

    out = []
    for host, blocks in read:
        inside = [b for b in blocks if b.main] if host not in wide else []
        asked = inside or [b for b in blocks if not menu(host, b)]
        left = [b for b in asked if text_token(host, b) not in texts]
        out.append("\n".join(b.text for b in left or asked))
    return out


def main_text(page: str, host: int, known: Templates | None = None) -> str:
    return main_texts([(page, host)], known)[0]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", path: str | None = None) -> DataFrame:
    """``key, url, text, n_chars`` of every row of ``pages``."""
    known = deduced(pages, key, url, page, path)
    source = pages.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{url}`").alias("__url"), F.col(f"`{page}`").alias("__page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = main_texts([(h or "", xxh64_intdigest(host_of(u))) for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist())], known)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["__id", "__url", "text", "n_chars"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"__id {kind}, __url string, text string, n_chars long").select(F.col("__id").alias(key), F.col("__url").alias(url), "text", "n_chars")
