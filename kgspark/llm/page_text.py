"""Main text of web pages by template deduction from equivalence classes (operator 9).

1. Every page becomes the sequence of its element openings, each told apart by its path of containers and by class and
   id; inline markup takes no part in paths.
2. Over the pages of a host, tokens with the same occurrence vector form an equivalence class. The vector is carried as
   a count and an order-free hash, so that no task gathers a host. A class that occurs in enough of the pages, in one
   order, is valid; valid classes nest by path into the host's template.
3. The slots of the template are the texts its tokens enclose. Slots of menus, headers, footers, sidebars, notices,
   adverts, forms and comments are passed over by the markup of their path, and slots that one
   and the same text fills on most of the host's distinct pages. The rest of the main slot is the text.

Compare Arasu and Garcia-Molina, "Extracting Structured Data from Web Pages" (SIGMOD 2003).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import cut_lineage, map_columns
from .url_filter import url_parts

LEAST_PAGES = 8  # distinct pages of a host from which variation tells something
LEAST_SUPPORT = 0.3  # share of a host's pages that a template token occurs in
SAME = 0.5  # a slot that one text fills on more than this share of the distinct pages is template text
DEEPEST = 40  # containers a path names; what is below them goes by a hash of its full path
MOST_BROADCAST_ROWS = 50_000  # template rows that are broadcast; more are joined

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object select option button annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr "
    "math semantics mrow mi mn mo mtext mspace ms msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover".split()
)
OUTSIDE = frozenset("nav footer aside form head menu dialog".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
# Words in class, id and role that mark what is not the article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|nav|navbar|"
    r"navigation|menus?|menubar|breadcrumbs?|header|masthead|footer|foot|sidebars?|side|aside|complementary|contentinfo|"
    r"related|recommend(?:ed|ations)?|notices?|cookies?|consent|gdpr|popup|modal|overlay|alerts?|newsletter|subscribe|"
    r"subscription|signup|login|share|sharing|social|comments?|commentlist|disqus|respond|replies|reply|discussion|"
    r"reviews?|widgets?|search|pagination|pager|toolbar|skip|hidden)(?:$|[\s_-])"
)

# Inside the article a name says so much only when all its parts do, being such words or parts of a page.
MARKS_WITHIN = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion "
    "banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars notice notices cookie cookies "
    "consent gdpr popup modal newsletter subscribe subscription signup share sharing social comment comments commentlist "
    "disqus respond pagination pager toolbar widget widgets hidden related recommended recommendations".split()
)
PARTS_OF_PAGES = frozenset(
    "area bar block body bottom box button buttons call card cell col column container content copy cta element field form "
    "frame grid group head heading holder icons inner inline item items label large left link links list main message module "
    "outer panel posts pane placeholder region right row section slot small strip table text title top unit widget wrap "
    "wrapper zone js the by 0".split()
)


def marked_within(names: str) -> bool:
    """Whether a class, id or role, of those between blanks, marks an element of an article as no part of it."""
    for name in names.split():
        parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=0)", name) if p]
        if any(p in MARKS_WITHIN for p in parts) and all(p in MARKS_WITHIN or p in PARTS_OF_PAGES for p in parts):
            return True
    return False


_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_IN_ARTICLE = re.compile(r"(?:^|/)(?:article|main)(?:[.#@!/]|$)")


def _attributes(written: str) -> dict[str, str]:
    return {a.lower(): html.unescape(d or s or b).lower() for a, d, s, b in _ATTRIBUTE.findall(written)}


def _passed_over(written: str) -> bool:
    """Whether the attributes of an inline element mark its text as no part of any article."""
    if "=" not in written and "hidden" not in written:
        return False
    values = _attributes(written)
    names = " ".join(re.sub(r"\d+", "0", values[k]) for k in ("class", "id", "role") if k in values)
    return "hidden" in values or values.get("aria-hidden") == "true" or marked_within(names)


def walk(page: str) -> Iterator[tuple[str, str, bool]]:
    """``kind, path, text`` events of a page: ``open`` with the path of the element, ``text`` with the path of its
    container, ``break`` at the edges of blocks. Unclosed and stray tags are borne, at any depth."""
    stack: list[tuple[str, str, str]] = []  # element, path, the part of the path that is spelled out
    at, raw = 0, None
    passed: list[str] = []  # open inline elements from the first one that is marked on; their text is passed over

    def path() -> str:
        return stack[-1][1] if stack else ""

    def entered(name: str, step: str) -> tuple[str, str, str]:
        if len(stack) < DEEPEST:
            own = f"{path()}/{step}" if stack else step
            return name, own, own
        _, above, spelled = stack[-1]
        key = "~" + xxhash.xxh3_64_hexdigest(f"{above}/{step}".encode("utf-8", "replace"))
        key += "!" if outside(f"{above}/{step}") else ""
        if name in ("article", "main") and not _IN_ARTICLE.search(spelled):
            return name, f"{spelled}/{name}.{key}", f"{spelled}/{name}.{key}"
        return name, f"{spelled}/{key}", spelled

    while at < len(page):
        if raw is not None:  # up to the end tag nothing else counts
            end = re.compile(rf"</{raw}\b", re.I).search(page, at)
            at, raw = (end.start() if end else len(page)), None
            continue
        found = _TAG.search(page, at)
        start = found.start() if found else len(page)
        if start > at and not passed:
            yield "text", path(), page[at:start]
        if found is None:
            break
        at = max(found.end(), at + 1)
        if found.group(2) is None:
            continue
        name = found.group(2).lower()
        if found.group(1):
            if name == "br":
                yield "break", "", ""
            elif name in INLINE:
                if name in passed:
                    del passed[len(passed) - 1 - passed[::-1].index(name) :]
            elif name not in VOID:
                passed.clear()  # a block's end ends what was left open inside
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        break
                yield "break", "", ""
            continue
        if name in INLINE:
            if not found.group(3).endswith("/") and (passed or _passed_over(found.group(3))):
                passed.append(name)
            continue
        yield "break", "", ""
        if name in VOID:
            continue
        passed.clear()
        if name in RAW:
            raw = None if found.group(3).endswith("/") and name in ("svg", "math") else name
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if name in SIBLINGS and stack and stack[-1][0] in SIBLINGS[name]:
            stack.pop()
        values = _attributes(found.group(3))
        step = name + "".join(
            f"{sign}{'.'.join(sorted(v.split()))}" for sign, key in ((".", "class"), ("#", "id"), ("@", "role")) if (v := values.get(key))
        )
        if "hidden" in values or values.get("aria-hidden") == "true":
            step += "!"
        stack.append(entered(name, re.sub(r"\d+", "0", step.replace("/", "|"))))
        yield "open", path(), ""


@lru_cache(1 << 14)
def outside(path: str) -> bool:
    """Whether the markup of a path says that it is not the article."""
    inside = False
    for step in path.split("/"):
        name = re.split(r"[.#@!]", step, maxsplit=1)[0]
        if name in OUTSIDE or step.endswith("!") or (name == "header" and not inside):
            return True
        marks = re.sub(r"[.#@]", " ", step[len(name) :])
        if name in ("article", "main"):
            inside = True
        elif inside and marked_within(marks):
            return True
        elif not inside and name not in ("html", "body") and MARKED.search(marks):
            return True
    return False


def _clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def blocks(page: str) -> Iterator[tuple[str, str]]:
    """``path, text`` of the blocks of a page in order; a block ends where block markup begins or ends."""
    held: list[str] = []
    where = ""
    for kind, path, text in walk(page):
        if kind == "text":
            if held and path != where:
                yield where, "".join(held)
                held = []
            where = path
            held.append(text)
        elif held:
            yield where, "".join(held)
            held = []
    if held:
        yield where, "".join(held)


def _digest(before: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), before)


def _occurrences():
    """Per page and path: how often it opens, the place of its first opening among them, length and hash of its texts;
    with each the hash of what the page has outside menus and the like, which tells variations from copies."""

    def work(pages: list[str | None]) -> tuple[list[list], list[int]]:
        out, owners = [[], [], [], [], [], []], []
        for i, page in enumerate(pages):
            opened: dict[str, list] = {}
            variant = 0
            for kind, path, _ in walk(page or ""):
                if kind == "open":
                    opened.setdefault(path, [0, len(opened), 0, 0])[0] += 1
            for path, text in blocks(page or ""):
                if text := _clean(text):
                    if path in opened:
                        opened[path][2] += len(text)
                        opened[path][3] = _digest(opened[path][3], text)
                    if not outside(path):
                        variant = _digest(_digest(variant, path), text)
            for path, (n, first, size, digest) in opened.items():
                for column, value in zip(out, (path, n, first, size, digest - (1 << 63), variant - (1 << 63))):
                    column.append(value)
                owners.append(i)
        return out, owners

    return work


def templates(pages: DataFrame) -> DataFrame:
    """``host, path, main, static`` of the template tokens of each host of ``pages(page_id, host, html)``.

    ``main`` marks the main slot: the article or main element of the template, else its innermost token that encloses
    most of the text outside menus and the like. ``static`` marks slots with template text. A page listed twice counts
    once; pages without an id, or with the same one, are told apart by their content.
    """
    added = "path STRING, n INT, first INT, size BIGINT, digest BIGINT, variant BIGINT"
    keyed = pages.withColumn("page", F.xxhash64("page_id", "html"))  # ids may be null or clash
    seen = cut_lineage(map_columns(keyed, ["html"], _occurrences, added, ["page", "host"]).distinct())
    variants = seen.select("host", "variant").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("variants"))
    per_host = seen.groupBy("host").agg(F.approx_count_distinct("page", 0.02).alias("pages")).join(variants, "host")
    tokens = seen.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("support"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.sum("size").alias("size"),
    )
    filled = seen.where("size > 0").select("host", "path", "digest", "variant").distinct()
    texts = filled.groupBy("host", "path", "digest").agg(F.count(F.lit(1)).alias("n"))
    same = texts.groupBy("host", "path").agg(F.max("n").alias("same"))
    frequent = tokens.join(per_host, "host").where(F.col("support") >= LEAST_SUPPORT * F.col("pages"))
    likely = cut_lineage(frequent.join(same, ["host", "path"], "left"))
    valid = _ordered(likely, seen)
    nested = valid.groupBy("host").agg(F.collect_list(F.struct("path", "size", "same", "variants")).alias("tokens"))

    def decide(tokens: list[list[dict]]) -> tuple[list[list], list[int]]:
        paths, main, static, owners = [], [], [], []
        for i, rows in enumerate(tokens):
            chosen, still = template_roles(rows)
            for row in rows:
                paths.append(row["path"])
                main.append(row["path"] in chosen)
                static.append(row["path"] in still)
                owners.append(i)
        return [paths, main, static], owners

    return map_columns(nested, ["tokens"], lambda: decide, "path STRING, main BOOLEAN, static BOOLEAN", ["host"])


def _ordered(tokens: DataFrame, seen: DataFrame) -> DataFrame:
    """The tokens of valid classes: equal occurrence vectors, and one order of first openings on every page."""
    members = tokens.select("host", "path", "vector", "support")
    placed = seen.select("page", "host", "path", "first").join(members, ["host", "path"])
    order = Window.partitionBy("page", "host", "vector", "support").orderBy("first")
    ranked = placed.withColumn("rank", F.row_number().over(order))
    steady = ranked.groupBy("host", "path").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    return tokens.join(steady.where("low = high").select("host", "path"), ["host", "path"], "left_semi")


def template_roles(tokens: list[dict]) -> tuple[set[str], set[str]]:
    """Paths of the main slots and of the slots with template text, from the template tokens of one host."""
    inside = [t for t in tokens if not outside(t["path"])]
    named = [t["path"] for t in inside if re.match(r"(article|main)\b", t["path"].rpartition("/")[2])]
    main = {p for p in named if not any(p != o and p.startswith(o + "/") for o in named)}
    if not main and inside:
        def enclosed(path: str) -> int:
            return sum(t["size"] for t in inside if t["path"] == path or t["path"].startswith(path + "/"))

        total = sum(t["size"] for t in inside)
        deep = [t["path"] for t in inside if enclosed(t["path"]) >= 0.8 * total]
        main = {max(deep, key=lambda p: (p.count("/"), p))} if deep and total else set()
    held = [t for t in inside if any(t["path"] == m or t["path"].startswith(m + "/") for m in main)]
    static = {t["path"] for t in held if t["variants"] >= LEAST_PAGES and (t["same"] or 0) > SAME * t["variants"]}
    return main, static


def main_text(page: str | None, main: set[str], static: set[str]) -> str:
    """The text of a page under a template; a page that has none of the main slots is read by its markup alone."""
    found = [(p, t) for p, raw in blocks(page or "") if not outside(p) and (t := _clean(raw))]

    def within(path: str, slots: set[str]) -> bool:
        return any(path == s or path.startswith(s + "/") for s in slots)

    own = [(p, t) for p, t in found if within(p, main)]
    if not own:
        named = [(p, t) for p, t in found if re.search(r"(?:^|/)(?:article|main)(?:[.#@/]|$)", p)]
        own = named or found
    return " ".join(t for p, t in own if p not in static)


def _extracted(pages: list[str | None], slots: list[list[dict] | None]) -> list[list]:
    texts = []
    for page, rows in zip(pages, slots):
        main = {r["path"] for r in rows or () if r["main"]}
        texts.append(main_text(page, main, {r["path"] for r in rows or () if r["static"]}))
    return [texts, [len(t) for t in texts]]


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Blocks in page order, white space as one space, character references decoded; nothing is cut off. Null and empty
    pages have an empty text; a null url is a host of its own. Equal pages of a host count as one variation, so copies
    do not turn an article into template text. Repeated rows give repeated rows; other columns play no part.
    """
    host, _ = url_parts(F.coalesce("url", F.lit("")))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    found = cut_lineage(templates(hosted.select("page_id", "host", "html")).where("main OR static"))
    slots = found.groupBy("host").agg(F.collect_list(F.struct("path", "main", "static")).alias("slots"))
    if found.count() <= MOST_BROADCAST_ROWS:  # else a join by host, whose hot keys are split at run time
        slots = F.broadcast(slots)
    joined = hosted.join(slots, "host", "left")
    return map_columns(joined, ["html", "slots"], lambda: _extracted, "text STRING, n_chars BIGINT", ["page_id", "url"])
