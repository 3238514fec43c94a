"""Main text of web pages, by templates deduced from pages of one host.

A page is read as tokens: the path of each element (tags, with classes and ids), and each block of text at its path. Over
the pages of a host, tokens with the same occurrence vector (how often each page has them) make an equivalence class. A
class is valid if it is large and frequent: several tokens, on most of the host's pages. Valid classes of elements that
each page has once nest by their paths into the host's template; valid classes of text are its constant parts. What
remains are the slots, and the one of them that holds most of the text that is not constant is the page's main text: tags
(article, main) decide only between elements that all hold most of it. In the slot a text is a part of the template only
where nothing else ever stands, or if all of many different pages have it; a paragraph that several pages share is text. Near
copies count as one page.

Within it, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out, by tag or
by words of class, id or role. Pages whose host has no template (too few pages, or none alike), and pages without the
template's slot, are read by their tags alone.

Defined cases: a null html is empty and has an empty text; pages without a url are of one host, the empty one; truncated and
wrongly nested markup is read as far as it goes, in linear time and memory however deep; rows that repeat a page_id are pages of their own; an empty table has no
rows; extra columns are not looked at.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# a quote opens a string only right after "=", as in HTML
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+(?:>|\Z)|[^<]+|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg math canvas object audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend "
    "li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold main text, and those that don't unless they stand in the article.
LEFT_OUT = frozenset("nav aside footer form head button select label option dialog menu script style textarea noscript template iframe svg math canvas object audio video title".split())
LEFT_OUT_ABOVE = frozenset(["header"])
MAIN = ("article", "main")
#: Names of parts that aren't main text, and words that say nothing of a part. A class, id or role marks a part only if it
#: consists of such words, and not of the latter alone: "cookie-notice" and "post-comments" do, "share-price" doesn't.
WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr login menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promotion recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
WORDS_ABOVE = frozenset("header masthead topbar".split())
PLAIN = frozenset(
    "area article articles bar block body bottom box button buttons buttonbar center col column container content fixed global group inner item items left link links list main outer page panel post posts "
    "right row section site slot sticky story top unit wrap wrapper".split()
)
#: An open element that a start tag closes, up to the elements that hold it.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
CLOSING = frozenset().union(*CLOSES.values())
HOLDS = frozenset("body article section div ul ol table td th blockquote form nav aside main header footer dl details".split())
#: A template is deduced from hosts of at least so many pages, two of them different; tokens of it are on different pages, and on at least
#: this share of all; its classes have so many tokens.
LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 2, 0.5, 2
#: Near copies are one page to the deduction: pages of the same least hash of blocks of so many characters.
LONG_BLOCK = 80
#: In the slot, what stands beside other text is a part of the template only if all pages of the host have it, so many of
#: which are no near copies of each other.
LEAST_CONTENTS = 4
#: Elements deeper than this have the path of the one that deep; their text is read like any other.
MOST_DEEP = 256
#: The slot holds more than this share of the host's text that is not constant.
SLOT_SHARE = 0.5
#: Templates of up to so many bytes are broadcast; beyond, they meet the pages in a join on the host.
BROADCAST_BYTES = 8 << 20


SIGNS = {"class": ".", "id": "#", "role": "@"}


@functools.lru_cache(maxsize=4096)
def _marks(value: str) -> frozenset[str]:
    """out, if a name in value is that of a part that never is main text; above, if of one that is none outside articles."""
    found = set()
    for name in value.split():
        words = {x.lower() for x in PARTS.findall(name) if not x.isdigit()}
        if words & WORDS and words <= WORDS | PLAIN:
            found.add("out")
        elif words & WORDS_ABOVE and words <= WORDS | WORDS_ABOVE | PLAIN:
            found.add("above")
    return frozenset(found)


class Block:
    __slots__ = ("path", "text", "out", "main")

    def __init__(self, path: str, text: str, out: bool, main: int) -> None:
        self.path, self.text, self.out, self.main = path, text, out, main


def read(html: str | None) -> tuple[list[Block], Counter]:
    """A page's blocks of text in order, and how often each element path occurs. out: the block is no main text."""
    blocks: list[Block] = []
    paths: Counter = Counter()
    stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]  # tag, path, left out, in the main part (1) or an article (2)
    open_tags: Counter = Counter()
    gates: list[int] = []  # places of open elements that a start tag may close, or that hold them
    held: list[str] = []

    def cut(n: int) -> None:
        """Close all elements from place n on."""
        for tag, *_ in stack[n:]:
            open_tags[tag] -= 1
        del stack[n:]
        while gates and gates[-1] >= n:
            gates.pop()

    def close(tag: str) -> None:
        """Close the innermost element of a tag, and what it holds."""
        if open_tags[tag] > 0:
            n = len(stack) - 1
            while stack[n][0] != tag:
                n -= 1
            cut(n)

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                _, path, out, main = stack[-1]
                blocks.append(Block(path, text, out, main))
            held.clear()

    raw = ""
    for match in TOKEN.finditer(html or ""):
        token = match[0]
        name = NAME.match(token) if token[0] == "<" else None
        if not name:
            if not raw and not token.startswith(("<!", "<?")):
                held.append(token)
            continue
        tag, end = name[1].lower(), token[1] == "/"
        if raw:
            if end and tag == raw:
                raw = ""
                close(tag)
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            held.append(" ")
        if end:
            close(tag)
            continue
        for at in reversed(gates) if tag in CLOSING else ():
            open_ = stack[at][0]
            if tag in CLOSES.get(open_, ()):
                cut(at)
                break
            if open_ in HOLDS:
                break
        _, path, out, main = stack[-1]
        step, marks = tag, set()
        for key, value in ATTRIBUTE.findall(token, name.end()) if name.end() < len(token) - 1 else ():
            if (key := key.lower()) in SIGNS:
                value = value.strip("\"'")
                marks |= _marks(value)
                step += SIGNS[key] + ".".join(sorted(value.split()))
        main = 2 if tag == "article" else main or int(tag in MAIN or step.endswith("@main"))
        if tag in ("html", "body"):
            marks = set()
        out = out or tag in LEFT_OUT or "out" in marks or (not main and (tag in LEFT_OUT_ABOVE or "above" in marks))
        full = f"{path}/{step}" if len(stack) <= MOST_DEEP else path
        paths[full] += 1
        if tag in VOID or token.endswith("/>"):
            continue
        if tag in CLOSES or tag in HOLDS:
            gates.append(len(stack))
        open_tags[tag] += 1
        stack.append((tag, full, out, 0 if out else main))
        if tag in RAW:
            raw = tag
    flush()
    return blocks, paths


def _inside(blocks: list[Block]) -> Counter:
    """How much text that isn't left out stands in each element, whatever its depth."""
    chars: Counter = Counter()
    for b in blocks:
        if not b.out:
            chars[b.path] += len(b.text)
    out: Counter = Counter()
    for path, n in chars.items():
        while path:
            out[path] += n
            path = path.rpartition("/")[0]
    return out


def _copies(blocks: list[Block], content: int) -> int:
    """What near copies of a page share: the least hash of its long blocks, or else the page's own."""
    return min((_digest("", b.text) for b in blocks if not b.out and len(b.text) >= LONG_BLOCK), default=content)


def _digest(path: str, text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """Per host with a template: host, slot (the path of the element that holds the article, or null), constants (digests of
    text) and fixed, those at paths where nothing but constants stands, and those that all of many different pages have.

    pages: page_id, host, html. Occurrence vectors are compared by two sums of hashes of page and count, pre-aggregated per
    task, however many pages a host has; equal pages and near copies add up like others, but what only they have is no template. A
    template is no larger than 1 / LEAST_SHARE pages.
    """
    keyed = pages.select("host", F.xxhash64("page_id", "html").alias("page"), F.xxhash64("html").alias("content"), "html")
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("content", pa.int64()), ("path", pa.string()), ("at", pa.string()), ("digest", pa.int64()), ("n", pa.int32()), ("chars", pa.int64()), ("main", pa.bool_())])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, page, content, html in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                blocks, paths = read(html.as_py())
                content = _copies(blocks, content)
                out.append((name, page, content, "", "", 0, 1, 0, False))
                out.append((name, page, content, "", str(content), 0, 1, 0, False))  # one vector for each content
                inside = _inside(blocks)
                texts = Counter((b.path, b.text, b.out) for b in blocks if not b.main)
                for path, n in paths.items():
                    out.append((name, page, content, path, "", 0, n, inside[path], path.rpartition("/")[2].startswith(MAIN) or path.endswith("@main")))
                out.extend((name, page, content, "", path, _digest(path, text), n, 0 if left_out else n * len(text), False) for (path, text, left_out), n in texts.items())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 9, schema, strict=True)], schema=schema)

    found = keyed.mapInArrow(tokens, "host string, page bigint, content bigint, path string, at string, digest bigint, n int, chars bigint, main boolean")
    vectors = found.groupBy("host", "path", "at", "digest", "main").agg(
        F.count("*").alias("support"), F.sum("n").alias("total"), F.sum("chars").alias("chars"), (F.min("content") < F.max("content")).alias("differ"),
        *(F.sum(F.pmod(F.xxhash64("page", "n", F.lit(i)), F.lit(1 << 31))).alias(f"vector{i}") for i in (1, 2)),
    )
    vectors = stored(vectors, "page-tokens")
    vector = ["support", "total", "vector1", "vector2"]
    sizes = vectors.where("path = '' and digest = 0 and at = '' and differ").select(F.col("host").alias("__host"), F.col("support").alias("pages"))
    classes = vectors.where("(path <> '' or digest <> 0) and differ").groupBy("host", *vector).agg(F.count("*").alias("tokens"))
    enough = (F.col("pages") >= LEAST_PAGES) & (F.col("support") >= F.col("pages") * LEAST_SHARE)
    valid = classes.join(sizes, classes["host"] == sizes["__host"]).where(enough & (F.col("tokens") >= LEAST_TOKENS)).drop("__host", "pages", "tokens")
    members = stored(vectors.where("differ").join(valid, ["host", *vector]), "template-tokens")
    constants = members.where("digest <> 0")
    # what of an element's text is not constant
    above = F.expr("transform(sequence(2, greatest(2, size(split(at, '/')))), i -> array_join(slice(split(at, '/'), 1, i), '/'))")
    lost = constants.where("chars > 0").select("host", F.explode(above).alias("path"), "chars").groupBy("host", "path").agg(F.sum("chars").alias("lost"))
    elements = members.where("path <> '' and total = support").join(lost, ["host", "path"], "left").withColumn("own", F.col("chars") - F.coalesce("lost", F.lit(0)))
    most = elements.groupBy("host").agg(F.max("own").alias("most"))
    # of the elements that hold most of that: an article or main element, the innermost, the one with more text
    choice = F.struct("main", F.size(F.split("path", "/")).alias("depth"), "own", F.col("path").alias("slot"))
    slots = elements.join(most, "host").where(F.col("own") > F.col("most") * SLOT_SHARE).groupBy("host").agg(F.max(choice)["slot"].alias("slot"))
    everything = vectors.where("digest <> 0").groupBy("host", "at").agg(F.sum("total").alias("all"))
    contents = vectors.where("path = '' and digest = 0 and at <> ''").groupBy("host").agg(F.count("*").alias("contents")).where(F.col("contents") >= LEAST_CONTENTS)
    common = contents.join(sizes, F.col("host") == F.col("__host")).select("host", F.col("pages").alias("support"), F.lit(True).alias("common"))
    settled = constants.groupBy("host", "at").agg(F.sum("total").alias("of")).join(everything, ["host", "at"]).where(F.col("of") == F.col("all")).select("host", "at", F.lit(True).alias("fixed"))
    known = constants.join(settled, ["host", "at"], "left").join(common, ["host", "support"], "left")
    digests = known.groupBy("host").agg(F.collect_set("digest").alias("constants"), F.collect_set(F.when(F.col("fixed") | F.col("common"), F.col("digest"))).alias("fixed"))
    none = F.array().cast("array<bigint>")
    return slots.join(digests, "host", "full").select("host", "slot", *[F.coalesce(c, none).alias(c) for c in ("constants", "fixed")])


def main_text(html: str | None, slot: str | None = None, constants: frozenset[int] = frozenset(), fixed: frozenset[int] = frozenset()) -> str:
    blocks, paths = read(html)
    keep = [b for b in blocks if not b.out]
    inside = [b for b in keep if b.path == slot or b.path.startswith(f"{slot}/")] if slot and slot in paths else []
    if inside:
        # in the slot, only what stands where nothing but constants does, and only if it is the lesser part
        own = [b for b in inside if b.main or _digest(b.path, b.text) not in fixed]
        size = lambda part: sum(len(b.text) for b in part)
        keep = own if 2 * size(own) > size(inside) else inside
    else:
        # without a template's slot, tags decide
        most = max((b.main for b in keep), default=0)
        keep = [b for b in keep if b.main == most]
        # constant parts outside articles; what is all that a page has stays
        keep = [b for b in keep if _digest(b.path, b.text) not in constants] or keep
    return "\n\n".join(b.text for b in keep)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text and n_chars (code points)."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    pages = pages.withColumn("host", host(F.col("url")))
    found = stored(templates(pages), "templates").withColumnRenamed("host", "__host")
    size = found.agg(F.coalesce(F.sum((F.size("constants") + F.size("fixed")) * 8 + F.coalesce(F.length("slot"), F.lit(0)) + F.length("__host") + 64), F.lit(0))).first()[0]
    joined = pages.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, pages["host"] == found["__host"], "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[frozenset[int]]] = {}
        for batch in batches:
            texts = []
            for name, html, slot, *sets in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5), batch.column(6), strict=True):
                if name not in held:
                    if len(held) > 256:
                        held.clear()
                    held[name] = [frozenset(x.as_py() or ()) for x in sets]
                texts.append(main_text(html.as_py(), slot, *held[name]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return joined.select("page_id", "url", "host", "html", "slot", "constants", "fixed").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
