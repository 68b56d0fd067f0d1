"""Main text of web pages by site template removal.

A page is read as a list of text blocks, each inside a chain of block elements.
Element subtrees are hashed twice: their tags and texts (links left out, numbers
in short texts alike), and their slot, the chain of elements from the page's root.  Spark
counts per host on how many different pages each subtree occurs, and, of slots
that pages fill once, how much of what they hold is said on other pages too.  Subtrees that recur on enough
of the host's pages are deleted, and so is all that stands in a slot whose
contents mostly recur (a menu or advert that is drawn from a set).  Where a
page marks its article (article or main), only that is kept, and its paragraphs
and headings are never counted as a template: shared prose is content.

Counting can't see what the extract must lack on hosts of one or two pages, so
elements that say what they are (nav, footer, aside, form, class "ad", role
"banner", ...) go as well.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from . import shared

#: A subtree is a template from this share of a host's different pages on, which is taken to be at least the first and at most the second number.
SHARE, MIN_PAGES, ENOUGH_PAGES = 0.3, 3, 8
#: A slot is a template's if it is on so many different pages, and this share of its subtrees recur on another page.
SLOT_PAGES, SLOT_SHARE = 4, 0.5
#: Numbers are alike in texts of so many letters at most ("Page 3 of 9").
FEW_LETTERS = 16
#: Templates (8 bytes each) that are broadcast at most.
BROADCAST_MARKS = 1_000_000

# Element names.
_RAW = "script|style|noscript|template|iframe|textarea|title|xmp|noembed|noframes|svg|math|object|canvas|select|datalist|audio|video"
_DROPPED = frozenset("head nav header footer aside form menu dialog button fieldset label".split())
_BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address hgroup center details summary hr search".split()
) | _DROPPED
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Start tags that end an open element of the second set, looked for up to the third.
_ENDS = {
    **{t: (frozenset(["p"]), frozenset()) for t in _BLOCKS},
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
}
#: Words in class or id that tell what an element is for.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox adsense sponsor sponsored sponsors promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies reply "
    "share sharing social related recommended recommendations widget pagination pager toolbar skip".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>.*?(?:</\1\s*+[^>]*+>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER, _LETTER = re.compile(r"\d+"), re.compile(r"[^\W\d_]")
_CLASS = re.compile(r"""\sclass\s*=\s*["']?([^"'>]*)""", re.I)
_HOST = re.compile(r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    """Lower-case host without www. and port; '' if there is none."""
    m = _HOST.match(url or "")
    return m[1].lower().removeprefix("www.") if m else ""


def _unwanted(tag: str, attrs: str, in_root: bool) -> bool:
    if tag in _DROPPED:
        return not (tag == "header" and in_root)  # an article's own header holds its heading
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs, re.I):
        return True
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            said = {w.lower() for w in [*_PARTS.findall(value), *re.split(r"[^a-zA-Z]+", value)]}
            if _MARKS & said - ({"header"} if in_root else set()):
                return True
        elif name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Prefix:
    """Prefix hashes of a sequence: any range's hash in constant time."""

    base, mod = 0x5DEECE66D1234567, (1 << 127) - 1

    def __init__(self) -> None:
        self.sums = [0]

    def add(self, item: str) -> None:
        h = int.from_bytes(hashlib.blake2b(item.encode("utf-8", "replace"), digest_size=15).digest(), "little")
        self.sums.append((self.sums[-1] * self.base + h) % self.mod)

    def of(self, first: int) -> int:
        """Of all items from the first on."""
        return (self.sums[-1] - self.sums[first] * pow(self.base, len(self.sums) - 1 - first, self.mod)) % self.mod


def parse(page: str, rules: bool = True):
    """Blocks (text, unwanted, in the article, in an article's header but no heading), subtrees (first, last, hash, slot, prose in the article), article found.

    rules: elements' names and attributes tell what is unwanted and what the article is.
    """
    blocks: list[tuple[str, bool, bool, bool]] = []
    subtrees: list[tuple[int, int, int, int, bool]] = []
    # open elements: tag, unwanted, in article, in its header, heading, first block, place in the tags met, slot
    stack: list[tuple[str, bool, bool, bool, bool, int, int, str]] = [("", False, False, False, False, 0, 0, "")]
    tags, texts = _Prefix(), _Prefix()
    buf: list[str] = []
    rooted = False

    def flush() -> None:
        if buf:
            text = " ".join(entities.unescape("".join(buf)).split())
            buf.clear()
            if text:
                top = stack[-1]
                blocks.append((text, top[1], top[2], top[3] and not top[4]))
                texts.add(_NUMBER.sub("0", text) if len(text) < 40 and len(_LETTER.findall(text)) <= FEW_LETTERS else text)

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            tag, _, inside, _, _, first, met, slot = stack.pop()
            if len(blocks) > first and tag not in ("html", "body", "article", "main"):
                h = hashlib.blake2b(f"{tag} {tags.of(met)} {texts.of(first)}".encode(), digest_size=8)
                slot = hashlib.blake2b(slot.encode("utf-8", "replace"), digest_size=8)
                subtrees.append((first, len(blocks), int.from_bytes(h.digest(), "little"), int.from_bytes(slot.digest(), "little"), inside and tag in _PROSE))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buf.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and m[1].lower() in ("select", "textarea", "iframe"):
                buf.append(" ")
            continue
        tag = tag.lower()
        if m[2]:
            if tag in _BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
            continue
        if tag == "br":
            buf.append(" ")
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        attrs = m[4]
        if tag not in _BLOCKS:
            if tag in ("span", "a", "ins", "em", "b", "i", "strong", "font") or "=" not in attrs:
                continue
        flush()
        ends, stop = _ENDS.get(tag, (frozenset(), frozenset()))
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in stop or stack[depth][0] not in ends | {"p"}:
                break
            if stack[depth][0] in ends:
                close(depth)
        top = stack[-1]
        named = _CLASS.search(attrs) if "=" in attrs else None
        slot = f"{top[7]}>{tag}" + (f".{_NUMBER.sub('0', named[1])}" if named else "")
        root = rules and (top[2] or tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I)))
        bad = rules and (top[1] or _unwanted(tag, attrs, top[2]))
        rooted = rooted or root and not bad
        stack.append((tag, bad, root, top[3] or tag == "header" and root, top[4] or tag in _HEADINGS, len(blocks), len(tags.sums), slot))
        tags.add(tag)
    if at < len(page):
        buf.append(page[at:])
    close(1)
    flush()
    return blocks, subtrees, rooted


def _digest(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def _key(host: str, subtree: int) -> int:
    return int.from_bytes(hashlib.blake2b(host.encode() + subtree.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)


def _candidates(host: str, subtrees) -> list[tuple[int, int | None, int, int]]:
    """(key, slot's key, first, last) of the subtrees that may be templates; no slot where the page fills it more than once."""
    times = Counter(slot for _, _, _, slot, prose in subtrees if not prose)
    return [(_key(host, h), _key(host, slot) if times[slot] == 1 else None, first, last) for first, last, h, slot, prose in subtrees if not prose]


def _content(blocks, rooted: bool, deleted=frozenset()) -> str:
    return "\n".join(text for i, (text, bad, inside, head) in enumerate(blocks) if not bad and not head and (inside or not rooted) and i not in deleted)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", counting: bool = True, rules: bool = True) -> DataFrame:
    """A row per input row: id, url, text, n_chars.

    text: the kept blocks in page order, white space within a block (that of
    character references included) as one space, blocks joined by a newline;
    '' for null or empty html and where nothing is kept.  n_chars: its code
    points.  A subtree counts once for every different text of the page
    outside its own template, so that copies of one page are no template; a
    null url is the host ''.  Rows with equal ids are pages of their own.
    Other columns are not read.  counting, rules: whether templates are
    counted, and whether elements' names and attributes tell (for comparison).
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    dealt, _ = X.dealt(rows, X.text_bytes(pages, html_col), "id", "url", "html")

    def look(key, table):
        """Rows (b, host, key, slot, own) of subtrees, and a row without a key for every page."""
        out = set()
        for url, page in zip(table.column("url").to_pylist(), table.column("html").to_pylist(), strict=True):
            blocks, subtrees, rooted = parse(page or "", rules)
            said = [text.encode("utf-8", "replace") for text, *_ in blocks]
            site = host_of(url)
            host, own = _key(site, 0), _digest(_content(blocks, rooted).encode("utf-8", "replace"))
            out.add((host, None, None, own))
            sums = [0]  # of all blocks' digests: what a page says beside a subtree is a difference
            for text, (_, bad, *_) in zip(said, blocks, strict=True):
                sums.append(sums[-1] + (0 if bad else _digest(text)))
            for k, slot, first, last in _candidates(site, subtrees):
                rest = own if rooted else (sums[-1] - sums[last] + sums[first] + (1 << 63)) % (1 << 64) - (1 << 63)
                out.add((host, k, slot, rest))
        host, keys, slots, owns = zip(*out, strict=True) if out else ((),) * 4
        return pa.table({"b": pa.array([key[0].as_py()] * len(keys), pa.int32()), "host": pa.array(host, pa.int64()), "key": pa.array(keys, pa.int64()), "slot": pa.array(slots, pa.int64()), "own": pa.array(owns, pa.int64())})

    def cut(table, templates):
        gone_keys = set(templates.column("mark").to_pylist())
        texts = []
        for url, page in zip(table.column("url").to_pylist(), table.column("html").to_pylist(), strict=True):
            blocks, subtrees, rooted = parse(page or "", rules)
            gone = {i for k, slot, a, z in _candidates(host_of(url), subtrees) if k in gone_keys or slot in gone_keys for i in range(a, z)}
            texts.append(_content(blocks, rooted, gone).encode("utf-8", "replace").decode())
        return pa.table({"id": table.column("id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(np.array([len(t) for t in texts], np.int64))})

    if counting:
        found = shared.table(dealt.groupBy("b").applyInArrow(look, "b int, host long, key long, slot long, own long"))
        marks = shared.table(templates(found))
        few = marks.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS
        # back to the buckets: each gets the templates that it holds, however many the site has
        both = found.filter("key IS NOT NULL").select("b", F.explode(F.array("key", "slot")).alias("mark"))
        held = both.join(F.broadcast(marks) if few else marks, "mark", "left_semi").distinct()
    else:
        held = pages.sparkSession.createDataFrame([], "b int, mark long")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return dealt.groupBy("b").cogroup(held.groupBy("b")).applyInArrow(cut, schema).withColumnsRenamed({"id": id_col, "url": url_col})


def templates(found: DataFrame) -> DataFrame:
    """Keys of subtrees and slots (mark) that are templates, from rows (host, key, slot, own)."""
    hosts = found.filter("key IS NULL").groupBy("host", "own").agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    subtrees = found.filter("key IS NOT NULL")
    pages = subtrees.groupBy("key", "own").agg(F.max("host").alias("host")).groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.max("host").alias("host"))
    again = pages.filter("pages > 1")
    least = F.least(F.lit(ENOUGH_PAGES), F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("host_pages") * SHARE)))
    common = again.filter(F.col("pages") >= MIN_PAGES).join(hosts, "host").filter(F.col("pages") >= least).select(F.col("key").alias("mark"))
    once = subtrees.filter("slot IS NOT NULL").select("key", "slot", "own").join(again.select("key", F.lit(1).alias("again")), "key", "left")
    slots = once.groupBy("slot", "own").agg(F.max(F.coalesce("again", F.lit(0))).alias("again")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.avg("again").alias("share"))
    return common.unionByName(slots.filter((F.col("n") >= SLOT_PAGES) & (F.col("share") >= SLOT_SHARE)).select(F.col("slot").alias("mark"))).distinct()
