"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from templates. A token of a page is a tag in its place (the path of tags it
stands in, with their class, id and role), or a text block in its place. Tokens that occur equally
often on every page of the host share an occurrence vector and form an equivalence class; a class
that is large and on enough pages is valid, part of a template of all the host's pages or of some. A
text of a valid class whose own element belongs to the class too is nested in it: the template says
it. Other texts fill the template's slots. Within an article or main part all texts are the
article's: one that is the same on all pages cannot be told from copies of the article.

Occurrence vectors are never collected: a vector's fingerprint is the sum, over pages, of count times
a number drawn from the page, so partial sums of any split of a host's pages add up.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import stored, text_of

#: Fingerprints are sums modulo this prime, twice over.
PRIME = (1 << 31) - 1
#: A class is valid if it has so many tokens, on so many pages, and on so large a part of the host's
#: pages, which bounds what is sent for a host to a hundred pages' worth.
CLASS_TOKENS, CLASS_PAGES, CLASS_PART = 3, 3, 0.01
#: Of whatever class, a text block outside any article is template text if so large a part of the
#: host's pages, and so many of them, have it in the same place.
TEMPLATE_PART, TEMPLATE_PAGES = 0.6, 5

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
#: Start tags that end an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd".split()
)
NOT_CONTENT = frozenset("head nav header footer aside form menu button select dialog".split()) | RAW
#: Words in class, id and role of elements that may not be the article. They are a hint only: an element
#: that holds most of its pages' text on the host is content, whatever its name.
NOT_CONTENT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
    footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion reply
    related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget""".split()
)
#: Names that say what an element is, if they are made of nothing but one of these and the filling words:
#: readers' comments, notices and adverts. Such an element is not content beside any that is.
APART_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising comment comments consent cookie cookies disqus gdpr newsletter notice notices
    replies respond sponsored subscribe""".split()
)
FILLING_WORDS = frozenset("area banner bar block box container content form inner list message post reader section slot thread user wrap wrapper".split())
CONTENT = frozenset({"article", "main"})
#: Elements whose names hint at nothing: they hold the page.
WHOLE = CONTENT | {"html", "body"}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>[^<>"']*(?:(?:"[^"]*"|'[^']*')[^<>"']*)*)>|<[A-Za-z/!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLANKS = re.compile(r"\s+")


def apart(value: str) -> bool:
    """Whether a class, id or role value names the element as comments, a notice or an advert."""
    for name in value.split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words & APART_WORDS and words <= APART_WORDS | FILLING_WORDS:
            return True
    return False


def under(path: str, label: str) -> str:
    """The path of an element below another, as a digest: deep pages hold many, and long, paths."""
    return hashlib.blake2b(f"{path}/{label}".encode("utf-8", "replace"), digest_size=8).hexdigest()


def blocks(page: str) -> list[tuple]:
    """The page as read_blocks() gives it. Elements that are set apart by name are left out, unless the
    page has no other text. Where all that is read lies in what is no content, an article or main part
    in it is content after all: what it lies in was never closed."""
    found = read_blocks(page, False)
    if not any(t[0] == "text" and t[2] for t in found) and any(t[0] == "tag" and t[5] for t in found):
        found = read_blocks(page, True)
    if any(t[0] == "text" and t[2] and not t[4] for t in found):
        found = [t for t in found if not t[4]]
    return [(*t[:4], t[5]) if t[0] == "text" else t[:4] for t in found]


def read_blocks(page: str, unclosed: bool) -> list[tuple]:
    """The page as tokens in order: ("tag", path, in_content, hints, apart, lost) for start tags that make
    structure, and ("text", path, in_content, hints, apart, text) for text blocks. apart: within comments,
    notices or adverts; lost: an article or main part in what is no content. in_content is 2 within an article or main
    part, 1 outside one, 0 in what is no content. hints are the paths of the elements around it, itself included, that are
    named as something else. Character references are decoded and white space is one space; empty blocks
    are left out."""
    out = []
    stack: list[tuple[str, str, int, tuple, bool, bool]] = []  # name, path, in_content, hints, apart, inline
    path, state, hints, aside = "", 1, (), False
    opened: Counter = Counter()  # names on the stack, so that an end tag without its start costs nothing
    parts: list[str] = []

    def flush():
        if parts:
            text = BLANKS.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(("text", path, state, hints, aside, text))
            parts.clear()

    def back_to(size):
        nonlocal path, state, hints, aside
        while len(stack) > size:
            opened[stack.pop()[0]] -= 1
        _, path, state, hints, aside, _ = stack[-1] if stack else ("", "", 1, (), False, False)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if state:
                parts.append(text)
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br" or name not in INLINE:
                flush()
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                back_to(k)
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in INLINE:
            if name not in VOID:
                if any(apart((a or b or c).lower()) for _, a, b, c in ATTRIBUTE.findall(m["rest"])):
                    state = 0
                stack.append((name, path, state, hints, aside, True))
                opened[name] += 1
            continue
        flush()
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    back_to(k)
                    break
                if not stack[k][5]:
                    break
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            after = page.find(">", close.end()) if close else -1
            at = after + 1 if after >= 0 else end
            continue
        words, label = [], name
        for key, a, b, c in ATTRIBUTE.findall(m["rest"]):
            value = (a or b or c).lower()
            words += re.split(r"[^a-z]+", value)
            label += f"[{key.lower()}={re.sub(r'[0-9]+', '#', value)}]"
            aside = aside or name not in WHOLE and apart(value)
        path = under(path, label)
        lost = not state and name in CONTENT
        if (not state and not (lost and unclosed)) or name in NOT_CONTENT and not (name == "header" and state == 2):
            state = 0
        elif name in CONTENT:
            # An article among the comments is a comment.
            state = state if aside else 2
        elif name not in WHOLE and not NOT_CONTENT_WORDS.isdisjoint(words):
            hints = (*hints, path)
        stack.append((name, path, state, hints, aside, False))
        opened[name] += 1
        out.append(("tag", path, state, hints, aside, lost))
    flush()
    return out


def held(found: list) -> dict[str, tuple[int, int]]:
    """Of each path of an element named as something else: the characters of the page's text in it, and
    all. That is the text of the page's articles, if they have any outside such elements."""
    texts = [t for t in found if t[0] == "text" and t[2]]
    if any(t[2] == 2 and not t[3] for t in texts):
        texts = [t for t in texts if t[2] == 2]
    inside = {path: 0 for t in found for path in t[3]}
    for t in texts:
        for path in set(t[3]):
            inside[path] += len(t[4])
    total = sum(len(t[4]) for t in texts)
    return {path: (n, total) for path, n in inside.items()}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, path, text, state, f1, f2, n_pages, n, inside, total): for every token of a host the fingerprint of
    its occurrence vector, the pages that have it and how often it occurs; for tags named as something
    else also the sums of held(). text is the crc of a text block, null for tags. Blocks within an
    article are slots' contents and not tokens; so are those in what is no content."""

    def run(batches):
        found: dict[tuple, list[int]] = {}

        def taken():
            rows = [(*k, *v) for k, v in found.items()]
            found.clear()
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "path", "text", "state", "f1", "f2", "n_pages", "n", "inside", "total"])

        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                host, page = host.as_py(), page.as_py()
                drawn = zlib.crc32(page.encode()) * 2_654_435_761 + len(page)
                counts: dict[tuple, int] = {}
                tokens = blocks(page)
                named = held(tokens)
                for token in tokens:
                    if token[0] == "tag":
                        key = (host, token[1], None, token[2])
                    elif token[2] == 1:
                        key = (host, token[1], zlib.crc32(token[4].encode()), 1)
                    else:
                        continue
                    counts[key] = counts.get(key, 0) + 1
                for key, n in counts.items():
                    sums = found.setdefault(key, [0] * 6)
                    sums[0] = (sums[0] + drawn % PRIME * n) % PRIME
                    sums[1] = (sums[1] + (drawn >> 13) % PRIME * n) % PRIME
                    sums[2] += 1
                    sums[3] += n
                    if key[2] is None and key[1] in named:
                        sums[4] += named[key[1]][0]
                        sums[5] += named[key[1]][1]
                if len(found) > 200_000:
                    yield taken()
        yield taken()

    rows = pages.select("host", "page").mapInArrow(run, "host string, path string, text bigint, state int, f1 bigint, f2 bigint, n_pages bigint, n bigint, inside bigint, total bigint")
    mod = lambda c: F.pmod(F.sum(c), F.lit(PRIME)).alias(c)
    return rows.groupBy("host", "path", "text", "state").agg(mod("f1"), mod("f2"), F.sum("n_pages").alias("n_pages"), *(F.sum(c).alias(c) for c in ("n", "inside", "total")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, fixed, named): the template texts outside articles of each host as path, crc, and the pages of the
    class they are nested in; null instead of these for texts that are on most pages of the host. named has the paths of elements named as something
    else, where so many pages have them that these can tell, and whether they hold most of the text.

    Classes are tokens of equal fingerprints. A text is nested in its class if the tag of its path is
    of the same class: each time the element stands there, it says this text.
    """
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    tokens = stored(occurrences(pages).filter(F.col("n_pages") >= CLASS_PAGES).join(sizes, "host"))
    classes = tokens.groupBy("host", "f1", "f2").agg(F.count(F.lit(1)).alias("tokens"), F.max("n_pages").alias("support"))
    valid = classes.filter(
        (F.col("tokens") >= CLASS_TOKENS) & (F.col("support") >= CLASS_PAGES)
    ).select("host", "f1", "f2", "support")
    elements = tokens.filter("text is null").select("host", "f1", "f2", "path").distinct()
    nested = elements.join(valid, ["host", "f1", "f2"])
    most = (F.col("n_pages") >= TEMPLATE_PAGES) & (F.col("n_pages") >= TEMPLATE_PART * F.col("host_pages"))
    texts = tokens.filter(F.col("text").isNotNull() & (F.col("n_pages") >= CLASS_PART * F.col("host_pages")))
    found = texts.join(nested, ["host", "f1", "f2", "path"], "left").withColumn("support", F.when(~most, F.col("support")))
    fixed = found.filter(most | F.col("support").isNotNull()).select("host", F.struct("path", "text", "support").alias("fixed"), F.lit(None).alias("named"))
    named = tokens.filter(F.col("text").isNull() & (F.col("total") > 0) & (F.col("n_pages") >= CLASS_PART * F.col("host_pages")))
    named = named.groupBy("host", "path").agg((2 * F.sum("inside") > F.sum("total")).alias("content"))  # of either state
    rows = fixed.unionByName(named.select("host", F.lit(None).alias("fixed"), F.struct("path", "content").alias("named")))
    return rows.groupBy("host").agg(F.collect_set("fixed").alias("fixed"), F.collect_set("named").alias("named"))


def page_text(page: str, fixed: dict | None = None, named: dict | None = None) -> tuple[str, int]:
    """The blocks in the article or main part, or else those that fill the template's slots, joined by
    newlines, and how many there are. fixed has (path, crc) of template texts with the pages of their
    class or None. named tells of paths of elements named as something else whether they are content
    after all; of others the page itself tells. On a page that holds nothing but what its classes hold, those of the class on the
    fewest pages are its text: it is a copy of other pages."""
    found = blocks(page)
    content = {path: 2 * n > total for path, (n, total) in held(found).items()} | (named or {})
    found = [t for t in found if all(content[path] for path in t[3])]
    within = any(t[0] == "tag" and t[2] == 2 for t in found)
    texts = [t for t in found if t[0] == "text" and t[2] == (2 if within else 1)]
    if not within and fixed:
        keys = [(t[1], zlib.crc32(t[4].encode())) for t in texts]
        slots = [t for t, k in zip(texts, keys, strict=True) if k not in fixed]
        least = min((n for k in keys if (n := fixed.get(k)) is not None), default=None)
        texts = slots or [t for t, k in zip(texts, keys, strict=True) if least is not None and fixed[k] == least]
    return "\n".join(t[4] for t in texts), len(texts)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: id, url, text (empty if none), n_chars (code points), n_blocks, host.

    A null page is empty. Pages without a host (null or relative URLs) share the template of "no host".
    Rows repeated are pages repeated, in the template's counts too. Markup that is never closed ends
    with the page; a tag the page breaks off in is dropped. An empty table gives an empty result. Other
    columns are not read. Pages are shuffled only if the templates of all hosts are too large to be
    sent along; a host with many pages is then split by adaptive joins.
    """
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), text_of(html_col).alias("page"))
    known = stored(templates(given))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        seen: dict = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = []
                for host, page, fixed, named in zip(*(part.column(k) for k in range(2, 6)), strict=True):
                    host = host.as_py()
                    if host not in seen:
                        if len(seen) > 1000:
                            seen.clear()
                        seen[host] = (
                            {(x["path"], x["text"]): x["support"] for x in fixed.as_py() or ()}, {x["path"]: x["content"] for x in named.as_py() or ()},
                        )
                    texts.append(page_text(page.as_py(), *seen[host]))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()),
                    pa.array([n for _, n in texts], pa.int64()), part.column(2),
                ], names=["id", "url", "text", "n_chars", "n_blocks", "host"])

    joined = given.join(known, "host", "left").select("id", "url", "host", "page", "fixed", "named")
    schema = f"id {kind}, url string, text string, n_chars bigint, n_blocks bigint, host string"
    return joined.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
