"""Main text of web pages, with page differencing against the nearest URL.

A page becomes lines: the text of its blocks, with the container they stand in. Each page is paired with the page next to it
in the order of the URL path within its host, the lines of the two are aligned by a longest common subsequence, and lines that both
share are deleted as part of the site. Two pages may also share a paragraph of their articles, and that is text: so a
shared line stays if it is a paragraph, heading, list item or cell inside an article or main element. Elements that say
that they are no text (navigation, forms, scripts, adverts, comments and so on, by tag, role, class or id) are left out before.

Plan: pages are dealt in ranges of (host, path), so a large host spreads over many tasks and neighbours meet in one; html
is shuffled once. Pages at the edges of ranges meet their neighbours in a small second step, which reads the same exchange; no
text is written in between.

Cases: null or empty html: empty text. No host in the URL, or a host with one page: no pair. Equal URLs: ordered by key.
Pages without an article or main element: all lines that are not shared. Unclosed and stray tags are tolerated. Nothing is cut.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.align import common_lines
from leakscan.llm.common import table, text_bytes
from leakscan.llm.ordered import following, in_order

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|object|svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9_:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dt dd figcaption caption".split())
_OUT = set("head nav footer aside form button select option dialog menu input audio video canvas map".split())
_MAIN = {"article", "main"}
#: A start tag of the key ends an open element of one of the values, if that is not in a nested container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words of class and id that name something other than text.
_HINTS = set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall share sharing social related "
    "recommended sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments commentlist "
    "reply replies respond disqus footer masthead toolbar widget skip hidden".split()
)


@dataclass(frozen=True)
class Line:
    text: str
    main: bool
    prose: bool


def _left_out(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _OUT or tag == "header" and not inside:
        return True
    if not attributes.strip():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and not (tag in _MAIN or tag in ("body", "html")):
            if not _HINTS.isdisjoint(_WORD.findall(value)) or not inside and "header" in _WORD.findall(value):
                return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def lines_of(page: str) -> list[Line]:
    """The blocks of a page that may be text, white space folded, character references decoded."""
    lines: list[Line] = []
    stack: list[tuple[str, bool]] = []  # open elements and whether they are left out
    out = main = 0  # how many open elements are left out, are article or main
    buffer: list[str] = []

    def flush():
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                block = next((t for t, _ in reversed(stack) if t not in _INLINE), "")
                lines.append(Line(text, main > 0, block in _PROSE))
            buffer.clear()

    def close_to(depth: int):
        nonlocal out, main
        while len(stack) > depth:
            tag, skipped = stack.pop()
            out -= skipped
            main -= tag in _MAIN

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            if not out:
                buffer.append(html.unescape(m["text"]))
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush()
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                close_to(depth)
            continue
        if tag not in _INLINE:
            ends = _ENDS.get(tag, set()) | ({"p"} if tag not in _VOID else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close_to(i)
                    break
                if stack[i][0] not in _INLINE:
                    break
        if tag not in _VOID and not m["attributes"].rstrip().endswith("/"):
            skipped = _left_out(tag, m["attributes"], main > 0)
            stack.append((tag, skipped))
            out += skipped
            main += tag in _MAIN
    flush()
    return lines


def main_text(own: list[Line], partner: list[Line] | None) -> str:
    """The lines that are text, joined by a space."""
    shared = {i for i, _ in common_lines([x.text for x in own], [x.text for x in partner])} if partner else set()
    inside = any(x.main for x in own)
    return " ".join(
        x.text
        for i, x in enumerate(own)
        if (x.main or not inside) and not (i in shared and not (x.main and x.prose))
    )


def _waits(host: str, first: bool, last: bool, paired: bool) -> bool:
    """Whether a page is paired in the second step: it may have a neighbour in another partition that is to be its pair."""
    return bool(host) and (first or last and not paired)


def extract(pages: DataFrame, key: str, url: str = "url", markup: str = "html") -> DataFrame:
    """key, url, text, n_chars for every page."""
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    rows = in_order(
        pages.select(
            F.col(f"`{key}`").alias("key"),
            F.col(f"`{url}`").cast("string").alias("url"),
            F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
            F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
            text_bytes(markup).alias("raw"),
        ),
        ["host", "path", "url", "key"],
        long="raw",
    )
    kind = rows.schema["key"].dataType.simpleString()

    def walk(batches):
        """Texts of the pages that have a neighbour in their partition to be paired with, or need none."""
        kinds = None
        before = None  # the page that waits for the one after it: key, url, host, lines, first, partner

        def finish(page, after):
            """after: (host, lines) of the next page in the same partition, if any; none if the page waits."""
            key_, url_, host, lines, first, partner = page
            if _waits(host, first, after is None, partner is not None):
                return None
            if partner is None and host and after and after[0] == host:
                partner = after[1]
            return key_, url_, main_text(lines, partner)

        def batch(out):
            types = [kinds, pa.string(), pa.string()]
            columns = zip(*(r for r in out if r), strict=True) if any(out) else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "url", "text"])

        for b in batches:
            kinds, out = b.column("key").type, []
            columns = (b.column(c).to_pylist() for c in ("key", "url", "host", "raw"))
            for key_, url_, host, raw in zip(*columns, strict=True):
                lines = lines_of(raw.decode("utf-8", "replace"))
                partner = before[3] if before and host and before[2] == host else None
                if before:
                    out.append(finish(before, (host, lines)))
                before = key_, url_, host, lines, before is None, partner
            yield batch(out)
        if before:
            yield batch([finish(before, None)])

    def edges(batches):
        """The first and the last page of a partition as they are (once, if they are one), and the page after the first."""
        names = ["key", "url", "host", "raw", "part", "first", "last", "waits", "next_raw"]
        first = last = second = None  # slices of one row
        paired = False  # whether the last page has the host of the one before it
        for b in batches:
            for i in range(len(b)) if second is None else range(max(len(b) - 1, 0), len(b)):
                host = b.column("host")[i].as_py()
                if first is None:
                    first = b.slice(i, 1)
                elif second is None:
                    second = b.slice(i, 1)
                above = b.slice(i - 1, 1) if i else last
                paired = bool(host) and above is not None and above.column("host")[0].as_py() == host
                last = b.slice(i, 1)
        for page, is_first, is_last in ((first, True, second is None), (last, False, True)):
            if page is not None and (is_first or second is not None):
                host = page.column("host")[0].as_py()
                near = is_first and second is not None and second.column("host")[0].as_py() == host
                flags = [is_first, is_last, _waits(host, is_first, is_last, paired and not is_first)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(page.column(c) for c in names[:5]),
                        *(pa.array([x], pa.bool_()) for x in flags),
                        second.column("raw") if near else pa.array([None], pa.binary()),
                    ],
                    names=names,
                )

    done = rows.mapInArrow(walk, f"key {kind}, url string, text string")
    walked = rows.mapInArrow(
        edges,
        f"key {kind}, url string, host string, raw binary, part int, first boolean, last boolean, waits boolean, next_raw binary",
    )
    order = following(walked.filter("last").select("part"))
    heads = walked.filter("first").select(F.col("part").alias("next_part"), F.col("host").alias("head_host"), F.col("raw").alias("head"))
    tails = walked.filter("last").join(order, "part").select(
        F.col("next_part").alias("part"), F.col("host").alias("tail_host"), F.col("raw").alias("tail")
    )
    waiting = (
        walked.filter("waits")
        .join(tails, "part", "left")
        .join(order, "part", "left")
        .join(heads, "next_part", "left")
        .select(
            "key",
            "url",
            "raw",
            F.coalesce(
                F.when(F.col("first") & (F.col("tail_host") == F.col("host")), F.col("tail")),
                F.col("next_raw"),
                F.when(F.col("last") & (F.col("head_host") == F.col("host")), F.col("head")),
            ).alias("partner"),
        )
    )

    def close(batches):
        for b in batches:
            texts = [
                main_text(
                    lines_of(raw.decode("utf-8", "replace")),
                    None if partner is None else lines_of(partner.decode("utf-8", "replace")),
                )
                for raw, partner in zip(b.column("raw").to_pylist(), b.column("partner").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("url"), pa.array(texts, pa.string())], names=["key", "url", "text"]
            )

    both = done.unionByName(waiting.mapInArrow(close, f"key {kind}, url string, text string"))
    return both.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), "page_id")
