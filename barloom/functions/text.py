"""Text columns: clean-up, codes, dates, links and JSON."""

from __future__ import annotations

import html
import json
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shortened(text: Column, limit: int) -> Column:
    clean = squeezed(text)
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit - 3), F.lit("..."))).otherwise(clean)


def symbol_code(text: Column) -> Column:
    """The last six digits, padded; null without a digit."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(digits != "", F.lpad(F.right(digits, F.lit(6)), 6, "0"))


def codes_in(text: Column) -> Column:
    """All runs of exactly six digits, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])([0-9]{6})(?=[^0-9]|$)"), F.lit(1)))


def date_in(text: Column) -> Column:
    """The first date written as 2023-1-5, 2023/01/05, 2023.1.5, 2023年1月5日 or 20230105; null where there is none or it is no date."""
    parts = [F.regexp_extract(text, r"(19\d\d|20\d\d)[-/.年](\d{1,2})[-/.月](\d{1,2})", k) for k in (1, 2, 3)]
    split = F.when(parts[0] != "", F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")))
    run = F.regexp_extract(text, r"(?:^|[^0-9])((?:19|20)\d{6})(?:[^0-9]|$)", 1)
    solid = F.when(run != "", F.concat_ws("-", F.substring(run, 1, 4), F.substring(run, 5, 2), F.substring(run, 7, 2)))
    return F.try_to_date(F.coalesce(split, solid), "yyyy-MM-dd")


def moment(text: Column) -> Column:
    """Epoch milliseconds or an ISO date and time as a timestamp; null otherwise."""
    millis = F.when(text.rlike(r"^\d{13}$"), text).cast("bigint")
    return F.coalesce(F.timestamp_millis(millis), F.try_to_timestamp(F.when(millis.isNull(), text)))


def event_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur, letter case aside."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))


def links_in(page: Column) -> Column:
    """array<struct<href, title>> of an HTML page's anchors, tags stripped."""
    anchors = F.regexp_extract_all(page, F.lit(r"(?is)(<a\s[^>]*href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>)"), F.lit(1))
    href = lambda a: F.regexp_extract(a, r"(?is)href\s*=\s*[\"']([^\"']+)[\"']", 1)
    title = lambda a: squeezed(F.regexp_replace(a, r"(?s)<[^>]+>", " "))
    return F.transform(anchors, lambda a: F.struct(href(a).alias("href"), title(a).alias("title")))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return text.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8, else GB18030, else with replacement signs."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for encoding in ("utf-8", "gb18030"):
            try:
                return bytes(b).decode(encoding)
            except UnicodeDecodeError:
                continue
        return bytes(b).decode("utf-8", "replace")

    return raw.map(one)


#: The names under which an item's parts are looked for, the first known one wins.
ITEM_NAMES = {
    "title": ("title", "name", "bt", "docTitle"),
    "url": ("url", "href", "link", "docpuburl"),
    "date": ("date", "time", "publishTime", "pubDate", "docreltime"),
    "summary": ("summary", "content", "memo"),
}


@F.pandas_udf(ArrayType(StructType([StructField(name, StringType()) for name in ITEM_NAMES])))
def items_in(text: pd.Series, base: pd.Series) -> pd.Series:
    """The titled objects of a JSON document at any depth, outer ones first, their URLs made absolute by base; none where it is no JSON.

    The walk keeps its own stack, so any depth the parser reads is walked.
    """

    def one(body: str | None, start: str | None) -> list[dict]:
        try:
            stack = [json.loads(body)] if body is not None else []
        except (ValueError, RecursionError):
            return []
        found = []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(reversed(node))
            elif isinstance(node, dict):
                part = {k: next((node[n] for n in names if node.get(n)), None) for k, names in ITEM_NAMES.items()}
                if part["title"]:
                    joined = urljoin(start or "", str(part["url"] or start or ""))
                    found.append({"title": str(part["title"]), "url": joined, "date": str(part["date"] or ""), "summary": str(part["summary"] or "")})
                stack.extend(reversed(list(node.values())))
        return found

    return pd.Series([one(b, s) for b, s in zip(text, base, strict=True)])


@F.pandas_udf(StringType())
def joined_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """link made absolute by base; null where either is."""
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def page_urls(seed: pd.Series, pages: pd.Series) -> pd.Series:
    """A list page and its further pages: name_1.ext beside name.ext, or index_1.html in a folder; queries fall away."""

    def one(url: str | None, n: int) -> list[str] | None:
        if url is None:
            return None
        parts, out = urlsplit(url), [url]
        head, _, tail = parts.path.rpartition("/")
        for k in range(1, max(1, int(n or 1))):
            if "." in tail:
                stem, _, ending = tail.rpartition(".")
                path = f"{head}/{stem}_{k}.{ending}" if head or parts.path.startswith("/") else f"{stem}_{k}.{ending}"
            else:
                path = f"{parts.path.rstrip('/')}/index_{k}.html"
            out.append(urlunsplit(parts._replace(path=path, query="")))
        return list(dict.fromkeys(out))

    return pd.Series([one(u, n) for u, n in zip(seed, pages, strict=True)])
