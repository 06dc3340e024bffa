"""Evaluation passages inside training text: a broadcast hash set of test n-grams against every document's windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage

#: A word is a Han character or a run of other letters and digits.
WORD = regex.compile(r"\p{Han}|[[\p{L}\p{N}]--\p{Han}]+", regex.V1)
NGRAM = 16
#: Characters of test items in one broadcast, so at most as many n-grams; more items are scanned block after block.
BLOCK_CHARS = 1_000_000
#: So many blocks are scanned by broadcast, each reading the documents once; more items meet the documents in a shuffle join.
MOST_BLOCKS = 4


def _powers(n: int) -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 1 << 62, size=(2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_code(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class ItemIndex:
    """The n-grams of the test items: sorted hashes and where each stands in one array of word numbers, items end to end.

    Twelve bytes per n-gram, four per word, and the distinct words of the block; the word numbers verify hits.
    """

    def __init__(self, items: Sequence[tuple[int, str]], n: int):
        self.n, self.vocabulary, self.powers = n, {}, _powers(n)[0]
        number = self.vocabulary.setdefault
        lengths, parts, ids = [0], [], []
        for item_id, text in items:
            part = np.fromiter((number(m.group().lower(), len(self.vocabulary)) for m in WORD.finditer(text or "")), dtype=np.int32)
            if len(part) >= n:
                parts.append(part)
                ids.append(item_id)
                lengths.append(len(part))
        self.ids, self.begins = np.array(ids, dtype=np.int64), np.cumsum(lengths)
        self.words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        self.codes = np.random.default_rng(7).integers(1, 1 << 62, size=max(1, len(self.vocabulary)), dtype=np.uint64)
        starts = [np.arange(a, b - n + 1, dtype=np.int32) for a, b in zip(self.begins, self.begins[1:])]
        at = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int32)
        hashes = self.hash(self.words, at)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], at[order]

    def hash(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.uint64)
        for k in range(self.n):
            out += self.codes[ids[starts + k]] * self.powers[k]
        return out

    def owner(self, at: int) -> int:
        return int(self.ids[np.searchsorted(self.begins, at, side="right") - 1])

    def word_ids(self, text: str) -> list[int]:
        get = self.vocabulary.get
        return [get(w.lower(), -1) for w in WORD.findall(text)]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, item) of each window of ids that is an n-gram of the item, verified word by word."""
        n = self.n
        if len(ids) < n or not len(self.hashes):
            return
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        starts = np.flatnonzero(unknown[n:] == unknown[:-n])
        if not len(starts):
            return
        h = self.hash(ids, starts)
        row = np.searchsorted(self.hashes, h)
        row[row == len(self.hashes)] = 0
        for k in np.flatnonzero(self.hashes[row] == h):
            start, r, last = int(starts[k]), int(row[k]), None
            window = ids[start : start + n]
            while r < len(self.hashes) and self.hashes[r] == h[k]:
                at = int(self.at[r])
                if (self.words[at : at + n] == window).all() and (item := self.owner(at)) != last:
                    last = item
                    yield start, item
                r += 1


def spans_of(hits: Iterable[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """(item, first word, word after the last) of each maximal stretch of words shared with an item; hits in order of position."""
    open_spans: dict[int, list[int]] = {}
    out = []
    for s, item in hits:
        span = open_spans.get(item)
        if span and s <= span[1]:
            span[1] = s + n
        else:
            if span:
                out.append((item, *span))
            open_spans[item] = [s, s + n]
    return out + [(item, *span) for item, span in open_spans.items()]


def _with_places(doc: int, body: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    places = [m.span() for m in WORD.finditer(body)] if spans else []
    return [(doc, item, places[a][0], places[b - 1][1], b - a) for item, a, b in spans]


_SPANS = "doc_id long, item_id long, start_char int, end_char int, words int"
_SPAN_COLUMNS = ["doc_id", "item_id", "start_char", "end_char", "words"]


def _scan(documents: DataFrame, block: list[tuple[int, str]], n: int) -> tuple[DataFrame, Broadcast]:
    sent = documents.sparkSession.sparkContext.broadcast(ItemIndex(block, n))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for batch in batches:
            out = []
            for doc, body in zip(batch.doc_id, batch.text, strict=True):
                out += _with_places(doc, body, spans_of(index.hits(np.array(index.word_ids(body), dtype=np.int32)), n))
            yield pd.DataFrame(out, columns=_SPAN_COLUMNS)

    return documents.mapInPandas(scan, _SPANS), sent


def _grams(df: DataFrame, n: int, distinct: bool) -> DataFrame:
    """(id, place, h1, h2): two independent 64-bit hashes of every n-gram of (id, text); place is null where only the n-gram matters."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, codes = _powers(n), {}
        for batch in batches:
            for key, body in zip(batch.id, batch.text, strict=True):
                words = []
                for w in WORD.findall(body):
                    code = codes.get(w)
                    if code is None:
                        code = _word_code(w.lower())
                        if len(codes) < 200_000:
                            codes[w] = code
                    words.append(code)
                m = len(words) - n + 1
                if m < 1:
                    continue
                x = np.array(words, dtype=np.uint64)
                h = np.zeros((2, m), dtype=np.uint64)
                for k in range(n):
                    h += x[k : k + m] * powers[:, k : k + 1]
                h1, h2 = h.view(np.int64)
                place = np.arange(m, dtype=np.int32)
                if distinct:
                    _, place = np.unique(h1, return_index=True)
                yield pd.DataFrame({"id": np.full(len(place), key, dtype=np.int64), "place": place.astype(np.int32), "h1": h1[place], "h2": h2[place]})

    return df.mapInPandas(grams, "id long, place int, h1 long, h2 long")


def _joined(documents: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The spans by a shuffle join of 128-bit n-gram fingerprints; nothing is broadcast or collected. Rows are numbered, so repeated documents stay apart."""
    rows = cut_lineage(documents.withColumn("row_", F.monotonically_increasing_id()))
    test = _grams(items, n, distinct=True).select("h1", "h2", F.col("id").alias("item_id")).distinct()
    windows = _grams(rows.select(F.col("row_").alias("id"), "text"), n, distinct=False).withColumnRenamed("id", "row_")
    hits = windows.join(test, ["h1", "h2"]).select("row_", "item_id", "place")
    order = Window.partitionBy("row_", "item_id").orderBy("place")
    fresh = (F.col("place") > F.lag("place").over(order) + n).cast("int")
    runs = hits.withColumn("run_", F.coalesce(F.sum(F.coalesce(fresh, F.lit(0))).over(order), F.lit(0)))
    spans = runs.groupBy("row_", "item_id", "run_").agg(F.min("place").alias("a"), (F.max("place") + n).alias("b"))
    per = spans.groupBy("row_").agg(F.collect_list(F.struct("item_id", "a", "b")).alias("spans"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, body, spans in zip(batch.doc_id, batch.text, batch.spans, strict=True):
                out += _with_places(doc, body, [(s["item_id"], s["a"], s["b"]) for s in spans])
            yield pd.DataFrame(out, columns=_SPAN_COLUMNS)

    return rows.join(per, "row_").select("doc_id", "text", "spans").mapInPandas(place, _SPANS)


def leaked_spans(documents: DataFrame, items: DataFrame, *, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = NGRAM, block_chars: int = BLOCK_CHARS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, words): every maximal stretch of at least n words a document shares with a test item.

    Words are compared without regard to case, white space, punctuation and underscores. The test items' n-grams are
    broadcast as a hash set and every window of every document is looked up; hits are verified word by word. Items of
    more than block_chars characters in all are split by id into blocks of about that size; each block is scanned and its
    result written before the next is sent, and its broadcast released, so the driver holds one block at a time. Beyond
    most_blocks blocks the n-grams of both sides meet in a shuffle join on two independent 64-bit hashes instead.

    Null and empty texts, and texts or items under n words, share nothing. Null ids of items count for nothing. Repeated
    documents are reported each. No documents or no items: no rows. Other columns are never read.
    """
    narrow = documents.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    known = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    blocks = int((known.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) + 1
    if blocks > most_blocks:
        return _joined(narrow, known, n)
    parts = []
    for b in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        found, sent = _scan(narrow, [(r.id, r.text) for r in part.collect()], n)
        if blocks == 1:
            return found
        parts.append(cut_lineage(found))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def remove_leaks(documents: DataFrame, spans: DataFrame, *, row_id: str = "doc_id", text: str = "text", drop_share: float = 0.5) -> DataFrame:
    """(doc_id, action, removed_chars, text): documents with leaked spans cut out.

    action is 'keep' without a span, 'cut' with some, 'drop' (null text) where the spans make up drop_share of the text
    or more. Overlapping spans count once. row_id must identify documents.
    """
    grouped = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_char", "end_char"))).alias("spans"))
    both = documents.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(grouped, "doc_id", "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, body, ranges in zip(batch.doc_id, batch.text, batch.spans, strict=True):
                if ranges is None:
                    out.append((doc, "keep", 0, body))
                    continue
                kept, end = [], 0
                for r in ranges:
                    if r["start_char"] > end:
                        kept.append(body[end : r["start_char"]])
                    end = max(end, r["end_char"])
                kept.append(body[end:])
                clean = "".join(kept)
                removed = len(body) - len(clean)
                drop = removed >= drop_share * len(body)
                out.append((doc, "drop" if drop else "cut", removed, None if drop else clean))
            yield pd.DataFrame(out, columns=["doc_id", "action", "removed_chars", "text"])

    return both.mapInPandas(cut, "doc_id long, action string, removed_chars int, text string")
