"""Several values packed in one field: expectation-maximisation segmentation with Viterbi lattices."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs which, beside letters and digits of any script, make up bare values.
SIGNS = "_:=.+-%"
DIGITS = re.compile(r"\d+")
#: The model's fixed size, per field: hashed value frequencies, and hashed behaviour of open signs.
VALUE_SLOTS, OPEN_SLOTS = 1 << 15, 1 << 10
#: A value never seen, of one piece; one joined from m pieces has the m-fold, so that it costs what its pieces cost.
LOG_UNSEEN = -math.log(VALUE_SLOTS)
PLAIN, QUOTED, OPEN = 0, 1, 2


class Piece(NamedTuple):
    """A stretch of text no reading cuts: value characters, a quoted span, or open signs. What lies between pieces separates."""

    kind: int
    value: str
    start: int
    end: int


class Model(NamedTuple):
    """Log frequencies of values and log probabilities that open signs join or separate, all by hashed slot."""

    values: np.ndarray
    join: np.ndarray
    split: np.ndarray


class Grammar:
    """Which characters make up values and which separate, whatever a model says; open_signs may do either."""

    def __init__(self, open_signs: str = ""):
        self.open_signs = open_signs
        opened = re.escape(open_signs)
        signs = re.escape("".join(s for s in SIGNS if s != "_" and s not in open_signs))
        value = rf"(?:(?![{opened}])[\w{signs}])" if open_signs else rf"[\w{signs}]"
        before = rf"(?<!{value})" if not open_signs else rf"(?:(?<![\w{signs}])|(?<=[{opened}]))"
        quoted = r"""(?:"((?:[^"]|"")*+)"|'((?:[^']|'')*+)')"""
        self.pattern = re.compile(rf"{before}{quoted}|({value}+)" + (rf"|([{opened}]+)" if open_signs else "|(?!)()"))

    def pieces(self, text: str) -> list[Piece]:
        """The pieces of text in order; an empty quoted span is none."""
        found = []
        for m in self.pattern.finditer(text):
            double, single, plain, opened = m.groups()
            if plain is not None:
                found.append(Piece(PLAIN, plain, m.start(), m.end()))
            elif opened:
                found.append(Piece(OPEN, opened, m.start(), m.end()))
            elif value := double.replace('""', '"') if double is not None else single.replace("''", "'"):
                found.append(Piece(QUOTED, value, m.start(), m.end()))
        return found


def _crc(text: str, crc: int = 0) -> int:
    return zlib.crc32(DIGITS.sub("0", text).encode("utf-8", "surrogatepass"), crc)


def edges(pieces: Sequence[Piece], i: int, model: Model) -> Iterator[tuple[int, float, int, list[int]]]:
    """Edges out of node i: (node after, log score, value slot or -1 for a separator, slots of the open signs passed).

    A quoted span is one edge and joins nothing. Plain pieces may be joined over open signs that touch both; every other
    joining is no edge of the lattice. Joined values of any number of pieces are edges.
    """
    first = pieces[i]
    if first.kind == OPEN:
        sign = _crc(first.value) % OPEN_SLOTS
        yield i + 1, model.split[sign], -1, [sign]
        return
    crc = _crc(first.value)
    slot = crc % VALUE_SLOTS
    yield i + 1, max(model.values[slot], LOG_UNSEEN), slot, []
    inner, passed, k, parts = 0.0, [], i + 1, 1
    while first.kind == PLAIN and k + 1 < len(pieces) and pieces[k].kind == OPEN and pieces[k + 1].kind == PLAIN and pieces[k - 1].end == pieces[k].start and pieces[k].end == pieces[k + 1].start:
        sign = _crc(pieces[k].value) % OPEN_SLOTS
        inner += model.join[sign]
        passed = [*passed, sign]
        crc = _crc(pieces[k + 1].value, _crc(pieces[k].value, crc))
        parts, k = parts + 1, k + 2
        slot = crc % VALUE_SLOTS
        yield k, max(model.values[slot], parts * LOG_UNSEEN) + inner, slot, passed


def viterbi(pieces: Sequence[Piece], model: Model) -> list[tuple[int, int]]:
    """The likeliest path's value edges: (first piece, piece after the last) of each value. Of equal paths the one of shorter values."""
    n = len(pieces)
    best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
    for i in range(n):
        for j, score, slot, _ in edges(pieces, i, model):
            if best[i] + score > best[j] or best[j] == -math.inf or (best[i] + score == best[j] and i > back[j][0]):
                best[j], back[j] = best[i] + score, (i, slot)
    spans, j = [], n
    while j:
        i, slot = back[j]
        if slot >= 0:
            spans.append((i, j))
        j = i
    return spans[::-1]


def read_values(text: str, pieces: Sequence[Piece], spans: Sequence[tuple[int, int]]) -> list[str]:
    """The text under each value edge; of a quoted span its inside."""
    return [pieces[i].value if j == i + 1 else text[pieces[i].start : pieces[j - 1].end] for i, j in spans]


def _add(a: float, b: float) -> float:
    if a == -math.inf or b == -math.inf:
        return max(a, b)
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def expected(pieces: Sequence[Piece], weight: float, model: Model, value_counts: np.ndarray, join_counts: np.ndarray, split_counts: np.ndarray) -> None:
    """Add the expected counts over all paths (forward-backward). Edges are made anew in each pass, so memory grows with the pieces only."""
    if all(p.kind != OPEN for p in pieces):  # one path, certain: each value counts in full
        for p in pieces:
            value_counts[_crc(p.value) % VALUE_SLOTS] += weight
        return
    n = len(pieces)
    forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i in range(n):
        for j, score, _, _ in edges(pieces, i, model):
            forward[j] = _add(forward[j], forward[i] + score)
    for i in range(n - 1, -1, -1):
        for j, score, _, _ in edges(pieces, i, model):
            backward[i] = _add(backward[i], backward[j] + score)
    for i in range(n):
        for j, score, slot, signs in edges(pieces, i, model):
            p = weight * math.exp(min(0.0, forward[i] + score + backward[j] - forward[n]))
            if slot < 0:
                split_counts[signs[0]] += p
            else:
                value_counts[slot] += p
                for sign in signs:
                    join_counts[sign] += p


def model_of(value_counts: np.ndarray, join_counts: np.ndarray, split_counts: np.ndarray) -> Model:
    """Log frequencies from counts; without counts every value is unseen and an open sign separates four times in five."""
    with np.errstate(divide="ignore"):
        values = np.log(value_counts / max(1.0, value_counts.sum()))
    both = join_counts + split_counts + 2.5
    return Model(values, np.log((join_counts + 0.5) / both), np.log((split_counts + 2.0) / both))


def start_model() -> Model:
    return model_of(np.zeros(VALUE_SLOTS), np.zeros(OPEN_SLOTS), np.zeros(OPEN_SLOTS))


def unpivoted(sources: Sequence[tuple[str, DataFrame, str, Sequence[str]]]) -> DataFrame:
    """(table_name, row_id, field_name, packed) of (name, table, id column, packed columns); null and empty fields left out."""
    parts = []
    for name, df, row_id, fields in sources:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("packed")) for f in fields]))
        parts.append(df.select(F.lit(name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), pairs.alias("p")).select("table_name", "row_id", "p.field_name", "p.packed"))
    return reduce(DataFrame.unionByName, parts).where("packed IS NOT NULL AND packed <> ''")


def shape(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "0")


def fit_segmentation(packed: DataFrame, grammar: Grammar, rounds: int = 6) -> dict[tuple[str, str], Model]:
    """Per (table_name, field_name), value frequencies and what open signs do, learned from the whole column.

    Each round reads every distinct shape (digits collapsed) of the column with its count; tasks return sums over fixed
    slots, so what reaches the driver never exceeds VALUE_SLOTS + 2 * OPEN_SLOTS numbers per field. Rounds end early at
    a fixed point: where no field has more than one path, the first counts are final.
    """
    spark = packed.sparkSession
    shapes = packed.groupBy("table_name", "field_name", shape(F.col("packed")).alias("shape")).agg(F.count(F.lit(1)).alias("n")).persist()
    models: dict[tuple[str, str], Model] = {}
    sizes = (VALUE_SLOTS, OPEN_SLOTS, OPEN_SLOTS)
    try:
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(models)

            def tally(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                sums: dict[tuple[str, str], tuple[np.ndarray, ...]] = {}
                start = start_model()
                for batch in batches:
                    for t, f, text, n in zip(batch.table_name, batch.field_name, batch["shape"], batch.n, strict=True):
                        if (t, f) not in sums:
                            sums[t, f] = tuple(np.zeros(s) for s in sizes)
                        if pieces := grammar.pieces(text):
                            expected(pieces, float(n), sent.value.get((t, f)) or start, *sums[t, f])
                for (t, f), arrays in sums.items():
                    for kind, values in enumerate(arrays):
                        at = np.flatnonzero(values)
                        yield pd.DataFrame({"table_name": t, "field_name": f, "kind": kind, "slot": at, "total": values[at]})

            counts = shapes.mapInPandas(tally, "table_name string, field_name string, kind int, slot int, total double")
            got = counts.groupBy("table_name", "field_name", "kind", "slot").agg(F.sum("total").alias("total")).toPandas()
            models = {}
            for key, part in got.groupby(["table_name", "field_name"]):
                arrays = tuple(np.zeros(s) for s in sizes)
                for kind, a in enumerate(arrays):
                    rows = part[part.kind == kind]
                    a[rows.slot.to_numpy()] = rows.total.to_numpy()
                models[key] = model_of(*arrays)
            sent.unpersist()
            if not (got.kind > 0).any():
                break
    finally:
        shapes.unpersist()
    return models


def split_packed(sources: Sequence[tuple[str, DataFrame, str, Sequence[str]]], open_signs: str = "", rounds: int = 6, models: dict[tuple[str, str], Model] | None = None) -> DataFrame:
    """(table_name, row_id, field_name, pos, item): one row per value of the packed columns of the given tables.

    A bare value is a run of letters, digits and SIGNS, all else separates, and a quoted span is one value: this grammar
    bounds the lattice. Its nodes are the boundaries of pieces; value edges hold one piece or several joined over open
    signs, separator edges hold open signs. A model learned per column by expectation-maximisation scores the edges, and
    the rows are the texts under the value edges of Viterbi's path. open_signs: signs that may stand inside a value or
    between two, so that only the column's frequencies tell; without any, the grammar leaves a single path per field, and
    nothing is learned.
    models: use these instead of learning. pos counts the values of a field from 1.

    Null and empty fields, and fields of separators only, give no row. Repeated values stay. A mark without its partner
    is a separator. Open signs at the edge of a value, or beside a quoted span, separate. Whole texts are read, however
    long; a stretch of k plain pieces joined by open signs has k * (k + 1) / 2 value edges, all of them weighed. Empty
    tables give an empty result. Extra columns are never read.
    """
    packed, grammar = unpivoted(sources), Grammar(open_signs)
    if models is None and open_signs:
        models = fit_segmentation(packed, grammar, rounds)
    sent = None if models is None else packed.sparkSession.sparkContext.broadcast(models)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths: dict[tuple[str, str, str], list[tuple[int, int]]] = {}
        single = start_model() if sent is None else None
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for t, row_id, f, text in zip(batch.table_name, batch.row_id, batch.field_name, batch.packed, strict=True):
                pieces = grammar.pieces(text)
                if not pieces:
                    continue
                key = (t, f, DIGITS.sub("0", text))
                if (spans := paths.get(key)) is None:
                    spans = viterbi(pieces, sent.value[t, f] if single is None else single)
                    if len(paths) < 100_000:  # a memory of paths, not of rows: every field is read by its own path
                        paths[key] = spans
                items = read_values(text, pieces, spans)
                n = len(items)
                for column, values in zip(columns, ([t] * n, [row_id] * n, [f] * n, range(1, n + 1), items), strict=True):
                    column.extend(values)
            table, ids, field, pos, item = columns
            text = lambda values: pd.Series(values, dtype=object)
            yield pd.DataFrame({"table_name": text(table), "row_id": pd.Series(ids, dtype="int64"), "field_name": text(field), "pos": pd.Series(pos, dtype="int32"), "item": text(item)})

    return packed.mapInPandas(split, "table_name string, row_id long, field_name string, pos int, item string")
