import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.operators.packed import OPEN_SLOTS, VALUE_SLOTS, Grammar, _crc, fit_segmentation, model_of, read_values, split_packed, start_model, unpivoted, viterbi

CHARS = set("_:=.+-%")


def plain(text):
    """The definition, character by character."""
    out, i, before = [], 0, True
    while i < len(text):
        c = text[i]
        if c in "\"'" and before:
            j, inside = i + 1, ""
            while j < len(text):
                if text[j] == c:
                    if text[j + 1 : j + 2] == c:
                        inside, j = inside + c, j + 2
                        continue
                    break
                inside, j = inside + text[j], j + 1
            if j < len(text):
                if inside:
                    out.append(inside)
                i, before = j + 1, True
                continue
        if c.isalnum() or c in CHARS:
            j = i
            while j < len(text) and (text[j].isalnum() or text[j] in CHARS):
                j += 1
            out.append(text[i:j])
            i, before = j, False
        else:
            i, before = i + 1, True
    return out


def reading(text, model, open_signs=""):
    pieces = Grammar(open_signs).pieces(text)
    return read_values(text, pieces, viterbi(pieces, model))


@given(st.text(alphabet="ab1;,| '\"_=。、 张", max_size=24))
@settings(max_examples=400, deadline=None)
def test_path_follows_the_definition(text):
    assert reading(text, start_model()) == plain(text)


@given(st.text(alphabet="ab1;-'\" ", max_size=16))
@settings(max_examples=300, deadline=None)
def test_open_signs_only_join_what_touches(text):
    """Whatever the model: with every open sign cut again, the values are those of the definition without that sign."""
    for counts in (np.zeros(OPEN_SLOTS), np.full(OPEN_SLOTS, 1000.0)):
        got = reading(text, model_of(np.zeros(VALUE_SLOTS), counts, np.zeros(OPEN_SLOTS)), "-")
        quoted = [p.value for p in Grammar("-").pieces(text) if p.kind == 1]
        cut = [part for v in got for part in ([v] if v in quoted else v.split("-"))]
        apart = [part for p in Grammar("-").pieces(text) if p.kind != 2 for part in [p.value]]
        assert [c for c in cut if c] == [a for a in apart if a]


def test_operator(spark):
    rows = [(1, 'a;"b; c";d', "x"), (2, None, "x"), (3, "", "x"), (4, ";; ,", "x"), (5, "'it''s';a;a", "x"), (6, "z" * 50_000 + ";y", "x"), (7, '"open; a', "x"), (7, '"open; a', "x")]
    df = spark.createDataFrame(rows, "row_id long, f string, item string")
    got = sorted((r.row_id, r.pos, r.item) for r in split_packed([("t", df, "row_id", ["f"])]).collect())
    assert got == sorted([(1, 1, "a"), (1, 2, "b; c"), (1, 3, "d"), (5, 1, "it's"), (5, 2, "a"), (5, 3, "a"), (6, 1, "z" * 50_000), (6, 2, "y"), (7, 1, "open"), (7, 2, "a"), (7, 1, "open"), (7, 2, "a")])
    assert split_packed([("t", df.limit(0), "row_id", ["f"])]).collect() == []


def counts_of(*values):
    counts = np.zeros(VALUE_SLOTS)
    for v in values:
        counts[_crc(v) % VALUE_SLOTS] += 1000
    return model_of(counts, np.zeros(OPEN_SLOTS), np.zeros(OPEN_SLOTS))


def test_the_model_decides_where_the_grammar_leaves_it_open(spark):
    df = spark.createDataFrame([(1, "alpha-beta;gamma"), (2, "'alpha-beta'-gamma")], "row_id long, f string")
    read = lambda model: sorted((r.row_id, r.pos, r.item) for r in split_packed([("t", df, "row_id", ["f"])], open_signs="-", models={("t", "f"): model}).collect())
    assert read(counts_of("alpha", "beta", "gamma")) == [(1, 1, "alpha"), (1, 2, "beta"), (1, 3, "gamma"), (2, 1, "alpha-beta"), (2, 2, "gamma")]
    assert read(counts_of("alpha-beta", "gamma")) == [(1, 1, "alpha-beta"), (1, 2, "gamma"), (2, 1, "alpha-beta"), (2, 2, "gamma")]
    with pytest.raises(Exception, match="KeyError"):
        split_packed([("t", df, "row_id", ["f"])], open_signs="-", models={}).collect()


def test_frequencies_of_the_column_decide(spark):
    """'x-ray' occurs as one value only, 'red' and 'blue' also alone; the same sign joins the one and separates the other."""
    rows = ["x-ray"] * 60 + ["red"] * 80 + ["blue"] * 80 + ["red-blue"] * 3 + ["red;x-ray"] * 20
    df = spark.createDataFrame(list(enumerate(rows)), "row_id long, f string")
    got = {}
    for r in split_packed([("t", df, "row_id", ["f"])], open_signs="-").collect():
        got.setdefault(rows[r.row_id], set()).add((r.pos, r.item))
    assert got["x-ray"] == {(1, "x-ray")} and got["red-blue"] == {(1, "red"), (2, "blue")} and got["red;x-ray"] == {(1, "red"), (2, "x-ray")}


def test_many_joined_pieces_have_no_cap(spark):
    text = "-".join(["p"] * 40)
    df = spark.createDataFrame([(k, text) for k in range(30)], "row_id long, f string")
    model = fit_segmentation(unpivoted([("t", df, "row_id", ["f"])]), Grammar("-"))["t", "f"]
    assert "".join(reading(text, model, "-")).replace("-", "") == "p" * 40
    assert reading(text, counts_of(text), "-") == [text]


def test_nothing_is_learned_where_the_grammar_leaves_one_path(spark, monkeypatch):
    """No pass over the column that could change no row."""
    df = spark.createDataFrame([(1, "alpha-beta;'x;y'")], "row_id long, f string")
    monkeypatch.setattr("barloom.operators.packed.fit_segmentation", lambda *a, **k: 1 / 0)
    assert sorted(r.item for r in split_packed([("t", df, "row_id", ["f"])]).collect()) == ["alpha-beta", "x;y"]
    with pytest.raises(ZeroDivisionError):
        split_packed([("t", df, "row_id", ["f"])], open_signs="-")
