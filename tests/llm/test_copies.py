import random

from barloom.llm.copies import collapse_copies, find_copies

RULE = {"row_id": "row_id", "ordered": ["title", "raw_hash"], "unordered": ["source"], "required": ["raw_hash"]}
SCHEMA = "row_id long, title string, raw_hash string, source string, id long, key string, first_id long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "clash", 9) for r in rows], SCHEMA)


def test_forms_of_one_event(spark):
    rows = [
        (5, "Stock 5 up, 10%", "ab-12", "News/Stock/Wire"),
        (3, "  STOCK 5 up 10％!", "AB12", "wire_stock_news"),
        (9, "Stock 5 up 10", "a b:12", " stock::news.wire "),
        (1, "Stock 5 up 11", "ab12", "wire_stock_news"),
        (2, "Stock 5 up 10", None, "wire_stock_news"),
        (4, "Stock 5 up 10", None, "wire_stock_news"),
        (6, None, "x", "s"),
        (7, None, "X", "S"),
        (8, "", "x", "s"),
        (10, "股价，上涨", "z", None),
        (11, "股价 上涨", "z", None),
    ]
    df = frame(spark, rows)
    for tuning in ({}, {"least_hot": 1, "max_hot": 100, "salts": 3}):
        got = sorted((r.first_id, r.copy_id) for r in find_copies(df, **RULE, **tuning).collect())
        assert got == [(3, 5), (3, 9), (6, 7), (10, 11)]
        kept = {r.row_id: r.copies for r in collapse_copies(df, keep=["title"], **RULE, **tuning).collect()}
        assert kept == {3: 3, 1: 1, 2: 1, 4: 1, 6: 2, 8: 1, 10: 2}
    assert find_copies(df.limit(0), **RULE).collect() == []
    assert collapse_copies(df.limit(0), **RULE).collect() == []


def test_hot_and_cold_groups_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, "Hot" if rnd.random() < 0.4 else f"t{rnd.randrange(300)}", "h", "s") for i in range(3000)]
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r[0])
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    got = find_copies(frame(spark, rows), **RULE, least_hot=500, max_hot=1000, salts=8)
    assert sorted((r.first_id, r.copy_id) for r in got.collect()) == want
