import pickle
import random

from barloom.llm.leakage import BLOCK_CHARS, WORD, ItemIndex, leaked_spans, remove_leaks

N = 16


def brute(docs, items):
    def grams(text):
        w = [x.lower() for x in WORD.findall(text or "")]
        return {tuple(w[i : i + N]) for i in range(len(w) - N + 1)}

    known = [(i, grams(t)) for i, t in items]
    return sorted((d, i) for d, t in docs for i, g in known if grams(t) & g)


def sample():
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)] + list("股价上涨回落")
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(60)) for k in range(12)]
    docs = []
    for k in range(60):
        item = items[rnd.randrange(12)][1].split(" ")
        a = rnd.randrange(40)
        piece = item[a : a + rnd.choice([10, 15, 16, 20])]
        docs.append((k, text(rnd.randrange(50)) + " - " + " ".join(piece).upper().replace(" ", rnd.choice([" ", "\n", " ** ", "_"])) + " . " + text(20)))
    return docs, items


def test_against_brute_force_in_one_and_several_blocks_and_joined(spark):
    docs, items = sample()
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert 10 < len(want) < 60
    places = []
    for block, most in ((10_000_000, 4), (700, 99), (700, 1)):  # one broadcast, several, the shuffle join
        spans = leaked_spans(d, i, block_chars=block, most_blocks=most)
        places.append(sorted(map(tuple, spans.collect())))
        assert sorted({(r.doc_id, r.item_id) for r in spans.collect()}) == want
    assert places[0] == places[1] == places[2]
    cleaned = remove_leaks(d, spans)
    assert cleaned.count() == len(docs)
    kept = [(r.doc_id, r.text) for r in cleaned.collect()]
    assert brute(kept, items) == []
    untouched = {x for x, _ in docs} - {x for x, _ in want}
    assert {r.doc_id for r in cleaned.where("action = 'keep'").collect()} == untouched


def test_nulls_short_long_and_empty(spark):
    passage = " ".join(f"t{k}" for k in range(20))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "t1 t2"), (4, "z " * 100_000 + passage), (5, passage), (5, passage)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, None), (3, "short"), (None, passage)], "item_id long, text string")
    for most in (4, 0):
        got = sorted((r.doc_id, r.item_id, r.words) for r in leaked_spans(docs, items, most_blocks=most).collect())
        assert got == [(4, 1, 20), (5, 1, 20), (5, 1, 20)]
        assert leaked_spans(docs.limit(0), items, most_blocks=most).collect() == []
        assert leaked_spans(docs, items.limit(0), most_blocks=most).collect() == []


def test_index_of_a_full_block_is_small():
    rnd = random.Random(6)
    text = "".join(chr(0x4E00 + rnd.randrange(6000)) for _ in range(BLOCK_CHARS))
    size = len(pickle.dumps(ItemIndex([(1, text)], N)))
    assert size < 20 * BLOCK_CHARS
