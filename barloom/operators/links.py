"""Links from texts to the entities they name: by code, by list, by name, else by keyword."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.text import codes_in
from barloom.session import cut_lineage

#: Names in one broadcast automaton; more are searched block after block.
BLOCK_NAMES = 100_000


def phrases_in(texts: DataFrame, phrases: DataFrame, *, block: int = BLOCK_NAMES) -> DataFrame:
    """(id, phrase): each distinct phrase that stands in a text, letter case aside. texts: id, text; phrases: phrase.

    The phrases are searched all at once by an automaton of at most about block of them, broadcast; of several blocks each
    is searched, its result written and its broadcast released before the next. Null and empty phrases are in no text.
    """
    spark = texts.sparkSession
    known = phrases.select(F.lower("phrase").alias("phrase")).where("phrase <> ''").distinct()
    blocks = known.count() // block + 1
    narrow = texts.select("id", "text").where("text IS NOT NULL")
    kind = texts.schema["id"].dataType.simpleString()
    parts = []
    for b in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([r.phrase for r in part.collect()])

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            automaton = ahocorasick.Automaton()
            for phrase in sent.value:
                automaton.add_word(phrase, phrase)
            automaton.make_automaton()
            for batch in batches:
                out = []
                if sent.value:
                    for key, text in zip(batch.id, batch.text, strict=True):
                        out += [(key, phrase) for phrase in {p for _, p in automaton.iter(text.lower())}]
                yield pd.DataFrame(out, columns=["id", "phrase"])

        found = narrow.mapInPandas(scan, f"id {kind}, phrase string")
        if blocks == 1:
            return found
        parts.append(cut_lineage(found))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def linked_symbols(texts: DataFrame, symbols: DataFrame, keywords: DataFrame, least_name: int = 3) -> DataFrame:
    """(id, symbol, method, confidence, keywords): the symbols a text is about, each by its surest route.

    texts: id, text, symbol (may be null), related (array of symbols, may be null); symbols: symbol, name (may be null);
    keywords: keyword, symbol. Routes: 'explicit_symbol' (1.0), 'provided_related_symbols' (0.95), 'code_mention' (0.95),
    'name_mention' (0.85, names of least_name characters or more); texts without any of these: 'theme_keyword', by the
    number of the symbol's keywords in the text, 0.57 for one and 0.78 at most. Only known symbols are linked.
    """
    known = symbols.where("symbol IS NOT NULL").groupBy("symbol").agg(F.min(F.lower("name")).alias("name"))
    row = lambda method, sure, word="symbol": (F.lit(method).alias("method"), F.lit(sure).alias("confidence"), F.col(word).alias("keywords"))
    have = known.select("symbol")
    explicit = texts.select("id", "symbol").join(have, "symbol").select("id", "symbol", *row("explicit_symbol", 1.0))
    listed = texts.select("id", F.explode("related").alias("symbol")).distinct().join(have, "symbol").select("id", "symbol", *row("provided_related_symbols", 0.95))
    coded = texts.select("id", F.explode(codes_in(F.col("text"))).alias("symbol")).join(have, "symbol").select("id", "symbol", *row("code_mention", 0.95))
    named = phrases_in(texts, known.where(F.length("name") >= least_name).select(F.col("name").alias("phrase")))
    named = named.join(known, F.col("phrase") == F.col("name")).select("id", "symbol", *row("name_mention", 0.85, "name"))
    direct = explicit.unionByName(listed).unionByName(coded).unionByName(named)
    order = F.struct(F.when(F.col("method") == "explicit_symbol", 0).when(F.col("method") == "provided_related_symbols", 1).when(F.col("method") == "code_mention", 2).otherwise(3).alias("o"))
    direct = direct.groupBy("id", "symbol").agg(F.min_by(F.struct("method", "confidence", "keywords"), order).alias("b")).select("id", "symbol", "b.*")
    words = keywords.select(F.lower("keyword").alias("phrase"), "symbol").join(have, "symbol").distinct()
    hits = phrases_in(texts, words.select("phrase")).join(words, "phrase").join(direct.select("id").distinct(), "id", "left_anti")
    n = F.count(F.lit(1))
    themed = hits.groupBy("id", "symbol").agg(F.lit("theme_keyword").alias("method"), F.least(F.lit(0.78), 0.50 + 0.07 * n).alias("confidence"), F.array_join(F.slice(F.array_sort(F.collect_set("phrase")), 1, 8), ",").alias("keywords"))
    return direct.unionByName(themed)


def keyword_symbols(series: DataFrame, themes: DataFrame) -> DataFrame:
    """(series, symbols): for each series the symbols of which a theme text holds one of its keywords, in order.

    series: series, keyword; themes: symbol, theme. A keyword is looked up in all themes at once, no series meets every symbol.
    """
    texts = themes.select("symbol", F.col("theme").alias("text")).where("symbol IS NOT NULL").select(F.col("symbol").alias("id"), "text")
    words = series.select("series", F.lower("keyword").alias("phrase")).distinct()
    hits = phrases_in(texts, words.select("phrase")).distinct().join(words, "phrase")
    return hits.groupBy("series").agg(F.array_join(F.array_sort(F.collect_set("id")), ";").alias("symbols"))
