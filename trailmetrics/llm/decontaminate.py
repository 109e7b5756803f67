"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's words are hashed, k of them together make a gram, and of every window of grams the least hash is
kept as fingerprint. With grams of ``k`` words and windows of ``span - k + 1`` grams, any shared run of ``span``
words has a whole window in common and hence a common fingerprint: no hit is missed. Fingerprints of
documents and of items are joined; texts with a hit are then compared word by word, so no
hit is wrong.

Items of fewer than ``SPAN`` words count as one window of their own length; each such length gets its
own, shorter fingerprints. Texts are known by a key made of their hashes, so that copies are compared once.

Defined results: null and wordless texts have no words and no hits; wordless items never occur; an item
without an id makes hits but is not counted or listed; items that share an id count as one; repeated
documents get a row each; without items nothing is hit. Only the named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmetrics.llm.common import ascii_lower, free_names, join_counted, let, table, text_key
from trailmetrics.session import materialise

SPAN = 10
GRAM = 4
#: Fixed value: what stands between words, after A-Z have been lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["key_a", "key_b"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _beside(values: Column, other: Column, shift: int, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine(values[i], other[i + shift])`` for every i that has both."""
    n = F.greatest(F.least(F.size(values), F.size(other) - shift), F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(other, F.lit(1 + shift), n), combine)


def _grams(hashes: Column, grams: Column, have: int, k: int, body: Callable[[Column], Column]) -> Column:
    if have == k:
        return body(grams)
    longer = _beside(grams, hashes, have, lambda a, b: F.xxhash64(a, b))
    return let(longer, lambda more: _grams(hashes, more, have + 1, k, body))


def _minima(values: Column, reach: int, window: int) -> Column:
    """The least of every ``window`` neighbours, from the least of every ``reach``."""
    if reach == window:
        return values
    step = min(reach, window - reach)
    wider = _beside(values, values, step, lambda a, b: F.least(a, b))
    return let(wider, lambda more: _minima(more, reach + step, window))


def fingerprints(all_words: Column, span: int, gram: int = GRAM) -> Column:
    """The distinct winnowing fingerprints; every run of ``span`` words has one of them."""
    k = min(gram, span)
    hashes = F.transform(all_words, lambda word: F.xxhash64(word))
    least = let(hashes, lambda h: _grams(h, h, 1, k, lambda grams: _minima(grams, 1, span - k + 1)))
    return F.array_distinct(least)


def item_windows(items: DataFrame, item_col: str, text_col: str, span: int) -> DataFrame:
    """``item_id, length, window`` of every window of every item, windows as space-joined words."""
    rows = items.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(span)))
    return rows.select("item_id", "length", F.explode_outer(_windows(F.col("words"), F.col("length"))).alias("window"))


def _windows(all_words: Column, length: Column) -> Column:
    last = F.size(all_words) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(all_words, i + 1, length), " "))


def hit_texts(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", span: int = SPAN,
) -> DataFrame:
    """A stored table with a row per text that an item's window occurs in: ``key_a, key_b, n_hit, item_ids``."""
    windows = materialise(item_windows(items, item_col, item_text_col, span), "windows")
    lengths = sorted(row.length for row in windows.select("length").distinct().collect())  # at most ``span``
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(*text_key(text), words(text).alias("words"))
    prints = windows.withColumn("words", F.split("window", " "))
    found = None
    for length in lengths:
        # explode_outer: of explode, Spark derives a filter that would compute the array twice
        wanted = prints.where(F.col("length") == length).select(
            F.explode_outer(fingerprints(F.col("words"), length)).alias("print")
        )
        of_docs = hashed.select(*KEY, F.explode_outer(fingerprints(F.col("words"), length)).alias("print"))
        hit = of_docs.join(wanted.distinct(), "print", "left_semi").select(*KEY)
        found = hit if found is None else found.unionAll(hit)
    if found is None:
        found = hashed.select(*KEY).limit(0)
    candidates = materialise(found.distinct(), "candidates")

    texts = join_counted(docs.select(*text_key(text), text.alias("text")), candidates, KEY, "left_semi")
    texts = texts.groupBy(*KEY).agg(F.first("text").alias("text")).select(*KEY, words(F.col("text")).alias("words"))
    texts = materialise(texts, "candidate-words")
    runs = None
    for length in lengths:
        every = texts.select(*KEY, F.posexplode_outer(_windows(F.col("words"), F.lit(length))).alias("start", "window"))
        same = windows.where(F.col("length") == length).select("item_id", "window")
        hit = every.join(same, "window").select(*KEY, "start", (F.col("start") + length).alias("end"), "item_id")
        runs = hit if runs is None else runs.unionAll(hit)
    if runs is None:
        runs = texts.select(*KEY, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("long").alias("item_id")).limit(0)
    runs = materialise(runs, "runs")

    before = W.partitionBy(*KEY).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = (
        runs.select(*KEY, "start", "end").distinct().withColumn("new", covered)
        .groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    )
    listed = (
        runs.where(F.col("item_id").isNotNull()).select(*KEY, F.col("item_id").cast("string").alias("item_id"))
        .distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    )
    none = F.array().cast("array<string>")
    hits = hits.join(listed, KEY, "left").withColumn("item_ids", F.coalesce("item_ids", none))
    return materialise(hits, "hits")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all columns, in which no window of an item occurs."""
    text, names = F.coalesce(F.col("text"), F.lit("")), free_names(docs.columns, *KEY)
    hits = hit_texts(docs, items).select(*KEY).toDF(*names)
    keyed = docs.withColumns(dict(zip(names, text_key(text))))
    return join_counted(keyed, hits, names, "left_anti").select(*docs.columns)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = hit_texts(docs, table(spark, sf_dir, "benchmark"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *text_key(text), F.size(words(text)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return join_counted(rows, hits, KEY, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("item_ids", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


OP10_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'
    ) AS words
    FROM documents
), items AS (
    SELECT item_id, words, least(len(words), 10) AS span
    FROM (
        SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'
        ) AS words
        FROM benchmark
    )
    WHERE len(words) > 0
), wanted AS (
    SELECT DISTINCT item_id, span, array_to_string(words[i:i + span - 1], ' ') AS run
    FROM (SELECT *, unnest(range(1, len(words) - span + 2)) AS i FROM items)
), held AS (
    SELECT row_id, span, i, array_to_string(words[i:i + span - 1], ' ') AS run
    FROM (
        SELECT row_id, words, span, unnest(range(1, len(words) - span + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT span FROM items) WHERE len(words) >= span
    )
), hits AS (
    SELECT row_id, h.span, i, item_id FROM held h JOIN wanted w ON h.span = w.span AND h.run = w.run
), places AS (
    SELECT row_id, count(DISTINCT place) AS n_hit
    FROM (SELECT row_id, unnest(range(i, i + span)) AS place FROM (SELECT DISTINCT row_id, span, i FROM hits)) GROUP BY row_id
), listed AS (
    SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (row_id) LEFT JOIN listed USING (row_id)
"""
