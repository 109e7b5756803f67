"""Packing, search, sharding, scores and the pipeline against plain versions."""

from __future__ import annotations

import math
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import LOWERED, awkward, documents, folder, prose, rows
from trailmetrics.llm import quality, sharding
from trailmetrics.llm.lm import heaps_exponent, score_documents
from trailmetrics.llm.packing import op1_best_fit, pack, pack_documents
from trailmetrics.llm.pii import redact_documents
from trailmetrics.llm.quality import (
    BUCKETS,
    FOLDS,
    REACH,
    WIDTH,
    fit,
    good_documents,
    index_vectors,
    op9_random_indexing,
    pooled,
    token_vectors,
)
from trailmetrics.llm.simhash import op4_vantage_simhash
from trailmetrics.llm.sharding import first_map, load_map, op6_virtual_slots, rebalance, shard_documents
from trailmetrics.llm.topk import op2_threshold_top_k


def plain_pack(sizes, bits, capacity):
    space, held, out = [], [], []
    for size, own in zip(sizes, bits):
        fitting = [(space[i], i) for i in range(len(space)) if space[i] >= size and not held[i] & own]
        i = min(fitting)[1] if fitting else len(space)
        if not fitting:
            space.append(capacity)
            held.append(0)
        out.append((i, capacity - space[i]))
        space[i] -= size
        held[i] |= own
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_a_search_of_all_bins(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(1, 65, size=400).tolist(), reverse=True)
    bits = [2 << int(rng.integers(3 + 4 * seed)) | (1 << 40 + int(rng.integers(60))) * int(rng.integers(2)) for _ in sizes]
    assert list(zip(*pack(sizes, bits, 64))) == plain_pack(sizes, bits, 64)


def test_packed_documents_are_whole_and_without_conflicts(spark):
    docs = documents(spark, awkward())
    placed = pack_documents(docs, capacity=128, shard_rows=10)
    tokens = {(d, len((t or "").split()) + 1) for d, t in awkward()}
    whole = placed.groupBy("doc_id").agg(F.sum("tokens")).collect()
    repeats = Counter(d for d, _ in awkward())
    for doc_id, total in whole:
        assert repeats[doc_id] > 1 or (doc_id, total) in tokens
    by_bin: dict = {}
    for row in placed.collect():
        by_bin.setdefault((row.shard, row.bin), []).append((row.bin_offset, row.tokens))
    for parts in by_bin.values():
        ends = np.cumsum([size for _, size in sorted(parts)])
        assert [start for start, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 128
    source = {r.doc_id: r.source for r in docs.where("doc_id IS NOT NULL AND doc_id <> 3").collect()}
    for key in by_bin:
        own = [source[r.doc_id] for r in placed.where(f"shard = {key[0]} AND bin = {key[1]}").collect() if source.get(r.doc_id)]
        assert len(own) == len(set(own))
    assert op1_best_fit(spark, folder(spark, documents=documents(spark, []))).count() == 0


def test_near_copies_share_no_sequence(spark):
    copies = [(i, prose(77, 40) + (f" end{i}" if i % 2 else "")) for i in range(8)]
    given = [*copies, *((100 + i, prose(i, 30)) for i in range(40)), (200, None), (201, "")]
    docs = documents(spark, given, sources=60)
    component = {r.doc_id: r.component_id for r in op4_vantage_simhash(spark, folder(spark, documents=docs)).collect()}
    assert len({component[i] for i in range(8)}) < 8
    placed = op1_best_fit(spark, folder(spark, documents=docs)).collect()
    assert sorted(r.doc_id for r in placed) == sorted(d for d, _ in given)
    held: dict = {}
    for row in placed:
        held.setdefault((row.shard, row.bin), []).append(component[row.doc_id])
    assert all(len(own) == len(set(own)) for own in held.values())
    sizes = [len((t or "").split()) + 1 for _, t in given]
    order = sorted(range(len(given)), key=lambda i: (-sizes[i], given[i][0]))
    numbers = {c: i for i, c in enumerate(sorted({*component.values()}))}
    sources = {r.doc_id: r.source for r in docs.collect()}
    shared = {s: 1 << (100 + i) for i, s in enumerate(sorted({x for x in sources.values() if x}))}
    bits = [(1 << numbers[component[given[i][0]]]) | shared.get(sources[given[i][0]], 0) for i in order]
    assert len(held) == len({b for b, _ in plain_pack([sizes[i] for i in order], bits, 2_048)})


VECTORS = [
    *((i, [float(x) for x in np.random.default_rng(i).normal(0, 0.1, 6)]) for i in range(0, 120)),
    (200, None), (201, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [9.0] * 6),
    (250, [0.1] * 3), (251, [0.1] * 3), (252, [0.2] * 3), (300, []), (301, []), (350, [0.5] * 6), (351, [0.5] * 6), (351, [0.5] * 6), (400, [-1.5] * 6),
]


def test_top_k_equals_all_products(spark):
    table = spark.createDataFrame([(i, v, 0) for i, v in VECTORS], "vec_id long, embedding array<float>, v int")
    usable = []
    for vec_id, v in VECTORS:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v]))
    expected = []
    for query_id, q in usable:
        if query_id % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in usable if i != query_id and len(v) == len(q))
            expected += [(query_id, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:5])]
    path = folder(spark, embeddings=table)
    assert rows(op2_threshold_top_k(spark, path)) == sorted(expected, key=repr)
    assert op2_threshold_top_k(spark, folder(spark, embeddings=table.limit(0))).count() == 0


def test_shards_are_even_in_bytes_and_gapless(spark):
    given = [*awkward(), *((1_000 + i, prose(i, 5 + i % 9)) for i in range(600))]
    found = op6_virtual_slots(spark, folder(spark, documents=documents(spark, given))).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted(
        (d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in given
    )
    for shard in range(8):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    loads = [sum(r.size for r in found if r.shard == shard) for shard in range(8)]
    longest = max(len((t or "").encode()) for _, t in given)
    assert sorted(loads)[-2] - min(loads) < 200 and max(loads) <= max(longest + 1, min(loads) + 200)
    assert op6_virtual_slots(spark, folder(spark, documents=documents(spark, []))).count() == 0


def test_a_stored_map_is_edited_in_versions(spark):
    docs = documents(spark, [(i, prose(i, 8)) for i in range(300)])
    path = folder(spark) + "/map"
    from trailmetrics.llm.sharding import store_map

    store_map(spark, path, first_map(4))
    shard_documents(docs, 4, map_path=path).count()
    shard_documents(docs, 5, map_path=path).count()
    assert {r.version for r in spark.read.parquet(path).select("version").distinct().collect()} == {1, 2, 3}
    before, after = ({r.virtual_slot: r.shard for r in load_map(spark, path, v).collect()} for v in (2, 3))
    moved = [slot for slot in before if before[slot] != after[slot]]
    assert set(after.values()) == set(range(5)) and len(moved) < len(before) / 3


def test_rebalancing_moves_little_and_only_between_full_and_spare():
    sizes = [1] * 64
    sizes[0] = 40
    new = rebalance(first_map(4, 64), sizes)
    loads = [sum(s for s, shard in zip(sizes, new.shard_of) if shard == k) for k in range(4)]
    assert max(loads[1:]) - min(loads[1:]) <= 1 and new.version == 2


def test_scores_equal_a_plain_model_and_sum_to_one(spark):
    given = [(i if i is None or i > 20 else i + 100, t) for i, t in awkward()] + [(40 + i, prose(i % 7, 25)) for i in range(20)]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    tokens = [(d, (t or "").translate(LOWERED).encode().split() + [b"\n"]) for d, t in given]
    words = Counter(w for d, ws in tokens if not held(d) for w in ws)
    pairs = Counter(p for d, ws in tokens if not held(d) for p in zip([b"\n", *ws], ws))
    n, v = sum(words.values()), len(words)
    grid = np.linspace(0, 1, 65)
    beta = heaps_exponent(len(pairs), np.array([sum(c**b for c in words.values()) for b in grid]))
    base = lambda w: (words[w] + 0.1) / (n + 0.1 * (v + 1))

    def chance(h, w):
        return base(w) if not words[h] else (pairs[h, w] + words[h] ** beta * base(w)) / (words[h] + words[h] ** beta)

    assert abs(sum(chance(b"the", w) for w in [*words, b"unknown"]) - 1) < 1e-9
    expected = sorted(
        ((d, held(d), len(ws), sum(w in words for w in ws), n, sum(math.log10(base(w)) for w in ws), sum(math.log10(chance(h, w)) for h, w in zip([b"\n", *ws], ws)))
         for d, ws in tokens), key=lambda r: (repr(r[:3]), r[5]))
    docs = documents(spark, given)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    found = sorted(map(tuple, score_documents(docs, held_out, block_tokens=900).collect()), key=lambda r: (repr(r[:3]), r[5]))
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-9)
    assert score_documents(documents(spark, []), F.lit(False)).count() == 0
    assert all(r.score == 0 for r in score_documents(docs, F.lit(True)).collect())


def labelled():
    """Half prose, half shouting or symbols; labels for all rows."""
    for i in range(240):
        words = prose(i, 60).split()
        good = i % 2 == 0
        yield 1_000 + i, " ".join(words if good else [w.upper() + "!!" if i % 4 == 1 else w + "$$$" for w in words]), int(good)


def test_quality_on_rows_it_has_not_seen_and_on_awkward_ones(spark):
    data = list(labelled())
    docs = documents(spark, [*((d, t) for d, t, _ in data), *awkward()])
    labels = spark.createDataFrame([*((d, q, 0) for d, _, q in data), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    path = folder(spark, documents=docs, labels=labels)
    found = op9_random_indexing(spark, path).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    truth = {d: q for d, _, q in data}
    unseen = [r for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % FOLDS == 0]
    assert all(r.held_out for r in unseen) and len(unseen) > 20
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.95 * len(unseen)
    none = op9_random_indexing(spark, folder(spark, documents=docs, labels=labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}


def test_quality_ignores_labels_of_the_held_out_fold(spark):
    data = list(labelled())
    turned = [(d, (1 - q) if zlib.crc32(str(d).encode()) % FOLDS == 0 else q, 0) for d, _, q in data]
    docs = documents(spark, [(d, t) for d, t, _ in data])
    schema = "doc_id long, quality int, toxic int"
    paths = [folder(spark, documents=docs, labels=spark.createDataFrame(rows_, schema)) for rows_ in ([(d, q, 0) for d, _, q in data], turned)]
    one, two = (rows(op9_random_indexing(spark, path)) for path in paths)
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert np.allclose([r[2] for r in one], [r[2] for r in two])


def test_a_model_of_one_class_stays_in_range():
    model = fit(np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((12, 2 * WIDTH)), [1] * 12)
    assert 0.5 < float(model.probabilities(np.zeros((1, 2 * WIDTH)))[0]) <= 1


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    data = list(labelled())
    clean = [(d, t) for d, t, q in data if q]
    given = [*((d, t) for d, t, _ in data), (5_000, clean[0][1]), (5_001, prose(900, 30) + " " + prose(901, 40)), (5_002, "mail me at jo@ex.org " + prose(902, 40))]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t)) for d, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in data], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, prose(901, 40))], "item_id long, text string")
    path = folder(spark, documents=docs, labels=labels, benchmark=benchmark)
    left, ids = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, path).persist()
        assert left.columns == docs.columns
        ids.append({r.doc_id for r in left.collect()})
    good = {d for d, _ in clean}
    assert len(good & ids[0]) >= 0.98 * len(good) and len(ids[0] - good - {5_000, 5_001, 5_002}) <= 3
    assert ids[0] - ids[1] == {5_000} and ids[1] - ids[2] == {5_001} and ids[2] == ids[3]
    assert left.where("doc_id = 5002").first().text.startswith("mail me at [EMAIL] ")
    packed = corpus_pipeline.STAGES[-1][1](spark, left, path)
    assert {r.doc_id for r in packed.collect()} == ids[3]
    assert rows(corpus_pipeline.run(spark, path).select("doc_id", "piece", "tokens")) == rows(packed.select("doc_id", "piece", "tokens"))


def buckets_of(word):
    return tuple(quality.streams_of([word])[0][:, 0].tolist())


def plain_vectors(texts):
    index = index_vectors(quality.SEED)
    total = np.zeros((BUCKETS, WIDTH))
    for text in texts:
        words = (text or "").split()
        shapes = [quality._AGAIN if i and words[i - 1] == word else buckets_of(word)[1] for i, word in enumerate(words)]
        for stream in ([buckets_of(word)[0] for word in words], shapes):
            for i, centre in enumerate(stream):
                for j in range(max(0, i - REACH), min(len(stream), i + REACH + 1)):
                    if j != i:
                        total[centre] += index[stream[j]]
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return total / np.where(length > 0, length, 1)


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_word_vectors_are_sums_over_all_documents(spark, monkeypatch, parts):
    monkeypatch.setattr(quality, "MERGED", 4)
    given = [(i, text if text is None else text[:900]) for i, text in awkward()] + [(90, "Word word word WORD!! 12 12 " + "w" * 200)]
    docs = documents(spark, given).repartition(parts)
    assert np.allclose(token_vectors(docs), plain_vectors([text for _, text in given]), atol=1e-6)
    assert not token_vectors(docs.limit(0)).any()


def test_pooled_vectors_are_means_over_both_streams():
    vectors = np.random.default_rng(3).normal(size=(BUCKETS, WIDTH)).astype(np.float32)
    for text in ("", "a", "Some words some words words, Aa!! 99 99 99", "x" * 500 + " y"):
        words = text.split()
        want = np.zeros(2 * WIDTH)
        for i, word in enumerate(words):
            shape = quality._AGAIN if i and words[i - 1] == word else buckets_of(word)[1]
            want += np.concatenate([vectors[buckets_of(word)[0]], vectors[shape]]) / len(words)
        assert np.allclose(pooled(["", text, "two words"], vectors)[1], want, atol=1e-5)


def test_sums_of_a_word_said_over_and_over():
    sums = quality.TokenSums()
    sums.add(["a " * 9_000 + "b", "a a"])
    one = quality.index_vectors(quality.SEED)[buckets_of("a")[0]].astype(int)
    two = quality.index_vectors(quality.SEED)[buckets_of("b")[0]].astype(int)
    assert (sums.total[buckets_of("b")[0]] == 2 * one).all()
    assert (sums.total[buckets_of("a")[0]] == (2 * (8_999 + 8_998) + 2) * one + 2 * two).all()


def test_features_do_not_depend_on_what_stands_around_a_word(monkeypatch):
    texts = [prose(i, 4) + " again again" for i in range(20)] + ["", " ", "Grüße ÀÉ×÷ß", "x" * 300, "(a) 'B' !!! 12a"]
    alone = [quality.streams_of([text]) for text in texts]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(quality, "PIECE", piece)
        streams, counts = quality.streams_of(texts)
        assert counts.tolist() == [len(text.split()) for text in texts]
        assert streams.tolist() == np.concatenate([own for own, _ in alone], axis=1).tolist()
    assert quality.streams_of([])[0].shape == (2, 0)


def test_the_shape_of_a_word_is_that_of_all_of_it():
    assert buckets_of("a" * 70 + "!")[1] != buckets_of("a" * 70)[1]
    def same(i, *words):
        return len({buckets_of(word)[i] for word in words}) == 1

    assert same(0, "Word", "word!", "(WORD)", '"word".') and same(0, "ÀÉ", "àé") and not same(0, "word", "words")
    assert same(1, "ab", "wxyz", "ßü") and same(1, "Ab", "Wxyz", "Éa") and same(1, "12", "9") and same(1, "AB12!", "Z9!")
    assert not same(1, "ab", "Ab") and not same(1, "a!", "a!!") and not same(1, "×", "Á")
    assert same(0, "!!!", "?") and not same(1, "!!!", "?")



#: Every name that an operator gives a column of its own.
INTERNAL = (
    "key_a key_b nameless some_id fp first label node spans kept quality score pooled print words start end item_ids n_hit slot shard"
    " __slot __shard __key_a __key_b __id __nameless __quality virtual_slot doc positions text_hash cluster piece tokens source_"
).split()


def test_no_stage_touches_a_column_of_the_users(spark):
    base = documents(spark, [*((d, t) for d, t, _ in labelled()), *awkward()]).select("doc_id", "text", "lang", "source", "n_chars")
    docs = base.select("*", *[F.lit(f"mine {name}").alias(name) for name in INTERNAL])
    path = folder(
        spark, labels=spark.createDataFrame([(d, q, 0) for d, _, q in labelled()], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, prose(2, 40))], "item_id long, text string"),
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, path)
        assert left.columns == docs.columns, name
        kept = left.select(*INTERNAL).distinct().collect()
        assert kept and all(tuple(row) == tuple(f"mine {x}" for x in INTERNAL) for row in kept), name
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/shards"
    sharding.write_shards(docs, slot_map(spark), out, "doc_id", "text")
    written = spark.read.parquet(out)
    assert written.count() == docs.count() and written.select(*INTERNAL).distinct().count() == 1


def slot_map(spark):
    return spark.createDataFrame([(1, slot, slot % 3) for slot in range(64)], sharding.MAP_SCHEMA)


def test_good_documents_of_awkward_and_empty_tables(spark):
    docs = documents(spark, [*((d, t) for d, t, _ in labelled()), *awkward()])
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in labelled()], "doc_id long, quality int, toxic int")
    path = folder(spark, labels=labels)
    left = good_documents(spark, docs, path)
    assert left.columns == docs.columns and 0 < left.count() < docs.count()
    assert good_documents(spark, docs.limit(0), path).count() == 0
    assert good_documents(spark, docs, folder(spark, labels=labels.limit(0))).count() == docs.count()  # a score of 0.5


def test_marks_in_texts_with_very_many_spans(spark):
    text = " ".join(f"a{i}@ex.org é{i}" for i in range(3_000))
    docs = documents(spark, [(1, text), (2, "a@b.org"), (3, "none"), (4, None)])
    found = {row.doc_id: row.text for row in redact_documents(docs).collect()}
    assert found[1] == " ".join(f"[EMAIL] é{i}" for i in range(3_000))
    assert (found[2], found[3], found[4]) == ("[EMAIL]", "none", None)


def test_pipeline_of_awkward_and_empty_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows, ids that come twice; and tables without rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    given = [(d, t, "en", f"s{d % 3}", len(t)) for d, t, _ in labelled()]
    odd = [(d, t, None, None, None) for d, t in awkward()]
    docs = spark.createDataFrame([*given, *odd, *odd[4:7]], schema)
    labels = spark.createDataFrame([*((d, q, 0) for d, q in ((d, q) for d, _, q in labelled())), (None, None, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, prose(4, 60)), (None, None), (2, "")], "item_id long, text string")
    path = folder(spark, documents=docs, labels=labels, benchmark=benchmark)
    packed = corpus_pipeline.run(spark, path)
    kept = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens")).collect()
    ids = {row.doc_id for row in kept}
    assert ids <= {d for d, *_ in [*given, *odd]} and 13 not in ids  # its passage is an item's
    for empty in ("documents", "labels", "benchmark"):
        tables = {"documents": docs, "labels": labels, "benchmark": benchmark}
        tables[empty] = tables[empty].limit(0)
        found = corpus_pipeline.run(spark, folder(spark, **tables))
        assert (found.count() == 0) == (empty == "documents"), empty
