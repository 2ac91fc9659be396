"""Exact and near duplicates against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
from brute import brute, normal, shingles
from corpora import corpus, nothing  # noqa: F401

from kickframe.llm import components, exact_dedup, minhash


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, k) for k in range(200, 260)] + [(3, 3), (5, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, 7: 7, **{k: 7 for k in range(200, 260)}}


def test_components_of_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups(corpus):
    rows = exact_dedup.digest_rows(corpus)
    index = exact_dedup.DigestIndex(corpus.sparkSession, buckets=4)
    index.ingest(rows)
    got = index.resolve(rows).collect()
    groups = defaultdict(list)
    for r in corpus.collect():
        groups[normal(r.text)].append(r.doc_id)
    assert len(got) == corpus.count()
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_digest[r.digest]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
        kept[r.digest] += r.kept
    assert set(kept.values()) == {1}


def test_index_grows_by_what_is_new(corpus):
    spark = corpus.sparkSession
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(9, "a b"), (4, "c")], "doc_id long, text string")
    index.ingest(exact_dedup.digest_rows(first))
    second = spark.createDataFrame([(2, "a  b"), (3, "d"), (1, "d")], "doc_id long, text string")
    rows = exact_dedup.digest_rows(second)
    index.ingest(rows)
    index.ingest(rows)  # a repeated run adds nothing
    assert sorted(r.doc_id for r in index.entries().collect()) == [1, 4, 9]
    assert {r.doc_id: (r.keep_id, r.kept) for r in index.resolve(rows).collect()} == {2: (9, False), 3: (1, False), 1: (1, True)}
    plan = rows.hint("merge").join(index.entries().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_another_session_opens_the_index(corpus):
    spark = corpus.sparkSession
    first = exact_dedup.DigestIndex(spark, buckets=4)
    rows = exact_dedup.digest_rows(corpus)
    first.ingest(rows)
    other = exact_dedup.DigestIndex(spark.newSession(), path=first.path, buckets=4)
    known = other.entries().count()
    assert known == first.entries().count() > 0
    other.ingest(rows)
    assert other.entries().count() == known


def test_an_append_writes_a_file_per_bucket(corpus):
    spark = corpus.sparkSession
    index = exact_dedup.DigestIndex(spark, buckets=4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        index.ingest(exact_dedup.digest_rows(corpus.repartition(31)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(index.entries().inputFiles()) <= 4


def test_exact_dedupe_keeps_one_row_and_all_columns(corpus, nothing):
    out = exact_dedup.dedupe(corpus)
    assert out.columns == corpus.columns
    texts = [normal(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({normal(r.text) for r in corpus.collect()})
    assert exact_dedup.dedupe(nothing).count() == 0


def test_near_groups(corpus, nothing):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    for k in (4, 5):
        want, got = brute(rows, k), minhash.near_duplicates(corpus, words=k).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == want.get(r.doc_id)
            assert r.kept == (r.doc_id == r.component_id)
        sizes = {r.doc_id: r.n_shingles for r in got if r.doc_id is not None}
        assert all(sizes[d] == len(shingles(t, k)) for d, t in rows if d is not None)
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_copies_far_from_the_hub(spark, monkeypatch):
    """A large group in which few pairs are linked, compared in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(70):
        words = list(base)
        for k in range(1 + i % 3):
            words[(7 * i + 19 * k) % 60] = f"y{i}_{k}"
        rows.append((i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=3).collect()}
    assert got == brute(rows, 3)


def test_a_hot_bucket_of_unlike_sizes(spark, monkeypatch):
    """All documents of a group share buckets, but sizes part it in many components."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "_bands", lambda signature, bands, rows: np.ones((len(signature), bands), np.int64))
    base = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(base[:n])) for n in (*range(5, 60, 3), *range(60, 400, 40))]
    rows += [(1000 + n, " ".join(base[:n] + [f"z{n}"])) for n in range(5, 400, 27)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 3)


def test_near_dedupe_keeps_columns(corpus):
    out = minhash.dedupe(corpus)
    want = brute([(r.doc_id, r.text) for r in corpus.collect()], 5)
    assert out.columns == corpus.columns
    assert {r.doc_id for r in out.collect()} == {d for d, c in want.items() if d == c} | {None}
