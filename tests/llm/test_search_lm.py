"""Clustering, lexical search and class-bigram scores against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpora import corpus, nothing  # noqa: F401

from kickframe.llm import classlm, clustering, search


def plain_lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]

    def place(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[place(x)[1]].append(x)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(centroids)]
    placed = [(i, *place(x)) for i, x in kept]
    by = Counter()
    for _, d, j in placed:
        by[j] += d
    return sorted((repr(i), j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in placed)


@pytest.mark.parametrize("width", [5, 3, 64])
def test_lloyd_is_the_plain_one(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.choice([-1, 0, 2]) + rng.gauss(0, 0.4) for _ in range(5)]) for i in range(120)]
    rows += [(500, None), (501, [0.1] * 4), (502, [0.1, None, 0.1, 0.1, 0.1]), (503, [float("nan")] * 5), (504, [float("inf")] * 5), (505, [])]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (601, [0.0] * 5), (602, [-0.0] * 5)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, row long").repartition(3)
    got = clustering.lloyd(table, clusters=6, rounds=4, dims=5, width=width).collect()
    assert sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == plain_lloyd(rows, 6, 4, 5)
    assert clustering.lloyd(table.where("1 = 0"), dims=5).count() == 0
    assert clustering.lloyd(table.where("vec_id < 3"), dims=5).where("distance = 0").count() == 3


def test_blocks_meet_assignments_without_a_shuffle(spark):
    table = spark.range(50).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> double(i * id)) AS embedding")
    kept = clustering.quantised(table, 8)
    blocks = clustering.Blocks.write(kept, 8, 4)
    assigned = clustering.assign(blocks, clustering.first_centroids(kept))
    plan = blocks.block(0).select("row", "x").hint("merge").join(assigned.select("row", "cluster"), "row")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of the partial distances


def test_a_round_takes_little_more_than_a_task_per_bucket(spark):
    table = spark.range(200).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> double(i * id % 17)) AS embedding")
    kept = clustering.quantised(table, 8)
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        blocks, first = clustering.Blocks.write(kept, 8, 4), clustering.first_centroids(kept)
        sc.setJobGroup("a-round", "")
        clustering.update(blocks, clustering.assign(blocks, first), first)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    status = sc.statusTracker()
    stages = {s for job in status.getJobIdsForGroup("a-round") for s in status.getJobInfo(job).stageIds}
    # A task per bucket sums the slices; two blocks once took two there and two for the distances.
    assert sum(info.numCompletedTasks for info in map(status.getStageInfo, stages) if info) < 2 * 40


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top):
    docs = [(d, Counter(plain_terms(t))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in docs:
            m = 10 + 90 * sum(c.values()) * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def shelf():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["ÄB", "Äb", "x_y", "é"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 8, 60])))) for i in range(1500)]
    docs += [(2000, None), (2001, ""), (2002, " .,; "), (2003, "w1 " * 40_000), (3, "w1 w2"), (3, "w1 w2"), (None, "w1 w5 ÄB"), (None, "w1 w5 ÄB")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for i in range(30)] + [(90, None), (91, "..."), (92, "unseen"), (93, "w1"), (94, " ".join(words)), (4, "w3")]
    return docs, items


@pytest.mark.parametrize(("shard", "blocks"), [(3000, 5), (1 << 20, 4000)])
def test_search_is_the_plain_ranking(spark, shelf, shard, blocks):
    docs, items = shelf
    table = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, score string, item long").repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    index = search.Index.write(table, shard_bytes=shard)
    got = index.search(wanted, most_items=blocks).collect()
    # A document that has its id in common with another is told apart by nothing but its score.
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == plain_search(docs, items, 10)
    assert index.search(wanted.where("1 = 0")).count() == 0
    assert search.Index.write(table.where("1 = 0")).search(wanted).count() == 0


def test_block_maxima_save_decompression():
    rng = random.Random(4)
    rare = [f"r{i}" for i in range(200)]
    texts = [(i, " ".join(["the"] * rng.randint(1, 3) + [rng.choice(rare) for _ in range(2)] + ["of"] * rng.randint(0, 2)).encode()) for i in range(4000)]
    texts += [(9000 + i, b"the special passage of words") for i in range(10)]
    q = search.Queries({t: i for i, t in enumerate([b"the", b"of", b"special", b"passage", b"words"])}, [np.arange(5)])
    row = search.build(texts)
    df = Counter(t for _, x in texts for t in set(x.split()))
    q.documents, q.words = len(texts), sum(len(x.split()) for _, x in texts)
    q.weight = np.array([math.floor(1000 * math.log((2 * q.documents + 2) / (2 * df[t] + 1))) for t in q.terms], np.int64)
    shard = search.Shard(row, q)
    docs, scores = shard.search(q.items[0], q.weight, 1, 10)
    everything = int((shard.span[:, 1] - shard.span[:, 0]).sum())
    assert shard.opened < everything / 2
    best = sorted(zip((-scores).tolist(), shard.ids[docs].tolist(), strict=True))[:10]
    assert [d for _, d in best] == list(range(9000, 9010))


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2_097_151, 2_097_152, 268_435_455, 268_435_456, 34_359_738_367], np.int64)
    data, begin = search.pack(values)
    assert (search.unpack(data) == values).all() and begin[0] == 0
    assert len(search.unpack(search.pack(values[:0])[0])) == 0


def plain_words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [""]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def plain_counts(rows):
    return Counter(w for d, t in rows if not held(d) for w in plain_words(t))


def test_class_scores_are_the_plain_ones(corpus, nothing):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    trained = classlm.Corpus.read(corpus, clusters=6, least=4, chunk_bytes=3000)
    kept = trained.exchange(3)
    assert kept == sorted(kept) and len(kept) > 1
    got = sorted(((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in trained.score().collect()))
    c, model = plain_counts(rows), trained.model
    n, v = sum(c.values()), len(c)
    # Classes of words, as the model has them.
    hashed = {h: i for i, h in enumerate(model.hashes.tolist())}
    keys = corpus.sparkSession.createDataFrame([(w.encode(),) for w in c if w], "w binary").selectExpr("w", "xxhash64(w) AS h").collect()
    kind = {r.w.decode(): model.classes[hashed[r.h]] if c[r.w.decode()] >= 4 else 6 + int(math.log2(c[r.w.decode()])) for r in keys}
    kind[""] = model.end
    size = np.zeros(model.width)
    for w, k in kind.items():
        size[k] += c[w] + 1
    size[6] += 1
    assert size.sum() == n + v + 1 and np.allclose(size, model.sizes)
    follows = Counter()
    for d, t in rows:
        if not held(d):
            ks = [kind[w] for w in plain_words(t)]
            follows.update(zip([model.end, *ks], ks))
    lead = Counter()
    for (a, _), x in follows.items():
        lead[a] += x
    want = []
    for d, t in rows:
        words = plain_words(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        score, before = 0.0, model.end
        for w in words:
            k = kind.get(w, 6)
            score += math.log10((follows[before, k] + classlm.ALPHA * size[k] / size.sum()) / (lead[before] + classlm.ALPHA) * (c[w] + 1) / size[k])
            before = k
        want.append((repr(d), held(d), len(words), sum(c[w] > 0 for w in words), n, base, score))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert classlm.scores(nothing).count() == 0


def test_probabilities_sum_to_one(corpus):
    trained = classlm.Corpus.read(corpus, clusters=5, least=4)
    trained.exchange(2)
    share = trained.model.sizes / trained.model.sizes.sum()
    follows, size = trained.model.logs()
    # All words of a class share it whole, the unknown word included, so classes after a class sum to one.
    assert np.allclose((10 ** follows).sum(1), 1) and np.allclose(10 ** size / trained.model.sizes.sum(), share)


def test_every_word_seen_twice_is_exchanged(corpus):
    """Words seen once are in the class of the unknown word, all others in an exchanged one."""
    trained = classlm.Corpus.read(corpus)
    trained.exchange(1)
    model, c = trained.model, plain_counts([(r.doc_id, r.text) for r in corpus.collect()])
    assert sorted(model.counts.tolist()) == sorted(n for w, n in c.items() if w and n > 1)
    assert any(n == 1 for n in c.values()) and any(2 <= n < 16 for n in c.values())
    counts, number = np.array([5, 0, 1, 2, 15]), np.array([-1, -1, -1, 0, 1])
    assert model.class_of(counts, number).tolist() == [model.end, model.clusters, model.clusters, *model.classes[:2]]


def test_held_out_texts_change_nothing(spark):
    rows = [(i, f"a b c d{i % 5} e{i % 3} a b") for i in range(200)]
    changed = [(d, "other words here" if held(d) else t) for d, t in rows]
    score = lambda data: {r.doc_id: (r.base_score, r.score) for r in classlm.scores(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    one, two = score(rows), score(changed)
    assert all(one[d] == two[d] for d, _ in rows if not held(d))


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(100) if held(i)][:3]
    got = classlm.scores(spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 3


def test_exchange_finds_the_best_move_of_a_word():
    """The gain of a move equals the difference of whole likelihoods."""
    rng = random.Random(1)
    words, kinds = list(range(12)), 4
    text = [rng.choice(words) for _ in range(400)]
    old = np.array([rng.randrange(kinds) for _ in words])

    def matrix(classes):
        m = np.zeros((kinds + 1, kinds + 1), np.int64)
        np.add.at(m, ([kinds, *classes[text]], [*classes[text], kinds]), 1)
        return m
    table = np.zeros((len(words), 2 * (kinds + 1) + 1), np.int64)
    k = [kinds, *old[text], kinds]
    for i, w in enumerate(text):
        table[w, 1 + k[i]] += 1
        table[w, 2 + kinds + k[i + 2]] += 1
        table[w, 0] += i + 1 < len(text) and text[i + 1] == w
    new = classlm.best_classes(matrix(old), old, table[:, 1:kinds + 2], table[:, kinds + 2:], table[:, 0], kinds)
    for w in words:
        each = []
        for b in range(kinds):
            moved = old.copy()
            moved[w] = b
            each.append(classlm.likelihood(matrix(moved)))
        assert each[new[w]] == pytest.approx(max(each), abs=1e-6)
