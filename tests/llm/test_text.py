"""Classifiers, chat, archives, mixing and vectors on small inputs."""

import base64
import hashlib
import inspect
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from corpora import corpus, nothing  # noqa: F401
from pyspark.sql import functions as F

from kickframe.llm import chat, mixing, queries, quality, toxicity, vectors, warc

SMALL = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(score) + 0.5


@pytest.mark.parametrize(("module", "target", "least"), [(quality, "quality", 0.98), (toxicity, "toxic", 0.95)])
def test_held_out_scores(spark, module, target, least):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = module.score(docs, module.train(docs, labels)).join(labels.select("doc_id", target), "doc_id", "left").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r[target] is not None]
    assert auc(np.array([r.score for r in held]), np.array([r[target] for r in held])) >= least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_odd_rows(spark, corpus, nothing, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert module.score(corpus, module.train(corpus, labels)).count() == corpus.count()
    none = module.train(corpus, labels.where("1 = 0"))
    assert {r.score for r in module.score(corpus, none).collect()} == {0.5}
    one = module.train(corpus, labels.where("quality = 1"))
    assert len({r.score for r in module.score(corpus, one).collect()}) == 1
    assert module.score(nothing, module.train(nothing, labels)).count() == 0


def test_same_sample_same_model(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(7), labels.repartition(3))
    assert (a.weight == b.weight).all() and (a.factor == b.factor).all()


def test_factors_learn_what_weights_cannot():
    rng = np.random.default_rng(1)

    def text():
        words, a, b = [f"w{i}" for i in rng.zipf(1.3, 40) % 3000], *rng.integers(2, size=2)
        return " ".join([*words, ("insult", "praise")[a], ("group", "other")[b]]), int(a == b)
    train, held = [text() for _ in range(4000)], [text() for _ in range(500)]
    y = np.array([y for _, y in held])

    def accuracy(**settings):
        m = toxicity.fit(toxicity.terms([t for t, _ in train]), np.array([y for _, y in train], float), paired=(0.01, 1.0), **settings)
        return ((m.scores(toxicity.terms([t for t, _ in held])) >= 0.5) == y).mean()
    assert accuracy() > 0.9 > 0.7 > accuracy(factor_rate=0.0)


def test_sample_is_whole_and_held_once():
    assert inspect.signature(toxicity.train).parameters["rows"].default == 20_000
    rng = np.random.default_rng(5)
    apart = [np.unique(rng.integers(0, 3000, 600)).astype(np.int32) for _ in range(20_000)]
    y = rng.integers(2, size=len(apart)).astype(float)
    flat = toxicity.Rows.of(apart)
    tracemalloc.start()
    m = toxicity.fit(flat, y, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < flat.ids.nbytes  # tables of fixed size and one batch, no second copy of the terms
    n = toxicity.fit(apart, y, epochs=1)
    assert m.bias == n.bias and (m.weight == n.weight).all()


def test_reject_keeps_clean_rows(corpus):
    machine = toxicity.Machine(-1.0, np.zeros(1 << toxicity.BITS, np.float32), np.zeros((1 << toxicity.BITS, toxicity.FACTORS), np.float32))
    machine.weight[toxicity.terms(["one"])[0]] = 5
    out = toxicity.reject(corpus, machine)
    assert out.columns == corpus.columns
    assert corpus.count() - out.count() == 2


def turns_of(spark):
    odd = ["<|im_end|>", "<\\|", "<\\\\|im_start|>", "", None, "a\nb", "\\n", "<|im_end|>\n<|im_start|>assistant\nok", "😀 é", "x" * 3000]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb\\", "<|x|>", None]), rng.choice(odd), 1)
            for c in [*range(12), None] for t in range(rng.randint(1, 9))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t} <|im_end|>" * 20, 1) for t in range(400)]  # half of all rows
    rows += [(5, None, "user", "no turn", 1), (5, 0, "user", "again", 1), (5, 0, "user", "again", 1)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(4)


@pytest.mark.parametrize("segment", [200, 1 << 20])
def test_chat_round_trip(spark, segment):
    rows = turns_of(spark)
    convs = defaultdict(list)
    for r in rows.collect():
        convs[r.conv_id].append((r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or ""))
    got = {r.conv_id: r for r in chat.read_digests(chat.format_conversations(rows, segment=segment)).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_digests(chat.format_conversations(rows.where("1 = 0"))).count() == 0


def pages_of(spark):
    rows = [(i, f"http://x/{i}%0A\r\n" if i % 3 else None, ["a", "bé", "", None, f"page {i}"][i % 5], 1) for i in range(60)]
    rows += [(7, "http://y", "same", 1), (7, "http://y", "same", 1), (None, "u", "a", 1), (None, "u", "no twin", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha int").repartition(5)


def test_archives(spark):
    pages = pages_of(spark)
    archive = warc.Archive.write(pages, roll=500)
    got = archive.read().collect()
    rows = [(r.page_id, r.url, (r.html or "").encode()) for r in pages.collect()]
    low = {}
    for p, _, b in rows:
        if p is not None:
            low[b] = min(low.get(b, p), p)
    seen, want = set(), Counter()
    for p, u, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        first = low.get(b)
        again = first is not None and (p != first or (p, b) in seen)
        seen.add((p, b))
        want[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None, u,
             None if again else b] += 1
    assert Counter((*tuple(r)[:6], None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert archive.manifest.count() > 3
    # Other partitions, the same bytes.
    again = warc.Archive.write(pages.repartition(2), roll=500).manifest.drop("file")
    assert sorted(again.collect()) == sorted(archive.manifest.drop("file").collect())
    plain = warc.Archive.write(pages, least=3).read()
    assert {r.record_type for r in plain.where("payload_bytes < 3").collect()} == {"response"}
    assert warc.Archive.write(pages.where("1 = 0")).read().count() == 0


def test_mixing_agrees_with_sql(spark, corpus, nothing):
    con = duckdb.connect()
    con.register("documents", corpus.toArrow())
    result = con.execute(queries.ORACLES["op5_mixing"])
    names = [c[0] for c in result.description]
    want = Counter(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in result.fetchall())
    got = mixing.select(corpus, queries.MIX)
    assert Counter(tuple(r[c] for c in sorted(names)) for r in got.collect()) == want
    taken = Counter(r.doc_id for r in mixing.mix(corpus, queries.MIX).collect())
    expected = Counter()
    for r in got.collect():
        expected[r.doc_id] += r.copies
    assert taken == +expected
    assert mixing.mix(corpus, queries.MIX).columns == corpus.columns
    assert mixing.mix(nothing, queries.MIX).count() == 0


def test_shortages_go_to_siblings_first(spark):
    rows = [(i, "t " * 10, "en", s) for i, s in enumerate(["a1"] * 1 + ["a2"] * 50 + ["b1"] * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    recipe = mixing.Recipe(budget=0.4, domains={"a1": "a", "a2": "a", "b1": "b"})
    got = {r.source: r.t for r in mixing.select(docs, recipe).where("copies > 0").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert got == {"a1": 10, "a2": 190, "b1": 200}  # 404 tokens: each domain 202, in whole documents


def vectors_of(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        centre = rng.standard_normal(16)
        for k in range(5):
            v = centre + rng.standard_normal(16) * rng.choice([0.1, 0.25, 0.4])
            rows.append((10 * i + k, [float(x) for x in v.astype(np.float32)], i % 3 if i % 10 else None, 1))
    base = rows[0][1]
    rows += [(9000 + k, [2 * x for x in base], 1, 1) for k in range(30)] + [(9100, base, 1, 1), (9100, base, 1, 1)]
    rows += [(9200, None, 1, 1), (9201, [], 1, 1), (9202, [0.0] * 16, 1, 1), (9203, [math.nan] * 16, 1, 1), (9204, [None] * 16, 1, 1),
             (9205, [1.0, 0.0], 1, 1), (9206, [2.0, -0.0], 1, 1), (9207, [math.inf] * 16, 1, 1), (None, base, 1, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, mult int").repartition(4)


@pytest.mark.parametrize(("blocks", "chunk"), [(8, 1500), (3, 7)])
def test_vector_links(spark, blocks, chunk):
    frame = vectors_of(spark)
    rows = [r for r in frame.collect()]
    usable = [(n, r) for n, r in enumerate(rows) if r.vec_id is not None and r.label is not None and r.embedding
              and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    links, near = Counter(), defaultdict(set)
    for i, (n, a) in enumerate(usable):
        for m, b in usable[:i]:
            if a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, float), np.array(b.embedding, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[n] += 1
                    links[m] += 1
                    near[a.vec_id].add(b.vec_id)
                    near[b.vec_id].add(a.vec_id)
    component = {}
    for v in sorted(near):
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = v
                todo += near[x]
    want = Counter((r.vec_id, links[n], component.get(r.vec_id, r.vec_id)) for n, r in enumerate(rows))
    got = vectors.near_duplicates(frame, blocks=blocks, chunk=chunk).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_duplicates(frame.where("1 = 0")).count() == 0


def test_a_pair_at_the_edge_of_a_block_meets(spark):
    # One-dimensional blocks; the first coordinates are apart by what just passes, from one slab's end to the next but one's start.
    x, y = [np.array([first, math.sqrt(1 - first ** 2), *[0.0] * 6]) @ vectors.rotation(8).T for first in (-1e-6, 0.132309)]
    frame = spark.createDataFrame([(1, x.tolist(), 0), (2, y.tolist(), 0)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_leaves_meet_all_that_is_within_reach():
    rng = np.random.default_rng(11)
    x, y = (rng.standard_normal((n, 8)).astype(np.float32) / 8 for n in (700, 400))
    for other in (None, y):
        z = x if other is None else other
        met = np.zeros((len(x), len(z)), int)
        for rows, columns in vectors.meetings(x, other, 0.02):
            met[np.ix_(rows, columns)] += 1
        close = ((x[:, None].astype(float) - z[None]) ** 2).sum(2) <= 0.02
        seen = met if other is not None else np.triu(met + np.tril(met, -1).T, 1)
        assert (seen[np.triu(close, 1) if other is None else close] > 0).all()
        assert met.max() == 1 and met.mean() < 0.1
    assert not list(vectors.meetings(x[:0], y, 1.0)) and not list(vectors.meetings(x, y[:0], 1.0))


def test_components_of_links_merge_to_the_lowest():
    root = np.arange(8)
    for p, q in (([5, 7], [6, 6]), ([0, 3, 6], [1, 4, 4]), ([], [])):
        root = vectors._merge(root, np.array(p, int), np.array(q, int))
    assert root.tolist() == [0, 0, 2, 3, 3, 3, 3, 3]
