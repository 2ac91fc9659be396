"""Token stores and packing: round trips, brute force, optimal packings of small instances."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpora import corpus, nothing  # noqa: F401
from tokenizers import Tokenizer

from kickframe.llm import packing, token_store
from kickframe.llm.tokens import Encoder

FILES = [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "blank"), ("word_bpe_49k.json", "none")]


@pytest.mark.parametrize(("file", "words"), FILES)
def test_words_encode_like_whole_texts(file, words):
    rng = random.Random(3)
    letters = [*"ab  \n\t'sé́  \x1c\x85.,!1 9İßΣ?;", "<|endoftext|>", " the", "'re", "　", "ab, ", "É. "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    path = public_tokenizers.path(file)
    code, whole = Encoder(path, words), Tokenizer.from_file(path)
    want = [np.array(e.ids, code.dtype).tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert code.ids(texts) == want
    assert code.ids(texts) == want


def test_perfect_hash_is_minimal_and_finds_every_key():
    keys = token_store.mix64(np.arange(5000, dtype=np.uint64))
    assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(5000))
    assert len(token_store.PerfectHash.build(keys[:0]).slots(keys)) == 5000


def test_store_round_trip(corpus, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    store = token_store.write_store(corpus, path, words="byte", end=0)
    whole = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id, r.text or "") for r in corpus.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for d, t in rows:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((d, at, len(ids) // 4, ids, zlib.crc32(ids)))
        at += len(ids) // 4
    got = [tuple(r) for r in store.read(corpus).collect()]
    assert sorted(map(repr, ((*x[:3], bytes(x[3]), x[4]) for x in got))) == sorted(map(repr, want))
    strangers = corpus.sparkSession.range(90_000, 90_200).withColumnRenamed("id", "doc_id")
    assert store.lookup(strangers).count() == 0
    assert token_store.write_store(nothing, path).read(corpus).count() == 0


def best(pieces, capacity):
    """The fewest sequences, by search."""
    pieces = sorted(pieces, reverse=True)

    def fits(k):
        def put(i, rooms):
            if i == len(pieces):
                return True
            for r in sorted({x for x in rooms if x >= pieces[i]}):
                left = list(rooms)
                left.remove(r)
                if put(i + 1, [*left, r - pieces[i]]):
                    return True
            return False
        return put(0, [capacity] * k)
    return next(k for k in itertools.count(0) if fits(k))


def test_plans_are_valid_and_reduction_loses_nothing():
    rng = random.Random(11)
    for _ in range(60):
        capacity = rng.choice([10, 20])
        pieces = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, left = packing.reduce_dominated(Counter(pieces), capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert Counter(x for s, m in fixed for x in s * m) + Counter(rest) == Counter(pieces)
        assert sum(m for _, m in fixed) + best(rest, capacity) == best(pieces, capacity)
        p = packing.plan(Counter(pieces), capacity)
        rank, seqs = Counter(), defaultdict(list)
        for x in pieces:
            s, o = p.places(np.array([x]), np.array([rank[x]]))
            rank[x] += 1
            seqs[int(s[0])].append((int(o[0]), x))
        for content in seqs.values():
            at = 0
            for offset, x in sorted(content):
                assert offset == at
                at += x
            assert at <= capacity
        assert len(seqs) == p.sequences >= packing.lower_bound(Counter(pieces), capacity)


def test_packing_of_a_corpus(corpus, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(corpus, path, words="blank", end=1).collect()
    whole = Tokenizer.from_file(path)
    want = Counter()
    for r in corpus.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r.doc_id, k, at, np.array(ids[at:at + 4096], "<u2").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for content in seqs.values():
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.pack(nothing, path).count() == 0
    sums = packing.pack(corpus.where("doc_id = 5003"), path, words="blank", digest=True).first()
    assert sums.ids_crc32 == zlib.crc32(np.array([*whole.encode("one").ids, 1], "<u4").tobytes())


def test_checksums_of_wide_and_narrow_ids():
    ids = [70000, 5, 1]
    assert packing.checksum(np.array(ids, "<u4").tobytes(), np.dtype("<u4")) == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert packing.checksum(np.array(ids[1:], "<u2").tobytes(), np.dtype("<u2")) == zlib.crc32(np.array(ids[1:], "<u4").tobytes())


def test_a_table_is_packed_as_tightly_as_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words="blank", digest=True).select("length", "sequence_id").collect()
    assert len({r.sequence_id for r in rows}) == packing.lower_bound(Counter(r.length for r in rows))


def test_runs_of_marks_after_a_word_are_looked_up():
    """A word followed by marks costs the tokenizer the word and the run once each, and ids equal those of the whole text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, code, asked = Tokenizer.from_file(path), Encoder(path, "blank"), []
    one = code._one
    code._one = lambda word: asked.append(word) or one(word)
    for stem in ("thor", "ciónñ", "Haus"):
        for run in ("&&&", "$$$", ",%%%", "!!", "***", "###"):
            code.ids([stem + run])
    assert not [w for w in asked if w[0].isalpha() and w[-1] in "&$%!*#"]
    for text in ("a&&& b$$$", "İ.. İ%%", "ΣΣ!! οδοσ&&", "don't!! it's..", "a1%% 1&& &&a", "x<|endoftext|> <|endoftext|>!! |>a|> y<|endoftext|", "é** é́##",
                 "a≠ a‍.. K!!", "'s&& a's!! a'&&", "中文.. لا!!", "&&&&" * 60 + " a" + "%" * 150):
        assert np.frombuffer(code.ids([text])[0], code.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids, text
