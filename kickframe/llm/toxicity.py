"""Toxicity by a factorization machine over hashed terms.

The log-odds of a text are a bias, a weight per term and the inner products of the
factors of every two terms in it, so a pair may count although neither term does.
The pairwise part costs one pass over the terms: half of the squared sum of their
factors less the sum of their squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm.batches import by_weight, claim, give_back, small_batches, utf8_lengths
from kickframe.llm.labelled import held_out, sample

BITS, FACTORS, STEM = 18, 8, 5
#: The most labelled rows that a model is fitted on, and the longest text among them.
SAMPLE, LONGEST = 20_000, 100_000
MODULUS, HELD = 5, 0
_MARKS = ".,;:!?\"'()[]{}*&%$#|-_~"
_KNOWN_MAX = 300_000


class _Terms(dict):
    """Buckets of each word as written, its whole and its stem, kept per worker and emptied when they grow too many."""

    def __missing__(self, word: str) -> int:
        plain = word.lower().strip(_MARKS)
        value = xxhash.xxh3_64_intdigest(plain) >> (64 - BITS) << BITS | xxhash.xxh3_64_intdigest(plain[:STEM], seed=1) >> (64 - BITS)
        if len(word) <= 64:
            self[word] = value
        return value


_terms = _Terms()


def terms(texts: list[str]) -> list[np.ndarray]:
    """Distinct buckets of each text's words and of their first letters; case and outer punctuation don't count."""
    claim("toxicity", _terms.clear)
    if len(_terms) > _KNOWN_MAX:
        _terms.clear()
    out = []
    for t in texts:
        words = set(t.split())
        both = np.fromiter(map(_terms.__getitem__, words), np.int64, len(words))
        out.append(np.unique(np.concatenate((both >> BITS, both & ((1 << BITS) - 1)))).astype(np.int32))
    return out


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terms, the start of each non-empty row and which rows these are."""
    size = np.array([len(r) for r in rows], np.int64)
    some = np.flatnonzero(size)
    return np.concatenate([*rows, np.empty(0, np.int32)]), (np.cumsum(size) - size)[some], some


@dataclass
class Rows:
    """Terms of many texts in one array; `ends` has where each text's stop. Only what is asked for is cut out."""

    ids: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([*rows, np.empty(0, np.int32)]), np.cumsum([len(r) for r in rows], dtype=np.int64))

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0:self.ends[i]]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        ids, starts, some = _flat(rows)
        if len(some):
            v = self.factor[ids]
            total = np.add.reduceat(v, starts, axis=0)
            own = np.add.reduceat((v * v).sum(1), starts)
            out[some] += np.add.reduceat(self.weight[ids], starts) + 0.5 * ((total * total).sum(1) - own)
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def fit(rows: Rows | list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 1.0, sparse: float = 4.0, factor_rate: float = 0.01,
        decay: float = 0.1, batch: int = 16, least: int = 3, paired: tuple[float, float] = (1 / 100, 1 / 2), alone: int = 4,
        seed: int = 7) -> Machine:
    """Logistic loss in seeded order, steps adapted to each term.

    Weights follow the regularised leader: a term gets one only when its gradients add up to more
    than `sparse`, so words of a few rows can't learn these rows by heart. Terms in fewer than
    `least` rows have nothing. Only terms within the shares `paired` of the rows have factors,
    which join after `alone` epochs and so learn what weights alone leave unexplained.
    """
    rng = np.random.default_rng(seed)
    n = 1 << BITS
    share = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(n, np.float32), np.zeros((n, FACTORS), np.float32))
    if not len(y) or y.min() == y.max():
        return m
    if not isinstance(rows, Rows):
        rows = Rows.of(rows)
    seen = np.zeros(n, np.int64)
    for at in range(0, len(rows.ids), 1 << 20):
        seen += np.bincount(rows.ids[at:at + (1 << 20)], minlength=n)
    pairing = (seen >= max(10, paired[0] * len(rows))) & (seen <= paired[1] * len(rows))
    known = seen >= least
    start = rng.normal(0, 0.01, (int(pairing.sum()), FACTORS)).astype(np.float32)
    lead, sum_w = np.zeros(n, np.float32), np.zeros(n, np.float32)
    sum_v, sum_b = np.full((n, FACTORS), 1e-3, np.float32), 1.0
    for epoch in range(epochs):
        if epoch == alone:
            m.factor[pairing] = start
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = [r[known[r]] for r in map(rows.__getitem__, order[at:at + batch].tolist())]
            error = m.scores(own) - y[order[at:at + batch]]
            sum_b += float(error.sum()) ** 2
            m.bias -= 0.1 * float(error.sum()) / sum_b ** 0.5
            ids, starts, some = _flat(own)
            if not len(some):
                continue
            e = np.repeat(error[some], np.diff(np.append(starts, len(ids)))).astype(np.float32)
            unique, g = _summed(ids, e[:, None])
            g = g[:, 0]
            grown = np.sqrt(sum_w[unique] + g * g)
            lead[unique] += g - (grown - np.sqrt(sum_w[unique])) / rate * m.weight[unique]
            sum_w[unique] += g * g
            z = lead[unique]
            m.weight[unique] = np.where(np.abs(z) <= sparse, 0, -(z - np.sign(z) * sparse) / ((1 + grown) / rate + 0.1))
            if epoch < alone:
                continue
            own = [r[pairing[r]] for r in own]
            ids, starts, some = _flat(own)
            if not len(some):
                continue
            length = np.diff(np.append(starts, len(ids)))
            v = m.factor[ids]
            total = np.repeat(np.add.reduceat(v, starts, axis=0), length, axis=0)
            e = np.repeat(error[some], length).astype(np.float32)
            unique, gv = _summed(ids, e[:, None] * (total - v))
            gv += decay * m.factor[unique]
            sum_v[unique] += gv * gv
            m.factor[unique] -= factor_rate * gv / np.sqrt(sum_v[unique])
    return m


def _summed(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[firsts], np.add.reduceat(values[order], firsts, axis=0)


def _terms_of():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_weight(utf8_lengths(batch.column("text")), 1 << 21):
                yield pa.RecordBatch.from_arrays([batch.column("y")[part], pa.array(terms(batch.column("text")[part].to_pylist()), pa.list_(pa.int32()))], names=["y", "terms"])
    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, longest: int = LONGEST) -> Machine:
    """Fit on at most `rows` documents whose `labels.toxic` may be used."""
    usable = ~held_out(F.col("doc_id"), MODULUS, HELD)
    chosen = sample(docs, labels, "toxic", usable, rows, longest)
    with small_batches(docs.sparkSession):
        # Their order is fixed, so the same rows give the same model.
        table = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").mapInArrow(_terms_of(), "y int, terms array<int>").toArrow()
    y = table.column("y").to_numpy().astype(np.float64)
    parts = table.column("terms").chunks
    # Slices keep the buffers of their table, so the terms are copied once and the table goes.
    ids = np.concatenate([*[p.flatten().to_numpy() for p in parts], np.empty(0, np.int32)])
    ends = np.cumsum(np.concatenate([*[p.value_lengths().to_numpy() for p in parts], np.empty(0, np.int32)]), dtype=np.int64)
    del table, parts
    give_back()
    machine = fit(Rows(ids, ends), y)
    del ids
    give_back()
    return machine


def _scored(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for batch in batches:
            for part in by_weight(utf8_lengths(batch.column("text")), 1 << 21):
                score = m.scores(terms([t or "" for t in batch.column("text")[part].to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], pa.array(score)], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per row `doc_id`, `held_out`, `score` (0 to 1), `predicted`.

    Null and empty texts have no terms and get the score of the bias. With no labels, or one
    value only, every score is the smoothed share of toxic labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # its size is fixed by BITS and FACTORS
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(shared), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _clean(machine, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for batch in batches:
            text = batch.column(names.index("text"))
            for part in by_weight(utf8_lengths(text), 1 << 21):
                keep = m.scores(terms([t or "" for t in text[part].to_pylist()])) < 0.5
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(keep))
    return run


def reject(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of `docs` that score below one half, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.mapInArrow(_clean(shared, docs.columns), docs.schema)
