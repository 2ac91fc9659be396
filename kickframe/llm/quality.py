"""Quality by compression: how much better good text's dictionary compresses a text than bad text's.

Two zstandard dictionaries are trained on labelled texts of either kind. A text is
compressed with each and with none. The difference of the sizes, normalised by
the text's length and by its own compressed size, becomes a probability by a
logistic curve fitted on other labelled texts, which also sees the plain ratio
and the length, as the difference means less for short or very regular texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm.batches import by_weight, small_batches, text_bytes
from kickframe.llm.labelled import held_out, sample

#: The most labelled rows for each dictionary and for the curve, and the longest text among them.
DICTIONARY_ROWS, CURVE_ROWS, LONGEST = 3000, 8000, 30_000
DICTIONARY_BYTES, LEVEL = 112 << 10, 3
MODULUS, HELD = 3, 1


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too few texts their end, of none nothing."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


@dataclass
class Compressor:
    """Features and score of texts; the curve is a flat share until it is fitted."""

    good: bytes
    bad: bytes
    share: float = 0.5
    centre: np.ndarray = field(default_factory=lambda: np.zeros(4))
    spread: np.ndarray = field(default_factory=lambda: np.ones(4))
    curve: np.ndarray | None = None

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Size differences by length and by plain size, plain ratio, log length."""
        def sizer(data: bytes):
            kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            own = zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
        good, bad, plain = sizer(self.good), sizer(self.bad), sizer(b"")
        out = np.empty((len(texts), 4))
        for i, t in enumerate(texts):
            alone, n = len(plain.compress(t)), len(t) + 1
            gain = len(bad.compress(t)) - len(good.compress(t))
            out[i] = gain / n, gain / alone, alone / n, np.log(n)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.share)
        x = (self.features(texts) - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> None:
        """The curve by damped Newton steps on standardised features."""
        self.share = float((y.sum() + 1) / (len(y) + 2))
        if not len(y) or y.min() == y.max():
            return
        self.centre, self.spread = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.centre) / self.spread, np.ones(len(x))])
        ridge = np.diag([penalty] * 4 + [1e-6])

        def loss(w):
            m = z @ w
            return float(np.logaddexp(0, m).sum() - y @ m + w @ ridge @ w / 2)
        w = np.zeros(5)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (p - y) + ridge @ w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, slope)
            scale = 1.0
            while scale > 1e-6 and loss(w - scale * step) > loss(w):
                scale /= 2
            w = w - scale * step
            if np.abs(slope).max() < 1e-6 * len(y):
                break
        self.curve = w


def _features(model: Compressor):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame) -> Compressor:
    """Fit on bounded samples of the documents whose `labels.quality` may be used.

    Half of the labelled ids, by hash, are for the dictionaries and the other half for the curve.
    """
    usable = ~held_out(F.col("doc_id"), MODULUS, HELD)
    half = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2))
    texts = []
    for kind in (1, 0):
        chosen = sample(docs, labels, "quality", usable & (half == 0) & (F.col("quality") == kind), DICTIONARY_ROWS, LONGEST)
        table = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").select("text").toArrow()
        texts.append(text_bytes(table.column("text").combine_chunks()) if table.num_rows else [])
    model = Compressor(*map(dictionary, texts))
    chosen = sample(docs, labels, "quality", usable & (half == 1), CURVE_ROWS, LONGEST, salt=5)
    with small_batches(docs.sparkSession):
        table = chosen.orderBy("doc_id").mapInArrow(_features(model), "y int, x array<double>").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, 4)
    model.fit(x, table.column("y").to_numpy().astype(float))
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for part in by_weight(np.array([len(t) for t in texts]), 1 << 22):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], pa.array(shared.value.scores(texts[part]))], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Compressor) -> DataFrame:
    """Per row `doc_id`, `held_out`, `score` (0 to 1, high is good), `predicted`.

    Null counts as empty, and an empty text is scored by the curve like any other. With no
    labels, or one value only, every score is the smoothed share of good labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(shared), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
