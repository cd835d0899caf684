"""Language identification: averaged embeddings of hashed subwords and a linear softmax.

A subword is a run of 1 to 4 characters of the lower-cased text, where every character that is no
letter counts as a space. A document is the mean of the embeddings of its subwords' buckets; a
linear layer and softmax give the languages. Both layers are trained in numpy by stochastic
gradient descent on a sample of labelled rows of bounded size. A part of the sample that is not
trained on sets the temperature, so that scores are probabilities, and the score under which a
document is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from llm.common import arrow_map, store

BUCKETS = 1 << 14
SIZES = (1, 2, 3, 4)
DIM = 16
#: Labelled rows that training reads, over all languages.
SAMPLE_ROWS = 4000
#: Files of the sample.
PIECES = 16
EPOCHS, BATCH, RATE = 4, 32, 2.0
#: Share of right answers on unseen rows that rejection may lose, and the highest score it may ask for.
LOST, HIGHEST = 0.001, 0.5
UNKNOWN = "und"
#: Characters read at a time.
STRETCH = 1 << 20

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """Subword counts by bucket; None for a text that is null or has no letter."""
    if not text:
        return None
    out, letters = np.zeros(BUCKETS, np.int64), False
    text = f" {text.lower()} "
    for start in range(0, len(text), STRETCH):  # subwords that start here may end in the next stretch
        c = np.frombuffer(text[start : start + STRETCH + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[c]
        letters |= bool(letter.any())
        c = np.where(letter, c, 32).astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, min(max(SIZES), len(c)) + 1):
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            if n in SIZES:
                out += np.bincount((h[:STRETCH] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return out if letters else None


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # embedding times softmax layer: one row per bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, count: np.ndarray) -> np.ndarray:
        z = (count @ self.table / count.sum() + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Train on (language, buckets, shares) rows; every fifth row only calibrates."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([languages.index(r[0]) for r in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[::5] if len(rows) >= 50 else order
    used = np.setdiff1d(order, held) if len(rows) >= 50 else order
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)

    def flat(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate([rows[r][1] for r in at]), np.concatenate([rows[r][2] for r in at])[:, None], np.array([len(rows[r][1]) for r in at])

    def hidden_of(buckets: np.ndarray, share: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(embed[buckets] * share, np.cumsum(sizes) - sizes, axis=0)

    for epoch in range(EPOCHS):
        used = rng.permutation(used)
        rate = RATE * (1 - epoch / EPOCHS)
        for start in range(0, len(used), BATCH):
            at = used[start : start + BATCH]
            buckets, share, sizes = flat(at)
            hidden = hidden_of(buckets, share, sizes)
            p = _softmax(hidden @ layer + bias)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = (p @ layer.T).astype(np.float32)
            layer -= rate * hidden.T @ p
            bias -= rate * 0.1 * p.sum(axis=0)
            np.add.at(embed, buckets, -rate * 100 * share * np.repeat(back, sizes, axis=0))
    z = np.concatenate([hidden_of(*flat(held[i : i + 256])) @ layer + bias for i in range(0, len(held), 256)]).astype(np.float64)

    def loss(t: float) -> float:
        return -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()

    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = _softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    threshold = min(HIGHEST, float(np.quantile(right, LOST))) if len(right) else 0.0
    return Model(languages, (embed @ layer).astype(np.float32), bias.astype(np.float64), float(temperature), threshold)


def remainder() -> Column:
    """crc32(doc_id as text) mod 4; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` rows that are not held out, an equal share for each language.

    The sample is drawn by a hash of the doc_id; only subword shares, at most BUCKETS numbers a
    row, go to the driver.
    """
    labelled = docs.filter((remainder() != 2) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([])
    quota = max(1, sample_rows // len(sizes))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    rate = F.lit(0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, min(1 << 20, -(-quota * (1 << 20) // n))).otherwise(rate)
    drawn = labelled.filter(draw < rate).select("lang", "text")

    def shares(rows: dict) -> dict:
        lang, at, value = [], [], []
        for name, text in zip(rows["lang"], rows["text"]):
            if (c := counts(text)) is not None:
                hit = np.flatnonzero(c)
                lang.append(name)
                at.append(hit.astype(np.uint16).tobytes())
                value.append((c[hit] / c.sum()).astype(np.float32).tobytes())
        return {"lang": pa.array(lang, pa.string()), "at": pa.array(at, pa.binary()), "share": pa.array(value, pa.binary())}

    # written by many tasks, then read in small pieces, of which the driver holds one at a time
    found = store(arrow_map(drawn, shares, "lang string, at binary, share binary").repartition(PIECES), "sample")
    read = islice(found.toLocalIterator(), 2 * sample_rows)
    rows = [(r["lang"], np.frombuffer(r["at"], np.uint16), np.frombuffer(r["share"], np.float32)) for r in read]
    return fit(sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` and lang_pred, score, rejected.

    Null texts and texts without a letter: 'und', score 0, rejected; so is every row if no language
    could be learned. Columns of `docs` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, lang, score = shared.value, [], []
        for text in batch.column("text").to_pylist():
            c = counts(text) if m.languages else None
            if c is None:
                lang.append(UNKNOWN)
                score.append(0.0)
            else:
                p = m.scores(c)
                lang.append(m.languages[int(p.argmax())])
                score.append(float(p.max()))
        rejected = [s < m.threshold or name == UNKNOWN for s, name in zip(score, lang)]
        found = (pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()))
        return pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "lang_pred", "score", "rejected"])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                yield one(batch.slice(start, 1000))

    plain = docs.select(*(F.col(f"`{c}`") for c in named))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields]
    return plain.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"]))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on the rows of `docs` that are not held out and predict every row."""
    return predict(docs, train(docs, sample_rows))
