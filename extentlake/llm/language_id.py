"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes in both directions, gives every byte position a distribution over the
languages, and a document's distribution is the mean over all of its positions. It is trained in numpy by
backpropagation through time on a bounded sample of labelled documents; scoring covers every byte of every text.

One label more than there are languages stands for none of them. It is learnt from noise made by a rule (random letters,
symbols and bytes), so a document's probability of it says whether the text is in any language that was learnt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import table
from ._words import string_slices

#: Bound of the training sample: documents (those of smallest hashed id), and characters in all from each of them.
SAMPLE_DOCS, SAMPLE_CHARS = 1200, 768
#: Candidates for each place in the sample that are ranked.
SPARE = 8
#: At most so many languages are learnt, the most frequent ones.
MAX_LANGUAGES = 400
#: Windows of noise for each language's mean number of windows.
NOISE = 1.0
WINDOW, HIDDEN = 64, 8
EPOCHS, BATCH, RATE = 5, 256, 0.02
UNKNOWN = "und"
NOTHING = "no language"


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class GRU:
    """One direction: update gate z, reset gate r, candidate c; the byte's share of all three is a table of 256 rows."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.table = rng.normal(0, 0.3, (257, 3 * hidden)).astype("f4")
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2 * hidden)).astype("f4")
        self.uc = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden)).astype("f4")

    def params(self):
        return [self.table, self.u, self.uc]

    def forward(self, x: np.ndarray, keep: bool = False):
        """States (time, rows, hidden) for bytes x (time, rows)."""
        n, h = self.h, np.zeros((x.shape[1], self.h), "f4")
        out, tape = np.empty((*x.shape, n), "f4"), []
        for t in range(len(x)):
            e = self.table[x[t]]
            # sigmoid(a) = (1 + tanh(a / 2)) / 2, in place
            g = h @ self.u
            g += e[:, : 2 * n]
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z, r = g[:, :n], g[:, n:]
            c = (r * h) @ self.uc
            c += e[:, 2 * n :]
            np.tanh(c, out=c)
            if keep:
                tape.append((h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return (out, tape) if keep else out

    def backward(self, x: np.ndarray, tape, d_out: np.ndarray):
        n = self.h
        d_table, d_u, d_uc = (np.zeros_like(p) for p in self.params())
        carry = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = tape[t]
            d = d_out[t] + carry
            dc = d * z * (1 - c * c)
            dz = d * (c - h) * z * (1 - z)
            d_rh = dc @ self.uc.T
            dr = d_rh * h * r * (1 - r)
            dg = np.hstack([dz, dr])
            d_uc += (r * h).T @ dc
            d_u += h.T @ dg
            np.add.at(d_table, x[t], np.hstack([dg, dc]))
            carry = d * (1 - z) + d_rh * r + dg @ self.u.T
        return [d_table, d_u, d_uc]


class ByteTagger:
    """Two directions and a softmax layer that labels every position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.fore, self.back = GRU(hidden, rng), GRU(hidden, rng)
        self.w = rng.normal(0, 0.1, (2 * hidden, len(labels))).astype("f4")
        self.b = np.zeros(len(labels), "f4")

    def params(self):
        return [*self.fore.params(), *self.back.params(), self.w, self.b]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (time, rows, labels); the padding byte 256 comes after a row's end."""
        h = np.concatenate([self.fore.forward(x), self.back.forward(x[::-1])[::-1]], 2)
        p = h @ self.w
        p += self.b
        np.exp(p, out=p)
        p /= p.sum(2, keepdims=True)
        return p

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray):
        """Loss and gradients of the mean cross-entropy over all real positions."""
        f, tape_f = self.fore.forward(x, True)
        b, tape_b = self.back.forward(x[::-1], True)
        h = np.concatenate([f, b[::-1]], 2)
        p = h @ self.w + self.b
        p = np.exp(p - p.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        rows = np.arange(x.shape[1])
        loss = -(np.log(p[:, rows, y] + 1e-9) * mask).sum() / mask.sum()
        d = p
        d[:, rows, y] -= 1
        d *= (mask / mask.sum())[:, :, None]
        d_h = d @ self.w.T
        n = self.fore.h
        grads = self.fore.backward(x, tape_f, d_h[:, :, :n]) + self.back.backward(x[::-1], tape_b, np.ascontiguousarray(d_h[::-1, :, n:]))
        return loss, [*grads, h.reshape(-1, 2 * n).T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> list[float]:
        """Adam over shuffled batches of windows x (rows, time) with labels y; returns the loss of each epoch."""
        rng, m = np.random.default_rng(seed), [(np.zeros_like(p), np.zeros_like(p)) for p in self.params()]
        losses, t = [], 0
        for epoch in range(epochs):
            total, order = 0.0, rng.permutation(len(x))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                xs = np.ascontiguousarray(x[some].T)
                loss, grads = self.step(xs, y[some], (xs < 256).astype("f4"))
                t, total = t + 1, total + loss * len(some)
                lr = rate * (1 - epoch / epochs)
                for p, g, (m1, m2) in zip(self.params(), grads, m):
                    m1 += 0.1 * (g - m1)
                    m2 += 0.01 * (g * g - m2)
                    p -= (lr * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-7)).astype("f4")
            losses.append(total / max(1, len(x)))
        return losses

    def score(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, rows: int = 2048) -> np.ndarray:
        """Mean position probabilities (texts, labels) of the texts data[offsets[i]:offsets[i + 1]]; zero for empty ones."""
        first, owner, last = _windows(offsets, window)
        padded = np.concatenate([data.astype(np.int16), np.full(window, 256, np.int16)])
        total = np.zeros((len(offsets) - 1, len(self.labels)))
        for k in range(0, len(first), rows):
            at = first[k : k + rows] + np.arange(window)[:, None]
            x = np.where(at < last[k : k + rows], padded[at], np.int16(256))
            p = self.positions(x)
            p *= (x < 256)[:, :, None]
            np.add.at(total, owner[k : k + rows], p.sum(0, dtype="f8"))
        return total / np.maximum(1, np.diff(offsets))[:, None]


def _windows(offsets: np.ndarray, window: int):
    """Start, text and end of text of every window."""
    n = -(-np.diff(offsets) // window)
    owner = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return offsets[owner] + k * window, owner, offsets[owner + 1]


def training_windows(rows: list[tuple[str, str]], labels: list[str], window: int = WINDOW):
    """(windows, labels) of (text, lang) rows; the last window of a text is padded with 256."""
    x, y = [], []
    for text, lang in rows:
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.int16)
        for k in range(0, len(raw), window):
            x.append(np.pad(raw[k : k + window], (0, max(0, k + window - len(raw))), constant_values=256))
            y.append(labels.index(lang))
    return np.array(x, np.int16).reshape(-1, window), np.array(y, np.int64)


def noise_windows(n: int, seed: int = 23, window: int = WINDOW) -> np.ndarray:
    """Windows of random text: words of letters that are equally likely, of symbols, and of bytes of other scripts; some end
    early. Digits are left out: telephone numbers and the like stand in clean documents of every language."""
    rng = np.random.default_rng(seed)
    kinds = [np.arange(97, 123), np.array([*range(33, 48), *range(58, 65), *range(91, 97)]), np.arange(128, 256)]
    x = np.empty((n, window), np.int16)
    for i in range(n):
        x[i] = rng.choice(kinds[i % len(kinds)], window)
        x[i, rng.random(window) < rng.uniform(0.05, 0.3)] = 32
        if rng.random() < 0.3:
            x[i, rng.integers(4, window) :] = 256
        if i % len(kinds) == 0 and rng.random() < 0.5:
            x[i, 0] -= 32
    return x


def held_out() -> Column:
    """crc32 of the id as text, modulo 4, is 2; such documents are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, epochs: int = EPOCHS) -> ByteTagger | None:
    """Fit on at most ``sample_docs`` documents, of each at most ``sample_chars`` characters in three runs from its start,
    middle and end; documents with a null text or language or a held-out id are no candidates. None without any candidate.

    The sample depends on the rows alone: rows that repeat an id are told apart by their texts, equal rows count once.
    """
    usable = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    top = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counts = dict(map(tuple, top.collect()))
    labels = sorted(counts)
    if not labels:
        return None
    usable = usable.where(F.col("lang").isin(labels)).withColumn("key", F.xxhash64("doc_id", "text", "lang"))
    # An even share for each language, of smallest hashed ids. Of a language's n rows only those whose hash is in the lowest
    # SPARE * share / n of all hashes are ranked, so that the ranking doesn't grow with the data.
    share = max(1, sample_docs // len(labels))
    below = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1, SPARE * share / n) * (2**64 - 1)) - 2**63)])
    ranked = usable.select("lang", F.xxhash64(F.col("doc_id"), F.lit(5)).alias("h"), "key").where(F.col("h") <= below[F.col("lang")])
    ranked = ranked.withColumn("k", F.rank().over(W.partitionBy("lang").orderBy("h", "key"))).where(F.col("k") <= share)
    keys = sorted({r[0] for r in ranked.select("key").distinct().collect()})
    run, n = sample_chars // 3, F.length("text")
    part = F.concat_ws(" ", *[F.substring(F.col("text"), (1 + F.greatest(n - run, F.lit(0)) * f).cast("int"), F.lit(run)) for f in (0.0, 0.5, 1.0)])
    some = usable.where(F.col("key").isin(keys)).select("key", F.when(n > sample_chars, part).otherwise(F.col("text")).alias("part"), "lang")
    rows = some.groupBy("key").agg(F.min(F.struct("part", "lang")).alias("row")).orderBy("key").select("row.part", "row.lang").collect()
    x, y = training_windows([tuple(r) for r in rows], labels)
    noise = noise_windows(int(NOISE * len(x) / len(labels)) + 1)
    model = ByteTagger([*labels, NOTHING])
    model.fit(np.concatenate([x, noise]), np.concatenate([y, np.full(len(noise), len(labels))]), epochs)
    return model


def _predict(batches, model: ByteTagger | None):
    for batch in batches:
        known = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        lang, score, other = np.full(len(known), UNKNOWN, object), np.zeros(len(known)), np.zeros(len(known))
        if model:
            names = np.array(model.labels[:-1], object)
            for row, end, data, offsets in string_slices(batch.column(1)):
                p = model.score(data, offsets)
                best = p[:, :-1].argmax(1)
                lang[row:end], score[row:end], other[row:end] = names[best], np.minimum(1, p[np.arange(end - row), best]), np.minimum(1, p[:, -1])
            lang[~known], score[~known], other[~known] = UNKNOWN, 0, 0
        yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(k) for k in range(3, batch.num_columns)], pa.array(lang, pa.string()), pa.array(score), pa.array(other)], [*batch.schema.names[:1], *batch.schema.names[3:], "lang_pred", "score", "no_language"])


def identify(documents: DataFrame, model: ByteTagger | None, carry: list[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, no_language of every row; and the columns of ``carry``, unchanged. score is the
    mean probability of the best language over all positions, no_language that of none.

    A null text, or one without any letter (Unicode's category L), is ``und`` with score 0, as is everything without a model
    (no labelled row). Ties between languages go to the first in alphabetical order; a null id counts as not held out;
    repeated rows give repeated results. Text, and nothing else, is read for the prediction; an empty table gives an empty
    result.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), letter.alias("letter"), held_out().alias("held_out"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(carry)])
    types = "".join(f", _{k} {documents.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = rows.mapInArrow(lambda b: _predict(b, model), f"doc_id long, held_out boolean{types}, lang_pred string, score double, no_language double")
    return out.select("doc_id", "held_out", "lang_pred", "score", "no_language", *[F.col(f"_{k}").alias(c) for k, c in enumerate(carry)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
