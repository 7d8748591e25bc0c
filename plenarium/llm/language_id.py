"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded and filtered at several widths, each filter's maximum over a window of
fixed length feeds a softmax.  Training takes one window from each row of a bounded
sample; prediction cuts every text into such windows, all of it, and averages the
windows' probabilities by the number of letters they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, table

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 8, 8
REACH = max(WIDTHS) - 1
#: Rows of each language that training takes at most.
SAMPLE = 1000
#: Languages that can be learnt, an output of the network each; with SAMPLE they bound what reaches the driver.
LANGUAGES = 500
UNKNOWN = "und"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER_BYTE = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Positions filtered at a time.
_AT_ONCE = 128 * WINDOW
#: Bytes of text in work at a time, a longer text apart.
_BYTES = 1 << 20


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def taps(self) -> list[np.ndarray]:
        """What each byte value adds to every filter at each distance from the position."""
        out = []
        for j in range(max(WIDTHS)):
            parts = [self.embedding @ w[j] if j < len(w) else np.zeros((256, FILTERS), np.float32) for w in self.filters]
            out.append(np.concatenate(parts, axis=1).astype(np.float32))
        return out

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        """Summed filter by filter: a matrix product may round a row by the rows beside it."""
        logits = np.repeat(self.dense_bias[None, :], len(pooled), axis=0)
        for active, weights in zip(np.maximum(pooled + self.bias, 0).T, self.dense, strict=True):
            logits += active[:, None] * weights
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(_LOWER)


def train(texts: list[str], languages: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 4) -> Network:
    """Adam on the cross entropy of one window for each text."""
    names = sorted(set(languages))
    target = np.array([names.index(x) for x in languages])
    rows = np.zeros((len(texts), WINDOW + REACH), dtype=np.uint8)
    for row, text in zip(rows, texts, strict=True):
        data = np.frombuffer(as_bytes(text)[: WINDOW + REACH], dtype=np.uint8)
        row[: len(data)] = data
    rng = np.random.default_rng(seed)
    scaled = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    total = FILTERS * len(WIDTHS)
    net = Network(names, rng.standard_normal((256, EMBEDDING)).astype(np.float32), [scaled(w, EMBEDDING, FILTERS) for w in WIDTHS], np.zeros(total, np.float32), scaled(total, len(names)), np.zeros(len(names), np.float32))
    weights = [net.embedding, *net.filters, net.bias, net.dense, net.dense_bias]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            x, y, step = rows[some], target[some], step + 1
            taps = net.taps()
            found = sum(tap[x[:, j : j + WINDOW]] for j, tap in enumerate(taps))
            place = found.argmax(axis=1)
            pooled = np.take_along_axis(found, place[:, None, :], axis=1)[:, 0]
            error = net.probabilities(pooled)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            active = np.maximum(pooled + net.bias, 0)
            back = (error @ net.dense.T) * (active > 0)
            on_embedding, on_filters = np.zeros_like(net.embedding), [np.zeros_like(w) for w in net.filters]
            for j in range(max(WIDTHS)):
                seen = np.take_along_axis(x, place + j, axis=1)
                on_tap = np.zeros((256, total), np.float32)
                np.add.at(on_tap, (seen, np.arange(total)[None, :]), back)
                for k, w in enumerate(net.filters):
                    if j < len(w):
                        part = on_tap[:, k * FILTERS : (k + 1) * FILTERS]
                        on_embedding += part @ w[j].T
                        on_filters[k][j] += net.embedding.T @ part
            slopes = [on_embedding, *on_filters, back.sum(axis=0), active.T @ error, error.sum(axis=0)]
            for w, g, m, v in zip(weights, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Predictor:
    """Windows of many texts at once; two byte pairs at a position give all filters by two lookups."""

    def __init__(self, net: Network):
        self.net = net
        a, b, c, d = net.taps()
        self.near = (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.far = (c[:, None, :] + d[None, :, :]).reshape(65536, -1)

    def pooled(self, codes: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Each filter's maximum in every window; ``codes`` has whole windows and REACH bytes more.

        ``final``: windows that end a text.  Their last REACH positions are past the text and
        see zeros only, whatever text comes next.
        """
        n = len(codes) - REACH
        nothing = self.near[0] + self.far[0]
        out = []
        for at in range(0, n, _AT_ONCE):
            part = codes[at : min(at + _AT_ONCE, n) + REACH].astype(np.int32)
            pairs = (part[:-1] << 8) | part[1:]
            values = self.near[pairs[:-2]]
            values += self.far[pairs[2:]]
            values = values.reshape(-1, WINDOW, values.shape[-1])
            values[final[at // WINDOW :][: len(values)], -REACH:] = nothing
            while values.shape[1] > 1:
                half = values.shape[1] // 2
                values = np.maximum(values[:, :half], values[:, half:])
            out.append(values[:, 0])
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; what a text gets depends on it alone."""
        answer = []
        for some in chunks(texts, lambda t: len(t or ""), _BYTES):
            answer.extend(self._predict_some(some))
        return answer

    def _predict_some(self, texts: list[str | None]) -> list[tuple[str, float]]:
        parts, owner = [], []
        for i, text in enumerate(texts):
            if text and self.net.languages and any(map(str.isalpha, text)):
                data = as_bytes(text)
                windows = -(-(len(data) + REACH) // WINDOW)
                parts.append(data.ljust(windows * WINDOW, b"\0"))
                owner.append((i, windows))
        answer = [(UNKNOWN, 0.0)] * len(texts)
        if not parts:
            return answer
        codes = np.frombuffer(b"".join([*parts, b"\0" * REACH]), dtype=np.uint8)
        del parts
        ends = np.cumsum([n for _, n in owner])
        final = np.zeros(ends[-1], dtype=bool)
        final[ends - 1] = True
        chances = self.net.probabilities(self.pooled(codes, final))
        letters = _LETTER_BYTE[codes[:-REACH]].reshape(-1, WINDOW).sum(axis=1)
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.add.reduceat(chances * letters[:, None], starts, axis=0)
        # Every letter is an ASCII letter or has bytes of at least 128, so no sum is 0.
        means = sums / np.add.reduceat(letters, starts)[:, None]
        for (i, _), row in zip(owner, means, strict=True):
            best = int(row.argmax())
            answer[i] = (self.net.languages[best], float(min(1.0, row[best])))
        return answer


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Learn from at most ``sample`` rows of each language among those not held out.

    Which rows is decided by a hash of doc_id; of each, a window at a hashed place.  A null
    text, lang or doc_id isn't learnt from.  Only this bounded sample reaches the driver:
    more than LANGUAGES values of lang are an error.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder() != 2)).select("doc_id", "text", "lang")
    shares = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(1.3 * sample) / F.count("*")).alias("share")).limit(LANGUAGES + 1).collect()
    if len(shares) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    # One row for each language, of which the network has an output each: few enough to send to every task.
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(4)), F.lit(1 << 30))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.greatest(F.lit(1), F.length("text") - WINDOW)) + 1
    chosen = usable.join(shares, "lang").where(draw < F.col("share") * (1 << 30)).select("lang", "doc_id", draw.alias("draw"), F.substr("text", place.cast("int"), F.lit(WINDOW + REACH)).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    rows = chosen.withColumn("nth", nth).where(F.col("nth") <= sample).orderBy("lang", "nth").select("text", "lang").collect()
    if not rows:
        none = np.zeros((0, 0), np.float32)
        return Network([], none, [], none, none, none)
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predicted(text: Column, net: Network) -> Column:
    """struct lang_pred, score of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(net) if net.languages else None
        for batch in batches:
            found = predictor.predict(batch.tolist()) if predictor else [(UNKNOWN, 0.0)] * len(batch)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, as is every text where
    there is nothing to learn from; a single learnt language always scores 1.  Texts are
    read whole, whatever their length.  Equal texts get equal answers, whatever rows stand
    beside them.  A null doc_id isn't held out.  An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select("doc_id", "text").withColumn("found", predicted(F.col("text"), fit(docs, sample)))
    return rows.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, over_chance: float = 1.2, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose language is found.

    ``und`` goes, and so do texts whose best language scores less than ``over_chance`` times
    what each of the learnt languages would get if they were equally likely (at most 1): of
    four languages, less than 0.3.  That is what is undecided between all of them; it isn't a
    test of whether a text is in any of them.
    """
    net = fit(docs, sample)
    least = min(1.0, over_chance / max(1, len(net.languages)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predicted(F.col("text"), net).alias("found"))
    return rows.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
