"""Operator 8: language identification by a byte convolutional network.

Texts are read as fixed windows of bytes (ASCII letters in lower case). Filters of several widths run over each window: a
filter has one weight for each byte at each of its offsets. The largest answer of each filter is kept, and a softmax over those
gives the window's languages; a document's probabilities are the mean over all its windows. For prediction the weights of two
neighbouring offsets are added up beforehand for all pairs of bytes, which changes nothing but the number of table reads.

The network is trained in numpy, with a fixed seed, on SAMPLE_PER_LANGUAGE expected rows of each language (chosen by a hash of
text and id; a row that is repeated counts once) and at most SAMPLE_WINDOWS windows of each, chosen by hash from all windows of the whole text.
Tasks cut the windows, so no text reaches the driver. Prediction reads every byte of every text.

Defined cases: a null text or one without a letter gives `und` with score 0; with no row to learn from everything is `und`;
equal texts give equal rows, ties go to the language that sorts first; rows with a null language are never learned from; more than MOST_LANGUAGES
languages are an error; texts of any length are read whole; further columns are ignored, and keep_identified() returns them as they
came, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import digest_id, mix, text_blocks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_PER_LANGUAGE = 400
SAMPLE_WINDOWS = 3
MOST_LANGUAGES = 1000
EPOCHS = 6
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Network:
    """Filters (offsets, 256, FILTERS) by width, biases, and the last layer."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    _tables: list[list[tuple[int, np.ndarray]]] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tables": []}

    def convolved(self, x: np.ndarray) -> list[np.ndarray]:
        """Answers of all filters at every position of windows `x` (n, WINDOW), by width."""
        out = []
        for w in self.filters:
            wide = w[0][x[:, : WINDOW - len(w) + 1]]
            for k in range(1, len(w)):
                wide += w[k][x[:, k : WINDOW - len(w) + 1 + k]]
            out.append(wide)
        return out

    def strongest(self, x: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each window, by tables over pairs of bytes."""
        if not self._tables:
            for w in self.filters:
                pairs = [(k, (w[k][:, None] + w[k + 1][None]).reshape(1 << 16, -1)) for k in range(0, len(w) - 1, 2)]
                self._tables.append(pairs + ([(len(w) - 1, w[-1])] if len(w) % 2 else []))
        code = x[:, :-1].astype(np.uint16) << np.uint16(8) | x[:, 1:]
        out = []
        for w, tables in zip(self.filters, self._tables, strict=True):
            wide = None
            for k, table in tables:
                part = table[(code if len(table) > 256 else x)[:, k : WINDOW - len(w) + 1 + k]]
                wide = part if wide is None else np.add(wide, part, out=wide)
            out.append(wide.max(axis=1))
        return np.concatenate(out, axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of the last layer for each window."""
        z = np.maximum(self.strongest(x) + self.bias, 0) @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows(data: np.ndarray) -> np.ndarray:
    """The bytes of one text as whole windows; the last is filled up by going round the text."""
    n = max(1, -(-len(data) // WINDOW))
    return np.resize(_FOLD[data], n * WINDOW).reshape(n, WINDOW)


def sampled_windows(data: np.ndarray) -> np.ndarray:
    """At most SAMPLE_WINDOWS windows of one text, by a hash of their contents from all of them."""
    every = windows(data)
    if len(every) <= SAMPLE_WINDOWS:
        return every
    words = every.view(np.uint64)
    place = np.zeros(len(every), np.uint64)
    for k in range(words.shape[1]):
        place = mix(place + words[:, k])
    return every[np.sort(np.argsort(place, kind="stable")[:SAMPLE_WINDOWS])]


def train(x: np.ndarray, labels: list[str], seed: int = 7) -> Network:
    """Fits the network to windows `x` (n, WINDOW) by Adam on softmax cross-entropy."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(label) for label in labels])
    net = Network(
        languages,
        [rng.normal(0, 0.1, (width, 256, FILTERS)).astype(np.float32) for width in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = [*net.filters, net.bias, net.dense, net.dense_bias]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    step, size = 0, 64
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            pick = order[at : at + size]
            part, want = x[pick], y[pick]
            answers = net.convolved(part)
            best = [a.argmax(axis=1) for a in answers]
            tops = np.concatenate([np.take_along_axis(a, b[:, None, :], 1)[:, 0] for a, b in zip(answers, best, strict=True)], axis=1) + net.bias
            hidden = np.maximum(tops, 0)
            z = hidden @ net.dense + net.dense_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(want)), want] -= 1
            p /= len(want)
            back = (p @ net.dense.T) * (tops > 0)
            rows, cols = np.arange(len(want))[:, None], np.arange(FILTERS)[None, :]
            grads = []
            for n, (w, b) in enumerate(zip(net.filters, best, strict=True)):
                grad = np.zeros_like(w)
                for k in range(len(w)):
                    np.add.at(grad[k], (part[rows, b + k], cols), back[:, n * FILTERS : (n + 1) * FILTERS])
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                w -= (0.02 / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def has_letter(data: bytes, ascii_letters: bool) -> bool:
    """Whether a text has a letter, which ASCII letters need not be looked for again; beyond ASCII the text is decoded."""
    return ascii_letters or any(c.isalpha() for c in data.decode("utf-8", "replace"))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def predict_block(net: Network | None, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score for each text of a block."""
    n = len(offsets) - 1
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    plain = letters[offsets[1:]] > letters[offsets[:-1]]
    spoken = [k for k in range(n) if has_letter(data[offsets[k] : offsets[k + 1]].tobytes() if not plain[k] else b"", bool(plain[k]))]
    names, scores = [UNKNOWN] * n, [0.0] * n
    if net is None or not spoken:
        return names, scores
    # Windows of all texts of the block together, but none with bytes of two texts.
    parts = [windows(data[offsets[k] : offsets[k + 1]]) for k in spoken]
    counts = np.array([len(p) for p in parts])
    every = np.concatenate(parts)
    p = np.concatenate([net.probabilities(every[at : at + 256]) for at in range(0, len(every), 256)])
    mean = np.add.reduceat(p, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0) / counts[:, None]
    for k, row in zip(spoken, np.round(mean.astype(float), 6), strict=True):
        best = int(row.argmax())
        names[k], scores[k] = net.languages[best], float(min(1.0, row[best]))
    return names, scores


def held_out_column() -> Column:
    """Rows that are never learned from: CRC-32 of the id's text has remainder 2 modulo 4."""
    return digest_id() % 4 == 2


def fit(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """The network learned from a bounded sample of labelled rows; none where there is no such row."""
    rows = documents.where(F.col("lang").isNotNull() & ~held_out_column() & (F.length(F.coalesce("text", F.lit(""))) > 0))
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"there are more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for r in sorted(counts) for v in (r["lang"], min(1.0, per_language / r["count"]))])
    code = F.xxhash64("text", "doc_id")
    place = F.pmod(code, F.lit(1 << 30)) / F.lit(float(1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in text_blocks(batches):
            parts = [sampled_windows(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays(
                [block.column("code").take(pa.array(owner)), block.column("lang").take(pa.array(owner)), pa.array([w.tobytes() for p in parts for w in p], pa.binary())], names=["code", "lang", "window"]
            )

    sample = rows.where(place < F.element_at(share, F.col("lang"))).select(code.alias("code"), "text", "lang").mapInArrow(cut, "code long, lang string, window binary")
    found = sorted((r["lang"], r["code"], bytes(r["window"])) for r in sample.distinct().collect())  # WINDOW bytes each
    return train(np.frombuffer(b"".join(w for *_, w in found), np.uint8).reshape(-1, WINDOW), [lang for lang, *_ in found]) if found else None


def identify(documents: DataFrame, net: Network | None) -> DataFrame:
    """All columns of the documents with lang_pred and score (columns of these names are replaced)."""
    kept = documents.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, 1 << 18):
            names, scores = predict_block(net, data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rows.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")


def language_digests(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    net = fit(documents.select("doc_id", "text", "lang"))
    rows = documents.select(F.col("doc_id").cast("long"), "text", held_out_column().alias("held_out"))
    return identify(rows, net).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least the score `least`; columns as they came.

    Texts without a letter always go. With no labelled row to learn from no other text is rejected.
    """
    net = fit(documents.select("doc_id", "text", "lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, 1 << 18):
            names, scores = predict_block(net, data, offsets)
            if net is None:
                known = [has_letter(data[a:b].tobytes(), False) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            else:
                known = [name != UNKNOWN and score >= least for name, score in zip(names, scores, strict=True)]
            yield rows.filter(pa.array(known, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
