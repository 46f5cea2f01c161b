"""Language ID by error-correcting output codes.

Each language has a codeword of bits. A binary classifier per bit (naive Bayes on hashed byte n-grams, languages with
the bit against languages without it) predicts a margin, and the language whose codeword has the least weighted
logistic loss wins; bits that err more on labelled rows kept back from learning weigh less. A document is flagged as
ambiguous where the losses of its two nearest codewords differ by no more than they do for the closest ``DOUBTFUL``
share of the rows kept back that are recognised.

Letters of a text are lower-cased where ASCII; other ASCII characters count as spaces, so digits, marks and junk say
nothing. Fitting reads a sample of at most about ``TRAIN_ROWS`` labelled documents per language, chosen by a hash of
the id; prediction reads every whole text.

Null, empty and letterless texts are ``und`` with a score of 0, and not ambiguous. Rows with a null id or label are predicted but not
learned from. Repeated rows get equal predictions. Without a labelled row every text is ``und``; with one language
nothing is ambiguous. A column to keep that has the name of an added one gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import beside, forget, saved, text_slices

#: Labelled documents per language that fitting reads (expected number; a hash of the id decides).
TRAIN_ROWS = 3000
#: Hash bins for byte n-grams of these lengths.
BINS, ORDERS = 8192, (2, 3, 4)
#: Share of the labelled rows that are kept back to weigh bits and to set the bound of ambiguity, and the share of those
#: that fall below it.
KEPT_BACK, DOUBTFUL = 0.25, 0.01
UNKNOWN = "und"

_BYTE = np.full(256, 32, np.uint8)
_BYTE[97:123] = _BYTE[65:91] = np.arange(97, 123)
_BYTE[128:] = np.arange(128, 256)


def has_letter(raw: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a letter of any script."""
    mapped = _BYTE[raw]
    if ((mapped >= 97) & (mapped < 123)).any():
        return True
    return bool((mapped >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def ngram_counts(column: pa.Array):
    """Yield (first row, counts by row and bin, whether each row has a letter) for runs of rows."""
    for a, b, raw, off in text_slices(column, 1 << 20):
        for i in range(a, b, 128):
            j = min(b, i + 128)
            o = off[i - a : j - a + 1]
            part = _BYTE[raw[o[0] : o[-1]]]
            o = o - o[0]
            row = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(o))
            counts = np.zeros((j - i) * BINS)
            word = part.astype(np.uint32)
            gram = word
            for k in range(1, max(ORDERS)):
                if len(part) <= k:
                    break
                gram = (gram[:-1] << np.uint32(8)) | word[k:]
                if k + 1 not in ORDERS:
                    continue
                keep = (row[:-k] == row[k:]) & (gram & np.uint32(0xFFFF) != 0x2020)
                mixed = (gram[keep] + np.uint32(k)) * np.uint32(0x9E3779B1)
                mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
                counts += np.bincount(row[:-k][keep] * BINS + (mixed >> np.uint32(19)), minlength=len(counts))
            letters = np.fromiter((has_letter(raw[s:e]) for s, e in zip(off[i - a : j - a], off[i - a + 1 : j - a + 1])), bool, j - i)
            yield i, counts.reshape(j - i, BINS), letters


def codewords(n: int) -> np.ndarray:
    """One row of +1/-1 bits per language: the exhaustive code up to 6 languages, else the best of seeded draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if (((b + 1) >> i) & 1) == 0 else -1 for b in range(bits)] for i in range(n)], float)
    rng, best, far = np.random.default_rng(7), None, -1
    length = int(np.ceil(12 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, length))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)
        least = apart[~np.eye(n, dtype=bool)].min() if n < 400 else apart.sum()
        if least > far:
            best, far = code, least
    return best


def _margins(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return counts @ weights / np.maximum(counts.sum(axis=1, keepdims=True), 1)


class Model:
    """``langs``, their ``code``, the n-gram ``weights`` of each bit, each bit's ``scale`` and ``trust``, and the least
    margin of a prediction without doubt."""

    def __init__(self, langs, code, weights):
        self.langs, self.code, self.weights = langs, code, weights
        self.scale = np.ones(code.shape[1])
        self.trust = np.ones(code.shape[1])
        self.doubt = 0.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Rows by languages: the softmax of the negative loss against each codeword."""
        loss = self.losses(counts)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """How much farther the second nearest codeword is than the nearest."""
        if len(self.langs) < 2:
            return np.full(len(counts), np.inf)
        near = np.partition(self.losses(counts), 1, axis=1)
        return near[:, 1] - near[:, 0]

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Rows by languages: the weighted loss against each codeword."""
        m = _margins(counts, self.weights) * self.scale
        loss = np.stack([(np.logaddexp(0, -2 * m * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        return loss * (4 / max(1e-9, self.trust.sum()))


def _partial_counts(batches):
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        total: dict[str, np.ndarray] = {}
        for first, counts, _ in ngram_counts(batch.column(0)):
            of = langs[first : first + len(counts)]
            for lang in set(of.tolist()):
                total[lang] = total.get(lang, 0) + counts[of == lang].sum(axis=0)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bin", "n"])


def _bit_errors(model: Model):
    place = {x: i for i, x in enumerate(model.langs)}

    def run(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            bits = model.code.shape[1]
            wrong, size, n = np.zeros(bits), np.zeros(bits), 0
            for first, counts, letters in ngram_counts(batch.column(0)):
                m = _margins(counts, model.weights)[letters]
                truth = model.code[[place[x] for x in langs[first : first + len(counts)]]][letters]
                wrong += (m * truth <= 0).sum(axis=0)
                size += np.abs(m).sum(axis=0)
                n += len(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits)), pa.array(wrong), pa.array(size), pa.array(np.full(bits, float(n)))], ["bit", "wrong", "size", "n"])

    return run


def _recognised(model: Model):
    """Margins of the rows that get their own label."""
    names = np.array(model.langs, dtype=object)

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for first, counts, letters in ngram_counts(batch.column(0)):
                right = letters & (names[model.losses(counts).argmin(axis=1)] == langs[first : first + len(counts)])
                yield pa.RecordBatch.from_arrays([pa.array(model.margins(counts)[right])], ["margin"])

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows with a text and a label. Collected: a row per language, then one per language and bin."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null and id is not null"
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], codewords(0), np.zeros((BINS, 1)))
    code = codewords(len(langs))
    if len(langs) == 1:
        return Model(langs, code, np.zeros((BINS, 1)))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_rows / sizes[lang]))])
    drawn = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    sample = saved(rows.where(drawn("train") < share[F.col("lang")]).select("text", "lang", (drawn("back") < KEPT_BACK).alias("back")), "sample")
    back = sample.where("back").select("text", "lang")
    counts = np.full((len(langs), BINS), 0.02)
    place = {x: i for i, x in enumerate(langs)}
    learned = sample.where("not back").select("text", "lang").mapInArrow(_partial_counts, "lang string, bin long, n double")
    for r in learned.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        counts[place[r["lang"]], r["bin"]] += r["n"]
    p = counts / counts.sum(axis=1, keepdims=True)
    weights = np.stack([np.log(p[bit > 0].mean(axis=0)) - np.log(p[bit < 0].mean(axis=0)) for bit in code.T], axis=1)
    model = Model(langs, code, weights)
    for r in back.mapInArrow(_bit_errors(model), "bit long, wrong double, size double, n double").groupBy("bit").agg(
        *[F.sum(c).alias(c) for c in ("wrong", "size", "n")]
    ).collect():
        error = min(0.49, (r["wrong"] + 1) / (r["n"] + 2))
        model.trust[r["bit"]] = np.log((1 - error) / error)
        model.scale[r["bit"]] = 2 * r["n"] / max(r["size"], 1e-9)
    model.doubt = back.mapInArrow(_recognised(model), "margin double").agg(F.percentile("margin", DOUBTFUL)).first()[0] or 0.0
    forget(sample)
    return model


def _predict(model: Model):
    names = np.array([*model.langs, UNKNOWN], dtype=object)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            best, score, doubt = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n, bool)
            if model.langs:
                for first, counts, letters in ngram_counts(batch.column(batch.num_columns - 1)):
                    s = model.scores(counts)
                    top = s.argmax(axis=1)
                    doubt[first : first + len(top)] = letters & (model.margins(counts) <= model.doubt)
                    best[first : first + len(top)] = np.where(letters, top, len(model.langs))
                    score[first : first + len(top)] = np.where(letters, s.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(doubt)],
                [*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"],
            )

    return run


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``."""
    rows, schema = beside(docs, keep, text_col, "lang_pred string, score double, ambiguous boolean")
    return rows.mapInArrow(_predict(model), schema)
