"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; runs of characters that are not letters become one space, so words are framed by spaces. n-grams
of 1 to 3 characters are hashed to BUCKETS features. Counts are summed on Spark, and the matrix of log probabilities
(BUCKETS x languages, whatever the corpus) goes to the tasks, which score batches of texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, unused

BUCKETS = 1 << 15
ORDERS = 3
#: Documents that the model is fitted on, at most about this many; the choice is by hash of the id.
TRAINING_DOCS = 20_000
RUN_CHARS = 1_000_000
_letter = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def ngram_features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document index, feature) of all n-grams of the texts, by order n. A text without letters has none."""
    lower = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(lower), dtype=np.int32), [len(t) for t in lower])
    letter = _letters()[codes]
    first = np.ones(len(codes), bool)
    first[1:] = letter[:-1] | (doc[1:] != doc[:-1])
    keep = letter | first  # a letter, or the first of a run of others
    c, doc, letter = np.where(letter, codes, 32)[keep].astype(np.uint32), doc[keep], letter[keep]
    yield doc[letter], (c[letter] * np.uint32(0x9E3779B1)) >> np.uint32(17)
    h = c * np.uint32(0x9E3779B1)
    for n in range(2, ORDERS + 1):
        same = doc[n - 1 :] == doc[: len(doc) - n + 1]
        h = (h[: len(c) - n + 1] ^ (h[: len(c) - n + 1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0xC2B2AE35)
        if n == 2:
            same &= letter[:-1] | letter[1:]
        yield doc[: len(h)][same], (h ^ (h >> np.uint32(13)))[same] * np.uint32(0x27D4EB2F) >> np.uint32(17)


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > RUN_CHARS:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, texts[start:]


class Model:
    def __init__(self, langs: list[str], log_prior: np.ndarray, log_prob: np.ndarray):
        self.langs, self.log_prior, self.log_prob = langs, log_prior, log_prob

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language (-1: no letters, or nothing learned) and its probability, per text."""
        best, sure = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.langs:
            return best, sure
        for start, run in _runs(texts):
            total, some = np.zeros((len(run), len(self.langs))), np.zeros(len(run), bool)
            for doc, feature in ngram_features(run):
                some[doc] = True
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(doc, self.log_prob[k][feature], len(run))
            total += self.log_prior
            p = np.exp(total - total.max(1, keepdims=True))
            top = total.argmax(1)
            here = slice(start, start + len(run))
            best[here] = np.where(some, top, -1)
            sure[here] = np.where(some, p[np.arange(len(run)), top] / p.sum(1), 0.0)
        return best, sure


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5) == 0


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", training_docs: int = TRAINING_DOCS) -> Model:
    """Learn from rows whose text and lang are not null and that are not held out.

    All such rows, if there are at most training_docs of them; else about that many, chosen by hash of the id.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out("id"), F.lit(False)))
    n = rows.count()
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // training_docs)))) == 0) if n > training_docs else rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, run in _runs(texts):
                own = langs[start : start + len(run)]
                names = sorted(set(own))
                which = np.array([names.index(x) for x in own])
                for name in names:
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    docs[name] = docs.get(name, 0) + own.count(name)
                for doc, feature in ngram_features(run):
                    both = np.bincount(which[doc] * BUCKETS + feature, minlength=len(names) * BUCKETS).reshape(len(names), -1)
                    for name, row in zip(names, both):
                        sums[name] += row
        for name in sums:
            at = np.flatnonzero(sums[name])
            ids, values = np.concatenate([[-1], at]), np.concatenate([[docs[name]], sums[name][at]])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.int32()), pa.array(values, pa.int64())], names=["lang", "f", "n"])

    counted = bounded_batches(rows.select("text", "lang")).mapInArrow(lean(count), "lang string, f int, n bigint").groupBy("lang", "f").agg(F.sum("n").alias("n"))
    got = counted.toArrow().to_pydict()  # at most languages x (BUCKETS + 1) rows
    langs = sorted(set(got["lang"]))
    place = {x: i for i, x in enumerate(langs)}
    k, f, v = np.array([place[x] for x in got["lang"]], int), np.array(got["f"], int), np.array(got["n"], float)
    sums = np.full((len(langs), BUCKETS), 0.5)
    docs = np.ones(len(langs))
    docs[k[f < 0]] = v[f < 0]
    sums[k[f >= 0], f[f >= 0]] += v[f >= 0]
    return Model(langs, np.log(docs / max(1, docs.sum())), np.log(sums / sums.sum(1, keepdims=True)) if langs else sums)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, held_out, lang_pred, score, and the columns in keep, for every row of df.

    lang_pred is a learned language, or und with score 0 if the text is null or has no letters, or nothing was learned.
    score is the model's probability of lang_pred. Columns in keep that are named like the result's own are left out; an
    empty table gives an empty result. Only the text is looked at, as a whole. A null id is not held out.
    """
    columns = [c for c in dict.fromkeys((id_col, *keep)) if c not in (text_col, "held_out", "lang_pred", "score")]
    rows = df.select(F.col(text_col).alias(unused(df, "_text")), *columns, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*columns, "held_out"])
    fields += f", `{text_col}` string" if text_col in keep else ""
    langs = [*model.langs, "und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, sure = model.score([t or "" for t in batch.column(0).to_pylist()])
            cols = [*batch.columns[1:], *([batch.column(0)] if text_col in keep else [])]
            names = [*columns, "held_out", *([text_col] if text_col in keep else [])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([langs[b] for b in best], pa.string()), pa.array(sure, pa.float64())], names=[*names, "lang_pred", "score"])

    return bounded_batches(rows).mapInArrow(lean(run), f"{fields}, lang_pred string, score double")
