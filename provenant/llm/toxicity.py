"""Toxicity by a classifier chain: categories are predicted one after the other, each linear model sees the probabilities
of the categories before it, and it was trained with their out-of-fold predictions.

Features of a text are its words (A-Z lowered, without outer punctuation) and their first four to six letters, hashed; each
counts once a text, so length tells nothing. Models are logistic, fitted in numpy on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from provenant.llm.common import small, text_of

#: Labelled texts that the models are fitted on: those of least hash, so the sample is random and the same in each run.
SAMPLE = 8_000
#: Hashed features: two to this power.
BITS = 18
#: A feature is in so many of the texts fitted on, and its frequency differs between labels: chi-square, one in a thousand.
LEAST, CHI_SQUARE = 8, 10.83
FOLDS = 4
#: Probability of the last category from which a text is rejected.
THRESHOLD = 0.5
#: The categories in the order of the chain, as SQL over the labels quality and toxic (null: not labelled).
CATEGORIES = (
    ("low_quality", "quality = 0"),
    ("degrading", "toxic = 1 AND coalesce(quality, 1) = 0"),
    ("abusive", "toxic = 1"),
)

_PREFIXES = (4, 5, 6)
_EDGES = ".,;:!?\"'()[]{}*#%&$|<>/\\-_=+~`^"


def feature_ids(text: str, bits: int = BITS) -> np.ndarray:
    """The distinct hashed features of a text, sorted; none for an empty one."""
    words = {w.strip(_EDGES) for w in set(text.lower().split())}
    words.discard("")
    digest, mask = xxhash.xxh64_intdigest, (1 << bits) - 1
    found = {digest(w) & mask for w in words}
    for n in _PREFIXES:
        found.update(digest(p, n) & mask for p in {w[:n] for w in words if len(w) >= n})
    return np.array(sorted(found), np.int32)


class Rows:
    """A binary matrix in compressed rows, with extra dense columns."""

    def __init__(self, rows: Sequence[np.ndarray], width: int) -> None:
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.ids = np.concatenate(rows).astype(np.int32) if len(rows) else np.zeros(0, np.int32)
        self.width = width
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.starts))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.ids], len(self.starts) - 1)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, values[self.row], self.width)

    def only(self, chosen: np.ndarray) -> Rows:
        """The same rows with some of the columns."""
        part, some = Rows((), int(chosen.sum())), chosen[self.ids]
        part.ids, part.row, part.starts = (np.cumsum(chosen, dtype=np.int32) - 1)[self.ids[some]], self.row[some], self.starts
        return part


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _telling(rows: Rows, labels: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Features whose frequency differs between the labels of the chosen rows, by a chi-square test."""
    yes, no = rows.back((labels & chosen).astype(float)), rows.back((~labels & chosen).astype(float))
    all_yes, all_no = (labels & chosen).sum(), (~labels & chosen).sum()
    both, rest = yes + no, all_yes + all_no - yes - no
    spread = np.maximum(float(all_yes) * all_no * both * rest, 1e-9)
    return (both >= LEAST) & ((yes * (all_no - no) - no * (all_yes - yes)) ** 2 * (all_yes + all_no) / spread >= CHI_SQUARE)


def fit(rows: Rows, extra: np.ndarray, labels: np.ndarray, chosen: np.ndarray, penalty: float = 2e-4, rounds: int = 100) -> np.ndarray:
    """Weights of features, extra columns and bias: logistic loss over the chosen rows, the rarer label weighing more by the root of the odds, by
    full-batch AdaGrad with an L2 penalty, for the features that tell. One label only gives a constant model."""
    weights = np.zeros(rows.width + extra.shape[1] + 1)
    if not chosen.any() or len(np.unique(labels[chosen])) < 2:
        weights[-1] = 0.0 if not chosen.any() else 20.0 if labels[chosen][0] else -20.0
        return weights
    telling = _telling(rows, labels, chosen)
    part = rows.only(telling)
    own, squares = np.zeros(part.width + extra.shape[1] + 1), np.full(part.width + extra.shape[1] + 1, 1e-8)
    share = labels[chosen].mean()
    each = np.where(labels, 0.5 / share, 0.5 / (1 - share)) ** 0.5 * chosen / chosen.sum()
    for _ in range(rounds):
        error = (_sigmoid(score(own, part, extra)) - labels) * each
        gradient = np.concatenate([part.back(error), extra.T @ error, [error.sum()]]) + penalty * np.append(own[:-1], 0)
        squares += gradient**2
        own -= 0.5 * gradient / np.sqrt(squares)
    weights[: rows.width][telling] = own[: part.width]
    weights[rows.width :] = own[part.width :]
    return weights


def score(weights: np.ndarray, rows: Rows, extra: np.ndarray) -> np.ndarray:
    return rows.dot(weights[: rows.width]) + extra @ weights[rows.width : -1] + weights[-1]


def fit_chain(found: Sequence[np.ndarray], labels: np.ndarray, folds: np.ndarray, width: int) -> list[np.ndarray]:
    """One model a category; labels has a column for each, -1 where it is not known; extra columns are the probabilities of
    the categories before, out of fold: each row's by models that didn't see its fold."""
    rows = Rows(found, width)
    extra, models = np.zeros((len(found), 0)), []
    for k in range(labels.shape[1]):
        known, truth = labels[:, k] >= 0, labels[:, k] > 0
        unseen = np.zeros(len(found))
        for fold in np.unique(folds):
            weights = fit(rows, extra, truth, known & (folds != fold))
            unseen = np.where(folds == fold, score(weights, rows, extra), unseen)
        models.append(fit(rows, extra, truth, known))
        extra = np.column_stack([extra, _sigmoid(unseen)])
    return models


def apply_chain(models: Sequence[np.ndarray], found: Sequence[np.ndarray], width: int) -> np.ndarray:
    """Probabilities, a column a category, for rows of features."""
    rows = Rows(found, width)
    extra, out = np.zeros((len(found), 0)), []
    for weights in models:
        out.append(_sigmoid(score(weights, rows, extra)))
        extra = np.column_stack([extra, out[-1]])
    return np.column_stack(out) if out else np.zeros((len(found), 0))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories: Sequence[tuple[str, str]] = CATEGORIES, bits: int = BITS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which features are kept, and the chain's models.

    At most `sample` labelled texts are used, the copies of a text once (a fold must not see its copies). Several labels of
    one document count by their largest values; a null label tells nothing, a label with a null doc_id is of no text. Null texts
    are empty. Without labels, or without documents that have some, the models say a half.
    """
    asked = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    asked = asked.where("doc_id IS NOT NULL").withColumn("draw", F.xxhash64("doc_id")).orderBy("draw").limit(sample)
    asked = asked.select(F.col("doc_id").alias("labelled_id"), *[F.expr(f"coalesce(cast({sql} AS int), -1)").alias(f"c{i}") for i, (_, sql) in enumerate(categories)])
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(asked), F.col("doc_id") == F.col("labelled_id"))  # no more rows than `sample`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            kinds, ids = [], []
            for text in batch.column(0).to_pylist():
                kinds.append(xxhash.xxh64_intdigest(text.encode()) >> 1)
                ids.append(feature_ids(text, bits))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(kinds, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names[1:], "kind", "ids"])

    marks = [f"c{i}" for i in range(len(categories))]
    schema = ", ".join(f"{m} int" for m in marks) + ", kind long, ids array<int>"
    rows = texts.select("text", *marks).mapInArrow(run, schema).toArrow()
    width = 1 << bits
    kinds, first = np.unique(rows["kind"].to_numpy(), return_index=True)
    values = np.column_stack([rows[m].to_numpy()[first] for m in marks]) if len(first) else np.zeros((0, len(marks)), int)
    ids = rows["ids"].combine_chunks()
    del rows
    found = [ids[int(i)].values.to_numpy() for i in first]
    counts = np.bincount(np.concatenate(found), minlength=width) if len(found) else np.zeros(width, np.int64)
    kept = counts >= LEAST
    slot = np.cumsum(kept, dtype=np.int32) - 1
    found = [slot[r[kept[r]]] for r in found]
    del ids
    return kept, fit_chain(found, values, (kinds % FOLDS).astype(int), int(kept.sum()))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, categories: Sequence[tuple[str, str]] = CATEGORIES) -> DataFrame:
    """Docs with the columns tox_<category> (double) and tox_rejected (boolean); rows and other columns as they are.

    Null texts are empty; an empty text has no features. Columns of docs with those names are replaced; an empty table gives no rows.
    """
    kept, models = train(docs, labels, sample, categories)
    context = docs.sparkSession.sparkContext
    width = int(kept.sum())
    shared = context.broadcast((np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32), models))  # bounded by the features
    names = [f"tox_{name}" for name, _ in categories]
    bits = BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, chain = shared.value
        for batch in small(batches):
            found = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                ids = slots[feature_ids(text, bits)]
                found.append(ids[ids >= 0])
            out = apply_chain(chain, found, width)
            columns = [pa.array(out[:, k], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns, pa.array(out[:, -1] >= threshold)], [*batch.schema.names[:-1], *names, "tox_rejected"])

    base = docs.drop(*names, "tox_rejected")
    schema = StructType([*base.schema.fields, *(StructField(n, DoubleType()) for n in names), StructField("tox_rejected", BooleanType())])
    hidden = "tox_text_" + "_" * max(len(x.name) for x in base.schema)  # longer than any other name
    return base.withColumn(hidden, text_of()).mapInArrow(run, schema)
