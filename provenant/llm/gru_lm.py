"""Language-model scoring: a gated recurrent network in numpy, trained by truncated backpropagation, state carried on.

Tokens are A-Z-lowered words and one end per text. The output is factored into classes: first a softmax over classes, then
one over the words of the class. Frequent words (HEAD) are in classes of their own softmax; all others fall into TAILS
classes by their last letters, and within these a word's probability is that of its smoothed count, so every word has one.

Counts cover every training text, and so do gradient steps: each training text belongs to one round, where every token is
predicted once. Texts lie one after the other in slots that run side by side; the state is carried from window to window and
gradients are cut at the window's start. Replicas train on parts of a round's texts from common weights, which are averaged
after each round in a tree. Scoring runs over every token of every text with the state carried on.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import small, text_of, written

#: No word contains a line feed: the end token's key.
END = b"\n"
HEAD = 4096
HEAD_CLASSES, TAILS = 24, 32
#: Words whose counts each worker holds; rarer ones meet their counts in a join.
HELD_WORDS = 1 << 18
HIDDEN = 16
WINDOW, ROUNDS = 32, 4
#: Slots of one gradient step, and tokens of one replica and round.
STEP, REPLICA = 192, 1 << 20
#: Longer texts are trained on in parts of so many windows, each with the window before it as a warm-up that has no goals.
PART = 32
#: Replicas whose weights one task adds up.
FAN = 32
RATE = 0.08
#: Most sequences that are scored side by side, and tokens that a task holds for that.
SLOTS, HELD_TOKENS = 512, 4_000_000
#: Words whose sums a task holds to count them, and words that it hands over at once.
HELD_COUNTS, GIVEN = 1 << 20, 1 << 16
#: Bytes of text that are split into words at once.
PIECE = 1 << 23
FOLD, HELD_OUT = 7, 2


def held_out(doc_id: Column) -> Column:
    """A null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLD)) == HELD_OUT


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def pieces(batches: Iterator[pa.RecordBatch], text: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about PIECE bytes of the text column; a longer text is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + PIECE, "right")))
            yield batch.slice(at, end - at)
            at = end


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The A-Z-lowered words of all texts, and whose each is."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, whose = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    there = pc.greater(pc.binary_length(words), 0)
    return words.filter(there), whose[there.to_numpy(zero_copy_only=False)]


def added(tallies: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(distinct words, their counts) of pieces, added up by word. Once the words not yet added are as many as the sums, they are
    added, so that memory follows the distinct words, not the tokens; sums of too many words are given out on the way."""
    held: list[tuple[pa.Array, np.ndarray]] = []
    summed = size = 0

    def one() -> tuple[pa.Array, np.ndarray]:
        met = pa.concat_arrays([words for words, _ in held]).dictionary_encode()
        sums = np.bincount(met.indices.to_numpy(), np.concatenate([c for _, c in held]), len(met.dictionary))
        return met.dictionary, sums.astype(np.int64)

    for tally in tallies:
        held.append(tally)
        size += len(tally[0])
        if size >= max(HELD_COUNTS // 4, 2 * summed):
            held = [one()]
            summed = size = len(held[0][0])
        if size >= HELD_COUNTS:
            yield one()
            held, summed, size = [], 0, 0
    if held:
        yield one()


def counts(texts: DataFrame) -> DataFrame:
    """Column text -> word (binary), c: how often each token occurs; the end token once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tallies() -> Iterator[tuple[pa.Array, np.ndarray]]:
            for batch in pieces(batches):
                found = pc.value_counts(split(batch.column(0))[0])
                yield found.field("values").cast(pa.binary()), found.field("counts").to_numpy()
                yield pa.array([END], pa.binary()), np.array([batch.num_rows])

        for words, c in added(tallies()):
            yield from small([pa.RecordBatch.from_arrays([words, pa.array(c)], ["word", "c"])], GIVEN)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words by rank, their symbols (head words, then tail classes), and the counts' totals."""

    words: list[bytes]
    c: np.ndarray
    total: int
    distinct: int
    tail_total: np.ndarray
    tail_distinct: np.ndarray
    #: The lowest grade of held words, and the draw below which its words are held.
    least: int = 0
    below: int = 0

    def __post_init__(self) -> None:
        self.head = min(HEAD, len(self.words))
        tails = [tail_class(w) for w in self.words[self.head :]]
        # Of the tail classes only: what the head's words don't have.
        for i, w in enumerate(self.words[: self.head]):
            self.tail_total[tail_class(w)] -= self.c[i]
            self.tail_distinct[tail_class(w)] -= 1
        self.symbol = np.concatenate([np.arange(self.head), self.head + np.array(tails, np.int64)]).astype(np.int32)
        self.log_c = np.log10(self.c + 1.0)
        self.end = self.words.index(END) if END in self.words else 0
        self.found = pa.array(self.words, pa.binary()).cast(pa.string())
        # Head classes by the sum of square roots of counts: frequent words share a class with few others.
        mass = np.cumsum(np.sqrt(self.c[: self.head]))
        self.word_class = np.minimum((mass - mass[0]) / max(mass[-1] - mass[0], 1e-9) * HEAD_CLASSES, HEAD_CLASSES - 1).astype(np.int64) if self.head else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.word_class, np.arange(HEAD_CLASSES + 1))
        self.class_of = np.concatenate([self.word_class, HEAD_CLASSES + np.arange(TAILS)])
        self.log_tail = np.log10(self.tail_total + self.tail_distinct + 1.0)

    @property
    def state(self) -> dict:
        """Plain values that can be sent to workers without this class."""
        return {k: v for k, v in vars(self).items() if k != "words"}

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        made = cls.__new__(cls)
        vars(made).update(state)
        return made

    def ranks(self, words: pa.Array) -> np.ndarray:
        """The ranks of words, -1 for those that are not held."""
        if not len(self.found):
            return np.full(len(words), -1)
        return pc.fill_null(pc.index_in(words, value_set=self.found), -1).to_numpy(zero_copy_only=False)


def _grade(c: Column) -> Column:
    """Counts in steps of a sixteenth of an octave: some hundred grades for counts of any size."""
    return F.floor(F.log2(c) * 16).cast("int")


def _draw() -> Column:
    """A number below 2**20 by which words of one grade are told apart."""
    return F.pmod(F.xxhash64("word"), F.lit(1 << 20))


def _held(least: int, below: int) -> Column:
    """Words of higher grades than `least`, those of that grade with a small draw, and the end token."""
    grade = _grade(F.col("c"))
    return (grade > least) | (grade == least) & (_draw() < below) | (F.col("word") == F.lit(bytearray(END)))


def vocabulary(found: DataFrame, held: int = HELD_WORDS) -> Vocabulary:
    """From the counts: about `held` words of the highest grades (of the last of these grades a part, by draw) and TAILS pairs of
    totals come to the driver, however many texts there are."""
    sizes = sorted(((r["grade"], r["n"]) for r in found.groupBy(_grade(F.col("c")).alias("grade")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, below, room = 1 << 20, 0, held
    for grade, n in sizes:
        least, below = grade, min(1 << 20, (room << 20) // n)
        room -= n
        if room <= 0:
            break
    top = found.where(_held(least, below)).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    tail = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(TAILS)).alias("tail")
    totals, distincts = np.zeros(TAILS), np.zeros(TAILS)
    for row in found.groupBy(tail).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        totals[row["tail"]], distincts[row["tail"]] = row["n"], row["v"]
    return Vocabulary(top["word"].to_pylist(), top["c"].to_numpy().astype(float), int(totals.sum()), int(distincts.sum()), totals, distincts, least, below)


class Model:
    """Weights and passes. Inputs are one-hot, so the input table holds each symbol's gate pre-activations."""

    names = ("table", "recur", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, words: Vocabulary, weights: dict[str, np.ndarray] | None = None) -> None:
        self.bounds, self.class_of, self.head, self.end = words.bounds, words.class_of, words.head, words.end
        if weights is None:
            random = np.random.default_rng(7)
            h, symbols, classes = HIDDEN, words.head + TAILS, HEAD_CLASSES + TAILS
            mass = np.zeros(classes)
            np.add.at(mass, words.word_class, words.c[: words.head] + 1)
            mass[HEAD_CLASSES:] += words.tail_total + words.tail_distinct + 1
            own = words.c[: words.head] + 1
            weights = {
                "table": random.normal(0, 0.5, (symbols, 3 * h)),
                "recur": random.normal(0, 0.7 / math.sqrt(h), (h, 3 * h)),
                "class_w": np.zeros((h, classes)),
                "class_b": np.log((mass + 1e-3) / (mass + 1e-3).sum()),
                "word_w": np.zeros((words.head, h)),
                "word_b": np.log(own / mass[words.word_class]),
            }
        self.weights = {k: np.ascontiguousarray(weights[k], np.float32) for k in self.names}
        self.bound: float | None = None

    def states(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, kept: list | None = None) -> np.ndarray:
        """The states after each input of x (steps, rows); keep is 0 where a row's state starts anew before the step."""
        recur, n = self.weights["recur"], HIDDEN
        inputs = self.weights["table"][x]
        anew = ~keep.all(1)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)):
            if anew[t]:
                h = h * keep[t][:, None]
            a, g = inputs[t], h @ recur
            gates = a[:, : 2 * n] + g[:, : 2 * n]  # the sigmoid of x is half of tanh(x / 2) + 1
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :n], gates[:, n:]
            new = r * g[:, 2 * n :]
            new += a[:, 2 * n :]
            np.tanh(new, out=new)
            if kept is not None:
                kept.append((h, z, r, new, g[:, 2 * n :]))
            h = np.add(new, z * (h - new), out=out[t])
        return out

    def _spans(self, classes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, end, rows) for each head class with rows."""
        order = np.argsort(classes.astype(np.uint8), kind="stable")  # small integers are sorted by their digits
        ends = np.searchsorted(classes[order], np.arange(HEAD_CLASSES + 1))
        for k in range(HEAD_CLASSES):
            if ends[k + 1] > ends[k]:
                yield int(self.bounds[k]), int(self.bounds[k + 1]), order[ends[k] : ends[k + 1]]

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each symbol given its state."""
        w = self.weights
        classes = self.class_of[y]
        logits = self._levelled(h @ w["class_w"] + w["class_b"])
        out = logits[np.arange(len(y)), classes] - np.log(np.exp(logits) @ np.ones(logits.shape[1], np.float32))
        for a, b, rows in self._spans(classes):
            if b - a > 1:
                inner = self._levelled(h[rows] @ w["word_w"][a:b].T + w["word_b"][a:b])
                out[rows] += inner[np.arange(len(rows)), y[rows] - a] - np.log(np.exp(inner) @ np.ones(b - a, np.float32))
        return out

    def _levelled(self, logits: np.ndarray) -> np.ndarray:
        """Logits whose exponentials are finite: states are within 1, so sums of weights bound them."""
        if self.bound is None:
            w = self.weights
            sums = [np.abs(w["class_w"]).sum(0) + np.abs(w["class_b"]), np.abs(w["word_w"]).sum(1) + np.abs(w["word_b"])]
            self.bound = max(float(x.max(initial=0)) for x in sums)
        return logits if self.bound < 60 else logits - logits.max(1, keepdims=True)

    def step(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, goal: np.ndarray, h: np.ndarray, squares: dict[str, np.ndarray], rate: float) -> tuple[float, np.ndarray]:
        """One AdaGrad step over a window: inputs, symbols to predict, keep (see states) and which symbols are goals, each
        (steps, rows), from the states h. The goals' loss in nats and the states after the window."""
        w, n = self.weights, HIDDEN
        steps, rows = x.shape
        kept: list = []
        states = self.states(x, keep, h, kept)
        flat = states.reshape(-1, n)
        scored = None if goal.all() else np.flatnonzero(goal.reshape(-1))
        out, target = (flat, y.reshape(-1)) if scored is None else (flat[scored], y.reshape(-1)[scored])
        if not len(target):
            return 0.0, states[-1]
        each = np.float32(1 / len(target))
        classes = self.class_of[target]
        at = np.arange(len(target))
        self.bound = None
        p = self._levelled(out @ w["class_w"] + w["class_b"])
        loss = -float(p[at, classes].sum())
        np.exp(p, out=p)
        total = p @ np.ones(p.shape[1], np.float32)
        loss += float(np.log(total).sum())
        p *= (each / total)[:, None]
        p[at, classes] -= each
        grads = {"class_w": out.T @ p, "class_b": np.ones(len(p), np.float32) @ p, "word_w": np.zeros_like(w["word_w"]), "word_b": np.zeros_like(w["word_b"])}
        dh = p @ w["class_w"].T
        for a, b, own in self._spans(classes):
            if b - a > 1:
                hr = out[own]
                q = self._levelled(hr @ w["word_w"][a:b].T + w["word_b"][a:b])
                spot = np.arange(len(own)), target[own] - a
                loss -= float(q[spot].sum())
                np.exp(q, out=q)
                total = q @ np.ones(b - a, np.float32)
                loss += float(np.log(total).sum())
                q *= (each / total)[:, None]
                q[spot] -= each
                grads["word_w"][a:b] = q.T @ hr
                grads["word_b"][a:b] = np.ones(len(q), np.float32) @ q
                dh[own] += q @ w["word_w"][a:b]
        if scored is None:
            back = dh.reshape(steps, rows, n)
        else:
            back = np.zeros((steps * rows, n), np.float32)
            back[scored] = dh
            back = back.reshape(steps, rows, n)
        carried = np.zeros((rows, n), np.float32)
        d_in = np.empty((steps, rows, 3 * n), np.float32)
        d_rec = np.empty_like(d_in)
        before = np.empty((steps, rows, n), np.float32)
        turned, anew = np.ascontiguousarray(w["recur"].T), ~keep.all(1)
        for t in range(steps - 1, -1, -1):
            old, z, r, new, g = kept[t]
            d = back[t] + carried
            dn = d * (1 - z)
            dn *= 1 - new * new
            ins, recs = d_in[t], d_rec[t]
            ins[:, 2 * n :] = dn
            np.multiply(d * (old - new), z * (1 - z), out=ins[:, :n])
            np.multiply(dn * g, r * (1 - r), out=ins[:, n : 2 * n])
            recs[:, : 2 * n] = ins[:, : 2 * n]
            np.multiply(dn, r, out=recs[:, 2 * n :])
            before[t] = old
            d *= z
            carried = recs @ turned
            carried += d
            if anew[t]:
                carried *= keep[t][:, None]
        grads["recur"] = before.reshape(-1, n).T @ d_rec.reshape(-1, 3 * n)
        inputs = x.reshape(-1).astype(np.uint16)
        order = np.argsort(inputs, kind="stable")
        inputs = inputs[order]
        first = np.flatnonzero(np.diff(inputs.astype(np.int32), prepend=-1))
        used = inputs[first]
        sums = np.add.reduceat(d_in.reshape(-1, 3 * n)[order], first, axis=0)
        for name, grad in grads.items():
            squares[name] += grad * grad
            w[name] -= rate * grad / np.sqrt(squares[name])
        squares["table"][used] += sums * sums
        w["table"][used] -= rate * sums / np.sqrt(squares["table"][used])
        return loss, states[-1]


def parts(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(symbols that are no goals, symbols) of a text's parts: PART windows of goals each, after a window to warm up."""
    for first in range(0, len(symbols), PART * WINDOW):
        warm = min(first, WINDOW)
        yield warm, symbols[first - warm : first + PART * WINDOW]


class Lanes:
    """Sequences one after the other in slots, the longest first into the emptiest: (steps, slots) of inputs, symbols to
    predict, whose they are, keep, and the slots' lengths, descending."""

    def __init__(self, sequences: list[np.ndarray], slots: int, end: int) -> None:
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        loads = [(0, s) for s in range(min(slots, len(order)))]
        lists: list[list[int]] = [[] for _ in loads]
        for i in order:
            load, s = heapq.heappop(loads)
            lists[s].append(i)
            heapq.heappush(loads, (load + len(sequences[i]), s))
        lists.sort(key=lambda own: -sum(len(sequences[i]) for i in own))
        self.lengths = np.array([sum(len(sequences[i]) for i in own) for own in lists])
        shape = int(self.lengths.max(initial=0)), len(lists)
        self.y, self.who, self.place = (np.zeros(shape, np.int32) for _ in range(3))
        self.x, self.keep = np.full(shape, end, np.int32), np.ones(shape, np.float32)
        for s, own in enumerate(lists):
            at = 0
            for i in own:
                size = len(sequences[i])
                self.y[at : at + size, s], self.who[at : at + size, s] = sequences[i], i
                self.place[at : at + size, s] = np.arange(size)
                self.x[at + 1 : at + size, s] = sequences[i][:-1]
                self.keep[at, s] = 0
                at += size

    def windows(self) -> Iterator[tuple[slice, int, np.ndarray]]:
        """(steps, active slots, which of their symbols there are) of each window."""
        for t in range(0, len(self.y), WINDOW):
            active = int((self.lengths > t).sum())
            span = slice(t, min(t + WINDOW, len(self.y)))
            yield span, active, np.arange(span.start, span.stop)[:, None] < self.lengths[None, :active]


def learn(model: Model, found: list[tuple[int, np.ndarray]], squares: dict[str, np.ndarray], rate: float) -> float:
    """Gradient steps over parts of texts, the state carried from window to window; the loss of all goals in nats."""
    lanes = Lanes([s for _, s in found], STEP, model.end)
    warm = np.array([n for n, _ in found])
    h, loss = np.zeros((len(lanes.lengths), HIDDEN), np.float32), 0.0
    for span, active, valid in lanes.windows():
        goal = valid & (lanes.place[span, :active] >= warm[lanes.who[span, :active]])
        more, h = model.step(lanes.x[span, :active], lanes.y[span, :active], lanes.keep[span, :active], goal, h[:active], squares, rate)
        loss += more
    return loss


_CHUNK = 1 << 15


def train(found: DataFrame, words: Vocabulary) -> dict[str, np.ndarray]:
    """Columns symbols (binary), n_tokens and round -> weights. The number of replicas grows with the tokens; their weights are
    averaged on the cluster, at most FAN at once, before they come to the driver. Without texts, the weights are those of the
    counts."""
    context = found.sparkSession.sparkContext
    weights = Model(words).weights
    sizes = {r["round"]: r["n"] for r in found.groupBy("round").agg(F.sum("n_tokens").alias("n")).collect()}  # ROUNDS rows
    for number in sorted(sizes):
        shared = context.broadcast((words.state, weights))
        rate = RATE / (1 + number)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, start = shared.value
            model = Model(Vocabulary.of(own), {k: v.copy() for k, v in start.items()})
            squares = {k: np.full_like(v, 1e-6) for k, v in model.weights.items()}
            seen, size, held = 0, 0, []
            for batch in small(batches):
                for symbols in batch.column(0).to_pylist():
                    held += parts(np.frombuffer(symbols, np.uint16).astype(np.int32))
                    size += len(symbols) // 2
                    if size >= 2 * STEP * PART * WINDOW:
                        learn(model, held, squares, rate)
                        seen, size, held = seen + size, 0, []
            if held:
                learn(model, held, squares, rate)
                seen += size
            if seen:
                flat = np.concatenate([model.weights[k].reshape(-1) for k in Model.names])
                pieces = [flat[i : i + _CHUNK].tobytes() for i in range(0, len(flat), _CHUNK)]
                task = TaskContext.get()
                many = len(pieces)
                columns = [pa.array([task.partitionId() if task else 0] * many, pa.int32()), pa.array(range(many), pa.int32()), pa.array([seen] * many, pa.int64()), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["replica", "chunk", "seen", "part"])

        def average(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(s * np.frombuffer(p, np.float32).astype(float) for s, p in zip(pdf["seen"], pdf["part"], strict=True))
            seen = int(pdf["seen"].sum())
            return pd.DataFrame({"replica": [pdf["replica"].iloc[0] // FAN], "chunk": [pdf["chunk"].iloc[0]], "seen": [seen], "part": [(total / seen).astype(np.float32).tobytes()]})

        replicas = -(-sizes[number] // REPLICA)
        schema = "replica int, chunk int, seen long, part binary"
        trained = found.where(F.col("round") == number).select("symbols").repartition(replicas).mapInArrow(run, schema)
        while True:
            trained = trained.groupBy(F.floor(F.col("replica") / FAN), "chunk").applyInPandas(average, schema)
            if replicas <= FAN:
                break
            replicas = -(-replicas // FAN)
        flat = np.frombuffer(b"".join(r["part"] for r in sorted(trained.collect(), key=lambda r: r["chunk"])), np.float32)  # the weights, about a MB
        ends = np.cumsum([weights[k].size for k in Model.names])
        weights = {k: flat[e - weights[k].size : e].reshape(weights[k].shape).copy() for k, e in zip(Model.names, ends, strict=True)}
        shared.unpersist()
    return weights


def score_sequences(model: Model, sequences: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Natural logarithm of the probability of each sequence of symbols; a state runs on to its sequence's end."""
    out = np.zeros(len(sequences))
    sizes = [len(s) for s in sequences]
    lanes = Lanes(sequences, min(slots, -(-sum(sizes) // max(sizes, default=1))), model.end)  # as many as the longest leaves full
    h = np.zeros((len(lanes.lengths), HIDDEN), np.float32)
    for span, active, valid in lanes.windows():
        states = model.states(lanes.x[span, :active], lanes.keep[span, :active], h[:active])
        h = states[-1]
        values = model.log_probs(states[valid], lanes.y[span, :active][valid])
        out += np.bincount(lanes.who[span, :active][valid], values.astype(float), len(out))
    return out


def encode(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, text, held_out -> doc_id, held_out, n_tokens, held_known, held_base and tail (sums of held words' logarithms),
    rare (the words that are not held), symbols (binary, 16 bits each), round (-1: held out)."""
    shared = rows.sparkSession.sparkContext.broadcast(words.state)  # bounded by HELD_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary.of(shared.value)
        for batch in pieces(batches, 1):
            many = batch.num_rows
            words, whose = split(batch.column(1))
            ranks = np.full(len(words) + many, own.end, np.int64)
            place = np.arange(len(words)) + whose  # an end token after each text
            ranks[place] = own.ranks(words)
            sizes = np.bincount(whose, minlength=many) + 1
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(many), sizes)
            known = ranks >= 0 if len(own.symbol) else np.zeros(len(ranks), bool)
            symbols = np.zeros(len(ranks), np.uint16)
            symbols[known] = own.symbol[ranks[known]]
            lost = known[place]
            odd = words.filter(pa.array(~lost)).cast(pa.binary())
            symbols[place[~lost]] = [own.head + tail_class(w) for w in odd.to_pylist()]
            if not len(own.symbol):
                symbols[ends - 1] = own.head + tail_class(END)
            late = symbols >= own.head
            base, tail = np.zeros(len(ranks)), np.zeros(len(ranks))
            base[known] = own.log_c[ranks[known]]
            tail[late] = np.where(known[late], base[late], 0) - own.log_tail[symbols[late] - own.head]
            rounds = [zlib.crc32(symbols[e - n : e]) % ROUNDS for n, e in zip(sizes, ends, strict=True)]
            away = batch.column(2).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], ends]).astype(np.int32)
            odd_ends = np.concatenate([[0], np.cumsum(np.bincount(whose[~lost], minlength=many))]).astype(np.int32)
            columns = [
                pa.array(sizes, pa.int64()), pa.array(np.bincount(owner, known, many).astype(np.int64)), pa.array(np.bincount(owner, base, many)), pa.array(np.bincount(owner, tail, many)),
                pa.ListArray.from_arrays(pa.array(odd_ends), odd), pa.BinaryArray.from_buffers(pa.binary(), many, [None, pa.py_buffer(starts * np.int32(2)), pa.py_buffer(symbols)]),
                pa.array(np.where(away, -1, rounds).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "held_out", "n_tokens", "held_known", "held_base", "tail", "rare", "symbols", "round"])

    schema = "doc_id long, held_out boolean, n_tokens long, held_known long, held_base double, tail double, rare array<binary>, symbols binary, round int"
    return rows.select("doc_id", "text", "held_out").mapInArrow(run, schema)


def score(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Texts whose crc32(doc_id) mod 7 is 2 are held out of all counts and training. A null text is empty: one end token. Repeated
    rows train and score like others; a null doc_id counts as an empty text. Without training rows every count is zero. Other columns are
    not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    counted = written(counts(rows.where(~F.col("held_out"))), "counts")
    words = vocabulary(counted)
    encoded = written(encode(rows, words).withColumn("row", F.monotonically_increasing_id()), "encoded")
    weights = train(encoded.where("round >= 0"), words)
    shared = docs.sparkSession.sparkContext.broadcast((words.state, weights))  # bounded by HELD_WORDS and the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, learned = shared.value
        model = Model(Vocabulary.of(state), learned)
        rows: list[int] = []
        sequences: list[np.ndarray] = []
        tokens = 0

        def handed() -> pa.RecordBatch:
            scores = score_sequences(model, sequences) / math.log(10)
            made = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(scores, pa.float64())], ["scored_row", "net"])
            rows.clear(), sequences.clear()
            return made

        for batch in small(batches):
            for row, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                sequences.append(np.frombuffer(symbols, np.uint16))
                tokens += len(sequences[-1])
                if tokens >= HELD_TOKENS:
                    yield handed()
                    tokens = 0
        if rows:
            yield handed()

    scored = encoded.select("row", "symbols").mapInArrow(run, "scored_row long, net double")
    rare = encoded.select("row", F.explode("rare").alias("word"))
    seen = rare.join(counted.where(~_held(words.least, words.below)).select("word", "c"), "word")
    seen = seen.groupBy(F.col("row").alias("seen_row")).agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("c") + 1.0)).alias("log_c"))
    more = F.coalesce("log_c", F.lit(0.0))
    told = encoded.drop("rare", "symbols", "round").join(scored, F.col("row") == F.col("scored_row")).join(seen, F.col("row") == F.col("seen_row"), "left")
    return told.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("held_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("held_base") + more - F.col("n_tokens") * F.lit(math.log10(words.total + words.distinct + 1))).alias("base_score"),
        (F.col("net") + F.col("tail") + more).alias("score"),
    )
