"""Whole-document log-likelihood by a gated recurrent language model.

A word's probability is that of its class given everything before it in the
document, times that of the word within its class.  Classes are the end of a
text, the most frequent words (each its own class) and word endings for all
other words, as counted over all training documents.  The class softmax sits on
a gated recurrent unit trained in numpy by back-propagation truncated to
windows, on every word of every training document: in rounds, in each of which
all partitions learn from documents of their own where they lie and their
networks are averaged; in scoring, the state is carried
across windows, so a document is scored whole however long it is.  Within a
class, words have smoothed relative frequencies counted over all training
documents: buckets send every distinct word's hash, ending and count to hash
owners and get the totals back (see exchange.py), so the vocabulary has no cap
and never meets in one place.  Probabilities of all words and one unknown word
per class sum to one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from . import shared
from . import textcore as C

#: Words with a class of their own, classes of endings, hidden units.
TOP_WORDS, ENDINGS, HIDDEN = 80, 47, 24
#: Updates of a small input, most lanes of an update (fewer where words would not make so many updates), its steps, and the learning rate.
UPDATES, LANES, WINDOW, RATE = 500, 256, 32, 0.01
#: Rounds end behind these parts (of 16, by a hash) of the training documents; a task's text bytes in a small input; bytes classed at a time.
ROUNDS, TASK_BYTES, CHUNK_BYTES = (1, 16), 16 << 20, 4 << 20
#: Lanes in scoring; states whose classes are worked on at a time (results don't depend on either).
SCORE_LANES, BLOCK_ROWS = 512, 1024
END = 0  # class of the end of a text; also what a document starts from

_U = np.uint64


@dataclass
class Network:
    top: np.ndarray  # sorted hashes of the frequent words
    top_class: np.ndarray
    ending: np.ndarray  # last two bytes -> class
    w: dict[str, np.ndarray]
    tokens: int = 0  # of all training documents
    size: int = 0  # their bytes, about

    @property
    def classes(self) -> int:
        return len(self.w["bo"])


def _endings(w: C.Words) -> np.ndarray:
    """Last two bytes of each word as a number."""
    last = w.data[w.end - 1].astype(np.int64)
    return np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64) * 256 + last


def classes_of(net: Network, w: C.Words) -> np.ndarray:
    out = net.ending[_endings(w)]
    if len(net.top):
        at = np.minimum(np.searchsorted(net.top, w.hash), len(net.top) - 1)
        out = np.where(net.top[at] == w.hash, net.top_class[at], out)
    return out


def _distinct(w: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, each word's place among them, and a word of each."""
    h, place = np.unique(w.hash, return_inverse=True)
    one = np.empty(len(h), np.int64)
    one[place] = np.arange(len(place))
    return h, place, one


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _step(h: np.ndarray, x: np.ndarray, w: dict[str, np.ndarray], n: int):
    """Gates and next state, as defined; x: the input's share of all three.  Cell does the same in fewer passes, and tests compare both."""
    a = _sig(x[:, : 2 * n] + h @ w["U"][:, : 2 * n])
    z, r = a[:, :n], a[:, n:]
    rh = r * h
    c = np.tanh(x[:, 2 * n :] + rh @ w["U"][:, 2 * n :])
    return z, r, rh, c, h + z * (c - h)


class Cell:
    """The unit's steps on whole arrays of one gate after the other, written into arrays that are there."""

    def __init__(self, w: dict[str, np.ndarray]):
        by_gate = lambda x: x.reshape(len(x), 3, -1).transpose(1, 0, 2).copy()
        self.inputs, self.u = by_gate(w["W"]), by_gate(w["U"])
        self.back = self.u.transpose(0, 2, 1).copy()
        for x in (self.inputs, self.u):  # a sigmoid takes the exponential of minus its argument
            np.negative(x[:2], out=x[:2])
        self.out = np.concatenate([w["O"], w["bo"][None]])  # for states with a one behind them
        self.ones = np.ones(len(w["bo"]), self.out.dtype)
        #: States lie in -1 to 1: with such weights all logits do in -40 to 40, and the greatest needn't be taken off before exponentials.
        self.small = bool(np.abs(self.out).sum(0).max() < 40)

    def step(self, h, x, gates, rh, c, new) -> None:
        """From states h and the inputs' shares x (by gate) to both gates, the reset state, the candidate and the next state."""
        np.matmul(h, self.u[:2], out=gates)
        gates += x[:2]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(gates[1], h, out=rh)
        np.matmul(rh, self.u[2], out=c)
        c += x[2]
        np.tanh(c, out=c)
        np.subtract(c, h, out=new)
        new *= gates[0]
        new += h

    def logits(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states with a one behind each, and logits of all classes, whose exponentials can be added up."""
        s = np.empty((len(states), len(self.out)), states.dtype)
        s[:, :-1], s[:, -1] = states, 1
        p = s @ self.out
        if not self.small:
            p -= p.max(1, keepdims=True)
        return s, p


def untrained(classes: int, counts: np.ndarray | None = None, seed: int = 3) -> dict[str, np.ndarray]:
    """Random weights; counts: how often each class occurs."""
    rng, n = np.random.default_rng(seed), HIDDEN
    w = {"W": rng.normal(0, 0.1, (classes, 3 * n)), "U": rng.normal(0, 0.2, (n, 3 * n)), "O": rng.normal(0, 0.1, (n, classes)), "bo": np.zeros(classes)}
    if counts is not None:
        w["bo"] = np.log(counts + 0.5) - np.log(counts.sum() + classes / 2)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _line(k: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents' classes behind each other, END before and behind each, and where documents begin."""
    flat, first = np.full(len(k) + 2 * len(lens), END, np.uint8), np.zeros(len(k) + 2 * len(lens), bool)
    flat[np.arange(len(k)) + 2 * np.repeat(np.arange(len(lens)), lens) + 1] = k
    first[np.cumsum(lens + 2) - lens - 2] = True
    return flat, first


class Trainer:
    """Trains weights by back-propagation truncated to windows; every class of a line that isn't a document's beginning is learnt once per call of learn()."""

    def __init__(self, w: dict[str, np.ndarray]):
        #: Weights, slopes and their averages lie in one vector each; w, grad and m are views by name.
        self.flat = np.zeros((4, sum(x.size for x in w.values())), np.float32)
        ends = np.cumsum([x.size for x in w.values()])[:-1]
        self.w, self.grad, self.m = ({k: x.reshape(w[k].shape) for k, x in zip(w, np.split(y, ends), strict=True)} for y in self.flat[:3])
        for k, x in w.items():
            self.w[k][:] = x
        self.updates = 0

    def learn(self, flat: np.ndarray, first: np.ndarray, lanes: int, rate) -> None:
        """rate: learning rate after so many more words."""
        steps = -(-(len(flat) - 1) // lanes)
        pad = lanes * steps - (len(flat) - 1)
        deal = lambda x, fill: np.ascontiguousarray(np.append(x, np.full(pad, fill, x.dtype)).reshape(lanes, steps).T)
        inputs, goals, scored, resets = deal(flat[:-1], END), deal(flat[1:], END), deal(~first[1:], False), deal(first[:-1], True)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, steps, WINDOW):
            z = at + WINDOW
            if scored[at:z].any():
                h = self._update(h, inputs[at:z], goals[at:z], scored[at:z], ~resets[at:z], rate(min(at * lanes, len(flat))))

    def _update(self, h, inputs, goals, scored, goes_on, rate):
        cell, n, (steps, lanes) = Cell(self.w), HIDDEN, inputs.shape
        into, ends, some = np.take(cell.inputs, inputs, axis=1), ~goes_on, ~goes_on.all(1)
        old, rh, c, new = (np.empty((steps, lanes, n), np.float32) for _ in range(4))
        gates = np.empty((2, steps, lanes, n), np.float32)
        for t in range(steps):
            old[t] = h
            if some[t]:
                old[t][ends[t]] = 0
            cell.step(old[t], into[:, t], gates[:, t], rh[t], c[t], new[t])
            h = new[t]
        grad = self.grad
        back = self._classes(cell, new.reshape(-1, n), goals.reshape(-1), scored.reshape(-1) / np.float32(max(1, scored.sum())), grad).reshape(steps, lanes, n)
        z, r = gates
        kept, slope = 1 - z, into  # the inputs' shares aren't needed any more
        dz_by, dr_by, dc_by = (c - old) * z * kept, old * r * (1 - r), z * (1 - c * c)
        d_next, drh, through = np.zeros((lanes, n), np.float32), np.empty((lanes, n), np.float32), np.empty((2, lanes, n), np.float32)
        for t in range(steps - 1, -1, -1):
            d = back[t]
            d += d_next
            np.multiply(d, dc_by[t], out=slope[2, t])
            np.matmul(slope[2, t], cell.back[2], out=drh)
            np.multiply(d, dz_by[t], out=slope[0, t])
            np.multiply(drh, dr_by[t], out=slope[1, t])
            np.matmul(slope[:2, t], cell.back[:2], out=through)
            np.multiply(d, kept[t], out=d_next)
            drh *= r[t]
            d_next += drh
            d_next += through[0]
            d_next += through[1]
            if some[t]:
                d_next[ends[t]] = 0
        flat = slope.reshape(3, -1, n)
        np.concatenate([*(old.reshape(-1, n).T @ flat[:2]), rh.reshape(-1, n).T @ flat[2]], 1, out=grad["U"])
        seen = inputs.reshape(-1)
        order = np.argsort(seen, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(seen[order]) != 0))
        grad["W"][:] = 0
        grad["W"][seen[order[cut]]] = np.add.reduceat(np.take(flat, order, axis=1), cut, axis=1).transpose(1, 0, 2).reshape(len(cut), -1)
        self.updates += 1
        weights, g, m, v = self.flat
        g *= np.float32(min(1.0, 1.0 / (np.linalg.norm(g.astype(np.float64)) + 1e-12)))
        m += np.float32(0.1) * (g - m)
        v += np.float32(0.01) * (g * g - v)
        weights -= np.float32(rate / (1 - 0.9**self.updates)) * m / (np.sqrt(v / np.float32(1 - 0.99**self.updates)) + np.float32(1e-8))
        return h

    @staticmethod
    def _classes(cell: Cell, states, goals, weight, grad) -> np.ndarray:
        """The loss's slope in the states, in blocks that stay in a core's cache; its slopes in O and bo go to grad."""
        out, back, total = np.empty_like(states), np.ascontiguousarray(cell.out[:-1].T), np.zeros_like(cell.out)
        for a in range(0, len(states), BLOCK_ROWS):
            s, k, mask = (x[a : a + BLOCK_ROWS] for x in (states, goals, weight))
            s, p = cell.logits(s)
            np.exp(p, out=p)
            sums = p @ cell.ones
            p[np.arange(len(p)), k] -= sums
            scale = (mask / sums)[:, None]  # of p; states and slopes are narrower
            s *= scale
            total += s.T @ p
            out[a : a + BLOCK_ROWS] = (p @ back) * scale
        grad["O"][:], grad["bo"][:] = total[:-1], total[-1]
        return out


def _lanes(words: float, updates: int) -> int:
    """Lanes with which so many words make about so many updates."""
    return int(np.clip(words // (WINDOW * max(1, updates)), 16, LANES))


def train_network(sequences: list[np.ndarray], classes: int, updates: int = UPDATES, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights of a gated recurrent unit that predicts each class of the sequences (each ending in END) from those before, in so many updates at least."""
    lens = np.array([len(s) - 1 for s in sequences], np.int64)
    k = np.concatenate([s[:-1] for s in sequences]) if sequences else np.zeros(0, np.uint8)
    flat, first = _line(k, lens)
    trainer = Trainer(untrained(classes, np.bincount(flat[~first], minlength=classes), seed))
    while len(k) and trainer.updates < updates:
        begun = trainer.updates
        trainer.learn(flat, first, _lanes(len(flat), 50), lambda _, begun=begun: RATE * max(0.1, 1 - 0.9 * begun / updates))
    return trainer.w


def network(top: np.ndarray, counts: np.ndarray, endings: np.ndarray, words: np.ndarray, tokens: np.ndarray, ends: int) -> tuple[Network, np.ndarray, np.ndarray]:
    """An untrained network, and words and tokens of each of its classes.

    top, counts: frequent words' hashes and how often they occur, the most
    frequent first; endings: their endings; words, tokens: of all words by
    ending; ends: texts.
    """
    order = np.argsort(top, kind="stable")
    top, counts, endings = top[order], counts[order], endings[order]
    words, tokens = words - np.bincount(endings, minlength=1 << 16), tokens - np.bincount(endings, counts, 1 << 16).astype(np.int64)
    frequent = np.argsort(-tokens, kind="stable")[: ENDINGS - 1]
    frequent = frequent[tokens[frequent] > 0]
    ending = np.full(1 << 16, len(top) + 1)  # all other endings
    ending[frequent] = len(top) + 2 + np.arange(len(frequent))
    in_words, in_tokens = (np.bincount(ending, x, 256).astype(np.int64) for x in (words, tokens))
    in_words[1 : len(top) + 1], in_tokens[1 : len(top) + 1] = 1, counts
    classes = len(top) + 2 + len(frequent)
    seen = in_tokens[:classes].astype(float)
    seen[END] = ends
    net = Network(top, 1 + np.arange(len(top)), ending, untrained(classes, seen), int(seen.sum()))
    return net, in_words, in_tokens


def refine(rows: DataFrame, net: Network) -> dict[str, np.ndarray]:
    """The network trained on all rows (text, part: 0 to 15), a partition each, and the results averaged by words, in rounds.

    All documents are learnt from once, and a small input's several times.  A
    partition's text is classed in pieces; weights are added up in blocks on
    executors, so the driver gets one network a round.
    """
    tasks = min(rows.rdd.getNumPartitions(), max(1, -(-net.size // TASK_BYTES)))
    rows, w, before = rows.coalesce(tasks), net.w, 0
    for last in ROUNDS:
        share = (last - before) / 16
        w = _round(rows.filter(F.col("part").between(before, last - 1)).select("text"), net, w, max(1.0, net.tokens * share / tasks), before / 16, share)
        before = last
    return w


def _round(rows: DataFrame, net: Network, w: dict[str, np.ndarray], expected: float, done: float, share: float) -> dict[str, np.ndarray]:
    """One round: every row (text) is learnt from; expected: words of a partition, from which lanes and rates follow."""
    held = shared.broadcast(rows.sparkSession, (net, w))
    names, shapes = zip(*((k, v.shape) for k, v in sorted(w.items())), strict=True)
    cuts, blocks = np.cumsum([int(np.prod(x)) for x in shapes])[:-1], 16
    epochs = max(1, min(8, round(UPDATES * 1536 / max(1, net.tokens))))
    lanes = _lanes(expected * epochs, UPDATES)

    def train(batches):
        net, w = held.value
        trainer, seen = Trainer(w), 0
        for batch in batches:
            _, off = C.raw(batch.column(0))
            for a, z in C.blocks(off, CHUNK_BYTES):
                text = C.words(batch.column(0).slice(a, z - a), lower=True)
                flat, first = _line(classes_of(net, text), text.lens)
                for _ in range(epochs):
                    trainer.learn(flat, first, min(lanes, len(flat)), lambda more, seen=seen: RATE * max(0.1, 1 - 0.9 * (done + share * min(1.0, (seen + more) / expected))))
                seen += len(text.start) + len(text.lens)
        if seen:
            flat = np.concatenate([trainer.w[x].reshape(-1) for x in names]).astype(np.float64) * seen
            body = [x.tobytes() for x in np.array_split(flat, blocks)]
            salt = TaskContext.get().partitionId() % 256
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([salt] * blocks, pa.int32()), pa.array([float(seen)] * blocks), pa.array(body, pa.binary())], ["block", "salt", "words", "body"])

    def add(key, table):
        total = sum(np.frombuffer(x) for x in table.column("body").to_pylist())
        words = sum(table.column("words").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "words": pa.array([words]), "body": pa.array([total.tobytes()], pa.binary())})

    form = "block int, salt int, words double, body binary"
    parts = rows.mapInArrow(train, form).groupBy("block", "salt").applyInArrow(add, form).groupBy("block").applyInArrow(add, form).collect()  # 16 rows
    if not parts:
        return w
    flat = np.concatenate([np.frombuffer(r["body"]) / r["words"] for r in sorted(parts, key=lambda r: r["block"])])
    return {k: x.reshape(s).astype(np.float32) for k, x, s in zip(names, np.split(flat, cuts), shapes, strict=True)}


def class_scores(net: Network, docs: list[np.ndarray], lanes: int = SCORE_LANES) -> np.ndarray:
    """Natural log-likelihood of each document's classes, END included; memory goes with the words there are, not with lanes times the longest document."""
    n, out = HIDDEN, np.zeros(len(docs))
    if not docs:
        return out
    lanes = min(lanes, len(docs))
    heap, queue = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        load, i = heapq.heappop(heap)
        queue[i].append(d)
        heapq.heappush(heap, (load + len(docs[d]) + 1, i))
    queue.sort(key=lambda q: -sum(len(docs[d]) + 1 for d in q))
    size = np.array([sum(len(docs[d]) + 1 for d in q) for q in queue])
    # lanes lie behind each other, so memory goes with the words there are
    line = [d for q in queue for d in q]
    owner = np.repeat(np.array(line, np.int32), [len(docs[d]) + 1 for d in line])
    goal = np.concatenate([x for d in line for x in (docs[d], (END,))]).astype(np.uint8)
    first = np.append(True, owner[1:] != owner[:-1])
    begin = np.cumsum(size) - size

    cell, kind = Cell(net.w), net.w["W"].dtype
    h, before, got, at = np.zeros((lanes, n), kind), np.zeros(lanes, np.uint8), np.empty(len(goal), kind), 0
    while at < size[0]:
        live = int((size > at).sum())
        z = min(at + max(1, min(64, BLOCK_ROWS // live)), int(size[live - 1]))  # no lane ends before z
        place = begin[None, :live] + np.arange(at, z)[:, None]
        goals, reset = goal[place], first[place]
        seen = np.concatenate([before[None, :live], goals[:-1]])
        seen[reset] = END
        before, h = goals[-1], h[:live]
        into, states = np.take(cell.inputs, seen, axis=1), np.empty((z - at, live, n), kind)
        gates, rh, c = np.empty((2, live, n), kind), np.empty((live, n), kind), np.empty((live, n), kind)
        for t in range(z - at):
            if reset[t].any():
                h = np.where(reset[t][:, None], kind.type(0), h)
            cell.step(h, into[:, t], gates, rh, c, states[t])
            h = states[t]
        logit = cell.logits(states.reshape(-1, n))[1]
        value = logit[np.arange(goals.size), goals.reshape(-1)]
        got[place.reshape(-1)] = value - np.log(np.exp(logit, out=logit) @ cell.ones)
        at = z
    return np.bincount(owner, got, len(docs))


def _ending_stats(bits: DataFrame) -> DataFrame:
    """Sums of the owners' tables of words and tokens by ending."""

    def add(batches):
        got = np.zeros((2, 1 << 16), np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                k, words, tokens = np.frombuffer(x, "<i8").reshape(3, -1)
                got[0, k] += words
                got[1, k] += tokens
        at = np.flatnonzero(got[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(got[0, at]), pa.array(got[1, at])], ["k", "words", "tokens"])

    return bits.mapInArrow(add, "k int, words long, tokens long").groupBy("k").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))


def score(docs: DataFrame, is_train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, is_train, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (lower-cased A-Z only) and one end; null and empty texts
    have the end alone.  train_tokens: all tokens of rows with is_train;
    n_known: tokens that occur among those.  base_score: log10 probability of
    all tokens under smoothed frequencies; score: under the network.  A null
    is_train counts as false.  With no training rows all words are unknown and
    the network is untrained.  All training rows are counted, fix the classes
    and train the network.  Only id, text and the columns of is_train are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(is_train, F.lit(False)).alias("is_train"))
    size, trained = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("is_train")).first()
    part = F.pmod(F.xxhash64("id", "text", F.lit(29)), F.lit(16))
    learnt = rows.filter("is_train").select(F.coalesce("text", F.lit("")).alias("text"), part.alias("part"))
    rows, buckets = X.dealt(rows, size, "id", "text")
    n = X.owners(buckets)

    def send(key, table):
        w = C.words(table.column("text"), lower=True)
        h, place, first = _distinct(w)
        train = np.repeat(table.column("is_train").to_numpy(), w.lens)
        count = np.bincount(place, train, len(h)).astype("<u4")
        kind = _endings(w)[first].astype("<u2")
        if not n:
            body = [x.tobytes() + c.tobytes() + k.tobytes() for x, c, k in zip(h, count, kind, strict=True)]
            return pa.table({"owner": pa.array([-1] * len(h), pa.int32()), "b": pa.array(np.full(len(h), key[0].as_py()), pa.int32()), "payload": pa.array(body, pa.binary())})
        cuts = X.owner_cuts(h, n)
        owners = np.flatnonzero(np.diff(cuts))
        body = [h[cuts[o] : cuts[o + 1]].tobytes() + count[cuts[o] : cuts[o + 1]].tobytes() + kind[cuts[o] : cuts[o + 1]].tobytes() for o in owners]
        return pa.table({"owner": pa.array(owners, pa.int32()), "b": pa.array(np.full(len(owners), key[0].as_py()), pa.int32()), "payload": pa.array(body, pa.binary())})

    def total(table):
        """Answers, and in rows with b -1 the words and tokens of every ending (level 0) and the most frequent words (level 1)."""
        parts = [(np.frombuffer(p, _U, k), np.frombuffer(p, "<u4", k, 8 * k), np.frombuffer(p, "<u2", k, 12 * k)) for p in table.column("payload").to_pylist() for k in [len(p) // 14]]
        h, count, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
        known, first, place = np.unique(h, return_index=True, return_inverse=True)
        sums = np.bincount(place, count)
        back = np.split(np.minimum(sums, 2**32 - 1).astype("<u4")[place], np.cumsum([len(p[0]) for p in parts])[:-1])
        k = kind[first].astype(np.int64)
        words, tokens = np.bincount(k, sums > 0, 1 << 16), np.bincount(k, sums, 1 << 16)
        at = np.flatnonzero(words)
        most = np.argsort(-sums, kind="stable")[:TOP_WORDS]
        most = most[sums[most] > 1]
        stats = [np.stack([at, words[at], tokens[at]]).astype("<i8"), np.stack([known[most].view("<i8"), sums[most].astype("<i8"), k[most]])]
        owner = table.column("owner").to_pylist()
        return pa.table({"b": pa.array([*table.column("b").to_pylist(), -1, -1], pa.int32()), "owner": pa.array([*owner, owner[0], owner[0]], pa.int32()), "level": pa.array([0] * (len(owner) + 1) + [1], pa.int32()), "bits": pa.array([*(x.tobytes() for x in back), *(x.tobytes() for x in stats)], pa.binary())})

    def pack(key, table):
        """The answer to a bucket whose words travelled as rows: hashes and totals."""
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), _U)
        body = h.tobytes() + np.minimum(table.column("n").to_numpy(), 2**32 - 1).astype("<u4").tobytes()
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "owner": pa.array([-1], pa.int32()), "level": pa.array([0], pa.int32()), "bits": pa.array([body], pa.binary())})

    sent = rows.groupBy("b").applyInArrow(send, X.MESSAGE)
    if n:
        answers = shared.table(sent.groupBy("owner").applyInArrow(total, X.ANSWER))
        stats = _ending_stats(answers.filter("b = -1 AND level = 0").select("bits"))
        found = [np.frombuffer(r["bits"], "<i8").reshape(3, -1) for r in answers.filter("b = -1 AND level = 1").select("bits").toLocalIterator()]  # TOP_WORDS of each owner
        top, counts, kinds = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        top = top.view(_U)
    else:  # Spark groups the words of all buckets
        turned = lambda name, at, size: F.hex(F.concat(*[F.substring(name, at + i, 1) for i in reversed(range(size))]))  # noqa: E731  reverse() would keep bytes of one character together
        number = lambda at, size: F.conv(turned("payload", at, size), 16, 10).cast("long")
        words = shared.table(sent.select("b", F.substring("payload", 1, 8).alias("h"), number(9, 4).alias("n"), number(13, 2).alias("k")))
        totals = shared.table(words.groupBy("h").agg(F.sum("n").alias("n"), F.min("k").alias("k")).filter("n > 0"))
        answers = words.select("b", "h").join(totals.select("h", "n"), "h").groupBy("b").applyInArrow(pack, X.ANSWER)
        stats = totals.groupBy("k").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"))
        found = totals.filter("n > 1").orderBy(F.desc("n"), turned("h", 1, 8)).limit(TOP_WORDS).collect()
        top, counts, kinds = np.frombuffer(b"".join(r["h"] for r in found), _U), np.array([r["n"] for r in found], np.int64), np.array([r["k"] for r in found], np.int64)

    by_ending = np.zeros((2, 1 << 16), np.int64)
    for r in stats.toLocalIterator():  # 65,536 rows at most
        by_ending[:, r["k"]] = r["words"], r["tokens"]
    most = np.lexsort((top, -counts))[:TOP_WORDS]
    net, in_words, in_tokens = network(top[most], counts[most], kinds[most], *by_ending, trained)
    net.size = size
    net.w = refine(learnt, net)
    held = shared.broadcast(spark, net)  # of fixed size: some 10,000 weights and 65,536 endings
    all_tokens = int(in_tokens.sum()) + trained
    all_words = int(in_words.sum()) + (1 if trained else 0)

    def rate(table, right):
        net = held.value
        w = C.words(table.column("text"), lower=True)
        h, place, first = _distinct(w)
        count = X.read_answer(right, 0, h, None, n, counts=True)[place]
        kind = classes_of(net, C.Words(w.data, w.doc_off, w.start[first], w.end[first], w.off, h)).astype(np.uint8)[place]
        top = all_tokens + 0.5 * (all_words + 1)
        per = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[w.off])
        within = np.log10((count + 0.5) / (in_tokens[kind] + 0.5 * (in_words[kind] + 1)))
        model = class_scores(net, [kind[a:z] for a, z in zip(w.off[:-1], w.off[1:], strict=True)]) / np.log(10)
        return pa.table({
            "id": table.column("id"), "is_train": table.column("is_train"), "n_tokens": pa.array(w.lens + 1, pa.int64()),
            "n_known": pa.array(per(count > 0).astype(np.int64) + (trained > 0)), "train_tokens": pa.array(np.full(len(w.lens), all_tokens), pa.int64()),
            "base_score": pa.array(per(np.log10((count + 0.5) / top)) + np.log10((trained + 0.5) / top)), "score": pa.array(per(within) + model),
        })

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("is_train", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")])
    return rows.groupBy("b").cogroup(answers.filter("b >= 0").groupBy("b")).applyInArrow(rate, schema).withColumnRenamed("id", id_col)
