"""Document log-likelihood under a gated recurrent language model.

Words are lower-cased (ASCII) runs between white space; each document ends with an end
token.  Word counts over all training documents give a smoothed unigram score and
the model's vocabulary: the most frequent words, an end symbol, and one symbol for all
rarer words, which spell themselves by their smoothed share of the rare mass.  A GRU in
numpy reads a document from its start to its end, carrying its state over the
windows; the output is factored into the class of the next word and the word in its
class.

Training is data-parallel: every training document belongs to one round (by a hash of its
whole text), in which its partition runs truncated backpropagation over all its tokens,
starting from the round's common parameters; the results are averaged in the executors
by groups (a tree), weighted by tokens.  What it gathers and learns from grows with the
corpus; the model's own size is fixed.  Training, counts and scores cover every token.

Words beyond a fixed head of the vocabulary are joined with their counts by a shuffle,
so no table that grows with the corpus is ever broadcast.

Defined results: null or empty text is its end token alone; a null doc_id trains (it
has no remainder); without training documents all counts are zero; repeated rows are
scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.llm.common import Scratch, small_batches

END = b"\n"  # no word can hold it
CLASSES, PER_CLASS, EMBED, HIDDEN = 64, 64, 16, 24
STOP, RARE = 0, (CLASSES - 1) * PER_CLASS  # the model's symbols for the end and for rare words, a class of their own
WORDS = RARE - 1  # symbols for words, from 1
#: Words with their counts held by every task: a fixed number.
HEAD = 100_000
WINDOW, LANES, TRAIN_LANES = 32, 384, 384
#: Tokens that are packed into lanes together.
PACK = 1_200_000
ROUNDS = 3
SMOOTH = 0.1


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all tokens, the end token included."""

    def run(batches):
        seen: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(words(text))
                seen[END] += 1
            if len(seen) > 400_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


SHAPES = {
    "embed": (CLASSES * PER_CLASS, EMBED), "in": (EMBED, 3 * HIDDEN), "state": (HIDDEN, 3 * HIDDEN), "bias": (3 * HIDDEN,),
    "class": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "word": (CLASSES, HIDDEN, PER_CLASS), "word_bias": (CLASSES, PER_CLASS),
}
ONES = {n: np.ones(n, np.float32) for n in (CLASSES, PER_CLASS)}


def _small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit can overflow an exponential, for states within (-1, 1)."""
    return bool(np.abs(weights).sum(-2).max() + np.abs(bias).max() < 80)


def _exp(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of these."""
    logits = states @ weights
    logits += bias
    if not small:
        logits -= logits.max(1, keepdims=True)
    e = np.exp(logits)
    return logits, e, e @ ONES[e.shape[1]]


class Model:
    """GRU with a class-factored softmax over CLASSES * PER_CLASS symbols."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.p = flat, self.named(flat)

    @staticmethod
    def named(flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of a vector of all parameters."""
        at, parts = 0, {}
        for name, shape in SHAPES.items():
            size = math.prod(shape)
            parts[name] = flat[at : at + size].reshape(shape)
            at += size
        return parts

    @classmethod
    def fresh(cls, stop: float, rare: float, words: list[float], seed: int = 11) -> Model:
        """Frequencies of the end, of rare words together and of the vocabulary; their logarithms are the first biases."""
        rng = np.random.default_rng(seed)
        share = np.full(CLASSES * PER_CLASS, 1e-9)
        share[[STOP, RARE]] = max(stop, 1e-9), max(rare, 1e-9)
        share[1 : 1 + len(words)] = np.maximum(words, 1e-9)
        share = (share / share.sum()).reshape(CLASSES, PER_CLASS)
        model = cls(np.zeros(sum(map(math.prod, SHAPES.values())), np.float32))
        for name, scale in (("embed", 8), ("in", 1), ("state", 1), ("class", 0.2), ("word", 0.2)):
            shape = SHAPES[name]
            model.p[name][:] = rng.standard_normal(shape) * (0.5 * scale / math.sqrt(shape[-2]))
        model.p["class_bias"][:] = np.log(share.sum(1))
        model.p["word_bias"][:] = np.log(share / share.sum(1, keepdims=True))
        return model

    def walk(self, tokens: np.ndarray, fresh: np.ndarray, h: np.ndarray, table: np.ndarray, keep: bool = False):
        """States that predict tokens [steps, lanes]; fresh marks a document's first token, where the state starts anew.

        Each step reads the token before (the end symbol at a start).  Returns the states and what backpropagation needs.
        """
        n, before = HIDDEN, tokens.copy()
        before[1:] = tokens[:-1]
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * n, n])  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        u, table = self.p["state"] * half, (table + self.p["bias"]) * half
        out, memory = np.empty((*tokens.shape, n), np.float32), []
        before[0] = self.last
        before[fresh] = STOP
        for t in range(len(tokens)):
            if fresh[t].any():
                h = np.where(fresh[t][:, None], 0, h)
            x, y = table[before[t]], h @ u
            g = x[:, : 2 * n] + y[:, : 2 * n]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            z, r = g[:, :n], g[:, n:]
            a = np.tanh(x[:, 2 * n :] + r * y[:, 2 * n :])
            if keep:
                memory.append((h, z, r, a, y[:, 2 * n :]))
            h = a + z * (h - a)
            out[t] = h
        self.last = tokens[-1]
        return out, h, (before, memory)

    def outputs(self, states: np.ndarray, tokens: np.ndarray, grads: dict | None = None):
        """Natural log probability of each token given its state; with grads also fills them and returns the states' gradient."""
        kind, inside = tokens // PER_CLASS, tokens % PER_CLASS
        small = _small(self.p["class"], self.p["class_bias"]) and _small(self.p["word"], self.p["word_bias"])
        logits, e, total = _exp(states, self.p["class"], self.p["class_bias"], small)
        row = np.arange(len(tokens))
        out = logits[row, kind] - np.log(total)
        back = None
        if grads is not None:
            d = e / total[:, None]
            d[row, kind] -= 1
            grads["class"] += states.T @ d
            grads["class_bias"] += d.sum(0)
            back = d @ self.p["class"].T
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for k in range(CLASSES - 1):  # the last class has one symbol
            own = order[edges[k] : edges[k + 1]]
            if not len(own):
                continue
            s, w = states[own], inside[own]
            logits, e, total = _exp(s, self.p["word"][k], self.p["word_bias"][k], small)
            at = np.arange(len(own))
            out[own] += logits[at, w] - np.log(total)
            if grads is not None:
                d = e / total[:, None]
                d[at, w] -= 1
                grads["word"][k] += s.T @ d
                grads["word_bias"][k] += d.sum(0)
                back[own] += d @ self.p["word"][k].T
        return out, back

    def score(self, docs: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
        """Log10 probability of each whole document (symbols, the end symbol last)."""
        out = np.zeros(len(docs))
        table = self.p["embed"] @ self.p["in"]
        for tokens, fresh, owner, filled in packed(docs, lanes):
            h = np.zeros((tokens.shape[1], HIDDEN), np.float32)
            self.last = np.full(tokens.shape[1], STOP)
            for at in range(0, len(tokens), WINDOW):
                # lanes stand longest first: those that have ended are left behind
                live = int((filled > at).sum())
                part, h, self.last = tokens[at : at + WINDOW, :live], h[:live], self.last[:live]
                real = (part >= 0).ravel()
                states, h, _ = self.walk(np.maximum(part, 0), fresh[at : at + WINDOW, :live], h, table)
                logp, _ = self.outputs(states.reshape(-1, HIDDEN)[real], part.ravel()[real])
                out += np.bincount(owner[at : at + WINDOW, :live].ravel()[real], logp, len(docs))
        return out / math.log(10)

    def train(self, docs: list[np.ndarray], optimizer: dict, rate: float) -> int:
        """Truncated backpropagation: the state, but no gradient, passes from window to window."""
        learned = 0
        for tokens, fresh, _, filled in packed(docs, TRAIN_LANES):
            h = np.zeros((tokens.shape[1], HIDDEN), np.float32)
            self.last = np.full(tokens.shape[1], STOP)
            for at in range(0, len(tokens), WINDOW):
                live = int((filled > at).sum())
                part, start, h, self.last = tokens[at : at + WINDOW, :live], fresh[at : at + WINDOW, :live], h[:live], self.last[:live]
                real = (part >= 0).ravel()
                n = int(real.sum())
                if not n:
                    continue
                table = self.p["embed"] @ self.p["in"]
                states, h, (before, memory) = self.walk(np.maximum(part, 0), start, h, table, True)
                gradient = np.zeros_like(self.flat)
                g = self.named(gradient)
                _, d = self.outputs(states.reshape(-1, HIDDEN)[real], part.ravel()[real], g)
                ds = np.zeros((part.size, HIDDEN), np.float32)
                ds[real] = d
                self._back(ds.reshape(*part.shape, HIDDEN), start, before, memory, g)
                self._step(gradient, n, optimizer, rate)
                learned += n
        return learned

    def _back(self, ds, fresh, before, memory, g):
        n, u = HIDDEN, self.p["state"]
        dh, dx = np.zeros_like(ds[0]), np.empty((*ds.shape[:2], 3 * n), np.float32)
        for t in range(len(ds) - 1, -1, -1):
            h, z, r, a, y = memory[t]
            dh = dh + ds[t]
            da = dh * (1 - z) * (1 - a * a)
            dz = dh * (h - a) * z * (1 - z)
            dr = da * y * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, da], axis=1)
            dy = np.concatenate([dz, dr, da * r], axis=1)
            g["state"] += h.T @ dy
            dh = np.where(fresh[t][:, None], 0, dh * z + dy @ u.T)
        flat, symbols = dx.reshape(-1, 3 * n), before.ravel()
        g["bias"] += flat.sum(0)
        g["in"] += self.p["embed"][symbols].T @ flat
        np.add.at(g["embed"], symbols, flat @ self.p["in"].T)

    def _step(self, g: np.ndarray, n: int, optimizer: dict, rate: float):
        """Adam, with gradients per token."""
        optimizer["t"] = t = optimizer.get("t", 0) + 1
        if t == 1:
            optimizer["m"], optimizer["s"] = np.zeros_like(g), np.zeros_like(g)
        m, s = optimizer["m"], optimizer["s"]
        g /= n
        np.clip(g, -0.1, 0.1, out=g)
        m *= 0.9
        m += 0.1 * g
        g *= g
        g *= 0.01
        s *= 0.99
        s += g
        np.divide(s, 1 - 0.99**t, out=g)
        np.sqrt(g, out=g)
        g += 1e-6
        np.divide(m, g, out=g)
        g *= rate / (1 - 0.9**t)
        self.flat -= g


def packed(docs: list[np.ndarray], lanes: int):
    """(tokens, fresh, owner, filled) of documents laid end to end in lanes of about equal length, longest lane first; -1 fills the ends."""
    if not docs:
        return
    lanes = min(lanes, len(docs))
    filled, rows = [0] * lanes, [[] for _ in range(lanes)]
    heap = [(0, i) for i in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, i = heapq.heappop(heap)
        rows[i].append(d)
        filled[i] = size + len(docs[d])
        heapq.heappush(heap, (filled[i], i))
    order = sorted(range(lanes), key=lambda i: -filled[i])
    rows, filled = [rows[i] for i in order], np.array([filled[i] for i in order])
    tokens, owner = np.full((max(filled), lanes), -1, np.int32), np.zeros((max(filled), lanes), np.int32)
    fresh = np.zeros(tokens.shape, bool)
    for i, own in enumerate(rows):
        at = 0
        for d in own:
            n = len(docs[d])
            tokens[at : at + n, i], owner[at : at + n, i], fresh[at, i] = docs[d], d, True
            at += n
    yield tokens, fresh, owner, filled


def _symbols(w: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    out = np.empty(len(w) + 1, np.int32)
    out[:-1] = np.fromiter(map(vocabulary.get, w, repeat(RARE)), np.int32, len(w))
    out[-1] = STOP
    return out


def lessons(texts: list[bytes | None], vocabulary: dict[bytes, int], turn: int, rounds: int) -> list[np.ndarray]:
    """The whole symbols of those texts that a round trains on; each text is in one round."""
    return [_symbols(words(t), vocabulary) for t in texts if crc32(t or b"") % rounds == turn]


def packs(docs: Iterable[np.ndarray], size: int = PACK) -> Iterator[list[np.ndarray]]:
    """Documents in order, put together until they hold `size` tokens."""
    held, total = [], 0
    for d in docs:
        held.append(d)
        total += len(d)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def fit(docs: DataFrame, vocabulary: dict[bytes, int], model: Model, *, text_col="text", rounds: int = ROUNDS) -> Model:
    """Rounds of local training and averaging, each over its share of the documents; together they read every token once."""
    texts = docs.select(F.col(text_col).cast("string"))
    schema = "part int, weight double, params binary"
    for turn in range(rounds):
        rate = 0.01 / (1 + turn)

        def learn(batches, model=model, turn=turn, rate=rate):
            own, optimizer, learned = Model(model.flat.copy()), {}, 0
            for pack in packs(x for batch in batches for x in lessons(batch.column(0).cast(pa.binary()).to_pylist(), vocabulary, turn, rounds)):
                learned += own.train(pack, optimizer, rate)
            if learned:
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "weight": [float(learned)], "params": [own.flat.tobytes()]}, schema=pa.schema([("part", pa.int32()), ("weight", pa.float64()), ("params", pa.binary())]))

        def average(rows):
            w = np.array(rows["weight"])
            flat = sum(np.frombuffer(p, "<f4").astype(np.float64) * x for p, x in zip(rows["params"], w)) / w.sum()
            return rows.iloc[:1].assign(weight=w.sum(), params=[flat.astype("<f4").tobytes()])

        got, width = texts.mapInArrow(learn, schema), texts.rdd.getNumPartitions()
        while width > 16:  # a tree: at most 16 models meet in one group, and 16 reach the driver
            got = got.withColumn("part", (F.col("part") / 16).cast("int")).groupBy("part").applyInPandas(average, schema)
            width = math.ceil(width / 16)
        rows = got.toPandas()
        if len(rows):
            model = Model(np.frombuffer(average(rows)["params"].iloc[0], "<f4").copy())
    return model


def frequent(seen: DataFrame, kinds: int) -> dict[bytes, int]:
    """At most HEAD of the most frequent words, most frequent first.

    A histogram of the counts (eighths of octaves) gives the count they begin at, so
    tasks send only words that are in.
    """
    if kinds > HEAD:
        step = F.floor(F.log2("c") * 8)
        bars = sorted(((r.b, r.n) for r in seen.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
        room, least = HEAD, None
        for b, n in bars:
            room -= n
            if room < 0:
                break
            least = b
        # words of one count alone may outnumber the head: then the model's own few are ordered out of them
        seen = seen.filter(step >= least) if least is not None else seen.orderBy(F.desc("c"), "word").limit(CLASSES * PER_CLASS)
    return dict(sorted(((bytes(r.word), r.c) for r in seen.collect()), key=lambda x: (-x[1], x[0])))


def score(docs: DataFrame, *, id_col="doc_id", text_col="text", rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows whose id is held out do not train."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "lm")
    training = docs.filter(~held_out(id_col))
    seen = scratch.keep(counts(training, text_col), "counts")
    total, kinds = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = frequent(seen, kinds)
    ends = head.get(END) or next((r.c for r in seen.filter(F.col("word") == F.lit(END)).collect()), 0)
    top = [w for w in head if w != END][:WORDS]
    vocabulary = {w: i + 1 for i, w in enumerate(top)}
    rare_tokens, rare_kinds = total - ends - sum(head[w] for w in top), kinds - len(top) - (ends > 0)
    model = Model.fresh(ends + 0.5, rare_tokens + 0.5, [head[w] for w in top])
    model = fit(training, vocabulary, model, text_col=text_col, rounds=rounds)
    logs = {w: math.log10(c + SMOOTH) for w, c in head.items()}
    held = spark.sparkContext.broadcast((logs, vocabulary, model))
    end_log = math.log10(ends + SMOOTH)
    kind = docs.schema[id_col].dataType
    fields = [(id_col, kind), ("n_tokens", T.LongType()), ("head_known", T.LongType()), ("head_log", T.DoubleType()), ("rare_log", T.DoubleType()), ("n_rare", T.LongType()), ("model", T.DoubleType()), ("tail", T.MapType(T.BinaryType(), T.LongType()))]

    def run(batches):
        logs, vocabulary, model = held.value
        for batch in batches:
            texts = [words(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            parts = [_symbols(w, vocabulary) for w in texts]
            likely = model.score(parts)
            rows = {f: [] for f, _ in fields[1:]}
            for w, s, m in zip(texts, parts, likely):
                known, head_log, rare_log, tail = int(ends > 0), end_log, 0.0, []
                for x, n in Counter(w).items():
                    log = logs.get(x)
                    if log is None:
                        tail.append((x, n))
                        continue
                    known += n
                    head_log += n * log
                    if x not in vocabulary:
                        rare_log += n * log
                values = (len(w) + 1, known, head_log, rare_log, int((s == RARE).sum()), float(m), tail)
                for f, v in zip(rows, values):
                    rows[f].append(v)
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.map_(pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(rows.values(), types)]], [f for f, _ in fields])

    parts = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))
    parts = scratch.keep(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    tail = parts.select("row", F.explode("tail").alias("word", "tf")).join(seen.hint("merge"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = tail.groupBy("row").agg(F.sum(F.col("tf") * F.log10(c + SMOOTH)).alias("tail_log"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
    both = parts.drop("tail").join(rare.hint("shuffle_hash"), "row", "left").withColumn("tail_log", F.coalesce("tail_log", F.lit(0.0)))
    base = math.log10(total + SMOOTH * (kinds + 1))
    rare_base = math.log10(rare_tokens + SMOOTH * (rare_kinds + 1))
    return both.select(
        id_col,
        held_out(id_col).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("tail_log") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + F.col("rare_log") + F.col("tail_log") - F.col("n_rare") * rare_base).alias("score"),
    )
