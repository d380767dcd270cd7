"""Language-model scoring with a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Tokens: ASCII-lower-cased words and one end per text. Symbols: the end, every word that the training texts hold at least
sqrt(N) / 4 times (N: their tokens, so the vocabulary grows with the corpus), and `classes` classes of all other words by their
last two bytes; a word's probability is its symbol's, times its add-one share in its class (one share is for a word not
seen), so the probabilities of all words sum to 1. Context: the last `context` symbols, each with a matrix of its own.

  h = sum over i of C_i r(u_i);   P(v) = softmax over bands (h . q_band + b) * softmax in v's band (h . q_v + b_v)

Symbols are dealt by frequency in about sqrt(M) bands of sqrt(M) symbols, so a normalised log-probability takes two short
batched matrix products instead of one over the whole vocabulary.

Training goes over all tokens of all training texts once, in `rounds` parts (by a hash of the text): a task takes the model of
the round before, runs minibatches with sampled noise (unigram bands, then unigram symbols of the band) under Adagrad over
its texts, and gives the rows it has touched, weighted by how often; the rows' weighted means are formed in a shuffle, and the
driver gets one row per symbol.

Counts: those of every word over all texts, in training and in all (pre-aggregated, then shuffled), stay in a table. The at
most `head` words of the highest count in all are broadcast with their counts; other words, which are rare everywhere, so that no
key is hot, meet their counts in a join.

Cases: null or empty text is the end alone; a null id counts as the empty text in the fold rule; repeated rows are
scored each; without training texts all counts are 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixar.llm import common, wordtok

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    """The words as UTF-8, then the end (empty)."""
    return [*text.encode().translate(_LOWER).split(), b""] if text else [b""]


def tokenize(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The same for a batch: number of each token's word in the distinct words, these (the end is the last), and tokens a text."""
    if not len(texts):
        return np.empty(0, np.int64), pa.array([""]), np.empty(0, np.int64)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    distinct = parts.flatten().dictionary_encode()
    words, at = distinct.dictionary, distinct.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # at white space in front or behind
        doc, at = doc[at != empty], at[at != empty]
    n = np.bincount(doc, minlength=len(texts))
    return np.insert(at, np.cumsum(n), len(words)).astype(np.int64), pa.concat_arrays([words, pa.array([""])]), n + 1


def strings(words: pa.Array) -> list[str]:
    """The words of tokenize(), which hold no space, as a list."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py().split(" ")


class Vocabulary:
    """Head words with their training counts, and a symbol for every word. Bounded by `head` and `classes`."""

    def __init__(self, head: list[tuple[str, int]], top: int, classes: int, ends: int):
        """head: by falling training count; the first `top` are symbols. The end is symbol 0."""
        self.top, self.classes = top, classes
        self.index = {"": 0} | {w: i + 1 for i, (w, _) in enumerate(head)}
        self.count = np.asarray([ends, *(c for _, c in head)], np.int64)
        self.symbol = np.asarray([0, *(i + 1 if i < top else self.class_of(w) for i, (w, _) in enumerate(head))], np.int64)
        self.size = 1 + top + classes

    def class_of(self, word: str) -> int:
        return 1 + self.top + zlib.crc32(word.encode()[-2:]) % self.classes

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Head index (-1: not in the head) and symbol of each word."""
        get = self.index.get
        at = np.asarray([get(w, -1) for w in words], np.int64)
        symbol = self.symbol[at]
        rest = np.flatnonzero(at < 0)
        symbol[rest] = [self.class_of(words[i]) for i in rest.tolist()]
        return at, symbol


def contexts(symbol: np.ndarray, n: np.ndarray, context: int) -> np.ndarray:
    """The `context` symbols before each token, the last one first; the end stands for those before a text."""
    out = np.zeros((len(symbol), context), np.int64)
    within = np.arange(len(symbol)) - np.repeat(np.cumsum(n) - n, n)
    for i in range(context):
        out[i + 1 :, i] = symbol[: -i - 1]
        out[within <= i, i] = 0
    return out


def _order(at: np.ndarray, m: int) -> np.ndarray:
    """The stable order of numbers below m; sorting 16-bit numbers is a fast radix sort."""
    return np.argsort(at.astype(np.uint16) if m <= 1 << 16 else at, kind="stable")


def _add_runs(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to out at its number; the numbers ascend."""
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[first]] += np.add.reduceat(rows, first, axis=0)


def _with_one(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Model:
    """Parameters by kind, a row each: 0 context vectors, 1 symbols (vector and bias), 2 bands (same), 3 rows of the matrices C."""

    def __init__(self, unigram: np.ndarray, context: int = 2, dims: int = 32, noise: int = 16, seed: int = 3):
        m = len(unigram)
        self.context, self.dims, self.noise, self.band = context, dims, noise, int(np.ceil(np.sqrt(m)))
        rng, own = np.random.default_rng(seed), (unigram + 1.0) / (unigram.sum() + m)
        bands = np.add.reduceat(own, np.arange(0, m, self.band))
        self.q_band, self.q = bands.astype(np.float32), (own / bands[np.arange(m) // self.band]).astype(np.float32)
        start = lambda k, bias: np.concatenate([rng.normal(0, 0.05, (k, dims)), bias[:, None]], 1).astype(np.float32)
        self.rows = [rng.normal(0, 0.1, (m, dims)).astype(np.float32), start(m, np.log(self.q)), start(len(bands), np.log(bands)), np.concatenate([np.eye(dims) / (i + 1) for i in range(context)]).astype(np.float32)]

    def hidden(self, before: np.ndarray) -> np.ndarray:
        d = self.dims
        return sum((self.rows[0] @ self.rows[3][i * d : i * d + d])[before[:, i]] for i in range(self.context))

    def log_probs(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural logs of the normalised probabilities."""
        out = np.empty(len(symbol))
        for a in range(0, len(symbol), 1 << 14):
            order = _order(symbol[a : a + (1 << 14)], len(self.q))
            v = symbol[a : a + (1 << 14)][order]
            h = _with_one(self.hidden(before[a : a + (1 << 14)][order]))
            band = v // self.band
            got = _log_share(h @ self.rows[2].T, band)
            cut = np.searchsorted(band, np.arange(len(self.q_band) + 1)).tolist()
            for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if j > i:
                    got[i:j] += _log_share(h[i:j] @ self.rows[1][b * self.band : (b + 1) * self.band].T, v[i:j] - b * self.band)
            out[a + order] = got
        return out

    def start_training(self, seed: int, rate: float = 0.1) -> None:
        self.rng, self.rate = np.random.default_rng(seed), np.float32(rate)
        self.squares = [np.full_like(x, 1e-6) for x in self.rows]
        self.weight = [np.zeros(len(x)) for x in self.rows]

    def train(self, before: np.ndarray, v: np.ndarray) -> None:
        """One minibatch, in the order of the symbols, so that those of one symbol or band are a slice."""
        d, k, size, m = self.dims, self.noise, self.band, len(self.q)
        order = _order(v, m)
        v, before = v[order], before[order]
        h, band = _with_one(self.hidden(before)), v // size
        grads, dh = [np.zeros_like(x) for x in self.rows], np.zeros_like(h)

        def seen(kind: int, at: np.ndarray, q: np.ndarray) -> None:
            x = self.rows[kind][at]
            g = 1 - _sigmoid(np.einsum("ij,ij->i", h, x) - np.log(k * q[at]))
            _add_runs(grads[kind], at, g[:, None] * h)
            x *= g[:, None]
            np.add(dh, x, out=dh)
            self.weight[kind] += np.bincount(at, minlength=len(q))

        def unseen(kind: int, own: slice, first: int, q: np.ndarray) -> None:
            at = first + np.minimum(np.searchsorted(np.cumsum(q), self.rng.random(k)), len(q) - 1)
            x, mine = self.rows[kind][at], h[own]
            g = _sigmoid(mine @ x.T - np.log(k * q[at - first]))
            np.subtract.at(grads[kind], at, g.T @ mine)
            dh[own] -= g @ x
            np.add.at(self.weight[kind], at, len(mine) / k)

        seen(2, band, self.q_band)
        unseen(2, slice(None), 0, self.q_band)
        seen(1, v, self.q)
        cut = np.searchsorted(band, np.arange(len(self.q_band) + 1)).tolist()
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if j > i:
                unseen(1, slice(i, j), b * size, self.q[b * size : (b + 1) * size])
        dh = np.ascontiguousarray(dh[:, :d])
        for i in range(self.context):
            c, u = slice(i * d, i * d + d), before[:, i]
            order = _order(u, m)
            sums, weight = np.zeros((m, d), np.float32), np.bincount(u, minlength=m)
            _add_runs(sums, u[order], dh[order])
            grads[0] += sums @ self.rows[3][c].T  # C_i is the same for all, so it is applied to the sums
            grads[3][c] = self.rows[0].T @ sums
            self.weight[0] += weight
            self.weight[3][c] += len(v)
        for x, g, s in zip(self.rows, grads, self.squares, strict=True):
            s += g * g
            g *= self.rate
            g /= np.sqrt(s)
            x += g


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x at each row's number, less the log of the row's sum of exp. Changes x."""
    x -= x.max(1, keepdims=True)
    own = x[np.arange(len(x)), at]
    return own - np.log(np.exp(x, out=x).sum(1))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def word_counts(docs: DataFrame, train: Column, text_col: str, classes: int) -> DataFrame:
    """(word, class, c in training texts, a in all) over all texts; the end is the empty word."""

    def run(batches):
        for batch in batches:
            for part in wordtok.slices(batch, 0, 8 << 20, 65536):
                at, words, n = tokenize(part.column(0))
                learnt = np.repeat(np.asarray(part.column(1).fill_null(False).to_numpy(zero_copy_only=False), np.int64), n)
                cls = [zlib.crc32(w.encode()[-2:]) % classes for w in strings(words)]
                yield pa.RecordBatch.from_arrays([words, pa.array(cls, pa.int64()), pa.array(np.bincount(at, learnt, len(words)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(words)))], ["word", "class", "c", "a"])

    partial = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), train.alias("learn")).mapInArrow(run, "word string, class long, c long, a long")
    return common.materialize(partial.groupBy("word", "class").agg(F.sum("c").alias("c"), F.sum("a").alias("a")), "counts")


def head_words(counts: DataFrame, head: int) -> list[tuple[str, int]]:
    """(word, c) of at most `head` words: all with a count in all texts over a threshold, which a histogram of logs gives."""
    bucket = F.floor(F.log2("a") * 8).cast("int")
    least, total = None, 0
    for b, n in sorted(counts.filter("word <> ''").groupBy(bucket.alias("b")).agg(F.count(F.lit(1))).collect(), reverse=True):  # some hundred rows
        total += n
        if total > head:
            break
        least = b
    if least is None:
        return []
    got = counts.filter((F.col("word") != "") & (bucket >= least)).select("word", "c").toArrow()
    return sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))


def train_round(learn: DataFrame, text_col: str, vocabulary, model: Model, seed: int, batch_tokens: int = 1 << 14) -> Model:
    """The model after one pass of all tasks over `learn`: the weighted means of the rows they touched."""
    held = learn.sparkSession.sparkContext.broadcast(model)
    cols = [f"x{j}" for j in range(model.dims + 1)]

    def run(batches):
        import copy

        from pyspark import TaskContext

        own, voc = copy.deepcopy(held.value), vocabulary.value
        own.start_training(seed + TaskContext.get().partitionId())
        some = False
        for batch in batches:
            for part in wordtok.slices(batch, 0):
                at, words, n = tokenize(part.column(0))
                symbol = voc.numbers(strings(words))[1][at]
                before = contexts(symbol, n, own.context)
                for a in range(0, len(symbol), batch_tokens):
                    own.train(before[a : a + batch_tokens], symbol[a : a + batch_tokens])
                    some = True
        for kind, (x, w) in enumerate(zip(own.rows, own.weight, strict=True)):
            row = np.flatnonzero(w) if some else np.empty(0, np.int64)
            for i in range(0, len(row), 8192):
                r = row[i : i + 8192]
                wide = np.zeros((len(r), len(cols)))
                wide[:, : x.shape[1]] = x[r] * w[r, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), kind, np.int32)), pa.array(r), pa.array(w[r]), *(pa.array(c) for c in wide.T.copy())], ["kind", "row", "w", *cols])

    touched = learn.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "kind int, row long, w double, " + ", ".join(f"{c} double" for c in cols))
    got = touched.groupBy("kind", "row").agg(F.sum("w").alias("w"), *[F.sum(c).alias(c) for c in cols]).toArrow()  # a row per symbol, at most
    kind, row, w = (got.column(c).to_numpy() for c in ("kind", "row", "w"))
    wide = np.stack([got.column(c).to_numpy() for c in cols], 1) if len(w) else np.empty((0, len(cols)))
    for i, x in enumerate(model.rows):
        own = kind == i
        x[row[own]] = wide[own][:, : x.shape[1]] / w[own, None]
    held.destroy()
    return model


class Fitted(NamedTuple):
    """What scoring needs: the counts of all words, N and V, and the bounded rest that is broadcast."""

    counts: DataFrame
    n: int
    v: int
    vocabulary: Vocabulary
    model: Model
    share: np.ndarray


def learns(train: Column | None, id_col: str) -> Column:
    return F.coalesce(~held_out(id_col) if train is None else train, F.lit(False))


def fit(docs: DataFrame, train: Column | None = None, least_share: float = 0.25, classes: int = 256, head: int = 150_000, context: int = 2, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    """Counts, vocabulary and model of the texts to learn from (default: those not held_out())."""
    train = learns(train, id_col)
    counts = word_counts(docs, train, text_col, classes)
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    heads = head_words(counts, head)
    top = sum(c >= max(1.0, least_share * n**0.5) for _, c in heads)
    vocabulary = Vocabulary(heads, top, classes, ends)
    own_n, own_v = np.zeros(classes), np.zeros(classes)  # of each class, without the words that are symbols themselves
    for k, a, b in counts.filter("word <> ''").groupBy("class").agg(F.sum("c"), F.count_if(F.col("c") > 0)).collect():
        own_n[k], own_v[k] = a, b
    for w, c in heads[:top]:
        own_n[zlib.crc32(w.encode()[-2:]) % classes] -= c
        own_v[zlib.crc32(w.encode()[-2:]) % classes] -= 1
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    model = Model(np.concatenate([vocabulary.count[: 1 + top], own_n]), context)
    for r in range(rounds):
        part = F.pmod(F.xxhash64(F.lit("round"), F.col(f"`{text_col}`").cast("string")), F.lit(rounds)) == r
        model = train_round(docs.filter(train & part), text_col, held, model, 1000 * r)
    held.destroy()
    return Fitted(counts, n, v, vocabulary, model, np.concatenate([np.zeros(1 + top), np.log10(own_n + own_v + 1)]))  # log10 of a class's shares


def score(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", fitted: Fitted | None = None, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every text, by what fit() learns
    from the same documents, or by what it has learnt."""
    spark, train = docs.sparkSession, learns(train, id_col)
    counts, n, v, vocabulary, model, share = fitted or fit(docs, train, id_col=id_col, text_col=text_col, **options)
    held = spark.sparkContext.broadcast(vocabulary)
    known_score = np.log10(vocabulary.count + 1.0)
    inner = np.where(vocabulary.symbol > vocabulary.top, known_score, 0.0)
    shared = spark.sparkContext.broadcast((model, share, known_score, inner))
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "rare"]

    def run(batches):
        voc, (model, shares, known, within) = held.value, shared.value
        for batch in batches:
            for part in wordtok.slices(batch, 3):
                at, words, n = tokenize(part.column(3))
                head_at, symbol = voc.numbers(strings(words))
                base = np.where(head_at >= 0, known[head_at], 0.0)
                inside = np.where(head_at >= 0, within[head_at], 0.0) - shares[symbol]
                seen = (head_at >= 0) & (voc.count[head_at] > 0)
                first = np.cumsum(n) - n
                s = symbol[at]
                lm = model.log_probs(contexts(s, n, model.context), s) / np.log(10) + inside[at]
                total = lambda x, first=first: pa.array(np.add.reduceat(x, first))
                rare = head_at[at] < 0
                cut = np.concatenate([[0], np.cumsum(np.add.reduceat(rare.astype(np.int64), first))])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n), total(seen[at].astype(np.int64)), total(base[at]), total(lm), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), words.take(pa.array(at[rare])))], names)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("doc_id"), (~train).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = rows.select("uid", "doc_id", "held_out").schema.add("n_tokens", "long").add("n_known", "long").add("base", "double").add("lm", "double").add("rare", T.ArrayType(T.StringType()))
    scored = common.materialize(rows.mapInArrow(run, schema), "scored")
    rare = scored.select("uid", F.explode("rare").alias("word")).join(counts.filter("c > 0").select("word", "c"), "word")
    found = rare.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("_sum"), F.count(F.lit(1)).alias("_known"))
    whole = scored.drop("rare").join(found, "uid", "left")
    more = F.coalesce("_sum", F.lit(0.0))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (F.col("lm") + more).alias("score"))
