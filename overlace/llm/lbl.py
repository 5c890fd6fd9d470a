"""10. LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation, and a unigram base.

The model's words are all training tokens from a count on, the end, and one for every other token. Two context words give
a prediction vector (a matrix per position). Its product with the vectors of about sqrt(words) classes, plus biases, is
normalised over the classes, and that with the vectors of the words of a class over the class, both exactly by batched
matrix products. A token outside the words has the last one's probability times its add-one share among such
tokens. All training tokens are dealt to shares of a fixed size, whatever the table's layout, and each share to a few rounds. In a round every share
trains from the last average on its tokens of that round; then vectors and the sums of their steps are averaged by
the steps that moved them, the rest by tokens.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.llm.common import fold, map_arrow, slices, texts
from overlace.llm.words import words
from overlace.plans.lineage import drop, stage

END = b""
DIM = 12


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 7) != 2)


def token_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(token, c) over whole texts, each with one END (an empty token); counted in tasks before the shuffle."""

    def run(batches):
        held: Counter = Counter()
        for batch in slices(batches):
            for text in texts(batch):
                held.update(words(text))
                held[END] += 1
            if len(held) > most:
                yield {"token": list(held), "c": list(held.values())}
                held.clear()
        yield {"token": list(held), "c": list(held.values())}

    return map_arrow(docs.select("text"), run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _classes(count: np.ndarray) -> np.ndarray:
    """The first word of each class: about sqrt(k) runs of the words, most frequent first, of equal sums of sqrt(count); the last is alone."""
    upto = np.cumsum(np.sqrt(count[:-1]))
    of = (upto / upto[-1:] * np.sqrt(len(upto))).astype(np.int64)
    return np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(upto))


def _in_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct id's run begins once the ids are sorted, the distinct ids, and the order; id and place are sorted as one number."""
    bits = len(ids).bit_length()
    key = np.sort(ids.astype(np.int64) << bits | np.arange(len(ids)))
    ids = key >> bits
    at = np.flatnonzero(np.diff(ids, prepend=-1))
    return at, ids[at], key & ((1 << bits) - 1)


class Model:
    """Parameters C (a matrix per position), Q and b (classes), R (context vectors, with one for the start), V and d (words within their class).

    ``first`` has the first word of each class; without it every word is a class of its own, and V and d are not used.
    """

    def __init__(self, unigram: np.ndarray, first: np.ndarray | None = None, dim: int = DIM, seed: int = 7):
        k, rng = len(unigram), np.random.default_rng(seed)
        self.start, self.noise = k, unigram
        self.first = np.arange(k) if first is None else first
        self.size = np.diff(self.first, append=k)
        self.of = np.repeat(np.arange(len(self.first)), self.size)
        self.mass = np.add.reduceat(unigram, self.first)
        self.C = np.stack([np.eye(dim, dtype=np.float32) * 0.5] * 2)
        self.Q = rng.normal(0, 0.05, (len(self.first), dim)).astype(np.float32)
        self.b = np.log(self.mass).astype(np.float32)
        self.R = rng.normal(0, 0.3, (k + 1, dim)).astype(np.float32)
        self.V = np.zeros((k, dim), np.float32)
        self.d = np.log(unigram / self.mass[self.of]).astype(np.float32)
        self.moved = [np.zeros(len(p), np.float32) for p in (self.R, self.V)]  # steps that moved a word's vectors
        self.seen = [np.full_like(p, 0.1) for p in (self.C, self.Q, self.b)]  # AdaGrad's sums
        self.seen_words = [np.full(len(p), 0.1, np.float32) for p in (self.R, self.V)]

    def parameters(self) -> list[np.ndarray]:
        return [self.C, self.Q, self.b, self.R, self.V, self.d]

    def flat(self, state: bool = False) -> np.ndarray:
        """All parameters, with AdaGrad's sums behind them if asked."""
        return np.concatenate([p.ravel() for p in self.parameters() + (self.seen + self.seen_words if state else [])])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters() + self.seen + self.seen_words:
            if at < len(flat):
                p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def pieces(self, total: float, block: int = 2048):
        """(kind, block, ids, weights, values) of all that was trained: vectors that were moved, and the other parameters by ``total``."""
        for kind, x, w in ((0, [self.R, self.seen_words[0]], self.moved[0]), (1, [self.V, self.d, self.seen_words[1]], self.moved[1])):
            ids = np.flatnonzero(w).astype(np.int32)
            for part in np.split(ids, np.flatnonzero(np.diff(ids // block)) + 1) if len(ids) else ():
                yield kind, int(part[0]) // block, part, w[part], np.column_stack([p[part] for p in x])
        rest = np.column_stack([np.concatenate([p.ravel() for p in x]) for x in ((self.C, self.Q, self.b), self.seen)])
        yield 2, 0, np.arange(len(rest), dtype=np.int32), np.full(len(rest), total, np.float32), rest

    def put(self, kind: int, ids: np.ndarray, x: np.ndarray) -> None:
        if kind == 0:
            self.R[ids], self.seen_words[0][ids] = x[:, :-1], x[:, -1]
        elif kind == 1:
            self.V[ids], self.d[ids], self.seen_words[1][ids] = x[:, :-2], x[:, -2], x[:, -1]
        else:
            for column, into in ((x[:, 0], (self.C, self.Q, self.b)), (x[:, 1], self.seen)):
                at = 0
                for p in into:
                    p[...] = column[at : at + p.size].reshape(p.shape)
                    at += p.size

    def predict(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        return self.R.take(c1, 0) @ self.C[0] + self.R.take(c2, 0) @ self.C[1]

    def train(self, triples: np.ndarray, weights: np.ndarray, rng, k: int = 32, k_word: int = 3, batch: int = 4096, rate: float = 0.08, cap: int = 16) -> None:
        """One pass of noise-contrastive estimation over (c1, c2, w) with weights; heavy triples are split into rows of at most ``cap``.

        The noise is ``k`` classes for a batch, and ``k_word`` words of the true word's class, all equally likely, for a row. Steps are AdaGrad's;
        context and word vectors sum their rows' gradients, the others take a batch's mean.
        """
        n = -(-weights // cap)
        rows = np.empty(n.sum(), [("c1", np.int32), ("c2", np.int32), ("w", np.int32), ("share", np.float32)])  # a row is read at once
        for name, x in zip(rows.dtype.names, (*triples, weights / n), strict=True):
            rows[name] = np.repeat(x, n)
        order = rng.permutation(len(rows))
        seen, (seen_r, seen_v) = self.seen, self.seen_words
        noise, lift = np.cumsum(self.mass), np.log(k * self.mass).astype(np.float32)
        lift_word = np.log(k_word / self.size[self.of]).astype(np.float32)
        for i in range(0, len(order), batch):
            part = rows.take(order[i : i + batch])
            part = part.take(np.argsort(part["w"]))  # so rows of a class lie together
            c1, c2, w, a = (part[name] for name in part.dtype.names)
            a = a / a.mean()
            c = self.of.take(w)
            r1, r2, qc = self.R.take(c1, 0), self.R.take(c2, 0), self.Q.take(c, 0)
            q = r1 @ self.C[0]
            q += r2 @ self.C[1]
            neg = np.minimum(np.searchsorted(noise, rng.random(k) * noise[-1]), len(noise) - 1)
            qn = self.Q[neg]
            pos = np.einsum("ij,ij->i", q, qc) + (self.b - lift).take(c)
            gp = a / (1 + np.exp(np.clip(pos, -30, 30)))
            out = q @ -qn.T
            out += lift[neg] - self.b[neg]
            gn = np.divide(-a[:, None], _one_and_exp(out), out=out)
            gq = gn @ qn
            qc *= gp[:, None]
            gq += qc
            grad = [np.zeros_like(p) for p in (self.C, self.Q, self.b)]
            at = np.flatnonzero(np.diff(c, prepend=-1))
            grad[1][c[at]] = np.add.reduceat(gp[:, None] * q, at)
            np.add.at(grad[1], neg, gn.T @ q)
            grad[2] += np.bincount(c, gp, len(self.b)).astype(np.float32)
            np.add.at(grad[2], neg, gn.sum(0))

            m = np.flatnonzero(self.size[c] > 1)
            if len(m):
                wm, cm, am, qm = w[m], c[m], a[m], np.ones((len(m), q.shape[1] + 1), np.float32)
                qm[:, :-1] = q.take(m, 0)
                size = self.size.take(cm)[:, None]
                every = np.empty((len(m), 1 + k_word), np.int64)
                every[:, 0] = wm
                every[:, 1:] = rng.random((len(m), k_word), np.float32) * size
                np.minimum(every[:, 1:], size - 1, out=every[:, 1:])
                every[:, 1:] += self.first.take(cm)[:, None]
                v = self.V.take(every, 0)
                s = (lift_word - self.d).take(every)
                s -= np.einsum("ikj,ij->ik", v, qm[:, :-1])
                g = np.divide(-am[:, None], _one_and_exp(s), out=s)
                g[:, 0] += am
                gq[m] += np.einsum("ik,ikj->ij", g, v)
                at, ids, by = _in_order(every.ravel())
                x = qm.take(by // (1 + k_word), 0)
                x *= g.ravel().take(by)[:, None]
                x = np.add.reduceat(x, at)
                seen_v[ids] += np.einsum("ij,ij->i", x, x) / x.shape[1]
                x *= (rate / np.sqrt(seen_v[ids]))[:, None]
                self.V[ids] += x[:, :-1]
                self.d[ids] += x[:, -1]
                self.moved[1][ids] += 1

            grad[0][0], grad[0][1] = r1.T @ gq, r2.T @ gq
            at, ids, by = _in_order(np.concatenate([c1, c2]))
            x = np.add.reduceat(np.concatenate([gq @ self.C[0].T, gq @ self.C[1].T]).take(by, 0), at)
            seen_r[ids] += np.einsum("ij,ij->i", x, x) / x.shape[1]
            x *= (rate / np.sqrt(seen_r[ids]))[:, None]
            self.R[ids] += x
            self.moved[0][ids] += 1
            for p, g, s in zip((self.C, self.Q, self.b), grad, seen, strict=True):
                g *= 100.0 / len(part)  # the batch's mean
                s += g * g
                p += rate * g / np.sqrt(s)

    def normaliser(self):
        """A function from context codes to log normalisers of the classes, computed once for each distinct context of a call."""

        def log_z(code: np.ndarray) -> np.ndarray:
            new, back = np.unique(code, return_inverse=True)
            z = np.empty(len(new), np.float32)
            for i in range(0, len(new), 1024):
                c = new[i : i + 1024]
                s = self.predict(c // (self.start + 1), c % (self.start + 1)) @ self.Q.T
                s += self.b
                z[i : i + 1024] = _log_sum(s)
            return z[back]

        return log_z

    def log_probability(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of each word after its context: its class's logarithm and its own within the class, both normalised exactly."""
        q, c = self.predict(c1, c2), self.of[w]
        out = np.einsum("ij,ij->i", q, self.Q[c]) + self.b[c] - self.normaliser()(c1 * (self.start + 1) + c2)
        order = np.argsort(c)
        ends = np.cumsum(np.bincount(c, minlength=len(self.first)))
        q, own = q.take(order, 0), w.take(order)  # in order of the classes, so each is a slice
        add = np.zeros(len(order), np.float32)
        for k in np.unique(c[self.size[c] > 1]):
            a, z = self.first[k], self.first[k] + self.size[k]
            for i in range(ends[k - 1] if k else 0, ends[k], 1024):
                o = slice(i, min(i + 1024, ends[k]))
                s = q[o] @ self.V[a:z].T
                s += self.d[a:z]
                true = s[np.arange(len(s)), own[o] - a]
                add[o] = true - _log_sum(s)
        out[order] += add
        return out


def _one_and_exp(x: np.ndarray) -> np.ndarray:
    """1 + exp(x) in place, as batches of new arrays cost more than the arithmetic."""
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return x


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Logarithms of the rows' sums of exponentials; overwrites ``s``. The greatest are taken out first where they could leave 32-bit floats."""
    ones = np.ones(s.shape[1], np.float32)
    if not s.size or max(s.max(), -s.min()) < 80:
        return np.log(np.exp(s, out=s) @ ones)
    top = s.max(1)
    s -= top[:, None]
    return top + np.log(np.exp(s, out=s) @ ones)


def _contexts(ids: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The class before, and the one before that, of each token; START before a document's first."""
    c1, c2 = np.empty_like(ids), np.empty_like(ids)
    c1[1:], c1[0] = ids[:-1], start
    c2[2:], c2[:2] = ids[:-2], start
    first = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    c1[first] = start
    c2[first] = start
    c2[np.minimum(first + 1, len(ids) - 1)[first + 1 < len(ids)]] = start
    return c1, c2


def _triples(ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (c1, c2, w) of documents that end with 0 each, and their counts; what they are made from is freed before training."""
    c1, c2 = _contexts(ids, np.flatnonzero(ids == 0), start)
    c1 *= start + 1
    c1 += c2
    del c2
    pairs, at = np.unique(c1, return_inverse=True)
    del c1
    at *= start + 1
    at += ids
    codes, counts = np.unique(at, return_counts=True)
    del at
    pair = pairs[codes // (start + 1)]
    return np.stack([pair // (start + 1), pair % (start + 1), codes % (start + 1)]).astype(np.int32), counts


def _mean(pieces: DataFrame) -> DataFrame:
    """(kind, ids, x): the weighted means of the pieces of all tasks, summed one piece at a time."""

    def run(batches):
        held: dict = {}
        for batch in slices(batches, 16):
            for kind, block, ids, w, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, w = np.frombuffer(ids, np.int32), np.frombuffer(w, np.float32).astype(float)
                x = np.frombuffer(x, np.float32).reshape(len(ids), -1)
                low, sums = held.get((kind, block), (0, np.zeros((0, x.shape[1] + 1))))
                low = low if len(sums) else int(ids[0])
                if ids[0] < low or ids[-1] >= low + len(sums):
                    least, most = min(low, int(ids[0])), max(low + len(sums), int(ids[-1]) + 1)
                    sums, low = np.pad(sums, ((low - least, most - low - len(sums)), (0, 0))), least
                sums[ids - low] += np.column_stack([x * w[:, None], w])
                held[kind, block] = low, sums
        for (kind, _), (low, sums) in held.items():
            at = np.flatnonzero(sums[:, -1])
            yield {"kind": [kind], "ids": [(at + low).astype(np.int32).tobytes()], "x": [(sums[at, :-1] / sums[at, -1:]).astype(np.float32).tobytes()]}

    return map_arrow(pieces.repartition("kind", "block"), run, "kind int, ids binary, x binary")


def train_model(docs: DataFrame, words_of: dict[bytes, int], unigram: np.ndarray, n_tokens: int, share_tokens: int = 5_000_000, rounds: int = 2, tokens_at_once: int = 3_000_000) -> Model:
    """Trains over all training documents: ``rounds`` rounds over shares of about ``share_tokens`` tokens, of which only the vectors that they moved leave the tasks.

    Documents are dealt by a hash of their place and id, so neither the table's partitions nor a repeated id shape a share. Texts become word numbers
    once; a round shuffles its part of them.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    known = sc.broadcast(words_of)  # as large as the model's vocabulary
    rest, shares = len(unigram) - 1, max(1, -(-n_tokens // share_tokens))

    def encode(batches):
        for batch in slices(batches):
            deal = batch.column(1).to_numpy()
            ids = [np.fromiter(map(known.value.get, words(t), repeat(rest)), np.int32).tobytes() for t in texts(batch)]
            yield {"share": deal % shares, "round": deal // shares % rounds, "ids": ids}

    place = F.shiftright(F.xxhash64(F.monotonically_increasing_id(), "doc_id"), 2).bitwiseAND(F.lit((1 << 61) - 1))
    coded = stage(map_arrow(_training(docs).select("text", place.alias("deal")), encode, "share int, round int, ids binary"))
    model = Model(unigram, _classes(unigram))
    end = np.array([words_of[END]])
    for number in range(rounds):
        shared = sc.broadcast((unigram, model.flat(state=True)))

        def run(batches, number=number, shared=shared):
            uni, flat = shared.value
            m = Model(uni, _classes(uni))
            m.load(flat)
            rng = np.random.default_rng([number, TaskContext.get().partitionId()])
            held, n, total = [], 0, 0

            def learn():
                m.train(*_triples(np.concatenate(held).astype(np.int64), m.start), rng)

            for data in chain.from_iterable(b.column(0).to_pylist() for b in slices(batches)):
                held += [np.frombuffer(data, np.int32), end]
                n += len(held[-2]) + 1
                if n >= tokens_at_once:
                    learn()
                    total, n, held = total + n, 0, []
            if n:
                learn()
            if total + n:
                for kind, block, *arrays in m.pieces(float(total + n)):
                    yield {"kind": [kind], "block": [block]} | {k: [x.tobytes()] for k, x in zip(("ids", "w", "x"), arrays, strict=True)}

        mine = coded.where(F.col("round") == number).repartitionById(shares, "share").select("ids")  # a share a task
        for r in _mean(map_arrow(mine, run, "kind int, block int, ids binary, w binary, x binary")).toLocalIterator():
            ids = np.frombuffer(r.ids, np.int32)
            model.put(r.kind, ids, np.frombuffer(r.x, np.float32).reshape(len(ids), -1))
        shared.unpersist()
    drop(coded)
    return model


def _least_for(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` tokens reach; read from a histogram of one row per power."""
    power = F.floor(F.log2("c")).cast("int")
    cells = sorted(counts.groupBy(power.alias("power")).count().collect(), reverse=True)
    held, least = 0, cells[0][0] + 1 if cells else 0
    for p, k in cells:
        held += k
        if held > most:
            break
        least = p
    return 1 << least


def _frequent(counts: DataFrame, least: int, at_least: int) -> DataFrame:
    """(token, c) of all tokens from ``least`` on, and of the ``at_least`` most frequent ones where those are more."""
    some = counts.where(F.col("c") >= least)
    if some.count() >= at_least:
        return some
    # Executors merge the partitions' first rows while they write; the driver reads the result alone.
    return stage(counts.orderBy(F.desc("c"), "token").limit(at_least))


def score_documents(docs: DataFrame, n_classes: int = 768, head: int = 65_536, least_count: int = 10, per_root: int = 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Trained on rows whose crc32 of the id as text, modulo 7, is not 2. The model's words are all tokens that occur
    ``least_count`` times in training and sqrt(train_tokens) / ``per_root`` times, and at least the ``n_classes`` most frequent. So they grow
    about with the root of the corpus, and model and broadcasts stay far below it; all other tokens are scored by their class and their own counts.
    The counts of the words, and of at most ``head`` tokens that are more frequent than all others, are broadcast; all other counts are joined.
    A null or empty text is its end alone; a null id is in no fold, so it is scored and not learned from. Repeated rows keep a row each; other
    columns are dropped. Without training rows the counts are zero and the model is uniform.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc = docs.sparkSession.sparkContext
    counts = stage(token_counts(_training(docs)))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    named = _frequent(counts, max(least_count, int(np.sqrt(n) / per_root)), n_classes).select("token", "c").toArrow()
    named = dict(zip(named["token"].to_pylist(), named["c"].to_pylist(), strict=True))
    by = dict(named)
    got = counts.where((F.col("c") >= _least_for(counts, head)) | (F.length("token") == 0)).toArrow()
    by |= zip(got["token"].to_pylist(), got["c"].to_pylist(), strict=True)
    top = sorted(by.items(), key=lambda x: (-x[1], x[0]))
    classes = {END: 0} | {t: i + 1 for i, (t, _) in enumerate([x for x in top if x[0] != END and x[0] in named])}
    c = np.array([by.get(t, 0) for t in classes], float)
    others, v_others = n - c.sum(), v - sum(t in by for t in classes)
    unigram = np.append(c + 1, max(0.0, others) + 1)
    unigram /= unigram.sum()
    model = train_model(docs, classes, unigram, n)
    shared = sc.broadcast(({t: i for i, (t, _) in enumerate(top)}, np.log10(np.array([x for _, x in top] + [0], float) + 1), classes, unigram, model.flat()))

    def run(batches):
        place, logs, known, uni, flat = shared.value
        m, rest = Model(uni, _classes(uni)), len(uni) - 1
        m.load(flat)
        to_class = np.full(len(place) + 1, rest)
        for t, i in known.items():
            if t in place:
                to_class[place[t]] = i
        miss = len(place)
        for batch in slices(batches, 512):
            per = [words(t) + [END] for t in texts(batch)]
            size = np.array([len(x) for x in per])
            at = np.fromiter(map(place.get, chain.from_iterable(per), repeat(miss)), np.int64, size.sum())
            ids, ends = to_class[at], np.cumsum(size) - 1
            if END not in place:
                ids[ends] = 0
            c1, c2 = _contexts(ids, ends, m.start)
            logp = m.log_probability(c1, c2, ids) / np.log(10)
            begin = ends - size + 1
            add = lambda x: np.add.reduceat(x.astype(float), begin)
            lost = at == miss
            tail = [Counter([w for i in np.flatnonzero(lost[b : b + len(ws)]).tolist() if (w := ws[i]) != END]) for ws, b in zip(per, begin.tolist(), strict=True)]
            yield {
                "doc_id": batch.column(0), "n_tokens": size, "head_known": add(at != miss).astype(np.int64), "head_log": add(logs[at]),
                "n_rest": add(ids == rest).astype(np.int64), "rest_log": add(logs[at] * (ids == rest)), "class_log": add(logp),
                "tail": [[{"token": w, "tf": k} for w, k in x.items()] for x in tail],
            }

    schema = "doc_id long, n_tokens long, head_known long, head_log double, n_rest long, rest_log double, class_log double, tail array<struct<token: binary, tf: long>>"
    seen = stage(map_arrow(docs, run, schema).withColumn("row", F.monotonically_increasing_id()))
    tail = seen.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.tf").join(counts, "token")
    tail = tail.groupBy("row").agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail_log"))
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    out = seen.drop("tail").join(tail, "row", "left")
    return out.select(
        "doc_id",
        F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("class_log") + F.col("rest_log") + tail_log - F.col("n_rest") * float(np.log10(others + v_others + 1))).alias("score"),
    )
