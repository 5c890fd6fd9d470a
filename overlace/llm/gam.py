"""6. Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one feature, then on pairs of features, are boosted in cycles with a small step; their sums are
lookup tables over bins, so a score is a vectorised addition of table cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.llm.common import fold, map_arrow, slices

FEATURES = ["log_words", "word_length", "upper", "digits", "symbols", "exclaims", "other_marks", "not_ascii", "distinct_words", "repeated_lines", "line_rate", "sentence_ends"]


def _classes() -> np.ndarray:
    """256 x 7 membership of bytes: upper, lower, digit, symbol, exclamation mark, other mark, lead byte of several."""
    out = np.zeros((256, 7))
    for b in range(256):
        c = chr(b)
        out[b] = [65 <= b <= 90, 97 <= b <= 122, 48 <= b <= 57, c in "#*$%&|<>", c == "!", 33 <= b < 127 and not c.isalnum() and c not in "#*$%&|<>!.,", b >= 0xC0]
    return out


CLASSES = _classes()


def features(text: str) -> list[float]:
    """Of the whole text, whatever its length; an empty text gives zeros."""
    data = text.encode("utf-8", "surrogatepass")
    ws = data.split()
    if not ws:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digit, symbol, bang, mark, lead = counts @ CLASSES
    n = len(ws)
    letters = max(1.0, upper + lower + lead)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [np.log1p(n), (counts[33:].sum() - counts[128:192].sum()) / n, upper / letters, digit / n, symbol / n, bang / n, mark / n, lead / letters, len(set(ws)) / n, 1 - len(set(lines)) / len(lines), len(lines) / n, counts[46] / n]


def with_features(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """(columns..., x): the feature vector of each row, in Python over Arrow batches; a column named x is not among ``columns``."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", x array<double>"

    def run(batches):
        for batch in slices(batches):
            yield {c: batch.column(i) for i, c in enumerate(columns)} | {"x": [features(t or "") for t in batch.column(len(columns)).to_pylist()]}

    return map_arrow(docs.select(*columns, F.col(text)), run, schema)


@dataclass
class Gam:
    """Cut points per feature, a table per feature, and a table per pair of features."""

    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, f], "right")]
        coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.pair_cuts)]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[coarse[f], coarse[g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -35, 35)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton steps of a tree with at most ``leaves`` leaves over ordered bins, grown where the gain is largest."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((gain(a, c) + gain(c, b) - gain(a, b), k, c) for k, (a, b) in enumerate(parts) for c in range(a + 1, b)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree of one cut on either axis (four leaves): its gain and its table."""
    G, H = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    best, table = 0.0, np.zeros_like(g)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            q = [(M[a, b], M[a, -1] - M[a, b], M[-1, b] - M[a, b], M[-1, -1] - M[a, -1] - M[-1, b] + M[a, b]) for M in (G, H)]
            v = [x / (y + ridge) for x, y in zip(*q, strict=True)]
            if (gain := sum(x * z for x, z in zip(q[0], v, strict=True))) > best:
                best, table = gain, np.block([[np.full((a, b), v[0]), np.full((a, g.shape[1] - b), v[1])], [np.full((g.shape[0] - a, b), v[2]), np.full((g.shape[0] - a, g.shape[1] - b), v[3])]])
    return best, table


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, cycles: int = 120, pair_cycles: int = 40, n_pairs: int = 6, rate: float = 0.15, leaves: int = 3, ridge: float = 1.0) -> Gam:
    """Cyclic boosting of the log-loss; features are never chosen, each has its turn. Without both classes: a constant."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for f in range(width)]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, pair_bins + 1)[1:-1])) if n else np.empty(0) for f in range(width)]
    p = (y.sum() + 1) / (n + 2)
    model = Gam(cuts, float(np.log(p / (1 - p))), [np.zeros(len(c) + 1) for c in cuts], [], coarse, [])
    if len(set(y.tolist())) < 2:
        return model
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    z = np.full(n, model.base)

    def slopes():
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(cycles):
        for f in range(width):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[f], g, len(model.tables[f])), np.bincount(at[f], h, len(model.tables[f])), leaves, ridge)
            model.tables[f] += step
            z += step[at[f]]
    low = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]
    grid = lambda f, g, v: np.bincount(low[f] * (len(coarse[g]) + 1) + low[g], v, (len(coarse[f]) + 1) * (len(coarse[g]) + 1)).reshape(len(coarse[f]) + 1, -1)
    g, h = slopes()
    gains = sorted(((_cross(grid(a, b, g), grid(a, b, h), ridge)[0], a, b) for a in range(width) for b in range(a + 1, width)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_cycles):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _cross(grid(a, b, g), grid(a, b, h), ridge)[1]
            model.pair_tables[k] += step
            z += step[low[a], low[b]]
    return model


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Gam:
    """Fits on a sample of about ``most_rows`` labelled documents, those of the smallest id hashes, outside the held-out fold.

    labels: (doc_id, quality). Rows with null ids or labels are left out; an id with several labels counts as good where their mean is
    0.5 or more, one with several texts is learned from that of the smallest feature vector. A threshold on the hash draws the sample,
    so no task or driver sorts the labels; it is all of them where there are no more than ``most_rows``.
    """
    known = labels.where("doc_id is not null and quality is not null").where(fold("doc_id", 3) != 1).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    share = most_rows / max(1, known.count())
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32))) if share < 1 else known
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    got = with_features(rows, ["doc_id", "y"]).groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def classify(docs: DataFrame, model: Gam, columns: list[str], text: str = "text", keep_text: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """(columns..., score, predicted) of every row: score in 0..1, predicted 1 from 0.5 on.

    Null and empty texts are scored too, by a vector of zeros. Nothing is shuffled. With ``keep_text`` the text is
    among ``columns`` and crosses to Python once. Columns named like the results, score and predicted unless ``names`` gives
    others, are replaced.
    """
    columns = [c for c in columns if c.lower() not in {n.lower() for n in names}]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + f", `{names[0]}` double, `{names[1]}` int"
    at = columns.index(text) if keep_text else len(columns)

    def run(batches):
        for batch in slices(batches):
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            score = model.score(x)
            yield {c: batch.column(i) for i, c in enumerate(columns)} | {names[0]: score, names[1]: (score >= 0.5).astype(np.int32)}

    return map_arrow(docs.select(*columns, *([] if keep_text else [F.col(text)])), run, schema)
