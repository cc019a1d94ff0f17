"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A short list of insults is given, and a lexicon is learned from labelled texts: words, and beginnings of words, that are
far more frequent in toxic texts. The features of a text are densities of lexicon hits, their weights, hits near words of
the second person, shares of capitals and punctuation, and the rate of words written with digits or signs inside, with the
hits those hide. Features of a training text use a lexicon learned without its fold, and the calibration is fitted to
scores of trees grown without its fold, so neither is flattered by the text itself.

Fitting uses at most MAX_LABELLED labelled texts, those with the smallest hashes of their ids, which bounds the lexicon
too; scoring is one pass over all whole texts with the small fitted model in a broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, table, text_bytes, text_chunks

#: The bound of the fit: labelled texts.
MAX_LABELLED = 20_000
THRESHOLD, FOLDS = 0.3, 4
#: A token enters a lexicon with so many toxic texts at least, and so large a log ratio of its rates.
LEAST_TEXTS, LEAST_WEIGHT = 3, 3.0
BEGINNINGS = (4, 5, 6)
NEAR = 5
#: Words of the second person in English, German, French and Spanish. Fixed values.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinem deinen ihr euch euer eure sie ihnen tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros os vuestro vuestra".split())
#: Common insults in English, German, French and Spanish, known without any label. Fixed values.
INSULTS = frozenset(
    "asshole bastard bitch clown coward crap creep cretin degenerate disgusting dimwit dirtbag dumb dumbass fool freak fuck fucking garbage idiot idiotic idiots imbecile jerk "
    "loser losers lowlife moron moronic morons pathetic pig retard rubbish scum scumbag shit shitty slut stupid subhuman trash twat ugly useless vermin whore worthless wretch "
    "abschaum arschloch blödmann depp dreckskerl dumm dummkopf hurensohn idioten schwachkopf trottel versager wichser "
    "abruti connard connasse crétin débile imbécile minable ordure pauvre pute salaud salope stupide "
    "basura cabrón cretino escoria estúpido estúpida idiota imbécil inútil maldito mierda patético perdedor puta tonto".split()
)
_WORD = re.compile(r"[^\W_]+")
#: A word with digits or signs between its letters, and the letters they stand for.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!|*.+\-_]{1,3}[^\W\d_]++)+")
#: What often stands around a word and hides nothing.
_AROUND = ".,;:!?\"'()"
_STANDS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "+": None, "-": None, "_": None})
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_PUNCT = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])
_EXCLAIM = np.array([b == 33 for b in range(256)])
FEATURES = ("hits", "hit_share", "distinct", "weight", "top", "begin_share", "begin_distinct", "begin_top", "near_second", "second", "capitals", "punctuation", "exclaims", "masked", "masked_hits", "length", "insult_share", "insults")


def tokens(text: str) -> set[str]:
    """The distinct words of a text, and the beginnings of its longer words with a mark after them."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "~" for k in BEGINNINGS for w in words if len(w) > k}


def masked_words(low: str) -> list[str]:
    """Words with digits or signs inside. They hold no white space, so pieces of letters alone needn't be looked at."""
    return [m for t in low.split() if not t.isalpha() and not t.strip(_AROUND).isalpha() for m in _MASKED.findall(t)]


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    begins: dict[str, float] = field(default_factory=dict)

    def features(self, text: str, row: np.ndarray) -> None:
        """Fill a row of FEATURES but for the shares of bytes."""
        low = text.lower()
        words = _WORD.findall(low)
        if not words:
            return
        n, own = len(words), set(words)
        known = self.words
        hits = [w for w in own if w in known]
        begins = {}
        for k in BEGINNINGS:
            for b in {w[:k] for w in own if len(w) > k}.intersection(self.begins):
                begins[b] = self.begins[b]
        masked = masked_words(low)
        second = not own.isdisjoint(SECOND)
        if hits or begins or second:
            found = {w for w in own if w in known or any(w[:k] in begins for k in BEGINNINGS)} if hits or begins else ()
            at = [i for i, w in enumerate(words) if w in found] if found else []
            to = [i for i, w in enumerate(words) if w in SECOND] if second else []
            row[9] = len(to) / n
            if at:
                row[0], row[1] = np.log1p(len(at)), len(at) / n
                if to:
                    t, a = np.array(to), np.array(at)
                    k = np.searchsorted(t, a)
                    gap = np.minimum(np.abs(a - t[np.minimum(k, len(t) - 1)]), np.abs(a - t[np.maximum(k - 1, 0)]))
                    row[8] = np.count_nonzero(gap <= NEAR) / n
        if hits:
            weights = [known[w] for w in hits]
            row[2], row[3], row[4] = len(hits), sum(weights), max(weights)
        if begins:
            row[5], row[6], row[7] = len(begins) / n, len(begins), max(begins.values())
        if masked:
            row[13] = len(masked) / n
            row[14] = sum(p in known or p in INSULTS for p in (w.translate(_STANDS) for w in masked)) / n
        row[15] = np.log1p(n)
        if not own.isdisjoint(INSULTS):
            row[16], row[17] = sum(w in INSULTS for w in words) / n, len(own & INSULTS)


def _shares(b: pa.Array, rows: np.ndarray) -> None:
    data, offsets = text_bytes(b)
    size = np.maximum(1, np.diff(offsets))
    for k, flag in ((10, _CAPITAL), (11, _PUNCT), (12, _EXCLAIM)):
        total = np.concatenate([[0], np.cumsum(flag[data])])
        rows[:, k] = (total[offsets[1:]] - total[offsets[:-1]]) / size


class Trees:
    """Boosted trees of fixed depth with logistic loss, grown on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 2.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            f += self._grow(binned, y - p, p * (1 - p))
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        inner = 2**self.depth - 1
        feature, cut = np.full(inner, -1), np.zeros(inner)
        node, width = np.zeros(len(grad), np.int64), self.bins + 1
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            local, best = node - first, np.full(count, 1e-6)
            pick = [(-1, 0)] * count
            for j, c in enumerate(self.cuts):
                if not len(c):
                    continue
                at = local * width + binned[:, j]
                g, h = (np.cumsum(np.bincount(at, v, count * width).reshape(count, width), axis=1) for v in (grad, hess))
                gl, hl, gr, hr = g[:, :-1], h[:, :-1], g[:, -1:] - g[:, :-1], h[:, -1:] - h[:, :-1]
                gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                gain[(hl < self.least / 10) | (hr < self.least / 10)] = 0
                k = gain[:, : len(c)].argmax(axis=1)
                for v in np.flatnonzero(gain[np.arange(count), k] > best):
                    best[v], pick[v] = gain[v, k[v]], (j, int(k[v]))
            right = np.zeros(len(grad), bool)
            for v, (j, k) in enumerate(pick):
                if j >= 0:
                    feature[first + v], cut[first + v] = j, self.cuts[j][k]
                    mine = local == v
                    right[mine] = binned[mine, j] > k
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = self.rate * g / (h + self.ridge)
        self.trees.append((feature, cut, value))
        return value[leaf]

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[node]
                node = 2 * node + 1 + ((j >= 0) & (x[rows, np.maximum(j, 0)] > cut[node]))
            f += value[node - len(feature)]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the nearest rising function, by pooling neighbours that fall; between them it is read off linearly."""
    order = np.argsort(x, kind="stable")
    xs, first = np.unique(x[order], return_index=True)
    n = np.diff([*first, len(x)])
    mean = np.add.reduceat(y[order], first) / n
    pools: list[list[float]] = []  # mean, weight, sum of x by weight
    for a, b, c in zip(mean, n, xs, strict=True):
        pools.append([a, b, b * c])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, s = pools.pop()
            p = pools[-1]
            p[0], p[1], p[2] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2] + s
    return np.array([s / w for _, w, s in pools]), np.array([m for m, _, _ in pools])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    points: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), float(self.points[1][0]))
        return np.clip(np.interp(self.trees.raw(x), *self.points), 0, 1)


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic and fold of at most `most` labelled texts; the rows of the held-out remainder are never among them."""
    toxic = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    seen = toxic.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` rows of two numbers, so this side is small whatever the tables' size.
    joined = docs.select("doc_id", "text").join(F.broadcast(seen), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    return one.select("text", "toxic", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"))


def _counts(sample: DataFrame, only: frozenset | None) -> DataFrame:
    """token, fold, toxic, n: in how many texts a token is; of the tokens in `only`, if given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple[int, int], Counter] = {}
        for b in batches:
            for text, toxic, fold in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                own = tokens(text)
                by.setdefault((fold, toxic), Counter()).update(own if only is None else own & only)
        for (fold, toxic), c in by.items():
            yield pa.RecordBatch.from_pydict({"token": list(c), "fold": pa.array([fold] * len(c), pa.int32()), "toxic": pa.array([toxic] * len(c), pa.int32()), "n": list(c.values())})

    return sample.mapInArrow(count, "token string, fold int, toxic int, n long")


def _lexicon(rows: list, texts: dict, without: int | None) -> Lexicon:
    """The lexicon from all folds but `without`. rows: token and its counts by fold and label; texts: counts of texts."""
    totals = [sum(n for (f, t), n in texts.items() if t == k and f != without) for k in (0, 1)]
    out = Lexicon()
    for token, counts in rows:
        seen = [sum(n for f, t, n in counts if t == k and f != without) for k in (0, 1)]
        if seen[1] >= LEAST_TEXTS:
            weight = float(np.log((seen[1] + 0.1) / (totals[1] + 0.2)) - np.log((seen[0] + 0.5) / (totals[0] + 1)))
            if weight >= LEAST_WEIGHT:
                (out.begins if token.endswith("~") else out.words)[token.rstrip("~")] = weight
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """A model from labelled documents. docs: doc_id, text; labels: doc_id, toxic."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.keep(_sample(docs, labels, most))
    texts = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n = [sum(v for (_, t), v in texts.items() if t == k) for k in (0, 1)]
    if not n[0] or not n[1]:
        return Model(Lexicon(), None, (np.zeros(1), np.array([1.0 if n[1] else 0.0])))
    frequent = _counts(sample.where("toxic = 1"), None).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    candidates = frozenset(r.token for r in frequent.collect())  # of the sample, so bounded with it
    by = {(f, t): F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}_{t}") for f in range(FOLDS) for t in (0, 1)}
    seen = _counts(sample, candidates).groupBy("token").agg(*by.values())
    some = F.lit(False)
    for without in (None, *range(FOLDS)):  # whether a token enters any of the lexicons, with room for rounding
        one, zero = (sum((F.col(f"n{f}_{t}") for f in range(FOLDS) if f != without), F.lit(0)) for t in (1, 0))
        total = [sum(v for (f, t), v in texts.items() if t == k and f != without) for k in (0, 1)]
        some = some | ((one >= LEAST_TEXTS) & (F.log((one + 0.1) / (total[1] + 0.2)) - F.log((zero + 0.5) / (total[0] + 1)) >= LEAST_WEIGHT - 1e-6))
    rows = [(r.token, [(f, t, r[f"n{f}_{t}"]) for f, t in by]) for r in seen.where(some).orderBy("token").collect()]
    lexicons = {f: _lexicon(rows, texts, f) for f in range(FOLDS)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            x = np.zeros((b.num_rows, len(FEATURES)))
            for row, text, fold in zip(x, b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True):
                lexicons[fold].features(text, row)
            _shares(b.column("text"), x)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column("toxic"), b.column("fold"), pa.array([hash_of(t) for t in b.column("text").to_pylist()], pa.int64())], ["x", "toxic", "fold", "h"])

    got = sample.mapInArrow(measure, "x array<double>, toxic int, fold int, h long").toArrow()
    got = got.sort_by([("h", "ascending"), ("toxic", "ascending")])  # at most `most` rows, whose order no longer depends on how they were dealt
    x, y, fold = np.array(got["x"].to_pylist()), got["toxic"].to_numpy().astype(float), got["fold"].to_numpy()
    apart = np.zeros(len(y))
    for f in range(FOLDS):
        held = fold == f
        if held.any():
            apart[held] = Trees().fit(x[~held], y[~held]).raw(x[held]) if 0 < y[~held].sum() < (~held).sum() else 0.0
    return Model(_lexicon(rows, texts, None), Trees().fit(x, y), isotonic(apart, y))


def hash_of(text: str) -> int:
    """An order for training rows that doesn't depend on how they are dealt."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scored(m, b.column("text")))], ["doc_id", "score"])

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(score, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, score double")


def _scored(m: Model, texts: pa.Array) -> np.ndarray:
    x = np.zeros((len(texts), len(FEATURES)))
    for row, t in zip(x, texts.to_pylist(), strict=True):
        if t:
            m.lexicon.features(t, row)
    _shares(texts, x)
    return m.score(x)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`.

    held_out: crc32 of the id as text, modulo 4, is 2; such rows' labels are never used, nor are rows without an id
    (held_out is then false). A null or empty text is scored by features of zero. Without labels of both kinds the
    score is the rate of label 1, 0 without any. A label given twice counts as toxic if either does; a repeated document
    trains once. Other columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, most)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_LABELLED) -> DataFrame:
    """`docs` with its own columns, without the rows whose score reaches the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in text_chunks(batches, text=at):
            yield b.filter(pa.array(_scored(m, b.column(at)) < threshold))

    return docs.mapInArrow(clean, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
