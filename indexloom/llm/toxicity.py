"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.session import written

# Seed lexicons, words that call a person or a thing worthless.
SEEDS = (
    ("idiot", "moron", "stupid", "imbecile", "dumb", "fool"),
    ("scum", "trash", "garbage", "vermin", "filth"),
    ("loser", "clown", "pathetic", "worthless", "disgusting", "useless"),
)
# Pattern voters.
PATTERNS = (
    r"\b(you|he|she|they)('re| is| are)? (an? )?(such |complete |total )?(idiot|moron|loser|clown|scum|trash)",
    r"\b(shut up|go to hell|get lost|hate you)\b",
    r"[a-z][@*#$%]{2,}[a-z]*",
)
_PATTERNS = [re.compile(p) for p in PATTERNS]
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Learning:
    """Bounds of what is learned from: `sample` labelled rows (the first by hash), and of what is kept: the `lexicon`
    features of most evidence. contexts: after how many different words a feature must stand; lift: how much likelier it is
    in toxic texts; doubt: the
    largest chance that a feature without meaning is as one-sided; groups: voters into which the mined lexicon is dealt; threshold: of the prediction."""

    sample: int = 30_000
    lexicon: int = 4_000
    contexts: int = 3
    lift: float = 12.0
    doubt: float = 1e-4
    groups: int = 8
    threshold: float = 0.3
    id_col: str = "doc_id"
    text_col: str = "text"


def features(word: str) -> Iterator[str]:
    """What a lexicon can know a word by: itself and, for word families, its first letters."""
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "-"


@dataclass
class Model:
    """index: number of each lexicon feature; heads: first letters of them all; weights and bias: of the classifier."""

    index: dict[str, int]
    seeds: dict[str, int]
    n_groups: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def __post_init__(self) -> None:
        self.heads = {f.rstrip("-")[:4] for f in self.index}

    def hits(self, text: str) -> list[int]:
        """Numbers of the features in a text; those after the lexicon's are seed lists and patterns."""
        low = text.lower()
        found: set[int] = set()
        index, heads, seeds, n = self.index, self.heads, self.seeds, len(self.index)
        for word in set(_WORD.findall(low)):
            if word[:4] in heads:
                found.update(index[f] for f in features(word) if f in index)
            if word in seeds:
                found.add(n + seeds[word])
        found.update(n + len(SEEDS) + k for k, p in enumerate(_PATTERNS) if p.search(low))
        return sorted(found)

    @property
    def size(self) -> int:
        return len(self.index) + len(SEEDS) + len(PATTERNS)

    def voters(self) -> np.ndarray:
        """The voter of each feature. Words and word families of the mined lexicon are dealt into groups apart."""
        own = [zlib.crc32(f.encode()) % self.n_groups + (self.n_groups if f.endswith("-") else 0) for f in self.index]
        return np.array([*own, *range(2 * self.n_groups, 2 * self.n_groups + len(SEEDS) + len(PATTERNS))], dtype=int)

    def score(self, hits: list[int]) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[hits].sum()))))


def label_model(hit: np.ndarray, clean: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posterior toxicity of rows from voters, and the voters' weights.

    hit[i, j]: voter j calls row i toxic (else it abstains); clean[i]: no voter found anything, the one vote for clean.
    Expectation-maximisation estimates each voter's chance to vote on toxic and on clean rows. Voters that go together
    beyond what the class explains are correlated: each counts by one over one plus its correlations with the others,
    estimated from what is left of the votes when their expectation is taken off.
    """
    votes = np.concatenate([hit, clean[:, None]], axis=1).astype(float)
    rows, n = votes.shape
    on_toxic, on_clean = np.full(n, 0.3), np.full(n, 0.01)
    on_toxic[-1], on_clean[-1] = 0.02, 0.9
    first_toxic, first_clean = on_toxic.copy(), on_clean.copy()
    weight, strength = np.ones(n), 2.0
    posterior = np.full(rows, prior)
    for step in range(rounds):
        ratio_on = np.log(on_toxic / on_clean)
        ratio_off = np.log((1 - on_toxic) / (1 - on_clean))
        odds = np.log(prior / (1 - prior)) + (votes * ratio_on + (1 - votes) * ratio_off) @ weight
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        toxic, rest = posterior.sum(), rows - posterior.sum()
        on_toxic = np.clip((posterior @ votes + strength * first_toxic) / (toxic + strength), 1e-4, 1 - 1e-4)
        on_clean = np.clip(((1 - posterior) @ votes + strength * first_clean) / (rest + strength), 1e-5, 1 - 1e-4)
        if step % 5 == 4:
            left = votes - np.outer(posterior, on_toxic) - np.outer(1 - posterior, on_clean)
            spread = np.sqrt((left**2).sum(axis=0)) + 1e-9
            together = np.clip((left.T @ left) / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(together, 0)
            weight = 1 / (1 + np.where(together > 0.1, together, 0).sum(axis=1))
    return posterior, weight


def fit_linear(rows: list[list[int]], target: np.ndarray, size: int, rounds: int = 300, decay: float = 1e-4):
    """Logistic regression on features that are there or not, to the posterior labels, by full-batch gradients."""
    line = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([f for r in rows for f in r], dtype=int)
    weights, bias = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        odds = bias + np.bincount(line, weights=weights[column], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target
        slope = np.append(np.bincount(column, weights=error[line], minlength=size) / len(rows) + decay * weights, error.mean())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def held_out(identifier):
    """Rows whose labels are never looked at."""
    return F.coalesce(F.crc32(identifier.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, how: Learning) -> DataFrame:
    """(text, toxic) of the sample. Its ids are few whatever the corpus, so the texts need no shuffle to meet them."""
    known = labels.filter(F.col(how.id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(how.id_col)))
    known = known.groupBy(F.col(how.id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = written(known.orderBy(F.xxhash64("__id"), "__id").limit(how.sample), "toxic-sample")
    texts = docs.select(F.col(f"`{how.id_col}`").alias("__id"), F.coalesce(F.col(f"`{how.text_col}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select("text", "toxic")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = set()
        for text in batch.column(0).to_pylist():
            before = ""
            for word in _WORD.findall(text.lower()):
                context = zlib.crc32(before.encode())
                found.update((f, context) for f in features(word))
                before = word
        names, contexts = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contexts, pa.int64())], ["feature", "context"])


def _by_chance(t: int, c: int, share: float) -> float:
    """Chance of `t` toxic texts or more among t + c."""
    n = t + c
    logs = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(share) + (n - k) * log(1 - share) for k in range(t, min(n, t + 50) + 1)]
    return sum(exp(x) for x in logs)


def mine(sample: DataFrame, how: Learning) -> list[str]:
    """Words and word families that mark the toxic texts of the sample.

    A feature counts by the different words it stands after, so that a passage in many copies counts once. Every feature of
    the sample that stands after enough of them is tested; only the number of those that pass is bounded, by evidence.
    """
    pairs = sample.filter("toxic = 1").select("text").mapInArrow(_pairs, "feature string, context long").distinct()
    often = pairs.groupBy("feature").agg(F.count("*").alias("n")).filter(F.col("n") >= how.contexts)
    wanted = {r["feature"] for r in often.select("feature").collect()}  # of `sample` texts at most, whatever the corpus

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally[("", toxic)] += 1
                seen = {f for word in set(_WORD.findall(text.lower())) for f in features(word)} & wanted
                tally.update((f, toxic) for f in seen)
        keys = list(tally)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([tally[k] for k in keys], pa.int64())],
            ["feature", "toxic", "n"],
        )

    counts = sample.mapInArrow(counted, "feature string, toxic int, n long").groupBy("feature", "toxic").agg(F.sum("n").alias("n"))
    n = {(r["feature"], r["toxic"]): r["n"] for r in counts.collect()}
    toxic, clean = n.get(("", 1), 0), n.get(("", 0), 0)
    if not toxic or not clean:
        return []
    scored = []
    for f in wanted:
        t, c = n.get((f, 1), 0), n.get((f, 0), 0)
        lift = ((t + 0.1) / toxic) / ((c + 0.5) / clean)
        if t >= how.contexts and lift >= how.lift and _by_chance(t, c, toxic / (toxic + clean)) <= how.doubt:
            scored.append((t * float(np.log(lift)), f))
    return [f for _, f in sorted(scored, key=lambda x: (-x[0], x[1]))[: how.lexicon]]


def learn(docs: DataFrame, labels: DataFrame, how: Learning = Learning()) -> Model:
    """Voters, label model and classifier from the sample; held-out rows are no part of it.

    Without labels of both classes only seed lists and patterns vote.
    """
    sample = _sample(docs, labels, how)
    lexicon = mine(sample, how)
    seeds = {w: k for k, words in enumerate(SEEDS) for w in words}
    model = Model({f: i for i, f in enumerate(lexicon)}, seeds, how.groups)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [model.hits(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], ["hits", "toxic"])

    rows = sample.mapInArrow(found, "hits array<int>, toxic int").groupBy("hits").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    rows = sorted(((list(r["hits"]), r["n"], r["toxic"]) for r in rows.collect()), key=lambda r: r[0])
    hits = [r[0] for r in rows for _ in range(r[1])]
    voter = model.voters()
    matrix = np.zeros((len(hits), 2 * how.groups + len(SEEDS) + len(PATTERNS)), dtype=bool)
    for i, row in enumerate(hits):
        matrix[i, voter[row]] = True
    if not hits:
        hits, matrix = [[]], np.zeros((1, matrix.shape[1]), dtype=bool)
    prior = (sum(r[2] for r in rows) + 1) / (sum(r[1] for r in rows) + 8)
    posterior, _ = label_model(matrix, ~matrix.any(axis=1), min(max(prior, 0.01), 0.5))
    known = sum(r[2] for r in rows)
    extra = [[i] for i in range(len(lexicon), model.size)] if not known else []
    target = np.concatenate([posterior, np.full(len(extra), 0.9)])
    model.weights, model.bias = fit_linear(hits + extra, target, model.size)
    return model


def score(docs: DataFrame, labels: DataFrame, how: Learning = Learning(), model: Model | None = None) -> DataFrame:
    """One row per document: id, whether it is held out, score and prediction. A score depends on the text alone.

    Null and empty texts have the score of a text without a hit; very long texts are read whole. Rows are mapped one by
    one without a shuffle, so repeated rows get equal scores and an empty table none. Columns of other names are not looked at.
    """
    model = model or learn(docs, labels, how)
    source = docs.select(F.col(f"`{how.id_col}`").alias("id"), F.coalesce(F.col(f"`{how.text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([source.schema["id"], T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(model.hits(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    out = source.mapInArrow(scored, schema)
    return out.select(
        F.col("id").alias(how.id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= how.threshold).cast("int").alias("predicted"),
    )
