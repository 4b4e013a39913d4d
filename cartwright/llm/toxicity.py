"""Toxicity by a chain of linear classifiers over hashed words.

Categories are learned in order. The model of a category also sees the logits of the earlier ones:
in training those come from models that have not seen the row (out of fold), in use from the models
of all rows. Training rows are a bounded sample of the labelled ones; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.llm import hashing
from cartwright.llm.common import stored, worker_tables

#: Most labelled rows that are trained on (about; they are drawn by hash of doc_id, half of them toxic
#: ones or as many as there are).
TRAINING_ROWS = 6_000
FOLDS = 4
FEATURE_BITS = 18
#: Leading bytes of a word that are features beside the whole word.
PREFIXES = (4, 6)
LEAST_ROWS = 3
LEAST_RATIO = 0.3
#: Rows that a feature's log ratio is drawn to 0 by.
PRIOR = 10.0
STEPS = 60
RIDGE = 1.0
#: Entries of the training rows that are summed at a time.
BLOCK = 1 << 20
_U = np.uint64

#: Categories of toxic rows that are learned from the labels, the first links of the chain, the narrower first.
GRADES = ("heavy", "explicit")
#: A feature is typical of toxic rows if so many of them hold it, and so many times the share of the clean rows.
TYPICAL_ROWS = 5
TYPICAL_RATIO = 10.0


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, text, lang (empty where unknown), toxic (0 or 1) and weight, about ``rows`` at most.

    Labels without a doc_id or verdict are left out; of several, the largest holds. Toxic and clean ones
    are drawn apart, so rare toxic ones are all there; a row's weight is the number of labels of its kind
    that it stands for. Only the drawn labels, at most about ``rows``, are broadcast to find their texts.
    """
    verdicts = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    toxic = F.col("toxic") > 0
    total, positive = verdicts.agg(F.count("*"), F.count_if(toxic)).first()
    wanted = min(positive, max(rows // 2, rows - (total - positive)))
    shares = [min(1.0, n / max(of, 1)) for n, of in ((wanted, positive), (rows - wanted, total - positive))]
    limit, weight = (
        F.when(toxic, F.lit(a)).otherwise(F.lit(b))
        for a, b in ([int(share * (1 << 40)) for share in shares], [1 / max(share, 1e-12) for share in shares])
    )
    drawn = verdicts.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)) < limit).withColumn("weight", weight)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    found = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(drawn), "doc_id")
    return found.select("doc_id", "text", "lang", toxic.cast("int").alias("toxic"), "weight")


def graded(rows: DataFrame, verdict: str = "toxic") -> DataFrame:
    """``rows`` (row, fold, lang, ``verdict``, features, ...) with heavy and explicit, the grades of a toxic row, 0 or 1.

    Typical features are found among the rows of the other folds, whatever their language. A toxic row is
    explicit if it holds one, and heavy if it holds at least as many as the median explicit row of its language. Without typical features, or toxic rows, nothing is either. ``rows`` is a
    bounded table with one row for each ``row``.
    """
    sizes = {(r.fold, r[verdict]): r["count"] for r in rows.groupBy("fold", verdict).count().collect()}
    found = rows.select("row", "fold", verdict, F.explode("features").alias("feature"))

    def rows_in(fold: int, truth: int) -> Column:
        return F.count_if((F.col("fold") == fold) & (F.col(verdict) == truth)).alias(f"n{truth}_{fold}")

    counts = found.groupBy("feature").agg(*[rows_in(f, truth) for f in range(FOLDS) for truth in (0, 1)])

    def typical(fold: int) -> Column:
        others = [f for f in range(FOLDS) if f != fold]
        clean, toxic = (sum((F.col(f"n{truth}_{f}") for f in others), F.lit(0)) for truth in (0, 1))
        n_clean, n_toxic = (sum(sizes.get((f, truth), 0) for f in others) for truth in (0, 1))
        return (toxic >= TYPICAL_ROWS) & (toxic * F.lit(float(n_clean)) >= (clean + 0.5) * F.lit(TYPICAL_RATIO * n_toxic))

    folds = F.array(*[F.when(typical(f), F.lit(f)) for f in range(FOLDS)])
    kept = counts.select("feature", F.explode(F.array_compact(folds)).alias("fold"))
    hits = found.filter(F.col(verdict) == 1).join(kept, ["feature", "fold"]).groupBy("row").agg(F.count("*").alias("hits"))
    explicit = rows.select("row", "lang").join(hits, "row")
    middle = F.median("hits").over(Window.partitionBy("lang"))
    grades = explicit.select("row", F.lit(1).alias("explicit"), (F.col("hits") >= middle).cast("int").alias("heavy"))
    own = [c for c in rows.columns if c not in GRADES]
    return stored(rows.select(*own).join(grades, "row", "left").na.fill(0, list(GRADES)), "graded")


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every distinct feature of every text, in that order.

    Words are runs of letters (A-Z lowered; any non-ASCII byte counts as a letter); features are
    hashes of a word and of its leading bytes.
    """
    data = _FOLD[data]
    starts, ends, first = hashing.word_spans(data, bounds, _LETTER)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kinds = [hashing.hash_words(data, starts, ends)]
    for n, length in enumerate(PREFIXES, 1):
        kinds.append(hashing.mix(hashing.hash_words(data, starts, np.minimum(ends, starts + length)) + _U(n)))
    found = [(doc << FEATURE_BITS) | (k >> _U(64 - FEATURE_BITS)).astype(np.int64) for k in kinds]
    both = np.unique(np.concatenate(found))
    return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, bounds in hashing.text_chunks(batch["text"]):
            doc, feature = features(data, bounds)
            ends = np.searchsorted(doc, np.arange(high - low + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
            part = batch.slice(low, high - low)
            rest = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part[c] for c in rest], lists], names=[*rest, "features"])


@dataclass
class Linear:
    """Logistic regression over hashed features, dense inputs and a constant."""

    weights: np.ndarray
    dense: np.ndarray
    constant: float

    def logits(self, first: np.ndarray, feature: np.ndarray, dense: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[feature])))
        return sums[first[1:]] - sums[first[:-1]] + dense @ self.dense + self.constant


def _ratios(feature: np.ndarray, row: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Log of how much likelier a feature is in positive rows, drawn to 0 where it is rare."""
    size, share = 1 << FEATURE_BITS, truth.mean()
    positive = np.bincount(feature, truth[row], size)
    negative = np.bincount(feature, minlength=size) - positive
    ratio = (positive + PRIOR * share) / truth.sum() * (len(truth) - truth.sum())
    ratio = np.log(ratio / (negative + PRIOR * (1 - share)))
    ratio[(positive + negative < LEAST_ROWS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    return ratio


def fit(
    first: np.ndarray, feature: np.ndarray, dense: np.ndarray, truth: np.ndarray, weight: np.ndarray | None = None
) -> Linear:
    """Fits a ridge logistic regression whose features are scaled by their log ratios.

    Features that say little (a rare one, or a ratio near 0) keep weight 0. The rarer class counts
    for more, by the square root of the ratio. A one-sided truth gives a constant. A row counts as
    ``weight`` rows; how much a feature says is a ratio within each class, which drawing does not change.
    """
    weight = np.ones(len(truth)) if weight is None else weight
    rows, positive, size = len(truth), float(truth.sum()), 1 << FEATURE_BITS
    if positive in (0.0, float(rows)):
        return Linear(np.zeros(size), np.zeros(dense.shape[1]), 8.0 if positive else -8.0)
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(first))
    ratio = _ratios(feature, row, truth)
    own = np.flatnonzero(ratio)
    width, scale = len(own), ratio[own]
    place = np.full(size, -1, np.int32)
    place[own] = np.arange(width)
    column = place[feature]
    row, column = row[column >= 0], column[column >= 0]
    balance = np.sqrt(weight[truth == 0].sum() / weight[truth > 0].sum())
    importance = np.where(truth > 0, max(balance, 1.0), max(1 / balance, 1.0)) * weight / weight.sum()

    blocks = [slice(a, a + BLOCK) for a in range(0, len(row), BLOCK)]

    def summed(groups: np.ndarray, values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Sums of ``values[at]`` by group, a block of entries at a time."""
        total = np.zeros(size)
        for block in blocks:
            total += np.bincount(groups[block], values[at[block]], size)
        return total

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = summed(row, w[:width] * scale, column, rows) + dense @ w[width:-1] + w[-1]
        chance = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        error = (chance - truth) * importance
        slope = np.concatenate((summed(column, error, row, width) * scale, dense.T @ error, [error.sum()]))
        slope[:-1] += RIDGE / rows * w[:-1]
        cost = (importance * (np.logaddexp(0, z) - truth * z)).sum()
        return cost + RIDGE / rows / 2 * (w[:-1] @ w[:-1]), slope

    w = _descend(loss, np.zeros(width + dense.shape[1] + 1))
    weights = np.zeros(size)
    weights[own] = w[:width] * ratio[own]
    return Linear(weights, w[width:-1], float(w[-1]))


def _descend(loss, w: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halving steps."""
    cost, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, scales = slope.copy(), []
        for move, turn in reversed(past):
            scales.append(move @ direction / (move @ turn))
            direction -= scales[-1] * turn
        if past:
            move, turn = past[-1]
            direction *= move @ turn / (turn @ turn)
        for (move, turn), scale in zip(past, reversed(scales), strict=True):
            direction += move * (scale - turn @ direction / (move @ turn))
        length, down = 1.0, slope @ direction
        if down <= 0:
            return w
        while True:
            new_cost, new_slope = loss(w - length * direction)
            if new_cost <= cost - 1e-4 * length * down:
                break
            length /= 2
            if length < 1e-8:
                return w
        move, turn = -length * direction, new_slope - slope
        if move @ turn > 1e-12:
            past = [*past, (move, turn)][-memory:]
        done = cost - new_cost < 1e-6 * cost
        w, cost, slope = w + move, new_cost, new_slope
        if done:
            return w
    return w


def _trainer(category: str, earlier: int):
    """Per group ``model``: a model of all rows but its fold; the last group's has seen all rows."""

    def train(table: pa.Table) -> pa.Table:
        worker_tables("toxicity")
        number = table["model"][0].as_py()
        order = np.argsort(table["row"].to_numpy())
        lists = table["features"].take(pa.array(order)).combine_chunks()
        table = table.drop_columns("features").take(pa.array(order))
        first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
        feature = lists.flatten().to_numpy()
        del lists
        dense = np.stack([table[f"logit{i}"].to_numpy() for i in range(earlier)], 1) if earlier else np.zeros((len(table), 0))
        truth, fold = table[category].to_numpy().astype(float), table["fold"].to_numpy()
        seen = fold != number
        model = fit(*_rows(first, feature, seen), dense[seen], truth[seen], table["weight"].to_numpy()[seen])
        held = np.flatnonzero(~seen)
        logits = model.logits(*_rows(first, feature, ~seen), dense[held])
        ids = table["row"].to_numpy()[held]
        blob = np.concatenate((model.weights, model.dense, [model.constant])).astype("<f8").tobytes()
        last = number == FOLDS
        return pa.table({
            "row": pa.array([*ids, -1] if last else ids, pa.int64()),
            "logit": pa.array([*logits, 0.0] if last else logits, pa.float64()),
            "model": pa.array([*[None] * len(held), blob] if last else [None] * len(held), pa.binary()),
        })

    return train


def _rows(first: np.ndarray, feature: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(first)
    return np.concatenate(([0], np.cumsum(sizes[chosen]))), feature[np.repeat(chosen, sizes)]


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    threshold: float


def fit_chain(training: DataFrame, categories: tuple[str, ...]) -> Chain | None:
    """The chain for the 0/1 columns ``categories`` of ``training`` (doc_id, text, ..., weight); None if empty.

    Folds are dealt by hash of doc_id. The models of a category are fitted side by side, one task for
    each fold and one for all rows, from the features of the training rows, a bounded table. The
    threshold is the probability of the last category at which its out-of-fold F1 is best. Without a
    column weight, every row counts as one; without lang, all have one language. Where the ``GRADES`` are
    asked for and ``training`` lacks them, they are derived from the last category (see ``graded``).
    """
    given = [c for c in categories if c in training.columns]
    if "weight" not in training.columns:
        training = training.withColumn("weight", F.lit(1.0))
    if "lang" not in training.columns:
        training = training.withColumn("lang", F.lit(""))
    rows = stored(
        training.select("doc_id", "text", "lang", *given, "weight").mapInArrow(
            _featured, ", ".join(["doc_id long", "lang string", *[f"{c} int" for c in given], "weight double", "features array<int>"])
        ).select(
            F.xxhash64("doc_id", "features").bitwiseAND(F.lit((1 << 62) - 1)).alias("row"),
            F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"), "lang", *given,
            "weight", "features",
        ).dropDuplicates(["row"]),
        "training",
    )
    if rows.isEmpty():
        return None
    if len(given) < len(categories):
        rows = graded(rows, categories[-1])
    models: list[Linear] = []
    for n, category in enumerate(categories):
        copies = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
        fitted = stored(
            copies.groupBy("model").applyInArrow(_trainer(category, n), "row long, logit double, model binary"),
            "fitted",
        )
        blob = np.frombuffer(fitted.filter("model IS NOT NULL").select("model").first()[0], "<f8")
        size = 1 << FEATURE_BITS
        models.append(Linear(blob[:size], blob[size : size + n], float(blob[-1])))
        unseen = fitted.filter("row >= 0").select("row", F.col("logit").alias(f"logit{n}"))
        rows = stored(rows.join(unseen, "row"), "training")
    last = rows.select(categories[-1], f"logit{len(categories) - 1}", "weight", "fold").toArrow()
    truth, logit, weight, fold = (column.to_numpy() for column in last.columns)
    # The model of a fold that saw one verdict only is a constant and says nothing about that fold's rows.
    said = np.isin(fold, [f for f in range(FOLDS) if len(np.unique(truth[fold != f])) > 1])
    return Chain(categories, models, _best_threshold(truth, logit, weight, said))


def _best_threshold(
    truth: np.ndarray, logit: np.ndarray, weight: np.ndarray | None = None, said: np.ndarray | None = None
) -> float:
    """The middle between two neighbouring scores that parts the rows with the best F1.

    Rows count by ``weight``, and only those ``said`` are parted. Where none of them is positive, or no
    cut is better than taking every row, the commoner verdict holds for all: above 1 no row is taken, at
    0 every row.
    """
    weight = np.ones(len(truth)) if weight is None else weight
    common = 0.0 if (weight * truth).sum() > weight.sum() / 2 else 2.0
    if said is not None:
        truth, logit, weight = truth[said], logit[said], weight[said]
    if not truth.any():
        return common
    order = np.argsort(-logit, kind="stable")
    truth, logit, weight = truth[order], logit[order], weight[order]
    hits = np.cumsum(truth * weight)
    score = 2 * hits / (np.cumsum(weight) + hits[-1])
    score[:-1][logit[:-1] == logit[1:]] = -1
    best = int(score.argmax())
    if best + 1 == len(logit):
        return common
    return float(1 / (1 + np.exp(-(logit[best] + logit[best + 1]) / 2)))


def _chances(chain):
    """A column function: the categories' probabilities of a text, null like empty."""

    @F.arrow_udf("array<double>")
    def chances(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_tables("toxicity")
        models = chain.value.models
        for texts in batches:
            parts = [np.zeros((0, len(models)))]
            for low, high, data, bounds in hashing.text_chunks(texts):
                doc, feature = features(data, bounds)
                first = np.searchsorted(doc, np.arange(high - low + 1))
                logits = np.zeros((high - low, 0))
                for model in models:
                    more = model.logits(first, feature, logits)
                    logits = np.concatenate((logits, more[:, None]), 1)
                parts.append(logits)
            chance = 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -700, 700)))
            ends = np.arange(0, chance.size + 1, len(models), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(chance.reshape(-1)))

    return chances


def score(docs: DataFrame, chain: Chain | None, categories: tuple[str, ...]) -> DataFrame:
    """``docs`` with p_<category> for each category and rejected (the last one reaches the threshold).

    A null text is scored like an empty one. Without a chain (no labelled rows) the probabilities are 0
    and nothing is rejected. Equal texts get equal scores. Columns of ``docs`` with these names are
    replaced; an empty table gives an empty one. There is no shuffle; the chain, of a fixed size, is
    broadcast, and only texts go to Python.
    """
    added = [f"p_{c}" for c in categories]
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*added, "rejected"}]
    if chain is None:
        return docs.select(*own, *[F.lit(0.0).alias(a) for a in added], F.lit(False).alias("rejected"))
    held = _chances(docs.sparkSession.sparkContext.broadcast(chain))(F.col("text"))
    return docs.select(
        *own, *[held[n].alias(a) for n, a in enumerate(added)], (held[len(added) - 1] >= chain.threshold).alias("rejected")
    )


CATEGORIES = (*GRADES, "toxic")


def toxic_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` scored by a chain for heavy, explicit and toxic that is learned from ``labels``."""
    chain = fit_chain(labelled(docs, labels, rows), CATEGORIES)
    return score(docs, chain, CATEGORIES)


def without_toxic_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that such a chain doesn't reject, all columns as they are, whatever their names.

    Without labelled rows every row stays; a null text is judged like an empty one; an empty table stays empty.
    """
    chain = fit_chain(labelled(docs, labels, rows), CATEGORIES)
    if chain is None:
        return docs
    held = _chances(docs.sparkSession.sparkContext.broadcast(chain))(F.col("text"))
    return docs.filter(held[len(CATEGORIES) - 1] < chain.threshold)
