"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles; the weight of a shingle is how often it occurs
times an inverse document frequency. Improved consistent weighted sampling draws from each weighted
set samples that agree between two sets with the probability of their weighted Jaccard similarity.
Bands of samples put similar texts in common buckets; what meets there is verified by the exact
weighted Jaccard similarity, and verified links are joined to classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm import hashing
from cartwright.llm.common import row_key, stored

#: Document frequencies are counted for hashed shingles, in a table of this size for any corpus.
FREQUENCY_BITS = 18
#: How much more a shingle can weigh than one that every document has: edits of a copy in a large
#: group of copies are rare shingles among common ones and must not outweigh them.
IDF_SPREAD = 0.5
#: Members of a bucket whose samples are compared with each other in one task.
BLOCK = 4096
#: Samples of each text of a shared bucket, by which pairs are picked for verification.
SAMPLES = 512
#: Sample comparisons held at once.
COMPARED = 1 << 24
_U = np.uint64


class Shingles:
    """The distinct shingles of a chunk of texts, by text and hash, with their counts.

    A text of fewer words than a shingle is one shingle; a text without words has none.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, size: int):
        starts, ends, first = hashing.word_spans(data, bounds)
        words = hashing.hash_words(data, starts, ends)
        counts = np.diff(first)
        doc_of = np.repeat(np.arange(len(counts)), counts)
        whole = hashing.window_hashes(words, size)
        inside = doc_of[: len(whole)] == doc_of[size - 1 :][: len(whole)]
        hashes, docs = [whole[inside]], [doc_of[: len(whole)][inside]]
        for n in range(1, size):
            short = np.flatnonzero(counts == n)
            if len(short):
                hashes.append(hashing.window_hashes(words, n)[first[short]])
                docs.append(short)
        doc, value = np.concatenate(docs), np.concatenate(hashes)
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        at = np.flatnonzero(new)
        self.doc, self.hash = doc[at], value[at]
        self.count = np.diff(np.append(at, len(doc)))
        self.texts = len(counts)
        self.bucket = (self.hash >> _U(64 - FREQUENCY_BITS)).astype(np.int64)

    def prints(self) -> list[bytes]:
        """128 bits of each text's multiset of shingles."""
        out = np.zeros((self.texts, 2), _U)
        mixed = hashing.joined(self.hash, self.count.astype(_U))
        np.add.at(out[:, 0], self.doc, mixed)
        np.add.at(out[:, 1], self.doc, hashing.mix(mixed ^ _U(0x5851F42D4C957F2D)))
        return [row.tobytes() for row in out]


def _frequencies(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, texts = np.zeros(1 << FREQUENCY_BITS, np.int64), 0
        for batch in batches:
            for _, _, data, bounds in hashing.text_chunks(batch["text"]):
                s = Shingles(data, bounds, size)
                texts += s.texts
                once = np.unique(s.doc << FREQUENCY_BITS | s.bucket) & ((1 << FREQUENCY_BITS) - 1)
                table += np.bincount(once, minlength=len(table))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(table[used], texts))], names=["bucket", "n"]
        )

    return count


def inverse_frequencies(docs: DataFrame, size: int, spread: float = IDF_SPREAD) -> np.ndarray:
    """The weight of a shingle by its hash's leading bits: 1 + spread * ln(N / df) / ln(buckets).

    df is the number of documents with a shingle in the bucket. The table has the same size for any
    corpus, so it can be collected and broadcast; all documents are counted.
    """
    counted = (
        docs.select("text").mapInArrow(_frequencies(size), "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    bucket, n = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    total = int(n[bucket < 0].sum())
    table = np.zeros(1 << FREQUENCY_BITS)
    table[bucket[bucket >= 0]] = n[bucket >= 0]
    share = np.maximum(table, 1) / max(total, 1)
    return 1 - spread * np.log(np.minimum(share, 1)) / (FREQUENCY_BITS * math.log(2))


def _gamma_quantiles(n: int) -> np.ndarray:
    """Values of the Gamma(2, 1) distribution at the middles of n equal shares."""
    share = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - np.exp(-middle) * (1 + middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low


_RATE = _gamma_quantiles(1 << 16).astype(np.float32)
_LOG_SCALE = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)


def samples(s: Shingles, log_idf: np.ndarray, n: int) -> np.ndarray:
    """n samples of each text with shingles, as 32-bit values: rows follow the texts' order.

    For shingle weight w, with r and c from Gamma(2, 1) and b from [0, 1) drawn by hash of shingle
    and sample: t = floor(ln w / r + b), and the shingle of smallest ln c - r (t - b + 1) is taken.
    That value stands for shingle and t. Only sums, products and tables are used, so any machine
    gets the same bits.
    """
    log_count = np.array([0.0, *(math.log(i) for i in range(1, int(s.count.max(initial=1)) + 1))], np.float32)
    log_weight = log_count[s.count] + log_idf[s.bucket]
    first = np.flatnonzero(np.diff(s.doc, prepend=-1))
    out = np.empty((len(first), n), np.float32)
    if not len(first):
        return out.view(np.uint32)
    for k in range(n):
        draw = hashing.mix(s.hash + _U((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        rate = _RATE[draw & _U(0xFFFF)]
        shift = (draw >> _U(40)).astype(np.float32) * np.float32(2**-24)
        step = np.floor(log_weight / rate + shift)
        value = _LOG_SCALE[(draw >> _U(16)) & _U(0xFFFF)] - rate * (step - shift + np.float32(1))
        out[:, k] = np.minimum.reduceat(value, first)
    return out.view(np.uint32)


def _signatures(size: int, bands: int, rows: int, idf):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_idf = np.log(idf.value).astype(np.float32)
        for batch in batches:
            for low, high, data, bounds in hashing.text_chunks(batch["text"]):
                s = Shingles(data, bounds, size)
                drawn = samples(s, log_idf, bands * rows).astype(_U).reshape(-1, bands, rows)
                keys = np.tile(np.arange(bands, dtype=_U), (len(drawn), 1))
                for r in range(rows):
                    keys = hashing.joined(keys, drawn[:, :, r])
                lengths = np.zeros(high - low, np.int64)
                lengths[np.unique(s.doc)] = bands
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()),
                    pa.array(keys.reshape(-1).view(np.int64)),
                )
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["id"], pa.array(s.prints(), pa.binary()), lists],
                    names=["doc_id", "id", "print", "bands"],
                )

    return sign


def _texts_of(size: int, idf):
    """The rows whose text has the wanted print, with a byte of each of SAMPLES samples."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_idf = np.log(idf.value).astype(np.float32)
        for batch in batches:
            for low, high, data, bounds in hashing.text_chunks(batch["text"]):
                s = Shingles(data, bounds, size)
                part = batch.slice(low, high - low)
                same = [a == b for a, b in zip(s.prints(), part["print"].to_pylist(), strict=True)]
                short = np.zeros((high - low, SAMPLES), np.uint8)
                drawn = samples(s, log_idf, SAMPLES).astype(_U)
                short[np.unique(s.doc)] = (hashing.mix(drawn) >> _U(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part["print"], part["text"], part["bands"], pa.array([x.tobytes() for x in short], pa.binary())],
                    names=["print", "text", "bands", "samples"],
                ).filter(pa.array(same, pa.bool_()))

    return keep


def weighted_jaccard(a: Shingles, b: Shingles, idf: np.ndarray) -> np.ndarray:
    """Similarity of each text of ``a`` with the text of ``b`` in the same place; 1 for two empty ones."""
    doc, value = np.concatenate((a.doc, b.doc)), np.concatenate((a.hash, b.hash))
    weight = np.concatenate((a.count * idf[a.bucket], b.count * idf[b.bucket]))
    order = np.lexsort((value, doc))
    doc, value, weight = doc[order], value[order], weight[order]
    pair = np.flatnonzero((doc[1:] == doc[:-1]) & (value[1:] == value[:-1]))
    least = np.bincount(doc[pair], np.minimum(weight[pair], weight[pair + 1]), a.texts)
    total = np.bincount(doc, weight, a.texts)
    return np.where(total > 0, least / np.maximum(total - least, 1e-300), 1.0)


def _verified(size: int, threshold: float, idf):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                _, high, data, bounds = next(hashing.text_chunks(batch["text_a"].slice(low)))
                a = Shingles(data, bounds, size)
                other = batch["text_b"].slice(low, high).cast(pa.large_binary())
                edges = np.concatenate(([0], np.cumsum([len(x.as_py()) for x in other])))
                b = Shingles(np.frombuffer(b"".join(other.to_pylist()), np.uint8), edges, size)
                similar = np.flatnonzero(weighted_jaccard(a, b, idf.value) >= threshold)
                yield batch.select(["a", "b"]).take(pa.array(low + similar))
                low += high

    return verify


def _linked(pairs: DataFrame, texts: DataFrame, size: int, threshold: float, idf) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    first = texts.select(F.col("print").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("print").alias("b"), F.col("text").alias("text_b"))
    return (
        pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
        .mapInArrow(_verified(size, threshold, idf), "a binary, b binary")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes; label is the smallest node that can be reached.

    Each step takes the smallest label next to a node, then that label's own label; the steps are as
    many as the logarithm of the longest path. Nothing is collected but whether a label changed.
    """
    edges = stored(
        links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "edges"
    )
    least = F.least("a", F.min("b")).alias("label")
    labels = stored(edges.groupBy("a").agg(least).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        )
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = stored(
            stepped.join(jump, "next").select(
                "node", F.least("next", "beyond").alias("label"),
                (F.least("next", "beyond") != F.col("label")).alias("changed"),
            ),
            "labels",
        )
        labels = moved.drop("changed")
        if moved.filter("changed").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), kept (that one).

    For the settings and the classes see ``_classes``. Other columns of ``docs`` are left out.
    """
    return _classes(docs, **settings).drop("id")


def without_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows whose doc_id has no kept row. Spark picks the join by the size of
    the list of such doc_ids."""
    gone = _classes(docs, **settings).groupBy("id").agg(F.max("kept").alias("kept")).filter("NOT kept")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(row_key().alias("id"), own).join(gone.select("id"), "id", "left_anti")
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def _classes(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 16, rows: int = 4,
    spread: float = IDF_SPREAD,
) -> DataFrame:
    """doc_id, id, class_id and kept of every row.

    Two documents are linked if the weighted Jaccard similarity of their shingles is at least
    ``threshold``; a class is what links connect. Documents with the same multiset of shingles are
    one node, so copies are never paired with each other; texts without words are one class. Where
    the smallest doc_id has several rows, each is marked kept. A null doc_id comes last and
    stands for a hash of the text in class_id. An empty table gives an empty one.

    First all members of a bucket are compared with its most central one (the one whose buckets are
    largest), not with each other: a group of copies of any size costs a pair per bucket and member.
    Where a bucket then still holds several classes, the samples of its members outside the main
    class are compared with those of all members, in blocks inside tasks, and the pairs that agree
    often enough are verified: no link between different texts of a bucket is left out. With 16 bands
    of 4 samples a pair of similarity 0.8 shares a bucket with probability 0.9998.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("id"), "text")
    idf = spark.sparkContext.broadcast(inverse_frequencies(keyed, size, spread))
    signed = stored(
        keyed.mapInArrow(
            _signatures(size, bands, rows, idf),
            "doc_id long, id long, print binary, bands array<long>",
        ),
        "signatures",
    )
    nodes = signed.filter("size(bands) > 0").groupBy("print").agg(
        F.min("id").alias("id"), F.first("bands").alias("bands")
    )
    member = nodes.select("print", F.explode("bands").alias("key"))
    live = member.join(_shared(member), "key")
    central = live.groupBy("print").agg(F.sum("n").alias("central"))
    live = stored(live.select("key", "print").join(central, "print"), "buckets")
    wanted = live.select("print").distinct().join(nodes, "print")
    texts = stored(
        keyed.select("id", "text").join(wanted, "id").select("print", "text", "bands")
        .mapInArrow(_texts_of(size, idf), "print binary, text string, bands array<long>, samples binary")
        .dropDuplicates(["print"]),
        "texts",
    )
    links = stored(_linked(_to_the_centre(live), texts, size, threshold, idf), "links")
    labels = components(links)
    apart = stored(_still_apart(live, labels, texts), "apart")
    pairs = stored(_likely_pairs(apart, threshold), "pairs")
    links = stored(_linked(pairs, texts, size, threshold, idf), "links")
    labels = _relabelled(labels, links)
    classes = signed.select("doc_id", "id", "print").join(
        labels.withColumnRenamed("node", "print"), "print", "left"
    ).withColumn("print", F.coalesce("label", "print"))
    smallest = classes.groupBy("print").agg(F.min("id").alias("class_id"))
    return classes.join(smallest, "print").select(
        "doc_id", "id", "class_id", (F.col("id") == F.col("class_id")).alias("kept")
    )


def _to_the_centre(live: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's most central member with every other."""
    centre = live.groupBy("key").agg(F.max(F.struct("central", "print")).alias("top"))
    return stored(
        live.join(centre.select("key", F.col("top.print").alias("a")), "key")
        .select("a", F.col("print").alias("b")).filter("a != b").distinct(),
        "pairs",
    )


def _still_apart(live: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """The members of the buckets that still hold several classes: key, print, class, main (whether
    it is the class of the bucket's centre), n (members of the bucket), bands and samples."""
    classed = live.join(labels.withColumnRenamed("node", "print"), "print", "left").select(
        "key", "print", "central", F.xxhash64(F.coalesce("label", "print")).alias("class")
    )
    buckets = classed.groupBy("key").agg(
        F.max(F.struct("central", "print", "class")).alias("top"), F.count(F.lit(1)).alias("n"),
        F.min("class").alias("least"), F.max("class").alias("most"),
    ).filter("least != most")
    return (
        classed.join(buckets.select("key", "n", F.col("top.class").alias("main")), "key")
        .select("key", "print", "class", (F.col("class") == F.col("main")).alias("main"), "n")
        .join(texts.select("print", "bands", "samples"), "print")
    )


def _agreeing(least: int):
    """Pairs of different classes whose samples agree ``least`` times, at least one of them outside
    the bucket's main class, from all rows of a block or pair of blocks of a bucket. A pair comes from
    the first of the buckets it shares: it is of two classes in each of them, so each compares it."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")]).combine_chunks()
        key, i, j, own, group = (rows[c].to_numpy() for c in ("key", "i", "j", "own", "class"))
        main = rows["main"].to_numpy()
        samples = np.frombuffer(b"".join(rows["samples"].to_pylist()), np.uint8).reshape(len(rows), -1)
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        prints = rows["print"].combine_chunks()
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        edges = np.append(np.flatnonzero(new), len(rows))
        for low, high in zip(edges, edges[1:], strict=False):
            part = np.arange(low, high)
            left = part[~main[part]]
            step = max(1, COMPARED // (len(part) * samples.shape[1]))
            for at in range(0, len(left), step):
                x = left[at : at + step]
                agree = (samples[x][:, None, :] == samples[part][None, :, :]).sum(2, dtype=np.int32)
                across = (own[x][:, None] != own[part][None, :]) if i[low] != j[low] else True
                once = main[part][None, :] | (x[:, None] < part[None, :])
                hit = (agree >= least) & across & once & (group[x][:, None] != group[part][None, :])
                a, b = np.nonzero(hit)
                a, b = x[a], part[b]
                shared = (bands[a] == bands[b]).argmax(1)
                here = bands[a, shared] == key[low]
                if here.any():
                    yield pa.RecordBatch.from_arrays(
                        [prints.take(pa.array(a[here])), prints.take(pa.array(b[here]))], schema=schema
                    )

    return compare


def _likely_pairs(apart: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that may be similar, from the samples of the members of each bucket.

    Samples are compared inside tasks and only agreeing pairs leave them; the least number of
    agreements lies 3.5 standard deviations below that of a pair at the threshold. A bucket of more
    than BLOCK members is dealt over blocks, and each pair of blocks is a task's group.
    """
    least = math.floor(SAMPLES * threshold - 3.5 * math.sqrt(SAMPLES * threshold * (1 - threshold)))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = apart.withColumn("own", F.pmod(F.xxhash64("print"), blocks)).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")
    )
    grouped = dealt.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "print",
        "class", "main", "bands", "samples",
    ).repartition("key", "i", "j")
    found = grouped.mapInArrow(_agreeing(least), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more links: only the labels that these join are walked."""
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    joined = links.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")
    )
    steps = components(joined)
    onward = steps.select(F.col("node").alias("label"), F.col("label").alias("next"))
    old = labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return stored(old.unionByName(steps.join(labels.select("node"), "node", "left_anti")), "labels")


def _shared(member: DataFrame) -> DataFrame:
    """The buckets with two members or more, and how many they have."""
    return member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
