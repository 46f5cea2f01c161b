"""MinHash near-duplicates with sequential Bayesian verification.

Every document gets a MinHash signature of its set of word shingles. Documents that agree on all rows of a band
are candidates. A candidate's signatures are compared batch by batch, and it is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below ``MISS``; what is left is verified on the full
sets. Documents of equal sets are one class from the start, so copies never make pairs.

Buckets are resolved in two steps that lose no pair:

1. each member is verified against the bucket's smallest document (at most one pair per row of the bucket);
2. buckets whose other members are not all linked by then are joined to families, and the members of a family are
   compared in blocks inside tasks, which return only the links that join two components.

Links are between classes of equal sets (``node``, a hash of the set), so rows of one id with different texts are
decided each by its own text. An empty text, a null text or a text without words gets a set of size 0, no link, and
its own id as component. Rows with a null id keep their row; they are not linked. Repeated rows give repeated rows.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import binary_array, saved, text_slices

WORDS = 5
THRESHOLD = 0.75
#: Bands times rows of the signature: a pair at the threshold misses all bands with probability 5e-6.
BANDS, ROWS = 32, 4
#: Signature values compared before each decision, and the chance to drop a pair at the threshold in one of them.
BATCH, MISS = 32, 1e-6
#: Documents and characters in a block of a family.
BLOCK, BLOCK_CHARS = 256, 4 << 20
#: Ids that may be broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C2
    x = (x ^ (x >> np.uint64(29))) * _C1
    return x ^ (x >> np.uint64(32))


def _word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words before each text."""
    inside = ~_SPACE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(raw)]
    start[heads] = inside[heads]
    at = np.flatnonzero(start)
    before = np.searchsorted(at, off)
    if not len(at):
        return np.zeros(0, np.uint64), before
    chars = _BYTE[_LOWER[raw[inside]]]
    first = np.flatnonzero(start[inside])
    size = np.diff(np.append(first, len(chars)))
    place = np.arange(len(chars)) - np.repeat(first, size)
    power = _mix(np.arange(1, int(size.max()) + 1, dtype=np.uint64)) | np.uint64(1)
    return _mix(np.add.reduceat(chars * power[place], first) + size.astype(np.uint64)), before


def shingle_sets(column: pa.Array, words: int = WORDS):
    """Yield the sorted distinct 64-bit shingle hashes of each text of an Arrow column."""
    for _, _, raw, off in text_slices(column):
        h, before = _word_hashes(raw, off)
        n = max(0, len(h) - words + 1)
        s = np.zeros(n, np.uint64)
        for j in range(words):
            s = _mix(s * _C1 + h[j : j + n])
        for a, b in zip(before[:-1], before[1:]):
            if b - a >= words:
                yield np.unique(s[a : b - words + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for x in h[a:b]:
                    whole = _mix(np.array([whole * _C1 + x], np.uint64))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> np.ndarray:
    low = np.full(len(_A), 2**32 - 1, np.uint32)
    s = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), 4096):
        np.minimum(low, (_A[:, None] * s[None, i : i + 4096] + _B[:, None]).min(axis=1), out=low)
    return low


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            n = batch.num_rows
            sizes = np.zeros(n, np.int64)
            key = np.zeros((n, 2), np.uint64)
            low = np.zeros((n, BANDS * ROWS), np.uint32)
            with np.errstate(over="ignore"):
                for i, s in enumerate(sets):
                    if len(s):
                        sizes[i] = len(s)
                        key[i] = _mix(s).sum(), _mix(s ^ _C2).sum()
                        low[i] = _signature(s)
                bands = np.zeros((n, BANDS), np.uint64)
                for j in range(ROWS):
                    bands = _mix(bands * _C1 + low[:, j::ROWS].astype(np.uint64) + np.uint64(1))
                sig = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            flat = pa.array(bands.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(key[:, 0].view(np.int64)),
                    pa.array(key[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), flat),
                    binary_array(sig),
                    batch.column(2),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sig", "tag"],
            )

    return run


def tag(text: Column) -> Column:
    """A hash that tells apart the texts of one id."""
    return F.xxhash64(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: set size, 128-bit hash of the set, band keys, the one-byte signature and the text's tag."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tag(F.col(text_col)).alias("tag")).mapInArrow(
        _fingerprints(words),
        "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary, tag long",
    )


def least_matches(threshold: float = THRESHOLD, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """Matches that a pair needs after each batch to stay: with a uniform prior the posterior of the match rate is
    Beta(m + 1, n - m + 1), whose tail above the threshold's match rate is P(Binomial(n + 1, rate) <= m)."""
    rate = threshold + (1 - threshold) / 256  # one-byte values agree by chance
    out = []
    for n in range(batch, BANDS * ROWS + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * rate**m * (1 - rate) ** (n + 1 - m)
        out.append(m)
    return out


def _stays(x: np.ndarray, y: np.ndarray, need: list[int]) -> np.ndarray:
    """Which rows of the signatures x and y pass every batch; a row that fails one is not compared further."""
    at, same = np.arange(len(x)), np.zeros(len(x), np.int32)
    for k, least in enumerate(need):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        same = same + (x[at, cols] == y[at, cols]).sum(axis=1)
        keep = same >= least
        at, same = at[keep], same[keep]
    return at


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _size_ok(n: np.ndarray, m: np.ndarray, hundredths: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= hundredths * np.maximum(n, m)


def _prune(need: list[int], hundredths: int):
    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ok = np.flatnonzero(_size_ok(t["n_a"].to_numpy(), t["n_b"].to_numpy(), hundredths))
            if len(ok):
                x, y = (_sig_matrix(t[c].combine_chunks()) for c in ("sig_a", "sig_b"))
                ok = ok[_stays(x[ok], y[ok], need)]
            yield t.select(["a", "b"]).take(pa.array(ok)).combine_chunks().to_batches()[0] if len(ok) else pa.RecordBatch.from_pydict(
                {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
            )

    return run


def _linked(s: np.ndarray, t: np.ndarray, hundredths: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= hundredths * (len(s) + len(t) - both)


def _verify_pairs(words: int, hundredths: int):
    def run(batches):
        for batch in batches:
            ok = [
                _linked(s, t, hundredths)
                for s, t in zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words))
            ]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify_block(words: int, hundredths: int, need: list[int]):
    """Links between documents of one block, or of two: each joins two components that nothing joined before."""

    def run(key, t):
        ids, label = t["doc_id"].to_numpy(), t["label"].to_numpy()
        order = np.argsort(ids, kind="stable")
        t, ids, label = t.take(pa.array(order)), ids[order], label[order]
        chunk, n = t["chunk"].to_numpy(), t["n_shingles"].to_numpy()
        sig = _sig_matrix(t["sig"].combine_chunks())
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
        parent = {x: x for x in label.tolist()}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets: dict[int, np.ndarray] = {}
        text = t["text"].combine_chunks()

        def whole(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = next(shingle_sets(text.slice(i, 1), words))
            return sets[i]

        across = bool((chunk != chunk[0]).any())
        found = []
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            if across:  # pairs inside a block belong to the block's own group
                j = j[chunk[j] != chunk[i]]
            j = j[(label[j] != label[i]) & _size_ok(n[j], n[i], hundredths)]
            j = j[(bands[j] == bands[i]).any(axis=1)]
            if not len(j):
                continue
            j = j[_stays(np.broadcast_to(sig[i], (len(j), BANDS * ROWS)), sig[j], need)]
            for k in j.tolist():
                p, q = root(int(label[i])), root(int(label[k]))
                if p != q and _linked(whole(i), whole(k), hundredths):
                    parent[max(p, q)] = min(p, q)
                    found.append((int(ids[i]), int(ids[k])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``node`` and text of the documents whose id and tag are in ``ids`` (a saved table): by broadcast up to
    BROADCAST_IDS ids, else by shuffle."""
    ids = ids.select("doc_id", "tag", "node")
    found = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc_id", "tag"])
    return found.select("node", "text").dropDuplicates(["node"])  # equal texts


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    miss: float = MISS,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``class_id`` (smallest id of an equal set), ``component_id``, ``kept``.

    Two documents are linked where their shingle sets have a Jaccard similarity of ``threshold`` or more;
    ``component_id`` is the smallest id that links reach, and ``kept`` marks the document that has it.
    """
    return grouped(docs, id_col, text_col, words, threshold, miss).select("doc_id", "n_shingles", "class_id", "component_id", "kept")


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``tag`` of the text that stays of each group of near duplicates, the one of the smallest id, and of
    each id whose text has no words. Rows with a null id are in no group."""
    rows = grouped(docs, id_col, text_col).where("doc_id is not null")
    return rows.groupBy(F.coalesce("component", "node", F.xxhash64("doc_id", F.lit("empty"))).alias("group")).agg(F.min(F.struct("doc_id", "tag")).alias("one")).select("one.*")


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """The columns of ``near_duplicates`` with each row's ``tag``, ``node`` and ``component`` (of nodes; null if unlinked)."""
    hundredths, need = round(100 * threshold), least_matches(threshold, BATCH, miss)
    prints = saved(fingerprints(docs, id_col, text_col, words), "prints")
    filled = prints.where("n_shingles > 0 and doc_id is not null")
    classes = saved(
        filled.groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "tag", "n_shingles", "bands", "sig")).alias("rep")
        ).withColumn("node", F.xxhash64("set_a", "set_b")),
        "classes",
    )
    reps = classes.select("node", "rep.*")
    rows = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    heads = rows.groupBy("band", "bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members"))
    members = saved(
        rows.join(heads.where("members > 1").drop("members"), ["band", "bucket"]), "members"
    )

    # 1. each member against the head of its bucket
    pairs = members.where("node > head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    side = reps.select("node", "n_shingles", "sig")
    for end in ("a", "b"):
        pairs = pairs.join(side.select(*[F.col(c).alias(x) for c, x in zip(side.columns, (end, f"n_{end}", f"sig_{end}"))]), end)
    likely = saved(pairs.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_prune(need, hundredths), "a long, b long"), "likely")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tag(F.col(text_col)).alias("tag"))
    wanted = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    wanted = saved(reps.select("node", "doc_id", "tag").join(wanted, "node"), "wanted")
    known = _only(texts, wanted)
    near = (
        likely.join(known.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
        .join(known.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
        .select("a", "b", "text_a", "text_b")
    )
    links = saved(near.mapInArrow(_verify_pairs(words, hundredths), "a long, b long"), "links")
    labels = saved(components(links), "labels")

    # 2. buckets whose members besides the head are in several components
    labelled = members.join(labels, "node", "left").withColumn(
        "label", F.coalesce("component", "node")
    )
    open_buckets = (
        labelled.where("node > head")
        .groupBy("band", "bucket")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("hub"))
        .where("low < high")
    )
    left = saved(
        labelled.where("node > head")
        .join(open_buckets.select("band", "bucket", "hub"), ["band", "bucket"])
        .select("node", "label", "hub")
        .distinct(),
        "left",
    )
    family = components(left.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    placed = (
        left.select("node", "label").distinct()
        .join(family.select("node", F.col("component").alias("family")), "node")
        .join(reps.select("node", "doc_id", "tag"), "node")
    )
    ids = saved(placed, "placed")
    rest = _only(texts, ids).join(ids.select("node", "label", "family"), "node").join(reps.drop("doc_id", "tag"), "node")
    sizes = rest.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    blocks = sizes.select(
        "family", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int").alias("blocks")
    )
    grouped = (
        rest.join(blocks, "family")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("chunk", "other"))
        .withColumn("high", F.greatest("chunk", "other"))
        .select("family", "low", "high", "chunk", F.col("node").alias("doc_id"), "label", "n_shingles", "bands", "sig", "text")
    )
    more = grouped.groupBy("family", "low", "high").applyInArrow(_verify_block(words, hundredths, need), "a long, b long")
    joined = saved(components(
        labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    ), "joined")
    smallest = joined.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = joined.join(smallest, "component")
    placed = classes.select("set_a", "set_b", "class_id", "node").join(named, "node", "left")
    return (
        prints.select("doc_id", "tag", "n_shingles", "set_a", "set_b")
        .join(placed, ["set_a", "set_b"], "left")
        .select(
            "doc_id",
            "tag",
            "n_shingles",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("component_id", "class_id", "doc_id").alias("component_id"),
            "node",
            "component",
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )
