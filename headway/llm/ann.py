"""Nearest neighbours with score-aware (anisotropic) quantisation.

Vectors are scaled to unit length, so that the largest inner product is the largest cosine. Each vector is stored as
four-bit codes, one per pair of dimensions. Codebooks and codes minimise a loss in which the part of the residual
that is parallel to the vector weighs more than the rest, because only that part shifts the scores of near queries. A
search scans tables of query-by-code inner products, keeps the best of each block and reranks them by exact cosines in
double precision. Blocks of which something was cut that may be nearer than the query's k-th (its approximate score and
the reach of the block's residuals say so) are scanned again with the exact vectors, inside tasks.

Equal vectors are one entry with their smallest ids. Entries are filed in cells by their nearest centre, and bundles of
neighbouring cells are dealt in blocks. Each query goes to the blocks of the cells nearest to it, where only these cells
are scanned for it; a block is repeated for every ``QUERY_GROUP`` queries that visit it, no more. A query's best are
kept over a whole block before anything is shuffled. How many cells it visits is measured on the fitting sample: so many
that they hold the ``CELL_RECALL`` share of the nearest. Codebooks and centres are fitted on at most about ``FIT_ROWS``
entries (a hash decides); every entry is indexed.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length isn't the
most frequent one. Rows with a null id take no part. Ties go to the smaller id. Repeated rows of one id count once; of
different vectors of one id the smallest (component by component) counts. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import binary_array, saved

#: Entries that fitting reads (expected number), and dimensions and codes of a subspace.
FIT_ROWS, SUB, CODES = 12_000, 2, 16
#: A residual's parallel part matters for queries whose score is at least this (unit vectors).
SCORE_THRESHOLD = 0.2
#: Entries of a cell on average, cells of a bundle, entries of a block at most about; the share of nearest entries that
#: the visited cells hold; candidates kept from a block and in all for reranking.
CELL, BUNDLE, BLOCK, CELL_RECALL, KEEP, RERANK = 4096, 8, 32768, 0.985, 40, 200
#: Queries in one group of a block, and in one step of a scan.
QUERY_GROUP, SLICE = 2048, 64
#: Standard deviations of a residual's part along a random direction that an exact scan allows for.
REACH = 4.0
SEED = 5


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _split(x: np.ndarray) -> np.ndarray:
    """Rows by subspaces by SUB, the last padded with zeros."""
    pad = -x.shape[1] % SUB
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB)


def parallel_weight(dim: int, threshold: float = SCORE_THRESHOLD) -> float:
    """Weight of the parallel residual against the orthogonal one for unit vectors."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def encode(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 3) -> np.ndarray:
    """Codes (rows by subspaces) by coordinate descent on the anisotropic loss; ``books`` is subspaces by CODES by SUB."""
    parts = _split(x)
    n, m = parts.shape[:2]
    codes = np.empty((n, m), np.int64)
    along = np.empty((n, m))
    for j in range(m):
        codes[:, j] = ((parts[:, j, None, :] - books[j]) ** 2).sum(axis=2).argmin(axis=1)
        along[:, j] = (parts[:, j] * (parts[:, j] - books[j][codes[:, j]])).sum(axis=1)
    total = along.sum(axis=1)
    for _ in range(rounds):
        moved = False
        for j in range(m):
            rest = parts[:, j, None, :] - books[j]
            shift = (parts[:, j, None, :] * rest).sum(axis=2)
            loss = (rest**2).sum(axis=2) + (weight - 1) * ((total - along[:, j])[:, None] + shift) ** 2
            best = loss.argmin(axis=1)
            moved |= bool((best != codes[:, j]).any())
            new = shift[np.arange(n), best]
            total += new - along[:, j]
            along[:, j], codes[:, j] = new, best
        if not moved:
            break
    return codes


def fit_books(x: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Codebooks for unit vectors: codes and codewords in turn, each minimising the anisotropic loss."""
    rng = np.random.default_rng(SEED)
    parts = _split(x)
    n, m = parts.shape[:2]
    weight = parallel_weight(x.shape[1])
    books = parts[rng.integers(0, n, CODES)].transpose(1, 0, 2).copy()
    books += rng.normal(0, 1e-4, books.shape)
    for _ in range(rounds):
        codes = encode(x, books, weight, 1)
        along = np.stack([(parts[:, j] * (parts[:, j] - books[j][codes[:, j]])).sum(axis=1) for j in range(m)], axis=1)
        for j in range(m):
            p = parts[:, j]
            other = along.sum(axis=1) - along[:, j]
            square = p[:, :, None] * p[:, None, :]
            left = np.zeros((CODES, SUB, SUB))
            right = np.zeros((CODES, SUB))
            np.add.at(left, codes[:, j], np.eye(SUB) + (weight - 1) * square)
            np.add.at(right, codes[:, j], p + (weight - 1) * (other + (p * p).sum(axis=1))[:, None] * p)
            used = np.bincount(codes[:, j], minlength=CODES) > 0
            books[j][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            along[:, j] = (p * (p - books[j][codes[:, j]])).sum(axis=1)
    return books


def fit_centres(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means centres, in the order of their main direction, so that neighbours in the list are near."""
    rng = np.random.default_rng(SEED + 1)
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    main = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
    return centres[np.argsort(centres @ main, kind="stable")]


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int, recall: float = CELL_RECALL, queries: int = 400) -> int:
    """Cells to visit so that they hold the ``recall`` share of the ``k`` nearest of sample vectors."""
    cell = (x @ centres.T).argmax(axis=1)
    at = np.random.default_rng(SEED + 2).permutation(len(x))[:queries]
    scores = x[at] @ x.T
    scores[np.arange(len(at)), at] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(centres)
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[at] @ centres.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, cell[nearest], axis=1), recall, method="higher")) + 1


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vec`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    limit = F.lit(1.7976931348623157e308)
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit))
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def _indexed(centres: np.ndarray, books: np.ndarray):
    weight = parallel_weight(centres.shape[1])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1)))
            cell = (x @ centres.T).argmax(axis=1)
            codes = encode(x, books, weight)
            rest = _split(x) - books[np.arange(len(books)), codes]
            along = (rest * _split(x)).sum(axis=(1, 2))
            across = np.sqrt(np.maximum(0.0, (rest**2).sum(axis=(1, 2)) - along**2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell.astype(np.int32)), binary_array(pack(codes)), pa.array(np.abs(along)), pa.array(across)], ["entry", "cell", "codes", "along", "across"]
            )

    return run


def _probed(centres: np.ndarray, probes: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.sort(np.argsort(-(_unit(_matrix(batch.column(1))) @ centres.T), axis=1, kind="stable")[:, :probes], axis=1)
            at, bundle, cells = [], [], []
            for i, row in enumerate(near):
                of, first = np.unique(row // BUNDLE, return_index=True)
                at += [i] * len(of)
                bundle += of.tolist()
                cells += [c.tolist() for c in np.split(row, first[1:])]
            again = pa.array(at, pa.int64())
            columns = [batch.column(0).take(again), batch.column(1).take(again), pa.array(bundle, pa.int32()), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["entry", "vec", "bundle", "cells"])

    return run


def _scan(books: np.ndarray, keep: int):
    """Best entries of a block for each query, of the cells it visits, by sums of table values. A row with a null entry has
    the best score that was cut. ``along`` and ``across`` are the block's longest residuals."""

    def run(key, queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return pa.Table.from_pylist([], SCANNED)
        block = block.sort_by([("cell", "ascending"), ("entry", "ascending")])
        entry, cell = block["entry"].to_numpy(), block["cell"].to_numpy()
        packed = np.frombuffer(b"".join(block["codes"].to_pylist()), np.uint8).reshape(len(entry), -1)
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(entry), -1)[:, : books.shape[0]].T.astype(np.intp)
        pairs = [(j, j + 1) if j + 1 < len(books) else (j,) for j in range(0, len(books), 2)]
        joint = [codes[p[0]] * CODES + codes[p[1]] if len(p) == 2 else codes[p[0]] for p in pairs]
        queries = queries.sort_by("entry")
        q, ids = _unit(_matrix(queries["vec"])), queries["entry"].to_numpy()
        visits = [np.array(x) for x in queries["cells"].to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: visits[i].tolist())  # queries of the same cells share a step
        out = []
        for a in range(0, len(order), SLICE):
            step = order[a : a + SLICE]
            every = np.unique(np.concatenate([visits[i] for i in step]))
            rows = np.flatnonzero(np.isin(cell, every)) if len(every) < BUNDLE else np.arange(len(entry))
            if not len(rows):
                continue
            tables = np.einsum("qmd,mcd->qmc", _split(q[step]), books).astype(np.float32)
            score = np.zeros((len(step), len(rows)), np.float32)
            for p, c in zip(pairs, joint):
                t = (tables[:, p[0], :, None] + tables[:, p[1], None, :]).reshape(len(step), -1) if len(p) == 2 else tables[:, p[0]]
                score += t[:, c[rows]]
            for k, i in enumerate(step):
                if len(visits[i]) < len(every):
                    score[k, ~np.isin(cell[rows], visits[i])] = -np.inf
            n = min(keep + 1, len(rows))  # one more, for the query's own entry
            if n < len(rows):
                best = np.argpartition(-score, n, axis=1)[:, : n + 1]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, axis=1), axis=1, kind="stable"), axis=1)
            else:
                best = np.broadcast_to(np.arange(n), score.shape)
            value = np.take_along_axis(score, best, axis=1)
            null = np.zeros(best.shape, bool)
            null[:, n:] = True  # the best that is cut
            ok = np.isfinite(value)
            who = np.broadcast_to(ids[step][:, None], best.shape)
            out.append((who[ok], entry[rows[best]][ok], value[ok], null[ok]))
        if not out:
            return pa.Table.from_pylist([], SCANNED)
        query, found, approx, null = (np.concatenate([o[i] for o in out]) for i in range(4))
        same = [np.full(len(query), x.as_py(), np.int32) for x in key]
        reach = [np.full(len(query), block[c].to_numpy().max()) for c in ("along", "across")]
        return pa.Table.from_arrays([pa.array(query), pa.array(found, mask=null), pa.array(approx), *map(pa.array, same), *map(pa.array, reach)], schema=SCANNED)

    return run


SCANNED = pa.schema([("query", pa.int64()), ("entry", pa.int64()), ("approx", pa.float32()), ("bundle", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("along", pa.float64()), ("across", pa.float64())])


def _scan_exactly(keep: int):
    """Best entries of a block for each query by the vectors themselves; scores that differ by rounding only are equal."""

    def run(_key, queries: pa.Table, block: pa.Table) -> pa.Table:
        found, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if queries.num_rows and block.num_rows:
            block = block.sort_by("held_entry")
            entry, x = block["held_entry"].to_numpy(), _unit(_matrix(block["held_vec"])).T
            ids, q = queries["entry"].to_numpy(), _unit(_matrix(queries["vec"]))
            n = min(keep + 1, len(entry))  # one more, for the query's own entry
            for a in range(0, len(ids), SLICE):
                for i, score in zip(ids[a : a + SLICE], q[a : a + SLICE] @ x):
                    least = np.partition(score, len(entry) - n)[len(entry) - n]
                    above, level = np.flatnonzero(score > least + 1e-12), np.flatnonzero(np.abs(score - least) <= 1e-12)
                    at = np.concatenate([above, level[: n - len(above)]])
                    found.append(entry[at])
                    who.append(np.full(len(at), i))
        return pa.table({"query": np.concatenate(who), "entry": np.concatenate(found)})

    return run


def _exact(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
        # scaling by a power of two changes no digit and keeps the squares finite
        a, b = (x / 2.0 ** np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True))) for x in (a, b))
        score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query", "entry", "score"])


def search(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK,
) -> DataFrame:
    """The ``k`` nearest other rows of each row for which the condition ``is_query`` on ``vec_id`` holds: ``query_id``,
    ``rank`` from 1, ``vec_id`` and ``score`` (cosine), nearest first, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    rows = saved(rows.where(F.size("vec") == dim).withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64("vec", F.lit("2"))), "vectors")
    # the smallest k + 1 ids of equal vectors stand for all of them
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ranked = rows.select("vec_id", "h1", "h2", F.row_number().over(same).alias("nth")).where(F.col("nth") <= k + 1)
    entries = saved(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("entry"), F.first("vec").alias("vec")), "entries")
    members = saved(ranked.join(entries.select("h1", "h2", "entry"), ["h1", "h2"]).select("entry", "vec_id"), "members")
    asked = saved(rows.where(is_query(F.col("vec_id"))).join(entries.select("h1", "h2", "entry"), ["h1", "h2"]).select("vec_id", "entry"), "asked")
    n = entries.count()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], out_schema)

    part = F.pmod(F.xxhash64("entry", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    fitted = entries.where(part <= FIT_ROWS / n).select("vec").toArrow()
    if not fitted.num_rows:
        fitted = entries.limit(CODES).select("vec").toArrow()
    x = _unit(_matrix(fitted["vec"]))
    books, centres = fit_books(x), fit_centres(x, int(min(len(x), max(1, -(-n // CELL)))))
    probes = probes_needed(x, centres, k)

    index = saved(entries.select("entry", "vec").mapInArrow(_indexed(centres, books), "entry long, cell int, codes binary, along double, across double"), "index")
    index = index.withColumn("bundle", F.floor(F.col("cell") / BUNDLE).cast("int"))
    sizes = index.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    vec_of = entries.select("entry", "vec")
    probed = saved(asked.select("entry").distinct().join(vec_of, "entry").mapInArrow(_probed(centres, probes), "entry long, vec array<double>, bundle int, cells array<int>"), "probed")
    visits = probed.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / QUERY_GROUP).cast("int").alias("parts"))
    dealing = sizes.join(visits, "bundle")  # a row per bundle
    block = F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int").alias("block")
    blocks = index.join(dealing, "bundle").select("bundle", block, "parts", "entry", "cell", "codes", "along", "across")
    dealt = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    searched = probed.join(dealing, "bundle").select(
        "bundle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int").alias("part"), "entry", "vec", "cells"
    )
    key = ["bundle", "block", "part"]
    found = saved(
        searched.groupBy(*key).cogroup(dealt.select(*key, "entry", "cell", "codes", "along", "across").groupBy(*key))
        .applyInArrow(_scan(books, KEEP), "query long, entry long, approx float, bundle int, block int, part int, along double, across double"),
        "found",
    )
    best = Window.partitionBy("query").orderBy(F.desc("approx"), "entry")
    ranked_found = saved(found.where("entry is not null").withColumn("nth", F.row_number().over(best)), "ranked")
    short = ranked_found.where(F.col("nth") <= rerank + 1).select("query", "entry")

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(vec_of.withColumnsRenamed({"entry": "query", "vec": "a"}), "query").join(vec_of.withColumnRenamed("vec", "b"), "entry")
        return both.select("query", "entry", "a", "b").mapInArrow(_exact, "query long, entry long, score double")

    def neighbours(exact: DataFrame) -> DataFrame:
        pairs = asked.withColumnsRenamed({"vec_id": "query_id", "entry": "query"}).join(exact, "query").join(members, "entry").where("vec_id != query_id")
        nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)

    exact = saved(scored(short), "exact")
    kth = neighbours(exact).groupBy("query_id", "query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(-1.0).alias("score")).groupBy("query").agg(F.min("score").alias("kth"))

    # what was cut may be nearer: a residual shifts a score s by s times its parallel part, and by its other part times
    # the cosine of that with the rest of the query, which is about one over the root of the dimensions
    cut = found.where("entry is null").unionByName(ranked_found.where(F.col("nth") > rerank + 1).drop("nth"))
    cut = cut.groupBy("query", *key).agg(F.max("approx").alias("approx"), F.max("along").alias("along"), F.max("across").alias("across"))
    off = min(1.0, REACH / max(1, dim - 1) ** 0.5)
    level = F.greatest("kth", F.lit(0.0))
    reach = level * F.col("along") + off * F.col("across") * F.sqrt(F.greatest(F.lit(0.0), 1 - level * level)) + 1e-5
    again = cut.join(kth, "query", "left").where(F.col("kth").isNull() | (F.col("approx") + reach >= F.col("kth")))
    again = saved(again.select(F.col("query").alias("entry"), *key), "again")
    held = blocks.select("bundle", "block", "entry").join(again.select(*key).distinct(), ["bundle", "block"]).join(vec_of, "entry")
    # both sides come from the same tables, so one has other names
    held = held.select(*[F.col(c).alias(f"held_{c}") for c in (*key, "entry", "vec")])
    more = again.join(vec_of, "entry").groupBy(*key).cogroup(held.groupBy(*[f"held_{c}" for c in key])).applyInArrow(_scan_exactly(k + 1), "query long, entry long")
    more = more.join(exact.select("query", "entry"), ["query", "entry"], "left_anti")
    return neighbours(exact.unionByName(scored(more))).select("query_id", "rank", "vec_id", "score")
