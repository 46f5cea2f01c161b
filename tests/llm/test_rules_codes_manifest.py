"""Quality rules, vector codes and the Merkle manifest against brute-force versions and their SQL."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.llm import codes, manifest, quality, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = db.execute(queries.ORACLES[name])
    at = {c[0]: i for i, c in enumerate(cursor.description)}
    assert sorted(at) == columns
    want = sorted((tuple(r[at[c]] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


# ---------------------------------------------------------------- quality rules


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(grams)
    again = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def normal(line):
    line = line.lower().translate(str.maketrans("123456789", "000000000"))
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")


def judged(docs, min_docs, max_share, left_share=50, left_words=25):
    """Rows (text, source) to (base counts, removed lines, removed words, kept)."""
    seen, hosts = collections.defaultdict(set), collections.defaultdict(set)
    for text, source in docs:
        hosts[source].add(text or "")
        for x in (text or "").split("\n"):
            if WORD.search(x):
                seen[source, normal(x)].add(text)
    out = []
    for text, source in docs:
        often = lambda x: len(seen[source, normal(x)]) > min_docs and len(seen[source, normal(x)]) > max_share * len(hosts[source])
        gone = [x for x in (text or "").split("\n") if WORD.search(x) and often(x)]
        n, chars, symbols, dup, again = base(text)
        lost = sum(len(WORD.findall(x)) for x in gone)
        failed = n < 50 or 100 * again > 50 * n
        out.append((n, chars, symbols, dup, again, failed, len(gone), lost, not failed and 100 * (n - lost) >= left_share * n and n - lost >= left_words))
    return out


def rows_of(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_rules_of_planted_boilerplate_repeats_and_edges(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join("w%d" % rng.randrange(4000) for _ in range(n))
    notice = "All rights reserved 2019 by the owners of this site and its many contributors worldwide, terms apply"
    docs = [("\n".join([prose(60), notice.replace("2019", str(1990 + k)).upper() if k % 2 else notice]), "a") for k in range(40)]
    notices = [notice, *[prose(18) for _ in range(3)]]
    docs += [("\n".join([prose(20), *notices]), "a") for _ in range(20)]  # mostly notices: depleted
    docs += [(prose(80), None) for _ in range(30)] + [("\n".join([prose(30), notice, notice]), None) for _ in range(15)]
    same = prose(70)
    docs += [(same, "b")] * 50  # copies of one text count once
    docs += [("a b c " * 40, "b"), ("x y z", "b"), ("", "a"), (" \n\t\x0b", "a"), (None, "a"), (None, None), ("#*$%&|<>\n\n---\n---\r\n" + prose(55), "c"), ("é 😀 ü x " * 30, "c")]
    docs += [(prose(20000) + "\n" + notice, "a"), (" ".join(["one two three"] * 20000), "b")]
    rows = [(k if k % 7 else None, t, "en", s, 1) for k, (t, s) in enumerate(docs)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit("clash"), "line": F.lit(1), "__extra": F.lit(2)}).repartition(5)
    got = quality.rules(df, ["doc_id", "kept", "line", "text"], min_docs=10, max_share=0.2)
    assert got.columns == ["doc_id", "line", "text", *quality.ADDED]
    want = judged(docs, 10, 0.2)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "kept")
    assert rows_of(got, "doc_id", *names) == collections.Counter((r[0], *w) for r, w in zip(rows, want))
    assert any(w[-3] and w[-1] for w in want) and any(w[-3] and not w[5] and not w[-1] for w in want)
    clean = rows_of(got, "doc_id", "text")
    assert all("rights reserved" not in (t or "").lower() for _, t in clean)
    for (text, _), r in zip(docs, rows):
        if "rights" not in (text or "").lower():
            assert clean[r[0], text]


def test_repeated_words_with_few_hash_bits_left(spark):
    """Long runs of windows that repeat far apart, and none at all."""
    rng = random.Random(1)
    words = ["v%d" % rng.randrange(300) for _ in range(30000)]
    texts = [" ".join(words), " ".join(map(str, range(50000))), "a b", "a b c", "a b c a b c", "a a a a", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(quality.repeated_words(F.split("t", " "))).collect()]
    assert got == [base(t)[4] for t in texts]


def test_rules_of_an_empty_table(spark):
    assert quality.rules(spark.createDataFrame([], DOCS), ["doc_id", "text"]).count() == 0


def test_rules_use_no_python(spark):
    plan = queries.op11_quality(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|ArrowEval|Pandas|InArrow", plan) and "NestedLoop" not in plan


# ---------------------------------------------------------------- codes


def coded(rows, entries=64, rounds=2, parts=16):
    """(id, label, vector) to (id, code, error) and the codebooks, by comparing with every entry."""
    good = [r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    if not good:
        return [], None
    width = max(1, -(-max(len(r[2]) for r in good) // parts))
    x = np.zeros((len(good), parts * width), np.int64)
    for k, r in enumerate(good):
        x[k, : len(r[2])] = np.floor(np.array(r[2], np.float32).astype(float) * 256)
    x = x.reshape(len(good), parts, width)
    first = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, list(good[k][2])))[:entries]
    books = x[first].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for k in range(books.shape[1]):
                if (at[:, p] == k).any():
                    m = x[at[:, p] == k, p]
                    books[p, k] = m.sum(0) // len(m)
    at, d = assign()
    return [(r[0], "".join("%02x" % c for c in a), int(e.sum()), r[1]) for r, a, e in zip(good, at, d)], books


def test_codes_with_ties_repeats_ragged_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    vector = lambda n=40: [float(v) for v in np.float32(rng.normal(0, 0.7, n))]
    rows = [(k * 3, k % 5 if k % 11 else None, vector()) for k in range(300)]
    rows += [(900, 1, rows[7][2])] * 3 + [(901, 1, [0.0] * 40), (902, None, [-0.001] * 40), (903, 2, vector(17)), (904, 2, []), (None, 3, vector())]
    rows += [(905, 1, None), (906, 1, [1.0, None]), (907, 1, [float("nan")] * 40), (908, 1, [float("inf")] * 40), (909, 4, [100.0] * 40), (910, 4, [-90.5] * 40)]
    df = spark.createDataFrame([(i, b, v, "x") for i, b, v in rows], "vec_id long, label int, embedding array<float>, code string").repartition(4)
    want, books = coded(rows)
    got = codes.fit(df)
    assert (got == books).all()
    out = codes.with_label_error(codes.encode(df, got, ["vec_id", "label", "code"]))
    sums = collections.Counter()
    for _, _, e, b in want:
        sums[b] += e
    assert rows_of(out, "vec_id", "code", "error", "label_error") == collections.Counter((i, c, e, sums[b]) for i, c, e, b in want)
    assert codes.fingerprint(got) == hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()


def test_few_vectors_and_none(spark):
    kind = "vec_id long, label int, embedding array<float>"
    df = spark.createDataFrame([(1, 1, [0.5, 0.25]), (2, 1, [0.5, 0.25]), (3, None, [1.0, -1.0])], kind)
    books = codes.fit(df)
    out = codes.encode(df, books, ["vec_id"])
    assert {(r["vec_id"], r["error"]) for r in out.collect()} == {(1, 0), (2, 0), (3, 0)}
    back = {r["vec_id"]: r["v"] for r in out.withColumn("v", codes.decoded(F.col("code"), books)).collect()}
    assert np.abs(np.array(back[3][:2]) - [1.0, -1.0]).max() <= 1 / 256
    none = df.where("false")
    assert codes.encode(none, codes.fit(none), ["vec_id"]).count() == 0
    with pytest.raises(Exception, match="beyond"):
        codes.fit(spark.createDataFrame([(1, 1, [1e30])], kind))


def test_the_annulus_holds_the_nearest_entry(spark):
    rng = np.random.default_rng(5)
    for scale in (3, 1000, 1 << 24):
        entries = rng.integers(-scale, scale, (64, 4))
        entries[10] = entries[50]  # ties go to the lower index
        rows = np.vstack([rng.integers(-2 * scale, 2 * scale, (5000, 4)), entries, np.zeros((1, 4), np.int64)])
        at, least = codes.nearest(rows, entries)
        d = ((rows[:, None] - entries[None]) ** 2).sum(-1)
        assert (at == d.argmin(1)).all() and (least == d.min(1)).all()


# ---------------------------------------------------------------- manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hashed(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes):
    """The root and every leaf's siblings (before, after) by level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            a = own[i] // 16 * 16
            path.append(("".join(nodes[a : own[i]]), "".join(nodes[own[i] + 1 : a + 16])))
            own[i] //= 16
        nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def proven(rows):
    """(doc_id, text, lang, source, n_chars) to the rows of op13."""
    leaf = lambda r, text: hashed((r[0], r[3], r[2], r[4], text))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    trees = {}
    for s, rs in by.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = climbed([leaf(r, r[1]) for r in rs])
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = climbed([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(by[s], trees[s][1]):
            path = path + top
            now = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                now = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
            for b, a in path:
                now = digest(b + now + a)
            out.append((r[0], leaf(r, r[1]), trees[s][0], root, digest("".join(b + a for b, a in path)), now, now == root))
    return collections.Counter(out)


def written(spark, rows, folder):
    spark.createDataFrame(rows, DOCS).withColumns({"idx": F.lit(1), "digest": F.lit("x"), "grp": F.lit(0)}).repartition(6).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 1}, {"hot": 1500, "é": 257, "B": 256, None: 3, "": 1, **{f"s{k}": 1 for k in range(40)}}])
def test_manifest_of_sources_of_all_sizes(spark, tmp_path, sizes):
    rows, k = [], 0
    for s, n in sizes.items():
        for i in range(n):
            k += 1
            rows.append((k * 7, f"Text {k} É" if k % 9 else None, None if k % 4 else "en", s, k if k % 5 else None))
    assert rows_of(queries.op13_manifest(spark, written(spark, rows, tmp_path)), *COLUMNS) == proven(rows)


def test_manifest_of_repeated_null_and_long_rows(spark, tmp_path):
    rows = [(None, "A", "en", "a", 1)] * 20 + [(5, "Same", "en", "a", 1)] * 20 + [(5, "Other", None, "a", None), (0, "", "", "", 0), (-3, None, None, None, None), (9, "Ab" * 500_000, "de", "b", 1)]
    got = queries.op13_manifest(spark, written(spark, rows, tmp_path))
    assert rows_of(got, *COLUMNS) == proven(rows)


def test_manifest_of_an_empty_table(spark, tmp_path):
    got = queries.op13_manifest(spark, written(spark, [], tmp_path))
    assert got.count() == 0 and got.columns == list(COLUMNS)


def test_a_changed_leaf_is_the_only_one_that_fails(spark):
    leaves = spark.range(300).select(F.lit("g").alias("grp"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    out = manifest.verified(manifest.manifest(leaves, ["id"]), F.when(F.col("item.id") == 77, F.sha2(F.lit("no"), 256)).otherwise(F.col("digest")))
    assert [r["item"]["id"] for r in out.where("not verified").collect()] == [77]
