"""WARC fixity audit with Merkle trees over stored archives.

Pages are written as WARC records into archive files, each record compressed on its own (gzip members one after another, as
WARC files are), so that it has a range of the stored bytes; an index holds the range of each. An audit reads the stored bytes of
every range and hashes them as they are, then builds a tree over each file: groups of records, groups of ``FANOUT`` groups, and so on up to one root. A node hashes its children's numbers, the lengths of
their ranges and their digests in order (lengths fix the offsets, and a lost record doesn't shift those after it).
Replicas are compared root by root, and only the children of mismatching nodes are read further, level by level, down to
the records that differ.

The place of a record in its file is its key's rank, so that a record missing from one replica doesn't move the others:
groups are ranges of a hash of the key. Null and empty pages are records with an empty block; a null url is written as
``urn:none``. Equal rows are stored once and counted. Rows of equal key are one leaf, whose records stand together,
ordered by digest (so losing one of them is found); all rows of one key stand in one file. An empty table has no files.
Other columns are not read. Bytes of an archive that are damaged or lost never fail an audit: a range is hashed as far as it is
there, and records of a file that is gone or can't be read are missing.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, remove, saved, shared_dir

#: Children of a node, levels of groups over the records, and records in a file on average.
FANOUT, LEVELS, FILE_RECORDS = 16, 3, 1024
#: The date that all records carry (a fixed value, so that writing twice gives equal bytes).
DATE = "2024-01-01T00:00:00Z"
_SPACE = FANOUT**LEVELS
#: Keys and digests of rows that a task remembers before a shuffle.
SEEN = 100_000
#: What a record ends with.
END = "\r\n\r\n"
#: Bytes of a record in one gzip member.
BLOCK = 1 << 23


def record(key: Column, url: Column, block: Column) -> Column:
    """A WARC/1.0 resource record, as text whose UTF-8 form are its bytes."""
    body = F.coalesce(block.cast("string"), F.lit(""))
    target = F.coalesce(F.regexp_replace(url.cast("string"), r"\s", "%20"), F.lit("urn:none"))
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    uid = F.concat_ws("-", digest.substr(1, 8), digest.substr(9, 4), digest.substr(13, 4), digest.substr(17, 4), digest.substr(21, 12))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), target,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:uuid:"), uid,
        F.lit(">\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit(END),
    )


def records(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", block_col: str = "html") -> DataFrame:
    """Per page: ``key`` and ``record``."""
    return pages.select(F.col(key_col).cast("string").alias("key"), record(F.col(key_col), F.col(url_col), F.col(block_col)).alias("record"))


def n_files(records: DataFrame) -> int:
    """Files for a table of records; every replica must be dealt with the same number."""
    return max(1, -(-records.count() // FILE_RECORDS))


def member(record: bytes) -> bytes:
    """A record as gzip members, without a date, so that equal records give equal bytes. Blocks stay below 16 MB, so that the
    last byte, the highest of the size, is 0."""
    return b"".join(gzip.compress(record[a : a + BLOCK], 6, mtime=0) for a in range(0, len(record), BLOCK))


def unpacked(stored: bytes) -> bytes:
    """The record of stored bytes, as far as they can be read."""
    out, left = b"", stored
    while left:
        reader = zlib.decompressobj(31)
        try:
            for a in range(0, len(left), 1 << 16):
                out += reader.decompress(left[a : a + (1 << 16)])
                if reader.eof:
                    left = reader.unused_data + left[a + (1 << 16) :]
                    break
            else:
                return out
        except zlib.error:
            return out
    return out


def _packed(batches):
    """Records as members with digest and length. A row whose key and record this task has seen of late goes on without its
    bytes, so that a row that occurs very often isn't shuffled as often; what is left of repeats goes after the shuffle."""
    seen: dict = {}
    for batch in batches:
        digests, lengths, members = [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("record").to_pylist()):
            raw = text.encode()
            raw = raw if raw.endswith(END.encode()) else raw + END.encode()
            known = (key, hashlib.sha256(raw).digest())
            if known in seen:
                d, n, stored = *seen[known], None
            else:
                stored = member(raw)
                d, n = seen[known] = hashlib.sha256(stored).digest(), len(stored)
            digests.append(d)
            lengths.append(n)
            members.append(stored)
        if len(seen) > SEEN:
            seen.clear()
        arrays = [batch.column(c) for c in ("file", "slot", "h", "key", "times")]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(digests, pa.binary()), pa.array(lengths, pa.int64()), pa.array(members, pa.binary())], ["file", "slot", "h", "key", "times", "d", "length", "member"])


PACKED = "file int, slot int, h long, key string, times long, d binary, length long, member binary"


def _placed(records: DataFrame, files: int) -> DataFrame:
    """``file``, ``slot`` (place of its lowest group), ``h``, ``key``, ``times`` and the other columns of rows."""
    times = F.col("times") if "times" in records.columns else F.lit(1).cast("long")
    others = [c for c in records.columns if c not in ("key", "times")]
    rows = records.select("key", F.xxhash64("key", F.lit("warc")).alias("h"), times.alias("times"), *others)
    file, slot = F.pmod("h", F.lit(files)).cast("int").alias("file"), F.pmod(F.shiftright("h", 20), F.lit(_SPACE)).cast("int").alias("slot")
    return rows.select(file, slot, "h", "key", "times", *others)


def _write(rows: DataFrame) -> str:
    """Writes members, sorted by place, one archive per folder ``file=N``, and returns the folder of all. The separator that the
    text writer puts after a row is the last byte of the member."""
    folder = f"{shared_dir(rows.sparkSession)}/archives-{uuid.uuid4().hex}"
    ordered = rows.sortWithinPartitions("file", "slot", "h", F.col("key").asc_nulls_first(), "d")
    body = F.expr("cast(substring(member, 1, length(member) - 1) as string)").alias("body")
    ordered.select(body, "file").write.partitionBy("file").option("lineSep", "\0").option("compression", "none").text(folder)
    return folder


def _index(rows: DataFrame) -> DataFrame:
    """A row per stored record of packed rows: ``file``, ``slot``, ``h``, ``key``, ``offset``, ``length`` and ``times`` (equal
    rows)."""
    once = rows.groupBy("file", "slot", "h", "key", "d", "length").agg(F.sum("times").alias("times"))
    before = Window.partitionBy("file").orderBy("slot", "h", F.col("key").asc_nulls_first(), "d").rowsBetween(Window.unboundedPreceding, 0)
    return saved(once.withColumn("offset", F.sum("length").over(before) - F.col("length")).drop("d"), "index")


def store(records: DataFrame, files: int) -> tuple[str, DataFrame]:
    """Writes archives and returns their folder and the index. A record that doesn't end as records do gets that end."""
    rows = saved(_placed(records.select("key", F.coalesce("record", F.lit("")).alias("record"), *[c for c in records.columns if c == "times"]), files).mapInArrow(_packed, PACKED), "packed")
    index = _index(rows)
    folder = _write(rows.where("member is not null").repartition("file").dropDuplicates(["file", "slot", "h", "key", "d"]))
    forget(rows)
    return folder, index


def copied(folder: str, index: DataFrame, files: int, change) -> tuple[str, DataFrame]:
    """A copy of stored archives whose records (``key``, ``record``) go through ``change``, which keeps keys and may drop rows."""
    return store(change(_read(folder, index, "record").select("key", "record", "times")), files)


def copied_bytes(folder: str, index: DataFrame, change) -> tuple[str, DataFrame]:
    """A copy of stored archives whose stored bytes (``key``, ``member``) go through ``change``, which keeps keys and may drop
    rows. Every archive is copied where it is read."""
    held = _read(folder, index, "member").select("file", "slot", "h", "key", "times", "member")
    rows = change(held).withColumns({"d": F.unhex(F.sha2("member", 256)), "length": F.length("member").cast("long")})
    narrow = rows.select("file", "slot", "h", "key", "times", "d", "length")
    return _write(rows), _index(narrow)


def _cut(what: str | None):
    def run(batches):
        for batch in batches:
            for file, content, ranges in zip(*[batch.column(c) for c in ("file", "content", "ranges")]):
                data = content.as_buffer()
                rows = pa.Table.from_struct_array(ranges.values).combine_chunks()
                parts = [bytes(memoryview(data)[a : a + n]) for a, n in zip(rows["offset"].to_pylist(), rows["length"].to_pylist())]
                columns = [pa.array(np.full(len(parts), file.as_py(), np.int32)), *[rows[c].combine_chunks() for c in INDEXED], pa.array([hashlib.sha256(x).digest() for x in parts], pa.binary())]
                if what == "record":
                    columns.append(pa.array([str(unpacked(x), "utf-8", "replace") for x in parts], pa.string()))
                elif what == "member":
                    columns.append(pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["file", *INDEXED, "d", *[what] * bool(what)])

    return run


INDEXED = ["slot", "h", "key", "offset", "length", "times"]


def read_ranges(folder: str, index: DataFrame, with_text: bool = False) -> DataFrame:
    """The index with ``d``, the digest of the stored bytes of each range (fewer where an archive ends before a range does),
    and the record in them as text, ``record``, if wanted (as far as it can be read)."""
    return _read(folder, index, "record" if with_text else None).withColumn("d", F.lower(F.hex("d")))


def _read(folder: str, index: DataFrame, what: str | None = None) -> DataFrame:
    """``read_ranges`` with digests as bytes, which take half the room in a shuffle; ``what``: ``record`` or ``member`` (the
    stored bytes) beside them."""
    spark = index.sparkSession
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
    files = files.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(folder)
    files = files.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("int").alias("file"), "content")
    ranges = index.groupBy("file").agg(F.collect_list(F.struct(*INDEXED)).alias("ranges"))  # the records of one file
    out = "file int, slot int, h long, key string, offset long, length long, times long, d binary" + {"record": ", record string", "member": ", member binary", None: ""}[what]
    return ranges.join(files, "file").select("file", "content", "ranges").mapInArrow(_cut(what), out)


def leaves(folder: str, index: DataFrame) -> DataFrame:
    """One row per key: ``file``, ``slot``, ``offset``, ``length``, ``rows``, and the ``digest`` of its stored bytes."""
    hashed = _read(folder, index)
    part = lambda x: F.concat_ws(":", F.lower(F.hex(x["d"])), x["times"].cast("string"))
    return hashed.groupBy("file", "slot", "h", "key").agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("d", "times"))), part), ","), 256).alias("digest"),
        F.min("offset").alias("offset"), F.sum("length").alias("length"), F.sum("times").alias("rows"),
    )


def tree(placed: DataFrame) -> list[DataFrame]:
    """The levels of the trees, leaves first and roots last. A node has ``file``, ``node``, ``digest``, ``lo``, ``hi``."""
    def ordered(*by: str) -> Column:
        children = F.sort_array(F.collect_list(F.struct(*by, (F.col("hi") - F.col("lo")).alias("length"), "digest")))
        return F.array_join(F.transform(children, lambda x: F.concat_ws(":", x[by[0]].cast("string"), x["length"].cast("string"), x["digest"])), ",")

    ranged = placed.withColumns({"lo": F.col("offset"), "hi": F.col("offset") + F.col("length")})
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    groups = ranged.groupBy("file", F.col("slot").alias("node")).agg(F.sha2(ordered("h", "key"), 256).alias("digest"), *ends)
    levels = [placed, saved(groups, "groups")]
    for _ in range(LEVELS):
        below = levels[-1].withColumnRenamed("node", "child")
        up = below.groupBy("file", F.floor(F.col("child") / FANOUT).cast("int").alias("node")).agg(F.sha2(ordered("child"), 256).alias("digest"), *ends)
        levels.append(saved(up, "level"))
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that only one side has."""
    side = lambda x, name: x.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("digest").alias(f"{name}_digest"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    both = side(a, "a").join(side(b, "b"), same, "full_outer")
    return both.where(~F.col("a_digest").eqNullSafe(F.col("b_digest"))).select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys])


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """The keys that differ between two replicas' trees: ``key``, ``file``, ``state`` (changed, missing, extra), and
    offset and length in each replica. Children are compared only where their parent differs."""
    bad = saved(_differing(a[-1], b[-1], ["file", "node"]), "bad")
    for level in range(len(a) - 2, 0, -1):
        parents = bad.withColumnRenamed("node", "parent")
        within = lambda x: x.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("int")).join(parents, ["file", "parent"], "left_semi")  # noqa: B023, E731
        bad = saved(_differing(within(a[level]), within(b[level]), ["file", "node"]), "bad")
    slots = bad.withColumnRenamed("node", "slot")
    side = lambda x, n: x.join(slots, ["file", "slot"], "left_semi").select("file", "key", *[F.col(c).alias(f"{n}_{c}") for c in ("digest", "offset", "length")])
    left, right = side(a[0], "a"), side(b[0], "b").withColumnsRenamed({"file": "b_file", "key": "b_key"})
    both = left.join(right, (left["file"] == right["b_file"]) & left["key"].eqNullSafe(right["b_key"]), "full_outer")
    state = F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "extra").when(F.col("a_digest") != F.col("b_digest"), "changed")
    return both.select(
        F.when(F.col("a_digest").isNotNull(), F.col("key")).otherwise(F.col("b_key")).alias("key"),
        F.coalesce("file", "b_file").alias("file"), state.alias("state"), "a_offset", "a_length", "b_offset", "b_length",
    ).where("state is not null")


def replica(records: DataFrame) -> DataFrame:
    """A second copy with damage that depends on the key only: a byte of the payload changed (of the header where the payload
    is empty), the end lost, the record gone."""
    damage = F.conv(F.substring(F.sha2(F.coalesce("key", F.lit("")), 256), 1, 4), 16, 10).cast("int")
    head = F.instr("record", "\r\n\r\n") + 3
    spot = F.when(F.length("record") > head + len(END), head + F.pmod(damage, F.length("record") - head - len(END)) + 1).otherwise(F.lit(6))
    other = lambda c: F.when(c == "x", "y").otherwise("x")
    flipped = F.concat(F.substr("record", F.lit(1), spot - 1), other(F.substr("record", spot, F.lit(1))), F.substr("record", spot + 1, F.length("record")))
    cut = F.expr("substring(record, 1, length(record) div 2)")
    state = F.when(damage % 127 == 1, "changed").when(damage % 127 == 2, "cut").when(damage % 127 == 3, "gone").otherwise("whole")
    return records.withColumn("damage", state).where("damage != 'gone'").select(
        *[c for c in records.columns if c != "record"], F.when(F.col("damage") == "changed", flipped).when(F.col("damage") == "cut", cut).otherwise(F.col("record")).alias("record")
    )


def damaged(members: DataFrame) -> DataFrame:
    """Stored bytes (``key``, ``member``) with damage that depends on the key only: a bit of one byte flipped, the second half lost,
    or the record gone."""
    damage = F.conv(F.substring(F.sha2(F.coalesce("key", F.lit("")), 256), 1, 4), 16, 10).cast("int")
    spot = F.pmod(damage, F.length("member")) + 1
    byte = lambda start, size: F.substr("member", start, size)
    other = F.unhex(F.lpad(F.hex(F.conv(F.hex(byte(spot, F.lit(1))), 16, 10).cast("long").bitwiseXOR(F.lit(4).cast("long"))), 2, "0"))
    flipped = F.concat(byte(F.lit(1), spot - 1), other, byte(spot + 1, F.length("member")))
    state = F.when(damage % 127 == 1, "changed").when(damage % 127 == 2, "cut").when(damage % 127 == 3, "gone").otherwise("whole")
    half = byte(F.lit(1), F.floor(F.length("member") / 2).cast("int"))
    bytes_now = F.when(F.col("damage") == "changed", flipped).when(F.col("damage") == "cut", F.concat(half, F.lit(b"\0"))).otherwise(F.col("member"))
    return members.withColumn("damage", state).where("damage != 'gone'").withColumn("member", bytes_now).drop("damage")


def built(folder: str, index: DataFrame) -> list[DataFrame]:
    """The tree over stored archives, whose bytes are read."""
    return tree(saved(leaves(folder, index), "leaves"))


def discard(folder: str, index: DataFrame) -> None:
    """Deletes stored archives and their index, once nothing reads them."""
    forget(index)
    remove(index.sparkSession, folder)


def fixity(left: tuple[str, DataFrame], right: tuple[str, DataFrame]) -> DataFrame:
    """Audit of two stored replicas (folder and index each), as ``compared`` gives it."""
    return compared(built(*left), built(*right))


def compared(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """Every key of two replicas' trees with ``file``, ``state`` (``ok`` where nothing differs), its offset range and the digest
    of its stored bytes in the first replica."""
    found = audit(a, b)
    extra = found.where("state = 'extra'").select("key", "file", "state", *[F.lit(None).cast(t).alias(c) for c, t in (("offset", "long"), ("length", "long"), ("digest", "string"))])
    marks = found.select(F.col("key").alias("f_key"), "state")
    known = a[0].join(marks, a[0]["key"].eqNullSafe(marks["f_key"]), "left")
    return known.select("key", "file", F.coalesce("state", F.lit("ok")).alias("state"), "offset", "length", "digest").unionByName(extra)
