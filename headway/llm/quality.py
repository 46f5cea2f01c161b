"""Quality rules across documents: lines that many documents of a host share, with DataFrame expressions only.

1. ``measured`` counts words, symbols, repeated lines and repeated three-word windows of every whole text, and keeps the
   hash of every normalised line (lower case, digits as 0, white space as one space) with its number of words.
2. ``frequent_lines`` counts, per host, the different documents that have a line; copies with equal texts count as one
   document, for they are the deduplication's business. Counts are taken in two steps (different texts per line, then
   texts), so that a line of a third of all documents is summed before it is shuffled.
3. ``rules`` removes lines above the limits: those of more than ``MIN_DOCS`` documents and of more than ``MAX_SHARE`` of
   the host's documents. A document is depleted if less than ``LEFT_SHARE`` percent of its words or fewer than
   ``LEFT_WORDS`` words are left, and depleted documents are rejected, as are those that fail the base rules.

Null texts have no words and fail the base rules, as do empty ones. Null hosts are one host of their own. Repeated rows
and rows without an id are rows like others. Lines without a word are neither counted nor removed. A column of ``keep``
that has the name of an added one gives way to it; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: The base rules: fewest words of a document, and the largest percentage of words in repeated windows.
FEWEST_WORDS = 50
MOST_REPEATED = 50
#: Words in a window of which repetitions are counted.
WINDOW = 3
#: A line is removed if more documents of its host have it than both limits allow.
MIN_DOCS = 10
MAX_SHARE = 0.01
#: What must be left of a document: percent of its words, and words.
LEFT_SHARE = 50
LEFT_WORDS = 25
#: A frequent line's counts are dealt to so many tasks each; they are at most 1 / MIN_DOCS of all lines.
SALTS = 16

ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "kept")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _among(text: Column, characters: str) -> Column:
    """How many characters of the text are among these."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of the words stand in a window found twice or more.

    Windows are sorted as hashes with their place in the low bits; neighbours of equal high bits are candidates, and only
    those are sorted again by their words, so that no two different windows count as equal.
    """

    return _once(words, lambda w: _repeated(w, window))


def _repeated(words: Column, window: int) -> Column:
    def at(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(window)]

    def same(rows: Column, key: Callable[[Column], Column]) -> Column:
        return F.filter(rows, lambda x, k: (key(x) == key(F.get(rows, k - 1))) | (key(x) == key(F.get(rows, k + 1))))

    n = F.size(words)
    places = F.sequence(F.lit(0), n - window)
    bits = F.ceil(F.log2(n + 1)).cast("int")
    one = F.lit(1).cast("long")
    high = lambda b: lambda x: F.call_function("shiftrightunsigned", x, b)

    def candidates(b: Column) -> Column:
        packed = F.transform(places, lambda i: F.call_function("shiftleft", F.xxhash64(*at(i)), b).bitwiseOR(i.cast("long")))
        mask = F.call_function("shiftleft", one, b) - 1
        return _once(F.sort_array(packed), lambda s: F.transform(same(s, high(b)), lambda x: x.bitwiseAND(mask).cast("int")))

    def exact(found: Column) -> Column:
        named = F.transform(found, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("w"), i.alias("i")))
        return F.sort_array(_once(F.sort_array(named), lambda s: F.transform(same(s, lambda x: x["w"]), lambda x: x["i"])))

    def covered(found: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + window - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + window).alias("end"))
        return F.aggregate(found, none, step, lambda a: a["n"])

    counted = _once(bits, lambda b: _once(candidates(b), lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(covered(exact(c)))))
    return F.when(n >= window, counted).otherwise(F.lit(0)).cast("long")


def normalised(line: Column) -> Column:
    """A line in lower case, digits as 0, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), r"[\x20\x09-\x0D]+", " "))


def measured(docs: DataFrame, keep: list[str], text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The columns ``keep`` with the base counts, ``__host``, ``__same`` (hash of the text), ``__lines`` (hash and words of
    every line with a word) and ``__row``, written to the shared folder: texts are read once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = _once(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again")))
    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    lines = _once(
        with_word,
        lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"),
            F.transform(x, lambda y: F.struct(F.xxhash64(normalised(y)).alias("line"), F.regexp_count(y, F.lit(WORD)).alias("words"))).alias("all"),
        ),
    )
    chosen = [c for c in keep if c.lower() not in ADDED]
    counted = docs.select(
        *chosen,
        F.col(host_col).alias("__host"),
        F.xxhash64(text).alias("__same"),
        words.alias("__words"),
        (F.length(text) - _among(text, SPACES)).cast("long").alias("word_chars"),
        _among(text, SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.monotonically_increasing_id().alias("__row"),
    )
    table = saved(counted, "measured")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return table.select(
        *chosen, F.col("__words.n").alias("n_words"), "word_chars", "n_symbols", F.col("__lines.again").alias("n_dup_lines"),
        F.col("__words.again").alias("n_repeat_words"), "__host", "__same", F.col("__lines.all").alias("__lines"), "__row",
    ).withColumn("base_failed", failed)


def frequent_lines(measured: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The lines above both limits of their host: ``host``, ``line``, ``n_docs``."""
    texts = measured.select(F.col("__host").alias("host"), F.col("__same").alias("same"), F.explode("__lines.line").alias("line"))
    counts = texts.distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = measured.select(F.col("__host").alias("h"), F.col("__same").alias("s")).distinct().groupBy("h").agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, counts["host"].eqNullSafe(hosts["h"])).where(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line", "n_docs")


def rules(
    docs: DataFrame, keep: list[str], text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
    left_share: int = LEFT_SHARE, left_words: int = LEFT_WORDS,
) -> DataFrame:
    """The columns ``keep`` of every row with ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``n_removed_lines``, ``n_removed_words`` and ``kept``. If
    ``keep`` has the text, it comes back without the removed lines (null stays null)."""
    rows = measured(docs, keep, text_col, host_col)
    # the frequent lines of a host are repeated for every salt, so that a line of a third of all rows meets many tasks
    often = saved(frequent_lines(rows, min_docs, max_share), "frequent").select(
        F.col("host").alias("f_host"), F.col("line").alias("f_line"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt")
    )
    lines = rows.select("__row", "__host", F.explode("__lines").alias("x")).select("__row", "__host", "x.*")
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
    hit = lines.join(often, lines["__host"].eqNullSafe(often["f_host"]) & (lines["line"] == often["f_line"]) & (lines["salt"] == often["f_salt"]))
    gone = hit.groupBy(F.col("__row").alias("g_row")).agg(
        F.count("*").alias("n_removed_lines"), F.sum("words").cast("long").alias("n_removed_words"), F.collect_set("line").alias("__gone")
    )
    joined = rows.join(gone, rows["__row"] == gone["g_row"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_removed_lines", "n_removed_words")})
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (100 * left < left_share * F.col("n_words")) | (left < left_words)
    out = joined.withColumn("kept", ~F.col("base_failed") & ~depleted)
    if text_col in keep:
        stays = lambda x: ~(x.rlike(WORD) & F.array_contains(F.col("__gone"), F.xxhash64(normalised(x))))
        rest = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), stays), "\n")
        out = out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(rest))
    return out.select(*[c for c in keep if c.lower() not in ADDED], *ADDED)
