"""Secret scans: candidate strings by pattern, false positives removed by a random forest.

Candidates are private key blocks, passwords in addresses, values assigned to a name such as ``password``, bearer and
signed web tokens, and long unbroken strings. A forest trained from labelled findings decides which are secrets, on
length, character transitions, dictionary coverage, the document's path (its source) and the neighbouring words. The
odds of the transitions and the dictionary are counted over all documents (``lexicon``); the trained trees become one
SQL expression, so a scan is a projection: no Python, no shuffle, one pass of the pattern over a text.

Names, blocks, logins and white space before a value may have any length; what follows the secret word of a name has at most 25
characters (``password_of_the_database``), and the scheme of an address at most 21.

Null and empty texts have no findings, and neither has a text without candidates. Findings don't overlap; those of
repeated rows are equal. Without documents the lexicon is empty: no word is known and all transitions are alike. Columns
of the documents named ``findings`` or ``redacted``, or that begin with ``__sec``, give way to those of the scan. U+FDD0,
a noncharacter, is read as U+FDD1, and written so where a text with secrets is redacted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from math import log

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, saved

#: Words of a secret's surroundings, of a harmless string's, of values that stand for one, and of paths of tests and
#: samples (fixed values).
SECRET_WORDS = ("secret", "token", "password", "passwd", "passphrase", "pwd", "credential", "api_key", "access_key", "private_key", "private", "auth", "bearer")
PLAIN_WORDS = ("sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "etag", "revision", "base64", "integrity", "example", "build")
STAND_INS = ("your", "example", "change", "placeholder", "xxx", "dummy", "sample", "test", "insert", "todo", "redacted", "***", "...", "none", "null", "true", "false", "undefined", "required", "optional", "password", "secret")
TEST_PATHS = ("test", "example", "sample", "mock", "fixture", "doc")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-")
#: What a secret's name ends with. A look-behind must be bounded, so the rest of a name has a largest length.
_NAME = "(?i:" + "|".join(w.replace("_", "[ _-]?") for w in SECRET_WORDS) + r"|(?<![A-Za-z])pass)(?:[_-][A-Za-z0-9_-]{0,24}|key|s|[0-9]{1,4}){0,1}"
_RUN = r"[A-Za-z0-9+/_-]{16,}+={0,2}+"
#: An assigned value: a run up to a delimiter, or what has no white space and no quotes, without closing marks.
_VALUE = "(" + _RUN + r"(?=[&<>,;)\]}#.:\s\"'`\\]|$)|[^\s\"'`<>\\]{5,}[^\s\"'`<>\\,;)\]}.:])"
_KINDS = (
    r"()(-----BEGIN (?:[A-Z0-9]{1,12} ){0,4}?PRIVATE KEY(?: BLOCK)?-----(?>(?s:.*?)(?=-----))-----END [A-Z0-9 ]++-----)",
    r"((?<!-)--[A-Za-z0-9][A-Za-z0-9_-]++(?<=" + _NAME + r")[ =][\"']?)" + _VALUE,
    r"((?i:bearer)\s++)([A-Za-z0-9._~+/-]{8,}+={0,2}+)",
    r"([A-Za-z][A-Za-z0-9+.-]{1,20}+://[^\s/:@\"'<>]*+:)([^\s/@\"'<>]{4,}+)(?=@)",
    r"()(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
    r"((?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{2,}+(?=\\?[\"']?\s*+[:=>])(?<=" + _NAME + r")\\?[\"']?\s*+(?:[:=]{1,2}+>?|>)\s*+\\?[\"'`]?)" + _VALUE,
    r"()(?<![+/-])(" + _RUN + ")",
)
#: What the last four kinds begin with, so that most words are read once: more than 15 token characters, or an assignment.
_LIKELY = r"(?=[A-Za-z0-9+/_.-]{1,15}+(?:[A-Za-z0-9+/_.-]|\\?[\"']?\s*+[:=>]))"
#: Every alternative is a pair of groups, what stands before the value and the value. None begins inside a word, which
#: keeps the scan to one look behind at most characters.
CANDIDATE = "(?<![A-Za-z0-9_])(?:" + "|".join(_KINDS[:3]) + "|" + _LIKELY + "(?:" + "|".join(_KINDS[3:]) + "))"
MARK, OTHER = "\ufdd0", "\ufdd1"
_MARKED = "".join(f"${2 * i + 1}" for i in range(len(_KINDS))) + MARK + "".join(f"${2 * i + 2}" for i in range(len(_KINDS))) + MARK
#: Frequent words kept as the dictionary, and their shortest and longest length.
VOCABULARY, SHORTEST, LONGEST = 400, 4, 20
TREES, DEPTH, SEED = 20, 8, 11
FINDINGS = 9000
FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "hex", "turns", "transitions", "distinct", "dictionary", "slashes", "joints",
    "prefix", "stand_in", "code", "path", "secret_word", "plain_word", "assigned", "credential", "address", "key_block",
)


@dataclass(frozen=True)
class Lexicon:
    """The most frequent ``words`` of a corpus, and by pair of letters the log of how much more often the second follows
    the first than it would by chance (26 rows of 26)."""

    words: tuple[str, ...] = ()
    odds: tuple[float, ...] = (0.0,) * 676


def lexicon(docs: DataFrame, text_col: str = "text", words: int = VOCABULARY) -> Lexicon:
    """Counted over the runs of ASCII letters of all texts, lower-cased. Collected: ``words`` rows and one per pair."""
    # outer, because a plain explode adds a filter that splits every text a second time
    runs = docs.select(F.explode_outer(F.split(F.lower(F.col(text_col).cast("string")), "[^a-z]+")).alias("word"))
    counts = saved(runs.where(F.length("word").between(3, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    top = counts.where(F.length("word") >= SHORTEST).orderBy(F.desc("n"), "word").limit(words).collect()
    pairs = counts.select(F.explode_outer(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair"), "n")
    follows = [[1.0] * 26 for _ in range(26)]
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        follows[ord(r["pair"][0]) - 97][ord(r["pair"][1]) - 97] += r["n"]
    forget(counts)
    odds = tuple(log(26 * n / sum(row)) for row in follows for n in row)
    return Lexicon(tuple(r["word"] for r in top), odds)


def _any(words: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(re.escape(w).replace("_", "[ _-]?") for w in words) + ")" if words else "(?!)"


def _prefix_pattern(words: tuple[str, ...]) -> str:
    """A pattern of lower-case words that shares their beginnings, so that few alternatives are tried at a character."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    if not heads:
        return "" if words else "(?!)"
    found = "(?:" + "|".join(c + _prefix_pattern(tuple(rest)) for c, rest in sorted(heads.items())) + ")"
    return found + "?" if "" in words else found


def features(value: Column, chars: Column, before: Column, after: Column, path: Column, known: Lexicon) -> list[Column]:
    """The forest's inputs, in the order of FEATURES, all doubles; ``chars`` are the characters of the value."""
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    per = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    near = F.right(before, F.lit(40))
    letter = lambda i: F.ascii(F.lower(F.get(chars, i))) - 97
    code = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - 2, F.lit(0))), lambda i: F.when(letter(i).between(0, 25) & letter(i + 1).between(0, 25), letter(i) * 26 + letter(i + 1)))
    odds = F.aggregate(
        F.filter(code, lambda c: c.isNotNull()), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda s, c: F.struct((s["sum"] + F.get(F.lit(list(known.odds)), c)).alias("sum"), (s["n"] + 1).alias("n")),
        lambda s: s["sum"] / F.greatest(s["n"], F.lit(1)),
    )
    return [
        n,
        per("[0-9]"),
        per("[A-Z]"),
        per("[a-z]"),
        per("[^A-Za-z0-9]"),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        per("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]"),
        odds,
        F.size(F.array_distinct(chars)) / n,
        1 - F.length(F.regexp_replace(F.lower(value), _prefix_pattern(known.words), "")) / n,
        F.regexp_count(value, F.lit("/")).cast("double"),
        F.regexp_count(value, F.lit("[_-]")) / n,
        flag(value.rlike("^(?:" + "|".join(map(re.escape, PREFIXES)) + ")")),
        flag(value.rlike(_any(STAND_INS)) | value.rlike(r"^(.)\1+$")),
        flag(value.rlike(r"^[$%{<\[]|[(\[]|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$")),
        flag(path.rlike(_any(TEST_PATHS))),
        flag(near.rlike(_any(SECRET_WORDS) + "|(?i)(?<![A-Za-z])pass(?![A-Za-z])")),
        flag(near.rlike(_any(PLAIN_WORDS))),
        flag(near.rlike("[=:>]\\s*\\\\?[\"'`]?$")),
        flag(near.rlike("://[^\\s/@]*:$") & after.startswith("@")),
        flag(after.startswith("@") | after.startswith(".") & after.rlike("^\\.[a-z]") | near.rlike("(?:://|@|www\\.)\\S*$")),
        flag(value.startswith("-----BEGIN ")),
    ]


#: Words of invented findings where a corpus has none (fixed values).
GENERIC = ("user", "account", "name", "file", "path", "data", "value", "index", "update", "delete", "create", "list", "item", "page", "image", "string", "number", "config", "default", "order", "request", "server", "client", "method", "report", "system", "message")


def labelled_findings(spark: SparkSession, known: Lexicon, n: int = FINDINGS) -> DataFrame:
    """``n`` invented findings with their labels: value, before, after, path, label (1 is a secret). Their prose is of the
    lexicon's words."""
    words = known.words or GENERIC
    salt = lambda s: F.sha2(F.concat(F.col("id").cast("string"), F.lit(s)), 256)
    literal = cache(lambda of: F.lit(list(of)))
    pick = lambda s, of: F.element_at(literal(of), (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(len(of))) + 1).cast("int"))
    hex_ = lambda s, size: F.substring(salt(s), 1, size)
    b64 = lambda s, size: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(salt(s), salt(s + "x")))), "[=\r\n]", ""), 1, size)
    safe = lambda s, size: F.translate(b64(s, size), "+/", "xY")
    upper = lambda s, size: F.substring(F.translate(F.upper(b64(s, 60)), "+/018", "AZQXW"), 1, size)
    cut = lambda c, s, least, most: F.substr(c, F.lit(1), F.pmod(F.xxhash64("id", F.lit(s)), F.lit(most - least + 1)).cast("int") + least)
    digits = F.rpad(F.abs(F.xxhash64("id", F.lit("digits"))).cast("string"), 16, "7")
    prose_word = lambda s: pick(s, words)
    name_word = lambda s: F.when(F.pmod(F.xxhash64("id", F.lit(s + "?")), F.lit(2)) == 0, pick(s, words)).otherwise(pick(s, GENERIC))
    prose = F.concat(*[prose_word(s) for s in "abcd"])
    identifier = F.concat_ws("_", name_word("f"), name_word("g"), name_word("h"), pick("i", ("id", "v2", "2024", "count", "by_key")))
    camel = F.concat(name_word("f"), F.initcap(name_word("g")), F.initcap(name_word("h")), pick("j", ("", "2", "Id")))
    path = F.concat(name_word("k"), F.lit("/"), name_word("l"), F.lit("/"), name_word("m"), F.lit("_"), digits.substr(1, 4))
    uuid = F.concat_ws("-", hex_("u", 8), hex_("v", 4), hex_("w", 4), hex_("x", 4), hex_("y", 12))
    filler = F.concat(prose_word("n"), F.lit(" "), prose_word("o"), F.lit(". "), prose_word("p"), F.lit(" "))
    name = pick("q", ("token", "secret", "api_key", "password", "auth_token", "access_key", "pwd", "db_password", "client_secret", "passphrase", "API key", "PASSWORD"))
    named = F.concat(filler, name, pick("r", ("=", ' = "', ": ", ":'", '="', '": "', " := ", " => ")))
    plain = F.concat(filler, pick("q", ("commit ", "sha1 ", "md5: ", "checksum=", 'etag: "', "revision ", "build ", "sha256:", 'digest = "', "uuid=", "integrity: ")))
    end = pick("t", (" ", '"', "\n", "'", ", ", "### ", "", ";", ")"))
    place = pick("place", ("src0", "src7", "web", "forum", "src/main", "wiki", ""))
    tests = pick("place", ("tests/unit", "examples", "docs/sample", "fixtures"))
    mark = pick("mark", ("!", "#", "$", "@", "%", "_", "-", "!!", "?x"))
    chosen = F.concat(F.initcap(prose_word("a")), digits.substr(1, 4), mark)  # a password as people make them
    lower = F.concat(prose_word("a"), prose_word("b"), digits.substr(1, 3), F.when(F.col("id") % 2 == 0, mark).otherwise(""))
    short = F.concat(cut(safe("s", 16), "l", 4, 10), mark, cut(safe("w", 16), "m", 2, 6))
    login = F.concat(filler, pick("u", ("postgres", "mysql", "amqp", "redis", "https", "mongodb+srv", "ftp")), F.lit("://"), pick("w", ("admin", "root", "app", "user", "")), F.lit(":"))
    host = F.concat(F.lit("@"), prose_word("h"), pick("x", (".example.com/", ":5432/db ", "-host/x ")))
    block = F.concat(F.lit("-----BEGIN "), pick("z", ("RSA ", "", "EC ", "OPENSSH ")), F.lit("PRIVATE KEY-----\n"), b64("s", 60), F.lit("\n"), b64("t", 60), F.lit("\n-----END PRIVATE KEY-----"))
    stand_in = pick("s", ("your_secret_token_here", "xxxxxxxxxxxxxxxxxxxxxxxx", "example_password_change", "placeholder-token-value", "changeme_changeme", "********", "undefined", "required", "None,None", "INSERT_TOKEN"))
    call = F.concat(pick("s", ("os.environ[", "getenv(", "${", "process.env.", "config.get(", "{{ ", "$(cat ", "settings.")), F.upper(name_word("g")), pick("x", ("]", ")", "}", "_KEY")))
    kinds = [
        (named, hex_("s", 40), end, place, 1), (named, cut(hex_("s", 64), "l", 16, 36), end, place, 1), (named, hex_("s", 32), end, place, 1),
        (filler, F.concat(F.lit("AKIA"), upper("s", 16)), end, place, 1), (named, cut(b64("s", 60), "l", 16, 48), end, place, 1),
        (filler, F.concat(F.lit("ghp_"), safe("s", 36)), end, place, 1), (F.concat(filler, F.lit("Bearer ")), cut(safe("s", 60), "l", 20, 60), end, place, 1),
        (filler, F.concat(F.lit("eyJ"), F.translate(b64("s", 20), "+/", "_-"), F.lit("."), F.translate(b64("t", 40), "+/", "_-"), F.lit("."), F.translate(b64("u", 43), "+/", "_-")), end, place, 1),
        (named, F.translate(b64("s", 16), "+/", "!#"), end, place, 1), (named, chosen, end, place, 1), (named, lower, end, place, 1), (named, short, end, place, 1), (named, short, end, place, 1),
        (named, cut(safe("s", 20), "l", 10, 15), end, place, 1), (login, chosen, host, place, 1), (login, short, host, place, 1), (login, cut(safe("s", 30), "l", 8, 24), host, place, 1),
        (named, block, end, place, 1), (filler, block, end, place, 1),
        (filler, digits, end, place, 0), (filler, prose, end, place, 0), (filler, identifier, end, place, 0), (filler, camel, end, place, 0),
        (filler, path, end, place, 0), (filler, uuid, end, place, 0), (plain, hex_("s", 40), end, place, 0), (plain, hex_("s", 32), end, place, 0), (plain, b64("s", 44), end, place, 0),
        (named, stand_in, end, place, 0), (login, pick("s", ("password", "secret", "pass", "xxxxx", "yourpassword")), host, place, 0), (named, call, end, place, 0),
        (named, hex_("s", 40), end, tests, 0), (filler, F.concat(F.lit("AKIA"), upper("s", 9), F.lit("EXAMPLE")), end, tests, 0),
        (F.concat(filler, F.lit("data:image/png;base64,")), b64("s", 60), end, place, 0),
        (filler, F.concat(identifier, digits.substr(1, 2)), F.lit("@mail.example.com"), place, 0),
        (F.concat(filler, F.lit("https://")), path, F.lit(" "), place, 0), (filler, F.repeat(pick("s", ("-", "_", "/", "0", "A", "=")), 24), end, place, 0),
        (named, identifier, end, place, 0), (named, prose_word("a"), end, place, 0), (named, F.concat(prose_word("a"), F.lit("_"), prose_word("b")), end, place, 0), (named, camel, end, place, 0),
        (F.concat(filler, F.lit("the bearer ")), F.concat(prose_word("a"), prose_word("b")), F.lit(" "), place, 0),
    ]
    # the parts are written first, and of the kinds only the chosen one is evaluated: both keep the generated code small
    parts: list[Column] = []

    def part(c: Column) -> Column:
        parts.append(c)
        return F.col(f"part{len(parts) - 1}")

    seen = {id(c): part(c) for c in (filler, named, plain, login, host, end, place, tests)}
    kinds = [[seen.get(id(c)) if id(c) in seen else part(c) for c in k[:4]] + [k[4]] for k in kinds]
    base = saved(spark.range(0, n, 1, 4).select("id", *[c.alias(f"part{i}") for i, c in enumerate(parts)]), "parts")
    kind, made = F.pmod("id", F.lit(len(kinds))), F
    for i, (b, v, a, p, y) in enumerate(kinds):
        made = made.when(kind == i, F.struct(v.alias("value"), b.alias("before"), a.alias("after"), p.alias("path"), F.lit(float(y)).alias("label")))
    return base.select(made.alias("f")).select("f.*")


def _tree(lines: list[str], at: int, row: str) -> tuple[str, int]:
    """One tree of a forest's printed form as a SQL expression on the struct ``row``; ``at`` is the line of its root."""
    if m := re.match(r"Predict: (\S+)", lines[at]):
        return f"{m[1]}D", at + 1
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
    left, at = _tree(lines, at + 1, row)
    right, at = _tree(lines, at + 1, row)  # the line between them is Else
    return f"if({row}.{FEATURES[int(m[1])]} <= {float(m[2])!r}D, {left}, {right})", at


class Forest:
    """A trained forest, whose score of a struct of FEATURES is a SQL expression, and the lexicon of its features."""

    def __init__(self, trees: list[str], known: Lexicon):
        self.trees, self.known = trees, known

    def score(self, row: str) -> str:
        """SQL for the share of trees that call the struct ``row`` a secret."""
        votes = [_tree([x.strip() for x in text.splitlines()[1:] if x.strip()], 0, row)[0] for text in self.trees]
        return f"({' + '.join(votes)}) / {len(votes)}"


def described(findings: DataFrame, known: Lexicon) -> DataFrame:
    """The columns FEATURES of labelled findings (value, before, after, path, label), and the label."""
    cols = features(F.col("value"), F.split("value", ""), F.col("before"), F.col("after"), F.col("path"), known)
    return findings.select(*[c.alias(n) for c, n in zip(cols, FEATURES)], "label")


def train(findings: DataFrame, known: Lexicon, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest from labelled findings (value, before, after, path, label); their number bounds the work."""
    seen = saved(described(findings, known), "described")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(seen)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)
    forget(seen)
    return Forest([t.toDebugString for t in model.trees], known)


def scanner(docs: DataFrame, text_col: str = "text") -> Forest:
    """A forest for these documents: their lexicon, and findings labelled in its words."""
    known = lexicon(docs, text_col)
    return train(labelled_findings(docs.sparkSession, known), known)


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Every row with ``findings``: per candidate its start (code points, from 0), value, score and whether it is a
    secret; and ``redacted``, the text with each secret replaced by ``<SECRET>``."""
    text, path = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    # values stand at odd places, what is between them at even ones
    cut = docs.withColumn("__sec_parts", F.split(F.regexp_replace(clean, CANDIDATE, _MARKED), MARK, -1))
    parts = F.col("__sec_parts")
    # the text before a candidate goes on before the candidates before it; ten pieces have 40 characters if there are any
    ends = F.transform(parts, lambda x: F.right(x, F.lit(60)))
    cut = cut.withColumn("__sec_ends", F.when(F.size(parts) > 1, ends))
    context = lambda i: F.right(F.array_join(F.slice("__sec_ends", F.greatest(i - 9, F.lit(1)), F.least(i, F.lit(10))), ""), F.lit(60))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)),
        lambda i: F.struct(context(i).alias("before"), F.get(parts, i).alias("value"), F.split(F.get(parts, i), "").alias("chars"), F.left(F.get(parts, i + 1), F.lit(40)).alias("after"), F.length(F.get(parts, i - 1)).alias("gap")),
    )
    seen = F.transform(pieces, lambda x: F.struct(*[c.alias(n) for c, n in zip(features(x["value"], x["chars"], x["before"], x["after"], path, forest.known), FEATURES)], x["value"].alias("value"), x["gap"].alias("gap")))
    cut = cut.withColumn("__sec_seen", F.when(F.size(parts) > 1, seen))
    rated = F.expr(f"coalesce(transform(__sec_seen, x -> struct(x.gap, x.value, {forest.score('x')} AS score)), array())")
    # starts by running sums, over chunks and then inside each, because every append copies what it extends
    rows = F.col("__sec_rated")
    chunk = F.ceil(F.sqrt(F.size(rows))).cast("int")
    chunks = F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(0), F.size(rows) - 1, chunk), lambda i: F.slice(rows, i + 1, chunk)))
    chars = lambda x: x["gap"] + F.length(x["value"])
    lengths = F.transform(chunks, lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + chars(x)))

    def running(array: Column, first: Column, length, kind: str, made) -> Column:
        empty = F.struct(first.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        return F.aggregate(array, empty, lambda s, x: F.struct((s["at"] + length(x)).alias("at"), F.array_append(s["out"], made(s["at"], x)).alias("out")), lambda s: s["out"])

    def finding(at: Column, x: Column) -> Column:
        return F.struct((at + x["gap"]).alias("start"), x["value"].alias("value"), x["score"].alias("score"), (x["score"] > threshold).alias("secret"))

    kind = "struct<start: int, value: string, score: double, secret: boolean>"
    firsts = running(lengths, F.lit(0), lambda n: n, "int", lambda at, _: at)
    placed = F.flatten(F.zip_with(chunks, firsts, lambda part, at: running(part, at, chars, kind, finding)))
    placed = F.coalesce(placed, F.expr(f"cast(array() as array<{kind}>)"))
    scored = cut.withColumn("__sec_rated", rated).withColumn("findings", placed)
    values = F.transform("findings", lambda f: F.when(f["secret"], F.lit("<SECRET>")).otherwise(f["value"]))
    masked = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.get(values, F.floor(i / 2).cast("int")))), "")
    redacted = F.when(F.exists("findings", lambda f: f["secret"]), masked).otherwise(F.col(text_col))
    return scored.withColumn("redacted", redacted).drop("__sec_parts", "__sec_ends", "__sec_seen", "__sec_rated")


def findings(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: document, start, length, the value's digest (never the value), score, secret."""
    # outer, because a plain explode adds a filter that scans every text a second time
    found = scan(docs.select(id_col, text_col, path_col), forest, text_col, path_col).select(id_col, F.explode_outer("findings").alias("f")).where("f is not null")
    return found.select(
        id_col, F.col("f.start").cast("long").alias("start"), F.length("f.value").cast("long").alias("n_chars"),
        F.sha2("f.value", 256).alias("value_sha256"), F.col("f.score").alias("score"), F.col("f.secret").alias("secret"),
    )
