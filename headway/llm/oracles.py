"""SQL of the queries that SQL can express, over the provided tables."""

from __future__ import annotations

from . import chat, codes, manifest, quality

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"

CHAT = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
    m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) IS NOT DISTINCT FROM role AS again FROM n),
    s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS lines,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS loss,
        sum(length({_ESCAPED.format('text')}) + CASE WHEN again THEN {len(chat.NEXT)}
            ELSE length({_ESCAPED.format('role')}) + {len(chat.START + chat.TEXT + chat.END)} END) AS chars FROM m GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
        CAST(chars AS BIGINT) AS formatted_chars FROM s"""

_SPACE = r"[\x20\x09-\x0D]+"

QUALITY = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, regexp_extract_all(text, '{quality.WORD}') AS w FROM d),
    g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    again AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM
        (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS times FROM g) WHERE times > 1) GROUP BY rid),
    l AS (SELECT *, trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '{_SPACE}', ' ', 'g')) AS norm, len(regexp_extract_all(line, '{quality.WORD}')) AS words
        FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{quality.WORD}')),
    hosts AS (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source),
    often AS (SELECT f.source, f.norm FROM (SELECT source, norm, count(DISTINCT text) AS n_docs FROM l GROUP BY source, norm) f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
        WHERE n_docs > {quality.MIN_DOCS} AND n_docs > {quality.MAX_SHARE} * host_docs),
    gone AS (SELECT rid, count(*) AS lines, CAST(sum(words) AS BIGINT) AS words FROM l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY rid),
    dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
    c AS (SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
        coalesce(gone.lines, 0) AS n_removed_lines, coalesce(gone.words, 0) AS n_removed_words
        FROM d JOIN w USING (rid) LEFT JOIN again USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
    SELECT * EXCLUDE (rid), NOT base_failed AND 100 * (n_words - n_removed_words) >= {quality.LEFT_SHARE} * n_words AND n_words - n_removed_words >= {quality.LEFT_WORDS} AS kept FROM
        (SELECT *, n_words < {quality.FEWEST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM c)"""


def _codes() -> str:
    k, parts = codes.ENTRIES, codes.PARTS
    text = f"""WITH v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    wide AS (SELECT CAST(ceil(max(len(e)) / {parts}.0) AS BIGINT) AS w FROM v),
    x AS (SELECT rid, vec_id, j // w AS p, j % w AS i, CAST(coalesce(floor({codes.SCALE} * CAST(e[j + 1] AS DOUBLE)), 0) AS BIGINT) AS x
        FROM (SELECT rid, vec_id, e, w, unnest(range({parts} * w)) AS j FROM v, wide)),
    b0 AS (SELECT k, p, i, x AS c FROM x JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS k FROM v) USING (rid) WHERE k < {k})"""
    for r in range(codes.ROUNDS + 1):
        text += f""",
    a{r} AS (SELECT rid, p, min(d) AS d, min(d * {k} + k) % {k} AS k FROM (SELECT rid, p, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN b{r} USING (p, i) GROUP BY rid, p, k) GROUP BY rid, p)"""
        if r < codes.ROUNDS:
            text += f""",
    b{r + 1} AS (SELECT k, p, i, coalesce(m, c) AS c FROM b{r} LEFT JOIN (SELECT k, p, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM x JOIN a{r} USING (rid, p) GROUP BY k, p, i) USING (k, p, i))"""
    last = codes.ROUNDS
    return text + f""",
    coded AS (SELECT rid, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY rid)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, i)) FROM b{last}) AS codebooks_sha256 FROM v JOIN coded USING (rid)"""


CODES = _codes()


def _manifest(levels: int = 6) -> str:
    """The trees level by level; enough levels for 16 ** 6 documents of a source and as many sources."""
    n = manifest.FANOUT
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda t: "sha256(concat(" + ", ".join(map(field, ("doc_id", "source", "lang", "n_chars", t))) + "))"
    lower = f"translate(text, '{manifest.UPPER}', '{manifest.UPPER.lower()}')"
    shift = "list_reduce([c] || repeat([CAST(0 AS BIGINT)], 8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT)), lambda a, b: {shift.replace('[c]', '[xor(a, b)]')}), 4294967295)"
    text = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, {leaf('text')} AS leaf,
        CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS tampered FROM documents),
    o AS (SELECT rid, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n, leaf AS digest FROM d)"""

    def tree(name: str, first: str) -> str:
        out = f", {name}0 AS (SELECT g, idx, n, digest FROM {first})"
        for k in range(levels):
            out += f""",
    {name}s{k} AS (SELECT g, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef,
        coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY g, idx // {n} ORDER BY idx)),
    {name}{k + 1} AS (SELECT g, idx // {n} AS idx, (n + {n - 1}) // {n} AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY g, idx // {n}, n)"""
        return out + f""",
    {name}r AS ({' UNION ALL '.join(f'SELECT g, digest FROM {name}{k} WHERE n = 1' for k in range(levels + 1))})"""

    def steps(name: str, place: str, before: str) -> str:
        """Joins the siblings of every level and folds them, for rows with ``cur`` and ``proof``."""
        out = ""
        for k in range(levels):
            now = f"{name}f{k}"
            out += f""",
    {now} AS (SELECT p.* EXCLUDE (cur, proof), CASE WHEN s.g IS NULL THEN cur ELSE sha256(bef || cur || aft) END AS cur, CASE WHEN s.g IS NULL THEN proof ELSE proof || bef || aft END AS proof
        FROM {before} p LEFT JOIN {name}s{k} s ON s.g = p.{place}g AND s.idx = p.{place}idx // {n ** k})"""
            before = now
        return out

    text += tree("a", "o")
    text += ", tops AS (SELECT '' AS g, g AS source_g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, digest FROM ar)"
    text += tree("b", "tops")
    text += ", start AS (SELECT d.doc_id, d.leaf, o.g, o.idx, t.g AS top_g, t.idx AS top_idx, t.digest AS subroot, coalesce(d.tampered, d.leaf) AS cur, '' AS proof FROM d JOIN o USING (rid) JOIN tops t ON t.source_g = o.g)"
    text += steps("a", "", "start") + steps("b", "top_", f"af{levels - 1}")
    return text + f" SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = digest AS verified FROM bf{levels - 1}, br"


MANIFEST = _manifest()

ORACLES: dict[str, str] = {"op3_chat": CHAT, "op11_quality": QUALITY, "op12_codes": CODES, "op13_manifest": MANIFEST}
