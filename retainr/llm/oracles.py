"""DuckDB statements for the operators that SQL can express, over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = rf"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, UNNEST(range(1, len(w) - 18)) AS i0 FROM doc),
seqs AS (SELECT doc_id, i0, array_to_string(w[i0:i0 + 19], ' ') AS seq FROM starts),
late AS (SELECT doc_id, i0, ROW_NUMBER() OVER (PARTITION BY seq ORDER BY doc_id, i0) AS nth FROM seqs),
gone AS (SELECT DISTINCT doc_id, UNNEST(range(i0, i0 + 20)) AS pos FROM late WHERE nth > 1),
words AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(range(1, len(w) + 1)) AS pos FROM doc),
rest AS (
    SELECT doc_id, COUNT(*) FILTER (g.pos IS NOT NULL) AS n_removed,
           COALESCE(STRING_AGG(word, ' ' ORDER BY pos) FILTER (g.pos IS NULL), '') AS kept
    FROM words LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(kept, '')) AS kept_sha256
FROM doc LEFT JOIN rest USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(
        translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
long AS (SELECT doc_id, w, UNNEST(range(1, len(w) - 3)) AS i0 FROM doc WHERE len(w) >= 5),
bag AS (
    SELECT DISTINCT doc_id, array_to_string(w[i0:i0 + 4], ' ') AS shingle FROM long
    UNION ALL
    SELECT doc_id, array_to_string(w, ' ') FROM doc WHERE len(w) BETWEEN 1 AND 4),
size AS (SELECT doc_id, COUNT(*) AS n FROM bag GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS n
    FROM bag x JOIN bag y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (
    SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
    WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM doc
    UNION
    SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT doc_id, CAST(COALESCE(ANY_VALUE(size.n), 0) AS BIGINT) AS n_shingles, MIN(other) AS component_id,
       MIN(other) = doc_id AS kept
FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
    SELECT *, SUM(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
                  + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) OVER so_far AS chars,
           LEAD(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last
    FROM turns WINDOW so_far AS (PARTITION BY conv_id ORDER BY turn, role, text
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(STRING_AGG(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(STRING_AGG(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(chars) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

MIX = rf"""
WITH d AS (
    SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
           CAST('0x' || substr(md5('mix-1|' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h
    FROM documents),
s AS (
    SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
           [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(ROW_NUMBER() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
    FROM d GROUP BY source),
-- the level at which the sources that it fills and the shares of the others add up to 150 %
levels AS (
    SELECT a.source,
           (1.5::DOUBLE * (SELECT SUM(source_size) FROM s)
            - COALESCE(SUM(2.0::DOUBLE * b.source_size) FILTER (b.source_size / b.weight < a.source_size / a.weight), 0))
           / SUM(b.weight) FILTER (b.source_size / b.weight >= a.source_size / a.weight) AS level
    FROM s a, s b GROUP BY a.source, a.source_size, a.weight),
final AS (
    SELECT MAX(level) AS level FROM levels),
t AS (
    SELECT source, source_size, LEAST(2.0::DOUBLE * source_size, final.level * weight) AS target FROM s, final),
n AS (
    SELECT *, ROW_NUMBER() OVER (
        PARTITION BY source
        ORDER BY 4 * length(bin(size + 4)) + ((size + 4) >> (length(bin(size + 4)) - 3)) % 4, h % 1024, size, h,
                 CAST(doc_id AS VARCHAR)) - 1 AS i
    FROM d),
r AS (
    SELECT n.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
           CAST('0x' || substr(md5('mix-1|' || COALESCE(n.source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
    FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * LEAST(floor(u + (i + 1) * rate) - floor(u + i * rate), 2) AS BIGINT) AS taken
FROM r
"""

def _vector_codes(rounds: int = 6) -> str:
    """Rounds are written out one after the other; d * 16 + entry orders by distance, then by index."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS MATERIALIZED (
    SELECT r, part, MIN(d * 16 + entry) AS best FROM (
        SELECT r, part, entry, SUM((x - c) * (x - c)) AS d FROM x JOIN book{i} USING (part, pos) GROUP BY r, part, entry)
    GROUP BY r, part)""")
        if i < rounds:
            steps.append(f"""
mean{i} AS (
    SELECT part, CAST(best % 16 AS BIGINT) AS entry, pos, CAST(SUM(x) AS BIGINT) AS s, COUNT(*) AS n
    FROM x JOIN near{i} USING (r, part) GROUP BY ALL),
book{i + 1} AS MATERIALIZED (
    SELECT part, entry, pos, COALESCE((s - (s % n + n) % n) // n, c) AS c FROM book{i} LEFT JOIN mean{i} USING (part, entry, pos))""")
    return f"""
WITH kept AS (
    SELECT vec_id, label, embedding, ROW_NUMBER() OVER (ORDER BY vec_id) AS r FROM embeddings
    WHERE embedding IS NOT NULL AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0),
x AS MATERIALIZED (
    SELECT r, (i - 1) // (m // 8) AS part, (i - 1) % (m // 8) AS pos, x FROM (
        SELECT r, len(embedding) AS m, UNNEST(range(1, len(embedding) + 1)) AS i,
               CAST(floor(4096 * CAST(UNNEST(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)),
book0 AS (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= 16),{",".join(steps)},
codes AS (
    SELECT r, STRING_AGG(printf('%02x', CAST(best % 16 AS INTEGER)), '' ORDER BY part) AS code,
           CAST(SUM(best // 16) AS BIGINT) AS error
    FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(STRING_AGG(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN codes USING (r)
"""


def _pii() -> str:
    """Matches and the gaps between them give positions; a span is (kind number, kind, start, end, score)."""
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    iban = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (f"list_sum([CASE WHEN (len({digits}) - i) % 2 = 1 THEN (2 * CAST({digits}[i] AS INTEGER)) // 10 + (2 * CAST({digits}[i] AS INTEGER)) % 10 "
            f"ELSE CAST({digits}[i] AS INTEGER) END FOR i IN range(1, len({digits}) + 1)]) % 10 = 0")
    turned = "replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4]"
    # letters become two digits; the remainder is taken digit by digit
    numbers = (f"array_to_string([CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END FOR c IN "
               f"string_split({turned}, '')], '')")
    mod97 = (f"list_reduce([CAST(c AS INTEGER) FOR c IN string_split('0' || {numbers}, '')], lambda a, d: (a * 10 + d) % 97) = 1")
    kinds = [
        ("email", email, "TRUE", 0.9, "mail|e-mail|email|contact|write|reach|kontakt|correo|courriel"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
         "len([p FOR p IN string_split(m, '.') IF len(ltrim(p, '0')) > 3 OR CAST('0' || ltrim(p, '0') AS HUGEINT) > 255]) = 0", 0.6,
         "ip|host|server|address|login|adresse|dirección"),
        ("card", r"[0-9](?:[ -]?[0-9])+", f"CASE WHEN len({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE FALSE END", 0.7,
         "card|visa|mastercard|credit|payment|karte|carte|tarjeta"),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"len({digits}) BETWEEN 9 AND 15", 0.7,
         "call|phone|tel|mobile|fax|telefon|téléphone|teléfono"),
        ("iban", iban, mod97, 0.8, "iban|bank|account|konto|compte|cuenta|bic"),
    ]
    parts = []
    for k, (kind, pattern, confirmed, base, context) in enumerate(kinds):
        # an account number stands alone: it is looked for with its neighbours, which are not part of it
        whole = f"(?:^|[^A-Za-z0-9]){pattern}(?:$|[^A-Za-z0-9])" if kind == "iban" else pattern
        lead = "len(regexp_extract(w, '^[^A-Za-z0-9]'))" if kind == "iban" else "0"
        inner = f"regexp_extract(w, '{pattern}')" if kind == "iban" else "w"
        parts.append(f"""
    SELECT doc_id, {k} AS k, '{kind}' AS kind, s, e, {base} + CASE WHEN regexp_matches(
        lower(text[greatest(s - 39, 1):s] || ' ' || text[e + 1:e + 40]), '(^|[^\\p{{L}}\\p{{N}}])({context})($|[^\\p{{L}}\\p{{N}}])')
        THEN 0.1 ELSE 0.0 END AS score
    FROM (SELECT doc_id, text, m, place + {lead} AS s, place + {lead} + len(m) AS e FROM (
        SELECT doc_id, text, {inner} AS m, w,
               COALESCE(list_sum([len(x) FOR x IN gaps[1:i]]), 0) + COALESCE(list_sum([len(x) FOR x IN found[1:i - 1]]), 0) AS place
        FROM (SELECT doc_id, text, found, gaps, i, found[i] AS w FROM (
            SELECT doc_id, text, found, gaps, UNNEST(range(1, len(found) + 1)) AS i FROM (
                SELECT doc_id, text, regexp_extract_all(text, '{whole}') AS found, string_split_regex(text, '{whole}') AS gaps
                FROM doc)))))
    WHERE {confirmed}""")
    counts = ", ".join(f"CAST(COUNT(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in ("email", "ip", "card", "phone", "iban"))
    text = "kind || ':' || s || ':' || e"
    return f"""
WITH doc AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counts},
       sha256(COALESCE(STRING_AGG({text}, ',' ORDER BY k, s) FILTER (k < 4), '')) AS base_sha256,
       COALESCE(STRING_AGG({text}, ',' ORDER BY k, s), '') AS spans, round(MAX(score), 4) AS top_score
FROM doc LEFT JOIN spans USING (doc_id) GROUP BY doc_id
"""


LEXICAL = r"""
WITH words AS (
    SELECT doc_id, UNNEST(regexp_extract_all(
        translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, CAST(SUM(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT COUNT(*) AS N, CAST(SUM(n) AS BIGINT) AS L FROM size),
asked AS (
    SELECT item_id, UNNEST(regexp_extract_all(
        translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
query AS (SELECT item_id, term, COUNT(*) AS qtf FROM asked GROUP BY ALL),
weight AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT N FROM total) + 2 AS DOUBLE) / CAST(2 * COUNT(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM tf WHERE term IN (SELECT term FROM query) GROUP BY term),
scored AS (
    SELECT item_id, doc_id, CAST(SUM(qtf * w * ((1000000000 * tf.tf) // (1000 * tf.tf
           + 12 * (100 - 25 + (25 * size.n * total.N) // total.L)))) AS BIGINT) AS score
    FROM query JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

SQL: dict[str, str] = {
    "op1_substring_dedup": SUBSTRINGS,
    "op5_pii": _pii(),
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op9_chat_format": CHAT,
    "op10_mix_sources": MIX,
    "op11_vector_codes": _vector_codes(),
    "op13_lexical_search": LEXICAL,
}
