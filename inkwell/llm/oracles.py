"""DuckDB SQL for those queries of this subpackage that SQL can express."""

_RULES = {
    1: "n_words < 10",
    2: "100 * n_repeat_words > 20 * n_words",
    4: "10 * n_symbols > n_words",
    8: "2 * n_dup_lines > n_lines",
    16: "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    32: "n_words > 0 AND 5 * n_shouted > 2 * n_words",
    64: "n_words > 0 AND 2 * n_letter_words < n_words",
}

_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM hit) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
       FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_shouted,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words
  FROM w LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, CAST(""" + " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for v, c in _RULES.items()) + r""" AS BIGINT) AS fail_bits FROM m)
"""
OP1 = (
    _LEDGER
    + """SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
)

#: Each policy as a whole (no rule left out), and without each of its rules.
ABLATIONS = (
    _LEDGER
    + """, r(rule, bit) AS (VALUES ('too_few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('word_length', 16), ('shouting', 32), ('few_letters', 64)),
p AS (SELECT 'base' AS policy, 1 AS version, rule, bit FROM r WHERE bit IN (1, 2) UNION ALL SELECT 'strict', 1, rule, bit FROM r WHERE bit NOT IN (16, 64) UNION ALL SELECT 'strict', 2, rule, bit FROM r),
c AS (SELECT policy, version, '' AS without_rule, sum(bit) AS mask FROM p GROUP BY policy, version
      UNION ALL SELECT a.policy, a.version, a.rule, coalesce(sum(b.bit), 0) FROM p a LEFT JOIN p b ON a.policy = b.policy AND a.version = b.version AND a.rule <> b.rule GROUP BY a.policy, a.version, a.rule)
SELECT policy, CAST(version AS INTEGER) AS version, without_rule, count(*) AS n_docs, count(*) FILTER (WHERE (fail_bits & CAST(mask AS BIGINT)) = 0) AS n_kept FROM b, c GROUP BY policy, version, without_rule
"""
)


#: The SQL's own list of templates and its own threshold: it takes nothing from the module it checks.
OP3 = r"""
WITH raw(license, template) AS (VALUES
  ('apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
  ('apache-2.0', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
  ('mit', 'Released under the MIT License.'),
  ('mit', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
  ('gpl-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
  ('gpl-2.0', 'This work is licensed under the GNU General Public License, version 2.'),
  ('gpl-3.0', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
  ('lgpl-3.0', 'This work is licensed under the GNU Lesser General Public License, version 3.'),
  ('agpl-3.0', 'This work is licensed under the GNU Affero General Public License, version 3.'),
  ('mpl-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
  ('bsd-3-clause', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:'),
  ('cc-by-nc-4.0', 'Licensed under CC BY-NC 4.0.'),
  ('cc-by-4.0', 'Licensed under CC BY 4.0.'),
  ('cc-by-sa-4.0', 'Licensed under CC BY-SA 4.0.'),
  ('cc-by-nc-4.0', 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.'),
  ('cc-by-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License.')),
tw AS (SELECT license, string_split(trim(regexp_replace(lower(template), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM raw),
t AS (SELECT license, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS template FROM tw),
c AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g') AS clean FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, unnest(list_concat(list_concat(string_split(clean, chr(10)), list_filter(string_split_regex(clean, '\n *\n'), lambda p: contains(p, chr(10)))),
         CASE WHEN regexp_matches(clean, '\n *\n') THEN [clean] ELSE [] END)) AS segment FROM c),
w AS (SELECT doc_id, list_filter(string_split_regex(segment, '[ \n]+'), lambda x: x <> '') AS ws FROM s),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM w WHERE len(ws) >= 2),
m AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(grams, template)) / (len(grams) + len(template)) AS dice FROM g, t)
SELECT doc_id, license, round(max(dice), 6) AS best, count(*) AS n_segments FROM m WHERE dice >= 0.8 GROUP BY doc_id, license
"""


OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
raw AS (SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM d)),
c AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pos) AS k FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (
  SELECT rid, doc_id, k, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS e FROM c WINDOW o AS (PARTITION BY rid ORDER BY k)),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, e ORDER BY doc_id, k) AS nth FROM w WHERE e IS NOT NULL),
gone AS (SELECT DISTINCT rid, unnest([k, k + 1, k + 2]) AS k FROM f WHERE nth > 1),
runs AS (SELECT rid, count(*) AS n_removed, count(*) FILTER (WHERE k - before > 1 OR before IS NULL) AS n_runs
         FROM (SELECT rid, k, lag(k) OVER (PARTITION BY rid ORDER BY k) AS before FROM gone) GROUP BY rid),
kept AS (SELECT raw.rid, string_agg(raw.line, chr(10) ORDER BY raw.pos) AS text FROM raw LEFT JOIN c ON raw.rid = c.rid AND raw.pos = c.pos
         LEFT JOIN gone ON c.rid = gone.rid AND c.k = gone.k WHERE gone.k IS NULL GROUP BY raw.rid),
n AS (SELECT rid, count(*) AS n_lines FROM c GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN runs USING (rid) LEFT JOIN kept USING (rid)
"""


#: The same with stretches of one or two lines that hold 30 words.
OP4_CONTENT = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
raw AS (SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM d)),
c AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pos) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (
  SELECT rid, doc_id, k, nw, line AS a, lead(line) OVER o AS b, lead(nw) OVER o AS nb, lead(line, 2) OVER o AS e FROM c WINDOW o AS (PARTITION BY rid ORDER BY k)),
s AS (SELECT rid, doc_id, k, 3 AS n, a, b, e FROM w WHERE e IS NOT NULL
      UNION ALL SELECT rid, doc_id, k, 2, a, b, '' FROM w WHERE b IS NOT NULL AND nw + nb >= 30
      UNION ALL SELECT rid, doc_id, k, 1, a, '', '' FROM w WHERE nw >= 30),
f AS (SELECT *, row_number() OVER (PARTITION BY n, a, b, e ORDER BY doc_id, k) AS nth FROM s),
gone AS (SELECT DISTINCT rid, unnest(range(k, k + n)) AS k FROM f WHERE nth > 1),
runs AS (SELECT rid, count(*) AS n_removed, count(*) FILTER (WHERE k - before > 1 OR before IS NULL) AS n_runs
         FROM (SELECT rid, k, lag(k) OVER (PARTITION BY rid ORDER BY k) AS before FROM gone) GROUP BY rid),
kept AS (SELECT raw.rid, string_agg(raw.line, chr(10) ORDER BY raw.pos) AS text FROM raw LEFT JOIN c ON raw.rid = c.rid AND raw.pos = c.pos
         LEFT JOIN gone ON c.rid = gone.rid AND c.k = gone.k WHERE gone.k IS NULL GROUP BY raw.rid),
n AS (SELECT rid, count(*) AS n_lines FROM c GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN runs USING (rid) LEFT JOIN kept USING (rid)
"""


_WORDS5 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = rf"""
WITH i AS (SELECT item_id, ws FROM (SELECT item_id, {_WORDS5} AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k:k + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS5} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT rid, k, iw.n AS n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM h) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)
"""


OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, k, array_to_string(ws[k:k + 12], ' ') AS g FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM d WHERE len(ws) >= 13)),
f AS (SELECT rid, k, doc_id > min(doc_id) OVER (PARTITION BY g) AS later FROM w),
gone AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(k, k + 13)) AS p FROM f WHERE later) GROUP BY rid),
gp AS (SELECT DISTINCT rid, unnest(ps) AS p FROM gone),
kw AS (SELECT u.rid, string_agg(u.w, ' ' ORDER BY u.p) AS kept FROM (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d) u LEFT JOIN gp ON gp.rid = u.rid AND gp.p = u.p WHERE gp.p IS NULL GROUP BY u.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kw USING (rid)
"""


#: The SQL's own patterns and scope, as the contract words them; lengths are filters.
_ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_USER = "(" + "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("username", "user", "login")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
_ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
_SCOPE = 200


def op9() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def kind(name: str, rank: int, pattern: str, group: int, keep: str) -> str:
        p = quote(pattern)
        return rf"""SELECT rid, '{name}' AS kind, {rank} AS rank, start, start + length(m) AS "end" FROM (
  SELECT rid, m, v, sum(length(gap)) OVER o + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT rid, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS gap FROM (
    SELECT rid, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {group}) AS vs, string_split_regex(text, {p}) AS gaps FROM d WHERE regexp_matches(text, {p})))
  WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE {keep}"""

    parts = " UNION ALL ".join(
        (
            kind("assign", 0, _ASSIGN, 2, "length(v) >= 12"),
            kind("access", 1, "AKIA[A-Z0-9]+", 0, "length(m) >= 18"),
            kind("hex", 2, "[0-9a-f]+", 0, "length(m) >= 16"),
            kind("secret", 3, "[A-Za-z0-9+/_=-]+", 0, "length(v) >= 20 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"),
            kind("short", 4, _ASSIGN, 2, "length(v) BETWEEN 6 AND 11"),
            kind("user", 5, _USER, 0, "true"),
            kind("endpoint", 6, _ENDPOINT, 0, "true"),
        )
    )
    near = lambda kinds, scope: f"""EXISTS (SELECT 1 FROM p b WHERE b.rid = a.rid AND b.kind IN ({kinds}) AND a.start - {scope} < b."end" AND b.start < a."end" + {scope})"""
    ids, values = "'access', 'user', 'endpoint'", "'assign', 'secret', 'short'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS MATERIALIZED ({parts}),
k AS (SELECT * FROM p a WHERE kind IN ('assign', 'access', 'hex')
  OR (kind = 'secret' AND NOT {near("'assign', 'access', 'hex', 'short', 'endpoint'", 0)} AND {near(ids, _SCOPE)})
  OR (kind = 'short' AND {near(ids, _SCOPE)}) OR (kind = 'user' AND {near(values, _SCOPE)})
  OR (kind = 'endpoint' AND {near(values, _SCOPE)} AND {near("'access', 'user'", _SCOPE)})),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


#: Bytes as pairs of hexadecimal digits; a window of 200 bytes is 400 of them.
OP10 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, k, md5_number(substring(h, 2 * k + 1, 400)) AS g FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS k FROM d WHERE length(h) >= 400)),
again AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT rid, k, k - row_number() OVER (PARTITION BY rid ORDER BY k) AS run FROM w WHERE g IN (SELECT g FROM again)),
stretch AS (SELECT rid, min(k) AS lo, max(k) + 200 AS hi FROM hit GROUP BY rid, run),
marked AS (SELECT rid, lo, hi, CASE WHEN lo <= max(hi) OVER (PARTITION BY rid ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM stretch),
spans AS (SELECT rid, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY lo) AS s FROM marked) GROUP BY rid, s),
cuts AS (SELECT rid, hi AS a, lead(lo, 1) OVER (PARTITION BY rid ORDER BY lo) AS b, lo FROM spans),
pieces AS (SELECT rid, a, b FROM cuts UNION ALL SELECT rid, 0, min(lo) FROM spans GROUP BY rid),
kept AS (SELECT p.rid, string_agg(substring(h, 2 * a + 1, coalesce(2 * b, length(h)) - 2 * a), '' ORDER BY a) AS h FROM pieces p JOIN d USING (rid) GROUP BY p.rid),
n AS (SELECT rid, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a string's UTF-8 bytes."""
    table = []
    for row in range(256):
        for _ in range(8):
            row = (row >> 1) ^ (0xEDB88320 if row & 1 else 0)
        table.append(row)
    byte = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: 16 * (instr('0123456789ABCDEF', hex(encode({text}))[i]) - 1) + instr('0123456789ABCDEF', hex(encode({text}))[i + 1]) - 1)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), lambda a, b: xor(({table}::BIGINT[])[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT)"


_FIELD = lambda c, value=None: f"coalesce(octet_length(encode(CAST({value or c} AS VARCHAR))) || ':' || CAST({value or c} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(c, text if c == "text" else None) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The trees are recursions over levels; every leaf then folds its own list of siblings.
OP11 = f"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS rid, *, coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0, false) AS touched FROM documents),
f AS (SELECT rid, doc_id, coalesce('1' || lang, '0') AS key, {_LEAF("text")} AS leaf, CASE WHEN touched THEN {_LEAF(_LOWERED.format("text"))} ELSE {_LEAF("text")} END AS changed FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM f),
nodes(key, level, pos, h, n) AS (
  SELECT key, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT key, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY key, level, pos // 8, n),
subroots AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, h, n) AS (
  SELECT 0, pos, h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
sides AS (
  SELECT key, level, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY key, level, pos // 8 ORDER BY pos)),
top_sides AS (
  SELECT level, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tops WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)),
steps AS (
  SELECT rid, s.level, s.l, s.r FROM leaves JOIN sides s ON s.key = leaves.key AND s.pos = leaves.pos // CAST(8 ** s.level AS BIGINT)
  UNION ALL
  SELECT rid, 1000 + t.level, t.l, t.r FROM leaves JOIN subroots ON subroots.key = leaves.key JOIN top_sides t ON t.pos = subroots.pos // CAST(8 ** t.level AS BIGINT)),
listed AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level) AS k FROM steps),
proofs AS (SELECT rid, string_agg(l || r, '' ORDER BY k) AS proof, max(k) AS last FROM listed GROUP BY rid),
folds(rid, k, h) AS (
  SELECT rid, 0::BIGINT, changed FROM f
  UNION ALL
  SELECT folds.rid, listed.k, sha256(listed.l || folds.h || listed.r) FROM folds JOIN listed ON listed.rid = folds.rid AND listed.k = folds.k + 1),
root AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroots.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folds.h AS folded_root, folds.h = root AS verified
FROM leaves JOIN subroots ON subroots.key = leaves.key CROSS JOIN root LEFT JOIN proofs ON proofs.rid = leaves.rid JOIN folds ON folds.rid = leaves.rid AND folds.k = coalesce(last, 0)
"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWERED.format("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST, rid DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
df AS (SELECT rid, unnest(ws) AS f FROM d UNION ALL SELECT rid, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM d),
bf AS (SELECT unnest(ws) AS f FROM b UNION ALL SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM b),
dc AS (SELECT rid, f, count(*) AS n FROM df GROUP BY ALL), bc AS (SELECT f, count(*) AS n FROM bf GROUP BY ALL),
place AS (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT f FROM dc UNION SELECT f FROM bc)),
s AS (SELECT bucket, sum(n) AS n FROM dc JOIN place USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS n FROM bc JOIN place USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM s) AS DOUBLE) + 10000) / ((CAST(s.n AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM t) AS DOUBLE) + 10000)))) AS gain
         FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM dc JOIN place USING (f) JOIN gain USING (bucket) GROUP BY rid),
h AS (SELECT rid, CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) AS h FROM d),
r AS (SELECT d.rid, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
      FROM d LEFT JOIN w USING (rid) JOIN h USING (rid)),
o AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, rid) AS place, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM r LEFT JOIN o USING (rid)
"""


ORACLES = {"op1_quality_ledger": OP1, "quality_ablations": ABLATIONS, "op3_license_scan": OP3, "op4_line_winnow": OP4_CONTENT, "line_winnow_runs_only": OP4, "op5_benchmark_hits": OP5, "op6_suffix_trees": OP6, "op9_secret_links": op9(), "op10_byte_buckets": OP10, "op11_merkle_manifest": OP11, "op12_exact_dedup": OP12, "op13_importance_resampling": OP13}
