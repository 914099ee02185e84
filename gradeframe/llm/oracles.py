"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

_LETTERS = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS l
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
wins AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM places, (SELECT DISTINCT l FROM items) WHERE i + l - 1 <= len(w)),
found AS (SELECT doc_id, i, wins.l, item_id FROM wins JOIN items USING (win, l)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY 1),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

ORACLES["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_BLANKS = "'[^\\x20\\x09-\\x0D]+'"

ORACLES["op4_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANKS}) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
wins AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS win FROM places),
later AS (
  SELECT doc_id, i FROM wins
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
lists AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: p IS NULL OR NOT list_contains(p, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""

ORACLES["op7_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d),
wins AS (SELECT doc_id, i, sha256(substr(h, 2 * i + 1, 100)) AS win FROM starts),
later AS (SELECT doc_id, i FROM wins QUALIFY doc_id > min(doc_id) OVER (PARTITION BY win)),
reach AS (
  SELECT doc_id, i, i + 50 AS e, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM later),
runs AS (SELECT doc_id, i, e, sum((r IS NULL OR i > r)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM reach),
spans AS (SELECT doc_id, g, min(i) AS a, max(e) AS b FROM runs GROUP BY 1, 2),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS k
  FROM gaps JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op3_ngram_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BLANKS}) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) m ON m.a = d.doc_id
"""

# The sentences and rules are fixed values, stated here once more as SQL.
_IDENTIFIER = """CASE s
  WHEN 'released under the mit license' THEN 'mit-notice' WHEN 'licensed under the mit license' THEN 'mit-notice'
  WHEN 'this project is licensed under the mit license' THEN 'mit-notice'
  WHEN 'permission is hereby granted free of charge to any person obtaining a copy' THEN 'mit-grant'
  WHEN 'the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software' THEN 'mit-keep-notice'
  WHEN 'the software is provided as is without warranty of any kind' THEN 'as-is'
  WHEN 'licensed under the apache license version 2 0' THEN 'apache-2-notice'
  WHEN 'you may not use this file except in compliance with the license' THEN 'apache-compliance'
  WHEN 'you may obtain a copy of the license at' THEN 'apache-copy'
  WHEN 'redistribution and use in source and binary forms with or without modification are permitted' THEN 'bsd-grant'
  WHEN 'redistributions of source code must retain the above copyright notice' THEN 'bsd-source'
  WHEN 'redistributions in binary form must reproduce the above copyright notice' THEN 'bsd-binary'
  WHEN 'this work is licensed under the gnu general public license version 3' THEN 'gpl-3-notice'
  WHEN 'licensed under the gnu general public license version 3' THEN 'gpl-3-notice'
  WHEN 'this program is free software' THEN 'gpl-free'
  WHEN 'you can redistribute it and or modify it under the terms of the gnu general public license' THEN 'gpl-terms'
  WHEN 'licensed under cc by 4 0' THEN 'cc-by-4-notice' WHEN 'licensed under cc by sa 4 0' THEN 'cc-by-sa-4-notice'
  WHEN 'licensed under cc by nc 4 0' THEN 'cc-by-nc-4-notice' WHEN 'all rights reserved' THEN 'reserved' END"""
_NAMED = """[
  CASE WHEN contains(l, '|mit-notice|') OR contains(l, '|mit-grant|mit-keep-notice|as-is|') THEN 'MIT' END,
  CASE WHEN contains(l, '|apache-2-notice|') OR contains(l, '|apache-compliance|apache-copy|') THEN 'Apache-2.0' END,
  CASE WHEN contains(l, '|bsd-grant|bsd-source|bsd-binary|') THEN 'BSD' END,
  CASE WHEN contains(l, '|gpl-3-notice|') THEN 'GPL-3.0' END,
  CASE WHEN contains(l, '|gpl-free|gpl-terms|') THEN 'GPL' END,
  CASE WHEN contains(l, '|cc-by-4-notice|') THEN 'CC-BY-4.0' END,
  CASE WHEN contains(l, '|cc-by-sa-4-notice|') THEN 'CC-BY-SA-4.0' END,
  CASE WHEN contains(l, '|cc-by-nc-4-notice|') THEN 'CC-BY-NC-4.0' END,
  CASE WHEN contains(l, '|reserved|') THEN 'Proprietary' END]"""

ORACLES["op5_licences"] = f"""
WITH d AS (
  SELECT doc_id, list_filter(list_transform(
      string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)),
      lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS sentences FROM documents),
i AS (SELECT *, list_filter(list_transform(sentences, lambda s: {_IDENTIFIER}), lambda x: x IS NOT NULL) AS ids FROM d),
n AS (SELECT *, '|' || array_to_string(ids, '|') || '|' AS l FROM i),
f AS (SELECT *, list_filter({_NAMED}, lambda x: x IS NOT NULL) AS names FROM n)
SELECT doc_id, len(sentences)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(names, ',') AS licences,
  CASE WHEN list_has_any(names, ['CC-BY-NC-4.0', 'Proprietary']) THEN 'restricted'
    WHEN list_has_any(names, ['GPL-3.0', 'GPL', 'CC-BY-SA-4.0']) THEN 'copyleft'
    WHEN len(names) > 0 THEN 'permissive' ELSE 'none' END AS kind
FROM f
"""

# CRC-32 of the decimal doc_id, bit by bit; a tree level per step of the recursion.
_ID = "doc_id::VARCHAR"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({_ID}, ''), lambda c: ascii(c)::BIGINT)),
  lambda x, c: list_reduce(list_prepend(xor(x, c), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)),
  4294967295)"""


def _part(value: str) -> str:
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _row(text: str) -> str:
    return "sha256(" + " || ".join(_part(v) for v in (_ID, "source", "lang", "n_chars::VARCHAR", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """(tree, pos, level, total, d, l, r): nodes of all levels, with the texts left and right of each in its run."""
    return f"""{name} AS (
  SELECT tree, pos, 0 AS level, count(*) OVER (PARTITION BY tree) AS total, d FROM {leaves}
  UNION ALL
  SELECT tree, pos // 8, level + 1, any_value(total), sha256(string_agg(d, '' ORDER BY pos)) FROM {name}
  WHERE pow(8, level) < total GROUP BY tree, pos // 8, level),
{name}_sides AS (
  SELECT *, coalesce(string_agg(d, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE pow(8, level) < total WINDOW w AS (PARTITION BY tree, level, pos // 8 ORDER BY pos))"""


ORACLES["op13_merkle"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, {_row('text')} AS d,
    CASE WHEN {_CRC} % 3 = 0 THEN {_row("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM hashed),
{_tree("nodes", "leaves")},
subroots AS (
  SELECT '' AS tree, tree AS lang, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, d
  FROM (SELECT tree, d FROM nodes QUALIFY level = max(level) OVER (PARTITION BY tree))),
{_tree("tops", "subroots")},
root AS (SELECT d FROM tops ORDER BY level DESC LIMIT 1),
sides AS (
  SELECT leaves.tree, leaves.pos, s.level, s.l, s.r FROM leaves JOIN nodes_sides s
    ON s.tree = leaves.tree AND s.pos = leaves.pos // pow(8, s.level)::BIGINT
  UNION ALL
  SELECT leaves.tree, leaves.pos, 100 + t.level, t.l, t.r FROM leaves JOIN subroots ON subroots.lang = leaves.tree
    JOIN tops_sides t ON t.pos = subroots.pos // pow(8, t.level)::BIGINT),
ways AS (SELECT tree, pos, list({{'l': l, 'r': r}} ORDER BY level) AS way FROM sides GROUP BY 1, 2),
told AS (
  SELECT doc_id, leaves.d AS leaf, subroots.d AS subroot, root.d AS root, coalesce(way, []) AS way,
    coalesce(other, leaves.d) AS from_
  FROM leaves JOIN subroots ON subroots.lang = leaves.tree CROSS JOIN root LEFT JOIN ways ON ways.tree = leaves.tree AND ways.pos = leaves.pos),
done AS (
  SELECT *, list_reduce(list_prepend({{'l': from_, 'r': ''}}, way),
    lambda x, s: {{'l': sha256(s.l || x.l || s.r), 'r': ''}}).l AS folded_root FROM told)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM done
"""
