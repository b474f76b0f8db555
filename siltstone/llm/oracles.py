"""DuckDB SQL for the operators that SQL can express; written apart from the Spark plans.

Base lines and the method's own columns are both given by brute force: every block against every template, every
window of words, every turn. Operators without an entry are tested against brute force in tests/llm."""

from __future__ import annotations

from siltstone.llm.license_scan import TEMPLATES

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_templates = ", ".join(f"({i}, '{label}', list_distinct(string_split('{text}', ' ')))" for i, (label, text) in enumerate(TEMPLATES))

OP1 = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {LOWER.format("text")} AS t FROM documents),
words AS (SELECT rid, doc_id, t, {ALNUM.format("t")} AS w FROM docs),
phrases(label, p) AS (VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])),
places AS (SELECT rid, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS place FROM words, phrases WHERE contains(t, 'license')),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid),
templates(id, label, tw) AS (VALUES {_templates}),
blocks AS (SELECT rid, row_number() OVER () AS bid, b FROM (SELECT rid, unnest(string_split_regex(t, '\n[\x20\t\r]*\n')) AS b FROM docs)),
sets AS (SELECT rid, bid, list_distinct({ALNUM.format("b")}) AS bw FROM blocks),
hits AS (SELECT rid, bid, label, len(list_intersect(tw, bw)) / len(tw) AS share FROM sets, templates WHERE len(list_intersect(tw, bw)) >= ceil(0.8 * len(tw) - 1e-9)),
method AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share, count(DISTINCT bid) AS n_blocks FROM hits GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, []::VARCHAR[])), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []::VARCHAR[]), coalesce(method.labels, []::VARCHAR[])))), ',') AS labels,
CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM words LEFT JOIN base USING (rid) LEFT JOIN method USING (rid)
"""

OP2 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
windows AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) >= 2),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(n, 0) AS n_repeat_words FROM words LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 5 * n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept FROM f
"""


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '%', '%25'), '<', '%3C'), '[', '%5B'), ']', '%5D')"


OP7 = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, greatest(ceil(length(text) / 4), 1)::BIGINT AS n, 10 + length({_escaped("role")}) + length({_escaped("text")}) AS chars FROM rows),
placed AS (SELECT *, row_number() OVER o AS r, sum(n) OVER o AS upto FROM sized WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
system AS (SELECT conv_id, min(r) AS r, arg_min(chars, r) AS chars, arg_min(n, r) AS tokens FROM placed WHERE role = 'system' GROUP BY conv_id),
cells AS (SELECT placed.*, upto - n AS before, coalesce(tokens, 0) AS sys, greatest(2048 - 512 - coalesce(tokens, 0), 512) AS room, (upto - 1) // greatest(2048 - 512 - coalesce(tokens, 0), 512) AS cell FROM placed LEFT JOIN system USING (conv_id)),
turns AS (SELECT *, 2 * cell + CASE WHEN before >= cell * room AND max(upto) OVER c - min(before) OVER c > room THEN 1 ELSE 0 END AS span FROM cells WINDOW c AS (PARTITION BY conv_id, cell)),
later AS (SELECT conv_id, span, min(r) AS first, min(before) AS begins, least(512, 2048 - min(sys) - (max(upto) - min(before))) AS room FROM turns GROUP BY ALL HAVING min(r) > 1),
extra AS (SELECT later.conv_id, system.chars FROM later JOIN system USING (conv_id) WHERE system.r < first
    UNION ALL SELECT later.conv_id, turns.chars FROM later JOIN turns ON later.conv_id = turns.conv_id AND turns.r BETWEEN first - 2 AND first - 1 AND role <> 'system' AND begins - before <= later.room),
more AS (SELECT conv_id, sum(chars) AS chars FROM extra GROUP BY conv_id),
one AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY r)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY r) FILTER (role = 'assistant'), '') AS target, sum(chars) AS chars FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(target) AS loss_chars, sha256(target) AS loss_sha256, (one.chars + coalesce(more.chars, 0))::BIGINT AS formatted_chars FROM one LEFT JOIN more USING (conv_id)
"""

ORACLES: dict[str, str] = {"op1_license_scan": OP1, "op2_quality_rules": OP2, "op7_chat_format": OP7}
