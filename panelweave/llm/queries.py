"""One registered query per operator, over its whole table, and SQL twins where SQL can express it."""

from __future__ import annotations

from panelweave.llm import bpe, chat, decontamination, forest, language, lines, merkle, periods, quality, secret_scan, simhash, substrings, token_counts
from panelweave.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"


def vocabulary_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest(spark, d):
    return forest.report(table(spark, d, "embeddings"))


#: A conversation whose texts consist of control strings.
MARKED_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_format(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).selectExpr(
        "CAST(-7 AS BIGINT) AS conv_id", "id AS turn", "CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role", f"'{MARKED_TEXT}' AS text"
    )
    return chat.report(rows.unionByName(marked))


def op3_simhash(spark, d):
    return simhash.report(table(spark, d, "documents"))


def op4_substring_dedup(spark, d):
    return substrings.report(table(spark, d, "documents")).drop("repeats")


def op5_byte_pairs(spark, d):
    return bpe.report(table(spark, d, "documents"), vocabulary_path())


def op6_line_dedup(spark, d):
    return lines.report(table(spark, d, "documents"))


def op7_secret_scan(spark, d):
    return secret_scan.report(table(spark, d, "documents"))


def op8_token_counts(spark, d):
    return token_counts.report(table(spark, d, "documents"), vocabulary_path())


def op9_decontamination(spark, d):
    return decontamination.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op10_language(spark, d):
    return language.report(table(spark, d, "documents"))


def op11_periodic_runs(spark, d):
    return periods.report(periods.planted(table(spark, d, "documents")))


def op12_merkle_manifest(spark, d):
    return merkle.report(table(spark, d, "documents"))


def op13_quality(spark, d):
    return quality.report(table(spark, d, "documents"), table(spark, d, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest, op2_chat_format, op3_simhash, op4_substring_dedup, op5_byte_pairs, op6_line_dedup, op7_secret_scan, op8_token_counts,
        op9_decontamination, op10_language, op11_periodic_runs, op12_merkle_manifest, op13_quality,
    )
}

_WORDS_9 = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_ESCAPED = "(length({0}) + length({0}) - length(translate({0}, '\\<[', '')))"

#: CRC-32 of a number's decimal digits: the table of its bytes is made by the rule, digits are folded in one by one.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda c, s: xor(c >> 8, t[CAST((xor(c, s) & 255) + 1 AS BIGINT)])))"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"


ORACLE_SQL = {
    "op2_chat_format": rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{MARKED_TEXT}'), (-7, 1, 'assistant', '{MARKED_TEXT}')),
sized AS (SELECT *, row_number() OVER w AS place, {len(chat.OPEN) + len(chat.CLOSE) + 1} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")} AS chars,
  len(regexp_extract_all(text, '{chat.TOKEN}')) + {chat.MARKS} AS tokens FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
led AS (SELECT *, place = 1 AND role = 'system' AS is_system, max(CASE WHEN place = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id) AS lead,
  max(CASE WHEN place = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS lead_chars FROM sized),
stepped AS (SELECT *, greatest(({chat.BUDGET - chat.HISTORY_TOKENS} - coalesce(lead, 0)) // 2, {chat.BUDGET // 8}) AS step,
  sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY place) - CASE WHEN is_system THEN 0 ELSE tokens END AS before FROM led),
keyed AS (SELECT *, tokens > step AS large,
  sum(CASE WHEN tokens > step AND NOT is_system THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY place) AS larges FROM stepped),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, larges, large, before // step ORDER BY place) = 1 AS starts FROM keyed WHERE NOT is_system),
begun AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS span FROM marked WHERE starts),
repeated AS (SELECT b.conv_id, sum(h.chars) AS chars FROM begun b JOIN marked h ON h.conv_id = b.conv_id AND h.place < b.place
  AND h.place >= b.place - {chat.HISTORY_TURNS} AND b.before - h.before <= {chat.HISTORY_TOKENS} WHERE b.span > 1 GROUP BY 1),
again AS (SELECT conv_id, sum(coalesce(lead_chars, 0)) AS chars FROM begun WHERE span > 1 GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
  CAST(sum(l.chars) + coalesce(max(r.chars), 0) + coalesce(max(a.chars), 0) AS BIGINT) AS formatted_chars
FROM led l LEFT JOIN repeated r USING (conv_id) LEFT JOIN again a USING (conv_id) GROUP BY conv_id""",
    "op4_substring_dedup": r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs)),
later AS (SELECT doc_id, i FROM windows JOIN (SELECT w, min(doc_id) AS least FROM windows GROUP BY w) USING (w) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM later),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM docs) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)""",
    "op6_line_dedup": rf"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls,
  list_transform(string_split(text, chr(10)), lambda l: len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS ns FROM documents),
windows AS (SELECT doc_id, i, k, array_to_string(ls[i:i + k - 1], chr(10)) AS w
  FROM (SELECT doc_id, ls, ns, k, unnest(range(1, len(ls) - k + 2)) AS i FROM docs, range(1, {lines.RUN + 1}) AS sizes(k))
  WHERE k = {lines.RUN} OR list_sum(ns[i:i + k - 1]) >= {lines.PASSAGE_WORDS}),
later AS (SELECT doc_id, i, k FROM (SELECT doc_id, i, k, row_number() OVER (PARTITION BY k, w ORDER BY doc_id, i) AS place FROM windows) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM later),
left_over AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM docs) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(CAST(len(ls) AS BIGINT), 0) AS n_lines, coalesce(CAST(len(ls) AS BIGINT), 0) - coalesce(n, 0) AS n_removed,
  CASE WHEN ls IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)""",
    "op9_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_9.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, ws, least(10, len(ws)) AS k FROM items WHERE len(ws) > 0),
item_windows AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, coalesce({_WORDS_9.format("text")}, []) AS ws FROM documents),
doc_windows AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM item_windows))),
found AS (SELECT doc_id, k, i, item FROM doc_windows JOIN item_windows USING (k, w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM found)) GROUP BY 1),
owners AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(o.n, 0) AS n_items,
  sha256(coalesce(o.names, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit h USING (doc_id) LEFT JOIN owners o USING (doc_id)""",
    "op11_periodic_runs": rf"""
WITH {_CRC_TABLE},
given AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, {_CRC.format("doc_id")} AS h FROM documents, crc),
sized AS (SELECT *, h // 10 AS g, len(ws) AS n FROM given),
shaped AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM sized),
docs AS (SELECT doc_id, n, list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) AS ws FROM shaped),
placed AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM docs),
equals AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equals),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
listed AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS names FROM runs GROUP BY 1),
best AS (SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period
  OR o.length * r.period = r.length * o.period AND (o.start < r.start OR o.start = r.start AND o.period < r.period))))
SELECT doc_id, coalesce(l.n, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period,
  CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(l.names, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed l USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN n_chars IS NOT NULL AND {_CRC.format("doc_id")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS other,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents, crc),
nodes(lang, level, n, pos, node) AS (SELECT lang, 0, n, pos, leaf FROM leaves
  UNION ALL SELECT lang, level + 1, any_value((n + 1) // 2), pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (SELECT lang, node, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, n, pos, node) AS (SELECT 0, n, pos, node FROM subroots
  UNION ALL SELECT level + 1, any_value((n + 1) // 2), pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2),
joined AS (SELECT l.doc_id, l.leaf, coalesce(l.other, l.leaf) AS first, l.pos, s.node AS subroot, s.height, s.pos AS place, (SELECT node FROM tops WHERE n = 1) AS root
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang),
steps AS (SELECT j.doc_id, n.level, (j.pos >> n.level) & 1 AS side, c.node AS other FROM leaves l JOIN joined j USING (doc_id)
    JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.pos = j.pos >> n.level AND n.level < j.height
    LEFT JOIN nodes c ON c.lang IS NOT DISTINCT FROM l.lang AND c.level = n.level AND c.pos = xor(n.pos, 1)
  UNION ALL SELECT j.doc_id, j.height + t.level, (j.place >> t.level) & 1, c.node FROM joined j
    JOIN tops t ON t.pos = j.place >> t.level AND t.n > 1 LEFT JOIN tops c ON c.level = t.level AND c.pos = xor(t.pos, 1)),
paths AS (SELECT doc_id, coalesce(string_agg(other, '' ORDER BY level), '') AS siblings, list({{'side': side, 'other': coalesce(other, '')}} ORDER BY level) AS path FROM steps GROUP BY 1),
ended AS (SELECT j.*, sha256(coalesce(p.siblings, '')) AS proof_sha256, list_reduce(list_prepend({{'side': 0::BIGINT, 'other': first}}, coalesce(p.path, [])),
    lambda x, y: {{'side': 0::BIGINT, 'other': sha256(CASE WHEN y.side = 1 THEN y.other || x.other ELSE x.other || y.other END)}}).other AS folded_root
  FROM joined j LEFT JOIN paths p USING (doc_id))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM ended""",
}
