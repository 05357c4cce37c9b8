"""SQL twins of the operators that SQL can express, on the same tables."""

from __future__ import annotations

#: Windows of eight words, repeated lines and adjacent repeats come from unnested words; the rules are those of ``rules.rules``.
_OP7 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
  u AS (SELECT row_number() OVER () AS r, * FROM d),
  l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM u),
  ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
  g AS (SELECT r, len(w) AS n, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM u WHERE len(w) >= 8)),
  twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
  cover AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
  each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM u),
  mark AS (SELECT r, i, CASE WHEN word = lag(word) OVER (PARTITION BY r ORDER BY i) THEN 0 ELSE 1 END AS new FROM each),
  runs AS (SELECT r, k, count(*) AS c FROM (SELECT r, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM mark) GROUP BY r, k),
  adj AS (SELECT r, sum(c // 2) AS n_adjacent FROM runs GROUP BY r),
  m AS (SELECT u.doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
      coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_adjacent, 0) AS n_adjacent
    FROM u LEFT JOIN ln USING (r) LEFT JOIN cover USING (r) LEFT JOIN adj USING (r)),
  b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_dup_lines > 40 * n_lines
      OR len(regexp_extract_all(t, '[!?]{2}')) * 5 > n_words OR length(regexp_replace(t, '[^\pL]', '', 'g')) * 2 < word_chars OR length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) * 2 > word_chars
      OR len(list_distinct(w)) * 6 < least(n_words, 3000) OR n_adjacent * 5 > n_words) AS kept
  FROM b"""

#: CRC-32 of a text, by a table of its 256 bytes' remainders; blob bytes come from the hexadecimal form.
_CRC = """crcs AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS remainders)"""


def _crc(text: str) -> str:
    step = "lambda c, x: xor(c // 256, crcs.remainders[(xor(c, x) % 256) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), {step}), 4294967295)"


#: Sequences are lists of (role, text); a node's descendants are the nodes whose member's own prefix it is.
_OP11 = f"""WITH {_CRC},
  own AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  h AS (SELECT conv_id, t, {_crc("conv_id::VARCHAR")} % 6 AS h FROM own, crcs),
  built AS (SELECT h.conv_id, list_concat(coalesce(f.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN own f ON f.conv_id = h.conv_id - h.conv_id % 100),
  spot AS (SELECT conv_id, len(t) AS n, d, t[1:d] AS p FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM built)),
  node AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM spot GROUP BY d, p),
  near AS (SELECT c.*, u.conv_id AS parent FROM node c LEFT JOIN node u ON u.d = c.d - 1 AND u.p = c.p[1:c.d - 1]),
  kids AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n FROM near WHERE d > 0 GROUP BY ALL),
  below AS (SELECT u.d, u.conv_id, count(*) FILTER (k.n IS NULL) AS leaves, sum((c.n_convs - 1) * coalesce(length(c.p[c.d][2]), 0)) AS saved
    FROM node c JOIN spot a ON a.conv_id = c.conv_id AND a.d <= c.d JOIN node u ON u.d = a.d AND u.p = a.p LEFT JOIN kids k ON k.d = c.d AND k.conv_id = c.conv_id GROUP BY u.d, u.conv_id)
  SELECT near.conv_id, near.d::BIGINT AS depth, near.parent AS parent_conv_id, near.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(near.ends) AS ends_sha256
  FROM near JOIN below USING (d, conv_id) LEFT JOIN kids USING (d, conv_id)"""


def _leaf(text: str) -> str:
    written = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
    return "sha256(concat(" + ", ".join(map(written, ("doc_id", "source", "lang", "n_chars", text))) + "))"


#: Trees grow by one level in each round of the recursion; a row's proof and the fold follow its places upwards.
_OP13 = f"""WITH RECURSIVE {_CRC},
  leaf AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || lang, '') AS tree, {_leaf("text")} AS h,
    CASE WHEN {_crc("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS fake FROM documents, crcs),
  placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, r) - 1 AS place FROM leaf),
  low AS (SELECT tree, 0 AS level, place, h FROM placed UNION ALL
    SELECT tree, level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, level, place // 8),
  subs AS (SELECT tree, arg_max(h, level) AS h, max(level) AS height FROM low GROUP BY tree),
  subs_placed AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS place FROM subs),
  top AS (SELECT 0 AS level, place, h FROM subs_placed UNION ALL
    SELECT level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, place // 8),
  root AS (SELECT arg_max(h, level) AS h, max(level) AS height FROM top),
  mine AS (SELECT placed.*, subs_placed.h AS subroot, subs_placed.height AS low_height, subs_placed.place AS sub_place, root.h AS root, root.height AS top_height FROM placed JOIN subs_placed USING (tree), root),
  steps AS (SELECT r, l.level, l.place, l.h, m.place // (8 ** l.level)::BIGINT AS own FROM mine m JOIN low l ON l.tree = m.tree AND l.level < m.low_height AND l.place // 8 = m.place // (8 ** (l.level + 1))::BIGINT
    UNION ALL SELECT r, m.low_height + t.level, t.place, t.h, m.sub_place // (8 ** t.level)::BIGINT FROM mine m JOIN top t ON t.level < m.top_height AND t.place // 8 = m.sub_place // (8 ** (t.level + 1))::BIGINT),
  sides AS (SELECT r, level, coalesce(string_agg(h, '' ORDER BY place) FILTER (place < own), '') AS l, coalesce(string_agg(h, '' ORDER BY place) FILTER (place > own), '') AS g FROM steps GROUP BY r, level),
  ways AS (SELECT r, list((l, g) ORDER BY level) AS way, string_agg(l || g, '' ORDER BY level) AS proof FROM sides GROUP BY r),
  fold AS (SELECT r, 1 AS i, coalesce(fake, h) AS h FROM mine UNION ALL SELECT r, i + 1, sha256(way[i][1] || h || way[i][2]) FROM fold JOIN ways USING (r) WHERE i <= len(way)),
  done AS (SELECT r, arg_max(h, i) AS folded FROM fold GROUP BY r)
  SELECT doc_id, mine.h AS leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM mine LEFT JOIN ways USING (r) JOIN done USING (r)"""

ORACLES = {"op7_rules": _OP7, "op11_prefix_trie": _OP11, "op13_merkle": _OP13}
