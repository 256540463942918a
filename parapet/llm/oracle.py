"""DuckDB SQL for the queries of this folder that SQL can express over whole tables.

The statements follow the contracts, not the operators: windows and sets are compared as
strings, links by counting shared shingles, components by the least reachable id.
"""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}')"


def spaced(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def alnum(text: str) -> str:
    return rf"regexp_extract_all({text}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


def windows(words: str, n: str) -> str:
    """Windows of n words as strings; a word holds no blank."""
    return f"list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i:i + {n} - 1], ' '))"


def _repeated(n: int, name: str) -> str:
    """Words in windows of n words that a text holds twice or more."""
    return f"""{name}_at AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, {windows('words', str(n))} AS w FROM split) WHERE len(w) > 1
), {name} AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(pos, pos + {n})) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS times FROM {name}_at) WHERE times > 1)
  GROUP BY doc_id
)"""


OP10 = f"""WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, {spaced("coalesce(text, '')")} AS words FROM documents
), {_repeated(3, 'triple')}, {_repeated(8, 'long')}, {_repeated(401, 'longer')}, lines AS (
  SELECT doc_id, line, count(*) AS times
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line
), dup AS (
  SELECT doc_id, sum(times - 1) AS n FROM lines GROUP BY doc_id
), counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(triple.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(long.n, 0) AS BIGINT) AS covered_words, longer.n IS NOT NULL AS too_long
  FROM split LEFT JOIN dup USING (doc_id) LEFT JOIN triple USING (doc_id)
       LEFT JOIN long USING (doc_id) LEFT JOIN longer USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
       NOT base_failed AND NOT (100 * covered_words > 40 * n_words OR too_long) AS kept FROM judged"""

OP6 = f"""WITH split AS (
  SELECT doc_id, {alnum(lowered('text'))} AS words FROM documents
), item AS (
  SELECT item_id, words, least(10, len(words)) AS n
  FROM (SELECT item_id, {alnum(lowered('text'))} AS words FROM benchmark) WHERE len(words) > 0
), pattern AS (
  SELECT DISTINCT item_id, n, unnest({windows('words', 'n')}) AS w FROM item
), place AS (
  SELECT doc_id, n, unnest(w) AS w, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, n, {windows('words', 'n')} AS w FROM split, (SELECT DISTINCT n FROM pattern))
), hit AS (
  SELECT doc_id, item_id, pos, n FROM place JOIN pattern USING (n, w)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM split LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP9 = f"""WITH RECURSIVE split AS (
  SELECT doc_id, {spaced(lowered('text'))} AS words FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest({windows('words', 'least(3, len(words))')}) AS s FROM split WHERE len(words) > 0
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY u, v, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM split
  UNION SELECT v, root FROM reach JOIN link ON u = node AND root < v
), least_root AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
FROM split LEFT JOIN size USING (doc_id) JOIN least_root ON node = doc_id"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
OP1 = f"""WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS response FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr({_BASE32}, 1 + (
         (CAST('0x' || substr(h || '0', 1 + (5 * i) // 4, 2) AS INTEGER) >> (3 - (5 * i) % 4)) & 31), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to FROM g"""


def crc32_table() -> list[int]:
    """The bytewise steps of the public checksum, from its polynomial."""
    def step(value: int) -> int:
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        return value
    return [step(i) for i in range(256)]


#: Letters beyond ASCII are all in Latin-1, so they have two bytes in UTF-8.
_BYTES = """flatten(list_transform(string_split(id || ':' || run, ''), lambda ch:
  CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [195, unicode(ch) - 64] END))"""
OP11 = rf"""WITH RECURSIVE run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all({lowered('text')}, '[a-z\x{{C0}}-\x{{FF}}]{{6,}}')) AS run FROM documents
), hashed AS (
  SELECT id, run, count(*) AS n, xor(list_reduce({_BYTES}, lambda c, b:
    xor(c >> 8, {crc32_table()}[(xor(c, CAST(b AS BIGINT)) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM run GROUP BY id, run
), cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END
         AS word, n FROM hashed
), word AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), without AS (
  SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM word)
), near AS (
  SELECT a.word, b.word AS other FROM without a JOIN without b USING (p, rest) WHERE a.word <> b.word
  UNION SELECT w.word, rest FROM without w JOIN word s ON s.word = rest
  UNION SELECT rest, w.word FROM without w JOIN word s ON s.word = rest
), best AS (
  SELECT near.word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other
  FROM near JOIN word ON word.word = other GROUP BY near.word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN other END AS form,
         CASE WHEN top >= 5 * n THEN top END AS form_n FROM word LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM word
  UNION SELECT chain.word, form FROM chain JOIN formed ON formed.word = root WHERE form IS NOT NULL
), ends AS (
  SELECT chain.word, root FROM chain JOIN formed ON formed.word = root WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""

_CONTROL = r"""regexp_replace(regexp_replace(coalesce({0}, ''), '<(\\*)(/?s>|</?SYS>>)', '<\\\1\2', 'g'),
  '\[(\\*)(/?INST\]|/?ROLE\]|END\]|NEXT\])', '[\\\1\2', 'g')"""
OP12 = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), placed AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, length({_CONTROL.format('text')}) AS long,
         CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 6 WHEN 'assistant' THEN 3
         ELSE 13 + length({_CONTROL.format('role')}) END AS opening,
         CASE role WHEN 'system' THEN 8 WHEN 'user' THEN 7 WHEN 'assistant' THEN 4 ELSE 5 END AS closing
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(long + CASE WHEN before = role THEN 6 ELSE opening END
                + CASE WHEN after = role THEN 0 ELSE closing END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""

OP13 = f"""WITH doc AS (
  SELECT row_number() OVER () AS row, doc_id, {alnum(lowered('text'))} AS words FROM documents
), term AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS t FROM doc WHERE len(words) > 0
), tf AS (
  SELECT row, doc_id, n, t, count(*) AS tf FROM term GROUP BY row, doc_id, n, t
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(words)) AS BIGINT) AS l FROM doc WHERE len(words) > 0
), weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t, big_n
), asked AS (
  SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({alnum(lowered('text'))}) AS t FROM benchmark)
  GROUP BY item_id, t
), scored AS (
  SELECT item_id, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // l))))
         AS BIGINT) AS score
  FROM asked JOIN weight USING (t) JOIN tf USING (t), total GROUP BY item_id, doc_id, row
), numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM numbered WHERE rank <= 10"""

ORACLE = {
    "op1_warc": OP1, "op6_wu_manber": OP6, "op9_hyperminhash": OP9, "op10_suffix_repetition": OP10,
    "op11_prefix_suffix_tiling": OP11, "op12_relational_chat": OP12,
    "op13_ball_tree": OP13,
}
