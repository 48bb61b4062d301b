"""DuckDB SQL for the operators that SQL can express."""

from critiq.llm.decontam import LEAST_LITERALS, UNITS, WINDOW

_TOKEN = r"([^\p{L}\p{N}]*)(\p{N}+(?:[.,:/]\p{N}+)*|\p{L}[\p{L}\p{M}]*)"
_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _form(opening: str) -> str:
    """A text's template, with capitalised words that open a sentence as `opening`."""
    return f"""list_transform(raw, lambda t, i: CASE WHEN regexp_matches(t, '^\\p{{N}}') THEN regexp_extract(gaps[i], '^\\s*([-+*/×÷=^])\\s*$', 1) || '<num>'
    WHEN lower(t) <> t THEN CASE WHEN i > 1 AND NOT regexp_matches(gaps[i], '[.!?:\\n]') THEN '<name>' ELSE {opening} END
    WHEN i > 1 AND lower(t) IN ({_UNITS}) AND regexp_matches(raw[i - 1], '^\\p{{N}}') THEN '<unit>' ELSE lower(t) END)"""


def _split(table: str, key: str) -> str:
    text = "coalesce(text, '')"
    tokens = f"SELECT {key}, regexp_extract_all({text}, '{_TOKEN}', 2) AS raw, regexp_extract_all({text}, '{_TOKEN}', 1) AS gaps FROM {table} WHERE {key} IS NOT NULL"
    return f"SELECT {key}, list_transform(raw, lambda t: lower(t)) AS low, {_form(chr(39) + '<name>' + chr(39))} AS name, {_form('lower(t)')} AS word FROM ({tokens})"


NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT b, root FROM reach JOIN both_ways ON a = doc_id)
SELECT n.doc_id, n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN reach ON n.doc_id = reach.doc_id GROUP BY n.doc_id, n"""



def _repeats(form: str) -> str:
    """Which slots hold the same value of the same kind: of each the first place where kind and value stand."""
    keys = f"list_transform({form}, lambda t, i: regexp_extract(t, '<[a-z]+>$') || ':' || low[i])"
    return f"list_transform({form}, lambda t, i: CASE WHEN t LIKE '%>' THEN list_position({keys}, regexp_extract(t, '<[a-z]+>$') || ':' || low[i]) END)"


def _judged(hits: str, of: str, name: str, voids: str) -> str:
    """CTEs: windows met by members of `of`, slots torn in pairs with enough of them, members held."""
    pair = "doc_id, class, kind, member"
    return f"""{name}_met AS MATERIALIZED (SELECT DISTINCT h.doc_id, m.class, m.kind, m.member, m.w, h.q - c.p AS line, c.p FROM {hits} h JOIN wanted c ON c.class = h.class AND c.w = h.w AND c.code = h.code
  JOIN members m ON m.member = c.member AND m.kind = c.kind WHERE {of}),
{name}_enough AS (SELECT {pair} FROM {name}_met JOIN totals USING (kind, member) GROUP BY {pair}, total HAVING count(DISTINCT p) >= 0.5 * total),
{name}_lines AS MATERIALIZED (SELECT * FROM {name}_met SEMI JOIN {name}_enough USING ({pair})),
{name}_slots AS (SELECT DISTINCT l.doc_id, l.class, l.kind, l.member, line, p + j AS j, regexp_extract(m.form[p + j + 1], '<[a-z]+>$') AS slot, m.low[p + j + 1] AS ours, d.low[line + p + j + 1] AS theirs
  FROM (SELECT *, unnest(range(w)) AS j FROM {name}_lines WHERE kind <> 'low') l JOIN members m ON m.member = l.member AND m.kind = l.kind JOIN d ON d.doc_id = l.doc_id WHERE m.form[p + j + 1] LIKE '%>'),
{name}_torn AS MATERIALIZED (SELECT doc_id, class, kind, member, line, j FROM (SELECT *, min(theirs) OVER here <> max(theirs) OVER here OR min(ours) OVER there <> max(ours) OVER there AS apart FROM {name}_slots
  WINDOW here AS (PARTITION BY {pair}, line, slot, ours), there AS (PARTITION BY {pair}, line, slot, theirs)) WHERE apart),
{name}_held AS MATERIALIZED (SELECT {pair}, count(DISTINCT p) AS n_windows, count(DISTINCT p) / total AS share FROM {name}_lines l JOIN totals USING (kind, member)
  WHERE NOT EXISTS (SELECT 1 FROM {voids} t WHERE t.doc_id = l.doc_id AND t.line = l.line AND t.j >= l.p AND t.j < l.p + l.w AND t.member = CASE WHEN l.kind = 'low' THEN l.class ELSE l.member END)
  GROUP BY {pair}, total HAVING count(DISTINCT p) / total >= 0.5)"""


_CODE = "array_to_string({}[{} + 1 : {} + w], ' ')"
DECONTAMINATION = f"""
WITH d AS ({_split('documents', 'doc_id')}),
items AS (SELECT *, least(len(low), {WINDOW}) AS w, array_to_string(name, ' ') || '/' || {_repeats('name')}::VARCHAR AS class, array_to_string(word, ' ') || '/' || {_repeats('word')}::VARCHAR AS finer
  FROM ({_split('benchmark', 'item_id')}) WHERE len(low) > 0),
each AS (SELECT item_id, w, low, 'name' AS kind, class, class AS member, name AS form FROM items
  UNION ALL SELECT item_id, w, low, 'word', class, finer || '//' || class, word FROM items WHERE name <> word
  UNION ALL SELECT item_id, w, low, 'low', class, array_to_string(low, ' ') || '//' || class, low FROM items),
members AS MATERIALIZED (SELECT kind, class, member, min(item_id) AS item_id, count(DISTINCT item_id) AS n_items, any_value(w) AS w, arg_min(low, item_id) AS low, any_value(form) AS form FROM each GROUP BY 1, 2, 3),
wanted AS MATERIALIZED (SELECT kind, class, member, w, p, {_CODE.format('form', 'p', 'p')} AS code FROM (SELECT *, unnest(range(len(form) - w + 1)) AS p FROM members
  WHERE kind = 'low' OR len(list_filter(form, lambda t: t NOT LIKE '<%')) >= {LEAST_LITERALS}) WHERE kind = 'low' OR len(list_filter(form[p + 1 : p + w], lambda t: t NOT LIKE '<%')) > 0),
totals AS (SELECT kind, member, count(*) AS total FROM wanted GROUP BY 1, 2),
keys AS (SELECT DISTINCT w, code, class FROM wanted),
seen AS (SELECT DISTINCT doc_id, w, q, unnest([{', '.join(_CODE.format(c, 'q', 'q') for c in ('low', 'name', 'word'))}]) AS code
  FROM (SELECT *, unnest(range(len(low) - w + 1)) AS q FROM d, (SELECT DISTINCT w FROM members) WHERE len(low) >= w)),
hits AS MATERIALIZED (SELECT doc_id, w, q, code, class FROM seen JOIN keys USING (w, code)),
{_judged('hits', "m.kind = 'name'", 'whole', 'whole_torn')},
rest AS MATERIALIZED (SELECT * FROM hits ANTI JOIN whole_held USING (doc_id, class)),
{_judged('rest', "m.kind <> 'name'", 'finer', "(FROM whole_torn UNION ALL FROM finer_torn)")},
found AS (SELECT doc_id, item_id, n_items, n_windows, share FROM (FROM whole_held UNION ALL FROM finer_held) JOIN members USING (kind, class, member))
SELECT doc_id, item_id, max({{'share': share, 'n_windows': n_windows, 'n_items': n_items}}).n_items AS n_items, max({{'share': share, 'n_windows': n_windows, 'n_items': n_items}}).n_windows AS n_windows, max(share) AS share
FROM found GROUP BY 1, 2"""


FILTER_AUDIT = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM w GROUP BY 1),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
cells AS MATERIALIZED (
  SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(w.text, '[A-Z]')) > 2 * length(w.text))::INT
           + 8 * regexp_matches(w.text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask,
         count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM w JOIN firsts ON w.text = firsts.text LEFT JOIN marks ON w.doc_id = marks.doc_id GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
places AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::BIGINT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
kinds AS (SELECT DISTINCT bit, before FROM places),
counts AS (
  SELECT part, bit, before, sum(n) FILTER (mask & (bit | before) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
         sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
  FROM cells, kinds GROUP BY ALL),
shares AS (SELECT part, bit, sum(removed) AS shapley FROM places JOIN counts USING (bit, before) GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(shapley, 0)::BIGINT AS shapley
FROM places JOIN counts USING (bit, before) JOIN shares USING (part, bit)"""

#: DuckDB has no crc32: a fold over the digits' bits.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(CAST(conv_id AS VARCHAR)[i])::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT)"""

CONVERSATION_TRIE = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || text), 1, 32)) AS t FROM turns GROUP BY 1),
heads AS (SELECT *, {CRC32} % 9 AS h FROM own),
full_paths AS MATERIALIZED (SELECT a.conv_id, list_concat(coalesce(b.t, [])[1 : a.h], a.t[a.h + 1 :]) AS t FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
members AS MATERIALIZED (SELECT conv_id, len(t) AS n, d AS depth, t[1 : d] AS p, t[d].text AS last FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM full_paths)),
nodes AS MATERIALIZED (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(any_value(last)), 0) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2),
linked AS MATERIALIZED (SELECT c.*, u.conv_id AS parent_conv_id FROM nodes c LEFT JOIN nodes u ON c.depth = u.depth + 1 AND c.p[1 : c.depth - 1] = u.p),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
counted AS MATERIALIZED (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids k ON l.conv_id = k.conv_id AND l.depth = k.depth),
under AS (
  SELECT u.p, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.bytes) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) c JOIN nodes u ON u.depth = c.up AND c.p[1 : c.up] = u.p GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM counted JOIN under USING (p)"""
