"""DuckDB SQL for the rows of the corpus queries, where SQL can express them."""


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII text in SQL: a step for each of its bits, by the reversed polynomial 0xEDB88320."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda b: [CAST(ord(b) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda a, x: {step}), 4294967295)"


def repaired_conversations() -> str:
    """The costs to go of op12 as SQL: backward over the rows, the least (cost, letters) from each of the grammar's four states, with the lines."""
    free, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    of = lambda cost, letter, then, line: f"{{'c': {then}.c + {cost}, 'a': '{letter}' || {then}.a, 't': {then}.t}}" if line is None else f"{{'c': {then}.c + {cost}, 'a': '{letter}' || {then}.a, 't': list_prepend({line}, {then}.t)}}"
    least = lambda options: f"list_min([{', '.join(options)}])"
    base, once, twice = [], [], []
    for s in range(4):
        k = " ".join(f"WHEN live AND left(role, 1) = '{x}' THEN {of('more', 'K', f'n{to}', 'role || chr(58) || text')}" for x, to in keep[s].items())
        r = f"CASE WHEN live THEN {of('1 + more', 'R', f'n{free[s]}', f'{chr(39)}{name[free[s]]}:{chr(39)} || text')} END"
        base.append(f"{least([of('2', 'D', f'n{s}', None), f'CASE {k} END', r])} AS b{s}")
        insert = lambda at, s=s: of("5", "I", f"{at}{free[s]}", f"'{name[free[s]]}:'")
        once.append(f"{least([f'b{s}', insert('b')])} AS o{s}")
        twice.append(f"{least([f'o{s}', insert('o')])} AS n{s}")
    end = lambda c, a, *t: f"{{'c': {c}, 'a': '{a}', 't': CAST([{', '.join(repr(x) for x in t)}] AS VARCHAR[])}}"
    ends = [end(0, ""), end(10, "II", "user:", "assistant:"), end(5, "I", "assistant:"), end(0, "")]
    return f"""
WITH RECURSIVE raw AS (
  SELECT *, {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS f FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(0, CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE f <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), copy) AS i FROM d),
q AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM p),
rows AS (
  SELECT *, NOT blank AND NOT seen AS live, CASE WHEN cut THEN 5 ELSE 0 END AS more, count(*) OVER (PARTITION BY conv_id) AS n,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM q),
w AS (
  SELECT conv_id, n + 1 AS i, {", ".join(f"{e} AS n{s}" for s, e in enumerate(ends))} FROM (SELECT conv_id, max(n) AS n FROM rows GROUP BY conv_id)
  UNION ALL
  SELECT conv_id, i, {", ".join(twice)} FROM (SELECT conv_id, i, {", ".join(once)} FROM (
    SELECT rows.conv_id, rows.i, {", ".join(base)} FROM w JOIN rows ON rows.conv_id IS NOT DISTINCT FROM w.conv_id AND rows.i = w.i - 1))),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND seen) AS duplicate,
    count(*) FILTER (WHERE live AND cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(w.n0.c, 0) AS BIGINT) AS cost, coalesce(w.n0.a, '') AS audit, sha256(coalesce(array_to_string(w.n0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 1
"""


ORACLES: dict[str, str] = {
    "op1_warc_round_trip": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
""",
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sets
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.root) AS component_id, min(r.root) = s.doc_id AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)
""",
    "op6_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS total,
    14 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\b'), '<', '\l')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = total THEN so_far ELSE 0 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
""",
    "op10_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM sized))),
found AS (SELECT p.doc_id, p.i, p.size, v.item_id FROM places p JOIN windows v ON p.size = v.size AND p.key = v.key),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
""",
    "op11_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95),
reach AS (SELECT r AS node, vec_id AS root FROM v UNION SELECT l.b, reach.root FROM reach JOIN links l ON l.a = reach.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN least ON least.node = v.r LEFT JOIN n ON n.a = v.r
""",
    "op13_expiring_clicks": rf"""
WITH RECURSIVE k AS (
  SELECT *, unnest(range(0, ((click_id % 3) + 3) % 3 + 1)) AS j FROM clicks WHERE click_id IS NOT NULL AND arrived_at IS NOT NULL),
c AS (SELECT *, {crc32("(CAST(click_id AS VARCHAR) || ':' || CAST(j AS VARCHAR))")} AS c FROM k),
h AS (
  SELECT click_id, c, epoch_us(arrived_at) // 3600000000 + 6 * j * (c % 10) AS hour,
    sha256(coalesce(CAST(client_id AS VARCHAR), '') || '|' || coalesce(kind, '') || '|' || coalesce(CAST(CAST(floor(100 * value + 0.5) AS BIGINT) AS VARCHAR), '') || '|'
      || coalesce(CAST(epoch_us(ts) AS VARCHAR), '') || '|' || coalesce(props, '') || '|' || CAST(c % 3 AS VARCHAR)) AS hash
  FROM c),
l AS (SELECT *, hour + (c // 10) % 200 AS lands FROM h),
b AS (SELECT click_id, hour, hash, (lands - min(lands) OVER ()) * 10 // (max(lands) OVER () - min(lands) OVER () + 1) AS batch FROM l),
m AS (SELECT batch, max(hour) AS newest FROM b GROUP BY batch),
now AS (SELECT batch, max(newest) OVER (ORDER BY batch) AS upto, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM m),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY click_id ORDER BY b.batch, hour, hash) AS n
  FROM b JOIN now ON now.batch = b.batch WHERE so_far IS NULL OR hour >= so_far - 24),
r AS (
  SELECT click_id, n, hour AS start, n AS opener FROM o WHERE n = 1
  UNION ALL
  SELECT o.click_id, o.n, CASE WHEN o.hour > r.start + 48 THEN o.hour ELSE r.start END, CASE WHEN o.hour > r.start + 48 THEN o.n ELSE r.opener END
  FROM r JOIN o ON o.click_id = r.click_id AND o.n = r.n + 1),
x AS (SELECT r.click_id, r.start, r.opener, o.n, o.hash, f.hash AS opens FROM r JOIN o ON o.click_id = r.click_id AND o.n = r.n JOIN o f ON f.click_id = r.click_id AND f.n = r.opener),
w AS (
  SELECT click_id, start AS start_hour, opener, opens, count(*) - 1 AS n_repeats, count(*) FILTER (WHERE hash <> opens) AS n_conflicts,
    CAST(coalesce(sum(CASE WHEN hash <> opens THEN {crc32("hash")} END), 0) AS BIGINT) AS conflict_crc
  FROM x GROUP BY click_id, start, opener, opens),
nxt AS (SELECT w.*, o.batch AS opened, lead(o.batch) OVER (PARTITION BY w.click_id ORDER BY w.opener) AS next_batch FROM w JOIN o ON o.click_id = w.click_id AND o.n = w.opener),
gone AS (SELECT nxt.click_id, nxt.opener, min(now.batch) AS b FROM nxt JOIN now ON now.batch >= nxt.opened AND start_hour + 48 < now.upto - 24 GROUP BY nxt.click_id, nxt.opener)
SELECT nxt.click_id, start_hour, CAST(least(coalesce(gone.b, 9), coalesce(next_batch, 9), 9) AS BIGINT) AS closed_batch, n_repeats, n_conflicts, conflict_crc, opens AS hash
FROM nxt LEFT JOIN gone ON gone.click_id = nxt.click_id AND gone.opener = nxt.opener
""",
    "op12_conversation_repair": repaired_conversations(),
}
