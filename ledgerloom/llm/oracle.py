"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from ledgerloom.llm import pipeline

_SPACES = r"[\x20\x09-\x0D]+"



def _crc32(text: str) -> str:
    """crc32 of an ASCII text in SQL, bit by bit."""
    byte = "list_reduce(range(8), lambda x, _: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b))"
    octets = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda crc, b: {byte}, 4294967295::BIGINT), 4294967295)"


# Repair of conversations: e, s, u and a are the cheapest edits so far that leave
# nothing, end in a system turn, in a user's or in an assistant's: cost, audit and
# the turns they leave.  Structs compare by cost, then audit.
def _edited(was: str, letter: str, cost: str, said: str = "NULL") -> str:
    lines = f"{was}.o" if said == "NULL" else f"list_append({was}.o, {said})"
    return f"CASE WHEN {was} IS NOT NULL THEN {{'c': {was}.c + {cost}, 'a': {was}.a || '{letter}', 'o': {lines}}} END"


def _best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


_DELETED = {p: _edited(f"p.{p}", "D", "4") for p in "esua"}
_STAYS = "CASE WHEN NOT r.must_go THEN {} END"


def _stay(was: str, initial: str, role: str) -> str:
    kept = f"CASE WHEN left(r.role, 1) = '{initial}' THEN {_edited(was, 'K', 'r.extra', 'r.said')} ELSE "
    return _STAYS.format(kept + _edited(was, "R", "3 + r.extra", f"'{role}:' || r.text") + " END")


_KEPT_SYSTEM = _STAYS.format(f"CASE WHEN left(r.role, 1) = 's' THEN {_edited('p.e', 'K', 'r.extra', 'r.said')} END")
_CONVERSATIONS = f"""
WITH RECURSIVE damage AS (
  SELECT *, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations
), rows_left AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM damage
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS core
  FROM rows_left
), faults AS (
  SELECT *, core = '' AS blank, core <> '' AND again AS duplicate,
         core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS truncated,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
  FROM numbered
), r AS (
  SELECT coalesce(conv_id::VARCHAR, 'null') AS k, n, role, text, role || ':' || text AS said, blank OR duplicate AS must_go,
         CASE WHEN truncated THEN 3 ELSE 0 END AS extra
  FROM faults
), p AS (
  SELECT DISTINCT coalesce(conv_id::VARCHAR, 'null') AS k, 0::BIGINT AS n,
         {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS e, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR[]) AS s,
         {{'c': 3, 'a': 'I', 'o': ['user:']}} AS u, {{'c': 6, 'a': 'II', 'o': ['user:', 'assistant:']}} AS a
  FROM conversations
  UNION ALL
  SELECT k, n, e, s, u, {_best("a", _edited("u", "I", "3", "'assistant:'"))} AS a
  FROM (
    SELECT k, n, e, s, a, {_best("u", *(_edited(w, "I", "3", "'user:'") for w in ("e", "s", "a")))} AS u
    FROM (
      SELECT p.k, r.n, {_DELETED['e']} AS e, {_best(_DELETED['s'], _KEPT_SYSTEM)} AS s,
             {_best(_DELETED['u'], *(_stay(f"p.{w}", "u", "user") for w in "esa"))} AS u,
             {_best(_DELETED['a'], _stay("p.u", "a", "assistant"))} AS a
      FROM p JOIN r ON r.k = p.k AND r.n = p.n + 1
    )
  )
), done AS (
  SELECT k, {_best("e", "a")} AS w FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS back FROM p) WHERE back = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, w.c::BIGINT AS cost, w.a AS audit,
       sha256(array_to_string(w.o, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i JOIN done ON k = coalesce(i.conv_id::VARCHAR, 'null')
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
"""

_FILTERS = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d
), q AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), m AS (
  SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
       + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
       + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
       + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask,
       coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN q USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), l AS (
  SELECT '' AS o, '' AS letter, 0 AS bit, 0 AS earlier, 0 AS step
  UNION ALL
  SELECT o || f.letter, f.letter, f.bit, earlier | l.bit, step + 1 FROM l JOIN f ON (earlier | l.bit) & f.bit = 0
), s AS (
  SELECT part, o, letter, step,
         coalesce(sum(n) FILTER (WHERE mask & (earlier | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & earlier <> 0 AND mask & bit <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM l, c WHERE step > 0 GROUP BY part, o, letter, step
), x AS (
  SELECT s.part, t.o AS filter_order, s.step, s.letter, s.kept, s.removed, s.redundant, s.unique_fails, s.good_lost, s.toxic_lost
  FROM s JOIN s t ON t.part = s.part AND t.step = 5 AND left(t.o, s.step) = s.o
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM x
"""


def _either(word: str) -> str:
    """A pattern for an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = f"({_NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _spans(kind: str, rank: int, pattern: str, least: int, group: int) -> str:
    """Begin and end of each match whose ``group`` is long enough.

    A match begins where its text comes first after the match before: an earlier place
    of the same text would have been matched there.
    """
    found = f"list_transform(regexp_extract_all(text, '{pattern}'), lambda x: {{'at': 0::BIGINT, 'n': length(x), 'm': x}})"
    sizes = f"list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda g: length(g))"
    onward = "{'at': strpos(substr(text, s.at + s.n + 1), x.m) + s.at + s.n - 1, 'n': x.n, 'm': ''}"
    places = f"list_reduce(m[:i], lambda s, x: {onward}, {{'at': 0, 'n': 0, 'm': ''}})"
    return f"""
  SELECT r, {rank} AS k, '{kind}' AS kind, p.at AS a, p.at + p.n AS z
  FROM (
    SELECT r, unnest(list_transform(range(1, len(m) + 1), lambda i: {places})) AS p, unnest({sizes}) AS size
    FROM (SELECT r, text, {found} AS m FROM d) WHERE len(m) > 0
  ) WHERE size >= {least}"""


_SECRETS = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), found AS ({_spans("assign", 0, _ASSIGN, 12, 2)}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 18, 0)}
  UNION ALL {_spans("hex", 2, "[0-9a-f]{16,}", 16, 0)}
), g AS (
  SELECT r, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans, count(*) FILTER (WHERE k = 0) AS n_assign,
         count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex
  FROM found GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob
FROM d LEFT JOIN g USING (r)
"""

_LINKS = f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, w[j:j + least(3, len(w)) - 1] AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS j FROM w WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), shared AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reached AS (
  SELECT r, r AS t FROM n
  UNION
  SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.t
), least AS (
  SELECT reached.r, min(w.doc_id) AS component_id FROM reached JOIN w ON w.r = reached.t GROUP BY reached.r
), counted AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE component_id END AS component_id,
       coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (r) LEFT JOIN least USING (r) LEFT JOIN counted ON counted.a = w.r
"""

ORACLE = {
    "op2_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op5_decontaminate": f"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda w: w <> '') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), i AS (
  SELECT row_number() OVER () AS i, item_id, least(5, len(w)) AS k, w FROM iw WHERE len(w) > 0
), s AS (
  SELECT DISTINCT i, item_id, k, w[j:j + k - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM i)
), n AS (
  SELECT i, count(*) AS n FROM s GROUP BY i
), ks AS (
  SELECT DISTINCT k FROM i
), d AS (
  SELECT DISTINCT r, doc_id, k, w[j:j + k - 1] AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM dw, ks WHERE len(w) >= k)
)
SELECT d.doc_id, s.item_id, n.n::INT AS n_shingles, count(*)::INT AS n_shared, count(*) / n.n AS containment
FROM s JOIN d USING (k, g) JOIN n USING (i)
GROUP BY d.r, d.doc_id, s.i, s.item_id, n.n
HAVING count(*) >= 0.8 * n.n
""",
    "op7_chat": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('<|' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&bar;') || '|>'
             || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '<|end|>'))::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g
""",
    "op6_secrets": _SECRETS,
    "op10_ngram_join": _LINKS,
    "op11_structure": _CONVERSATIONS,
    "op12_filters": _FILTERS,
}
if pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = pipeline.ORACLE_SQL
