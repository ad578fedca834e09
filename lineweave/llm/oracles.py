"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from . import mixing, nndescent, substring

OP2 = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
  l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {nndescent.THRESHOLD}),
  r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
  SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = vec_id AS kept FROM embeddings JOIN r ON r.a = vec_id GROUP BY vec_id"""

OP3 = """WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
  p AS (SELECT t.*, u.turn AS parent FROM t LEFT JOIN t u ON u.conv_id = t.conv_id AND u.role = 'user' AND u.turn = CASE t.role WHEN 'user' THEN t.turn - 2 WHEN 'assistant' THEN t.turn - 1 END),
  d AS (SELECT conv_id, turn, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.conv_id, p.turn, d.depth + 1 FROM d JOIN p ON p.conv_id = d.conv_id AND p.parent = d.turn)
  SELECT conv_id, turn AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn)::INT AS place, depth::BIGINT AS depth,
    CASE WHEN role = 'user' THEN 'call' WHEN role = 'assistant' AND parent IS NULL THEN 'orphan' WHEN role = 'assistant' THEN 'linked' ELSE 'message' END AS status,
    CASE WHEN role = 'user' THEN true END AS valid,
    '{' || CASE WHEN role = 'user' THEN '"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"call_id":"call-' || turn || '",' ELSE '' END || '"content":' || to_json(text) || ','
      || CASE WHEN role = 'user' THEN '"name":"reply",' WHEN role = 'assistant' THEN '"reply_to":"call-' || turn - 1 || '",' ELSE '' END || '"role":"' || role || '"}' AS json
  FROM p JOIN d USING (conv_id, turn)"""

OP5 = rf"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  a AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i : i + {substring.WINDOW - 1}], ' ') AS seq FROM (SELECT doc_id, words, unnest(range(1, len(words) - {substring.WINDOW - 2})) AS i FROM w)),
  f AS (SELECT seq, min(doc_id) AS first FROM a GROUP BY seq),
  g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring.WINDOW})) AS place FROM a JOIN f USING (seq) WHERE first < doc_id),
  h AS (SELECT doc_id, list(place) AS gone FROM g GROUP BY doc_id)
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: gone IS NULL OR NOT list_contains(gone, x[2])), lambda x: x[1]), ' '), '')) AS kept_sha256
  FROM w LEFT JOIN h USING (doc_id)"""


def _mixing() -> str:
    same = {m: f"n.{m} IS NOT DISTINCT FROM g.{m}" for m in mixing.MARGINS}
    parts = [
        r"""d AS MATERIALIZED (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
          CASE WHEN contains(text, '!!') THEN 'shout' WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[0-9]') THEN 'facts' WHEN contains(text, chr(10)) THEN 'essay' ELSE 'note' END AS topic FROM documents)""",
        "n AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t FROM d GROUP BY ALL)",
    ]
    for m in mixing.MARGINS:
        parts.append(f"g_{m} AS (SELECT {m}, CASE WHEN sum(t) > 0 THEN pow(sum(t), {mixing.POWER}) ELSE 0 END AS p FROM n GROUP BY {m})")
        parts.append(f"goal_{m} AS MATERIALIZED (SELECT {m}, p / (SELECT sum(p) FROM g_{m}) AS goal FROM g_{m})")
    joins = " ".join(f"JOIN goal_{m} g{k} ON {same[m].replace('g.', f'g{k}.')}" for k, m in enumerate(mixing.MARGINS))
    parts.append(f"r0 AS MATERIALIZED (SELECT n.source, n.lang, n.topic, n.t, n.t AS w, {', '.join(f'g{k}.goal AS goal_{m}' for k, m in enumerate(mixing.MARGINS))} FROM n {joins})")
    step = 0
    for _ in range(mixing.ROUNDS):
        for m in mixing.MARGINS:
            step += 1
            parts.append(f"r{step} AS MATERIALIZED (SELECT * REPLACE (coalesce(w * goal_{m} / nullif(sum(w) OVER (PARTITION BY {m}), 0), 0) AS w) FROM r{step - 1})")
    rare = " OR ".join(f"sum(t) OVER (PARTITION BY {m}) < {mixing.SMALL} * sum(t) OVER ()" for m in mixing.MARGINS)
    parts.append(f"o AS (SELECT source, lang, topic, w / nullif(t, 0) AS o, {rare} AS rare FROM r{step})")
    parts.append("rates AS (SELECT *, coalesce(least(o / (SELECT coalesce(max(o) FILTER (NOT rare), max(o)) FROM o), 1), 1) AS rate FROM o)")
    draw = "('0x' || substr(md5('mix' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    on = " AND ".join(f"d.{m} IS NOT DISTINCT FROM x.{m}" for m in mixing.MARGINS)
    return f"WITH {', '.join(parts)} SELECT doc_id, d.source, d.lang, d.topic, tokens, round(rate, 6) AS rate, {draw} < rate AS chosen FROM d JOIN rates x ON {on}"


ORACLES = {"op2_embedding_dedup": OP2, "op3_tool_calls": OP3, "op5_substring_dedup": OP5, "op10_mixing": _mixing()}
