"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from .queries import MIXTURE, SHARDS, TABLE_SIZE

_HEX = "CAST('0x' || substr(md5({text}), {first}, 8) AS BIGINT)"


def sharding_sql(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> str:
    rows = ", ".join(f"({k}, '{name}')" for k, name in enumerate(shards))
    return f"""
WITH RECURSIVE s(k, shard) AS (VALUES {rows}),
prefers AS (SELECT list(struct_pack(o := {_HEX.format(text="shard", first=1)} % {size}, st := {_HEX.format(text="shard", first=9)} % {size - 1} + 1) ORDER BY k) AS p FROM s),
turns(t, free, slot) AS (
  SELECT CAST(-1 AS BIGINT), range(0, {size}), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT n, list_filter(free, lambda x: x <> best), best FROM (
    SELECT t + 1 AS n, free, CAST(list_min(list_transform(free, lambda x: {{'r': (((x - p[CAST((t + 1) % {len(shards)} AS BIGINT) + 1].o) * p[CAST((t + 1) % {len(shards)} AS BIGINT) + 1].st) % {size} + {size}) % {size}, 's': x}})).s AS BIGINT) AS best
    FROM turns, prefers WHERE t + 1 < {size})),
lookup AS (SELECT slot, t % {len(shards)} AS k FROM turns WHERE t >= 0)
SELECT d.doc_id, l.slot, s.shard FROM (SELECT doc_id, {_HEX.format(text="coalesce(CAST(doc_id AS VARCHAR), '')", first=1)} % {size} AS slot FROM documents) d JOIN lookup l USING (slot) JOIN s ON s.k = l.k
"""


TOKENS = "CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT)"


def _case(level: str, path: Sequence[str]) -> str:
    full = " || '/' || ".join(path)
    paths = [f"WHEN {full} = '{k}' THEN {v}" for k, v in MIXTURE.weights.items() if "/" in k or len(path) == 1]
    names = [f"WHEN {level} = '{k}' THEN {v}" for k, v in MIXTURE.weights.items() if "/" not in k]
    return f"CASE {' '.join(paths + names)} ELSE {MIXTURE.default_weight} END"


def mixing_ctes(docs: str, mix=MIXTURE) -> str:
    """CTEs from `docs` (doc_id, text, levels..) to `chosen`."""
    levels = list(mix.levels)
    path = ", ".join(levels)
    up, down = mix.budget_share
    seed = mix.seed
    text = f"""
slim AS (SELECT doc_id, {path}, {TOKENS} AS n_tokens, {_HEX.format(text=f"'{seed}/' || doc_id", first=1)} % {mix.buckets} AS bucket FROM {docs}),
leaf AS (SELECT {path}, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {mix.max_epochs} AS BIGINT) AS cap FROM slim GROUP BY ALL),
given0 AS (SELECT least(coalesce(sum(tokens), 0) * {up} // {down}, coalesce(sum(cap), 0)) AS budget FROM leaf),"""
    for depth in range(1, len(levels) + 1):
        own, up_path = levels[:depth], levels[: depth - 1]
        part = f"PARTITION BY {', '.join(up_path)}" if up_path else ""
        join = f"JOIN given{depth - 1} g USING ({', '.join(up_path)})" if up_path else f"CROSS JOIN given{depth - 1} g"
        name = own[-1]
        text += f"""
n{depth} AS (SELECT n.*, g.budget AS b FROM (SELECT {', '.join(own)}, sum(cap) AS cap, {_case(name, own)} AS w FROM leaf GROUP BY {', '.join(own)}) n {join}),
o{depth} AS (SELECT *, coalesce(sum(cap) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM n{depth} WINDOW x AS ({part} ORDER BY cap / w, {name})),
p{depth} AS (SELECT *, (b - before) * w >= cap * after AS f FROM o{depth}),
q{depth} AS (SELECT *, b - coalesce(sum(cap) FILTER (f) OVER ({part}), 0) AS lft, sum(w) FILTER (NOT f) OVER ({part}) AS opn FROM p{depth}),
r{depth} AS (SELECT *, CASE WHEN f THEN cap ELSE lft * w // opn END AS fl, CASE WHEN f THEN -1 ELSE lft * w % opn END AS rest FROM q{depth}),
s{depth} AS (SELECT *, b - sum(fl) OVER ({part}) AS spare, row_number() OVER ({part} ORDER BY rest DESC, {name}) AS turn FROM r{depth}),
given{depth} AS (SELECT {', '.join(own)}, fl + CASE WHEN turn <= spare AND rest > 0 THEN 1 ELSE 0 END AS budget FROM s{depth}),"""
    return text + f"""
epochs AS (SELECT {path}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full_epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaf JOIN given{len(levels)} USING ({path})),
ordered AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {path} ORDER BY md5('{seed}/' || full_epochs || '/b/' || bucket), bucket, md5('{seed}/' || full_epochs || '/d/' || doc_id), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM slim JOIN epochs USING ({path})),
chosen AS (SELECT doc_id, {path}, n_tokens, CAST(full_epochs AS BIGINT) AS full_epochs, CAST(greatest(0, least(n_tokens, rest - start)) AS BIGINT) AS partial_tokens, CAST(n_tokens * full_epochs + greatest(0, least(n_tokens, rest - start)) AS BIGINT) AS tokens_used, start FROM ordered)"""


DOMAIN = "'domain' || coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS BIGINT) % 4, 0)"


def mixing_sql() -> str:
    docs = f"(SELECT doc_id, text, coalesce({DOMAIN}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)"
    return f"WITH {mixing_ctes(docs)} SELECT * EXCLUDE (start) FROM chosen"


_RUN = "regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def lexical_search_sql(k: int = 10) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_RUN} AS words FROM documents),
t AS (SELECT doc_id, len(words) AS n, unnest(words) AS word FROM d),
tf AS (SELECT doc_id, n, {_LOWER.format("word")} AS term, count(*) AS tf FROM t GROUP BY ALL),
whole AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM d WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, {_LOWER.format(f"unnest({_RUN})")} AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN whole WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) CROSS JOIN whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}
"""


def vector_codes_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One CTE for each assignment and each codebook."""
    text = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM kept CROSS JOIN range({parts}) r(p)),
book0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM cut) WHERE e < {entries})"""
    for k in range(rounds + 1):
        text += f""",
near{k} AS MATERIALIZED (SELECT vec_id, label, p, v, min(struct_pack(far := far, e := e)) AS best FROM (
  SELECT c.vec_id, c.label, c.p, c.v, b.e, CAST(list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far FROM cut c JOIN book{k} b USING (p)) GROUP BY ALL)"""
        if k < rounds:
            text += f""",
mean{k} AS (SELECT p, e, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS v FROM (
  SELECT p, best.e AS e, i, sum(v[i]) AS s, count(*) AS n FROM near{k}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)"""
    return text + f""",
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM near{rounds} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": mixing_sql(), "op9_lookup_sharding": sharding_sql(), "op11_partial_distance": vector_codes_sql(), "op12_block_max_wand": lexical_search_sql()}
