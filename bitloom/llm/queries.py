"""Queries of this subpackage, one ``opN_<name>`` for each operator, and their SQL."""

from . import counts, language, minhash, neardup, packing, pieces, pii, search, secrets, suffixes


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_pieces": pieces.query,
        "op2_secrets": secrets.query,
        "op3_language": language.query,
        "op4_neardup": neardup.query,
        "op5_pii": pii.query,
        "op6_counts": counts.query,
        "op7_minhash": minhash.query,
        "op8_suffixes": suffixes.query,
        "op9_search": search.query,
        "op10_packing": packing.query,
        "pipeline": _pipeline,
    }


USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

COMPONENTS = """
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

ORACLE = {
    "op4_neardup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND {USABLE}),
edges AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND p.id <> q.id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings),{COMPONENTS},
n AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT comp.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, comp.id = component_id AS kept FROM comp LEFT JOIN n ON n.id = comp.id""",
    "op7_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
nodes AS (SELECT doc_id AS id FROM documents),{COMPONENTS}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM comp LEFT JOIN n ON n.doc_id = id""",
    "op8_suffixes": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, (length(hex(encode(coalesce(text, '')))) // 2)::BIGINT AS n FROM documents),
c AS (SELECT doc_id, j, substr(h, 2 * j + 1, 998) AS h FROM (SELECT doc_id, h, unnest(range(0, n - 99, 400)) AS j FROM d WHERE n >= 100)),
g AS MATERIALIZED (SELECT doc_id, i + j AS i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, j, unnest(range(least(400, length(h) // 2 - 99))) AS i FROM c)),
w AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM g) WHERE nth > 1),
t AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS new FROM w),
u AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM t),
s AS MATERIALIZED (SELECT doc_id, s, min(i) AS a, max(i) + 100 AS b FROM u GROUP BY doc_id, s),
p AS (SELECT doc_id, b AS x, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
q AS (SELECT p.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, n) - x)), '' ORDER BY x) AS kept FROM p JOIN d USING (doc_id) GROUP BY p.doc_id),
r AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "op9_search": f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE {USABLE}),
d AS (SELECT q.id AS query_id, c.id AS vec_id, sqrt(list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.id % 100 = 0 AND c.id <> q.id AND len(q.x) = len(c.x))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d) WHERE rank <= 10""",
}


def _secrets_sql() -> str:
    """Offsets from the lengths of gaps and matches; the patterns are stated anew, for RE2, which doesn't look around."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    run = "[A-Za-z0-9+/_-]"
    patterns = [
        rf"""(?:{words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "AKIA[A-Z0-9]+",
        "[0-9a-f]{32,}",
        r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----",
        run + "{24,}={0,2}",
    ]
    quoted = ["'" + p.replace("'", "''") + "'" for p in patterns]
    parts = " UNION ALL ".join(f"SELECT rid, doc_id, owner, repo, {k} AS kind, string_split_regex(t, {q}) AS ps, regexp_extract_all(t, {q}) AS hs FROM d" for k, q in enumerate(quoted))
    kinds = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(("assign", "access", "hex", "vendor", "generic"))) + " END"
    write = f"string_agg({kinds} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    live = lambda v: f"(length({v}) >= 12 AND len(list_distinct(string_split({v}, ''))) >= least(8, length({v})) AND NOT regexp_matches({v}, '(?i)example|sample|changeme|placeholder|dummy|your[_-]|xxxx|0123456789|abcdef0123'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(lang, '') AS repo, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
u AS (SELECT rid, doc_id, owner, repo, kind, hs[i] AS hit, (coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM m)),
v AS (SELECT *, start + length(hit) AS stop, CASE WHEN kind = 0 THEN regexp_extract(hit, {quoted[0]}, 1) ELSE hit END AS value FROM u),
f AS (SELECT * FROM v WHERE CASE kind WHEN 0 THEN length(value) >= 8 WHEN 1 THEN length(value) >= 16 WHEN 4 THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') ELSE true END),
c AS (SELECT * FROM f WHERE kind < 4 OR NOT EXISTS (SELECT 1 FROM f g WHERE g.rid = f.rid AND g.kind < 4 AND g.start < f.stop AND f.start < g.stop)),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM c GROUP BY value),
s AS (SELECT c.*, owners, repos, {live('value')} AS live FROM c JOIN o USING (value) WHERE kind < 4 OR owners = 1),
r AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {write} FILTER (kind < 3) AS base, {write} AS spans, count(*) AS n, count(*) FILTER (owners >= 3 AND repos >= 4) AS copied, count(*) FILTER (owners = 1) AS owned, count(*) FILTER (owners = 1 AND live) AS live, count(*) FILTER (repos = 1) AS single, max(repos) AS most FROM s GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
coalesce(n, 0)::BIGINT AS n_spans, coalesce(copied, 0)::BIGINT AS n_copied, coalesce(owned, 0)::BIGINT AS n_owned, coalesce(live, 0)::BIGINT AS n_live, coalesce(single, 0)::BIGINT AS n_single, coalesce(most, 0)::BIGINT AS most_repos FROM d LEFT JOIN r USING (rid)"""


ORACLE["op2_secrets"] = _secrets_sql()


def oracle_sql() -> dict:
    """SQL of the operators that SQL can express; the others are tested against libraries and brute force."""
    return dict(ORACLE)
