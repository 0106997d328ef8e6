"""DuckDB SQL for the queries that SQL can say."""

from __future__ import annotations

from millrace.llm.secrets import ALLOWED, BASE, CLASSES, SCALE


def centroid_sql(count: int, rounds: int, size: int = 64, scale: int = 256) -> str:
    """Clusters of ``embeddings`` by all distances, round after round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, min(d) AS distance, arg_min(c, d * {count} + c) AS cluster FROM (
          SELECT vec_id, k.v, c, list_sum([(k.v[i] - m.v[i]) * (k.v[i] - m.v[i]) FOR i IN range(1, {size + 1})]) AS d FROM k, c{r} m)
        GROUP BY vec_id, v)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, m.v) AS v FROM c{r} m LEFT JOIN (
          SELECT cluster AS c, list(x ORDER BY i) AS v FROM (SELECT cluster, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x
            FROM a{r}, range(1, {size + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster) n USING (c))""")
    return f"""WITH k AS MATERIALIZED (SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
        FROM embeddings WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM k QUALIFY c < {count}),
      {", ".join(steps[:-1])}
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
      CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} m ON m.c = cluster"""


def secrets_sql() -> str:
    """Spans of ``documents``: each kind takes a text apart, and lengths add up to places."""
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def plain(pattern: str) -> str:  # no possessive or look-behind forms; what they leave out is too short to be kept
        return pattern.replace("*+", "*").replace("(?<![0-9a-f])[0-9a-f]{24,}+", "[0-9a-f]+")

    harmless = "|".join(ALLOWED)
    rules = [(kind, plain(head), plain(value), f"length(v) >= {least}") for kind, (head, value, least) in BASE.items()]
    for c in CLASSES:
        sums = f"""list_sum([CAST(round(n * log2(n) * {SCALE}) AS BIGINT) FOR n IN
            [len([1 FOR y IN w IF y = x]) FOR x IN list_distinct(w)]])"""
        least = f"list_min([{sums} FOR w IN [string_split(substr(v, i, {c.window}), '') FOR i IN range(1, length(v) - {c.window - 2})]])"
        rules.append((c.kind, "", f"[{c.characters}]+", f"""length(v) >= {c.window} AND NOT regexp_full_match(v, {quoted(harmless)})
            AND log2({c.window}) - {least} / {float(c.window * SCALE)} >= {c.bits}"""))
    steps, source = [], "text"
    for i, (kind, head, value, kept) in enumerate(rules):
        whole = quoted(f"(?s)(.*?)(?:({head})({value})|\\z)")

        def cut(text: str, kept=kept, whole=whole) -> str:
            g, h, v = (f"regexp_extract_all({text}, {whole}, {n})" for n in (1, 2, 3))
            return f"""[{{'g': p[1], 'm': p[2] || p[3], 'k': list_transform([p[3]], lambda v: {kept})[1]}} FOR p IN list_zip({g}, {h}, {v})]"""

        own = "text" if kind in BASE else source
        steps.append(f"p{i} AS MATERIALIZED (SELECT *, {cut(own)} AS p_{i}{'' if own == source else f', {cut(source)} AS q_{i}'} FROM {'docs' if not i else f'r{i - 1}'})")
        blank = f"p_{i}" if own == source else f"q_{i}"
        steps.append(f"""r{i} AS MATERIALIZED (SELECT * EXCLUDE (p_{i}{'' if own == source else f', q_{i}'}),
          array_to_string([x.g || CASE WHEN x.k THEN repeat(' ', length(x.m)) ELSE x.m END FOR x IN {blank}], '') AS rest_{i},
          [{{'s': list_sum([length(y.g) + length(y.m) FOR y IN p_{i}[:j]]) - length(p_{i}[j].m), 'r': {i}, 'kind': '{kind}',
             'e': list_sum([length(y.g) + length(y.m) FOR y IN p_{i}[:j]])}} FOR j IN range(1, len(p_{i}) + 1) IF p_{i}[j].k] AS s_{i} FROM p{i})""")
        source = f"rest_{i}"
    text = "array_to_string([x.kind || ':' || x.s || ':' || x.e FOR x IN list_sort({})], ',')"
    base = text.format(" || ".join(f"s_{i}" for i in range(len(BASE))))
    counts = ", ".join(f"CAST(len(s_{i}) AS BIGINT) AS n_{kind}" for i, kind in enumerate(BASE))
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(steps)}
    SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {text.format(" || ".join(f"s_{i}" for i in range(len(rules))))} AS spans
    FROM r{len(rules) - 1}"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    def bit(crc: str) -> str:
        return f"CASE WHEN {crc} & 1 = 1 THEN xor({crc} >> 1, 3988292384) ELSE {crc} >> 1 END"

    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(ch)::BIGINT FOR ch IN string_split({text}, '')]),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, n: {bit('x')})))"""


def trie_sql() -> str:
    """Nodes of rebuilt ``conversations``, each prefix a list of turns; subtrees by comparing prefixes."""
    return f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
      k AS (SELECT c, count(*) AS n, {_crc32('c::VARCHAR')} % 9 AS h FROM t GROUP BY c),
      l AS (SELECT k.c, k.h, least(k.h, coalesce(r.n, 0)) AS shared FROM k LEFT JOIN k r ON r.c = k.c - k.c % 5),
      turns AS (SELECT t.c, pos - h + shared AS d, role, text FROM t JOIN l ON l.c = t.c WHERE pos > h
        UNION ALL SELECT l.c, pos, role, text FROM l JOIN t ON t.c = l.c - l.c % 5 WHERE pos <= h),
      own AS (SELECT c, list({{'r': role, 't': text}} ORDER BY d) AS s FROM turns GROUP BY c),
      seqs AS (SELECT k.c, coalesce(s, []) AS s FROM k LEFT JOIN own USING (c)),
      node AS MATERIALIZED (SELECT s[:d] AS p, d, min(c) AS conv_id, count(*) AS n,
          coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(s) = d), '') AS ends
        FROM seqs, unnest(range(0, len(s) + 1)) u(d) GROUP BY ALL),
      kids AS (SELECT p[:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
      below AS (SELECT a.p, count(*) FILTER (WHERE kids.n IS NULL) AS leaves,
          sum((b.n - 1) * CASE WHEN b.d = 0 THEN 0 ELSE strlen(b.p[b.d].t) END) AS saved
        FROM node b LEFT JOIN kids ON kids.p = b.p, unnest(range(0, b.d + 1)) u(e) JOIN node a ON a.p = b.p[:e] GROUP BY a.p)
    SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs,
      CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
      sha256(node.ends) AS ends_sha256
    FROM node JOIN below ON below.p = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN node up ON node.d > 0 AND up.p = node.p[:node.d - 1]"""


ORACLES = {"op11_centroids": centroid_sql(40, 5), "op12_secrets": secrets_sql(), "op13_prefix_trie": trie_sql()}
