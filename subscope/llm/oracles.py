"""DuckDB statements for the corpus operators that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH hashed AS (
    SELECT doc_id, length(coalesce(text, '')) AS size,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), judged AS (
    SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST) AS keep_id,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST) AS place
    FROM hashed
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM judged
"""

OP2 = r"""
WITH sized AS (
    SELECT doc_id, coalesce('0' || source, '1') AS name,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 15) AS place,
           substr(md5(coalesce(text, 'null')), 1, 15) AS tie
    FROM documents
), sources AS (
    SELECT name, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(name)) - 1 AS nth
    FROM sized GROUP BY name
), weighed AS (
    SELECT *, [5.0, 2.0, 1.0][nth % 3 + 1]::DOUBLE AS weight, [-0.5, 0.0, 0.5][nth % 3 + 1]::DOUBLE AS tilt,
           source_size * 2.0::DOUBLE AS cap FROM sources
), levels AS (
    SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
), goals AS (
    SELECT *, coalesce(least(weight * (SELECT arg_min(o.level, (o.cap / o.weight, o.nth)) FROM levels o WHERE o.level * o.weight < o.cap
                                       AND (o.cap / o.weight, o.nth) <= (l.cap / l.weight, l.nth)), cap), cap) AS target
    FROM levels l
), steps AS (
    SELECT doc_id, size, name,
           coalesce(sum(size) OVER (PARTITION BY name ORDER BY place, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM sized
), planned AS (
    SELECT s.doc_id, s.size, s.earlier::DOUBLE + s.size::DOUBLE / 2.0::DOUBLE AS middle, g.source_size, g.target, g.tilt,
           CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS rounds
    FROM steps s JOIN goals g USING (name)
), counted AS (
    SELECT *, least(2, rounds + CASE WHEN middle <= target - rounds * source_size THEN 1 ELSE 0 END)::INTEGER AS copies,
           least(1.0::DOUBLE, middle / target) AS used
    FROM planned
)
SELECT doc_id, size, source_size, target, (c.copies * size)::BIGINT AS taken, c.copies,
       CASE WHEN c.copies = 0 THEN NULL WHEN c.target <= 0 THEN 0.0::DOUBLE WHEN c.tilt = 0 THEN c.used
            ELSE (sqrt((1.0::DOUBLE - c.tilt) * (1.0::DOUBLE - c.tilt) + 4.0::DOUBLE * c.tilt * c.used) - (1.0::DOUBLE - c.tilt)) / (2.0::DOUBLE * c.tilt)
       END AS first_position
FROM counted c
"""

OP3 = r"""
WITH whole AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.r <> q.r
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""




def _op8() -> str:
    """Every span of words against every template, word by word; phrases by their places."""
    from subscope.llm.licenses import PHRASES, notices

    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    known = ", ".join(
        f"({n.number}, '{n.label}', {quoted(n.words)}, {quoted(n.telling)}, {n.need}, {n.span})" for n in notices()
    )
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in PHRASES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH notices(t, label, parts, telling, need, span) AS (VALUES {known}), phrases(parts, label) AS (VALUES {phrases}),
docs AS (SELECT doc_id, row_number() OVER () AS r, {lower} AS low FROM documents),
worded AS (SELECT doc_id, r, low, regexp_extract_all(low, '{word}') AS words FROM docs),
places AS (
    SELECT r, label, i FROM (SELECT r, words, unnest(range(len(words))) AS i FROM worded WHERE contains(low, 'license') OR contains(low, 'nc'))
    JOIN phrases ON list_extract(words, i + 1) = parts[1] AND words[i + 1 : i + len(parts)] = parts
),
base AS (
    SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY r
),
tokens AS (SELECT r, unnest(range(len(words))) AS i, unnest(words) AS w FROM worded),
parts AS (SELECT t, label, telling, need, span, len(parts) AS size, unnest(range(1, len(parts) + 1)) AS nth, unnest(parts) AS w FROM notices),
hits AS (SELECT * FROM tokens JOIN parts USING (w)),
able AS (SELECT r, t FROM hits GROUP BY r, t, need HAVING count(DISTINCT w) >= need),
near AS (SELECT hits.* FROM hits JOIN able USING (r, t)),
firsts AS (
    SELECT a.r, a.t, a.label, a.size, a.need, a.telling, a.nth, a.i AS low, b.w, min(b.i) AS place
    FROM near a JOIN near b ON a.r = b.r AND a.t = b.t AND b.i >= a.i AND b.i < a.i + a.span
    WHERE a.nth <= a.size - a.need + 1 GROUP BY ALL
),
met AS (
    SELECT r, t, label, nth, low, max(place) + 1 AS high, count(*) AS shared, count(*)::DOUBLE / size AS share
    FROM firsts GROUP BY r, t, label, nth, low, size, need, telling
    HAVING count(*) >= need AND count(*) FILTER (list_contains(telling, w)) = len(telling)
),
best AS (
    SELECT * FROM met a WHERE NOT EXISTS (
        SELECT 1 FROM met b WHERE a.r = b.r AND b.low < a.high AND a.low < b.high
        AND (b.shared, b.share, -b.nth, b.low - b.high, -b.t, -b.low) > (a.shared, a.share, -a.nth, a.low - a.high, -a.t, -a.low)
    )
),
added AS (SELECT r, list_distinct(list(label)) AS labels, max(share) AS best FROM best GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(list_aggregate(b.labels, 'string_agg', ','), '') AS base_labels,
       coalesce(list_aggregate(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(a.labels, [])))), 'string_agg', ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM worded LEFT JOIN base b USING (r) LEFT JOIN added a USING (r)
"""


def _op11(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds, one after the other, over all vectors and all centroids."""
    parts = [f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
        SELECT sha256('3:' || coalesce(vec_id::VARCHAR, 'null')) AS h, v FROM kept ORDER BY h, v LIMIT {k})
)"""]
    near = """
SELECT r, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v, min((list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, y.c)) AS best
FROM kept x, c{0} y GROUP BY r"""
    for n in range(rounds):
        parts.append(f"""near{n} AS MATERIALIZED ({near.format(n)}
), c{n + 1} AS MATERIALIZED (
    SELECT c, coalesce(list(q ORDER BY d) FILTER (q IS NOT NULL), any_value(old)) AS v FROM (
        SELECT o.c, any_value(o.v) AS old, d, (sum(m.x) - ((sum(m.x) % count(m.x)) + count(m.x)) % count(m.x)) // count(m.x) AS q
        FROM (SELECT c, v, unnest(range(1, 65)) AS d FROM c{n}) o
        LEFT JOIN (SELECT best[2] AS c, unnest(v)::HUGEINT AS x, unnest(range(1, 65)) AS d FROM near{n}) m USING (c, d)
        GROUP BY o.c, d) GROUP BY c
)""")
    parts.append(f"""final AS MATERIALIZED ({near.format(rounds)})
SELECT f.vec_id, f.best[2]::INTEGER AS cluster, f.best[1]::BIGINT AS distance,
       (sum(f.best[1]) OVER (PARTITION BY f.best[2]))::BIGINT AS cluster_inertia, (sum(f.best[1]) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(y.v, ',')) AS centroid_sha256
FROM final f JOIN c{rounds} y ON y.c = f.best[2]""")
    return ", ".join(parts)


def _op13(levels: int = 20) -> str:
    """Level by level: the runs of all nodes, and what each document's place in them adds to its proof.

    ``levels`` unrolls the two trees far enough for 3^20 leaves each.
    """
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # crc32 of the decimal doc_id, bit by bit: DuckDB has no such function
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384::BIGINT) ELSE t >> 1 END))"""
    parts = [f"""
WITH d AS MATERIALIZED (
    SELECT doc_id, source, {leaf('text')} AS leaf,
           CASE WHEN xor({crc}, 4294967295::BIGINT) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS own
    FROM documents
), l0 AS MATERIALIZED (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, '' AS proof, own AS folded FROM d
), n0 AS MATERIALIZED (SELECT tree, spot, leaf AS h FROM l0)"""]
    done = 0
    for tree in ("lower", "upper"):
        if tree == "upper":
            parts.append(f"""l{done + 1} AS MATERIALIZED (SELECT l.* REPLACE (l.tree AS spot, 0 AS tree), n.h AS subroot FROM l{done} l JOIN n{done} n USING (tree)),
n{done + 1} AS MATERIALIZED (SELECT 0 AS tree, tree AS spot, h FROM n{done})""")
            done += 1
        for _ in range(levels):
            parts.append(f"""r{done} AS MATERIALIZED (
    SELECT tree, spot // 3 AS run, list(h ORDER BY spot) AS hs, sum(count(*)) OVER (PARTITION BY tree) AS n FROM n{done} GROUP BY tree, spot // 3),
n{done + 1} AS MATERIALIZED (SELECT tree, run AS spot, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{done}),
l{done + 1} AS MATERIALIZED (
    SELECT l.* REPLACE (
        run AS spot,
        CASE WHEN n > 1 THEN proof || array_to_string(hs[1 : spot % 3] || hs[spot % 3 + 2 :], '') ELSE proof END AS proof,
        CASE WHEN n > 1 THEN sha256(array_to_string(hs[1 : spot % 3] || [folded] || hs[spot % 3 + 2 :], '')) ELSE folded END AS folded)
    FROM l{done} l JOIN r{done} r ON r.tree = l.tree AND r.run = l.spot // 3)""")
            done += 1
    parts.append(f"""last AS (SELECT h AS root FROM n{done})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM l{done}, last""")
    return ", ".join(parts)


def statements() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op2_mixture": OP2, "op3_top_k": OP3, "op8_licenses": _op8(), "op11_clusters": _op11(), "op13_manifest": _op13()}
