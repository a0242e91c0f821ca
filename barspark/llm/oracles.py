"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

#: Reachability from pairs (x, y) with x < y: the smallest node of each component.
_REACH = """both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x, least(x, min(y)) AS root FROM reach GROUP BY x)"""


def jaccard(n: int, percent: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents WHERE doc_id IS NOT NULL),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= {n} THEN list_distinct(list_transform(generate_series(1, len(ws) - {n - 1}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= {percent} * (nx + ny - c)),
{_REACH},
keys AS (SELECT doc_id, list_sort(s) AS k FROM sets),
same AS (SELECT k, count(*) AS n FROM keys GROUP BY k)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) > 0 THEN same.n ELSE 0 END AS n_same, coalesce(root, sets.doc_id) AS component_id
FROM sets JOIN keys USING (doc_id) JOIN same USING (k) LEFT JOIN least ON least.x = sets.doc_id"""


def near_vectors(least: float) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda c: c * c))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {least}),
{_REACH},
degree AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM v LEFT JOIN degree ON degree.x = vec_id LEFT JOIN least ON least.x = vec_id"""


def repeats(size: int) -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents WHERE doc_id IS NOT NULL),
win AS (SELECT doc_id, unnest(generate_series(1, len(ws) - {size - 1})) AS i, ws FROM w WHERE len(ws) >= {size}),
named AS (SELECT doc_id, i, array_to_string(ws[i:i + {size - 1}], ' ') AS s FROM win),
first_in AS (SELECT s, min(doc_id) AS m FROM named GROUP BY s),
late AS (SELECT doc_id, i FROM named JOIN first_in USING (s) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {size - 1})) AS k FROM late),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


#: CRC-32 of a text's bytes (ASCII digits here), bit by bit.
def _crc32(text: str) -> str:
    bits = f"flatten(list_transform(generate_series(1, length({text})), lambda i: list_transform(generate_series(0, 7), lambda k: (CAST(ascii(substr({text}, CAST(i AS INTEGER), 1)) AS BIGINT) >> k) & 1)))"
    step = "xor(acc >> 1, (xor(acc, b) & 1) * CAST(3988292384 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda acc, b: {step}), CAST(4294967295 AS BIGINT))"


def manifest(fanout: int = 16, depth: int = 6) -> str:
    """Trees of at most fanout ** depth leaves a source, and as many sources."""
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"

    def levels(name: str, source: str) -> list[str]:
        """name0 holds g, i, h, n; each level up has a node for every ``fanout`` of the level below, and left and right siblings of each."""
        out = [f"{name}0 AS ({source})"]
        for k in range(depth):
            run = f"PARTITION BY g, i // {fanout} ORDER BY i ROWS BETWEEN"
            out.append(f"{name}s{k} AS (SELECT g, i, h, n, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, "
                       f"CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT g, i // {fanout} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, "
                       f"(any_value(n) + {fanout - 1}) // {fanout} AS n FROM {name}{k} GROUP BY g, i // {fanout})")
        return out

    def fold(frm: str, name: str, extra: str) -> list[str]:
        """frm0 holds f (folded so far) and p (siblings so far) of each leaf and its place i in tree ``name``."""
        out = []
        for k in range(depth):
            out.append(f"{frm}{k + 1} AS (SELECT {extra}, x.g, x.i // {fanout} AS i, CASE WHEN s.n > 1 THEN sha256(concat(s.l, f, s.r)) ELSE f END AS f, concat(p, s.l, s.r) AS p "
                       f"FROM {frm}{k} x JOIN {name}s{k} s ON x.g = s.g AND x.i = s.i)")
        return out

    text = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [
        f"""leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS h,
  CASE WHEN doc_id IS NOT NULL AND {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(text)} END AS t FROM documents)""",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves)""",
        *levels("a", "SELECT g, i, h, n FROM placed"),
        f"""subs AS (SELECT g AS of, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{depth})""",
        *levels("b", "SELECT '' AS g, i, h, n FROM subs"),
        "x0 AS (SELECT doc_id, h AS leaf, g, i, coalesce(t, h) AS f, '' AS p FROM placed)",
        *fold("x", "a", "doc_id, leaf"),
        f"y0 AS (SELECT doc_id, leaf, subs.h AS subroot, '' AS g, subs.i, f, p FROM x{depth} x JOIN subs ON x.g = subs.of)",
        *fold("y", "b", "doc_id, leaf, subroot"),
    ]
    return ("WITH " + ",\n".join(parts) +
            f"\nSELECT doc_id, leaf, subroot, b.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = b.h AS verified FROM y{depth} y JOIN b{depth} b ON y.g = b.g")


def vector_codes(parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Lloyd's rounds one after the other; distances from dot products of integers in doubles, which are exact."""
    usable = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
    near = ("(SELECT p.vec_id, p.part, p.x, c.entry, p.xx - 2 * list_dot_product(p.x, c.c) + list_dot_product(c.c, c.c) AS d FROM pieces p JOIN book{k} c ON p.part = c.part) "
            "QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1")
    out = [f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE {usable})",
           f"cut AS (SELECT vec_id, unnest(generate_series(0, {parts - 1})) AS part, v, len(v) // {parts} AS w FROM kept)",
           "pieces AS MATERIALIZED (SELECT vec_id, part, v[part * w + 1:part * w + w] AS x, list_dot_product(x, x) AS xx FROM cut)",
           f"book0 AS MATERIALIZED (SELECT part, entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id, x) - 1 AS entry FROM pieces) WHERE entry < {size})"]
    for k in range(rounds):
        out.append(f"near{k} AS MATERIALIZED (SELECT * FROM {near.format(k=k)})")
        out.append(f"mean{k} AS (SELECT part, entry, list(m ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS m FROM (SELECT part, entry, x, unnest(generate_series(1, len(x))) AS i FROM near{k}) GROUP BY ALL) GROUP BY ALL)")
        out.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))")
    out.append(f"last AS MATERIALIZED (SELECT * FROM {near.format(k=rounds)})")
    out.append("codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id)")
    out.append(f"sha AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS s FROM (SELECT part, entry, c, unnest(generate_series(1, len(c))) AS i FROM book{rounds}))")
    return ("WITH " + ",\n".join(out) + "\nSELECT codes.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM codes JOIN kept USING (vec_id), sha")
