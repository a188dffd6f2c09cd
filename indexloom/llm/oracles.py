"""DuckDB SQL for the results of operators that SQL can express."""

from __future__ import annotations

MERKLE_LEVELS = 9  # 8 ** 9 leaves of a group, and as many groups


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: {byte}), 4294967295)"


def _field(value: str) -> str:
    shown = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({shown}) || ':' || {shown}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def merkle() -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""d AS (SELECT doc_id, lang, {_leaf('text')} AS leaf, {_leaf(low)} AS lowered,
            {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 AS tampered FROM documents)""",
        """l AS (SELECT *, CASE WHEN tampered THEN lowered ELSE leaf END AS shown,
            dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)""",
        "a0 AS (SELECT tree, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS total FROM l)",
    ]

    def climb(name: str) -> None:
        """A tree that is one node stays as it is."""
        for k in range(MERKLE_LEVELS):
            parts.append(
                f"""{name}{k + 1} AS (SELECT tree, pos // 8 AS pos,
                    CASE WHEN max(total) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node,
                    (max(total) + 7) // 8 AS total FROM {name}{k} GROUP BY tree, pos // 8)"""
            )

    def sides(name: str, source: str, key: str, pos: str) -> str:
        """Joined to `source`: what stands left and right of its path on every level."""
        picks, joins = [], []
        for k in range(MERKLE_LEVELS):
            place = f"({pos} // {8**k})"
            parts.append(
                f"""{name}{k}s AS (SELECT x.tree, x.pos, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS lo,
                    coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS hi, max(x.total) AS total
                    FROM {name}{k} x JOIN {name}{k} y ON x.tree = y.tree AND x.pos // 8 = y.pos // 8 GROUP BY x.tree, x.pos)"""
            )
            joins.append(f"JOIN {name}{k}s {name}{k}j ON {name}{k}j.tree = {key} AND {name}{k}j.pos = {place}")
            picks.append(f"{{'lo': {name}{k}j.lo, 'hi': {name}{k}j.hi, 'fold': {name}{k}j.total > 1}}")
        return f"SELECT {source}.*, [{', '.join(picks)}] AS path_{name} FROM {source} {' '.join(joins)}"

    climb("a")
    parts.append(f"b0 AS (SELECT 0 AS tree, tree AS pos, node, count(*) OVER () AS total FROM a{MERKLE_LEVELS})")
    climb("b")
    parts.append(f"la AS ({sides('a', 'l', 'l.tree', 'l.pos')})")
    parts.append(f"lb AS ({sides('b', 'la', '0', 'la.tree')})")
    fold = "shown"
    for path in ("path_a", "path_b"):
        for k in range(1, MERKLE_LEVELS + 1):
            parts.append(
                f"f_{path}{k} AS (SELECT * REPLACE (CASE WHEN {path}[{k}].fold THEN sha256({path}[{k}].lo || shown || {path}[{k}].hi) ELSE shown END AS shown) FROM "
                + ("lb" if (path, k) == ("path_a", 1) else f"f_path_a{MERKLE_LEVELS}" if k == 1 else f"f_{path}{k - 1}")
                + ")"
            )
    both = "list_concat(path_a, path_b)"
    proof = f"sha256(array_to_string(list_transform(list_filter({both}, lambda s: s.fold), lambda s: s.lo || s.hi), ''))"
    return f"""WITH {', '.join(parts)}
        SELECT f.doc_id, f.leaf, t.node AS subroot, r.node AS root, {proof} AS proof_sha256, f.{fold} AS folded_root,
               f.{fold} = r.node AS verified
        FROM f_path_b{MERKLE_LEVELS} f JOIN a{MERKLE_LEVELS} t ON t.tree = f.tree JOIN b{MERKLE_LEVELS} r ON true"""


DECONTAMINATION = r"""WITH
    dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
    x AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM g) lengths WHERE len(w) >= n)),
    h AS (SELECT DISTINCT x.r, x.i, x.n, x.gram FROM x JOIN (SELECT DISTINCT n, gram FROM g) k ON x.n = k.n AND x.gram = k.gram),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
    named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
              FROM (SELECT h.r, CAST(g.item_id AS VARCHAR) AS item FROM h JOIN g ON g.n = h.n AND g.gram = h.gram WHERE g.item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

HARD_NEGATIVES = """WITH
    e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS anchor, a.label AS own, c.id, c.label, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
          FROM e a JOIN e c ON a.id % 50 = 0 AND c.id <> a.id),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM s WHERE label = own QUALIFY place <= 5),
    n AS (SELECT p.anchor AS anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
          FROM p JOIN s ON s.anchor = p.anchor AND s.label <> p.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
          QUALIFY rank <= 3)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n"""

ORACLES = {
    "op11_merkle_manifest": merkle(),
    "op12_decontamination": DECONTAMINATION,
    "op13_hard_negatives": HARD_NEGATIVES,
}
