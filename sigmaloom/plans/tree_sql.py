"""SQL that grows the same trees as the engines do without noise, for comparison on the driver's tables.

Rows are counted by their bins and target first; what follows works on these few cells. Every step of growth is one common table.
The tables compared have no missing values, so default sides play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from ..operators.statistics import SCALE
from ..operators.trees import TreeSchema, candidate_features


def _accuracy(table: str) -> str:
    """n and accuracy of a table of cells with y, n and the prediction p."""
    return f"SELECT sum(n)::BIGINT AS n, round(sum(CASE WHEN (p >= 0.5) = (y = 1) THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE, 6) AS accuracy FROM {table}"


def _score(g: str, h: str) -> str:
    return f"({g}) * ({g}) / ({h} + 1.0)"


def boosted(schema: TreeSchema, rows: str, growth: str, trees: int, depth: int, rounds: int, rate: float) -> str:
    """Trees on fixed-point gradients and hessians of the logistic loss, clipped at 1, with an L2 weight of 1 and steps of at most 1. Nodes are
    numbered as in a heap."""
    columns = ", ".join(f"b{k}" for k in range(len(schema.features)))
    ctes = [f"m0 AS MATERIALIZED (SELECT {columns}, y, count(*) AS n, 0.0::DOUBLE AS margin FROM ({rows}) GROUP BY ALL)"]
    unit, by = float(SCALE), {"oblivious": "", "leafwise": "", "depthwise": "PARTITION BY node"}[growth]
    for t in range(trees):
        p = "(1 / (1 + exp(-margin)))"
        ctes.append(f"x{t}_0 AS MATERIALIZED (SELECT *, n * round_even(({p} - y) * {unit}, 0) AS g, n * round_even({p} * (1 - {p}) * {unit}, 0) AS h, 0 AS node FROM m{t})")
        for r in range(rounds):
            of, to = f"x{t}_{r}", f"x{t}_{r + 1}"
            sides = " UNION ALL ".join(
                f"SELECT node, {f} AS f, {cut} AS cut, coalesce(sum(g) FILTER (b{f} <= {cut}), 0) / {unit} AS gl, coalesce(sum(h) FILTER (b{f} <= {cut}), 0) / {unit} AS hl, sum(g) / {unit} AS ga, sum(h) / {unit} AS ha FROM {of} WHERE node < {(1 << depth) - 1} GROUP BY node"
                for f, cuts in enumerate(schema.cuts)
                for cut in range(len(cuts))
            )
            gain = f"{_score('gl', 'hl')} + {_score('ga - gl', '(ha - hl)')} - {_score('ga', 'ha')}"
            ctes.append(f"s{t}_{r} AS MATERIALIZED (SELECT node, f, cut, {gain} AS gain FROM ({sides}))")
            if growth == "oblivious":  # one split for all nodes
                ctes.append(f"w{t}_{r} AS MATERIALIZED (SELECT f, cut FROM (SELECT f, cut, sum(gain) AS gain FROM s{t}_{r} GROUP BY ALL) ORDER BY gain DESC, f, cut LIMIT 1)")
                on = "CROSS JOIN"
            else:
                ctes.append(f"w{t}_{r} AS MATERIALIZED (SELECT node, f, cut FROM s{t}_{r} QUALIFY row_number() OVER ({by} ORDER BY gain DESC, node, f, cut) = 1 AND gain > 1e-9)")
                on = "LEFT JOIN"
            right = "CASE f " + " ".join(f"WHEN {k} THEN b{k}" for k in range(len(schema.features))) + " END > cut"
            moved = f"CASE WHEN f IS NULL THEN node ELSE 2 * node + 1 + ({right})::INT END"
            ctes.append(f"{to} AS MATERIALIZED (SELECT {columns}, y, n, margin, g, h, {moved} AS node FROM {of} {on} w{t}_{r}{' USING (node)' if on == 'LEFT JOIN' else ''})")
        ctes.append(f"l{t} AS MATERIALIZED (SELECT node, {rate} * least(greatest(-(sum(g) / {unit}) / (sum(h) / {unit} + 1.0), -1.0), 1.0) AS leaf FROM x{t}_{rounds} GROUP BY node)")
        ctes.append(f"m{t + 1} AS MATERIALIZED (SELECT {columns}, y, n, margin + leaf AS margin FROM x{t}_{rounds} JOIN l{t} USING (node))")
    ctes.append(f"z AS (SELECT y, n, 1 / (1 + exp(-margin)) AS p FROM m{trees})")
    return f"WITH {', '.join(ctes)} {_accuracy('z')}"


def random_forest(schema: TreeSchema, rows: str, trees: int, depth: int, max_features: int, digest: Callable[[str], str], held_out: int | None = None) -> str:
    """Trees on disjoint cells, dealt by a keyed digest of their text; each node's candidates come from the public schedule, and nodes that no
    cell reaches split at their first candidate. held_out: a fold of `rows` that trains nothing and alone is scored."""
    names = [f"b{k}" for k in range(len(schema.features))]
    fold = "" if held_out is None else ", fold"
    columns, text = ", ".join(names) + fold, " || ',' || ".join([*(f"{b}::VARCHAR" for b in names), "(CASE y WHEN 1 THEN '1.0' ELSE '0.0' END)"])
    ctes = [
        f"c AS MATERIALIZED (SELECT {columns}, y, count(*) AS n FROM ({rows}) GROUP BY ALL)",
        f"a0 AS MATERIALIZED (SELECT c.*, t, 0 AS node, ('0x' || substr({digest(text)}, 1, 15))::BIGINT % {trees} = t{f' AND fold <> {held_out}' if fold else ''} AS mine FROM c CROSS JOIN (SELECT unnest(range({trees})) AS t))",
    ]
    pick = "CASE f " + " ".join(f"WHEN {k} THEN {b}" for k, b in enumerate(names)) + " END"
    for level, chosen in enumerate(candidate_features(schema, trees, depth, max_features)):
        layout = ", ".join(f"({t}, {w}, {f}, {cut})" for t, nodes in enumerate(chosen) for w, features in enumerate(nodes) for f in features for cut in range(len(schema.cuts[f])))
        side = lambda y, low: f"coalesce(sum(a.n) FILTER (a.y = {y} AND ({pick} <= cut) = {low}), 0)::DOUBLE"
        ctes.append(f"v{level}(t, node, f, cut) AS (VALUES {layout})")
        ctes.append(
            f"q{level} AS (SELECT v.t, v.node, f, cut, {side(0, 'true')} AS l0, {side(1, 'true')} AS l1, {side(0, 'false')} AS r0, {side(1, 'false')} AS r1 FROM v{level} v LEFT JOIN (SELECT * FROM a{level} WHERE mine) a ON a.t = v.t AND a.node = v.node GROUP BY ALL)"
        )
        half = lambda x: f"CASE WHEN {x}0 + {x}1 > 0 THEN ({x}0 * {x}0 + {x}1 * {x}1) / ({x}0 + {x}1) ELSE 0 END"
        ctes.append(f"w{level} AS MATERIALIZED (SELECT t, node, f, cut FROM q{level} QUALIFY row_number() OVER (PARTITION BY t, node ORDER BY {half('l')} + {half('r')} DESC, f, cut) = 1)")
        ctes.append(f"a{level + 1} AS MATERIALIZED (SELECT {columns}, y, n, t, 2 * node + ({pick} > cut)::INT AS node, mine FROM a{level} JOIN w{level} USING (t, node))")
    ctes.append(f"l AS (SELECT t, node, (coalesce(sum(n) FILTER (mine AND y = 1), 0) + 1)::DOUBLE / (coalesce(sum(n) FILTER (mine), 0) + 2)::DOUBLE AS value FROM a{depth} GROUP BY ALL)")
    ctes.append(f"z AS (SELECT y, any_value(n) AS n, list_reduce(list(value ORDER BY t), lambda a, b: a + b) / {trees} AS p FROM a{depth} JOIN l USING (t, node){f' WHERE fold = {held_out}' if fold else ''} GROUP BY {columns}, y)")
    return f"WITH {', '.join(ctes)} {_accuracy('z')}"
