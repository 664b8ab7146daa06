"""DuckDB SQL of the analysis queries, written from the operators' definitions: training parts are listed, not subtracted."""

from __future__ import annotations

from ..functions.linear import solved_sql
from ..functions.stats import critical_z, erfc_sql
from ..operators.adjust import METHODS

K, RUNS = 5, 20
Z05 = critical_z(0.05)
TINY = "CAST(1e-8 AS DOUBLE)"


def r6(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _v(i: int) -> str:
    return f"CAST(embedding[{i + 1}] AS DOUBLE)"


S = f"s AS (SELECT vec_id AS sample_id, embedding, {_v(0)} + {_v(1)} + {_v(2)} - {_v(3)} - {_v(4)} + CAST(0.5 AS DOUBLE) * {_v(60)} AS y, {_v(60)} AS c1, {_v(61)} AS c2 FROM embeddings)"
SB = S.replace("s AS", "s0 AS", 1) + ",\ns AS (SELECT sample_id, embedding, CAST(y > (SELECT median(y) FROM s0) AS DOUBLE) AS y, c1, c2 FROM s0)"
E_ = "e AS (SELECT sample_id, CAST(i - 1 AS INTEGER) AS edge_id, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT sample_id, embedding, unnest(range(1, 56)) AS i FROM s))"


def fold(k: int = K, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"f AS (SELECT sample_id, CAST((row_number() OVER ({part}ORDER BY md5('fold:42:' || sample_id), sample_id) - 1) % {k} AS INTEGER) AS sample_fold FROM s)"


ROLES = f"roles AS (SELECT k.fold, s.sample_id, f.sample_fold = k.fold AS is_test, s.y, s.c1, s.c2 FROM s JOIN f USING (sample_id), (SELECT CAST(unnest(range({K})) AS INTEGER) AS fold) k)"
TRAIN = "t AS (SELECT r.fold, e.edge_id, r.sample_id, e.value AS x, r.y, r.c1, r.c2 FROM e JOIN roles r USING (sample_id) WHERE NOT r.is_test)"
RANKED = """t0 AS (SELECT * FROM t),
tr AS (SELECT fold, edge_id, sample_id, CAST(row_number() OVER (PARTITION BY fold, edge_id ORDER BY x, sample_id) AS DOUBLE) AS x,
       CAST(row_number() OVER (PARTITION BY fold, edge_id ORDER BY y, sample_id) AS DOUBLE) AS y,
       CAST(row_number() OVER (PARTITION BY fold, edge_id ORDER BY c1, sample_id) AS DOUBLE) AS c1, c2 FROM t0)"""


def _z(r: str, k: int) -> str:
    df = f"(n - 2 - {k})"
    c = f"greatest(least({r}, CAST(0.999999 AS DOUBLE)), CAST(-0.999999 AS DOUBLE))"
    return f"({c} * sqrt({df} / (1 - {c} * {c})) / sqrt(CAST({df} AS DOUBLE) / ({df} + 1)))"


def stat(k: int = 0, source: str = "t") -> str:
    """st: fold, edge_id, n, r, z."""
    base = f"m AS (SELECT fold, edge_id, count(*) AS n, corr(x, y) AS xy, corr(x, c1) AS x1, corr(y, c1) AS y1, corr(x, c2) AS x2, corr(y, c2) AS y2, corr(c1, c2) AS c12 FROM {source} GROUP BY fold, edge_id)"
    if k == 0:
        body = "SELECT fold, edge_id, n, xy AS r, xy AS pr FROM m"
    elif k == 1:
        body = "SELECT fold, edge_id, n, (xy - x1 * y1) / sqrt(1 - x1 * x1) AS r, (xy - x1 * y1) / sqrt((1 - x1 * x1) * (1 - y1 * y1)) AS pr FROM m"
    else:
        one = "m1 AS (SELECT *, (xy - x1 * y1) / sqrt((1 - x1 * x1) * (1 - y1 * y1)) AS pxy, (x2 - x1 * c12) / sqrt((1 - x1 * x1) * (1 - c12 * c12)) AS px2, (y2 - y1 * c12) / sqrt((1 - y1 * y1) * (1 - c12 * c12)) AS py2 FROM m)"
        full = "(pxy - px2 * py2) / sqrt((1 - px2 * px2) * (1 - py2 * py2))"
        return f"{base},\n{one},\npr AS (SELECT fold, edge_id, n, {full} AS pr, {full} * sqrt((1 - y1 * y1) * (1 - py2 * py2)) AS r FROM m1),\nst AS (SELECT fold, edge_id, n, r, {_z('pr', 2)} AS z FROM pr)"
    return f"{base},\npr AS ({body}),\nst AS (SELECT fold, edge_id, n, r, {_z('pr', k)} AS z FROM pr)"


MASK = f"mask AS (SELECT fold, edge_id, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS network FROM st WHERE abs(z) > CAST({Z05!r} AS DOUBLE))"
P = f"p AS (SELECT fold, edge_id, r, z, least(1.0, {erfc_sql('abs(z) / sqrt(CAST(2 AS DOUBLE))')}) AS p FROM st)"
NETWORK = "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END"
STRENGTH = """st1 AS (SELECT m.fold, e.sample_id, sum(value) FILTER (network = 'positive') AS pos, sum(value) FILTER (network = 'negative') AS neg FROM mask m JOIN e USING (edge_id) GROUP BY 1, 2),
rows0 AS (SELECT r.*, coalesce(pos, 0.0) AS pos, coalesce(neg, 0.0) AS neg FROM roles r LEFT JOIN st1 USING (fold, sample_id))"""


def _gram(features: list[str], target: str, source: str, keys: str, name: str, where: str = "NOT is_test") -> str:
    f = ["CAST(1 AS DOUBLE)", *features]
    cols = [f"sum({a} * {f[j]}) AS g_{i}_{j}" for i, a in enumerate(f) for j in range(i, len(f))] + [f"sum({a} * {target}) AS b_{i}" for i, a in enumerate(f)]
    return f"{name}g AS (SELECT {keys}, {', '.join(cols)} FROM {source} WHERE {where} GROUP BY {keys}),\n" + solved_sql(f"{name}g", keys, len(f), name)


def residual(keys: str = "fold") -> str:
    fits = ",\n".join(_gram(["c1", "c2"], x, "rows0", keys, name) for x, name in (("pos", "rp"), ("neg", "rn")))
    own = "pos - (rp.beta_0 + rp.beta_1 * c1 + rp.beta_2 * c2) AS pos_res, neg - (rn.beta_0 + rn.beta_1 * c1 + rn.beta_2 * c2) AS neg_res"
    return f"{fits},\nrows1 AS (SELECT rows0.*, {own} FROM rows0 JOIN rp USING ({keys}) JOIN rn USING ({keys}))"


def design(keys: str = "fold") -> str:
    parts = []
    zero = "CAST(0 AS DOUBLE)"
    for network in ("positive", "negative", "both"):
        p, n = network != "negative", network != "positive"
        raw, res = (["pos" if p else zero, "neg" if n else zero], ["pos_res" if p else zero, "neg_res" if n else zero])
        for model, f in (("connectome", [*raw, zero, zero]), ("covariates", [zero, zero, "c1", "c2"]), ("full", [*raw, "c1", "c2"]), ("residuals", [*res, zero, zero])):
            parts.append(f"SELECT {keys}, sample_id, is_test, y, '{model}' AS model, '{network}' AS network, " + ", ".join(f"{c} AS f{i + 1}" for i, c in enumerate(f)) + " FROM rows1")
    return "d AS (" + " UNION ALL ".join(parts) + ")"


def predicted(keys: str = "fold") -> str:
    by = f"{keys}, model, network"
    fit = _gram(["f1", "f2", "f3", "f4"], "y", "d", by, "co")
    return f"{fit},\npred AS (SELECT {by}, sample_id, y AS y_true, beta_0 + beta_1 * f1 + beta_2 * f2 + beta_3 * f3 + beta_4 * f4 AS y_pred FROM d JOIN co USING ({by}) WHERE is_test)"


FEATURES = 4


def grown(trees: int, depth: int, bins: int = 32) -> tuple[str, ...]:
    """pred: what trees of equal ranges say; a level is a table of each row's node in each tree."""
    by, f = "fold, model, network", range(1, FEATURES + 1)
    at = [f"CAST(greatest(0, least({bins - 1}, coalesce(floor((f{i} - lo{i}) * {bins} / nullif(hi{i} - lo{i}, 0)), 0))) AS INTEGER) AS b{i}" for i in f]
    ends = ", ".join(f"min(f{i}) FILTER (NOT is_test) AS lo{i}, max(f{i}) FILTER (NOT is_test) AS hi{i}" for i in f)
    u = "CAST(CAST('0x' || substr(md5('tree:42:' || tree || ':' || sample_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"
    times = " + ".join(f"CAST({u} >= {p} AS INTEGER)" for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676))
    out = [
        "dd AS (SELECT * FROM d WHERE model IN ('connectome', 'full'))",
        f"ends AS (SELECT {by}, {ends} FROM dd GROUP BY ALL)",
        f"bb AS (SELECT {by}, sample_id, is_test, y, {', '.join(at)} FROM dd JOIN ends USING ({by}))",
        f"n0 AS MATERIALIZED (SELECT *, {times if trees > 1 else 1} AS w, 1 AS node FROM bb, (SELECT unnest(range({trees})) AS tree))",
    ]
    for k in range(depth):
        each = " UNION ALL ".join(f"SELECT {by}, tree, node, w, y, {i - 1} AS feature, b{i} AS b FROM n{k} WHERE NOT is_test AND w > 0 AND node >= {1 << k}" for i in f)
        cut = " ".join(f"WHEN {i - 1} THEN b{i}" for i in f)
        out += [
            f"e{k} AS (SELECT {by}, tree, node, feature, b, sum(w) AS n, sum(w * y) AS s FROM ({each}) GROUP BY ALL)",
            f"c{k} AS (SELECT *, sum(n) OVER o AS n0, sum(s) OVER o AS s0, sum(n) OVER (o ORDER BY b) AS n1, sum(s) OVER (o ORDER BY b) AS s1 FROM e{k} WINDOW o AS (PARTITION BY {by}, tree, node, feature))",
            f"g{k} AS (SELECT *, round(s1 * s1 / n1 + (s0 - s1) * (s0 - s1) / (n0 - n1) - s0 * s0 / n0, 6) AS gain FROM c{k} WHERE n1 < n0)",
            f"x{k} AS (SELECT {by}, tree, node, feature, b AS cut FROM g{k} WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY {by}, tree, node ORDER BY gain DESC, feature, b) = 1)",
            f"n{k + 1} AS MATERIALIZED (SELECT n.* EXCLUDE (node), CASE WHEN feature IS NULL THEN node ELSE 2 * node + CAST(CASE feature {cut} END > cut AS INTEGER) END AS node FROM n{k} n LEFT JOIN x{k} USING ({by}, tree, node))",
        ]
    out.append(f"v AS (SELECT {by}, tree, node, CAST(sum(w * y) AS DOUBLE) / sum(w) AS v FROM n{depth} WHERE NOT is_test AND w > 0 GROUP BY ALL)")
    out.append(f"guess AS (SELECT {by}, sample_id, y AS y_true, avg(v) AS y_pred FROM n{depth} JOIN v USING ({by}, tree, node) WHERE is_test GROUP BY {by}, sample_id, y)")
    return tuple(out)


def basis_sums(knots: int = 10) -> tuple[str, ...]:
    """sums: products of cubic B-splines; a basis function is listed where it isn't 0, or is next to that."""
    by, f = "fold, model, network", range(1, FEATURES + 1)
    ends = ", ".join(f"min(f{i}) FILTER (NOT is_test) AS lo{i}, max(f{i}) FILTER (NOT is_test) AS hi{i}" for i in f)
    at = " UNION ALL ".join(f"SELECT {by}, sample_id, y, {1 + (i - 1) * knots} AS k, greatest(0.0, least(1.0, coalesce((f{i} - lo{i}) / nullif(hi{i} - lo{i}, 0), 0.0))) * {knots - 3} AS t FROM dd JOIN ends USING ({by}) WHERE NOT is_test" for i in f)
    values = "(VALUES (0, (1 - u) * (1 - u) * (1 - u) / 6), (1, (3 * u * u * u - 6 * u * u + 4) / 6), (2, (-3 * u * u * u + 3 * u * u + 3 * u + 1) / 6), (3, u * u * u / 6)) b(j, v)"
    return (
        "dd AS (SELECT * FROM d WHERE model IN ('connectome', 'full'))",
        f"ends AS (SELECT {by}, {ends} FROM dd GROUP BY ALL)",
        f"pl AS (SELECT *, CAST(least(floor(t), {knots - 4}) AS INTEGER) AS s, t - least(floor(t), {knots - 4}) AS u FROM ({at}))",
        f"en AS MATERIALIZED (SELECT {by}, sample_id, y, k + s + j AS i, v FROM pl, LATERAL (SELECT * FROM {values}) UNION ALL SELECT {by}, sample_id, y, 0, 1.0 FROM dd WHERE NOT is_test)",
        f"sums AS (SELECT {by}, a.i, b.i AS j, sum(a.v * b.v) AS total FROM en a JOIN en b USING ({by}, sample_id) WHERE a.i <= b.i GROUP BY ALL UNION ALL SELECT {by}, i, -1, sum(v * y) FROM en GROUP BY ALL UNION ALL SELECT {by}, -1, -1, sum(y * y) FROM dd WHERE NOT is_test GROUP BY ALL)",
    )


def reweighted(rounds: int) -> tuple[str, ...]:
    """b<rounds>: coefficients of y on pos and neg after so many steps from 0."""
    f = ("1.0", "pos", "neg")
    out = ["b0 AS (SELECT DISTINCT fold, CAST(0 AS DOUBLE) AS k0, CAST(0 AS DOUBLE) AS k1, CAST(0 AS DOUBLE) AS k2 FROM rows0)"]
    for k in range(rounds):
        p = "1 / (1 + exp(-(k0 + k1 * pos + k2 * neg)))"
        sums = ", ".join([f"sum({a} * {f[j]} * greatest(p * (1 - p), 1e-8)) AS g_{i}_{j}" for i, a in enumerate(f) for j in range(i, 3)] + [f"sum({a} * (y - p)) AS b_{i}" for i, a in enumerate(f)])
        out.append(f"lg{k} AS (SELECT fold, {sums} FROM (SELECT *, {p} AS p FROM rows0 JOIN b{k} USING (fold) WHERE NOT is_test) GROUP BY fold)")
        out.append(solved_sql(f"lg{k}", "fold", 3, f"ls{k}"))
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT fold, k0 + beta_0 AS k0, k1 + beta_1 AS k1, k2 + beta_2 AS k2 FROM b{k} JOIN ls{k} USING (fold))")
    return tuple(out)


BASE = (S, E_, fold(), ROLES, TRAIN, stat())
CHAIN = (*BASE, MASK, STRENGTH, residual(), design(), predicted())


def reg(source: str, keys: str, digits: int = 6) -> str:
    ev = f"1 - var_pop(y_true - y_pred) / (var_pop(y_true) + {TINY})"
    n = "count(*)"
    syy, spp = (f"greatest(sum({v} * {v}) - sum({v}) * sum({v}) / {n}, 0.0)" for v in ("y_true", "y_pred"))
    r = f"(sum(y_true * y_pred) - sum(y_true) * sum(y_pred) / {n}) / (sqrt({syy}) * sqrt({spp}) + {TINY})"
    return f"SELECT {keys}, {ev} AS explained_variance_score, {r} AS pearson_score, avg((y_true - y_pred) * (y_true - y_pred)) AS mean_squared_error, avg(abs(y_true - y_pred)) AS mean_absolute_error FROM {source} GROUP BY {keys}"


QUARTILES = (("least", 0), ("lower", 0.25), ("median", 0.5), ("upper", 0.75), ("greatest", 1))
METRICS = ("explained_variance_score", "pearson_score", "mean_squared_error", "mean_absolute_error")
MET = f"met AS ({reg('pred', 'fold, model, network')})"
INC = "inc AS (SELECT a.fold, a.network, " + ", ".join(f"a.{m} - b.{m} AS {m}" for m in METRICS) + " FROM met a JOIN met b USING (fold, network) WHERE a.model = 'full' AND b.model = 'covariates')"
ROUNDED = ", ".join(f"{r6(m)} AS {m}" for m in METRICS)
DIM = "dim AS (SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS INTEGER) AS edge_id, CAST(i AS INTEGER) AS node_i, CAST(j AS INTEGER) AS node_j FROM (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS j) WHERE i < j)"
STAB = f"stab AS (SELECT edge_id, network, count(DISTINCT fold) AS n_selected, count(DISTINCT fold) / CAST({K} AS DOUBLE) AS stability FROM mask GROUP BY 1, 2)"
OBS = "obs AS (SELECT p.edge_id, p.network, p.n_selected, p.stability, p.node_i, p.node_j, round(coalesce(found.p_value, 1.0), 6) AS p_value FROM pst p LEFT JOIN named ON named.run_id = 0 AND named.network = p.network AND named.edge_id = p.edge_id LEFT JOIN found ON found.network = named.network AND found.component = named.component WHERE p.run_id = 0)"

# permuted runs
TARGETS = f"""nat AS (SELECT sample_id, y, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) AS q FROM s),
per AS (SELECT run_id, y, row_number() OVER (PARTITION BY run_id ORDER BY md5('42:' || run_id || ':' || sample_id), sample_id) AS q FROM s, (SELECT CAST(unnest(range(1, {RUNS + 1})) AS INTEGER) AS run_id)),
tg AS (SELECT CAST(0 AS INTEGER) AS run_id, sample_id, y FROM s UNION ALL SELECT run_id, nat.sample_id, per.y FROM per JOIN nat USING (q))"""
PMASK = f"""pt AS (SELECT tg.run_id, k.fold, e.edge_id, count(*) AS n, corr(e.value, tg.y) AS r FROM tg JOIN e USING (sample_id) JOIN f USING (sample_id), (SELECT CAST(unnest(range({K})) AS INTEGER) AS fold) k WHERE f.sample_fold <> k.fold GROUP BY 1, 2, 3),
pz AS (SELECT run_id, fold, edge_id, r, {_z('r', 0)} AS z FROM pt),
pmask AS (SELECT run_id, fold, edge_id, {NETWORK} AS network FROM pz WHERE abs(z) > CAST({Z05!r} AS DOUBLE)),
pst AS (SELECT run_id, network, edge_id, node_i, node_j, count(DISTINCT fold) AS n_selected, count(DISTINCT fold) / CAST({K} AS DOUBLE) AS stability FROM pmask JOIN dim USING (edge_id) GROUP BY ALL)"""
PBASE = (S, E_, fold(), TARGETS, DIM, PMASK)


def comp(source: str, keys: str) -> str:
    """comp: keys, node, component; by walking from each node."""
    k2 = ", ".join(f"w.{k}" for k in keys.split(", "))
    return f"""ends AS (SELECT {keys}, node_i AS a, node_j AS b FROM {source} UNION SELECT {keys}, node_j, node_i FROM {source}),
walk AS (SELECT {keys}, a AS node, a AS reach FROM ends UNION SELECT {k2}, w.node, n.b FROM walk w JOIN ends n ON {' AND '.join(f'w.{k} = n.{k}' for k in keys.split(', '))} AND w.reach = n.a),
comp AS (SELECT {keys}, node, min(reach) AS component FROM walk GROUP BY {keys}, node)"""


def sizes(source: str, keys: str, value: str) -> str:
    on = " AND ".join(f"c.{k} = x.{k}" for k in keys.split(", "))
    kx = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""named AS (SELECT x.*, c.component FROM {source} x JOIN comp c ON {on} AND c.node = x.node_i),
sz AS (SELECT {kx}, component, count(*) AS n_edges, sum({value}) AS statistic FROM named x GROUP BY {kx}, component),
nn AS (SELECT {keys}, component, count(*) AS n_nodes FROM comp GROUP BY {keys}, component)"""


def _rec(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


NULLS = f"nul AS (SELECT network, run_id, coalesce(max(statistic), 0.0) AS top FROM (SELECT CAST(unnest(range(1, {RUNS + 1})) AS INTEGER) AS run_id), (SELECT unnest(['positive', 'negative']) AS network) LEFT JOIN sz USING (run_id, network) GROUP BY network, run_id)".replace("FROM (SELECT CAST", "FROM (SELECT * FROM (SELECT CAST").replace(" AS network) LEFT JOIN", " AS network)) LEFT JOIN")
KEPT = f"kept AS (SELECT * FROM pst WHERE n_selected >= {-(-K // 2)})"


def nbs(value: str) -> tuple[str, ...]:
    found = f"found AS (SELECT sz.network, sz.component, n_edges, statistic, n_nodes, (1 + (SELECT count(*) FROM nul WHERE nul.network = sz.network AND top >= statistic - 1e-12)) / CAST({RUNS + 1} AS DOUBLE) AS p_value FROM sz JOIN nn USING (run_id, network, component) WHERE run_id = 0)"
    return (*PBASE, KEPT, comp("kept", "run_id, network"), sizes("kept", "run_id, network", value), NULLS, found)


TF = f"""steps AS (SELECT pst.*, CAST(h AS INTEGER) AS step FROM pst, (SELECT unnest(range(1, 11)) AS h) WHERE stability >= h * CAST(0.1 AS DOUBLE) - CAST(1e-7 AS DOUBLE))"""
TFSCORE = "sc AS (SELECT run_id, network, node_i, node_j, sum(pow(CAST(sz.n_edges AS DOUBLE), 0.5) * pow(named.step * CAST(0.1 AS DOUBLE), 2.0) * CAST(0.1 AS DOUBLE)) AS score FROM named JOIN sz USING (run_id, network, step, component) GROUP BY ALL)"
TFALL = (*PBASE, TF, comp("steps", "run_id, network, step"), sizes("steps", "run_id, network, step", "1.0"), TFSCORE)
LI = "li AS (SELECT l_returnflag, CAST(l_extendedprice > 40000.0 AS INTEGER) AS t, l_quantity / CAST(50 AS DOUBLE) AS g FROM lineitem)"
AUC = f"""ra AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY g) + (count(*) OVER (PARTITION BY l_returnflag, g) - 1) / CAST(2 AS DOUBLE) AS r FROM li),
auc AS (SELECT l_returnflag, (sum(r) FILTER (t = 1) - CAST(sum(t) AS DOUBLE) * (sum(t) + 1) / 2) / (CAST(sum(t) AS DOUBLE) * sum(1 - t) + {TINY}) AS roc_auc FROM ra GROUP BY 1)"""


def histogram(source: str, column: str, bins: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    ends = f"ends AS (SELECT {keys}min({column}) AS lo, max({column}) AS hi FROM {source} {'GROUP BY ' + by if by else ''})"
    join = f"JOIN ends USING ({by})" if by else ", ends"
    return _with(ends, body=f"SELECT {keys}CAST(least(coalesce(floor(({column} - lo) * {bins} / nullif(hi - lo, 0)), 0), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM {source} {join} WHERE {column} IS NOT NULL GROUP BY ALL")


def binned(value: str, lo: str, hi: str, bins: int = 20) -> str:
    return f"CAST(least(coalesce(floor(({value} - {lo}) * {bins} / nullif({hi} - {lo}, 0)), 0), {bins - 1}) AS INTEGER)"


def _adjusted(method: str) -> str:
    w = "PARTITION BY fold"
    up = f"({w} ORDER BY p, edge_id ROWS UNBOUNDED PRECEDING)"
    down = f"({w} ORDER BY p DESC, edge_id DESC ROWS UNBOUNDED PRECEDING)"
    pm = f"pm AS (SELECT fold, edge_id, p, CAST(count(*) OVER ({w}) AS DOUBLE) AS m, CAST(row_number() OVER ({w} ORDER BY p, edge_id) AS DOUBLE) AS i FROM p)"
    simple = {
        "bonferroni": "m * p",
        "sidak": "1 - pow(1 - p, m)",
        "holm": f"max((m - i + 1) * p) OVER {up}",
        "holm-sidak": f"max(1 - pow(1 - p, m - i + 1)) OVER {up}",
        "simes-hochberg": f"min((m - i + 1) * p) OVER {down}",
        "fdr_bh": f"min(m * p / i) OVER {down}",
        "fdr_by": f"min(m * p / i * h) OVER {down}",
    }
    if method in simple:
        h = f"ph AS (SELECT *, sum(1 / i) OVER ({w}) AS h FROM pm)"
        return _with(*BASE, P, pm, h, body=f"SELECT fold, edge_id, {r6(f'least(1.0, {simple[method]})')} AS p_adjusted FROM ph")
    if method == "hommel":
        simes = "si AS (SELECT a.fold, j, min(j * b.p / (b.i - (a.m - j))) AS simes, any_value(a.m) AS m FROM (SELECT DISTINCT fold, m, CAST(unnest(range(1, CAST(m AS INTEGER) + 1)) AS DOUBLE) AS j FROM pm) a JOIN pm b ON a.fold = b.fold AND b.i > a.m - j GROUP BY a.fold, j)"
        body = f"SELECT x.fold, edge_id, {r6('least(1.0, greatest(any_value(p), max(CASE WHEN x.i > x.m - j THEN simes ELSE least(simes, j * p) END)))')} AS p_adjusted FROM pm x JOIN si ON x.fold = si.fold GROUP BY x.fold, edge_id"
        return _with(*BASE, P, pm, simes, body=body)
    first, factor = ("0.05", "1.0") if method == "fdr_tsbh" else ("CAST(0.05 AS DOUBLE) / CAST(1.05 AS DOUBLE)", "CAST(1.05 AS DOUBLE)")
    bh = f"bh AS (SELECT *, least(1.0, min(m * p / i) OVER {down}) AS b FROM pm),\nrj AS (SELECT *, sum(CASE WHEN b <= {first} THEN 1 ELSE 0 END) OVER ({w}) AS k FROM bh)"
    return _with(*BASE, P, pm, bh, body=f"SELECT fold, edge_id, {r6(f'least(1.0, CASE WHEN k = 0 OR k = m THEN b * {factor} ELSE b * (m - k) / m * {factor} END)')} AS p_adjusted FROM rj")


def _inner(ranked: bool = False, correction: bool = False) -> tuple[str, ...]:
    """Three inner folds in each of three outer ones: i_mask, i_mean and best, the parameters being alphas."""
    k = "(SELECT CAST(unnest(range(3)) AS INTEGER) AS {})"
    z = ", ".join(f"({i}, CAST({critical_z(a)!r} AS DOUBLE), CAST({a} AS DOUBLE))" for i, a in enumerate((0.05, 0.01)))
    value = "row_number() OVER (PARTITION BY fold, inner_fold, edge_id ORDER BY {}, sample_id)" if ranked else "{}"
    enough = "p_adjusted < alpha AND r <> 0" if correction else "abs(z) > z_min"
    return (
        S,
        E_,
        fold(3),
        f"o AS (SELECT k.fold, s.sample_id, s.y FROM s JOIN f USING (sample_id), {k.format('fold')} k WHERE f.sample_fold <> k.fold)",
        "own AS (SELECT *, CAST((row_number() OVER (PARTITION BY fold ORDER BY md5('fold:42:' || fold || ':' || sample_id), sample_id) - 1) % 3 AS INTEGER) AS own FROM o)",
        f"i AS (SELECT own.*, k.inner_fold, own.own = k.inner_fold AS is_test FROM own, {k.format('inner_fold')} k)",
        f"i_x AS (SELECT fold, inner_fold, edge_id, {value.format('value')} AS x, {value.format('y')} AS y FROM i JOIN e USING (sample_id) WHERE NOT is_test)",
        "i_t AS (SELECT fold, inner_fold, edge_id, count(*) AS n, corr(x, y) AS r FROM i_x GROUP BY 1, 2, 3)",
        f"i_z AS (SELECT *, {_z('r', 0)} AS z FROM i_t)",
        _corrected("i_z", "i_s", "fold, inner_fold"),
        f"g AS (SELECT * FROM (VALUES {z}) g(param_id, z_min, alpha))",
        f"i_mask AS (SELECT fold, inner_fold, param_id, edge_id, {NETWORK} AS network FROM i_s, g WHERE {enough})",
        "i_st AS (SELECT m.fold, m.inner_fold, m.param_id, e.sample_id, sum(value) FILTER (network = 'positive') AS pos, sum(value) FILTER (network = 'negative') AS neg FROM i_mask m JOIN e USING (edge_id) GROUP BY 1, 2, 3, 4)",
        "i_d AS (SELECT i.*, g.param_id, coalesce(pos, 0.0) AS f1, coalesce(neg, 0.0) AS f2 FROM i CROSS JOIN g LEFT JOIN i_st USING (fold, inner_fold, param_id, sample_id))",
        _gram(["f1", "f2"], "y", "i_d", "fold, inner_fold, param_id", "i_co"),
        "i_pred AS (SELECT fold, inner_fold, param_id, y AS y_true, beta_0 + beta_1 * f1 + beta_2 * f2 AS y_pred FROM i_d JOIN i_co USING (fold, inner_fold, param_id) WHERE is_test)",
        f"i_met AS ({reg('i_pred', 'fold, inner_fold, param_id')})",
        "mean AS (SELECT fold, param_id, avg(pearson_score) AS mean FROM i_met GROUP BY 1, 2)",
        "best AS (SELECT fold, param_id, mean FROM mean QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mean DESC, param_id) = 1)",
    )


def _corrected(source: str, name: str, family: str) -> str:
    """source (z) with p_adjusted after Benjamini and Hochberg."""
    p = f"least(1.0, {erfc_sql('abs(z) / sqrt(CAST(2 AS DOUBLE))')})"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY p, edge_id) AS i, count(*) OVER (PARTITION BY {family}) AS m FROM (SELECT *, {p} AS p FROM {source})"
    return f"{name} AS (SELECT *, least(1.0, min(m * p / i) OVER (PARTITION BY {family} ORDER BY p DESC, edge_id DESC)) AS p_adjusted FROM ({ranked}))"


def _outer(mask: str, *ctes: str, ranked: bool = False) -> str:
    """Metrics of the outer folds with the edges of mask."""
    three = ROLES.replace(f"range({K})", "range(3)")
    train = (three, TRAIN, *((RANKED,) if ranked else ()), stat(0, "tr" if ranked else "t"), _corrected("st", "st_s", "fold"))
    both = "allm AS (SELECT fold, model, network, " + ", ".join(METRICS) + " FROM met UNION ALL SELECT fold, 'increment', network, " + ", ".join(METRICS) + " FROM inc)"
    return _with(*ctes, *train, mask, STRENGTH, residual(), design(), predicted(), MET, INC, both, body=f"SELECT fold, model, network, {ROUNDED} FROM allm")


def _statistic(base: str, k: int, ranked: bool = False) -> str:
    ctes = (base, E_, fold(), ROLES, TRAIN) + ((RANKED,) if ranked else ()) + (stat(k, "tr" if ranked else "t"),)
    return _with(*ctes, body=f"SELECT fold, edge_id, n, {r6('r')} AS r, {r6('z')} AS z FROM st")


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["edge_long"] = _with(S, E_, body=f"SELECT sample_id, edge_id, {r6('value')} AS value FROM e")
    o["edge_nodes"] = _with(S, E_, DIM, body=f"SELECT edge_id, node_i, node_j, {r6('avg(value)')} AS mean FROM e JOIN dim USING (edge_id) GROUP BY 1, 2, 3")
    o["matrix_roundtrip"] = _with(S, E_, DIM, body=f"SELECT sample_id, true AS same, CAST(node AS INTEGER) AS node, {r6('sum(value)')} AS row_sum FROM (SELECT sample_id, node_i AS node, value FROM e JOIN dim USING (edge_id) UNION ALL SELECT sample_id, node_j, value FROM e JOIN dim USING (edge_id)) GROUP BY 1, 2, 3")
    o["infer_nodes"] = "WITH c AS (SELECT o_custkey, count(*) AS n_edges FROM orders GROUP BY 1), n AS (SELECT unnest(range(2, 2000)) AS n) SELECT o_custkey, n_edges, n AS n_nodes FROM c LEFT JOIN n ON n * (n - 1) // 2 = n_edges"
    o["task_type_detect"] = _with(S, body="SELECT * FROM (SELECT 'y' AS name, count(DISTINCT y) AS n_values, 'regression' AS task FROM s) UNION ALL VALUES ('above', 2, 'classification'), ('side', 2, 'classification'), ('one', 1, 'invalid')")
    o["data_summary"] = "SELECT count(*) AS n_samples, CAST(55 AS BIGINT) AS n_features, CAST(2 AS BIGINT) AS n_covariates, CAST(0 AS BIGINT) AS n_missing FROM embeddings"
    o["target_histogram"] = histogram("orders", "o_totalprice", 30)
    o["report_strength_histogram"] = histogram("events", "value", 30, "event_type")
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    o["covariate_onehot"] = "SELECT c_custkey, c_acctbal, " + ", ".join(f"CAST(coalesce(c_mktsegment = '{v}', false) AS DOUBLE) AS c_mktsegment_{v}" for v in levels[1:]) + " FROM customer"
    gaps = "g AS (SELECT sample_id, edge_id, CASE WHEN (sample_id * 7 + edge_id) % 11 <> 0 THEN value END AS value FROM e)"
    means = "mean AS (SELECT fold, edge_id, avg(value) AS mean FROM g JOIN roles USING (sample_id) WHERE NOT is_test GROUP BY 1, 2)"
    o["impute_mean"] = _with(S, E_, fold(), ROLES, gaps, means, body=f"SELECT fold, edge_id, {r6('sum(coalesce(value, mean))')} AS total, count(coalesce(value, mean)) AS n FROM g JOIN roles USING (sample_id) JOIN mean USING (fold, edge_id) GROUP BY 1, 2")
    o["variance_filter"] = _with(S, E_, body=f"SELECT edge_id, {r6('var_samp(value)')} AS variance FROM e WHERE edge_id % 2 = 0 GROUP BY 1 HAVING var_samp(value) > 1e-6")
    fit = "fit AS (SELECT fold, edge_id, regr_slope(x, c1) AS b, regr_intercept(x, c1) AS a FROM t GROUP BY 1, 2)"
    o["residualize_edges"] = _with(S, E_, fold(), ROLES, TRAIN, fit, body=f"SELECT fold, sample_id, {r6('sum(abs(value - a - b * c1))')} AS size FROM e JOIN roles USING (sample_id) JOIN fit USING (fold, edge_id) GROUP BY 1, 2")
    orders = "s AS (SELECT o_orderkey AS sample_id, o_orderpriority FROM orders)"
    o["kfold_assign"] = _with(orders, fold(), body="SELECT sample_id, sample_fold AS fold FROM f")
    o["stratified_kfold"] = _with(orders, fold(by="o_orderpriority"), body="SELECT sample_id, o_orderpriority, sample_fold AS fold FROM f JOIN s USING (sample_id)")
    o["repeated_kfold"] = _with(S, body="SELECT sample_id, CAST(r AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY r ORDER BY md5('fold:' || (r + 42) || ':' || sample_id), sample_id) - 1) % 5 AS INTEGER) AS fold FROM s, (SELECT unnest(range(3)) AS r)")
    o["shuffle_split"] = _with(S, body="SELECT sample_id, CAST(r AS INTEGER) AS split, row_number() OVER (PARTITION BY r ORDER BY md5('split:' || (r + 42) || ':' || sample_id), sample_id) <= ceil((SELECT count(*) FROM s) * CAST(0.2 AS DOUBLE)) AS is_test FROM s, (SELECT unnest(range(3)) AS r)")
    o["permuted_targets"] = _with(S, TARGETS, body=f"SELECT run_id, sample_id, {r6('y')} AS y FROM tg")
    for name, base, k, ranked in (("edge_pearson", S, 0, False), ("edge_pearson_blocked", S, 0, False), ("edge_spearman", S, 0, True), ("edge_point_biserial", SB, 0, False), ("edge_partial_1cov", S, 1, False), ("edge_partial_2cov", S, 2, False), ("edge_spearman_partial", S, 1, True), ("edge_point_biserial_partial", SB, 1, False)):
        o[name] = _statistic(base, k, ranked)
    gone = (_gram(["c1", "c2"], "x", "t", "fold, edge_id", "xr", "true"), "t2 AS (SELECT t.fold, t.edge_id, sample_id, x - beta_0 - beta_1 * c1 - beta_2 * c2 AS x, y, c1, c2 FROM t JOIN xr USING (fold, edge_id))", stat(0, "t2"))
    o["edge_residual"] = _with(*BASE[:5], *gone, body=f"SELECT fold, edge_id, n, {r6('r')} AS r, {r6('z')} AS z FROM st")
    twice = "roles AS (SELECT CAST(r * 5 + k AS INTEGER) AS fold, sample_id, own = k AS is_test, y, c1, c2 FROM (SELECT s.*, r, (row_number() OVER (PARTITION BY r ORDER BY md5('fold:' || (r + 42) || ':' || sample_id), sample_id) - 1) % 5 AS own FROM s, (SELECT unnest(range(2)) AS r)), (SELECT unnest(range(5)) AS k))"
    for name, ranked in (("", False), ("_spearman", True)):
        o[f"edge_repeated_splits{name}"] = _with(S, E_, twice, TRAIN, *((RANKED,) if ranked else ()), stat(0, "tr" if ranked else "t"), body=f"SELECT fold, edge_id, n, {r6('r')} AS r, {r6('z')} AS z FROM st")
    o["edge_pvalue"] = _with(*BASE, P, body=f"SELECT fold, edge_id, {r6('p')} AS p FROM p")
    o["edge_select"] = _with(*BASE, MASK, body="SELECT * FROM mask")
    grid = ", ".join(f"({i}, CAST({critical_z(a)!r} AS DOUBLE))" for i, a in enumerate((0.05, 0.01, 0.001)))
    o["edge_select_grid"] = _with(*BASE, body=f"SELECT fold, param_id, edge_id, {NETWORK} AS network FROM st, (VALUES {grid}) g(param_id, z_min) WHERE abs(z) > z_min")
    rank = "row_number() OVER (PARTITION BY fold ORDER BY abs(z) DESC, edge_id)"
    o["edge_k_best"] = _with(*BASE, body=f"SELECT fold, edge_id FROM st QUALIFY {rank} <= 5")
    o["edge_best_percent"] = _with(*BASE, body=f"SELECT fold, edge_id FROM st QUALIFY {rank} <= ceil(count(*) OVER (PARTITION BY fold) * 0.1)")
    for method in METHODS:
        o[f"padj_{method.replace('-', '_')}"] = _adjusted(method)
    o["network_strength"] = _with(*BASE, MASK, STRENGTH, body=f"SELECT fold, sample_id, is_test, {r6('pos')} AS pos, {r6('neg')} AS neg FROM rows0")
    o["residualized_strength"] = _with(*BASE, MASK, STRENGTH, residual(), body=f"SELECT fold, sample_id, {r6('pos_res')} AS pos_res, {r6('neg_res')} AS neg_res FROM rows1 WHERE is_test")
    for model in ("connectome", "covariates", "full", "residuals"):
        o[f"cv_pred_{model}"] = _with(*CHAIN, body=f"SELECT fold, network, sample_id, {r6('y_true')} AS y_true, {r6('y_pred')} AS y_pred FROM pred WHERE model = '{model}'")
    for name, kind in (("tree", grown(1, 4)), ("forest", grown(10, 3))):
        o[f"nonlinear_{name}"] = _with(*CHAIN[:-1], *kind, f"met AS ({reg('guess', 'fold, model, network')})", body=f"SELECT fold, model, network, {ROUNDED} FROM met")
    o["additive_sums"] = _with(*CHAIN[:-1], *basis_sums(), body=f"SELECT fold, model, network, i, j, {r6('total')} AS total FROM sums")
    o["logistic_coefficients"] = _with(SB, E_, fold(K, 'y'), *BASE[3:], MASK, STRENGTH, *reweighted(4), body="SELECT fold, " + ", ".join(f"{r6(f'k{i}')} AS beta_{i}" for i in range(3)) + " FROM b4")
    o["cv_metrics_regression"] = _with(*CHAIN, MET, body=f"SELECT fold, model, network, {ROUNDED} FROM met")
    o["metrics_large"] = _with("x AS (SELECT l_returnflag, l_extendedprice AS y_true, l_quantity * CAST(1500 AS DOUBLE) AS y_pred FROM lineitem)", f"m AS ({reg('x', 'l_returnflag')})", body=f"SELECT l_returnflag, {ROUNDED} FROM m")
    q = f"CAST(sum(CASE WHEN t = {{}} AND (g > 0.5) = {{}} THEN 1 ELSE 0 END) AS DOUBLE)"  # noqa: F541
    four = f"c AS (SELECT l_returnflag, count(*) AS n, {q.format(1, 'true')} AS tp, {q.format(1, 'false')} AS fn, {q.format(0, 'true')} AS fp, {q.format(0, 'false')} AS tn FROM li GROUP BY 1)"
    rates = f"ca AS (SELECT *, tp / (tp + fn + {TINY}) AS tpr, tn / (tn + fp + {TINY}) AS tnr, tp / (tp + fp + {TINY}) AS pr FROM c)"
    o["metrics_classification"] = _with(LI, AUC, four, rates, body=f"SELECT l_returnflag, {r6(f'(tp + tn) / (n + {TINY})')} AS accuracy, {r6('(tpr + tnr) / 2')} AS balanced_accuracy, {r6(f'2 * pr * tpr / (pr + tpr + {TINY})')} AS f1_score, {r6('roc_auc')} AS roc_auc FROM ca JOIN auc USING (l_returnflag)")
    o["roc_auc_midrank"] = _with(LI, AUC, body=f"SELECT l_returnflag, {r6('roc_auc')} AS roc_auc FROM auc")
    o["cv_increment"] = _with(*CHAIN, MET, INC, body=f"SELECT fold, network, {ROUNDED} FROM inc")
    both = "allm AS (SELECT fold, model, network, " + ", ".join(METRICS) + " FROM met UNION ALL SELECT fold, 'increment', network, " + ", ".join(METRICS) + " FROM inc)"
    pairs = ", ".join(f"{r6(f'avg({m})')} AS {m}__mean, {r6(f'stddev_samp({m})')} AS {m}__std" for m in METRICS)
    left = "ex AS (SELECT r.fold, e.sample_id, e.edge_id, value - beta_0 - beta_1 * c1 - beta_2 * c2 AS value FROM e JOIN roles r USING (sample_id) JOIN xr USING (fold, edge_id))"
    o["residual_cv_metrics"] = _with(*BASE[:5], *gone, MASK, left, STRENGTH.replace("JOIN e USING (edge_id)", "JOIN ex e USING (fold, edge_id)"), residual(), design(), predicted(), MET, INC, both, body=f"SELECT fold, model, network, {ROUNDED} FROM allm")
    o["cv_summary"] = _with(*CHAIN, MET, INC, both, body=f"SELECT model, network, {pairs} FROM allm GROUP BY 1, 2")
    o["edge_stability"] = _with(*BASE, MASK, STAB, body="SELECT * FROM stab")
    o["stable_edges"] = _with(*BASE, MASK, STAB, body="SELECT edge_id, network, n_selected FROM stab WHERE n_selected > 3")
    o["inner_cv_best_param"] = _with(*_inner(), body=f"SELECT fold, param_id, {r6('mean')} AS mean FROM best")
    o["report_parameters"] = _with(*_inner(), body="SELECT fold, 'correction: none' || chr(10) || 'method: pearson' || chr(10) || 'threshold: ' || CASE param_id WHEN 0 THEN '0.05' ELSE '0.01' END AS params FROM best")
    chosen = "v AS (SELECT CASE param_id WHEN 0 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END AS t FROM best)"
    places = ", ".join(f"{r6(f'quantile_cont(t, {v})')} AS {n}" for n, v in QUARTILES)
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "std", *(n for n, _ in QUARTILES)))
    text = " UNION ALL ".join(f"SELECT '{k}', count(*), {none}, 1, '{v}', count(*) FROM v" for k, v in (("method", "pearson"), ("correction", "none")))
    o["report_parameter_summary"] = _with(*_inner(), chosen, body=f"SELECT 'threshold' AS name, count(*) AS n, {r6('avg(t)')} AS mean, {r6('stddev_samp(t)')} AS std, {places}, CAST(NULL AS BIGINT) AS n_values, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS n_top FROM v UNION ALL {text}")
    by_z, by_p = (f"mask AS (SELECT fold, edge_id, {NETWORK} AS network FROM st_s JOIN best USING (fold) JOIN g USING (param_id) WHERE {x})" for x in ("abs(z) > z_min", "p_adjusted < alpha AND r <> 0"))
    o["nested_cv_metrics"] = _outer(by_z, *_inner())
    o["nested_cv_spearman"] = _outer(by_z, *_inner(ranked=True), ranked=True)
    o["nested_cv_corrected"] = _outer(by_p, *_inner(correction=True))
    o["stable_edges_metrics"] = _outer("mask AS (SELECT fold, edge_id, network FROM i_mask WHERE param_id = 0 GROUP BY 1, 2, 3 HAVING count(DISTINCT inner_fold) > 1)", *_inner())
    prow = f"""pro AS (SELECT tg.run_id, k.fold, sample_id, f.sample_fold = k.fold AS is_test, tg.y, s.c1, s.c2 FROM tg JOIN f USING (sample_id) JOIN s USING (sample_id), (SELECT CAST(unnest(range({K})) AS INTEGER) AS fold) k),
pss AS (SELECT m.run_id, m.fold, e.sample_id, sum(value) FILTER (network = 'positive') AS pos, sum(value) FILTER (network = 'negative') AS neg FROM pmask m JOIN e USING (edge_id) GROUP BY 1, 2, 3),
rows0 AS (SELECT pro.*, coalesce(pos, 0.0) AS pos, coalesce(neg, 0.0) AS neg FROM pro LEFT JOIN pss USING (run_id, fold, sample_id))"""
    by = "run_id, fold, network"
    more = ", ".join(f"a.{m} - b.{m} AS {m}" for m in METRICS)
    pmet = f"""met AS ({reg('pred', 'run_id, fold, model, network')}),
allm AS (SELECT {by}, model, {', '.join(METRICS)} FROM met UNION ALL SELECT {by}, 'increment', {more} FROM met a JOIN met b USING ({by}) WHERE a.model = 'full' AND b.model = 'covariates'),
mm AS (SELECT run_id, model, network, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM allm GROUP BY 1, 2, 3)"""
    better = ", ".join(r6(f"(1 + count(*) FILTER (n.{m} {'<' if m.endswith('error') else '>'} t.{m})) / CAST({RUNS + 1} AS DOUBLE)") + f" AS {m}__mean" for m in METRICS)
    o["perm_pvalues"] = _with(*PBASE, prow, residual("run_id, fold"), design("run_id, fold"), predicted("run_id, fold"), pmet, body=f"SELECT n.model, n.network, {better} FROM mm n JOIN mm t ON n.network = t.network AND n.model = t.model AND n.run_id > 0 AND t.run_id = 0 GROUP BY 1, 2")
    o["edge_components"] = _rec(*PBASE, KEPT, comp("kept", "run_id, network"), body="SELECT run_id, network, node, component FROM comp")
    extent, intensity = nbs("1.0"), nbs("stability - CAST(0.5 AS DOUBLE)")
    o["nbs_extent_edges"] = _rec(*extent, body=f"SELECT network, node_i, node_j, {r6('p_value')} AS p_value FROM named JOIN found USING (network, component) WHERE run_id = 0")
    columns = f"network, component, n_edges, {r6('statistic')} AS statistic, n_nodes, {r6('p_value')} AS p_value, p_value < 0.05 AS significant"
    o["nbs_extent_components"] = _rec(*extent, body=f"SELECT {columns} FROM found")
    o["nbs_intensity_components"] = _rec(*intensity, body=f"SELECT {columns} FROM found")
    o["nbs_critical_value"] = _rec(*extent, body=f"SELECT network, {r6('quantile_cont(CAST(top AS DOUBLE), 0.95)')} AS critical_value FROM nul GROUP BY 1")
    most = "CAST(coalesce((SELECT max(n_edges) FROM found WHERE found.network = nul.network), 0) AS BIGINT) AS largest_component_edges, (SELECT count(*) FROM found WHERE found.network = nul.network AND p_value < 0.05) AS n_significant_components"
    o["nbs_diagnostics"] = _rec(*extent, body=f"SELECT network, {r6('quantile_cont(CAST(top AS DOUBLE), 0.95)')} AS critical_value, CAST(coalesce((SELECT max(statistic) FROM found WHERE found.network = nul.network), 0) AS DOUBLE) AS observed_max, (SELECT count(*) FROM named JOIN found USING (network, component) WHERE run_id = 0 AND network = nul.network AND p_value < 0.05) AS n_significant_edges, {most} FROM nul GROUP BY network")
    bins = "eb AS (SELECT network, CAST(min(top) AS DOUBLE) AS lo, CAST(max(top) AS DOUBLE) AS hi, least(40, greatest(10, count(DISTINCT top))) AS bins FROM nul GROUP BY 1)"
    at = "ab AS (SELECT network, lo, (hi - lo) / bins AS width, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((top - lo) / ((hi - lo) / bins)), bins - 1) END AS INTEGER) AS bin FROM nul JOIN eb USING (network))"
    o["report_null_histogram"] = _rec(*extent, bins, at, body=f"SELECT network, bin, {r6('lo + bin * width')} AS lo, {r6('lo + (bin + 1) * width')} AS hi, count(*) AS n, CAST(coalesce((SELECT max(statistic) FROM found WHERE found.network = ab.network), 0) AS DOUBLE) AS observed FROM ab GROUP BY network, bin, lo, width")
    ends = ", ".join(f"{r6(f'{f}(node_{k} * (2 * CAST(3.141592653589793 AS DOUBLE) / 11))')} AS {c}_{k}" for k in "ij" for c, f in (("x", "cos"), ("y", "sin"))) + ", CAST(0 AS DOUBLE) AS z_i, CAST(0 AS DOUBLE) AS z_j"
    o["report_placed_edges"] = _with(*PBASE, body=f"SELECT network, node_i, node_j, {r6('stability')} AS stability, {ends} FROM pst WHERE run_id = 0")
    o["tfce_scores"] = _rec(*TFALL, body=f"SELECT run_id, network, node_i, node_j, {r6('score')} AS score FROM sc")
    tnull = NULLS.replace("max(statistic)", "max(score)").replace("LEFT JOIN sz", "LEFT JOIN sc")
    o["tfce_pvalues"] = _rec(*TFALL, tnull, body=f"SELECT network, node_i, node_j, {r6('score')} AS score, {r6(f'(1 + (SELECT count(*) FROM nul WHERE nul.network = sc.network AND top >= score - 1e-12)) / CAST({RUNS + 1} AS DOUBLE)')} AS p_value FROM sc WHERE run_id = 0")
    o["tfce_diagnostics"] = _rec(*TFALL, tnull, body=f"SELECT network, {r6('quantile_cont(CAST(top AS DOUBLE), 0.95)')} AS critical_value, {r6('coalesce((SELECT max(score) FROM sc WHERE sc.network = nul.network AND run_id = 0), 0)')} AS observed_max, (SELECT count(*) FROM sc WHERE sc.network = nul.network AND run_id = 0 AND score > 0 AND (1 + (SELECT count(*) FROM nul m WHERE m.network = sc.network AND top >= score - 1e-12)) / CAST({RUNS + 1} AS DOUBLE) < 0.05) AS n_significant_edges FROM nul GROUP BY 1")
    observed = (*extent, OBS)
    signed = "sg AS (SELECT node_i, node_j, sum(CASE WHEN network = 'positive' THEN stability ELSE -stability END) AS signed FROM obs GROUP BY 1, 2)"
    o["report_edge_table"] = _rec(*observed, body=f"SELECT 'R' || node_j AS region_a, 'R' || node_i AS region_b, {r6('stability', 5)} AS stability, {r6('p_value', 5)} AS p_value FROM obs")
    o["report_signed_stability"] = _rec(*observed, signed, body=f"SELECT node_i, node_j, {r6('signed')} AS signed FROM sg")
    o["report_shown_edges"] = _rec(*observed, body="SELECT edge_id, network FROM obs QUALIFY p_value < 0.05 OR NOT bool_or(p_value < 0.05) OVER (PARTITION BY network)")
    o["report_group_summary"] = _rec(*observed, signed, body=f"SELECT 'N' || least(node_i % 3, node_j % 3) AS group_a, 'N' || greatest(node_i % 3, node_j % 3) AS group_b, {r6('avg(signed)')} AS mean, count(*) AS n FROM sg GROUP BY 1, 2")
    o["report_node_degrees"] = _rec(*observed, body="SELECT node, count(*) FILTER (network = 'positive') AS n_positive, count(*) FILTER (network = 'negative') AS n_negative, count(*) AS total FROM (SELECT network, unnest([node_i, node_j]) AS node FROM obs) GROUP BY 1 ORDER BY total DESC, node DESC LIMIT 5")
    o["report_matrix_order"] = 'WITH n AS (SELECT CAST(n_nationkey AS INTEGER) AS node_id, CAST(n_regionkey AS VARCHAR) AS g FROM nation) SELECT node_id, g AS "group", CAST(row_number() OVER (ORDER BY g, node_id) - 1 AS INTEGER) AS place, coalesce(lag(g) OVER (ORDER BY g, node_id) <> g, true) AS starts_block FROM n'
    long = "lm AS (" + " UNION ALL ".join(f"SELECT fold, model, network, '{m}' AS metric, {m} AS value FROM met" for m in METRICS) + ")"
    o["report_metrics_melt"] = _with(*CHAIN, MET, long, body=f"SELECT fold, model, network, metric, {r6('value')} AS value FROM lm")
    quart = ", ".join(f"{r6(f'quantile_cont(value, {v})')} AS {n}" for n, v in QUARTILES)
    o["report_metrics_box"] = _with(*CHAIN, MET, long, body=f"SELECT model, network, metric, {quart} FROM lm GROUP BY 1, 2, 3")
    low = ", ".join(f"{r6(f'quantile_cont(l_extendedprice, {v})')} AS {n}" for n, v in (("low", 0.05), ("median", 0.5), ("high", 0.95)))
    o["report_quantiles"] = f"SELECT l_returnflag, count(*) AS n, {low} FROM lineitem GROUP BY 1"
    ended = "z AS (SELECT l_returnflag, min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d, count(*) AS m FROM lineitem GROUP BY 1)"
    o["report_cells"] = _with(ended, body=f"SELECT l_returnflag, {binned('l_quantity', 'a', 'b')} AS x_bin, {binned('l_extendedprice', 'c', 'd')} AS y_bin, count(*) AS n, {r6('count(*) / CAST(any_value(m) AS DOUBLE)')} AS share FROM lineitem JOIN z USING (l_returnflag) GROUP BY 1, 2, 3")
    facets = "fa AS (SELECT * FROM pred WHERE model = 'connectome' OR model = 'covariates' AND network = 'both'), fe AS (SELECT model, network, min(y_true) AS lo, max(y_true) AS hi FROM fa GROUP BY 1, 2)"
    o["report_predictions_facets"] = _with(*CHAIN, facets, body=f"SELECT model, network, {binned('y_true', 'lo', 'hi')} AS x_bin, count(*) AS n FROM fa JOIN fe USING (model, network) GROUP BY 1, 2, 3")
    kinds = "(SELECT unnest(['connectome', 'residuals']) AS model), (SELECT unnest(['positive', 'negative']) AS network)"
    o["report_strengths_facets"] = _with(*BASE, MASK, STRENGTH, residual(), "ye AS (SELECT min(y) AS lo, max(y) AS hi FROM rows1 WHERE is_test)", body=f"SELECT model, network, {binned('y', 'lo', 'hi')} AS y_bin, count(*) AS n FROM rows1, ye, {kinds} WHERE is_test GROUP BY 1, 2, 3")
    o["report_class_histogram"] = _with("z AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)", body=f"SELECT o_orderstatus, {binned('o_totalprice', 'lo', 'hi')} AS bin, count(*) AS n FROM orders, z GROUP BY 1, 2")
    o["report_class_probabilities"] = f"SELECT l_returnflag AS network, CAST(l_extendedprice > 40000.0 AS DOUBLE) AS y_true, {binned('l_quantity / CAST(50 AS DOUBLE)', 'CAST(0 AS DOUBLE)', 'CAST(1 AS DOUBLE)')} AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"
    level = {c: f"CAST({binned(f'CAST({c} AS DOUBLE)', f'(SELECT CAST(min({c}) AS DOUBLE) FROM orders)', f'(SELECT CAST(max({c}) AS DOUBLE) FROM orders)', 10)} AS VARCHAR)" for c in ("o_totalprice", "o_custkey")} | {c: c for c in ("o_orderstatus", "o_orderpriority")}
    drawn = list(level)
    o["report_pair_plot"] = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {level[a]} AS x, {level[b] if a != b else 'CAST(NULL AS VARCHAR)'} AS y, count(*) AS n FROM orders GROUP BY 3, 4" for i, a in enumerate(drawn) for b in drawn[i:])
    o["report_shares"] = f"SELECT o_orderpriority, o_orderstatus, count(*) AS n, {r6('count(*) / CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS DOUBLE)')} AS share FROM orders GROUP BY 1, 2"
    holes = "count(*) FILTER ((sample_id * 7 + edge_id) % 11 = 0)"
    o["missing_values"] = _with(S, E_, body=f"SELECT 'edges' AS name, {holes} AS n_missing, {r6(f'{holes} / CAST(count(*) AS DOUBLE)')} AS share FROM e UNION ALL SELECT 'c1', count(*) FILTER (sample_id % 3 = 0), {r6('count(*) FILTER (sample_id % 3 = 0) / CAST(count(*) AS DOUBLE)')} FROM s UNION ALL VALUES ('y', 0, CAST(0 AS DOUBLE)), ('c2', 0, CAST(0 AS DOUBLE))")
    o["report_fit_lines"] = _with(*CHAIN, body=f"SELECT model, network, count(*) AS n, {r6('corr(y_true, y_pred)')} AS r, {r6('regr_slope(y_true, y_pred)')} AS slope, {r6('regr_intercept(y_true, y_pred)')} AS intercept, {r6('min(y_pred)')} AS x_min, {r6('max(y_pred)')} AS x_max FROM pred WHERE model <> 'covariates' GROUP BY 1, 2")
    o["report_crosstab"] = "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2"
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    o["report_pair_correlations"] = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS r FROM lineitem" for i, a in enumerate(names) for b in names[i + 1 :])
    place = "list_position(['covariates', 'connectome', 'full', 'residuals'], model) * 10 + list_position(['positive', 'negative', 'both'], network)"
    p = f"round(least(1.0, {erfc_sql('abs(' + _z('avg(pearson_score)', 0).replace('(n - ', '((SELECT count(*) FROM s) - ') + ') / sqrt(CAST(2 AS DOUBLE))')}), 6)"
    star = f"CASE WHEN {p} < 0.001 THEN '<0.001**' WHEN {p} < 0.01 THEN printf('%.3f', {p}) || '**' WHEN {p} < 0.05 THEN printf('%.3f', {p}) || '*' ELSE printf('%.3f', {p}) END"
    o["report_apa"] = _with(*CHAIN, MET, body=f"SELECT CAST({place} AS BIGINT) AS position, model, network, printf('%.3f [%.3f]', avg(mean_absolute_error), stddev_samp(mean_absolute_error)) AS mae, {star} AS p FROM met GROUP BY model, network")
    r2 = "m AS (SELECT edge_id, corr(value, y) AS xy, corr(value, c1) AS xc, corr(y, c1) AS yc FROM e JOIN s USING (sample_id) GROUP BY 1)"
    unique = "(xy - xc * yc) * (xy - xc * yc) / (1 - xc * xc)"
    o["confound_r2s"] = _with(S, E_, r2, body=f"SELECT edge_id, {r6('xy * xy')} AS naive, {r6('yc * yc')} AS confound, {r6(f'yc * yc + {unique}')} AS \"full\", {r6(unique)} AS \"unique\" FROM m")
    return o
