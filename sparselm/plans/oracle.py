"""Reference SQL for the registered queries (DuckDB dialect).

These are the brute-force or closed-form statements the Spark results are
compared against: long-form self-joins for Gram matrices and interactions,
``row_number`` for positions, and ``S(Σy, λ)/n`` for the one-hot LASSO fits.
Parameters are the fixed values of :mod:`.catalog`.
"""

from __future__ import annotations

from .catalog import (DROP_POSITIONS, FIT_TOL, FOLDS, GRID, HISTORY_TOL, LINEITEM_BLOCKS, LINEITEM_CENTER,
                      LINEITEM_LAMBDA, ONEHOT_CENTER, ONEHOT_LAMBDA, STEP_LAMBDA, THRESHOLD)

EMB_LONG = """(SELECT vec_id,
        CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS idx,
        CAST(unnest(embedding) AS DOUBLE) AS v,
        CAST(label AS DOUBLE) AS y
   FROM embeddings)"""

Y = f"(o_totalprice / 1000 - {ONEHOT_CENTER})"

ONEHOT = f"""(SELECT CAST(dense_rank() OVER (ORDER BY lvl) - 1 AS INTEGER) AS idx,
        'o_orderpriority=' || lvl AS name, n, s, ss
   FROM (SELECT o_orderpriority AS lvl, count(*) AS n, sum({Y}) AS s, sum({Y} * {Y}) AS ss
           FROM orders GROUP BY o_orderpriority))"""


def _st(x: str, k: str) -> str:
    return f"(CASE WHEN {x} > {k} THEN {x} - {k} WHEN {x} < -({k}) THEN {x} + {k} ELSE 0.0 END)"


def _onehot_coef(lam: float) -> str:
    return f"({_st('s', repr(lam))} / n)"


_drop_shift = " - ".join(f"CAST(idx > {p} AS INTEGER)" for p in DROP_POSITIONS)
_drop_list = ", ".join(str(p) for p in DROP_POSITIONS)
_grid_values = ", ".join(f"({i}, {float(v)!r})" for i, v in enumerate(GRID))

_GRID_SQL = f"""WITH g AS {ONEHOT},
lam AS (SELECT * FROM (VALUES {_grid_values}) t(pos, lam_v)),
z AS (SELECT pos, lam_v, n, s, ss,
             CASE WHEN s > lam_v THEN (s - lam_v) / n WHEN s < -lam_v THEN (s + lam_v) / n
                  ELSE 0.0 END AS z
        FROM lam CROSS JOIN g)
SELECT CAST(pos AS INTEGER) AS pos, CAST(lam_v AS DOUBLE) AS "lambda",
       round(sum(n * z * z - 2 * z * s + ss) / sum(n), 4) + 0.0 AS mse,
       CAST(count(CASE WHEN z <> 0 THEN 1 END) AS INTEGER) AS nnz
  FROM z GROUP BY pos, lam_v"""

# the rounds by recursion: x, u are block values before round `iter`, z the
# consensus before it; u2, x2, z2 the values after
def _history_sql(tol: float) -> str:
    return f"""
WITH RECURSIVE obs AS (
  SELECT o_orderkey % 4 AS b, o_orderpriority AS lvl, count(*) AS n, sum({Y}) AS s
    FROM orders GROUP BY o_orderkey % 4, o_orderpriority),
c AS (SELECT count(DISTINCT o_orderkey % 4) AS nb, count(DISTINCT o_orderpriority) AS p,
             count(*) / count(DISTINCT o_orderpriority) / count(DISTINCT o_orderkey % 4) AS rho,
             sum({Y} * {Y}) AS ss FROM orders),
bg AS (SELECT b.b, g.lvl, coalesce(n, 0) AS n, coalesce(s, 0.0) AS s
         FROM (SELECT DISTINCT b FROM obs) b CROSS JOIN (SELECT DISTINCT lvl FROM obs) g
         LEFT JOIN obs USING (b, lvl)),
step AS (
  SELECT 0 AS iter, b, lvl, n, s, 0.0::DOUBLE AS x, 0.0::DOUBLE AS u, 0.0::DOUBLE AS z,
         0.0::DOUBLE AS u2, (s / (n + rho))::DOUBLE AS x2,
         {_st('(sum(s / (n + rho)) OVER (PARTITION BY lvl) / nb)', f'{ONEHOT_LAMBDA!r} / (rho * nb)')}::DOUBLE AS z2
    FROM bg CROSS JOIN c
  UNION ALL
  SELECT iter + 1, b, lvl, n, s, x, u, z, u, x2,
         {_st('(sum(x2 + u) OVER (PARTITION BY lvl) / nb)', f'{ONEHOT_LAMBDA!r} / (rho * nb)')}
    FROM (SELECT iter, b, lvl, n, s, x2 AS x, u2 + x2 - z2 AS u, z2 AS z,
                 (s + rho * (z2 - (u2 + x2 - z2))) / (n + rho) AS x2, nb, rho
            FROM step CROSS JOIN c WHERE iter < 400)),
logged AS (
  SELECT iter, sqrt(sum((x2 - z2) * (x2 - z2))) AS r,
         sqrt(max(p) * max(nb)) * {tol!r}
           + {tol!r} * greatest(sqrt(sum(x * x)), sqrt(sum(z * z))) AS ep,
         max(rho) * sqrt(sum((z2 - z) * (z2 - z))) AS sd,
         sqrt(max(p) * max(nb)) * {tol!r} + {tol!r} * sqrt(sum(u * u)) AS ed,
         0.5 * (sum(n * z2 * z2 - 2 * z2 * s) + max(ss))
           + {ONEHOT_LAMBDA!r} * sum(abs(z2)) / max(nb) AS obj
    FROM step CROSS JOIN c GROUP BY iter),
stopped AS (SELECT min(iter) AS last FROM logged WHERE r < ep AND sd < ed)
SELECT CAST(iter AS INTEGER) AS iter, round(r, 4) + 0.0 AS resid_primal,
       round(ep, 4) + 0.0 AS eps_primal, round(sd, 4) + 0.0 AS resid_dual,
       round(ed, 4) + 0.0 AS eps_dual, round(obj, 1) AS objective,
       CAST(last + 1 AS INTEGER) AS iterations, true AS converged
  FROM logged CROSS JOIN stopped WHERE iter <= last"""

_JOB_SQL = f"""
SELECT idx, true AS kkt_ok, round(sum(v * quality), 4) + 0.0 AS xty,
       CAST(count(*) AS BIGINT) AS n
  FROM {EMB_LONG} JOIN labels ON vec_id = doc_id GROUP BY idx"""

_NAMES_SQL = f"""
WITH n AS (SELECT DISTINCT idx, 'e' || CAST(idx AS VARCHAR) AS name FROM {EMB_LONG}),
     p AS (SELECT count(*) AS p FROM n)
SELECT idx, name FROM n
UNION ALL
SELECT CAST(p.p + a.idx * (2 * p.p - a.idx - 1) // 2 + (b.idx - a.idx - 1) AS INTEGER) AS idx,
       a.name || ':' || b.name AS name
  FROM n a JOIN n b ON a.idx < b.idx CROSS JOIN p"""

_INTERACTIONS_SQL = f"""
WITH e AS {EMB_LONG}, p AS (SELECT max(idx) + 1 AS p FROM e)
SELECT idx, true AS kkt_ok, round(sum(v * y), 4) + 0.0 AS xty, CAST(count(*) AS BIGINT) AS n
  FROM e GROUP BY idx
UNION ALL
SELECT CAST(p + a.idx * (2 * p - a.idx - 1) // 2 + (b.idx - a.idx - 1) AS INTEGER), true,
       round(sum(a.v * b.v * a.y), 4) + 0.0, CAST(count(*) AS BIGINT)
  FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.idx < b.idx CROSS JOIN p
 GROUP BY p, a.idx, b.idx"""

ORACLE_SQL = {
    "sample_matrix_long": f"""
SELECT CAST(vec_id AS VARCHAR) AS sample_id, idx, v AS value FROM {EMB_LONG}""",

    "feature_dictionary": f"""
SELECT DISTINCT idx, 'e' || CAST(idx AS VARCHAR) AS name FROM {EMB_LONG}""",

    "combined_scan": f"""
WITH x AS (SELECT vec_id, sum(v) AS s1, sum(v * v) AS s2, count(*) AS p
             FROM {EMB_LONG} GROUP BY vec_id)
SELECT CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic,
       CAST(x.p + x.p * (x.p - 1) // 2 AS INTEGER) AS n_features,
       round(x.s1 + (x.s1 * x.s1 - x.s2) / 2, 6) + 0.0 AS feature_sum
  FROM x JOIN labels l ON x.vec_id = l.doc_id""",

    "combined_names": _NAMES_SQL,

    "interaction_files": f"""
WITH x AS (SELECT vec_id, sum(v) AS s1, sum(v * v) AS s2, count(*) AS p,
                  max(CASE WHEN idx = 0 THEN v END) AS first_marker
             FROM {EMB_LONG} GROUP BY vec_id),
     last AS (SELECT vec_id, CAST(embedding[-1] AS DOUBLE) * CAST(embedding[-2] AS DOUBLE) AS v
                FROM embeddings)
SELECT CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic,
       CAST(x.p + x.p * (x.p - 1) // 2 AS INTEGER) AS n_features, first_marker,
       last.v AS last_product, round(x.s1 + (x.s1 * x.s1 - x.s2) / 2, 6) + 0.0 AS feature_sum
  FROM x JOIN labels l ON x.vec_id = l.doc_id JOIN last ON last.vec_id = x.vec_id""",

    "sample_join": f"""
WITH x AS (SELECT vec_id, sum(v) AS s1, count(*) AS p FROM {EMB_LONG} GROUP BY vec_id)
SELECT x.vec_id AS sample_id, CAST(l.quality AS DOUBLE) AS y, CAST(x.p AS INTEGER) AS n_features,
       round(x.s1, 6) + 0.0 AS feature_sum
  FROM x JOIN labels l ON x.vec_id = l.doc_id""",

    "alignment_report": """
WITH l AS (SELECT vec_id AS k, count(*) AS lc FROM embeddings GROUP BY vec_id),
     r AS (SELECT doc_id AS k, count(*) AS rc FROM labels GROUP BY doc_id),
     j AS (SELECT l.lc, r.rc FROM l FULL OUTER JOIN r ON l.k = r.k)
SELECT CAST(coalesce(sum(lc), 0) AS BIGINT) AS left_rows,
       CAST(coalesce(sum(rc), 0) AS BIGINT) AS right_rows,
       CAST(coalesce(sum(lc * rc), 0) AS BIGINT) AS joined_rows,
       CAST(coalesce(sum(CASE WHEN rc IS NULL THEN lc END), 0) AS BIGINT) AS left_only_rows,
       CAST(coalesce(sum(CASE WHEN lc IS NULL THEN rc END), 0) AS BIGINT) AS right_only_rows,
       CAST(count(CASE WHEN lc > 1 THEN 1 END) AS BIGINT) AS left_dup_ids,
       CAST(count(CASE WHEN rc > 1 THEN 1 END) AS BIGINT) AS right_dup_ids
  FROM j""",

    "positional_join": """
WITH a AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id, label FROM embeddings),
     b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, quality FROM labels)
SELECT CAST(a.pos AS BIGINT) AS pos, a.vec_id, a.label, b.doc_id, b.quality
  FROM a JOIN b ON a.pos = b.pos""",

    "drop_features": f"""
SELECT vec_id AS sample_id, CAST(idx - {_drop_shift} AS INTEGER) AS idx, v AS value
  FROM {EMB_LONG} WHERE idx NOT IN ({_drop_list})""",

    "transpose": f"""
SELECT CAST(vec_id AS VARCHAR) AS sample_id, idx, v AS value FROM {EMB_LONG}""",

    "pairwise_interactions": f"""
SELECT a.vec_id AS sample_id, a.idx AS k, b.idx AS j, a.v * b.v AS value
  FROM {EMB_LONG} a JOIN {EMB_LONG} b ON a.vec_id = b.vec_id AND a.idx < b.idx""",

    "interaction_names": _NAMES_SQL,

    "gram": f"""
SELECT a.idx AS i, b.idx AS j, round(sum(a.v * b.v), 6) + 0.0 AS g
  FROM {EMB_LONG} a JOIN {EMB_LONG} b ON a.vec_id = b.vec_id AND a.idx <= b.idx
 GROUP BY a.idx, b.idx""",

    "xty": f"""
SELECT idx AS i, round(sum(v * y), 6) + 0.0 AS xty FROM {EMB_LONG} GROUP BY idx""",

    "block_moments": f"""
SELECT a.vec_id % 4 AS block_id, a.idx AS i, b.idx AS j, round(sum(a.v * b.v), 6) + 0.0 AS g
  FROM {EMB_LONG} a JOIN {EMB_LONG} b ON a.vec_id = b.vec_id AND a.idx <= b.idx
 GROUP BY a.vec_id % 4, a.idx, b.idx""",

    "block_sq_norms": f"""
SELECT vec_id % 4 AS block_id, round(sum(v * v), 6) + 0.0 AS sq_norm,
       CAST(count(DISTINCT vec_id) AS BIGINT) AS n
  FROM {EMB_LONG} GROUP BY vec_id % 4""",

    "vector_mean": f"""
SELECT idx AS i, round(avg(v), 6) + 0.0 AS mean FROM {EMB_LONG} GROUP BY idx""",

    "soft_threshold": f"""
SELECT i, round({_st('s', repr(THRESHOLD))}, 6) + 0.0 AS value
  FROM (SELECT idx AS i, sum(v * y) AS s FROM {EMB_LONG} GROUP BY idx)""",

    "ridge_solve_p2": """
WITH g AS (SELECT l_returnflag, l_linestatus,
                  sum(l_quantity * l_quantity) + 1.0 AS a, sum(l_quantity * l_discount) AS b,
                  sum(l_discount * l_discount) + 1.0 AS d,
                  sum(l_quantity * (l_extendedprice / 1000)) AS c1,
                  sum(l_discount * (l_extendedprice / 1000)) AS c2
             FROM lineitem GROUP BY l_returnflag, l_linestatus)
SELECT l_returnflag, l_linestatus, CAST(0 AS INTEGER) AS i,
       round((d * c1 - b * c2) / (a * d - b * b), 4) + 0.0 AS x FROM g
UNION ALL
SELECT l_returnflag, l_linestatus, CAST(1 AS INTEGER) AS i,
       round((a * c2 - b * c1) / (a * d - b * b), 4) + 0.0 AS x FROM g""",

    "lasso_onehot": f"""
SELECT idx, name, round({_onehot_coef(ONEHOT_LAMBDA)}, 4) + 0.0 AS coef
  FROM {ONEHOT} WHERE abs(s) > {ONEHOT_LAMBDA!r}""",

    "lasso_lineitem": f"""
WITH g AS (SELECT l_returnflag || l_linestatus AS name, count(*) AS n,
                  sum(l_extendedprice / 1000 - {LINEITEM_CENTER!r}) AS s
             FROM lineitem GROUP BY l_returnflag, l_linestatus)
SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS idx, name,
       round({_onehot_coef(LINEITEM_LAMBDA)}, 4) + 0.0 AS coef,
       CAST({LINEITEM_BLOCKS} AS INTEGER) AS n_blocks, CAST(sum(n) OVER () AS BIGINT) AS n
  FROM g""",

    "admm_step": f"""
WITH bg AS (SELECT o_orderkey % 4 AS b, o_orderpriority AS lvl, count(*) AS n, sum({Y}) AS s
              FROM orders GROUP BY o_orderkey % 4, o_orderpriority),
     nb AS (SELECT count(DISTINCT o_orderkey % 4) AS nb FROM orders),
     x AS (SELECT lvl, sum(s / (n + 1.0)) / max(nb.nb) AS xbar, {STEP_LAMBDA!r} / max(nb.nb) AS k
             FROM bg CROSS JOIN nb GROUP BY lvl)
SELECT CAST(dense_rank() OVER (ORDER BY lvl) - 1 AS INTEGER) AS idx,
       round({_st('xbar', 'k')}, 6) + 0.0 AS z
  FROM x""",

    "admm_three_rounds": f"""
WITH b AS (SELECT DISTINCT o_orderkey % 4 AS b FROM orders),
     g AS (SELECT DISTINCT o_orderpriority AS lvl FROM orders),
     obs AS (SELECT o_orderkey % 4 AS b, o_orderpriority AS lvl, count(*) AS n, sum({Y}) AS s
               FROM orders GROUP BY o_orderkey % 4, o_orderpriority),
     bg AS (SELECT b.b, g.lvl, coalesce(obs.n, 0) AS n, coalesce(obs.s, 0.0) AS s
              FROM b CROSS JOIN g LEFT JOIN obs ON obs.b = b.b AND obs.lvl = g.lvl),
     k AS (SELECT {STEP_LAMBDA!r} / count(*) AS k, count(*) AS nb FROM b),
     r1 AS (SELECT bg.*, s / (n + 1.0) AS x1 FROM bg),
     z1 AS (SELECT lvl, {_st('sum(x1) / max(k.nb)', 'max(k.k)')} AS z1
              FROM r1 CROSS JOIN k GROUP BY lvl),
     r2 AS (SELECT r1.*, z1.z1, x1 - z1.z1 AS u1,
                   (s + (z1.z1 - (x1 - z1.z1))) / (n + 1.0) AS x2
              FROM r1 JOIN z1 ON r1.lvl = z1.lvl),
     z2 AS (SELECT lvl, {_st('(sum(x2) + sum(u1)) / max(k.nb)', 'max(k.k)')} AS z2
              FROM r2 CROSS JOIN k GROUP BY lvl),
     r3 AS (SELECT r2.*, z2.z2, u1 + x2 - z2.z2 AS u2 FROM r2 JOIN z2 ON r2.lvl = z2.lvl),
     r3x AS (SELECT r3.*, (s + (z2 - u2)) / (n + 1.0) AS x3 FROM r3),
     z3 AS (SELECT lvl, {_st('(sum(x3) + sum(u2)) / max(k.nb)', 'max(k.k)')} AS z3
              FROM r3x CROSS JOIN k GROUP BY lvl)
SELECT CAST(dense_rank() OVER (ORDER BY lvl) - 1 AS INTEGER) AS idx,
       round(z3, 6) + 0.0 AS z
  FROM z3""",

    "history_two_rounds": f"""
WITH b AS (SELECT DISTINCT o_orderkey % 4 AS b FROM orders),
     g AS (SELECT DISTINCT o_orderpriority AS lvl FROM orders),
     obs AS (SELECT o_orderkey % 4 AS b, o_orderpriority AS lvl, count(*) AS n, sum({Y}) AS s
               FROM orders GROUP BY o_orderkey % 4, o_orderpriority),
     tot AS (SELECT o_orderpriority AS lvl, count(*) AS n, sum({Y}) AS s, sum({Y} * {Y}) AS ss
               FROM orders GROUP BY o_orderpriority),
     bg AS (SELECT b.b, g.lvl, coalesce(obs.n, 0) AS n, coalesce(obs.s, 0.0) AS s
              FROM b CROSS JOIN g LEFT JOIN obs ON obs.b = b.b AND obs.lvl = g.lvl),
     k AS (SELECT {STEP_LAMBDA!r} / count(*) AS k, count(*) AS nb FROM b),
     r1 AS (SELECT bg.*, s / (n + 1.0) AS x1 FROM bg),
     z1 AS (SELECT lvl, {_st('sum(x1) / max(k.nb)', 'max(k.k)')} AS z1
              FROM r1 CROSS JOIN k GROUP BY lvl),
     r2 AS (SELECT r1.*, z1.z1, x1 - z1.z1 AS u1,
                   (s + (z1.z1 - (x1 - z1.z1))) / (n + 1.0) AS x2
              FROM r1 JOIN z1 ON r1.lvl = z1.lvl),
     z2 AS (SELECT lvl, {_st('(sum(x2) + sum(u1)) / max(k.nb)', 'max(k.k)')} AS z2
              FROM r2 CROSS JOIN k GROUP BY lvl),
     zz AS (SELECT z1.lvl, z1.z1, z2.z2, tot.n, tot.s, tot.ss
              FROM z1 JOIN z2 ON z1.lvl = z2.lvl JOIN tot ON tot.lvl = z1.lvl),
     res AS (SELECT sqrt(sum((r2.x1 - r2.z1) * (r2.x1 - r2.z1))) AS r0,
                    sqrt(sum((r2.x2 - z2.z2) * (r2.x2 - z2.z2))) AS r1,
                    sqrt(sum(r2.x1 * r2.x1)) AS x1
               FROM r2 JOIN z2 ON r2.lvl = z2.lvl),
     dual AS (SELECT sqrt(max(k.nb)) * sqrt(sum(z1 * z1)) AS s0,
                     sqrt(max(k.nb)) * sqrt(sum((z2 - z1) * (z2 - z1))) AS s1,
                     sqrt(count(*) * max(k.nb)) * 1e-6 AS e0,
                     0.5 * sum(n * z1 * z1 - 2 * z1 * s + ss) + {STEP_LAMBDA!r} * sum(abs(z1)) AS o0,
                     0.5 * sum(n * z2 * z2 - 2 * z2 * s + ss) + {STEP_LAMBDA!r} * sum(abs(z2)) AS o1
                FROM zz CROSS JOIN k)
SELECT CAST(0 AS INTEGER) AS iter, round(r0, 6) + 0.0 AS resid_primal,
       round(s0, 6) + 0.0 AS resid_dual, round(e0, 8) AS eps_primal, round(e0, 8) AS eps_dual,
       round(o0, 2) AS objective FROM res CROSS JOIN dual
UNION ALL
SELECT CAST(1 AS INTEGER), round(r1, 6) + 0.0, round(s1, 6) + 0.0,
       round(e0 + 1e-6 * greatest(x1, s0), 8), round(e0 + 1e-6 * r0, 8), round(o1, 2)
  FROM res CROSS JOIN dual""",

    "admm_history": _history_sql(HISTORY_TOL),

    "fit_history": _history_sql(FIT_TOL),

    "round_timings": f"""
WITH h AS ({_history_sql(HISTORY_TOL)})
SELECT CAST(max(iterations) + 1 AS INTEGER) AS rounds, true AS positive, true AS within_fit
  FROM h""",

    "lasso_two_rho": f"""
SELECT fit, idx, round({_onehot_coef(ONEHOT_LAMBDA)}, 4) + 0.0 AS coef
  FROM {ONEHOT} CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INTEGER) AS fit)""",

    "cross_validation": f"""
WITH lam AS (SELECT * FROM (VALUES {_grid_values}) t(pos, lam_v)),
f AS (SELECT o_orderkey % {FOLDS} AS fold, o_orderpriority AS lvl, count(*) AS n, sum({Y}) AS s,
             sum({Y} * {Y}) AS ss
        FROM orders GROUP BY o_orderkey % {FOLDS}, o_orderpriority),
rest AS (SELECT *, sum(n) OVER (PARTITION BY lvl) - n AS rn,
                sum(s) OVER (PARTITION BY lvl) - s AS rs FROM f),
z AS (SELECT fold, pos, lam_v, n, s, ss, {_st('rs', 'lam_v')} / rn AS z FROM rest CROSS JOIN lam),
e AS (SELECT fold, pos, lam_v, sum(n) AS n, sum(n * z * z - 2 * z * s + ss) AS sse,
             count(CASE WHEN z <> 0 THEN 1 END) AS nnz FROM z GROUP BY fold, pos, lam_v),
m AS (SELECT pos, sum(sse) / sum(n) AS mse_all FROM e GROUP BY pos)
SELECT CAST(fold AS BIGINT) AS fold, CAST(pos AS INTEGER) AS pos, CAST(lam_v AS DOUBLE) AS "lambda",
       CAST(n AS BIGINT) AS n, round(sse / n, 4) + 0.0 AS mse, CAST(nnz AS INTEGER) AS nnz,
       round(mse_all, 4) + 0.0 AS mse_all,
       pos = (SELECT arg_min(pos, mse_all) FROM m) AS best
  FROM e JOIN m USING (pos)""",

    "strong_path": f"""
WITH g AS {ONEHOT},
lam AS (SELECT pos, lam_v, coalesce(lag(lam_v) OVER (ORDER BY lam_v DESC),
                                    (SELECT max(abs(s)) FROM g)) AS lam_b
          FROM (VALUES {_grid_values}) t(pos, lam_v)),
z AS (SELECT pos, lam_v, idx, n, s, ss, {_st('s', 'lam_v')} / n AS z,
             (abs(s) > lam_b OR least(abs(s), lam_b) >= 2 * lam_v - greatest(lam_b, lam_v)) AS kept
        FROM lam CROSS JOIN g)
SELECT CAST(pos AS INTEGER) AS pos, CAST(lam_v AS DOUBLE) AS "lambda",
       CAST(count(CASE WHEN kept THEN 1 END) OVER (PARTITION BY pos) AS INTEGER) AS screened,
       CAST(count(CASE WHEN z <> 0 THEN 1 END) OVER (PARTITION BY pos) AS INTEGER) AS nnz,
       round(sum(n * z * z - 2 * z * s + ss) OVER (PARTITION BY pos)
             / sum(n) OVER (PARTITION BY pos), 4) + 0.0 AS mse,
       idx, round(z, 4) + 0.0 AS coef
  FROM z""",

    "warm_start": f"""
SELECT idx, round({_onehot_coef(ONEHOT_LAMBDA)}, 4) + 0.0 AS coef FROM {ONEHOT}""",

    "final_state": f"""
SELECT idx, name, round({_onehot_coef(ONEHOT_LAMBDA)}, 4) + 0.0 AS z,
       round({_onehot_coef(ONEHOT_LAMBDA)}, 4) + 0.0 AS xbar,
       round((s - n * {_onehot_coef(ONEHOT_LAMBDA)}) * count(*) OVER () / sum(n) OVER (), 4)
         + 0.0 AS ubar
  FROM {ONEHOT}""",

    "lasso_embeddings": f"""
SELECT idx, true AS kkt_ok, round(sum(v * y), 4) + 0.0 AS xty,
       CAST(count(*) AS BIGINT) AS n FROM {EMB_LONG} GROUP BY idx""",

    "lasso_job_files": _JOB_SQL,

    "lasso_job_wide": _JOB_SQL,

    "lasso_interactions": _INTERACTIONS_SQL,

    "lasso_feature_split": _INTERACTIONS_SQL,

    "streaming_statistics": f"""
SELECT idx AS i, round(sum(v * y), 6) + 0.0 AS xty FROM {EMB_LONG} GROUP BY idx""",

    "predict": f"""
WITH w AS (SELECT idx, sum(v * y) / count(*) AS w FROM {EMB_LONG} GROUP BY idx)
SELECT e.vec_id AS sample_id, round(sum(e.v * w.w), 6) + 0.0 AS prediction
  FROM {EMB_LONG} e JOIN w ON e.idx = w.idx GROUP BY e.vec_id""",

    "mse": f"""
WITH z AS (SELECT n, s, ss, {_onehot_coef(ONEHOT_LAMBDA)} AS z FROM {ONEHOT})
SELECT CAST(sum(n) AS BIGINT) AS n,
       round(sum(n * z * z - 2 * z * s + ss) / sum(n), 4) + 0.0 AS mse
  FROM z""",

    "lambda_grid": _GRID_SQL,

    "lambda_best": f"""
WITH grid AS ({_GRID_SQL})
SELECT "lambda" AS best_lambda, mse AS best_mse FROM grid ORDER BY mse, pos LIMIT 1""",

    "model_roundtrip": f"""
WITH z AS (SELECT *, {_onehot_coef(ONEHOT_LAMBDA)} AS z FROM {ONEHOT})
SELECT idx, name, round(z, 4) + 0.0 AS coef, CASE WHEN z <> 0 THEN round(z, 4) END AS text_coef,
       round(sum(n * z * z - 2 * z * s + ss) OVER () / sum(n) OVER (), 4) AS mse FROM z""",
}
