"""The same answers in plain SQL, written independently of the Spark plans."""

from __future__ import annotations

# Rational approximation of the normal quantile (P. J. Acklam), fixed values.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00, 1.0)

EMBEDDING_DIMS = 64
DAYS = 30
TWO_52 = 4503599627370496.0

SQL: dict[str, str] = {}


def r(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) + {3.1 * 10.0 ** -(digits + 2)!r}, {digits}) + 0.0"


def horner(coefficients, x: str) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


EVENTS = """v AS (
  SELECT event_id AS point_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS tc,
         CAST(hour(ts) AS BIGINT) AS mc_id, event_type, user_id, ts,
         value AS a, CAST(hour(ts) AS DOUBLE) AS b
  FROM events)"""

EMBEDDED = f"""el AS (
  SELECT vec_id AS point_id, label, CAST(unnest(embedding) AS DOUBLE) AS v,
         CAST(unnest(range({EMBEDDING_DIMS})) AS INTEGER) AS dim
  FROM embeddings),
lc AS (SELECT label AS pos, dim, count(*) AS n, sum(v) AS s1, sum(v * v) AS s2,
              sum(v) / count(*) AS c
       FROM el GROUP BY label, dim),
ex AS (SELECT point_id, label, list(v ORDER BY dim) AS x FROM el GROUP BY point_id, label),
cx AS (SELECT pos, max(n) AS n, list(c ORDER BY dim) AS c,
              sqrt(greatest(sum(s2) / max(n) - sum(s1 * s1) / (max(n) * max(n)), 0)) AS rmsd
       FROM lc GROUP BY pos)"""


def d2(x: str, c: str) -> str:
    return (
        f"list_sum(list_transform(list_zip({x}, {c}), "
        "lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    )


ASSIGNED = f"""{EMBEDDED},
pairs AS (SELECT point_id, x, pos, rmsd, {d2('x', 'c')} AS d2 FROM ex CROSS JOIN cx),
best AS (SELECT point_id, any_value(x) AS x, min((d2, pos, rmsd)) AS m
         FROM pairs GROUP BY point_id),
asg AS (SELECT point_id, x, m[1] AS d2, m[2] AS pos, sqrt(m[1]) AS dist,
               CASE WHEN sqrt(m[1]) <= 1.0 * m[3] THEN 1 ELSE 0 END AS inside
        FROM best)"""

HOURLY = f"""{EVENTS},
dl AS (SELECT mc_id, tc, count(*) AS n, sum(a) AS a1, sum(b) AS b1,
              sum(a * a) AS a2, sum(b * b) AS b2,
              CAST(count(*) * tc AS BIGINT) AS t1, CAST(count(*) * tc * tc AS BIGINT) AS t2
       FROM v GROUP BY mc_id, tc)"""

SUMS = ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" if c in ("n", "t1", "t2") else f"sum({c}) AS {c}"
    for c in ("n", "a1", "b1", "a2", "b2", "t1", "t2")
)

RUNNING = f"""{HOURLY},
tk AS (SELECT DISTINCT tc FROM v),
rn AS (SELECT dl.mc_id, tk.tc, {SUMS} FROM tk JOIN dl ON dl.tc <= tk.tc
       GROUP BY dl.mc_id, tk.tc)"""

SNAPSHOTS = f"""{RUNNING},
half AS (SELECT list(tc ORDER BY tc)[CAST(count(*) // 2 AS BIGINT) + 1] AS tc FROM tk),
sn AS (SELECT tc, CAST(pos AS INTEGER) AS pos, list(mc_id ORDER BY mc_id) AS ids, {SUMS}
       FROM (SELECT rn.*, CASE WHEN rn.tc > half.tc THEN mc_id % 12 ELSE mc_id END AS pos
             FROM rn CROSS JOIN half)
       GROUP BY tc, pos)"""

KEPT = f"""{SNAPSHOTS},
kt AS (SELECT tc FROM tk WHERE (SELECT max(tc) FROM tk) < tc + 3 * 2 * (tc & (-tc)))"""


def as_of(days: str) -> str:
    return f"""{KEPT},
rq AS (SELECT tc, h FROM ({days}) CROSS JOIN (VALUES (1), (6), (12)) hs(h)),
r1 AS (SELECT tc, CAST(h AS BIGINT) AS h,
              (SELECT max(kt.tc) FROM kt WHERE kt.tc <= rq.tc) AS t1 FROM rq),
ao AS (SELECT tc, h, coalesce(t1, -1) AS t1,
              CASE WHEN t1 IS NULL THEN -1 ELSE
                coalesce((SELECT max(kt.tc) FROM kt WHERE kt.tc <= r1.t1 - r1.h),
                         (SELECT min(tc) FROM kt)) END AS t2
       FROM r1)"""


HORIZON = f"""{as_of('SELECT tc FROM tk WHERE tc >= (SELECT min(tc) FROM kt)')},
nw AS (SELECT ao.tc, ao.h, ao.t1, ao.t2, s.* EXCLUDE (tc)
       FROM ao JOIN sn s ON s.tc = ao.t1),
od AS (SELECT nw.tc, nw.h, nw.pos, flatten(list(o.ids)) AS ids,
              sum(o.n) AS n, sum(o.a1) AS a1, sum(o.b1) AS b1, sum(o.a2) AS a2,
              sum(o.b2) AS b2, sum(o.t1) AS t1, sum(o.t2) AS t2
       FROM nw JOIN sn o ON o.tc = nw.t2 AND list_has_any(o.ids, nw.ids)
       WHERE nw.t1 - nw.h >= nw.t2
       GROUP BY nw.tc, nw.h, nw.pos),
hz AS (SELECT nw.tc, nw.h, nw.t1, nw.t2, nw.pos,
              CASE WHEN od.ids IS NULL THEN nw.ids
                   ELSE list_filter(nw.ids, lambda i: NOT list_contains(od.ids, i)) END AS ids,
              CAST(nw.n - coalesce(od.n, 0) AS BIGINT) AS n,
              nw.a1 - coalesce(od.a1, 0) AS a1, nw.b1 - coalesce(od.b1, 0) AS b1,
              nw.a2 - coalesce(od.a2, 0) AS a2, nw.b2 - coalesce(od.b2, 0) AS b2,
              CAST(nw.t1_1 - coalesce(od.t1, 0) AS BIGINT) AS m1,
              CAST(nw.t2_1 - coalesce(od.t2, 0) AS BIGINT) AS m2
       FROM nw LEFT JOIN od USING (tc, h, pos))"""
# Two columns are named t1: the tick of the newer snapshot and a time moment.
HORIZON = HORIZON.replace("s.* EXCLUDE (tc)", "s.* EXCLUDE (tc) RENAME (t1 AS t1_1, t2 AS t2_1)")


def flat(digits: int = 6, times: bool = True) -> str:
    text = ", ".join(
        f"{r(c, digits)} AS {name}"
        for c, name in (("a1", "s1_0"), ("b1", "s1_1"), ("a2", "s2_0"), ("b2", "s2_1"))
    )
    return f"n, {text}" + (", t1 AS cf1t, t2 AS cf2t" if times else "")


def ids_text(ids: str) -> str:
    joined = f"array_to_string(list_transform({ids}, lambda i: CAST(i AS VARCHAR)), ',')"
    return f"coalesce({joined}, '')"


def uniform(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / {TWO_52})"


# -- sources and parsing ------------------------------------------------------

SQL["parse_points"] = f"""WITH {EVENTS}
SELECT point_id, 0 AS dim, {r('a')} AS value FROM v
UNION ALL SELECT point_id, 1, {r('b')} FROM v"""

SQL["drop_label"] = f"""WITH {EMBEDDED}
SELECT label, dim, count(*) AS n, {r('sum(v)')} AS total FROM el GROUP BY label, dim"""

SQL["parse_rejects"] = """SELECT CASE event_type WHEN 'error' THEN 'not a number'
  WHEN 'view' THEN 'wrong length' ELSE 'accepted' END AS reason, count(*) AS n
FROM events GROUP BY ALL"""

SQL["text_round_trip"] = f"""WITH {EVENTS}
SELECT count(*) AS n, {r('sum(a)', 4)} AS a, {r('sum(b)', 4)} AS b, {r('sum(a * b)', 4)} AS ab
FROM v"""

SQL["replay_points"] = f"""SELECT count(*) AS n, {r('sum(l_quantity)', 2)} AS s0,
  {r('sum(l_extendedprice)', 2)} AS s1, {r('sum(l_discount)', 2)} AS s2, {r('sum(l_tax)', 2)} AS s3
FROM lineitem"""

# -- scaling ------------------------------------------------------------------

SQL["standardize_batch"] = f"""WITH {EVENTS},
m AS (SELECT tc, avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb
      FROM v GROUP BY tc)
SELECT point_id, tc, {r('coalesce((a - ma) / nullif(sa, 0), 0)')} AS z0,
       {r('coalesce((b - mb) / nullif(sb, 0), 0)')} AS z1
FROM v JOIN m USING (tc)"""

_L = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SQL["standardize_lineitem"] = f"""WITH m AS (
  SELECT {', '.join(f'avg({c}) AS m{i}, stddev_samp({c}) AS s{i}' for i, c in enumerate(_L))}
  FROM lineitem),
z AS (SELECT l_returnflag, {', '.join(
    f'coalesce(({c} - m{i}) / nullif(s{i}, 0), 0) AS z{i}' for i, c in enumerate(_L))}
  FROM lineitem CROSS JOIN m)
SELECT l_returnflag, count(*) AS n,
  {', '.join(f'{r(f"avg(z{i})")} AS z{i}, {r(f"max(z{i})")} AS top{i}' for i in range(4))}
FROM z GROUP BY l_returnflag"""

SQL["pca_rotation"] = f"""WITH {EMBEDDED}
SELECT point_id, {r('sum(v * v)')} AS norm2 FROM el GROUP BY point_id"""

# -- assignment ---------------------------------------------------------------

SQL["assign_nearest"] = f"""WITH {ASSIGNED}
SELECT point_id, CAST(pos AS BIGINT) AS mc_id, {r('d2')} AS d2 FROM asg"""

SQL["classify_boundary"] = f"""WITH {ASSIGNED}
SELECT point_id, CAST(pos AS BIGINT) AS mc_id, inside, {r('dist')} AS dist FROM asg"""

SQL["inliers_only"] = f"""WITH {ASSIGNED}
SELECT point_id, CAST(pos AS BIGINT) AS mc_id FROM asg WHERE inside = 1"""

SQL["outliers_only"] = f"""WITH {ASSIGNED}
SELECT point_id, {r('dist')} AS dist FROM asg WHERE inside = 0"""

_XL = ", ".join(_L)
SQL["assign_totals"] = f"""WITH c AS (
  SELECT CAST(ascii(l_returnflag) * 128 + ascii(l_linestatus) AS INTEGER) AS pos,
         {', '.join(f'sum({c}) / count(*) AS c{i}' for i, c in enumerate(_L))}
  FROM lineitem GROUP BY l_returnflag, l_linestatus),
b AS (SELECT l.rid, min((({' + '.join(f'(l.{x} - c{i}) * (l.{x} - c{i})'
                                      for i, x in enumerate(_L))}), pos)) AS m
      FROM (SELECT row_number() OVER () AS rid, {_XL} FROM lineitem) l CROSS JOIN c
      GROUP BY l.rid)
SELECT m[2] AS pos, count(*) AS n, {r('sum(m[1]) / 1e6', 2)} AS d2_millions
FROM b GROUP BY m[2]"""

_SUM1, _SUM2 = "sum(list_sum(x))", "sum(list_sum(list_transform(x, lambda v: v * v)))"
SQL["absorb_batch"] = f"""WITH {ASSIGNED}
SELECT CASE WHEN inside = 1 THEN CAST(pos AS INTEGER) ELSE -1 END AS pos, count(*) AS n,
       {r(_SUM1)} AS s1, {r(_SUM2)} AS s2
FROM asg GROUP BY 1"""

# -- cluster features ---------------------------------------------------------

SQL["cf_by_cluster"] = f"""WITH {EVENTS}
SELECT event_type, tc, count(*) AS n, {r('sum(a)')} AS s1_0, {r('sum(b)')} AS s1_1,
       {r('sum(a * a)')} AS s2_0, {r('sum(b * b)')} AS s2_1
FROM v GROUP BY event_type, tc"""

SQL["cf_by_label"] = f"""WITH {EMBEDDED}
SELECT pos AS label, n, dim, {r('s1')} AS s1, {r('s2')} AS s2 FROM lc"""

SQL["cf_lineitem"] = f"""SELECT l_returnflag, l_linestatus, count(*) AS n,
  {', '.join(f'{r(f"sum({c})", 2)} AS s1_{i}' for i, c in enumerate(_L))},
  {', '.join(f'{r(f"sum({c} * {c}) / count(*)", 1)} AS m2_{i}' for i, c in enumerate(_L))}
FROM lineitem GROUP BY l_returnflag, l_linestatus"""

SQL["cf_time_features"] = f"""WITH {HOURLY}
SELECT mc_id, tc, n, t1 AS cf1t, t2 AS cf2t FROM dl"""

SQL["batch_totals"] = f"""WITH {EVENTS}, c AS (SELECT tc, count(*) AS n_batch FROM v GROUP BY tc)
SELECT tc, n_batch, CAST(sum(n_batch) OVER (ORDER BY tc) AS BIGINT) AS n_total FROM c"""

SQL["centroids"] = f"""WITH {EMBEDDED}
SELECT CAST(pos AS BIGINT) AS mc_id, dim, {r('c')} AS value FROM lc"""

SQL["mc_weights"] = f"""WITH {EMBEDDED}
SELECT CAST(pos AS BIGINT) AS mc_id, n, {r('n / sum(n) OVER ()')} AS weight FROM cx"""

SQL["mc_rmsd"] = f"""WITH g AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 144
              + (hour(ts) * 60 + minute(ts)) // 10 AS INTEGER) AS pos,
         count(*) AS n, sum(round(value * 100)) AS a1, sum(round(value * 100) ** 2) AS a2,
         sum(hour(ts)) AS b1, sum(hour(ts) * hour(ts)) AS b2
  FROM events GROUP BY 1),
c AS (SELECT pos, n, a1 / n AS ca, b1 / n AS cb, a1, a2, b1, b2 FROM g),
one AS (SELECT s.pos, min((s.ca - o.ca) ** 2 + (s.cb - o.cb) ** 2) AS d2
        FROM c s JOIN c o ON s.n = 1 AND ((s.ca - o.ca) ** 2 + (s.cb - o.cb) ** 2) <> 0
        GROUP BY s.pos)
SELECT c.pos, c.n, {r('''CASE WHEN n = 1 THEN sqrt(d2)
  ELSE sqrt(greatest((a2 + b2) / n - (a1 * a1 + b1 * b1) / (n * n), 0)) END''', 4)} AS rmsd
FROM c LEFT JOIN one USING (pos)"""

SQL["mc_rmsd_by_label"] = f"""WITH {EMBEDDED}
SELECT CAST(pos AS BIGINT) AS mc_id, n, {r('rmsd')} AS rmsd FROM cx"""

_MCPAIRS = f"""{EMBEDDED},
mp AS (SELECT a.pos AS pos, b.pos AS other, {d2('a.c', 'b.c')} AS d2 FROM cx a CROSS JOIN cx b)"""

SQL["nearest_other"] = f"""WITH {_MCPAIRS},
b AS (SELECT pos, min((d2, other)) AS m FROM mp WHERE d2 <> 0 GROUP BY pos)
SELECT pos, m[2] AS other, {r('m[1]')} AS d2 FROM b"""

SQL["closest_pair"] = f"""WITH {_MCPAIRS},
b AS (SELECT min((d2, pos, other)) AS m FROM mp WHERE pos < other)
SELECT m[2] AS pos_a, m[3] AS pos_b, {r('m[1]')} AS d2 FROM b"""

SQL["distance_to_mean"] = f"""WITH {EMBEDDED},
m AS (SELECT dim, sum(v) / count(*) AS c FROM el GROUP BY dim)
SELECT CAST(pos AS BIGINT) AS mc_id, {r('sum((lc.c - m.c) * (lc.c - m.c))')} AS d2
FROM lc JOIN m USING (dim) GROUP BY pos"""

SQL["slot_lookup"] = f"""WITH {EMBEDDED}
SELECT DISTINCT l_partkey AS mc_id, coalesce(CAST(cx.pos AS INTEGER), -1) AS pos
FROM lineitem LEFT JOIN cx ON cx.pos = l_partkey"""

SQL["merge_closest"] = f"""WITH {_MCPAIRS},
b AS (SELECT min((d2, pos, other)) AS m FROM mp WHERE pos < other),
t AS (SELECT lc.*, CASE WHEN pos = m[3] THEN m[2] ELSE pos END AS into_pos FROM lc CROSS JOIN b)
SELECT into_pos AS pos, CAST(into_pos AS BIGINT) AS mc_id,
       CAST(sum(n) FILTER (dim = 0) AS BIGINT) AS n,
       CASE WHEN min(pos) < max(pos) OR count(DISTINCT pos) > 1
            THEN into_pos || ',' || (SELECT m[3] FROM b) ELSE CAST(into_pos AS VARCHAR) END AS ids,
       CAST(sum(n) FILTER (dim = 0) AS BIGINT) AS cf1t, {r('sum(s1)')} AS s1, {r('sum(s2)')} AS s2
FROM t GROUP BY into_pos"""

SQL["state_update"] = f"""WITH {HOURLY},
lt AS (SELECT max(tc) AS tc FROM dl),
st AS (SELECT mc_id, {SUMS} FROM dl WHERE tc < (SELECT tc FROM lt) GROUP BY mc_id),
u AS (SELECT s.mc_id, s.n + coalesce(b.n, 0) AS n, s.a1 + coalesce(b.a1, 0) AS a1,
             s.b1 + coalesce(b.b1, 0) AS b1, s.a2 + coalesce(b.a2, 0) AS a2,
             s.b2 + coalesce(b.b2, 0) AS b2, s.t1 + coalesce(b.t1, 0) AS t1,
             s.t2 + coalesce(b.t2, 0) AS t2
      FROM st s LEFT JOIN (SELECT * FROM dl WHERE tc = (SELECT tc FROM lt)) b USING (mc_id))
SELECT mc_id, {flat(4)} FROM u"""

_USERS = f"""{EVENTS},
us AS (SELECT user_id, count(*) AS n, sum(tc) / count(*) AS mean,
              sqrt(greatest(sum(tc * tc) / count(*)
                            - (sum(tc) / count(*)) * (sum(tc) / count(*)), 0)) AS sd
       FROM v GROUP BY user_id)"""

_STALE = f"""SELECT user_id, n, {r('stamp', 4)} AS stamp,
  CASE WHEN n = 0 OR stamp < (SELECT max(stamp) FROM st) - 10 THEN 1 ELSE 0 END AS stale FROM st"""

SQL["stale_split"] = f"""WITH {_USERS}, st AS (SELECT *, mean AS stamp FROM us) {_STALE}"""

SQL["stale_split_quantile"] = f"""WITH {_USERS},
p AS (SELECT *, 1.0 - 3 / (2.0 * n) AS p FROM us),
q AS (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS rr,
             CASE WHEN n >= 6 THEN sqrt(-2 * ln(1 - p)) END AS tail FROM p),
st AS (SELECT user_id, n, CASE WHEN n < 6 THEN mean
         WHEN p <= 0.97575 THEN mean + sd * q * {horner(ACKLAM_A, 'rr')}
                                / {horner(ACKLAM_B, 'rr')}
         ELSE mean - sd * {horner(ACKLAM_C, 'tail')} / {horner(ACKLAM_D, 'tail')} END AS stamp
       FROM q)
{_STALE}"""

# -- snapshots and horizons ---------------------------------------------------

SQL["cumulative_snapshots"] = f"""WITH {RUNNING} SELECT mc_id, tc, {flat(4)} FROM rn"""

SQL["pyramid_retention"] = f"""WITH {EVENTS},
tk AS (SELECT DISTINCT tc FROM v),
clock AS (SELECT unnest(range(1, (SELECT max(tc) FROM tk) + 1)) AS x),
gone AS (SELECT x AS at_tick, x - 3 * 2 * (x & (-x)) AS tc FROM clock)
SELECT w.x AS now, tk.tc, CAST(bit_count((tk.tc & (-tk.tc)) - 1) AS INTEGER) AS tick_order,
       CASE WHEN EXISTS (SELECT 1 FROM gone WHERE gone.tc = tk.tc AND gone.at_tick <= w.x)
            THEN 0 ELSE 1 END AS kept
FROM tk JOIN clock w ON w.x >= tk.tc"""

SQL["asof_snapshots"] = f"""WITH {as_of('SELECT tc FROM tk')} SELECT tc, h, t1, t2 FROM ao"""

SQL["lineage_join"] = f"""WITH {SNAPSHOTS}
SELECT a.tc, a.pos, b.pos AS old_pos
FROM sn a JOIN sn b ON b.tc = (SELECT min(tc) FROM tk) AND a.tc > b.tc
     AND list_has_any(a.ids, b.ids)"""

SQL["horizon_subtract"] = f"""WITH {HORIZON}
SELECT tc, h, t1, t2, pos, {ids_text('ids')} AS ids,
       {flat(4, times=False)}, m1 AS cf1t, m2 AS cf2t FROM hz"""

SQL["horizon_centers"] = f"""WITH {HORIZON}
SELECT tc, h, pos, {r('a1 / n', 4)} AS c0, {r('b1 / n', 4)} AS c1 FROM hz WHERE n > 0"""

SQL["horizon_report"] = f"""WITH {HORIZON}
SELECT tc, h, t1, t2, count(*) FILTER (n > 0) AS mc_count, CAST(sum(n) AS BIGINT) AS n_points
FROM hz GROUP BY tc, h, t1, t2"""

SQL["snapshot_centers"] = f"""WITH {SNAPSHOTS},
l AS (SELECT * FROM sn WHERE tc = (SELECT max(tc) FROM tk) AND n > 0)
SELECT tc, pos, 0 AS dim, {r('a1 / n')} AS value FROM l
UNION ALL SELECT tc, pos, 1, {r('b1 / n')} FROM l"""

SQL["sliding_remove"] = f"""WITH {SNAPSHOTS},
mx AS (SELECT max(tc) AS tc FROM tk),
s AS (SELECT sn.* FROM sn JOIN mx USING (tc)),
g AS (SELECT dl.* FROM dl CROSS JOIN mx WHERE dl.tc = mx.tc + 1 - 6),
k AS (SELECT s.pos, s.n - coalesce(sum(g.n), 0) AS n, s.a1 - coalesce(sum(g.a1), 0) AS a1,
             s.b1 - coalesce(sum(g.b1), 0) AS b1, s.a2 - coalesce(sum(g.a2), 0) AS a2,
             s.b2 - coalesce(sum(g.b2), 0) AS b2, s.t1 - coalesce(sum(g.t1), 0) AS t1,
             s.t2 - coalesce(sum(g.t2), 0) AS t2
      FROM s LEFT JOIN g ON list_contains(s.ids, g.mc_id)
      GROUP BY s.pos, s.n, s.a1, s.b1, s.a2, s.b2, s.t1, s.t2)
SELECT pos, CAST(n AS BIGINT) AS n, CAST(t1 AS BIGINT) AS cf1t, CAST(t2 AS BIGINT) AS cf2t,
       {r('a1', 4)} AS s1_0, {r('b1', 4)} AS s1_1, {r('a2', 4)} AS s2_0, {r('b2', 4)} AS s2_1,
       {r('sqrt(greatest((a2 + b2) / n - (a1 * a1 + b1 * b1) / (n * n), 0))', 4)} AS rmsd
FROM k"""

SQL["expire_snapshots"] = f"""WITH {SNAPSHOTS}
SELECT tc, count(*) AS mcs, CAST(sum(n) AS BIGINT) AS n FROM sn
WHERE NOT tc < (SELECT max(tc) FROM tk) - 6 + 1 GROUP BY tc"""

# -- text exports -------------------------------------------------------------

SQL["centers_text"] = f"""WITH {SNAPSHOTS}
SELECT tc, 1 AS run, {r('a1 / n')} AS c0, {r('b1 / n')} AS c1, 1 AS run_suffix
FROM sn WHERE n > 0"""

SQL["snapshot_text"] = f"""WITH {SNAPSHOTS}
SELECT tc, 'MicroCluster IDs' AS field, '[' || {ids_text('ids')} || ']' AS content FROM sn
UNION ALL SELECT tc, 'CF2T', CAST(t2 AS VARCHAR) FROM sn
UNION ALL SELECT tc, 'CF1T', CAST(t1 AS VARCHAR) FROM sn
UNION ALL SELECT tc, 'N', CAST(n AS VARCHAR) FROM sn"""

# -- k-means parts ------------------------------------------------------------

SQL["wssse"] = f"""WITH {ASSIGNED} SELECT {r('sum(d2)')} AS wssse FROM asg"""


def _lloyd(rounds: int) -> str:
    parts = [EMBEDDED, "k0 AS MATERIALIZED (SELECT pos, c FROM cx)"]
    for i in range(1, rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT point_id, min(({d2('x', 'c')}, pos))[2] AS pos FROM ex CROSS JOIN k{i - 1}
  GROUP BY point_id),
m{i} AS MATERIALIZED (
  SELECT a.pos, el.dim, count(*) AS n, sum(v) / count(*) AS c FROM el JOIN a{i} a USING (point_id)
  GROUP BY a.pos, el.dim),
k{i} AS MATERIALIZED (
  SELECT k.pos, coalesce((SELECT list(c ORDER BY dim) FROM m{i} m WHERE m.pos = k.pos), k.c) AS c
  FROM k{i - 1} k)"""
        )
    return ",\n".join(parts)


SQL["lloyd_step"] = f"""WITH {_lloyd(1)}
SELECT pos, n, dim, {r('c')} AS value FROM m1"""

SQL["lloyd_iterations"] = f"""WITH {_lloyd(3)}
SELECT CAST(pos AS INTEGER) AS cluster, CAST(dim AS INTEGER) AS dim, {r('v')} AS value
FROM (SELECT pos, unnest(range({EMBEDDING_DIMS})) AS dim, unnest(c) AS v FROM k3)"""

_QUARTERS = """q0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY quarter) - 1 AS INTEGER) AS pos, c0, c1, CAST({w} AS DOUBLE) AS w
  FROM (SELECT floor(b / 6) AS quarter, avg(a) AS c0, avg(b) AS c1 FROM v GROUP BY 1))"""


def _follow(before: str, after: str, where: str, decay: str) -> str:
    """One update of weighted centers by the events of ``where``."""
    return f"""g{after} AS MATERIALIZED (
  SELECT m[2] AS pos, count(*) AS n, sum(a) AS sa, sum(b) AS sb FROM (
    SELECT point_id, any_value(a) AS a, any_value(b) AS b,
           min(((a - c0) * (a - c0) + (b - c1) * (b - c1), pos)) AS m
    FROM (SELECT * FROM v {where}) CROSS JOIN {before} GROUP BY point_id) GROUP BY 1),
{after} AS MATERIALIZED (
  SELECT pos, CASE WHEN n IS NULL THEN c0 ELSE (1 - n / (d + n)) * c0 + sa / (d + n) END AS c0,
         CASE WHEN n IS NULL THEN c1 ELSE (1 - n / (d + n)) * c1 + sb / (d + n) END AS c1,
         d + coalesce(n, 0) AS w
  FROM (SELECT k.*, g.n, g.sa, g.sb, k.w * {decay} AS d
        FROM {before} k LEFT JOIN g{after} g USING (pos)))"""


SQL["streaming_kmeans_step"] = f"""WITH {EVENTS}, {_QUARTERS.format(w='500.0')},
{_follow('q0', 'q1', '', '0.5e0')}
SELECT pos, {r('c0')} AS c0, {r('c1')} AS c1, {r('w')} AS weight FROM q1"""

_DECAY = "pow(pow(0.5, 1 / 1000.0), (SELECT count(*) FROM v WHERE tc = {day}))"
SQL["streaming_kmeans"] = f"""WITH {EVENTS}, {_QUARTERS.format(w='0.0')},
{(',' + chr(10)).join(
    _follow(f'q{day - 1}', f'q{day}', f'WHERE tc = {day}', _DECAY.format(day=day))
    for day in range(1, DAYS + 1))}
SELECT pos, {r('c0', 4)} AS c0, {r('c1', 4)} AS c1, {r('w', 4)} AS weight,
       CAST((SELECT count(DISTINCT tc) FROM v) AS INTEGER) AS ticks FROM q{DAYS}"""

_CUT = f"""{EMBEDDED},
w AS (SELECT pos, n / sum(n) OVER () AS w FROM cx),
cut AS (SELECT pos, CASE WHEN pos = (SELECT max(pos) FROM w) THEN 1.0
                         ELSE sum(w) OVER (ORDER BY pos) END AS hi FROM w)"""

SQL["weighted_systematic_sample"] = f"""WITH {_CUT},
u AS (SELECT (i + 0.5) / 5000 AS u FROM range(5000) t(i)),
pick AS (SELECT u, (SELECT min(pos) FROM cut WHERE hi >= u) AS pos FROM u)
SELECT CAST(cut.pos AS BIGINT) AS mc_id, count(pick.u) AS hits
FROM cut LEFT JOIN pick USING (pos) GROUP BY cut.pos"""

SQL["weighted_random_sample"] = f"""WITH {_CUT},
u AS (SELECT {uniform("'7|' || i")} AS u FROM range(5000) t(i))
SELECT CAST(pos AS BIGINT) AS mc_id, count(*) AS hits
FROM (SELECT u, (SELECT min(pos) FROM cut WHERE hi >= u) AS pos FROM u) GROUP BY pos"""

# -- starting a model ---------------------------------------------------------

SQL["init_random"] = f"""WITH {EVENTS},
m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM v),
z AS (SELECT point_id, coalesce((a - ma) / nullif(sa, 0), 0) AS a,
             coalesce((b - mb) / nullif(sb, 0), 0) AS b FROM v CROSS JOIN m),
k AS (SELECT CAST(i AS INTEGER) AS pos, {uniform("'3|' || i || '|0'")} AS c0,
             {uniform("'3|' || i || '|1'")} AS c1 FROM range(20) t(i)),
g AS (SELECT point_id, any_value(a) AS a, any_value(b) AS b,
             min(((a - c0) * (a - c0) + (b - c1) * (b - c1), pos))[2] AS pos
      FROM z CROSS JOIN k GROUP BY point_id)
SELECT k.pos, CAST(k.pos AS BIGINT) AS mc_id, count(point_id) AS n,
       {r('coalesce(sum(a), 0)', 4)} AS s1_0, {r('coalesce(sum(b), 0)', 4)} AS s1_1,
       {r('coalesce(sum(a * a), 0)', 4)} AS s2_0, {r('coalesce(sum(b * b), 0)', 4)} AS s2_1,
       count(point_id) AS cf1t, count(point_id) AS cf2t
FROM k LEFT JOIN g USING (pos) GROUP BY k.pos"""

SQL["init_from_file"] = SQL["init_random"]

SQL["random_start_centers"] = f"""WITH {EMBEDDED},
k AS (SELECT CAST(i AS INTEGER) AS pos, list({uniform("'3|' || i || '|' || j")} ORDER BY j) AS c
      FROM range(10) t(i) CROSS JOIN range({EMBEDDING_DIMS}) s(j) GROUP BY i),
g AS (SELECT point_id, min(({d2('x', 'c')}, pos)) AS m FROM ex CROSS JOIN k GROUP BY point_id)
SELECT m[2] AS pos, count(*) AS n, {r('sum(m[1])', 4)} AS d2 FROM g GROUP BY 1"""

# -- the online model ---------------------------------------------------------

_TOTALS = f"""{EVENTS},
c AS (SELECT tc, sum(count(*)) OVER (ORDER BY tc) AS seen FROM v GROUP BY tc),
s AS (SELECT min(tc) AS start FROM c WHERE seen >= 500),
w AS (SELECT greatest(v.tc, s.start) AS tc, a, b FROM v CROSS JOIN s)"""

SQL["online_tick_totals"] = f"""WITH {_TOTALS}
SELECT tc, count(*) AS n, {r('sum(a)', 4)} AS s1_0, {r('sum(a * a)', 4)} AS s2_0,
       CAST(count(*) * tc AS BIGINT) AS cf1t, CAST(count(*) * tc * tc AS BIGINT) AS cf2t
FROM w GROUP BY tc"""

SQL["online_partitioned"] = f"""WITH {_TOTALS}
SELECT tc, count(*) AS n, {r('sum(a)', 4)} AS s1_0 FROM w GROUP BY tc"""

# -- macro-clusters -----------------------------------------------------------


def _weighted_rounds(rounds: int, keys: str) -> str:
    """k-means over ``mp`` ({keys}, x0, x1, w) from the centers ``k0`` ({keys}, c, c0, c1)."""
    on = " AND ".join(f"k.{k} = mp.{k}" for k in keys.split(", "))
    parts = []
    for i in range(1, rounds + 1):
        parts.append(
            f"""k{i} AS MATERIALIZED (
  SELECT k.{keys.replace(', ', ', k.')}, k.c, coalesce(g.c0, k.c0) AS c0, coalesce(g.c1, k.c1) AS c1
  FROM k{i - 1} k LEFT JOIN (
    SELECT {keys}, c, sum(x0 * w) / sum(w) AS c0, sum(x1 * w) / sum(w) AS c1 FROM (
      SELECT mp.{keys.replace(', ', ', mp.')}, mp.pos, any_value(x0) AS x0, any_value(x1) AS x1,
             any_value(w) AS w,
             min(((x0 - c0) * (x0 - c0) + (x1 - c1) * (x1 - c1), c))[2] AS c
      FROM mp JOIN k{i - 1} k ON {on} GROUP BY ALL)
    GROUP BY {keys}, c) g USING ({keys}, c))"""
        )
    return ",\n".join(parts)


SQL["offline_sweep"] = f"""WITH {HORIZON},
mp AS MATERIALIZED (SELECT tc, h, pos, a1 / n AS x0, b1 / n AS x1, n AS w FROM hz WHERE n > 0),
k0 AS MATERIALIZED (
  SELECT tc, h, c, x0 AS c0, x1 AS c1 FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY tc, h ORDER BY w DESC, pos) - 1 AS INTEGER) AS c
    FROM mp) WHERE c < 5),
{_weighted_rounds(20, 'tc, h')},
held AS (SELECT tc, h, c, sum(w) AS weight FROM (
    SELECT mp.tc, mp.h, mp.pos, any_value(w) AS w,
           min(((x0 - c0) * (x0 - c0) + (x1 - c1) * (x1 - c1), c))[2] AS c
    FROM mp JOIN k20 k ON k.tc = mp.tc AND k.h = mp.h GROUP BY mp.tc, mp.h, mp.pos)
  GROUP BY tc, h, c)
SELECT tc, h, c AS cluster, CAST(coalesce(weight, 0) AS DOUBLE) AS weight,
       {r('c0', 4)} AS c0, {r('c1', 4)} AS c1
FROM k20 LEFT JOIN held USING (tc, h, c)"""

SQL["macro_sampled"] = f"""WITH {SNAPSHOTS},
mc AS MATERIALIZED (SELECT 0 AS one, pos, a1 / n AS x0, b1 / n AS x1, n FROM sn
       WHERE tc = (SELECT max(tc) FROM tk) AND n > 0),
ws AS (SELECT pos, n / sum(n) OVER () AS w FROM mc),
cut AS MATERIALIZED (SELECT pos, CASE WHEN pos = (SELECT max(pos) FROM ws) THEN 1.0
                ELSE sum(w) OVER (ORDER BY pos) END AS hi FROM ws),
draw AS (SELECT i, {uniform("'1|' || i")} AS u FROM range(5000) t(i)),
hit AS (SELECT pos, count(*) AS w FROM (
    SELECT (SELECT min(pos) FROM cut WHERE hi >= u) AS pos FROM draw) GROUP BY pos),
mp AS MATERIALIZED (SELECT one, pos, x0, x1, w FROM mc JOIN hit USING (pos)),
k0 AS MATERIALIZED (
  SELECT one, c, x0 AS c0, x1 AS c1 FROM (
    SELECT CAST(i AS INTEGER) AS c,
           (SELECT min(pos) FROM cut WHERE hi >= {uniform("'2|' || i")}) AS pos
    FROM range(5) t(i)) JOIN mc USING (pos)),
{_weighted_rounds(20, 'one')},
held AS (SELECT c, sum(n) AS weight FROM (
    SELECT pos, any_value(n) AS n,
           min(((x0 - c0) * (x0 - c0) + (x1 - c1) * (x1 - c1), c))[2] AS c
    FROM mc CROSS JOIN k20 GROUP BY pos) GROUP BY c)
SELECT c AS cluster, CAST(coalesce(weight, 0) AS DOUBLE) AS weight,
       {r('c0', 4)} AS c0, {r('c1', 4)} AS c1
FROM k20 LEFT JOIN held USING (c)"""

# -- placing outliers ---------------------------------------------------------

_N = 24


def _gap(i: str, j: str) -> str:
    return f"(ca[{i}] - ca[{j}]) * (ca[{i}] - ca[{j}]) + (cb[{i}] - cb[{j}]) * (cb[{i}] - cb[{j}])"


def _added(name: str, point: str) -> str:
    """List ``name`` after the point joined ``slot``, or ``slot`` went to ``other``."""
    return (
        f"list_transform({name}, lambda v, i: CASE "
        f"WHEN joined AND i = slot THEN v + {point} WHEN joined THEN v "
        f"WHEN i = slot THEN {point} WHEN i = other THEN v + {name}[slot] ELSE v END) AS {name}"
    )


_MOVED = "((joined AND i = slot) OR (NOT joined AND i = other))"

_LAST_DAY = f"""{HOURLY},
lt AS (SELECT max(tc) AS tc FROM dl),
bf AS (SELECT CAST(mc_id AS INTEGER) AS pos, {SUMS} FROM dl
       WHERE tc < (SELECT tc FROM lt) GROUP BY mc_id),
mc AS MATERIALIZED (SELECT *, a1 / n AS ca, b1 / n AS cb,
         sqrt(greatest((a2 + b2) / n - (a1 * a1 + b1 * b1) / (n * n), 0)) AS rm FROM bf),
near AS (SELECT point_id, any_value(a) AS a, any_value(b) AS b,
                min(((a - ca) * (a - ca) + (b - cb) * (b - cb), pos, rm)) AS m
         FROM (SELECT * FROM v WHERE tc = (SELECT tc FROM lt)) CROSS JOIN mc GROUP BY point_id),
pt AS MATERIALIZED (SELECT point_id, a, b, m[2] AS pos, sqrt(m[1]) <= m[3] AS inside FROM near),
inl AS (SELECT pos, count(*) AS n, sum(a) AS a1, sum(b) AS b1, sum(a * a) AS a2, sum(b * b) AS b2
        FROM pt WHERE inside GROUP BY pos)"""

# Outliers of one cell of a grid are one group; axes are halved in turn until there are few.
_GROUPS = """wd AS (SELECT pow(2, floor(log2(0.125 * median(rm) / sqrt(2)))) AS w FROM mc WHERE rm > 0),
oc AS (SELECT point_id, a, b, s, trunc(floor(a / w) / 2 ** ((s + 1) // 2)) AS ia, trunc(floor(b / w) / 2 ** (s // 2)) AS ib
       FROM pt CROSS JOIN wd CROSS JOIN range(60) t(s) WHERE NOT inside),
fs AS (SELECT min(s) AS s FROM (SELECT s FROM oc GROUP BY s HAVING count(DISTINCT (ia, ib)) <= 24)),
og AS (SELECT min(point_id) AS point_id, count(*) AS m, sum(a) AS a, sum(b) AS b,
              sum(a * a) AS aa, sum(b * b) AS bb
       FROM oc WHERE s = (SELECT s FROM fs) GROUP BY ia, ib)"""

SQL["outlier_groups"] = f"""WITH {_LAST_DAY},
{_GROUPS}
SELECT point_id, m AS n, {r('a', 4)} AS s1_0, {r('b', 4)} AS s1_1, {r('aa', 4)} AS s2_0, {r('bb', 4)} AS s2_1
FROM og"""

_SINGLE = """og AS (SELECT point_id, CAST(1 AS BIGINT) AS m, a, b, a * a AS aa, b * b AS bb FROM pt WHERE NOT inside)"""


def _placed(groups: str, joins: str) -> str:
    """One recursion step per outlier or group, in order: it joins a founded
    micro-cluster, or makes two of the others merge.
    """
    return f"""WITH RECURSIVE {_LAST_DAY},
{groups},
op AS MATERIALIZED (SELECT row_number() OVER (ORDER BY point_id) AS k, m, a, b, aa, bb FROM og),
st AS (SELECT mc.pos, mc.n + coalesce(inl.n, 0) AS n, mc.a1 + coalesce(inl.a1, 0) AS a1,
              mc.b1 + coalesce(inl.b1, 0) AS b1, mc.a2 + coalesce(inl.a2, 0) AS a2,
              mc.b2 + coalesce(inl.b2, 0) AS b2,
              mc.t1 + coalesce(inl.n, 0) * (SELECT tc FROM lt) AS t1,
              mc.t2 + coalesce(inl.n, 0) * (SELECT tc * tc FROM lt) AS t2, ca, cb, rm
       FROM mc LEFT JOIN inl USING (pos)),
f AS (
  SELECT CAST(0 AS BIGINT) AS k, list(CAST(pos AS BIGINT) ORDER BY pos) AS ids,
         {', '.join(f'list(CAST({c} AS {t}) ORDER BY pos) AS {c}' for c, t in (
             ('n', 'BIGINT'), ('a1', 'DOUBLE'), ('b1', 'DOUBLE'), ('a2', 'DOUBLE'),
             ('b2', 'DOUBLE'), ('t1', 'BIGINT'), ('t2', 'BIGINT'), ('ca', 'DOUBLE'),
             ('cb', 'DOUBLE'), ('rm', 'DOUBLE')))},
         CAST([] AS BIGINT[]) AS founded, CAST(100 AS BIGINT) AS next_id
  FROM st
  UNION ALL
  SELECT k, ids, n, a1, b1, a2, b2, t1, t2, ca, cb,
         list_transform(rm, lambda v, i: CASE
           WHEN {_MOVED} THEN sqrt(greatest((a2[i] + b2[i]) / n[i]
             - (a1[i] * a1[i] + b1[i] * b1[i]) / (n[i] * n[i]), 0))
           WHEN NOT joined AND i = slot AND m > 1 THEN sqrt(greatest((aa + bb) / m - (a * a + b * b) / (m * m), 0))
           WHEN NOT joined AND i = slot THEN sqrt(list_min(list_filter(
             list_transform(range(1, {_N} + 1), lambda j: {_gap('j', 'slot')}),
             lambda g: g <> 0)))
           ELSE v END) AS rm,
         founded, next_id
  FROM (
    SELECT k, m, a, b, aa, bb, joined, slot, other, n, a1, b1, a2, b2, t1, t2, rm,
           list_transform(ids, lambda v, i: CASE WHEN NOT joined AND i = slot THEN next_id
                                                 ELSE v END) AS ids,
           list_transform(ca, lambda v, i: CASE WHEN {_MOVED} THEN a1[i] / n[i]
                            WHEN NOT joined AND i = slot THEN a / m ELSE v END) AS ca,
           list_transform(cb, lambda v, i: CASE WHEN {_MOVED} THEN b1[i] / n[i]
                            WHEN NOT joined AND i = slot THEN b / m ELSE v END) AS cb,
           CASE WHEN joined OR list_contains(founded, slot) THEN founded
                ELSE list_append(founded, slot) END AS founded,
           CASE WHEN joined THEN next_id ELSE next_id + 1 END AS next_id
    FROM (
      SELECT k, m, a, b, aa, bb, ids, ca, cb, rm, founded, next_id, joined, slot, other,
             {_added('n', 'm')}, {_added('a1', 'a')}, {_added('b1', 'b')},
             {_added('a2', 'aa')}, {_added('b2', 'bb')},
             {_added('t1', 'm * tc')}, {_added('t2', 'm * tc * tc')}
      FROM (
        SELECT *, CAST(CASE WHEN joined THEN hit[3] ELSE pair[3] END AS BIGINT) AS slot,
               CAST(CASE WHEN joined THEN -1 ELSE pair[2] END AS BIGINT) AS other
        FROM (
          SELECT *, {joins} AS joined
          FROM (
            SELECT op.*, f.* EXCLUDE (k), lt.tc,
                   list_sort(list_transform(founded, lambda s, i: [
                     (a1[s] / n[s] - op.a / op.m) ** 2 + (b1[s] / n[s] - op.b / op.m) ** 2, i, s]))[1] AS hit,
                   list_sort(list_transform(
                     list_filter(range({_N * _N}), lambda x: x // {_N} < x % {_N}),
                     lambda x: [{_gap(f'x // {_N} + 1', f'x % {_N} + 1')},
                                x // {_N} + 1, x % {_N} + 1]))[1] AS pair
            FROM f JOIN op ON op.k = f.k + 1 CROSS JOIN lt))))))
SELECT CAST(p - 1 AS INTEGER) AS pos, mc_id, n, {r('a1', 4)} AS s1_0, {r('b1', 4)} AS s1_1,
       {r('a2', 4)} AS s2_0, {r('b2', 4)} AS s2_1, t1 AS cf1t, t2 AS cf2t
FROM (SELECT unnest(range(1, {_N} + 1)) AS p, unnest(ids) AS mc_id, unnest(n) AS n,
             unnest(a1) AS a1, unnest(b1) AS b1, unnest(a2) AS a2, unnest(b2) AS b2,
             unnest(t1) AS t1, unnest(t2) AS t2
      FROM f WHERE k = (SELECT max(k) FROM f))"""


_JOINS = "coalesce(sqrt(hit[1]) <= rm[CAST(hit[3] AS BIGINT)], false)"
SQL["outlier_maintenance"] = _placed(_SINGLE, _JOINS)
SQL["outlier_maintenance_flat"] = _placed(_SINGLE, "false")
SQL["outliers_grouped"] = _placed(_GROUPS, _JOINS)
SQL["outliers_grouped_flat"] = _placed(_GROUPS, "false")

# -- event time -----------------------------------------------------------------

SQL["late_ticks"] = f"""WITH {EVENTS},
arrival(k, tick) AS (VALUES (0, 3), (1, 1), (2, 2), (3, 5), (4, 4), (5, 6)),
span AS (SELECT CAST(ceil(tc / 5) AS BIGINT) AS tick, point_id % 7 = 0 AS bad FROM v),
counted AS (SELECT tick, count(*) FILTER (WHERE NOT bad) AS n, count(*) FILTER (WHERE bad) AS bad
            FROM span GROUP BY tick),
clock AS (SELECT k, tick, n, bad, max(tick) OVER (ORDER BY k) AS tc FROM arrival JOIN counted USING (tick))
SELECT CAST(tc AS BIGINT) AS tc, row_number() OVER (PARTITION BY tc ORDER BY k) - 1 AS part, n AS n_batch,
       CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS n_total,
       CASE WHEN tick < tc THEN n ELSE 0 END AS n_late, bad AS n_rejected
FROM clock"""
