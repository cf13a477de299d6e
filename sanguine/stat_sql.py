"""DuckDB SQL for the tests of methods, by other routes than the library's: Newton steps for quantiles, quadrature for tails, windows for Walsh averages."""

from __future__ import annotations


def below(x: str) -> str:
    """Normal distribution function: rationals of Hart (1968, no. 5666), good for |x| < 7; fixed values."""
    top = ("0.0352624965998911", "0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871", "221.213596169931", "220.206867912376")
    bottom = ("0.0883883476483184", "1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674", "637.333633378831", "793.826512519948", "440.413735824752")

    def poly(c):
        out = c[0]
        for v in c[1:]:
            out = f"({out} * abs({x}) + {v})"
        return out

    tail = f"(CASE WHEN abs({x}) > 7 THEN 0.0 ELSE exp(-({x}) * ({x}) / 2) * CAST({poly(top)} AS DOUBLE) / CAST({poly(bottom)} AS DOUBLE) END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def cells(metrics: dict[str, str], by: str) -> str:
    """cl (set, block, method, value) of medians; metrics: expressions over orders by name."""
    each = " UNION ALL ".join(f"SELECT {by} || '|{m}' AS set, CAST(c_nationkey AS VARCHAR) AS block, c_mktsegment AS method, CAST({e} AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey" for m, e in metrics.items())
    return f"""rs AS ({each}), md AS (SELECT set, block, method, median(value) AS value FROM rs GROUP BY ALL),
kk AS (SELECT set, count(DISTINCT method) AS k FROM md GROUP BY set),
cl AS (SELECT md.*, k, n FROM md JOIN kk USING (set) JOIN (SELECT set, block FROM md JOIN kk USING (set) GROUP BY set, block, k HAVING count(*) = k) USING (set, block) JOIN (SELECT set, count(*) AS n FROM (SELECT set, block FROM md JOIN kk USING (set) GROUP BY set, block, k HAVING count(*) = k) GROUP BY set) USING (set))"""


# quantiles by Newton's steps from the middle, which close in from one side
NORMAL = f"""sc AS (SELECT set, method, value, n, k, (row_number() OVER (PARTITION BY set, method ORDER BY value) - 0.375) / (n + 0.25) AS p FROM cl),
sq AS (SELECT *, list_reduce(range(60), lambda x, i: x + (p - {below("x")}) / (exp(-x * x / 2) / sqrt(2 * pi())), CAST(0.0 AS DOUBLE)) AS m FROM sc),
sw AS (SELECT set, method, n, k, CASE WHEN n > 4 AND max(value) > min(value) THEN pow(covar_pop(value, m), 2) / (var_pop(value) * var_pop(m)) END AS w FROM sq GROUP BY set, method, n, k),
sp AS (SELECT *, 1 - {below("z")} AS p FROM (SELECT *, (ln(1 - w) - (-1.2725 + 1.0521 * (ln(ln(n)) - ln(n)))) / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))) AS z FROM sw))"""


def beta_tail(f: str, d1: str, d2: str) -> str:
    """F's tail by Simpson's rule over u, u ** 2 the beta variable's value from the left: an integrand without poles for whole degrees of freedom."""
    top = f"sqrt({d2} / ({d2} + {d1} * {f}))"
    g = f"(2 * pow(u * {top} / 2000, {d2} - 1) * pow(1 - pow(u * {top} / 2000, 2), {d1} / 2.0 - 1))"
    return f"list_sum(list_transform(range(0, 2001), lambda u: {g} * CASE WHEN u IN (0, 2000) THEN 1 WHEN u % 2 = 1 THEN 4 ELSE 2 END)) * {top} / 6000 * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0))"


LEVENE = f"""fd AS (SELECT set, method, k, n, abs(value - median(value) OVER (PARTITION BY set, method)) AS d FROM cl),
lv AS (SELECT set, k, n, (n * k - k) * between_ / ((k - 1) * within_) AS f FROM (SELECT set, k, n, sum(pow(m - a, 2)) AS between_, sum(pow(d - m, 2)) AS within_
  FROM (SELECT *, avg(d) OVER (PARTITION BY set, method) AS m, avg(d) OVER (PARTITION BY set) AS a FROM fd) GROUP BY ALL)),
lp AS (SELECT *, {beta_tail("f", "(k - 1)", "(n * k - k)")} AS p FROM lv)"""

CHOICE = """ch AS (SELECT s.set, s.k, s.n, s.normal, coalesce(lp.p >= 0.05, false) AS equal, CASE WHEN normal AND coalesce(lp.p >= 0.05, false) THEN 'anova' ELSE 'friedman' END AS test
  FROM (SELECT set, k, n, min(coalesce(p, -1)) >= 0.05 / k AS normal FROM sp GROUP BY set, k, n) s JOIN lp USING (set))"""

ERROR = """an AS (SELECT set, k, n, sum(pow(value - mb - mm + ma, 2)) / ((k - 1) * (n - 1)) AS mse, sum(pow(mm - ma, 2)) / (k - 1) AS msm
  FROM (SELECT *, avg(value) OVER (PARTITION BY set, block) AS mb, avg(value) OVER (PARTITION BY set, method) AS mm, avg(value) OVER (PARTITION BY set) AS ma FROM cl) GROUP BY set, k, n),
rk AS (SELECT *, (SELECT 0.5 + count(*) FILTER (WHERE b.value < a.value) + count(*) FILTER (WHERE b.value = a.value) / 2.0 FROM cl b WHERE b.set = a.set AND b.block = a.block) AS r FROM cl a)"""

OMNIBUS = f"""fr AS (SELECT m.set, k, n, 12 * n / (k * (k + 1)) * sum(pow(r - (k + 1) / 2.0, 2)) / (1 - any_value(t) / (n * k * (k * k - 1.0))) AS x
  FROM (SELECT set, k, n, method, avg(r) AS r FROM rk GROUP BY ALL) m JOIN (SELECT set, sum(c * c * c - c) AS t FROM (SELECT set, block, value, count(*) AS c FROM cl GROUP BY ALL) GROUP BY set) USING (set) GROUP BY m.set, k, n)
SELECT set, k, n, normal, equal, test, round(statistic, 6) AS statistic, dof1, dof2, round(p, 6) AS p, p < 0.05 AS differ FROM (
  SELECT ch.*, msm / mse AS statistic, CAST(k - 1 AS DOUBLE) AS dof1, CAST((k - 1) * (n - 1) AS DOUBLE) AS dof2, {beta_tail("(msm / mse)", "(k - 1)", "((k - 1) * (n - 1))")} AS p FROM ch JOIN an USING (set, k, n) WHERE test = 'anova'
  UNION ALL SELECT ch.*, x, CAST(k - 1 AS DOUBLE), NULL, exp(-x / 2) * list_sum(list_transform(range(0, (k - 1) // 2), lambda i: pow(x / 2, i) / gamma(i + 1))) FROM ch JOIN fr USING (set, k, n) WHERE test = 'friedman')"""

# the studentised range by sums over places z of the smallest value and, with an estimated error, over the estimate s
PAIRS = f"""lv2 AS (SELECT ch.set, 'tukey' AS test, method, ch.k, avg(value) AS v, sqrt(any_value(mse) / any_value(ch.n)) AS se, any_value((ch.k - 1) * (ch.n - 1)) AS dof FROM ch JOIN cl USING (set) JOIN an USING (set) WHERE test = 'anova' GROUP BY ALL
  UNION ALL SELECT ch.set, 'nemenyi', method, ch.k, avg(r), sqrt(ch.k * (ch.k + 1) / (12.0 * any_value(ch.n))), NULL FROM ch JOIN rk USING (set) WHERE test = 'friedman' GROUP BY ch.set, method, ch.k),
pr AS (SELECT a.set, a.test, a.method AS a, b.method AS b, a.v - b.v AS gap, abs(a.v - b.v) / a.se AS q, a.k, a.dof FROM lv2 a JOIN lv2 b ON a.set = b.set AND a.method < b.method),
ss AS (SELECT DISTINCT dof, s, CASE WHEN dof IS NULL THEN 1.0 ELSE exp(ln(2) + dof / 2.0 * ln(dof / 2.0) - lgamma(dof / 2.0) + (dof - 1) * ln(s) - dof * s * s / 2) * 0.01 END AS weight
  FROM (SELECT DISTINCT dof FROM lv2), LATERAL (SELECT unnest(CASE WHEN dof IS NULL THEN [1.0] ELSE list_transform(range(1, 300), lambda i: i * 0.01) END) AS s)),
zz AS (SELECT z * 0.1 AS z, {below("z * 0.1")} AS c, exp(-z * z * 0.005) / sqrt(2 * pi()) * 0.1 AS d FROM (SELECT unnest(range(-70, 71)) AS z)),
tl AS (SELECT set, a, b, 1 - sum(k * d * weight * pow(c - {below("(z - q * s)")}, k - 1)) AS p FROM pr JOIN ss ON pr.dof IS NOT DISTINCT FROM ss.dof, zz GROUP BY ALL)
SELECT set, test, a, b, round(gap, 6) AS gap, round(q, 6) AS q, round(p, 5) + 0.0 AS p, p < 0.05 AS differ FROM pr JOIN tl USING (set, a, b)"""


def posterior(draws: int, rope: str) -> str:
    """Posterior shares from the same seeded draws: counters mixed in 128-bit numbers, shares by running sums over the ordered differences."""
    m = "18446744073709551615::UHUGEINT"
    mul = lambda x, c: f"(({x} * {c}::UHUGEINT) & {m})"
    return f"""dv AS (SELECT set, method, var_samp(value) AS v FROM cl GROUP BY ALL),
df AS (SELECT a.set, a.method AS a, b.method AS b, a.value - b.value AS z FROM cl a JOIN cl b ON a.set = b.set AND a.block = b.block AND a.method < b.method),
zs AS (SELECT set, a, b, z, row_number() OVER (PARTITION BY set, a, b ORDER BY z) AS i FROM df),
pq AS (SELECT df.set, df.a, df.b, count(*) AS n, {rope} * sqrt((any_value(x.v) + any_value(y.v)) / 2) AS rope, ('0x' || substr(md5('|' || df.set || '|' || df.a || '|' || df.b), 1, 12))::BIGINT AS seed
  FROM df JOIN dv x ON x.set = df.set AND x.method = df.a JOIN dv y ON y.set = df.set AND y.method = df.b GROUP BY ALL),
un AS (SELECT set, a, b, n, draw, i, (CAST(x >> 12 AS DOUBLE) + 0.5) / 4503599627370496 AS u FROM (SELECT set, a, b, n, draw, i, xor(y, y >> 31) AS x FROM (SELECT set, a, b, n, draw, i, {mul("xor(y, y >> 27)", "10723151780598845931")} AS y
  FROM (SELECT set, a, b, n, draw, i, {mul("xor(y, y >> 30)", "13787848793156543929")} AS y FROM (SELECT set, a, b, n, draw, i, {mul("(seed + draw * (n + 3) + i)::UHUGEINT", "11400714819323198485")} AS y
  FROM pq, LATERAL (SELECT unnest(range({draws})) AS draw), LATERAL (SELECT unnest(range(1, n + 4)) AS i)))))),
gm AS (SELECT set, a, b, draw, i, -ln(u) AS g FROM un WHERE i <= n UNION ALL
  SELECT set, a, b, draw, 0, -ln(min(u) FILTER (i = n + 2)) * pow(cos(2 * pi() * min(u) FILTER (i = n + 3)), 2) FROM un GROUP BY set, a, b, draw),
zz AS (SELECT set, a, b, i, z, row_number() OVER (PARTITION BY set, a, b ORDER BY z, i) AS o FROM (SELECT * FROM zs UNION ALL SELECT set, a, b, 0.0, 0 FROM pq)),
lo AS (SELECT p.set, p.a, p.b, p.i, p.o, count(*) FILTER (WHERE q.z < -2 * rope - p.z) AS l, count(*) FILTER (WHERE q.z <= 2 * rope - p.z) AS h FROM zz p JOIN zz q USING (set, a, b) JOIN pq USING (set, a, b) GROUP BY ALL),
rn AS (SELECT set, a, b, draw, o, l, h, g, sum(g) OVER (PARTITION BY set, a, b, draw ORDER BY o) AS c, sum(g) OVER (PARTITION BY set, a, b, draw) AS t FROM gm JOIN lo USING (set, a, b, i)),
th AS (SELECT x.set, x.a, x.b, x.draw, sum(x.g * coalesce(l.c, 0)) / any_value(x.t) / any_value(x.t) AS s, sum(x.g * (x.t - coalesce(h.c, 0))) / any_value(x.t) / any_value(x.t) AS g
  FROM rn x LEFT JOIN rn l ON l.set = x.set AND l.a = x.a AND l.b = x.b AND l.draw = x.draw AND l.o = x.l LEFT JOIN rn h ON h.set = x.set AND h.a = x.a AND h.b = x.b AND h.draw = x.draw AND h.o = x.h GROUP BY ALL),
wn AS (SELECT set, a, b, count(*) FILTER (1 - s - g < s AND s >= g) / {draws} AS p_smaller, count(*) FILTER (1 - s - g >= s AND 1 - s - g >= g) / {draws} AS p_equal, count(*) FILTER (1 - s - g < g AND g > s) / {draws} AS p_larger FROM th GROUP BY ALL)
SELECT set, a, b, CAST(n AS INTEGER) AS n, round(rope, 2) AS rope, round(p_smaller, 6) AS p_smaller, round(p_equal, 6) AS p_equal, round(p_larger, 6) AS p_larger,
  CASE WHEN p_smaller >= 0.95 THEN 'smaller' WHEN p_equal >= 0.95 THEN 'equal' WHEN p_larger >= 0.95 THEN 'larger' ELSE 'inconclusive' END AS decision FROM wn JOIN pq USING (set, a, b)"""
