"""DuckDB SQL of filters and methods over windows of 80 samples, by other routes than the library's numpy.

Each function gives the text of common table expressions that read `win` (video_id, win_idx, win_pos, r, g, b) and end in a
table of the given name: (video_id, win_idx, x list), or rows with win_pos. Recursions run over a window's list.
"""

from __future__ import annotations

N = 80

ROWS = "SELECT video_id, win_idx, CAST(i - 1 AS INTEGER) AS win_pos, round(x[i], {digits}) + 0.0 AS x FROM {name}, (SELECT unnest(range(1, 81)) AS i)"


def rows(name: str, digits: int) -> str:
    """One row for each sample of a table of lists."""
    return ROWS.format(name=name, digits=digits)


def doubles(values) -> str:
    return "[" + ", ".join(f"{float(v):.17e}" for v in values) + "]"


def signal(name: str = "sg", column: str = "g") -> str:
    return f"{name} AS (SELECT video_id, win_idx, list({column} ORDER BY win_pos) AS x FROM win GROUP BY ALL)"


def centred(source: str, name: str) -> str:
    return f"{name} AS (SELECT video_id, win_idx, list_transform(x, lambda v: v - list_avg(x)) AS x FROM {source})"


def _difference_equation(x: str, past: str, b, a) -> str:
    """y[t] = sum b[k] x[t-k] - sum a[k] y[t-k], over list x, whose past values are all `past`; past outputs are 0."""
    n = len(b) - 1
    padded = f"list_concat(list_transform(range({n}), lambda q: {past}), {x})"
    made = f"list_transform(range(1, len({x}) + 1), lambda i: [list_dot_product({padded}[i:i + {n}], {doubles(b[::-1])})])"
    step = f"list_append(s, e[1] - list_dot_product(s[len(s) - {n - 1}:len(s)], {doubles(a[:0:-1])}))"
    return f"list_reduce(list_prepend({doubles([0] * n)}, {made}), lambda s, e: {step})[{n + 1}:]"


def causal(source: str, name: str, b, a) -> str:
    return f"{name} AS (SELECT video_id, win_idx, {_difference_equation('x', '0.0', b, a)} AS x FROM {source})"


def zero_phase(source: str, name: str, b, a) -> str:
    """Forwards and backwards over the signal, extended oddly. A band-pass is at rest on a constant, so it starts at 0 there."""
    pad = 3 * len(b)
    head = f"list_transform(range({pad}), lambda i: 2 * x[1] - x[{pad + 1} - i])"
    tail = f"list_transform(range({pad}), lambda i: 2 * x[{N}] - x[{N - 1} - i])"
    return f"""{name}_e AS (SELECT video_id, win_idx, list_concat({head}, x, {tail}) AS x FROM {source}),
{name}_f AS (SELECT video_id, win_idx, list_reverse({_difference_equation('x', 'x[1]', b, a)}) AS x FROM {name}_e),
{name} AS (SELECT video_id, win_idx, list_reverse({_difference_equation('x', 'x[1]', b, a)})[{pad + 1}:{pad + N}] AS x FROM {name}_f)"""


def smoothness(source: str, name: str, weight: float) -> str:
    """x - y, where (I + weight D'D) y = x for second differences D: two substitutions with the factors of five diagonals."""
    main = [1 + weight * v for v in (1, 5, *[6] * (N - 4), 5, 1)]
    near = [weight * v for v in (-2, *[-4] * (N - 3), -2)]
    d, one, two = [], [], []
    for i in range(N):
        pivot = main[i]
        if i > 0:
            pivot -= one[i - 1] ** 2 * d[i - 1]
        if i > 1:
            pivot -= two[i - 2] ** 2 * d[i - 2]
        d.append(pivot)
        one.append(((near[i] if i < N - 1 else 0) - (two[i - 1] * d[i - 1] * one[i - 1] if 0 < i < N - 1 else 0)) / pivot)
        two.append((weight if i < N - 2 else 0) / pivot)

    def substituted(elements: str) -> str:
        return f"list_reduce(list_prepend([0.0::DOUBLE, 0.0::DOUBLE], {elements}), lambda s, e: list_append(s, e[1] - e[2] * s[len(s)] - e[3] * s[len(s) - 1]))[3:]"

    forth = f"list_transform(range(1, {N + 1}), lambda i: [x[i], {doubles([0] + one[:-1])}[i], {doubles([0, 0] + two[:-2])}[i]])"
    back = f"list_transform(range(1, {N + 1}), lambda i: [z[{N + 1} - i] / {doubles(d[::-1])}[i], {doubles(one[::-1])}[i], {doubles(two[::-1])}[i]])"
    return f"""{name}_z AS (SELECT video_id, win_idx, x, {substituted(forth)} AS z FROM {source}),
{name}_y AS (SELECT video_id, win_idx, x, list_reverse({substituted(back)}) AS y FROM {name}_z),
{name} AS (SELECT video_id, win_idx, list_transform(x, lambda v, i: v - y[i]) AS x FROM {name}_y)"""


def polynomial_rest(source: str, name: str, window: int = 31, degree: int = 5) -> str:
    """x without its local polynomial fit, from Gram's polynomials P[k+1] = t P[k] - k^2 (w^2 - k^2) / (4 (4 k^2 - 1)) P[k-1]."""
    half = window // 2
    steps = [f"SELECT t, 1.0::DOUBLE AS p0, t::DOUBLE AS p1 FROM (SELECT unnest(range({-half}, {half + 1})) AS t)"]
    for k in range(1, degree):
        steps.append(f"SELECT *, t * p{k} - {k * k * (window**2 - k * k) / (4 * (4 * k * k - 1))!r} * p{k - 1} AS p{k + 1} FROM ({steps[-1]})")
    weight = " + ".join(f"u.p{k} * v.p{k} / (SELECT sum(p{k} * p{k}) FROM {name}_p)" for k in range(degree + 1))
    place = f"CASE WHEN i < {half} THEN i - {half} WHEN i >= {N - half} THEN i - {N - 1 - half} ELSE 0 END"
    return f"""{name}_p AS ({steps[-1]}),
{name}_w AS (SELECT u.t AS place, list({weight} ORDER BY v.t) AS w FROM {name}_p u, {name}_p v GROUP BY u.t),
{name}_i AS (SELECT i, w, least(greatest(i - {half}, 0), {N - window}) AS first FROM (SELECT unnest(range({N})) AS i) JOIN {name}_w ON place = {place}),
{name} AS (SELECT video_id, win_idx, list(x[i + 1] - list_dot_product(x[first + 1:first + {window}], w) ORDER BY i) AS x FROM {source}, {name}_i GROUP BY ALL)"""


def pos(name: str = "po", width: int = 16) -> str:
    """Rows of the plane orthogonal to skin: short windows from sample 1 on, added where they overlap; sample 0 is 0."""
    key = "PARTITION BY video_id, win_idx, s"
    return f"""{name}_c AS (SELECT video_id, win_idx, s, win_pos, r / (avg(r) OVER w + 1e-9) AS r, g / (avg(g) OVER w + 1e-9) AS g, b / (avg(b) OVER w + 1e-9) AS b
  FROM win, (SELECT unnest(range(1, {N - width + 1})) AS s) WHERE win_pos BETWEEN s AND s + {width - 1} WINDOW w AS ({key})),
{name}_s AS (SELECT video_id, win_idx, s, win_pos, g - b AS u, g + b - 2 * r AS v FROM {name}_c),
{name}_h AS (SELECT *, u + stddev_pop(u) OVER w / (stddev_pop(v) OVER w + 1e-9) * v AS h FROM {name}_s WINDOW w AS ({key})),
{name}_m AS (SELECT video_id, win_idx, win_pos, h - avg(h) OVER ({key}) AS h FROM {name}_h),
{name} AS (SELECT video_id, win_idx, win_pos, sum(h) AS x FROM {name}_m GROUP BY ALL UNION ALL SELECT video_id, win_idx, 0, 0.0 FROM win WHERE win_pos = 0)"""


def _adjugate(l: str) -> dict[str, str]:
    """Cofactors of the symmetric matrix (rr, rg, rb, gg, gb, bb) less l times the identity: a multiple of u u' for an eigenvalue l."""
    a, d, f = f"(rr - {l})", f"(gg - {l})", f"(bb - {l})"
    return {"rr": f"({d} * {f} - gb * gb)", "rg": f"(rb * gb - rg * {f})", "rb": f"(rg * gb - rb * {d})", "gg": f"({a} * {f} - rb * rb)", "gb": f"(rg * rb - gb * {a})", "bb": f"({a} * {d} - rg * rg)"}


_MOMENTS = ", ".join(f"sum({p} * {q}) AS {p}{q}" for p, q in ("rr", "rg", "rb", "gg", "gb", "bb"))


def lgi(name: str = "lg") -> str:
    """Rows of green without the largest eigenvector's part; the eigenvalue from the characteristic cubic by its cosine form."""
    c = _adjugate("l")
    det = "((rr - q) * ((gg - q) * (bb - q) - gb * gb) - rg * (rg * (bb - q) - gb * rb) + rb * (rg * gb - (gg - q) * rb))"
    return f"""{name}_m AS (SELECT video_id, win_idx, {_MOMENTS} FROM win GROUP BY ALL),
{name}_q AS (SELECT *, (rr + gg + bb) / 3 AS q FROM {name}_m),
{name}_p AS (SELECT *, sqrt(((rr - q) ** 2 + (gg - q) ** 2 + (bb - q) ** 2 + 2 * (rg * rg + rb * rb + gb * gb)) / 6) AS p FROM {name}_q),
{name}_l AS (SELECT *, q + 2 * p * cos(acos(least(1, greatest(-1, {det} / (2 * p * p * p)))) / 3) AS l FROM {name}_p),
{name}_u AS (SELECT video_id, win_idx, {c['rr']} + {c['gg']} + {c['bb']} AS tr, {c['rg']} AS cr, {c['gg']} AS cg, {c['gb']} AS cb FROM {name}_l),
{name} AS (SELECT video_id, win_idx, win_pos, g - (cr * r + cg * g + cb * b) / tr AS x FROM win JOIN {name}_u USING (video_id, win_idx))"""


def pca(name: str = "pc") -> str:
    """Rows (output, win_pos, x) of the two components of samples centred over their channels, whose matrix has the third eigenvalue 0."""
    c = _adjugate("l")
    first = lambda p: f"CASE WHEN {c['rr']} >= greatest({c['gg']}, {c['bb']}) THEN {c[''.join(sorted('r' + p, key='rgb'.index))]} WHEN {c['gg']} >= {c['bb']} THEN {c[''.join(sorted('g' + p, key='rgb'.index))]} ELSE {c[''.join(sorted('b' + p, key='rgb'.index))]} END"
    return f"""{name}_d AS (SELECT video_id, win_idx, win_pos, r - (r + g + b) / 3 AS r, g - (r + g + b) / 3 AS g, b - (r + g + b) / 3 AS b FROM win),
{name}_m AS (SELECT video_id, win_idx, {_MOMENTS} FROM {name}_d GROUP BY ALL),
{name}_l AS (SELECT *, (rr + gg + bb) / 2 + s * sqrt(greatest((rr + gg + bb) ** 2 / 4 - (rr * gg - rg * rg + rr * bb - rb * rb + gg * bb - gb * gb), 0)) AS l FROM {name}_m, (VALUES (0, 1), (1, -1)) v(output, s)),
{name}_u AS (SELECT video_id, win_idx, output, l, {first('r')} AS u, {first('g')} AS v, {first('b')} AS w FROM {name}_l),
{name}_x AS (SELECT video_id, win_idx, output, win_pos, (u * r + v * g + w * b) / sqrt(u * u + v * v + w * w) * sqrt(l) / 2 AS x FROM {name}_d JOIN {name}_u USING (video_id, win_idx)),
{name} AS (SELECT video_id, win_idx, output, win_pos, x * sign(arg_max(x, abs(x)) OVER (PARTITION BY video_id, win_idx, output)) AS x FROM {name}_x)"""
