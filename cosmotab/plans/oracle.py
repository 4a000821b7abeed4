"""SQL for DuckDB of each registered query, over the same tables."""

from __future__ import annotations

from cosmotab.functions.fits import CATALOG, COEFFICIENTS
from cosmotab.operators.params import DEFAULTS, PRESETS, RANGES
from cosmotab.plans import fixtures

PI2 = "(2e0*pi()*pi())"


def r8(x: str) -> str:
    return f"(round({x}, 8) + 0e0)"


def rl(x: str) -> str:
    return f"(round(ln({x}), 8) + 0e0)"


def d(x: float) -> str:
    """A double literal."""
    return repr(float(x)) if "e" in repr(float(x)) else f"{float(x)!r}e0"


def w(y: str, name: str) -> str:
    if name == "Gaussian":
        return f"exp(-0.5e0*({y})*({y}))"
    if name == "Sharp-k":
        return f"(CASE WHEN {y} <= 1e0 THEN 1e0 ELSE 0e0 END)"
    series = f"(1e0 - pow({y},2)/10e0 + pow({y},4)/280e0 - pow({y},6)/15120e0 + pow({y},8)/1330560e0 - pow({y},10)/172972800e0)"
    return f"(CASE WHEN abs({y}) < 0.1e0 THEN {series} ELSE 3e0*(sin({y})-({y})*cos({y}))/(({y})*({y})*({y})) END)"


def weights(source: str, by: str, x: str) -> str:
    """A query: the rows of source with the Simpson weight w over x."""
    over, whole = f"OVER (PARTITION BY {by} ORDER BY {x})", f"OVER (PARTITION BY {by})"
    return f"""SELECT *, (CASE WHEN i % 2 = 1 AND i < sm THEN pow(b1+a1, 3)/(6e0*b1*a1) ELSE 0e0 END)
  + (CASE WHEN i % 2 = 0 AND i+2 < sm THEN (a1+a2)/6e0*(2e0-a2/a1) ELSE 0e0 END)
  + (CASE WHEN i % 2 = 0 AND i >= 2 AND i < sm THEN (b1+b2)/6e0*(2e0-b2/b1) ELSE 0e0 END)
  + (CASE WHEN n % 2 = 0 AND n > 2 AND i = n-1 THEN (2e0*b1*b1+3e0*b2*b1)/(6e0*(b2+b1)) WHEN n % 2 = 0 AND n > 2 AND i = n-2 THEN (a1*a1+3e0*b1*a1)/(6e0*b1)
     WHEN n % 2 = 0 AND n > 2 AND i = n-3 THEN -a2*a2*a2/(6e0*a1*(a1+a2)) WHEN n = 2 THEN coalesce(a1, b1)/2e0 ELSE 0e0 END) AS w
FROM (SELECT *, n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS sm FROM (SELECT *, row_number() {over} - 1 AS i, count(*) {whole} AS n,
  {x} - lag({x}, 1) {over} AS b1, lag({x}, 1) {over} - lag({x}, 2) {over} AS b2, lead({x}, 1) {over} - {x} AS a1, lead({x}, 2) {over} - lead({x}, 1) {over} AS a2 FROM {source}) q1) q2"""


def gradient(source: str, by: str, x: str, y: str, out: str, order: int = 2) -> str:
    """A query: the rows of source with out = d ln y / d ln x."""
    over = f"OVER (PARTITION BY {by} ORDER BY {x})"
    at = ", ".join(f"{f}({c}, {k}) {over} AS {c}{s}{k}" for c in ("gu", "gf") for f, s in (("lag", "m"), ("lead", "p")) for k in (1, 2))
    first = "coalesce((gfp1-gf)/(gup1-gu), (gf-gfm1)/(gu-gum1))"
    head = "(-(2e0*(gup1-gu)+(gup2-gup1))/((gup1-gu)*(gup2-gu))*gf + (gup2-gu)/((gup1-gu)*(gup2-gup1))*gfp1 - (gup1-gu)/((gup2-gup1)*(gup2-gu))*gfp2)"
    tail = "((gu-gum1)/((gum1-gum2)*(gu-gum2))*gfm2 - (gu-gum2)/((gum1-gum2)*(gu-gum1))*gfm1 + (2e0*(gu-gum1)+(gum1-gum2))/((gu-gum1)*(gu-gum2))*gf)"
    ends = first if order == 1 else f"coalesce(CASE WHEN gum1 IS NULL THEN {head} END, CASE WHEN gup1 IS NULL THEN {tail} END, {first})"
    inner = "(-(gup1-gu)/((gu-gum1)*(gup1-gum1))*gfm1 + ((gup1-gu)-(gu-gum1))/((gu-gum1)*(gup1-gu))*gf + (gu-gum1)/((gup1-gu)*(gup1-gum1))*gfp1)"
    return f"""SELECT *, CASE WHEN gum1 IS NOT NULL AND gup1 IS NOT NULL THEN {inner} ELSE {ends} END AS {out}
FROM (SELECT *, {at} FROM (SELECT *, ln({x}) AS gu, ln(greatest({y}, 1e-300)) AS gf FROM {source}) q1) q2"""


def tail(source: str, by: str, x: str, y: str, out: str) -> str:
    return f"""SELECT *, greatest(sum(strip) OVER (PARTITION BY {by} ORDER BY {x} DESC ROWS UNBOUNDED PRECEDING), 1e-300) AS {out}
FROM (SELECT *, coalesce(0.5e0*({y}+lead({y}) OVER (PARTITION BY {by} ORDER BY {x}))*(ln(lead({x}) OVER (PARTITION BY {by} ORDER BY {x}))-ln({x})), 0e0) AS strip FROM {source}) q"""


def fit(name: str, s: str = "s", z: str = "z", dc: str = "1.686e0", om: str = "0.3e0", dh: str = "200e0") -> str:
    """f(sigma) of a fit over SQL expressions."""
    nu, zp = f"({dc}/{s})", f"(1e0+{z})"
    k = {n: d(v) for n, v in COEFFICIENTS.get(name, {}).items()}
    st = lambda: f"({k['A']}*sqrt(2e0*{k['a']}/pi())*(1e0+pow({k['a']}*{nu}*{nu}, -{k['p']}))*{nu}*exp(-0.5e0*{k['a']}*{nu}*{nu}))"
    cut = lambda A, a, b, c: f"({A}*(pow({b}/{s}, {a})+1e0)*exp(-({c})/({s}*{s})))"
    at = lambda n: f"({k[n]}*pow({zp}, {k[n + '_z']}))"
    up = f"(-ln({s}))"
    if name == "Press-Schechter 1974":
        return f"(sqrt(2e0/pi())*{nu}*exp(-0.5e0*{nu}*{nu}))"
    if name in ("Sheth-Tormen 2001", "Courtin 2010"):
        return st()
    if name == "Jenkins 2001":
        return f"({k['A']}*exp(-pow(abs({up}+{k['b']}), {k['c']})))"
    if name == "Reed 2003":
        return f"({st()}*exp(-{k['c']}/pow({s}*((exp(2e0*{s})+exp(-2e0*{s}))/2e0), {k['q']})))"
    if name == "Warren 2006":
        return f"({k['A']}*(pow({s}, -{k['a']})+{k['b']})*exp(-{k['c']}/({s}*{s})))"
    if name == "Reed 2007":
        bump = lambda i: f"{k[f'g{i}']}*exp(-({up}-{k[f'at{i}']})*({up}-{k[f'at{i}']})/{k[f'width{i}']})"
        shape = f"(1e0+pow({k['a']}*{nu}*{nu}, -{k['p']})+{bump(1)}+{bump(2)})"
        return f"({k['A']}*sqrt(2e0*{k['a']}/pi())*{shape}*{nu}*exp(-0.5e0*{k['ca']}*{k['a']}*{nu}*{nu}-{k['n']}*pow({nu}, {k['q']})))"
    if name == "Tinker 2008":
        return cut(at("A"), at("a"), f"({k['b']}*pow({zp}, -pow(10e0, -pow({k['alpha']}/log10({dh}/{k['delta']}), {k['alpha_q']}))))", k["c"])
    if name == "Crocce 2010":
        return f"({at('A')}*(pow({s}, -{at('a')})+{at('b')})*exp(-{at('c')}/({s}*{s})))"
    if name == "Bhattacharya 2011":
        an2 = f"({at('a')}*{nu}*{nu})"
        return f"({at('A')}*sqrt(2e0/pi())*exp(-0.5e0*{an2})*(1e0+pow({an2}, -{k['p']}))*pow({nu}*sqrt({at('a')}), {k['q']}))"
    if name in ("Angulo 2012", "Watson FOF 2013"):
        return cut(k["A"], k["a"], k["b"], k["c"])
    by_z = lambda n: f"(CASE WHEN {z} = 0 THEN {k[n + '0']} WHEN {z} >= 6 THEN {k[n + '6']} ELSE {om}*({at(n)}+{k[n + '_add']}) END)"
    c = f"(CASE WHEN {z} = 0 THEN {k['c0']} WHEN {z} >= 6 THEN {k['c6']} ELSE {k['c']} END)"
    over = f"({dh}/{k['delta']})"
    gamma = f"exp({k['g1']}*({over}-1e0))*pow({over}, -{k['g2']}*{om}-{k['g3']})*exp({k['g4']}*(1e0-{over})/pow({s}, {k['g5']}))"
    return f"({gamma}*{cut(by_z('A'), by_z('a'), by_z('b'), c)})"


RHO = "(Omega_m*2.775e11*(H0/100e0)*(H0/100e0))"
OMEGA_R = "(2.469e-5*pow(2.7255e0/2.7255e0, 4)*(1e0+0.22710731766e0*3.046e0)/((H0/100e0)*(H0/100e0)))"
OMZ = f"(Omega_m*pow(1e0+z, 3)/({OMEGA_R}*pow(1e0+z, 4)+Omega_m*pow(1e0+z, 3)+greatest(1e0-Omega_m-{OMEGA_R}, 0e0)))"
BASE = ("fx_run", "fx_k", "fx_z", "fx_mass", "fx_power", "fx_growth")


def sigma_sum(name: str, y: str = "k*r") -> str:
    return f"sqrt(greatest(sum(w*k*k*k*p/{PI2}*{w(y, name)}*{w(y, name)}), 0e0))"


STEPS = {
    "pw": weights("(SELECT *, ln(k) AS x FROM fx_power) p0", "run_id, z", "x"),
    "rad": f"SELECT run_id, m_h, m_h/(H0/100e0) AS m, pow(3e0*m_h/(H0/100e0)/(4e0*pi()*{RHO}), 1e0/3e0) AS r FROM fx_run CROSS JOIN fx_mass",
    "sig": f"SELECT pw.run_id, 'Top-hat' AS window_type, z, m_h, rad.m, r, {sigma_sum('Top-hat')} AS sigma FROM pw JOIN rad ON pw.run_id = rad.run_id GROUP BY pw.run_id, z, m_h, rad.m, r",
    "s8": f"SELECT pw.run_id, z, {sigma_sum('Top-hat', 'k*(8e0/(H0/100e0))')} AS sigma8 FROM pw JOIN fx_run ON pw.run_id = fx_run.run_id GROUP BY pw.run_id, z",
    "slo": gradient("sig", "run_id, window_type, z", "m", "sigma", "dlns"),
    "hm": "SELECT slo.run_id, window_type, z, fit, m_h, m, s AS sigma, greatest({rho}/m*f*abs(dlns)/pow(H0/100e0, 3), 1e-300) AS hmf FROM (SELECT * FROM ({fan}) q) slo JOIN fx_run ON slo.run_id = fx_run.run_id".format(
        rho=RHO,
        fan=" UNION ALL ".join(
            f"SELECT slo.run_id, window_type, z, m_h, m, dlns, greatest(sigma, 1e-30) AS s, '{n}' AS fit, {fit(n, 'greatest(sigma, 1e-30)', 'z', '1.686e0', OMZ)} AS f FROM slo JOIN fx_run ON slo.run_id = fx_run.run_id"
            for n in ("Press-Schechter 1974", "Sheth-Tormen 2001", "Tinker 2008", "Watson SO 2013")
        ),
    ),
    "hc": tail("hm", "run_id, window_type, z, fit", "m_h", "hmf", "n_gt_m"),
    "curves": f"""SELECT 'P(k)' AS metric, run_id, '' AS window_type, '' AS fit, z, k AS x, p AS y FROM fx_power UNION ALL SELECT 'Delta2(k)', run_id, '', '', z, k, k*k*k*p/{PI2} FROM fx_power
UNION ALL SELECT 'Growth', run_id, '', '', 0e0, z, growth FROM fx_growth UNION ALL SELECT 'sigma(M)', run_id, window_type, '', z, m_h, sigma FROM slo
UNION ALL SELECT 'sigma slope', run_id, window_type, '', z, m_h, abs(dlns) FROM slo UNION ALL SELECT 'HMF', run_id, window_type, fit, z, m_h, hmf FROM hc UNION ALL SELECT 'Cumulative HMF', run_id, window_type, fit, z, m_h, n_gt_m FROM hc""",
}
ORDER = (*BASE, *STEPS)


def sql(upto: str, body: str, extra: str = "") -> str:
    """WITH the fixtures and steps up to `upto`, then extra expressions, then the body."""
    parts = [fixtures.cte(n) if n in BASE else f"{n} AS ({STEPS[n]})" for n in ORDER[: ORDER.index(upto) + 1]]
    return "WITH " + ",\n".join([*parts, *([extra] if extra else [])]) + "\n" + body


def on(fixture: str, body: str, *more: str) -> str:
    return "WITH " + ", ".join(fixtures.cte(n) for n in (*more, fixture)) + "\n" + body
