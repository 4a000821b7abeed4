"""The registered queries: each applies one operator to tables derived from the given ones (fixtures)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cosmotab.functions import cosmology as cos
from cosmotab.functions import fits, windows
from cosmotab.operators import compare, curves, field, hmf, ledger, params, sigma
from cosmotab.operators.pairing import is_small, shares
from cosmotab.plans import oracle as o
from cosmotab.plans.fixtures import REDSHIFTS, cells, cte, runs, table
from cosmotab.sources import io
from cosmotab.sources.shared import new_folder as shared
from cosmotab.sources.shared import stored

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
#: Rows of sigma curves that one task takes; each becomes a row of every fit.
SLOPES_A_TASK = 20_000
SHOWN_FITS = ["Press-Schechter 1974", "Sheth-Tormen 2001", "Tinker 2008", "Watson SO 2013"]


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__.rstrip("_")
        Q[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def rounded(x: Column | str, digits: int) -> Column:
    """x rounded as DuckDB rounds a double, by scaling: F.round takes every value through a decimal text, some 0.5 us each."""
    return F.rint((c(x) if isinstance(x, str) else x) * 10.0**digits) / 10.0**digits + 0.0


def r8(x: Column | str) -> Column:
    return rounded(x, 8)


def rl(x: Column | str) -> Column:
    return rounded(F.ln(x), 8)


def power(s, d):
    return table(s, d, "fx_power")


def radii(s, d):
    return sigma.mass_radii(table(s, d, "fx_run"), table(s, d, "fx_mass"))


def sigmas(s, d, names=("Top-hat",), where="true"):
    """where: a condition on the redshift. Each redshift's curve stands alone, but no filter of Spark's gets through the arrays of redshifts."""
    return sigma.sigma_m(power(s, d).filter(where), radii(s, d), names, dealt=True)


def slopes(s, d, where="true"):
    return hmf.slopes(sigmas(s, d, where=where))


def tails(s, d, names=SHOWN_FITS, where="true"):
    return hmf.hmf_cumulative(hmf.hmf(slopes(s, d, where), table(s, d, "fx_run"), list(names)))


def all_curves(s, d):
    slope = stored(slopes(s, d))
    dealt = slope.repartition(shares(slope.count(), SLOPES_A_TASK), "run_id")  # the tails' windows then stay in their tasks
    tail = hmf.hmf_cumulative(hmf.hmf(dealt, table(s, d, "fx_run"), SHOWN_FITS))
    return compare.metric_curves(power(s, d), table(s, d, "fx_growth"), slope, tail)


# --- sources and sinks ---------------------------------------------------------------------------------------------


@query(o.on("fx_run", "SELECT CAST(run_id AS VARCHAR) AS run_id, name, CASE WHEN run_id % 3 = 0 THEN NULL ELSE 'OK' END AS class_status, H0, Omega_m, true AS visible, run_id % 10 = 0 AS is_baseline FROM fx_run WHERE run_id % 17 <> 0"))
def read_runs(s, d):
    docs = runs(s, d).select(
        "run_id", F.to_json(F.struct(
            c("run_id").cast("string").alias("run_id"), F.when(c("run_id") % 2 == 0, c("name")).alias("run_name"), F.when(c("run_id") % 2 == 1, c("name")).alias("name"), c("created_at"),
            F.when(c("run_id") % 3 != 0, F.lit("OK")).alias("class_status"), F.when(c("run_id") % 10 == 0, F.lit(True)).alias("is_baseline"), F.struct("H0", "Omega_m").alias("params"))).alias("value"),
    )
    docs.select(F.when(c("run_id") % 17 == 0, F.lit("{broken")).otherwise(c("value")).alias("value")).write.text(path := shared(s))
    found, _ = io.read_runs(s, path, multi_line=False)
    return found.select("run_id", "name", "class_status", "params.H0", "params.Omega_m", "visible", "is_baseline")


@query(o.sql("fx_power", f"SELECT run_id, count(*) AS samples, {o.rl('sum(p)')} AS ln_sum FROM fx_power GROUP BY run_id"))
def write_runs(s, d):
    io.write_runs(runs(s, d).select("run_id", "name", "created_at"), power(s, d), path := shared(s))
    return io.read_curves(s, f"{path}/curves").join(s.read.json(f"{path}/runs").select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("samples"), rl(F.sum("p")).alias("ln_sum"))


@query(o.sql("fx_power", f"SELECT run_id, {o.rl('k')} AS ln_k, {o.rl('p')} AS ln_p, {o.rl(f'k*k*k*p/{o.PI2}')} AS ln_d2 FROM fx_power WHERE z = 0"))
def export_power(s, d):
    io.write_csv(io.export_power(power(s, d)), path := shared(s))
    back = io.read_csv(s, path, "k_Mpc_inv double, P_Mpc3 double, Delta2 double")
    return back.select("run_id", rl("k_Mpc_inv").alias("ln_k"), rl("P_Mpc3").alias("ln_p"), rl("Delta2").alias("ln_d2"))


SIGMA_CSV = f"run_id, {o.rl('m_h')} AS ln_m_h, {o.rl('m')} AS ln_m, {o.rl('r')} AS ln_r, {o.rl('sigma')} AS ln_sigma, {o.r8('dlns')} AS dlns"


def shown_sigma(df, *more):
    return df.select("run_id", *[rl(x).alias(f"ln_{x}") for x in ("m_h", "m", "r", "sigma")], r8("dlns").alias("dlns"), *more)


@query(o.sql("slo", f"SELECT {SIGMA_CSV} FROM slo WHERE z = 0"))
def export_sigma(s, d):
    io.write_csv(io.export_sigma(slopes(s, d)), path := shared(s))
    back = io.read_csv(s, path, ", ".join(f"`{n}` double" for n in io.SIGMA_HEADERS["new"]))
    return shown_sigma(back.withColumnsRenamed(dict(zip(io.SIGMA_HEADERS["new"], io.SIGMA_COLUMNS, strict=False))))


@query(o.sql("slo", f"SELECT {SIGMA_CSV.replace('run_id', 'CAST(run_id AS VARCHAR) AS run_id')}, CASE WHEN run_id % 2 = 0 THEN 'new' ELSE 'old' END AS header, CASE WHEN run_id % 2 = 1 THEN window_type END AS window_type FROM slo WHERE z = 0"))
def import_curves(s, d):
    """One folder a run, half of them with the older header; what is read back knows its run from the folder alone."""
    rows = stored(slopes(s, d, "z = 0"))
    io.write_run_folders(io.export_sigma(rows.filter("run_id % 2 = 0")), f"{(path := shared(s))}/newer")
    io.write_run_folders(io.export_sigma(rows.filter("run_id % 2 = 1"), "old"), f"{path}/older")
    return shown_sigma(io.import_curves(s, path)[0], "header", "window_type")


HMF_WIDE = ", ".join(f"{o.rl(f'max(CASE WHEN fit = {chr(39)}{f}{chr(39)} THEN {v} END)')} AS {n}_{k}_z0" for v, n in (("hmf", "hmf"), ("n_gt_m", "cumulative")) for f, k in (("Press-Schechter 1974", "press_schechter"), ("Sheth-Tormen 2001", "sheth_tormen")))


@query(o.sql("hc", f"SELECT run_id, {o.rl('m_h')} AS ln_m_h, {HMF_WIDE} FROM hc WHERE z = 0 GROUP BY run_id, m_h"))
def export_hmf(s, d):
    wide = io.export_hmf(tails(s, d, SHOWN_FITS[:2]))
    return wide.select("run_id", rl("M_h_inv_Msun").alias("ln_m_h"), *[rl(x).alias(x) for x in wide.columns[2:]])


@query(o.sql("hc", f"SELECT CAST(run_id AS VARCHAR) AS run_id, {o.rl('m_h')} AS ln_m_h, {HMF_WIDE} FROM hc WHERE z = 0 GROUP BY run_id, m_h"))
def import_hmf(s, d):
    io.write_run_folders(stored(io.export_hmf(tails(s, d, SHOWN_FITS[:2], "z = 0"))), path := shared(s))
    back = io.import_hmf(s, path)[0]
    return back.select("run_id", rl("M_h_inv_Msun").alias("ln_m_h"), *[rl(x).alias(x) for x in io.HMF_HEADER[1:]])


@query(o.sql("fx_power", "SELECT run_id, " + o.rl("k") + " AS ln_k, " + ", ".join(f"{o.rl(f'max(CASE WHEN z = {o.d(z)} THEN p END)')} AS {io.z_column(z, 'P_z', '_Mpc3')}" for z in REDSHIFTS) + " FROM fx_power GROUP BY run_id, k"))
def export_power_wide(s, d):
    wide = io.export_power_wide(power(s, d), list(REDSHIFTS))
    return wide.select("run_id", rl("k").alias("ln_k"), *[rl(x).alias(x) for x in wide.columns[2:]])


@query(o.sql("sig", "SELECT run_id, " + o.rl("m_h") + " AS ln_m_h, " + ", ".join(f"{o.rl(f'max(CASE WHEN z = {o.d(z)} THEN sigma END)')} AS {io.z_column(z, 'sigma_z')}" for z in REDSHIFTS) + " FROM sig GROUP BY run_id, m_h"))
def export_sigma_wide(s, d):
    wide = io.export_sigma_wide(sigmas(s, d), list(REDSHIFTS))
    return wide.select("run_id", rl("m_h").alias("ln_m_h"), *[rl(x).alias(x) for x in wide.columns[4:]])


FILES = ", ".join(f"('{f}', {i})" for i, f in enumerate(io.PRODUCTS))


@query(o.on("fx_run", f"SELECT run_id, file, (run_id + i) % 3 <> 0 AS present FROM fx_run CROSS JOIN (VALUES {FILES}) AS t(file, i)"))
def export_completeness(s, d):
    r = runs(s, d).select("run_id")
    made = r.select("run_id", F.posexplode(F.array(*map(F.lit, io.PRODUCTS))).alias("i", "file")).filter((c("run_id") + c("i")) % 3 != 0)
    return io.export_completeness(r, made)


@query(o.on("fx_dirty", """SELECT run_id, CASE WHEN trim(name) = '' THEN 'run' ELSE regexp_replace(regexp_replace(trim(name), '\\s+', '_', 'g'), '^_+|_+$', '', 'g') END AS stem,
  '# ' || name || chr(10) || chr(10) || chr(10) || chr(10) || '## Reproducibility' || chr(10) || chr(10) || '- Backend: ' || coalesce(class_status, 'UNKNOWN') || chr(10)
  || '- k range: ' || k_min || ' to ' || k_max || ' Mpc^-1' || chr(10) || '- k samples: ' || k_points || chr(10) || '- mass range: 10^' || mass_min_exp || ' to 10^' || mass_max_exp || ' h^-1 Msun' || chr(10)
  || '- mass samples: ' || mass_points || chr(10) || '- window: Top-hat' || chr(10) || '- integration: log-k Simpson rule on the sampled grid' || chr(10) || chr(10) || '## Notes' || chr(10) || CASE WHEN run_id % 2 = 0 THEN chr(10) || '- seen' || chr(10) || '- ' || run_id || chr(10) ELSE '' END AS summary FROM fx_dirty"""))
def run_summary(s, d):
    return io.run_summary(runs(s, d, "fx_dirty").withColumns({
        "notes": F.lit(None).cast("string"), "window_type": F.lit("Top-hat"), "bullets": F.when(c("run_id") % 2 == 0, F.array(F.lit("seen"), c("run_id").cast("string"))),
    }))


# --- projections, filters, checks ----------------------------------------------------------------------------------

HAVE = {"A_s", "n_s", "Omega_m", "H0", "Omega_b", "enable_ede", "f_EDE", "log10_a_c", "k_min", "k_max", "k_points", "mass_min_exp", "mass_max_exp", "mass_points", "selected_mass_exp", "single_z"}
LISTS = ("z_values", "z_presets_selected")


def default_sql(p):
    v = params.DEFAULTS[p]
    if p in LISTS:
        return "list_aggregate([round(x, 6) FOR x IN [0e0, z_extra]], 'string_agg', ' ')" if p == "z_values" else f"'{' '.join(str(float(x)) for x in v)}'"
    text = f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, (bool, int)) else o.d(v)
    return f"coalesce({p}, {text})" if p in HAVE else text


@query(o.on("fx_dirty", f"SELECT run_id, {', '.join(f'{default_sql(p)} AS {p}' for p in params.DEFAULTS)} FROM fx_dirty"))
def merge_defaults(s, d):
    """All parameters; lists as text."""
    rows = params.merge_defaults(runs(s, d, "fx_dirty"))
    return rows.select("run_id", *[F.array_join(F.transform(p, lambda x: F.round(x.cast("double"), 6).cast("string")), " ").alias(p) if p in LISTS else c(p) for p in params.DEFAULTS])


DIRTY = f"m AS (SELECT * REPLACE (coalesce(A_s, {o.d(2.1e-9)}) AS A_s, coalesce(n_s, 0.965e0) AS n_s, coalesce(Omega_m, {o.d(params.DEFAULTS['Omega_m'])}) AS Omega_m) FROM fx_dirty)"
RULES = (
    "Omega_b >= Omega_m", "k_min <= 0 OR k_max <= k_min", "k_points < 50", "mass_min_exp >= mass_max_exp", "mass_points < 20", "selected_mass_exp < mass_min_exp OR selected_mass_exp > mass_max_exp", "z_extra < 0",
    "enable_ede AND (f_EDE < 0 OR f_EDE > 0.3e0)",
)
@query(o.on("fx_dirty", "SELECT run_id, concat_ws(' ', " + ", ".join(f"CASE WHEN {r} THEN '{t}' END" for r, t in zip(RULES, params.MESSAGES, strict=True)) + ") AS violations FROM m").replace(")\nSELECT", f"), {DIRTY}\nSELECT", 1))
def validate_params(s, d):
    good, bad = params.validate_params(params.merge_defaults(runs(s, d, "fx_dirty")))
    return bad.select("run_id", F.array_join("violations", " ").alias("violations")).unionByName(good.select("run_id", F.lit("").alias("violations")))


AUDITED = [r for r in params.RANGES if r[0] in ("A_s", "n_s", "H0", "Omega_m", "Omega_b", "f_EDE", "log10_a_c", "k_min", "k_max", "k_points", "mass_min_exp", "mass_max_exp", "mass_points", "selected_mass_exp", "single_z")]


@query(o.on("fx_dirty", " UNION ALL ".join(f"SELECT run_id, '{p}' AS param, CAST({p} AS DOUBLE) AS value, {o.d(lo)} AS lo, {o.d(hi)} AS hi FROM fx_dirty WHERE {p} < {o.d(lo)} OR {p} > {o.d(hi)}" for p, lo, hi in AUDITED)))
def range_audit(s, d):
    return params.range_audit(runs(s, d, "fx_dirty"))


@query(o.on("fx_run", f"""SELECT run_id, preset, preset_name, CASE WHEN preset = 'EDE' THEN true ELSE false END AS enable_ede, CASE WHEN preset = 'High amplitude' THEN {o.d(2.35e-9)} ELSE A_s END AS A_s,
  CASE WHEN preset = 'Blue tilt' THEN 0.99e0 ELSE n_s END AS n_s, 0.1e0 AS f_EDE, -3.5e0 AS log10_a_c, 3 AS n_EDE FROM fx_run CROSS JOIN (VALUES {", ".join(f"('{n}', '{t}')" for n, _, t in params.PRESETS)}) AS t(preset, preset_name)"""))
def apply_presets(s, d):
    return params.apply_presets(runs(s, d)).select("run_id", "preset", "preset_name", "enable_ede", "A_s", "n_s", "f_EDE", "log10_a_c", "n_EDE")


@query(o.on("fx_run", f"SELECT run_id, H0/100e0 AS h, {o.r8('Omega_m-Omega_b')} AS Omega_cdm, {o.r8(o.OMEGA_R)} AS Omega_r, {o.r8(f'1e0-Omega_m-{o.OMEGA_R}')} AS Omega_de, {o.rl('2.775e11*(H0/100e0)*(H0/100e0)')} AS ln_rho_crit, {o.rl(o.RHO)} AS ln_rho0, {o.rl('pow(10e0, -3.5e0)')} AS ln_a_c, {o.rl('1e0/pow(10e0, -3.5e0)-1e0')} AS ln_z_c FROM fx_run"))
def derived_quantities(s, d):
    r = params.derived_quantities(params.merge_defaults(runs(s, d)))
    return r.select("run_id", "h", *[r8(x).alias(x) for x in ("Omega_cdm", "Omega_r", "Omega_de")], *[rl(x).alias(f"ln_{x}") for x in ("rho_crit", "rho0", "a_c", "z_c")])


@query(o.sql("fx_z", f"SELECT run_id, z, {o.r8(o.OMZ)} AS omega_m_z FROM fx_z JOIN fx_run USING (run_id)"))
def omega_m_of_z(s, d):
    r = table(s, d, "fx_z").join(table(s, d, "fx_run"), "run_id")
    return r.select("run_id", "z", r8(cos.omega_m_of_z(c("z"), c("Omega_m"), cos.omega_r(c("H0")))).alias("omega_m_z"))


#: A redshift of nine decimals, and what the settings make of it; a number is compared by 12 significant digits.
FINE_Z = "single_z + (run_id*7919 % 1000)/1e3 + (run_id*104729 % 1000003)/1e9"
Z_LIST = "list_sort(list_distinct(list_filter([0e0, z_extra, fine_z], lambda x: x >= 0)))"
G12 = "printf('%.12g', {})"
D = params.DEFAULTS
NUMERIC = {
    "H0": "H0", "Omega_b": "Omega_b", "Omega_cdm": "Omega_m-Omega_b", "Omega_k": o.d(D["Omega_k"]), "A_s": "A_s", "n_s": "n_s", "k_pivot": o.d(D["k_pivot"]), "tau_reio": o.d(D["tau_reio"]), "T_cmb": o.d(D["Tcmb"]),
    "N_ur": o.d(D["N_eff"]), "P_k_max_1/Mpc": "1.05e0*k_max", "z_max_pk": f"list_max({Z_LIST})",
}
NUMERIC_EARLY = {"n_axion": o.d(D["n_EDE"]), "log10_axion_ac": "log10_a_c", "fraction_axion_ac": "f_EDE"}
TEXT_EARLY = {"scf_potential": "axion", "do_shooting": "yes", "do_shooting_scf": "yes", "scf_has_perturbations": "yes", "attractor_ic_scf": "no", "scf_parameters": D["scf_parameters"]}
SETTINGS = [
    *[(k, G12.format(f"CAST({x} AS DOUBLE)"), "true") for k, x in NUMERIC.items()], *[(k, f"'{v}'", "true") for k, v in (("output", "mPk"), ("modes", "s"), ("gauge", "synchronous"))],
    ("z_pk", f"list_aggregate(list_transform({Z_LIST}, lambda x: {G12.format('x')}), 'string_agg', ',')", "true"),
    *[(k, G12.format(f"CAST({x} AS DOUBLE)"), "enable_ede") for k, x in NUMERIC_EARLY.items()], *[(k, f"'{v}'", "enable_ede") for k, v in TEXT_EARLY.items()],
]


@query(o.on("fx_dirty", " UNION ALL ".join(f"SELECT run_id, '{k}' AS key, {v} AS value FROM mz WHERE {when}" for k, v, when in SETTINGS)).replace(")\nSELECT", f"), {DIRTY}, mz AS (SELECT *, {FINE_Z} AS fine_z FROM m)\nSELECT", 1))
def solver_settings(s, d):
    """The whole map, a row a key; numbers with 12 significant digits."""
    rows = params.merge_defaults(runs(s, d, "fx_dirty").withColumn("single_z", F.expr(FINE_Z)))
    pairs = rows.select("run_id", F.explode(params.solver_settings()).alias("key", "text"))
    number = params.short_number(c("text").cast("double"))
    return pairs.select("run_id", "key", F.when(c("key").isin(*NUMERIC, *NUMERIC_EARLY), number).otherwise(c("text")).alias("value"))


@query(o.sql("fx_power", "SELECT run_id, z, count(*) AS samples, CASE WHEN count(*) >= 8 AND bool_and(coalesce(k > 0 AND p > 0, false)) AND count(DISTINCT k) = count(k) THEN 'pass' ELSE 'quarantine' END AS verdict FROM fx_power_dirty GROUP BY run_id, z", cte("fx_power_dirty")))
def power_quality(s, d):
    return sigma.power_quality(table(s, d, "fx_power_dirty"))


@query(o.sql("sig", "SELECT run_id, window_type, z, count(*) AS masses, CASE WHEN count(*) >= 4 AND bool_and(m > 0 AND sigma > 0) AND count(DISTINCT m) = count(m) THEN 'pass' ELSE 'quarantine' END AS verdict FROM sig WHERE run_id % 9 <> 0 OR m_h < 1.5e8 GROUP BY run_id, window_type, z"))
def mass_grid_quality(s, d):
    return sigma.mass_grid_quality(sigmas(s, d).filter("run_id % 9 <> 0 or m_h < 1.5e8"))


@query(o.on("fx_run", f"SELECT run_id, i, {o.rl('A_s*pow(pow(10e0, -5e0+i*6e0/499e0)/0.05e0, n_s-1e0)')} AS ln_p FROM fx_run CROSS JOIN (SELECT unnest(range(500)) AS i) t"))
def primordial(s, d):
    r = runs(s, d).select("run_id", "A_s", "n_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(499).cast("bigint"))).alias("i"))
    return r.select("run_id", "i", rl(cos.primordial(F.pow(F.lit(10.0), -5.0 + c("i") * 6.0 / 499.0), c("A_s"), c("n_s"))).alias("ln_p"))


@query(o.sql("fx_power", f"SELECT run_id, z, {o.rl('k')} AS ln_k, {o.rl(f'k*k*k*p/{o.PI2}')} AS ln_d2 FROM fx_power"))
def delta2(s, d):
    return power(s, d).select("run_id", "z", rl("k").alias("ln_k"), rl(cos.delta2(c("k"), c("p"))).alias("ln_d2"))


@query(o.sql("fx_power", f"SELECT run_id, z, {o.rl('k')} AS ln_k, {o.r8('t/norm')} AS shape FROM t JOIN n USING (run_id, z)", "t AS (SELECT run_id, z, k, p/pow(k, n_s) AS t FROM fx_power JOIN fx_run USING (run_id)), k0 AS (SELECT run_id, z, min(k) AS k0, arg_min(t, k) AS t0 FROM t GROUP BY ALL), n AS (SELECT run_id, z, coalesce(quantile_cont(CASE WHEN k <= greatest(5e0*k0, 0.003e0) THEN t END, 0.5e0), min(t0)) AS norm FROM t JOIN k0 USING (run_id, z) GROUP BY ALL)"))
def processing_shape(s, d):
    return sigma.processing_shape(power(s, d), runs(s, d)).select("run_id", "z", rl("k").alias("ln_k"), r8("shape").alias("shape"))


@query(o.sql("rad", f"SELECT run_id, {o.rl('m_h')} AS ln_m_h, {o.rl('r')} AS ln_r, {o.r8(f'4e0*pi()*{o.RHO}*r*r*r/3e0/m')} AS back FROM rad JOIN fx_run USING (run_id)"))
def mass_radius(s, d):
    r = radii(s, d).join(runs(s, d), "run_id")
    return r.select("run_id", rl("m_h").alias("ln_m_h"), rl("r").alias("ln_r"), r8(cos.mass_of_radius(c("r"), cos.rho0(c("H0"), c("Omega_m"))) / c("m")).alias("back"))


def y_grid(s, d):
    """y over ten decades, from part keys."""
    return table(s, d, "part").select("p_partkey", F.pow(F.lit(10.0), -4.0 + (c("p_partkey") % 600) / 100.0).alias("y"))


Y_GRID = "SELECT p_partkey, pow(10e0, -4e0+(p_partkey % 600)/100e0) AS y FROM part"
for _key, _f, _w in (("window_top_hat", windows.top_hat, "Top-hat"), ("window_gaussian", windows.gaussian, "Gaussian"), ("window_sharp_k", windows.sharp_k, "Sharp-k")):
    query(f"SELECT p_partkey, {o.r8(o.w('y', _w))} AS w FROM ({Y_GRID}) q", _key)(lambda s, d, f=_f: y_grid(s, d).select("p_partkey", r8(f(c("y"))).alias("w")))

NAMES = ("Top-hat", "Gaussian", "Sharp-k", "other")


@query(" UNION ALL ".join(f"SELECT p_partkey, '{n}' AS window_type, {o.r8(o.w('y', n))} AS w, {o.r8(f'{o.w(chr(121), n)}*{o.w(chr(121), n)}')} AS w2 FROM ({Y_GRID}) q" for n in NAMES))
def window_response(s, d):
    rows = y_grid(s, d).select("*", F.explode(F.array(*map(F.lit, NAMES))).alias("window_type"))
    return rows.select("p_partkey", "window_type", r8(windows.window(c("y"), c("window_type"))).alias("w"), r8(windows.window_squared(c("y"), c("window_type"))).alias("w2"))


EXACT = "(3e0*(sin(y)-y*cos(y))/(y*y*y))"
SERIES_SQL = "(1e0 - pow(y,2)/10e0 + pow(y,4)/280e0 - pow(y,6)/15120e0 + pow(y,8)/1330560e0 - pow(y,10)/172972800e0)"


#: Below this, or below the rounding of the exact form (4e-15 / y^2, as its numerator cancels), an error counts as this much.
ERROR_FLOOR = 1e-9
WIDE_Y = "SELECT p_partkey, pow(10e0, -7e0+(p_partkey*37 % 900)/100e0) AS y FROM part"


@query(f"SELECT p_partkey, {o.r8('log10(y)')} AS log_y, (round(log10(greatest(abs({SERIES_SQL}-{EXACT})/greatest(abs({EXACT}), 1e-30), 1e-9, 4e-15/(y*y))), 4) + 0e0) AS log_error FROM ({WIDE_Y}) q")
def series_error(s, d):
    """Every y from 1e-7 to 100e0: all of the figure's range, on both sides of the switch to the series."""
    rows = table(s, d, "part").select("p_partkey", F.pow(F.lit(10.0), -7.0 + (c("p_partkey") * 37 % 900) / 100.0).alias("y"))
    e = windows.top_hat_exact(c("y"))
    error = F.abs(windows.top_hat_series(c("y")) - e) / F.greatest(F.abs(e), F.lit(1e-30))
    shown = F.greatest(error, F.lit(ERROR_FLOOR), 4e-15 / (c("y") * c("y")))
    return rows.select("p_partkey", r8(F.log10("y")).alias("log_y"), (F.round(F.log10(shown), 4) + 0.0).alias("log_error"))


INTEGRAND = " UNION ALL ".join(f"SELECT p.run_id, z, '{n}' AS window_type, {o.rl('k')} AS ln_k, (round(ln(greatest(k*k*k*p/{o.PI2}*{o.w('k*r', n)}*{o.w('k*r', n)}, 1e-300)), 6) + 0e0) AS ln_i FROM fx_power p JOIN rr USING (run_id) WHERE z = 0" for n in windows.WINDOWS)
AT_MASS = "rr AS (SELECT a.run_id, exp(ln(a.r)+(ln(b.r)-ln(a.r))*(ln(1e12)-ln(a.m_h))/(ln(b.m_h)-ln(a.m_h))) AS r FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY m_h DESC) AS o FROM rad WHERE m_h <= 1e12) a JOIN (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY m_h) AS o FROM rad WHERE m_h > 1e12) b ON a.run_id = b.run_id AND a.o = 1 AND b.o = 1)"


@query(o.sql("rad", INTEGRAND, AT_MASS))
def sigma_integrand(s, d):
    """Every k: the oscillating top-hat part, the Gaussian tail and the sharp-k range that is cut to the floor too."""
    ask = runs(s, d).select("run_id", F.lit(1e12).alias("at"))
    at = curves.interpolate(ask, radii(s, d), ["run_id"], "at", "m_h", "r", "r", log=True).select("run_id", "r")
    rows = sigma.sigma_integrand(power(s, d).filter("z = 0"), at)
    return rows.select("run_id", "z", "window_type", rl("k").alias("ln_k"), (F.round(F.ln("integrand"), 6) + 0.0).alias("ln_i"))


@query(o.on("fx_sigma", f"SELECT l_orderkey, l_linenumber, {o.r8('1.686e0/greatest(sigma, 1e-30)')} AS nu FROM fx_sigma"))
def peak_height(s, d):
    return table(s, d, "fx_sigma").select("l_orderkey", "l_linenumber", r8(fits.peak_height(c("sigma"))).alias("nu"))


IN_RANGE = {
    "Press-Schechter 1974": "true", "Sheth-Tormen 2001": "true", "Jenkins 2001": "-ln(sigma) > -1.2e0 AND -ln(sigma) < 1.05e0 AND z <= 5", "Reed 2003": "-ln(sigma) > -1.7e0 AND -ln(sigma) < 0.9e0 AND z <= 15",
    "Warren 2006": "log10(m) > 10 AND log10(m) < 15 AND z = 0", "Reed 2007": "-ln(sigma) > -1.7e0 AND -ln(sigma) < 0.9e0 AND z <= 30", "Tinker 2008": "-ln(sigma) > -0.6e0 AND -ln(sigma) < 0.4e0 AND z <= 2.5e0",
    "Crocce 2010": "log10(m) > 10.5e0 AND log10(m) < 15.5e0 AND z <= 2", "Courtin 2010": "-ln(sigma) > -0.8e0 AND -ln(sigma) < 0.7e0 AND z = 0", "Bhattacharya 2011": "log10(m) > 11.8e0 AND log10(m) < 15.5e0 AND z <= 2",
    "Angulo 2012": "log10(m) > 8 AND log10(m) < 16 AND z = 0", "Watson FOF 2013": "-ln(sigma) > -0.55e0 AND -ln(sigma) < 1.31e0 AND z <= 30", "Watson SO 2013": "z <= 30",
}


@query(o.sql("slo", " UNION ALL ".join(f"SELECT run_id, z, '{n}' AS fit, {o.rl('m_h')} AS ln_m_h, {r} AS calibrated FROM slo" for n, r in IN_RANGE.items())))
def calibration_label(s, d):
    """All fits of the catalogue."""
    rows = hmf.hmf(slopes(s, d), table(s, d, "fx_run"), list(fits.FITS))
    return hmf.calibration_label(rows, hmf.fit_catalog(s)).select("run_id", "z", "fit", rl("m_h").alias("ln_m_h"), "calibrated")


# --- multiplicity functions ----------------------------------------------------------------------------------------

SIG = "sigma"
for _name, _f in fits.FITS.items():
    query(o.on("fx_sigma", f"SELECT l_orderkey, l_linenumber, {o.rl(f'greatest({o.fit(_name, SIG)}, 1e-300)')} AS ln_f FROM fx_sigma"), _f.__name__)(
        lambda s, d, f=_f: table(s, d, "fx_sigma").select("l_orderkey", "l_linenumber", rl(F.greatest(f(c("sigma"), z=c("z")), F.lit(1e-300))).alias("ln_f"))
    )

DISPATCH = ("Press-Schechter", "Sheth-Tormen", *fits.FITS)


@query(o.on("fx_sigma", "SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 15 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(DISPATCH)) + " END AS fit, " + o.rl("greatest(CASE (l_orderkey + l_linenumber) % 15 " + " ".join(f"WHEN {i} THEN {o.fit(fits.ALIASES.get(n, n), SIG)}" for i, n in enumerate(DISPATCH)) + " END, 1e-300)") + " AS ln_f FROM fx_sigma"))
def fit_dispatch(s, d):
    rows = table(s, d, "fx_sigma").withColumn("fit", F.element_at(F.array(*map(F.lit, DISPATCH)), ((c("l_orderkey") + c("l_linenumber")) % 15 + 1).cast("int")))
    return rows.select("l_orderkey", "l_linenumber", "fit", rl(F.greatest(fits.multiplicity(c("sigma"), c("fit"), z=c("z")), F.lit(1e-300))).alias("ln_f"))


ATLAS = "(SELECT run_id, i, (run_id % 3)*1e0 AS z, pow(10e0, -1.1e0+i*1.9e0/499e0) AS s FROM fx_run CROSS JOIN (SELECT unnest(range(500)) AS i) t) q"


@query(o.on("fx_run", " UNION ALL ".join(f"SELECT run_id, i, '{n}' AS fit, {o.rl(f'greatest({o.fit(n)}, 1e-300)')} AS ln_f FROM {ATLAS}" for n in fits.FITS)))
def fit_atlas(s, d):
    """All 13 fits on all 500 values of sigma, floored as the mass functions are. A fit depends on sigma and z alone, so it is
    worked out once for each of the runs' redshifts, and these curves meet the runs by z."""
    asked = runs(s, d).select("run_id", (c("run_id") % 3).cast("double").alias("z"))
    grid = asked.select("z").distinct().select("z", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(499).cast("bigint"))).alias("i")).withColumn("s", F.pow(F.lit(10.0), -1.1 + c("i") * 1.9 / 499.0))
    fan = F.explode(F.array(*[F.struct(F.lit(n).alias("fit"), fits.multiplicity(c("s"), n, z=c("z")).alias("f")) for n in fits.FITS]))
    curve = grid.select("z", "i", fan.alias("e")).select("z", "i", "e.fit", rl(F.greatest("e.f", F.lit(1e-300))).alias("ln_f"))
    return asked.join(F.broadcast(curve) if is_small(curve) else curve, "z").select("run_id", "i", "fit", "ln_f")


# --- joins ---------------------------------------------------------------------------------------------------------


@query(o.on("fx_dirty", f"SELECT run_id, {o.r8('lo+j*(hi-lo)/(n-1)')} AS log_m FROM (SELECT run_id, mass_min_exp AS lo, mass_max_exp AS hi, mass_points AS n, unnest(range(mass_points)) AS j FROM fx_dirty) q"))
def expand_grid(s, d):
    return sigma.expand_grid(runs(s, d, "fx_dirty")).select("run_id", r8(F.log10("m_h")).alias("log_m"))


@query(o.sql("rad", f"SELECT p.run_id, z, count(*) AS pairs, {o.rl('sum(k*r)')} AS ln_sum_y FROM fx_power p JOIN rad USING (run_id) GROUP BY p.run_id, z"))
def mass_k_join(s, d):
    return sigma.mass_k_join(power(s, d), radii(s, d)).groupBy("run_id", "z").agg(F.count("*").alias("pairs"), rl(F.sum("y")).alias("ln_sum_y"))


def z_requests(s, d):
    return runs(s, d).select("run_id", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.7, 1.0, 1.5, 4.0, 99.0)])).alias("z"))


Z_ASK = "ask AS (SELECT run_id, z FROM fx_run CROSS JOIN (VALUES (0e0), (0.25e0), (0.5e0), (0.7e0), (1e0), (1.5e0), (4e0), (99e0)) AS t(z))"


@query(o.sql("fx_z", "SELECT ask.run_id, ask.z, arg_min(s.z, [abs(s.z-ask.z), s.z]) AS z_used FROM ask JOIN fx_z s ON ask.run_id = s.run_id GROUP BY ask.run_id, ask.z", Z_ASK))
def nearest_z(s, d):
    return compare.nearest_z(z_requests(s, d), table(s, d, "fx_z"))


@query(o.sql("fx_z", "SELECT ask.run_id, ask.z, s.z AS z_used FROM ask LEFT JOIN fx_z s ON ask.run_id = s.run_id AND abs(ask.z-s.z) <= 1e-9", Z_ASK))
def strict_z(s, d):
    found, missing = hmf.strict_z(z_requests(s, d), table(s, d, "fx_z"))
    return found.unionByName(missing.withColumn("z_used", F.lit(None).cast("double")))


def keyed(s, d):
    """The runs of fx_dirty with keys over a few coarse values, so that keys repeat."""
    coarse = runs(s, d, "fx_dirty").select("run_id", "created_at", F.round("H0", -1).alias("H0"), F.round("f_EDE", 1).alias("f_EDE"), "enable_ede", "single_z")
    return params.merge_defaults(coarse).withColumn("cache_key", params.cache_key())


KEYED = "g AS (SELECT run_id, created_s, concat(round(H0, -1), '|', round(f_EDE, 1), '|', enable_ede, '|', single_z) AS g FROM fx_dirty)"


def keyed_sql(body):
    return o.on("fx_dirty", body).replace(")\nSELECT", f"), {KEYED}\nSELECT", 1)


@query(keyed_sql("SELECT run_id, dense_rank() OVER (ORDER BY f) AS key_no FROM (SELECT run_id, min(run_id) OVER (PARTITION BY g) AS f FROM g) q"))
def cache_key(s, d):
    """Keys differ between the engines: compared are which runs share one, and the keys' order by their first run."""
    rows = stored(keyed(s, d).select("run_id", "cache_key"))
    keys = ledger.numbered(rows.groupBy("cache_key").agg(F.min("run_id").alias("f")), ["f"], "key_no")
    return rows.join(keys, "cache_key").select("run_id", "key_no")


@query(keyed_sql("SELECT run_id FROM g WHERE g IN (SELECT g FROM g WHERE run_id % 10 = 0)"))
def cache_hits(s, d):
    k = keyed(s, d)
    return ledger.cache_hits(k, k.filter("run_id % 10 = 0")).select("run_id")


@query(keyed_sql("SELECT run_id FROM g WHERE g NOT IN (SELECT g FROM g WHERE run_id % 10 = 0)"))
def cache_misses(s, d):
    k = keyed(s, d)
    return ledger.cache_misses(k, k.filter("run_id % 10 = 0")).select("run_id")


@query(keyed_sql("SELECT count(*) AS runs, arg_min(run_id, created_s) AS first_run FROM g GROUP BY g HAVING count(*) > 1"))
def run_duplicates(s, d):
    return ledger.run_duplicates(keyed(s, d)).select("runs", "first_run")


POINTS = "ev AS (SELECT event_id, user_id AS curve, CAST(event_id*3+1 AS DOUBLE) AS x FROM events), cu AS (SELECT curve, x, max(y) AS y FROM fx_order_curve GROUP BY curve, x), ab AS (SELECT l.event_id, l.x, l.x0, l.y0, h.x AS x1, h.y AS y1 FROM (SELECT ev.*, cu.x AS x0, cu.y AS y0 FROM ev ASOF LEFT JOIN cu ON ev.curve = cu.curve AND ev.x >= cu.x) l ASOF LEFT JOIN cu h ON l.curve = h.curve AND l.x <= h.x)"


def points(s, d):
    return table(s, d, "fx_event_point"), table(s, d, "fx_order_curve").groupBy("curve", "x").agg(F.max("y").alias("y"))


def interpolation_sql(inside: str, outside: str) -> str:
    return o.on("fx_order_curve", f"SELECT event_id, {o.rl(f'CASE WHEN x0 IS NULL OR x1 IS NULL THEN {outside} WHEN x0 = x1 THEN y0 ELSE {inside} END')} AS ln_value FROM ab").replace(")\nSELECT", f"), {POINTS}\nSELECT", 1)


STRAIGHT, CURVED = "y0+(y1-y0)/(x1-x0)*(x-x0)", "exp(ln(y0)+(ln(y1)-ln(y0))/(ln(x1)-ln(x0))*(ln(x)-ln(x0)))"


def interpolated(s, d, **how):
    p, q = points(s, d)
    return curves.interpolate(p, q, ["curve"], **how).select("event_id", rl("value").alias("ln_value"))


@query(interpolation_sql(CURVED, "coalesce(y0, y1)"))
def loglog_interp(s, d):
    return interpolated(s, d)


@query(interpolation_sql(CURVED, "NULL"))
def strict_interp(s, d):
    return interpolated(s, d, log=True, strict=True, floor=1e-300)


@query(interpolation_sql(STRAIGHT, "coalesce(y0, y1)"))
def linear_interp(s, d):
    return interpolated(s, d, log=False)


#: Run 1 has no z = 0.5: its growth is interpolated, and other runs' curves at 0.5 have no baseline.
BASELINE = 1
MISFIT = "cv AS (SELECT * FROM curves WHERE NOT (run_id = 1 AND fit = 'Tinker 2008')), ky AS (SELECT DISTINCT metric, run_id, window_type, fit, z FROM cv), bs AS (SELECT metric, z, window_type, fit FROM ky WHERE run_id = 1), bf AS (SELECT metric, z, min([window_type, fit]) AS f FROM bs GROUP BY metric, z), mt AS (SELECT ky.*, coalesce(bs.window_type, bf.f[1]) AS base_window, coalesce(bs.fit, bf.f[2]) AS base_fit FROM ky LEFT JOIN bs USING (metric, z, window_type, fit) LEFT JOIN bf USING (metric, z))"


def compared_curves(s, d):
    return stored(all_curves(s, d).filter(~((c("run_id") == BASELINE) & (c("fit") == "Tinker 2008"))))


@query(o.sql("curves", "SELECT metric, run_id, window_type, fit, z, base_window, base_fit FROM mt", MISFIT))
def baseline_match(s, d):
    return compare.baseline_match(compared_curves(s, d), BASELINE)


@query(o.on("fx_run", "SELECT event_id AS owner, event_id % 150 AS run_id, CASE WHEN event_id % 150 IN (SELECT run_id FROM fx_run) THEN event_id % 150 ELSE (SELECT arg_max(run_id, created_s) FROM fx_run) END AS resumed FROM events"))
def resume_run(s, d):
    ask = table(s, d, "events").select(c("event_id").alias("owner"), (c("event_id") % 150).alias("run_id"))
    return ledger.resume_run(ask, runs(s, d))


# --- aggregations --------------------------------------------------------------------------------------------------

ORDER_CURVES = "cu AS (SELECT curve, x, max(y) AS y FROM fx_order_curve GROUP BY curve, x)"


def order_curves(s, d):
    return table(s, d, "fx_order_curve").groupBy("curve", "x").agg(F.max("y").alias("y"))


def on_orders(body):
    return o.on("fx_order_curve", body).replace(")\nSELECT", f"), {ORDER_CURVES}\nSELECT", 1)


@query(on_orders(f"SELECT curve, round(sum(w*y)/1e6, 6) + 0e0 AS integral FROM ({o.weights('cu', 'curve', 'x')}) q GROUP BY curve"))
def simpson_integral(s, d):
    return curves.simpson_integral(order_curves(s, d), ["curve"]).select("curve", (F.round(c("integral") / 1e6, 6) + 0.0).alias("integral"))


SIGMA_ROWS = f"SELECT run_id, window_type, z, {o.rl('m_h')} AS ln_m_h, {o.rl('sigma')} AS ln_sigma FROM sig"


def shown(df):
    return df.select("run_id", "window_type", "z", rl("m_h").alias("ln_m_h"), rl("sigma").alias("ln_sigma"))


@query(o.sql("sig", SIGMA_ROWS))
def sigma_m(s, d):
    return shown(sigmas(s, d))


@query(o.sql("sig", SIGMA_ROWS))
def sigma_m_packed(s, d):
    return shown(sigma.sigma_m_packed(power(s, d), radii(s, d)))


@query(o.sql("s8", f"SELECT run_id, z, {o.rl('sigma8')} AS ln_sigma8 FROM s8"))
def sigma8(s, d):
    return sigma.sigma8(power(s, d), table(s, d, "fx_run"), dealt=True).select("run_id", "z", rl("sigma8").alias("ln_sigma8"))


@query(o.sql("rad", " UNION ALL ".join(f"SELECT pw.run_id, '{n}' AS window_type, z, {o.rl('m_h')} AS ln_m_h, {o.rl(f'greatest({o.sigma_sum(n)}, 1e-6)')} AS ln_sigma FROM pw JOIN rad ON pw.run_id = rad.run_id GROUP BY pw.run_id, z, m_h" for n in windows.WINDOWS)))
def sigma_windows(s, d):
    return shown(sigmas(s, d, windows.WINDOWS).withColumn("sigma", F.greatest("sigma", F.lit(1e-6))))


@query(o.sql("rad", f"SELECT run_id, {o.rl('lo*small')} AS low_small, {o.rl('lo*large')} AS low_large, {o.rl('hi*small')} AS high_small, {o.rl('hi*large')} AS high_large FROM (SELECT run_id, min(k) AS lo, max(k) AS hi FROM fx_power GROUP BY run_id) a JOIN (SELECT run_id, min(r) AS small, max(r) AS large FROM rad GROUP BY run_id) b USING (run_id)"))
def k_coverage(s, d):
    r = sigma.k_coverage(power(s, d), radii(s, d))
    return r.select("run_id", *[rl(x).alias(x) for x in r.columns[1:]])


@query(o.sql("fx_growth", f"SELECT run_id, z, {o.r8('growth/max(CASE WHEN z = 0 THEN growth END) OVER (PARTITION BY run_id)')} AS d FROM fx_growth"))
def growth_norm(s, d):
    return sigma.growth_norm(table(s, d, "fx_growth")).select("run_id", "z", r8("d").alias("d"))


GROWTH_CHECK = o.sql("s8", f"SELECT run_id, z, {o.r8('sigma8/max(CASE WHEN z = 0 THEN sigma8 END) OVER (PARTITION BY run_id)')} AS ratio, {o.r8('growth')} AS growth FROM s8 JOIN fx_growth USING (run_id, z)")


@query(GROWTH_CHECK)
def growth_check(s, d):
    rows = compare.growth_check(sigma.sigma8(power(s, d), table(s, d, "fx_run"), dealt=True), table(s, d, "fx_growth"))
    return rows.select("run_id", "z", r8("ratio").alias("ratio"), r8("growth").alias("growth"))


@query(o.sql("fx_growth", f"SELECT run_id, z, {o.r8('growth')} AS growth FROM fx_growth ORDER BY run_id, z"))
def sorted_growth(s, d):
    return table(s, d, "fx_growth").orderBy("run_id", "z").select("run_id", "z", r8("growth").alias("growth"))


P_AT = "pa AS (SELECT a.run_id, a.z, a.p + (b.p-a.p)/(b.k-a.k)*(0.01e0-a.k) AS p FROM (SELECT run_id, z, max(k) AS k, arg_max(p, k) AS p FROM fx_power WHERE k <= 0.01e0 GROUP BY ALL) a JOIN (SELECT run_id, z, min(k) AS k, arg_min(p, k) AS p FROM fx_power WHERE k > 0.01e0 GROUP BY ALL) b USING (run_id, z)), fp AS (SELECT run_id, z, sqrt(p/max(CASE WHEN z = 0 THEN p END) OVER (PARTITION BY run_id)) AS f FROM pa)"


@query(o.sql("s8", f"SELECT run_id, z, {o.rl('sigma8')} AS ln_sigma8, {o.r8('growth')} AS growth, {o.r8('f')} AS from_power, {o.r8('f/growth-1e0')} AS difference FROM fp JOIN s8 USING (run_id, z) JOIN fx_growth USING (run_id, z)", P_AT))
def growth_diagnostics(s, d):
    rows = compare.growth_diagnostics(power(s, d), sigma.sigma8(power(s, d), table(s, d, "fx_run"), dealt=True), table(s, d, "fx_growth"))
    return rows.select("run_id", "z", rl("sigma8").alias("ln_sigma8"), r8("growth").alias("growth"), r8("from_power").alias("from_power"), r8("difference").alias("difference"))


@query(o.sql("fx_power", "SELECT run_id, count(DISTINCT z) AS redshifts, count(*) AS evaluations FROM fx_power GROUP BY run_id"))
def run_cost(s, d):
    return power(s, d).groupBy("run_id").agg(F.count_distinct("z").alias("redshifts"), F.count("*").alias("evaluations"))


@query(o.sql("fx_z", "SELECT z FROM fx_z GROUP BY z HAVING count(DISTINCT run_id) = (SELECT count(*) FROM fx_run)"))
def common_z(s, d):
    return compare.common_z(table(s, d, "fx_z"))


# --- window functions ----------------------------------------------------------------------------------------------


@query(on_orders(f"SELECT curve, x, round(w, 6) + 0e0 AS w FROM ({o.weights('cu', 'curve', 'x')}) q"))
def simpson_weights(s, d):
    return curves.simpson_weights(order_curves(s, d), ["curve"]).select("curve", "x", (F.round("w", 6) + 0.0).alias("w"))


for _key, _order in (("log_gradient", 2), ("log_gradient_first_order", 1)):
    query(on_orders(f"SELECT curve, x, round(slope, 4) + 0e0 AS slope FROM ({o.gradient('cu', 'curve', 'x', 'y', 'slope', _order)}) q"), _key)(
        lambda s, d, e=_order: curves.log_gradient(order_curves(s, d), ["curve"], edge_order=e).select("curve", "x", (F.round("slope", 4) + 0.0).alias("slope"))
    )


@query(on_orders(f"SELECT curve, x, {o.rl('tail').replace(', 8)', ', 6)')} AS ln_tail FROM ({o.tail('cu', 'curve', 'x', 'y', 'tail')}) q"))
def tail_cumulative(s, d):
    return curves.tail_cumulative(order_curves(s, d), ["curve"]).select("curve", "x", (F.round(F.ln("tail"), 6) + 0.0).alias("ln_tail"))


CLEAN = "cl AS (SELECT run_id, created_s, CASE WHEN trim(name) = '' THEN 'Untitled run' ELSE regexp_replace(trim(name), '\\s+', ' ', 'g') END AS base FROM fx_dirty), pl AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY created_s, run_id) AS p FROM cl), us AS (SELECT regexp_extract(base, '^(.*) \\((\\d+)\\)$', 1) AS b, CAST(regexp_extract(base, '^(.*) \\((\\d+)\\)$', 2) AS BIGINT) AS n FROM (SELECT DISTINCT base FROM cl) q WHERE regexp_matches(base, '^(.*) \\((\\d+)\\)$'))"


@query(o.on("fx_dirty", "SELECT run_id, CASE WHEN p = 1 THEN base ELSE base || ' (' || (p + (SELECT count(*) FROM us WHERE b = base AND n <= p)) || ')' END AS unique_name FROM pl").replace(")\nSELECT", f"), {CLEAN}\nSELECT", 1))
def unique_names(s, d):
    return ledger.unique_names(runs(s, d, "fx_dirty").select("run_id", "name", "created_at")).select("run_id", "unique_name")


@query(o.on("fx_dirty", "SELECT run_id, row_number() OVER (ORDER BY created_s, run_id) AS number, (row_number() OVER (ORDER BY created_s, run_id) - 1) % 5 AS color FROM fx_dirty"))
def run_numbering(s, d):
    return ledger.run_numbering(runs(s, d, "fx_dirty"))


@query(o.on("fx_run", "SELECT run_id, run_id = 7 AS is_baseline FROM fx_run"))
def assign_baseline(s, d):
    flagged = runs(s, d).withColumn("is_baseline", c("run_id") % 8 == 7)
    return ledger.assign_baseline(flagged).select("run_id", "is_baseline")


# --- halo mass function and comparison -----------------------------------------------------------------------------


@query(o.sql("hm", f"SELECT run_id, window_type, z, fit, {o.rl('m_h')} AS ln_m_h, {o.rl('hmf')} AS ln_hmf FROM hm"), "hmf")
def hmf_(s, d):
    rows = hmf.hmf(slopes(s, d), table(s, d, "fx_run"), SHOWN_FITS)
    return rows.select("run_id", "window_type", "z", "fit", rl("m_h").alias("ln_m_h"), rl("hmf").alias("ln_hmf"))


@query(o.sql("hc", f"SELECT run_id, window_type, z, fit, {o.rl('m_h')} AS ln_m_h, {o.rl('n_gt_m')} AS ln_n FROM hc"))
def hmf_cumulative(s, d):
    return tails(s, d).select("run_id", "window_type", "z", "fit", rl("m_h").alias("ln_m_h"), rl("n_gt_m").alias("ln_n"))


@query(o.sql("curves", f"SELECT metric, run_id, window_type, fit, z, {o.r8('CASE WHEN x > 0 THEN ln(x) ELSE -1e0 END')} AS ln_x, {o.rl('y')} AS ln_y FROM curves"))
def metric_curves(s, d):
    return all_curves(s, d).select("metric", "run_id", "window_type", "fit", "z", r8(F.when(c("x") > 0, F.ln("x")).otherwise(-1.0)).alias("ln_x"), rl("y").alias("ln_y"))


COMPARED = MISFIT + """, bc AS (SELECT mt.metric, mt.run_id, mt.window_type, mt.fit, mt.z, b.x AS bx, b.y AS by1 FROM mt JOIN cv b ON b.run_id = 1 AND b.metric = mt.metric AND b.z = mt.z AND b.window_type = mt.base_window AND b.fit = mt.base_fit),
ls AS (SELECT metric, run_id, window_type, fit, z, min(l) AS l FROM (SELECT metric, run_id, window_type, fit, z, x AS l FROM cv UNION ALL SELECT metric, run_id, window_type, fit, z, least(bx, by1) FROM bc) q GROUP BY ALL),
lo AS (SELECT cv.*, bc.bx AS x0, bc.by1 AS y0 FROM cv ASOF LEFT JOIN bc ON cv.metric = bc.metric AND cv.run_id = bc.run_id AND cv.window_type = bc.window_type AND cv.fit = bc.fit AND cv.z = bc.z AND cv.x >= bc.bx),
hi AS (SELECT lo.*, bc.bx AS x1, bc.by1 AS y1 FROM lo ASOF LEFT JOIN bc ON lo.metric = bc.metric AND lo.run_id = bc.run_id AND lo.window_type = bc.window_type AND lo.fit = bc.fit AND lo.z = bc.z AND lo.x <= bc.bx),
ba AS (SELECT hi.*, CASE WHEN x0 IS NULL OR x1 IS NULL THEN coalesce(y0, y1) WHEN x0 = x1 THEN y0 WHEN l > 0 THEN exp(ln(y0)+(ln(y1)-ln(y0))/(ln(x1)-ln(x0))*(ln(x)-ln(x0))) ELSE y0+(y1-y0)/(x1-x0)*(x-x0) END AS base FROM hi JOIN ls USING (metric, run_id, window_type, fit, z))"""
RATIO = "CASE WHEN abs(base) > 1e-300 THEN y/base END"
VALUES = {"ratio": RATIO, "fractional": f"({RATIO}-1e0)", "percent": f"(100e0*({RATIO}-1e0))", "overlay": "ln(y)"}
X_SQL = o.r8("CASE WHEN x > 0 THEN ln(x) ELSE -1e0 END")


def round_relative(v: str) -> str:
    """Ratios span many decades: digits after the sign's logarithm."""
    return f"(round(CASE WHEN abs({v}) < 1e0 THEN {v} ELSE sign({v})*(1e0+ln(abs({v}))) END, 6) + 0e0)"


for _mode, _sql in VALUES.items():

    def _compared(s, d, mode=_mode):
        v = c("value") if mode != "overlay" else F.ln("value")
        scaled = F.when(F.abs(v) < 1.0, v).otherwise(F.signum(v) * (1.0 + F.ln(F.abs(v))))
        rows = compare.compare(compared_curves(s, d), BASELINE, mode)
        return rows.select("metric", "run_id", "window_type", "fit", "z", r8(F.when(c("x") > 0, F.ln("x")).otherwise(-1.0)).alias("ln_x"), rounded(scaled, 6).alias("value"))

    query(o.sql("curves", f"SELECT metric, run_id, window_type, fit, z, {X_SQL} AS ln_x, {round_relative(_sql)} AS value FROM ba", COMPARED), f"compare_{_mode}")(_compared)


@query(o.sql("curves", "SELECT metric, round(ln(greatest(quantile_cont(abs(v), 0.99e0), 1e-4)), 6) AS ln_extent FROM (SELECT metric, " + VALUES["fractional"] + " AS v FROM ba) q GROUP BY metric", COMPARED))
def residual_extent(s, d):
    return compare.residual_extent(compare.compare(compared_curves(s, d), BASELINE, "fractional")).select("metric", F.round(F.ln("extent"), 6).alias("ln_extent"))


@query(o.sql("s8", f"SELECT run_id, name, run_id = 1 AS baseline, H0, Omega_m, Omega_b, A_s, n_s, enable_ede, 0.1e0 AS f_EDE, -3.5e0 AS log10_a_c, {o.r8('sigma8')} AS sigma8 FROM fx_run JOIN (SELECT run_id, sigma8 FROM s8 WHERE z = 0) q USING (run_id)"))
def compare_table(s, d):
    now = sigma.sigma8(power(s, d).filter("z = 0"), table(s, d, "fx_run"), dealt=True).select("run_id", "sigma8")
    return compare.compare_table(params.merge_defaults(runs(s, d)), now, BASELINE).withColumn("sigma8", r8("sigma8"))


# --- sorts, limits, sets -------------------------------------------------------------------------------------------


@query(o.on("fx_dirty", "SELECT run_id, name FROM fx_dirty ORDER BY created_s DESC, run_id DESC LIMIT 3"))
def latest_runs(s, d):
    return ledger.latest_runs(runs(s, d, "fx_dirty")).select("run_id", "name")


@query(o.sql("curves", "SELECT metric, run_id, window_type, fit, count(*) AS samples FROM (SELECT * FROM curves JOIN (SELECT metric, run_id, window_type, fit, row_number() OVER (PARTITION BY metric ORDER BY run_id, window_type, fit) AS place FROM (SELECT DISTINCT metric, run_id, window_type, fit FROM curves) a) b USING (metric, run_id, window_type, fit) WHERE place <= 36) q GROUP BY ALL"))
def curve_cap(s, d):
    return compare.curve_cap(stored(all_curves(s, d))).groupBy("metric", "run_id", "window_type", "fit").agg(F.count("*").alias("samples"))


PARSED = "p AS (SELECT event_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM fx_event_text), v AS (SELECT event_id, list_filter(list_transform(parts, lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x >= 0) AS vals, list_filter(list_transform(parts, lambda x: CASE WHEN TRY_CAST(x AS DOUBLE) IS NULL THEN 'Could not parse redshift value ''' || x || '''.' WHEN TRY_CAST(x AS DOUBLE) < 0 THEN 'Ignored negative redshift value ' || x || '.' END), lambda x: x IS NOT NULL) AS issues FROM p)"


def parsed_sql(body):
    return o.on("fx_event_text", body).replace(")\nSELECT", f"), {PARSED}\nSELECT", 1)


def numbers(a):
    return F.array_join(F.transform(a, params.short_number), ",")


NUMBERS = "coalesce(list_aggregate(list_transform({}, lambda x: " + G12.format("x") + "), 'string_agg', ','), '')"


@query(parsed_sql(f"SELECT event_id, {NUMBERS.format('vals')} AS redshifts, list_aggregate(issues, 'string_agg', ' ') AS issues FROM v"))
def parse_redshifts(s, d):
    values, issues = params.parse_redshifts("text")
    return table(s, d, "fx_event_text").select("event_id", numbers(values).alias("redshifts"), F.array_join(issues, " ").alias("issues"))


@query(parsed_sql(f"SELECT event_id, {NUMBERS.format('list_sort(list_distinct(list_concat(vals, [0e0, 0.5e0, 1e0, 2e0, 5e0, 10e0])))')} AS redshifts FROM v"))
def combined_redshifts(s, d):
    values, _ = params.parse_redshifts("text")
    presets = F.array(*map(F.lit, REDSHIFTS))
    return table(s, d, "fx_event_text").select("event_id", numbers(params.combined_redshifts(presets, values)).alias("redshifts"))


@query(o.sql("fx_z", "SELECT ask.run_id, ask.z FROM ask WHERE NOT EXISTS (SELECT 1 FROM fx_z s WHERE s.run_id = ask.run_id AND s.z = ask.z)", Z_ASK))
def missing_redshifts(s, d):
    return hmf.strict_z(z_requests(s, d), table(s, d, "fx_z"))[1]


# --- names, ledger, fields -----------------------------------------------------------------------------------------

PARTS = f"""list_filter([CASE WHEN abs(A_s-2.1e-9)/2.1e-9 > 0.03e0 THEN CASE WHEN A_s > 2.1e-9 THEN 'High A_s' ELSE 'Low A_s' END END, CASE WHEN abs(n_s-0.965e0) > 0.01e0 THEN CASE WHEN n_s > 0.965e0 THEN 'Blue Tilt' ELSE 'Red Tilt' END END,
  CASE WHEN enable_ede THEN printf('EDE f%.2f zc%d', f_EDE, CAST(round(pow(10e0, -log10_a_c)-1e0) AS BIGINT)) END, CASE WHEN abs(Omega_m-{o.d(params.DEFAULTS['Omega_m'])}) > 0.015e0 THEN printf('Omega_m %.3f', Omega_m) END], lambda x: x IS NOT NULL)"""


@query(o.on("fx_dirty", f"SELECT run_id, printf('Run %03d — ', run_id) || CASE WHEN len(p) = 0 THEN 'Baseline LCDM' WHEN len(p) <= 2 THEN list_aggregate(p, 'string_agg', ' + ') ELSE 'Custom Cosmology' END AS name FROM (SELECT run_id, {PARTS} AS p FROM m) q").replace(")\nSELECT", f"), {DIRTY}\nSELECT", 1))
def auto_name(s, d):
    r = params.merge_defaults(runs(s, d, "fx_dirty"))
    return r.select("run_id", params.auto_name(c("run_id")).alias("name"))


@query(o.on("fx_dirty", "SELECT run_id, name || ' | ' || coalesce(class_status, 'UNKNOWN') || ' | ' || strftime(make_timestamp(created_s*1000000), '%Y-%m-%d %H:%M') || ' | A_s=' || printf('%.2e', A_s) || CASE WHEN enable_ede THEN ', f_EDE=' || printf('%.2f', f_EDE) ELSE '' END AS label FROM m").replace(")\nSELECT", f"), {DIRTY}\nSELECT", 1))
def run_label(s, d):
    r = params.merge_defaults(runs(s, d, "fx_dirty"))
    return r.select("run_id", params.run_label().alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'run' ELSE p_partkey || '_' || replace(p_type, ' ', '_') || '_a_b' END AS stem FROM part")
def safe_stem(s, d):
    made = F.when(c("p_partkey") % 10 == 0, F.lit(' /\\ :*?"<>| ')).otherwise(F.concat(F.lit("  "), c("p_partkey").cast("string"), F.lit(" \\ "), c("p_type"), F.lit("/a  \t b:?_ ")))
    return table(s, d, "part").select("p_partkey", params.safe_stem(made).alias("stem"))


@query(o.on("fx_run", "SELECT run_id, name, run_id = (SELECT min(run_id) FROM fx_run WHERE run_id % 10 = 3) AS is_baseline FROM (SELECT run_id, CASE WHEN run_id % 5 = 1 THEN 'Renamed' || CASE WHEN run_id > (SELECT min(run_id) FROM fx_run WHERE run_id % 5 = 1 AND run_id % 4 <> 0) THEN ' (' || (SELECT count(*) FROM fx_run b WHERE b.run_id % 5 = 1 AND b.run_id % 4 <> 0 AND b.run_id <= a.run_id) || ')' ELSE '' END ELSE name END AS name FROM fx_run a WHERE run_id % 4 <> 0 UNION ALL SELECT run_id + 1000000, 'Copy of ' || name FROM fx_run WHERE run_id % 5 = 2 AND run_id % 4 <> 0) q"))
def apply_ledger_edits(s, d):
    r = runs(s, d).select("run_id", "name", "created_at", (c("run_id") == 0).alias("is_baseline"), F.create_map(F.lit("a"), F.lit("b")).alias("exports"))
    act = lambda when, action, argument: r.filter(when).select("run_id", F.lit(action).alias("action"), argument.alias("argument"))
    base = r.filter("run_id % 10 = 3").agg(F.min("run_id").alias("run_id")).select("run_id", F.lit("baseline").alias("action"), F.lit("1").alias("argument"))
    edits = act("run_id % 4 = 0", "delete", F.lit(None).cast("string")).unionByName(act("run_id % 5 = 1", "rename", F.lit("  Renamed "))).unionByName(act("run_id % 5 = 2", "duplicate", (c("run_id") + 1000000).cast("string"))).unionByName(base)
    return ledger.apply_edits(r, edits).select("run_id", "name", "is_baseline")


N, BOX, SMOOTH = 32, 200.0, 4.0


def modes(s, d):
    """A mode for every part: places of a grid of N^3, in order of the keys, more than once if there are more parts."""
    p = table(s, d, "part").select("p_partkey", *[(F.expr(f"p_partkey div {q}") % N).cast("double").alias(x) for q, x in ((N * N, "ix"), (N, "iy"), (1, "iz"))])
    wrap = lambda i: F.when(i >= N / 2, i - float(N)).otherwise(i)
    kk = 2.0 * 3.141592653589793 / BOX * F.sqrt(sum((wrap(c(x)) * wrap(c(x)) for x in ("iy", "iz")), wrap(c("ix")) * wrap(c("ix"))))
    return p.select(c("p_partkey").alias("mode_id"), kk.alias("kk"), ((c("p_partkey") * 37 % 101) / 50.0 - 1.0).alias("re"), ((c("p_partkey") * 53 % 97) / 48.0 - 1.0).alias("im"))


WRAP = lambda q: f"(CASE WHEN ((p_partkey // {q}) % {N}) >= {N // 2} THEN ((p_partkey // {q}) % {N})-{N}e0 ELSE ((p_partkey // {q}) % {N})*1e0 END)"
MODES = f"md AS (SELECT p_partkey AS mode_id, 2e0*pi()/200e0*sqrt({WRAP(N * N)}*{WRAP(N * N)}+{WRAP(N)}*{WRAP(N)}+{WRAP(1)}*{WRAP(1)}) AS kk, (p_partkey*37 % 101)/50e0-1e0 AS re, (p_partkey*53 % 97)/48e0-1e0 AS im FROM part), p0 AS (SELECT run_id, k, p, lead(k) OVER w AS k1, lead(p) OVER w AS p1 FROM fx_power WHERE z = 0 WINDOW w AS (PARTITION BY run_id ORDER BY k)), am AS (SELECT mode_id, run_id, pow({N}e0/200e0, 1.5e0)*sqrt(exp(ln(p)+(ln(p1)-ln(p))*(ln(kk)-ln(k))/(ln(k1)-ln(k))))*exp(-0.5e0*pow(kk*4e0, 2)) AS a FROM md JOIN p0 ON kk > 0 AND kk >= k AND kk < k1)"


@query(o.sql("fx_power", f"SELECT mode_id, r.run_id, {o.r8('re*coalesce(a, 0e0)')} AS re, {o.r8('im*coalesce(a, 0e0)')} AS im FROM md CROSS JOIN (SELECT run_id FROM fx_run) r LEFT JOIN am USING (mode_id, run_id)", MODES))
def mode_filter(s, d):
    rows = field.mode_filter(modes(s, d), power(s, d).filter("z = 0"), N, BOX, SMOOTH)
    return rows.select("mode_id", "run_id", r8("re").alias("re"), r8("im").alias("im"))


@query(f"SELECT p_partkey, {o.r8('2e0*pi()/(100e0+p_size)')} AS k_fund, {o.r8('pi()*64e0/(100e0+p_size)')} AS k_nyq FROM part")
def fourier_coverage(s, d):
    boxes = table(s, d, "part").select("p_partkey", (100.0 + c("p_size")).alias("box"), F.lit(64.0).alias("n"))
    return field.fourier_coverage(boxes).select("p_partkey", r8("k_fund").alias("k_fund"), r8("k_nyq").alias("k_nyq"))


CELLS = "WITH e AS (SELECT CAST(label AS BIGINT) AS run_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), ce AS (SELECT run_id, CAST(pos // 8 AS BIGINT) AS ix, CAST(pos % 8 AS BIGINT) AS iy, avg(CAST(v AS DOUBLE)) AS delta FROM e GROUP BY run_id, pos), b AS (SELECT ix, iy, delta AS bd FROM ce WHERE run_id = 1), br AS (SELECT greatest(stddev_pop(bd), 1e-30) AS rms FROM b), f AS (SELECT ce.run_id, ix, iy, delta, bd, rms FROM ce JOIN b USING (ix, iy) CROSS JOIN br)\n"


@query(CELLS + f"SELECT run_id, ix, iy, {o.r8('delta/rms')} AS scaled, {o.r8('(delta-bd)/rms')} AS difference FROM f")
def field_normalize(s, d):
    return field.field_normalize(cells(s, d), 1).select("run_id", "ix", "iy", r8("scaled").alias("scaled"), r8("difference").alias("difference"))


@query(CELLS + f"SELECT run_id, {o.r8('stddev_pop(delta)')} AS rms, {o.r8('stddev_pop(delta)/max(rms)')} AS rms_ratio, {o.r8('corr(delta, bd)')} AS correlation, {o.r8('stddev_pop(delta-bd)/max(rms)')} AS difference_ratio FROM f GROUP BY run_id")
def field_stats(s, d):
    rows = field.field_stats(cells(s, d), 1)
    return rows.select("run_id", *[r8(x).alias(x) for x in rows.columns[1:]])


@query(CELLS + f"SELECT run_id, {o.r8('greatest(quantile_cont(abs(delta/rms), 0.995e0), 1e0)')} AS scale_extent, {o.r8('greatest(quantile_cont(abs((delta-bd)/rms), 0.995e0), 1e-4)')} AS difference_extent FROM f GROUP BY run_id")
def field_extent(s, d):
    rows = field.field_extent(field.field_normalize(cells(s, d), 1))
    return rows.select("run_id", r8("scale_extent").alias("scale_extent"), r8("difference_extent").alias("difference_extent"))


@query(CELLS + f"SELECT run_id, iy, {o.r8('delta')} AS delta FROM ce WHERE ix = 4")
def field_cut(s, d):
    return field.field_cut(cells(s, d), 8).select("run_id", "iy", r8("delta").alias("delta"))


def flagship(s, d):
    """n(>M) of every run and redshift: power -> sigma -> slope -> mass function -> tail."""
    return hmf_cumulative(s, d)


for _name in ("series_error", "sigma_integrand", "calibration_label"):  # their names while a partial form had the plain one
    Q[f"{_name}_whole"], SQL[f"{_name}_whole"] = Q[_name], SQL[_name]
