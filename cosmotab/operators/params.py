"""Parameter sets, one row per run: defaults, checks, presets, redshift lists, solver settings, names and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosmotab.functions import cosmology as cos

#: Parameter defaults.
DEFAULTS: dict[str, object] = {
    "mode": "Learning", "A_s": 2.1e-9, "n_s": 0.965, "k_pivot": 0.05, "H0": 67.81, "Omega_m": 0.3098830430481205, "Omega_b": 0.0493, "Omega_k": 0.0,
    "N_eff": 3.046, "Tcmb": 2.7255, "tau_reio": 0.06, "enable_ede": True, "f_EDE": 0.10, "log10_a_c": -3.5, "n_EDE": 3, "scf_parameters": "2.806,0.0",
    "k_min": 1e-4, "k_max": 200.0, "k_points": 1200, "quad_limit": 200, "window_type": "Top-hat", "fitting": "Sheth-Tormen 2001", "delta_halo": 200.0,
    "delta_c": 1.686, "mass_min_exp": 8.0, "mass_max_exp": 15.0, "mass_points": 80, "selected_mass_exp": 12.0, "single_z": 0.0, "custom_z_list": "",
    "z_presets_selected": [0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 100.0], "z_values": [0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 100.0],
}
#: Parameter, smallest and largest allowed value.
RANGES = (
    ("A_s", 0.5e-9, 3.5e-9), ("n_s", 0.90, 1.05), ("k_pivot", 0.002, 0.1), ("H0", 55.0, 80.0), ("Omega_m", 0.20, 0.45), ("Omega_b", 0.035, 0.065),
    ("Omega_k", -0.05, 0.05), ("N_eff", 2.0, 4.5), ("Tcmb", 2.70, 2.75), ("tau_reio", 0.03, 0.09), ("f_EDE", 0.0, 0.20), ("log10_a_c", -4.5, -2.5),
    ("k_min", 1e-5, 1e-3), ("k_max", 10.0, 300.0), ("k_points", 300.0, 3000.0), ("quad_limit", 100.0, 500.0), ("delta_c", 1.5, 1.9), ("mass_min_exp", 8.0, 12.0),
    ("mass_max_exp", 12.0, 16.0), ("mass_points", 40.0, 250.0), ("selected_mass_exp", 8.0, 15.0), ("single_z", 0.0, 100.0),
)
#: Scenario, its overrides and its draft name.
PRESETS = (
    ("LCDM", {"enable_ede": False}, "Baseline LCDM"),
    ("EDE", {"enable_ede": True, "f_EDE": 0.10, "log10_a_c": -3.5, "n_EDE": 3}, "EDE f0.10"),
    ("High amplitude", {"enable_ede": False, "A_s": 2.35e-9}, "High A_s"),
    ("Blue tilt", {"enable_ede": False, "n_s": 0.99}, "Blue tilt"),
)
#: The parameters that a solution depends on.
SLOW_KEYS = (
    "A_s", "n_s", "k_pivot", "H0", "Omega_m", "Omega_b", "Omega_k", "tau_reio", "Tcmb", "N_eff", "enable_ede", "f_EDE", "log10_a_c", "n_EDE", "k_min",
    "k_max", "k_points", "z_values", "single_z", "scf_parameters",
)


#: The messages of the rules that parameters can break, in the rules' order.
MESSAGES = (
    "Omega_b must be smaller than Omega_m so Omega_cdm remains positive.",
    "The k range must satisfy 0 < k_min < k_max.",
    "At least 50 k samples are required.",
    "The minimum halo mass must be below the maximum halo mass.",
    "At least 20 mass samples are required.",
    "The inspection mass must lie inside the selected halo-mass range.",
    "Redshifts must be non-negative.",
    "f_EDE must lie between 0 and 0.3.",
)
#: What is said of a part of a redshift list that is no number, or a negative one: before and after the part.
NOT_PARSED, NEGATIVE = ("Could not parse redshift value '", "'."), ("Ignored negative redshift value ", ".")


def _lit(v: object) -> Column:
    return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)


def merge_defaults(runs: DataFrame, defaults: dict[str, object] = DEFAULTS) -> DataFrame:
    """Every parameter as a column: the run's value, or the default where it is null or the column is missing."""
    have = set(runs.columns)
    return runs.withColumns({k: F.coalesce(F.col(k), _lit(v)) if k in have else _lit(v) for k, v in defaults.items()})


def violations() -> Column:
    """The messages of the rules that a complete parameter row breaks, as an array."""
    c = F.col
    rules = (
        c("Omega_b") >= c("Omega_m"),
        (c("k_min") <= 0) | (c("k_max") <= c("k_min")),
        c("k_points") < 50,
        c("mass_min_exp") >= c("mass_max_exp"),
        c("mass_points") < 20,
        (c("selected_mass_exp") < c("mass_min_exp")) | (c("selected_mass_exp") > c("mass_max_exp")),
        F.exists("z_values", lambda z: z < 0),
        c("enable_ede") & ((c("f_EDE") < 0) | (c("f_EDE") > 0.3)),
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in zip(rules, MESSAGES, strict=True)]))


def validate_params(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid runs, rejected runs with column violations) of runs with all parameters."""
    marked = runs.withColumn("violations", violations())
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def range_audit(runs: DataFrame, ids: list[str] = ["run_id"]) -> DataFrame:  # noqa: B006
    """run_id, param, value, lo, hi for every numeric parameter outside its allowed range."""
    have = [(p, lo, hi) for p, lo, hi in RANGES if p in runs.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for p, lo, hi in have]))
    return runs.select(*ids, rows.alias("r")).select(*ids, "r.*").filter(~F.col("value").between(F.col("lo"), F.col("hi")))


def apply_presets(runs: DataFrame) -> DataFrame:
    """Each run once for each scenario (column preset), its parameters overridden and preset_name set."""
    fields = sorted({k for _, o, _ in PRESETS for k in o})
    kind = {k: type(DEFAULTS[k]).__name__.replace("bool", "boolean").replace("str", "string").replace("float", "double") for k in fields}
    presets = F.explode(
        F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(label).alias("preset_name"), *[F.lit(o.get(k)).cast(kind[k]).alias(f"new_{k}") for k in fields]) for n, o, label in PRESETS])
    )
    out = runs.select("*", presets.alias("_p")).select("*", "_p.*").drop("_p")
    return out.withColumns({k: F.coalesce(f"new_{k}", k) if k in runs.columns else F.coalesce(f"new_{k}", F.lit(DEFAULTS[k])) for k in fields}).drop(*[f"new_{k}" for k in fields])


def derived_quantities(runs: DataFrame) -> DataFrame:
    """Adds h, Omega_cdm, Omega_r, Omega_de, rho_crit, rho0, a_c and z_c."""
    c = F.col
    r = cos.omega_r(c("H0"), c("Tcmb"), c("N_eff"))
    a_c = F.pow(F.lit(10.0), c("log10_a_c"))
    return runs.withColumns({
        "h": cos.h(c("H0")), "Omega_cdm": c("Omega_m") - c("Omega_b"), "Omega_r": r, "Omega_de": 1.0 - c("Omega_m") - c("Omega_k") - r,
        "rho_crit": cos.rho_crit(c("H0")), "rho0": cos.rho0(c("H0"), c("Omega_m")), "a_c": a_c, "z_c": 1.0 / a_c - 1.0,
    })


def parse_redshifts(text: str | Column) -> tuple[Column, Column]:
    """(values, issues): the numbers of a comma-separated text, in order, and what is wrong with the other parts."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    number = lambda p: p.try_cast("double")
    values = F.filter(F.transform(parts, number), lambda v: v >= 0)
    message = lambda p: (
        F.when(number(p).isNull(), F.concat(F.lit(NOT_PARSED[0]), p, F.lit(NOT_PARSED[1])))
        .when(number(p) < 0, F.concat(F.lit(NEGATIVE[0]), p, F.lit(NEGATIVE[1])))
    )
    return F.coalesce(values, F.array().cast("array<double>")), F.coalesce(F.array_compact(F.transform(parts, message)), F.array().cast("array<string>"))


def combined_redshifts(presets: Column, custom: Column, single: Column | None = None) -> Column:
    """Sorted distinct union of preset, custom and single redshifts with 0, none negative."""
    more = F.array(F.lit(0.0)) if single is None else F.array(F.lit(0.0), single)
    return F.array_sort(F.array_distinct(F.filter(F.concat(presets, custom, more), lambda z: z >= 0)))


def short_number(x: Column) -> Column:
    """A double with 12 significant digits, without a fraction's trailing zeros: 0.5, 1, 10, 0.12345678, 1e-07."""
    digits = F.format_string("%.12g", x)
    return F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def plain_number(x: Column) -> Column:
    """As short_number(), with .0 where it would look like a whole number: 200.0, 0.0001, 2e-06."""
    short = short_number(x)
    return F.when(short.rlike("[.e]"), short).otherwise(F.concat(short, F.lit(".0")))


def solver_settings() -> Column:
    """Map of settings for the external solver; the keys of early dark energy only where it is on. Keys and constant
    settings are fixed values, the solver's own."""
    c, text = F.col, lambda x: x.cast("string")
    zs = combined_redshifts(c("z_values"), F.array().cast("array<double>"), c("single_z"))
    pairs = {
        "output": F.lit("mPk"), "H0": text(c("H0")), "Omega_b": text(c("Omega_b")), "Omega_cdm": text(c("Omega_m") - c("Omega_b")), "Omega_k": text(c("Omega_k")),
        "A_s": text(c("A_s")), "n_s": text(c("n_s")), "k_pivot": text(c("k_pivot")), "tau_reio": text(c("tau_reio")), "T_cmb": text(c("Tcmb")), "N_ur": text(c("N_eff")),
        "P_k_max_1/Mpc": text(1.05 * c("k_max")), "z_max_pk": short_number(F.array_max(zs)), "z_pk": F.array_join(F.transform(zs, short_number), ","), "modes": F.lit("s"), "gauge": F.lit("synchronous"),
    }
    early = {
        "scf_potential": F.lit("axion"), "n_axion": text(c("n_EDE")), "log10_axion_ac": text(c("log10_a_c")), "fraction_axion_ac": text(c("f_EDE")), "scf_parameters": c("scf_parameters"),
        "do_shooting": F.lit("yes"), "do_shooting_scf": F.lit("yes"), "scf_has_perturbations": F.lit("yes"), "attractor_ic_scf": F.lit("no"),
    }
    as_map = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])
    return F.map_concat(as_map(pairs), F.when(c("enable_ede"), as_map(early)).otherwise(F.create_map().cast("map<string,string>")))


def auto_name(number: Column) -> Column:
    """`Run 007 — ` and what differs from the defaults: up to two parts, or `Custom Cosmology` (the parts' texts and the
    differences that count are fixed values)."""
    c, d = F.col, DEFAULTS
    parts = F.array_compact(F.array(
        F.when(F.abs(c("A_s") - d["A_s"]) / d["A_s"] > 0.03, F.when(c("A_s") > d["A_s"], "High A_s").otherwise("Low A_s")),
        F.when(F.abs(c("n_s") - d["n_s"]) > 0.01, F.when(c("n_s") > d["n_s"], "Blue Tilt").otherwise("Red Tilt")),
        F.when(c("enable_ede"), F.format_string("EDE f%.2f zc%d", c("f_EDE"), F.round(F.pow(F.lit(10.0), -c("log10_a_c")) - 1.0).cast("bigint"))),
        F.when(F.abs(c("Omega_m") - d["Omega_m"]) > 0.015, F.format_string("Omega_m %.3f", c("Omega_m"))),
    ))
    label = F.when(F.size(parts) == 0, "Baseline LCDM").when(F.size(parts) <= 2, F.array_join(parts, " + ")).otherwise("Custom Cosmology")
    return F.concat(F.format_string("Run %03d — ", number), label)


def short_exponent(x: Column) -> Column:
    """A double as 2.10e-09."""
    return F.format_string("%.2e", x)


def run_label() -> Column:
    """name | status | created | A_s=..., f_EDE=..."""
    c = F.col
    extras = F.concat_ws(", ", F.concat(F.lit("A_s="), short_exponent(c("A_s"))), F.when(c("enable_ede"), F.concat(F.lit("f_EDE="), F.format_string("%.2f", c("f_EDE")))))
    return F.concat_ws(" | ", c("name"), F.coalesce(c("class_status"), F.lit("UNKNOWN")), F.date_format("created_at", "yyyy-MM-dd HH:mm"), extras)


def safe_stem(name: Column, empty: str = "run") -> Column:
    """The name as part of a file name: runs of white space and slashes become one underscore; reserved marks and all that
    isn't printable (controls, format characters such as a zero-width space, unassigned and private ones, other
    separators) go; then underscores at both ends."""
    joined = F.regexp_replace(F.regexp_replace(name, r"^(?U)\s+|\s+$", ""), r"(?U)[\s/\\]+", "_")
    clean = F.regexp_replace(F.regexp_replace(joined, r"[:*?\"<>|\p{C}\p{Z}]", ""), "^_+|_+$", "")
    return F.when(clean == "", empty).otherwise(clean)


def cache_key(version: str = "1") -> Column:
    """20 hex digits over the slow parameters, each as double, boolean or text, so that 0 and 0.0 are one key."""
    kinds = {k: DEFAULTS[k] for k in SLOW_KEYS}
    as_text = lambda k: (
        F.array_join(F.transform(k, lambda z: F.format_string("%.9e", z.cast("double"))), ",") if isinstance(kinds[k], list)
        else F.col(k).cast("string") if isinstance(kinds[k], (bool, str))
        else F.format_string("%.9e", F.col(k).cast("double"))
    )
    return F.substring(F.sha2(F.concat_ws(";", F.lit(version), *[as_text(k) for k in sorted(SLOW_KEYS)]), 256), 1, 20)
