"""Schemas of the stored tables."""

from __future__ import annotations

#: Masses in h^-1 solar masses (m_h) or solar masses (m = m_h / h), k in 1/Mpc, P in Mpc^3, hmf in h^3/Mpc^3.
POWER = "run_id bigint, z double, k double, p double"
GROWTH = "run_id bigint, z double, growth double"
SIGMA = "run_id bigint, window_type string, z double, m_h double, m double, r double, sigma double, dlns double"
HMF = "run_id bigint, window_type string, z double, fit string, m_h double, m double, sigma double, hmf double, n_gt_m double"
CURVES = "metric string, run_id bigint, window_type string, fit string, z double, x double, y double"
CELLS = "run_id bigint, ix int, iy int, delta double"
MODES = "mode_id bigint, kk double, re double, im double"

PARAMS = (
    "struct<A_s: double, n_s: double, k_pivot: double, H0: double, Omega_m: double, Omega_b: double, Omega_k: double, N_eff: double, Tcmb: double, tau_reio: double, "
    "enable_ede: boolean, f_EDE: double, log10_a_c: double, n_EDE: int, scf_parameters: string, k_min: double, k_max: double, k_points: int, quad_limit: int, "
    "window_type: string, fitting: string, delta_halo: double, delta_c: double, mass_min_exp: double, mass_max_exp: double, mass_points: int, selected_mass_exp: double, "
    "single_z: double, z_presets_selected: array<double>, z_values: array<double>, custom_z_list: string, mode: string>"
)
DERIVED = "struct<h: double, Omega_cdm: double, Omega_r: double, Omega_de: double, rho_crit: double, rho0: double, a_c: double, z_c: double>"
#: A stored run document; run_name is an older alias of name.
RUN = (
    "run_id string, name string, run_name string, color string, created_at timestamp, updated_at timestamp, notes string, visible boolean, is_baseline boolean, "
    f"class_status string, class_error string, sigma8 double, rho0 double, window_type string, hash string, arrays_file string, params {PARAMS}, derived {DERIVED}, "
    "class_settings map<string,string>, exports map<string,string>"
)
