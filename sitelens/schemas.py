"""Schemas of the engine's tables. A missing value is NULL; NaN never enters."""

from __future__ import annotations

ATOMS = (
    "pdb_id string, atom_ord int, group_pdb string, element string, atom_name string, altloc string, res_name string, "
    "chain_id string, res_id int, ins_code string, x double, y double, z double, occupancy double, b_factor double, model_num int"
)
STRUCTURES = (
    "pdb_id string, space_group string, cell_a double, cell_b double, cell_c double, cell_alpha double, cell_beta double, "
    "cell_gamma double, resolution double, r_work double, r_free double, nonpoly array<string>"
)
SCORES = "pdb_id string, pos int, chain_id string, res_id int, ins_code string, score double"
METADATA = (
    "pdb_id string, space_group string, cell_a double, cell_b double, cell_c double, cell_alpha double, cell_beta double, cell_gamma double, "
    "unit_cell_volume double, resolution double, r_work double, r_free double, deposited_r_work double, deposited_r_free double, num_water long, "
    "ligand_names string, experiment_condition string, ph string, crystal_grow_temp double, diffrn_temp double, starting_model string"
)
MEMBERS = (
    "cluster_id int, within_cutoff boolean, pdb_id string, chain_id string, res_id int, altloc string, x double, y double, z double, "
    "b_factor double, occupancy double, edia double"
)
CLUSTERS = "cluster_id int, center_x double, center_y double, center_z double, std_x double, std_y double, std_z double, cluster_occupancy double, n_radius_rejected long"
ARCHIVE_ENTRY = (
    "struct<refine:array<struct<pdbx_starting_model:string,ls_R_factor_R_work:string,ls_R_factor_R_free:string>>,"
    "pdbx_initial_refinement_model:array<struct<accession_code:string>>,diffrn:array<struct<ambient_temp:string>>,"
    "exptl_crystal_grow:array<struct<pH:string,pdbx_pH_range:string,temp:string,pdbx_details:string>>>"
)
