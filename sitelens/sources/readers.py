"""Readers: cohort lists, mmCIF structures, quality scores, archive entries, CSV tables. Files are read by Spark only."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as s

MISSING = "<missing>"


def cohort_ids(lines: DataFrame, keys: list[str] = ("cohort",)) -> DataFrame:
    """(keys, pos, pdb_id) of list lines (keys, pos, line): the first token, cut at '_', lower case; the first of repeats stays."""
    token = F.get(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), F.lit(0))
    d = lines.withColumn("pdb_id", F.lower(F.substring_index(token, "_", 1))).where(~F.coalesce(F.trim("line"), F.lit("")).startswith("#") & (F.coalesce(F.col("pdb_id"), F.lit("")) != ""))
    return d.groupBy(*keys, "pdb_id").agg(F.min("pos").alias("pos")).select(*keys, "pos", "pdb_id")


def read_cohorts(spark: SparkSession, path: str) -> DataFrame:
    """All list files under a path: (cohort, pos, pdb_id); the cohort is the file's name without its ending."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("cohort"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    return cohort_ids(t)


def structure_path(pdb_id: Column | str, folder: str, template: str = "{pdb_id}/{pdb_id}_final.cif") -> Column:
    c = F.col(pdb_id) if isinstance(pdb_id, str) else pdb_id
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.replace(F.lit(template), F.lit("{pdb_id}"), c))


_TOKEN = re.compile(r"""'(?:[^'\n]|'(?=\S))*'|"(?:[^"\n]|"(?=\S))*"|#[^\n]*|[^\s]+""")


def cif_tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(value, quoted) of a CIF document; text fields between lines that start with ';' are one value."""
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        if lines[i].startswith(";"):
            body = [lines[i][1:]]
            i += 1
            while i < len(lines) and not lines[i].startswith(";"):
                body.append(lines[i])
                i += 1
            yield "\n".join(body).rstrip("\r"), True
            rest = lines[i][1:] if i < len(lines) else ""
        else:
            rest = lines[i]
        for m in _TOKEN.finditer(rest):
            t = m[0]
            if t[0] == "#":
                continue
            if t[0] in "'\"" and len(t) > 1 and t[-1] == t[0]:
                yield t[1:-1], True
            else:
                yield t, False
        i += 1


def parse_cif(text: str) -> dict[str, list[str]]:
    """Tag (lower case) to its values, of the first data block; loops give columns, scalars one value."""
    out: dict[str, list[str]] = {}
    tags: list[str] | None = None
    values: list[str] = []
    name, blocks = None, 0

    def close() -> None:
        nonlocal tags, values
        if tags:
            for k, t in enumerate(tags):
                out[t] = values[k :: len(tags)]
        tags, values = None, []

    looping = False
    for t, quoted in cif_tokens(text):
        low = t.lower()
        if not quoted and low.startswith("data_"):
            close()
            blocks += 1
            if blocks > 1:
                return out
        elif not quoted and low == "loop_":
            close()
            tags, looping = [], True
        elif not quoted and t.startswith("_"):
            if looping and tags is not None and not values:
                tags.append(low)
            else:
                close()
                looping, name = False, low
        elif tags is not None:
            values.append(t)
        elif name is not None:
            out.setdefault(name, []).append(t)
            name = None
    close()
    return out


def _num(v, kind=float):
    try:
        x = kind(re.sub(r"\(\d+\)$", "", v))
    except (TypeError, ValueError):
        return None
    return x if x == x else None


def atoms_of(cif: dict[str, list[str]], pdb_id: str) -> list[tuple]:
    """Atom rows of model 1, all alternative locations, with the author's chain and residue ids."""
    col = lambda name, other="": cif.get(f"_atom_site.{name}") or cif.get(f"_atom_site.{other}")
    x = col("cartn_x")
    if not x:
        return []
    n = len(x)
    get = lambda *names: next((cif[f"_atom_site.{k}"] for k in names if f"_atom_site.{k}" in cif), [None] * n)
    group, element, name, alt = get("group_pdb"), get("type_symbol"), get("auth_atom_id", "label_atom_id"), get("label_alt_id")
    comp, chain, seq, ins = get("auth_comp_id", "label_comp_id"), get("auth_asym_id", "label_asym_id"), get("auth_seq_id", "label_seq_id"), get("pdbx_pdb_ins_code")
    y, z, occ, b, model = get("cartn_y"), get("cartn_z"), get("occupancy"), get("b_iso_or_equiv"), get("pdbx_pdb_model_num")
    first = next((m for m in model if m is not None), None)
    rows = []
    for i in range(n):
        if model[i] is not None and model[i] != first:
            continue
        code = "" if ins[i] in (None, "?", ".") else ins[i].strip()
        rows.append((pdb_id, i, group[i], element[i], name[i], alt[i], comp[i], chain[i], _num(seq[i], int), code, _num(x[i]), _num(y[i]), _num(z[i]), _num(occ[i]), _num(b[i]), _num(model[i], int)))
    return rows


def structure_of(cif: dict[str, list[str]], pdb_id: str) -> tuple:
    """Scalars of a structure; the first value that is a number counts."""
    number = lambda tag: next((v for v in map(_num, cif.get(tag, [])) if v is not None), None)
    group = (cif.get("_symmetry.space_group_name_h-m") or cif.get("_space_group.name_h-m_alt") or [None])[0]
    return (
        pdb_id, None if group in (None, "?", ".") else group, *(number(f"_cell.length_{k}") for k in "abc"), *(number(f"_cell.angle_{k}") for k in ("alpha", "beta", "gamma")),
        number("_refine.ls_d_res_high"), number("_refine.ls_r_factor_r_work"), number("_refine.ls_r_factor_r_free"), [v for v in cif.get("_pdbx_entity_nonpoly.comp_id", []) if v not in ("?", ".")],
    )


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.lower(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"(_final)?\.[^.]*$", "")).alias("pdb_id"), F.make_valid_utf8("value").alias("value"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.cif") -> DataFrame:
    """(pdb_id, value): the whole text of each file below a path; bytes that are no UTF-8 become U+FFFD."""
    return _files(spark, path, pattern)


def atoms_from(texts: DataFrame) -> DataFrame:
    """Atoms of (pdb_id, value) structure texts."""

    def run(it):
        for pdf in it:
            for p, v in zip(pdf["pdb_id"], pdf["value"], strict=True):
                yield pd.DataFrame(atoms_of(parse_cif(v), p.lower()), columns=[c.split()[0] for c in schemas.ATOMS.split(", ")])

    return texts.select("pdb_id", "value").mapInPandas(run, schemas.ATOMS)


def structures_from(texts: DataFrame) -> DataFrame:
    """Scalars of (pdb_id, value) structure texts."""

    def run(it):
        for pdf in it:
            yield pd.DataFrame([structure_of(parse_cif(v), p.lower()) for p, v in zip(pdf["pdb_id"], pdf["value"], strict=True)], columns=[c.split()[0] for c in schemas.STRUCTURES.split(", ")])

    return texts.select("pdb_id", "value").mapInPandas(run, schemas.STRUCTURES)


def read_atoms(spark: SparkSession, path: str, pattern: str = "*.cif") -> DataFrame:
    """Atoms of all structure files below a path; the id is the file's name without ``_final``."""
    return atoms_from(read_texts(spark, path, pattern))


def read_structures(spark: SparkSession, path: str, pattern: str = "*.cif") -> DataFrame:
    return structures_from(read_texts(spark, path, pattern))


_SCORE_JSON = "array<struct<compID:string,EDIAm:double,pdb:struct<strandID:string,seqNum:int,insCode:string>>>"


def scores_of(files: DataFrame) -> DataFrame:
    """Water scores of (pdb_id, value) JSON texts in file order; unreadable texts give none."""
    d = files.select("pdb_id", F.posexplode(F.from_json("value", _SCORE_JSON)).alias("pos", "e")).where(F.col("e.compID").isin("HOH", "WAT"))
    return d.select(F.lower("pdb_id").alias("pdb_id"), "pos", F.col("e.pdb.strandID").alias("chain_id"), F.col("e.pdb.seqNum").alias("res_id"), s.insertion_code("e.pdb.insCode").alias("ins_code"), s.finite("e.EDIAm").alias("score"))


def read_scores(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    return scores_of(_files(spark, path, pattern))


def last_scores(scores: DataFrame, keys: list[str] = ("pdb_id", "chain_id", "res_id", "ins_code"), pos: str = "pos", score: str = "score") -> DataFrame:
    """One score per key: the last in file order."""
    return scores.groupBy(*keys).agg(F.max_by(score, pos).alias(score))


def waters(atoms: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Water oxygens with edia (NULL without scores), paired in order."""
    from ..operators.filters import attach_in_order, is_water_oxygen

    w = atoms.where(is_water_oxygen())
    if scores is None:
        w = w.withColumn("edia", F.lit(None).cast("double"))
    else:
        w = attach_in_order(w, scores.withColumnRenamed("score", "edia"), ["pdb_id", "chain_id", "res_id", "ins_code"], "atom_ord", "pos", "edia")
    return w.select("pdb_id", "chain_id", "res_id", "altloc", "x", "y", "z", "b_factor", "occupancy", "edia", "atom_ord")


def renumbered(protein: DataFrame) -> DataFrame:
    """Residues shifted so that the first is 1, where it lies above 1; column ``offset``."""
    first = protein.groupBy("pdb_id").agg((F.min_by("res_id", "atom_ord") - 1).alias("offset"))
    return protein.join(first, "pdb_id").withColumn("offset", F.greatest("offset", F.lit(0))).withColumn("res_id", F.col("res_id") - F.col("offset"))


def archive_fields(entries: DataFrame, column: str = "entry") -> DataFrame:
    """(pdb_id, status, starting_model, deposited_r_work, deposited_r_free, diffrn_temp, ph, crystal_grow_temp, experiment_condition) of JSON entries."""
    d = entries.select("pdb_id", F.from_json(column, schemas.ARCHIVE_ENTRY).alias("e"))
    status, model = s.starting_model(F.col("e.pdbx_initial_refinement_model.accession_code"), F.col("e.refine.pdbx_starting_model"))
    return d.select(
        "pdb_id", status.alias("starting_model_status"), model.alias("starting_model"),
        s.first_number("e.refine.ls_R_factor_R_work").alias("deposited_r_work"), s.first_number("e.refine.ls_R_factor_R_free").alias("deposited_r_free"),
        s.least_number("e.diffrn.ambient_temp").alias("diffrn_temp"), s.growth_ph("e.exptl_crystal_grow.pH", "e.exptl_crystal_grow.pdbx_pH_range").alias("ph"),
        s.first_number("e.exptl_crystal_grow.temp").alias("crystal_grow_temp"), s.joined_details("e.exptl_crystal_grow.pdbx_details").alias("experiment_condition"),
    )


def rest_fetch(template: str, timeout: float = 30.0):
    """A function id -> JSON text by a GET of the template's address; None where there is no such entry (404)."""

    def fetch(pdb_id: str) -> str | None:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(template.replace("{pdb_id}", pdb_id), timeout=timeout) as r:
                return r.read().decode()
        except HTTPError as e:
            if e.code == 404:
                return None
            raise

    return fetch


def fetch_entries(ids: DataFrame, fetch, tries: int = 3, wait: float = 2.0) -> DataFrame:
    """(pdb_id, entry) by a function id -> JSON text or None (``rest_fetch``), with some tries each; the default source is a
    folder of files. An entry that fails every time is NULL, with a warning."""

    def run(it):
        import time

        for pdf in it:
            rows = []
            for p in pdf["pdb_id"]:
                text = None
                for k in range(tries):
                    try:
                        text = fetch(p)
                        break
                    except OSError:
                        if k == tries - 1:
                            warnings.warn(f"no entry for {p}", stacklevel=1)
                        else:
                            time.sleep(wait)
                rows.append((p, text))
            yield pd.DataFrame(rows, columns=["pdb_id", "entry"])

    return ids.select("pdb_id").mapInPandas(run, "pdb_id string, entry string")


def metadata(structures: DataFrame, counts: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """The metadata table: scalars, cell volume, water counts, ligands and, where there are entries, archive fields."""
    rad = lambda c: F.cos(F.radians(F.col(c)))
    ca, cb, cg = rad("cell_alpha"), rad("cell_beta"), rad("cell_gamma")
    volume = F.col("cell_a") * F.col("cell_b") * F.col("cell_c") * F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)
    d = structures.join(counts, "pdb_id", "left").withColumns({"unit_cell_volume": F.round(volume, 2), "ligand_names": s.ligand_names("nonpoly"), "num_water": F.coalesce("num_water", F.lit(0)).cast("long")})
    names = [c.split()[0] for c in schemas.METADATA.split(", ")]
    if entries is not None:
        d = d.join(archive_fields(entries).drop("starting_model_status"), "pdb_id", "left")
    have = set(d.columns)
    types = {c.split()[0]: c.split()[1] for c in schemas.METADATA.split(", ")}
    return d.select(*[F.col(c) if c in have else F.lit(None).cast(types[c]).alias(c) for c in names])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with an explicit schema, so no id turns into a number; the missing mark is NULL."""
    return spark.read.csv(path, schema=schema, header=True, nullValue=MISSING)


def find_metadata(names: list[str], cohort: str) -> str | None:
    """The longest of the names that the cohort equals or extends by '_' tokens."""
    at = cohort
    while at:
        if at in names:
            return at
        at = at.rpartition("_")[0]
    return None


def cohort_metadata(cohorts: DataFrame, tables: DataFrame) -> DataFrame:
    """(cohort, name) of the longest table name that each cohort equals or extends by '_' tokens; NULL without any."""
    parts = F.split("cohort", "_")
    prefixes = cohorts.select("cohort", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))).alias("name"))
    found = prefixes.join(tables.select("name").distinct(), "name").groupBy("cohort").agg(F.max_by("name", F.length("name")).alias("name"))
    return cohorts.select("cohort").distinct().join(found, "cohort", "left")


def read_metadata(spark: SparkSession, folder: str, cohort: str) -> DataFrame | None:
    """The metadata table of ``<folder>/<name>/metadata.csv`` for the longest name that fits the cohort."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.csv").format("binaryFile").load(folder)
    names = [r["name"] for r in found.select(F.element_at(F.split("path", "/"), -2).alias("name")).distinct().collect()]
    name = find_metadata(names, cohort)
    return None if name is None else read_csv(spark, f"{folder.rstrip('/')}/{name}/metadata.csv", schemas.METADATA)
