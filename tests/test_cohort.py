import numpy as np
import pytest

from sitelens import cli, schemas
from sitelens.config import Config
from sitelens.operators import alignment, clusters, filters, partitions
from sitelens.plans import cohort
from sitelens.sources import readers, writers

NAMES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()


def cif(seed: int, shift: float, group: str = "P 1", waters=((9.0, 0.0, 0.0),), cell=(100, 100, 100)) -> str:
    r = np.random.default_rng(1)
    rows = []
    for k in range(20):
        x, y, z = r.uniform(0, 15, 3) + shift
        rows.append(("ATOM", k + 1, "C", "CA", ".", NAMES[k], "A", 1, k + 1, "?", f"{x:.3f}", f"{y:.3f}", f"{z:.3f}", "1.00", f"{10 + k}.0", "?", k + 1, NAMES[k], "A", "CA", 1))
    for k, (x, y, z) in enumerate(waters):
        for alt in ("A", "B") if k == 1 else (".",):
            rows.append(("HETATM", 100 + k, "O", "O", alt, "HOH", "D", 2, ".", "?", f"{x + shift:.3f}", f"{y + shift:.3f}", f"{z + shift:.3f}", "0.50", f"{20 + seed + k}.0", "?", 300 + k, "HOH", "A", "O", 1))
    rows.append(("HETATM", 999, "H", "H1", ".", "HOH", "D", 2, ".", "?", "1.0", "1.0", "1.0", "1.0", "9.0", "?", 300, "HOH", "A", "H1", 1))
    tags = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_entity_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv pdbx_formal_charge auth_seq_id auth_comp_id auth_asym_id auth_atom_id pdbx_PDB_model_num".split()
    head = f"data_x\n# note\n_cell.length_a {cell[0]}\n_cell.length_b {cell[1]}\n_cell.length_c {cell[2]}\n_cell.angle_alpha 90\n_cell.angle_beta 90\n_cell.angle_gamma 90\n_symmetry.space_group_name_H-M '{group}'\n_refine.ls_d_res_high 1.{seed}\n_struct.title\n;a long\ntitle _atom_site.x\n;\nloop_\n_pdbx_entity_nonpoly.entity_id\n_pdbx_entity_nonpoly.comp_id\n1 CL\n2 HOH\n3 'NA'\n#\n"
    return head + "loop_\n" + "".join(f"_atom_site.{t}\n" for t in tags) + "\n".join(" ".join(map(str, x)) for x in rows) + "\n#\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("structures")
    near = ((3.0, 3.0, 3.0), (6.0, 6.0, 6.0), (60.0, 60.0, 60.0))
    for k, name in enumerate(("1aaa", "1bbb", "1ccc")):
        (d / name).mkdir()
        (d / name / f"{name}_final.cif").write_text(cif(k, k * 7.0, waters=near))
    (d / "1aaa" / "1aaa_final.json").write_text('[{"compID":"HOH","EDIAm":0.9,"pdb":{"strandID":"A","seqNum":300,"insCode":""}},{"compID":"HOH","EDIAm":0.8,"pdb":{"strandID":"A","seqNum":301}},{"compID":"HOH","EDIAm":0.1,"pdb":{"strandID":"A","seqNum":301}},{"compID":"ALA","EDIAm":0.5}]')
    (d / "1bbb" / "1bbb_final.json").write_text("not json")
    return str(d)


def test_readers(spark, folder):
    atoms, st, scores = cohort.load(spark, folder)
    assert [c.split()[0] for c in schemas.ATOMS.split(", ")] == atoms.columns
    assert {r["pdb_id"]: r["num_water"] for r in filters.count_water_oxygens(atoms).collect()} == {"1aaa": 4, "1bbb": 4, "1ccc": 4}
    s = {r["pdb_id"]: r for r in st.collect()}
    assert s["1aaa"]["space_group"] == "P 1" and s["1ccc"]["resolution"] == 1.2 and s["1aaa"]["nonpoly"] == ["CL", "HOH", "NA"]
    assert scores.count() == 3
    w = readers.waters(atoms, scores).where("pdb_id = '1aaa'").orderBy("atom_ord").collect()
    assert [r["edia"] for r in w] == [0.9, 0.8, 0.1, None] and [r["altloc"] for r in w] == [".", "A", "B", "."]
    m = {r["pdb_id"]: r for r in readers.metadata(st, filters.count_water_oxygens(atoms)).collect()}
    assert m["1aaa"]["ligand_names"] == "CL|NA" and m["1aaa"]["unit_cell_volume"] == 1e6 and m["1aaa"]["num_water"] == 4


def test_filters(spark, folder):
    atoms, st, scores = cohort.load(spark, folder)
    kept, w, report = filters.filter_waters(atoms, st, 8.0)
    r = {x["pdb_id"]: x for x in report.collect()}
    assert all(x["n_waters_before"] == 4 and x["n_waters_removed_by_distance"] + x["n_waters_remaining"] == 4 for x in r.values())
    assert r["1aaa"]["n_waters_removed_by_distance"] == 1
    assert kept.where("element = 'H'").count() == 0 and kept.where("group_pdb = 'ATOM'").count() == 60
    loose = filters.filter_waters(atoms, st, 999.0, scores, float("-inf"), float("inf"))[2].collect()
    assert all(x["n_waters_remaining"] == 4 or x["pdb_id"] == "1aaa" for x in loose)
    drop = filters.filter_waters(atoms, st, 999.0, scores, 0.5, drop_without_scores=True)[2].collect()
    assert {x["pdb_id"]: x["n_waters_remaining"] for x in drop} == {"1aaa": 2, "1bbb": 0, "1ccc": 0}
    with pytest.raises(ValueError):
        filters.population("none")
    with pytest.raises(ValueError):
        filters.keep_bfactor(1.0, "other")
    same = spark.createDataFrame([("a", 5.0), ("a", 5.0)], "pdb_id string, b_factor double")
    ref = filters.with_reference(same, filters.F.lit(True))
    assert ref.where(filters.keep_bfactor(-9.0)).count() == 2 and {x[0] for x in ref.select(filters.zscore()).collect()} == {0.0}


def test_align_cluster_pairs(spark, folder):
    atoms, st, _ = cohort.load(spark, folder)
    moved, report = cohort.align_stage(atoms, "1aaa")
    r = {x["pdb_id"]: x for x in report.collect()}
    assert r["1bbb"]["n_common_ca"] == 20 and r["1bbb"]["rmsd_after"] < 0.01 and r["1bbb"]["rmsd_before"] > 10
    assert moved.count() == atoms.count()
    rows, table = cohort.cluster_stage(moved.where("res_name <> 'HOH' or x < 50"), Config(min_cluster_size=3, min_samples=1), 3)
    assert {x["cluster_occupancy"] for x in table.collect()} == {1.0}
    waters, structures, summary = cohort.cohort_frames(rows, table, readers.metadata(st, filters.count_water_oxygens(atoms)), Config(), "c")
    assert waters.where("group = 'consensus'").count() >= 6 and structures.where("f1 = 1").count() == 3 and "num_water_deposited" in structures.columns
    assert summary.count() == 1
    p = {(x["structure_ref"], x["structure_mobile"]): x for x in alignment.pairwise(atoms, st, 1.0).collect()}
    assert len(p) == 9 and p["1aaa", "1aaa"]["f1"] == 1 and p["1aaa", "1bbb"]["matched_recall"] == 1 and p["1aaa", "1ccc"]["chamfer"] < 0.02 and p["1aaa", "1bbb"]["max_cell_diff"] == 0
    for block in (1, 2):
        assert {(x["structure_ref"], x["structure_mobile"]): (x["f1"], x["rmsd_after"]) for x in alignment.pairwise(atoms, st, 1.0, block).collect()} == {k: (x["f1"], x["rmsd_after"]) for k, x in p.items()}
    few = alignment.align(alignment.ca_trace(atoms.where("res_id < 5")), alignment.ca_trace(atoms.where("pdb_id = '1aaa'")))
    assert few.where("warning is not null and rotation is null").count() == 3


def test_masks(spark):
    c = spark.createDataFrame([(0, 0.8), (1, 0.1)], "cluster_id int, cluster_occupancy double")
    m = spark.createDataFrame([(0, True), (0, False), (1, True), (-1, False)], "cluster_id int, within_cutoff boolean")
    got = [(r["cluster_id"], r["within_cutoff"], r["consensus"]) for r in clusters.consensus_mask(m, c, 0.3).collect()]
    assert sorted(got) == [(-1, False, False), (0, False, False), (0, True, True), (1, True, False)]
    with pytest.raises(ValueError):
        partitions.query_arms(c, "nothing >")


def test_writers(spark, folder, tmp_path):
    text = cif(0, 0.0)
    out = writers.edited_cif(text, set(range(21)), {20: (1.0, 2.0, 3.0)})
    back = readers.atoms_of(readers.parse_cif(out), "x")
    assert len(back) == 21 and back[20][10:13] == (1.0, 2.0, 3.0) and readers.parse_cif(out)["_struct.title"] == ["a long\ntitle _atom_site.x"]
    one = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 1.0, 1.0, 1.0, 0.5, 0)], schemas.CLUSTERS)
    noise = spark.createDataFrame([(-1, False, "1aaa", "A", 1, ".", 0.0, 0.0, 0.0, None, 1.0, None)], schemas.MEMBERS)
    writers.write_cluster_cif(writers.cluster_sites(one, noise, 4), (tmp_path / "c" / "clusters.cif").as_uri())
    c = readers.parse_cif((tmp_path / "c" / "clusters.cif").read_text())
    assert c["_atom_site.auth_asym_id"] == ["A", "B"] and c["_atom_site.b_iso_or_equiv"] == ["1.000", "0.000"] and c["_atom_site.occupancy"] == ["0.500", "0.250"]
    assert writers.report_name(4, 0.5, 1, "zscore", "all") == "filtering_report_4.00A_edia0.50_bfactor_z1.00all.csv"
    for v in ("a b", "it's", 'q"x', "", "loop_", "two\nlines", "_x", None, "data_1"):
        got = readers.parse_cif("data_a\n_t.v " + writers.cif_value(v) + "\n")["_t.v"]
        assert got == ["?" if v is None else v]
    (tmp_path / "list.txt").write_text("# c\n1ABC_final x\n\n 2DEF\n1abc\n")
    assert [(r["pos"], r["pdb_id"]) for r in readers.read_cohorts(spark, str(tmp_path / "list.txt")).orderBy("pos").collect()] == [(1, "1abc"), (3, "2def")]
    assert readers.find_metadata(["a", "a_b"], "a_b_c_d") == "a_b" and readers.find_metadata(["x"], "a_b") is None
    assert writers.cohort_export(["b", "a", "b"], {"tol": 2.0})[0] == "a\nb\n"
    e = spark.createDataFrame([("1aaa", '{"refine":[{"pdbx_starting_model":"PDB entry 1CIL","ls_R_factor_R_work":"?"},{"ls_R_factor_R_work":0.2}],"diffrn":[{"ambient_temp":293},{"ambient_temp":100}],"exptl_crystal_grow":[{"pdbx_pH_range":"4.4-4.8","pdbx_details":" a\\n b "}]}'), ("2bbb", None)], "pdb_id string, entry string")
    r = {x["pdb_id"]: x for x in readers.archive_fields(e).collect()}["1aaa"]
    assert (r["starting_model"], r["deposited_r_work"], r["diffrn_temp"], r["ph"], r["experiment_condition"]) == ("1cil", 0.2, 100.0, "4.4-4.8", "a b")


def test_command_line(spark, folder, tmp_path):
    cli.main(["metadata", folder, str(tmp_path)], spark)
    cli.main(["filter", folder, str(tmp_path), "--distance-cutoff", "8"], spark)
    assert spark.read.csv(str(tmp_path / "metadata.csv"), header=True).count() == 3
    assert spark.read.csv(str(tmp_path / "filtering_report_8.00A.csv"), header=True).count() == 3
    with pytest.raises(ValueError):
        Config.load(None, nothing=1)
    report = spark.read.csv(str(tmp_path / "filtering_report_8.00A.csv"), header=True)
    assert report.columns == ["pdb_id", "n_waters_before", "n_waters_moved", "n_waters_removed_by_distance", "n_waters_remaining"]
    for stage, more in (("filter", ["--edia-cutoff", "0.5", "--drop-if-no-edia-json", "--exclusive-borderline", "--distance-cutoff", "99"]), ("align", ["--reference", "1aaa"]), ("cluster", ["--min-cluster-size", "3", "--min-samples", "1", "--write-cif", "--include-noise"])):
        cli.main([stage, folder, str(tmp_path / stage), *more], spark)
    report = spark.read.csv(str(tmp_path / "filter" / "filtering_report_99.00A_edia0.50.csv"), header=True)
    assert report.columns[-2:] == ["n_waters_remaining", "edia_applied"] and {r["pdb_id"]: r["n_waters_remaining"] for r in report.collect()} == {"1aaa": "2", "1bbb": "0", "1ccc": "0"}
    back = readers.read_atoms(spark, str(tmp_path / "filter"))
    assert {r["pdb_id"]: r["n"] for r in back.groupBy("pdb_id").agg(filters.F.count("*").alias("n")).collect()} == {"1aaa": 22, "1bbb": 20, "1ccc": 20}
    moved, raw = readers.read_atoms(spark, str(tmp_path / "align")), readers.read_atoms(spark, folder)
    assert moved.count() == raw.count()
    first = lambda df, p: df.where(f"pdb_id = '{p}' and atom_name = 'CA'").orderBy("atom_ord").first()["x"]
    assert abs(first(moved, "1bbb") - first(raw, "1aaa")) < 0.01
    cells = readers.parse_cif((tmp_path / "cluster" / "clusters.cif").read_text())
    assert "A" in cells["_atom_site.auth_asym_id"]


def test_texts_are_written_whole_or_not_at_all(spark, tmp_path):
    df = spark.createDataFrame([(f"{k}xyz", f"text {k} é") for k in range(20)], "pdb_id string, cif string").repartition(5)
    folder = (tmp_path / "out").as_uri()
    broken = df.withColumn("cif", filters.F.expr("if(pdb_id = '7xyz', raise_error('lost'), cif)"))
    with pytest.raises(Exception, match="lost"):
        writers.write_texts(broken, folder)
    assert not list((tmp_path / "out").rglob("*"))
    assert writers.write_texts(df, folder) == 20 == writers.write_texts(df, folder)
    assert sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(f"{k}xyz/{k}xyz_final.cif" for k in range(20))
    assert (tmp_path / "out" / "3xyz" / "3xyz_final.cif").read_text() == "text 3 é" and not list((tmp_path / "out").glob(".aside*"))


def test_frames_of_finished_cohorts(spark, tmp_path):
    """Consensus, agreement and summary of two cohorts, one without metadata, by hand."""
    members = "cluster_id,within_cutoff,pdb_id,chain_id,res_id,altloc,x,y,z,b_factor,occupancy,edia\n"
    head = "cluster_id,center_x,center_y,center_z,std_x,std_y,std_z,cluster_occupancy,n_radius_rejected\n"
    for name, far in (("one_iso", 9.0), ("two", 0.2)):
        d = tmp_path / name
        d.mkdir()
        rows = ["0,true,1aaa,A,1,,0.0,0.0,0.0,10.0,1.0,0.9", "0,true,2bbb,A,1,,0.1,0.0,0.0,12.0,1.0,", f"-1,false,2bbb,A,2,,{far},0.0,0.0,30.0,1.0,", "1,true,1aaa,A,3,,50.0,0.0,0.0,20.0,1.0,"]
        (d / "cluster_members.csv").write_text(members + "\n".join(rows) + "\n")
        (d / "clusters.csv").write_text(head + "0,0.05,0.0,0.0,0.05,0.0,0.0,1.0,0\n1,50.0,0.0,0.0,0.0,0.0,0.0,0.5,0\n")
    (tmp_path / "one").mkdir()
    names = [c.split()[0] for c in schemas.METADATA.split(", ")]
    line = lambda **own: ",".join(str(own.get(c, "<missing>")) for c in names)
    (tmp_path / "one" / "metadata.csv").write_text("\n".join([",".join(names), line(pdb_id="1aaa", resolution=1.5, num_water=7), line(pdb_id="2bbb", num_water=8)]) + "\n")
    cli.main(["frames", str(tmp_path), str(tmp_path / "out"), "--cohorts", "one_iso", "two", "--consensus-cutoff", "0.8", "--match-radius", "1.0"], spark)
    read = lambda n: spark.read.csv(str(tmp_path / "out" / f"{n}.csv"), header=True, inferSchema=True)
    waters = read("waters").groupBy("cohort", "group").count().collect()
    assert {(r["cohort"], r["group"]): r["count"] for r in waters} == {(c, g): 2 for c in ("one_iso", "two") for g in ("consensus", "nonconsensus")}
    st = {(r["cohort"], r["pdb_id"]): r for r in read("structures").collect()}
    assert len(st) == 4 and all(r["recall"] == 1 for r in st.values())
    assert st["one_iso", "2bbb"]["precision"] == 0.5 and st["two", "2bbb"]["precision"] == 1 and st["one_iso", "1aaa"]["precision"] == 0.5
    of = lambda k, c: str(st[k][c])
    assert of(("one_iso", "1aaa"), "resolution") == "1.5" and float(of(("one_iso", "1aaa"), "num_water_deposited")) == 7
    assert of(("one_iso", "2bbb"), "resolution") == of(("two", "1aaa"), "resolution") == "<missing>"
    assert read("summary").count() == 2


def test_one_structure_fails_alone(spark):
    rows = []
    for p in ("bad", "none", "nocell", "dry", "far"):
        rows.append((p, 0, "ATOM", "C", "CA", ".", "ALA", "A", 1, "", 0.0, 0.0, 0.0, 1.0, 5.0, 1))
        rows.append((p, 3, "ATOM", "O", "O", ".", "HOH", "A", 9, "", 1.0, 1.0, 1.0, 1.0, 5.0, 1))
        rows.append((p, 4, "HETATM", "C", "C", ".", None, "A", 9, "", 1.0, 1.0, 1.0, 1.0, 5.0, 1))
        if p != "dry":
            rows.append((p, 1, "HETATM", "O", "O", ".", "HOH", "B", 2, "", 9.0, 0.0, 0.0, 1.0, 9.0, 1))
    atoms = spark.createDataFrame(rows, schemas.ATOMS)
    cells = [("bad", "P 99", 10.0), ("none", None, 10.0), ("dry", "P 1", 10.0), ("far", "P 1", 100.0)]
    st = spark.createDataFrame([(p, g, a, a, a, 90.0, 90.0, 90.0, None, None, None, None) for p, g, a in cells], schemas.STRUCTURES)
    kept, _, report = filters.filter_waters(atoms, st, 4.0)
    r = {x["pdb_id"]: (x["n_waters_before"], x["n_waters_moved"], x["n_waters_removed_by_distance"], x["n_waters_remaining"], bool(x["error"])) for x in report.collect()}
    assert r == {"bad": (None, None, None, None, True), "nocell": (None, None, None, None, True), "dry": (0, 0, 0, 0, False), "none": (1, 1, 0, 1, False), "far": (1, 0, 1, 0, False)}
    assert {x["pdb_id"]: x["count"] for x in kept.groupBy("pdb_id").count().collect()} == {"dry": 3, "none": 4, "far": 3}


def test_sources(spark, tmp_path):
    ids = spark.createDataFrame([("1abc",), ("2def",), ("3bad",)], "pdb_id string")

    def fetch(p):
        if p == "3bad":
            raise OSError("no network")
        return None if p == "2def" else "{}"

    assert {r["pdb_id"]: r["entry"] for r in readers.fetch_entries(ids, fetch, wait=0.0).collect()} == {"1abc": "{}", "2def": None, "3bad": None}
    (tmp_path / "e.json").write_text("{}")
    assert readers.rest_fetch((tmp_path / "{pdb_id}.json").as_uri().replace("%7B", "{").replace("%7D", "}"))("e") == "{}"
    assert [r[0] for r in ids.limit(1).select(readers.structure_path("pdb_id", "/d/")).collect()] == ["/d/1abc/1abc_final.cif"]
    names = spark.createDataFrame([("a",), ("a_b",), ("x_y",)], "name string")
    got = readers.cohort_metadata(spark.createDataFrame([("a_b_c",), ("a_c",), ("z",), ("x",)], "cohort string"), names)
    assert {r["cohort"]: r["name"] for r in got.collect()} == {"a_b_c": "a_b", "a_c": "a", "z": None, "x": None}
    (tmp_path / "coh").mkdir()
    head = ",".join(c.split()[0] for c in schemas.METADATA.split(", "))
    (tmp_path / "coh" / "metadata.csv").write_text(head + "\n1abc,P 1" + ",1" * 13 + ",x,y,<missing>,1,2,3\n")
    assert readers.read_metadata(spark, str(tmp_path), "coh_iso").first()["space_group"] == "P 1" and readers.read_metadata(spark, str(tmp_path), "other") is None
    p = spark.createDataFrame([("1abc", "A", 5), ("1abc", "A", 6), ("2def", "A", 1), ("3ghi", "A", -2)], "pdb_id string, chain_id string, res_id int").withColumn("atom_ord", filters.F.monotonically_increasing_id())
    assert sorted((r["pdb_id"], r["res_id"], r["offset"]) for r in readers.renumbered(p).collect()) == [("1abc", 1, 4), ("1abc", 2, 4), ("2def", 1, 0), ("3ghi", -2, 0)]


def test_stream(spark, folder, tmp_path):
    from sitelens.streaming.ingest import ingest

    for _ in range(2):
        ingest(spark, folder, str(tmp_path / "t"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 75
