import gzip

import pytest
from pyspark.sql import functions as F

from sitelens import cli
from sitelens.sources import readers, structure_format

TAGS = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv".split()


def text(k, n):
    loop = "loop_\n" + "".join(f"_atom_site.{x}\n" for x in TAGS) + "".join(f"HETATM {i} O O . HOH A {i} {k} {i}.5 2.25(3) 1.0 {'?' if i % 3 else i}\n" for i in range(n))
    return f"data_x\n_cell.length_a {10 + k}\n_symmetry.space_group_name_H-M 'P 1'\n_refine.ls_d_res_high 1.{k}\n" + (loop if n else "")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("structures")
    for k in range(9):
        own = d / f"{k}abc"
        own.mkdir()
        (own / f"{k}ABC_final.cif").write_text(text(k, k % 4 * 5))
    (d / "empty.cif").write_text("")
    (d / "bad.cif").write_bytes(b"data_x\n_cell.length_a \xff\xfe 3\nloop_\n_atom_site.id\n1 2 3")
    (d / "packed.cif.gz").write_bytes(gzip.compress(text(7, 3).encode()))
    for name in ("_hidden.cif", ".aside/x.cif", "other.txt"):
        (d / name).parent.mkdir(exist_ok=True)
        (d / name).write_text(text(1, 2))
    return str(d)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_same_rows_as_the_texts(spark, folder):
    whole = structure_format.read_whole(spark, folder)
    texts = readers.read_texts(spark, folder).where("pdb_id not in ('_hidden', 'x')")
    assert rows(structure_format.atoms_in(whole)) == rows(readers.atoms_from(texts))
    assert rows(structure_format.structures_in(whole)) == rows(readers.structures_from(texts))
    read = spark.read.format("structure_files")
    assert rows(read.option("table", "atoms").load(folder)) == rows(readers.atoms_from(texts))
    assert rows(spark.read.format("structure_files").option("table", "structures").load(folder)) == rows(readers.structures_from(texts))
    assert whole.where("pdb_id = '0abc'").first()["atoms"] == [] and whole.where("pdb_id = 'empty'").count() == 0


def test_filters_beside_whole_rows(spark, folder):
    """Scans of one frame with different filters don't touch each other."""
    whole = structure_format.read_whole(spark, folder).select("pdb_id", "cell_a")
    one = whole.where("pdb_id = '3abc'")
    assert one.union(whole).count() == whole.union(one).count() == 11 and (whole.count(), one.count(), whole.count()) == (10, 1, 10)
    assert whole.crossJoin(one.select(F.col("cell_a").alias("b"))).where("cell_a <= b").count() == 4


def test_ids_choose_the_files(spark, folder, tmp_path):
    (tmp_path / "list.txt").write_text("# a cohort\n1ABC x\n\n 3abc_final\n_\n1abc\nnone\n")
    names = lambda **o: sorted(r["pdb_id"] for r in spark.read.format("structure_files").options(**o).load(folder).select("pdb_id").collect())
    structure_format.register(spark)
    assert names(ids="2abc, 1ABC,none") == ["1abc", "2abc"] and names(ids="") == []
    few = structure_format.read_whole(spark, folder, str(tmp_path / "list.txt"))
    assert rows(few) == rows(structure_format.read_whole(spark, folder).where("pdb_id in ('1abc', '3abc')"))
    ids = {r["pdb_id"] for r in readers.read_cohorts(spark, str(tmp_path / "list.txt")).collect()}
    assert ids == {"1abc", "3abc", "none"} and names(cohort=str(tmp_path)) == ["1abc", "3abc"]
    assert names(cohort=str(tmp_path / "list.txt"), ids="3abc,4abc") == ["3abc"]
    reader = structure_format.StructureFiles({"path": folder, "partition_bytes": "1", "cohort": str(tmp_path / "list.txt")}).reader(few.schema)
    assert [[i for _, i in p.files] for p in reader.partitions()] == [["1abc"], ["3abc"]]


def test_columns_partitions_and_patterns(spark, folder, tmp_path):
    structure_format.register(spark)
    read = lambda **o: spark.read.format("structure_files").options(**o)
    few = read(table="atoms").schema("z double, pdb_id string").load(folder)
    assert few.columns == ["z", "pdb_id"] and rows(few) == rows(read(table="atoms").load(folder).select("z", "pdb_id"))
    assert few.agg(F.max("z")).first()[0] == 2.25
    cells = read().schema("cell_a double").load(folder)
    assert rows(cells) == rows(read().load(folder).select("cell_a"))
    with pytest.raises(Exception, match="no column nothing"):
        read(table="atoms").schema("nothing int").load(folder).collect()
    with pytest.raises(Exception, match="is none of"):
        read(table="bonds").load(folder)
    assert read(partition_bytes=1).load(folder).rdd.getNumPartitions() == 10
    assert read().load(folder).rdd.getNumPartitions() == 1
    assert rows(read(partition_bytes=1).load(folder)) == rows(read().load(folder))
    packed = read(pattern="*.cif.gz").load(folder).first()
    assert packed["pdb_id"] == "packed" and packed["cell_a"] == 17.0 and len(packed["atoms"]) == 3
    assert read().load(f"{folder}/3abc/3ABC_final.cif").first()["pdb_id"] == "3abc"
    (tmp_path / "none").mkdir()
    assert read().load(str(tmp_path / "none")).collect() == []


def test_command_line_of_a_cohort(spark, folder, tmp_path):
    (tmp_path / "list.txt").write_text("1abc\n3abc\n")
    cli.main(["metadata", folder, str(tmp_path / "out"), "--cohort", str(tmp_path / "list.txt")], spark)
    got = spark.read.csv(str(tmp_path / "out" / "metadata.csv"), header=True)
    assert {r["pdb_id"]: r["num_water"] for r in got.collect()} == {"1abc": "5", "3abc": "15"}
