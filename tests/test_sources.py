"""Files written and read back, and files of each format as others write them."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from cinnabar.functions import molecules as M
from cinnabar.operators import curation
from cinnabar.sources import records, tables


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy(columns[0]).select(*columns).collect()]


def put(path, text):
    with gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w") as f:
        f.write(text)
    return str(path)


def test_format_of():
    assert [records.format_of(p) for p in ("a/b.smi", "x.SMILES.gz", "c.rdf", "d.sdf", "e.pb")] == ["smi", "smi", "rdf", "sdf", "ord"]
    for bad in ("a.txt", "noext", "a.gz"):
        with pytest.raises(ValueError):
            records.format_of(bad)


@pytest.mark.parametrize("name", ["a.smi", "a.smi.gz"])
def test_lines_and_fields(spark, tmp_path, name):
    path = put(tmp_path / name, "\nCC>>CO\tx\t\ty \n  \nC>>N name of it\n O \n")
    assert rows(records.smiles(spark, path), "idx", "raw", "smiles", "source") == [(0, "CC>>CO\tx\t\ty", "CC>>CO", ["x", "y"]), (1, "C>>N name of it", "C>>N", ["name of it"]), (2, "O", "O", [])]
    assert records.count_records(spark, path) == 3
    assert rows(records.blocks(records.lines(spark, path), 2), "block", "offset", "items") == [(0, 0, ["CC>>CO\tx\t\ty", "C>>N name of it"]), (1, 2, ["O"])]


def test_places_over_many_splits(spark, tmp_path):
    for i in range(3):
        put(tmp_path / f"part{i}.smi", "".join(f"C{i} {j}\n\n" for j in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = rows(records.lines(spark, f"{tmp_path}/*.smi"), "idx", "raw")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i * 500 + j, f"C{i} {j}") for i in range(3) for j in range(500)]


@pytest.mark.parametrize("name", ["a.csv", "a.csv.gz"])
def test_csv(spark, tmp_path, name):
    path = put(tmp_path / name, 'id,Smiles,note\n1,CC,"a, b"\n2,,x\n3, CO ,\n')
    assert rows(records.csv_smiles(spark, path), "idx", "smiles") == [(0, "CC"), (1, "CO")]
    assert rows(records.csv_smiles(spark, put(tmp_path / "b.tsv", "CC\t1\nCO\t2\n"), header=False, delimiter="\t"), "idx", "smiles") == [(0, "CC"), (1, "CO")]
    for head in ("smiles,SMILES\nC,N\n",):
        assert rows(records.csv_smiles(spark, put(tmp_path / "c.csv", head)), "idx", "smiles") == [(0, "N")]
    with pytest.raises(ValueError, match="ambiguous"):
        records.resolve_column(["smiles", "Smiles"], "SMILES")
    with pytest.raises(ValueError, match="missing"):
        records.resolve_column(["a"], "SMILES")


def test_rdf_and_sdf_blocks(spark, tmp_path):
    rdf = put(tmp_path / "a.rdf", "$RDFILE 1\n$DATM 01/01/00\n$RFMT $RIREG 1\n$RXN\nA\n$MFMT\nB\n$RFMT\n$RXN\nC\n")
    assert rows(records.rdf_blocks(spark, rdf), "idx", "block") == [(0, "$RFMT $RIREG 1\n$RXN\nA"), (1, "$MFMT\nB"), (2, "$RFMT\n$RXN\nC")]
    assert records.count_records(spark, rdf) == 3
    sdf = put(tmp_path / "a.sdf", "one\nx\n$$$$\ntwo\n$$$$\n")
    assert rows(records.sdf_blocks(spark, sdf), "idx", "block") == [(0, "one\nx\n"), (1, "two\n")]
    assert records.count_records(spark, sdf) == 2


def test_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "CC>>CO", {"source_0002": "b", "source_0001": "a\nx", "init_smiles": "q", "k": "v"}), (1, "C>>N", {"z": "2", "a": "1"}), (2, "O>>N", None)], "idx long, smiles string, meta map<string,string>")
    tables.write_records(df, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["CC>>CO\ta;x\tb\tv", "C>>N\t1\t2", "O>>N"]
    info = df.where("meta IS NOT NULL").select("idx", records.source_info(F.col("meta")).alias("s"))
    assert rows(info, "idx", "s") == [(0, "a x;b"), (1, "a=1;z=2")]


def test_rdf_and_sdf_round_trip(spark, tmp_path):
    texts = ["[CH3:1][C:2](=[O:3])[OH:4].[CH3:5][NH2:6]>>[CH3:1][C:2](=[O:3])[NH:6][CH3:5].[OH2:4]", "[CH3:1][Br:2].[OH-:3]>>[CH3:1][OH:3].[Br-:2]"]
    df = spark.createDataFrame([(i, t, {"k": f"v{i}"}) for i, t in enumerate(texts)] + [(2, "bad", None)], "idx long, smiles string, meta map<string,string>")
    tables.write_rdf(df, f"{tmp_path}/r")
    back = tables.parse_blocks(records.rdf_blocks(spark, f"{tmp_path}/r"))
    from cinnabar.functions import reactions as R

    assert [(r.smiles, r.meta, r.error) for r in back.orderBy("idx").collect()] == [(R.write(R.parse(t)), {"k": f"v{i}"}, None) for i, t in enumerate(texts)]
    mols = spark.createDataFrame([(0, "CC(=O)O"), (1, "C[NH3+]"), (2, "c1ccccc1[13CH3]")], "idx long, smiles string")
    tables.write_sdf(mols, f"{tmp_path}/s")
    back = tables.parse_blocks(records.sdf_blocks(spark, f"{tmp_path}/s"))
    assert [M.canonical(r.smiles) for r in back.orderBy("idx").collect()] == [M.canonical(s) for _, s in mols.collect()]
    assert tables.parse_blocks(spark.createDataFrame([("junk",), (None,)], "block string")).where("error IS NULL").count() == 0


def message(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    data = value if isinstance(value, bytes) else value.encode()
    out, n = bytes([number << 3 | 2]), len(data)
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out + data


def compound(role, *identifiers):
    return b"".join(message(1, message(1, kind) + message(3, text)) for kind, text in identifiers) + message(3, role)


def test_protobuf(spark, tmp_path):
    inputs = message(2, message(1, "a") + message(2, message(1, compound(1, (6, "acid"), (2, " CC(=O)O "))) + message(1, compound(3, (7, "water"), (2, "O"))) + message(1, compound(0, (2, "CO")))))
    percentage = bytes([1 << 3 | 5]) + struct.pack("<f", 81.26)
    product = message(1, message(1, 2) + message(3, "CC(=O)OC")) + message(3, message(2, 1)) + message(3, message(2, 3) + message(8, percentage))
    good = inputs + message(8, message(3, product)) + message(10, "ord-1")
    path = tmp_path / "d.pb"
    path.write_bytes(message(1, "set") + b"".join(message(3, m) for m in (good, message(10, "none"), inputs + message(8, message(3, message(1, message(1, 2) + message(3, "C(")))))))
    got = records.ord_reactions(spark, str(path)).collect()
    assert [(r.idx, r.reaction_id, r.smiles, r.meta) for r in got] == [(0, "ord-1", "CC(=O)O.CO>O>CC(=O)OC", {"ord_reaction_id": "ord-1", "ord_yields": "81.3", "ord_solvents": "water"})]
    assert got[0].record == "CC(=O)O.CO>O>CC(=O)OC\tord-1\twater\t81.3" and records.count_records(spark, str(path)) == 3
    for broken in (b"\x0a\xff", b"\x08", b"\x0b"):
        with pytest.raises(ValueError):
            list(records.fields(broken))


def test_rules_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([(1, "[C:1]>>[N:1]", 3, [5, 6]), (0, "[C:1]>>[O:1]", 9, [1, 5, 7]), (2, "bad", 1, [])], "rule_id long, rule_smarts string, popularity long, reaction_indices array<long>")
    tables.write_rules(rules, f"{tmp_path}/r")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()][:2] == ["rule_smarts\tpopularity\treaction_indices", "[C:1]>>[O:1]\t9\t1,5,7"]
    back = tables.read_rules(spark, f"{tmp_path}/r")
    assert rows(back, "rule_id", "rule_smarts", "popularity", "reaction_indices") == [(0, "[C:1]>>[O:1]", 9, [1, 5, 7]), (1, "[C:1]>>[N:1]", 3, [5, 6])]
    assert rows(tables.rule_of_reaction(back), "rxn_idx", "rule_id") == [(1, 0), (5, 1), (6, 1), (7, 0)]
    for at, want in ((1, [1]), (slice(0, 3, 2), [0, 2]), (slice(1, None), [1, 2]), ([2, 0], [0, 2])):
        assert [r[0] for r in rows(tables.select_rules(rules, at), "rule_id")] == want
    pairs = spark.createDataFrame([(7, "CO", 0), (1, "CN", 1)], "rxn_idx long, product_smiles string, rule_id long")
    tables.write_policy(pairs, f"{tmp_path}/p")
    assert [tuple(r) for r in tables.read_policy(spark, f"{tmp_path}/p").collect()] == [("CN", 1), ("CO", 0)]


def test_routes(spark, tmp_path):
    one, two = "[CH3:1][Br:2].[OH2:3]>>[CH3:1][OH:3]", "[CH3:1][OH:3].[CH3:4][C:5](=[O:6])[OH:7]>>[CH3:1][O:3][C:5]([CH3:4])=[O:6]"
    steps = spark.createDataFrame([(4, 1, two, "m,1"), (4, 0, one, None)], "route_id long, step_id int, smiles string, meta string")
    tables.write_routes(steps, f"{tmp_path}/c")
    assert [tuple(r) for r in tables.read_routes(spark, f"{tmp_path}/c").orderBy("step_id").collect()] == [(4, 0, one, None), (4, 1, two, "m,1")]
    trees = tables.route_trees(steps)
    tree = json.loads(trees.first().tree)
    assert tree["smiles"] == M.canonical("COC(C)=O") and [c["in_stock"] for c in tree["children"][0]["children"]] == [False, True]
    assert rows(tables.route_levels(trees), "node", "parent", "level", "type")[:3] == [(0, None, 0, "mol"), (1, 0, 1, "reaction"), (2, 1, 2, "mol")]
    path = put(tmp_path / "t_12.json", json.dumps([tree, {}]))
    got = rows(tables.read_route_trees(spark, path), "step_id", "route_id", "smiles")
    assert [x[:2] for x in got] == [(0, 0), (1, 0)] and tables.route_index(path) == 12 and tables.route_index("x.json") is None


def test_matrix_and_patterns(spark, tmp_path):
    matrix = tables.read_matrix(spark, put(tmp_path / "m.tsv", "\tacid\tAcid\nacid\t0\t2\namine\t1\t0\n"))
    assert sorted(map(tuple, matrix.collect())) == [("acid", "Acid", 2), ("acid", "acid", 0), ("amine", "Acid", 0), ("amine", "acid", 1)]
    yaml = pytest.importorskip("yaml")
    text = yaml.safe_dump({"Acids": [{"name": "acid", "smarts": "C(=O)O"}], "Cl": {"smarts": "[Cl]", "family": "chloride"}})
    assert rows(tables.read_patterns(spark, put(tmp_path / "p.yaml", text)), "place", "name", "category", "smarts") == [(0, "acid", "Acids", "C(=O)O"), (1, "Cl", "chloride", "[Cl]")]


def test_reports(spark, tmp_path):
    errors = spark.createDataFrame([("C(", "a\tb", "parse", "IncorrectSmiles", "x\ny")], "original_smiles string, source_info string, stage string, error_type string, error_message string")
    tables.write_errors(errors, f"{tmp_path}/e")
    assert "C(\ta b\tparse\tIncorrectSmiles\tx y" in [r.value for r in spark.read.text(f"{tmp_path}/e").collect()]
    tables.write_statistics(spark.createDataFrame([("CC", 1)], "target_smiles string, num_routes long"), f"{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").columns == tables.STATISTICS
    summary = spark.createDataFrame([(3, None)], "total_input long, error_file string")
    assert json.loads(tables.summary_json(summary).first().value) == {"total_input": 3, "error_file": None}
    files = spark.createDataFrame([("b", 2, 3), ("a", 1, 1)], "name string, size long, lines long")
    assert len(tables.digest(files).first().digest) == 16 and tables.digest(files).first() == tables.digest(files.orderBy("name")).first()
    once = tables.cached(spark, files, str(tmp_path), "k")
    assert once.count() == tables.cached(spark, files.limit(0), str(tmp_path), "k").count() == 2
    assert "<td>a</td>" in tables.html_table(files, "t & u") and "t &amp; u" in tables.html_table(files, "t & u")


def test_reasons(spark):
    df = spark.createDataFrame([("parse/ValueError: a/b: c",), ("NoReactionFilter",), (None,)], "r string").select(curation.reason_parts(F.col("r")).alias("p")).select("p.*")
    assert [tuple(r) for r in df.collect()] == [("parse", "ValueError", "a/b: c"), (None, None, None), (None, None, None)]
    with pytest.raises(Exception, match="null key"):
        curation.keep_first(spark.createDataFrame([(None, 1)], "k string, i long"), ["k"], "i", strict=True).collect()
