"""Whole jobs on small files, and scans of routes."""

import json

from cinnabar import cli
from cinnabar.operators import quality
from cinnabar.operators import reactions as O

ESTERS = [f"[CH3:1][C:2](=[O:3])[OH:4].{''.join(f'[CH2:{10 + i}]' if i else '[CH3:10]' for i in range(n))}[OH:40]>>{''.join(f'[CH2:{10 + i}]' if i else '[CH3:10]' for i in range(n))}[O:40][C:2](=[O:3])[CH3:1]" for n in range(4, 8)]


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_curation_jobs(spark, tmp_path):
    source = tmp_path / "in.smi"
    source.write_text("\n".join([f"{ESTERS[0]}\tone", f"{ESTERS[1]}\ttwo", f"{ESTERS[0]}\tagain", "bad>>\tx", "C(C)(C)(C)(C)C>>CC\ty", "[CH3:1][OH:2]>>[CH3:1][OH:2]"]))
    cli.main(["standardize", str(source), f"{tmp_path}/s", "--steps", "check_valence", "kekulize", "aromatize"])
    out = lines(spark, f"{tmp_path}/s/records")
    assert [x.split("\t")[1:] for x in out] == [["one"], ["two"], []]
    errors = [x.split("\t") for x in lines(spark, f"{tmp_path}/s/errors") if not x.startswith("original_smiles")]
    assert sorted((e[1], e[2], e[3]) for e in errors) == [("x", "parse", "IncorrectSmiles"), ("y", "CheckValence", "ValueError")]
    assert json.loads(lines(spark, f"{tmp_path}/s/summary")[0]) == {"total_input": 6, "succeeded": 3, "filtered": 0, "errored": 2, "duplicates": 1}
    cli.main(["filter", str(source), f"{tmp_path}/f", "--filters", "NoReactionFilter"])
    assert len(lines(spark, f"{tmp_path}/f/records")) == 3 and [json.loads(x)["reason"] for x in lines(spark, f"{tmp_path}/f/rejections")] == ["NoReactionFilter"]


def test_mining_and_planning_jobs(spark, tmp_path):
    (tmp_path / "in.smi").write_text("\n".join(ESTERS))
    cli.main(["extract", f"{tmp_path}/in.smi", f"{tmp_path}/m", "--min-popularity", "2"])
    head, *rules = lines(spark, f"{tmp_path}/m/rules")
    assert head == "rule_smarts\tpopularity\treaction_indices" and [r.split("\t")[1:] for r in rules] == [["4", "0,1,2,3"]]
    assert [x.split("\t")[1] for x in lines(spark, f"{tmp_path}/m/policy")[1:]] == ["0"] * 4
    (tmp_path / "blocks.csv").write_text("id,smiles\n1,OCCCCCCCCC\n2,bad(\n3,C(=O)(O)C\n")
    cli.main(["stock", f"{tmp_path}/blocks.csv", f"{tmp_path}/stock"])
    assert sorted(lines(spark, f"{tmp_path}/stock")) == ["CC(=O)O", "CCCCCCCCCO"]
    (tmp_path / "targets.smi").write_text("CC(=O)OCCCCCCCCC\nCCCCCCCCCCC\n")
    cli.main(["plan", f"{tmp_path}/targets.smi", f"{tmp_path}/p", "--rules", f"{tmp_path}/m/rules", "--stock", f"{tmp_path}/stock", "--iterations", "5"])
    assert [(r.target_id, r.step_id, r.smiles, r.rule_id) for r in spark.read.parquet(f"{tmp_path}/p/routes").collect()] == [(0, 0, "CC(=O)O.CCCCCCCCCO>>CCCCCCCCCOC(C)=O", 0)]
    stats = spark.read.option("header", True).csv(f"{tmp_path}/p/statistics").orderBy("target_smiles").collect()
    assert [(r.num_routes, r.solved) for r in stats] == [("1", "true"), ("0", "false")]


def test_scan_of_routes(spark):
    # a bromide reacts beside a bromide, a chloride and an amine that stand elsewhere
    step = "[CH3:1][CH:2]([Br:3])[CH2:4][CH2:5][Br:6].[OH2:7]>>[CH3:1][CH:2]([OH:7])[CH2:4][CH2:5][Br:6].[BrH:3]"
    amide = "[CH3:1][C:2](=[O:3])[OH:4].[NH2:5][CH2:6][CH2:7][Cl:8]>>[CH3:1][C:2](=[O:3])[NH:5][CH2:6][CH2:7][Cl:8].[OH2:4]"
    steps = spark.createDataFrame([(1, 0, step), (1, 1, amide), (2, 0, "bad"), (3, 0, None)], "route_id long, step_id int, smiles string")
    groups = spark.createDataFrame([(0, "acid", "x", "[C;$(C(=O)[O;D1])]"), (1, "bromide", "x", "[Br][C]"), (2, "chloride", "x", "[Cl][C]"), (3, "alcohol", "x", "[O;D1][C;X4]")], "place int, name string, category string, smarts string")
    halogens = spark.createDataFrame([(0, "Br", "bromide", "[Br][C]"), (1, "Cl", "chloride", "[Cl][C]")], "place int, name string, category string, smarts string")
    scanned = O.scan_steps(steps, groups, halogens).orderBy("route_id", "step_id").collect()
    assert [(r.route_id, r.step_id, r.reacting_fg, [c.fg_name for c in r.competing], r.halogens) for r in scanned] == [(1, 0, "bromide", ["bromide"], 0), (1, 1, "acid", ["chloride"], 0)]
    matrix = spark.createDataFrame([("bromide", "bromide", 2), ("chloride", "acid", 1)], "competing_fg string, reacting_fg string, level int")
    found = O.interactions(O.scan_steps(steps, groups, halogens), matrix)
    assert sorted((r.step_id, r.fg_name, r.severity) for r in found.collect()) == [(0, "bromide", "incompatible"), (1, "chloride", "competing")]
    routes = spark.createDataFrame([(1, 4), (2, 2), (5, 0)], "route_id long, n_steps long")
    hal = spark.createDataFrame([(2, 0.5), (5, 0.25)], "route_id long, halogens double")
    scores = {r.route_id: r.score for r in quality.competing_sites(routes, found, hal).collect()}
    assert scores == {1: 0.625, 2: 0.75, 5: 0.75}
    ranked = quality.rank_routes(spark.createDataFrame([(1, 4.0), (2, 4.0), (9, 8.0), (5, -1.0)], "route_id long, original double"), quality.competing_sites(routes, found, hal), 0.5)
    assert [(r.route_id, r.site_score, r.combined, r.place) for r in ranked.orderBy("place").collect()] == [(2, 0.75, 0.625, 1), (1, 0.625, 0.5625, 2), (9, 0.0, 0.5, 3), (5, 0.75, 0.3125, 4)]


def test_labels_of_rules(spark):
    rules = spark.createDataFrame([(4, "[c:1]-[c:2]>>[c:1]Br.[c:2]B(O)O"), (7, "[N:1]>>[O:1]")], "rule_id long, rule_smarts string")
    mols = spark.createDataFrame([("Cc1ccc(cc1)-c1ccc(C)cc1",), ("CCN",), ("bad(",)], "smiles string")
    assert [(r.applied, r.priority) for r in O.rule_labels(mols, "smiles", rules).collect()] == [([4], [4]), ([7], []), (None, None)]


def test_features(spark):
    out = {r.smiles: r for r in O.features(spark.createDataFrame([("CO",), ("C",), ("c1ccccc1",), ("[Pd]Cl",), (None,)], "smiles string")).collect()}
    assert [list(x) for x in out["CO"].x] == [[6, 2, 14, 2, 2, 3, 0, 1, 1, 0, 0], [8, 2, 16, 4, 2, 1, 0, 1, 1, 0, 0]]
    assert [(e.s, e.t) for e in out["CO"].edge_index] == [(0, 1), (1, 0)] and [list(a) for a in out["CO"].edge_attr] == [[1.0, 0.0, 0.0, 0.0]] * 2
    assert out["C"].x is None and out[None].x is None and len(out["c1ccccc1"].x) == 6 and list(out["[Pd]Cl"].x[0])[:5] == [46, 5, 10, 10, 3]
    assert [O.place(e) for e in ("H", "He", "Na", "Fe", "La", "Ce", "Hf", "Au", "I")] == [(1, 1), (1, 18), (3, 1), (4, 8), (6, 3), (6, 0), (6, 4), (6, 11), (5, 17)]
    assert [O.shell(e) for e in ("H", "He", "C", "Cl", "Cr", "Fe", "Pd", "Br")] == [(1, 1), (1, 2), (2, 2), (2, 5), (1, 1), (1, 2), (3, 10), (2, 5)]
