"""The commands from files to reports."""

import random

import pytest

from cladeforge.engine import Database
from cladeforge.__main__ import main


def write_genomes(folder, rng):
    root = "".join(rng.choice("ACGT") for _ in range(200))
    seqs = {}
    for i in range(4):
        seqs[f"g{i}"] = root + "".join(rng.choice("ACGT") for _ in range(400))
        (folder / f"g{i}.fna").write_text(f">ACC{i}|taxid|{10 + i}| x\n" + "\n".join(seqs[f"g{i}"][j : j + 60] for j in range(0, 600, 60)) + "\n")
    return seqs


def test_commands(spark, tmp_path):
    rng = random.Random(2)
    (tmp_path / "genomes").mkdir()
    (tmp_path / "reads").mkdir()
    seqs = write_genomes(tmp_path / "genomes", rng)
    db_path, out = str(tmp_path / "db"), str(tmp_path / "out")
    main(["quickrun", "--db", db_path, "-d", str(tmp_path / "genomes"), "-k", "21", "-s", "1", "-n", "2"])
    db = Database(spark, db_path)
    assert sorted(n.name for n in db.tree().leaves()) == sorted(seqs)
    with open(tmp_path / "reads" / "one.fa", "w") as f:
        for i in range(40):
            name = f"g{i % 4}"
            start = rng.randrange(230, 500)
            f.write(f">R{i} {name}\n{seqs[name][start : start + 100]}\n")
        f.write(">root x\n" + seqs["g0"][:90] + "\n>none x\n" + "ACGT" * 20 + "\n>short x\nACG\n")
    folders = db.classify(str(tmp_path / "reads"), out)
    raw = {r["read_id"]: r for r in spark.read.schema("code string, read_id string, node string, length int, hits string, sample string").option("sep", "\t").csv(folders.of("phy", "raw")).collect()}
    ids = {r["name"]: r["node_id"] for r in spark.read.parquet(db.folders.nodes).collect()}
    assert all(raw[f"R{i}"]["code"] == "C" and raw[f"R{i}"]["node"] == f"p{ids[f'g{i % 4}']}" for i in range(40))
    assert (raw["root"]["code"], raw["root"]["node"], raw["none"]["code"], raw["short"]["code"]) == ("C", "p1", "U", "U")
    assert raw["R0"]["length"] == 101
    summary = {r["label"]: r for r in spark.read.option("header", True).csv(folders.of("phy", "summary")).collect()}
    assert summary["p1"]["t_cumul"] == "41" and summary["unclassified"]["t_count"] == "2" and summary["g0"]["c_count"] == "10"
    main(["cutoff", "--db", db_path, "-o", out, "--cpm", "500000"])
    assert {r["label"] for r in spark.read.option("header", True).csv(folders.of("phy", "summary")).collect()} >= {"p1"}
    main(["draw_tree", "--db", db_path, "-o", out, "--colour", "one=FF0000"])
    for name in ("drawing", "drawing_classified"):
        assert "TREE_COLORS" in [r["value"] for r in spark.read.text(f"{out}/phy/{name}").collect()]
    assert [r["value"] for r in spark.read.text(f"{out}/phy/drawing_splits").collect()] == ["TREE_COLORS", "SEPARATOR TAB", "DATA"]  # no read is split
    split, classified = (spark.read.option("header", True).csv(folders.of("phy", x)) for x in ("split", "classified"))
    assert split.columns == classified.columns == ["label", "one"] and "unclassified" not in {r["label"] for r in split.collect()}
    assert {r["label"]: r["one"] for r in classified.collect()} == {"unclassified": "2", "p1": "1", **dict.fromkeys(("g0", "g1", "g2", "g3"), "10")}
    main(["cutoff", "--db", db_path, "-o", out + "2", "--classified", folders.of("phy", "classified"), "--split", folders.of("phy", "split"), "--cpm", "0"])
    assert {r["label"]: r["t_cumul"] for r in spark.read.option("header", True).csv(out + "2/phy/summary").collect()}["p1"] == "41"
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n" + "".join(f"{10 + i}\t|\t1\t|\tspecies\t|\n" for i in range(4)))
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n" + "".join(f"{10 + i}\t|\tS{i}\t|\t\t|\tscientific name\t|\n" for i in range(4)))
    main(["to_taxonomy", "--db", db_path, "-o", out, "--nodes_dump", str(tmp_path / "nodes.dmp"), "--names_dump", str(tmp_path / "names.dmp")])
    got = {r["taxid"]: (r["sl"], r["scientific_name"]) for r in spark.read.option("header", True).csv(f"{out}/tax/summary").collect()}
    assert got["1"] == ("41", "root") and got["10"] == ("10", "S0") and got["unclassified"][0] == "2"


def test_groups_and_fake_tree(spark, tmp_path):
    (tmp_path / "genomes").mkdir()
    write_genomes(tmp_path / "genomes", random.Random(3))
    db = Database(spark, str(tmp_path / "db")).create()
    db.add(str(tmp_path / "genomes"))
    assert len(db.config.paths()) == 4 and "sequences=4" in str(db.config)
    db.fake_tree()
    assert len(db.tree().leaves()) == 4
    db.remove([str(tmp_path / "genomes" / "g0.fna")])
    assert len(Database(spark, str(tmp_path / "db")).config.paths()) == 3


def test_tree_stages_are_kept_and_stored(spark, tmp_path, capsys, monkeypatch):
    from cladeforge import __main__ as commands

    monkeypatch.setattr(commands, "DEFAULT", str(tmp_path / "default"))
    (tmp_path / "genomes").mkdir()
    write_genomes(tmp_path / "genomes", random.Random(4))
    path = str(tmp_path / "db")
    with pytest.raises(ValueError, match="no database"):
        main(["print", "--db", path])
    with pytest.raises(SystemExit):
        main(["print"])
    main(["create", "--db", path])
    main(["default_db", "--db", path])
    main(["add", "-d", str(tmp_path / "genomes" / "g0.fna")])
    main(["set", "-k", "15", "-s", "1"])
    main(["sketch"])
    stored = str(tmp_path / "db" / "phylogeny" / "sketch" / "default.k15.s1.scaled")
    assert {r["name"] for r in spark.read.parquet(stored).select("name").distinct().collect()} == {"g0"}
    for i in (1, 2, 3):
        main(["add", "-d", str(tmp_path / "genomes" / f"g{i}.fna")])
    main(["distance"])
    assert spark.read.parquet(stored).groupBy("name").count().count() == 4
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "db" / "phylogeny" / "distance" / "default.k15.s1.scaled.tab")).collect()]
    assert lines[0] == "4" and [x.split("\t")[0] for x in lines[1:]] == ["g0", "g1", "g2", "g3"]
    main(["nj"])
    assert capsys.readouterr().out.count("g3") == 1
    db = Database(spark, path)
    assert db.distance(scaled=300, bottom=True).count() == 6
    main(["mashtree"])
    assert sorted(x.name for x in Database(spark, path).tree().leaves()) == ["g0", "g1", "g2", "g3"]
    (tmp_path / "log").write_text("1\tclassify\t01/02/2022 03:04:05 PM RSS: 1.5Gb VSZ: 2.5Gb\n1\tclassify\t01/02/2022 03:04:06 PM RSS: 2.0Gb VSZ: 3.0Gb\n2\tclassify\t01/02/2022 03:04:06 PM RSS: 1.0Gb VSZ: 1.0Gb\n")
    main(["plot_memory", "--log", str(tmp_path / "log"), "-o", str(tmp_path / "memory")])
    assert spark.read.option("header", True).csv(str(tmp_path / "memory")).collect() == [("classify", "3.0", "4.0")]
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n")
    main(["download_taxonomy", "--nodes_dump", str(tmp_path / "nodes.dmp"), "--names_dump", str(tmp_path / "nodes.dmp")])
    assert (tmp_path / "db" / "phylogeny" / "nodes.dmp").exists()
