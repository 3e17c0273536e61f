"""python -m cladeforge COMMAND --db FOLDER ...: the commands of a sequence database."""

from __future__ import annotations

import argparse
import os
import shutil

COMMANDS = ("create", "add", "remove", "set", "print", "build", "quickrun", "classify", "to_taxonomy", "cutoff", "draw_tree", "tree", "finish_tree", "fake_phylogeny", "sketch", "distance", "nj", "phylotree", "mashtree", "download_taxonomy", "plot_memory", "default_db")
DEFAULT = os.path.join(os.path.expanduser("~"), ".cladeforge")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladeforge", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--db", help="a database's folder; without it, that of default_db")
    p.add_argument("-d", "--directory")
    p.add_argument("-o", "--out")
    p.add_argument("--group")
    p.add_argument("--first", type=int)
    p.add_argument("-k", type=int)
    p.add_argument("-n", type=int, help="partitions")
    p.add_argument("-s", "--sketch", type=int)
    p.add_argument("-p", "--phylogeny")
    p.add_argument("--template")
    p.add_argument("--paired", action="store_true")
    p.add_argument("--keep_zeros", action="store_true")
    p.add_argument("--alpha", type=float, default=0.1)
    p.add_argument("--cpm", type=float, default=100.0)
    p.add_argument("--colour", action="append", default=[], help="sample=RRGGBB")
    p.add_argument("--log_scores", action="store_true")
    p.add_argument("--samples", action="append", default=[], help="sample=group")
    p.add_argument("--classified", help="a matrix from elsewhere, with --split")
    p.add_argument("--split")
    p.add_argument("--log")
    p.add_argument("--nodes_dump")
    p.add_argument("--names_dump")
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from cladeforge.engine import Database
    from cladeforge.sources import reports

    a = parser().parse_args(argv)
    if a.command == "default_db":
        with open(DEFAULT, "w") as f:
            f.write(os.path.abspath(a.db))
        return
    a.db = a.db or (open(DEFAULT).read().strip() if os.path.exists(DEFAULT) else None)
    if not a.db:
        raise SystemExit("no database: give --db or set one by default_db")
    spark = SparkSession.builder.appName("cladeforge").getOrCreate()
    db = Database(spark, a.db)
    if a.command not in ("create", "quickrun"):
        db.check()
    values = {x: y for x, y in (("k", a.k), ("s", a.sketch), ("phylogeny_path", a.phylogeny)) if y is not None}
    if a.command == "create":
        db.create()
    elif a.command == "add":
        db.add(a.directory, a.group or "default", a.first)
    elif a.command == "remove":
        db.remove([a.directory] if a.directory else None, a.group)
    elif a.command == "set":
        db.set(a.group, **values)
    elif a.command == "print":
        print(db.config)
    elif a.command in ("tree", "phylotree", "mashtree"):
        print(db.make_tree(a.group, bottom=a.command == "mashtree"))
        if a.command == "phylotree":
            print(db.finish_tree(a.template))
    elif a.command == "sketch":
        db.sketch(a.group)
    elif a.command == "distance":
        db.distance(a.group)
    elif a.command == "nj":
        print(db.neighbour_joining(a.group))
    elif a.command == "download_taxonomy":
        for path in (a.nodes_dump, a.names_dump):  # fetched beforehand: this program opens no connection
            shutil.copy(path, db.folders.phylogeny)
    elif a.command == "plot_memory":
        db.memory(a.log, a.out).show()
    elif a.command == "cutoff" and a.classified:
        db.cutoff_matrices(a.classified, a.split, a.out, a.cpm)
    elif a.command == "finish_tree":
        print(db.finish_tree(a.template))
    elif a.command == "fake_phylogeny":
        print(db.fake_tree())
    elif a.command == "build":
        db.build(a.n)
    elif a.command == "quickrun":
        db.create()
        db.add(a.directory)
        db.set(**values)
        if not a.phylogeny:
            db.make_tree()
        db.build(a.n)
    elif a.command == "classify":
        db.classify(a.directory, a.out, a.paired, a.alpha, a.cpm, a.keep_zeros, a.n)
    elif a.command == "cutoff":
        db.cutoff(a.out, a.cpm, a.keep_zeros)
    elif a.command == "draw_tree":
        db.draw(a.out, dict(x.split("=", 1) for x in a.colour), a.log_scores, a.cpm, [tuple(x.split("=", 1)) for x in a.samples])
    else:
        ids = spark.read.schema("name string, accession string, taxid string").csv(db.folders.accessions)
        db.to_taxonomy(a.out, reports.read_dump(spark, a.nodes_dump, a.names_dump), ids.where(F.col("taxid") != "None").select("name", "taxid"))


if __name__ == "__main__":
    main()
