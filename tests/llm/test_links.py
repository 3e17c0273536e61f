"""Links, components, contamination, labels, licences and the pipeline against brute force."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from cladeforge.llm import decontaminate, licenses, simhash, toxicity
from cladeforge.llm.graph import connected_components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=3):
    up = {i: i for i in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_fingerprint():
    for t in [None, "", " \t\n", "One", "One two", "One two THREE", "É é\x0bà\x1cb c d", "a b c d e f " * 50]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_near_duplicates(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = components(fps)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in got} == {i: (fps[i], want[i]) for i in fps}


@pytest.mark.parametrize("limit", [None, 8, 60])
def test_links_of_dense_groups(spark, limit):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for base in list(fps)[:3]:
        for _ in range(150):
            x = base
            for _ in range(rng.randrange(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = {x if x < 2**63 else x - 2**64: x for x in fps}
    got = dict(map(tuple, connected_components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), run_limit=limit)).collect()))
    want = components(signed)
    assert {s: got.get(s, s) for s in signed} == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (500, 502)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500, 502: 500}


def test_components_of_a_long_chain_of_random_numbers(spark):
    rng = random.Random(5)
    names = list({rng.getrandbits(64) - 2**63 for _ in range(3000)})
    rng.shuffle(names)
    edges = [p if rng.random() < 0.5 else p[::-1] for p in zip(names[:-1], names[1:], strict=True)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == dict.fromkeys(names, min(names))
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(edges, "a long, b long"), max_rounds=2)


def windows_hit(doc, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, hit, found = words(doc), set(), set()
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            for at in range(len(d) - k + 1):
                if d[at : at + k] == w[s : s + k]:
                    hit |= set(range(at, at + k))
                    found.add(i)
    return len(d), len(hit), found


def test_contamination(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(["Alpha", "beta", "gÄmma", "delta9", "the"]) for _ in range(n))) for i, n in enumerate([20, 13, 5, 1, 0, 14, 30])] + [(7, None)]
    docs = []
    for i in range(40):
        parts = [" ".join(rng.choice(["alpha", "Beta", "x", "the"]) for _ in range(rng.randrange(0, 15)))]
        if i % 2:
            t = rng.choice([t for _, t in items if t])
            parts += [t.upper().replace("Ä", "Ä") if i % 4 == 1 else t, "tail end"]
        docs.append((i, ", ".join(parts)))
    got = decontaminate.Decontaminator(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).report()
    for r in got.collect():
        n, hit, found = windows_hit(docs[r["key"]][1], items)
        assert (r["n_words"], r["n_hit"], set(r["items"])) == (n, hit, {str(i) for i in found}), docs[r["key"]]


def near_places(doc, item, share, slop):
    """Begins at which at least ``share`` of the item's words stand in place or up to ``slop`` words off."""
    places = {}
    for i, w in enumerate(doc):
        places.setdefault(w, set()).add(i)
    out = set()
    for begin in range(-len(item) - slop, len(doc) + slop):
        got = sum(any(begin + i + d in places.get(w, ()) for d in range(-slop, slop + 1)) for i, w in enumerate(item))
        if got >= share * len(item):
            out.add(begin)
    return out


@pytest.mark.parametrize("slop", [0, 2])
def test_proximity_against_brute_force(spark, slop):
    rng = random.Random(slop)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([25, 13, 14, 40, 8, 2])]
    docs = []
    for i in range(30):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([["odd"], [words[at], "odd"], []]) if len(words) > 1 and slop else ["odd"]
        docs.append((i, " ".join([rng.choice(vocabulary) for _ in range(5)] + words + ["end"])))
    found = decontaminate.Decontaminator(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    ids = {r["row"]: r["doc_id"] for r in found.docs.select("key", "row").withColumnRenamed("key", "doc_id").collect()}
    got = {(ids[r["row"]], r["item"]) for r in found.proximity(0.8, slop).collect()}
    want = {(d, i) for d, t in docs for i, item in items if near_places(t.split(), item.split(), 0.8, slop)}
    # An item of two words may stand apart by more than its anchors tell; longer ones are all found.
    assert {x for x in got if x[1] != 5} == {x for x in want if x[1] != 5} and {x for x in got if x[1] == 5} <= {x for x in want if x[1] == 5}


def test_a_stored_index_serves_a_second_benchmark(spark, tmp_path):
    from cladeforge.llm.common import with_rows

    docs = with_rows(spark.createDataFrame([(1, "a b c d e"), (2, "x y"), (2, "b c")], "doc_id long, text string"))
    decontaminate.PositionalIndex.build(docs).save(str(tmp_path / "index"))
    index = decontaminate.PositionalIndex.load(spark, str(tmp_path / "index"))
    assert index.postings.count() == 9
    for items, want in (([(1, "B c")], {(1, 2), (2, 0), (2, 2)}), ([(1, "x y"), (2, "nowhere"), (3, "e")], {(1, 1), (2, 2), (2, 0)})):
        got = decontaminate.Decontaminator(docs, spark.createDataFrame(items, "item_id long, text string"), index=index).report()
        assert {(r["key"], r["n_hit"]) for r in got.collect()} == want


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    weights = np.append(rng.uniform(1, 6, 60) ** 2, 5.0)
    popular = np.append(1 / np.arange(1, 61), 0)[:60] / sum(1 / np.arange(1, 61))
    vectors = []
    for m in rng.integers(0, 20, 700):
        ids, counts = np.unique(rng.choice(60, m, p=popular), return_counts=True)
        vectors.append(toxicity.unit(ids, counts, weights))
    index = toxicity.BlockMaxIndex(61, vectors, [(0, i) for i in range(len(vectors))])
    plain = np.zeros((len(vectors), 61))
    for i, (t, w) in enumerate(vectors):
        plain[i, t] = w
    for t, w in vectors[:80]:
        want = np.sort(plain[:, t] @ w)[::-1][:10]
        got, entries = index.nearest(t, w, 10)
        assert np.allclose(got, want, atol=1e-5) and np.allclose(plain[index.labels[entries, 1]][:, t] @ w, got, atol=1e-5)


@pytest.fixture(scope="module")
def scored(spark):
    """(toxic, predicted, score) of all held-out labelled rows, by the query."""
    d = "/root/testdata/sf0.1"
    rows = toxicity.op10_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    import zlib

    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    return [(r["toxic"], r["predicted"], r["score"]) for r in rows]


def test_held_out_accuracy(scored):
    assert sum(p for y, p, _ in scored if not y) <= 0.005 * sum(not y for y, _, _ in scored)
    assert sum(p for y, p, _ in scored if y) >= 0.9 * sum(y for y, _, _ in scored)


def test_scores_are_calibrated(scored):
    """About the told share of each range of scores is toxic, within four standard errors and two rows."""
    for lo, hi in ((0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 1.01)):
        part = [(y, s) for y, _, s in scored if lo <= s < hi]
        want, got = sum(s for _, s in part), sum(y for y, _ in part)
        assert abs(want - got) <= 4 * sum(s * (1 - s) for _, s in part) ** 0.5 + 2, (lo, want, got)
    assert sum((s - y) ** 2 for y, _, s in scored) / len(scored) < 0.02


def test_every_word_has_a_weight(spark):
    rows = [(i, f"word{i % 7} plain text" if i % 4 else f"awful word{i % 7}", int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t, _ in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    assert {*(f"word{i}" for i in range(7)), "plain", "text", "awful"} <= set(model.index) and (model.weights > 0).all()
    assert model.weights[model.index["awful"]] > 10 * model.weights[model.index["plain"]]
    got = toxicity.score_texts(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted", "evidence"] and {r["predicted"] for r in got.where("text like 'awful%'").collect()} == {1}


def test_scores_do_not_use_other_columns(spark):
    rows = [(i, f"some plain words {i % 3}" if i % 4 else f"awful nasty{'abcdefghij'[i % 10]} words", i % 4 == 0) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, toxicity.fit(toxicity.training_rows(docs, labels))).collect()}
    by = {}
    for i, t, y in rows:
        assert (got[i] >= 0.5) == y
        by.setdefault(t, set()).add(got[i])
    assert all(len(v) == 1 for v in by.values())


def test_licences_are_inherited(spark):
    files = [
        (1, "a/LICENSE", "Some words.\nReleased under the MIT License.\nMore."), (2, "a/b/c/code.py", "plain text"), (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/d/x.py", "Licensed under CC BY-NC 4.0."), (5, "z/y.py", "the under of"), (6, "ab/x", "x"), (7, None, "Released under the MIT License."), (8, "a/direct.txt", None),
    ]
    got = {r["key"]: (r["own"], r["license"], r["inherited_from"]) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string"), "doc_id").collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "Apache-2.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        5: (None, None, None), 6: (None, None, None), 7: ("MIT", "MIT", None), 8: (None, "MIT", "a"),
    }


def test_licence_files_titles_and_notices_in_lines(spark):
    folder = Path(licenses.__file__).parent / "licence_texts"
    full = {p.stem: p.read_text() for p in folder.glob("*.txt")}
    files = [(f"{n}/LICENSE", t.replace("Copyright", "Copyright (c) 2020 Someone Else")) for n, t in full.items()]
    gpl = "  # This program is free software: you can redistribute it and/or modify it under the terms of the GNU General\n  # Public License as published by the Free Software Foundation, either version 3 of the License, or later."
    more = {"spdx": ("// SPDX-License-Identifier: MIT\nx = 1", "MIT"), "spdx2": ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), "spdx3": ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), "gpl": (gpl, "GPL-3.0"),
            "long": ("word " * 30 + "Released under the MIT License " + "word " * 30, "MIT"), "title": ("MIT License\n\nCopyright", "MIT"), "gnu": ("GNU GENERAL PUBLIC LICENSE\n   Version 3", "GPL-3.0"), "gpl2": ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), "gpl2b": (gpl.replace("version 3", "version 2"), "GPL-2.0"), "lgpl": ("// GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
            "bsd2": ("Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:", "BSD-2-Clause"), "isc": ("SPDX-License-Identifier: ISC", "ISC"),
            "granted": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "MIT"),
            "project": ("This project is licensed under the MIT License - see the file for details", "MIT"), "mpl": ("Mozilla Public License Version 2.0", "MPL-2.0"), "un": ("// This is free and unencumbered software released into the public domain.", "Unlicense"),
            "none": ("the MIT students' permission and a driving license", None)}
    rows = [(i, p, t) for i, (p, t) in enumerate([*files, *((f"x/{k}.py", t) for k, (t, _) in more.items())])]
    got = {r["path"]: r["own"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id").collect()}
    assert got == {f"{n}/LICENSE": n for n in full} | {f"x/{k}.py": n for k, (_, n) in more.items()}


def test_every_segment_that_reaches_the_threshold_is_compared():
    idf = licenses.weights({"the": 900, "under": 500, "license": 20}, 1000)
    vecs = licenses.vectors(idf)
    must = set(licenses.needed(vecs, 0.7))
    for v in vecs.values():
        assert sum(x * x for w, x in v.items() if w not in must) < 0.49


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from cladeforge.llm import packing, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    before = seen["toxicity"]
    want = components({i: plain_fingerprint(t) for i, t in before.items()})
    assert set(seen["simhash_near_dedup"]) == set(want.values())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for i, t in seen["simhash_near_dedup"].items():
        n, hit, _ = windows_hit(t, items)
        if not (hit and 20 * hit >= n):
            clean.add(i)
    assert set(seen["benchmark_decontamination"]) == clean
    for i, t in seen["secret_scans"].items():
        was = seen["benchmark_decontamination"][i]
        assert ("[SECRET]" in t) == (t != was)
    assert not any(len(r["found"]) for r in secrets.scan(kept).collect())
    out = corpus_pipeline.run(spark, SF).collect()
    enc = packing.encoding(packing.default_ranks())
    assert sum(r["length"] for r in out) == sum(len(enc.encode_ordinary(t)) + 1 for t in seen["secret_scans"].values())


PIPELINE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, score double"


def pipeline_input(spark, tmp_path, pairs):
    from cladeforge.llm.common import materialize

    folder = tmp_path / "in"
    folder.mkdir()
    for t in ("benchmark", "labels"):
        (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 0.5) for i, t in pairs], PIPELINE_COLUMNS)
    rows.coalesce(2).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_pipeline_keeps_unrelated_rows_of_one_id(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"word{i % 997} token{i % 31}." for i in range(40_000))
    pairs = [(5, "alpha beta gamma delta epsilon zeta eta theta"), (5, "quite another text about sailing boats and the sea"), (5, "quite another text about sailing boats and the sea"), (None, "no id but words of its own here"),
             (None, "no id but words of its own here"), (7, None), (8, ""), (9, long), (10, "password: abcdefgh in a text of some words"), (3, "quite another text about sailing boats and the sea")]
    d = pipeline_input(spark, tmp_path, pairs)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, d)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)  # a table that is not read from files
    want = [(None, pairs[3][1]), (3, pairs[1][1]), (5, pairs[0][1]), (7, None), (9, long), (10, "a")]
    got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0]))
    assert [i for i, _ in got] == [i for i, _ in want] and [t for i, t in got if i in (None, 3, 5, 9)] == [t for i, t in want if i in (None, 3, 5, 9)]
    assert next(t for i, t in got if i == 10).startswith("[SECRET]")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == {i for i, _ in want}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, pipeline_input(spark, tmp_path, [])).count() == 0


def test_rows_are_told_apart_and_small_tables_are_few_files(spark):
    from cladeforge.llm.common import materialize, with_rows

    rows = with_rows(spark.createDataFrame([(1, "a")] * 50, "doc_id long, text string"))
    first = sorted(map(repr, rows.collect()))
    assert len(set(first)) == 50 and first == sorted(map(repr, rows.collect()))
    written = materialize(spark.range(10_000).repartition(200, "id"), "few")
    assert len(written.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism and written.count() == 10_000


def test_arrow_batches_restores_the_setting(spark):
    from cladeforge.llm.common import arrow_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with arrow_batches(spark, 7):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before


def test_op7_query_against_brute_force(spark):
    fps = {i: plain_fingerprint(t) for i, t in map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())}
    want = components(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7_simhash_near_dedup(spark, SF).collect()} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_queries_match_their_sql(spark):
    import duckdb

    from cladeforge.llm import registry

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        got = registry.QUERIES[name](spark, SF)
        columns = sorted(got.columns)
        assert sorted(map(str, got.select(*columns).collect())) and sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, con.execute(f"select {', '.join(columns)} from ({sql})").fetchall()))
