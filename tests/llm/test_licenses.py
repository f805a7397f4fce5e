import random
import re

from sitelens.llm import licenses


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def places(text):
    w = words(text)
    return sorted((i, i + len(p.split()), label) for label, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def rows_of(spark, texts):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, spans string, row int").repartition(3)
    return {r["doc_id"]: r for r in licenses.scan(df).collect()}


def test_base_places_against_brute_force(spark):
    r = random.Random(1)
    bits = ["cc", "by", "CC-BY", "general", "public", "license", "GENERAL public LICENSE,", "all", "rights", "reserved.", "All Rights Reserved", "x", "é", "cc by cc by", "K", "3"]
    texts = [(k, " ".join(r.choice(bits) for _ in range(r.randrange(40)))) for k in range(300)]
    texts += [(900, None), (901, ""), (902, "cc"), (903, "cc by"), (904, "all rights reserved " * 5000), (905, "word " * 60_000 + "cc by"), (906, "accc byb"), (907, "ccé by"), (908, "cc_by c c by")]
    got = rows_of(spark, texts)
    assert len(got) == len(texts)
    for k, t in texts:
        assert got[k]["n_words"] == len(words(t))
        assert sorted((s["start"], s["stop"], s["label"]) for s in got[k]["spans"] if s["base"]) == places(t)


def test_notices_and_changed_wordings(spark):
    prose = "the of to and this is under terms with or without use in the work of the public any copy "
    texts = dict(enumerate([
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        prose * 30 + "This program is free software: you can redistribute it and/or really modify it under the terms of the GNU General Public License as published",
        "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:",
        "Permission is hereby granted, to any person obtaining a copy of this software and associated documentation files (the Software)",
        prose * 50, "the license of the software is distributed under the terms of the public license", "All rights are reserved", "license mit the under released",
        "Released under the Mit. " + prose,
    ]))
    got = rows_of(spark, texts.items())
    labels = {k: sorted({s["label"] for s in r["spans"]}) for k, r in got.items()}
    assert labels == {0: ["mit"], 1: ["apache-2.0"], 2: ["cc-by", "cc-by-nc"], 3: ["gpl"], 4: ["gpl"], 5: ["bsd"], 6: ["mit"], 7: [], 8: [], 9: [], 10: [], 11: ["mit"]}
    moved = [s for s in got[5]["spans"]]
    assert [(s["start"], s["stop"], round(s["share"], 6)) for s in moved] == [(0, 22, round(21 / 22, 6))]


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (1, "mit"), (None, "cc by"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_words"], len(r["spans"])) for r in licenses.scan(df).collect()) == [("1", 1, 0), ("1", 2, 1), ("1", 2, 1), ("None", 0, 0), ("None", 2, 1)]
    assert licenses.scan(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, sf_dir):
    plan = licenses.op13_licenses(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and plan.count("Exchange hashpartitioning") == 1
