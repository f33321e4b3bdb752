"""Licence scans: every planted notice is found with its family, ordinary text is not."""

import pytest

from plumbline.llm import licences as li

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return li.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def hits(spark, rows, model):
    return sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in li.scan(spark.createDataFrame(rows, "doc_id bigint, text string, hit string"), model).collect())


def test_notices(spark, model):
    notices = [
        ("mit", "Released under the MIT License."), ("apache", "  licensed under the APACHE license, version 2.0"), ("cc", "Licensed under CC BY-NC 4.0."),
        ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("reserved", "All rights reserved."), ("mpl", "SPDX-License-Identifier: MPL-2.0"),
        ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        ("public_domain", "This is free and unencumbered software released into the public domain."),
    ]
    rows = [(i, f"First line of it.\n{text}\nmore text", "clash") for i, (_, text) in enumerate(notices)]
    assert hits(spark, rows, model) == [(i, 1, family, True) for i, (family, _) in enumerate(notices)]


def test_ordinary_text(spark, model):
    rows = [(1, "The public was free to use the general form of the source. He is permitted to go.", ""), (2, None, ""), (3, "", ""), (4, "word " * 50_000, ""),
            (5, "My driving license expired last year and the policeman was not amused at all when he saw it.", ""), (6, "a\n\n\nb", "")]
    assert [h for h in hits(spark, rows, model) if h[3]] == []


def test_repeated_rows_and_empty_table(spark, model):
    row = (None, "All rights reserved.\nAll rights reserved.", "")
    assert [h[1:] for h in hits_null(spark, [row, row], model)] == [(0, "reserved", True), (0, "reserved", True), (1, "reserved", True), (1, "reserved", True)]
    assert hits(spark, [], model) == []


def hits_null(spark, rows, model):
    out = li.scan(spark.createDataFrame(rows, "doc_id bigint, text string, hit string"), model).collect()
    return sorted(((r.doc_id, r.paragraph, r.family, r.confirmed) for r in out), key=str)


def test_corpus(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {(r.doc_id, r.paragraph): r.family for r in li.scan(docs, model).collect()}
    want = {}
    for r in docs.collect():
        for n, line in enumerate((r.text or "").split("\n")):
            for mark, family in (("MIT License", "mit"), ("Apache License", "apache"), ("GNU General", "gpl"), ("CC BY", "cc"), ("rights reserved", "reserved")):
                if mark in line:
                    want[r.doc_id, n] = family
    assert got == want and len(want) > 20


def test_plan_is_native(spark, model):
    plan = li.scan(spark.read.parquet(f"{FOLDER}/documents.parquet"), model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_plain_paragraph_counts(spark, monkeypatch):
    """More paragraphs than the class weighs, one of them close to a template: all are counted, and none that is left out passes the bar."""
    rows = [(i, "it was a plain day in the town\nwith the sea") for i in range(3000)] + [(9000 + i, "you may not use this file except in\nyou may obtain a copy of the code") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    monkeypatch.setattr(li, "written", lambda df: seen.append(df) or df.cache())
    model = li.train(docs)
    assert [df.agg({"n": "sum"}).first()[0] for df in seen if df.columns == ["grams", "left_out", "n"]] == [6040]
    left = li.told_apart(docs).filter("left_out").select("hit", li.grams(li.F.concat(li.F.split(li.F.lit("you may not use this file except in"), " "))).alias("grams")).limit(1)
    assert li.probabilities(left, ["hit"], li.F.col("grams"), model.weights, model.biases).first()["probability"] <= model.bar


def test_plain_grams(spark):
    texts = ["This work is in the, you may obtain A COPY of 2.0 or", "use v 2.0 v 2", "nothing here", "the the the free of charge to"]
    rows = li.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    known = li.vocabulary()
    for r in rows.select("words", li.plain_grams(li.F.col("words")).alias("got"), li.grams(li.F.col("words")).alias("all")).collect():
        assert r.got == sorted(set(r["all"]) & set(known))
