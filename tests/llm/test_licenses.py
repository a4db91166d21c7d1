import re

from sparvane.llm import licenses


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(df).collect()}


def test_labels_and_places(spark):
    apache = "x y. You may NOT use this file except in compliance with the License; you may obtain a copy of the License at z"
    edited = "x redistribution and use in source forms with or without modification are permitted provided that the following conditions are met"
    rows = scan(spark, ["Released under the MIT License, MIT license!", apache, edited, "Licensed under CC BY-NC 4.0.", "the license of mit", None, ""])
    assert rows[0].n_base == 2 and (rows[0].first_word, rows[0].last_word) == (3, 5) and rows[0].labels == ["mit"] and rows[0].score == 1
    assert rows[1].n_base == 0 and rows[1].labels == ["apache"] and rows[1].score == 1
    assert rows[2].labels == ["bsd"] and 0.8 <= rows[2].score < 1 and rows[2].spans[0].start == 1
    assert rows[3].labels == ["cc-by-nc"] and rows[3].base_labels == []
    assert all(rows[i].labels == [] and rows[i].score == 0 and rows[i].first_word is None for i in (4, 5, 6))


def test_plan_stays_in_the_jvm(edge_docs):
    plan = licenses.scan(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_only_a_to_z_are_lower_cased(spark):
    rows = scan(spark, ["this worK is licensed under the gnu general public license version 3".replace("K", "\u212a"), "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE VERSION 3", "\u212a\u0130 MIT License"])
    assert rows[0].score == 1 and rows[0].n_base == 1 and not any(s.covered == 1 for s in rows[0].spans)
    assert [s.covered for s in rows[1].spans] == [1.0] and rows[2].n_words == 3 and rows[2].labels == ["mit"]


def test_edges(spark, edge_docs, no_docs):
    long = "word " * 50_000 + "MIT license"
    rows = [(None, "Apache License"), (1, "Apache License"), (1, "Apache License"), (2, None), (3, ""), (4, " \n"), (5, long)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, row int, labels string")
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, ",".join(r.labels), r.score) for r in licenses.scan(df).collect())
    apache = (2, 1, 0, "apache", 1.0)
    assert got == [("1", *apache), ("1", *apache), ("2", 0, 0, None, "", 0.0), ("3", 0, 0, None, "", 0.0), ("4", 0, 0, None, "", 0.0), ("5", 50_002, 1, 50_000, "mit", 1.0), ("None", *apache)]
    assert licenses.scan(edge_docs).count() == edge_docs.count() and licenses.scan(no_docs).count() == 0
