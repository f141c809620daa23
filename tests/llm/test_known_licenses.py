"""The licence query's own table of known texts and notices."""

import re

import pytest

from tessera.llm import known_licenses, licenses, registry

FILES = {p.name: p.read_text("utf-8") for p in known_licenses.TEXTS.glob("*.txt")}


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    """License and notices of each text, by the registered query."""

    def run(texts):
        folder = str(tmp_path_factory.mktemp("docs"))
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        return [(r["license"], r["notices"]) for r in registry.op3_licenses(spark, folder).orderBy("doc_id").collect()]

    return run


def test_entire_texts(scan):
    names = sorted(FILES)
    found = scan([FILES[n] for n in names] + [" ".join(FILES["BSD-3-Clause.txt"].split(" ")).replace("<year> <owner>", "2020 A. Person")])
    assert [i for i, _ in found] == [re.sub(r"(\.spdx)?\.txt$", "", n) for n in names] + ["BSD-3-Clause"]


def test_titles(scan):
    mit, isc = dict(licenses.LICENSES)["MIT"], dict(licenses.LICENSES)["ISC"]
    texts = ["MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit, "The MIT License (MIT)\n" + mit, "ISC License\n\n" + isc, "Some License\n\n" + mit]
    assert [i for i, _ in scan(texts)] == ["MIT", "MIT", "ISC", None]


def test_notices(scan):
    texts = [
        '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file',
        "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;",
        "/* SPDX-License-Identifier: BSD-3-Clause */",
        "x\nThis project is licensed under the MIT License.",
        "Licensed under some license.",
    ]
    assert scan(texts) == [(None, "Apache-2.0"), (None, "GPL-2.0-or-later"), (None, "BSD-3-Clause"), (None, "MIT"), (None, None)]


def test_table_names_each_licence_once(spark):
    rows = known_licenses.known_licenses(spark)
    marked = rows.select("license", "whole", licenses.canonical_text(licenses._lines(rows["text"])).alias("form")).distinct()
    assert marked.groupBy("whole", "form").count().where("count > 1").isEmpty()
    assert len(set(known_licenses.texts())) + len(set(known_licenses.notices())) < 10_000
