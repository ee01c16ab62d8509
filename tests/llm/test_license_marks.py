"""Notices that differ from another license's in one word."""

import pytest

from geoloom.llm import licenses

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
CC = "It is licensed under a Creative Commons Attribution{} 4.0 International License."
CASES = [
    (GPL.format("", 3), "gpl-3"), (GPL.format("Affero ", 3), "agpl-3"), (GPL.format("", 2), ""), (LGPL, "lgpl"),
    (CC.format(""), "cc-by"), (CC.format("-NonCommercial"), "cc-by-nc"), (CC.format("-Non-Commercial"), "cc-by-nc"), (CC.format("-ShareAlike"), "cc-by-sa"),
    ("licensed under the Apache License, Version 2.0", "apache-2"), ("licensed under the Apache License, Version 1.1", ""),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r.labels for r in licenses.scan(rows).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_only_the_right_label(got, i):
    assert got[i] == CASES[i][1]
