"""Licence texts as files have them, and texts that would take long."""

import time

import pytest

from tessera.llm import license_scan

S = license_scan.SENTENCES


def scan(spark, *texts):
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.licenses for r in sorted(rows, key=lambda r: r.doc_id)]


def bsd(owner):
    parts = [S["bsd/grant"], "1. " + S["bsd/source"], "2. " + S["bsd/binary"], "3. " + S["bsd/endorse"].replace("the copyright holder", owner)]
    return "Copyright (c) 2020\n\n" + "\n\n".join(parts) + "\n"


@pytest.mark.parametrize("owner", ["the copyright holder", "Example Inc.", "Example, Inc.", "the University of\n * Somewhere", "A. B. Author; others"])
def test_any_owner(spark, owner):
    wrapped = " * " + bsd(owner).replace(" promote ", "\n * promote ")
    assert scan(spark, bsd(owner), wrapped) == ["BSD-3-Clause"] * 2


def test_tags(spark):
    assert scan(spark, "// SPDX-License-Identifier: MIT\nint x;", "/* SPDX-License-Identifier: Apache-2.0 */", "# spdx-license-identifier:BSD-3-Clause", "SPDX-License-Identifier: Foo-1.0", "SPDX-License-Identifier:\tGPL-3.0-only") == ["MIT", "Apache-2.0", "BSD-3-Clause", "", "GPL-3.0-only"]


def test_marks_and_lines(spark):
    control = "x\x01Released under the MIT License.\x01"
    assert scan(spark, "Released   under --- the\n# MIT License!", "Released under. the MIT License", "Released under .the MIT License", "a;\nReleased under the MIT License", control, "Released under the MIT License...x") == ["MIT", "", "MIT", "MIT", "", ""]


@pytest.mark.parametrize("noise", [". ", "...", ".\n", "\n", " \n\n ", "a. ", "license ", "neither the name of ", "licensed under the\n", "\x01", "! ? ", "# "])
def test_long_texts_in_linear_time(spark, noise):
    n = 1_000_000 // len(noise)
    text = S["mit/notice"] + "\n" + noise * n + "\n" + S["mit/notice"]
    scan(spark, "warm up license " + S["mit/notice"])
    began = time.perf_counter()
    assert scan(spark, text)[0] in ("MIT", "")
    assert time.perf_counter() - began < 30
