import re
import textwrap

import pytest
from gridquarry.llm import licenses as lc
from gridquarry.llm.queries import op3_licenses

SF = "/root/testdata/sf0.01"


def brute(text):
    """Short references by plain comparison of words, sentence by sentence."""
    out, at = [], 0
    short = {tuple(lc.words(t)): n for n, t in lc.TEMPLATES if len(t) < 100}
    for piece in re.split(r"(\n|(?<=[.!?;])[ \t]+)", text):
        if tuple(lc.words(piece)) in short:
            out.append(f"{short[tuple(lc.words(piece))]}:{at}:{at + len(piece)}")
        at += len(piece)
    return ",".join(out)


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op3_licenses(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.licenses == brute(docs[r.doc_id])
    assert sum(r.n_licenses for r in got) > 5


@pytest.mark.parametrize(("name", "text"), lc.TEMPLATES)
def test_every_template_is_told_from_the_others(name, text):
    wrapped = "\n".join(textwrap.wrap(text, 76))
    page = f"Some prose goes before it all.\n{wrapped}\nAnd other prose comes after, of no interest."
    found = lc.find(page)[1]
    assert [x["license"] for x in found] == [name]


def test_wording_differences_are_reported_and_numbers_decide():
    text = lc.TEMPLATES[3][1].replace("associated", "accompanying")
    found = lc.find(text)[1]
    assert (found[0]["license"], found[0]["missing"], found[0]["extra"]) == ("MIT", ["associated"], ["accompanying"])
    assert lc.find("Licensed under the Apache License, Version 3.0.")[1] == []
    assert lc.find("A license to drive is needed on public roads.")[1] == []


def test_odd_rows(spark):
    line = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, line), (3, line), (None, line), (4, ("some long words here. " * 20_000) + "\n" + line), (5, "license " * 3000), (6, "é\n" + line + " " + line)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, licenses string")
    got = lc.scan(frame).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: len(r.licenses) for r in got} == {1: 0, 2: 0, 3: 1, None: 1, 4: 1, 5: 0, 6: 2}
    assert lc.scan(frame.limit(0)).count() == 0


APACHE, UNLESS, MIT = lc.TEMPLATES[6][1], lc.TEMPLATES[7][1], lc.TEMPLATES[3][1]


def names(text):
    return [x["license"] for x in lc.find(text)[1]]


def test_notices_that_follow_each_other_are_all_found():
    wrap = lambda t: "\n".join(textwrap.wrap(t, 76))
    short = "Licensed under the Apache License, Version 2.0."
    assert names(wrap(APACHE) + "\n\n" + wrap(UNLESS)) == ["Apache-2.0"] * 2
    assert names(wrap(APACHE + " " + UNLESS)) == ["Apache-2.0"] * 2
    assert names(wrap(MIT) + "\n" + short) == ["MIT", "Apache-2.0"]
    assert names(short + "\n" + wrap(MIT)) == ["Apache-2.0", "MIT"]
    assert names(wrap(lc.TEMPLATES[10][1]) + "\nReleased under the MIT License.") == ["BSD-3-Clause", "MIT"]
    assert names(wrap(MIT + " " + MIT)) == ["MIT"] * 2
    assert names(wrap(MIT.replace("associated", "accompanying")) + "\n" + short) == ["MIT", "Apache-2.0"]
    text = short + " " + wrap(MIT)
    assert [text[x["start"] : x["end"]] for x in lc.find(text)[1]] == [short, wrap(MIT)]


def test_every_spdx_expression_is_found():
    text = "// SPDX-License-Identifier: MIT OR Apache-2.0\n// SPDX-License-Identifier: ISC.\nReleased under the MIT License.\n"
    assert names(text) == ["MIT OR Apache-2.0", "ISC", "MIT"]
    assert [text[x["start"] : x["end"]] for x in lc.find(text)[1]][:2] == ["SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: ISC"]


def test_short_references_inside_sentences_do_not_count():
    assert names("It was not released under the MIT License.") == []
