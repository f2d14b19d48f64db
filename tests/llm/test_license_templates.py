import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prepkit.llm import license_templates as lt
from prepkit.llm.oracles import _template_regex
from tests.llm.helpers import clashing, no_documents, odd_documents


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["a <<any 2>> b", "a <<optional>> b <<any 1>> <<end>> c", "a <<optional>> b <<optional>> c <<end>> <<end>> a b"]), st.lists(st.sampled_from("abcx"), max_size=9))
def test_automaton_accepts_what_the_regular_expression_does(markup, words):
    made = lt.Automaton.compile("t", markup)
    encoded = [w.encode() for w in words]
    found = any(made.accepts(encoded, i) for i in range(len(words)))
    assert found == bool(re.search(_template_regex(markup)[0], " " + " ".join(words) + " "))


@pytest.mark.parametrize("markup", ["<<optional>> a", "a <<end>>", "<<any 3>>", "<<any 2>> a", "a <<other>>", "<<optional>> a <<end>>"])
def test_bad_markup(markup):
    with pytest.raises(ValueError):
        lt.Automaton.compile("t", markup)


def test_text():
    out = lt.scan_text("Ünder the MIT  License.\nReleased under the mit-license; Copyright (c) 2020 A. Bé. All rights reserved".encode())
    assert out["n_base"] == 2 and (out["first_word"], out["last_word"]) == (2, 7)
    assert out["base_labels"] == "mit" and out["labels"] == "mit,mit-notice,reserved"
    assert out["score"] == pytest.approx(5 / 6)
    assert lt.scan_text(b"licensed under the apache license, version 2.1")["labels"] == "apache"
    assert lt.scan_text(b"")["first_word"] is None


def test_odd_rows(spark):
    rows = lt.scan_licenses(clashing(odd_documents(spark), ["labels"])).collect()
    assert len(rows) == 14 and all(r["_labels"] == "mine" and r["labels"] == "" for r in rows)
    assert {r["n_words"] for r in rows if r["text"] is None} == {0}
    assert lt.scan_licenses(no_documents(spark)).count() == 0
