from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prepkit.llm import quality_rules as q
from tests.llm.helpers import clashing, no_documents, odd_documents


def slow_repeats(words, w=8):
    grams = [tuple(words[i : i + w]) for i in range(len(words) - w + 1)]
    found = Counter(grams)
    return len({j for i, g in enumerate(grams) if found[g] > 1 for j in range(i, i + w)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeated_words(words):
    assert q.repeated_words(words) == slow_repeats(words)


def test_counts():
    f = q.features_of("a# b\xa0c\n\n x \n x \ny$|\n\x1c")
    assert f == {"n_words": 6, "word_chars": 11, "n_symbols": 3, "n_lines": 5, "n_dup_lines": 1, "n_repeat_words": 0}


def test_odd_rows(spark):
    out = q.quality_rules(clashing(odd_documents(spark), ["kept", "n_words"])).collect()
    assert len(out) == 14 and all(r["_kept"] == "mine" and r["_n_words"] == "mine" for r in out)
    assert all(not r["kept"] for r in out if not (r["text"] or "").strip())
    assert q.quality_rules(no_documents(spark)).count() == 0


def test_threshold_follows_the_group(spark):
    """A symbol rate that is usual in one source is odd in another."""
    plain, marked = "word " * 100, "word " * 100 + "# " * 50
    rows = [(i, plain + str(i), "en", "prose", 0) for i in range(80)] + [(100 + i, marked + str(i), "en", "code", 0) for i in range(80)]
    rows += [(500, marked, "en", "prose", 0), (501, marked, "en", "code", 0), (502, marked, "en", "rare", 0)]
    docs = spark.createDataFrame([(i, t.replace("word", f"w{i}x"), l, s, n) for i, t, l, s, n in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("doc_id", "regexp_replace(text, '(w[0-9]+x) ', '$1') as t", "text", "lang", "source", "n_chars").drop("t")
    measured = q.measure(docs)
    limits = {(r["source"]): r["fence_symbol_rate"] for r in q.fences(q.sketch(measured)).collect()}
    assert limits["prose"] < 333 < limits["code"]
    assert limits["rare"] is not None  # judged by its language


def test_sketch_accuracy(spark):
    values = spark.range(1, 5001).selectExpr("'en' lang", "'s' source", "id as symbol_rate", "0L as dup_line_rate", "0L as repeat_rate", "0L as word_length")
    row = q.quantiles(q.sketch(values), ["lang", "source"]).filter("measure = 'symbol_rate'").first()
    assert row["mid"] == pytest.approx(2500, rel=q.ACCURACY + 1e-3) and row["high"] == pytest.approx(3750, rel=q.ACCURACY + 1e-3)


def test_each_measure_rejects_what_base_rules_keep(spark):
    """One text per measure that only this measure rejects, in a clean source."""
    words = [f"w{i:03}" for i in range(100)]
    lines = [" ".join(words[5 * i : 5 * i + 5]) for i in range(20)]
    odd = {
        "symbol_rate": " ".join(words) + " " + "# " * 30,
        "dup_line_rate": "\n".join([f"{w} a b c d e f" for w in words[:11]] + ["same"] * 10),
        "repeat_rate": " ".join(words[:72] + words[80:94] + words[80:94]),
        "word_length": " ".join(w * 6 for w in words),
    }
    rows = [(i, "\n".join(lines), "en", "prose", 0) for i in range(80)] + [(100 + i, t, "en", "prose", 0) for i, t in enumerate(odd.values())]
    judged = q.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = {r["doc_id"]: r for r in judged.collect()}
    assert all(got[i]["kept"] for i in range(80))
    for i, name in enumerate(odd):
        r = got[100 + i]
        assert not r["base_failed"] and not r["kept"], name
        assert [m for m in q.MEASURES if r[m] > r[f"fence_{m}"]] == [name]


def test_the_groups_set_their_fences(spark):
    """On a given table fences differ between groups, and the least distance decides in few of them."""
    measured = q.measure(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), keep=["doc_id", "lang", "source"])
    sketches = q.sketch(measured.filter("not base_failed"))
    rows = q.fences(sketches).toPandas()
    for m in q.MEASURES:
        assert rows[f"fence_{m}"].nunique() > len(rows) / 3, m
    free = q.MEASURES.copy()
    try:
        for m, (sql, reach, _) in free.items():
            q.MEASURES[m] = (sql, reach, 0.0)
        unbound = q.fences(sketches).toPandas()
    finally:
        q.MEASURES.update(free)
    both = rows.merge(unbound, on=["lang", "source"], suffixes=("", "_free"))
    for m in q.MEASURES:
        assert (both[f"fence_{m}"] != both[f"fence_{m}_free"]).mean() < 0.1, m


def test_small_groups_are_drawn_to_their_parents(spark):
    """One odd document alone in its group does not set its own fence; many of them do."""
    rows = [("en", "a", 0, 0, 0, 500)] * 500 + [("en", "b", 2000, 0, 0, 500)] + [("en", "c", 2000, 0, 0, 500)] * 1000
    sketches = q.sketch(spark.createDataFrame(rows, "lang string, source string, symbol_rate bigint, dup_line_rate bigint, repeat_rate bigint, word_length bigint"))
    one, many = (q.fences(s).filter("source = 'b'").first()["fence_symbol_rate"] for s in (sketches.filter("source <> 'c'"), sketches))
    assert one < 2000 < many


def test_failed_documents_do_not_set_fences(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {i}", "en", "s") for i in range(60)]
    fences = [q.quality_rules(spark.createDataFrame(rows + more, "doc_id bigint, text string, lang string, source string")).filter("doc_id < 60").select("fence_symbol_rate", "fence_word_length").distinct().collect()
              for more in ([], [(100 + i, "#### " * 10, "en", "s") for i in range(500)])]
    assert fences[0] == fences[1] and len(fences[0]) == 1
