import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prepkit.llm import byte_bpe as b
from tests.llm.helpers import ODD_TEXTS, clashing, no_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = st.text(alphabet=st.sampled_from("abthe'sl 1٣½²́  \x1c\x85　é你\n\t.,!_")) | st.text()


@pytest.fixture(scope="module")
def public():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_pattern_is_the_public_one():
    assert b.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_ids_are_the_library_s(public, text):
    own = b.vocabulary(PATH)
    made = own.encode(text)
    assert ids_of(made) == public.encode_ordinary(text)
    assert own.decode(made) == text.encode()


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=[chr(i) for i in range(128)]))
def test_ascii_splits_alike(text):
    split = b.Splitter()
    assert split(text) == split.findall(text)


def test_room_for_units_changes_no_id(monkeypatch, public):
    monkeypatch.setattr(b, "KEPT_UNITS", 3)
    own = b.Vocabulary(PATH)
    for text in ["one two three four", "one two, five six!", "seven " * 3]:
        assert ids_of(own.encode(text)) == public.encode_ordinary(text) and len(own) <= 3


def test_every_sign_splits_alike():
    """Pairs of a sign's last byte and a letter, digit, blank or point are tokens here, so each split shows in the ids."""
    follow = b"a1 ."
    ranks = {bytes([i]): i for i in range(256)}
    for f in follow:
        for i in range(256):
            if bytes([i, f]) not in ranks:
                ranks[bytes([i, f])] = len(ranks)
    public = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces, bad = b.Splitter(), []
    for code in range(0x30000):
        if 0xD800 <= code < 0xE000:
            continue
        sign = chr(code)
        for f in follow:
            text = sign + chr(f)
            own = [p for u in b.UNIT.findall(text) for p in pieces(u)]
            if (len(own) == 1) != (len(public.encode_ordinary(text)) == len(text.encode()) - 1):
                bad.append(text)
    assert not bad


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aehtxX 你é-", min_size=1, max_size=60), st.data())
def test_appends_and_edits_are_exact(text, data):
    own, raw = b.vocabulary(PATH), text.encode()
    cut = data.draw(st.integers(0, len(raw)))
    table = b.Prefixes(own, raw[:cut])
    table.append(raw[cut:])
    assert table.last == b.Prefixes(own, raw).last
    start = data.draw(st.integers(0, len(raw)))
    end = data.draw(st.integers(start, len(raw)))
    new = data.draw(st.binary(max_size=8))
    table.edit(start, end, new)
    assert table.last == b.Prefixes(own, raw[:start] + new + raw[end:]).last
    assert [own.bytes[i] for i in table.ids()] == own.merged(raw[:start] + new + raw[end:])


def test_an_edit_works_out_few_entries():
    own, chance = b.vocabulary(PATH), random.Random(5)
    raw = bytes(chance.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    table = b.Prefixes(own, raw)
    done = table.edit(9_000, 9_003, b"zz")
    assert done < 3 * own.longest
    assert table.last == b.Prefixes(own, raw[:9_000] + b"zz" + raw[9_003:]).last


@settings(max_examples=500, deadline=None)
@given(TEXTS, TEXTS, TEXTS, TEXTS)
def test_near_edit(public, left, old, new, right):
    own = b.vocabulary(PATH)
    made, _ = b.near_edit(own, left + old + right, own.encode(left + old + right), left + new + right)
    assert ids_of(made) == public.encode_ordinary(left + new + right)


def test_documents(spark, public):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from prepkit.llm.queries import registry

    rows = {r["doc_id"]: r for r in registry.queries["op13_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        ids, got = public.encode_ordinary(r["text"] or ""), rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert len(rows) == docs.count()


def test_odd_rows(spark, public):
    docs = clashing(odd_documents(spark), ["ids", "decoded"])
    rows = b.decode(b.encode(docs, PATH), PATH).collect()
    assert len(rows) == docs.count() and all(r["_ids"] == "mine" and r["_decoded"] == "mine" for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(ODD_TEXTS):
        assert ids_of(bytes(by_id[i]["ids"])) == public.encode_ordinary(text or "")
        assert bytes(by_id[i]["decoded"]) == (text or "").encode()
    assert b.encode(no_documents(spark), PATH).count() == 0


def test_reencode(spark, public):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    changed = docs.withColumn("changed", F.concat(F.substring("text", 1, 300), F.lit(" inserted words, "), F.expr("substring(text, 310)")))
    encoded = b.encode(changed.withColumn("t", F.col("text")), PATH, "t")
    rows = b.reencode(encoded, PATH, "text", "changed").collect()
    for r in rows:
        assert ids_of(bytes(r["new_ids"])) == public.encode_ordinary(r["changed"])
    long = [r for r in rows if len(r["changed"]) > 2_000]
    assert long and all(r["n_again"] < 200 for r in long)
