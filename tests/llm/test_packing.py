import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prepkit.llm import packing as p
from tests.llm.helpers import clashing, no_documents, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB'sIİΣσéŒſªµ×ÿ.,;-_ \n\t\x0b\x85\xa0́　٣1<|>你👍")) | st.text())
def test_ids_are_those_of_the_whole_text(tokenizer, text):
    want = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert np.frombuffer(p.token_bytes(text, PATH), "<u4").tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(0, 60))
def test_fill_is_closest(counts, target):
    reach = {0}
    for n, c in counts.items():
        reach = {r + k * n for r in reach for k in range(c + 1) if r + k * n <= target}
    best, taken = p.fill(counts, target)
    assert best == max(reach) == sum(n * c for n, c in taken.items())
    assert all(c <= counts[n] for n, c in taken.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 200), max_size=20))
def test_plan_places_every_token_once(histogram):
    plan, used, covered = p.Plan(histogram, 64), defaultdict(list), defaultdict(list)
    intervals = plan.by_length()
    for n, count in histogram.items():
        for rank in range(count):
            pieces = p.pieces_of(n, rank, 0, intervals, plan.sequences, 64)
            covered[n, rank] = sorted((s, s + l) for s, l, _, _ in pieces)
            for _, length, sequence, offset in pieces:
                used[sequence].append((offset, offset + length))
    for (n, _), spans in covered.items():
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for spans in used.values():
        spans.sort()
        total = spans[-1][1]
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert total == 64 or total & (total - 1) == 0  # no padding at all
    assert sorted(used) == list(range(plan.sequences))


@pytest.mark.parametrize("longest", [59, 79, 200])
def test_many_lengths_are_not_padded(longest):
    plan = p.Plan({n: 1 for n in range(1, longest + 1)}, 4096)
    used = defaultdict(int)
    for origin, lo, hi, _, length, first, each, done, offset in plan.rows:
        for rank in range(hi - lo):
            used[first + (done + rank) // each] += length
    assert sum(used.values()) == longest * (longest + 1) // 2
    assert all(n == 4096 or n & (n - 1) == 0 for n in used.values())


def check_rows(rows, texts, tokenizer):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]]
        assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
        for r in pieces:
            raw = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert raw == bytes(r["ids"]) and zlib.crc32(raw) == r["ids_crc32"]
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= 4096


def test_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    rows = p.pack(docs.select("doc_id", "text"), PATH).collect()
    check_rows(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)


def test_odd_rows(spark, tokenizer):
    docs = clashing(odd_documents(spark), ["start", "ids", "__rank"])
    rows = p.pack(docs, PATH).collect()
    assert all(r["start"] == "mine" and r["__rank"] == "mine" for r in rows)
    again = Counter(r["doc_id"] for r in rows if r["_start"] == 0)
    assert again == Counter(r["doc_id"] for r in docs.collect())
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).drop("start", "ids", "__rank")
    check_rows(p.pack(unique, PATH).collect(), [(r["doc_id"], r["text"]) for r in unique.collect()], tokenizer)
    assert p.pack(no_documents(spark), PATH).count() == 0
