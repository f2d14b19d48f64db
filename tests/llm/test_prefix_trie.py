import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from prepkit.llm import prefix_trie as p

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest_order(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    """The contract by lists and dictionaries."""
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, digest_order(role or "", text or ""), role or "", text or ""))
    talks = {c: [x[3:] for x in sorted(t)] for c, t in talks.items()}
    again = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))  # below zero the remainder has the sign of the number, as in SQL
        again[c] = talks.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, s in sorted(again.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    inner = {n[:-1] for n in members if n}
    for n, who in members.items():
        if n:
            children[n[:-1]] += 1
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(who) - 1) * (len(n[-1][1]) if n else 0)
            leaves[n[:d]] += n not in inner
    out = []
    for n, who in members.items():
        ends = ",".join(str(c) for c in who if len(again[c]) == len(n))
        out.append((who[0], len(n), members[n[:-1]][0] if n else None, len(who), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(spark, rows):
    return sorted((tuple(r) for r in p.trie(p.rebuilt(p.numbered(spark.createDataFrame(rows, SCHEMA)))).collect()), key=repr)


def talk(c, *turns):
    return [(c, i, *t) for i, t in enumerate(turns)]


def test_against_lists(spark, monkeypatch):
    monkeypatch.setattr(p, "RUN_SIGNS", 20)
    chance, rows = random.Random(3), []
    for c in chance.sample(range(450), 160):
        n = chance.choice([1, 1, 2, 4, 5, 8, 9, 13])
        rows += talk(c, *[(chance.choice(["user", "assistant"]), chance.choice(["a", "bb", "👍", ""])) for _ in range(n)])
    rows += [r for c in range(500, 600) for r in talk(c, *[("user", "same"), ("assistant", "copy")] * 3)]  # copies
    rows += talk(700, *[("user", f"turn {i % 7}") for i in range(90)]) + talk(701, *[("user", f"turn {i % 7}") for i in range(88)])  # many blocks
    rows += [(31, None, "user", "first"), (31, 2, None, None), (31, 2, "user", "tie"), (31, 2, "user", "tie"), (32, 0, None, "x" * 5000)]
    rows += [(None, 1, "user", "no conversation"), (-130, 0, "user", "a"), (-130, 1, "user", "b"), (-100, 0, "user", "c")]
    chance.shuffle(rows)
    assert made(spark, rows) == brute(rows)


def test_no_turns_left(spark):
    # Conversations whose own turns all lie before h and whose base is missing.
    ids = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 > 2]
    rows = [r for c in ids for r in talk(c, ("user", "a"), ("assistant", "b"))]
    got = made(spark, rows)
    assert got == brute(rows) and got[0][1] == 0 and len(got) == 1


def test_odd_tables(spark):
    assert made(spark, []) == []
    extra = spark.createDataFrame([(1, 0, "user", "x", "mine", 5)], SCHEMA + ", depth string, key1 int")
    (row,) = [r for r in p.trie(p.rebuilt(p.numbered(extra))).collect() if r["depth"] == 0]
    assert row["n_convs"] == 1


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_given_table(spark, folder):
    from prepkit.llm.queries import registry

    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in registry.queries["op12_prefix_trie"](spark, folder).collect()), key=repr)
    assert got == brute(rows)


def test_one_rollup_shape(spark, plan):
    rows = spark.createDataFrame(talk(1, ("user", "a")), SCHEMA)
    parts = p.rebuilt(p.numbered(rows))
    text = plan(p._rolled(p.blocks(parts), "count(*) AS n"))
    assert "Expand" in text and "spark_grouping_id" in text
