import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prepkit.llm import turn_repair as t

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def all_repairs(rows, costs, inserts):
    """Every way of editing, with up to ``inserts`` turns anywhere."""
    made = ["user", "assistant"]

    def edits(role, text, fault):
        yield "D", costs.delete, None
        if fault not in (t.BLANK, t.DUPLICATE):
            extra = costs.truncated if fault == t.TRUNCATED else 0
            yield "K", extra, (role, text)
            for r in made:
                yield "R", costs.rerole + extra, (r, text)

    slots = [list(itertools.chain([()], *(itertools.product(made, repeat=k) for k in range(1, inserts + 1)))) for _ in range(len(rows) + 1)]
    for chosen in itertools.product(*slots):
        if sum(map(len, chosen)) > inserts:
            continue
        for way in itertools.product(*(edits(*r) for r in rows)):
            audit, cost, out = "", 0, []
            for i, added in enumerate(chosen):
                audit, cost, out = audit + "I" * len(added), cost + costs.insert * len(added), out + [(r, "") for r in added]
                if i < len(rows):
                    letter, price, turn = way[i]
                    audit, cost, out = audit + letter, cost + price, out + ([turn] if turn else [])
            if all(r for r, _ in out) and GRAMMAR.fullmatch("".join(r[0] for r, _ in out)):
                yield cost, audit, "\n".join(f"{r}:{x}" for r, x in out)


@pytest.mark.parametrize("costs", [t.Costs(), t.Costs(insert=1), t.Costs(insert=3, delete=2), t.Costs(rerole=3, insert=4, truncated=1)])
def test_least_of_all_repairs(costs):
    chance = random.Random(7)
    for _ in range(60):
        rows = [(chance.choice(["system", "user", "assistant", " ", ""]), f"t{i}", chance.choice([0, 0, 0, 1, 2, 3])) for i in range(chance.randint(0, 4))]
        path = t.Path(len(rows), costs)
        for r in rows:
            path.add(*r)
        cost, audit, text = min(all_repairs(rows, costs, 2))
        assert path.end() == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def test_no_insert_pays():
    """Default costs: with three inserts allowed anywhere, none is in a cheapest repair."""
    for roles in itertools.product(["system", "user", "assistant"], repeat=3):
        for faults in itertools.product([0, 3], repeat=3):
            rows = [(r, "x", f) for r, f in zip(roles, faults)]
            least = min(all_repairs(rows, t.Costs(), 3))
            assert "I" not in least[1]


def by_hand(rows):
    """The contract in plain Python: least (cost, audit) per state of the grammar, without inserts."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}
    talks, ids = defaultdict(list), set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talks[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv in ids:
        own = sorted(talks[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in own if r[0] is not None]
        faults, seen = [], set()
        best = {"": (0, "", [])}
        for _, role, text in own:
            signs = re.findall("[^\x20\x09-\x0d]", text)
            fault = 1 if not signs else 2 if (role, text) in seen else 3 if signs[-1] not in ".!?" else 0
            faults.append(fault)
            seen.add((role, text))
            ways = defaultdict(list)
            for state, (cost, audit, done) in best.items():
                ways[state].append((cost + 2, audit + "D", done))
                for letter, price, r in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    goal = follow[state].get(r[:1])
                    if fault not in (1, 2) and goal:
                        ways[goal].append((cost + price + 5 * (fault == 3), audit + letter, [*done, f"{r}:{text}"]))
            best = {state: min(found) for state, found in ways.items()}
        cost, audit, done = min(v for k, v in best.items() if k in ("", "p"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(done).encode()).hexdigest()
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd_rows():
    chance, rows = random.Random(11), []
    for c in range(120):
        for i in range(chance.choice([1, 2, 3, 6, 9])):
            role = chance.choice(["user", "assistant", "system", "tool", None, ""])
            rows.append((c, i if chance.random() > 0.1 else None, role, chance.choice(["Yes.", "No", "a?\n ", " \t", None, "", "👍", "Hm! é"])))
    rows += [(500, i // 2, "user" if i % 3 else "assistant", f"Turn {i}.") for i in range(900)]  # a long one with ties
    rows += [(501, 3, "user", "Same.")] * 3 + [(502, 0, "user", "word " * 30_000 + "."), (502, 1, "assistant", " " * 50_000)]
    rows += [(None, 1, "user", "No id."), (None, None, None, None)]
    chance.shuffle(rows)
    return rows


def test_against_plain_python(spark):
    rows = odd_rows()
    damaged = t.damage(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = t.decide(damaged)
    assert results(got) == by_hand(rows)
    texts = t.repaired(damaged, got)
    joined = {r["conv_id"]: r["x"] for r in texts.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").alias("x")
    ).collect()}
    for r in got.collect():
        assert hashlib.sha256(joined.get(r["conv_id"], "").encode()).hexdigest() == r["repaired_sha256"]


def test_repaired_with_inserts(spark):
    rows = [(1, 0, "user", "a.", False), (1, 1, "user", "b.", False), (2, 0, "system", "x.", False), (2, 1, "user", "y.", False)]
    rows = spark.createDataFrame(rows, SCHEMA + ", gone boolean")
    got = t.decide(rows, t.Costs(insert=1, rerole=9, delete=9))
    assert {r["conv_id"]: r["audit"] for r in got.collect()} == {1: "KIKI", 2: "KKI"}
    turns = [(r["conv_id"], r["role"], r["text"]) for r in t.repaired(rows, got).orderBy("conv_id", "place").collect()]
    assert turns == [(1, "user", "a."), (1, "assistant", ""), (1, "user", "b."), (1, "assistant", ""), (2, "system", "x."), (2, "user", "y."), (2, "assistant", "")]


def test_odd_tables(spark):
    assert results(t.decide(t.damage(spark.createDataFrame([], SCHEMA)))) == []
    extra = spark.createDataFrame([(4, 0, "user", "x", "mine", 1)], SCHEMA + ", fault string, gone int")
    assert len(results(t.decide(t.damage(extra)))) == 1


def test_all_rows_dropped(spark):
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert results(t.decide(t.damage(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA)))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_given_table(spark):
    from prepkit.llm.queries import registry

    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(registry.queries["op11_turn_repair"](spark, folder)) == by_hand(rows)


def test_one_shuffle(spark, plan):
    rows = t.damage(spark.createDataFrame([(4, 0, "user", "x")], SCHEMA))
    assert plan(t.decide(rows)).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
