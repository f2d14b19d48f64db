"""Personal data by candidates and boosted trees, on DataFrame functions only.

Generators propose spans with high recall: the base patterns for email, ip, card and phone, and looser forms of them (spelled-out
emails, cards in other groupings, phone numbers without a plus sign, strict forms with digits after them). Every candidate gets format features (digits,
groups, signs, Luhn, the parts' range, length) and context features (the characters before and after, a
word that names such data shortly before). Proposals may overlap.

Trees, one model for all kinds, learn from labelling rules: a base candidate is positive if its check holds, a looser
one if its check holds and its context or form supports it. All candidates of all documents count: they are summed up
per combination of features, label and fold, a table whose size depends on the features' ranges and
not on the documents; fixed examples of each form stand beside them, so that forms a corpus lacks are known too. A third of the documents is held
out from training and sets each kind's threshold: the lowest score from which on ``PRECISION`` of candidates are positive.

Base spans always stay. Looser spans are added where their score reaches the threshold and no base span and no better
looser span before them overlaps. ``redact`` puts a mark in the place of every run of overlapping spans.

Time grows with the length of a text and its number of matches: places are running sums by blocks, contexts and gaps are read from pieces of the
text, and only spans that overlap, directly or by others between them, are held against each other.

Defined results: a null text has no spans and stays null; an empty one has none; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.llm.boost import Trees, train
from prepkit.llm.common import aside
from prepkit.session import stage

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
CONTEXT = 24
#: Code points of a piece of text, and values of a block of running sums: both bound what is read or copied for one span.
PIECE = 256
BLOCK = 128
#: A threshold that no score reaches.
NEVER = 2.0


@dataclass(frozen=True)
class Generator:
    """``hint``: signs, none or those of which a match of ``pattern`` holds one at least."""

    kind: str
    base: bool
    hint: str
    pattern: str


# The base patterns start where a run of their signs starts, or where the last match ended: this
# keeps them linear on long runs and finds the same places as a search from every character.
GENERATORS = (
    Generator("email", True, "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Generator("ip", True, ".", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    Generator("card", True, "", r"[0-9](?:[\x20-]?[0-9])++"),
    Generator("phone", True, "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    Generator("email", False, "([", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[a-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[a-z0-9-]{2,24}){1,3}"),
    Generator("card", False, "", r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9])"),
    Generator("phone", False, "", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
    # Strict forms that a base pattern swallows together with digits that follow.
    Generator("card", False, "", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])"),
    Generator("phone", False, "+", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
)

# Words that name such data, per kind.
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|courriel|correo)[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|adresse)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta)[^\n]{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|telefon)[^\n]{0,12}$",
}

# Examples of each form, so that trees know forms that a corpus lacks. (text, whether personal)
EXAMPLES = (
    ("mail ann.lee (at) mail (dot) example.org now", True),
    ("write to bob[at]example[dot]com please", True),
    ("meet (at) noon (dot) then", False),
    ("card 4111.1111.1111.1111 was used", True),
    ("visa 5500_0000_0000_0004 expired", True),
    ("part 4111.1111.1111.1112 is out", False),
    ("code 1234/5678/9012/3456 printed", False),
    ("phone 555-123-4567 today", True),
    ("call (555) 123-4567 today", True),
    ("tel: 555.123.4567 today", True),
    ("pay 4111 1111 1111 1111 22 now", True),
    ("item 4111 1111 1111 1112 22 now", False),
    ("reach +1 (555) 123-4567 10.0.0.1 now", True),
    ("sum 555 123 4567 units", False),
    ("lot 123-456-7890 of parts", False),
)
EXAMPLE_WEIGHT = 5

_SPAN = "struct<gen:int,kind:int,start:int,stop:int,label:int,digits:int,groups:int,size:int,signs:int,luhn:int,range:int,cue:int,before:int,after:int>"
FEATURES = ("gen", "digits", "groups", "size", "signs", "luhn", "range", "cue", "before", "after")
OWN = ("candidates", "spans", "base_spans")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running merges (sums, maxima) of an array; ``merge`` takes a null for "nothing before".

    Done by blocks of ``BLOCK`` and then over the blocks, since an array that grows by one is copied at each step.
    """

    def plain(array: Column) -> Column:
        nothing = F.expr("cast(array() as array<bigint>)")
        return F.aggregate(array, nothing, lambda out, v: F.concat(out, F.array(merge(F.try_element_at(out, F.lit(-1)), v))))

    def blocked(array: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int"))
        own = F.transform(numbers, lambda i: plain(F.slice(array, i * BLOCK + 1, F.lit(BLOCK))))

        def joined(blocks: Column) -> Column:
            before = plain(F.transform(blocks, lambda k: F.try_element_at(k, F.lit(-1))))
            return bound(before, lambda ends: F.flatten(F.transform(blocks, lambda k, i: bound(F.get(ends, i - 1), lambda e: F.transform(k, lambda v: merge(e, v))))))

        return bound(own, joined)

    return bound(values, lambda array: F.when(F.size(array) > BLOCK, blocked(array)).otherwise(plain(array)))


def _plus(before: Column, value: Column) -> Column:
    return F.coalesce(before, F.lit(0).cast("bigint")) + value


def matches(text: Column, generator: Generator) -> Column:
    """Array of (match, code points up to its end from the end of the one before)."""
    parts = F.zip_with(
        F.regexp_extract_all(text, F.lit(generator.pattern), F.lit(0)), F.split(text, generator.pattern, -1),
        lambda m, s: F.struct(m.alias("m"), (F.length(s) + F.length(m)).cast("bigint").alias("step")),
    )
    there = text.rlike(generator.pattern)
    if generator.hint:
        there = reduce(or_, [text.contains(sign) for sign in generator.hint]) & there
    empty = F.expr("cast(array() as array<struct<m:string,step:bigint>>)")
    return F.when(there, F.filter(parts, lambda p: p["m"].isNotNull())).otherwise(empty)


def places(text: Column) -> Column:
    """Array of (generator, start, stop, match) of all generators' matches, in code points.

    The text is split at the matches; places are running sums of the lengths of pieces and matches.
    """

    def placed(found: Column, number: Column) -> Column:
        stops = running(F.transform(found, lambda p: p["step"]), _plus)
        return F.zip_with(found, stops, lambda p, stop: F.struct(
            number.alias("gen"), (stop - F.length(p["m"])).cast("int").alias("start"), stop.cast("int").alias("stop"), p["m"].alias("m")))

    return F.flatten(F.transform(F.array(*[matches(text, g) for g in GENERATORS]), placed))


def pieces_of(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, so that a part of it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points of the text from ``start`` on (from 0)."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + length) / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE + 1, length)


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    """The value of the kind; false for others."""
    chosen = F.lit(False)
    for name, value in values.items():
        chosen = F.when(kind == KINDS.index(name), value).otherwise(chosen)
    return chosen


def _kind_of_sign(sign: Column) -> Column:
    """0 none, 1 blank, 2 letter, 3 digit, 4 other."""
    return (
        F.when((sign == "") | sign.isNull(), 0).when(sign.rlike(r"^\s"), 1).when(sign.rlike(r"^\p{L}"), 2).when(sign.rlike(r"^[0-9]"), 3).otherwise(4)
    )


def _candidate(place: Column, digits: Column, context: Column, around: dict[str, Column]) -> Column:
    """Features and label of a span: its digits, the code points before it, and the signs on both sides."""
    number, start, stop, match = (place[n] for n in ("gen", "start", "stop", "m"))
    kind = F.get(F.array(*[F.lit(KINDS.index(g.kind)) for g in GENERATORS]), number)
    base = F.get(F.array(*[F.lit(g.base) for g in GENERATORS]), number)
    by_form = F.get(F.array(*[F.lit(g.kind == "card" or bool(g.hint)) for g in GENERATORS]), number)
    n = F.length(digits)
    luhn = n.between(12, 19) & F.call_function("luhn_check", digits)
    octets = (kind == KINDS.index("ip")) & match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    cue = _by_kind(kind, {k: context.rlike(c) for k, c in CUES.items()})
    valid = _by_kind(kind, {"email": F.lit(True), "ip": octets, "card": n.between(14, 19) & luhn, "phone": n.between(10, 15)})
    spelled = match.rlike(r"(?i)(?:[(\[]dot[)\]]|\.)\x20?[a-z]{2,6}$") & (cue | match.rlike(r"(?i)\[at\]"))
    label = F.when(base, valid).when(kind == KINDS.index("email"), spelled).when(by_form, valid).otherwise(valid & cue)
    values = {
        "gen": number, "kind": kind, "start": start, "stop": stop, "label": label,
        "digits": F.least(n, F.lit(24)),
        "groups": F.least(F.size(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))), F.lit(6)),
        "size": F.least(F.ceil(F.log2(F.length(match) + F.lit(1.0))), F.lit(8)),
        "signs": F.when(match.contains("("), 3).when(match.contains("."), 2).when(match.contains("-"), 1).otherwise(0),
        "luhn": luhn, "range": octets, "cue": cue,
        "before": _kind_of_sign(around["before"]), "after": _kind_of_sign(around["after"]),
    }
    return F.struct(*[F.coalesce(v.cast("int"), F.lit(0)).alias(n) for n, v in values.items()])


def candidates(text: Column) -> Column:
    """All proposals of all generators, as an array of spans with features and label."""

    def features(place: Column, pieces: Column) -> Column:
        # The context, the span's last sign and the one after it lie in at most a few pieces.
        start = F.greatest(place["start"] - CONTEXT, F.lit(0))
        context = part(pieces, start, F.least(place["start"], F.lit(CONTEXT)))
        after = part(pieces, place["stop"], F.lit(1))
        digits = F.regexp_replace(place["m"], "[^0-9]", "")
        own = F.struct(digits.alias("digits"), context.alias("context"), after.alias("after"))
        return bound(own, lambda o: _candidate(
            place, o["digits"], o["context"], {"before": F.when(place["start"] > 0, F.substring(o["context"], -1, 1)), "after": o["after"]}))

    found = bound(pieces_of(text), lambda pieces: F.transform(places(text), lambda p: features(p, pieces)))
    return F.when(text.isNotNull(), found).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _examples(spark: SparkSession) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(int(y)).alias("y")) for t, y in EXAMPLES])).alias("e")
    spans = spark.range(1).select(rows).select(F.col("e.y").alias("y"), F.explode(candidates(F.col("e.t"))).alias("c"))
    # An example speaks of the looser form it holds; the base pattern inside it keeps its own label.
    label = F.when(F.col("c.gen").isin([i for i, g in enumerate(GENERATORS) if g.base]), F.col("c.label")).otherwise(F.col("y"))
    cells = spans.select(*[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.kind").alias("kind"), label.alias("label"))
    return cells.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), F.lit(EXAMPLE_WEIGHT).cast("bigint").alias("n"))


def fit(found: DataFrame, key: str = "doc_id") -> tuple[Trees, dict[int, float]]:
    """Trees and thresholds per kind from the candidates of ``found``."""
    fold = (F.pmod(F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1).cast("int")
    spans = found.filter(F.size("candidates") > 0).select(fold.alias("fold"), F.explode("candidates").alias("c"))
    cells = spans.select(*[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.kind").alias("kind"), F.col("c.label").alias("label"), "fold")
    cells = cells.withColumn("n", F.lit(1).cast("bigint")).unionByName(_examples(found.sparkSession))
    # One row per combination of small whole numbers: its size does not follow the documents.
    rows = cells.groupBy(*FEATURES, "kind", "label", "fold").agg(F.sum("n").alias("n")).collect()
    rows = sorted(rows, key=lambda r: tuple(r))
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.float64)
    y, n, fold_of, kind = (np.array([r[c] for r in rows], np.float64) for c in ("label", "n", "fold", "kind"))
    learn = fold_of == 0
    trees = train(x[learn], y[learn], n[learn], bins=24)
    scores = trees.predict(x)
    loose = np.array([not GENERATORS[r["gen"]].base for r in rows])
    thresholds = {}
    for k in range(len(KINDS)):
        own = (fold_of == 1) & (kind == k) & loose
        thresholds[k] = threshold(scores[own], y[own], n[own])
    return trees, thresholds


def threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest score from which on, at each score, the share of positives is at least ``precision``."""
    best = NEVER
    for s in sorted(set(scores.tolist()), reverse=True):
        at = scores >= s
        if (weight * y)[at].sum() < precision * weight[at].sum():
            break
        best = s
    return max(best, 0.5)


def runs(spans: Column) -> Column:
    """Spans in order of their starts, as an array of arrays: those that overlap, also by others between them, together."""

    def cut(array: Column) -> Column:
        def at(ends: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(array) - 1)
            firsts = F.filter(places, lambda i: (i == 0) | (F.get(array, i)["start"] >= F.get(ends, i - 1)))
            return bound(firsts, lambda f: F.transform(f, lambda a, k: F.slice(array, a + 1, F.coalesce(F.get(f, k + 1), F.size(array)) - a)))

        return F.when(F.size(array) > 0, bound(running(F.transform(array, lambda s: s["stop"].cast("bigint")), F.greatest), at)).otherwise(
            F.slice(F.array(array), F.lit(1), F.lit(0)))

    return bound(spans, cut)


def select(found: DataFrame, trees: Trees, thresholds: dict[int, float]) -> DataFrame:
    """``found`` with ``base_spans`` and ``spans``, arrays of (start, kind, stop) in order, in place of the candidates."""
    base_of = [i for i, g in enumerate(GENERATORS) if g.base]
    kind = "array<struct<start:int,kind:int,stop:int>>"

    def triple(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))

    def scored(c: Column) -> Column:
        limit = F.lit(NEVER)
        for k, t in thresholds.items():
            limit = F.when(c["kind"] == k, F.lit(t)).otherwise(limit)
        score = trees.column([c[f] for f in FEATURES])
        return F.struct((-score).alias("order"), c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), (score + 1e-12 >= limit).alias("chosen"))

    base = F.array_sort(F.transform(F.filter("candidates", lambda c: c["gen"].isin(base_of) & (c["label"] == 1)), triple))
    loose = F.array_sort(F.filter(F.transform(F.filter("candidates", lambda c: ~c["gen"].isin(base_of)), scored), lambda c: c["chosen"]))
    with_base = found.withColumn("base_spans", F.when(F.size("candidates") > 0, base).otherwise(F.expr(f"cast(array() as {kind})")))

    def clear(taken: Column, c: Column) -> Column:
        return ~F.exists(taken, lambda t: (t["start"] < c["stop"]) & (c["start"] < t["stop"]))

    def settled(run: Column) -> Column:
        """Base spans of a run, and its looser ones from the best on that nothing taken overlaps."""
        taken = F.transform(F.filter(run, lambda c: c["order"].isNull()), triple)
        looser = F.array_sort(F.transform(F.filter(run, lambda c: c["order"].isNotNull()), lambda c: F.struct(c["order"], c["start"], c["kind"], c["stop"])))
        return F.aggregate(looser, taken, lambda taken, c: F.when(clear(taken, c), F.concat(taken, F.array(triple(c)))).otherwise(taken))

    def mixed(c: Column, order: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), order.alias("order"))

    every = F.array_sort(F.concat(F.transform("base_spans", lambda c: mixed(c, F.lit(None).cast("double"))), F.transform(loose, lambda c: mixed(c, c["order"]))))
    added = F.flatten(F.transform(runs(every), settled))
    spans = F.when(F.exists("candidates", lambda c: ~c["gen"].isin(base_of)), F.array_sort(added)).otherwise(F.col("base_spans"))
    return with_base.withColumn("spans", spans).drop("candidates")


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) with ``base_spans`` and ``spans``.

    Candidates are written once; training and selection read them. Input columns of the operator's names get an underscore in front.
    """
    docs = aside(docs, OWN)
    kept = [f"`{c}`" for c in (docs.columns if keep is None else keep)]
    found = stage(docs.select(*kept, candidates(F.col(f"`{text}`")).alias("candidates")), "pii-candidates")
    return select(found, *fit(found, key))


def count(spans: Column, kind: int) -> Column:
    """Spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The texts with a mark of the first span's kind in place of each run of overlapping spans."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    joined = F.transform(runs(F.col(spans)), lambda r: F.struct(
        F.get(r, F.lit(0))["start"].alias("start"), F.get(r, F.lit(0))["kind"].alias("kind"), F.array_max(F.transform(r, lambda s: s["stop"])).alias("stop")))

    def done(pieces: Column, marks: Column) -> Column:
        def marked(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(marks, i - 1)["stop"], F.lit(0))
            return F.concat(part(pieces, before, s["start"] - before), F.get(names, s["kind"]))

        last = F.try_element_at(marks, F.lit(-1))["stop"]
        rest = F.length(F.col(f"`{text}`")) - last
        return F.concat(F.array_join(F.transform(marks, marked), ""), part(pieces, last, rest))

    whole = F.col(f"`{text}`")
    changed = bound(pieces_of(whole), lambda pieces: bound(joined, lambda marks: done(pieces, marks)))
    return docs.withColumn(text, F.when(F.size(spans) > 0, changed).otherwise(whole))
