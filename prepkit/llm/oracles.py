"""DuckDB SQL that says what queries of this subpackage return. Written apart from the operators."""

from __future__ import annotations

import re

from prepkit.llm import license_templates as licenses
from prepkit.llm import mixing as mix
from prepkit.llm import quality_rules as rules


def quality_rules(docs: str = "documents", columns: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    """Counts by lists of words and lines, thresholds by counts of buckets."""
    gamma = repr(rules.GAMMA)
    rates = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, CAST({reach} AS DOUBLE) AS reach, CAST({least} AS DOUBLE) AS least, {m} AS value FROM rated WHERE NOT base_failed AND {m} IS NOT NULL"
        for m, (_, reach, least) in rules.MEASURES.items()
    )
    over = " OR ".join(f"coalesce({m} > {m}_fence, false)" for m in rules.MEASURES)
    picks = ", ".join(f"max(CASE WHEN measure = '{m}' THEN floor(fence) END) AS {m}_fence" for m in rules.MEASURES)

    def level(keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        return f"""SELECT {by}, any_value(reach) AS reach, any_value(least) AS least, max(total) AS n_rows, max(mid) AS mid,
              (CAST(sum(CASE WHEN v > mid THEN s ELSE 0 END) AS DOUBLE) - max(mid) * CAST(sum(CASE WHEN v > mid THEN n ELSE 0 END) AS DOUBLE)) / max(total) AS excess
            FROM (SELECT *, min(CASE WHEN up_to * 2 >= total THEN v END) OVER (PARTITION BY {by}) AS mid
              FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY v) AS up_to, sum(n) OVER (PARTITION BY {by}) AS total
                FROM (SELECT {by}, reach, least, v, count(*) AS n, sum(value) AS s FROM valued GROUP BY ALL)))
            GROUP BY {by}"""

    def drawn(column: str, child: str, parent: str) -> str:
        weight = f"{child}.n_rows / ({child}.n_rows + {rules.PARENT_ROWS})"
        return f"{weight} * {child}.{column} + (1 - {weight}) * {parent}.{column} AS {column}"

    return f"""
    WITH numbered AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
    worded AS (
      SELECT *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM numbered),
    windows AS (
      SELECT rid, p, array_to_string(words[p : p + 7], ' ') AS w
      FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS p FROM worded)),
    covered AS (
      SELECT rid, count(DISTINCT q) AS n_repeat_words
      FROM (SELECT rid, unnest(range(p, p + 8)) AS q
            FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, w) AS c FROM windows) WHERE c > 1)
      GROUP BY rid),
    lines AS (
      SELECT rid, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) - count(DISTINCT l) AS BIGINT) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM numbered)
      WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
    counted AS (
      SELECT w.*, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words
      FROM worded w LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)),
    rated AS (
      SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED_PERCENT} * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words END AS symbol_rate,
        CASE WHEN n_words > 0 THEN 1000 * n_dup_lines // n_lines END AS dup_line_rate,
        CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS repeat_rate,
        CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS word_length
      FROM counted),
    valued AS (
      SELECT lang, source, measure, reach, least, value,
        CASE WHEN value = 0 THEN 0 ELSE 2 / (1 + {gamma}) * pow({gamma}, ceil(ln(value) / ln({gamma}))) END AS v
      FROM ({rates})),
    by_source AS ({level("lang, source")}), by_lang AS ({level("lang")}), whole AS ({level("")}),
    langs AS (SELECT l.lang, l.measure, {drawn("mid", "l", "w")}, {drawn("excess", "l", "w")} FROM by_lang l JOIN whole w USING (measure)),
    groups AS (
      SELECT s.lang, s.source, s.measure, s.reach, s.least, {drawn("mid", "s", "l")}, {drawn("excess", "s", "l")}
      FROM by_source s JOIN langs l ON s.lang IS NOT DISTINCT FROM l.lang AND s.measure = l.measure),
    chosen AS (SELECT lang, source, measure, mid + greatest(reach * excess, least + CAST({2 * rules.ACCURACY} AS DOUBLE) * mid) AS fence FROM groups),
    fences AS (SELECT lang, source, {picks} FROM chosen GROUP BY lang, source),
    judged AS (
      SELECT r.*, NOT base_failed AND NOT ({over}) AS kept
      FROM rated r LEFT JOIN fences f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source)
    SELECT {columns} FROM judged"""


def mixing(docs: str = "documents") -> str:
    """Copies by counting the Poisson terms below each document's number."""

    def drawn(seed: int, *parts: str) -> str:
        text = " || '|' || ".join([f"'{seed}'", *(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)])
        return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"

    return f"""
    WITH sizes AS (SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS DOUBLE) AS bytes FROM {docs} GROUP BY source),
    rates AS (
      SELECT source, CASE WHEN bytes > 0 THEN
        (SELECT sum(bytes) FROM sizes) / (SELECT count(*) FROM sizes WHERE bytes > 0) / bytes END AS rate FROM sizes),
    terms AS (
      SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS up_to
      FROM (SELECT source, rate, unnest(range(0, CAST(floor(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rates WHERE rate IS NOT NULL)),
    counts AS (
      SELECT source, k, up_to, coalesce(lag(up_to) OVER (PARTITION BY source ORDER BY k), 0) AS before FROM terms),
    numbered AS (SELECT row_number() OVER () AS rid, doc_id, source, {drawn(mix.SEED, "doc_id")} / 4503599627370496.0 AS u FROM {docs}),
    copied AS (
      SELECT n.doc_id, n.source, CASE WHEN r.rate IS NULL THEN 1 ELSE c.k END AS n_copies
      FROM numbered n JOIN rates r ON n.source IS NOT DISTINCT FROM r.source
      LEFT JOIN counts c ON n.source IS NOT DISTINCT FROM c.source AND n.u >= c.before AND n.u < c.up_to),
    exploded AS (
      SELECT doc_id, source, CAST(n_copies AS BIGINT) AS n_copies, unnest(range(0, n_copies)) AS copy_no FROM copied WHERE n_copies > 0)
    SELECT doc_id, source, n_copies, copy_no, {drawn(mix.SEED + 1, "doc_id", "copy_no")} AS shuffle_key FROM exploded"""


def _template_regex(markup: str) -> tuple[str, int]:
    """A template as a regular expression over words that each have a blank before, and its mandatory words."""
    out, mandatory, depth = [], 0, 0
    for token in re.findall(r"<<[^>]*>>|\S+", markup):
        if token == "<<optional>>":
            out.append("(?:")
            depth += 1
        elif token == "<<end>>":
            out.append(")?")
            depth -= 1
        elif token.startswith("<<any"):
            out.append("(?: [^ ]+){0,%s}" % token[6:-2])
        else:
            out.append(" " + token)
            mandatory += not depth
    return "".join(out) + " ", mandatory


def license_templates(docs: str = "documents") -> str:
    """Phrases by lists of words, templates by regular expressions over the words."""
    templates = [(label, *_template_regex(markup)) for label, markup in licenses.TEMPLATES]
    found = ", ".join(f"CASE WHEN regexp_matches(line, '{regex}') THEN '{label}' END" for label, regex, _ in templates)
    sizes = ", ".join(f"CASE WHEN regexp_matches(line, '{regex}') THEN {n} END" for _, regex, n in templates)
    phrases = [(p.split(), label) for p, label in licenses.BASE_PHRASES.items()]
    at = " || ".join(
        "list_filter(range(0, len(words)), lambda i: " + " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(ws)) + ")" for ws, _ in phrases
    )
    base = ", ".join(f"CASE WHEN contains(line, ' {' '.join(ws)} ') THEN '{label}' END" for ws, label in phrases)
    base_sizes = ", ".join(f"CASE WHEN contains(line, ' {' '.join(ws)} ') THEN {len(ws)} END" for ws, _ in phrases)

    def joined(items: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list_filter([{items}], lambda x: x IS NOT NULL))), ',')"

    return f"""
    WITH worded AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {docs}),
    lined AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line, {at} AS places FROM worded),
    scanned AS (
      SELECT *, {joined(base)} AS base_labels, {joined(base + ", " + found)} AS labels, greatest(0, {sizes}, {base_sizes}) AS strongest FROM lined)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word,
      CAST(list_max(places) AS BIGINT) AS last_word, base_labels, labels, CAST(strongest AS DOUBLE) / (strongest + 1) AS score
    FROM scanned"""


def crc32(text: str) -> str:
    """CRC-32 of a text of ASCII signs, bit by bit."""
    signs = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295, {signs}), lambda c, b: {step}), 4294967295)"


def prefix_trie() -> str:
    """Prefixes as lists of turns; every sum by joins with all nodes below."""
    h = crc32("CAST(conv_id AS VARCHAR)")
    return f"""
    WITH turns AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || t)) - 1 AS pos, {{'r': r, 't': t}} AS x
      FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base FROM turns),
    shared AS (SELECT conv_id, base, {h} % 6 AS h FROM convs),
    parts AS (
      SELECT s.conv_id, 1 AS part, t.pos, t.x FROM shared s JOIN turns t ON t.conv_id = s.base AND t.pos < s.h
      UNION ALL SELECT s.conv_id, 2, t.pos, t.x FROM shared s JOIN turns t ON t.conv_id = s.conv_id AND t.pos >= s.h),
    seqs AS (
      SELECT c.conv_id, coalesce(list(p.x ORDER BY p.part, p.pos) FILTER (p.x IS NOT NULL), []) AS s FROM convs c LEFT JOIN parts p USING (conv_id) GROUP BY c.conv_id),
    members AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seqs),
    nodes AS (
      SELECT s[1 : d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(len(s[1 : d][d].t), 0) AS chars,
        string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d) AS ending
      FROM members GROUP BY ALL),
    kids AS (SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
    full_nodes AS (SELECT a.*, coalesce(k.n_children, 0) AS n_children FROM nodes a LEFT JOIN kids k ON k.p = a.p AND k.d = a.d),
    below AS (
      SELECT a.p, a.d, sum((b.n - 1) * b.chars) AS saved, count(*) FILTER (b.n_children = 0) AS leaves
      FROM (SELECT p, d, unnest(range(0, d + 1)) AS e, n, chars, n_children FROM full_nodes) b JOIN nodes a ON a.d = b.e AND a.p = b.p[1 : b.e] GROUP BY ALL)
    SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(a.n AS BIGINT) AS n_convs, CAST(a.n_children AS BIGINT) AS n_children,
      CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ending, '')) AS ends_sha256
    FROM full_nodes a JOIN below b ON a.p = b.p AND a.d = b.d LEFT JOIN nodes u ON u.d = a.d - 1 AND u.p = a.p[1 : a.d - 1]"""


def turn_repair() -> str:
    """Least (cost, audit) per state of the grammar, row by row, with at most one insert before each row and at the end."""
    kind = crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    white = "\\x20\\x09-\\x0D"
    follow = "(VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'p'), ('p', 'u', 'u')) f(q, initial, goal)"
    inserts = "(VALUES ('', 'user', 'u'), ('s', 'user', 'u'), ('u', 'assistant', 'p'), ('p', 'user', 'u')) g(q, role, goal)"
    inserted = f"""
        SELECT d.conv_id, d.i, d.q, d.w FROM dp d
        UNION ALL SELECT d.conv_id, d.i, g.goal, {{'cost': d.w.cost + 5, 'audit': d.w.audit || 'I', 'done': list_append(d.w.done, g.role || ':')}} FROM dp d JOIN {inserts} ON g.q = d.q"""
    return f"""
    WITH RECURSIVE coded AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {kind} % 20 AS kind FROM conversations),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
    judged AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
          WHEN NOT regexp_matches(text, '[.!?][{white}]*$') THEN 3 ELSE 0 END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
      FROM placed),
    ids AS (SELECT conv_id, CAST(sum(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM coded GROUP BY conv_id),
    dp AS (
      SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS q, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'done': CAST([] AS VARCHAR[])}} AS w FROM ids
      UNION ALL
      SELECT conv_id, i, q, min(w) FROM (
        WITH ahead AS ({inserted}),
        step AS (SELECT a.q, a.w, j.* FROM ahead a JOIN judged j ON j.conv_id IS NOT DISTINCT FROM a.conv_id AND j.i = a.i + 1)
        SELECT conv_id, i, q, {{'cost': w.cost + 2, 'audit': w.audit || 'D', 'done': w.done}} AS w FROM step
        UNION ALL
        SELECT conv_id, i, f.goal, {{'cost': w.cost + CASE fault WHEN 3 THEN 5 ELSE 0 END, 'audit': w.audit || 'K', 'done': list_append(w.done, role || ':' || text)}}
        FROM step JOIN {follow} ON f.q = step.q AND f.initial = left(role, 1) WHERE fault NOT IN (1, 2)
        UNION ALL
        SELECT conv_id, i, g.goal, {{'cost': w.cost + 1 + CASE fault WHEN 3 THEN 5 ELSE 0 END, 'audit': w.audit || 'R', 'done': list_append(w.done, g.role || ':' || text)}}
        FROM step JOIN {inserts} ON g.q = step.q WHERE fault NOT IN (1, 2)
      ) GROUP BY conv_id, i, q),
    best AS (
      SELECT d.conv_id, min(d.w) AS w FROM ({inserted}) d JOIN ids n ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = n.n
      WHERE d.q IN ('', 'p') GROUP BY d.conv_id),
    counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
      FROM judged GROUP BY conv_id)
    SELECT b.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
      coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, b.w.cost AS cost, b.w.audit AS audit,
      sha256(array_to_string(b.w.done, chr(10))) AS repaired_sha256
    FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""
