"""Secret scans (operator 1): a trigram inverted index in front of the rules.

From each rule's regular expression a Boolean trigram query is derived: an OR of clauses, each an AND of trigrams without which the rule cannot
match. The index is partitioned by document: a row's postings, the trigrams of its text that some query asks for, are made and the clauses intersected with them where the row
lies, which gives the rules the row is a candidate of; only these are verified on the whole text. Rules without mandatory trigrams scan every text.
:func:`postings` gives the same postings as a table.

Everything is DataFrame expressions in one pass: no text, no posting and no span is shuffled, so neither a common trigram nor a
group of copies is a hot key. Spans come from one pass of an anchored expression and a running sum, so their cost is linear in the text but for a logarithm.

Defined results: null texts are empty; matches of a rule are leftmost and do not overlap; offsets are code points, ends exclusive; spans of
several rules may overlap; spans that start together (ties) go by the rules' order; very long texts and texts of many matches are scanned whole; repeated rows get equal results; an empty
table gives an empty table. Extra columns stay out of the way, as only key and text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import bind, running, table

SPAN = "array<struct<start:bigint,end:bigint,from:bigint,to:bigint>>"


@dataclass(frozen=True)
class Rule:
    """pattern: what a match is; value, least: the group and its least length that keep a match (group 0: all of it).

    A run of one character class is leftmost and longest, so a least length inside the pattern keeps the same matches as dropping short ones.
    """

    kind: str
    pattern: str
    value: int = 0
    least: int = 0
    base: bool = False


# The base kinds in their listed order, then those added.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

_EXACT_LIMIT = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which any match contains whole; None if nothing is mandatory."""
    import re._parser as parser

    def of(seq) -> tuple[set[str] | None, set[frozenset[str]]]:
        """The exact strings of a sequence, if few; and its clauses (an OR; the empty clause asks for nothing)."""
        exact: set[str] | None = {""}
        clauses: set[frozenset[str]] = {frozenset()}
        run: set[str] = {""}

        def flush() -> None:
            nonlocal clauses, run
            own = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            if frozenset() not in own:
                clauses = {a | b for a, b in product(clauses, own)}
            run = {""}

        for op, arg in seq:
            name, got, inner = str(op), None, {frozenset()}
            if name == "LITERAL":
                got = {chr(arg).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                got = {chr(c).lower() for _, c in arg}
            elif name == "SUBPATTERN":
                got, inner = of(arg[3])
            elif name == "BRANCH":
                parts = [of(x) for x in arg[1]]
                got = None if any(e is None for e, _ in parts) else {s for e, _ in parts for s in e}
                inner = {c for _, cs in parts for c in cs}
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, sub = arg
                e, cs = of(sub)
                if e is not None and high <= 3 and not isinstance(high, type(None)):
                    got = {"".join(p) for n in range(low, int(high) + 1) for p in product(sorted(e), repeat=n)}
                elif low:
                    inner = cs
            elif name == "AT":
                got = {""}
            if got is not None and len(run) * len(got) <= _EXACT_LIMIT:
                run = {a + b for a, b in product(run, got)}
                exact = None if exact is None else {a + b for a, b in product(exact, got)}
            else:
                flush()
                exact = None
                if got is not None:
                    run = got
                elif frozenset() not in inner:
                    clauses = {a | b for a, b in product(clauses, inner)}
        if exact is not None:
            own = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}
            return exact, own
        flush()
        return None, clauses

    clauses = of(parser.parse(pattern))[1]
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _trie(trigrams: list[str]) -> str:
    """An alternative of trigrams that shares beginnings, so that most positions fail at the first letter."""
    firsts: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(trigrams):
        firsts.setdefault(a, {}).setdefault(b, []).append(c)
    q = re.escape
    return "|".join(q(a) + "(?:" + "|".join(q(b) + "(?:" + "|".join(map(q, cs)) + ")" for b, cs in bs.items()) + ")" for a, bs in firsts.items())


def spans(text: Column, rule: Rule) -> Column:
    """SPAN of a rule's matches in whole texts: start and end in code points, from and to in bytes. Each gap and match is one anchored step."""
    steps = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?{rule.pattern}"), F.lit(0))
    inner = lambda s, g: F.regexp_extract(s, rf"(?s)\A.*?({rule.pattern})\z", g)
    long = lambda c: c.cast("long")
    sized = F.transform(
        steps,
        lambda s: F.struct(
            long(F.length(s)).alias("step"), long(F.octet_length(s)).alias("bytes"), long(F.length(inner(s, 1))).alias("match"), long(F.octet_length(inner(s, 1))).alias("own"),
            (F.length(inner(s, 1 + rule.value)) if rule.value else F.length(inner(s, 1))).alias("value"),
        ),
    )

    def placed(sizes: Column) -> Column:
        ends, tos = running(F.transform(sizes, lambda s: s["step"])), running(F.transform(sizes, lambda s: s["bytes"]))
        both = F.arrays_zip(sizes.alias("s"), ends.alias("end"), tos.alias("to"))
        kept = F.filter(both, lambda x: x["s"]["value"] >= rule.least)
        return F.transform(kept, lambda x: F.struct((x["end"] - x["s"]["match"]).alias("start"), x["end"].alias("end"), (x["to"] - x["s"]["own"]).alias("from"), x["to"].alias("to")))

    return bind(sized, placed)


def row_trigrams(text: Column, terms: list[str]) -> Column:
    """The distinct ones of ``terms`` that a text holds, in either case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?i)(?=({_trie(terms)}))"), F.lit(1)), lambda t: F.lower(t)))


def asked(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for c in trigram_query(r.pattern) or () for t in c})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, key): the postings of the trigrams that the rules ask for."""
    return docs.select(F.explode(row_trigrams(F.coalesce(F.col(text), F.lit("")), asked(rules))).alias("trigram"), key)


def meets(trigrams: Column, clauses: list[frozenset[str]]) -> Column:
    """Whether a row's postings hold all trigrams of some clause."""
    found = F.lit(False)
    for clause in clauses:
        every = F.lit(True)
        for t in sorted(clause):
            every = every & F.array_contains(trigrams, t)
        found = found | every
    return found


def _labelled(order: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["from"].alias("from"), s["to"].alias("to"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, text, found): found is array<struct<kind,start,end,from,to>> by start, then the rules' order."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("trigrams", row_trigrams(F.col("text"), asked(rules)))
    lists = []
    for i, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        here = meets(F.col("trigrams"), query) if query else F.col("text").rlike(rule.pattern)
        found = F.when(here, spans(F.col("text"), rule)).otherwise(F.array().cast(SPAN))
        lists.append(F.transform(found, _labelled(i, rule.kind)))
    every = F.array_sort(F.concat(*lists))
    out = rows.select("key", "text", every.alias("every"))
    return out.select("key", "text", F.transform("every", lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "from", "to")))).alias("found"))


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans become one."""

    def cleaned(body: Column, spans: Column, reach: Column) -> Column:
        """A span that starts before an earlier one ends adds no mark; what is kept is cut out of the text's bytes, which needs no count of characters."""
        before = F.transform(spans, lambda s, i: F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long")))
        fresh = F.filter(F.arrays_zip(spans.alias("span"), before.alias("before")), lambda x: x["span"]["from"] >= x["before"])
        part = lambda at, size: F.substring(body, (at + 1).cast("int"), size.cast("int")).cast("string")
        gaps = F.transform(fresh, lambda x: F.concat(part(x["before"], x["span"]["from"] - x["before"]), F.lit(mark)))
        return bind(F.array_max(reach), lambda last: F.concat(F.array_join(gaps, ""), part(last, F.octet_length(body) - last)))

    reach = running(F.transform(found, lambda s: s["to"]), F.greatest)
    done = bind(F.struct(text.cast("binary").alias("body"), found.alias("spans"), reach.alias("reach")), lambda x: cleaned(x["body"], x["spans"], x["reach"]))
    return F.when(F.size(found) > 0, done).otherwise(text)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in base]
    own = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select(F.col("key").alias("doc_id"), *counts, F.sha2(written(own), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def _sql_pattern(pattern: str) -> str:
    """The pattern without an inline flag: both cases of each letter of (?i:...) are written out, so only A-Z fold."""

    def both(m: re.Match) -> str:
        return "(?:" + "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in m[1]) + ")"

    return re.sub(r"\(\?i:([^()]*)\)", both, pattern).replace("'", "''")


def _sql() -> str:
    steps = []
    for i, rule in enumerate(RULES):
        p = _sql_pattern(rule.pattern)
        value = f"length(regexp_extract(step, '(?s)^.*?({p})$', {1 + rule.value}))"
        steps.append(
            f"SELECT doc_id, {i} AS o, '{rule.kind}' AS kind, n, length(step) AS l, length(regexp_extract(step, '(?s)^.*?({p})$', 1)) AS m, {value} >= {rule.least} AS kept FROM "
            f"(SELECT doc_id, unnest(x) AS step, unnest(range(1, len(x) + 1)) AS n FROM (SELECT doc_id, regexp_extract_all(t, '(?s).*?{p}') AS x FROM d))"
        )
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(steps)}),
e AS (SELECT doc_id, o, kind, m, kept, sum(l) OVER (PARTITION BY doc_id, o ORDER BY n) AS fin FROM s),
f AS (SELECT doc_id, o, kind, fin - m AS start, fin, kind || ':' || CAST(fin - m AS BIGINT) || ':' || CAST(fin AS BIGINT) AS w FROM e WHERE kept),
g AS (SELECT doc_id, {counts}, string_agg(w, ',' ORDER BY start, o) AS spans, string_agg(w, ',' ORDER BY start, o) FILTER (kind IN ({base})) AS own FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


OP1_SQL = _sql()
