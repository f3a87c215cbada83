"""Operator 8: secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: every match must contain
them. The index holds postings (trigram, document) for the trigrams that any query names;
postings are intersected and united per document as bit sets, and only documents that satisfy
a rule's query are verified with its pattern. A rule whose matches need no trigram scans every
document.

Null text counts as empty and has no spans; an empty table gives an empty result. Repeated
rows are found alike, each row once, also where doc_id is null or repeated. Spans of one kind
never overlap; spans of different kinds may, and are listed by start, then in the rules'
order. Texts of any length are searched whole. Extra columns are carried through by scan()
unless they clash with an output column, which then replaces them."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table
from .native import let, lower_ascii, running_sums

Query = tuple  # ("all",) | ("has", trigram) | ("and", queries) | ("or", queries)
ALL: Query = ("all",)
#: Alternatives that a literal run may have before it is cut.
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1  # its characters at least; shorter matches are dropped after matching


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: The base patterns; the contract fixes them. Where a match ends in a run of one class and its
#: whole length counts, the run's least length stands in the pattern: a longer run is the same
#: match, a shorter one would be dropped.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
_KEY_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: Between the lines of a key: white space, or line ends written as escapes.
_GAP = r"(?:\s|\\[rn])*+"
#: A key goes on to its END line; where that is missing (before other dashes), over header fields
#: and the base64 lines that follow, with a shorter last one.
_KEY_BODY = (
    r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}(?:Proc-Type|DEK-Info):\s*+[^\s\\]++)*+(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+"
    r"""(?:(?<=[A-Za-z0-9+/]{16})(?:[ \t]*+(?:\r?\n|\\r\\n|\\n)[ \t]*+|[ ])[A-Za-z0-9+/]++(?:={1,2}|(?=\s*+$|\r?\n|\\[rn]|["'])))?)"""
)
#: Further public token formats, and blocks of private keys.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("private", _KEY_HEADER + _KEY_BODY),
)
RULES = BASE + MORE
#: Candidates (an id, a hash and flags) are broadcast up to this many rows, else texts are shuffled
#: to them.
BROADCAST_ROWS = 200_000


# --- trigram queries ------------------------------------------------------------------


def _strings(node) -> set[str] | None:
    """The few literal strings (lower-cased) that a node can match, or None."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for o, a in arg:
            if o is sre.LITERAL:
                out.add(chr(a).lower())
            elif o is sre.RANGE and a[1] - a[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] <= 4:
        one = _sequence_strings(arg[2])
        return None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        s = _strings(node)
        if s is None or len(out) * len(s) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def _both(kind: str, queries: Sequence[Query]) -> Query:
    neutral = ALL if kind == "and" else None
    parts = [q for q in dict.fromkeys(queries) if q != neutral]
    if kind == "or" and ALL in parts:
        return ALL
    if not parts:
        return ALL
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """One of the strings occurs: alternatives that imply another one are left out."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [x for x in sets if not any(y < x for y in sets)]
    return _both("or", [_both("and", [("has", t) for t in sorted(x)]) for x in sorted(least, key=sorted)])


def _inner(node) -> Query:
    """What a node that isn't a few strings needs."""
    op, arg = node
    if op is sre.SUBPATTERN:
        return _of_nodes(arg[3])
    if op is sre.BRANCH:
        return _both("or", [_of_nodes(x) for x in arg[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
        return _of_nodes(arg[2])
    return ALL


def _of_nodes(nodes) -> Query:
    need, run = [], {""}
    for node in nodes:
        s = _strings(node)
        if s is not None and len(run) * len(s) <= MOST_STRINGS:
            run = {a + b for a in run for b in s}
            continue
        need.append(_of_strings(run))
        run = s if s is not None else {""}
        if s is None:
            need.append(_inner(node))
    return _both("and", [*need, _of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """What the lower-cased trigrams of a text must satisfy for the pattern to match in it."""
    return _of_nodes(sre_parse.parse(pattern))


def trigrams(query: Query) -> set[str]:
    if query[0] == "has":
        return {query[1]}
    return set().union(*(trigrams(q) for q in query[1])) if len(query) > 1 else set()


def holds(query: Query, has) -> object:
    """The query with has(trigram) for each leaf, joined by & and |."""
    if query[0] == "has":
        return has(query[1])
    parts = [holds(q, has) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


# --- index, intersection, verification ---------------------------------------------------


def postings(docs: DataFrame, key: Sequence[str], text: str, wanted: Sequence[str]) -> DataFrame:
    """(key..., trigram number) for each wanted trigram that a text holds, case ignored."""
    low = docs.select(*key, lower_ascii(F.col(text)).alias("_low"))
    found = F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)])
    return low.select(*key, found.alias("_found")).select(*key, F.explode(F.filter("_found", lambda x: F.isnotnull(x))).alias("trigram"))


def candidates(index: DataFrame, key: Sequence[str], wanted: Sequence[str], queries: Sequence[Query]) -> DataFrame:
    """(key..., c0, c1, ...): for each document with postings, which queries they satisfy."""
    per = 60
    words = -(-len(wanted) // per)
    sums = [F.bit_or(F.when(F.floor(F.col("trigram") / per) == w, F.expr(f"shiftleft(1L, trigram % {per})")).otherwise(F.lit(0).cast("long"))).alias(f"_b{w}") for w in range(words)]
    place = {t: divmod(i, per) for i, t in enumerate(wanted)}

    def has(t: str) -> Column:
        w, b = place[t]
        return F.col(f"_b{w}").bitwiseAND(F.lit(1 << b)) != 0

    bits = index.groupBy(*key).agg(*sums)
    flags = [holds(q, has).alias(f"c{i}") for i, q in enumerate(queries)]
    out = bits.select(*key, *flags)
    return out.filter(reduce(lambda a, b: a | b, [F.col(f"c{i}") for i in range(len(queries))]))


def rule_spans(text: Column, number: int, rule: Rule) -> Column:
    """The rule's kept matches as an array of (start, kind number, end), in code points."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def located(matches: Column) -> Column:
        lengths = F.transform(matches, lambda m: F.length(m).cast("long"))
        pieces = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p).cast("long"))
        # the end of match i: all pieces up to it and all matches with it
        ends = let(F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), lengths, lambda p, m: p + m), running_sums)
        size = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda v: F.length(v)) if rule.group else lengths
        spans = F.zip_with(ends, F.arrays_zip(lengths.alias("m"), size.alias("v")), lambda e, x: F.struct((e - x["m"]).alias("start"), F.lit(number).alias("kind"), e.alias("end"), x["v"].alias("v")))
        return F.transform(F.filter(spans, lambda s: s["v"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    # one search tells most documents from those with something to locate
    return F.when(~text.rlike(rule.pattern), none).otherwise(let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), located))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with spans: an array of (start, kind, end) over all rules, by start then rule;
    kind is the rule's name, ends are exclusive, and positions count code points."""
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [i for i, q in enumerate(queries) if q != ALL]
    kept = [c for c in docs.columns if c != "spans"]
    # the columns carried along stand in one struct, so no name can clash
    row = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept) if c != text])
    rows = docs.select(row.alias("_row"), F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.col(f"`{text}`").alias("_raw"))
    whole = F.coalesce("_raw", F.lit(""))
    if indexed:
        wanted = sorted(set().union(*(trigrams(queries[i]) for i in indexed)))
        index = postings(rows.select("_id", "_hash", whole.alias("_text")), ["_id", "_hash"], "_text", wanted)
        found = stored(candidates(index, ["_id", "_hash"], wanted, [queries[i] for i in indexed]).withColumnsRenamed({"_id": "_cid", "_hash": "_chash"}), "candidates")
        rows = rows.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_hash") == F.col("_chash")), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    each = [F.when(F.col(f"c{indexed.index(i)}"), rule_spans(whole, i, r)).otherwise(none) if i in indexed else rule_spans(whole, i, r) for i, r in enumerate(rules)]
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(F.array_sort(F.concat(*each)), lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end")))
    back = [F.col("_raw").alias(c) if c == text else F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(kept)]
    return rows.select(*back, spans.alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with every found span replaced by its kind in brackets; overlapping spans become
    one. Null text stays null; the other columns are unchanged."""
    own = fresh("_spans", docs.columns)
    found = scan(docs.withColumnRenamed("spans", own), doc_id, text, rules)
    t = F.col(f"`{text}`")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], t.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"))
        longer = F.struct(s["end"].alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).when(s["end"] > acc["at"], longer).otherwise(acc)

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], t.substr((acc["at"] + 1).cast("int"), F.length(t))))
    return found.select(*[F.when(F.size("spans") > 0, clean).otherwise(t).alias(text) if c == text else F.col(f"`{own if c == 'spans' else c}`").alias(c) for c in docs.columns])


# --- query ---------------------------------------------------------------------------


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    as_given = {"access": Rule("access", "AKIA[A-Z0-9]+", 0, 16), "hex": Rule("hex", "[0-9a-f]+", 0, 32), "private": Rule("private", _KEY_HEADER)}
    parts = []
    for i, r in enumerate(as_given.get(r.kind, r) for r in RULES):
        p = quoted(r.pattern)
        parts.append(f"""SELECT doc_id, {i} AS k, '{r.kind}' AS kind, i,
            list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
            FROM (SELECT doc_id, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m,
                regexp_extract_all(t, {p}, {r.group}) AS v, regexp_split_to_array(t, {p}) AS p FROM d) WHERE len(m) > 0) WHERE length(v[i]) >= {r.least}""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
x AS (SELECT doc_id, k, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS e FROM s),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
    string_agg(e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(e, ',' ORDER BY s, k) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


SQL = _sql()
