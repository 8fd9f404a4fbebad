"""Secret scans: known forms, and sliding-window entropy over candidate strings.

Known forms ("base", leftmost and non-overlapping per kind): assign, access, hex; see KINDS. The entropy scan adds
kind `entropy`: a candidate is a run of 20 or more of [A-Za-z0-9+/_=-] with a letter and a digit. A window of 20 characters
slides along it with a count for each character, five bits each in a few longs; a step takes one from the count of the
character that leaves and adds one for the one that enters, and moves the sum of c*log2(c) by the two differences. A window is
hot where its Shannon entropy reaches the threshold of the candidate's class (hex, alnum, other). The span runs from the first
hot window to the end of the last. Candidates on the allow-list (UUIDs, words joined by - _ / or =, marked examples) and those
that overlap a base span give none.

Positions come from the lengths of the pieces between matches, so all stays in built-in functions, without a shuffle.

Defined cases: a null or empty text has no spans; a very long text or candidate is scanned whole, in time in proportion to its
length; equal starts are ordered by kind as listed, then end; rows that repeat give the same result each; an empty table gives an
empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import read, running_sum

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The same where there is a digit, tried only at the start of a run.
CANDIDATE_DIGIT = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Words with up to 4 digits each; tested part by part, as one pattern for them all recurses once for each word.
JOINT, WORD, FIRST_WORD = r"[-_/=]+", r"^[A-Za-z]*[0-9]{0,4}$", r"^[A-Za-z]+[0-9]{0,4}$"
EXAMPLE = r"(?i)example|sample|placeholder|x{6,}|0{8,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Shannon entropy in bits that a window reaches, by class of character.
THRESHOLDS = {"hex": 2.9, "alnum": 3.6, "other": 3.7}
UNIT = 1_000_000


def _g(c: int) -> int:
    return round(c * math.log2(c) * UNIT) if c > 1 else 0


def _most(bits: float) -> int:
    """A window has at least this entropy if its sum of c*log2(c) is at most so much."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def found(text: Column, pattern: str, value_group: int = 0) -> Column:
    """All matches of a pattern that never matches empty, as array of (start, end, value), by code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(gaps, matches, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
    ends = running_sum(steps)
    return F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.get(values, i).alias("value")))


def _if_any(text: Column, pattern: str, value_group: int = 0) -> Column:
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(pattern), found(text, pattern, value_group)).otherwise(none)


#: Places of the counts: how many in a long, and bits of each (a window holds 20 of a character at most).
PER_LONG, COUNT_BITS = 12, 5
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def hot_range(s: Column) -> Column:
    """(first, last): start of the first and of the last hot window of a string of SIGNS from 1, or 0 where there is none."""
    limit = F.when(~s.rlike("[^0-9a-fA-F]"), _most(THRESHOLDS["hex"])).when(~s.rlike("[^0-9A-Za-z]"), _most(THRESHOLDS["alnum"])).otherwise(_most(THRESHOLDS["other"]))
    # what the sum of c*log2(c) grows by when a count goes from c to c + 1
    grows = F.array(*[F.lit(_g(c + 1) - _g(c)).cast("bigint") for c in range(WINDOW + 1)])

    def counter(k: Column) -> Column:
        shift = F.pmod(k, F.lit(PER_LONG)) * COUNT_BITS
        return F.struct(F.floor(k / PER_LONG).cast("int").alias("long"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("bigint"), shift).alias("unit"))

    signs = F.transform(F.transform(F.split(s, ""), lambda ch: F.instr(F.lit(SIGNS), ch) - 1), counter)
    pairs = F.zip_with(signs, F.concat(F.array_repeat(F.lit(None).cast("struct<long:int,shift:int,unit:bigint>"), WINDOW), signs), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]

        def held(c: Column) -> Column:
            return F.call_function("shiftright", F.get(acc["counts"], c["long"]), c["shift"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("bigint")).cast("int")

        def moved(c: Column, k: Column) -> Column:
            return c + F.when(k == enters["long"], enters["unit"]).otherwise(0) - F.when(k == leaves["long"], leaves["unit"]).otherwise(0)

        by = F.get(grows, held(enters)) - F.when(leaves.isNull(), 0).otherwise(F.get(grows, held(leaves) - 1))
        # a window is judged one step later, from fields alone, as an expression that stands here twice is computed twice
        hot = (acc["i"] >= WINDOW) & (acc["total"] <= acc["limit"])
        first, last = F.when(hot & (acc["first"] == 0), acc["i"] - WINDOW + 1).otherwise(acc["first"]), F.when(hot, acc["i"] - WINDOW + 1).otherwise(acc["last"])
        # the last steps come from padding: nothing enters, and i stays
        return F.when(enters.isNull(), F.struct(acc["limit"].alias("limit"), acc["i"].alias("i"), acc["total"].alias("total"), acc["counts"].alias("counts"), first.alias("first"), last.alias("last"))).otherwise(
            F.struct(acc["limit"].alias("limit"), (acc["i"] + 1).alias("i"), (acc["total"] + F.when(enters == leaves, 0).otherwise(by)).alias("total"), F.transform(acc["counts"], moved).alias("counts"), first.alias("first"), last.alias("last")))

    none = F.array_repeat(F.lit(0).cast("bigint"), -(-len(SIGNS) // PER_LONG))
    # the limit reads the whole string, so it is computed once and carried along
    start = F.struct(limit.cast("bigint").alias("limit"), F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("total"), none.alias("counts"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(pairs, start, step)


def allowed(value: Column) -> Column:
    """Whether a candidate is on the allow-list."""
    parts = F.split(value, JOINT, -1)
    words = F.get(parts, F.lit(0)).rlike(FIRST_WORD) & F.forall(parts, lambda w: w.rlike(WORD))
    return value.rlike(UUID) | value.rlike(EXAMPLE) | words


def clear_of(candidates: Column, base: Column) -> Column:
    """The candidates that overlap no base span; both in order of start. Two passes over all of them, forth and back."""
    def marked(c: Column, is_base: bool) -> Column:
        return F.transform(c, lambda m: F.struct(m["start"].alias("start"), F.lit(is_base).alias("base"), m["end"].alias("end")))

    merged = F.array_sort(F.concat(marked(candidates, False), marked(base, True)))

    def flags(array: Column, edge: Column, key, pick, meets) -> Column:
        """One sign for each candidate on the way: 1 if it meets what base spans passed so far reach to."""
        def step(acc: Column, m: Column) -> Column:
            return F.when(m["base"], F.struct(pick(acc["edge"], key(m)).alias("edge"), acc["said"].alias("said"))).otherwise(
                F.struct(acc["edge"].alias("edge"), F.concat(acc["said"], F.when(meets(m, acc["edge"]), "1").otherwise("0")).alias("said")))

        return F.aggregate(array, F.struct(edge.alias("edge"), F.lit("").alias("said")), step)["said"]

    forth = flags(merged, F.lit(-1).cast("bigint"), lambda m: m["end"], F.greatest, lambda m, e: m["start"] < e)
    back = flags(F.reverse(merged), F.lit(1 << 62).cast("bigint"), lambda m: m["start"], F.least, lambda m, e: m["end"] > e)
    told = F.zip_with(F.split(forth, ""), F.split(F.reverse(back), ""), lambda a, b: (a == "0") & (b == "0"))
    kept = F.filter(F.zip_with(candidates, told, lambda c, ok: F.struct(c.alias("c"), ok.alias("ok"))), lambda x: x["ok"])
    return F.when((F.size(base) == 0) | (F.size(candidates) == 0), candidates).otherwise(F.transform(kept, lambda x: x["c"]))


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, base and spans: arrays of (start, kind, end) in order; kind is a number in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    df = df.select("id", "text", F.filter(_if_any(F.col("text"), ASSIGN, 2), lambda m: F.length(m["value"]) >= 6).alias("assign"), _if_any(F.col("text"), ACCESS).alias("access"), _if_any(F.col("text"), HEX).alias("hex"), _if_any(F.col("text"), CANDIDATE_DIGIT).alias("candidates"))
    likely = F.filter("candidates", lambda c: c["value"].rlike("[A-Za-z]") & ~allowed(c["value"]))

    def spans_of(kind: str) -> Column:
        return F.transform(kind, lambda m: _span(kind, m["start"], m["end"]))

    base = F.array_sort(F.concat(*map(spans_of, KINDS[:3])))
    df = df.select("id", "text", base.alias("base"), likely.alias("likely"))
    df = df.select("id", "text", "base", clear_of(F.col("likely"), F.col("base")).alias("clear"))
    ranges = F.transform("clear", lambda c: F.struct(c["start"].alias("at"), hot_range(c["value"]).alias("r")))
    df = df.select("id", "text", "base", F.filter(ranges, lambda x: x["r"]["first"] > 0).alias("hot"))
    added = F.transform("hot", lambda x: _span("entropy", x["at"] + x["r"]["first"] - 1, x["at"] + x["r"]["last"] - 1 + WINDOW))
    return df.select("id", "text", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def said(spans) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    spans = scan(read(spark, sf_dir, "documents"))
    return spans.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def _sql() -> str:
    def q(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def matches(kind: str, pattern: str, group: int = 0) -> str:
        return f"""SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS k, unnest(regexp_extract_all(text, {q(pattern)})) AS m, unnest(regexp_extract_all(text, {q(pattern)}, {group})) AS v,
        unnest(list_transform(string_split_regex(text, {q(pattern)})[:len(regexp_extract_all(text, {q(pattern)}))], lambda x: length(x))) AS gap, generate_subscripts(regexp_extract_all(text, {q(pattern)}), 1) AS i FROM d"""

    words = r"^[A-Za-z]+[0-9]{0,4}([-_/=]+[A-Za-z]*[0-9]{0,4})*$"  # in one pattern here
    allowed = " OR ".join(f"regexp_matches(v, {q(p)})" for p in (UUID, words, EXAMPLE))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({matches("assign", ASSIGN, 2)} UNION ALL {matches("access", ACCESS)} UNION ALL {matches("hex", HEX)} UNION ALL {matches("entropy", CANDIDATE)}),
p AS (SELECT doc_id, kind, k, v, (sum(gap + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS stop, length(m) AS n FROM m),
base AS (SELECT doc_id, kind, k, stop - n AS start, stop FROM p WHERE kind <> 'entropy' AND (kind <> 'assign' OR length(v) >= 6)),
cand AS (SELECT doc_id, v, stop - n AS start, stop FROM p WHERE kind = 'entropy' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT ({allowed})
         AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = p.doc_id AND base.start < p.stop AND p.stop - p.n < base.stop)),
win AS (SELECT doc_id, start, v, w, unnest(string_split(substr(v, w, {WINDOW}), '')) AS ch FROM (SELECT *, unnest(range(1, length(v) - {WINDOW} + 2)) AS w FROM cand)),
cnt AS (SELECT doc_id, start, v, w, ch, count(*) AS c FROM win GROUP BY ALL),
ent AS (SELECT doc_id, start, v, w, sum(CASE WHEN c > 1 THEN round(c * log2(c) * {UNIT}) ELSE 0 END) AS total FROM cnt GROUP BY ALL),
hot AS (SELECT doc_id, start + min(w) - 1 AS b, start + max(w) - 1 + {WINDOW} AS e FROM ent
        WHERE total <= CASE WHEN NOT regexp_matches(v, '[^0-9a-fA-F]') THEN {_most(THRESHOLDS["hex"])} WHEN NOT regexp_matches(v, '[^0-9A-Za-z]') THEN {_most(THRESHOLDS["alnum"])} ELSE {_most(THRESHOLDS["other"])} END
        GROUP BY doc_id, start, v),
a AS (SELECT doc_id, kind, k, start, stop, true AS b FROM base UNION ALL SELECT doc_id, 'entropy', 3, b, e, false FROM hot),
s AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, k, stop) FILTER (WHERE b) AS base, string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, k, stop) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)
"""


SQL = _sql()
