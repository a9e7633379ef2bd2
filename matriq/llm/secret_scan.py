"""Secret scans: keyed patterns, and sliding-window entropy over candidate strings. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.llm.common import read

# The patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]
#: Long enough matches: of group 2, of the whole, of the whole.
LEAST = {"assign": 8, "access": 16, "hex": 32}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits; the most that 20 characters can have is 4.32, random hex digits have about 3.4, prose letters about 3.3.
HEX_BITS, MIXED_BITS = 2.95, 3.75
_WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+)"
#: Candidates that are no secrets: words and paths of words, numbers, strings that say they are examples, and UUIDs.
ALLOW = (
    rf"^{_WORD}?(?:[/_=+-]++{_WORD})*+[/_=+-]*$|^[0-9._=+/-]*$|(?i:example|placeholder|your[_-]?(?:key|token|secret)|x{{6,}})"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
)
#: Characters of a candidate that are looked at in one go, and spans that are added to a list before it is put away.
CHUNK, RUN = 256, 64
_SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def spans(text: Column, pattern: str, kind: str, whole: int | None, group: int | None = None) -> Column:
    """array<struct(s, k, e, m)> of the leftmost non-overlapping matches, in code points, end exclusive.

    Between the matches lie the pieces of a split by the same pattern, so positions are running sums of lengths.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    walk = F.aggregate(
        F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: F.struct(m.alias("m"), p.alias("p"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("run"), F.array().cast(f"array<{_SPAN}>").alias("runs")),
        lambda a, z: _step(a, z, kind),
        lambda a: F.flatten(F.concat(a["runs"], F.array(a["run"]))),
    )
    kept = walk if whole is None else F.filter(walk, lambda x: F.length(x["m"] if group is None else F.regexp_extract(x["m"], pattern, group)) >= whole)
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast(_SPAN))


def _step(a: Column, z: Column, kind: str) -> Column:
    """One match more. Lists are copied when they grow, so a full run is put away and a new one begun."""
    s = a["at"] + F.length(z["p"])
    e = s + F.length(z["m"])
    one = F.array(F.struct(s.alias("s"), F.lit(KINDS.index(kind)).alias("k"), e.alias("e"), z["m"].alias("m")))
    full = F.size(a["run"]) >= RUN
    run, runs = F.when(full, one).otherwise(F.concat(a["run"], one)), F.when(full, F.concat(a["runs"], F.array(a["run"]))).otherwise(a["runs"])
    return F.struct(e.alias("at"), run.alias("run"), runs.alias("runs"))


def window_bits(s: Column, size: int = WINDOW) -> Column:
    """The largest Shannon entropy of any `size` neighbouring characters of an ASCII string; 0 if it has fewer.

    As the window moves, the count of one character goes up and that of another down, and the sum of c log2 c changes by
    those two terms alone. Long strings are cut into chunks that overlap by less than a window, so work grows with the length.
    """
    parts = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{CHUNK - size + 1}}}"), F.lit(0))
    after = F.concat(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.substring(p, 1, size - 1)), F.array(F.lit("")))
    chunks = F.zip_with(parts, after, lambda p, q: F.concat(p, q))
    return F.coalesce(F.array_max(F.transform(chunks, lambda c: _chunk_bits(c, size))), F.lit(0.0))


def _chunk_bits(c: Column, size: int) -> Column:
    terms = [n * math.log2(n) if n else 0.0 for n in range(size + 2)]
    #: By a character's count before it: what one more adds to the sum, and what one less does.
    more = F.array(*(F.lit(y - x) for x, y in zip(terms, terms[1:], strict=False)))
    less = F.array(*(F.lit(x - y) for x, y in zip([0.0, *terms], terms, strict=False)))

    def count(window: Column, n: Column, char: Column) -> Column:
        return n - F.length(F.replace(window, char, F.lit("")))

    def step(a: Column, i: Column) -> Column:
        new, old = F.substring(c, i, F.lit(1)), F.substring(c, i - size, F.lit(1))
        window = F.substring(c, i - size, F.lit(size))
        rise = F.get(more, count(window, F.lit(size), new))
        change = F.when(i <= size, F.get(more, count(F.substring(c, F.lit(1), i - 1), i - 1, new))).when(new == old, 0.0).otherwise(rise + F.get(less, count(window, F.lit(size), old)))
        total = a["sum"] + change
        return F.struct(total.alias("sum"), F.when(i >= size, F.least(a["least"], total)).otherwise(a["least"]).alias("least"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(math.inf).alias("least"))
    return F.aggregate(F.sequence(F.lit(1), F.length(c)), start, step, lambda a: F.when(a["least"] < math.inf, math.log2(size) - a["least"] / size).otherwise(0.0))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base (assign, access and hex spans by start, then kind) and found (entropy spans).

    Spans are struct(s, k, e, m): start, kind, end (exclusive, in code points) and matched text. A
    candidate string counts if the entropy of one of its windows reaches the bound of its character
    class (hex digits, or mixed), no allow-list pattern suppresses it, and no base span overlaps it.
    Null and empty texts, and texts shorter than any pattern, have no spans. Repeated rows each keep
    their row; no documents: no rows; extra columns are ignored.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(_SPAN)
    rows = docs.select(F.col(id_col).alias("_id"), t.alias("_t"))
    # A cheap look first: few texts hold any candidate, and the others need no spans.
    some = F.col("_t").rlike(ASSIGN)
    long_hex = HEX.replace("+", f"{{{LEAST['hex']},}}")
    rows = rows.select(
        "_id",
        F.when(some, spans(F.col("_t"), ASSIGN, "assign", LEAST["assign"], 2)).otherwise(none).alias("_assign"),
        F.when(F.col("_t").contains("AKIA"), spans(F.col("_t"), ACCESS, "access", LEAST["access"])).otherwise(none).alias("_access"),
        F.when(F.col("_t").rlike(long_hex), spans(F.col("_t"), long_hex, "hex", None)).otherwise(none).alias("_hex"),
        F.when(
            F.col("_t").rlike(CANDIDATE),
            F.filter(spans(F.col("_t"), CANDIDATE, "entropy", None), lambda x: ~x["m"].rlike(ALLOW)),
        ).otherwise(none).alias("_try"),
    )
    rows = rows.select("_id", F.array_sort(F.concat("_assign", "_access", "_hex")).alias("base"), "_try", F.size("_assign").alias("n_assign"), F.size("_access").alias("n_access"), F.size("_hex").alias("n_hex"))
    apart = F.filter("_try", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    found = F.filter(apart, lambda x: window_bits(x["m"]) >= F.when(x["m"].rlike("^[0-9A-Fa-f]+$"), HEX_BITS).otherwise(MIXED_BITS))
    return rows.select(F.col("_id").alias(id_col), "base", F.when(F.size("_try") > 0, found).otherwise(none).alias("found"), *(F.col(c).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")))


def listed(c: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "found"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))


def _sql_spans(kind: str, pattern: str, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, list_sum([len(x) for x in pieces[1:i]]) + coalesce(list_sum([len(x) for x in found[1:i - 1]]), 0) AS s,
       list_sum([len(x) for x in pieces[1:i]]) + list_sum([len(x) for x in found[1:i]]) AS e, {KINDS.index(kind)} AS k, found[i] AS m
FROM (SELECT doc_id, pieces, found, unnest(range(1, len(found) + 1)) AS i
      FROM (SELECT doc_id, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS found FROM documents))
WHERE {keep}"""


_ALLOW_SQL = ALLOW.replace("++", "+").replace("*+", "*")
SQL = f"""
WITH base AS ({_sql_spans("assign", ASSIGN, "len(regexp_extract(found[i], '" + ASSIGN.replace("'", "''") + f"', 2)) >= {LEAST['assign']}")}
UNION ALL {_sql_spans("access", ACCESS, f"len(found[i]) >= {LEAST['access']}")}
UNION ALL {_sql_spans("hex", HEX, f"len(found[i]) >= {LEAST['hex']}")}),
tried AS ({_sql_spans("entropy", CANDIDATE, "NOT regexp_matches(found[i], '" + _ALLOW_SQL + "')")}),
rated AS (SELECT *, list_max([list_aggregate(string_split(substr(m, j, {WINDOW}), ''), 'entropy') for j in range(1, len(m) - {WINDOW} + 2)]) AS bits FROM tried),
extra AS (SELECT doc_id, s, e, k, m FROM rated r WHERE bits >= CASE WHEN regexp_matches(m, '^[0-9A-Fa-f]+$') THEN {HEX_BITS} ELSE {MIXED_BITS} END
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s < r.e AND b.e > r.s)),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e AS t FROM (SELECT * FROM base UNION ALL SELECT * FROM extra)),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
        string_agg(t, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(t, ',' ORDER BY s, k) AS a FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""
