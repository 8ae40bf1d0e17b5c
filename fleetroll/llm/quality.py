"""Rule bitmask ledger: every rule is evaluated once; policies and ablations are bitwise work on the ledger."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, plain, unpacked

#: Bit, name and condition of failure, on the measures below.
RULES: list[tuple[int, str, str]] = [
    (0, "too_few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 16 * n_words"),
    (6, "few_letters", "10 * n_letters < 5 * word_chars"),
    (7, "too_many_words", "n_words > 1000000"),
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_letters", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Policy:
    """A version of which rules count: a document passes if none of the mask's bits is set."""

    version: int
    mask: int

    @classmethod
    def of(cls, version: int, *names: str) -> "Policy":
        return cls(version, sum(1 << bit for bit, name, _ in RULES if name in names))


BASE = Policy.of(0, "too_few_words", "repeated_windows")
POLICIES = {
    1: Policy.of(1, "too_few_words", "repeated_windows", "symbols", "repeated_lines"),
    2: Policy.of(2, *(name for _, name, _ in RULES)),
}


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``: computed once, whatever the optimiser moves."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _measures() -> Column:
    """One expression for all measures, each step bound once.

    Windows of three words are compared by 64-bit hashes sorted within the row; where one repeats, hashes are sorted
    with their places, and the places of repeated windows give the words they cover.
    """
    ws = r"' \t\u000B\f\r'"
    step = _let("coalesce(text, '')", "t", f"struct(filter(split(t, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '') AS w, filter(split(t, '\\n'), x -> length(translate(x, {ws}, '')) > 0) AS l)")
    grams = "IF(size(a.w) < 3, array(), transform(sequence(0, size(a.w) - 3), i -> xxhash64(a.w[i], a.w[i + 1], a.w[i + 2])))"
    step = _let(step, "a", f"struct(size(a.w) AS n, size(a.l) AS nl, size(array_distinct(a.l)) AS nd, array_join(a.w, '') AS j, {grams} AS h)")
    letters = "length(regexp_replace(b.j, '[^\\\\p{L}]+', ''))"
    step = _let(step, "b", f"struct(b.n, b.nl, b.nd, length(b.j) AS wc, length(regexp_replace(b.j, '[^#*$%&|<>]+', '')) AS ns, {letters} AS le, b.h, sort_array(b.h) AS s)")
    rest = ", ".join(f"{{0}}.{c}" for c in ("n", "nl", "nd", "wc", "ns", "le"))
    placed = "IF(exists(transform(c.s, (h, i) -> i > 0 AND h = c.s[i - 1]), z -> z), array_sort(transform(c.h, (h, i) -> struct(h AS h, i AS i))), array())"
    step = _let(step, "c", f"struct({rest.format('c')}, {placed} AS p)")
    again = "(j > 0 AND d.p[j - 1].h = x.h) OR (j + 1 < size(d.p) AND d.p[j + 1].h = x.h)"
    step = _let(step, "d", f"struct({rest.format('d')}, sort_array(transform(filter(d.p, (x, j) -> {again}), x -> x.i)) AS r)")
    covered = "aggregate(transform(e.r, (p, j) -> IF(j + 1 < size(e.r), least(3, e.r[j + 1] - p), 3)), 0L, (s, x) -> s + x)"
    step = _let(
        step,
        "e",
        f"struct(cast(e.n AS bigint) AS n_words, cast(e.wc AS bigint) AS word_chars, cast(e.ns AS bigint) AS n_symbols, cast(e.le AS bigint) AS n_letters, cast(e.nl AS bigint) AS n_lines, cast(e.nl - e.nd AS bigint) AS n_dup_lines, {covered} AS n_repeat_words)",
    )
    fields = ", ".join(f"m.{c}" for c in MEASURES)
    bits = " + ".join(f"IF({re.sub(r'[a-z]+_[a-z_]+', lambda x: 'm.' + x[0], c)}, {1 << b}L, 0L)" for b, _, c in RULES)
    return F.expr(_let(step, "m", f"struct({fields}, {bits} AS fail_bits)"))


def ledger(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with its measures and ``fail_bits``; all other columns pass through.

    Columns with the name of a measure, or of ``fail_bits`` or ``~measures``, give way.
    Null texts and texts of white space have no words and fail ``too_few_words``; every measure of them is 0.  Rows
    repeated in the input are repeated in the output.  Built-in functions only, and no shuffle.
    """
    docs = plain(docs, *MEASURES, "fail_bits", "~measures")
    return docs.withColumn("~measures", _measures()).select(*[F.col(f"`{c}`") for c in docs.columns], "`~measures`.*")


def verdict(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(led: DataFrame, policies: dict[int, Policy] = POLICIES) -> DataFrame:
    """For each policy and rule: documents failing the rule, failing it alone, and kept if the rule were dropped.

    The ledger shrinks to one row per combination of bits before anything else, whatever its size.
    """
    combos = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    spark = led.sparkSession
    rows = [(p.version, name, 1 << bit, p.mask) for p in policies.values() for bit, name, _ in RULES if p.mask >> bit & 1]
    rules = spark.createDataFrame(rows, "policy int, rule string, bit long, mask long")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        combos.crossJoin(F.broadcast(rules))
        .groupBy("policy", "rule")
        .agg(
            F.coalesce(F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("failing"),
            F.coalesce(F.sum(F.when(hit == F.col("bit"), F.col("n"))), F.lit(0)).alias("failing_alone"),
            F.coalesce(F.sum(F.when(hit.bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
        )
    )


def quality_filter(docs: DataFrame, policy: Policy = POLICIES[1]) -> DataFrame:
    """``docs`` without the documents that ``policy`` rejects; the columns stay as they are."""
    return unpacked(ledger(packed(docs)).where(verdict(policy)), docs)


def _sql() -> str:
    failing = " + ".join(f"CASE WHEN {c} THEN {1 << b} ELSE 0 END" for b, _, c in RULES)
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
          list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {ws}, '')) > 0) AS l FROM t),
    g AS (SELECT doc_id, w, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
    r AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3)))::BIGINT AS n_repeat_words
          FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM f) GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
          length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
          length(regexp_replace(array_to_string(w, ''), '[^\\p{{L}}]+', '', 'g'))::BIGINT AS n_letters,
          len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
          coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
    b AS (SELECT *, ({failing})::BIGINT AS fail_bits FROM m)"""


SQL_LEDGER = _sql() + f"""
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
           (fail_bits & {BASE.mask}) <> 0 AS base_failed, (fail_bits & {POLICIES[1].mask}) = 0 AS kept FROM b"""


def _sql_ablation() -> str:
    rows = ", ".join(f"({p.version}, '{name}', {1 << bit}, {p.mask})" for p in POLICIES.values() for bit, name, _ in RULES if p.mask >> bit & 1)
    return _sql() + f"""
    SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS failing, count(*) FILTER (fail_bits & mask = bit)::BIGINT AS failing_alone,
           count(*) FILTER (fail_bits & mask & ~bit = 0)::BIGINT AS kept_without FROM b, (VALUES {rows}) v(policy, rule, bit, mask) GROUP BY policy, rule"""


SQL_ABLATION = _sql_ablation()
