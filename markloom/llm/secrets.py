"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule is a regular expression; the trigrams it can't match without give a Boolean query (``trigrams``).
The index lists, for every trigram of any query, the rows that hold it.  Postings are intersected per
alternative, clause and rule by counting, and only the surviving (row, rule) pairs are verified with the
expression.  Rules without mandatory trigrams scan every text.

Rows are named in the index by a 64-bit hash of id and text: rows that share it share their candidates, and
as every candidate is verified on its own text, that can't change a result.

Defined cases: null texts count as empty; repeated rows get a row each; an empty table gives no rows; other
columns are ignored.  Places count code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import body
from markloom.llm.trigrams import query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the match counts if its group ``value`` has ``least`` characters or more."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    base: bool = False


#: The base rules, then customary forms of tokens, in the order of their kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]+", 0, 24),
)


def row_code() -> Column:
    return F.xxhash64(F.col("doc_id"), body())


def query_rows(rules: tuple[Rule, ...]) -> list[tuple[str, int, int, str, int, int]]:
    """``(trigram, clause, alternative, kind, grams, clauses)`` of all rules that have mandatory trigrams."""
    rows = []
    for rule in rules:
        clauses = query(rule.pattern)
        for c, alternatives in enumerate(clauses):
            for a, grams in enumerate(sorted(alternatives, key=sorted)):
                rows += [(gram, c, a, rule.kind, len(grams), len(clauses)) for gram in sorted(grams)]
    return rows


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: ``(trigram, code)`` for every wanted trigram and row that holds it."""
    lowered = docs.select(row_code().alias("code"), F.lower(body()).alias("lowered"))
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(g)), F.lit(g)) for g in grams]))
    return lowered.select("code", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(code, kinds)``: the rules whose trigram queries a row satisfies."""
    rows = query_rows(rules)
    wanted = docs.sparkSession.createDataFrame(rows, "trigram string, clause int, alternative int, kind string, grams int, clauses int")
    found = postings(docs, sorted({r[0] for r in rows})).join(F.broadcast(wanted), "trigram")
    whole = found.groupBy("code", "kind", "clauses", "clause", "alternative", "grams").agg(F.count_distinct("trigram").alias("n")).filter("n = grams")
    held = whole.groupBy("code", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).filter("n = clauses")
    return held.groupBy("code").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """``array<struct<start, order, end>>``: what lies between matches and the matches add up to places."""
    between, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = matches if rule.value == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value))
    sizes = F.zip_with(F.transform(between, F.length), F.zip_with(F.transform(matches, F.length), F.transform(values, F.length), lambda m, v: F.struct(m.alias("m"), v.alias("v"))), lambda b, x: F.struct(b.alias("b"), x["m"].alias("m"), x["v"].alias("v")))
    kept = "array<struct<start:int,order:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kept).alias("found"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + x["b"]
        end = first + F.coalesce(x["m"], F.lit(0))
        span = F.struct(first.alias("start"), F.lit(order).alias("order"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["v"] >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    return F.when(text.rlike(rule.pattern), F.aggregate(sizes, start, step, lambda s: s["found"])).otherwise(F.array().cast(kept))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, text, spans``: spans ``(start, order, end)`` of every document by start, then rule."""
    rows = docs.select("doc_id", body().alias("text"), row_code().alias("code"))
    marked = rows.join(candidates(docs, rules), "code", "left")
    free = {rule.kind for rule in rules if not query(rule.pattern)}
    nothing = F.array().cast("array<struct<start:int,order:int,end:int>>")
    found = []
    for order, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, order)
        found.append(spans if rule.kind in free else F.when(F.array_contains("kinds", rule.kind), spans).otherwise(nothing))
    return marked.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("spans"))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_<base kind>..., base_sha256, spans`` of every document."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = F.array(*[F.lit(i) for i, r in enumerate(rules) if r.base])
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["order"]), x["start"], x["end"])), ",")
    spans = secret_spans(docs, rules).select("doc_id", "spans")
    of_rule = lambda order: F.size(F.filter("spans", lambda x: x["order"] == order)).cast("long")
    counts = [of_rule(i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base]
    only_base = F.filter("spans", lambda x: F.array_contains(base, x["order"]))
    return spans.select("doc_id", *counts, F.sha2(listed(only_base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


