"""Secret scanning with a trigram inverted index.

A rule's regex is turned into a Boolean trigram query (OR of branches, each an
AND of trigrams that every match must contain).  The index holds, for each
trigram that some rule asks for, the texts that contain it; intersecting the
postings of a branch gives the candidate texts of its rule, and only these are
verified with the regex.  Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.columns import text_of, with_text_key
from riskweave.session import materialise


@dataclass(frozen=True)
class Rule:
    """``regex`` matches leftmost and non-overlapping; matches whose ``group`` has
    fewer than ``least`` characters are dropped afterwards."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    base: bool = True


# The patterns the result is defined by.  A run of hex digits or
# of capitals is matched whole, so asking for its length in the regex is the
# same as dropping short runs; for "assign" it is not, so its length is tested after.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6,
        group=2,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("pat", r"ghp_[A-Za-z0-9]{36}", base=False),
)

#: Alternatives kept while a query is derived; beyond them a gap is put in, which only weakens the query.
MAX_BRANCHES = 64


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Branches of lower-case trigrams, one of which every match has in full; None if there are none."""
    found = {t for t, _ in _walk(regex_parser.parse(regex), {(frozenset(), "")})}
    if not all(found):
        return None
    # a branch that contains another adds nothing
    return sorted((b for b in found if not any(o < b for o in found)), key=sorted)


def _walk(pattern, states: set[tuple[frozenset, str]]) -> set[tuple[frozenset, str]]:
    """``states``: (trigrams so far, literal text that ends here)."""
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            c = chr(arg).lower()
            states = {
                (t | {(tail + c)[-3:]} if len(tail) >= 2 else t, (tail + c)[-2:]) for t, tail in states
            }
        elif name == "SUBPATTERN":
            states = _walk(arg[-1], states)
        elif name == "BRANCH":
            states = set().union(*(_walk(p, states) for p in arg[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] <= 1:
            once = _walk(arg[2], states)
            if arg[1] > 1:
                once = {(t, "") for t, _ in once}
            states = once | (states if arg[0] == 0 else set())
        elif name != "AT":
            states = {(t, "") for t, _ in states}
        if len(states) > MAX_BRANCHES:
            common = frozenset.intersection(*(t for t, _ in states))
            states = {(common, "")}
    return states


def build_postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Index table ``(trigram, k1, k2)`` for the trigrams that the rules ask for, sorted by trigram."""
    low = F.lower(F.col("text"))
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return materialise(
        texts.select("k1", "k2", F.explode(hits).alias("trigram")).sortWithinPartitions("trigram", "k1", "k2"),
        "trigram-postings",
    )


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``(k1, k2, kinds)``: the rules whose query a text satisfies.

    A posting sets one bit of each branch that asks for it; a branch holds
    where all its bits are set.  The bits of a text's copies fold before the shuffle.
    """
    terms, number = [], 0
    for kind, branches in queries.items():
        for branch in branches:
            # several numbered parts if a branch has over 62 trigrams
            names = sorted(branch)
            parts = [names[i : i + 62] for i in range(0, len(names), 62)]
            for p, part in enumerate(parts):
                full = (1 << len(part)) - 1
                terms += [(t, kind, number, p, len(parts), 1 << i, full) for i, t in enumerate(part)]
            number += 1
    table = postings.sparkSession.createDataFrame(
        terms, "trigram string, kind string, branch int, part int, parts int, bit long, full long"
    )
    # the table has one row per trigram of a rule
    return (
        postings.join(F.broadcast(table), "trigram")
        .groupBy("k1", "k2", "kind", "branch", "part")
        .agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full"), F.first("parts").alias("parts"))
        .where("bits = full")
        .groupBy("k1", "k2", "kind", "branch")
        .agg(F.count(F.lit(1)).alias("n"), F.first("parts").alias("parts"))
        .where("n = parts")
        .groupBy("k1", "k2")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def match_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of ``(start, ord, end, kind)`` of the rule's matches, in code points.

    The pieces between the matches and the matches themselves alternate, so
    their lengths add up to the positions.
    """
    regex = F.lit(rule.regex)
    gaps = F.transform(F.split(text, rule.regex, -1), F.char_length)
    tests = F.regexp_extract_all(text, regex, F.lit(rule.group))
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    sizes = F.zip_with(
        whole, tests, lambda w, t: F.struct(F.char_length(w).alias("len"), F.char_length(t).alias("test"))
    )
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(whole)),
        sizes,
        lambda gap, m: F.struct(gap.alias("gap"), m["len"].alias("len"), m["test"].alias("test")),
    )
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(x["test"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda acc: acc["found"])


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``(doc_id, found)``: all spans ``(start, ord, end, kind)`` of each document by start, then rule order.

    Null or empty text has no spans.  Ids may be null or repeated: every row is
    reported.  Other columns are not read.  Letters of the index are lower-case,
    so the index only ever adds candidates.
    """
    base = with_text_key(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), F.col("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not None}
    trigrams = sorted({t for q in queries.values() for b in q for t in b})
    if trigrams:
        chosen = materialise(candidates(build_postings(base, trigrams), queries), "secret-candidates")
        rows = base.join(chosen, ["k1", "k2"], "left")
    else:
        rows = base.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    text, parts = F.col("text"), []
    for order, rule in enumerate(rules):
        meant = F.array_contains("kinds", rule.kind) if rule.kind in queries else F.lit(True)
        parts.append(F.when(meant & text.rlike(rule.regex), match_spans(text, rule, order)).otherwise(none))
    return rows.select(F.col("id").alias("doc_id"), F.array_sort(F.concat(*parts)).alias("found"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
