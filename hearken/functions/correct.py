"""Ordered dictionary corrections: a few rules as a chain of column expressions, many by one search for all their sources."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.automaton import Finder, applied
from hearken.functions.expr import let
from hearken.session import sent_to_workers

KINDS = ("typo", "spacing")
#: Up to so many rules are a chain of columns; a longer chain would take the planner too long.
CHAIN = 64
APPLIED = "array<struct<rule_id:string,source:string,target:string,reason:string,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """Replace ``source`` by ``target``; with context terms only where one of them is near, the source itself included."""

    rule_id: str
    source: str
    target: str
    reason: str
    kind: str = "typo"
    context_terms: tuple[str, ...] = ()
    context_window: int = 20

    def __post_init__(self) -> None:
        blank = [name for name in ("rule_id", "source", "reason") if not getattr(self, name).strip()]
        faults = {
            f"a rule needs {', '.join(blank)}": bool(blank),
            f"unknown kind of rule: {self.kind}": self.kind not in KINDS,
            "context terms must not be blank": "" in map(str.strip, self.context_terms),
            "a context window must be positive": bool(self.context_terms) and self.context_window < 1,
            "a rule must change its source": self.target == self.source,
        }
        if found := [text for text, wrong in faults.items() if wrong]:
            raise ValueError("; ".join(found))


def checked(rules: Iterable[Rule]) -> tuple[Rule, ...]:
    """A set of rules; each is sound by itself, and no two share an id or a source."""
    rules = tuple(rules)
    for what in ("rule_id", "source"):
        twice = [name for name, n in Counter(getattr(rule, what) for rule in rules).items() if n > 1]
        if twice:
            raise ValueError(f"two rules have the same {what}: {', '.join(twice)}")
    return rules


def enabled(rules: Iterable[Rule], kinds: Iterable[str] = ("typo",)) -> tuple[Rule, ...]:
    kinds = set(kinds)
    if not kinds:
        raise ValueError("at least one kind of rule must be enabled")
    return tuple(rule for rule in checked(rules) if rule.kind in kinds)


def rules_from_json(text: str) -> tuple[Rule, ...]:
    """Rules in file order; unknown or missing fields are errors."""
    entries = json.loads(text)
    if not isinstance(entries, list):
        raise ValueError("rules must be a list")
    try:
        return checked(Rule(**{**entry, "context_terms": tuple(entry.get("context_terms", ()))}) for entry in entries)
    except (TypeError, AttributeError) as error:
        raise ValueError(f"a rule has wrong fields: {error}") from error


def replaced(text: Column, rule: Rule) -> Column:
    if not rule.context_terms:
        return F.replace(text, F.lit(rule.source), F.lit(rule.target))
    size, reach = len(rule.source), rule.context_window
    terms = "|".join(map(re.escape, rule.context_terms))

    def rebuilt(t: Column, p: Column) -> Column:
        """Walk the gaps; each source between two gaps is judged by its surroundings in the unchanged text."""

        def step(state: Column, gap: Column) -> Column:
            at = state["at"]
            low = F.greatest(F.lit(0), at - reach)
            near = F.substr(t, low + 1, at + size + reach - low)
            word = F.when(at < 0, F.lit("")).when(near.rlike(terms), F.lit(rule.target)).otherwise(F.lit(rule.source))
            begin = F.when(at < 0, F.lit(0)).otherwise(at + size)
            return F.struct((begin + F.length(gap)).alias("at"), F.concat(state["out"], F.array(word, gap)).alias("out"))

        start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(p, start, step, lambda s: F.array_join(s["out"], ""))

    pieces = F.split(text, "\\Q" + rule.source + "\\E", -1)
    return F.when(text.contains(rule.source), let(F.struct(text.alias("t"), pieces.alias("p")), lambda x: rebuilt(x["t"], x["p"]))).otherwise(text)


FIELDS = ("rule_id", "source", "target", "reason", "kind")


def by_search(df: DataFrame, text_col: str, active: tuple[Rule, ...], out: str, log: str) -> DataFrame:
    """``correct`` for any number of rules, in a plan of one step: all sources are searched for at once, and only rules that can
    fire are applied.

    Rules and automata are broadcast; the automata's size is bounded by the rules', and is an error beyond two gigabytes.
    """
    finder = Finder.of([r.source for r in active])
    if finder.size() > 2 << 30:
        raise ValueError("too many rules for one set; apply them in several sets, in order")
    sent = sent_to_workers(df.sparkSession, (finder, active))
    kind = pa.struct([("out", pa.string()), ("log", pa.list_(pa.struct([(f, pa.string()) for f in FIELDS])))])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search, rules = sent()
        steps = [(r.source, r.target, r.context_terms, r.context_window) for r in rules]
        entries = [{f: getattr(r, f) for f in FIELDS} for r in rules]
        for column in columns:
            texts = column.to_pylist()
            rows = []
            for text, holds in zip(texts, search.found([t or "" for t in texts])):
                done, fired = applied(text, holds, steps, search) if text and holds else (text, [])
                rows.append(None if text is None else {"out": done, "log": [entries[k] for k in fired]})
            yield pa.array(rows, kind)

    step = F.arrow_udf(run, f"struct<out:string,log:{APPLIED}>")
    made = df.withColumn("__corrected", step(F.col(text_col).cast("string")))
    return made.withColumns({log: F.col("__corrected.log"), out: F.col("__corrected.out")}).drop("__corrected")


def correct(df: DataFrame, text_col: str, rules: Iterable[Rule], kinds: Iterable[str] = ("typo",), out: str = "corrected", log: str = "corrections", chain: int = CHAIN) -> DataFrame:
    """Adds the corrected text and the rules that changed it, in order.  Each rule sees what the one before it left.

    Every step is a column of its own, so no rule evaluates the rules before it twice; more than ``chain`` rules are searched for
    at once instead, with the same result.  A blank text stays as it is and logs nothing; a null text gives nulls.
    """
    active = enabled(rules, kinds)
    if len(active) > chain:
        return by_search(df, text_col, active, out, log)
    names = [f"__corrected_{k}" for k in range(len(active) + 1)]
    made = df.withColumn(names[0], F.col(text_col))
    for k, rule in enumerate(active):
        made = made.withColumn(names[k + 1], replaced(F.col(names[k]), rule))
    entry = lambda r: F.struct(*(F.lit(getattr(r, f)).alias(f) for f in FIELDS))
    fired = [F.when(F.col(names[k]) != F.col(names[k + 1]), entry(r)) for k, r in enumerate(active)]
    applied = F.filter(F.array(*fired), lambda x: x.isNotNull()) if fired else F.array()
    return made.withColumn(log, F.when(F.col(text_col).isNotNull(), applied.cast(APPLIED))).withColumn(out, F.col(names[-1])).drop(*names)
