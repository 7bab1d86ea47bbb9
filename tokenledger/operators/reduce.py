"""Reduction of long texts: collapse repeated lines, keep head, diagnostics and tail, fit a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.scalars import bind


@dataclass(frozen=True)
class Reduction:
    """Defaults of the production job; fixed values."""

    max_chars: int = 12_000
    head: int = 60
    tail: int = 60
    important: int = 40
    tail_share: float = 0.4
    signal: str = r"(?i)\b(error|errors|fail|failed|failure|fatal|warning|warn|exception|traceback|assert|expected|actual)\b"
    elided_notice: str = "[%d lines left out]"
    middle_notice: str = "[diagnostic lines among those left out]"
    cut_notice: str = "\n[middle left out to fit the budget]\n"


def collapsed(lines: Column) -> Column:
    """Without lines equal to the one before."""
    return bind(lines, lambda ls: F.filter(ls, lambda x, i: (i == 0) | (x != F.element_at(ls, F.greatest(i, F.lit(1))))))


def reduced_lines(lines: Column, r: Reduction) -> Column:
    """(kept: lines, elided: number of lines left out) of collapsed lines."""

    def cut(ls: Column, found: Column) -> Column:
        n = F.size(ls)
        elided = n - r.head - r.tail - F.size(found)
        told = F.array(F.format_string("\n" + r.elided_notice + "\n", elided))
        diagnostics = F.when(F.size(found) > 0, F.concat(F.array(F.lit(""), F.lit(r.middle_notice)), found, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
        kept = F.concat(F.slice(ls, 1, r.head), told, diagnostics, F.slice(ls, F.greatest(F.lit(1), n - r.tail + 1), F.lit(r.tail)))
        return F.struct(kept.alias("kept"), elided.alias("elided"))

    def told(ls: Column) -> Column:
        n = F.size(ls)
        middle = F.slice(ls, F.lit(r.head + 1), F.greatest(F.lit(0), n - r.head - r.tail))
        found = F.slice(F.filter(middle, lambda x: x.rlike(r.signal)), 1, r.important)
        whole = F.struct(ls.alias("kept"), F.lit(0).alias("elided"))
        return F.when(n > r.head + r.tail + r.important, bind(found, lambda f: cut(ls, f))).otherwise(whole)

    return bind(lines, told)


def fit_ends(text: Column, budget: int, r: Reduction) -> Column:
    """Both ends of a text longer than budget, the notice counted in."""
    room = max(0, budget - len(r.cut_notice))
    tail = int(room * r.tail_share)
    short = lambda t: F.concat(F.substring(t, 1, room - tail), F.lit(r.cut_notice), F.right(t, F.lit(tail)) if tail else F.lit(""))
    return bind(text, lambda t: F.when(F.length(t) > budget, short(t)).otherwise(t))


def reduce_text(df: DataFrame, text: str = "text", r: Reduction = Reduction()) -> DataFrame:
    """df with reduced, raw_chars, sent_chars, elided_lines and changed; short texts stay as they are, null is empty.

    The columns come from a generator of one row, so a filter on them does not make them a second time."""
    names = ("reduced", "elided_lines", "raw_chars", "sent_chars", "changed")

    def told(t: Column, reduced: Column, elided: Column) -> Column:
        values = (reduced, elided, F.length(t), F.length(reduced), reduced != t)
        return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])

    def cut(t: Column) -> Column:
        lines = reduced_lines(collapsed(F.split(t, "\n")), r)
        return bind(lines, lambda k: bind(fit_ends(F.array_join(k["kept"], "\n"), r.max_chars, r), lambda x: told(t, x, k["elided"])))

    made = F.when(F.length("_text") > r.max_chars, cut(F.col("_text"))).otherwise(told(F.col("_text"), F.col("_text"), F.lit(0)))
    return df.drop(*names).withColumn("_text", F.coalesce(F.col(text), F.lit(""))).select("*", F.inline(F.array(made))).drop("_text")


def ledger_rows(reduced: DataFrame, session: Column, project: Column, ts: Column) -> DataFrame:
    """A ledger row for each changed text; session and project by unsalted fingerprint."""
    short = lambda c: F.substring(F.sha2(c, 256), 1, 12)
    return reduced.where("changed").select(ts.alias("ts"), short(session).alias("session"), short(project).alias("project"), "raw_chars", "sent_chars", "elided_lines")
