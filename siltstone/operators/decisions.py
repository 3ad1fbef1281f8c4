"""Ordered decision tables: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How verdicts rank, strictest first, and which kinds of inherited claim are contracts or background.
VERDICTS = ["CONTRADICTED", "UNGROUNDED_NEW_CLAIM", "UNVERIFIABLE_INHERITED_CLAIM", "NON_CHECKABLE", "SUPPORTED"]
CONTRACTS = ["invariant", "public_contract", "concurrency", "security"]
BACKGROUND = ["rationale", "external_dependency", "historical_statement"]


def table(rules: list[tuple[Column, Column | str]], otherwise: Column | str) -> Column:
    """The outcome of the first condition that is true."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    out: Column | None = None
    for when, then in rules:
        out = F.when(when, value(then)) if out is None else out.when(when, value(then))
    return value(otherwise) if out is None else out.otherwise(value(otherwise))


def reasons(**checks: Column) -> Column:
    """Names of all checks that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def strictest(a: Column, b: Column) -> Column:
    """The stricter of two verdicts; two unknown ones are NON_CHECKABLE."""
    place = lambda v: F.coalesce(F.create_map(*[x for i, n in enumerate(VERDICTS) for x in (F.lit(n), F.lit(len(VERDICTS) - i))])[v], F.lit(0))
    return F.when(place(a) >= place(b), F.coalesce(a, F.lit("NON_CHECKABLE"))).otherwise(F.coalesce(b, F.lit("NON_CHECKABLE")))


def route(origin: Column, kind: Column, contradiction: Column, provenance: Column, executable_evidence: Column) -> Column:
    """Where a claim goes, by origin (inherited, synthesized, uncertain), verdicts and kind.

    What was made up never reopens code; nor does what can't be verified, or a contradiction without executable evidence.
    """
    v = strictest(contradiction, provenance)
    open_ = v.isin("UNGROUNDED_NEW_CLAIM", "UNVERIFIABLE_INHERITED_CLAIM")
    quorum = contradiction.eqNullSafe("CONTRADICTED") & F.coalesce(executable_evidence, F.lit(False))
    return table(
        [
            (contradiction.isNull() & provenance.isNull(), "abstain"),
            ((origin == "synthesized") & (open_ | (v == "CONTRADICTED")), "comment_counterexample"),
            (origin == "synthesized", "accept"),
            ((origin == "inherited") & (v == "CONTRADICTED") & kind.isin(CONTRACTS) & quorum, "code_reopen"),
            ((origin == "inherited") & (v == "CONTRADICTED"), "comment_counterexample"),
            ((origin == "inherited") & (v == "UNVERIFIABLE_INHERITED_CLAIM") & kind.isin(BACKGROUND), "preserve_and_audit"),
            ((origin == "inherited") & open_, "human_review"),
            (origin == "inherited", "accept"),
            (v == "CONTRADICTED", "comment_counterexample"),
            (open_, "human_review"),
        ],
        "accept",
    )


def band(size: Column, defines: Column, same_line: Column, same_symbol: Column, high: Column, kept_modified: Column, modified: Column, renamed: Column, large: int = 20, moderate: int = 8, heavy: int = 3) -> Column:
    """hard with two strong signs, medium with one (or a moderate size), else easy; only renames make it one step easier."""
    signs = [size >= large, defines, same_symbol, same_line, high, kept_modified, defines & (modified >= heavy)]
    strong: Column = F.lit(0)
    for s in signs:
        strong = strong + F.coalesce(s, F.lit(False)).cast("int")
    pure = (renamed > 0) & (modified == 0)
    one = F.coalesce(defines | same_line | same_symbol, F.lit(False)) | (size >= moderate)
    return table([((strong >= 2) & pure, "medium"), (strong >= 2, "hard"), (one & pure, "easy"), (one, "medium")], "easy")


def critic_budget(base: int, coverage: Column) -> Column:
    """Retries by the worse side's coverage: all from 0.9, half (rounded up) from 0.5, else one; all where it is unknown."""
    return F.when(coverage.isNull() | (coverage >= 0.9), base).when(coverage >= 0.5, (base + 1) // 2).otherwise(1)


def role_budget(base: int, factor: Column) -> Column:
    """Retries scaled by what the role of a change asks for: at least one, at most twice the base; the base where the factor is unknown."""
    return F.greatest(F.lit(1), F.least(F.floor(base * F.coalesce(factor, F.lit(1.0))).cast("int"), F.lit(2 * base)))


def decide(hard: Column, needs_human: Column, warned: Column, retries: Column, critic_retries: Column, entropy: Column, agreement: Column, coverage: Column, budget: int = 2, critic: int = 2, max_entropy: float = 0.9, min_agreement: float = 0.0) -> Column:
    """accept, retry or escalate, under a budget each for failures, for warnings and for refusals."""
    return table(
        [
            (needs_human & (retries < 1), "retry"),
            (needs_human, "escalate"),
            (hard & (retries < budget), "retry"),
            (hard, "escalate"),
            ((entropy > max_entropy) | (agreement < min_agreement), "escalate"),
            (warned & (critic_retries < critic_budget(critic, coverage)), "retry"),
        ],
        "accept",
    )


def risk_score(needs_human: Column, one_side: Column, markers: Column, syntax: Column, severity: Column) -> Column:
    """A crude 0..1 score; a missing syntax check counts as passed, a missing severity as medium (1)."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    total = 0.5 * yes(needs_human) + 0.2 * yes(one_side) + 0.3 * yes(markers) + 0.3 * (1 - F.coalesce(syntax, F.lit(True)).cast("double")) + 0.1 * F.coalesce(severity.cast("double"), F.lit(1.0))
    return F.least(F.lit(1.0), total)
