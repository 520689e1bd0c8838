"""Ordered decisions and fail-closed gates as column expressions.

A decision table is data: ordered (outcome, condition) pairs of which the first that holds decides. Which
outcomes a project gives to which conditions is its own business; the tables here are those that read text
and structure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomill.functions import text as tx


def first_match(rules: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The outcome of the first rule whose condition holds; null conditions do not hold."""
    out = None
    for outcome, condition in rules:
        out = F.when(condition, outcome) if out is None else out.when(condition, outcome)
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def has_any(c: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(c, F.lit(t))
    return found


def gates(evidence: DataFrame, subject: str, gate: str, status: str, names: Sequence[str], passing: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(subject, *gates, verdict): long evidence pivoted; a missing gate is NOT_EXECUTED.

    The verdict is NOT_EXECUTED if any gate is, else STALE_AUDIT if any is, else PASS if all pass, else FAIL.
    ``passing`` lists statuses that count as passing for a gate besides PASS.
    """
    at = {n: F.max(F.when(F.col(gate) == n, F.col(status))).alias(n) for n in names}
    g = evidence.groupBy(subject).agg(*at.values())
    g = g.select(subject, *[F.coalesce(F.col(n), F.lit("NOT_EXECUTED")).alias(n) for n in names])
    every = F.array(*[F.col(n) for n in names])
    passed = F.array(*[F.col(n).isin("PASS", *(passing or {}).get(n, ())) for n in names])
    verdict = first_match(
        [("NOT_EXECUTED", F.array_contains(every, "NOT_EXECUTED")), ("STALE_AUDIT", F.array_contains(every, "STALE_AUDIT")), ("PASS", F.forall(passed, lambda p: p))], "FAIL"
    )
    return g.withColumn("verdict", verdict)


# What failure logs say, most telling first.
FAILURES = (
    ("DEPRECATION_WARNING", ("deprecationwarning", "deprecated")),
    ("IMPORT_FAILURE", ("modulenotfounderror", "cannot import", "importerror")),
    ("API_ABSENT", ("attributeerror",)),
    ("SIGNATURE_MISMATCH", ("typeerror",)),
    ("BEHAVIOR_MISMATCH", ("assertionerror",)),
    ("ENVIRONMENT_FAILURE", ("internal error", "bwrap", "permission denied", "resource temporarily unavailable")),
)
_SIGNATURE_TERMS = ("unexpected keyword", "missing", "takes", "positional argument", "does not support replacement")


def failure_kind(passed: Column, log: Column) -> Column:
    said = F.lower(F.coalesce(log, F.lit("")))
    rules = [("NONE", passed)]
    for outcome, terms in FAILURES:
        hit = has_any(said, terms)
        rules.append((outcome, hit & has_any(said, _SIGNATURE_TERMS) if outcome == "SIGNATURE_MISMATCH" else hit))
    return first_match(rules, "TEST_EXPECTATION_ONLY")


# What a change's subject line says about its kind, most telling first.
CHANGES = (
    ("API_DEPRECATION", ("deprecat",)),
    ("API_REMOVAL", ("remov", "delete")),
    ("FUNCTION_RENAME", ("renam",)),
    ("SIGNATURE_CHANGE", ("signatur", "arg", "param")),
)


def change_kind(subject: Column) -> Column:
    said = F.lower(F.coalesce(subject, F.lit("")))
    return first_match([(k, has_any(said, terms)) for k, terms in CHANGES], "API_EVOLUTION")


def adjudicated(a: Column, b: Column, human: Column, prior: Column) -> tuple[Column, Column]:
    """Label and how it came about: agreement, else the human label, else the prior one."""
    agree = a.eqNullSafe(b)
    return F.when(agree, a).otherwise(F.coalesce(human, prior)), first_match([("CONSENSUS", agree), ("HUMAN_ADJUDICATED", human.isNotNull())], "EVIDENCE_ADJUDICATED")


# Beginnings of words, and whole words, that tell of deprecation, removal and replacement.
DIRECTION_STEMS, DIRECTION_WORDS = ("deprecat", "remov", "replac", "renam"), ("favor", "instead", "no longer", "disuse")
DIRECTIONS = rf"\b(?:{'|'.join(DIRECTION_STEMS)})|\b(?:{'|'.join(DIRECTION_WORDS)})\b"
# What a claim may do with a symbol, and wordings of what came later.
ACTIONS = ("use", "call", "import", "access", "catch", "raise", "replace", "pass", "remove", "deprecate", "get", "set", "inspect")
FUTURE_TERMS = (
    "will be removed", "deprecated in", "removed in", "replaced by", "should be migrated", "future version", "later version",
    "no longer supported", "obsolete in", "subsequent release", "in favor of",
)


def states_direction(statement: Column) -> Column:
    return F.lower(F.coalesce(statement, F.lit(""))).rlike(DIRECTIONS)


def entailment(candidate: Column, evidence: Column, symbol: Column, replacements: Column) -> Column:
    """ENTAILED: symbol or a replacement in candidate and evidence, with an action; PARTIAL: in one of them."""
    said, shown = F.lower(candidate), F.lower(evidence)
    names = F.filter(F.transform(F.coalesce(replacements, F.array().cast("array<string>")), lambda r: F.split_part(F.lower(F.element_at(F.split(r, r"\."), -1)), F.lit("("), F.lit(1))), lambda r: F.length(r) > 2)
    short = F.lower(tx.short_symbol(symbol))
    inside = lambda t: F.contains(t, short) | F.exists(names, lambda r: F.contains(t, r))
    empty = (F.coalesce(candidate, F.lit("")) == "") | (F.coalesce(evidence, F.lit("")) == "")
    return first_match([("NOT_ENTAILED", empty), ("ENTAILED", inside(said) & inside(shown) & has_any(said, ACTIONS)), ("PARTIAL", inside(said) | inside(shown))], "NOT_ENTAILED")


def attribution(claim: str, gold: str, diff: Column) -> Column:
    """How well a claim is attributed, from struct columns of a claim and its gold record, in order:
    commit missing or wrong, artifact wrong, symbol unknown, then SUPPORTED or PARTIAL."""
    c, g = (lambda f: F.col(f"{claim}.{f}")), (lambda f: F.col(f"{gold}.{f}"))
    text = F.lower(F.coalesce(diff, F.lit("")))
    commit = F.trim(F.coalesce(c("evidence_commit"), F.lit("")))
    target = F.coalesce(g("target_commit"), F.lit(""))
    artifact = tx.paths_match(c("artifact_uri"), g("artifact_uri")) | (text != "") & F.contains(text, F.lower(tx.basename(c("artifact_uri"))))
    short = F.lower(tx.short_symbol(c("symbol")))
    in_diff = (short != "") & (text != "") & F.contains(text, short)
    known = tx.symbols_match(c("symbol"), g("symbol"), c("statement")) | in_diff
    rep = F.lower(tx.short_symbol(g("replacement_symbol")))
    replaced = (rep == "") | F.contains(F.lower(c("statement")), rep)
    entailed = (text == "") | (((short == "") | in_diff) & ((rep == "") | F.contains(text, rep)))
    full = states_direction(c("statement")) & replaced & entailed
    return first_match(
        [
            ("MISSING_COMMIT_ATTRIBUTION", commit == ""),
            ("WRONG_COMMIT", (target != "") & ~F.startswith(target, commit)),
            ("WRONG_ARTIFACT", ~F.coalesce(artifact, F.lit(False))),
            ("UNSUPPORTED", ~F.coalesce(known, F.lit(False))),
            ("SUPPORTED", full),
        ],
        "PARTIAL",
    )


def leakage_level(defines_target: Column, migration: Column, near: Column, hinted: Column) -> Column:
    return first_match([("TRIVIALIZES_TASK", defines_target | migration), ("NEAR_SOLUTION", near), ("HINTED", hinted)], "NONTRIVIAL")


def graded(checks: Sequence[Column]) -> Column:
    """ENTAILED if all checks hold, PARTIAL if any does, else NOT_ENTAILED; null checks do not hold."""
    held = F.array(*[F.coalesce(c, F.lit(False)) for c in checks])
    return first_match([("ENTAILED", F.forall(held, lambda x: x)), ("PARTIAL", F.exists(held, lambda x: x))], "NOT_ENTAILED")


def symbol_state(found: Column, deprecated: Column, hooked: Column, missing: str = "absent") -> Column:
    """State of a symbol on one side of a change, from what its definitions say."""
    return first_match([(missing, ~F.coalesce(found, F.lit(False))), ("deprecated_getattr", hooked), ("deprecated_warn", deprecated)], "exists_active")


def later_knowledge(statement: Column, base: Column, commit: Column, number: Column, replacements: Column) -> Column:
    """What a statement knows that its base text cannot: the change's number or commit, later wordings, new names."""
    said, known = F.lower(F.coalesce(statement, F.lit(""))), F.lower(F.coalesce(base, F.lit("")))
    short = F.lower(F.left(commit, F.lit(8)))
    names = F.filter(F.transform(F.coalesce(replacements, F.array().cast("array<string>")), lambda r: F.lower(F.trim(r))), lambda r: (F.length(r) >= 4) & ~F.contains(known, r))
    padded = F.concat(F.lit(" "), F.regexp_replace(said, r"[^\p{L}\p{N}_]", " "), F.lit(" "))
    hits = F.array(
        F.when((number != "") & F.contains(said, F.concat(F.lit("#"), number)), "number"),
        F.when((F.length(short) == 8) & F.contains(said, short), "commit"),
        F.when(F.size(tx.terms_beyond(said, known, FUTURE_TERMS)) > 0, "wording"),
        F.when(F.exists(names, lambda r: F.contains(padded, F.concat(F.lit(" "), r, F.lit(" ")))), "replacement"),
    )
    return F.filter(hits, lambda h: h.isNotNull())


def factuality(leaks: Column, grounded: Column, contradicted: Column) -> Column:
    """Deterministic judgement, failing closed: contradiction first, then support needs grounding and isolation."""
    return first_match([("CONTRADICTED", contradicted), ("FACTUALLY_SUPPORTED", grounded & (F.size(leaks) == 0))], "INSUFFICIENT_EVIDENCE")


# Paths of documents and of tests.
_DOCS, _TESTS = r"^docs?/|\.(?:md|rst|txt)$", r"^(?:test|tests|testing)/"


def change_triage(paths: Column, n_changes: Column, n_public: Column) -> Column:
    """What a change touches: nothing, documents only, tests only, no Python, layout only, an API, or noise."""
    python = F.filter(paths, lambda p: F.endswith(p, F.lit(".py")))
    return first_match(
        [
            ("REJECT_EMPTY", F.size(paths) == 0),
            ("REJECT_DOCS_ONLY", F.forall(paths, lambda p: p.rlike(_DOCS))),
            ("REJECT_TEST_ONLY", (F.size(python) > 0) & F.forall(python, lambda p: p.rlike(_TESTS))),
            ("REJECT_NON_PYTHON", F.size(python) == 0),
            ("REJECT_FORMAT_ONLY", n_changes == 0),
            ("HIGH_CONFIDENCE", n_public > 0),
        ],
        "NOISE",
    )


def merge_kind(merged: Column, merge_commit: Column, head: Column, target: Column, head_reaches: Column, message: Column, number: Column) -> Column:
    """How a change came in: by merge commit, fast forward, rebase, squash, or unknown."""
    short = F.lower(F.left(target, F.lit(8)))
    is_ = lambda c: F.startswith(F.lower(c), short)
    named = F.contains(message, F.concat(F.lit("#"), number))
    return first_match([("unknown", ~merged), ("merge_commit", is_(merge_commit)), ("fast_forward", is_(head)), ("rebase_ancestor", head_reaches), ("squash_merge", named)], "unknown")


# Wordings of migration advice in comments.
ADVICE = ("use .* instead of", "deprecated.*use", "replaced by", "migrate from", "in favor of")
_ADVICE = rf'(?im)^[ \t]*(?:#|\*|""").*(?:{"|".join(ADVICE)})'


def context_leakage(context: Column, target: Column, replacements: Column) -> Column:
    """Whether a context defines the target, hints at its replacement or a migration, or neither."""
    text, name = F.coalesce(context, F.lit("")), tx.short_symbol(target)
    defined = F.regexp_extract_all(text, F.lit(r"(?:def|class)\s+([A-Za-z_]\w*)\s*[:(]"), F.lit(1))
    used = tx.tokens(text)
    hinted = F.exists(F.coalesce(replacements, F.array().cast("array<string>")), lambda r: (F.length(F.trim(r)) >= 3) & F.array_contains(used, F.lower(F.trim(r))))
    return leakage_level(F.array_contains(defined, name), F.lit(False), F.lit(False), hinted | text.rlike(_ADVICE))


def provenance(parts: Sequence[tuple[Column, Column]], others: Sequence[Column]) -> Column:
    """Whether each text has its recorded digest (an empty record never does) and all other checks hold."""
    ok = F.lit(True)
    for text, digest in parts:
        ok = ok & (F.coalesce(digest, F.lit("")) != "") & F.coalesce(F.sha2(text, 256) == digest, F.lit(False))
    for o in others:
        ok = ok & F.coalesce(o, F.lit(False))
    return F.when(ok, "VERIFIED").otherwise("FAILED")


def simulated_action(category: Column, method: Column, text: Column, kinds: Column, stale: dict[str, str], cancelled: str, warning: str, blind: Sequence[str]) -> tuple[Column, Column]:
    """Whether a simulated agent acts on stale text, and whether it flags a conflict, without running anything.

    ``stale`` has, per category, the text that marks stale knowledge. An explicit update is followed unless the
    update's notice (``cancelled``) is missing or the method ignores validity; stale evidence is used only by the
    ``blind`` methods; a conflict is flagged by a warning record or its wording.
    """
    seen = lambda c: (category == c) & F.contains(text, F.lit(stale[c])) if c in stale else F.lit(False)
    used = seen("explicit_update") & (~F.contains(text, F.lit(cancelled)) | (method == "no_validity")) | seen("stale_evidence") & method.isin(*blind)
    flagged = (category == "unresolved_conflict") & (F.array_contains(kinds, "conflict_warning") | F.contains(text, F.lit(warning)))
    return F.coalesce(used, F.lit(False)), F.coalesce(flagged, F.lit(False))
