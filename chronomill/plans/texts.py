"""Queries of text functions and of classification by what texts say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomill.common import table
from chronomill.functions import code
from chronomill.functions import text as tx
from chronomill.operators import rules, stats
from chronomill.plans import sql
from chronomill.plans.store import v1_records
from chronomill.sources import readers

_TICKS = "```"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def hashes(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d)
    return t.select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.md5("text"), 1, 8).alias("short_md5"), tx.fingerprint(F.col("lang"), F.col("source"), F.col("n_chars")).alias("fingerprint"))


def token_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens each of the tokenisers finds."""
    n = lambda c: F.size(c)
    return documents(spark, d).where("text is not null").select(
        "doc_id", n(tx.tokens("text")).alias("n_tokens"), n(tx.tokens("text", 2)).alias("n_long"), n(tx.ascii_tokens("text")).alias("n_ascii"),
        n(tx.long_tokens("text")).alias("n_four"), n(tx.split_words("text")).alias("n_words"),
    )


def symbol_names(spark: SparkSession, d: str) -> DataFrame:
    v = v1_records(spark, d).where("symbol is not null")
    call = F.concat(F.lit(" \""), "symbol_qualified_name", F.lit("()"))
    return v.select(
        "memory_id", tx.normal_symbol(F.concat(F.lit("'"), "symbol", F.lit("'"))).alias("symbol"), tx.short_symbol("symbol_qualified_name").alias("short"),
        tx.symbols_match(F.col("symbol"), call, F.col("statement")).alias("matches"),
    )


def path_names(spark: SparkSession, d: str) -> DataFrame:
    """Records whose statement names a file, with how that file fits their own path."""
    v = v1_records(spark, d).where("artifact_uri <> ''").withColumn("named", F.regexp_extract("statement", r"(src/[a-z_/]+\.py)", 1)).where("named <> ''")
    return v.select("memory_id", "named", tx.basename("artifact_uri").alias("file_name"), tx.paths_match(F.col("artifact_uri"), F.col("named")).alias("fits"))


def normal_spaces(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(tx.normal_space("text")).alias("normal_md5"), tx.same_lines(F.col("text"), F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("same_lines"))


def fences(spark: SparkSession, d: str) -> DataFrame:
    """Code of fenced blocks in a Markdown file of a task: how many, the longest and the last."""
    files = table(spark, d, "task_environments").where("task_id is not null").select("task_id", F.explode("initial_workspace").alias("path", "content")).where("endswith(path, '.md')")
    one = files.groupBy("task_id", "path").agg(F.min("content").alias("content"))
    found = tx.fenced("content")
    return one.select("task_id", "path", F.size(found).alias("n_blocks"), F.md5(tx.longest(found)).alias("longest_md5"), F.md5(F.try_element_at(found, F.lit(-1))).alias("last_md5"))


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Statements that are JSON, read tolerantly."""
    r = table(spark, d, "memory_records").select("id", F.from_json(tx.fenced_json("statement"), "symbol string, file string, owner string").alias("j"))
    return r.where("j.symbol is not null").groupBy("id").agg(F.max("j.symbol").alias("symbol"), F.max("j.file").alias("file"), F.max("j.owner").alias("owner"))


def version_claims(spark: SparkSession, d: str) -> DataFrame:
    """Impossible version ranges and contradicted return claims in texts made from statements."""
    v = v1_records(spark, d).where("statement is not null")
    ver = F.regexp_extract("statement", r"(\d+\.\d+)", 1)
    claim = F.concat(F.lit("needs "), ver, F.lit(" or later but less than 5.4; always returns true"))
    return v.where(ver != "").select("memory_id", ver.alias("version"), tx.impossible_range(claim).alias("impossible"), tx.always_contradicted(claim, F.col("statement")).alias("contradicted"))


def future_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of later knowledge in a statement that its task's text does not have."""
    v = v1_records(spark, d).where("statement is not null")
    found = tx.terms_beyond(F.col("statement"), F.col("artifact_uri"), (*rules.FUTURE_TERMS, "was removed", "until"))
    return v.select("memory_id", F.array_join(found, ",").alias("terms"), rules.states_direction(F.col("statement")).alias("states_direction"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", F.md5(tx.excerpt("text", F.lit("def "))).alias("excerpt_md5")).where("excerpt_md5 is not null")


def diff_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Diffs among the documents, those over 1,200 characters shortened, hunks of source files first."""
    diffs = table(spark, d, "documents").where("doc_kind = 'commit_diff' and text is not null")
    return readers.truncated_diffs(diffs, "doc_id", "text", most=1200, least_rest=100).select("doc_id", F.md5("diff").alias("diff_md5"), F.length("diff").alias("n_chars"))


def diff_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Hunks of diffs in documents, scored by what they show; the best hunk of each document ranks first."""
    h = readers.hunks(documents(spark, d).where("doc_kind = 'commit_diff' and text is not null"), "doc_id", "text")
    score = F.when(F.contains("hunk", F.lit("policy")), 5).otherwise(0) + F.when(F.contains("hunk", F.lit("release")), 3).otherwise(0) + F.when(F.col("hunk").rlike("def |class |import "), 1).otherwise(0)
    return h.select("doc_id", "hunk_no", "n_added", "n_removed", score.alias("score"), F.md5("hunk").alias("hunk_md5"))


def best_hunks(spark: SparkSession, d: str) -> DataFrame:
    h = diff_hunks(spark, d)
    return h.groupBy("doc_id").agg(F.max_by(F.struct("hunk_no", "score"), F.struct(F.col("score"), -F.col("hunk_no"))).alias("b"), F.count("*").alias("n_hunks")).select("doc_id", "b.hunk_no", "b.score", "n_hunks")


def issue_numbers(spark: SparkSession, d: str) -> DataFrame:
    at = F.concat(F.lit("https://example.org/o/r/pull/"), F.col("doc_id").cast("string"), F.lit("/files"))
    return documents(spark, d).select("doc_id", tx.issue_number(at).alias("number"), tx.issue_number("source").alias("none"))


def near_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of a task's instruction that begin like a word of its description."""
    t = table(spark, d, "task_environments").where("task_id is not null").groupBy("task_id").agg(F.min("current_task_instruction").alias("a"), F.min("description").alias("b"))
    return t.select("task_id", tx.near_words(F.array_distinct(tx.long_tokens(F.coalesce("a", F.lit("")))), F.array_distinct(tx.long_tokens(F.coalesce("b", F.lit(""))))).alias("n_near"))


def roundings(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("observed_at") / 7
    return v1_records(spark, d).select("memory_id", F.round(v, 1).alias("one"), F.round(v, 2).alias("two"), F.round(v, 4).alias("four"))


def packed_headers(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "task_environments").where("task_id is not null").select("task_id", F.explode("initial_workspace").alias("path", "content")).distinct()
    text = files.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("path")), lambda p: F.concat(F.lit("# File: "), p, F.lit(" (Lines 1-40)\nx"))), "\n").alias("context"))
    return text.select("task_id", F.array_join(tx.packed_files("context"), ",").alias("files"))


def value_scan(spark: SparkSession, d: str) -> DataFrame:
    """Where a task's target symbol is given away: in its instruction, its description or a workspace file."""
    t = table(spark, d, "task_environments").where("task_id is not null")
    places = F.array(
        F.struct(F.lit("instruction").alias("place"), F.array("current_task_instruction").alias("texts")),
        F.struct(F.lit("description").alias("place"), F.array("description").alias("texts")),
        F.struct(F.lit("workspace").alias("place"), F.map_values("initial_workspace").alias("texts")),
    )
    rows = t.select("task_id", "target_symbol", F.explode(places).alias("p")).select("task_id", "target_symbol", "p.place", F.explode("p.texts").alias("text"))
    return rows.where(F.contains("text", F.col("target_symbol"))).select("task_id", "place").distinct()


def failure_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episode_events").dropDuplicates(["event_id"])
    log = F.concat_ws(" ", F.coalesce("error", F.lit("")), F.when(F.pmod("event_id", F.lit(4)) == 0, "TypeError: missing argument").when(F.pmod("event_id", F.lit(4)) == 1, "ImportError").otherwise(F.lit("AssertionError: no")))
    return e.groupBy(rules.failure_kind(F.coalesce(F.col("status") == "PASSED", F.lit(False)), log).alias("failure")).agg(F.count("*").alias("n"))


def change_kinds(spark: SparkSession, d: str) -> DataFrame:
    return v1_records(spark, d).groupBy(rules.change_kind(F.col("statement")).alias("change")).agg(F.count("*").alias("n"))


def entailments(spark: SparkSession, d: str) -> DataFrame:
    """Records whose statement is judged against the target commit's message made of symbol and kind."""
    v = v1_records(spark, d)
    evidence = F.concat_ws(" ", "evidence_ref", F.when(F.pmod("ingest_seq", F.lit(2)) == 0, F.col("symbol")), F.lit("use"))
    words = F.regexp_extract("statement", r"([a-z]+_[a-z0-9_]+)", 1)
    return v.select("memory_id", rules.entailment(F.col("statement"), evidence, words, F.array("symbol")).alias("entailment"))


def attributions(spark: SparkSession, d: str) -> DataFrame:
    """Records as claims, judged against the previous record's commit, path and symbol."""
    v = v1_records(spark, d).where("artifact_uri is not null and statement is not null")
    claim = F.struct(F.when(F.pmod("ingest_seq", F.lit(5)) > 0, F.col("source_commit")).alias("evidence_commit"), "artifact_uri", F.coalesce("symbol", F.lit("")).alias("symbol"), "statement")
    gold = F.struct(F.when(F.pmod("ingest_seq", F.lit(7)) > 0, F.col("source_commit")).otherwise(F.lit("fffffff")).alias("target_commit"), F.when(F.pmod("ingest_seq", F.lit(3)) > 0, F.col("artifact_uri")).otherwise(F.lit("x/none.py")).alias("artifact_uri"), F.coalesce("symbol_qualified_name", F.lit("other")).alias("symbol"), F.lit("").alias("replacement_symbol"))
    return v.select("memory_id", claim.alias("c"), gold.alias("g")).select("memory_id", rules.attribution("c", "g", F.lit("")).alias("attribution"))


def leakage_levels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task_environments").where("task_id is not null").select("task_id", "target_symbol", F.array_join(F.map_values("initial_workspace"), "\n").alias("context"))
    one = t.groupBy("task_id").agg(F.max(F.struct("target_symbol", "context")).alias("t")).select("task_id", "t.*")
    c = F.coalesce("context", F.lit(""))
    defines = F.contains(c, F.concat(F.lit("def "), F.col("target_symbol"), F.lit("(")))
    level = rules.leakage_level(defines, c.rlike("(?i)migrat"), F.contains(c, F.lit("return True\n\n\ndef")), F.contains(c, F.split("target_symbol", "_")[0]))
    return one.select("task_id", level.alias("level"))


def support_grades(spark: SparkSession, d: str) -> DataFrame:
    """How many of four checks tie a record's statement to its own artifact and symbol."""
    v = v1_records(spark, d)
    said = F.lower(F.coalesce("statement", F.lit("")))
    checks = [F.contains(said, F.lit("_")), F.contains(said, F.lower(tx.basename("artifact_uri"))), rules.states_direction(F.col("statement")), F.contains(said, F.lower("symbol"))]
    return v.select("memory_id", rules.graded(checks[:1] + checks[2:3]).alias("wording"), rules.graded(checks).alias("support"))


def later_knowledge(spark: SparkSession, d: str) -> DataFrame:
    """What statements know beyond their artifact's path, with the record's number and commit as the change's."""
    v = v1_records(spark, d).where("statement is not null")
    text = F.concat_ws(" ", "statement", F.when(F.pmod("ingest_seq", F.lit(4)) == 0, F.concat(F.lit("#"), F.col("ingest_seq").cast("string"))), F.when(F.pmod("ingest_seq", F.lit(4)) == 1, F.lit("in favor of release_queue")))
    leaks = rules.later_knowledge(text, F.col("artifact_uri"), F.lit("abcdef0123"), F.col("ingest_seq").cast("string"), F.array(F.lit("release_queue"), F.lit("abc")))
    grounded = F.contains(F.lower("statement"), F.lit("src/"))
    return v.select("memory_id", F.array_join(leaks, ",").alias("leaks"), rules.factuality(leaks, grounded, F.contains(F.lower("statement"), F.lit("never"))).alias("factuality"))


def change_triage(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by what their transition touches; names of functions count as public unless they begin with an underscore."""
    t = table(spark, d, "task_environments").where("task_id is not null").select("task_id", F.coalesce(F.map_keys("workspace_transition"), F.array().cast("array<string>")).alias("p"), F.array_join(F.map_values("workspace_transition"), "\n").alias("c"))
    one = t.groupBy("task_id").agg(F.max(F.struct(F.array_sort("p").alias("paths"), "c")).alias("t")).select("task_id", "t.*")
    names = F.regexp_extract_all(F.coalesce("c", F.lit("")), F.lit(r"def ([A-Za-z_0-9]+)"), F.lit(1))
    return one.select("task_id", rules.change_triage(F.col("paths"), F.size(names), F.size(F.filter(names, lambda n: ~F.startswith(n, F.lit("_"))))).alias("triage"))


def merge_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Records as changes, by how they came in."""
    v = v1_records(spark, d).where("source_commit is not null")
    k = F.pmod("ingest_seq", F.lit(6))
    c, other = F.concat(F.col("source_commit"), F.lit("00")), F.lit("ffffffffff")
    kind = rules.merge_kind(k > 0, F.when(k == 1, c).otherwise(other), F.when(k == 2, c).otherwise(other), c, k == 3, F.when(k == 4, F.lit("Fix #77")).otherwise(F.lit("Fix")), F.lit("77"))
    return v.groupBy(kind.alias("merged_by")).agg(F.count("*").alias("n"))


def context_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Whether a task's transition gives its target away."""
    t = table(spark, d, "task_environments").where("task_id is not null").select("task_id", "target_symbol", "required_patterns", F.array_join(F.map_values("workspace_transition"), "\n").alias("c"))
    one = t.groupBy("task_id").agg(F.max(F.struct("target_symbol", "required_patterns", "c")).alias("t")).select("task_id", "t.*")
    return one.select("task_id", rules.context_leakage(F.col("c"), F.col("target_symbol"), F.col("required_patterns")).alias("leakage"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Records whose statement still has the digest taken of it, and whose artifact and time are known."""
    v = v1_records(spark, d)
    stamp = F.when(F.pmod("ingest_seq", F.lit(5)) == 0, F.lit("")).when(F.pmod("ingest_seq", F.lit(5)) == 1, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("statement", 256))
    return v.select("memory_id", rules.provenance([(F.col("statement"), stamp)], [F.col("artifact_uri") != "", F.col("valid_from").isNotNull()]).alias("provenance"))


def symbol_states(spark: SparkSession, d: str) -> DataFrame:
    """State of each function before and after a task's transition, counted."""
    from chronomill.plans.matching import _tree

    def side(s: str, missing: str) -> DataFrame:
        files = _tree(spark, d, s).where("endswith(path, '.py')").withColumn("file_key", F.concat_ws("#", "task_id", "path"))
        defs = code.symbol_definitions(files, "file_key", "content").where("kind in ('function', 'class', 'hook')")
        return defs.groupBy("file_key", "qualified_name").agg(F.bool_or("deprecated").alias("d"), F.bool_or(F.col("kind") == "hook").alias("h"))

    a, b = side("initial_workspace", "absent"), side("workspace_transition", "removed")
    j = a.join(b.withColumnsRenamed({"d": "d2", "h": "h2"}), ["file_key", "qualified_name"], "full")
    before = rules.symbol_state(F.col("d").isNotNull(), F.col("d"), F.col("h"))
    after = rules.symbol_state(F.col("d2").isNotNull(), F.col("d2"), F.col("h2"), "removed")
    return j.groupBy(before.alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


def simulated_actions(spark: SparkSession, d: str) -> DataFrame:
    """What a simulated agent does with the record each event retrieved, per method and category."""
    e = table(spark, d, "episode_events").dropDuplicates(["event_id"]).select("event_id", "category", "method", F.col("record_id").alias("id"))
    r = table(spark, d, "memory_records").groupBy("id").agg(F.min_by(F.struct("statement", "type"), "ingest_seq").alias("r")).select("id", "r.*")
    text, kinds = F.coalesce("statement", F.lit("")), F.array("type")
    used, flagged = rules.simulated_action(
        F.col("category"), F.col("method"), text, kinds, {"explicit_update": "release", "stale_evidence": "lock"}, "removed", "already held", ("no_validity", "recent", "bm25")
    )
    return e.join(r, "id").groupBy("method", "category").agg(F.count("*").alias("n"), F.count_if(used).alias("n_stale"), F.count_if(flagged).alias("n_flagged"))


def attribution_rates(spark: SparkSession, d: str) -> DataFrame:
    """Counts by attribution, the share supported and the share without support."""
    a = attributions(spark, d)
    names = ("SUPPORTED", "PARTIAL", "UNSUPPORTED", "WRONG_ARTIFACT", "WRONG_COMMIT", "MISSING_COMMIT_ATTRIBUTION")
    g = a.agg(F.count("*").alias("n_claims"), *[F.count_if(F.col("attribution") == n).alias(n.lower()) for n in names])
    bad = F.col("unsupported") + F.col("wrong_artifact") + F.col("wrong_commit") + F.col("missing_commit_attribution")
    return g.withColumns({"supported_rate": F.round(stats.ratio(F.col("supported"), F.col("n_claims")), 6), "unsupported_rate": F.round(stats.ratio(bad, F.col("n_claims")), 6)})


QUERIES = {
    k: globals()[k]
    for k in (
        "hashes", "token_kinds", "symbol_names", "path_names", "normal_spaces", "fences", "json_fields", "version_claims", "future_terms", "excerpts", "diff_excerpts", "diff_hunks",
        "best_hunks", "issue_numbers", "near_words", "roundings", "packed_headers", "value_scan", "failure_kinds", "change_kinds", "entailments", "attributions", "leakage_levels",
        "support_grades", "later_knowledge", "change_triage", "merge_kinds", "context_leakage", "provenance", "symbol_states",
        "simulated_actions", "attribution_rates",
    )
}

_NORMAL = lambda c: f"regexp_replace(regexp_replace(trim(coalesce({c}, '')), '[()]+$', ''), '^[\"'']|[\"'']$', '', 'g')"
_FOUR = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9_]{{4,}}')"
_TERMS = ", ".join(f"'{t}'" for t in (*rules.FUTURE_TERMS, "was removed", "until"))
_HUNKS = r"""
l as (select doc_id, string_split(replace(text, e'\r\n', e'\n'), e'\n') as ls from documents where doc_kind = 'commit_diff' and text is not null),
x as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from l),
n as (select *, sum(starts_with(line, '@@ ')::int) over (partition by doc_id order by i) as hunk_no from x),
h as (select doc_id, hunk_no::int as hunk_no, string_agg(line, e'\n' order by i) as hunk, count(*) filter (starts_with(line, '+') and not starts_with(line, '+++')) as n_added,
  count(*) filter (starts_with(line, '-') and not starts_with(line, '---')) as n_removed from n where hunk_no > 0 and not starts_with(line, 'diff --git ') group by all),
s as (select *, case when contains(hunk, 'policy') then 5 else 0 end + case when contains(hunk, 'release') then 3 else 0 end + case when regexp_matches(hunk, 'def |class |import ') then 1 else 0 end as score from h)"""
_MD = "f as (select task_id, e.key as path, min(e.value) as content from (select task_id, unnest(map_entries(initial_workspace)) as e from task_environments where task_id is not null) where ends_with(e.key, '.md') group by all)"
_CASE = lambda table_, c, other: "case " + " ".join("when " + " or ".join(f"contains({c}, '{t}')" for t in ts) + f" then '{k}'" for k, ts in table_) + f" else '{other}' end"

ORACLES = {
    "hashes": "select doc_id, sha256(text) as sha, left(md5(text), 8) as short_md5, sha256(coalesce(lang, 'MISSING') || chr(31) || coalesce(source, 'MISSING') || chr(31) || coalesce(n_chars::varchar, 'MISSING')) as fingerprint from documents",
    "token_kinds": f"select doc_id, len({sql.tokens('text')}) as n_tokens, len({sql.tokens('text', 2)}) as n_long, len(list_filter({sql.tokens('text')}, lambda x: regexp_full_match(x, '[a-z0-9_]+'))) as n_ascii, len({_FOUR('text')}) as n_four, len({sql.words('text')}) as n_words from documents where text is not null",
    "symbol_names": f"""with {sql.DELIVERIES}, x as (select memory_id, symbol, lower({_NORMAL('symbol')}) as na, lower({_NORMAL("' \"' || symbol_qualified_name || '()'")}) as nb, split_part({_NORMAL('symbol_qualified_name')}, '.', -1) as short, lower(coalesce(statement, '')) as st, symbol_qualified_name as q from d where symbol is not null)
select memory_id, symbol, short, na <> '' and nb <> '' and (na = nb or split_part(na, '.', -1) = split_part(nb, '.', -1) or (contains(st, split_part(na, '.', -1)) and contains(st, split_part(nb, '.', -1)))) as matches from x""",
    "path_names": f"with {sql.DELIVERIES}, x as (select memory_id, artifact_uri, regexp_extract(statement, '(src/[a-z_/]+\\.py)', 1) as named, split_part(artifact_uri, '/', -1) as file_name from d where artifact_uri <> '') select memory_id, named, file_name, file_name = split_part(named, '/', -1) or ends_with(artifact_uri, named) or ends_with(named, artifact_uri) as fits from x where named <> ''",
    "normal_spaces": f"select doc_id, md5(trim(regexp_replace(text, '{sql.SPACE}+', ' ', 'g'))) as normal_md5, replace(text, e'\\r\\n', e'\\n') is not distinct from replace(replace(text, e'\\n', e'\\r\\n'), e'\\r\\n', e'\\n') as same_lines from documents",
    "fences": f"""with {_MD}, x as (select *, regexp_extract_all(content, '(?s){_TICKS}python\\s*(.*?)\\s*{_TICKS}', 1) as b from f)
select task_id, path, len(b) as n_blocks, md5((list_sort(list_transform(b, lambda x, i: {{'n': length(x), 'i': -i, 'x': x}}), 'DESC'))[1].x) as longest_md5, md5(b[-1]) as last_md5 from x""",
    "json_fields": "with x as (select id, case when json_valid(statement) then statement::json end as j from memory_records) select id, max(j->>'$.symbol') as symbol, max(j->>'$.file') as file, max(j->>'$.owner') as owner from x where j->>'$.symbol' is not null group by 1",
    "version_claims": f"with {sql.DELIVERIES}, x as (select memory_id, regexp_extract(statement, '([0-9]+\\.[0-9]+)', 1) as version, lower(statement) as st from d where statement is not null) select memory_id, version, [split_part(version, '.', 1)::int, split_part(version, '.', 2)::int] >= [5, 4] as impossible, contains(st, 'return false') and not contains(st, 'return true') as contradicted from x where version <> ''",
    "future_terms": f"with {sql.DELIVERIES} select memory_id, array_to_string(list_filter([{_TERMS}], lambda t: contains(lower(statement), t) and not contains(lower(coalesce(artifact_uri, '')), t)), ',') as terms, regexp_matches(lower(statement), '{rules.DIRECTIONS}') as states_direction from d where statement is not null",
    "excerpts": "with x as (select doc_id, string_split(text, e'\\n') as ls from documents where text is not null), y as (select *, list_position(list_transform(ls, lambda l: contains(l, 'def ')), true) as p from x) select doc_id, md5(array_to_string(ls[greatest(p - 2, 1) : p + 8], e'\\n')) as excerpt_md5 from y where p > 0",
    "diff_excerpts": """with l as (select doc_id, text, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) as k
  from documents where doc_kind = 'commit_diff' and length(text) > 1200),
h as (select *, coalesce(contains(last_value(case when starts_with(line, 'diff --git') then line end ignore nulls) over (partition by doc_id order by k), 'src/'), false) as is_source from l),
p as (select doc_id, coalesce(string_agg(line, chr(10) order by k) filter (is_source), '') as a, coalesce(string_agg(line, chr(10) order by k) filter (not is_source), '') as b from h group by 1),
x as (select d.doc_id, case when p.doc_id is null then text when 1200 - length(a) > 100 then a || chr(10) || b[1 : 1200 - length(a)] else a end as t from documents d left join p using (doc_id) where doc_kind = 'commit_diff' and text is not null)
select doc_id, md5(t) as diff_md5, length(t)::int as n_chars from x""",
    "diff_hunks": f"with {_HUNKS} select doc_id, hunk_no, n_added, n_removed, score, md5(hunk) as hunk_md5 from s",
    "best_hunks": f"with {_HUNKS} select doc_id, hunk_no, score, n_hunks from (select *, count(*) over (partition by doc_id) as n_hunks, row_number() over (partition by doc_id order by score desc, hunk_no) as r from s) where r = 1",
    "issue_numbers": "select doc_id, doc_id as number, null::bigint as none from documents",
    "near_words": f"with t as (select task_id, min(current_task_instruction) as a, min(description) as b from task_environments where task_id is not null group by 1), w as (select task_id, list_distinct({_FOUR(chr(99) + 'oalesce(a, ' + chr(39) * 2 + ')')}) as a, list_distinct({_FOUR('coalesce(b, ' + chr(39) * 2 + ')')}) as b from t) select task_id, len(list_filter(a, lambda x: len(list_filter(b, lambda y: starts_with(y, left(x, 4)))) > 0)) as n_near from w",
    "roundings": f"with {sql.DELIVERIES} select memory_id, round(observed_at / 7, 1) as one, round(observed_at / 7, 2) as two, round(observed_at / 7, 4) as four from d",
    "packed_headers": "with f as (select distinct task_id, unnest(map_keys(initial_workspace)) as p from task_environments where task_id is not null) select task_id, string_agg(p, ',' order by p) as files from f group by 1",
    "value_scan": """with p as (select task_id, target_symbol, 'instruction' as place, current_task_instruction as t from task_environments where task_id is not null union all select task_id, target_symbol, 'description', description from task_environments where task_id is not null
  union all select task_id, target_symbol, 'workspace', unnest(map_values(initial_workspace)) from task_environments where task_id is not null) select distinct task_id, place from p where contains(t, target_symbol)""",
    "failure_kinds": """with e as (select distinct * from episode_events), x as (select coalesce(status = 'PASSED', false) as ok, lower(coalesce(error, '') || ' ' || case when event_id % 4 = 0 then 'TypeError: missing argument' when event_id % 4 = 1 then 'ImportError' else 'AssertionError: no' end) as l from e)
select case when ok then 'NONE' when contains(l, 'deprecationwarning') or contains(l, 'deprecated') then 'DEPRECATION_WARNING' when contains(l, 'modulenotfounderror') or contains(l, 'cannot import') or contains(l, 'importerror') then 'IMPORT_FAILURE'
  when contains(l, 'attributeerror') then 'API_ABSENT' when contains(l, 'typeerror') and regexp_matches(l, 'unexpected keyword|missing|takes|positional argument|does not support replacement') then 'SIGNATURE_MISMATCH'
  when contains(l, 'assertionerror') then 'BEHAVIOR_MISMATCH' else 'TEST_EXPECTATION_ONLY' end as failure, count(*) as n from x group by 1""",
    "change_kinds": f"with {sql.DELIVERIES} select {_CASE(rules.CHANGES, 'lower(coalesce(statement, chr(32)))', 'API_EVOLUTION')} as change, count(*) as n from d group by 1",
    "leakage_levels": """with x as (select task_id, target_symbol, array_to_string(map_values(initial_workspace), e'\\n') as context from task_environments where task_id is not null),
t as (select * from x qualify row_number() over (partition by task_id order by target_symbol desc, context desc) = 1)
select task_id, case when contains(coalesce(context, ''), 'def ' || target_symbol || '(') or regexp_matches(coalesce(context, ''), '(?i)migrat') then 'TRIVIALIZES_TASK' when contains(coalesce(context, ''), e'return True\\n\\n\\ndef') then 'NEAR_SOLUTION'
  when contains(coalesce(context, ''), split_part(target_symbol, '_', 1)) then 'HINTED' else 'NONTRIVIAL' end as level from t""",
    "support_grades": f"""with {sql.DELIVERIES}, x as (select memory_id, [contains(st, '_'), coalesce(contains(st, lower(split_part(artifact_uri, '/', -1))), false), regexp_matches(st, '{rules.DIRECTIONS}'), coalesce(contains(st, lower(symbol)), false)] as c
  from (select *, lower(coalesce(statement, '')) as st from d))
select memory_id, case when c[1] and c[3] then 'ENTAILED' when c[1] or c[3] then 'PARTIAL' else 'NOT_ENTAILED' end as wording, case when not list_contains(c, false) then 'ENTAILED' when list_contains(c, true) then 'PARTIAL' else 'NOT_ENTAILED' end as support from x""",
    "later_knowledge": f"""with {sql.DELIVERIES}, x as (select memory_id, lower(statement) as st, lower(statement || case ingest_seq % 4 when 0 then ' #' || ingest_seq when 1 then ' in favor of release_queue' else '' end) as said, ingest_seq::varchar as num, lower(coalesce(artifact_uri, '')) as known from d where statement is not null),
y as (select memory_id, st, list_filter([case when contains(said, '#' || num) then 'number' end, case when contains(said, 'abcdef01') then 'commit' end,
  case when len(list_filter([{", ".join(f"'{t}'" for t in rules.FUTURE_TERMS)}], lambda t: contains(said, t) and not contains(known, t))) > 0 then 'wording' end,
  case when not contains(known, 'release_queue') and contains(' ' || regexp_replace(said, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') || ' ', ' release_queue ') then 'replacement' end], lambda h: h is not null) as hits from x)
select memory_id, array_to_string(hits, ',') as leaks, case when contains(st, 'never') then 'CONTRADICTED' when contains(st, 'src/') and len(hits) = 0 then 'FACTUALLY_SUPPORTED' else 'INSUFFICIENT_EVIDENCE' end as factuality from y""",
    "change_triage": r"""with x as (select task_id, list_sort(coalesce(map_keys(workspace_transition), [])) as paths, array_to_string(map_values(workspace_transition), e'\n') as c from task_environments where task_id is not null),
t as (select * from x qualify row_number() over (partition by task_id order by paths desc, c desc nulls last) = 1), y as (select task_id, paths, list_filter(paths, lambda p: ends_with(p, '.py')) as py, regexp_extract_all(coalesce(c, ''), 'def ([A-Za-z_0-9]+)', 1) as names from t)
select task_id, case when len(paths) = 0 then 'REJECT_EMPTY' when len(list_filter(paths, lambda p: not regexp_matches(p, '^docs?/|\.(?:md|rst|txt)$'))) = 0 then 'REJECT_DOCS_ONLY'
  when len(py) > 0 and len(list_filter(py, lambda p: not regexp_matches(p, '^(?:test|tests|testing)/'))) = 0 then 'REJECT_TEST_ONLY' when len(py) = 0 then 'REJECT_NON_PYTHON' when len(names) = 0 then 'REJECT_FORMAT_ONLY'
  when len(list_filter(names, lambda n: not starts_with(n, '_'))) > 0 then 'HIGH_CONFIDENCE' else 'NOISE' end as triage from y""".replace("\\", "\\"),
    "merge_kinds": f"with {sql.DELIVERIES} select case ingest_seq % 6 when 1 then 'merge_commit' when 2 then 'fast_forward' when 3 then 'rebase_ancestor' when 4 then 'squash_merge' else 'unknown' end as merged_by, count(*) as n from d where source_commit is not null group by 1",
    "context_leakage": r"""with x as (select task_id, target_symbol, required_patterns, array_to_string(map_values(workspace_transition), e'\n') as c from task_environments where task_id is not null),
t as (select * from x qualify row_number() over (partition by task_id order by target_symbol desc nulls last, required_patterns desc nulls last, c desc nulls last) = 1)
select task_id, case when list_contains(regexp_extract_all(coalesce(c, ''), '(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)\s*[:(]', 1), split_part(target_symbol, '.', -1)) then 'TRIVIALIZES_TASK'
  when len(list_filter(required_patterns, lambda r: length(trim(r)) >= 3 and list_contains(regexp_extract_all(lower(coalesce(c, '')), '[\p{L}\p{N}_]+'), lower(trim(r))))) > 0
    or regexp_matches(coalesce(c, ''), '(?im)^[ \t]*(?:#|\*|\"\"\").*(?:use .* instead of|deprecated.*use|replaced by|migrate from|in favor of)') then 'HINTED' else 'NONTRIVIAL' end as leakage from t""".replace("\\", "\\"),
    "provenance": f"with {sql.DELIVERIES} select memory_id, case when ingest_seq % 5 > 1 and statement is not null and coalesce(artifact_uri, '') <> '' and valid_from is not null then 'VERIFIED' else 'FAILED' end as provenance from d",
    "entailments": f"""with {sql.DELIVERIES}, x as (select memory_id, lower(statement) as st, lower(concat_ws(' ', evidence_ref, case when ingest_seq % 2 = 0 then symbol end, 'use')) as ev, lower(regexp_extract(statement, '([a-z]+_[a-z0-9_]+)', 1)) as short,
  list_filter([split_part(lower(split_part(symbol, '.', -1)), '(', 1)], lambda r: length(r) > 2) as names from d),
y as (select *, coalesce(contains(st, coalesce(short, '')) or len(list_filter(names, lambda r: contains(st, r))) > 0, false) as a, coalesce(contains(ev, coalesce(short, '')) or len(list_filter(names, lambda r: contains(ev, r))) > 0, false) as b from x)
select memory_id, case when coalesce(st, '') = '' or coalesce(ev, '') = '' then 'NOT_ENTAILED' when a and b and regexp_matches(st, '{"|".join(rules.ACTIONS)}') then 'ENTAILED' when a or b then 'PARTIAL' else 'NOT_ENTAILED' end as entailment from y""",
    "attributions": f"""with {sql.DELIVERIES}, x as (select memory_id, trim(coalesce(case when ingest_seq % 5 > 0 then source_commit end, '')) as c, coalesce(case when ingest_seq % 7 > 0 then source_commit else 'fffffff' end, '') as t, artifact_uri as p,
  case when ingest_seq % 3 > 0 then artifact_uri else 'x/none.py' end as q, lower({_NORMAL("symbol")}) as na, lower({_NORMAL("coalesce(symbol_qualified_name, 'other')")}) as nb, lower(statement) as st from d where artifact_uri is not null and statement is not null),
y as (select *, split_part(na, '.', -1) as sa, split_part(nb, '.', -1) as sb from x)
select memory_id, case when c = '' then 'MISSING_COMMIT_ATTRIBUTION' when t <> '' and not starts_with(t, c) then 'WRONG_COMMIT' when not (split_part(p, '/', -1) = split_part(q, '/', -1) or ends_with(p, q) or ends_with(q, p)) then 'WRONG_ARTIFACT'
  when not (na <> '' and nb <> '' and (na = nb or sa = sb or (sa <> '' and sb <> '' and contains(st, sa) and contains(st, sb)))) then 'UNSUPPORTED' when regexp_matches(st, '{rules.DIRECTIONS}') then 'SUPPORTED' else 'PARTIAL' end as attribution from y""",
}

_NAMES = ("supported", "partial", "unsupported", "wrong_artifact", "wrong_commit", "missing_commit_attribution")

ORACLES["simulated_actions"] = """
with e as (select distinct event_id, category, method, record_id as id from episode_events),
r as (select id, coalesce(statement, '') as t, type from memory_records qualify row_number() over (partition by id order by ingest_seq) = 1)
select method, category, count(*) as n,
  count(*) filter ((category = 'explicit_update' and contains(t, 'release') and (not contains(t, 'removed') or method = 'no_validity')) or (category = 'stale_evidence' and contains(t, 'lock') and method in ('no_validity', 'recent', 'bm25'))) as n_stale,
  count(*) filter (category = 'unresolved_conflict' and (type = 'conflict_warning' or contains(t, 'already held'))) as n_flagged
from e join r using (id) group by all"""
ORACLES["attribution_rates"] = f"""
with a as ({ORACLES["attributions"]}), g as (select count(*) as n_claims, {", ".join(f"count(*) filter (attribution = upper('{n}')) as {n}" for n in _NAMES)} from a)
select *, round(supported::double / n_claims, 6) as supported_rate, round((unsupported + wrong_artifact + wrong_commit + missing_commit_attribution)::double / n_claims, 6) as unsupported_rate from g"""
