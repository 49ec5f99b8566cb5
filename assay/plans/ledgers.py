"""Ledgers, coordination and audit over tables: orders stand for gates, pages for claimed paths, events for sessions,
conversations for waves (D15, A14-A24, J2-J15, L2-L8, T-1 to T-7, W8, W10, W13, F9-F17, K10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.findings import together
from assay.functions import text
from assay.functions.paths import globs_overlap, is_inside, literal_prefix, path_problem
from assay.operators import audit, coordination, files, ledger, workbooks
from assay.operators.tabular import unreadable_cells
from assay.plans import query, table

# Both engines read these: made-up gates, and nothing of what the operators find out about them.
GATES = (
    "select concat('led', cast(o_custkey % 200 as {s}), '.md') as file, concat('G', cast(case when o_orderkey % 401 = 0 then o_orderkey + 200 else o_orderkey end as {s})) as id, o_orderkey as line, "
    "case o_orderkey % 7 when 0 then 'Improve the totals' when 1 then 'All 12 files are read' when 2 then 'Refactored names stay' when 3 then 'update docs' else 'Totals agree' end as title, "
    "case when o_orderkey % 3 = 0 then null when o_orderkey % 31 = 0 then '' when o_orderkey % 5 = 0 then 'echo done' when o_orderkey % 11 = 0 then 'echo a && run b' else 'run totals' end as \"check\", "
    "case when o_orderkey % 3 = 0 then null when o_orderkey % 13 = 0 then ' OK ' when o_orderkey % 17 = 0 then '/src/a.b/' when o_orderkey % 19 = 0 then '/tot.l/i' else 'total: 12' end as expect, "
    "case o_orderkey % 6 when 0 then 'PENDING' when 1 then null when 2 then '' when 3 then 'exit=0; EXPECT=matched; path=a=b; exit = 1' else 'exit=0;EXPECT=matched' end as evidence, "
    "o_orderstatus <> 'O' as checked, o_orderkey % 43 = 0 as abandoned, o_custkey, o_orderkey, o_orderstatus from orders"
)
SQL_GATES = GATES.format(s="varchar")
STATE = "case when abandoned then 'abandoned' when not checked then 'unmet' when evidence is null or lower(trim(evidence)) in ('', 'pending') then 'unmet-no-evidence' else 'met' end"
RUNNABLE = "coalesce(\"check\", '') <> ''"


def gates(spark, sf_dir):
    made = spark.sql(GATES.format(s="string").replace('"check"', "`check`").replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))
    return made.withColumn("state", ledger.gate_state(F.col("abandoned"), F.col("checked"), F.col("evidence"))).withColumn("runnable", F.coalesce("check", F.lit("")) != "")


COUNTS = f"select file, count(*) filter (where state = 'met') met, count(*) filter (where state = 'unmet') unmet, count(*) filter (where state = 'unmet-no-evidence') unmet_no_evidence, count(*) filter (where state = 'abandoned') abandoned, count(*) filter (where runnable) runnable, count(*) filter (where not runnable) manual from (select *, {STATE} state, {RUNNABLE} runnable from ({SQL_GATES}))"


@query(COUNTS + " group by 1")
def gate_state_counts(spark, sf_dir):
    """D15, A14, A16."""
    return ledger.state_counts(gates(spark, sf_dir), ["file"])


@query(
    f"with c as ({COUNTS} group by 1) select file, (unmet + unmet_no_evidence + file.len() % 3)::bigint effective_unmet, greatest(0, met - file.len() % 3)::bigint reported_met, case when abandoned > 0 then 'handoff-required' when unmet + unmet_no_evidence + file.len() % 3 = 0 then 'all-met' else 'unmet' end verdict from c".replace("file.len()", "length(file)")
)
def gate_verdict(spark, sf_dir):
    """A15, 2.9.3: an abandoned gate wins the label; results that are stale take from the met."""
    counts = ledger.state_counts(gates(spark, sf_dir), ["file"])
    return ledger.verdict(counts, F.length("file") % 3).select("file", "effective_unmet", "reported_met", "verdict")


@query(
    f"with g as ({SQL_GATES}), a as (select file, concat('G', o_orderkey + case when o_orderkey % 2 = 0 then 0 else 100000000 end) id from g where o_orderkey % 37 = 0) "
    "select 'duplicate-id' as rule, file, id, min(line)::bigint as line from g group by file, id having count(*) > 1 union all select 'unknown-abandon', file, id, null from a where not exists (select 1 from g where g.file = a.file and g.id = a.id) "
    "union all select case when coalesce(\"check\", '') = '' then 'expect-without-check' else 'check-without-expect' end, file, id, line from g where (coalesce(\"check\", '') = '') <> (coalesce(expect, '') = '')"
)
def ledger_diagnostics(spark, sf_dir):
    """J7, A23, 2.9.2."""
    g = gates(spark, sf_dir)
    a = g.filter("o_orderkey % 37 = 0").select("file", F.concat(F.lit("G"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(100_000_000)).cast("string")).alias("id"))
    pick = lambda df, rule, line: df.select(rule.alias("rule"), "file", "id", line.cast("long").alias("line"))
    return together(pick(ledger.duplicate_ids(g), F.lit("duplicate-id"), F.col("first_line")), pick(ledger.unknown_abandons(a, g), F.lit("unknown-abandon"), F.lit(None)), pick(ledger.incomplete_checks(g), F.col("rule"), F.col("line")))


@query(
    f"with g as (select *, {RUNNABLE} runnable from ({SQL_GATES}) where not abandoned) select rule, count(*) n from (select unnest([case when \"check\" = 'echo done' then 'tautological-check' end, case when expect = ' OK ' then 'weak-expect' end, case when expect = '/src/a.b/' then 'path-read-as-regex' end, case when not runnable then 'manual-gate' end, case when not runnable and title like '%12%' then 'unmeasured-number' end, case when title in ('Improve the totals', 'update docs') then 'activity-not-outcome' end]) as rule from g) where rule is not null group by 1"
)
def lint_rules(spark, sf_dir):
    """A title that starts with a longer word than an activity, and a command with two parts, are clean."""
    return ledger.lint(gates(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"with g as (select *, {RUNNABLE} runnable from ({SQL_GATES}) where not abandoned) select file, count(*) live, count(*) filter (where runnable) runnable, count(*) filter (where runnable) * 2 < count(*) mostly_manual from g group by 1")
def lint_ratio(spark, sf_dir):
    """L8, A17."""
    return ledger.mostly_manual(gates(spark, sf_dir))


SIGNED = f"select *, {STATE} state, {RUNNABLE} runnable, concat_ws('|', id, \"check\", expect) as sig from ({SQL_GATES})"


def signed(g):
    return g.withColumn("signature", F.sha2(F.concat_ws("|", "id", "check", "expect"), 256))


@query(
    f"with g as ({SIGNED}) select case when not exists (select 1 from g f where f.runnable and f.file = r.file and f.id = r.id and f.sig = r.sig and f.o_orderkey % 23 <> 0) then 'stale' when o_orderkey % 2 = 0 then 'met' else 'unmet' end outcome, count(*) n from g r where runnable group by 1"
)
def stale_results(spark, sf_dir):
    """Results of gates whose text has changed since; some ids stand twice."""
    g = signed(gates(spark, sf_dir).filter("runnable"))
    fresh = g.withColumn("signature", F.when(F.col("o_orderkey") % 23 == 0, "changed").otherwise(F.col("signature")))
    results = g.select("file", "id", "signature", (F.col("o_orderkey") % 2 == 0).alias("ok"))
    return ledger.apply_results(results, fresh).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"with g as ({SIGNED}), r as (select file, id, case when o_orderkey % 23 = 0 then 'older' else sig end sig, bool_and(o_orderkey % 2 = 0) ok from g where runnable and o_orderkey % 5 <> 0 group by all) select g.file, g.id, "
    "case when runnable and not ok and state in ('met', 'unmet-no-evidence') then 'unmet' when runnable and ok and state <> 'abandoned' then 'met' else state end state, runnable and state = 'met' and ok is null extra_unmet from g left join r on g.file = r.file and g.id = r.id and g.sig = r.sig"
)
def reverified_gates(spark, sf_dir):
    """J15, 2.9.4: every gate once, those too whose id stands twice."""
    g = signed(gates(spark, sf_dir))
    ran = g.filter("runnable and o_orderkey % 5 <> 0").select("file", "id", F.when(F.col("o_orderkey") % 23 == 0, "older").otherwise(F.col("signature")).alias("signature"), (F.col("o_orderkey") % 2 == 0).alias("ok"))
    return ledger.reverified(g, ran)


@query(f"with g as (select *, {STATE} state from ({SQL_GATES})) select file, id, line from g where {RUNNABLE} and state in ('unmet', 'unmet-no-evidence')")
def pending_gates(spark, sf_dir):
    """P37."""
    return ledger.pending(gates(spark, sf_dir)).select("file", "id", "line")


@query(
    f"with g as ({SQL_GATES}), w as (select id as name, id, file, 0 as q from g where o_orderkey % 100 = 0 union select file || ':' || id, id, file, 1 from g where o_orderkey % 100 = 50 union select 'nothing', null, null, 0), "
    "n as (select name, count(*) n from (select distinct name from w) w join (select id as k from g union all select file || ':' || id from g) x on w.name = x.k group by 1) select distinct w.name, case when n = 1 then 'selected' when n is null then 'unknown' else 'ambiguous' end state from w left join n on w.name = n.name"
)
def gate_selection(spark, sf_dir):
    """Bare and qualified ids; some stand twice, one does not exist."""
    g = gates(spark, sf_dir)
    bare, full = g.filter("o_orderkey % 100 = 0").select(F.col("id").alias("name")), g.filter("o_orderkey % 100 = 50").select(F.concat_ws(":", "file", "id").alias("name"))
    wanted = bare.unionByName(full).unionByName(spark.createDataFrame([("nothing",)], "name string")).distinct()
    return ledger.select_gates(g, wanted).select("name", "state")


@query(
    f"with g as (select file as ledger, id, {STATE} state, {RUNNABLE} runnable, o_orderkey from ({SQL_GATES})), a as (select distinct ledger, id from g where o_orderkey % 4 = 0), "
    "f as (select case when state in ('abandoned', 'unmet-no-evidence') then 'high' else 'medium' end severity, case when state = 'abandoned' then 'abandoned' when state = 'unmet' then 'unmet' when state = 'unmet-no-evidence' then 'checked-without-evidence' when not runnable then 'manual-met' when a.id is null then 'met-without-standing-approval' end code from g left join a on g.ledger = a.ledger and g.id = a.id) "
    "select severity, code, count(*) n from f where code is not null group by 1, 2 union all select 'low', 'orphan-approval', count(*) from g where o_orderkey % 90 = 0"
)
def audit_findings(spark, sf_dir):
    """Gates, standing approvals, and approvals of ledgers that are gone."""
    g = gates(spark, sf_dir).withColumnRenamed("file", "ledger")
    approvals = g.filter("o_orderkey % 4 = 0").select("ledger", "id", F.concat(F.col("id"), F.lit(".json")).alias("file"), F.lit("2024-01-01").alias("approved_at"))
    gone = g.filter("o_orderkey % 90 = 0").select(F.lit("gone.md").alias("ledger"), "id", F.concat(F.col("id"), F.lit("-gone.json")).alias("file"), F.lit("2024-01-01").alias("approved_at"))
    found = together(audit.gate_findings(audit.standing_approval(g, approvals)), audit.orphan_approvals(approvals.unionByName(gone), g.select("ledger").distinct()))
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"with g as ({SIGNED}) select file as ledger, count(*) n from g where runnable and exists (select 1 from g a where a.runnable and a.file = g.file and a.id = g.id and a.sig = g.sig and a.o_orderkey % 4 = 0 and a.o_orderkey % 12 <> 4) group by 1")
def signed_approvals(spark, sf_dir):
    """An approval counts for the text that it was given for."""
    g = signed(gates(spark, sf_dir).filter("runnable")).withColumnRenamed("file", "ledger")
    given = g.filter("o_orderkey % 4 = 0").select("ledger", "id", F.when(F.col("o_orderkey") % 12 == 4, "other").otherwise(F.col("signature")).alias("signature"))
    return audit.signed_approval(g, given).groupBy("ledger").agg(F.count(F.lit(1)).alias("n"))


QUOTE = "case when regexp_matches({0}, '[\",\\r\\n]') then '\"' || replace({0}, '\"', '\"\"') || '\"' else {0} end"


@query(f"select doc_id, md5(concat_ws(',', doc_id::varchar, {QUOTE.format('coalesce(text, chr(0))').replace('chr(0)', chr(39) * 2)}, {QUOTE.format('(lang || chr(34) || source)')})) as line from documents")
def audit_csv_cells(spark, sf_dir):
    """Whole texts as cells of one line."""
    line = audit.csv_line(F.col("doc_id"), F.col("text"), F.concat("lang", F.lit('"'), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(line).alias("line"))


@query(
    f"with g as (select *, {STATE} state, {RUNNABLE} runnable from ({SQL_GATES})), q as (select concat('\"', \"check\", '\"') x) select file as ledger, line, concat_ws(',', file, id, title, state, case when runnable then 'runnable' else 'manual' end, coalesce(\"check\", ''), coalesce(expect, ''), "
    "case o_orderkey % 6 when 3 then '1' when 4 then '0' when 5 then '0' else '' end, case when o_orderkey % 6 in (3, 4, 5) then 'matched' else '' end, '', '', '', '') as text from g".replace(", q as (select concat('\"', \"check\", '\"') x)", "")
)
def audit_table(spark, sf_dir):
    """Evidence fields in their columns, a later key wins."""
    g = gates(spark, sf_dir).withColumnRenamed("file", "ledger").withColumns({"approved_at": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    return audit.audit_rows(g)


@query("select event_id, case event_id % 4 when 0 then null when 1 then null else event_type end as kind, case event_id % 4 when 2 then 'b=' || user_id else case when event_id % 4 = 3 then 'last' end end as value from events")
def evidence_fields(spark, sf_dir):
    """pending and missing evidence, values with an equals sign, spaces, a key twice."""
    place = F.col("event_id") % 4
    raw = F.when(place == 0, " Pending ").when(place == 1, F.lit(None)).when(place == 2, F.concat(F.lit("kind = "), F.col("event_type"), F.lit(";value=b="), F.col("user_id").cast("string"), F.lit("; noise"))).otherwise(F.concat(F.lit("value=first;kind="), F.col("event_type"), F.lit(";value = last ")))
    fields = text.evidence_fields(raw)
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(fields, F.lit("kind")).alias("kind"), F.try_element_at(fields, F.lit("value")).alias("value"))


@query("select o_custkey, substring(sha256(string_agg(o_orderkey::varchar || ':' || o_orderstatus, chr(0) order by o_orderkey::varchar || ':' || o_orderstatus)), 1, 24) digest from orders group by 1")
def state_digest(spark, sf_dir):
    """A18."""
    items = table(spark, sf_dir, "orders").select("o_custkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("item"))
    return audit.state_digests(items, ["o_custkey"], "item")


GLOB = "case when page_id % 83 = 0 then '**/x' when page_id % 97 = 0 then '../up' when page_id % 5 = 0 then concat('./', p) when page_id % 7 = 0 then concat(p, '/*.html') when page_id % 11 = 0 then regexp_extract(p, '^([^/]*/[^/]*)', 1) else p end"


@query(
    f"with c as (select concat('o', page_id % 40) as owner, page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#*\\[].*$', '') p from pages), k as (select owner, {GLOB} as g, page_id from c), "
    "s as (select *, list_filter(string_split(g, '/'), lambda x: x <> '' and x <> '.') parts, g in ('**/x', '../up') wide from k), "
    # the first place where the parts differ, and the first where either has a wildcard
    "j as (select a.owner, a.g, b.owner other, b.g their_glob, b.page_id place, list_filter(range(1, least(len(a.parts), len(b.parts)) + 1), lambda i: a.parts[i] <> b.parts[i]) apart, list_filter(range(1, least(len(a.parts), len(b.parts)) + 1), lambda i: regexp_matches(a.parts[i] || b.parts[i], '[*?\\[{]')) loose "
    "from s a join s b on a.owner <> b.owner where not a.wide and not b.wide), "
    "m as (select owner, g, other, arg_min(their_glob, place) their_glob from j where coalesce(apart[1], 1000) >= coalesce(loose[1], 999) group by 1, 2, 3) "
    "select owner, g as \"glob\", other, their_glob from m union all select distinct owner, g, null, null from s where wide union all select distinct null, null, owner, g from s where wide"
)
def lease_conflicts(spark, sf_dir):
    """The pairs of a theta join, found by an equi-join."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("o"), (F.col("page_id") % 40).cast("string")).alias("owner"), "page_id", F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*/", ""), r"[?#*\[].*$", "").alias("p"))
    claims = pages.select("owner", F.expr(GLOB).alias("glob"), F.col("page_id").alias("place"))
    return coordination.lease_conflicts(claims, claims)


@query("with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as p from pages) select page_id, p like 'm.%' as inside_m, case when page_id % 9 = 0 then 'traversal' when page_id % 9 = 1 then 'absolute' when page_id % 9 = 2 then 'blank' when page_id % 9 = 3 then 'pattern' when page_id % 9 = 4 then 'root' when regexp_matches(p, '[*?\\[\\]{}]') then 'pattern' end problem, page_id % 9 = 0 or contains(p, 'example') conflict from p")
def path_rules(spark, sf_dir):
    """A path that may not be claimed overlaps everything."""
    bare = F.regexp_replace("url", r"^[a-z]+://", "")
    kind = F.col("page_id") % 9
    path = F.when(kind == 0, F.concat(F.lit("../"), bare)).when(kind == 1, F.concat(F.lit("C:\\"), bare)).when(kind == 2, " ").when(kind == 3, F.concat(bare, F.lit("*"))).when(kind == 4, "./.").otherwise(bare)
    site = F.regexp_extract(bare, "^([^/]*)", 1)
    inside = is_inside(F.when(bare.startswith("m."), F.concat(F.lit("m/"), bare)).otherwise(bare), F.lit("./m"))
    wide = globs_overlap(F.when(kind == 0, path).otherwise(bare), F.when(kind == 0, F.lit("elsewhere")).otherwise(F.concat(site, F.lit("/**"))))
    return table(spark, sf_dir, "pages").select("page_id", inside.alias("inside_m"), path_problem(path, True).alias("problem"), wide.alias("conflict"))


@query(
    "with p as (select page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') as parts from pages), q as (select page_id, parts[1] host, list_filter(parts, lambda x: x <> '') as parts from p), "
    "r as (select *, list_position(list_transform(parts, lambda x: regexp_matches(x, '[*?\\[{]')), true) loose from q) select page_id, case when page_id % 3 = 2 then '' when page_id % 3 = 1 then host else array_to_string(list_slice(parts, 1, coalesce(nullif(loose, 0), 1000) - 1), '/') end prefix from r"
)
def literal_prefixes(spark, sf_dir):
    """F14."""
    bare, kind = F.regexp_replace("url", r"^[a-z]+://", ""), F.col("page_id") % 3
    glob = F.when(kind == 2, "../x").when(kind == 1, F.concat(F.regexp_extract(bare, "^([^/]*)", 1), F.lit("/*/b"))).otherwise(bare)
    return table(spark, sf_dir, "pages").select("page_id", literal_prefix(glob).alias("prefix"))


RUNS = "with t as (select user_id, event_id, {state} as state, lag({state}) over w as was from events window w as (partition by user_id order by event_id)), r as (select *, sum(case when state = was then 0 else 1 end) over (partition by user_id order by event_id) run from t) select user_id, event_id, state, row_number() over (partition by user_id, run order by event_id) blocks, row_number() over (partition by user_id, run order by event_id) > 6 released from r"


@query(RUNS.format(state="event_type"))
def progress_guard(spark, sf_dir):
    """W13, T-4."""
    return coordination.block_runs(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type"))


@query(RUNS.format(state="case when event_type in ('view', 'click', 'error') then 'a' else 'b' end"))
def progress_guard_coarse(spark, sf_dir):
    """W13, T-4: positive control, where sessions are released."""
    return coordination.block_runs(table(spark, sf_dir, "events"), "user_id", "event_id", F.when(F.col("event_type").isin("view", "click", "error"), "a").otherwise("b"))


@query("select user_id::varchar as session, max(ts) updated_at from events group by 1 order by updated_at desc, session limit 64")
def latest_sessions(spark, sf_dir):
    """W8."""
    return coordination.latest(table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("session")).agg(F.max("ts").alias("updated_at")))


@query(
    "with e as (select event_id, event_id % 7 <> 0 readable, event_id % 11 <> 0 resolved, event_id % 13 <> 0 ledger_ok, event_id % 4 = 0 complete, event_id % 5 = 0 released from events) select decision, count(*) n from (select case when not readable or not resolved then 'allow' when not ledger_ok then 'block' when complete then 'allow' when released then 'release' else 'block' end decision from e) group by 1"
)
def hook_decisions(spark, sf_dir):
    """T-5."""
    by = lambda n: F.col("event_id") % n
    decided = coordination.decision(by(7) != 0, by(11) != 0, by(13) != 0, by(4) == 0, by(5) == 0)
    return table(spark, sf_dir, "events").groupBy(decided.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "with t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as seq from conversations), s as (select *, case seq when 0 then 'open' when 1 then 'start' when 2 then 'start' when 3 then 'seal' when 4 then 'return' when 5 then 'return' else 'abandon' end as action from t) "
    "select conv_id, seq, action, case when conv_id % 4 = 0 and seq = 2 then 'handle-in-use' when conv_id % 4 = 0 and seq = 3 then 'missing-starts' when conv_id % 4 = 0 and seq in (4, 5) then 'wave-is-open' when conv_id % 4 = 0 and seq >= 7 then 'wave-is-abandoned' when conv_id % 4 = 0 then null when seq >= 6 then 'wave-is-complete' end as refused, "
    "case when conv_id % 4 = 0 then case when seq >= 6 then 'abandoned' else 'open' end when seq < 3 then 'open' when seq < 5 then 'sealed' else 'complete' end as state from s"
)
def dispatch_lifecycle(spark, sf_dir):
    """T-1: the events of wave_events, folded."""
    return coordination.fold_waves(wave_events(spark, sf_dir)).select(F.col("wave").cast("long").alias("conv_id"), "seq", "action", "refused", "state")


def wave_events(spark, sf_dir):
    """A conversation's turns as the events of a wave of two leaves; in some the second start takes the handle of the first."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("seq"))
    seq = F.col("seq")
    action = F.when(seq == 0, "open").when(seq.isin(1, 2), "start").when(seq == 3, "seal").when(seq.isin(4, 5), "return").otherwise("abandon")
    leaf = F.when(seq.isin(1, 4), "a").when(seq.isin(2, 5), "b")
    handle = F.when((seq == 1) | ((seq == 2) & (F.col("conv_id") % 4 == 0)), "h1").when(seq == 2, "h2")
    return rows.select(F.col("conv_id").cast("string").alias("wave"), "seq", action.alias("action"), F.when(seq == 0, F.array(F.lit("a"), F.lit("b"))).alias("leaves"), leaf.alias("leaf"), handle.alias("handle"), F.lit("no time").alias("reason"))


def made_waves(spark, sf_dir):
    """A wave per order: two leaves, started, sealed, returned; some of it out of order or missing by the key."""
    k = F.col("o_orderkey")
    at = lambda minutes: F.col("o_orderdate").cast("timestamp") + F.make_interval(mins=F.lit(minutes))
    start = lambda handle, when: F.struct(handle.alias("handle"), when.alias("at"))
    state = F.when(k % 3 == 0, "open").when(k % 3 == 1, "sealed").otherwise("complete")
    started = F.create_map(F.lit("a"), start(F.lit("h1"), F.when(k % 17 == 0, at(-5)).otherwise(at(1))), F.lit("b"), start(F.when(k % 13 == 0, "h1").otherwise("h2"), at(2)))
    returned = F.when(k % 3 == 2, F.create_map(F.lit("a"), F.when(k % 19 == 0, at(3)).otherwise(at(6)), F.lit("b"), at(7))).when((k % 3 == 1) & (k % 11 == 0), F.create_map(F.lit("a"), at(6), F.lit("b"), at(7))).otherwise(F.create_map().cast("map<string, timestamp>"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("w"), k.cast("string")).alias("wave"), F.when(k % 23 == 0, "paused").otherwise(state).alias("state"), F.array(F.lit("a"), F.lit("b")).alias("leaves"), at(0).alias("opened_at"),
        F.when(k % 3 != 0, F.when(k % 29 == 0, F.lit(None)).otherwise(at(5))).alias("sealed_at"), F.when(k % 3 == 2, at(8)).alias("completed_at"), F.lit(None).cast("timestamp").alias("abandoned_at"), F.when(k % 31 == 0, "tired").alias("reason"), started.alias("started"), returned.alias("returned"),
    )


@query(
    "with w as (select o_orderkey k, case when o_orderkey % 23 = 0 then 'paused' when o_orderkey % 3 = 0 then 'open' when o_orderkey % 3 = 1 then 'sealed' else 'complete' end state, o_orderkey % 3 <> 0 and o_orderkey % 29 <> 0 has_seal, o_orderkey % 3 = 2 has_done, o_orderkey % 3 = 2 or (o_orderkey % 3 = 1 and o_orderkey % 11 = 0) has_returns from orders), "
    "r as (select unnest([case when state = 'paused' then 'invalid-state' end, case when k % 31 = 0 then 'stray-abandonment' end, case when k % 13 = 0 then 'handle-reused' end, case when k % 17 = 0 then 'start-before-open' end, case when state in ('sealed', 'complete') and not has_seal then 'missing-time' end, "
    "case when state = 'sealed' and has_returns then 'sealed-yet-returned' end, case when state = 'paused' and has_seal then 'stray-seal' end, case when has_returns and not has_seal then 'return-without-seal' end, case when has_done and k % 19 = 0 and has_seal then 'return-before-seal' end, case when state <> 'complete' and has_done then 'stray-completion' end]) as rule from w) select rule, count(*) n from r where rule is not null group by 1"
)
def dispatch_invalid(spark, sf_dir):
    """T-2, J10."""
    return coordination.wave_problems(made_waves(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "select case when o_orderkey % 23 = 0 then 'paused' when o_orderkey % 3 = 0 then 'open' when o_orderkey % 3 = 1 then 'sealed' else 'complete' end state, case when o_orderkey % 23 <> 0 and o_orderkey % 3 < 2 then 'blocking' else 'resolved' end effect, count(*) n, 2 * count(*) started, sum(case when o_orderkey % 3 = 2 or (o_orderkey % 3 = 1 and o_orderkey % 11 = 0) then 2 else 0 end)::bigint returned from orders group by 1, 2"
)
def dispatch_progress(spark, sf_dir):
    """T-3, A22."""
    done = coordination.wave_progress(made_waves(spark, sf_dir))
    return done.groupBy("state", "effect").agg(F.count(F.lit(1)).alias("n"), F.sum("started").alias("started"), F.sum("returned").alias("returned"))


@query("select scope, leaf, count(*) n from (select concat('s', page_id % 3) scope, concat('l', page_id % 5) leaf from pages) where not (scope = 's1' and leaf = 'l2') and scope <> 's0' group by 1, 2")
def lease_release(spark, sf_dir):
    """T-7: one leaf, then a whole scope."""
    leases = table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("scope"), F.concat(F.lit("l"), (F.col("page_id") % 5).cast("string")).alias("leaf"))
    left = coordination.release_leases(coordination.release_leases(leases, "s1", "l2"), "s0")
    return left.groupBy("scope", "leaf").agg(F.count(F.lit(1)).alias("n"))


@query()
def lease_admission(spark, sf_dir):
    """T-6: every page claims its folder and itself, in the order of page_id."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#*\[{].*$", "")
    claims = table(spark, sf_dir, "pages").select(F.col("page_id").alias("turn"), F.concat(F.lit("o"), F.col("page_id").cast("string")).alias("owner"), F.array(path, F.concat(F.lit("pages/"), (F.col("page_id") % 60).cast("string"))).alias("globs"))
    return coordination.admit_claims(claims).select("turn", "owner", "admitted")


@query(
    "with r as (select o_orderkey id, o_orderkey % 7 = 0 lost, o_orderkey % 11 = 0 stale, o_orderkey % 13 = 0 removed, o_orderkey % 26 = 0 authority, o_orderkey % 17 = 0 parked, o_orderkey % 19 = 0 ownerless, o_orderkey % 23 = 0 unseen, o_orderkey % 29 = 0 uncovered, o_orderkey % 31 = 0 twice from orders), "
    "g as (select id, unnest(case when lost then ['missing row'] else [case when stale then 'stale revision' end, case when removed and not authority then 'removal lacks authority' end, case when not removed and parked then 'disposition is not completion' end, case when not removed and ownerless then 'missing or stale owner' end, case when not removed and unseen then 'missing or stale observation' when not removed and uncovered then 'observation does not cover outcome' end, case when twice then 'duplicate row' end] end) gap from r) select gap, count(*) n from g where gap is not null group by 1"
)
def contract_review(spark, sf_dir):
    """All gaps of each required outcome."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    required = orders.select(k.alias("id"))
    observation = F.when(k % 23 == 0, "none").otherwise(F.concat(F.lit("obs"), (k % 50).cast("string")))
    row = orders.filter(k % 7 != 0).select(
        k.alias("id"), F.lit(2).alias("place"), F.when(k % 19 == 0, "gone").otherwise("leaf").alias("owner"), observation.alias("observation"),
        F.when(k % 13 == 0, "REMOVED_BY_USER").when(k % 17 == 0, "PARKED").otherwise("ACTIVE").alias("disposition"), F.when(k % 11 == 0, 1).otherwise(2).alias("revision"),
    )
    older = row.filter("id % 31 = 0").withColumns({"place": F.lit(1), "owner": F.lit("nobody")})
    owners = spark.createDataFrame([("leaf",)], "owner string")
    observations = orders.select(F.concat(F.lit("obs"), (k % 50).cast("string")).alias("observation"), F.when(k % 29 == 0, -1).otherwise(k).alias("covers"))
    removals = orders.filter(k % 26 == 0).select(k.alias("id"))
    return audit.contract_review(required, row.unionByName(older), owners, observations, removals, 2).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select p_partkey k, p_brand sheet from part), s as (select cast(regexp_extract(p_brand, '(\\d+)$', 1) as int) idx, max(p_type) txt from part group by 1) select sheet, k, case when k % 5 = 0 then '' when k % 2 = 0 then coalesce(txt, '') else k::varchar end as value from c left join s on idx = k % 30")
def string_lookup(spark, sf_dir):
    """Shared strings by index, indexes out of range, plain values."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cells = part.select(F.col("p_brand").alias("sheet"), k.alias("k"), F.when(k % 5 == 0, "s").when(k % 2 == 0, "s").otherwise("n").alias("type"), F.when(k % 5 == 0, "-1").when(k % 2 == 0, (k % 30).cast("string")).otherwise(k.cast("string")).alias("value"))
    strings = part.groupBy(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("idx")).agg(F.max("p_type").alias("text"))
    return workbooks.shared_strings(cells, strings).select("sheet", "k", "value")


@query("select n_name as name, case n_nationkey % 3 when 0 then 'xl/worksheets/' || n_nationkey || '.xml' when 1 then 'xl/' || n_nationkey || '.xml' else 'xl/w/' || n_nationkey || '.xml' end target_path from nation where n_nationkey % 5 <> 4")
def sheet_paths(spark, sf_dir):
    """Relative, absolute and full targets; sheets without a relation go."""
    nation, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    sheets = nation.select(F.col("n_name").alias("name"), F.concat(F.lit("rId"), k.cast("string")).alias("rid"))
    target = F.when(k % 3 == 0, F.concat(F.lit("worksheets/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("/xl/"), k.cast("string"))).otherwise(F.concat(F.lit("xl/w/"), k.cast("string")))
    relations = nation.filter(k % 5 != 4).select(F.concat(F.lit("rId"), k.cast("string")).alias("rid"), F.concat(target, F.lit(".xml")).alias("target"))
    return workbooks.sheet_map(sheets, relations)


@query("select doc_id, strlen(text) between 500 and 5000 as sized, sha256(text) = sha256('x') or doc_id % 2 = 0 as same, trim(text, E' \\t\\n\\r') <> '' filled, strlen(text) > 5000 skipped from documents")
def file_rules(spark, sf_dir):
    """Documents as files; the digest that is asked for is the row's own, or another."""
    docs = table(spark, sf_dir, "documents").withColumn("content", F.encode("text", "UTF-8"))
    as_files = docs.select(F.col("doc_id").cast("string").alias("path"), F.octet_length("content").cast("long").alias("length"), "content")
    seen = files.survey(as_files, 5000).select(F.col("path").cast("long").alias("doc_id"), "skipped")
    asked = F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("content", 256))).otherwise(F.sha2(F.lit("x"), 256))
    rules = docs.select("doc_id", files.size_within(F.octet_length("content"), 500, 5000).alias("sized"), files.digest_is(F.col("content"), asked).alias("same"), files.has_content(F.col("text")).alias("filled"))
    return rules.join(seen, "doc_id")


@query("select 'blank' kind, count(*) n, string_agg(o_orderkey::varchar, ',' order by o_orderkey) filter (where place <= 20) as rows, greatest(0, count(*) - 20) more from (select o_orderkey, row_number() over (order by o_orderkey) place from orders where o_orderkey % 40 = 0) union all select 'not-a-number', count(*), string_agg(o_orderkey::varchar, ',' order by o_orderkey) filter (where place <= 20), greatest(0, count(*) - 20) from (select o_orderkey, row_number() over (order by o_orderkey) place from orders where o_orderkey % 40 = 1)")
def bad_cells(spark, sf_dir):
    """A3, W7."""
    k = F.col("o_orderkey")
    return unreadable_cells(table(spark, sf_dir, "orders"), F.when(k % 40 == 0, " ").when(k % 40 == 1, "5.").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")), k)


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'text' else 'regex' end kind, case when o_orderkey % 5 = 0 then 'a/b' when o_orderkey % 5 = 1 then 'a/b' when o_orderkey % 5 = 2 then 'a\\/b' else 'ab' end as value, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 3 then 'i' else '' end flags, o_orderkey % 5 = 1 path_like, 'led' || o_custkey % 7 || ':G' || o_orderkey qualified, case when o_orderkey % 2 = 0 then 'head' else 'x' || o_orderkey end bare from orders")
def small_functions(spark, sf_dir):
    """F9, F12, F17."""
    k = F.col("o_orderkey")
    expect = F.when(k % 5 == 0, "a/b").when(k % 5 == 1, "/a/b/").when(k % 5 == 2, "/a\\/b/").when(k % 5 == 3, "/ab/i").otherwise("/ab/")
    file = F.concat(F.lit("x/.y\\led"), (F.col("o_custkey") % 7).cast("string"), F.lit(".md"))
    bom = F.when(k % 2 == 0, "\ufeffhead").otherwise(F.concat(F.lit("x"), k.cast("string")))
    rows = table(spark, sf_dir, "orders").withColumn("e", text.expectation(expect))
    return rows.select("o_orderkey", "e.kind", "e.value", "e.flags", "e.path_like", text.qualified(file, F.concat(F.lit("G"), k.cast("string"))).alias("qualified"), text.strip_bom(bom).alias("bare"))


@query("select o_custkey, count(*) n, string_agg(o_orderkey::varchar, ', ' order by o_orderkey) filter (where place <= 12) || case when count(*) > 12 then ' +' || (count(*) - 12) || ' more' else '' end shown from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) place from orders) group by 1")
def unmet_heads(spark, sf_dir):
    """The first ids and how many more there are."""
    return audit.heads(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")
