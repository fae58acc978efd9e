"""The same results in plain SQL (DuckDB), for every registered query SQL can express."""

from __future__ import annotations

#: (table, case, activity, order) of each log.
LOGS = {
    "events": ("events", "user_id", "event_type", "ts, event_id"),
    "orders": ("orders", "o_custkey", "o_orderpriority", "o_orderdate, o_orderkey"),
    "lineitem": (
        "lineitem", "l_orderkey", "l_returnflag || l_linestatus",
        "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus",
    ),
    "conversations": ("conversations", "conv_id", "role", "turn"),
}


def _log(name: str) -> str:
    """ev(case_id, activity, pos), tr(case_id, acts, n), train, test, pre(case_id, k, prefix, suffix) and labels."""
    table, case, activity, order = LOGS[name]
    return f"""
    with ev as (
        select {case} as case_id, coalesce(cast({activity} as varchar), 'nan') as activity,
               row_number() over (partition by {case} order by {order}) as pos
        from {table} where {case} is not null),
    tr as (select case_id, list(activity order by pos) as acts, count(*) as n from ev group by case_id),
    ranked as (select *, row_number() over (order by case_id) as rn, count(*) over () as cases from tr),
    parted as (select case_id, acts, n, rn <= 2 * ceil(cases / 3.0) as is_train from ranked),
    train as (select case_id, acts, n from parted where is_train and n >= 2),
    test as (select case_id, acts, n from parted where not is_train),
    pre as (
        select case_id, acts, n, k, acts[1:k] as prefix, acts[k + 1:] as suffix
        from (select *, unnest(range(2, n)) as k from test where n >= 3)),
    labels as (
        select activity, row_number() over (order by activity) as ix, count(*) over () as n_labels
        from (select distinct activity from ev))
    """


def _variants(source: str) -> str:
    return f"select acts, count(*) as n_traces, min(case_id) as variant_id, any_value(n) as n from {source} group by acts"


def _long(*columns: str) -> str:
    return ", ".join(f"cast({c} as bigint) as {c}" for c in columns)


def _text(array: str) -> str:
    return f"array_to_string({array}, ',')"


_VALIDATION = """,
    hashed as (select *, md5(cast(case_id as varchar) || ':1') as h from train),
    numbered as (select *, row_number() over (order by h) as hr, count(*) over () as total from hashed),
    marked as (select *, hr <= round_even(0.1 * total, 0) as chosen from numbered)
"""

#: Trees of the fixed models as rows: the flower and the bag of the labels.
_NODES = """,
    k as (select max(n_labels) as k from labels),
    nodes as (
        select 'flower' as model_id, 0 as node_id, -1 as parent_id, 0 as child_ix, 'XorLoop' as type, '[XorLoop0]' as shortname, 0 as depth
        union all select 'flower', 1, 0, 0, 'Xor', '[Xor1]', 1
        union all select 'flower', ix + 1, 1, ix - 1, 'task', activity, 2 from labels
        union all select 'flower', k + 2, 0, 1, 'tau', '[tau' || (k + 2) || ']', 1 from k
        union all select 'flower', k + 3, 0, 2, 'tau', '[tau' || (k + 3) || ']', 1 from k
        union all select 'bag', 0, -1, 0, 'And', '[And0]', 0
        union all select 'bag', 1, 0, 0, 'Seq', '[Seq1]', 1
        union all select 'bag', ix + 1, 1, ix - 1, 'task', activity, 2 from labels where ix <= 2
        union all select 'bag', ix + 1, 0, ix - 2, 'task', activity, 1 from labels where ix > 2)
"""

#: What a bag replay shows: labels by first need, then the unobserved ones in tree order.
_BAG = f""",
    v as ({_variants('train')}),
    firsts as (
        select variant_id, n_traces, l.activity, l.ix, list_position(acts, l.activity) as met
        from v cross join labels l),
    first_two as (
        select variant_id, max(case when ix = 1 then met end) as at1, max(case when ix = 2 then met end) as at2
        from firsts group by variant_id),
    needed as (
        select f.variant_id, n_traces, activity, ix,
               case when ix = 1 then least(coalesce(at1, 1000000), coalesce(at2, 1000000)) else coalesce(met, 1000000) end as need
        from firsts f join first_two using (variant_id)),
    played as (
        select variant_id, n_traces, activity, greatest(ix - 2, 0) as branch,
               row_number() over (partition by variant_id order by need, ix) as step
        from needed)
"""

#: Decisions of the flower model: the value at each position, and the loop count.
_FLOWER = f""",
    v as ({_variants('train')}),
    steps as (select variant_id, n_traces, n, unnest(acts) as activity, generate_subscripts(acts, 1) - 1 as i from v),
    value_counts as (
        select '[Xor1]' as operator, '[XorLoop0]{{' || i || '}}' as loop_ctx, 'pf+' as source, activity as value, sum(n_traces) as cnt
        from steps group by i, activity
        union all select '[Xor1]', null, 'pf', activity, sum(n_traces) from (
            -- the last value of each feature counts, and positions are features: every event counts
            select activity, n_traces from steps) group by activity
        union all select '[XorLoop0]', '', 'pf+', cast(n - 1 as varchar), sum(n_traces) from v group by n
        union all select '[XorLoop0]', null, 'pf', cast(n - 1 as varchar), sum(n_traces) from v group by n),
    modes as (
        select i, activity from (
            select i, activity, row_number() over (partition by i order by sum(n_traces) desc, activity) as r
            from steps group by i, activity) where r = 1),
    usual as (select ceil(median(n)) as len, median(n) as med from train)
"""

#: Flower predictions: play on to the median length, each time with the usual activity.
_GUESS = """,
    guess as (
        select p.case_id, p.k, p.prefix, p.suffix, any_value(p.acts) as acts,
               coalesce(list(m.activity order by m.i) filter (m.i is not null), []) as guessed
        from pre p cross join usual u
        left join modes m on m.i >= p.k and m.i < greatest(p.k, u.len)
        group by p.case_id, p.k, p.prefix, p.suffix)
"""

_LETTERS = """,
    lettered as (select {keys}, {a} as a, {b} as b,
        array_to_string([chr(96 + cast(list_position(ls, x) as int)) for x in {a}], '') as sa,
        array_to_string([chr(96 + cast(list_position(ls, x) as int)) for x in {b}], '') as sb
        from {source} cross join (select list(activity order by ix) as ls from labels)),
    spelled as (select *, case when sa = '' then ' ' else sa end as ta, case when sb = '' then ' ' else sb end as tb from lettered)
"""

_DAMERAU = "round(1.0 - damerau_levenshtein(ta, tb) / greatest(length(ta), length(tb)), 9)"
_LEVENSHTEIN = "round(1.0 - levenshtein(ta, tb) / greatest(length(ta), length(tb)), 9)"


def _scored_lines(log: str) -> str:
    return (
        _log(log) + _FLOWER + _GUESS
        + _LETTERS.format(keys="case_id, k, prefix, suffix, guessed", a="guessed", b="suffix", source="guess")
        + f", scored as (select *, {_DAMERAU} as dam, {_LEVENSHTEIN} as lev from spelled)"
    )


_GRAMS = """,
    grams as (
        select case_id, [activity] as gram, pos as last from {ev}
        union all
        select case_id, [activity, nxt], pos + 1 from (
            select case_id, activity, pos, lead(activity) over (partition by case_id order by pos) as nxt from {ev})
        where nxt is not null)
"""
_TRAIN_EVENTS = ", tev as (select ev.* from ev join train using (case_id))"


def queries() -> dict[str, str]:
    lines, events, orders, talks = (_log(n) for n in ("lineitem", "events", "orders", "conversations"))
    halves = lines + _LETTERS.format(keys="case_id, k", a="prefix", b="suffix", source="pre")
    train_grams = lines + _TRAIN_EVENTS + _GRAMS.format(ev="tev")
    return {
        "event_log": "select o_custkey as case_id, o_orderpriority as activity, o_orderkey as order_key from orders",
        "traces": lines + f"select case_id, {_text('acts')} as trace from tr",
        "variants": lines + f"select {_text('acts')} as trace, n_traces, variant_id as first_case_id from ({_variants('tr')})",
        "trace_text": orders + "select case_id, array_to_string(acts, '|') as text, n as n_back from tr",
        "max_trace_len": events + "select max(n) as max_len from tr",
        "train_test_split": lines + "select case_id, case when is_train then 'train' else 'test' end as part from parted",
        "train_traces": lines + f"select case_id, {_text('acts')} as trace from train",
        "split_counts": orders + "select (select count(*) from train) as n_train, (select count(*) from pre) as n_test",
        "prefixes": lines + f"select case_id, k as length, {_text('prefix')} as prefix, {_text('suffix')} as suffix from pre",
        "train_minus_validation": lines + _VALIDATION + f"select case_id, {_text('acts')} as trace from marked where not chosen",
        "validation_prefixes": lines + _VALIDATION + f"""
            select case_id, k as length, {_text('acts[1:k]')} as prefix, {_text('acts[k + 1:]')} as suffix
            from (select *, unnest(range(2, n)) as k from marked where chosen and n >= 3)""",
        "directly_follows": events + """
            select activity as a, nxt as b, count(*) as cnt
            from (select activity, lead(activity) over (partition by case_id order by pos) as nxt from ev)
            where nxt is not null group by 1, 2""",
        "start_end_activities": lines + """
            select activity, count(*) filter (pos = 1) as n_start, count(*) filter (pos = n) as n_end
            from ev join tr using (case_id) where pos = 1 or pos = n group by activity""",
        "xes_export": talks + f"""
            select 'concept:name' as trace_key, cast(rn - 1 as varchar) as trace_name, {_text('acts')} as names, n as n_events
            from ranked""",
        "xes_roundtrip": lines + f"select cast(rn - 1 as varchar) as trace_name, {_text('acts')} as trace from ranked",
        "xes_attributes": """
            select cast(o_custkey as varchar) as trace_name, string_agg(o_orderpriority, ',' order by o_orderdate, o_orderkey) as trace,
                   string_agg(o_orderstatus, ',' order by o_orderdate, o_orderkey) as statuses, count(*) as n_times
            from orders where o_custkey is not null group by o_custkey""",
        "csv_roundtrip": events + f"select 'u' || case_id as case_id, {_text('acts')} as trace from tr",
        "levenshtein_similarity": halves + f"select case_id, k as length, {_LEVENSHTEIN} as similarity from spelled",
        "damerau_similarity": halves + f"select case_id, k as length, {_DAMERAU} as similarity from spelled",
        "activity_ngrams": lines + _GRAMS.format(ev="ev") + "select case_id, array_to_string(gram, ' ') as ngram, count(*) as n from grams group by case_id, gram",
        "orders_ngrams": orders + _GRAMS.format(ev="ev") + "select case_id, array_to_string(gram, ' ') as ngram, len(gram) as size, count(*) as n from grams group by case_id, gram",
        "orders_ngram_features": orders + _TRAIN_EVENTS + _GRAMS.format(ev="tev") + """
            select case_id, array_to_string(gram, ' ') as ngram, len(gram) as size from grams group by case_id, gram""",
        "ngram_vocabulary": train_grams + """
            select array_to_string(gram, ' ') as ngram, count(distinct case_id) as n_traces from grams group by gram""",
        "ngram_features": train_grams + "select case_id, array_to_string(gram, ' ') as ngram from grams group by case_id, gram",
        "prefix_features": talks + _TRAIN_EVENTS + _GRAMS.format(ev="tev") + """
            select case_id, unnest(range(greatest(2, first_len), longest + 1)) as length, array_to_string(gram, ' ') as ngram
            from (select case_id, gram, min(last) as first_len from grams group by 1, 2)
            cross join (select max(n) as longest from train)""",
        "svd_features": train_grams + """,
            held as (select distinct case_id, gram from grams),
            first as (select gram from held where case_id = (select min(case_id) from held))
            select case_id, cast(count(*) as double) as own, cast(count(first.gram) as double) as with_first
            from held left join first using (gram) group by case_id""",
        "prefix_projections": train_grams + """,
            news as (select case_id, gram, min(last) as seen from grams group by 1, 2),
            cuts as (select case_id, unnest(range(2, n + 1)) as length from train)
            select cuts.case_id, length, cast(count(*) as double) as own,
                   case when length > 2 then cast(count(*) filter (seen < length) as double) end as with_before
            from cuts join news on news.case_id = cuts.case_id and seen <= length group by 1, 2""",
        "core_distances": train_grams + """,
            bits as (select gram, cast(1 as bigint) << cast(row_number() over (order by gram) - 1 as int) as bit from (select distinct gram from grams)),
            sets as (select case_id, cast(sum(bit) as bigint) as mask from (select distinct case_id, gram from grams) join bits using (gram) group by case_id),
            points as (select mask, min(case_id) as name, count(*) as weight from sets group by mask),
            pairs as (
                select a.name, any_value(a.weight) as weight, bit_count(xor(a.mask, b.mask)) as apart, sum(b.weight) as other
                from points a join points b on a.name <> b.name group by a.name, apart),
            reached as (select name, apart, weight - 1 + sum(other) over (partition by name order by apart) as reach from pairs),
            sizes as (select unnest(range(2, 11)) as candidate),
            far as (select name, candidate, min(apart) as apart from reached join sizes on reach >= candidate group by 1, 2)
            select p.name, p.weight, s.candidate, cast(case when p.weight > s.candidate then 0 else far.apart end as bigint) as core
            from points p cross join sizes s left join far on far.name = p.name and far.candidate = s.candidate""",
        "tree_table": lines + _NODES + f"select model_id, type, shortname, {_long('node_id', 'parent_id', 'child_ix', 'depth')} from nodes",
        "tree_memberships": lines + _NODES + """
            select 'bag' as model_id, 'and_branch' as kind, n.shortname as node, '[And0]' as operator,
                   case when n.parent_id = 1 then 0 else n.child_ix end as detail
            from nodes n where n.model_id = 'bag' and n.node_id > 0
            union all
            select 'flower', 'loop_around', shortname, '[XorLoop0]', 0 from nodes where model_id = 'flower' and node_id > 0
            union all
            select 'flower', 'xor_child', shortname, '[Xor1]', null from nodes where model_id = 'flower' and parent_id = 1
            union all
            select 'flower', case when child_ix = 1 then 'loop_redo' else 'loop_exit' end, shortname, '[XorLoop0]', null
            from nodes where model_id = 'flower' and parent_id = 0 and child_ix > 0""",
        "tree_lca": lines + _NODES + f"""
            select model_id, {_long('node_1', 'node_2', 'ancestor', 'level')} from (
            select a.model_id, a.node_id as node_1, b.node_id as node_2,
                   case when a.parent_id = 1 and b.parent_id = 1 then 1 else 0 end as ancestor,
                   case when a.parent_id = 1 and b.parent_id = 1 then 2 else 1 end as level
            from nodes a join nodes b on a.model_id = b.model_id and a.node_id < b.node_id
            where a.type in ('task', 'tau') and b.type in ('task', 'tau'))""",
        "tree_branch_sizes": lines + _NODES + f"""
            select model_id, {_long('and_id', 'branch', 'n_nodes')} from (
            select 'bag' as model_id, 0 as and_id, 0 as branch, 3 as n_nodes
            union all select 'bag', 0, ix - 2, 1 from labels where ix > 2)""",
        "model_alphabet": " union ".join(
            f"select '{name}' as model_id, cast({activity} as varchar) as activity from {table}"
            for name, (table, _, activity, _) in LOGS.items()
        ),
        "discovered_replay": " union all ".join(
            f"select * from ({_log(name)} select '{name}' as model_id, variant_id, {_text('acts')} as path, "
            f"cast(0 as bigint) as n_skipped from ({_variants('tr')}))"
            for name in LOGS
        ),
        "fired_transitions": lines + _FLOWER + """
            select variant_id, 0 as pos, 'end_[XorLoop0]' as fired from v
            union all select variant_id, 1 + 5 * i, '[Xor1]' from steps
            union all select variant_id, 2 + 5 * i, activity from steps
            union all select variant_id, 3 + 5 * i, 'end_[Xor1]' from steps
            union all select variant_id, 4 + 5 * i, '[XorLoop0]' from steps
            union all select variant_id, 5 + 5 * i, '[tau' || (n_labels + case when i = n - 1 then 3 else 2 end) || ']'
            from steps cross join (select max(n_labels) as n_labels from labels)""",
        "visible_path": lines + _BAG + """
            select variant_id, string_agg(activity, ',' order by step) as path from played group by variant_id""",
        "loop_counters": lines + _FLOWER + f"""
            select variant_id, {_long('pos', 'operator', 'count')} from (
            select variant_id, 5 + 5 * i as pos, 0 as operator, i + 1 as count from steps where i < n - 1)""",
        "and_steps": lines + _BAG + f"select variant_id, {_long('operator', 'step')}, branch from (select *, 0 as operator from played)",
        "footprint": lines + _FLOWER + """
            select variant_id, n_traces as weight, '[Xor1]' as operator, '[XorLoop0]{' || i || '}' as loop_ctx, activity as value from steps
            union all select variant_id, n_traces, '[XorLoop0]', '', cast(n - 1 as varchar) from v""",
        "decision_table": events + _FLOWER + f"select operator, loop_ctx, source, value, {_long('cnt')} from value_counts",
        "xor_decisions": events + _FLOWER + f"""
            select loop_ctx, source, value, {_long('n')} from (
            select loop_ctx, source, value, n from (
                select loop_ctx, source, value, sum(cnt) over (partition by loop_ctx, source) as n,
                       row_number() over (partition by loop_ctx, source order by cnt desc, value) as r
                from value_counts where operator = '[Xor1]') where r = 1)""",
        "loop_decisions": events + _FLOWER + f"""
            select source, median, n, {_long('operator')} from (
            select 0 as operator, source, med - 1 as median, (select count(*) from train) as n
            from usual cross join (select unnest(['pf+', 'pf']) as source))""",
        "and_decisions": lines + _BAG + f"""
            select ranked, source, {_long('operator', 'step', 'n')} from (
            select 0 as operator, step, source, string_agg(branch, ',' order by score desc, branch) as ranked, sum(cnt) as n
            from (select step, branch, sum(n_traces) as cnt, sum(n_traces) / case when branch = 0 then 3.0 else 1.0 end as score
                  from played group by step, branch) cross join (select unnest(['pf+', 'pf']) as source) group by step, source)""",
        "decision_lookup": lines + _FLOWER + """
            select case_id, case when m.i is not null then 'pf+' else 'pf' end as source, coalesce(m.activity, o.activity) as value
            from test t left join modes m on m.i = t.n
            cross join (select activity from steps group by activity order by sum(n_traces) desc, activity limit 1) o""",
        "predicted_suffixes": lines + _FLOWER + _GUESS + f"""
            select min(case_id) as variant_id, k as length, {_text('any_value(guessed)')} as suffix_guessed
            from guess group by acts, k""",
        "predict_one": talks + _FLOWER + f"""
            select {_text('t.acts[1:2]')} as prefix, coalesce(string_agg(m.activity, ',' order by m.i), '') as suffix_guessed
            from (select * from test where n >= 2 order by case_id desc limit 1) t cross join usual u
            left join modes m on m.i >= 2 and m.i < u.len group by t.acts""",
        "prediction_lines": _scored_lines("events") + f"""
            select case_id, k as length, {_text('prefix')} as prefix, {_text('guessed')} as suffix_guessed,
                   {_text('suffix')} as suffix, dam as damerau_similarity, lev as levenshtein_similarity from scored""",
        "decision_source_tally": lines + _FLOWER + f"""
            select source, {_long('n_decisions')} from (
            select s.source, case when s.source = 'pf+'
                then (select sum(2 * (greatest(k, len) - k) + 1) from pre cross join usual) else 0 end as n_decisions
            from (select unnest(['pf+', 'pf', 'first']) as source) s)""",
        "describe_similarity": _scored_lines("lineitem") + """
            , m as (select avg(dam) as mu, count(*) as c from scored)
            select count(*) as nobs, round(min(dam), 6) as min, round(max(dam), 6) as max, round(avg(dam), 6) as mean,
                   round(var_samp(dam), 6) as variance,
                   round(avg(power(dam - mu, 3)) / power(avg(power(dam - mu, 2)), 1.5), 6) as skewness,
                   round(avg(power(dam - mu, 4)) / power(avg(power(dam - mu, 2)), 2) - 3, 6) as kurtosis
            from scored cross join m""",
        "run_report": _scored_lines("lineitem") + """
            , m as (select avg(dam) as mu from scored)
            select 'lineitem' as dataset, 1 as ngram_min, 2 as ngram_max, (select count(*) from train) as n_train,
                   count(*) as n_test, count(*) as nobs, round(min(dam), 6) as min, round(max(dam), 6) as max, round(avg(dam), 6) as mean,
                   round(var_samp(dam), 6) as variance,
                   round(avg(power(dam - mu, 3)) / power(avg(power(dam - mu, 2)), 1.5), 6) as skewness,
                   round(avg(power(dam - mu, 4)) / power(avg(power(dam - mu, 2)), 2) - 3, 6) as kurtosis
            from scored cross join m""",
    }
