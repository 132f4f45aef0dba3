"""DuckDB oracle statements for the evaluation group (plain SQL windows/joins)."""

from __future__ import annotations

from roomlens.operators import cases
from roomlens.plans.oracle_sql import IAQ, METRIC_LIST, ROOM_LIST


def R(expr: str, d: int) -> str:
    return f"cast(round(cast(round({expr}, 8) as decimal(38, 8)), {d}) as double)"


def _q(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


RECS = f"""recs0 as (
  select o_orderkey as order_key, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
         case o_orderstatus when 'F' then 'nl_sql' when 'O' then 'display_cards' when 'P' then 'kg_ablation' end as task,
         {ROOM_LIST}[o_custkey % 3 + 1] as room,
         '2024-01-' || lpad(cast(o_orderkey % 30 + 1 as varchar), 2, '0') as day_text,
         {METRIC_LIST}[o_orderkey % 5 + 1] as metric_col,
         case when o_orderkey % 97 = 0 then 'bad' else cast(o_totalprice / 1e5 as varchar) end as lat_text
  from orders),
recs1 as (
  select order_key, task || '_r' || cast(order_key % 4 as varchar) || '.jsonl' as file, task,
         case when o_orderstatus = 'P' then case when order_key % 2 = 0 then 'kg_on' else 'kg_off' end end as condition,
         case when order_key % 17 = 0 then '' else o_orderpriority end as model,
         case o_custkey % 5 when 0 then null when 4 then false else true end as correct,
         case when o_orderstatus <> 'P' then lat_text end as latency_s,
         case when o_orderstatus = 'P' then cast(o_totalprice / 2e5 as varchar) end as latency_plot_s,
         case when o_orderstatus = 'P' then lat_text end as latency_total_s,
         case when o_orderstatus = 'F' then 'What is the average ' || metric_col || ' of ' || room || '?' end as question,
         case when o_orderstatus = 'F' then 'select avg(' || metric_col || ') from iaq' end as generated_sql,
         case when o_orderstatus = 'O' then 'date=' || day_text || chr(10) || 'location=' || room || chr(10)
              || 'time=08:15' || chr(10) || 'metric=' || metric_col end as params_text,
         case when o_orderstatus = 'O' then {R('o_totalprice / 1e4', 2)} end as returned_value,
         case when o_orderstatus = 'O' then case when o_custkey % 3 = 0 then 'ok' when o_custkey % 3 = 1 then 'warn-low' end
              end as returned_state,
         case when o_orderstatus = 'P' then 'plot temperature for ' || day_text || ' in ' || room end as plot_request,
         case when o_orderstatus = 'P' and order_key % 3 = 1 then 'please show me ' || room end as request_text,
         case when o_orderstatus = 'P' and order_key % 3 <> 0
              then 'The readings look ' || case when o_custkey % 2 = 0 then 'stable' else 'noisy' end end as model_response
  from recs0),
recs as (select *, row_number() over (partition by file order by order_key) - 1 as "index" from recs1)"""

SUMMARY = f"""summary as (
  select coalesce(nullif(model, ''), 'default') as model,
         coalesce(nullif(task, ''), 'unknown') || coalesce(' [' || nullif(condition, '') || ']', '') as task,
         count(*) filter (where correct) as correct,
         count(*) filter (where correct is not null) as graded,
         count(*) filter (where correct is null) as pending,
         count(*) as total,
         {R("(count(*) filter (where correct)) / nullif(count(*) filter (where correct is not null), 0)", 6)} as accuracy,
         {R("avg(try_cast(coalesce(latency_total_s, latency_s, latency_plot_s) as double))", 6)} as mean_latency_s
  from recs1 group by 1, 2)"""

TASK_TYPE = "case " + " ".join(f"when starts_with(file, '{p}_') then '{p}'" for p in
                               ["nl_sql", "display_cards", "plot_gen", "chart_interp", "kg_ablation"]) + " else 'other' end"

FILES = f"""files as (
  select file, {TASK_TYPE} as task_type, count(*) as total,
         count(*) filter (where correct is not null) as graded,
         count(*) - count(*) filter (where correct is not null) as pending,
         count(*) filter (where correct) as correct,
         cast(round((count(*) filter (where correct is not null)) * 100 / count(*)) as bigint) as progress_pct,
         coalesce(min("index") filter (where correct is null), 0) as first_pending
  from recs group by file)"""

GRADES = """grades as (
  select r.file, r."index" + case when l.l_linenumber = 7 then 1000000 else 0 end as "index",
         l.l_linestatus = 'F' as correct, '  ' || cast(l.l_linenumber as varchar) || ' ' as note,
         l.l_shipdate as graded_at
  from recs r join lineitem l on l.l_orderkey = r.order_key where l.l_returnflag = 'R')"""

PRED = """pred as (
  select 'r1' as run, d.lang as model, case when l.toxic = 1 then 'UNSAFE' else 'SAFE' end as true_label,
         d.n_chars / 1e3 as latency_s,
         case when d.doc_id % 11 = 0 then '' when d.doc_id % 11 = 1 then 'ERROR: 500 Server Error'
              when (d.doc_id % 7 = 0) <> (l.toxic = 1) then '**UNSAFE**' when d.doc_id % 5 = 0 then 'Not-safe: smoke'
              else 'Safe.' end as model_text,
         cast(d.doc_id as varchar) as image_path
  from labels l join documents d on d.doc_id = l.doc_id),
np as (select *, regexp_replace(regexp_replace(regexp_replace(lower(model_text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'),
                  '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') as norm from pred),
pp as (select *, case when norm = '' then 'UNKNOWN'
                      when contains(norm, 'unsafe') or contains(norm, 'not safe') or contains(norm, 'danger')
                        or contains(norm, 'fire') or contains(norm, 'smoke') then 'UNSAFE'
                      when contains(norm, 'safe') then 'SAFE' else 'UNKNOWN' end as pred_label from np),
p as (select *, pred_label = true_label as is_correct from pp)"""

CONF = """conf as (select run, model,
  count(*) filter (where true_label = 'SAFE' and pred_label = 'SAFE') as tp,
  count(*) filter (where true_label = 'UNSAFE' and pred_label = 'UNSAFE') as tn,
  count(*) filter (where true_label = 'UNSAFE' and pred_label <> 'UNSAFE') as fp,
  count(*) filter (where true_label = 'SAFE' and pred_label <> 'SAFE') as fn
  from p group by run, model)"""


def _ratio(a: str, b: str) -> str:
    return R(f"coalesce(({a}) / nullif({b}, 0), 0.0)", 6)


ACC = f"""acc as (select run, model, count(*) as total, count(*) filter (where is_correct) as correct,
  {_ratio("count(*) filter (where is_correct)", "count(*)")} as accuracy,
  {_ratio("count(*) filter (where true_label = 'SAFE' and pred_label = 'SAFE')", "count(*) filter (where true_label = 'SAFE')")} as safe_accuracy,
  {_ratio("count(*) filter (where true_label = 'UNSAFE' and pred_label = 'UNSAFE')", "count(*) filter (where true_label = 'UNSAFE')")} as unsafe_accuracy
  from p group by run, model)"""

LAT = f"""lat as (select run, model, count(latency_s) as n,
  {R('avg(latency_s)', 6)} as latency_mean_s, {R('min(latency_s)', 6)} as latency_min_s,
  {R('max(latency_s)', 6)} as latency_max_s, {R('median(latency_s)', 6)} as latency_median_s,
  {R('quantile_disc(latency_s, 0.95)', 6)} as latency_p95_s
  from p group by run, model)"""


def _mets_values() -> str:
    rows = [f"({_q(m)}, {_q(w)}, {i}, {_q(' | '.join(cases.CHART_RUBRICS[m]))})"
            for i, (m, w) in enumerate(cases.CASE_METRICS)]
    return "mets(metric, word, m_ord, rubric) as (values " + ", ".join(rows) + ")"


def eval_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    W = f"with {RECS}"
    q["record_summary"] = f"{W}, {SUMMARY} select * from summary"
    q["console_summary"] = f"""{W}, {SUMMARY}
      select model, task, total as n, correct, pending,
             coalesce(printf('%.1f%%', {R('accuracy * 100', 1)}), '-') as accuracy,
             coalesce(printf('%.3f', {R('mean_latency_s', 3)}), '-') as mean_latency from summary"""
    q["file_progress"] = f"{W}, {FILES} select * from files"
    q["record_totals"] = f"""{W}, {FILES}
      select count(*) as files, cast(sum(total) as bigint) as records, cast(sum(graded) as bigint) as graded,
             greatest(cast(sum(total) - sum(graded) as bigint), 0) as pending from files"""
    q["first_pending"] = f"{W}, {FILES} select file, first_pending from files"
    q["best_worst"] = f"""{W}, {SUMMARY},
      e as (select task, max(accuracy) as b, min(accuracy) as w from summary group by task)
      select s.task, s.model, s.accuracy,
             case when s.accuracy is null then null when s.accuracy = e.b then 'best'
                  when s.accuracy = e.w then 'worst' end as highlight
      from summary s join e on e.task = s.task"""
    q["kg_gain"] = f"""{W},
      x as (select coalesce(nullif(model, ''), 'default') as model,
                   (count(*) filter (where condition = 'kg_on' and correct))
                     / nullif(count(*) filter (where condition = 'kg_on' and correct is not null), 0) as a_on,
                   (count(*) filter (where condition = 'kg_off' and correct))
                     / nullif(count(*) filter (where condition = 'kg_off' and correct is not null), 0) as a_off
            from recs1 where condition in ('kg_on', 'kg_off') group by 1)
      select model, {R('a_on', 6)} as acc_kg_on, {R('a_off', 6)} as acc_kg_off, {R('a_on - a_off', 6)} as kg_gain from x"""
    q["paired_outcomes"] = f"""{W},
      x as (select coalesce(nullif(model, ''), 'default') as model, order_key // 2 as pair_id,
                   max(case when condition = 'kg_on' then cast(correct as int) end) as c_on,
                   max(case when condition = 'kg_off' then cast(correct as int) end) as c_off,
                   count(*) filter (where condition = 'kg_on') as n_on,
                   count(*) filter (where condition = 'kg_off') as n_off
            from recs1 where condition in ('kg_on', 'kg_off') group by 1, 2)
      select model, pair_id, c_on = 1 as kg_on_correct, c_off = 1 as kg_off_correct,
             case when n_on = 0 or n_off = 0 then 'unpaired' when c_on is null or c_off is null then 'ungraded'
                  when c_on = 1 and c_off = 1 then 'both_correct' when c_on = 1 then 'kg_on_only'
                  when c_off = 1 then 'kg_off_only' else 'neither' end as outcome from x"""
    js = ("case when returned_value = floor(returned_value) then cast(cast(floor(returned_value) as bigint) as varchar) "
          "else cast(returned_value as varchar) end")
    q["review_rows"] = f"""{W}
      select file, "index",
             coalesce(nullif(question, ''), nullif(request_text, ''), nullif(plot_request, ''), params_text,
                      'No prompt text recorded.') as prompt,
             coalesce('Generated SQL:' || chr(10) || generated_sql, '') as secondary,
             coalesce(nullif(model_response, ''), nullif(generated_sql, ''),
                      case when nullif(returned_state, '') is not null or returned_value is not null
                           then 'Returned value: ' || coalesce({js}, '-') || chr(10) || 'Returned state: '
                                || coalesce(returned_state, '-') end,
                      'No model response stored for this record.') as response,
             case when correct then 'Correct' when not correct then 'Incorrect' else 'Pending' end as status,
             case when condition = 'kg_off' then 'KG-Off' else 'KG-On' end as condition_label
      from recs"""
    q["grade_merge"] = f"""{W}, {GRADES},
      valid as (select g.* from grades g semi join recs r on r.file = g.file and r."index" = g."index"),
      last as (select * from (select *, row_number() over (partition by file, "index"
                 order by graded_at desc, correct desc, note desc) as rn from valid) where rn = 1)
      select r.file, r."index", r.order_key,
             case when l.file is not null then l.correct else r.correct end as correct,
             case when l.file is not null then nullif(regexp_replace(l.note, '^\\s+|\\s+$', '', 'g'), '') end as note,
             strftime(l.graded_at, '%Y-%m-%dT%H:%M:%S+00:00') as graded_at
      from recs r left join last l on l.file = r.file and l."index" = r."index\""""
    two = lambda day: f"""select * from (select g.*, row_number() over (partition by file, "index"
                 order by graded_at desc, correct desc, note desc) as rn
               from grades g semi join recs r on r.file = g.file and r."index" = g."index"
               where day(graded_at) % 2 = {day}) where rn = 1"""  # noqa: E731
    q["grade_rewrite"] = f"""{W}, {GRADES},
      first as ({two(0)}), second as ({two(1)}),
      new as (select coalesce(s.file, f.file) as file, coalesce(s."index", f."index") as "index",
                     case when s.file is not null then s.correct else f.correct end as correct,
                     case when s.file is not null then s.note else f.note end as note, coalesce(s.graded_at, f.graded_at) as graded_at
              from first f full join second s on s.file = f.file and s."index" = f."index")
      select r.file, r."index", r.order_key, r.model, case when n.file is not null then n.correct else r.correct end as correct,
             nullif(regexp_replace(n.note, '^\\s+|\\s+$', '', 'g'), '') as note,
             strftime(n.graded_at, '%Y-%m-%dT%H:%M:%S+00:00') as graded_at
      from recs r left join new n on n.file = r.file and n."index" = r."index\""""
    q["stream_grades"] = f"""{W}, {GRADES},
      last as (select * from (select *, row_number() over (partition by file, "index"
                 order by graded_at desc, correct desc, note desc) as rn from grades) where rn = 1),
      graded_recs as (select r.* exclude (correct), case when l.file is not null then l.correct else r.correct end as correct
                 from recs r left join last l on l.file = r.file and l."index" = r."index"),
      {SUMMARY.replace("summary as", "regraded as").replace("from recs1", "from graded_recs")}
      select * from regraded"""
    q["grade_rejects"] = f"""{W}, {GRADES}
      select g.file, g."index", g.correct, strftime(g.graded_at, '%Y-%m-%d %H:%M:%S') as graded_at
      from grades g anti join recs r on r.file = g.file and r."index" = g."index\""""
    P = f"with {PRED}"
    q["predict_parse"] = f"""{P} select run, model, image_path, true_label, pred_label, is_correct,
      {R('latency_s', 6)} as latency_s from p"""
    q["confusion"] = f"{P}, {CONF} select * from conf"
    q["confusion_grid"] = f"""{P}, {CONF}
      select run, model, 'SAFE' as true_label, tp as pred_safe, fn as pred_unsafe from conf
      union all select run, model, 'UNSAFE' as true_label, fp as pred_safe, tn as pred_unsafe from conf"""
    q["class_accuracy"] = f"{P}, {ACC} select * from acc"
    q["latency_stats"] = f"{P}, {LAT} select * from lat"
    q["latency_box"] = f"""{P},
      qs as (select run, model, count(latency_s) as n, quantile_cont(latency_s, 0.25) as q1,
                    median(latency_s) as med, quantile_cont(latency_s, 0.75) as q3 from p group by run, model),
      w as (select p.run, p.model,
                   min(latency_s) filter (where latency_s >= q1 - 1.5 * (q3 - q1)) as wl,
                   max(latency_s) filter (where latency_s <= q3 + 1.5 * (q3 - q1)) as wh
            from p join qs on qs.run = p.run and qs.model = p.model group by p.run, p.model)
      select qs.run, qs.model, n, {R('q1', 6)} as q1, {R('med', 6)} as median, {R('q3', 6)} as q3,
             {R('q3 - q1', 6)} as iqr, {R('least(wl, q1)', 6)} as whisker_low, {R('greatest(wh, q3)', 6)} as whisker_high
      from qs join w on w.run = qs.run and w.model = qs.model"""
    f4 = lambda c: f"printf('%.4f', {R(c, 4)})"
    q["metric_long"] = f"""{P}, {CONF}, {ACC}, {LAT},
      s as (select * from acc join conf using (run, model) join lat using (run, model))
      select run, model, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) as ord,
             unnest(['Accuracy', 'Safe Accuracy', 'Unsafe Accuracy', 'TP', 'TN', 'FP', 'FN',
                     'Latency Mean (s)', 'Latency Median (s)', 'Latency P95 (s)']) as metric,
             unnest([{f4('accuracy')}, {f4('safe_accuracy')}, {f4('unsafe_accuracy')},
                     cast(tp as varchar), cast(tn as varchar), cast(fp as varchar), cast(fn as varchar),
                     {f4('latency_mean_s')}, {f4('latency_median_s')}, {f4('latency_p95_s')}]) as value
      from s"""
    n, seed = 150, 31
    q["class_sample"] = f"""with docs as (select lang as cls, cast(doc_id as varchar) as item,
                                   md5('{seed}:' || cast(doc_id as varchar)) as h from documents),
      cnt as (select cls, count(*) as available from docs group by cls),
      rk as (select d.*, c.available, row_number() over (partition by d.cls order by h, item) as rank
             from docs d join cnt c on c.cls = d.cls),
      draws as (select cls, available, unnest(range(1, {n + 1})) as draw from cnt where available < {n}),
      pick as (select cls, draw,
                      (('0x' || substr(md5('{seed}:' || cls || ':' || cast(draw as varchar)), 1, 8))::bigint
                        % available) + 1 as rank from draws)
      select cls as lang, cast(rank as integer) as draw, item as image_path, false as with_replacement
        from rk where available >= {n} and rank <= {n}
      union all
      select p.cls, cast(p.draw as integer), rk.item, true from pick p join rk on rk.cls = p.cls and rk.rank = p.rank"""
    q["names_renamed"] = """with d as (select distinct source, lang,
          coalesce(nullif(regexp_replace(regexp_replace(source || ':' || lang || '/latest', '^\\s+|\\s+$', '', 'g'),
                   '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'default') as folder from documents)
      select source, lang, folder,
             case folder when 'src0_en_latest' then 'Source zero (en)' when 'src1_de_latest' then 'Source one (de)'
                  else replace(folder, '_', ':') end as label from d"""
    mm = "mm(location, metric, word, agg, aw) as (values " + ", ".join(
        "(" + ", ".join(_q(x) for x in row) + ")" for row in cases.MINMAX_CASES) + ")"
    qs = "[" + ", ".join(_q(x) for x in cases.CHART_QUESTIONS) + "]"
    q["case_tables"] = f"""with {IAQ}, {_mets_values()}, {mm},
      rooms as (select distinct location from iaq),
      dr as (select distinct cast(cast("Date" as date) as varchar) as date, location from iaq),
      g1 as (select 'nl_sql' as task, printf('What is the average %s of %s?', word, location) as text, location, metric,
                    'mean' as agg, null::varchar as date, null::varchar as question, null::varchar as rubric
             from rooms, mets
             union all
             select 'nl_sql', printf('What is the %s %s of %s?', aw, word, location), location, metric, agg,
                    null, null, null from mm where location in (select location from rooms)),
      g2 as (select 'display_cards' as task, concat_ws(' ', date, '08:15', location) as text, location, m.metric,
                    null::varchar as agg, date, null::varchar as question, null::varchar as rubric
             from dr, (values ('temperature_c'), ('humidity_rh')) m(metric)),
      g4 as (select 'chart_interp' as task, concat_ws(' ', 'plot', word, 'for', date, 'in', location) as text,
                    location, metric, null::varchar as agg, date,
                    {qs}[((row_number() over (order by date, location, m_ord) - 1) % 5) + 1] as question, rubric
             from dr, mets)
      select * from g1 union all select * from g2 union all select * from g4"""
    aq = "aq(metric, question, rubric) as (values " + ", ".join(
        f"({_q(m)}, {_q(cases.ABLATION_QUESTIONS[m])}, {_q(' | '.join(cases.ABLATION_RUBRICS[m]))})"
        for m in cases.ABLATION_QUESTIONS) + ")"
    q["ablation_cases"] = f"""with {IAQ}, {_mets_values()}, {aq},
      dr as (select distinct cast(cast("Date" as date) as varchar) as expected_date, location as expected_location from iaq),
      c as (select concat_ws(' ', 'plot', word, 'for', expected_date, 'in', expected_location) as plot_request,
                   aq.question, aq.rubric, mets.metric as expected_metric, expected_location, expected_date,
                   cond.condition, m_ord
            from dr, mets join aq on aq.metric = mets.metric, (values ('kg_on'), ('kg_off')) cond(condition))
      select plot_request, question, rubric, expected_metric, expected_location, expected_date, condition,
             row_number() over (partition by condition order by expected_date, expected_location, m_ord) as "index"
      from c"""
    return q
