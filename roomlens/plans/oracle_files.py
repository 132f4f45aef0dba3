"""DuckDB oracle statements for the file/replay/stream group.

What is read back must equal what the tables say, so most statements are
the table-side computation of the same result."""

from __future__ import annotations

from roomlens.plans.oracle_eval import ACC, CONF, GRADES, LAT, PRED, R, RECS, eval_sql
from roomlens.plans.oracle_kg import kg_sql, triples_cte
from roomlens.plans.oracle_sql import IAQ, room_sql

SANITIZE = ("coalesce(nullif(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), "
            "'[^A-Za-z0-9._-]+', '_', 'g'), ''), 'default')")


def files_sql() -> dict[str, str]:
    rs, es = room_sql(), eval_sql()
    q: dict[str, str] = {}
    q["room_csv_scan"] = rs["union_rooms"]
    q["room_csv_quality"] = f"""with {IAQ},
      r as (select location, location || '_measurements_IAQ_1h_avg.csv' as file, hour("Date") as h from iaq)
      select file, c as "column", count(*) as rows,
             count(*) filter (where (c = 'Date' and h = 6) or (c = 'temperature_c' and h = 4) or (c = 'humidity_rh' and h < 2)) as missing,
             count(*) filter (where (c = 'Date' and h = 5) or (c = 'temperature_c' and h = 3) or (c = 'samples_per_hour' and h % 2 = 0)) as bad
      from r, (values ('Date'), ('temperature_c'), ('humidity_rh'), ('samples_per_hour')) cols(c)
      where not (location = 'kitchen' and c = 'samples_per_hour') group by 1, 2"""
    q["room_csv_override"] = f"""with {IAQ}
      select cast("Date" as varchar) as "Date", 'unknown' as location, IAQ_class, samples_per_hour, {R('temperature_c', 6)} as temperature_c
      from iaq where location = 'office'"""
    q["kg_file_lineage"] = f"""with {IAQ}, d as ({kg_sql()['kg_datasets']}),
      f as (select location || '_measurements_IAQ_1h_avg.csv' as file, count(*) as rows_read from iaq group by 1
            union all select 'attic_measurements_IAQ_1h_avg.csv', count(*) from iaq where location = 'office' and hour("Date") = 0 having count(*) > 0)
      select d.dataset, d.llabel, coalesce(d.file, f.file) as file, f.rows_read,
             case when f.file is null then 'no-file' when d.dataset is null then 'no-dataset' else 'read' end as status
      from d full join f on f.file = d.file"""
    q["latency_sketch"] = f"""with {PRED} select run, model, count(latency_s) as n, true as median_within, true as p95_within
      from p group by run, model having count(latency_s) > 0"""
    q["result_listing"] = f"""with {RECS}, {GRADES},
      last as (select * from (select *, row_number() over (partition by file, "index" order by graded_at desc, correct desc, note desc) as rn
               from grades where file like 'nl_sql%') where rn = 1),
      g as (select r.file, l.file is not null as hit, case when l.file is not null then l.correct else r.correct end as correct
            from recs r left join last l on l.file = r.file and l."index" = r."index")
      select file, split_part(file, '_r', 1) as task_type, count(*) as total, count(*) filter (where correct is not null) as graded,
             count(*) filter (where correct is null) as pending, count(*) filter (where correct) as correct,
             cast(round(count(*) filter (where correct is not null) * 100.0 / count(*), 0) as bigint) as progress_pct, bool_or(hit) as changed
      from g group by file"""
    q["ntriples_scan"] = f"with {triples_cte()} select s, p, o, o_type from triples"
    q["jsonl_roundtrip"] = f"""with {RECS}
      select task, {SANITIZE.format(x='model')} as model_dir, 'r' || cast(order_key % 4 as varchar) as run, count(*) as total,
             count(*) filter (where correct is not null) as graded, count(*) filter (where correct is null) as pending,
             count(*) filter (where correct) as correct,
             case when task = 'nl_sql' and {SANITIZE.format(x='model')} = '1-URGENT' and order_key % 4 = 0 then 2 else 0 end as corrupt,
             true as modified_known
      from recs1 group by 1, 2, 3, corrupt"""
    q["csv_roundtrip"] = f"""with {PRED},
      r as (select model, true_label,
                   case when cast(image_path as bigint) % 13 = 0 then ''
                        when cast(image_path as bigint) % 17 = 0 then 'n/a'
                        else printf('%.6f', latency_s) end as lat from p),
      chosen as (select *, 'raw_safety_eval.csv' as file_name from r where model <> 'de'
                 union all select *, 'raw_safety_experiment.csv' from r where model = 'de' and true_label = 'UNSAFE')
      select model, file_name, count(*) as n, cast(round(cast(round(avg(try_cast(lat as double)), 8) as decimal(38, 8)), 6) as double) as latency_mean_s
      from chosen where try_cast(lat as double) is not null group by model, file_name"""
    f4 = lambda c: f"printf('%.4f', cast(round(cast(round({c}, 8) as decimal(38, 8)), 4) as double)) as {c}"
    q["summary_csv"] = f"""with {PRED}, {CONF}, {ACC}, {LAT}
      select model, {f4('accuracy')}, {f4('safe_accuracy')}, {f4('unsafe_accuracy')}, cast(tp as varchar) as tp,
             cast(tn as varchar) as tn, cast(fp as varchar) as fp, cast(fn as varchar) as fn,
             {', '.join(f4(f'latency_{c}_s') for c in ('mean', 'min', 'max', 'median', 'p95'))}
      from acc join conf using (run, model) join lat using (run, model)"""
    q["sample_manifest"] = f"""select 31 as seed, 150 as n_per_class, lang, string_agg(image_path, ',' order by image_path) as items
      from ({es['class_sample']}) group by lang"""
    q["image_checks"] = """select 'page_' || cast(page_id as varchar) as name,
             case when page_id % 7 <> 0 then cast(strlen(html) + case when page_id % 3 = 0 then 8 else 0 end as bigint) end as size,
             page_id % 7 <> 0 as decodes, page_id % 7 <> 0 and page_id % 3 = 0 as is_png
      from pages"""
    q["image_scan"] = """with p as (
        select page_id, coalesce(html, '') as html,
               case page_id % 5 when 0 then 'png' when 1 then 'JPG' when 2 then 'jpeg' when 3 then 'WebP' else 'txt' end as ext
        from pages where page_id is not null)
      select 'd' || lpad(cast(page_id % 16 as varchar), 2, '0') as folder, 'page_' || cast(page_id as varchar) || '.' || ext as name,
             lower(ext) as ext, cast(strlen(html) + case when page_id % 3 = 0 then 8 else 0 end as bigint) as size,
             true as decodes, page_id % 3 = 0 as is_png
      from p where ext <> 'txt' and (html <> '' or page_id % 3 = 0)"""
    q["artifact_scan"] = f"""with {RECS}
      select {SANITIZE.format(x='model')} as model, cast(order_key as bigint) as "index", condition,
             'temperature' as metric_word, regexp_extract(plot_request, 'for (\\S+) in', 1) as date,
             regexp_extract(plot_request, ' in ([a-z]+)$', 1) as location, model_response as text, false as stray
      from recs1 where model_response is not null
      union all select null, null, null, null, null, null, 'not a response', true"""
    q["ablation_records"] = f"""with {RECS},
      cs as ({es['ablation_cases']}),
      n as (select condition, count(*) as n_cases from cs group by condition),
      lim as ({rs['safe_limit']}),
      r as (select order_key, {SANITIZE.format(x='model')} as model, recs1.condition,
                   order_key % n.n_cases + 1 as "index", model_response, correct
            from recs1 join n on n.condition = recs1.condition where task = 'kg_ablation')
      select r.order_key, r.model, r.condition, r."index", cs.plot_request, lim.expected_safe_state,
             lim.recommended_min, lim.recommended_max, lim.observed_min, lim.observed_max, lim.violation,
             r.model_response, r.correct
      from r left join cs on cs.condition = r.condition and cs."index" = r."index"
      left join lim on lim.date = cs.expected_date and lim.location = cs.expected_location and lim.metric = cs.expected_metric"""
    q["batch_predict"] = f"with {PRED} select image_path, model_text, pred_label from p"
    q["stream_summary"] = es["record_summary"]
    return q
