"""DuckDB oracle statements for the text group."""

from __future__ import annotations

from roomlens.functions.text import PY_LINE_BREAK

from roomlens.operators import cases
from roomlens.plans import text_queries as tq
from roomlens.plans.oracle_kg import context_ctes, seed_triples_cte
from roomlens.plans.oracle_sql import IAQ, METRIC_LIST, ROOM_LIST


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


GEN = f"""gen as (
  select o_orderkey as text_id,
         case o_orderkey % 10
           when 0 then base
           when 1 then '```' || base || '```'
           when 2 then '```sql' || chr(10) || base || chr(10) || '```'
           when 3 then 'SQL: ' || base
           when 4 then 'Here is the query you asked for:' || chr(10) || base
           when 5 then chr(10) || '  ' || base || '; drop table iaq'
           when 6 then 'Sure. with t as (' || base || ') select * from t'
           when 7 then 'select updated_at from iaq'
           when 8 then 'select transform(location) using ''cat'' as (x string) from iaq' end as raw_text
  from (select o_orderkey,
               'select ' || ['avg', 'min', 'max'][o_custkey % 3 + 1] || '(' || {METRIC_LIST}[o_orderkey % 5 + 1]
               || ') from iaq where lower(location) like ''%' || {ROOM_LIST}[(o_custkey + o_orderkey) % 3 + 1] || '%''' as base
        from orders) o)"""

WS = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def ws(x: str) -> str:
    return WS.format(x=x)


# the lines after the first, re-joined with a newline (str.splitlines)
AFTER_FIRST_LINE = (f"regexp_replace(coalesce(regexp_extract(t, '(?s)^.*?(?:{PY_LINE_BREAK})(.*)$', 1), ''), "
                    f"'{PY_LINE_BREAK}', chr(10), 'g')")

CLEAN = f"""c0 as (select text_id, raw_text, {ws("regexp_replace(" + ws('raw_text') + ", '^`+|`+$', '', 'g')")} as t from gen),
c1 as (select text_id, raw_text, case when len(string_split(t, '```')) >= 3 then {ws("string_split(t, '```')[2]")}
                                 when contains(t, '```') then {ws("replace(t, '```', '')")} else t end as t from c0),
c2 as (select text_id, raw_text,
              case when regexp_full_match(string_split_regex(t, '{PY_LINE_BREAK}')[1], '(?i)\\s*sql\\s*')
                   then {ws(AFTER_FIRST_LINE)}
                   else t end as t from c1),
c3 as (select text_id, raw_text, regexp_replace(t, '(?i)^\\s*(sql|query)\\s*:\\s*', '') as t from c2),
c4 as (select text_id, raw_text,
              case when not regexp_matches(t, '(?i)^\\s*(select|with)\\b') and regexp_matches(t, '(?i)\\bselect\\b')
                   then regexp_extract(t, '(?is)^.*?(\\bselect\\b.*)$', 1) else t end as t from c3),
cleaned as (select text_id, case when raw_text is null or raw_text = '' then ''
                                 else {ws("split_part(t, ';', 1)")} end as sql from c4)"""


def text_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_sql"] = f"with {GEN}, {CLEAN} select * from cleaned"
    low = f"lower({ws('sql')})"
    q["guard_sql"] = f"""with {GEN}, {CLEAN},
      g as (select text_id, sql,
                   case when not regexp_matches({low}, '^(select|with)') then 'Only SELECT statements are allowed.'
                        when regexp_matches({low}, 'insert|update|delete|drop|alter|create|attach|copy|pragma')
                          or regexp_matches({low}, 'reflect\\(|java_method\\(|try_reflect\\(')
                          or contains({low}, 'transform(')
                        then 'Unsafe SQL detected.' end as reason from cleaned)
      select text_id, sql, reason is null as allowed, reason,
             coalesce(regexp_matches({low}, '^(select|with)'), false) as valid_sql from g"""
    q["guarded_query"] = f"""with {IAQ}
      select cast(cast("Date" as date) as varchar) as day, location,
             cast(round(cast(round(avg(temperature_c), 8) as decimal(38, 8)), 6) as double) as avg_temp, cast(round(cast(round(avg(humidity_rh), 8) as decimal(38, 8)), 6) as double) as avg_hum
      from iaq where lower(location) like '%kitchen%' group by 1, 2"""
    for name, sql in tq.GUARDED_SQL.items():
        sql = sql.replace("count(distinct IAQ_class, heat_stable)", "count(distinct (IAQ_class, heat_stable)) filter (where IAQ_class is not null)")
        q[f"guarded_{name}"] = f"with {IAQ} {sql}"
    words = ", ".join(f"({_q(m)}, {_q(w)})" for m, w in cases.CASE_METRICS)
    mm = ", ".join("(" + ", ".join(_q(x) for x in row) + ")" for row in cases.MINMAX_CASES)
    q["score_generated_sql"] = f"""with {IAQ}, {GEN}, {CLEAN},
      long as (select location, metric, v from iaq
               unpivot include nulls (v for metric in (temperature_c, humidity_rh, pressure_hpa, gas_resistance_ohms, IAQ_proxy))),
      truth as (select location, metric, 'mean' as agg, avg(v) as expected from long group by 1, 2
                union all select location, metric, 'min', min(v) from long group by 1, 2
                union all select location, metric, 'max', max(v) from long group by 1, 2),
      mets(metric, word) as (values {words}),
      mm(location, metric, word, agg, aw) as (values {mm}),
      rooms as (select distinct location from iaq),
      qc as (select printf('What is the average %s of %s?', word, location) as text, location, metric, 'mean' as agg
             from rooms, mets
             union all select printf('What is the %s %s of %s?', aw, word, location), location, metric, agg
             from mm where location in (select location from rooms)),
      ans as (select o_orderkey as order_key, o_orderpriority as model, {ROOM_LIST}[o_custkey % 3 + 1] as location,
                     {METRIC_LIST}[o_orderkey % 5 + 1] as metric, ['mean', 'min', 'max'][(o_orderkey // 5) % 3 + 1] as agg
              from orders where o_orderstatus = 'F'),
      j as (select a.order_key, a.model, qc.text, c.sql, t.expected,
                   case a.order_key % 4
                     when 0 then null
                     when 1 then try_cast(cast(t.expected + [0.0, 0.004, 0.03][a.order_key % 3 + 1] as varchar) as double)
                     else null end as result_value
            from ans a left join qc on qc.location = a.location and qc.metric = a.metric and qc.agg = a.agg
            left join truth t on t.location = a.location and t.metric = a.metric and t.agg = a.agg and qc.text is not null
            left join cleaned c on c.text_id = a.order_key)
      select order_key, model, text as question, sql as generated_sql, cast(round(cast(round(result_value, 8) as decimal(38, 8)), 6) as double) as result_value,
             cast(round(cast(round(expected, 8) as decimal(38, 8)), 6) as double) as expected_value,
             coalesce(regexp_matches({low}, '^(select|with)'), false) as valid_sql,
             case when text is not null then coalesce(regexp_matches({low}, '^(select|with)'), false)
               and coalesce(abs(result_value - expected) <= 0.01, false) end as correct,
             case when text is null then 'no-case' else 'scored' end as status
      from j"""
    schema = ("Date (timestamp_ntz)\\nIAQ_class (string)\\nIAQ_proxy (double)\\ngas_resistance_ohms (double)\\n"
              "heat_stable (boolean)\\nhumidity_rh (double)\\nlocation (string)\\npressure_hpa (double)\\n"
              "samples_per_hour (int)\\ntemperature_c (double)")
    head = (tq.SYSTEM_SQL + "\\n" + tq.LOCATIONS_HINT.replace("\n", "\\n") + "Table name: iaq\\n"
            + "Schema (name (dtype)):\\n" + schema + "\\n\\nSample rows (JSON):\\n")
    num = lambda c: f"coalesce(cast(cast(round(cast(round({c}, 8) as decimal(38, 8)), 6) as double) as varchar), 'null')"
    txt = lambda c: f"""coalesce('"' || cast({c} as varchar) || '"', 'null')"""
    raw = lambda c: f"coalesce(cast({c} as varchar), 'null')"
    cells = [("Date", txt('"Date"')), ("IAQ_class", txt("IAQ_class")), ("IAQ_proxy", num("IAQ_proxy")),
             ("gas_resistance_ohms", num("gas_resistance_ohms")), ("heat_stable", raw("heat_stable")),
             ("humidity_rh", num("humidity_rh")), ("location", txt("location")), ("pressure_hpa", num("pressure_hpa")),
             ("samples_per_hour", raw("samples_per_hour")), ("temperature_c", num("temperature_c"))]
    row = "'{' || " + " || ', ' || ".join(f"""'"{c}": ' || {x}""" for c, x in cells) + " || '}'"
    sample = f"""smp as (select '[' || string_agg(r, ', ' order by "Date", location) || ']' as rows
               from (select "Date", location, {row} as r from iaq order by "Date", location limit 5))"""
    hdrs = "[null, ' TRUE ', 'yes', 'off', '0']"
    q["prompt_assembly"] = f"""with {IAQ}, {sample}, {seed_triples_cte()},
      conv as (select conv_id, turn, text, conv_id * 1000 + turn as text_id,
                      turn % 7 = 6 or coalesce(lower({ws(f"{hdrs}[conv_id % 5 + 1]")}) in ('1', 'true', 'yes', 'on'), false) as kg_disabled
               from conversations where role = 'user'),
      {context_ctes('conv', 'text_id', 'text')}
      select c.conv_id, c.turn, c.kg_disabled, coalesce(ctx.n_lines, 0) as n_facts,
             replace({_q(head)}, '\\n', chr(10)) || (select rows from smp) || chr(10) || chr(10)
             || case when not c.kg_disabled
                     then {_q(tq.COMFORT_CONTEXT)}
                          || case when coalesce(ctx.context, '') <> ''
                                  then chr(10) || 'Relevant KG facts:' || chr(10) || ctx.context else '' end
                          || chr(10) || chr(10)
                     else '' end
             || 'Question: ' || coalesce(c.text, '') || chr(10) || chr(10) || {_q(tq.CLOSING)} as prompt
      from conv c left join ctx on ctx.doc_id = c.text_id"""
    return q
