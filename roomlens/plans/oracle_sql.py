"""DuckDB oracle statements, written independently of the Spark plans.

The oracle is deliberately brute force (range joins on raw rows, theta
joins, plain windows): it states the semantics, not an efficient plan.
Tables are the driver's pre-registered views.
"""

from __future__ import annotations

ROOM_LIST = "['hallway', 'kitchen', 'office']"
METRIC_LIST = "['temperature_c', 'humidity_rh', 'pressure_hpa', 'gas_resistance_ohms', 'IAQ_proxy']"

IAQ = """iaq as (
  select h as "Date", location,
         23 + (day(h) % 7 - 3) * 1.3 + (v - 50) * 0.06 as temperature_c,
         45 + (day(h) % 5 - 2) * 8.0 + (c - 50) * 0.25 as humidity_rh,
         990 + p * 0.2 as pressure_hpa,
         1000 * e as gas_resistance_ohms,
         g as IAQ_proxy,
         n >= 5 as heat_stable,
         case when g is null then null when g < 25 then 'good' when g < 75 then 'fair' else 'poor' end as IAQ_class,
         n as samples_per_hour
  from (select date_trunc('hour', ts) as h,
               case user_id % 3 when 0 then 'hallway' when 1 then 'kitchen' else 'office' end as location,
               avg(case when event_type = 'view' then value end) as v,
               avg(case when event_type = 'click' then value end) as c,
               avg(case when event_type = 'purchase' then value end) as p,
               avg(case when event_type = 'error' then value end) as e,
               avg(case when event_type = 'signup' then value end) as g,
               cast(count(*) as int) as n
        from events group by 1, 2) x)"""

LONG = """long as (
  select "Date", location, metric, v from iaq
  unpivot include nulls (v for metric in (temperature_c, humidity_rh, pressure_hpa, gas_resistance_ohms, IAQ_proxy)))"""

DIM = """dim(metric, lo, hi, has_range) as (values
  ('temperature_c', 20.0::double, 26.0::double, true),
  ('humidity_rh', 30.0::double, 60.0::double, true),
  ('pressure_hpa', null::double, null::double, false),
  ('IAQ_proxy', null::double, null::double, false),
  ('gas_resistance_ohms', null::double, null::double, false))"""

REQ = f"""req as (
  select o_orderkey as request_id,
         case o_orderkey % 7
           when 0 then concat_ws(' ', 'plot', m, 'for', d1, 'in', r1)
           when 1 then concat_ws(' ', 'plot', m, 'from', d1, 'to', d2, 'in', r1)
           when 2 then concat_ws(' ', 'plot', m, 'in', r1)
           when 3 then concat_ws(' ', 'plot', m, 'for', d1)
           when 4 then concat_ws(' ', 'plot', m, 'for 2024-13-45 in', r1)
           when 5 then concat_ws(' ', 'plot wind speed for', d1, 'in', r1)
           else concat_ws(' ', 'plot', m, 'for', d1, 'in', r1, 'and', r2) end as request
  from (select o_orderkey,
               ['temperature', 'humidity', 'pressure', 'gas resistance', 'IAQ'][o_orderkey % 5 + 1] as m,
               {ROOM_LIST}[o_custkey % 3 + 1] as r1,
               {ROOM_LIST}[(o_custkey + 1) % 3 + 1] as r2,
               '2024-01-' || lpad(cast(o_orderkey % 25 + 1 as varchar), 2, '0') as d1,
               '2024-01-' || lpad(cast(o_orderkey % 25 + 2 + o_custkey % 5 as varchar), 2, '0') as d2
        from orders) o)"""


def parse_cols(col: str = "request") -> str:
    """Metric (map order), first/second date, first room, as select items."""
    lc = f"lower({col})"
    words = [("temperature", "temperature_c"), ("temp", "temperature_c"), ("humidity", "humidity_rh"),
             ("pressure", "pressure_hpa"), ("iaq", "IAQ_proxy"), ("iaq score", "IAQ_proxy"),
             ("gas resistance", "gas_resistance_ohms")]
    metric = "case " + " ".join(
        f"when regexp_matches({lc}, '\\b{w}\\b') then '{m}'" for w, m in words) + " end"
    dates = f"regexp_extract_all({col}, '(20\\d{{2}}-\\d{{2}}-\\d{{2}})', 1)"
    room = "case " + " ".join(f"when contains({lc}, '{r}') then '{r}'"
                              for r in ["kitchen", "office", "hallway"]) + " end"
    return (f"{metric} as metric, {dates}[1] as date_from, {dates}[2] as date_to, {room} as room")


WINDOW = """cast(try_strptime(date_from, '%Y-%m-%d') as date) as d0,
  case when date_to is null then cast(try_strptime(date_from, '%Y-%m-%d') as date) + 1
       else cast(try_strptime(date_to, '%Y-%m-%d') as date) end as d1"""

DAILY = """d as (select cast(cast("Date" as date) as varchar) as day, location,
                 avg(temperature_c) as t, avg(humidity_rh) as h from iaq group by 1, 2)"""


def card(col: str, name: str, lo: int, hi: int) -> str:
    return (f"select day, location, '{name}' as title, cast(round(cast(round({col}, 8) as decimal(38, 8)), 2) as double) as value, "
            f"case when {col} is null then 'no-data' when {col} < {lo} then 'warn-low' "
            f"when {col} > {hi} then 'warn-high' else 'ok' end as status from d")


PLOT_REQ = """labels(expected_metric, label) as (values ('temperature_c', 'temperature'), ('humidity_rh', 'humidity'),
     ('pressure_hpa', 'pressure'), ('gas_resistance_ohms', 'gas resistance'), ('IAQ_proxy', 'IAQ')),
  dr as (select distinct cast(cast("Date" as date) as varchar) as expected_date, location as expected_location from iaq),
  preq as (select concat_ws(' ', 'plot', label, 'for', expected_date, 'in', expected_location) as request,
                  expected_metric, expected_date, expected_location from dr, labels)"""

TITLE = """case metric when 'temperature_c' then 'Temperature' when 'humidity_rh' then 'Humidity'
       when 'pressure_hpa' then 'Pressure' when 'IAQ_proxy' then 'IAQ score' else metric end"""


def room_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["daily_cards"] = f"with {IAQ}, {DAILY} {card('t', 'temperature_c', 20, 26)} union all {card('h', 'humidity_rh', 30, 60)}"
    locs = ", ".join(f"('{x}')" for x in ["kitchen", "Office", "hallway", "^h", "office|hall", "KIT", "garage", "("]) + ", (null)"
    q["card_requests"] = f"""with {IAQ},
      days0 as (select distinct cast(cast("Date" as date) as varchar) as date from iaq),
      days as (select date from days0 union all select date || ' 01:30' from days0 union all select '2024-13-45'),
      locs(location) as (values {locs}),
      req as (select date || '|' || coalesce(location, '-') as request_id, date, location,
                     coalesce(location, 'office') as pat, try_cast(date as timestamp) as t0 from days, locs),
      m as (select r.request_id, avg(i.temperature_c) as t, avg(i.humidity_rh) as h
            from req r join iaq i on i."Date" >= r.t0 and i."Date" < r.t0 + interval 1 day
             and case when r.pat = '(' then false else regexp_matches(lower(i.location), lower(replace(r.pat, '(', ''))) end
            group by r.request_id),
      w as (select r.*, m.t, m.h from req r left join m on m.request_id = r.request_id),
      long as (select request_id, date, location, pat, t0, 'temperature_c' as title, t as v, 20 as lo, 26 as hi from w
               union all select request_id, date, location, pat, t0, 'humidity_rh', h, 30, 60 from w)
      select request_id, date, location, title, cast(round(cast(round(v, 8) as decimal(38, 8)), 2) as double) as value,
             case when t0 is null then 'bad-date' when pat = '(' then 'bad-pattern' when v is null then 'no-data'
                  when v < lo then 'warn-low' when v > hi then 'warn-high' else 'ok' end as status from long"""
    q["daily_ticker"] = f"""with {IAQ}, {DAILY}
      select day, location, 'temperature_c: ' || coalesce(cast(cast(round(cast(round(t, 8) as decimal(38, 8)), 2) as double) as varchar), 'nan')
             || ' • humidity_rh: ' || coalesce(cast(cast(round(cast(round(h, 8) as decimal(38, 8)), 2) as double) as varchar), 'nan') as ticker from d"""
    q["location_stats"] = f"""with {IAQ}, {LONG}
      select location, metric, cast(round(cast(round(avg(v), 8) as decimal(38, 8)), 6) as double) as mean, cast(round(cast(round(min(v), 8) as decimal(38, 8)), 6) as double) as min, cast(round(cast(round(max(v), 8) as decimal(38, 8)), 6) as double) as max
      from long group by location, metric"""
    q["window_value"] = f"""with {IAQ}, {LONG},
      days as (select distinct cast("Date" as date) as d0 from iaq),
      rooms(room) as (values ('kitchen'), ('office'), ('hallway'), ('garage')),
      metrics as (select unnest({METRIC_LIST}) as metric),
      r as (select * from days, rooms, metrics)
      select cast(r.d0 as varchar) as start_day, r.room, r.metric, cast(round(cast(round(avg(l.v), 8) as decimal(38, 8)), 6) as double) as value_mean,
             case when avg(l.v) is null then 'no-data' else 'ok' end as status
      from r left join long l on l.metric = r.metric and l."Date" >= r.d0
           and l."Date" < r.d0 + interval 3 day and contains(l.location, r.room)
      group by r.d0, r.room, r.metric"""
    q["parse_requests"] = f"""with {REQ}, p as (select request_id, {parse_cols()} from req)
      select request_id, metric, date_from, date_to, room as location,
             try_strptime(date_from, '%Y-%m-%d') is not null as date_ok from p"""
    q["value_questions"] = f"""with {IAQ}, {LONG}, {REQ},
      p as (select request_id, {parse_cols()} from req),
      w as (select *, {WINDOW} from p),
      v as (select w.request_id, avg(l.v) as value_mean from w join long l
              on l.metric = w.metric and l."Date" >= w.d0 and l."Date" < w.d1
             and (w.room is null or contains(l.location, w.room))
            where w.metric is not null and w.d0 is not null and w.d1 is not null group by w.request_id)
      select w.request_id, w.metric, w.date_from as date, w.room, cast(round(cast(round(v.value_mean, 8) as decimal(38, 8)), 6) as double) as value_mean,
             case when w.metric is null then 'no-metric' when w.date_from is null then 'no-date'
                  when w.d0 is null or w.d1 is null then 'bad-date'
                  when v.value_mean is null then 'no-data' else 'ok' end as status
      from w left join v on v.request_id = w.request_id"""
    q["daily_mean"] = f"""with {IAQ}, {LONG}
      select cast(cast("Date" as date) as varchar) as day, location, metric, cast(round(cast(round(avg(v), 8) as decimal(38, 8)), 6) as double) as mean
      from long group by all"""
    q["hourly_profile"] = f"""with {IAQ}, {LONG}
      select location, cast(hour("Date") as integer) as hour, metric, cast(round(cast(round(avg(v), 8) as decimal(38, 8)), 6) as double) as mean
      from long group by all"""
    q["point_value"] = f"""with {IAQ}
      select e.event_id as ask_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') as asked_at, e.loc as location,
             cast(round(cast(round(i.temperature_c, 8) as decimal(38, 8)), 6) as double) as temperature_c, cast(round(cast(round(i.humidity_rh, 8) as decimal(38, 8)), 6) as double) as humidity_rh
      from (select event_id, ts, {ROOM_LIST}[user_id % 3 + 1] as loc from events) e
      left join iaq i on i."Date" = date_trunc('hour', e.ts) and i.location = e.loc"""
    q["safe_limit"] = f"""with {IAQ}, {LONG}, {DIM},
      d as (select cast(cast("Date" as date) as varchar) as date, location, metric, min(v) as omin, max(v) as omax
            from long where metric in ('temperature_c', 'humidity_rh') group by all)
      select date, location, metric,
             case when omin is null then 'no-data' when omin >= lo and omax <= hi then 'within_safe_limit' else 'outside_safe_limit' end
               as expected_safe_state,
             lo as recommended_min, hi as recommended_max, cast(round(cast(round(omin, 8) as decimal(38, 8)), 6) as double) as observed_min, cast(round(cast(round(omax, 8) as decimal(38, 8)), 6) as double) as observed_max,
             case when omin is null or omin >= lo and omax <= hi then null when omin < lo and omax > hi then 'below_and_above'
                  when omin < lo then 'below' else 'above' end as violation
      from d join dim using (metric)"""
    q["oracle_state"] = f"""with {IAQ}, {LONG}, {DIM},
      d as (select cast(cast("Date" as date) as varchar) as date, location, metric, avg(v) as m
            from long where metric in ('temperature_c', 'humidity_rh') group by all)
      select date, location, metric, cast(round(cast(round(m, 8) as decimal(38, 8)), 6) as double) as expected_value,
             case when lo is null or hi is null then 'unknown' when m is null then 'no-data'
                  when m < lo then 'warn-low' when m > hi then 'warn-high' else 'ok' end as expected_state
      from d join dim using (metric)"""
    q["result_status"] = f"""with {IAQ}, {LONG}, {DIM},
      x as (select location, metric, avg(v) as m from long group by all)
      select location, metric,
             case when lo is not null and m < lo then 'warn-low' when hi is not null and m > hi then 'warn-high'
                  when has_range then 'ok' else 'info' end as status,
             case when lo is not null and m < lo then 'Below range' when hi is not null and m > hi then 'Above range'
                  when has_range then 'Within range' else 'Info' end as status_label,
             'Mean value ' || printf('%.2f', cast(round(cast(round(m, 8) as decimal(38, 8)), 2) as double))
               || case when lo is not null or hi is not null
                       then ' (comfort ' || coalesce(printf('%.1f', lo), '–') || ' – ' || coalesce(printf('%.1f', hi), '–') || ')'
                       else '' end as detail,
             cast(round(cast(round(m, 8) as decimal(38, 8)), 3) as double) as mean_value, lo as recommended_min, hi as recommended_max,
             upper(substr(location, 1, 1)) || lower(substr(location, 2)) as location_title
      from x join dim using (metric) where m is not null"""
    all_req = f"""{REQ}, areq as (select cast(request_id as varchar) as request_id, request from req
                union all select 'none', 'plot temperature for 2030-01-01 in office'),
      p as (select request_id, {parse_cols()} from areq),
      w as (select *, {WINDOW}, concat_ws('|', metric, coalesce(room, '*'), coalesce(date_from, '*'), coalesce(date_to, '*'))
                   as series from p)"""
    match = """l.metric = w.metric and (w.date_from is null or (l."Date" >= w.d0 and l."Date" < w.d1))
                          and (w.room is null or contains(lower(l.location), w.room))"""
    q["series_with_band"] = f"""with {IAQ}, {LONG}, {DIM}, {all_req},
      s as (select distinct series, metric, room, date_from, date_to, d0, d1 from w where metric is not null)
      select w.series, cast(l."Date" as varchar) as "Date", l.location, l.metric,
             cast(round(cast(round(l.v, 8) as decimal(38, 8)), 6) as double) as value,
             case when l.metric in ('temperature_c', 'humidity_rh') and lo is not null and hi is not null then lo end as band_min,
             case when l.metric in ('temperature_c', 'humidity_rh') and lo is not null and hi is not null then hi end as band_max,
             case when date_from is not null and date_to is null then {TITLE.replace('metric', 'l.metric')} || ' on ' || date_from
                  when date_from is not null then {TITLE.replace('metric', 'l.metric')} || ' from ' || date_from || ' to ' || date_to
                  else {TITLE.replace('metric', 'l.metric')} end
               || coalesce(' at ' || upper(substr(w.room, 1, 1)) || lower(substr(w.room, 2)), '') as title,
             case when date_from is not null and date_to is null then 'time on ' || date_from else 'time' end as x_label
      from s w join long l on {match}
      left join dim on dim.metric = l.metric"""
    q["series_requests"] = f"""with {IAQ}, {LONG}, {all_req},
      hit as (select distinct w.series from w join long l on {match})
      select w.request_id, case when w.metric is not null then w.series end as series,
             case when w.metric is null then 'no-metric'
                  when w.date_from is not null and (w.d0 is null or w.d1 is null) then 'bad-date'
                  when hit.series is null then 'no-data' else 'ok' end as status
      from w left join hit on hit.series = w.series"""
    q["score_parse"] = f"""with {IAQ}, {PLOT_REQ},
      p as (select *, {parse_cols()} from preq)
      select request, metric as parsed_metric, room as parsed_location, date_from as parsed_date,
             coalesce(metric = expected_metric and room = expected_location and date_from = expected_date, false)
               as correct
      from p"""
    q["score_cards"] = f"""with {IAQ}, {LONG}, {DIM},
      recs as (select o_orderkey as order_key, case when o_orderkey % 17 = 0 then '' else o_orderpriority end as model,
                      '2024-01-' || lpad(cast(o_orderkey % 30 + 1 as varchar), 2, '0') as date,
                      {ROOM_LIST}[o_custkey % 3 + 1] as location,
                      {METRIC_LIST}[o_orderkey % 5 + 1] as metric,
                      cast(round(cast(round(o_totalprice / 1e4, 8) as decimal(38, 8)), 2) as double) as returned_value,
                      case when o_custkey % 3 = 0 then 'ok' when o_custkey % 3 = 1 then 'warn-low' end as returned_state
               from orders where o_orderstatus = 'O'),
      d as (select cast(cast("Date" as date) as varchar) as date, location, metric, avg(v) as m
            from long where metric in ('temperature_c', 'humidity_rh') group by all),
      e as (select date, location, metric, cast(round(cast(round(m, 8) as decimal(38, 8)), 6) as double) as expected_value,
                   case when m is null then 'no-data' when m < lo then 'warn-low' when m > hi then 'warn-high'
                        else 'ok' end as expected_state from d join dim using (metric))
      select order_key, model, date, location, metric, returned_value, returned_state, expected_value, expected_state,
             coalesce(returned_state = expected_state and abs(returned_value - expected_value) <= 0.01, false) as correct
      from recs left join e using (date, location, metric)"""
    q["sample_rows"] = f"""with {IAQ}
      select cast("Date" as varchar) as "Date", location, cast(round(cast(round(temperature_c, 8) as decimal(38, 8)), 6) as double) as temperature_c,
             cast(round(cast(round(humidity_rh, 8) as decimal(38, 8)), 6) as double) as humidity_rh, cast(round(cast(round(pressure_hpa, 8) as decimal(38, 8)), 6) as double) as pressure_hpa,
             cast(round(cast(round(IAQ_proxy, 8) as decimal(38, 8)), 6) as double) as IAQ_proxy, cast(round(cast(round(gas_resistance_ohms, 8) as decimal(38, 8)), 6) as double) as gas_resistance_ohms
      from iaq order by "Date", location limit 5"""
    q["union_rooms"] = f"""with {IAQ}
      select cast("Date" as varchar) as "Date", cast(round(cast(round(IAQ_proxy, 8) as decimal(38, 8)), 6) as double) as IAQ_proxy,
             case when location = 'kitchen' then null else IAQ_class end as IAQ_class,
             cast(round(cast(round(gas_resistance_ohms, 8) as decimal(38, 8)), 6) as double) as gas_resistance_ohms, heat_stable, cast(round(cast(round(humidity_rh, 8) as decimal(38, 8)), 6) as double) as humidity_rh,
             location, cast(round(cast(round(pressure_hpa, 8) as decimal(38, 8)), 6) as double) as pressure_hpa, samples_per_hour, cast(round(cast(round(temperature_c, 8) as decimal(38, 8)), 6) as double) as temperature_c
      from iaq"""
    return q
