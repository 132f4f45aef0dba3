"""DuckDB oracle statements for the graph queries (brute-force joins)."""

from __future__ import annotations

from roomlens.operators.kg import EX, RDF_TYPE, RDFS_LABEL, seed_rows


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def triples_cte() -> str:
    seed = ",\n    ".join(f"({_q(s)}, {_q(p)}, {_q(o)}, {_q(k)})" for s, p, o, k in seed_rows())
    T, L = _q(RDF_TYPE), _q(RDFS_LABEL)
    ex = lambda x: _q(EX + x)
    nat = f"{_q(EX + 'nation_')} || cast(n_nationkey as varchar)"
    sup = f"{_q(EX + 'supplier_')} || cast(s_suppkey as varchar)"
    met = f"{_q(EX + 'metric_')} || replace(p_name, ' ', '_')"
    pol = f"{_q(EX + 'policy_')} || regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g')"
    ds = f"{_q(EX + 'dataset_')} || cast(c_custkey as varchar)"
    return f"""triples as materialized (
  select * from (values
    {seed}) t(s, p, o, o_type)
  union all select {nat}, {T}, {ex('Location')}, 'iri' from nation
  union all select {nat}, {L}, n_name, 'string' from nation
  union all select {sup}, {T}, {ex('PervasiveDisplay')}, 'iri' from supplier
  union all select {sup}, {L}, s_name, 'string' from supplier
  union all select {sup}, {ex('atLocation')}, {_q(EX + 'nation_')} || cast(s_nationkey as varchar), 'iri' from supplier
  union all select {met}, {T}, {ex('Metric')}, 'iri' from (select distinct p_name from part)
  union all select {met}, {L}, p_name, 'string' from (select distinct p_name from part)
  union all select {met}, {ex('recommendedMin')}, printf('%.2f', min(p_retailprice)), 'float' from part
            group by p_name having length(p_name) % 3 <> 2
  union all select {met}, {ex('recommendedMax')}, printf('%.2f', max(p_retailprice)), 'float' from part
            group by p_name having length(p_name) % 3 = 0
  union all select {pol}, {T}, {ex('Policy')}, 'iri' from (select distinct p_type from part)
  union all select {pol}, {L}, 'Check ' || lower(p_type) || ' when ring or nation load is high', 'string'
            from (select distinct p_type from part)
  union all select {pol}, {ex('appliesTo')}, {_q(EX + 'nation_')} || cast(nk as varchar), 'iri'
            from (select distinct p_type, p_partkey % 25 as nk from part)
  union all select {ds}, {T}, {ex('Dataset')}, 'iri' from customer
  union all select {ds}, {L}, c_name, 'string' from customer
  union all select {ds}, {ex('coversLocation')}, {_q(EX + 'nation_')} || cast(c_nationkey as varchar), 'iri' from customer
  union all select {ds}, {ex('sourceFile')}, c_name || '.csv', 'string' from customer)"""


def kg_sql() -> dict[str, str]:
    T, L = _q(RDF_TYPE), _q(RDFS_LABEL)
    ex = lambda x: _q(EX + x)
    W = f"with {triples_cte()}"
    disp = f"""select a.s as display, b.o as dlabel, c.o as loc, d.o as llabel
      from triples a join triples b on b.s = a.s and b.p = {L}
      join triples c on c.s = a.s and c.p = {ex('atLocation')}
      join triples d on d.s = c.o and d.p = {L}
      where a.p = {T} and a.o = {ex('PervasiveDisplay')}"""
    at = f"""select a.s as display, b.s as loc
      from triples a join triples c on c.s = a.s and c.p = {ex('atLocation')}
      join triples b on b.s = c.o and b.p = {T} and b.o = {ex('Location')}
      where a.p = {T} and a.o = {ex('PervasiveDisplay')}"""
    pol = f"""select a.s as policy, b.o as plabel, c.o as loc, d.o as llabel
      from triples a join triples b on b.s = a.s and b.p = {L}
      join triples c on c.s = a.s and c.p = {ex('appliesTo')}
      join triples d on d.s = c.o and d.p = {L}
      where a.p = {T} and a.o = {ex('Policy')}"""
    met = f"""select a.s as m, b.o as mlab, mn.o as min, mx.o as max
      from triples a join triples b on b.s = a.s and b.p = {L}
      left join triples mn on mn.s = a.s and mn.p = {ex('recommendedMin')}
      left join triples mx on mx.s = a.s and mx.p = {ex('recommendedMax')}
      where a.p = {T} and a.o = {ex('Metric')}"""
    nodes = f"""cand as (
        select display as id, dlabel as label, 'display' as kind, 1 as ord from disp
        union all select loc, llabel, 'location', 2 from disp
        union all select policy, plabel, 'policy', 3 from pol
        union all select loc, llabel, 'location', 4 from pol
        union all select m, mlab, 'metric', 5 from met),
      nodes as (select id, label, kind from (
        select *, row_number() over (partition by id order by ord, label, kind) as rn from cand) where rn = 1)"""
    q: dict[str, str] = {}
    q["kg_displays"] = f"{W} {disp}"
    q["kg_pattern"] = f"{W} {at}"
    q["kg_policies"] = f"{W} {pol}"
    q["kg_metrics_optional"] = f"{W} {met}"
    q["kg_labels_limit"] = f"{W} select s as thing, o as label from triples where p = {L} order by thing, label limit 20"
    q["kg_datasets"] = f"""{W} select a.s as dataset, b.o as dlabel, c.o as loc, e.o as llabel, d.o as file
      from triples a join triples b on b.s = a.s and b.p = {L}
      join triples c on c.s = a.s and c.p = {ex('coversLocation')}
      join triples d on d.s = a.s and d.p = {ex('sourceFile')}
      join triples e on e.s = c.o and e.p = {L}
      where a.p = {T} and a.o = {ex('Dataset')}"""
    q["kg_nodes"] = f"{W}, disp as ({disp}), pol as ({pol}), met as ({met}), {nodes} select * from nodes"
    q["kg_edges"] = f"""{W}, disp as ({disp}), pol as ({pol})
      select display as source, loc as target, 'atLocation' as type from disp
      union all select policy, loc, 'appliesTo' from pol"""
    q["kg_tracks"] = f"""{W}, disp as ({disp}), pol as ({pol}), met as ({met}), {nodes},
      m as (select lower(label) as l, max(id) as target from nodes where kind = 'metric'
            and lower(label) in ('temperature', 'humidity', 'pressure', 'gas resistance') group by 1)
      select n.id as source, m.target, 'tracks' as type from nodes n, m where n.kind = 'location'"""
    q["kg_context"] = f"""{W}, {context_ctes('documents', 'doc_id', 'text')}
      select d.doc_id, coalesce(ctx.n_lines, 0) as n_lines, coalesce(ctx.context, '') as context
      from documents d left join ctx on ctx.doc_id = d.doc_id"""
    return q


def seed_triples_cte() -> str:
    seed = ",\n    ".join(f"({_q(s)}, {_q(p)}, {_q(o)}, {_q(k)})" for s, p, o, k in seed_rows())
    return f"triples as materialized (select * from (values\n    {seed}) t(s, p, o, o_type))"


def context_ctes(texts: str, id_col: str, text_col: str, limit: int = 6) -> str:
    """K-7 by brute force: every distinct word against every label with
    `contains`, then the line budget with plain windows.  Defines `ctx`."""
    T, L = _q(RDF_TYPE), _q(RDFS_LABEL)
    ex = lambda x: _q(EX + x)
    return f"""lab as (select s, o as label from triples where p = {L}),
      ty as (select s, max(case when o = {ex('Metric')} then 1 else 0 end) as is_metric,
                    max(case when o = {ex('Policy')} then 1 else 0 end) as is_policy
             from triples where p = {T} group by s),
      bd as (select s, min(case when p = {ex('recommendedMin')} then o end) as lo,
                    min(case when p = {ex('recommendedMax')} then o end) as hi from triples group by s),
      facts as (select lab.s, lab.label, coalesce(ty.is_policy, 0) as is_policy,
                       string_split(lab.s, '/')[-1] || ' --label--> ' || lab.label as line1,
                       case when ty.is_metric = 1 and (bd.lo is not null or bd.hi is not null)
                            then string_split(lab.s, '/')[-1] || ' --recommendedRange--> '
                                 || coalesce(bd.lo, '-inf') || ' to ' || coalesce(bd.hi, 'inf') end as line2
                from lab left join ty on ty.s = lab.s left join bd on bd.s = lab.s),
      dw as (select distinct {id_col} as doc_id, lower(w) as word
             from (select {id_col}, unnest(regexp_split_to_array({text_col}, '\\s+')) as w from {texts})
             where length(w) >= 3),
      vocab as (select distinct word from dw),
      wf as (select v.word, f.* from vocab v join facts f on contains(lower(f.label), v.word)),
      hits as (select distinct dw.doc_id, wf.s, wf.label, wf.is_policy, wf.line1, wf.line2
               from dw join wf on wf.word = dw.word),
      ranked as (select *, row_number() over (partition by doc_id order by s, label) as rk,
                        case when line2 is null then 1 else 2 end as nl from hits),
      lab_b as (select *, coalesce(sum(nl) over (partition by doc_id order by rk
                        rows between unbounded preceding and 1 preceding), 0) as before from ranked),
      lab_kept as (select * from lab_b where before < {limit}),
      used as (select doc_id, sum(nl) as used from lab_kept group by doc_id),
      pol as (select *, row_number() over (partition by doc_id order by s, label) as pk from hits where is_policy = 1),
      pol_kept as (select pol.* from pol left join used on used.doc_id = pol.doc_id
                   where pk = 1 or coalesce(used.used, 0) + pk - 1 < {limit}),
      lines as (select doc_id, 0 as g, rk as r, 0 as sub, line1 as line from lab_kept
                union all select doc_id, 0, rk, 1, line2 from lab_kept where line2 is not null
                union all select doc_id, 1, pk, 0, 'Policy: ' || label from pol_kept),
      ctx as (select doc_id, string_agg(line, chr(10) order by g, r, sub) as context, count(*) as n_lines
              from lines group by doc_id)"""
