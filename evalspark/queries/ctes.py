"""The stand-in tables of ``fixtures`` once more, as SQL for the checking engine."""

from __future__ import annotations

from evalspark.fixtures import EVENT_TYPES, FEATURES64, FIELDS, RATERS, RUBRIC_PHRASES

_MODELS = ", ".join(f"('{m}', '{n}', '{u}')" for m, n, u in RATERS)
_TYPES = ", ".join(f"('{t}')" for t in EVENT_TYPES)


def _answers(salt: str) -> str:
    return f"""
  select activity_uuid as case_id, model,
    case when h3 < '05' then null when h3 < '08' then '' when h3 < '0c' then substr(body, 1, 25)
         when h3 < '0e' then '[1, 2]' when h3 < '10' then concat(body, ' Hope this helps')
         when h3 < '50' then concat('```json', chr(10), body, chr(10), '```') else body end as raw
  from (
    select *, concat('{{"activity_name": "',
      case when h1 < name_thr then 'unknown' when h1 > 'f0' then concat(' ', upper(activity_name)) else activity_name end,
      '", "geography": "', geography, '", "reference_product_name": "', reference_product_name,
      '", "reference_product_unit": "',
      case when h2 < unit_thr then 'kilogram' else reference_product_unit end, '"}}') as body
    from (
      select a.*, m.*,
        md5(concat(cast(activity_uuid as varchar), '|', model, '|name{salt}')) as h1,
        md5(concat(cast(activity_uuid as varchar), '|', model, '|unit{salt}')) as h2,
        md5(concat(cast(activity_uuid as varchar), '|', model, '|form{salt}')) as h3
      from activities a cross join (values {_MODELS}) m(model, name_thr, unit_thr)))"""


def _parsed(source: str) -> str:
    fields = ", ".join(f"case when s = 'ok' then json_extract_string(c, '$.{f}') end as p_{f}" for f in FIELDS)
    return f"""
  select case_id, model, raw, s as parse_state, {fields}
  from (
    select *, case when coalesce(raw, '') = '' then 'parse_error' when not json_valid(c) then 'parse_error'
                   when json_type(c) = 'OBJECT' then 'ok' else 'not_object' end as s
    from (
      select *, case when starts_with(t, '```')
          then regexp_replace(regexp_replace(regexp_replace(t, '^`+|`+$', '', 'g'), 'json', ''), '^\\s+|\\s+$', '', 'g')
          else t end as c
      from (select *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as t from {source})))"""


def norm(x: str) -> str:
    return f"lower(regexp_replace(coalesce(cast({x} as varchar), ''), '^\\s+|\\s+$', '', 'g'))"


def _scored(source: str) -> str:
    flags = ", ".join(
        f"cast(parse_state = 'ok' and {norm('p_' + f)} = {norm('t.' + f)} as int) as {f}_correct" for f in FIELDS
    )
    every = ", ".join(f"{f}_correct" for f in FIELDS)
    truth = ", ".join(f"t.{f} as t_{f}" for f in FIELDS)
    return f"""
  select *, least({every}) as correct from (
    select p.*, {truth}, {flags} from {source} p join activities t on t.activity_uuid = p.case_id)"""


PARTS = {
    "activities": """
  select p_partkey as activity_uuid, concat(p_name, ', ', lower(p_type), ' production') as activity_name,
    n_name as geography, p_brand as reference_product_name,
    case p_size % 4 when 0 then 'kg' when 1 then 'm3' when 2 then 'kWh' else 'unit' end as reference_product_unit,
    p_size as reference_product_amount
  from part join nation on p_partkey % 25 = n_nationkey""",
    "answers": _answers(""),
    "parsed": _parsed("answers"),
    "scored": _scored("parsed"),
    "answers_hard": _answers("#hard"),
    "parsed_hard": _parsed("answers_hard"),
    "scored_hard": _scored("parsed_hard"),
    "features7": """
  select p_partkey as row_id, cast(count(*) as double) as f00, sum(l_quantity) as f01,
    avg(l_extendedprice) as f02, avg(l_discount) as f03, avg(l_tax) as f04,
    max(p_retailprice) as f05, cast(max(p_size) as double) as f06
  from part join lineitem on p_partkey = l_partkey group by p_partkey""",
    "dirty": """
  select row_id, f00, f01, f02, f03, f04,
    case when md5(cast(row_id as varchar)) < '08' then 'n/a' when md5(cast(row_id as varchar)) < '0c' then ''
         when md5(cast(row_id as varchar)) < '10' then 'nan'
         else cast(cast(f05 as decimal(18, 2)) as varchar) end as f05,
    case when md5(cast(row_id as varchar)) > 'e0' then null else cast(cast(f06 as int) as varchar) end as f06
  from features7""",
    "clean": """
  select row_id, f00, f01, f02, f03, f04,
    case when isnan(try_cast(f05 as double)) then null else try_cast(f05 as double) end as f05,
    try_cast(f06 as double) as f06
  from dirty""",
    "wide": "select vec_id as row_id, label as cluster, "
    + ", ".join(f"cast(embedding[{i + 1}] as double) as {c}" for i, c in enumerate(FEATURES64))
    + " from embeddings",
    "long64": """
  select vec_id as row_id, label as cluster, unnest(range(0, 64)) as j, cast(unnest(embedding) as double) as x
  from embeddings""",
    "planted": """
  select row_id, cast(id % 4 as int) as truth,
    case when id % 101 = 100 then ((id * 3737) % 20011) / 100e0 - 100
         else 10 * (id % 2) + ((id * 7919) % 99991) / 99991e0 end as f00,
    case when id % 101 = 100 then ((id * 5353) % 20011) / 100e0 - 100
         else 5 * (id % 4 - id % 2) + ((id * 104729) % 99989) / 99989e0 end as f01
  from (select p_partkey as row_id, p_partkey as id from part)""",
    "separated": "select * from planted where row_id % 101 <> 100",
    "rubric_drafts": "select case_id, model, concat_ws(' ', draft, concat_ws(' ', list_extract(p, case_id % "
    + f"{len(RUBRIC_PHRASES)} + 1), list_extract(p, case_id % 7 + 1))) as draft from drafts cross join (select ["
    + ", ".join(f"'{p}'" for p in RUBRIC_PHRASES) + "] as p)",
    "scaled7": "select row_id, " + ", ".join(f"(f{j:02d} - avg(f{j:02d}) over ()) / stddev_pop(f{j:02d}) over () as f{j:02d}" for j in range(7))
    + " from features7",
    "drafts": "select doc_id as case_id, source as model, text as draft from documents",
    "blocks": f"""
  select case_id, model, max(cast(event_type = model as int)) as correct
  from (select concat(cast(user_id as varchar), '|', strftime(ts, '%Y-%m-%d')) as case_id, event_type from events)
  cross join (values {_TYPES}) m(model) group by case_id, model""",
    "flagged": """
  select vec_id as row_id, label as cluster, 'v' || cast(vec_id % 37 as varchar) as name,
    cast(embedding[1] as double) > 0.15 as flag_a, cast(embedding[2] as double) > 0.12 as flag_b
  from embeddings""",
}

# Which parts need which.
NEEDS = {
    "answers": ["activities"],
    "parsed": ["answers"],
    "scored": ["parsed"],
    "answers_hard": ["activities"],
    "parsed_hard": ["answers_hard"],
    "scored_hard": ["parsed_hard"],
    "separated": ["planted"],
    "rubric_drafts": ["drafts"],
    "scaled7": ["features7"],
    "dirty": ["features7"],
    "clean": ["dirty"],
}


def sql(parts: list[str], body: str, more: str = "") -> str:
    """``body`` with the common table expressions it names, and what those need."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in done:
            done.append(name)

    for p in parts:
        add(p)
    ctes = [f"{p} as ({PARTS[p]})" for p in done]
    if more:
        ctes.append(more)
    return f"with {', '.join(ctes)}\n{body}" if ctes else body
