"""The few expressions that Spark SQL and DuckDB spell differently, and the learning-domain views over the driver's tables."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    def __init__(self, sf_dir: str):
        self.t = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}

    month = staticmethod(lambda c: f"date_format({c}, 'yyyy-MM')")
    iso_week = staticmethod(lambda c: f"concat(extract(YEAROFWEEK from {c}), '-', lpad(weekofyear({c}), 2, '0'))")
    json = staticmethod(lambda c, k: f"get_json_object({c}, '$.{k}')")
    days = staticmethod(lambda a, b: f"datediff({a}, {b})")
    plus_days = staticmethod(lambda a, n: f"date_add({a}, {n})")
    array = staticmethod(lambda c, o: f"sort_array(collect_list({c}))" if o is None else f"transform(sort_array(collect_list(struct({o}, {c} as _v))), x -> x._v)")
    joined = staticmethod(lambda c: f"array_join(sort_array(collect_list(cast({c} as string))), ',')")
    item = staticmethod(lambda a, i: f"element_at({a}, cast({i} as int))")
    text = staticmethod(lambda c: f"cast({c} as string)")
    extract = staticmethod(lambda c, p, g=0: f"regexp_extract({c}, '{p}', {g})".replace("\\", "\\\\"))
    replace = staticmethod(lambda c, p, r: f"regexp_replace({c}, '{p}', '{r}')".replace("\\", "\\\\"))
    matches = staticmethod(lambda c, p: f"({c} rlike '{p}')".replace("\\", "\\\\"))
    extract_all = staticmethod(lambda c, p, g=0: f"regexp_extract_all({c}, '{p}', {g})".replace("\\", "\\\\"))
    unnest = staticmethod(lambda rel, a, name: f"{rel} lateral view explode({a}) _l as {name}")
    distinct = staticmethod(lambda a: f"array_distinct({a})")
    list_text = staticmethod(lambda a: f"array_join({a}, ',')")
    sha = staticmethod(lambda c: f"sha2({c}, 256)")
    dow_seconds = staticmethod(lambda c: f"unix_micros(cast({c} as timestamp))")
    split = staticmethod(lambda c, s: f"split({c}, '{s}')")
    array_of = staticmethod(lambda *x: f"array({', '.join(x)})")
    size = staticmethod(lambda a: f"cast(size({a}) as bigint)")
    row = staticmethod(lambda **v: "named_struct(" + ", ".join(f"'{k}', cast({x} as bigint)" for k, x in v.items()) + ")")
    row_type = staticmethod(lambda *names: "struct<" + ", ".join(f"{n}: bigint" for n in names) + ">")
    dot = staticmethod(lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, x) -> s + x)")

    @staticmethod
    def fold(items: str, order: str, start: str, step: str, kind: str) -> str:
        """Fold items (an expression) in order from start; in step, s is the state and x the item."""
        return f"aggregate(transform(sort_array(collect_list(struct({order}, {items} as _v))), y -> y._v), cast({start} as {kind}), (s, x) -> cast({step} as {kind}))"


class Duck:
    def __init__(self):
        self.t = {t: t for t in TABLES}

    month = staticmethod(lambda c: f"strftime({c}, '%Y-%m')")
    iso_week = staticmethod(lambda c: f"strftime({c}, '%G-%V')")
    json = staticmethod(lambda c, k: f"json_extract_string({c}, '$.{k}')")
    days = staticmethod(lambda a, b: f"cast(date_diff('day', cast({b} as date), cast({a} as date)) as int)")
    plus_days = staticmethod(lambda a, n: f"cast(cast({a} as date) + cast({n} as int) as date)")
    array = staticmethod(lambda c, o: f"list({c} order by {o or c})")
    joined = staticmethod(lambda c: f"string_agg(cast({c} as varchar), ',' order by cast({c} as varchar))")
    item = staticmethod(lambda a, i: f"({a})[cast({i} as int)]")
    text = staticmethod(lambda c: f"cast({c} as varchar)")
    extract = staticmethod(lambda c, p, g=0: f"regexp_extract({c}, '{p}', {g})")
    replace = staticmethod(lambda c, p, r: f"regexp_replace({c}, '{p}', '{r}', 'g')")
    matches = staticmethod(lambda c, p: f"regexp_matches({c}, '{p}')")
    extract_all = staticmethod(lambda c, p, g=0: f"regexp_extract_all({c}, '{p}', {g})")
    unnest = staticmethod(lambda rel, a, name: f"(select *, unnest({a}) as {name} from {rel})")
    distinct = staticmethod(lambda a: f"list_distinct({a})")
    list_text = staticmethod(lambda a: f"array_to_string({a}, ',')")
    sha = staticmethod(lambda c: f"sha256({c})")
    dow_seconds = staticmethod(lambda c: f"epoch_us({c})")
    split = staticmethod(lambda c, s: f"string_split({c}, '{s}')")
    array_of = staticmethod(lambda *x: f"[{', '.join(x)}]")
    size = staticmethod(lambda a: f"cast(len({a}) as bigint)")
    row = staticmethod(lambda **v: "{" + ", ".join(f"'{k}': cast({x} as bigint)" for k, x in v.items()) + "}")
    row_type = staticmethod(lambda *names: "struct(" + ", ".join(f"{n} bigint" for n in names) + ")")
    dot = staticmethod(lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: cast(z[1] as double) * cast(z[2] as double)))")

    @staticmethod
    def fold(items: str, order: str, start: str, step: str, kind: str) -> str:
        kind = kind.replace("string", "varchar")
        return f"list_reduce(list_prepend(cast({start} as {kind}), list(cast({items} as {kind}) order by {order})), lambda s, x: cast({step} as {kind}))"


#: Domain views; each may use those before it.
VIEWS = {
    "users": lambda t: f"select c_custkey as email, c_mktsegment as grade, c_nationkey as province, c_acctbal as balance from {t['customer']}",
    "provinces": lambda t: f"select n_nationkey as code, n_name as name, n_regionkey as region from {t['nation']}",
    "regions": lambda t: f"select r_regionkey as code, r_name as name from {t['region']}",
    "papers": lambda t: f"select o_orderkey as id, c_nationkey as province, cast(year(o_orderdate) as int) as yr, o_orderpriority as subject, o_orderstatus as level, o_custkey as owner, o_orderdate as created_at from {t['orders']} join {t['customer']} on o_custkey = c_custkey",
    "questions": lambda t: f"""select l_orderkey as paper_id, cast(l_linenumber as bigint) as question_number, l_returnflag as qtype, cast(l_quantity as bigint) as score, cast(1 + l_partkey % 5 as int) as difficulty, l_partkey as kp,
        cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as bigint) as seq from {t['lineitem']}""",
    "sessions": lambda t: f"""select o_orderkey as id, o_custkey as email, o_orderpriority as subject, o_orderdate as started_at, count(*) as question_count, count(case when l_returnflag = 'N' then 1 end) as correct_count,
        avg(1 + l_partkey % 5) as avg_difficulty from {t['orders']} join {t['lineitem']} on o_orderkey = l_orderkey group by o_orderkey, o_custkey, o_orderpriority, o_orderdate""",
    "kps": lambda t: f"select p_partkey as id, p_name as name, p_type as subject, cast(1 + p_size % 5 as int) as difficulty, case p_partkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as frequency from {t['part']}",
    "edges": lambda t: f"select distinct src, dst from (select p_partkey as src, cast(floor(p_partkey / 2) as bigint) as dst from {t['part']} union all select p_partkey, cast(floor(p_partkey / 3) as bigint) from {t['part']}) where src <> dst and dst > 0",
    "practice": lambda t: f"select event_id as id, user_id as email, event_id % 50 as kp, event_type as subject, event_id % 3 <> 0 as is_correct, cast(floor(value * 1000) as bigint) as time_ms, ts, event_id % 7 = 0 as hint, props from {t['events']}",
    "wrong": lambda t: "select id, email, kp, subject, ts, time_ms, props as data from practice where not is_correct",
    "checkins": lambda t: f"select distinct user_id as email, cast(ts as date) as d from {t['events']}",
    "mastery": lambda t: "select email, kp, count(*) as attempts, count(case when is_correct then 1 end) as correct, cast(count(case when is_correct then 1 end) as double) / count(*) as score, max(ts) as last_at from practice group by email, kp",
    "rag": lambda t: f"select vec_id as id, embedding, label as kp, cast(1 + vec_id % 5 as int) as difficulty from {t['embeddings']}",
}
AS_OF = "date '2024-01-31'"


def with_views(d, names: str) -> str:
    need = set(names.split())
    if need & {"wrong", "mastery"}:
        need.add("practice")
    return "with " + ",\n".join(f"{n} as ({f(d.t)})" for n, f in VIEWS.items() if n in need) + "\n"
