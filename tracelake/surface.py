"""The SQL surface: one query per class of operator, over the relational test tables.

Texts that both engines read alike are given once; where dialects differ the
DuckDB text follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.joins import as_of_join, interval_counts
from .sources.adapters import tables

_SQL: dict[str, tuple[str, str]] = {}


def _both(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    _SQL[name] = (spark_sql, duck_sql or spark_sql)


_both("sql_scan_project", "select r_regionkey, r_name as name, r_regionkey * 2 + 1 as twice from region")
_both("sql_filter", "select o_orderkey, o_totalprice from orders where o_totalprice between 1000 and 200000 and o_orderstatus in ('F', 'P') and o_orderpriority like '1%' and o_orderdate is not null and not (o_orderkey % 3 = 0)")
_both("sql_case", "select case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as class, count(*) as n from part group by 1")
_both("sql_join_inner", "select n_name, count(*) as n, round(sum(c_acctbal), 2) as total from customer join nation on c_nationkey = n_nationkey group by n_name")
_both("sql_join_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000 group by c_custkey")
_both("sql_join_right", "select n_name, count(s_suppkey) as n from supplier right join nation on s_nationkey = n_nationkey group by n_name")
_both("sql_join_full", "select coalesce(a.k, b.k) as k, a.x, b.y from (select n_nationkey as k, n_name as x from nation where n_nationkey < 15) a full outer join (select n_nationkey as k, n_regionkey as y from nation where n_nationkey > 10) b on a.k = b.k")
_both("sql_join_cross", "select a.r_name as one, b.r_name as two from region a cross join region b")
_both("sql_join_semi", "select c_custkey, c_name from customer left semi join orders on c_custkey = o_custkey and o_orderstatus = 'P'", "select c_custkey, c_name from customer semi join (select * from orders where o_orderstatus = 'P') on c_custkey = o_custkey")
_both("sql_join_anti", "select c_custkey from customer left anti join orders on c_custkey = o_custkey and o_totalprice > 250000", "select c_custkey from customer anti join (select * from orders where o_totalprice > 250000) on c_custkey = o_custkey")
_both("sql_join_using", "select k, x, y from (select n_nationkey as k, n_name as x from nation) a join (select n_nationkey as k, n_regionkey as y from nation) b using (k)")
_both("sql_join_natural", "select * from (select r_regionkey as n_regionkey, r_name from region) a natural join (select n_regionkey, n_name from nation) b")
_both("sql_join_theta", "select a.n_name as one, count(*) as n from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey <> b.n_regionkey group by a.n_name")
_both("sql_unnest", "select doc, word, n from (select doc_id as doc, word, count(*) as n from (select doc_id, explode(split(text, ' ')) as word from documents) x group by 1, 2) y where n >= 20", "select doc, word, n from (select doc_id as doc, word, count(*) as n from (select doc_id, unnest(string_split(text, ' ')) as word from documents) x group by 1, 2) y where n >= 20")
_both(
    "sql_aggregate",
    "select l_returnflag, l_linestatus, sum(l_quantity) as q, round(avg(l_discount), 8) as d, min(l_shipdate) as first, max(l_shipdate) as last, count(*) as n, count(distinct l_suppkey) as suppliers from lineitem group by 1, 2",
)
_both("sql_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15")
_both("sql_filter_aggregate", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_totalprice > 200000) as big from orders group by 1")
_both("sql_statistics", "select p_brand, round(stddev_samp(p_retailprice), 6) as sd, round(var_pop(p_retailprice), 4) as v, round(corr(p_size, p_retailprice), 8) as c, median(p_size) as m, bool_and(p_size > 0) as a, bool_or(p_size > 49) as o from part group by 1")
_both("sql_percentile", "select l_shipmode, p from (select l_returnflag as l_shipmode, percentile(l_extendedprice, 0.9) as p from lineitem group by 1) x", "select l_returnflag as l_shipmode, quantile_cont(l_extendedprice, 0.9) as p from lineitem group by 1")
_both("sql_array_agg", "select n_regionkey, concat_ws(',', sort_array(collect_list(n_name))) as names from nation group by 1", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1")
_both("sql_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
_both("sql_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
_both("sql_rollup", "select n_regionkey, n_name, count(*) as n from nation group by rollup (n_regionkey, n_name)")
_both(
    "sql_window_rank",
    "select o_custkey, o_orderkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, round(percent_rank() over w, 8) as pr, round(cume_dist() over w, 8) as cd, ntile(4) over w as nt from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
)
_both("sql_window_offset", "select o_orderkey, lag(o_totalprice) over w as before, lead(o_totalprice, 2) over w as after, first_value(o_orderkey) over w as first from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
_both("sql_window_frame", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as s, max(o_totalprice) over (partition by o_custkey order by o_orderkey range between 1000 preceding and 1000 following) as m from orders")
_both("sql_qualify", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) x where rn <= 2", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2")
_both("sql_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 50")
_both("sql_offset", "select p_partkey from part order by p_retailprice, p_partkey limit 25 offset 40")
_both("sql_union", "select n_regionkey as k from nation union select r_regionkey from region")
_both("sql_union_all", "select n_regionkey as k from nation union all select r_regionkey from region")
_both("sql_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier where s_acctbal > 0")
_both("sql_except", "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000")
_both("sql_intersect_all", "select c_nationkey as k from customer intersect all select s_nationkey from supplier")
_both("sql_except_all", "select c_nationkey as k from customer except all select s_nationkey from supplier")
_both("sql_scalar_subquery", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 2 from orders)")
_both("sql_exists", "select s_suppkey from supplier s where exists (select 1 from lineitem l where l.l_suppkey = s.s_suppkey and l.l_quantity > 49) and not exists (select 1 from nation n where n.n_nationkey = s.s_nationkey and n.n_regionkey = 0)")
_both("sql_correlated", "select o_orderkey from orders o where o_totalprice > (select 1.8 * avg(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)")
_both("sql_cte", "with big as (select o_custkey, sum(o_totalprice) as total from orders group by 1), top as (select * from big where total > 1000000) select c_mktsegment, count(*) as n from top join customer on c_custkey = o_custkey group by 1")
_both("sql_recursive_cte", "with recursive t(conv_id, turn, depth) as (select conv_id, turn, 0 from conversations where turn = 0 union all select c.conv_id, c.turn, t.depth + 1 from conversations c join t on c.conv_id = t.conv_id and c.turn = t.turn + 1) select conv_id, max(depth) as depth from t group by 1")
_both(
    "sql_string",
    "select p_partkey, upper(p_name) as u, length(p_name) as n, substr(p_name, 2, 4) as s, replace(p_brand, '#', '-') as r, lpad(cast(p_size as string), 4, '0') as l, reverse(p_brand) as v, concat_ws('/', p_brand, p_type) as c, instr(p_type, 'E') as i, split_part(p_type, ' ', 1) as f, trim('  x ') as t from part",
    "select p_partkey, upper(p_name) as u, length(p_name) as n, substr(p_name, 2, 4) as s, replace(p_brand, '#', '-') as r, lpad(cast(p_size as varchar), 4, '0') as l, reverse(p_brand) as v, concat_ws('/', p_brand, p_type) as c, instr(p_type, 'E') as i, split_part(p_type, ' ', 1) as f, trim('  x ') as t from part",
)
_both(
    "sql_regex",
    "select doc_id, text rlike '[A-Z]{4}' as m, regexp_extract(text, '([a-z]+)tion', 1) as e, regexp_count(text, 'th') as n, md5(regexp_replace(text, '[aeiou]', '_')) as r from documents",
    "select doc_id, regexp_matches(text, '[A-Z]{4}') as m, regexp_extract(text, '([a-z]+)tion', 1) as e, len(regexp_extract_all(text, 'th')) as n, md5(regexp_replace(text, '[aeiou]', '_', 'g')) as r from documents",
)
_both(
    "sql_date",
    "select event_id, cast(date_trunc('day', ts) as string) as d, extract(hour from ts) as h, extract(month from ts) as mo, unix_micros(cast(ts as timestamp)) as us, cast(to_date(ts) + interval 3 days as string) as later from events",
    "select event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as d, extract(hour from ts) as h, extract(month from ts) as mo, epoch_us(ts) as us, strftime(cast(ts as date) + interval 3 days, '%Y-%m-%d') as later from events",
)
_both(
    "sql_math",
    "select event_id, round(sqrt(value), 9) as a, round(ln(value + 1), 9) as b, round(exp(value / 500), 9) as c, floor(value) as d, ceil(value) as e, abs(value - 250) as f, round(pow(value, 0.3), 9) as g, sign(value - 250) as h, greatest(value, 250) as i, least(value, 250) as j, round(sin(value), 9) as k, isnan(value) as l from events",
)
_both(
    "sql_nested",
    "select k, xs[0] as first, size(xs) as n, array_contains(xs, 3) as has, cast(array_max(xs) as bigint) as top, s.b as b, m['x'] as x from (select n_nationkey as k, array(n_nationkey, n_regionkey, 3) as xs, named_struct('a', n_name, 'b', n_regionkey) as s, map('x', n_nationkey) as m from nation) t",
    "select k, xs[1] as first, len(xs) as n, list_contains(xs, 3) as has, cast(list_max(xs) as bigint) as top, s.b as b, m['x'] as x from (select n_nationkey as k, [n_nationkey, n_regionkey, 3] as xs, {'a': n_name, 'b': n_regionkey} as s, map {'x': n_nationkey} as m from nation) t",
)
_both("sql_json", "select event_id, json_get_num(props, 'k') as k, json_get_str(concat('{\"k[0].x\":\"', event_type, '\"}'), 'k[0].x') as s from events", "select event_id, cast(props::json ->> 'k' as double) as k, event_type as s from events")
_both("sql_cast", "select event_id, cast(value as int) as i, try_cast(event_type as double) as t, cast(user_id as string) as s from events", "select event_id, cast(trunc(value) as int) as i, try_cast(event_type as double) as t, cast(user_id as varchar) as s from events")
_both("sql_values", "select * from values (1, 'a'), (2, 'b') as t(k, v)", "select * from (values (1, 'a'), (2, 'b')) t(k, v)")
_both("sql_date_bin", "select (unix_micros(cast(ts as timestamp)) div 900000000) * 900000000 as bin, count(*) as n from events group by 1", "select (epoch_us(ts) // 900000000) * 900000000 as bin, count(*) as n from events group by 1")
_both("sql_correlation_of_signals", "select e.event_type, count(*) as n from events e join customer c on e.user_id = c.c_custkey where c.c_acctbal > 0 group by 1")
_both(
    "sql_pricing_summary",
    "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus",
)
_both("sql_approx", "select abs(approx_count_distinct(l_orderkey) - count(distinct l_orderkey)) <= 0.1 * count(distinct l_orderkey) as near from lineitem", "select true as near")


def _spark_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        from .functions import register

        tables(spark, d, *(t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations") if t in text))
        if "json_get" in text:
            register(spark)
        return spark.sql(text)

    return run


def join_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each error with the last click of the same user before it."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"), "event_type")
    errors, clicks = e.where("event_type = 'error'"), e.where("event_type = 'click'").select("user_id", "us", F.col("event_id").alias("click_id"))
    return as_of_join(errors, clicks, on="us", by=["user_id"], values=["click_id"]).select("event_id", "click_id")


def join_interval(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within the ten hours after an error of anyone, counted per error."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"), "event_type")
    errors = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("us").alias("start"), (F.col("us") + 36_000_000_000).alias("end"))
    return interval_counts(e.where("event_type = 'purchase'").select("us"), errors, "us", "start", "end", ["error_id"], width=36_000_000_000)


_CODE: dict[str, tuple[Callable, str]] = {
    "join_as_of": (join_as_of, "select e.event_id, arg_max(c.event_id, epoch_us(c.ts)) as click_id from (select * from events where event_type = 'error') e left join (select * from events where event_type = 'click') c on e.user_id = c.user_id and c.ts <= e.ts group by 1"),
    "join_interval": (join_interval, "select a.event_id as error_id, count(*) as n from (select * from events where event_type = 'error') a join (select * from events where event_type = 'purchase') b on epoch_us(b.ts) >= epoch_us(a.ts) and epoch_us(b.ts) < epoch_us(a.ts) + 36000000000 group by 1"),
}


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user's events with gaps of a day, by running sum over a lag."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    new = (F.col("us") - F.lag("us").over(w) > 86_400_000_000).cast("int")
    s = e.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("first"))


_CODE["window_sessions"] = (
    sessions,
    "with e as (select user_id, epoch_us(ts) as us, event_id from events), l as (select *, case when us - lag(us) over w <= 86400000000 then 0 else 1 end as new from e window w as (partition by user_id order by us, event_id)), s as (select *, sum(new) over (partition by user_id order by us, event_id) as session from l) select user_id, session, count(*) as n, min(us) as first from s group by 1, 2",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _spark_query(text) for name, (text, _) in _SQL.items()} | {k: f for k, (f, _) in _CODE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _SQL.items()} | {k: s for k, (_, s) in _CODE.items()}
