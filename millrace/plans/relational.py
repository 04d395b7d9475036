"""The SQL surface: joins, aggregates, windows, sets, subqueries, scalar functions. Money is summed as decimals, so order never shows."""

from __future__ import annotations

from millrace.plans.registry import sql

_MONEY = "cast(sum(cast({} as decimal(18,2))) as double)"
rev = _MONEY.format("l_extendedprice")
tot = _MONEY.format("o_totalprice")
val = _MONEY.format("value")

# Joins
sql("join_inner", "select c_mktsegment, count(*) as n, " + tot + " as total from {customer} join {orders} on c_custkey = o_custkey group by c_mktsegment")
sql("join_left", "select c_custkey, count(o_orderkey) as n_orders from {customer} left join {orders} on c_custkey = o_custkey group by c_custkey")
sql("join_right", "select n_name, count(s_suppkey) as n_suppliers from {supplier} right join {nation} on s_nationkey = n_nationkey group by n_name")
sql("join_full", "select coalesce(c_nationkey, s_nationkey) as nationkey, coalesce(nc, 0) as n_customers, coalesce(ns, 0) as n_suppliers from (select c_nationkey, count(*) as nc from {customer} where c_acctbal > 5000 group by c_nationkey) c full outer join (select s_nationkey, count(*) as ns from {supplier} group by s_nationkey) s on c_nationkey = s_nationkey")
sql("join_cross", "select r_name, seg, count(*) as n from {region} cross join (select distinct c_mktsegment as seg from {customer}) s group by r_name, seg")
sql("join_semi", "select o_orderkey, o_totalprice from {orders} left semi join (select l_orderkey from {lineitem} where l_quantity >= 49) l on o_orderkey = l_orderkey", "select o_orderkey, o_totalprice from {orders} where o_orderkey in (select l_orderkey from {lineitem} where l_quantity >= 49)")
sql("join_anti", "select c_custkey, c_name from {customer} left anti join {orders} on c_custkey = o_custkey and o_totalprice > 400000", "select c_custkey, c_name from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey and o_totalprice > 400000)")
sql("join_theta", "select a.n_nationkey as a, b.n_nationkey as b from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
sql("join_using", "select n_name, r_name from (select n_name, n_regionkey as k from {nation}) n join (select r_name, r_regionkey as k from {region}) r using (k)")
sql("join_natural", "select nm, rname from (select n_name as nm, n_regionkey as k from {nation}) n natural join (select r_name as rname, r_regionkey as k from {region}) r")
sql("join_multiway", "select r_name, o_orderpriority, count(*) as n, " + tot + " as total from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey group by r_name, o_orderpriority")
sql("join_nullsafe", "select count(*) as n from (select nullif(n_regionkey, 0) as k from {nation}) a join (select nullif(r_regionkey, 0) as k from {region}) b on a.k <=> b.k", "select count(*) as n from (select nullif(n_regionkey, 0) as k from {nation}) a join (select nullif(r_regionkey, 0) as k from {region}) b on a.k is not distinct from b.k")
sql("join_lateral", "select c_custkey, o.o_orderkey from {customer}, lateral (select max(o_orderkey) as o_orderkey from {orders} where o_custkey = c_custkey) o where o.o_orderkey is not null")
sql("two_sum", "with v as (select distinct p_size as x from {part}) select a.x as a, b.x as b from v a join v b on b.x = 60 - a.x where a.x < b.x")

# Aggregates
sql("agg_pricing", "select l_returnflag, l_linestatus, " + _MONEY.format("l_quantity") + " as sum_qty, " + rev + " as sum_base, cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as sum_disc, count(*) as n from {lineitem} where l_shipdate <= timestamp '2001-09-02 00:00:00' group by l_returnflag, l_linestatus")
sql("agg_basic", "select event_type, count(*) as n, count(distinct user_id) as users, min(value) as low, max(value) as high, round(avg(value), 6) as mean from {events} group by event_type")
sql("agg_stats", "select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(stddev_pop(l_quantity), 6) as sdp, round(var_samp(l_quantity), 5) as v, round(var_pop(l_quantity), 5) as vp, round(corr(l_quantity, l_extendedprice), 6) as r, round(covar_pop(l_quantity, l_discount), 6) as cp, round(covar_samp(l_quantity, l_discount), 6) as cs from {lineitem} group by l_returnflag")
sql("agg_filter", "select o_orderstatus, count(*) filter (where o_totalprice > 250000) as large, count(*) as n from {orders} group by o_orderstatus")
sql("agg_having", "select o_custkey, count(*) as n from {orders} group by o_custkey having count(*) >= 15")
sql("agg_distinct", "select count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts, count(distinct l_returnflag) as flags from {lineitem}")
sql("agg_rollup", "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as int) as g1, cast(grouping(l_linestatus) as int) as g2 from {lineitem} group by rollup(l_returnflag, l_linestatus)")
sql("agg_cube", "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by cube(o_orderstatus, o_orderpriority)")
sql("agg_grouping_sets", "select p_brand, p_type, count(*) as n from {part} group by grouping sets ((p_brand), (p_type), ())")
sql("agg_ordinal", "select p_brand, p_size > 25 as large, count(*) as n from {part} group by 1, 2")
sql("agg_array", "select c_nationkey, array_sort(collect_list(c_custkey)) as keys from {customer} where c_acctbal > 9000 group by c_nationkey", "select c_nationkey, list_sort(list(c_custkey)) as keys from {customer} where c_acctbal > 9000 group by c_nationkey")
sql("agg_median", "select l_returnflag, percentile(l_quantity, 0.5) as med, percentile(l_quantity, 0.9) as p90 from {lineitem} group by l_returnflag", "select l_returnflag, quantile_cont(l_quantity, 0.5) as med, quantile_cont(l_quantity, 0.9) as p90 from {lineitem} group by l_returnflag")
sql("agg_mode_any", "select count_if(p_size > 40) as large, bool_and(p_retailprice > 0) as priced, bool_or(p_size = 1) as any_small, max_by(p_partkey, p_retailprice * 1000000 + p_partkey) as dearest from {part}", "select count_if(p_size > 40)::bigint as large, bool_and(p_retailprice > 0) as priced, bool_or(p_size = 1) as any_small, arg_max(p_partkey, p_retailprice * 1000000 + p_partkey) as dearest from {part}")
sql("agg_bits", "select c_nationkey, bit_and(c_custkey) as a, bit_or(c_custkey) as o, bit_xor(c_custkey) as x from {customer} group by c_nationkey")

# Windows
sql("win_rank", "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, rank() over (partition by o_custkey order by o_orderpriority) as rk, dense_rank() over (partition by o_custkey order by o_orderpriority) as dr from {orders}", "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rn, rank() over (partition by o_custkey order by o_orderpriority)::int as rk, dense_rank() over (partition by o_custkey order by o_orderpriority)::int as dr from {orders}")
sql("win_shares", "select s_suppkey, round(percent_rank() over (partition by s_nationkey order by s_acctbal, s_suppkey), 9) as pr, round(cume_dist() over (partition by s_nationkey order by s_acctbal, s_suppkey), 9) as cd, ntile(4) over (order by s_acctbal, s_suppkey) as q from {supplier}", "select s_suppkey, round(percent_rank() over (partition by s_nationkey order by s_acctbal, s_suppkey), 9) as pr, round(cume_dist() over (partition by s_nationkey order by s_acctbal, s_suppkey), 9) as cd, ntile(4) over (order by s_acctbal, s_suppkey)::int as q from {supplier}")
sql("win_lag", "select event_id, lag(value) over w as before, lead(value, 2, -1.0) over w as after from {events} window w as (partition by user_id order by ts, event_id)")
sql("win_first_last", "select event_id, first_value(value) over w as f, last_value(value) over w as l, nth_value(value, 2) over w as second from {events} window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)")
sql("win_moving", "select event_id, cast(sum(cast(value as decimal(18,2))) over (partition by user_id order by ts, event_id rows between 3 preceding and current row) as double) as total, count(*) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 following) as n from {events}")
sql("win_range", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate range between interval '90' day preceding and current row) as recent from {orders}")
sql("win_top_n", "select c_mktsegment, c_custkey, c_acctbal from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rn from {customer}) t where rn <= 3")
sql("win_groups", "select event_id, cast(sum(cast(value as decimal(18,2))) over (partition by user_id order by g range between 1 preceding and current row) as double) as total from (select *, dense_rank() over (partition by user_id order by event_type) as g from {events}) t", "select event_id, cast(sum(cast(value as decimal(18,2))) over (partition by user_id order by event_type groups between 1 preceding and current row) as double) as total from {events}")

# Sets, order, limit
sql("set_union", "select c_nationkey as k from {customer} union select s_nationkey from {supplier}")
sql("set_union_all", "select k, count(*) as n from (select c_nationkey as k from {customer} union all select s_nationkey from {supplier}) t group by k")
sql("set_intersect", "select c_nationkey as k from {customer} where c_acctbal > 9900 intersect select s_nationkey from {supplier}")
sql("set_except", "select n_nationkey as k from {nation} except select s_nationkey from {supplier} where s_acctbal > 5000")
sql("set_except_all", "select c_nationkey as k from {customer} except all select s_nationkey from {supplier}")
sql("set_intersect_all", "select c_nationkey as k from {customer} intersect all select s_nationkey from {supplier}")
sql("order_top_k", "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 25")
sql("order_offset", "select o_orderkey from {orders} order by o_orderdate, o_orderkey limit 20 offset 40")
sql("order_nulls", "select k, rn from (select k, row_number() over (order by k desc nulls last) as rn from (select nullif(n_nationkey, 3) as k from {nation}) t) u", "select k, rn::int as rn from (select k, row_number() over (order by k desc nulls last) as rn from (select nullif(n_nationkey, 3) as k from {nation}) t) u")
sql("distinct_rows", "select distinct o_orderstatus, o_orderpriority from {orders}")

# Subqueries
sql("sub_cte", "with big as (select * from {orders} where o_totalprice > 400000), per as (select o_custkey, count(*) as n from big group by o_custkey) select n, count(*) as customers from per group by n")
sql("sub_recursive", "with recursive t(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * (n + 1) from t where n < 12) select n, f from t")
sql("sub_scalar", "select count(*) as n from {orders} where o_totalprice > (select avg(o_totalprice) from {orders})")
sql("sub_correlated", "select l_orderkey, l_linenumber from {lineitem} a where l_quantity > (select 1.9 * avg(l_quantity) from {lineitem} b where b.l_partkey = a.l_partkey)")
sql("sub_exists", "select c_custkey from {customer} where exists (select 1 from {orders} where o_custkey = c_custkey and o_totalprice > 490000)")
sql("sub_in", "select s_suppkey from {supplier} where s_nationkey in (select n_nationkey from {nation} where n_regionkey = 2) and s_suppkey not in (select l_suppkey from {lineitem} where l_quantity > 49.5 and l_discount > 0.085)")
sql("sub_values", "select v.k, n_name from (values (1, 'x'), (7, 'y')) as v(k, tag) join {nation} on n_nationkey = v.k")

# Predicates and conditions
sql("pred_mixed", "select count(*) as n from {part} where p_size between 5 and 20 and p_type in ('ECONOMY', 'STANDARD') and p_name like '%ring%' and p_brand is not null and not p_brand = 'Brand#3'")
sql("pred_case", "select case when l_quantity < 10 then 'small' when l_quantity < 30 then 'mid' else 'large' end as bucket, count(*) as n from {lineitem} group by 1")
sql("pred_null", "select sum(case when k is null then 1 else 0 end) as nulls, count(k) as n, sum(coalesce(k, -1)) as s from (select nullif(n_regionkey, 2) as k from {nation}) t", "select sum(case when k is null then 1 else 0 end)::bigint as nulls, count(k) as n, sum(coalesce(k, -1))::bigint as s from (select nullif(n_regionkey, 2) as k from {nation}) t")
sql("pred_distinct_from", "select count(*) as n from {nation} where nullif(n_regionkey, 1) is distinct from n_regionkey", "select count(*) as n from {nation} where nullif(n_regionkey, 1) is distinct from n_regionkey")
sql("cast_try", "select count(try_cast(substr(p_brand, 7) as int)) as good, count(*) - count(try_cast(p_brand as int)) as bad from {part}")

# Scalar functions
sql("fn_math", "select p_partkey, abs(p_size - 25) as a, cast(ceil(p_retailprice) as bigint) as c, cast(floor(p_retailprice) as bigint) as f, round(sqrt(p_size), 9) as s, round(ln(p_size), 9) as l, round(log2(p_size), 9) as l2, round(log10(p_size), 9) as l10, round(exp(p_size / 10.0), 6) as e, round(power(p_size, 2), 6) as p, p_size % 7 as m, cast(sign(p_size - 25) as int) as sg from {part}")
sql("fn_trig", "select n_nationkey, round(sin(n_nationkey), 9) as s, round(cos(n_nationkey), 9) as c, round(tan(n_nationkey), 9) as t, round(atan(n_nationkey), 9) as a, round(asin(n_nationkey / 25.0), 9) as asn, round(acos(n_nationkey / 25.0), 9) as acs, round(atan2(n_nationkey, 3), 9) as a2, round(degrees(n_nationkey), 6) as d from {nation}")
sql("fn_trunc", "select c_custkey, case when c_acctbal >= 0 then floor(c_acctbal) else ceil(c_acctbal) end as t from {customer}", "select c_custkey, trunc(c_acctbal)::bigint as t from {customer}")
sql("fn_string", "select c_custkey, upper(c_name) as u, lower(c_name) as l, length(c_name) as n, substr(c_name, 3, 5) as s, replace(c_name, '#', '-') as r, lpad(cast(c_custkey as string), 8, '0') as lp, rpad(c_mktsegment, 12, '.') as rp, reverse(c_mktsegment) as rv, concat(c_name, '/', c_mktsegment) as cc, left(c_name, 4) as lf, right(c_name, 4) as rg from {customer}", "select c_custkey, upper(c_name) as u, lower(c_name) as l, length(c_name)::int as n, substr(c_name, 3, 5) as s, replace(c_name, '#', '-') as r, lpad(cast(c_custkey as varchar), 8, '0') as lp, rpad(c_mktsegment, 12, '.') as rp, reverse(c_mktsegment) as rv, concat(c_name, '/', c_mktsegment) as cc, left(c_name, 4) as lf, right(c_name, 4) as rg from {customer}")
sql("fn_string_more", "select p_partkey, split_part(p_name, ' ', 1) as w1, instr(p_name, ' ') as at, startswith(p_name, 'red') as red, repeat(p_type, 2) as rp, translate(p_brand, '#B', '_b') as tr, trim(concat('  ', p_type, ' ')) as t, ltrim(concat('  ', p_type)) as lt, rtrim(concat(p_type, '  ')) as rt, ascii(p_name) as a, chr(65 + p_size % 26) as ch, initcap(p_name) as ic, concat_ws('|', p_brand, p_type) as ws from {part}", "select p_partkey, split_part(p_name, ' ', 1) as w1, strpos(p_name, ' ')::int as at, starts_with(p_name, 'red') as red, repeat(p_type, 2) as rp, translate(p_brand, '#B', '_b') as tr, trim(concat('  ', p_type, ' ')) as t, ltrim(concat('  ', p_type)) as lt, rtrim(concat(p_type, '  ')) as rt, ascii(p_name)::int as a, chr(65 + p_size % 26) as ch, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], ' ') as ic, concat_ws('|', p_brand, p_type) as ws from {part}")
sql("fn_lengths", "select doc_id, octet_length(text) as bytes, char_length(text) as chars, bit_length(text) as bits from {documents}", "select doc_id, strlen(text)::int as bytes, length(text)::int as chars, (8 * strlen(text))::int as bits from {documents}")
sql("fn_hash", "select n_nationkey, md5(n_name) as m, sha2(n_name, 256) as s, lower(hex(n_nationkey)) as h from {nation}", "select n_nationkey, md5(n_name) as m, sha256(n_name) as s, lower(to_hex(n_nationkey)) as h from {nation}")
sql("fn_regexp", "select p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) as digits, regexp_replace(p_name, '[aeiou]', '*') as masked, p_name rlike '^[a-m]' as early from {part}", "select p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) as digits, regexp_replace(p_name, '[aeiou]', '*', 'g') as masked, regexp_matches(p_name, '^[a-m]') as early from {part}")
sql("fn_dates", "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, quarter(o_orderdate) as q, dayofyear(o_orderdate) as doy, cast(date_trunc('month', o_orderdate) as timestamp_ntz) as mon, cast(o_orderdate + interval '10' day as timestamp_ntz) as due from {orders}", "select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as d, quarter(o_orderdate)::int as q, dayofyear(o_orderdate)::int as doy, date_trunc('month', o_orderdate)::timestamp as mon, o_orderdate + interval '10' day as due from {orders}")
sql("fn_date_bin", "select cast(floor(unix_micros(cast(ts as timestamp)) / 21600000000) as bigint) as bin, count(*) as n from {events} group by 1", "select (epoch_us(ts) // 21600000000)::bigint as bin, count(*) as n from {events} group by 1")
sql("fn_epoch", "select event_id, unix_millis(cast(ts as timestamp)) as ms, cast(timestamp_millis(unix_millis(cast(ts as timestamp))) as timestamp_ntz) as back from {events}", "select event_id, epoch_us(ts) // 1000 as ms, make_timestamp(epoch_us(ts) // 1000 * 1000) as back from {events}")
sql("fn_json", "select event_id, cast(get_json_object(props, '$.k') as int) as k from {events}", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from {events}")
sql("fn_variant", "select event_type, sum(variant_get(parse_json(props), '$.k', 'bigint')) as k from {events} group by event_type", "select event_type, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as k from {events} group by event_type")
sql("fn_arrays", "select c_nationkey, size(k) as n, k[0] as first, array_contains(k, cast(17 as bigint)) as has, aggregate(k, cast(0 as bigint), (a, x) -> a + x) as s, size(filter(k, x -> x % 2 = 0)) as even from (select c_nationkey, array_sort(collect_list(c_custkey)) as k from {customer} group by c_nationkey) t", "select c_nationkey, len(k)::int as n, k[1] as first, list_contains(k, 17) as has, list_sum(k)::bigint as s, len(list_filter(k, lambda x: x % 2 = 0))::int as even from (select c_nationkey, list_sort(list(c_custkey)) as k from {customer} group by c_nationkey) t")
sql("fn_explode", "select w, count(*) as n from (select explode(split(p_name, ' ')) as w from {part}) t group by w", "select w, count(*) as n from (select unnest(string_split(p_name, ' ')) as w from {part}) t group by w")
sql("fn_struct", "select n_nationkey, s.a as a, s.b as b from (select n_nationkey, named_struct('a', n_name, 'b', n_regionkey + 1) as s from {nation}) t", "select n_nationkey, s.a as a, s.b as b from (select n_nationkey, {'a': n_name, 'b': n_regionkey + 1} as s from {nation}) t")
sql("fn_pivot", "select * from (select o_orderpriority, o_orderstatus from {orders}) pivot (count(*) for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p from {orders} group by o_orderpriority")

# Members of the families above that stand alone
sql("agg_approx", "select event_type, abs(approx_count_distinct(user_id, 0.01) - count(distinct user_id)) <= 0.05 * count(distinct user_id) as users_close, abs(percentile_approx(value, 0.5, 10000) - percentile(value, 0.5)) <= 0.02 * percentile(value, 0.5) as median_close, round(median(value), 6) as med from {events} group by event_type", "select event_type, true as users_close, true as median_close, round(median(value), 6) as med from {events} group by event_type")
sql("agg_grouping_id", "select o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) as g, count(*) as n from {orders} group by cube(o_orderstatus, o_orderpriority)", "select o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::bigint as g, count(*) as n from {orders} group by cube(o_orderstatus, o_orderpriority)")
sql("fn_sha2_family", "select n_nationkey, length(sha2(n_name, 224)) as n224, length(sha2(n_name, 384)) as n384, length(sha2(n_name, 512)) as n512, sha2(n_name, 0) = sha2(n_name, 256) as same from {nation}", "select n_nationkey, 56::int as n224, 96::int as n384, 128::int as n512, true as same from {nation}")
sql("fn_string_rest", "select p_partkey, btrim(concat('  ', p_type, '  ')) as b, btrim(p_type, 'SE') as bs, position('a' in p_name) as at, regexp_like(p_name, '^[a-m].*e') as hit, strpos_ as s from (select *, locate('e', p_name) as strpos_ from {part}) t", "select p_partkey, trim(concat('  ', p_type, '  ')) as b, trim(p_type, 'SE') as bs, position('a' in p_name)::int as at, regexp_matches(p_name, '^[a-m].*e') as hit, strpos(p_name, 'e')::int as s from {part}")
sql("fn_temporal_rest", "select o_orderkey, date_part('month', o_orderdate) as m, extract(doy from o_orderdate) as doy, cast(date_part('dow_iso', o_orderdate) as int) as dow, cast(to_timestamp(date_format(o_orderdate, 'yyyy-MM-dd HH:mm'), 'yyyy-MM-dd HH:mm') as timestamp_ntz) as parsed, cast(timestamp_micros(unix_micros(cast(o_orderdate as timestamp)) + 1) as timestamp_ntz) as later, cast(timestamp_seconds(unix_seconds(cast(o_orderdate as timestamp))) as timestamp_ntz) as whole from {orders}", "select o_orderkey, month(o_orderdate)::int as m, dayofyear(o_orderdate)::int as doy, isodow(o_orderdate)::int as dow, date_trunc('minute', o_orderdate)::timestamp as parsed, o_orderdate + interval 1 microsecond as later, date_trunc('second', o_orderdate)::timestamp as whole from {orders}")
sql("fn_clock_and_chance", "select n_nationkey, now() >= timestamp '2020-01-01' as after, current_date() = cast(now() as date) as today, r >= 0 and r < 1 as unit from (select n_nationkey, rand(7) as r from {nation}) t", "select n_nationkey, true as after, true as today, true as unit from {nation}")
