"""Queries of the driver contract: each operator as engine SQL, DataFrame operator or Spark SQL, with DuckDB SQL beside it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.filters import EthFilter, LogFilter
from .operators.transfers import TransferFilter, net_flow, notifications
from .operators.windows import groups_frame
from .sources.schema import APPROVAL, DEPOSIT, TRANSFER, from_events, from_receipts, public_view
from .sources.store import LogStore, scratch

#: A block among the first, where the stores of the queries below begin a second batch.
SPLIT = 18000100
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(read(spark, sf_dir, "events"))


def _wallet(n: int) -> str:
    return "0x" + hashlib.sha256(f"w:{n}".encode()).hexdigest()[:40]


#: The same relation for DuckDB.
LOGS = f"""SELECT block_number, block_hash, timestamp, tx_hash, tx_index, log_index, address, topic0, topic1, topic2, topic3,
 list_filter([topic0, topic1, topic2, topic3], lambda x: x IS NOT NULL) AS topics, data, CAST((length(data) - 2) // 2 AS BIGINT) AS data_len, source FROM (SELECT
 18000000 + event_id // 4 AS block_number, '0x' || sha256(concat('block:', CAST(event_id // 4 AS VARCHAR))) AS block_hash, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
 '0x' || sha256(concat('tx:', CAST(event_id // 2 AS VARCHAR))) AS tx_hash, (event_id % 4) // 2 AS tx_index, event_id % 4 AS log_index,
 '0x' || substr(sha256(concat('token:', CAST(user_id % 7 AS VARCHAR))), 1, 40) AS address,
 CASE event_type WHEN 'purchase' THEN '{TRANSFER}' WHEN 'click' THEN '{APPROVAL}' WHEN 'view' THEN '{DEPOSIT}' WHEN 'signup' THEN '0x7fcf532c15f0a6db0bd6d0e038bea71d30d808c7d98cb3bf7268a95bf5081b65' END AS topic0,
 CASE WHEN event_type <> 'error' THEN '0x' || lpad(substr(sha256(concat('w:', CAST(user_id AS VARCHAR))), 1, 40), 64, '0') END AS topic1,
 CASE WHEN event_type IN ('purchase', 'click') THEN '0x' || lpad(substr(sha256(concat('w:', CAST((user_id * 7 + event_id) % 150 AS VARCHAR))), 1, 40), 64, '0') END AS topic2,
 CASE WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN '0x' || lpad(lower(hex(event_id)), 64, '0') END AS topic3,
 CASE WHEN event_type = 'error' THEN '0x' || repeat('ab', CAST(event_id % 4 AS INT)) WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN '0x'
  ELSE '0x' || lpad(lower(hex(event_id)), 48, '0') || lpad(lower(hex(CAST(floor(value * 100) AS BIGINT))), 16, '0') END AS data,
 CASE WHEN event_id % 10 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS source FROM events) t"""
WALLET = _wallet(3)
AMOUNT = "(CASE WHEN data = '0x' THEN 0::HUGEINT ELSE ('0x' || substr(data, greatest(3, length(data) - 23)))::HUGEINT END)"

#: name -> (engine SQL, DuckDB SQL over `logs` or None where the text is the same)
ENGINE: dict[str, tuple[str, str | None]] = {
    "logs_scan": ("SELECT FROM logs", "SELECT * FROM logs"),
    "logs_project": ("SELECT block_number AS b, address, data_len FROM logs", None),
    "logs_exclude": ("SELECT * EXCLUDE (data, topics) FROM logs", None),
    "logs_from_first": ("FROM logs SELECT block_number, log_index, topic0", "SELECT block_number, log_index, topic0 FROM logs"),
    "logs_topics": ("SELECT block_number, log_index, CARDINALITY(topics) AS n, topics[1] AS first, topics[2] AS second FROM logs", "SELECT block_number, log_index, len(topics)::INT AS n, topics[1] AS first, topics[2] AS second FROM logs"),
    "logs_filter_event": ("SELECT block_number, log_index, data FROM logs WHERE topic0 = event'Transfer(address,address,uint256)' AND block_number >= 18000010", f"SELECT block_number, log_index, data FROM logs WHERE topic0 = '{TRANSFER}' AND block_number >= 18000010"),
    "logs_filter_or": (f"SELECT block_number, log_index FROM logs WHERE (topic0 = '{TRANSFER}' OR topic0 = '{APPROVAL}') AND NOT (data_len = 0 OR source = 1)", None),
    "logs_filter_data": ("SELECT block_number, log_index, data FROM logs WHERE data >= '0x0000000000000000000000000000000000000000000000000100' AND data <> '0xab'", None),
    "logs_filter_null": ("SELECT topic0 IS NULL AS anonymous, topic3 IS NOT NULL AS indexed, COUNT(*) AS n FROM logs GROUP BY topic0 IS NULL, topic3 IS NOT NULL", None),
    "logs_not_in_nulls": (f"SELECT COUNT(*) AS n FROM logs WHERE topic0 NOT IN ('{TRANSFER}') AND topic1 IS DISTINCT FROM topic2", None),
    "logs_like_case": ("SELECT CASE WHEN address LIKE '0x1%' THEN 'one' WHEN address LIKE '0xe%' THEN 'e' ELSE 'other' END AS kind, COUNT(*) AS n FROM logs GROUP BY 1", None),
    "logs_latest": ("SELECT block_number, log_index FROM logs WHERE block_number > LATEST - 5", "SELECT block_number, log_index FROM logs WHERE block_number > (SELECT max(block_number) FROM logs) - 5"),
    "logs_count": ("SELECT COUNT(*) AS count FROM logs WHERE address IN (SELECT address FROM logs WHERE block_number = 18000000)", None),
    "logs_count_source": ("SELECT source, COUNT(1) AS n FROM logs GROUP BY source ORDER BY source", None),
    "logs_top": ("SELECT block_number, tx_index, log_index, data_len FROM logs ORDER BY block_number DESC, tx_index DESC, log_index DESC LIMIT 1000", None),
    "logs_limit_offset": ("SELECT block_number, log_index FROM logs ORDER BY block_number, log_index LIMIT 10, 20", "SELECT block_number, log_index FROM logs ORDER BY block_number, log_index LIMIT 20 OFFSET 10"),
    "logs_nulls_max": ("SELECT block_number, log_index, RANK() OVER (PARTITION BY address ORDER BY topic3) AS up, RANK() OVER (PARTITION BY address ORDER BY topic3 DESC) AS down FROM logs", "SELECT block_number, log_index, (RANK() OVER (PARTITION BY address ORDER BY topic3 ASC NULLS LAST))::INT AS up, (RANK() OVER (PARTITION BY address ORDER BY topic3 DESC NULLS FIRST))::INT AS down FROM logs"),
    "sum_data": ("SELECT SUM(data) AS total FROM logs", f"SELECT CAST(SUM({AMOUNT}) AS VARCHAR) AS total FROM logs"),
    "sum_data_grouped": ("SELECT address, SUM(data) AS total FROM logs WHERE topic0 = event'Transfer(address,address,uint256)' GROUP BY address HAVING total > 0 ORDER BY total DESC", f"SELECT address, CAST(SUM({AMOUNT}) AS VARCHAR) AS total FROM logs WHERE topic0 = '{TRANSFER}' GROUP BY address HAVING SUM({AMOUNT}) > 0"),
    "sum_data_case": ("SELECT topic0, SUM(CASE WHEN source = 0 THEN data ELSE -1 END) - SUM(CASE WHEN source = 1 THEN data END) AS delta, SUM(5) AS fives FROM logs GROUP BY topic0", f"SELECT topic0, CAST(SUM(CASE WHEN source = 0 THEN {AMOUNT} ELSE -1 END) - SUM(CASE WHEN source = 1 THEN {AMOUNT} END) AS VARCHAR) AS delta, CAST(SUM(5) AS VARCHAR) AS fives FROM logs GROUP BY topic0"),
    "logs_self_join": ("SELECT a.block_number, a.log_index AS i, b.log_index AS j FROM logs a JOIN logs b ON a.tx_hash = b.tx_hash AND a.log_index < b.log_index", None),
    "logs_comma_join": ("SELECT a.address, COUNT(*) AS n FROM logs a, logs b WHERE a.block_hash = b.block_hash AND a.topic1 = b.topic2 GROUP BY a.address", None),
    "logs_cte": ("WITH t AS (SELECT address, topic2 AS w, data_len FROM logs WHERE topic2 IS NOT NULL), u AS (SELECT w, COUNT(*) AS n FROM t GROUP BY w) SELECT t.address, MAX(u.n) AS most FROM t JOIN u ON t.w = u.w GROUP BY t.address", None),
    "logs_shadow": ("WITH logs AS (SELECT block_number FROM logs WHERE source = 1) SELECT COUNT(*) AS n, MIN(block_number) AS low FROM logs", "SELECT COUNT(*) AS n, MIN(block_number) AS low FROM logs WHERE source = 1"),
    "logs_recursive": ("WITH RECURSIVE c AS (SELECT 0 AS n, MIN(block_number) AS b FROM logs UNION ALL SELECT c.n + 1, logs.block_number + 1 FROM c JOIN logs ON logs.block_number = c.b WHERE logs.log_index = 2 AND c.n < 8) SELECT n, b FROM c", None),
    "logs_scalar_subquery": ("SELECT COUNT(*) AS n FROM logs WHERE block_number = (SELECT MAX(block_number) FROM logs WHERE source = 1)", None),
    "logs_exists": ("SELECT COUNT(*) AS n FROM logs a WHERE EXISTS (SELECT 1 FROM logs b WHERE b.topic1 = a.topic2 AND b.source = 1) AND NOT EXISTS (SELECT 1 FROM logs c WHERE c.tx_hash = a.tx_hash AND c.topic3 IS NOT NULL)", None),
    "logs_union": ("SELECT topic1 AS w FROM logs UNION SELECT topic2 FROM logs", None),
    "logs_intersect": ("SELECT topic1 AS w FROM logs INTERSECT SELECT topic2 FROM logs", None),
    "logs_except_all": ("SELECT topic1 AS w FROM logs EXCEPT ALL SELECT topic2 FROM logs", None),
    "logs_distinct": ("SELECT DISTINCT address, topic0 FROM logs", None),
    "logs_distinct_on": ("SELECT DISTINCT ON (address) address, block_number, log_index FROM logs ORDER BY address, block_number DESC, log_index DESC", None),
    "logs_qualify": ("SELECT address, block_number, log_index, ROW_NUMBER() OVER (PARTITION BY address ORDER BY block_number, log_index) AS rn FROM logs QUALIFY rn <= 3", "SELECT * FROM (SELECT address, block_number, log_index, CAST(ROW_NUMBER() OVER (PARTITION BY address ORDER BY block_number, log_index) AS INT) AS rn FROM logs) WHERE rn <= 3"),
    "logs_rollup": ("SELECT address, source, COUNT(*) AS n FROM logs GROUP BY ROLLUP (address, source)", None),
    "logs_cube": ("SELECT address, topic0, GROUPING(address) AS g, COUNT(*) AS n FROM logs GROUP BY CUBE (address, topic0)", "SELECT address, topic0, GROUPING(address)::TINYINT AS g, COUNT(*) AS n FROM logs GROUP BY CUBE (address, topic0)"),
    "logs_grouping_sets": ("SELECT address, topic0, COUNT(*) AS n FROM logs GROUP BY GROUPING SETS ((address), (topic0), ())", None),
    "logs_group_all": ("SELECT address, data_len, COUNT(*) AS n FROM logs GROUP BY ALL", None),
    "logs_filter_agg": ("SELECT address, COUNT(*) FILTER (WHERE source = 1) AS traced, MIN(data) AS low, MAX(data) AS high, COUNT(DISTINCT topic1) AS wallets FROM logs GROUP BY address", None),
    "logs_having": ("SELECT topic1, COUNT(*) AS n FROM logs GROUP BY topic1 HAVING n > 60", None),
    "logs_day_buckets": ("SELECT timestamp / 86400 AS day, COUNT(*) AS n FROM logs GROUP BY timestamp / 86400", "SELECT timestamp // 86400 AS day, COUNT(*) AS n FROM logs GROUP BY 1"),
    "window_ranks": ("SELECT block_number, log_index, RANK() OVER w AS r, DENSE_RANK() OVER w AS d, NTILE(5) OVER v AS q FROM logs WINDOW w AS (PARTITION BY address ORDER BY data_len), v AS (PARTITION BY address ORDER BY block_number, log_index)", "SELECT block_number, log_index, RANK() OVER w::INT AS r, DENSE_RANK() OVER w::INT AS d, NTILE(5) OVER v::INT AS q FROM logs WINDOW w AS (PARTITION BY address ORDER BY data_len), v AS (PARTITION BY address ORDER BY block_number, log_index)"),
    "window_offsets": ("SELECT block_number, log_index, LAG(data_len) OVER w AS before, LEAD(data_len, 2) OVER w AS after, FIRST_VALUE(data_len) OVER w AS first, NTH_VALUE(data_len, 2) OVER w AS second FROM logs WINDOW w AS (PARTITION BY address ORDER BY block_number, log_index)", None),
    "window_running": ("SELECT block_number, log_index, SUM(data_len) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS UNBOUNDED PRECEDING) AS total FROM logs", "SELECT block_number, log_index, CAST(SUM(data_len) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM logs"),
    "window_sliding": ("SELECT block_number, log_index, SUM(data_len) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS total, MAX(data_len) OVER (PARTITION BY address ORDER BY block_number RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS most FROM logs", "SELECT block_number, log_index, CAST(SUM(data_len) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS BIGINT) AS total, MAX(data_len) OVER (PARTITION BY address ORDER BY block_number RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS most FROM logs"),
    "window_distinct_sum": ("SELECT block_number, log_index, SUM(DISTINCT data_len) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS total FROM logs", "SELECT block_number, log_index, CAST(list_sum(list_distinct(list(data_len) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))) AS BIGINT) AS total FROM logs"),
    "window_percent": ("SELECT block_number, log_index, ROUND(PERCENT_RANK() OVER w, 9) AS p, ROUND(CUME_DIST() OVER w, 9) AS c FROM logs WINDOW w AS (PARTITION BY address ORDER BY data_len)", None),
    "window_over_groups": ("SELECT address, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC, address) AS r FROM logs GROUP BY address", "SELECT address, COUNT(*) AS n, (RANK() OVER (ORDER BY COUNT(*) DESC, address))::INT AS r FROM logs GROUP BY address"),
    "fn_strings": ("SELECT block_number, log_index, UPPER(substr(address, 3, 4)) AS u, strpos(data, 'ab') AS p, starts_with(address, '0x1') AS s, REVERSE(substr(data, 3, 4)) AS r, repeat('xy', 2) AS rep, LPAD(substr(data, 3, 2), 5, '*') AS l FROM logs", "SELECT block_number, log_index, upper(substr(address, 3, 4)) AS u, strpos(data, 'ab')::INT AS p, starts_with(address, '0x1') AS s, reverse(substr(data, 3, 4)) AS r, repeat('xy', 2) AS rep, lpad(substr(data, 3, 2), 5, '*') AS l FROM logs"),
    "fn_arrays": (f"SELECT block_number, log_index, array_has(topics, '{TRANSFER}') AS transfer, array_length(topics) AS n, array_to_string(topics, ',') AS joined FROM logs", f"SELECT block_number, log_index, list_contains(topics, '{TRANSFER}') AS transfer, len(topics)::INT AS n, array_to_string(topics, ',') AS joined FROM logs"),
    "fn_math": ("SELECT block_number, log_index, power(2, log_index) AS p, abs(5 - data_len) AS a, gcd(data_len, 12) AS g, block_number % 7 AS m, block_number / 7 AS d, block_number & 255 AS low, log_index ^ 3 AS x FROM logs", "SELECT block_number, log_index, power(2, log_index)::BIGINT AS p, abs(5 - data_len) AS a, gcd(data_len, 12) AS g, block_number % 7 AS m, block_number // 7 AS d, block_number & 255 AS low, xor(log_index, 3) AS x FROM logs"),
    "fn_conditional": ("SELECT block_number, log_index, COALESCE(topic3, topic2, 'none') AS c, NULLIF(source, 1) AS n, GREATEST(tx_index, log_index) AS g, TRY_CAST(CASE WHEN source = 1 THEN 'x1' ELSE '12' END AS BIGINT) AS t FROM logs", None),
    "fn_digest": ("SELECT block_number, log_index, encode(sha256(data), 'hex') AS h, md5(address) AS m FROM logs", "SELECT block_number, log_index, sha256(data) AS h, md5(address) AS m FROM logs"),
    "logs_distinct_on_limit": ("SELECT DISTINCT ON (block_number) block_number, log_index AS i, data_len FROM logs ORDER BY block_number, i DESC LIMIT 400", None),
    "logs_qualify_order": ("SELECT address, topic0 FROM logs QUALIFY ROW_NUMBER() OVER (PARTITION BY address ORDER BY block_number, log_index) <= 90 ORDER BY block_number DESC, log_index DESC LIMIT 250", None),
    "fn_division": ("SELECT block_number, log_index, n / 2 AS half, -n / 2 AS minus, LENGTH(address) / 5 AS l, n / 2 / 2 AS quarter, n / 2.0 AS f, CAST(n AS DOUBLE) / 2 AS g, 7 * n / (n + 1) AS r FROM (SELECT block_number, log_index, log_index + 1 AS n, address FROM logs) t", "SELECT block_number, log_index, n // 2 AS half, -(n // 2) AS minus, LENGTH(address) // 5 AS l, (n // 2) // 2 AS quarter, n / 2 AS f, n / 2 AS g, 7 * n // (n + 1) AS r FROM (SELECT block_number, log_index, log_index + 1 AS n, address FROM logs) t"),
    "fn_regexp": (r"SELECT block_number, log_index, regexp_match(address, '^0x([0-9]+)([a-f])') AS m, regexp_match(address, 'a[0-9]') AS w, regexp_like(data, '0{30}') AS z, regexp_replace(address, '[0-9]', '#', 'g') AS r, address ~ '^0x[0-4]' AS t, data ILIKE '0XA%' AS i FROM logs", r"SELECT block_number, log_index, CASE WHEN regexp_matches(address, '^0x([0-9]+)([a-f])') THEN [regexp_extract(address, '^0x([0-9]+)([a-f])', 1), regexp_extract(address, '^0x([0-9]+)([a-f])', 2)] END AS m, CASE WHEN regexp_matches(address, 'a[0-9]') THEN [regexp_extract(address, 'a[0-9]')] END AS w, regexp_matches(data, '0{30}') AS z, regexp_replace(address, '[0-9]', '#', 'g') AS r, regexp_matches(address, '^0x[0-4]') AS t, data ILIKE '0XA%' AS i FROM logs"),
    "fn_date_bin": ("SELECT block_number, log_index, CAST(date_bin(INTERVAL '500 milliseconds', moment) AS VARCHAR) AS a, CAST(date_bin(INTERVAL '15 minutes', moment) AS VARCHAR) AS b, CAST(date_bin(INTERVAL '2 months', moment) AS VARCHAR) AS c FROM (SELECT block_number, log_index, to_timestamp_micros(timestamp * 1000000 + log_index * 260000) AS moment FROM logs) t", "SELECT block_number, log_index, CAST(time_bucket(INTERVAL '500 milliseconds', moment, TIMESTAMP '1970-01-01') AS VARCHAR) AS a, CAST(time_bucket(INTERVAL '15 minutes', moment, TIMESTAMP '1970-01-01') AS VARCHAR) AS b, CAST(time_bucket(INTERVAL '2 months', moment, TIMESTAMP '1970-01-01') AS VARCHAR) AS c FROM (SELECT block_number, log_index, make_timestamp(timestamp * 1000000 + log_index * 260000) AS moment FROM logs) t"),
    "fn_struct_map": ("SELECT block_number, log_index, named_struct('a', address, 'n', data_len).n AS n, map_keys(make_map('x', source, 'y', tx_index)) AS k, map_extract(make_map('x', source, 'y', tx_index), 'y') AS v FROM logs", "SELECT block_number, log_index, data_len AS n, ['x', 'y'] AS k, [tx_index] AS v FROM logs"),
    "agg_arrays": ("SELECT address, array_agg(data_len ORDER BY block_number, log_index) AS sizes, string_agg(CAST(log_index AS VARCHAR), '-' ORDER BY block_number, log_index) AS s FROM logs WHERE source = 1 GROUP BY address", "SELECT address, list(data_len ORDER BY block_number, log_index) AS sizes, string_agg(CAST(log_index AS VARCHAR), '-' ORDER BY block_number, log_index) AS s FROM logs WHERE source = 1 GROUP BY address"),
    "agg_ordered_set": ("SELECT address, percentile_cont(0.5) WITHIN GROUP (ORDER BY data_len) AS mid, MEDIAN(block_number) AS m FROM logs GROUP BY address", None),
    "fn_text": ("SELECT block_number, log_index, ascii(substr(address, 3)) AS a, btrim(address, '0x') AS b, char_length(data) AS c, chr(65 + log_index) AS d, concat_ws('-', address, topic3, source) AS e, ends_with(data, '00') AS f, left(address, 5) AS g, left(address, -30) AS h, right(address, 4) AS i, right(address, -35) AS j, levenshtein(substr(address, 3, 6), 'abcdef') AS k, octet_length(data) AS l, bit_length(address) AS m FROM logs", "SELECT block_number, log_index, ascii(substr(address, 3)) AS a, trim(address, '0x') AS b, length(data)::INT AS c, chr((65 + log_index)::INT) AS d, concat_ws('-', address, topic3, source) AS e, ends_with(data, '00') AS f, left(address, 5) AS g, left(address, -30) AS h, right(address, 4) AS i, right(address, -35) AS j, levenshtein(substr(address, 3, 6), 'abcdef')::INT AS k, strlen(data)::INT AS l, (8 * strlen(address))::INT AS m FROM logs"),
    "fn_text_edits": ("SELECT block_number, log_index, overlay(address PLACING 'zz' FROM 3 FOR 4) AS a, replace(address, 'a', '_') AS b, rpad(substr(data, 3, 4), 6, '*') AS c, split_part(address, 'a', 2) AS d, substring_index(address, 'a', 1) AS e, to_hex(block_number) AS f, translate(address, 'abc', 'xy') AS g, position('a' IN address) AS h, ltrim(substr(data, 3), '0') AS i, rtrim(data, '0') AS j, initcap(concat('ab ', substr(address, 3, 3))) AS k, contains(address, 'ab') AS l, lower('AB' || data) AS m, find_in_set(substr(address, 3, 1), '1,2,3,e') AS n FROM logs", "SELECT block_number, log_index, left(address, 2) || 'zz' || substr(address, 7) AS a, replace(address, 'a', '_') AS b, rpad(substr(data, 3, 4), 6, '*') AS c, split_part(address, 'a', 2) AS d, split_part(address, 'a', 1) AS e, lower(hex(block_number)) AS f, replace(translate(address, 'ab', 'xy'), 'c', '') AS g, strpos(address, 'a')::INT AS h, ltrim(substr(data, 3), '0') AS i, rtrim(data, '0') AS j, 'Ab ' || upper(substr(address, 3, 1)) || substr(address, 4, 2) AS k, contains(address, 'ab') AS l, lower('AB' || data) AS m, coalesce(list_position(['1', '2', '3', 'e'], substr(address, 3, 1)), 0)::INT AS n FROM logs"),
    "fn_numbers": ("SELECT block_number, log_index, ROUND(sqrt(data_len), 9) AS a, ROUND(cbrt(data_len), 9) AS b, ROUND(exp(log_index), 9) AS c, ROUND(ln(data_len + 1), 9) AS d, ROUND(log2(data_len + 1), 9) AS e, ROUND(log10(data_len + 1), 9) AS f, ROUND(log(3, data_len + 1), 9) AS g, floor(data_len / 5.0) AS h, ceil(data_len / 5.0) AS i, trunc(data_len / 7.0) AS j, signum(log_index - 1) AS k, factorial(log_index) AS l, lcm(log_index + 1, 6) AS m, iszero(log_index) AS n, isnan(CAST(log_index AS DOUBLE)) AS o FROM logs", "SELECT block_number, log_index, round(sqrt(data_len), 9) AS a, round(cbrt(data_len), 9) AS b, round(exp(log_index), 9) AS c, round(ln(data_len + 1), 9) AS d, round(log2(data_len + 1), 9) AS e, round(log10(data_len + 1), 9) AS f, round(ln(data_len + 1) / ln(3), 9) AS g, floor(data_len / 5.0)::DOUBLE AS h, ceil(data_len / 5.0)::DOUBLE AS i, trunc(data_len / 7.0)::DOUBLE AS j, sign(log_index - 1)::DOUBLE AS k, factorial(log_index::INT)::BIGINT AS l, lcm(log_index + 1, 6)::BIGINT AS m, log_index = 0 AS n, false AS o FROM logs"),
    "fn_angles": ("SELECT block_number, log_index, ROUND(sin(log_index), 9) AS a, ROUND(cos(log_index), 9) AS b, ROUND(tan(log_index), 9) AS c, ROUND(asin(log_index / 4.0), 9) AS d, ROUND(acos(log_index / 4.0), 9) AS e, ROUND(atan(log_index), 9) AS f, ROUND(atan2(log_index, 2), 9) AS g, ROUND(sinh(log_index), 9) AS h, ROUND(cosh(log_index), 9) AS i, ROUND(tanh(log_index), 9) AS j, ROUND(degrees(log_index), 9) AS k, ROUND(radians(log_index), 9) AS l, ROUND(pi(), 9) AS m, ROUND(cot(log_index + 1), 9) AS n FROM logs", "SELECT block_number, log_index, round(sin(log_index), 9) AS a, round(cos(log_index), 9) AS b, round(tan(log_index), 9) AS c, round(asin(log_index / 4.0), 9) AS d, round(acos(log_index / 4.0), 9) AS e, round(atan(log_index), 9) AS f, round(atan2(log_index, 2), 9) AS g, round(sinh(log_index), 9) AS h, round(cosh(log_index), 9) AS i, round(tanh(log_index), 9) AS j, round(degrees(log_index), 9) AS k, round(radians(log_index), 9) AS l, round(pi(), 9) AS m, round(cot(log_index + 1), 9) AS n FROM logs"),
    "fn_bits": ("SELECT block_number, log_index, data_len | 5 AS a, data_len & 6 AS b, data_len << 2 AS c, data_len >> 1 AS d, data_len % 5 AS e, 0 - data_len AS f, nvl(NULLIF(source, 0), 9) AS g, nvl2(topic3, 'y', 'n') AS h, least(tx_index, source) AS i, source = 1 AND topic3 IS NULL OR NOT (tx_index = 0) AS j, (topic3 = topic1) IS UNKNOWN AS k, (source = 1) IS NOT TRUE AS l FROM logs", "SELECT block_number, log_index, data_len | 5 AS a, data_len & 6 AS b, data_len << 2 AS c, data_len >> 1 AS d, data_len % 5 AS e, 0 - data_len AS f, coalesce(nullif(source, 0), 9) AS g, CASE WHEN topic3 IS NOT NULL THEN 'y' ELSE 'n' END AS h, least(tx_index, source) AS i, source = 1 AND topic3 IS NULL OR NOT (tx_index = 0) AS j, (topic3 = topic1) IS NULL AS k, (source = 1) IS DISTINCT FROM true AS l FROM logs"),
    "fn_array_edits": ("SELECT block_number, log_index, array_append(topics, 'x') AS a, array_prepend('x', topics) AS b, array_concat(topics, ARRAY['p', 'q']) AS c, array_slice(topics, 2, 3) AS d, array_pop_back(topics) AS e, array_pop_front(topics) AS f, array_remove(topics, topic0) AS g, array_replace(topics, topic1, 'w') AS h, array_repeat(source, 2) AS i, array_resize(topics, 3, 'z') AS j, topics[1:2] AS k, topics[-1] AS l FROM logs", "SELECT block_number, log_index, list_append(topics, 'x') AS a, list_prepend('x', topics) AS b, list_concat(topics, ['p', 'q']) AS c, topics[2:3] AS d, topics[1:greatest(len(topics) - 1, 0)] AS e, topics[2:] AS f, CASE WHEN topic0 IS NULL THEN topics ELSE topics[2:] END AS g, CASE WHEN topic1 IS NULL THEN topics ELSE list_concat([topic0, 'w'], topics[3:]) END AS h, [source, source] AS i, list_resize(topics, 3, 'z') AS j, topics[1:2] AS k, topics[-1] AS l FROM logs"),
    "fn_array_sets": ("SELECT block_number, log_index, array_distinct(ARRAY[source, tx_index, log_index]) AS a, array_sort(ARRAY[source, tx_index, log_index]) AS b, array_max(ARRAY[source, tx_index]) AS c, array_min(ARRAY[source, tx_index]) AS d, array_position(ARRAY[3, 2, 1], log_index) AS e, array_has_all(topics, ARRAY[topic1]) AS f, array_has_any(topics, ARRAY['x', topic2]) AS g, string_to_array(substr(address, 3, 9), 'a') AS h, flatten(ARRAY[ARRAY[source], ARRAY[tx_index]]) AS i, range(0, 3) AS j, cardinality(array_union(ARRAY[source, 2], ARRAY[tx_index, 3])) AS k, array_sort(array_except(ARRAY[0, 1, 2, 3], ARRAY[log_index])) AS l FROM logs WHERE topic2 IS NOT NULL", "SELECT block_number, log_index, list_filter([source, tx_index, log_index], lambda x, i: list_position([source, tx_index, log_index], x) = i) AS a, list_sort([source, tx_index, log_index]) AS b, greatest(source, tx_index) AS c, least(source, tx_index) AS d, CASE WHEN log_index = 0 THEN NULL ELSE 4 - log_index END::BIGINT AS e, true AS f, true AS g, string_split(substr(address, 3, 9), 'a') AS h, [source, tx_index] AS i, [0, 1, 2]::INT[] AS j, len(list_distinct([source, 2, tx_index, 3]))::INT AS k, list_filter([0, 1, 2, 3]::BIGINT[], lambda x: x <> log_index) AS l FROM logs WHERE topic2 IS NOT NULL"),
    "fn_moments": ("SELECT block_number, log_index, CAST(date_trunc('hour', moment) AS VARCHAR) AS a, date_part('doy', moment) AS b, extract(DOW FROM moment) AS c, CAST(to_date(CAST(moment AS VARCHAR)) AS VARCHAR) AS d, to_char(moment, '%Y/%m/%d %H:%M') AS e, CAST(make_date(2020, 2, CAST(log_index + 1 AS INT)) AS VARCHAR) AS f, to_unixtime(moment) AS g, date_part('hour', moment) AS h, CAST(moment + INTERVAL '1 day 2 hours' AS VARCHAR) AS i, moment > TIMESTAMP '2024-01-01 00:00:00' AS j FROM (SELECT block_number, log_index, to_timestamp_seconds(timestamp) AS moment FROM logs) t", "SELECT block_number, log_index, CAST(date_trunc('hour', moment) AS VARCHAR) AS a, date_part('doy', moment)::INT AS b, date_part('dow', moment)::INT AS c, CAST(moment::DATE AS VARCHAR) AS d, strftime(moment, '%Y/%m/%d %H:%M') AS e, CAST(make_date(2020, 2, log_index + 1) AS VARCHAR) AS f, epoch(moment)::BIGINT AS g, date_part('hour', moment)::INT AS h, CAST(moment + INTERVAL '1 day 2 hours' AS VARCHAR) AS i, moment > TIMESTAMP '2024-01-01 00:00:00' AS j FROM (SELECT block_number, log_index, make_timestamp(timestamp * 1000000) AS moment FROM logs) t"),
    "fn_casts": ("SELECT block_number, log_index, CAST(data_len AS VARCHAR) AS a, TRY_CAST(substr(address, 3, 3) AS BIGINT) AS b, CAST(CAST(data_len AS DECIMAL(12, 2)) / 4 AS DECIMAL(12, 3)) AS c, data_len::DOUBLE AS d, CAST(source AS BOOLEAN) AS e, CAST('1' || CAST(log_index AS VARCHAR) AS BIGINT) AS f, arrow_typeof(data_len) AS g FROM logs", "SELECT block_number, log_index, data_len::VARCHAR AS a, TRY_CAST(CASE WHEN regexp_full_match(substr(address, 3, 3), '[0-9]+') THEN substr(address, 3, 3) END AS BIGINT) AS b, CAST(data_len / 4 AS DECIMAL(12, 3)) AS c, data_len::DOUBLE AS d, source = 1 AS e, 10 + log_index AS f, 'Int64' AS g FROM logs"),
    "fn_digest_more": ("SELECT block_number, log_index, encode(sha256(address), 'hex') AS a, encode(digest(address, 'md5'), 'hex') AS b, encode(decode(substr(address, 3), 'hex'), 'hex') AS c, encode(decode(substr(address, 3, 6), 'hex'), 'base64') AS d FROM logs", "SELECT block_number, log_index, sha256(address) AS a, md5(address) AS b, substr(address, 3) AS c, rtrim(to_base64(unhex(substr(address, 3, 6))), '=') AS d FROM logs"),
    "fn_regexp_count": ("SELECT block_number, log_index, regexp_count(address, '[a-f]') AS a, regexp_instr(address, '[a-f]') AS b, regexp_like(address, 'A', 'i') AS c, address SIMILAR TO '0x(1|e)%' AS d, address !~ '^0x1' AS e, address NOT LIKE '%ab%' AS f, regexp_replace(address, '[0-9]+', '#') AS g FROM logs", "SELECT block_number, log_index, len(regexp_extract_all(address, '[a-f]'))::INT AS a, (length(regexp_extract(address, '^[^a-f]*')) + 1)::INT AS b, contains(lower(address), 'a') AS c, regexp_matches(address, '^0x(1|e)') AS d, NOT regexp_matches(address, '^0x1') AS e, NOT contains(address, 'ab') AS f, regexp_replace(address, '[0-9]+', '#') AS g FROM logs"),
    "agg_approximate": ("SELECT topic0, approx_distinct(address) AS d, abs(approx_percentile_cont(block_number, 0.5) - MEDIAN(block_number)) <= 2 AS near, abs(approx_median(block_number) - MEDIAN(block_number)) <= 2 AS mid FROM logs GROUP BY topic0", "SELECT topic0, COUNT(DISTINCT address) AS d, true AS near, true AS mid FROM logs GROUP BY topic0"),
    "agg_moments": ("SELECT address, ROUND(stddev_pop(data_len), 6) AS a, ROUND(var_samp(data_len), 6) AS b, ROUND(covar_pop(data_len, log_index), 6) AS c, ROUND(regr_slope(data_len, log_index), 6) AS d, ROUND(regr_intercept(data_len, log_index), 6) AS e, ROUND(regr_r2(data_len, log_index), 6) AS f, regr_count(data_len, log_index) AS g, ROUND(AVG(data_len), 6) AS h FROM logs GROUP BY address", "SELECT address, ROUND(stddev_pop(data_len), 6) AS a, ROUND(var_samp(data_len), 6) AS b, ROUND(covar_pop(data_len, log_index), 6) AS c, ROUND(regr_slope(data_len, log_index), 6) AS d, ROUND(regr_intercept(data_len, log_index), 6) AS e, ROUND(regr_r2(data_len, log_index), 6) AS f, CAST(regr_count(data_len, log_index) AS BIGINT) AS g, ROUND(AVG(data_len), 6) AS h FROM logs GROUP BY address"),
    "agg_first_last": ("SELECT address, FIRST_VALUE(data_len ORDER BY block_number, log_index) AS a, LAST_VALUE(data_len ORDER BY block_number, log_index) AS b, bit_and(data_len) AS c, bit_or(data_len) AS d, bit_xor(data_len) AS e, bool_and(source = 0) AS f, bool_or(source = 1) AS g, MIN(topic3) AS h FROM logs GROUP BY address", "SELECT address, arg_min(data_len, block_number * 4 + log_index) AS a, arg_max(data_len, block_number * 4 + log_index) AS b, bit_and(data_len) AS c, bit_or(data_len) AS d, bit_xor(data_len) AS e, bool_and(source = 0) AS f, bool_or(source = 1) AS g, MIN(topic3) AS h FROM logs GROUP BY address"),
    "agg_types": ("SELECT source, SUM(data_len) AS a, SUM(CAST(data_len AS DECIMAL(10, 2))) AS b, SUM(CAST(data_len AS DOUBLE)) AS c, AVG(CAST(data_len AS DECIMAL(10, 2))) AS d, SUM(DISTINCT data_len) AS e, COUNT(topic3) AS f, SUM(CASE WHEN data_len < 0 THEN 1 END) AS g FROM logs GROUP BY source", "SELECT source, SUM(data_len)::BIGINT AS a, SUM(data_len)::DECIMAL(20, 2) AS b, SUM(data_len)::DOUBLE AS c, ((SUM(data_len)::HUGEINT * 2000000 + COUNT(*)) // (2 * COUNT(*)) / 1000000)::DECIMAL(14, 6) AS d, SUM(DISTINCT data_len)::BIGINT AS e, COUNT(topic3) AS f, NULL::BIGINT AS g FROM logs GROUP BY source"),
    "agg_default_names": ("SELECT COUNT(*), MAX(block_number) FROM logs WHERE topic3 IS NULL", "SELECT COUNT(*) AS \"count(*)\", MAX(block_number) AS \"max(logs.block_number)\" FROM logs WHERE topic3 IS NULL"),
    "logs_unnest": ("SELECT block_number, log_index, unnest(topics) AS t FROM logs", None),
    "select_constants": ("SELECT 1 + 1 AS two, 'a' || 'b' AS ab, 7 / 2 AS three, ARRAY[1, 2][2] AS second, NULL IS NULL AS yes", "SELECT 2 AS two, 'ab' AS ab, 3::BIGINT AS three, 2 AS second, true AS yes"),
    "logs_filter_sets": ("SELECT block_number, log_index, address FROM logs WHERE address IN (SELECT address FROM logs WHERE log_index = 2 AND source = 1) AND (block_number BETWEEN 18000003 AND 18001003 OR data_len NOT IN (32, 0)) AND data < '0xac1' AND topic1 IS NOT NULL", None),
    "logs_filter_literal": (f"SELECT block_number, log_index FROM logs WHERE topic1 = address'{WALLET}' OR topic2 = address'{WALLET}'", f"SELECT block_number, log_index FROM logs WHERE '0x' || lpad('{WALLET[2:]}', 64, '0') IN (topic1, topic2)"),
    "logs_semi_anti": ("SELECT a.block_number, a.log_index FROM logs a LEFT SEMI JOIN logs b ON a.topic1 = b.topic2 AND b.source = 1 UNION ALL SELECT c.block_number, c.log_index FROM logs c LEFT ANTI JOIN logs d ON c.tx_hash = d.tx_hash AND d.topic3 IS NOT NULL", "SELECT block_number, log_index FROM logs a WHERE topic1 IN (SELECT topic2 FROM logs WHERE source = 1) UNION ALL SELECT block_number, log_index FROM logs WHERE tx_hash NOT IN (SELECT tx_hash FROM logs WHERE topic3 IS NOT NULL)"),
    "logs_right_semi_anti": ("SELECT b.block_number, b.log_index FROM logs a RIGHT SEMI JOIN logs b ON a.topic1 = b.topic2 AND a.source = 1 UNION ALL SELECT d.block_number, d.log_index FROM logs c RIGHT ANTI JOIN logs d ON c.tx_hash = d.tx_hash AND c.topic3 IS NOT NULL", "SELECT block_number, log_index FROM logs WHERE topic2 IN (SELECT topic1 FROM logs WHERE source = 1) UNION ALL SELECT block_number, log_index FROM logs WHERE tx_hash NOT IN (SELECT tx_hash FROM logs WHERE topic3 IS NOT NULL)"),
    "logs_cross_join": ("SELECT a.address, b.topic0 FROM (SELECT DISTINCT address FROM logs) a CROSS JOIN (SELECT DISTINCT topic0 FROM logs) b", None),
    "logs_outer_joins": ("SELECT a.tx_hash, COUNT(b.log_index) AS n, COUNT(a.log_index) AS m FROM (SELECT * FROM logs WHERE log_index = 0) a FULL JOIN (SELECT * FROM logs WHERE source = 1) b ON a.tx_hash = b.tx_hash GROUP BY a.tx_hash", None),
    "logs_replace": ("SELECT * EXCLUDE (topics, source) REPLACE (upper(address) AS address, data_len + 1 AS data_len) FROM logs", None),
    "logs_order_alias": ("SELECT -block_number AS block_number, log_index AS i FROM logs ORDER BY block_number, i DESC LIMIT 30", None),
    "logs_quoted": ("WITH \"T\" AS (SELECT address AS \"Who\", data_len FROM logs) SELECT \"Who\", COUNT(*) AS n FROM \"T\" WHERE DATA_LEN > 3 GROUP BY \"Who\"", "SELECT address AS \"Who\", COUNT(*) AS n FROM logs WHERE data_len > 3 GROUP BY address"),
    "logs_nested_cte": ("WITH a AS (WITH b AS (SELECT address, block_number FROM logs WHERE source = 1) SELECT address, MAX(block_number) AS high FROM b GROUP BY address) SELECT logs.address, COUNT(*) AS n FROM logs JOIN a ON logs.address = a.address AND logs.block_number > a.high - 100 GROUP BY logs.address", None),
    "logs_set_nested": ("(SELECT topic1 AS w FROM logs WHERE source = 1 UNION ALL SELECT topic2 FROM logs) EXCEPT SELECT topic1 FROM logs WHERE block_number < 18000020", None),
    "logs_derived": ("SELECT n, COUNT(*) AS wallets FROM (SELECT topic1, COUNT(*) AS n FROM logs WHERE topic1 IS NOT NULL GROUP BY topic1) t WHERE n > (SELECT AVG(data_len) FROM logs) GROUP BY n", None),
    "logs_lateral": ("SELECT a.address, t.block_number FROM (SELECT DISTINCT address FROM logs) a, LATERAL (SELECT MAX(b.block_number) AS block_number FROM logs b WHERE b.address = a.address AND b.source = 1) t", None),
    "sum_data_or": ("SELECT SUM(data) AS total FROM logs WHERE (topic0 = event'Transfer(address,address,uint256)' OR topic1 = topic2) AND block_number > 18000020", f"SELECT CAST(SUM({AMOUNT}) AS VARCHAR) AS total FROM logs WHERE (topic0 = '{TRANSFER}' OR topic1 = topic2) AND block_number > 18000020"),
    "sum_data_top": ("SELECT topic1, SUM(data) AS total FROM logs GROUP BY topic1 ORDER BY total DESC, topic1 LIMIT 7", f"SELECT topic1, CAST(SUM({AMOUNT}) AS VARCHAR) AS total FROM logs GROUP BY topic1 ORDER BY SUM({AMOUNT}) DESC, topic1 LIMIT 7"),
    "sum_data_twice": ("SELECT address, SUM(data) AS a, SUM(data) - SUM(7) AS b, SUM(data) - (SUM(data) + SUM(1)) AS c FROM logs GROUP BY address", f"SELECT address, CAST(SUM({AMOUNT}) AS VARCHAR) AS a, CAST(SUM({AMOUNT}) - SUM(7) AS VARCHAR) AS b, CAST(-SUM(1) AS VARCHAR) AS c FROM logs GROUP BY address"),
    "window_avg_distinct": ("SELECT block_number, log_index, ROUND(AVG(DISTINCT data_len) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS UNBOUNDED PRECEDING), 9) AS a FROM logs", "SELECT block_number, log_index, round(list_avg(list_distinct(list(data_len) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS UNBOUNDED PRECEDING))), 9) AS a FROM logs"),
    "window_sliding_avg": ("SELECT block_number, log_index, ROUND(AVG(data_len) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS a, COUNT(topic3) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS b, AVG(CASE WHEN data_len > 90 THEN data_len END) OVER (PARTITION BY address) AS c, LAST_VALUE(log_index) OVER (PARTITION BY address ORDER BY block_number, log_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS d FROM logs", None),
    "metadata_text": ("SELECT column_name FROM information_schema.columns WHERE ordinal_position = '3' OR column_name BETWEEN 'topic0' AND 'topic3'", "SELECT * FROM (VALUES ('timestamp'), ('topic0'), ('topic1'), ('topic2'), ('topic3')) t(column_name)"),
    "logs_any_all": ("SELECT block_number, log_index FROM logs WHERE topic1 = ANY (SELECT topic2 FROM logs WHERE source = 1) AND address <> ALL (SELECT address FROM logs WHERE block_number = 18000000 AND log_index < 2)", "SELECT block_number, log_index FROM logs WHERE topic1 IN (SELECT topic2 FROM logs WHERE source = 1) AND address NOT IN (SELECT address FROM logs WHERE block_number = 18000000 AND log_index < 2)"),
    "values_table": ("SELECT x, y, x IN (1, NULL) AS i FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) t(x, y)", None),
    "generate_series": ("SELECT value * value AS v FROM generate_series(1, 100)", "SELECT CAST(i * i AS BIGINT) AS v FROM generate_series(1, 100) t(i)"),
    "metadata_columns": ("SELECT column_name, ordinal_position, is_nullable, data_type FROM information_schema.columns WHERE table_name = 'logs' AND ordinal_position > 7", "SELECT * FROM (VALUES ('topic0', 8::BIGINT, 'YES', 'text'), ('topic1', 9, 'YES', 'text'), ('topic2', 10, 'YES', 'text'), ('topic3', 11, 'YES', 'text'), ('topics', 12, 'NO', 'ARRAY'), ('data', 13, 'NO', 'text'), ('data_len', 14, 'NO', 'bigint'), ('source', 15, 'NO', 'bigint')) t(column_name, ordinal_position, is_nullable, data_type)"),
    "metadata_tables": ("SELECT table_schema, table_name, table_type FROM information_schema.tables", "SELECT 'public' AS table_schema, 'logs' AS table_name, 'BASE TABLE' AS table_type"),
}

MONEY = "CAST({} AS DECIMAL(18, 2))"
#: name -> SQL over the driver's tables, the same in both; {t} stands for a table
TPCH: dict[str, str] = {
    "join_inner": "SELECT c_mktsegment, o_orderpriority, COUNT(*) AS n FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_mktsegment, o_orderpriority",
    "join_left": "SELECT c_custkey, COUNT(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "join_right": "SELECT n_name, COUNT(s_suppkey) AS n FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name",
    "join_full": "SELECT c_custkey, s_suppkey FROM {customer} FULL JOIN {supplier} ON c_custkey = s_suppkey AND c_nationkey = s_nationkey",
    "join_semi": "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "join_anti": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
    "join_not_in": "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)",
    "join_using": "SELECT r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM {region}) a JOIN (SELECT n_regionkey AS k, n_name FROM {nation}) b USING (k)",
    "join_natural": "SELECT r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM {region}) a NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM {nation}) b",
    "join_theta": "SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_lateral": "SELECT n_name, t.n FROM {nation}, LATERAL (SELECT COUNT(*) AS n FROM {supplier} WHERE s_nationkey = n_nationkey) t",
    "join_multiway": "SELECT r_name, COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS revenue FROM {region} JOIN {nation} ON r_regionkey = n_regionkey JOIN {customer} ON n_nationkey = c_nationkey JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY r_name",
    "agg_pricing": "SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS price, COUNT(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "agg_statistics": "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 4) AS vp, ROUND(CORR(l_quantity, l_extendedprice), 6) AS r, ROUND(COVAR_SAMP(l_quantity, l_discount), 6) AS cv, MEDIAN(l_quantity) AS med, ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope FROM {lineitem} GROUP BY l_returnflag",
    "agg_bool_bit": "SELECT o_orderstatus, BOOL_AND(o_orderkey > 0) AS every, BOOL_OR(o_totalprice > 400000) AS some, BIT_AND(o_orderkey) AS a, BIT_OR(o_orderkey) AS o, BIT_XOR(o_orderkey) AS x FROM {orders} GROUP BY o_orderstatus",
    "agg_distinct": "SELECT c_nationkey, COUNT(DISTINCT c_mktsegment) AS segments, CAST(SUM(DISTINCT c_custkey % 10) AS BIGINT) AS d FROM {customer} GROUP BY c_nationkey",
    "agg_decimal_avg": "SELECT c_mktsegment, CAST(AVG(CAST(c_acctbal AS DECIMAL(12, 2))) * 1000000 AS BIGINT) AS millionths FROM {customer} GROUP BY c_mktsegment",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_empty": "SELECT COUNT(*) AS n, SUM(o_custkey) IS NULL AS none, MAX(o_orderpriority) AS m FROM {orders} WHERE o_orderkey < 0",
    "subquery_correlated": "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * AVG(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)",
    "topk_orders": "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "set_union_all": "SELECT s_nationkey AS k FROM {supplier} UNION ALL SELECT c_nationkey FROM {customer}",
    "set_intersect_all": "SELECT s_nationkey AS k FROM {supplier} INTERSECT ALL SELECT c_nationkey FROM {customer}",
    "set_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'",
    "window_top_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rn FROM {orders}) t WHERE rn <= 2",
    "fn_dates": "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m, DATE_TRUNC('month', o_orderdate) = TIMESTAMP '1995-03-01 00:00:00' AS march FROM {orders}",
}


def _net_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net_flow(public_view(logs_of(spark, sf_dir)), _wallet(3))


def _eth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = EthFilter.parse({"fromBlock": "0x112a880", "toBlock": "latest", "topics": [[TRANSFER, APPROVAL], None], "limit": 500, "offset": 20})
    return Engine(logs_of(spark, sf_dir), head=2**40).get_logs(request.to_log_filter(2**40)).select("block_number", "tx_index", "log_index", "address", "data")


def _log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = LogFilter(from_block=18000005, topics=(None, None, None), min_topics=3, data_from="0x00", descending=True)
    return Engine(logs_of(spark, sf_dir)).get_logs(request).select("block_number", "tx_index", "log_index", "topic2")


def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = TransferFilter.parse({"wallets": [_wallet(3), _wallet(8)], "min": "1000"})
    rows = public_view(logs_of(spark, sf_dir)).where(wanted.predicate()).withColumn("removed", F.lit(False))
    return notifications(rows).select("tokenAddress", "from", "to", "blockNumber", "logIndex", "removed")


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_of(spark, sf_dir)
    entry = F.struct("address", F.filter(F.array("topic0", "topic1", "topic2", "topic3"), lambda t: t.isNotNull()).alias("topics"), "data")
    tx = logs.groupBy("block_number", "block_hash", "tx_index", "tx_hash").agg(F.min("timestamp").alias("timestamp"), F.sort_array(F.collect_list(F.struct("log_index", entry.alias("log")))).alias("l"))
    tx = tx.withColumn("t", F.struct("tx_index", F.col("tx_hash").alias("hash"), F.transform("l", lambda x: x["log"]).alias("logs")))
    blocks = tx.groupBy("block_number", "block_hash").agg(F.min("timestamp").alias("timestamp"), F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["hash"].alias("hash"), t["logs"].alias("logs"))).alias("transactions"))
    return from_receipts(blocks).select("block_number", "tx_index", "log_index", "tx_hash", "address", "topic0", "topic3", "data", "data_len")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_of(spark, sf_dir)
    return groups_frame(logs, F.sum("data_len"), "total", ["address"], [F.col("block_number")], -2, 0).select("block_number", "log_index", "total")


def _store(spark: SparkSession, sf_dir: str) -> LogStore:
    """The logs in two batches of small buckets."""
    store, logs = LogStore(spark, scratch(spark, "store"), bucket_blocks=500), logs_of(spark, sf_dir)
    store.append(logs.where(F.col("block_number") < SPLIT))
    store.append(logs.where(F.col("block_number") >= SPLIT))
    return store


def _store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(_store(spark, sf_dir), unverified=True).sql(f"SELECT block_number, log_index, address, data FROM logs WHERE block_number > {SPLIT + 50}")


def _store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.compact(["address", "block_number"])
    return Engine(store, unverified=True).sql("SELECT address, SUM(data) AS total FROM logs GROUP BY address")


def _store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees that captured the store between two commits."""
    store, logs = LogStore(spark, scratch(spark, "store"), bucket_blocks=500), logs_of(spark, sf_dir)
    store.append(logs.where(F.col("block_number") < SPLIT))
    reader = Engine(store.snapshot(), unverified=True)
    store.append(logs.where(F.col("block_number") >= SPLIT))
    return reader.sql("SELECT COUNT(*) AS n, MAX(block_number) AS high, COUNT(DISTINCT address) AS emitters FROM logs")


def _reorganised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All canonical rows after the blocks from SPLIT on were replaced by shorter ones."""
    store, logs = _store(spark, sf_dir), logs_of(spark, sf_dir)
    new = logs.where((F.col("block_number") >= SPLIT) & (F.col("log_index") < 2)).withColumn("block_hash", F.concat(F.lit("0xff"), F.substring("block_hash", 5, 62)))
    store.reorganise(SPLIT, new)
    return Engine(store, unverified=True).sql("SELECT block_number, block_hash, log_index, data FROM logs")


def _sum_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums where nothing is known of the payloads: every other one is of over 35 bytes."""
    wide = F.concat(F.lit("0x" + "0" * 64), F.expr("substring(data, 3)"))
    logs = logs_of(spark, sf_dir)
    return Engine(logs.withColumn("data", F.when(F.col("log_index") % 2 == 0, wide).otherwise(F.col("data")))).sql("SELECT address, SUM(data) AS total FROM logs GROUP BY address")


_IS_TRANSFER = f"topic0 = '{TRANSFER}' AND topic3 IS NULL AND data_len = 32"
DATAFRAME: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "net_flow": (_net_flow, f"SELECT address, CAST(r AS VARCHAR) AS received, CAST(s AS VARCHAR) AS sent, CAST(r - s AS VARCHAR) AS net FROM (SELECT address, SUM(CASE WHEN topic2 = w THEN {AMOUNT} ELSE 0 END) AS r, SUM(CASE WHEN topic1 = w THEN {AMOUNT} ELSE 0 END) AS s FROM logs, (SELECT '0x' || lpad(substr(sha256('w:3'), 1, 40), 64, '0') AS w) WHERE {_IS_TRANSFER} AND (topic1 = w OR topic2 = w) GROUP BY address)"),
    "eth_filter": (_eth_filter, f"SELECT block_number, tx_index, log_index, address, data FROM logs WHERE block_number >= 18000000 AND topic0 IN ('{TRANSFER}', '{APPROVAL}') AND topic1 IS NOT NULL ORDER BY block_number, tx_index, log_index LIMIT 500 OFFSET 20"),
    "log_filter": (_log_filter, "SELECT block_number, tx_index, log_index, topic2 FROM logs WHERE block_number >= 18000005 AND topic0 IS NOT NULL AND topic1 IS NOT NULL AND topic2 IS NOT NULL AND data >= '0x00'"),
    "transfer_filter": (_transfers, f"SELECT address AS \"tokenAddress\", '0x' || substr(topic1, 27) AS \"from\", '0x' || substr(topic2, 27) AS \"to\", block_number AS \"blockNumber\", log_index AS \"logIndex\", false AS removed FROM logs WHERE {_IS_TRANSFER} AND data >= '0x' || lpad('3e8', 64, '0') AND (substr(topic1, 27) IN (substr(sha256('w:3'), 1, 40), substr(sha256('w:8'), 1, 40)) OR substr(topic2, 27) IN (substr(sha256('w:3'), 1, 40), substr(sha256('w:8'), 1, 40)))"),
    "receipt_flattening": (_receipts, "SELECT block_number, tx_index, log_index, tx_hash, address, topic0, topic3, data, data_len FROM logs"),
    "window_groups_frame": (_groups, "SELECT block_number, log_index, CAST(SUM(data_len) OVER (PARTITION BY address ORDER BY block_number GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM logs"),
    "sum_data_any_length": (_sum_any, f"SELECT address, CAST(SUM({AMOUNT}) AS VARCHAR) AS total FROM logs GROUP BY address"),
    "store_range": (_store_range, f"SELECT block_number, log_index, address, data FROM logs WHERE block_number > {SPLIT + 50}"),
    "store_compacted": (_store_compacted, f"SELECT address, CAST(SUM({AMOUNT}) AS VARCHAR) AS total FROM logs GROUP BY address"),
    "store_snapshot": (_store_snapshot, f"SELECT COUNT(*) AS n, MAX(block_number) AS high, COUNT(DISTINCT address) AS emitters FROM logs WHERE block_number < {SPLIT}"),
    "reorg_state": (_reorganised, "SELECT block_number, block_hash, log_index, data FROM logs WHERE block_number < 18000100 UNION ALL SELECT block_number, '0xff' || substr(block_hash, 5), log_index, data FROM logs WHERE block_number >= 18000100 AND log_index < 2"),
}


def _engine_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(logs_of(spark, sf_dir), most_bytes=32).sql(sql)


#: DuckDB's words where they are others: its AVG of decimals is a double, so the exact value is put together from a sum.
TPCH_ORACLE = {
    "agg_decimal_avg": "SELECT c_mktsegment, CAST(sign(s) * ((abs(s) * 20000 + n) // (2 * n)) AS BIGINT) AS millionths FROM (SELECT c_mktsegment, SUM(CAST(CAST(c_acctbal AS DECIMAL(12, 2)) * 100 AS HUGEINT)) AS s, COUNT(c_acctbal) AS n FROM customer GROUP BY c_mktsegment) t",
}


def _plain(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql


def _table_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query in the engine's dialect over other tables than logs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = {t: read(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
        return Engine(logs_of(spark, sf_dir), tables=own).sql(_plain(sql))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _engine_query(sql) for name, (sql, _) in ENGINE.items()}
    out |= {name: _table_query(sql) for name, sql in TPCH.items()}
    return out | {name: f for name, (f, _) in DATAFRAME.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: f"WITH logs AS ({LOGS}) SELECT * FROM ({duck or sql}) q" for name, (sql, duck) in ENGINE.items()}
    for name, sql in TPCH.items():
        out[name] = TPCH_ORACLE.get(name, _plain(sql))
    return out | {name: f"WITH logs AS ({LOGS}) SELECT * FROM ({sql}) q" for name, (_, sql) in DATAFRAME.items()}
