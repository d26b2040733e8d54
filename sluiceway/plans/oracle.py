"""The same results in SQL, for DuckDB over the same tables."""

from __future__ import annotations

START = 1704067200000000

ROUTES = """(VALUES (1, 'click', 'web/click'), (2, 'view', 'web/view'),
  (3, 'purchase', 'shop/purchase'), (4, 'purchase', 'shop/purchase.rollup'),
  (5, 'error', 'ops'), (6, 'error', 'ops/err')) AS r(route_no, name, target)"""

# Lines of the documents: the parts that end in a newline.
LINES = """parts AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS p FROM documents),
numbered AS (SELECT doc_id, lang, source, p, unnest(range(1, len(p))) AS line_no FROM parts),
lines AS (SELECT doc_id, lang, source, line_no, p[line_no] AS line FROM numbered)"""

OFFSETS = """located AS (SELECT *, (sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no)
  - strlen(line) - 1)::BIGINT AS byte_offset FROM lines)"""

ENVELOPES = """env AS (SELECT event_id, user_id, value, epoch_us(ts) AS time_us,
  event_type AS event_name, props AS event_data FROM events)"""

GOOD_ROUTES = f"""resolved AS (SELECT route_no, name, target, string_split(target, '/') AS t FROM {ROUTES}),
bad AS (SELECT name, min(route_no) AS first_bad FROM resolved WHERE len(t) <> 2 GROUP BY name),
good AS (SELECT r.route_no, r.name, t[1] AS db, t[2] AS tab FROM resolved r
  LEFT JOIN bad USING (name) WHERE first_bad IS NULL OR r.route_no < first_bad)"""

TICK = f"""{START} + greatest(1, (time_us - {START} + 59999999) // 60000000) * 60000000"""

HOSTS = """hosts AS (SELECT s_name AS h, CASE WHEN s_nationkey < 20
  THEN s_name || '.nation' || s_nationkey ELSE '' END AS f FROM supplier)"""


def _heartbeat(interval: int, ticks: int) -> str:
    return f"""SELECT {START} + n * {interval} AS tick_us, 'sys.alive' AS event_name,
      '{{ "hostname": "' || h || '", "hostname_fqdn": "' || f || '" }}' AS event_data
      FROM hosts, range(1, {ticks + 1}) AS g(n)"""


def _esc(text: str) -> str:
    """JSON escaping of what occurs in the tables: backslash, quote and newline."""
    return (
        f"replace(replace(replace({text}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'),"
        f" chr(10), chr(92) || 'n')"
    )


STATUS = """CASE event_id % 7 WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 500
  WHEN 5 THEN NULL ELSE 201 END"""

DELIVERIES = f"""sent AS (SELECT db AS "database", tab AS "table", event_data,
  ({STATUS})::INTEGER AS http_status, (event_id % 3 + 1)::INTEGER AS attempt
  FROM env JOIN good ON event_name = name),
judged AS (SELECT *, CASE http_status WHEN 201 THEN 'OK' WHEN 400 THEN 'EINVAL'
  WHEN 401 THEN 'EACCESS' WHEN 403 THEN 'EACCESS' ELSE 'EIO' END AS outcome FROM sent)"""

LEVELS = """CASE event_type WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'INFO'
  WHEN 'purchase' THEN 'NOTICE' WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'LOUD' END"""

METRIC = """CASE WHEN {v} = 0 THEN '0'
  WHEN abs({v}) < 1e-9 THEN printf('%.1fp', {v} * 1e12)
  WHEN abs({v}) < 1e-6 THEN printf('%.1fn', {v} * 1e9)
  WHEN abs({v}) < 1e-3 THEN printf('%.1fμ', {v} * 1e6)
  WHEN abs({v}) < 0.1 THEN printf('%.1fm', {v} * 1e3)
  WHEN abs({v}) < 10 THEN printf('%.2f', {v})
  WHEN abs({v}) < 1e3 THEN printf('%.1f', {v})
  WHEN abs({v}) < 1e6 THEN printf('%.1fK', {v} / 1e3)
  WHEN abs({v}) < 1e9 THEN printf('%.1fM', {v} / 1e6)
  WHEN abs({v}) < 1e12 THEN printf('%.1fG', {v} / 1e9)
  ELSE printf('%.1fT', {v} / 1e12) END"""

PLAIN = r"""regexp_replace(printf('%f', {v}), '(\.\d+?)0+$', '\1')"""


def _shapes(table: str, column: str) -> str:
    counts = ", ".join(
        f"count(*) FILTER (regexp_full_match({column}::VARCHAR, '{shape}')) AS n_{name}"
        for name, shape in (
            ("hex", "[0-9a-fA-F]*"),
            ("alphanumeric", "[0-9a-zA-Z]*"),
            ("shell_safe", "[0-9a-zA-Z_.-]*"),
            ("digits", "[0-9]*"),
            ("number", "-?[0-9]*([.,][0-9]*)?"),
        )
    )
    return f"SELECT '{column}' AS field, count({column}) AS n_values, {counts} FROM {table}"


ASCII_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOW = ASCII_UP.lower()

URL = r"^(https?)://([^/?#]+)(/[^?#]*)?(\?([^#]*))?"

LINE = r"^([A-Za-z]+) (.*)\.$"

LETTERS = ", ".join(f"({i}, '{letter}')" for i, letter in enumerate("abcdefghijklmnopqrstuvwxyz"))

_SHOP = """FROM env JOIN good ON event_name = name"""


ORDER_PATTERNS = """r AS (SELECT n, c_custkey * 3 + n AS route_no, CASE n WHEN 1 THEN 'order.' || c_custkey || '.%'
              WHEN 2 THEN '%' || c_custkey || '.F' ELSE '%.' || c_custkey || '.%' END AS pattern,
              CASE n WHEN 1 THEN 'nation' || c_nationkey || '/%E' WHEN 3 THEN '%E/' || c_custkey
                ELSE CASE WHEN c_nationkey = 1 THEN 'x/y/z' ELSE 'late/' || c_custkey END END AS target
              FROM customer, (VALUES (1), (2), (3)) AS v(n)
              WHERE n = 1 OR (n = 2 AND c_nationkey < 5) OR (n = 3 AND c_nationkey > 20)),
            o AS (SELECT o_orderkey, 'order.' || o_custkey || '.' || o_orderstatus AS name FROM orders),
            names AS (SELECT DISTINCT name FROM o)"""


def all_sql() -> dict[str, str]:
    return {
        "scan_lines": f"""WITH {LINES}, {OFFSETS}
            SELECT doc_id, line_no, byte_offset, line FROM located""",
        "resume_scan": f"""WITH {LINES}, {OFFSETS},
            files AS (SELECT doc_id, lang, '/logs/' || source || '/' || doc_id AS path,
              doc_id + 100 AS inode, strlen(text) AS size,
              strlen(string_split(text, chr(10))[1]) + 1 AS first_line FROM documents),
            saved AS (SELECT 'log_' || sha1(path) AS k,
              CASE lang WHEN 'de' THEN inode + 1 ELSE inode END AS ck_inode,
              CASE lang WHEN 'fr' THEN size + 1 ELSE first_line END AS ck_offset
              FROM files WHERE lang <> 'es'),
            started AS (SELECT doc_id, path, inode,
              (CASE WHEN inode = ck_inode AND size >= ck_offset THEN ck_offset ELSE 0 END)::BIGINT
                AS "start"
              FROM files LEFT JOIN saved ON 'log_' || sha1(path) = k)
            SELECT path, inode, "start", byte_offset, line FROM located JOIN started USING (doc_id)
            WHERE byte_offset >= "start" """,
        "drop_blank": """WITH parts AS (SELECT doc_id,
              string_split(replace(text, '.' || chr(10), chr(10) || chr(10)), chr(10)) AS p
              FROM documents),
            numbered AS (SELECT doc_id, p, unnest(range(1, len(p))) AS line_no FROM parts)
            SELECT doc_id, line_no, p[line_no] AS line FROM numbered WHERE p[line_no] <> ''""",
        "wrap_raw": f"""WITH {LINES} SELECT doc_id, line_no,
            '{{ "data": "' || {_esc("line")} || '" }}' AS event_data FROM lines WHERE line <> ''""",
        "encode_payload": f"""SELECT page_id, '{{"url":"' || {_esc("url")} || '","html":"' ||
            {_esc("html")} || '"}}' AS event_data FROM pages""",
        "regex_fields": f"""WITH {LINES} SELECT doc_id, line_no,
            regexp_extract(line, '{LINE}', 1) AS word, regexp_extract(line, '{LINE}', 2) AS rest
            FROM lines WHERE regexp_matches(line, '{LINE}')""",
        "regex_url": f"""WITH f AS (SELECT page_id, url,
              regexp_extract(url, '{URL}', 1) AS scheme, regexp_extract(url, '{URL}', 2) AS host,
              regexp_extract(url, '{URL}', 3) AS path, regexp_extract(url, '{URL}', 5) AS query
              FROM pages WHERE regexp_matches(url, '{URL}'))
            SELECT page_id, scheme, host, path, query,
              '{{"scheme":"' || {_esc("scheme")} || '","host":"' || {_esc("host")} || '"' ||
              CASE WHEN path <> '' OR regexp_matches(url, '^https?://[^/?#]+\\?')
                THEN ',"path":"' || {_esc("path")} || '"' ELSE '' END ||
              CASE WHEN regexp_matches(url, '^https?://[^/?#]+(/[^?#]*)?\\?')
                THEN ',"query":"' || {_esc("query")} || '"' ELSE '' END || '}}' AS event_data
            FROM f""",
        "regex_match": f"""WITH {LINES} SELECT doc_id, line_no, line FROM lines
            WHERE regexp_matches(line, '\\w+ \\| [a-m]+[,.]?')""",
        "to_event": f"""WITH {ENVELOPES} SELECT {TICK} AS time_us, event_name, event_data FROM env""",
        "tick_assign": f"""WITH {ENVELOPES} SELECT event_id, time_us, {TICK} AS tick_us FROM env""",
        "missed_ticks": f"""WITH {ENVELOPES},
            ticks AS (SELECT DISTINCT event_name, {TICK} AS tick_us FROM env),
            steps AS (SELECT event_name, tick_us, (tick_us - lag(tick_us)
              OVER (PARTITION BY event_name ORDER BY tick_us)) // 60000000 - 1 AS missed FROM ticks)
            SELECT event_name, tick_us, missed FROM steps WHERE missed > 0""",
        "heartbeat": f"""WITH {HOSTS} {_heartbeat(1000000, 60)}""",
        "union_bindings": f"""WITH {ENVELOPES}, {HOSTS}
            SELECT {TICK} AS tick_us, event_name, event_data FROM env
            UNION ALL {_heartbeat(60000000, 10)}""",
        "round_zip": """WITH ranked AS (SELECT conv_id, role, text,
              row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS round_no
              FROM conversations),
            rounds AS (SELECT DISTINCT conv_id, round_no FROM ranked)
            SELECT r.conv_id, r.round_no, coalesce(s.text, '') AS system,
              coalesce(u.text, '') AS "user", coalesce(a.text, '') AS assistant,
              '{"conv":' || r.conv_id || '}' AS sensor
            FROM rounds r
            LEFT JOIN ranked s ON s.conv_id = r.conv_id AND s.round_no = r.round_no
              AND s.role = 'system'
            LEFT JOIN ranked u ON u.conv_id = r.conv_id AND u.round_no = r.round_no
              AND u.role = 'user'
            LEFT JOIN ranked a ON a.conv_id = r.conv_id AND a.round_no = r.round_no
              AND a.role = 'assistant'""",
        "merge_rounds": f"""WITH ranked AS (SELECT conv_id, role, turn, text,
              row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS round_no
              FROM conversations)
            SELECT conv_id, round_no, '{{"conv":' || conv_id || ',"turn":' ||
              coalesce(max(turn) FILTER (role = 'assistant'), max(turn) FILTER (role = 'user'),
                max(turn) FILTER (role = 'system')) || string_agg(
                ',"' || role || '":"' || {_esc("text")} || '"', ''
                ORDER BY CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END) ||
              '}}' AS event_data FROM ranked GROUP BY conv_id, round_no""",
        "merge_last": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
              AS round_no, text AS event_data FROM conversations WHERE role = 'assistant'
            QUALIFY text <> ''""",
        "merge_last_rounds": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
              AS round_no, text AS event_data FROM conversations WHERE role = 'assistant'
            QUALIFY text <> ''""",
        "merge_broken": """SELECT event_id, CASE WHEN event_type IN ('signup', 'error')
              THEN '{"no":' || event_id || '}' ELSE '{"k":' || json_extract_string(props, '$.k') ||
              ',"user":' || user_id || ',"no":' || event_id || '}' END AS event_data FROM events""",
        "merge_overlay": """SELECT event_id, CASE WHEN event_type = 'view' THEN props ELSE
            '{"k":{"was":[' || event_id || ',"' || event_type || '"]},"user":' || user_id || '}' END
            AS event_data FROM events""",
        "route_exact": f"""WITH {ENVELOPES}, {GOOD_ROUTES}
            SELECT db AS "database", tab AS "table", count(*) AS n_events,
              min(time_us) AS first_us, max(time_us) AS last_us,
              sum(strlen(event_data))::BIGINT AS n_bytes {_SHOP} GROUP BY 1, 2""",
        "route_shared": """SELECT event_id, route_no, db AS "database", tab AS "table" FROM events
            JOIN (VALUES (1, 'view', 'web', 'view'), (2, 'view', 'web', 'all'),
              (1, 'error', 'ops', 'errors')) AS r(route_no, name, db, tab) ON event_type = name""",
        "route_many": f"""SELECT event_id, 3 * i + n + 1 AS route_no, kind AS "database",
              letter || '.' || event_type AS "table" FROM events,
              (VALUES {LETTERS}) AS l(i, letter), (VALUES (0, 'begin'), (1, 'hold'), (2, 'end')) AS k(n, kind)
            WHERE CASE n WHEN 0 THEN starts_with(event_type, letter) WHEN 1 THEN contains(event_type, letter)
              ELSE suffix(event_type, letter) END""",
        "route_errors": f"""WITH {ENVELOPES}, resolved AS (SELECT *,
              len(string_split(target, '/')) <> 2 AS bad FROM {ROUTES}),
            flagged AS (SELECT *, coalesce(bool_or(bad) OVER (PARTITION BY name ORDER BY route_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM resolved)
            SELECT event_id, route_no, target, CASE WHEN bad THEN 'EINVAL' END AS error_code, stopped
            FROM env JOIN flagged ON event_name = name WHERE bad OR stopped""",
        "route_table": """WITH r AS (SELECT 'customer.' || c_custkey AS name, n AS route_no,
              CASE n WHEN 0 THEN 'all' WHEN 1 THEN c_mktsegment ELSE 'nation' END AS db,
              CASE n WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN 'orders'
                ELSE c_nationkey::VARCHAR END AS tab
              FROM customer, (VALUES (0), (1), (2)) AS v(n) WHERE c_nationkey >= 5 OR n = 0)
            SELECT o_orderkey, route_no, db AS "database", tab AS "table"
            FROM orders JOIN r ON name = 'customer.' || o_custkey""",
        "route_patterns": f"""WITH {ORDER_PATTERNS}, hits AS (SELECT name, route_no, replace(target, '%E', name) AS target
              FROM names JOIN r ON name LIKE pattern),
            b AS (SELECT name, min(route_no) AS first_bad FROM hits WHERE len(string_split(target, '/')) <> 2 GROUP BY name),
            good AS (SELECT hits.* FROM hits LEFT JOIN b USING (name) WHERE first_bad IS NULL OR route_no < first_bad)
            SELECT o_orderkey, route_no, target, split_part(target, '/', 1) AS "database",
              split_part(target, '/', 2) AS "table" FROM o JOIN good USING (name)""",
        "unrouted_patterns": f"""WITH {ORDER_PATTERNS}
            SELECT o_orderkey, name AS event_name FROM o WHERE NOT EXISTS (SELECT 1 FROM r
              WHERE n <> 1 AND o.name LIKE r.pattern)""",
        "routed": f"""SELECT event_id, event_type AS event_name FROM events
            WHERE event_type IN (SELECT name FROM {ROUTES})""",
        "unrouted": f"""SELECT event_id, event_type AS event_name FROM events
            WHERE event_type NOT IN (SELECT name FROM {ROUTES})""",
        "route_template": """WITH r AS (SELECT * FROM (VALUES (1, '%', 'mydb/%E'),
              (2, 'p%', 'shop/%E.rollup'), (3, '%ck', 'web/%E'), (4, 's%n%p', '%E'),
              (5, 'signup', 'late/%E'), (6, '%rr%', '%E/all')) AS v(route_no, pattern, target)),
            hits AS (SELECT event_id, route_no, replace(target, '%E', event_type) AS target,
              FROM events JOIN r ON event_type LIKE pattern),
            cut AS (SELECT *, coalesce(bool_or(len(string_split(target, '/')) <> 2) OVER
              (PARTITION BY event_id ORDER BY route_no), false) AS over FROM hits)
            SELECT event_id, route_no, target, split_part(target, '/', 1) AS "database",
              split_part(target, '/', 2) AS "table" FROM cut WHERE NOT over""",
        "parse_target": """WITH c AS (SELECT c_custkey, CASE
              WHEN c_nationkey < 5 THEN c_mktsegment
              WHEN c_nationkey > 20 THEN c_mktsegment || '/' || c_name || '/' || c_nationkey
              WHEN c_nationkey = 10 THEN '/' || c_name
              ELSE c_mktsegment || '/' || c_name END AS target FROM customer),
            p AS (SELECT *, string_split(target, '/') AS t FROM c)
            SELECT c_custkey, target, CASE WHEN len(t) = 2 THEN t[1] END AS "database",
              CASE WHEN len(t) = 2 THEN t[2] END AS "table",
              CASE WHEN len(t) <> 2 THEN 'EINVAL' END AS error_code FROM p""",
        "routes_from_properties": """SELECT c_custkey, 1::BIGINT AS route_no,
              c_mktsegment AS event_name_match, 'crm/' || c_mktsegment AS target,
              NULL::VARCHAR AS error_code FROM customer
            UNION ALL SELECT c_custkey, 2, CASE WHEN c_acctbal >= 2000 THEN 'signup' END,
              CASE WHEN c_acctbal >= 2000 THEN 'new/' || c_name END,
              CASE WHEN c_acctbal < 2000 THEN 'EINVAL' END FROM customer""",
        "target_broadcast": """WITH o AS (SELECT * FROM (VALUES (1, 'warehouse'), (2, 'stream'),
              (3, 'archive')) AS v(output_no, output_name)),
            tried AS (SELECT event_id, output_no, output_name, CASE
              WHEN output_no = 1 AND event_type = 'error' THEN 'EINVAL'
              WHEN output_no = 2 AND value > 60 THEN 'EIO' END AS error_code FROM events, o)
            SELECT event_id, output_no::BIGINT AS output_no, output_name, error_code,
              last_value(error_code IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY output_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS reported_error
            FROM tried""",
        "severity_filter": f"""WITH e AS (SELECT event_id, {LEVELS} AS level FROM events),
            s AS (SELECT * FROM (VALUES ('TRACE', 1), ('DEBUG', 2), ('INFO', 3), ('NOTICE', 4),
              ('WARNING', 5), ('ERROR', 6), ('CRITICAL', 7), ('ALERT', 8), ('EMERGENCY', 9),
              ('FATAL', 10)) AS v(level, severity_rank))
            SELECT event_id, level, severity_rank FROM e JOIN s USING (level)
            WHERE severity_rank >= 3""",
        "unknown_severity": f"""SELECT event_id, {LEVELS} AS level FROM events
            WHERE event_type = 'signup'""",
        "list_bindings": """SELECT DISTINCT 'chat.' || conv_id AS event_name,
              'source' AS item_kind, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2
              WHEN 'assistant' THEN 3 END::BIGINT AS item_no, role AS item_name FROM conversations
            UNION ALL SELECT DISTINCT 'chat.' || conv_id, 'target', 1, 'chat/' || conv_id
              FROM conversations""",
        "count_bindings": """SELECT 'chat.' || conv_id AS event_name,
              count(DISTINCT role) AS n_sources, 1::BIGINT AS n_targets
            FROM conversations GROUP BY conv_id""",
        "delivery_outcome": f"""WITH {ENVELOPES}, {GOOD_ROUTES}, {DELIVERIES}
            SELECT "database", "table", outcome, count(*) AS attempts FROM judged GROUP BY 1, 2, 3""",
        "dead_letters": f"""WITH {ENVELOPES}, {GOOD_ROUTES}, {DELIVERIES}
            SELECT * FROM judged WHERE outcome <> 'OK'""",
        "redeliver": f"""WITH {ENVELOPES}, {GOOD_ROUTES}, {DELIVERIES},
            r AS (SELECT * FROM (VALUES ('O', 'open'), ('F', 'done'), ('F', 'all'))
              AS v(status, tab))
            SELECT "database", "table", event_data, (attempt + 1)::BIGINT AS attempt FROM judged
              WHERE outcome = 'EIO' AND attempt < 3
            UNION ALL SELECT 'orders', tab, '{{"key":"' || o_orderkey || '"}}', 1
              FROM orders JOIN r ON o_orderstatus = status""",
        "insert_payload": f"""WITH {ENVELOPES}, {GOOD_ROUTES}
            SELECT event_id, route_no, '[{{"database":"' || db || '","table":"' || tab ||
              '","data":' || event_data || '}}]' AS body {_SHOP}""",
        "kafka_shape": """SELECT event_type AS topic, user_id::VARCHAR AS key, props AS value
            FROM events""",
        "table_sink": f"""WITH {ENVELOPES}, {GOOD_ROUTES}
            SELECT db AS "database", tab AS "table", event_id, event_data {_SHOP}""",
        "tail_scan": f"""WITH {LINES} SELECT line, strlen(line) AS byte_length FROM lines""",
        "stream_sink": f"""WITH {ENVELOPES}, {GOOD_ROUTES}
            SELECT db AS "database", tab AS "table", event_id, event_data {_SHOP}""",
        "committed_sink": f"""WITH {ENVELOPES}, {GOOD_ROUTES}
            SELECT db AS "database", tab AS "table", event_id, event_data {_SHOP}""",
        "file_sink": """SELECT event_id, event_type AS event_name, props AS event_data FROM events""",
        "checkpoint": """WITH f AS (SELECT lang, '/logs/' || source || '/' || doc_id AS path,
              doc_id + 100 AS inode, strlen(text) - strlen(list_last(string_split(text, chr(10))))
                AS "offset", strlen(string_split(text, chr(10))[1]) + 1 AS first_line
              FROM documents)
            SELECT 'log_' || sha1(path) AS checkpoint_key, inode, "offset"::BIGINT AS "offset"
            FROM f WHERE "offset" > 0 AND NOT (lang = 'en' AND "offset" = first_line)""",
        "source_lag": """WITH f AS (SELECT lang, 'log_' || sha1('/logs/' || source || '/' || doc_id) AS checkpoint_key,
              doc_id + 100 AS inode, strlen(text) AS whole,
              strlen(text) - strlen(list_last(string_split(text, chr(10)))) AS complete,
              strlen(string_split(text, chr(10))[1]) + 1 AS first_line FROM documents),
            r AS (SELECT *, CASE lang WHEN 'en' THEN least(complete, first_line) ELSE complete END AS read,
              CASE lang WHEN 'fr' THEN 1 ELSE whole END AS now FROM f WHERE complete > 0)
            SELECT checkpoint_key, inode, read::BIGINT AS "offset", now::BIGINT AS size,
              (CASE WHEN lang = 'de' OR now < read THEN now ELSE now - read END)::BIGINT AS lag
            FROM r WHERE whole IS NOT NULL""",
        "field_profile": " UNION ALL ".join(
            [_shapes("events", c) for c in ("event_type", "user_id", "value", "props")]
            + [_shapes("orders", c) for c in ("o_orderstatus", "o_orderkey", "o_orderpriority")]
        ),
        "text_normalize": f"""SELECT doc_id,
              md5(translate(text, '{ASCII_UP}', '{ASCII_LOW}')) AS lower_md5,
              md5(translate(text, '{ASCII_LOW}', '{ASCII_UP}')) AS upper_md5,
              md5(regexp_replace(text, '[^A-Za-z0-9_.-]', '', 'g')) AS shell_md5,
              md5(replace(text, 'th', 'thth')) AS replaced_md5,
              source || '/' || lang AS folder FROM documents""",
        "text_match": f"""SELECT doc_id, starts_with(text, 'Th') AS begins,
              suffix(text, '.') AS ends, contains(text, 'é') AS includes,
              contains(translate(text, '{ASCII_UP}', '{ASCII_LOW}'), 'the') AS includes_i,
              (CASE WHEN contains(text, 'z') THEN strlen(string_split(text, 'z')[1]) ELSE -1 END)
                ::BIGINT AS first_z,
              (CASE WHEN contains(text, '.')
                THEN strlen(text) - strlen(list_last(string_split(text, '.'))) - 1 ELSE -1 END)
                ::BIGINT AS last_dot,
              (CASE WHEN text < 'Of' THEN -1 WHEN text > 'Of' THEN 1 ELSE 0 END)::BIGINT
                AS order_to_of FROM documents""",
        "split_join": """SELECT doc_id, len(string_split(text, ' ')) AS n_words,
              md5(array_to_string(string_split(text, ' '), ', ')) AS list_md5,
              array_to_string(list_sort(list_distinct(string_split(text, ' '))), '|') AS word_set
            FROM documents""",
        "template_format": """SELECT c_custkey, c_name || ' <' || c_mktsegment || c_custkey ||
              '> buys ' || c_mktsegment || ', ' || c_name || c_mktsegment || '; ten is ' ||
              c_mktsegment || c_custkey || '0' AS line FROM customer""",
        "metric_format": f"""SELECT o_orderkey, {METRIC.format(v="o_totalprice")} AS price,
              {METRIC.format(v="(o_totalprice / 1e6)")} AS millions,
              {METRIC.format(v="(o_totalprice / -1e10)")} AS tiny,
              {METRIC.format(v="(o_totalprice * 2e6)")} AS huge,
              {PLAIN.format(v="o_totalprice")} AS plain,
              {PLAIN.format(v="(o_totalprice / 7.0::DOUBLE)")} AS seventh,
              o_custkey::VARCHAR AS customer, (o_orderstatus = 'O')::VARCHAR AS is_open
            FROM orders""",
        "time_format": f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at,
              strftime(ts, '%Y%m%dT%H:%M, day %j') AS compact,
              epoch_us(ts) + 108000000000 AS later_us,
              strftime(ts + INTERVAL 30 HOUR, '%Y-%m-%d %H:%M:%S') AS later,
              epoch_us(ts) > {START} + 604800000000 AS after_first_week,
              (epoch_us(ts) - {START}) // 3600000000 AS hours FROM events""",
        "json_sensor": """SELECT event_id, event_type AS event_name,
              json_extract(props, '$.k')::BIGINT AS k,
              json_extract_string(props, '$.missing') AS missing FROM events""",
        "system_stats": """SELECT s_suppkey, s_name AS hostname, s_acctbal / 2 AS cpu_user,
              NULL::DOUBLE AS cpu_system, s_acctbal AS load_1m, s_suppkey * 4096 AS memory_used,
              NULL::BIGINT AS memory_free, CASE WHEN s_nationkey < 20 THEN '/' END AS mount,
              CASE WHEN s_nationkey < 20 THEN s_suppkey * 1000 END AS used,
              CASE WHEN s_nationkey < 20 THEN 5::BIGINT END AS free FROM supplier""",
        "collect_and_route": f"""WITH {LINES}, {HOSTS}, alive AS ({_heartbeat(1000000, 10)}),
            logs AS (SELECT {START} + 1000000 AS tick_us, '{{"word":"' ||
              regexp_extract(line, '{LINE}', 1) || '","rest":"' ||
              {_esc(f"regexp_extract(line, '{LINE}', 2)")} || '"}}' AS event_data
              FROM lines WHERE regexp_matches(line, '{LINE}'))
            SELECT 'text' AS "database", 'lines' AS "table", count(*) AS n_events,
              max(tick_us) AS last_tick_us, sum(strlen(event_data))::BIGINT AS n_bytes FROM logs
            UNION ALL SELECT 'hosts', tab, count(*), max(tick_us), sum(strlen(event_data))::BIGINT
              FROM alive, (VALUES ('alive'), ('history')) AS v(tab) GROUP BY tab""",
    }
