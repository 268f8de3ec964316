"""DuckDB SQL for every registered query with a SQL form.

The fixture views are rebuilt here as CTEs over the pre-registered
``events`` and ``lineitem`` views, following the same rules as
``sources.fixtures``; each query then states its operator's rule directly in
SQL (NOT EXISTS, window functions, a recursive CTE for the greedy cover),
independently of the Spark implementation.
"""

from __future__ import annotations

from tidemark.plans import params as P

SENT = "TIMESTAMP '9999-12-31 00:00:00'"

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "ticks": ("SELECT event_id AS id, ts AS bus_time, event_type AS instrument, value AS price FROM events", ()),
    "trades": (f"""SELECT 't' || cast(event_id AS VARCHAR) AS public_id, ts AS bus_time,
        CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 1 DAY ELSE {SENT} END AS known_to,
        cast(user_id AS VARCHAR) AS session_id, event_id AS sequence_id, event_type AS instrument_public_id,
        'x' || cast(event_id AS VARCHAR) AS trade_id,
        CASE WHEN event_id % 40 = 0 THEN ts - INTERVAL 45 DAY ELSE ts END AS executed_at,
        value AS price, cast(event_id % 100 + 1 AS BIGINT) AS size,
        CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, event_id AS id FROM events""", ()),
    "leaf": ("""SELECT 'ticks' AS table_name, d AS day, 'ticks_d' || strftime(d, '%Y%m%d') AS leaf_name
        FROM (SELECT DISTINCT cast(bus_time AS DATE) AS d FROM ticks) x
        WHERE extract(day FROM d) NOT IN (11, 22)""", ("ticks",)),
    "trades_leaf": ("""SELECT 'trades' AS table_name, d AS day, 'trades_d' || strftime(d, '%Y%m%d') AS leaf_name
        FROM (SELECT DISTINCT cast(bus_time AS DATE) AS d FROM trades) x""", ("trades",)),
    "all_leaves": ("SELECT * FROM leaf UNION ALL SELECT * FROM trades_leaf", ("leaf", "trades_leaf")),
    "children": ("""SELECT table_name, leaf_name, 'r' AS kind, false AS is_default,
            cast(day AS TIMESTAMP) AS bound_lower, cast(day + 1 AS TIMESTAMP) AS bound_upper FROM all_leaves
        UNION ALL
        SELECT DISTINCT table_name, table_name || '_default', 'r', true, NULL::TIMESTAMP, NULL::TIMESTAMP
        FROM all_leaves""", ("all_leaves",)),
    "counts": ("""SELECT cast(bus_time AS DATE) AS day, count(*) AS n, min(id) AS lo, max(id) + 1 AS hi
        FROM ticks GROUP BY cast(bus_time AS DATE)""", ("ticks",)),
    "ledger": ("""SELECT 'ticks' AS table_name, 'ticks' AS kind,
            cast(extract(day FROM d) * 10 + copy AS BIGINT) AS line_no,
            CASE WHEN extract(day FROM d) = 10 THEN 7 ELSE 8 END AS nf,
            'ticks-' || cast(d AS VARCHAR) || '.csv.zst' AS file, cast(d AS VARCHAR) AS day,
            cast(lo AS VARCHAR) AS bound_lower,
            cast(CASE WHEN extract(day FROM d) = 8 THEN lo ELSE hi END AS VARCHAR) AS bound_upper,
            cast(CASE WHEN extract(day FROM d) IN (7, 14) THEN n + 1 ELSE n END AS VARCHAR) AS rows,
            cast(n * 20 AS VARCHAR) AS bytes,
            CASE WHEN extract(day FROM d) = 9 THEN 'bad' ELSE repeat('a', 64) END AS sha256,
            strftime(d + 1, '%Y-%m-%d') || 'T03:17:00Z' AS exported_at
        FROM (SELECT day AS d, n, lo, hi, 1 AS copy FROM counts
              UNION ALL SELECT day AS d, n, lo, hi, 2 AS copy FROM counts WHERE extract(day FROM day) = 13) c
        WHERE extract(day FROM d) <= 20 AND extract(day FROM d) <> 5""", ("counts",)),
    "trades_ledger": ("""SELECT 'trades' AS table_name, 'trades' AS kind,
            cast(d - DATE '2023-01-01' + 1 AS BIGINT) AS line_no, 8 AS nf,
            'trades-' || cast(d AS VARCHAR) || '.csv.zst' AS file, cast(d AS VARCHAR) AS day,
            cast(d AS VARCHAR) || 'T00:00:00Z' AS bound_lower,
            strftime(d + 1, '%Y-%m-%d') || 'T00:00:00Z' AS bound_upper,
            cast(n AS VARCHAR) AS rows, cast(n * 100 AS VARCHAR) AS bytes, repeat('c', 64) AS sha256,
            strftime(d + 1, '%Y-%m-%d') || 'T03:17:00Z' AS exported_at
        FROM (SELECT cast(executed_at AS DATE) AS d, count(*) AS n FROM trades GROUP BY 1) x
        WHERE d < DATE '2024-01-10'""", ("trades",)),
    "all_ledgers": ("SELECT * FROM ledger UNION ALL SELECT * FROM trades_ledger", ("ledger", "trades_ledger")),
    "ledger_days": ("""SELECT DISTINCT table_name, TRY_CAST(day AS DATE) AS day FROM all_ledgers
        WHERE TRY_CAST(day AS DATE) IS NOT NULL""", ("all_ledgers",)),
    "inventory": ("""SELECT 'ticks-' || cast(day AS VARCHAR) || '.csv.zst' AS file,
            cast(CASE WHEN extract(day FROM day) = 12 THEN n * 20 - 1 ELSE n * 20 END AS BIGINT) AS bytes,
            CASE WHEN extract(day FROM day) = 16 THEN repeat('b', 64) ELSE repeat('a', 64) END AS sha256
        FROM counts WHERE extract(day FROM day) <> 15""", ("counts",)),
    "trades_inventory": ("SELECT file, cast(bytes AS BIGINT) AS bytes, sha256 FROM trades_ledger", ("trades_ledger",)),
    "cfg": ("""SELECT * FROM (VALUES ('ticks', 6, true), ('trades', 30, false)) v(table_name, back_days, purged)""",
            ()),
    "scope": (f"""SELECT table_name, DATE '{P.TODAY}' - back AS lo, DATE '{P.TODAY}' + {P.FORWARD} AS hi
        FROM (SELECT table_name, CASE WHEN purged AND back_days >= 7 THEN 6 ELSE back_days END AS back FROM cfg) c""",
              ("cfg",)),
    "missing": ("""SELECT s.table_name, cast(g.d AS DATE) AS day
        FROM scope s, LATERAL (SELECT unnest(generate_series(s.lo, s.hi, INTERVAL 1 DAY)) AS d) g
        WHERE NOT EXISTS (SELECT 1 FROM all_leaves l WHERE l.table_name = s.table_name AND l.day = cast(g.d AS DATE))""",
                ("scope", "all_leaves")),
    "kept": ("""SELECT m.* FROM missing m WHERE NOT EXISTS
        (SELECT 1 FROM ledger_days d WHERE d.table_name = m.table_name AND d.day = m.day)""",
             ("missing", "ledger_days")),
    "anchors_rec(table_name, anchor)": ("""SELECT table_name, min(day) FROM kept GROUP BY table_name
        UNION ALL
        SELECT a.table_name, (SELECT min(k.day) FROM kept k WHERE k.table_name = a.table_name AND k.day > a.anchor + 13)
        FROM "anchors_rec" a WHERE a.anchor IS NOT NULL""", ("kept",)),
    "anchors": ("""SELECT table_name, anchor, anchor + 13 AS covers_until FROM anchors_rec WHERE anchor IS NOT NULL""",
                ("anchors_rec(table_name, anchor)",)),
    "first_gap": (f"""SELECT c.table_name, min(g.day) AS gap
        FROM cfg c, (SELECT cast(unnest(generate_series(DATE '{P.TODAY}', DATE '{P.TODAY}' + 400, INTERVAL 1 DAY))
                     AS DATE) AS day) g
        WHERE NOT EXISTS (SELECT 1 FROM all_leaves l WHERE l.table_name = c.table_name AND l.day = g.day)
        GROUP BY c.table_name""", ("cfg", "all_leaves")),
    "headroom": (f"""SELECT c.table_name,
            CASE WHEN f.gap IS NULL THEN 401 ELSE (SELECT count(*) FROM all_leaves l WHERE l.table_name = c.table_name
                 AND l.day >= DATE '{P.TODAY}' AND l.day < f.gap) END AS headroom,
            f.gap IS NULL AS capped
        FROM cfg c LEFT JOIN first_gap f ON f.table_name = c.table_name""", ("cfg", "first_gap")),
    "default_rows": ("""SELECT 'ticks' AS table_name, count(*) AS default_rows FROM ticks t WHERE NOT EXISTS
            (SELECT 1 FROM all_leaves l WHERE l.table_name = 'ticks' AND l.day = cast(t.bus_time AS DATE))
        UNION ALL
        SELECT 'trades', count(*) FROM trades t WHERE NOT EXISTS
            (SELECT 1 FROM all_leaves l WHERE l.table_name = 'trades' AND l.day = cast(t.executed_at AS DATE))""",
                     ("ticks", "trades", "all_leaves")),
    "sl": ("SELECT DISTINCT session_id, cast(bus_time AS DATE) AS day FROM trades", ("trades",)),
    "smiss": ("""SELECT s.session_id, cast(g.d AS DATE) AS day
        FROM (SELECT DISTINCT session_id FROM sl) s,
             (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d) g
        WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.session_id = s.session_id AND sl.day = cast(g.d AS DATE))""",
              ("sl",)),
    "sess_rec(session_id, anchor)": ("""SELECT session_id, min(day) FROM smiss GROUP BY session_id
        UNION ALL
        SELECT a.session_id, (SELECT min(k.day) FROM smiss k WHERE k.session_id = a.session_id AND k.day > a.anchor + 13)
        FROM "sess_rec" a WHERE a.anchor IS NOT NULL""", ("smiss",)),
    "log_lines": ("""SELECT event_type AS file, cast(event_id AS BIGINT) AS line_no,
        CASE WHEN event_id % 50 < 5 THEN '=== job 2024' WHEN value > 60 THEN 'WARN: slow'
             WHEN value < 1 THEN 'FAILED' ELSE 'OK' END AS line FROM events""", ()),
    "runs": ("""SELECT file, line_no, line, cast(sum(CASE WHEN regexp_matches(line, '^=== job [0-9]') THEN 1 ELSE 0 END)
            OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_no
        FROM log_lines""", ("log_lines",)),
    "problems": ("""SELECT file, run_no, count(*) AS n_lines,
            cast(count_if(regexp_matches(line, '^(ABORT|WARN:|[a-z]+: FAILED|gitlink: !!)')) AS BIGINT) AS n_problems,
            count_if(regexp_matches(line, '^(ABORT|WARN:|[a-z]+: FAILED|gitlink: !!)')) > 0 AS failed
        FROM runs WHERE run_no > 0 GROUP BY file, run_no""", ("runs",)),
    "c1m": ("""SELECT instrument, time_bucket(INTERVAL 1 MINUTE, bus_time) AS open_at,
            arg_min(price, (bus_time, id)) AS open, max(price) AS high, min(price) AS low,
            arg_max(price, (bus_time, id)) AS close, cast(count(*) AS DOUBLE) AS volume, count(*) AS trades
        FROM ticks GROUP BY 1, 2""", ("ticks",)),
}


def _line_ok(alias: str = "") -> str:
    a = alias + "." if alias else ""
    dd = f"try_strptime({a}day, '%Y-%m-%d')"
    digits = lambda c: f"coalesce(regexp_matches({a}{c}, '^[0-9]+$'), false)"
    strip = lambda c: f"CASE WHEN ltrim({a}{c}, '0') = '' THEN '0' ELSE ltrim({a}{c}, '0') END"
    lt = (f"(length({strip('bound_lower')}) < length({strip('bound_upper')}) OR "
          f"(length({strip('bound_lower')}) = length({strip('bound_upper')}) AND {strip('bound_lower')} < {strip('bound_upper')}))")
    day_ok = (f"(coalesce(regexp_matches({a}day, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'), false) AND {dd} IS NOT NULL "
              f"AND strftime({dd}, '%Y-%m-%d') = {a}day)")
    ts_ok = (f"({a}bound_lower = {a}day || 'T00:00:00Z' AND "
             f"{a}bound_upper = strftime({dd} + INTERVAL 1 DAY, '%Y-%m-%d') || 'T00:00:00Z')")
    bounds = f"(CASE WHEN {a}kind = 'trades' THEN coalesce({ts_ok}, false) ELSE {digits('bound_lower')} AND {digits('bound_upper')} AND coalesce({lt}, false) END)"
    return (f"coalesce({a}nf = 8 AND {a}file = {a}table_name || '-' || {a}day || '.csv.zst' AND coalesce({day_ok}, false) "
            f"AND {bounds} AND {digits('rows')} AND {digits('bytes')} "
            f"AND coalesce(regexp_matches({a}sha256, '^[0-9a-f]{{64}}$'), false) "
            f"AND coalesce(regexp_matches({a}exported_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$'), false), false)")


def _series(lo: str, hi: str) -> str:
    return f"(SELECT cast(unnest(generate_series(DATE '{lo}', DATE '{hi}', INTERVAL 1 DAY)) AS DATE) AS day)"


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEWS[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    names = _order(views)
    parts = [f'{n if "(" in n else n} AS ({VIEWS[n][0]})' for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    rec = "RECURSIVE " if any("(" in n for n in names) else ""
    return f"WITH {rec}" + ",\n".join(parts) + "\n" + body if parts else body


def _candles(src: str, timeframes: list[tuple[str, str]], cut: str) -> str:
    sel = []
    for tf, iv in timeframes:
        q = (f"SELECT instrument, '{tf}' AS timeframe, time_bucket(INTERVAL {iv}, open_at) AS open_at, "
             f"arg_min(open, open_at) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_at) AS close, "
             f"sum(volume) AS volume, cast(sum(trades) AS BIGINT) AS trades FROM {src} GROUP BY 1, 3")
        if tf == "1d":
            q = f"SELECT * FROM ({q}) d WHERE open_at >= {cut}"
        sel.append(q)
    return "\nUNION ALL\n".join(sel)


DERIVED = [("5m", "5 MINUTE"), ("15m", "15 MINUTE"), ("30m", "30 MINUTE"), ("1h", "1 HOUR"), ("4h", "4 HOUR"),
           ("1d", "1 DAY")]

DIGEST = ("SELECT cast(bus_time AS DATE) AS day, count(*) AS n_rows, cast(sum(('0x' || substr(sha256("
          "cast(id AS VARCHAR) || '|' || cast(epoch_us(bus_time) AS VARCHAR) || '|' || "
          "cast(cast(round(price * 100) AS BIGINT) AS VARCHAR)), 1, 15))::HUGEINT) AS VARCHAR) AS digest "
          "FROM ticks GROUP BY 1")


def _hi(day: str) -> str:
    import datetime as dt
    return (dt.date.fromisoformat(day) + dt.timedelta(days=1)).isoformat()


def _purge_sql(table: str, ledger: str, inventory: str, time_col: str, fact: str, lo: str, hi: str,
               armed: bool = True) -> str:
    """Purge plan rule in SQL: first failing check wins, per requested day of one table."""
    not_armed = "true" if (table == "trades" and not armed) else "false"
    return sql(f"""SELECT table_name, day, CASE WHEN reason = 'verified' THEN 'PURGE' ELSE 'REFUSE' END AS decision,
            reason, target, leaf_name, ledger_rows, table_rows FROM (
        SELECT r.table_name, r.day, t.target, t.leaf_name, TRY_CAST(p.rows AS BIGINT) AS ledger_rows,
            coalesce(c.table_rows, 0) AS table_rows,
            CASE WHEN coalesce(p.n_lines, 0) = 0 THEN 'no manifest line'
                 WHEN p.n_malformed > 0 THEN 'malformed manifest line'
                 WHEN p.n_lines > 1 THEN 'duplicate manifest lines'
                 WHEN NOT p.fields_ok THEN 'invalid manifest line'
                 WHEN i.file IS NULL THEN 'archive file missing'
                 WHEN i.sha256 <> p.sha256 THEN 'sha mismatch'
                 WHEN cast(i.bytes AS VARCHAR) <> p.bytes THEN 'size mismatch'
                 WHEN {not_armed} THEN 'purge not armed'
                 WHEN t.target = 'REFUSE' THEN 'no safe purge mapping'
                 WHEN t.target <> 'PARTITION' THEN 'no exact partition'
                 WHEN TRY_CAST(p.rows AS BIGINT) IS DISTINCT FROM coalesce(c.table_rows, 0) THEN 'row mismatch'
                 ELSE 'verified' END AS reason
        FROM (SELECT '{table}' AS table_name, day, strftime(day, '%Y-%m-%d') AS day_text
              FROM {_series(lo, hi)} g) r
        LEFT JOIN (SELECT table_name, day AS day_text, count(*) AS n_lines, count_if(nf <> 8) AS n_malformed,
                          arg_max(file, line_no) AS file, arg_max(rows, line_no) AS rows,
                          arg_max(bytes, line_no) AS bytes, arg_max(sha256, line_no) AS sha256,
                          arg_max(fields_ok, line_no) AS fields_ok
                   FROM (SELECT *, {_line_ok()} AS fields_ok FROM {ledger}) x GROUP BY 1, 2) p
          ON p.table_name = r.table_name AND p.day_text = r.day_text
        LEFT JOIN {inventory} i ON i.file = p.file
        LEFT JOIN tgt t ON t.table_name = r.table_name AND t.day = r.day
        LEFT JOIN (SELECT cast({time_col} AS DATE) AS day, count(*) AS table_rows FROM {fact}
                   WHERE {time_col} >= TIMESTAMP '{lo}' AND {time_col} < TIMESTAMP '{_hi(hi)}'
                   GROUP BY 1) c ON c.day = r.day) z""", ledger, inventory, "children", fact, extra={
        "tgt": f"""SELECT l.table_name, cast(l.bound_lower AS DATE) AS day, 'PARTITION' AS target, l.leaf_name
            FROM children l
            WHERE NOT l.is_default AND l.table_name = '{table}' AND (SELECT count(*) FROM children m
              WHERE NOT m.is_default AND m.table_name = l.table_name AND m.bound_lower = l.bound_lower) = 1
              AND l.bound_upper = l.bound_lower + INTERVAL 1 DAY
              AND l.bound_lower = cast(cast(l.bound_lower AS DATE) AS TIMESTAMP)
            UNION ALL
            SELECT '{table}', g.day, 'DEFAULT', '{table}_default' FROM {_series(lo, hi)} g
            WHERE NOT EXISTS (SELECT 1 FROM children c WHERE NOT c.is_default AND c.table_name = '{table}'
                              AND cast(c.bound_lower AS DATE) = g.day)
              AND EXISTS (SELECT 1 FROM children c WHERE c.is_default AND c.table_name = '{table}')"""})


_ARRIVED = {
    "drops": """SELECT *, cast(least((extract(day FROM bus_time) - 1) // 10, 2) AS BIGINT) + CASE WHEN id % 40 = 0 THEN 1 ELSE 0 END
                AS d FROM ticks""",
    "arrived": """SELECT a.*, coalesce(a.bus_time < (SELECT max(b.bus_time) FROM drops b WHERE b.d < a.d) - INTERVAL 1 DAY, false)
                  AS is_late FROM drops a""",
}

ORACLE: dict[str, str] = {
    "day_counts": sql("SELECT cast(bus_time AS DATE) AS day, count(*) AS n_rows FROM ticks GROUP BY 1", "ticks"),
    "day_slice": sql(f"SELECT * FROM ticks WHERE bus_time >= TIMESTAMP '{P.SLICE_FROM}' "
                     f"AND bus_time < TIMESTAMP '{P.SLICE_TO}'", "ticks"),
    "id_bounds": sql(f"""SELECT g.day, coalesce(min(t.id), 0) AS id_lower, coalesce(max(t.id), 0) + 1 AS id_upper,
        count(t.id) AS n_rows FROM {_series(P.BOUNDS_FROM, P.BOUNDS_TO)} g
        LEFT JOIN ticks t ON cast(t.bus_time AS DATE) = g.day GROUP BY g.day""", "ticks"),
    "oldest_day": sql("""SELECT 'ticks' AS table_name, cast(arg_min(bus_time, id) AS DATE) AS oldest_day FROM ticks
        UNION ALL SELECT 'trades', cast(arg_min(executed_at, id) AS DATE) FROM trades""", "ticks", "trades"),
    "missing_days": sql("SELECT table_name, day FROM missing", "missing"),
    "missing_days_unarchived": sql("SELECT table_name, day FROM kept", "kept"),
    "forward_headroom": sql("SELECT table_name, cast(headroom AS BIGINT) AS headroom, capped FROM headroom",
                            "headroom"),
    "contiguous_runs": sql("""SELECT table_name, min(day) AS run_start, max(day) AS run_end, count(*) AS n_days
        FROM (SELECT table_name, day, day - cast(row_number() OVER (PARTITION BY table_name ORDER BY day) AS INTEGER)
              AS isl FROM (SELECT DISTINCT table_name, day FROM all_leaves) d) x GROUP BY table_name, isl""",
                           "all_leaves"),
    "cover_anchors": sql("SELECT table_name, anchor, covers_until FROM anchors", "anchors"),
    "session_missing_days": sql(f"""SELECT s.session_id, g.day
        FROM (SELECT DISTINCT session_id FROM sl) s, {_series('2024-01-01', '2024-01-30')} g
        WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.session_id = s.session_id AND sl.day = g.day)""", "trades",
                                extra={"sl": "SELECT DISTINCT session_id, cast(bus_time AS DATE) AS day FROM trades"}),
    "session_anchors": sql("""SELECT session_id, anchor, anchor + 13 AS covers_until FROM sess_rec
        WHERE anchor IS NOT NULL""", "sess_rec(session_id, anchor)"),
    "session_runs": sql("""SELECT session_id, min(day) AS run_start, max(day) AS run_end, count(*) AS n_days
        FROM (SELECT session_id, day, day - cast(row_number() OVER (PARTITION BY session_id ORDER BY day) AS INTEGER)
              AS isl FROM sl) x GROUP BY session_id, isl""", "trades",
                        extra={"sl": "SELECT DISTINCT session_id, cast(bus_time AS DATE) AS day FROM trades"}),
    "leaf_catalog": sql("""SELECT table_name, leaf_name, cast(try_strptime(right(leaf_name, 8), '%Y%m%d') AS DATE) AS day
        FROM names WHERE regexp_matches(leaf_name, '^' || table_name || '_d[0-9]{8}$')
          AND try_strptime(right(leaf_name, 8), '%Y%m%d') IS NOT NULL""", "all_leaves",
                        extra={"names": """SELECT table_name, leaf_name FROM all_leaves
        UNION ALL SELECT DISTINCT table_name, table_name || '_default' FROM all_leaves
        UNION ALL SELECT DISTINCT table_name, table_name || '_d' || strftime(day, '%Y%m') || '32' FROM all_leaves
        UNION ALL SELECT table_name, table_name || '_d' || strftime(day, '%Y%m%d') || '_old' FROM all_leaves"""}),
    "read_days": sql("""SELECT t.* FROM ticks t WHERE t.bus_time >= TIMESTAMP '2024-01-01'
        AND t.bus_time < TIMESTAMP '2024-01-31' AND EXISTS (SELECT 1 FROM leaf l WHERE l.day = cast(t.bus_time AS DATE))""",
                     "ticks", "leaf"),
    "read_trades": sql(f"""SELECT public_id, bus_time AS "timestamp", known_to, session_id, sequence_id,
            instrument_public_id, trade_id, executed_at, price, size, side, id FROM trades
        WHERE executed_at >= TIMESTAMP '{P.SLICE_FROM}' AND executed_at < TIMESTAMP '{P.SLICE_TO}'""", "trades"),
    "reconcile_counts": sql("""SELECT coalesce(tc.table_name, led.table_name) AS table_name,
            coalesce(tc.day, led.day) AS day, tc.table_rows, led.ledger_rows, NULL::BIGINT AS archive_rows,
            coalesce(led.ledger_lines, 0) AS ledger_lines,
            CASE WHEN tc.table_rows IS NULL THEN 'not in table' WHEN led.ledger_lines IS NULL THEN 'not in ledger'
                 WHEN led.ledger_lines > 1 THEN 'ambiguous ledger'
                 WHEN tc.table_rows <> led.ledger_rows THEN 'row mismatch' ELSE 'ok' END AS status
        FROM (SELECT 'ticks' AS table_name, cast(bus_time AS DATE) AS day, count(*) AS table_rows FROM ticks GROUP BY 2) tc
        FULL OUTER JOIN (SELECT table_name, TRY_CAST(day AS DATE) AS day, count(*) AS ledger_lines,
                                max(TRY_CAST(rows AS BIGINT)) AS ledger_rows
                         FROM ledger WHERE TRY_CAST(day AS DATE) IS NOT NULL GROUP BY 1, 2) led
          ON tc.table_name = led.table_name AND tc.day = led.day""", "ticks", "ledger"),
    "ledger_health": sql("""SELECT table_name, day, count(*) AS n_lines, cast(count_if(nf <> 8) AS BIGINT) AS n_malformed,
            CASE WHEN count_if(nf <> 8) > 0 THEN 'malformed' WHEN count(*) > 1 THEN 'duplicate' ELSE 'single' END
            AS status FROM all_ledgers GROUP BY table_name, day""", "all_ledgers"),
    "manifest_valid": sql(f"""SELECT table_name, line_no, day, file, fields_ok,
            CASE WHEN nf <> 8 THEN 'malformed' WHEN NOT fields_ok THEN 'invalid' ELSE 'valid' END AS verdict
        FROM (SELECT *, {_line_ok()} AS fields_ok FROM all_ledgers) x""", "all_ledgers"),
    "skip_done_days": sql(f"""SELECT 'ticks' AS table_name, g.day,
            CASE WHEN EXISTS (SELECT 1 FROM ledger_days d WHERE d.table_name = 'ticks' AND d.day = g.day)
                 THEN 'done' ELSE 'todo' END AS status FROM {_series(P.BACKFILL_FROM, P.BACKFILL_TO)} g""",
                          "ledger_days"),
    "last_ledger_line": sql("""SELECT l.table_name, l.day, l.line_no, l.nf, l.file, l.rows, l.sha256 FROM all_ledgers l
        WHERE l.line_no = (SELECT max(m.line_no) FROM all_ledgers m WHERE m.table_name = l.table_name AND m.day = l.day)""",
                            "all_ledgers"),
    "resolve_purge_target": sql(f"""SELECT d.table_name, d.day,
            CASE WHEN e.n_exact > 1 OR e.n_other > 0 THEN 'REFUSE' WHEN e.n_exact = 1 THEN 'PARTITION'
                 WHEN f.default_leaf IS NOT NULL THEN 'DEFAULT' ELSE 'MISSING' END AS target,
            CASE WHEN e.n_exact > 1 OR e.n_other > 0 THEN '' WHEN e.n_exact = 1 THEN e.exact_leaf
                 WHEN f.default_leaf IS NOT NULL THEN f.default_leaf ELSE '' END AS leaf_name,
            CASE WHEN e.n_exact > 1 OR e.n_other > 0 THEN 1 WHEN e.n_exact = 1 THEN 2
                 WHEN f.default_leaf IS NOT NULL THEN 3 ELSE 4 END AS priority
        FROM (SELECT 'ticks' AS table_name, day FROM {_series(P.TARGET_FROM, P.TARGET_TO)} a
              UNION ALL SELECT 'trades', day FROM {_series(P.TARGET_FROM, P.TARGET_TO)} b) d
        LEFT JOIN exact e ON e.table_name = d.table_name AND e.day = d.day
        LEFT JOIN deflt f ON f.table_name = d.table_name""", "children", extra={
        "exact": """SELECT table_name, cast(bound_lower AS DATE) AS day, count(*) AS n_exact,
            count_if(kind <> 'r') AS n_other, min(leaf_name) AS exact_leaf FROM children
            WHERE NOT is_default AND bound_lower = cast(cast(bound_lower AS DATE) AS TIMESTAMP)
              AND bound_upper = cast(cast(bound_lower AS DATE) + 1 AS TIMESTAMP) GROUP BY 1, 2""",
        "deflt": "SELECT table_name, min(leaf_name) AS default_leaf FROM children WHERE is_default GROUP BY 1"}),
    "verify_archive": sql("""SELECT l.table_name, l.line_no, l.day, l.file,
            CASE WHEN i.file IS NULL THEN 'archive file missing' WHEN i.sha256 <> l.sha256 THEN 'sha mismatch'
                 WHEN cast(i.bytes AS VARCHAR) <> l.bytes THEN 'size mismatch' ELSE 'ok' END AS archive_verdict
        FROM ledger l LEFT JOIN inventory i ON i.file = l.file""", "ledger", "inventory"),
    "purge_plan": _purge_sql("ticks", "ledger", "inventory", "bus_time", "ticks", P.PURGE_FROM, P.PURGE_TO),
    "purge_plan_trades": _purge_sql("trades", "trades_ledger", "trades_inventory", "executed_at", "trades",
                                    P.TRADES_PURGE_FROM, P.TRADES_PURGE_TO),
    "staleness": sql(f"""SELECT j.job, max(s.success_at) AS last_success,
            coalesce(cast(floor((epoch(TIMESTAMP '{P.STALE_NOW}') - epoch(max(s.success_at))) / 86400) AS BIGINT), 9999)
              AS days_since,
            coalesce(cast(floor((epoch(TIMESTAMP '{P.STALE_NOW}') - epoch(max(s.success_at))) / 86400) AS BIGINT), 9999)
              > 2 AS stale
        FROM (VALUES ('ticks'), ('trades'), ('candles')) j(job)
        LEFT JOIN (SELECT table_name AS job, try_strptime(exported_at, '%Y-%m-%dT%H:%M:%SZ') AS success_at
                   FROM all_ledgers) s ON s.job = j.job GROUP BY j.job""", "all_ledgers"),
    "ledger_totals": sql("""SELECT * FROM (SELECT table_name, day, count(*) AS n_lines,
            cast(sum(TRY_CAST(rows AS BIGINT)) AS BIGINT) AS rows, cast(sum(TRY_CAST(bytes AS BIGINT)) AS BIGINT) AS bytes
        FROM all_ledgers GROUP BY ROLLUP (table_name, day)) x WHERE table_name IS NOT NULL""", "all_ledgers"),
    "route_rows": sql("""SELECT t.id, cast(t.bus_time AS DATE) AS day, coalesce(l.leaf_name, 'ticks_default') AS target
        FROM ticks t LEFT JOIN leaf l ON l.day = cast(t.bus_time AS DATE)""", "ticks", "leaf"),
    "default_rows": sql("SELECT * FROM default_rows", "default_rows"),
    "stream_route_default": sql("""SELECT t.id, cast(t.bus_time AS DATE) AS day FROM ticks t
        WHERE NOT EXISTS (SELECT 1 FROM leaf l WHERE l.day = cast(t.bus_time AS DATE))""", "ticks", "leaf"),
    "late_arrivals": sql("""SELECT cast(bus_time AS DATE) AS arrival_day,
            cast(date_diff('day', cast(executed_at AS DATE), cast(bus_time AS DATE)) AS BIGINT) AS lag_days,
            count(*) AS n_rows FROM trades WHERE cast(bus_time AS DATE) > cast(executed_at AS DATE) GROUP BY 1, 2""",
                         "trades"),
    "sealed_day_late_rows": sql("""SELECT t.id, cast(t.executed_at AS DATE) AS day, t.bus_time, t.executed_at
        FROM trades t JOIN (SELECT TRY_CAST(day AS DATE) AS day,
                                   min(try_strptime(exported_at, '%Y-%m-%dT%H:%M:%SZ')) AS exported_at
                            FROM trades_ledger WHERE TRY_CAST(day AS DATE) IS NOT NULL GROUP BY 1) s
          ON s.day = cast(t.executed_at AS DATE) WHERE t.bus_time > s.exported_at""", "trades", "trades_ledger"),
    "monotonicity_violations": sql("""SELECT id, executed_at, running_max FROM (SELECT id, executed_at,
            max(executed_at) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running_max
        FROM trades) x WHERE executed_at < running_max""", "trades"),
    "ticks_to_candles": sql("""SELECT instrument, '1h' AS timeframe, time_bucket(INTERVAL 1 HOUR, bus_time) AS open_at,
            arg_min(price, (bus_time, id)) AS open, max(price) AS high, min(price) AS low,
            arg_max(price, (bus_time, id)) AS close, cast(count(*) AS DOUBLE) AS volume, count(*) AS trades
        FROM ticks GROUP BY 1, 3""", "ticks"),
    "synthesize_candles": sql(_candles("src", DERIVED, f"TIMESTAMP '{P.SYNTH_CUT}'"), "c1m", extra={
        "src": f"SELECT * FROM c1m WHERE open_at >= TIMESTAMP '{P.SYNTH_START}' "
               f"AND open_at < TIMESTAMP '{_hi(P.SYNTH_END)}'"}),
    "close_versions": sql(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS known_from,
            l_extendedprice AS price,
            coalesce(lead(l_shipdate) OVER (PARTITION BY l_orderkey, l_linenumber
                                            ORDER BY l_shipdate, l_partkey, l_suppkey), {SENT}) AS known_to
        FROM lineitem"""),
    "closed_versions": sql(f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
            l_shipdate AS known_from, l_extendedprice AS price,
            coalesce(lead(l_shipdate) OVER (PARTITION BY l_orderkey, l_linenumber
                                            ORDER BY l_shipdate, l_partkey, l_suppkey), {SENT}) AS known_to
        FROM lineitem) v WHERE known_to < {SENT} AND known_from >= TIMESTAMP '{P.VERSIONS_FROM}'
          AND known_from < TIMESTAMP '{_hi(P.VERSIONS_TO)}'"""),
    "candle_upsert": sql(f"""
        SELECT instrument, timeframe, open_at, a_open AS open, a_high AS high, a_low AS low, a_close AS close,
               a_volume AS volume, a_trades AS trades, TIMESTAMP '{P.UPSERT_FIRST}' AS known_from,
               CASE WHEN n_open IS NOT NULL AND NOT same THEN TIMESTAMP '{P.UPSERT_AT}' ELSE {SENT} END AS known_to
        FROM j WHERE a_open IS NOT NULL
        UNION ALL
        SELECT instrument, timeframe, open_at, n_open, n_high, n_low, n_close, n_volume, n_trades,
               TIMESTAMP '{P.UPSERT_AT}', {SENT}
        FROM j WHERE n_open IS NOT NULL AND (a_open IS NULL OR NOT same)""", "ticks", extra={
        "bars1": """SELECT instrument, '1h' AS timeframe, time_bucket(INTERVAL 1 HOUR, bus_time) AS open_at,
            arg_min(price, (bus_time, id)) AS open, max(price) AS high, min(price) AS low,
            arg_max(price, (bus_time, id)) AS close, cast(count(*) AS DOUBLE) AS volume, count(*) AS trades
            FROM ticks WHERE extract(minute FROM bus_time) < 30 GROUP BY 1, 3""",
        "bars2": """SELECT instrument, '1h' AS timeframe, time_bucket(INTERVAL 1 HOUR, bus_time) AS open_at,
            arg_min(price, (bus_time, id)) AS open, max(price) AS high, min(price) AS low,
            arg_max(price, (bus_time, id)) AS close, cast(count(*) AS DOUBLE) AS volume, count(*) AS trades
            FROM ticks GROUP BY 1, 3""",
        "j": """SELECT coalesce(a.instrument, n.instrument) AS instrument, coalesce(a.timeframe, n.timeframe) AS timeframe,
            coalesce(a.open_at, n.open_at) AS open_at,
            a.open AS a_open, a.high AS a_high, a.low AS a_low, a.close AS a_close, a.volume AS a_volume,
            a.trades AS a_trades, n.open AS n_open, n.high AS n_high, n.low AS n_low, n.close AS n_close,
            n.volume AS n_volume, n.trades AS n_trades,
            (a.open IS NOT DISTINCT FROM n.open AND a.high IS NOT DISTINCT FROM n.high
             AND a.low IS NOT DISTINCT FROM n.low AND a.close IS NOT DISTINCT FROM n.close
             AND a.volume IS NOT DISTINCT FROM n.volume AND a.trades IS NOT DISTINCT FROM n.trades) AS same
            FROM bars1 a FULL OUTER JOIN bars2 n
              ON a.instrument = n.instrument AND a.timeframe = n.timeframe AND a.open_at = n.open_at"""}),
    "lookback_since": sql(f"""SELECT source, last_epoch, gap_days, greatest(gap_days, 4) AS lookback_days,
            cast(TIMESTAMP '{P.LOOKBACK_NOW}' AS DATE) - cast(greatest(gap_days, 4) AS INTEGER) AS since
        FROM (SELECT source, last_epoch,
                     coalesce(cast(floor((epoch(TIMESTAMP '{P.LOOKBACK_NOW}') - last_epoch) / 86400) AS BIGINT) + 1, 0)
                       AS gap_days
              FROM (SELECT instrument AS source, cast(floor(epoch(max(bus_time))) AS BIGINT) AS last_epoch
                    FROM ticks GROUP BY 1) s) g""", "ticks"),
    "day_content_digest": sql(DIGEST, "ticks"),
    "export_restore_roundtrip": sql(DIGEST, "ticks"),
    "export_ledger": sql("SELECT day, lo AS id_lower, hi AS id_upper, n AS n_rows, 8 AS nf FROM counts", "counts"),
    "restore_days": sql("SELECT * FROM ticks", "ticks"),
    "purge_plan_export": sql("""SELECT 'ticks' AS table_name, c.day,
            CASE WHEN l.day IS NULL THEN 'REFUSE' ELSE 'PURGE' END AS decision,
            CASE WHEN l.day IS NULL THEN 'no exact partition' ELSE 'verified' END AS reason,
            CASE WHEN l.day IS NULL THEN 'DEFAULT' ELSE 'PARTITION' END AS target,
            coalesce(l.leaf_name, 'ticks_default') AS leaf_name, c.n AS ledger_rows, c.n AS table_rows
        FROM counts c LEFT JOIN leaf l ON l.day = c.day""", "counts", "leaf"),
    "reconcile_export": sql("""SELECT 'ticks' AS table_name, day, n AS table_rows, n AS ledger_rows,
            n AS archive_rows, cast(1 AS BIGINT) AS ledger_lines, 'ok' AS status FROM counts""", "counts"),
    "segment_runs": sql("SELECT file, line_no, run_no FROM runs", "runs"),
    "problem_count": sql("SELECT * FROM problems", "problems"),
    "run_tail": sql("""SELECT file, run_no, line_no, line, from_end FROM (SELECT file, run_no, line_no, line,
            row_number() OVER (PARTITION BY file, run_no ORDER BY line_no DESC) AS from_end FROM runs
            WHERE run_no > 0 AND regexp_matches(line,
              '^(===|==|--|OK|WARN|ABORT|REFUSE|SKIP|refused:|FILE ROWCOUNT|purge mismatch)')) x
        WHERE from_end <= 40""", "runs"),
    "alert_body": sql("""SELECT file, run_no, line_no, line, from_end FROM (SELECT r.file, r.run_no, r.line_no, r.line,
            row_number() OVER (PARTITION BY r.file ORDER BY r.line_no DESC) AS from_end
        FROM runs r WHERE r.run_no = (SELECT max(m.run_no) FROM runs m WHERE m.file = r.file)
          AND regexp_matches(r.line,
              '^(===|==|--|OK|WARN|ABORT|REFUSE|SKIP|refused:|FILE ROWCOUNT|purge mismatch)')) x
        WHERE from_end <= 40""", "runs"),
    "failure_streaks": sql("""SELECT file, run_no, failed, streak, streak >= 2 AS alarm FROM (
        SELECT file, run_no, failed,
            cast(CASE WHEN failed THEN row_number() OVER (PARTITION BY file, g ORDER BY run_no)
                                       - CASE WHEN g > 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS streak
        FROM (SELECT file, run_no, failed, sum(CASE WHEN failed THEN 0 ELSE 1 END)
                OVER (PARTITION BY file ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
              FROM problems) x) y""", "problems"),
    "backfill_summary": sql(f"""SELECT 'ticks' AS table_name, cast(count_if(outcome = 'ok') AS BIGINT) AS ok,
            cast(count_if(outcome = 'skip') AS BIGINT) AS skip, cast(count_if(outcome = 'fail') AS BIGINT) AS fail,
            cast(count_if(outcome = 'not_attempted') AS BIGINT) AS not_attempted,
            cast(coalesce(sum(CASE WHEN outcome = 'ok' THEN floor((bytes + 1048575) / 1048576) END), 0) AS BIGINT) AS mb
        FROM (SELECT day, bytes, CASE WHEN first_fail IS NOT NULL AND day > first_fail THEN 'not_attempted'
                                     WHEN done THEN 'skip' WHEN NOT has_leaf THEN 'fail' ELSE 'ok' END AS outcome
              FROM (SELECT *, min(CASE WHEN NOT done AND NOT has_leaf THEN day END) OVER () AS first_fail
                    FROM (SELECT g.day, c.n * 20 AS bytes,
                                 EXISTS (SELECT 1 FROM ledger_days d WHERE d.table_name = 'ticks' AND d.day = g.day)
                                   AS done,
                                 EXISTS (SELECT 1 FROM leaf l WHERE l.day = g.day) AS has_leaf
                          FROM {_series(P.BACKFILL_FROM, P.BACKFILL_TO)} g LEFT JOIN counts c ON c.day = g.day) a) b) o""",
                            "ledger_days", "leaf", "counts"),
    "partition_coverage": sql("""SELECT c.table_name, cast(CASE WHEN c.purged AND c.back_days >= 7 THEN 6
                                            ELSE c.back_days END AS INTEGER) AS back_days,
            coalesce(m.missing, 0) AS missing, coalesce(d.dropped, 0) AS dropped, coalesce(a.anchors, 0) AS anchors,
            a.first_anchor, cast(h.headroom AS BIGINT) AS headroom, h.capped,
            coalesce(r.default_rows, 0) AS default_rows, coalesce(r.default_rows, 0) > 0 AS blocked,
            h.headroom < 7 AS failed
        FROM cfg c
        LEFT JOIN (SELECT table_name, count(*) AS missing FROM kept GROUP BY 1) m ON m.table_name = c.table_name
        LEFT JOIN (SELECT table_name, count(*) AS dropped FROM missing x WHERE EXISTS (SELECT 1 FROM ledger_days d
                   WHERE d.table_name = x.table_name AND d.day = x.day) GROUP BY 1) d ON d.table_name = c.table_name
        LEFT JOIN (SELECT table_name, count(*) AS anchors, min(anchor) AS first_anchor FROM anchors GROUP BY 1) a
          ON a.table_name = c.table_name
        LEFT JOIN headroom h ON h.table_name = c.table_name
        LEFT JOIN default_rows r ON r.table_name = c.table_name""",
                              "cfg", "kept", "missing", "ledger_days", "anchors", "headroom", "default_rows"),
    "retention_plan": sql(f"""SELECT 'ticks' AS table_name, day, seq,
            CASE WHEN EXISTS (SELECT 1 FROM ledger_days d WHERE d.table_name = 'ticks' AND d.day = x.day)
                 THEN 'purge' ELSE 'export+purge' END AS action
        FROM (SELECT cast(g.d AS DATE) AS day, cast(row_number() OVER (ORDER BY g.d) AS INTEGER) AS seq
              FROM (SELECT cast(arg_min(bus_time, id) AS DATE) AS oldest FROM ticks) o,
                   LATERAL (SELECT unnest(generate_series(o.oldest, DATE '{P.TODAY}' - 7, INTERVAL 1 DAY)) AS d) g) x
        WHERE seq <= {P.RETENTION_MAX_DAYS}""", "ticks", "ledger_days"),
    "candle_sweep": sql(f"""SELECT instrument, timeframe, open_at, id, known_from, known_to, close FROM (
        SELECT instrument, '1h' AS timeframe, time_bucket(INTERVAL 1 HOUR, bus_time) AS open_at, bus_time AS known_from,
               id, price AS close,
               coalesce(lead(bus_time) OVER (PARTITION BY instrument, time_bucket(INTERVAL 1 HOUR, bus_time)
                                             ORDER BY bus_time, id), {SENT}) AS known_to FROM ticks) v
        WHERE known_to < {SENT} AND open_at >= TIMESTAMP '{P.SWEEP_FROM}' AND open_at < TIMESTAMP '{_hi(P.SWEEP_TO)}'""",
                        "ticks"),
    "candle_ingest": sql("SELECT instrument, timeframe, open_at, open, high, low, close, volume FROM (" +
                         _candles("src", DERIVED, "(SELECT since FROM since)") + ") u", "c1m", "ticks", extra={
        "since": f"""SELECT min(cast(TIMESTAMP '{P.LOOKBACK_NOW}' AS DATE) - cast(greatest(coalesce(
                cast(floor((epoch(TIMESTAMP '{P.LOOKBACK_NOW}') - last_epoch) / 86400) AS BIGINT) + 1, 0), 4) AS INTEGER))
                AS since FROM (SELECT instrument, cast(floor(epoch(max(bus_time))) AS BIGINT) AS last_epoch
                               FROM ticks GROUP BY 1) s""",
        "src": f"""SELECT * FROM c1m WHERE open_at >= (SELECT since FROM since)
                   AND open_at < TIMESTAMP '{P.LOOKBACK_NOW}'::DATE + 1"""}),
    "candle_ingest_upsert": sql("""SELECT timeframe, count(*) AS n_bars, cast(1 AS BIGINT) AS max_active,
            cast(1 AS BIGINT) AS min_active, cast(1 AS BIGINT) AS max_versions
        FROM (SELECT instrument, timeframe, open_at FROM (""" + _candles("src", DERIVED, "(SELECT since FROM since)") + """) u
              UNION ALL SELECT instrument, '1m', open_at FROM (SELECT DISTINCT instrument, open_at FROM c1m
                        WHERE open_at >= (SELECT since FROM since)) m) x GROUP BY timeframe""", "c1m", "ticks", extra={
        "since": f"""SELECT min(cast(TIMESTAMP '{P.LOOKBACK_NOW}' AS DATE) - cast(greatest(coalesce(
                cast(floor((epoch(TIMESTAMP '{P.LOOKBACK_NOW}') - last_epoch) / 86400) AS BIGINT) + 1, 0), 4) AS INTEGER))
                AS since FROM (SELECT instrument, cast(floor(epoch(max(bus_time))) AS BIGINT) AS last_epoch
                               FROM ticks GROUP BY 1) s""",
        "src": f"""SELECT * FROM c1m WHERE open_at >= (SELECT since FROM since)
                   AND open_at < TIMESTAMP '{P.LOOKBACK_NOW}'::DATE + 1"""}),
    "export_strings_roundtrip": """WITH t AS (SELECT doc_id, doc_id % 10 AS k,
            TIMESTAMP '2024-01-01' + to_days(cast(doc_id % 5 AS INTEGER)) + to_seconds(cast(doc_id % 60 AS DOUBLE)) AS tm,
            CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  lead and trail  '
                 WHEN 3 THEN 'a "quoted", \\ "" text'
                 WHEN 4 THEN 'line' || chr(10) || 'feed' || chr(13) || chr(10) || 'return' || chr(13) || ' end'
                 ELSE text END AS text, lang FROM documents),
        h AS (SELECT cast(tm AS DATE) AS day, sha256(concat_ws('|', doc_id, epoch_us(tm), coalesce('=' || text, '~'),
                coalesce('=' || lang, '~'), CASE k WHEN 5 THEN 'nan' WHEN 6 THEN 'inf' WHEN 7 THEN '-inf' WHEN 8 THEN '~'
                ELSE cast(doc_id AS VARCHAR) END)) AS s FROM t)
        SELECT fmt, day, count(*) AS n_rows, cast(sum(cast(('0x' || substr(s, 1, 15)) AS HUGEINT)) AS VARCHAR) AS digest
        FROM h, (VALUES ('csv.gz'), ('csv.zst')) f(fmt) GROUP BY fmt, day""",
    "sweep_remainder": sql(f"""SELECT part, year, count(*) AS n_rows, cast(count_if(known_to = {SENT}) AS BIGINT) AS n_active
        FROM (SELECT cast(extract(year FROM known_from) AS BIGINT) AS year, known_to,
                CASE WHEN known_to < {SENT} AND known_from >= TIMESTAMP '{P.VERSIONS_FROM}'
                          AND known_from < TIMESTAMP '{_hi(P.VERSIONS_TO)}' THEN 'archived' ELSE 'remaining' END AS part
              FROM (SELECT l_shipdate AS known_from, coalesce(lead(l_shipdate) OVER (PARTITION BY l_orderkey, l_linenumber
                        ORDER BY l_shipdate, l_partkey, l_suppkey), {SENT}) AS known_to FROM lineitem) v) x
        GROUP BY part, year"""),
    "retention_run": f"""WITH d AS (SELECT DISTINCT cast(ts AS DATE) AS day FROM events
              WHERE cast(ts AS DATE) <= DATE '{P.TODAY}' - 7 AND extract(day FROM ts) <> 4
              UNION SELECT DATE '2024-01-02'),
        r AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM d)
        SELECT table_name, cast((n - 1) // 3 + 1 AS BIGINT) AS run, day, 'PURGE' AS decision, true AS dropped
        FROM r, (VALUES ('ticks'), ('trades')) t(table_name) WHERE n <= 9""",
    "archive_bytes": """WITH t AS (SELECT cast(ts AS DATE) AS day, event_id, event_type || ',' ||
                strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ',' || cast(cast(round(value * 100) AS BIGINT) AS VARCHAR) AS rest FROM events),
        f AS (SELECT day, 'id,instrument,bus_time,cents' || chr(10) ||
                string_agg(event_id || ',' || rest || chr(10), '' ORDER BY event_id) AS text FROM t GROUP BY day)
        SELECT day, cast(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM f""",
    "ledger_from_text": sql("""SELECT day, nf, cast(sum(n) AS BIGINT) AS n_lines, any_value(rows) AS last_rows, any_value(sha256) AS last_sha256
        FROM (SELECT day, 8 AS nf, count(*) + count_if(line_no % 20 = 11) AS n, CASE WHEN bool_or(line_no % 20 = 11)
                     THEN cast(cast(max(rows) AS BIGINT) + 1000 AS VARCHAR) ELSE max(rows) END AS rows, max(sha256) AS sha256
              FROM ledger WHERE nf = 8 GROUP BY day
              UNION ALL SELECT day, 9, 1, rows, sha256 FROM ledger WHERE nf = 8 AND line_no % 20 = 11
              UNION ALL SELECT day, 7, 1, rows, sha256 FROM ledger WHERE nf = 8 AND line_no % 20 = 11) x
        GROUP BY day, nf""", "ledger"),
    "run_logs_text": """SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS folder, cast(ts AS DATE) AS day,
            row_number() OVER (PARTITION BY event_id % 2, cast(ts AS DATE) ORDER BY event_id) AS line_no,
            cast(event_id AS VARCHAR) || ' ' || CASE WHEN event_id % 50 < 5 THEN '=== job 2024' WHEN value > 60 THEN 'WARN: slow'
                 WHEN value < 1 THEN 'FAILED' ELSE 'OK' END AS line FROM events""",
    "restore_job": sql(DIGEST, "ticks"),
    "stream_candles": sql("""SELECT instrument, '1h' AS timeframe, time_bucket(INTERVAL 1 HOUR, bus_time) AS open_at,
            arg_min(price, (bus_time, id)) AS open, max(price) AS high, min(price) AS low,
            arg_max(price, (bus_time, id)) AS close, cast(count(*) AS DOUBLE) AS volume, count(*) AS trades
        FROM ticks GROUP BY 1, 3""", "ticks"),
    "purge_catalog": """WITH n AS (SELECT cast(ts AS DATE) AS day, count(*) AS n, count_if(event_id % 10 = 0) AS late FROM events
              WHERE cast(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-06' GROUP BY 1)
        SELECT kind, day, extract(day FROM day) NOT IN (3, 4) AS dropped,
               cast(CASE extract(day FROM day) WHEN 3 THEN n WHEN 4 THEN n + late ELSE 0 END AS BIGINT) AS rows_left
        FROM n, (VALUES ('managed'), ('external')) k(kind)""",
    "sweep_apply": sql(f"""SELECT part, day, count(*) AS n_rows, cast(count_if(known_to = {SENT}) AS BIGINT) AS n_active,
               cast(sum(cast(round(close * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM (SELECT *, cast(open_at AS DATE) AS day, CASE WHEN known_to < {SENT} AND open_at >= TIMESTAMP '{P.SWEEP_FROM}'
                     AND open_at < TIMESTAMP '{_hi(P.SWEEP_TO)}' THEN 'archived' ELSE 'remaining' END AS part
              FROM (SELECT time_bucket(INTERVAL 1 HOUR, bus_time) AS open_at, price AS close,
                      coalesce(lead(bus_time) OVER (PARTITION BY instrument, time_bucket(INTERVAL 1 HOUR, bus_time)
                                                    ORDER BY bus_time, id), {SENT}) AS known_to FROM ticks) v) x
        GROUP BY part, day""", "ticks"),
    "ingest_table": sql("""SELECT timeframe, day, cast(count(*) * (CASE WHEN again THEN 2 ELSE 1 END) AS BIGINT) AS n_versions,
               count(*) AS n_active, count(*) AS n_bars,
               cast(sum(cast(round((close + CASE WHEN again THEN 1 ELSE 0 END) * 100) AS BIGINT)) AS BIGINT) AS cents,
               again AS rewritten
        FROM (SELECT timeframe, cast(open_at AS DATE) AS day, close, extract(day FROM open_at) % 5 = 0 AS again
              FROM (SELECT '1m' AS timeframe, open_at, close FROM c1m
                    UNION ALL SELECT '1h', time_bucket(INTERVAL 1 HOUR, bus_time), arg_max(price, (bus_time, id)) FROM ticks
                    GROUP BY instrument, 2) b) x GROUP BY timeframe, day, again""", "c1m", "ticks"),
    "restore_resumed": sql("SELECT * FROM (" + DIGEST + ") d WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-05'", "ticks"),
    "stream_late_bars": sql(f"""SELECT 'late' AS kind, instrument, bus_time AS at, price AS open, price AS high, price AS low,
               price AS close, cast(1 AS BIGINT) AS trades FROM arrived WHERE is_late
        UNION ALL
        SELECT 'bar', instrument, time_bucket(INTERVAL 1 HOUR, bus_time) AS open_at, arg_min(price, (bus_time, id)), max(price),
               min(price), arg_max(price, (bus_time, id)), count(*) FROM arrived WHERE NOT is_late
        GROUP BY instrument, open_at
        HAVING open_at + INTERVAL 1 HOUR <= (SELECT max(bus_time) - INTERVAL 1 DAY FROM arrived)""", "ticks", extra=_ARRIVED),
    "stream_sealed_days": sql("""SELECT id, cast(bus_time AS DATE) AS day, cast(d AS BIGINT) AS batch,
               CASE WHEN (d > 0 AND dom BETWEEN 1 AND 3) OR (d > 1 AND dom BETWEEN 9 AND 13) OR (d > 2 AND dom BETWEEN 19 AND 24)
                    THEN 'sealed' WHEN dom NOT IN (11, 22) THEN 'leaf' ELSE 'default' END AS target
        FROM (SELECT *, extract(day FROM bus_time) AS dom FROM arrived) a""", "ticks", extra=_ARRIVED),
    "session_day_words": sql("""SELECT 'missing' AS kind, session_id, day AS first_day, day AS last_day, cast(1 AS BIGINT) AS n_days
        FROM smiss
        UNION ALL SELECT 'run', session_id, min(day), max(day), count(*) FROM (SELECT session_id, day,
            day - cast(row_number() OVER (PARTITION BY session_id ORDER BY day) AS INTEGER) AS g FROM sl) x GROUP BY session_id, g""",
                             "smiss", "sl"),
    "footer_day_stats": sql("""SELECT c.day, n AS n_rows, lo AS id_lower, hi AS id_upper, l.day IS NOT NULL AS has_leaf
        FROM counts c LEFT JOIN leaf l ON c.day = l.day""", "counts", "leaf"),
    "trades_order": sql("""SELECT kind, day, n AS n_rows, n_parts, cast(0 AS BIGINT) AS inversions, cast(bad AS BIGINT) AS breaks,
               bad = 0 AS in_order
        FROM (SELECT *, CASE WHEN kind = 'swapped' AND extract(day FROM day) % 7 = 0 AND n_parts > 1 THEN 1 ELSE 0 END AS bad
              FROM (SELECT cast(executed_at AS DATE) AS day, count(*) AS n, (count(*) + 49) // 50 AS n_parts FROM trades GROUP BY 1) t,
                   (VALUES ('written'), ('swapped')) k(kind)) x""", "trades"),
}
