"""DuckDB SQL giving the expected result of each named query.

The SQL restates the rules over the values that the log was made from; it parses
no payload and shares no logic with the Spark code, only the fixed values.
"""

from matchlens.functions.costs import COSTS, RESOURCES
from matchlens.functions.milestones import KEY_TECHS
from matchlens.functions.units import UNIT_PATTERNS
from matchlens.sources.events import BUILDINGS, MARKET, TECHS, UNITS

W = 60_000_000  # one minute in microseconds


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_ACTIONS = f"""
raw AS (
  SELECT event_id AS seq, user_id // 8 AS match_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 720 AS t_us
  FROM events),
actions AS (
  SELECT match_id, seq, t_us, k, event_type, value,
         CASE WHEN k <> 99 THEN CAST(user_id % 8 + 1 AS INTEGER) END AS player,
         CASE event_type
           WHEN 'click' THEN 'DE_QUEUE'
           WHEN 'view' THEN CASE WHEN k % 4 = 0 THEN 'MULTIQUEUE' ELSE 'ORDER' END
           WHEN 'signup' THEN 'BUILD'
           WHEN 'purchase' THEN 'RESEARCH'
           WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END
         END AS type,
         CASE WHEN event_type IN ('click', 'view') THEN ({_list(UNITS)})[k % 20 + 1] END AS unit,
         CASE WHEN event_type = 'signup' THEN ({_list(BUILDINGS)})[k % 8 + 1] END AS building,
         CASE WHEN event_type = 'purchase' THEN ({_list(TECHS)})[k % 10 + 1] END AS tech,
         CASE WHEN event_type = 'error' THEN ({_list(MARKET)})[(k // 2) % 4 + 1] END AS res,
         1 + k % 5 AS items
  FROM raw),
matches AS (SELECT match_id, max(t_us) AS duration_us FROM actions GROUP BY match_id),
players AS (
  SELECT match_id, CAST(p AS INTEGER) AS player,
         'P' || match_id || '_' || p AS name
  FROM matches, range(1, 9) AS r(p))"""

_COSTS = (
    "costs(kind, prio, key, food, wood, gold, stone) AS (VALUES "
    + ", ".join(
        f"('{kind}', {i}, '{name}', {f}, {w}, {g}, {s})"
        for i, (kind, name, f, w, g, s) in enumerate(COSTS)
    )
    + ")"
)

_NAMED = """
named AS (
  SELECT *, CASE WHEN type IN ('DE_QUEUE', 'ORDER') THEN 'unit'
                 WHEN type = 'BUILD' THEN 'building'
                 WHEN type = 'RESEARCH' THEN 'tech' END AS kind,
         CASE WHEN type IN ('DE_QUEUE', 'ORDER') AND seq % 4 = 3 THEN '{"name":"' || unit || '"}'
              WHEN type IN ('DE_QUEUE', 'ORDER') THEN unit
              WHEN type = 'BUILD' THEN building
              WHEN type = 'RESEARCH' THEN tech END AS cname
  FROM actions),
names AS (SELECT DISTINCT kind, cname FROM named WHERE kind IS NOT NULL),
ranked AS (
  SELECT n.kind, n.cname, c.*  EXCLUDE (kind),
         row_number() OVER (PARTITION BY n.kind, n.cname
                            ORDER BY c.key <> lower(n.cname), c.prio) AS rn
  FROM names n JOIN costs c
    ON c.kind = n.kind AND (contains(lower(n.cname), c.key) OR contains(c.key, lower(n.cname)))),
lookup AS (SELECT * FROM ranked WHERE rn = 1)"""

_DELTAS = """
deltas AS (
  SELECT a.match_id, a.seq, a.player, a.t_us,
         -l.food * f AS food, -l.wood * f AS wood, -l.gold * f AS gold, -l.stone * f AS stone
  FROM (SELECT *, CASE WHEN kind = 'unit' AND seq % 4 = 0 THEN items ELSE 1 END AS f
        FROM named) a
  JOIN lookup l ON l.kind = a.kind AND l.cname = a.cname
  WHERE a.player IS NOT NULL
  UNION ALL
  SELECT match_id, seq, player, t_us,
         CASE WHEN res = 'food' THEN s ELSE 0 END, CASE WHEN res = 'wood' THEN s ELSE 0 END,
         CASE WHEN res = 'gold' THEN s ELSE 0 END, CASE WHEN res = 'stone' THEN s ELSE 0 END
  FROM (SELECT *, CASE WHEN type = 'BUY' THEN 100 ELSE -100 END AS s FROM actions)
  WHERE type IN ('BUY', 'SELL') AND player IS NOT NULL)"""

_PRICED = ",".join([_ACTIONS, _COSTS, _NAMED, _DELTAS])

_BASE = (
    f"lower(CASE p_partkey % 3 WHEN 0 THEN ({_list(UNITS)})[p_partkey % {len(UNITS)} + 1] "
    f"WHEN 1 THEN ({_list(BUILDINGS)})[p_partkey % {len(BUILDINGS)} + 1] "
    f"ELSE ({_list(TECHS)})[p_partkey % {len(TECHS)} + 1] END)"
)
_OWN_COSTS = f"""
costs AS (
  SELECT (['unit', 'building', 'tech'])[p_partkey % 3 + 1] AS kind,
         p_partkey * 7919 % 1000003 AS prio,
         CASE WHEN p_partkey % 7 = 0 THEN {_BASE} || ' ' || p_name
              WHEN p_partkey % 7 = 1 THEN left({_BASE}, 3 + p_size % 4)
              WHEN p_partkey % 7 = 2 AND p_partkey % 5 = 0 THEN {_BASE}
              ELSE p_name || ' ' || p_partkey END AS key,
         p_size AS food, p_partkey % 13 AS wood, p_partkey % 101 AS gold, 0 AS stone
  FROM part)"""
_OWN_PRICED = ",".join([_ACTIONS, _OWN_COSTS, _NAMED, _DELTAS])

_PROD = "type IN ('DE_QUEUE', 'MULTIQUEUE', 'ORDER')"

_VILLAGERS = f"""
vill AS (
  SELECT * FROM actions
  WHERE {_PROD} AND player IS NOT NULL AND unit IN ('Villager', 'Aldeano')),
gaps AS (
  SELECT match_id, player, seq, t_us,
         t_us - lag(t_us) OVER (PARTITION BY match_id, player ORDER BY seq) AS gap_us
  FROM vill),
incs AS (
  SELECT match_id, player, t_us, gap_us - 25000000 AS v FROM gaps WHERE gap_us > 27000000)"""


def _windows(src: str, w: int = W) -> str:
    """CTEs for the windows of ``src(match_id, player, t_us, v)``."""
    return f"""
src AS ({src}),
scope AS (SELECT match_id, (max(t_us) + {w - 1}) // {w} AS n FROM src GROUP BY match_id),
who AS (SELECT DISTINCT match_id, player FROM src WHERE player IS NOT NULL),
grid AS (SELECT match_id, player, n, unnest(range(n)) AS bin FROM who JOIN scope USING (match_id)),
sums AS (
  SELECT match_id, player, least(t_us // {w}, n - 1) AS bin, CAST(sum(v) AS BIGINT) AS v
  FROM src JOIN scope USING (match_id) GROUP BY ALL),
dense AS (
  SELECT match_id, player, n, bin, coalesce(v, 0) AS v
  FROM grid LEFT JOIN sums USING (match_id, player, bin))"""


def _series(value: str, w_s: int = 60, of: str = "dense", more: str = "") -> str:
    return (
        f"SELECT match_id, CAST(bin * {w_s} AS BIGINT) AS time_sec, player, "
        f"{value} AS value{more} FROM {of}"
    )


_RUNNING = "sum(v) OVER (PARTITION BY match_id, player ORDER BY bin)"

_APM = "SELECT match_id, player, t_us, 1 AS v FROM actions WHERE player IS NOT NULL"


def _apm(w_s: int = 60) -> str:
    return (
        f"WITH {_ACTIONS}, {_windows(_APM, w_s * 1_000_000)} "
        + _series(f"CAST(v * 60 AS DOUBLE) / {w_s}", w_s)
    )


def _stats(src: str) -> str:
    return f"""
stats AS (
  SELECT match_id, player, any_value(n) AS n,
         CAST(sum(v) AS BIGINT) AS s1, CAST(sum(v * v) AS BIGINT) AS s2, max(v) AS top
  FROM {src} GROUP BY match_id, player)"""


def _spend(r: str) -> str:
    src = f"SELECT match_id, player, t_us, -{r} AS v FROM deltas WHERE {r} < 0"
    return f"WITH {_PRICED}, {_windows(src)} " + _series("CAST(v AS BIGINT)")


def _balance(r: str) -> str:
    src = f"SELECT match_id, player, t_us, {r} AS v FROM deltas"
    return f"WITH {_PRICED}, {_windows(src)} " + _series(f"CAST({_RUNNING} AS BIGINT)")


_SPENT = " + ".join(f"greatest(-{r}, 0)" for r in RESOURCES)
_TOTAL = f"SELECT match_id, player, t_us, {_SPENT} AS v FROM deltas WHERE {_SPENT} > 0"
_CHANGE = "SELECT match_id, player, t_us, food + wood + gold + stone AS v FROM deltas"

_SNAPSHOTS = """
snaps AS (
  SELECT match_id, player, seq, t_us, value AS total_res
  FROM actions WHERE event_type = 'view' AND match_id % 2 = 0),
s_scope AS (
  SELECT match_id, (max(t_us) + {1}) // {0} AS n FROM snaps GROUP BY match_id),
s_edges AS (
  SELECT match_id, player, n, unnest(range(n + 1)) AS bin
  FROM (SELECT DISTINCT match_id, player FROM snaps WHERE player IS NOT NULL)
  JOIN s_scope USING (match_id)),
s_known AS (
  SELECT e.match_id, e.player, e.n, e.bin, s.total_res AS v
  FROM (SELECT *, bin * {0} AS t_us FROM s_edges) e ASOF LEFT JOIN snaps s
    ON s.match_id = e.match_id AND s.player = e.player AND s.t_us <= e.t_us),
s_filled AS (
  SELECT match_id, player, n, bin,
         coalesce(first_value(v IGNORE NULLS) OVER (
           PARTITION BY match_id, player ORDER BY bin
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS v
  FROM s_known),
stock AS (SELECT * FROM s_filled WHERE bin < n)""".format(W, W - 1)

_EVENTS = f"""
labelled AS (
  SELECT match_id, player, t_us, type, coalesce(tech, building) AS label,
         lower(coalesce(tech, building)) AS low
  FROM actions WHERE player IS NOT NULL AND type IN ('RESEARCH', 'BUILD')),
kinds AS (
  SELECT *, CASE
    WHEN type = 'BUILD' THEN CASE low WHEN 'castle' THEN 'castle' WHEN 'town center' THEN 'tc' END
    WHEN low IN ('feudal age', 'castle age', 'imperial age') THEN 'age'
    WHEN starts_with(low, 'elite ') THEN 'elite'
    WHEN {" OR ".join(f"contains(low, '{t}')" for t in KEY_TECHS)} THEN 'tech' END AS kind
  FROM labelled),
firsts AS (
  SELECT match_id, player, min(t_us) AS t_us, label, kind, CASE kind
      WHEN 'age' THEN upper(left(label, 1)) WHEN 'castle' THEN 'C' WHEN 'elite' THEN 'E'
      WHEN 'tech' THEN 'T' WHEN 'tc' THEN 'TC' END AS code
  FROM kinds WHERE kind IS NOT NULL GROUP BY match_id, player, label, kind)"""

_TOTALS = """
totals AS (
  SELECT match_id, CAST(player AS BIGINT) AS player,
         CAST(100 * count(*) FILTER (event_type = 'click') AS DOUBLE) AS food,
         CAST(100 * count(*) FILTER (event_type = 'view') AS DOUBLE) AS wood,
         CAST(100 * count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS gold,
         CAST(100 * count(*) FILTER (event_type = 'error') AS DOUBLE) AS stone
  FROM actions WHERE player IS NOT NULL GROUP BY match_id, player)"""

_COUNTS = f"""
WITH {_ACTIONS}, {_VILLAGERS}
SELECT match_id, player, CAST(coalesce(v, 0) AS BIGINT) AS villagers
FROM players LEFT JOIN
  (SELECT match_id, player, sum(items) AS v FROM vill GROUP BY ALL) USING (match_id, player)"""


def _ramp(r: str) -> str:
    return f"""
WITH {_ACTIONS}, {_TOTALS}, scope AS (
  SELECT match_id, (duration_us + {W - 1}) // {W} AS n FROM matches),
ramp AS (
  SELECT p.match_id, p.player, coalesce(t.{r}, 0.0) AS total, n, unnest(range(n)) AS bin
  FROM players p JOIN scope USING (match_id)
  LEFT JOIN totals t ON t.match_id = p.match_id AND t.player = p.player)
{_series('''CASE WHEN bin = 0 THEN 0.0 WHEN bin = n - 1 THEN total
         ELSE CAST(bin AS DOUBLE) * (total / CAST(n - 1 AS DOUBLE)) END''', of="ramp")}"""


def _noted(is_match: str) -> str:
    return f"""
WITH {_ACTIONS}, vill AS (
  SELECT match_id, player, CAST(sum(items) AS BIGINT) AS v FROM actions
  WHERE {_PROD} AND player IS NOT NULL AND ({is_match}) GROUP BY ALL)
SELECT match_id, player, coalesce(v, 0) AS villagers
FROM players LEFT JOIN vill USING (match_id, player)"""


def _pattern_hits(patterns: dict[str, str]) -> str:
    listed = ", ".join(f"('{u}', '{p}')" for u, p in patterns.items())
    return f"""
WITH {_ACTIONS}, patterns(name, pattern) AS (VALUES {listed})
SELECT match_id, p.name AS unit, count(*) AS n, CAST(sum(items) AS BIGINT) AS items
FROM actions a JOIN patterns p ON regexp_matches(a.unit, p.pattern, 'i')
WHERE {_PROD} AND player IS NOT NULL GROUP BY ALL"""


def _rounded(summary: str) -> str:
    places = ", ".join(
        f"CAST(round(CAST({c} AS DECIMAL(30, 10)), 1) AS DOUBLE) AS {c}"
        for c in ("tc_idle_s", "tc_idle_pct", "apm_mean", "apm_peak")
    )
    return f"SELECT match_id, player, name, villagers_trained, {places} FROM ({summary})"


def _all_deltas(priced: str) -> str:
    return f"""
WITH {priced}
SELECT match_id, seq, player, t_us, CAST(food AS BIGINT) AS food, CAST(wood AS BIGINT) AS wood,
       CAST(gold AS BIGINT) AS gold, CAST(stone AS BIGINT) AS stone
FROM deltas"""


def _lookup(costs: str) -> str:
    return f"""
WITH {_ACTIONS}, {costs}, {_NAMED}
SELECT n.kind, n.cname AS name, l.key AS matched, CAST(l.food AS BIGINT) AS food,
       CAST(l.wood AS BIGINT) AS wood, CAST(l.gold AS BIGINT) AS gold,
       CAST(l.stone AS BIGINT) AS stone
FROM names n LEFT JOIN lookup l USING (kind, cname)"""


_OWN_PATTERNS = rf"""
own AS (
  SELECT CASE WHEN p_partkey = 42 THEN 'Villager' ELSE 'Line ' || p_partkey END AS name,
         CASE WHEN p_partkey % 100 = 7
                THEN lower(left(({_list(UNITS)})[p_partkey % 20 + 1], 4)) || '|' || replace(p_name, ' ', '\s*')
              WHEN p_partkey % 100 = 8
                THEN regexp_replace(({_list(UNITS)})[p_partkey % 20 + 1], '[- ]', '.?', 'g') || '$'
              ELSE replace(p_name, ' ', '\s*') || '|' || p_brand END AS pattern
  FROM part),
defaults(name, pattern) AS (VALUES {", ".join(f"('{u}', '{p}')" for u, p in UNIT_PATTERNS.items())}),
patterns AS (
  SELECT * FROM own UNION ALL
  SELECT * FROM defaults WHERE name NOT IN (SELECT name FROM own)),
found AS (
  SELECT DISTINCT u.unit, p.name FROM (SELECT DISTINCT unit FROM actions WHERE unit IS NOT NULL) u
  JOIN patterns p ON regexp_matches(u.unit, p.pattern, 'i'))"""

_IS_VILLAGER = "unit IN ('Villager', 'Aldeano')"


def all_oracles() -> dict[str, str]:
    sql = {
        "prod_events": f"""
WITH {_ACTIONS} SELECT match_id, seq, player, t_us, type FROM actions WHERE {_PROD}""",
        "unit_names": f"""
WITH {_ACTIONS}
SELECT match_id, seq, CASE WHEN seq % 4 <> 0 THEN unit END AS name FROM actions WHERE {_PROD}""",
        "unit_pattern_hits": _pattern_hits(UNIT_PATTERNS),
        "unit_string_hits": f"""
WITH {_ACTIONS}, hits AS (
  SELECT match_id, seq, type, coalesce(unit, building, tech) AS hit,
         row_number() OVER (PARTITION BY match_id ORDER BY seq) AS rn
  FROM actions WHERE type NOT IN ('BUY', 'SELL') AND regexp_matches(
    coalesce(unit, building, tech),
    'villag|aldean|archer|arquero|skirm|militia|milicia|scout|explor', 'i'))
SELECT match_id, seq, type, hit FROM hits WHERE rn <= 20""",
        "action_type_counts": f"""
WITH {_ACTIONS} SELECT match_id, type, count(*) AS n FROM actions GROUP BY ALL""",
        "action_samples": f"""
WITH {_ACTIONS}, sampled AS (
  SELECT *, CASE WHEN contains(type, 'QUEUE') THEN 'DE_QUEUE' ELSE type END AS kind FROM actions
  WHERE type NOT IN ('BUY', 'SELL')),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY match_id, kind ORDER BY seq) AS r FROM sampled)
SELECT match_id, kind, CAST(r AS INTEGER) AS rn, seq, type, player FROM numbered WHERE r <= 10""",
        "apm_timeseries": _apm(),
        "apm_timeseries_15s": _apm(15),
        "apm_named": f"""
WITH {_ACTIONS}, {_windows(_APM)}
{_series("CAST(v * 60 AS DOUBLE) / 60", more=", name",
         of="dense JOIN players USING (match_id, player)")}""",
        "apm_stats": f"""
WITH {_ACTIONS}, {_windows(_APM)}, {_stats("dense")}
SELECT match_id, player, CAST(s1 * 60 AS DOUBLE) / (n * 60) AS apm_mean,
       CASE WHEN n > 1 THEN
         sqrt(CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) * 1.0::DOUBLE
       END AS apm_sd,
       CAST(top * 60 AS DOUBLE) / 60 AS apm_peak
FROM stats""",
        "villager_counts": _COUNTS,
        "villager_counts_strict": _COUNTS,
        "units_created_timeseries": f"""
WITH {_ACTIONS}, {_VILLAGERS},
{_windows("SELECT match_id, player, t_us, items AS v FROM vill")}
{_series("CAST(v AS BIGINT)")}""",
        "units_created_selected": f"""
WITH {_ACTIONS}, {_windows(f'''
  SELECT match_id, player, t_us, items AS v FROM actions
  WHERE {_PROD} AND player IS NOT NULL AND unit IN ('Scout Cavalry', 'Eagle Scout')''', 2 * W)}
{_series("CAST(v AS BIGINT)", 120)} WHERE player IN (1, 3, 5)""",
        "villager_gaps": f"""
WITH {_ACTIONS}, {_VILLAGERS} SELECT match_id, player, seq, t_us, gap_us FROM gaps""",
        "tc_idle_time": f"""
WITH {_ACTIONS}, {_VILLAGERS}
SELECT match_id, player, coalesce(CAST(v AS DOUBLE) / 1000000, 0.0) AS idle_s
FROM players LEFT JOIN
  (SELECT match_id, player, CAST(sum(v) AS BIGINT) AS v FROM incs GROUP BY ALL)
  USING (match_id, player)""",
        "tc_idle_cumulative": f"""
WITH {_ACTIONS}, {_VILLAGERS}, {_windows("SELECT * FROM incs")},
known AS (
  SELECT g.match_id, g.player, g.bin, coalesce(CAST(sum(i.v) AS BIGINT), 0) AS v
  FROM grid g LEFT JOIN incs i
    ON i.match_id = g.match_id AND i.player = g.player AND i.t_us <= g.bin * {W}
  GROUP BY ALL)
{_series("CAST(v AS DOUBLE) / 1000000", of="known")}""",
        "cost_lookup": _lookup(_COSTS),
        "resource_deltas": _all_deltas(_PRICED),
        "total_spend_cumulative": f"""
WITH {_PRICED}, {_windows(_TOTAL)} {_series(f"CAST({_RUNNING} AS BIGINT)")}""",
        "total_spend_per_window": f"""
WITH {_PRICED}, {_windows(_TOTAL)} {_series("CAST(v AS BIGINT)")}""",
        "approx_total_balance": f"""
WITH {_PRICED}, {_windows(_CHANGE)} {_series(f"CAST({_RUNNING} + 700 AS BIGINT)")}""",
        "resource_has_data": f"""
WITH {_PRICED}, spent AS (
  {" UNION ALL ".join(
      f"SELECT match_id, '{r}' AS resource, {r} AS v FROM deltas WHERE {r} < 0"
      for r in RESOURCES)})
SELECT m.match_id, r.resource, count(s.v) > 0 AS has_data
FROM matches m CROSS JOIN (VALUES ('food'), ('wood'), ('gold'), ('stone')) r(resource)
LEFT JOIN spent s ON s.match_id = m.match_id AND s.resource = r.resource GROUP BY ALL""",
        "important_events": f"""
WITH {_ACTIONS}, {_EVENTS} SELECT match_id, player, t_us, label, kind, code FROM firsts""",
        "events_tc_age": f"""
WITH {_ACTIONS}, {_EVENTS}
SELECT match_id, player, t_us, label, kind, code FROM firsts WHERE kind IN ('tc', 'age')""",
        "sync_stock": f"WITH {_ACTIONS}, {_SNAPSHOTS} {_series('v', of='stock')}",
        "stock_total": f"""
WITH {_PRICED}, {_SNAPSHOTS}, {_windows(_CHANGE)}
{_series("v", of="stock")}
UNION ALL
SELECT * FROM ({_series(f"CAST({_RUNNING} + 700 AS DOUBLE)")})
WHERE match_id NOT IN (SELECT match_id FROM stock)""",
        "postgame_totals": f"""
WITH {_ACTIONS}, {_TOTALS} SELECT match_id, player, food, wood, gold, stone FROM totals""",
        "player_summary": f"""
WITH {_ACTIONS}, {_VILLAGERS}, {_windows(_APM)}, {_stats("dense")},
idle AS (
  SELECT match_id, player, CAST(CAST(sum(v) AS BIGINT) AS DOUBLE) / 1000000 AS idle_s
  FROM incs GROUP BY ALL),
trained AS (SELECT match_id, player, CAST(sum(items) AS BIGINT) AS v FROM vill GROUP BY ALL)
SELECT p.match_id, p.player, p.name, coalesce(t.v, 0) AS villagers_trained,
       coalesce(i.idle_s, 0.0) AS tc_idle_s,
       CASE WHEN m.duration_us > 0 THEN 100.0::DOUBLE * coalesce(i.idle_s, 0.0)
         / (CAST(m.duration_us AS DOUBLE) / 1000000) END AS tc_idle_pct,
       CAST(s.s1 * 60 AS DOUBLE) / (s.n * 60) AS apm_mean,
       CAST(s.top * 60 AS DOUBLE) / 60 AS apm_peak
FROM players p JOIN matches m USING (match_id)
LEFT JOIN trained t USING (match_id, player) LEFT JOIN idle i USING (match_id, player)
LEFT JOIN stats s USING (match_id, player)""",
        "match_summary": f"""
WITH {_ACTIONS}, listed AS (
  SELECT match_id, CAST(count(*) AS INTEGER) AS n_players,
         CAST(to_json(list({{'name': name, 'civilization': NULL, 'winner': NULL, 'eapm': NULL}}
                           ORDER BY player)) AS VARCHAR) AS players_json
  FROM players GROUP BY match_id)
SELECT match_id, CAST(duration_us AS DOUBLE) / 1000000 AS duration_s, n_players, players_json
FROM matches JOIN listed USING (match_id)""",
    }
    own = {"Villager": "villager", "Gatherer": "villager|aldean"}
    sql |= {
        "cost_lookup_own": _lookup(_OWN_COSTS),
        "resource_deltas_own": _all_deltas(_OWN_PRICED),
        "unit_pattern_hits_table": f"""
WITH {_ACTIONS}, {_OWN_PATTERNS}
SELECT match_id, f.name AS unit, count(*) AS n, CAST(sum(items) AS BIGINT) AS items
FROM actions a JOIN found f USING (unit) WHERE {_PROD} AND player IS NOT NULL GROUP BY ALL""",
        "unit_pattern_hits_own": _pattern_hits(
            own | {u: p for u, p in UNIT_PATTERNS.items() if u not in own}
        ),
        "villager_names": f"""
WITH {_ACTIONS}
SELECT match_id, seq, CASE WHEN seq % 4 <> 0 THEN unit END AS name,
       seq % 4 <> 0 AND {_IS_VILLAGER} AS is_villager
FROM actions WHERE {_PROD}""",
        "villager_counts_noted": _noted(f"{_IS_VILLAGER} OR seq % 3 = 1"),
        "villager_counts_noted_strict": _noted(
            f"{_IS_VILLAGER} OR (seq % 3 = 1 AND seq % 4 = 0)"
        ),
        "villager_counts_repeated_keys": _COUNTS,
        "apm_selected_or_all": f"""
WITH {_ACTIONS}, {_windows("""
  SELECT match_id, player, t_us, 1 AS v FROM actions
  WHERE player IS NOT NULL AND NOT (match_id % 2 = 1 AND player = 1)""")},
chosen AS (SELECT match_id, bool_or(player = 1) AS one FROM who GROUP BY match_id)
{_series("CAST(v * 60 AS DOUBLE) / 60", of="dense JOIN chosen USING (match_id)")}
WHERE player = 1 OR NOT one""",
        "actions_rejected": f"""
WITH {_ACTIONS}
SELECT true AS source_file, CASE seq % 100 WHEN 14 THEN 'no match_id' ELSE 'malformed' END AS reason,
       CASE seq % 100 WHEN 13 THEN '{{"match_id":' || match_id || ',"seq":' || seq
                      WHEN 14 THEN '{{"seq":' || seq || '}}'
                      ELSE '{{"match_id":' || match_id || ',"t_us":"soon"}}' END AS record
FROM actions WHERE seq % 100 IN (13, 14, 15)""",
        "apm_minutes": f"""
SELECT *, CAST(time_sec AS DOUBLE) / 60 AS time_min FROM ({_apm()})""",
        "actions_reread": f"""
WITH {_ACTIONS}, payloads AS (SELECT *, CASE
    WHEN event_type IN ('click', 'view') THEN CASE seq % 4
      WHEN 0 THEN '{{"unit":"' || unit || '","amount":' || items || '}}'
      WHEN 1 THEN '{{"unit_name":"' || unit || '","count":' || items || '}}'
      WHEN 2 THEN '{{"object_name":"' || unit || '","quantity":' || items || '}}'
      ELSE '{{"unit":{{"name":"' || unit || '"}},"n":' || items || '}}' END
    WHEN event_type = 'signup' THEN '{{"building":"' || building || '"}}'
    WHEN event_type = 'purchase' THEN '{{"technology":"' || tech || '"}}'
    WHEN event_type = 'error' THEN '{{"resource":"' || res || '","amount":100}}' END AS payload
  FROM actions)
SELECT match_id, player, seq, t_us, type, payload, true AS source_file FROM payloads""",
        "matches_reread_json": f"""
WITH {_ACTIONS}
SELECT match_id, duration_us, CAST(NULL AS INTEGER) AS map_id, CAST(NULL AS VARCHAR) AS map_name,
       CAST(NULL AS VARCHAR) AS version, true AS source_file FROM matches""",
        "sync_packets": f"""
WITH {_ACTIONS}
SELECT match_id, player, seq, t_us, CASE WHEN player IS NULL THEN 0.0 ELSE value END AS total_res
FROM actions WHERE event_type = 'view' AND match_id % 2 = 0""",
        "events_in_time_order": sql["important_events"],
        "action_types_by_frequency": sql["action_type_counts"],
        "player_summary_rounded": _rounded(sql["player_summary"]),
        "spend_has_data_food": f"""
SELECT match_id, sum(value) <> 0 AS has_data FROM ({_spend("food")}) GROUP BY match_id""",
        "postgame_totals_slots": f"""
WITH {_ACTIONS}, {_TOTALS}, placed AS (
  SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY player) AS player,
         food, wood, gold, stone FROM totals)
SELECT * FROM placed WHERE greatest(food, wood, gold, stone) > 0""",
        "postgame_totals_header": f"""
WITH {_ACTIONS}, {_TOTALS}
SELECT match_id, player, food, wood, gold, stone FROM totals
WHERE greatest(food, wood, gold, stone) > 0""",
        "postgame_totals_nested": f"""
WITH {_ACTIONS}, {_TOTALS}
SELECT match_id, player + 76561198000000000 AS player, food, wood, gold, stone FROM totals""",
        "postgame_totals_keys": sql["postgame_totals"],
        "postgame_totals_walk": sql["postgame_totals"],
        "resource_ramp": _ramp("food"),
    }
    for r in RESOURCES:
        if r != "food":
            sql[f"resource_ramp_{r}"] = _ramp(r)
        sql[f"resource_spend_{r}"] = _spend(r)
        sql[f"resource_balance_{r}"] = _balance(r)
    return {name: text.strip() for name, text in sql.items()}
