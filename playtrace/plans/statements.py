"""The result of each query, stated in SQL over the same tables. Used to check the DataFrame versions."""

from __future__ import annotations

import re

from playtrace.config import DAY_MS, GRAVEYARD_NOW, LOST_NOW
from playtrace.sources.testbed import SQL as VIEWS

KEYS = {"track": "track_id", "artist": "artist_id", "album": "album_id"}
RECENT_LOST, RECENT_GRAVE = LOST_NOW - 180 * DAY_MS, GRAVEYARD_NOW - 180 * DAY_MS
BASE = "count(*) AS plays, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(skip) AS BIGINT) AS skips, CAST(sum(ms_played) AS BIGINT) AS ms_played, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts"


def _recent(since: int = RECENT_LOST) -> str:
    return f"count(*) FILTER (ts_ms >= {since} AND q = 1) AS recent_plays"


def _round(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {float(10**digits)}"


def _with(body: str, *tables: str) -> str:
    return VIEWS + "".join(f", {t}" for t in tables) + "\n" + body


def _monthly(key: str) -> str:
    return f"SELECT {key}, ym, count(*) AS plays, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM e WHERE {key} IS NOT NULL GROUP BY ALL"


TRACKS = f"tracks AS (SELECT track_id, {BASE}, count(*) - CAST(sum(q) AS BIGINT) AS short_plays, count(DISTINCT local_date) AS distinct_days, count(DISTINCT ym) AS active_months, {_recent()} FROM e GROUP BY ALL)"
ARTISTS = f"artists AS (SELECT artist_id, {BASE}, count(DISTINCT track_id) AS tracks, count(DISTINCT album_id) AS albums, count(DISTINCT local_date) AS distinct_days, {_recent()}, count(*) FILTER (hour >= 22 OR hour < 5) AS night_plays FROM e GROUP BY ALL)"
ALBUMS = f"albums AS (SELECT album_id, {BASE}, count(DISTINCT track_id) AS tracks, {_recent()} FROM e WHERE album_id IS NOT NULL GROUP BY ALL)"
DAYS = "days AS (SELECT local_date, count(*) AS plays, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played, count(DISTINCT track_id) AS tracks, count(DISTINCT artist_id) AS artists, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts FROM e GROUP BY ALL)"
YEARS = "years AS (SELECT year, count(*) AS plays, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played, count(DISTINCT track_id) AS tracks, count(DISTINCT artist_id) AS artists, count(DISTINCT album_id) AS albums, count(DISTINCT local_date) AS distinct_days FROM e GROUP BY ALL)"
OWNED = "owned AS (SELECT artist_id, track_id, CAST(sum(q) AS BIGINT) AS q_plays FROM e GROUP BY ALL)"
HOURS = "hours AS (SELECT hour, dow, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM s GROUP BY ALL)"


def _peak_month(key: str) -> str:
    return _with(f"SELECT {key}, ym AS peak_ym, q_plays AS peak_ym_plays FROM m QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY q_plays DESC, plays DESC, ym) = 1", f"m AS ({_monthly(key)})")


def _by_year(key: str) -> str:
    return f"y AS (SELECT {key}, year, CAST(sum(q) AS BIGINT) AS n FROM e WHERE {key} IS NOT NULL GROUP BY ALL)"


def _peak_year(key: str) -> str:
    return _with(f"SELECT {key}, year AS peak_year, n AS peak_year_plays FROM y QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, year) = 1", _by_year(key))


def _plays(kind: str, name: str = "pl") -> str:
    key = KEYS[kind]
    return f"{name} AS (SELECT {key} AS id, ts_ms, ym FROM e WHERE q = 1 AND {key} IS NOT NULL)"


def _densest(name: str, days: int, plays: str = "pl") -> str:
    w = days * DAY_MS
    return f"""{name} AS (
  SELECT d.id, plays_in, to_ts, (SELECT min(ts_ms) FROM {plays} p WHERE p.id = d.id AND p.ts_ms >= d.to_ts - {w}) AS from_ts, (SELECT count(*) FROM {plays} p WHERE p.id = d.id AND p.ts_ms > d.to_ts) AS plays_after
  FROM (SELECT id, ts_ms AS to_ts, count(*) OVER (PARTITION BY id ORDER BY ts_ms RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) AS plays_in FROM {plays}) d
  QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY plays_in DESC, to_ts) = 1)"""


GAPS = f"""gaps AS (
  SELECT id, coalesce(max(gap) FILTER (gap > 0), 0) AS gap_ms, CAST(floor(coalesce(max(gap) FILTER (gap > 0), 0) / {DAY_MS}) AS BIGINT) AS gap_days,
    min_by(prev, struct_pack(g := -gap, t := ts_ms)) FILTER (gap > 0) AS gap_from, min_by(ts_ms, struct_pack(g := -gap, t := ts_ms)) FILTER (gap > 0) AS gap_to
  FROM (SELECT id, ts_ms, lag(ts_ms) OVER w AS prev, ts_ms - lag(ts_ms) OVER w AS gap FROM pl WINDOW w AS (PARTITION BY id ORDER BY ts_ms)) GROUP BY id)"""


def _log_scale(x: str, low: float, high: float) -> str:
    return f"least(greatest((ln(1 + greatest(({x})::DOUBLE, 0)) - ln(1 + {low}::DOUBLE)) / (ln(1 + {high}::DOUBLE) - ln(1 + {low}::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE)"


def _clamp(x: str) -> str:
    return f"least(greatest(({x})::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)"


def _dormancy(days: str) -> str:
    return f"CASE WHEN {days} <= 0 THEN 0.0::DOUBLE ELSE {_clamp(f'ln(1 + {days} / 30.0::DOUBLE) / ln(1 + 2920 / 30.0::DOUBLE)')} END"


def _tenths(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5) / 10"


RUNS = """months AS (SELECT id, ym, count(*) AS n FROM pl GROUP BY ALL), strong AS (
  SELECT id, ym, CAST(substr(ym, 1, 4) AS INT) * 12 + CAST(substr(ym, 6, 2) AS INT) AS m FROM (SELECT *, max(n) OVER (PARTITION BY id) AS peak FROM months) WHERE n >= greatest(2, ceil(peak * 0.2::DOUBLE))
), islands AS (SELECT id, m - row_number() OVER (PARTITION BY id ORDER BY ym) AS g FROM strong), runs AS (SELECT id, max(c) AS longest_run FROM (SELECT id, g, count(*) AS c FROM islands GROUP BY ALL) GROUP BY id)"""


def _obsessions(kind: str) -> list[str]:
    least = {"track": 20, "artist": 60, "album": 30}[kind]
    parts = [
        f"allp AS (SELECT {KEYS[kind]} AS id, ts_ms, ym FROM e WHERE q = 1 AND {KEYS[kind]} IS NOT NULL)",
        f"counts AS (SELECT id, count(*) AS lifetime_plays FROM allp GROUP BY id HAVING count(*) >= {least})", "pl AS (SELECT allp.* FROM allp JOIN counts USING (id))",
        _densest("main", 30), _densest("week", 7), RUNS,
        f"nth AS (SELECT id, {', '.join(f'CAST(floor((max(CASE WHEN rn = {n} THEN ts_ms END) - min(ts_ms)) / {DAY_MS}) AS BIGINT) AS days_to_{n}' for n in (50, 100))} FROM (SELECT id, ts_ms, row_number() OVER (PARTITION BY id ORDER BY ts_ms) AS rn FROM pl) GROUP BY id)",
        f"""{kind}_obs AS (SELECT '{kind}' AS kind, main.id, main.from_ts AS window_start, main.to_ts AS window_end, main.plays_in AS window_plays, lifetime_plays, main.plays_in / lifetime_plays::DOUBLE AS share,
          main.plays_in / greatest(1.0::DOUBLE, (main.to_ts - main.from_ts) / {DAY_MS}.0::DOUBLE) AS plays_per_day, main.plays_after, main.plays_after / lifetime_plays::DOUBLE AS after_share,
          {_tenths(f"100 * (0.42::DOUBLE * {_clamp('main.plays_in / lifetime_plays::DOUBLE')} + 0.36::DOUBLE * {_log_scale('main.plays_in', 5, 150)} + 0.22::DOUBLE * {_clamp('main.plays_in / 30.0::DOUBLE / 6')})")} AS intensity,
          days_to_50, days_to_100, coalesce(longest_run, 0) AS longest_run, week.plays_in AS peak_week
        FROM main JOIN counts USING (id) JOIN week USING (id) JOIN nth USING (id) LEFT JOIN runs USING (id) WHERE main.plays_in >= 5)""",
    ]
    return [re.sub(r"\b(allp|counts|pl|main|week|months|strong|islands|runs|nth)\b", rf"{kind}_\1", x) for x in parts]


def _obsession_rows(kind: str) -> str:
    return _with(f"SELECT * REPLACE ({_round('share')} AS share, {_round('plays_per_day')} AS plays_per_day, {_round('after_share')} AS after_share) FROM {kind}_obs", *_obsessions(kind))


_REJECTED = f"""CASE WHEN q_plays < 8 THEN 'too-few-plays' WHEN ms_played < 1200000 THEN 'too-little-time' WHEN days_since < 365 THEN 'not-dormant'
  WHEN CASE WHEN q_plays > 0 THEN recent_plays / q_plays::DOUBLE ELSE 0 END > 0.05 THEN 'already-returned' END"""
_DIMS = {
    "affinity": _clamp(f"0.6::DOUBLE * {_log_scale('q_plays', 5, 400)} + 0.4::DOUBLE * {_log_scale('ms_played / 60000.0::DOUBLE', 15, 1200)}"),
    "dormancy": _dormancy("days_since"),
    "peak": _clamp(f"0.55::DOUBLE * {_log_scale('peak_plays', 3, 120)} + 0.45::DOUBLE * {_clamp('CASE WHEN q_plays > 0 THEN peak_plays / q_plays::DOUBLE ELSE 0 END')}"),
    "engagement": _clamp("0.6::DOUBLE * (1 - least(skips / plays::DOUBLE, 1)) + 0.4::DOUBLE * least(q_plays / plays::DOUBLE, 1)"),
    "consistency": _clamp(f"0.5::DOUBLE * {_log_scale('active_months', 1, 36)} + 0.5::DOUBLE * {_log_scale('distinct_days', 2, 150)}"),
}
LOST = [
    TRACKS, _plays("track"), _densest("peak90", 90), GAPS,
    f"""measured AS (SELECT t.track_id AS id, t.*, coalesce(plays_in, 0) AS peak_plays, coalesce(gap_days, 0) AS longest_gap_days, CAST(floor(({LOST_NOW} - last_ts) / {DAY_MS}.0::DOUBLE) AS BIGINT) AS days_since
      FROM tracks t LEFT JOIN peak90 p ON p.id = t.track_id LEFT JOIN gaps g ON g.id = t.track_id)""",
    f"gated AS (SELECT *, {_REJECTED} AS rejected_by FROM measured)",
    "dims AS (SELECT *, " + ", ".join(f"CASE WHEN rejected_by IS NULL THEN {v} ELSE 0.0::DOUBLE END AS {k}" for k, v in _DIMS.items()) + " FROM gated)",
    f"lost AS (SELECT *, CASE WHEN rejected_by IS NULL THEN {_tenths('100 * (affinity * 0.30::DOUBLE + dormancy * 0.26::DOUBLE + peak * 0.17::DOUBLE + engagement * 0.13::DOUBLE + consistency * 0.14::DOUBLE)')} ELSE 0.0::DOUBLE END AS score FROM dims)",
]


def _graveyard(kind: str) -> list[str]:
    key, least = KEYS[kind], {"track": 25, "artist": 60, "album": 30}[kind]
    if kind == "album":
        best = f"{kind}_best AS (SELECT album_id, year AS peak_year FROM (SELECT album_id, year, ym, sum(q) AS n FROM e WHERE album_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY album_id ORDER BY n DESC, ym) = 1)"
    else:
        best = f"{kind}_best AS (SELECT {key}, year AS peak_year FROM {kind}_y QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, year) = 1)"
    prominence = f"CASE WHEN rank_at_peak IS NULL THEN 0.35::DOUBLE ELSE {_clamp('1 - ln(1 + (rank_at_peak::DOUBLE - 1)) / ln(51::DOUBLE)')} END"
    return [
        f"{kind}_y AS (SELECT {key}, year, CAST(sum(q) AS BIGINT) AS n FROM e WHERE {key} IS NOT NULL GROUP BY ALL)", best,
        f"{kind}_ranks AS (SELECT {key}, year AS peak_year, rank() OVER (PARTITION BY year ORDER BY n DESC) AS rank_at_peak FROM {kind}_y)",
        f"{kind}_stats AS (SELECT {key}, CAST(sum(q) AS BIGINT) AS q_plays, max(ts_ms) AS last_ts FROM e WHERE {key} IS NOT NULL GROUP BY {key} HAVING sum(q) >= {least} AND max(ts_ms) <= {GRAVEYARD_NOW - 730 * DAY_MS} AND count(*) FILTER (ts_ms >= {RECENT_GRAVE} AND q = 1) <= 2)",
        f"""{kind}_grave AS (SELECT *, {_tenths(f"100 * (0.46::DOUBLE * {_log_scale('q_plays', least, least * 12)} + 0.36::DOUBLE * {_dormancy('days_missing')} + 0.18::DOUBLE * {prominence})")} AS score
          FROM (SELECT '{kind}' AS kind, s.{key} AS id, q_plays, last_ts, CAST(floor(({GRAVEYARD_NOW} - last_ts) / {DAY_MS}.0::DOUBLE) AS BIGINT) AS days_missing, peak_year, rank_at_peak
            FROM {kind}_stats s LEFT JOIN {kind}_best USING ({key}) LEFT JOIN {kind}_ranks USING ({key}, peak_year)))""",
    ]


SESSIONS = [
    """marked AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY listener ORDER BY ts_ms, event_id) AS BIGINT) AS session FROM (
      SELECT *, coalesce(CAST(ts_ms - lag(ts_ms) OVER (PARTITION BY listener ORDER BY ts_ms, event_id) > 21600000 AS INT), 0) AS fresh FROM s))""",
    """base AS (SELECT listener, session, min(ts_ms) AS start_ts, max(ts_ms) AS end_ts, CAST(sum(ms_played) AS BIGINT) AS ms_played, count(*) AS events, CAST(sum(q) AS BIGINT) AS q_plays,
      min_by(local_date, struct_pack(a := ts_ms, b := event_id)) AS local_date FROM marked GROUP BY ALL)""",
    *[
        f"""{name} AS (SELECT listener, session, min_by({col}, struct_pack(a := -n, b := f)) AS top, max(n) AS repeats, count(*) AS kinds,
          CASE WHEN count(*) > 1 THEN least(greatest(sum(-(n / total::DOUBLE) * ln(n / total::DOUBLE)) / ln(count(*)::DOUBLE), 0), 1) ELSE 0 END AS diversity
          FROM (SELECT *, sum(n) OVER (PARTITION BY listener, session) AS total FROM (SELECT listener, session, {col}, count(*) AS n, min(struct_pack(a := ts_ms, b := event_id)) AS f FROM marked GROUP BY ALL)) GROUP BY ALL)"""
        for name, col in (("ft", "track_id"), ("fa", "artist_id"))
    ],
    """sess AS (SELECT base.*, ft.top AS top_track, ft.repeats AS max_repeats, ft.kinds AS tracks, ft.diversity, fa.top AS top_artist, fa.kinds AS artists, greatest(end_ts - start_ts, ms_played) AS duration_ms
      FROM base JOIN ft USING (listener, session) JOIN fa USING (listener, session))""",
]
VECTORS = [
    f"m AS ({_monthly('track_id')})",
    "first AS (SELECT min(CAST(substr(ym, 1, 4) AS INT) * 12 + CAST(substr(ym, 6, 2) AS INT)) AS m0, max(CAST(substr(ym, 1, 4) AS INT) * 12 + CAST(substr(ym, 6, 2) AS INT)) AS m1 FROM m)",
    "vectors AS (SELECT CAST(CAST(substr(ym, 1, 4) AS INT) * 12 + CAST(substr(ym, 6, 2) AS INT) - m0 AS BIGINT) AS i, ym, track_id AS id, sqrt(ms_played::DOUBLE) AS w FROM (SELECT * FROM m WHERE ms_played > 0 QUALIFY row_number() OVER (PARTITION BY ym ORDER BY ms_played DESC, track_id) <= 40), first)",
    "every AS (SELECT CAST(x - m0 AS BIGINT) AS i, printf('%04d-%02d', (x - 1) // 12, (x - 1) % 12 + 1) AS ym FROM (SELECT m0, unnest(generate_series(m0, m1)) AS x FROM first))",
    "sides AS (SELECT place AS i, id, sum(CASE WHEN before_it THEN w END) AS b, sum(CASE WHEN NOT before_it THEN w END) AS a FROM (SELECT id, w, i + d AS place, d > 0 AS before_it FROM vectors, (SELECT unnest([-2, -1, 0, 1, 2, 3]) AS d)) GROUP BY ALL)",
    "norms AS (SELECT i, coalesce(sum(a * b), 0) AS dot, coalesce(sum(a * a), 0) AS aa, coalesce(sum(b * b), 0) AS bb FROM sides GROUP BY i)",
    "dist AS (SELECT every.i, ym, CASE WHEN every.i = 0 OR (coalesce(aa, 0) = 0 AND coalesce(bb, 0) = 0) THEN 0.0 WHEN coalesce(aa, 0) = 0 OR coalesce(bb, 0) = 0 THEN 0.5 ELSE 1 - dot / sqrt(aa * bb) END AS distance FROM every LEFT JOIN norms USING (i))",
]
_STAMP = "CASE event_id % 7 WHEN 1 THEN 'missing-timestamp' WHEN 2 THEN 'invalid-timestamp' WHEN 3 THEN 'missing-track' WHEN 4 THEN 'missing-artist' WHEN 5 THEN 'podcast' WHEN 6 THEN 'not-an-object' END"
_RULED = [*LOST, _by_year("track_id"), """ruled AS (SELECT l.*, p_brand AS artist, p_type AS album, CASE WHEN p_size > 25 THEN p_name END AS tags, p_size % 2 AS favorite, peak_year
  FROM lost l JOIN part ON p_partkey = l.id LEFT JOIN (SELECT track_id, year AS peak_year FROM y QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, year) = 1) b ON b.track_id = l.id)"""]
_YEAR98 = "year = 1998"



def _library(where: str, order: str) -> str:
    return _with(f"SELECT track_id, p_name AS name, p_brand AS artist, q_plays, last_ts FROM tracks JOIN part ON p_partkey = track_id WHERE {where} ORDER BY {order}, track_id LIMIT 60", TRACKS)


def _cumulated(key: str) -> str:
    return f"c AS (SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY year) AS upto, sum(n) OVER (PARTITION BY {key}) AS total, count(*) OVER (PARTITION BY {key}) AS years, row_number() OVER (PARTITION BY {key} ORDER BY year) AS i FROM y)"


def _tight(key: str) -> str:
    return f"""SELECT * FROM (SELECT a.{key}, a.year AS from_year, b.year AS to_year, b.i - a.i + 1 AS span, CAST(b.upto - a.upto + a.n AS BIGINT) AS plays, CAST(a.total AS BIGINT) AS total, a.years
          FROM c a JOIN c b ON a.{key} = b.{key} AND a.i <= b.i WHERE a.total > 0 AND b.upto - a.upto + a.n >= 0.7::DOUBLE * a.total)
        QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY span, plays DESC, from_year) = 1 AND span <= greatest(2, ceil(years / 2))"""


STATEMENTS: dict[str, str] = {
    "g01_track_stats": _with("FROM tracks", TRACKS),
    "g02_artist_stats": _with("FROM artists", ARTISTS),
    "g03_album_stats": _with("FROM albums", ALBUMS),
    "g04_monthly_tracks": _with(_monthly("track_id")),
    "g05_monthly_artists": _with(_monthly("artist_id")),
    "g06_daily": _with("FROM days", DAYS),
    "g07_hourly": _with("FROM hours", HOURS),
    "g08_yearly": _with("FROM years", YEARS),
    "g09_album_breadth": _with(
        f"SELECT album_id, {_round('count(*) FILTER (q_plays >= 3) / count(*)::DOUBLE')} AS breadth, {_round('sum(CASE WHEN rn <= 3 THEN q_plays ELSE 0 END) / greatest(sum(q_plays), 1)::DOUBLE')} AS top3_share FROM r GROUP BY album_id",
        "t AS (SELECT album_id, track_id, CAST(sum(q) AS BIGINT) AS q_plays FROM e WHERE album_id IS NOT NULL GROUP BY ALL)", "r AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY q_plays DESC, track_id) AS rn FROM t)",
    ),
    "g10_year_from_month": _with("SELECT year, plays, q_plays, ms_played FROM years", YEARS),
    "g11_hours_dense": _with("SELECT CAST(h AS INTEGER) AS hour, count(s.hour) AS plays, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS ms_played FROM (SELECT unnest(range(24)) AS h) LEFT JOIN s ON s.hour = h AND local_date = '2024-01-03' GROUP BY h"),
    "g12_lifetime": _with(
        f"SELECT *, {_round('skips / streams::DOUBLE')} AS skip_rate FROM (SELECT (SELECT count(*) FROM a) AS streams, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played, count(DISTINCT track_id) AS tracks, count(DISTINCT artist_id) AS artists, count(DISTINCT album_id) AS albums, count(DISTINCT local_date) AS active_days, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, CAST(sum(skip) AS BIGINT) AS skips FROM e)"
    ),
    "g13_dayparts": _with(
        f"SELECT part, CAST(sum(plays) AS BIGINT) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms_played, {_round('sum(plays) / (sum(sum(plays)) OVER ())::DOUBLE')} AS share FROM (SELECT *, CASE WHEN hour < 5 THEN 'lateNight' WHEN hour < 12 THEN 'morning' WHEN hour < 17 THEN 'afternoon' WHEN hour < 22 THEN 'evening' ELSE 'night' END AS part FROM hours) GROUP BY part", HOURS
    ),
    "g13_clock": _with(
        f"SELECT CAST(sum(plays) AS BIGINT) AS plays, CAST(sum(w) AS BIGINT) AS weekend_plays, CAST(sum(plays) - sum(w) AS BIGINT) AS weekday_plays, min_by(hour, struct_pack(a := -plays, b := hour)) AS peak_hour, {_round('sum(CASE WHEN hour < 5 THEN plays ELSE 0 END) / sum(plays)::DOUBLE')} AS after_midnight_share FROM (SELECT hour, CAST(sum(plays) AS BIGINT) AS plays, CAST(sum(CASE WHEN dow IN (0, 6) THEN plays ELSE 0 END) AS BIGINT) AS w FROM hours GROUP BY hour)", HOURS
    ),
    "g14_facets": _with("SELECT DISTINCT 'year' AS facet, CAST(year AS VARCHAR) AS value, 0::BIGINT AS n FROM e UNION ALL (SELECT 'artist', CAST(artist_id AS VARCHAR), q_plays FROM artists ORDER BY q_plays DESC, artist_id LIMIT 200) UNION ALL SELECT 'tag', n_name, (SELECT count(*) FROM part WHERE p_size > 10 AND p_size % 40 = n_nationkey) FROM nation", ARTISTS),
    "g15_usage_counts": "SELECT n_name, count(s_suppkey) AS uses FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name",
    "g16_joined_names": "SELECT n_regionkey, string_agg(n_name, ' | ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "g17_session_averages": _with(f"SELECT count(*) AS sessions, {_round('avg(events)')} AS mean_events, {_round('avg(ms_played)')} AS mean_ms FROM sess", *SESSIONS),
    "g18_month_totals": _with("SELECT count(*) AS plays, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played, count(DISTINCT track_id) AS tracks, count(DISTINCT artist_id) AS artists FROM a WHERE ym = '1998-05'"),
    "w01_track_peak_month": _peak_month("track_id"),
    "w02_artist_peak_month": _peak_month("artist_id"),
    "w03_track_peak_year": _peak_year("track_id"),
    "w04_artist_peak_year": _peak_year("artist_id"),
    "w05_album_peak": _with("SELECT album_id, ym AS peak_ym, year AS peak_year, n AS peak_ym_plays FROM (SELECT album_id, year, ym, CAST(sum(q) AS BIGINT) AS n FROM e WHERE album_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY album_id ORDER BY n DESC, ym) = 1"),
    "w06_canonical_album": _with("SELECT track_id, supplier_id AS album_id, n AS plays FROM (SELECT track_id, supplier_id, count(*) AS n FROM a GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, supplier_id) = 1"),
    "w07_rank_in_year": _with("SELECT *, rank() OVER (PARTITION BY year ORDER BY n DESC) AS rank_in_year FROM y", _by_year("track_id")),
    "w08_densest_artist_7d": _with("FROM d", _plays("artist"), _densest("d", 7)),
    "w08_densest_album_30d": _with("FROM d", _plays("album"), _densest("d", 30)),
    "w08_densest_track_90d": _with("FROM d", _plays("track"), _densest("d", 90)),
    "w09_longest_gap": _with("FROM gaps", _plays("track"), GAPS),
    "w10_days_to_nth": _with(
        "SELECT id, " + ", ".join(f"CAST(floor((max(CASE WHEN rn = {n} THEN ts_ms END) - min(ts_ms)) / {DAY_MS}.0::DOUBLE) AS BIGINT) AS days_to_{n}" for n in (5, 50)) + " FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts_ms) AS rn FROM pl) GROUP BY id", _plays("album")
    ),
    "w11_plays_after": _with("SELECT id, to_ts, plays_after FROM d", _plays("artist"), _densest("d", 30)),
    "w12_monthly_run": _with("SELECT id, coalesce(longest_run, 0) AS longest_run FROM (SELECT DISTINCT id FROM pl) LEFT JOIN runs USING (id)", _plays("album"), RUNS),
    "w13_streak": _with("SELECT count(*) AS days, min(local_date) AS from_date, max(local_date) AS to_date FROM (SELECT local_date, CAST(local_date AS DATE) - CAST(row_number() OVER (ORDER BY local_date) AS INT) AS g FROM days) GROUP BY g ORDER BY days DESC, from_date LIMIT 1", DAYS),
    "w14_milestones": _with("SELECT id, rn AS n, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts_ms) AS rn FROM pl) WHERE rn IN (10, 25, 50)", _plays("track")),
    "w15_top_per_day": _with("SELECT local_date, artist_id, plays FROM (SELECT local_date, artist_id, count(*) AS plays FROM s GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY local_date ORDER BY plays DESC, artist_id) = 1"),
    "w16_diversified": _with(
        "SELECT row_number() OVER (ORDER BY w > 2, score DESC, q_plays DESC, id) AS position, id, artist_id, score FROM (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY score DESC, q_plays DESC, id) AS w FROM (SELECT * FROM lost WHERE score >= 30 ORDER BY score DESC, q_plays DESC, id LIMIT 200) JOIN (SELECT DISTINCT track_id AS t, artist_id FROM a) ON t = id)", *LOST
    ),
    "w17_year_span": _with(f"SELECT track_id, from_year, to_year, span, plays, total FROM ({_tight('track_id')})", "y AS (SELECT track_id, year, count(*) AS n FROM e GROUP BY ALL)", _cumulated("track_id")),
    "w18_previous_year": _with("SELECT a.year, a.plays, a.ms_played, b.plays AS previous_plays, b.ms_played AS previous_ms FROM years a LEFT JOIN years b ON b.year = a.year - 1", YEARS),
    "q03_sessions_global": _with(
        "SELECT session, min(ts_ms) AS start_ts, max(ts_ms) AS end_ts, count(*) AS events FROM (SELECT *, CAST(sum(fresh) OVER (ORDER BY ts_ms, event_id) AS BIGINT) AS session FROM (SELECT *, coalesce(CAST(ts_ms - lag(ts_ms) OVER (ORDER BY ts_ms, event_id) > 600000 AS INT), 0) AS fresh FROM s)) GROUP BY session"
    ),
    "q03_sessions_by_listener": _with("SELECT listener, start_ts, end_ts, events FROM base", *SESSIONS[:2]),
    "q04_session_stats": _with(f"SELECT * REPLACE ({_round('diversity')} AS diversity) FROM sess", *SESSIONS),
    "l07_session_list": _with("SELECT listener, session, start_ts, ms_played, events FROM sess WHERE events >= 2 ORDER BY ms_played DESC, start_ts, session, listener LIMIT 50 OFFSET 10", *SESSIONS),
    "q06_obsessions_artist": _obsession_rows("artist"),
    "q06_obsessions_album": _obsession_rows("album"),
    "q08_lost_favourites": _with("SELECT id, q_plays, peak_plays, longest_gap_days, days_since, rejected_by, " + ", ".join(f"{_round(k)} AS {k}" for k in _DIMS) + ", score FROM lost", *LOST),
    "r06_lost_count": _with("SELECT count(*) AS n FROM lost WHERE score >= 30", *LOST),
    **{f"q10_graveyard_{k}": _with(f"SELECT kind, id, q_plays, last_ts, days_missing, peak_year, rank_at_peak, score FROM {k}_grave", *_graveyard(k)) for k in KEYS},
    "l06_graveyard_page": _with(
        "SELECT kind, CAST(id AS VARCHAR) AS id, q_plays, days_missing, score FROM (SELECT kind, CAST(id AS VARCHAR) AS id, q_plays, days_missing, score FROM track_grave UNION ALL SELECT kind, id, q_plays, days_missing, score FROM album_grave UNION ALL SELECT kind, CAST(id AS VARCHAR), q_plays, days_missing, score FROM artist_grave) WHERE days_missing >= 800 ORDER BY score DESC, q_plays DESC, kind, id LIMIT 100",
        *_graveyard("track"), *_graveyard("album"), *_graveyard("artist"),
    ),
    "q20_comebacks": _with(f"SELECT * FROM (SELECT g.id, gap_days, gap_from, gap_to, (SELECT count(*) FROM pl WHERE pl.id = g.id AND ts_ms >= gap_to AND ts_ms <= gap_to + {90 * DAY_MS}) AS plays_after FROM gaps g WHERE gap_days >= 180) WHERE plays_after >= 5", _plays("track"), GAPS),
    "r05_deep_cuts": _with("SELECT * FROM (SELECT l.id, q_plays, score, artist_id, max(q_plays) OVER (PARTITION BY artist_id) AS best FROM lost l JOIN (SELECT DISTINCT track_id AS t, artist_id FROM a) ON t = l.id) WHERE score >= 30 AND q_plays < 0.6::DOUBLE * best", *LOST),
    "q11_month_vectors": _with(f"SELECT i, ym, id, {_round('w', 4)} AS w FROM vectors", *VECTORS[:3]),
    "q12_boundaries": _with(f"SELECT i, ym, {_round('distance')} AS distance FROM dist", *VECTORS),
    "q13_change_points": _with(
        f"SELECT i, ym, {_round('distance')} AS distance FROM (SELECT *, CASE WHEN i = 1 THEN 0 ELSE coalesce(lag(distance) OVER (ORDER BY i), 0) END AS l, coalesce(lead(distance) OVER (ORDER BY i), 0) AS r FROM dist) WHERE i >= 1 AND distance >= 0.42 AND distance >= l AND distance >= r", *VECTORS
    ),
    "f04_cosine_pairs": f"SELECT query_id, vec_id, {_round('c')} AS cosine FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS c FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) WHERE c >= 0.25",
    "j01_inner_dims": "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "j02_left_join": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "j03_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "j04_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "j05_share_of_best": _with("SELECT *, max(q_plays) OVER (PARTITION BY artist_id) AS best FROM owned", OWNED),
    "j06_top_track_of_artist": _with("SELECT artist_id, track_id AS top_track FROM owned QUALIFY row_number() OVER (PARTITION BY artist_id ORDER BY q_plays DESC, track_id) = 1", OWNED),
    "j08_events_in_sessions": _with(
        "SELECT l.listener AS owner, l.session, count(*) AS events, CAST(sum(CAST(s.listener = l.listener AS INT)) AS BIGINT) AS own FROM (SELECT * FROM sess WHERE events >= 2 ORDER BY ms_played DESC, start_ts, session, listener LIMIT 20) l JOIN s ON s.ts_ms BETWEEN l.start_ts AND l.end_ts GROUP BY ALL", *SESSIONS
    ),
    "l01_top_tracks": _with("SELECT track_id, q_plays, ms_played FROM tracks WHERE q_plays > 0 ORDER BY q_plays DESC, ms_played DESC, track_id LIMIT 50", TRACKS),
    "l01_top_tracks_year": _with(f"SELECT track_id, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM e WHERE {_YEAR98} GROUP BY track_id ORDER BY q_plays DESC, ms_played DESC, track_id LIMIT 50"),
    "l02_top_artists": _with("SELECT artist_id, q_plays, ms_played FROM artists WHERE q_plays > 0 ORDER BY ms_played DESC, artist_id LIMIT 10", ARTISTS),
    "l03_top_albums": _with("SELECT album_id, q_plays, ms_played FROM albums WHERE q_plays > 0 ORDER BY ms_played DESC, album_id LIMIT 50", ALBUMS),
    "r02_yearly_points": _with("SELECT year, plays, q_plays, ms_played FROM years", YEARS),
    "r10_months": _with("SELECT DISTINCT ym FROM e"),
    "r11_heatmap": _with("SELECT local_date, tracks AS value FROM days WHERE local_date BETWEEN '1998-01-01' AND '1998-12-31'", DAYS),
    "r12_bounds": _with("SELECT min(local_date) AS first_date, max(local_date) AS last_date FROM days", DAYS),
    "r03_rediscovery": _with(
        "SELECT id, score, days_since, CASE WHEN days_since // 365 >= 5 THEN 'years5' WHEN days_since // 365 >= 2 THEN 'years2' ELSE 'quiet' END AS reason FROM (SELECT *, row_number() OVER (ORDER BY score DESC, q_plays DESC, id) - 1 AS i, count(*) OVER () AS n FROM (SELECT * FROM lost WHERE score >= 30 ORDER BY score DESC, q_plays DESC, id LIMIT 60)) WHERE i = ('0x' || substr(md5('2002-08-01'), 1, 8))::BIGINT % n", *LOST
    ),
    "r04_on_this_day": _with(
        "SELECT local_date, plays, q_plays, ms_played, top_artist, top_artist_plays, top_track, top_track_plays FROM days"
        + "".join(f" LEFT JOIN (SELECT local_date, {k}_id AS top_{k}, n AS top_{k}_plays FROM (SELECT local_date, {k}_id, count(*) AS n FROM a GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY local_date ORDER BY n DESC, {k}_id) = 1) USING (local_date)" for k in ("artist", "track"))
        + " WHERE local_date LIKE '%-06-15' AND local_date <> '2001-06-15'", DAYS
    ),
    "r11_heatmap_plays": _with("SELECT local_date, plays AS value FROM days WHERE local_date BETWEEN '1998-01-01' AND '1998-12-31'", DAYS),
    "r11_heatmap_ms": _with("SELECT local_date, ms_played AS value FROM days WHERE local_date BETWEEN '1998-01-01' AND '1998-12-31'", DAYS),
    "r07_year_months": _with("SELECT ym, count(*) AS plays, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM e WHERE year = 1998 GROUP BY ym"),
    "r07_year_hours": _with("SELECT CAST(h AS INTEGER) AS hour, count(a.hour) AS plays, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS ms_played FROM (SELECT unnest(generate_series(0, 23)) AS h) LEFT JOIN a ON a.hour = h AND a.year = 1998 GROUP BY h"),
    "r08_new_artists": _with("SELECT artist_id, q_plays FROM artists WHERE first_ts >= 788918400000 AND first_ts < 791596800000 ORDER BY q_plays DESC, artist_id LIMIT 10", ARTISTS),
    "q04_session_cards": _with(
        " UNION ALL ".join(f"(SELECT '{n}' AS card, listener, session, {_round(v + '::DOUBLE')} AS value FROM sess WHERE events >= {k} ORDER BY {o}, start_ts, listener, session LIMIT 1)" for n, v, k, o in (
            ("longest", "ms_played", 2, "ms_played DESC"), ("mostDiverse", "diversity", 6, "diversity DESC, artists DESC"), ("mostRepetitive", "max_repeats", 6, "max_repeats DESC, events DESC"))), *SESSIONS
    ),
    "r07_rewind_year": _with(
        f"""SELECT years.*, (SELECT ym FROM (SELECT ym, sum(ms_played) AS ms FROM e WHERE {_YEAR98} GROUP BY ym) ORDER BY ms DESC, ym LIMIT 1) AS best_month, (SELECT local_date FROM days WHERE local_date LIKE '1998-%' ORDER BY ms_played DESC, local_date LIMIT 1) AS best_day,
          (SELECT {_round('count(*) FILTER (hour >= 22 OR hour < 5) / count(*)::DOUBLE')} FROM a WHERE {_YEAR98}) AS late_share, (SELECT count(*) FROM tracks WHERE first_ts >= 883612800000 AND first_ts < 915148800000) AS new_tracks, (SELECT plays FROM years WHERE year = 1997) AS previous_plays FROM years WHERE {_YEAR98}""",
        YEARS, DAYS, TRACKS,
    ),
    "r07_vanished": _with(
        f"SELECT track_id, CAST(sum(q) AS BIGINT) AS year_plays, any_value(last_ts) AS last_ts FROM e JOIN (SELECT track_id, max(ts_ms) AS last_ts FROM e GROUP BY track_id) USING (track_id) WHERE year = 2001 AND last_ts >= 978307200000 AND last_ts < 1009843200000 AND last_ts <= {GRAVEYARD_NOW - 365 * DAY_MS} GROUP BY track_id HAVING sum(q) >= 10 ORDER BY year_plays DESC, track_id LIMIT 12"
    ),
    "r08_rewind_month": _with("SELECT track_id, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM e WHERE ym = '1998-05' GROUP BY track_id ORDER BY q_plays DESC, ms_played DESC, track_id LIMIT 12"),
    "r09_random_month": _with("SELECT ym, q_plays FROM (SELECT *, row_number() OVER (ORDER BY ym) - 1 AS i, count(*) OVER () AS n FROM (SELECT ym, CAST(sum(q) AS BIGINT) AS q_plays FROM e GROUP BY ym HAVING sum(q) >= 20)) WHERE i = 4242 % n"),
    "r13_day_detail": _with("SELECT track_id, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM s WHERE local_date = '2024-01-03' GROUP BY track_id ORDER BY plays DESC, ms_played DESC, track_id LIMIT 20"),
    "r14_session_detail": _with(
        "SELECT event_id, ts_ms, track_id, ms_played, CASE WHEN artist_id = 'error' THEN 1::BIGINT ELSE 0::BIGINT END AS skip FROM s WHERE ts_ms BETWEEN (SELECT start_ts FROM base WHERE listener = 8 AND session = 3) AND (SELECT end_ts FROM base WHERE listener = 8 AND session = 3)",
        *SESSIONS[:2],
    ),
    "l07_sessions_diverse": _with(f"SELECT listener, session, {_round('diversity')} AS diversity, artists, max_repeats, events FROM sess WHERE events >= 6 ORDER BY sess.diversity DESC, artists DESC, start_ts, session, listener LIMIT 40", *SESSIONS),
    "l07_sessions_repetitive": _with(f"SELECT listener, session, {_round('diversity')} AS diversity, artists, max_repeats, events FROM sess WHERE events >= 6 ORDER BY max_repeats DESC, events DESC, start_ts, session, listener LIMIT 40", *SESSIONS),
    "q09_artist_gaps": _with("FROM gaps", _plays("artist"), GAPS),
    "r15_milestones": _with(
        f"""SELECT track_id, 'first-heard' AS kind, first_ts AS ts_ms, NULL::BIGINT AS n, NULL::BIGINT AS days FROM tracks
        UNION ALL SELECT track_id, 'last-heard', last_ts, NULL, NULL FROM tracks
        UNION ALL SELECT t.track_id, 'play-count', r.ts_ms, rn, CAST(floor((r.ts_ms - first_ts) / {DAY_MS}.0::DOUBLE) AS BIGINT)
          FROM (SELECT track_id, ts_ms, row_number() OVER (PARTITION BY track_id ORDER BY ts_ms) AS rn FROM a WHERE q = 1) r JOIN tracks t USING (track_id) WHERE rn IN (10, 25, 50, 100, 250, 500, 1000) AND rn <= t.q_plays
        UNION ALL SELECT track_id, 'peak-month', epoch_ms(CAST(ym || '-01' AS TIMESTAMP)), n, NULL FROM (
          SELECT track_id, ym, CAST(sum(q) AS BIGINT) AS n FROM e GROUP BY track_id, ym QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY sum(q) DESC, count(*) DESC, ym) = 1)
        UNION ALL SELECT id, 'longest-absence', gap_from, NULL, gap_days FROM gaps WHERE gap_days >= 90
        UNION ALL SELECT * FROM (SELECT id, 'comeback', gap_to, (SELECT count(*) FROM a WHERE a.track_id = gaps.id AND q = 1 AND ts_ms BETWEEN gap_to AND gap_to + {90 * DAY_MS}) AS n, gap_days FROM gaps WHERE gap_days >= 180) WHERE n >= 5""",
        TRACKS, _plays("track"), GAPS,
    ),
    "r15_track_detail": _with("SELECT t.*, gap_days, gap_from, gap_to FROM tracks t JOIN gaps ON id = track_id WHERE track_id = 7", TRACKS, _plays("track"), GAPS),
    "r16_insights": _with(
        f"""SELECT artist_id, gap_days, plays_since, CASE WHEN gap_days IS NOT NULL THEN coalesce(plays_since, 0) >= 5 END AS returned, from_year, to_year, CAST(floor(100.0::DOUBLE * b.plays / b.total + 0.5) AS BIGINT) AS percent,
        x.plays >= 40 AND night_plays >= 0.4::DOUBLE * x.plays AS nocturnal, best >= 0.3::DOUBLE * o.total AS one_track, night_plays, best
        FROM artists x JOIN (SELECT artist_id, max(n) AS best, sum(n) AS total FROM (SELECT artist_id, track_id, count(*) AS n FROM e GROUP BY ALL) GROUP BY artist_id) o USING (artist_id)
        LEFT JOIN (SELECT id AS artist_id, gap_days, (SELECT count(*) FROM a WHERE a.artist_id = gaps.id AND ts_ms >= gap_to) AS plays_since FROM gaps WHERE gap_days >= 180) USING (artist_id)
        LEFT JOIN ({_tight("artist_id")}) b USING (artist_id)""",
        ARTISTS, _plays("artist"), GAPS, "y AS (SELECT *, count(*) OVER (PARTITION BY artist_id) AS held FROM (SELECT artist_id, year, count(*) AS n FROM e GROUP BY ALL) QUALIFY held >= 2)", _cumulated("artist_id"),
    ),
    "r17_album_detail": _with("SELECT track_id, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM a WHERE album_id = 'Brand#2|ECONOMY' GROUP BY track_id ORDER BY plays DESC, track_id LIMIT 25"),
    "r19_library_plays": _library("p_size % 2 = 1", "q_plays DESC"),
    "r19_library_recent": _library("p_size > 10", "last_ts DESC"),
    "r19_library_first": _library("p_size <= 10", "first_ts"),
    "r19_library_time": _library("p_size > 10 AND p_size % 40 = 12", "ms_played DESC"),
    "r19_library_artist": _library("p_size % 3 = 1 AND (p_name ILIKE '%blue%' OR p_brand ILIKE '%blue%')", "lower(p_brand)"),
    "r19_library": _with("SELECT track_id, p_name AS name, q_plays FROM tracks JOIN part ON p_partkey = track_id WHERE p_name ILIKE '%RED%' ORDER BY lower(p_name), track_id LIMIT 100", TRACKS),
    "c01_rules_all": _with("SELECT id AS track_id, q_plays FROM ruled WHERE q_plays >= 20 AND 100.0::DOUBLE * skips / plays < 60 AND year(make_timestamp(first_ts * 1000)) BETWEEN 1990 AND 1996 AND favorite = 1", *_RULED),
    "c02_rules_any": _with(f"SELECT id AS track_id, q_plays FROM ruled WHERE ms_played / 60000.0::DOUBLE > 120 OR coalesce(peak_year, 0) = 1999 OR ({LOST_NOW} - last_ts) / {DAY_MS}.0::DOUBLE >= 900", *_RULED),
    "c03_rules_text": _with("SELECT id AS track_id, q_plays FROM ruled WHERE artist ILIKE '%brand#1%' AND NOT coalesce(tags, '') ILIKE '%RED%' AND lower(album) <> 'economy'", *_RULED),
    "t02_document_tokens": "SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents) WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 100",
    "s16_dedup": _with("SELECT year, count(*) AS events FROM (SELECT DISTINCT year, ts_ms, artist_id, track_id, ms_played, reason_end FROM a) GROUP BY year"),
    "x01_incremental_merge": _with("SELECT year, count(*) AS events FROM (SELECT DISTINCT year, ts_ms, artist_id, track_id, ms_played, reason_end FROM a WHERE year = 1999) GROUP BY year"),
    "s20_reject_tally": f"SELECT {_STAMP} AS reject_reason, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY ALL",
}

_SECTIONS = (
    ("destroyed", "album", "true", "window_plays DESC, intensity DESC", "window_plays"), ("artistBinges", "artist", "share >= 0.30::DOUBLE", "intensity DESC", "intensity"), ("albumAddictions", "album", "true", "intensity DESC", "intensity"),
    ("oneHit", "album", "share >= 0.6::DOUBLE AND after_share <= 0.12::DOUBLE", "share DESC, window_plays DESC", "share"), ("fastestHundred", "album", "days_to_100 IS NOT NULL", "days_to_100", "days_to_100"),
    ("mostIntenseWeek", "album", "true", "peak_week DESC", "peak_week"), ("longest", "album", "longest_run >= 3", "longest_run DESC, lifetime_plays DESC", "longest_run"),
)

STATEMENTS["l05_obsession_sections"] = _with(
    " UNION ALL ".join(
        f"(SELECT '{name}' AS section, CAST(id AS VARCHAR) AS id, {_round(f'{value}::DOUBLE')} AS value FROM (SELECT * REPLACE (CAST(id AS VARCHAR) AS id) FROM {kind}_obs) WHERE {where} ORDER BY {order}, id LIMIT 10)" for name, kind, where, order, value in _SECTIONS
    ),
    *_obsessions("album"), *_obsessions("artist"),
)
_TOPS = (
    ("mostPlayedTrack", "tracks", "track_id", "q_plays DESC", "q_plays"), ("mostPlayedArtist", "artists", "artist_id", "ms_played DESC", "ms_played"), ("mostPlayedAlbum", "albums", "album_id", "ms_played DESC", "q_plays"),
    ("longestDay", "days", "local_date", "ms_played DESC", "ms_played"), ("busiestDay", "days", "local_date", "plays DESC", "plays"), ("longestStreak", "streak", "from_date", "days DESC", "days"),
    ("fastestFifty", "(SELECT * FROM track_obs WHERE days_to_50 IS NOT NULL)", "id", "days_to_50", "days_to_50"), ("fastestHundred", "(SELECT * FROM track_obs WHERE days_to_100 IS NOT NULL)", "id", "days_to_100", "days_to_100"), ("biggestComeback", "(SELECT gaps.* FROM gaps JOIN tracks ON track_id = id WHERE q_plays >= 15 AND gap_days >= 180)", "id", "gap_days DESC", "gap_days"),
    ("longestLost", "(SELECT * FROM lost WHERE score > 0)", "id", "last_ts", "days_since"), ("biggestObsession", "track_obs", "id", "intensity DESC", "window_plays"), ("mostActiveYear", "years", "year", "ms_played DESC", "plays"), ("longestSession", "streams", "start_ts", "ms_played DESC", "ms_played"),
)
STATEMENTS["l04_records"] = _with(
    " UNION ALL ".join(f"(SELECT '{name}' AS record, CAST({key} AS VARCHAR) AS id, CAST({value} AS BIGINT) AS value FROM {source} x ORDER BY {order}, x.{key} LIMIT 1)" for name, source, key, order, value in _TOPS),
    *LOST, ARTISTS, ALBUMS, DAYS, YEARS, *_obsessions("track"),
    "streak AS (SELECT count(*) AS days, min(local_date) AS from_date FROM (SELECT local_date, CAST(local_date AS DATE) - CAST(row_number() OVER (ORDER BY local_date) AS INT) AS g FROM days) GROUP BY g)",
    """streams AS (SELECT min(ts_ms) AS start_ts, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM (SELECT *, sum(fresh) OVER (ORDER BY ts_ms RANGE UNBOUNDED PRECEDING) AS g FROM (
      SELECT ts_ms, ms_played, coalesce(CAST(ts_ms - lag(ts_ms) OVER (ORDER BY ts_ms) > 1800000 AS INT), 0) AS fresh FROM e)) GROUP BY g)""",
)

_OLDEST = "SELECT id, q_plays, score FROM lost l WHERE score >= 30"
_PAGE = "ORDER BY score DESC, q_plays DESC, id LIMIT 50"
_CANONICAL = "held AS (SELECT track_id, album_id FROM (SELECT track_id, album_id, count(*) AS n FROM a WHERE album_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, album_id) = 1)"
_POINT = "count(*) AS plays, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played"
STATEMENTS |= {
    "r05_lost_oldFavorites": _with(f"{_OLDEST} AND q_plays >= 40 {_PAGE}", *LOST),
    "r05_lost_forgottenAlbums": _with(f"{_OLDEST} AND id IN (SELECT track_id FROM held JOIN album_grave g ON g.id = album_id) {_PAGE}", *LOST, _CANONICAL, *_graveyard("album")),
    "r05_lost_deepCuts": _with(f"{_OLDEST} AND q_plays < 0.6::DOUBLE * (SELECT max(b.q_plays) FROM owned b JOIN owned mine USING (artist_id) WHERE mine.track_id = l.id) {_PAGE}", *LOST, OWNED),
    "r05_lost_all": _with(f"{_OLDEST} AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l.id AND (p_name ILIKE '%red%' OR p_brand ILIKE '%red%')) {_PAGE}", *LOST),
    "l02_top_artists_year": _with(f"SELECT artist_id, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM e WHERE {_YEAR98} GROUP BY artist_id ORDER BY ms_played DESC, artist_id LIMIT 50"),
    "l03_top_albums_year": _with(f"SELECT album_id, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM a WHERE {_YEAR98} AND album_id IS NOT NULL GROUP BY album_id ORDER BY ms_played DESC, album_id LIMIT 50"),
    "r01_overview": _with(
        """SELECT 'count' AS section, 'track' AS id, count(DISTINCT track_id) AS value FROM e UNION ALL SELECT 'count', 'artist', count(DISTINCT artist_id) FROM e UNION ALL SELECT 'count', 'album', count(DISTINCT album_id) FROM e
        UNION ALL SELECT 'lifetime', 'streams', count(*) FROM a UNION ALL SELECT 'lifetime', 'plays', count(*) FROM e UNION ALL SELECT 'lifetime', 'q_plays', CAST(sum(q) AS BIGINT) FROM e UNION ALL SELECT 'lifetime', 'ms_played', CAST(sum(ms_played) AS BIGINT) FROM e UNION ALL SELECT 'lifetime', 'distinct_days', count(*) FROM days
        UNION ALL SELECT 'year', CAST(year AS VARCHAR), ms_played FROM years UNION ALL (SELECT 'track', CAST(track_id AS VARCHAR), q_plays FROM tracks ORDER BY q_plays DESC, ms_played DESC, track_id LIMIT 5)""", TRACKS, YEARS, DAYS
    ),
    "r07_first_heard": _with(
        " UNION ALL ".join(f"(SELECT '{k}' AS kind, CAST({k}_id AS VARCHAR) AS id, first_ts, q_plays FROM {k}s WHERE first_ts >= 788918400000 AND first_ts < 820454400000 ORDER BY q_plays DESC, {k}_id LIMIT 12)" for k in ("artist", "track")), ARTISTS, TRACKS
    ),
    "r07_obsession": _with("SELECT id, window_start, window_plays, intensity FROM track_obs WHERE window_start >= 694224000000 AND window_start < 883612800000 ORDER BY intensity DESC, id LIMIT 1", *_obsessions("track")),
    "r08_month_artists": _with(f"SELECT artist_id, {_POINT} FROM e WHERE ym = '1998-05' GROUP BY artist_id ORDER BY ms_played DESC, artist_id LIMIT 12"),
    "r08_month_days": _with("SELECT local_date, plays, q_plays, ms_played, tracks FROM days WHERE local_date LIKE '1998-05-%'", DAYS),
    "r13_day_artist": _with("SELECT artist_id, count(*) AS plays FROM s WHERE local_date = '2024-01-03' GROUP BY artist_id ORDER BY plays DESC, artist_id LIMIT 1"),
    "r13_day_sessions": _with("SELECT listener, session, start_ts, events, ms_played FROM sess WHERE local_date = '2024-01-03'", *SESSIONS),
    "r15_track_points": _with(
        " UNION ALL ".join(f"SELECT '{unit}' AS unit, {at} AS at, {_POINT} FROM {source} WHERE track_id = 7 GROUP BY ALL" for unit, at, source in (("month", "ym", "e"), ("year", "substr(ym, 1, 4)", "e"), ("hour", "printf('%02d', hour)", "a")))
    ),
    "r16_artist_lists": _with(
        """(SELECT 'track' AS kind, CAST(track_id AS VARCHAR) AS id, q_plays AS value FROM tracks WHERE track_id IN (SELECT track_id FROM owned WHERE artist_id = 2) ORDER BY q_plays DESC, ms_played DESC, track_id LIMIT 12)
        UNION ALL (SELECT 'album', album_id, ms_played FROM albums WHERE album_id IN (SELECT album_id FROM held JOIN owned USING (track_id) WHERE artist_id = 2) ORDER BY ms_played DESC, album_id LIMIT 8)""", TRACKS, ALBUMS, OWNED, _CANONICAL
    ),
    "r17_album_months": _with("SELECT ym, count(*) AS plays, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM a WHERE album_id = 'Brand#2|ECONOMY' GROUP BY ym"),
}
