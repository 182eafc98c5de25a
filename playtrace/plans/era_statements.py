"""SQL for eras and for search, which also finds eras."""

from __future__ import annotations

from playtrace.config import DAY_MS, LOST_NOW
from playtrace.plans.statements import ALBUMS, ARTISTS, LOST, _round, _with

_MONTH = "CAST(substr(ym, 1, 4) AS INT) * 12 + CAST(substr(ym, 6, 2) AS INT)"


def _recursive(body: str, *tables: str) -> str:
    return _with(body, *tables).replace("WITH", "WITH RECURSIVE", 1)


def _monthly(key: str) -> str:
    return f"SELECT supplier_id % 4 AS listener, {key}, ym, count(*) AS plays, CAST(sum(q) AS BIGINT) AS q_plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM e GROUP BY ALL"


def _corner(i: str, j: str) -> str:
    """The sum of the products of all pairs of months up to i and j."""
    return f"grid[({i} + 1) * (m + 1) + {j} + 2]"


def _product(x: str, y: str) -> str:
    """The product of the vectors of two segments, from four corners."""
    return f"({_corner(x + '.e', y + '.e')} - {_corner(f'({x}.b - 1)', y + '.e')} - {_corner(x + '.e', f'({y}.b - 1)')} + {_corner(f'({x}.b - 1)', f'({y}.b - 1)')})"


def _alike(x: str, y: str) -> str:
    """The cosine of two segments; null if one is silent. Sums of corners are rounded, so that products of unlike segments are 0."""
    xx, yy, xy = (f"round({_product(p, q)}, 5)" for p, q in ((x, x), (y, y), (x, y)))
    return f"CASE WHEN {xx} > 0 AND {yy} > 0 THEN round({xy} / sqrt({xx} * {yy}), 10) END"


#: Settled segments: short weak ones join the neighbour that they resemble, then alike neighbours merge, one step at a time.
SETTLED = [
    f"em AS ({_monthly('track_id')})", f"am AS ({_monthly('artist_id')})",
    f"bounds AS (SELECT listener, min({_MONTH}) AS m0, max({_MONTH}) AS m1 FROM em GROUP BY listener)",
    f"vec AS (SELECT listener, CAST({_MONTH} - m0 AS BIGINT) AS i, track_id AS id, sqrt(ms_played::DOUBLE) AS w FROM (SELECT * FROM em WHERE ms_played > 0 QUALIFY row_number() OVER (PARTITION BY listener, ym ORDER BY ms_played DESC, track_id) <= 40) JOIN bounds USING (listener))",
    """cal AS (SELECT listener, CAST(x - m0 AS BIGINT) AS i, printf('%04d-%02d', (x - 1) // 12, (x - 1) % 12 + 1) AS ym, coalesce(plays, 0) AS plays
      FROM (SELECT listener, m0, unnest(generate_series(m0, m1)) AS x FROM bounds) LEFT JOIN (SELECT listener, ym, sum(q_plays) AS plays FROM em GROUP BY ALL) k ON k.listener = listener AND k.ym = printf('%04d-%02d', (x - 1) // 12, (x - 1) % 12 + 1))""".replace("k.listener = listener", "k.listener = z.listener").replace("FROM bounds) LEFT", "FROM bounds) z LEFT").replace("SELECT listener, CAST(x - m0", "SELECT z.listener, CAST(x - m0"),
    "sided AS (SELECT listener, place AS i, id, sum(CASE WHEN d > 0 THEN w END) AS b, sum(CASE WHEN d <= 0 THEN w END) AS a FROM (SELECT listener, id, w, i + d AS place, d FROM vec, (SELECT unnest([-2, -1, 0, 1, 2, 3]) AS d)) GROUP BY ALL)",
    "normed AS (SELECT listener, i, coalesce(sum(a * b), 0) AS dot, coalesce(sum(a * a), 0) AS aa, coalesce(sum(b * b), 0) AS bb FROM sided GROUP BY ALL)",
    "far AS (SELECT c.listener, c.i, CASE WHEN c.i = 0 OR (coalesce(aa, 0) = 0 AND coalesce(bb, 0) = 0) THEN 0.0 WHEN coalesce(aa, 0) = 0 OR coalesce(bb, 0) = 0 THEN 0.5 ELSE 1 - dot / sqrt(aa * bb) END::DOUBLE AS x FROM cal c LEFT JOIN normed n ON n.listener = c.listener AND n.i = c.i)",
    """cuts AS (SELECT listener, i, x FROM (SELECT *, CASE WHEN i = 1 THEN 0 ELSE coalesce(lag(x) OVER w, 0) END AS l, coalesce(lead(x) OVER w, 0) AS r FROM far WINDOW w AS (PARTITION BY listener ORDER BY i)) WHERE i >= 1 AND x >= 0.42 AND x >= l AND x >= r
      UNION ALL SELECT listener, i, x FROM far WHERE i = 0)""",
    "begun AS (SELECT c.listener, list({'b': i, 'e': coalesce(after - 1, m1 - m0), 's': x} ORDER BY i) AS segs FROM (SELECT *, lead(i) OVER (PARTITION BY listener ORDER BY i) AS after FROM cuts) c JOIN bounds USING (listener) GROUP BY c.listener)",
    # all products of two months, summed over both, with a border of zeros
    "pairs AS (SELECT a.listener, a.i, b.i AS j, sum(a.w * b.w) AS x FROM vec a JOIN vec b ON a.listener = b.listener AND a.id = b.id GROUP BY ALL)",
    """rows AS (SELECT c.listener, c.i, d.i AS j, sum(coalesce(x, 0)) OVER (PARTITION BY c.listener, c.i ORDER BY d.i) AS x
      FROM (SELECT listener, i FROM cal UNION ALL SELECT listener, -1 FROM bounds) c JOIN (SELECT listener, i FROM cal UNION ALL SELECT listener, -1 FROM bounds) d ON d.listener = c.listener LEFT JOIN pairs ON pairs.listener = c.listener AND pairs.i = c.i AND pairs.j = d.i)""",
    "grids AS (SELECT listener, list(x ORDER BY i, j) AS grid, max(i) + 1 AS m FROM (SELECT listener, i, j, sum(x) OVER (PARTITION BY listener, j ORDER BY i) AS x FROM rows) GROUP BY listener)",
    f"""steps AS (
      SELECT listener, 0 AS step, segs FROM begun
      UNION ALL
      SELECT listener, step + 1, CASE WHEN k > 0 AND leftward THEN segs[1:k - 2] || [{{'b': segs[k - 1].b, 'e': segs[k].e, 's': segs[k - 1].s}}] || segs[k + 1:]
          WHEN k > 0 THEN segs[1:k - 1] || [{{'b': segs[k].b, 'e': segs[k + 1].e, 's': greatest(segs[k].s, segs[k + 1].s)}}] || segs[k + 2:]
          ELSE segs[1:n - 1] || [{{'b': segs[n].b, 'e': segs[n + 1].e, 's': segs[n].s}}] || segs[n + 2:] END
      FROM (
        SELECT *, k = len(segs) OR (k > 1 AND coalesce({_alike("segs[k - 1]", "segs[k]")}, 0) >= coalesce({_alike("segs[k]", "segs[k + 1]")}, 0)) AS leftward,
          CASE WHEN k = 0 THEN coalesce(list_position(list_transform(range(1, len(segs)), lambda y: coalesce({_alike("segs[y]", "segs[y + 1]")}, 0) >= 0.78), true), 0) ELSE 0 END AS n
        FROM (SELECT s.listener, step, segs, grid, m, CASE WHEN len(segs) > 1 THEN coalesce(list_position(list_transform(segs, lambda y: y.e - y.b + 1 < 3 AND y.s < 0.68), true), 0) ELSE 0 END AS k FROM steps s JOIN grids g ON g.listener = s.listener)
      ) WHERE k > 0 OR n > 0)""",
    """settled AS (SELECT listener, row_number() OVER (PARTITION BY listener ORDER BY lo) - 1 AS era, lo, hi, s FROM (
      SELECT x.listener, b, s, min(i) AS lo, max(i) AS hi FROM (SELECT listener, y.b AS b, y.e AS e, y.s AS s FROM (SELECT listener, unnest(segs) AS y FROM steps QUALIFY step = max(step) OVER (PARTITION BY listener)))
      x JOIN cal c ON c.listener = x.listener AND c.i BETWEEN b AND e AND c.plays >= 10 GROUP BY ALL) WHERE listener IN (SELECT listener FROM cal WHERE plays >= 10 GROUP BY listener HAVING count(*) >= 6))""",
    "era AS (SELECT s.listener, era, a.ym AS start_ym, b.ym AS end_ym, hi - lo + 1 AS months, round(s, 3) AS strength FROM settled s JOIN cal a ON a.listener = s.listener AND a.i = lo JOIN cal b ON b.listener = s.listener AND b.i = hi)",
    "sums AS (SELECT r.listener, era, CAST(sum(plays) AS BIGINT) AS streams, CAST(sum(q_plays) AS BIGINT) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms_played FROM era r JOIN am ON am.listener = r.listener AND ym BETWEEN start_ym AND end_ym GROUP BY ALL)",
    "fresh AS (SELECT r.listener, era, count(*) AS new_artists FROM era r JOIN (SELECT listener, artist_id, min(ym) AS ym FROM am GROUP BY ALL) f ON f.listener = r.listener AND ym BETWEEN start_ym AND end_ym GROUP BY ALL)",
    """lead8 AS (SELECT *, row_number() OVER (PARTITION BY listener, era ORDER BY ms DESC, artist_id) AS rn FROM (SELECT r.listener, era, artist_id, sum(ms_played) AS ms FROM era r JOIN am ON am.listener = r.listener AND ym BETWEEN start_ym AND end_ym GROUP BY ALL) QUALIFY rn <= 8)""",
    """heard8 AS (SELECT *, row_number() OVER (PARTITION BY listener, era ORDER BY n DESC, track_id) AS rn FROM (SELECT r.listener, era, track_id, sum(q_plays) AS n FROM era r JOIN em ON em.listener = r.listener AND ym BETWEEN start_ym AND end_ym GROUP BY ALL) QUALIFY rn <= 8)""",
    """led AS (SELECT l.listener, l.era, list(CAST(artist_id AS VARCHAR) ORDER BY rn) AS leaders, max(CASE WHEN rn = 1 THEN CAST(artist_id AS VARCHAR) END) AS n1, max(CASE WHEN rn = 2 THEN CAST(artist_id AS VARCHAR) END) AS n2,
      max(CASE WHEN rn = 1 THEN ms / ms_played::DOUBLE END) AS s1, coalesce(max(CASE WHEN rn = 2 THEN ms / ms_played::DOUBLE END), 0) AS s2 FROM lead8 l JOIN sums ON sums.listener = l.listener AND sums.era = l.era GROUP BY ALL)""",
    # artists are named by their numbers here, so no name begins with an article
    """eras AS (SELECT r.listener, r.era, start_ym, end_ym, months, strength, plays, streams, ms_played, coalesce(new_artists, 0) AS new_artists,
      CASE WHEN s1 >= 0.24 AND n2 IS NOT NULL AND s2 >= 0.13 AND s2 >= 0.55::DOUBLE * s1 THEN 'The ' || n1 || ' / ' || n2 || ending WHEN s1 >= 0.24 THEN 'The ' || n1 || ending WHEN n2 IS NOT NULL AND s1 + s2 >= 0.30 THEN 'The ' || n1 || ' / ' || n2 || ending
        ELSE 'The ' || left(start_ym, 4) || CASE WHEN left(start_ym, 4) = left(end_ym, 4) THEN '' ELSE '–' || left(end_ym, 4) END || ' Stretch' END AS title,
      leaders, (SELECT list(CAST(track_id AS VARCHAR) ORDER BY rn) FROM heard8 h WHERE h.listener = r.listener AND h.era = r.era) AS tracks, r.era % 5 AS accent
      FROM (SELECT *, CASE WHEN months <= 5 THEN ' Period' WHEN months <= 17 THEN ' Era' ELSE ' Years' END AS ending FROM era) r JOIN sums USING (listener, era) JOIN led USING (listener, era) LEFT JOIN fresh USING (listener, era))""",
]
_NAMED = """named AS (SELECT n_nationkey % 4 AS listener, CAST(n_nationkey // 4 + 1992 AS VARCHAR) || '-01' AS start_ym, n_name FROM nation WHERE n_nationkey // 4 + 1992 <> 1996)"""

#: What search finds, with what it ranks and filters by.
FOUND = [
    *LOST, ARTISTS, ALBUMS, *SETTLED,
    """entries AS (
      SELECT 'track' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS subtitle, CAST(substr(p_brand, 7) AS BIGINT) AS artist FROM part
      UNION SELECT 'artist', CAST(CAST(substr(p_brand, 7) AS BIGINT) AS VARCHAR), p_brand, '', CAST(substr(p_brand, 7) AS BIGINT) FROM part
      UNION SELECT 'album', p_brand || '|' || p_type, p_type, p_brand, CAST(substr(p_brand, 7) AS BIGINT) FROM part
      UNION ALL SELECT 'era', listener || ':' || era, title, start_ym || ' - ' || end_ym, NULL FROM eras
      UNION ALL SELECT 'tag', CAST(n_nationkey AS VARCHAR), n_name, '', NULL FROM nation
      UNION ALL SELECT 'collection', CAST(r_regionkey AS VARCHAR), r_name, 'The small ring of a region', NULL FROM region)""",
    """numbers AS (SELECT 'track' AS kind, CAST(id AS VARCHAR) AS id, q_plays, first_ts, last_ts, score AS lost FROM lost
      UNION ALL SELECT 'artist', CAST(artist_id AS VARCHAR), q_plays, first_ts, last_ts, NULL FROM artists UNION ALL SELECT 'album', album_id, q_plays, first_ts, last_ts, NULL FROM albums)""",
    """docs AS (SELECT kind, id, artist, coalesce(q_plays, 0) AS plays, first_ts, last_ts, lost, p_size AS size, list_filter(string_split_regex(lower(title || ' ' || subtitle), '[^a-z0-9]+'), lambda x: x <> '') AS words
      FROM entries LEFT JOIN numbers USING (kind, id) LEFT JOIN part ON kind = 'track' AND CAST(p_partkey AS VARCHAR) = id)""",
]


def _searched(text: str, where: str = "true", plays: bool = True, limit: int | None = 60, digits: int = 4) -> str:
    """BM25 with k1 = 1.2 and b = 0.75 for the words of a text, the last a prefix, doubled, with plays and weighted by kind."""
    words = text.lower().split()
    tests = [f"lambda x: x = '{w}'" for w in words[:-1]] + [f"lambda x: starts_with(x, '{w}')" for w in words[-1:]]
    tf = "".join(f", len(list_filter(words, {t}))::DOUBLE AS tf{i}" for i, t in enumerate(tests))
    df = "".join(f", count(*) FILTER (tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(tests)))
    rank = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))" for i in range(len(tests))) or "0.0::DOUBLE"
    boost = "CASE kind WHEN 'artist' THEN 1.15::DOUBLE WHEN 'album' THEN 1.05::DOUBLE WHEN 'era' THEN 1.1::DOUBLE WHEN 'tag' THEN 1.2::DOUBLE WHEN 'collection' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END"
    tables = [
        f"counted AS (SELECT *, len(words)::DOUBLE AS length{tf} FROM docs)", f"totals AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean{df} FROM counted WHERE length > 0)",
        f"scored AS (SELECT *, {rank} AS t FROM counted, totals WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(tests))) or 'true'})",
        f"ranked AS (SELECT *, (2 * t + {'ln(1 + plays::DOUBLE)' if plays else '0'}) * {boost} AS score FROM scored WHERE {where})",
    ]
    if limit is None:
        return _recursive(f"SELECT kind, id, {_round('t')} AS text_score, {_round('score')} AS score FROM ranked", *FOUND, *tables)
    return _recursive(f"SELECT kind, id, plays, {_round('score', digits)} AS score FROM (SELECT * FROM ranked ORDER BY score DESC, plays DESC, kind, id LIMIT {limit})", *FOUND, *tables)


_ENTITY = "kind IN ('track', 'artist', 'album')"
_PLAYED = f"({_ENTITY} AND EXISTS (SELECT 1 FROM a WHERE a.year = 1999 AND CASE kind WHEN 'track' THEN CAST(a.track_id AS VARCHAR) WHEN 'artist' THEN CAST(a.artist_id AS VARCHAR) ELSE a.album_id END = id))"
STATEMENTS = {
    "q19_eras": _recursive("FROM eras", *SETTLED),
    "r18_eras_named": _recursive("SELECT r.listener, era, r.start_ym, end_ym, coalesce(n_name, title) AS title, title AS auto_title FROM eras r LEFT JOIN named n ON n.listener = r.listener AND n.start_ym = r.start_ym", *SETTLED, _NAMED),
    "r18_eras_at": _recursive(
        "SELECT d.listener, d.ym, era, title FROM (SELECT DISTINCT o_custkey % 4 AS listener, strftime(CAST(o_orderdate AS DATE) + INTERVAL 36 MONTH, '%Y-%m') AS ym FROM orders) d LEFT JOIN eras r ON r.listener = d.listener AND d.ym BETWEEN start_ym AND end_ym", *SETTLED
    ),
    "s19_highlights": _recursive(
        f"""SELECT 'years' AS card, max(year)::BIGINT - min(year) + 1 AS a, min(year)::BIGINT AS b FROM e UNION ALL (SELECT 'biggestYear', year, CAST(floor(sum(ms_played) / 3600000.0::DOUBLE + 0.5) AS BIGINT) FROM e GROUP BY year ORDER BY sum(ms_played) DESC, year LIMIT 1)
        UNION ALL SELECT 'lostFavorites', n, CAST(greatest(1, floor(({LOST_NOW} - oldest) / {365 * DAY_MS}.0::DOUBLE)) AS BIGINT) FROM (SELECT count(*) FILTER (score >= 30) AS n, min(last_ts) AS oldest FROM lost WHERE score > 0) WHERE n > 0
        UNION ALL SELECT 'totalTime', CAST(floor(sum(ms_played) / 3600000.0::DOUBLE + 0.5) AS BIGINT), CAST(floor(sum(ms_played) / {DAY_MS}.0::DOUBLE + 0.5) AS BIGINT) FROM e UNION ALL SELECT 'eras', count(*), NULL FROM eras""", *LOST, *SETTLED
    ),
    "t03_search_match": _searched("red brand 1", limit=None).replace(f"SELECT kind, id, {_round('t')} AS text_score, {_round('score')} AS score FROM ranked", "SELECT kind, id FROM ranked"),
    "t04_search_rank": _searched("small ring", plays=False, limit=None),
    "t06_all": _searched("brand 1"),
    "t06_browse": _searched("", "kind IN ('artist', 'tag', 'collection', 'era')"),
    "t06_kinds": _searched("small", "kind IN ('album', 'collection')"),
    "t06_min_plays": _searched("brand", "kind IN ('track', 'era') AND plays >= 25"),
    "t06_year": _searched("red", f"NOT {_ENTITY} OR {_PLAYED}"),
    "t06_first_heard": _searched("", "year(make_timestamp(first_ts * 1000)) BETWEEN 1996 AND 1997"),
    "t06_last_heard": _searched("ring", "year(make_timestamp(last_ts * 1000)) BETWEEN 2000 AND 2001"),
    "t06_artist": _searched("", "artist = 7"),
    "t06_tag": _searched("blue", "kind = 'track' AND size % 25 = 3"),
    "t06_lost": _searched("", "kind = 'track' AND lost >= 45"),
    "t06_favorite": _searched("cold", "kind = 'track' AND size % 2 = 0"),
    "t06_retired": _searched("hot", "kind = 'track' AND size % 5 = 0"),
    "t06_dormant": _searched("brand", f"{LOST_NOW} - last_ts >= {365 * DAY_MS}"),
    "t06_active": _searched("gear", f"1008000000000 - last_ts <= {180 * DAY_MS}"),
}
