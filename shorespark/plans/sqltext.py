"""Pieces of SQL text that several oracle queries share."""

from __future__ import annotations

# Published constants of the transverse Mercator projection on WGS84, zone 19 south: k0 times the radius of
# the rectifying sphere, the first eccentricity and the four series coefficients.
UTM_RADIUS, UTM_E = 6364902.166165087, 0.08181919084262149
UTM_ALPHA = (8.377318206244698e-4, 7.608527773572307e-7, 1.197645503329453e-9, 2.429170607201359e-12)


def utm_cte(name: str, source: str, lon: str, lat: str, x: str, y: str) -> str:
    """CTEs that add easting x and northing y to all columns of `source`; the last one is called `name`."""
    atanh = lambda v: f"(0.5 * ln((1 + ({v})) / (1 - ({v}))))"
    sinh = lambda v: f"((exp({v}) - exp(-({v}))) / 2)"
    cosh = lambda v: f"((exp({v}) + exp(-({v}))) / 2)"
    inner = f"{atanh(f'sin(radians({lat}))')} - {UTM_E!r} * {atanh(f'{UTM_E!r} * sin(radians({lat}))')}"
    east = " + ".join(f"{c!r} * cos({2 * j} * xi_) * {sinh(f'{2 * j} * eta_')}" for j, c in enumerate(UTM_ALPHA, 1))
    north = " + ".join(f"{c!r} * sin({2 * j} * xi_) * {cosh(f'{2 * j} * eta_')}" for j, c in enumerate(UTM_ALPHA, 1))
    return f"""{name}_a AS (SELECT *, {inner} AS w_, radians({lon} + 69) AS dl_ FROM {source}),
{name}_b AS (SELECT *, {sinh('w_')} AS t_ FROM {name}_a),
{name}_c AS (SELECT *, atan2(t_, cos(dl_)) AS xi_, {atanh('sin(dl_) / sqrt(1 + t_ * t_)')} AS eta_ FROM {name}_b),
{name} AS (SELECT * EXCLUDE (w_, dl_, t_, xi_, eta_), 500000 + {UTM_RADIUS!r} * (eta_ + {east}) AS {x}, 10000000 + {UTM_RADIUS!r} * (xi_ + {north}) AS {y} FROM {name}_c)"""


YES_SQL = "lower(trim(affects_cartagena)) IN ('true', 't', 'yes', 'y', '1', '1.0', 'si', 'sí', 's', 'verdadero', 'v', 'cierto', 'on')"
USABLE_SQL = f"SELECT DISTINCT sector_id, event_id, start_date, end_date FROM marejadas_oficiales_armada WHERE {YES_SQL} AND start_date IS NOT NULL AND end_date >= start_date"


def offset_sql(u: str) -> str:
    """Microseconds that the clocks of zone zn are ahead of UTC at the instant u."""
    return f"(epoch_us(timezone(zn, to_timestamp(CAST(floor(({u}) / 1000000.0) AS BIGINT)))) - CAST(floor(({u}) / 1000000.0) AS BIGINT) * 1000000)"


def instant_cte(name: str, source: str, text: str, zone: str, keep: str) -> str:
    """CTEs with the columns `keep` of `source`, t_ (the trimmed text) and us: the instant a timestamp text states, in
    microseconds, null if it states none. Written from the statement of the problem, one pattern a kind of text."""
    clock = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?"
    own = r"(Z|UTC|GMT|CLT|CLST|[+-]\d\d:?\d\d)?"
    forms = {
        "iso": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T ]{clock})? ?{own}$", "y m d h i s f z"),
        "ordinal": (rf"^(\d{{4}})-(\d{{3}})(?:[T ]{clock})? ?{own}$", "y doy h i s f z"),
        "compact": (rf"^(\d{{4}})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d)?)? ?{own}$", "y m d h i s z"),
        "late": (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?: {clock})?(?: ([AaPp])[Mm])? ?{own}$", "d m y h i s f p z"),
        "named": (rf"^(?:\pL+, )?(\d{{1,2}}) (?:de )?(\pL+) (?:de )?(\d{{4}})(?: {clock})? ?{own}$", "d n y h i s f z"),
    }
    parts = ", ".join(f"regexp_extract(t_, '{pat}', [{', '.join(repr(c) for c in names.split())}]) AS r_{k}" for k, (pat, names) in forms.items())
    get = lambda c: "coalesce(" + ", ".join(f"nullif(r_{k}.{c}, '')" for k, (_, names) in forms.items() if c in names.split()) + ")"
    months = ("ene jan", "feb fev", "mar", "abr apr", "may mai", "jun", "jul", "ago aug", "sep set", "oct out", "nov", "dic dec dez")
    named = "CASE " + " ".join(f"WHEN n3 IN ({', '.join(repr(m) for m in ms.split())}) THEN '{i}'" for i, ms in enumerate(months, 1)) + " END"
    off = offset_sql
    return f"""{name}_a AS (SELECT {keep}, trim({text}) AS t_, coalesce({zone}, 'UTC') AS zn FROM {source}),
{name}_b AS (SELECT *, {parts} FROM {name}_a),
{name}_c AS (SELECT {', '.join(k.strip() for k in keep.split(','))}, t_, zn, {get('y')} AS y, {get('m')} AS m, {get('d')} AS d, {get('doy')} AS doy, lower(substr({get('n')}, 1, 3)) AS n3, TRY_CAST({get('h')} AS INTEGER) AS h, TRY_CAST({get('i')} AS INTEGER) AS i, coalesce(TRY_CAST({get('s')} AS INTEGER), 0) AS s, coalesce(TRY_CAST(rpad(substr({get('f')}, 1, 6), 6, '0') AS INTEGER), 0) AS f, {get('z')} AS z, lower({get('p')}) AS p FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN doy IS NOT NULL THEN CASE WHEN CAST(doy AS INTEGER) BETWEEN 1 AND CAST(strftime(make_date(CAST(y AS INTEGER), 12, 31), '%j') AS INTEGER) THEN make_date(CAST(y AS INTEGER), 1, 1) + (CAST(doy AS INTEGER) - 1) END ELSE TRY_CAST(y || '-' || lpad(coalesce(m, {named}), 2, '0') || '-' || lpad(d, 2, '0') AS DATE) END AS dt,
  CASE WHEN p IS NULL THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN p = 'p' THEN 12 ELSE 0 END END AS hh FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN h IS NULL AND i IS NULL THEN epoch_us(CAST(dt AS TIMESTAMP)) WHEN hh BETWEEN 0 AND 23 AND i BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59 THEN epoch_us(CAST(dt AS TIMESTAMP)) + ((hh * 60 + i) * 60 + s) * 1000000::BIGINT + f END AS w,
  CASE WHEN z IN ('Z', 'UTC', 'GMT') THEN 0 WHEN z = 'CLT' THEN -240 WHEN z = 'CLST' THEN -180 WHEN z IS NOT NULL THEN (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INTEGER) * 60 + CAST(right(z, 2) AS INTEGER)) END AS o FROM {name}_d),
{name}_f AS (SELECT *, w - {off('w - 86400000000')} AS c1, w - {off('w + 86400000000')} AS c2 FROM {name}_e),
{name} AS (SELECT {', '.join(k.strip() for k in keep.split(','))}, t_, CASE WHEN regexp_matches(t_, '^(\\d{{10}}|\\d{{13}}|\\d{{16}})$') THEN CASE length(t_) WHEN 10 THEN CAST(t_ AS BIGINT) * 1000000 WHEN 13 THEN CAST(t_ AS BIGINT) * 1000 ELSE CAST(t_ AS BIGINT) END
  WHEN o IS NOT NULL THEN w - o * 60000000::BIGINT WHEN c1 + {off('c1')} = w THEN c1 WHEN c2 + {off('c2')} = w THEN c2 ELSE c1 END AS us FROM {name}_f)"""


SCENES_SQL = instant_cte("sc", "storm_scene_join", "acquired_at", "clock_zone", "obs_id, sector_id, series_id, pass_no, position_m, storm_join_window_days")
