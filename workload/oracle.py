"""SQL that DuckDB runs on the same tables, one text per registered query.

Written independently of the Spark side: polygons as edge rows, windows and joins as SQL.
"""

from __future__ import annotations

from .views import TABLES, VIEWS, vertices_sql

TITLE_WORD = r"[\p{L}\p{M}\p{N}'']+|[^\p{L}\p{M}\p{N}'']+"


def _title(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '{TITLE_WORD}'),"
        " lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def _key(c: str) -> str:
    return f"trim(regexp_replace({c}, '[[:punct:] ]+', ' ', 'g'))"


def _edges(source: str, attrs: str) -> str:
    return f"""
SELECT {attrs}, x AS ax, y AS ay,
       COALESCE(lead(x) OVER w, first_value(x) OVER w) AS bx, COALESCE(lead(y) OVER w, first_value(y) OVER w) AS byy
FROM {source} WINDOW w AS (PARTITION BY {attrs.split(",")[0]} ORDER BY seq)
"""


def _whole(v: str) -> str:
    """A coordinate in units of 2 ** -47: a whole number, without rounding, for the degrees of these tables."""
    return f"CAST({v} * 140737488355328::DOUBLE AS HUGEINT)"


def _turn(p: str, x: str, y: str) -> str:
    """Side of the edge that a point is on, exactly."""
    ax, ay, bx, by, x, y = map(_whole, (f"{p}.ax", f"{p}.ay", f"{p}.bx", f"{p}.byy", x, y))
    return f"sign(({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax}))"


def _crosses(p: str, x: str, y: str) -> str:
    """1 if the ray to the right meets the edge."""
    side = f"{_turn(p, x, y)} * CASE WHEN {p}.byy > {p}.ay THEN 1 ELSE -1 END"
    return f"CASE WHEN ({p}.ay > {y}) <> ({p}.byy > {y}) THEN CASE WHEN {side} > 0 THEN 1 ELSE 0 END ELSE 0 END"


def _inside(points: str, edges: str, key: str) -> str:
    """Pairs of distinct coordinates and polygon id, point strictly within polygon."""
    return f"""
SELECT p.px, p.py, e.{key}
FROM (SELECT DISTINCT lon AS px, lat AS py FROM {points} WHERE lon IS NOT NULL AND lat IS NOT NULL) p
JOIN (SELECT {key}, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM {edges} GROUP BY {key}) b
  ON p.px BETWEEN b.x0 AND b.x1 AND p.py BETWEEN b.y0 AND b.y1
JOIN {edges} e ON e.{key} = b.{key}
GROUP BY p.px, p.py, e.{key}
HAVING sum({_crosses('e', 'p.px', 'p.py')}) % 2 = 1
   AND sum(CASE WHEN p.px BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND p.py BETWEEN least(e.ay, e.byy) AND greatest(e.ay, e.byy)
                THEN CASE WHEN {_turn('e', 'p.px', 'p.py')} = 0 THEN 1 ELSE 0 END ELSE 0 END) = 0
"""


def _overlaps(left: str, lkey: str, right: str, rkey: str) -> str:
    """Pairs of polygons with a point in common, and the area they share.

    Whether they have one is found from edges that meet and vertices inside, not from the area.
    """
    box = "min(least(ax, bx)) AS x0, max(greatest(ax, bx)) AS x1, min(least(ay, byy)) AS y0, max(greatest(ay, byy)) AS y1, first(ax ORDER BY ax, ay) AS vx, first(ay ORDER BY ax, ay) AS vy"
    meets = (
        f"greatest(a.ax, a.bx) >= least(b.ax, b.bx) AND greatest(b.ax, b.bx) >= least(a.ax, a.bx)"
        f" AND greatest(a.ay, a.byy) >= least(b.ay, b.byy) AND greatest(b.ay, b.byy) >= least(a.ay, a.byy)"
        f" AND {_turn('a', 'b.ax', 'b.ay')} * {_turn('a', 'b.bx', 'b.byy')} <= 0 AND {_turn('b', 'a.ax', 'a.ay')} * {_turn('b', 'a.bx', 'a.byy')} <= 0"
    )

    def held(own: str, edges: str, key: str, other: str) -> str:
        return f"""
SELECT q.lid, q.rid FROM near q JOIN {edges} e ON e.{key} = q.{other}
GROUP BY q.lid, q.rid HAVING sum({_crosses('e', f'q.{own}x', f'q.{own}y')}) % 2 = 1
"""

    return f"""
WITH near AS (
  SELECT l.{lkey} AS lid, r.{rkey} AS rid, least(l.y0, r.y0) AS base, l.vx AS lx, l.vy AS ly, r.vx AS rx, r.vy AS ry
  FROM (SELECT {lkey}, {box} FROM {left} GROUP BY {lkey}) l JOIN (SELECT {rkey}, {box} FROM {right} GROUP BY {rkey}) r
    ON l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1
), common AS (
  SELECT DISTINCT lid, rid FROM near JOIN {left} a ON a.{lkey} = lid JOIN {right} b ON b.{rkey} = rid WHERE {meets}
  UNION ({held("l", right, rkey, "rid")}) UNION ({held("r", left, lkey, "lid")})
), areas AS (
SELECT lid, rid, sum(sgn * (hi - lo) * CASE WHEN (a0 - b0) * (a1 - b1) >= 0 THEN (least(a0, b0) + least(a1, b1)) / 2
    ELSE (t * (least(a0, b0) + a0 + t * (a1 - a0)) + (1 - t) * (a0 + t * (a1 - a0) + least(a1, b1))) / 2 END) AS overlap
FROM (
  SELECT *, (a0 - b0) / nullif((a0 - b0) - (a1 - b1), 0) AS t FROM (
    SELECT *, aay + (aby - aay) * (lo - aax) / (abx - aax) - base AS a0, aay + (aby - aay) * (hi - aax) / (abx - aax) - base AS a1,
           bay + (bby - bay) * (lo - bax) / (bbx - bax) - base AS b0, bay + (bby - bay) * (hi - bax) / (bbx - bax) - base AS b1
    FROM (
      SELECT lid, rid, base, a.ax AS aax, a.ay AS aay, a.bx AS abx, a.byy AS aby, b.ax AS bax, b.ay AS bay, b.bx AS bbx, b.byy AS bby,
             greatest(least(a.ax, a.bx), least(b.ax, b.bx)) AS lo, least(greatest(a.ax, a.bx), greatest(b.ax, b.bx)) AS hi,
             CASE WHEN (a.bx < a.ax) = (b.bx < b.ax) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn
      FROM near JOIN {left} a ON a.{lkey} = lid JOIN {right} b ON b.{rkey} = rid
    ) WHERE lo < hi
  )
) GROUP BY lid, rid)
SELECT c.lid, c.rid, greatest(coalesce(overlap, 0), 0) AS overlap FROM common c LEFT JOIN areas a ON a.lid = c.lid AND a.rid = c.rid
"""


def _largest(pairs: str) -> str:
    return f"""
SELECT lid, rid, overlap FROM (
  SELECT *, row_number() OVER (PARTITION BY lid ORDER BY round(overlap, 12) DESC, rid) AS rn FROM {pairs}
) WHERE rn = 1
"""


def _cascade_race(c: str, old: list[tuple[str, str]], kept: list[str], other: str) -> str:
    cases = " ".join(f"WHEN {c} = '{a}' THEN '{b}'" for a, b in old)
    listed = ", ".join(f"'{k}'" for k in kept)
    return f"CASE {cases} WHEN {c} NOT IN ({listed}) THEN '{other}' ELSE {c} END"


GUN_RACE = _cascade_race(
    "upper(race)",
    [("AM. INDIAN", "NATIVE AMERICAN"), ("ORIENTAL", "ASIAN")],
    ["BLACK", "WHITE", "ASIAN", "NATIVE AMERICAN"],
    "OTHER",
)

# Shared steps, each a CTE that may use the ones named with it.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {name: ((), sql) for name, sql in VIEWS.items()}
for _n, _attrs in (("areas", "area_id, community"), ("zips", "zip"), ("tracts", "geoid10")):
    STEPS[f"{_n}_v"] = ((), vertices_sql(_n))
    STEPS[f"{_n}_e"] = ((f"{_n}_v",), _edges(f"{_n}_v", _attrs))
STEPS |= {
    "crime_points": (("crimes",), "SELECT *, longitude AS lon, latitude AS lat FROM crimes"),
    "crimes_in_zips": (("crime_points", "zips_e"), _inside("crime_points", "zips_e", "zip")),
    "crimes_in_areas": (("crime_points", "areas_e"), _inside("crime_points", "areas_e", "area_id")),
    "cases_in_areas": (("cases", "areas_e"), _inside("cases", "areas_e", "area_id")),
    "area_names": (("areas_v",), "SELECT DISTINCT area_id, community FROM areas_v"),
    "zips_areas": (("zips_e", "areas_e"), _overlaps("zips_e", "zip", "areas_e", "area_id")),
    "tracts_areas": (("tracts_e", "areas_e"), _overlaps("tracts_e", "geoid10", "areas_e", "area_id")),
    "tracts_named": (("tracts_e", "areas_e"), _overlaps("tracts_e", "geoid10", "areas_e", "community")),
    "tracts_zips": (("tracts_e", "zips_e"), _overlaps("tracts_e", "geoid10", "zips_e", "zip")),
    "tract_area": (("tracts_areas",), _largest("tracts_areas")),
    "tract_named": (("tracts_named",), _largest("tracts_named")),
    "tract_zip": (("tracts_zips",), _largest("tracts_zips")),
    "money": (("budget_lines",), "SELECT * REPLACE (TRY_CAST(amount AS DECIMAL(38,2)) AS amount) FROM budget_lines"),
    "gun": (
        ("cases",),
        f"""
SELECT case_no, name, manner, age, CASE WHEN upper(latino) = 'YES' THEN 'LATINO' WHEN latino IS NOT NULL THEN {GUN_RACE} END AS race,
       upper(sex) AS sex, upper(latino) AS latino, date_of_death, upper(incident_address) AS incident_address, upper(incident_city) AS incident_city,
       upper(primary_cause_a) AS primary_cause,
       regexp_replace(coalesce(upper(primary_cause_b), '-') || ' ' || coalesce(upper(primary_cause_c), '-') || ' ' || coalesce(upper(secondary_cause), '-'), '[^\\p{{L}}]+$', '') AS secondary_cause
FROM cases
WHERE coalesce(contains(upper(primary_cause_a), 'GUNSHOT'), false) OR coalesce(contains(upper(primary_cause_b), 'GUNSHOT'), false)
   OR coalesce(contains(upper(primary_cause_c), 'GUNSHOT'), false) OR coalesce(contains(upper(secondary_cause), 'GUNSHOT'), false)
""".replace("{{", "{").replace("}}", "}"),
    ),
    "owned": ((), ""),
}
STEPS["owned"] = (
    ("named_places", "manual_places"),
    "SELECT * FROM named_places UNION SELECT * FROM manual_places",
)
STEPS |= {
    "all_places": (("owned", "api_places"), "SELECT * FROM owned UNION SELECT * FROM api_places"),
    "dup_one": (("all_places",), "SELECT case_no FROM all_places GROUP BY case_no HAVING count(*) > 1"),
    "left_places": (
        ("owned", "api_places", "dup_one"),
        "SELECT * FROM owned UNION SELECT a.* FROM api_places a WHERE NOT EXISTS (SELECT 1 FROM dup_one d WHERE d.case_no IS NOT DISTINCT FROM a.case_no)",
    ),
    "dup_two": (("left_places",), "SELECT case_no FROM left_places GROUP BY case_no HAVING count(*) > 1"),
    "places": (
        ("left_places", "dup_two"),
        "SELECT l.* FROM left_places l WHERE NOT (l.lat IS NULL AND EXISTS (SELECT 1 FROM dup_two d WHERE d.case_no IS NOT DISTINCT FROM l.case_no))",
    ),
    "gun_located": (("gun", "places"), "SELECT g.*, p.lat, p.lon FROM gun g LEFT JOIN places p ON g.case_no IS NOT DISTINCT FROM p.case_no"),
    "gun_in_areas": (("gun_located", "areas_e"), _inside("gun_located", "areas_e", "area_id")),
    "gun_in_zips": (("gun_located", "zips_e"), _inside("gun_located", "zips_e", "zip")),
    "gun_in_tracts": (("gun_located", "tracts_e"), _inside("gun_located", "tracts_e", "geoid10")),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for m in STEPS[n][0]:
            visit(m)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def _sql(body: str, *steps: str, **extra: str) -> str:
    names = {t: t for t in TABLES}
    parts = []
    for n in _needed(steps):
        text = STEPS[n][1]
        if n in VIEWS or n.endswith("_v"):
            text = text.format(**names)
        parts.append(f"{n} AS ({text.strip()})")
    parts += [f"{n} AS ({text.strip()})" for n, text in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


ORACLE: dict[str, str] = {}

# Crimes

ORACLE["crimes_monthly"] = _sql(
    """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, crime_category, arrest, c.community_area, year, count(*) AS count_of_crimes, any_value(n.community) AS community
FROM (SELECT DISTINCT * FROM crimes) c JOIN crime_categories USING (primary_type) LEFT JOIN community_names n ON c.community_area = n.community_area
WHERE c.community_area IS NOT NULL GROUP BY ALL
""",
    "crimes", "crime_categories", "community_names",
)
ORACLE["crimes_monthly_by_area"] = _sql(
    """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, crime_category, arrest, c.community_area, z.zip, year, count(*) AS count_of_crimes, any_value(n.community) AS community
FROM (SELECT DISTINCT * FROM crimes) c JOIN crimes_in_zips z ON c.longitude = z.px AND c.latitude = z.py JOIN crime_categories USING (primary_type)
LEFT JOIN community_names n ON c.community_area = n.community_area
WHERE c.community_area IS NOT NULL GROUP BY ALL
""",
    "crimes_in_zips", "crime_categories", "community_names",
)
ORACLE["epoch_roundtrip"] = _sql(
    """
SELECT DISTINCT CAST(epoch(date_trunc('month', date)) AS BIGINT) AS seconds, CAST(date_trunc('month', date) AS DATE) AS month FROM crimes
""",
    "crimes",
)

# Budgets

_KEYS = "year, funds, general_fund_type, department"
ORACLE["budget_sum_present"] = _sql(
    f"SELECT {_KEYS}, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount FROM money WHERE general_fund_type IS NOT NULL GROUP BY ALL",
    "money",
)
ORACLE["budget_sum_strict"] = _sql(
    f"SELECT {_KEYS}, CAST(CASE WHEN count(*) = count(amount) THEN sum(amount) END AS DOUBLE) AS amount FROM money WHERE general_fund_type IS NOT NULL GROUP BY {_KEYS}",
    "money",
)
ORACLE["budget_year_total"] = _sql(
    """
SELECT year, funds, CAST(amount AS DOUBLE) AS amount, CAST(sum(amount) OVER (PARTITION BY year) AS DOUBLE) AS year_total
FROM (SELECT year, funds, coalesce(sum(amount), 0) AS amount FROM money GROUP BY ALL)
""",
    "money",
)
ORACLE["budget_grand_total"] = _sql(
    """
SELECT year, funds, CAST(amount AS DOUBLE) AS amount, CAST(sum(amount) OVER () AS DOUBLE) AS total
FROM (SELECT year, funds, coalesce(sum(amount), 0) AS amount FROM money GROUP BY ALL)
""",
    "money",
)
ORACLE["budget_versions_union"] = _sql(
    """
SELECT *, CAST(sum(amount) OVER (PARTITION BY year) AS DOUBLE) AS year_total FROM (
  SELECT m.year, m.funds AS fund_type, m.general_fund_type AS fund_description, m.department AS department_description,
         CAST(coalesce(sum(m.amount), 0) AS DOUBLE) AS amount, upper(m.department) AS department_clean_orig, lower(m.department) AS department_clean_current,
         CASE WHEN contains(m.department, 'Sheriff') THEN 'Public Safety' ELSE 'Other' END AS category
  FROM money m WHERE m.general_fund_type IS NOT NULL AND m.department NOT LIKE 'Finance%' GROUP BY ALL)
""",
    "money",
)

_CATEGORY = "CASE WHEN contains(department, 'Hospital') THEN 'Public Health' WHEN contains(department, 'Sheriff') THEN 'Public Safety' ELSE 'Other' END"
_WIDE = """
SELECT fund, department, year, CAST(sum(CASE WHEN status <> 'O' THEN a END) AS BIGINT) AS expenditures, CAST(sum(CASE WHEN status = 'O' THEN a END) AS BIGINT) AS appropriations
FROM (SELECT funds AS fund, department, CASE WHEN status = 'P' THEN -1 ELSE year END AS year, status, CAST(clean_amount AS BIGINT) AS a FROM budget_lines) GROUP BY ALL
"""
# Every fund and department has a column for every year; absent cells are missing.
_WIDE_FULL = """
SELECT g.fund, g.department, nullif(y.year, -1) AS year, w.expenditures, w.appropriations
FROM (SELECT DISTINCT fund, department FROM wide) g CROSS JOIN (VALUES (1995), (1996), (1997), (1998), (1999), (2000), (2001), (-1)) AS y(year)
LEFT JOIN wide w ON w.fund = g.fund AND w.department = g.department AND w.year = y.year
"""


def _by_year(lines: str) -> str:
    return f"""
SELECT fund, CAST(NULL AS VARCHAR) AS genfundtype, department, category, year, CAST(amount AS DOUBLE) AS amount, CAST(sum(amount) OVER (PARTITION BY year) AS DOUBLE) AS year_total
FROM (SELECT year, fund, department, category, coalesce(sum(amount), 0) AS amount FROM {lines}
      WHERE year IS NOT NULL AND fund IS NOT NULL AND department IS NOT NULL AND category IS NOT NULL GROUP BY ALL)
"""


def _one_year(lines: str, year: int) -> str:
    return f"""
SELECT fund, genfundtype, department, category, {year} AS year, CAST(amount AS DOUBLE) AS amount,
       CAST(CASE WHEN count(*) OVER () = count(amount) OVER () THEN sum(amount) OVER () END AS DOUBLE) AS year_total
FROM (SELECT fund, genfundtype, department, category, CASE WHEN count(*) = count(TRY_CAST(amount AS DECIMAL(38,2))) THEN sum(TRY_CAST(amount AS DECIMAL(38,2))) END AS amount
      FROM {lines} WHERE amount IS NOT NULL AND fund IS NOT NULL AND genfundtype IS NOT NULL AND department IS NOT NULL AND category IS NOT NULL
      GROUP BY fund, genfundtype, department, category)
"""


def _like_any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce(contains({c}, '{w}'), false)" for w in words) + ")"


def _ruled(health: str, safety: str, rest: str = "'Other'", first: str = "'Public Health'") -> str:
    return (
        f"CASE WHEN ({health}) IS NULL THEN NULL WHEN {health} THEN {first}"
        f" WHEN ({safety}) IS NULL THEN NULL WHEN {safety} THEN 'Public Safety' ELSE {rest} END"
    )


_TABS = "('CHIEF JUDGE', 'CLERK OF THE CIRCUIT COURT', 'HOMELAND SECURITY AND EMERGENCY MANAGEMENT', 'STATE''S ATTORNEY', 'PUBLIC DEFENDER', 'SHERIFF')"
_SYSTEM = "COOK COUNTY HEALTH AND HOSPITALS SYSTEM"
_TAB_SAFETY = f"general_fund_type = 'Public Safety Fund' OR coalesce(tab IN {_TABS}, false) OR fund = 'Law Library'"
_TITLES = ["Security", "Law Library", "Medical Examiner", "Judicial Advisory"]
_WIDE_SAFE = ["Court", "State''s Attorney", "Probation", "Security", "Sheriff", "911", "ETSB", "Mental Health", "Children''s Waiting Room", "Women''s Justice", "Law Library"]
_SUMMARY = ["CHIEF JUDGE", "SHERIFF", "CLERK OF THE CIRCUIT COURT", "STATE''S ATTORNEY"]

_FIVE = "SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c UNION SELECT * FROM d UNION SELECT * FROM e UNION SELECT * FROM f"


def _mapped_tab(year: int) -> str:
    key = "trim(fund)" if year == 1998 else "fund"
    return _one_year(
        f"""(SELECT l.funds AS fund, l.general_fund_type AS genfundtype, l.department, m.category, l.amount
FROM (SELECT *, {key} AS tfund FROM budget_lines WHERE year = {year}) l
JOIN (SELECT DISTINCT {key} AS tfund, tab, CASE WHEN tab IS NULL THEN 'Other' ELSE 'Public Safety' END AS category FROM budget_lines WHERE department NOT LIKE 'Finance%') m
  ON l.tfund IS NOT DISTINCT FROM m.tfund AND l.tab IS NOT DISTINCT FROM m.tab)""",
        {1998: 2015, 1997: 2014}[year],
    )


def _mapped_summary(year: int) -> str:
    title = "department" if year == 1996 else "department || ' ' AS department"
    return _one_year(
        f"(SELECT funds AS fund, general_fund_type AS genfundtype, {title}, {_CATEGORY} AS category, clean_amount AS amount FROM budget_lines WHERE year = {year} AND department NOT LIKE 'Finance%')",
        {1995: 2012, 1996: 2013}[year],
    )


ORACLE["budget_category_mapping"] = _sql(
    _FIVE,
    "budget_lines", "money",
    wide=_WIDE,
    wide_full=_WIDE_FULL,
    a=_by_year(f"(SELECT year, funds AS fund, department, {_CATEGORY} AS category, amount FROM money WHERE year >= 1999 AND department NOT LIKE 'Finance%')"),
    b=_mapped_tab(1998),
    c=_mapped_tab(1997),
    d=_mapped_summary(1995),
    e=_mapped_summary(1996),
    f=_by_year(f"(SELECT t.year, t.fund, t.department, {_CATEGORY} AS category, unnest([t.appropriations, 0]) AS amount FROM wide_full t WHERE department NOT LIKE 'Finance%')"),
)


def _ruled_tab(year: int) -> str:
    category = _ruled(f"tab = '{_SYSTEM}'", _TAB_SAFETY)
    return _one_year(
        f"(SELECT funds AS fund, general_fund_type AS genfundtype, department, {category} AS category, amount FROM budget_lines WHERE year = {year})",
        {1998: 2015, 1997: 2014}[year],
    )


def _ruled_summary(year: int) -> str:
    names = _SUMMARY + (["PUBLIC DEFENDER"] if year == 1996 else [])
    category = _ruled(
        f"coalesce(contains(tab, '{_SYSTEM}'), false)",
        f"general_fund_type = 'Public Safety Fund' OR {_like_any('tab', names)} OR {_like_any('department', _TITLES)}",
    )
    return _one_year(
        f"(SELECT funds AS fund, general_fund_type AS genfundtype, department || ' ' AS department, {category} AS category, clean_amount AS amount FROM budget_lines WHERE year = {year})",
        {1995: 2012, 1996: 2013}[year],
    )


_FUNCTION = (
    "CASE WHEN function_area IS NULL THEN NULL WHEN function_area = 'Public Safety' THEN function_area"
    f" WHEN funds = 'Health Enterprise Fund' OR {_like_any('function_area', ['Health', 'Hospital'])} THEN 'Public Health' ELSE 'Other' END"
)
_WIDE_RULE = _ruled(
    f"fund = 'Health Fund' OR {_like_any('department', ['Lead Poisoning', 'TB Sanitarium', 'Managed Care'])}",
    f"fund = 'Public Safety Fund' OR {_like_any('department', [*_WIDE_SAFE, 'Medical Examiner'])}",
)
ORACLE["budget_category_rules"] = _sql(
    _FIVE,
    "budget_lines", "money",
    wide=_WIDE,
    wide_full=_WIDE_FULL,
    a=_by_year(f"(SELECT year, funds AS fund, department, {_FUNCTION} AS category, amount FROM money WHERE year >= 1999)"),
    b=_ruled_tab(1998),
    c=_ruled_tab(1997),
    d=_ruled_summary(1995),
    e=_ruled_summary(1996),
    f=_by_year(f"(SELECT year, fund, department, {_WIDE_RULE} AS category, unnest([appropriations, 0]) AS amount FROM wide_full)"),
)


def _spent_tab(year: int) -> str:
    label = _ruled(f"tab = '{_SYSTEM}' OR coalesce(contains(fund, 'Solid Waste'), false)", _TAB_SAFETY, _title("tab"))
    return f"""
SELECT label AS fund, fund_type, {({1998: 2015, 1997: 2014})[year]} AS year, CAST(a AS DOUBLE) AS amount, CAST(sum(a) OVER () AS DOUBLE) AS year_total
FROM (SELECT {label} AS label, funds AS fund_type, CAST(clean_amount AS DECIMAL(38,2)) AS a FROM budget_lines WHERE year = {year}) WHERE label IS NOT NULL AND a IS NOT NULL
"""


_SPENT_WIDE = _ruled(
    f"fund = 'Health Fund' OR {_like_any('department', ['Lead Poisoning', 'TB Sanitarium', 'Medical Examiner'])}",
    f"fund = 'Public Safety Fund' OR {_like_any('department', _WIDE_SAFE)}",
    "department",
)
_TYPED = _ruled(
    f"funds = 'Health Enterprise Fund' OR {_like_any('department', ['Health', 'Hospital'])}",
    "coalesce(department IN ('Chief Judge', 'Clerk of the Circuit Court', 'Public Defender', 'Sheriff', 'State''s Attorney'), false)",
    "department",
)
ORACLE["budget_expenditures"] = _sql(
    "SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d",
    "budget_lines",
    wide=_WIDE,
    wide_full=_WIDE_FULL,
    a=_spent_tab(1998),
    b=_spent_tab(1997),
    c=f"""
SELECT label AS fund, fund AS fund_type, year, CAST(amount AS DOUBLE) AS amount, CAST(total AS DOUBLE) AS year_total FROM (
  SELECT *, CASE WHEN year IS NOT NULL THEN coalesce(sum(amount) OVER (PARTITION BY year), 0) END AS total FROM (
    SELECT {_SPENT_WIDE} AS label, fund, year, unnest([expenditures, 0]) AS amount FROM wide_full)) WHERE amount IS NOT NULL
""",
    d=f"""
SELECT {_TYPED} AS fund, funds AS fund_type, 2020 AS year, CAST(clean_amount AS DOUBLE) AS amount, CAST(sum(CAST(clean_amount AS BIGINT)) OVER () AS DOUBLE) AS year_total
FROM budget_lines
""",
)
ORACLE["budget_melt_separate"] = _sql(
    """
SELECT fund, department, coalesce(CAST(year AS VARCHAR), 'prior') AS year, expenditures, 0 AS appropriations FROM wide_full
UNION ALL SELECT fund, department, coalesce(CAST(year AS VARCHAR), 'prior'), 0, appropriations FROM wide_full
""",
    "budget_lines",
    wide=_WIDE,
    wide_full=_WIDE_FULL,
)

# Cases

ORACLE["cases_gunshot"] = _sql("SELECT * FROM gun", "gun")
ORACLE["cases_title"] = _sql(
    f"SELECT case_no, {_title('name')} AS name, {_title('primary_cause_a')} AS primary_cause_a, {_title('incident_address')} AS incident_address FROM cases",
    "cases",
)
ORACLE["named_locations"] = _sql(
    f"""
SELECT c.case_no, m.formatted AS full_address, 'CHICAGO' AS city, CAST(60600 + m.place_id AS VARCHAR) AS zip, m.lat, m.lon
FROM (SELECT *, {_key("replace(short_address, ' ', ', ')")} AS k FROM gazetteer WHERE NOT contains(formatted, 'RED')) m
LEFT JOIN (SELECT case_no, {_key("incident_address")} AS k FROM gun) c ON c.k IS NOT DISTINCT FROM m.k
""",
    "gazetteer", "gun",
)
ORACLE["cases_address_key_join"] = _sql(
    f"""
SELECT c.case_no, c.k AS join_field, g.place_id FROM (SELECT case_no, {_key("incident_address")} AS k FROM cases) c
LEFT JOIN (SELECT place_id, {_key("short_address")} AS k FROM gazetteer) g ON c.k IS NOT DISTINCT FROM g.k
""",
    "cases", "gazetteer",
)
ORACLE["cases_overrides"] = _sql(
    "SELECT c.case_no, CASE WHEN m.case_no IS NOT NULL THEN 'EVANSTON' ELSE c.incident_city END AS incident_city FROM cases c LEFT JOIN manual_places m USING (case_no)",
    "cases", "manual_places",
)
ORACLE["manual_locations"] = _sql(
    """
SELECT case_no, full_address, city, zip, lat, lon FROM (
  SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY entry, k) AS rn FROM (
    SELECT CASE WHEN o.value IS NOT NULL THEN o.value ELSE c.case_no END AS case_no, m.* FROM keyed m
    LEFT JOIN by_key c ON c.k IS NOT DISTINCT FROM m.k LEFT JOIN numbers o ON o.full_address = m.full_address)
  WHERE case_no IS NOT NULL) WHERE rn = 1
""",
    "cases",
    manual=f"""
SELECT case_id AS entry, incident_address AS street, concat_ws(', ', coalesce(incident_address, 'NA'), coalesce(incident_city, 'NA'), 'IL', CAST(age + 60600 AS VARCHAR)) AS full_address,
       upper(incident_city) AS city, CAST(age + 60600 AS VARCHAR) AS zip, lat, lon,
       CASE WHEN incident_address = 'SCENE' THEN 'UNK LOCATION' ELSE {_key("replace(incident_address, '#', ' - ')")} END AS k
FROM cases
""",
    numbers="SELECT full_address, 'ME-' || CAST(min(entry) AS VARCHAR) AS value FROM manual WHERE street = 'CORNER OF MAIN' GROUP BY 1",
    keyed="SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY entry) AS rn FROM manual) WHERE rn = 1",
    by_key=f"SELECT case_no, {_key('incident_address')} AS k FROM cases",
)
ORACLE["cases_prefer_sources"] = _sql("SELECT * FROM places", "places")
ORACLE["cases_located"] = _sql("SELECT case_no, incident_address, lat, lon FROM gun_located", "gun_located")
_LOCATABLE = """incident_address IS NOT NULL AND substr({a}, 1, 4) <> 'SCEN' AND substr({a}, 1, 1) <> 'S' AND substr({a}, 1, 3) <> 'UNK'
  AND (date_of_death > DATE '1998-01-01' OR regexp_matches({a}, '^\\d'))""".replace("{a}", "upper(incident_address)")
ORACLE["cases_worklist"] = _sql(
    f"SELECT case_no, upper(incident_address) AS incident_address, date_of_death FROM cases WHERE lat IS NULL AND {_LOCATABLE}",
    "cases",
)
ORACLE["cases_labelled"] = _sql(
    f"""
SELECT g.case_no, {_title('g.name')} AS name, g.manner, g.age, coalesce({_title('g.race')}, 'Other') AS race, {_title('g.sex')} AS sex, {_title('g.latino')} AS latino,
       g.date_of_death, g.incident_address, g.incident_city, {_title('g.primary_cause')} AS primary_cause, {_title('g.secondary_cause')} AS secondary_cause,
       g.lat, g.lon, {_title('g.incident_city')} AS city, t.geoid10 AS block_group, a.area_id AS comarea_id, n.community AS community_area,
       {_title('coalesce(z.zip, g.incident_city)')} AS pri_neighborhood, {_title("'near ' || z.zip")} AS sec_neighborhood, {_title('g.incident_address')} AS address
FROM gun_located g
LEFT JOIN gun_in_tracts t ON g.lon = t.px AND g.lat = t.py
LEFT JOIN gun_in_areas a ON g.lon = a.px AND g.lat = a.py LEFT JOIN area_names n ON n.area_id = a.area_id
LEFT JOIN gun_in_zips z ON g.lon = z.px AND g.lat = z.py
""",
    "gun_in_areas", "gun_in_zips", "gun_in_tracts", "area_names",
)
ORACLE["cases_keep_first"] = _sql(
    "SELECT incident_address, case_id, case_no FROM cases QUALIFY row_number() OVER (PARTITION BY incident_address ORDER BY case_id) = 1", "cases"
)
ORACLE["cases_later_rows"] = _sql(
    "SELECT incident_address, case_id FROM cases QUALIFY row_number() OVER (PARTITION BY incident_address ORDER BY case_id) > 1", "cases"
)
ORACLE["cases_repeated_rows"] = _sql(
    "SELECT incident_address, case_id FROM cases QUALIFY count(*) OVER (PARTITION BY incident_address) > 1", "cases"
)
ORACLE["cases_duplicates"] = _sql(
    "SELECT race, latino, age, incident_city, count(*) AS copies FROM cases GROUP BY ALL HAVING count(*) > 1", "cases"
)
ORACLE["largest_per_key"] = _sql(
    "SELECT incident_address, measure, case_id FROM cases QUALIFY row_number() OVER (PARTITION BY incident_address ORDER BY measure DESC, case_id) = 1", "cases"
)
ORACLE["candidates_top_k"] = _sql(
    "SELECT incident_address, case_id, measure FROM cases QUALIFY row_number() OVER (PARTITION BY incident_address ORDER BY measure DESC, case_id) <= 3", "cases"
)
ORACLE["natural_and_null_join"] = _sql(
    "SELECT case_id, race, latino, count(*) OVER (PARTITION BY race, latino) AS n FROM cases", "cases"
)
ORACLE["outer_join_chain"] = _sql(
    """
SELECT k.case_no, n.c AS named, m.c AS manual, a.c AS api, z.c AS zips FROM (SELECT case_no FROM n UNION SELECT case_no FROM m UNION SELECT case_no FROM a UNION SELECT case_no FROM z) k
LEFT JOIN n ON k.case_no IS NOT DISTINCT FROM n.case_no LEFT JOIN m ON k.case_no IS NOT DISTINCT FROM m.case_no
LEFT JOIN a ON k.case_no IS NOT DISTINCT FROM a.case_no LEFT JOIN z ON k.case_no IS NOT DISTINCT FROM z.case_no
""",
    "named_places", "manual_places", "api_places", "case_zips",
    n="SELECT case_no, count(*) AS c FROM named_places WHERE case_no IS NOT NULL GROUP BY 1",
    m="SELECT case_no, count(*) AS c FROM manual_places WHERE case_no IS NOT NULL GROUP BY 1",
    a="SELECT case_no, count(*) AS c FROM api_places GROUP BY 1",
    z="SELECT DISTINCT zip AS case_no, 1 AS c FROM case_zips",
)
ORACLE["join_suffixes"] = _sql(
    """
SELECT place_id AS id, replace(short_address, ' ', ', ') AS raw, formatted AS address_x, 'CHICAGO' AS city_x,
       CASE WHEN NOT contains(formatted, 'RED') THEN 60600 + place_id END AS zip, formatted AS address_y, 'Chicago' AS city_y FROM gazetteer
""",
    "gazetteer",
)
ORACLE["join_on_id"] = _sql(
    "SELECT c.case_no, c.lat, c.lon, m.lat AS manual_lat FROM cases c JOIN manual_places m ON c.case_no = m.case_no", "cases", "manual_places"
)
ORACLE["anti_null_safe"] = _sql(
    "SELECT case_no, race FROM cases c WHERE NOT EXISTS (SELECT 1 FROM named_places n WHERE n.case_no IS NOT DISTINCT FROM c.case_no)", "cases", "named_places"
)
ORACLE["semi_null_safe"] = _sql(
    """
SELECT case_no, incident_city, latino FROM cases c WHERE EXISTS (SELECT 1 FROM (
  SELECT CASE WHEN manner = 'Suicide' THEN incident_city END AS city, CASE WHEN manner = 'Suicide' THEN latino END AS latino FROM cases) d
  WHERE d.city IS NOT DISTINCT FROM c.incident_city AND d.latino IS NOT DISTINCT FROM c.latino)
""",
    "cases",
)
ORACLE["union_distinct"] = _sql(
    "SELECT race, sex, incident_city FROM cases UNION SELECT CASE WHEN latino = 'YES' THEN 'other' ELSE race END, sex, incident_city FROM cases", "cases"
)
ORACLE["union_all"] = _sql(
    "SELECT case_no, lat, lon FROM named_places UNION ALL SELECT case_no, lat, NULL FROM manual_places", "named_places", "manual_places"
)
ORACLE["cases_projected"] = _sql(
    "SELECT case_no AS \"CASE\", upper(sex) AS SEX, upper(race) AS RACE, 'IL' AS state, CAST(NULL AS VARCHAR) AS zip FROM cases", "cases"
)
ORACLE["conform_schema"] = _sql(
    "SELECT year, fund, CAST(NULL AS VARCHAR) AS genfundtype, TRY_CAST(amount AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS note FROM budget_lines", "budget_lines"
)
ORACLE["cases_predicates"] = _sql(
    f"""
SELECT case_no, coalesce(contains(primary_cause_a, 'unshot'), false) OR coalesce(contains(primary_cause_b, 'unshot'), false) AS any_word,
       coalesce(regexp_matches(incident_address, '^[0-9]+ [SN]'), false) AS numbered, coalesce(race IN ('White', 'Black'), false) AS in_list,
       CASE WHEN latino = 'YES' THEN 'y' WHEN latino <> 'YES' THEN 'n' END AS latino_flag, {_LOCATABLE} AS locatable,
       NOT regexp_matches(case_no, '^[0-9[:punct:]]') AND substr(upper(incident_address), 1, 3) <> 'UNK' AS usable,
       coalesce(CASE WHEN sex <> 'Male' AND race <> '' THEN race END, latino) AS filled, CAST(substr(case_no, 3, 4) AS INT) AS case_year,
       coalesce(race, 'NA') || '/' || coalesce(latino, 'NA') || '/' || CAST(age AS VARCHAR) AS pasted,
       {_cascade_race("race", [("Am. Indian", "Native American")], ["Black", "White", "Native American"], "Other")} AS race
FROM cases
""",
    "cases",
)
ORACLE["split_three_ways"] = _sql(
    "SELECT case_id, latino, CASE latino WHEN 'YES' THEN 'yes' WHEN 'NO' THEN 'no' ELSE 'unknown' END AS part FROM cases", "cases"
)
ORACLE["opioid_cases"] = _sql(
    f"""
SELECT DISTINCT c.case_number, CASE WHEN c.latino THEN 'Latino' WHEN NOT c.latino THEN c.race END AS race, c.latino, c.latitude, c.longitude, a.area_id AS community_area_id, n.community AS community_area
FROM (SELECT CASE WHEN case_id % 19 = 0 THEN '' ELSE case_no END AS case_number,
             {_cascade_race("race", [("Am. Indian", "Native American")], ["Black", "White", "Asian", "Native American"], "Other")} AS race,
             latino = 'YES' AS latino, lat AS latitude, lon AS longitude FROM cases) c
LEFT JOIN cases_in_areas a ON c.longitude = a.px AND c.latitude = a.py LEFT JOIN area_names n ON n.area_id = a.area_id WHERE c.case_number <> ''
""",
    "cases_in_areas", "area_names",
)

# Areas

ORACLE["point_in_area"] = _sql(
    "SELECT c.case_no, c.lat, c.lon, a.area_id, n.community FROM cases c LEFT JOIN cases_in_areas a ON c.lon = a.px AND c.lat = a.py LEFT JOIN area_names n ON n.area_id = a.area_id",
    "cases_in_areas", "area_names",
)
ORACLE["enrich_areas"] = _sql(
    """
SELECT a.area_id, z.zip, count(*) AS n FROM crimes c LEFT JOIN crimes_in_areas a ON c.longitude = a.px AND c.latitude = a.py
LEFT JOIN crimes_in_zips z ON c.longitude = z.px AND c.latitude = z.py GROUP BY ALL
""",
    "crimes_in_areas", "crimes_in_zips",
)
ORACLE["polygon_overlap"] = _sql(
    """
SELECT z.zip, p.rid AS area_id, n.community, round(p.overlap, 8) AS overlap FROM (SELECT DISTINCT zip FROM zips_v) z
LEFT JOIN zips_areas p ON p.lid = z.zip LEFT JOIN area_names n ON n.area_id = p.rid
""",
    "zips_areas", "area_names",
)
ORACLE["overlap_with_one"] = _sql(
    """
SELECT p.lid AS geoid10, p.rid AS area_id, round(p.overlap, 8) AS overlap FROM tracts_areas p JOIN area_names n ON n.area_id = p.rid WHERE n.community = 'AREA NATION_7'
""",
    "tracts_areas", "area_names",
)
ORACLE["largest_overlap"] = _sql(
    "SELECT lid AS geoid10, rid AS pri_neigh, round(overlap, 8) AS overlap FROM tract_area", "tract_area"
)
_CENTROID = """
SELECT geoid10, sum(cr) / 2 AS area, min(ox) + sum((ax + bx - 2 * ox) * cr) / (3 * sum(cr)) AS x, min(oy) + sum((ay + byy - 2 * oy) * cr) / (3 * sum(cr)) AS y
FROM (SELECT *, (ax - ox) * (byy - oy) - (bx - ox) * (ay - oy) AS cr FROM (
  SELECT *, min(ax) OVER (PARTITION BY geoid10) AS ox, min(ay) OVER (PARTITION BY geoid10) AS oy FROM tracts_e)) GROUP BY geoid10
"""
ORACLE["area_centroid"] = _sql(
    "SELECT geoid10, round(area, 8) AS area, round(x, 7) AS x, round(y, 7) AS y FROM centres", "tracts_e", centres=_CENTROID
)
ORACLE["web_mercator"] = _sql(
    """
SELECT case_no, round(lon * 6378137.0::DOUBLE * pi() / 180, 3) AS x, round(ln(tan(lat * pi() / 360 + pi() / 4)) * 6378137.0::DOUBLE, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM cases
""",
    "cases",
)
ORACLE["blockgroup_fields"] = _sql(
    """
SELECT c.geoid10 AS block_group, z.rid AS zip, a.rid AS neighborhood, round(c.y, 7) AS latitude, round(c.x, 7) AS longitude, 'U.S.A.' AS country
FROM centres c LEFT JOIN tract_zip z ON z.lid = c.geoid10 LEFT JOIN tract_named a ON a.lid = c.geoid10
""",
    "tract_zip", "tract_named",
    centres=_CENTROID,
)

# Census and survey

_SPAN = "(VALUES (1990, 1984, 1999), (2000, 2000, 2009), (2010, 2010, 2020)) AS s(dy, lo, hi)"
_RACES = ["white", "black", "native_am", "asian", "pacific_island", "other", "mult"]


def _long(cols: list[tuple[str, str]], measure: str, source: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{label}' AS race, {col} AS {measure} FROM {source}" for label, col in cols
    )


_POP = [(r, f"pop_race_{r}") for r in _RACES]
ORACLE["census_expand"] = _sql(
    f"SELECT zcta, datayear, total_pop, CAST(y.join_year AS INT) AS join_year FROM census JOIN {_SPAN} ON s.dy = datayear, LATERAL (SELECT unnest(range(s.lo, s.hi + 1)) AS join_year) y",
    "census",
)
ORACLE["census_melt"] = _sql(_long(_POP, "pop_race", "census", "zcta, datayear"), "census")
ORACLE["census_other"] = _sql(
    """
SELECT DISTINCT * FROM m WHERE race NOT IN ('other', 'mult', 'pacific_island')
UNION ALL SELECT zcta, datayear, 'other', CAST(coalesce(sum(pop_race), 0) AS BIGINT) FROM m WHERE race IN ('other', 'mult', 'pacific_island') GROUP BY zcta, datayear
""",
    "census",
    m=_long(_POP, "pop_race", "census", "zcta, datayear"),
)


def _folded(source: str, measure: str, others: str) -> str:
    return f"""
SELECT CASE WHEN race IN ({others}) THEN 'other' ELSE race END AS race, zcta, join_year, sex, CAST(sum({measure}) AS BIGINT) AS {measure}
FROM {source} WHERE {measure} IS NOT NULL GROUP BY 1, 2, 3, 4
"""


ORACLE["census_long"] = _sql(
    """
SELECT m.zcta, m.join_year, CASE m.race WHEN 'black' THEN 'Black' WHEN 'white' THEN 'White' WHEN 'asian' THEN 'Asian' WHEN 'native_am' THEN 'Native American' ELSE 'Other' END AS race,
       CASE m.sex WHEN 'males' THEN 'Male' WHEN 'females' THEN 'Female' ELSE m.sex END AS sex,
       g.geogyear, g.datayear, g.total_pop, g.occupied_units, g.vacant_units, g.owner_occupied, g.renter_occupied, g.pop_sex, p.pop_race, o.pop_own_race, r.pop_rent_race
FROM (SELECT zcta, join_year, race, sex FROM p UNION SELECT zcta, join_year, race, sex FROM o UNION SELECT zcta, join_year, race, sex FROM r) m
LEFT JOIN p USING (zcta, join_year, race, sex) LEFT JOIN o USING (zcta, join_year, race, sex) LEFT JOIN r USING (zcta, join_year, race, sex)
LEFT JOIN (SELECT * FROM by_sex) g ON g.zcta = m.zcta AND g.join_year = m.join_year AND g.sex = m.sex AND p.race IS NOT NULL
""",
    "census", "case_zips",
    kept="SELECT * FROM census WHERE zcta IN (SELECT zip FROM case_zips WHERE zip IS NOT NULL)",
    filled=f"SELECT kept.*, CAST(y.join_year AS INT) AS join_year FROM kept JOIN {_SPAN} ON s.dy = datayear, LATERAL (SELECT unnest(range(s.lo, s.hi + 1)) AS join_year) y",
    by_sex="SELECT *, 'males' AS sex, total_males AS pop_sex FROM filled UNION ALL SELECT *, 'females', total_females FROM filled",
    p=_folded(f"({_long(_POP, 'pop_race', 'by_sex', 'zcta, join_year, sex')})", "pop_race", "'mult', 'pacific_island', 'other'"),
    o=_folded(
        f"({_long([(x, f'own_{x}_occupied') for x in ('white', 'black', 'other', 'mult_race')], 'pop_own_race', 'by_sex', 'zcta, join_year, sex')})",
        "pop_own_race", "'mult_race', 'other'",
    ),
    r=_folded(
        f"({_long([(x, f'rent_{x}_occupied') for x in ('asian', 'other', 'mult_race')], 'pop_rent_race', 'by_sex', 'zcta, join_year, sex')})",
        "pop_rent_race", "'mult_race', 'other'",
    ),
)
STEPS["tract_survey"] = (
    ("survey",),
    "SELECT *, right(geo_id, 11) AS geoid10 FROM survey",
)
ORACLE["survey_loaded"] = _sql(
    """
SELECT geoid10, acs_year, total_population AS "Total_Population", population_asian AS "Population_Asian", median_income_white AS "Median_Income_White", 4 AS vertices FROM tract_survey
""",
    "tract_survey",
)
ORACLE["survey_areas"] = _sql(
    """
SELECT s.geoid10, s.acs_year, n.rid AS pri_neigh, b.area_id AS sec_neigh, z.rid AS zip, a.rid AS community_area_id, c.community AS community_area,
       nullif(s.median_income_white, -666666666) AS "Median_Income_White", nullif(s.median_income_black, -666666666) AS "Median_Income_Black"
FROM tract_survey s LEFT JOIN tract_named n ON n.lid = s.geoid10 LEFT JOIN area_names b ON b.community = n.rid
LEFT JOIN tract_zip z ON z.lid = s.geoid10 LEFT JOIN tract_area a ON a.lid = s.geoid10 LEFT JOIN area_names c ON c.area_id = a.rid
""",
    "tract_survey", "tract_named", "tract_zip", "tract_area", "area_names",
)
ORACLE["survey_long"] = _sql(
    """
SELECT geoid10, y.acs_year, zip, race, sex, nullif(income, -666666666) AS median_income_race, pop AS population_race, psex AS population_sex FROM (
  SELECT s.geoid10, s.acs_year, z.rid AS zip, r.race, CASE r.race WHEN 'White' THEN s.median_income_white WHEN 'Black' THEN s.median_income_black WHEN 'Asian' THEN s.median_income_asian ELSE s.median_income_native_american END AS income,
         CASE r.race WHEN 'White' THEN s.population_white WHEN 'Black' THEN s.population_black WHEN 'Asian' THEN s.population_asian ELSE s.population_native_american END AS pop,
         x.sex, CASE x.sex WHEN 'Female' THEN s.population_female ELSE s.population_male END AS psex
  FROM tract_survey s LEFT JOIN tract_zip z ON z.lid = s.geoid10
  CROSS JOIN (VALUES ('White'), ('Black'), ('Native_American'), ('Asian')) AS r(race) CROSS JOIN (VALUES ('Female'), ('Male')) AS x(sex)
) q JOIN (VALUES (2018, 2018), (2019, 2019), (2019, 2020)) AS y(source_year, acs_year) ON y.source_year = q.acs_year
""",
    "tract_survey", "tract_zip",
)

# Geocoding

STEPS["prepared"] = (
    ("cases",),
    """
SELECT DISTINCT case_no, upper(incident_address) AS incident_address, coalesce(incident_city, 'CHICAGO') AS incident_city,
       upper(incident_address) || ', ' || coalesce(incident_city, 'CHICAGO') AS full_address
FROM cases WHERE NOT regexp_matches(case_no, '^[0-9[:punct:]]') AND substr(upper(incident_address), 1, 3) <> 'UNK'
""",
)
ORACLE["prepared_addresses"] = _sql(
    "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (ORDER BY case_no) AS rn FROM prepared) WHERE rn >= 2", "prepared"
)
_KM = """round(asin(sqrt(pow(sin((radians(41.87394839029574) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(41.87394839029574)) * pow(sin((radians(-87.68008235783819) - radians(lon)) / 2), 2))) * (2 * 6378137.0::DOUBLE / 1000), 6)"""
_NARROW = "lon BETWEEN -88.45017 AND -87.25895 AND lat BETWEEN 41.49624 AND 42.30971"
ORACLE["geocode_join"] = _sql(
    f"""
SELECT c.case_no, g.place_id, g.rank FROM (SELECT case_no, {_key("incident_address")} AS k FROM cases) c
JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY km, place_id) AS rank FROM (
  SELECT place_id, {_key("short_address")} AS k, {_KM} AS km FROM gazetteer WHERE {_NARROW})) g ON g.k = c.k AND g.rank <= 3
""",
    "cases", "gazetteer",
)

_TYPED = """CASE case_id % 5 WHEN 0 THEN replace(incident_address, 'Street', 'Stret') WHEN 1 THEN replace(incident_address, 'Street', 'Steret')
  WHEN 2 THEN replace(incident_address, 'Street#', 'Streett ') ELSE incident_address END"""
# Every pair that shares a word is weighed; the Spark side looks up the rare words alone.
ORACLE["geocode_fuzzy"] = _sql(
    """
SELECT t.case_no, r.place_id, r.rank, r.edits FROM typed t JOIN (
  SELECT q, place_id, edits, row_number() OVER (PARTITION BY q ORDER BY edits, shared DESC, km, place_id) AS rank FROM fits JOIN book USING (k)) r
ON r.q = t.q AND r.rank <= 2
""",
    "cases", "gazetteer",
    typed=f"SELECT case_no, {_key(_TYPED)} AS q FROM cases",
    book=f"SELECT place_id, upper({_key('short_address')}) AS k, {_KM} AS km FROM gazetteer WHERE {_NARROW}",
    held="SELECT DISTINCT k, unnest(string_split(k, ' ')) AS word FROM (SELECT DISTINCT k FROM book)",
    weights="SELECT word, CAST(round(1000 * ln(1 + (SELECT count(DISTINCT k) FROM book) / count(*)::DOUBLE)) AS BIGINT) AS w FROM held GROUP BY word",
    asked="SELECT q, word, w FROM (SELECT DISTINCT q, unnest(string_split(upper(q), ' ')) AS word FROM (SELECT DISTINCT q FROM typed WHERE q <> '')) JOIN weights USING (word)",
    totals="SELECT q, sum(w) AS total FROM asked GROUP BY q",
    fits="""SELECT q, k, shared, levenshtein(upper(q), k) AS edits FROM (SELECT q, k, sum(w) AS shared FROM asked JOIN held USING (word) GROUP BY q, k)
  JOIN totals USING (q) WHERE shared * 100 >= total * 70 AND levenshtein(upper(q), k) <= 2""",
)


def _agrees(given: str, found: str, pattern: str) -> str:
    number = f"nullif(regexp_extract({given}, '[0-9]+'), '')"
    return f"coalesce(regexp_matches({found}, '{pattern}'), false) AND contains({found}, {number})"


ORACLE["house_number"] = _sql(
    f"""
SELECT case_no, place_id, {_agrees("incident_address", "f", "[.*0-9{,}]")} AS agrees, {_agrees("incident_address", "f", "[0-9]{2}")} AS agrees_strict FROM (
  SELECT c.case_no, c.incident_address, g.place_id, coalesce(g.formatted, 'RURAL ROUTE ' || c.case_no) AS f
  FROM (SELECT *, {_key("incident_address")} AS k FROM cases) c LEFT JOIN (SELECT *, {_key("short_address")} AS k FROM gazetteer) g ON c.k IS NOT DISTINCT FROM g.k)
""",
    "cases", "gazetteer",
)
_LONG = "full_address || ', United States'"
for _short, _word in ((" S\\. ", " SOUTH "), (" S ", " SOUTH "), (" N\\. ", " NORTH "), (" N ", " NORTH "), (" W\\. ", " WEST "), (" W ", " WEST "), (" E\\. ", " EAST "), (" E ", " EAST ")):
    _LONG = f"regexp_replace({_LONG}, '{_short}', '{_word}')"


def _round(name: str, todo: str, query: str, col: str, k: int, where: str, km: str) -> str:
    """Accepted answers of one round."""
    return f"""
SELECT t.case_no, g.lat, g.lon, g.formatted FROM (SELECT *, {_key(query)} AS k FROM {todo}) t
JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY km, place_id) AS rank FROM (
  SELECT *, {_key(f"upper({col})")} AS k, {km} AS km FROM gazetteer WHERE {where})) g ON g.k = t.k AND g.rank <= {k}
WHERE {_agrees("t.incident_address", "g.formatted", "[.*0-9{,}]")}
"""


_ROUND_STEPS = {
    "r1": _round("raw", "prepared", "full_address", "city_address", 1, "contains(formatted, 'Cook County') AND lon BETWEEN -90.06527 AND -86.55094 AND lat BETWEEN 39.82326 AND 43.22390", _KM),
    "t2": "SELECT * FROM prepared WHERE case_no NOT IN (SELECT case_no FROM r1)",
    "r2": _round("rewritten", "t2", _LONG, "long_address", 3, _NARROW, _KM),
    "t3": "SELECT * FROM t2 WHERE case_no NOT IN (SELECT case_no FROM r2)",
    "r3": _round("fallback", "t3", "full_address", "city_address", 1, "true", "0"),
    "t4": "SELECT * FROM t3 WHERE case_no NOT IN (SELECT case_no FROM r3)",
}
_ZIP = "regexp_extract_all({f}, '[0-9]{5}')"
_CITY = r"regexp_extract_all({f}, ',\s[A-Za-z\s]+,\s')"


def _zip(f: str) -> str:
    codes = _ZIP.replace("{f}", f)
    return f"CASE WHEN len({codes}) > 1 THEN array_to_string(({codes})[2:], ' ') ELSE list_extract({codes}, 1) END"


def _city(f: str) -> str:
    parts = _CITY.replace("{f}", f)
    return f"trim(replace(list_extract({parts}, CASE WHEN len({parts}) > 2 THEN 2 ELSE 1 END), ',', ''))"


ORACLE["geocode_rounds"] = _sql(
    f"""
SELECT DISTINCT case_no, lat, lon, formatted AS full_address, {_zip("formatted")} AS zip, {_city("formatted")} AS city
FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)
""",
    "prepared", "gazetteer",
    **_ROUND_STEPS,
)
ORACLE["geocode_unplaced"] = _sql("SELECT * FROM t4", "prepared", "gazetteer", **_ROUND_STEPS)
_REFUSED = "(SELECT case_no FROM cases WHERE case_id % 6 = 1)"


def _refused(todo: str, query: str, col: str, k: int, where: str, km: str) -> str:
    """Answers of one round that do not pass."""
    return f"""
SELECT t.case_no, g.lat, g.lon, g.formatted FROM (SELECT *, {_key(query)} AS k FROM {todo}) t
JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY km, place_id) AS rank FROM (
  SELECT *, {_key(f"upper({col})")} AS k, {km} AS km FROM gazetteer WHERE {where})) g ON g.k = t.k AND g.rank <= {k}
WHERE ({_agrees("t.incident_address", "g.formatted", "[.*0-9{,}]")}) IS NOT TRUE
"""


# Of each case the answers of the last round it was asked in: those that fail, also beside a good one, or none;
# and every good answer of a case that has several.
ORACLE["geocode_to_check"] = _sql(
    """
SELECT p.*, f.lat AS found_lat, f.lon AS found_lon, f.formatted AS found_formatted FROM prepared p JOIN (
  SELECT * FROM f1 WHERE case_no IN (SELECT case_no FROM r1)
  UNION SELECT * FROM f2 WHERE case_no IN (SELECT case_no FROM r2)
  UNION SELECT * FROM f3
  UNION SELECT * FROM good WHERE case_no IN (SELECT case_no FROM good GROUP BY case_no HAVING count(*) > 1)
) f ON f.case_no = p.case_no
UNION
SELECT p.*, NULL, NULL, NULL FROM t4 p WHERE case_no NOT IN (SELECT case_no FROM f3)
""",
    "prepared", "gazetteer", "cases",
    **_ROUND_STEPS,
    f1=_refused("prepared", "full_address", "city_address", 1, "contains(formatted, 'Cook County') AND lon BETWEEN -90.06527 AND -86.55094 AND lat BETWEEN 39.82326 AND 43.22390", _KM),
    f2=_refused("t2", _LONG, "long_address", 3, _NARROW, _KM),
    f3=_refused("t3", "full_address", "city_address", 1, "true", "0"),
    good="SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3",
)
ORACLE["geocode_settled"] = _sql(
    f"""
SELECT DISTINCT case_no, lat, lon, formatted AS full_address, {_zip("formatted")} AS zip, {_city("formatted")} AS city
FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) WHERE case_no NOT IN {_REFUSED}
""",
    "prepared", "gazetteer", "cases",
    **_ROUND_STEPS,
)
STEPS["cleaned"] = (
    ("cases", "gazetteer"),
    f"""
SELECT case_no, lat, lon, name || ', Oak Park, IL 60301, USA' AS formatted FROM cases
WHERE (incident_city = 'OAK PARK' OR primary_cause_c IS NOT NULL) AND manner = 'Suicide' AND lat IS NOT NULL
UNION
SELECT t.case_no, g.lat, g.lon, g.formatted FROM (
  SELECT *, {_key("cleaned")} AS k FROM (
    SELECT case_no, CASE WHEN latino = 'YES' THEN '' ELSE upper(replace(replace(incident_address, '.', ''), '#', ' ')) END AS cleaned FROM cases
    WHERE (incident_city = 'OAK PARK' OR primary_cause_c IS NOT NULL) AND NOT (manner = 'Suicide' AND lat IS NOT NULL)) WHERE cleaned <> '') t
JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY km, place_id) AS rank FROM (
  SELECT *, {_key("upper(short_address)")} AS k, {_KM} AS km FROM gazetteer WHERE {_NARROW})) g ON g.k = t.k AND g.rank = 1
WHERE {_agrees("t.cleaned", "g.formatted", "[.*0-9{,}]")}
""",
)
ORACLE["cleaned_locations"] = _sql("SELECT * FROM cleaned", "cleaned")
ORACLE["confirmed_locations"] = _sql(
    f"""
SELECT DISTINCT case_no, lat, lon, formatted AS full_address, {_zip("formatted")} AS zip, {_city("formatted")} AS city
FROM (SELECT * FROM confirmed UNION ALL SELECT * FROM r4)
""",
    "prepared", "gazetteer", "cleaned",
    **{n: _ROUND_STEPS[n] for n in ("r1", "t2", "r2")},
    confirmed="SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM cleaned",
    t9="SELECT * FROM prepared WHERE case_no NOT IN (SELECT case_no FROM confirmed)",
    r4=_round("fallback", "t9", "full_address", "city_address", 1, "true", "0"),
)
ORACLE["parse_zip_city"] = _sql(
    f"SELECT place_id, {_zip('formatted')} AS zip, {_city('formatted')} AS city FROM gazetteer", "gazetteer"
)
_EXPANDED = _LONG.replace("full_address || ', United States'", "short_address")
ORACLE["text_replace"] = _sql(
    rf"""
SELECT place_id, {_EXPANDED} AS expanded, regexp_replace(formatted, ' STREET', '') AS shorter, regexp_replace(formatted, '[AEIOU]', '_', 'g') AS masked,
       regexp_replace(short_address, '[^\p{{L}}]+$', '') AS trimmed, {_key("formatted")} AS key, nullif(regexp_extract(formatted, '[0-9]+'), '') AS number FROM gazetteer
""",
    "gazetteer",
)
_FIELDS = {
    "STREET": "street", "CITY": "adminArea5", "COUNTY": "adminArea4", "STATE": "adminArea3", "ZIP": "postalCode",
    "GEO_QUALITY": "geocodeQuality", "GEO_QUAL_CODE": "geocodeQualityCode",
}
_flat_cols = []
for _i, _suffix in enumerate(("", "_2", "_3")):
    _at = f"$.results[0].locations[{_i}]"
    _flat_cols += [f"json_extract_string(response, '{_at}.{p}') AS {n}{_suffix}" for n, p in _FIELDS.items()]
    _flat_cols += [f"CAST(json_extract_string(response, '{_at}.latLng.{p}') AS DOUBLE) AS {n}{_suffix}" for n, p in (("LAT", "lat"), ("LON", "lng"))]
STEPS["flat"] = (
    ("responses",),
    "SELECT hash_key AS HASH_KEY, json_extract_string(response, '$.results[0].providedLocation.street') AS RAW, " + ", ".join(_flat_cols) + " FROM responses",
)
_ALL = [*_FIELDS, "LAT", "LON"]
_PICK = """CASE WHEN COUNTY IS NULL THEN NULL WHEN COUNTY = 'Cook' THEN CASE WHEN STATE IS NULL THEN NULL WHEN STATE = 'IL' THEN 1 ELSE 0 END
  ELSE CASE WHEN (COUNTY_2 = 'Cook' AND STATE_2 = 'IL') IS NULL THEN NULL WHEN COUNTY_2 = 'Cook' AND STATE_2 = 'IL' THEN 2
    WHEN (COUNTY_3 = 'Cook' AND STATE_3 = 'IL') IS NULL THEN NULL WHEN COUNTY_3 = 'Cook' AND STATE_3 = 'IL' THEN 3 ELSE 0 END END"""
STEPS["chosen"] = (
    ("flat",),
    "SELECT *, "
    + ", ".join(
        f"CASE pick WHEN 0 THEN 'MISIDENTIFIED' WHEN 1 THEN CAST({f} AS VARCHAR) WHEN 2 THEN CAST({f}_2 AS VARCHAR) WHEN 3 THEN CAST({f}_3 AS VARCHAR) END AS {f}_FIN"
        for f in _ALL
    )
    + f" FROM (SELECT *, {_PICK} AS pick FROM flat)",
)
ORACLE["candidates_flat"] = _sql("SELECT * FROM flat", "flat")
ORACLE["candidates_choose"] = _sql(
    "SELECT RAW, STREET_FIN, CITY_FIN, COUNTY_FIN, STATE_FIN, ZIP_FIN, LAT_FIN, LON_FIN FROM chosen WHERE LAT_FIN <> 'MISIDENTIFIED'", "chosen"
)
ORACLE["candidates_manual"] = _sql(
    "SELECT HASH_KEY, RAW, STREET_FIN, LAT_FIN FROM chosen WHERE LAT_FIN IS NULL OR LAT_FIN = 'MISIDENTIFIED'", "chosen"
)
ORACLE["address_requests"] = _sql(
    r"""
SELECT DISTINCT md5(regexp_replace(concat_ws('', incident_address, 'Cook', 'IL', incident_city), '\s', '', 'g')) AS hash_key,
  '?street=' || coalesce(replace(regexp_replace(incident_address, '\s', '+', 'g'), '.', ''), '') || '&county=Cook&state=IL&city=' || coalesce(incident_city, '') || '&maxResults=3' AS request
FROM cases
""",
    "cases",
)
ORACLE["location_fields_merged"] = _sql(
    """
SELECT incident_address, case_no, upper(street_fin) AS street, CASE WHEN raw IS NOT NULL THEN 'EVANSTON' ELSE incident_city END AS city, 'IL' AS state,
       coalesce(CASE WHEN raw IS NOT NULL AND NOT contains(formatted, 'RED') THEN 60601 END, age + 60600) AS zip, coalesce(lat_fin, lat) AS lat, coalesce(lon_fin, lon) AS lon, kind AS loc_type,
       CASE WHEN kind = 'HOSPITAL' AND status <> 'CLOSED' THEN 'OPEN' WHEN kind <> 'HOSPITAL' THEN 'N/A' ELSE kind END AS status
FROM (SELECT *, CASE WHEN manner = 'Suicide' THEN 'SCENE' WHEN sex = 'Male' THEN 'HOSPITAL' ELSE 'SCENE' END AS kind, CASE WHEN latino = 'YES' THEN 'CLOSED' ELSE 'UNKNOWN' END AS status FROM cases) c
LEFT JOIN (SELECT replace(replace(short_address, ' S ', ' S. '), 'Street ', 'Street#') AS raw, short_address AS street_fin, formatted, lat AS lat_fin, lon AS lon_fin FROM gazetteer) g ON c.incident_address = g.raw
""",
    "cases", "gazetteer",
)

ORACLE["response_maps"] = _sql(
    """
SELECT md5(CAST(c_custkey AS VARCHAR)) AS "HASH_KEY", CAST(c_custkey AS VARCHAR) || ' MAIN' AS "RAW",
       1 + CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 7 = 0 THEN 1 ELSE 2 END AS candidates FROM customer
"""
)
ORACLE["headers_repaired"] = _sql(
    'SELECT case_id AS "X_id", age AS "Age..years.", sex AS "...3", lat AS "lat", lon AS "lat.1" FROM cases', "cases"
)
ORACLE["geojson_rings"] = _sql(
    "SELECT geoid10, round(area, 8) AS area, 1 AS rings FROM centres", "tracts_e", centres=_CENTROID
)
ORACLE["census_named"] = _sql("SELECT zcta, datayear, total_pop, pop_race_white FROM census", "census")
ORACLE["location_fields_manual"] = _sql(
    """
SELECT incident_address, case_no, CASE WHEN place_id % 3 <> 0 THEN upper(short_address) ELSE 'old street' END AS street,
       CASE WHEN place_id % 2 = 0 THEN 'EVANSTON' ELSE incident_city END AS city, 'IL' AS state,
       CASE WHEN place_id % 3 <> 0 THEN 60601 ELSE age + 60600 END AS zip,
       CASE WHEN place_id % 3 <> 0 THEN g.glat ELSE lat END AS lat, CASE WHEN place_id % 3 <> 0 THEN g.glon ELSE lon END AS lon
FROM cases c
LEFT JOIN (SELECT replace(replace(short_address, ' S ', ' S. '), 'Street ', 'Street#') AS raw, short_address, place_id, lat AS glat, lon AS glon FROM gazetteer) g ON c.incident_address = g.raw
""",
    "cases", "gazetteer",
)

# Profiles, positions, checks

ORACLE["freq_sorted"] = _sql(
    "SELECT incident_address, count(*) AS freq FROM cases WHERE incident_address IS NOT NULL GROUP BY 1 ORDER BY freq DESC, incident_address", "cases"
)
ORACLE["city_frequency"] = _sql(
    "SELECT incident_city, count(*) AS freq FROM cases WHERE incident_city <> 'CHICAGO' GROUP BY 1", "cases"
)
ORACLE["numbered_addresses"] = _sql(
    """
SELECT raw, raw AS address, '' AS city, 'IL' AS state, '' AS zip, row_number() OVER (ORDER BY raw) AS id
FROM (SELECT DISTINCT incident_address AS raw FROM cases WHERE regexp_matches(incident_address, '^[123456789]+'))
""",
    "cases",
)
ORACLE["histogram"] = _sql(
    """
SELECT sex, bin, round(lo + bin * w, 6) AS bin_start, count(*) AS count FROM (
  SELECT sex, lo, w, CAST(least(floor((d - lo) / w), 29) AS INT) AS bin FROM (
    SELECT sex, d, min(d) OVER () AS lo, (max(d) OVER () - min(d) OVER ()) / 30 AS w FROM (SELECT sex, CAST(date_diff('day', DATE '1970-01-01', date_of_death) AS DOUBLE) AS d FROM cases)))
GROUP BY ALL
""",
    "cases",
)
ORACLE["summary_stats"] = _sql(
    """
SELECT round(min(m), 4) AS min, round(quantile_cont(m, 0.25), 4) AS q1, round(quantile_cont(m, 0.5), 4) AS median, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.75), 4) AS q3,
       round(max(m), 4) AS max, count(*) - count(m) AS missing FROM (SELECT CASE WHEN race IS NOT NULL THEN measure END AS m FROM cases)
""",
    "cases",
)
ORACLE["repeat_count"] = _sql(
    """
SELECT case_id, address, CASE WHEN address IS NULL OR address = '' THEN -1 ELSE count(*) OVER (PARTITION BY address) END AS at_location
FROM (SELECT case_id, CASE WHEN sex = 'Male' THEN incident_address ELSE '' END AS address FROM cases)
""",
    "cases",
)
ORACLE["row_slice"] = _sql(
    "SELECT case_no, date_of_death, case_id FROM cases QUALIFY row_number() OVER (ORDER BY date_of_death, case_id) BETWEEN 51 AND 500", "cases"
)
ORACLE["row_ids"] = _sql("SELECT case_id, measure, row_number() OVER (ORDER BY measure, case_id) AS row_id FROM cases", "cases")
ORACLE["first_per_group"] = _sql(
    "SELECT race, latino, age, case_no, lat FROM cases QUALIFY row_number() OVER (PARTITION BY race, latino, age ORDER BY case_id) = 1", "cases"
)
ORACLE["distinct_rows"] = _sql("SELECT DISTINCT race, latino, incident_address FROM cases", "cases")
ORACLE["max_per_group"] = _sql(
    "SELECT race, latino, max(measure) AS largest, count(*) AS rows FROM cases WHERE race IS NOT NULL AND latino IS NOT NULL GROUP BY 1, 2", "cases"
)
ORACLE["ordered_limited"] = _sql("SELECT case_id, measure FROM cases ORDER BY measure DESC, case_id LIMIT 200", "cases")
ORACLE["checks_report"] = _sql(
    """
SELECT 'cases' AS "table", count(*) AS rows FROM cases
UNION ALL SELECT 'outside', count(*) FROM cases c LEFT JOIN cases_in_areas a ON c.lon = a.px AND c.lat = a.py WHERE a.area_id IS NULL AND c.incident_city = 'CHICAGO'
UNION ALL SELECT 'unmatched', count(*) FROM cases c LEFT JOIN cases_in_areas a ON c.lon = a.px AND c.lat = a.py WHERE a.area_id IS NULL
UNION ALL SELECT 'conflicts', count(*) FROM cases WHERE sex = 'Male' AND incident_city <> 'CHICAGO'
UNION ALL SELECT 'duplicates', count(*) FROM (SELECT incident_address FROM cases GROUP BY 1 HAVING count(*) > 1)
""",
    "cases_in_areas",
)
ORACLE["checks_filled"] = _sql(
    "SELECT count(race) AS race, count(latino) AS latino, count(incident_address) AS incident_address, count(lat) AS lat, true AS nothing_empty FROM cases", "cases"
)

ORACLE["checks_report"] = _sql(
    """
SELECT 'rows' AS "check", count(*) AS count FROM budget_lines
UNION ALL SELECT 'filled_function_area', count(function_area) FROM budget_lines
UNION ALL SELECT 'filled_tab', count(tab) FROM budget_lines
UNION ALL SELECT 'filled_general_fund_type', count(general_fund_type) FROM budget_lines
UNION ALL SELECT 'filled_amount', count(amount) FROM budget_lines
UNION ALL SELECT 'health_without_tab', count(*) FROM budget_lines WHERE contains(department, 'Hospital') AND tab IS NULL
UNION ALL SELECT 'fund_differs', count(*) FROM budget_lines WHERE upper(trim(fund)) <> upper(general_fund_type)
UNION ALL SELECT 'above_300000', count(*) FROM budget_lines WHERE TRY_CAST(amount AS DOUBLE) > 300000
UNION ALL SELECT 'lost_amount', count(*) FROM budget_lines WHERE amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL
""",
    "budget_lines",
)
ORACLE["dates_mdy"] = """
SELECT form, text, CAST(coalesce(
    try_strptime(text, '%m/%d/%Y'), try_strptime(text, '%m-%d-%Y'), try_strptime(text, '%m.%d.%y'), try_strptime(text, '%B %d, %Y'),
    try_strptime(text, '%b %d %Y'), CASE WHEN length(text) = 8 THEN try_strptime(text, '%m%d%Y') END) AS DATE) AS day, count(*) AS n
FROM (
    SELECT k AS form, CASE k WHEN 0 THEN strftime(d, '%-m/%-d/%Y') WHEN 1 THEN strftime(d, '%m-%d-%Y') WHEN 2 THEN strftime(d, '%-m.%-d.%y')
        WHEN 3 THEN strftime(d, '%B %-d, %Y') WHEN 4 THEN strftime(d, '%b %d %Y') WHEN 5 THEN strftime(d, '%m%d%Y') WHEN 6 THEN strftime(d, '%d/%m/%Y') END AS text
    FROM (SELECT CAST(o_orderkey % 8 AS INT) AS k, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders))
GROUP BY ALL
"""
