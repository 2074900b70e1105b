"""Common table expressions of the DuckDB oracle, and a builder that pulls in what a query needs."""

from __future__ import annotations

import math
import re


def hu(n: str, d: str, digits: int = 2) -> str:
    """n / d rounded half away from zero in whole-number arithmetic, as DOUBLE."""
    ten = 10 ** digits
    n, d = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    return (f"(CASE WHEN {d} > 0 THEN CAST(sign({n}) * ((2 * {ten} * abs({n}) + {d}) // (2 * {d})) AS DOUBLE)"
            f" / {ten}::DOUBLE END)")


def cents(column: str) -> str:
    """A two-digit DOUBLE as whole hundredths."""
    return f"CAST(round({column} * 100) AS HUGEINT)"


def flag(column: str) -> str:
    return f"CASE WHEN {column} = 'True' THEN 1 ELSE 0 END"


def text(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'True' ELSE 'False' END"


MEAN_RATIO = hu(f"sum({cents('Passengers_Per_Bus')})", "100 * count(Passengers_Per_Bus)")
TOTALS = ("CAST(sum(Passenger_Departures) AS BIGINT) AS Total_Passengers, "
          "CAST(sum(Bus_Departures) AS BIGINT) AS Total_Buses")
WEIGHTED = hu("sum(Passenger_Departures)", "sum(Bus_Departures)")
SUMMARY = f"{TOTALS}, {MEAN_RATIO} AS Avg_Passengers_Per_Bus, {WEIGHTED} AS Weighted_Passengers_Per_Bus"

DIGITS = 4


def mean4(column: str) -> str:
    """Mean of values with four digits, exact before its own rounding."""
    return hu(f"sum(CAST(round({column} * 10000) AS HUGEINT))", f"10000 * count({column})", DIGITS)


def sum4(column: str) -> str:
    return f"(CAST(sum(CAST(round({column} * 10000) AS HUGEINT)) AS DOUBLE) / 10000::DOUBLE)"


Z = 1.28155
EPOCH_WEEKS = "(date_diff('day', DATE '1970-01-01', {d}) / 7::DOUBLE)"


def _forecast(prefix: str, totals: str, key: str | None) -> dict[str, str]:
    """Trend times ISO-week index for one series, or one per key."""
    k = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    using = f"USING ({key})" if key else "ON true"
    using_wk = f"USING ({k}Week)"
    t = EPOCH_WEEKS.format(d="Week_Date")
    tf = EPOCH_WEEKS.format(d="ds")
    return {
        f"{prefix}_h": f"""SELECT {k}Week_Date, CAST(Passenger_Departures AS DOUBLE) AS y, {t} AS t,
            CAST(week(Week_Date) AS INTEGER) AS Week FROM {totals}""",
        f"{prefix}_p": f"""SELECT {k}coalesce(regr_slope(y, t), 0) AS slope,
            coalesce(regr_intercept(y, t), avg(y)) AS intercept, min(Week_Date) AS first, min(t) AS t0, max(t) AS t1
            FROM {prefix}_h {group}""",
        f"{prefix}_f": f"""SELECT {prefix}_h.*, first, intercept + slope * t AS trend
            FROM {prefix}_h JOIN {prefix}_p {using}""",
        f"{prefix}_i": f"""SELECT {k}Week, avg(y / nullif(trend, 0)) AS idx FROM {prefix}_f GROUP BY {k}Week""",
        f"{prefix}_s": f"""SELECT {k}coalesce(stddev_samp(y - trend * coalesce(idx, 1)), 0) AS sigma
            FROM {prefix}_f JOIN {prefix}_i {using_wk} {group}""",
        f"{prefix}_y": f"""SELECT {k}date_diff('day', first, Week_Date) // 364 AS yr, regr_slope(y / nullif(idx, 0), t) AS s
            FROM {prefix}_f JOIN {prefix}_i {using_wk} GROUP BY {k}yr
            HAVING regr_count(y / nullif(idx, 0), t) >= 13 AND regr_slope(y / nullif(idx, 0), t) IS NOT NULL""",
        f"{prefix}_d": f"""SELECT {k}s - lag(s) OVER ({f"PARTITION BY {key} " if key else ""}ORDER BY yr) AS d FROM {prefix}_y""",
        f"{prefix}_l": f"""SELECT {k}round(avg(abs(d)), 6) AS lam, count(d) AS n FROM {prefix}_d {group}""",
        f"{prefix}_w": f"""SELECT {k}t1, coalesce(2 * lam * lam * n / nullif(3 * (t1 - t0), 0), 0) AS grow
            FROM {prefix}_p LEFT JOIN {prefix}_l {using}""",
        f"{prefix}_c": f"""SELECT {k}slope, intercept, ds, CAST(year(ds) AS INTEGER) AS Year,
            CAST(month(ds) AS INTEGER) AS Month, CAST(week(ds) AS INTEGER) AS Week
            FROM {prefix}_p CROSS JOIN future""",
        prefix: f"""SELECT {k}ds, round(yh, {DIGITS}) AS yhat, round(yh - {Z} * width, {DIGITS}) AS yhat_lower,
            round(yh + {Z} * width, {DIGITS}) AS yhat_upper, Year, Month, Week FROM (
              SELECT {k}ds, Year, Month, Week, (intercept + slope * {tf}) * coalesce(idx, 1) AS yh,
                     sqrt(sigma * sigma + coalesce(idx, 1) * coalesce(idx, 1) * grow * ({tf} - t1) * ({tf} - t1) * ({tf} - t1)) AS width
              FROM {prefix}_c LEFT JOIN {prefix}_i {using_wk} JOIN {prefix}_s {using} JOIN {prefix}_w {using})""",
    }


def _additive(prefix: str, totals: str, key: str) -> dict[str, str]:
    """Ridge fit of trend, hinges and yearly waves per key: sums, then the elimination spelled out column by column."""
    changes, order, ridge, width = 12, 6, 0.05, 26
    knots = [0.8 * (i + 1) / (changes + 1) for i in range(changes)]
    turn = 2 * math.pi / 365.25
    hinges = ", ".join(f"greatest(t - {k!r}::DOUBLE, 0)" for k in knots)
    waves = ", ".join(f"{f}(day * {turn!r}::DOUBLE * {k})" for k in range(1, order + 1) for f in ("sin", "cos"))
    row = f"[1::DOUBLE, t, {hinges}, {waves}]"
    dot = "list_sum(list_transform(list_zip(x, beta), lambda z: z[1] * z[2]))"
    sums = ", ".join(f"sum(z[i] * z[{j}])" for j in range(1, width + 2))
    steps = {f"{prefix}_e0": f"""SELECT {key}, list(list_transform(r, lambda v, j: CASE WHEN j = i AND j > 1 THEN v + {ridge} * n ELSE v END) ORDER BY i) AS m
        FROM {prefix}_m JOIN {prefix}_p USING ({key}) GROUP BY {key}"""}
    for k in range(1, width + 1):
        steps[f"{prefix}_e{k}"] = f"""SELECT {key}, list_transform(m, lambda r, i: CASE WHEN i = {k} THEN r
            ELSE list_transform(list_zip(r, m[{k}]), lambda z: z[1] - r[{k}] / m[{k}][{k}] * z[2]) END) AS m FROM {prefix}_e{k - 1}"""
    return {
        f"{prefix}_h": f"""SELECT {key}, date_diff('day', DATE '1970-01-01', Week_Date) AS day,
            CAST(Passenger_Departures AS DOUBLE) AS y FROM {totals}""",
        f"{prefix}_p": f"SELECT {key}, min(day) AS f, max(day) AS l, count(*) AS n FROM {prefix}_h GROUP BY {key}",
        f"{prefix}_x": f"""SELECT {key}, y, {row} AS x FROM (SELECT {prefix}_h.*, (day - f) / greatest(l - f, 1)::DOUBLE AS t
            FROM {prefix}_h JOIN {prefix}_p USING ({key}))""",
        f"{prefix}_m": f"""SELECT {key}, i, [{sums}] AS r FROM (SELECT {key}, list_append(x, y) AS z FROM {prefix}_x),
            generate_series(1, {width}) AS g(i) GROUP BY {key}, i""",
        **steps,
        f"{prefix}_b": f"SELECT {key}, list_transform(m, lambda r, i: r[{width + 1}] / r[i]) AS beta FROM {prefix}_e{width}",
        f"{prefix}_r": f"""SELECT {key}, avg(pow(y - {dot}, 2)) AS miss FROM {prefix}_x JOIN {prefix}_b USING ({key}) GROUP BY {key}""",
        f"{prefix}_g": f"""SELECT {key}, f, l, beta, miss, 2 * pow(list_sum(list_transform(beta[3:{changes + 2}], lambda v: abs(v))) / {changes}, 2)
            * {changes} / 3 AS grow FROM {prefix}_p JOIN {prefix}_b USING ({key}) JOIN {prefix}_r USING ({key})""",
        f"{prefix}_c": f"""SELECT {key}, ds, beta, miss, grow, t - 1 AS ahead, {row} AS x FROM (
            SELECT {prefix}_g.*, ds, date_diff('day', DATE '1970-01-01', ds) AS day,
                (date_diff('day', DATE '1970-01-01', ds) - f) / greatest(l - f, 1)::DOUBLE AS t FROM {prefix}_g CROSS JOIN future)""",
        prefix: f"""SELECT {key}, ds, round(v, 2) AS yhat, round(v - {Z} * w, 2) AS yhat_lower, round(v + {Z} * w, 2) AS yhat_upper,
            CAST(year(ds) AS INTEGER) AS Year, CAST(month(ds) AS INTEGER) AS Month, CAST(week(ds) AS INTEGER) AS Week
            FROM (SELECT {key}, ds, {dot} AS v, sqrt(miss + grow * ahead * ahead * ahead) AS w FROM {prefix}_c)""",
    }


FEATURES = [
    "Year_Num", "Quarter", "Month_Num", "Week_Num", "Avg_Temp_F", "Precipitation_Inches",
    "Is_Severe_Weather", "Is_Holiday", "Is_Tourism_Peak", "Days_Since_Pandemic_Start",
    "Is_COVID_Period", "Is_High_Inflation", "Is_Summer", "Is_Winter", "Baseline_2019_Passengers"]


def _forest(trees: int = 100, depth: int = 10, seed: int = 42, bins: int = 32, cells: int = 4096) -> dict[str, str]:
    """A forest of binned features, level by level: the rows with their node, then the best split of each node."""
    bounds = [int(2 ** 32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11)]
    numbers = f"range({len(FEATURES)})"
    steps = {
        "fr_v": f"""SELECT Carrier_Name, Week_Date, unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in FEATURES)}]) AS x,
            unnest({numbers}) AS f FROM feat""",
        "fr_l": "SELECT f, min(x) AS lo, max(x) AS hi FROM fr_v GROUP BY f",
        "fr_c": f"""SELECT f, CASE WHEN hi > lo THEN least(CAST(floor((x - lo) / (hi - lo) * {cells}) AS BIGINT), {cells - 1})
            ELSE 0 END AS cell, count(*) AS n, max(x) AS edge FROM fr_v JOIN fr_l USING (f) GROUP BY 1, 2""",
        "fr_q": f"""SELECT f, edge, CASE WHEN count(*) OVER (PARTITION BY f) <= {bins}
            THEN row_number() OVER (PARTITION BY f ORDER BY cell)
            ELSE CAST({bins} * (sum(n) OVER (PARTITION BY f ORDER BY cell) - n) // sum(n) OVER (PARTITION BY f) AS BIGINT) END AS bin
            FROM fr_c""",
        "fr_e": "SELECT f, list(edge ORDER BY edge) AS edges FROM (SELECT f, bin, max(edge) AS edge FROM fr_q GROUP BY f, bin) GROUP BY f",
        "fr_x": """SELECT Carrier_Name, Week_Date, list(len(list_filter(edges, lambda u: u < x)) ORDER BY f) AS x
            FROM fr_v JOIN fr_e USING (f) GROUP BY Carrier_Name, Week_Date""",
        "fr_u": f"""SELECT Carrier_Name, Week_Date, CAST(t AS INTEGER) AS Tree, CAST('0x' || substr(md5('{seed}:' || t || ':'
            || Carrier_Name || ':' || CAST(Week_Date AS VARCHAR)), 1, 8) AS BIGINT) AS u
            FROM feat, generate_series(1, {trees}) AS g(t)""",
        "fr_s0": f"""SELECT * FROM (SELECT Tree, 1 AS Node, len(list_filter({bounds}, lambda d: d <= u)) AS w, Passenger_Departures AS y, x
            FROM fr_u JOIN fr_x USING (Carrier_Name, Week_Date) JOIN feat USING (Carrier_Name, Week_Date)) WHERE w > 0""",
    }
    for k in range(depth):
        steps[f"fr_h{k}"] = f"""SELECT Tree, Node, f, b, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * y) AS BIGINT) AS s
            FROM (SELECT Tree, Node, w, y, unnest(x) AS b, unnest({numbers}) AS f FROM fr_s{k}) GROUP BY ALL"""
        steps[f"fr_b{k}"] = f"""SELECT Tree, Node, f, b, gain, ln, ls, n - ln AS rn, s - ls AS rs FROM (
            SELECT *, pow2 / (CAST(ln AS DOUBLE) * CAST(n - ln AS DOUBLE)) / CAST(n AS DOUBLE) AS gain FROM (
              SELECT *, d * d AS pow2 FROM (SELECT *, CAST(ls AS DOUBLE) * CAST(n - ln AS DOUBLE)
                  - CAST(s - ls AS DOUBLE) * CAST(ln AS DOUBLE) AS d FROM (
                SELECT Tree, Node, f, b, CAST(sum(n) OVER up AS BIGINT) AS ln, CAST(sum(s) OVER up AS BIGINT) AS ls,
                  CAST(sum(n) OVER one AS BIGINT) AS n, CAST(sum(s) OVER one AS BIGINT) AS s FROM fr_h{k}
                WINDOW one AS (PARTITION BY Tree, Node, f), up AS (PARTITION BY Tree, Node, f ORDER BY b)) WHERE ln < n)))
            WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY Tree, Node ORDER BY gain DESC, f, b) = 1"""
        steps[f"fr_s{k + 1}"] = f"""SELECT r.Tree, CAST(2 * r.Node + CASE WHEN x[f + 1] > b THEN 1 ELSE 0 END AS INTEGER) AS Node, w, y, x
            FROM fr_s{k} r JOIN fr_b{k} p ON r.Tree = p.Tree AND r.Node = p.Node"""
    steps["fr_p"] = "\nUNION ALL ".join(f"SELECT * FROM fr_b{k}" for k in range(depth))
    names = "[" + ", ".join(f"'{c}'" for c in FEATURES) + "]"
    steps["fr_n"] = f"""SELECT a.Tree, a.Node, a.n AS Rows, CAST(a.s AS DOUBLE) / a.n AS Prediction, {names}[p.f + 1] AS Feature,
        edges[p.b + 1] AS Threshold, p.gain AS Gain FROM (
          SELECT Tree, Node, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * y) AS BIGINT) AS s FROM fr_s0 GROUP BY Tree, Node
          UNION ALL SELECT Tree, 2 * Node, ln, ls FROM fr_p UNION ALL SELECT Tree, 2 * Node + 1, rn, rs FROM fr_p) a
        LEFT JOIN fr_p p ON a.Tree = p.Tree AND a.Node = p.Node LEFT JOIN fr_e e ON e.f = p.f"""
    place = "SELECT Carrier_Name, Week_Date, Tree, 1 AS Node, x FROM fr_u JOIN fr_x USING (Carrier_Name, Week_Date)"
    for k in range(depth):
        place = f"""SELECT Carrier_Name, Week_Date, r.Tree, CASE WHEN p.f IS NULL THEN r.Node WHEN x[p.f + 1] > p.b THEN 2 * r.Node + 1
            ELSE 2 * r.Node END AS Node, x FROM ({place}) r LEFT JOIN fr_p p ON r.Tree = p.Tree AND r.Node = p.Node"""
    steps["fr_t"] = place
    return steps


_ROWS = "PARTITION BY Carrier_Name ORDER BY Week_Date"
W = f"OVER ({_ROWS})"
R4 = f"OVER ({_ROWS} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
R12 = f"OVER ({_ROWS} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
C4 = f"OVER ({_ROWS} RANGE BETWEEN INTERVAL 21 DAY PRECEDING AND CURRENT ROW)"
C12 = f"OVER ({_ROWS} RANGE BETWEEN INTERVAL 77 DAY PRECEDING AND CURRENT ROW)"

CTES: dict[str, str] = {
    "wk": """SELECT CAST(date_trunc('week', l_shipdate) + INTERVAL 4 DAY AS DATE) AS Week_Date,
            n_name AS Carrier_Name, n_name || ' Lines' AS Carrier_Full_Name, r_name AS Service_Type,
            CAST(count(DISTINCT l_orderkey) AS BIGINT) AS Bus_Departures,
            CAST(sum(l_quantity) AS BIGINT) AS Passenger_Departures
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2, 3, 4""",
    "cal": """SELECT *, CAST(year(Week_Date) AS INTEGER) AS Year, CAST(quarter(Week_Date) AS INTEGER) AS Quarter,
            CAST(month(Week_Date) AS INTEGER) AS Month, monthname(Week_Date) AS Month_Name,
            CAST(week(Week_Date) AS INTEGER) AS Week_of_Year,
            CASE WHEN month(Week_Date) IN (12, 1, 2) THEN 'Winter' WHEN month(Week_Date) IN (3, 4, 5) THEN 'Spring'
                 WHEN month(Week_Date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS Season
        FROM wk""",
    "att": f"""SELECT *, CAST(30 + (Week_of_Year * 13) % 61 AS DOUBLE) AS Avg_Temp_F,
            ((Week_of_Year * 7) % 10) / 10::DOUBLE AS Precipitation_Inches,
            CAST(CASE WHEN Month IN (12, 1, 2) THEN Week_of_Year % 3 + 1 ELSE 0 END AS DOUBLE) AS Snow_Inches,
            CASE WHEN Week_of_Year % 11 = 0 THEN NULL WHEN (Week_of_Year * 7) % 10 >= 7 THEN 'Rain'
                 ELSE 'Normal' END AS Weather_Condition,
            {text("Month IN (12, 1, 2) AND Week_of_Year % 3 = 2")} AS Is_Severe_Weather,
            CASE WHEN Week_Date >= DATE '2001-10-01' THEN NULL WHEN Week_Date < DATE '1997-01-01' THEN 'Pre'
                 WHEN Week_Date < DATE '1998-07-01' THEN 'During' WHEN Week_Date < DATE '2000-01-01' THEN 'Recovery'
                 ELSE 'Post' END AS COVID_Period,
            CASE WHEN Year >= 2000 THEN 'High' ELSE 'Stable' END AS Economic_Period,
            {text("Week_Date >= DATE '1997-01-01' AND Week_Date < DATE '1998-07-01'")} AS Is_COVID_Period,
            {text("Year >= 2000")} AS Is_High_Inflation,
            CAST(date_diff('day', DATE '1997-01-01', Week_Date) AS INTEGER) AS Days_Since_Pandemic_Start,
            {text("Week_of_Year IN (1, 27, 47, 52)")} AS Is_Holiday,
            {text("Month IN (7, 8, 12)")} AS Is_Tourism_Peak,
            CASE Week_of_Year WHEN 47 THEN 'Parade' WHEN 1 THEN 'New Year' END AS NYC_Event
        FROM cal""",
    "bas": """SELECT Carrier_Name, Week_of_Year, CAST(sum(Bus_Departures) AS BIGINT) AS Baseline_2019_Buses,
            CAST(sum(Passenger_Departures) AS BIGINT) AS Baseline_2019_Passengers
        FROM cal WHERE Year = 1995 GROUP BY 1, 2""",
    "stg": f"""SELECT Week_Date, Year, Quarter, Month, Month_Name, Week_of_Year, Season,
            Carrier_Name, Carrier_Full_Name, Service_Type, Bus_Departures, Passenger_Departures,
            {hu("Passenger_Departures", "Bus_Departures")} AS Passengers_Per_Bus,
            Baseline_2019_Buses, Baseline_2019_Passengers,
            {hu("100 * Bus_Departures", "Baseline_2019_Buses")} AS Bus_Recovery_Percent,
            {hu("100 * Passenger_Departures", "Baseline_2019_Passengers")} AS Passenger_Recovery_Percent,
            CAST(Bus_Departures - lag(Bus_Departures) {W} AS DOUBLE) AS Bus_WoW_Change,
            CAST(Passenger_Departures - lag(Passenger_Departures) {W} AS DOUBLE) AS Passenger_WoW_Change,
            {hu(f"sum(Bus_Departures) {R4}", f"count(Bus_Departures) {R4}")} AS Bus_4wk_MA,
            {hu(f"sum(Passenger_Departures) {R4}", f"count(Passenger_Departures) {R4}")} AS Passenger_4wk_MA,
            {hu(f"sum(Bus_Departures) {R12}", f"count(Bus_Departures) {R12}")} AS Bus_12wk_MA,
            {hu(f"sum(Passenger_Departures) {R12}", f"count(Passenger_Departures) {R12}")} AS Passenger_12wk_MA,
            Avg_Temp_F, Precipitation_Inches, Snow_Inches, Weather_Condition, Is_Severe_Weather,
            COVID_Period, Economic_Period, Is_COVID_Period, Is_High_Inflation, Days_Since_Pandemic_Start,
            Is_Holiday, Is_Tourism_Peak, NYC_Event
        FROM att LEFT JOIN bas USING (Carrier_Name, Week_of_Year)""",
    "bad": """SELECT Week_Date, Carrier_Name, CASE WHEN Year = 1996 AND Week_of_Year % 2 = 1 AND Carrier_Name LIKE '%3'
                THEN Carrier_Name || ' Bus' ELSE Carrier_Full_Name END AS Full_Name,
            CASE WHEN Week_of_Year = 10 AND Carrier_Name LIKE '%7' THEN 'True' ELSE Is_Holiday END AS Is_Holiday FROM att""",
    "span": """SELECT CASE WHEN make_date(Year, Quarter * 3 - 2, 1) > (SELECT min(Week_Date) FROM cal) THEN make_date(Year, Quarter * 3 - 2, 1) END AS first,
            CASE WHEN Year % 2 = 0 THEN CAST(make_date(Year, Quarter * 3 - 2, 1) + INTERVAL 100 DAY AS DATE)
                 ELSE CAST(make_date(Year, Quarter * 3 - 2, 1) + INTERVAL 80 DAY AS DATE) END AS last, Year || '-Q' || Quarter AS label
        FROM (SELECT DISTINCT Year, Quarter FROM cal)""",
    # dimensions
    "dd": f"""SELECT DISTINCT CAST(strftime(Week_Date, '%Y%m%d') AS INTEGER) AS Date_Key, Week_Date, Year, Quarter,
            Month, Month_Name, Week_of_Year, Season, {flag("Is_Holiday")} AS Is_Holiday,
            {flag("Is_Tourism_Peak")} AS Is_Tourism_Peak FROM att""",
    "dc": """SELECT CAST(row_number() OVER (ORDER BY Carrier_Name) AS INTEGER) AS Carrier_Key, Carrier_Name,
            Carrier_Full_Name FROM (SELECT DISTINCT Carrier_Name, Carrier_Full_Name FROM att)""",
    "dw": f"""SELECT CAST(row_number() OVER (ORDER BY Avg_Temp_F, Precipitation_Inches, Snow_Inches,
            Weather_Condition, Is_Severe_Weather) AS INTEGER) AS Weather_Key, * FROM (
              SELECT DISTINCT Avg_Temp_F, Precipitation_Inches, Snow_Inches,
                     coalesce(Weather_Condition, 'Unknown') AS Weather_Condition,
                     {flag("Is_Severe_Weather")} AS Is_Severe_Weather FROM att)""",
    "ds_": f"""SELECT CAST(row_number() OVER (ORDER BY Days_Since_Pandemic_Start, COVID_Period) AS INTEGER)
            AS COVID_Key, * FROM (
              SELECT DISTINCT COVID_Period, Economic_Period, {flag("Is_COVID_Period")} AS Is_COVID_Period,
                     {flag("Is_High_Inflation")} AS Is_High_Inflation, Days_Since_Pandemic_Start
              FROM att WHERE COVID_Period IS NOT NULL)""",
    "de": f"""SELECT CAST(row_number() OVER (ORDER BY NYC_Event, Is_Holiday, Is_Tourism_Peak) AS INTEGER)
            AS Event_Key, * FROM (
              SELECT DISTINCT {flag("Is_Holiday")} AS Is_Holiday, coalesce(NYC_Event, 'None') AS NYC_Event,
                     {flag("Is_Tourism_Peak")} AS Is_Tourism_Peak FROM att)""",
    "dt": """SELECT CAST(row_number() OVER (ORDER BY Service_Type) AS INTEGER) AS Service_Type_Key, Service_Type,
            Service_Type || ' transportation service' AS Service_Description
        FROM (SELECT DISTINCT Service_Type FROM att)""",
    "fact": f"""SELECT row_number() OVER (ORDER BY d.Date_Key, c.Carrier_Key) AS Fact_Key,
            d.Date_Key, c.Carrier_Key, w.Weather_Key, s.COVID_Key, e.Event_Key, t.Service_Type_Key,
            f.Bus_Departures, f.Passenger_Departures, f.Passengers_Per_Bus,
            f.Baseline_2019_Buses, f.Baseline_2019_Passengers, f.Bus_Recovery_Percent, f.Passenger_Recovery_Percent,
            f.Bus_WoW_Change, f.Passenger_WoW_Change, f.Bus_4wk_MA, f.Passenger_4wk_MA, f.Bus_12wk_MA,
            f.Passenger_12wk_MA
        FROM stg f JOIN dd d ON d.Week_Date = f.Week_Date JOIN dc c ON c.Carrier_Name = f.Carrier_Name
        LEFT JOIN dw w ON w.Avg_Temp_F = f.Avg_Temp_F AND w.Precipitation_Inches = f.Precipitation_Inches
             AND w.Snow_Inches = f.Snow_Inches AND w.Weather_Condition = coalesce(f.Weather_Condition, 'Unknown')
             AND w.Is_Severe_Weather = {flag("f.Is_Severe_Weather")}
        LEFT JOIN ds_ s ON s.COVID_Period = f.COVID_Period
             AND s.Days_Since_Pandemic_Start = f.Days_Since_Pandemic_Start
        LEFT JOIN de e ON e.Is_Holiday = {flag("f.Is_Holiday")} AND e.Is_Tourism_Peak = {flag("f.Is_Tourism_Peak")}
             AND e.NYC_Event = coalesce(f.NYC_Event, 'None')
        LEFT JOIN dt t ON t.Service_Type = f.Service_Type""",
    "star": """SELECT d.Date_Key, d.Year, d.Month, d.Quarter, c.Carrier_Name, s.COVID_Period,
            f.Passenger_Departures, f.Bus_Departures, f.Passengers_Per_Bus
        FROM fact f JOIN dd d ON f.Date_Key = d.Date_Key JOIN dc c ON f.Carrier_Key = c.Carrier_Key
             JOIN ds_ s ON f.COVID_Key = s.COVID_Key""",
    "perf": f"SELECT Carrier_Name, {SUMMARY} FROM star GROUP BY Carrier_Name",
    # rendered inputs
    "grown": """SELECT Week_Date, Carrier_Name, Service_Type, Bus_Departures, Passenger_Departures FROM cal
        UNION ALL SELECT Week_Date, 'Total', 'Aggregate', CAST(sum(Bus_Departures) AS BIGINT),
            CAST(sum(Passenger_Departures) AS BIGINT) FROM cal GROUP BY Week_Date""",
    "lab": """SELECT *, strftime(monday, '%b ') || day(monday) || '-' ||
            CASE WHEN month(monday) <> month(Week_Date) THEN strftime(Week_Date, '%b ') ELSE '' END
            || day(Week_Date) AS Week_Label, CAST(year(monday) AS INTEGER) AS Label_Year
        FROM (SELECT *, CAST(Week_Date - 4 AS DATE) AS monday FROM cal)""",
    "con": """SELECT Carrier_Name, Carrier_Full_Name, Service_Type, Week_Label, Week_Date, Year, Month, Month_Name,
            Week_of_Year, Quarter, Season,
            CAST(CASE WHEN Month >= 7 THEN Year ELSE Year - 1 END AS INTEGER) AS Fiscal_Year,
            dayname(Week_Date) AS Day_of_Week, CAST(Bus_Departures AS DOUBLE) AS Bus_Departures,
            CAST(Passenger_Departures AS DOUBLE) AS Passenger_Departures,
            round(CASE WHEN Bus_Departures > 0 THEN CAST(Passenger_Departures AS DOUBLE) / Bus_Departures END, 6)
                AS Passengers_Per_Bus,
            CAST(NULL AS DOUBLE) AS Baseline_2019_Buses, CAST(NULL AS DOUBLE) AS Baseline_2019_Passengers,
            CAST(NULL AS DOUBLE) AS Bus_Recovery_Percent, CAST(NULL AS DOUBLE) AS Passenger_Recovery_Percent,
            CAST(50 AS DOUBLE) AS Avg_Temp_F, CAST(0.1 AS DOUBLE) AS Precipitation_Inches,
            CAST(0 AS DOUBLE) AS Snow_Inches, 'Normal' AS Weather_Condition,
            CAST(NULL AS VARCHAR) AS Major_Weather_Event,
            CASE WHEN Year = 2020 THEN 'Lockdown' WHEN Year IN (2021, 2022, 2023) THEN 'Recovery'
                 ELSE 'Normal' END AS Status,
            false AS Is_Holiday, Month IN (7, 8) AS Is_Summer_Peak, Month = 12 AS Is_Holiday_Season,
            false AS Is_Severe_Weather, Month IN (12, 1, 2, 3) AS Is_Snow_Week, Month IN (7, 8) AS Is_Hot_Week,
            Month IN (12, 1, 2) AS Is_Cold_Week, CAST(NULL AS VARCHAR) AS Notes
        FROM lab""",
    # forecasts
    "tot": """SELECT Week_Date, CAST(sum(Passenger_Departures) AS BIGINT) AS Passenger_Departures,
            CAST(sum(Bus_Departures) AS BIGINT) AS Bus_Departures FROM cal GROUP BY Week_Date""",
    "totc": """SELECT Carrier_Name AS Carrier, Week_Date, CAST(sum(Passenger_Departures) AS BIGINT)
            AS Passenger_Departures FROM cal GROUP BY 1, 2""",
    "future": """SELECT CAST(last + CAST(7 - dayofweek(last) + 7 * i AS INTEGER) AS DATE) AS ds
        FROM (SELECT max(Week_Date) AS last FROM cal), generate_series(0, 311) AS g(i)""",
    **_forecast("fo", "tot", None),
    **_forecast("fc", "totc", "Carrier"),
    "tota": "SELECT 'all' AS Carrier, Week_Date, Passenger_Departures FROM tot",
    **_additive("ao", "tota", "Carrier"),
    **_additive("ac", "totc", "Carrier"),
    "ann": f"""SELECT Year, {sum4("yhat")} AS Projected_Passengers,
            {sum4("yhat_lower")} AS Lower_Bound, {sum4("yhat_upper")} AS Upper_Bound,
            round({sum4("yhat")} - sqrt(sum(pow(yhat - yhat_lower, 2))), {DIGITS}) AS Lower_Bound_RSS,
            round({sum4("yhat")} + sqrt(sum(pow(yhat_upper - yhat, 2))), {DIGITS}) AS Upper_Bound_RSS,
            min(ds) <= make_date(Year, 1, 7) AND max(ds) >= make_date(Year, 12, 25) AS Is_Full_Year
        FROM fo GROUP BY Year""",
    "annc": f"""SELECT Carrier, Year, {sum4("yhat")} AS Projected_Passengers,
            min(ds) <= make_date(Year, 1, 7) AND max(ds) >= make_date(Year, 12, 25) AS Is_Full_Year
        FROM fc GROUP BY Carrier, Year""",
    "bw": f"""SELECT Week AS Week_of_Year, {mean4("yhat")} AS Avg_Passengers FROM fo WHERE Year IN (SELECT Year FROM ann WHERE Is_Full_Year) GROUP BY Week""",
    "bm": f"""SELECT Month, {mean4("yhat")} AS Avg_Passengers,
            monthname(make_date(2000, Month, 1)) AS Month_Name FROM fo WHERE Year IN (SELECT Year FROM ann WHERE Is_Full_Year) GROUP BY Month""",
    "feat": f"""SELECT Carrier_Name, Week_Date, Year AS Year_Num, Quarter, Month AS Month_Num, Week_of_Year AS Week_Num,
            Avg_Temp_F, Precipitation_Inches, {flag("Is_Severe_Weather")} AS Is_Severe_Weather,
            {flag("Is_Holiday")} AS Is_Holiday, {flag("Is_Tourism_Peak")} AS Is_Tourism_Peak,
            Days_Since_Pandemic_Start, {flag("Is_COVID_Period")} AS Is_COVID_Period,
            {flag("Is_High_Inflation")} AS Is_High_Inflation,
            CASE WHEN Season = 'Summer' THEN 1 ELSE 0 END AS Is_Summer,
            CASE WHEN Season = 'Winter' THEN 1 ELSE 0 END AS Is_Winter,
            Baseline_2019_Passengers, Passenger_Departures
        FROM stg WHERE Baseline_2019_Passengers IS NOT NULL""",
    "qc": """SELECT Carrier_Name, Year, Quarter, CAST(sum(Passenger_Departures) AS BIGINT) AS Passengers
        FROM cal GROUP BY 1, 2, 3""",
    "qa": """SELECT Year, Quarter, CAST(sum(Passenger_Departures) AS BIGINT) AS Passengers
        FROM cal GROUP BY 1, 2""",
}
CTES |= _forest()


def with_ctes(body: str) -> str:
    """The body behind the expressions it mentions, directly or through others."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b", sql):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    once = lambda name: "MATERIALIZED " if name.startswith("fr_") else ""
    heads = ",\n".join(f"{name} AS {once(name)}({CTES[name]})" for name in needed)
    return f"WITH {heads}\n{body}" if heads else body
