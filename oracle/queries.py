"""DuckDB SQL per query: the same result as the Spark query, written independently."""

from __future__ import annotations

from oracle.ctes import C4, C12, DIGITS, FEATURES, MEAN_RATIO, R4, R12, SUMMARY, TOTALS, W, flag, hu, mean4, sum4, with_ctes

PASS, FAIL, WARNING = "✓ PASS", "✗ FAIL", "⚠ WARNING"
PASS_FAIL = f"CASE WHEN {{}} = 0 THEN '{PASS}' ELSE '{FAIL}' END"
PASS_WARN = f"CASE WHEN {{}} = 0 THEN '{PASS}' ELSE '{WARNING}' END"

UNIQUE = [
    ("dim_date", "dd", "Date_Key"), ("dim_date", "dd", "Week_Date"),
    ("dim_carrier", "dc", "Carrier_Key"), ("dim_carrier", "dc", "Carrier_Name"),
    ("dim_weather", "dw", "Weather_Key"), ("dim_status", "ds_", "COVID_Key"),
    ("dim_event", "de", "Event_Key"), ("dim_service_type", "dt", "Service_Type_Key"),
    ("dim_service_type", "dt", "Service_Type"), ("fact", "fact", "Fact_Key"),
    ("fact", "fact", "Date_Key, Carrier_Key"), ("monthly", "star", "Year, Month, Carrier_Name"),
    ("quarterly", "star", "Year, Quarter"), ("period", "star", "COVID_Period"),
    ("performance", "perf", "Carrier_Name")]

FOREIGN = [("Date_Key", "dim_date", "dd"), ("Carrier_Key", "dim_carrier", "dc"),
           ("Weather_Key", "dim_weather", "dw"), ("COVID_Key", "dim_status", "ds_"),
           ("Event_Key", "dim_event", "de"), ("Service_Type_Key", "dim_service_type", "dt")]

TABLES = [("source", "stg", "Source"), ("dim_date", "dd", "Dimension"), ("dim_carrier", "dc", "Dimension"),
          ("dim_weather", "dw", "Dimension"), ("dim_status", "ds_", "Dimension"), ("dim_event", "de", "Dimension"),
          ("dim_service_type", "dt", "Dimension"), ("fact", "fact", "Fact"),
          ("monthly", "(SELECT DISTINCT Year, Month, Carrier_Name FROM star)", "Summary"),
          ("quarterly", "(SELECT DISTINCT Year, Quarter FROM star)", "Summary"),
          ("period", "(SELECT DISTINCT COVID_Period FROM star)", "Summary"), ("performance", "perf", "Summary")]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _unique(name: str, table: str, keys: str) -> str:
    grouped = table in ("star",)
    inner = f"SELECT DISTINCT {keys} FROM star" if grouped else f"SELECT {keys} FROM {table}"
    return (f"SELECT '{name} ({keys})' AS Check_Type, count(*) AS Issue_Count, {PASS_FAIL.format('count(*)')} AS Status "
            f"FROM (SELECT {keys} FROM ({inner}) GROUP BY {keys} HAVING count(*) > 1)")


TWICE = {
    "dim_date": "Date_Key % 3 = 1", "dim_carrier": "Carrier_Key % 3 = 1", "dim_weather": "Weather_Key % 3 = 1",
    "dim_status": "COVID_Key % 3 = 1", "dim_event": "Event_Key % 3 = 1", "dim_service_type": "Service_Type_Key % 3 = 1",
    "fact": "Fact_Key % 97 = 1", "monthly": "Month = 2", "quarterly": "Quarter = 3", "period": "COVID_Period = 'Post'",
    "performance": "Carrier_Name LIKE '%1'"}


def _unique_twice(name: str, table: str, keys: str) -> str:
    base = f"(SELECT DISTINCT {keys} FROM star)" if table == "star" else table
    return _unique(name, f"(SELECT * FROM {base} UNION ALL SELECT * FROM {base} WHERE {TWICE[name]})", keys)


def _foreign(key: str, name: str, table: str) -> str:
    return (f"SELECT '{key} in {name}' AS Check_Type, count(*) AS Issue_Count, {PASS_FAIL.format('count(*)')} AS Status "
            f"FROM fact f WHERE f.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {table} k WHERE k.{key} = f.{key})")


def _averages(weeks: int, by_rows: str, by_calendar: str) -> str:
    columns = []
    for short, name in (("Bus", "Bus_Departures"), ("Passenger", "Passenger_Departures")):
        columns.append(f"{hu(f'sum({name}) {by_rows}', f'count({name}) {by_rows}')} AS {short}_{weeks}wk_Row_MA")
        columns.append(f"{hu(f'sum({name}) {by_calendar}', f'count({name}) {by_calendar}')} AS {short}_{weeks}wk_MA")
    return f"SELECT Carrier_Name, Week_Date, {', '.join(columns)} FROM cal"


def _wow(short: str, name: str) -> str:
    change, before = f"({name} - lag({name}) {W})", f"lag({name}) {W}"
    return (f"CAST({change} AS DOUBLE) AS {short}_WoW_Change, {hu(f'100 * {change}', before)} AS {short}_WoW_Percent")


def _statistics(label: str, column: str) -> str:
    return f"""SELECT '{label}' AS Metric, CAST(sum({column}) AS BIGINT) AS Total,
        {hu(f"sum({column})", f"count({column})")} AS Average, CAST(sum({column}) // count({column}) AS BIGINT) AS Average_Int,
        min({column}) AS Minimum, max({column}) AS Maximum FROM fact"""


def _preview(name: str, table: str, key: str, text: str) -> str:
    return (f"SELECT * FROM (SELECT '{name}' AS Table_Name, CAST({key} AS BIGINT) AS Row_Key, {text} AS Row_Text "
            f"FROM {table} ORDER BY {key} LIMIT 5)")


_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in _MONTHS) + "]"


def _label_parse() -> str:
    """Label text back to dates, by list position of the month abbreviation."""
    return f"""SELECT Friday, Week_Label, Label_Year, make_date(Label_Year, m_end, d_end) AS Literal_Date,
        make_date(Label_Year + CASE WHEN m_end < m_start THEN 1 ELSE 0 END, m_end, d_end) AS Week_Date,
        false AS Week_Date_Defaulted
      FROM (SELECT Friday, Week_Label, Label_Year, list_position({_MONTH_LIST}, Week_Label[1:3])::INTEGER AS m_start,
              CASE WHEN regexp_matches(tail, '[A-Z]') THEN list_position({_MONTH_LIST}, tail[1:3])
                   ELSE list_position({_MONTH_LIST}, Week_Label[1:3]) END::INTEGER AS m_end,
              CAST(regexp_extract(tail, '[0-9]+') AS INTEGER) AS d_end
            FROM (SELECT DISTINCT Week_Date AS Friday, Week_Label, Label_Year,
                         string_split(Week_Label, '-')[2] AS tail FROM lab))"""


_BODIES: dict[str, str] = {
    # sources and sinks
    "weekly_source": "SELECT * FROM wk",
    "sheet_extract": """SELECT Carrier_Name, Carrier_Full_Name, Service_Type, Week_Label, Week_Date, Bus_Departures,
        Passenger_Departures, Passengers_Per_Bus FROM con""",
    "sheet_rejects": """SELECT DISTINCT Week_Label AS sheet, Label_Year AS year, CASE kind WHEN 0 THEN 'no header'
            WHEN 1 THEN 'no carrier column' ELSE 'no measure column' END AS reason,
            CAST(CASE WHEN kind > 0 THEN 2 END AS INTEGER) AS header_row
        FROM (SELECT *, (date_diff('day', DATE '1970-01-01', Week_Date) // 7) % 9 AS kind FROM lab) WHERE kind <= 2""",
    "label_quality": """SELECT CASE WHEN kind = 3 THEN replace(Week_Label, '-', ' to ') ELSE Week_Label END AS Week_Label, Label_Year,
            CASE WHEN kind = 3 THEN make_date(Label_Year, 1, 1) ELSE Week_Date END AS Week_Date, kind = 3 AS Week_Date_Defaulted,
            count(*) AS Rows, CASE WHEN kind = 4 THEN 1 ELSE 0 END::BIGINT AS Rows_Without_Number
        FROM (SELECT *, (date_diff('day', DATE '1970-01-01', Week_Date) // 7) % 9 AS kind FROM lab) WHERE kind > 2
        GROUP BY Week_Label, Label_Year, Week_Date, kind""",
    "dim_conflicts": """SELECT 'dim_carrier' AS dimension, Carrier_Name AS member, 'Carrier_Full_Name' AS attribute, count(DISTINCT Full_Name) AS n_values
        FROM bad GROUP BY Carrier_Name HAVING count(DISTINCT Full_Name) > 1
        UNION ALL SELECT 'dim_date', CAST(Week_Date AS VARCHAR), 'Is_Holiday', count(DISTINCT Is_Holiday)
        FROM bad GROUP BY Week_Date HAVING count(DISTINCT Is_Holiday) > 1""",
    "consolidate_union": """SELECT Carrier_Name, Week_Date, Bus_Departures, Passenger_Departures, 'departures' AS Feed FROM cal
      UNION ALL SELECT o_orderpriority, CAST(date_trunc('week', o_orderdate) + INTERVAL 4 DAY AS DATE), count(*),
             CAST(NULL AS BIGINT), 'orders' FROM orders GROUP BY 1, 2
      UNION ALL SELECT event_type, CAST(date_trunc('week', ts) + INTERVAL 4 DAY AS DATE), CAST(NULL AS BIGINT),
             count(*), 'events' FROM events GROUP BY 1, 2""",
    "source_load": "SELECT Carrier_Name, Week_Date, Year, Bus_Departures, Passenger_Departures, Season, Is_Summer_Peak FROM con",
    "sink_csv_roundtrip": "SELECT * FROM tot",
    "table_reload": "SELECT * FROM tot",
    "sink_table_roundtrip": f"SELECT Month, Carrier_Name, {TOTALS}, {MEAN_RATIO} AS Avg_Passengers_Per_Bus, Year FROM star GROUP BY Year, Month, Carrier_Name",
    "stage_source": "SELECT * FROM stg",
    # projections and filters
    "project_consolidated": "SELECT * FROM con",
    "filter_members": "SELECT Week_Date, Carrier_Name, Service_Type, Bus_Departures, Passenger_Departures FROM cal",
    "filter_not_null": """SELECT Carrier_Name, Week_Date, COVID_Period, Weather_Condition, Passenger_Departures FROM att
        WHERE COVID_Period IS NOT NULL AND Weather_Condition IS NOT NULL""",
    "feature_rows_complete": "SELECT * FROM feat",
    "latest_year_rows": """SELECT Carrier_Name, Week_Date, Year, Passenger_Departures FROM cal
        WHERE Year = (SELECT max(Year) FROM cal)""",
    "check_integrity": _union([
        f"SELECT '{label}' AS Check_Type, count(*) AS Issue_Count, {status.format('count(*)')} AS Status FROM fact WHERE {where}"
        for label, status, where in (
            ("NULL Foreign Keys", PASS_FAIL, "Date_Key IS NULL OR Carrier_Key IS NULL"),
            ("Negative Passenger Counts", PASS_WARN, "Passenger_Departures < 0"),
            ("Negative Bus Counts", PASS_WARN, "Bus_Departures < 0"))]),
    "filter_like": """SELECT Carrier_Name, Week_Date, Bus_Departures FROM cal
        WHERE Carrier_Name LIKE 'NATION_1%' OR Carrier_Name LIKE '%_7'""",
    "flag_encode": "SELECT Carrier_Name, Week_Date, " + ", ".join(
        f"{flag(c)} AS {c}" for c in ("Is_Holiday", "Is_Tourism_Peak", "Is_Severe_Weather", "Is_COVID_Period",
                                      "Is_High_Inflation")) + " FROM att",
    # scalar functions
    "week_label_parse": _label_parse(),
    "date_parts": """SELECT DISTINCT Week_Date, Year, Quarter, Month, Month_Name, Week_of_Year, Season,
        Fiscal_Year, Day_of_Week FROM con""",
    "season_label": """SELECT Season, count(*) AS Row_Count, CAST(sum(Passenger_Departures) AS BIGINT) AS Total_Passengers
        FROM cal GROUP BY Season""",
    "fiscal_year": """SELECT CAST(CASE WHEN Month >= 7 THEN Year ELSE Year - 1 END AS INTEGER) AS Fiscal_Year,
        count(DISTINCT Week_Date) AS Weeks, CAST(sum(Passenger_Departures) AS BIGINT) AS Total_Passengers
        FROM cal GROUP BY 1""",
    "status_label": """SELECT Carrier_Name, Week_Date, Year, CASE WHEN Year = 1995 THEN 'Lockdown'
        WHEN Year BETWEEN 1996 AND 1998 THEN 'Recovery' ELSE 'Normal' END AS Status FROM cal""",
    "calendar_flags": """SELECT DISTINCT Week_Date, Month, Is_Summer_Peak, Is_Holiday_Season, Is_Snow_Week, Is_Hot_Week,
        Is_Cold_Week FROM con""",
    "date_key": """SELECT DISTINCT Week_Date, CAST(strftime(Week_Date, '%Y%m%d') AS INTEGER) AS Date_Key,
        CAST(Year * 10000 + Month * 100 + day(Week_Date) AS INTEGER) AS Date_Key_From_Parts FROM cal""",
    "safe_date_cast": """SELECT DISTINCT Week_Date, Week_Date AS From_Us_Text, Week_Date AS From_Iso_Text,
        TRY_CAST(Week_Label AS DATE) AS From_Label FROM lab""",
    "check_date_range": """SELECT 'Date Range' AS Check_Type, min(Week_Date) AS Earliest_Date, max(Week_Date) AS Latest_Date,
        CAST(date_diff('day', min(Week_Date), max(Week_Date)) AS INTEGER) AS Days_Covered
        FROM fact f JOIN dd d ON f.Date_Key = d.Date_Key""",
    "days_since": """SELECT DISTINCT Week_Date, CAST(Week_Date - DATE '1997-01-01' AS INTEGER) AS Days_Since FROM cal""",
    "passengers_per_bus": f"""SELECT Carrier_Name, Week_Date, {hu("Passenger_Departures", "Bus_Departures")} AS Rounded,
        round(CAST(Passenger_Departures AS DOUBLE) / nullif(Bus_Departures, 0), 6) AS Ratio FROM cal""",
    "recovery_percent": "SELECT Carrier_Name, Week_Date, Bus_Recovery_Percent, Passenger_Recovery_Percent FROM stg",
    "period_classify": "SELECT DISTINCT Week_Date, COVID_Period AS Period, Economic_Period FROM att",
    "period_table_classify": """SELECT Carrier_Name, Week_Date, label AS Period FROM cal
        LEFT JOIN span ON coalesce(first <= Week_Date, true) AND Week_Date <= last
        QUALIFY row_number() OVER (PARTITION BY Carrier_Name, Week_Date ORDER BY first DESC NULLS LAST, label DESC) = 1""",
    "period_overlaps": """SELECT a.first, a.last, a.label, count(*) - 1 AS others FROM span a
        JOIN span b ON coalesce(b.first <= a.first, true) AND a.first <= b.last GROUP BY ALL HAVING count(*) > 1""",
    "numeric_coerce": """SELECT CAST(c AS INTEGER) AS col_idx, count(*) AS Cells, count(TRY_CAST(v AS DOUBLE)) AS Numbers,
        CAST(sum(TRY_CAST(v AS DOUBLE)) AS BIGINT) AS Total FROM (
          SELECT 0 AS c, Carrier_Name AS v FROM cal UNION ALL SELECT 1, CAST(Bus_Departures AS VARCHAR) FROM cal
          UNION ALL SELECT 2, CAST(Passenger_Departures AS VARCHAR) FROM cal
          UNION ALL SELECT unnest([0, 0, 1, 2]), 'heading' FROM (SELECT DISTINCT Week_Date FROM cal)) GROUP BY c""",
    "lookup_enrich": """SELECT Week_Date, Carrier_Name, Passenger_Departures,
        CASE WHEN Carrier_Name <> 'Total' THEN Service_Type END AS Service_Type,
        CASE WHEN Carrier_Name <> 'Total' THEN Carrier_Name || ' Lines' END AS Carrier_Full_Name FROM grown""",
    "event_default": "SELECT coalesce(NYC_Event, 'None') AS NYC_Event, count(*) AS Row_Count FROM att GROUP BY 1",
    "service_description": """SELECT DISTINCT Service_Type, Service_Type || ' transportation service' AS Description,
        Service_Type || ' service' AS Short_Description,
        nullif(Service_Type, 'ASIA') || ' transportation service' AS Null_Description FROM cal""",
    "latest_records": f"""SELECT d.Week_Date, d.Year, c.Carrier_Name, f.Bus_Departures, f.Passenger_Departures,
        f.Passengers_Per_Bus, {hu("CAST(round(f.Passenger_Recovery_Percent * 100) AS HUGEINT)", "100", 1)} AS Recovery_Pct
        FROM fact f JOIN dd d ON f.Date_Key = d.Date_Key JOIN dc c ON f.Carrier_Key = c.Carrier_Key
        ORDER BY d.Week_Date DESC, c.Carrier_Name LIMIT 5""",
    "baseline_comparison": f"""SELECT Year, Projected_Passengers, Lower_Bound, Upper_Bound, Is_Full_Year,
        CAST(b AS DOUBLE) AS Baseline_2019, round(Projected_Passengers - b, {DIGITS}) AS Difference,
        round((Projected_Passengers - b) * 100 / nullif(b, 0), {DIGITS}) AS Percent_Change
        FROM ann, (SELECT CAST(sum(Passenger_Departures) AS DOUBLE) AS b FROM cal WHERE Year = 1995)""",
    # dimensions, fact, star
    "dim_date": "SELECT * FROM dd",
    "dim_carrier": "SELECT * FROM dc",
    "dim_weather": "SELECT * FROM dw",
    "dim_status": "SELECT * FROM ds_",
    "dim_event": "SELECT * FROM de",
    "dim_service_type": "SELECT * FROM dt",
    "distinct_values": "SELECT DISTINCT Service_Type FROM cal",
    "fact_load": "SELECT * FROM fact",
    "fact_fanout_check": f"""SELECT a AS Source_Rows, b AS Joined_Rows, b - a AS Extra_Rows,
        CASE WHEN a = b THEN '{PASS}' ELSE '{WARNING}' END AS Status
        FROM (SELECT (SELECT count(*) FROM att) AS a, (SELECT count(*) FROM att f LEFT JOIN dw w
              ON w.Avg_Temp_F = f.Avg_Temp_F AND w.Precipitation_Inches = f.Precipitation_Inches
              AND w.Weather_Condition = coalesce(f.Weather_Condition, 'Unknown')) AS b)""",
    "star_read": "SELECT * FROM star",
    "baseline_attach": """SELECT Carrier_Name, Week_Date, Week_of_Year, Baseline_2019_Buses, Baseline_2019_Passengers
        FROM stg""",
    # summaries
    "monthly_carrier_summary": f"SELECT Year, Month, Carrier_Name, {SUMMARY} FROM star GROUP BY Year, Month, Carrier_Name",
    "quarterly_summary": f"""SELECT Year, Quarter, {SUMMARY}, count(DISTINCT Carrier_Name) AS Unique_Carriers
        FROM star GROUP BY Year, Quarter""",
    "quarterly_carriers_by_sketch": """SELECT Year, Quarter, count(DISTINCT Carrier_Name) AS Carriers_Estimate,
        count(DISTINCT Carrier_Name) AS Unique_Carriers FROM star GROUP BY Year, Quarter""",
    "period_impact_summary": f"""SELECT COVID_Period, CAST(sum(Passenger_Departures) AS BIGINT) AS Total_Passengers,
        {hu("sum(Passenger_Departures)", "count(Passenger_Departures)")} AS Avg_Weekly_Passengers,
        count(Passenger_Departures) AS Total_Weeks, count(DISTINCT Date_Key) AS Distinct_Weeks,
        {hu("sum(Passenger_Departures)", "count(DISTINCT Date_Key)")} AS Avg_Passengers_Per_Week
        FROM star GROUP BY COVID_Period""",
    "carrier_performance": "SELECT * FROM perf",
    "carrier_performance_ranked": """SELECT *, CAST(row_number() OVER (ORDER BY Avg_Passengers_Per_Bus DESC, Carrier_Name)
        AS INTEGER) AS Performance_Rank FROM perf""",
    "top_performers": """SELECT CAST(row_number() OVER (ORDER BY Avg_Passengers_Per_Bus DESC, Carrier_Name) AS INTEGER)
        AS Performance_Rank, Carrier_Name, Total_Passengers, Avg_Passengers_Per_Bus FROM perf
        ORDER BY Performance_Rank LIMIT 5""",
    "summary_grouping_sets": f"""SELECT Year, Month, Quarter, COVID_Period, Carrier_Name, {TOTALS},
        {MEAN_RATIO} AS Avg_Passengers_Per_Bus,
        {hu("sum(Passenger_Departures)", "count(Passenger_Departures)")} AS Avg_Weekly_Passengers,
        count(Passenger_Departures) AS Total_Weeks, count(DISTINCT c) AS Unique_Carriers,
        CASE WHEN grouping(Month) = 0 THEN 'monthly' WHEN grouping(Quarter) = 0 THEN 'quarterly'
             WHEN grouping(COVID_Period) = 0 THEN 'period' ELSE 'carrier' END AS Summary
        FROM (SELECT *, Carrier_Name AS c FROM star)
        GROUP BY GROUPING SETS ((Year, Month, Carrier_Name), (Year, Quarter), (COVID_Period), (Carrier_Name))""",
    "summary_statistics": _union([_statistics("Passenger Departures", "Passenger_Departures"),
                                  _statistics("Bus Departures", "Bus_Departures")]),
    "weekly_totals": "SELECT * FROM tot",
    "weekly_totals_by_carrier": "SELECT * FROM totc",
    "recovery_status": f"""SELECT ly AS Latest_Year, bt AS Baseline_Total, {hu("bt", "bn")} AS Baseline_Weekly_Avg,
        {hu("bt", "bw")} AS Baseline_True_Weekly_Avg, lt AS Latest_Total, {hu("lt", "ln")} AS Latest_Weekly_Avg,
        {hu("lt", "lw")} AS Latest_True_Weekly_Avg, bc AS Baseline_Carriers, {hu("100 * lt", "bt")} AS Recovery_Percent,
        {hu("100 * lt", "bs")} AS Recovery_Percent_Same_Weeks
      FROM (SELECT max(ly) AS ly,
          CAST(sum(Passenger_Departures) FILTER (Year = 1995) AS BIGINT) AS bt,
          count(Passenger_Departures) FILTER (Year = 1995) AS bn,
          count(DISTINCT Week_Date) FILTER (Year = 1995) AS bw,
          count(DISTINCT Carrier_Name) FILTER (Year = 1995) AS bc,
          CAST(sum(Passenger_Departures) FILTER (Year = ly) AS BIGINT) AS lt,
          count(Passenger_Departures) FILTER (Year = ly) AS ln,
          count(DISTINCT Week_Date) FILTER (Year = ly) AS lw,
          sum(Passenger_Departures) FILTER (Year = 1995 AND Week_of_Year IN (
             SELECT Week_of_Year FROM cal WHERE Year = (SELECT max(Year) FROM cal))) AS bs
        FROM (SELECT *, (SELECT max(Year) FROM cal) AS ly FROM cal))""",
    "carrier_year_pivot": "SELECT Year, " + ", ".join(
        f"sum(Projected_Passengers) FILTER (Carrier = 'NATION_{i}') AS NATION_{i}" for i in range(25))
        + " FROM annc GROUP BY Year",
    # windows
    "wow_change": f"""SELECT Carrier_Name, Week_Date, {_wow("Bus", "Bus_Departures")},
        {_wow("Passenger", "Passenger_Departures")} FROM cal""",
    "moving_avg_4wk": _averages(4, R4, C4),
    "moving_avg_12wk": _averages(12, R12, C12),
    # sorting and previews
    "sorted_consolidated": """SELECT Carrier_Name, Week_Date, Bus_Departures, Passenger_Departures FROM con
        ORDER BY Week_Date, Carrier_Name""",
    "table_preview": _union([
        _preview("dim_date", "dd", "Date_Key", "Month_Name"),
        _preview("dim_carrier", "dc", "Carrier_Key", "Carrier_Name"),
        _preview("dim_weather", "dw", "Weather_Key", "Weather_Condition"),
        _preview("dim_status", "ds_", "COVID_Key", "COVID_Period || '/' || Economic_Period"),
        _preview("dim_event", "de", "Event_Key", "NYC_Event"),
        _preview("dim_service_type", "dt", "Service_Type_Key", "Service_Type")]),
    # quality
    "row_count_summary": _union([
        f"SELECT '{name}' AS Table_Name, count(*) AS Row_Count, '{kind}' AS Table_Type FROM {cte}"
        for name, cte, kind in TABLES]),
    "staging_quality": f"""SELECT count(*) AS Total_Rows, count(*) FILTER (Week_Date IS NULL) AS Null_Dates,
        count(*) FILTER (Carrier_Name IS NULL) AS Null_Carriers,
        CASE WHEN count(*) FILTER (Week_Date IS NULL OR Carrier_Name IS NULL) = 0 THEN '{PASS}'
             ELSE '{WARNING}' END AS Status FROM cal""",
    "check_referential": _union([_foreign(*f) for f in FOREIGN]),
    "check_unique_keys": _union([_unique(*u) for u in UNIQUE]),
    "repeated_key_findings": _union([_unique_twice(*u) for u in UNIQUE]),
    "period_loss_check": f"""SELECT count(*) AS Fact_Rows, count(*) FILTER (COVID_Key IS NULL) AS Lost_Rows,
        coalesce(CAST(sum(Passenger_Departures) FILTER (COVID_Key IS NULL) AS BIGINT), 0) AS Lost_Passengers,
        {PASS_WARN.format("count(*) FILTER (COVID_Key IS NULL)")} AS Status FROM fact""",
    "date_key_conflicts": f"""SELECT count(*) AS Total_Rows, count(*) FILTER (Week_Date IS NULL) AS Null_Keys,
        count(*) FILTER (CAST(strftime(Week_Date, '%Y%m%d') AS INTEGER)
            IS DISTINCT FROM Year * 10000 + Month * 100 + day(Week_Date)) AS Conflicts,
        '{PASS}' AS Status FROM cal""",
    "rollup_reconciliation": f"""SELECT Week_Date, r.p AS Rollup_Passengers, m.p AS Member_Passengers, r.b AS Rollup_Buses,
        m.b AS Member_Buses, CASE WHEN r.p = m.p AND r.b = m.b THEN '{PASS}' ELSE '{FAIL}' END AS Status
        FROM (SELECT Week_Date, Passenger_Departures AS p, Bus_Departures AS b FROM grown WHERE Carrier_Name = 'Total') r
        JOIN (SELECT Week_Date, CAST(sum(Passenger_Departures) AS BIGINT) AS p, CAST(sum(Bus_Departures) AS BIGINT) AS b
              FROM grown WHERE Carrier_Name <> 'Total' GROUP BY Week_Date) m USING (Week_Date)""",
    # forecasts
    "forest_nodes": "SELECT * FROM fr_n",
    "feature_importance": "SELECT Feature, round(coalesce(share / k, 0), 9) AS Importance FROM (" + _union([
        f"SELECT '{c}' AS Feature" for c in FEATURES]) + """) LEFT JOIN (
          SELECT Feature, sum(g / whole) AS share FROM (SELECT Feature, g, sum(g) OVER (PARTITION BY Tree) AS whole FROM (
            SELECT Tree, Feature, sum(Gain) AS g FROM fr_n WHERE Feature IS NOT NULL GROUP BY Tree, Feature)) GROUP BY Feature)
        USING (Feature), (SELECT count(DISTINCT Tree) AS k FROM fr_n WHERE Feature IS NOT NULL)""",
    "forest_fit": """SELECT Carrier_Name, Week_Date, round(avg(Prediction), 4) AS Fitted
        FROM fr_t JOIN fr_n USING (Tree, Node) GROUP BY Carrier_Name, Week_Date""",
    "feature_correlation": _union([
        f"SELECT '{c}' AS Feature, round(covar_pop({c}, Passenger_Departures) / nullif(stddev_pop({c}) "
        f"* stddev_pop(Passenger_Departures), 0), 6) AS Correlation FROM feat" for c in FEATURES]),
    "top_features": "SELECT * FROM (" + _union([
        f"SELECT '{c}' AS Feature, round(covar_pop({c}, Passenger_Departures) / nullif(stddev_pop({c}) "
        f"* stddev_pop(Passenger_Departures), 0), 6) AS Correlation FROM feat" for c in FEATURES])
        + ") ORDER BY abs(Correlation) DESC NULLS LAST, Feature LIMIT 10",
    "future_calendar": """SELECT ds, CAST(year(ds) AS INTEGER) AS Year, CAST(month(ds) AS INTEGER) AS Month,
        CAST(week(ds) AS INTEGER) AS Week FROM future""",
    "forecast_overall": "SELECT * FROM fo",
    "forecast_by_carrier": "SELECT * FROM fc",
    "forecast_overall_additive": "SELECT * EXCLUDE (Carrier) FROM ao",
    "forecast_by_carrier_additive": "SELECT * FROM ac",
    "additive_residuals": "SELECT Carrier, true AS Solved FROM (SELECT DISTINCT Carrier FROM totc)",
    "forecast_annual": "SELECT * FROM ann",
    "busiest_weeks": f"""SELECT Week AS Week_of_Year, {mean4("yhat")} AS Avg_Passengers FROM fo GROUP BY Week""",
    "busiest_months": f"""SELECT Month, {mean4("yhat")} AS Avg_Passengers,
        monthname(make_date(2000, Month, 1)) AS Month_Name FROM fo GROUP BY Month""",
    "top_weeks": "SELECT * FROM bw ORDER BY Avg_Passengers DESC, Week_of_Year LIMIT 10",
    "monthly_series": f"""SELECT CAST(date_trunc('month', Week_Date) AS DATE) AS Month_Start,
        CAST(sum(Passenger_Departures) AS DOUBLE) AS Passengers, 'Historical' AS Series FROM cal GROUP BY 1
      UNION ALL SELECT CAST(date_trunc('month', ds) AS DATE), {sum4("yhat")}, 'Forecast' FROM fo GROUP BY 1""",
    "carrier_forecast_summary": f"""SELECT Carrier, {mean4("Projected_Passengers")} AS Avg_Annual_Passengers
        FROM annc WHERE Is_Full_Year GROUP BY Carrier""",
    "top_carriers": f"""SELECT Carrier, {mean4("Projected_Passengers")} AS Avg_Annual_Passengers
        FROM annc WHERE Is_Full_Year GROUP BY Carrier ORDER BY Avg_Annual_Passengers DESC, Carrier LIMIT 3""",
    "carrier_forecast_annual": "SELECT * FROM annc",
    "forecast_findings": f"""SELECT a AS Avg_Annual_Passengers,
        (SELECT Year FROM ann WHERE Is_Full_Year ORDER BY Projected_Passengers DESC, Year LIMIT 1) AS Peak_Year,
        p AS Peak_Volume,
        (SELECT Week_of_Year FROM bw ORDER BY Avg_Passengers DESC, Week_of_Year LIMIT 1) AS Busiest_Week,
        (SELECT Month_Name FROM bm ORDER BY Avg_Passengers DESC, Month LIMIT 1) AS Busiest_Month,
        b AS Baseline_2019, round((a - b) * 100 / nullif(b, 0), {DIGITS}) AS Change_Percent
        FROM (SELECT {mean4("Projected_Passengers")} AS a, max(Projected_Passengers) AS p FROM ann WHERE Is_Full_Year),
             (SELECT CAST(sum(Passenger_Departures) AS BIGINT) AS b FROM cal WHERE Year = 1995)""",
    # indicators
    "period_decline": f"""SELECT 'Pre' AS Before_Period, 'During' AS After_Period, b AS Before_Weekly_Avg,
        a AS After_Weekly_Avg, {hu("100 * (CAST(round(a * 100) AS HUGEINT) - CAST(round(b * 100) AS HUGEINT))",
                                   "CAST(round(b * 100) AS HUGEINT)")} AS Change_Percent
      FROM (SELECT {hu("sum(Passenger_Departures) FILTER (COVID_Period = 'Pre')",
                       "count(DISTINCT Week_Date) FILTER (COVID_Period = 'Pre')")} AS b,
                   {hu("sum(Passenger_Departures) FILTER (COVID_Period = 'During')",
                       "count(DISTINCT Week_Date) FILTER (COVID_Period = 'During')")} AS a FROM att)""",
    "recovery_quarter": f"""SELECT level AS Baseline_Quarter, Passengers, Year AS Recovery_Year, Quarter AS Recovery_Quarter
        FROM (SELECT {hu("sum(Passengers)", "count(*)")} AS level FROM qa WHERE Year = 1995) l LEFT JOIN qa q
          ON q.Year >= 1997 AND q.Passengers >= l.level ORDER BY Year NULLS LAST, Quarter LIMIT 1""",
    "carrier_recovery_speed": f"""SELECT CAST(row_number() OVER (ORDER BY Recovery_Year NULLS LAST, Recovery_Quarter,
        Carrier_Name) AS INTEGER) AS Speed_Rank, * FROM (
          SELECT Carrier_Name, level AS Baseline_Quarter, Passengers, Year AS Recovery_Year, Quarter AS Recovery_Quarter
          FROM (SELECT l.Carrier_Name, level, Passengers, Year, Quarter, row_number() OVER (
                  PARTITION BY l.Carrier_Name ORDER BY Year, Quarter) AS rn
                FROM (SELECT Carrier_Name, {hu("sum(Passengers) FILTER (Year = 1995)", "count(*) FILTER (Year = 1995)")}
                      AS level FROM qc GROUP BY Carrier_Name) l
                LEFT JOIN qc q ON q.Carrier_Name = l.Carrier_Name AND q.Year >= 1997 AND q.Passengers >= l.level)
          WHERE rn = 1)""",
    "carrier_leaders": """SELECT e.Carrier_Name AS Most_Efficient, e.Avg_Passengers_Per_Bus, t.Carrier_Name AS Largest,
        t.Total_Passengers FROM (SELECT * FROM perf ORDER BY Avg_Passengers_Per_Bus DESC, Carrier_Name LIMIT 1) e,
        (SELECT * FROM perf ORDER BY Total_Passengers DESC, Carrier_Name LIMIT 1) t""",
    "carrier_yoy": f"""SELECT c.Carrier_Name, c.Year, c.Passengers, p.Passengers AS Previous_Passengers,
        {hu("100 * (c.Passengers - p.Passengers)", "p.Passengers")} AS Growth_Percent
      FROM (SELECT Carrier_Name, Year, CAST(sum(Passengers) AS BIGINT) AS Passengers FROM qc GROUP BY 1, 2) c
      LEFT JOIN (SELECT Carrier_Name, Year, CAST(sum(Passengers) AS BIGINT) AS Passengers FROM qc GROUP BY 1, 2) p
        ON p.Carrier_Name = c.Carrier_Name AND p.Year = c.Year - 1""",
    "forecast_cagr": f"""SELECT y0 AS First_Year, y1 AS Last_Year, v0 AS First_Volume, v1 AS Last_Volume,
        round((pow(v1 / v0, 1::DOUBLE / (y1 - y0)) - 1) * 100, {DIGITS}) AS Cagr_Percent
      FROM (SELECT min(Year) AS y0, max(Year) AS y1, arg_min(Projected_Passengers, Year) AS v0,
                   arg_max(Projected_Passengers, Year) AS v1 FROM ann WHERE Is_Full_Year)""",
}

_FOOT = "Total_Passengers, Total_Buses, Avg_Passengers_Per_Bus"
_BODIES |= {
    "preview_dim_date": f"SELECT * FROM ({_BODIES['dim_date']}) ORDER BY Week_Date DESC LIMIT 5",
    "preview_fact": f"SELECT * FROM ({_BODIES['fact_load']}) ORDER BY Date_Key DESC, Carrier_Key LIMIT 5",
    "preview_monthly": f"SELECT Year, Month, Carrier_Name, {_FOOT} FROM ({_BODIES['monthly_carrier_summary']}) "
                       "ORDER BY Year DESC, Month DESC, Carrier_Name LIMIT 5",
    "preview_quarterly": f"SELECT Year, Quarter, {_FOOT}, Unique_Carriers FROM ({_BODIES['quarterly_summary']}) "
                         "ORDER BY Year DESC, Quarter DESC LIMIT 5",
    "preview_period": "SELECT COVID_Period, Total_Passengers, Avg_Weekly_Passengers, Total_Weeks "
                      f"FROM ({_BODIES['period_impact_summary']}) ORDER BY COVID_Period NULLS FIRST LIMIT 5",
    "preview_performance": f"SELECT Carrier_Name, {_FOOT} FROM perf ORDER BY Carrier_Name LIMIT 5",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(body) for name, body in _BODIES.items()}
