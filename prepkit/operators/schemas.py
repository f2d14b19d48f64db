"""The six declared tables and the operator that brings a frame into a declared shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions.values import plain_number
from prepkit.operators.columns import column

# ---- fixed values: declared tables, names and types in their declared order ----------------------
DECLARED = {
    "SCHOOL_ACCOUNTABILITY": """
        Year int, System string, School string, Indicator string, Grade string, Gender string, Race string,
        Ethnicity string, Sub_Population string, Score double""",
    "SCHOOL_EDUNOMICS": """
        state string, year int, distid_stateassigned string, schoolid_stateassigned string, distname string,
        schoolname string, ncesdistid_admin string, ncesdistid_geo string, census_id string, ncesid string,
        ncesenroll int, gradespan string, level int, enroll_raw_AL string, pp_stloc_raw_AL double,
        pp_fed_raw_AL double, pp_total_raw_AL double, schoolstloc_raw_AL double, schoolfed_raw_AL double,
        schooltot_raw_AL double, pp_total_norm_NERDS double, flag_NERDS int, flag_f33 int, nces_locale string,
        nces_charter string, nces_magnet string, nces_title1 string, nces_title1_schoolwide string,
        nces_freelunch int, nces_reducedlunch int, nces_poverty double, nces_address string, nces_city string,
        nces_zip string, pp_site_stloc_raw_AL double, pp_site_fed_raw_AL double, pp_site_raw_AL double,
        pp_centshare_stloc_raw_AL double, pp_centshare_fed_raw_AL double, pp_centshare_raw_AL double""",
    "STUDENT_DEMOGRAPHICS": """
        Year int, System string, School string, Grade string, Gender string, Ethnicity string,
        Sub_Population string, Total_Student_Count int, Asian int, Asian_Pct double,
        Black_or_African_American int, Black_or_African_American_Pct double,
        American_Indian_Alaska_Native int, American_Indian_Alaska_Native_Pct double,
        Native_Hawaiian_Pacific_Islander int, Native_Hawaiian_Pacific_Islander_Pct double,
        White int, White_Pct double, Two_or_more_races int, Two_or_more_races_Pct double""",
    "TEACHER_DEMOGRAPHICS": """
        Year int, System string, School string, Gender string, Race string, Ethnicity string,
        Sub_Population string, Demographic_Count double, Total_Count double, Demographic_Rate double""",
    "TEACHER_EFFECTIVENESS": """
        Year int, System_Code int, System string, School_Code int, School string,
        Educator_Effectiveness_Score double, ATOT_Completion_Rate_Designation string, Title_I_Status string""",
    "TEACHER_EXPERIENCE": """
        Year int, System string, School string, Gender string, Race string, Ethnicity string,
        Sub_Population string, Total_Count double, Experienced_Count double, Experienced_Rate double,
        Inexperienced_Count double, Inexperienced_Rate double""",
}
# ---- end of fixed values -------------------------------------------------------------------------


def declared(table: str) -> T.StructType:
    """Schema of a declared table."""
    return T.DataType.fromDDL(DECLARED[table])


def _cast(value: Column, source: T.DataType, target: T.DataType) -> Column:
    whole = isinstance(target, T.IntegralType)
    if whole and isinstance(source, T.FractionalType):
        # 2.0 is an int, 2.5 is not: no silent cut of the fraction.
        return F.when(value == F.floor(value), value.try_cast(target))
    if whole and isinstance(source, T.StringType):
        number = plain_number(value)
        return F.coalesce(value.try_cast(target), F.when(number == F.floor(number), number.try_cast(target)))
    return value.try_cast(target)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Order, names and types of a schema; a missing column is null, a cell that does not fit is null."""
    sources = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            (
                _cast(column(f.name), sources[f.name], f.dataType)
                if f.name in sources
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in schema.fields
        ]
    )


def conform_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """What ``conform`` does per column: how many cells had a value, and how many lost it.

    One aggregation over the rows; ``state`` is kept, cast, missing or extra.
    """
    sources = {f.name: f.dataType for f in df.schema.fields}
    targets = {f.name: f.dataType for f in schema.fields}
    names = list(targets) + [n for n in sources if n not in targets]
    totals, states = [], {}
    for i, n in enumerate(names):
        if n not in sources:
            states[n] = "missing"
            values, lost = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        else:
            states[n] = "extra" if n not in targets else "kept" if sources[n] == targets[n] else "cast"
            values = F.count(column(n))
            lost = (
                F.count(F.when(_cast(column(n), sources[n], targets[n]).isNull(), column(n)))
                if n in targets
                else F.lit(0).cast("bigint")
            )
        totals.append(
            F.struct(F.lit(n).alias("name"), F.lit(states[n]).alias("state"),
                     values.alias("cells"), lost.alias("cells_lost"))
        )
    return df.agg(F.array(*totals).alias("columns")).select(F.inline("columns"))
