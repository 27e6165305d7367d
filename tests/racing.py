"""A small entry table with the racing column names."""

import random

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from groupstats.functions import fixed

CODES = [
    "ri_Discipline", "ri_RaceGrade", "ri_InOut", "ri_LeftrRight", "ri_CourseCode", "hi_RunningStyle",
    "hi_HoofCode", "hi_ConditionClass", "hi_SexCode",
    "pre1_RaceGrade", "pre1_InOut", "pre1_LeftRight",
    *[f"pre{i}_{c}" for i in (1, 2, 3) for c in ("Discipline", "FieldStatus", "CourseCode")],
]
IDS = ["entry", "hi_RaceID", "ri_Datetime", "li_RaceID", "ei_RaceID"] + [
    f"pre{i}_{c}" for i in (1, 2, 3) for c in ("RaceID", "RegisterdDate")
]
SLOT_NUMBERS = [
    "FinishingTime", "Distance", "OrderOfFinish", "HeadCount", "Weight", "Pass1", "Pass2", "Pass3", "Pass4",
    "First3FTime", "Last3FTime", "TimeDelta", "BasisWeight",
]
NUMBERS = [
    "ri_Distance", "ri_FirstPrize", "ri_HaedCount", "hi_BasePops", "li_WinOdds", "li_HorseWeight",
    "li_BasisWeight", "hr_OrderOfFinish", "hr_TimeDelta", "hr_PaybackWin",
    "hr_PaybackPlace", "hr_FinishingTime", "hr_Distance",
    *[f"ei_{p}{s}QuinellaPer" for p in ("Father", "Mother") for s in ("Turf", "Dirt")],
    *[f"ei_{f}{p}" for f in (*fixed.CAREER_TOTAL_OF, "Dist") for p in ("First", "Second", "Third", "Lose")],
    *[f"pre{i}_{c}" for i in (1, 2, 3) for c in SLOT_NUMBERS],
]


def schema() -> T.StructType:
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in [*IDS, *CODES]]
        + [T.StructField(c, T.IntegerType()) for c in ("ri_Year", "ri_Month")]
        + [T.StructField(c, T.DoubleType()) for c in NUMBERS]
    )


def rows(races: int = 21, seed: int = 1) -> list[dict]:
    draw = random.Random(seed)
    out = []
    for race in range(races):
        distance = draw.choice([1200.0, 1400.0])
        year = 2012 + race % 7
        size = draw.randint(4, 8)
        finish = draw.sample(range(1, size + 1), size)
        for place in finish:
            row = {c: draw.choice(["1s", "2s", None]) for c in CODES}
            row |= {c: float(draw.randint(1, 9)) if draw.random() > 0.1 else None for c in NUMBERS}
            row |= {c: draw.choice(["r1", None]) for c in IDS}
            row |= {f"pre{i}_RegisterdDate": f"2010010{i}s" for i in (1, 2, 3)}
            row |= {
                "entry": f"e{len(out):04d}", "hi_RaceID": f"race{race:03d}", "ri_Datetime": f"{year}0301s",
                "ri_Discipline": draw.choice(["1s", "2s"]), "hi_HoofCode": draw.choice(["01s", "18s", "13s"]),
                "hi_ConditionClass": "1s", "ri_Year": year, "ri_Month": 1 + race % 12, "ri_Distance": distance,
                "hr_Distance": distance, "hr_OrderOfFinish": float(place), "hr_FinishingTime": 70.0 + place,
                "hr_PaybackWin": 300.0 if place == 1 else None, "hr_PaybackPlace": 150.0 if place < 3 else None,
                "hi_RunningStyle": draw.choice(["1s", "4s", "8s"]),
            }
            out.append(row)
    return out


def entry_table(spark: SparkSession, races: int = 21):
    names = schema().names
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows(races)], schema())
