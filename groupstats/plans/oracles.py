"""DuckDB SQL for each query of the catalogue, over the same tables.

Queries that draw random numbers or fit trees have none.
"""

from __future__ import annotations

ENTRIES = """
WITH e AS (
  SELECT *,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
      || floor(l_extendedprice * 100 + 0.5)::BIGINT || '-' || date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS entry_id,
    CASE WHEN l_tax = 0 THEN 0.0::DOUBLE ELSE l_extendedprice END AS "time",
    nullif(l_quantity, 30) - 2 AS odds,
    l_linenumber AS finish,
    CASE WHEN l_discount >= 0.08 THEN l_extendedprice * l_discount END AS pay_win,
    CASE WHEN l_discount >= 0.05 THEN l_extendedprice * l_tax END AS pay_place,
    (l_discount >= 0.08)::INT AS is_win,
    (l_discount >= 0.05)::INT AS is_place,
    CASE WHEN l_tax <> 0.08 THEN ((l_quantity::INT * 7 + l_linenumber * 3) % 50)::DOUBLE / 50 END AS pred,
    ((l_quantity::INT * 7 + l_linenumber * 3) % 97)::DOUBLE / 97 AS score,
    nullif(l_quantity, 10) AS qty_n,
    CASE WHEN l_discount <> 0.03 THEN l_extendedprice END AS price_n,
    nullif(l_returnflag, 'R') AS flag_n,
    CASE WHEN p_size % 7 <> 0 THEN p_size END AS distance,
    nullif(p_brand, 'Brand#3') AS brand_n,
    year(o_orderdate)::INT AS "year",
    month(o_orderdate)::INT AS "month"
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
)"""

SLOT_FIELDS = {
    "FinishingTime": "value",
    "Distance": "(1000 + 200 * (event_id % 8))::DOUBLE",
    "OrderOfFinish": "(event_id % 7)::DOUBLE",
    "HeadCount": "(event_id % 4)::DOUBLE",
    "Weight": "nullif(value * 10, 0)",
    "TimeDelta": "value - 5",
    "Pass1": "(event_id % 2)::DOUBLE",
    "Pass2": "nullif((event_id % 3)::DOUBLE, 1)",
    "Pass3": "(event_id % 5)::DOUBLE",
    "Pass4": "(event_id % 11)::DOUBLE",
    "Discipline": "event_type",
    "FieldStatus": "substr(event_type, 1, 1)",
    "CourseCode": "(event_id % 3) || 's'",
    "RaceID": "CASE WHEN event_id % 13 <> 0 THEN 'r' || event_id END",
    "RegisterdDate": "CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE strftime(ts, '%Y%m%d') || 's' END",
}

SLOTS = (
    "WITH base AS (SELECT event_id, user_id, ts, "
    + ", ".join(f"{sql} AS {name}" for name, sql in SLOT_FIELDS.items())
    + " FROM events), s AS (SELECT *, "
    + ", ".join(
        f"lag({name}, {i}) OVER w AS pre{i}_{name}" for i in (1, 2, 3) for name in SLOT_FIELDS
    )
    + " FROM base WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
)


def r(sql: str, name: str | None = None, digits: int = 6) -> str:
    """Value cut to ``digits`` decimals."""
    scale = f"1e{digits}::DOUBLE"
    return f"floor(({sql}) * {scale} + 0.5) / {scale}" + (f" AS {name}" if name else "")


def z(value: str, over: str, floor: str | None) -> str:
    """z-score over a window, undefined where the deviation is."""
    std = f"stddev_samp({value}) OVER ({over})"
    if floor:
        std = f"CASE WHEN {std} IS NOT NULL THEN greatest({std}, {floor}) END"
    return f"({value} - avg({value}) OVER ({over})) / nullif({std}, 0)"


def e(select: str, rest: str = "") -> str:
    return f"{ENTRIES} SELECT l_orderkey, entry_id, {select} FROM e {rest}"


def s(select: str, rest: str = "") -> str:
    return f"{SLOTS} SELECT event_id, {select} FROM s {rest}"


G = "PARTITION BY l_orderkey"
MARGIN = f'nullif("time", 0) - min(nullif("time", 0)) OVER ({G})'
ODDS = "CASE WHEN odds >= 1 THEN odds ELSE 99 END"
POPULARITY = f"row_number() OVER ({G} ORDER BY {ODDS}, entry_id)"
PRED_ORDER = f"CASE WHEN pred IS NOT NULL THEN rank() OVER ({G} ORDER BY pred ASC NULLS LAST) END"

ORACLES: dict[str, str] = {}

# ------------------------------------------------------------ group statistics

ORACLES["group_zscore"] = e(
    f"{r(z('l_extendedprice', G, '1e-5'), 'l_extendedprice')}, {r(z('qty_n', G, '1e-5'), 'qty_n')}"
)
ORACLES["group_zscore_new"] = e(
    "price_n, l_quantity, is_win, "
    f"{r(z('price_n', G, '1e-5'), 'price_n_norm')}, {r(z('l_quantity', G, '1e-5'), 'l_quantity_norm')}"
)
ORACLES["global_zscore"] = e(
    f"{r(z('price_n', '', '1e-5'), 'price_n')}, {r(z('l_quantity', '', None), 'l_quantity')}, "
    "0.0::DOUBLE AS flat, 0.0::DOUBLE AS level"
)
ORACLES["mixed_normalize"] = e(
    f"{r(z('l_extendedprice', G, '1e-5'), 'l_extendedprice')}, {r(z('qty_n', G, '1e-5'), 'qty_n')}, "
    f"{r(z('o_totalprice', '', '1e-5'), 'o_totalprice')}, is_win, flag_n"
)
ORACLES["group_mean_append"] = e(
    f"price_n, qty_n, {r(f'avg(price_n) OVER ({G})', 'price_n_mean')}, "
    f"{r(f'avg(qty_n) OVER ({G})', 'qty_n_mean')}"
)
ORACLES["margin_targets"] = e(f'nullif("time", 0) AS "time", {r(MARGIN, "margin")}')
ORACLES["key_zscore_ratio"] = e(
    f"distance, price_n, {r(z('price_n', 'PARTITION BY distance', None), 'norm')}, "
    f"{r('price_n / nullif(avg(price_n) OVER (PARTITION BY distance), 0)', 'div')}",
    "WHERE distance IS NOT NULL",
)
ORACLES["target_set"] = (
    f'{ENTRIES}, m AS (SELECT l_orderkey, entry_id, nullif("time", 0) AS "time", distance, '
    f"{ODDS} AS odds, finish, is_win, is_place, pay_win, {POPULARITY} AS pops_order, {MARGIN} AS margin FROM e) "
    'SELECT l_orderkey, entry_id, "time", distance, odds, finish, is_win, is_place, '
    f"{r('(coalesce(pay_win, 0) - 100) / 100', 'win_return')}, "
    f"{r('(coalesce(pay_win, 0) - 100) / 100', 'place_return')}, pops_order, "
    "(finish < pops_order)::INT AS oof_over_pops, (finish < pops_order)::INT * is_place AS pop_prediction, "
    f"{r('margin', 'margin')}, {r(z('margin', 'PARTITION BY distance', None), 'norm_margin')}, "
    f"{r('margin / nullif(avg(margin) OVER (PARTITION BY distance), 0)', 'div_margin')}, "
    + r(z('"time"', "PARTITION BY distance", None), "norm_time") + ", "
    + r('"time" / nullif(avg("time") OVER (PARTITION BY distance), 0)', "div_time")
    + " FROM m WHERE distance IS NOT NULL"
)
ORACLES["target_set_order"] = e(
    "finish, nullif(p_size % 8, 5) AS base, (finish = 1)::INT AS is_win, is_place, "
    f"{r('(coalesce(pay_win, 0) - 100) / 100', 'win_return')}, "
    f"{r('(coalesce(pay_place, 0) - 100) / 100', 'place_return')}, "
    "coalesce(finish < nullif(p_size % 8, 5), false)::INT AS oof_over_pops, "
    "coalesce(finish < nullif(p_size % 8, 5), false)::INT * is_place AS pop_prediction"
)

# --------------------------------------------------------------- slot features


def _slot_scores() -> str:
    keys = [["Distance"], ["Distance", "Discipline"], ["Distance", "FieldStatus"], ["Distance", "CourseCode"]]
    out = []
    for i in (1, 2, 3):
        for parts in keys:
            over = "PARTITION BY " + ", ".join(f"pre{i}_{p}" for p in parts)
            for t in ("TimeDelta", "FinishingTime"):
                out.append(r(z(f"pre{i}_{t}", over, "1e-8"), f"pre{i}_{t}_{'_'.join(parts)}_tmp_score"))
    return ", ".join(out)


ORACLES["slot_zscore"] = s(_slot_scores())


def _three(name: str) -> str:
    cells = [f"pre{i}_{name}" for i in (1, 2, 3)]
    total = " + ".join(f"coalesce({c}, 0)" for c in cells)
    count = " + ".join(f"({c} IS NOT NULL)::INT" for c in cells)
    listed = ", ".join(cells)
    return (
        f"{r(f'pre1_{name}', f'pre1_{name}')}, {r(f'({total}) / nullif({count}, 0)', f'avg3_{name}')}, "
        f"{r(f'least({listed})', f'min3_{name}')}, {r(f'greatest({listed})', f'max3_{name}')}"
    )


ORACLES["slot_agg3"] = s(
    f"{_three('FinishingTime')}, {_three('Weight')}, pre1_RaceID, pre2_RaceID, pre3_RaceID"
)
ORACLES["slot_ratio"] = s(
    ", ".join(r(f"pre{i}_FinishingTime / nullif(pre{i}_Distance, 0)", f"pre{i}_Speed", 8) for i in (1, 2, 3))
    + ", "
    + ", ".join(r(f"pre{i}_OrderOfFinish / nullif(pre{i}_HeadCount, 0)", f"pre{i}_OofRatio", 8) for i in (1, 2))
)
_FIRST = "coalesce(nullif(pre{0}_Pass1, 0), nullif(pre{0}_Pass2, 0), nullif(pre{0}_Pass3, 0))"
ORACLES["first_corner"] = s(
    ", ".join(
        f"{_FIRST.format(i)} AS first_corner_pass_pre{i}, "
        f"pre{i}_Pass4 - {_FIRST.format(i)} AS first_last_pass_delta_pre{i}"
        for i in (1, 2, 3)
    )
)
ORACLES["slot_delta"] = s(
    ", ".join(
        r(f"{a} - {b}", n)
        for a, b, n in [
            ("Weight", "pre1_Weight", "weight_delta"),
            ("pre1_Weight", "pre2_Weight", "weight_delta_pre1"),
            ("pre2_Weight", "pre3_Weight", "weight_delta_pre2"),
            ("pre1_OrderOfFinish", "pre1_Pass4", "nobi_pre1"),
            ("pre1_Pass4", "pre1_Pass3", "pass_delta_pre1"),
            ("Distance", "pre1_Distance", "distance_delta"),
        ]
    )
)


def _days(later: str, earlier: str, name: str) -> str:
    days = f"date_diff('day', try_strptime({earlier}, '%Y%m%ds'), try_strptime({later}, '%Y%m%ds'))"
    return f"CASE WHEN {days} >= 0 THEN {days}::DOUBLE END AS {name}"


ORACLES["elapsed_days"] = s(
    ", ".join(
        [
            _days("RegisterdDate", "pre1_RegisterdDate", "elapsed_time"),
            _days("pre1_RegisterdDate", "pre2_RegisterdDate", "elapsed_time_1_2"),
            _days("pre3_RegisterdDate", "pre2_RegisterdDate", "elapsed_back"),
        ]
    )
)
ORACLES["change_flags"] = s(
    ", ".join(
        f"coalesce(pre1_{c} = {c}, false)::TINYINT AS {n}"
        for c, n in [
            ("Discipline", "discipline_change"), ("FieldStatus", "field_change"), ("CourseCode", "course_change"),
        ]
    )
)
ORACLES["has_flags"] = s(
    ", ".join(f"(pre{i}_RaceID IS NULL)::TINYINT AS has_pre{i}" for i in (1, 2, 3))
    + ", (RaceID IS NULL)::TINYINT AS has_li"
)

# --------------------------------------------------------- shares and encodings

ORACLES["code_share"] = e(
    "l_linenumber || 's' AS style, "
    + ", ".join(
        r(f"count(*) FILTER (l_linenumber = {i}) OVER ({G})::DOUBLE / count(*) OVER ({G})", n)
        for i, n in enumerate(
            ["nige_ratio", "senko_ratio", "sasi_ratio", "oikomi_ratio", "kouji_ratio", "jizai_ratio"], 1
        )
    )
)

_FAMILIES = {"Jra": "F", "Inter": "O", "Other": "P"}
_PLACES = {"First": "1", "Second": "2", "Third": "3", "Lose": "4"}
_WIN = "JraFirst + InterFirst + OtherFirst"
_PLACE = " + ".join(f"{f}First + {f}Second + {f}Third" for f in _FAMILIES)
_TOTAL = f"{_PLACE} + JraLose + InterLose + OtherLose"
ORACLES["career_rollup"] = (
    "WITH c AS (SELECT o_custkey, "
    + ", ".join(
        f"count(*) FILTER (o_orderstatus = '{st}' AND o_orderpriority LIKE '{d}%') AS {f}{p}"
        for f, st in _FAMILIES.items()
        for p, d in _PLACES.items()
    )
    + ", "
    + ", ".join(
        f"count(*) FILTER (o_orderpriority LIKE '{_PLACES[p]}%') AS ei_Dist{p}" for p in ("First", "Second", "Third")
    )
    + " FROM orders GROUP BY o_custkey) SELECT o_custkey, "
    + ", ".join(f"{f}Lose AS ei_{f}Lose" for f in _FAMILIES)
    + ", ei_DistFirst, ei_DistSecond, ei_DistThird, "
    + ", ".join(
        r(f"{f}Lose / nullif({f}First + {f}Second + {f}Third + {f}Lose, 0)::DOUBLE", f"ei_{f}LosePer")
        for f in _FAMILIES
    )
    + f", {_TOTAL} AS ei_TotalTotal, {_WIN} AS ei_TotalWin, {_PLACE} AS ei_TotalPlace, "
    + r(f"({_WIN}) / nullif({_TOTAL}, 0)::DOUBLE", "ei_TotalWinPer") + ", "
    + r(f"({_PLACE}) / nullif({_TOTAL}, 0)::DOUBLE", "ei_TotalPlacePer")
    + " FROM c"
)


def _encoded(key: str, target: str, k: int, f: int) -> str:
    over = f"PARTITION BY {key}"
    weight = f"(1 / (1 + exp(-(count(*) OVER ({over}) - {k}) / {f}::DOUBLE)))"
    return f"{weight} * avg({target}) OVER ({over}) + (1 - {weight}) * avg({target}) OVER ()"


ORACLES["target_encode"] = (
    f"{ENTRIES}, t AS (SELECT l_orderkey, entry_id, brand_n, "
    f"{r(_encoded('brand_n', 'price_n', 600, 300), 'brand_n_te', 4)} FROM e) "
    "SELECT * FROM t WHERE brand_n IS NOT NULL"
)


def _pairs(groups: dict[str, str], codes: dict[str, str]) -> str:
    """Names of codes and their values."""
    out = []
    for gn, g in groups.items():
        for cn, c in codes.items():
            for t in ("is_place", "price_n"):
                out.append(r(_encoded(f"{c}, {g}", t, 500, 30), f"{gn}_{cn}_te_{t}", 4))
    return ", ".join(out)


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


ORACLES["target_encode_pairs"] = e(_pairs(_same("o_orderpriority", "l_linestatus"), _same("p_type", "flag_n")))
ORACLES["target_encode_many"] = e(
    _pairs(
        _same("o_orderpriority", "l_linestatus", "flag_n") | {"y": '"year"', "m": '"month"'},
        _same("p_type", "l_returnflag", "brand_n", "p_name")
        | {"size": "p_size", "line": "l_linenumber", "supplier": "l_suppkey", "begin": "substr(p_name, 1, 3)"},
    )
)

_CODES = ["l_returnflag", "flag_n", "p_type", "brand_n", "p_name"]
_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS \"value\" FROM e" for c in _CODES)
ORACLES["value_counts"] = (
    f'{ENTRIES}, c AS ({_CELLS}) SELECT "column", "value", count(*) AS "count" FROM c '
    'WHERE "value" IS NOT NULL GROUP BY ALL'
)
ORACLES["distinct_counts"] = (
    f'{ENTRIES}, c AS ({_CELLS}) SELECT "column", '
    'count(DISTINCT "value") + max(("value" IS NULL)::BIGINT) AS distinct_values FROM c GROUP BY ALL'
)
ORACLES["fold_rare_others"] = e(
    ", ".join(
        f"CASE WHEN {c} IS NOT NULL AND count(*) OVER (PARTITION BY {c}) > 940 THEN {c} ELSE 'others' END AS {c}"
        for c in ("p_name", "flag_n", "brand_n")
    )
)
_MIX = "p_brand || '/' || p_size"
ORACLES["fold_rare_few"] = e(
    f"CASE WHEN count(*) OVER (PARTITION BY {_MIX}) >= 45 THEN {_MIX} ELSE 'few' END AS mix, "
    "CASE WHEN flag_n IS NULL OR count(*) OVER (PARTITION BY flag_n) >= 45 THEN flag_n ELSE 'few' END AS flag_n"
)


def _label(c: str) -> str:
    return f"(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1)::INT"


ORACLES["label_encode"] = e(", ".join(f"{_label(c)} AS {c}" for c in ("p_name", "flag_n", "brand_n")))
ORACLES["one_hot"] = e(
    ", ".join(
        f"coalesce({c} = '{v}', false)::TINYINT AS {c}_{v}"
        for c, v in [("flag_n", "A"), ("flag_n", "N"), ("l_linestatus", "F"), ("l_linestatus", "O")]
    )
)
_MAX = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", max(label)::BIGINT AS max_code FROM (SELECT {_label(c)} AS label FROM e)"
    for c in ("p_brand", "p_name", "flag_n")
)
ORACLES["max_code"] = f"{ENTRIES} {_MAX}"
ORACLES["embedding_width"] = (
    f'{ENTRIES}, m AS ({_MAX}) SELECT "column", '
    "CASE WHEN n < 10 THEN n // 2 + 1 WHEN n < 30 THEN n // 5 + 1 WHEN n < 150 THEN n // 10 + 1 "
    "WHEN n < 300 THEN n // 15 + 1 ELSE n // 50 + 1 END::INT AS divided, "
    "CASE WHEN n < 10 THEN n WHEN n < 20 THEN 10 ELSE 20 END::INT AS capped_10, "
    "CASE WHEN n < 5 THEN n WHEN n < 20 THEN 10 ELSE 20 END::INT AS capped_5 "
    'FROM (SELECT "column", max_code + 1 AS n FROM m)'
)

# ------------------------------------------------------------------ null handling

_NULLABLE = ["price_n", "qty_n", "flag_n", "pay_win", "pred"]
ORACLES["null_count"] = e(" + ".join(f"({c} IS NULL)::INT" for c in _NULLABLE) + " AS null_count")
ORACLES["completeness"] = (
    f"{ENTRIES} SELECT "
    + r(
        "(2 * count(*) + " + " + ".join(f"count({c})" for c in _NULLABLE) + ") / (count(*) * 7)::DOUBLE",
        "completeness",
    )
    + " FROM e"
)
ORACLES["fill_global"] = e(
    f"{r('coalesce(price_n, avg(price_n) OVER ())', 'price_n', 4)}, "
    f"{r('coalesce(qty_n, avg(qty_n) OVER ())', 'qty_n', 4)}, 0.0::DOUBLE AS empty, "
    "coalesce(flag_n, 'nan') AS flag_n"
)
ORACLES["fill_group"] = e(
    ", ".join(r(f"coalesce({c}, avg({c}) OVER ({G}), 0)", c) for c in ("price_n", "qty_n", "pay_win"))
    + ", coalesce(flag_n, 'nan') AS flag_n"
)
ORACLES["fill_zero"] = e("coalesce(price_n, 0) AS price_n, coalesce(qty_n, 0) AS qty_n")
ORACLES["payback_scale"] = e(
    ", ".join(
        f"{r(f'least(greatest(coalesce({c}, 0) / 100, 0), 100)', c)}, {r(f'coalesce({c}, 0) / 100', f'{c}_eval')}"
        for c in ("pay_win", "pay_place")
    )
)
ORACLES["column_profile"] = f"{ENTRIES} " + " UNION ALL ".join(
    [
        f"SELECT '{c}' AS \"column\", 'numerical' AS kind, {r(f'avg({c})', 'mean', 4)}, "
        f"{r(f'stddev_samp({c})', 'std', 4)} FROM e"
        for c in ("l_quantity", "price_n", "qty_n", "pay_win")
    ]
    + ["SELECT 'flag_n', 'categorical', NULL::DOUBLE, NULL::DOUBLE"]
)

_NUMBERS, _TEXTS = ("l_quantity", "price_n", "l_orderkey"), ("flag_n", "p_name", "brand_n")
ORACLES["merged_profile"] = f"{ENTRIES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS \"rows\", (count(*) - count({c}))::BIGINT AS nulls, TRUE AS near, "
    + (
        f"{r(f'max({c}::DOUBLE)', 'largest', 2)}, NULL::VARCHAR AS largest_text, {r(f'avg({c})', 'mean', 4)}, {r(f'stddev_samp({c})', 'std', 4)} FROM e"
        if c in _NUMBERS
        else f"NULL::DOUBLE AS largest, max({c}) AS largest_text, NULL::DOUBLE AS mean, NULL::DOUBLE AS std FROM e"
    )
    for c in _NUMBERS + _TEXTS
)

# -------------------------------------------------------------------- projections


def _bucket(d: str) -> str:
    return (
        f"CASE WHEN {d} BETWEEN 1000 AND 1400 THEN 'sprint' WHEN {d} > 1400 AND {d} <= 1600 THEN 'mile' "
        f"WHEN {d} > 1600 AND {d} <= 2200 THEN 'middle' WHEN {d} > 2200 AND {d} < 2600 THEN 'classic' "
        f"WHEN {d} >= 2600 THEN 'stayer' END"
    )


ORACLES["distance_bucket"] = e(f"distance * 60 AS length, {_bucket('distance * 60')} AS distance_category")
_HOOF = "nullif(lpad((p_size % 27)::VARCHAR, 2, '0') || 's', '03s')"
ORACLES["code_lookup"] = e(
    f"p_size * 60 AS length, {_bucket('p_size * 60')} AS distance_category, "
    f"CASE WHEN {_HOOF} IN ('01s','02s','03s','04s') THEN 't1' WHEN {_HOOF} IN ('05s','06s','07s','08s') THEN 't2' "
    f"WHEN {_HOOF} IN ('09s','10s','11s','12s') THEN 't3' WHEN {_HOOF} IN ('17s','18s','19s','20s') THEN 't4' "
    f"WHEN {_HOOF} IN ('21s','22s','23s','24s') THEN 't5' ELSE 'o' END AS hoof_type, "
    f"CASE WHEN {_HOOF} IN ('01s','05s','09s','17s','21s') THEN 'l' WHEN {_HOOF} IN ('02s','06s','10s','18s','22s') "
    f"THEN 'm' WHEN {_HOOF} IN ('03s','07s','11s','19s','23s') THEN 's' "
    f"WHEN {_HOOF} IN ('04s','08s','12s','20s','24s') THEN 'qs' ELSE 'o' END AS hoof_size"
)
ORACLES["choose_by_code"] = e(
    "CASE WHEN flag_n = 'A' THEN l_extendedprice WHEN flag_n = 'N' THEN l_quantity END AS chosen"
)
_KIND = "CASE WHEN p_type = 'SMALL' THEN 's' ELSE p_type END"


def _both(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 's' OR {b} = 's' THEN 's' ELSE {a} || {b} END"


ORACLES["combine_codes"] = e(
    f"{_both('flag_n', 'o_orderstatus')} AS flag_n_status, {_both('flag_n', 'l_linestatus')} AS flag_n_l_linestatus, "
    f"{_both(f'({_KIND})', 'o_orderstatus')} AS kind_status, {_both(f'({_KIND})', 'l_linestatus')} AS kind_l_linestatus"
)
ORACLES["season_cycle"] = e(
    f"\"month\", {r('sin(pi() / 6 * \"month\")', 'season_sin')}, {r('cos(pi() / 6 * \"month\")', 'season_cos')}"
)
ORACLES["log_target"] = e(
    ", ".join(
        r(f"CASE WHEN 1 + {c} > 0 THEN ln(1 + {c}) END", n) for c, n in [("odds", "log_odds"), ("price_n", "log_price")]
    )
)
ORACLES["row_filters"] = e(
    "\"year\", CASE WHEN flag_n = 'N' THEN 's' ELSE flag_n END AS flag, (finish = 1)::INT AS \"first\"",
    "WHERE qty_n IS NOT NULL AND odds IS NOT NULL AND odds <> 0 AND coalesce(flag_n <> 'A', true) "
    f"AND {_bucket('p_size * 60')} = 'middle' AND \"year\" >= 1997 AND \"year\" BETWEEN 1996 AND 2000",
)

# ----------------------------------------------------------------------- ranking

ORACLES["popularity_order"] = e(f"{ODDS} AS odds, {POPULARITY} AS pops_order")
ORACLES["pred_rank"] = e(f"pred, {PRED_ORDER} AS pred_order")


def _pick(direction: str) -> str:
    return (
        f"(pred IS NOT NULL AND row_number() OVER ({G} ORDER BY pred {direction} NULLS LAST, entry_id) = 1)::INT"
    )


ORACLES["top1_pick"] = e(f"pred, {_pick('DESC')} AS pick_max, {_pick('ASC')} AS pick_min")
ORACLES["crowd_flag"] = (
    f"{ENTRIES}, p AS (SELECT *, {POPULARITY} AS pops_order, {PRED_ORDER} AS pred_order FROM e) "
    "SELECT l_orderkey, entry_id, (finish < pops_order)::INT AS oof_over_pops, "
    "(finish < pops_order)::INT * is_place AS pop_prediction, "
    "coalesce(pred_order < pops_order, false)::TINYINT AS kaime FROM p"
)
ORACLES["leave_one_out"] = e(
    f"{r(f'sum(coalesce(price_n, 0)) OVER ({G}) - coalesce(price_n, 0)', 'price_others', 3)}, "
    f"count(*) OVER ({G}) - 1 AS others"
)

# ----------------------------------------------------------------- group filters

ORACLES["drop_groups_no_winner"] = e("is_win", f"QUALIFY max(is_win) OVER ({G}) = 1")
ORACLES["drop_groups_zero_sum"] = e(
    r("pay_win", "pay_win"), f"QUALIFY coalesce(sum(pay_win) OVER ({G}), 0) <> 0"
)
ORACLES["keep_groups"] = e("l_quantity", "WHERE o_orderstatus = 'P'")
ORACLES["drop_listed_groups"] = e("l_quantity", "WHERE o_orderstatus <> 'P'")

# ------------------------------------------------------------------------ splits

ORACLES["year_split"] = e("\"year\", CASE WHEN \"year\" < 2000 THEN 'train' ELSE 'test' END AS split")


def _group_fold(k: int) -> str:
    return (
        "g AS (SELECT l_orderkey, least((row_number() OVER (ORDER BY md5('16:' || l_orderkey)) - 1) "
        f"// (count(*) OVER () // {k}), {k - 1})::INT AS fold FROM (SELECT DISTINCT l_orderkey FROM e))"
    )


ORACLES["group_kfold"] = (
    f"{ENTRIES}, {_group_fold(10)} SELECT l_orderkey, entry_id, fold FROM e JOIN g USING (l_orderkey)"
)
ORACLES["row_kfold"] = e("(ntile(3) OVER (ORDER BY md5('32:' || entry_id)) - 1)::INT AS fold")
ORACLES["holdout_groups"] = (
    f"{ENTRIES}, y AS (SELECT * FROM e WHERE \"year\" >= 1997), "
    "g AS (SELECT l_orderkey, row_number() OVER (ORDER BY md5('32:' || l_orderkey)) <= 1000 AS is_test "
    "FROM (SELECT DISTINCT l_orderkey FROM y)) "
    'SELECT l_orderkey, entry_id, "year", is_test FROM y JOIN g USING (l_orderkey)'
)
ORACLES["downsample_exact"] = e(
    "is_win",
    "QUALIFY is_win = 1 OR row_number() OVER (PARTITION BY is_win ORDER BY md5('32:' || entry_id)) "
    "<= sum(is_win) OVER ()",
)
ORACLES["upsample_exact"] = (
    f"{ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY is_win ORDER BY md5('32:' || entry_id)) AS i, "
    "sum(is_win) OVER ()::BIGINT AS ones, count(*) OVER () - sum(is_win) OVER ()::BIGINT AS zeros FROM e) "
    "SELECT l_orderkey, entry_id, is_win, unnest(range(CASE WHEN is_win = 0 THEN 1 "
    "ELSE zeros // ones + (i <= zeros % ones)::BIGINT END))::INT AS copy FROM n"
)

# ------------------------------------------------------------------- group arrays


def _padded(fields: dict[str, tuple[str, str]], key: str = "l_orderkey") -> str:
    """``fields`` maps a name to its real value and its padding value; padding is shuffled in by digests of its own."""
    real = ", ".join(f"{v} AS {n}" for n, (v, _) in fields.items())
    blank = ", ".join(f"{p} AS {n}" for n, (_, p) in fields.items())
    return (
        f"sized AS (SELECT {key}, count(*) AS n, {blank} FROM e WHERE {key} IS NOT NULL GROUP BY {key}), "
        "pads AS (SELECT *, unnest(range(1, (18 - n % 18) % 18 + 1)) AS j FROM sized), "
        f"mixed AS (SELECT {key}, {real}, 0 AS is_padded, md5('5:' || entry_id) AS d FROM e WHERE {key} IS NOT NULL "
        f"UNION ALL SELECT {key}, {', '.join(fields)}, 1, md5('5:' || {key} || ':pad:' || j) FROM pads), "
        f"padded AS (SELECT * EXCLUDE (d), ((k - 1) // 18)::INT AS block, ((k - 1) % 18 + 1)::INT AS pos "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY d) AS k FROM mixed))"
    )


_PADDED = _padded(
    {
        "l_extendedprice": ("l_extendedprice", "avg(l_extendedprice)"),
        "score": ("score", "avg(score)"),
        "l_linenumber": ("l_linenumber", "0"),
        "finish": ("finish", "19"),
        "is_win": ("is_win", "0"),
        "is_place": ("is_place", "0"),
    }
)
_CENTS = "floor(l_extendedprice * 100 + 0.5)"
_PADDED_WIDE = _padded(
    {
        "l_extendedprice": (_CENTS, f"avg({_CENTS})"),
        "score": ("score", "avg(score)"),
        "l_linenumber": ("l_linenumber", "0"),
        "is_win": ("is_win", "0"),
    },
    "l_suppkey",
)
ORACLES["pad_groups"] = (
    f"{ENTRIES}, {_PADDED} SELECT l_orderkey, block, pos, {r('l_extendedprice', 'l_extendedprice')}, "
    f"{r('score', 'score')}, l_linenumber, finish, is_win, is_place, is_padded FROM padded"
)
ORACLES["pad_shuffled_groups"] = (
    f"{ENTRIES}, {_PADDED_WIDE} SELECT l_suppkey, block, pos, {r('l_extendedprice', 'l_extendedprice')}, "
    f"{r('score', 'score')}, l_linenumber, is_win, is_padded FROM padded"
)


ORACLES["pad_wide_groups"] = (
    f"{ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('5:' || entry_id)) - 1 AS k "
    "FROM e WHERE l_suppkey IS NOT NULL), "
    f"g AS (SELECT l_suppkey, count(*) AS n, avg({_CENTS}) AS price, avg(score) AS score FROM e "
    "WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey), "
    "b AS (SELECT *, unnest(range(n % 18, 18)) AS i FROM g WHERE n % 18 > 0) "
    f"SELECT l_suppkey, (k // 18)::INT AS block, (k % 18 + 1)::INT AS pos, {r(_CENTS, 'l_extendedprice')}, "
    f"{r('score', 'score')}, l_linenumber, is_win, 0 AS is_padded FROM n UNION ALL "
    f"SELECT l_suppkey, (n // 18)::INT, (i + 1)::INT, {r('price')}, {r('score')}, 0, 0, 1 FROM b"
)


def _millionths(value: str) -> str:
    return f"floor({value} * 1000000 + 0.5)::BIGINT"


def _tensor(padded: str, key: str) -> str:
    return (
        f"{ENTRIES}, {padded} SELECT {key}, block, count(*)::INT AS width, "
        f"string_agg({_millionths('l_extendedprice')} || ',' || {_millionths('score')}, ',' ORDER BY pos) AS main, "
        "string_agg(l_linenumber::VARCHAR, ',' ORDER BY pos) AS line, "
        f"string_agg(is_win::VARCHAR, ',' ORDER BY pos) AS win FROM padded GROUP BY {key}, block"
    )


ORACLES["group_tensor"] = _tensor(_PADDED, "l_orderkey")
ORACLES["group_tensor_wide"] = _tensor(_PADDED_WIDE, "l_suppkey")
ORACLES["group_rows"] = (
    f"{ENTRIES}, p AS (SELECT *, row_number() OVER ({G} ORDER BY entry_id) AS pos FROM e) "
    "SELECT l_orderkey, ((pos - 1) // 4)::INT AS chunk, count(*)::INT AS entries, "
    f"string_agg({_millionths('l_extendedprice')} || ',' || {_millionths('l_quantity')}, ',' ORDER BY pos) AS x, "
    f"string_agg({_millionths('score')}::VARCHAR, ',' ORDER BY pos) AS y FROM p GROUP BY ALL"
)
_P = "PARTITION BY l_suppkey"
ORACLES["group_chain"] = (
    f"{ENTRIES}, m AS (SELECT *, nullif(\"time\", 0) AS t, CASE WHEN odds >= 1 THEN odds ELSE 99 END AS o FROM e "
    "WHERE l_suppkey IS NOT NULL) "
    f"SELECT l_suppkey, entry_id, {r(f't - min(t) OVER ({_P})', 'margin')}, "
    f"row_number() OVER ({_P} ORDER BY o, entry_id) AS pops_order, "
    f"CASE WHEN pred IS NOT NULL THEN rank() OVER ({_P} ORDER BY pred NULLS LAST) END AS pred_order, "
    f"(pred IS NOT NULL AND row_number() OVER ({_P} ORDER BY pred DESC NULLS LAST, entry_id) = 1)::INT AS pred_bin, "
    f"{r(f'sum(l_quantity) OVER ({_P}) - l_quantity', 'rest')}, count(*) OVER ({_P}) - 1 AS others FROM m"
)
ORACLES["draw_many_groups"] = (
    f"{ENTRIES}, g AS (SELECT l_orderkey, row_number() OVER (ORDER BY md5('10:' || l_orderkey)) AS i, "
    "count(*) OVER () AS n FROM (SELECT DISTINCT l_orderkey FROM e)), "
    "lots AS (SELECT (k // 2)::INT AS draw, (k % 2)::INT AS part FROM range(200000) t(k)), "
    "d AS (SELECT draw, part, ('0x' || substr(md5('10:' || draw || ':' || part), 1, 12))::BIGINT "
    "% (SELECT max(n) FROM g) + 1 AS i FROM lots) "
    "SELECT draw, count(*) AS entries, min(entry_id) AS least, max(entry_id) AS greatest "
    "FROM d JOIN g USING (i) JOIN e USING (l_orderkey) GROUP BY draw"
)
ORACLES["draw_groups"] = (
    f"{ENTRIES}, g AS (SELECT l_orderkey, row_number() OVER (ORDER BY md5('9:' || l_orderkey)) AS i, "
    "count(*) OVER () AS n FROM (SELECT DISTINCT l_orderkey FROM e)), "
    "lots AS (SELECT (k // 2)::INT AS draw, (k % 2)::INT AS part FROM range(128) t(k)), "
    "d AS (SELECT draw, part, ('0x' || substr(md5('9:' || draw || ':' || part), 1, 12))::BIGINT "
    "% (SELECT max(n) FROM g) + 1 AS i FROM lots) "
    "SELECT l_orderkey, entry_id, draw, part FROM d JOIN g USING (i) JOIN e USING (l_orderkey)"
)

# ------------------------------------------------------------------------ reports

_REPORT = ["win", "place"]


def _picked(direction: str, more: str = "") -> str:
    return (
        f"SELECT *{more} FROM e QUALIFY row_number() OVER ({G} ORDER BY pred {direction} NULLS LAST, entry_id) = 1"
    )


def _report(stakes: str, keep: str = "pred IS NOT NULL") -> str:
    return ", ".join(
        r(f"coalesce(sum(is_{n}) FILTER ({keep}), 0) / nullif({stakes}, 0)::DOUBLE", f"{n}_hit") + ", "
        + r(
            f"coalesce(sum(coalesce(pay_{n}, 0)) FILTER ({keep}), 0) / nullif({stakes} * 100, 0)::DOUBLE",
            f"{n}_return",
        )
        for n in _REPORT
    )


ORACLES["top1_report"] = f"{ENTRIES} " + " UNION ALL ".join(
    f"SELECT count(*) AS groups, {_report('count(*)')}, '{mode}' AS mode FROM ({_picked(d)})"
    for mode, d in [("argmax", "DESC"), ("argmin", "ASC")]
)
ORACLES["value_bet_report"] = (
    f"{ENTRIES}, p AS ({_picked('ASC', f', {POPULARITY} AS pops, {PRED_ORDER} AS ranked')}) "
    "SELECT count(*) FILTER (ranked < pops) AS buys, "
    f"{_report('count(*) FILTER (ranked < pops)', 'ranked < pops')} FROM p"
)
ORACLES["fold_summary"] = (
    f"{ENTRIES}, {_group_fold(5)}, p AS ({_picked('ASC')}), f AS (SELECT fold, avg(is_win) AS win_hit, "
    "avg(is_place) AS place_hit, avg(coalesce(pay_win, 0)) / 100 AS win_return, "
    "avg(coalesce(pay_place, 0)) / 100 AS place_return FROM (SELECT l_orderkey, "
    + ", ".join(
        f"CASE WHEN pred IS NOT NULL THEN {c} END AS {c}" for c in ("is_win", "is_place", "pay_win", "pay_place")
    )
    + ", CASE WHEN pred IS NOT NULL THEN fold END AS fold FROM p JOIN g USING (l_orderkey)) GROUP BY fold) SELECT "
    + ", ".join(
        f"{r(f'avg({m})', f'{m}_mean')}, {r(f'stddev_pop({m})', f'{m}_std')}"
        for m in ("win_hit", "place_hit", "win_return", "place_return")
    )
    + " FROM f"
)
ORACLES["threshold_sweep"] = (
    f"{ENTRIES}, c AS (SELECT i / 50.0::DOUBLE AS cutoff FROM range(50) t(i)), "
    "m AS (SELECT min(pred) AS lo, max(pred) AS hi FROM e) "
    f"SELECT {r('cutoff', 'cutoff')}, count(pred) AS buys, "
    + ", ".join(
        r(f"sum(is_{n}) / nullif(count(pred), 0)::DOUBLE", f"{n}_hit") + ", "
        + r(f"sum(coalesce(pay_{n}, 0)) / nullif(count(pred) * 100, 0)", f"{n}_return")
        for n in _REPORT
    )
    + f", {r('any_value(lo)', 'min_pred')}, {r('any_value(hi)', 'max_pred')} "
    "FROM c CROSS JOIN m LEFT JOIN e ON pred > cutoff GROUP BY cutoff"
)
ORACLES["buy_skip_report"] = (
    f"{ENTRIES} SELECT count(*) FILTER (pred >= 1 - pred) AS buys, count(*) AS entries, "
    + r(
        "sum(least(greatest(l_discount * 20, 0), 1)) FILTER (pred >= 1 - pred) / count(*) FILTER (pred >= 1 - pred)",
        "hit_ratio",
    )
    + ", "
    + r("sum(l_discount * 20) FILTER (pred >= 1 - pred) / count(*) FILTER (pred >= 1 - pred)", "return_ratio")
    + " FROM e"
)


def _first_best(c: str) -> str:
    return f"first_value(CASE WHEN {c} IS NOT NULL THEN entry_id END) OVER ({G} ORDER BY {c} DESC NULLS LAST, entry_id)"


ORACLES["argmax_hit"] = (
    f"{ENTRIES}, h AS (SELECT DISTINCT l_orderkey, coalesce({_first_best('pred')} = {_first_best('finish')}, false) "
    f"AS hit FROM e) SELECT count(*) AS groups, {r('avg(hit::INT)', 'hit_ratio')} FROM h"
)
ORACLES["winner_accuracy"] = (
    f"{ENTRIES}, m AS (SELECT l_orderkey, pred, {MARGIN} AS margin, entry_id FROM e), p AS (SELECT * FROM m "
    f"QUALIFY row_number() OVER ({G} ORDER BY pred ASC NULLS LAST, entry_id) = 1) SELECT count(*) AS groups, "
    f"{r('avg((pred IS NOT NULL AND coalesce(margin = 0, false))::INT)', 'accuracy')} FROM p"
)
def _pair_sum(term: str, scale: str, key: str, unordered: bool) -> str:
    fields = _padded({"score": ("score", "avg(score)"), "gap": ("l_discount", "avg(l_discount)")}, key)
    later = " AND a.block * 18 + a.pos < b.block * 18 + b.pos" if unordered else ""
    return (
        f"{ENTRIES}, {fields}, widths AS (SELECT {key}, count(*)::DOUBLE AS w FROM padded GROUP BY {key}) "
        f"SELECT a.{key}, {r(f'sum({term}) / first({scale})', 'loss')} "
        f"FROM padded a JOIN padded b ON a.{key} = b.{key}{later} JOIN widths ON widths.{key} = a.{key} GROUP BY a.{key}"
    )


_P = "(1 / (1 + exp(-(a.score - b.score))))"
_T = "(1 / (1 + exp(-(a.gap - b.gap))))"
_XENT = f"-{_T} * ln(greatest({_P}, 1e-8)) - (1 - {_T}) * ln(greatest(1 - {_P}, 1e-8))"
_TANH = "((exp(2 * (b.gap - a.gap)) - 1) / (exp(2 * (b.gap - a.gap)) + 1))"
_SOFTPLUS = f"least(greatest(w + ln(1 + exp(b.score - a.score)) * {_TANH}, 0), w)"
for _name, _key in (("", "l_orderkey"), ("_wide", "l_suppkey")):
    ORACLES[f"pairwise_xent{_name}"] = _pair_sum(_XENT, "w", _key, True)
    ORACLES[f"pairwise_softplus{_name}"] = _pair_sum(_SOFTPLUS, "w * w", _key, False)
ORACLES["cross_entropy"] = (
    f"{ENTRIES} SELECT "
    + r("avg(-is_win * ln(greatest(score, 1e-8)) - (1 - is_win) * ln(greatest(1 - score, 1e-8)))", "cross_entropy")
    + ", "
    + r("avg(-is_win * ln(least(greatest(score, 1e-8), 1)))", "log_loss")
    + " FROM e"
)
_KEPT = "CASE WHEN score > 0.5 THEN l_discount * 20 + 0.013 ELSE 1 END"
_REST = f"sum({_KEPT}) OVER ({G}) - ({_KEPT}) - count(*) OVER ({G})"
ORACLES["loo_reward"] = (
    f"{ENTRIES}, raw AS (SELECT l_orderkey, entry_id, (score > 0.5)::INT AS buy, 1 + {_REST} AS s0, "
    f"l_discount * 20 + 0.013 + {_REST} AS b0 FROM e), "
    "w AS (SELECT *, s0 + (s0 > 0.4)::INT AS s1, b0 + (b0 > 0.4)::INT AS b1 FROM raw) "
    f"SELECT l_orderkey, entry_id, buy, {r('s1 - (s1 + b1) / 2', 'reward_skip')}, "
    f"{r('b1 - (s1 + b1) / 2', 'reward_buy')} FROM w"
)

# ---------------------------------------------------------- columns and model input

ORACLES["feature_columns"] = e("score, l_tax, is_win AS label")
ORACLES["chosen_columns"] = e("l_quantity, score")
ORACLES["cast_codes"] = (
    f"{ENTRIES} SELECT l_orderkey::INT AS l_orderkey, entry_id, l_linenumber::INT AS line, nullif(l_tax, 0) AS tax, "
    "l_quantity::FLOAT AS l_quantity FROM e"
)
ORACLES["model_input"] = e(f"{_millionths('l_quantity')} || ',' || {_millionths('l_tax')} AS main, flag_n, l_linestatus")
ORACLES["one_hot_wide"] = (
    f"{ENTRIES}, n AS (SELECT p_name, (row_number() OVER (ORDER BY p_name) - 1)::INT AS place FROM (SELECT DISTINCT p_name FROM e)) "
    "SELECT l_orderkey, entry_id, coalesce(flag_n = 'A', false)::TINYINT AS flag_n_A, "
    "coalesce(flag_n = 'N', false)::TINYINT AS flag_n_N, place, 1.0::DOUBLE AS total FROM e JOIN n USING (p_name)"
)
ORACLES["shuffled_sample"] = e("l_quantity", "ORDER BY md5('3:' || entry_id) LIMIT 1000")
ORACLES["importance_order"] = (
    f"{ENTRIES}, c AS (SELECT l_returnflag || l_linestatus AS feature, count(*)::DOUBLE AS importance FROM e GROUP BY 1) "
    "SELECT feature, importance, row_number() OVER (ORDER BY importance, feature)::INT AS place FROM c"
)

# -------------------------------------------------------------- sources and sinks

ORACLES["declared_scan"] = f"SELECT o_orderkey, {r('o_totalprice', 'o_totalprice', 2)} FROM orders"
ORACLES["held_out_sample"] = (
    f"{ENTRIES} SELECT count(*) AS rows, sum(l_quantity) AS quantity, least(count(*), 100) AS limited FROM e "
    "WHERE ('0x' || substr(md5('32:' || entry_id), 1, 12))::BIGINT / 281474976710656.0 < 0.1"
)

ORACLES["csv_scan"] = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 THEN o_orderstatus END AS o_orderstatus, "
    "CASE WHEN o_orderkey % 13 > 0 AND o_orderkey % 17 > 0 THEN o_totalprice END AS o_totalprice, "
    "(o_orderkey % 5)::INT AS lines FROM orders"
)
ORACLES["csv_bad_values"] = (
    "SELECT 'o_totalprice' AS \"column\", '12,5 EUR' AS value, o_orderkey FROM orders WHERE o_orderkey % 13 = 0"
)
ORACLES["csv_to_parquet"] = f"SELECT o_orderkey, o_orderstatus, {r('o_totalprice', 'o_totalprice', 2)} FROM orders"
ORACLES["scored_table"] = e("\"year\", pred, CASE WHEN \"year\" < 2000 THEN 'train' ELSE 'test' END AS split")

# ------------------------------------------------------------------------ models

ORACLES["gbt_search"] = "SELECT i::INT AS trial, true AS in_order, true AS measured FROM range(6) t(i)"
ORACLES["gbt_nominal"] = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, count(*) AS rows, true AS exact, true AS beats_constant FROM lineitem {join}"
    for kind, join in (("set", "JOIN part ON p_partkey = l_partkey"), ("flag", "JOIN part ON p_partkey = l_partkey"))
)

# --------------------------------------------------------------------- streaming

ORACLES["stream_apply"] = (
    "SELECT event_id, event_type, " + r(_encoded("event_type", "value", 1000, 500), "value_te") + " FROM events"
)


def _uniform(seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || entry_id), 1, 12))::BIGINT / 281474976710656.0)"


ORACLES["row_split"] = e(f"CASE WHEN {_uniform(32)} < 0.1 THEN 'test' ELSE 'train' END AS split")
ORACLES["action_sample"] = e(
    f"({_uniform(7)} > score)::INT AS drawn, "
    f"CASE WHEN {_uniform(8)} < 0.05 THEN 1 - (score > 0.5)::INT ELSE (score > 0.5)::INT END AS flipped"
)
