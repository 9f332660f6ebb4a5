"""Test cases for the fixed checks: decoded from row numbers, labelled by the checks themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.operators import checks

# What cases try at and around the bounds.
LANE_WIDTHS = [5.0, 8.0, 8.9, 9.0, 9.5, 10.0, 10.5, 11.0, 11.5, 12.0, 12.1, 13.0, 15.0, 20.0]
SHOULDER_WIDTHS = [0.0, 2.0, 3.9, 4.0, 5.0, 6.0, 8.0, 10.0, 10.1, 12.0, 15.0]
HOR_CLASSES = [-1, 0, 1, 2, 3, 4, 5, 6, 10]
PASSING_TYPES = [-1, 0, 1, 2, 3, 5]
SPEEDS = [15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75]
WRONG_CLASSES = [-1, 6, 7, 8, 9, 10]
WRONG_TYPES = [-1, 3, 4, 5]
#: The checks that label cases.
CONSTRAINTS = [
    ("SF-001", "lane_width", 9.0, 12.0, None, "error", None), ("SF-002", "shoulder_width", 4.0, 10.0, None, "error", None),
    ("SF-003", "hor_class", None, None, [0, 1, 2, 3, 4, 5], "error", None), ("SF-004", "passing_type", None, None, [0, 1, 2], "error", None),
]
FIELDS = ("lane_width", "shoulder_width", "hor_class", "passing_type", "design_rad", "spl")
BELOW, ABOVE = 50.0, 200.0


def boundaries() -> list[tuple[str, dict[str, float]]]:
    """category and values of the cases at bounds, in order: each tried value of each parameter, then each speed with its least radius, one below and one above."""
    single = (("sf001", "lane_width", LANE_WIDTHS), ("sf002", "shoulder_width", SHOULDER_WIDTHS), ("sf003", "hor_class", HOR_CLASSES), ("sf004", "passing_type", PASSING_TYPES))
    out = [(f"boundary_{k}", {p: float(v)}) for k, p, values in single for v in values]
    least = checks._radii()
    for s in SPEEDS:
        r = least[s - checks.RADIUS[0][0]]
        out += [("boundary_sf005", {"spl": float(s), "design_rad": x}) for x in (r, r - BELOW, r + ABOVE) if x > 0]
    return out


def digits(sizes: list[int], at: int = 0) -> list[str]:
    """For each size an expression over the draws _d0, _d1, ... of 60 bits, from number `at` on: its digit in mixed radix. Twenty bits of each draw are left over, so that no digit is favoured by more than a millionth."""
    out, below = [], 1
    for size in sizes:
        if below * size > 2**40:
            at, below = at + 1, 1
        out.append(f"(_d{at} div {below}L) % {size}L")
        below *= size
    return out


def cases(numbers: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """number, category, a column for each of FIELDS, expected_valid, expected_violations (rules, in order): the case that each number stands for.

    numbers: number, from 0 on; the first numbers are the cases at bounds, of the rest up to total a fifth is valid, a fifth invalid in one way, a quarter has
    two to five parameters that are tried in combination, and what is left is random. A case depends on its number, total and seed alone, however rows are
    dealt; a null number is no case, a number that is given twice is one twice, and numbers beyond total are random cases, too.
    """
    known = boundaries()
    rest = max(0, total - len(known))
    a, b = len(known) + rest // 5, len(known) + 2 * (rest // 5)
    c = b + rest // 4
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("number").cast("string"), F.lit(f"{seed}:{k}")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    n = numbers.where("number >= 0").select("number", *(draw(k).alias(f"_d{k}") for k in range(3)))
    of = lambda values, digit: F.get(F.array(*(F.lit(float(v)) for v in values)), F.expr(digit).cast("int"))
    part = lambda digit, first, by: (F.expr(digit) + first) / F.lit(float(by))
    least = [checks._radii()[s - checks.RADIUS[0][0]] for s in SPEEDS]

    lane, shoulder, kind, passing, speed, over = digits([301, 601, 6, 3, len(SPEEDS), 501])
    valid = {"lane_width": part(lane, 900, 100), "shoulder_width": part(shoulder, 400, 100), "hor_class": part(kind, 0, 1), "passing_type": part(passing, 0, 1), "design_rad": of(least, speed) + F.expr(over), "spl": of(SPEEDS, speed)}

    which, side, low, above_lane, above_shoulder, wrong_class, wrong_type, share = digits([5, 2, 391, 791, 491, len(WRONG_CLASSES), len(WRONG_TYPES), 451], 1)
    low_side = F.expr(side) == 0
    wrong = {
        "lane_width": F.when(low_side, part(low, 500, 100)).otherwise(part(above_lane, 1210, 100)), "shoulder_width": F.when(low_side, part(low, 0, 100)).otherwise(part(above_shoulder, 1010, 100)),
        "hor_class": of(WRONG_CLASSES, wrong_class), "passing_type": of(WRONG_TYPES, wrong_type), "design_rad": F.greatest(F.lit(10.0), F.floor(of(least, speed) * (F.expr(share) + 500) / F.lit(100.0)) / F.lit(10.0)),
    }
    invalid = {p: F.when(F.expr(which) == i, wrong[p]).otherwise(valid[p]) for i, p in enumerate(wrong)} | {"spl": valid["spl"]}

    many, coin1, coin2, coin3, l, s, h, t, v, fair, up, down = digits([4, 2, 2, 10, len(LANE_WIDTHS), len(SHOULDER_WIDTHS), len(HOR_CLASSES), len(PASSING_TYPES), len(SPEEDS), 2, 501, 151])
    has = lambda count, also: (F.expr(many) + 2 >= count) | also
    road = has(5, F.expr(coin3) >= 4)
    tried = F.when(F.expr(fair) == 0, of(least, v) + F.expr(up)).otherwise(F.greatest(F.lit(50.0), of(least, v) - 50 - F.expr(down)))
    mixed = {"lane_width": of(LANE_WIDTHS, l), "shoulder_width": of(SHOULDER_WIDTHS, s), "hor_class": F.when(has(3, F.expr(coin1) == 0), of(HOR_CLASSES, h)), "passing_type": F.when(has(4, F.expr(coin2) == 0), of(PASSING_TYPES, t)), "design_rad": F.when(road, tried), "spl": F.when(road, of(SPEEDS, v))}

    l, s, h, t, v, r = digits([1501, 1701, 12, 7, len(SPEEDS), 19501])
    free = {"lane_width": part(l, 500, 100), "shoulder_width": part(s, -200, 100), "hor_class": part(h, -1, 1), "passing_type": part(t, -1, 1), "design_rad": part(r, 500, 10), "spl": of(SPEEDS, v)}

    at = F.col("number")
    given = lambda p: F.get(F.array(*(F.lit(values.get(p)).cast("double") for _, values in known)), at.cast("int"))
    value = lambda p: F.when(at < len(known), given(p)).when(at < a, valid[p]).when(at < b, invalid[p]).when(at < c, mixed[p]).otherwise(free[p])
    names = F.get(F.array(*(F.lit(k) for k, _ in known)), at.cast("int"))
    category = F.when(at < len(known), names).when(at < a, "valid_only").when(at < b, "invalid_only").when(at < c, "combinatorial").otherwise("random")
    made = n.select("number", category.alias("category"), *(value(p).alias(p) for p in FIELDS))
    found = checks.fixed_checks(FIELDS, CONSTRAINTS)
    broken = F.array_compact(F.array(*(F.when(k.end > 1, F.lit(k.rule.replace("SV-005", "SF-005"))) for k in found)))
    return made.withColumn("expected_violations", broken).withColumn("expected_valid", F.size("expected_violations") == 0)
