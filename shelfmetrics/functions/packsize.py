"""Pack sizes from titles and details: readings, their agreement, and a size or a reason to abstain.

All of it is column expressions over arrays of at most nine readings. Lambdas run on the JVM; no Python worker is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .units import ALIASES, agree, canonical_unit, dimension, factor

TOLERANCE = 0.02
MOST_PACKS = 24  # "N pack" above that is a number of pieces

# Nouns that are counted, and the patterns of amounts in normalised titles.
COUNTED = (
    r"count|ct|capsules?|caps|vcaps|veg(?:gie)?\s*caps(?:ules)?|tablets?|tabs|caplets?|softgels?|soft\s*gels|gummies|gummy|pieces|pcs|pc|bags|wipes|sheets|pods|packets|sachets|sticks|"
    r"lozenges|rolls|towelettes|pads|liners|napkins|cups|plates|bars|chews|lollipops|patches|strips|swabs|tampons|diapers|pairs|refills|cartridges|filters|batteries|ea|each"
)
UNIT = "|".join(f"(?:{p})" for p, _ in ALIASES)
NUMBER = r"(\d+(?:\.\d+)?|\d+/\d+)"
FRESH = r"(?<![\w.])"  # a number doesn't follow a word character or a dot
SIZE = rf"{FRESH}{NUMBER}\s*-?\s*({UNIT})(?![a-z])"
COUNT = rf"{FRESH}(\d+)\s*-?\s*(?:{COUNTED})(?![a-z])"
APOSTROPHE = rf"{FRESH}(\d+)'s\b|{FRESH}(\d{{2,}})s\b"
N_BY_SIZE = rf"{FRESH}(\d+)\s*x\s*{NUMBER}\s*-?\s*({UNIT})(?![a-z])"
N_BY_COUNT = rf"{FRESH}(\d+)\s*x\s*(\d+)\s*-?\s*(?:{COUNTED}|pack|pk)(?![a-z])"
N_PACKS_OF = rf"{FRESH}(\d+)\s*-?\s*(?:packs?|boxes|bottles|tubes|cans|jars|bags)\s+of\s+(\d+)\b"
PACK_OF = r"\b(?:pack|set|case|bundle|lot)\s+of\s+(\d+)\b"
N_PACK = rf"{FRESH}(\d+)\s*-?\s*(?:pack|pk|packs|count\s+pack)(?![a-z])"
PER_CONTAINER = rf"{FRESH}(\d+)\s*/\s*(?:bag|box|pack|case|bottle|roll)\b|\b(?:box|bag|tub|jar|bottle)\s+of\s+(\d+)\b"
KIT = r"\b(?:kit|includes)\b"
CONTAINER = (
    r"\b(?:cups?|glass(?:es)?|containers?|tumblers?|mugs?|bowls?|plates?|lids?|liners?|trash\s+bags?|garbage\s+bags?|can\s+liners?|buckets?|pitchers?|flasks?|shaker|dispensers?|"
    r"spray\s+bottles?|empty|reusable\s+bottles?|water\s+bottles?|sleeves?)\b"
)
NUTRITION = rf"{FRESH}{NUMBER}\s*g\s+(?:of\s+)?(?:protein|sugars?|fiber|fibre|carbs?|net\s+carbs|fat|collagen|creatine)\b"
STANDARD_FORM = (
    r"^\s*\d+(?:\.\d+)?\s+(?:count|fl\.? oz|fluid ounces?|ounces?|ounce|pounds?|grams?|kilograms?|milliliters?|liters?|gallons?|quarts?|pints?)\b(?:\s*\(pack of \d+\))?\s*$"
)
QUANTITY = rf"^\s*{NUMBER}\s*({UNIT}|count|ct)\b"

# Confidence by case, the first that applies.
WEAK, DISSENT, TITLE_AND_STRONG, TWO_STRONG, TITLE_FLAGGED, TITLE_ALONE, ONE_STRONG = 0.4, 0.3, 0.95, 0.85, 0.6, 0.8, 0.75

READING = "struct<dimension:string,count:double,size:double,unit:string,source:string,strong:boolean>"
_MERGED = "struct<state:string,value:double>"


def _u(pattern: str, flags: str = "U") -> str:
    return f"(?{flags}){pattern}"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(_u(pattern)), F.lit(group))


def _first(text: Column, pattern: str, group: int, flags: str = "U") -> Column:
    return F.nullif(F.regexp_extract(text, _u(pattern, flags), group), F.lit(""))


def number(text: Column) -> Column:
    """A decimal or a simple fraction; null for a zero denominator, or digits that a cast doesn't know."""
    parts = F.split(text, "/")
    return F.when(text.contains("/"), F.try_divide(parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(text.try_cast("double"))


def _numbers(texts: Column) -> Column:
    return F.transform(texts, lambda x: x.try_cast("double"))


def _either(text: Column, pattern: str) -> Column:
    """The group that matched, of two."""
    return _numbers(F.zip_with(_all(text, pattern, 1), _all(text, pattern, 2), lambda a, b: F.when(a == "", b).otherwise(a)))


def normalised(title: Column) -> Column:
    text = F.replace(F.replace(F.lower(title), F.lit("×"), F.lit(" x ")), F.lit("*"), F.lit(" x "))
    text = F.regexp_replace(text, r"(?U)(?<=\d),(?=\d{3}\b)", "")
    return F.regexp_replace(text, _u(NUTRITION), " ")


def reading(dim: Column, count: Column, size: Column, unit: Column, source: str, strong: Column | bool = True) -> Column:
    return F.struct(
        dim.alias("dimension"), count.alias("count"), size.alias("size"), unit.alias("unit"), F.lit(source).alias("source"), (F.lit(strong) if isinstance(strong, bool) else strong).alias("strong")
    ).cast(READING)


def merged(values: Column, multiplier: Column) -> Column:
    """What repeated mentions come to: none, ok with a value, or conflict.

    Mentions that agree give the first as written. Of two amounts, the larger may be the smaller times the multiplier.
    """
    apart = F.aggregate(
        F.array_sort(values),
        F.array().cast("array<double>"),
        lambda seen, v: F.when(F.exists(seen, lambda s: agree(v, s, TOLERANCE)), seen).otherwise(F.concat(seen, F.array(v))),
    )
    low, high = F.get(apart, F.lit(0)), F.get(apart, F.lit(1))
    is_total = (F.size(apart) == 2) & multiplier.isNotNull() & agree(high, low * multiplier, TOLERANCE)
    state = F.when(F.size(values) == 0, "none").when((F.size(apart) == 1) | F.coalesce(is_total, F.lit(False)), "ok").otherwise("conflict")
    value = F.when(F.size(apart) == 1, F.get(values, F.lit(0))).when(is_total, low)
    return F.struct(state.alias("state"), value.alias("value")).cast(_MERGED)


def _title_columns(df: DataFrame, title: str) -> DataFrame:
    """Adds _t (normalised), _container, _readings (from the title), _flag and _lone (a lone multiplier)."""
    df = stage(df, {"_t": normalised(F.col(title))})
    t = F.col("_t")
    df = stage(
        df,
        {
            "_container": t.rlike(_u(CONTAINER)),
            "_packs": _numbers(_all(t, N_PACK, 1)),
            "_of": _numbers(_all(t, PACK_OF, 1)),
            "_amounts": F.zip_with(_all(t, SIZE, 1), _all(t, SIZE, 2), lambda n, u: F.struct(number(n).alias("n"), canonical_unit(u).alias("unit"))),
        }
    )
    df = stage(
        df,
        {
            "_mults": F.concat("_of", F.filter("_packs", lambda n: n <= MOST_PACKS)),
            "_counts": F.concat(_numbers(_all(t, COUNT, 1)), _either(t, APOSTROPHE), _either(t, PER_CONTAINER), F.filter("_packs", lambda n: n > MOST_PACKS)),
            "_amounts": F.when(~F.col("_container"), F.filter("_amounts", lambda a: a["n"].isNotNull() & a["unit"].isNotNull())).otherwise(F.filter("_amounts", lambda a: F.lit(False))),
        }
    )
    first_mult = F.get("_mults", F.lit(0))
    df = stage(
        df,
        {
            "_mult": F.nullif(first_mult, F.lit(0.0)),
            "_lone": F.when((F.size(F.array_distinct("_mults")) == 1) & (first_mult > 1), first_mult),
            "_weights": F.filter("_amounts", lambda a: dimension(a["unit"]) == "weight"),
            "_volumes": F.filter("_amounts", lambda a: dimension(a["unit"]) == "volume"),
        }
    )
    for d in ("weight", "volume"):
        unit = F.get(f"_{d}s", F.lit(0))["unit"]
        df = stage(df, {f"_{d}_unit": unit})
        each = factor(F.col(f"_{d}_unit"))
        df = stage(df, {f"_{d}": merged(F.transform(f"_{d}s", lambda a: a["n"] * factor(a["unit"]) / each), F.col("_mult"))})  # noqa: B023
    df = stage(df, {"_count": merged(F.col("_counts"), F.col("_mult"))})

    pack, one = F.coalesce("_mult", F.lit(1.0)), F.lit(1.0)
    weight, volume, count = (F.col(f"_{d}")["state"] for d in ("weight", "volume", "count"))
    by_weight = reading(F.lit("weight"), pack, F.col("_weight")["value"], F.col("_weight_unit"), "title")
    by_volume = reading(F.lit("volume"), pack, F.col("_volume")["value"], F.col("_volume_unit"), "title")
    sized_count = F.col("_count")["value"] * pack
    each_weight = reading(F.lit("weight"), sized_count, F.col("_weight")["value"], F.col("_weight_unit"), "title")
    each_volume = reading(F.lit("volume"), sized_count, F.col("_volume")["value"], F.col("_volume_unit"), "title")
    by_count = reading(F.lit("count"), pack, F.col("_count")["value"], F.lit("ct"), "title")
    times_unit = canonical_unit(_first(t, N_BY_SIZE, 3))
    times = reading(dimension(times_unit), _first(t, N_BY_SIZE, 1).try_cast("double"), number(_first(t, N_BY_SIZE, 2)), times_unit, "title")
    counted = [reading(F.lit("count"), _first(t, p, 1).try_cast("double"), _first(t, p, 2).try_cast("double"), F.lit("ct"), "title") for p in (N_BY_COUNT, N_PACKS_OF)]
    is_times = times_unit.isNotNull() & ~F.col("_container")
    is_counted = [_first(t, p, 1).isNotNull() for p in (N_BY_COUNT, N_PACKS_OF)]
    early = is_times | is_counted[0] | is_counted[1]
    both = (weight == "ok") & (volume == "ok")
    flag = (
        F.when(early, None)
        .when(F.size(F.array_distinct("_mults")) > 1, "title_conflicting_pack_counts")
        .when(weight == "conflict", "title_conflicting_weight")
        .when(volume == "conflict", "title_conflicting_volume")
        .when(count == "conflict", "title_conflicting_counts")
        .when((count == "ok") & ((weight == "ok") | (volume == "ok")), "title_size_count_ambiguous")
        .when(both, "title_weight_and_volume")
    )
    none = F.array().cast(f"array<{READING}>")
    readings = (
        F.when(is_times, F.array(times))
        .when(is_counted[0], F.array(counted[0]))
        .when(is_counted[1], F.array(counted[1]))
        .when(F.col("_flag").startswith("title_conflicting"), none)
        .when((count == "ok") & (weight == "ok"), F.array(each_weight))
        .when((count == "ok") & (volume == "ok"), F.array(each_volume))
        .when(both, F.array(by_weight, by_volume))
        .when(weight == "ok", F.array(by_weight))
        .when(volume == "ok", F.array(by_volume))
        .when(count == "ok", F.array(by_count))
        .otherwise(none)
    )
    # a reading without an amount, from a zero denominator, is none
    return stage(stage(df, {"_flag": flag}), {"_title_readings": F.filter(readings, lambda r: r["size"].isNotNull() & r["count"].isNotNull())})


def _detail(value: Column, source: str, strong: Column | bool = True) -> Column:
    """A leading quantity, times a pack count; one piece in all is filler."""
    n, raw = number(_first(value, QUANTITY, 1, "iU")), F.lower(_first(value, QUANTITY, 2, "iU"))
    packs = F.coalesce(_first(value, r"pack of (\d+)", 1, "iU").try_cast("double"), F.lit(1.0))
    unit = F.when(raw.isin("count", "ct"), "ct").otherwise(canonical_unit(raw))
    filler = (unit == "ct") & (n * packs <= 1)
    return F.when(n.isNotNull() & unit.isNotNull() & ~filler, reading(dimension(unit), packs, n, unit, source, strong))


def _digits(value: Column, source: str, strong: bool) -> Column:
    n = F.trim(value).try_cast("double")
    return F.when(value.rlike(r"^\s*[0-9]+\s*$") & (n > 1), reading(F.lit("count"), F.lit(1.0), n, F.lit("ct"), source, strong))


def _detail_readings(details: Column, title_count: Column, container: Column) -> Column:
    value = lambda key: F.nullif(F.try_element_at(details, F.lit(key)), F.lit(""))
    found = []
    for key, source in (("Size", "size_field"), ("Unit Count", "unit_count")):
        r = _detail(value(key), source, F.coalesce(value(key).rlike(_u(STANDARD_FORM, "iU")), F.lit(False)))
        found.append(F.when(~container | (r["dimension"] == "count"), r))
    volumes = [_detail(value(key), "volume_field") for key in ("Item Volume", "Liquid Volume", "Volume")]
    volume = F.coalesce(*[F.when(r["dimension"] == "volume", r) for r in volumes])
    found.append(F.when(~container & volume.isNotNull(), reading(F.lit("volume"), F.coalesce(title_count, F.lit(1.0)), volume["size"], volume["unit"], "volume_field")))
    for key, strong in (("Sheet Count", True), ("Number of Pieces", True), ("Number of Items", False), ("Item Package Quantity", False)):
        found.append(_digits(value(key), key.lower().replace(" ", "_"), strong))
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def _total(r: Column) -> Column:
    return r["count"] * r["size"] * factor(r["unit"])


def _grouped(readings: Column) -> Column:
    """First-fit groups of readings of the same amount, each by its first reading."""
    kind = f"array<struct<dimension:string,total:double,members:array<{READING}>>>"
    fits = lambda g, r: (g["dimension"] == r["dimension"]) & agree(g["total"], _total(r), TOLERANCE)

    def put(groups: Column, r: Column) -> Column:
        place = F.array_position(F.transform(groups, lambda g: fits(g, r)), F.lit(True))
        joined = F.transform(
            groups,
            lambda g, k: F.struct(g["dimension"].alias("dimension"), g["total"].alias("total"), F.when(k + 1 == place, F.concat(g["members"], F.array(r))).otherwise(g["members"]).alias("members")),
        )
        fresh = F.struct(r["dimension"].alias("dimension"), _total(r).alias("total"), F.array(r).alias("members"))
        return F.when(place > 0, joined).otherwise(F.concat(groups, F.array(fresh))).cast(kind)

    return F.aggregate(readings, F.array().cast(kind), put)


def extract_pack_sizes(items: DataFrame, threshold: float = 0.7, title: str = "title", details: str = "details") -> DataFrame:
    """Adds pack (a struct, null where it abstains), confidence, flag (why it abstains) and readings.

    pack has count, size, unit, dimension, total_base (grams, millilitres or pieces), confidence and sources (sorted).
    details is a map of strings. Null titles and details are empty. All other columns are kept.
    """
    df = stage(items, {"_title": F.coalesce(F.col(title), F.lit("")), "_details": F.coalesce(F.col(details), F.create_map().cast("map<string,string>"))})
    df = _title_columns(df, "_title")
    many = F.get(F.filter("_title_readings", lambda r: r["count"] > 1), F.lit(0))["count"]
    df = stage(df, {"_many": many, "_holds": F.lower("_title").rlike(_u(CONTAINER))})
    df = stage(df, {"_details_read": _detail_readings(F.col("_details"), F.col("_many"), F.col("_holds"))})
    is_kit = F.lower("_title").rlike(_u(KIT))
    conflict = F.coalesce(F.col("_flag").startswith("title_conflicting"), F.lit(False))
    df = stage(df, {"readings": F.when(is_kit | conflict, F.array().cast(f"array<{READING}>")).otherwise(F.concat("_title_readings", "_details_read"))})
    df = stage(df, {"_groups": _grouped(F.col("readings"))})
    strong = lambda g: F.array_distinct(F.transform(F.filter(g["members"], lambda r: r["strong"]), lambda r: r["source"]))
    ranked = F.transform("_groups", lambda g, k: F.struct(F.size(strong(g)).alias("strong"), F.size(g["members"]).alias("size"), (-k).alias("at")))
    df = stage(df, {"_best": F.get("_groups", -F.array_max(ranked)["at"])})
    best = F.col("_best")
    df = stage(
        df,
        {
            "_strong": F.size(strong(best)),
            "_by_title": F.exists(best["members"], lambda r: r["source"] == "title"),
            "_dissent": F.exists("readings", lambda r: r["strong"]) & (F.size(F.filter("readings", lambda r: r["strong"])) > F.size(F.filter(best["members"], lambda r: r["strong"]))),
        }
    )
    ratio = best["total"] / F.col("_lone")
    clash = (F.size("_title_readings") == 0) & F.col("_lone").isNotNull() & (best["dimension"] == "count") & (F.abs(ratio - F.rint(ratio)) > 1e-9)
    dissent = F.col("_dissent") | F.coalesce(clash, F.lit(False))
    cases = [
        (is_kit, 0.0, F.lit("title_is_kit")),
        (conflict, 0.3, F.col("_flag")),
        (F.size("readings") == 0, 0.0, F.lit("no_size_found")),
        (F.col("_strong") == 0, WEAK, F.lit("only_weak_sources")),
        (dissent, DISSENT, F.lit("sources_disagree")),
        (F.col("_by_title") & (F.col("_strong") >= 2), TITLE_AND_STRONG, F.lit(None)),
        (F.col("_strong") >= 2, TWO_STRONG, F.lit(None)),
        (F.col("_by_title") & F.col("_flag").isNotNull(), TITLE_FLAGGED, F.col("_flag")),
        (F.col("_by_title"), TITLE_ALONE, F.lit(None)),
        (F.lit(True), ONE_STRONG, F.lit(None)),
    ]
    confidence, reason = F.lit(None).cast("double"), F.lit(None).cast("string")
    for case, level, why in reversed(cases):
        case = F.coalesce(case, F.lit(False))
        confidence, reason = F.when(case, F.lit(level)).otherwise(confidence), F.when(case, why).otherwise(reason)
    df = stage(df, {"confidence": confidence, "_reason": reason})
    returned = (F.col("confidence") >= threshold) & best.isNotNull()
    shown = F.coalesce(F.get(F.filter(best["members"], lambda r: r["source"] == "title"), F.lit(0)), F.get(F.filter(best["members"], lambda r: r["strong"]), F.lit(0)))
    df = stage(df, {"_shown": shown})
    r = F.col("_shown")
    pack = F.struct(
        r["count"].alias("count"),
        r["size"].alias("size"),
        r["unit"].alias("unit"),
        r["dimension"].alias("dimension"),
        _total(r).alias("total_base"),
        F.col("confidence").alias("confidence"),
        F.sort_array(F.array_distinct(F.transform(best["members"], lambda m: m["source"]))).alias("sources"),
    )
    out = stage(df, {"pack": F.when(returned, pack), "flag": F.when(~F.coalesce(returned, F.lit(False)), F.coalesce("_reason", F.lit("below_threshold")))})
    return out.select(*items.columns, "pack", "confidence", "flag", "readings")
