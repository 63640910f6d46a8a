"""Column functions: clocks, classes, ages, weather, names, calendars, reliability, scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """c held between low and high; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def rate(num: Column, den: Column) -> Column:
    """num / den, null where den is 0."""
    return F.when(den > 0, num.cast("double") / den)


def weighted_present(parts: list[tuple[float | Column, Column]], default: float | None = None) -> Column:
    """Weighted mean of the values that are present, weights renormalised; else the default."""
    one = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    top = sum((F.when(c.isNotNull(), one(w) * c).otherwise(0.0) for w, c in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), one(w)).otherwise(0.0) for w, c in parts), F.lit(0.0))
    return F.when(weight > 0, top / weight).otherwise(F.lit(default).cast("double"))


def unfused(c: Column) -> Column:
    """The same column, which keeps its projection out of whole-stage code.

    For projections of many expressions: Spark then cuts them into methods that the JVM compiles,
    while a fused method of more than 8,000 bytes stays interpreted, several times slower. Meant
    for a plain column, as what is inside is not compiled either.
    """
    return F.element_at(F.transform(F.array(c), lambda v: v), 1)


def time_seconds(c: Column) -> Column:
    """Clock text (s.f, m:s.f or h:m:s.f) in seconds; anything else is null."""
    parts = F.split(F.trim(c), ":")
    whole = lambda i: parts[i].try_cast("int")
    last = F.element_at(parts, -1).try_cast("double")
    return F.when(F.size(parts) == 1, last).when(F.size(parts) == 2, whole(0) * 60 + last).when(F.size(parts) == 3, whole(0) * 3600 + whole(1) * 60 + last)


PRIZES = "struct<prizes:array<struct<rank:int,prize:double>>>"


def prize_map(c: Column) -> Column:
    """Prize JSON as a map of rank to amount; entries without rank or amount are left out."""
    prizes = F.from_json(c, PRIZES)["prizes"]
    return F.map_from_entries(F.transform(F.filter(prizes, lambda p: p["rank"].isNotNull() & p["prize"].isNotNull()), lambda p: F.struct(p["rank"], p["prize"])))


def prize_for(prizes: Column, finish: Column) -> Column:
    return F.coalesce(F.try_element_at(prizes, finish), F.lit(0.0))


#: Race-name patterns and their class labels; the first that matches holds.
CLASS_PATTERNS = (
    (r"گروه\s*1(?:\s|$|[^و0-9])", "group1"),
    (r"گروه\s*1\s*و\s*2", "group1_2"),
    (r"گروه\s*2", "group2"),
    (r"گروه\s*3", "group3"),
    (r"(?i)\(G1\)|G1\b", "g1"),
    (r"(?i)\(G2\)|G2\b", "g2"),
    (r"(?i)\(G3\)|G3\b", "g3"),
    (r"کلاس\s*([0-9]{1,2})", None),
    (r"مبتدی|نبرده", "maiden"),
    (r"میدن", "maiden"),
    (r"برنده", "winner"),
    (r"ایران\s*کاپ", "iran_cup"),
)
HANDICAP_BAND = r"از\s*\d+\s*تا\s*\d+"
#: Points that a class adds to the difficulty index.
CLASS_POINTS = {"group1": 25, "g1": 25, "group1_2": 18, "group2": 15, "g2": 15, "group3": 10, "g3": 10, "iran_cup": 12, "class1": 12, "class2": 8}


def race_class(c: Column) -> Column:
    out = F.when(c.isNull() | (c == ""), "unknown")
    for pattern, label in CLASS_PATTERNS:
        found = F.lit(label) if label else F.concat(F.lit("class"), F.regexp_extract(c, pattern, 1))
        out = out.when(c.rlike(pattern), found)
    return out.when(c.rlike(HANDICAP_BAND), "handicap_band").otherwise("other")


def class_points(c: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for label, points in CLASS_POINTS.items():
        out = out.when(c == label, points)
    return out.otherwise(0)


def distance_bucket(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c < 1200, "sprint").when(c < 1600, "mile").when(c < 2000, "mid").otherwise("staying")


def age_years(birth: Column, on: Column) -> Column:
    days = F.datediff(on, birth)
    return F.when(days >= 0, F.round(days / 365.25, 2))


def age_band(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c < 3, "2yo").when(c < 4, "3yo").when(c < 5, "4yo").when(c < 7, "5-6yo").otherwise("7yo+")


def finish_quality(c: Column) -> Column:
    return F.when(c <= 0, 0.0).otherwise(clamp(120.0 - 20.0 * c))


def finish_points(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), 100.0 - 12.0 * (c - 1)))  # greatest() would skip a null


#: WMO weather codes and their labels.
WMO_LABELS = {
    0: "clear", 1: "mainly_clear", 2: "partly_cloudy", 3: "overcast", 45: "fog", 48: "fog",
    51: "drizzle", 53: "drizzle", 55: "drizzle", 56: "freezing_drizzle", 57: "freezing_drizzle",
    61: "rain", 63: "rain", 65: "rain", 66: "freezing_rain", 67: "freezing_rain",
    71: "snow", 73: "snow", 75: "snow", 77: "snow", 80: "rain_showers", 81: "rain_showers", 82: "rain_showers",
    85: "snow_showers", 86: "snow_showers", 95: "thunderstorm", 96: "thunderstorm", 99: "thunderstorm",
}


def wmo_condition(code: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in WMO_LABELS.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(labels, code), F.concat(F.lit("code_"), code.cast("string"))))


def weather_category(condition: Column, precip: Column) -> Column:
    c, wet = F.lower(condition), F.coalesce(precip > 0.2, F.lit(False))
    return (
        F.when((condition.isNull() | (condition == "")) & wet, "precip").when(condition.isNull() | (condition == ""), "unknown")
        .when(c.isin("clear", "mainly_clear"), "clear").when(c.isin("partly_cloudy", "overcast"), "cloudy")
        .when(c.contains("thunder"), "storm").when(c.contains("fog"), "fog").when(c.contains("snow"), "snow")
        .when(c.rlike("rain|drizzle|shower") | wet, "precip").otherwise("unknown")
    )


def heat_index_c(temp: Column, humidity: Column) -> Column:
    """Rothfusz regression in Fahrenheit, back in Celsius; the dry bulb below 80 F."""
    t, rh = temp * 9.0 / 5.0 + 32.0, clamp(humidity)
    hi = -42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 6.83783e-3 * t * t - 5.481717e-2 * rh * rh + 1.22874e-3 * t * t * rh + 8.5282e-4 * t * rh * rh - 1.99e-6 * t * t * rh * rh
    return F.when(humidity.isNull(), None).when(t < 80.0, F.round(temp, 3)).otherwise(F.round((hi - 32.0) * 5.0 / 9.0, 3))


def track_condition(day: Column, d3: Column, d7: Column) -> Column:
    day, d3, d7 = (F.coalesce(c, F.lit(0.0)) for c in (day, d3, d7))
    return F.when((day >= 5) | (d3 >= 25), "muddy").when((day >= 2) | (d3 >= 12), "wet").when((d3 >= 4) | (d7 >= 15), "soft").when((d3 >= 1) | (day >= 0.2), "firm").otherwise("dry")


def surface_moisture(day: Column, d3: Column, d7: Column) -> Column:
    dry = lambda c, scale: 1.0 - F.exp(-F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) / scale)
    return F.round(clamp(0.45 * dry(day, 4.0) + 0.35 * dry(d3, 12.0) + 0.20 * dry(d7, 25.0), 0.0, 1.0), 4)


def temp_range(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c < 10, "cold").when(c < 18, "cool").when(c < 25, "mild").when(c < 32, "warm").otherwise("hot")


#: The points of the compass from north on.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def wind_compass(degrees: Column) -> Column:
    at = F.floor((F.pmod(degrees, F.lit(360.0)) + 11.25) / 22.5) % 16
    return F.element_at(F.array(*map(F.lit, COMPASS)), at.cast("int") + 1)


#: Letters that are written alike in Persian, and what is removed or kept as a digit.
LETTERS = ("كيىةؤإأآٱۀ", "کییهوااااه")
REMOVED = "​‌‍﻿⁠­ءٰٔ"
DIGITS = ("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")


@F.pandas_udf(T.StringType())
def nfkc(s):
    """Unicode compatibility form; only for text that isn't ASCII."""
    return s.str.normalize("NFKC")


def normalize_name(c: Column, compose: bool = False) -> Column:
    """One spelling for a name: Persian letters, ASCII digits, no marks, lower case, single spaces.

    With `compose`, non-ASCII names first go through NFKC, the only step that needs Python.
    """
    base = F.when(c.rlike(r"[^\x00-\x7F]"), nfkc(c)).otherwise(c) if compose else c
    plain = F.translate(F.translate(F.translate(base, REMOVED, ""), *LETTERS), *DIGITS)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " "), " +", " "))


def normalize_sex(c: Column) -> Column:
    n = F.regexp_replace(normalize_name(c), " ", "")
    return (
        F.when(c.isNull() | (n == ""), None).when(n.isin("نر", "مادهنر", "male", "colt", "stallion", "horse", "h"), "male")
        .when(n.isin("ماده", "female", "filly", "mare", "m"), "female").when(n.isin("اخته", "گلدینگ", "gelding", "g"), "gelding")
        .when(n.contains("اخته") | n.contains("geld"), "gelding").when(n.rlike("ماده|filly|mare") | (n == "f"), "female")
        .when(n.rlike("نر|colt|stallion") | (n == "c"), "male").otherwise("unknown")
    )


def bio_sex(raw: Column, age: Column) -> Column:
    """Colt, Filly, Stallion, Mare or Gelding; binary labels are refined by age."""
    r = F.lower(F.trim(raw))
    young = age < 4.999
    male, female = r.isin("نر", "male", "نریان"), r.isin("ماده", "female", "مادیان")
    return (
        F.when(r.isin("gelding", "اخته"), "Gelding").when(r.isin("colt", "filly", "stallion", "mare"), F.initcap(r))
        .when(male & young, "Colt").when(male, "Stallion").when(female & young, "Filly").when(female, "Mare")
    )


def is_female(sex: Column) -> Column:
    return sex.isin("Filly", "Mare")


def is_male(sex: Column) -> Column:
    return sex.isin("Colt", "Stallion", "Gelding")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def jalali_ymd(c: Column) -> Column:
    """Jalali year, month and day of a date: 33-year cycles of 12053 days and 4-year runs of 1461."""
    days = F.datediff(c, F.lit("1600-03-20").cast("date"))  # day 0 is the first of 979
    cycle, rest = _div(days, 12053), days % 12053
    four, left = _div(rest, 1461), rest % 1461
    more = F.when(left >= 366, _div(left - 1, 365)).otherwise(0)
    day = F.when(left >= 366, (left - 1) % 365).otherwise(left)
    year = 979 + 33 * cycle + 4 * four + more
    month = F.when(day < 186, _div(day, 31) + 1).otherwise(_div(day - 186, 30) + 7)
    of_month = F.when(day < 186, day % 31 + 1).otherwise((day - 186) % 30 + 1)
    return F.struct(year.cast("int").alias("y"), month.cast("int").alias("m"), of_month.cast("int").alias("d"))


def jalali_text(c: Column) -> Column:
    p = jalali_ymd(c)
    return F.format_string("%04d/%02d/%02d", p["y"], p["m"], p["d"])


def from_jalali(y: Column, m: Column, d: Column) -> Column:
    """The date of a Jalali year, month and day."""
    k = y - 979
    days = 365 * k + _div(k, 33) * 8 + _div(F.pmod(k, F.lit(33)) + 3, 4) + F.when(m <= 7, (m - 1) * 31).otherwise(186 + (m - 7) * 30) + d - 1
    return F.date_add(F.lit("1600-03-20").cast("date"), days.cast("int"))


def jalali_bounds(y: Column, m: Column) -> Column:
    """First and last date of a Jalali month."""
    nxt = from_jalali(F.when(m == 12, y + 1).otherwise(y), F.when(m == 12, 1).otherwise(m + 1), F.lit(1))
    return F.struct(from_jalali(y, m, F.lit(1)).alias("first"), F.date_sub(nxt, 1).alias("last"))


def synthetic_course(name: Column) -> Column:
    """Code of a track without an entry in the registry: an ASCII slug, or 10 digits of its SHA-1."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("t"), F.substring(F.sha1(name), 1, 10)))


def reliability(n: Column) -> Column:
    return F.when(n < 3, "LOW").when(n < 5, "MEDIUM-LOW").when(n < 10, "MEDIUM").otherwise("HIGH")


def eb_rate(s: Column, n: Column, prior: Column, m: float = 5.0) -> Column:
    """Empirical-Bayes rate, null without evidence."""
    return F.when(n > 0, (s + m * prior) / (n + m))


def sample_confidence(n: Column) -> Column:
    return F.when(n <= 0, 0.0).when(n == 1, 20.0).when(n == 2, 40.0).when(n <= 4, 60.0).when(n <= 9, 85.0).otherwise(95.0)


def confidence(n: Column, missing: Column, complete: Column) -> Column:
    """Half the sample, a quarter each for missing values and completeness, held down for small samples."""
    c = 0.5 * sample_confidence(n) + 0.25 * (1 - clamp(missing, 0.0, 1.0)) * 100 + 0.25 * clamp(complete, 0.0, 1.0) * 100
    cap = F.when(n <= 0, 15.0).when(n == 1, 35.0).when(n == 2, 55.0).when(n <= 4, 75.0).otherwise(100.0)
    return F.least(c, cap)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 92, "very_high").when(score >= 80, "high").when(score >= 60, "medium").when(score >= 40, "low").otherwise("very_low")


def market_band(score: Column) -> Column:
    return F.when(score >= 85, "Very High").when(score >= 70, "High").when(score >= 50, "Medium").when(score >= 30, "Low").otherwise("Very Low")


def dq_label(missing: Column, n: Column) -> Column:
    return F.when(n <= 0, "insufficient").when(missing > 0.4, "poor").when(missing > 0.2, "fair").when(n < 5, "limited_sample").otherwise("good")


#: How a race's name states its restrictions.
AGE_PATTERN = r"(?i)(?:(\d+)\s*ساله)|(?:(\d+)\s*year)|(?:age[s]?\s*(\d+))"
SEX_PATTERN = r"(?i)(مادیان|نریان|filly|mare|colt|gelding|female|male|fillies|mares)"


def age_restriction(name: Column) -> Column:
    found = F.concat(*(F.regexp_extract(name, AGE_PATTERN, i) for i in (1, 2, 3)))
    return F.when(found != "", F.concat(found, F.lit("yo")))


def sex_restriction(name: Column) -> Column:
    found = F.regexp_extract(name, SEX_PATTERN, 1)
    return F.when(found != "", F.lower(found))


def is_valid_url(c: Column) -> Column:
    return c.rlike(r"^https?://[^/\s?#]+")


def is_valid_clock(c: Column) -> Column:
    return c.rlike(r"^(\d+:)?\d{1,3}(\.\d+)?$")


def consistency(finishes_sd: Column, n: Column) -> Column:
    return F.when(n == 1, 100.0).when(n > 1, clamp(100.0 * F.exp(-finishes_sd / 2.5)))


def fatigue(gap: Column, starts_30: Column) -> Column:
    step = F.when(gap.isNull(), 0.0).when(gap <= 3, 90.0).when(gap <= 7, 70.0).when(gap <= 14, 40.0).when(gap <= 28, 20.0).otherwise(5.0)
    return F.when(gap.isNotNull() | (starts_30 > 0), F.round(clamp(0.6 * step + 0.4 * clamp(starts_30 * 18.0)), 3))


def difficulty_index(mean_rating: Column, field: Column, klass: Column) -> Column:
    score = clamp((F.coalesce(mean_rating, F.lit(40.0)) - 30.0) * 1.1)
    return F.round(clamp(0.55 * score + 0.25 * clamp(field * 6.0) + class_points(klass)), 3)


def performance_rating(starts: Column, wins: Column, seconds: Column, thirds: Column, avg_finish: Column, steady: Column, difficulty: Column, form: Column, speed: Column) -> Column:
    """Weighted mean of outcome rates, finish, consistency, opposition, form and speed; earnings stay out."""
    share = lambda x: F.when(starts > 0, clamp(100.0 * x / starts))
    return weighted_present([
        (18.0, share(wins)), (8.0, share(seconds)), (5.0, share(thirds)), (15.0, share(wins + seconds + thirds)),
        (15.0, clamp(120.0 - 12.5 * avg_finish)), (12.0, F.when(starts >= 3, steady)), (6.0, F.when(starts == 2, steady)),
        (12.0, difficulty), (10.0, clamp(form)), (5.0, clamp(speed)),
    ])
