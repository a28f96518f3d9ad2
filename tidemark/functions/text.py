"""Text, number and date functions as Column expressions.

White space, numbers and number text follow ECMAScript, since the layers' publishers and clients do: ``WS`` includes the
no-break space, an empty string counts as the number 0, and 5.0 prints as 5.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import session

#: ECMAScript white space and line terminators, as a character class.
WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
DETAIL = T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.StringType())])
LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.StringType())])


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it; plans of nested text rules stay small."""
    return F.get(F.transform(F.array(value), f), 0)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space."""
    # a single space stays as it is, so most of a text needs no replacement
    return F.regexp_replace(c, f"{WS}{{2,}}|{WS.replace(' ', '', 1)}", " ")


def some(c: Column) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(trim(c), F.lit(""))


def prop(properties: Column, key: str) -> Column:
    """A property of a variant: its trimmed text if it is a non-empty string, else null; numbers aren't converted."""
    value = F.try_variant_get(properties, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", let(trim(F.try_variant_get(properties, f"$.{key}", "string")), lambda v: F.when(v != "", v)))


def flag(properties: Column, key: str) -> Column:
    """Whether a property is true, or the string 'true'."""
    return F.coalesce(F.try_variant_get(properties, f"$.{key}", "string") == "true", F.lit(False))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def http_url(c: Column) -> Column:
    return F.when(c.rlike("(?i)^https?://"), c)


def yes_no(c: Column) -> Column:
    return F.when(F.lower(c) == "yes", True).when(F.lower(c) == "no", False)


def yes_no_label(c: Column) -> Column:
    return F.when(yes_no(c), "Yes").when(~yes_no(c), "No")


def sentence_label(c: Column) -> Column:
    """First letter large, the rest small; NA and N/A are no value."""
    low = F.lower(c)
    return F.when(~c.rlike("(?i)^n/?a$"), F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2))))


def presence_label(c: Column, label: str) -> Column:
    return F.when(~c.rlike("(?i)^n/?a$"), F.lit(label))


def detail(label: str, value: Column) -> Column:
    return let(value, lambda v: F.when(v != "", F.struct(F.lit(label).alias("label"), v.alias("value"))))


def non_empty(array: Column) -> Column:
    return let(array, lambda a: F.when(F.size(a) > 0, a))


def details(*items: Column) -> Column:
    return non_empty(F.filter(F.array(*items), lambda x: x.isNotNull()))


def tags(array: Column) -> Column:
    """Non-empty tags; of those that differ in case only, the first; null if none."""
    kept = F.filter(array, lambda t: t.isNotNull() & (t != ""))
    empty = F.array().cast("array<string>")
    fold = F.aggregate(kept, empty, lambda seen, t: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(t)), seen).otherwise(F.concat(seen, F.array(t))))
    return non_empty(fold)


def tags_csv(c: Column) -> Column:
    return let(c, lambda a: F.when(F.size(a) > 0, F.concat(F.lit(","), F.array_join(a, ","), F.lit(","))))


def kind_and_period(c: Column) -> Column:
    """(kind, period) of 'kind - period'; what follows a second dash is dropped."""
    part = lambda parts, i: F.nullif(F.get(parts, i), F.lit(""))
    parts = F.transform(F.split(c, f"{WS}+-{WS}+", -1), trim)
    return let(parts, lambda p: F.when(part(p, 0).isNotNull(), F.struct(part(p, 0).alias("kind"), part(p, 1).alias("period"))))


def date_only(c: Column) -> Column:
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd")


def _number(bare: Column) -> Column:
    based = [F.when(bare.rlike(rule), F.conv(F.substr(bare, F.lit(3)), base, 10).cast("double")) for rule, base in ((r"^0[xX][0-9a-fA-F]+$", 16), (r"^0[oO][0-7]+$", 8), (r"^0[bB][01]+$", 2))]
    return F.when(bare == "", 0.0).when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double")).otherwise(F.coalesce(*based))


def _finite(c: Column) -> Column:
    return let(c, lambda v: F.when(F.abs(v) < float("inf"), v))


def parse_number(c: Column) -> Column:
    """The finite number that ECMAScript reads from a text; '' is 0; null if there is none."""
    return _finite(let(trim(c), _number))


def number_prop(properties: Column, key: str) -> Column:
    """A property that is a finite number, or a text that reads as one."""
    kind = F.schema_of_variant(F.try_variant_get(properties, f"$.{key}", "variant"))
    text = let(trim(F.try_variant_get(properties, f"$.{key}", "string")), _number)
    return _finite(F.when(kind == "STRING", text).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(properties, f"$.{key}", "double")))


def number_text(c: Column) -> Column:
    """A number without a trailing .0."""
    return let(c, lambda v: F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("bigint").cast("string")).otherwise(v.cast("string")))


def depth(average: Column, most: Column, average_is_least: Column, most_is_least: Column) -> Column:
    plus = lambda f: F.when(f, "+").otherwise("")

    def shown(x):
        a, m = x["a"], x["m"]
        return (
            F.when(a.isNotNull() & m.isNotNull() & (a != m), F.concat(number_text(a), F.lit("–"), number_text(m), plus(most_is_least), F.lit(" m")))
            .when(m.isNotNull(), F.concat(number_text(m), plus(most_is_least), F.lit(" m")))
            .when(a.isNotNull(), F.concat(number_text(a), plus(average_is_least), F.lit(" m")))
        )

    return let(F.struct(average.alias("a"), most.alias("m")), shown)


def video_ids(c: Column) -> Column:
    """Ids of a list of 'id,start,end' entries."""
    entries = F.split(F.coalesce(c, F.lit("")), f"{WS}+")
    return non_empty(F.filter(F.transform(entries, lambda e: trim(F.substring_index(e, ",", 1))), lambda i: i.rlike("^[A-Za-z0-9_-]{6,}$")))


def links(c: Column) -> Column:
    """(url, label) of a list of 'url|label' entries; only http(s)."""
    entries = F.split(F.coalesce(c, F.lit("")), f"{WS}+")

    def link(e):
        at = F.locate("|", e)
        url = F.when(at > 0, F.substring_index(e, "|", 1)).otherwise(e)
        label = F.when(at > 0, F.nullif(trim(F.substr(e, at + 1)), F.lit("")))
        return F.struct(url.alias("url"), label.alias("label"))

    return non_empty(F.filter(F.transform(entries, link), lambda x: x["url"].rlike("(?i)^https?://")))


def rating(value: Column, count: Column) -> Column:
    return let(F.struct(value.alias("v"), count.alias("n")), lambda x: F.when((x["v"] > 0) & (x["n"] > 0), F.struct(x["v"].alias("value"), F.floor(x["n"] + 0.5).cast("bigint").alias("count"))))


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(trim(c)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 120)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def compatible(c: Column) -> Column:
    """NFKC; ASCII texts stay as they are."""
    session.ship_active()
    return F.when(c.rlike("^[\\x00-\\x7F]*$"), c).otherwise(nfkc(c))


def swears(c: Column, words) -> Column:
    """Whether one of ``words`` stands alone in the text, in any case."""
    return F.lower(compatible(c)).rlike(f"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])")


# Facts in prose.

#: Names of months, and the patterns that state what counts as a fact.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE = r"(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?([A-Za-z]+)\s+(\d{4})"
FROM = rf"(?i)(?:in place|effective|valid|applicable|enforced)[^.]*?\bfrom(?:\s+the)?\s+{DATE}"
UNTIL = rf"(?i)(?:until|till|up to|to)(?:\s+the)?\s+{DATE}"
NOTICE = r"(?i)notices? to mariners\b.{0,40}?\bof\s+(\d{4})"
REFERENCE = r"(?i)(?:local\s+)?notices? to mariners\b.{0,40}?\bof\s+\d{4}"
METRES = r"(?i)distance of\s+(\d+(?:\.\d+)?)\s*(?:m\b|metres|meters)"
MILES = r"(?i)(?:distance|zone) of\s+(\d+(?:\.\d+)?)\s*(?:nm\b|nautical miles?)"
NAUTICAL_MILE = 1852.0


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def prose(c: Column) -> Column:
    return collapse(without_tags(c))


def group(c: Column, pattern: str, n: int) -> Column:
    """A group of the first match, or null."""
    return let(F.regexp_extract(c, pattern, n), lambda v: F.when(v != "", v))


def _date(c: Column, pattern: str, end_of_day: bool) -> Column:
    """The date that the first match states; the pattern's groups are its day, month and year."""
    clock = " 23:59:59.999" if end_of_day else " 00:00:00"
    months = F.array(*[F.lit(m) for m in MONTHS])

    def stated(parts):
        month = let(F.array_position(months, F.lower(F.get(parts, 1))), lambda m: F.when(m > 0, m.cast("int")))
        return F.concat(F.format_string("%04d-%02d-", F.get(parts, 2).cast("int"), month), F.lpad(F.get(parts, 0), 2, "0"), F.when(month > 0, clock)).try_cast("timestamp_ntz")

    return let(group(c, pattern, 0), lambda m: let(F.split(F.regexp_replace(m, pattern, "$1 $2 $3"), " "), stated))


def _notice_date(bare: Column) -> Column:
    return let(group(bare, NOTICE, 1).cast("int"), lambda year: F.when(year.between(2000, 2100), F.format_string("%04d-01-01 00:00:00", year)).try_cast("timestamp_ntz"))


def _source_url(plain: Column) -> Column:
    return F.regexp_replace(group(plain, "(?i)https?://[^\\s\"'<>]+", 0), "[.,;)]+$", "")


def _distance(plain: Column, metres_times: float = 1.0) -> Column:
    both = F.struct(group(plain, METRES, 1).cast("double").alias("m"), group(plain, MILES, 1).cast("double").alias("n"))
    value = lambda x: F.coalesce(F.when(x["n"].isNotNull(), x["m"] * metres_times).otherwise(x["m"]), x["n"] * NAUTICAL_MILE)
    return let(both, lambda x: let(value(x), lambda v: F.when(v > 0, v)))


def valid_from(c: Column) -> Column:
    return let(prose(c), lambda p: _date(p, FROM, end_of_day=False))


def valid_to(c: Column) -> Column:
    """The last millisecond of the stated day."""
    return let(prose(c), lambda p: _date(p, UNTIL, end_of_day=True))


def notice_date(c: Column) -> Column:
    """1 January of the year of the notice that the text names, if it is between 2000 and 2100."""
    return _notice_date(without_tags(c))


def notice_reference(c: Column) -> Column:
    return trim(group(prose(c), REFERENCE, 0))


def source_url(c: Column) -> Column:
    return _source_url(prose(c))


def distance_metres(c: Column, metres_times: float = 1.0) -> Column:
    """Metres, or nautical miles in metres.

    Where a text states both, the metres are multiplied by ``metres_times``: as they are, or by ``NAUTICAL_MILE`` for the
    result of services that read the first number in the last unit.
    """
    return _distance(prose(c), metres_times)


def facts(c: Column) -> Column:
    """All facts of a text as one struct; its tags and white space are taken out once."""

    def read(plain, bare):
        return F.struct(
            _date(plain, FROM, end_of_day=False).alias("valid_from"),
            _date(plain, UNTIL, end_of_day=True).alias("valid_to"),
            _notice_date(bare).alias("notice_date"),
            trim(group(plain, REFERENCE, 0)).alias("reference"),
            _source_url(plain).alias("url"),
            _distance(plain).alias("distance"),
        )

    return let(without_tags(c), lambda bare: let(collapse(bare), lambda plain: read(plain, bare)))


def zone_name(c: Column) -> Column:
    return trim(collapse(compatible(c)))


def zone_identity(name: Column) -> Column:
    return F.lower(name)


def sub_key(layer: Column, name: Column) -> Column:
    return F.concat(layer, F.lit(":"), F.substring(F.sha2(zone_identity(name), 256), 1, 20))


MARKER = r"^\([^)]{1,8}\)\s*"


def display_name(c: Column) -> Column:
    """Without a marker such as '(1A)' in front, unless nothing else is there."""
    return F.coalesce(F.nullif(trim(F.regexp_replace(c, MARKER, "")), F.lit("")), c)


def plain_source(c: Column) -> Column:
    return trim(prose(c))


def long_date(c: Column) -> Column:
    return F.date_format(c, "d MMMM yyyy")


#: Dates and times as views read them, and those that a field of a form takes as they are.
ISO = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"
FIELD = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"


def iso_time(c: Column) -> Column:
    """The time (in the session's zone where it names none) of an ISO text with year, month and day in parts; else null."""
    return F.when(c.rlike(ISO), F.try_to_timestamp(F.replace(c, F.lit(","), F.lit("."))))


def view_date(c: Column) -> Column:
    """A text's time for a table, such as '19 Jun 2026, 23:41'; the text itself where it has none, empty for null."""
    return F.coalesce(F.date_format(iso_time(c), "dd MMM yyyy, HH:mm"), c, F.lit(""))


def view_relative(c: Column, now: Column) -> Column:
    """A text's time as seen from ``now``, such as '2 hours ago', in the largest unit that is full; empty without a time."""

    def phrase(at):
        out = None
        for unit in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
            n = F.timestamp_diff(unit, now, at)
            size = F.concat(F.abs(n).cast("string"), F.lit(f" {unit.lower()}"), F.when(F.abs(n) == 1, "").otherwise("s"))
            said = F.when(at < now, F.concat(size, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), size))
            full = (n != 0) | F.lit(unit == "SECOND")
            out = F.when(full, said) if out is None else out.when(full, said)
        return F.when(at.isNotNull(), out)

    return F.coalesce(let(iso_time(c), phrase), F.lit(""))


def datetime_local(c: Column) -> Column:
    """A text's date and minute for a field of a form: as written where it has them, else in the session's zone, else the text."""
    return F.when(c.rlike(FIELD), F.substring(c, 1, 16)).otherwise(F.coalesce(F.date_format(iso_time(c), "yyyy-MM-dd'T'HH:mm"), c, F.lit("")))


def fact_lines(distance: Column, start: Column, end: Column, reference: Column) -> Column:
    lines = F.array(
        F.when(distance.isNotNull(), F.concat(F.lit("Vessels must keep at least "), number_text(distance), F.lit(" m clear."))),
        F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("In force from "), long_date(start), F.lit(" until "), long_date(end), F.lit(".")))
        .when(start.isNotNull(), F.concat(F.lit("In force from "), long_date(start), F.lit("."))),
        F.when(reference.isNotNull(), F.concat(F.lit("Established by "), reference, F.lit("."))),
    )
    return F.filter(lines, lambda x: x.isNotNull())


RESTRICTIONS = "Restrictions:"
MOST_RESTRICTIONS = 12


def compose_description(summary: Column, restrictions: Column) -> Column:
    lines = F.filter(F.transform(F.slice(restrictions, 1, MOST_RESTRICTIONS), trim), lambda x: x != "")
    block = F.concat(F.lit(f"{RESTRICTIONS}\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))
    parts = F.filter(F.array(trim(summary), trim(block)), lambda x: x != "")
    return F.array_join(parts, "\n\n")


def iso_millis(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def job_id(prefix: str, as_of: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(as_of, "yyyy-MM-dd"))


def error_code(c: Column) -> Column:
    """camelCase text becomes CAMEL_CASE."""
    parted = F.regexp_replace(F.regexp_replace(trim(c), "([a-z])([A-Z])", "$1_$2"), "[^a-zA-Z0-9]+", "_")
    return F.upper(F.regexp_replace(parted, "^_+|_+$", ""))


#: Property names that may hold a feature's label, the first that is set wins.
FEATURE_LABELS = ("name", "title", "NAME", "Name", "label", "LABEL", "SITE_NAME")


def feature_label(properties: Column) -> Column:
    """The first of the label properties that is set and isn't empty, zero or false; else the empty text."""
    values = [F.try_variant_get(properties, f"$.{n}", "string") for n in FEATURE_LABELS]
    return F.coalesce(*[F.when(~v.isin("", "0", "false"), v) for v in values], F.lit(""))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)
